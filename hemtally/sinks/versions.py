"""Tables replaced a day at a time in one commit: days are staged in folders of their own, and a small list says which folder holds which day."""

from __future__ import annotations

import json
import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from hemtally.functions.dates import days_before
from hemtally.sinks.daily import snapshot_rows
from hemtally.sources.shared import remove_path


class DayTable:
    """A table in ``path`` whose loads replace whole days, all or nothing.

    A load writes its days below ``data/load=<id>/`` and then one list of all days' folders, ``_versions/<number>``, by renaming a finished file
    to a name that must not exist. Until then readers see the version before; of two loads that start from the same version the second one fails.
    The list has one entry per day. ``vacuum`` removes the folders that the newest version does not name.
    """

    def __init__(self, spark: SparkSession, path: str, day_column: str = "event_date") -> None:
        self.spark, self.day_column = spark, day_column
        self.path = path.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def load(self, df: DataFrame, run_date: date | str) -> int:
        """Replace the day before the run and every other day in ``df``, as ``load_snapshot`` does; without rows for the day before, that day is empty
        from now on. Returns the new version."""
        (yesterday,) = days_before(run_date, 1, 1)
        rows = snapshot_rows(df, run_date, self.day_column)
        version, schema, days = self.newest()
        plain = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema if f.name != self.day_column])
        if schema is not None and schema != plain:
            raise TypeError(f"the table has {schema.simpleString()}, the load {plain.simpleString()}")
        load = f"data/load={uuid.uuid4().hex}"
        rows.write.partitionBy(self.day_column).parquet(f"{self.path}/{load}")
        staged = {day: f"{load}/{day}" for day in self._names(load) if day.startswith(f"{self.day_column}=")}
        kept = {day: folder for day, folder in days.items() if day != f"{self.day_column}={yesterday}"}
        self._commit(version + 1, json.dumps({"schema": plain.jsonValue(), "days": kept | staged}))
        return version + 1

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest unless given."""
        number, schema, days = self.newest() if version is None else (version, *self._version(version))
        if schema is None:
            raise FileNotFoundError(f"{self.path} has no version")
        schema = T.StructType([*schema.fields, T.StructField(self.day_column, T.DateType())])
        if not days:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema).option("basePath", f"{self.path}/data")
        return reader.parquet(*(f"{self.path}/{folder}" for folder in days.values())).select(*schema.names)

    def newest(self) -> tuple[int, T.StructType | None, dict[str, str]]:
        """(number, columns besides the day, folder of each day); 0 before the first load."""
        number = max((int(name) for name in self._names("_versions") if name.isdigit()), default=0)
        return (number, *self._version(number)) if number else (0, None, {})

    def vacuum(self) -> int:
        """Remove what only older versions or failed loads hold; returns the number of folders removed. Not while a load runs."""
        number, _, days = self.newest()
        loads = {folder.split("/")[1] for folder in days.values()}
        old = [f"data/{name}" for name in self._names("data") if name not in loads]
        old += [f"data/{load}/{day}" for load in loads for day in self._names(f"data/{load}")
                if day.startswith(f"{self.day_column}=") and days.get(day) != f"data/{load}/{day}"]
        old += [f"_versions/{name}" for name in self._names("_versions") if name != _file_name(number)]
        for name in old:
            remove_path(self.spark, f"{self.path}/{name}")
        return len(old)

    def _version(self, number: int) -> tuple[T.StructType, dict[str, str]]:
        where = f"{self.path}/_versions/{_file_name(number)}"
        told = json.loads("\n".join(r[0] for r in self.spark.read.text(where, wholetext=True).collect()))
        return T.StructType.fromJson(told["schema"]), told["days"]

    def _commit(self, number: int, text: str) -> None:
        staged, final = (self._hadoop.fs.Path(f"{self.path}/_versions/{n}") for n in (f".{uuid.uuid4().hex}", _file_name(number)))
        out = staged.getFileSystem(self._conf).create(staged)
        out.write(bytearray(text.encode()))
        out.close()
        kind = getattr(self._hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.NONE  # an existing file is an error
        self._hadoop.fs.FileContext.getFileContext(final.toUri(), self._conf).rename(staged, final, options)

    def _names(self, folder: str) -> list[str]:
        where = self._hadoop.fs.Path(f"{self.path}/{folder}")
        system = where.getFileSystem(self._conf)
        return [s.getPath().getName() for s in system.listStatus(where)] if system.exists(where) else []


def _file_name(number: int) -> str:
    return f"{number:012d}"
