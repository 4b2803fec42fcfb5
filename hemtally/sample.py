"""Inputs of the operators derived from TPC-H-like tables, as FIXTURES.md describes them.

Every table is read whole: each list has a row for every customer. Whether a row finds a partner is decided by its value: a customer
that should miss lists the hash of another text.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hemtally.operators.weblog import log_columns
from hemtally.sources.shared import remove_path

# Run dates that fit the derived tables.
IMPRESSION_RUN = date(2001, 8, 2)
ACTIVITY_RUN = date(2024, 1, 31)


class Sample:
    """The derived tables of one data folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def impressions(self) -> DataFrame:
        order = F.col("o_orderkey")
        return self.table("orders").select(
            _md5("o_custkey").alias("md5"),
            F.col("o_orderdate").cast("date").alias("date_p"),
            F.struct(F.concat(F.lit("10.0.0."), (order % 8).cast("string")).alias("ip")).alias("request"),
            F.when(order % 3 == 0, "phone").when(order % 3 == 1, "tablet").alias("dev_type"),
            F.concat(F.lit("maker"), (F.col("o_custkey") % 5).cast("string")).alias("dev_maker"),
            F.concat(F.lit("browser"), (order % 4).cast("string")).alias("nbrowser"),
            F.col("o_orderstatus").alias("os"),
            F.col("o_orderpriority").alias("category_id"),
        )

    def emails(self) -> DataFrame:
        """Two snapshots of all customers; in the newer one those below a balance list another text's hash, the richest twice."""
        customer = self.table("customer")
        key = F.col("c_custkey").cast("string")
        listed = F.when(F.col("c_acctbal") >= 4500, F.md5(key)).otherwise(F.md5(F.concat(key, F.lit("x"))))
        newer = _copies(customer, F.col("c_acctbal") >= 9000).select(listed.alias("md5"), F.lit("20240201").alias("date_p"))
        return newer.union(customer.select(F.md5(key), F.lit("20240101")))

    def client_mixed(self) -> DataFrame:
        customer = self.table("customer")
        kind = F.col("c_custkey") % 6
        hem = (
            F.when(kind == 0, F.md5("c_name"))
            .when(kind == 1, F.sha1("c_name"))
            .when(kind == 2, F.sha2("c_name", 256))
            .when(kind == 3, F.upper(F.md5("c_name")))
            .when(kind != 4, "not-a-hash")
        )
        extra = F.when(F.col("c_acctbal") >= 9000, F.array(hem, F.md5("c_name"))).otherwise(F.array(hem))
        return customer.select(F.explode(extra).alias("hem"))

    def client_md5(self) -> DataFrame:
        hem = F.when(F.col("c_nationkey") != 0, F.md5(_listed("BUILDING"))).alias("hem")
        return self._listed_twice().select(hem)

    def client_sha1(self) -> DataFrame:
        return self._listed_twice().select(F.sha1(_listed("AUTOMOBILE")).alias("sh1"))

    def client_sha2(self) -> DataFrame:
        return self._listed_twice().select(F.sha2(_listed("MACHINERY"), 256).alias("sh2"))

    def _listed_twice(self) -> DataFrame:
        """All customers, those with a high balance twice."""
        return _copies(self.table("customer"), F.col("c_acctbal") >= 8000)

    def pairs(self) -> DataFrame:
        number = F.col("o_orderkey") % 80
        older = F.col("o_orderdate").cast("date") < F.lit(date(2001, 1, 1))
        return (
            self.table("orders")
            .join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                F.md5("c_name").alias("hem"),
                F.when(number == 0, "aaid")
                .when(number == 1, "idfa")
                .otherwise((F.lit(100) + number).cast("string"))
                .alias("domain"),
                F.when(F.col("n_regionkey") == 1, "US").otherwise("EU").alias("region"),
                F.when(older, "20001231").otherwise("20010801").alias("date_p"),
            )
        )

    def domain_names(self) -> DataFrame:
        """Names for the numeric domains; the mobile ones have none."""
        number = F.lit(100) + F.col("n_nationkey")
        return self.table("nation").select(number.cast("string").alias("id"), F.col("n_name").alias("name"))

    def graph(self) -> DataFrame:
        customer = self.table("customer")
        key, md5 = F.col("c_custkey"), F.md5("c_name")
        plain = F.concat(F.lit("x"), md5)
        parts = [F.substring(md5, start, size) for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
        return (
            customer.select(
                F.when(F.col("c_acctbal") < 9000, md5).otherwise(F.md5(F.concat("c_name", F.lit("x")))).alias("hash"),
                F.concat(F.when(key % 2 == 0, "d").otherwise("l"), key.cast("string")).alias("cookie"),
                F.when(key % 2 == 0, F.concat_ws("-", *parts)).otherwise(plain).alias("identifier"),
                F.lit("20240130").alias("date_p"),
            )
            .union(
                customer.select(md5, F.concat(F.lit("d"), key.cast("string")), plain, F.lit("20240110"))
            )
        )

    def hash_lookup(self) -> DataFrame:
        customer = self.table("customer")

        def part(name: Column, snapshot: str) -> DataFrame:
            return customer.select(
                F.md5(name).alias("md5"), F.sha1(name).alias("sh1"), F.sha2(name, 256).alias("sh2"), F.lit(snapshot).alias("date_p")
            )

        known = F.when(F.col("c_acctbal") >= 0, F.col("c_name")).otherwise(F.concat("c_name", F.lit("y")))
        return part(known, "20240115").union(part(F.col("c_name"), "20231231"))

    def weblog(self) -> DataFrame:
        event, user = F.col("event_id"), F.col("user_id").cast("string")
        return self.table("events").select(
            F.col("ts"),
            F.col("ts").cast("date").alias("log_date"),
            (F.lit(100) + event % 4).cast("string").alias("adv_id"),
            F.when(event % 5 == 0, "null").otherwise(F.concat(F.lit("d"), user)).alias("domain_user_id"),
            F.when(event % 7 == 0, None)
            .when(event % 3 == 0, "null")
            .otherwise(F.concat(F.lit("l"), user))
            .alias("linked_cookie"),
        )

    def raw_log(self, base: str) -> None:
        """The web log as it arrives: ``base/yyyy/MM/dd/HH/``, 24 fields without names, separated by tabs, for each half of a day."""
        staged = f"{base}-staged"
        fields = {name: F.lit(f"field {n}") for n, name in enumerate(log_columns())}
        log = self.weblog().select("adv_id", "domain_user_id", "linked_cookie", "ts")
        fields |= {name: F.col(name) for name in ("adv_id", "domain_user_id", "linked_cookie")}
        half = F.format_string("%02d", F.hour("ts") - F.hour("ts") % 12)
        parts = {"y": F.date_format("ts", "yyyy"), "m": F.date_format("ts", "MM"), "d": F.date_format("ts", "dd"), "h": half}
        rows = log.select(*(c.alias(n) for n, c in (fields | parts).items()))
        rows.write.partitionBy(*parts).option("sep", "\t").csv(staged)
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        system = path(staged).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for found in system.globStatus(path(f"{staged}/*/*/*/*")):
            hour = found.getPath()
            names = str(hour.toString()).rsplit("/", 4)[1:]
            target = path("/".join([base, *(name.split("=")[1] for name in names)]))
            system.mkdirs(target.getParent())
            system.rename(hour, target)
        remove_path(self.spark, staged)

    def uneven_lines(self) -> DataFrame:
        """Lines of three fields; every seventh customer's has two, every eleventh's four."""
        key = F.col("c_custkey")
        fields = F.concat_ws(";", key.cast("string"), "c_mktsegment", F.when(key % 7 != 0, F.col("c_name")), F.when((key % 7 != 0) & (key % 11 == 0), "more"))
        return self.table("customer").select(fields.alias("value"))

    def clusters(self) -> DataFrame:
        fourth = F.col("l_suppkey") % 4
        domain = F.when(fourth == 0, "aaid").when(fourth == 1, "idfa").otherwise(fourth.cast("string"))
        token = F.concat(domain, F.lit(":"), F.col("l_partkey").cast("string"))
        order = F.col("l_orderkey")
        tokens = (
            F.when(order % 50 == 0, "no-colon-token")
            .when(order % 17 == 0, None)
            .when(order % 11 == 0, F.concat("tokens", F.lit("|")))
            .otherwise(F.col("tokens"))
        )
        return (
            self.table("lineitem")
            .groupBy("l_orderkey")
            .agg(F.listagg(token, F.lit("|")).alias("tokens"))
            .select(order.alias("cluster_id"), tokens.alias("tokens"))
        )

    def file(self) -> DataFrame:
        nation = F.when(F.col("c_custkey") % 3 != 0, F.col("c_nationkey").cast("string"))
        return self.table("customer").select(
            F.col("c_custkey").cast("string").alias("_c0"), F.col("c_mktsegment").alias("_c1"), nation.alias("_c2")
        )

    def load_target(self) -> DataFrame:
        return self.table("events").select(
            F.col("event_type").alias("kind"),
            F.col("user_id").alias("user"),
            F.col("ts").cast("date").alias("event_date"),
        )

    def load_incoming(self) -> DataFrame:
        return self.table("events").select(F.lit("reloaded").alias("kind"), F.col("user_id").alias("user"))

    def activity(self) -> DataFrame:
        day = F.col("ts").cast("date")
        return (
            self.table("events")
            .groupBy(F.col("user_id").alias("template_id"), day.alias("activity_date"))
            .agg(F.count("*").alias("decisions"))
        )

    def owners(self) -> DataFrame:
        return (
            self.table("customer")
            .join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                F.col("c_custkey").alias("template_id"),
                F.when(F.col("c_nationkey") % 2 == 0, F.concat("c_name", F.lit(' & <"x">'))).otherwise(F.col("c_name")).alias("template_name"),
                F.concat(F.lit(" "), F.lower("c_mktsegment"), F.lit("@example.com ")).alias("email_address"),
                F.col("c_mktsegment").alias("am_name"),
                F.col("c_nationkey").alias("publisher_id"),
                F.col("n_name").alias("pub_name"),
                F.col("r_regionkey").alias("media_group_id"),
                F.col("r_name").alias("media_group_name"),
            )
        )


def _copies(rows: DataFrame, twice: Column) -> DataFrame:
    """Every row, those that the condition holds for twice."""
    return rows.withColumn("_copy", F.explode(F.when(twice, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_copy")


def _listed(segment: str) -> Column:
    """A customer's name; outside the segment, a text that nothing else has."""
    return F.when(F.col("c_mktsegment") == segment, F.col("c_name")).otherwise(F.concat("c_name", F.lit("x")))


def _md5(column: str) -> Column:
    return F.md5(F.col(column).cast("string"))
