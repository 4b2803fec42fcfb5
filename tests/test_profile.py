from __future__ import annotations

from hemtally.operators import merged_profile, preview, profile_file, profile_sketches
from helpers import rows


def test_counts_rows_and_distinct_values_without_nulls(spark):
    df = spark.createDataFrame([("a", None), ("a", "x"), ("b", None)], "c0 string, c1 string")
    assert rows(profile_file(df)) == [("c0", 3, 2), ("c1", 3, 1)]


def test_empty_file_gives_zeros(spark):
    df = spark.createDataFrame([], "c0 string, c1 string")
    assert rows(profile_file(df)) == [("c0", 0, 0), ("c1", 0, 0)]


def test_sketch_counts_rows_exactly_and_values_nearly(spark):
    df = spark.range(5000).selectExpr("cast(id as string) as c0", "cast(id % 7 as string) as c1")
    counts = {column: (n, distinct) for column, n, distinct in rows(profile_file(df, approx_rsd=0.02))}
    assert counts["c1"] == (5000, 7)
    assert counts["c0"][0] == 5000
    assert abs(counts["c0"][1] - 5000) < 5000 * 0.1


def test_column_names_with_dots(spark):
    df = spark.createDataFrame([("a",)], "`x.y` string")
    assert rows(profile_file(df)) == [("x.y", 1, 1)]


def test_preview(spark):
    assert preview(spark.range(20)).count() == 5


def test_distinct_counts_merge_over_days(spark):
    df = spark.range(30_000).selectExpr(
        "cast(id % 3 as string) as day", "cast(id % 20000 as string) as c0", "id % 7 as c1", "cast(null as string) as c2"
    )
    parts = [profile_sketches(df.filter(f"day = '{day}'"), "day") for day in range(3)]
    merged = {r["column"]: r for r in merged_profile(parts[0].union(parts[1]).union(parts[2])).collect()}
    assert {c: r["n_rows"] for c, r in merged.items()} == {"c0": 30_000, "c1": 30_000, "c2": 30_000}
    for column, exact in (("c0", 20_000), ("c1", 7), ("c2", 0)):
        assert merged[column]["n_least"] <= exact <= merged[column]["n_most"]
    assert merged["c0"]["n_most"] - merged["c0"]["n_least"] < 20_000 * 0.06
    twice = {r["column"]: r for r in merged_profile(parts[0].union(parts[0])).collect()}
    assert twice["c0"]["n_least"] <= 10_000 <= twice["c0"]["n_most"]
    assert merged_profile(profile_sketches(df.limit(0), "day")).collect() == []
