"""Sketches against exact counts and ranks."""

import math
import random

from pyspark.sql import functions as F

from lorewell.operators import sketches
from lorewell.session import table
from tests.conftest import SF


def test_quantiles_are_within_their_bound(spark):
    rng = random.Random(1)
    rows = [(g, rng.choice([0.0, -1.0, 1.0]) * rng.expovariate(1) * 10 ** rng.randrange(-3, 6)) for g in "ab" for _ in range(3000)] + [("a", None), ("b", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    at = [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0]
    bins = sketches.quantile_bins(df, ["g"], "v")
    got = {(r["g"], r["q"]): r["value"] for r in sketches.quantiles(bins, ["g"], at).collect()}
    for g in "ab":
        values = sorted(v for k, v in rows if k == g and v is not None and not math.isnan(v))
        for q in at:
            exact = values[max(1, math.ceil(q * len(values))) - 1]
            assert abs(got[g, q] - exact) <= sketches.ERROR * abs(exact) * (1 + 1e-9), (g, q)
    assert len(got) == 2 * len(at)


def test_merged_days_equal_the_whole(spark, tmp_path):
    events = table(spark, SF, "events").withColumn("day", F.to_date("ts"))
    whole = {(r["event_type"], r["q"]): r["value"] for r in sketches.quantiles(sketches.quantile_bins(events, ["event_type"], "value"), ["event_type"], [0.1, 0.5, 0.99]).collect()}
    path = str(tmp_path / "bins")
    sketches.upsert_days(sketches.quantile_bins(events.where("day < '2024-01-15'"), ["day", "event_type"], "value"), path, "day")
    before = {f for r in spark.read.parquet(path).select("_metadata.file_path").distinct().collect() for f in r}
    sketches.upsert_days(sketches.quantile_bins(events.where("day >= '2024-01-15'"), ["day", "event_type"], "value"), path, "day")
    sketches.upsert_days(sketches.quantile_bins(events.where("day = '2024-01-20'"), ["day", "event_type"], "value"), path, "day")
    after = {f for r in spark.read.parquet(path).select("_metadata.file_path").distinct().collect() for f in r}
    assert before < after
    merged = sketches.merged_bins(spark.read.parquet(path), ["event_type"])
    assert {(r["event_type"], r["q"]): r["value"] for r in sketches.quantiles(merged, ["event_type"], [0.1, 0.5, 0.99]).collect()} == whole


def test_distinct_counts(spark):
    rows = table(spark, "/root/testdata/sf0.1", "lineitem").withColumn("month", F.trunc("l_shipdate", "month"))
    days = sketches.distinct_sketches(rows, ["month", "l_returnflag"], "l_orderkey")
    merged = sketches.distinct_counts(sketches.merged_distinct(days, ["l_returnflag"]))
    exact = {r["l_returnflag"]: r["n"] for r in rows.groupBy("l_returnflag").agg(F.count_distinct("l_orderkey").alias("n")).collect()}
    for r in merged.collect():
        assert abs(r["n_distinct"] / exact[r["l_returnflag"]] - 1) < 4 * 1.04 / 2**7
    nulls = spark.createDataFrame([("a", None), ("b", 1), ("b", 1)], "g string, v long")
    assert {(r["g"], r["n"], r["n_distinct"]) for r in sketches.distinct_counts(sketches.distinct_sketches(nulls, ["g"], "v")).collect()} == {("a", 0, 0), ("b", 2, 1)}
