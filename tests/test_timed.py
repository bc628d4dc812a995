"""Joins and frames over time against DuckDB and plain loops; the registered queries are compared in test_catalogue."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lorewell.operators import timed

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "id long, k string, t timestamp, v double"


def made(n, seed):
    """Few instants, so that ties are many; a hot key; rows without key or time."""
    rng = random.Random(seed)
    at = lambda: T0 + dt.timedelta(seconds=rng.randrange(-400, 400) * 10)
    return [(i, rng.choice(["hot", "hot", "a", "b", None]), at() if rng.random() > 0.05 else None, rng.choice([None, 1.0, 2.0, 3.0])) for i in range(n)]


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("seconds", [30, 600, 86_400])
def test_as_of(spark, strict, seconds):
    a, b = made(300, 1), made(300, 2)
    right = spark.createDataFrame(b, SCHEMA).select("k", F.col("t").alias("rt"), F.col("id").alias("rid"), F.col("v").alias("rv"))
    out = timed.as_of(spark.createDataFrame(a, SCHEMA), right, "k", "t", "rt", ["rid", "rv"], "rid", strict, seconds)
    assert out.columns == ["id", "k", "t", "v", "rid", "rv"]
    for r in (rows := out.collect()):
        ok = [(t, i, v) for i, k, t, v in b if k is not None and t is not None and k == r["k"] and r["t"] is not None and (t < r["t"] if strict else t <= r["t"])]
        t, i, v = max(ok, key=lambda x: x[:2], default=(None, None, None))
        assert (r["rid"], r["rv"]) == (i, v), r
    assert sorted(r["id"] for r in rows) == list(range(300))


@pytest.mark.parametrize("bins", [1, 7])
def test_within(spark, bins):
    a, b = made(200, 3), made(200, 4)
    df = timed.within(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), "k", "t", "t", 60, bins=bins)
    want = sorted((i, j) for i, k, t, _ in a for j, m, u, _ in b if k is not None and k == m and t and u and abs((t - u).total_seconds()) <= 60)
    assert sorted((r["id"], r["right_id"]) for r in df.collect()) == want
    assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()


def test_contained(spark):
    points = made(200, 5)
    rng = random.Random(6)
    ranges = [(i, rng.choice(["hot", "a", None]), (s := T0 + dt.timedelta(seconds=rng.randrange(-4000, 4000))), s + dt.timedelta(seconds=rng.choice([-5, 0, 1, 900, 3000]))) for i in range(60)]
    df = timed.contained(spark.createDataFrame(points, SCHEMA), spark.createDataFrame(ranges, "id long, k string, a timestamp, b timestamp"), "k", "t", "a", "b", 300)
    want = sorted((i, j) for i, k, t, _ in points for j, m, s, e in ranges if k is not None and k == m and t and s <= t < e)
    assert sorted((r["id"], r["range_id"]) for r in df.collect()) == want and want


@pytest.mark.parametrize("seconds", [50, 86_400])
def test_trailing(spark, seconds):
    rows = made(300, 7)
    df = timed.trailing(spark.createDataFrame(rows, SCHEMA), "k", "t", 120, {"n": F.count(F.lit(1)), "total": F.sum("v"), "most": F.max("v")}, seconds)
    for r in (got := df.collect()):
        if r["k"] is None or r["t"] is None:
            assert r["n"] is None and r["total"] is None
            continue
        near = [v for _, k, t, v in rows if k == r["k"] and t is not None and 0 <= (r["t"] - t).total_seconds() <= 120]
        values = [v for v in near if v is not None]
        assert (r["n"], r["total"], r["most"]) == (len(near), sum(values) if values else None, max(values, default=None))
    assert len(got) == 300


def test_hot_key_is_many_groups(spark):
    """A key that holds every row: no group of a window or join holds more than a slice of it."""
    rows = spark.range(5_000).selectExpr("id", "'hot' AS k", "timestamp_micros(id * 1000000) AS t", "1.0D AS v")
    out = timed.trailing(rows, "k", "t", 100, {"n": F.count(F.lit(1))}, 500)
    assert out.where("n = 101").count() == 4_900
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "_s" in plan.split("hashpartitioning(")[1][:40] and "SinglePartition" not in plan


def test_names_and_empty(spark):
    a = spark.createDataFrame(made(5, 8), SCHEMA)
    with pytest.raises(ValueError, match="already"):
        timed.as_of(a, a, "k", "t", "t", ["v"], "id")
    empty = a.limit(0)
    right = a.select("k", F.col("t").alias("rt"), F.col("id").alias("rid"))
    assert timed.as_of(empty, right, "k", "t", "rt", ["rid"], "rid").count() == 0
    assert timed.as_of(a, right.limit(0), "k", "t", "rt", ["rid"], "rid").where("rid IS NULL").count() == 5
    assert timed.within(a, empty, "k", "t", "t", 60).count() == 0 and timed.trailing(empty, "k", "t", 60, {"n": F.count(F.lit(1))}).count() == 0
