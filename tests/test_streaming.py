"""Streams against their batch forms: watermarks, late rows, restarts, list state, timers, initial state."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from lorewell.operators import memory
from lorewell.session import table
from lorewell.streaming import sessions, windows
from tests.conftest import SF

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "id long, k string, t timestamp"


def put(spark, path, rows):
    """One more file; a stream takes the oldest first."""
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    time.sleep(1.1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def test_late_rows_and_restart(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    put(spark, src, [(1, "a", at(1)), (2, "a", at(12)), (3, None, at(2)), (4, "a", None)])
    put(spark, src, [(5, "a", at(3)), (6, "b", at(40))])  # 3 is late but its window ends after the watermark, 12 - 10
    put(spark, src, [(8, "b", at(41))])
    put(spark, src, [(7, "a", at(4)), (10, "b", at(35))])  # 4 is behind the watermark, 40 - 10: it does not count; 35 does

    def take():
        stream = windows.file_stream(spark, src, SCHEMA, 1)
        return windows.run(windows.tumbling(stream, "t", ["k"], "10 minutes", "10 minutes", {"n": F.count(F.lit(1)), "ids": F.sort_array(F.collect_list("id"))}), out, cp)

    take()
    rows = lambda: sorted((r["k"] or "", r["starts"], r["ids"]) for r in spark.read.parquet(out).collect())
    assert rows() == [("", at(0), [3]), ("a", at(0), [1, 5]), ("a", at(10), [2])]
    take()  # nothing new: nothing is added
    assert len(rows()) == 3
    put(spark, src, [(9, "b", at(200))])
    take()
    assert rows() == [("", at(0), [3]), ("a", at(0), [1, 5]), ("a", at(10), [2]), ("b", at(30), [10]), ("b", at(40), [6, 8])]


def turns_of(spark, path, rows):
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.mode("append").parquet(path)
    time.sleep(1.1)


def latest(spark, out):
    """The last memory of every session that was written."""
    rows = spark.read.parquet(out)
    last = rows.groupBy("conv_id").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["conv_id", "batch"])


@pytest.fixture
def rocks(spark):
    old = spark.conf.get(sessions.PROVIDER[0])
    yield
    spark.conf.set(sessions.PROVIDER[0], old)


def test_list_state_equals_last_n(spark, tmp_path, rocks):
    conv = table(spark, SF, "conversations")
    src, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    for i in range(3):
        conv.where(f"turn % 3 = {i}").coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)
    stream = lambda: windows.file_stream(spark, src, conv.schema, 1)
    sessions.run(stream(), out, cp, 3)
    want = memory.last_n(conv, 3).select("conv_id", "turn", memory.normal_role(F.col("role")).alias("role"), "text")
    got = latest(spark, out).select("conv_id", "turn", "role", "text")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    batches = spark.read.parquet(out).select("batch").distinct().count()
    sessions.run(stream(), out, cp, 3)
    assert spark.read.parquet(out).select("batch").distinct().count() == batches


def test_clear_late_and_initial_state(spark, tmp_path, rocks):
    src, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    initial = spark.createDataFrame([(1, 0, "user", "old"), (1, 1, "bot", "older reply"), (2, 0, "user", "other")], "conv_id long, turn long, role string, text string")
    turns_of(spark, src, [(1, 3, "user", "c"), (3, None, None, None)])
    turns_of(spark, src, [(1, 2, "bot", "late"), (3, 5, "clear", None), (3, 6, "user", "new"), (3, 4, "user", "before the mark")])
    sessions.run(windows.file_stream(spark, src, initial.schema, 1), out, cp, 3, initial=initial)
    got = sorted((r["batch"], r["conv_id"], r["turn"], r["role"], r["text"]) for r in spark.read.parquet(out).where("conv_id <> 3 OR batch > 0").collect())
    assert got == [(0, 1, 0, "user", "old"), (0, 1, 1, "assistant", "older reply"), (0, 1, 3, "user", "c"), (1, 1, 1, "assistant", "older reply"), (1, 1, 2, "assistant", "late"), (1, 1, 3, "user", "c"), (1, 3, 6, "user", "new")]


def test_idle_sessions_are_forgotten(spark, tmp_path, rocks):
    src, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    turns_of(spark, src, [(1, 1, "user", "a")])
    stream = lambda: windows.file_stream(spark, src, "conv_id long, turn long, role string, text string", 1)
    sessions.run(stream(), out, cp, 3, idle_seconds=1)
    time.sleep(2.5)
    turns_of(spark, src, [(2, 1, "user", "wakes the stream")])
    sessions.run(stream(), out, cp, 3, idle_seconds=1)
    turns_of(spark, src, [(1, 2, "user", "b")])
    sessions.run(stream(), out, cp, 3, idle_seconds=1)
    assert [(r["turn"], r["text"]) for r in latest(spark, out).where("conv_id = 1").collect()] == [(2, "b")]
