"""The generation ledger: each request once, resumed after a failure, nothing on a second run."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from lorewell.operators import generations, ledger


def counting(folder, fail=lambda text: False):
    """A generator that leaves a file a call."""

    def generate(messages):
        text = messages[-1]["content"]
        with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
            f.write(text)
        if fail(text):
            raise ConnectionError(text)
        return text.upper()

    return generate


def asks(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    message = F.struct(F.lit("user").alias("role"), F.col("t").alias("content"))
    return df.withColumn("messages", F.array(message))


@pytest.fixture
def calls(tmp_path):
    folder = tmp_path / "calls"
    folder.mkdir()
    return folder


def test_each_request_once(spark, tmp_path, calls):
    path, df = str(tmp_path / "ledger"), asks(spark, [f"q{i % 40}" for i in range(200)])
    for _ in range(2):
        got = ledger.generate_once(df, path, counting(str(calls)), part=15).collect()
        assert len(got) == 200 and all(r["reply"] == r["t"].upper() and r["reply_error"] is None for r in got)
    assert len(list(calls.iterdir())) == 40 and ledger.summary(spark, path) == {"requests": 40, "replies": 40, "calls": 40}
    ledger.generate_once(asks(spark, ["q1", "new"]), path, counting(str(calls)))
    assert len(list(calls.iterdir())) == 41
    assert len(generations.manifest(spark, path)["parts"]) >= 4


def test_failures_are_tried_anew_up_to_a_bound(spark, tmp_path, calls):
    path, df = str(tmp_path / "ledger"), asks(spark, ["good", "bad", "bad"])
    for n, want in ((1, 2), (2, 3), (3, 3)):
        got = {r["t"]: (r["reply"], r["reply_error"]) for r in ledger.generate_once(df, path, counting(str(calls), lambda t: t == "bad"), attempts=2).collect()}
        assert got == {"good": ("GOOD", None), "bad": (None, "ConnectionError: bad")} and len(list(calls.iterdir())) == want, n
    got = ledger.generate_once(df, path, counting(str(calls)), attempts=3).collect()
    assert all(r["reply"] for r in got) and len(list(calls.iterdir())) == 4


def test_a_run_that_is_cut_off_is_resumed(spark, tmp_path, calls, monkeypatch):
    path, df = str(tmp_path / "ledger"), asks(spark, [f"q{i}" for i in range(60)])
    real, published = generations.append, []

    def stop(*a):
        if len(published) == 2:
            raise KeyboardInterrupt
        published.append(real(*a))

    monkeypatch.setattr(generations, "append", stop)
    with pytest.raises(KeyboardInterrupt):
        ledger.generate_once(df, path, counting(str(calls)), part=10)
    monkeypatch.setattr(generations, "append", real)
    before = len(list(calls.iterdir()))
    assert 0 < before < 60 == len(ledger.generate_once(df, path, counting(str(calls)), part=10).where("reply IS NOT NULL").collect())
    assert len(list(calls.iterdir())) == 60


def test_models_nulls_and_empty(spark, tmp_path):
    path, df = str(tmp_path / "ledger"), asks(spark, ["a"])
    ledger.generate_once(df, path, lambda m: "one", model="x")
    assert ledger.generate_once(df, path, lambda m: "two", model="y").first()["reply"] == "two"
    nothing = df.withColumn("messages", F.lit(None).cast(df.schema["messages"].dataType))
    row = ledger.generate_once(nothing, path, lambda m: "three", attempts=1).first()
    assert row["reply"] is None and row["reply_error"].startswith("TypeError")
    assert ledger.generate_once(df.limit(0), path).count() == 0


class Tasks:
    """Counts the tasks of the jobs of a group."""

    def __init__(self, spark):
        self.sc = spark.sparkContext

    def of(self, name, f):
        self.sc.setJobGroup(name, name)
        f()
        self.sc.setLocalProperty("spark.jobGroup.id", None)
        seen = self.sc.statusTracker()
        stages = {s for j in seen.getJobIdsForGroup(name) for s in seen.getJobInfo(j).stageIds}
        return sum(i.numCompletedTasks for i in map(seen.getStageInfo, stages) if i)


def test_a_part_does_not_read_the_ledger(spark, tmp_path):
    """Tasks follow the parts: twice the parts are not four times the tasks."""
    tasks = Tasks(spark)
    few, many = (tasks.of(f"fill-{n}", lambda n=n: ledger.generate_once(asks(spark, [f"q{i}" for i in range(n)]), str(tmp_path / str(n)), part=4)) for n in (40, 80))
    assert len(generations.manifest(spark, str(tmp_path / "80"))["parts"]) >= 18 and many < 2.4 * few, (few, many)
    scans = [s for s in generations.read(spark, str(tmp_path / "80"))._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Relation" in s]
    assert len(scans) == 1
    assert not list((tmp_path / "80" / generations.STAGED).iterdir())


def test_what_another_run_publishes_meanwhile_is_not_asked_again(spark, tmp_path, calls, monkeypatch):
    path, df = str(tmp_path / "ledger"), asks(spark, [f"q{i}" for i in range(30)])
    real, other = generations.append, []

    def beside(*a):
        version = real(*a)
        if not other:
            other.append(True)
            ledger.generate_once(df, path, counting(str(calls)), part=100)
        return version

    monkeypatch.setattr(generations, "append", beside)
    assert ledger.generate_once(df, path, counting(str(calls)), part=10).where("reply IS NOT NULL").count() == 30
    assert len(list(calls.iterdir())) == 30 and ledger.summary(spark, path) == {"requests": 30, "replies": 30, "calls": 30}
