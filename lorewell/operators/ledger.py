"""A generation ledger (E3, E4): every request is known by a hash of what it asks, and is generated once.

The ledger is a table of generations (request, reply, error) that is only appended to. A run generates what the ledger lacks: each
different request once, however many rows ask it, in parts that are published one by one. A run that is cut off is resumed by the next,
which calls again for the part that was not published and for nothing before it; so does Spark for a task that was lost with its
executor, as no call can be made exactly once across a failure. Failures are kept, and tried anew up to a bound of attempts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.functions.embed import extractive_reply
from lorewell.operators import generations
from lorewell.session import remove

LEDGER = "request string, reply string, error string"
#: Requests of a part: the run ahead of a commit, and what a lost run has to ask again.
PART = 1_000


def request_key(messages: Column, model: Column | str = "") -> Column:
    """What a request is known by: a hash of the model and of all its messages in order."""
    return F.sha2(F.to_json(F.struct(F.lit(model).alias("model") if isinstance(model, str) else model.alias("model"), messages.alias("messages"))), 256)


def replies(spark: SparkSession, path: str) -> DataFrame:
    """(request, reply, error, attempts): one row a request, its reply if there ever was one."""
    if generations.manifest(spark, path) is None:
        return spark.createDataFrame([], f"{LEDGER}, attempts long")
    rows = generations.read(spark, path)
    return rows.groupBy("request").agg(F.max("reply").alias("reply"), F.max("error").alias("error"), F.count(F.lit(1)).alias("attempts")).withColumn("error", F.when(F.col("reply").isNull(), F.col("error")))


def missing(asked: DataFrame, path: str, attempts: int) -> DataFrame:
    """(request, messages): the different requests that have no reply and were tried less than `attempts` times."""
    spark = asked.sparkSession
    done = replies(spark, path).where(F.col("reply").isNotNull() | (F.col("attempts") >= attempts)).select("request")
    return asked.groupBy("request").agg(F.any_value("messages").alias("messages")).join(done, "request", "left_anti")


def fill(requests: DataFrame, path: str, generator: Callable[[list[dict]], str], attempts: int = 3, part: int = PART) -> int:
    """Generates what the ledger lacks of requests (request, messages) and returns how many calls were made.

    Missing requests are told once and written in parts of about `part` by their hashes, so that a part reads its own requests and
    nothing of the ledger. A part is generated, written and published before the next begins, so a run that is cut off has lost one
    part at most. Once another run has published meanwhile, each part leaves out what the ledger has by then. A request that fails is
    published with its error; null messages fail.
    """
    spark = requests.sparkSession
    version, shared = (generations.versions(spark, path) or [0])[-1], False
    lacking = missing(requests, path, attempts)
    n = lacking.count()
    if not n:
        return 0
    staged = f"{path}/{generations.STAGED}/{uuid.uuid4().hex}"
    try:
        numbered = lacking.withColumn("part", F.pmod(F.crc32("request"), F.lit(-(-n // part))))
        numbered.repartition("part").write.partitionBy("part").parquet(staged)
        for name in generations.folders(spark, staged):
            mine = spark.read.schema(lacking.schema).parquet(f"{staged}/{name}").repartition("request")
            newest = generations.latest(spark, path, version)
            shared = shared or newest != version
            before = generations.manifest(spark, path, newest) if newest else None
            if shared:
                mine = missing(mine, path, attempts)
            generations.append(mine.mapInPandas(_generate(generator), LEDGER), path, before)
            version = newest + 1
    finally:
        remove(spark, staged)
    return n


def _generate(generator: Callable[[list[dict]], str]):
    def one(messages) -> tuple[str | None, str | None]:
        try:
            return generator([m if isinstance(m, dict) else m.asDict() for m in messages]), None
        except Exception as e:  # noqa: BLE001  a request that fails must not fail the others
            return None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            said = [one(m) for m in batch["messages"]]
            yield pd.DataFrame({"request": batch["request"], "reply": [s for s, _ in said], "error": [e for _, e in said]})

    return run


def generate_once(df: DataFrame, path: str, generator: Callable[[list[dict]], str] = extractive_reply, messages: str = "messages", into: str = "reply", model: str = "", attempts: int = 3, part: int = PART) -> DataFrame:
    """E3 through a ledger: df with a reply for each row's messages and, where there is none, its error in <into>_error.

    Rows that ask the same get the same reply of one call; a second run over the same rows makes no call. Runs when it is called.
    """
    keyed = df.withColumn("_request", request_key(F.col(messages), model))
    fill(keyed.select(F.col("_request").alias("request"), F.col(messages).alias("messages")), path, generator, attempts, part)
    known = replies(df.sparkSession, path).select(F.col("request").alias("_request"), F.col("reply").alias(into), F.col("error").alias(f"{into}_error"))
    return keyed.join(known, "_request", "left").drop("_request")


def summary(spark: SparkSession, path: str) -> dict:
    """Requests, replies and published calls so far."""
    counts = [F.count(F.lit(1)).alias("requests"), F.count("reply").alias("replies"), F.coalesce(F.sum("attempts"), F.lit(0)).alias("calls")]
    return replies(spark, path).agg(*counts).first().asDict()
