"""Bounded conversation memory in batch form (W1, W1', M1-M4, X6, X7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorewell.operators.context import ordered_text


def normal_role(role: Column) -> Column:
    """Everything that is not the user is the assistant, null included."""
    return F.when(role == "user", "user").otherwise("assistant")


def last_n(turns: DataFrame, n: int = 10, session: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Each session's n last messages.

    Turns are unique within a session; a repeated turn is kept as another message, in no fixed order.
    """
    newest = W.partitionBy(session).orderBy(F.col(turn).desc())
    return turns.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= n).drop("_r")


def as_of(turns: DataFrame, n: int = 10, session: str = "conv_id", turn: str = "turn") -> DataFrame:
    """W1': for each turn, the at most n messages before it as history, oldest first."""
    before = W.partitionBy(session).orderBy(turn).rowsBetween(-n, -1)
    return turns.withColumn("history", F.collect_list(F.struct(normal_role(F.col("role")).alias("role"), F.col("text").alias("content"))).over(before))


def after_clear(turns: DataFrame, is_clear: Column, session: str = "conv_id", turn: str = "turn") -> DataFrame:
    """M2: what a session remembers after its last clear marker; the marker itself is not a message."""
    cleared = F.max(F.when(is_clear, F.col(turn))).over(W.partitionBy(session))
    return turns.withColumn("_c", cleared).where(F.col("_c").isNull() | (F.col(turn) > F.col("_c"))).drop("_c")


def history_string(turns: DataFrame, n: int = 10, session: str = "conv_id", turn: str = "turn") -> DataFrame:
    """One line for each remembered message."""
    said = F.concat(F.when(F.col("role") == "user", "用户").otherwise("我"), F.lit(": "), F.coalesce("text", F.lit("")))
    return ordered_text(last_n(turns, n, session, turn).withColumn("_line", said), [session], turn, "_line", "\n", "history")


def transcript(turns: DataFrame, failed: Column, session: str = "conv_id", turn: str = "turn") -> tuple[DataFrame, DataFrame]:
    """M4: (transcript, memory). A turn whose reply failed stays in the transcript but not in memory."""
    return turns, turns.where(~F.coalesce(failed, F.lit(False)))
