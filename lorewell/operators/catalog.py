"""Entity catalog."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Groups in display order.
DYNASTIES = ["上古", "商朝", "西周", "春秋", "战国", "秦朝", "西汉", "东汉末", "三国蜀汉", "三国东吴", "三国曹魏", "东晋", "隋朝", "唐朝", "北宋", "南宋", "元朝", "明朝", "清朝"]

LAST = 2147483647


def dynasty_order(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(d, i) for i, d in enumerate(DYNASTIES)], "dynasty string, ord int")


def last_wins(chars: DataFrame, order: str, key: str = "name") -> DataFrame:
    """The last row of each key in the given order."""
    cols = [c for c in chars.columns if c not in (key, order)]
    return chars.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("_v")).select(key, "_v.*")


def grouped(chars: DataFrame, order: DataFrame) -> DataFrame:
    """A3 + J3 + T6: members of each group, known groups first in their order, then the others by name."""
    members = chars.groupBy("dynasty").agg(F.array_sort(F.collect_list("name")).alias("names"), F.count(F.lit(1)).alias("n"))
    return members.join(F.broadcast(order), "dynasty", "left").withColumn("ord", F.coalesce("ord", F.lit(LAST))).orderBy("ord", "dynasty")


def lookup(rows: DataFrame, chars: DataFrame, how: str = "left") -> DataFrame:
    """J1 (left), J2 (inner, or left_semi for existence); Spark broadcasts a small catalog by its size."""
    return rows.join(chars, "name", how)


def not_cached(pages: DataFrame, cache: DataFrame) -> DataFrame:
    """Pages whose url was not fetched yet; unlike a failure, a cache hit is just not fetched again."""
    return pages.join(cache.select("url").distinct(), "url", "left_anti")


def without_knowledge(entities: DataFrame, covered: DataFrame, key: str) -> DataFrame:
    """U2."""
    return entities.join(covered.select(key).distinct(), key, "left_anti")


def union_all(frames: list[DataFrame]) -> DataFrame:
    """U1."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def success_ratio(ok: Column) -> list[Column]:
    """A6."""
    return [F.count_if(ok).alias("success"), F.count(F.lit(1)).alias("total")]


def kpis(chars: DataFrame, chunks: DataFrame) -> DataFrame:
    """Characters, groups, knowledge chunks."""
    left = chars.agg(F.count(F.lit(1)).alias("characters"), F.countDistinct("dynasty").alias("dynasties"))
    return left.join(chunks.agg(F.count(F.lit(1)).alias("chunks")))


def profile(chars: DataFrame, name: str) -> DataFrame:
    """One row per quote of one character."""
    return chars.where(F.col("name") == name).select("name", "dynasty", "title", "years", F.posexplode_outer("famous_quotes").alias("pos", "quote"))


# Recommended names with the group their card shows.
RECOMMENDED = [("孔子", "春秋"), ("秦始皇", "秦朝"), ("李白", "唐朝"), ("诸葛亮", "三国"), ("苏轼", "北宋"), ("康熙", "清朝")]


def recommended(spark: SparkSession, chars: DataFrame, shown: DataFrame | None = None) -> DataFrame:
    """Recommended entities (pos, name, shown) that the catalog has; the shown group may differ from the catalog's."""
    if shown is None:
        shown = spark.createDataFrame([(i, n, d) for i, (n, d) in enumerate(RECOMMENDED)], "pos int, name string, shown string")
    return shown.join(chars.select("name", "dynasty"), "name")
