"""Mergeable sketches by group: distinct counts and quantiles that are stored and merged, so that new data never rereads the old.

Distinct counts are Spark's HyperLogLog sketches. Quantiles are kept as counts of logarithmic bins, of a width that bounds the
relative error: a plain aggregate, exact to merge by adding, and of a size that is bounded by the range of the values alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Registers of a distinct-count sketch as a power of two (relative standard error 1.04 / sqrt(2^14) = 0.8 %), relative error of quantiles.
LG_K, ERROR = 14, 0.01


def bin_of(value: Column, error: float = ERROR) -> Column:
    """The bin of a value as (sign, exponent): all values of a bin are within `error` of its middle, in proportion. Zero has its own."""
    width = math.log((1 + error) / (1 - error))
    size = F.floor(F.log(F.abs(value)) / F.lit(width)).cast("int")
    return F.struct(F.signum(value).cast("int").alias("sign"), F.when(value != 0, size).otherwise(F.lit(0)).alias("power"))


def middle(sign: Column, power: Column, error: float = ERROR) -> Column:
    """The value that stands for a bin: 1 + error times its lower edge, which is as far, in proportion, from either edge."""
    width = math.log((1 + error) / (1 - error))
    return sign * F.exp(power * F.lit(width)) * F.lit(1 + error)


def distinct_sketches(rows: DataFrame, by: list[str | Column], value: str | Column, lg_k: int = LG_K) -> DataFrame:
    """A sketch a group: (by..., sketch, n). Nulls are not counted; a group of nulls alone has an empty sketch."""
    return rows.groupBy(*by).agg(F.hll_sketch_agg(value, lg_k).alias("sketch"), F.count(value).alias("n"))


def merged_distinct(sketches: DataFrame, by: list[str | Column]) -> DataFrame:
    """Sketches of finer groups as sketches of coarser ones."""
    return sketches.groupBy(*by).agg(F.hll_union_agg("sketch").alias("sketch"), F.sum("n").alias("n"))


def distinct_counts(sketches: DataFrame) -> DataFrame:
    return sketches.withColumn("n_distinct", F.hll_sketch_estimate("sketch")).drop("sketch")


def quantile_bins(rows: DataFrame, by: list[str | Column], value: str, error: float = ERROR) -> DataFrame:
    """(by..., sign, power, n): how many values of a group fall into each bin. Nulls and NaN are not counted."""
    finite = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    return finite.groupBy(*by, bin_of(F.col(value).cast("double"), error).alias("bin")).agg(F.count(F.lit(1)).alias("n")).select(*[c for c in finite.select(*by).columns], "bin.sign", "bin.power", "n")


def merged_bins(bins: DataFrame, by: list[str | Column]) -> DataFrame:
    return bins.groupBy(*by, "sign", "power").agg(F.sum("n").alias("n"))


def quantiles(bins: DataFrame, by: list[str], at: list[float], error: float = ERROR) -> DataFrame:
    """(by..., q, value): for each q the value whose rank is ceil(q n) of the group's n, at least the first, to the relative error.

    A group's bins are at most some thousands, however many values it has; only they are ordered.
    """
    signed = F.col("sign") * F.col("power")
    order = W.partitionBy(*by).orderBy("sign", signed)
    upto = bins.withColumns({"_upto": F.sum("n").over(order.rowsBetween(W.unboundedPreceding, 0)), "_all": F.sum("n").over(W.partitionBy(*by))})
    wanted = upto.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in at])))
    rank = F.greatest(F.ceil(F.col("q") * F.col("_all")), F.lit(1))
    hit = wanted.where((F.col("_upto") >= rank) & (F.col("_upto") - F.col("n") < rank))
    return hit.select(*by, "q", middle(F.col("sign"), F.col("power"), error).alias("value"))


def upsert_days(sketches: DataFrame, path: str, day: str) -> list[str]:
    """Stores sketches by day; only the days that come are written anew, others are neither read nor touched. Returns those days."""
    days = sorted(str(r[0]) for r in sketches.select(day).distinct().collect())
    sketches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)
    return days
