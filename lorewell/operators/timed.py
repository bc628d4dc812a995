"""Joins and frames over time: as-of, interval and range-frame forms whose hot keys are cut by time.

A key may hold any share of all rows. Every operator here deals its rows by key *and* slice of time, so a hot key is many tasks; what a
slice needs from its neighbours is carried as a few rows (the last value before it, or the rows within reach of its edge). None of the
plans has a nested-loop join or a window over a whole key.

Rows without a key or a time have no place in time: they join nothing and are in no frame, and are returned where a left row must be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Seconds of a slice of time.
SLICE_SECONDS = 86_400


def micros(c: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp."""
    return F.unix_micros(F.col(c).cast("timestamp") if isinstance(c, str) else c.cast("timestamp"))


def _slice(us: Column, seconds: int) -> Column:
    """The number of the slice that an instant is in, in whole numbers (floor, also before 1970)."""
    size = F.lit(seconds * 1_000_000)
    return ((us - F.pmod(us, size)) / size).cast("long")


def as_of(left: DataFrame, right: DataFrame, on: str, left_time: str, right_time: str, values: list[str], id: str, strict: bool = False, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Each left row with the values of the right row of its key that is the last one at or before its time (strict: before it).

    id: a right column that orders right rows of one time, the greatest counts. values come under their own names, null where
    there is no such row.

    Both streams are one union that is ordered within (key, slice of time). The last value within the slice so far is a running
    `last`; where a slice has none before a row, the last value of the key's earlier slices serves, which is taken from one row a
    slice. Left rows move once.
    """
    taken = set(left.columns) & set(values)
    if taken:
        raise ValueError(f"left has columns of these names already: {sorted(taken)}")
    carried = F.struct(*[F.col(v) for v in values])
    timeless = F.col(on).isNull() | F.col(left_time).isNull()
    lost, left = left.where(timeless), left.where(~timeless)
    both_null = F.lit(None)
    rows = left.select(F.col(on).alias("_k"), micros(left_time).alias("_t"), F.struct(*left.columns).alias("_row"), both_null.cast(right.select(carried.alias("c")).schema["c"].dataType).alias("_v"), both_null.cast(right.schema[id].dataType).alias("_id"))
    other = right.where(F.col(on).isNotNull() & F.col(right_time).isNotNull())
    other = other.select(F.col(on).alias("_k"), micros(right_time).alias("_t"), both_null.cast(rows.schema["_row"].dataType).alias("_row"), carried.alias("_v"), F.col(id).alias("_id"))
    both = rows.unionByName(other).withColumn("_s", _slice(F.col("_t"), slice_seconds))
    # of one time, right rows come before left ones, or behind them if only earlier ones count
    side = F.when(F.col("_row").isNull(), F.lit(1 if strict else 0)).otherwise(F.lit(0 if strict else 1))
    here = W.partitionBy("_k", "_s").orderBy("_t", side, F.col("_id").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    within = both.withColumn("_in", F.last(F.when(F.col("_row").isNull(), F.struct(F.col("_v").alias("v"))), ignorenulls=True).over(here)).where("_row IS NOT NULL")
    # the last right row of every slice, and of all slices before it
    ends = other.withColumn("_s", _slice(F.col("_t"), slice_seconds)).groupBy("_k", "_s").agg(F.max_by(F.struct(F.col("_v").alias("v")), F.struct("_t", "_id")).alias("_last"))
    slices = rows.select("_k", _slice(F.col("_t"), slice_seconds).alias("_s")).distinct()
    order = W.partitionBy("_k").orderBy("_s").rowsBetween(W.unboundedPreceding, -1)
    before = slices.join(ends, ["_k", "_s"], "full").withColumn("_before", F.last("_last", ignorenulls=True).over(order)).where("_before IS NOT NULL").select("_k", "_s", "_before")
    found = within.join(before, ["_k", "_s"], "left").withColumn("_got", F.coalesce("_in", "_before"))
    found = found.select("_row.*", *[F.col("_got.v")[v].alias(v) for v in values])
    return found.unionByName(lost.withColumns({v: F.lit(None).cast(right.schema[v].dataType) for v in values}))


def within(left: DataFrame, right: DataFrame, on: str, left_time: str, right_time: str, seconds: int, prefix: str = "right_", bins: int = 1) -> DataFrame:
    """All pairs of a left and a right row of one key whose times are at most `seconds` apart.

    Time is cut into bins of `seconds` (times `bins`, for fewer and larger ones). A left row keeps its bin; a right row is sent to its own
    bin and to those that its reach enters, and the join is an equi-join on key and bin, followed by the exact test. A pair meets in
    the left row's bin alone, so none comes twice. A hot key is spread over its bins.
    """
    size = F.lit(seconds * bins * 1_000_000)
    bin_of = lambda us: ((us - F.pmod(us, size)) / size).cast("long")
    reach = F.lit(seconds * 1_000_000)
    a = left.where(F.col(on).isNotNull() & F.col(left_time).isNotNull()).withColumns({"_t": micros(left_time), "_k": F.col(on)}).withColumn("_bin", bin_of(F.col("_t")))
    b = right.where(F.col(on).isNotNull() & F.col(right_time).isNotNull()).select(F.col(on).alias("_k"), micros(right_time).alias("_u"), *[F.col(c).alias(prefix + c) for c in right.columns])
    b = b.withColumn("_bin", F.explode(F.sequence(bin_of(F.col("_u") - reach), bin_of(F.col("_u") + reach))))
    return a.join(b, ["_k", "_bin"]).where(F.abs(F.col("_t") - F.col("_u")) <= reach).drop("_k", "_bin", "_t", "_u")


def contained(points: DataFrame, ranges: DataFrame, on: str, time: str, start: str, end: str, bin_seconds: int, prefix: str = "range_") -> DataFrame:
    """Every point with the ranges [start, end) of its key that hold its time.

    A range is sent to every bin that it reaches into, a point to its own; the join is on key and bin. A range of many bins is many
    small rows without data of others, so bin_seconds is best near the usual length of a range. Empty or inverted ranges hold nothing.
    """
    p = points.where(F.col(on).isNotNull() & F.col(time).isNotNull()).withColumns({"_t": micros(time), "_k": F.col(on)}).withColumn("_bin", _slice(F.col("_t"), bin_seconds))
    r = ranges.where(F.col(on).isNotNull()).select(F.col(on).alias("_k"), micros(start).alias("_a"), micros(end).alias("_b"), *[F.col(c).alias(prefix + c) for c in ranges.columns]).where("_a < _b")
    r = r.withColumn("_bin", F.explode(F.sequence(_slice(F.col("_a"), bin_seconds), _slice(F.col("_b") - 1, bin_seconds))))
    return p.join(r, ["_k", "_bin"]).where("_a <= _t AND _t < _b").drop("_k", "_bin", "_t", "_a", "_b")


def trailing(rows: DataFrame, on: str, time: str, seconds: int, aggregates: dict[str, Column], slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Every row with aggregates over the rows of its key from `seconds` before it up to its own time, rows of that time included.

    aggregates: expressions such as F.sum("value"). A row is in its own slice of time, and once more, as a helper, in each later slice
    that it is within reach of; the frame is a range over (key, slice), so a hot key is as many tasks as it has slices. Helpers are
    dropped after. Rows without a key or time are returned with null.
    """
    size = F.lit(slice_seconds * 1_000_000)
    reach = F.lit(seconds * 1_000_000)
    placed = rows.withColumns({"_k": F.col(on), "_t": micros(time)})
    known = F.col("_k").isNotNull() & F.col("_t").isNotNull()
    own = _slice(F.col("_t"), slice_seconds)
    cut = placed.where(known).withColumn("_own", own)
    cut = cut.withColumn("_s", F.explode(F.sequence(F.col("_own"), ((F.col("_t") + reach - F.pmod(F.col("_t") + reach, size)) / size).cast("long"))))
    frame = W.partitionBy("_k", "_s").orderBy("_t").rangeBetween(-seconds * 1_000_000, 0)
    done = cut.withColumns({name: e.over(frame) for name, e in aggregates.items()}).where("_s = _own").drop("_k", "_t", "_own", "_s")
    lost = placed.where(~known).drop("_k", "_t").withColumns({name: F.lit(None).cast(done.schema[name].dataType) for name in aggregates})
    return done.unionByName(lost)
