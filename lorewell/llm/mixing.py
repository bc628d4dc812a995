"""Mixing sources to target weights by a low-discrepancy schedule (operator 5).

Slots of equal words are dealt to the sources by golden-ratio points; a source's r-th slot takes the r-th block of its shuffled
stream. So the schedule says which words stand where, and how many blocks a source has, to within the discrepancy of the
points; closing slots settle what is left of each target. Null and empty texts have no words and are never taken, a null source is
a source of its own, repeated rows are documents of their own, and empty tables give no row.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorewell.llm.common import keep, running_total

WEIGHTS = (3, 1, 2)
SHARE = Fraction(3, 2)
EPOCHS = 2
BLOCK_WORDS = 1024
#: The source table is planned on the driver; more sources than this are refused.
MAX_SOURCES = 1_000_000
#: Documents and slots that one running total sorts together.
BUCKET_ROWS, BUCKET_SLOTS = 5_000, 65_536
#: The points are multiples of STEP modulo CIRCLE: the golden ratio in whole numbers, so that they are exact however many there are.
CIRCLE = 1 << 31
STEP = round(CIRCLE * (math.sqrt(5) - 1) / 2)


def size_of(text: Column) -> Column:
    """Words of a text: runs of anything but ASCII white space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[int], share: Fraction = SHARE, epochs: int = EPOCHS) -> list[Fraction]:
    """Water filling: by weight, none above epochs times its size, the excess shared again until none is above."""
    total = share * sum(sizes)
    out = [Fraction(0)] * len(sizes)
    open_ = [i for i, n in enumerate(sizes) if n]
    while open_ and total > 0:
        weight = sum(weights[i] for i in open_)
        full = [i for i in open_ if total * weights[i] > weight * epochs * sizes[i]]
        if not full:
            for i in open_:
                out[i] = total * weights[i] / weight
            break
        for i in full:
            out[i] = Fraction(epochs * sizes[i])
            total -= out[i]
        done = set(full)
        open_ = [i for i in open_ if i not in done]
    return out


def plan(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> pd.DataFrame:
    """One row per source: source, s (its place by code point, null last), docs, source_size, target, quota, buckets."""
    rows = sized.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("source_size")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["source_size"] for r in rows]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(rows))])
    return pd.DataFrame(
        {
            "source": [r["source"] for r in rows],
            "s": range(len(rows)),
            "source_size": sizes,
            "target": [float(g) for g in goal],
            "quota": [math.floor(g) for g in goal],
            "buckets": [max(1, -(-r["docs"] // BUCKET_ROWS)) for r in rows],
        }
    )


def bounds(quotas: list[int]) -> np.ndarray:
    """Where each source's part of the circle ends; a source without a quota has none of it."""
    total, at, out = sum(quotas), 0, []
    for q in quotas:
        at += q
        out.append(at * CIRCLE // total)
    return np.array(out, dtype=np.int64)


def schedule(spark, quotas: list[int], block: int = BLOCK_WORDS) -> DataFrame:
    """(slot, s, r): one slot for every block of all quotas; slot i takes the source whose part of the circle holds the point
    (i + 1) * STEP, and r ranks a source's slots from 0.

    A source that its points give fewer slots than its quota needs, as one smaller than a block may be, gets the rest as closing
    slots after the last, by source; slots beyond a quota's need stay empty and are left out. Points are drawn once, so the
    work is that of the slots, whatever the sizes are. No quota, no slot.
    """
    total = sum(quotas)
    if not total:
        return spark.createDataFrame([], "slot long, s int, r long")
    ends = bounds(quotas)

    @F.pandas_udf("int")
    def source_at(points: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(ends, points.to_numpy(), side="right").astype(np.int32))

    n = -(-total // block)
    point = (F.col("id") + 1) % CIRCLE * STEP % CIRCLE
    drawn = spark.range(n).select(F.col("id").alias("slot"), source_at(point).alias("s"), F.floor(F.col("id") / BUCKET_SLOTS).alias("b"))
    got = {r["s"]: r["n"] for r in drawn.groupBy("s").agg(F.count(F.lit(1)).alias("n")).collect()}
    need = [-(-q // block) for q in quotas]
    ranked = running_total(drawn, ["s"], "b", ["slot"], F.lit(1), "r")
    most = spark.createDataFrame(list(enumerate(need)), "s int, need long")
    inner = ranked.join(F.broadcast(most), "s").where("r < need").select("slot", "s", "r")
    closing, at = [], n
    for s, k in enumerate(need):
        if (lacks := k - got.get(s, 0)) > 0:
            closing.append((s, k - lacks, k - 1, at))
            at += lacks
    if not closing:
        return inner
    runs = spark.createDataFrame(closing, "s int, lo long, hi long, at long").select("s", "lo", "at", F.explode(F.sequence("lo", "hi")).alias("r"))
    return inner.unionByName(runs.select((F.col("at") + F.col("r") - F.col("lo")).alias("slot"), "s", "r"))


def place(sized: DataFrame, sources: pd.DataFrame) -> DataFrame:
    """Each document's place in its source's shuffled stream: columns s, source_size, target, quota, start."""
    spark = sized.sparkSession
    table = spark.createDataFrame(sources.astype(object).where(sources.notna(), None).values.tolist() or [], "source string, s int, source_size long, target double, quota long, buckets long")
    both = sized.join(F.broadcast(table.withColumnRenamed("source", "_source")), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    both = both.withColumn("b", F.conv(F.left("h", F.lit(8)), 16, 10).cast("long") % F.col("buckets"))
    return running_total(both, ["s"], "b", ["h", "doc_id", "size"], F.col("size"), "start").drop("b", "buckets")


def pieces(placed: DataFrame, slots: DataFrame, block: int = BLOCK_WORDS, epochs: int = EPOCHS) -> DataFrame:
    """The mix: for every document and slot that share words, slot, epoch and the words [begin, finish) of the document.

    Documents that the mix leaves out have one row without slot. A source's stream, repeated epochs times and cut
    at its quota, is dealt to its slots in blocks of equal words.
    """
    runs = F.array(*[F.struct(F.lit(e).alias("epoch"), (F.col("start") + F.col("source_size") * e).alias("p"), F.least("quota", F.col("start") + F.col("source_size") * e + F.col("size")).alias("q")) for e in range(epochs)])
    full = F.filter(runs, lambda x: x["q"] > x["p"])
    by_block = F.flatten(F.transform(full, lambda x: F.transform(F.sequence(F.floor(x["p"] / block), F.floor((x["q"] - 1) / block)), lambda r: F.struct(x["epoch"].alias("epoch"), r.alias("r"), (F.greatest(x["p"], r * block) - x["p"]).alias("begin"), (F.least(x["q"], (r + 1) * block) - x["p"]).alias("finish")))))
    cut = placed.withColumn("x", F.explode_outer(by_block)).select("*", F.col("x.epoch").alias("epoch"), F.col("x.r").alias("r"), F.col("x.begin").alias("begin"), F.col("x.finish").alias("finish")).drop("x")
    # rows without a block spread by their place, not on one null key
    key = F.coalesce("r", -F.col("start") - 1)
    return cut.withColumn("r", key).join(slots, ["s", "r"], "left")


def shuffle_hash(seed: int = 5) -> Column:
    parts = [F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")).cast("binary"))]
    return F.md5(F.concat_ws("|", *parts).cast("binary"))


def sized_documents(docs: DataFrame, seed: int = 5) -> DataFrame:
    """(doc_id, source, size, h); h shuffles, is the same in every run and can be had in any SQL."""
    return docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), shuffle_hash(seed).alias("h"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK_WORDS) -> DataFrame:
    """The mixed pieces of (doc_id, text, source): see pieces(). Empty tables give no row; repeated rows are documents of their own."""
    sized = keep(sized_documents(docs))
    sources = plan(sized, weights)
    slots = schedule(docs.sparkSession, sources["quota"].tolist(), block)
    return pieces(place(sized, sources), slots, block)


def taken(mixed: DataFrame) -> DataFrame:
    """Words that the mix takes of each document, repeats counted, the first of its slots and in how many pieces it is dealt."""
    return taken_at(mixed).drop("start", "h", "at")


def taken_at(mixed: DataFrame) -> DataFrame:
    """taken() with each document's place, start and h, and at: the first slot of every epoch, null where it has none."""
    dealt = F.col("slot").isNotNull()
    words = F.coalesce(F.sum(F.when(dealt, F.col("finish") - F.col("begin"))), F.lit(0)).alias("taken")
    slots = [F.min("slot").alias("first_slot"), F.count(F.when(dealt, 1)).alias("n_slots"), F.array(*[F.min(F.when(F.col("epoch") == e, F.col("slot"))) for e in range(EPOCHS)]).alias("at")]
    n = F.sum(F.when(F.col("epoch").isNull() | ((F.col("epoch") == 0) & (F.col("begin") == 0)), 1).otherwise(0))
    grouped = mixed.groupBy("doc_id", "source", "size", "source_size", "target", "start", "h").agg(words, *slots, n.alias("_n"))
    # rows that agree in everything and have no words share a place
    return grouped.withColumn("_i", F.explode(F.sequence(F.lit(1), F.greatest("_n", F.lit(1))))).drop("_i", "_n")


#: Targets, the slots with their ranks, and the stream's blocks joined to them.
OP5_SQL = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5('5|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS h
  FROM documents),
sums AS (SELECT source, count(*) AS docs, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM sums),
ordered AS (
  SELECT *, sum(2 * source_size) OVER o AS full_sum, sum(w) OVER o AS full_w, row_number() OVER o AS k,
         3 * sum(source_size) OVER () AS double_total, sum(w) OVER () AS all_w
  FROM weighed WHERE source_size > 0 WINDOW o AS (ORDER BY 2.0 * source_size / w, source IS NULL, source ROWS UNBOUNDED PRECEDING)),
-- with the k - 1 sources of least size by weight full, the others share num / den by weight
levels AS (
  SELECT *, double_total - 2 * (full_sum - 2 * source_size) AS num, 2 * (all_w - (full_w - w)) AS den FROM ordered),
first_open AS (SELECT min(k) AS k FROM levels WHERE num * w <= 2 * source_size * den),
level AS (SELECT num::HUGEINT AS num, den::HUGEINT AS den, k FROM levels WHERE k = (SELECT k FROM first_open)),
aims AS (
  SELECT l.source, l.source_size, l.docs,
         CASE WHEN l.k < v.k THEN (2 * l.source_size)::DOUBLE ELSE (v.num * l.w)::DOUBLE / v.den::DOUBLE END AS target,
         CASE WHEN l.k < v.k THEN (2 * l.source_size)::HUGEINT ELSE (v.num * l.w) // v.den END AS quota
  FROM levels l, level v
  UNION ALL SELECT source, source_size, docs, 0.0, 0 FROM weighed WHERE source_size = 0),
placed AS (
  SELECT s.*, a.source_size, a.target, a.quota,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY ('0x' || left(s.h, 8))::BIGINT % greatest(1, (a.docs + 4999) // 5000), s.h, s.doc_id, s.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source),
circle AS (
  SELECT source, quota, (quota + 1023) // 1024 AS need, row_number() OVER o AS s, (sum(quota) OVER ())::HUGEINT AS total,
         (sum(quota) OVER (o ROWS UNBOUNDED PRECEDING))::HUGEINT * 2147483648 AS top
  FROM aims WINDOW o AS (ORDER BY source IS NULL, encode(source))),
parts AS (SELECT *, coalesce(lag(top) OVER (ORDER BY s), 0) // total AS lo, top // total AS hi FROM circle WHERE total > 0),
points AS (
  SELECT i AS slot, (i + 1) % 2147483648 * 1327217885 % 2147483648 AS p
  FROM (SELECT unnest(range(0, ((total + 1023) // 1024)::BIGINT)) AS i FROM (SELECT any_value(total) AS total FROM parts))),
drawn AS (SELECT slot, s, need, row_number() OVER (PARTITION BY s ORDER BY slot) - 1 AS r FROM points JOIN parts ON p >= lo AND p < hi),
lacking AS (
  SELECT s, unnest(range(got, need::BIGINT)) AS r FROM (SELECT s, need, (SELECT count(*) FROM drawn d WHERE d.s = parts.s) AS got FROM parts)),
slots AS (
  SELECT slot, s, r FROM drawn WHERE r < need
  UNION ALL SELECT (SELECT count(*) FROM points) + row_number() OVER (ORDER BY s, r) - 1, s, r FROM lacking),
runs AS (
  SELECT placed.*, p, least(quota, p + size)::BIGINT AS q FROM (SELECT *, start + e * source_size AS p FROM placed, (VALUES (0), (1)) x(e)) placed),
blocks AS (SELECT doc_id, h, source, start, p, q, unnest(range(p::BIGINT // 1024, (q - 1) // 1024 + 1)) AS r FROM runs WHERE q > p),
dealt AS (
  SELECT b.doc_id, b.h, b.source, b.start, slot, least(q, (b.r + 1) * 1024) - greatest(p, b.r * 1024) AS n
  FROM blocks b JOIN parts c ON b.source IS NOT DISTINCT FROM c.source JOIN slots USING (s, r)),
words AS (SELECT doc_id, h, source, start, sum(n)::BIGINT AS taken, min(slot) AS first_slot, count(*) AS n_slots FROM dealt GROUP BY ALL)
SELECT p.doc_id, p.size, p.source_size, round(p.target, 6) AS target, p.source, coalesce(taken, 0)::BIGINT AS taken, first_slot::BIGINT AS first_slot,
       coalesce(n_slots, 0)::BIGINT AS n_slots
FROM placed p LEFT JOIN words d ON p.h = d.h AND p.start = d.start AND p.source IS NOT DISTINCT FROM d.source
"""


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    """The mix of all documents: words taken of each, and its slots in the schedule."""
    from lorewell.session import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return taken(mix(docs)).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", "source", "first_slot", "n_slots")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents as often as the mix takes them, whole copies in the order of their slots: partitions follow one another, and
    so do the rows of each.

    A row is kept round(taken / size) times (0 to EPOCHS) by its own taken words; those without words go, for the mix takes none
    of them. Rows alike in id, text and source are told apart by number. All columns stay as they are, whatever their names.
    """
    spark = docs.sparkSession
    slot = F.transform(F.sequence(F.lit(1), F.lit(EPOCHS)), lambda e: F.coalesce(F.get("at", e - 1), "first_slot"))
    times = taken_at(mix(docs)).where("size > 0").select("h", F.col("source").alias("src"), "start", F.round(F.col("taken") / F.col("size")).cast("int").alias("times"), slot.alias("at"))
    times = keep(times)
    rows = docs.select(F.struct("*").alias("doc"), shuffle_hash().alias("own"), F.col("source").alias("own_src"))
    same = (F.col("own") == F.col("h")) & F.col("own_src").eqNullSafe(F.col("src"))
    if not times.groupBy("h", "src").count().where("count > 1").isEmpty():
        # numbers by partition and by place, so that rows with countless likes are not ranked by one task
        key = lambda h, src: F.concat_ws("|", h, F.coalesce(F.hex(src), F.lit("-")))
        mine = keep(rows.withColumn("id", F.monotonically_increasing_id()).withColumns({"k": key("own", "own_src"), "b": F.shiftright("id", 33)}))
        rows = running_total(mine, ["k"], "b", ["id"], F.lit(1), "nth").select("doc", "own", "own_src", F.col("nth").alias("m"))
        theirs = times.withColumns({"k": key("h", "src"), "b": F.floor(F.col("start") / 1_000_000)})
        times = running_total(theirs, ["k"], "b", ["start"], F.lit(1), "nth").drop("k", "b")
        same = same & (F.col("m") == F.col("nth"))
    joined = rows.join(times.where("times >= 1"), same).select("doc", "own", F.explode(F.slice("at", F.lit(1), F.col("times"))).alias("slot"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    last = times.agg(F.max(F.array_max("at"))).first()[0] or 0
    ordered = joined.repartitionById(parts, F.floor(F.col("slot") * parts / F.lit(last + 1)).cast("int")).sortWithinPartitions("slot", "own")
    return ordered.select("doc.*")
