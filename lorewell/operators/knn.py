"""Vector search (T1-T5, F1-F3, J5, W2): exact, filtered, scored, with fallback, batched."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorewell.session import settled

#: Bytes of queries that are sent to all executors, or form a block; rows of the index in a block.
QUERY_BYTES, BLOCK_ROWS = 32 << 20, 8_192


def squared_l2(a: Column, b: Column) -> Column:
    """In double precision; null where a vector is null or the lengths differ."""
    parts = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(parts, F.lit(0.0), lambda s, v: s + v)


def where_equal(df: DataFrame, filters: dict | None) -> DataFrame:
    """equality filters ahead of the search, where Catalyst pushes them into the scan."""
    for name, value in (filters or {}).items():
        df = df.where(F.col(name) == F.lit(value))
    return df


def scored(index: DataFrame, query: DataFrame, filters: dict | None, vector: str) -> DataFrame:
    """The filtered rows that have a distance to the query."""
    both = where_equal(index, filters).join(F.broadcast(query.select(F.col(vector).alias("q")).limit(1)))
    return both.withColumn("score", squared_l2(F.col(vector), F.col("q"))).drop("q").where("score is not null")


def topk(index: DataFrame, query: DataFrame, k: int = 4, filters: dict | None = None, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """The k rows nearest to one query vector (one row with column q), with score and rank.

    The score is the squared L2 distance (lower is better); ties go to the smaller key.
    """
    best = scored(index, query, filters, vector).orderBy("score", key).limit(k)
    return best.withColumn("rank", F.row_number().over(W.orderBy("score", key)))


def topk_with_fallback(index: DataFrame, query: DataFrame, k: int, filters: dict, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """T5: filtered search; only if that has no row at all, unfiltered search.

    Whether the filter leaves a row is asked first, which ends at the first one, so that only one of the two searches is planned.
    """
    found = not scored(index, query, filters, vector).isEmpty()
    return topk(index, query, k, filters if found else None, vector, key).withColumn("fallback", F.lit(not found))


def retriever(index: DataFrame, k: int = 4) -> Callable[[DataFrame], DataFrame]:
    """T4."""
    return lambda query: topk(index, query, k)


def _sound(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.exists(c, lambda x: x.isNull())


def batch_topk(index: DataFrame, queries: DataFrame, k: int, vector: str = "embedding", key: str = "vec_id", by: list[str] | None = None, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """J5 + W2: k neighbours of every query; queries have query_id and q.

    by: columns that must agree (a filter per query); nulls never do. Vectors that are null, hold nulls or have another length than
    the query have no distance to it. The size of the queries is asked first, by a job. Up to query_bytes of them are sent to all
    executors, the index stays where it is, and a task gives k rows a query. More are never brought together: blocks of queries meet
    blocks of the index in a shuffle, see in_blocks().
    """
    by = by or []
    same = F.to_json(F.struct(*by)) if by else F.lit("")
    known = reduce(lambda x, c: x & F.col(c).isNotNull(), by, F.lit(True))
    asked = queries.where(_sound("q") & known).select("query_id", F.col("q").cast("array<double>").alias("q"), F.concat_ws(" ", F.size("q"), same).alias("same"))
    rows = index.where(_sound(vector) & known).select(key, F.col(vector).cast("array<double>").alias("v"), F.concat_ws(" ", F.size(vector), same).alias("same"))
    size = asked.agg(F.sum(8 * F.size("q") + 8 * k + F.length("same") + 64)).first()[0] or 0
    if size <= query_bytes:
        shared = index.sparkSession.sparkContext.broadcast(asked.toArrow())
        out = rows.mapInArrow(_nearest(shared, k, key), _hits(rows, asked, key))
    else:
        out = in_blocks(rows, asked, "same", k, key, query_bytes=query_bytes)
    return ranked(out, k, key)


def _hits(rows: DataFrame, asked: DataFrame, key: str) -> str:
    return f"query_id {asked.schema['query_id'].dataType.simpleString()}, `{key}` {rows.schema[key].dataType.simpleString()}, score double"


def ranked(hits: DataFrame, k: int, key: str) -> DataFrame:
    """The k best of each query's hits, by score and key."""
    out = hits.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("score", key)))
    return out.where(F.col("rank") <= k)


def in_blocks(rows: DataFrame, asked: DataFrame, same: str, k: int, key: str, block_rows: int = BLOCK_ROWS, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, key, score): the k nearest of every block of rows (key, v, same) for each of (query_id, q, same) where same agrees.

    A value of same is cut into blocks on both sides, so that a hot one is many tasks of bounded size; every block of queries meets
    every block of rows of its value, and rows whose value nobody asks for are not moved.
    """
    per = F.greatest(F.lit(1), F.floor(F.lit(query_bytes) / F.max(8 * F.size("q") + 64)))
    held = rows.groupBy(same).agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("rb"))
    sizes = held.join(asked.groupBy(same).agg(F.ceil(F.count(F.lit(1)) / per).cast("int").alias("qb")), same)
    deal = lambda id, n: F.pmod(F.xxhash64(id), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.join(sizes, same).select(same, deal(key, "rb").alias("r"), every("qb").alias("b"), key, "v")
    right = asked.join(sizes, same).select(same, every("rb").alias("r"), deal("query_id", "qb").alias("b"), "query_id", "q")

    def compare(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        if not mine.num_rows or not theirs.num_rows:
            return pa.table({"query_id": theirs.column("query_id").slice(0, 0), key: mine.column(key).slice(0, 0), "score": pa.array([], pa.float64())})
        row, col, score = nearest_rows(_matrix(theirs.column("q").combine_chunks()), _matrix(mine.column("v").combine_chunks()), k)
        return pa.table({"query_id": theirs.column("query_id").take(pa.array(row)), key: mine.column(key).take(pa.array(col)), "score": score})

    return left.groupBy(same, "r", "b").cogroup(right.groupBy(same, "r", "b")).applyInArrow(compare, _hits(rows, asked, key))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def nearest_rows(asked: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of at least the k nearest rows of each query, ties included: a product finds them, and differences in
    double precision score them."""
    square = (x * x).sum(1)
    rows, cols, scores = [], [], []
    for lo in range(0, len(asked), 512):
        q = asked[lo : lo + 512]
        about = square[None] + (q * q).sum(1)[:, None] - 2 * q @ x.T
        if len(x) > k:
            # what the product's rounding may have put behind the k-th stays in
            slack = 1e-9 * (square.max() + (q * q).sum(1) + 1)
            row, col = np.nonzero(~(about > (np.partition(about, k - 1, axis=1)[:, k - 1] + slack)[:, None]))
        else:
            row, col = (c.ravel() for c in np.indices(about.shape))
        rows.append(lo + row)
        cols.append(col)
        scores += [((x[col[i : i + 50_000]] - q[row[i : i + 50_000]]) ** 2).sum(1) for i in range(0, len(row), 50_000)]
    none = np.zeros(0, np.int64)
    return np.concatenate(rows or [none]), np.concatenate(cols or [none]), np.concatenate(scores or [np.zeros(0)])


def _nearest(shared, k: int, key: str):
    """The k nearest of a task's rows for each query; what is held between batches is k rows a query, cut when it has grown fourfold."""

    def groups(names: pa.Array) -> dict[str, np.ndarray]:
        out: dict[str, list[int]] = {}
        for i, g in enumerate(names.to_pylist()):
            out.setdefault(g, []).append(i)
        return {g: np.array(v) for g, v in out.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value.combine_chunks()
        if not asked.num_rows:
            return
        lists = asked.column("q").combine_chunks()
        asks = groups(asked.column("same"))
        wanted = {g: _matrix(lists.take(pa.array(at))) for g, at in asks.items()}
        held: list[pa.Table] = []
        size = 0

        def cut() -> pa.Table:
            best = pa.concat_tables(held).sort_by([("at", "ascending"), ("score", "ascending"), (key, "ascending")])
            at = best.column("at").to_numpy()
            first = np.searchsorted(at, at)
            return best.filter(pa.array(np.arange(len(at)) - first < k))

        for batch in batches:
            for g, own in groups(batch.column("same")).items():
                if g not in asks:
                    continue
                row, col, score = nearest_rows(wanted[g], _matrix(batch.column("v").take(pa.array(own))), k)
                held.append(pa.table({"at": asks[g][row], key: batch.column(key).take(pa.array(own[col])), "score": score}))
                size += len(row)
            if size > 4 * k * asked.num_rows:
                held = [cut()]
                size = held[0].num_rows
        if held:
            best = cut()
            out = pa.table({"query_id": asked.column("query_id").take(best.column("at")), key: best.column(key), "score": best.column("score")})
            yield from out.combine_chunks().to_batches()

    return run


def batch_topk_with_fallback(index: DataFrame, queries: DataFrame, k: int, by: list[str], **kw) -> DataFrame:
    """T5 for many queries: those without a filtered hit search the whole index. Runs the filtered search when it is called."""
    hit = settled(batch_topk(index, queries, k, by=by, **kw))
    missed = queries.join(hit.select("query_id").distinct(), "query_id", "left_anti")
    return hit.withColumn("fallback", F.lit(False)).unionByName(batch_topk(index, missed, k, **kw).withColumn("fallback", F.lit(True)))
