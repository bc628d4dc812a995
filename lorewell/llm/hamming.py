"""Nearest neighbours by multi-index hashing over learned rotated binary codes (operator 9).

Each code is cut into substrings of SUB bits, and every substring has a table: for each of its 2^SUB words, where the rows that hold it
begin. A query looks up its own word in every table and all words that differ from it in at most `reach` bits, which are enumerated
by flipping bits; nothing else of a table is read. By the pigeonhole principle this retrieves every code within radius(), and all
rows that are touched are reranked by their vectors, in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorewell.llm.common import keep

#: Vectors that rotations and reach are learned from.
SAMPLE_ROWS = 4_000
#: Bits of a substring, the numbers of substrings that learning chooses from, and the most bits that are flipped at first.
SUB, SUBS, FLIPS = 16, (8, 16, 24, 32, 48, 64, 80, 96, 128, 160), 2
#: The share of the sample's own nearest neighbours that probes are to touch.
FOUND = 0.95
#: Bytes of the vectors of an index and rows of it, and bytes of the queries that tasks are sent together.
SHARD_BYTES, SHARD_ROWS, QUERY_BYTES = 32 << 20, 65_536, 32 << 20
K = 10


@dataclass
class Coder:
    """Sign codes after a learned centre and learned rotations, and the reach of probes in each substring."""

    mean: np.ndarray
    planes: np.ndarray
    reach: int

    @property
    def subs(self) -> int:
        return self.planes.shape[1] // SUB

    def radius(self) -> int:
        """The Hamming radius within which every code is retrieved: one more bit could be spread over all substrings."""
        return self.subs * (self.reach + 1) - 1

    def keys(self, x: np.ndarray) -> np.ndarray:
        """One row of substring keys for every vector."""
        out = []
        for i in range(0, len(x), 4096):
            out.append(np.packbits((x[i : i + 4096] - self.mean) @ self.planes > 0, axis=1).view(np.uint16))
        return np.concatenate(out) if out else np.zeros((0, self.subs), np.uint16)


def learn(sample: np.ndarray, k: int = K, rows: int = 0, seed: int = 9) -> Coder:
    """Iterative quantisation on PCA axes, restarted for each group of bits. Of all reaches and numbers of substrings whose
    probes touch FOUND of the sample's nearest neighbours, the one that touches the least of the sample.

    rows: of how many the sample is taken. The k nearest of all lie about as far as that share of k in the sample, one at least.
    """
    k = max(1, round(k * min(1.0, len(sample) / max(rows, 1))))
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    mean = sample.mean(0)
    x = sample - mean
    _, _, axes = np.linalg.svd(x, full_matrices=False)
    basis = axes.T if len(axes) == dim else np.eye(dim)
    planes = []
    while sum(p.shape[1] for p in planes) < SUB * SUBS[-1]:
        r = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        v = x @ basis
        for _ in range(8):
            u, _, w = np.linalg.svd(np.sign(v @ r).T @ v)
            r = (u @ w).T
        planes.append(basis @ r)
    full = Coder(mean, np.concatenate(planes, 1)[:, : SUB * SUBS[-1]], SUB)
    some = rng.permutation(len(sample))[:200]
    keys = full.keys(sample)
    near = np.argsort((x**2).sum(1)[None] - 2 * x[some] @ x.T, axis=1)[:, 1 : k + 1]
    if not near.size:
        return full
    # the least distance of any of the first substrings, to all rows and to the nearest
    least, chosen = np.full((len(some), len(sample)), SUB, np.uint8), []
    for j in range(SUBS[-1]):
        least = np.minimum(least, np.bitwise_count(keys[some, j, None] ^ keys[None, :, j]))
        if j + 1 in SUBS:
            hit = np.take_along_axis(least, near, axis=1)
            chosen += [((least <= reach).mean(), j + 1, reach) for reach in range(FLIPS + 1) if (hit <= reach).mean() >= FOUND]
    # where no choice finds the asked share, all substrings are probed as far as is allowed
    _, subs, reach = min(chosen, default=(1.0, SUBS[-1], FLIPS))
    return Coder(mean, full.planes[:, : subs * SUB], reach)


@lru_cache(maxsize=None)
def flips(reach: int) -> np.ndarray:
    """All words of SUB bits with at most `reach` bits set, those of fewer bits first."""
    out = [sum(1 << b for b in bits) for n in range(reach + 1) for bits in combinations(range(SUB), n)]
    return np.array(out, np.uint16)


class MultiIndex:
    """The tables of a shard: for each word of each substring, where its rows begin in `rows`."""

    def __init__(self, keys: np.ndarray) -> None:
        self.n, self.subs = keys.shape
        self.rows = np.zeros(self.subs * self.n, np.int32)
        self.first = np.zeros((self.subs, (1 << SUB) + 1), np.int32)
        for j in range(self.subs):
            self.rows[j * self.n : (j + 1) * self.n] = np.argsort(keys[:, j], kind="stable")
            np.cumsum(np.bincount(keys[:, j], minlength=1 << SUB), out=self.first[j, 1:])
        self.table = np.arange(self.subs)[:, None]

    def touched(self, key: np.ndarray, reach: int) -> np.ndarray:
        """All rows of which a substring is within reach of the query's."""
        if reach >= SUB // 2:
            return np.arange(self.n)
        word = (key[:, None] ^ flips(reach)[None]).astype(np.int64)
        start, end = self.first[self.table, word], self.first[self.table, word + 1]
        size = (end - start).ravel()
        held = np.flatnonzero(size)
        size, start = size[held], (start + self.table * self.n).ravel()[held].astype(np.int64)
        found = np.zeros(self.n, bool)
        if len(held):
            found[self.rows[np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())]] = True
        return np.flatnonzero(found)

    def read(self, reach: int) -> int:
        """Bytes of the tables that a query reads before it knows its rows."""
        return 8 * self.subs * len(flips(reach))


def search_shard(ids: np.ndarray, x: np.ndarray, q: np.ndarray, keys: np.ndarray, coder: Coder, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(ids, distances, rows touched): for every query (q, its keys) the k nearest found in the shard, -1 and infinity where it
    has fewer. The reach grows until k rows are touched or the shard is exhausted. Ties go to the smaller id."""
    index = MultiIndex(coder.keys(x))
    best, apart, seen = np.full((len(q), k), -1, np.int64), np.full((len(q), k), np.inf), 0
    for i in range(len(q)):
        reach = coder.reach
        while len(rows := index.touched(keys[i], reach)) < k and len(rows) < len(x):
            # beyond a few flips, going on costs more than all rows do
            reach = reach + 1 if reach <= FLIPS else SUB
        seen += len(rows)
        d = np.sqrt(((x[rows] - q[i]) ** 2).sum(1))
        if len(rows) > 4 * k:
            some = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
            rows, d = rows[some], d[some]
        order = np.lexsort((ids[rows], d))[:k]
        best[i, : len(order)], apart[i, : len(order)] = ids[rows[order]], d[order]
    return best, apart, seen


def valid(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v, dim): rows with a key and a vector that is not null, empty or zero and has only finite components."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(key).alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    return rows.where(~bad & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))


def _vectors(column: pa.ListArray) -> np.ndarray:
    """Vectors of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def search(vectors: DataFrame, queries: DataFrame, k: int = K, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for every query, by Euclidean distance.

    vectors and queries have vec_id, v and dim (see valid()); only vectors of a query's length are compared with it, and of a
    query id's several vectors the least one asks. Equal vectors are one entry of the index that carries its k + 1 smallest
    ids, which is all that k neighbours can need of them. Entries stay where they are: tasks index them shard by shard and are
    sent the queries, QUERY_BYTES of them a pass; a task gives k + 1 rows a query. Empty tables give no row.
    """
    spark = vectors.sparkSession
    empty = "query_id long, rank int, vec_id long, score double"
    entries = keep(vectors.groupBy("v", "dim").agg(F.min("vec_id").alias("lo"), F.count(F.lit(1)).alias("copies")))
    asked = keep(queries.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v")))
    size = {r["dim"]: r["n"] for r in entries.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    asks = {r["dim"]: r["n"] for r in asked.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    hits = None
    for dim in sorted(set(size) & set(asks)):
        n = size[dim]
        own = entries.where(F.col("dim") == dim)
        coder = learn(sampled(own, n, sample_rows), k, n)
        # a query's vector, its keys, and what is held of it
        blocks = max(1, -(-asks[dim] * (8 * dim + 2 * coder.subs + 32 * (k + 1)) // QUERY_BYTES))
        shard = max(1, min(SHARD_ROWS, SHARD_BYTES // (8 * dim)))
        parts = max(1, min(-(-n // shard), int(spark.conf.get("spark.sql.shuffle.partitions"))))
        spread = own.select("lo", "v").repartition(parts, "lo")
        for b in range(blocks):
            rows = asked.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)).select("vec_id", "v").toArrow()
            q = _vectors(rows.column("v").combine_chunks()) if rows.num_rows else np.zeros((0, dim))
            shared = spark.sparkContext.broadcast((rows.column("vec_id").to_numpy(), q, coder.keys(q), coder))
            found = spread.mapInArrow(_searcher(shared, k + 1, shard), "query_id long, lo long, score double")
            hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        return spark.createDataFrame([], empty)
    first = hits.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy("score", "lo"))).where(F.col("r") <= k + 1)
    # copies: entries that several rows share give their smallest ids
    many = entries.where("copies > 1").select("v", "lo")
    member = vectors.select("vec_id", "v").join(many, "v")
    least = member.select("lo", "vec_id", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("salt"))
    for by in (["lo", "salt"], ["lo"]):
        least = least.withColumn("r", F.row_number().over(W.partitionBy(*by).orderBy("vec_id"))).where(F.col("r") <= k + 1).drop("r")
    ids = least.groupBy("lo").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    spread = first.select("query_id", "lo", "score").join(ids, "lo", "left").withColumn("vec_id", F.explode(F.coalesce("ids", F.array("lo"))))
    ranked = spread.where("vec_id != query_id").withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def sampled(entries: DataFrame, n: int, most: int) -> np.ndarray:
    """At most `most` of n distinct vectors, those of the smallest hashes."""
    part = entries.select("v", F.xxhash64("v").alias("h"))
    if n > most:
        part = part.where((F.col("h").cast("double") / F.lit(2.0**64) + 0.5) <= F.lit(1.5 * most / n)).orderBy("h").limit(most)
    return np.array([r["v"] for r in sorted(part.collect(), key=lambda r: r["h"])], dtype=np.float64)


def _searcher(shared, k: int, shard: int):
    """Searches a task's rows shard by shard and gives the k nearest of all of them for every query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q, keys, coder = shared.value
        best, apart = np.full((len(q), k), -1, np.int64), np.full((len(q), k), np.inf)
        held: list[pa.RecordBatch] = []

        def add() -> None:
            ids, x = np.concatenate([b.column("lo").to_numpy() for b in held]), np.concatenate([_vectors(b.column("v")) for b in held])
            new, d, _ = search_shard(ids, x, q, keys, coder, k)
            both, far = np.concatenate([best, new], 1), np.concatenate([apart, d], 1)
            order = np.lexsort((both, far), axis=1)[:, :k]
            best[:], apart[:] = np.take_along_axis(both, order, 1), np.take_along_axis(far, order, 1)

        for batch in batches:
            for i in range(0, batch.num_rows, shard):
                part = batch.slice(i, shard)
                if sum(b.num_rows for b in held) + part.num_rows > shard:
                    add()
                    held.clear()
                held.append(part)
        if held:
            add()
        row, col = np.nonzero(best >= 0) if len(q) else (np.zeros(0, np.int64),) * 2
        yield pa.RecordBatch.from_arrays([pa.array(qids[row], pa.int64()), pa.array(best[row, col], pa.int64()), pa.array(apart[row, col], pa.float64())], ["query_id", "lo", "score"])

    return run


def op9_hamming(spark, sf_dir: str) -> DataFrame:
    """The 10 nearest of all embeddings for those whose id is divisible by 100."""
    from lorewell.session import table

    rows = valid(table(spark, sf_dir, "embeddings"))
    return search(rows, rows.where("vec_id % 100 = 0"))
