"""Vector code compression: codebooks of integer vectors, entries found by VA-file filtering (operator 12).

A vector's components become the integers floor(1024 x), and it is cut into equal consecutive parts, each replaced by the number of
the nearest entry of its position's codebook. To find it, every coordinate of the entries is quantised to a few bits; what is
stored of an entry are its cells. For a query, a table a coordinate holds the least and the greatest squared distance to each cell,
and sums over an entry's cells are bounds of its distance. Only entries whose lower bound is not above the least upper bound are
compared, in whole numbers.

A round is one pass over the vectors: tasks are sent the codebooks (a few hundred entries, whatever the data) and give a count and
sums of components an entry. Vectors are never moved, and what reaches the driver are the entries.

Rows whose vector is null, or holds a null, NaN or infinite component, are dropped; null keys, repeated rows and other columns stay.
Vectors shorter than the longest, or of a length that does not divide, count as followed by zeros. Components beyond 2^26 after
scaling count as 2^26, so that sums stay within 64 bits. With fewer rows than entries, codebooks are shorter; an empty table gives
empty codebooks and no row. Equal distances go to the lower entry; rows of equal keys open the codebook in the order of their vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.llm.common import free_name, keep, release

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Bits a coordinate of an entry is quantised to, query parts that are worked on at once, and the greatest component.
BITS, CHUNK, MOST = 4, 2048, 1 << 26
#: Bounds are sums of single-precision numbers; they are widened by more than such sums can be off.
SLACK = 1e-4


class VAFile:
    """The cells of a codebook's entries."""

    def __init__(self, entries: np.ndarray, bits: int = BITS):
        self.entries = entries
        k, dim = entries.shape
        cells = min(1 << bits, k)
        rank = np.argsort(np.argsort(entries, axis=0, kind="stable"), axis=0, kind="stable")
        self.cell = rank * cells // k
        # a cell reaches from the least to the greatest coordinate of its entries
        self.low, self.high = np.full((dim, cells), MOST, np.int64), np.full((dim, cells), -MOST, np.int64)
        axis = np.broadcast_to(np.arange(dim), (k, dim))
        np.minimum.at(self.low, (axis, self.cell), entries)
        np.maximum.at(self.high, (axis, self.cell), entries)
        # entry e takes, from each coordinate's table, the place of its cell: a product adds up all tables for all entries
        self.takes = np.zeros((dim * cells, k), np.float32)
        self.takes[axis * cells + self.cell, np.broadcast_to(np.arange(k)[:, None], (k, dim))] = 1
        self.compared = 0

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the squared distances of queries to all entries."""
        below, above = self.low - x[:, :, None], x[:, :, None] - self.high
        near = np.maximum(np.maximum(below, above), 0).astype(np.float64)
        far = np.maximum(np.abs(below), np.abs(above)).astype(np.float64)
        flat = (len(x), -1)
        low = np.square(near).astype(np.float32).reshape(flat) @ self.takes
        high = np.square(far).astype(np.float32).reshape(flat) @ self.takes
        return low * (1 - SLACK), high * (1 + SLACK)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each query; ties to the lower entry."""
        entry, distance = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        for i in range(0, len(x), CHUNK):
            part = x[i : i + CHUNK]
            low, high = self.bounds(part)
            row, col = np.nonzero(low <= high.min(1)[:, None])
            self.compared += len(row)
            apart = np.zeros(len(row), np.int64)
            for j in range(x.shape[1]):
                apart += np.square(part[row, j] - self.entries[col, j])
            first = np.searchsorted(row, np.arange(len(part)))
            least = np.minimum.reduceat(apart, first)
            hit = np.flatnonzero(apart == least[row])
            entry[i : i + CHUNK] = col[hit[np.searchsorted(row[hit], np.arange(len(part)))]]
            distance[i : i + CHUNK] = least
        return entry, distance


def integers(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of `width` integers floor(SCALE x), zeros behind shorter ones."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    whole = np.clip(np.floor(flat * SCALE), -MOST, MOST).astype(np.int64)
    if len(whole) == len(column) * width:
        return whole.reshape(len(column), width)
    size = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.int64)
    row = np.repeat(np.arange(len(column)), size)
    out[row, np.arange(len(whole)) - np.repeat(np.cumsum(size) - size, size)] = whole
    return out


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector has only finite components."""
    v = F.col(vector)
    return vectors.where(v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def _assigned(batches: Iterator[pa.RecordBatch], shared, place: int):
    """(batch, integers, entries and squared distances by part) of every piece of the batches."""
    books = shared.value
    files = [VAFile(book) for book in books] if books.shape[1] else []
    parts, _, dim = books.shape
    for batch in batches:
        for i in range(0, batch.num_rows, CHUNK):
            piece = batch.slice(i, CHUNK)
            x = integers(piece.column(place), parts * dim)
            found = [f.nearest(x[:, p * dim : (p + 1) * dim]) for p, f in enumerate(files)]
            yield piece, x, np.stack([e for e, _ in found], 1), np.stack([d for _, d in found], 1)
    release()


def _sums(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, k, dim = shared.value.shape
        count, total = np.zeros((parts, k), np.int64), np.zeros((parts, k, dim), np.int64)
        for _, x, entry, _ in _assigned(batches, shared, 0):
            for p in range(parts):
                order = np.argsort(entry[:, p], kind="stable")
                used, first = np.unique(entry[order, p], return_index=True)
                count[p, used] += np.diff(first, append=len(order))
                total[p, used] += np.add.reduceat(x[order, p * dim : (p + 1) * dim], first, axis=0)
        p, e = np.nonzero(count)
        sums = pa.FixedSizeListArray.from_arrays(pa.array(total[p, e].ravel()), dim).cast(pa.list_(pa.int64())) if dim else pa.array([[]] * len(p), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(count[p, e]), sums], ["part", "entry", "n", "sums"])

    return run


def learn(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part, entry, component): opened by the vectors of the smallest keys, each round moved to the mean of what is
    nearest to them, rounded down. An entry that nothing is nearest to stays."""
    rows = usable(vectors, vector)
    spark = rows.sparkSession
    width = rows.agg(F.max(F.size(vector))).first()[0] or 0
    width = -(-width // parts) * parts
    first = rows.select(F.col(key).alias("k"), F.col(vector).alias("v")).orderBy(F.col("k").asc_nulls_last(), "v").limit(entries).select("v").toArrow()
    opened = integers(first.column("v"), width) if first.num_rows else np.zeros((0, width), np.int64)
    dim = width // parts
    books = np.ascontiguousarray(opened.reshape(len(opened), parts, dim).transpose(1, 0, 2))
    if not len(opened):
        return books
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(books)
        found = rows.select(vector).mapInArrow(_sums(shared), "part long, entry long, n long, sums array<long>")
        sums = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dim)]
        moved = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *sums).collect()
        books = books.copy()
        for r in moved:
            books[r["part"], r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(dim)]
    return books


def encode(vectors: DataFrame, books: np.ndarray, vector: str = "embedding", code: str = "code", error: str = "error") -> DataFrame:
    """The usable rows with the entries' numbers, a byte a part, and the squared distance of the integers to them.

    The vector's column goes; other columns stay. A name that is taken gets underscores.
    """
    rows = usable(vectors, vector)
    rows = rows.select(*[c for c in rows.columns if c != vector], vector)
    others = rows.columns[:-1]
    code = free_name(others, code)
    error = free_name([*others, code], error)
    shared = rows.sparkSession.sparkContext.broadcast(books)
    schema = rows.drop(vector).schema.add(code, "binary").add(error, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, _, entry, distance in _assigned(batches, shared, len(others)):
            raw, parts = entry.astype(np.uint8).tobytes(), entry.shape[1]
            codes = pa.array([raw[i : i + parts] for i in range(0, len(raw), parts)], pa.binary())
            yield pa.RecordBatch.from_arrays([*piece.columns[:-1], codes, pa.array(distance.sum(1))], [*others, code, error])

    return rows.mapInArrow(run, schema)


def decode(code: bytes, books: np.ndarray) -> np.ndarray:
    """The components that a code stands for."""
    return np.concatenate([books[p, e] for p, e in enumerate(code)]) / SCALE


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' integers by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def op12_va_codes(spark, sf_dir: str) -> DataFrame:
    """The code and its error of every embedding, with the error of its label's rows."""
    from lorewell.session import table

    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    books = learn(rows)
    found = keep(encode(rows, books))
    totals = found.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return found.join(totals, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
