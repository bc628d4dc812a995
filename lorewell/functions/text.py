"""Text expressions (X5-X14) and the recursive splitter."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell.session import free_name, release

#: Texts of about so many bytes are in Python's hands at once; a longer one stands alone.
SLICE = 1 << 20

# Separators tried in this order.
SEPARATORS = ["\n\n", "\n", "。", "！", "？", ".", "!", "?", " ", ""]


def strip(c: Column) -> Column:
    """Strips Unicode white space, which trim() would leave."""
    return F.regexp_replace(c, r"(?U)^[\s　]+|[\s　]+$", "")


def preview(c: Column, n: int = 60) -> Column:
    """F11."""
    return F.concat(F.left(c, F.lit(n)), F.lit("..."))


def safe_filename(c: Column) -> Column:
    """Characters that file systems refuse become underscores."""
    return F.regexp_replace(c, r'[\\/:*?"<>|]', "_")


def line_breaks(c: Column, tag: str = "<br>") -> Column:
    """X10."""
    return F.replace(c, F.lit("\n"), F.lit(tag))


def timestamp_text(c: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """X11; the clock is always a parameter."""
    return F.date_format(c, pattern)


def error_class(message: Column) -> Column:
    """Network before auth before generic; only 'Connection' is case-sensitive."""
    low = F.lower(message)
    return (
        F.when(message.contains("Connection") | low.contains("timeout"), "network")
        .when(low.contains("api_key") | low.contains("unauthorized"), "auth")
        .otherwise("generic")
    )


def _pieces(text: str, separator: str) -> list[str]:
    """Split, each separator kept at the start of what follows it."""
    if not separator:
        return list(text)
    head, *rest = text.split(separator)
    return [p for p in [head, *(separator + r for r in rest)] if p]


def split_text(text: str, chunk_size: int = 500, chunk_overlap: int = 100, separators: list[str] | None = None) -> list[str]:
    """Recursive splitting; lengths are code points.

    Empty text gives no chunk. Chunks are stripped, and empty ones dropped. With "" among the
    separators no chunk is longer than chunk_size.
    """
    seps = SEPARATORS if separators is None else separators
    at = next((i for i, s in enumerate(seps) if s == "" or s in text), len(seps) - 1)
    finer = seps[at + 1 :]
    out: list[str] = []
    waiting: list[str] = []
    for piece in _pieces(text, seps[at]):
        if len(piece) < chunk_size:
            waiting.append(piece)
            continue
        out += _merge(waiting, chunk_size, chunk_overlap)
        waiting = []
        out += split_text(piece, chunk_size, chunk_overlap, finer) if finer else [piece]
    return out + _merge(waiting, chunk_size, chunk_overlap)


def _merge(pieces: list[str], size: int, overlap: int) -> list[str]:
    """Greedy windows over the pieces; a window keeps a tail of at most overlap for the next."""
    out: list[str] = []
    first, total = 0, 0
    for i, piece in enumerate(pieces):
        n = len(piece)
        if total + n > size and i > first:
            out.append("".join(pieces[first:i]).strip())
            while first < i and (total > overlap or total + n > size):
                total -= len(pieces[first])
                first += 1
        total += n
    out.append("".join(pieces[first:]).strip())
    return [c for c in out if c]


def slices(batch: pa.Array, most: int = SLICE, rows: int = 1_000) -> Iterator[pa.Array]:
    """An Arrow batch of texts in slices of about `most` bytes and at most `rows` texts, so that what is made of them stays small
    however many rows Spark sends at once."""
    sizes = pc.fill_null(pc.binary_length(batch), 0).to_pylist()
    first, total = 0, 0
    for i, n in enumerate(sizes):
        if i > first and (total + n > most or i - first == rows):
            yield batch.slice(first, i - first)
            first, total = i, 0
        total += n
    if first < len(batch):
        yield batch.slice(first)


def split_documents(docs: DataFrame, column: str = "content", chunk_size: int = 500, chunk_overlap: int = 100) -> DataFrame:
    """X1 over a DataFrame: one row per chunk, all columns kept, with chunk_id from 0.

    Null and empty texts give no chunk.
    """
    name = free_name(docs.columns, "_chunks")

    @F.arrow_udf("array<string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for texts in slices(batch):
                yield pa.array([split_text(t, chunk_size, chunk_overlap) if t else [] for t in texts.to_pylist()], pa.list_(pa.string()))
        release()

    # only the text goes to Python
    others = [c for c in docs.columns if c != column]
    cut = docs.withColumn(name, run(column)).select(*others, F.posexplode(name).alias("chunk_id", column))
    return cut.select(*docs.columns, "chunk_id")


def chunk_fixed(docs: DataFrame, column: str, size: int = 500, overlap: int = 100) -> DataFrame:
    """Sliding windows of size, step size - overlap: a simplified X1 that SQL can express."""
    step = size - overlap
    n = F.char_length(column)
    last = F.greatest(F.lit(0), F.ceil((n - overlap) / F.lit(step)).cast("int") - 1)
    return (
        docs.where(n > 0)
        .withColumn("chunk_id", F.explode(F.sequence(F.lit(0), last)))
        .withColumn("chunk", F.substring(F.col(column), F.col("chunk_id") * step + 1, F.lit(size)))
    )
