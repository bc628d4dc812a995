"""Embedding and generation plug-ins (E1-E3) with offline, deterministic defaults."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.functions.text import slices
from lorewell.session import free_name, release

Embedder = Callable[[list[str]], np.ndarray]


def hashed_ngrams(texts: list[str], dim: int = 256, sizes: tuple[int, ...] = (1, 2, 3)) -> np.ndarray:
    """Signed counts of hashed character n-grams, scaled to length 1, all texts at once; empty text gives zeros."""
    codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    flat = np.concatenate([*codes, np.zeros(0, "<u4")]).astype(np.uint64) + np.uint64(1)
    row = np.repeat(np.arange(len(texts)), [len(c) for c in codes])
    out = np.zeros(len(texts) * dim)
    for n in sizes:
        h = np.full(max(0, len(flat) - n + 1), n, np.uint64)
        for i in range(n):
            h = (h ^ flat[i : i + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        whole = row[: len(h)] == row[n - 1 : n - 1 + len(h)]
        h, at = h[whole], row[: len(h)][whole]
        slot = at * dim + ((h >> np.uint64(8)) % np.uint64(dim)).astype(np.int64)
        out += np.bincount(slot, weights=1.0 - 2.0 * (h & np.uint64(1)).astype(np.float64), minlength=len(out))
    vectors = out.reshape(len(texts), dim)
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norm, out=vectors, where=norm > 0).astype(np.float32)


def embed(df: DataFrame, column: str, into: str = "embedding", embedder: Embedder = hashed_ngrams) -> DataFrame:
    """One embedding per row, the embedder being called with up to 1,000 texts; null text counts as empty."""

    @F.arrow_udf("array<float>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for texts in slices(batch):
                vectors = np.asarray(embedder([t or "" for t in texts.to_pylist()]), np.float32)
                ends = np.arange(len(texts) + 1, dtype=np.int32) * np.int32(vectors.shape[1])
                yield pa.ListArray.from_arrays(pa.array(ends), pa.array(vectors.ravel()))
        release()

    return df.withColumn(into, run(column))


def extractive_reply(messages: list[dict]) -> str:
    """The default generator: it quotes the first evidence line, or else the question."""
    system = next((m["content"] for m in messages if m["role"] == "system"), "")
    evidence = [line for line in system.split("\n") if line.startswith("[史料")]
    asked = next((m["content"] for m in reversed(messages) if m["role"] == "user"), "")
    return f"{evidence[0]}\n{asked}" if evidence else asked


def generate(df: DataFrame, column: str = "messages", into: str = "reply", generator: Callable[[list[dict]], str] = extractive_reply) -> DataFrame:
    """A reply for each row's message list; a failing call leaves null and its message in <into>_error."""
    name = free_name(df.columns, "_said")

    def one(messages) -> tuple[str | None, str | None]:
        try:
            return generator([m if isinstance(m, dict) else m.asDict() for m in messages]), None
        except Exception as e:  # noqa: BLE001  a reply that fails must not fail the others
            return None, str(e)

    @F.pandas_udf("said string, failed string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([one(m) for m in batch], columns=["said", "failed"])

    # only the messages go to Python, and no plan may call the generator twice for a row
    said = df.withColumn(name, run.asNondeterministic()(column))
    return said.withColumns({into: F.col(name)["said"], f"{into}_error": F.col(name)["failed"]}).drop(name)
