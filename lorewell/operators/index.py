"""Index build and lifecycle (K5, K6, A2, L1-L3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.functions.embed import Embedder, embed, hashed_ngrams
from lorewell.functions.text import split_documents
from lorewell.operators import generations, knn


def chunks_of(docs: DataFrame, chunk_size: int = 500, chunk_overlap: int = 100) -> DataFrame:
    """X1 with a stable chunk key: the hash of what the chunk is, so a rebuild gives the same rows."""
    meta = [c for c in docs.columns if c != "content"]
    cut = split_documents(docs, "content", chunk_size, chunk_overlap)
    return cut.withColumn("vec_id", F.xxhash64("content", "chunk_id", *[F.col(m).cast("string") for m in meta]))


def build(docs: DataFrame, path: str, embedder: Embedder = hashed_ngrams, chunk_size: int = 500, chunk_overlap: int = 100, partition_by: str | None = None) -> int:
    """K5 + E1: split, embed, write; returns the number of chunks. Rebuilding replaces, so nothing doubles, in one step: a reader
    finds the old chunks until the new ones are complete.

    partition_by: a filter column of few values that searches prune by. Empty input leaves the index as it is.
    """
    if docs.isEmpty():
        return 0
    rows = embed(chunks_of(docs, chunk_size, chunk_overlap).dropDuplicates(["vec_id"]), "content", embedder=embedder)
    generations.replace(rows, path, partition_by)
    return count(docs.sparkSession, path)


def append(docs: DataFrame, path: str, embedder: Embedder = hashed_ngrams, tries: int = 5) -> int:
    """Adds only chunks that the index lacks, as a generation of their own; returns how many. Where another writer was first,
    what is lacking is told anew."""
    spark = docs.sparkSession
    rows = chunks_of(docs).dropDuplicates(["vec_id"])
    for left in range(tries - 1, -1, -1):
        before = generations.manifest(spark, path)
        new = rows.join(generations.read(spark, path, before["version"]).select("vec_id"), "vec_id", "left_anti") if before else rows
        try:
            version = generations.append(embed(new, "content", embedder=embedder), path, before)
            return count(spark, path, version) - (count(spark, path, before["version"]) if before else 0)
        except generations.Conflict:
            if not left:
                raise
    return 0


def remove_documents(keys: DataFrame, path: str, key: str) -> int:
    """Drops the chunks of documents by a metadata column; returns how many chunks are left. No part is rewritten until compact()."""
    generations.delete(keys, path, key)
    return count(keys.sparkSession, path)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The chunks of the index, as they are now or were in a version."""
    return generations.read(spark, path, version)


def count(spark: SparkSession, path: str, version: int | None = None) -> int:
    """A2: chunks; a missing index has 0, a damaged one raises."""
    return generations.read(spark, path, version).count() if generations.manifest(spark, path) else 0


def clear(spark: SparkSession, path: str) -> None:
    """K6: the index stays readable and is empty."""
    if generations.manifest(spark, path):
        generations.clear(spark, path)


def ensure(spark: SparkSession, path: str, docs: DataFrame, embedder: Embedder = hashed_ngrams) -> int:
    """L1: builds only an index that is missing or empty."""
    return count(spark, path) or build(docs, path, embedder)


# Smoke queries of the two builders.
SMOKE = ["秦始皇统一六国", "李白的诗歌", "赤壁之战"]


def smoke(spark: SparkSession, path: str, queries: list[str] | None = None, k: int = 2, embedder: Embedder = hashed_ngrams) -> DataFrame:
    """L2 and L3: k previews for each smoke query, as one batched search."""
    asked = spark.createDataFrame(list(enumerate(queries or SMOKE)), "query_id int, query string")
    q = embed(asked, "query", "q", embedder)
    index = read(spark, path)
    hits = knn.batch_topk(index, q, k)
    return hits.join(asked, "query_id").join(index.select("vec_id", "title", F.concat(F.left("content", F.lit(60)), F.lit("...")).alias("preview")), "vec_id").orderBy("query_id", "rank")
