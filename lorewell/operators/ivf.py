"""An inverted file over vectors (T1, K5): an index whose searches read only the cells near a query.

Cells are learned by k-means on a bounded sample. Every row is written to its nearest cells, sorted by cell within shelves of cells,
which are partitions of the written table; a search reads the shelves that it probes, and of these the row groups of the cells. How
many cells are probed is learned from the index itself: the exact neighbours of a few of its rows are found once, and as many cells
are taken as hold the asked share of them.

Rows and queries meet cell by cell in a shuffle, and large cells are cut into blocks (knn.in_blocks), so no task grows with a hot
cell and no query reaches the driver. What all tasks are sent are the centres, at most MOST_CELLS of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.operators import knn

#: Rows that centres are learned from, cells at most, rows a cell is to have while there are fewer cells, rows a shelf is to have.
SAMPLE_ROWS, MOST_CELLS, CELL_ROWS, SHELF_ROWS = 16_384, 4_096, 4, 1_000_000
#: Cells that a row is written to, rows whose neighbours the number of probes is learned from, share of these that is
#: to be found (the row itself does not count).
COPIES, TRIED, FOUND = 1, 200, 0.9


@dataclass
class Cells:
    """Centres, the cells that a search probes, and how many cells share a shelf."""

    centres: np.ndarray
    probes: int
    per_shelf: int

    def order(self, x: np.ndarray, most: int) -> np.ndarray:
        """The nearest cells of each vector, nearest first."""
        apart = (self.centres**2).sum(1)[None] - 2 * x @ self.centres.T
        most = min(most, len(self.centres))
        some = np.argpartition(apart, most - 1, axis=1)[:, :most] if most < len(self.centres) else np.broadcast_to(np.arange(len(self.centres)), apart.shape)
        return np.take_along_axis(some, np.argsort(np.take_along_axis(apart, some, 1), axis=1, kind="stable"), 1)


def sound(rows: DataFrame, vector: str) -> DataFrame:
    """Rows with a vector of at least one component, all of them finite."""
    v = F.col(vector)
    return rows.where(v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 3) -> np.ndarray:
    centres = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = np.concatenate([((centres**2).sum(1)[None] - 2 * x[i : i + 2048] @ centres.T).argmin(1) for i in range(0, len(x), 2048)])
        order = np.argsort(near, kind="stable")
        used, first, n = np.unique(near[order], return_index=True, return_counts=True)
        centres[used] = np.add.reduceat(x[order], first, axis=0) / n[:, None]
    return centres


def with_cells(rows: DataFrame, cells: Cells, most: int, vector: str) -> DataFrame:
    """rows with an array of their nearest cells, `cells`."""
    shared = rows.sparkSession.sparkContext.broadcast(cells)

    def near(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            x = batch.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            found = [shared.value.order(x[i : i + 2048], most) for i in range(0, len(x), 2048)]
            yield pa.array([row.tolist() for part in found for row in part], pa.list_(pa.int32()))

    return rows.withColumn("cells", F.arrow_udf(near, "array<int>")(F.col(vector).cast("array<double>")))


def sample(rows: DataFrame, n: int, most: int, vector: str, key: str) -> np.ndarray:
    """At most `most` of n vectors, those of the smallest hashes of their keys."""
    part = rows.select(F.col(vector).cast("array<double>").alias("v"), F.xxhash64(key).alias("h"))
    if n > most:
        part = part.where((F.col("h").cast("double") / F.lit(2.0**64) + 0.5) <= F.lit(2.0 * most / n))
    found = part.orderBy("h", "v").limit(most).select("v").toArrow().column("v").combine_chunks()
    return found.flatten().to_numpy(zero_copy_only=False).reshape(len(found), -1) if len(found) else np.zeros((0, 1))


def _write(rows: DataFrame, cells: Cells, path: str, copies: int, vector: str, mode: str) -> None:
    placed = with_cells(rows, cells, copies, vector).withColumn("cell", F.explode("cells")).drop("cells")
    placed = placed.withColumn("shelf", (F.col("cell") / cells.per_shelf).cast("int"))
    # rebalancing splits a shelf that is too large for one task and keeps small ones together
    placed.hint("rebalance", "shelf").sortWithinPartitions("shelf", "cell").write.mode(mode).partitionBy("shelf").parquet(f"{path}/rows")


def build(rows: DataFrame, path: str, vector: str = "embedding", key: str = "vec_id", k: int = 10, copies: int = COPIES, found: float = FOUND, sample_rows: int = SAMPLE_ROWS, shelf_rows: int = SHELF_ROWS) -> Cells:
    """Learns cells, writes the rows by cell under path, learns the number of probes, and writes the cells beside them.

    Rows without a finite vector cannot be searched and are left out; all vectors are to have one length. An empty table gives an
    index of no cells, which finds nothing.
    """
    spark = rows.sparkSession
    rows = sound(rows, vector)
    n = rows.count()
    some = sample(rows, n, sample_rows, vector, key)
    wanted = max(1, min(MOST_CELLS, n // CELL_ROWS, len(some) // 4)) if n else 0
    per_shelf = max(1, round(wanted * shelf_rows / max(1, n * copies)))
    cells = Cells(kmeans(some, wanted) if n else np.zeros((0, 1)), wanted, min(per_shelf, max(1, wanted)))
    if n:
        _write(rows, cells, path, copies, vector, "overwrite")
        cells.probes = probes_for(rows, cells, vector, key, k, copies, found)
    table = pa.table({"cell": np.arange(wanted), "centre": pa.array(cells.centres.tolist(), pa.list_(pa.float64()))})
    spark.createDataFrame(table).withColumns({"probes": F.lit(cells.probes), "per_shelf": F.lit(cells.per_shelf), "copies": F.lit(copies)}).coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
    return cells


def probes_for(rows: DataFrame, cells: Cells, vector: str, key: str, k: int, copies: int, found: float) -> int:
    """The least number of probes by which that share of the k exact neighbours of TRIED rows are met, each by its first cell that
    is probed. One pass over the rows."""
    tried = rows.select(F.col(key).alias("query_id"), F.col(vector).alias("q")).orderBy(F.xxhash64("query_id"), "query_id").limit(TRIED)
    hits = knn.batch_topk(rows, tried, k + 1, vector, key).where(F.col(key) != F.col("query_id")).select("query_id", key)
    order = with_cells(tried, cells, len(cells.centres), "q").select("query_id", F.col("cells").alias("order"))
    homes = with_cells(rows.join(F.broadcast(hits.select(key).distinct()), key, "left_semi"), cells, copies, vector).select(key, "cells")
    place = F.array_min(F.transform("cells", lambda c: F.array_position("order", c)))
    places = [r[0] for r in hits.join(homes, key).join(order, "query_id").select(place).collect()]
    return int(np.quantile(places, found, method="higher")) if places else len(cells.centres)


def load(spark: SparkSession, path: str) -> tuple[Cells, int]:
    """The cells of an index, and how many copies of a row it holds."""
    got = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()
    if not got:
        return Cells(np.zeros((0, 1)), 0, 1), 1
    return Cells(np.array([r["centre"] for r in got]), got[0]["probes"], got[0]["per_shelf"]), got[0]["copies"]


def append(rows: DataFrame, path: str, vector: str = "embedding") -> None:
    """Writes further rows to their cells; centres and probes stay as they were learned."""
    cells, copies = load(rows.sparkSession, path)
    if not len(cells.centres):
        raise ValueError(f"{path} was built of no rows: build it")
    _write(sound(rows, vector), cells, path, copies, vector, "append")


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, vector: str = "embedding", key: str = "vec_id", probes: int | None = None) -> DataFrame:
    """T1 for many queries (query_id, q): the k nearest rows of the probed cells, with squared L2 distance and rank."""
    cells, _ = load(spark, path)
    asked = sound(queries, "q").select("query_id", F.col("q").cast("array<double>").alias("q"))
    if not len(cells.centres):
        kind = queries.schema["query_id"].dataType.simpleString()
        return spark.createDataFrame([], f"query_id {kind}, `{key}` long, score double, rank int")
    asked = asked.where(F.size("q") == cells.centres.shape[1])
    asked = with_cells(asked, cells, probes or cells.probes, "q").withColumn("cell", F.explode("cells")).drop("cells")
    rows = probed(spark, path, asked, cells).select(key, F.col(vector).cast("array<double>").alias("v"), "cell")
    hits = knn.in_blocks(rows, asked, "cell", k, key)
    # a row's copies may both be met
    return knn.ranked(hits.groupBy("query_id", key).agg(F.min("score").alias("score")), k, key)


def probed(spark: SparkSession, path: str, asked: DataFrame, cells: Cells) -> DataFrame:
    """The written rows of the cells that queries probe. The cells' numbers are fetched, at most MOST_CELLS, so that the scan is
    pruned when it is planned: whole shelves are not listed, and row groups of other cells are skipped."""
    wanted = sorted(r[0] for r in asked.select("cell").distinct().collect())
    shelves = sorted({c // cells.per_shelf for c in wanted})
    table = spark.read.parquet(f"{path}/rows")
    return table.where(F.col("shelf").isin(shelves) & F.col("cell").isin(wanted)) if len(wanted) < len(cells.centres) else table


def compared(spark: SparkSession, path: str, queries: DataFrame, key: str = "vec_id", probes: int | None = None) -> DataFrame:
    """(query_id, compared): how many different rows a search compares with each query."""
    cells, _ = load(spark, path)
    asked = with_cells(queries, cells, probes or cells.probes, "q").select("query_id", F.explode("cells").alias("cell"))
    held = spark.read.parquet(f"{path}/rows").select(key, "cell")
    return asked.join(held, "cell").groupBy("query_id").agg(F.count_distinct(key).alias("compared"))
