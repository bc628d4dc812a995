"""The inverted file against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorewell.operators import ivf, knn
from lorewell.session import table
from tests.conftest import SF

LARGE = "/root/testdata/sf0.1"


def asked(rows, every):
    return rows.where(f"vec_id % {every} = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def pairs(df):
    return {(r["query_id"], r["vec_id"]): r["score"] for r in df.collect()}


def test_recall_and_pruning(spark, tmp_path):
    """At sf0.1: at least 0.9 of the exact neighbours of all queries, from under 30 % of the rows, and a scan of the probed cells."""
    rows = table(spark, LARGE, "embeddings")
    path, q = str(tmp_path / "ivf"), asked(rows, 100)
    cells = ivf.build(rows, path, k=6, shelf_rows=400)
    exact = pairs(knn.batch_topk(rows, q, 6))
    found = ivf.search(spark, path, q, 6)
    near = pairs(found)
    assert len(near) == len(exact) and len(exact.keys() & near.keys()) >= 0.9 * len(exact)
    assert all(abs(near[p] - exact[p]) < 1e-9 for p in exact.keys() & near.keys())
    share = [r["compared"] / rows.count() for r in ivf.compared(spark, path, q).collect()]
    assert sum(share) / len(share) < 0.3 and cells.probes < len(cells.centres)
    one = ivf.search(spark, path, q.where("query_id = 0"), 6, probes=3)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "shelf" in plan.split("PartitionFilters: [")[1].split("]")[0] and "In(cell" in plan
    assert len({r["shelf"] for r in spark.read.parquet(f"{path}/rows").select("shelf").distinct().collect()}) > 3


def test_all_cells_are_exact_and_append_is_found(spark, tmp_path):
    rows = table(spark, SF, "embeddings")
    path, q = str(tmp_path / "ivf"), asked(rows, 10)
    cells = ivf.build(rows.where("vec_id % 3 > 0"), path)
    ivf.append(rows.where("vec_id % 3 = 0"), path)
    exact, near = pairs(knn.batch_topk(rows, q, 5)), pairs(ivf.search(spark, path, q, 5, probes=len(cells.centres)))
    assert near == pytest.approx(exact)
    assert {r["query_id"] for r in ivf.search(spark, path, q, 1).where("query_id = vec_id").collect()} == {r["query_id"] for r in q.collect()}


def test_hot_cell(spark, tmp_path):
    """A third of all rows are one vector: their cell is cut into blocks, ties go to the smaller ids."""
    x = np.random.default_rng(5).normal(size=(300, 4))
    x[::3] = x[0]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    ivf.build(df, str(tmp_path / "ivf"))
    got = ivf.search(spark, str(tmp_path / "ivf"), asked(df, 30), 4)
    first = got.where("query_id = 0").orderBy("rank").collect()
    assert [r["vec_id"] for r in first] == [0, 3, 6, 9] and [r["rank"] for r in first] == [1, 2, 3, 4]
    blocks = knn.in_blocks(df.select("vec_id", F.col("embedding").alias("v"), F.lit("a").alias("same")), asked(df, 30).withColumn("same", F.lit("a")), "same", 4, "vec_id", block_rows=16)
    assert pairs(knn.ranked(blocks, 4, "vec_id")) == pytest.approx(pairs(knn.batch_topk(df, asked(df, 30), 4)))


def test_nulls_and_empty(spark, tmp_path):
    schema = "vec_id long, embedding array<double>"
    df = spark.createDataFrame([(1, None), (2, [1.0, None]), (3, []), (4, [float("nan"), 1.0]), (5, [1.0, 2.0]), (None, [1.0, 2.5])], schema)
    path = str(tmp_path / "ivf")
    ivf.build(df, path)
    q = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [1.0])], "query_id long, q array<double>")
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ivf.search(spark, path, q, 3).collect()) == [(1, 1, 5, 0.0), (1, 2, None, 0.25)]
    ivf.build(df.limit(0), str(tmp_path / "none"))
    assert ivf.search(spark, str(tmp_path / "none"), q, 3).count() == 0
    with pytest.raises(ValueError, match="no rows"):
        ivf.append(df, str(tmp_path / "none"))
