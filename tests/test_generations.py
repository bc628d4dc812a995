"""Generations: every row once through appends, deletes and compaction, readers in between, writers that meet."""

import pytest

from lorewell.operators import generations as g
from lorewell.operators import index

SCHEMA = "k long, v string"


def rows(df):
    return sorted((r["k"], r["v"]) for r in df.collect())


def test_life_of_a_table(spark, tmp_path):
    path = str(tmp_path / "t")
    make = lambda *ks, v="a": spark.createDataFrame([(k, v) for k in ks], SCHEMA)
    assert g.manifest(spark, path) is None
    with pytest.raises(ValueError, match="no table"):
        g.read(spark, path)
    assert g.append(make(1, 2, 3), path) == 1
    reader = g.read(spark, path)
    g.append(make(4, 5), path)
    g.delete(make(2, 4, 9), path, "k")
    assert rows(g.read(spark, path)) == [(1, "a"), (3, "a"), (5, "a")]
    g.append(make(2, v="again"), path)
    assert rows(g.read(spark, path)) == [(1, "a"), (2, "again"), (3, "a"), (5, "a")]
    g.delete(make(2), path, "k")
    g.append(make(2, v="third"), path)
    before = rows(g.read(spark, path))
    g.compact(spark, path)
    assert rows(g.read(spark, path)) == before and len(g.manifest(spark, path)["parts"]) == 1 and not g.manifest(spark, path)["deletes"]
    # a reader of the first version, and any version by number, still finds what it held
    assert rows(reader) == [(1, "a"), (2, "a"), (3, "a")] and rows(g.read(spark, path, 2)) == [(k, "a") for k in range(1, 6)]
    g.replace(make(7), path)
    assert rows(g.read(spark, path)) == [(7, "a")]
    g.clear(spark, path)
    assert g.read(spark, path).count() == 0 and g.read(spark, path).columns == ["k", "v"]
    assert g.vacuum(spark, path) and g.versions(spark, path) == [9] and not g.vacuum(spark, path)
    with pytest.raises(ValueError, match="no version 2"):
        g.read(spark, path, 2)


def test_two_writers(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    one = spark.createDataFrame([(1, "a")], SCHEMA)
    g.replace(one, path)
    stale = g.manifest(spark, path)
    g.append(one, path)
    with pytest.raises(g.Conflict):
        g.append(one, path, stale)
    assert g.read(spark, path).count() == 2 and len(g.vacuum(spark, path)) == 1


def test_partitions_nulls_and_other_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "x", {"a": 1}), (None, None, None), (2, "y", {})], "k long, v string, _at map<string,int>")
    g.replace(df, path, "v")
    g.append(df.limit(0), path)
    g.delete(df.select("k"), path, "k")
    assert [(r["k"], r["v"]) for r in g.read(spark, path).collect()] == [(None, None)]


def test_index_deletes_and_concurrent_append(spark, tmp_path):
    path = str(tmp_path / "i")
    docs = spark.createDataFrame([("one text", "a"), ("two texts", "b"), ("three", "c")], "content string, title string")
    assert index.build(docs, path) == 3 and index.remove_documents(docs.where("title = 'b'"), path, "title") == 2
    assert index.append(docs, path) == 1 and index.count(spark, path) == 3
    assert [r["title"] for r in index.read(spark, path, 2).orderBy("title").collect()] == ["a", "c"]


def test_parts_of_one_scan_keep_their_deletes(spark, tmp_path):
    path = str(tmp_path / "t")
    make = lambda *ks, v="a": spark.createDataFrame([(k, v) for k in ks], SCHEMA)
    want = set()
    for i in range(4):
        g.append(make(i, 9, v=str(2 * i)), path)
        g.append(make(i + 10, 9, v=str(2 * i + 1)), path)
        want |= {(i, str(2 * i)), (i + 10, str(2 * i + 1))}
        g.delete(make(9, 11), path, "k")
        want.discard((11, "3"))
    g.append(make(9, v="last"), path)
    assert rows(g.read(spark, path)) == sorted(want | {(9, "last")})
    plan = g.read(spark, path)._jdf.queryExecution().analyzed().toString()
    assert sum("Relation" in s and "v#" in s for s in plan.split("\n")) == 5
