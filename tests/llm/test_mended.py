"""Cases that earlier rounds got wrong: copies of one row in sharding, extra columns that cannot be hashed, cuts of the secret scan."""

from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from lorewell.llm import resharding, secrets_scan
from tests.conftest import SF


def balanced(rows, n, shards=24):
    """Every row once, gapless slots, shards of near equal bytes and rows dealt among all of them."""
    slots, size = defaultdict(list), Counter()
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        size[r["shard"]] += r["size"]
    assert sum(map(len, slots.values())) == n and all(sorted(v) == list(range(len(v))) for v in slots.values())
    largest = max(r["size"] for r in rows)
    assert len(size) == shards and max(size.values()) - min(size.values()) <= 4 * largest, sorted(size.values())


@pytest.mark.parametrize("block", [None, 2_000])
def test_copies_of_a_row_are_dealt(spark, monkeypatch, block):
    """1,000 different rows and 1,000 copies of one: shards stay near equal, and so do the files of copies beyond a block."""
    if block:
        monkeypatch.setattr(resharding, "BLOCK_BYTES", block)
    docs = spark.range(1000).selectExpr("id AS doc_id", "repeat('x', 150) || id AS text", "'a' AS source")
    copy = spark.range(1000).selectExpr("CAST(7 AS long) AS doc_id", "repeat('y', 152) AS text", "'b' AS source")
    rows = resharding.shard_documents(docs.unionByName(copy).repartition(5)).collect()
    balanced(rows, 2000)
    assert Counter(r["doc_id"] for r in rows)[7] == 1001


def test_copies_alone_and_again(spark, tmp_path):
    """A table of one row's copies, then more and fewer shards of it."""
    path = str(tmp_path / "layout")
    docs = spark.range(600).selectExpr("CAST(1 AS long) AS doc_id", "'same text' AS text", "CAST(NULL AS string) AS source", "map('k', 1) AS m")
    resharding.write_layout(docs, path, 6)
    for n in (6, 9, 4):
        if n != 6:
            resharding.reshard_files(spark, path, n)
        got = resharding.read_shards(spark, path).collect()
        held = defaultdict(list)
        for r in got:
            held[r["shard"]].append(r["slot"])
        assert len(got) == 600 and all(sorted(v) == list(range(len(v))) for v in held.values())
        assert len(held) == n and max(map(len, held.values())) - min(map(len, held.values())) <= 2


def test_pipeline_takes_any_column(spark):
    """Nulls, empties, repeated rows, a map, clashing names: every stage runs, extra columns pass through to the last."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    docs = docs.unionByName(docs.limit(3)).selectExpr("*", "map('a', doc_id) AS m", "doc_id AS shard", "'x' AS slot", "1 AS old", "'h' AS h", "2 AS class_id", "3 AS rep", "4 AS part", "5 AS own")
    odd = docs.limit(2).selectExpr("CAST(NULL AS long) AS doc_id", "CAST(NULL AS string) AS text", "lang", "CAST(NULL AS string) AS source", "n_chars", "m", "shard", "slot", "old", "h", "class_id", "rep", "part", "own")
    docs = docs.unionByName(odd)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if i < 4:
            assert out.columns == docs.columns
        assert out.count() > 0
        docs = out if i < 4 else docs
        assert i == 4 or stage(spark, docs.limit(0), SF).count() == 0


CUTS = {
    'password      = "hunter2secret"': "hunter2secret",
    "password\t\t\t= hunter2secret": "hunter2secret",
    "'password':   'hunter2secret'": "hunter2secret",
    'passphrase: "correct horse battery staple"': "correct horse battery staple",
    "postgres://admin:S3cr3tPw9@db.host/x": "S3cr3tPw9",
    'password="Tr0ub4dor!!!"': "Tr0ub4dor!!!",
    "password = Tr0ub4dor99.": "Tr0ub4dor99",
    'token = "abc\'def.ghi-123"': "abc'def.ghi-123",
    "see password: 'it is 5 o clock'": "it is 5 o clock",
}


def test_secret_candidates_are_whole(spark):
    docs = spark.createDataFrame(list(enumerate(CUTS)), "doc_id long, text string")
    got = {r["doc_id"]: r["candidate"] for r in secrets_scan.candidates(docs).where("nth = 0").collect()}
    assert got == dict(enumerate(CUTS.values()))
