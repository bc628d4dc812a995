"""The registered queries against DuckDB where SQL can express them, and the pipeline stage by stage."""

import pytest

import corpus_pipeline
from lorewell.llm import registry
from lorewell.session import table
from tests.conftest import SF
from tests.oracle import compare, connect


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, name):
    compare(registry.queries()[name](spark, SF), connect(SF), registry.oracle_sql()[name])


def test_names():
    assert {f"op{n}" for n in range(1, 14)} | {"pipeline"} == {k.split("_")[0] for k in registry.queries()}
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontaminate", "mix_sources", "shard"]


def test_pipeline_by_stage(spark, tmp_path):
    """Each stage on what its predecessor kept, against a plain version of what it is to do."""
    import re
    from collections import Counter, defaultdict

    from tests.llm.test_ops_small import shingle_bag

    docs = table(spark, SF, "documents")
    kept = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        assert i == 4 or out.columns == table(spark, SF, "documents").columns
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        kept.append(docs.collect())
    before = table(spark, SF, "documents").collect()
    # language: every document with a letter is of a clear language here
    assert {r["doc_id"] for r in kept[0]} == {r["doc_id"] for r in before if re.search(r"[^\W\d_]", r["text"])}
    # near-duplicates: one of each connected class, by all pairs that share a shingle
    bags = {r["doc_id"]: shingle_bag(r["text"]) for r in kept[0]}
    holders, root = defaultdict(list), {d: d for d in bags}
    for d in sorted(bags):
        for s in bags[d]:
            holders[s].append(d)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for d, bag in bags.items():
        shared = Counter()
        for s, n in bag.items():
            for e in holders[s]:
                if e > d:
                    shared[e] += min(n, bags[e][s])
        for e, n in shared.items():
            if n / (sum(bag.values()) + sum(bags[e].values()) - n) >= 0.8:
                x, y = sorted((find(d), find(e)))
                root[y] = x
    assert {r["doc_id"] for r in kept[1]} == {find(d) for d in bags}
    # benchmark: exactly the documents that contain an item, case and punctuation aside
    plain = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    items = [plain(r["text"]) for r in table(spark, SF, "benchmark").collect()]
    assert {r["doc_id"] for r in kept[2]} == {r["doc_id"] for r in kept[1] if not any(i in plain(r["text"]) for i in items)}
    # mix: whole copies, twice at most
    times = Counter(r["doc_id"] for r in kept[3])
    assert set(times) <= {r["doc_id"] for r in kept[2]} and max(times.values()) <= 2
    # shards: every row once, gapless slots, near equal bytes
    assert Counter(r["doc_id"] for r in kept[4]) == times
    slots, size = defaultdict(list), Counter()
    for r in kept[4]:
        slots[r["shard"]].append(r["slot"])
        size[r["shard"]] += r["size"]
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and len(slots) == 24
    assert max(size.values()) - min(size.values()) <= 4 * max(r["size"] for r in kept[4])
