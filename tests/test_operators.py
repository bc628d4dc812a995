"""Properties and goldens of the operators, and the stream against the batch form."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorewell.functions.embed import embed, hashed_ngrams
from lorewell.operators import chat, context, export, index, knn, memory
from lorewell.plans import catalogue
from lorewell.session import table
from lorewell.streaming.memory import memory_stream
from tests.conftest import SF


@pytest.fixture(scope="module")
def vectors(spark):
    return table(spark, SF, "embeddings").cache()


def test_topk_properties(vectors):
    q = vectors.where("vec_id = 7").select("embedding")
    rows = knn.topk(vectors, q, 5, {"label": 2}).orderBy("rank").collect()
    assert len(rows) == 5 and all(r["label"] == 2 for r in rows) and [r["rank"] for r in rows] == [1, 2, 3, 4, 5]
    assert [r["score"] for r in rows] == sorted(r["score"] for r in rows)
    assert knn.topk(vectors.limit(3), q, 10).count() == 3 and knn.topk(vectors, q, 5, {"label": -1}).count() == 0


def test_fallback_only_without_hits(vectors):
    q = vectors.where("vec_id = 7").select("embedding")
    few = vectors.where("label <> 3 or vec_id < 40")
    hit = knn.topk_with_fallback(few, q, 50, {"label": 3}).collect()
    assert hit and len(hit) < 50 and not any(r["fallback"] for r in hit)
    missed = knn.topk_with_fallback(vectors, q, 3, {"label": -1})
    assert missed.count() == 3 and all(r["fallback"] for r in missed.collect())


def test_batch_fallback(vectors):
    queries = vectors.where("vec_id < 3").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.when(F.col("vec_id") == 1, -1).otherwise(F.col("label")).alias("label"))
    got = knn.batch_topk_with_fallback(vectors, queries, 3, by=["label"]).collect()
    assert len(got) == 9 and all(r["fallback"] == (r["query_id"] == 1) for r in got)


def test_persona(spark):
    got = {r["name"]: r["prompt"] for r in catalogue.chars(spark).select("name", context.persona_prompt().alias("prompt")).collect()}
    assert got["李白"].startswith("你现在扮演中国历史人物【李白】。\n\n## 人物信息\n- 朝代：唐朝\n") and '"天生我材必有用"' in got["李白"] and "- 唐诗\n" in got["李白"]


def test_citation_defaults(spark):
    rows = spark.createDataFrame([(1, None, "", None, None, "c")], "rank int, title string, source string, url string, character string, content string")
    r = context.citations(rows).first()
    assert (r["title"], r["source"], r["url"], r["character"]) == ("未知", "", "", "")
    assert context.evidence(context.citations(rows), []).first()[0] == "[史料1] 来源:  - 未知\nc"


def test_memory_bound(spark):
    rows = [("s", t, "user" if t % 2 == 0 else "system", f"m{t}") for t in range(11)] + [("e", 0, None, None)]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    assert sorted(r["turn"] for r in memory.last_n(df, 10).where("conv_id = 's'").collect()) == list(range(1, 11))
    last = memory.as_of(df, 10).where("conv_id = 's' and turn = 10").first()["history"]
    assert [m["content"] for m in last] == [f"m{t}" for t in range(10)] and last[1]["role"] == "assistant"
    assert memory.after_clear(df, F.col("turn") == 4).where("conv_id = 's'").count() == 6


def test_markdown(spark):
    rows = spark.createDataFrame([(1, 0, "user", "问", []), (1, 1, "assistant", "答", ["t1", None])], "c int, turn int, role string, text string, titles array<string>")
    info = F.struct(F.lit("唐朝").alias("dynasty"), F.lit(None).cast("string").alias("title"), F.lit("701").alias("years"))
    text = export.markdown(rows, "c", "turn", F.lit("李白"), F.lit("2024-01-02 03:04:05").cast("timestamp"), info, "titles").first()["markdown"]
    assert text == "# 与李白的对话\n\n**导出时间**: 2024-01-02 03:04:05\n\n## 人物信息\n\n- **朝代**: 唐朝\n- **身份**: 未知\n- **生卒年**: 701\n\n## 对话记录\n\n---\n\n### 👤 用户\n\n问\n\n---\n\n### 🎭 李白\n\n答\n\n*参考资料*: t1 | 未知\n\n---\n\n\n*由「历史人物对话」系统生成*\n"
    pdf = export.pdf(spark.createDataFrame([("第一行\nsecond",)], "markdown string")).first()["pdf"]
    assert bytes(pdf).startswith(b"%PDF-1.4") and bytes(pdf).rstrip().endswith(b"%%EOF")


def test_embedder():
    v = hashed_ngrams(["abc", "", "abc"])
    assert np.allclose(v[0], v[2]) and not v[1].any() and abs(np.linalg.norm(v[0]) - 1) < 1e-6


def test_index_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "index")
    docs = spark.createDataFrame([("t", "百科", "", "李白", "biography", "f", "x" * 700), ("u", "百科", "", "杜甫", "biography", "g", "短")], "title string, source string, url string, character string, category string, file string, content string")
    assert index.count(spark, path) == 0 and index.ensure(spark, path, docs) == 3 and index.build(docs, path) == 3
    assert index.append(docs, path) == 0 and index.ensure(spark, path, docs.limit(0)) == 3 and index.build(docs.limit(0), path) == 0
    assert index.smoke(spark, path).count() == 6
    index.clear(spark, path)
    assert index.count(spark, path) == 0


def test_chat(spark):
    chars = catalogue.chars(spark)
    turns = spark.createDataFrame([(1, 0, "user", "你好", "李白"), (1, 1, "assistant", "好", "李白"), (1, 2, "user", "作诗", "李白"), (2, 0, "user", "x", "无名")], "conv_id long, turn long, role string, text string, name string")
    rows = spark.createDataFrame([("诗", "集", "", "李白", "床前明月光"), ("论", "集", "", "孔子", "学而")], "title string, source string, url string, character string, content string")
    idx = embed(index.chunks_of(rows), "content")
    got = {r["turn"]: r for r in chat.chat(turns, chars, idx).collect()}
    assert set(got) == {0, 2} and [m["role"] for m in got[2]["messages"]] == ["system", "user", "assistant", "user"]
    assert "[史料1] 来源: 集 - 诗" in got[2]["messages"][0]["content"] and "学而" not in got[2]["messages"][0]["content"]
    failed = chat.chat(turns, chars, idx, generator=lambda m: 1 / 0).first()
    assert failed["reply"] is None and "division" in failed["reply_error"]


def test_stream_equals_batch(spark, tmp_path):
    source = table(spark, SF, "conversations")
    source.where("turn < 3").write.parquet(str(tmp_path / "in/a"))
    source.where("turn >= 3").write.parquet(str(tmp_path / "in/b"))
    rows = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    seen = {}

    def take(batch, _):
        new = {}
        for r in batch.collect():
            new.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"]))
        seen.update(new)

    q = memory_stream(rows, 3).writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", str(tmp_path / "check")).start()
    q.processAllAvailable()
    q.stop()
    want = {}
    for r in memory.last_n(source, 3).select("conv_id", "turn", memory.normal_role(F.col("role")).alias("role"), "text").collect():
        want.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"]))
    assert {k: sorted(v) for k, v in seen.items()} == {k: sorted(v) for k, v in want.items()}


def test_entry_without_llm():
    import __spark_entry__

    assert set(catalogue.ORACLE) <= set(__spark_entry__.queries())


def test_query_blocks(vectors):
    """Queries too many to be sent out meet the index in blocks, with the same result, groups and hot groups included."""
    queries = vectors.where("vec_id % 20 = 0").select("label", F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    for by in ([], ["label"]):
        whole = sorted(knn.batch_topk(vectors, queries, 3, by=by).collect())
        assert sorted(knn.batch_topk(vectors, queries, 3, by=by, query_bytes=2_000).collect()) == whole


def test_stream_state_clears_and_evicts():
    import pandas as pd

    from lorewell.streaming.memory import remember

    class State:
        exists, value = False, None

        @property
        def get(self):
            return self.value

        def update(self, value):
            self.exists, self.value = True, value

    state, step = State(), remember(3)

    def feed(*rows):
        frame = pd.DataFrame(rows, columns=["turn", "role", "text"])
        return [(t, r, x) for f in step((7,), iter([frame]), state) for t, r, x in zip(f["turn"], f["role"], f["text"], strict=True)]

    assert feed((0, "user", "a"), (1, "assistant", "b")) == [(0, "user", "a"), (1, "assistant", "b")]
    assert feed((3, "user", "d"), (2, "system", "c")) == [(1, "assistant", "b"), (2, "assistant", "c"), (3, "user", "d")]
    assert feed((4, "clear", None)) == []
    assert feed((5, "user", "e")) == [(5, "user", "e")]
    # what comes late from before the clear stays cleared
    assert feed((2, "user", "late")) == [(5, "user", "e")]
    assert feed((6, "x", "f"), (7, "user", "g"), (8, "user", "h")) == [(6, "assistant", "f"), (7, "user", "g"), (8, "user", "h")]


def test_embedder_gets_a_slice_at_once(spark):
    texts = [None, "", "y" * 2_000_000, *[f"text {i}" for i in range(2_500)]]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").coalesce(1)
    calls = embed(df, "t", embedder=lambda ts: np.array([[len(ts), sum(map(len, ts))]] * len(ts))).collect()
    assert max(r["embedding"][0] for r in calls) <= 1_000
    assert [r["id"] for r in calls if r["embedding"][1] > 1 << 20] == [2]
    got = [r["embedding"] for r in embed(df, "t").orderBy("id").collect()]
    assert np.array_equal(np.array(got, np.float32), hashed_ngrams([t or "" for t in texts]))
