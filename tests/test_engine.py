"""The engine end to end on a hand-made catalog and corpus."""

import datetime as dt

from lorewell.engine import Engine
from lorewell.plans import catalogue

DOC = "title string, source string, url string, character string, category string, file string, content string"


def test_engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path), catalogue.chars(spark))
    docs = spark.createDataFrame([("诗", "集", "", "李白", "poem", "a", "床前明月光"), ("论", "集", "", "孔子", "biography", "b", "学而时习之"), ("史", "记", "", "秦始皇", "biography", "c", "统一六国")], DOC)
    assert e.count() == 0 and e.ensure(docs) == 3 and e.add_documents(docs) == 0 and e.count() == 3
    assert [r["title"] for r in e.search("统一六国", 1).collect()] == ["史"]
    assert [r["title"] for r in e.search_by_character("x", "孔子").collect()] == ["论"]
    assert e.search_by_category("x", "biography").count() == 2
    assert e.retrieve("明月", "李白").collect()[0]["title"] == "诗" and e.retrieve("明月", "杜甫").count() == 3
    assert e.by_dynasty().collect()[0]["dynasty"] == "春秋" and e.names().count() == 6 and e.profile("秦始皇").count() == 2
    assert e.kpis().first().asDict() == {"characters": 6, "dynasties": 5, "chunks": 3}
    ask = lambda t: e.chat(spark.createDataFrame([("s1", "李白", t), ("s2", "无名", t)], "conv_id string, name string, text string")).collect()
    first = ask("你好")
    assert [r["conv_id"] for r in first] == ["s1"] and first[0]["reply"].startswith("[史料1] 来源: 集 - 诗")
    ask("再来")
    assert [r["turn"] for r in e.history("s1").orderBy("turn").collect()] == [0, 1, 2, 3] and e.history("s2").count() == 0
    assert e.history_text("s1").first()["history"].startswith("用户: 你好\n我: ")
    assert "### 🎭 李白" in e.export_markdown("s1", "李白", dt.datetime(2024, 1, 2)).first()["markdown"]
    e.clear("s1")
    assert e.history("s1").count() == 0
    ask("三")
    assert e.history("s1").count() == 2
    e.generator = lambda m: 1 / 0
    assert ask("败")[0]["reply"] is None and e.history("s1").count() == 2
    e.clear_all()
    assert e.messages().count() == 0
    e.clear_index()
    assert e.count() == 0


def test_engine_with_a_ledger(spark, tmp_path):
    """A call of chat that is repeated gets its replies from the ledger: memory grows, the generator is not called again."""
    calls = tmp_path / "calls"
    calls.mkdir()

    def generator(messages):
        import uuid

        (calls / uuid.uuid4().hex).touch()
        return messages[-1]["content"] + "!"

    e = Engine(spark, str(tmp_path / "home"), catalogue.chars(spark), generator=generator, replies_once=True)
    e.ensure(spark.createDataFrame([("诗", "集", "", "李白", "poem", "a", "床前明月光")], DOC))
    asked = spark.createDataFrame([("s1", "李白", "你好"), ("s2", "李白", "你好")], "conv_id string, name string, text string")
    assert [r["reply"] for r in e.chat(asked).collect()] == ["你好!", "你好!"] and len(list(calls.iterdir())) == 1
    e.clear_all()
    assert [r["reply"] for r in e.chat(asked).collect()] == ["你好!", "你好!"] and len(list(calls.iterdir())) == 1
    assert e.history("s1").count() == 2
