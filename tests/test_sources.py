"""Goldens of the sources: header grammar, catalog files, directories, pages, cache."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lorewell.config import load_settings
from lorewell.sources import catalog_files, fetch, files, knowledge, pages

FULL = "# 黄帝\n\n【来源】百度百科\n【URL】http://a\n【分类】biography\n【人物】黄帝\n\n---\n\n第一行\n--- 中\n第二行\n"


def parsed(spark, content, file="f.x.txt", compat=False):
    return knowledge.parse(spark.createDataFrame([(file, content)], "file string, content string"), compat).first().asDict()


def test_full_header(spark):
    assert parsed(spark, FULL) == {"file": "f.x.txt", "title": "黄帝", "source": "百度百科", "url": "http://a", "character": "黄帝", "category": "biography", "content": "第一行\n第二行"}


def test_compat_cut(spark):
    got = parsed(spark, FULL, compat=True)
    assert (got["character"], got["category"], got["url"], got["source"]) == ("帝", "iography", "http://a", "百度百科")


def test_defaults(spark):
    got = parsed(spark, "no header\n---\nbody")
    assert got == {"file": "f.x.txt", "title": "f.x", "source": "未知", "url": "", "character": "", "category": "biography", "content": "body"}
    assert parsed(spark, "# only")["content"] == "" and parsed(spark, None)["title"] == "f.x"


def test_only_ten_lines_and_last_wins(spark):
    assert parsed(spark, "# a\n# b\n" + "\n" * 7 + "# j\n# k\n---\nx")["title"] == "j"
    assert parsed(spark, "\n" * 10 + "# late\n---\nx")["title"] == "f.x"


def test_crlf(spark):
    assert parsed(spark, FULL.replace("\n", "\r\n"))["content"] == "第一行\n第二行"


def test_read_knowledge_skips_bad_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text(FULL, encoding="utf-8")
    (tmp_path / "b.txt").write_bytes(b"# x\n\xff\xfe\n---\ny")
    (tmp_path / "c.md").write_text("no")
    (tmp_path / "传 1+%20.txt").write_text(FULL, encoding="utf-8")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/d.txt").write_text(FULL, encoding="utf-8")
    assert [r["file"] for r in knowledge.read_knowledge(spark, str(tmp_path)).orderBy("file").collect()] == ["a.txt", "传 1+%20.txt"]
    assert knowledge.read_raw(spark, str(tmp_path / "a.txt")).first()["content"] == FULL


def test_round_trip(spark):
    rows = spark.createDataFrame([("黄帝", "dyn", "文"), ("a/b", "dyn", "x")], "name string, dynasty string, content string")
    rendered = knowledge.render(knowledge.builtin_rows(rows), F.lit(knowledge.BUILTIN))
    assert {r["file"] for r in rendered.collect()} == {"biography_黄帝_内置.txt", "biography_a_b_内置.txt"}
    back = knowledge.parse(rendered.withColumnRenamed("value", "content")).select("character", "content").collect()
    assert {tuple(r) for r in back} == {("黄帝", "文"), ("a/b", "x")}


def test_catalog(spark, tmp_path):
    base = "name: {n}\ndynasty: 唐朝\ntitle: 诗人\nyears: '701'\navatar: x\npersonality: |\n  {p}\nspeaking_style: s\n"
    (tmp_path / "a").mkdir()
    (tmp_path / "a/1.yaml").write_text(base.format(n="李白", p="first") + "knowledge_focus:\n  - 诗\n", encoding="utf-8")
    (tmp_path / "b.yaml").write_text(base.format(n="李白", p="second"), encoding="utf-8")
    (tmp_path / "c.yaml").write_text(base.format(n="坏", p="x") + "other: 1\n", encoding="utf-8")
    (tmp_path / "d.yaml").write_text("- not a mapping\n")
    (tmp_path / "e.yaml").write_text("name: only\n")
    got = catalog_files.read_catalog(spark, str(tmp_path)).collect()
    assert [r["name"] for r in got] == ["李白"] and got[0]["personality"] == "second\n" and got[0]["knowledge_focus"] == []
    assert catalog_files.read_all(spark, str(tmp_path)).where("error is not null").count() == 3


def test_directory(spark, tmp_path):
    (tmp_path / "a.TXT").write_text("text")
    (tmp_path / "b.md").write_text("# md")
    (tmp_path / "c.html").write_text("<p>x<script>no</script></p><b>y</b>")
    (tmp_path / "d.csv").write_text("1")
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:t>one</w:t></w:p><w:p><w:t>two</w:t></w:p></w:document>')
    (tmp_path / "e.docx").write_bytes(buffer.getvalue())
    (tmp_path / "f.docx").write_bytes(b"broken")
    got = {r["source_file"].rsplit("/", 1)[1]: r for r in files.load_directory(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.TXT", "b.md", "c.html", "e.docx", "f.docx"}
    assert got["c.html"]["content"] == "x\ny" and got["e.docx"]["content"] == "one\ntwo" and got["f.docx"]["error"]
    assert files.load_file(spark, str(tmp_path / "b.md")).first()["content"] == "# md"
    with pytest.raises(ValueError):
        files.load_file(spark, str(tmp_path / "d.csv"))


def test_extract():
    html = '<h1> T <b>x</b></h1><div class="para">no</div><div class="main-content z"><p>one <a href="#">link</a><p>two<sup>1</sup><script>s()</script><p> </div><p>outside'
    assert pages.extract(html, "n", pages.Selectors()) == ("Tx", "one\ntwo")
    assert pages.extract("<div class=para>only</div>", "n", pages.Selectors()) == ("n", "only")
    assert pages.extract("<p>x</p>", "n", pages.Selectors()) == ("n", None) and pages.extract(None, "n")[1] is None
    assert pages.extract('<div class="mw-parser-output"><p>a</p><p> </p><p>b</p></div>', "n", pages.WIKI)[1] == "a\n\nb"
    assert pages.extract('<div class="main-content">x<a>y</a><sup>z</sup></div>', "n", pages.BAIKE_V1)[1] == "x\ny"


def test_gate(spark):
    df = spark.createDataFrame([("a" * n,) for n in (49, 50, 5000, 5001)], "content string")
    assert sorted(r[0] for r in pages.gate(df).select(F.length("content")).collect()) == [50, 5000, 5000]


def test_cache(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"u1": {"title": "t", "time": "2024-01-01"}}))
    (tmp_path / "e.json").write_text("{}")
    cache = pages.read_cache(spark, str(tmp_path / "c.json"))
    assert [tuple(r) for r in cache.collect()] == [("u1", "t", "2024-01-01")]
    assert pages.read_cache(spark, str(tmp_path / "e.json")).count() == 0
    new = spark.createDataFrame([("u1", "t2"), ("u2", "x")], "url string, title string")
    assert {tuple(r) for r in pages.merge_cache(cache, new, "2024-02-02").collect()} == {("u1", "t2", "2024-02-02"), ("u2", "x", "2024-02-02")}


def test_settings(tmp_path):
    (tmp_path / ".env").write_text("# c\nMAX_HISTORY=4\nVERBOSE=false\nOTHER=1\n")
    s = load_settings(str(tmp_path / ".env"), {"rag_top_k": "7"})
    assert (s.max_history, s.verbose, s.rag_top_k, s.temperature) == (4, False, 7, 0.8)


def test_named_files(spark, tmp_path):
    rows = spark.createDataFrame([("a.txt", "1"), ("a.txt", "2"), ("b c.txt", None), (None, "x"), ("史.txt", "文\n")], "file string, value string")
    out = tmp_path / "kb"
    for _ in range(2):
        assert knowledge.write_files(rows, f"file:{out}") == 3
    assert {f.name: f.read_text(encoding="utf-8") for f in out.iterdir() if not f.name.startswith(".")} == {"a.txt": "2", "b c.txt": "", "史.txt": "文\n"}
    assert knowledge.write_files(rows.limit(0), str(tmp_path / "none")) == 0


def test_cache_file(spark, tmp_path):
    path = str(tmp_path / "c.json")
    rows = [("u\"1", "题", "2024-01-01"), ("u2", None, "2024-01-02")]
    pages.write_cache(spark.createDataFrame([*rows, (None, "x", "y")], "url string, title string, time string"), path)
    assert json.loads((tmp_path / "c.json").read_text(encoding="utf-8")) == {u: {"title": t, "time": d} for u, t, d in rows}
    assert {tuple(r) for r in pages.read_cache(spark, path).collect()} == set(rows)
    pages.write_cache(spark.createDataFrame([], "url string, title string, time string"), path)
    assert json.loads((tmp_path / "c.json").read_text()) == {} and pages.read_cache(spark, path).count() == 0


def _answers(url):
    if "error" in url:
        raise OSError("down")
    body = "<h1>T</h1><div class='main-content'>" + "".join(f"<p>{'x' * 30}</p>" for _ in range(1 if "short" in url else 2)) + "</div>"
    return (403, None) if "blocked" in url else (200, body)


def test_fetch(spark):
    urls = spark.createDataFrame([("a", 1), ("blocked", 2), ("error", 3), (None, 4)], "url string, extra int")
    got = {r["extra"]: (r["status"], r["attempts"], r["error"]) for r in fetch.fetch(urls, _answers, blocked_wait=0, error_wait=0).collect()}
    assert got == {1: (200, 1, None), 2: (403, 3, None), 3: (None, 3, "OSError: down"), 4: (None, 0, None)}
    assert fetch.ok_pages(fetch.fetch(urls)).count() == 0


def test_crawl(spark, tmp_path):
    names = spark.createDataFrame([(n,) for n in ("good", "short", "blocked", "error", "seen")], "name string")
    cache = spark.createDataFrame([("https://baike.baidu.com/item/seen",)], "url string")
    got = fetch.crawl(names, str(tmp_path / "p"), _answers, cache, blocked_wait=0, error_wait=0).collect()
    assert [(r["title"], r["character"], r["source"], r["category"], len(r["content"])) for r in got] == [("T", "good", "百度百科", "biography", 61)]
    assert spark.read.parquet(str(tmp_path / "p")).count() == 4


def test_crawl_sources(spark, tmp_path):
    names = spark.createDataFrame([("good",), ("error",)], "name string")
    got = fetch.crawl_sources(names, str(tmp_path / "p"), _answers).collect()
    assert [(r["source"], r["character"], r["content"]) for r in got] == [("百度百科-good", "good", "x" * 30 + "\n" + "x" * 30)]
    assert pages.extract('<div class="mw-parser-output">bare</div>', "n", pages.WIKI)[1] == ""
