"""The formats against the directory scan and the page reader; filters reach the source."""

from pyspark.sql import functions as F

from lorewell.session import table
from lorewell.sources import datasource, files
from tests.conftest import SF


def kept_above(df):
    """The filters that are left above the scan."""
    return [line for line in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Filter " in line]


def test_documents(spark, tmp_path, monkeypatch):
    for name, text in {"a.txt": "one", "b.MD": "two\nlines", "c.csv": "no", "sub/d.html": "<p>x</p><p>y</p>", "sub/e.docx": "broken", "f": "none"}.items():
        at = tmp_path / name
        at.parent.mkdir(exist_ok=True)
        at.write_text(text)
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe")
    datasource.register(spark)
    monkeypatch.setattr(datasource, "PARTITION_BYTES", 5)
    got = spark.read.format("lorewell_documents").load(str(tmp_path))
    short = lambda c: F.substring_index(c, "/", -1)
    rows = sorted(map(str, got.select("content", "page", short("source").alias("f"), "error").collect()))
    want = files.load_directory(spark, str(tmp_path)).select("content", "page", short("source_file").alias("f"), "error")
    assert rows == sorted(map(str, want.collect())) and len(rows) == 5
    # an empty file is a document here; Spark's own file sources pass it over
    (tmp_path / "g.txt").write_text("")
    got = spark.read.format("lorewell_documents").load(str(tmp_path))
    texts = got.where("suffix IN ('.txt', '.md') AND error IS NULL")
    assert sorted(r["content"] for r in texts.collect()) == ["", "one", "two\nlines"]
    assert not any(".txt" in line for line in kept_above(texts))
    assert got.where("suffix = '.csv'").count() == 0 and got.where(F.col("suffix") == ".TXT").count() == 0


def test_pages(spark):
    datasource.register(spark)
    pages = table(spark, SF, "pages")
    got = spark.read.format("lorewell_pages").load(f"{SF}/pages.parquet")
    want = files.load_urls(pages).select("content", F.col("source_url").alias("url"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    urls = [r["url"] for r in pages.select("url").distinct().orderBy("url").limit(2).collect()]
    some = got.where(F.col("url").isin(urls))
    assert sorted(map(str, some.collect())) == sorted(map(str, want.where(F.col("url").isin(urls)).collect()))
    assert not any(urls[0] in line for line in kept_above(some))
    assert got.where("url = 'nowhere'").count() == 0


def test_readers_of_ones_own(spark, tmp_path):
    (tmp_path / "a.rows").write_text("x|y")
    files.register(".rows", lambda content: content.decode().split("|"))
    try:
        datasource.register(spark)
        got = spark.read.format("lorewell_documents").load(str(tmp_path)).orderBy("page").collect()
        assert [(r["content"], r["page"], r["suffix"]) for r in got] == [("x", 0, ".rows"), ("y", 1, ".rows")]
    finally:
        del files.READERS[".rows"]
