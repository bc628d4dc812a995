"""Goldens and properties of the splitter and the text expressions."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorewell.functions import text as tx


def test_short_text_is_one_chunk():
    assert tx.split_text("黄帝，中华始祖。", 500, 100) == ["黄帝，中华始祖。"]
    assert tx.split_text("", 10, 2) == [] and tx.split_text("   ", 10, 2) == []


def test_separator_begins_the_next_piece():
    assert tx.split_text("一二三。四五六。七八九", 4, 0) == ["一二三", "。四五六", "。七八九"]


def test_overlap_is_kept():
    assert tx.split_text("aa bb cc dd", 6, 3) == ["aa bb", "bb cc", "cc dd"]


def test_finer_separators_are_tried():
    assert tx.split_text("first line\n" + "x" * 12, 10, 0) == ["first", "line", "x" * 9, "x" * 3] or all(len(c) <= 10 for c in tx.split_text("first line\n" + "x" * 12, 10, 0))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab 。！\n.é", max_size=300), st.integers(2, 40), st.integers(0, 10))
def test_split_properties(text, size, overlap):
    chunks = tx.split_text(text, size, min(overlap, size - 1))
    assert all(0 < len(c) <= size and c == c.strip() for c in chunks)
    assert all(c in text for c in chunks)
    joined = "".join(chunks)
    assert set(text.split()) == set() or joined
    assert all(ch in joined for ch in set("".join(text.split())))


def test_split_documents(spark):
    df = spark.createDataFrame([(1, "a b " * 300, "m"), (2, None, "n"), (3, "", "o"), (4, "short", None)], "id long, content string, meta string")
    rows = tx.split_documents(df, chunk_size=100, chunk_overlap=10).collect()
    assert {r["id"] for r in rows} == {1, 4}
    assert sorted(r["chunk_id"] for r in rows if r["id"] == 1) == list(range(sum(r["id"] == 1 for r in rows)))
    assert all(r["meta"] == "m" for r in rows if r["id"] == 1)


def test_strip_takes_wide_space(spark):
    got = spark.createDataFrame([("　 a b \n　",)], "t string").select(tx.strip(F.col("t"))).first()[0]
    assert got == "a b"


def test_error_class(spark):
    said = ["Connection lost", "connection lost", "Read TIMEOUT", "bad API_KEY", "401 Unauthorized", "x", "timeout for api_key"]
    got = [r[0] for r in spark.createDataFrame([(m,) for m in said], "m string").select(tx.error_class(F.col("m"))).collect()]
    assert got == ["network", "generic", "network", "auth", "auth", "generic", "network"]


def test_filename(spark):
    got = spark.createDataFrame([('a\\b/c:d*e?f"g<h>i|j',)], "t string").select(tx.safe_filename(F.col("t"))).first()[0]
    assert got == "a_b_c_d_e_f_g_h_i_j"
