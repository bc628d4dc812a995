"""The splitter as expressions against the one in Python."""

import random

import pyarrow as pa
import pytest

from lorewell.functions.splitter import split_columns
from lorewell.functions.text import slices, split_documents, split_text
from lorewell.session import table
from tests.conftest import SF


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_equals_python_on_all_documents(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    assert rows(split_columns(docs, "text")) == rows(split_documents(docs, "text"))


@pytest.mark.parametrize(("size", "overlap"), [(2, 0), (5, 2), (12, 5), (30, 29)])
def test_equals_python_on_made_texts(spark, size, overlap):
    rng = random.Random(size)
    signs = ["a", "b", "é", "😀", "中", " ", " ", "\n", "\n\n", "。", ".", "!", "？", "\t", "word", "longer word"]
    texts = ["", None, " ", "\n\n\n", "x" * 100] + ["".join(rng.choice(signs) for _ in range(rng.randrange(80))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, content string").selectExpr("id", "content", "map('k', id) AS _items")
    want = sorted((i, c, n) for i, t in enumerate(texts) if t for n, c in enumerate(split_text(t, size, overlap)))
    out = split_columns(df, "content", size, overlap)
    assert sorted((r["id"], r["content"], r["chunk_id"]) for r in out.collect()) == want
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString() and split_columns(df.limit(0)).count() == 0


def test_refuses_what_it_cannot_close(spark):
    with pytest.raises(ValueError, match="empty"):
        split_columns(spark.createDataFrame([("a",)], "content string"), separators=["\n"])


def test_python_holds_a_slice_at_once(spark):
    texts = ["a b " * 50, None, "", "词。" * 3_000, *["x" * 600] * 2_500]
    got = list(slices(pa.array(texts), 20_000, 1_000))
    assert [t for s in got for t in s.to_pylist()] == texts and not list(slices(pa.array([], pa.string())))
    sizes = [sum(len((t or "").encode()) for t in s.to_pylist()) for s in got]
    assert all(n <= 20_000 for n in sizes) and max(len(s) for s in slices(pa.array(texts), 1 << 30)) == 1_000
    assert [len(s) for s in slices(pa.array(["long", "longer", "l"]), 3)] == [1, 1, 1]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, content string").coalesce(1)
    want = sorted((i, c, n) for i, t in enumerate(texts) if t for n, c in enumerate(split_text(t)))
    assert sorted((r["id"], r["content"], r["chunk_id"]) for r in split_documents(df).collect()) == want
