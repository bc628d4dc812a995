"""Operator 12 against plain loops over all entries."""

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from lorewell.llm.product_codes import MOST, VAFile, decode, encode, learn, op12_va_codes
from lorewell.session import table
from tests.conftest import SF


def plain(rows, parts=4, entries=256, rounds=4):
    """rows of (key, label, components) by the definition: {key: (code, error)}, label sums, digest."""
    kept = [(k, label, [math.floor(1024 * x) for x in v]) for k, label, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    d = len(kept[0][2]) // parts
    x = np.array([v for _, _, v in kept])
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0))
    books = [x[order[:entries], p * d : (p + 1) * d] for p in range(parts)]

    def assign(p):
        part = x[:, p * d : (p + 1) * d]
        far = ((part[:, None, :] - books[p][None]) ** 2).sum(2)
        return part, far.argmin(1), far.min(1)

    for _ in range(rounds):
        for p in range(parts):
            part, near, _ = assign(p)
            books[p] = np.array([part[near == e].sum(0) // (near == e).sum() if (near == e).any() else books[p][e] for e in range(len(books[p]))])
    found = [assign(p) for p in range(parts)]
    code = ["".join(f"{int(found[p][1][i]):02x}" for p in range(parts)) for i in range(len(kept))]
    error = [int(sum(found[p][2][i] for p in range(parts))) for i in range(len(kept))]
    by_label = defaultdict(int)
    for (_, label, _), e in zip(kept, error, strict=True):
        by_label[label] += e
    text = ",".join(str(v) for b in books for row in b.tolist() for v in row)
    return sorted((repr(k), c, e, by_label[label], hashlib.sha256(text.encode()).hexdigest()) for (k, label, _), c, e in zip(kept, code, error, strict=True))


def got(df):
    return sorted((repr(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in df.collect())


def test_embeddings(spark):
    rows = [(r["vec_id"], r["label"], r["embedding"]) for r in table(spark, SF, "embeddings").collect()]
    assert got(op12_va_codes(spark, SF)) == plain(rows)


@pytest.mark.parametrize("n", [3, 400])
def test_nulls_ties_and_repeats(spark, tmp_path, n):
    rng = np.random.default_rng(n)
    rows = [(i, int(i) % 3 or None, [float(v) for v in rng.integers(-2, 3, 8) / 1024]) for i in range(n)]
    rows += [rows[1], rows[1], (None, 1, rows[2][2]), (n + 1, 1, None), (n + 2, 1, [1.0, None] * 4), (n + 3, 1, [1.0, float("nan")] * 4), (n + 4, 1, [1.0, float("-inf")] * 4), (n + 5, None, [1e9] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(3)
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    rows = [(k, label, v if v is None or v[0] < 1e6 else [MOST / 1024] * 8) for k, label, v in rows]
    assert got(op12_va_codes(spark, str(tmp_path))) == plain(rows)


def test_other_lengths_and_columns(spark):
    rows = [(1, [0.5] * 6, "a"), (2, [0.25] * 3, "b"), (3, [], "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, code string").selectExpr("*", "map('k', 1) AS error")
    books = learn(df)
    assert books.shape == (4, 3, 2)
    out = {r["vec_id"]: r for r in encode(df, books).collect()}
    assert {k: r["code"] for k, r in out.items()} == {1: "a", 2: "b", 3: "c"} and all(r["error_"] == 0 and r["error"] == {"k": 1} for r in out.values())
    assert decode(out[2]["code_"], books).tolist() == [0.25, 0.25, 0.25, 0, 0, 0, 0, 0]
    assert learn(df.limit(0)).size == 0 and encode(df.limit(0), learn(df.limit(0))).count() == 0


def test_filter_leaves_few(spark):
    x = np.array([[math.floor(1024 * v) for v in r["embedding"]] for r in table(spark, SF, "embeddings").collect()])[:, :16]
    for bits in (1, 2, 4):
        f = VAFile(x[:100], bits)
        entry, distance = f.nearest(x)
        far = ((x[:, None] - x[None, :100]) ** 2).sum(2)
        assert (entry == far.argmin(1)).all() and (distance == far.min(1)).all()
        low, high = f.bounds(x)
        assert (low <= far).all() and (far <= high).all()
    assert f.compared < 25 * len(x)
