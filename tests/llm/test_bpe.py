"""Operator 13 against the tokenizers library, id by id."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lorewell.llm import bpe
from lorewell.llm.bpe import Encoder, Vocabulary, decode_documents, encode_documents, op13_bpe
from lorewell.session import table
from tests.conftest import SF

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "a" * 5000, "ab" * 3000 + "<|endoftext|>  x", "<|endoftext|><|endoftext|>", "don't 's''s  \n\n  x 'll'LL \t\x1c\x1d a", " 　  x y", "<|endoftext", "  ", "a ", "\r\n\r\n a"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary.read(PATH)


def of(encoder, text):
    return np.frombuffer(encoder.encode([text])[0], "<u4").tolist()


def made(n, seed):
    """Texts of letters, digits, marks and white space of many scripts, newer signs than the library knows among them."""
    rng = random.Random(seed)
    signs = ["a", "b", "e", "é", "中", "1", "٣", " ", "  ", "\n", "'", "s", "!", "😀", "́", "\x85", "\x00", "<|endoftext|>", "the ", "and"]
    for _ in range(n):
        yield "".join(rng.choice([*signs, chr(rng.randrange(0x20, 0xD7FF)), chr(rng.randrange(0x10000, 0x110000)), chr(0x323B0 + rng.randrange(4000))]) for _ in range(rng.randrange(300)))


def test_equals_library(vocabulary, library):
    encoder = Encoder(vocabulary)
    for text in [*ODD, *made(400, 1)]:
        want = library.encode(text, add_special_tokens=False).ids
        assert of(encoder, text) == want
        assert encoder.decode(encoder.encode([text])[0]) == library.decode(want, skip_special_tokens=False)


def test_slices_change_nothing(vocabulary, monkeypatch):
    texts = ["".join(made(40, 2)) * 2, *ODD]
    want = Encoder(vocabulary).encode(texts)
    monkeypatch.setattr(bpe, "SLICE", 50)
    monkeypatch.setattr(bpe, "REMEMBERED", 5_000)
    assert [Encoder(vocabulary).encode([t])[0] for t in texts] == want == Encoder(vocabulary).encode(texts)


def test_cuts_are_certain(vocabulary):
    """No token of the merges holds a pair of bytes that forces a cut."""
    encoder = Encoder(vocabulary)
    for i in vocabulary.merges[:, 2].tolist():
        t = np.frombuffer(vocabulary.tokens[i], np.uint8)
        assert encoder.inside[t[:-1], t[1:]].all()
    q, x = b"qX"
    assert not encoder.inside[q, x]


def test_documents(spark, library):
    rows = {r["doc_id"]: r for r in op13_bpe(spark, SF).collect()}
    import hashlib

    docs = table(spark, SF, "documents").collect()
    assert len(rows) == len(docs)
    for r in docs:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        got = rows[r["doc_id"]]
        assert got["n_tokens"] == len(ids) and got["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()


def test_edge_cases(spark):
    rows = [(1, None, "x"), (1, None, "x"), (None, "", None), (3, "word " * 200_000, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tokens string").selectExpr("*", "map('a', 1) AS decoded_")
    out = decode_documents(encode_documents(docs, PATH), PATH)
    got = sorted(((r["doc_id"] or 0, len(r["ids"]), r["decoded"]) for r in out.collect()))
    assert [g[:2] for g in got] == [(0, 0), (1, 0), (1, 0), (3, 4 * 200_001)] and got[-1][2] == "word " * 200_000 and "decoded_" in out.columns
    assert encode_documents(docs.limit(0), PATH).count() == 0
