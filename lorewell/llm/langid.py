"""Language identification: words first, then ever shorter character n-grams (operator 10).

Words are runs of letters, in small letters. Texts are worked on as arrays of code points, many at once; a word or n-gram is a
64-bit hash of its code points.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorewell.llm.common import ODD, arrow_text, mix, release, text_batches, text_slices

#: Bounds of the labelled sample: so many distinct texts of each language; and of the model: so many words, and n-grams of an
#: order, of each language, the most frequent ones.
PER_LANG, TOKENS = 600, 100_000
#: n-gram orders, tried in this order for a word that training did not see.
ORDERS = (4, 3, 2, 1)
#: A document's confidence rests on at most so many words' worth of evidence.
EVIDENCE_WORDS = 20.0
UND = "und"
LEAST_SEEN = 3
#: Bytes of text that are worked on together.
SLICE = 256 << 10
#: Code points up to here are looked up; above, the ideographs to CJK_END are letters.
TABLE, CJK_END = 0x20000, 0x323B0


@cache
def small_letters() -> np.ndarray:
    """For every code point of the table its small letter, 0 for what is no letter."""
    out = np.zeros(TABLE, np.uint32)
    for c in range(TABLE):
        if (x := chr(c)).isalpha():
            out[c] = ord(x.lower()[0])
    return out


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2 ** 64."""
    base = int(ODD)
    both = []
    for x in (base, pow(base, -1, 1 << 64)):
        p = np.full(n, x, np.uint64)
        p[0] = 1
        both.append(np.cumprod(p, dtype=np.uint64))
    return both[0], both[1]


@cache
def usual_powers() -> tuple[np.ndarray, np.ndarray]:
    return powers(SLICE + (1 << 16))


class Stretch:
    """Some texts as one array of small letters, 0 between words and texts; words has the start and end of each word, docs its
    text. Any run of the array has a hash."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        raw = data.tobytes()
        n = len(offsets) - 1
        try:
            points = np.frombuffer(raw.decode().encode("utf-32-le"), "<u4")
            chars = np.diff(np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets])
        except UnicodeDecodeError:
            texts = [raw[a:b].decode(errors="replace") for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)]
            points, chars = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4"), np.array([len(t) for t in texts])
        low = small_letters()[np.minimum(points, TABLE - 1)]
        if len(points) and points.max() >= TABLE:
            far = points >= TABLE
            low[far] = np.where(points[far] < CJK_END, points[far], 0)
        full = np.zeros(len(points) + n + 1, np.uint32)
        doc = np.repeat(np.arange(n), chars)
        full[np.arange(len(points)) + doc + 1] = low
        inside = (full > 0).view(np.int8)
        step = np.diff(inside)
        self.starts, self.ends = np.flatnonzero(step == 1) + 1, np.flatnonzero(step == -1) + 1
        self.docs = np.searchsorted(np.cumsum(chars) + np.arange(1, n + 1), self.starts, side="left")
        usual = usual_powers()
        power, self.inverse = usual if len(full) <= len(usual[0]) else powers(len(full))
        self.sums = np.zeros(len(full) + 1, np.uint64)
        np.cumsum(mix((full.astype(np.uint64) + np.uint64(1)) * ODD) * power[: len(full)], dtype=np.uint64, out=self.sums[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray, salt: int) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + np.uint64(salt * int(ODD) % (1 << 64)))

    def words(self) -> np.ndarray:
        return self.hashes(self.starts, self.ends, 0)

    def grams(self, start: np.ndarray, end: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
        """(number of its word, hash) of all n-grams of some words, each with one blank on either side."""
        n = np.maximum(end - start + 3 - order, 0)
        of = np.repeat(np.arange(len(start)), n)
        at = np.arange(len(of)) + np.repeat(start - 1 - np.cumsum(n) + n, n)
        return of, self.hashes(at, at + order, order)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves remainder 1 by 3; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(labelled: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """At most per_lang distinct texts of each language, those of the smallest hashes; (lang, text).

    Only hashes are compared, never texts, and a share far above what is needed is cut before they are ranked,
    so a hot language or a text with countless copies is no burden.
    """
    rows = labelled.where("text is not null and lang is not null").select("lang", "text", F.xxhash64("text").alias("h"))
    hashes = rows.groupBy("lang", "h").agg(F.lit(1).alias("one"))
    sizes = hashes.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    span = F.col("h").cast("double") / F.lit(2.0**64) + 0.5
    near = hashes.join(F.broadcast(sizes), "lang").where(span <= F.lit(2.0 * per_lang + 50) / F.col("n"))
    best = near.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("h"))).where(F.col("r") <= per_lang)
    return rows.join(F.broadcast(best.select("lang", "h")), ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"]).select("lang", "text")


@dataclass
class Model:
    """Log frequencies by language: sorted hashes of words and of n-grams, with a row for each; the last axis follows langs."""

    langs: list[str]
    words: np.ndarray
    word_rows: np.ndarray
    grams: np.ndarray
    gram_rows: np.ndarray


def count_tokens(texts: DataFrame) -> DataFrame:
    """(lang, kind, token, n) over all texts; kind 0 for words, else the n-gram order. Counts combine before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = arrow_text(batch.column("text"))
            langs, code = np.unique(np.array(batch.column("lang").to_pylist(), dtype=object).astype(str), return_inverse=True)
            for i, j in text_slices(offsets, SLICE):
                part = Stretch(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                own, out = code[i:j][part.docs], []
                for lang in np.unique(own):
                    of = np.flatnonzero(own == lang)
                    keys, first, n = np.unique(part.words()[of], return_index=True, return_counts=True)
                    out.append((lang, 0, keys, n))
                    for order in ORDERS:
                        w, h = part.grams(part.starts[of[first]], part.ends[of[first]], order)
                        grams, at = np.unique(h, return_inverse=True)
                        out.append((lang, order, grams, np.bincount(at, weights=n[w], minlength=len(grams)).astype(np.int64)))
                for lang, kind, keys, n in out:
                    k = len(keys)
                    yield pa.RecordBatch.from_arrays([pa.array([langs[lang]] * k, pa.string()), pa.array(np.full(k, kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "kind", "token", "n"])

    counted = texts.select("lang", "text").mapInArrow(run, "lang string, kind int, token long, n long")
    return counted.groupBy("lang", "kind", "token").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, per_lang: int = PER_LANG) -> Model:
    """A model of the languages in (lang, text), from a bounded sample of the rows.

    Words and n-grams seen less than LEAST_SEEN times are left out. Without any labelled text the model has no language.
    """
    text_batches(labelled.sparkSession)
    counts = count_tokens(sample(labelled, per_lang))
    several = counts.withColumn("all", F.sum("n").over(W.partitionBy("kind", "token"))).where(F.col("all") >= LEAST_SEEN).drop("all")
    most = several.withColumn("r", F.row_number().over(W.partitionBy("lang", "kind").orderBy(F.desc("n"), "token"))).where(F.col("r") <= TOKENS).drop("r")
    table = most.toPandas()
    langs = sorted(table["lang"].unique())
    none = np.zeros(0, np.uint64)
    if not langs:
        return Model([], none, np.zeros((0, 0)), none, np.zeros((0, 0)))
    lang = table["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy()
    kind, token, n = (table[c].to_numpy() for c in ("kind", "token", "n"))

    def rows(of: int) -> tuple[np.ndarray, np.ndarray]:
        own = kind == of
        keys, at = np.unique(token[own].view(np.uint64), return_inverse=True)
        seen = np.zeros((len(keys), len(langs)))
        seen[at, lang[own]] = n[own]
        return keys, np.log(seen + 0.5) - np.log(seen.sum(0) + 0.5 * len(keys) + 1e-9)

    grams, gram_rows = zip(*[rows(k) for k in ORDERS], strict=True)
    order = np.argsort(np.concatenate(grams))
    return Model(langs, *rows(0), np.concatenate(grams)[order], np.concatenate(gram_rows)[order])


def look_up(keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The place of each hash among sorted keys, -1 for what is none of them."""
    if not len(keys):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, at, -1)


def backoff(part: Stretch, start: np.ndarray, end: np.ndarray, model: Model) -> np.ndarray:
    """For every word the mean of its longest known n-grams' rows, whatever order has any; zeros if none is known."""
    out = np.zeros((len(start), len(model.langs)))
    left = np.arange(len(start))
    for order in ORDERS:
        of, h = part.grams(start[left], end[left], order)
        at = look_up(model.grams, h)
        known = at >= 0
        n = np.bincount(of[known], minlength=len(left))
        sums = np.zeros((len(left), len(model.langs)))
        np.add.at(sums, of[known], model.gram_rows[at[known]])
        some = n > 0
        out[left[some]] = sums[some] / n[some, None]
        left = left[~some]
        if not len(left):
            break
    return out


def tell(column, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(number of the language, confidence) of every text; -1 and 0 for a null text and one without a letter."""
    data, offsets = arrow_text(column)
    best, score = np.full(len(offsets) - 1, -1), np.zeros(len(offsets) - 1)
    if not model.langs:
        return best, score
    for i, j in text_slices(offsets, SLICE):
        part = Stretch(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        if not len(part.starts):
            continue
        h = part.words()
        at = look_up(model.words, h)
        values = model.word_rows[at] if len(model.words) else np.zeros((len(at), len(model.langs)))
        new = np.flatnonzero(at < 0)
        if len(new):
            _, first, back = np.unique(h[new], return_index=True, return_inverse=True)
            values[new] = backoff(part, part.starts[new[first]], part.ends[new[first]], model)[back]
        total = np.stack([np.bincount(part.docs, weights=values[:, k], minlength=j - i) for k in range(len(model.langs))], 1)
        words = np.bincount(part.docs, minlength=j - i)
        scaled = total * np.minimum(1.0, EVIDENCE_WORDS / np.maximum(words, 1))[:, None]
        p = np.exp(scaled - scaled.max(1, keepdims=True))
        top = p.argmax(1)
        has = words > 0
        best[i:j] = np.where(has, top, -1)
        score[i:j] = np.where(has, p[np.arange(j - i), top] / p.sum(1), 0.0)
    return best, score


def predict(df: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """columns, lang and score of (columns, text). Null texts and texts without a letter are und with score 0; without any
    language learned all are. Repeated rows are told alike."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    text_batches(df.sparkSession)
    rows = df.select(*columns, F.col("text").alias("_text"))
    schema = rows.select(*columns).schema.add("lang", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.langs, UND], dtype=object)
        for batch in batches:
            best, score = tell(batch.column(len(columns)), model)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(names[best], pa.string()), pa.array(score)], schema.names)
        release()

    return rows.mapInArrow(run, schema)


def op10_langid(spark, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those that are not held out."""
    from lorewell.session import table

    docs = table(spark, sf_dir, "documents").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text", "lang")
    model = fit(docs.where("not held_out").select("lang", "text"))
    return predict(docs.drop("lang"), model, ["doc_id", "held_out"]).withColumnRenamed("lang", "lang_pred")


def keep_identified(docs: DataFrame, least: float = 0.35) -> DataFrame:
    """The documents whose language is told with at least that confidence; all columns stay.

    Documents without a letter go. Without any labelled text, nothing can be told and only those go.
    """
    model = fit(docs.select("lang", "text"))
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, score = tell(batch.column(at), shared.value)
            yield batch.filter(pa.array((best >= 0) & (score >= least)))
        release()

    return docs.mapInArrow(run, docs.schema)
