"""Quality by hierarchical empirical Bayes: document evidence shrunk towards path, host and global rates (operator 8)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell.llm.common import arrow_text, keep, text_batches, text_slices, word_hashes

#: Bounds of the labelled samples that the lexicon and the regression take, at every size of the tables.
SAMPLE, FITTED = 12_000, 4_000
#: Hashed words, and dense features: shares of ASCII marks, digits, capitals, repeats, lengths.
WORDS, MARKS = 4_096, 33
DENSE = MARKS + 6
WIDTH = WORDS + DENSE
#: Bytes and documents that have rows of features at once, 50 kB each.
SLICE, ROWS = 512 << 10, 512
#: A document is kept from this quality on, if its chance of being toxic is below that.
KEEP, TOXIC = 0.5, 0.93
#: A word tells toxic documents if so many, and that share, of the sample's have it and its rate there is so many times that elsewhere.
TELLING, SHARE, ODDS = 5, 0.015, 30.0
#: Strength of the global prior on hosts and of a host's on its paths is estimated, within these bounds.
STRENGTH = (2.0, 1000.0)

MARK_OF = np.full(256, -1)
for _i, _c in enumerate(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\n"):
    MARK_OF[_c] = _i


def feature_rows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One row of WIDTH features for each document of a slice (log counts of hashed words, then dense ones); word hashes and
    their documents."""
    n = len(offsets) - 1
    h, docs, starts, ends = word_hashes(data, offsets, bare=True)
    bucket = ((h >> np.uint64(30)) % np.uint64(WORDS)).astype(np.int64)
    words = np.bincount(docs, minlength=n)
    x = np.zeros((n, WIDTH), np.float32)
    counts = np.bincount(docs * WORDS + bucket, minlength=n * WORDS).reshape(n, WORDS)
    x[:, :WORDS] = np.log1p(counts) / np.sqrt(np.maximum(words, 1))[:, None]
    size = np.diff(offsets)
    doc_of = np.repeat(np.arange(n), size)
    mark = MARK_OF[data]
    has = np.flatnonzero(mark >= 0)
    per_word = 1.0 / np.maximum(words, 1)
    x[:, WORDS : WORDS + MARKS] = np.sqrt(np.bincount(doc_of[has] * MARKS + mark[has], minlength=n * MARKS).reshape(n, MARKS) * per_word[:, None])
    same = np.flatnonzero((h[1:] == h[:-1]) & (docs[1:] == docs[:-1]))
    upper = np.bincount(doc_of[(data - np.uint8(65)) < 26], minlength=n) / np.maximum(size, 1)
    digit = np.bincount(doc_of[(data - np.uint8(48)) < 10], minlength=n) / np.maximum(size, 1)
    pairs = np.unique(docs * (1 << 44) + (h >> np.uint64(20)).astype(np.int64)) >> 44
    x[:, WORDS + MARKS :] = np.stack([np.bincount(docs[same], minlength=n) * per_word, np.sqrt(upper), np.sqrt(digit), np.log1p(words) / 8, np.bincount(docs, weights=ends - starts, minlength=n) * per_word / 10, np.bincount(pairs, minlength=n) * per_word], 1)
    return x, h, docs


def _fit(x: np.ndarray, y: np.ndarray, steps: int = 300, decay: float = 3e-3) -> np.ndarray:
    """Logistic regression by full-batch Adam; the last weight is the intercept. One class alone gives its log odds."""
    w = np.zeros(x.shape[1] + 1, np.float32)
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    w[-1] = np.log(rate / (1 - rate))
    if not 0 < y.mean() < 1:
        return w
    scale = np.ones(x.shape[1], np.float32)
    scale[:WORDS] = 4.0
    m, v = np.zeros_like(w), np.zeros_like(w)
    xs = x * scale
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-(xs @ w[:-1] + w[-1])))
        g = np.append(xs.T @ (p - y) / len(y) + decay * w[:-1] * (np.arange(len(w) - 1) < WORDS), (p - y).mean()).astype(np.float32)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    w[:-1] *= scale
    return w


@dataclass
class Model:
    """weights (WIDTH + 1) tell quality; a word of lexicon (sorted hashes) tells a toxic document with chance."""

    weights: np.ndarray
    lexicon: np.ndarray
    chance: np.ndarray


def learn_lexicon(words: DataFrame, bad: int, good: int) -> tuple[np.ndarray, np.ndarray]:
    """Words that occur in TELLING toxic documents or more and in SHARE of them, and there far more than elsewhere, with their precision.

    words has (w, toxic) for each document's different words; bad and good count the documents.
    """
    counts = words.groupBy("w").agg(F.sum(F.col("toxic").cast("int")).alias("inside"), F.count(F.lit(1)).alias("n"))
    often = counts.where(F.col("inside") >= F.lit(max(TELLING, SHARE * bad))).orderBy("w").toPandas()
    keys, inside = often["w"].to_numpy().view(np.uint64), often["inside"].to_numpy(dtype=float)
    outside = often["n"].to_numpy() - inside
    # the rate outside, had one more document the word
    odds = (inside / max(1, bad)) / ((outside + 1) / max(1, good))
    use = np.flatnonzero(odds >= ODDS)
    use = use[np.argsort(keys[use])]
    return keys[use], (inside / (inside + outside + 1))[use]


def toxic_chance(h: np.ndarray, docs: np.ndarray, n: int, model: Model) -> np.ndarray:
    """One less the chance that none of the document's telling words is meant."""
    out = np.zeros(n)
    if len(model.lexicon):
        at = np.minimum(np.searchsorted(model.lexicon, h), len(model.lexicon) - 1)
        hit = np.flatnonzero(model.lexicon[at] == h)
        pairs = np.unique(docs[hit] * len(model.lexicon) + at[hit])
        np.add.at(out, pairs // len(model.lexicon), np.log1p(-np.minimum(model.chance[pairs % len(model.lexicon)], 0.999)))
    return 1 - np.exp(out)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, fitted: int = FITTED) -> Model:
    """A model from at most `sample` labelled documents, those of the smallest hashes: the lexicon takes all of them, the weights
    the first `fitted`.

    A document with several labels counts with the greatest, one of several texts with that of the least hash; without labels
    all weights are 0. The driver holds the rows of `fitted` documents and the words that tell; words are counted where they are.
    """
    text_batches(docs.sparkSession)
    each = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    order = F.struct(F.xxhash64("doc_id").alias("h"), "doc_id")
    some = keep(each.withColumn("o", order).orderBy("o").limit(sample))
    last = some.orderBy("o").limit(fitted).agg(F.max("o").alias("o")).first()["o"]
    if last is None:
        return Model(np.zeros(WIDTH + 1, np.float32), np.zeros(0, np.uint64), np.zeros(0))
    dense = F.col("o") <= F.struct(F.lit(last["h"]).alias("h"), F.lit(last["doc_id"]).alias("doc_id"))
    held = docs.select("doc_id", "text").join(F.broadcast(some.select("doc_id")), "doc_id").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = held.join(F.broadcast(some.select("doc_id", "quality", "toxic", dense.alias("dense"))), "doc_id").select("text", "quality", "toxic", "dense")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = arrow_text(batch.column("text"))
            at, values, words = [], [], []
            dense = batch.column("dense").to_pylist()
            for i, j in text_slices(offsets, SLICE, ROWS):
                x, h, d = feature_rows(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                for row, use in zip(x, dense[i:j], strict=True):
                    hit = np.flatnonzero(row) if use else np.zeros(0, np.int64)
                    at.append(hit.astype(np.uint16).tobytes())
                    values.append(row[hit].astype(np.float32).tobytes())
                ends = np.searchsorted(d, np.arange(j - i + 1))
                words += [np.unique(h[a:b]).view(np.int64) for a, b in zip(ends, ends[1:], strict=False)]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, words)]).astype(np.int32)), pa.array(np.concatenate(words) if words else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.binary()), pa.array(values, pa.binary()), lists, batch.column("quality"), batch.column("toxic"), batch.column("dense")], ["at", "v", "w", "quality", "toxic", "dense"])

    found = keep(rows.mapInArrow(run, "at binary, v binary, w array<long>, quality int, toxic int, dense boolean"))
    n = {r["bad"]: r["n"] for r in found.groupBy((F.col("toxic") > 0).alias("bad")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n:
        return Model(np.zeros(WIDTH + 1, np.float32), np.zeros(0, np.uint64), np.zeros(0))
    got = found.where("dense").select("at", "v", "quality").collect()
    got.sort(key=lambda r: (bytes(r["at"]), bytes(r["v"]), r["quality"]))
    x = np.zeros((len(got), WIDTH), np.float32)
    for row, r in zip(x, got, strict=True):
        row[np.frombuffer(r["at"], np.uint16)] = np.frombuffer(r["v"], np.float32)
    weights = _fit(x, np.array([r["quality"] > 0 for r in got], dtype=np.float32)) if got else np.zeros(WIDTH + 1, np.float32)
    return Model(weights, *learn_lexicon(found.select(F.explode("w").alias("w"), (F.col("toxic") > 0).alias("toxic")), n.get(True, 0), n.get(False, 0)))


def evidence(docs: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """columns, and each document's classifier probabilities p and toxic; a text without a word, a null one too, has p 0."""
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*columns, "text")
    schema = rows.select(*columns).schema.add("p", "double").add("toxic", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        w = model.weights
        for batch in batches:
            data, offsets = arrow_text(batch.column(len(columns)))
            out = [np.zeros((0, 2))]
            for i, j in text_slices(offsets, SLICE, ROWS):
                x, h, d = feature_rows(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                p = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30).astype(np.float64)))
                p[np.bincount(d, minlength=j - i) == 0] = 0
                out.append(np.stack([p, toxic_chance(h, d, j - i, model)], 1))
            both = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(both[:, 0]), pa.array(both[:, 1])], [*columns, "p", "toxic"])

    return rows.mapInArrow(run, schema)


def _strength(mean: Column, spread: Column, size: Column) -> Column:
    """The prior's weight in documents, by moments: rates of groups vary by mean (1 - mean) / (strength + 1) beyond chance."""
    var = F.greatest(spread - mean * (1 - mean) / F.greatest(size, F.lit(1.0)), F.lit(1e-6))
    return F.greatest(F.lit(STRENGTH[0]), F.least(F.lit(STRENGTH[1]), mean * (1 - mean) / var - 1))


def posteriors(scored: DataFrame) -> DataFrame:
    """(host, path, n, rate, host_rate, all_rate) from (host, path, p): rates of good documents, paths shrunk to their
    host and hosts to all, each by a strength estimated from how much the groups differ.

    Sums only: documents combine before the shuffle, so a hot host is as cheap as any.
    """
    paths = keep(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.count(F.lit(1)).alias("k"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("hq"))
    total = hosts.agg(F.sum("hn").alias("an"), F.sum("hs").alias("as"), F.count(F.lit(1)).alias("hosts"), F.sum(F.col("hs") * F.col("hs") / F.col("hn")).alias("aq"))
    mean = F.col("as") / F.col("an")
    with_all = hosts.join(F.broadcast(total)).withColumn("all_rate", mean)
    host_strength = _strength(F.col("all_rate"), F.col("aq") / F.col("an") - F.col("all_rate") * F.col("all_rate"), F.col("an") / F.col("hosts"))
    with_host = with_all.withColumn("host_rate", (F.col("hs") + host_strength * F.col("all_rate")) / (F.col("hn") + host_strength))
    raw = F.col("hs") / F.col("hn")
    path_strength = _strength(F.col("host_rate"), F.col("hq") / F.col("hn") - raw * raw, F.col("hn") / F.col("k"))
    prior = with_host.select(F.col("host").alias("_host"), "host_rate", "all_rate", path_strength.alias("strength"))
    both = paths.join(prior, F.col("host").eqNullSafe(F.col("_host")))
    return both.select("host", "path", "n", ((F.col("s") + F.col("strength") * F.col("host_rate")) / (F.col("n") + F.col("strength"))).alias("rate"), "host_rate", "all_rate")


def _logit(p: Column) -> Column:
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(q / (1 - q))


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column) -> DataFrame:
    """(doc_id, host, path, p, toxic, host_rate, path_rate, score, keep) of every row of (doc_id, text).

    score is the document's probability with its site's rate in place of the global prior. Null hosts and paths are sites of
    their own; a text without a word scores 0; without labels every text with a word is kept.
    """
    model = fit(docs, labels)
    rows = keep(evidence(docs.select("doc_id", "text", host.alias("host"), path.alias("path")), model, ["doc_id", "host", "path"]))
    site = keep(posteriors(rows)).select(F.col("host").alias("_h"), F.col("path").alias("_p"), F.col("rate").alias("path_rate"), "host_rate", "all_rate")
    joined = rows.join(site, F.col("host").eqNullSafe(F.col("_h")) & F.col("path").eqNullSafe(F.col("_p")))
    score = F.when(F.col("p") > 0, 1 / (1 + F.exp(-(_logit(F.col("p")) + _logit(F.col("path_rate")) - _logit(F.col("all_rate")))))).otherwise(0.0)
    done = joined.withColumn("score", score)
    kept = (F.col("score") >= KEEP) & (F.col("toxic") < TOXIC) if model.weights.any() else F.col("p") > 0
    return done.select("doc_id", "host", "path", F.round("p", 6).alias("p"), F.round("toxic", 6).alias("toxic"), F.round("host_rate", 6).alias("host_rate"), F.round("path_rate", 6).alias("path_rate"), F.round("score", 6).alias("score"), kept.alias("keep"))


def op8_quality(spark, sf_dir: str) -> DataFrame:
    """Quality of all documents; source is the host, source and language the path."""
    from lorewell.session import table

    docs = table(spark, sf_dir, "documents")
    return classify(docs, table(spark, sf_dir, "labels"), F.col("source"), F.concat_ws("/", "source", "lang"))
