"""Benchmark decontamination by latent semantic retrieval (operator 4).

Words are runs of letters and digits, without regard to the case of ASCII and Latin-1 letters.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.llm.common import arrow_text, release, text_batches, text_slices, word_hashes

#: Hashed vocabulary, words of a passage of the decomposition, rank and oversampling of the randomised SVD.
FEATURES, PASSAGE, RANK, OVER = 2048, 64, 48, 8
#: Search windows in blocks of BLOCK words: (blocks, stride in blocks). An item part is sought in windows of about its length.
BLOCK = 4
WINDOWS = ((2, 1), (3, 1), (4, 1), (5, 1), (7, 2), (9, 2), (11, 2), (14, 3))
#: Longer items are sought in equal parts of at most so many words, which fit a machine word.
PART_WORDS = 58
#: A window is a candidate from this cosine on, or by its words: see Rare.
COSINE = 0.55
#: Words of a part that retrieval by words leaves out, the most common ones; buckets of its first look.
COMMON, LOOKUP = 0.25, 1 << 16
#: Contaminated: this share of the item's words in order, or the lower share with that share of its answer.
WHOLE, PARAPHRASE, ANSWER = 0.7, 0.5, 0.75
#: Bytes of benchmark text of one search, about 10 bytes of broadcast each; more is searched in blocks, each a pass over the documents.
ITEM_BYTES = 8 << 20
SLICE, CHUNK_WORDS, OVERLAP = 2 << 20, 150_000, 128
#: Windows that are compared together.
CHUNK_WINDOWS = 25_000
#: Parts that are matched together, and bytes of their dense masks that a worker keeps.
PARTS, DENSE_BYTES = 128, 64 << 20
SHARDS = 16


def features(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(20)).astype(np.int64) % FEATURES


def test_matrix(seed: int = 4) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(FEATURES, RANK + OVER)).astype(np.float32)


def places(docs: np.ndarray) -> np.ndarray:
    """Each word's place in its document."""
    if not len(docs):
        return docs
    new = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]]))
    return np.arange(len(docs)) - np.repeat(new, np.diff(np.append(new, len(docs))))


def accumulate(h: np.ndarray, docs: np.ndarray, omega: np.ndarray, z: np.ndarray, df: np.ndarray, tf: np.ndarray) -> None:
    """Adds the passages of some documents to z = T'T omega (T: term counts of passages), df and tf."""
    f = features(h)
    first = np.flatnonzero(places(docs) % PASSAGE == 0)
    ends = np.append(first[1:], len(f))
    for b in range(0, len(first), 1024):
        lo, hi = first[b], ends[min(b + 1024, len(first)) - 1]
        n = min(1024, len(first) - b)
        pid = np.repeat(np.arange(n), ends[b : b + n] - first[b : b + n])
        counts = np.bincount(pid * FEATURES + f[lo:hi], minlength=n * FEATURES).astype(np.float32).reshape(n, FEATURES)
        z += counts.T @ (counts @ omega)
        df += (counts > 0).sum(0)
        tf += counts.sum(0, dtype=np.float64)


def sketch(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(z, df, tf, passages) over all passages of all documents, in one pass.

    Each task sums what it reads; the sums meet by rows of the matrix, added in the order of the tasks.
    """
    width = RANK + OVER + 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        omega = test_matrix()
        z, df, tf, n = np.zeros((FEATURES, RANK + OVER)), np.zeros(FEATURES), np.zeros(FEATURES), 0
        for batch in batches:
            data, offsets = arrow_text(batch.column(0))
            for i, j in text_slices(offsets, SLICE):
                h, d, _, _ = word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], bare=True)
                n += int((places(d) % PASSAGE == 0).sum())
                accumulate(h, d, omega, z, df, tf)
        full = np.concatenate([z, df[:, None], tf[:, None], np.full((FEATURES, 1), float(n))], 1)
        yield pa.RecordBatch.from_arrays([pa.array(range(SHARDS), pa.int32()), pa.array([x.tobytes() for x in np.split(full, SHARDS)])], ["i", "m"])
        release()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, m in zip(batch.column("i").to_pylist(), batch.column("m").to_pylist(), strict=True):
                part = np.frombuffer(m)
                sums[i] = sums[i] + part if i in sums else part
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["i", "m"])

    parts = docs.select("text").mapInArrow(run, "i int, m binary").withColumn("task", F.spark_partition_id())
    total = parts.repartition(SHARDS, "i").sortWithinPartitions("i", "task").mapInArrow(add, "i int, m binary").collect()
    if not total:
        return np.zeros((FEATURES, RANK + OVER)), np.zeros(FEATURES), np.zeros(FEATURES), 0
    full = np.concatenate([np.frombuffer(r["m"]).reshape(-1, width) for r in sorted(total, key=lambda r: r["i"])])
    return full[:, :-3], full[:, -3], full[:, -2], int(full[0, -1])


@dataclass
class Space:
    """Latent coordinates: a word adds its row of g; mean is the corpus's mean row, taken off so that directions tell."""

    g: np.ndarray
    mean: np.ndarray


def decompose(z: np.ndarray, df: np.ndarray, tf: np.ndarray, n: int) -> Space:
    """Single-pass randomised SVD (Nystrom form) of the TF-IDF matrix T D from z = T'T omega; coordinates are scaled by
    the singular values, so that no direction (the language, above all) outweighs the others."""
    idf = np.log((n + 1) / (df + 1)) + 1e-3
    omega = test_matrix().astype(np.float64)
    core = omega.T @ z
    lam, u = np.linalg.eigh((core + core.T) / 2)
    ok = lam > 1e-8 * max(lam.max(), 1e-30)
    q, sv, _ = np.linalg.svd((idf[:, None] * z) @ (u[:, ok] / np.sqrt(lam[ok])), full_matrices=False)
    rank = int(min(RANK, (sv > 1e-6 * max(sv.max(initial=0), 1e-30)).sum()))
    if not rank:
        return Space(np.zeros((FEATURES, 1), np.float32), np.zeros(1, np.float32))
    g = idf[:, None] * q[:, :rank] / sv[:rank]
    return Space(g.astype(np.float32), (tf @ g / max(tf.sum(), 1)).astype(np.float32))


@dataclass
class Items:
    """Benchmark items cut into parts. groups: window class to the numbers of its parts; part_first: a part's place in its item;
    whole: the words of the items of several parts."""

    ids: list[int]
    words: np.ndarray
    part_item: np.ndarray
    part_first: np.ndarray
    part_answer: np.ndarray
    whole: dict[int, np.ndarray]
    vectors: np.ndarray
    groups: dict[tuple[int, int], np.ndarray]
    masks: dict[tuple[int, int], list[Masks]]
    rare: dict[tuple[int, int], list[Rare]]


@dataclass
class Rare:
    """The words of some parts without their most common ones. A window with PARAPHRASE of a part's words in order has at least
    `need` of these, so what has fewer is surely no candidate."""

    keys: np.ndarray
    seen: np.ndarray
    first: np.ndarray
    part: np.ndarray
    times: np.ndarray
    need: np.ndarray


def rare_words(parts: list[np.ndarray], often: dict[int, int]) -> Rare:
    """often: parts that have a word. The words of the most parts are left out, up to COMMON of a part's."""
    rows, need = [], []
    for i, p in enumerate(parts):
        words, times = np.unique(p, return_counts=True)
        left = int(COMMON * len(p))
        need.append(int(np.ceil(PARAPHRASE * len(p))))
        for k in np.argsort([-often[w] for w in words.tolist()], kind="stable"):
            if often[int(words[k])] > 1 and times[k] <= left:
                left -= int(times[k])
                need[-1] -= int(times[k])
            else:
                rows.append((int(words[k]), i, int(times[k])))
    rows.sort()
    keys, first = np.unique(np.array([r[0] for r in rows], np.uint64), return_index=True)
    seen = np.zeros(LOOKUP, bool)
    seen[(keys % np.uint64(LOOKUP)).astype(np.int64)] = True
    return Rare(keys, seen, np.append(first, len(rows)), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), np.array(need))


def enough_words(h: np.ndarray, low: np.ndarray, rare: Rare, cell: int) -> np.ndarray:
    """(cell, part): whether the three cells of `cell` words from this one on may have the part's words. low: h by LOOKUP."""
    n, parts = len(h) // cell + 3, len(rare.need)
    at = np.flatnonzero(rare.seen[low])
    key = np.minimum(np.searchsorted(rare.keys, h[at]), len(rare.keys) - 1)
    is_key = rare.keys[key] == h[at]
    both = np.unique(at[is_key] // cell * len(rare.keys) + key[is_key])
    count = np.zeros(n * parts)
    # bounded slices, each within its own cells
    for i in range(0, len(both), 16_384):
        where, key = both[i : i + 16_384] // len(rare.keys), both[i : i + 16_384] % len(rare.keys)
        size = rare.first[key + 1] - rare.first[key]
        row = np.arange(size.sum()) + np.repeat(rare.first[key] - np.cumsum(size) + size, size)
        some = np.bincount(np.repeat(where - where[0], size) * parts + rare.part[row], weights=rare.times[row])
        count[where[0] * parts : where[0] * parts + len(some)] += some
    count = count.reshape(n, parts)
    return count[:-2] + count[1:-1] + count[2:] >= rare.need


def answer_words(n: int) -> int:
    """The last quarter of an item stands for its answer, three words at least."""
    return min(n, max(3, n // 4))


def prepare(rows: list[tuple[int, str | None]], space: Space) -> Items:
    """Items without a word take no part."""
    ids, words, part_item, parts, firsts, answers, classes, whole = [], [], [], [], [], [], [], {}
    for item, text in rows:
        raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
        h, _, _, _ = word_hashes(raw, np.array([0, len(raw)]), bare=True)
        if not len(h):
            continue
        last = len(h) - answer_words(len(h))
        at = 0
        if len(h) > PART_WORDS:
            whole[len(ids)] = h
        for piece in np.array_split(h, -(-len(h) // PART_WORDS)):
            part_item.append(len(ids))
            parts.append(piece)
            firsts.append(at)
            answers.append(sum(1 << i for i in range(len(piece)) if at + i >= last))
            classes.append(min(WINDOWS, key=lambda w: abs(np.log(w[0] * BLOCK / len(piece)))))
            at += len(piece)
        ids.append(item)
        words.append(len(h))
    raw_vectors = np.array([space.g[features(p)].sum(0) - len(p) * space.mean for p in parts], dtype=np.float32).reshape(len(parts), space.g.shape[1])
    norm = np.linalg.norm(raw_vectors, axis=1, keepdims=True)
    vectors = raw_vectors / np.maximum(norm, 1e-12)
    groups = {w: np.array([i for i, c in enumerate(classes) if c == w]) for w in set(classes)}
    masks = {w: [part_masks([parts[i] for i in group[g : g + PARTS]]) for g in range(0, len(group), PARTS)] for w, group in groups.items()}
    often = Counter(w for p in parts for w in set(p.tolist()))
    rare = {w: [rare_words([parts[i] for i in group[g : g + PARTS]], often) for g in range(0, len(group), PARTS)] for w, group in groups.items()}
    return Items(ids, np.array(words), np.array(part_item), np.array(firsts), np.array(answers, dtype=np.uint64), whole, vectors, groups, masks, rare)


def lcs(seen: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Bit-parallel longest common subsequence: the bits of each row's part that a window takes.

    seen: for every word of a window, the bits of its places in the part (64 words at most); low: the bits of the part.
    """
    v = np.full(len(seen), ~np.uint64(0))
    for m in np.ascontiguousarray(seen.T):
        u = v & m
        v = (v + u) | (v ^ u)
    return ~v & low


@dataclass
class Masks:
    """For every part and word of a group the bits of the word's places, (part, key, bits) by their places among keys; low: each
    part's bits. dense() has a row for every part and a last column, of words that are no key, of zeros; what tasks are sent
    grows with the words alone, and a worker holds the dense form of DENSE_BYTES of groups at most."""

    keys: np.ndarray
    part: np.ndarray
    key: np.ndarray
    bits: np.ndarray
    low: np.ndarray

    def dense(self, held: dict[int, np.ndarray]) -> np.ndarray:
        if (out := held.get(id(self))) is None:
            out = np.zeros((len(self.low), len(self.keys) + 1), np.uint64)
            out[self.part, self.key] = self.bits
            if sum(x.nbytes for x in held.values()) + out.nbytes <= DENSE_BYTES:
                held[id(self)] = out
        return out


def part_masks(parts: list[np.ndarray]) -> Masks:
    keys = np.unique(np.concatenate(parts))
    rows = []
    for i, p in enumerate(parts):
        own, at = np.unique(p, return_inverse=True)
        bits = np.zeros(len(own), np.uint64)
        np.bitwise_or.at(bits, at, np.uint64(1) << np.arange(len(p)).astype(np.uint64))
        rows.append((np.full(len(own), i), np.searchsorted(keys, own), bits))
    low = np.array([(1 << len(p)) - 1 for p in parts], dtype=np.uint64)
    return Masks(keys, *(np.concatenate(c) for c in zip(*rows, strict=True)), low)


def search(h: np.ndarray, docs: np.ndarray, space: Space, items: Items) -> list[tuple[int, int, int, int, float, int]]:
    """(document, part, words in common, answer words in common, cosine, first word) for every candidate window that passes half
    of the part's words; the same pair may come more than once. Retrieval by words misses no such window."""
    out: list[tuple[int, int, int, int, float, int]] = []
    held: dict[int, np.ndarray] = {}
    rows_of_g = np.concatenate([space.g - space.mean, np.zeros((1, space.g.shape[1]), np.float32)])
    padded_docs = np.concatenate([docs, np.full(OVERLAP, -1)])
    for lo in range(0, len(h), CHUNK_WORDS):
        hi = min(len(h), lo + CHUNK_WORDS + OVERLAP)
        d = docs[lo:hi]
        place = places(d)
        block = np.flatnonzero(place % BLOCK == 0)
        number = np.cumsum(place % BLOCK == 0) - 1
        # each block's words, missing ones as the zero row
        grid = np.full((len(block), BLOCK), FEATURES, dtype=np.int64)
        grid[number, place % BLOCK] = features(h[lo:hi])
        vec = rows_of_g[grid[:, 0]]
        for i in range(1, BLOCK):
            vec += rows_of_g[grid[:, i]]
        # centred sums stay small, so single precision does
        cum = np.concatenate([np.zeros((1, vec.shape[1]), np.float32), np.cumsum(vec, axis=0)])
        block_doc = d[block]
        doc_first = np.flatnonzero(np.concatenate([[True], block_doc[1:] != block_doc[:-1]]))
        doc_end = np.append(doc_first[1:], len(block))
        # what the windows of this chunk see, with what is added on either side
        base, top = max(0, lo - OVERLAP), min(len(h), hi + OVERLAP)
        around = h[base:top]
        looked = (around % np.uint64(LOOKUP)).astype(np.int64)
        for (blocks, stride), group in items.groups.items():
            # a quarter of a window more on either side
            more = blocks * BLOCK // 4 + 1
            cell = -(-(blocks * BLOCK + 2 * more) // 2)
            enough = [enough_words(around, looked, rare, cell) for rare in items.rare[blocks, stride]]
            inner = np.arange(0, max(0, len(block) - blocks + 1), stride)
            inner = inner[block_doc[inner] == block_doc[inner + blocks - 1]] if len(inner) else inner
            # and each document's first and last windows, which are all of a short document
            start = np.concatenate([inner, doc_first, np.maximum(doc_first, doc_end - blocks)])
            end = np.concatenate([inner + blocks, np.minimum(doc_first + blocks, doc_end), doc_end])
            looked_up: dict[int, np.ndarray] = {}
            for s in range(0, len(start), CHUNK_WINDOWS):
                a, b = start[s : s + CHUNK_WINDOWS], end[s : s + CHUNK_WINDOWS]
                x = cum[b]
                x -= cum[a]
                least = np.sqrt(np.einsum("ij,ij->i", x, x)) * np.float32(COSINE)
                place_of = np.maximum(lo + block[a] - more, base) - base
                for g, own, by_words in zip(range(0, len(group), PARTS), items.masks[blocks, stride], enough, strict=True):
                    part, keys, low = group[g : g + PARTS], own.keys, own.low
                    dots = x @ items.vectors[part].T
                    w, p = np.nonzero((dots >= np.maximum(least, 1e-9)[:, None]) | by_words[place_of // cell])
                    if not len(w):
                        continue
                    masks = own.dense(held)
                    # every word of the chunk is looked up once, whatever windows it is in
                    if g not in looked_up:
                        found = np.minimum(np.searchsorted(keys, around), len(keys) - 1)
                        looked_up[g] = np.append(np.where(keys[found] == around, found, len(keys)), len(keys)).astype(np.int32)
                    known = looked_up[g]
                    for c in range(0, len(w), 4_000):
                        cw, cp = w[c : c + 4_000], p[c : c + 4_000]
                        at = np.clip((lo + block[a[cw]] - more)[:, None] + np.arange(blocks * BLOCK + 2 * more), 0, len(h))
                        key = known[np.minimum(at - base, len(around))]
                        key[padded_docs[at] != block_doc[a[cw]][:, None]] = len(keys)
                        taken = lcs(masks[cp[:, None], key], low[cp])
                        common = np.bitwise_count(taken)
                        hit = np.flatnonzero(common >= PARAPHRASE * np.bitwise_count(low[cp]))
                        answer = np.bitwise_count(taken[hit] & items.part_answer[part[cp[hit]]])
                        cos = dots[cw[hit], cp[hit]] / np.maximum(least[cw[hit]], 1e-9) * COSINE
                        first = np.clip(lo + block[a[cw[hit]]] - more, 0, len(h))
                        out += zip(block_doc[a[cw[hit]]].tolist(), part[cp[hit]].tolist(), common[hit].tolist(), answer.tolist(), cos.tolist(), first.tolist(), strict=True)
    return out


def whole_item(words: list[int], item: np.ndarray) -> tuple[int, int]:
    """(words in common, answer words in common) of a stretch of text and a whole item of any length, in order."""
    places: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    v = full
    for w in words:
        if m := places.get(w):
            u = v & m
            v = ((v + u) | (v - u)) & full
    taken = ~v & full
    return taken.bit_count(), (taken >> (len(item) - answer_words(len(item)))).bit_count()


def whole_items(found: list[tuple], h: np.ndarray, docs: np.ndarray, items: Items) -> dict[tuple[int, int], set[tuple[int, int, float]]]:
    """For items of several parts: (words in common, answer words, cosine) of the stretches where a part was found.

    A stretch reaches as far on either side of the found part as the item does, and a quarter more; so what is in
    order there counts, also parts of which too little is left to be found by themselves. Where an item has half of its
    words, one of its parts has half of its own, so no stretch is missed.
    """
    out: dict[tuple[int, int], set[tuple[int, int, float]]] = {}
    done = set()
    for doc, part, _, _, cos, at in found:
        item = int(items.part_item[part])
        if item not in items.whole:
            continue
        words = items.whole[item]
        ahead, behind = int(items.part_first[part]), len(words) - int(items.part_first[part])
        lo, hi = at - ahead - ahead // 4 - 8, at + behind + behind // 4 + 40
        first, last = np.searchsorted(docs, doc), np.searchsorted(docs, doc, side="right")
        lo, hi = max(lo, int(first)) // 8 * 8, min(hi, int(last)) // 8 * 8 + 8
        if (doc, item, lo, hi) in done:
            continue
        done.add((doc, item, lo, hi))
        lo, hi = max(lo, int(first)), min(hi, int(last))
        out.setdefault((doc, item), set()).add((*whole_item(h[lo:hi].tolist(), words), cos))
    return out


def decide(found: list[tuple], items: Items, stretches: dict | None = None) -> list[tuple[int, int, int, int, bool, float]]:
    """(document, item number, words in common, item words, answer found, cosine) of what counts as contaminated.

    Each part counts with one window, whichever serves best: an item of one part is in the document if a window has WHOLE of its
    words, in order, or PARAPHRASE of them with ANSWER of its answer; parts of longer items add up, or a stretch
    has that share of them (see whole_items).
    """
    windows: dict[tuple[int, int], set[tuple[int, int, float]]] = {}
    for doc, part, common, answer, cos, *_ in found:
        windows.setdefault((doc, part), set()).add((common, answer, cos))
    choices: dict[tuple[int, int], list[tuple[int, int, float]]] = {}
    for (doc, part), seen in sorted(windows.items()):
        row = choices.setdefault((doc, int(items.part_item[part])), [(0, 0, 0.0)])
        row[:] = undominated([(c + common, a + answer, max(x, cos)) for c, a, x in row for common, answer, cos in undominated(seen)])
    for key, seen in (stretches or {}).items():
        choices[key] = undominated([*choices[key], *seen])
    out = []
    for (doc, item), row in sorted(choices.items()):
        n = int(items.words[item])
        for common, answer, cos in row:
            has = answer >= ANSWER * answer_words(n)
            if common >= WHOLE * n or (common >= PARAPHRASE * n and has):
                out.append((doc, item, int(common), n, bool(has), float(cos)))
                break
    return out


def undominated(seen) -> list[tuple[int, int, float]]:
    """Of (words in common, answer words, cosine) those that no other beats in both counts, the most words first."""
    out: list[tuple[int, int, float]] = []
    for row in sorted(seen, reverse=True):
        if not out or row[1] > out[-1][1]:
            out.append(row)
    return out


def leaks_of_batch(column, space: Space, items: Items) -> list[tuple[int, int, int, int, bool, float]]:
    data, offsets = arrow_text(column)
    out = []
    for i, j in text_slices(offsets, SLICE):
        h, d, _, _ = word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], bare=True)
        found = search(h, d, space, items)
        out += [(doc + i, *rest) for doc, *rest in decide(found, items, whole_items(found, h, d, items))]
    return out


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str | None]]]:
    """The items, ITEM_BYTES of text at a time in expectation, so that what tasks are sent stays bounded."""
    size = benchmark.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = max(1, -(-size // ITEM_BYTES))
    for b in range(blocks):
        part = benchmark if blocks == 1 else benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        yield [(r["item_id"], r["text"]) for r in part.select("item_id", "text").collect()]


def latent_space(docs: DataFrame) -> Space:
    """The latent space of all documents' passages."""
    text_batches(docs.sparkSession)
    return decompose(*sketch(docs))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, words_common, item_words, answer_found, cosine): documents that contain a benchmark item, exactly
    or in other words, and the item. One row per pair; documents without any have none.

    Null and empty texts contain nothing; repeated rows give repeated pairs, and so do repeated benchmark items; items without a word
    are in no document; an empty table on either side gives no row.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, words_common int, item_words int, answer_found boolean, cosine double"
    space = latent_space(docs)
    out = spark.createDataFrame([], schema)
    for rows in item_blocks(benchmark):
        shared = spark.sparkContext.broadcast((space, prepare(rows, space)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            space, items = shared.value
            for batch in batches:
                found = leaks_of_batch(batch.column("text"), space, items) if items.ids else []
                ids = batch.column("doc_id").take(pa.array([r[0] for r in found], pa.int64()))
                cols = [pa.array([r[k] for r in found], t) for k, t in ((2, pa.int32()), (3, pa.int32()), (4, pa.bool_()), (5, pa.float64()))]
                yield pa.RecordBatch.from_arrays([ids, pa.array([items.ids[r[1]] for r in found], pa.int64()), *cols], ["doc_id", "item_id", "words_common", "item_words", "answer_found", "cosine"])
            release()

        out = out.unionByName(docs.select("doc_id", "text").mapInArrow(run, schema))
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that contain no benchmark item; all columns stay, in one pass without a shuffle. Null and empty texts stay."""
    space = latent_space(docs)
    for rows in item_blocks(benchmark):
        items = prepare(rows, space)
        if not items.ids:
            continue
        shared = docs.sparkSession.sparkContext.broadcast((space, items))
        at = docs.columns.index("text")

        def run(batches: Iterator[pa.RecordBatch], shared=shared, at=at) -> Iterator[pa.RecordBatch]:
            space, items = shared.value
            for batch in batches:
                clean = np.ones(batch.num_rows, dtype=bool)
                clean[[r[0] for r in leaks_of_batch(batch.column(at), space, items)]] = False
                yield batch.filter(pa.array(clean))
            release()

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    """Benchmark items found in all documents."""
    from lorewell.session import table

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
