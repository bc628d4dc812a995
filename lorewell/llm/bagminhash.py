"""Near-duplicates by BagMinHash signatures of weighted shingles (operator 7)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.llm.common import MIX1, ODD, arrow_text, keep, mix, release, stash, text_batches, text_slices, uniform, unstash, word_hashes
from lorewell.llm.components import components

SHINGLE = 5
LEAST = 0.8
#: Signature of BANDS * ROWS components. At similarity 0.8 a pair misses every band with probability 7e-5.
BANDS, ROWS = 24, 5
SLICE = 2 << 20
#: Members that are compared with one centre in one group.
GROUP = 512
#: Members of a bucket in one block, and the agreement of signatures from which a pair is compared exactly: a pair of
#: similarity LEAST is below it with probability 1.6e-5, less than the bands miss.
MEMBERS, LOOK = 1024, 0.64
BITS = np.uint64(20)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The multiset of word shingles of each document: (document, shingle, count), sorted by document and shingle.

    Words are runs without ASCII white space, capitals of ASCII and Latin-1 as small letters. A document of fewer words has one
    shingle of all of them; one without words has none. Shingles are 44-bit hashes.
    """
    h, docs, _, _ = word_hashes(data, offsets)
    n = len(offsets) - 1
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    words = np.bincount(docs, minlength=n)
    first = np.cumsum(words) - words
    place = np.arange(len(h)) - first[docs]
    full = place + width <= words[docs]
    single = (place == 0) & (words[docs] < width)
    acc = np.zeros(len(h), np.uint64)
    for i in range(width):
        acc = acc * ODD
        if i < len(h):
            acc[: len(h) - i] += h[i:] * MIX1 if i else h * MIX1
    out = mix(acc)
    at = np.flatnonzero(single)
    if len(at):
        last = words[docs[at]]
        folded = np.zeros(len(at), np.uint64)
        for i in range(width - 1):
            has = i < last
            folded[has] = mix(folded[has] * ODD + h[at[has] + i])
        out[at] = mix(folded ^ last.astype(np.uint64))
    use = np.flatnonzero(full | single)
    keys = (docs[use].astype(np.uint64) << np.uint64(44)) | (out[use] >> BITS)
    keys.sort()
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    uniq = keys[new]
    return (uniq >> np.uint64(44)).astype(np.int64), uniq & np.uint64((1 << 44) - 1), np.diff(np.append(new, len(keys)))


def signatures(doc: np.ndarray, shingle: np.ndarray, count: np.ndarray, n: int, size: int = BANDS * ROWS) -> np.ndarray:
    """BagMinHash of each document's multiset: n x size arrival times, infinite for documents without shingles.

    Weights are cut into dyadic levels (0, 1], (1, 2], (2, 4], ... For a shingle, each level is a Poisson process of
    the level's width whose points carry a component and a height within the level, drawn by hashes of shingle, level and
    rank; a document sees the points whose height its count reaches. A component keeps the first point it
    sees, so two documents agree on it with probability sum(min) / sum(max). Points are drawn up to a time by
    which all components should be hit, and later where some are not.
    """
    total = np.bincount(doc, weights=count, minlength=n)
    sig = np.full((n, size), np.inf)
    top = np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64) + 1
    el = np.repeat(np.arange(len(doc)), top)
    level = np.arange(len(el)) - np.repeat(np.cumsum(top) - top, top)
    width = np.where(level == 0, 1.0, 2.0 ** (level - 1))
    seed0 = mix(shingle[el] * ODD + level.astype(np.uint64))
    below = np.where(level == 0, 0.0, 2.0 ** (level - 1))
    horizon = np.zeros(n)
    todo = total > 0
    goal = np.where(todo, size * (np.log(size) + 3.0) / np.maximum(total, 1), 0.0)
    state_t = np.zeros(len(el))
    state_k = np.zeros(len(el), np.uint64)
    flat = sig.ravel()
    while todo.any():
        live = np.flatnonzero(todo[doc[el]])
        t, k, seed, d, w = state_t[live], state_k[live], seed0[live], doc[el[live]], width[live]
        reach = goal[d]
        height = (count[el[live]] - below[live]) / w
        while len(live):
            draw = mix(seed + (k + np.uint64(1)) * ODD)
            nt = t - np.log(uniform(draw)) / w
            hit = nt <= reach
            # what comes too late is drawn again from the same rank when the horizon is moved
            state_t[live[~hit]], state_k[live[~hit]] = t[~hit], k[~hit]
            live, t, k, seed, d, w, reach, height, draw = (x[hit] for x in (live, nt, k, seed, d, w, reach, height, draw))
            second = mix(draw ^ MIX1)
            seen = uniform(mix(second)) <= height
            comp = ((second >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
            np.minimum.at(flat, (d * size + comp)[seen], t[seen])
            k = k + np.uint64(1)
        horizon[todo] = goal[todo]
        todo &= np.isinf(sig).any(1)
        goal[todo] *= 1.7
    return sig


def bands(sig: np.ndarray, n_bands: int = BANDS) -> np.ndarray:
    """One hash for each band of a signature."""
    bits = np.ascontiguousarray(sig).view(np.uint64).reshape(len(sig), n_bands, -1)
    h = np.broadcast_to(np.arange(n_bands, dtype=np.uint64), bits.shape[:2]).copy()
    for i in range(bits.shape[2]):
        h = mix((h ^ bits[:, :, i]) * ODD)
    return h.view(np.int64)


def sketch(docs: DataFrame) -> DataFrame:
    """(doc_id, h1, h2, bands, sig) of (doc_id, text); h1 and h2 tell equal texts, bands is empty without words, and sig has
    eight bits of each component."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(77), "text").alias("h2"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = arrow_text(batch.column("text"))
            parts, has, short = [], [], []
            for i, j in text_slices(offsets, SLICE):
                lo, hi = offsets[i], offsets[j]
                doc, s, c = shingles(data[lo:hi], offsets[i : j + 1] - lo)
                sig = signatures(doc, s, c, j - i)
                parts.append(bands(sig))
                short.append((mix(sig.view(np.uint64)) >> np.uint64(56)).astype(np.uint8))
                has.append(np.bincount(doc, minlength=j - i) > 0)
            if not parts:
                continue
            lists = np.concatenate(parts)
            some = np.concatenate(has)
            ends = np.concatenate([[0], np.cumsum(np.where(some, BANDS, 0))]).astype(np.int32)
            arrays = pa.ListArray.from_arrays(pa.array(ends), pa.array(lists[some].ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h1"), batch.column("h2"), arrays, pa.array([x.tobytes() for x in np.concatenate(short)], pa.binary())], ["doc_id", "h1", "h2", "bands", "sig"])
        release()

    return rows.mapInArrow(run, "doc_id long, h1 long, h2 long, bands array<long>, sig binary")


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets (sorted shingles, counts)."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
    same = a[0][at] == b[0]
    shared = np.minimum(a[1][at[same]], b[1][same]).sum()
    return float(shared / (a[1].sum() + b[1].sum() - shared))


def verify(pairs: DataFrame, texts: DataFrame, least: float = LEAST) -> DataFrame:
    """Of the candidate pairs (a, b), those whose texts (id, text) are that similar, with sim.

    The pairs of a centre a are dealt to groups of about GROUP members; each group reads the centre's text once, and
    then one text after another.
    """
    many = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP)
    dealt = pairs.join(many, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce(F.ceil(F.col("n") / GROUP), F.lit(1))).alias("salt"))
    centres = dealt.select("a", "salt").distinct().select(F.col("a").alias("id"), "salt", "a", F.lit(None).cast("long").alias("b"))
    rows = centres.unionByName(dealt.select(F.col("b").alias("id"), "salt", "a", "b")).join(texts, "id").select("a", "salt", "b", "text")
    sorted_rows = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, group = (np.zeros(0, np.uint64), np.zeros(0, np.int64)), None
        for batch in batches:
            data, offsets = arrow_text(batch.column("text"))
            a, salt, b = batch.column("a").to_pylist(), batch.column("salt").to_pylist(), batch.column("b").to_pylist()
            out: list[tuple[int, int, float]] = []
            for i, j in text_slices(offsets, SLICE):
                doc, s, c = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                at = np.searchsorted(doc, np.arange(j - i + 1))
                for x in range(i, j):
                    own = s[at[x - i] : at[x - i + 1]], c[at[x - i] : at[x - i + 1]]
                    if b[x] is None:
                        centre, group = own, (a[x], salt[x])
                    elif group == (a[x], salt[x]) and (sim := overlap(centre, own)) >= least:
                        out.append((a[x], b[x], sim))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.float64())], ["a", "b", "sim"])

    return sorted_rows.mapInArrow(run, "a long, b long, sim double")


def first_candidates(buckets: DataFrame) -> DataFrame:
    """One pair (a, b) for each document: the first, in a random order, of all that share a bucket with it."""
    centres = buckets.groupBy("bh").agg(F.min(F.struct(F.xxhash64("id").alias("o"), "id")).alias("c"))
    best = buckets.join(centres, "bh").groupBy("id").agg(F.min("c").alias("c"))
    return best.where("c.id != id").select(F.col("c.id").alias("a"), F.col("id").alias("b"))


def alike(sig: np.ndarray, root: np.ndarray, bands: np.ndarray, bh: int, first: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, estimate): all pairs x < y of a cell's rows of different components whose signatures agree by LOOK or more,
    and whose first common bucket is bh, so that a pair comes up once. first: the first so many rows meet the others only."""
    columns = np.ascontiguousarray(sig.T)
    xs, ys, es = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for lo in range(0, first or len(sig), 128):
        hi, start = min(lo + 128, first or len(sig)), first or lo
        same = np.zeros((hi - lo, len(sig) - start), np.uint8)
        for c in columns:
            same += c[lo:hi, None] == c[None, start:]
        estimate = (same / len(columns) - 1 / 256) / (1 - 1 / 256)
        x, y = np.nonzero((estimate >= LOOK) & (root[lo:hi, None] != root[None, start:]))
        e = estimate[x, y]
        x, y = x + lo, y + start
        x, y, e = x[y > x], y[y > x], e[y > x]
        for i in range(0, len(x), 50_000):
            u, v = x[i : i + 50_000], y[i : i + 50_000]
            common = (bands[u] == bands[v]).argmax(1)
            own = bands[u, common] == bh
            xs.append(u[own])
            ys.append(v[own])
            es.append(e[i : i + 50_000][own])
    return np.concatenate(xs), np.concatenate(ys), np.concatenate(es)


CELL = ["bh", "i", "j"]


def by_cell(batches: Iterator[pa.RecordBatch], shrink=None) -> Iterator[dict[str, list]]:
    """The rows of one cell after another, from batches sorted by cell; shrink adds columns to a batch when it is read."""
    held: dict[str, list] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = {c: batch.column(c).to_numpy() for c in (*CELL, "k", "id", "h1", "root")}
        for c in ("sig", "bands"):
            kind = np.uint8 if c == "sig" else np.int64
            cols[c] = np.frombuffer(b"".join(batch.column(c).to_pylist()), kind).reshape(batch.num_rows, -1)
        if shrink:
            cols |= shrink(batch)
        cut = np.flatnonzero(np.any([cols[c][1:] != cols[c][:-1] for c in CELL], axis=0)) + 1
        for k, m in zip(np.append(0, cut), np.append(cut, batch.num_rows), strict=True):
            if held and any(held[c][-1][-1] != cols[c][k] for c in CELL):
                yield held
                held = {}
            for c, v in cols.items():
                held.setdefault(c, []).append(v[k:m])
    if held:
        yield held


def first_side(c: dict[str, np.ndarray]) -> int:
    """The rows of a cell's first block, where it has two."""
    return int((c["k"] == c["i"]).sum()) if c["i"][0] != c["j"][0] else 0


def cells(rooted: DataFrame, members: int) -> DataFrame:
    """(bh, i, j, k, id, h1, root): the buckets of several components as cells of block i against block j; k is the row's own block.

    A bucket of `members` or fewer is one cell. A larger one is cut into blocks, those of its largest component apart: every
    block of the others meets every block, and only the largest component's own ones never meet each other.
    """
    sizes = rooted.groupBy("bh", "root").agg(F.count(F.lit(1)).alias("n"))
    most = sizes.groupBy("bh").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("roots"), F.max(F.struct("n", "root")).alias("big")).where("roots > 1")
    rows = rooted.join(most, "bh")
    small, main = F.col("n") <= members, F.col("root") == F.col("big.root")
    others = F.when(small, 1).otherwise(F.ceil((F.col("n") - F.col("big.n")) / members)).cast("int")
    blocks = others + F.when(small, 0).otherwise(F.ceil(F.col("big.n") / members)).cast("int")
    k = F.when(small, 0).when(main, others + F.pmod(F.xxhash64("id"), blocks - others)).otherwise(F.pmod(F.xxhash64("id"), others)).cast("int")
    last = F.when(~small & main, others).otherwise(blocks) - 1
    met = rows.select("bh", "id", "h1", "root", k.alias("k"), F.explode(F.sequence(F.lit(0), last)).alias("m"))
    return met.select("bh", F.least("k", "m").alias("i"), F.greatest("k", "m").alias("j"), "k", "id", "h1", "root").distinct()


def close_rows(rows: DataFrame) -> DataFrame:
    """(bh, i, j, id, h1) of the rows that have a pair to be compared in their cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in by_cell(batches):
            c = {k: np.concatenate(v) for k, v in held.items()}
            x, y, _ = alike(c["sig"], c["root"], c["bands"], c["bh"][0], first_side(c))
            at = np.unique(np.concatenate([x, y]))
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(c[k][at]) for k in (*CELL, "id", "h1")], [*CELL, "id", "h1"])

    return rows.repartition(*CELL).sortWithinPartitions(*CELL, "k", "id", "h1").mapInArrow(run, "bh long, i int, j int, id long, h1 long")


def links_of_cells(rows: DataFrame, least: float = LEAST) -> DataFrame:
    """Links (a, b) of the rows with texts: every pair of a cell is compared exactly, the most similar by signature first, unless
    links already found in the cell join its ends."""

    def read(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        data, offsets = arrow_text(batch.column("text"))
        multisets, total = np.empty(batch.num_rows, object), np.zeros(batch.num_rows, np.int64)
        for i, j in text_slices(offsets, SLICE):
            doc, s, c = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            at = np.searchsorted(doc, np.arange(j - i + 1))
            for x in range(i, j):
                k, m = at[x - i : x - i + 2]
                multisets[x], total[x] = (s[k:m].copy(), c[k:m].astype(np.int32)), c[k:m].sum()
        return {"multiset": multisets, "total": total}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in by_cell(batches, read):
            c = {k: np.concatenate(v) for k, v in held.items()}
            x, y, e = alike(c["sig"], c["root"], c["bands"], c["bh"][0], first_side(c))
            t = c["total"]
            # sizes alone rule a pair out exactly
            fit = np.minimum(t[x], t[y]) >= least * np.maximum(t[x], t[y])
            x, y, e = x[fit], y[fit], e[fit]
            order = np.argsort(-e, kind="stable")
            parent = np.unique(c["root"], return_inverse=True)[1]
            up, sets, found = list(range(parent.max() + 1)), c["multiset"], []

            def top(k: int, up=up) -> int:
                while up[k] != k:
                    up[k] = up[up[k]]
                    k = up[k]
                return k

            tree = parent.tolist()
            for u, v in zip(x[order].tolist(), y[order].tolist(), strict=True):
                p, q = top(tree[u]), top(tree[v])
                if p != q and overlap(sets[u], sets[v]) >= least:
                    up[p] = q
                    found.append((u, v))
            if found:
                at = np.array(found)
                yield pa.RecordBatch.from_arrays([pa.array(c["id"][at[:, 0]]), pa.array(c["id"][at[:, 1]])], ["a", "b"])

    return rows.repartition(*CELL).sortWithinPartitions(*CELL, "k", "id", "h1").mapInArrow(run, "a long, b long")


def packed(known: DataFrame) -> DataFrame:
    """(id, h1, sig, bands) of (id, h1, sig, _b), the bands as bytes of little-endian longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("_b").flatten().to_numpy(zero_copy_only=False).astype("<i8").reshape(-1, BANDS)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("h1"), batch.column("sig"), pa.array([r.tobytes() for r in raw], pa.binary())], ["id", "h1", "sig", "bands"])

    return known.mapInArrow(run, "id long, h1 long, sig binary, bands binary")


def tight(df: DataFrame, rows: int) -> DataFrame:
    """As few partitions as so many small rows need."""
    return df.coalesce(max(1, -(-rows // 100_000)))


def near_duplicates(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, class_id): documents whose 5-word shingles overlap by `least` or more are linked, and linked ones form a class.

    class_id is the least doc_id of the class. Equal texts are one class and enter the search once; texts without a
    word, null ones too, are each alone, and rows of one doc_id are one document. A null doc_id has class null.
    """
    spark = docs.sparkSession
    text_batches(spark)
    sk = keep(sketch(docs.select("doc_id", "text")))
    rows = sk.where("doc_id is not null and size(bands) > 0")
    groups = keep(rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    # a group of countless copies is dealt in pieces wherever its members meet what is known of the group
    pieces = F.ceil(F.col("n") / GROUP)
    copies = rows.select("doc_id", "h1", "h2").join(groups, ["h1", "h2"]).where("doc_id != rep")
    member = keep(copies.select("doc_id", "rep", F.pmod(F.xxhash64("doc_id"), pieces).alias("piece")).distinct())
    single = rows.join(member.select("doc_id"), "doc_id", "left_anti")
    exploded = single.select(F.col("doc_id").alias("id"), "h1", F.explode("bands").alias("bh"))
    # only buckets of two members or more go on
    shared = exploded.groupBy("bh").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bh")
    buckets = keep(exploded.join(shared, "bh", "left_semi"))
    texts, path = stash(docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h1"), "text").join(buckets.select("id").distinct(), "id", "left_semi"))
    known = single.select(F.col("doc_id").alias("id"), "h1", "sig", F.col("bands").alias("_b")).dropDuplicates(["id", "h1"])
    roots = None

    def joined(found: DataFrame, roots: DataFrame | None) -> DataFrame | None:
        """Components of links and of earlier components, which stand in for their links."""
        m = found.count()
        if not m:
            return roots
        found = tight(found, m)
        edges = found if roots is None else found.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
        out = keep(components(edges))
        return tight(out, out.count())

    pairs = keep(first_candidates(buckets))
    n = pairs.count()
    if n:
        # a mate for each joins most of them cheaply; then whatever is still apart is compared, all with all
        roots = joined(keep(verify(tight(pairs, n), texts, least).select("a", "b")), roots)
        rooted = buckets.withColumn("root", F.col("id")) if roots is None else buckets.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
        dealt = keep(cells(rooted, MEMBERS))
        close = keep(close_rows(dealt.join(packed(known), ["id", "h1"])))
        if not close.isEmpty():
            # few rows have anything to be compared with; only their texts travel
            some = texts.join(close.select("id", "h1").distinct(), ["id", "h1"], "left_semi").dropDuplicates(["id", "h1"])
            full = close.join(dealt, [*CELL, "id", "h1"]).join(packed(known), ["id", "h1"]).join(some, ["id", "h1"])
            roots = joined(keep(links_of_cells(full, least)), roots)
    unstash(spark, path)
    if roots is None:
        named = member.select("doc_id", "rep")
    else:
        known_root = groups.join(roots.select(F.col("node").alias("rep"), "root"), "rep").select("rep", "root", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)).alias("piece"))
        named = member.join(known_root, ["rep", "piece"], "left").select("doc_id", F.coalesce("root", "rep").alias("rep"))
        named = named.unionByName(roots.join(member.select(F.col("doc_id").alias("node")), "node", "left_anti").select(F.col("node").alias("doc_id"), F.col("root").alias("rep")))
    return sk.select("doc_id").join(named, "doc_id", "left").select("doc_id", F.coalesce("rep", "doc_id").alias("class_id"))


def one_of_each(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """One document of each class, that of the least doc_id; all columns stay, whatever their names. Rows without a doc_id stay;
    of several rows of one doc_id the one of the least hash of its text does."""
    gone = near_duplicates(docs, least).where("doc_id != class_id").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti")
    repeated = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 and doc_id is not null")
    if repeated.isEmpty():
        return left
    # only repeated ids are grouped, and their rows combine before they meet
    again = left.join(repeated.select("doc_id"), "doc_id", "left_semi")
    first = again.select(F.struct("*").alias("doc")).groupBy("doc.doc_id").agg(F.min_by("doc", F.xxhash64("doc.text")).alias("doc")).select("doc.*")
    return left.join(repeated.select("doc_id"), "doc_id", "left_anti").unionByName(first)


def op7_bagminhash(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    from lorewell.session import table

    return near_duplicates(table(spark, sf_dir, "documents"))
