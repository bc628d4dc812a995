"""Removal of repeated byte strings by column-wise multi-document suffix sorting (operator 2).

Every string of LENGTH bytes holds one anchor: the leftmost of its K-byte substrings with the least hash. So equal strings
have equal anchors at equal offsets, and the strings of one anchor lie side by side once their texts are aligned on
it. The aligned texts ("pieces") are the documents of the column-wise construction: from the last column to the first,
each round takes one symbol of every piece and updates the order of the pieces' suffixes and the common prefixes of
neighbours. Neighbours that share LENGTH bytes or more at a column hold equal strings there.

The order is positional: only suffixes that start at the same column are compared, for equal strings always do. A transform of the
whole collection is not written, see the README for why.

Anchors that only one text holds cannot repeat, and their pieces are never sent. Pieces that are equal within a part
of the input are sent once, and those that are equal across parts are compared once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.llm.common import MIX2, ODD, arrow_text, keep, mix, text_batches, text_slices

#: Length of strings and of anchors; windows of so many anchor positions.
LENGTH, K = 100, 32
SPAN = LENGTH - K + 1
COLUMNS = 2 * (SPAN - 1) + K
#: Bytes of text of a part, of a slice of array work, pieces of a block of the construction, and anchors that are sent together.
PART_BYTES, SLICE, BLOCK, SENT = 16 << 20, 256 << 10, 60_000, 600_000
#: An anchor of so many texts is hot: its strings are dealt by more of what they hold (see RANGES).
HOT = 1_000
#: Ranges of a string's bytes ahead of its anchor. They part where the bytes ahead or behind double, so the bytes that all
#: strings of a range share hold at least half of what any of them has on either side: texts that agree around a hot anchor
#: but differ further out part company.
RANGES = sorted({0, *(2**i for i in range(7)), *(SPAN - 2**i for i in range(7))})
RANGES = [(a, b - 1) for a, b in zip(RANGES, [*RANGES[1:], SPAN], strict=True)]


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings that share an anchor: (anchor hash, document, anchor position, first start, last start)."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return np.zeros(0, np.uint64), none, none, none, none
    h = data.astype(np.uint64) + np.uint64(1)
    power, width = int(ODD), 1
    while width < K:
        # in place: h[i] becomes the hash of 2 * width bytes from i
        m = len(h) - width
        h = h[:m] * np.uint64(power) + h[width:]
        power = power * power % (1 << 64)
        width *= 2
    full = mix(h ^ MIX2)
    low = np.uint64(127)
    key = full & ~low
    width = 1
    while 2 * width <= SPAN:
        key = np.minimum(key[: len(key) - width], key[width:] + np.uint64(width))
        width *= 2
    if width < SPAN:
        rest = SPAN - width
        key = np.minimum(key[: len(key) - rest], key[rest:] + np.uint64(rest))
    # strings that end within their document
    starts = np.arange(len(key))
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(key)]
    ok = np.flatnonzero(starts + LENGTH <= offsets[doc + 1])
    if not len(ok):
        return np.zeros(0, np.uint64), none, none, none, none
    at = ok + (key[ok] & low).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (ok[1:] != ok[:-1] + 1)]))
    last = np.append(new[1:], len(ok)) - 1
    return full[at[new]], doc[ok[new]], at[new], ok[new], ok[last]


def part_of(parts: int):
    """A text's part, by id and tie, so that rows without an id spread like all others."""
    return F.pmod(F.xxhash64("id", "tie"), F.lit(parts)).cast("int")


def repeated_anchors(docs: DataFrame, parts: int) -> DataFrame:
    """(part, blob, hot): the anchor hashes of each part's documents that two texts hold, or one text twice; and the hot ones.

    docs has id, tie and text. Anchors travel as arrays by ranges of their hashes, each once per batch and text.
    """
    ranges = int(max(parts, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    def blobs(cols: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        h, t, p = (np.concatenate(c) for c in zip(*cols, strict=True))
        # by the lower bits: anchors are least hashes, so their upper bits are small
        to = ((h & np.uint64(0xFFFFFFFF)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
        order = np.lexsort((t, h, p, to))
        h, t, p, to = h[order], t[order], p[order], to[order]
        same = np.concatenate([[False], (h[1:] == h[:-1]) & (t[1:] == t[:-1]) & (p[1:] == p[:-1])])
        # an anchor that a text holds twice goes with a mark
        twice = np.concatenate([same[1:], [False]]) | same
        first = np.flatnonzero(~same)
        h, t, p, to, twice = h[first], t[first], p[first], to[first], twice[first]
        cut = np.flatnonzero(np.concatenate([[True], (to[1:] != to[:-1]) | (p[1:] != p[:-1])]))
        ends = np.append(cut[1:], len(h))
        rows = [(int(to[a]), int(p[a]), h[a:b].tobytes(), t[a:b].tobytes(), np.packbits(twice[a:b]).tobytes()) for a, b in zip(cut, ends, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["r", "part", "h", "t", "m"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: list[tuple[np.ndarray, ...]] = []
        held = 0
        for batch in batches:
            data, offsets = arrow_text(batch.column("text"))
            part = batch.column("part").to_numpy()
            tie = batch.column("tie").to_numpy().view(np.uint64)
            for i, j in text_slices(offsets, SLICE):
                h, d, _, _, _ = anchors(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                cols.append((h, tie[i:j][d], part[i:j][d]))
                held += len(h)
                if held >= SENT:
                    yield blobs(cols)
                    cols, held = [], 0
        if held:
            yield blobs(cols)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for r, part, h, t, m in zip(*(batch.column(c).to_pylist() for c in ("r", "part", "h", "t", "m")), strict=True):
                hs = np.frombuffer(h, np.uint64)
                got.setdefault(r, []).append((part, hs, np.frombuffer(t, np.uint64), np.unpackbits(np.frombuffer(m, np.uint8), count=len(hs)).astype(bool)))
        for rows in got.values():
            h = np.concatenate([x[1] for x in rows])
            t = np.concatenate([x[2] for x in rows])
            m = np.concatenate([x[3] for x in rows])
            order = np.lexsort((t, h))
            hs, ts = h[order], t[order]
            keys, often = np.unique(hs, return_counts=True)
            hot = keys[often >= HOT]
            differ = (hs[1:] == hs[:-1]) & (ts[1:] != ts[:-1])
            again = np.unique(np.concatenate([hs[1:][differ], h[m]]))
            if not len(again):
                continue
            # back to every part that holds one of them
            p = np.repeat([x[0] for x in rows], [len(x[1]) for x in rows])
            hit = again[np.minimum(np.searchsorted(again, h), len(again) - 1)] == h
            h, p = h[hit], p[hit]
            order = np.lexsort((h, p))
            h, p = h[order], p[order]
            cut = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
            sent = np.split(h, cut[1:])
            yield pa.RecordBatch.from_arrays([pa.array(p[cut], pa.int32()), pa.array([x.tobytes() for x in sent], pa.binary()), pa.array([x[np.isin(x, hot)].tobytes() for x in sent], pa.binary())], ["part", "blob", "hot"])

    sent = docs.select(part_of(parts).alias("part"), "tie", "text").mapInArrow(send, "r int, part int, h binary, t binary, m binary")
    return sent.repartition(ranges, "r").mapInArrow(answer, "part int, blob binary, hot binary")


PIECE = "anchor long, id long, tie long, at long, lead int, more int, bytes binary, lo long, hi long"


def piece_rows(table: pa.Table, side: pa.Table) -> pa.Table:
    """The pieces of one part. Rows with bytes are to be compared; those without are known to repeat an earlier piece,
    and lo to hi are the bytes that this removes."""
    empty = [("anchor", pa.int64()), ("id", pa.int64()), ("tie", pa.int64()), ("at", pa.int64()), ("lead", pa.int32()), ("more", pa.int32()), ("bytes", pa.binary()), ("lo", pa.int64()), ("hi", pa.int64())]
    blobs = [np.frombuffer(b, np.uint64) for b in side.column("blob").to_pylist() if b is not None]
    if not blobs or not table.num_rows:
        return pa.Table.from_pylist([], schema=pa.schema(empty))
    again = np.unique(np.concatenate(blobs))
    hot = set(np.concatenate([np.frombuffer(b, np.uint64) for b in side.column("hot").to_pylist() if b is not None]).tolist())
    gone = {(i, t) for i, t, b in zip(side.column("id").to_pylist(), side.column("tie").to_pylist(), side.column("blob").to_pylist(), strict=True) if b is None}
    table = table.sort_by([("id", "ascending"), ("tie", "ascending")])
    ids, ties = table.column("id").to_numpy(), table.column("tie").to_numpy()
    data, offsets = arrow_text(table.column("text"))
    text = data.tobytes()
    alive = np.ones(len(ids), dtype=bool)
    alive[1:] &= (ids[1:] != ids[:-1]) | (ties[1:] != ties[:-1])
    if gone:
        alive &= np.array([(i, t) not in gone for i, t in zip(ids.tolist(), ties.tolist(), strict=True)], dtype=bool)
    seen: set[tuple[int, bytes]] = set()
    sent: list[tuple] = []
    known: list[list[int]] = []

    def add(key: int, doc: int, at: int, lo: int, hi: int) -> None:
        """The strings that start from lo to hi, at their anchor."""
        raw = text[lo : hi + LENGTH]
        start = int(offsets[doc])
        if (at - lo, raw) not in seen:
            seen.add((at - lo, raw))
            sent.append((key, int(ids[doc]), int(ties[doc]), at - start, at - lo, hi - lo, raw))
        elif known and known[-1][0] == doc and known[-1][1] <= lo - start <= known[-1][2]:
            known[-1][2] = max(known[-1][2], hi + LENGTH - start)
        else:
            known.append([doc, lo - start, hi + LENGTH - start])

    for i, j in text_slices(offsets, SLICE):
        base = offsets[i]
        h, d, at, first, last = anchors(data[base : offsets[j]], offsets[i : j + 1] - base)
        hit = np.flatnonzero(alive[i:j][d] & (again[np.minimum(np.searchsorted(again, h), len(again) - 1)] == h)) if len(h) else []
        if not len(hit):
            continue
        for key, doc, a, lo, hi in zip(h[hit].tolist(), (d[hit] + i).tolist(), (at[hit] + base).tolist(), (first[hit] + base).tolist(), (last[hit] + base).tolist(), strict=True):
            if key not in hot:
                add(key, doc, a, lo, hi)
                continue
            for n, (near, far) in reversed(list(enumerate(RANGES))):
                x, y = max(lo, a - far), min(hi, a - near)
                if x <= y:
                    add(xxhash.xxh3_64_intdigest(text[a - near : a - far + LENGTH], seed=n), doc, a, x, y)
    cols = list(zip(*sent, strict=True)) if sent else [()] * 7
    docs = [k[0] for k in known]
    key = np.array(cols[0], dtype=np.uint64).view(np.int64)
    left = [pa.array(key), *(pa.array(c, k) for c, (_, k) in zip(cols[1:], empty[1:7], strict=True)), pa.nulls(len(sent), pa.int64()), pa.nulls(len(sent), pa.int64())]
    right = [pa.nulls(len(docs), k) for _, k in empty]
    right[0] = pa.array((ids[docs].view(np.uint64) * ODD).view(np.int64), pa.int64())
    right[1], right[2] = pa.array(ids[docs], pa.int64()), pa.array(ties[docs], pa.int64())
    right[7], right[8] = pa.array([k[1] for k in known], pa.int64()), pa.array([k[2] for k in known], pa.int64())
    return pa.concat_tables([pa.Table.from_arrays(c, names=[n for n, _ in empty]) for c in (left, right)])


def covered(lead: np.ndarray, more: np.ndarray, rank: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Which strings of the pieces also start earlier: a row for each piece, a column for each place of the anchor.

    matrix has the pieces' bytes aligned on the anchor, lead the bytes ahead of the anchor and more the strings that
    follow the first; rank orders the pieces by document and place. The columns are taken one after another, the last first.
    """
    k = len(lead)
    out = np.zeros((k, SPAN), dtype=bool)
    first = SPAN - 1 - lead
    order = np.arange(k)
    prefix = np.zeros(k + 1, dtype=np.uint8)
    columns = np.ascontiguousarray(matrix.T)
    for column in range(COLUMNS - 1, -1, -1):
        symbol = columns[column][order]
        move = np.argsort(symbol, kind="stable")
        order = order[move]
        moved = symbol[move]
        # the prefix that neighbours share: the least between them before, and one more, if their symbols agree
        least = np.minimum.reduceat(prefix, move + 1)
        prefix[1:k] = np.where(moved[1:] == moved[:-1], np.minimum(least[:-1], LENGTH - 1) + 1, 0)
        prefix[0] = 0
        if column < SPAN:
            live = (first[order] <= column) & (column <= first[order] + more[order])
            # pieces that share LENGTH bytes are one run
            run = np.flatnonzero(prefix[:k] < LENGTH)
            if len(run) == k:
                continue
            place = np.where(live, rank[order], k)
            earliest = np.minimum.reduceat(place, run)
            length = np.diff(np.append(run, k))
            out[order, column] = live & (place > np.repeat(earliest, length))
    return out


def compare(pieces: pa.Table) -> pa.RecordBatch:
    """(id, tie, lo, hi): the bytes of a block of pieces (whole anchors) that repeat."""
    ids, ties, at = (pieces.column(c).to_numpy() for c in ("id", "tie", "at"))
    lead, more = (pieces.column(c).to_numpy().astype(np.int64) for c in ("lead", "more"))
    k = len(ids)
    raw = pieces.column("bytes").combine_chunks()
    offsets = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + k + 1].astype(np.int64)
    data = np.frombuffer(raw.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    length = np.diff(offsets)
    begin = np.arange(k) * COLUMNS + (SPAN - 1 - lead)
    matrix = np.zeros(k * COLUMNS, np.uint8)
    matrix[np.repeat(begin - (offsets[:-1] - offsets[0]), length) + np.arange(length.sum())] = data
    rank = np.empty(k, np.int64)
    rank[np.lexsort((at, ties, ids))] = np.arange(k)
    hit = covered(lead, more, rank, matrix.reshape(k, COLUMNS))
    padded = np.zeros((k, SPAN + 2), dtype=np.int8)
    padded[:, 1:-1] = hit
    edge = np.diff(padded, axis=1)
    row, lo = np.nonzero(edge == 1)
    _, hi = np.nonzero(edge == -1)
    base = at[row] - (SPAN - 1)
    return pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(ties[row]), pa.array(base + lo), pa.array(base + hi - 1 + LENGTH)], ["id", "tie", "lo", "hi"])


SPANS = ["id", "tie", "lo", "hi"]


def spans_of(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    """compare() over a list of batches."""
    table = pa.Table.from_batches(held).combine_chunks()
    return compare(table) if table.num_rows else pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 4, SPANS)


def again_of(batch: pa.RecordBatch, before: tuple | None) -> np.ndarray:
    """Which rows of a sorted batch have the anchor, lead and bytes of the row ahead of them; before: that of the batch ahead."""
    anchor, lead, raw = batch.column("anchor").to_numpy(), batch.column("lead").to_numpy(), batch.column("bytes")
    out = np.zeros(len(anchor), bool)
    same = np.flatnonzero((anchor[1:] == anchor[:-1]) & (lead[1:] == lead[:-1])) + 1
    out[same] = pc.equal(raw.take(pa.array(same)), raw.take(pa.array(same - 1))).to_numpy(zero_copy_only=False)
    out[0] = before == (int(anchor[0]), int(lead[0]), raw[0].as_py())
    return out


def repeated_spans(pieces: DataFrame) -> DataFrame:
    """(id, tie, lo, hi) of all pieces. A task sorts its pieces by anchor and bytes and builds them in blocks of whole anchors;
    what is known already passes, and of equal pieces only the earliest enters, so that an anchor that all parts share costs
    no more memory than its different surroundings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n, before = 0, None
        for batch in batches:
            new = batch.column("bytes").is_valid()
            yield batch.filter(pc.invert(new)).select(SPANS)
            batch = batch.filter(new).select(["anchor", "id", "tie", "at", "lead", "more", "bytes"])
            if not batch.num_rows:
                continue
            again = again_of(batch, before)
            before = tuple(batch.column(c)[-1].as_py() for c in ("anchor", "lead", "bytes"))
            if again.any():
                copies = batch.filter(pa.array(again))
                lo = copies.column("at").to_numpy() - copies.column("lead").to_numpy()
                yield pa.RecordBatch.from_arrays([copies.column("id"), copies.column("tie"), pa.array(lo), pa.array(lo + copies.column("more").to_numpy() + LENGTH)], SPANS)
                batch = batch.filter(pa.array(~again))
                if not batch.num_rows:
                    continue
            anchor = batch.column("anchor").to_numpy()
            if n + len(anchor) >= BLOCK:
                # cut where the last anchor of what is held begins
                cut = int(np.searchsorted(anchor, anchor[-1]))
                if cut or (held and held[-1].column("anchor")[-1].as_py() != anchor[0]):
                    held.append(batch.slice(0, cut))
                    yield spans_of(held)
                    held, n = [], 0
                    batch = batch.slice(cut)
            held.append(batch)
            n += batch.num_rows
        if n:
            yield spans_of(held)

    return pieces.repartition("anchor").sortWithinPartitions("anchor", "lead", "bytes", "id", "tie", "at").mapInArrow(run, "id long, tie long, lo long, hi long")


RESULT = "id long, tie long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<lo:long,hi:long>>"


def cut(table: pa.Table, side: pa.Table) -> pa.Table:
    """The result of each text of a part; side has its repeated bytes and, with null lo, texts to leave out."""
    ids, ties, lo, hi = (side.column(c).to_pylist() for c in ("id", "tie", "lo", "hi"))
    gone, found = set(), {}
    for i, t, a, b in zip(ids, ties, lo, hi, strict=True):
        if a is None:
            gone.add((i, t))
        else:
            found.setdefault((i, t), []).append((a, b))
    out = []
    for i, t, text in zip(table.column("id").to_pylist(), table.column("tie").to_pylist(), table.column("text").to_pylist(), strict=True):
        if (i, t) in gone:
            continue
        gone.add((i, t))
        raw = text.encode()
        spans: list[list[int]] = []
        for a, b in sorted(found.get((i, t), [])):
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], b)
            else:
                spans.append([a, b])
        digest, at = hashlib.sha256(), 0
        for a, b in spans:
            digest.update(raw[at:a])
            at = b
        digest.update(raw[at:])
        out.append({"id": i, "tie": t, "n_bytes": len(raw), "n_removed": sum(b - a for a, b in spans), "n_spans": len(spans), "kept_sha256": digest.hexdigest(), "spans": [{"lo": a, "hi": b} for a, b in spans]})
    span = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
    kinds = [pa.int64()] * 5 + [pa.string(), span]
    names = ["id", "tie", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
    return pa.Table.from_pylist(out, schema=pa.schema(list(zip(names, kinds, strict=True))))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) of (doc_id, text).

    A byte is removed if a string of LENGTH bytes over it also starts earlier: in a document of smaller doc_id, or earlier in
    its own. Equal texts of LENGTH bytes or more go whole but for the one of the least doc_id. A null text is empty; rows of
    one doc_id with different texts are ordered by a hash of the text, and a null doc_id comes last.
    """
    text_batches(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    last, least = F.lit((1 << 63) - 1), F.lit(-(1 << 63))
    # tie orders rows of one id, and those without an id behind the greatest one
    hashed = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), last).alias("id"), F.xxhash64(F.lit(2), text).bitwiseAND(last).alias("tie1"), text.alias("text"))
    rows = hashed.withColumn("tie", F.when(F.col("doc_id").isNull(), F.col("tie1")).otherwise(F.col("tie1").bitwiseOR(least)))
    n = F.octet_length("text").cast("long")
    meta = keep(rows.select("doc_id", "id", "tie", "tie1", F.xxhash64(F.lit(22), "text").alias("tie2"), n.alias("n_bytes"), F.when(n < LENGTH, F.sha2("text", 256)).alias("sha")))
    size = meta.agg(F.sum("n_bytes")).first()[0] or 0
    parts = max(1, -(-size // PART_BYTES))
    long_rows = meta.where(F.col("n_bytes") >= LENGTH)
    groups = keep(long_rows.groupBy("tie1", "tie2", "n_bytes").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    # every row of these texts, salted for texts with countless copies by splitting the join
    same = keep(long_rows.join(groups, ["tie1", "tie2", "n_bytes"]))
    copies = same.where("id != first")
    once = same.where("id = first").groupBy("doc_id", "id", "tie", "n_bytes").agg((F.count(F.lit(1)) - 1).alias("n")).where("n > 0").withColumn("_i", F.explode(F.expr("sequence(1L, n)"))).drop("n", "_i")
    gone = copies.select("id", "tie").distinct()
    texts = rows.where(n >= LENGTH).select("id", "tie", "text").withColumn("part", part_of(parts))
    blobs = repeated_anchors(texts, parts)
    nothing = F.lit(None)
    side = blobs.select("part", nothing.cast("long").alias("id"), nothing.cast("long").alias("tie"), "blob", "hot").unionByName(gone.select(part_of(parts).alias("part"), "id", "tie", nothing.cast("binary").alias("blob"), nothing.cast("binary").alias("hot")))
    # one plan up to the result: both passes over the texts of a part read the same shuffle
    pieces = texts.groupBy("part").cogroup(side.groupBy("part")).applyInArrow(piece_rows, PIECE)
    side2 = repeated_spans(pieces).unionByName(gone.select("id", "tie", nothing.cast("long").alias("lo"), nothing.cast("long").alias("hi"))).withColumn("part", part_of(parts))
    done = texts.groupBy("part").cogroup(side2.groupBy("part")).applyInArrow(cut, RESULT)
    none = F.expr("cast(array() as array<struct<lo:bigint,hi:bigint>>)")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("lo"), F.col("n_bytes").alias("hi")))
    empty = F.sha2(F.lit(""), 256)
    out = done.select(F.when((F.col("id") != last) | (F.col("tie") < 0), F.col("id")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")
    for frame in (copies, once):
        out = out.unionByName(frame.select("doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), empty.alias("kept_sha256"), whole.alias("spans")))
    short = meta.where(F.col("n_bytes") < LENGTH).select("doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("sha").alias("kept_sha256"), none.alias("spans"))
    return out.unionByName(short)


def op2_repeats(spark, sf_dir: str) -> DataFrame:
    """Repeated strings of 100 bytes removed from all documents."""
    from lorewell.session import table

    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("spans")


#: The contract string by string, in hexadecimal: two digits a byte.
OP2_SQL = """
WITH raw AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS x FROM documents),
strings AS (
  SELECT doc_id, i AS s, substr(x, 2 * i + 1, 200) AS w
  FROM (SELECT doc_id, x, unnest(range(0, greatest(0, length(x) // 2 - 99))) AS i FROM raw)),
again AS (
  SELECT doc_id, s FROM strings QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, s) > 1),
marked AS (
  SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 0 ELSE 1 END AS fresh FROM again),
runs AS (
  SELECT doc_id, min(s) AS lo, max(s) + 100 AS hi
  FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS run FROM marked) GROUP BY doc_id, run),
gaps AS (
  SELECT doc_id, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS a, lo AS b FROM runs
  UNION ALL SELECT r.doc_id, coalesce(max(hi), 0), any_value(length(x) // 2) FROM raw r LEFT JOIN runs USING (doc_id) GROUP BY r.doc_id),
kept AS (SELECT doc_id, string_agg(substr(x, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS k FROM gaps JOIN raw USING (doc_id) GROUP BY doc_id)
SELECT r.doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(c.removed, 0)::BIGINT AS n_removed, coalesce(c.n, 0)::BIGINT AS n_spans,
       sha256(unhex(k)) AS kept_sha256
FROM raw r JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, sum(hi - lo) AS removed, count(*) AS n FROM runs GROUP BY doc_id) c USING (doc_id)
"""
