"""The prefix trie of conversations: MSD radix partitioning over turn ids, finished by multikey quicksort (operator 11).

Turns (role, text) are numbered by a dictionary; texts themselves are read once and never shuffled, a digest of 32 bytes stands for
them. Equal sequences of ids are one sequence with a weight. A bucket holds the sequences that share a prefix. A round takes every
bucket of more than LOCAL turns: it emits the nodes of what all of its sequences still share, and deals them by their next id into
buckets one level down. A bucket of at most LOCAL turns goes to one task, where multikey quicksort parts it further: the sequences
that equal the pivot at a depth are a node, emitted as the recursion goes down. Sums over subtrees are taken within such a task, and
added up round by round above it.

Nothing is gathered without a bound: sequences are held in blocks of 2^BLOCK_BITS turns; ranks within a conversation come from a range
partitioning, so one conversation may hold any share of the rows; a long sequence that is alone in its bucket is emitted by blocks.
The members of a node are hashed in one stream of their ids, as the digest asks, packed by ranges of 4,096 ids beforehand.
The number of rounds is that of the branchings of a path while more than LOCAL turns lie below it.

Rows without a conversation are in no conversation. Null role or text is empty. Rows of one turn are in the order of role and digest
of the text, repeated rows count as often as they stand. An empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorewell.llm.common import keep, running_total, stash, text_batches, unstash

#: Turns of a block as a power of two, and turns below a prefix that one task finishes.
BLOCK_BITS, LOCAL = 12, 1 << 14
#: Turns that conversations of a hundred share at most, so many as h can be.
SHARED = 5
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NOBODY = hashlib.sha256(b"").hexdigest()


class Kept:
    """Tables in the shared folder that go when the work is done."""

    def __init__(self, spark):
        self.spark, self.paths = spark, []

    def __call__(self, df: DataFrame) -> DataFrame:
        out, path = stash(df)
        self.paths.append(path)
        return out

    def drop(self) -> None:
        for path in self.paths:
            unstash(self.spark, path)


def coded_turns(conversations: DataFrame, kept: Kept) -> DataFrame:
    """(conv_id, rank, tid, chars): every turn's place in its conversation from 0, the number of its role and text, code points."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), digest.alias("digest"), F.char_length(text).cast("long").alias("chars"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    # a range of the whole order to a task; its number is the bucket of the running count
    placed = kept(rows.repartitionByRange("conv_id", *order, F.monotonically_increasing_id()).withColumn("pid", F.spark_partition_id()))
    words = placed.select("digest").distinct().withColumn("lead", F.hex(F.substring("digest", 1, 2)))
    words = running_total(words, [], "lead", ["digest"], F.lit(1), "tid").select("digest", F.col("tid").cast("long").alias("tid"))
    ranked = running_total(placed, ["conv_id"], "pid", order, F.lit(1), "rank")
    return kept(ranked.join(words, "digest").select("conv_id", F.col("rank").cast("long").alias("rank"), "tid", "chars"))


def rebuilt(coded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, n) of every conversation, and (conv_id, pos, tid, chars) of its turns: the first h of the conversation c - c%100 and
    its own after its first h, where h is crc32(c) % 6."""
    own = coded.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    base = F.col("conv_id") - F.col("conv_id") % 100
    has = own.where("conv_id % 100 = 0").select(F.col("conv_id").alias("base"), F.col("own").alias("has"))
    convs = own.withColumn("base", base).withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % (SHARED + 1)).join(has, "base", "left")
    convs = convs.withColumn("k", F.least("h", F.coalesce("has", F.lit(0)))).select("conv_id", "base", "h", "k", (F.col("k") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n"))
    heads = coded.where((F.col("conv_id") % 100 == 0) & (F.col("rank") < SHARED)).select(F.col("conv_id").alias("base"), F.col("rank").alias("pos"), "tid", "chars")
    taken = convs.join(heads, "base").where("pos < k").select("conv_id", "pos", "tid", "chars")
    rest = coded.join(convs, "conv_id").where("rank >= h").select("conv_id", (F.col("rank") - F.col("h") + F.col("k")).alias("pos"), "tid", "chars")
    return convs.select("conv_id", "n"), taken.unionByName(rest)


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the ids of each digest, which come in order; only the state of one hash is held."""
    now, state, first = None, None, True
    for batch in batches:
        done: list[tuple[str, str]] = []
        for dig, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if dig != now or state is None:
                if state is not None:
                    done.append((now, state.hexdigest()))
                now, state, first = dig, hashlib.sha256(), True
            state.update(ids.encode() if first else b"," + ids.encode())
            first = False
        yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in done], pa.string()), pa.array([h for _, h in done], pa.string())], ["dig", "ends"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([state.hexdigest()])], ["dig", "ends"])


def sequences(convs: DataFrame, turns: DataFrame, bits: int, kept: Kept) -> tuple[DataFrame, DataFrame]:
    """Different sequences (s, w, n, ends): least conversation, conversations, turns, digest of their ids; and their blocks
    (s, blk, tids, chars)."""
    cell = F.array_sort(F.collect_list(F.struct("pos", "tid", "chars")))
    blocks = turns.groupBy("conv_id", F.shiftright("pos", bits).alias("blk")).agg(cell.alias("c"))
    blocks = kept(blocks.select("conv_id", "blk", F.col("c.tid").alias("tids"), F.col("c.chars").alias("chars")))
    parts = blocks.select("conv_id", F.struct("blk", F.sha2(F.array_join(F.col("tids").cast("array<string>"), ","), 256).alias("d")).alias("part"))
    whole = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list("part")).alias("p")).select("conv_id", F.sha2(F.array_join("p.d", ""), 256).alias("dig"))
    all_of = kept(convs.join(whole, "conv_id", "left").select("conv_id", "n", F.coalesce("dig", F.lit("")).alias("dig")))
    classes = all_of.groupBy("dig").agg(F.min("conv_id").alias("s"), F.count(F.lit(1)).alias("w"), F.min("n").alias("n"))
    packed = all_of.groupBy("dig", F.shiftright("conv_id", 12).alias("range")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    packed = packed.select("dig", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), "range")
    ends = packed.repartition("dig").sortWithinPartitions("dig", "range").select("dig", "ids").mapInArrow(_streams, "dig string, ends string")
    seqs = kept(classes.join(ends, "dig").select("s", "w", "n", "ends"))
    return seqs, kept(blocks.withColumnRenamed("conv_id", "s").join(seqs.select("s"), "s", "left_semi"))


class Nodes:
    """Nodes of one bucket, parents before children."""

    def __init__(self):
        self.conv, self.depth, self.up, self.convs, self.chars, self.ends = [], [], [], [], [], []

    def add(self, conv: int, depth: int, up: int, convs: int, chars: int) -> int:
        self.conv.append(conv)
        self.depth.append(depth)
        self.up.append(up)
        self.convs.append(convs)
        self.chars.append(chars)
        self.ends.append(NOBODY)
        return len(self.conv) - 1

    def rows(self, parent: int) -> list[list]:
        n = len(self.conv)
        children, leaves, saved = [0] * n, [0] * n, [0] * n
        for i in range(n - 1, -1, -1):
            leaves[i] = leaves[i] or 1
            saved[i] += (self.convs[i] - 1) * self.chars[i]
            if i:
                children[self.up[i]] += 1
                leaves[self.up[i]] += leaves[i]
                saved[self.up[i]] += saved[i]
        above = [parent, *(self.conv[u] for u in self.up[1:])]
        return [self.conv, self.depth, above, self.convs, children, leaves, saved, self.ends]


def multikey_quicksort(top: tuple[int, int], seqs: list[tuple[int, int, str, list[int], list[int]]]) -> Nodes:
    """Nodes of the sequences (s, w, ends, ids, chars) below a prefix; top: its depth and the code points of its last text.

    The members that equal the pivot's id at a depth are a node and go on one deeper; those before and after it stay at the depth.
    """
    nodes = Nodes()
    root = nodes.add(min(q[0] for q in seqs), top[0], -1, sum(q[1] for q in seqs), top[1])
    stack = [(seqs, 0, root)]
    while stack:
        group, at, node = stack.pop()
        rest = []
        for q in group:
            if len(q[3]) == at:
                nodes.ends[node] = q[2]
            else:
                rest.append(q)
        while len(rest) == 1:
            s, w, ends, ids, chars = rest.pop()
            for i in range(at, len(ids)):
                node = nodes.add(s, top[0] + i + 1, node, w, chars[i])
            nodes.ends[node] = ends
        if rest:
            pivot = rest[len(rest) // 2][3][at]
            same = [q for q in rest if q[3][at] == pivot]
            if len(same) < len(rest):
                stack += [([q for q in rest if q[3][at] < pivot], at, node), ([q for q in rest if q[3][at] > pivot], at, node)]
            child = nodes.add(min(q[0] for q in same), top[0] + at + 1, node, sum(q[1] for q in same), same[0][4][at])
            stack.append((same, at + 1, child))
    return nodes


def _finish(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Nodes of buckets whose rows (b, d, parent, top, r, s, w, ends, blk, tids, chars) come in order of b, s, blk."""
    head, seqs = None, []

    def done() -> list[list]:
        b, d, parent, top, r = head
        found = multikey_quicksort((d, top), [(s, w, ends, ids[skip:], chars[skip:]) for s, w, ends, ids, chars, skip in seqs])
        out = found.rows(parent)
        return [*out, [r] + [None] * (len(out[0]) - 1)]

    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "top_of"]
    types = [pa.int64()] * 7 + [pa.string(), pa.int64()]

    def batch_of(columns: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            b, d, parent, top, r, s, w, ends, blk, ids, chars = row
            if head is None or head[0] != b:
                if head is not None:
                    yield batch_of(done())
                head, seqs = (b, d, parent, top, r), []
            if seqs and seqs[-1][0] == s:
                seqs[-1][3].extend(ids)
                seqs[-1][4].extend(chars)
            else:
                seqs.append((s, w, ends, ids or [], chars or [], d - (blk << bits) if ids else 0))
    if head is not None:
        yield batch_of(done())


def _long(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Nodes below the top of a sequence that is alone, of rows (s, d, w, n, ends, blk, chars, after), a block each; after: the code
    points behind the block."""
    for batch in batches:
        for s, d, w, n, ends, blk, chars, after in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            first = blk << bits
            own = np.array(chars[max(0, d - first) :], np.int64)
            depth = np.arange(len(own)) + max(first, d) + 1
            behind = np.cumsum(own[::-1])[::-1] + after
            k, one = len(own), np.ones(len(own), np.int64)
            columns = [s * one, depth, s * one, w * one, (depth < n).astype(np.int64), one, (w - 1) * behind, [NOBODY] * k, [None] * k]
            if k and depth[-1] == n:
                columns[7][-1] = ends
            names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "top_of"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 7 + [pa.string(), pa.int64()], strict=True)], names)


def finished(parts: DataFrame, seqs: DataFrame, blocks: DataFrame, local: int, bits: int) -> DataFrame:
    """Nodes of buckets that need no further round; top_of is the round that a bucket's first node came from, else null.

    parts: (s, b, d, parent, top, size, rest, r).
    """
    alone = (F.col("size") == 1) & (F.col("rest") > local)
    # a sequence that ends at the bucket's own node has no block to give
    ahead = (F.col("s") == F.col("of")) & (F.col("d") < F.col("n")) & (F.col("blk") >= F.shiftright("d", bits))
    rows = parts.join(seqs, "s").join(blocks.withColumnRenamed("s", "of"), ahead, "left")
    small = rows.where(~alone).select("b", "d", "parent", "top", "r", "s", "w", "ends", "blk", "tids", "chars")
    out = small.repartition("b").sortWithinPartitions("b", "s", "blk").mapInArrow(partial(_finish, bits=bits), f"{NODE}, top_of long")
    behind = F.sum("total").over(W.partitionBy("s").orderBy(F.col("blk").desc()).rowsBetween(W.unboundedPreceding, -1))
    skip = F.greatest(F.col("d") - F.shiftleft("blk", bits), F.lit(0)).cast("int")
    total = F.aggregate(F.slice("chars", skip + 1, F.greatest(F.size("chars") - skip, F.lit(0))), F.lit(0).cast("long"), lambda a, x: a + x)
    long = rows.where(alone).withColumn("total", total)
    long = long.withColumn("after", F.coalesce(behind, F.lit(0)))
    below = long.select("s", "d", "w", "n", "ends", "blk", "chars", "after").mapInArrow(partial(_long, bits=bits), f"{NODE}, top_of long")
    tops = long.groupBy("s", "d", "parent", "w", "top", "r").agg(F.sum("total").alias("all"))
    one = F.lit(1).cast("long")
    tops = tops.select(F.col("s").alias("conv_id"), F.col("d").alias("depth"), F.col("parent").alias("parent_conv_id"), F.col("w").alias("n_convs"), one.alias("n_children"), one.alias("n_leaves"),
                       ((F.col("w") - 1) * (F.col("all") + F.col("top"))).alias("saved_tokens"), F.lit(NOBODY).alias("ends_sha256"), F.col("r").alias("top_of"))
    return out.unionByName(below).unionByName(tops)


def prefix_trie(conversations: DataFrame, local: int = LOCAL, bits: int = BLOCK_BITS) -> DataFrame:
    """One row a node of the trie of rebuilt conversations, see the module and NODE for the columns."""
    spark = conversations.sparkSession
    text_batches(spark)
    kept = Kept(spark)
    convs, turns = rebuilt(coded_turns(conversations, kept))
    seqs, blocks = sequences(convs, turns, bits, kept)
    whole = seqs.agg(F.min("s"), F.sum("w"), F.count(F.lit(1)), F.sum("n")).first()
    if whole[0] is None:
        kept.drop()
        return spark.createDataFrame([], NODE)
    zero = F.lit(0).cast("long")
    state = seqs.select("s", "w", "n", F.lit(whole[0]).alias("b"), zero.alias("d"), F.lit(None).cast("long").alias("parent"), zero.alias("top"), F.lit(whole[1]).alias("convs"), F.lit(whole[2]).alias("size"), F.lit(whole[3]).alias("rest"))
    big = (F.col("size") > 1) & (F.col("rest") > local)
    levels, parts, r = [], [], 0
    while True:
        parts.append(state.where(~big).withColumn("r", F.lit(r - 1).cast("long")))
        state = state.where(big)
        buckets = kept(state.select("b", "d", "parent", "top", "convs", "size").distinct())
        if not buckets.head(1):
            break
        below = blocks.join(state.select("s", "b", "d", "w", "n"), "s").where(F.col("blk") >= F.shiftright("d", bits))
        below = below.select("s", "b", "d", "w", "n", "blk", F.posexplode(F.arrays_zip("tids", "chars")).alias("i", "c"))
        below = below.select("s", "b", "d", "w", "n", (F.shiftleft("blk", bits) + F.col("i")).alias("pos"), F.col("c.tids").alias("tid"), F.col("c.chars").alias("chars")).where("pos >= d")
        same = kept(below.groupBy("b", "pos").agg(F.count(F.lit(1)).alias("c"), F.min("tid").alias("lo"), F.max("tid").alias("hi"), F.min("chars").alias("chars")))
        known = same.join(buckets, "b")
        branch = kept(known.where("c < size OR lo < hi").groupBy("b").agg(F.min("pos").alias("at")))
        trunk = known.join(branch, "b").where("pos < at").select("b", (F.col("pos") + 1).alias("depth"), "chars").unionByName(buckets.select("b", F.col("d").alias("depth"), F.col("top").alias("chars")))
        split = below.join(branch, "b").where("pos = at").select("s", "w", "n", "b", "at", "tid", "chars")
        child = kept(split.groupBy("b", "tid").agg(F.min("s").alias("to"), F.sum("w").alias("convs"), F.count(F.lit(1)).alias("size"), F.sum(F.col("n") - F.col("at") - 1).alias("rest"), F.min("chars").alias("top")))
        ended = state.join(branch, (state.b == branch.b) & (state.n == branch["at"])).select(state.b, "s").join(seqs.select("s", "ends"), "s").select("b", "ends")
        levels.append((buckets, branch, kept(trunk), kept(ended)))
        dealt = split.drop("chars").join(child, ["b", "tid"])
        state = kept(dealt.select("s", "w", "n", F.col("to").alias("b"), (F.col("at") + 1).alias("d"), F.col("b").alias("parent"), "top", "convs", "size", "rest"))
        r += 1
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    leaves = kept(finished(every.drop("w", "n", "convs"), seqs, blocks, local, bits))
    out, above = leaves.drop("top_of"), None
    for r in range(len(levels) - 1, -1, -1):
        buckets, branch, trunk, ended = levels[r]
        kids = leaves.where(F.col("top_of") == r).select(F.col("parent_conv_id").alias("b"), "n_leaves", "saved_tokens")
        kids = kids.unionByName(above) if above is not None else kids
        sums = kids.groupBy("b").agg(F.count(F.lit(1)).alias("kids"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved"))
        own = trunk.groupBy("b").agg(F.sum("chars").alias("all"))
        sums = kept(buckets.join(branch, "b").join(sums, "b").join(own, "b"))
        above = sums.select(F.col("parent").alias("b"), "n_leaves", (F.col("saved") + (F.col("convs") - 1) * F.col("all")).alias("saved_tokens"))
        before = running_total(trunk.withColumn("cell", F.shiftright("depth", bits)), ["b"], "cell", ["depth"], F.col("chars"), "before")
        rows = before.join(sums, "b").join(ended, "b", "left")
        last = F.col("depth") == F.col("at")
        rows = rows.select(F.col("b").alias("conv_id"), "depth", F.when(F.col("depth") == F.col("d"), F.col("parent")).otherwise(F.col("b")).alias("parent_conv_id"), F.col("convs").alias("n_convs"),
                           F.when(last, F.col("kids")).otherwise(1).alias("n_children"), "n_leaves", (F.col("saved") + (F.col("convs") - 1) * (F.col("all") - F.col("before"))).alias("saved_tokens"),
                           F.when(last, F.coalesce("ends", F.lit(NOBODY))).otherwise(NOBODY).alias("ends_sha256"))
        out = out.unionByName(rows)
    result = keep(out)
    kept.drop()
    return result


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """The trie of all conversations."""
    from lorewell.session import table

    return prefix_trie(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
