"""Resharding by minimum-cost flow (operator 6).

A layout is a folder of Parquet files with a list of where each shard's files are. Resharding writes the files of the shards
that gain or lose rows anew, then replaces the list in one step, then deletes what the list no longer names: a reader
finds each row once at any time, and a run that is cut off leaves the old layout as it was.
"""

from __future__ import annotations

import heapq
import json
import re
import uuid
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lorewell.llm.common import keep, running_total, shared_dir, stash, unstash

OLD_SHARDS, NEW_SHARDS = 16, 24
#: Blocks are ranges of a hash: of so many bytes on average, and at most so many in all, so that the table of their places can
#: be broadcast; an old shard has the least number at least. A file holds some blocks of a shard, of about so many bytes.
BLOCK_BYTES, MOST_BLOCKS, BLOCKS, FILE_BYTES = 16 << 20, 100_000, 256, 64 << 20
LIST = "_shards.json"


def min_cost_flow(supply: list[int], capacity: list[int], cost=None) -> dict[tuple[int, int], int]:
    """Bytes from each old to each new shard, of least total cost; sum(capacity) must cover sum(supply).

    cost(i, j) per byte; by default 0 where i == j (the bytes stay) and 1 elsewhere (they move). Successive
    shortest paths with potentials; ties go to smaller numbers, so reruns agree.
    """
    cost = cost or (lambda i, j: int(i != j))
    if sum(capacity) < sum(supply):
        raise ValueError("the new shards cannot hold the old ones")
    n, m = len(supply), len(capacity)
    price = [[cost(i, j) for j in range(m)] for i in range(n)]
    left, room = list(supply), list(capacity)
    flow: dict[tuple[int, int], int] = defaultdict(int)
    pot = [0] * (n + m)
    while any(left):
        # shortest reduced distances from all old shards that still have bytes
        dist = [0 if i < n and left[i] else float("inf") for i in range(n + m)]
        came = [-1] * (n + m)
        heap = [(0, i) for i in range(n) if left[i]]
        # sources start from equal reduced distance
        base = min(-pot[i] for i in range(n) if left[i])
        for i in range(n):
            if left[i]:
                dist[i] = -pot[i] - base
        heap = [(dist[i], i) for i in range(n) if left[i]]
        heapq.heapify(heap)
        while heap:
            d, u = heapq.heappop(heap)
            if d > dist[u]:
                continue
            if u < n:
                steps = ((n + j, price[u][j]) for j in range(m))
            else:
                steps = ((i, -price[i][u - n]) for i in range(n) if flow.get((i, u - n), 0))
            for v, c in steps:
                nd = d + c + pot[u] - pot[v]
                if nd < dist[v]:
                    dist[v], came[v] = nd, u
                    heapq.heappush(heap, (nd, v))
        real = {j: dist[n + j] + pot[n + j] for j in range(m) if room[j] and dist[n + j] < float("inf")}
        end = n + min(real, key=lambda j: (real[j], j))
        far = max(d for d in dist if d < float("inf"))
        path, v = [], end
        while came[v] >= 0:
            path.append((came[v], v))
            v = came[v]
        amount = min([left[v], room[end - n], *(flow[b, a - n] for a, b in path if a >= n)])
        for a, b in path:
            if a < n:
                flow[a, b - n] += amount
            else:
                flow[b, a - n] -= amount
        left[v] -= amount
        room[end - n] -= amount
        for x in range(n + m):
            pot[x] += min(dist[x], far)
    return {k: v for k, v in flow.items() if v}


def capacities(total: int, shards: int) -> list[int]:
    """Equal parts that differ by one byte at most."""
    return [total // shards + (i < total % shards) for i in range(shards)]


def cuts(supply: list[int], flow: dict[tuple[int, int], int]) -> list[tuple[int, int, int, int]]:
    """(old, new, begin, end): each old shard's bytes in block order; what stays comes first."""
    out = []
    for i, n in enumerate(supply):
        at = 0
        for j in sorted((j for a, j in flow if a == i), key=lambda j: (j != i, j)):
            out.append((i, j, at, at + flow[i, j]))
            at += flow[i, j]
        assert at == n
    return out


def text_size(text: Column) -> Column:
    """UTF-8 bytes plus 8; a null text has none."""
    return (F.octet_length(F.coalesce(text, F.lit("")).cast("binary")) + 8).cast("long")


def place_hash(*columns: Column) -> Column:
    """What orders the rows of a shard."""
    return F.xxhash64(F.lit(6), *columns)


def hashable(schema: StructType) -> list[str]:
    """The columns that Spark can hash: those without a map or a variant in them."""
    return [f.name for f in schema if not re.search(r"\b(map<|variant)", f.dataType.simpleString())]


def old_shard(docs_source: str = "source") -> Column:
    """The layout to start from: one key-sharded by source."""
    return (F.crc32(F.coalesce(F.col(docs_source), F.lit("")).cast("binary")) % OLD_SHARDS).cast("int")


def reshard(sized: DataFrame, n_old: int = OLD_SHARDS, n_new: int = NEW_SHARDS, cost=None) -> tuple[DataFrame, DataFrame, list[tuple[int, int, int, int]]]:
    """Where the rows (old, h, size) go: the blocks, with each one's old shard, its new shard and file there, the hashes [lo, hi)
    of it that go there, their rows and bytes, and the slot of their first row; how many blocks each old shard has; and the transfers.

    Rows of an old shard are laid out block by block and by h; a row goes where its first byte falls among the old shard's
    cuts. So shard sizes are equal to within one row per cut. Rows of one hash are alike; where a cut falls among them, or they
    are more than a block, they are parted by count: such pieces have the numbers [lo, hi) of the copies in `part`.
    """
    spark = sized.sparkSession
    sums = {r["old"]: r["n"] for r in sized.groupBy("old").agg(F.sum("size").alias("n")).collect()}
    supply = [sums.get(i, 0) for i in range(n_old)]
    moves = cuts(supply, min_cost_flow(supply, capacities(sum(supply), n_new), cost))
    each = max(BLOCK_BYTES, -(-sum(supply) // MOST_BLOCKS))
    counts = spark.createDataFrame([(i, max(BLOCKS, -(-n // each))) for i, n in enumerate(supply)], "old int, blocks long")
    rows = in_blocks(sized, counts).groupBy("old", "block", "h").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    laid = running_total(keep(rows), ["old"], "block", ["h"], F.col("size"), "at")
    table = F.broadcast(spark.createDataFrame(moves, "old int, shard int, from long, to long"))
    one = F.expr("size div n")
    copy = lambda at: F.least(F.col("n"), F.greatest(F.lit(0), F.expr(f"(`{at}` - at + (size div n) - 1) div (size div n)")))
    cut = laid.join(table, "old").withColumns({"i": copy("from"), "j": copy("to")}).where("i < j")
    parted = (F.col("n") > 1) & ((F.col("i") > 0) | (F.col("j") < F.col("n")) | (F.col("size") > each))
    cut = keep(cut.withColumn("parted", parted))
    blocks = cut.where("NOT parted").groupBy("old", "block", "shard").agg(F.min("h").alias("lo"), F.sum("size").alias("bytes"), F.sum("n").alias("n"))
    blocks = blocks.withColumn("hi", F.lead("lo").over(W.partitionBy("old", "block").orderBy("lo"))).withColumn("part", F.lit(None).cast("struct<lo:long,hi:long>"))
    step = F.greatest(F.lit(1), F.floor(F.lit(each) / one)).cast("long")
    pieces = cut.where("parted").withColumn("lo", F.explode(F.sequence(F.col("i"), F.col("j") - 1, step)))
    pieces = pieces.withColumn("part", F.struct(F.col("lo"), F.least(F.col("lo") + step, F.col("j")).alias("hi"))).withColumn("m", F.col("part.hi") - F.col("lo"))
    blocks = blocks.unionByName(pieces.select("old", "block", "shard", F.col("h").alias("lo"), (F.col("m") * one).alias("bytes"), F.col("m").alias("n"), F.col("h").alias("hi"), "part"))
    along = W.partitionBy("shard").orderBy("old", "block", F.col("part").isNotNull(), "lo", "part.lo").rowsBetween(W.unboundedPreceding, -1)
    placed = blocks.select(
        "old", "block", "shard", "lo", "hi", "part", "bytes", "n",
        F.coalesce(F.sum("n").over(along), F.lit(0)).alias("slot"),
        F.floor(F.coalesce(F.sum("bytes").over(along), F.lit(0)) / FILE_BYTES).cast("int").alias("file"),
    )
    return keep(placed), counts, moves


def in_blocks(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """rows with their block."""
    return rows.join(F.broadcast(counts), "old").withColumn("block", F.pmod(F.shiftright("h", 16), F.col("blocks"))).drop("blocks")


def with_slots(rows: DataFrame, placed: DataFrame, counts: DataFrame) -> tuple[DataFrame, str | None]:
    """rows (old, h) with shard, file and slot: gapless from 0 within each shard, by old shard, block and h; and the path of a table
    that they are read from in part, if there is one.

    The places of blocks are broadcast, MOST_BLOCKS of them and as many pieces of copies at most; the rows travel once, to their
    file. Copies that are parted are numbered first: they are written once with a number of their own, and counted by the tasks
    that wrote them, so that no task sees all copies of a row.
    """
    files = max(1, min(placed.select("shard", "file").distinct().count(), MOST_BLOCKS))
    pieces = placed.where("part IS NOT NULL").select("old", F.col("lo").alias("h"), "part", "shard", "file", F.col("slot").alias("first"))
    parted, path = F.broadcast(pieces.select("old", "h").distinct()), None
    where = F.broadcast(placed.where("part IS NULL").select("old", "block", "shard", "file", "lo", "hi", F.col("slot").alias("first")))
    whole = rows.join(parted, ["old", "h"], "left_anti") if pieces.head(1) else rows
    here = in_blocks(whole, counts).join(where, ["old", "block"]).where((F.col("h") >= F.col("lo")) & (F.col("hi").isNull() | (F.col("h") < F.col("hi"))))
    rank = F.row_number().over(W.partitionBy("shard", "file", "old", "block").orderBy("h"))
    out = here.repartition(files, "shard", "file").withColumn("slot", F.col("first") + rank - 1).drop("lo", "hi", "first", "block")
    if pieces.head(1):
        copies, path = stash(rows.join(parted, ["old", "h"], "left_semi").withColumn("own", F.monotonically_increasing_id()))
        numbered = running_total(copies.withColumn("task", F.shiftright("own", 33)), ["old", "h"], "task", ["own"], F.lit(1), "copy")
        to = numbered.join(F.broadcast(pieces), ["old", "h"]).where((F.col("copy") >= F.col("part.lo")) & (F.col("copy") < F.col("part.hi")))
        to = to.withColumn("slot", F.col("first") + F.col("copy") - F.col("part.lo")).select(*out.columns)
        out = out.unionByName(to.repartition(files, "shard", "file"))
    return out, path


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def listed(spark: SparkSession, path: str) -> dict[int, str]:
    """Where each shard's files are, below path; nothing where there is no layout. Shards without rows are not listed."""
    fs, at = _fs(spark, f"{path}/{LIST}")
    if not fs.exists(at):
        return {}
    stream = fs.open(at)
    try:
        said = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return {int(k): v for k, v in json.loads(said).items()}


def _list(spark: SparkSession, path: str, shards: dict[int, str]) -> None:
    """Replaces the list in one step."""
    fs, new = _fs(spark, f"{path}/_new-{uuid.uuid4().hex}.json")
    out = fs.create(new, True)
    out.write(bytearray(json.dumps(shards).encode()))
    out.close()
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    how = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    how[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(new, hadoop.Path(f"{path}/{LIST}"), how)


def read_shards(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """(doc, slot, shard): every row of a layout once; doc has the columns it was written with."""
    shards = listed(spark, path)
    if not shards:
        raise ValueError(f"no shards at {path}")
    gens = sorted({v.split("/")[0] for v in shards.values()})
    out = None
    for gen in gens:
        own = [f"{path}/{v}" for v in shards.values() if v.startswith(gen + "/")]
        part = spark.read.option("basePath", f"{path}/{gen}").parquet(*own)
        out = part if out is None else out.unionByName(part)
    return out.select("doc", "slot", F.col("shard").cast("int").alias("shard"))


def rewrite(rows: DataFrame, path: str, touched: set[int]) -> None:
    """Writes rows (doc, shard, slot), dealt by file, as the new content of the touched shards of the layout at path.

    Touched shards without a row are no longer listed; what the list no longer names is deleted.
    """
    spark = rows.sparkSession
    before = listed(spark, path)
    gen = f"g{uuid.uuid4().hex}"
    rows.select("doc", "slot", "shard").write.partitionBy("shard").parquet(f"{path}/{gen}")
    fs, at = _fs(spark, f"{path}/{gen}")
    written = {int(f.getPath().getName()[6:]) for f in fs.listStatus(at) if f.getPath().getName().startswith("shard=")}
    after = {j: d for j, d in before.items() if j not in touched} | {j: f"{gen}/shard={j}" for j in sorted(written)}
    _list(spark, path, after)
    for d in set(before.values()) - set(after.values()):
        unstash(spark, f"{path}/{d}")


def write_layout(docs: DataFrame, path: str, n_new: int = NEW_SHARDS) -> list[tuple[int, int, int, int]]:
    """Lays documents that are in no files of their own out in n_new shards at path; their old shards are by source.

    The transfers are those of least bytes from the old shards. All columns of docs are written. Returns the transfers.
    """
    rows = docs.select(F.struct("*").alias("doc"), old_shard().alias("old"), text_size(F.col("text")).alias("size"), place_hash(*[F.col(f"`{c}`") for c in hashable(docs.schema)]).alias("h"))
    return _relay(rows, path, OLD_SHARDS, n_new, fresh=True)


def reshard_files(spark: SparkSession, path: str, n_new: int, n_old: int | None = None) -> list[tuple[int, int, int, int]]:
    """Reshards the layout at path to n_new shards of near equal bytes, by moving the fewest; returns the transfers.

    Shards that neither gain nor lose rows keep their files. A layout can grow or shrink; shards beyond the new number are emptied.
    """
    rows = read_shards(spark, path)
    n_old = n_old or max(listed(spark, path)) + 1
    keyed = rows.select("doc", F.col("shard").alias("old"), text_size(F.col("doc.text")).alias("size"), place_hash(*[F.col(f"doc.`{c}`") for c in hashable(rows.schema["doc"].dataType)]).alias("h"))
    return _relay(keyed, path, n_old, n_new, fresh=False)


def _relay(rows: DataFrame, path: str, n_old: int, n_new: int, fresh: bool) -> list[tuple[int, int, int, int]]:
    placed, counts, moves = reshard(keep(rows.select("old", "h", "size")), n_old, n_new)
    touched = set(range(n_new))
    if not fresh:
        # bytes that a cut leaves within one row move no row, and rewrite nothing
        flows = placed.select("old", "shard").distinct().where("old != shard").collect()
        touched = {x for r in flows for x in (r["old"], r["shard"])}
        rows = rows.where(F.col("old").isin(sorted(touched)))
    if touched:
        slotted, written = with_slots(rows.drop("size"), placed, counts)
        rewrite(slotted, path, touched)
        if written:
            unstash(rows.sparkSession, written)
    return moves


def shard_documents(docs: DataFrame, n_new: int = NEW_SHARDS, path: str | None = None) -> DataFrame:
    """Writes the documents' shards and gives every row's shard and slot as its file has them.

    path: where the files go and stay; without one they go to the shared folder and are deleted once the digest is
    taken. An empty table gives no row, repeated rows get slots of their own and are parted like others, a null text counts
    as empty. Extra columns of any type are written with the rows.
    """
    spark = docs.sparkSession
    at = path or f"{shared_dir(spark)}/lorewell-{uuid.uuid4().hex}"
    write_layout(docs, at, n_new)
    if listed(spark, at):
        rows = read_shards(spark, at)
        text = F.coalesce("doc.text", F.lit("")).cast("binary")
        old = (F.crc32(F.coalesce("doc.source", F.lit("")).cast("binary")) % OLD_SHARDS).cast("int")
        out = rows.select("doc.doc_id", text_size(F.col("doc.text")).alias("size"), F.crc32(text).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), old.alias("old_shard"))
    else:
        out = spark.createDataFrame([], "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int, old_shard int")
    if path is None:
        out = keep(out)
        unstash(spark, at)
    return out


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes, moved from 16 by least bytes, read from the files they were written to."""
    from lorewell.session import table

    return shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
