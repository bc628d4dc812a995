"""What the operators share: shared-folder cuts of lineage, distributed running totals, byte-level tokens."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, named by spark.checkpoint.dir; a temporary one only in a local session that names none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lorewell-"))
    return sc.getCheckpointDir()


def keep(df: DataFrame) -> DataFrame:
    """Cuts lineage by a checkpoint in the shared folder; it is computed once and survives lost executors.

    Spark deletes it with the DataFrame where spark.cleaner.referenceTracking.cleanCheckpoints is set, as it should be.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stash(df: DataFrame) -> tuple[DataFrame, str]:
    """A written table in the shared folder, compressed, for what is read several times; unstash() deletes it."""
    path = f"{shared_dir(df.sparkSession)}/lorewell-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def unstash(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: What goes to a Python worker at once, unless the session says otherwise; Spark's own bounds are 10,000 rows and 64 MB.
BATCH_ROWS, BATCH_BYTES = 2_000, 16 << 20


def text_batches(spark: SparkSession) -> None:
    """Bounds the texts that go to a Python worker at once. All operators set the same bounds, and none that the user set."""
    for name, usual, bound in (("maxRecordsPerBatch", "10000", BATCH_ROWS), ("maxBytesPerBatch", "67108864b", BATCH_BYTES)):
        if spark.conf.get(f"spark.sql.execution.arrow.{name}") == usual:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(bound))


def free_name(columns: list[str], name: str) -> str:
    """name, with as many underscores behind it as keep it apart from the columns, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def running_total(df: DataFrame, group: list[str], bucket: str, order: list[Column | str], value: Column, into: str) -> DataFrame:
    """The exclusive running total of value within group, by bucket and then order.

    Only sums of (group, bucket) meet per group; rows are sorted per (group, bucket), so a hot group is
    spread over its buckets. Groups and buckets must not be null.
    """
    keys = [*group, bucket]
    sums = df.withColumn("_v", value).groupBy(*keys).agg(F.sum("_v").alias("_s"))
    before = W.partitionBy(*group).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(*keys, F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_off"))
    within = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    joined = df.join(offsets, keys)
    return joined.withColumn(into, F.col("_off") + F.coalesce(F.sum(value).over(within), F.lit(0))).drop("_off")


def arrow_text(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string array without copying each text; nulls are empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if not len(offsets):
        offsets = np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def release() -> None:
    """Gives a worker's free memory back at the end of a task; workers live on, and what they hold adds up over the stages."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def text_slices(offsets: np.ndarray, most: int, rows: int = 1 << 30):
    """Ranges of documents of about `most` bytes and at most `rows` each, so that array work stays small; a longer document
    stands alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        j = min(j, n, i + rows)
        yield i, j
        i = j


#: Keeps the first 0 to 8 bytes of a little-endian word.
MASKS = np.array([(1 << (8 * i)) - 1 for i in range(9)], dtype=np.uint64)
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def uniform(x: np.ndarray) -> np.ndarray:
    """Hashes to doubles above 0 and at most 1."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * (1.0 / (1 << 53))


def word_hashes(data: np.ndarray, offsets: np.ndarray, bare: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of other bytes than ASCII white space) of a slice of documents: (hash, document, start, end).

    Words never cross documents. bare: ASCII punctuation parts words too. Capitals of ASCII and Latin-1 count as small
    letters. A hash takes the word's bytes eight at a time, all words at once.
    """
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), empty, empty, empty
    if bare:
        inside = (data > 127) | (((data | np.uint8(32)) - np.uint8(97)) < 26) | ((data - np.uint8(48)) < 10)
    else:
        inside = ~((data == 32) | ((data - np.uint8(9)) < 5))
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    docs = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets)))
    low = np.zeros(n + 16, np.uint8)
    low[:n] = data + (((data - np.uint8(65)) < 26).view(np.uint8) << np.uint8(5))
    wide = np.flatnonzero(data[:-1] == 0xC3) + 1
    if len(wide):
        second = low[wide]
        low[wide] = second + (((second - np.uint8(0x80)) < 0x1F) & (second != 0x97)).astype(np.uint8) * np.uint8(32)
    eight = np.ndarray((n + 9,), dtype="<u8", buffer=low, strides=(1,))
    lengths = ends - starts
    h = lengths.astype(np.uint64) * MIX1
    at, left, step = None, lengths, 0
    while True:
        chunk = eight[starts + step if at is None else starts[at] + step]
        chunk &= MASKS[np.minimum(left, 8)]
        if at is None:
            h = mix((h ^ chunk) * ODD)
        else:
            h[at] = mix((h[at] ^ chunk) * ODD)
        step += 8
        more = np.flatnonzero(left > 8)
        if not len(more):
            return h, docs, starts, ends
        at = more if at is None else at[more]
        left = left[more] - 8
