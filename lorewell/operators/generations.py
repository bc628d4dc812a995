"""A table of immutable generations (K5, K6): appended to, deleted from, compacted and replaced in one step each, under readers.

A table is a folder of parts and lists of deleted keys, and of numbered manifests that name them. What a manifest names is never
changed. A writer writes its files first and then the next manifest, by a rename that fails where that number is taken: of two writers
one is told so, and nobody sees half of a write. A reader takes the last manifest, or any older one, and finds the same rows as
long as vacuum() has not dropped it. Files of a writer that failed are named by nothing; vacuum() deletes them.

The driver handles names alone, some hundred bytes a part; compact() keeps their number small.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lorewell.session import free_name, remove

MANIFESTS = "_manifests"
#: Where writers may keep what they work from; nothing of it is part of a version.
STAGED = "staged"


class Conflict(RuntimeError):
    """Another writer has published first; nothing was changed. Read again and repeat."""


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, at = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def folders(spark: SparkSession, path: str) -> list[str]:
    """The names of the folders that a partitioned write has left below path."""
    return [n for n in _names(spark, path) if "=" in n]


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the manifests that are there, oldest first; none where there is no table."""
    return [int(n[:-5]) for n in _names(spark, f"{path}/{MANIFESTS}") if n.endswith(".json") and n[:-5].isdigit()]


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    """The manifest of a version, the last one unless told; None where there is no table."""
    if version is None:
        known = versions(spark, path)
        if not known:
            return None
        version = known[-1]
    fs, at = _fs(spark, f"{path}/{MANIFESTS}/{version:012d}.json")
    if not fs.exists(at):
        raise ValueError(f"{path} has no version {version}, it has {versions(spark, path)}")
    stream = fs.open(at)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")) | {"version": version}
    finally:
        stream.close()


def latest(spark: SparkSession, path: str, version: int) -> int:
    """The last version's number, by trying those that follow `version`; unlike versions(), it does not list all manifests."""
    while True:
        fs, at = _fs(spark, f"{path}/{MANIFESTS}/{version + 1:012d}.json")
        if not fs.exists(at):
            return version
        version += 1


def _publish(spark: SparkSession, path: str, before: dict | None, schema: StructType, parts: list[dict], deletes: list[dict]) -> int:
    """Writes the manifest that follows `before`, in one step, or raises Conflict."""
    version = (before["version"] if before else 0) + 1
    fs, new = _fs(spark, f"{path}/{MANIFESTS}/.{uuid.uuid4().hex}")
    fs.mkdirs(new.getParent())
    out = fs.create(new, True)
    out.write(bytearray(json.dumps({"schema": schema.json(), "parts": parts, "deletes": deletes}).encode()))
    out.close()
    jvm = spark.sparkContext._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(new, jvm.org.apache.hadoop.fs.Path(f"{path}/{MANIFESTS}/{version:012d}.json"), spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Py4JJavaError as e:
        fs.delete(new, False)
        if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
            raise Conflict(f"version {version} of {path} was written meanwhile") from e
        raise
    return version


def _part(df: DataFrame, path: str, folder: str, partition_by: str | None = None) -> str:
    name = f"{folder}/{uuid.uuid4().hex}"
    writer = df.write
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(f"{path}/{name}")
    return name


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a version. A part's rows whose key was deleted after it was written are left out, by one anti-join."""
    now = manifest(spark, path, version)
    if now is None:
        raise ValueError(f"there is no table at {path}")
    schema = StructType.fromJson(json.loads(now["schema"]))
    names = [f.name for f in schema]
    since, gone_key, at = (free_name(names, n) for n in ("_since", "_key", "_at"))
    out = spark.createDataFrame([], schema)
    if now["parts"]:
        out = None
        for parts in _alike(now):
            paths = [f"{path}/{p['name']}" for p in parts]
            rows = spark.read.schema(schema).parquet(*paths).select(*names, F.lit(parts[0]["since"]).alias(since))
            out = rows if out is None else out.unionByName(rows)
        for key in sorted({d["key"] for d in now["deletes"]}):
            gone = None
            for d in now["deletes"]:
                if d["key"] == key:
                    keys = spark.read.parquet(f"{path}/{d['name']}").select(F.col(key).alias(gone_key), F.lit(d["at"]).alias(at))
                    gone = keys if gone is None else gone.unionByName(keys)
            gone = gone.groupBy(gone_key).agg(F.max(at).alias(at))
            out = out.join(gone, (F.col(key) == F.col(gone_key)) & (F.col(since) < F.col(at)), "left_anti")
        out = out.drop(since)
    return out


def _alike(now: dict) -> list[list[dict]]:
    """The parts of a manifest in groups that one scan reads: those that the same deletes follow. A part that is split by a column's
    values stands alone, as Spark takes that column from the folders below one root."""
    ats, groups = [d["at"] for d in now["deletes"]], {}
    for p in now["parts"]:
        groups.setdefault((sum(at > p["since"] for at in ats), p["name"] if p["by"] else None), []).append(p)
    return list(groups.values())


def replace(df: DataFrame, path: str, partition_by: str | None = None) -> int:
    """A version that has df's rows alone. Readers of older versions go on."""
    spark = df.sparkSession
    before = manifest(spark, path)
    name = _part(df, path, "parts", partition_by)
    return _publish(spark, path, before, df.schema, [{"name": name, "since": (before["version"] if before else 0) + 1, "by": partition_by}], [])


def append(df: DataFrame, path: str, before: dict | None = None) -> int:
    """A version with df's rows besides those that are there; columns are matched by name.

    before: the manifest that df was made from, where it hangs on it; a later version of another writer is then a Conflict.
    """
    spark = df.sparkSession
    before = before or manifest(spark, path)
    if before is None:
        return replace(df, path)
    schema = StructType.fromJson(json.loads(before["schema"]))
    by = before["parts"][0]["by"] if before["parts"] else None
    part = {"name": _part(df.select(*[F.col(f.name).cast(f.dataType) for f in schema]), path, "parts", by), "since": before["version"] + 1, "by": by}
    return _publish(spark, path, before, schema, [*before["parts"], part], before["deletes"])


def delete(keys: DataFrame, path: str, key: str) -> int:
    """A version without the rows whose key is among the keys; no part is rewritten. Rows appended later may have them again."""
    spark = keys.sparkSession
    before = manifest(spark, path)
    if before is None:
        raise ValueError(f"there is no table at {path}")
    at = before["version"] + 1
    gone = {"name": _part(keys.select(key).where(F.col(key).isNotNull()).distinct(), path, "deletes"), "key": key, "at": at}
    return _publish(spark, path, before, StructType.fromJson(json.loads(before["schema"])), before["parts"], [*before["deletes"], gone])


def clear(spark: SparkSession, path: str) -> int:
    """K6: a version of no rows; the table stays readable."""
    before = manifest(spark, path)
    if before is None:
        raise ValueError(f"there is no table at {path}")
    return _publish(spark, path, before, StructType.fromJson(json.loads(before["schema"])), [], [])


def compact(spark: SparkSession, path: str) -> int:
    """A version of the same rows in one part, without deletes."""
    before = manifest(spark, path)
    if before is None:
        raise ValueError(f"there is no table at {path}")
    rows = read(spark, path, before["version"])
    by = before["parts"][0]["by"] if before["parts"] else None
    name = _part(rows, path, "parts", by)
    return _publish(spark, path, before, rows.schema, [{"name": name, "since": before["version"] + 1, "by": by}], [])


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Drops all but the last `keep` versions, and the files that none of these name; not to be run beside writers."""
    known = versions(spark, path)
    used = set()
    for v in known[-keep:]:
        m = manifest(spark, path, v)
        used |= {x["name"] for x in [*m["parts"], *m["deletes"]]}
    for v in known[:-keep]:
        remove(spark, f"{path}/{MANIFESTS}/{v:012d}.json")
    lost = [f"{folder}/{n}" for folder in ("parts", "deletes", STAGED) for n in _names(spark, f"{path}/{folder}") if f"{folder}/{n}" not in used]
    for name in lost:
        remove(spark, f"{path}/{name}")
    return lost
