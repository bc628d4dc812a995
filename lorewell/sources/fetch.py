"""Page fetching behind a plug-in, and the crawls over it."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorewell.operators.catalog import not_cached
from lorewell.sources.pages import BAIKE_V1, WIKI, Selectors, crawl_rows, extract_pages, item_url

#: A url to its status and html; what it raises counts as a failed attempt.
Fetcher = Callable[[str], tuple[int, str | None]]


def offline(url: str) -> tuple[int, str | None]:
    """The default: nothing is fetched, and the status is 0."""
    return 0, None


def http(url: str, timeout: float = 20.0) -> tuple[int, str | None]:
    """A plain GET that follows redirects."""
    from urllib.error import HTTPError
    from urllib.parse import quote
    from urllib.request import Request, urlopen

    try:
        with urlopen(Request(quote(url, safe=":/?#&=%+,;@"), headers={"User-Agent": "Mozilla/5.0"}), timeout=timeout) as got:
            return got.status, got.read().decode(got.headers.get_content_charset() or "utf-8", "replace")
    except HTTPError as e:
        return e.code, None


def fetch(urls: DataFrame, fetcher: Fetcher = offline, attempts: int = 3, blocked_wait: float = 5.0, error_wait: float = 3.0) -> DataFrame:
    """H8: the rows of urls with status, html, attempts and error of the last attempt.

    A row is tried until its status is 200, at most `attempts` times, with a wait after 403 and after an error and none after
    other statuses. A null url is not tried. No row is dropped. Write the result before using it twice: every reading fetches anew.
    """

    def one(url: str | None) -> tuple[int | None, str | None, int, str | None]:
        status, html, error = None, None, None
        for i in range(attempts if url is not None else 0):
            wait = 0.0
            try:
                status, html = fetcher(url)
                error, wait = None, blocked_wait if status == 403 else 0.0
            except Exception as e:  # noqa: BLE001  what a plug-in raises is a failed attempt
                status, html, error, wait = None, None, f"{type(e).__name__}: {e}", error_wait
            if status == 200:
                return status, html, i + 1, None
            if i + 1 < attempts:
                time.sleep(wait)
        return status, None, attempts if url is not None else 0, error

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = pd.DataFrame([one(u) for u in batch["url"]], columns=["status", "html", "attempts", "error"], index=batch.index)
            yield pd.concat([batch, got.astype({"status": "Int32", "attempts": "int32"})], axis=1)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in urls.schema)
    return urls.mapInPandas(run, f"{schema}, status int, html string, attempts int, error string")


def host_of(url: Column) -> Column:
    """The host of a url in small letters, without user and port; what has none is a host of its own, the empty one."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def fetch_politely(urls: DataFrame, path: str, fetcher: Fetcher = offline, attempts: int = 3, spacing: float = 1.0, round_wait: float = 5.0) -> DataFrame:
    """H8, H9: as fetch(), with at least `spacing` seconds between two requests to a host, and retries in later rounds.

    Every round asks each url that is left once. A host belongs to one task, which takes the first url of each of its hosts, then the
    second of each, and so on; it waits only where that comes too soon for a host. A url that failed is left to the next round, before
    which the driver waits, and no task does. Every different url is asked once a round, however many rows have it.

    A round is written to path/round=i before the next begins; a run that was cut off goes on behind the last whole round that is
    there. A task that Spark repeats asks its hosts again. Null urls are not tried; no row is dropped.
    """
    spark = urls.sparkSession
    schema = "url string, status int, html string, attempts int, error string, asked double"
    left = urls.where("url IS NOT NULL").select("url").distinct().withColumn("asked", F.lit(None).cast("double"))
    for i in range(attempts):
        at = f"{path}/round={i}"
        if not _whole(spark, at):
            if i and left.isEmpty():
                break
            if i:
                time.sleep(round_wait)
            host = W.partitionBy("host")
            queued = left.withColumn("host", host_of(F.col("url"))).withColumns({"nth": F.row_number().over(host.orderBy("url")), "last": F.max("asked").over(host)})
            queued = queued.repartition("host").sortWithinPartitions("nth", "host").select("url", "host", "last")
            queued.mapInPandas(_ask(fetcher, i + 1, spacing), schema).write.mode("overwrite").parquet(at)
        left = spark.read.schema(schema).parquet(at).where("status IS NULL OR status <> 200").select("url", "asked")
    done = spark.read.schema(schema + ", round int").parquet(path).groupBy("url").agg(F.max_by(F.struct("status", "html", "attempts", "error"), "round").alias("r")).select("url", "r.*")
    found = urls.join(done, "url", "left").withColumn("attempts", F.coalesce("attempts", F.lit(0)))
    return found.select(*urls.columns, "status", "html", "attempts", "error")


def _whole(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _ask(fetcher: Fetcher, attempt: int, spacing: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked: dict[str, float] = {}
        for batch in batches:
            rows = []
            for url, host, last in batch.itertuples(index=False):
                before = asked.get(host, last if last == last and last is not None else 0.0)
                time.sleep(max(0.0, before + spacing - time.time()))
                asked[host] = time.time()
                try:
                    status, html = fetcher(url)
                    error = None
                except Exception as e:  # noqa: BLE001  what a plug-in raises is a failed attempt
                    status, html, error = None, None, f"{type(e).__name__}: {e}"
                rows.append((url, status, html if status == 200 else None, attempt, error, asked[host]))
            got = pd.DataFrame(rows, columns=["url", "status", "html", "attempts", "error", "asked"])
            yield got.astype({"status": "Int32", "attempts": "int32"})

    return run


def ok_pages(fetched: DataFrame) -> DataFrame:
    """F5."""
    return fetched.where("status = 200")


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crawl(characters: DataFrame, path: str, fetcher: Fetcher = offline, cache: DataFrame | None = None, category: str = "biography", **how) -> DataFrame:
    """S11 and S15 over (name): the gated results of the names whose page is not in the cache.

    A name is fetched once and has one result, however many rows have it. What was fetched is written to path, with the failures, and
    read from there; `how` goes to fetch().
    """
    wanted = characters.select(F.col("name").alias("character"), item_url(F.col("name")).alias("url")).distinct()
    if cache is not None:
        wanted = not_cached(wanted, cache)
    fetched = _written(fetch(wanted, fetcher, **how), path)
    return crawl_rows(extract_pages(ok_pages(fetched), Selectors(), name="character", carry=["character"]), F.col("character"), category=category)


#: The source's name, what stands before the name in its url, and how it is read.
SITES = (("维基百科", "https://zh.wikipedia.org/wiki/", WIKI), ("百度百科", "https://baike.baidu.com/item/", BAIKE_V1))


def crawl_sources(characters: DataFrame, path: str, fetcher: Fetcher = offline) -> DataFrame:
    """(content, source, character) of every site that has a text for a name; one attempt each, no gate."""
    out = None
    for i, (site, prefix, sel) in enumerate(SITES):
        wanted = characters.select(F.col("name").alias("character"), F.concat(F.lit(prefix), "name").alias("url"))
        fetched = _written(fetch(wanted, fetcher, attempts=1), f"{path}/site={i}")
        texts = extract_pages(ok_pages(fetched), sel, name="character", carry=["character"]).where("content != ''")
        rows = texts.select("content", F.concat(F.lit(f"{site}-"), "character").alias("source"), "character")
        out = rows if out is None else out.unionByName(rows)
    return out
