"""Queues by host: a recorder shows that no host is asked twice within the spacing, rounds are resumed."""

import os
import time
import uuid
from collections import defaultdict

from pyspark.sql import functions as F

from lorewell.sources import fetch
from lorewell.session import table
from tests.conftest import SF

SPACING = 0.05


def recorder(folder, bad=lambda url: False):
    def get(url):
        now = time.time()
        with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
            f.write(f"{now}\n{url}")
        if bad(url):
            raise TimeoutError(url)
        return (403, "no") if len(url) % 5 == 0 else (200, "page of " + url)

    return get


def asked(folder):
    out = []
    for name in os.listdir(folder):
        with open(os.path.join(folder, name)) as f:
            t, url = f.read().split("\n")
            out.append((float(t), url))
    return sorted(out)


def test_no_host_is_hurried(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    pages = table(spark, SF, "pages").select("page_id", "url")
    pages = pages.unionByName(pages.limit(5)).unionByName(spark.createDataFrame([(-1, None), (-2, "no scheme")], "page_id long, url string"))
    got = fetch.fetch_politely(pages, str(tmp_path / "rounds"), recorder(str(folder)), attempts=2, spacing=SPACING, round_wait=0).collect()
    assert len(got) == pages.count()
    for r in got:
        blocked = r["url"] is not None and len(r["url"]) % 5 == 0
        assert (r["status"], r["attempts"]) == ((None, 0) if r["url"] is None else (403, 2) if blocked else (200, 1))
        assert r["html"] == (None if r["url"] is None or blocked else "page of " + r["url"])
    hosts = {r["url"]: r["h"] for r in pages.where("url IS NOT NULL").select("url", fetch.host_of(F.col("url")).alias("h")).collect()}
    times = defaultdict(list)
    for t, url in asked(folder):
        times[hosts[url]].append(t)
    assert len(times) > 5 and min(b - a for v in times.values() for a, b in zip(v, v[1:], strict=False)) >= SPACING * 0.98
    urls = [u for _, u in asked(folder)]
    assert len(urls) == sum(2 if len(u) % 5 == 0 else 1 for u in set(urls))


def test_rounds_are_resumed(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    urls = spark.createDataFrame([(f"http://h{i % 3}/x{'y' * (i % 7)}{i}",) for i in range(20)], "url string")
    path = str(tmp_path / "rounds")
    first = fetch.fetch_politely(urls, path, recorder(str(folder), lambda u: "h0" in u), attempts=1, spacing=0, round_wait=0)
    n = len(asked(folder))
    assert n == 20 and first.where("error LIKE 'TimeoutError%'").count() == 7
    again = fetch.fetch_politely(urls, path, recorder(str(folder)), attempts=3, spacing=0, round_wait=0).collect()
    bad = sum(r["status"] != 200 for r in first.collect())
    still = sum(len(r["url"]) % 5 == 0 for r in again)
    assert len(asked(folder)) == n + bad + still and sum(r["status"] == 200 for r in again) == 20 - still
