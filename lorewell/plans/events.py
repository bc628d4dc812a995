"""Registered queries over events in time: joins, frames, windows of streams, state, sketches."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorewell.operators import sketches, timed
from lorewell.plans.registry import query, read_back
from lorewell.session import table
from lorewell.streaming import sessions, windows


def cents(c: str = "value"):
    """A value of two decimals as a whole number, so that sums do not hang on their order."""
    return F.round(F.col(c) * 100).cast("long")


def _of(spark, d, kind, **names):
    rows = table(spark, d, "events").where(F.col("event_type") == kind)
    return rows.select("user_id", *[F.col(c).alias(n) for n, c in names.items()])


@query("""SELECT p.event_id, p.user_id, v.event_id AS view_id, v.value AS view_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def time_as_of(spark, d):
    """Every purchase with the user's last view before it."""
    views = _of(spark, d, "view", view_ts="ts", view_id="event_id", view_value="value")
    return timed.as_of(_of(spark, d, "purchase", event_id="event_id", ts="ts"), views, "user_id", "ts", "view_ts", ["view_id", "view_value"], "view_id").drop("ts")


@query("""SELECT a.event_id, b.event_id AS error_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.event_type = 'error'
AND a.event_type = 'purchase' AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 600000000""")
def time_within(spark, d):
    """Purchases with the user's errors at most ten minutes away."""
    errors = _of(spark, d, "error", error_ts="ts", error_id="event_id")
    return timed.within(_of(spark, d, "purchase", event_id="event_id", ts="ts"), errors, "user_id", "ts", "error_ts", 600, prefix="").select("event_id", "error_id")


@query("""SELECT a.event_id, b.event_id AS signup_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.event_type = 'signup'
AND a.event_type = 'click' AND a.ts >= b.ts AND a.ts < b.ts + INTERVAL 6 HOUR""")
def time_contained(spark, d):
    """Clicks with the signups whose first six hours hold them."""
    first = _of(spark, d, "signup", signup_id="event_id", starts="ts").withColumn("ends", F.col("starts") + F.expr("interval 6 hours"))
    clicks = _of(spark, d, "click", event_id="event_id", ts="ts")
    return timed.contained(clicks, first, "user_id", "ts", "starts", "ends", 21_600, prefix="of_").select("event_id", F.col("of_signup_id").alias("signup_id"))


@query("""SELECT event_id, count(*) OVER w AS n, sum(round(value * 100)::BIGINT) OVER w::BIGINT AS cents, max(value) OVER w AS most FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 MINUTE PRECEDING AND CURRENT ROW)""")
def time_trailing(spark, d):
    """Every event with count, sum and maximum of its user's last hour."""
    rows = table(spark, d, "events").select("event_id", "user_id", "ts", "value", cents().alias("c"))
    out = timed.trailing(rows, "user_id", "ts", 3_600, {"n": F.count(F.lit(1)), "cents": F.sum("c"), "most": F.max("value")})
    return out.select("event_id", "n", "cents", "most")


def _stream(spark, d, name):
    """A given table as a stream of its files; a pattern names it, as a stream's plain path must be a folder."""
    return windows.file_stream(spark, f"{d}/{name}.parque[t]", table(spark, d, name).schema)


def _events(spark, d):
    """Events whose time can carry a watermark."""
    return _stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _plain_times(rows):
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("starts", "ends")})


def totals():
    return {"n": F.count(F.lit(1)), "cents": F.sum(cents())}


@query("""WITH w AS (SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS starts, value FROM events),
g AS (SELECT event_type, starts, starts + INTERVAL 1 HOUR AS ends, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM w GROUP BY event_type, starts)
SELECT * FROM g WHERE ends <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def stream_tumbling(spark, d):
    """Hours by kind of event that the watermark has closed, through a stream into a table; a second run finds nothing new."""

    def write(path):
        for _ in range(2):
            windows.run(windows.tumbling(_events(spark, d), "ts", ["event_type"], "1 hour", "10 minutes", totals()), f"{path}/rows", f"{path}/checkpoint")

    return read_back(spark, write, lambda p: _plain_times(spark.read.parquet(f"{p}/rows")))


@query("""WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM e)
SELECT user_id, min(ts) AS starts, max(ts) + INTERVAL 30 MINUTE AS ends, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM s GROUP BY user_id, session
HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def stream_sessions(spark, d):
    """Sessions of users that the watermark has closed, through a stream into a table."""
    result = windows.sessions(_events(spark, d), "ts", ["user_id"], "30 minutes", "10 minutes", totals())
    return read_back(spark, lambda p: windows.run(result, f"{p}/rows", f"{p}/checkpoint"), lambda p: _plain_times(spark.read.parquet(f"{p}/rows")))


@query("SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END AS role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def stream_memory(spark, d):
    """M1: what sessions remember after their messages came as a stream."""

    def write(path):
        old = spark.conf.get(sessions.PROVIDER[0])
        sessions.run(_stream(spark, d, "conversations"), f"{path}/rows", f"{path}/checkpoint", 3)
        spark.conf.set(sessions.PROVIDER[0], old)

    return read_back(spark, write, lambda p: spark.read.parquet(f"{p}/rows")).drop("batch")


_WIDTH = "ln((1 + 0.01) / (1 - 0.01))"


@query(f"""WITH b AS (SELECT l_returnflag, floor(ln(l_extendedprice) / {_WIDTH}) AS power, count(*) AS n FROM lineitem GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY l_returnflag ORDER BY power) AS upto, sum(n) OVER (PARTITION BY l_returnflag) AS total FROM b)
SELECT l_returnflag, q, round(exp(power * {_WIDTH}) * 1.01, 4) AS value FROM c, (VALUES (0.01::DOUBLE), (0.5), (0.9), (0.999)) v(q) WHERE upto >= ceil(q * total) AND upto - n < ceil(q * total)""")
def sketch_quantiles(spark, d):
    """Quantiles of prices from sketches that were stored by month and merged."""
    rows = table(spark, d, "lineitem").withColumn("month", F.trunc("l_shipdate", "month"))
    bins = sketches.quantile_bins(rows, ["month", "l_returnflag"], "l_extendedprice")
    stored = read_back(spark, lambda p: sketches.upsert_days(bins, p, "month"), spark.read.parquet)
    found = sketches.quantiles(sketches.merged_bins(stored, ["l_returnflag"]), ["l_returnflag"], [0.01, 0.5, 0.9, 0.999])
    return found.withColumn("value", F.round("value", 4))


@query("SELECT event_type, count(user_id) AS n, count(DISTINCT user_id) AS exact, true AS within FROM events GROUP BY event_type")
def sketch_distinct(spark, d):
    """Users by kind of event from sketches that were stored by day and merged, beside the exact count: within 4 standard errors."""
    events = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    stored = read_back(spark, lambda p: sketches.upsert_days(sketches.distinct_sketches(events, ["day", "event_type"], "user_id"), p, "day"), spark.read.parquet)
    about = sketches.distinct_counts(sketches.merged_distinct(stored, ["event_type"]))
    exact = events.groupBy("event_type").agg(F.count_distinct("user_id").alias("exact"))
    near = F.abs(F.col("n_distinct") - F.col("exact")) <= F.lit(4 * 1.04 / 2 ** (sketches.LG_K / 2)) * F.col("exact")
    return about.join(exact, "event_type").select("event_type", "n", "exact", near.alias("within"))
