"""Streams run over all events that are there, and what they wrote."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlake.sources.shared import scratch
from ledgerlake.streaming import jobs

from .registry import Tables, query


def run(t: Tables, job, mode: str = "append"):
    events = jobs.source(t.spark, f"{t.sf_dir}/events.parquet")
    return jobs.run_to(job(events), scratch(t.spark, "stream"), scratch(t.spark, "progress"), mode)


def run_in_steps(t: Tables, rows, job, parts: int = 3):
    """job(stream, late) over `rows` that come in some disorder, a trigger a file."""
    path = scratch(t.spark, "arrivals")
    late = jobs.staged(rows, path, parts)
    # A part of a large table is many files: a trigger takes as many as there are tasks.
    stream = jobs.source(t.spark, path, max(1, t.spark.sparkContext.defaultParallelism))
    return jobs.run_to(job(stream, late), scratch(t.spark, "stream"), scratch(t.spark, "progress"))


@query("""SELECT strftime(time_bucket(INTERVAL 5 MINUTE, ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def stream_tumbling(t: Tables):
    """ST08 as a stream: counts in windows, the last state of each."""
    out = run(t, lambda e: jobs.tumbling_counts(e, "5 minutes", ["event_type"]), "complete")
    return out.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


@query("""WITH e AS (SELECT user_id, event_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS s, lag(event_type) OVER w AS before, lag(CAST(floor(epoch(ts)) AS BIGINT)) OVER w AS prev FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, event_id FROM e WHERE before IS NULL OR before <> event_type OR s - prev > 86400""")
def stream_repeats(t: Tables):
    """ST10 as a stream: keyed state holds the last value and its time."""
    return run_in_steps(t, t.events.select("user_id", "ts", "event_id", "event_type"), lambda e, late: jobs.first_of_repeats(e, "user_id", "event_id", "event_type", 86400, late))


@query("""WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq FROM events) SELECT user_id, seq AS sequence, 'released' AS outcome FROM e""")
def stream_reorder(t: Tables):
    """ST01 as a stream: numbered frames come out in order. Numbers are given before the stream, as a sender does."""
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long")
    numbered = t.events.select("user_id", "ts", number.alias("seq"), F.col("event_id").cast("string").alias("checksum"))
    return run_in_steps(t, numbered, lambda e, late: jobs.reordered(e, "user_id", "seq", "checksum", late=late))


#: A key's events one after the other, with the microseconds of each.
STEPS = "SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events"


@query(f"""WITH RECURSIVE e AS ({STEPS}), b AS (SELECT user_id, event_id, n, us, true AS passed, 5.0::DOUBLE - 1.0::DOUBLE AS remaining FROM e WHERE n = 1
UNION ALL SELECT user_id, event_id, n, us, there >= 1.0 AS passed, CASE WHEN there >= 1.0 THEN there - 1.0::DOUBLE ELSE there END FROM (SELECT e.*, least(5.0::DOUBLE, b.remaining + (e.us - b.us) / 1e6::DOUBLE * (1.0::DOUBLE / 3600)) AS there FROM b JOIN e ON b.user_id = e.user_id AND e.n = b.n + 1)) SELECT user_id, event_id, passed FROM b""")
def stream_rate_limit(t: Tables):
    """ST05 as a stream: token bucket."""
    return run_in_steps(t, t.events.select("user_id", "ts", "event_id"), lambda e, late: jobs.rate_limited(e, "user_id", "event_id", 1 / 3600, 5.0, late=late))


@query(f"""WITH RECURSIVE e AS ({STEPS} WHERE event_type = 'error'), b AS (SELECT user_id, event_id, n, us, false AS locked, us AS start, 1 AS count, -1::BIGINT AS until FROM e WHERE n = 1
UNION ALL SELECT user_id, event_id, n, us, CASE WHEN us < until THEN true ELSE c >= 3 END, CASE WHEN us < until THEN start WHEN c >= 3 THEN -1 ELSE s END, CASE WHEN us < until THEN count WHEN c >= 3 THEN 0 ELSE c END, CASE WHEN us >= until AND c >= 3 THEN us + 3600000000 ELSE until END
FROM (SELECT e.user_id, e.event_id, e.n, e.us, b.until, b.start, b.count, CASE WHEN b.start < 0 OR e.us - b.start >= 86400000000 THEN e.us ELSE b.start END AS s, CASE WHEN b.start < 0 OR e.us - b.start >= 86400000000 THEN 1 ELSE b.count + 1 END AS c FROM b JOIN e ON b.user_id = e.user_id AND e.n = b.n + 1)) SELECT user_id, event_id, locked FROM b""")
def stream_lockouts(t: Tables):
    """ST08 as a stream with windows that the first failure opens."""
    failures = t.events.filter("event_type = 'error'").select("user_id", "ts", "event_id")
    return run_in_steps(t, failures, lambda e, late: jobs.lockouts(e, "user_id", "event_id", 3, 86400, 3600, late))
