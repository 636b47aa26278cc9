"""Batch twins of the streaming operators: the same rows as a stream that has seen all events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlake.operators.core import latest

from .registry import Tables, query


def row_count():
    return F.count(F.lit(1))


def at_second():
    return F.unix_timestamp("ts")


def by_user():
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


EPOCH = "CAST(floor(epoch(ts)) AS BIGINT)"


@query("""WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, event_id FROM events), k AS (SELECT user_id, seq FROM e WHERE event_id % 37 <> 0), m AS (SELECT user_id, seq, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS rn FROM k) SELECT user_id, count(*) FILTER (WHERE seq = rn) AS released, count(*) FILTER (WHERE seq <> rn) AS waiting FROM m GROUP BY 1""")
def contiguous_prefix(t: Tables):
    """ST01: what a reorder buffer has released once a number is missing."""
    e = t.events.withColumn("seq", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))).filter("event_id % 37 != 0")
    m = e.withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy("seq")))
    return m.groupBy("user_id").agg(F.count_if(F.col("seq") == F.col("rn")).alias("released"), F.count_if(F.col("seq") != F.col("rn")).alias("waiting"))


@query("""WITH w AS (SELECT event_type, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start FROM events) SELECT event_type, strftime(start, '%Y-%m-%d %H:%M') AS start, count(*) AS n FROM w GROUP BY 1, 2""")
def sliding_window(t: Tables):
    """ST02: hour windows every half hour."""
    g = t.events.groupBy("event_type", F.window("ts", "60 minutes", "30 minutes")).agg(row_count().alias("n"))
    return g.select("event_type", F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "n")


@query(f"""WITH e AS (SELECT event_id, {EPOCH} AS s FROM events) SELECT event_id, CAST(floor((s + 900) / 1800) * 1800 AS BIGINT) AS owner FROM e""")
def window_ownership(t: Tables):
    """ST03: overlapping windows own what lies up to the midpoints between them."""
    return t.events.select("event_id", (F.floor((at_second() + 900) / 1800) * 1800).cast("long").alias("owner"))


@query(f"""WITH e AS (SELECT user_id, event_id, ts, CASE WHEN {EPOCH} - lag({EPOCH}) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 21600 THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM e) SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n FROM s GROUP BY 1, 2""")
def session_gap(t: Tables):
    """ST04: sessions end at a gap of six hours."""
    fresh = F.when(at_second() - F.lag(at_second()).over(by_user()) <= 21600, 0).otherwise(1)
    s = t.events.withColumn("fresh", fresh).withColumn("session", F.sum("fresh").over(by_user()))
    return s.groupBy("user_id", "session").agg(row_count().alias("n"))


@query("""SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS cursor FROM events""")
def event_cursor(t: Tables):
    """ST06: a log position for each key."""
    return t.events.select("event_id", "user_id", F.row_number().over(by_user()).alias("cursor"))


@query("""SELECT user_id, strftime(time_bucket(INTERVAL 5 MINUTE, ts), '%Y-%m-%d %H:%M') AS start, count(*) AS n, count(*) >= 2 AS locked FROM events WHERE event_type = 'error' GROUP BY 1, 2""")
def tumbling_count(t: Tables):
    """ST08: failures in five minutes."""
    g = t.events.filter("event_type = 'error'").groupBy("user_id", F.window("ts", "5 minutes")).agg(row_count().alias("n"))
    return g.select("user_id", F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "n", (F.col("n") >= 2).alias("locked"))


@query(f"""WITH e AS (SELECT *, max({EPOCH}) OVER () AS now FROM events), l AS (SELECT user_id, max(event_id) AS job, max({EPOCH}) AS beat, max(now) AS now, count(*) AS attempts FROM e GROUP BY 1) SELECT job, now - beat > 3600 AS expired, attempts >= 70 AS exhausted FROM l""")
def expired_leases(t: Tables):
    """ST09: jobs whose heartbeat is too old, and those out of attempts."""
    now = t.events.agg(F.max(at_second()).alias("now"))
    l = t.events.groupBy("user_id").agg(F.max("event_id").alias("job"), F.max(at_second()).alias("beat"), row_count().alias("attempts")).withColumn("now", now.scalar())
    return l.select("job", (F.col("now") - F.col("beat") > 3600).alias("expired"), (F.col("attempts") >= 70).alias("exhausted"))


@query(f"""WITH e AS (SELECT event_id, event_type, {EPOCH} AS s, lag(event_type) OVER w AS before, lag({EPOCH}) OVER w AS then FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT event_id FROM e WHERE before IS NULL OR before <> event_type OR s - "then" > 86400""")
def dedupe_within_window(t: Tables):
    """ST10: equal to the last of its key within a day is a repeat."""
    repeat = (F.lag("event_type").over(by_user()) == F.col("event_type")) & (at_second() - F.lag(at_second()).over(by_user()) <= 86400)
    return t.events.withColumn("repeat", F.coalesce(repeat, F.lit(False))).filter("NOT repeat").select("event_id")


@query("""SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def session_registry(t: Tables):
    """ST11, ST13: the newest entry of each session."""
    return latest(t.events, ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "event_id")
