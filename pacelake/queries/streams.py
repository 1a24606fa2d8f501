"""Streaming twins on the events table (survey K, extensions)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import streaming as S
from .registry import query, r4


@query("k10_tumbling_window", "SELECT CAST(epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS BIGINT) AS start_us, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY ALL")
def tumbling(t):
    out = S.drain(S.tumbling(S.event_stream(t.spark, t.folder), "ts", "1 day", "60 days", "event_type"), "complete", "tumbling")
    return out.select(F.unix_micros("window.start").alias("start_us"), "event_type", "n", F.round("total", 3).alias("total"))


@query("k10_sliding_window", "SELECT CAST(epoch_us(b) AS BIGINT) - d * 3600000000 AS start_us, count(*) AS n FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS b, unnest(range(0, 6)) AS d FROM events) GROUP BY 1")
def sliding(t):
    out = S.drain(S.sliding(S.event_stream(t.spark, t.folder), "ts", "6 hours", "1 hour", "60 days"), "complete", "sliding")
    return out.select(F.unix_micros("window.start").alias("start_us"), "n")


@query("k10_session_window", """WITH a AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 6 * 3600 * 1000000::BIGINT THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM a) SELECT user_id, CAST(min(epoch_us(ts)) AS BIGINT) AS start_us, count(*) AS n FROM b GROUP BY user_id, s""")
def session(t):
    out = S.drain(S.gap_sessions(S.event_stream(t.spark, t.folder), "ts", "6 hours", "60 days", "user_id"), "complete", "sessions")
    return out.select("user_id", F.unix_micros("session_window.start").alias("start_us"), "n")


@query("k01_streamed_current_state", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def streamed_state(t):
    return S.drain(S.current_state(S.event_stream(t.spark, t.folder), "user_id", "ts", "event_id", "event_type"), "complete", "state")


@query("k02_streamed_dedup", "SELECT DISTINCT user_id, event_type, CAST(epoch_us(ts) AS BIGINT) AS us FROM events")
def streamed_dedup(t):
    out = S.drain(S.distinct(S.event_stream(t.spark, t.folder).select("user_id", "event_type", "ts"), "user_id", "event_type", "ts"), "append", "dedup")
    return out.select("user_id", "event_type", F.unix_micros("ts").alias("us"))


@query("k07_streamed_outcomes", """WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'signup'), o AS (SELECT user_id, ts AS seen, event_id AS outcome_id FROM events WHERE event_type = 'purchase')
    SELECT p.event_id, min_by(o.outcome_id, (o.seen, o.outcome_id)) AS outcome_id, count(o.outcome_id) AS n FROM p LEFT JOIN o ON p.user_id = o.user_id AND o.seen > p.ts AND o.seen <= p.ts + INTERVAL 7 DAY GROUP BY p.event_id""")
def streamed_outcomes(t):
    """Signups with their first purchase of the seven days after, by a join of two streams; a signup without one keeps a row.

    The delay is the table's own time span, so no row is late.
    """
    span = t("events").agg(F.max("ts").alias("z"), F.min("ts").alias("a")).selectExpr("cast(ceil((unix_micros(cast(z as timestamp)) - unix_micros(cast(a as timestamp))) / 1e6) as long) as s").first()  # one row
    e = S.event_stream(t.spark, t.folder)
    made = e.where("event_type = 'signup'").select("event_id", "user_id", F.col("ts").alias("made"))
    seen = S.event_stream(t.spark, t.folder).where("event_type = 'purchase'").select("user_id", F.col("ts").alias("seen"), F.col("event_id").alias("outcome_id"))
    pairs = S.drain(S.outcomes(made, seen, "user_id", "made", "seen", "7 DAYS", f"{(span.s or 0) + 1} seconds").select("event_id", "seen", "outcome_id"), "append", "outcomes")
    first = pairs.groupBy("event_id").agg(F.min_by("outcome_id", F.struct("seen", "outcome_id")).alias("outcome_id"), F.count("*").alias("n"))
    return t("events").where("event_type = 'signup'").select("event_id").join(first, "event_id", "left").select("event_id", "outcome_id", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
