"""As-of joins, current state and validity (survey D, G, K batch twins)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import temporal as T
from ..operators.windows import micros, top_k
from .registry import GAMES, LOG, query, r4

_PURCHASES = "event_type = 'purchase'"


@query("d06_as_of_last_k", f"""WITH f AS (SELECT event_id, user_id, ts FROM events WHERE {_PURCHASES}), o AS (SELECT event_id AS seen_id, user_id, ts AS seen, value FROM events WHERE event_type = 'view'),
    j AS (SELECT f.event_id, o.value, row_number() OVER (PARTITION BY f.event_id ORDER BY seen DESC, seen_id DESC) AS r FROM f JOIN o ON f.user_id = o.user_id AND o.seen < f.ts)
    SELECT event_id, count(*) AS n, round(avg(value), 4) AS avg_5, round(avg(value) FILTER (WHERE r <= 3), 4) AS avg_3, round(max(value) FILTER (WHERE r = 1), 4) AS last_value FROM j WHERE r <= 5 GROUP BY event_id""")
def as_of_last_k(t):
    e = t("events")
    facts = e.where(_PURCHASES).select("event_id", "user_id", "ts")
    seen = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("seen"), F.col("event_id").alias("seen_id"), "value")
    r = T.recent_observations(facts, seen, ["user_id"], "event_id", "ts", "seen", "seen_id", ["value"], 5)
    return r.groupBy("event_id").agg(F.count("*").alias("n"), r4(F.avg("value")).alias("avg_5"), r4(F.avg(F.when(F.col("recency") <= 3, F.col("value")))).alias("avg_3"), r4(F.max(F.when(F.col("recency") == 1, F.col("value")))).alias("last_value"))


@query("d06_as_of_last", f"""SELECT f.event_id, o.event_id AS seen_id, o.value AS seen_value FROM (SELECT * FROM events WHERE {_PURCHASES}) f LEFT JOIN LATERAL
    (SELECT event_id, value FROM events o WHERE o.event_type = 'view' AND o.user_id = f.user_id AND o.ts < f.ts ORDER BY ts DESC, event_id DESC LIMIT 1) o ON true""")
def as_of_last(t):
    e = t("events")
    seen = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("seen"), F.col("event_id").alias("seen_id"), F.col("value").alias("seen_value"))
    return T.as_of(e.where(_PURCHASES).select("event_id", "user_id", "ts"), seen, ["user_id"], "ts", "seen", "seen_id", ["seen_id", "seen_value"]).select("event_id", "seen_id", "seen_value")


@query("d07_first_after", f"""SELECT f.event_id, o.event_id AS next_id FROM (SELECT * FROM events WHERE {_PURCHASES}) f LEFT JOIN LATERAL
    (SELECT event_id FROM events o WHERE o.event_type = 'view' AND o.user_id = f.user_id AND o.ts > f.ts ORDER BY ts, event_id LIMIT 1) o ON true""")
def first_after(t):
    e = t("events")
    seen = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("seen"), F.col("event_id").alias("next_id"))
    return T.next_after(e.where(_PURCHASES).select("event_id", "user_id", "ts"), seen, ["user_id"], "ts", "seen", "next_id", ["next_id"]).select("event_id", "next_id")


@query("d08_date_window_join", """WITH w AS (SELECT user_id, CAST(min(ts) AS DATE) AS a, CAST(min(ts) AS DATE) + 7 AS z FROM events WHERE event_type = 'signup' GROUP BY user_id)
    SELECT e.event_id, e.user_id FROM events e JOIN w ON e.user_id = w.user_id AND (CAST(e.ts AS DATE) BETWEEN a AND z OR e.event_type = 'error')""")
def date_window(t):
    e = t("events")
    w = e.where("event_type = 'signup'").groupBy("user_id").agg(F.to_date(F.min("ts")).alias("a"))
    return e.join(w, "user_id").where(F.to_date("ts").between(F.col("a"), F.date_add("a", 7)) | (F.col("event_type") == "error")).select("event_id", "user_id")


@query("d09_validity_intervals", """WITH c AS (SELECT * FROM (SELECT *, row_number() OVER w AS i, lag(event_type) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE i = 1 OR before IS DISTINCT FROM event_type),
    v AS (SELECT user_id, event_type, event_id, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to, ts FROM c)
    SELECT user_id, event_type, CAST(epoch_us(ts) AS BIGINT) AS from_us, CAST(epoch_us(valid_to) AS BIGINT) AS to_us, valid_to IS NULL AS active FROM v""")
def validity(t):
    v = T.validity(t("events"), ["user_id"], "ts", "event_id", "event_type")
    return v.select("user_id", "event_type", micros("valid_from").alias("from_us"), micros("valid_to").alias("to_us"), F.col("valid_to").isNull().alias("active"))


@query("d10_best_version", f"""WITH {LOG} SELECT user_id, k, event_id, value FROM log WHERE k IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id, k ORDER BY (event_type = 'purchase') DESC, value DESC NULLS LAST, event_id) = 1""")
def best_version(t):
    return T.best_version(t.log().where("k is not null"), ["user_id", "k"], [F.desc(F.col("event_type") == "purchase"), F.desc_nulls_last("value"), F.col("event_id")]).select("user_id", "k", "event_id", "value")


@query("d20_event_in_interval", """WITH c AS (SELECT user_id, ts AS a, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS z FROM events WHERE event_type = 'signup')
    SELECT e.event_id, CAST(epoch_us(c.a) AS BIGINT) AS start_us FROM events e JOIN c ON e.user_id = c.user_id AND e.ts > c.a AND (c.z IS NULL OR e.ts <= c.z) WHERE e.event_type = 'click'""")
def event_in_interval(t):
    """Each click with the signup that it follows: the last signup strictly before it."""
    e = t("events")
    seen = e.where("event_type = 'signup'").select("user_id", F.col("ts").alias("a"), F.col("event_id").alias("sid"))
    got = T.as_of(e.where("event_type = 'click'").select("event_id", "user_id", "ts"), seen, ["user_id"], "ts", "a", "sid", ["a"])
    return got.where("a is not null").select("event_id", micros("a").alias("start_us"))


@query("k01_current_state", f"""WITH {LOG} SELECT user_id, event_id, event_type, k FROM log QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def current_state(t):
    return T.latest(t.log(), ["user_id"], "ts", "event_id", ["event_id", "event_type", "k"])


@query("k02_idempotent_insert", """WITH old AS (SELECT * FROM events WHERE event_id % 3 <> 0), new AS (SELECT * FROM events WHERE event_id % 2 = 0) SELECT event_id, user_id FROM new WHERE event_id NOT IN (SELECT event_id FROM old)""")
def idempotent_insert(t):
    e = t("events").select("event_id", "user_id")
    incoming = e.where("event_id % 2 = 0")
    return T.insert_missing(e.where("event_id % 3 <> 0"), incoming.union(incoming), ["event_id"])


@query("k03_late_data_ignored", f"""WITH {LOG}, c AS (SELECT user_id, max(ts) - INTERVAL 10 DAY AS cutoff FROM log GROUP BY user_id)
    SELECT l.user_id, count(*) AS n, max(l.event_id) AS newest FROM log l JOIN c ON l.user_id = c.user_id AND l.ts <= c.cutoff WHERE l.event_type <> 'error' GROUP BY l.user_id""")
def late_ignored(t):
    log = t.log()
    c = log.groupBy("user_id").agg((F.max("ts") - F.expr("INTERVAL 10 DAYS")).alias("cutoff"))
    return log.where("event_type <> 'error'").join(c, "user_id").where("ts <= cutoff").groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("newest"))


@query("k04_correction_supersedes", """WITH old AS (SELECT user_id, event_id, ts, value FROM events WHERE event_type = 'view'), new AS (SELECT user_id, event_id, ts, value FROM events WHERE event_type = 'click')
    SELECT user_id, event_id, value FROM (SELECT * FROM old UNION ALL SELECT * FROM new) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def supersedes(t):
    e = t("events").select("user_id", "event_id", "ts", "value", "event_type")
    old, new = (e.where(F.col("event_type") == x).drop("event_type") for x in ("view", "click"))
    return T.upsert(old, new, ["user_id"], "ts", "event_id").select("user_id", "event_id", "value")


@query("k05_staleness", """WITH m AS (SELECT max(ts) AS now FROM events), l AS (SELECT event_type, max(ts) AS seen FROM events GROUP BY event_type)
    SELECT event_type, CAST(epoch_us(now) - epoch_us(seen) AS BIGINT) AS age_us, CASE WHEN epoch_us(now) - epoch_us(seen) <= CASE event_type WHEN 'view' THEN 360 WHEN 'click' THEN 720 ELSE 1440 END * 60000000::BIGINT THEN 'FRESH' ELSE 'STALE' END AS state FROM l, m""")
def staleness(t):
    e = t("events").select("event_type", micros("ts").alias("us"))
    l = e.groupBy("event_type").agg(F.max("us").alias("seen"))
    now = e.agg(F.max("us").alias("now"))
    minutes = F.when(F.col("event_type") == "view", 360).when(F.col("event_type") == "click", 720).otherwise(1440)
    age = F.col("now") - F.col("seen")
    return l.crossJoin(F.broadcast(now)).select("event_type", age.alias("age_us"), F.when(age <= minutes * F.lit(60_000_000).cast("long"), "FRESH").otherwise("STALE").alias("state"))


@query("k06_overrides_in_force", f"""WITH {LOG}, o AS (SELECT user_id, event_id, ts, value, CASE WHEN event_type = 'purchase' THEN 'SET' ELSE 'CLEAR' END AS action, CASE WHEN k % 2 = 0 THEN ts + INTERVAL 5 DAY END AS expiry
        FROM log WHERE event_type IN ('purchase', 'error') AND ts <= TIMESTAMP '2024-01-20 00:00:00'),
    l AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
    SELECT user_id, event_id, value FROM l WHERE action = 'SET' AND (expiry IS NULL OR expiry > TIMESTAMP '2024-01-20 00:00:00')""")
def in_force(t):
    o = t.log().where(F.col("event_type").isin("purchase", "error"))
    o = o.withColumns({"action": F.when(F.col("event_type") == "purchase", "SET").otherwise("CLEAR"), "expiry": F.when(F.col("k") % 2 == 0, F.col("ts") + F.expr("INTERVAL 5 DAYS"))})
    return T.in_force(o, ["user_id"], "ts", "event_id", "action", "expiry", F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"), ["event_id", "value"])


@query("k07_outcome_attached_later", f"""WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'signup'), o AS (SELECT user_id, ts AS seen, event_id AS outcome_id, value FROM events WHERE event_type = 'purchase')
    SELECT p.event_id, min_by(o.outcome_id, (o.seen, o.outcome_id)) AS outcome_id FROM p LEFT JOIN o ON p.user_id = o.user_id AND o.seen > p.ts GROUP BY p.event_id""")
def outcome_attached(t):
    e = t("events")
    seen = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("seen"), F.col("event_id").alias("outcome_id"))
    return T.next_after(e.where("event_type = 'signup'").select("event_id", "user_id", "ts"), seen, ["user_id"], "ts", "seen", "outcome_id", ["outcome_id"]).select("event_id", "outcome_id")


@query("a24_changed_rows", """WITH a AS (SELECT user_id, event_type, count(*) AS n, max(event_id) AS newest FROM events WHERE ts < TIMESTAMP '2024-01-15 00:00:00' GROUP BY ALL), b AS (SELECT user_id, event_type, count(*) AS n, max(event_id) AS newest FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' GROUP BY ALL)
    SELECT user_id, event_type, b.n, b.newest, concat_ws(',', CASE WHEN a.n IS DISTINCT FROM b.n THEN 'n' END, CASE WHEN a.newest IS DISTINCT FROM b.newest THEN 'newest' END) AS changed FROM a JOIN b USING (user_id, event_type) WHERE a.n IS DISTINCT FROM b.n OR a.newest IS DISTINCT FROM b.newest""")
def changed_rows(t):
    e = t("events")
    count = lambda x: x.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("newest"))
    out = T.changed_rows(count(e.where("ts < '2024-01-15'")), count(e.where("ts >= '2024-01-10'")), ["user_id", "event_type"], ["n", "newest"])
    return out.select("user_id", "event_type", "n", "newest", F.concat_ws(",", "changed").alias("changed"))


@query("a23_upsert_checkpoint", f"""WITH {GAMES} SELECT player_id, game_id, units FROM games QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY game_time DESC, game_id DESC) = 1""")
def upsert_checkpoint(t):
    g = t.games().select("player_id", "game_id", "game_time", "units", "season")
    old, new = g.where("season < 1998").drop("season"), g.where("season >= 1998").drop("season")
    return T.upsert(old, new, ["player_id"], "game_time", "game_id").select("player_id", "game_id", "units")


@query("g06_source_priority", f"""WITH {LOG} SELECT user_id, event_id FROM log QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 ELSE 1 END DESC, ts DESC, event_id DESC) = 1""")
def source_priority(t):
    rank = F.when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "signup", 2).otherwise(1)
    return top_k(t.log(), ["user_id"], [rank.desc(), F.desc("ts"), F.desc("event_id")], 1).select("user_id", "event_id")


@query("j27_availability", f"""WITH {LOG}, s AS (SELECT *, CASE event_type WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 ELSE 1 END AS priority FROM log WHERE ts <= TIMESTAMP '2024-01-25 00:00:00' AND event_type <> 'error'),
    m AS (SELECT *, max(priority) OVER (PARTITION BY user_id) AS top FROM s), c AS (SELECT user_id, count(DISTINCT event_type) > 1 AS conflict FROM s GROUP BY user_id)
    SELECT m.user_id, event_type AS status, event_id, conflict FROM m JOIN c USING (user_id) WHERE priority = top QUALIFY row_number() OVER (PARTITION BY m.user_id ORDER BY ts DESC, event_id DESC) = 1""")
def availability(t):
    s = t.log().where("ts <= '2024-01-25 00:00:00' and event_type <> 'error'")
    rank = F.when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "signup", 2).otherwise(1)
    g = s.groupBy("user_id").agg(F.max_by(F.struct("event_type", "event_id"), F.struct(rank.alias("p"), "ts", "event_id")).alias("x"), (F.count_distinct("event_type") > 1).alias("conflict"))
    return g.select("user_id", F.col("x.event_type").alias("status"), F.col("x.event_id").alias("event_id"), "conflict")


@query("j56_freshness", """SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 50) AS large, arg_max(value, (ts, event_id)) AS newest_value FROM events GROUP BY event_type""")
def freshness(t):
    return t("events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("large"), F.max_by("value", F.when(F.col("value").isNotNull(), F.struct("ts", "event_id"))).alias("newest_value"))
