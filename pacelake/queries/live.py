"""Live context and turn decisions (survey A20, A21, G7, J20, J31, J32, J42, J71-J73, J77)."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import allocation as A
from ..operators import live as L
from ..operators.windows import dealt, micros, numbered
from .decisions import CAPPED
from .reconstruction import EVENTS, _intervals, _lines
from .registry import GAMES, query, r4


@query("a20_registered_relation", "SELECT o_orderstatus, count(*) AS n, CAST(sum(k) AS BIGINT) AS k FROM (SELECT o_orderstatus, o_orderkey % 7 AS k FROM orders) GROUP BY 1")
def registered(t):
    """A frame under a name for SQL; the name goes, the plan stays."""
    name = f"frame_{uuid4().hex}"  # no caller's view has it
    t("orders").withColumn("k", F.col("o_orderkey") % 7).createTempView(name)
    out = t.spark.sql(f"SELECT o_orderstatus, count(*) AS n, sum(k) AS k FROM {name} GROUP BY 1")
    t.spark.catalog.dropTempView(name)
    return out


@query("a21_ordered_batches", "SELECT CAST((k - 1) // 500 AS BIGINT) AS batch, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS k FROM orders) GROUP BY 1")
def ordered_batches(t):
    """Batches of an ordered scan: rows are numbered in parts, so no task sorts them all."""
    n = numbered(t("orders").select("o_orderkey", micros("o_orderdate").alias("us")), [], "us", "o_orderkey", "k")
    return n.groupBy(F.floor((F.col("k") - 1) / 500).alias("batch")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))


@query("g07_order_by_all", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber, l_discount FROM lineitem ORDER BY ALL")
def order_by_all(t):
    return t.spark.sql("SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber, l_discount FROM {line} ORDER BY ALL", line=t("lineitem"))


@query("j20_reconciled_deltas", CAPPED.format("SELECT l_orderkey AS g, l_linenumber AS i, l_quantity + (l_discount * 100 - 5) AS x FROM lineitem") + " SELECT g AS game_id, i AS line, round(least(greatest(x + s, 0), 40), 4) AS minutes FROM r JOIN s USING (g)")
def reconciled(t):
    """Baselines and predicted changes of a team, brought to its 200 minutes."""
    raw = t("lineitem").select(F.col("l_orderkey").alias("game_id"), F.col("l_linenumber").alias("line"), (F.col("l_quantity") + (F.col("l_discount") * 100 - 5)).alias("raw"))
    return A.project_to_total(raw, ["game_id"], "line", "raw", 200.0, 0.0, 40.0).select("game_id", "line", r4("projected").alias("minutes"))


_KIND = "CASE priority WHEN '1' THEN 'FRIENDLY' WHEN '2' THEN 'PRESEASON_TOURNAMENT' WHEN '3' THEN 'SUPERCUP' WHEN '4' THEN 'DOMESTIC_OFFICIAL' ELSE 'OTHER' END"


@query("j31_preparation_context", f"""WITH {GAMES}, g AS (SELECT player_id, game_id, game_time, units / 10 AS minutes, CAST(returned = 0 AS INTEGER) AS starter, n_lines * 10 AS points, CASE priority WHEN '1' THEN 0.2::DOUBLE WHEN '2' THEN 0.3::DOUBLE WHEN '3' THEN 0.65::DOUBLE WHEN '4' THEN 0.75::DOUBLE END AS kw, max(game_time) OVER () AS cutoff FROM games),
    h AS (SELECT *, kw * pow(2, -date_diff('second', game_time, cutoff) / 86400.0::DOUBLE / 21) AS w, CASE WHEN minutes >= 5 THEN points / minutes END AS rate FROM g WHERE kw IS NOT NULL AND game_time < cutoff AND game_time >= cutoff - INTERVAL 60 DAY QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY game_time DESC, game_id DESC) <= 5),
    p AS (SELECT player_id, count(*) AS n, least(0.5::DOUBLE, 0.5::DOUBLE * sum(w)) AS w, sum(w * minutes) / sum(w) AS m, sum(w * starter) / sum(w) AS s, sum(w * rate) / sum(w) FILTER (WHERE rate IS NOT NULL) AS r FROM h GROUP BY 1),
    b AS (SELECT player_id, avg(minutes) AS baseline, avg(starter) AS starter_rate, sum(points) / sum(minutes) AS rate FROM g WHERE game_time < cutoff - INTERVAL 60 DAY GROUP BY 1),
    a AS (SELECT b.*, n, coalesce(w, 0) AS w, s, r, least(greatest(baseline + coalesce(w * (m - baseline), 0), 0), 40) AS adjusted FROM b LEFT JOIN p ON b.player_id = p.player_id)
    SELECT player_id, n AS prep_games, round(w, 6) AS prep_weight, round(adjusted, 6) AS adjusted, round(CASE WHEN n IS NULL THEN starter_rate ELSE (1 - w) * starter_rate + w * s END, 6) AS expected_starter_rate,
    round(least(greatest((adjusted - baseline) * rate + coalesce(least(greatest(r - rate, -0.5), 0.5) * w * adjusted, 0), -5), 5)::DOUBLE, 6) AS points_delta, CASE WHEN adjusted - baseline >= 0.5 THEN 'TRENDING UP' WHEN adjusted - baseline <= -0.5 THEN 'TRENDING DOWN' ELSE 'STABLE' END AS role_change FROM a""")
def preparation(t):
    """Games of the last 60 days beside a baseline from all games before them."""
    g = t.games().select("player_id", "game_id", "game_time", (F.col("units") / 10).alias("minutes"), (F.col("returned") == 0).cast("int").alias("starter"), (F.col("n_lines") * 10).alias("points"), F.expr(_KIND).alias("kind"))
    g = g.crossJoin(F.broadcast(g.agg(F.max("game_time").alias("cutoff"))))  # one row
    old = g.where(F.col("game_time") < F.col("cutoff") - F.expr("INTERVAL 60 DAY"))
    base = old.groupBy("player_id").agg(F.avg("minutes").alias("baseline"), F.avg("starter").alias("starter_rate"), (F.sum("points") / F.sum("minutes")).alias("rate"))
    out = L.with_preparation(base.join(L.preparation(g, "player_id", "game_time", "game_id", F.col("cutoff")), "player_id", "left"))
    return out.select("player_id", "prep_games", *[F.round(c, 6).alias(c) for c in ("prep_weight", "adjusted", "expected_starter_rate", "points_delta")], "role_change")


@query("j32_matchday", """WITH m AS (SELECT o_custkey AS scope, o_orderkey AS batch, o_orderdate AS observed, o_orderkey % 5 + CAST(l_tax >= 0.08 AS INTEGER) AS matchday, (l_partkey % 4) || '|' || (CASE WHEN l_partkey % 2 = 0 THEN l_partkey % 4 + 1 ELSE l_partkey % 4 - 1 END) AS pair FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
    b AS (SELECT scope, batch, max(observed) AS observed, list(DISTINCT matchday) AS days, list(DISTINCT pair) AS pairs FROM m GROUP BY ALL), l AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY scope ORDER BY observed DESC, batch DESC) = 1),
    r AS (SELECT scope, CASE WHEN len(days) = 1 THEN days[1] END AS matchday, pairs, scope % 5 AS round, CASE scope % 3 WHEN 0 THEN ['0|1', '1|0', '2|3', '3|2'] WHEN 1 THEN ['0|1', '1|0'] END AS sp FROM l),
    x AS (SELECT *, CASE WHEN sp IS NOT NULL THEN round END AS slate_round FROM r)
    SELECT scope, CASE WHEN method IS NULL THEN 'AMBIGUOUS' ELSE 'RESOLVED' END AS status, matchday, slate_round AS round, method FROM (SELECT *, CASE WHEN matchday IS NULL OR slate_round IS NULL THEN NULL WHEN matchday % 2 = 0 AND matchday = slate_round THEN 'DIRECT'
        WHEN len(pairs) >= 2 AND (list_has_all(sp, pairs) OR (list_has_all(pairs, sp) AND (scope % 2 = 0 OR list_has_any(pairs, ['2|3', '3|2'])))) THEN 'CONTEXT' END AS method FROM x)""")
def matchday(t):
    """Customers as seasons, orders as market batches of fixtures 0-1 and 2-3; odd seasons have 0-1 in a second round too."""
    team, other = F.col("l_partkey") % 4, F.when(F.col("l_partkey") % 2 == 0, F.col("l_partkey") % 4 + 1).otherwise(F.col("l_partkey") % 4 - 1)
    market = t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("scope"), F.col("o_orderkey").alias("batch"), F.col("o_orderdate").alias("observed"), (F.col("o_orderkey") % 5 + (F.col("l_tax") >= 0.08).cast("int")).alias("matchday"), team.alias("team"), other.alias("opponent"))
    scopes = t("orders").select(F.col("o_custkey").alias("scope")).distinct()
    pairs = F.when(F.col("scope") % 3 == 0, F.expr("array(struct(0L, 1L), struct(1L, 0L), struct(2L, 3L), struct(3L, 2L))")).when(F.col("scope") % 3 == 1, F.expr("array(struct(0L, 1L), struct(1L, 0L))"))
    slate = scopes.select("scope", (F.col("scope") % 5).alias("round"), F.explode(pairs).alias("p")).select("scope", "round", F.col("p.col1").alias("team"), F.col("p.col2").alias("opponent"))
    mapping = scopes.select("scope", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))).alias("matchday")).select("scope", "matchday", F.col("matchday").alias("round"), (F.col("matchday") % 2 == 0).alias("validated"))
    rounds = F.expr("CASE WHEN scope % 2 = 1 THEN array(struct(scope % 5, 0L, 1L), struct(scope % 5, 3L, 2L), struct(scope % 5 + 1, 1L, 0L)) ELSE array(struct(scope % 5, 0L, 1L), struct(scope % 5, 3L, 2L)) END")
    schedule = scopes.select("scope", F.explode(rounds).alias("r")).toDF("scope", "r").select("scope", F.col("r.col1").alias("round"), F.col("r.col2").alias("home"), F.col("r.col3").alias("away"))
    return L.matchday(market, slate, mapping, schedule, "scope")


@query("j42_turn_transitions", """WITH o AS (SELECT l_orderkey, list(l_partkey ORDER BY l_partkey) AS p, list(l_partkey ORDER BY l_partkey) FILTER (WHERE l_linenumber <= 3) AS st, coalesce(list(l_partkey) FILTER (WHERE l_returnflag = 'R'), []) AS gone, max(l_suppkey) AS top, min(l_suppkey) AS low FROM lineitem GROUP BY 1),
    x AS (SELECT *, l_orderkey % 5 AS k FROM o WHERE st IS NOT NULL), y AS (SELECT *, p[1] AS cap, p[-1] AS alt, CASE WHEN k IN (1, 2) THEN list_append(st, p[-1]) ELSE st END AS st2 FROM x)
    SELECT l_orderkey, concat_ws('|', CASE WHEN k = 3 AND top <> low THEN 'TRADE' END, CASE WHEN k = 4 AND cap <> alt THEN 'SIXTH' END, CASE WHEN len(list_filter(st2, lambda v: NOT list_contains(st, v) AND list_contains(gone, v))) > 0 THEN 'PROMOTED' END,
        CASE WHEN k >= 2 AND alt <> st[1] AND list_contains(gone, alt) THEN 'CAPTAIN_PLAYED' END, CASE WHEN k >= 2 AND NOT list_contains(st2, alt) THEN 'CAPTAIN_BENCHED' END) AS breaks FROM y""")
def transitions(t):
    """Lines 1 to 3 start, returned lines have played; the order's number says what the next turn changes."""
    flagged = lambda c: F.sort_array(F.collect_list(F.when(F.expr(c), F.col("l_partkey"))))
    o = t("lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_partkey")).alias("p"), flagged("l_linenumber <= 3").alias("st"), flagged("l_returnflag = 'R'").alias("gone"), F.max("l_suppkey").alias("top"), F.min("l_suppkey").alias("low")).where("size(st) > 0").withColumn("k", F.col("l_orderkey") % 5)
    first, last = F.element_at("p", 1), F.element_at("p", -1)
    lineup = lambda coach, sixth, captain, starters: F.struct(F.col("p").alias("players"), coach.alias("coach"), sixth.alias("sixth"), captain.alias("captain"), starters.alias("starters"))
    k, st = F.col("k"), F.col("st")
    before = lineup(F.col("top"), first, F.element_at("st", 1), st)
    after = lineup(F.when(k == 3, F.col("low")).otherwise(F.col("top")), F.when(k == 4, last).otherwise(first), F.when(k >= 2, last).otherwise(F.element_at("st", 1)), F.when(k.isin(1, 2), F.concat(st, F.array(last))).otherwise(st))
    return o.withColumns({"before": before, "after": after}).select("l_orderkey", L.transition_breaks("before", "after", "gone").alias("breaks"))


@query("j71_event_diagnostics", """WITH e AS (SELECT *, lag(l_linenumber) OVER w AS n0, lag(l_quantity) OVER w AS q0, count(*) OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS same FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity))
    SELECT l_orderkey, count(*) AS events, count(*) FILTER (WHERE l_linenumber < n0) AS inversions, count(*) - count(DISTINCT l_linenumber) AS duplicate_numbers, max(l_linenumber)::BIGINT - min(l_linenumber) + 1 - count(DISTINCT l_linenumber) AS gaps, count(*) FILTER (WHERE same > 1) AS duplicate_events, count(*) FILTER (WHERE l_quantity > q0) AS clock_increases FROM e GROUP BY 1""")
def diagnostics(t):
    """Lines in the order of their ship dates; quantity stands for the clock that should only fall."""
    w = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    same = Window.partitionBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    e = dealt(t("lineitem"), t.parts("lineitem"), ["l_orderkey"]).withColumns({"n0": F.lag("l_linenumber").over(w), "q0": F.lag("l_quantity").over(w), "same": F.count("*").over(same)})
    numbers = F.count_distinct("l_linenumber")
    return e.groupBy("l_orderkey").agg(F.count("*").alias("events"), F.count_if(F.col("l_linenumber") < F.col("n0")).alias("inversions"), (F.count("*") - numbers).alias("duplicate_numbers"), (F.max("l_linenumber").cast("long") - F.min("l_linenumber") + 1 - numbers).alias("gaps"), F.count_if(F.col("same") > 1).alias("duplicate_events"), F.count_if(F.col("l_quantity") > F.col("q0")).alias("clock_increases"))


@query("j72_same_clock", """WITH e AS (SELECT *, CAST(ts AS DATE) AS period, CAST(floor(value) AS BIGINT) AS clock, user_id % 3 AS team, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS n FROM events), s AS (SELECT * FROM e WHERE event_type IN ('click', 'purchase')), o AS (SELECT * FROM e WHERE event_type = 'error')
    SELECT o.period, count(*) AS timeouts, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM s WHERE s.period = o.period AND s.clock = o.clock)) AS with_any, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM s WHERE s.period = o.period AND s.clock = o.clock AND s.team = o.team)) AS with_same_team,
    count(*) FILTER (WHERE EXISTS (SELECT 1 FROM s WHERE s.period = o.period AND s.clock = o.clock AND s.n IN (o.n - 1, o.n + 1))) AS adjacent FROM o GROUP BY 1""")
def same_clock(t):
    """Timeouts beside substitutions of the same clock: rows are numbered in ranges of the order, and a timeout asks by keys, so no day is sorted in one task."""
    e = t("events").select("event_id", "ts", "event_type", F.to_date("ts").alias("period"), F.floor("value").alias("clock"), (F.col("user_id") % 3).alias("team"))
    e = numbered(e, ["period"], "ts", "event_id", "n")
    subs, timeouts = e.where(F.col("event_type").isin("click", "purchase")), e.where("event_type = 'error'")
    there = lambda name, *keys: subs.select(*keys).distinct().withColumn(name, F.lit(True))
    beside = timeouts.select("event_id", "period", "clock", F.explode(F.array(F.col("n") - 1, F.col("n") + 1)).alias("n")).join(subs.select("period", "clock", "n"), ["period", "clock", "n"], "left_semi").select("event_id").distinct().withColumn("next", F.lit(True))
    e = timeouts.join(there("any", "period", "clock"), ["period", "clock"], "left").join(there("own", "period", "clock", "team"), ["period", "clock", "team"], "left").join(beside, "event_id", "left")
    return e.groupBy("period").agg(F.count("*").alias("timeouts"), F.count_if("any").alias("with_any"), F.count_if("own").alias("with_same_team"), F.count_if("next").alias("adjacent"))


@query("j73_actor_boundaries", f"WITH {EVENTS}, act AS (SELECT l_orderkey AS game, CAST(l_linenumber * 300 + floor(l_quantity) AS INTEGER) AS sec, CASE WHEN l_linenumber % 2 = 0 THEN 'B' || l_suppkey ELSE 'S' || (l_partkey % 4 + 1) END AS player FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL)) SELECT game, count(*) AS actors, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.game = act.game AND st.player = act.player AND z > a AND act.sec BETWEEN a AND z)) AS outside FROM act WHERE game IN (SELECT game FROM good) GROUP BY 1")
def actor_boundaries(t):
    """Event actors who are in the lineup neither before nor after the instant of their event."""
    player = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("B"), F.col("l_suppkey").cast("string"))).otherwise(F.concat(F.lit("S"), (F.col("l_partkey") % 4 + 1).cast("string")))
    actors = _lines(t).select(F.col("l_orderkey").alias("game"), F.lit("H").alias("side"), (F.col("l_linenumber") * 300 + F.floor("l_quantity")).cast("int").alias("at"), player.alias("player"))
    return L.outside_lineups(actors, _intervals(t), parts=t.parts("lineitem")).groupBy("game").agg(F.count("*").alias("actors"), F.count_if(~F.col("inside")).alias("outside"))


@query("j77_decision_threshold", "WITH r AS (SELECT l_orderkey, max(l_quantity) AS captain, min(l_quantity) AS worst, quantile_disc(l_quantity, 0.5) AS bench FROM lineitem GROUP BY 1) SELECT l_orderkey, CASE WHEN worst - 30 < bench / 1.1::DOUBLE AND captain + 30 >= bench / 1.1::DOUBLE THEN round(bench / 1.1::DOUBLE, 2) END AS threshold FROM r")
def decision_threshold(t):
    """The captain's score below which another player takes the place."""
    r = t("lineitem").groupBy("l_orderkey").agg(F.max("l_quantity").alias("captain"), F.min("l_quantity").alias("worst"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY l_quantity)").alias("bench"))
    turn = L.threshold(F.col("worst") - 30, F.col("captain") + 30, lambda v: v * 1.1 < F.col("bench"))
    return r.select("l_orderkey", F.round(turn, 2).alias("threshold"))
