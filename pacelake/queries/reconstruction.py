"""Event-log reconstruction (survey J7-J10, J73): orders as games whose lines are substitutions.

Each order starts with S1 to S5; a line takes the starter of its part's number off for the bench
player of its supplier, so some orders break the rules and are quarantined.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import stints as S
from ..operators.windows import dealt
from .registry import query

EVENTS = """ev AS (SELECT l_orderkey AS game, l_linenumber AS n, CAST(l_linenumber * 300 + floor(l_quantity) AS INTEGER) AS sec, 'S' || (l_partkey % 5 + 1) AS o, 'B' || l_suppkey AS i, floor(l_quantity) AS points FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL)),
    bad AS (SELECT game, CASE WHEN bool_or(r = 'O') THEN 'OUT_NOT_ON_COURT' ELSE 'IN_ALREADY_ON_COURT' END AS reason FROM (SELECT game, r FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY game, o ORDER BY n) > 1 THEN 'O' WHEN row_number() OVER (PARTITION BY game, i ORDER BY n) > 1 THEN 'I' END AS r FROM ev) WHERE r IS NOT NULL QUALIFY row_number() OVER (PARTITION BY game ORDER BY sec) = 1) GROUP BY 1),
    good AS (SELECT * FROM ev WHERE game NOT IN (SELECT game FROM bad)), slots AS (SELECT DISTINCT game, unnest(['S1', 'S2', 'S3', 'S4', 'S5']) AS player FROM good),
    st AS (SELECT s.game, s.player, 0 AS a, coalesce(g.sec, 2400) AS z FROM slots s LEFT JOIN good g ON g.game = s.game AND g.o = s.player UNION ALL SELECT game, i, sec, 2400 FROM good)"""


def _lines(t):
    """A line for each number of an order; dealt by order before anything is grouped, so that all that follows by game stays in its part."""
    lines = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return dealt(lines, t.parts("lineitem"), ["l_orderkey"]).groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_quantity")])


def _spans(t):
    line = _lines(t).select(F.col("l_orderkey").alias("game"), (F.col("l_linenumber") * 300 + F.floor("l_quantity")).cast("int").alias("at"), F.concat(F.lit("S"), (F.col("l_partkey") % 5 + 1).cast("string")).alias("o"), F.concat(F.lit("B"), F.col("l_suppkey").cast("string")).alias("i"))
    moves = F.array(F.struct(F.col("o").alias("player"), F.lit("OUT").alias("action")), F.struct(F.col("i").alias("player"), F.lit("IN").alias("action")))
    subs = line.select("game", F.lit("H").alias("side"), "at", F.explode(moves).alias("m")).select("game", "side", "at", "m.player", "m.action")
    games = dealt(t("lineitem").select(F.col("l_orderkey").alias("game")), t.parts("lineitem"), ["game"]).distinct()
    starters = games.select("game", F.lit("H").alias("side"), F.explode(F.array(*[F.lit(f"S{k}") for k in range(1, 6)])).alias("player"))
    return S.spans(subs, starters, games.withColumn("seconds", F.lit(2400)), parts=S.AS_DEALT)


def _intervals(t):
    return S.intervals(S.gathered(_spans(t)))


def _stints(t):
    return S.stints(_spans(t))


def _box(t):
    """Seconds as a box score would give them: a starter's from the line that takes it off, a bench player's from then on, some of them off by a little or too much."""
    line = _lines(t).select(F.col("l_orderkey").alias("game"), (F.col("l_linenumber") * 300 + F.floor("l_quantity")).cast("int").alias("sec"), (F.col("l_partkey") % 5).cast("int").alias("o"), F.concat(F.lit("B"), F.col("l_suppkey").cast("string")).alias("i"))
    game = F.col("game")
    out = line.groupBy("game").agg(*[F.min(F.when(F.col("o") == k, F.col("sec"))).alias(f"s{k}") for k in range(5)])
    off = F.when(game % 11 == 0, 6).otherwise(game % 5)
    first = out.select("game", F.explode(F.array(*[F.struct(F.lit(f"S{k + 1}").alias("player"), (F.coalesce(f"s{k}", F.lit(2400)) + off).alias("seconds")) for k in range(5)])).alias("x")).select("game", "x.*")
    bench = line.groupBy("game", F.col("i").alias("player")).agg(F.min("sec").alias("sec")).select("game", "player", (2400 - F.col("sec") + game % 4).alias("seconds"))
    return first.union(bench).union(out.select("game", F.lit("N"), F.when(game % 13 == 0, 30).otherwise(game % 3)))


@query("j07_audit", f"WITH {EVENTS} SELECT game, reason FROM bad")
def audit(t):
    return _spans(t).where("reason is not null").groupBy("game", "side").agg(F.max("reason").alias("reason")).select("game", "reason")


@query("j07_player_stints", f"WITH {EVENTS} SELECT game, player, CAST(a AS INTEGER) AS from_s, CAST(z AS INTEGER) AS to_s FROM st WHERE z > a")
def stints(t):
    return _stints(t).select("game", "player", F.col("from").alias("from_s"), F.col("to").alias("to_s"))


_BOX = f"""{EVENTS}, every AS (SELECT DISTINCT game, unnest(['S1', 'S2', 'S3', 'S4', 'S5']) AS player FROM ev),
    box AS (SELECT s.game, s.player, coalesce(min(ev.sec), 2400) + CASE WHEN s.game % 11 = 0 THEN 6 ELSE s.game % 5 END AS official FROM every s LEFT JOIN ev ON ev.game = s.game AND ev.o = s.player GROUP BY s.game, s.player
        UNION ALL SELECT game, i, 2400 - min(sec) + game % 4 FROM ev GROUP BY game, i UNION ALL SELECT DISTINCT game, 'N', CASE WHEN game % 13 = 0 THEN 30 ELSE game % 3 END FROM ev),
    played AS (SELECT game, player, sum(z - a) AS s FROM st WHERE z > a GROUP BY ALL),
    err AS (SELECT box.game, box.player, official, coalesce(s, 0) AS rebuilt, coalesce(s, 0) - official AS e FROM box LEFT JOIN played ON played.game = box.game AND played.player = box.player WHERE box.game NOT IN (SELECT game FROM bad))"""


@query("j07_minute_audit", f"WITH {_BOX} SELECT game, player, CAST(official AS INTEGER) AS official_seconds, CAST(rebuilt AS INTEGER) AS reconstructed_seconds, CAST(e AS INTEGER) AS difference_seconds, abs(e) <= 5 AS within_tolerance FROM err")
def minute_audit(t):
    return S.minute_audit(_spans(t), _box(t), parts=S.AS_DEALT)


@query("j07_game_audit", f"""WITH {_BOX}, a AS (SELECT game, count(*) AS n, count(*) FILTER (WHERE e = 0) AS exact, count(*) FILTER (WHERE abs(e) <= 5) AS near, count(*) FILTER (WHERE abs(e) > 5) AS outside, max(abs(e)) AS most, sum(abs(e)) AS total FROM err GROUP BY 1)
    SELECT g.game, reason IS NULL AS structurally_reconstructed, reason IS NULL AND coalesce(outside, 0) = 0 AS rotation_usable, CASE WHEN reason IS NOT NULL THEN reason WHEN outside > 0 THEN 'PLAYER_MINUTES_OUTSIDE_TOLERANCE' END AS quarantine_reason, coalesce(n, 0) AS player_rows, coalesce(exact, 0) AS exact_player_rows,
        coalesce(near, 0) AS near_exact_player_rows, coalesce(outside, 0) AS outside_tolerance_player_rows, CAST(coalesce(most, 0) AS BIGINT) AS maximum_absolute_error_seconds, CAST(coalesce(total, 0) AS BIGINT) AS total_absolute_error_seconds
    FROM (SELECT DISTINCT game FROM ev) g LEFT JOIN bad ON bad.game = g.game LEFT JOIN a ON a.game = g.game""")
def game_audit(t):
    return S.game_audit(_spans(t), _box(t), parts=S.AS_DEALT)


@query("j07_accepted_stints", f"WITH {_BOX} SELECT game, player, CAST(a AS INTEGER) AS from_s, CAST(z AS INTEGER) AS to_s FROM st WHERE z > a AND game NOT IN (SELECT game FROM err WHERE abs(e) > 5)")
def accepted_stints(t):
    return S.stints(S.accepted(_spans(t), _box(t), parts=t.parts("lineitem"))).select("game", "player", F.col("from").alias("from_s"), F.col("to").alias("to_s"))


@query("j08_rotation", f"WITH {EVENTS} SELECT game, player, CAST(sum(z - a) AS BIGINT) AS seconds, count(*) AS stints, CAST(sum(greatest(0, z - greatest(a, 2280))) AS BIGINT) AS closing, min(a) = 0 AS started FROM st WHERE z > a GROUP BY ALL")
def rotation(t):
    s = _stints(t)
    return s.groupBy("game", "player").agg(F.sum(F.col("to") - F.col("from")).alias("seconds"), F.count("*").alias("stints"), F.sum(F.greatest(F.lit(0), F.col("to") - F.greatest("from", F.lit(2280)))).alias("closing"), (F.min("from") == 0).alias("started"))


@query("j09_on_off", f"WITH {EVENTS}, total AS (SELECT game, sum(points) AS p FROM good GROUP BY 1), ons AS (SELECT st.game, player, sum(points) AS p FROM st JOIN good g ON g.game = st.game AND g.sec > a AND g.sec <= z WHERE z > a GROUP BY ALL) SELECT st.game, st.player, coalesce(max(ons.p), 0)::DOUBLE AS on_points, (max(total.p) - coalesce(max(ons.p), 0))::DOUBLE AS off_points FROM st JOIN total ON total.game = st.game LEFT JOIN ons ON ons.game = st.game AND ons.player = st.player WHERE z > a GROUP BY ALL")
def on_off(t):
    """Off-court totals are the team's less what fell while on court."""
    s = _stints(t)
    points = _lines(t).select(F.col("l_orderkey").alias("game"), (F.col("l_linenumber") * 300 + F.floor("l_quantity")).cast("int").alias("at"), F.floor("l_quantity").cast("double").alias("points"))
    e = points.groupBy("game").agg(F.collect_list(F.struct("at", "points")).alias("e"), F.sum("points").alias("total"))  # a game's few events
    on = F.aggregate(F.filter("e", lambda x: (x["at"] > F.col("from")) & (x["at"] <= F.col("to"))), F.lit(0.0), lambda a, x: a + x["points"])
    return s.join(e, "game").groupBy("game", "player").agg(F.sum(on).alias("on_points"), (F.max("total") - F.sum(on)).alias("off_points"))


@query("j10_lineup_shares", f"WITH {EVENTS}, b AS (SELECT game, sec AS x FROM good UNION SELECT game, 0 FROM good UNION SELECT game, 2400 FROM good), i AS (SELECT game, lead(x) OVER (PARTITION BY game ORDER BY x) - x AS s FROM b), p AS (SELECT game, s / 2400.0::DOUBLE AS p FROM i WHERE s > 0) SELECT game, count(*) AS lineups, round(0 - sum(p * ln(p)), 6) AS entropy, round(max(p), 6) AS top1 FROM p GROUP BY 1")
def lineup_shares(t):
    p = _intervals(t).where("reason is null").groupBy("game", "court").agg((F.sum(F.col("to") - F.col("from")) / 2400.0).alias("p"))
    return p.groupBy("game").agg(F.count("*").alias("lineups"), F.round(E.entropy(F.col("p")), 6).alias("entropy"), F.round(F.max("p"), 6).alias("top1"))
