"""Possessions, rich feature families and the current slate (survey J7, J12, J25)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import temporal as T
from ..operators.stints import possessions
from ..operators.windows import dealt
from ..plans import shot_features as S
from .player_table import _sql, features
from .reconstruction import EVENTS, _intervals, _lines, lineup_shares, on_off, rotation
from .registry import query, r4

_MIN = "(SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL)"


def _at():
    return (F.col("l_linenumber") * 300 + F.floor("l_quantity")).cast("int")


@query("j07_possessions", f"""WITH {EVENTS}, p AS (SELECT l_orderkey AS game, CAST(l_linenumber * 300 + floor(l_quantity) AS INTEGER) AS sec, ['2FGM', '3FGA', 'O', 'TO', 'FTM'][(l_partkey + l_suppkey) % 5 + 1] AS play, l_suppkey % 2 = 0 AS own FROM {_MIN}),
    b AS (SELECT game, sec AS x FROM good UNION SELECT game, 0 FROM good UNION SELECT game, 2400 FROM good), i AS (SELECT game, x AS a, lead(x) OVER (PARTITION BY game ORDER BY x) AS z FROM b),
    n AS (SELECT i.game, a, z, count(*) FILTER (WHERE own AND play IN ('2FGM', '3FGA')) AS fga, count(*) FILTER (WHERE own AND play = 'O') AS oreb, count(*) FILTER (WHERE own AND play = 'TO') AS tov, count(*) FILTER (WHERE own AND play = 'FTM') AS fta,
        count(*) FILTER (WHERE own AND play = '2FGM') * 2 + count(*) FILTER (WHERE own AND play = 'FTM') AS points, sum(CASE WHEN own THEN 0 ELSE CASE play WHEN 'O' THEN -1 WHEN 'FTM' THEN 0.44 ELSE 1 END END) AS against FROM i LEFT JOIN p ON p.game = i.game AND sec > a AND sec <= z WHERE z > a GROUP BY ALL)
    SELECT game, a AS from_s, z AS to_s, CAST(fga AS INTEGER) AS fga, CAST(oreb AS INTEGER) AS oreb, CAST(tov AS INTEGER) AS turnovers, CAST(fta AS INTEGER) AS fta, CAST(points AS INTEGER) AS points, round((fga - oreb + tov + 0.44 * fta)::DOUBLE, 2) AS own, round((fga - oreb + tov + 0.44 * fta + coalesce(against, 0))::DOUBLE / 2, 2) AS game_possessions FROM n""".replace("count(*) FILTER (WHERE own", "count(play) FILTER (WHERE own").replace("sum(CASE WHEN own THEN 0", "sum(CASE WHEN play IS NULL OR own THEN 0"))
def segment_possessions(t):
    play = F.element_at(F.array(*[F.lit(x) for x in ("2FGM", "3FGA", "O", "TO", "FTM")]), ((F.col("l_partkey") + F.col("l_suppkey")) % 5 + 1).cast("int"))
    plays = _lines(t).select(F.col("l_orderkey").alias("game"), _at().alias("at"), F.when(F.col("l_suppkey") % 2 == 0, "H").otherwise("A").alias("team"), play.alias("play"))
    p = possessions(_intervals(t), plays)
    return p.select("game", F.col("from").alias("from_s"), F.col("to").alias("to_s"), "fga", "oreb", "turnovers", "fta", "points", F.round("own", 2).alias("own"), F.round("game_possessions", 2).alias("game_possessions"))


_OBS = "o AS (SELECT o_orderkey AS game, o_custkey AS cust, o_orderdate AS t FROM orders)"
_HISTORY = "h AS (SELECT core.game, core.player, x.*, row_number() OVER (PARTITION BY core.game, core.player ORDER BY x.t DESC, x.g DESC) AS r FROM core JOIN x ON x.cust = core.cust AND x.p = core.player AND x.t < core.t)"
_CORE = "core AS (SELECT game, cust, t, unnest(['S1', 'S2', 'S3', 'S4', 'S5']) AS player FROM o)"


def _core(t):
    """A row for each order and starter: the rows that get features, whether their game could be reconstructed or not."""
    o = t("orders").select(F.col("o_orderkey").alias("game"), F.col("o_custkey").alias("cust"), F.col("o_orderdate").alias("t"))
    return o, o.select("*", F.explode(F.array(*[F.lit(f"S{k}") for k in range(1, 6)])).alias("player"))


def _family(t, core, observed, values, k=6):
    """Each core row's last k observations strictly before it, as rows with their recency."""
    parts = t.parts("lineitem")
    facts = core.withColumn("key", F.concat_ws("|", F.col("game").cast("string"), "player"))
    recent = T.recent_observations(facts, observed, ["cust", "player"], "key", "t", "t", "game", values, k, parts)
    return facts.select("key", "game", "player"), dealt(recent, parts, ["key"])


def _mean(c, k):
    return F.avg(F.when(F.col("recency") <= k, F.col(c)))


@query("j12_rotation_features", f"""WITH {EVENTS}, {_OBS}, {_CORE}, x AS (SELECT st.game AS g, st.player AS p, o.cust, o.t, sum(z - a) AS seconds, count(*) AS stints, CAST(sum(greatest(0, z - greatest(a, 2280))) > 0 AS INTEGER) AS closing FROM st JOIN o ON o.game = st.game WHERE z > a GROUP BY ALL), {_HISTORY},
    f AS (SELECT game, player, count(*) FILTER (WHERE r <= 5) AS last_5_n, max(stints) FILTER (WHERE r = 1) AS last_1_stints, avg(stints) FILTER (WHERE r <= 3) AS s3, avg(seconds) FILTER (WHERE r <= 5) / 60 AS m5, sum(seconds) FILTER (WHERE r <= 5) / (2400.0::DOUBLE * count(*) FILTER (WHERE r <= 5)) AS share, avg(closing) FILTER (WHERE r <= 5) AS closing,
        stddev_samp(seconds / 60) FILTER (WHERE r <= 5) AS sd, stddev_samp(stints) FILTER (WHERE r <= 5) AS ssd, (avg(seconds) FILTER (WHERE r <= 3) - avg(seconds) FILTER (WHERE r BETWEEN 4 AND 6)) / 60 AS trend FROM h GROUP BY ALL)
    SELECT core.game, core.player, coalesce(last_5_n, 0) AS last_5_n, last_1_stints, round(s3, 4) AS last_3_stints, round(m5, 6) AS last_5_minutes, round(share, 8) AS last_5_share, round(closing, 4) AS last_5_closing, round(sd, 4) AS minutes_std, round(trend, 4) AS minutes_trend, round(1 / (1 + sd / 10 + ssd / 3), 4) AS role_stability FROM core LEFT JOIN f ON f.game = core.game AND f.player = core.player""")
def rotation_features(t):
    o, core = _core(t)
    seen = rotation(t).join(o, "game").select("cust", "player", "game", "t", "seconds", "stints", (F.col("closing") > 0).cast("int").alias("closing"))
    facts, h = _family(t, core, seen, ["seconds", "stints", "closing"])
    near = F.col("recency") <= 5
    minutes = F.col("seconds") / 60
    a = h.groupBy("key").agg(
        F.count_if(near).alias("last_5_n"), F.max(F.when(F.col("recency") == 1, F.col("stints"))).alias("last_1_stints"), r4(_mean("stints", 3)).alias("last_3_stints"), F.round(_mean("seconds", 5) / 60, 6).alias("last_5_minutes"), F.round(F.sum(F.when(near, F.col("seconds"))) / (2400.0 * F.count_if(near)), 8).alias("last_5_share"), r4(_mean("closing", 5)).alias("last_5_closing"),
        r4(F.stddev_samp(F.when(near, minutes))).alias("minutes_std"), r4((_mean("seconds", 3) - F.avg(F.when(F.col("recency").between(4, 6), F.col("seconds")))) / 60).alias("minutes_trend"), r4(1 / (1 + F.stddev_samp(F.when(near, minutes)) / 10 + F.stddev_samp(F.when(near, F.col("stints"))) / 3)).alias("role_stability"),
    )
    return facts.join(a, "key", "left").drop("key").withColumn("last_5_n", F.coalesce("last_5_n", F.lit(0)))


@query("j12_onoff_features", f"""WITH {EVENTS}, {_OBS}, {_CORE}, total AS (SELECT game, sum(points) AS p FROM good GROUP BY 1), ons AS (SELECT st.game, player, sum(points) AS p FROM st JOIN good g ON g.game = st.game AND g.sec > a AND g.sec <= z WHERE z > a GROUP BY ALL),
    y AS (SELECT DISTINCT st.game AS g, st.player AS p, coalesce(ons.p, 0)::DOUBLE AS onp, (total.p - coalesce(ons.p, 0))::DOUBLE AS offp FROM st JOIN total ON total.game = st.game LEFT JOIN ons ON ons.game = st.game AND ons.player = st.player WHERE z > a), x AS (SELECT y.*, cust, t FROM y JOIN o ON o.game = y.g), {_HISTORY}
    SELECT game, player, count(*) FILTER (WHERE r <= 5) AS last_5_n, round(avg(onp) FILTER (WHERE r <= 5), 4) AS last_5_on, round(avg(offp) FILTER (WHERE r <= 5), 4) AS last_5_off, round(avg(onp - offp) FILTER (WHERE r <= 5), 4) AS last_5_split, round(avg(onp - offp) FILTER (WHERE r <= 3), 4) AS last_3_split FROM h GROUP BY ALL""")
def onoff_features(t):
    o, core = _core(t)
    seen = on_off(t).join(o, "game").select("cust", "player", "game", "t", "on_points", "off_points", (F.col("on_points") - F.col("off_points")).alias("split"))
    r = T.recent_lists(core, seen, ["cust", "player"], ["game", "player"], "t", "t", "game", ["on_points", "off_points", "split"], 6, t.parts("lineitem")).where(F.size("recent") > 0)
    return r.select("game", "player", F.size(_near(5)).cast("long").alias("last_5_n"), _recent_mean("on_points", 5).alias("last_5_on"), _recent_mean("off_points", 5).alias("last_5_off"), _recent_mean("split", 5).alias("last_5_split"), _recent_mean("split", 3).alias("last_3_split"))


def _near(k):
    return F.filter("recent", lambda x: x["recency"] <= k)


def _recent_mean(c, k):
    """Mean of whole numbers among the last k, whose sum no order changes."""
    known = F.filter(_near(k), lambda x: x[c].isNotNull())
    return r4(F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, x: a + x[c]), F.size(known)))


@query("j12_lineup_features", f"""WITH {EVENTS}, {_OBS}, b AS (SELECT game, sec AS x FROM good UNION SELECT game, 0 FROM good UNION SELECT game, 2400 FROM good), i AS (SELECT game, lead(x) OVER (PARTITION BY game ORDER BY x) - x AS s FROM b), q AS (SELECT game, s / 2400.0::DOUBLE AS p FROM i WHERE s > 0),
    x AS (SELECT q.game AS g, 'ALL' AS p, cust, t, count(*) AS lineups, round(0 - sum(p * ln(p)), 6) AS entropy, round(max(p), 6) AS top1 FROM q JOIN o ON o.game = q.game GROUP BY ALL), core AS (SELECT *, 'ALL' AS player FROM o), {_HISTORY}
    SELECT game, count(*) FILTER (WHERE r <= 5) AS last_5_n, round(avg(lineups) FILTER (WHERE r <= 5), 4) AS last_5_lineups, round(avg(entropy) FILTER (WHERE r <= 5), 8) AS last_5_entropy, max(top1) FILTER (WHERE r <= 5) AS last_5_top1 FROM h GROUP BY game""")
def lineup_features(t):
    o, _ = _core(t)
    seen = lineup_shares(t).join(o, "game").select("cust", F.lit("ALL").alias("player"), "game", "t", "lineups", "entropy", "top1")
    facts, h = _family(t, o.withColumn("player", F.lit("ALL")), seen, ["lineups", "entropy", "top1"])
    a = h.groupBy("key").agg(F.count_if(F.col("recency") <= 5).alias("last_5_n"), r4(_mean("lineups", 5)).alias("last_5_lineups"), F.round(_mean("entropy", 5), 8).alias("last_5_entropy"), F.max(F.when(F.col("recency") <= 5, F.col("top1"))).alias("last_5_top1"))
    return facts.join(a, "key").drop("key", "player")


@query("j25_current_slate", _sql("all_games", "all_games AS (SELECT * FROM games UNION ALL SELECT -1 - player_id, player_id, c, CAST(year(c) AS INTEGER), NULL, NULL, NULL, NULL, NULL, NULL FROM (SELECT DISTINCT player_id FROM games), (SELECT max(game_time) + INTERVAL 1 DAY AS c FROM games)), ") + " WHERE f.game_id < 0")
def current_slate(t):
    """Candidates of the next day as rows without stats behind their history, through the same function as the training table."""
    g = t.games()
    next_day = F.broadcast(g.agg((F.max("game_time") + F.expr("INTERVAL 1 DAY")).alias("game_time")))  # one row
    slate = g.select("player_id").distinct().crossJoin(next_day).select((-1 - F.col("player_id")).alias("game_id"), "player_id", "game_time", F.year("game_time").alias("season"))
    return features(g.unionByName(slate, allowMissingColumns=True), t.parts("lineitem")).where("game_id < 0")


_SHOTS = """o AS (SELECT o_orderkey AS game, o_custkey AS cust, xor(o_custkey, o_orderkey % 8) AS opponent, o_orderdate AS t, year(o_orderdate) AS season FROM orders),
    places AS (SELECT l_orderkey AS game, 'S' || (l_linenumber % 5 + 1) AS player, (l_partkey * 37 + l_linenumber * 11) % 1500 - 750 AS x, (l_suppkey * 53 + l_partkey * 7) % 1000 - 100 AS y, 2 + (l_partkey % 3 = 0)::INTEGER AS points, l_returnflag <> 'R' AS made FROM lineitem),
    far AS (SELECT *, sqrt((x * x + y * y)::DOUBLE) AS d FROM places),
    shots AS (SELECT *, CASE WHEN points = 2 THEN CASE WHEN d <= 125 THEN 'rim' WHEN abs(x) <= 245 AND y <= 423 THEN 'paint' ELSE 'midrange' END WHEN abs(x) >= 660 AND y <= 142 THEN 'corner3' ELSE 'above_break3' END AS zone FROM far
        WHERE NOT (x = -1 AND y = -1) AND abs(x) <= 750 AND y BETWEEN -150 AND 1400 AND NOT (points = 2 AND d > 800) AND NOT (points = 3 AND d < 550))"""
_ZONES = ("rim", "paint", "midrange", "corner3", "above_break3")


def _shot_sql(seen: str, match: str, prefix: str, allowed: str, more: str, core: str) -> str:
    """A join of each row with all observations before it, in place of windows."""
    sums = ", ".join(f"sum(n_{z}) FILTER (WHERE h.season = core_season) AS a_{z}, sum(m_{z}) FILTER (WHERE h.season = core_season) AS k_{z}, sum(n_{z}) FILTER (WHERE r <= 5) AS l_{z}" for z in _ZONES)
    counts = ", ".join(f"count(*) FILTER (WHERE zone = '{z}') AS n_{z}, count(*) FILTER (WHERE zone = '{z}' AND made) AS m_{z}" for z in _ZONES)
    out = ", ".join(f"CAST(a_{z} AS BIGINT) AS {prefix}season_{z}_attempts{allowed}, round(a_{z} / nullif(att, 0)::DOUBLE, 6) AS {prefix}season_{z}_attempt_rate{allowed}, round(l_{z} / nullif(l5, 0)::DOUBLE, 6) AS {prefix}last5_{z}_attempt_rate{allowed}, round(k_{z} / nullif(a_{z}, 0)::DOUBLE, 6) AS {prefix}{z}_fg{allowed or '_pct'}" for z in _ZONES)
    return f"""WITH {_SHOTS}, obs AS (SELECT {seen}, o.game, o.season, o.t, count(*) AS n, sum(points) FILTER (WHERE made) AS p, count(*) FILTER (WHERE points = 2) AS p2, count(*) FILTER (WHERE points = 3) AS p3, sum(d / 100) AS dist, {counts} FROM shots s JOIN o ON o.game = s.game GROUP BY ALL), {core},
        h AS (SELECT c_game, c_player, core.season AS core_season, obs.*, row_number() OVER (PARTITION BY c_game, c_player ORDER BY obs.t DESC, obs.game DESC) AS r FROM core JOIN obs ON {match} AND obs.t < core.t),
        a AS (SELECT c_game, c_player, count(*) AS g, count(*) FILTER (WHERE r <= 5) AS g5, count(*) FILTER (WHERE r <= 10) AS g10, sum(n) AS alln, sum(n) FILTER (WHERE h.season = core_season) AS att, coalesce(sum(p) FILTER (WHERE h.season = core_season), 0) AS pts, sum(p2) FILTER (WHERE h.season = core_season) AS two, sum(p3) FILTER (WHERE h.season = core_season) AS three,
            sum(dist) FILTER (WHERE h.season = core_season) AS dist, sum(n) FILTER (WHERE r <= 5) AS l5, sum(n) FILTER (WHERE r <= 10) AS l10, max(epoch_us(t)) AS us, {sums} FROM h GROUP BY ALL)
        SELECT core.c_game AS game, core.c_player AS player, coalesce(g, 0) AS {prefix}games_before, coalesce(g5, 0) AS {prefix}last5_games_n, CAST(alln AS BIGINT) AS {prefix}attempts_before, {out}, round(dist / nullif(att, 0), 6) AS {prefix}avg_distance{allowed}_m, us AS {prefix}source_max_game_time_us{more} FROM core LEFT JOIN a ON a.c_game = core.c_game AND a.c_player = core.c_player"""


def _shots(t):
    place = lambda e: F.expr(e).cast("double")
    return t("lineitem").select(
        F.col("l_orderkey").alias("game"), F.expr("concat('S', l_linenumber % 5 + 1)").alias("player"), place("(l_partkey * 37 + l_linenumber * 11) % 1500 - 750").alias("x"), place("(l_suppkey * 53 + l_partkey * 7) % 1000 - 100").alias("y"),
        F.expr("if(l_partkey % 3 = 0, 3, 2)").alias("points"), (F.col("l_returnflag") != "R").alias("made"),
    )


def _shot_games(t):
    return t("orders").select(F.col("o_orderkey").alias("game"), F.col("o_custkey").alias("cust"), F.expr("o_custkey ^ (o_orderkey % 8)").alias("opponent"), F.col("o_orderdate").alias("t"), F.year("o_orderdate").alias("season"))


def _six(df):
    return df.select(*[F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


_MORE = ", coalesce(g10, 0) AS shot_last10_games_n, CAST(l5 AS BIGINT) AS shot_last5_attempts_n, CAST(l10 AS BIGINT) AS shot_last10_attempts_n, round(three / nullif(att, 0)::DOUBLE, 6) AS shot_3pa_share, round(two / nullif(att, 0)::DOUBLE, 6) AS shot_2pa_share, round(pts / nullif(att, 0)::DOUBLE, 6) AS shot_points_per_shot, round(" + " + ".join(f"pow(a_{z} / nullif(att, 0)::DOUBLE, 2)" for z in _ZONES) + ", 6) AS shot_zone_concentration, round(CASE WHEN att > 0 THEN 0 - (" + " + ".join(f"CASE WHEN a_{z} > 0 THEN a_{z} / att::DOUBLE * ln(a_{z} / att::DOUBLE) ELSE 0 END" for z in _ZONES) + ") END, 6) AS shot_profile_entropy, round((" + " + ".join(f"abs(l_{z} / nullif(l5, 0)::DOUBLE - a_{z} / nullif(att, 0)::DOUBLE)" for z in _ZONES) + ") / 2, 6) AS shot_recent_vs_season_mix_change"


@query("j12_shot_features", _shot_sql("o.cust, s.player", "obs.cust = core.cust AND obs.player = core.c_player", "shot_", "", _MORE, "core AS (SELECT game AS c_game, cust, t, season, unnest(['S1', 'S2', 'S3', 'S4', 'S5']) AS c_player FROM o)"))
def shot_features(t):
    """Each starter of an order with the shot profile of the starter's games before it."""
    games = _shot_games(t)
    core = games.select("game", "cust", "t", "season", F.explode(F.array(*[F.lit(f"S{k}") for k in range(1, 6)])).alias("player"))
    seen = S.profiles(_shots(t), "game", "player").join(games, "game")
    return _six(S.rates(S.carried(core, seen, ["cust", "player"], "season", "t", "game", parts=t.parts("lineitem")), "game", "player"))


@query("j12_opponent_shot_features", _shot_sql("o.opponent", "obs.opponent = core.opponent", "opp_shot_", "_allowed", "", "core AS (SELECT game AS c_game, opponent, t, season, 'ALL' AS c_player FROM o)"))
def opponent_shot_features(t):
    """Each order with what its opponent allowed in the opponent's games before it."""
    games = _shot_games(t)
    seen = S.profiles(_shots(t), "game").join(games, "game")
    core = games.select("game", "opponent", "t", "season", F.lit("ALL").alias("player"))
    return _six(S.rates(S.carried(core, seen, ["opponent"], "season", "t", "game", last=(5,), parts=t.parts("lineitem")), "game", "player", prefix="opp_shot_", allowed="_allowed", own=False))
