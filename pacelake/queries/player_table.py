"""The whole feature table of player-games (survey J2): what is known of a player before each game, in one plan.

All frames stand on one partition and order (the player's games in time), or on the player's games of
a season, so Spark sorts twice for all columns; league context comes from daily sums, which are
few, by an as-of window over days.  Nothing of the game itself is a feature.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.exprs import ratio
from ..operators.windows import History, dealt, micros, trend
from .registry import GAMES, query, r4

STATS = ("units", "n_lines", "returned", "pending", "spend")
#: Games of the trailing frames, and days of the load counts.
TRAILING, LOAD = (3, 5, 10), (7, 14, 30)
COLD, START = 5, 10.0

_W = "PARTITION BY player_id ORDER BY game_time, game_id"
_ROWS = "{} ROWS BETWEEN {} PRECEDING AND {} PRECEDING"
_ALL = _ROWS.format(_W, "UNBOUNDED", 1)
_SEASON = _ROWS.format("PARTITION BY player_id, season ORDER BY game_time, game_id", "UNBOUNDED", 1)


def _sql(source: str = "games", more: str = "") -> str:
    r = lambda x, name: f"round({x}, 4) AS {name}"
    last = lambda k: _ROWS.format(_W, k, 1)
    cols = []
    for s in STATS:
        cols += [r(f"avg({s}) OVER ({_SEASON})", f"{s}_season"), r(f"avg({s}) OVER ({_ALL})", f"{s}_career")]
        cols += [r(f"avg({s}) OVER ({last(k)})", f"{s}_last_{k}") for k in TRAILING]
        cols += [r(f"stddev_samp({s}) OVER ({last(5)})", f"{s}_std_5"), r(f"max({s}) OVER ({last(10)})::DOUBLE", f"{s}_max_10"), r(f"min({s}) OVER ({last(10)})::DOUBLE", f"{s}_min_10"), r(f"lag({s}) OVER ({_W})::DOUBLE", f"{s}_previous")]
        cols.append(r(f"CASE WHEN count({s}) OVER ({_ROWS.format(_W, 6, 4)}) = 3 THEN avg({s}) OVER ({last(3)}) - avg({s}) OVER ({_ROWS.format(_W, 6, 4)}) END", f"{s}_trend"))
        if s != "n_lines":
            cols.append(r(f"sum({s}) OVER ({last(10)})::DOUBLE / nullif(sum(n_lines) OVER ({last(10)}), 0)", f"{s}_per_line"))
    cols += [f"count(*) OVER ({_ALL}) AS games_before", f"count(*) OVER ({_SEASON}) AS season_games_before", f"count(*) OVER ({_ALL}) < {COLD} AS cold"]
    cols.append(f"round((epoch_us(game_time) - epoch_us(lag(game_time) OVER ({_W}))) / 86400000000.0::DOUBLE, 4) AS days_rest")
    cols += [f"count(*) OVER (PARTITION BY player_id ORDER BY epoch_us(game_time) RANGE BETWEEN {d * 86400000000} PRECEDING AND 1 PRECEDING) AS games_{d}d" for d in LOAD]
    cols += [r(f"avg(CAST(returned > 0 AS INTEGER)) OVER ({last(10)})", "absence_rate"), r(f"avg(CAST(priority IN ('1', '2') AS INTEGER)) OVER ({last(10)})", "urgent_rate")]
    cols += [r(f"coalesce(avg(units) OVER ({_SEASON}), avg(units) OVER ({_ALL}), {START})::DOUBLE", "baseline"), f"season = min(season) OVER (PARTITION BY player_id) AS rookie_season"]
    return f"""WITH {GAMES}, {more}known AS (SELECT *, CAST(floor(price) AS BIGINT) AS spend FROM {source}), day AS (SELECT season, CAST(game_time AS DATE) AS d, sum(units) AS u, sum(n_lines) AS l, count(*) AS n FROM {source} GROUP BY ALL),
    league AS (SELECT season, d, round(sum(u) OVER w / nullif(sum(n) OVER w, 0), 4) AS league_units, round(sum(u) OVER w / nullif(sum(l) OVER w, 0), 4) AS league_per_line FROM day WINDOW w AS (PARTITION BY season ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    f AS (SELECT game_id, player_id, season, game_time, units AS target, {", ".join(cols)} FROM known)
    SELECT f.*, league_units, league_per_line, round(baseline - league_units, 4) AS baseline_over_league FROM f JOIN league ON league.season = f.season AND league.d = CAST(f.game_time AS DATE)"""


@query("j02_player_features", _sql())
def player_features(t):
    return features(t.games(), t.parts("lineitem"))


def features(games, parts=None):
    """The table for player-games; rows without stats (games to come) get theirs from the same frames.  ``parts`` that grow with the table bound what a task sorts."""
    g = dealt(games, parts, ["player_id"]).withColumn("spend", F.floor("price"))
    h, s = History("player_id", "game_time", "game_id"), History(["player_id", "season"], "game_time", "game_id")
    cols = {}
    for x in STATS:
        over = lambda f, w, x=x: r4(f(x).over(w).cast("double"))
        cols |= {f"{x}_season": over(F.avg, s.before()), f"{x}_career": over(F.avg, h.before())} | {f"{x}_last_{k}": over(F.avg, h.last(k)) for k in TRAILING}
        cols |= {f"{x}_std_5": over(F.stddev_samp, h.last(5)), f"{x}_max_10": over(F.max, h.last(10)), f"{x}_min_10": over(F.min, h.last(10)), f"{x}_previous": over(F.lag, h.rows), f"{x}_trend": r4(trend(x, h, 3))}
        if x != "n_lines":
            cols[f"{x}_per_line"] = r4(ratio(F.sum(x).over(h.last(10)).cast("double"), F.sum("n_lines").over(h.last(10))))
    career = F.count("*").over(h.before())
    cols |= {"games_before": career, "season_games_before": F.count("*").over(s.before()), "cold": career < COLD}
    cols["days_rest"] = r4((micros("game_time") - F.lag(micros("game_time")).over(h.rows)) / 86_400_000_000.0)
    cols |= {f"games_{d}d": F.count("*").over(h.days("game_time", d)) for d in LOAD}
    cols |= {"absence_rate": r4(F.avg((F.col("returned") > 0).cast("int")).over(h.last(10))), "urgent_rate": r4(F.avg(F.col("priority").isin("1", "2").cast("int")).over(h.last(10)))}
    cols["baseline"] = r4(F.coalesce(F.avg("units").over(s.before()), F.avg("units").over(h.before()), F.lit(START)))
    cols["rookie_season"] = F.col("season") == F.min("season").over(Window.partitionBy("player_id"))
    f = g.select("game_id", "player_id", "season", "game_time", F.col("units").alias("target"), *[c.alias(n) for n, c in cols.items()])
    day = games.groupBy("season", F.to_date("game_time").alias("d")).agg(F.sum("units").alias("u"), F.sum("n_lines").alias("l"), F.count("*").alias("n"))
    w = Window.partitionBy("season").orderBy("d").rowsBetween(Window.unboundedPreceding, -1)  # a season's days
    league = day.select("season", "d", r4(ratio(F.sum("u").over(w), F.sum("n").over(w))).alias("league_units"), r4(ratio(F.sum("u").over(w), F.sum("l").over(w))).alias("league_per_line"))
    out = f.withColumn("d", F.to_date("game_time")).join(league, ["season", "d"]).drop("d")
    return out.withColumn("baseline_over_league", r4(F.col("baseline") - F.col("league_units")))
