"""Windows over histories (survey F, parts of J)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.exprs import ratio
from ..operators.windows import DAY, History, average_rank, dealt, elo, ewma, islands, micros, sessions, top_k, trend
from .registry import GAMES, LOG, query, r4

H = History("player_id", "game_time", "game_id")
SEASON = History(["player_id", "season"], "game_time", "game_id")
W = "WINDOW p AS (PARTITION BY player_id ORDER BY game_time, game_id)"


@query("f00_rolling_form", f"""WITH {GAMES} SELECT game_id, player_id, count(*) OVER b AS prior_n, lag(units) OVER p AS last_1, round(avg(units) OVER l5, 4) AS last_5_avg, count(units) OVER l5 AS last_5_n,
    round(median(units) OVER l5, 4) AS last_5_median, round(stddev_samp(units) OVER l5, 4) AS last_5_std, round(avg(units) OVER s, 4) AS season_avg_before,
    CAST(date_diff('day', lag(game_time) OVER p, game_time) AS INTEGER) AS days_since_prev FROM games
    WINDOW p AS (PARTITION BY player_id ORDER BY game_time, game_id), b AS (PARTITION BY player_id ORDER BY game_time, game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    l5 AS (PARTITION BY player_id ORDER BY game_time, game_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), s AS (PARTITION BY player_id, season ORDER BY game_time, game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def rolling_form(t):
    l5 = H.last(5)
    return t.games().select(
        "game_id", "player_id", F.count("*").over(H.before()).alias("prior_n"), F.lag("units").over(H.rows).alias("last_1"), r4(F.avg("units").over(l5)).alias("last_5_avg"), F.count("units").over(l5).alias("last_5_n"),
        r4(F.percentile("units", 0.5).over(l5)).alias("last_5_median"), r4(F.stddev_samp("units").over(l5)).alias("last_5_std"), r4(F.avg("units").over(SEASON.before())).alias("season_avg_before"),
        F.datediff("game_time", F.lag("game_time").over(H.rows)).alias("days_since_prev"),
    )


@query("f01_named_windows", f"""WITH {GAMES} SELECT game_id, sum(n_lines) OVER p::BIGINT AS lines_so_far, max(units) OVER p AS best_so_far, min(units) OVER p AS worst_so_far, row_number() OVER p AS nth FROM games {W}""".replace("sum(n_lines) OVER p::BIGINT", "CAST(sum(n_lines) OVER p AS BIGINT)"))
def named_windows(t):
    return t.games().select("game_id", F.sum("n_lines").over(H.until()).alias("lines_so_far"), F.max("units").over(H.until()).alias("best_so_far"), F.min("units").over(H.until()).alias("worst_so_far"), F.row_number().over(H.rows).cast("long").alias("nth"))


@query("f02_expanding_before", f"""WITH {GAMES} SELECT game_id, count(*) OVER c AS career_n, round(avg(units) OVER c, 4) AS career_avg, count(*) OVER s AS season_n, round(avg(units) OVER s, 4) AS season_avg FROM games
    WINDOW c AS (PARTITION BY player_id ORDER BY game_time, game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), s AS (PARTITION BY player_id, season ORDER BY game_time, game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def expanding_before(t):
    return t.games().select("game_id", F.count("*").over(H.before()).alias("career_n"), r4(F.avg("units").over(H.before())).alias("career_avg"), F.count("*").over(SEASON.before()).alias("season_n"), r4(F.avg("units").over(SEASON.before())).alias("season_avg"))


_K = ", ".join(f"round(avg(units) OVER l{k}, 4) AS avg_{k}, count(*) OVER l{k} AS n_{k}" for k in (3, 5, 10))
_KW = ", ".join(f"l{k} AS (PARTITION BY player_id ORDER BY game_time, game_id ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)" for k in (3, 5, 10))


@query("f03_trailing_k", f"WITH {GAMES} SELECT game_id, {_K} FROM games WINDOW {_KW}")
def trailing_k(t):
    return t.games().select("game_id", *[x for k in (3, 5, 10) for x in (r4(F.avg("units").over(H.last(k))).alias(f"avg_{k}"), F.count("*").over(H.last(k)).alias(f"n_{k}"))])


@query("f04_displaced_trend", f"""WITH {GAMES} SELECT game_id, round(CASE WHEN count(units) OVER a = 3 AND count(units) OVER b = 3 THEN avg(units) OVER a - avg(units) OVER b END, 4) AS trend FROM games
    WINDOW a AS (PARTITION BY player_id ORDER BY game_time, game_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), b AS (PARTITION BY player_id ORDER BY game_time, game_id ROWS BETWEEN 6 PRECEDING AND 4 PRECEDING)""")
def displaced_trend(t):
    return t.games().select("game_id", r4(trend("units", H)).alias("trend"))


@query("f06_framed_median_std", f"""WITH {GAMES} SELECT game_id, round(median(units) OVER l, 4) AS med, round(stddev_samp(units) OVER l, 4) AS std, round(min(units) OVER l, 4) AS low FROM games
    WINDOW l AS (PARTITION BY player_id ORDER BY game_time, game_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)""")
def framed_median(t):
    w = H.last(10)
    return t.games().select("game_id", r4(F.percentile("units", 0.5).over(w)).alias("med"), r4(F.stddev_samp("units").over(w)).alias("std"), r4(F.min("units").over(w)).alias("low"))


@query("f08_filtered_window_aggregate", f"""WITH {GAMES} SELECT game_id, round(avg(units) FILTER (WHERE returned > 0) OVER l, 4) AS avg_with_returns, count(*) FILTER (WHERE returned = 0) OVER l AS n_without FROM games
    WINDOW l AS (PARTITION BY player_id ORDER BY game_time, game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def filtered_window(t):
    w = H.before()
    return t.games().select("game_id", r4(F.avg(F.when(F.col("returned") > 0, F.col("units"))).over(w)).alias("avg_with_returns"), F.count(F.when(F.col("returned") == 0, 1)).over(w).alias("n_without"))


@query("f09_lag_lead", f"WITH {GAMES} SELECT game_id, lag(units) OVER p AS prev_1, lag(units, 2) OVER p AS prev_2, lead(units) OVER p AS next_1 FROM games {W}")
def lag_lead(t):
    return t.games().select("game_id", F.lag("units").over(H.rows).alias("prev_1"), F.lag("units", 2).over(H.rows).alias("prev_2"), F.lead("units").over(H.rows).alias("next_1"))


@query("f10_ordinal_and_recency", f"""WITH {GAMES} SELECT game_id, row_number() OVER (PARTITION BY player_id ORDER BY game_time, game_id)::INTEGER AS ordinal, row_number() OVER (PARTITION BY player_id ORDER BY game_time DESC, game_id DESC)::INTEGER AS recency FROM games""")
def ordinals(t):
    back = Window.partitionBy("player_id").orderBy(F.desc("game_time"), F.desc("game_id"))
    return t.games().select("game_id", F.row_number().over(H.rows).alias("ordinal"), F.row_number().over(back).alias("recency"))


@query("f11_dense_rank_of_groups", f"""WITH {GAMES} SELECT season, month, CAST(n AS BIGINT) AS n, CAST(dense_rank() OVER (ORDER BY first_time, season, month) AS INTEGER) AS split FROM
    (SELECT season, CAST(month(game_time) AS INTEGER) AS month, min(game_time) AS first_time, count(*) AS n FROM games GROUP BY ALL)""")
def dense_rank_groups(t):
    g = t.games().groupBy("season", F.month("game_time").alias("month")).agg(F.min("game_time").alias("first_time"), F.count("*").alias("n"))
    return g.select("season", "month", "n", F.dense_rank().over(Window.orderBy("first_time", "season", "month")).alias("split"))  # a row for each month


@query("f12_qualify_top_k", f"WITH {GAMES} SELECT player_id, game_id, units FROM games QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY units DESC, game_id) <= 3")
def qualify_top(t):
    return top_k(t.games(), ["player_id"], [F.desc("units"), F.col("game_id")], 3).select("player_id", "game_id", "units")


@query("f13_share_of_partition", f"WITH {GAMES} SELECT game_id, round(units / sum(units) OVER (PARTITION BY player_id, season), 4) AS share FROM games")
def partition_share(t):
    return t.games().select("game_id", r4(F.col("units") / F.sum("units").over(Window.partitionBy("player_id", "season"))).alias("share"))


@query("f14_audit_cutoff", f"""WITH {GAMES}, a AS (SELECT player_id, game_time, max(game_time) OVER (PARTITION BY player_id ORDER BY epoch_us(game_time) RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM games)
    SELECT player_id, count(*) AS n, count(newest) AS with_history, count(*) FILTER (WHERE newest >= game_time) AS leaks FROM a GROUP BY player_id""")
def audit_cutoff(t):
    a = t.games().withColumn("newest", F.max("game_time").over(H.earlier("game_time")))
    return a.groupBy("player_id").agg(F.count("*").alias("n"), F.count("newest").alias("with_history"), F.count_if(F.col("newest") >= F.col("game_time")).alias("leaks"))


@query("f15_rank_methods", f"""WITH {GAMES} SELECT game_id, CAST(rank() OVER (PARTITION BY season ORDER BY units DESC) AS INTEGER) AS min_rank, rank() OVER (PARTITION BY season ORDER BY units) + (count(*) OVER (PARTITION BY season, units) - 1) / 2.0::DOUBLE AS avg_rank,
    CAST(row_number() OVER (PARTITION BY season ORDER BY units, game_id) AS INTEGER) AS first_rank FROM games""")
def rank_methods(t):
    w = Window.partitionBy("season")
    return t.games().select("game_id", F.rank().over(w.orderBy(F.desc("units"))).alias("min_rank"), average_rank("units", ["season"]).alias("avg_rank"), F.row_number().over(w.orderBy("units", "game_id")).alias("first_rank"))


@query("f16_shifted_expanding_mean", f"""WITH {GAMES}, m AS (SELECT player_id, season, CAST(month(game_time) AS INTEGER) AS month, sum(units) AS units FROM games GROUP BY ALL)
    SELECT player_id, season, month, round(avg(units) OVER (PARTITION BY player_id ORDER BY season, month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 4) AS before,
    round(avg(units) OVER (PARTITION BY player_id ORDER BY season, month ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 4) AS last5 FROM m""")
def shifted_mean(t):
    m = t.games().groupBy("player_id", "season", F.month("game_time").alias("month")).agg(F.sum("units").alias("units"))
    h = History("player_id", "season", "month")
    return m.select("player_id", "season", "month", r4(F.avg("units").over(h.before())).alias("before"), r4(F.avg("units").over(h.last(5))).alias("last5"))


@query("f17_next_if_adjacent", f"""WITH {GAMES}, m AS (SELECT player_id, CAST(year(game_time) * 12 + month(game_time) AS INTEGER) AS m, sum(units) AS units FROM games GROUP BY ALL)
    SELECT player_id, m, units, next_units FROM (SELECT *, lead(units) OVER w AS next_units, lead(m) OVER w AS next_m FROM m WINDOW w AS (PARTITION BY player_id ORDER BY m)) WHERE next_m = m + 1""")
def next_adjacent(t):
    m = t.games().groupBy("player_id", (F.year("game_time") * 12 + F.month("game_time")).alias("m")).agg(F.sum("units").alias("units"))
    w = Window.partitionBy("player_id").orderBy("m")
    return m.withColumns({"next_units": F.lead("units").over(w), "next_m": F.lead("m").over(w)}).where("next_m = m + 1").select("player_id", "m", "units", "next_units")


@query("f18_sliding_7_days", """SELECT event_id, count(*) OVER w AS n_7d, round(sum(value) OVER w, 4) AS sum_7d FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 604800000000 PRECEDING AND 1 PRECEDING)""")
def sliding_days(t):
    w = History("user_id").days("ts", 7)
    return t("events").select("event_id", F.count("*").over(w).alias("n_7d"), r4(F.sum("value").over(w)).alias("sum_7d"))


@query("f19_status_trajectory", """SELECT event_id, event_type, lag(event_type) OVER w AS before, CAST(floor(epoch(ts)) - floor(epoch(lag(ts) OVER w)) AS BIGINT) AS seconds FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def status_trajectory(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    seconds = F.floor(micros("ts") / 1e6) - F.floor(F.lag(micros("ts")).over(w) / 1e6)
    return t("events").select("event_id", "event_type", F.lag("event_type").over(w).alias("before"), seconds.alias("seconds"))


@query("f20_islands_of_equal_status", """WITH a AS (SELECT *, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM a)
    SELECT user_id, CAST(island AS BIGINT) AS island, event_type, count(*) AS n, min(event_id) AS first_event, round(sum(value), 4) AS total FROM b GROUP BY ALL""")
def status_islands(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = t("events").withColumn("new", ~F.lag("event_type").over(w).eqNullSafe(F.col("event_type")))
    return islands(e, ["user_id"], ["ts", "event_id"], F.col("new")).groupBy("user_id", "island", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"), r4(F.sum("value")).alias("total"))


@query("f21_lineup_continuity", """WITH l AS (SELECT o_custkey, o_orderkey, o_orderdate, list_sort(list(DISTINCT l_suppkey)) AS s FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL),
    p AS (SELECT *, lag(s) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM l)
    SELECT o_orderkey, CAST(len(s) AS INTEGER) AS size, round(CASE WHEN before IS NOT NULL THEN len(list_intersect(s, before)) / len(s)::DOUBLE END, 4) AS continuity FROM p""")
def lineup_continuity(t):
    lines = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_suppkey").alias("s"))
    o = t("orders").join(lines, "o_orderkey")
    before = F.lag("s").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return o.select("o_orderkey", F.size("s").alias("size"), r4(F.size(F.array_intersect("s", before)) / F.size("s").cast("double") + F.when(before.isNull(), None).otherwise(0)).alias("continuity"))


@query("f22_turns_by_date", """SELECT event_id, CAST(dense_rank() OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE)) AS INTEGER) AS turn FROM events""")
def turns(t):
    return t("events").select("event_id", F.dense_rank().over(Window.partitionBy("user_id").orderBy(F.to_date("ts"))).alias("turn"))


@query("f23_order_inversions", """SELECT user_id, count(*) FILTER (WHERE event_id < before) AS inversions, count(*) AS n FROM (SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) GROUP BY user_id""")
def inversions(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t("events").withColumn("before", F.lag("event_id").over(w)).groupBy("user_id").agg(F.count_if(F.col("event_id") < F.col("before")).alias("inversions"), F.count("*").alias("n"))


@query("f24_elo_by_season", """WITH RECURSIVE g AS (SELECT concat_ws('-', year(o_orderdate), month(o_orderdate)) AS season, o_orderkey, c_nationkey AS h, s_nationkey AS a, CAST(l_quantity >= 25 AS INTEGER) AS won,
    row_number() OVER (PARTITION BY year(o_orderdate), month(o_orderdate) ORDER BY o_orderdate, o_orderkey, s_nationkey, l_quantity >= 25) AS k FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON o_orderkey = l_orderkey AND l_linenumber = 1 JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey),
    r AS (SELECT DISTINCT season, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS o_orderkey, CAST(NULL AS DOUBLE) AS home_elo, CAST(NULL AS DOUBLE) AS away_elo, MAP {} :: MAP(BIGINT, DOUBLE) AS rating FROM g
        UNION ALL SELECT season, k, o_orderkey, rh, ra, map_concat(rating, MAP {h: rh + d, a: ra - d}) FROM (SELECT *, 20 * (won - 1 / (1 + pow(10, (ra - rh - 70) / 400))) AS d
            FROM (SELECT g.season, g.k, g.o_orderkey, CAST(h AS BIGINT) AS h, CAST(a AS BIGINT) AS a, won, rating, coalesce(rating[CAST(h AS BIGINT)], 1500.0::DOUBLE) AS rh, coalesce(rating[CAST(a AS BIGINT)], 1500.0::DOUBLE) AS ra FROM r JOIN g ON g.season = r.season AND g.k = r.k + 1)))
    SELECT season, o_orderkey, round(home_elo, 4) AS home_elo, round(away_elo, 4) AS away_elo FROM r WHERE k > 0""")
def elo_seasons(t):
    """Customers' nations (home) against suppliers' nations (away) of each order's first line; an order may have several, which come by nation and winner."""
    first = t("lineitem").where("l_linenumber = 1").join(F.broadcast(t("supplier").select("s_suppkey", "s_nationkey")), F.col("l_suppkey") == F.col("s_suppkey"))
    o = t("orders").join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(first, F.col("o_orderkey") == F.col("l_orderkey"))
    games = o.where("c_nationkey <> s_nationkey").select(F.concat_ws("-", F.year("o_orderdate"), F.month("o_orderdate")).alias("season"), micros("o_orderdate").alias("at"), "o_orderkey", "c_nationkey", "s_nationkey", (F.col("l_quantity") >= 25).alias("home_won"))
    out = elo(games, "season", ["at", "o_orderkey", "s_nationkey", "home_won"], "c_nationkey", "s_nationkey", "home_won")
    return out.select("season", "o_orderkey", r4("home_elo").alias("home_elo"), r4("away_elo").alias("away_elo"))


@query("f24_win_rate_and_margins", f"""WITH {GAMES} SELECT game_id, round(avg(CAST(units > 100 AS INTEGER)) OVER s, 4) AS win_rate, round(avg(units - 100) OVER l5, 4) AS margin_5 FROM games
    WINDOW s AS (PARTITION BY player_id, season ORDER BY game_time, game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), l5 AS (PARTITION BY player_id ORDER BY game_time, game_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)""")
def win_rate(t):
    return t.games().select("game_id", r4(F.avg((F.col("units") > 100).cast("int")).over(SEASON.before())).alias("win_rate"), r4(F.avg(F.col("units") - 100).over(H.last(5))).alias("margin_5"))


@query("f25_series_state", f"""WITH {GAMES}, s AS (SELECT *, CAST(row_number() OVER w AS INTEGER) AS series_game, coalesce(sum(CAST(units > 100 AS INTEGER)) OVER b, 0) AS wins, coalesce(sum(CAST(units <= 100 AS INTEGER)) OVER b, 0) AS losses FROM games
    WINDOW w AS (PARTITION BY player_id, season ORDER BY game_time, game_id), b AS (PARTITION BY player_id, season ORDER BY game_time, game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT game_id, series_game, CAST(wins AS BIGINT) AS wins_before, wins = 2 OR losses = 2 AS elimination, wins = 2 AND losses = 2 AS deciding FROM s""")
def series_state(t):
    b = SEASON.before()
    s = t.games().select("game_id", F.row_number().over(SEASON.rows).alias("series_game"), F.coalesce(F.sum((F.col("units") > 100).cast("int")).over(b), F.lit(0)).alias("wins_before"), F.coalesce(F.sum((F.col("units") <= 100).cast("int")).over(b), F.lit(0)).alias("losses"))
    return s.select("game_id", "series_game", F.col("wins_before").cast("long").alias("wins_before"), ((F.col("wins_before") == 2) | (F.col("losses") == 2)).alias("elimination"), ((F.col("wins_before") == 2) & (F.col("losses") == 2)).alias("deciding"))


@query("f26_pair_history", """WITH p AS (SELECT DISTINCT l_orderkey AS g, l_suppkey AS s FROM lineitem), pairs AS (SELECT a.g, a.s AS s1, b.s AS s2 FROM p a JOIN p b ON a.g = b.g AND a.s < b.s)
    SELECT g, s1, s2, count(*) OVER (PARTITION BY s1, s2 ORDER BY o_orderdate, g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS shared_before FROM pairs JOIN orders ON g = o_orderkey""")
def pair_history(t):
    sets = t("lineitem").groupBy(F.col("l_orderkey").alias("g")).agg(F.array_sort(F.collect_set("l_suppkey")).alias("m"))  # a game's few members
    pairs = sets.select("g", F.explode("m").alias("s1"), "m").select("g", "s1", F.explode(F.filter("m", lambda x: x > F.col("s1"))).alias("s2"))
    h = History(["s1", "s2"], "o_orderdate", "g")
    dated = pairs.join(t("orders").select(F.col("o_orderkey").alias("g"), "o_orderdate"), "g")
    return dealt(dated, 3 * t.parts("lineitem"), ["s1", "s2"]).select("g", "s1", "s2", F.count("*").over(h.before()).alias("shared_before"))


@query("f27_sessions_by_gap", """WITH a AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w <= 6 * 3600 * 1000000::BIGINT THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM a)
    SELECT user_id, CAST(s AS BIGINT) AS session, count(*) AS n, CAST(max(epoch_us(ts)) - min(epoch_us(ts)) AS BIGINT) AS length_us FROM b GROUP BY ALL""")
def sessions_by_gap(t):
    s = sessions(t("events"), ["user_id"], "ts", "event_id", 6 * 3600)
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"), (F.max(micros("ts")) - F.min(micros("ts"))).alias("length_us"))


@query("e12_ewma", f"""WITH {GAMES}, n AS (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY game_time, game_id) AS i FROM games)
    SELECT a.game_id, round(sum(b.units * pow(0.65, a.i - b.i - 1)) / sum(pow(0.65, a.i - b.i - 1)), 4) AS ewma FROM n a LEFT JOIN n b ON a.player_id = b.player_id AND b.i < a.i GROUP BY a.game_id""")
def ewma_before(t):
    return t.games().select("game_id", r4(ewma("units", H, 0.65)).alias("ewma"))


@query("d05_full_prior_history", f"""WITH {GAMES} SELECT a.game_id, count(b.game_id) AS n_before, round(avg(b.units), 4) AS avg_before, round(avg(b.units) FILTER (WHERE b.season >= a.season - 2), 4) AS avg_3s,
    count(b.game_id) FILTER (WHERE b.game_time >= a.game_time - INTERVAL 7 DAY) AS n_7d FROM games a LEFT JOIN games b ON a.player_id = b.player_id AND b.game_time < a.game_time GROUP BY a.game_id""")
def full_prior(t):
    """Time-strict history by range frames: no pairs of a game and its past are built."""
    earlier, week = H.earlier("game_time"), History("player_id").days("game_time", 7)
    # seasons from two years back, strictly earlier in time: season sums less what is not earlier
    seasons = Window.partitionBy("player_id").orderBy("season").rangeBetween(-2, -1)
    own = History(["player_id", "season"]).earlier("game_time")
    a, n = F.coalesce(F.sum("units").over(seasons), F.lit(0.0)) + F.coalesce(F.sum("units").over(own), F.lit(0.0)), F.count("*").over(seasons) + F.count("*").over(own)
    return t.games().select("game_id", F.count("*").over(earlier).alias("n_before"), r4(F.avg("units").over(earlier)).alias("avg_before"), r4(ratio(a, n)).alias("avg_3s"), F.count("*").over(week).alias("n_7d"))
