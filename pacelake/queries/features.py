"""Feature tables (survey J1-J6, J11-J23, J30-J34)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import evaluation as E
from ..operators.windows import History
from ..plans import features as P
from .registry import GAMES, SIDES, query, r4
from .scalars import SHOTS, shots

H = History("player_id", "game_time", "game_id")
_B = "PARTITION BY player_id ORDER BY game_time, game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
_L = "PARTITION BY player_id ORDER BY game_time, game_id ROWS BETWEEN {} PRECEDING AND 1 PRECEDING"


@query("j01_targets", f"WITH {GAMES}, b AS (SELECT *, CASE WHEN returned = n_lines THEN 'DNP' WHEN units > 0 THEN 'PLAYED' ELSE 'UNKNOWN' END AS status, units - 20 * returned AS base FROM games) SELECT game_id, status, CASE WHEN status = 'PLAYED' THEN base::DOUBLE END AS base, round(CASE WHEN status = 'PLAYED' THEN base + CASE WHEN priority = '1' THEN 0.1::DOUBLE * abs(base) ELSE 0 END END, 4) AS standardized, round(CASE WHEN status = 'PLAYED' AND season BETWEEN 1997 AND 2000 THEN base + CASE WHEN priority = '1' THEN 0.1::DOUBLE * abs(base) ELSE 0 END END, 4) AS actual FROM b")
def targets(t):
    b = t.games().withColumns({"status": X.eligibility("units", F.col("returned") == F.col("n_lines")), "base": F.col("units") - 20 * F.col("returned")})
    played = F.col("status") == "PLAYED"
    total = r4(F.when(played, X.with_bonus("base", F.col("priority") == "1")))
    return b.select("game_id", "status", F.when(played, F.col("base")).alias("base"), total.alias("standardized"), F.when(F.col("season").between(1997, 2000), total).alias("actual"))


TEAMS = f"""{SIDES}, g2 AS (SELECT h.game_id, o_orderdate AS game_time, CAST(year(o_orderdate) AS INTEGER) AS season, c_nationkey AS home, CAST((c_nationkey + h.game_id % 24 + 1) % 25 AS BIGINT) AS away, h.points AS hp, a.points AS ap FROM sides h JOIN sides a ON h.game_id = a.game_id AND h.side = 'HOME' AND a.side = 'AWAY' JOIN orders ON o_orderkey = h.game_id JOIN customer ON c_custkey = o_custkey),
    tg AS (SELECT game_id, game_time, season, CAST(home AS BIGINT) AS team, away AS opponent, hp AS points, ap AS allowed, 'HOME' AS venue FROM g2 UNION ALL SELECT game_id, game_time, season, away, home, ap, hp, 'AWAY' FROM g2)"""


def team_games(t):
    p = t.sides().groupBy("game_id").agg(F.max(F.when(F.col("side") == "HOME", F.col("points"))).alias("hp"), F.max(F.when(F.col("side") == "AWAY", F.col("points"))).alias("ap")).where("hp is not null and ap is not null")
    o = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("game_id"), F.col("o_orderdate").alias("game_time"), F.year("o_orderdate").alias("season"), F.col("c_nationkey").cast("long").alias("home"))
    return P.team_games(p.join(o, "game_id").withColumn("away", (F.col("home") + F.col("game_id") % 24 + 1) % 25), "home", "away", "hp", "ap")


@query("j03_team_features", f"WITH {TEAMS} SELECT game_id, team, count(*) OVER w AS n, round(sum(points) OVER w / nullif(sum(allowed) OVER w, 0), 4) AS ratio_of_sums, round(avg(points) OVER l, 4) AS last_10, round(avg(allowed) OVER l, 4) AS allowed_10 FROM tg WINDOW w AS (PARTITION BY team ORDER BY game_time, game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), l AS (PARTITION BY team ORDER BY game_time, game_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)")
def team_features(t):
    h = History("team", "game_time", "game_id")
    w, l = h.before(), h.last(10)
    return team_games(t).select("game_id", "team", F.count("*").over(w).alias("n"), r4(X.ratio(F.sum("points").over(w), F.sum("allowed").over(w))).alias("ratio_of_sums"), r4(F.avg("points").over(l)).alias("last_10"), r4(F.avg("allowed").over(l)).alias("allowed_10"))


@query("j04_team_and_opponent", f"WITH {TEAMS}, f AS (SELECT game_id, team, opponent, venue, avg(points) OVER (PARTITION BY team ORDER BY game_time, game_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS form FROM tg) SELECT a.game_id, a.team, round(a.form, 4) AS own_form, round(b.form, 4) AS opponent_form, round(a.form - b.form, 4) AS edge FROM f a JOIN f b ON a.game_id = b.game_id AND a.venue <> b.venue")
def team_opponent(t):
    """Both sides' features meet in one window over the game."""
    f = team_games(t).withColumn("form", F.avg("points").over(History("team", "game_time", "game_id").last(5)))
    g = Window.partitionBy("game_id")
    home, away = (F.max(F.when(F.col("venue") == v, F.col("form"))).over(g) for v in ("HOME", "AWAY"))
    both = f.withColumn("other", F.when(F.col("venue") == "HOME", away).otherwise(home))
    return both.select("game_id", "team", r4("form").alias("own_form"), r4("other").alias("opponent_form"), r4(F.col("form") - F.col("other")).alias("edge"))


@query("j05_market_attach", f"WITH {GAMES}, m AS (SELECT o_custkey AS player_id, CAST(year(o_orderdate) AS INTEGER) AS season, o_totalprice AS credits, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) SELECT game_id, CASE WHEN season = 2000 THEN credits END AS credits FROM games LEFT JOIN m USING (player_id, season)")
def market(t):
    m = t("orders").groupBy(F.col("o_custkey").alias("player_id"), F.year("o_orderdate").alias("season")).agg(F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("credits"))
    return t.games().join(m, ["player_id", "season"], "left").select("game_id", X.valid_only("credits", F.col("season") == 2000).alias("credits"))


@query("j06_split_index", f"WITH {GAMES}, s AS (SELECT season, min(game_time) AS first_time, count(*) AS n FROM games GROUP BY 1) SELECT season, CAST(dense_rank() OVER (ORDER BY first_time, season) AS INTEGER) AS split, CAST(greatest(1995, season - 2) AS INTEGER) AS history_3, n FROM s")
def split_index(t):
    s = t.games().groupBy("season").agg(F.min("game_time").alias("first_time"), F.count("*").alias("n"))  # a row for each season
    return s.select("season", F.dense_rank().over(Window.orderBy("first_time", "season")).alias("split"), F.greatest(F.lit(1995), F.col("season") - 2).alias("history_3"), "n")


@query("j11_shot_profiles", f"WITH {SHOTS} SELECT label, count(*) AS n, count(*) FILTER (WHERE zone = 'RIM') AS rim, count(*) FILTER (WHERE zone = 'PAINT') AS paint, round(count(*) FILTER (WHERE zone IS NULL)::DOUBLE / count(*), 4) AS quarantined, round(count(*) FILTER (WHERE zone = 'CORNER3')::DOUBLE / nullif(count(*) FILTER (WHERE points = 3), 0), 4) AS corner_share FROM shots GROUP BY 1")
def shot_profiles(t):
    z = F.col("zone")
    return shots(t).groupBy("label").agg(F.count("*").alias("n"), F.count_if(z == "RIM").alias("rim"), F.count_if(z == "PAINT").alias("paint"), r4(F.count_if(z.isNull()) / F.count("*")).alias("quarantined"), r4(X.ratio(F.count_if(z == "CORNER3"), F.count_if(F.col("points") == 3))).alias("corner_share"))


@query("j12_shot_mix_change", f"WITH {SHOTS}, o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS r FROM shots WHERE zone IS NOT NULL), z AS (SELECT label, zone, count(*) FILTER (WHERE r <= 20)::DOUBLE AS a, count(*)::DOUBLE AS b FROM o GROUP BY ALL), s AS (SELECT *, sum(a) OVER (PARTITION BY label) AS ta, sum(b) OVER (PARTITION BY label) AS tb FROM z) SELECT label, round(0.5::DOUBLE * sum(abs(a / ta - b / tb)), 4) AS mix_change, round(sum((b / tb) * (b / tb)), 4) AS concentration FROM s GROUP BY 1")
def mix_change(t):
    o = shots(t).where("zone is not null").withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("vec_id"))))
    z = o.groupBy("label", "zone").agg(F.count_if(F.col("r") <= 20).cast("double").alias("a"), F.count("*").cast("double").alias("b"))
    w = Window.partitionBy("label")
    s = z.select("label", (F.col("a") / F.sum("a").over(w)).alias("p"), (F.col("b") / F.sum("b").over(w)).alias("q"))
    return s.groupBy("label").agg(r4(0.5 * F.sum(F.abs(F.col("p") - F.col("q")))).alias("mix_change"), r4(E.herfindahl(F.col("q"))).alias("concentration"))


@query("j13_role_stability", f"WITH {GAMES} SELECT game_id, round(1 / (1 + stddev_samp(units) OVER l / 10 + stddev_samp(n_lines) OVER l / 3), 4) AS stability FROM games WINDOW l AS ({_L.format(10)})")
def stability(t):
    w = H.last(10)
    return t.games().select("game_id", r4(X.role_stability(F.stddev_samp("units").over(w), F.stddev_samp("n_lines").over(w))).alias("stability"))


@query("j15_game_environment", "WITH g AS (SELECT l_orderkey, sum(l_quantity * l_quantity) / (sum(l_quantity) * sum(l_quantity)) AS hhi FROM lineitem GROUP BY 1), o AS (SELECT o_orderkey, o_custkey, o_orderdate, hhi FROM orders JOIN g ON l_orderkey = o_orderkey) SELECT o_orderkey, round(hhi, 10) AS hhi, round(avg(hhi) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 10) AS last5 FROM o")
def environment(t):
    q = F.col("l_quantity")
    g = t("lineitem").groupBy("l_orderkey").agg((F.sum(q * q) / (F.sum(q) * F.sum(q))).alias("hhi"))
    o = t("orders").join(g, F.col("o_orderkey") == F.col("l_orderkey"))
    return o.select("o_orderkey", F.round("hhi", 10).alias("hhi"), F.round(F.avg("hhi").over(History("o_custkey", "o_orderdate", "o_orderkey").last(5)), 10).alias("last5"))


@query("j16_played_only_history", f"""WITH {GAMES}, g AS (SELECT *, returned = 0 AS played FROM games), n AS (SELECT *, count(*) FILTER (WHERE played) OVER ({_B}) AS n FROM g), p AS (SELECT player_id, n + 1 AS j, units FROM n WHERE played)
    SELECT n.game_id, count(p.units) AS last_k_n, round(avg(p.units), 4) AS last_k_avg FROM n LEFT JOIN p ON p.player_id = n.player_id AND p.j <= n.n AND p.j > n.n - 3 GROUP BY 1""")
def played_only(t):
    f = P.played_history(t.games().withColumn("played", F.col("returned") == 0), "units", "played", 3)
    return f.select("game_id", "last_k_n", r4("last_k_avg").alias("last_k_avg"))


@query("j17_absence_context", f"WITH {GAMES}, m AS (SELECT priority, CAST(game_time AS DATE) AS d, count(*) AS roster, count(*) FILTER (WHERE returned > 0) AS absent, sum(units) FILTER (WHERE returned > 0) AS lost FROM games GROUP BY ALL HAVING count(*) >= 2) SELECT game_id, absent, coalesce(lost, 0) AS lost, absent >= 2 AS high FROM games JOIN m ON m.priority = games.priority AND m.d = CAST(game_time AS DATE) WHERE returned = 0")
def absence(t):
    g = t.games().withColumn("d", F.to_date("game_time"))
    m = g.groupBy("priority", "d").agg(F.count("*").alias("roster"), F.count_if(F.col("returned") > 0).alias("absent"), F.sum(F.when(F.col("returned") > 0, F.col("units"))).alias("lost")).where("roster >= 2")
    return g.where("returned = 0").join(m, ["priority", "d"]).select("game_id", "absent", F.coalesce("lost", F.lit(0.0)).alias("lost"), (F.col("absent") >= 2).alias("high"))


@query("j19_naive_redistribution", f"WITH {GAMES}, m AS (SELECT priority, CAST(game_time AS DATE) AS d, sum(units) FILTER (WHERE returned > 0) AS lost, count(*) FILTER (WHERE returned = 0) AS n, sum(units) FILTER (WHERE returned = 0) AS kept FROM games GROUP BY ALL) SELECT game_id, round(units + coalesce(lost, 0) / n, 4) AS equal_share, round(units + coalesce(lost, 0) * units / kept, 4) AS proportional FROM games JOIN m ON m.priority = games.priority AND m.d = CAST(game_time AS DATE) WHERE returned = 0")
def redistribution(t):
    w = Window.partitionBy("priority", F.to_date("game_time"))
    lost = F.coalesce(F.sum(F.when(F.col("returned") > 0, F.col("units"))).over(w), F.lit(0.0))
    n, kept = F.count(F.when(F.col("returned") == 0, 1)).over(w), F.sum(F.when(F.col("returned") == 0, F.col("units"))).over(w)
    out = t.games().select("game_id", "returned", r4(F.col("units") + X.ratio(lost, n)).alias("equal_share"), r4(F.col("units") + X.ratio(lost * F.col("units"), kept)).alias("proportional"))
    return out.where("returned = 0").drop("returned")


@query("j21_baselines", f"""WITH {GAMES}, n AS (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY game_time, game_id) AS i FROM games), e AS (SELECT a.game_id, sum(b.units * pow(0.65, a.i - b.i - 1)) / sum(pow(0.65, a.i - b.i - 1)) AS ewma FROM n a LEFT JOIN n b ON a.player_id = b.player_id AND b.i < a.i GROUP BY 1),
    w AS (SELECT game_id, player_id, season, units, avg(units) OVER ({_B}) AS career, avg(units) OVER (PARTITION BY player_id, season ORDER BY game_time, game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s, avg(units) OVER ({_L.format(3)}) AS l3, avg(units) OVER ({_L.format(5)}) AS l5, sum(units) OVER ({_B}) / nullif(sum(n_lines) OVER ({_B}), 0) * avg(n_lines) OVER ({_L.format(5)}) AS r FROM games)
    SELECT game_id, player_id, season, units, round(coalesce(s, career, 10), 6) AS season_avg, round(coalesce(l3, career, 10), 6) AS last_3, round(coalesce(l5, career, 10), 6) AS last_5, round(coalesce(ewma, career, 10), 6) AS ewma, round(coalesce(r, career, 10), 6) AS rate_x_exposure, round(0.5::DOUBLE * coalesce(s, career, 10) + 0.5::DOUBLE * coalesce(l5, career, 10), 6) AS blend FROM w JOIN e USING (game_id)""")
def baselines(t):
    b = P.baselines(t.games(), "units", "n_lines")
    return b.select("game_id", "player_id", "season", "units", *[F.round(c, 6).alias(c) for c in ("season_avg", "last_3", "last_5", "ewma", "rate_x_exposure", "blend")])


@query("j23_role_change_score", f"WITH {GAMES}, w AS (SELECT game_id, abs(avg(units) OVER ({_L.format(3)}) - avg(units) OVER ({_B})) AS a, abs(stddev_samp(units) OVER ({_L.format(5)})) AS b, 40 * abs(avg(returned) OVER ({_L.format(3)}) - avg(returned) OVER ({_B})) AS c FROM games) SELECT game_id, round((coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0)) / nullif(CAST(a IS NOT NULL AS INTEGER) + CAST(b IS NOT NULL AS INTEGER) + CAST(c IS NOT NULL AS INTEGER), 0), 4) AS score FROM w")
def role_change(t):
    b, l3 = H.before(), H.last(3)
    parts = (F.abs(F.avg("units").over(l3) - F.avg("units").over(b)), F.abs(F.stddev_samp("units").over(H.last(5))), 40 * F.abs(F.avg("returned").over(l3) - F.avg("returned").over(b)))
    w = t.games().select("game_id", *[p.alias(n) for p, n in zip(parts, "abc", strict=True)])
    return w.select("game_id", r4(P.mean_of_known(F.col("a"), F.col("b"), F.col("c"))).alias("score"))


@query("j30_cold_start_blend", f"WITH {GAMES}, s AS (SELECT player_id, season, count(*) AS n, avg(units) AS u FROM games GROUP BY ALL), m AS (SELECT season, avg(u) AS mean FROM s GROUP BY 1) SELECT a.player_id, a.season, round(CASE WHEN b.u IS NULL THEN m.mean ELSE 0.7::DOUBLE * m.mean + 0.3::DOUBLE * b.u END, 4) AS start FROM s a LEFT JOIN s b ON b.player_id = a.player_id AND b.season = a.season - 1 JOIN m ON m.season = a.season")
def cold_start(t):
    s = t.games().groupBy("player_id", "season").agg(F.avg("units").alias("u"))
    before = s.select("player_id", (F.col("season") + 1).alias("season"), F.col("u").alias("before"))
    m = s.groupBy("season").agg(F.avg("u").alias("mean"))  # a row for each season
    j = s.join(before, ["player_id", "season"], "left").join(F.broadcast(m), "season")
    return j.select("player_id", "season", r4(F.when(F.col("before").isNull(), F.col("mean")).otherwise(0.7 * F.col("mean") + 0.3 * F.col("before"))).alias("start"))


@query("j33_pool_status", f"WITH {GAMES}, a AS (SELECT player_id, count(*) AS n, max(season) AS last, count(DISTINCT priority) AS p FROM games GROUP BY 1) SELECT c_custkey, CASE WHEN n IS NULL THEN 'UNKNOWN' WHEN last < 2000 THEN 'INACTIVE' WHEN p = 1 AND n > 1 THEN 'REVIEW' WHEN n < 3 THEN 'THIN' ELSE 'READY' END AS status FROM customer LEFT JOIN a ON player_id = c_custkey")
def pool_status(t):
    a = t.games().groupBy("player_id").agg(F.count("*").alias("n"), F.max("season").alias("last"), F.count_distinct("priority").alias("p"))
    status = F.when(F.col("n").isNull(), "UNKNOWN").when(F.col("last") < 2000, "INACTIVE").when((F.col("p") == 1) & (F.col("n") > 1), "REVIEW").when(F.col("n") < 3, "THIN").otherwise("READY")
    return t("customer").join(a, F.col("c_custkey") == F.col("player_id"), "left").select("c_custkey", status.alias("status"))


@query("j34_price_frame", f"WITH {GAMES}, s AS (SELECT player_id, CAST(year(game_time) * 12 + month(game_time) AS INTEGER) AS m, max(price) AS price, sum(units) AS units FROM games GROUP BY ALL), w AS (SELECT *, lead(price) OVER o AS next_price, lead(m) OVER o AS next_m, lag(price) OVER o AS lag_1, lag(price, 2) OVER o AS lag_2, avg(units) OVER (PARTITION BY player_id ORDER BY m ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS recent FROM s WINDOW o AS (PARTITION BY player_id ORDER BY m)) SELECT player_id, m, price, lag_1, lag_2, round(recent, 4) AS recent, CASE WHEN next_m = m + 1 THEN next_price END AS target FROM w")
def price_frame(t):
    s = t.games().groupBy("player_id", (F.year("game_time") * 12 + F.month("game_time")).alias("m")).agg(F.max("price").alias("price"), F.sum("units").alias("units"))
    o = Window.partitionBy("player_id").orderBy("m")
    return s.select("player_id", "m", "price", F.lag("price").over(o).alias("lag_1"), F.lag("price", 2).over(o).alias("lag_2"), r4(F.avg("units").over(o.rowsBetween(-3, -1))).alias("recent"), F.when(F.lead("m").over(o) == F.col("m") + 1, F.lead("price").over(o)).alias("target"))


@query("j14_target_rows_in_history", f"WITH {GAMES}, tr AS (SELECT player_id, max(game_time) + INTERVAL 1 DAY AS game_time FROM games GROUP BY 1), u AS (SELECT player_id, game_time, game_id, units, 1 AS o FROM games UNION ALL SELECT player_id, game_time, NULL, NULL, 0 FROM tr) SELECT player_id, n, round(a, 4) AS last_5_avg FROM (SELECT *, count(units) OVER w AS n, avg(units) OVER l AS a FROM u WINDOW w AS (PARTITION BY player_id ORDER BY game_time, o, game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), l AS (PARTITION BY player_id ORDER BY game_time, o, game_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)) WHERE o = 0")
def target_rows(t):
    """Rows to predict are appended with null stats, so the same windows serve training and live rows."""
    g = t.games().select("player_id", "game_time", "game_id", "units", F.lit(1).alias("o"))
    tr = g.groupBy("player_id").agg((F.max("game_time") + F.expr("INTERVAL 1 DAY")).alias("game_time")).withColumn("o", F.lit(0))
    h = History("player_id", "game_time", "o", "game_id")
    u = g.unionByName(tr, allowMissingColumns=True).withColumns({"n": F.count("units").over(h.before()), "a": F.avg("units").over(h.last(5))})
    return u.where("o = 0").select("player_id", "n", r4("a").alias("last_5_avg"))


@query("j26_parity_check", f"""WITH {GAMES}, n AS (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY game_time, game_id) AS i, avg(units) OVER ({_L.format(5)}) AS a FROM games),
    p AS (SELECT a.game_id, any_value(a.a) AS a, avg(b.units) AS b FROM n a LEFT JOIN n b ON b.player_id = a.player_id AND b.i BETWEEN a.i - 5 AND a.i - 1 GROUP BY 1)
    SELECT count(*) AS rows, count(*) FILTER (WHERE a IS NOT NULL) AS known, round(sum(a), 3) AS total, count(*) FILTER (WHERE a IS DISTINCT FROM b AND coalesce(abs(a - b) > 1e-9, true)) AS mismatches FROM p""")
def parity(t):
    """Two ways to the same feature, a frame's mean and a fold over the frame's values, compared at 1e-9."""
    last = F.collect_list("units").over(H.last(5))
    j = t.games().select(F.avg("units").over(H.last(5)).alias("a"), X.ratio(F.aggregate(last, F.lit(0.0), lambda s, x: s + x), F.size(last)).alias("b"))
    same = F.col("a").eqNullSafe(F.col("b")) | F.coalesce(F.abs(F.col("a") - F.col("b")) <= 1e-9, F.lit(False))
    return j.agg(F.count("*").alias("rows"), F.count("a").alias("known"), F.round(F.sum("a"), 3).alias("total"), F.count_if(~same).alias("mismatches"))
