"""Evaluation of predictions (survey E19-E26, J45-J50, J78-J81): the trailing mean predicts the next value."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.distributions import shifted_curve
from ..functions.exprs import band
from ..operators import evaluation as E
from ..operators.windows import History
from .registry import GAMES, query, r4

_L10 = "(PARTITION BY player_id ORDER BY game_time, game_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)"
PRED = f"""{GAMES}, pred AS (SELECT *, CASE WHEN prior < 3 THEN '0-2' WHEN prior < 6 THEN '3-5' ELSE '6+' END AS depth FROM (SELECT game_id, player_id, season, game_time, units AS y, priority, count(*) OVER w AS prior, round(avg(units) OVER w, 4) AS p, round(quantile_cont(units, 0.1) OVER w, 4) AS q10,
    round(quantile_cont(units, 0.5) OVER w, 4) AS q50, round(quantile_cont(units, 0.9) OVER w, 4) AS q90 FROM games WINDOW w AS {_L10}) WHERE prior > 0)"""


def predictions(t):
    w = History("player_id", "game_time", "game_id").last(10)
    q = lambda x: r4(F.percentile("units", x).over(w))
    out = t.games().select("game_id", "player_id", "season", "game_time", F.col("units").alias("y"), "priority", F.count("*").over(w).alias("prior"), r4(F.avg("units").over(w)).alias("p"), q(0.1).alias("q10"), q(0.5).alias("q50"), q(0.9).alias("q90")).where("prior > 0")
    return out.withColumn("depth", F.when(F.col("prior") < 3, "0-2").when(F.col("prior") < 6, "3-5").otherwise("6+"))


_METRICS = "count(*) AS n, round(avg(abs(p - y)), 3) AS mae, round(sqrt(avg((p - y) * (p - y))), 3) AS rmse, round(avg(p - y), 3) AS bias, round(corr(y, p), 3) AS pearson"


def _rounded(df, keys):
    return df.select(*keys, "n", *[F.round(c, 3).alias(c) for c in ("mae", "rmse", "bias", "pearson")])


@query("e19_error_metrics", f"WITH {PRED} SELECT season, {_METRICS} FROM pred GROUP BY season")
def metrics(t):
    return _rounded(E.error_metrics(predictions(t), "y", "p", ["season"]), ["season"])


@query("e19_spearman", f"""WITH {PRED}, r AS (SELECT season, rank() OVER (PARTITION BY season ORDER BY y) + (count(*) OVER (PARTITION BY season, y) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY season ORDER BY p) + (count(*) OVER (PARTITION BY season, p) - 1) / 2.0::DOUBLE AS b FROM pred)
    SELECT season, round(corr(a, b), 4) AS spearman FROM r GROUP BY season""")
def spearman(t):
    return E.spearman(predictions(t), "y", "p", ["season"]).select("season", r4("spearman").alias("spearman"))


@query("e20_banded_metrics", f"WITH {PRED} SELECT depth, {_METRICS} FROM pred GROUP BY depth")
def banded(t):
    return _rounded(E.error_metrics(predictions(t), "y", "p", ["depth"]), ["depth"])


@query("e20_prediction_bins", f"WITH {PRED}, b AS (SELECT *, CASE WHEN p >= 0 AND p < 50 THEN 'low' WHEN p >= 50 AND p < 110 THEN 'mid' WHEN p >= 110 AND p < 1000 THEN 'high' END AS bin FROM pred) SELECT bin, {_METRICS} FROM b GROUP BY bin")
def bins(t):
    return _rounded(E.error_metrics(predictions(t).withColumn("bin", band("p", [0, 50, 110, 1000], ["low", "mid", "high"])), "y", "p", ["bin"]), ["bin"])


@query("e23_pinball_coverage", f"""WITH {PRED} SELECT season, round(avg(greatest(0.1 * (y - q10), -0.9 * (y - q10))), 4) AS pinball_10, round(avg(greatest(0.9 * (y - q90), -0.1 * (y - q90))), 4) AS pinball_90, round(avg(CAST(y BETWEEN q10 AND q90 AS INTEGER)), 4) AS coverage FROM pred GROUP BY season""")
def pinball(t):
    inside = F.col("y").between(F.col("q10"), F.col("q90")).cast("int")
    return predictions(t).groupBy("season").agg(r4(F.avg(E.pinball("y", "q10", 0.1))).alias("pinball_10"), r4(F.avg(E.pinball("y", "q90", 0.9))).alias("pinball_90"), r4(F.avg(inside)).alias("coverage"))


@query("e23_weighted_interval_score", f"""WITH {PRED} SELECT season, round(avg((0.5 * abs(y - q50) + 0.1 * ((q90 - q10) + 10 * greatest(q10 - y, 0) + 10 * greatest(y - q90, 0))) / 0.6), 4) AS wis FROM pred GROUP BY season""")
def wis(t):
    return predictions(t).groupBy("season").agg(r4(F.avg(E.weighted_interval_score("y", "q50", [("q10", "q90", 0.2)]))).alias("wis"))


BIN = f"{PRED}, pb AS (SELECT season, CAST(y >= 100 AS INTEGER) AS hit, least(greatest(p / 200, 0.01), 0.99) AS prob FROM pred)"


def binary(t):
    return predictions(t).select("season", (F.col("y") >= 100).cast("int").alias("hit"), F.least(F.greatest(F.col("p") / 200, F.lit(0.01)), F.lit(0.99)).alias("prob"))


@query("e23_brier_log_loss", f"WITH {BIN} SELECT season, round(avg((prob - hit) * (prob - hit)), 4) AS brier, round(-avg(CASE WHEN hit = 1 THEN ln(prob) ELSE ln(1 - prob) END), 4) AS log_loss FROM pb GROUP BY season")
def brier(t):
    return binary(t).groupBy("season").agg(r4(E.brier("hit", "prob")).alias("brier"), r4(E.log_loss("hit", "prob")).alias("log_loss"))


@query("e23_auc", f"""WITH {BIN}, r AS (SELECT season, hit, rank() OVER (PARTITION BY season ORDER BY prob) + (count(*) OVER (PARTITION BY season, prob) - 1) / 2.0::DOUBLE AS r FROM pb)
    SELECT season, round((sum(r) FILTER (WHERE hit = 1) - count(*) FILTER (WHERE hit = 1) * (count(*) FILTER (WHERE hit = 1) + 1) / 2.0::DOUBLE) / (count(*) FILTER (WHERE hit = 1) * count(*) FILTER (WHERE hit = 0))::DOUBLE, 4) AS auc FROM r GROUP BY season""")
def auc(t):
    return E.auc(binary(t), "hit", "prob", ["season"]).select("season", r4("auc").alias("auc"))


@query("e23_calibration_bins", f"WITH {BIN} SELECT CAST(least(floor(prob * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(prob), 4) AS mean_p, round(avg(hit::DOUBLE), 4) AS share FROM pb GROUP BY 1")
def calibration(t):
    return E.calibration_bins(binary(t), "hit", "prob").select("bin", "n", r4("mean_p").alias("mean_p"), r4("share").alias("share"))


@query("j45_affine_calibration", f"WITH {PRED} SELECT season, round(regr_slope(y, p), 4) AS slope, round(regr_intercept(y, p), 3) AS intercept, round(median(y - p), 4) AS median_shift FROM pred GROUP BY season")
def affine(t):
    return predictions(t).groupBy("season").agg(r4(F.regr_slope("y", "p")).alias("slope"), F.round(F.regr_intercept("y", "p"), 3).alias("intercept"), r4(F.percentile(F.col("y") - F.col("p"), 0.5)).alias("median_shift"))


@query("j46_conformal_radius", f"""WITH {PRED}, r AS (SELECT depth, abs(y - p) AS r, row_number() OVER (PARTITION BY depth ORDER BY abs(y - p)) AS k, count(*) OVER (PARTITION BY depth) AS n, row_number() OVER (ORDER BY abs(y - p)) AS ka, count(*) OVER () AS na FROM pred)
    SELECT depth, max(n) AS n, round(CASE WHEN max(n) >= 100 THEN max(r) FILTER (WHERE k = least(n, ceil((n + 1) * 0.9))) ELSE (SELECT max(r) FROM r WHERE ka = least(na, ceil((na + 1) * 0.9))) END, 4) AS radius FROM r GROUP BY depth""")
def conformal(t):
    return E.conformal_radius(predictions(t).withColumn("e", F.col("y") - F.col("p")), "depth", "e", 0.9).select("depth", "n", r4("radius").alias("radius"))


@query("j47_rearranged_quantiles", f"WITH {PRED} SELECT game_id, list_sort([q90, q10, q50]) AS q FROM pred")
def rearranged(t):
    return predictions(t).select("game_id", F.array_sort(F.array("q90", "q10", "q50")).alias("q"))


@query("j48_hybrid_weight", f"""WITH {PRED}, g AS (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0]::DOUBLE[]) AS w), m AS (SELECT w, round(avg(abs(w * p + (1 - w) * q50 - y)), 4) AS mae FROM pred, g GROUP BY w) SELECT w, mae FROM m ORDER BY mae, w LIMIT 1""")
def hybrid(t):
    grid = F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)])
    e = predictions(t).select("y", "p", "q50", F.explode(grid).alias("w"))
    m = e.groupBy("w").agg(r4(F.avg(F.abs(F.col("w") * F.col("p") + (1 - F.col("w")) * F.col("q50") - F.col("y")))).alias("mae"))
    return m.orderBy("mae", "w").limit(1)


@query("j49_threshold_base_rates", f"WITH {PRED}, h AS (SELECT unnest([40, 80, 120, 160]) AS threshold) SELECT CAST(threshold AS INTEGER) AS threshold, season, round(avg(CAST(y >= threshold AS INTEGER)), 4) AS rate, count(*) FILTER (WHERE y >= threshold) >= 100 AS retained FROM pred, h GROUP BY ALL")
def thresholds(t):
    e = predictions(t).select("season", "y", F.explode(F.array(*[F.lit(x) for x in (40, 80, 120, 160)])).alias("threshold"))
    return e.groupBy("threshold", "season").agg(r4(F.avg((F.col("y") >= F.col("threshold")).cast("int"))).alias("rate"), (F.count_if(F.col("y") >= F.col("threshold")) >= 100).alias("retained"))


@query("j78_paired_comparison", f"WITH {PRED} SELECT depth, round(avg(abs(p - y) - abs(q50 - y)), 4) AS mean_gain, round(avg(CAST(abs(q50 - y) < abs(p - y) AS INTEGER)), 4) AS p_better FROM pred GROUP BY depth")
def paired(t):
    a, b = F.abs(F.col("p") - F.col("y")), F.abs(F.col("q50") - F.col("y"))
    return predictions(t).groupBy("depth").agg(r4(F.avg(a - b)).alias("mean_gain"), r4(F.avg((b < a).cast("int"))).alias("p_better"))


@query("j79_segments", f"WITH {PRED}, t AS (SELECT quantile_cont(p, 0.75) AS q FROM pred) SELECT p >= q AS top_quartile, {_METRICS} FROM pred, t GROUP BY 1 HAVING count(*) >= 30")
def segments(t):
    p = predictions(t)
    q = p.agg(F.percentile("p", 0.75).alias("q"))
    e = p.crossJoin(F.broadcast(q)).withColumn("top_quartile", F.col("p") >= F.col("q"))
    return _rounded(E.error_metrics(e, "y", "p", ["top_quartile"]).where("n >= 30"), ["top_quartile"])


@query("j80_shortfall_parts", f"WITH {PRED} SELECT part, round(avg(greatest(x, 0)), 4) AS shortfall FROM (SELECT 'above' AS part, y - p AS x FROM pred UNION ALL SELECT 'below', p - y FROM pred UNION ALL SELECT 'tail', y - q90 FROM pred) GROUP BY part")
def shortfall(t):
    long = predictions(t).select((F.col("y") - F.col("p")).alias("above"), (F.col("p") - F.col("y")).alias("below"), (F.col("y") - F.col("q90")).alias("tail")).unpivot([], ["above", "below", "tail"], "part", "x")
    return long.groupBy("part").agg(r4(F.avg(F.greatest("x", F.lit(0.0)))).alias("shortfall"))


@query("j81_group_correlation", f"WITH {PRED} SELECT player_id, round(corr(p, y), 4) AS r FROM pred GROUP BY 1 HAVING count(*) >= 5 AND stddev_pop(p) > 0 AND stddev_pop(y) > 0")
def group_correlation(t):
    g = predictions(t).groupBy("player_id").agg(E.correlation("p", "y").alias("r"), F.count("*").alias("n"), F.stddev_pop("p").alias("sp"), F.stddev_pop("y").alias("sy"))
    return g.where("n >= 5 and sp > 0 and sy > 0").select("player_id", r4("r").alias("r"))


@query("j63_statistical_ties", f"""WITH {PRED}, m AS (SELECT player_id, avg(y) AS mean, stddev_samp(y) / sqrt(count(*)) AS se, count(*) AS n FROM pred GROUP BY 1 HAVING count(*) >= 5), b AS (SELECT arg_max(mean - 1.96 * se, (mean, -player_id)) AS floor FROM m)
    SELECT player_id, round(mean, 4) AS mean FROM m, b WHERE mean >= floor""")
def ties(t):
    m = predictions(t).groupBy("player_id").agg(F.avg("y").alias("mean"), (F.stddev_samp("y") / F.sqrt(F.count("*"))).alias("se"), F.count("*").alias("n")).where("n >= 5")
    floor = m.agg(F.max_by(F.col("mean") - 1.96 * F.col("se"), F.struct("mean", (-F.col("player_id")).alias("p"))).alias("floor"))
    return m.crossJoin(F.broadcast(floor)).where("mean >= floor").select("player_id", r4("mean").alias("mean"))


@query("j24_walk_forward_folds", f"WITH {GAMES}, s AS (SELECT DISTINCT season FROM games) SELECT s.season AS test_season, count(*) FILTER (WHERE g.season < s.season) AS n_train, count(*) FILTER (WHERE g.season = s.season) AS n_test FROM s JOIN games g ON g.season <= s.season GROUP BY 1 HAVING count(*) FILTER (WHERE g.season < s.season) > 0")
def folds(t):
    n = t.games().groupBy("season").agg(F.count("*").alias("n"))  # a row for each season
    before = F.sum("n").over(Window.orderBy("season").rowsBetween(Window.unboundedPreceding, -1))
    return n.select(F.col("season").alias("test_season"), before.alias("n_train"), F.col("n").alias("n_test")).where("n_train > 0")


_THRESHOLDS = [40, 80, 120, 160, 200]


@query("j65_shifted_survival", f"""WITH {PRED}, s AS (SELECT game_id, [{", ".join(f"avg((units >= {x})::INTEGER) OVER w" for x in _THRESHOLDS)}] AS chances FROM games WINDOW w AS {_L10}), x AS (SELECT pred.game_id, p - q50 AS delta, chances FROM pred JOIN s ON s.game_id = pred.game_id),
    u AS (SELECT game_id, delta, unnest({_THRESHOLDS})::DOUBLE AS t, least(greatest(unnest(chances), 1e-6), 1 - 1e-6) AS c FROM x), l AS (SELECT game_id, delta, t, ln(c / (1 - c)) AS odds FROM u),
    pieces AS (SELECT a.game_id, a.delta, a.t AS t0, b.t AS t1, a.odds AS o0, b.odds AS o1 FROM l a JOIN l b ON b.game_id = a.game_id AND b.t = a.t + 40), q AS (SELECT unnest({_THRESHOLDS})::DOUBLE AS t),
    v AS (SELECT game_id, q.t, 1 / (1 + exp(0 - (o0 + (o1 - o0) / (t1 - t0) * (q.t - delta - t0)))) AS moved FROM pieces JOIN q ON (q.t - delta >= t0 OR t0 = 40) AND (q.t - delta < t1 OR t1 = 200)),
    f AS (SELECT game_id, t, round(min(moved) OVER (PARTITION BY game_id ORDER BY t), 4) AS p FROM v) SELECT game_id, list(p ORDER BY t) AS survival FROM f GROUP BY 1""")
def shifted_survival(t):
    """Shares of the last ten games above each threshold, moved by how far the mean is from the median."""
    w = History("player_id", "game_time", "game_id").last(10)
    chances = F.array(*[F.avg((F.col("units") >= x).cast("int")).over(w) for x in _THRESHOLDS])
    q50 = r4(F.percentile("units", 0.5).over(w))
    rows = t.games().select("game_id", chances.alias("chances"), (r4(F.avg("units").over(w)) - q50).alias("delta")).where("delta is not null")
    return rows.select("game_id", F.transform(shifted_curve("chances", _THRESHOLDS, F.col("delta")), lambda x: F.round(x, 4)).alias("survival"))
