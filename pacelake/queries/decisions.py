"""Allocation, rosters and models (survey J18, J34-J47, J59)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import distributions as D
from ..operators import allocation as A
from ..operators.windows import History, top_k
from .evaluating import PRED, predictions
from .registry import GAMES, query, r4


#: The nearest values within 0 and 40 that sum to 200, from breakpoints of the shift; {} has rows g, i, x.
CAPPED = """WITH r AS ({}), b AS (SELECT g, -x AS b FROM r UNION SELECT g, 40 - x FROM r), f AS (SELECT r.g, b, sum(least(greatest(x + b, 0), 40)) AS f FROM b JOIN r ON r.g = b.g GROUP BY ALL),
    e AS (SELECT g, max(b) FILTER (WHERE f <= 200) AS lo, max_by(f, b) FILTER (WHERE f <= 200) AS f_lo, min(b) FILTER (WHERE f >= 200) AS hi, min_by(f, b) FILTER (WHERE f >= 200) AS f_hi FROM f GROUP BY 1),
    s AS (SELECT g, CASE WHEN f_hi > f_lo THEN lo + (200 - f_lo) * (hi - lo) / (f_hi - f_lo) ELSE lo END AS s FROM e WHERE lo IS NOT NULL AND hi IS NOT NULL)"""


@query("j18_simplex_projection", CAPPED.format("SELECT l_orderkey AS g, l_linenumber AS i, l_quantity AS x FROM lineitem") + " SELECT g AS l_orderkey, i AS l_linenumber, round(least(greatest(x + s, 0), 40), 4) AS projected FROM r JOIN s USING (g)")
def simplex(t):
    """Line quantities as minutes, brought to 200 an order within 0 and 40."""
    line = t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return A.project_to_total(line, ["l_orderkey"], "l_linenumber", "l_quantity", 200.0, 0.0, 40.0).select("l_orderkey", "l_linenumber", r4("projected").alias("projected"))


@query("j18_projection_totals", "SELECT l_orderkey, 200.0::DOUBLE AS total, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1 HAVING count(*) * 40 >= 200")
def projection_totals(t):
    line = t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    p = A.project_to_total(line, ["l_orderkey"], "l_linenumber", "l_quantity", 200.0, 0.0, 40.0)
    return p.groupBy("l_orderkey").agg(F.round(F.sum("projected"), 6).alias("total"), F.count("*").alias("n"))


@query("j35_lineup_score", "WITH r AS (SELECT l_orderkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber) AS k FROM lineitem) SELECT l_orderkey, sum(l_quantity * CASE WHEN k = 1 THEN 2 WHEN k <= 3 THEN 1 ELSE 0.5::DOUBLE END) AS score FROM r GROUP BY 1")
def lineup_score(t):
    k = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("l_quantity"), "l_linenumber"))
    role = F.when(k == 1, "CAPTAIN").when(k <= 3, "STARTER").otherwise("BENCH")
    return A.lineup_score(t("lineitem").select("l_orderkey", "l_quantity", role.alias("role")), ["l_orderkey"], "l_quantity", "role")


@query("j36_inverse_cdf", f"WITH {PRED} SELECT game_id, round(q10 + (q50 - q10) * (0.3 - 0.1) / 0.4, 4) AS p30, round(q50 + (q90 - q50) * 0.5::DOUBLE, 4) AS p70 FROM pred")
def inverse(t):
    levels, q = F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)), F.array("q10", "q50", "q90")
    p = predictions(t)
    return p.select("game_id", r4(D.inverse_cdf(F.lit(0.3), levels, q)).alias("p30"), r4(D.inverse_cdf(F.lit(0.7), levels, q)).alias("p70"))


@query("e23_crps", f"""WITH {GAMES}, s AS (SELECT game_id, units AS y, list(units) OVER (PARTITION BY player_id ORDER BY game_time, game_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS x FROM games), a AS (SELECT game_id, avg(abs(v - y)) AS first FROM (SELECT game_id, y, unnest(x) AS v FROM s) GROUP BY 1),
    b AS (SELECT game_id, avg(abs(v - w)) AS pairs FROM (SELECT game_id, v, unnest(x) AS w FROM (SELECT game_id, x, unnest(x) AS v FROM s)) GROUP BY 1) SELECT game_id, round(first - pairs / 2, 4) AS crps FROM a JOIN b USING (game_id)""")
def crps(t):
    sample = F.collect_list("units").over(History("player_id", "game_time", "game_id").last(10))
    return t.games().select("game_id", F.col("units").alias("y"), sample.alias("x")).where("size(x) > 0").select("game_id", r4(D.crps(F.col("x"), F.col("y"))).alias("crps"))


@query("j47_monotone_survival")
def survival(t):
    """Shares of all of a player's games above rising thresholds, held monotone by pooling."""
    steps = (40, 80, 120, 160)
    g = t.games().groupBy("player_id").agg(F.array(*[F.avg((F.col("units") >= x).cast("double")) for x in steps]).alias("raw"), F.array(*[F.count("units").cast("double")] * len(steps)).alias("w"))
    return g.select("player_id", F.transform(D.decreasing("raw", "w"), lambda x: F.round(x, 4)).alias("survival"))


@query("j39_best_rosters")
def rosters(t):
    """A slate for each size of part: guards, forwards and centers by type, credits by price, clubs by brand."""
    p = t("part").select(
        (F.col("p_size") % 7).alias("slate"), F.col("p_partkey").alias("player"), F.element_at(F.array(F.lit("G"), F.lit("F"), F.lit("C")), (F.col("p_partkey") % 3 + 1).cast("int")).alias("position"), F.col("p_brand").alias("club"),
        F.round(4 + F.pmod(F.col("p_retailprice"), F.lit(12.0)), 1).alias("credits"), F.round(F.pmod(F.col("p_retailprice") * 7, F.lit(40.0)), 3).alias("value"),
    )
    return A.rosters(p, "slate", {"G": 4, "F": 4, "C": 2}, 100.0, 6)


@query("j42_roster_rules", "WITH r AS (SELECT l_orderkey, count(*) AS n, max(c) AS most, sum(l_quantity) AS credits FROM (SELECT l_orderkey, l_quantity, count(*) OVER (PARTITION BY l_orderkey, l_suppkey) AS c FROM lineitem) GROUP BY 1) SELECT l_orderkey, n <= 7 AND most <= 2 AND credits <= 200 AS legal, concat_ws('|', CASE WHEN credits > 200 THEN 'CREDITS' END, CASE WHEN most > 2 THEN 'CLUB' END, CASE WHEN n > 7 THEN 'SIZE' END) AS reasons FROM r")
def roster_rules(t):
    by = t("lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.count("*").alias("c"), F.sum("l_quantity").alias("q"))
    r = by.groupBy("l_orderkey").agg(F.sum("c").alias("n"), F.max("c").alias("most"), F.sum("q").alias("credits"))
    bad = {"CREDITS": F.col("credits") > 200, "CLUB": F.col("most") > 2, "SIZE": F.col("n") > 7}
    return r.select("l_orderkey", (~(bad["CREDITS"] | bad["CLUB"] | bad["SIZE"])).alias("legal"), F.concat_ws("|", *[F.when(c, n) for n, c in bad.items()]).alias("reasons"))


@query("j43_policy_comparison", f"WITH {PRED}, g AS (SELECT player_id, p, q50, y, row_number() OVER (PARTITION BY season ORDER BY p DESC, game_id) AS a, row_number() OVER (PARTITION BY season ORDER BY q50 DESC, game_id) AS b, row_number() OVER (PARTITION BY season ORDER BY y DESC, game_id) AS o, season FROM pred) SELECT season, sum(y) FILTER (WHERE a <= 10) AS by_mean, sum(y) FILTER (WHERE b <= 10) AS by_median, sum(y) FILTER (WHERE o <= 10) AS hindsight FROM g GROUP BY 1")
def policies(t):
    g = predictions(t).select("season", "game_id", "p", "q50", "y")
    best = lambda c, name: top_k(g, ["season"], [F.desc(c), F.col("game_id")], 10).groupBy("season").agg(F.sum("y").alias(name))
    return best("p", "by_mean").join(best("q50", "by_median"), "season").join(best("y", "hindsight"), "season")


@query("j59_walk_forward_model")
def model(t):
    """Linear regression of the next value on trailing features: fitted on all seasons but the last, judged on the last."""
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
    from pyspark.ml.pipeline import Pipeline
    from pyspark.ml.regression import LinearRegression

    names = ["prior", "p", "q10", "q50", "q90"]
    data = predictions(t).select("season", F.col("y").alias("label"), *[F.col(c).cast("double").alias(c) for c in names])
    last = data.agg(F.max("season")).first()[0]
    stages = [Imputer(inputCols=names, outputCols=names), VectorAssembler(inputCols=names, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), LinearRegression(regParam=0.1)]
    fitted = Pipeline(stages=stages).fit(data.where(F.col("season") < last))
    scored = fitted.transform(data.where(F.col("season") == last))
    return scored.groupBy("season").agg(F.count("*").alias("n"), r4(F.avg(F.abs(F.col("prediction") - F.col("label")))).alias("mae"), r4(F.avg(F.abs(F.col("p") - F.col("label")))).alias("baseline_mae"))
