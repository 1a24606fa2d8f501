"""Isotonic calibration and mean-matched marginals (survey J36, J45), all pairs of columns (E25), joint availability (J28), walk-forward ridge (J34), stages with partial failure (K8), schema migrations (A2)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import isotonic as I
from ..operators import models as M
from ..operators.migrations import Migration, log, migrate, tables
from ..operators.staged import RUN, Stage, last_valid, latest, run
from ..operators.windows import History
from ..storage import new_path
from .evaluating import PRED, predictions
from .registry import GAMES, query, r4


@query("j45_isotonic_calibration", f"""WITH {PRED}, v AS (SELECT depth, floor(p / 4) AS x, count(*) AS w, sum(y) AS s FROM pred GROUP BY ALL), c AS (SELECT depth, x, row_number() OVER o AS i, sum(w) OVER o AS w, sum(s) OVER o AS s FROM v WINDOW o AS (PARTITION BY depth ORDER BY x)),
    mean AS (SELECT b.depth, coalesce(a.i, 0) + 1 AS f, b.i AS t, (b.s - coalesce(a.s, 0)) / (b.w - coalesce(a.w, 0)) AS m FROM c b, LATERAL (SELECT a.i, a.s, a.w FROM c a WHERE a.depth = b.depth AND a.i < b.i UNION ALL SELECT 0, 0, 0) a),
    low AS (SELECT c.depth, c.x, f, min(m) AS m FROM c JOIN mean ON mean.depth = c.depth AND f <= c.i AND t >= c.i GROUP BY ALL)
    SELECT depth, x, round(max(m), 4) AS fitted FROM low GROUP BY depth, x""")
def isotonic(t):
    """The fit of outcomes that doesn't fall with the prediction, in steps of four, by depth of history: largest of least means in SQL, pooling here."""
    p = predictions(t).select("depth", F.floor(F.col("p") / 4).cast("double").alias("x"), "y")
    return I.fitted(p, ["depth"], "x", "y").select("depth", "x", r4("fitted").alias("fitted"))


@query("j36_matched_marginal", f"""WITH RECURSIVE {PRED}, b(game_id, q10, q50, q90, m, lo, hi, k) AS (SELECT game_id, q10, q50, q90, p * 0.9137171::DOUBLE, p * 0.9137171::DOUBLE - q90 - 1, p * 0.9137171::DOUBLE - q10 + 1, 0 FROM pred
        UNION ALL SELECT game_id, q10, q50, q90, m, CASE WHEN short THEN mid ELSE lo END, CASE WHEN short THEN hi ELSE mid END, k + 1 FROM (SELECT *, 0.3::DOUBLE * greatest(q10 + mid, 0) + 0.4::DOUBLE * greatest(q50 + mid, 0) + 0.3::DOUBLE * greatest(q90 + mid, 0) < m AS short FROM (SELECT *, (lo + hi) / 2 AS mid FROM b WHERE k < 60)))
    SELECT game_id, round(greatest(q10 + (lo + hi) / 2, 0), 3) AS q10, round(greatest(q50 + (lo + hi) / 2, 0), 3) AS q50, round(greatest(q90 + (lo + hi) / 2, 0), 3) AS q90 FROM b WHERE k = 60""")
def marginal(t):
    """Quantiles moved so that the mean of their inverse CDF is 0.9137171 of the prediction, not below zero."""
    levels = F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))
    q = I.matched(levels, F.array("q10", "q50", "q90"), F.col("p") * 0.9137171, 0.0)
    return predictions(t).select("game_id", F.explode(F.array(q)).alias("q")).select("game_id", *[F.round(F.get("q", F.lit(i)), 3).alias(n) for i, n in enumerate(("q10", "q50", "q90"))])


_PAIRED = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey", "l_suppkey", "l_linenumber", "net", "taxed")
_WITH_NET = "SELECT *, l_extendedprice * (1 - l_discount) AS net, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS taxed FROM lineitem"


@query("e25_all_pairs", f"WITH l AS ({_WITH_NET}) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n, round(corr({a}, {b}), 4) AS r, abs(corr({a}, {b})) >= 0.98 AS near_duplicate FROM l" for i, a in enumerate(_PAIRED) for b in _PAIRED[i + 1 :]))
def all_pairs(t):
    """Correlations of all pairs of nine columns, and which are near duplicates."""
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    lines = t("lineitem").withColumn("net", net).withColumn("taxed", net * (1 + F.col("l_tax")))
    return M.correlations(lines, _PAIRED).withColumn("r", F.round("r", 4))


@query("j28_joint_scenarios", """WITH l AS (SELECT l_orderkey, l_linenumber, (min(l_partkey) % 83 + 3) / 101.0::DOUBLE AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY CAST(l_linenumber AS VARCHAR)) - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber),
    m AS (SELECT l_orderkey, m, product(CASE WHEN (m >> i) & 1 = 1 THEN p ELSE 1 - p END) AS q, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY i) FILTER (WHERE (m >> i) & 1 = 1) AS outs FROM l, range(128) r(m) WHERE m < (1 << n) GROUP BY l_orderkey, m),
    k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY q DESC) AS scenario FROM m QUALIFY scenario <= 6)
    SELECT l_orderkey, CAST(scenario AS INTEGER) AS scenario, round(q, 9) AS probability, abs(round(1 - sum(q) OVER (PARTITION BY l_orderkey), 7)) AS left_out, CASE WHEN scenario = 1 THEN coalesce(outs, '') END AS outs FROM k""")
def scenarios(t):
    """The six likeliest joint outcomes of each order's lines, and what is left out."""
    lines = t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(((F.min("l_partkey") % 83 + 3) / 101.0).alias("p"))
    s = M.joint_scenarios(lines, ["l_orderkey"], "l_linenumber", "p", 6)
    return s.select("l_orderkey", "scenario", F.round("probability", 9).alias("probability"), F.abs(F.round("left_out", 7)).alias("left_out"), F.when(F.col("scenario") == 1, F.array_join("outs", ",")).alias("outs"))


@query("j34_walk_forward_ridge", f"""WITH {GAMES}, g AS (SELECT game_id, season, price, avg(units) OVER w AS p, avg(price) OVER w AS q FROM games WINDOW w AS (PARTITION BY player_id ORDER BY game_time, game_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
    k AS (SELECT season, price / 1000.0::DOUBLE AS y, p AS a, q / 1000.0::DOUBLE AS b FROM g WHERE p IS NOT NULL),
    s AS (SELECT DISTINCT season FROM k), m AS (SELECT s.season, count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, var_pop(a) + 0.5 AS aa, var_pop(b) + 0.5 AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS bly FROM s JOIN k ON k.season < s.season GROUP BY s.season),
    f AS (SELECT season, n, ma, mb, my, (ay * bb - bly * ab) / (aa * bb - ab * ab) AS wa, (bly * aa - ay * ab) / (aa * bb - ab * ab) AS wb FROM m)
    SELECT k.season, CAST(any_value(f.n) AS BIGINT) AS trained, count(*) AS n, round(avg(abs(my + wa * (a - ma) + wb * (b - mb) - y)), 4) AS mae, round(avg(abs(b - y)), 4) AS baseline_mae, round(any_value(wa), 5) AS w_units, round(any_value(wb), 5) AS w_price FROM k JOIN f ON f.season = k.season GROUP BY k.season""")
def ridge(t):
    """The price of a game from a player's last five: each season by a ridge fit of all seasons before."""
    w = History("player_id", "game_time", "game_id").last(5)
    g = t.games().select("season", (F.col("price") / 1000.0).alias("y"), F.avg("units").over(w).alias("a"), (F.avg("price").over(w) / 1000.0).alias("b")).where("a is not null")
    fits = M.walk_forward_ridge(g, "season", ["a", "b"], "y", 0.5)
    p = M.predicted(g, fits, "season", ["a", "b"]).where("predicted is not null")
    m = p.groupBy("season").agg(F.count("*").alias("n"), r4(F.avg(F.abs(F.col("predicted") - F.col("y")))).alias("mae"), r4(F.avg(F.abs(F.col("b") - F.col("y")))).alias("baseline_mae"))
    return m.join(fits, "season").select("season", "trained", "n", "mae", "baseline_mae", F.round(F.get("weights", F.lit(0)), 5).alias("w_units"), F.round(F.get("weights", F.lit(1)), 5).alias("w_price"))


@query("k08_staged_run", """WITH first AS (SELECT 'lines' AS stage, 'SUCCEEDED' AS status UNION ALL SELECT 'totals', 'SUCCEEDED' UNION ALL SELECT 'audit', CASE WHEN (SELECT count(*) FROM lineitem WHERE l_quantity > 45) > 0 THEN 'FAILED' ELSE 'SUCCEEDED' END UNION ALL SELECT 'report', CASE WHEN (SELECT count(*) FROM lineitem WHERE l_quantity > 45) > 0 THEN 'SKIPPED' ELSE 'SUCCEEDED' END)
    SELECT stage, first.status AS first_status, 'SUCCEEDED' AS last_status, CASE stage WHEN 'lines' THEN (SELECT count(*) FROM lineitem) WHEN 'audit' THEN 1 ELSE (SELECT count(DISTINCT l_orderkey) FROM lineitem) END AS n FROM first""")
def staged_run(t):
    """A run whose optional audit fails at first, so that its report is skipped; the rerun makes these two alone."""
    spark, folder = t.spark, new_path(t.spark, "staged")

    def stages(limit: float) -> list[Stage]:
        too_much = F.when(F.max("l_quantity") > limit, F.raise_error(F.lit("a line has too much"))).otherwise(F.max("l_quantity"))
        return [
            Stage("lines", lambda r: t("lineitem").select("l_orderkey", "l_quantity")), Stage("totals", lambda r: r["lines"].groupBy("l_orderkey").agg(F.sum("l_quantity").alias("units")), ["lines"]),
            Stage("audit", lambda r: r["lines"].agg(too_much.alias("most")), ["lines"], optional=True), Stage("report", lambda r: r["totals"].crossJoin(r["audit"]), ["totals", "audit"]),
        ]

    run(spark, folder, "r1", stages(45.0))
    first = [(r.stage, r.status) for r in latest(spark, folder, "r1").collect() if r.stage != RUN]  # a row for each stage
    run(spark, folder, "r1", stages(1e9))
    kept = latest(spark, folder, "r1").where(F.col("stage") != RUN).select("stage", F.col("status").alias("last_status"))
    state = last_valid(spark, folder)
    counts = reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("stage"), "n") for name, df in state.items()])
    return spark.createDataFrame(first, "stage string, first_status string").join(kept, "stage").join(counts, "stage")


@query("a02_migrated_tables", """SELECT player, games, spent, 'v' || (games >= 3)::INTEGER AS tier, 3 AS schema_version, 'created,spent_renamed,tiers' AS applied, '' AS applied_again
    FROM (SELECT o_custkey AS player, count(*) AS games, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS spent FROM orders GROUP BY 1)""")
def migrated_tables(t):
    """A table created, changed and extended by three migrations in two calls; a third call applies nothing."""
    spark, folder = t.spark, new_path(t.spark, "migrations")
    created = Migration(1, "created", lambda _: {"players": t("orders").groupBy(F.col("o_custkey").alias("player")).agg(F.count("*").alias("games"), F.sum(F.round(F.col("o_totalprice") * 100)).alias("total")), "staging": t("orders").select("o_orderkey")})
    renamed = Migration(2, "spent_renamed", lambda now: {"players": now["players"].select("player", "games", F.col("total").cast("long").alias("spent")), "staging": None})
    tiers = Migration(3, "tiers", lambda now: {"players": now["players"].withColumn("tier", F.concat(F.lit("v"), (F.col("games") >= 3).cast("int").cast("string")))})
    applied = migrate(spark, folder, [created]) + migrate(spark, folder, [tiers, renamed, created])
    again = migrate(spark, folder, [created, renamed, tiers])
    version = log(spark, folder).agg(F.max("version")).first()[0]  # one row
    (name,) = now = tables(spark, folder)
    return now[name].select("*", F.lit(version).alias("schema_version"), F.lit(",".join(applied)).alias("applied"), F.lit(",".join(again)).alias("applied_again"))
