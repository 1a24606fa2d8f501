"""Aggregations (survey E)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.exprs import ratio
from ..operators import evaluation as E
from ..operators.windows import top_k
from .registry import GAMES, LOG, query, r4


@query("e01_group_by", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, count(*) AS n, round(avg(l_discount), 4) AS avg_disc, min(l_tax) AS low_tax, max(l_tax) AS high_tax FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY ALL")
def group_by(t):
    return t("lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02 00:00:00'").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("qty"), F.count("*").alias("n"), r4(F.avg("l_discount")).alias("avg_disc"), F.min("l_tax").alias("low_tax"), F.max("l_tax").alias("high_tax"))


@query("e02_group_by_all", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def group_by_all(t):
    t("orders").createOrReplaceTempView("orders_e02")
    return t.spark.sql("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders_e02 GROUP BY ALL")


@query("e03_filtered_aggregates", "SELECT l_suppkey, sum(l_quantity) FILTER (WHERE l_returnflag = 'R') AS returned, count(*) FILTER (WHERE l_discount > 0.05) AS n_disc, max(l_quantity) FILTER (WHERE l_linestatus = 'O') AS top_open FROM lineitem GROUP BY l_suppkey")
def filtered(t):
    return t("lineitem").groupBy("l_suppkey").agg(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))).alias("returned"), F.count_if(F.col("l_discount") > 0.05).alias("n_disc"), F.max(F.when(F.col("l_linestatus") == "O", F.col("l_quantity"))).alias("top_open"))


@query("e04_conditional_sums", "SELECT user_id, CAST(sum(CAST(event_type = 'click' AS INTEGER)) AS BIGINT) AS clicks, CAST(sum(CAST(event_type = 'error' AS INTEGER)) AS BIGINT) AS errors FROM events GROUP BY user_id")
def conditional(t):
    return t("events").groupBy("user_id").agg(*[F.sum(F.when(F.col("event_type") == k, 1).otherwise(0)).alias(a) for k, a in (("click", "clicks"), ("error", "errors"))])


@query("e05_count_distinct", "SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_custkey) FILTER (WHERE o_orderstatus = 'F') AS with_f FROM orders GROUP BY 1")
def distinct(t):
    return t("orders").groupBy("o_orderpriority").agg(F.count_distinct("o_custkey").alias("customers"), F.count_distinct(F.when(F.col("o_orderstatus") == "F", F.col("o_custkey"))).alias("with_f"))


@query("e06_having_duplicates", "SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def having(t):
    return t("lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n")).where("n > 1")


@query("e07_arg_max", f"WITH {LOG} SELECT user_id, arg_max(k, (value, event_id)) FILTER (WHERE k IS NOT NULL) AS k_of_best, arg_max(event_type, (ts, event_id)) AS last_type FROM log GROUP BY user_id")
def arg_max(t):
    return t.log().groupBy("user_id").agg(F.max_by("k", F.when(F.col("k").isNotNull(), F.struct("value", "event_id"))).alias("k_of_best"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"))


@query("e08_any_value_bool_or", "SELECT o_custkey, min(o_orderstatus) AS some_status, bool_or(o_orderstatus = 'P') AS any_p, bool_and(o_totalprice > 1000) AS all_large FROM orders GROUP BY 1")
def bools(t):
    return t("orders").groupBy("o_custkey").agg(F.min("o_orderstatus").alias("some_status"), F.bool_or(F.col("o_orderstatus") == "P").alias("any_p"), F.bool_and(F.col("o_totalprice") > 1000).alias("all_large"))


@query("e10_distinct_lists", "SELECT l_suppkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags, list_sort(list(DISTINCT l_linestatus)) AS states FROM lineitem GROUP BY 1")
def lists(t):
    return t("lineitem").groupBy("l_suppkey").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("flags"), F.array_sort(F.collect_set("l_linestatus")).alias("states"))


@query("e11_median_stddev", "SELECT l_suppkey, median(l_quantity) AS med, round(stddev_samp(l_quantity), 4) AS std FROM lineitem GROUP BY 1")
def median(t):
    return t("lineitem").groupBy("l_suppkey").agg(F.percentile("l_quantity", 0.5).alias("med"), r4(F.stddev_samp("l_quantity")).alias("std"))


@query("e13_ratio_of_sums", "SELECT l_suppkey, round(sum(l_quantity) FILTER (WHERE l_returnflag = 'R') / nullif(sum(l_quantity), 0), 4) AS return_rate FROM lineitem GROUP BY 1")
def ratio_of_sums(t):
    return t("lineitem").groupBy("l_suppkey").agg(r4(ratio(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))), F.sum("l_quantity"))).alias("return_rate"))


@query("e14_entropy_herfindahl", f"WITH {GAMES}, s AS (SELECT player_id, units / sum(units) OVER (PARTITION BY player_id) AS p FROM games) SELECT player_id, round(0 - sum(p * ln(p)) FILTER (WHERE p > 0), 4) AS entropy, round(sum(p * p), 4) AS hhi FROM s GROUP BY 1")
def entropy(t):
    p = F.col("units") / F.sum("units").over(Window.partitionBy("player_id"))
    return t.games().select("player_id", p.alias("p")).groupBy("player_id").agg(r4(E.entropy(F.col("p"))).alias("entropy"), r4(E.herfindahl(F.col("p"))).alias("hhi"))


@query("e15_top_k_share", f"WITH {GAMES}, r AS (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY units DESC, game_id) AS k FROM games) SELECT player_id, round(sum(units) FILTER (WHERE k <= 3) / sum(units), 4) AS top3, round(sum(units) FILTER (WHERE k = 1) / sum(units), 4) AS top1 FROM r GROUP BY 1")
def top_share(t):
    k = F.row_number().over(Window.partitionBy("player_id").orderBy(F.desc("units"), "game_id"))
    r = t.games().withColumn("k", k)
    return r.groupBy("player_id").agg(r4(F.sum(F.when(F.col("k") <= 3, F.col("units"))) / F.sum("units")).alias("top3"), r4(F.sum(F.when(F.col("k") == 1, F.col("units"))) / F.sum("units")).alias("top1"))


@query("e16_two_levels", f"WITH {GAMES}, m AS (SELECT player_id, season, sum(units) AS u FROM games GROUP BY ALL) SELECT season, count(*) AS players, round(avg(u), 4) AS mean_units, max(u) AS top FROM m GROUP BY season")
def two_levels(t):
    m = t.games().groupBy("player_id", "season").agg(F.sum("units").alias("u"))
    return m.groupBy("season").agg(F.count("*").alias("players"), r4(F.avg("u")).alias("mean_units"), F.max("u").alias("top"))


@query("e17_totals_rollup", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup(t):
    return t("lineitem").rollup("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("qty"), F.count("*").alias("n"))


@query("e17_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube(t):
    return t("orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("e18_scalar_subqueries", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS n_f FROM customer")
def scalars(t):
    o = t("orders").groupBy("o_custkey").agg(F.count("*").alias("n_orders"), F.count_if(F.col("o_orderstatus") == "F").alias("n_f"))
    return t("customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n_orders", F.lit(0).cast("long")).alias("n_orders"), F.coalesce("n_f", F.lit(0).cast("long")).alias("n_f"))


@query("e21_quantiles", "SELECT l_returnflag, quantile_cont(l_quantity, 0.1) AS q10, quantile_cont(l_quantity, 0.5) AS q50, quantile_cont(l_quantity, 0.9) AS q90 FROM lineitem GROUP BY 1")
def quantiles(t):
    q = F.percentile("l_quantity", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    return t("lineitem").groupBy("l_returnflag").agg(q.alias("q")).select("l_returnflag", *[F.col("q")[i].alias(n) for i, n in enumerate(("q10", "q50", "q90"))])


@query("e22_order_statistic_quantile", f"WITH {GAMES}, r AS (SELECT player_id, units, row_number() OVER (PARTITION BY player_id ORDER BY units) AS k, count(*) OVER (PARTITION BY player_id) AS n FROM games) SELECT player_id, max(units) FILTER (WHERE k = least(n, greatest(1, ceil((n + 1) * 0.8)))) AS q80 FROM r GROUP BY 1")
def order_quantile(t):
    return E.order_quantile(t.games().select("player_id", "units"), ["player_id"], "units", 0.8, "q80")


@query("e24_missing_rates", f"WITH {LOG} SELECT event_type, round(avg(CAST(k IS NULL AS INTEGER)), 4) AS k_missing, round(avg(CAST(value IS NULL AS INTEGER)), 4) AS value_missing, count(*) AS n FROM log GROUP BY 1")
def missing(t):
    return t.log().groupBy("event_type").agg(*[r4(F.avg(F.col(c).isNull().cast("int"))).alias(f"{c}_missing") for c in ("k", "value")], F.count("*").alias("n"))


@query("e24_season_stability", f"WITH {GAMES}, m AS (SELECT season, stat, avg(v) AS mean FROM (SELECT season, 'units' AS stat, units AS v FROM games UNION ALL SELECT season, 'n_lines', n_lines FROM games UNION ALL SELECT season, 'returned', returned FROM games) GROUP BY ALL) SELECT stat, count(*) AS seasons, round(avg(mean), 4) AS mean, round(stddev_samp(mean), 4) AS std FROM m GROUP BY 1")
def stability(t):
    long = t.games().select("season", F.col("units").cast("double").alias("units"), F.col("n_lines").cast("double").alias("n_lines"), F.col("returned").cast("double").alias("returned")).unpivot("season", ["units", "n_lines", "returned"], "stat", "v")
    return long.groupBy("season", "stat").agg(F.avg("v").alias("mean")).groupBy("stat").agg(F.count("*").alias("seasons"), r4(F.avg("mean")).alias("mean"), r4(F.stddev_samp("mean")).alias("std"))


@query("e25_correlations", "SELECT round(corr(l_quantity, l_extendedprice), 4) AS qty_price, round(corr(l_quantity, l_discount), 4) AS qty_disc, round(corr(l_discount, l_tax), 4) AS disc_tax FROM lineitem")
def correlations(t):
    pairs = (("l_quantity", "l_extendedprice", "qty_price"), ("l_quantity", "l_discount", "qty_disc"), ("l_discount", "l_tax", "disc_tax"))
    return t("lineitem").agg(*[r4(E.correlation(a, b)).alias(n) for a, b, n in pairs])


@query("e25_duplicate_columns", "SELECT 'l_quantity' AS a, 'l_quantity_copy' AS b, bool_and(l_quantity IS NOT DISTINCT FROM q2) AS same FROM (SELECT l_quantity, l_quantity * 1.0::DOUBLE AS q2, l_tax FROM lineitem) UNION ALL SELECT 'l_quantity', 'l_tax', bool_and(l_quantity IS NOT DISTINCT FROM l_tax) FROM lineitem")
def duplicate_columns(t):
    """Columns with equal signatures (an order-free hash sum) hold the same values."""
    sig = lambda c: F.sum(F.pmod(F.xxhash64("l_orderkey", "l_linenumber", c), F.lit(1 << 31)))
    s = t("lineitem").withColumn("l_quantity_copy", F.col("l_quantity") * 1.0).agg(*[sig(c).alias(c) for c in ("l_quantity", "l_quantity_copy", "l_tax")])
    rows = [F.struct(F.lit("l_quantity").alias("a"), F.lit(b).alias("b"), (F.col("l_quantity") == F.col(b)).alias("same")) for b in ("l_quantity_copy", "l_tax")]
    return s.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


@query("e26_cluster_bootstrap")
def bootstrap(t):
    g = t.games().select("player_id", "returned", "n_lines")
    return E.bootstrap_ratio(g, "player_id", "returned", "n_lines", 200).agg(F.count("*").alias("replicates"), r4(F.avg("ratio")).alias("mean"), r4(F.percentile("ratio", 0.025)).alias("low"), r4(F.percentile("ratio", 0.975)).alias("high"))


@query("e27_pivot", "SELECT user_id, CAST(coalesce(count(*) FILTER (WHERE event_type = 'view'), 0) AS BIGINT) AS view, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'purchase') AS purchase FROM events GROUP BY user_id")
def pivot(t):
    return t("events").groupBy("user_id").pivot("event_type", ["view", "click", "purchase"]).agg(F.count(F.lit(1))).na.fill(0, ["view", "click", "purchase"])


@query("e28_decayed_mean", "WITH m AS (SELECT max(ts) AS now FROM events) SELECT user_id, round(sum(value * pow(2, -((epoch_us(now) - epoch_us(ts)) / 86400000000.0::DOUBLE) / 21)) / sum(pow(2, -((epoch_us(now) - epoch_us(ts)) / 86400000000.0::DOUBLE) / 21)), 4) AS decayed FROM events, m WHERE value IS NOT NULL GROUP BY user_id")
def decayed(t):
    e = t("events").where("value is not null").select("user_id", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    w = F.pow(F.lit(2.0), -((F.col("now") - F.col("us")) / 86_400_000_000.0) / 21)
    now = t("events").agg(F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("now"))
    return e.crossJoin(F.broadcast(now)).groupBy("user_id").agg(r4(F.sum(F.col("value") * w) / F.sum(w)).alias("decayed"))


@query("e30_transform_total", f"WITH {GAMES} SELECT game_id, sum(units) OVER (PARTITION BY player_id) AS total, CAST(count(*) OVER (PARTITION BY player_id) AS BIGINT) AS n FROM games")
def transform(t):
    w = Window.partitionBy("player_id")
    return t.games().select("game_id", F.sum("units").over(w).alias("total"), F.count("*").over(w).alias("n"))


@query("e31_season_averages_top", f"WITH {GAMES} SELECT player_id, season, count(*) AS games, round(avg(units), 1) AS avg_units, max(units) AS best FROM games GROUP BY ALL ORDER BY avg(units) DESC, player_id, season LIMIT 500")
def season_averages(t):
    g = t.games().groupBy("player_id", "season").agg(F.count("*").alias("games"), F.avg("units").alias("u"), F.max("units").alias("best"))
    return g.orderBy(F.desc("u"), "player_id", "season").limit(500).select("player_id", "season", "games", F.round("u", 1).alias("avg_units"), "best")


@query("e32_reasons_joined", "SELECT l_suppkey, string_agg(DISTINCT reason, '|' ORDER BY reason) AS reasons FROM (SELECT l_suppkey, CASE WHEN l_discount > 0.09 THEN 'deep_discount' WHEN l_quantity > 45 THEN 'bulk' WHEN l_tax = 0 THEN 'no_tax' END AS reason FROM lineitem) WHERE reason IS NOT NULL GROUP BY 1")
def reasons(t):
    reason = F.when(F.col("l_discount") > 0.09, "deep_discount").when(F.col("l_quantity") > 45, "bulk").when(F.col("l_tax") == 0, "no_tax")
    return t("lineitem").withColumn("reason", reason).where("reason is not null").groupBy("l_suppkey").agg(F.array_join(F.array_sort(F.collect_set("reason")), "|").alias("reasons"))


@query("e33_status_counts", "SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS errors, CAST(max(epoch_us(ts)) AS BIGINT) AS newest_us, arg_max(event_type, (ts, event_id)) AS newest FROM events GROUP BY 1")
def status_counts(t):
    return t("events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("newest_us"), F.max_by("event_type", F.struct("ts", "event_id")).alias("newest"))


@query("e34_alerts", f"""WITH {GAMES}, r AS (SELECT player_id, units, row_number() OVER (PARTITION BY player_id ORDER BY game_time DESC, game_id DESC) AS k FROM games),
    a AS (SELECT player_id, quantile_cont(units, 0.5) FILTER (WHERE k > 5) AS thr, min(units) FILTER (WHERE k <= 5) AS low, count(*) AS n FROM r GROUP BY 1) SELECT player_id, thr, low FROM a WHERE n >= 10 AND low > thr""")
def alerts(t):
    k = F.row_number().over(Window.partitionBy("player_id").orderBy(F.desc("game_time"), F.desc("game_id")))
    r = t.games().withColumn("k", k)
    a = r.groupBy("player_id").agg(F.percentile(F.when(F.col("k") > 5, F.col("units")), 0.5).alias("thr"), F.min(F.when(F.col("k") <= 5, F.col("units"))).alias("low"), F.count("*").alias("n"))
    return a.where("n >= 10 and low > thr").select("player_id", "thr", "low")


@query("e29_ranking_capture", f"WITH {GAMES}, r AS (SELECT season, row_number() OVER (PARTITION BY season ORDER BY units DESC, game_id) AS a, row_number() OVER (PARTITION BY season ORDER BY price DESC, game_id) AS b, count(*) OVER (PARTITION BY season) AS n FROM games) SELECT count(*) FILTER (WHERE a <= 10 AND b <= 20) AS hits, count(*) FILTER (WHERE a <= 10) AS available FROM r WHERE n >= 10")
def capture(t):
    return E.capture(t.games(), ["season"], "units", "price", "game_id", 10, 20, least=10)


@query("a26_value_histogram", "SELECT event_type, n FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1) ORDER BY n DESC, event_type LIMIT 25")
def histogram(t):
    return t("events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type").limit(25)


@query("g04_n_largest", f"WITH {GAMES} SELECT season, game_id FROM games QUALIFY row_number() OVER (PARTITION BY season ORDER BY price DESC, game_id) <= 10")
def n_largest(t):
    return top_k(t.games(), ["season"], [F.desc("price"), F.col("game_id")], 10).select("season", "game_id")
