"""Integrity checks (survey M) and diagnostics of sources (J57, J67-J72)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import quality as Q
from .registry import GAMES, query, r4


@query("m01_unique_keys", "SELECT 'orders' AS check, count(*) AS violations FROM (SELECT 1 FROM orders GROUP BY o_orderkey HAVING count(*) > 1) UNION ALL SELECT 'lineitem', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) UNION ALL SELECT 'part_supplier', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_partkey, l_suppkey HAVING count(*) > 1)")
def unique_keys(t):
    line = t("lineitem")
    return Q.report(Q.duplicates("orders", t("orders"), ["o_orderkey"]), Q.duplicates("lineitem", line, ["l_orderkey", "l_linenumber"]), Q.duplicates("part_supplier", line, ["l_partkey", "l_suppkey"]))


@query("m02_ranges", "SELECT unnest(['quantity', 'discount', 'tax', 'flags']) AS check, unnest([count(*) FILTER (WHERE l_quantity <= 0), count(*) FILTER (WHERE l_discount NOT BETWEEN 0 AND 0.08), count(*) FILTER (WHERE l_tax < 0.01), count(*) FILTER (WHERE l_returnflag NOT IN ('A', 'R'))]) AS violations FROM lineitem")
def ranges(t):
    return Q.many(t("lineitem"), {"quantity": F.col("l_quantity") <= 0, "discount": ~F.col("l_discount").between(0, 0.08), "tax": F.col("l_tax") < 0.01, "flags": ~F.col("l_returnflag").isin("A", "R")})


@query("m03_participants", "SELECT 'supplier_region' AS check, count(*) AS violations FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE s_nationkey NOT IN (c_nationkey, (c_nationkey + 1) % 25)")
def participants(t):
    j = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return Q.breaks("supplier_region", j, (F.col("s_nationkey") != F.col("c_nationkey")) & (F.col("s_nationkey") != (F.col("c_nationkey") + 1) % 25))


@query("m04_cardinality", "SELECT 'four_lines' AS check, count(*) AS violations FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey HAVING count(*) <> 4)")
def cardinality(t):
    return Q.cardinality("four_lines", t("lineitem"), ["l_orderkey"], 4)


@query("m05_reconciliation", "SELECT 'order_total' AS check, count(*) AS violations FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE abs(o_totalprice - s) > 1000")
def reconciliation(t):
    return Q.unreconciled("order_total", t("orders"), "o_orderkey", "o_totalprice", t("lineitem"), "l_orderkey", "l_extendedprice", 1000)


@query("m06_formats", "SELECT 'segment' AS check, count(*) FILTER (WHERE NOT regexp_matches(c_mktsegment, '^[A-Z]+$')) AS violations FROM customer UNION ALL SELECT 'url', count(*) FILTER (WHERE NOT regexp_matches(url, '^https?://[^/]+/[a-z]{2}/')) FROM pages")
def formats(t):
    return Q.report(Q.breaks("segment", t("customer"), ~F.col("c_mktsegment").rlike("^[A-Z]+$")), Q.breaks("url", t("pages"), ~F.col("url").rlike("^https?://[^/]+/[a-z]{2}/")))


@query("m07_temporal", "SELECT 'ship_before_order' AS check, count(*) AS violations FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate")
def temporal(t):
    return Q.breaks("ship_before_order", t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")), F.col("l_shipdate") < F.col("o_orderdate"))


def _between(level):
    """An interpolated quantile of the sorted list v; quantile_cont leaves the value by a rounding where both neighbours are equal."""
    at = f"((len(v) - 1) * {level}::DOUBLE)"
    low, high = f"v[floor({at})::BIGINT + 1]", f"v[ceil({at})::BIGINT + 1]"
    return f"CASE WHEN {low} = {high} THEN {low} ELSE (ceil({at}) - {at}) * {low} + ({at} - floor({at})) * {high} END"


@query("m08_monotone", f"WITH {GAMES}, l AS (SELECT player_id, list(units ORDER BY units) FILTER (WHERE units IS NOT NULL) AS v FROM games GROUP BY 1), q AS (SELECT player_id, {_between(0.1)} AS a, {_between(0.5)} AS b, {_between(0.9)} AS c FROM l) SELECT 'monotone_quantiles' AS check, count(*) FILTER (WHERE (a <= b AND b <= c) IS DISTINCT FROM true) AS violations FROM q")
def monotone(t):
    q = t.games().groupBy("player_id").agg(F.percentile("units", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("q"))
    return Q.breaks("monotone_quantiles", q, ~((F.col("q")[0] <= F.col("q")[1]) & (F.col("q")[1] <= F.col("q")[2])).eqNullSafe(F.lit(True)))


@query("m09_references", "SELECT 'order_customer' AS check, count(*) AS violations FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'line_order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'label_document', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def references(t):
    return Q.report(Q.orphans("order_customer", t("orders"), t("customer"), "o_custkey", "c_custkey"), Q.orphans("line_order", t("lineitem"), t("orders"), "l_orderkey", "o_orderkey"), Q.orphans("label_document", t("labels"), t("documents"), "doc_id", "doc_id"))


@query("m10_versions_agree", "SELECT 'chars' AS check, count(*) FILTER (WHERE n_chars IS DISTINCT FROM length(text)) AS violations FROM documents")
def versions(t):
    return Q.breaks("chars", t("documents"), ~F.col("n_chars").eqNullSafe(F.char_length("text").cast("long")))


@query("m11_json_contents", "SELECT 'props_k' AS check, count(*) FILTER (WHERE TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) IS NULL OR TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) > 90) AS violations FROM events")
def json_contents(t):
    k = F.get_json_object("props", "$.k").try_cast("int")
    return Q.breaks("props_k", t("events"), k.isNull() | (k > 90))


@query("m13_cutoff_leaks", "SELECT 'history' AS check, count(*) AS violations FROM (SELECT o_orderdate, max(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM orders) WHERE newest >= o_orderdate")
def cutoff(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, -1)
    return Q.breaks("history", t("orders").withColumn("newest", F.max("o_orderdate").over(w)), F.col("newest") >= F.col("o_orderdate"))


@query("m14_missingness", "SELECT unnest(['text', 'lang', 'source']) AS check, unnest([count(*) FILTER (WHERE text IS NULL), count(*) FILTER (WHERE lang IS NULL), count(*) FILTER (WHERE source IS NULL)]) AS violations FROM documents")
def missingness(t):
    return Q.many(t("documents"), {c: F.col(c).isNull() for c in ("text", "lang", "source")})


@query("j67_coverage_matrix", f"""WITH {GAMES}, l AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT season, count(*) AS orders, count(*) FILTER (WHERE l.n > 0) AS with_lines, CAST(sum(coalesce(l.n, 0)) AS BIGINT) AS lines FROM (SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS season FROM orders) o LEFT JOIN l ON l_orderkey = o_orderkey GROUP BY 1""")
def coverage(t):
    l = t("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    o = t("orders").select("o_orderkey", F.year("o_orderdate").alias("season")).join(l, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.groupBy("season").agg(F.count("*").alias("orders"), F.count_if(F.col("n") > 0).alias("with_lines"), F.sum(F.coalesce("n", F.lit(0))).alias("lines"))


@query("j68_transfers", f"WITH {GAMES}, s AS (SELECT player_id, season, count(DISTINCT priority) AS p FROM games GROUP BY ALL HAVING count(DISTINCT priority) > 1) SELECT season, count(*) AS players, max(p) AS most FROM s GROUP BY 1")
def transfers(t):
    s = t.games().groupBy("player_id", "season").agg(F.count_distinct("priority").alias("p")).where("p > 1")
    return s.groupBy("season").agg(F.count("*").alias("players"), F.max("p").alias("most"))


@query("j69_price_progression", f"WITH {GAMES}, n AS (SELECT player_id, units, season, lead(units) OVER w AS next_units, lead(season) OVER w AS next_season FROM (SELECT player_id, season, sum(units) AS units FROM games GROUP BY ALL) WINDOW w AS (PARTITION BY player_id ORDER BY season)) SELECT season, count(*) AS pairs, round(avg(CAST(next_units >= units AS INTEGER)), 4) AS up_rate FROM n WHERE next_season = season + 1 GROUP BY 1")
def progression(t):
    n = t.games().groupBy("player_id", "season").agg(F.sum("units").alias("units"))
    w = Window.partitionBy("player_id").orderBy("season")
    n = n.withColumns({"next_units": F.lead("units").over(w), "next_season": F.lead("season").over(w)}).where("next_season = season + 1")
    return n.groupBy("season").agg(F.count("*").alias("pairs"), r4(F.avg((F.col("next_units") >= F.col("units")).cast("int"))).alias("up_rate"))


@query("j70_source_agreement", "SELECT count(*) AS shared, round(avg(CAST(a.event_type IS NOT DISTINCT FROM b.event_type AS INTEGER)), 4) AS type_rate FROM (SELECT user_id, min_by(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1) a JOIN (SELECT user_id, max_by(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1) b USING (user_id)")
def agreement(t):
    g = t("events").groupBy("user_id").agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("a"), F.max_by("event_type", F.struct("ts", "event_id")).alias("b"))
    return g.agg(F.count("*").alias("shared"), r4(F.avg(F.col("a").eqNullSafe(F.col("b")).cast("int"))).alias("type_rate"))


@query("j71_order_diagnostics", "SELECT user_id, count(*) AS n, max(event_id) - min(event_id) + 1 - count(DISTINCT event_id) AS number_gaps, count(*) - count(DISTINCT ts) AS same_time FROM events GROUP BY 1")
def diagnostics(t):
    return t("events").groupBy("user_id").agg(F.count("*").alias("n"), (F.max("event_id") - F.min("event_id") + 1 - F.count_distinct("event_id")).alias("number_gaps"), (F.count("*") - F.count_distinct("ts")).alias("same_time"))


@query("j72_co_occurrence", "WITH h AS (SELECT user_id, CAST(ts AS DATE) AS d, bool_or(event_type = 'error') AS err, bool_or(event_type = 'purchase') AS buy FROM events GROUP BY ALL) SELECT count(*) AS days, count(*) FILTER (WHERE err AND buy) AS both, count(*) FILTER (WHERE err) AS errors FROM h")
def co_occurrence(t):
    h = t("events").groupBy("user_id", F.to_date("ts").alias("d")).agg(F.bool_or(F.col("event_type") == "error").alias("err"), F.bool_or(F.col("event_type") == "purchase").alias("buy"))
    return h.agg(F.count("*").alias("days"), F.count_if(F.col("err") & F.col("buy")).alias("both"), F.count_if("err").alias("errors"))


@query("j57_scoring_validation", f"WITH {GAMES} SELECT season, count(*) AS n, count(*) FILTER (WHERE abs(units - price / 3000) < 20) AS close, count(*) FILTER (WHERE price IS NULL) AS missing FROM games GROUP BY 1")
def scoring_validation(t):
    return t.games().groupBy("season").agg(F.count("*").alias("n"), F.count_if(F.abs(F.col("units") - F.col("price") / 3000) < 20).alias("close"), F.count_if(F.col("price").isNull()).alias("missing"))
