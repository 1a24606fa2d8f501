"""Protocols and remaining composed operators (survey D15, I20, J28-J29, J40, J44, J50, J55, J58, J64-J66, J75)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import distributions as D
from ..functions import exprs as X
from ..operators import evaluation as E
from ..operators.windows import beside, numbered
from .evaluating import PRED, predictions
from .registry import GAMES, LOG, query, r4


@query("d15_row_id_merge", "WITH a AS (SELECT doc_id AS id, length(text) AS n FROM documents), b AS (SELECT doc_id AS id, lang FROM documents) SELECT id, CAST(n AS INTEGER) AS n, lang FROM a JOIN b USING (id)")
def row_id_merge(t):
    d = t("documents")
    return d.select(F.col("doc_id").alias("id"), F.char_length("text").alias("n")).join(d.select(F.col("doc_id").alias("id"), "lang"), "id")


@query("i20_quantile_bins", f"WITH {GAMES}, r AS (SELECT game_id, season, row_number() OVER (PARTITION BY season ORDER BY units, game_id) AS k, count(*) OVER (PARTITION BY season) AS n FROM games) SELECT game_id, CAST(greatest(ceil((k - 1) * 10.0::DOUBLE / (n - 1)), 1) AS INTEGER) AS bin FROM r WHERE n > 1")
def quantile_bins(t):
    """Ten bins of first ranks by interpolated edges, right-closed."""
    g = t.games().select("game_id", "season", "units")
    size = g.groupBy("season").agg(F.count("*").alias("n"))
    r = beside(numbered(g, ["season"], "units", "game_id", "k"), size, ["season"]).where("n > 1")
    return r.select("game_id", F.greatest(F.ceil((F.col("k") - 1) * 10.0 / (F.col("n") - 1)), F.lit(1)).cast("int").alias("bin"))


@query("j28_availability_scenarios", f"WITH {LOG}, u AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') / count(*)::DOUBLE AS p FROM log GROUP BY 1) SELECT user_id, scenario, round(CASE scenario WHEN 'OUT' THEN p ELSE 1 - p END, 4) AS weight FROM (SELECT user_id, p, unnest(CASE WHEN p = 0 THEN ['PLAYS'] ELSE ['PLAYS', 'OUT'] END) AS scenario FROM u)")
def scenarios(t):
    u = t.log().groupBy("user_id").agg((F.count_if(F.col("event_type") == "error") / F.count("*")).alias("p"))
    branch = F.when(F.col("p") == 0, F.array(F.lit("PLAYS"))).otherwise(F.array(F.lit("PLAYS"), F.lit("OUT")))
    s = u.select("user_id", "p", F.explode(branch).alias("scenario"))
    return s.select("user_id", "scenario", r4(F.when(F.col("scenario") == "OUT", F.col("p")).otherwise(1 - F.col("p"))).alias("weight"))


@query("j29_hybrid_propagation", f"WITH {PRED} SELECT game_id, round(0.25::DOUBLE * q50 + 0.75::DOUBLE * p, 8) AS hybrid FROM pred")
def hybrid(t):
    return predictions(t).select("game_id", F.round(0.25 * F.col("q50") + 0.75 * F.col("p"), 8).alias("hybrid"))


@query("j40_candidate_pairs", "WITH t AS (SELECT l_orderkey, l_linenumber, l_quantity FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL)) SELECT a.l_orderkey, CAST(a.l_linenumber AS INTEGER) AS captain, CAST(b.l_linenumber AS INTEGER) AS sixth, 2 * a.l_quantity + b.l_quantity AS score FROM t a JOIN t b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber <> b.l_linenumber WHERE 2 * a.l_quantity + b.l_quantity > 140")
def candidate_pairs(t):
    """Role assignments within a roster of a few players: exploded arrays, no self-join."""
    own = t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q")).groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "q")).alias("m"))
    a = own.select("l_orderkey", F.explode("m").alias("a"), "m").select("l_orderkey", "a", F.explode("m").alias("b"))
    score = 2 * F.col("a.q") + F.col("b.q")
    return a.where((F.col("a.l_linenumber") != F.col("b.l_linenumber")) & (score > 140)).select("l_orderkey", F.col("a.l_linenumber").cast("int").alias("captain"), F.col("b.l_linenumber").cast("int").alias("sixth"), score.alias("score"))


@query("j50_run_evaluation", f"WITH {PRED} SELECT player_id, count(*) AS n, round(avg(abs(p - y)), 7) AS mae, round(max(y) - max(p), 4) AS top_gap FROM pred GROUP BY player_id")
def run_evaluation(t):
    return predictions(t).groupBy("player_id").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("p") - F.col("y"))), 7).alias("mae"), r4(F.max("y") - F.max("p")).alias("top_gap"))


@query("j55_monitoring", f"WITH {LOG} SELECT CAST(ts AS DATE) AS day, count(*) AS runs, count(*) FILTER (WHERE event_type = 'error') AS failed, round(avg(k), 4) AS mean_k, max(k) AS worst_k FROM log GROUP BY 1")
def monitoring(t):
    return t.log().groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("runs"), F.count_if(F.col("event_type") == "error").alias("failed"), r4(F.avg("k")).alias("mean_k"), F.max("k").alias("worst_k"))


@query("j58_rule_fingerprints", "WITH f AS (SELECT p_brand, p_type, sha256(string_agg(DISTINCT CAST(p_size AS VARCHAR), ',' ORDER BY CAST(p_size AS VARCHAR))) AS fp FROM part GROUP BY ALL) SELECT p_brand, count(*) AS rules, count(DISTINCT fp) AS versions, count(DISTINCT fp) = 1 AS compatible FROM f GROUP BY 1")
def rule_fingerprints(t):
    f = t("part").groupBy("p_brand", "p_type").agg(F.sha2(F.array_join(F.array_sort(F.collect_set(F.col("p_size").cast("string"))), ","), 256).alias("fp"))
    return f.groupBy("p_brand").agg(F.count("*").alias("rules"), F.count_distinct("fp").alias("versions"), (F.count_distinct("fp") == 1).alias("compatible"))


@query("j64_walk_forward_forecast", f"""WITH {PRED}, f AS (SELECT DISTINCT season AS fold FROM pred), m AS (SELECT fold, regr_slope(y, p) AS a, regr_intercept(y, p) AS b, count(*) AS n FROM f JOIN pred ON season < fold GROUP BY 1)
    SELECT fold, n AS n_train, count(*) AS n_test, round(avg(abs(a * p + b - y)), 4) AS mae FROM m JOIN pred ON season = fold GROUP BY ALL""")
def walk_forward(t):
    """A line fitted on all seasons before, judged on each season: moments of each season, summed over the seasons before."""
    p = predictions(t)
    moments = p.groupBy("season").agg(F.count("*").alias("n"), F.sum("p").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("p") * F.col("p")).alias("sxx"), F.sum(F.col("p") * F.col("y")).alias("sxy"))
    before = Window.orderBy("season").rowsBetween(Window.unboundedPreceding, -1)  # a row for each season
    s = moments.select(F.col("season").alias("fold"), *[F.sum(c).over(before).alias(c) for c in ("n", "sx", "sy", "sxx", "sxy")]).where("n is not null")
    slope = (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / (F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"))
    m = s.withColumn("a", slope).withColumn("b", (F.col("sy") - F.col("a") * F.col("sx")) / F.col("n"))
    j = p.join(F.broadcast(m), p["season"] == m["fold"])
    return j.groupBy("fold", F.col("n").alias("n_train")).agg(F.count("*").alias("n_test"), r4(F.avg(F.abs(F.col("a") * F.col("p") + F.col("b") - F.col("y")))).alias("mae"))


@query("j65_location_shift", f"WITH {PRED} SELECT game_id, [round(q10 + (p - q50), 4) + 0.0::DOUBLE, round(q50 + (p - q50), 4) + 0.0::DOUBLE, round(q90 + (p - q50), 4) + 0.0::DOUBLE] AS shifted FROM pred")  # + 0.0: no negative zero
def location_shift(t):
    q = F.array("q10", "q50", "q90")
    return predictions(t).select("game_id", F.transform(q, lambda x: F.round(x + (F.col("p") - F.col("q50")), 4)).alias("shifted"))


@query("j66_live_absence", f"WITH {GAMES}, m AS (SELECT season, priority, sum(units) FILTER (WHERE returned > 0) / sum(units) AS missing_rate, count(*) FILTER (WHERE returned = 0) AS depth, max(units) FILTER (WHERE returned = 0) / sum(units) FILTER (WHERE returned = 0) AS concentration FROM games GROUP BY ALL) SELECT game_id, round(missing_rate, 4) AS missing_rate, depth, round(concentration, 6) AS concentration FROM games JOIN m USING (season, priority)")
def live_absence(t):
    w = Window.partitionBy("season", "priority")
    out, own = F.when(F.col("returned") > 0, F.col("units")), F.when(F.col("returned") == 0, F.col("units"))
    return t.games().select("game_id", r4(X.ratio(F.sum(out).over(w), F.sum("units").over(w))).alias("missing_rate"), F.count(own).over(w).alias("depth"), F.round(X.ratio(F.max(own).over(w), F.sum(own).over(w)), 6).alias("concentration"))


@query("j75_mentions", "WITH n AS (SELECT n_name, lower(n_name) AS alias FROM nation WHERE length(n_name) >= 5), w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+'))) AS word FROM documents) SELECT doc_id, n_name FROM w JOIN n ON word = alias UNION SELECT page_id, r_name FROM (SELECT page_id, unnest(list_distinct(regexp_extract_all(lower(html), '[a-z]+'))) AS word FROM pages) JOIN region ON word = lower(r_name)")
def mentions(t):
    """Whole-word aliases found by an equi-join on words, not by a pattern for each alias and text."""
    words = lambda df, key, text, pattern: df.select(F.col(key).alias("doc_id"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0)))).alias("word"))
    n = t("nation").where("length(n_name) >= 5").select("n_name", F.lower("n_name").alias("word"))
    r = t("region").select(F.col("r_name").alias("n_name"), F.lower("r_name").alias("word"))
    return words(t("documents"), "doc_id", "text", "[a-z0-9_]+").join(n, "word").select("doc_id", "n_name").union(words(t("pages"), "page_id", "html", "[a-z]+").join(r, "word").select("doc_id", "n_name")).distinct()


@query("j22_competition_context", f"WITH {GAMES} SELECT game_id, CASE WHEN month(game_time) <= 3 THEN 'EARLY' WHEN month(game_time) <= 9 THEN 'REGULAR' ELSE 'PLAYOFF' END AS stage, CAST(row_number() OVER (PARTITION BY player_id, season ORDER BY game_time, game_id) AS INTEGER) AS game_number FROM games")
def competition(t):
    m = F.month("game_time")
    return t.games().select("game_id", F.when(m <= 3, "EARLY").when(m <= 9, "REGULAR").otherwise("PLAYOFF").alias("stage"), F.row_number().over(Window.partitionBy("player_id", "season").orderBy("game_time", "game_id")).alias("game_number"))


@query("e25_near_duplicate_columns", "SELECT a, b, round(r, 3) AS r FROM (SELECT 'l_extendedprice' AS a, 'l_quantity' AS b, corr(l_extendedprice, l_quantity) AS r FROM lineitem UNION ALL SELECT 'double_quantity', 'l_quantity', corr(2 * l_quantity + 1, l_quantity) FROM lineitem) WHERE abs(r) >= 0.98")
def near_duplicates(t):
    line = t("lineitem").withColumn("double_quantity", 2 * F.col("l_quantity") + 1)
    pairs = (("l_extendedprice", "l_quantity"), ("double_quantity", "l_quantity"))
    c = line.agg(*[E.correlation(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(f"r{i}", 3).alias("r")) for i, (a, b) in enumerate(pairs)])
    return c.select(F.explode(rows).alias("x")).select("x.*").where(F.abs("r") >= 0.98)


