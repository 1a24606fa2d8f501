"""Filters, joins, sorts and set operations (survey C, D, G, H)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import all_of, differs, finite, normal_text
from ..operators.windows import numbered
from .registry import GAMES, LOG, SIDES, query, r4


@query("c01_code_range", f"WITH {GAMES} SELECT game_id FROM games WHERE 'E' || season BETWEEN 'E1996' AND 'E1998'")
def code_range(t):
    return t.games().where(F.concat(F.lit("E"), F.col("season").cast("string")).between("E1996", "E1998")).select("game_id")


@query("c02_membership", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
def membership(t):
    return t("orders").where(F.col("o_orderstatus").isin("F", "P") & ~F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey")


@query("c03_list_semi_join", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 7)")
def list_semi(t):
    return t("lineitem").join(t("part").where("p_size = 7"), F.col("l_partkey") == F.col("p_partkey"), "left_semi").select("l_orderkey", "l_linenumber")


@query("c04_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def exists(t):
    return t("customer").join(t("orders").where("o_totalprice > 200000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("c05_not_exists", "SELECT s_suppkey FROM supplier WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49 AND l_returnflag = 'R' AND l_discount > 0.08)")
def not_exists(t):
    return t("supplier").join(t("lineitem").where("l_quantity > 49 and l_returnflag = 'R' and l_discount > 0.08"), F.col("s_suppkey") == F.col("l_suppkey"), "left_anti").select("s_suppkey")


@query("c06_text_search", "SELECT p_partkey FROM part WHERE lower(concat_ws(' ', p_name, p_brand, p_type)) LIKE '%steel%'")
def search(t):
    return t("part").where(F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type")).contains("steel")).select("p_partkey")


@query("c07_is_distinct_from", f"WITH {LOG} SELECT event_id FROM log WHERE k IS DISTINCT FROM CAST(floor(value) AS INTEGER) AND (k > 50) IS DISTINCT FROM true")
def distinct_from(t):
    return t.log().where(differs("k", F.floor("value").cast("int")) & differs(F.col("k") > 50, F.lit(True))).select("event_id")


@query("c08_regex", "SELECT page_id FROM pages WHERE regexp_matches(url, '^https://[a-z]+[.]example[.](com|org)/')")
def regex(t):
    return t("pages").where(F.col("url").rlike("^https://[a-z]+[.]example[.](com|org)/")).select("page_id")


@query("c09_dynamic_filters", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderdate >= TIMESTAMP '1997-01-01 00:00:00' AND o_totalprice < 100000")
def dynamic(t):
    """A filter map: absent values add no condition."""
    wanted = {"status": "O", "from": "1997-01-01", "to": None, "below": 100000, "text": None}
    make = {"status": lambda v: F.col("o_orderstatus") == v, "from": lambda v: F.col("o_orderdate") >= F.lit(v).cast("timestamp_ntz"), "to": lambda v: F.col("o_orderdate") < F.lit(v).cast("timestamp_ntz"), "below": lambda v: F.col("o_totalprice") < v, "text": lambda v: F.col("o_orderpriority").contains(v)}
    return t("orders").where(all_of(make[k](v) for k, v in wanted.items() if v is not None)).select("o_orderkey")


@query("c10_null_tolerant_scope", f"WITH {LOG}, s AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE k % 5 END AS scope FROM log) SELECT event_id FROM s WHERE scope IS NULL OR scope = 2")
def scope(t):
    s = t.log().withColumn("scope", F.when(F.col("event_id") % 3 == 0, None).otherwise(F.col("k") % 5))
    return s.where(F.col("scope").isNull() | (F.col("scope") == 2)).select("event_id")


@query("c11_expiry", "SELECT event_id FROM events WHERE ts + INTERVAL 12 HOUR > TIMESTAMP '2024-01-20 00:00:00' AND ts <= TIMESTAMP '2024-01-20 00:00:00'")
def expiry(t):
    at = F.expr("timestamp_ntz'2024-01-20 00:00:00'")
    return t("events").where((F.col("ts") + F.expr("INTERVAL 12 HOURS") > at) & (F.col("ts") <= at)).select("event_id")


@query("c12_finite", "SELECT event_id FROM events WHERE isfinite(value) AND NOT isnan(value)")
def finite_only(t):
    return t("events").where(finite("value")).select("event_id")


@query("c13_group_size", f"WITH {GAMES} SELECT game_id FROM games QUALIFY count(*) OVER (PARTITION BY player_id) >= 12")
def group_size(t):
    return t.games().withColumn("n", F.count("*").over(Window.partitionBy("player_id"))).where("n >= 12").select("game_id")


@query("c14_latest_batch", "SELECT event_id FROM events WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events)")
def latest_batch(t):
    e = t("events")
    return e.join(F.broadcast(e.agg(F.max(F.to_date("ts")).alias("d"))), F.to_date("ts") == F.col("d"), "left_semi").select("event_id")  # one row


@query("d01_inner_using", "SELECT l_orderkey, l_linenumber, n_name, r_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def inner(t):
    dims = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return t("lineitem").join(dims, F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "l_linenumber", "n_name", "r_name")


_SN = "SELECT player_id, season, sum(units) AS u FROM games GROUP BY ALL"


@query("d02_multi_key", f"WITH {GAMES}, s AS ({_SN}) SELECT g.game_id, a.u AS own, b.u AS before FROM games g JOIN s a ON a.player_id = g.player_id AND a.season = g.season JOIN s b ON b.player_id = g.player_id AND b.season = g.season - 1")
def multi_key(t):
    g = t.games()
    s = g.groupBy("player_id", "season").agg(F.sum("units").alias("u"))
    a, b = s.withColumnRenamed("u", "own"), s.select("player_id", (F.col("season") + 1).alias("season"), F.col("u").alias("before"))
    return g.join(a, ["player_id", "season"]).join(b, ["player_id", "season"]).select("game_id", "own", "before")


@query("d03_left_attach", "SELECT doc_id, quality, toxic, quality IS NOT NULL AS labelled FROM documents LEFT JOIN labels USING (doc_id)")
def left_attach(t):
    return t("documents").join(t("labels"), "doc_id", "left").select("doc_id", "quality", "toxic", F.col("quality").isNotNull().alias("labelled"))


@query("d04_opponent_pairing", f"WITH {SIDES} SELECT a.game_id, a.side, b.points AS allowed, a.points - b.points AS margin FROM sides a JOIN sides b ON a.game_id = b.game_id AND a.side <> b.side")
def pairing(t):
    """The other side's values from one window over the game: no self-join."""
    w = Window.partitionBy("game_id")
    s = t.sides().withColumns({"all": F.sum("points").over(w), "n": F.count("*").over(w)}).where("n = 2")
    return s.select("game_id", "side", (F.col("all") - F.col("points")).alias("allowed"), (2 * F.col("points") - F.col("all")).alias("margin"))


@query("d11_either_key", "SELECT e.event_id, c.n FROM events e JOIN (SELECT user_id AS u, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1) c ON e.user_id = c.u OR e.event_id % 150 = c.u WHERE e.event_type = 'purchase'")
def either_key(t):
    """A join on one key or another: the row's distinct keys are exploded, so that it stays an equi-join."""
    e = t("events")
    c = e.where("event_type = 'error'").groupBy(F.col("user_id").alias("u")).agg(F.count("*").alias("n"))
    keys = e.where("event_type = 'purchase'").select("event_id", F.explode(F.array_distinct(F.array("user_id", F.col("event_id") % 150))).alias("u"))
    return keys.join(c, "u").select("event_id", "n")


@query("d13_json_lateral", "SELECT event_id, key FROM (SELECT event_id, unnest(json_keys(props)) AS key FROM events) WHERE key = 'k'")
def json_lateral(t):
    return t("events").select("event_id", F.explode(F.map_keys(F.from_json("props", "map<string,string>"))).alias("key")).where("key = 'k'")


@query("d14_checked_merge", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def checked_merge(t):
    """A many-to-one join that fails where the right side repeats a key."""
    c = t("customer").select("c_custkey", "c_name")
    n = c.groupBy("c_custkey").agg(F.first("c_name").alias("c_name"), F.count("*").alias("n"))
    one = n.select("c_custkey", F.when(F.col("n") == 1, F.col("c_name")).otherwise(F.raise_error(F.lit("key repeats")).cast("string")).alias("c_name"))
    return t("orders").join(one, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("d16_roster_by_games", "WITH m AS (SELECT date_trunc('month', max(o_orderdate)) AS since FROM orders), s AS (SELECT o_orderkey AS g, o_custkey % 25 AS home, (o_custkey + 7) % 25 AS away FROM orders, m WHERE o_orderdate >= since), n AS (SELECT g, unnest([home, away]) AS nation FROM s) SELECT g, s_suppkey FROM n JOIN supplier ON s_nationkey = nation")
def roster_games(t):
    """The slate of the last month that the schedule has, with both sides' rosters."""
    orders = t("orders")
    since = orders.agg(F.date_trunc("month", F.max("o_orderdate")).cast("timestamp_ntz").alias("since"))
    s = orders.crossJoin(F.broadcast(since)).where("o_orderdate >= since").select(F.col("o_orderkey").alias("g"), F.explode(F.array(F.col("o_custkey") % 25, (F.col("o_custkey") + 7) % 25)).alias("nation"))
    return s.join(t("supplier"), F.col("s_nationkey") == F.col("nation")).select("g", "s_suppkey")


@query("d17_set_containment", "WITH a AS (SELECT o_custkey, list(DISTINCT o_orderpriority) AS p FROM orders GROUP BY 1) SELECT o_custkey, list_has_all(['1-URGENT', '2-HIGH', '3-MEDIUM'], p) AS contained FROM a")
def containment(t):
    a = t("orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("p"))
    return a.select("o_custkey", (F.size(F.array_except("p", F.array(*[F.lit(x) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM")]))) == 0).alias("contained"))


@query("d18_pairs_within_group", "WITH p AS (SELECT DISTINCT l_orderkey AS g, l_suppkey AS s FROM lineitem) SELECT a.s AS player, b.s AS mate, count(*) AS games FROM p a JOIN p b ON a.g = b.g AND a.s <> b.s GROUP BY ALL HAVING count(*) >= 8")
def pairs(t):
    sets = t("lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("m"))  # a game's few members
    p = sets.select(F.explode("m").alias("player"), "m").select("player", F.explode("m").alias("mate")).where("player <> mate")
    return p.groupBy("player", "mate").agg(F.count("*").alias("games")).where("games >= 8")


@query("d19_ambiguous_keys", "SELECT p_partkey, count(*) OVER (PARTITION BY lower(p_name)) > 1 AS ambiguous FROM part")
def ambiguous(t):
    return t("part").select("p_partkey", (F.count("*").over(Window.partitionBy(F.lower("p_name"))) > 1).alias("ambiguous"))


@query("g01_total_order_top", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def total_order(t):
    return t("orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(20).select("o_orderkey", "o_totalprice")


@query("g02_nulls_last", f"WITH {LOG} SELECT event_id, v, row_number() OVER (ORDER BY v DESC NULLS LAST, event_id) AS place FROM (SELECT event_id, CASE WHEN k % 2 = 0 THEN k END AS v FROM log)")
def nulls_last(t):
    v = t.log().select("event_id", F.when(F.col("k") % 2 == 0, F.col("k")).alias("v"))
    return numbered(v, [], "v", "event_id", "place", descending=True)


_VIEWS = {"by_units": ("units", True), "by_best": ("best", True), "by_price": ("price", True), "by_bargain": ("bargain", False), "by_games": ("n", True), "by_returns": ("returns", True)}


@query("g05_ranking_views", f"""WITH {GAMES}, a AS (SELECT player_id, avg(units) AS units, max(units) AS best, max(price) AS price, min(price) AS bargain, count(*) AS n, CASE WHEN count(*) >= 5 THEN sum(returned) END AS returns FROM games GROUP BY 1)
    SELECT player_id, {", ".join(f"row_number() OVER (ORDER BY {x} {'DESC' if d else 'ASC'} NULLS LAST, player_id) AS {n}" for n, (x, d) in _VIEWS.items())} FROM a""")
def ranking(t):
    """All players in all views, missing values last."""
    a = t.games().groupBy("player_id").agg(F.avg("units").alias("units"), F.max("units").alias("best"), F.max("price").alias("price"), F.min("price").alias("bargain"), F.count("*").alias("n"), F.sum("returned").alias("r"))
    a = a.withColumn("returns", F.when(F.col("n") >= 5, F.col("r")))
    views = [numbered(a.select("player_id", x), [], x, "player_id", name, descending).select("player_id", name) for name, (x, descending) in _VIEWS.items()]
    return reduce(lambda v, w: v.join(w, "player_id"), views)


@query("h01_union_distinct", "SELECT o_custkey AS id FROM orders WHERE o_totalprice > 150000 UNION SELECT c_custkey FROM customer WHERE c_acctbal > 5000")
def union_distinct(t):
    return t("orders").where("o_totalprice > 150000").select(F.col("o_custkey").alias("id")).union(t("customer").where("c_acctbal > 5000").select("c_custkey")).distinct()


@query("h02_union_all_padded", "SELECT event_id, value, NULL::VARCHAR AS props FROM events WHERE event_type = 'view' UNION ALL SELECT event_id, NULL::DOUBLE, props FROM events WHERE event_type = 'click'")
def union_all(t):
    e = t("events")
    return e.where("event_type = 'view'").select("event_id", "value").unionByName(e.where("event_type = 'click'").select("event_id", "props"), allowMissingColumns=True)


@query("h03_inline_values", "SELECT event_id, w.weight FROM events JOIN (VALUES ('view', 1), ('click', 2), ('purchase', 5)) w(kind, weight) ON event_type = kind")
def inline_values(t):
    w = t.spark.sql("SELECT * FROM VALUES ('view', 1), ('click', 2), ('purchase', 5) AS w(kind, weight)")
    return t("events").join(F.broadcast(w), F.col("event_type") == F.col("kind")).select("event_id", "weight")  # three rows


@query("h04_concat_frames", f"WITH {GAMES} SELECT 'recent' AS fold, count(*) AS n FROM games WHERE season >= 2000 UNION ALL SELECT 'middle', count(*) FROM games WHERE season BETWEEN 1997 AND 1999 UNION ALL SELECT 'old', count(*) FROM games WHERE season < 1997")
def concat(t):
    g = t.games()
    parts = {"recent": F.col("season") >= 2000, "middle": F.col("season").between(1997, 1999), "old": F.col("season") < 1997}
    return reduce(DataFrame.unionByName, [g.where(c).agg(F.count("*").alias("n")).select(F.lit(k).alias("fold"), "n") for k, c in parts.items()])


@query("h05_drop_duplicates", "SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def drop_duplicates(t):
    return t("lineitem").select("l_suppkey", "l_returnflag").dropDuplicates()


@query("h06_set_algebra", "WITH s AS (SELECT l_suppkey, list(DISTINCT l_returnflag) FILTER (WHERE l_quantity > 45) AS a, list(DISTINCT l_returnflag) FILTER (WHERE l_discount > 0.08) AS b FROM lineitem GROUP BY 1) SELECT l_suppkey, list_sort(list_intersect(a, b)) AS both, CAST(len(list_filter(a, lambda x: NOT list_contains(b, x))) AS INTEGER) AS only_a FROM s WHERE a IS NOT NULL AND b IS NOT NULL")
def set_algebra(t):
    s = t("lineitem").groupBy("l_suppkey").agg(F.collect_set(F.when(F.col("l_quantity") > 45, F.col("l_returnflag"))).alias("a"), F.collect_set(F.when(F.col("l_discount") > 0.08, F.col("l_returnflag"))).alias("b")).where("size(a) > 0 and size(b) > 0")
    return s.select("l_suppkey", F.array_sort(F.array_intersect("a", "b")).alias("both"), F.size(F.array_except("a", "b")).alias("only_a"))


@query("h07_intersect", "SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def intersect(t):
    o = t("orders")
    return o.where("o_orderstatus = 'P'").select("o_custkey").intersect(o.where("o_orderpriority = '1-URGENT'").select("o_custkey"))


@query("h07_except", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def subtract(t):
    return t("customer").select("c_custkey").subtract(t("orders").select("o_custkey"))


@query("a25_payload_diff", f"WITH {LOG}, a AS (SELECT user_id, max(k) AS k, count(*) AS n, max(value) AS v FROM log WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT user_id, max(k) AS k, count(*) AS n, max(value) AS v FROM log WHERE event_id % 2 = 1 GROUP BY 1) SELECT count(*) AS shared, count(*) FILTER (WHERE a.k IS DISTINCT FROM b.k) AS k_changed, count(*) FILTER (WHERE a.n IS DISTINCT FROM b.n) AS n_changed, count(*) FILTER (WHERE a.v IS DISTINCT FROM b.v) AS v_changed FROM a JOIN b USING (user_id)")
def payload_diff(t):
    part = lambda m, s: t.log().where(F.col("event_id") % 2 == m).groupBy("user_id").agg(F.max("k").alias(f"k{s}"), F.count("*").alias(f"n{s}"), F.max("value").alias(f"v{s}"))
    return part(0, "").join(part(1, "1"), "user_id").agg(F.count("*").alias("shared"), *[F.count_if(differs(c, f"{c}1")).alias(f"{c}_changed") for c in "knv"])


@query("a27_missing_components", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01 00:00:00' AND o_orderstatus = 'F')")
def missing_components(t):
    done = t("orders").where("o_orderdate >= timestamp_ntz'2001-01-01 00:00:00' and o_orderstatus = 'F'")
    return t("customer").join(done, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("j51_exact_identity", """WITH b AS (SELECT item_id, trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')) AS key FROM benchmark), d AS (SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')) AS key FROM documents),
    g AS (SELECT key, count(DISTINCT doc_id) AS n, min(doc_id) AS doc_id FROM d GROUP BY 1) SELECT item_id, coalesce(CASE WHEN n = 1 THEN 'MATCHED' WHEN n > 1 THEN 'AMBIGUOUS' END, 'UNMATCHED') AS status, CASE WHEN n = 1 THEN doc_id END AS doc_id FROM b LEFT JOIN g USING (key)""")
def identity(t):
    key = F.trim(F.regexp_replace(F.lower("text"), "[^a-z]+", " "))
    g = t("documents").groupBy(F.sha2(key, 256).alias("key")).agg(F.count_distinct("doc_id").alias("n"), F.min("doc_id").alias("doc_id"))
    status = F.when(F.col("n") == 1, "MATCHED").when(F.col("n") > 1, "AMBIGUOUS").otherwise("UNMATCHED")
    return t("benchmark").select("item_id", F.sha2(key, 256).alias("key")).join(g, "key", "left").select("item_id", status.alias("status"), F.when(F.col("n") == 1, F.col("doc_id")).alias("doc_id"))


@query("j74_tiered_match", """WITH c AS (SELECT c_custkey, c_name, c_nationkey, lower(replace(c_name, '#', ' ')) AS norm FROM customer), o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN o_custkey END AS id, CASE WHEN o_orderkey % 4 = 3 THEN 'nobody' WHEN o_orderkey % 4 = 2 THEN upper(replace(c_name, '#', '  ')) ELSE c_name END AS name FROM orders JOIN customer ON c_custkey = o_custkey),
    m AS (SELECT o_orderkey, 1 AS tier, c.c_custkey FROM o JOIN c ON o.id = c.c_custkey UNION ALL SELECT o_orderkey, 2, c.c_custkey FROM o JOIN c ON o.name = c.c_name UNION ALL SELECT o_orderkey, 3, c.c_custkey FROM o JOIN c ON regexp_replace(lower(o.name), '[^a-z0-9]+', ' ', 'g') = c.norm),
    b AS (SELECT o_orderkey, min(tier) AS tier FROM m GROUP BY 1), r AS (SELECT m.o_orderkey, m.tier, count(DISTINCT c_custkey) AS n, min(c_custkey) AS c FROM m JOIN b ON m.o_orderkey = b.o_orderkey AND m.tier = b.tier GROUP BY ALL)
    SELECT o.o_orderkey, CAST(r.tier AS INTEGER) AS tier, CASE WHEN r.n = 1 THEN r.c END AS c_custkey, CASE WHEN r.n IS NULL THEN 'UNMATCHED' WHEN r.n = 1 THEN 'MATCHED' ELSE 'AMBIGUOUS' END AS status FROM o LEFT JOIN r ON o.o_orderkey = r.o_orderkey""")
def tiered(t):
    """Explicit id, exact name, normalised name: the first tier with a candidate decides."""
    c = t("customer").select("c_custkey", "c_name")
    o = t("orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey") % 4
    o = o.select("o_orderkey", F.when(k == 0, F.col("o_custkey")).alias("id"), F.when(k == 3, "nobody").when(k == 2, F.upper(F.replace("c_name", F.lit("#"), F.lit("  ")))).otherwise(F.col("c_name")).alias("name"))
    ways = [(1, o.where("id is not null").select("o_orderkey", F.col("id").cast("string").alias("key")), F.col("c_custkey").cast("string")), (2, o.select("o_orderkey", F.col("name").alias("key")), F.col("c_name")), (3, o.select("o_orderkey", normal_text("name").alias("key")), normal_text("c_name"))]
    m = reduce(DataFrame.unionByName, [left.join(c.select(own.alias("key"), "c_custkey"), "key").select("o_orderkey", F.lit(n).alias("tier"), "c_custkey") for n, left, own in ways])
    n = m.groupBy("o_orderkey", "tier").agg(F.count_distinct("c_custkey").alias("n"), F.min("c_custkey").alias("c")).groupBy("o_orderkey").agg(F.min(F.struct("tier", "n", "c")).alias("b"))
    status = F.when(F.col("b").isNull(), "UNMATCHED").when(F.col("b.n") == 1, "MATCHED").otherwise("AMBIGUOUS")
    return o.select("o_orderkey").join(n, "o_orderkey", "left").select("o_orderkey", F.col("b.tier").alias("tier"), F.when(F.col("b.n") == 1, F.col("b.c")).alias("c_custkey"), status.alias("status"))


@query("j61_overlay_precedence", f"WITH {LOG}, m AS (SELECT user_id, max(k) AS k FROM log WHERE event_type = 'error' GROUP BY 1), p AS (SELECT user_id, max(k) AS k FROM log WHERE event_type = 'purchase' GROUP BY 1), v AS (SELECT user_id, min(k) AS k FROM log GROUP BY 1) SELECT v.user_id, coalesce(CASE WHEN m.k > 90 THEN m.k END, p.k, v.k) AS status FROM v LEFT JOIN m USING (user_id) LEFT JOIN p USING (user_id)")
def overlay(t):
    k = lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("k")))
    g = t.log().groupBy("user_id").agg(k("error").alias("m"), k("purchase").alias("p"), F.min("k").alias("v"))
    return g.select("user_id", F.coalesce(F.when(F.col("m") > 90, F.col("m")), "p", "v").alias("status"))


@query("j53_recent_form", f"WITH {GAMES}, u AS (SELECT player_id, game_time, game_id, units, 'A' AS comp FROM games WHERE priority IN ('1', '2') UNION SELECT player_id, game_time, game_id, units, 'B' FROM games WHERE priority NOT IN ('1', '2')), r AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY game_time DESC, game_id DESC) <= 5) SELECT player_id, count(*) AS n, round(avg(units), 4) AS mean, median(units) AS med, count(*) FILTER (WHERE comp = 'A') AS n_a FROM r GROUP BY 1")
def recent_form(t):
    g = t.games().select("player_id", "game_time", "game_id", "units", F.when(F.col("priority").isin("1", "2"), "A").otherwise("B").alias("comp"))
    r = g.withColumn("r", F.row_number().over(Window.partitionBy("player_id").orderBy(F.desc("game_time"), F.desc("game_id")))).where("r <= 5")
    return r.groupBy("player_id").agg(F.count("*").alias("n"), r4(F.avg("units")).alias("mean"), F.percentile("units", 0.5).alias("med"), F.count_if(F.col("comp") == "A").alias("n_a"))


@query("j54_scoring_ladder", f"WITH {GAMES} SELECT game_id, CASE WHEN returned = 0 THEN 'EXACT' WHEN returned = 1 THEN 'PIR' WHEN returned = 2 THEN 'VAL' ELSE 'LOWER_BOUND' END AS kind, CASE WHEN returned = 0 THEN units WHEN returned = 1 THEN units - 5 WHEN returned = 2 THEN units * 0.5::DOUBLE ELSE 0 END AS score FROM games")
def ladder(t):
    r, u = F.col("returned"), F.col("units")
    return t.games().select("game_id", F.when(r == 0, "EXACT").when(r == 1, "PIR").when(r == 2, "VAL").otherwise("LOWER_BOUND").alias("kind"), F.when(r == 0, u).when(r == 1, u - 5).when(r == 2, u * 0.5).otherwise(0.0).alias("score"))


@query("j62_value_growth", f"WITH {GAMES}, a AS (SELECT player_id, avg(units) / avg(price) * 1000 AS v, avg(CAST(units > 100 AS INTEGER))::DOUBLE AS p, avg(price) / 100000 - 1 AS d FROM games GROUP BY 1), m AS (SELECT median(v) AS med FROM a) SELECT player_id, round(CASE WHEN v >= med AND p >= 0.5 THEN v * (0.75::DOUBLE + 0.25::DOUBLE * p) + 0.05::DOUBLE * least(greatest(d, 0), 0.5::DOUBLE) END, 4) AS growth FROM a, m")
def growth(t):
    a = t.games().groupBy("player_id").agg((F.avg("units") / F.avg("price") * 1000).alias("v"), F.avg((F.col("units") > 100).cast("int")).alias("p"), (F.avg("price") / 100000 - 1).alias("d"))
    m = a.agg(F.percentile("v", 0.5).alias("med"))
    score = F.col("v") * (0.75 + 0.25 * F.col("p")) + 0.05 * F.least(F.greatest("d", F.lit(0.0)), F.lit(0.5))
    return a.crossJoin(F.broadcast(m)).select("player_id", r4(F.when((F.col("v") >= F.col("med")) & (F.col("p") >= 0.5), score)).alias("growth"))


@query("j52_history_catalog", f"WITH {GAMES} SELECT season, count(*) AS games, count(DISTINCT player_id) AS players, max(units) AS best FROM games WHERE priority IN ('1', '3', '5') GROUP BY season")
def catalog(t):
    return t.games().where(F.col("priority").isin("1", "3", "5")).groupBy("season").agg(F.count("*").alias("games"), F.count_distinct("player_id").alias("players"), F.max("units").alias("best"))
