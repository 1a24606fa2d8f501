"""Scalar expressions and projections (survey B, I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from .registry import GAMES, LOG, SIDES, query, r4


@query("b01_base_score", """SELECT l_orderkey, l_linenumber, l_quantity + l_linenumber - (l_quantity - floor(l_quantity * (1 - l_discount))) AS base FROM lineitem""")
def base_score(t):
    made = F.floor(F.col("l_quantity") * (1 - F.col("l_discount"))).cast("double")
    x = t("lineitem").withColumn("made", made)
    return x.select("l_orderkey", "l_linenumber", X.base_score(["l_quantity", "l_linenumber"], [], [("l_quantity", "made")]).alias("base"))


@query("b01_score_with_bonus", f"WITH {GAMES} SELECT game_id, round(b + CASE WHEN units > 100 THEN 0.1::DOUBLE * abs(b) ELSE 0 END, 4) AS total FROM (SELECT *, units - 20.0::DOUBLE * returned AS b FROM games)")
def with_bonus(t):
    return t.games().withColumn("b", F.col("units") - 20.0 * F.col("returned")).select("game_id", r4(X.with_bonus("b", F.col("units") > 100)).alias("total"))


@query("b02_eligibility", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity - 10 > 0 AND NOT l_returnflag = 'R' THEN 'PLAYED' WHEN l_returnflag = 'R' THEN 'DNP' ELSE 'UNKNOWN' END AS status FROM lineitem")
def eligibility(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", X.eligibility(F.col("l_quantity") - 10, F.col("l_returnflag") == "R").alias("status"))


@query("b03_star_minus", "SELECT * EXCLUDE (c_acctbal, c_mktsegment) FROM customer")
def star_minus(t):
    return t("customer").drop("c_acctbal", "c_mktsegment")


@query("b04_star_replace", "SELECT * REPLACE (upper(n_name) AS n_name, CAST(n_regionkey + 1 AS INTEGER) AS n_regionkey) FROM nation")
def star_replace(t):
    return t("nation").withColumns({"n_name": F.upper("n_name"), "n_regionkey": F.col("n_regionkey") + 1})


@query("b05_constants", "SELECT r_regionkey, 'V1' AS version, 'STRICTLY_BEFORE' AS policy FROM region")
def constants(t):
    return t("region").select("r_regionkey", F.lit("V1").alias("version"), F.lit("STRICTLY_BEFORE").alias("policy"))


@query("b06_guarded_ratio", f"WITH {GAMES} SELECT game_id, round(units / nullif(returned, 0), 4) AS per_return FROM games")
def guarded(t):
    return t.games().select("game_id", r4(X.ratio("units", "returned")).alias("per_return"))


@query("b07_threshold_rate", f"WITH {GAMES} SELECT game_id, round(CASE WHEN units >= 10 THEN returned::DOUBLE / units END, 4) AS rate FROM games")
def threshold_rate(t):
    return t.games().select("game_id", r4(X.rate_when("returned", "units")).alias("rate"))


@query("b08_coalesce_chain", f"WITH {LOG} SELECT event_id, coalesce(CASE WHEN k > 50 THEN k END, CASE WHEN value > 50 THEN CAST(floor(value) AS INTEGER) END, -1) AS v FROM log")
def coalesced(t):
    return t.log().select("event_id", F.coalesce(F.when(F.col("k") > 50, F.col("k")), F.when(F.col("value") > 50, F.floor("value").cast("int")), F.lit(-1)).alias("v"))


@query("b09_flags_from_counts", f"WITH {GAMES}, n AS (SELECT player_id, count(*) AS n, sum(returned) AS r FROM games GROUP BY 1) SELECT player_id, n >= 5 AS has_5, n >= 10 AS has_10, r > 0 AND n >= 3 AS usable FROM n")
def flags(t):
    n = t.games().groupBy("player_id").agg(F.count("*").alias("n"), F.sum("returned").alias("r"))
    return n.select("player_id", (F.col("n") >= 5).alias("has_5"), (F.col("n") >= 10).alias("has_10"), ((F.col("r") > 0) & (F.col("n") >= 3)).alias("usable"))


@query("b10_interactions", f"WITH {GAMES} SELECT game_id, round(units * n_lines, 4) AS volume, round(0.5::DOUBLE * (units + 10 * returned), 4) AS blend FROM games")
def interactions(t):
    return t.games().select("game_id", r4(F.col("units") * F.col("n_lines")).alias("volume"), r4(0.5 * (F.col("units") + 10 * F.col("returned"))).alias("blend"))


@query("b11_winner", f"WITH {SIDES} SELECT h.game_id, CASE WHEN h.points > a.points THEN 'HOME' WHEN h.points < a.points THEN 'AWAY' END AS winner FROM sides h JOIN sides a ON h.game_id = a.game_id AND h.side = 'HOME' AND a.side = 'AWAY'")
def winner(t):
    s = t.sides().groupBy("game_id").agg(F.max(F.when(F.col("side") == "HOME", F.col("points"))).alias("h"), F.max(F.when(F.col("side") == "AWAY", F.col("points"))).alias("a")).where("h is not null and a is not null")
    return s.select("game_id", F.when(F.col("h") > F.col("a"), "HOME").when(F.col("h") < F.col("a"), "AWAY").alias("winner"))


@query("b12_leakage_guard", f"WITH {GAMES} SELECT game_id, CASE WHEN status_ok THEN price END AS price FROM (SELECT *, season >= 1998 AND returned = 0 AS status_ok FROM games)")
def leakage_guard(t):
    return t.games().select("game_id", X.valid_only("price", (F.col("season") >= 1998) & (F.col("returned") == 0)).alias("price"))


@query("b13_display_name", "SELECT c_custkey, CASE WHEN n = upper(n) THEN list_aggregate(list_transform(string_split(split_part(n, ', ', 2) || ' ' || split_part(n, ', ', 1), ' '), lambda x: upper(x[1]) || lower(x[2:])), 'string_agg', ' ') ELSE split_part(n, ', ', 2) || ' ' || split_part(n, ', ', 1) END AS name FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN upper(replace(c_name, '#', ', ')) ELSE replace(c_name, '#', ', ') END AS n FROM customer)")
def display_name(t):
    n = F.replace("c_name", F.lit("#"), F.lit(", "))
    return t("customer").select("c_custkey", X.display_name(F.when(F.col("c_custkey") % 2 == 0, F.upper(n)).otherwise(n)).alias("name"))


@query("b14_prefixed_columns", "SELECT s_suppkey, s_name AS supplier_name, s_acctbal AS supplier_balance FROM supplier")
def prefixed(t):
    return t("supplier").select("s_suppkey", "s_name", "s_acctbal").withColumnsRenamed({"s_name": "supplier_name", "s_acctbal": "supplier_balance"})


@query("i01_math", "SELECT l_orderkey, l_linenumber, round(sqrt(l_quantity), 4) AS root, round(ln(l_quantity), 4) AS log, round(pow(l_discount, 2), 6) AS square, round(1 / (1 + exp(-(l_quantity - 25) / 10)), 4) AS sigmoid, CAST(sign(l_tax - 0.04) AS INTEGER) AS s, greatest(l_discount, l_tax) AS hi, least(l_discount, l_tax) AS lo FROM lineitem")
def maths(t):
    q = F.col("l_quantity")
    return t("lineitem").select("l_orderkey", "l_linenumber", r4(F.sqrt(q)).alias("root"), r4(F.ln(q)).alias("log"), F.round(F.pow("l_discount", F.lit(2.0)), 6).alias("square"), r4(1 / (1 + F.exp(-(q - 25) / 10))).alias("sigmoid"), F.sign(F.col("l_tax") - 0.04).cast("int").alias("s"), F.greatest("l_discount", "l_tax").alias("hi"), F.least("l_discount", "l_tax").alias("lo"))


@query("i02_clip", "SELECT l_orderkey, l_linenumber, least(greatest(l_quantity, 10), 40)::DOUBLE AS q FROM lineitem")
def clipped(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", X.clip("l_quantity", 10.0, 40.0).alias("q"))


@query("i03_date_differences", "SELECT o_orderkey, l_linenumber, CAST(date_diff('day', o_orderdate, l_shipdate) AS INTEGER) AS days, CAST(floor(epoch(l_shipdate)) - floor(epoch(o_orderdate)) AS BIGINT) AS seconds FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def date_differences(t):
    us = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / 1e6)
    return t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "l_linenumber", F.datediff("l_shipdate", "o_orderdate").alias("days"), (us("l_shipdate") - us("o_orderdate")).alias("seconds"))


@query("i04_intervals", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(CAST(o_orderdate AS DATE) + 60 AS DATE) AS plus_60, o_orderdate + INTERVAL 7 DAY > TIMESTAMP '1998-01-01 00:00:00' AS late FROM orders")
def intervals(t):
    return t("orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"), F.date_add(F.to_date("o_orderdate"), 60).alias("plus_60"), (F.col("o_orderdate") + F.expr("INTERVAL 7 DAYS") > F.expr("timestamp_ntz'1998-01-01 00:00:00'")).alias("late"))


@query("i05_epoch_micros", "SELECT event_id, CAST(epoch_us(ts) AS BIGINT) AS us FROM events")
def epoch(t):
    return t("events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


@query("i06_clock_parsing", """SELECT event_id, CASE WHEN regexp_matches(c, '^[0-9]{1,3}:[0-5][0-9]$') THEN CAST(split_part(c, ':', 1) AS INTEGER) * 60 + CAST(split_part(c, ':', 2) AS INTEGER) END AS seconds
    FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'DNP' ELSE lpad(CAST(event_id % 48 AS VARCHAR), 2, '0') || ':' || lpad(CAST(event_id % 70 AS VARCHAR), 2, '0') END AS c FROM events)""")
def clocks(t):
    two = lambda n: F.lpad((F.col("event_id") % n).cast("string"), 2, "0")
    c = F.when(F.col("event_id") % 7 == 0, "DNP").otherwise(F.concat_ws(":", two(48), two(70)))
    return t("events").select("event_id", X.clock_seconds(c).alias("seconds"))


@query("i06_iso_durations", """SELECT event_id, round(CASE WHEN event_id % 5 = 0 THEN NULL ELSE (event_id % 3) * 60 + event_id % 60 + (event_id % 40) / 60.0::DOUBLE END, 4) AS minutes FROM events""")
def durations(t):
    e = F.col("event_id")
    raw = F.when(e % 5 == 0, "DNP").otherwise(F.concat(F.lit("PT"), (e % 3).cast("string"), F.lit("H"), (e % 60).cast("string"), F.lit("M"), (e % 40).cast("string"), F.lit("S")))
    return t("events").select("event_id", r4(X.duration_minutes(raw)).alias("minutes"))


@query("i07_period_offsets", "SELECT event_id, CAST(p AS INTEGER) AS period, CAST(CASE WHEN p <= 4 THEN 600 ELSE 300 END AS INTEGER) AS length, CAST(CASE WHEN p <= 4 THEN (p - 1) * 600 ELSE 2400 + (p - 5) * 300 END AS INTEGER) AS off FROM (SELECT event_id, event_id % 6 + 1 AS p FROM events)")
def periods(t):
    return t("events").select("event_id", (F.col("event_id") % 6 + 1).cast("int").alias("period")).select("event_id", "period", X.period_length("period").alias("length"), X.period_offset("period").alias("off"))


@query("i08_normal_text", """SELECT doc_id, md5(trim(regexp_replace(translate(lower(text), 'áàâäãåéèêëíìîïóòôöõúùûüñçýÿšžćčđłń', 'aaaaaaeeeeiiiiooooouuuuncyyszccdln'), '[^a-z0-9]+', ' ', 'g'))) AS normal_md5 FROM documents""")
def normal_text(t):
    return t("documents").select("doc_id", F.md5(X.normal_text("text")).alias("normal_md5"))


@query("i09_name_variants", """SELECT p_partkey, v AS variant FROM (SELECT p_partkey, unnest(list_distinct([lower(p_name), array_to_string(list_reverse(string_split(lower(p_name), ' ')), ' '), array_to_string(list_sort(string_split(lower(p_name), ' ')), ' ')])) AS v FROM part)""")
def variants(t):
    words = F.split(F.lower("p_name"), " ")
    return t("part").select("p_partkey", F.explode(F.array_distinct(F.array(F.lower("p_name"), F.array_join(F.reverse(words), " "), F.array_join(F.array_sort(words), " ")))).alias("variant"))


@query("i10_canonical_codes", "SELECT p_partkey, coalesce(nullif(regexp_extract(trim(c), '^[Pp]([0-9]+)$', 1), ''), upper(trim(c))) AS code FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN ' P' || p_partkey ELSE 'x' || p_partkey || ' ' END AS c FROM part)")
def codes(t):
    k = F.col("p_partkey").cast("string")
    return t("part").select("p_partkey", X.canonical_code(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" P"), k)).otherwise(F.concat(F.lit("x"), k, F.lit(" ")))).alias("code"))


@query("i11_keyword_classes", "SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'licen[sc]e') THEN 'LICENSED' WHEN regexp_matches(lower(text), '[0-9]{3}-[0-9]{4}') THEN 'CONTACT' WHEN regexp_matches(lower(text), '\\|') THEN 'TABLE' ELSE 'PLAIN' END AS kind FROM documents")
def classes(t):
    return t("documents").select("doc_id", X.first_match("text", [("licen[sc]e", "LICENSED"), ("[0-9]{3}-[0-9]{4}", "CONTACT"), (r"\|", "TABLE")], "PLAIN").alias("kind"))


@query("i12_season_codes", f"WITH {GAMES} SELECT DISTINCT 'E' || season AS code, 'E' || (season - 1) AS before FROM games")
def season_codes(t):
    code = F.concat(F.lit("E"), F.col("season").cast("string"))
    return t.games().select(code.alias("code"), X.season_before(code).alias("before")).distinct()


_XY = "(SELECT vec_id, label, embedding[1] * 1000 AS x, (embedding[2] + 0.3) * 1200 AS y, CASE WHEN vec_id % 3 = 0 THEN 3 ELSE 2 END AS points FROM embeddings)"
ZONE = """CASE WHEN (x = -1 AND y = -1) OR abs(x) > 750 OR y < -150 OR y > 1400 OR (points = 2 AND sqrt(x * x + y * y) > 800) OR (points = 3 AND sqrt(x * x + y * y) < 550) THEN NULL WHEN points = 2 AND sqrt(x * x + y * y) <= 125 THEN 'RIM'
    WHEN points = 2 AND abs(x) <= 245 AND y <= 423 THEN 'PAINT' WHEN points = 2 THEN 'MIDRANGE' WHEN abs(x) >= 660 AND y <= 142 THEN 'CORNER3' ELSE 'ABOVE_BREAK3' END"""
SHOTS = f"shots AS (SELECT *, {ZONE} AS zone FROM (SELECT vec_id, label, embedding[1]::DOUBLE * 1000 AS x, (embedding[2]::DOUBLE + 0.3::DOUBLE) * 1200 AS y, CASE WHEN vec_id % 3 = 0 THEN 3 ELSE 2 END AS points FROM embeddings))"


def shots(t):
    """Embedding components as places of shots."""
    e = F.col("embedding")
    s = t("embeddings").select("vec_id", "label", (e[0].cast("double") * 1000).alias("x"), ((e[1].cast("double") + 0.3) * 1200).alias("y"), F.when(F.col("vec_id") % 3 == 0, 3).otherwise(2).alias("points"))
    return s.withColumn("zone", X.shot_zone("x", "y", "points"))


@query("i13_shot_zones", f"WITH {SHOTS} SELECT vec_id, zone, round(sqrt(x * x + y * y), 3) AS distance FROM shots")
def zones(t):
    return shots(t).select("vec_id", "zone", F.round(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")), 3).alias("distance"))


@query("i14_json_paths", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_path(t):
    return t("events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("i15_json_objects", "SELECT event_id, key, CAST(props->>key AS VARCHAR) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)")
def json_object(t):
    return t("events").select("event_id", F.explode(F.from_json("props", "map<string,string>"))).select("event_id", "key", "value")


@query("i16_list_operations", "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n, list_contains(list_transform(embedding, lambda x: x > 0), true) AS any_positive, CAST(len(list_filter(embedding, lambda x: x > 0)) AS INTEGER) AS n_positive FROM embeddings")
def list_ops(t):
    return t("embeddings").select("vec_id", F.size("embedding").alias("n"), F.exists("embedding", lambda x: x > 0).alias("any_positive"), F.size(F.filter("embedding", lambda x: x > 0)).alias("n_positive"))


@query("i17_string_keys", "SELECT n_nationkey, concat_ws('|', CAST(n_nationkey AS VARCHAR), n_name) AS key, len(string_split(concat_ws('|', CAST(n_nationkey AS VARCHAR), n_name), '|'))::INTEGER AS parts FROM nation")
def string_keys(t):
    k = F.concat_ws("|", F.col("n_nationkey").cast("string"), "n_name")
    return t("nation").select("n_nationkey", k.alias("key"), F.size(F.split(k, r"\|")).alias("parts"))


@query("i18_trim_nullif", "SELECT event_id, nullif(trim(trim(CAST(json_extract(props, '$.k') AS VARCHAR), '\"')), '0') AS k FROM events")
def trims(t):
    return t("events").select("event_id", F.nullif(F.trim(F.btrim(F.get_json_object("props", "$.k"), F.lit('"'))), F.lit("0")).alias("k"))


@query("i19_binning", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity >= 1 AND l_quantity < 10 THEN 'small' WHEN l_quantity >= 10 AND l_quantity < 30 THEN 'medium' WHEN l_quantity >= 30 AND l_quantity < 51 THEN 'large' END AS size, CASE WHEN l_discount > 0 AND l_discount <= 0.05 THEN 'low' WHEN l_discount > 0.05 AND l_discount <= 0.1 THEN 'high' END AS disc FROM lineitem")
def binning(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", X.band("l_quantity", [1, 10, 30, 51], ["small", "medium", "large"]).alias("size"), X.band("l_discount", [0, 0.05, 0.1], ["low", "high"], right=True).alias("disc"))


@query("i21_ordered_classes", f"WITH {GAMES} SELECT game_id, CASE WHEN units >= 150 AND returned = 0 THEN 'CREATOR' WHEN returned >= 2 THEN 'RISKY' WHEN n_lines >= 5 THEN 'VOLUME' ELSE 'ROLE' END AS archetype FROM games")
def archetypes(t):
    return t.games().select("game_id", F.when((F.col("units") >= 150) & (F.col("returned") == 0), "CREATOR").when(F.col("returned") >= 2, "RISKY").when(F.col("n_lines") >= 5, "VOLUME").otherwise("ROLE").alias("archetype"))


@query("i22_interpolation", "SELECT l_orderkey, l_linenumber, round(CASE WHEN q <= 5 THEN 0 WHEN q <= 20 THEN (q - 5) / 15.0 * 0.4 WHEN q <= 40 THEN 0.4 + (q - 20) / 20.0 * 0.6 ELSE 1 END, 4)::DOUBLE AS share FROM (SELECT l_orderkey, l_linenumber, l_quantity AS q FROM lineitem)")
def interpolation(t):
    xs, ys = (F.array(*[F.lit(float(v)) for v in p]) for p in ((5, 20, 40), (0, 0.4, 1)))
    return t("lineitem").select("l_orderkey", "l_linenumber", r4(X.interpolated("l_quantity", xs, ys)).alias("share"))


@query("i23_stable_ids", "SELECT c_custkey, sha256('player|' || c_custkey || '|' || c_name) AS id FROM customer")
def stable_ids(t):
    return t("customer").select("c_custkey", X.stable_id("player", "c_custkey", "c_name").alias("id"))


@query("i24_possessions_pace", f"WITH {SIDES} SELECT game_id, side, round(fga - oreb + tov + 0.44::DOUBLE * fta, 4) AS poss, round(CASE WHEN fga >= 40 THEN 40.0::DOUBLE * (fga - oreb + tov + 0.44::DOUBLE * fta) / fga END, 4) AS pace FROM sides")
def possessions(t):
    p = X.possessions("fga", "oreb", "tov", "fta")
    return t.sides().select("game_id", "side", r4(p).alias("poss"), r4(X.pace(p, "fga")).alias("pace"))


@query("i25_usage", f"""WITH {GAMES}, s AS (SELECT season, sum(units) AS tu, sum(n_lines) AS tl, sum(returned) AS tr FROM games GROUP BY 1)
    SELECT game_id, round(least(greatest(100 * ((units + 0.44::DOUBLE * n_lines + returned) * 40) / nullif(8.0::DOUBLE * (tu + 0.44::DOUBLE * tl + tr) / 1000, 0), 0), 100), 4) AS usg FROM games JOIN s USING (season)""")
def usage(t):
    g = t.games()
    s = g.groupBy("season").agg(F.sum("units").alias("tu"), F.sum("n_lines").alias("tl"), F.sum("returned").alias("tr"))
    j = g.join(F.broadcast(s), "season")  # a row for each season
    return j.select("game_id", r4(X.usage("units", "n_lines", "returned", F.lit(8.0), F.col("tu") / 1000, F.col("tl") / 1000, F.col("tr") / 1000, F.lit(200.0))).alias("usg"))


@query("i26_coach_points", f"""WITH {SIDES}, g AS (SELECT game_id, max(points) FILTER (WHERE side = 'HOME') - max(points) FILTER (WHERE side = 'AWAY') AS m FROM sides GROUP BY 1)
    SELECT game_id, CAST(CASE WHEN abs(m) <= 10 OR game_id % 9 = 0 THEN CASE WHEN m > 0 THEN 10 ELSE -5 END WHEN abs(m) <= 20 THEN CASE WHEN m > 0 THEN 20 ELSE -10 END ELSE CASE WHEN m > 0 THEN 25 ELSE -20 END END AS INTEGER) AS points FROM g WHERE m IS NOT NULL""")
def coach_points(t):
    g = t.sides().groupBy("game_id").agg((F.max(F.when(F.col("side") == "HOME", F.col("points"))) - F.max(F.when(F.col("side") == "AWAY", F.col("points")))).alias("m")).where("m is not null")
    return g.select("game_id", X.coach_points("m", F.col("game_id") % 9 == 0, F.col("m") > 0).alias("points"))


@query("i27_role_labels", f"WITH {GAMES}, a AS (SELECT player_id, avg(units) AS u FROM games GROUP BY 1) SELECT player_id, CASE WHEN u >= 130 THEN 'STARTER' WHEN u >= 90 THEN 'ROTATION' ELSE 'BENCH' END AS role FROM a")
def roles(t):
    a = t.games().groupBy("player_id").agg(F.avg("units").alias("u"))
    return a.select("player_id", F.when(F.col("u") >= 130, "STARTER").when(F.col("u") >= 90, "ROTATION").otherwise("BENCH").alias("role"))


@query("i28_schedule_changes", """WITH a AS (SELECT user_id, max(ts) AS d, count(*) AS n FROM events WHERE event_id % 3 = 0 GROUP BY 1), b AS (SELECT user_id, max(ts) AS d, count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY 1)
    SELECT b.user_id, CASE WHEN a.d IS NULL THEN 'NEW' WHEN b.d > a.d THEN 'POSTPONED' WHEN a.n IS DISTINCT FROM b.n OR a.d IS DISTINCT FROM b.d THEN 'UPDATED' ELSE 'UNCHANGED' END AS change FROM b LEFT JOIN a USING (user_id)""")
def schedule(t):
    part = lambda m, d, n: t("events").where(F.col("event_id") % m == 0).groupBy("user_id").agg(F.max("ts").alias(d), F.count("*").alias(n))
    return part(2, "d", "n").join(part(3, "d0", "n0"), "user_id", "left").select("user_id", X.change_class(["d0", "n0"], ["d", "n"], "d0", "d").alias("change"))


@query("i29_positions", "SELECT p_partkey, CASE WHEN contains(lower(p_type), 'steel') THEN 'G' WHEN contains(lower(p_type), 'brass') THEN 'F' WHEN contains(lower(p_type), 'tin') THEN 'C' ELSE 'OTHER' END AS position FROM part")
def positions(t):
    return t("part").select("p_partkey", X.first_match("p_type", [("steel", "G"), ("brass", "F"), ("tin", "C")], "OTHER").alias("position"))


@query("a28_redaction", r"SELECT doc_id, regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '<email>', 'g'), '\+?[0-9][0-9 ()-]{7,}[0-9]', '<number>', 'g') AS clean FROM documents")
def redaction(t):
    return t("documents").select("doc_id", F.regexp_replace(F.regexp_replace("text", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "<email>"), r"\+?[0-9][0-9 ()-]{7,}[0-9]", "<number>").alias("clean"))


@query("a28_url_redaction", r"SELECT page_id, regexp_replace(url, '([?&][^=&#]+)=[^&#]*', '\1=***', 'g') AS url FROM pages")
def url_redaction(t):
    return t("pages").select("page_id", F.regexp_replace("url", r"([?&][^=&#]+)=[^&#]*", "$1=***").alias("url"))


@query("a29_failure_classes", "SELECT event_id, CASE WHEN event_type = 'error' THEN CASE WHEN value < 20 THEN 'TIMEOUT' WHEN value < 40 THEN 'HTTP' ELSE 'PARSE' END ELSE 'NONE' END AS class FROM events")
def failures(t):
    return t("events").select("event_id", F.when(F.col("event_type") == "error", F.when(F.col("value") < 20, "TIMEOUT").when(F.col("value") < 40, "HTTP").otherwise("PARSE")).otherwise("NONE").alias("class"))


@query("a14_html_options", r"SELECT page_id, len(regexp_extract_all(html, '(?s)<li>.*?</li>'))::INTEGER AS items, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, regexp_extract(html, '<html lang=.([a-z]+)', 1) AS lang FROM pages")
def html_options(t):
    return t("pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit(r"(?s)<li>.*?</li>"), F.lit(0))).alias("items"), F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"), F.regexp_extract("html", "<html lang=.([a-z]+)", 1).alias("lang"))


@query("a14_html_links", r"SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href=.([^ >]*)[^ >]>', 1))) AS href FROM pages")
def html_links(t):
    return t("pages").select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(r"href=.([^ >]*)[^ >]>"), F.lit(1)))).alias("href"))


@query("a15_embedded_json", r"SELECT page_id, regexp_extract(html, '(?s)<script>(.*?)</script>', 1) AS script FROM pages")
def embedded(t):
    return t("pages").select("page_id", F.regexp_extract("html", r"(?s)<script>(.*?)</script>", 1).alias("script"))


@query("a19_content_hashes", "SELECT sha256(html) AS digest, count(*) AS n, min(page_id) AS first_page FROM pages GROUP BY 1")
def content_hashes(t):
    return t("pages").groupBy(F.sha2("html", 256).alias("digest")).agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))
