"""Joint lineup optimum, forced entities and lineup enumeration (survey J39, J40, J76): parts as players, suppliers as coaches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lineups as L
from .registry import query

_POSITIONS = ("G", "F", "C")


def _players(t):
    spot = F.element_at(F.array(*[F.lit(x) for x in _POSITIONS]), (F.col("p_partkey") % 3 + 1).cast("int"))
    return t("part").select(
        (F.col("p_size") % 10).alias("slate"), F.col("p_partkey").alias("player"), spot.alias("position"), F.col("p_brand").alias("club"),
        F.round(4 + F.pmod(F.col("p_retailprice"), F.lit(12.0)), 1).alias("credits"), F.round(F.pmod(F.col("p_retailprice") * 7, F.lit(40.0)), 3).alias("value"),
    )


def _coaches(t):
    return t("supplier").select((F.col("s_suppkey") % 10).alias("slate"), F.col("s_suppkey").alias("coach"), F.round(3 + F.pmod(F.col("s_acctbal"), F.lit(5.0)), 1).alias("credits"), F.round(F.pmod(F.col("s_acctbal") * 3, F.lit(45.0)) - 20, 2).alias("value"))


@query("j39_lineup_optimum")
def lineup_optimum(t):
    """Each slate's best ten players with roles, and coach."""
    return L.optimum(_players(t), _coaches(t), "slate").select("slate", "entity", "kind", "role", "position", "club", "credits", "value", F.round("objective", 6).alias("objective"))


@query("j76_forced_entities")
def forced(t):
    """The best lineup that holds the player of least value, or the coach of least value, and what it costs against the free one."""
    players, coaches = _players(t), _coaches(t)
    worst = players.groupBy("slate").agg(F.min_by(F.col("player"), F.struct("value", "player")).cast("string").alias("p")).join(coaches.groupBy("slate").agg(F.min_by(F.col("coach"), F.struct("value", "coach")).cast("string").alias("c")), "slate")
    none = F.array().cast("array<string>")
    asked = worst.select("slate", F.explode(F.create_map(F.lit("free"), none, F.lit("player"), F.array("p"), F.lit("coach"), F.array("c"))).alias("request", "entities"))
    found = L.optimum(players, coaches, "slate", requests=asked).groupBy("slate", "request").agg(F.max("objective").alias("objective"), F.sum("credits").alias("credits"))
    free = found.where("request = 'free'").select("slate", F.col("objective").alias("free"))
    return found.join(free, "slate").select("slate", "request", F.round("objective", 4).alias("objective"), F.round("credits", 1).alias("credits"), F.round(F.col("free") - F.col("objective"), 4).alias("cost"))


@query("j40_lineup_enumeration", """WITH p AS (SELECT p_partkey // 10 AS roster, row_number() OVER (PARTITION BY p_partkey // 10 ORDER BY p_partkey) - 1 AS i, ['G', 'F', 'C'][p_partkey % 3 + 1] AS s, floor(p_retailprice % 40) AS v FROM part),
    m AS (SELECT m FROM range(1024) r(m) WHERE bit_count(m) = 5),
    x AS (SELECT roster, m, sum(CASE WHEN (m >> i) & 1 = 1 THEN v ELSE v * 0.5::DOUBLE END) AS base, max(CASE WHEN (m >> i) & 1 = 1 THEN v END) AS cap, max(CASE WHEN (m >> i) & 1 = 0 THEN v END) AS sixth, sum(CASE WHEN (m >> i) & 1 = 1 THEN v ELSE 0 END) AS sv, sum(CASE WHEN (m >> i) & 1 = 0 THEN v ELSE 0 END) AS bv,
        count(*) FILTER (WHERE (m >> i) & 1 = 1 AND s = 'G') * 100 + count(*) FILTER (WHERE (m >> i) & 1 = 1 AND s = 'F') * 10 + count(*) FILTER (WHERE (m >> i) & 1 = 1 AND s = 'C') AS f, count(*) AS n FROM p, m GROUP BY roster, m)
    SELECT roster, CAST(count(*) * 25 AS BIGINT) AS lineups, max(base + cap + 0.5::DOUBLE * sixth) AS best, round(sum(25 * base + 5 * sv + 2.5::DOUBLE * bv) / (25 * count(*)), 4) AS mean FROM x WHERE n = 10 AND f IN (221, 122, 212, 131, 311) GROUP BY roster""")
def enumeration(t):
    """All lineups of rosters of ten parts each, with their scores."""
    spot = F.element_at(F.array(*[F.lit(x) for x in _POSITIONS]), (F.col("p_partkey") % 3 + 1).cast("int"))
    rosters = t("part").groupBy(F.expr("p_partkey div 10").alias("roster")).agg(F.array_sort(F.collect_list(F.struct(F.col("p_partkey").alias("player"), spot.alias("position"), F.floor(F.col("p_retailprice") % 40).cast("double").alias("v")))).alias("players"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, p: a + p["v"])
    every = L.enumerated(rosters, "roster", 10, base=0.5 * total("players") + 0.5 * total("starters"))
    score = F.col("base") + 0.5 * F.col("sixth.v") + F.col("captain.v")
    return every.groupBy("roster").agg(F.count("*").alias("lineups"), F.max(score).alias("best"), F.round(F.avg(score), 4).alias("mean"))
