"""Shot profiles of players and of what opponents allow, strictly before each row's cutoff (survey J12)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators.windows import dealt, micros

#: Zones and their column names.
ZONES = {"RIM": "rim", "PAINT": "paint", "MIDRANGE": "midrange", "CORNER3": "corner3", "ABOVE_BREAK3": "above_break3"}
COUNTS = ["attempts", "makes", "points", "two_pa", "three_pa", *[f"{z}_{n}" for z in ZONES.values() for n in ("attempts", "makes")], "distance"]


def profiles(shots: DataFrame, *keys: str) -> DataFrame:
    """Counts by zone for each game and shooter or side.  Shots carry x, y (cm), points and made; those without a zone (impossible places) don't count."""
    zone, made = F.col("zone"), F.col("made")
    placed = shots.withColumn("zone", X.shot_zone("x", "y", "points")).where("zone is not null")
    by_zone = [c for z, n in ZONES.items() for c in (F.count_if(zone == z).alias(f"{n}_attempts"), F.count_if((zone == z) & made).alias(f"{n}_makes"))]
    return placed.groupBy(*keys).agg(
        F.count("*").alias("attempts"), F.count_if(made).alias("makes"), F.sum(F.when(made, F.col("points")).otherwise(0)).alias("points"), F.count_if(F.col("points") == 2).alias("two_pa"), F.count_if(F.col("points") == 3).alias("three_pa"), *by_zone,
        F.sum(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")) / 100).alias("distance"),
    )


def carried(facts: DataFrame, observed: DataFrame, entity: Sequence[str], season: str, time: str, tie: str, last: Sequence[int] = (5, 10), parts: int | None = None) -> DataFrame:
    """Each fact with sums of the entity's observations strictly before it: all, of its season, and of the last k games.

    Facts and observations are one union that is shuffled once by the entity; at one instant facts stand before observations.  An entity's games
    stay in one task; ``parts`` that grow with the table bound what a task sorts.  Sums are null without observations, their numbers zero.  Facts keep their columns; those of COUNTS must not be among them.
    """
    of_facts = [c for c in facts.columns if c not in (*entity, season, time)]
    f = facts.select(*entity, season, micros(time).alias("__at"), F.lit(0).alias("__side"), F.struct(time, *of_facts).alias("__fact"))
    o = observed.select(*entity, season, micros(time).alias("__at"), F.lit(1).alias("__side"), F.col(tie).alias("__tie"), *COUNTS)
    rows = dealt(f.unionByName(o, allowMissingColumns=True), parts, entity)
    w = Window.partitionBy(*entity).orderBy("__at", "__side", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    in_season = Window.partitionBy(*entity, season).orderBy("__at", "__side", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", F.count("attempts").over(w).alias("games_before"), F.sum("attempts").over(w).alias("all_attempts"), F.max(F.when(F.col("__side") == 1, F.col("__at"))).over(w).alias("source_max_us"), *[F.sum(c).over(in_season).alias(f"season_{c}") for c in COUNTS])
    for k in last:
        near = Window.partitionBy(*entity).orderBy("games_before").rangeBetween(-(k - 1), 0)
        sums = ["attempts", *[f"{z}_attempts" for z in ZONES.values()]] if k == last[0] else ["attempts"]
        rows = rows.select("*", F.count("attempts").over(near).alias(f"last{k}_n"), *[F.sum(c).over(near).alias(f"last{k}_{c}") for c in sums])
    made = [c for c in rows.columns if c.startswith(("season_", "last", "all_")) and c != season]
    return rows.where("__side = 0").select(*entity, season, "__fact.*", "games_before", "source_max_us", *made)


def _total(parts) -> Column:
    return reduce(add, parts)


def rates(history: DataFrame, *keys: str, prefix: str = "shot_", allowed: str = "", own: bool = True) -> DataFrame:
    """The feature table of ``carried``: shares by zone, accuracy, distance and, for shooters, value, concentration, entropy and the recent change of the mix."""
    c, zones = F.col, list(ZONES.values())
    season = {z: X.ratio(c(f"season_{z}_attempts"), c("season_attempts")) for z in zones}
    recent = {z: X.ratio(c(f"last5_{z}_attempts"), c("last5_attempts")) for z in zones}
    out = {"games_before": c("games_before"), "last5_games_n": c("last5_n"), "attempts_before": c("all_attempts")}
    for z in zones:
        out |= {f"season_{z}_attempts{allowed}": c(f"season_{z}_attempts"), f"season_{z}_attempt_rate{allowed}": season[z], f"last5_{z}_attempt_rate{allowed}": recent[z], f"{z}_fg{allowed or '_pct'}": X.ratio(c(f"season_{z}_makes"), c(f"season_{z}_attempts"))}
    out[f"avg_distance{allowed}_m"] = X.ratio(c("season_distance"), c("season_attempts"))
    if own:
        out |= {"last10_games_n": c("last10_n"), "last5_attempts_n": c("last5_attempts"), "last10_attempts_n": c("last10_attempts")}
        out |= {name: X.ratio(c(f"season_{x}"), c("season_attempts")) for name, x in (("3pa_share", "three_pa"), ("2pa_share", "two_pa"), ("points_per_shot", "points"))}
        out["zone_concentration"] = _total(r * r for r in season.values())
        out["profile_entropy"] = F.when(c("season_attempts") > 0, -_total(F.when(r > 0, r * F.ln(r)).otherwise(0.0) for r in season.values()))
        out["recent_vs_season_mix_change"] = _total(F.abs(recent[z] - season[z]) for z in zones) / 2
    out["source_max_game_time_us"] = c("source_max_us")
    return history.select(*keys, *[x.alias(prefix + n) for n, x in out.items()])
