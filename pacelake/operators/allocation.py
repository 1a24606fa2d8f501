"""Bounded allocation and roster choice."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def simplex_shift(raw: Column, total: Column, low: float, high: float, steps: int = 60) -> Column:
    """The shift s for which the sum of clip(raw + s, low, high) is ``total``, by bisection; null if out of reach."""
    at = lambda s: F.aggregate(raw, F.lit(0.0), lambda a, x: a + F.least(F.greatest(x + s, F.lit(low)), F.lit(high)))
    start = F.struct((F.lit(low) - F.array_max(raw)).alias("a"), (F.lit(high) - F.array_min(raw)).alias("z"))

    def halve(b: Column, _: Column) -> Column:
        mid = (b["a"] + b["z"]) / 2
        more = at(mid) < total
        return F.struct(F.when(more, mid).otherwise(b["a"]).alias("a"), F.when(more, b["z"]).otherwise(mid).alias("z"))

    inside = (total >= F.size(raw) * low) & (total <= F.size(raw) * high)
    return F.when(inside, F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda b: (b["a"] + b["z"]) / 2))


def project_to_total(df: DataFrame, group: Sequence[str], member: str, raw: str, total: float, low: float, high: float, name: str = "projected") -> DataFrame:
    """(group, member, name): the nearest bounded values that sum to ``total`` in each group (a team's players)."""
    g = df.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct(member, F.col(raw).cast("double").alias("raw")))).alias("m"))
    g = g.withColumn("raws", F.transform("m", lambda x: x["raw"])).withColumn("shift", simplex_shift(F.col("raws"), F.lit(float(total)), low, high))
    return g.where("shift is not null").select(*group, "shift", F.explode("m").alias("x")).select(*group, F.col(f"x.{member}").alias(member), F.least(F.greatest(F.col("x.raw") + F.col("shift"), F.lit(low)), F.lit(high)).alias(name))


def contenders(pool: DataFrame, slate: str, counts: dict[str, int]) -> DataFrame:
    """The pool without players that no best roster needs.

    A player goes if as many players of the same slate, position and club as a roster has of that position
    are worth as much and cost no more: one of them is free to take the player's place.  Of one
    price only so many are kept first, so what is left of a group is bounded by the number of prices.
    """
    need = F.element_at(F.create_map(*[F.lit(x) for kv in counts.items() for x in kv]), F.col("position"))
    group = [slate, "position", "club"]
    order = [F.desc("value"), F.col("player")]
    known = pool.where(F.col("position").isin(*counts))
    level = known.withColumn("__cost", F.rint(F.col("credits") * 10)).withColumn("__k", F.row_number().over(Window.partitionBy(*group, "__cost").orderBy(*order))).where(F.col("__k") <= need)
    better = F.collect_list("__cost").over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    cheaper = F.size(F.filter(better, lambda c: c <= F.col("__cost")))
    return level.withColumn("__cheaper", cheaper).where(F.col("__cheaper") < need).select(*pool.columns)


def rosters(pool: DataFrame, slate: str, counts: dict[str, int], budget: float, club_limit: int) -> DataFrame:
    """(slate, player, position, club, credits, value) of each slate's best roster; a slate's contenders are one group, of a
    size that positions, clubs and prices bound, not the pool."""
    schema = pool.select(slate, "player", "position", "club", "credits", "value").schema

    from .lineups import best_players

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("player").reset_index(drop=True)
        return pdf.iloc[best_players(pdf, counts, budget, club_limit)]

    return contenders(pool.select(*schema.names), slate, counts).groupBy(slate).applyInPandas(solve, schema)


def lineup_score(roster: DataFrame, group: Sequence[str], score: str, role: str) -> DataFrame:
    """Starters and sixth count once, bench half, the captain once more."""
    weight = F.when(F.col(role) == "CAPTAIN", 2.0).when(F.col(role).isin("STARTER", "SIXTH"), 1.0).otherwise(0.5)
    return roster.groupBy(*group).agg(F.sum(F.col(score) * weight).alias("score"))
