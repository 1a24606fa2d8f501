"""Leakage-safe feature tables over player-game and team-game facts.

Facts: game_id, player_id, game_time, season, units and a played flag.  Every frame ends before
the row it describes, and audit columns show the newest source row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import EWMA_ALPHA, ratio
from ..operators.windows import History, ewma

COLD_START = 10.0


def played_history(facts: DataFrame, value: str, played: str, k: int) -> DataFrame:
    """Every row with n and mean of the last ``k`` played rows before it: rows that weren't played get features but add none."""
    h = History("player_id", "game_time", "game_id")
    n = facts.withColumn("__n", F.count(F.when(F.col(played), 1)).over(h.before()))  # played rows before this one
    # the j-th played row is a source at 2j - 1; a row with n played rows before it looks back from 2n
    rows = n.withColumn("__at", 2 * F.col("__n"))
    sources = n.where(F.col(played)).select("player_id", (2 * F.col("__n") + 1).alias("__at"), F.col(value).alias("__v"))
    back = Window.partitionBy("player_id").orderBy("__at").rangeBetween(-(2 * k - 1), 0)
    both = rows.unionByName(sources, allowMissingColumns=True).withColumns({"last_k_n": F.count("__v").over(back), "last_k_avg": F.avg("__v").over(back)})
    return both.where(F.col("game_id").isNotNull()).select(*facts.columns, "last_k_n", "last_k_avg")


def baselines(facts: DataFrame, value: str, exposure: str) -> DataFrame:
    """Six transparent predictions of ``value`` for each row from what came before, with a fixed value on a cold start."""
    h, s = History("player_id", "game_time", "game_id"), History(["player_id", "season"], "game_time", "game_id")
    season, career = F.avg(value).over(s.before()), F.avg(value).over(h.before())
    last3, last5 = F.avg(value).over(h.last(3)), F.avg(value).over(h.last(5))
    rate = ratio(F.sum(value).over(h.before()), F.sum(exposure).over(h.before())) * F.avg(exposure).over(h.last(5))
    cold = F.lit(COLD_START)
    fall = lambda *c: F.coalesce(*c, career, cold)
    return facts.select(
        "game_id", "player_id", "season", value, fall(season).alias("season_avg"), fall(last3).alias("last_3"), fall(last5).alias("last_5"),
        fall(ewma(value, h, 1 - EWMA_ALPHA)).alias("ewma"), fall(rate).alias("rate_x_exposure"), (0.5 * fall(season) + 0.5 * fall(last5)).alias("blend"),
    )


def mean_of_known(*values: Column) -> Column:
    """Mean of the values that are not null."""
    known = F.array_compact(F.array(*values))
    return ratio(F.aggregate(known, F.lit(0.0), lambda a, x: a + x), F.size(known))


def team_games(facts: DataFrame, home: str, away: str, home_points: str, away_points: str) -> DataFrame:
    """Two rows for each game: each side with its points and the other's."""
    keep = ["game_id", "game_time", "season"]
    rows = F.array(
        F.struct(F.col(home).alias("team"), F.col(away).alias("opponent"), F.col(home_points).alias("points"), F.col(away_points).alias("allowed"), F.lit("HOME").alias("venue")),
        F.struct(F.col(away).alias("team"), F.col(home).alias("opponent"), F.col(away_points).alias("points"), F.col(home_points).alias("allowed"), F.lit("AWAY").alias("venue")),
    )
    return facts.select(*keep, F.explode(rows).alias("r")).select(*keep, "r.*")


def blended(parts: list[tuple[Column, float]]) -> Column:
    """Weighted mean of the parts that are known."""
    top = reduce(lambda a, b: a + b, [F.coalesce(x * w, F.lit(0.0)) for x, w in parts])
    weight = reduce(lambda a, b: a + b, [F.when(x.isNotNull(), F.lit(w)).otherwise(0.0) for x, w in parts])
    return ratio(top, weight)
