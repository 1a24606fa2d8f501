"""What is decided before a round: preparation context, the round a market belongs to, turn rules, thresholds."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import clip, ratio
from .windows import dealt

#: Weights of games outside the competition, the half-life of a game in days, and the largest share they have.
GAME_WEIGHTS = {"FRIENDLY": 0.20, "PRESEASON_TOURNAMENT": 0.30, "SUPERCUP": 0.65, "DOMESTIC_OFFICIAL": 0.75}
HALF_LIFE, LARGEST_SHARE = 21.0, 0.50


def preparation(games: DataFrame, player: str, time: str, tie: str, cutoff: Column, days: int = 60, last: int = 5) -> DataFrame:
    """(player, prep_games, prep_weight, prep_minutes, prep_starter_rate, prep_rate) from a player's last games before ``cutoff``.

    games: player, time, tie, kind (of ``GAME_WEIGHTS``; others don't count), minutes, starter, points.  Weights fall by half every
    three weeks; a rate takes games of 5 minutes and more.  A player without such games has no row.
    """
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in GAME_WEIGHTS.items() for x in kv]), F.col("kind"))
    near = games.where(F.col("kind").isin(*GAME_WEIGHTS) & (F.col(time) < cutoff) & (F.col(time) >= cutoff - F.expr(f"INTERVAL {days} DAY")))
    order = Window.partitionBy(player).orderBy(F.desc(time), F.desc(tie))
    age = (F.unix_micros(cutoff.cast("timestamp")) - F.unix_micros(F.col(time).cast("timestamp"))) / 86_400_000_000.0
    kept = near.withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= last).withColumn("__w", weight * F.pow(F.lit(2.0), -age / HALF_LIFE))
    mean = lambda x: ratio(F.sum(F.col("__w") * x), F.sum(F.when(x.isNotNull(), F.col("__w"))))
    rate = F.when(F.col("minutes") >= 5, F.col("points") / F.col("minutes"))
    return kept.groupBy(player).agg(
        F.count("*").alias("prep_games"), F.least(F.lit(LARGEST_SHARE), LARGEST_SHARE * F.sum("__w")).alias("prep_weight"), mean(F.col("minutes")).alias("prep_minutes"), mean(F.col("starter")).alias("prep_starter_rate"), mean(rate).alias("prep_rate"),
    )


def with_preparation(df: DataFrame) -> DataFrame:
    """Baselines (baseline minutes, rate, starter_rate) moved towards preparation by its weight: minutes within 0 and 40, points a
    minute by 0.5 at most, points by 5 at most."""
    w = F.when(F.col("baseline").isNotNull() & F.col("prep_minutes").isNotNull(), clip(F.coalesce("prep_weight", F.lit(0.0)), 0.0, LARGEST_SHARE)).otherwise(0.0)
    adjusted = clip(F.col("baseline") + w * F.coalesce(F.col("prep_minutes") - F.col("baseline"), F.lit(0.0)), 0.0, 40.0)
    out = df.withColumns({"prep_weight": w, "adjusted": adjusted})
    out = out.withColumn("minutes_delta", F.col("adjusted") - F.col("baseline"))
    form = F.coalesce(clip(F.col("prep_rate") - F.col("rate"), -0.5, 0.5), F.lit(0.0)) * F.col("prep_weight") * F.col("adjusted")
    known = F.col("prep_starter_rate").isNotNull() & (F.col("prep_weight") > 0)
    starter = F.when(known, (1 - F.col("prep_weight")) * F.coalesce("starter_rate", F.lit(0.5)) + F.col("prep_weight") * F.col("prep_starter_rate")).otherwise(F.col("starter_rate"))
    change = F.when(F.col("minutes_delta") >= 0.5, "TRENDING UP").when(F.col("minutes_delta") <= -0.5, "TRENDING DOWN").otherwise("STABLE")
    points = clip(F.coalesce(F.col("minutes_delta") * F.col("rate") + F.coalesce(form, F.lit(0.0)), F.lit(0.0)), -5.0, 5.0)
    return out.withColumns({"expected_starter_rate": starter, "points_delta": points, "role_change": change})


def matchday(market: DataFrame, slate: DataFrame, mapping: DataFrame, schedule: DataFrame, scope: str) -> DataFrame:
    """(scope, status, matchday, round, method) of each scope with a market.

    market: scope, batch, observed, matchday, team, opponent; slate: scope, round, team, opponent; mapping: scope, matchday, round,
    validated; schedule: scope, round, home, away.  The latest batch counts (ties by batch).  It has to name one matchday; that is tied to
    the slate's round by a validated mapping to this round alone, or by two and more pairs of opponents that are all on the slate, or
    that hold the slate's pairs and are all in the schedule of this round and of no other.  A scope's pairs are few: a league's teams.
    """
    pair = lambda a, b: F.concat_ws("|", F.col(a).cast("string"), F.col(b).cast("string"))
    both = F.col("team").isNotNull() & F.col("opponent").isNotNull()
    batches = market.groupBy(scope, "batch").agg(F.max("observed").alias("observed"), F.sort_array(F.collect_set("matchday")).alias("days"), F.collect_set(F.when(both, pair("team", "opponent"))).alias("pairs"))
    m = batches.groupBy(scope).agg(F.max_by(F.struct("days", "pairs"), F.struct("observed", "batch")).alias("b")).select(scope, F.when(F.size("b.days") == 1, F.col("b.days")[0]).alias("matchday"), "b.pairs")
    on = slate.groupBy(scope).agg(F.collect_set("round").alias("rounds"), F.collect_set(pair("team", "opponent")).alias("slate_pairs")).select(scope, F.when(F.size("rounds") == 1, F.col("rounds")[0]).alias("round"), "slate_pairs")
    direct = mapping.where("validated").groupBy(scope, "matchday").agg(F.collect_set("round").alias("direct"))
    days = schedule.where("round is not null").groupBy(scope, "round").agg(F.array_union(F.collect_set(pair("home", "away")), F.collect_set(pair("away", "home"))).alias("p"))
    fixtures = days.groupBy(scope).agg(F.collect_list(F.struct("round", "p")).alias("fixtures"))
    j = m.join(on, scope, "left").join(direct, [scope, "matchday"], "left").join(fixtures, scope, "left")
    within = lambda a, b: F.size(F.array_except(a, b)) == 0
    fitting = F.transform(F.filter("fixtures", lambda f: within(F.col("pairs"), f["p"])), lambda f: f["round"])
    enough, has = F.size("pairs") >= 2, F.size("slate_pairs") > 0
    found = F.col("matchday").isNotNull() & F.col("round").isNotNull()
    context = enough & has & (within(F.col("pairs"), F.col("slate_pairs")) | (within(F.col("slate_pairs"), F.col("pairs")) & (F.size(fitting) == 1) & (F.get(fitting, F.lit(0)) == F.col("round"))))
    method = F.when(found & (F.size("direct") == 1) & (F.get("direct", F.lit(0)) == F.col("round")), "DIRECT").when(found & context, "CONTEXT")
    return j.select(scope, "matchday", "round", method.alias("method")).select(scope, F.when(F.col("method").isNull(), "AMBIGUOUS").otherwise("RESOLVED").alias("status"), "matchday", "round", "method")


def transition_breaks(before: str, after: str, played: str) -> Column:
    """Reasons, joined by |, why a lineup (struct of players, coach, sixth, captain, starters) can't follow another between turns."""
    b, a, gone = F.col(before), F.col(after), F.col(played)
    same = (F.size(F.array_except(b["players"], a["players"])) == 0) & (F.size(F.array_except(a["players"], b["players"])) == 0) & b["coach"].eqNullSafe(a["coach"])
    rules = {
        "TRADE": ~same, "SIXTH": ~b["sixth"].eqNullSafe(a["sixth"]), "PROMOTED": F.arrays_overlap(F.array_except(a["starters"], b["starters"]), gone),
        "CAPTAIN_PLAYED": (a["captain"] != b["captain"]) & F.array_contains(gone, a["captain"]), "CAPTAIN_BENCHED": ~F.array_contains(a["starters"], a["captain"]),
    }
    return F.concat_ws("|", *[F.when(c, F.lit(n)) for n, c in rules.items()])


def threshold(low: Column, high: Column, acts: Callable[[Column], Column], steps: int = 28) -> Column:
    """The value between low and high at which ``acts`` turns from true to false, by bisection; null if it doesn't turn so."""

    def halve(b: Column, _: Column) -> Column:
        mid = (b["a"] + b["z"]) / 2
        up = acts(mid)
        return F.struct(F.when(up, mid).otherwise(b["a"]).alias("a"), F.when(up, b["z"]).otherwise(mid).alias("z"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(low.cast("double").alias("a"), high.cast("double").alias("z")), halve, lambda b: (b["a"] + b["z"]) / 2)
    return F.when(acts(low) & ~acts(high), found)


def outside_lineups(actors: DataFrame, intervals: DataFrame, game: Sequence[str] = ("game", "side"), parts: int | None = None) -> DataFrame:
    """Actors (game, side, at, player) with ``inside``: whether the player is on court up to this instant or from it on; a game's few intervals
    come as one array."""
    courts = intervals.where("reason is null").groupBy(*game).agg(F.collect_list(F.struct("from", "to", "court")).alias("__courts"))
    there = F.exists("__courts", lambda c: (c["from"] <= F.col("at")) & (F.col("at") <= c["to"]) & F.array_contains(c["court"], F.col("player")))
    return dealt(actors, parts, game).join(dealt(courts, parts, game), list(game)).withColumn("inside", there).drop("__courts")
