"""Event-log reconstruction: who was on court from when to when, and whether it can be believed.

A player's instants of coming in and going out are one window over (game, side, player): each IN is
paired with the next OUT, and an IN on court or an OUT off court breaks the rules.  Everything is dealt by game, so
one shuffle serves all steps, and no Python worker runs.  The audit compares stints with box minutes and accepts or
quarantines whole games; nothing is repaired.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored
from .windows import islands

#: Seconds by which box minutes and stints may differ.
TOLERANCE = 5


#: As a number of parts: the inputs are dealt by game already, all in as many parts, and stay so.
AS_DEALT = 0


def _dealt(df: DataFrame, parts: int | None) -> DataFrame:
    """Rows dealt by game, in as many parts as asked for."""
    if parts == AS_DEALT:
        return df
    return df.repartition(parts, "game") if parts else df.repartition("game")


def spans(subs: DataFrame, starters: DataFrame, length: DataFrame, size: int = 5, parts: int | None = None) -> DataFrame:
    """(game, side, reason, seconds, player, from, to): a row for each time a player comes in, of sides that break a rule too.

    subs: game, side, at (seconds from the start), player, action IN or OUT; starters: game, side, player;
    length: game, seconds.  At one instant, players who go both out and in stay.  The reason is that of the first
    instant that breaks a rule: UNBALANCED, OUT_NOT_ON_COURT, IN_ALREADY_ON_COURT, or STARTERS if there aren't ``size`` of them.  Rows with
    a null instant, player or action are no moves; repeated rows count once; sides without starters are left out.
    All is dealt once by game, in ``parts``: a number that grows with the table bounds what a task holds.  With AS_DEALT inputs that are
    dealt by game, all in as many parts, stay where they are.
    """
    known = subs.where("player is not null and at is not null").select("game", "side", F.col("at").cast("int").alias("at"), "player", (F.col("action") == "IN").alias("in"), (F.col("action") == "OUT").alias("out"))
    first = starters.where("player is not null").select("game", "side", F.lit(-1).alias("at"), "player", F.lit(True).alias("in"), F.lit(False).alias("out"))
    moves = _dealt(known.unionByName(first), parts).groupBy("game", "side", "at", "player").agg((F.max("in").cast("int") - F.max("out").cast("int")).alias("step")).where("step <> 0")
    own, side = Window.partitionBy("game", "side", "player").orderBy("at"), Window.partitionBy("game", "side")
    moves = moves.withColumn("net", F.sum("step").over(Window.partitionBy("game", "side", "at"))).withColumn("on", F.coalesce(F.sum("step").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("next", F.lead("at").over(own))
    subbed = F.col("at") >= 0
    rank = F.when(subbed & (F.col("net") != 0), 1).when(subbed & (F.col("step") < 0) & (F.col("on") < 1), 2).when(subbed & (F.col("step") > 0) & (F.col("on") > 0), 3)
    broken = F.col("at").cast("long") * 4 + rank  # the first instant, then the least rank
    moves = moves.withColumns({"first": F.count_if(~subbed).over(side), "broken": F.min(broken).over(side)}).where("first > 0 and step > 0")
    reason = F.when(F.col("first") != size, "STARTERS").otherwise(F.get(F.array(F.lit("UNBALANCED"), F.lit("OUT_NOT_ON_COURT"), F.lit("IN_ALREADY_ON_COURT")), (F.col("broken") % 4 - 1).cast("int")))
    timed = moves.select("game", "side", reason.alias("reason"), "player", F.greatest("at", F.lit(0)).alias("from"), "next").join(length.select("game", F.col("seconds").cast("int").alias("seconds")), "game")
    return timed.select("game", "side", "reason", "seconds", "player", "from", F.coalesce("next", "seconds").alias("to"))


def gathered(rows: DataFrame) -> DataFrame:
    """``sides`` of ``spans``."""
    came = F.when(F.col("reason").isNull() & (F.col("from") < F.col("to")), F.struct("player", "from", "to"))
    return rows.groupBy("game", "side").agg(F.max("reason").alias("reason"), F.max("seconds").alias("seconds"), F.collect_list(came).alias("stints"))


def sides(subs: DataFrame, starters: DataFrame, length: DataFrame, size: int = 5, parts: int | None = None) -> DataFrame:
    """(game, side, reason, seconds, stints): each side with its players' stints (player, from, to), or none and the reason; inputs as for ``spans``."""
    return gathered(spans(subs, starters, length, size, parts))


def stints(known: DataFrame) -> DataFrame:
    """(game, side, player, from, to) of the stints of ``sides`` or ``spans``."""
    if "stints" not in known.columns:
        return known.where("reason is null and from < to").select("game", "side", "player", "from", "to")
    return known.select("game", "side", F.explode("stints").alias("x")).select("game", "side", "x.player", "x.from", "x.to")


def intervals(known: DataFrame) -> DataFrame:
    """(game, side, reason, from, to, court) of every interval between changes of ``sides``; a side with a reason gives one row without an interval."""
    edges = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0)), F.transform("stints", lambda x: x["from"]), F.transform("stints", lambda x: x["to"]))))
    out = known.withColumn("edges", edges)
    court = lambda a, z: F.array_sort(F.transform(F.filter("stints", lambda x: (x["from"] <= a) & (x["to"] >= z)), lambda x: x["player"]))
    spans = F.transform(F.slice("edges", F.lit(1), F.size("edges") - 1), lambda a, i: F.struct(a.alias("from"), F.get("edges", i + 1).alias("to"), court(a, F.get("edges", i + 1)).alias("court")))
    return out.select("game", "side", "reason", F.explode_outer(spans).alias("x")).select("game", "side", "reason", "x.from", "x.to", "x.court").where("reason is not null or from is not null")


def lineups(subs: DataFrame, starters: DataFrame, length: DataFrame, size: int = 5) -> DataFrame:
    """``intervals`` of ``sides``."""
    return intervals(sides(subs, starters, length, size))


def minute_audit(known: DataFrame, box: DataFrame, tolerance: int = TOLERANCE, parts: int | None = None) -> DataFrame:
    """(game, player, official_seconds, reconstructed_seconds, difference_seconds, within_tolerance) of every box row of a game without a reason.

    known: ``sides`` or ``spans``; box: game, player, seconds; a player without stints has 0, and repeated rows of a player count once, with the most seconds.
    """
    game = Window.partitionBy("game")
    g = _compared(known, box, parts).withColumns({"known": F.max("known").over(game), "reasons": F.count("reason").over(game)}).where("known and reasons = 0 and official_seconds is not null")
    apart = F.col("reconstructed_seconds") - F.col("official_seconds")
    return g.select("game", "player", "official_seconds", "reconstructed_seconds", apart.alias("difference_seconds"), (F.abs(apart) <= tolerance).alias("within_tolerance"))


def _compared(known: DataFrame, box: DataFrame, parts: int | None) -> DataFrame:
    """(game, player, reason, reconstructed_seconds, official_seconds, known): stints and box rows by one union, dealt once by game.

    A player of a side with a reason has a row of its own for it; box rows stand with those without one."""
    if "stints" in known.columns:
        known = known.select("game", "reason", F.explode_outer("stints").alias("x")).select("game", "reason", "x.player", "x.from", "x.to")
    seconds = F.when(F.col("reason").isNull() & (F.col("from") < F.col("to")), F.col("to") - F.col("from")).otherwise(0)
    played = known.select("game", "player", "reason", seconds.alias("played"), F.lit(None).cast("int").alias("official"), F.lit(True).alias("known"))
    listed = box.select("game", "player", F.lit(None).cast("string").alias("reason"), F.lit(0).alias("played"), F.col("seconds").cast("int").alias("official"), F.lit(False).alias("known"))
    return _dealt(played.unionByName(listed), parts).groupBy("game", "player", "reason").agg(F.sum("played").cast("int").alias("reconstructed_seconds"), F.max("official").alias("official_seconds"), F.max("known").alias("known"))


def game_audit(known: DataFrame, box: DataFrame, tolerance: int = TOLERANCE, parts: int | None = None) -> DataFrame:
    """One row for each game: whether it was reconstructed and is usable, the reasons of its quarantine (sorted, joined by |), how many box rows
    agree exactly, within the tolerance and not, and the largest and total absolute error."""
    apart = F.abs(F.col("reconstructed_seconds") - F.col("official_seconds"))
    figures = {
        "player_rows": F.count("official_seconds"), "exact_player_rows": F.count_if(apart == 0), "near_exact_player_rows": F.count_if(apart <= tolerance), "outside_tolerance_player_rows": F.count_if(apart > tolerance),
        "maximum_absolute_error_seconds": F.max(apart).cast("long"), "total_absolute_error_seconds": F.sum(apart),
    }
    game = _compared(known, box, parts).groupBy("game").agg(F.max("known").alias("known"), F.collect_set("reason").alias("reasons"), *[x.alias(c) for c, x in figures.items()]).where("known")
    whole = F.size("reasons") == 0
    game = game.withColumns({c: F.coalesce(F.when(whole, F.col(c)), F.lit(0).cast("long")) for c in figures})  # a game with a reason isn't compared
    outside = F.col("outside_tolerance_player_rows") > 0
    reasons = F.array_sort(F.when(outside, F.array_append("reasons", F.lit("PLAYER_MINUTES_OUTSIDE_TOLERANCE"))).otherwise(F.col("reasons")))
    return game.select("game", whole.alias("structurally_reconstructed"), (whole & ~outside).alias("rotation_usable"), F.when(F.size(reasons) > 0, F.array_join(reasons, "|")).alias("quarantine_reason"), *figures)


def accepted(known: DataFrame, box: DataFrame, tolerance: int = TOLERANCE, parts: int | None = None) -> DataFrame:
    """``sides`` or ``spans`` of the usable games alone."""
    known = stored(known, "sides")
    return known.join(game_audit(known, box, tolerance, parts).where("rotation_usable").select("game"), "game", "left_semi")


def player_stints(intervals: DataFrame) -> DataFrame:
    """(game, side, player, stint, from, to): a player's intervals that touch are one stint."""
    p = intervals.where("reason is null").select("game", "side", F.explode("court").alias("player"), "from", "to")
    w = Window.partitionBy("game", "side", "player").orderBy("from")
    marked = islands(p.withColumn("new", ~F.col("from").eqNullSafe(F.lag("to").over(w))), ["game", "side", "player"], ["from"], F.col("new"), "stint")
    return marked.groupBy("game", "side", "player", "stint").agg(F.min("from").alias("from"), F.max("to").alias("to"))


#: What a play counts as and the points it makes.
PLAYS = {"fga": ("2FGM", "2FGA", "3FGM", "3FGA"), "oreb": ("O",), "turnovers": ("TO",), "fta": ("FTM", "FTA")}
POINTS = {"2FGM": 2, "3FGM": 3, "FTM": 1}


def possessions(intervals: DataFrame, plays: DataFrame) -> DataFrame:
    """Intervals (game, side, from, to) with fga, oreb, turnovers, fta, points, own and opponent's possessions and their mean.

    plays: game, at, team (a side), play.  A play at the instant of a substitution belongs to the lineup before it, one at second 0
    to the first lineup.  A game's plays come as one array of a few hundred.
    """
    held = plays.groupBy("game").agg(F.collect_list(F.struct("at", "team", "play")).alias("__plays"))
    within = F.filter("__plays", lambda e: ((e["at"] > F.col("from")) & (e["at"] <= F.col("to"))) | ((e["at"] == 0) & (F.col("from") == 0)))
    j = intervals.where("reason is null").join(held, "game", "left").withColumn("__in", F.coalesce(within, F.array().cast("array<struct<at:int, team:string, play:string>>")))
    of = lambda own, kinds: F.size(F.filter("__in", lambda e: (e["team"] == F.col("side") if own else e["team"] != F.col("side")) & e["play"].isin(*kinds)))
    count = lambda own: of(own, PLAYS["fga"]) - of(own, PLAYS["oreb"]) + of(own, PLAYS["turnovers"]) + 0.44 * of(own, PLAYS["fta"])
    points = sum((n * of(True, (k,)) for k, n in POINTS.items()), F.lit(0))
    out = j.select("game", "side", "from", "to", *[of(True, kinds).alias(k) for k, kinds in PLAYS.items()], points.alias("points"), count(True).alias("own"), count(False).alias("against"))
    return out.withColumn("game_possessions", (F.col("own") + F.col("against")) / 2)
