"""Windows over ordered histories, all of which end before the current row.

One set of partition and order columns is used throughout a plan, so that Spark sorts
once for all frames.  Nothing here windows over a whole table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..storage import stored

DAY = 86_400_000_000


class History:
    """Frames of an entity's rows in time order (ties by id)."""

    def __init__(self, entity: Sequence[str] | str, *order: str | Column):
        self.entity = [entity] if isinstance(entity, str) else list(entity)
        self.order = list(order)

    @property
    def rows(self) -> WindowSpec:  # made when it is used: a module may hold a History before there is a session
        return Window.partitionBy(*self.entity).orderBy(*self.order)

    def before(self) -> WindowSpec:
        return self.rows.rowsBetween(Window.unboundedPreceding, -1)

    def last(self, k: int) -> WindowSpec:
        return self.rows.rowsBetween(-k, -1)

    def displaced(self, far: int, near: int) -> WindowSpec:
        return self.rows.rowsBetween(-far, -near)

    def until(self) -> WindowSpec:
        return self.rows.rowsBetween(Window.unboundedPreceding, 0)

    def days(self, time: str, days: float) -> WindowSpec:
        """Rows of the ``days`` days before this instant, its own excluded."""
        return Window.partitionBy(*self.entity).orderBy(micros(time)).rangeBetween(-int(days * DAY), -1)

    def earlier(self, time: str) -> WindowSpec:
        """Rows strictly earlier in time (ties excluded)."""
        return Window.partitionBy(*self.entity).orderBy(micros(time)).rangeBetween(Window.unboundedPreceding, -1)


def micros(time: str | Column) -> Column:
    """Microseconds since the epoch of a timestamp with or without zone."""
    time = F.col(time) if isinstance(time, str) else time
    return F.unix_micros(time.cast("timestamp"))


def dealt(df: DataFrame, parts: int | None, by: Sequence[str]) -> DataFrame:
    """Rows dealt by their keys in this many parts, which the windows and groups behind it keep; without a number, as they are."""
    return df.repartition(parts, *by) if parts else df


def trend(x: str, history: History, k: int = 3) -> Column:
    """Mean of the last k less that of the k before them, if both are full."""
    near, far = history.last(k), history.displaced(2 * k, k + 1)
    return F.when((F.count(x).over(near) == k) & (F.count(x).over(far) == k), F.avg(x).over(near) - F.avg(x).over(far))


def ewma(x: str, history: History, decay: float) -> Column:
    """Sum of x times decay ** age over the sum of decay ** age, over the rows before.

    Rows so far back that their weight is below 2 ** -64 of the latest one's are left out: a double doesn't hold
    their part, and the frame, which a fold goes through, is bounded whatever an entity's history.
    """
    reach = max(1, math.ceil(64 * math.log(2) / -math.log(decay)))
    values = F.collect_list(F.col(x)).over(history.last(reach))
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("w"))
    return F.aggregate(values, zero, lambda s, v: F.struct((s["a"] * decay + v).alias("a"), (s["w"] * decay + 1.0).alias("w")), lambda s: F.try_divide(s["a"], s["w"]))


def beside(df: DataFrame, other: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows with what the other table has for their group; null groups match."""
    if not by:
        return df.crossJoin(F.broadcast(other))  # one row
    renamed = other.withColumnsRenamed({c: f"__{c}" for c in by})
    joined = df.join(renamed, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]))
    return joined.drop(*(f"__{c}" for c in by))


def in_parts(df: DataFrame, by: Sequence[str], x: str, descending: bool = False, parts: int = 64) -> DataFrame:
    """Rows with ``__part``, a number that rises along the order of x (nulls last) within a group: what has to be
    sorted as a whole is sorted by parts, between quantiles of x, however few groups there are."""
    levels = [(i + 1) / parts for i in range(parts - 1)]
    splits = df.groupBy(*by).agg(F.percentile_approx(x, levels, 1000).alias("__splits"))
    below = F.size(F.filter("__splits", lambda s: s < F.col(x)))
    part = F.when(F.col(x).isNull(), parts).otherwise(parts - 1 - below if descending else F.coalesce(below, F.lit(0)))
    return beside(df, splits, by).withColumn("__part", part).drop("__splits")


def _before_part(parted: DataFrame, by: Sequence[str], n: Column) -> DataFrame:
    """by, __part and __before (rows of the group's parts before it): a few rows for each group."""
    sizes = parted.groupBy(*by, "__part").agg(n.alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    return sizes.select(*by, "__part", F.coalesce(before, F.lit(0)).alias("__before"))


def in_order(df: DataFrame, *order: Column, name: str = "__at") -> DataFrame:
    """Rows with their place, from 0, in the order of the whole table, stored.

    The table is sorted in ranges of the order, tie-breakers included, so that neither one frequent value nor nulls gather
    in a task; a row's place is its place in its range plus the rows of the ranges before.
    """
    inner = F.col(name).bitwiseAND((1 << 33) - 1)  # an id has the range's number above bit 33
    table = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id()), "in-order")
    sizes = table.groupBy(F.shiftright(name, 33).alias("__range")).agg((F.max(inner) + 1).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))  # a row for each range
    offsets = F.broadcast(sizes.select("__range", F.coalesce(before, F.lit(0)).alias("__before")))
    return table.withColumn("__range", F.shiftright(name, 33)).join(offsets, "__range").withColumn(name, inner + F.col("__before")).drop("__range", "__before")


def numbered(df: DataFrame, by: Sequence[str], x: str, tie: str, name: str, descending: bool = False) -> DataFrame:
    """Row numbers from 1 within each group by x (nulls last) and tie; groups, frequent values and nulls of any size spread over ranges of the order."""
    order = F.desc_nulls_last(x) if descending else F.asc_nulls_last(x)
    out = in_order(df, *[F.col(c) for c in by], order, F.col(tie), name=name)
    if not by:
        return out.withColumn(name, F.col(name) + 1)
    first = out.groupBy(*by).agg(F.min(name).alias("__first"))
    return beside(out, first, by).withColumn(name, F.col(name) - F.col("__first") + 1).drop("__first")


def cumulated(counted: DataFrame, by: Sequence[str], x: str, n: str = "n") -> DataFrame:
    """Rows (by, x, n), one for each value, with ``upto``: how many rows of the group have this value or a smaller one; sorted in parts."""
    parted = in_parts(counted, by, x)
    inside = F.sum(n).over(Window.partitionBy(*by, "__part").orderBy(F.asc_nulls_last(x)).rowsBetween(Window.unboundedPreceding, 0))
    out = beside(parted.withColumn("__inside", inside), _before_part(parted, by, F.sum(n)), [*by, "__part"])
    return out.withColumn("upto", F.col("__inside") + F.col("__before")).drop("__inside", "__before", "__part")


def top_k(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str | None = None) -> DataFrame:
    """The first k rows of each group (Spark prunes each map task to k rows before the shuffle)."""
    name = rank or "__rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(name) <= k)
    return out if rank else out.drop(name)


def average_rank(x: str, group: Sequence[str] = ()) -> Column:
    """Rank from 1 in which ties share their mean."""
    w = Window.partitionBy(*group)
    return F.rank().over(w.orderBy(F.col(x).asc_nulls_last())) + (F.count("*").over(Window.partitionBy(*group, x)) - 1) / 2.0


def islands(df: DataFrame, entity: Sequence[str], order: Sequence[str], starts: Column, name: str = "island") -> DataFrame:
    """Numbers runs of rows: a row for which ``starts`` holds (or is null) begins a new one."""
    w = Window.partitionBy(*entity).orderBy(*order)
    return df.withColumn(name, F.sum(F.when(F.coalesce(starts, F.lit(True)), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def sessions(df: DataFrame, entity: Sequence[str], time: str, tie: str, gap_seconds: float) -> DataFrame:
    """Events with a session number; a gap of more than ``gap_seconds`` begins a session."""
    w = Window.partitionBy(*entity).orderBy(time, tie)
    gap = micros(time) - F.lag(micros(time)).over(w)
    return islands(df.withColumn("__new", gap.isNull() | (gap > gap_seconds * 1e6)), entity, [time, tie], F.col("__new"), "session").drop("__new")


def elo(games: DataFrame, season: str, order: Sequence[str], home: str, away: str, home_won: str, start: float = 1500.0, k: float = 20.0, advantage: float = 70.0) -> DataFrame:
    """Ratings of both sides before each game.  A true recurrence over a season's games, so each season
    is one group: its size is bounded by a season's fixtures, not by the table."""
    keep = [season, *order, home, away, home_won]

    def rate(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order), kind="mergesort")
        rating: dict = {}
        before = []
        for h, a, won in zip(pdf[home], pdf[away], pdf[home_won], strict=True):
            rh, ra = rating.get(h, start), rating.get(a, start)
            before.append((rh, ra))
            expected = 1 / (1 + 10 ** ((ra - rh - advantage) / 400))
            change = k * (float(bool(won)) - expected)
            rating[h], rating[a] = rh + change, ra - change
        pdf["home_elo"], pdf["away_elo"] = zip(*before, strict=True) if before else ([], [])
        return pdf

    chosen = games.select(*dict.fromkeys(keep))
    schema = ", ".join(f"`{n}` {t}" for n, t in chosen.dtypes) + ", home_elo double, away_elo double"
    return chosen.groupBy(season).applyInPandas(rate, schema)
