"""Isotonic calibration by pooling in ranges, and marginals matched to a mean.

Rows are counted by value first.  Counted values are numbered in order and pooled by chunks of
consecutive numbers; a pooled block keeps the number of its first value.  The next round deals the blocks to chunks that
are shifted by half and, every second round, twice as wide, so what two neighbours would pool over a
chunk's edge is pooled there.  When a round of either shift pools nothing, all neighbours are in order; as
pooling gives one result in any sequence, that is the fit of the whole group.  Rounds are
written tables, and a chunk holds a bounded number of values.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from .windows import beside, numbered

#: Values of a chunk; values that are expanded together.
CHUNK, SPREAD = 4096, 256


def _pool(pdf: pd.DataFrame) -> pd.DataFrame:
    """Adjacent violators of one chunk's blocks, pooled."""
    rows: list[list] = []
    for at, upto, low, w, s in pdf.sort_values("at")[["at", "upto", "low", "w", "s"]].itertuples(index=False):
        rows.append([at, upto, low, w, s])
        while len(rows) > 1 and rows[-2][4] * rows[-1][3] >= rows[-1][4] * rows[-2][3]:  # means, without division
            b = rows.pop()
            a = rows[-1]
            a[1], a[3], a[4] = b[1], a[3] + b[3], a[4] + b[4]
    out = pd.DataFrame(rows, columns=["at", "upto", "low", "w", "s"])
    return out.assign(**{c: pdf[c].iloc[0] for c in pdf.columns if c not in out.columns and c != "__chunk"})[[c for c in pdf.columns if c != "__chunk"]]


def blocks(df: DataFrame, by: Sequence[str], x: str, y: str, chunk: int = CHUNK) -> DataFrame:
    """(by, at, upto, low, w, s): the blocks of the least-squares fit of y that doesn't fall with x; rows at to upto (numbers of distinct x, from 1)
    from the value low on, with w rows and sum s.  Rows with a null x or y are left out; equal x count as one value."""
    counted = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, F.col(x).alias("low")).agg(F.count("*").cast("double").alias("w"), F.sum(F.col(y).cast("double")).alias("s"))
    now = stored(numbered(counted, by, "low", "low", "at").select(*by, "at", F.col("at").alias("upto"), "low", "w", "s"), "isotonic-values")
    n, still, shifted = now.count(), 0, False
    while still < 2 and n:
        number = F.floor((F.col("at") + (chunk // 2 if shifted else 0)) / chunk)
        schema = now.schema
        now = stored(now.withColumn("__chunk", number).groupBy(*by, "__chunk").applyInPandas(_pool, schema), "isotonic-blocks")
        left = now.count()
        still = still + 1 if left == n else 0
        n, chunk, shifted = left, chunk * 2 if shifted else chunk, not shifted
    return now


def fitted(df: DataFrame, by: Sequence[str], x: str, y: str, name: str = "fitted", chunk: int = CHUNK) -> DataFrame:
    """(by, x, name) for every distinct x of each group."""
    values = numbered(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, x).distinct(), by, x, x, "__at").withColumn("__part", F.floor(F.col("__at") / SPREAD))
    steps = blocks(df, by, x, y, chunk).select(*by, F.col("at").alias("__from"), F.col("upto").alias("__to"), (F.col("s") / F.col("w")).alias(name))
    spread = steps.withColumn("__part", F.explode(F.sequence(F.floor(F.col("__from") / SPREAD), F.floor(F.col("__to") / SPREAD))))
    return beside(values, spread, [*by, "__part"]).where(F.col("__at").between(F.col("__from"), F.col("__to"))).select(*by, x, name)


def _weights(levels: Column) -> Column:
    """What each quantile adds to the mean of the inverse CDF through (level, quantile), flat beyond its ends."""
    at = lambda i, end: F.coalesce(F.get(levels, i), F.lit(end))
    width = lambda i: (F.when(i + 1 < F.size(levels), F.get(levels, i + 1) + F.get(levels, i)).otherwise(2.0) - F.when(i > 0, F.get(levels, i) + at(i - 1, 0.0)).otherwise(0.0)) / 2
    return F.transform(F.sequence(F.lit(0), F.size(levels) - 1), width)


def curve_mean(levels: Column, quantiles: Column) -> Column:
    """Mean of the inverse CDF through (level, quantile), flat beyond its ends."""
    return F.aggregate(F.zip_with(_weights(levels), quantiles, lambda w, q: w * q), F.lit(0.0), lambda a, v: a + v)


def matched(levels: Column, quantiles: Column, mean: Column, low: float) -> Column:
    """The quantiles (ascending), moved alike and held at ``low`` from below, whose curve has this mean; null for a mean below ``low``.

    The mean rises with the shift along a convex chain of lines, one for each number of quantiles that are held; its root is the least of the
    lines' roots.
    """
    parts = F.zip_with(_weights(levels), quantiles, lambda w, q: F.struct(w.alias("w"), q.cast("double").alias("q")))
    zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("wq"), F.lit(None).cast("double").alias("s"))

    def line(a: Column, x: Column) -> Column:  # from the highest quantile down: those so far move, the others are held
        w, wq = a["w"] + x["w"], a["wq"] + x["w"] * x["q"]
        return F.struct(w.alias("w"), wq.alias("wq"), F.least(a["s"], (mean - low * (1 - w) - wq) / w).alias("s"))

    shift = F.aggregate(F.reverse(parts), zero, line, lambda a: a["s"])
    moved = F.transform(F.array(shift), lambda s: F.transform(quantiles, lambda q: F.greatest(q + s, F.lit(low))))  # the shift is computed once
    return F.when(mean >= low, F.get(moved, F.lit(0)))
