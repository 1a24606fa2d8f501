"""Walk-forward ridge from moments, joint scenarios of independent branches, all pairs of columns."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import beside


def walk_forward_ridge(df: DataFrame, season: str, features: Sequence[str], y: str, penalty: float) -> DataFrame:
    """(season, trained, intercept, weights): for each season the ridge fit of all seasons before it.

    One aggregate gives the moments of each season (counts, sums, products); the moments of the seasons before are their running sums, a row
    for each season, so all fits are one pass over the rows.  Features are centred, and ``penalty`` times the rows is added to their squares.
    Rows with a null feature or outcome are left out; a season without two earlier rows has null weights.
    """
    names = [*features, y]
    known = df.where(" and ".join(f"{c} is not null" for c in names))
    one = [F.count("*").cast("double").alias("n"), *[F.sum(F.col(c).cast("double")).alias(f"s_{i}") for i, c in enumerate(names)]]
    two = [F.sum(F.col(a).cast("double") * F.col(b)).alias(f"p_{i}_{j}") for (i, a), (j, b) in combinations(enumerate([*names, None]), 2) if b] + [F.sum(F.col(c).cast("double") * F.col(c)).alias(f"p_{i}_{i}") for i, c in enumerate(names)]
    moments = known.groupBy(season).agg(*one, *two)
    every = df.select(season).where(F.col(season).isNotNull()).distinct().join(moments, season, "left")
    before = Window.orderBy(season).rowsBetween(Window.unboundedPreceding, -1)  # a row for each season
    sums = every.select(season, *[F.coalesce(F.sum(c).over(before), F.lit(0.0)).alias(c) for c in moments.columns if c != season])
    k = len(features)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for _, r in b.iterrows():
                n = r["n"]
                if n < 2:
                    rows.append((r[season], int(n), None, None))
                    continue
                mean = np.array([r[f"s_{i}"] for i in range(k + 1)]) / n
                square = np.array([[r[f"p_{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)]) / n - np.outer(mean, mean)
                w = np.linalg.solve(square[:k, :k] + penalty * np.eye(k), square[:k, k])
                rows.append((r[season], int(n), float(mean[k] - w @ mean[:k]), w.tolist()))
            yield pd.DataFrame(rows, columns=[season, "trained", "intercept", "weights"])

    kind = df.schema[season].dataType.simpleString()
    return sums.mapInPandas(solve, f"`{season}` {kind}, trained long, intercept double, weights array<double>")


def predicted(df: DataFrame, fits: DataFrame, season: str, features: Sequence[str], name: str = "predicted") -> DataFrame:
    """Rows with the prediction of their season's fit; null where there is none or a feature is null."""
    x = sum((F.get("weights", F.lit(i)) * F.col(c) for i, c in enumerate(features)), F.col("intercept"))
    return beside(df, fits.select(season, "intercept", "weights"), [season]).withColumn(name, x).drop("intercept", "weights")


def joint_scenarios(df: DataFrame, group: Sequence[str], member: str, out_probability: str, k: int) -> DataFrame:
    """(group, scenario, probability, outs, left_out): the k likeliest joint outcomes of independent members who are out or not.

    Members are folded in one after another; as branches are independent, the k likeliest outcomes of some of them are all that
    the k likeliest of one more can be made of, so never more than 2 k are held.  Certain members (0 or 1) don't branch; probabilities
    are cut to 0 and 1, null ones are 0.  outs: the ids that are out, ascending, as strings; equal probabilities come in their order.
    left_out: the probability of all other outcomes.  A group's members come as one array (a team's players).
    """
    p = F.coalesce(F.least(F.greatest(F.col(out_probability).cast("double"), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    teams = df.where(F.col(member).isNotNull()).groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(F.col(member).cast("string").alias("id"), p.alias("p")))).alias("members"))
    kind = "array<struct<less: double, outs: array<string>>>"  # the probability is negative, so that the order rises

    def fold(state: Column, m: Column) -> Column:
        stay = F.transform(state, lambda s: F.struct((s["less"] * (1 - m["p"])).alias("less"), s["outs"].alias("outs")))
        out = F.transform(state, lambda s: F.struct((s["less"] * m["p"]).alias("less"), F.array_append(s["outs"], m["id"]).alias("outs")))
        return F.slice(F.array_sort(F.filter(F.concat(stay, out), lambda s: s["less"] < 0)), 1, k).cast(kind)

    start = F.array(F.struct(F.lit(-1.0).alias("less"), F.array().cast("array<string>").alias("outs"))).cast(kind)
    found = teams.select(*group, F.explode(F.array(F.aggregate("members", start, fold))).alias("found"))
    mass = F.aggregate("found", F.lit(1.0), lambda a, s: a + s["less"])
    rows = found.select(*group, mass.alias("left_out"), F.posexplode("found").alias("place", "s"))
    return rows.select(*group, (F.col("place") + 1).alias("scenario"), (-F.col("s.less")).alias("probability"), "s.outs", "left_out")


def _moments(columns: Sequence[str]):
    """Tables of columns to a row for each pair: n, means and sums of squares and products about them, lows and highs, over rows that know both."""
    pairs = list(combinations(range(len(columns)), 2))

    def read(tables):
        total = None
        for table in tables:
            x = np.column_stack([np.array(table[c].to_numpy(zero_copy_only=False), dtype=float) for c in columns]) if table.num_rows else np.empty((0, len(columns)))
            null = np.column_stack([table[c].is_null().to_numpy(zero_copy_only=False) for c in columns]) if table.num_rows else np.empty((0, len(columns)), bool)
            rows = []
            for i, j in pairs:
                known = ~(null[:, i] | null[:, j])
                a, b = (x[:, i], x[:, j]) if known.all() else (x[known, i], x[known, j])
                if not len(a):
                    rows.append([0.0] * 6 + [np.inf, -np.inf] * 2)
                    continue
                ma, mb = a[0] + (a - a[0]).mean(), b[0] + (b - b[0]).mean()
                da, db = a - ma, b - mb
                rows.append([len(a), ma, mb, da @ da, db @ db, da @ db, a.min(), a.max(), b.min(), b.max()])
            total = np.array(rows) if total is None else _merged(total, np.array(rows))
        if total is not None:
            names = ["a", "b", "n", "ma", "mb", "saa", "sbb", "sab", "la", "ha", "lb", "hb"]
            yield pa.RecordBatch.from_arrays([pa.array([columns[i] for i, _ in pairs]), pa.array([columns[j] for _, j in pairs]), pa.array(total[:, 0].astype("int64")), *map(pa.array, total[:, 1:].T)], names=names)

    return read


def _merged(s, t):
    """Moments of two sets of rows as those of their union."""
    n = s[:, 0] + t[:, 0]
    part = np.divide(t[:, 0], n, out=np.zeros_like(n), where=n > 0)
    d = t[:, 1:3] - s[:, 1:3]
    across = (s[:, 0] * part)[:, None] * np.column_stack([d[:, 0] * d[:, 0], d[:, 1] * d[:, 1], d[:, 0] * d[:, 1]])
    return np.column_stack([n, s[:, 1:3] + d * part[:, None], s[:, 3:6] + t[:, 3:6] + across, np.minimum(s[:, 6], t[:, 6]), np.maximum(s[:, 7], t[:, 7]), np.minimum(s[:, 8], t[:, 8]), np.maximum(s[:, 9], t[:, 9])])


def correlations(df: DataFrame, columns: Sequence[str], near: float = 0.98) -> DataFrame:
    """(a, b, n, r, near_duplicate) of all pairs of columns; nulls are left out pair by pair, and r is null without two different values.

    Each task gives the moments of its own rows, a row for each pair; those few rows are merged about their common mean.
    """
    kinds = "a string, b string, n long, ma double, mb double, saa double, sbb double, sab double, la double, ha double, lb double, hb double"
    own = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).mapInArrow(lambda batches: _moments(list(columns))(batches), kinds)
    w = Window.partitionBy("a", "b")  # a row for each task
    mean = lambda m: F.try_divide(F.sum(F.col("n") * F.col(m)).over(w), F.sum("n").over(w))
    parts = own.withColumns({"da": F.col("ma") - mean("ma"), "db": F.col("mb") - mean("mb")})
    total = lambda s, x, y: F.sum(F.when(F.col("n") > 0, F.col(s) + F.col("n") * F.col(x) * F.col(y)))
    sums = parts.groupBy("a", "b").agg(F.sum("n").alias("n"), total("saa", "da", "da").alias("saa"), total("sbb", "db", "db").alias("sbb"), total("sab", "da", "db").alias("sab"), ((F.min("la") < F.max("ha")) & (F.min("lb") < F.max("hb"))).alias("apart"))
    r = F.when(F.col("apart"), F.try_divide(F.col("sab"), F.sqrt("saa") * F.sqrt("sbb")))
    return sums.select("a", "b", "n", r.alias("r")).withColumn("near_duplicate", F.coalesce(F.abs("r") >= near, F.lit(False)))
