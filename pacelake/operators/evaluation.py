"""Evaluation: errors, ranks, quantiles, intervals, probabilities, calibration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored
from .windows import beside, cumulated


def correlation(x: str, y: str) -> Column:
    """Pearson's r over rows where both are known; null where one is constant, for which ``corr`` divides by zero."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def error_metrics(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """n, mae, rmse, bias, pearson of each group."""
    e = F.col(p) - F.col(y)
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"), correlation(y, p).alias("pearson"))


def spearman(df: DataFrame, y: str, p: str, by: Sequence[str]) -> DataFrame:
    """Correlation of ranks within each group; ties share their mean rank.

    Rows are counted by both values; ranks are counted by value, in parts, and taken about their mean.
    """
    pairs = stored(df.groupBy(*by, y, p).agg(F.count("*").alias("n")), "rank-pairs")
    size = pairs.groupBy(*by).agg(F.sum("n").alias("__size"))

    def ranks(x: str, name: str) -> DataFrame:
        c = cumulated(pairs.groupBy(*by, x).agg(F.sum("n").alias("n")), by, x)
        return c.select(*by, x, (F.col("upto") - (F.col("n") - 1) / 2.0).alias(name))

    r = beside(beside(beside(pairs, ranks(y, "__a"), [*by, y]), ranks(p, "__b"), [*by, p]), size, by)
    a, b = (F.col(c) - (F.col("__size") + 1) / 2.0 for c in ("__a", "__b"))
    total = lambda v: F.sum(F.col("n") * v)
    return r.groupBy(*by).agg(F.try_divide(total(a * b), F.sqrt(total(a * a)) * F.sqrt(total(b * b))).alias("spearman"))


def order_quantile(df: DataFrame, by: Sequence[str], x: str, q: float, name: str = "q") -> DataFrame:
    """The ceil((n + 1) q)-th smallest value of each group, within its range: no interpolation.  Values are counted, no group is gathered."""
    counted = stored(df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count("*").alias("n")), "counted-values")
    size = counted.groupBy(*by).agg(F.sum("n").alias("__size"))
    c = beside(cumulated(counted, by, x), size, by)
    need = F.least(F.greatest(F.ceil((F.col("__size") + 1) * F.lit(q)), F.lit(1)), F.col("__size"))
    return c.where(F.col("upto") >= need).groupBy(*by).agg(F.min(x).alias(name))


def pinball(y: str, quantile: str, level: float) -> Column:
    e = F.col(y) - F.col(quantile)
    return F.greatest(e * level, e * (level - 1))


def interval_score(y: str, low: str, high: str, alpha: float) -> Column:
    y, low, high = F.col(y), F.col(low), F.col(high)
    return (high - low) + F.lit(2 / alpha) * F.greatest(low - y, F.lit(0.0)) + F.lit(2 / alpha) * F.greatest(y - high, F.lit(0.0))


def weighted_interval_score(y: str, median: str, intervals: Sequence[tuple[str, str, float]]) -> Column:
    total, weights = F.lit(0.5) * F.abs(F.col(y) - F.col(median)), 0.5
    for low, high, alpha in intervals:
        total = total + F.lit(alpha / 2) * interval_score(y, low, high, alpha)
        weights += alpha / 2
    return total / F.lit(weights)


def brier(y: str, p: str) -> Column:
    return F.avg((F.col(p) - F.col(y)) * (F.col(p) - F.col(y)))


def log_loss(y: str, p: str, floor: float = 1e-6) -> Column:
    p = F.least(F.greatest(F.col(p), F.lit(floor)), F.lit(1 - floor))
    return -F.avg(F.when(F.col(y) == 1, F.ln(p)).otherwise(F.ln(1 - p)))


def auc(df: DataFrame, y: str, p: str, by: Sequence[str]) -> DataFrame:
    """Area under the ROC curve by mean ranks within each group; null unless both classes are there.  Scores are counted, ranks are counted in parts."""
    counted = stored(df.groupBy(*by, p).agg(F.count("*").alias("n"), F.count_if(F.col(y) == 1).alias("a"), F.count_if(F.col(y) == 0).alias("b")), "counted-scores")
    rank = F.col("upto") - (F.col("n") - 1) / 2.0
    r = cumulated(counted, by, p).groupBy(*by).agg(F.sum(rank * F.col("a")).alias("s"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    return r.select(*by, F.try_divide(F.col("s") - F.col("a") * (F.col("a") + 1) / 2.0, (F.col("a") * F.col("b")).cast("double")).alias("auc"))


def calibration_bins(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """n, mean prediction and share of ones of equal-width bins of a probability."""
    k = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(k.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("share"))


def conformal_radius(df: DataFrame, group: str, residual: str, coverage: float, least: int = 100) -> DataFrame:
    """Per group the min(n, ceil((n + 1) coverage))-th smallest absolute residual; groups below ``least`` rows take that of all rows.

    Ranks come from a count below and at each value, so no group is gathered in one list.
    """
    r = df.select(group, F.abs(residual).alias("r"))
    counted = stored(r.groupBy(group, "r").agg(F.count("*").alias("n")), "counted-residuals")

    def at_rank(x: DataFrame, keys: list[str]) -> DataFrame:
        c = beside(cumulated(x, keys, "r"), x.groupBy(*keys).agg(F.sum("n").alias("total")), keys)
        need = F.least(F.col("total"), F.ceil((F.col("total") + 1) * F.lit(coverage)))
        return c.where(F.col("upto") >= need).groupBy(*keys).agg(F.min("r").alias("radius"), F.max("total").alias("n"))

    own = at_rank(counted, [group])
    whole = at_rank(counted.groupBy("r").agg(F.sum("n").alias("n")), []).select(F.col("radius").alias("all_radius"))
    return own.crossJoin(F.broadcast(whole)).select(group, "n", F.when(F.col("n") >= least, F.col("radius")).otherwise(F.col("all_radius")).alias("radius"))


def capture(df: DataFrame, group: Sequence[str], y: str, p: str, tie: str, top: int, within: int, least: int = 1) -> DataFrame:
    """How many of a group's ``top`` by y are among its ``within`` by p."""
    w = Window.partitionBy(*group)
    r = df.select(*group, F.row_number().over(w.orderBy(F.desc(y), tie)).alias("a"), F.row_number().over(w.orderBy(F.desc(p), tie)).alias("b"), F.count("*").over(w).alias("size"))
    return r.where(F.col("size") >= least).agg(F.count_if((F.col("a") <= top) & (F.col("b") <= within)).alias("hits"), F.count_if(F.col("a") <= top).alias("available"))


def entropy(share: Column) -> Column:
    """-sum p ln p over a group's shares, zero shares left out."""
    return F.lit(0.0) - F.sum(F.when(share > 0, share * F.ln(share)))


def herfindahl(share: Column) -> Column:
    return F.sum(share * share)


def bootstrap_ratio(df: DataFrame, cluster: str, numerator: str, denominator: str, replicates: int, seed: int = 7) -> DataFrame:
    """Replicate ratios of sums over resampled clusters: each cluster gets a Poisson(1) weight in each replicate,
    by a hash of cluster, replicate and seed, so that the draw needs no gathering and never varies."""
    sums = df.groupBy(cluster).agg(F.sum(numerator).alias("a"), F.sum(denominator).alias("b"))
    drawn = sums.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    u = (F.pmod(F.xxhash64(F.col(cluster), "replicate", F.lit(seed)), F.lit(1_000_003)) + 0.5) / 1_000_003.0
    edges = [0.36787944117, 0.73575888234, 0.91969860293, 0.98101184312, 0.99634015317, 0.99940581518, 0.99991675885]
    weight = sum((F.when(u > e, 1).otherwise(0) for e in edges), F.lit(0))
    return drawn.withColumn("w", weight).groupBy("replicate").agg(F.try_divide(F.sum(F.col("a") * F.col("w")), F.sum(F.col("b") * F.col("w"))).alias("ratio"))
