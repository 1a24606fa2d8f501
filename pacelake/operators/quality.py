"""Integrity checks: each counts the rows that break a rule; ``report`` puts checks in one table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def breaks(name: str, df: DataFrame, condition: Column | str) -> DataFrame:
    """Rows for which the condition holds."""
    return df.agg(F.count_if(F.expr(condition) if isinstance(condition, str) else condition).alias("violations")).select(F.lit(name).alias("check"), "violations")


def many(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Several conditions on one table in one scan."""
    counts = df.agg(*[F.count_if(c).alias(f"c{i}") for i, c in enumerate(checks.values())])
    rows = F.array(*[F.struct(F.lit(n).alias("check"), F.col(f"c{i}").alias("violations")) for i, n in enumerate(checks)])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def duplicates(name: str, df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that stand more than once."""
    return breaks(name, df.groupBy(*key).count(), F.col("count") > 1)


def cardinality(name: str, df: DataFrame, key: Sequence[str], exact: int) -> DataFrame:
    return breaks(name, df.groupBy(*key).count(), F.col("count") != exact)


def orphans(name: str, df: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Rows whose key has no parent."""
    p = parent.select(F.col(parent_key).alias("__p")).distinct()
    return breaks(name, df.where(F.col(key).isNotNull()).join(p, F.col(key) == F.col("__p"), "left_anti"), F.lit(True))


def unreconciled(name: str, df: DataFrame, key: str, value: str, parts: DataFrame, parts_key: str, parts_value: str, tolerance: float) -> DataFrame:
    """Totals that differ from the sum of their parts."""
    s = parts.groupBy(F.col(parts_key).alias("__k")).agg(F.sum(parts_value).alias("__s"))
    return breaks(name, df.join(s, F.col(key) == F.col("__k")), F.abs(F.col(value) - F.col("__s")) > tolerance)


def report(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


class IntegrityError(ValueError):
    """Raised by ``require`` with the checks that failed."""


def require(checks: DataFrame) -> None:
    """Fails closed: raises unless every check counts zero.  What comes to the driver is a row for each check."""
    bad = checks.where("violations > 0").collect()
    if bad:
        raise IntegrityError("; ".join(f"{r.check}: {r.violations}" for r in bad))


def fingerprint(df: DataFrame, digits: int = 12) -> DataFrame:
    """n and an order-free fingerprint of a table; doubles are rounded first."""
    columns = [F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    return df.select(*columns).select(F.xxhash64(*df.columns).alias("h")).agg(F.count("*").alias("n"), F.bit_xor("h").alias("x"), F.sum(F.pmod("h", F.lit(1 << 31))).alias("s"))
