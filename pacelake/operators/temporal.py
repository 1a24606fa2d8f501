"""Point-in-time joins and views of append-only logs.

As-of lookups run as a union of both sides in time order and a window over the entity, which
shuffles each side once; no pair of a fact and all its past is built, except where a
caller asks for the rows themselves (``last_observations``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import dealt, micros, top_k


def as_of(facts: DataFrame, observed: DataFrame, entity: Sequence[str], fact_time: str, seen_time: str, tie: str, values: Sequence[str], strict: bool = True) -> DataFrame:
    """Each fact with the values of the last observation before it (at or before it, if not strict); nulls if there is none."""
    side, at, seen = "__side", "__at", "__seen"
    f = facts.withColumns({at: micros(fact_time), side: F.lit(0 if strict else 1), seen: F.lit(None).cast(observed.select(F.struct(*dict.fromkeys([tie, *values])).alias("s")).schema["s"].dataType)})
    o = observed.select(*entity, micros(seen_time).alias(at), F.lit(1 if strict else 0).alias(side), F.struct(*dict.fromkeys([tie, *values])).alias(seen))
    w = Window.partitionBy(*entity).orderBy(at, side, F.col(seen)[tie]).rowsBetween(Window.unboundedPreceding, 0)
    both = f.unionByName(o, allowMissingColumns=True).withColumn(seen, F.last(seen, ignorenulls=True).over(w))
    return both.where(F.col(side) == (0 if strict else 1)).select(*facts.columns, *[F.col(seen)[v].alias(v) for v in values])


def next_after(facts: DataFrame, observed: DataFrame, entity: Sequence[str], fact_time: str, seen_time: str, tie: str, values: Sequence[str]) -> DataFrame:
    """Each fact with the values of the first observation after it."""
    side, at, seen = "__side", "__at", "__seen"
    f = facts.withColumns({at: micros(fact_time), side: F.lit(1), seen: F.lit(None).cast(observed.select(F.struct(*dict.fromkeys([tie, *values])).alias("s")).schema["s"].dataType)})
    o = observed.select(*entity, micros(seen_time).alias(at), F.lit(0).alias(side), F.struct(*dict.fromkeys([tie, *values])).alias(seen))
    w = Window.partitionBy(*entity).orderBy(at, side, F.col(seen)[tie]).rowsBetween(0, Window.unboundedFollowing)
    both = f.unionByName(o, allowMissingColumns=True).withColumn(seen, F.first(seen, ignorenulls=True).over(w))
    return both.where(F.col(side) == 1).select(*facts.columns, *[F.col(seen)[v].alias(v) for v in values])


def recent_observations(facts: DataFrame, observed: DataFrame, entity: Sequence[str], key: str, fact_time: str, seen_time: str, tie: str, values: Sequence[str], k: int, parts: int | None = None) -> DataFrame:
    """(fact key, recency 1..k, values): the last k observations strictly before each fact.

    One window over the union of both sides carries the last k observations along, so what is
    built is facts times k at most.  ``parts`` that grow with the table bound what a task sorts.
    """
    out = _looking_back(facts, observed, entity, [key], fact_time, seen_time, tie, values, k, parts).select(key, "__n", F.explode("__last").alias("x"))
    return out.select(key, (F.col("__n") - F.col("x.n") + 1).cast("int").alias("recency"), *[F.col("x.s")[v].alias(v) for v in values])


def recent_lists(facts: DataFrame, observed: DataFrame, entity: Sequence[str], keep: Sequence[str], fact_time: str, seen_time: str, tie: str, values: Sequence[str], k: int, parts: int | None = None) -> DataFrame:
    """(facts' columns to keep, ``recent``): ``recent_observations`` as one array of (recency, values) for each fact, empty if there are none; nothing is gathered again behind the window."""
    held = _looking_back(facts, observed, entity, keep, fact_time, seen_time, tie, values, k, parts)
    return held.select(*keep, F.transform("__last", lambda x: F.struct((F.col("__n") - x["n"] + 1).cast("int").alias("recency"), *[x["s"][v].alias(v) for v in values])).alias("recent"))


def _looking_back(facts: DataFrame, observed: DataFrame, entity: Sequence[str], keep: Sequence[str], fact_time: str, seen_time: str, tie: str, values: Sequence[str], k: int, parts: int | None) -> DataFrame:
    """Facts with __last, the last k observations by their numbers n, and __n, the number of those before."""
    side, at, seen = "__side", "__at", "__seen"
    f = facts.select(*dict.fromkeys([*entity, *keep]), micros(fact_time).alias(at), F.lit(0).alias(side), F.lit(None).cast(observed.select(F.struct(*dict.fromkeys([tie, *values])).alias("s")).schema["s"].dataType).alias(seen))
    o = observed.select(*entity, micros(seen_time).alias(at), F.lit(1).alias(side), F.struct(*dict.fromkeys([tie, *values])).alias(seen))
    both = dealt(f.unionByName(o, allowMissingColumns=True), parts, entity)
    order = Window.partitionBy(*entity).orderBy(at, side, F.col(seen)[tie])
    # observations are numbered; the window looks back over the rows between and keeps k of them
    numbered = both.withColumn("__n", F.count(seen).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    back = Window.partitionBy(*entity).orderBy("__n").rangeBetween(-(k - 1), 0)
    held = numbered.withColumn("__last", F.collect_list(F.when(F.col(seen).isNotNull(), F.struct(F.col("__n").alias("n"), F.col(seen).alias("s")))).over(back))
    return held.where(F.col(side) == 0)


def latest(log: DataFrame, key: Sequence[str], time: str, tie: str, values: Sequence[str]) -> DataFrame:
    """Current state: the newest row of each key by (time, tie), as one aggregate without a sort."""
    order = F.struct(time, tie)
    return log.groupBy(*key).agg(F.max_by(F.struct(time, tie, *[v for v in values if v not in (time, tie)]), order).alias("s")).select(*key, *[F.col("s")[v].alias(v) for v in values])


def in_force(log: DataFrame, key: Sequence[str], time: str, tie: str, action: str, expiry: str, as_of_time: Column, values: Sequence[str]) -> DataFrame:
    """Overrides in force at an instant: the newest event of the key up to then is SET and has not expired."""
    seen = log.where(F.col(time) <= as_of_time)
    now = latest(seen, key, time, tie, [action, expiry, *values])
    return now.where((F.col(action) == "SET") & (F.col(expiry).isNull() | (F.col(expiry) > as_of_time))).select(*key, *values)


def best_version(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key: the first by the given priorities."""
    return top_k(df, key, order, 1)


def validity(log: DataFrame, key: Sequence[str], time: str, tie: str, value: str) -> DataFrame:
    """Slowly changing dimension: (key, value, valid_from, valid_to) of runs of equal values; valid_to null for the open one."""
    w = Window.partitionBy(*key).orderBy(time, tie)
    changed = log.withColumn("__before", F.lag(F.struct(value)).over(w)).where(F.col("__before").isNull() | ~F.col("__before")[value].eqNullSafe(F.col(value)))
    return changed.select(*key, value, F.col(time).alias("valid_from"), F.lead(time).over(w).alias("valid_to"))


def during(facts: DataFrame, intervals: DataFrame, keys: Sequence[str], time: str, start: str, end: str, how: str = "inner") -> DataFrame:
    """Facts with the interval (start, end] of their keys that holds their time."""
    i = intervals
    on = [facts[k] == i[k] for k in keys] + [(facts[time] > i[start]) & (i[end].isNull() | (facts[time] <= i[end]))]
    joined = facts.join(i, on, how)
    for k in keys:
        joined = joined.drop(i[k])
    return joined


def insert_missing(existing: DataFrame, incoming: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of ``incoming`` whose key is new, once each; appending them twice changes nothing."""
    return incoming.dropDuplicates(list(key)).join(existing.select(*key).distinct(), list(key), "left_anti")


def upsert(existing: DataFrame, incoming: DataFrame, key: Sequence[str], time: str, tie: str) -> DataFrame:
    """The newest row of each key of both tables."""
    both = existing.unionByName(incoming, allowMissingColumns=True)
    rest = [x for x in both.columns if x not in key]
    return latest(both, key, time, tie, rest).select(*both.columns)


def changed_rows(before: DataFrame, after: DataFrame, key: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Keys of both tables whose values differ, with the names of the differing columns."""
    b, a = before.select(*key, *[F.col(v).alias(f"__{v}") for v in values]), after.select(*key, *values)
    named = F.array_compact(F.array(*[F.when(~F.col(v).eqNullSafe(F.col(f"__{v}")), v) for v in values]))
    return a.join(b, list(key)).withColumn("changed", named).where(F.size("changed") > 0).select(*key, *values, "changed")
