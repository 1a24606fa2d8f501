"""Who is who in two sources: a cascade of tiers, each with keys of its own, that passes leftovers on.

A tier never guesses: an entry is matched if all its keys lead to one person, and if no other entry of the
tier leads there too.  Persons matched in a tier are taken, and entries it leaves go on to the next.  What no
tier matches is classified.  Keys of persons are counted before entries meet them, so a key that a third
of either source shares costs one row on each side, never their pairs.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import normal_text
from ..storage import stored

#: Words after a surname that are no part of it.
SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "v")


def _plain(x: Column) -> Column:
    """Normal words; an apostrophe joins, any other sign parts."""
    return F.filter(F.split(normal_text(F.regexp_replace(x, "['’]", "")), " "), lambda w: w != "")


def _bare(words: Column) -> Column:
    return F.filter(words, lambda w: ~w.isin(*SUFFIXES))


def _full(words: Column) -> Column:
    """Without initials at the end."""
    last = F.array_max(F.transform(words, lambda w, i: F.when(F.char_length(w) > 1, i + 1).otherwise(0)))
    return F.slice(words, F.lit(1), F.coalesce(last, F.lit(0)))


def official_parts(name: Column) -> tuple[Column, Column]:
    """Words of surname and given names of "SURNAME, GIVEN"; a name without a comma has no given names."""
    cut = F.instr(name, ",")
    return _plain(F.when(cut > 0, F.substring(name, F.lit(1), cut - 1)).otherwise(name)), F.when(cut > 0, _plain(F.substring(name, cut + 1, F.char_length(name)))).otherwise(F.array().cast("array<string>"))


def official_variants(name: Column) -> Column:
    """The spellings that other sources give an official name: as it stands, given names first, without suffixes, without initials; no edit distance."""
    surname, given = official_parts(name)
    join = lambda *parts: F.array_join(F.concat(*parts), " ")
    some = [join(_plain(name)), join(given, surname), join(_bare(given), _bare(surname)), join(_full(_bare(given)), _bare(surname))]
    return F.filter(F.array_distinct(F.array(*some)), lambda v: v != "")


def strong_names(name: Column, official: Column) -> Column:
    """Whether a name and an official one agree strongly: all its words are in the official name, or the surname is the same and
    the first given names share three letters.  One word alone never does."""
    words = _plain(name)
    surname, given = (_bare(x) for x in official_parts(official))
    given = _full(given)
    within = F.size(F.array_except(words, F.concat(given, surname))) == 0
    first, other = F.substring(F.get(words, F.lit(0)), 1, 3), F.substring(F.get(given, F.lit(0)), 1, 3)
    alike = (F.try_element_at(words, F.lit(-1)) == F.try_element_at(surname, F.lit(-1))) & (first == other) & (F.char_length(first) == 3)
    return F.coalesce((F.size(words) > 1) & (F.instr(official, ",") > 0) & (within | alike), F.lit(False))


def jersey_key(team: Column, jersey: Column) -> Column:
    """Team and number without leading zeros; null where either is missing."""
    number = F.regexp_replace(F.trim(jersey.cast("string")), "^0+(?=.)", "")
    return F.concat_ws("|", team.cast("string"), F.when(number != "", number)).substr(F.lit(1), F.when(team.isNotNull() & (number != ""), F.lit(1 << 20)))


@dataclass(frozen=True)
class Tier:
    """keys of an entry and of a person (arrays of strings; nulls are no keys); agree: a column over entry and official name that has to hold."""

    name: str
    entry_keys: Column
    person_keys: Column
    agree: bool = False


def _candidates(entries: DataFrame, persons: DataFrame, tier: Tier) -> DataFrame:
    """entry, n (how many persons its keys lead to, counted up to two) and person (the one, or the least)."""
    keyed = persons.select("person", "official", F.explode(tier.person_keys).alias("key")).where("key is not null").dropDuplicates(["person", "key"])
    index = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("person").alias("person"), F.min_by("official", "person").alias("official"))
    own = entries.select("entry", "name", F.explode(tier.entry_keys).alias("key")).where("key is not null").dropDuplicates(["entry", "key"])
    found = own.join(index, "key").groupBy("entry").agg(F.max("n").alias("most"), F.count_distinct("person").alias("several"), F.min("person").alias("person"), F.min("name").alias("name"), F.min_by("official", "person").alias("official"))
    n = F.when((F.col("most") > 1) | (F.col("several") > 1), 2).otherwise(1)
    agree = strong_names(F.col("name"), F.col("official")) if tier.agree else F.lit(True)
    return found.select("entry", "person", n.alias("n"), agree.alias("agree"))


def resolve(entries: DataFrame, persons: DataFrame, tiers: Sequence[Tier]) -> DataFrame:
    """entry, person, tier, status of every entry.

    entries: entry and name, persons: person and official, and what the tiers' keys read.  status: MATCHED; else, by the
    last tier that led anywhere, AMBIGUOUS (several persons), CONTESTED (other entries lead to the same one), INCOMPATIBLE (one person, whose
    name doesn't agree) or UNMATCHED (no tier led anywhere).  Null names have no words; entries and persons are distinct by their id, repeated rows count once.
    """
    left, free, out = entries, persons, []
    for tier in tiers:
        found = _candidates(left, free, tier)
        rivals = found.where("n = 1 and agree").groupBy("person").agg(F.count("*").alias("rivals"))
        known = stored(found.join(rivals, "person", "left").select("entry", "person", "n", "agree", "rivals"), f"tier-{tier.name}")
        status = F.when(F.col("n") > 1, "AMBIGUOUS").when(~F.col("agree"), "INCOMPATIBLE").when(F.col("rivals") > 1, "CONTESTED").otherwise("MATCHED")
        told = known.select("entry", F.when(status == "MATCHED", F.col("person")).alias("person"), F.lit(tier.name).alias("tier"), status.alias("status"))
        out.append(told.withColumn("place", F.lit(len(out))))
        done = told.where("status = 'MATCHED'")
        left, free = left.join(done.select("entry"), "entry", "left_anti"), free.join(done.select("person"), "person", "left_anti")
    verdict = F.struct((F.col("status") == "MATCHED").alias("matched"), "place", "person", "tier", "status")
    best = reduce(DataFrame.unionByName, out).groupBy("entry").agg(F.max(verdict).alias("v"))
    return entries.select("entry").distinct().join(best, "entry", "left").select("entry", "v.person", F.when(F.col("v.matched"), F.col("v.tier")).alias("tier"), F.coalesce("v.status", F.lit("UNMATCHED")).alias("status"))
