"""Identity tiers (survey J51): customers as official players, and as entries of another source that spells some names its own way."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import identity as I
from .registry import query

_DIGITS, _LETTERS = "0123456789", "bdfglmnkst"
_GIVEN = ("NIKOLAOS", "WADE", "O'SHAE J", "GUR", "MARCUS JR")
_OTHER = ("Nikos", "Wade", "OShae", "Gur", "Marcus")


def _people(t):
    c = t("customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("team"), (F.col("c_custkey") % 100).alias("jersey"))
    surname = F.translate((F.col("k") - F.when(F.col("k") % 17 == 0, 5).otherwise(0)).cast("string"), _DIGITS, _LETTERS)
    given = lambda names: F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("k") % 5 + 1).cast("int"))
    return c.withColumn("surname", surname).withColumn("given", given(_GIVEN)).withColumn("other", given(_OTHER))


_SQL_PEOPLE = f"""c AS (SELECT c_custkey AS k, c_nationkey AS team, c_custkey % 100 AS jersey, translate(CAST(c_custkey - CASE WHEN c_custkey % 17 = 0 THEN 5 ELSE 0 END AS VARCHAR), '{_DIGITS}', '{_LETTERS}') AS surname,
        ['nikolaos', 'wade', 'oshae j', 'gur', 'marcus jr'][c_custkey % 5 + 1] AS given, ['nikolaos', 'wade', 'oshae', 'gur', 'marcus'][c_custkey % 5 + 1] AS short, ['nikos', 'wade', 'oshae', 'gur', 'marcus'][c_custkey % 5 + 1] AS other FROM customer),
    variants AS (SELECT DISTINCT k, unnest([surname || ' ' || given, given || ' ' || surname, replace(given, ' jr', '') || ' ' || surname, short || ' ' || surname]) AS v FROM c),
    e AS (SELECT k, CASE k % 7 WHEN 6 THEN 'nobody known' WHEN 5 THEN 'someone else' ELSE other || ' ' || surname END AS name, CASE WHEN k % 7 <> 6 THEN team || '|' || jersey END AS j FROM c),
    m1 AS (SELECT e.k AS entry, v.k AS person FROM e JOIN variants v ON v.v = e.name),
    n1 AS (SELECT entry, count(DISTINCT person) AS n, min(person) AS person FROM m1 GROUP BY 1),
    r1 AS (SELECT *, sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY person) AS rivals FROM n1),
    done AS (SELECT entry, person FROM r1 WHERE n = 1 AND rivals = 1),
    m2 AS (SELECT e.k AS entry, c.k AS person, e.name, c.given, c.surname, c.short FROM e JOIN c ON e.j = c.team || '|' || c.jersey WHERE e.k NOT IN (SELECT entry FROM done) AND c.k NOT IN (SELECT person FROM done)),
    n2 AS (SELECT entry, count(*) AS n, min(person) AS person, min_by(string_split(name, ' ')[-1] = surname AND name[1:3] = given[1:3], person) AS agree FROM m2 GROUP BY 1),
    r2 AS (SELECT *, sum(CASE WHEN n = 1 AND agree THEN 1 ELSE 0 END) OVER (PARTITION BY person) AS rivals FROM n2)"""


@query("j51_identity_tiers", f"""WITH {_SQL_PEOPLE} SELECT e.k AS entry, CASE WHEN done.entry IS NOT NULL THEN done.person WHEN r2.n = 1 AND r2.agree AND r2.rivals = 1 THEN r2.person END AS person, CASE WHEN done.entry IS NOT NULL THEN 'NAME' WHEN r2.n = 1 AND r2.agree AND r2.rivals = 1 THEN 'TEAM_JERSEY' END AS tier,
    CASE WHEN done.entry IS NOT NULL THEN 'MATCHED' WHEN r2.n > 1 THEN 'AMBIGUOUS' WHEN r2.n = 1 AND NOT r2.agree THEN 'INCOMPATIBLE' WHEN r2.n = 1 AND r2.rivals > 1 THEN 'CONTESTED' WHEN r2.n = 1 THEN 'MATCHED' WHEN r1.n > 1 THEN 'AMBIGUOUS' WHEN r1.n = 1 THEN 'CONTESTED' ELSE 'UNMATCHED' END AS status
    FROM e LEFT JOIN done ON done.entry = e.k LEFT JOIN r1 ON r1.entry = e.k LEFT JOIN r2 ON r2.entry = e.k""")
def tiers(t):
    """Official name variants first, then team and jersey with a name that agrees strongly."""
    p = _people(t)
    persons = p.select(F.col("k").alias("person"), F.concat(F.upper("surname"), F.lit(", "), "given").alias("official"), "team", "jersey")
    spelled = F.when(F.col("k") % 7 == 6, "Nobody Known").when(F.col("k") % 7 == 5, "Someone Else").otherwise(F.concat_ws(" ", "other", F.initcap("surname")))
    entries = p.select(F.col("k").alias("entry"), spelled.alias("name"), "team", F.when(F.col("k") % 7 != 6, F.concat(F.lit("0"), F.col("jersey").cast("string"))).alias("jersey"))
    number = F.array(I.jersey_key(F.col("team"), F.col("jersey")))
    return I.resolve(entries, persons, [I.Tier("NAME", F.array(F.array_join(I._plain(F.col("name")), " ")), I.official_variants(F.col("official"))), I.Tier("TEAM_JERSEY", number, number, agree=True)])
