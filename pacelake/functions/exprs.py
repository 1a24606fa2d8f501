"""Scalar expressions: guarded arithmetic, scoring, rates, clocks, names, classes."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
MIN_RATE_MINUTES, FREE_THROW_WEIGHT, EWMA_ALPHA = 10.0, 0.44, 0.35


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, null where b is zero or null."""
    return F.try_divide(c(a).cast("double"), c(b).cast("double"))


def rate_when(x: Column | str, exposure: Column | str, least: float = MIN_RATE_MINUTES) -> Column:
    """x per unit of exposure, null below the least exposure."""
    return F.when(c(exposure) >= least, c(x).cast("double") / c(exposure))


def clip(x: Column | str, low: float, high: float) -> Column:
    return F.least(F.greatest(c(x), F.lit(low)), F.lit(high))


def differs(a: Column | str, b: Column | str) -> Column:
    """IS DISTINCT FROM."""
    return ~c(a).eqNullSafe(c(b))


def finite(x: Column | str) -> Column:
    x = c(x)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def valid_only(x: Column | str, flag: Column | str) -> Column:
    """Null unless the flag holds: hides values that were not known at the time."""
    return F.when(c(flag), c(x))


def base_score(positives: Sequence[str], negatives: Sequence[str], attempts: Sequence[tuple[str, str]]) -> Column:
    """Sum of positives less negatives less misses (attempted - made)."""
    total = reduce(lambda a, b: a + b, [c(p) for p in positives])
    for n in negatives:
        total = total - c(n)
    for attempted, made in attempts:
        total = total - (c(attempted) - c(made))
    return total


def with_bonus(base: Column | str, won: Column | str) -> Column:
    """Winners get a tenth of the base's size on top, which also lifts negative bases."""
    return c(base) + F.when(c(won), F.lit(0.1) * F.abs(c(base))).otherwise(F.lit(0.0))


def eligibility(minutes: Column | str, did_not_play: Column | str) -> Column:
    return F.when((c(minutes) > 0) & ~c(did_not_play), "PLAYED").when(c(did_not_play), "DNP").otherwise("UNKNOWN")


def possessions(fga, oreb, turnovers, fta) -> Column:
    return c(fga) - c(oreb) + c(turnovers) + F.lit(FREE_THROW_WEIGHT) * c(fta)


def pace(poss, minutes) -> Column:
    """Possessions for 40 minutes; null for fewer than 40 minutes played."""
    return F.when(c(minutes) >= 40, F.lit(40.0) * c(poss) / c(minutes))


def usage(fga, fta, turnovers, minutes, team_fga, team_fta, team_turnovers, team_minutes) -> Column:
    own = c(fga) + F.lit(FREE_THROW_WEIGHT) * c(fta) + c(turnovers)
    team = c(team_fga) + F.lit(FREE_THROW_WEIGHT) * c(team_fta) + c(team_turnovers)
    return clip(100.0 * ratio(own * (c(team_minutes) / 5.0), c(minutes) * team), 0.0, 100.0)


def clock_seconds(clock: Column | str) -> Column:
    """Seconds of MM:SS, null for anything else or seconds above 59."""
    good = c(clock).rlike("^[0-9]{1,3}:[0-5][0-9]$")
    return F.when(good, F.split_part(c(clock), F.lit(":"), F.lit(1)).cast("int") * 60 + F.split_part(c(clock), F.lit(":"), F.lit(2)).cast("int"))


def duration_minutes(raw: Column | str) -> Column:
    """Minutes of MM:SS or ISO PT#H#M#S; null for DNP and anything else."""
    part = lambda unit: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(c(raw), rf"([0-9]+){unit}", 1), F.lit("")), F.lit("999999")).cast("double"), F.lit(0.0))
    iso = c(raw).rlike("^PT([0-9]+H)?([0-9]+M)?([0-9]+S)?$")
    return F.when(clock_seconds(raw).isNotNull(), clock_seconds(raw) / 60.0).when(iso, part("H") * 60 + part("M") + part("S") / 60.0)


def period_length(period: Column | str) -> Column:
    return F.when(c(period) <= 4, 600).otherwise(300)


def period_offset(period: Column | str) -> Column:
    return F.when(c(period) <= 4, (c(period) - 1) * 600).otherwise(2400 + (c(period) - 5) * 300)


#: Latin letters with marks and the letters without them.
_MARKED, _PLAIN = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿšžćčđłń", "aaaaaaeeeeiiiiooooouuuuncyyszccdln"


def normal_text(x: Column | str) -> Column:
    """Lower case, marks off, anything but letters and digits as one space."""
    plain = F.translate(F.lower(c(x)), _MARKED, _PLAIN)
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def collapsed(x: Column | str) -> Column:
    return F.lower(F.trim(F.regexp_replace(c(x), r"\s+", " ")))


def display_name(x: Column | str) -> Column:
    """"SURNAME, GIVEN" as "Given Surname"; upper case becomes title case."""
    x = c(x)
    turned = F.when(F.contains(x, F.lit(", ")), F.concat_ws(" ", F.split_part(x, F.lit(", "), F.lit(2)), F.split_part(x, F.lit(", "), F.lit(1)))).otherwise(x)
    return F.when(x == F.upper(x), F.initcap(turned)).otherwise(turned)


def canonical_code(x: Column | str) -> Column:
    """Digits of P-codes, else the trimmed code in upper case."""
    digits = F.regexp_extract(F.trim(c(x)), "^[Pp]([0-9]+)$", 1)
    return F.coalesce(F.nullif(digits, F.lit("")), F.upper(F.trim(c(x))))


def season_before(code: Column | str, years: int = 1) -> Column:
    return F.concat(F.substring(c(code), 1, 1), (F.substring(c(code), 2, 4).cast("int") - years).cast("string"))


def first_match(x: Column | str, rules: Sequence[tuple[str, str]], otherwise: str) -> Column:
    """The label of the first pattern found in the lower-case text."""
    text, out = F.lower(c(x)), None
    for pattern, label in rules:
        out = (F if out is None else out).when(text.rlike(pattern), label)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


def band(x: Column | str, edges: Sequence[float], labels: Sequence[str], right: bool = False) -> Column:
    """Label of the interval [a, b) (or (a, b]) that holds x; null outside."""
    x, out = c(x), None
    for a, b, label in zip(edges[:-1], edges[1:], labels, strict=True):
        inside = (x > a) & (x <= b) if right else (x >= a) & (x < b)
        out = (F if out is None else out).when(inside, label)
    return out


def shot_zone(x: Column | str, y: Column | str, points: Column | str) -> Column:
    """Five zones by centimetres from the basket; null for places a shot can't have."""
    x, y, points = c(x), c(y), c(points)
    d = F.sqrt(x * x + y * y)
    impossible = ((x == -1) & (y == -1)) | (F.abs(x) > 750) | (y < -150) | (y > 1400) | ((points == 2) & (d > 800)) | ((points == 3) & (d < 550))
    return (
        F.when(impossible, None).when((points == 2) & (d <= 125), "RIM").when((points == 2) & (F.abs(x) <= 245) & (y <= 423), "PAINT").when(points == 2, "MIDRANGE")
        .when((F.abs(x) >= 660) & (y <= 142), "CORNER3").otherwise("ABOVE_BREAK3")
    )


def coach_points(margin: Column | str, overtime: Column | str, won: Column | str) -> Column:
    close, mid = (F.abs(c(margin)) <= 10) | c(overtime), F.abs(c(margin)) <= 20
    return F.when(close, F.when(c(won), 10).otherwise(-5)).when(mid, F.when(c(won), 20).otherwise(-10)).otherwise(F.when(c(won), 25).otherwise(-20))


def role_stability(std_minutes, std_stints) -> Column:
    return 1.0 / (1.0 + c(std_minutes) / 10.0 + c(std_stints) / 3.0)


def change_class(before: Sequence[str], after: Sequence[str], date_before: str, date_after: str) -> Column:
    """NEW without a row before, POSTPONED for a later date, UPDATED for any other change, else UNCHANGED."""
    changed = reduce(lambda a, b: a | b, [differs(x, y) for x, y in zip(before, after, strict=True)])
    return F.when(c(date_before).isNull(), "NEW").when(c(date_after) > c(date_before), "POSTPONED").when(changed, "UPDATED").otherwise("UNCHANGED")


def stable_id(entity: str, *parts: Column | str) -> Column:
    """A deterministic id of an entity's parts."""
    return F.sha2(F.concat_ws("|", F.lit(entity), *[c(p).cast("string") for p in parts]), 256)


def interpolated(x: Column | str, xs: Column, ys: Column) -> Column:
    """Piecewise linear through ascending (xs, ys), constant outside."""
    x, n = c(x), F.size(xs)
    upper = F.aggregate(xs, F.lit(0), lambda k, v: F.when(v < x, k + 1).otherwise(k))  # xs below x
    a, b = F.get(xs, upper - 1), F.get(xs, upper)
    ya, yb = F.get(ys, upper - 1), F.get(ys, upper)
    return F.when(upper == 0, F.get(ys, F.lit(0))).when(upper >= n, F.get(ys, n - 1)).otherwise(ya + (yb - ya) * ratio(x - a, b - a))
