"""Rosters with roles: the joint optimum of roster, starters, sixth, captain and coach, and all lineups of a roster.

``optimum`` is exact.  Without the limit of players from one club the problem falls apart by position: a table
holds the best value of each number of starters and bench players at each cost, and tables
are put together for every formation and every position of captain and sixth.  That value bounds the
problem with the limit from above; where its roster has too many players of a club, the search branches: of that
club's players one more than allowed can't all be in, so each branch leaves one out and holds those before it.  Branches are taken
best bound first, and the first legal roster is the optimum.  Forced entities are held from the start.  Every (slate,
request) is a subproblem of its own task, over the contenders of its slate, whose number positions,
clubs and prices bound.

``enumerated`` numbers the choices of starters and unranks the numbers, so that ranges of numbers spread over tasks and no
task holds the product.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .allocation import contenders


@dataclass(frozen=True)
class Rules:
    """counts by position, formations in the order of the positions, credits in tenths; without roles all players count once and coaches are left out."""

    counts: dict[str, int]
    formations: Sequence[tuple[int, ...]]
    budget: float
    club_limit: int
    captain: float = 2.0
    starter: float = 1.0
    sixth: float = 1.0
    bench: float = 0.5
    roles: bool = True


#: Ten players and a coach, five starters.
CLASSIC = Rules({"G": 4, "F": 4, "C": 2}, ((2, 2, 1), (1, 2, 2), (2, 1, 2), (1, 3, 1), (3, 1, 1)), 100.0, 6)
ROLES = ("STARTER", "CAPTAIN", "BENCH", "SIXTH")


def _steps(rules: Rules) -> list[tuple[tuple[int, int, int, int], float]]:
    """Of each role: by how much it moves (starters, bench, captains, sixths), and its weight."""
    every = [((1, 0, 0, 0), rules.starter), ((1, 0, 1, 0), rules.captain), ((0, 1, 0, 0), rules.bench), ((0, 1, 0, 1), rules.sixth)]
    return every if rules.roles else [((1, 0, 0, 0), 1.0)]


def _table(cost: np.ndarray, value: np.ndarray, held: np.ndarray, shape: tuple[int, int], room: int, rules: Rules) -> tuple[np.ndarray, list[np.ndarray]]:
    """Best value by (starters, bench, captain, sixth, cost) over one position's players, and each player's role there (-1: left out)."""
    flags = 2 if rules.roles else 1
    full = (shape[0] + 1, shape[1] + 1, flags, flags, room + 1)
    best = np.full(full, -np.inf)
    best[0, 0, 0, 0, 0] = 0.0
    picks = []
    for c, v, must in zip(cost.tolist(), value.tolist(), held.tolist(), strict=True):
        new, role = (np.full(full, -np.inf) if must else best.copy()), np.full(full, -1, np.int8)
        for r, (move, weight) in enumerate(_steps(rules)):
            if c > room or any(m >= n for m, n in zip(move, full, strict=False)):
                continue
            to = tuple(slice(m, None) for m in (*move, c))
            frm = tuple(slice(None, n - m) for m, n in zip((*move, c), full, strict=True))
            taken = best[frm] + weight * v
            better = taken > new[to]
            new[to] = np.where(better, taken, new[to])
            role[to][better] = r
        best = new
        picks.append(role)
    return best, picks


def _rising(a: np.ndarray) -> np.ndarray:
    """Without costs that buy no more than a lower one."""
    before = np.concatenate(([-np.inf], np.maximum.accumulate(a)[:-1]))
    return np.where(a > before, a, -np.inf)


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Best sum at each cost."""
    out = np.full(len(a), -np.inf)
    for k in np.flatnonzero(np.isfinite(a)):
        np.maximum(out[k:], a[k] + b[: len(a) - k], out=out[k:])
    return out


def _split(total: np.ndarray, a: np.ndarray, b: np.ndarray, cost: int) -> int:
    """The part of the cost that a has in the best sum at this cost."""
    return int(np.argmax(a[: cost + 1] + b[cost::-1]))


class Search:
    """One subproblem: players and coaches with costs in tenths."""

    def __init__(self, players: pd.DataFrame, coaches: pd.DataFrame | None, rules: Rules):
        self.players, self.rules, self.spots = players, rules, list(rules.counts)
        self.room = int(round(rules.budget * 10))
        self.cost, self.value = np.rint(players["credits"].to_numpy(float) * 10).astype(int), players["value"].to_numpy(float)
        self.at = {s: np.flatnonzero((players["position"] == s).to_numpy()) for s in self.spots}
        self.club = players["club"].to_numpy()
        self.tables: dict[tuple, tuple] = {}
        self.coach_cost = np.zeros(1, int) if coaches is None else np.rint(coaches["credits"].to_numpy(float) * 10).astype(int)
        self.coach_value = np.zeros(1) if coaches is None else coaches["value"].to_numpy(float)

    def _of(self, spot: str, held: frozenset, out: frozenset) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        own = [i for i in self.at[spot].tolist() if i not in out]
        key = (spot, held & frozenset(own), out & frozenset(self.at[spot].tolist()))
        if key not in self.tables:
            rows, k, n = np.array(own, int), self.spots.index(spot), self.rules.counts[spot]
            shape = max(f[k] for f in self.rules.formations), n - min(f[k] for f in self.rules.formations)
            self.tables[key] = (rows, *_table(self.cost[rows], self.value[rows], np.isin(rows, list(held)), shape, self.room, self.rules))
        return self.tables[key]

    def relaxed(self, held: frozenset, out: frozenset, coach_out: frozenset) -> tuple[float, list[tuple[int, int]], int] | None:
        """Best value without the club limit, its (player, role) pairs and its coach."""
        coach = np.full(self.room + 1, -np.inf)
        for k, (c, v) in enumerate(zip(self.coach_cost.tolist(), self.coach_value.tolist(), strict=True)):
            if c <= self.room and k not in coach_out:
                coach[c] = max(coach[c], v)
        coach = _rising(coach)
        known = [self._of(s, held, out) for s in self.spots]
        flags = range(len(self.spots)) if self.rules.roles else (None,)
        best: tuple = (-np.inf,)
        top = coach.max(initial=-np.inf)
        for f in self.rules.formations:
            for captain in flags:
                for sixth in flags:
                    parts = [_rising(t[1][f[k], self.rules.counts[s] - f[k], int(captain == k), int(sixth == k)]) for k, (s, t) in enumerate(zip(self.spots, known, strict=True))]
                    if sum(p.max() for p in parts) + top <= best[0]:
                        continue
                    sums = [parts[0]]
                    for p in [*parts[1:], coach]:
                        sums.append(_rising(_joined(sums[-1], p)))
                    if sums[-1].max() > best[0]:
                        best = (float(sums[-1].max()), f, captain, sixth, parts, sums)
        if not np.isfinite(best[0]):
            return None
        value, f, captain, sixth, parts, sums = best
        cost = int(np.argmax(sums[-1]))
        left = _split(sums[-1], sums[-2], coach, cost)
        who = next(k for k, (c, v) in enumerate(zip(self.coach_cost.tolist(), self.coach_value.tolist(), strict=True)) if k not in coach_out and c == cost - left and v == coach[c])
        chosen: list[tuple[int, int]] = []
        for k in range(len(self.spots) - 1, -1, -1):
            before = _split(sums[k], sums[k - 1], parts[k], left) if k else 0
            rows, _, picks = known[k]
            at = [f[k], self.rules.counts[self.spots[k]] - f[k], int(captain == k), int(sixth == k), left - before]
            for i, role in zip(rows[::-1].tolist(), picks[::-1], strict=True):
                r = int(role[tuple(at)])
                if r >= 0:
                    chosen.append((i, r))
                    at = [a - m for a, m in zip(at, (*_steps(self.rules)[r][0], int(self.cost[i])), strict=True)]
            left = before
        return value, chosen, who

    def best(self, held: frozenset = frozenset(), coach: int | None = None) -> tuple[float, list[tuple[int, int]], int] | None:
        """The optimum with the players held and the coach, if one is forced; None if there is none."""
        others = frozenset(range(len(self.coach_cost))) - {coach} if coach is not None else frozenset()
        heap, n = [], 0
        found = self.relaxed(held, frozenset(), others)
        if found:
            heap.append((-found[0], n, held, frozenset(), found))
        while heap:
            _, _, keep, out, found = heapq.heappop(heap)
            clubs: dict = {}
            for i, _ in found[1]:
                clubs.setdefault(self.club[i], []).append(i)
            over = next((sorted(x) for _, x in sorted(clubs.items(), key=lambda x: str(x[0])) if len(x) > self.rules.club_limit), None)
            if over is None:
                return found
            some = sorted(over, key=lambda i: (i not in keep, i))[: self.rules.club_limit + 1]
            for k, i in enumerate(some):
                if i in keep:
                    continue
                branch = keep | frozenset(some[:k]), out | {i}
                found = self.relaxed(*branch, others)
                if found:
                    n += 1
                    heapq.heappush(heap, (-found[0], n, *branch, found))
        return None


CHOSEN = "entity string, kind string, role string, position string, club string, credits double, value double, objective double"


def optimum(pool: DataFrame, coaches: DataFrame, slate: str, rules: Rules = CLASSIC, requests: DataFrame | None = None) -> DataFrame:
    """(slate, request, entity, kind, role, position, club, credits, value, objective): each request's best lineup; none, if it has none.

    pool: slate, player, position, club, credits, value; coaches: slate, coach, credits, value; requests: slate, request,
    entities (array of player and coach ids as strings that have to be in).  Without requests there is one for each slate, named ``best``.
    """
    text = lambda df, c: df.withColumn(c, F.col(c).cast("string"))
    pool, coaches = text(pool.select(slate, "player", "position", "club", "credits", "value"), "player"), text(coaches, "coach")
    requests = requests if requests is not None else pool.select(slate).distinct().select(slate, F.lit("best").alias("request"), F.array().cast("array<string>").alias("entities"))
    asked = requests.select(slate, "request", F.explode("entities").alias("player"))
    kept = contenders(pool, slate, rules.counts).join(requests, slate).unionByName(pool.join(asked, [slate, "player"]).join(requests, [slate, "request"]).select(slate, "player", "position", "club", "credits", "value", "request", "entities")).dropDuplicates([slate, "request", "player"])
    line = [slate, "request", "entities", "entity", "kind", "position", "club", "credits", "value"]
    players = kept.select(slate, "request", "entities", F.col("player").alias("entity"), F.lit("PLAYER").alias("kind"), "position", F.col("club").cast("string").alias("club"), F.col("credits").cast("double").alias("credits"), F.col("value").cast("double").alias("value"))
    led = coaches.join(requests, slate).select(slate, "request", "entities", F.col("coach").alias("entity"), F.lit("COACH").alias("kind"), F.lit(None).cast("string").alias("position"), F.lit(None).cast("string").alias("club"), F.col("credits").cast("double").alias("credits"), F.col("value").cast("double").alias("value"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in players.select(slate, "request").schema) + ", " + CHOSEN

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        people = pdf[pdf["kind"] == "PLAYER"].sort_values("entity").reset_index(drop=True)
        heads = pdf[pdf["kind"] == "COACH"].sort_values("entity").reset_index(drop=True)
        wanted = set(pdf["entities"].iloc[0])
        held, lead = frozenset(np.flatnonzero(people["entity"].isin(wanted)).tolist()), np.flatnonzero(heads["entity"].isin(wanted)).tolist()
        found = None
        if len(heads) and len(people) and len(held) + len(lead) == len(wanted) and len(lead) < 2:
            found = Search(people, heads, rules).best(held, lead[0] if lead else None)
        rows = []
        if found:
            rows = [(p["entity"], "PLAYER", ROLES[r], p["position"], p["club"], p["credits"], p["value"]) for i, r in sorted(found[1]) for p in [people.iloc[i]]]
            h = heads.iloc[found[2]]
            rows.append((h["entity"], "COACH", "COACH", None, None, h["credits"], h["value"]))
        return pd.DataFrame([(pdf[slate].iloc[0], pdf["request"].iloc[0], *r, found[0]) for r in rows], columns=[slate, "request", *(c.split()[0] for c in CHOSEN.split(", "))])

    return players.select(*line).unionByName(led.select(*line)).groupBy(slate, "request").applyInPandas(solve, schema)


def best_players(pool: pd.DataFrame, counts: dict[str, int], budget: float, club_limit: int) -> list[int]:
    """Row numbers of the roster of largest value without roles or coach; empty if there is none."""
    rules = replace(CLASSIC, counts=counts, formations=(tuple(counts.values()),), budget=budget, club_limit=club_limit, roles=False)
    found = Search(pool, None, rules).best()
    return sorted(i for i, _ in found[1]) if found else []


def combination(rank: Column, n: int, k: int) -> Column:
    """The places, ascending, of the rank-th (from 0) choice of k of n places, in the order of their largest places."""
    binomials = F.array(*[F.array(*[F.lit(math.comb(c, j)) for j in range(k + 1)]) for c in range(n)])
    zero = F.struct(rank.cast("long").alias("rank"), F.lit(k).alias("left"), F.array().cast("array<int>").alias("places"))

    def place(s: Column, c: Column) -> Column:
        below = F.get(F.get(binomials, c), s["left"])
        taken = (s["left"] > 0) & (below <= s["rank"])
        return F.struct(F.when(taken, s["rank"] - below).otherwise(s["rank"]).alias("rank"), F.when(taken, s["left"] - 1).otherwise(s["left"]).alias("left"), F.when(taken, F.concat(F.array(c), s["places"])).otherwise(s["places"]).alias("places"))

    return F.aggregate(F.sequence(F.lit(n - 1), F.lit(0), F.lit(-1)), zero, place, lambda s: s["places"])


def enumerated(rosters: DataFrame, group: str, size: int, rules: Rules = CLASSIC, block: int = 64, **also: Column) -> DataFrame:
    """(group, rank, starters, sixth, captain) of every legal lineup of each roster; also: columns over players and starters, computed once for all roles.

    rosters: group and players, an array of ``size`` structs (player, position); others have no lineups.  Choices of starters are
    numbered, and blocks of ``block`` numbers are dealt over tasks before they are unranked.
    """
    k = sum(rules.formations[0])
    total = math.comb(size, k)
    blocks = rosters.where(F.size("players") == size).select(group, "players", F.explode(F.sequence(F.lit(0), F.lit((total - 1) // block))).alias("block")).repartition(group, "block")
    ranks = blocks.select(group, "players", F.explode(F.sequence(F.col("block") * block, F.least(F.col("block") * block + (block - 1), F.lit(total - 1)))).alias("rank"))
    once = lambda c: F.explode(F.array(c))  # noqa: E731  a generated column is computed once, whatever filters and columns use it
    placed = ranks.select(group, "players", "rank", once(combination(F.col("rank"), size, k)).alias("places"))
    starters = placed.select(group, "players", "rank", "places", once(F.transform("places", lambda i: F.get("players", i))).alias("starters"))
    at = lambda spot: F.size(F.filter("starters", lambda p: p["position"] == spot))
    counts = F.array(*map(at, rules.counts))
    legal = starters.where(counts.isin(*[F.array(*[F.lit(x) for x in f]) for f in rules.formations]))
    bench = F.filter("players", lambda p, i: ~F.array_contains("places", i))
    each = legal.select(group, "rank", "starters", *(c.alias(n) for n, c in also.items()), F.explode(bench).alias("sixth"))
    return each.select(group, "rank", "starters", "sixth", F.explode("starters").alias("captain"), *also)
