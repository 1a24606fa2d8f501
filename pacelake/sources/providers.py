"""Box scores of other providers: each layout is a declared mapping to one set of columns.

A layout gives an expression over the raw document: an array of player rows.  All providers of a table of documents are read in one scan, in one
projection; Python runs only where a document holds HTML tables, and sees only those.  Missing statistics stay null.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .html import tables

#: The statistics of a player row.
STATISTICS = (
    "points", "two_points_made", "two_points_attempted", "three_points_made", "three_points_attempted", "free_throws_made", "free_throws_attempted", "offensive_rebounds", "defensive_rebounds", "total_rebounds",
    "assists", "steals", "turnovers", "blocks", "blocks_received", "fouls_committed", "fouls_drawn", "efficiency", "pir", "plus_minus",
)


def whole(x: str) -> str:
    """SQL for a whole number; dashes, blanks and anything else are null."""
    return f"cast(try_cast(trim({x}) AS decimal(20, 4)) AS bigint)"


def played(x: str) -> str:
    """SQL for minutes: MM:SS, an ISO duration or a decimal number; null for DNP, dashes and blanks."""
    iso = "^PT(?:([0-9]+)H)?(?:([0-9]+)M)?(?:([0-9]+(?:[.][0-9]+)?)S)?$"
    part = lambda k: f"coalesce(try_cast(regexp_extract(trim({x}), '{iso}', {k}) AS double), 0)"
    return f"""CASE WHEN trim({x}) LIKE '%:%' THEN try_cast(split_part(trim({x}), ':', 1) AS double) + try_cast(split_part(trim({x}), ':', 2) AS double) / 60
        WHEN trim({x}) RLIKE '{iso}' THEN {part(1)} * 60 + {part(2)} + {part(3)} / 60 ELSE cast(try_cast(trim({x}) AS decimal(20, 8)) AS double) END"""


def made(x: str, mark: str = "/") -> dict[str, str]:
    """SQL for the two halves of 'made/attempted'; null where the mark is missing."""
    half = lambda k: f"if(instr({x}, '{mark}') > 0, {whole(f'split_part({x}, {chr(39)}{mark}{chr(39)}, {k})')}, NULL)"
    return {"made": half(1), "attempted": half(2)}


def _row(side: str, name: str, key: str, minutes: str, starter: str, statistics: dict[str, str]) -> str:
    stats = ", ".join(f"'{s}', cast({statistics.get(s, 'NULL')} AS bigint)" for s in STATISTICS)
    return f"named_struct('side', {side}, 'player_name_raw', cast({name} AS string), 'source_player_id', cast({key} AS string), 'minutes', cast({minutes} AS double), 'starter', cast({starter} AS boolean), {stats})"


def _pairs(shots: dict[str, str], mark: str = "/") -> dict[str, str]:
    return {f"{kind}_{half}": sql for kind, x in shots.items() for half, sql in made(x, mark).items()}


@dataclass(frozen=True)
class Html:
    """The first two tables with a row that has all words of ``header``: home and away.

    ``t`` is a table, ``r`` a row of it and ``c(k)`` its k-th cell; ``player`` tells rows of players from headers and totals.
    """

    header: tuple[str, ...]
    width: int
    player: str
    name: str
    minutes: int
    at: dict[str, int]
    shots: dict[str, int]
    starter: str = "NULL"
    extra: dict[str, str] = field(default_factory=dict)
    mark: str = "/"

    is_html = True

    def rows(self, source: str) -> str:
        words = ", ".join(f"'{w}'" for w in self.header)
        boxes = f"slice(filter({source}, t -> exists(t.rows, r -> size(array_except(array({words}), r.cells)) = 0)), 1, 2)"
        cell = {f"c{k}": f"get(r.cells, {k})" for k in range(self.width)}
        put = lambda sql: sql.format(**cell)
        stats = {s: whole(f"get(r.cells, {k})") for s, k in self.at.items()} | _pairs({s: f"get(r.cells, {k})" for s, k in self.shots.items()}, self.mark) | {s: put(x) for s, x in self.extra.items()}
        row = _row("if(i = 0, 'home', 'away')", put(self.name), put(self.name), played(f"get(r.cells, {self.minutes})"), put(self.starter), stats)
        players = f"flatten(transform(b, (t, i) -> transform(filter(t.rows, r -> size(r.cells) = {self.width} AND {put(self.player)}), r -> {row})))"
        return f"flatten(transform(filter(array({boxes}), b -> size(b) = 2), b -> {players}))"


@dataclass(frozen=True)
class Json:
    """A document ``d`` by its schema, in which {P} stands for a player ``p``; ``statistics`` names the fields, ``types`` what else is read of a player."""

    schema: str
    home: str
    away: str
    name: str
    key: str
    minutes: str
    starter: str
    statistics: dict[str, str]
    types: str
    valid: str = "true"
    player: str = "p IS NOT NULL"
    shots: dict[str, str] = field(default_factory=dict)
    extra: dict[str, str] = field(default_factory=dict)
    of: str = "p"
    inner: str = "{P}"
    value: str = ""
    raw: str = "{raw}"

    is_html = False

    def rows(self, source: str) -> str:
        kind = "struct<value: string>" if self.value else "string"
        fields = [f"{f}: {kind}" for f in self.statistics.values()]
        person = self.inner.replace("{P}", f"struct<{', '.join([*fields, self.types])}>")
        stats = {s: whole(f"{self.of}.{f}{self.value}") for s, f in self.statistics.items()}
        for kind, x in self.shots.items():
            for half, sql in made(x).items():
                stats[f"{kind}_{half}"] = f"if(instr({x}, '/') > 0, {sql}, {stats.get(f'{kind}_{half}', 'NULL')})"
        for s, sql in self.extra.items():
            stats[s] = sql.format(**stats)
        side = lambda s, people: f"transform(filter({people}, p -> {self.player}), p -> {_row(repr(s), self.name, self.key, self.minutes, self.starter, stats)})"
        d = f"from_json({self.raw.format(raw=source)}, '{self.schema.replace('{P}', person)}')"
        return f"flatten(transform(filter(array({d}), d -> {self.valid}), d -> concat({side('home', self.home)}, {side('away', self.away)})))"


#: How each provider names, orders and marks its statistics.
LAYOUTS: dict[str, Html | Json] = {
    "acb": Html(
        header=("Jugador",), width=22, player="{c0} RLIKE '^[0-9]+[ ]'", name="regexp_replace({c0}, '^[0-9]+[ ]+', '')", minutes=1,
        at={"points": 2, "offensive_rebounds": 9, "defensive_rebounds": 10, "total_rebounds": 11, "assists": 12, "turnovers": 13, "steals": 14, "blocks": 15, "blocks_received": 16, "fouls_committed": 18, "fouls_drawn": 19, "plus_minus": 20, "pir": 21},
        shots={"two_points": 3, "three_points": 5, "free_throws": 7}, starter="exists(r.marks, k -> contains(k, 'playerStarterIcon'))",
    ),
    "olympiacos": Html(
        header=("PIR", "Player"), width=18, player="{c0} RLIKE '^[0-9]+$'", name="{c1}", minutes=2,
        at={"points": 3, "offensive_rebounds": 7, "defensive_rebounds": 8, "total_rebounds": 9, "assists": 10, "steals": 11, "turnovers": 12, "blocks": 13, "blocks_received": 14, "fouls_committed": 15, "fouls_drawn": 16, "pir": 17},
        shots={"two_points": 4, "three_points": 5, "free_throws": 6},
    ),
    "lnb_pre": Html(
        header=("Joueur",), width=20, player="{c0} RLIKE '^[0-9]+$'", name="{c1}", minutes=3,
        at={"points": 4, "offensive_rebounds": 9, "defensive_rebounds": 10, "total_rebounds": 11, "assists": 12, "fouls_committed": 13, "fouls_drawn": 14, "steals": 15, "turnovers": 16, "blocks": 17, "blocks_received": 18, "efficiency": 19},
        shots={"three_points": 7, "free_throws": 8}, mark="-", starter="if(exists(t.rows, q -> size(q.cells) = 20 AND get(q.cells, 2) = 'x'), {c2} = 'x', NULL)",
        # all field goals less the threes
        extra={f"two_points_{h}": f"{made('{c5}', '-')[h]} - {made('{c7}', '-')[h]}" for h in ("made", "attempted")},
    ),
    "givemestats": Html(
        header=("Player", "MIN", "PTS"), width=19, player="{c1} NOT IN ('Player', 'TOTAL', 'Team', 'Team Totals')", name="{c1}", minutes=2,
        at={"points": 3, "offensive_rebounds": 8, "defensive_rebounds": 9, "total_rebounds": 10, "assists": 11, "steals": 12, "blocks": 13, "blocks_received": 14, "turnovers": 15, "fouls_committed": 16, "fouls_drawn": 17, "efficiency": 18},
        shots={"two_points": 4, "three_points": 5, "free_throws": 6},
        # attempts below the makes are unknown
        extra={f"{s}_attempted": f"if({made('{c%d}' % k)['made']} > {made('{c%d}' % k)['attempted']}, NULL, {made('{c%d}' % k)['attempted']})" for s, k in (("two_points", 4), ("three_points", 5), ("free_throws", 6))},
    ),
    "israel": Html(
        header=("Player Name", "Min", "VAL"), width=23, player="{c0} RLIKE '^[0-9]+$' AND {c1} <> 'Team'", name="{c1}", minutes=3,
        at={"points": 4, "defensive_rebounds": 11, "offensive_rebounds": 12, "total_rebounds": 13, "fouls_committed": 14, "fouls_drawn": 15, "steals": 16, "turnovers": 17, "assists": 18, "blocks": 19, "blocks_received": 20, "efficiency": 21, "plus_minus": 22},
        shots={"two_points": 5, "three_points": 7, "free_throws": 9}, starter="{c2} = '*'",
    ),
    "rincon": Html(
        header=("Jugador", "Min", "Val"), width=15, player="{c0} NOT IN ('Jugador', 'Totales')", name="{c0}", minutes=1,
        at={"points": 2, "total_rebounds": 6, "assists": 8, "turnovers": 9, "steals": 10, "plus_minus": 13, "efficiency": 14},
        shots={"two_points": 3, "three_points": 4, "free_throws": 5},
        extra={"offensive_rebounds": made("{c7}")["made"], "defensive_rebounds": made("{c7}")["attempted"], "blocks": made("{c11}")["made"], "blocks_received": made("{c11}")["attempted"], "fouls_committed": made("{c12}")["made"], "fouls_drawn": made("{c12}")["attempted"]},
    ),
    "bbl": Json(
        schema="props struct<pageProps: struct<initialGameStats: struct<status: string, homeTeam: struct<playerStats: array<{P}>>, guestTeam: struct<playerStats: array<{P}>>>>>",
        raw="""regexp_extract({raw}, '(?s)<script id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1)""", valid="d.props.pageProps.initialGameStats.status = 'OFFICIAL'",
        home="d.props.pageProps.initialGameStats.homeTeam.playerStats", away="d.props.pageProps.initialGameStats.guestTeam.playerStats",
        types="seasonPlayer: struct<firstName: string, lastName: string, playerId: string>, secondsPlayed: double, isStartingFive: boolean",
        name="concat(p.seasonPlayer.firstName, ' ', p.seasonPlayer.lastName)", key="p.seasonPlayer.playerId", minutes="p.secondsPlayed / 60", starter="p.isStartingFive",
        statistics={"points": "points", "two_points_made": "twoPointShotsMade", "two_points_attempted": "twoPointShotsAttempted", "three_points_made": "threePointShotsMade", "three_points_attempted": "threePointShotsAttempted", "free_throws_made": "freeThrowsMade", "free_throws_attempted": "freeThrowsAttempted", "offensive_rebounds": "offensiveRebounds", "defensive_rebounds": "defensiveRebounds", "total_rebounds": "totalRebounds", "assists": "assists", "steals": "steals", "turnovers": "turnovers", "blocks": "blocks", "fouls_committed": "foulsCommitted", "fouls_drawn": "foulsReceived", "efficiency": "efficiency", "plus_minus": "plusMinus"},
    ),
    "vtb": Json(
        schema="GameTeams array<struct<Players: array<{P}>>>", home="get(d.GameTeams, 0).Players", away="get(d.GameTeams, 1).Players",
        types="FirstNameEn: string, LastNameEn: string, PersonID: string, Seconds: double, IsStart: boolean, Shots1: string, Shots2: string, Shots3: string",
        name="concat(p.FirstNameEn, ' ', p.LastNameEn)", key="p.PersonID", minutes="p.Seconds / 60", starter="p.IsStart", shots={"free_throws": "p.Shots1", "two_points": "p.Shots2", "three_points": "p.Shots3"},
        statistics={"points": "Points", "two_points_made": "Goal2", "two_points_attempted": "Shot2", "three_points_made": "Goal3", "three_points_attempted": "Shot3", "free_throws_made": "Goal1", "free_throws_attempted": "Shot1", "offensive_rebounds": "OffRebound", "defensive_rebounds": "DefRebound", "total_rebounds": "Rebound", "assists": "Assist", "steals": "Steal", "turnovers": "Turnover", "blocks": "Blocks", "fouls_committed": "Foul", "fouls_drawn": "OpponentFoul", "plus_minus": "PlusMinus"},
        # who played has zeros where the feed has nulls, and the plain efficiency
        extra={s: f"if(p.Seconds > 0, coalesce({{{s}}}, 0), {{{s}}})" for s in STATISTICS[:17] if s != "blocks_received"} | {"efficiency": "if(p.Seconds > 0, {points} + {total_rebounds} + {assists} + {steals} + {blocks} - ({two_points_attempted} - {two_points_made}) - ({three_points_attempted} - {three_points_made}) - ({free_throws_attempted} - {free_throws_made}) - {turnovers}, NULL)"},
    ),
    "lnb": Json(
        schema="data struct<statistics: struct<data: struct<base: struct<home: struct<persons: array<struct<rows: array<{P}>>>>, away: struct<persons: array<struct<rows: array<{P}>>>>>>>>",
        home="get(d.data.statistics.data.base.home.persons, 0).rows", away="get(d.data.statistics.data.base.away.persons, 0).rows", inner="struct<statistics: {P}, personName: string, personId: string, starter: boolean>", types="minutes: string", of="p.statistics",
        name="p.personName", key="p.personId", minutes=played("p.statistics.minutes"), starter="p.starter",
        statistics={"points": "points", "two_points_made": "pointsTwoMade", "two_points_attempted": "pointsTwoAttempted", "three_points_made": "pointsThreeMade", "three_points_attempted": "pointsThreeAttempted", "free_throws_made": "freeThrowsMade", "free_throws_attempted": "freeThrowsAttempted", "offensive_rebounds": "reboundsOffensive", "defensive_rebounds": "reboundsDefensive", "total_rebounds": "rebounds", "assists": "assists", "steals": "steals", "turnovers": "turnovers", "blocks": "blocks", "blocks_received": "blocksReceived", "fouls_committed": "foulsTotal", "efficiency": "efficiency", "plus_minus": "plusMinus"},
    ),
    "lkl": Json(
        schema="boxscore struct<home: struct<players: array<{P}>>, away: struct<players: array<{P}>>>", home="d.boxscore.home.players", away="d.boxscore.away.players", value=".value",
        types="name: struct<value: string>, slug: string, time: struct<value: string>, is_starter: boolean, fg2: struct<value: string>, fg3: struct<value: string>, ft: struct<value: string>",
        name="p.name.value", key="p.slug", minutes=played("p.time.value"), starter="p.is_starter", shots={"two_points": "p.fg2.value", "three_points": "p.fg3.value", "free_throws": "p.ft.value"},
        statistics={"points": "points", "offensive_rebounds": "offensive_rebounds", "defensive_rebounds": "defensive_rebounds", "total_rebounds": "total_rebounds", "assists": "assists", "steals": "steals", "turnovers": "turnovers", "blocks": "blocks", "blocks_received": "blocks_received", "fouls_committed": "fouls", "fouls_drawn": "fouls_on", "efficiency": "efficiency", "plus_minus": "plus_minus"},
    ),
    "lba": Json(
        schema="scores struct<ht: struct<rows: array<{P}>>, vt: struct<rows: array<{P}>>>", home="d.scores.ht.rows", away="d.scores.vt.rows", player="coalesce(p.player_id, '') NOT IN ('', '0')",
        types="player_id: string, player_name: string, player_surname: string, sec: double, sf: string", name="concat(p.player_name, ' ', p.player_surname)", key="p.player_id", minutes="p.sec / 60", starter="coalesce(p.sf = '1', false)",
        statistics={"points": "pun", "two_points_made": "t2_r", "two_points_attempted": "t2_t", "three_points_made": "t3_r", "three_points_attempted": "t3_t", "free_throws_made": "tl_r", "free_throws_attempted": "tl_t", "offensive_rebounds": "rimbalzi_o", "defensive_rebounds": "rimbalzi_d", "total_rebounds": "rimbalzi_t", "assists": "ass", "steals": "palle_r", "turnovers": "palle_p", "blocks": "stoppate_dat", "blocks_received": "stoppate_sub", "fouls_committed": "falli_c", "fouls_drawn": "falli_sf", "efficiency": "val_lega", "plus_minus": "plus_minus"},
    ),
    "fiba": Json(
        schema="tm map<string, struct<pl: map<string, {P}>>>", home="map_entries(try_element_at(d.tm, '1').pl)", away="map_entries(try_element_at(d.tm, '2').pl)", of="p.value",
        types="internationalFirstName: string, firstName: string, internationalFamilyName: string, familyName: string, sMinutes: string, starter: string",
        name="concat_ws(' ', coalesce(nullif(p.value.internationalFirstName, ''), nullif(p.value.firstName, '')), coalesce(nullif(p.value.internationalFamilyName, ''), nullif(p.value.familyName, '')))", key="p.key", minutes=played("p.value.sMinutes"), starter="p.value.starter NOT IN ('0', 'false', '')",
        statistics={"points": "sPoints", "two_points_made": "sTwoPointersMade", "two_points_attempted": "sTwoPointersAttempted", "three_points_made": "sThreePointersMade", "three_points_attempted": "sThreePointersAttempted", "free_throws_made": "sFreeThrowsMade", "free_throws_attempted": "sFreeThrowsAttempted", "offensive_rebounds": "sReboundsOffensive", "defensive_rebounds": "sReboundsDefensive", "total_rebounds": "sReboundsTotal", "assists": "sAssists", "steals": "sSteals", "turnovers": "sTurnovers", "blocks": "sBlocks", "blocks_received": "sBlocksReceived", "fouls_committed": "sFoulsPersonal", "fouls_drawn": "sFoulsOn", "plus_minus": "sPlusMinusPoints", "efficiency": "eff_1"},
    ),
}
#: The order of the numbers in a delimited feed; None is not kept.
DELIMITED = (
    "points", "total_rebounds", "assists", "minutes", None, None, "two_points_made", "two_points_attempted", "three_points_made", "three_points_attempted", "free_throws_made", "free_throws_attempted", "plus_minus",
    "offensive_rebounds", "defensive_rebounds", "fouls_committed", "steals", "turnovers", "blocks", "blocks_received", None,
)


def _delimited(raw: str) -> str:
    """Blocks of ``key÷value`` parts; players have PJ (surname and initial), PK (a path with the full name and the id), PN (the side's code) and PC (the numbers).

    A dash is zero.  Of a player who comes twice the first block counts.
    """
    part = lambda key: f"substring(try_element_at(filter(split(b, '¬'), x -> startswith(x, '{key}÷')), -1), 4)"
    block = f"named_struct('pj', {part('PJ')}, 'path', split(trim(BOTH '/' FROM {part('PK')}), '/'), 'side', CASE {part('PN')} WHEN home_source_code THEN 'home' WHEN away_source_code THEN 'away' END, 'v', split({part('PC')}, '[|]'))"
    valid = f"filter(transform(split({raw}, '¬~'), b -> {block}), p -> p.pj IS NOT NULL AND p.side IS NOT NULL AND size(p.path) >= 2 AND size(p.v) = {len(DELIMITED)})"
    first = f"flatten(transform(array({valid}), v -> filter(v, (p, i) -> array_position(transform(v, q -> element_at(q.path, -1)), element_at(p.path, -1)) = i + 1)))"
    surname = "regexp_replace(p.pj, ' [^ ]*$', '')"
    slug, own = "element_at(p.path, -2)", f"regexp_replace(lower({surname}), '[^a-z0-9-]', '')"
    name = f"if(startswith({slug}, concat({own}, '-')) AND length({slug}) > length({own}) + 1, concat(initcap(replace(substring({slug}, length({own}) + 2), '-', ' ')), ' ', {surname}), p.pj)"
    stats = {s: f"if(trim(get(p.v, {k})) = '-', 0, {whole(f'get(p.v, {k})')})" for k, s in enumerate(DELIMITED) if s and s != "minutes"}
    return f"transform({first}, p -> {_row('p.side', name, 'element_at(p.path, -1)', played(f'get(p.v, {DELIMITED.index("minutes")})'), 'NULL', stats)})"


def _transcribed(raw: str) -> str:
    """Rows written down by hand, in the columns of the result."""
    schema = "rows array<struct<side: string, player_name_raw: string, source_player_id: string, minutes: string, starter: boolean, " + ", ".join(f"{s}: string" for s in STATISTICS) + ">>"
    row = _row("p.side", "p.player_name_raw", "coalesce(nullif(p.source_player_id, ''), concat(p.player_name_raw, ':', i))", played("p.minutes"), "p.starter", {s: whole(f"p.{s}") for s in STATISTICS})
    return f"transform(from_json({raw}, '{schema}').rows, (p, i) -> {row})"


def providers() -> list[str]:
    return [*LAYOUTS, "flashscore", "transcribed_box"]


def boxes(documents: DataFrame, *keys: str, raw: str = "raw", provider: str = "provider") -> DataFrame:
    """A row for each document: keys, provider, the names and codes of its sides, and ``players``, an array.

    Documents carry the provider's key, home_team and away_team, and may carry home_code and away_code, the delimited feed's home_source_code and
    away_source_code, and ``reversed`` (the document names the away side first).  A document without two player tables, of another
    shape, not final or of an unknown provider has null or no players; ``rejected`` finds it.
    """
    there = set(documents.columns)
    optional = {c: "string" for c in ("home_code", "away_code", "home_source_code", "away_source_code")} | {"reversed": "boolean"}
    docs = documents.select(*keys, F.col(provider).alias("provider"), F.col(raw).alias("raw"), "home_team", "away_team", *[F.col(c) if c in there else F.lit(None).cast(t).alias(c) for c, t in optional.items()])
    html = [k for k, x in LAYOUTS.items() if x.is_html]
    docs = docs.withColumn("html", tables(F.when(F.col("provider").isin(html), F.col("raw")), spread=False))
    cases = {k: x.rows("html" if x.is_html else "raw") for k, x in LAYOUTS.items()} | {"flashscore": _delimited("raw"), "transcribed_box": _transcribed("raw")}
    players = F.expr(f"CASE provider {' '.join(f"WHEN '{k}' THEN {sql}" for k, sql in cases.items())} END")
    return docs.select(*keys, "provider", "home_team", "away_team", "home_code", "away_code", "reversed", players.alias("players"))


def player_rows(read: DataFrame, *keys: str) -> DataFrame:
    """A row for each player of ``boxes``, with the name and code of the side."""
    p = read.select(*keys, "provider", "home_team", "away_team", "home_code", "away_code", F.coalesce("reversed", F.lit(False)).alias("reversed"), F.explode_outer("players").alias("p")).where("p is not null")  # explode would have its array made twice, for a filter of its size
    home = (F.col("p.side") == "home") != F.col("reversed")
    by_side: dict[str, Column] = {"side": F.when(home, "home").otherwise("away"), "team_name_raw": F.when(home, F.col("home_team")).otherwise(F.col("away_team")), "team_code": F.when(home, F.col("home_code")).otherwise(F.col("away_code"))}
    return p.select(*keys, "provider", *[c.alias(n) for n, c in by_side.items()], *[f"p.{c}" for c in ("player_name_raw", "source_player_id", "minutes", "starter", *STATISTICS)])


def rejected(read: DataFrame, *keys: str) -> DataFrame:
    """Documents of ``boxes`` without a player row."""
    return read.where(F.coalesce(F.size("players"), F.lit(0)) <= 0).select(*keys, "provider")
