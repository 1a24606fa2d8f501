"""Box scores, play-by-play, shots and rosters: raw JSON documents to flat rows.

Each reader takes a DataFrame with the raw document in a string column and its keys in
others, parses it once with a declared schema and explodes it; unknown fields are never
read, missing ones are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The counting statistics of a box score and their columns.
STATISTICS = {
    "Points": "points", "FieldGoalsMade2": "two_pointers_made", "FieldGoalsAttempted2": "two_pointers_attempted", "FieldGoalsMade3": "three_pointers_made", "FieldGoalsAttempted3": "three_pointers_attempted",
    "FreeThrowsMade": "free_throws_made", "FreeThrowsAttempted": "free_throws_attempted", "OffensiveRebounds": "offensive_rebounds", "DefensiveRebounds": "defensive_rebounds", "TotalRebounds": "total_rebounds",
    "Assistances": "assists", "Steals": "steals", "Turnovers": "turnovers", "BlocksFavour": "blocks", "BlocksAgainst": "blocks_received", "FoulsCommited": "fouls_committed", "FoulsReceived": "fouls_drawn",
    "Valuation": "pir", "Plusminus": "plus_minus",
}
#: The arrays of a play-by-play document in order of play.
QUARTERS = ("FirstQuarter", "SecondQuarter", "ThirdQuarter", "ForthQuarter")

_STATS = ", ".join(f"{k}: int" for k in STATISTICS)
_CLUB = "struct<club: struct<code: string, name: string>, score: int, partials: struct<extraPeriods: string>>"
GAME = (
    "season struct<year: int, code: string, competitionCode: string>, phaseType struct<code: string>, round int, id string, identifier string, gameCode int, played boolean, gameStatus string, date string, localDate string, utcDate string, "
    f"local {_CLUB}, road {_CLUB}, venue struct<code: string, name: string, capacity: int>, isNeutralVenue boolean, winner struct<code: string>"
)
BOX = (
    f"Stats array<struct<Team: string, Coach: string, PlayersStats: array<struct<Player_ID: string, Player: string, Team: string, Dorsal: string, IsStarter: int, IsPlaying: int, Minutes: string, {_STATS}>>, "
    f"tmr: struct<OffensiveRebounds: int, DefensiveRebounds: int, TotalRebounds: int>, totr: struct<Minutes: string, {_STATS}>>>"
)
EVENT = "struct<TYPE: string, NUMBEROFPLAY: int, CODETEAM: string, PLAYER_ID: string, PLAYTYPE: string, PLAYER: string, TEAM: string, DORSAL: string, MINUTE: string, MARKERTIME: string, POINTS_A: int, POINTS_B: int, COMMENT: string, PLAYINFO: string>"
SHOT = "Rows array<struct<NUM_ANOT: int, TEAM: string, ID_PLAYER: string, PLAYER: string, ID_ACTION: string, ACTION: string, POINTS: int, COORD_X: double, COORD_Y: double, ZONE: string, FASTBREAK: string, SECOND_CHANCE: string, POINTS_OFF_TURNOVER: string, MINUTE: int, CONSOLE: string, POINTS_A: int, POINTS_B: int, UTC: string>>"
PERSON = "struct<code: string, name: string, alias: string, passportName: string, passportSurname: string, height: double, weight: double, birthDate: string, country: struct<code: string, name: string>, birthCountry: struct<code: string>>"
ROSTER = f"data array<struct<type: string, typeName: string, person: {PERSON}, club: struct<code: string, name: string>, season: struct<code: string>, externalId: string, position: int, positionName: string, dorsal: string, active: boolean, startDate: string, endDate: string>>"


def _extra_periods(side: str) -> Column:
    """The number of extra periods, an array or an object in the raw document."""
    raw = F.col(f"g.{side}.partials.extraPeriods")
    return F.when(raw.startswith("["), F.json_array_length(raw)).when(raw.startswith("{"), F.size(F.json_object_keys(raw))).otherwise(0)


def games(documents: DataFrame, raw: str = "raw") -> DataFrame:
    """A row for each game of documents with a ``data`` array."""
    g = documents.select(F.explode(F.from_json(raw, f"data array<struct<{', '.join(p.replace(' ', ': ', 1) for p in _fields(GAME))}>>").getField("data")).alias("g"))
    home, away = F.col("g.local.score"), F.col("g.road.score")
    winner = F.when(home > away, F.col("g.local.club.code")).when(away > home, F.col("g.road.club.code"))
    names = {
        "season": "season.year", "season_code": "season.code", "competition_code": "season.competitionCode", "phase_code": "phaseType.code", "round": "round", "game_id": "id", "game_identifier": "identifier", "game_code": "gameCode",
        "played": "played", "game_status": "gameStatus", "date": "date", "local_date": "localDate", "utc_date": "utcDate", "home_team_id": "local.club.code", "home_team_name": "local.club.name", "away_team_id": "road.club.code",
        "away_team_name": "road.club.name", "home_score": "local.score", "away_score": "road.score", "venue_code": "venue.code", "venue_name": "venue.name", "venue_capacity": "venue.capacity", "neutral_venue": "isNeutralVenue", "api_winner_code": "winner.code",
    }
    return g.select(*[F.col(f"g.{p}").alias(n) for n, p in names.items()], F.greatest(_extra_periods("local"), _extra_periods("road")).alias("overtime_periods"), winner.alias("derived_winner_code"))


def _fields(ddl: str) -> list[str]:
    """Top-level fields of a schema string."""
    out, depth, start = [], 0, 0
    for i, ch in enumerate(ddl):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(ddl[start:i].strip())
            start = i + 1
    return [*out, ddl[start:].strip()]


def minutes(raw: Column) -> Column:
    """Decimal minutes of MM:SS; null for DNP, blanks and anything else."""
    parts = F.split(F.trim(raw), ":")
    value = parts[0].try_cast("int") + parts[1].try_cast("int") / 60
    return F.when(F.trim(raw).rlike("^[0-9]+:[0-9]+$"), F.round(value, 4))


def player_rows(documents: DataFrame, raw: str = "raw") -> DataFrame:
    """A row for each player; documents carry game_id, home_team_id and away_team_id.  The first of Stats is the home side."""
    s = documents.select("game_id", "home_team_id", "away_team_id", F.posexplode(F.from_json(raw, BOX).getField("Stats")).alias("side", "s"))
    p = s.select("*", F.explode("s.PlayersStats").alias("p"))
    own = lambda f: F.trim(F.col(f"p.{f}"))
    home = F.col("side") == 0
    return p.select(
        "game_id", own("Player_ID").alias("player_id"), own("Player").alias("player_name"), own("Team").alias("team_id"), F.when(home, F.col("away_team_id")).otherwise(F.col("home_team_id")).alias("opponent_id"), F.when(home, "home").otherwise("away").alias("home_away"),
        own("Dorsal").alias("jersey_number"), (F.col("p.IsStarter") == 1).alias("is_starter"), (F.col("p.IsPlaying") == 1).alias("is_playing_flag"), own("Minutes").alias("minutes_raw"), minutes(F.col("p.Minutes")).alias("minutes"),
        F.coalesce(F.upper(own("Minutes")) == "DNP", F.lit(False)).alias("did_not_play"), *[F.col(f"p.{k}").alias(n) for k, n in STATISTICS.items()],
    )


def team_rows(documents: DataFrame, raw: str = "raw") -> DataFrame:
    """A row for each side with its totals (totr) and team rebounds (tmr)."""
    s = documents.select("game_id", "home_team_id", "away_team_id", F.posexplode(F.from_json(raw, BOX).getField("Stats")).alias("side", "s"))
    home = F.col("side") == 0
    return s.select(
        "game_id", F.trim(F.get("s.PlayersStats", F.lit(0)).getField("Team")).alias("team_id"), F.trim("s.Team").alias("team_name"), F.when(home, F.col("away_team_id")).otherwise(F.col("home_team_id")).alias("opponent_id"), F.when(home, "home").otherwise("away").alias("home_away"),
        F.trim("s.Coach").alias("coach"), F.trim("s.totr.Minutes").alias("minutes_raw"), F.col("s.tmr.OffensiveRebounds").alias("team_rebounds_offensive"), F.col("s.tmr.DefensiveRebounds").alias("team_rebounds_defensive"), F.col("s.tmr.TotalRebounds").alias("team_rebounds_total"),
        *[F.col(f"s.totr.{k}").alias(n) for k, n in STATISTICS.items()],
    )


def events(documents: DataFrame, raw: str = "raw") -> DataFrame:
    """Play-by-play in response order with its period; overtime comes as an array for each period, or flat.

    A flat overtime event belongs to the period of its elapsed minute, five minutes each from 41;
    a closing marker (EP, EG) at the first minute of a period closes the one before.
    """
    flat, nested = f"array<{EVENT}>", f"array<array<{EVENT}>>"
    doc = F.from_json(raw, ", ".join([f"{q} {flat}" for q in QUARTERS] + ["ExtraTime string"]))
    extra = F.col("d.ExtraTime")
    is_nested = extra.rlike(r"^\s*\[\s*\[")
    tag = lambda events, period, source: F.transform(events, lambda e: F.struct(period(e).cast("int").alias("quarter"), F.lit(source).alias("source_period"), e.alias("e")))
    elapsed = lambda e: F.coalesce(F.floor(e["MINUTE"].try_cast("double")).cast("int"), F.lit(41))

    def overtime(e: Column) -> Column:
        m = elapsed(e)
        offset = F.greatest(F.lit(0), F.floor((m - 41) / 5))
        closing = F.coalesce(F.trim(e["PLAYTYPE"]).isin("EP", "EG"), F.lit(False)) & (m > 41) & ((m - 41) % 5 == 0)
        return 5 + F.when(closing, F.greatest(F.lit(0), offset - 1)).otherwise(offset)

    empty = F.array().cast(flat)
    parts = [tag(F.coalesce(F.col(f"d.{q}"), empty), lambda e, k=k: F.lit(k), q) for k, q in enumerate(QUARTERS, 1)]
    flat_extra = tag(F.coalesce(F.when(~is_nested, F.from_json(extra, flat)), empty), overtime, "ExtraTime")
    periods = F.transform(F.coalesce(F.when(is_nested, F.from_json(extra, nested)), F.array().cast(nested)), lambda p, i: F.transform(p, lambda e: F.struct((i + 5).cast("int").alias("quarter"), F.concat(F.lit("ExtraTime"), (i + 1).cast("string")).alias("source_period"), e.alias("e"))))
    rows = documents.select("game_id", doc.alias("d")).select("game_id", F.posexplode(F.concat(*parts, flat_extra, F.flatten(periods))).alias("n", "x"))
    names = {"event_type": "TYPE", "event_number": "NUMBEROFPLAY", "game_clock": "MARKERTIME", "elapsed_minute": "MINUTE", "home_score": "POINTS_A", "away_score": "POINTS_B", "comment": "COMMENT", "play_info": "PLAYINFO"}
    trimmed = {"team_id": "CODETEAM", "player_id": "PLAYER_ID", "play_type": "PLAYTYPE", "player_name": "PLAYER", "team_name": "TEAM", "jersey_number": "DORSAL"}
    return rows.select("game_id", (F.col("n") + 1).alias("source_sequence"), F.col("x.quarter").alias("quarter"), F.col("x.source_period").alias("source_period"), *[F.col(f"x.e.{p}").alias(n) for n, p in names.items()], *[F.trim(f"x.e.{p}").alias(n) for n, p in trimmed.items()])


def shots(documents: DataFrame, raw: str = "raw") -> DataFrame:
    """A row for each shot, with whether it was made and what it is worth, from its action code."""
    s = documents.select("game_id", F.posexplode(F.from_json(raw, SHOT).getField("Rows")).alias("n", "s"))
    action = F.trim("s.ID_ACTION")
    names = {"event_number": "NUM_ANOT", "action": "ACTION", "points": "POINTS", "coordinate_x": "COORD_X", "coordinate_y": "COORD_Y", "zone": "ZONE", "fast_break": "FASTBREAK", "second_chance": "SECOND_CHANCE", "points_off_turnover": "POINTS_OFF_TURNOVER", "elapsed_minute": "MINUTE", "game_clock": "CONSOLE", "home_score": "POINTS_A", "away_score": "POINTS_B", "utc_timestamp_raw": "UTC"}
    worth = F.when(action.startswith("3"), 3).when(action.startswith("2"), 2).when(action.startswith("F"), 1)
    return s.select("game_id", (F.col("n") + 1).alias("sequence"), F.trim("s.TEAM").alias("team_id"), F.trim("s.ID_PLAYER").alias("player_id"), F.trim("s.PLAYER").alias("player_name"), action.alias("action_id"), action.endswith("M").alias("made"), worth.alias("points_value"), *[F.col(f"s.{p}").alias(n) for n, p in names.items()])


def roster(documents: DataFrame, raw: str = "raw") -> DataFrame:
    """A row for each player (not staff) of a roster document."""
    m = documents.select(F.explode(F.from_json(raw, ROSTER).getField("data")).alias("m")).where("m.type = 'J' or m.typeName = 'Player'")
    names = {
        "season_code": "season.code", "player_id": "person.code", "external_id": "externalId", "player_name": "person.name", "alias": "person.alias", "passport_name": "person.passportName", "passport_surname": "person.passportSurname", "team_id": "club.code", "team_name": "club.name",
        "position_code": "position", "position": "positionName", "jersey_number": "dorsal", "height_cm": "person.height", "weight_kg": "person.weight", "birth_date": "person.birthDate", "nationality_code": "person.country.code", "nationality": "person.country.name",
        "birth_country_code": "person.birthCountry.code", "active": "active", "membership_start": "startDate", "membership_end": "endDate",
    }
    return m.select(*[F.col(f"m.{p}").alias(n) for n, p in names.items()])


def latest_sequence(rows: DataFrame, game: str = "game_id") -> DataFrame:
    """Events whose number falls behind the one before: order of response and of number disagree."""
    w = Window.partitionBy(game).orderBy("source_sequence")
    return rows.withColumn("before", F.lag("event_number").over(w)).where("event_number < before")
