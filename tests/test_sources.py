import json

from pacelake.sources import boxscores as B
from pacelake.sources import files


def docs(spark, *payloads):
    return spark.createDataFrame([("g1", "HOM", "AWY", json.dumps(p)) for p in payloads], "game_id string, home_team_id string, away_team_id string, raw string")


def test_games(spark):
    def game(h, a, extra, winner):
        return {"id": "x", "gameCode": 7, "season": {"year": 2025, "code": "E2025"}, "played": True, "local": {"club": {"code": "HOM", "name": "Home"}, "score": h, "partials": {"extraPeriods": extra}}, "road": {"club": {"code": "AWY"}, "score": a}, "winner": {"code": winner}, "unknown": 1}

    rows = B.games(docs(spark, {"data": [game(80, 79, {}, "AWY"), game(70, 90, {"1": 5, "2": 6}, "AWY"), game(70, 70, None, None)]})).collect()
    assert [(r.derived_winner_code, r.api_winner_code, r.overtime_periods) for r in rows] == [("HOM", "AWY", 0), ("AWY", "AWY", 2), (None, None, 0)]
    assert (rows[0].season, rows[0].game_code, rows[0].home_team_name, rows[0].venue_name) == (2025, 7, "Home", None)


def test_box_score(spark):
    player = lambda pid, team, minutes, starter: {"Player_ID": f"{pid}  ", "Player": " SURNAME, GIVEN", "Team": f"{team} ", "Minutes": minutes, "IsStarter": starter, "Points": 5}
    box = {"Stats": [{"Team": "Home", "Coach": "C", "PlayersStats": [player("P1", "HOM", "25:30", 1), player("P2", "HOM", "DNP", 0)], "tmr": {"TotalRebounds": 3}, "totr": {"Minutes": "200:00", "Points": 80}}, {"Team": "Away", "PlayersStats": [player("P3", "AWY", " 01:06 ", 0)], "totr": {"Points": 79}}]}
    p = {r.player_id: r for r in B.player_rows(docs(spark, box)).collect()}
    assert {k: (r.minutes, r.did_not_play, r.home_away, r.opponent_id, r.is_starter, r.points) for k, r in p.items()} == {"P1": (25.5, False, "home", "AWY", True, 5), "P2": (None, True, "home", "AWY", False, 5), "P3": (1.1, False, "away", "HOM", False, 5)}
    t = {r.home_away: (r.team_id, r.points, r.team_rebounds_total, r.opponent_id) for r in B.team_rows(docs(spark, box)).collect()}
    assert t == {"home": ("HOM", 80, 3, "AWY"), "away": ("AWY", 79, None, "HOM")}


def test_play_by_play_periods(spark):
    e = lambda n, minute=None, kind="2FGM": {"NUMBEROFPLAY": n, "MINUTE": minute, "PLAYTYPE": kind, "CODETEAM": "HOM "}
    flat = {"FirstQuarter": [e(2), e(1)], "ForthQuarter": [e(3)], "ExtraTime": [e(4, 41), e(5, 46, "EP"), e(6, 46, "BP"), e(7, 61, "EG"), e(8, None)]}
    rows = B.events(docs(spark, flat)).orderBy("source_sequence").collect()
    assert [(r.source_sequence, r.event_number, r.quarter) for r in rows] == [(1, 2, 1), (2, 1, 1), (3, 3, 4), (4, 4, 5), (5, 5, 5), (6, 6, 6), (7, 7, 8), (8, 8, 5)]
    nested = {"SecondQuarter": [e(1)], "ExtraTime": [[e(2)], [e(3), e(4)]]}
    rows = B.events(docs(spark, nested)).orderBy("source_sequence").collect()
    assert [(r.quarter, r.source_period) for r in rows] == [(2, "SecondQuarter"), (5, "ExtraTime1"), (6, "ExtraTime2"), (6, "ExtraTime2")]
    assert rows[0].team_id == "HOM"
    assert B.events(docs(spark, {})).count() == 0
    assert [r.event_number for r in B.latest_sequence(B.events(docs(spark, flat))).collect()] == [1]


def test_shots_and_roster(spark):
    s = B.shots(docs(spark, {"Rows": [{"ID_ACTION": "3FGM", "COORD_X": 1.5}, {"ID_ACTION": "2FGA "}, {"ID_ACTION": "FTM"}]})).orderBy("sequence").collect()
    assert [(r.made, r.points_value) for r in s] == [(True, 3), (False, 2), (True, 1)]
    r = B.roster(docs(spark, {"data": [{"type": "J", "person": {"code": "1"}}, {"type": "E", "person": {"code": "2"}}, {"typeName": "Player", "person": {"code": "3", "country": {"code": "ES"}}}]})).collect()
    assert [(x.player_id, x.nationality_code) for x in r] == [("1", None), ("3", "ES")]


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name\n007,"x ""y"""\n')
    assert [tuple(r) for r in files.csv_text(spark, str(tmp_path / "a.csv")).collect()] == [("007", 'x "y"')]
    x = spark.createDataFrame([("k", "<r><item><a>1</a><b>t</b></item><item><a>2</a></item></r>")], "k string, raw string")
    assert sorted(tuple(r) for r in files.xml_rows(x, "raw", "item", "a int, b string").collect()) == [("k", 1, "t"), ("k", 2, None)]
    old = spark.createDataFrame([("p", "d1")], "path string, digest string")
    new = spark.createDataFrame([("p", "d2"), ("q", "d1"), ("r", "d2")], "path string, digest string")
    assert [r.digest for r in files.unseen(new, old).collect()] == ["d2"]
    assert [(r.path, r.digest) for r in files.conflicts(new, old).collect()] == [("p", "d2")]
    assert files.binary_documents(spark, str(tmp_path / "a.csv")).count() == 1
