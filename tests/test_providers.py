import json

import pytest

from pacelake.sources import html as H
from pacelake.sources import providers as V


def page(*tables, row="<tr class='{cls}'>{cells}</tr>"):
    make = lambda r: row.format(cls="", cells="".join(f"<td>{c}</td>" for c in r))
    return "<p>x</p>" + "".join("<table>" + "".join(r if isinstance(r, str) else make(r) for r in t) + "</table>" for t in tables)


def cells(width, **at):
    return [str(at.get(f"c{k}", "")) for k in range(width)]


def both(head, row):
    """Home has the row, away none."""
    return page([head, row], [head])


PLAYER = {"points": 12, "assists": 3}
DOCUMENTS = {
    "acb": (page([["Jugador"], f"<tr><td>7 LEE, A<i class='playerStarterIcon'></i></td>{''.join(f'<td>{x}</td>' for x in cells(22, c1='20:30', c2=12, c5='2/5', c12=3)[1:])}</tr>", cells(22, c0="Total", c2=80)], [["Jugador"]]), {"player_name_raw": "LEE, A", "minutes": 20.5, "starter": True, "three_points_made": 2, "three_points_attempted": 5, "pir": None}),
    "olympiacos": (both(["#", "Player", "PIR"], cells(18, c0=4, c1="Lee", c2="DNP", c3=12, c10=3, c17=-2)), {"player_name_raw": "Lee", "minutes": None, "starter": None, "pir": -2}),
    "lnb_pre": (both(["Joueur"], cells(20, c0=4, c1="Lee", c2="x", c3="10:00", c4=12, c5="6 - 9", c7="2 - 4", c8="0 - 0", c12=3)), {"starter": True, "two_points_made": 4, "two_points_attempted": 5, "three_points_made": 2, "free_throws_attempted": 0}),
    "givemestats": (both(["Player", "MIN", "PTS"], cells(19, c1="Lee", c2="10", c3=12, c4="2/0", c5="1/1", c11=3)), {"minutes": 10.0, "two_points_made": 2, "two_points_attempted": None, "three_points_attempted": 1}),
    "israel": (both(["Player Name", "Min", "VAL"], cells(23, c0=4, c1="Lee", c2="*", c3="1:30", c4=12, c7="1/2", c18=3, c22="-5")), {"starter": True, "minutes": 1.5, "plus_minus": -5, "three_points_attempted": 2}),
    "rincon": (both(["Jugador", "Min", "Val"], cells(15, c0="Lee", c1="5:00", c2=12, c7="1/4", c8=3, c11="0/1", c12="2/-")), {"offensive_rebounds": 1, "defensive_rebounds": 4, "blocks": 0, "blocks_received": 1, "fouls_committed": 2, "fouls_drawn": None}),
    "bbl": ('<script id="__NEXT_DATA__" type="x">' + json.dumps({"props": {"pageProps": {"initialGameStats": {"status": "OFFICIAL", "homeTeam": {"playerStats": [{"points": 12, "assists": 3, "secondsPlayed": 90, "isStartingFive": True, "foulsReceived": 2, "seasonPlayer": {"firstName": "A", "lastName": "Lee", "playerId": 9}}]}, "guestTeam": {"playerStats": []}}}}}) + "</script>", {"player_name_raw": "A Lee", "source_player_id": "9", "minutes": 1.5, "starter": True, "fouls_drawn": 2, "steals": None}),
    "vtb": (json.dumps({"GameTeams": [{"Players": [{"FirstNameEn": "A", "LastNameEn": "Lee", "PersonID": 9, "Seconds": 60, "Points": 12, "Assist": 3, "Shots1": "", "Shots2": "0/2", "Shots3": "4/5", "Rebound": None, "Turnover": 1}]}, {"Players": []}]}), {"two_points_made": 0, "three_points_attempted": 5, "total_rebounds": 0, "plus_minus": None, "blocks_received": None, "efficiency": 12 + 3 - 2 - 1 - 1}),
    "lnb": (json.dumps({"data": {"statistics": {"data": {"base": {"home": {"persons": [{"rows": [{"personName": "A Lee", "personId": "u", "starter": False, "statistics": {"points": 12, "assists": 3, "minutes": "PT12M30S", "foulsTotal": 4}}]}]}, "away": {"persons": [{"rows": []}]}}}}}}), {"minutes": 12.5, "starter": False, "fouls_committed": 4, "source_player_id": "u"}),
    "lkl": (json.dumps({"boxscore": {"home": {"players": [{"name": {"value": "A Lee"}, "slug": "lee", "time": {"value": "3:00"}, "is_starter": True, "points": {"value": 12}, "assists": {"value": "3"}, "fg2": {"value": "1/2"}, "fouls_on": {"value": "-"}}]}, "away": {"players": []}}}), {"two_points_attempted": 2, "three_points_made": None, "fouls_drawn": None, "minutes": 3.0}),
    "lba": (json.dumps({"scores": {"ht": {"rows": [{"player_id": 9, "player_name": "A", "player_surname": "Lee", "sec": 30, "sf": 1, "pun": 12, "ass": 3}, {"player_id": 0, "pun": 80}]}, "vt": {"rows": []}}}), {"minutes": 0.5, "starter": True, "source_player_id": "9"}),
    "fiba": (json.dumps({"tm": {"1": {"pl": {"5": {"firstName": "A", "internationalFamilyName": "Lee", "familyName": "x", "sMinutes": "2:00", "starter": 0, "sPoints": 12, "sAssists": 3}}}, "2": {"pl": {}}}}), {"player_name_raw": "A Lee", "source_player_id": "5", "starter": False, "minutes": 2.0}),
    "flashscore": ("SA÷3¬~PJ÷De Lee A.¬PK÷/player/de-lee-anna/Qx/¬PN÷hh¬PC÷12|-|3|9:30|4|8|1|2|3|4|-|-|-5|1|2|3|4|5|6|7|0¬~PJ÷Twice¬PK÷/p/t/Qx¬PN÷hh¬PC÷1|1|1|1|1|1|1|1|1|1|1|1|1|1|1|1|1|1|1|1|1¬~PJ÷Other¬PK÷/p/o/Qz¬PN÷zz¬PC÷1|1|1|1|1|1|1|1|1|1|1|1|1|1|1|1|1|1|1|1|1", {"player_name_raw": "De Lee A.", "source_player_id": "Qx", "minutes": 9.5, "total_rebounds": 0, "free_throws_made": 0, "plus_minus": -5, "pir": None}),
    "transcribed_box": (json.dumps({"rows": [{"side": "home", "player_name_raw": "Lee", "minutes": "7:30", "points": 12, "assists": 3}]}), {"source_player_id": "Lee:0", "minutes": 7.5, "steals": None}),
}


@pytest.fixture(scope="module")
def read(spark):
    rows = [(k, k, raw, "Home", "Away", "hh", "aa", False) for k, (raw, _) in DOCUMENTS.items()]
    rows += [("bad-json", "lba", "{", "Home", "Away", None, None, False), ("one table", "acb", page([["Jugador"]]), "Home", "Away", None, None, False), ("null", "rincon", None, "Home", "Away", None, None, None), ("unknown", "nobody", "x", "Home", "Away", None, None, False)]
    rows += [("draft", "bbl", DOCUMENTS["bbl"][0].replace("OFFICIAL", "LIVE"), "Home", "Away", None, None, False), ("turned", "fiba", DOCUMENTS["fiba"][0], "Home", "Away", None, None, True)]
    docs = spark.createDataFrame(rows, "game_id string, provider string, raw string, home_team string, away_team string, home_source_code string, away_source_code string, reversed boolean").withColumn("points", V.F.lit("clash"))
    return V.boxes(docs, "game_id")


def test_every_layout(read):
    got = {}
    for r in V.player_rows(read, "game_id").collect():
        got.setdefault(r.game_id, []).append(r.asDict())
    turned = got.pop("turned")
    assert set(got) == set(DOCUMENTS) == set(V.providers())
    for k, (_, want) in DOCUMENTS.items():
        assert len(got[k]) == 1, k
        row = got[k][0]
        assert {c: row[c] for c in want} == want, k
        assert {c: row[c] for c in PLAYER} == PLAYER, k
        assert (row["side"], row["team_name_raw"]) == ("home", "Home"), k
    assert [(r["side"], r["team_name_raw"]) for r in turned] == [("away", "Away")]


def test_what_cannot_be_read(read):
    assert {r.game_id for r in V.rejected(read, "game_id").collect()} == {"bad-json", "one table", "null", "unknown", "draft"}


def test_full_names_of_the_delimited_feed(spark):
    raw = "PJ÷Lee A.¬PK÷/player/lee-anna-b/Qx/¬PN÷hh¬PC÷" + "|".join(["1"] * 21)
    docs = spark.createDataFrame([("g", "flashscore", raw, "H", "A", "hh")], "game_id string, provider string, raw string, home_team string, away_team string, home_source_code string")
    assert [r.player_name_raw for r in V.player_rows(V.boxes(docs, "game_id"), "game_id").collect()] == ["Anna B Lee"]


def test_html_tables(spark):
    text = """<TABLE><tr><th rowspan="2">a<th colspan=2>b &amp; c</tr><tr><th>x<th>x</tr>
        <tr><td rowspan=2>1<td>2<script>no</script><td> 3\n 4 </tr><tr><td>5<td><table><tr><td>inner</td></tr></table>6</table><p>after</p><table></table>"""
    docs = spark.createDataFrame([("d", text, 7), ("none", "plain <b>text", 7), ("null", None, 7)], "k string, raw string, names int").drop("names")
    rows = H.table_rows(docs).orderBy("table_no", "row_no").collect()
    assert [(r.k, r.table_no, r.row_no, r.names, r.cells) for r in rows] == [
        ("d", 0, 2, ["a", "b & c x", "b & c x"], ["1", "2", "3 4"]),
        ("d", 0, 3, ["a", "b & c x", "b & c x"], ["1", "5", "6"]),
        ("d", 1, 0, [], ["inner"]),
    ]
    assert [r.v for r in H.table_rows(docs).where("table_no = 0").select(H.cell("a").alias("v")).collect()] == ["1", "1"]
    assert [len(t["rows"][2]["cells"]) for t in H._tables(text, False)[:1]] == [3]
    assert [len(t["rows"][3]["cells"]) for t in H._tables(text, False)[:1]] == [2]
    assert H._tables("İ" * 50 + "<table><tr><td>x", True) == [{"names": [], "rows": [{"cells": ["x"], "heads": [False], "marks": []}]}]
    wide = H._tables(f"<table><tr><td colspan=99999>x</td></tr><tr><td>{'y' * 2_000_000}</td></tr></table>", True)
    assert len(wide[0]["rows"][0]["cells"]) == 1000 and len(wide[0]["rows"][1]["cells"][0]) == 2_000_000


def test_plain_tags_need_no_parser(monkeypatch):
    """Texts of plain tags are split; with anything else in them the parser reads the whole text, and both give the same."""
    texts = ["<table><tr><TH rowspan=2 class='a b'>x</th><th colspan=\"2\">y &amp; z<tr><td checked>1<br>2</table>", "<table><tr><td>a<table><tr><td>b</table>c</td></tr>d > e"]
    odd = ["<table><tr><td>a<!-- <td> --><td/>b", "<table><tr><td>a<script><td></script>b", "<table><tr><td>1 < 2</td>", "<table><tr><td a='<'>x"]
    plain = lambda x: H._Reader._plain(H._Reader(""), x)
    assert [plain(x) for x in texts + odd] == [True] * 2 + [False] * 4
    read = [H._tables(x, True) for x in texts + odd]
    monkeypatch.setattr(H._Reader, "_plain", lambda self, text: False)
    assert [H._tables(x, True) for x in texts + odd] == read
    monkeypatch.undo()
    monkeypatch.setattr(H, "_Parser", None)
    assert [H._tables(x, True) for x in texts] == read[:2]
