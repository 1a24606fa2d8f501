"""Readers of raw documents (survey A7-A13) over JSON and XML that Spark writes from the tables: a document for each order or customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import boxscores as B
from ..sources import html as H
from ..sources import providers as V
from ..sources.files import xml_rows
from .registry import query, r4


def _lines(t):
    """(game_id, lines in order) of each order: the few lines of an order, ties by all their columns."""
    lines = F.sort_array(F.collect_list(F.expr("struct(l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus)")))
    return t("lineitem").groupBy(F.col("l_orderkey").alias("game_id")).agg(lines.alias("m"))


def _boxes(t):
    """Box-score documents: odd lines are the home side, even ones the away side."""
    players = lambda k: f"""transform(filter(m, x -> x.l_linenumber % 2 = {k}), x -> named_struct('Player_ID', concat(' P', x.l_partkey), 'Player', concat('N', x.l_partkey), 'Team', '{"HA"[1 - k]}', 'Dorsal', string(x.l_suppkey),
        'IsStarter', int(x.l_linenumber <= 4), 'IsPlaying', 1, 'Minutes', if(x.l_returnflag = 'R', 'DNP', concat(int(x.l_quantity), ':30')), 'Points', int(x.l_quantity), 'Assistances', int(x.l_suppkey % 7)))"""  # noqa: E731
    side = lambda k: f"""named_struct('Team', '{"HA"[1 - k]}', 'Coach', 'C{k}', 'PlayersStats', {players(k)}, 'tmr', named_struct('TotalRebounds', size(filter(m, x -> x.l_linenumber % 2 = {k}))),
        'totr', named_struct('Minutes', '200:00', 'Points', int(aggregate(filter(m, x -> x.l_linenumber % 2 = {k}), 0D, (a, x) -> a + floor(x.l_quantity)))))"""  # noqa: E731
    return _lines(t).select("game_id", F.lit("H").alias("home_team_id"), F.lit("A").alias("away_team_id"), F.expr(f"to_json(named_struct('Stats', array({side(1)}, {side(0)})))").alias("raw"))


@query("a07_games_feed", """SELECT 'E' || year(o_orderdate) AS season_code, 'G' || o_orderkey AS game_id, CAST(month(o_orderdate) AS INTEGER) AS round, 'C' || o_custkey AS home_team_id, CAST(floor(o_totalprice) % 100 AS INTEGER) AS home_score, CAST(floor(o_totalprice / 100) % 100 AS INTEGER) AS away_score,
    CAST(o_orderkey % 3 AS INTEGER) AS overtime_periods, CASE WHEN floor(o_totalprice) % 100 > floor(o_totalprice / 100) % 100 THEN 'C' || o_custkey WHEN floor(o_totalprice) % 100 < floor(o_totalprice / 100) % 100 THEN 'V' || o_custkey END AS derived_winner_code FROM orders""")
def games_feed(t):
    """A document for each customer and month; extra periods come as an array or as an object."""
    extra = "CASE o_orderkey % 3 WHEN 0 THEN '[]' WHEN 1 THEN '[7]' ELSE '{\"1\": 5, \"2\": 9}' END"
    club = lambda c, score: f"named_struct('club', named_struct('code', concat('{c}', o_custkey), 'name', 'x'), 'score', int({score} % 100), 'partials', named_struct('extraPeriods', {extra}))"
    game = f"named_struct('season', named_struct('year', year(o_orderdate), 'code', concat('E', year(o_orderdate))), 'round', month(o_orderdate), 'id', concat('G', o_orderkey), 'local', {club('C', 'floor(o_totalprice)')}, 'road', {club('V', 'floor(o_totalprice / 100)')})"
    documents = t("orders").groupBy("o_custkey", F.trunc("o_orderdate", "month")).agg(F.to_json(F.struct(F.collect_list(F.expr(game)).alias("data"))).alias("raw"))
    return B.games(documents).select("season_code", "game_id", "round", "home_team_id", "home_score", "away_score", "overtime_periods", "derived_winner_code")


@query("a08_player_box_feed", """SELECT l_orderkey AS game_id, 'P' || l_partkey AS player_id, CASE WHEN l_linenumber % 2 = 1 THEN 'H' ELSE 'A' END AS team_id, CASE WHEN l_linenumber % 2 = 1 THEN 'A' ELSE 'H' END AS opponent_id, CASE WHEN l_linenumber % 2 = 1 THEN 'home' ELSE 'away' END AS home_away, l_linenumber <= 4 AS is_starter,
    CASE WHEN l_returnflag <> 'R' THEN round(floor(l_quantity) + 0.5::DOUBLE, 4) END AS minutes, l_returnflag = 'R' AS did_not_play, CAST(floor(l_quantity) AS INTEGER) AS points, CAST(l_suppkey % 7 AS INTEGER) AS assists FROM lineitem""")
def player_box(t):
    return B.player_rows(_boxes(t)).select("game_id", "player_id", "team_id", "opponent_id", "home_away", "is_starter", "minutes", "did_not_play", "points", "assists")


@query("a09_team_box_feed", """SELECT l_orderkey AS game_id, side AS home_away, max(team_id) AS team_id, max(opponent_id) AS opponent_id, CAST(sum(q) AS INTEGER) AS points, CAST(count(q) AS INTEGER) AS team_rebounds_total FROM (SELECT l_orderkey, CASE WHEN l_linenumber % 2 = 1 THEN 'home' ELSE 'away' END AS side,
    CASE WHEN l_linenumber % 2 = 1 THEN 'H' ELSE 'A' END AS team_id, CASE WHEN l_linenumber % 2 = 1 THEN 'A' ELSE 'H' END AS opponent_id, floor(l_quantity) AS q FROM lineitem UNION ALL SELECT l_orderkey, s, NULL, CASE s WHEN 'home' THEN 'A' ELSE 'H' END, NULL FROM (SELECT DISTINCT l_orderkey, unnest(['home', 'away']) AS s FROM lineitem)) GROUP BY ALL""".replace("sum(q)", "coalesce(sum(q), 0)"))
def team_box(t):
    """Totals as the document gives them; a side without players has no team id."""
    return B.team_rows(_boxes(t)).select("game_id", "home_away", "team_id", "opponent_id", "points", "team_rebounds_total")


@query("a10_play_by_play_feed", """WITH e AS (SELECT *, l_linenumber > 4 AS extra, 41 + floor(l_quantity) % 12 AS m, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus) AS n FROM lineitem)
    SELECT l_orderkey AS game_id, CAST(n AS INTEGER) AS source_sequence, CAST(CASE WHEN NOT extra THEN l_linenumber WHEN l_returnflag = 'R' AND m > 41 AND (m - 41) % 5 = 0 THEN 5 + floor((m - 41) / 5) - 1 ELSE 5 + floor((m - 41) / 5) END AS INTEGER) AS quarter, CASE WHEN l_returnflag = 'R' THEN 'EP' ELSE '2FGM' END AS play_type, 'P' || l_partkey AS player_id FROM e""")
def play_by_play(t):
    """Lines 1 to 4 are the quarters, later ones flat overtime; returned lines are closing markers."""
    event = "x -> named_struct('NUMBEROFPLAY', x.l_linenumber, 'PLAYER_ID', concat('P', x.l_partkey, '  '), 'PLAYTYPE', if(x.l_returnflag = 'R', ' EP', '2FGM'), 'MINUTE', string(41 + int(x.l_quantity) % 12))"
    part = lambda condition: f"transform(filter(m, x -> {condition}), {event})"
    quarters = ", ".join(f"'{q}', {part(f'x.l_linenumber = {k}')}" for k, q in enumerate(B.QUARTERS, 1))
    documents = _lines(t).select("game_id", F.expr(f"to_json(named_struct({quarters}, 'ExtraTime', {part('x.l_linenumber > 4')}))").alias("raw"))
    return B.events(documents).select("game_id", F.col("source_sequence").cast("int").alias("source_sequence"), "quarter", "play_type", "player_id")


@query("a11_shots_feed", "SELECT l_orderkey AS game_id, 'P' || l_partkey AS player_id, CASE l_linenumber % 3 WHEN 0 THEN 'FTM' WHEN 1 THEN '2FGA' ELSE '3FGM' END AS action_id, l_linenumber % 3 <> 1 AS made, CAST(CASE l_linenumber % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS INTEGER) AS points_value, l_quantity AS coordinate_x, CAST(l_linenumber AS INTEGER) AS event_number FROM lineitem")
def shots_feed(t):
    row = "x -> named_struct('NUM_ANOT', x.l_linenumber, 'ID_PLAYER', concat(' P', x.l_partkey), 'ID_ACTION', element_at(array('FTM', '2FGA', '3FGM'), int(x.l_linenumber % 3) + 1), 'COORD_X', x.l_quantity)"
    documents = _lines(t).select("game_id", F.expr(f"to_json(named_struct('Rows', transform(m, {row})))").alias("raw"))
    return B.shots(documents).select("game_id", "player_id", "action_id", "made", "points_value", "coordinate_x", "event_number")


@query("a12_roster_feed", "SELECT 'P' || l_partkey AS player_id, 'T' || l_orderkey AS team_id, CASE WHEN l_linestatus = 'O' THEN 'Guard' ELSE 'Center' END AS position, CAST(l_linenumber AS VARCHAR) AS jersey_number, l_quantity AS height_cm FROM lineitem WHERE l_returnflag <> 'N'")
def roster_feed(t):
    """Lines with the flag N are staff."""
    member = "x -> named_struct('type', if(x.l_returnflag = 'A', 'J', 'E'), 'typeName', if(x.l_returnflag = 'R', 'Player', 'Staff'), 'person', named_struct('code', concat('P', x.l_partkey), 'height', x.l_quantity), 'club', named_struct('code', concat('T', game_id)), 'dorsal', string(x.l_linenumber), 'positionName', if(x.l_linestatus = 'O', 'Guard', 'Center'))"
    documents = _lines(t).select(F.expr(f"to_json(named_struct('data', transform(m, {member})))").alias("raw"))
    return B.roster(documents).select("player_id", "team_id", "position", "jersey_number", "height_cm")


@query("a13_xml_roster_feed", "SELECT l_orderkey AS game_id, count(*) AS players, round(avg(l_quantity), 4) AS mean_height, count(*) FILTER (WHERE l_linestatus = 'O') AS guards FROM lineitem GROUP BY 1")
def xml_roster(t):
    """Roster summary of XML documents."""
    item = "x -> concat('<player><code>P', x.l_partkey, '</code><position>', if(x.l_linestatus = 'O', 'Guard', 'Center'), '</position><height>', x.l_quantity, '</height></player>')"
    documents = _lines(t).select("game_id", F.expr(f"concat('<club>', array_join(transform(m, {item}), ''), '</club>')").alias("raw"))
    rows = xml_rows(documents, "raw", "player", "code string, position string, height double")
    return rows.groupBy("game_id").agg(F.count("*").alias("players"), r4(F.avg("height")).alias("mean_height"), F.count_if(F.col("position") == "Guard").alias("guards"))


@query("a14_html_tables", """SELECT l_orderkey AS game_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus) - 1 + 2 AS INTEGER) AS row_no, 'Order ' || l_orderkey AS game, 'P' || l_partkey AS part, CAST(floor(l_quantity) AS INTEGER) AS quantity, l_returnflag AS flag FROM lineitem""")
def html_tables(t):
    """Tables with a header of two rows, a cell over all rows of an order and a cell over two columns."""
    line = "(x, i) -> concat('<tr>', if(i = 0, concat('<td rowspan=\"', size(m), '\">Order <b>', game_id, '</b>'), ''), '<td>P', x.l_partkey, '</td><td>', int(x.l_quantity), '<td> ', x.l_returnflag, '\\n</td></tr>')"
    head = "<p>x</p><table><tr><th rowspan=2>game</th><th rowspan=2>part</th><th colspan=2>line</th></tr><tr><th>quantity</th><th>flag</th></tr>"
    documents = _lines(t).select("game_id", F.expr(f"concat('{head}', array_join(transform(m, {line}), ''), '</table>')").alias("raw"))
    c = lambda n: H.cell(n)
    return H.table_rows(documents).select("game_id", "row_no", c("game").alias("game"), c("part").alias("part"), c("line quantity").cast("int").alias("quantity"), c("line flag").alias("flag"))


def _provider_boxes(t):
    """A box score of each order in one of five layouts; odd lines are the home side."""
    html = lambda cells, width: "concat('<tr>', array_join(transform(array(" + ", ".join(cells.get(k, "''") for k in range(width)) + "), v -> concat('<td>', v, '</td>')), ''), '</tr>')"
    name, points, assists, three = "concat('N', x.l_partkey)", "string(int(x.l_quantity))", "string(int(x.l_suppkey % 7))", "concat(x.l_linenumber, '/', x.l_linenumber + 2)"
    clock = "if(x.l_returnflag = 'R', '', concat(int(x.l_quantity), ':30'))"
    seconds = "if(x.l_returnflag = 'R', NULL, int(x.l_quantity) * 60 + 30)"
    side = lambda k, f: f"transform(filter(m, x -> x.l_linenumber % 2 = {k}), (x, i) -> {f})"
    table = lambda k, head, f: f"concat('<table><tr>{head}</tr>', array_join({side(k, f)}, ''), '</table>')"
    acb = html({0: f"concat(x.l_linenumber, ' ', {name})", 1: clock, 2: points, 5: three, 12: assists}, 22)
    rincon = html({0: name, 1: clock, 2: points, 4: three, 8: assists}, 15)
    fiba = f"struct(string(i), named_struct('firstName', 'F', 'familyName', {name}, 'sMinutes', {clock}, 'starter', int(x.l_linenumber <= 4), 'sPoints', int({points}), 'sAssists', int({assists}), 'sThreePointersMade', x.l_linenumber, 'sThreePointersAttempted', x.l_linenumber + 2))"
    lba = f"named_struct('player_id', i + 1, 'player_name', 'F', 'player_surname', {name}, 'sec', {seconds}, 'sf', int(x.l_linenumber <= 4), 'pun', int({points}), 'ass', int({assists}), 't3_r', x.l_linenumber, 't3_t', x.l_linenumber + 2)"
    numbers = f"array_join(array({points}, '-', if({assists} = '0', '-', {assists}), {clock}, '', '', '-', '-', string(x.l_linenumber), string(x.l_linenumber + 2), '-', '-', '-', '-', '-', '-', '-', '-', '-', '-', '-'), '|')"
    flash = lambda k: f"concat('PJ÷', {name}, ' F.¬PK÷/player/', lower({name}), '-fay/', i, 's{k}/¬PN÷{'AH'[k]}¬PC÷', {numbers}, '¬')"
    documents = f"""CASE game_id % 5 WHEN 0 THEN concat({table(1, '<th>Jugador</th>', acb)}, {table(0, '<th>Jugador</th>', acb)}) WHEN 1 THEN concat({table(1, '<th>Jugador</th><th>Min</th><th>Val</th>', rincon)}, {table(0, '<th>Jugador</th><th>Min</th><th>Val</th>', rincon)})
        WHEN 2 THEN to_json(named_struct('tm', map('1', named_struct('pl', map_from_entries({side(1, fiba)})), '2', named_struct('pl', map_from_entries({side(0, fiba)})))))
        WHEN 3 THEN to_json(named_struct('scores', named_struct('ht', named_struct('rows', {side(1, lba)}), 'vt', named_struct('rows', {side(0, lba)})))) ELSE array_join(concat({side(1, flash(1))}, {side(0, flash(0))}), '~') END"""
    kind = "element_at(array('acb', 'rincon', 'fiba', 'lba', 'flashscore'), int(game_id % 5) + 1)"
    d = _lines(t).select("game_id", F.expr(kind).alias("provider"), F.expr(documents).alias("raw"), F.lit("Home").alias("home_team"), F.lit("Away").alias("away_team"), F.lit("H").alias("home_source_code"), F.lit("A").alias("away_source_code"))
    return V.boxes(d, "game_id")


@query("a16_provider_boxes", """SELECT l_orderkey AS game_id, ['acb', 'rincon', 'fiba', 'lba', 'flashscore'][l_orderkey % 5 + 1] AS provider, CASE WHEN l_linenumber % 2 = 1 THEN 'home' ELSE 'away' END AS side, CASE WHEN l_linenumber % 2 = 1 THEN 'Home' ELSE 'Away' END AS team_name_raw,
    CASE l_orderkey % 5 WHEN 2 THEN 'F ' WHEN 3 THEN 'F ' WHEN 4 THEN 'Fay ' ELSE '' END || 'N' || l_partkey AS player_name_raw, CASE WHEN l_returnflag <> 'R' THEN round(floor(l_quantity) + 0.5::DOUBLE, 4) END AS minutes, CASE l_orderkey % 5 WHEN 0 THEN false WHEN 2 THEN l_linenumber <= 4 WHEN 3 THEN l_linenumber <= 4 END AS starter,
    CAST(floor(l_quantity) AS BIGINT) AS points, CAST(l_suppkey % 7 AS BIGINT) AS assists, CAST(l_linenumber AS BIGINT) AS three_points_made, CAST(l_linenumber + 2 AS BIGINT) AS three_points_attempted, CASE WHEN l_orderkey % 5 = 4 THEN 0::BIGINT END AS blocks FROM lineitem""")
def provider_boxes(t):
    rows = V.player_rows(_provider_boxes(t), "game_id")
    return rows.select("game_id", "provider", "side", "team_name_raw", "player_name_raw", r4("minutes").alias("minutes"), "starter", "points", "assists", "three_points_made", "three_points_attempted", "blocks")
