"""Queries on small tables that hold what the given ones rarely do, against their SQL."""

import datetime

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import pacelake.queries as own
from pacelake.operators import models as M
from pacelake.operators import stints as S
from pacelake.operators import temporal as T
from pacelake.queries import registry


@pytest.fixture
def orders_of(tmp_path):
    """Writes orders and lineitem: for each customer the units of its orders, one line each, a day apart."""

    def write(units):
        orders, lines, start = [], [], datetime.datetime(1997, 1, 1)
        for customer, values in units.items():
            for day, u in enumerate(values):
                key = len(orders) + 1
                orders.append({"o_orderkey": key, "o_custkey": customer, "o_orderstatus": "O", "o_totalprice": 1.0, "o_orderdate": start + datetime.timedelta(day), "o_orderpriority": "1-URGENT"})
                lines.append({"l_orderkey": key, "l_partkey": 1, "l_suppkey": 1, "l_linenumber": 1, "l_quantity": float(u), "l_extendedprice": float(u), "l_discount": 0.0, "l_tax": 0.0, "l_returnflag": "N", "l_linestatus": "O", "l_shipdate": start})
        for name, rows in (("orders", orders), ("lineitem", lines)):
            pq.write_table(pa.Table.from_pylist(rows), tmp_path / f"{name}.parquet")
        return str(tmp_path)

    return write


def both(spark, folder, name):
    """Rows of the query and of its SQL."""
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = con.execute(own.ORACLE_SQL[name]).to_arrow_table()
    got = own.QUERIES[name](spark, folder).toArrow().select(want.column_names)
    return (sorted(repr(list(r.values())) for r in x.to_pylist()) for x in (got, want))


def test_correlation_of_a_constant_group(spark, orders_of):
    folder = orders_of({1: [7, 7, 7, 7, 7, 7, 7], 2: [7, 7, 7], 3: [1, 5, 2, 9, 4, 7, 3]})
    got, want = both(spark, folder, "j81_group_correlation")
    assert got == want
    assert len(got) == 1


def test_metrics_of_a_constant_group_have_no_correlation(spark, orders_of):
    (row,) = own.QUERIES["e19_error_metrics"](spark, orders_of({1: [7, 7, 7]})).collect()
    assert (row.n, row.mae, row.pearson) == (2, 0.0, None)


def test_quantiles_of_equal_values_are_monotone(spark, orders_of):
    folder = orders_of({1: [53, 53, 53], 2: [106, 106, 106], 3: [1, 5, 2], 4: [9]})
    got, want = both(spark, folder, "m08_monotone")
    assert got == want == ["['monotone_quantiles', 0]"]


def test_shifted_quantiles_have_no_negative_zero(spark, orders_of):
    folder = orders_of({1: [49, 16, 124, 129, 116, 71], 2: [140, 92, 119, 90, 88, 16, 79, 15, 94, 27, 111, 17]})
    got, want = both(spark, folder, "j65_location_shift")
    assert got == want
    assert "[6, [0.0, 86.8, 97.8]]" in got
    assert not any("-0.0" in row for row in want)


@pytest.fixture
def no_broadcast(spark):
    """Joins by shuffle, as on tables too large to broadcast."""
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k in keys:
        spark.conf.unset(k)


@pytest.mark.parametrize("name", ["j07_accepted_stints", "j07_game_audit", "j07_minute_audit"])
def test_audits_joined_by_shuffle(spark, no_broadcast, name):
    got, want = both(spark, "/root/testdata/sf0.001", name)
    assert list(got) == list(want)


def test_stints_are_dealt_in_as_many_parts_as_asked(spark):
    subs = spark.createDataFrame([(g, "H", 300, p, a) for g in range(40) for p, a in (("S1", "OUT"), ("B1", "IN"))], "game long, side string, at int, player string, action string")
    starters = spark.createDataFrame([(g, "H", f"S{k}") for g in range(40) for k in range(1, 6)], "game long, side string, player string")
    length = spark.createDataFrame([(g, 2400) for g in range(40)], "game long, seconds int")
    few, many = (S.spans(subs, starters, length, parts=n) for n in (2, 7))
    assert many.rdd.getNumPartitions() == 7
    assert sorted(few.collect()) == sorted(many.collect())
    assert few.count() == 240


def test_parts_follow_the_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(registry, "PART_ROWS", 10)
    for n in (1, 100, 1000):
        spark.range(n).write.mode("overwrite").parquet(f"{tmp_path}/lineitem.parquet")
        assert registry.Tables(spark, str(tmp_path)).parts("lineitem") == max(1, n // 10)


def test_histories_are_dealt_in_as_many_parts_as_asked(spark):
    rows = [(i, i % 30, datetime.datetime(1997, 1, 1) + datetime.timedelta(i), float(i)) for i in range(300)]
    seen = spark.createDataFrame(rows, "g long, cust long, t timestamp, v double")
    plain, many = (T.recent_observations(seen, seen, ["cust"], "g", "t", "t", "g", ["v"], 3, n) for n in (None, 7))
    assert many.rdd.getNumPartitions() == 7
    assert sorted(plain.collect()) == sorted(many.collect())


@pytest.mark.parametrize("name", ["j71_event_diagnostics", "f26_pair_history", "j02_player_features", "j12_opponent_shot_features"])
def test_windows_follow_the_rows(spark, monkeypatch, name):
    """A part for each 500 of 6,000 lines, where the session has four."""
    monkeypatch.setattr(registry, "PART_ROWS", 500)
    plan = own.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert f"{36 if name == 'f26_pair_history' else 12}), REPARTITION_BY_NUM" in plan


def test_pairs_of_columns_need_a_row_a_task(spark):
    rows = [(float(i % 17), float(i % 5), 0.1, None if i % 3 else float(i)) for i in range(1000)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(5)
    got = {(r.a, r.b): r for r in M.correlations(df, ["a", "b", "c", "d"]).collect()}
    want = df.agg(*[F.corr(x, y).alias(x + y) for x, y in ("ab", "ad", "bd")]).first()
    assert all(abs(got[x, y].r - want[x + y]) < 1e-12 for x, y in ("ab", "ad", "bd"))
    assert [got[x, y].r for x, y in ("ac", "bc", "cd")] == [None] * 3
    assert (got["a", "d"].n, got["a", "b"].n) == (334, 1000)
    assert "Generate" not in M.correlations(df, ["a", "b"])._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["j07_audit", "j07_player_stints", "j07_minute_audit", "j07_game_audit", "j07_possessions", "j08_rotation", "j09_on_off", "j10_lineup_shares"])
def test_games_are_dealt_once(spark, no_broadcast, monkeypatch, name):
    """Lines and games are dealt before they are grouped; no step behind goes back to the session's number of tasks."""
    monkeypatch.setattr(registry, "PART_ROWS", 500)
    plan = own.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "12), REPARTITION_BY_NUM" in plan
    assert "ENSURE_REQUIREMENTS" not in plan


def test_audit_of_sides_and_spans_alike(spark):
    """A game broken on one side, a good one, one without a box and a box without a game."""
    subs = spark.createDataFrame([("g", "H", 300, "B9", "OUT"), ("g", "H", 300, "B1", "IN"), ("h", "H", 600, "S1", "OUT"), ("h", "H", 600, "B1", "IN")], "game string, side string, at int, player string, action string")
    starters = spark.createDataFrame([(g, s, f"{s}{k}" if s == "A" else f"S{k}") for g in "ghi" for s in "HA" for k in range(1, 6)], "game string, side string, player string")
    length = spark.createDataFrame([(g, 2400) for g in "ghi"], "game string, seconds int")
    box = spark.createDataFrame([("g", "S1", 2400), ("h", "S1", 603), ("h", "B1", 1800), ("h", "N", 9), ("h", "N", 2), ("x", "S1", 5)], "game string, player string, seconds int")
    want = [("g", False, False, "OUT_NOT_ON_COURT", 0, 0, 0, 0, 0, 0), ("h", True, False, "PLAYER_MINUTES_OUTSIDE_TOLERANCE", 3, 1, 2, 1, 9, 12), ("i", True, True, None, 0, 0, 0, 0, 0, 0)]
    for known in (S.sides(subs, starters, length), S.spans(subs, starters, length, parts=3)):
        assert sorted(tuple(r) for r in S.game_audit(known, box, parts=3).collect()) == want
        assert sorted(tuple(r) for r in S.minute_audit(known, box).collect()) == [("h", "B1", 1800, 1800, 0, True), ("h", "N", 9, 0, -9, False), ("h", "S1", 603, 600, -3, True)]


def test_recent_lists_hold_the_recent_observations(spark):
    rows = [(i, i % 7, datetime.datetime(1997, 1, 1) + datetime.timedelta(i // 3), None if i % 11 == 0 else float(i)) for i in range(200)]
    seen = spark.createDataFrame(rows, "g long, cust long, t timestamp, v double")
    args = ("t", "t", "g", ["v"], 3, 5)
    flat = sorted((r.g, r.recency, r.v or -1.0) for r in T.recent_observations(seen, seen, ["cust"], "g", *args).collect())
    lists = T.recent_lists(seen, seen, ["cust"], ["g"], *args)
    got = lists.collect()
    assert len(got) == 200
    assert sorted((r.g, x.recency, x.v or -1.0) for r in got for x in r.recent) == flat
    assert lists.rdd.getNumPartitions() == 5
