"""Hand-computed values, invariants and brute force for operators."""

import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pacelake.functions import distributions as D
from pacelake.functions import exprs as X
from pacelake.operators import allocation as A
from pacelake.operators import evaluation as E
from pacelake.operators import quality as Q
from pacelake.operators import temporal as T
from pacelake.operators import lineups as L
from pacelake.operators import stints as S
from pacelake.operators.stints import lineups, player_stints
from pacelake.operators import windows as W
from pacelake.operators.windows import History, elo, ewma


FOLDER = "/root/testdata/sf0.001"


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_scoring_by_hand(spark):
    stats = dict(pts=20, reb=7, ast=4, stl=2, blk=1, fd=5, to=3, br=1, fc=2, p2=8, m2=5, p3=5, m3=2, ft=4, mt=4)
    df = spark.createDataFrame([tuple(stats.values())], ", ".join(f"{k} int" for k in stats))
    base = X.base_score(["pts", "reb", "ast", "stl", "blk", "fd"], ["to", "br", "fc"], [("p2", "m2"), ("p3", "m3"), ("ft", "mt")])
    r = df.select(base.alias("base")).select("base", X.with_bonus("base", F.lit(True)).alias("total"), X.with_bonus(F.lit(-2), F.lit(True)).alias("low")).first()
    assert (r.base, round(r.total, 6), round(r.low, 6)) == (27, 29.7, -1.8)


def test_rates_clocks_names(spark):
    r = one(
        spark, poss=X.possessions(F.lit(70), F.lit(10), F.lit(12), F.lit(20)), slow=X.pace(F.lit(90.0), F.lit(45)), short=X.pace(F.lit(90.0), F.lit(39)), clock=X.clock_seconds(F.lit("05:07")), bad=X.clock_seconds(F.lit("05:99")),
        off5=X.period_offset(F.lit(5)), off8=X.period_offset(F.lit(8)), len4=X.period_length(F.lit(4)), iso=X.duration_minutes(F.lit("PT1H2M30S")), dnp=X.duration_minutes(F.lit("DNP")), name=X.display_name(F.lit("DE COLO, NANDO")),
        plain=X.normal_text(F.lit("  Žalgiris--Kaunas! ")), zero=X.ratio(F.lit(1), F.lit(0)), code=X.canonical_code(F.lit("P001")),
    )
    assert (round(r.poss, 6), r.slow, r.short, r.clock, r.bad, r.off5, r.off8, r.len4, r.iso, r.dnp) == (80.8, 80.0, None, 307, None, 2400, 3300, 600, 62.5, None)
    assert (r.name, r.plain, r.zero, r.code) == ("Nando De Colo", "zalgiris kaunas", None, "001")


@pytest.mark.parametrize(("x", "y", "points", "zone"), [(0, 100, 2, "RIM"), (200, 300, 2, "PAINT"), (400, 300, 2, "MIDRANGE"), (670, 100, 3, "CORNER3"), (300, 700, 3, "ABOVE_BREAK3"), (-1, -1, 2, None), (0, 900, 2, None), (0, 100, 3, None), (800, 0, 3, None)])
def test_shot_zones(spark, x, y, points, zone):
    assert one(spark, z=X.shot_zone(F.lit(float(x)), F.lit(float(y)), F.lit(points))).z == zone


def test_coach_points(spark):
    cases = [(5, False, True, 10), (-5, False, False, -5), (30, True, True, 10), (15, False, True, 20), (-15, False, False, -10), (25, False, True, 25), (-25, False, False, -20)]
    df = spark.createDataFrame(cases, "margin int, ot boolean, won boolean, want int")
    assert all(r.got == r.want for r in df.select("want", X.coach_points("margin", "ot", "won").alias("got")).collect())


def side(players, prefix="S"):
    return [("g", "H", f"{prefix}{i}") for i in range(1, players + 1)]


def reconstruct(spark, subs, starters=None):
    s = spark.createDataFrame(subs or [("x", "H", 0, "p", "IN")], "game string, side string, at int, player string, action string")
    return lineups(s, spark.createDataFrame(starters or side(5), "game string, side string, player string"), spark.createDataFrame([("g", 2400)], "game string, seconds int"))


def test_balanced_substitution_gives_two_stints(spark):
    out = reconstruct(spark, [("g", "H", 300, "S1", "OUT"), ("g", "H", 300, "B1", "IN"), ("g", "H", 600, "B1", "OUT"), ("g", "H", 600, "S1", "IN")])
    st = {(r.player, r["from"], r["to"]) for r in player_stints(out).collect()}
    assert {x for x in st if x[0] in ("S1", "B1")} == {("S1", 0, 300), ("B1", 300, 600), ("S1", 600, 2400)}
    assert sum(z - a for _, a, z in st) == 5 * 2400
    assert ("S2", 0, 2400) in st  # intervals that touch are one stint


@pytest.mark.parametrize(
    ("subs", "starters", "reason"),
    [
        ([("g", "H", 300, "S1", "OUT")], None, "UNBALANCED"), ([("g", "H", 300, "B9", "OUT"), ("g", "H", 300, "B1", "IN")], None, "OUT_NOT_ON_COURT"), ([("g", "H", 300, "S1", "OUT"), ("g", "H", 300, "S2", "IN")], None, "IN_ALREADY_ON_COURT"),
        ([], side(4), "STARTERS"), ([("g", "H", 300, "S1", "OUT"), ("g", "H", 300, "S1", "IN")], None, None),
    ],
)
def test_reasons_and_same_clock_no_op(spark, subs, starters, reason):
    rows = reconstruct(spark, subs, starters).collect()
    assert {r.reason for r in rows} == {reason}
    assert [(r["from"], r["to"]) for r in rows] == ([(0, 2400)] if reason is None else [(None, None)])


def audited(spark, subs, box, starters=None):
    s = spark.createDataFrame(subs or [("x", "H", 0, "p", "IN")], "game string, side string, at int, player string, action string")
    known = S.sides(s, spark.createDataFrame(starters or side(5), "game string, side string, player string"), spark.createDataFrame([("g", 2400)], "game string, seconds int"))
    b = spark.createDataFrame([("g", p, n) for p, n in box.items()], "game string, player string, seconds int")
    return S.game_audit(known, b).first(), {r.player: r.difference_seconds for r in S.minute_audit(known, b).collect()}, S.accepted(known, b).count()


def test_games_are_accepted_by_box_minutes(spark):
    swap = [("g", "H", 300, "S1", "OUT"), ("g", "H", 300, "B1", "IN"), ("g", "H", 600, "B1", "OUT"), ("g", "H", 600, "S1", "IN")]
    full = {f"S{i}": 2400 for i in range(2, 6)}
    game, rows, kept = audited(spark, swap, full | {"S1": 2100, "B1": 300})
    assert game.rotation_usable and game.exact_player_rows == 6 and game.maximum_absolute_error_seconds == 0 and kept == 1
    game, rows, kept = audited(spark, swap, full | {"S1": 2105, "B1": 295, "N": 0})  # within five seconds
    assert game.rotation_usable and (game.exact_player_rows, game.near_exact_player_rows) == (5, 7) and rows["S1"] == -5 and rows["N"] == 0
    game, rows, kept = audited(spark, [], full | {"S1": 2460})
    assert game.structurally_reconstructed and not game.rotation_usable and game.outside_tolerance_player_rows == 1 and kept == 0
    assert game.quarantine_reason == "PLAYER_MINUTES_OUTSIDE_TOLERANCE" and game.total_absolute_error_seconds == 60
    game, rows, kept = audited(spark, [("g", "H", 300, "S1", "OUT")], full)  # no minutes of a game that breaks a rule
    assert (game.quarantine_reason, game.player_rows, rows, kept) == ("UNBALANCED", 0, {}, 0) and not game.structurally_reconstructed


def test_stints_against_a_fold_over_the_set_on_court(spark):
    rng = random.Random(5)
    subs, want, reasons = [], set(), {}
    for g in range(150):
        court, since, made, reason = {f"S{i}" for i in range(1, 6)}, dict.fromkeys([f"S{i}" for i in range(1, 6)], 0), set(), None
        for at in sorted(rng.sample(range(0, 2401), rng.randrange(6))):
            pool = sorted(court) if rng.random() < 0.93 else ["S1", "B1", "B2"]
            out, come = rng.choice(pool), rng.choice([x for x in ("S1", "S2", "B1", "B2", "B3") if x not in court or rng.random() < 0.07])
            outs, ins = {out} - {come}, {come} - {out} if rng.random() < 0.95 else set()
            subs += [(str(g), "H", at, out, "OUT")] + [(str(g), "H", at, come, "IN")] * (2 if ins or out == come else 0)
            if out == come:
                continue
            if reason is None:
                reason = "UNBALANCED" if len(ins) != len(outs) else "OUT_NOT_ON_COURT" if not outs <= court else "IN_ALREADY_ON_COURT" if ins & court else None
            if reason is None:
                made |= {(str(g), p, since.pop(p), at) for p in outs}
                since |= dict.fromkeys(ins, at)
                court = court - outs | ins
        reasons[str(g)] = reason
        if reason is None:
            want |= {x for x in made if x[2] < x[3]} | {(str(g), p, a, 2400) for p, a in since.items() if a < 2400}
    starters = [(str(g), "H", f"S{i}") for g in range(150) for i in range(1, 6)]
    known = S.sides(spark.createDataFrame(subs + [("0", "H", None, "S1", "OUT"), ("0", "H", 5, None, "OUT")], "game string, side string, at int, player string, action string"), spark.createDataFrame(starters + starters[:7], "game string, side string, player string"), spark.createDataFrame([(str(g), 2400) for g in range(150)], "game string, seconds int"))
    assert {r.game: r.reason for r in known.collect()} == reasons and len(set(reasons.values())) == 4
    assert {(r.game, r.player, r["from"], r["to"]) for r in S.stints(known).collect()} == want
    courts = S.intervals(known).where("reason is null").collect()
    assert all(len(r.court) == 5 for r in courts)
    inside = {(r.game, p, k) for r in courts for p in r.court for k in range(r["from"], r["to"], 60)}
    assert inside == {(g, p, k) for g, p, a, z in want for r in courts if r.game == g and a <= r["from"] and r["to"] <= z for k in range(r["from"], r["to"], 60)}


def test_elo_first_games(spark):
    g = spark.createDataFrame([(1, 1, "a", "b", True), (1, 2, "b", "a", True)], "season int, n int, h string, v string, won boolean")
    r = {x.n: (x.home_elo, x.away_elo) for x in elo(g, "season", ["n"], "h", "v", "won").collect()}
    expected = 1 / (1 + 10 ** (-70 / 400))
    assert r[1] == (1500, 1500)
    assert np.allclose(r[2], (1500 - 20 * (1 - expected), 1500 + 20 * (1 - expected)))


def test_histories_exclude_the_row_and_ties_stay_apart(spark):
    df = spark.createDataFrame([(1, i, t, float(v)) for i, t, v in [(1, "2024-01-01", 1), (2, "2024-01-02", 2), (3, "2024-01-02", 4), (4, "2024-01-03", 8)]], "p int, id int, t string, v double").withColumn("t", F.col("t").cast("timestamp"))
    h = History("p", "t", "id")
    r = {x.id: x for x in df.select("id", F.sum("v").over(h.before()).alias("order"), F.sum("v").over(h.earlier("t")).alias("time"), ewma("v", h, 0.5).alias("e")).collect()}
    assert [r[i].order for i in (1, 2, 3, 4)] == [None, 1, 3, 7]
    assert [r[i].time for i in (1, 2, 3, 4)] == [None, 1, 1, 7]
    assert r[1].e is None and abs(r[3].e - (2 + 0.5) / 1.5) < 1e-12


def test_as_of_against_brute_force(spark):
    rng = random.Random(2)
    facts = [(i, rng.randrange(3), rng.randrange(20)) for i in range(40)]
    seen = [(100 + i, rng.randrange(3), rng.randrange(20), rng.random()) for i in range(40)]
    f = spark.createDataFrame(facts, "id int, k int, t long").withColumn("t", F.timestamp_seconds("t"))
    o = spark.createDataFrame(seen, "sid int, k int, s long, v double").withColumn("s", F.timestamp_seconds("s"))
    last = {r.id: r.sid for r in T.as_of(f, o, ["k"], "t", "s", "sid", ["sid", "v"]).collect()}
    upto = {r.id: r.sid for r in T.as_of(f, o, ["k"], "t", "s", "sid", ["sid", "v"], strict=False).collect()}
    after = {r.id: r.sid for r in T.next_after(f, o, ["k"], "t", "s", "sid", ["sid"]).collect()}
    three = {}
    for r in T.recent_observations(f, o, ["k"], "id", "t", "s", "sid", ["sid"], 3).collect():
        three.setdefault(r.id, {})[r.recency] = r.sid
    for i, k, t in facts:
        own = sorted((s, sid) for sid, q, s, _ in seen if q == k)
        before = [sid for s, sid in own if s < t]
        assert last[i] == (before[-1] if before else None)
        assert upto[i] == next((sid for s, sid in reversed(own) if s <= t), None)
        assert after[i] == next((sid for s, sid in own if s > t), None)
        assert three.get(i, {}) == {n + 1: sid for n, sid in enumerate(reversed(before[-3:]))}


def test_projection_keeps_total_and_bounds(spark):
    df = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate((50, 45, 30, 20, 10, 5, 0))] + [("b", 0, 10.0)], "team string, p int, raw double")
    r = A.project_to_total(df, ["team"], "p", "raw", 200.0, 0.0, 40.0).collect()
    assert {x.team for x in r} == {"a"}  # one player can't hold 200
    assert abs(sum(x.projected for x in r) - 200) < 1e-6
    assert all(-1e-9 <= x.projected <= 40 + 1e-9 for x in r)


def test_best_roster_against_all_combinations():
    rng = random.Random(4)
    for _ in range(6):
        pool = pd.DataFrame([{"player": i, "position": "GFC"[i % 3], "club": rng.choice("xyz"), "credits": rng.randrange(20, 60) / 10, "value": rng.random() * 10} for i in range(12)])
        best, got = -1.0, L.best_players(pool, {"G": 2, "F": 2, "C": 1}, 20.0, 2)
        for c in itertools.combinations(range(12), 5):
            x = pool.iloc[list(c)]
            if x.position.value_counts().to_dict() == {"G": 2, "F": 2, "C": 1} and x.credits.sum() <= 20.0001 and x.club.value_counts().max() <= 2:
                best = max(best, x.value.sum())
        assert (abs(pool.iloc[got].value.sum() - best) < 1e-9) if got else best < 0


def test_contenders_hold_a_best_roster(spark):
    """The query's rosters are worth as much as the best ones of the whole pools."""
    import pacelake.queries as own

    got = own.QUERIES["j39_best_rosters"](spark, FOLDER).toPandas()
    p = spark.read.parquet(f"{FOLDER}/part.parquet").toPandas()
    pool = pd.DataFrame({"slate": p.p_size % 7, "player": p.p_partkey, "position": ["GFC"[k % 3] for k in p.p_partkey], "club": p.p_brand, "credits": (4 + p.p_retailprice % 12).round(1), "value": (p.p_retailprice * 7 % 40).round(3)})
    counts = {"G": 4, "F": 4, "C": 2}
    assert len(got)
    for slate, x in got.groupby("slate"):
        whole = pool[pool.slate == slate].reset_index(drop=True)
        assert x.position.value_counts().to_dict() == counts and x.credits.sum() < 100.0001 and x.club.value_counts().max() <= 6
        assert abs(x.value.sum() - whole.iloc[L.best_players(whole, counts, 100.0, 6)].value.sum()) < 1e-6
    rng = random.Random(6)
    rows = [(0, i, "GFC"[i % 3], rng.choice("xyz"), rng.randrange(40, 60) / 10, float(rng.randrange(6))) for i in range(60)]
    df = spark.createDataFrame(rows, "slate int, player int, position string, club string, credits double, value double")
    kept, small = A.contenders(df, "slate", {"G": 2, "F": 2, "C": 1}).toPandas(), df.toPandas()
    assert len(kept) < 55
    for limit in (2, 3):
        values = [pool.iloc[L.best_players(pool, {"G": 2, "F": 2, "C": 1}, 25.0, limit)].value.sum() for pool in (small, kept)]
        assert values[0] == values[1] > 0


def test_ranks_in_parts_are_those_of_a_whole_sort(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([None, *range(40)])) for i in range(900)] + [("c", 1000, None)]
    df = spark.createDataFrame(rows, "g string, id int, x int")
    for descending in (False, True):
        got = {r.id: r.k for r in W.numbered(df, ["g"], "x", "id", "k", descending).collect()}
        want = {}
        for g in ("a", "b", None, "c"):
            own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[2] is None, (-r[2] if descending else r[2]) if r[2] is not None else 0, r[1]))
            want |= {r[1]: k for k, r in enumerate(own, 1)}
        assert got == want
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else small ranges are put together
    for hot in (None, 7):  # one value or null in nine rows of ten spreads by the tie
        many = spark.range(40_000).select("id", F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(F.lit(hot)).alias("x"))
        out = W.numbered(many, [], "x", "id", "k")
        per = [spark.read.parquet(f).count() for f in out.inputFiles() if "in-order" in f]
        assert len(per) >= 4 and max(per) < 0.5 * sum(per)
        assert out.groupBy().agg(F.min("k"), F.max("k"), F.count_distinct("k")).first() == (1, 40_000, 40_000)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    counted = df.where("x is not null").groupBy("x").agg(F.count("*").alias("n"))
    known = sorted(r[2] for r in rows if r[2] is not None)
    assert {r.x: r.upto for r in W.cumulated(counted, [], "x").collect()} == {x: sum(v <= x for v in known) for x in set(known)}


def test_pool_adjacent():
    assert D.pool_adjacent(np.array([0.9, 0.5, 0.7, 0.1]), np.ones(4)).tolist() == pytest.approx([0.9, 0.6, 0.6, 0.1])


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([("g", 1.0, 2.0, 0), ("g", 3.0, 3.0, 1), ("g", 5.0, 4.0, 1)], "k string, y double, p double, hit int")
    m = E.error_metrics(df, "y", "p", ["k"]).first()
    assert (m.n, round(m.mae, 6), round(m.rmse, 6), m.bias) == (3, 0.666667, 0.816497, 0.0)
    assert E.spearman(df, "y", "p", ["k"]).first().spearman == pytest.approx(1.0)
    assert E.auc(df, "hit", "p", ["k"]).first().auc == 1.0
    assert E.order_quantile(df, [], "y", 0.8).first().q == 5.0


def test_checks_fail_closed(spark):
    df = spark.createDataFrame([(1, 2), (1, 3), (2, None)], "k int, v int")
    r = {x.check: x.violations for x in Q.report(Q.duplicates("dup", df, ["k"]), Q.many(df, {"null": F.col("v").isNull(), "big": F.col("v") > 9}), Q.orphans("orphan", df, df.where("k = 1"), "k", "k")).collect()}
    assert r == {"dup": 1, "null": 1, "big": 0, "orphan": 1}
    with pytest.raises(Q.IntegrityError, match="dup"):
        Q.require(Q.duplicates("dup", df, ["k"]))
    Q.require(Q.duplicates("fine", df, ["k", "v"]))
    a, b = (Q.fingerprint(x).first() for x in (df, df.orderBy(F.desc("k"))))
    assert a == b


def test_ingest_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a")], "k int, v string")
    new = spark.createDataFrame([(1, "b"), (2, "c"), (2, "c")], "k int, v string")
    fresh = T.insert_missing(old, new, ["k"])
    assert [(r.k, r.v) for r in fresh.collect()] == [(2, "c")]
    assert T.insert_missing(old.union(fresh), new, ["k"]).count() == 0


def test_survival_counts_every_game_of_a_player(spark):
    from pacelake.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    lines, orders = (spark.read.parquet(f"{folder}/{x}.parquet").toPandas() for x in ("lineitem", "orders"))
    games = orders.merge(lines.groupby("l_orderkey").l_quantity.sum().rename("units"), left_on="o_orderkey", right_index=True)
    want = {k: [float((u.astype(float) >= x).mean()) for x in (40, 80, 120, 160)] for k, u in games.groupby("o_custkey").units}
    got = {r.player_id: r.survival for r in QUERIES["j47_monotone_survival"](spark, folder).collect()}
    assert got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k], atol=1e-4) for k in want)


def test_pooling_of_arrays_that_rise(spark):
    df = spark.createDataFrame([([0.9, 0.5, 0.7, 0.1], [1.0, 1.0, 3.0, 1.0]), ([0.1, 0.4, 0.7], [1.0, 1.0, 2.0])], "v array<double>, w array<double>")
    pooled = [r.p for r in df.select(D.decreasing("v", "w").alias("p")).collect()]
    assert np.allclose(pooled[0], [0.9, 0.65, 0.65, 0.1]) and np.allclose(pooled[1], [0.475] * 3)


def test_streamed_dedup_drops_no_late_row(spark, tmp_path):
    import datetime
    import os

    from pacelake.queries import QUERIES

    for i in range(20):  # the newest times come first, so that all of the third trigger is late
        at = datetime.datetime(2024, 1, 1) + datetime.timedelta(days=40 * (19 - i))
        part = str(tmp_path / f"part-{i}")
        spark.createDataFrame([(i, "view", at), (i, "view", at), (99, "click", at)], "user_id long, event_type string, ts timestamp").coalesce(1).write.parquet(part)
        (tmp_path / "events.parquet").mkdir(exist_ok=True)
        name = next(x for x in os.listdir(part) if x.endswith(".parquet"))
        os.rename(f"{part}/{name}", tmp_path / "events.parquet" / f"{i:02}.parquet")
        os.utime(tmp_path / "events.parquet" / f"{i:02}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    rows = QUERIES["k02_streamed_dedup"](spark, str(tmp_path)).collect()
    assert len(rows) == len(set(rows)) == 40


@pytest.mark.parametrize("mode", ["complete", "append"])
def test_a_drained_stream_resumes(spark, tmp_path, mode):
    from pacelake import streaming as S

    table, seen = tmp_path / "in" / "events.parquet", []
    table.mkdir(parents=True)
    schema = "user_id long, event_id long, ts timestamp"
    stream = spark.readStream.schema(schema).parquet(str(table))

    def run():
        wanted = S.current_state(stream, "user_id", "ts", "event_id") if mode == "complete" else S.distinct(stream.select("user_id", "event_id"), "user_id", "event_id")
        return sorted(tuple(r) for r in S.drain(wanted, mode, "resumed", f"file://{tmp_path}/kept").select("user_id", "event_id").collect())

    seen.append(run())
    spark.sql("SELECT 1L AS user_id, 1L AS event_id, timestamp'2024-01-01' AS ts").write.mode("append").parquet(str(table))
    seen += [run(), run()]
    spark.sql("SELECT * FROM VALUES (1L, 2L, timestamp'2024-01-02'), (2L, 3L, timestamp'2023-01-01'), (1L, 1L, timestamp'2024-01-01') AS t(user_id, event_id, ts)").write.mode("append").parquet(str(table))
    seen.append(run())
    last = [(1, 2), (2, 3)] if mode == "complete" else [(1, 1), (1, 2), (2, 3)]
    assert seen == [[], [(1, 1)], [(1, 1)], last]


def test_official_name_variants_and_strong_names(spark):
    from pacelake.operators import identity as I

    rows = spark.createDataFrame([("BALDWIN IV, WADE",), ("BRISSETT, O'SHAE J",), ("Plain Name",), (None,), ("",)], "n string").select("n", I.official_variants(F.col("n")).alias("v")).collect()
    got = {r.n: set(r.v or ()) for r in rows}
    assert "wade baldwin" in got["BALDWIN IV, WADE"] and "baldwin wade" not in got["BALDWIN IV, WADE"]
    assert "oshae brissett" in got["BRISSETT, O'SHAE J"] and got["Plain Name"] == {"plain name"} and got[""] == set() and not got[None]
    pairs = [("Oshae Brissett", "BRISSETT, O'SHAE J", True), ("Nikos Rogkavopoulos", "ROGKAVOPOULOS, NIKOLAOS", True), ("Chiek Diallo", "RADZEVICIUS, GYTIS", False), ("Gur Lavy", "LAVI, GUR", False), ("Wade", "BALDWIN, WADE", False), (None, "A, B", False), ("Al Bo", "BO, AL", True), ("A Bo", "BO, AL", False), ("x y", None, False)]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean")
    assert all(r.got == r.want for r in df.select("want", I.strong_names(F.col("a"), F.col("b")).alias("got")).collect())


def test_tiers_pass_leftovers_on_and_are_unique_on_both_sides(spark):
    from pacelake.operators import identity as I

    persons = spark.createDataFrame([(1, "DOE, JOHN", "t", "7"), (2, "ROE, JANE", "t", "8"), (3, "ROE, JANE", "u", "8"), (4, "POE, NIKOLAOS", "t", "09"), (5, "LONE, A", "v", None), (1, "DOE, JOHN", "t", "7")], "person int, official string, team string, jersey string")
    entries = spark.createDataFrame(
        [("a", "John Doe", "t", "7"), ("b", "Jane Roe", "u", "08"), ("c", "Nikos Poe", "t", "9"), ("d", "Other Man", "t", "8"), ("e", None, None, None), ("f", "A Lone", "v", "1"), ("g", "a lone", "v", "2"), ("h", "x", "t", "7"), ("a", "John Doe", "t", "7")],
        "entry string, name string, team string, jersey string",
    )
    number = F.array(I.jersey_key(F.col("team"), F.col("jersey")))
    tiers = [I.Tier("NAME", F.array(F.array_join(I._plain(F.col("name")), " ")), I.official_variants(F.col("official"))), I.Tier("TEAM_JERSEY", number, number, agree=True)]
    got = {r.entry: (r.person, r.tier, r.status) for r in I.resolve(entries, persons, tiers).collect()}
    assert got == {
        "a": (1, "NAME", "MATCHED"), "b": (3, "TEAM_JERSEY", "MATCHED"), "c": (4, "TEAM_JERSEY", "MATCHED"), "d": (None, None, "INCOMPATIBLE"), "e": (None, None, "UNMATCHED"),
        "f": (None, None, "CONTESTED"), "g": (None, None, "CONTESTED"), "h": (None, None, "UNMATCHED"),
    }
    assert I.resolve(entries.where("false"), persons, tiers).count() == 0
    assert {r.status for r in I.resolve(entries, persons.where("false"), tiers).collect()} == {"UNMATCHED"}


def small_pool(rng, n=13):
    pool = pd.DataFrame([{"slate": 0, "player": f"p{i:02d}", "position": "GFC"[i % 3], "club": rng.choice("xyz"), "credits": rng.randrange(20, 60) / 10, "value": float(rng.randrange(1, 90))} for i in range(n)])
    coaches = pd.DataFrame([{"slate": 0, "coach": f"c{i}", "credits": rng.randrange(10, 40) / 10, "value": float(rng.randrange(-5, 25))} for i in range(3)])
    return pool, coaches


SMALL = L.Rules({"G": 2, "F": 2, "C": 1}, ((1, 1, 1), (2, 1, 0), (1, 2, 0)), 24.0, 2)


def every_lineup(pool, coaches, rules, forced=()):
    """The best objective over all rosters, formations, roles and coaches."""
    best = -math.inf
    spots = list(rules.counts)
    for c in itertools.combinations(range(len(pool)), sum(rules.counts.values())):
        x = pool.iloc[list(c)]
        if x.position.value_counts().reindex(spots, fill_value=0).to_dict() != rules.counts or x.club.value_counts().max() > rules.club_limit or not {f for f in forced if f[0] == "p"} <= set(x.player):
            continue
        lead = max((h.value for h in coaches.itertuples() if x.credits.sum() + h.credits <= rules.budget + 1e-9 and (not any(f[0] == "c" for f in forced) or h.coach in forced)), default=None)
        if lead is None:
            continue
        for s in itertools.combinations(c, sum(rules.formations[0])):
            if tuple(sum(pool.position[i] == p for i in s) for p in spots) in rules.formations:
                rest = [i for i in c if i not in s]
                base = sum(pool.value[i] for i in s) + rules.bench * sum(pool.value[i] for i in rest)
                best = max(best, base + max(pool.value[i] for i in s) * (rules.captain - 1) + max(pool.value[i] for i in rest) * (rules.sixth - rules.bench) + lead)
    return best


def test_joint_optimum_against_all_lineups(spark):
    rng = random.Random(8)
    feasible = 0
    for k in range(6):
        pool, coaches = small_pool(rng)
        forced = [[], ["p03"], ["p00", "c1"], ["p02", "p05", "p08"]]  # the last: three centers of one place
        asked = spark.createDataFrame([(0, str(i), f) for i, f in enumerate(forced)], "slate long, request string, entities array<string>")
        out = L.optimum(spark.createDataFrame(pool), spark.createDataFrame(coaches), "slate", SMALL, asked).toPandas()
        for i, f in enumerate(forced):
            got, want = out[out.request == str(i)], every_lineup(pool, coaches, SMALL, f)
            assert len(got) == (0 if want == -math.inf else 6)
            if len(got):
                feasible += 1
                weight = got.role.map({"CAPTAIN": 2, "STARTER": 1, "SIXTH": 1, "BENCH": 0.5, "COACH": 1})
                assert abs(got.objective.iloc[0] - want) < 1e-9 and abs((got.value * weight).sum() - want) < 1e-9
                assert got.credits.sum() <= 24.0001 and got.club.value_counts().max() <= 2 and set(f) <= set(got.entity)
                start = got[got.role.isin(["CAPTAIN", "STARTER"])]
                assert tuple((start.position == s).sum() for s in "GFC") in SMALL.formations and sorted(got.role)[1:] == ["CAPTAIN", "COACH", "SIXTH", "STARTER", "STARTER"]
    assert feasible >= 12


def test_combinations_are_unranked(spark):
    got = [tuple(r.c) for r in spark.range(math.comb(7, 3)).select(L.combination(F.col("id"), 7, 3).alias("c")).collect()]
    assert len(set(got)) == 35 and set(got) == set(itertools.combinations(range(7), 3))


def test_every_legal_lineup_is_enumerated(spark):
    people = [(f"p{i}", "GFC"[i % 3]) for i in range(6)]
    df = spark.createDataFrame([(1, people), (2, people[:5]), (3, None)], "g int, players array<struct<player: string, position: string>>")
    got = [(frozenset(p.player for p in r.starters), r.sixth.player, r.captain.player) for r in L.enumerated(df, "g", 6, SMALL, block=4).collect()]
    want = set()
    for s in itertools.combinations(people, 3):
        if tuple(sum(p[1] == x for p in s) for x in "GFC") in SMALL.formations:
            want |= {(frozenset(p[0] for p in s), b[0], c[0]) for b in people if b not in s for c in s}
    assert len(got) == len(set(got)) and set(got) == want


def plain_isotonic(points):
    """points: x to list of y; pooled one after another."""
    out = []
    for x in sorted(points):
        out.append([[x], len(points[x]), sum(points[x])])
        while len(out) > 1 and out[-2][2] / out[-2][1] >= out[-1][2] / out[-1][1]:
            b = out.pop()
            out[-1] = [out[-1][0] + b[0], out[-1][1] + b[1], out[-1][2] + b[2]]
    return {x: s / w for xs, w, s in out for x in xs}


@pytest.mark.parametrize("kind", ["noise", "falling", "rising", "one"])
def test_isotonic_pooled_in_ranges(spark, kind):
    from pacelake.operators import isotonic as I

    rng = random.Random(3)
    rows = []
    for g in ("a", None):
        for _ in range(400):
            x = rng.randrange(150) if kind != "one" else 5
            y = {"noise": x / 100 + rng.random(), "falling": -x, "rising": x, "one": rng.random()}[kind]
            rows.append((g, float(x), float(y)))
    df = spark.createDataFrame([*rows, ("a", None, 1.0), ("a", 3.0, None)], "g string, x double, y double")
    for chunk in (4, 1000):
        got = {(r.g, r.x): r.fitted for r in I.fitted(df, ["g"], "x", "y", chunk=chunk).collect()}
        want = {}
        for g in ("a", None):
            points = {}
            for h, x, y in rows:
                if h == g:
                    points.setdefault(x, []).append(y)
            want |= {(g, x): v for x, v in plain_isotonic(points).items()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert I.fitted(df.where("false"), ["g"], "x", "y").count() == 0


def test_marginals_have_the_mean_they_are_matched_to(spark):
    from pacelake.operators import isotonic as I

    levels = [0.1, 0.25, 0.5, 0.9]
    cases = [([1.0, 3.0, 5.0, 20.0], 8.0), ([0.0, 0.0, 1.0, 2.0], 0.1), ([-5.0, 0.0, 1.0, 2.0], 4.0), ([1.0, 1.0, 1.0, 1.0], 0.0), ([1.0, 2.0, 3.0, 4.0], -1.0)]
    df = spark.createDataFrame(cases, "q array<double>, m double").withColumn("l", F.array(*map(F.lit, levels)))
    for r in df.withColumn("new", I.matched(F.col("l"), F.col("q"), F.col("m"), 0.0)).withColumn("mean", I.curve_mean(F.col("l"), F.col("new"))).collect():
        if r.m < 0:
            assert r.new is None
        else:
            assert abs(r["mean"] - r.m) < 1e-6 and min(r.new) >= 0 and r.new == sorted(r.new)


def test_joint_scenarios_against_the_whole_product(spark):
    from pacelake.operators import models as M

    rng = random.Random(1)
    rows = [(g, f"m{i}", rng.choice([rng.random(), 0.0, 1.0, None])) for g in range(12) for i in range(rng.randrange(1, 9))]
    out = M.joint_scenarios(spark.createDataFrame([*rows, (3, None, 0.5)], "g int, m string, p double"), ["g"], "m", "p", 5).collect()
    for g in range(12):
        team = sorted((m, p or 0.0) for h, m, p in rows if h == g)
        every = []
        for flags in itertools.product((0, 1), repeat=len(team)):
            q = math.prod(p if f else 1 - p for f, (_, p) in zip(flags, team))
            if q > 0:
                every.append((q, [m for f, (m, _) in zip(flags, team) if f]))
        every.sort(key=lambda x: -x[0])
        got = sorted((r for r in out if r.g == g), key=lambda r: r.scenario)
        assert np.allclose([r.probability for r in got], [x[0] for x in every[:5]]) and got[0].outs == every[0][1]
        assert abs(got[0].left_out - (1 - sum(x[0] for x in every[:5]))) < 1e-9


def test_walk_forward_ridge_is_that_of_the_seasons_before(spark):
    from pacelake.operators import models as M

    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 3))
    y = x @ [1.0, -2.0, 0.5] + 3 + rng.normal(size=200)
    season = np.repeat([1, 2, 3, 4], 50)
    pdf = pd.DataFrame({"season": season, "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y})
    df = spark.createDataFrame(pdf).union(spark.createDataFrame([(2, None, 1.0, 1.0, 1.0)], "season long, a double, b double, c double, y double"))
    fits = {r.season: r for r in M.walk_forward_ridge(df, "season", ["a", "b", "c"], "y", 0.3).collect()}
    assert fits[1].weights is None and fits[1].trained == 0
    for s in (2, 3, 4):
        old = season < s
        z, t = x[old] - x[old].mean(0), y[old] - y[old].mean()
        w = np.linalg.solve(z.T @ z / old.sum() + 0.3 * np.eye(3), z.T @ t / old.sum())
        assert np.allclose(fits[s].weights, w) and abs(fits[s].intercept - (y[old].mean() - w @ x[old].mean(0))) < 1e-9 and fits[s].trained == old.sum()
    p = M.predicted(df, spark.createDataFrame(list(fits.values()), "season long, trained long, intercept double, weights array<double>"), "season", ["a", "b", "c"]).where("season = 3 and a is not null").toPandas()
    assert np.allclose(p.predicted, p[["a", "b", "c"]] @ fits[3].weights + fits[3].intercept)


def test_all_pairs_find_near_duplicates(spark):
    from pacelake.operators import models as M

    df = spark.range(100).select(F.col("id").alias("a"), (F.col("id") * 2.0 + F.when(F.col("id") == 3, 1).otherwise(0)).alias("b"), (F.col("id") % 7).alias("c"), F.lit(1).alias("d"), F.when(F.col("id") < 50, F.col("id")).alias("e"))
    got = {(r.a, r.b): r for r in M.correlations(df, ["a", "b", "c", "d", "e"]).collect()}
    assert len(got) == 10 and got["a", "b"].near_duplicate and got["a", "e"].n == 50 and got["a", "e"].near_duplicate
    assert got["a", "d"].r is None and not got["a", "d"].near_duplicate and abs(got["a", "c"].r) < 0.3


def test_stages_fail_in_part_and_resume(spark, tmp_path):
    from pacelake.operators import staged as G

    folder, made = f"file://{tmp_path}/state", []

    def stage(name, needs=(), optional=False, fails=False):
        def make(r):
            made.append(name)
            if fails:
                raise ValueError("no\nmore")
            return spark.range(3 + sum(r[n].count() for n in needs))

        return G.Stage(name, make, needs, optional)

    assert G.last_valid(spark, folder) == {}
    assert G.run(spark, folder, "r1", [stage("a"), stage("b", ["a"], optional=True, fails=True), stage("c", ["b"]), stage("d", ["a"])]) == "PARTIAL"
    rows = {r.stage: (r.status, r.error) for r in G.latest(spark, folder, "r1").collect()}
    assert rows == {"a": ("SUCCEEDED", None), "b": ("FAILED", "ValueError: no"), "c": ("SKIPPED", "needs b"), "d": ("SUCCEEDED", None), "*": ("PARTIAL", None)}
    assert made == ["a", "b", "d"] and {k: v.count() for k, v in G.last_valid(spark, folder).items()} == {"a": 3, "d": 6}
    assert G.run(spark, folder, "r2", [stage("a", fails=True), stage("d", ["a"])]) == "FAILED"
    assert {k: v.count() for k, v in G.last_valid(spark, folder).items()} == {"a": 3, "d": 6}  # the state before is untouched
    made.clear()
    assert G.run(spark, folder, "r1", [stage("a"), stage("b", ["a"], optional=True), stage("c", ["b"]), stage("d", ["a"])]) == "SUCCEEDED"
    assert made == ["b", "c"] and {k: v.count() for k, v in G.last_valid(spark, folder).items()} == {"a": 3, "b": 6, "c": 9, "d": 6}


def test_streamed_outcomes_find_late_and_unordered_files(spark, tmp_path):
    from pacelake.queries import QUERIES

    rng = random.Random(4)
    base = 1_700_000_000
    rows = [(i, rng.randrange(6), rng.choice(["signup", "purchase", "view"]), base + rng.randrange(20 * 86_400)) for i in range(240)]
    table = tmp_path / "events.parquet"
    for k in range(12):  # files in the reverse order of time
        part = sorted(rows, key=lambda r: -r[3])[k * 20 : (k + 1) * 20]
        spark.createDataFrame(part, "event_id long, user_id long, event_type string, s long").select("event_id", "user_id", "event_type", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(str(table))
    got = {r.event_id: (r.outcome_id, r.n) for r in QUERIES["k07_streamed_outcomes"](spark, str(tmp_path)).collect()}
    want = {}
    for i, u, kind, s in rows:
        if kind == "signup":
            later = sorted((z, o) for o, v, other, z in rows if other == "purchase" and v == u and s < z <= s + 7 * 86_400)
            want[i] = (later[0][1] if later else None, len(later))
    assert got == want
