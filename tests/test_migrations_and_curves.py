import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pacelake.functions.distributions import shifted_curve
from pacelake.operators.migrations import Migration, log, migrate, tables
from pacelake.plans import shot_features as S


def test_migrations(spark, tmp_path):
    folder = f"file://{tmp_path}/base"
    one = Migration(1, "one", lambda _: {"a": spark.range(3)})
    bad = Migration(2, "two", lambda now: {"a": now["a"].withColumn("x", F.raise_error(F.lit("no")))})
    good = Migration(2, "two", lambda now: {"a": now["a"].withColumn("x", F.col("id") * 2)})
    four = Migration(4, "four", lambda now: {"b": now["a"].limit(1), "a": None})
    assert tables(spark, folder) == {} and log(spark, folder).count() == 0
    assert migrate(spark, folder, [one]) == ["one"]
    with pytest.raises(Exception, match="no"):
        migrate(spark, folder, [one, bad, four])
    assert tables(spark, folder)["a"].columns == ["id"]  # what failed left nothing
    assert migrate(spark, folder, [four, good, one]) == ["two", "four"]
    assert list(tables(spark, folder)) == ["b"] and tables(spark, folder)["b"].columns == ["id", "x"]
    assert migrate(spark, folder, [one, good, four]) == []
    assert migrate(spark, folder, [one, Migration(3, "three", lambda now: {"c": spark.range(0)})]) == ["three"]
    assert {k: v.count() for k, v in tables(spark, folder).items()} == {"b": 1, "c": 0}
    with pytest.raises(ValueError, match="was applied as two"):
        migrate(spark, folder, [Migration(2, "other", lambda now: {})])
    with pytest.raises(ValueError, match="one version"):
        migrate(spark, folder, [one, Migration(1, "x", lambda now: {})])


def plain_shift(p, thresholds, delta, falling):
    """Scalar interpolation in log odds with the outer slopes carried on."""
    odds = [math.log(min(max(x, 1e-6), 1 - 1e-6) / (1 - min(max(x, 1e-6), 1 - 1e-6))) for x in p]
    out = []
    for t in thresholds:
        x = t - delta
        k = max([i for i in range(len(thresholds) - 1) if thresholds[i] <= x], default=0)
        z = odds[k] + (odds[k + 1] - odds[k]) * (x - thresholds[k]) / (thresholds[k + 1] - thresholds[k])
        out.append(1 / (1 + math.exp(-z)))
    return list(np.minimum.accumulate(out) if falling else np.maximum.accumulate(out))


@pytest.mark.parametrize("falling", [True, False])
def test_shifted_curve(spark, falling):
    rng = np.random.default_rng(4)
    thresholds = [10.0, 15.0, 30.0, 50.0]
    rows = [(i, [float(x) for x in sorted(rng.random(4), reverse=falling)], float(rng.normal() * 30)) for i in range(60)]
    rows += [(60, [1.0, 1.0, 0.0, 0.0], 0.0), (61, [0.4, 0.6, 0.5, 0.1], 5.0), (62, None, 1.0), (63, [0.1, None, 0.1, 0.1], 1.0), (64, [0.5] * 4, None)]
    df = spark.createDataFrame(rows, "i int, p array<double>, delta double")
    got = {r.i: r.c for r in df.select("i", shifted_curve("p", thresholds, F.col("delta"), falling).alias("c")).collect()}
    for i, p, delta in rows[:62]:
        assert got[i] == pytest.approx(plain_shift(p, thresholds, delta, falling), abs=1e-9)
    assert got[62] is got[63] is got[64] is None


def test_shot_history_is_strictly_before(spark):
    shots = spark.createDataFrame([(1, "p", 0.0, 0.0, 2, True), (1, "p", -1.0, -1.0, 2, True), (2, "p", 700.0, 0.0, 3, False), (3, "p", 0.0, 700.0, 3, True)], "game int, player string, x double, y double, points int, made boolean")
    games = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02"), (3, "2025-01-02")], "game int, day string").select("game", F.col("day").cast("timestamp").alias("t"), F.substring("day", 1, 4).alias("season"))
    facts = games.withColumn("player", F.lit("p")).withColumn("extra", F.lit(None).cast("string")).unionByName(games.where("game = 1").withColumns({"player": F.lit("q"), "extra": F.lit("x")}))
    seen = S.profiles(shots, "game", "player").join(games, "game")
    out = {(r.player, r.game): r for r in S.rates(S.carried(facts, seen, ["player"], "season", "t", "game"), "player", "game").collect()}
    number = lambda k: (out[k].shot_games_before, out[k].shot_last5_games_n, out[k].shot_attempts_before, out[k].shot_season_rim_attempts, out[k].shot_last5_rim_attempt_rate)
    assert number(("p", 1)) == (0, 0, None, None, None) == number(("q", 1))  # its own game doesn't count, nor another player's
    assert number(("p", 2)) == (1, 1, 1, 1, 1.0)  # the shot without a place is left out
    assert number(("p", 3)) == (2, 2, 2, None, 0.5)  # a new season
    assert out[("p", 3)].shot_source_max_game_time_us < 1_735_776_000_000_000
    assert S.carried(facts.limit(0), seen, ["player"], "season", "t", "game").count() == 0
    assert S.carried(facts, seen.limit(0), ["player"], "season", "t", "game").count() == 4
