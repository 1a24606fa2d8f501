"""The rule ensemble: held-out accuracy, rules as paths, columns as compiled, odd rows."""

import math
import zlib

import pytest

from pacelake.llm import queries, rule_ensemble


@pytest.fixture(scope="module")
def scored(spark):
    folder = "/root/testdata/sf0.1"
    out = queries.op12_rule_ensemble(spark, folder)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    return out.toPandas(), spark.read.parquet(f"{folder}/labels.parquet").toPandas()


def test_held_out_accuracy(scored):
    rows, labels = scored
    assert len(rows) == 10_000 and all(h == (zlib.crc32(str(d).encode()) % 3 == 1) for d, h in zip(rows.doc_id, rows.held_out, strict=True))
    assert rows.score.between(0, 1).all() and (rows.predicted == (rows.score >= 0.5)).all()
    test = rows.merge(labels, on="doc_id").query("held_out")
    n1 = int(test.quality.sum())
    auc = (test.score.rank()[test.quality == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(test) - n1))
    assert auc > 0.98
    assert test[test.quality == 1].predicted.mean() > 0.98 and test[test.quality == 0].predicted.mean() < 0.1


def test_rules_are_the_paths_of_a_tree():
    tree = """DecisionTreeClassificationModel: depth=2
  If (feature 3 <= 0.5)
   If (feature 1 <= 2.0)
    Predict: 0.0
   Else (feature 1 > 2.0)
    Predict: 1.0
  Else (feature 3 > 0.5)
   If (feature 3 <= 0.75)
    Predict: 1.0
   Else (feature 3 > 0.75)
    Predict: 0.0
"""
    inf = math.inf
    assert rule_ensemble.rules_of(tree) == {
        ((3, -inf, 0.5),), ((1, -inf, 2.0), (3, -inf, 0.5)), ((1, 2.0, inf), (3, -inf, 0.5)), ((3, 0.5, inf),), ((3, 0.5, 0.75),), ((3, 0.75, inf),),
    }


def test_statistics_of_a_text(spark, docs_of):
    row = rule_ensemble.statistics(docs_of(["Ab ab, ab ab!\nx #1\nx #1\n"]), "doc_id").first()
    stat = {n: row[f"stat_{n}"] for n in rule_ensemble.NAMES}
    assert (stat["chars"], stat["words"], stat["lines"]) == (24, 8, 3)
    assert stat["variety"] == pytest.approx(math.log(7) / math.log(9)) and stat["echoed_words"] == 0
    assert stat["symbols"] == 2 / 24 and stat["digits"] == 2 / 24 and stat["capitals"] == 1 / 24 and stat["calls"] == 1 / 24
    assert stat["repeated_lines"] == pytest.approx(1 / 3) and stat["ended_lines"] == pytest.approx(1 / 3) and stat["line_words"] == pytest.approx(8 / 3)


def test_the_column_adds_up_the_rules_that_hold(spark, docs_of):
    k = rule_ensemble.NAMES.index("words")
    model = rule_ensemble.Ensemble({((k, 1.0, math.inf),): 2.0, ((k, 1.0, 3.0),): -0.5}, 0.25)
    got = [r.s for r in rule_ensemble.statistics(docs_of(["a", "a b", "a b c d"]), "doc_id").select("doc_id", model.score().alias("s")).orderBy("doc_id").collect()]
    assert got == pytest.approx([1 / (1 + math.exp(-z)) for z in (0.25, 1.75, 2.25)])
    assert model.described() == ["+2.000 if 1 < words", "-0.500 if 1 < words <= 3"]


def test_odd_rows_and_few_labels(spark, docs_of):
    texts = [f"plain text number {i} goes on." if i % 2 else "# # # $ $ $" for i in range(40)] + [None, "", "word " * 300_000]
    docs = docs_of(texts).withColumnRenamed("lang", "stat_chars").withColumnRenamed("source", "Words")
    docs = docs.union(docs.where("doc_id < 5")).union(docs.where("doc_id = 0").selectExpr("cast(null as long) as doc_id", *[f"`{c}`" for c in docs.columns[1:]]))
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (3, None), (1, 0)], "doc_id long, quality int")
    rows = rule_ensemble.classify(docs, labels).collect()
    assert len(rows) == len(texts) + 6 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[40].score == by[41].score and all(by[i].predicted == i % 2 for i in range(40))
    one = rule_ensemble.classify(docs, labels.where("quality = 1")).collect()
    n = sum(1 for i in range(40) if i % 2 and zlib.crc32(str(i).encode()) % 3 != 1)
    assert {round(r.score, 9) for r in one} == {round((n + 1) / (n + 2), 9)}
    assert {r.score for r in rule_ensemble.classify(docs, labels.where("false")).collect()} == {0.5}
    assert rule_ensemble.classify(docs.where("false"), labels).count() == 0
