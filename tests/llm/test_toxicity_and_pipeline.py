import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from pacelake.llm import common, decontaminate, line_dedup, queries, toxicity
from pacelake.llm.common import words_of


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    out = queries.op8_toxicity(spark, folder)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = out.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").toPandas()
    assert all(h == (zlib.crc32(str(d).encode()) % 5 == 0) for d, h in zip(rows.doc_id, rows.held_out, strict=True))
    test = rows[rows.held_out]
    n1 = int(test.toxic.sum())
    auc = (test.score.rank()[test.toxic == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(test) - n1))
    assert auc > 0.95
    assert test[test.toxic == 1].predicted.mean() > 0.85 and test[test.toxic == 0].predicted.mean() < 0.02


def test_mentions_of_groups_move_the_score_little():
    rng = np.random.default_rng(0)
    n, width = 400, 6  # feature 0: an insult, 5: an identity term that goes along with it
    y = rng.random(n) < 0.4
    x = toxicity.Sparse([np.array([k for k, on in ((0, t and rng.random() < 0.8), (5, t and rng.random() < 0.7), (1 + i % 4, True)) if on]) for i, t in enumerate(y)])
    change = toxicity.Sparse([np.array([5])] * n, [np.ones(1)] * n)
    free, _ = toxicity.fit(y.astype(float), x, change, width, penalty=0.0)
    held, _ = toxicity.fit(y.astype(float), x, change, width, penalty=50.0)
    assert free[5] > 1 and abs(held[5]) < 0.2 * free[5] and held[0] > 1


class Sent:
    def __init__(self, value):
        self.value = value


def test_copies_swap_a_term_for_one_of_its_group():
    names = sorted({f for g in toxicity.IDENTITY_TERMS.values() for t in g for f in toxicity.features_of(t.encode())} | set(toxicity.features_of(b"met")))
    texts = ["we met a muslim", "zwei Frauen und ein hund", "les juifs ont", "los ciegos", "nobody here"]
    batch = pa.RecordBatch.from_pydict({"text": texts, "toxic": [0, 1, 0, 1, 0]})
    rows = next(toxicity._training_rows(Sent(names), iter([batch]))).to_pylist()
    for r, group in zip(rows, ("religion", "gender, de", "religion, fr", "age and ability, es", None), strict=True):
        gained, lost = ({names[i][1:-1].decode() for i in r[k] if names[i][:1] == b"^" and names[i][-1:] == b"$"} for k in ("gained", "lost"))
        assert len(gained) == 1 and len(lost) == (group is not None)
        if group:
            assert gained | lost <= set(toxicity.IDENTITY_TERMS[group]) and not gained & lost
    assert [r["toxic"] for r in rows] == [0, 1, 0, 1, 0]


def test_fewer_false_positives_on_neutral_mentions(spark, docs_of):
    rng = random.Random(4)
    filler = [f"word{i}" for i in range(60)]
    texts, toxic = [], []
    for i in range(600):  # toxic texts name a group far more often than the others do
        bad = i % 3 == 0
        words = rng.choices(filler, k=8) + ["idiot"] * (bad and rng.random() < 0.8) + ["muslim"] * (rng.random() < (0.7 if bad else 0.03))
        texts.append(" ".join(words))
        toxic.append(int(bad))
    docs = docs_of(texts)
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    neutral = [" ".join([*rng.choices(filler, k=8), "muslim"]) for _ in range(200)]
    plain, held = (toxicity.train(docs, labels, penalty=p).scorer() for p in (0.0, toxicity.COUNTERFACTUAL))
    wrong = [sum(score(t) >= 0.5 for t in neutral) for score in (plain, held)]
    assert wrong[0] > 100 and wrong[1] < 0.2 * wrong[0]
    assert held("word1 word2 idiot") >= 0.5


def test_repeated_rows_are_learned_from_once(spark, docs_of):
    docs = docs_of(["a fine text"] * 50 + ["an idiot", None], [1] * 50 + [2, 3])
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 0)], "doc_id long, toxic int")
    assert sorted(map(str, ((r.text, r.toxic) for r in toxicity.labelled(docs, labels).collect()))) == ["('a fine text', 0)", "('an idiot', 1)", "(None, 0)"]


def test_toxicity_edge_cases(spark, docs_of):
    texts = [f"you are a {w} person number {i}" for i, w in enumerate(["idiot", "kind", "idiot", "good"] * 10)] + [None, "", "idiot " * 50_000]
    docs = docs_of(texts).withColumnRenamed("lang", "score")
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(40)] + [(None, 1), (3, None), (0, 0)], "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.classify(docs, labels).collect()}
    assert len(out) == len(texts) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out.values())
    assert out[42].predicted == 1 and out[40].score == out[41].score
    kept = toxicity.clean(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, r in out.items() if not r.predicted}
    none = toxicity.classify(docs, labels.where("toxic = 1")).collect()
    assert len({r.score for r in none}) == 1
    assert toxicity.classify(docs_of([]), labels).count() == 0


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append((name, docs))
    return dict(out)


def test_stages_keep_columns_and_decide(spark, sf, stages):
    names = list(stages)
    assert names == ["documents", "toxicity", "line_dedup", "simhash", "decontamination", "byte_bpe"]
    assert all(stages[n].columns == stages["documents"].columns for n in names[:-1])
    counts = [stages[n].count() for n in names]
    assert counts[0] > counts[1] == counts[2] > counts[3] >= counts[4] == counts[5]


def test_each_stage_on_its_own_input(spark, sf, stages):
    from test_line_dedup import plain_decisions
    from test_simhash import plain_components, plain_fingerprint

    rows = {n: {r.doc_id: r.text for r in stages[n].select("doc_id", *["text"] * (n != "byte_bpe")).collect()} if n != "byte_bpe" else {} for n in stages}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    learned = [d for d in rows["documents"] if labels.get(d) == 1 and zlib.crc32(str(d).encode()) % 5]
    assert sum(d in rows["toxicity"] for d in learned) <= 0.2 * len(learned)
    gone = [d for d in rows["documents"] if d not in rows["toxicity"]]
    assert sum(labels.get(d) == 0 for d in gone) <= 2
    cut = dict(zip(rows["toxicity"], plain_decisions(list(rows["toxicity"].items())), strict=True))
    want = {d: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in set(cut[d])) for d, t in rows["toxicity"].items()}
    assert rows["line_dedup"] == want
    ids = sorted(rows["line_dedup"])
    groups = plain_components(ids, [plain_fingerprint(rows["line_dedup"][d]) for d in ids])
    assert set(rows["simhash"]) == {d for d, g in zip(ids, groups, strict=True) if d == g}
    windows = {tuple(p) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() for p in decontaminate.windows(r.text)}
    sizes = {len(p) for p in windows}
    dirty = {d for d, t in rows["simhash"].items() for w in [words_of(t)] for n in sizes for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows}
    assert set(rows["decontamination"]) == set(rows["simhash"]) - dirty
    last = {r.doc_id: r.decoded_sha256 for r in stages["byte_bpe"].collect()}
    assert last == {d: hashlib.sha256(t.encode()).hexdigest() for d, t in rows["decontamination"].items()}


def test_run_gives_the_last_stages_rows(spark, sf, stages):
    got = sorted(map(tuple, corpus_pipeline.run(spark, sf).collect()))
    assert got == sorted(map(tuple, stages["byte_bpe"].collect()))


def test_a_step_keeps_its_result_alone(spark):
    import os

    root = f"{common.shared_folder(spark)}/pacelake-{spark.sparkContext.applicationId}".removeprefix("file:").replace("//", "/")
    before = set(os.listdir(root)) if os.path.isdir(root) else set()

    def make():
        inner = common.stored(spark.range(10), "inner")
        assert inner.inputFiles()[0].split("/")[-3].startswith("step-")
        return inner.where("id > 3")

    df, path = common.step(spark, make, "kept")
    assert df.count() == 6 and set(os.listdir(root)) - before == {path.split("/")[-1]}
    with pytest.raises(ZeroDivisionError):
        common.step(spark, lambda: common.stored(spark.range(3), "inner").where(str(1 / 0)), "lost")
    assert set(os.listdir(root)) - before == {path.split("/")[-1]}
    assert "step-" not in common.scratch_path(spark, "x")
    common.remove(spark, path)
    common.remove(spark, path)


def test_run_leaves_its_last_table_alone(spark, sf):
    import os

    root = f"{common.shared_folder(spark)}/pacelake-{spark.sparkContext.applicationId}".removeprefix("file:").replace("//", "/")
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    assert corpus_pipeline.run(spark, sf).count() > 0
    assert [x.rsplit("-", 1)[0] for x in set(os.listdir(root)) - before] == ["stage-byte_bpe"]


def test_stages_take_odd_tables(spark, docs_of, sf):
    docs = docs_of([None, "", "some line that is long enough to be judged", "some line that is long enough to be judged", "x"], [None, 1, 2, 2, 3]).withColumnRenamed("source", "Doc")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.count() >= 1, name
        assert stage(spark, docs.where("false"), sf).count() == 0, name
    assert line_dedup.deduplicated(docs).columns == docs.columns
