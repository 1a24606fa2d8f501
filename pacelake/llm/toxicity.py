"""Toxicity classifier with counterfactual regularisation.

A logistic model over binary features of a text: its words, and beginnings and inner
pieces of its words, so that inflections and compounds that were never labelled still
count.  Training pairs each labelled text with copies in which an identity term is swapped
for another of its group, and in which all of them are left out (a text without one gets a mention of a term), and
penalises the squared change of the score: terms of a group count alike, and a group's mention alone moves the score little.
Terms are always features, hence always held down.

Terms are given for each language that the texts are written in.

Features are picked by how far their document frequencies in toxic and other labelled
texts differ, and the model is fitted on ``TRAIN_DOCS`` labelled texts at most, taken by a
hash of doc_id, one text for each id: a stated bound, the same at every corpus size.  Counts, pick and fit see
those texts only; scoring reads every text whole, in one pass, through a worker's
word cache.

A label is 1 if any row of its doc_id says so; null ids and labels are no labels.  Of several
rows with a labelled id the text with the least hash is learned from.  Null and empty texts get the score of a
text without features.  Rows are scored one by one, so repeated rows and extra columns
change nothing; empty tables give empty tables; without labels of both kinds the score is
the smoothed share of toxic labels.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import own_name, slices, stored, words_of

#: Labelled texts to learn from, and features of the model.
TRAIN_DOCS, FEATURES = 20_000, 4_096
#: Least number of training texts with a feature, and lengths of pieces of words.
MIN_TEXTS, PIECES = 3, (4, 5)
#: Weights of the ridge and of the counterfactual penalty; steps of the fit.
RIDGE, COUNTERFACTUAL, STEPS = 0.02, 5.0, 300
#: Words that a worker remembers.
CACHE = 300_000

#: Identity terms by group; a term is swapped for the others of its group.
IDENTITY_TERMS = {
    "religion": ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    "origin": ("black", "white", "asian", "african", "latino", "european", "immigrant"),
    "gender": ("woman", "man", "women", "men", "female", "male", "transgender"),
    "orientation": ("gay", "straight", "lesbian", "bisexual", "queer"),
    "age_and_ability": ("old", "young", "deaf", "blind", "disabled"),
    "religion, de": ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten", "katholiken"),
    "origin, de": ("schwarze", "weiße", "asiaten", "afrikaner", "europäer", "einwanderer", "flüchtlinge"),
    "gender, de": ("frau", "mann", "frauen", "männer", "transfrauen", "transmänner"),
    "orientation, de": ("schwule", "lesben", "bisexuelle", "heterosexuelle"),
    "age and ability, de": ("alte", "junge", "gehörlose", "blinde", "behinderte"),
    "religion, fr": ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées", "catholiques"),
    "origin, fr": ("noirs", "blancs", "asiatiques", "africains", "européens", "immigrés", "réfugiés"),
    "gender, fr": ("femme", "homme", "femmes", "hommes", "transgenres"),
    "orientation, fr": ("homosexuels", "lesbiennes", "bisexuels", "hétérosexuels"),
    "age and ability, fr": ("vieux", "jeunes", "sourds", "aveugles", "handicapés"),
    "religion, es": ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos", "católicos"),
    "origin, es": ("negros", "blancos", "asiáticos", "africanos", "europeos", "inmigrantes", "refugiados"),
    "gender, es": ("mujer", "hombre", "mujeres", "hombres", "transexuales"),
    "orientation, es": ("homosexuales", "lesbianas", "bisexuales", "heterosexuales"),
    "age and ability, es": ("viejos", "jóvenes", "sordos", "ciegos", "discapacitados"),
}


def features_of(word: bytes) -> list[bytes]:
    """A word's features: itself (with marks of both ends), its beginnings and its pieces."""
    marked = b"^" + word + b"$"
    out = [marked]
    for n in PIECES:
        out += [marked[i : i + n] for i in range(len(marked) - n + 1)]
    return out


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = (Counter(), Counter())
    cache: dict[bytes, list[bytes]] = {}
    for b in slices(batches):
        for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
            own: set[bytes] = set()
            for w in set(words_of(text)):
                if w not in cache:
                    cache[w] = features_of(w)
                own.update(cache[w])
            counts[bool(toxic)].update(own)
        if len(cache) > CACHE:
            cache.clear()
    names = list(counts[0].keys() | counts[1].keys())
    cols = [pa.array(names, pa.binary()), *(pa.array([c[n] for n in names], pa.int64()) for c in counts)]
    yield pa.RecordBatch.from_arrays(cols, ["feature", "n0", "n1"])


def labelled(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS) -> DataFrame:
    """text and toxic of ``limit`` labelled documents at most, stored; labels has doc_id and toxic."""
    marks = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)  # at most limit rows
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    one = texts.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("toxic").cast("int").alias("toxic"))
    return stored(one.select("text", "toxic"), "labelled-texts")


def _indices(words: set[bytes], index: dict[bytes, int], cache: dict[bytes, tuple[int, ...]]) -> set[int]:
    out: set[int] = set()
    for w in words:
        hit = cache.get(w)
        if hit is None:
            hit = cache[w] = tuple({index[f] for f in features_of(w) if f in index})
        if hit:
            out.update(hit)
    return out


def _training_rows(shared: Broadcast, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each text its features, those it gains and loses in its copy with another term, and those it loses without any term."""
    index: dict[bytes, int] = {f: i for i, f in enumerate(shared.value)}
    cache: dict[bytes, tuple[int, ...]] = {}
    groups = {t.encode(): [x.encode() for x in g] for g in IDENTITY_TERMS.values() for t in g}
    terms = sorted(groups)
    for b in slices(batches):
        rows = []
        for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
            words = set(words_of(text))
            own = _indices(words, index, cache)
            at = hash(len(words) * 31 + len(text or "")) % (1 << 30)
            named = sorted(w for w in words if w in groups)
            if named:
                term = named[at % len(named)]
                other = [t for t in groups[term] if t != term]
                copy = words - {term} | {other[at % len(other)]}
            else:
                copy = words | {terms[at % len(terms)]}
            new, bare = _indices(copy, index, cache), _indices(words - groups.keys(), index, cache) if named else own
            rows.append((int(toxic), sorted(own), sorted(new - own), sorted(own - new), sorted(own - bare)))
        if len(cache) > CACHE:
            cache.clear()
        lists = pa.list_(pa.int16())
        cols = [pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], lists) for k in (1, 2, 3, 4))]
        yield pa.RecordBatch.from_arrays(cols, ["toxic", "own", "gained", "lost", "dropped"])


class Sparse:
    """Rows of feature numbers with signs, for products with a weight vector."""

    def __init__(self, rows: list[np.ndarray], signs: list[np.ndarray] | None = None):
        self.n = len(rows)
        self.column = np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64)
        self.row = np.repeat(np.arange(self.n), [len(r) for r in rows])
        self.sign = np.concatenate([np.zeros(0), *signs]) if signs is not None else np.ones(len(self.column))

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.column] * self.sign, self.n)

    def back(self, v: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.column, v[self.row] * self.sign, width)


def fit(y: np.ndarray, x: Sparse, change: Sparse, width: int, ridge: float = RIDGE, penalty: float = COUNTERFACTUAL, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on: weighted log loss + ridge |w|^2 + penalty mean((w . change)^2)."""
    w, bias = np.zeros(width), 0.0
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) / len(y)
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x.times(w) + bias, -30, 30)))
        error = (p - y) * weight
        gap = change.times(w)
        g = np.append(x.back(error, width) + 2 * ridge * w / width**0.5 + 2 * penalty * change.back(gap, width) / max(len(y), 1), error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, bias = w - step[:-1], bias - step[-1]
    return w, bias


class Model:
    """Features with their weights, and the bias."""

    def __init__(self, features: list[bytes], weights: np.ndarray, bias: float):
        self.features, self.weights, self.bias = features, weights, bias

    def scorer(self) -> Callable[[str | None], float]:
        index = {f: i for i, f in enumerate(self.features)}
        cache: dict[bytes, tuple[int, ...]] = {}

        def score(text: str | None) -> float:
            if len(cache) > CACHE:
                cache.clear()
            found = sorted(_indices(set(words_of(text)), index, cache))
            return float(1 / (1 + np.exp(-np.clip(self.weights[found].sum() + self.bias, -30, 30))))

        return score


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS, features: int = FEATURES, penalty: float = COUNTERFACTUAL) -> Model:
    """A model from the labelled texts; labels has doc_id and toxic.  penalty: the weight of score changes, 0 for a plain model."""
    texts = labelled(docs, labels, limit)
    sizes = {int(r.toxic > 0): r["count"] for r in texts.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).count().collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        share = (n1 + 1) / (n0 + n1 + 2)
        return Model([], np.zeros(0), float(np.log(share / (1 - share))))
    counts = texts.mapInArrow(_feature_counts, "feature binary, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    rate = lambda c, n: (F.col(c) + 0.5) / (n + 1.0)
    # the standardised difference of the two shares
    both = (F.col("n0") + F.col("n1") + 0.5) / (n0 + n1 + 1.0)
    strength = F.abs(rate("n1", n1) - rate("n0", n0)) / F.sqrt(both * (1 - F.least(both, F.lit(1 - 1e-9))) * (1 / n0 + 1 / n1))
    best = counts.where(F.col("n0") + F.col("n1") >= MIN_TEXTS).select("feature", strength.alias("z")).orderBy(F.desc("z"), "feature").limit(features).collect()  # at most features rows
    names = [bytes(r.feature) for r in best]
    names += sorted({f for g in IDENTITY_TERMS.values() for t in g for f in features_of(t.encode())} - set(names))
    shared = texts.sparkSession.sparkContext.broadcast(names)
    rows = texts.mapInArrow(partial(_training_rows, shared), "toxic int, own array<short>, gained array<short>, lost array<short>, dropped array<short>").toPandas()  # at most limit rows
    own, gained, lost, dropped = ([np.asarray(v, np.int64) for v in rows[c]] for c in ("own", "gained", "lost", "dropped"))
    swapped = [np.concatenate(p) for p in zip(gained, lost, strict=True)], [np.concatenate((np.ones(len(a)), -np.ones(len(b)))) for a, b in zip(gained, lost, strict=True)]
    without = [d for d in dropped if len(d)]
    change = Sparse(swapped[0] + without, swapped[1] + [-np.ones(len(d)) for d in without])
    weights, bias = fit((rows["toxic"].to_numpy() > 0).astype(float), Sparse(own), change, len(names), penalty=penalty)
    return Model(names, weights, bias)


_scorers: dict[int, Callable[[str | None], float]] = {}


def score(model: Model, text: Column) -> Column:
    """The score of a text, 0 to 1."""
    key = hash((tuple(model.features), model.weights.tobytes(), model.bias))

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        if key not in _scorers:
            _scorers.clear()
            _scorers[key] = model.scorer()
        return texts.map(_scorers[key]).astype("float64")

    return scored(text)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves no remainder by 5: such rows are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string")) % 5 == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; a null id is not held out."""
    model = train(docs, labels.where(~held_out(F.col("doc_id"))))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), score(model, F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the model does not call toxic, all columns."""
    model = train(docs, labels.where(~held_out(F.col("doc_id"))))
    name = own_name(docs, "toxicity")
    return docs.withColumn(name, score(model, F.col("text"))).where(F.col(name) < 0.5).select(*docs.columns)
