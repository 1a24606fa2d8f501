"""Quality classifier: a sparse ensemble of rules over statistics of a text.

Statistics of a whole text are column expressions (sizes, shares of symbols, capitals,
digits, repeated words and lines).  A random forest of shallow trees is grown on the
statistics of labelled texts; every path from a root to a node is a rule, a conjunction of
bounds on statistics.  A logistic model with an L1 penalty gives the rules weights, most of
them zero, and the rest is compiled into one Spark column: scoring is a projection of the
scan, without Python and without a shuffle.

Trees and weights are fitted on ``TRAIN_DOCS`` labelled texts at most, taken by a hash of
doc_id, one text for each id: a stated bound, the same at every corpus size.

A label is 1 if any row of its doc_id says so; null ids and labels are no labels.  Of several
rows with a labelled id the text with the least hash is learned from.  Null texts count as
empty, and an empty text has all statistics zero.  Rows are scored one by one, so repeated
rows and extra columns change nothing; empty tables give empty tables; without labels of both
kinds, or where no tree finds a split, the score is the smoothed share of label 1.
"""

from __future__ import annotations

import math
import re

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Labelled texts to learn from; trees, their depth, least texts of a node, and the L1 penalty.
TRAIN_DOCS, TREES, DEPTH, MIN_NODE, PENALTY = 12_000, 20, 3, 5, 0.0002

BLANK = r"[\x20\x09-\x0D]+"


NAMES = (
    "chars", "words", "word_length", "variety", "echoed_words", "short_words", "long_words", "symbols", "calls", "stops", "capitals", "letters", "digits",
    "lines", "line_words", "repeated_lines", "ended_lines",
)


def _statistics() -> dict[str, Column]:
    """Statistics by name, of the columns text, words and lines."""
    share = lambda part, whole: part.cast("double") / F.greatest(whole, F.lit(1)).cast("double")
    chars, n = F.char_length("text"), F.size("words")
    count = lambda others: F.char_length(F.regexp_replace("text", others, ""))  # noqa: E731  characters without the runs of others
    return {
        "chars": chars.cast("double"),
        "words": n.cast("double"),
        "word_length": share(F.char_length(F.array_join("words", "")), n),
        "variety": F.log1p(F.size(F.array_distinct("words")).cast("double")) / F.greatest(F.log1p(n.cast("double")), F.lit(0.1)),  # differs little by length
        "echoed_words": share(F.size(F.filter("words", lambda w, i: w == F.get("words", i - 1))), n),
        "short_words": share(F.size(F.filter("words", lambda w: F.char_length(w) <= 3)), n),
        "long_words": share(F.size(F.filter("words", lambda w: F.char_length(w) > 14)), n),
        "symbols": share(count(r"[^#*$%&|<>@^~_=+{}\[\]\\]+"), chars),
        "calls": share(count("[^!?]+"), chars),
        "stops": share(count("[^.,;:]+"), chars),
        "capitals": share(count(r"\P{Lu}+"), chars),
        "letters": share(count(r"\P{L}+"), chars),
        "digits": share(count("[^0-9]+"), chars),
        "lines": F.size("lines").cast("double"),
        "line_words": share(n, F.size("lines")),
        "repeated_lines": share(F.size("lines") - F.size(F.array_distinct("lines")), F.size("lines")),
        "ended_lines": share(F.size(F.filter("lines", lambda x: x.rlike(r"[.!?][\x20\x09-\x0D]*$"))), F.size("lines")),
    }


def statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` of every row, and its statistics, named ``stat_...``; any column called text is read as text."""
    text = docs.select(*keep, F.coalesce("text", F.lit("")).alias("text"))
    split = text.withColumn("words", F.array_remove(F.split("text", BLANK), "")).withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    return split.select(*keep, *(c.alias(f"stat_{name}") for name, c in zip(NAMES, _statistics().values(), strict=True)))


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS) -> DataFrame:
    """label and statistics of ``limit`` labelled documents at most, stored; labels has doc_id and quality."""
    marks = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") > 0).cast("double").alias("label"))
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)  # at most limit rows
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    one = texts.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("label").alias("label"))
    return stored(statistics(one, "doc_id", "label").repartition(4, "doc_id").sortWithinPartitions("doc_id"), "quality-training")


Rule = tuple[tuple[int, float, float], ...]  # bounds (statistic, above, up to), by statistic


def rules_of(tree: str) -> set[Rule]:
    """The rules of a tree, from its printed form: one for each node but the root."""
    found: set[Rule] = set()
    path: list[tuple[int, float, float]] = []
    for line in tree.splitlines():
        m = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if not m:
            continue
        del path[len(m[1]) - 2 :]  # a node's children stand one blank further in; the root's stand after two
        at, bound = int(m[2]), float(m[4])
        path.append((at, -math.inf, bound) if m[3] == "<=" else (at, bound, math.inf))
        tight: dict[int, tuple[float, float]] = {}
        for k, low, high in path:
            a, b = tight.get(k, (-math.inf, math.inf))
            tight[k] = max(a, low), min(b, high)
        found.add(tuple((k, *tight[k]) for k in sorted(tight)))
    return found


def condition(rule: Rule) -> Column:
    """The rule as a boolean column over statistics."""
    parts = [F.col(f"stat_{NAMES[k]}") > low for k, low, _ in rule if low > -math.inf] + [F.col(f"stat_{NAMES[k]}") <= high for k, _, high in rule if high < math.inf]
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


class Ensemble:
    """Rules with their weights, and the bias."""

    def __init__(self, weights: dict[Rule, float], bias: float):
        self.weights, self.bias = weights, bias

    def score(self) -> Column:
        """The score, 0 to 1, over the columns of ``statistics``."""
        margin = F.lit(self.bias)
        for rule, weight in self.weights.items():
            margin = margin + F.when(condition(rule), weight).otherwise(0.0)
        return 1 / (1 + F.exp(-margin))

    def described(self) -> list[str]:
        """Each rule in words with its weight, the heaviest first."""
        def words(rule: Rule) -> str:
            return " and ".join(f"{f'{low:g} < ' if low > -math.inf else ''}{NAMES[k]}{f' <= {high:g}' if high < math.inf else ''}" for k, low, high in rule)

        return [f"{w:+.3f} if {words(r)}" for r, w in sorted(self.weights.items(), key=lambda x: (-abs(x[1]), x[0]))]


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY) -> Ensemble:
    """The ensemble from the labelled texts; labels has doc_id and quality."""
    rows = training_rows(docs, labels, limit)
    n = {int(r.label): r["count"] for r in rows.groupBy("label").count().collect()}
    share = (n.get(1, 0) + 1) / (n.get(0, 0) + n.get(1, 0) + 2)
    constant = Ensemble({}, math.log(share / (1 - share)))
    if len(n) < 2:
        return constant
    points = rows.select("label", array_to_vector(F.array(*(f"stat_{x}" for x in NAMES))).alias("features"))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, minInstancesPerNode=MIN_NODE, featureSubsetStrategy="onethird", seed=11).fit(points)
    rules = sorted(set().union(*(rules_of(t.toDebugString) for t in forest.trees)))
    if not rules:
        return constant
    fired = rows.select("label", array_to_vector(F.array(*(condition(r).cast("double") for r in rules))).alias("features"))
    model = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=100, standardization=False).fit(stored(fired, "quality-rules"))
    return Ensemble({r: float(w) for r, w in zip(rules, model.coefficients, strict=True) if w}, float(model.intercept))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves remainder 1 by 3: such rows are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string")) % 3 == 1, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; a null id is not held out."""
    model = train(docs, labels.where(~held_out(F.col("doc_id"))))
    out = statistics(docs, "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), model.score().alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
