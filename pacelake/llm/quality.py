"""Quality rules with cross-document line frequency, in DataFrame functions only.

Base rules look at one text: too few words, or too many words within repeated windows of
``WINDOW`` words.  The cross-document rule hashes the normalised lines (lower case, outer
blanks off) of every text, counts for each host (column source) in how many documents a
line stands, takes lines above either limit (more than ``MIN_DOCS`` documents; for small hosts more than
``MIN_SHARE`` of the host's, ``FEW_DOCS`` at least) as boilerplate, and rejects documents of which less than ``MIN_LEFT`` of the
characters are left without them.

Texts are split once, into a stored table with a row id, the base figures and (hash, length)
of each line.  Counting shuffles 64-bit hashes of host and of line, after partial counts; the
removal joins the same keys with the lines above the limits, so a line or a host with a
third of all rows is spread by its other half of the key or by the adaptive skew join.

Null texts have no words and lines.  A null source is a host of its own.  Every row counts
as a document of its own, repeated rows too; null ids come back null.  Extra columns are not
read; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

WINDOW, MIN_WORDS, MAX_REPEATED = 8, 20, 30
MIN_DOCS, FEW_DOCS, MIN_SHARE, MIN_LEFT = 50, 5, 0.1, 0.5
BLANK = r"[\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words within windows that are found twice or more in the array, the first included.

    Windows are hashed; only if some hash repeats are they sorted, and the starts of equal
    neighbours cover their words.
    """
    def starts(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(ordered, lambda s: F.filter(s, lambda x, j: F.get(s, j - 1)["h"].eqNullSafe(x["h"]) | F.get(s, j + 1)["h"].eqNullSafe(x["h"])))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def covered(at: Column) -> Column:
        zero = F.struct(F.lit(-window).alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(at, zero, lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(window), x - a["last"])).alias("n")), lambda a: a["n"])

    hashes = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - window), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)])))
    counted = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(starts(h))).otherwise(F.lit(0).cast("long")))
    return F.when(F.size(words) > window, counted).otherwise(F.lit(0).cast("long"))


def normalised(line: Column) -> Column:
    return F.lower(F.btrim(line, F.lit(" \t\r")))


def figures(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """A stored row for each document: row, doc_id, host, the base figures and its lines."""
    text = F.coalesce("text", F.lit(""))
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("source").cast("string")).alias("host"), text.alias("text"))
    split = split.withColumn("words", F.array_remove(F.split("text", BLANK), "")).withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    out = split.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "host", *["text"] * keep_text,
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.transform("lines", lambda x: F.struct(F.xxhash64(F.lit(0), normalised(x)).alias("hash"), F.char_length(x).alias("chars"))).alias("lines"),
    )
    return stored(out, "quality-figures")


def frequent_lines(rows: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """host, hash and docs of the lines that stand in more documents of their host than either limit allows."""
    seen = rows.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: x["hash"]))).alias("hash"))
    counts = seen.groupBy("host", "hash").agg(F.count("*").alias("docs")).where(F.col("docs") >= min(FEW_DOCS, min_docs + 1))
    hosts = rows.groupBy("host").agg(F.count("*").alias("host_docs"))
    return counts.join(hosts, "host").where((F.col("docs") > min_docs) | ((F.col("docs") >= FEW_DOCS) & (F.col("docs") > F.col("host_docs") * min_share))).select("host", "hash", "docs")


def rules(docs: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE, min_left: float = MIN_LEFT, with_text: bool = False) -> DataFrame:
    """doc_id, the base figures, base_failed, removed_chars and kept of every row; with_text: also text, without the removed lines."""
    rows = figures(docs, with_text)
    lines = rows.select("row", "host", F.explode("lines").alias("line")).select("row", "host", "line.hash", "line.chars")
    bad = [F.collect_set("hash").alias("bad")] if with_text else []
    gone = lines.join(frequent_lines(rows, min_docs, min_share).select("host", "hash"), ["host", "hash"]).groupBy("row").agg(F.sum("chars").alias("gone"), *bad)
    total = F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x["chars"])
    out = rows.join(gone, "row", "left").withColumn("removed_chars", F.coalesce("gone", F.lit(0).cast("long")))
    out = out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")))
    out = out.withColumn("kept", ~F.col("base_failed") & (total - F.col("removed_chars") >= min_left * total))
    if with_text:
        bad = F.coalesce("bad", F.array().cast("array<long>"))
        out = out.withColumn("text", F.array_join(F.filter(F.split("text", "\n"), lambda x: ~F.array_contains(bad, F.xxhash64(F.lit(0), normalised(x)))), "\n"))
    return out.select("doc_id", *["text"] * with_text, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_chars", "kept")
