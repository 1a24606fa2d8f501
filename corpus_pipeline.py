"""The corpus pipeline: five stages over documents, each a Parquet table that the next one reads.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.  All but
the last return the columns of documents; the last returns the encoded documents.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pacelake.llm import byte_bpe, decontaminate, line_dedup, simhash, toxicity
from pacelake.llm.common import documents, documents_with_key, own_name, remove, step


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go; it learns from the labels of documents that are here.

    Every row is scored by itself: repeated rows go or stay together; null and empty texts score as texts without
    features; texts are read whole; extra columns stay; an empty table gives an empty table.
    """
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-equal lines one stays; every document keeps its row.

    Null and empty texts have no lines and stay as they are; of repeated rows one keeps the lines; null ids come first; a very long
    text is one row of work; extra columns stay; an empty table gives an empty table.
    """
    return line_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays, that of the smallest doc_id.

    Null ids come last, and of repeated rows one stays; null and empty texts share the fingerprint zero, so one of them stays;
    texts are read whole; extra columns stay; an empty table gives an empty table.
    """
    return simhash.first_of_groups(docs)


def reject_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go.

    Repeated rows go or stay together, rows with a null id by their text; null and empty texts have no words and stay; a long text is a
    segment of its own; extra columns stay; an empty table gives an empty table.
    """
    keyed = documents_with_key(docs).select(F.col("doc").alias("doc_id"), "text")
    found = decontaminate.report(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    key = own_name(docs, "row_key")
    hit = found.where("contaminated").select(F.col("doc_id").alias(key)).distinct()
    return docs.withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))).join(hit, key, "left_anti").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of what is left, with digests of ids and decoded bytes.

    A row for each row, repeated ones too; null texts count as empty; texts are read whole; a null id comes back null;
    other columns are not read; an empty table gives an empty table.
    """
    import public_tokenizers

    shared = byte_bpe.vocabulary(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return byte_bpe.round_trip(docs, shared)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash", drop_near_copies),
    ("decontamination", reject_contaminated),
    ("byte_bpe", encode),
]

#: MinHash, the classifier and XXH64 are beyond SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stored before the next; a stage's scratch and its predecessor's table go once its own stands."""
    docs, last = documents(spark, sf_dir), None
    for name, stage in STAGES:
        docs, path = step(spark, partial(stage, spark, docs, sf_dir), f"stage-{name}")
        if last:
            remove(spark, last)
        last = path
    return docs
