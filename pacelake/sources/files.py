"""Flat files, XML rows and the write-once store of raw documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def csv_text(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, every column a string, so that ids keep their leading zeros."""
    return spark.read.option("header", True).option("inferSchema", False).option("escape", '"').csv(path)


def xml_rows(documents: DataFrame, raw: str, item: str, fields: str) -> DataFrame:
    """Elements ``item`` of XML documents as rows of the given fields (a schema string)."""
    inner = F.regexp_extract_all(raw, F.lit(rf"(?s)(<{item}[ >].*?</{item}>)"), F.lit(1))
    rest = [c for c in documents.columns if c != raw]
    return documents.select(*rest, F.explode(inner).alias("x")).select(*rest, F.from_xml("x", fields).alias("x")).select(*rest, "x.*")


def binary_documents(spark: SparkSession, path: str) -> DataFrame:
    """path, digest and content of raw files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("digest"), "content")


def unseen(incoming: DataFrame, archived: DataFrame) -> DataFrame:
    """Documents whose digest is not in the archive yet, once each: the store is only ever added to."""
    return incoming.dropDuplicates(["digest"]).join(archived.select("digest").distinct(), "digest", "left_anti")


def conflicts(incoming: DataFrame, archived: DataFrame) -> DataFrame:
    """Documents that come under an archived path with another digest: they go beside it, never over it."""
    old = archived.select("path", F.col("digest").alias("archived_digest"))
    return incoming.join(old, "path").where("digest <> archived_digest")
