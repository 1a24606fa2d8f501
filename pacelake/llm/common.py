"""What the operators of this subpackage share: scratch tables, row batches, words.

Scratch tables are Parquet below the folder that ``spark.checkpoint.dir`` names,
which every executor reaches.  They cut lineage: a lost executor costs only the
tasks it held, never a chain of stages.  ``step`` runs one step of a longer job, keeps its result and removes
its other scratch tables; ``clear_scratch`` removes what one application wrote, once no DataFrame that reads it is used any more.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_folder

#: Separators of the plain word class: everything that is not 0-9, a letter or above 0x7F.
_WORD_TABLE = bytes(
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)
#: A-Z to a-z and nothing else.
LOWER_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "replace").translate(_WORD_TABLE).split() if text else []


#: The thread's property that names the folder, within the application's, of the step it runs.
_STEP = "pacelake.scratch.step"


def scratch_path(spark: SparkSession, name: str) -> str:
    step = spark.sparkContext.getLocalProperty(_STEP)
    return f"{shared_folder(spark)}/pacelake-{spark.sparkContext.applicationId}/{f'{step}/' if step else ''}{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The DataFrame written as a scratch table and read again."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, if it is there."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def step(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> tuple[DataFrame, str]:
    """What ``make`` returns, as a scratch table, and its path; all other scratch tables of the step are gone, even if it fails."""
    sc = spark.sparkContext
    outer, path, folder = sc.getLocalProperty(_STEP), scratch_path(spark, name), f"step-{uuid.uuid4().hex[:12]}"
    sc.setLocalProperty(_STEP, folder)
    try:
        df = make()
        df.write.option("compression", "zstd").parquet(path)
    finally:
        sc.setLocalProperty(_STEP, outer)
        remove(spark, f"{shared_folder(spark)}/pacelake-{sc.applicationId}/{folder}")
    return spark.read.schema(df.schema).parquet(path), path


def clear_scratch(spark: SparkSession) -> None:
    """Removes all scratch tables of this application."""
    remove(spark, f"{shared_folder(spark)}/pacelake-{spark.sparkContext.applicationId}")


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut into runs of rows of about ``limit`` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.binary_length(batch.column(text)).fill_null(0), dtype=np.int64)
        group = np.cumsum(sizes) // limit
        cuts = np.flatnonzero(np.diff(group)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield batch.slice(int(a), int(b - a))


def own_name(df: DataFrame, base: str) -> str:
    """A column name that the DataFrame does not have (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name = f"_{name}"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def documents_with_key(docs: DataFrame) -> DataFrame:
    """doc_id, doc (a hash of id and text that tells rows apart, but for repeated ones) and text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text")).alias("doc"), "text")
