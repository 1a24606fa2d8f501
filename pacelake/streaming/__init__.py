"""Structured Streaming twins of the batch semantics; ``availableNow`` drains what is there and stops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import new_path


def event_stream(spark: SparkSession, folder: str, table: str = "events") -> DataFrame:
    """A table of a folder as a stream of its files."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    path = f"{folder}/{table}.parque[t]"  # a pattern: the table may be a file or a folder of files
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(path)
    return stream.withColumns({c: F.col(c).cast("timestamp") for c, t in stream.dtypes if t == "timestamp_ntz"})


def drain(result: DataFrame, mode: str, name: str, folder: str | None = None) -> DataFrame:
    """Runs a streaming query over all that is there and returns its result table.

    complete: the last batch is the result.  append: batches add up.  Results and checkpoints lie
    in the shared folder, batches are keyed by their number, so a batch that is run again
    replaces itself.  A stream without files gives an empty table.  With a ``folder`` of the caller's, a later run resumes after the last batch that was
    committed there: it reads new files alone and goes on from the state; without new files the result stays.
    """
    spark = result.sparkSession
    root = folder or new_path(spark, f"stream-{name}")
    out, checkpoint = f"{root}/result", f"{root}/checkpoint"
    jvm = spark.sparkContext._jvm
    path = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join([out, *parts]))
    fs = path().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path())

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        if mode == "complete":  # the last result stays until the new one is whole
            fs.delete(path(f"batch={number - 1}"), True)

    query = result.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(result.schema).parquet(out).select(*result.columns)


def tumbling(stream: DataFrame, time: str, width: str, late: str, *keys: str) -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sliding(stream: DataFrame, time: str, width: str, slide: str, late: str) -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.window(time, width, slide)).agg(F.count("*").alias("n"))


def gap_sessions(stream: DataFrame, time: str, gap: str, late: str, key: str) -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"))


def deduplicated(stream: DataFrame, time: str, late: str, *keys: str) -> DataFrame:
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def distinct(stream: DataFrame, *keys: str) -> DataFrame:
    """First rows of keys, however late they come; the state holds every key, which suits a table that is drained."""
    return stream.dropDuplicates(list(keys))


def current_state(stream: DataFrame, key: str, time: str, tie: str, *values: str) -> DataFrame:
    """The newest row of each key so far (state of one row for each key)."""
    return stream.groupBy(key).agg(F.max_by(F.struct(tie, *values), F.struct(time, tie)).alias("s")).select(key, "s.*")


def outcomes(predictions: DataFrame, seen: DataFrame, key: str, made: str, time: str, within: str, late: str) -> DataFrame:
    """Pairs of a prediction and an outcome of its key that comes later, up to ``within`` after it: an inner join of two streams.

    Both sides wait in the state for each other, whichever comes first, and are dropped once the watermark (``late`` behind the newest row of
    either stream) says that no partner can come.  Rows later than that are lost, so ``late`` has to cover the disorder of the input.
    """
    p, o = predictions.withWatermark(made, late), seen.withWatermark(time, late).withColumnRenamed(key, "__key")
    return p.join(o, (F.col(key) == F.col("__key")) & (F.col(time) > F.col(made)) & (F.col(time) <= F.col(made) + F.expr(f"INTERVAL {within}"))).drop("__key")
