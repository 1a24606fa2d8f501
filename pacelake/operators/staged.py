"""Stages with partial failure: a status table, the last valid state, and reruns that start at what failed.

Every stage writes its result to a folder of its own and then appends a row to the status table; both are
Spark writes, so a lost executor costs its tasks, and a lost driver leaves a stage without a row, which the next call of
the run makes again.  Nothing is overwritten: a run becomes the last valid state by its closing row alone, and a
run that fails leaves the state before it as it was.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATUS = "run_id string, stage string, status string, path string, error string, at double"
#: The closing row of a run.
RUN = "*"


@dataclass(frozen=True)
class Stage:
    """make gets the results of earlier stages by name; an optional stage may fail without failing the run, and stages that need it are skipped."""

    name: str
    make: Callable[[dict[str, DataFrame]], DataFrame]
    needs: Sequence[str] = ()
    optional: bool = False


def status(spark: SparkSession, folder: str) -> DataFrame:
    """All status rows; none, if nothing was run."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/status")
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(STATUS).parquet(f"{folder}/status") if there else spark.createDataFrame([], STATUS)


def latest(spark: SparkSession, folder: str, run_id: str) -> DataFrame:
    """The last row of each stage of a run."""
    return status(spark, folder).where(F.col("run_id") == run_id).groupBy("stage").agg(F.max_by(F.struct("status", "path", "error"), "at").alias("x")).select("stage", "x.*")


def _say(spark: SparkSession, folder: str, *row: str | None) -> None:
    spark.createDataFrame([(*row, time.time())], STATUS).coalesce(1).write.mode("append").parquet(f"{folder}/status")


def run(spark: SparkSession, folder: str, run_id: str, stages: Sequence[Stage]) -> str:
    """Runs what of the run has not succeeded yet; SUCCEEDED, PARTIAL (only optional stages or those that need them are missing) or FAILED.

    A stage whose needs are missing is SKIPPED.  An exception of a stage is its error, the first line, and never leaves here.
    """
    done = {r.stage: r.path for r in latest(spark, folder, run_id).where("status = 'SUCCEEDED'").collect() if r.stage != RUN}  # a row for each stage
    results = {s.name: spark.read.parquet(done[s.name]) for s in stages if s.name in done}
    soft = {s.name for s in stages if s.optional}
    missing, lost = set(), False
    for s in stages:
        if s.name in done:
            continue
        gone = [n for n in s.needs if n in missing]
        if gone:
            outcome = ("SKIPPED", None, f"needs {', '.join(gone)}")
        else:
            path = f"{folder}/results/{run_id}/{s.name}-{uuid.uuid4().hex[:12]}"
            try:
                s.make(results).write.option("compression", "zstd").parquet(path)
                results[s.name] = spark.read.parquet(path)
                outcome = ("SUCCEEDED", path, None)
            except Exception as e:  # noqa: BLE001  whatever a stage raises is its status
                outcome = ("FAILED", None, f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"[:500])
        if outcome[0] != "SUCCEEDED":
            missing.add(s.name)
            if any(n in soft for n in gone):
                soft.add(s.name)
            lost |= s.name not in soft
        _say(spark, folder, run_id, s.name, *outcome)
    verdict = "FAILED" if lost else "PARTIAL" if missing else "SUCCEEDED"
    _say(spark, folder, run_id, RUN, verdict, None, None)
    return verdict


def last_valid(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The results of the last run that didn't fail, by stage; empty, if there is none."""
    row = status(spark, folder).where((F.col("stage") == RUN) & F.col("status").isin("SUCCEEDED", "PARTIAL")).orderBy(F.desc("at")).first()
    if row is None:
        return {}
    return {r.stage: spark.read.parquet(r.path) for r in latest(spark, folder, row.run_id).where("status = 'SUCCEEDED' and path is not null").collect()}  # a row for each stage
