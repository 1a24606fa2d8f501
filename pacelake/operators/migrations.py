"""Forward-only schema migrations of a folder of tables.

A migration writes the tables it changes to folders of their own and then appends one row, with the place of every table after it, to the log.
That row is the commit: a migration that fails, or whose driver is lost, leaves the tables of the row before, and the next call makes it again.
One caller at a time; two that migrate one folder at once would both append the row.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "step long, version int, name string, at double, tables map<string, string>"


@dataclass(frozen=True)
class Migration:
    """apply gets all tables by name and returns those that are new or changed; None drops a table."""

    version: int
    name: str
    apply: Callable[[dict[str, DataFrame]], dict[str, DataFrame | None]]


def log(spark: SparkSession, folder: str) -> DataFrame:
    """Applied migrations; none, where nothing was applied."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/schema_migrations")
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(LOG).parquet(f"{folder}/schema_migrations") if there else spark.createDataFrame([], LOG)


def tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables as the last applied migration left them."""
    last = log(spark, folder).orderBy(F.desc("step")).first()  # one row
    return {name: spark.read.parquet(path) for name, path in last.tables.items()} if last else {}


def migrate(spark: SparkSession, folder: str, migrations: Sequence[Migration]) -> list[str]:
    """Applies what isn't applied yet, in order of version; the names of what this call applied.

    An applied version is never run again, whatever became of its code; one whose name differs from the log's, or two of one version, are an error.  What a migration raises leaves here,
    and the ones before it stay applied.
    """
    if len({m.version for m in migrations}) < len(migrations):
        raise ValueError("two migrations have one version")
    rows = log(spark, folder).collect()  # a row for each migration
    done = {r.version: r.name for r in rows}
    step = max((r.step for r in rows), default=0)
    places = dict(max(rows, key=lambda r: r.step).tables) if rows else {}
    applied = []
    for m in sorted(migrations, key=lambda m: m.version):
        if m.version in done:
            if done[m.version] != m.name:
                raise ValueError(f"version {m.version} was applied as {done[m.version]}, not {m.name}")
            continue
        now = dict(places)
        for name, table in m.apply({n: spark.read.parquet(p) for n, p in places.items()}).items():
            now.pop(name, None)
            if table is not None:
                now[name] = f"{folder}/tables/{name}-{m.version:03d}-{uuid.uuid4().hex[:12]}"
                table.write.option("compression", "zstd").parquet(now[name])
        step, places = step + 1, now
        spark.createDataFrame([(step, m.version, m.name, time.time(), places)], LOG).coalesce(1).write.mode("append").parquet(f"{folder}/schema_migrations")
        applied.append(m.name)
    return applied
