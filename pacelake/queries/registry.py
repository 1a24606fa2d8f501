"""The registry of queries and the tables they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table behind one part, and how few of them are still worth a part where cores are idle.
PART_ROWS, SMALL_ROWS = 100_000, 20_000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers fn(t) -> DataFrame, where t(name) reads a table, under a name, with its SQL."""

    def add(fn: Callable[[Tables], DataFrame]) -> Callable:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return add


class Tables:
    """Tables of a folder by name, and what several queries derive from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._parts = spark, folder, {}

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def parts(self, name: str) -> int:
        """Into how many parts rows that follow a table's are dealt, so that a task's share stays the same however large the table; the rows are counted from the file's metadata."""
        if name not in self._parts:
            n = self(name).count()
            self._parts[name] = max(1, -(-n // PART_ROWS), min(self.spark.sparkContext.defaultParallelism, n // SMALL_ROWS))
        return self._parts[name]

    def games(self) -> DataFrame:
        """A row for each order: the player-game facts (player = customer, season = year)."""
        lines = self("lineitem").groupBy(F.col("l_orderkey").alias("game_id")).agg(
            F.sum("l_quantity").alias("units"), F.count("*").alias("n_lines"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count_if(F.col("l_linestatus") == "O").alias("pending"),
        )
        orders = self("orders").select(F.col("o_orderkey").alias("game_id"), F.col("o_custkey").alias("player_id"), F.col("o_orderdate").alias("game_time"), F.year("o_orderdate").alias("season"), F.substring("o_orderpriority", 1, 1).alias("priority"), F.col("o_totalprice").alias("price"))
        return orders.join(lines, "game_id")

    def sides(self) -> DataFrame:
        """Two rows for each order with two lines and more: odd and even lines as the two sides of a game."""
        side = F.when(F.col("l_linenumber") % 2 == 1, "HOME").otherwise("AWAY")
        return self("lineitem").groupBy(F.col("l_orderkey").alias("game_id"), side.alias("side")).agg(
            F.sum("l_quantity").alias("fga"), F.count_if(F.col("l_returnflag") == "R").alias("oreb"), F.count_if(F.col("l_linestatus") == "O").alias("tov"), F.count("*").alias("fta"), F.sum(F.floor(F.col("l_quantity") * (1 - F.col("l_discount")))).cast("double").alias("points"),
        )

    def log(self) -> DataFrame:
        """Events as an append-only log with their number k of props."""
        return self("events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))


GAMES = """games AS (SELECT o_orderkey AS game_id, o_custkey AS player_id, o_orderdate AS game_time, CAST(year(o_orderdate) AS INTEGER) AS season,
    substr(o_orderpriority, 1, 1) AS priority, o_totalprice AS price, units, n_lines, returned, pending
    FROM orders JOIN (SELECT l_orderkey, sum(l_quantity) AS units, count(*) AS n_lines, count(*) FILTER (WHERE l_returnflag = 'R') AS returned,
        count(*) FILTER (WHERE l_linestatus = 'O') AS pending FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey)"""

SIDES = """sides AS (SELECT l_orderkey AS game_id, CASE WHEN l_linenumber % 2 = 1 THEN 'HOME' ELSE 'AWAY' END AS side, sum(l_quantity) AS fga,
    count(*) FILTER (WHERE l_returnflag = 'R') AS oreb, count(*) FILTER (WHERE l_linestatus = 'O') AS tov, count(*) AS fta,
    CAST(sum(floor(l_quantity * (1 - l_discount))) AS DOUBLE) AS points FROM lineitem GROUP BY ALL)"""

LOG = """log AS (SELECT *, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"""


def r4(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 4)
