"""Token counts by a two-tier lookup on the map side.

The ``table_size`` most frequent pre-tokens of a sample make a compact table of token
counts (an Arrow column of strings of bounded length and a byte for each), which is broadcast: its
size is a parameter and does not grow with the corpus.  A worker looks the pre-tokens of a batch
up in that table's hash index, makes the rest distinct, looks these up in its own bounded cache, and
encodes what neither holds.  No pre-token of the corpus is shuffled.  The counts are the library's
whatever the table holds: the sample (``SAMPLE_DOCS`` documents by a hash of id and text) decides the speed alone.

Nulls and empty texts have no bytes and no tokens.  Rows are treated one by one:
repeated rows, null ids and extra columns change nothing, an empty table gives an
empty table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices
from .encode import Encoder, encoder

#: Entries of the broadcast table, and documents that it is counted from.
TABLE_SIZE, SAMPLE_DOCS = 65_536, 4_096
#: The counter is cut to its frequent half when it holds more.
COUNTED = 400_000
#: Longer pre-tokens are left to the workers.
LONGEST = 32
#: Bytes of text that a task counts at once, unless a single document has more.
TEXT_BYTES = 8 << 20


def _count(shared: Broadcast, table_size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    e = encoder(("counts", hash(shared.value)), lambda: Encoder(shared.value))
    seen: Counter[bytes] = Counter()
    for b in slices(batches, limit=TEXT_BYTES):
        counts = e.pieces(b.column("text"))[0].value_counts()
        short = counts.filter(pc.less_equal(pc.binary_length(counts.field("values")), LONGEST))
        seen.update(dict(zip(short.field("values").to_pylist(), short.field("counts").to_pylist(), strict=True)))
        if len(seen) > COUNTED:
            seen = Counter(dict(seen.most_common(COUNTED // 2)))
    top = sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:table_size]
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in top], pa.binary()), pa.array([n for _, n in top], pa.int64())], ["pre_token", "n"])


def frequent(docs: DataFrame, tokenizer_json: Broadcast, table_size: int = TABLE_SIZE, sample: int = SAMPLE_DOCS) -> DataFrame:
    """The most frequent pre-tokens of ``sample`` texts at most with their numbers (ties by bytes); one task counts them."""
    share = min(1.0, sample / max(docs.count(), 1))
    below = F.xxhash64(F.col("doc_id").cast("long"), F.col("text")).bitwiseAND(F.lit(0xFFFFFF)) <= int(share * 0xFFFFFF)
    return docs.where(below).select("text").limit(sample).coalesce(1).mapInArrow(partial(_count, tokenizer_json, table_size), "pre_token binary, n long")


def _apply(shared: Broadcast, table: Broadcast, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    e = encoder(("counts", hash(shared.value)), lambda: Encoder(shared.value))
    keys, lengths = table.value
    lengths = np.frombuffer(lengths, np.uint8)
    for b in slices(batches, limit=TEXT_BYTES):
        n_bytes = pc.cast(pc.binary_length(b.column("text").cast(pa.binary())).fill_null(0), pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), n_bytes, pa.array(e.count(b.column("text"), keys, lengths))], ["doc_id", "n_bytes", "n_tokens"])


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512, table_size: int = TABLE_SIZE) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens) of every text.

    Tokens are those that the tokenizers library makes by default without the special
    tokens it would add: a special token's string inside a text is one token.
    """
    spark: SparkSession = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    e = Encoder(shared.value)
    rows = frequent(docs, shared, table_size).collect()  # table_size rows at most
    known = [(bytes(r.pre_token), n) for r in rows if (n := len(e.ids(bytes(r.pre_token)))) < 256]
    table = spark.sparkContext.broadcast((pa.array([k for k, _ in known], pa.binary()), bytes(n for _, n in known)))
    counted = docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(partial(_apply, shared, table), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
