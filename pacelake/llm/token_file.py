"""Token ids in files of blocks: frequency-ranked ids in byte-aligned variable-length
coding with separate control bytes.

Ids are replaced by their rank in the corpus, so that frequent ids take one byte.  A
control byte holds the lengths (1 to 4, less one) of four values; the data bytes follow
in a stream of their own.  ``unpack`` decodes a block with one table lookup for each
control byte and a gather for each byte position.

A file is a Parquet table with a row for each block: shard (ascending in doc_id), block,
first (ids before it in its shard), doc_ids, counts, control, data.  Parquet carries the
bytes so that Spark's commit protocol covers lost tasks and any store can hold them.  The
rank table, of the vocabulary's size, lies beside the blocks.

Every text gets the end id.  Nulls and empty texts have that id alone.  Rows with one doc_id, or
with none, stand in the order of a hash of their ids, so that a doc_id with many rows is dealt over
shards; null doc_ids come first and come back null.  Extra columns
are not read; an empty table gives empty files.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, stored
from .encode import Encoder, binary_rows, encoder

#: Ids of a block, unless a single document has more.
BLOCK_IDS = 1 << 18
#: Bytes of text that a task encodes at once, unless a single document has more.
TEXT_BYTES = 8 << 20
#: Lengths of the four values of each control byte.
LENGTHS = np.array([[(c >> (2 * k) & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)
BLOCKS = "shard int, block int, first long, n_ids long, doc_ids binary, known binary, counts binary, control binary, data binary"


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values."""
    v = np.ascontiguousarray(values, "<u4")
    size = 1 + (v >= 1 << 8).astype(np.uint8) + (v >= 1 << 16) + (v >= 1 << 24)
    keep = np.arange(4, dtype=np.uint8) < size[:, None]
    codes = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    codes[: len(v)] = size - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    return control.astype(np.uint8).tobytes(), v.view(np.uint8).reshape(-1, 4)[keep].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` values of control and data bytes."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)
    at = np.cumsum(size) - size
    out = np.zeros(n, np.uint32)
    for k in range(int(size.max(initial=0))):
        has = size > k
        out[has] |= raw[at[has] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _stage(shared: Broadcast, lower: bool, end_id: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    e = encoder(("token_file", hash(shared.value)), lambda: Encoder(shared.value, "<u2", lower=lower))
    for b in slices(batches, limit=TEXT_BYTES):
        ids, ends = e.encode(b.column("text"))
        ids = np.insert(ids, ends, end_id)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), binary_rows(ids, ends + np.arange(1, len(ends) + 1))], ["doc_id", "ids"])


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << 16, np.int64)
    for b in batches:
        for part in slices([b], "ids"):
            counts += np.bincount(np.frombuffer(b"".join(part.column("ids").to_pylist()), "<u2"), minlength=1 << 16)
    ids = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(counts[ids], pa.int64())], ["id", "n"])


def _write(ranks: Broadcast, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rank_of = np.zeros(1 << 16, np.uint32)
    rank_of[ranks.value] = np.arange(len(ranks.value), dtype=np.uint32)
    shard, block, first = TaskContext.get().partitionId(), 0, 0
    for b in batches:
        for part in slices([b], "ids", 2 * BLOCK_IDS):
            ids = part.column("ids").to_pylist()
            counts = np.array([len(x) // 2 for x in ids], np.int64)
            known = np.asarray(part.column("doc_id").is_valid())
            doc_ids = np.asarray(part.column("doc_id").fill_null(0), np.int64)
            control, data = pack(rank_of[np.frombuffer(b"".join(ids), "<u2")])
            row = [shard, block, first, int(counts.sum()), doc_ids.astype("<i8").tobytes(), np.packbits(known).tobytes(), counts.astype("<i8").tobytes(), control, data]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], [c.split()[0] for c in BLOCKS.split(", ")])
            block, first = block + 1, first + row[3]


def _read(ranks: Broadcast, bases: Broadcast, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    by_rank = np.array(ranks.value, "<u4")
    for b in batches:
        for r in b.to_pylist():
            counts, doc_ids = np.frombuffer(r["counts"], "<i8"), np.frombuffer(r["doc_ids"], "<i8")
            known = np.unpackbits(np.frombuffer(r["known"], np.uint8), count=len(counts)).astype(bool)
            ids = by_rank[unpack(r["control"], r["data"], r["n_ids"])]
            ends = np.cumsum(counts)
            starts = ends - counts
            crc = [zlib.crc32(ids[a:z].data) for a, z in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_ids, pa.int64(), mask=~known), pa.array(starts + (bases.value[r["shard"]] + r["first"])), pa.array(counts), pa.array(crc, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )


class TokenFiles:
    """Written files: ``blocks`` and the ids by rank."""

    def __init__(self, blocks: DataFrame, ranks: list[int]):
        self.blocks, self.ranks = blocks, ranks

    def documents(self) -> DataFrame:
        """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of each document, from the blocks."""
        sc = self.blocks.sparkSession.sparkContext
        base, bases = 0, {}
        for r in self.blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect():  # a row for each shard file
            bases[r.shard] = base
            base += r.n
        return self.blocks.mapInArrow(partial(_read, sc.broadcast(self.ranks), sc.broadcast(bases)), "doc_id long, start long, n_tokens long, ids_crc32 long")


def write(docs: DataFrame, tokenizer_path: str, end_id: int = 1, lower: bool = True) -> TokenFiles:
    """Encodes every text, appends ``end_id`` and writes the ids in ascending doc_id order.

    lower: whether the vocabulary drops blanks and lower-cases.  Ids have to be below 65,536.
    The histogram and rank table are of the vocabulary's size.
    """
    spark: SparkSession = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    rows = docs.selectExpr("cast(doc_id as long) as doc_id", "text")
    staged = stored(rows.mapInArrow(partial(_stage, shared, lower, end_id), "doc_id long, ids binary"), "token-ids")
    tally = staged.select("ids").mapInArrow(_histogram, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    ranks = [r.id for r in tally.orderBy(F.desc("n"), "id").collect()]  # a row for each id in use
    order = F.col("doc_id").asc_nulls_first(), F.xxhash64("ids")
    shards = staged.repartitionByRange(*order).sortWithinPartitions(*order, "ids")
    return TokenFiles(stored(shards.mapInArrow(partial(_write, spark.sparkContext.broadcast(ranks)), BLOCKS), "token-files"), ranks)
