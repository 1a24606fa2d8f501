"""Byte-level BPE encoding and decoding over Arrow batches.

Texts are encoded by the tokenizers library (see ``encode``); ids are kept as
little-endian unsigned 32-bit integers.  As the tokens of byte-level BPE are the
bytes of the text in order, offsets are sums of token lengths: ``char_spans`` maps
bytes to characters, and a token that ends inside a character counts as split.
Decoding reverses the byte table; ``text_of`` holds back the bytes of a split
character until the next tokens complete it.

Nulls and empty texts give no tokens.  Rows are treated one by one: repeated rows,
null ids and extra columns change nothing, an empty table gives an empty table.
"""

from __future__ import annotations

import codecs
import hashlib
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from .common import slices
from .encode import Encoder, binary_rows, byte_table, encoder, texts_of, tokenizer_from_ranks

#: Bytes of text that a task encodes at once, unless a single document has more.
TEXT_BYTES = 8 << 20
SCHEMA = "doc_id long, n_tokens long, ids binary"
SPANS = "doc_id long, ids array<int>, starts array<int>, ends array<int>, split array<boolean>"
ROUND = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_split long, exact boolean"


def vocabulary(spark: SparkSession, ranks_path: str, pattern: str) -> Broadcast:
    """The tokenizer of a rank file as JSON for all workers; its size is the vocabulary's, whatever the corpus."""
    return spark.sparkContext.broadcast(tokenizer_from_ranks(ranks_path, pattern))


def token_bytes(tok: Tokenizer) -> list[bytes]:
    """Bytes of each id, by the reversed byte table."""
    back = {c: b for b, c in byte_table().items()}
    vocab = tok.get_vocab(with_added_tokens=False)
    out = [b""] * (max(vocab.values(), default=-1) + 1)
    for token, i in vocab.items():
        out[i] = bytes(back[c] for c in token)
    return out


def char_spans(raw: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Character start and end of each token, and whether it begins or ends inside a character.

    A split character belongs to every token that holds some of its bytes.
    """
    ends = np.cumsum(lengths)
    starts = ends - lengths
    lead = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
    before = np.concatenate(([0], np.cumsum(lead)))  # characters that begin before each byte
    whole = np.concatenate((lead, [True]))
    first = before[starts] - ~whole[starts]
    return first, before[ends], ~whole[starts] | ~whole[ends]


def text_of(pieces: Iterable[bytes]) -> Iterator[str]:
    """Text of a stream of token bytes: a piece that ends within a character is held until it is complete."""
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    for p in pieces:
        yield decoder.decode(p)
    yield decoder.decode(b"", True)


def _tools(shared: Broadcast) -> tuple[Encoder, list[bytes], np.ndarray]:
    def make() -> Encoder:
        e = Encoder(shared.value, ordinary=True)
        e.table = token_bytes(e.tok)
        e.lengths = np.array([len(t) for t in e.table], np.int64)
        return e

    e = encoder(("byte_bpe", hash(shared.value)), make)
    return e, e.table, e.lengths


def _encoded(batches: Iterator[pa.RecordBatch], e: Encoder) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for b in slices(batches, limit=TEXT_BYTES):
        yield b, *e.encode(b.column("text"))


def _rows_of(values: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    return [values[a:z] for a, z in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def _encode(shared: Broadcast, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    e, _, _ = _tools(shared)
    for b, ids, ends in _encoded(batches, e):
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(ends, prepend=0), pa.int64()), binary_rows(ids, ends)], ["doc_id", "n_tokens", "ids"])


def _spans(shared: Broadcast, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    e, _, lengths = _tools(shared)
    for b, ids, ends in _encoded(batches, e):
        rows = _rows_of(ids, ends)
        spans = [char_spans((t or "").encode(), lengths[x]) for t, x in zip(b.column("text").to_pylist(), rows, strict=True)]
        cols = [pa.array([x.astype(np.int32) for x in rows], pa.list_(pa.int32()))]
        cols += [pa.array([s[k].astype(np.int32) for s in spans], pa.list_(pa.int32())) for k in (0, 1)]
        cols.append(pa.array([s[2] for s in spans], pa.list_(pa.bool_())))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], ["doc_id", "ids", "starts", "ends", "split"])


def _decode(shared: Broadcast, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    _, table, _ = _tools(shared)
    for b in batches:
        rows = [np.frombuffer(x or b"", "<u4").tolist() for x in b.column("ids").to_pylist()]
        texts = ["".join(text_of(map(table.__getitem__, x))) for x in rows]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])


def _round(shared: Broadcast, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    e, table, lengths = _tools(shared)
    for b, ids, ends in _encoded(batches, e):
        data, offsets = texts_of(b.column("text"))
        inside = np.append((data & 0xC0) == 0x80, False)  # places within a character
        cols: list[list] = [[], [], [], [], []]
        for row, raw, first in zip(_rows_of(ids, ends), np.split(data, offsets[1:-1]), offsets.tolist(), strict=False):
            decoded = b"".join(map(table.__getitem__, row.tolist()))
            at = np.cumsum(lengths[row])[:-1]
            n_split = int(inside[first + at[at < len(raw)]].sum())
            for c, v in zip(cols, (len(row), hashlib.sha256(row).hexdigest(), hashlib.sha256(decoded).hexdigest(), n_split, decoded == raw.tobytes()), strict=True):
                c.append(v)
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_split", "exact"])


def _rows(docs: DataFrame) -> DataFrame:
    return docs.selectExpr("cast(doc_id as long) as doc_id", "text")


def encode(docs: DataFrame, shared: Broadcast) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) of every text."""
    return _rows(docs).mapInArrow(partial(_encode, shared), SCHEMA)


def spans(docs: DataFrame, shared: Broadcast) -> DataFrame:
    """Ids with the characters that each covers, and whether it splits one."""
    return _rows(docs).mapInArrow(partial(_spans, shared), SPANS)


def decode(encoded: DataFrame, shared: Broadcast) -> DataFrame:
    """doc_id and text of what ``encode`` returned."""
    return encoded.select("doc_id", "ids").mapInArrow(partial(_decode, shared), "doc_id long, text string")


def round_trip(docs: DataFrame, shared: Broadcast) -> DataFrame:
    """Encodes and decodes every text in one pass: digests of ids and of the decoded bytes, the
    token boundaries inside characters, and whether the bytes came back."""
    return _rows(docs).mapInArrow(partial(_round, shared), ROUND)
