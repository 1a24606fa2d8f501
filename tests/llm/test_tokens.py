import base64
import hashlib
import zlib
from collections import Counter
from functools import cache

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pacelake.llm import byte_bpe, queries, token_counts, token_file
from pacelake.llm.encode import Encoder, load_ranks, merges_of, tokenizer_from_ranks

RANKS = P.path("byte_bpe_50k.tiktoken")
ODD = [
    "", " ", "  ", "a  b", " a", "a ", "a\n", "\na", "\n\na b\tc", "   x", "it's don't 'S we'll", "été à <|endoftext|> x", "x​y", "12 345.67!!", "\x00a b", "a\r\nb", "ａｂｃ １２", "é" * 300, "🙂🙂 👨‍👩", "a\x0bb  c",
    "Ö ö ß", "ΣΑΣ Σ", "a  b", "　x", "<|startoftext|>a<|endoftext|>", "x" * 5000, "word,word", "don't,", "éa", None,
]


@pytest.fixture(scope="module")
def plain():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def from_ranks():
    return tokenizer_from_ranks(RANKS, P.PATTERN)


def test_merges_rebuild_every_token():
    ranks = load_ranks(RANKS)
    assert sorted(ranks[a + b] for a, b in merges_of(ranks)) == sorted(r for t, r in ranks.items() if len(t) > 1)


def test_round_trip_is_tiktokens(spark, docs_of, plain, from_ranks, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [(-i - 1, t) for i, t in enumerate(ODD)]
    shared = byte_bpe.vocabulary(spark, RANKS, P.PATTERN)
    docs = docs_of([t for _, t in rows], [d for d, _ in rows])
    got = {r.doc_id: r for r in byte_bpe.round_trip(docs.withColumnRenamed("lang", "ids"), shared).collect()}
    assert len(got) == len(rows)
    for d, t in rows:
        ids = plain.encode_ordinary(t or "")
        r = got[d]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest() and r.exact
    texts = {r.doc_id: r.text for r in byte_bpe.decode(byte_bpe.encode(docs, shared), shared).collect()}
    assert texts == {d: t or "" for d, t in rows}
    assert byte_bpe.round_trip(docs_of([]), shared).count() == 0


def test_spans_cover_characters(spark, docs_of, from_ranks):
    texts = ["🙂a é", "plain words", "日本語"]
    shared = byte_bpe.vocabulary(spark, RANKS, P.PATTERN)
    table = byte_bpe.token_bytes(Tokenizer.from_str(from_ranks))
    for r in byte_bpe.spans(docs_of(texts), shared).collect():
        text, at = texts[r.doc_id], 0
        raw = text.encode()
        for i, a, z, split in zip(r.ids, r.starts, r.ends, r.split, strict=True):
            n = len(table[i])
            assert raw[at : at + n] == table[i]
            assert split == (len(raw[:at].decode(errors="ignore").encode()) != at or len(raw[: at + n].decode(errors="ignore").encode()) != at + n)
            if not split:
                assert text[a:z].encode() == table[i]
            else:
                assert text[a:z].encode().find(table[i]) >= 0
            at += n


def test_split_characters_are_held_back():
    raw = "é🙂".encode()
    assert "".join(byte_bpe.text_of([raw[:1], raw[1:3], raw[3:]])) == "é🙂"
    assert "".join(byte_bpe.text_of([b"\xff"])) == "�"


#: Texts of what the cuts look at, so that every pair of classes meets.
MIXED = st.text(st.sampled_from(list("aZéÀ×÷ß09'-.< \n\t\r\x0b\x1c\x85\xa0\u2003\u3000\ufeff\u0301日🙂st")), max_size=24)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text() | MIXED, max_size=6))
def test_any_texts_give_the_librarys_ids(plain, from_ranks, texts):
    def rows(e):
        ids, ends = e.encode(pa.array(["left", *texts], pa.string())[1:])
        return [x.tolist() for x in np.split(ids, ends)[:-1]]

    assert rows(own_encoder(from_ranks, ordinary=True)) == [plain.encode_ordinary(t) for t in texts]
    for name, lower in (("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)):
        t = tokenizer(name)
        e = own_encoder(t.to_str(), lower=lower)
        want = [t.encode(x, add_special_tokens=False).ids for x in texts]
        assert rows(e) == want
        assert e.count(pa.array(texts, pa.string()), pa.array([b"a", b" a"]), np.array([1, 1], np.uint8)).tolist() == [len(x) for x in want]


@cache
def own_encoder(tokenizer_json, **how):
    return Encoder(tokenizer_json, limit=3, **how)


@cache
def tokenizer(name):
    return Tokenizer.from_file(P.path(name))


def test_counts_are_the_librarys_whatever_the_table_holds(spark, docs_of):
    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    texts = ODD + ["the same words again and again " * 50] * 3
    want = {i: (len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in enumerate(texts)}
    for size in (0, 3, 1000):
        got = {r.doc_id: r for r in token_counts.count_tokens(docs_of(texts), path, table_size=size).collect()}
        assert {d: (r.n_bytes, r.n_tokens) for d, r in got.items()} == want
        assert all(r.over_limit == (r.n_tokens > 512) for r in got.values())
    assert token_counts.count_tokens(docs_of([]), path).count() == 0


def test_file_against_the_library(spark, docs_of):
    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    ids = [None, *range(50, 50 + len(ODD) - 1)]
    texts = ODD[::-1]
    files = token_file.write(docs_of(texts, ids), path)
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.start, r.n_tokens, r.ids_crc32) for r in files.documents().collect()))
    want, start = [], 0
    for known, d, text in sorted((d is not None, d or 0, x or "") for d, x in zip(ids, texts, strict=True)):
        own = np.array([*t.encode(text, add_special_tokens=False).ids, 1], "<u4")
        want.append((known, d, start, len(own), zlib.crc32(own.tobytes())))
        start += len(own)
    assert got == want
    counts = Counter(i for x in texts for i in [*t.encode(x or "", add_special_tokens=False).ids, 1])
    assert files.ranks == [i for i, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))]
    assert token_file.write(docs_of([]), path).documents().count() == 0


@given(st.lists(st.integers(0, 2**32 - 1), max_size=70))
def test_variable_length_coding_round_trip(values):
    control, data = token_file.pack(np.array(values, np.uint32))
    assert len(control) == -(-len(values) // 4)
    assert token_file.unpack(control, data, len(values)).tolist() == values


def test_a_repeated_id_is_dealt_over_shards(spark, docs_of):
    texts = [f"word {i}" for i in range(3000)] + ["same"] * 40
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files = token_file.write(docs_of(texts, [7] * 3000 + [None] * 40), P.path("word_bpe_49k.json"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = files.documents().orderBy("start").collect()
    assert files.blocks.select("shard").distinct().count() > 1
    assert [r.doc_id for r in got] == [None] * 40 + [7] * 3000 and got[-1].start + got[-1].n_tokens == sum(r.n_tokens for r in got)


def test_whole_table_as_the_library_counts_and_encodes(spark, sf):
    """op7 and op9 on every document against one call of the library for each text."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    bpe = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op7_token_counts(spark, sf).collect()}
    want = {d: (len(t.encode()), n, n > 512) for d, t in docs for n in [len(bpe.encode(t, add_special_tokens=False).ids)]}
    assert got == want
    word = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows, start = {}, 0
    for d, t in sorted(docs):
        ids = [*word.encode(t, add_special_tokens=False).ids, 1]
        rows[d] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op9_token_file(spark, sf).collect()} == rows
