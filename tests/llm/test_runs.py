"""Periodic runs against a search of all periods and starts."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from pacelake.llm import queries, runs


def plain_runs(w):
    """Every stretch that keeps a period p, for all p, without those that keep a smaller one."""
    n, out = len(w), []
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            size = j - i + p
            if size >= max(6, 4 * p) and not any(w[i : i + size - q] == w[i + q : i + size] for q in range(1, p)):
                out.append((i, size, p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    w = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    found = plain_runs(w)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    gone = {k for s, size, p in found for k in range(s + p, s + size)}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *top, sha("".join(f"{s},{size},{p}\n" for s, size, p in found).encode()), sha(b" ".join(x for k, x in enumerate(w) if k not in gone)))


def test_whole_table(spark, sf):
    out = queries.op11_word_runs(spark, sf)
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(map(tuple, out.collect()))
    assert got == sorted(plain_row(d, t) for d, t in docs)
    assert sum(r[1] > 0 for r in got) >= 5


@pytest.mark.parametrize("seed", range(4))
def test_small_alphabets(seed):
    rng = random.Random(seed)
    for _ in range(150):
        docs = []
        for _ in range(rng.randint(0, 5)):
            letters, n = rng.choice([1, 2, 3, 5, 50]), rng.randint(0, 70)
            w = [rng.randrange(letters) for _ in range(n)]
            if n and rng.random() < 0.6:
                s, p = rng.randrange(n), rng.randint(1, 14)
                w[s:] = [w[s + (i - s) % p] for i in range(s, n)]
                for _ in range(rng.randint(0, 2)):
                    w[rng.randrange(n)] = rng.randrange(letters)
            docs.append(w)
        codes, text = np.array([x for w in docs for x in w], np.int32), np.repeat(np.arange(len(docs), dtype=np.int32), [len(w) for w in docs])
        assert list(map(tuple, runs.find(codes, text).tolist())) == [(k, *r) for k, w in enumerate(docs) for r in plain_runs(w)]


def test_wavelet_matrix_against_sorting():
    rng = np.random.default_rng(1)
    for n in (1, 2, 17, 300):
        values = rng.permutation(n)
        m = runs.WaveletMatrix(values)
        for _ in range(50):
            a, b = sorted(rng.integers(0, n + 1, 2))
            x, part = int(rng.integers(0, 2 * n + 2)), np.sort(values[a:b])
            one = lambda v: np.array([v], np.int64)
            assert m.less(one(a), one(b), one(x))[0] == (part < x).sum()
            if b > a:
                k = int(rng.integers(0, b - a))
                assert m.nth(one(a), one(b), one(k))[0] == part[k]
                low, high = m.neighbours(one(a), one(b), one(part[k]))
                assert (low[0], high[0]) == (part[k - 1] if k else -1, part[k + 1] if k + 1 < b - a else -1)


def test_odd_rows(spark, docs_of):
    long = " ".join(f"w{i % 50_000}" for i in range(200_000)) + " end"  # over a megabyte, exponent 4
    texts = [None, "", " \n\t\r\x0b\x0c ", "a a a a a a", "a a a a a", "a a a a a a", "x é é é é é é y", "b b " * 6, long]
    docs = docs_of(texts, [None, 1, 2, 3, 3, 3, None, 7, 11]).withColumnRenamed("source", "Runs").withColumnRenamed("lang", "N_words")
    got = sorted(map(tuple, runs.digests(runs.runs(docs, runs.planted)).collect()), key=repr)
    want = [plain_row(i, t) for i, t in zip([None, 1, 2, 3, 3, 3, None, 7], texts[:-1], strict=True)]
    assert [r for r in got if r[0] != 11] == sorted(want, key=repr)
    (last,) = [r for r in got if r[0] == 11]
    assert last[1:6] == (1, 0, 200_000, 50_000, 4000)
    kept = {r.collapsed for r in runs.runs(docs).where("doc_id is null or doc_id = 3").collect()}
    assert kept == {"", "a", "a a a a a", "x é y"}
    assert runs.runs(docs.where("false")).count() == 0
