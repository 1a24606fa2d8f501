import random

import numpy as np
import xxhash

from pacelake.llm import simhash
from pacelake.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text):
    words = (text or "").translate(LOWER).encode().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps, radius=4):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        r = find(i)
        least[r] = min([x for x in (least.get(r), d) if x is not None], default=None)
    return [least[find(i)] for i in range(len(ids))]


def test_whole_table_against_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    fps = [plain_fingerprint(r.text) for r in rows]
    want = {r.doc_id: (f, c) for r, f, c in zip(rows, fps, plain_components([r.doc_id for r in rows], fps), strict=True)}
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.groups(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    assert got == want


def test_edge_cases(spark, docs_of):
    texts = [None, "", "one", "One", "a b c d", "a b c d", "x " * 30_000, "x " * 30_000 + "y"]
    ids = [5, 3, 7, 7, None, 9, 11, 12]
    rows = {(r.doc_id, r.component_id) for r in simhash.groups(docs_of(texts, ids).withColumnRenamed("lang", "fp")).collect()}
    assert rows == {(5, 3), (3, 3), (7, 7), (None, 9), (9, 9), (11, 11), (12, 11)}
    assert simhash.groups(docs_of([])).count() == 0


def test_links_of_dense_and_sparse_values_at_any_block_count(spark, monkeypatch):
    rng = random.Random(3)
    values = {rng.getrandbits(64) for _ in range(150)}
    for center in list(values)[:3]:
        for _ in range(80):
            v = center
            for _ in range(rng.randrange(8)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    want = plain_components(signed, [s % (1 << 64) for s in signed])
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    for expected, shard in ((64, 16_384), (0.001, 16_384), (64, 50), (0.001, 4)):
        monkeypatch.setattr(simhash, "EXPECTED", expected)
        monkeypatch.setattr(simhash, "SHARD", shard)
        roots = {r.node: r.root for r in components(simhash.links(df)).collect()}
        assert [roots.get(s, s) for s in signed] == want


def test_bk_tree_keeps_every_value_and_search_is_exact():
    rng = np.random.default_rng(1)
    value = np.unique(rng.integers(0, 1 << 20, 400, dtype=np.uint64))
    group = (value % 3).astype(np.int64)
    forest = simhash.Forest(group, value)
    got = {(int(q), int(n)) for a, b in forest.search(group, value, 4) for q, n in zip(a, b, strict=True)}
    want = {(i, j) for i in range(len(value)) for j in range(len(value)) if group[i] == group[j] and bin(int(value[i] ^ value[j])).count("1") <= 4}
    assert got == want
    assert len(forest.node) == len(value) - 3


def test_components_of_a_long_path_and_repeated_edges(spark):
    edges = [(i, i + 1) for i in range(40)] * 2 + [(100, 100), (None, 3), (200, 201)]
    roots = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert roots == {i: 0 for i in range(1, 41)} | {201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
