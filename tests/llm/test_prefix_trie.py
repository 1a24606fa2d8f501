"""The prefix trie against a dictionary of all prefixes, over ranges of several sizes."""

import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from pacelake.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_nodes(rows, shared=True):
    turns = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            turns[c].append(((t is not None, t or 0, hashlib.md5(f"{len(r)}:{r}{x}".encode()).hexdigest()), (r, x)))
    own = {c: [y for _, y in sorted(v)] for c, v in turns.items()}
    convs = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if shared else 0
        first = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        convs[c] = tuple(own.get(first, [])[:h] + v[h:])
    members, kids = collections.defaultdict(list), collections.defaultdict(list)
    for c, v in convs.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved, out = {}, {}, []
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = sum(saved[x] for x in kids[k]) + ((len(members[k]) - 1) * len(k[-1][1].encode().split()) if k else 0)
        ends = ",".join(map(str, sorted(c for c in members[k] if len(convs[c]) == len(k))))
        out.append((min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), len(kids[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def got_nodes(df, shared=True, **how):
    out = prefix_trie.nodes(df, prefix_trie.shared_turns(F.col("conv_id")) if shared else None, **how)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, out.collect()), key=repr)


def test_whole_table(spark, sf):
    rows = list(map(tuple, spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()))
    assert sorted(map(tuple, queries.op13_prefix_trie(spark, sf).collect()), key=repr) == plain_nodes(rows)


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(3)
    rows = [(None, 1, "u", "x")]
    for c in range(-30, 150):
        for t in range(rng.choice([0, 1, 2, 3, 5, 8, 40])):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["u", "a", None]), rng.choice(["x y", "z", None, ""]) if rng.random() < 0.5 else "x"))
    return rows + rows[1:20]


@pytest.mark.parametrize("range_bytes", [40, 2_000, 1 << 24])
def test_nulls_ties_repeats_and_ranges(spark, odd, range_bytes):
    df = spark.createDataFrame(odd, SCHEMA).withColumn("Depth", F.lit(1)).withColumn("tokens", F.lit("clash"))
    assert got_nodes(df, range_bytes=range_bytes) == plain_nodes(odd)


def test_hot_prefix_and_copies(spark):
    rows = []
    for c in range(600):  # a third are copies of one conversation, all share a first turn
        rows.append((c, 0, "system", "be kind"))
        rows += [(c, t, "user", f"same words {t}") for t in range(1, 4)] if c % 3 == 0 else [(c, t, "user", f"own {c // 2} {t}") for t in range(1, 1 + c % 5)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got_nodes(df, shared=False, range_bytes=1_000) == plain_nodes(rows, shared=False)
    spread = prefix_trie.rebuilt(df).select(F.unhex(F.array_join("tokens", "")).alias("path")).distinct().repartitionByRange(8, "path")
    sizes = [r["count"] for r in spread.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 6 and max(sizes) < 0.4 * sum(sizes)


def test_one_long_conversation_and_none(spark):
    rows = [(1, t, "user", "w " * 100_000 if t == 7 else f"turn {t}") for t in range(700)] + [(2, t, "user", f"turn {t}") for t in range(5)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got_nodes(df) == plain_nodes(rows)
    assert got_nodes(df.where("false")) == []
