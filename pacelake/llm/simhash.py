"""Near-duplicate groups by SimHash fingerprints and BK-trees.

A fingerprint has a bit set where over half of the text's shingle hashes (XXH64, seed
42, of four words) have it set; a text without words has the fingerprint zero.  Texts
link at ``radius`` or fewer differing bits.

Fingerprints are made distinct first, so copies cost nothing.  If two differ in at most
r bits, then of r + k blocks at least k agree: every choice of k blocks gives a bucket
key, and k grows with the number of fingerprints so that a bucket of unrelated ones stays
small.  Each bucket is a shard with a BK-tree of its own, whose children are keyed by the
integer distance to their parent; a search follows only the edges within the radius of
the distance it has just measured.  A bucket above ``SHARD``
fingerprints is first compared with ``PIVOTS`` of its own, by columns alone.  The pivots that
some fingerprint links make up the hub; fingerprints outside it get trees, and as all of the bucket has to meet
these, the bits that its key leaves open are blocked once more, into buckets within the
bucket.  Trees of more than ``SHARD`` of such fingerprints are dealt into several, each of which is sent to all
queries of its bucket.  So no link is lost and no task holds more than a tree and a chunk of queries.  A task returns a
forest of its links, never all pairs; ``components`` unites the forests.

Null texts count as empty.  Rows with one doc_id stand for one document with several
texts: each row has its fingerprint.  Null ids are never a component's smallest id.  Extra
columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from .common import LOWER_TABLE, documents_with_key, own_name, slices, stored
from .components import components, hook, pivot_hubs

RADIUS, SHINGLE, SEED = 4, 4, 42
#: Fingerprints of a shard tree at most, and unrelated ones expected in a bucket.
SHARD, EXPECTED = 16_384, 64
#: Fingerprints of a bucket above SHARD that all of it is compared with, and open blocks that agree in a bucket within it.
PIVOTS, AGREEING = 8, 2
#: All bits of a fingerprint.
EVERY = (1 << 64) - 1
#: Rows that a task holds at once, and pairs that a search holds at once.
CHUNK_ROWS, FRONTIER = 1 << 19, 1 << 21


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> bytes:
    """Eight bytes, the highest bit first."""
    words = text.encode("utf-8", "replace").translate(LOWER_TABLE).split() if text else []
    if not words:
        return bytes(8)
    n = len(words)
    line = b" ".join(words)
    if n <= shingle:
        return xxh64_digest(line, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    raw = np.frombuffer(b"".join([xxh64_digest(line[a:z], seed) for a, z in spans]), np.uint8).reshape(-1, 8)
    counts = np.zeros(64, np.int64)
    for k in range(0, len(raw), 1 << 14):
        counts += np.unpackbits(raw[k : k + (1 << 14)], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(raw)).tobytes()


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, limit=1 << 22):
        raw = b"".join([fingerprint(t) for t in b.column("text").to_pylist()])
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("doc"), pa.array(np.frombuffer(raw, ">i8").astype(np.int64))], ["doc_id", "doc", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, doc (a hash of id and text) and fp (the fingerprint as a signed long) of every row."""
    return documents_with_key(docs).mapInArrow(_fingerprints, "doc_id long, doc long, fp long")


def masks(bits: int, radius: int, k: int) -> list[int]:
    """The bits of every choice of k of radius + k blocks of the bits that are set."""
    places = [i for i in range(64) if bits >> i & 1]
    edges = [len(places) * i // (radius + k) for i in range(radius + k + 1)]
    blocks = [sum(1 << i for i in places[a:z]) for a, z in zip(edges, edges[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(blocks, k)]


def signed(mask: int) -> Column:
    return F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")


def blocks_agreeing(n: int, radius: int) -> int:
    """The smallest k for which ``n`` random fingerprints leave EXPECTED of them in a bucket at most."""
    k = 1
    while n > EXPECTED * 2.0 ** (64 * k // (radius + k)) and comb(radius + k + 1, k + 1) <= 70:
        k += 1
    return k


class Forest:
    """BK-trees of groups of values, one for each group, built level by level."""

    def __init__(self, group: np.ndarray, value: np.ndarray):
        self.value = value
        n = len(value)
        self.groups, first, inverse = np.unique(group, return_index=True, return_inverse=True)
        self.roots = first
        parent = first[inverse]
        waiting = np.flatnonzero(parent != np.arange(n))
        keys, nodes = [], []
        while len(waiting):
            up = parent[waiting]
            key = up * 65 + np.bitwise_count(value[waiting] ^ value[up])
            found, at, inverse = np.unique(key, return_index=True, return_inverse=True)
            keys.append(found)
            nodes.append(waiting[at])
            parent[waiting] = waiting[at][inverse]
            waiting = waiting[parent[waiting] != waiting]
        key, node = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, nodes))
        order = np.argsort(key)
        self.key, self.node = key[order], node[order]

    def search(self, group: np.ndarray, value: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of a query's and a node's number within the radius; every group of a query needs a tree."""
        query, at = np.arange(len(value)), self.roots[np.searchsorted(self.groups, group)]
        while len(query):
            d = np.bitwise_count(value[query] ^ self.value[at]).astype(np.int64)
            near = d <= radius
            yield query[near], at[near]
            low = np.searchsorted(self.key, at * 65 + np.maximum(d - radius, 0))
            high = np.searchsorted(self.key, at * 65 + np.minimum(d + radius, 64), "right")
            many = high - low
            query = np.repeat(query, many)
            at = self.node[np.repeat(low - np.cumsum(many) + many, many) + np.arange(len(query))]


def _links(key: np.ndarray, fp: np.ndarray, tree: np.ndarray, radius: int) -> pa.RecordBatch:
    """A forest of the links between rows of equal keys of which one is in the tree."""
    names, row = np.unique(fp, return_inverse=True)
    parent = np.arange(len(names))
    value = fp.view(np.uint64)
    members = np.flatnonzero(tree)
    forest = Forest(key[members], value[members])
    sizes = np.unique(key[members], return_counts=True)[1][np.searchsorted(forest.groups, key)]
    block = np.cumsum(sizes) // FRONTIER
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1), len(key)]
    for a, z in zip(cuts, cuts[1:], strict=False):
        for query, at in forest.search(key[a:z], value[a:z], radius):
            hook(parent, row[a:z][query], row[members][at])
    child = np.flatnonzero(parent != np.arange(len(names)))
    return pa.RecordBatch.from_arrays([pa.array(names[child]), pa.array(names[parent[child]])], ["a", "b"])


def _search(radius: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by key, those of the tree first.  A key's rows stay together unless they fill a chunk; then its tree stays."""
    held: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]
    for b in batches:
        held = [np.concatenate((h, np.asarray(c))) for h, c in zip(held, b.columns, strict=True)]
        if len(held[0]) < CHUNK_ROWS:
            continue
        last = held[0] == held[0][-1]
        if last.all():
            yield _links(*held, radius)
            keep = held[2]
        else:
            yield _links(*(h[~last] for h in held), radius)
            keep = last
        held = [h[keep] for h in held]
    if len(held[0]):
        yield _links(*held, radius)


def _within(large: DataFrame, radius: int, chosen: list[int]) -> tuple[DataFrame, DataFrame]:
    """Of buckets above SHARD (rows choice, key, fp) the edges a, b to pivots, and rows key, fp, tree for the search."""
    cells = large.groupBy("key", F.pmod(F.xxhash64("fp"), F.lit(PIVOTS)).alias("cell")).agg(F.min("fp").alias("pivot"))
    pivots = stored(cells.groupBy("key").agg(F.sort_array(F.collect_list("pivot")).alias("pivots")), "fingerprint-pivots")
    bits = F.transform("pivots", lambda p, i: F.when(F.bit_count(F.col("fp").bitwiseXOR(p)) <= radius, F.pow(F.lit(2), i).cast("int")).otherwise(0))
    near = F.aggregate(bits, F.lit(0), lambda x, y: x + y)
    marked = stored(large.join(pivots, "key").select("choice", "key", "fp", near.alias("near")), "near-pivots")
    seen = marked.groupBy("key", "near").agg(F.count("*").alias("n")).groupBy(F.col("key").alias("group")).agg(F.collect_list(F.struct("near", "n")).alias("seen"))  # 2 ** PIVOTS for a bucket at most
    hubs = seen.mapInArrow(pivot_hubs, "group long, hub int").withColumnRenamed("group", "key")
    linked = F.filter("pivots", lambda p: F.bit_count(F.col("fp").bitwiseXOR(p)) <= radius)
    edges = marked.where("near <> 0").join(pivots, "key").select(F.col("fp").alias("a"), F.explode(linked).alias("b"))
    inner = F.array(*[F.array(*[signed(m) for m in masks(EVERY ^ mask, radius, AGREEING)]) for mask in chosen])[F.col("choice")]
    told = marked.join(hubs, "key").withColumn("tree", F.col("near").bitwiseAND(F.col("hub")) == 0)
    rows = stored(told.select("fp", "tree", F.explode(F.transform(inner, lambda m, j: F.xxhash64("key", j, F.col("fp").bitwiseAND(m)))).alias("key")), "inner-buckets")
    trees = stored(rows.where("tree").groupBy("key").count().select("key", F.ceil(F.col("count") / SHARD).cast("int").alias("shards")), "inner-trees")
    dealt = rows.join(trees, "key").select("*", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    own = F.pmod(F.xxhash64("fp"), F.col("shards")).cast("int") == F.col("shard")
    return edges, dealt.select(F.xxhash64("key", "shard").alias("key"), "fp", (F.col("tree") & own).alias("tree"))


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges a, b between distinct fingerprints (column fp) that connect all those within the radius."""
    chosen = masks(EVERY, radius, blocks_agreeing(distinct.count(), radius))
    keys = [F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(signed(m))) for i, m in enumerate(chosen)]
    keyed = distinct.select("fp", F.posexplode(F.array(*keys)).alias("choice", "key"))
    hot = stored(keyed.groupBy("key").count().where(F.col("count") > SHARD).select("key"), "hot-buckets")
    search = lambda rows: rows.repartition("key").sortWithinPartitions("key", F.desc("tree")).mapInArrow(partial(_search, radius), "a long, b long")
    if hot.isEmpty():
        return search(keyed.select("key", "fp", F.lit(True).alias("tree")))
    cold = keyed.join(hot, "key", "left_anti").select("key", "fp", F.lit(True).alias("tree"))
    edges, rows = _within(stored(keyed.join(hot, "key"), "hot-fingerprints"), radius, chosen)
    return search(cold.unionByName(rows)).unionByName(edges)


def groups(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, doc, fp, component_id (the smallest doc_id reachable over links, its own included) and root (a
    fingerprint that stands for the component) of every row."""
    marked = stored(fingerprints(docs), "fingerprints")
    distinct = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct-fingerprints")
    roots = components(links(distinct.select("fp"), radius)).withColumnRenamed("node", "fp")
    named = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_fp = named.select("fp", "root").join(smallest, "root").select("fp", "root", "component_id")
    return marked.join(by_fp, "fp").select("doc_id", "doc", "fp", "component_id", "root")


def first_of_groups(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs``, all columns, that come first (by doc_id, nulls last, and hash) in their group."""
    place = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "doc")
    key, of, nth = own_name(docs, "row_key"), own_name(docs, "row_of"), own_name(docs, "nth_row")
    first = groups(docs, radius).groupBy("root").agg(F.min(place).alias("place")).select(F.col("place.doc").alias(key), F.col("place.doc_id").alias(of))
    keyed = docs.withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), F.col("text")))
    keyed = keyed.join(first, (keyed[key] == first[key]) & keyed["doc_id"].cast("long").eqNullSafe(first[of]), "left_semi")
    same = Window.partitionBy("doc_id", key).orderBy(key)
    return keyed.withColumn(nth, F.row_number().over(same)).where(F.col(nth) == 1).select(*docs.columns)
