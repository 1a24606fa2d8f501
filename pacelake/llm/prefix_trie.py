"""Prefix trie of conversations, by truncation peeling.

A node is a distinct sequence of first turns.  Each conversation becomes a path: one binary token
for a turn, the md5 of its role and text and its number of words.  Equal paths are
aggregated first, then all paths are dealt into ranges of their order, so that one very common
first turn spreads over many ranges.  A task peels its range from the deepest level up: at
depth d the conversations that end there join the surviving nodes, paths with equal first d
turns become one node with the sums of its children, and every survivor is stripped of its
last turn and grouped again by what is left.  A range is read once, and nodes are
aggregated while they are found.

Only nodes on the first and on the last path of a range may go on in a range beside it.  They
stay open: the two paths, with what their nodes have gathered so far, are the next round's
input, which is smaller by the number of paths in a range.  Rounds end when what is left fits one range
of ``RANGE_BYTES`` or of ``RANGE_PATHS`` paths.  Each round is a written table.  Children that closed under an open
parent take its id from the rounds that follow, by the digest of the parent's path.

Digests of the conversations that end at a node are read from ids in blocks of 4,096
numbers, joined in parallel and hashed in order, so copies of one conversation are never
held as one list.

Rows without a conv_id belong to no conversation and are left out.  Null roles and texts are
empty; a null turn comes first, and rows of one turn come in the order of the md5 of role and
text.  Repeated rows are turns of their own.  Without conversations there are no nodes.  Extra
columns are not read.  The turns of one conversation, 50 bytes each whatever their text, have to fit a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Bytes of a turn in a path: md5 and number of words.
TOKEN = 20
#: Bytes of paths that one task peels at a time.
RANGE_BYTES = 16 << 20
#: A range has more paths than the two that may stay open, so that rounds end.
RANGE_PATHS = 8
#: Ids are joined in blocks of 2^ID_BITS numbers.
ID_BITS = 12

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ended long, node_key binary, parent_key binary"
CELLS = ("n", "least", "kids", "leaves", "saved", "ended")
OPEN = "path binary, " + ", ".join(f"open_{c} array<long>" for c in CELLS)
_NONE = np.iinfo(np.int64).max  # of no conversation


def token(role: Column, text: Column) -> Column:
    """A turn's part of the path, as hexadecimal digits: role and text can't run into each other."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    digest = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))
    return F.concat(digest, F.lpad(F.hex(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))), 8, "0"))


def rebuilt(conversations: DataFrame, shared: Column | None = None, group: int = 20) -> DataFrame:
    """conv_id and tokens of every conversation after its first turns are replaced by those of the first conversation of its group.

    shared: how many turns, of the column conv_id.  None: conversations as they are.
    """
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), token(F.col("role"), F.col("text")).alias("token"))
    first = F.col("conv_id") - F.col("conv_id") % group
    dealt = turns.withColumn("first", first).repartition("first")  # both steps below keep to this partitioning
    in_order = F.transform(F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"), "token"))), lambda t: t["token"])
    own = dealt.groupBy("first", "conv_id").agg(in_order.alias("tokens"))
    if shared is None:
        return own.select("conv_id", "tokens")
    heads = own.where(F.col("conv_id") == F.col("first")).select("first", F.slice("tokens", 1, 3).alias("head"))
    h = shared.cast("int")
    joined = own.join(heads, "first", "left").withColumn("head", F.coalesce("head", F.array().cast("array<string>")))
    return joined.select("conv_id", F.concat(F.slice("head", F.lit(1), h), F.slice("tokens", h + 1, F.size("tokens"))).alias("tokens"))


def shared_turns(conv_id: Column) -> Column:
    """crc32 of the id as text, modulo 4."""
    return F.crc32(conv_id.cast("string")) % 4


def _end_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest of each path's blocks, which come one after another in order."""
    path, least, state = None, 0, hashlib.sha256()

    def rows(done: list[tuple[int, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], ["ended", "ends_sha256"])

    for b in batches:
        done: list[tuple[int, str]] = []
        for p, low, ids in zip(*(b.column(c).to_pylist() for c in ("path_key", "least", "ids")), strict=True):
            if p != path:
                if path is not None:
                    done.append((least, state.hexdigest()))
                path, least, state = p, low, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield rows(done)
    if path is not None:
        yield rows([(least, state.hexdigest())])


def end_digests(paths: DataFrame) -> DataFrame:
    """ended (the smallest id of a path) and the digest of all its ids, ascending."""
    block = paths.groupBy("path_key", F.shiftright("conv_id", ID_BITS).alias("block")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    joined = block.select("path_key", "block", F.get("ids", F.lit(0)).alias("least"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
    return joined.repartition("path_key").sortWithinPartitions("path_key", "block").mapInArrow(_end_digest, "ended long, ends_sha256 string")


class Peel:
    """Peels the sorted paths of one range; ``whole``: there is no range beside it."""

    def __init__(self, paths: list[bytes], cells: list[np.ndarray], whole: bool, keyed: bool):
        self.paths, self.cells, self.whole, self.keyed = paths, cells, whole, keyed
        self.size = np.array([len(p) // TOKEN for p in paths], np.int64)
        self.at = np.concatenate((np.zeros(1, np.int64), np.cumsum(self.size + 1)))  # of each path's cells
        self.tokens = np.frombuffer(b"".join(paths), np.dtype(f"V{TOKEN}"))
        self.first = self.at[:-1] - np.arange(len(paths))  # of each path's tokens
        self.words = np.ascontiguousarray(self.tokens).view(np.uint8).reshape(-1, TOKEN)[:, 16:].copy().view(">u4").astype(np.int64).ravel()
        self.common = self._common()
        last = len(paths) - 1
        self.spine = [] if whole else [0] if last == 0 else [0, last]
        self.left = {k: [[int(_NONE) if c in ("least", "ended") else 0] * (int(self.size[k]) + 1) for c in CELLS] for k in self.spine}
        self.keys = {k: _keys(paths[k]) for k in ({0, last} if keyed or not whole else ())}

    def _common(self) -> np.ndarray:
        """Turns that each path has in common with the one before it."""
        n = len(self.paths)
        out = np.zeros(n, np.int64)
        short = np.minimum(self.size[1:], self.size[:-1])
        begin = np.cumsum(short) - short
        step = np.arange(int(short.sum())) - np.repeat(begin, short)
        same = self.tokens[np.repeat(self.first[:-1], short) + step] == self.tokens[np.repeat(self.first[1:], short) + step]
        until = np.where(same, np.repeat(short, short), step)
        some = np.flatnonzero(short)
        if len(some):
            out[1 + some] = np.minimum.reduceat(until, begin[some])
        return out

    def nodes(self) -> Iterator[list[np.ndarray]]:
        """Columns of NODE, level by level."""
        order = np.argsort(-self.size, kind="stable")  # the longest paths first
        deepest = int(self.size.max(initial=-1))
        ended_by = np.searchsorted(-self.size[order], -np.arange(deepest + 1), "right")  # paths of at least d turns
        child: dict[str, np.ndarray] = {}
        for d in range(deepest, -1, -1):
            here = np.sort(order[: ended_by[d]])
            fresh = np.ones(len(here), bool)
            fresh[1:] = (np.diff(here) > 1) | (self.common[here[1:]] < d)
            start = np.flatnonzero(fresh)
            cell = self.at[here] + d
            total = {c: (np.minimum if c in ("least", "ended") else np.add).reduceat(self.cells[k][cell], start) for k, c in enumerate(CELLS)}
            place = here[start]  # the first path of each node
            open_ = np.zeros(len(start), bool)
            if not self.whole:
                open_[0] = here[0] == 0
                open_[-1] |= here[-1] == len(self.paths) - 1
            if child:
                parent = np.searchsorted(place, child["place"], "right") - 1
                closed = np.flatnonzero(~child["open"])
                up = parent[closed]
                for c in ("n", "leaves", "saved"):
                    np.add.at(total[c], up, child[c][closed])
                np.add.at(total["kids"], up, 1)
                np.minimum.at(total["least"], up, child["least"][closed])
                yield self._rows(d + 1, child, closed, total["least"][up], open_[up], place[up])
            for k in np.flatnonzero(open_):
                into = self.left[0 if place[k] == 0 else len(self.paths) - 1]
                for c, name in enumerate(CELLS):
                    into[c][d] = int(total[name][k])
            shut = ~open_
            total["leaves"] = np.where(shut & (total["kids"] == 0), 1, total["leaves"])
            if d:
                total["saved"] = total["saved"] + np.where(shut, (total["n"] - 1) * self.words[self.first[place] + d - 1], 0)
            child = {**total, "place": place, "open": open_}
        if child:
            closed = np.flatnonzero(~child["open"])
            yield self._rows(0, child, closed, np.zeros(len(closed), np.int64), np.zeros(len(closed), bool), child["place"][closed])

    def _rows(self, depth: int, child: dict[str, np.ndarray], closed: np.ndarray, parent: np.ndarray, waits: np.ndarray, above: np.ndarray) -> list[pa.Array]:
        """waits: the parent is open; above: the first path of the parent."""
        n = len(closed)
        take = lambda c: pa.array(child[c][closed], pa.int64())
        ended = child["ended"][closed]
        last = len(self.paths) - 1
        parents = [self.keys[0 if above[k] == 0 else last][depth - 1] if waits[k] else None for k in range(n)] if waits.any() else [None] * n
        own = [_keys(self.paths[child["place"][k]])[depth] for k in closed] if self.keyed else [None] * n
        return [
            take("least"), pa.array(np.full(n, depth), pa.int64()), pa.array(parent, pa.int64(), mask=waits | (depth == 0)), take("n"), take("kids"), take("leaves"), take("saved"),
            pa.array(ended, pa.int64(), mask=ended == _NONE), pa.array(own, pa.binary()), pa.array(parents, pa.binary()),
        ]


def _keys(path: bytes) -> list[bytes]:
    """The digest of each beginning of the path."""
    state = hashlib.blake2b(digest_size=16)
    out = [state.digest()]
    for k in range(0, len(path), TOKEN):
        state.update(path[k : k + TOKEN])
        out.append(state.digest())
    return out


_NODE_NAMES = [x.split()[0] for x in NODE.split(", ")]
_NODE_TYPES = [pa.binary() if x.endswith("binary") else pa.int64() for x in NODE.split(", ")]
_OPEN_TYPES = [pa.binary()] + [pa.list_(pa.int64())] * len(CELLS)
_OPEN_NAMES = ["path", *(f"open_{c}" for c in CELLS)]


def _peel(whole: bool, keyed: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of nodes (path is null) and of what stays open (depth is null)."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    paths = table.column("path").to_pylist()
    if "conv_id" in table.column_names:  # the first round: each path counts where it ends
        ends = np.cumsum([len(p) // TOKEN + 1 for p in paths])
        cells = [np.full(ends[-1], _NONE if c in ("least", "ended") else 0, np.int64) for c in CELLS]
        cells[0][ends - 1] = table.column("n").to_numpy()
        cells[1][ends - 1] = cells[5][ends - 1] = table.column("conv_id").to_numpy()
    else:
        cells = [table.column(f"open_{c}").combine_chunks().flatten().to_numpy() for c in CELLS]
    peel = Peel(paths, cells, whole, keyed)
    blank = lambda types, n: [pa.nulls(n, t) for t in types]
    for columns in peel.nodes():
        if len(columns[0]):
            yield pa.RecordBatch.from_arrays(columns + blank(_OPEN_TYPES, len(columns[0])), _NODE_NAMES + _OPEN_NAMES)
    n = len(peel.spine)
    columns = [pa.array([peel.paths[k] for k in peel.spine], pa.binary())] + [pa.array([peel.left[k][c] for k in peel.spine], _OPEN_TYPES[1]) for c in range(len(CELLS))]
    yield pa.RecordBatch.from_arrays(blank(_NODE_TYPES, n) + columns, _NODE_NAMES + _OPEN_NAMES)


def nodes(conversations: DataFrame, shared: Column | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """A row for each node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256."""
    spark = conversations.sparkSession
    paths = rebuilt(conversations, shared).select("conv_id", F.unhex(F.array_join("tokens", "")).alias("path")).withColumn("path_key", F.unhex(F.md5("path")))
    paths = stored(paths, "trie-paths")
    left = stored(paths.groupBy("path").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n")), "trie-ranges")
    found, keyed = None, False
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))  # ranges of the first round, unless its size asks for more
    while True:
        size = left.agg(F.count("*").alias("paths"), F.coalesce(F.sum(F.octet_length("path") + TOKEN), F.lit(0)).alias("bytes")).first()
        ranges = max(1 if keyed else spread, size["bytes"] // range_bytes + 1)
        ranges = max(1, min(ranges, size["paths"] // RANGE_PATHS))
        sorted_ = left.repartitionByRange(ranges, "path").sortWithinPartitions("path") if ranges > 1 else left.coalesce(1).sortWithinPartitions("path")
        round_ = stored(sorted_.mapInArrow(partial(_peel, ranges == 1, keyed), f"{NODE}, {OPEN}"), "trie-round")
        shut = round_.where("depth is not null").select(*_NODE_NAMES)
        found = shut if found is None else found.unionByName(shut)
        if ranges == 1:
            break
        left, keyed = round_.where("path is not null").select(*_OPEN_NAMES), True
    known = found.where("parent_key is null")
    waiting = found.where("parent_key is not null").drop("parent_conv_id")
    above = found.where("node_key is not null").select(F.col("node_key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    every = known.unionByName(waiting.join(above, "parent_key", "left"))
    out = every.join(end_digests(paths), "ended", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
