"""Fuzzy line dedup by MinHash: of each group of near-equal lines one line stays.

Every line that isn't blank is judged, in a normal form (lower case, outer blanks off, runs of blanks as one
space).  Two lines link if the Jaccard similarity of their character shingles is 0.8 or more; a line shorter
than a shingle is its own only shingle, so it links with equal lines alone.

1. ``line_table`` splits every text and stores a row for each judged line.  A line that its
   task has not seen before and that holds a shingle also gets its normal form and ``BANDS`` band keys, from a
   one-permutation MinHash of its character shingles (empty bins borrow from the next).
2. Lines that share a band key are candidates.  The (key, line) rows are sorted by key and
   streamed; buckets of one line go, and buckets with the same least line become one group.
3. Candidates get their normal forms, and each group is verified by exact Jaccard
   similarity of shingle sets.  A task keeps a union-find: a line is compared only with
   lines of components that it doesn't belong to yet, and only a forest of links is returned.
   A large group is indexed by shingle; its most central lines come first, and once they hold
   most of the group, only the others have to be compared with all.
   A group above ``SHARD`` lines is first spread over all tasks, where each line is compared with ``PIVOTS``
   lines of its group.  The pivots that some line links make up the hub; lines outside it, as a rule
   a few, are dealt into shards, each of which meets all lines of the group in blocks.
4. ``components`` unites the links; the first occurrence (by doc_id, hash of the text, row, line) of each
   component stays.

Of lines with Jaccard similarity 0.8 a share of 1 - (1 - 0.8 ** 4) ** 12 = 0.998 meets in a
bucket, and more of closer ones.  Lines are known by 128-bit hashes of their normal forms; in links one half names
a line, and links count only for the form that was verified.

Null and empty texts have one line that is not judged.  Every row is a document of its own: of repeated rows one
keeps the line; null ids count as smallest.  Extra
columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh128_intdigest

from .common import own_name, slices, stored
from .components import components, pivot_hubs
from .quality import let

SHINGLE, BANDS, ROWS = 8, 12, 4
#: Similarity 4 / 5.
NUMERATOR, DENOMINATOR = 4, 5
#: Lines of a shard; lines that a task verifies at once; lines that all lines of a group above SHARD are compared with first.
SHARD, BLOCK, PIVOTS = 4096, 8192, 8
#: Groups up to this size are compared pair by pair; central lines that open a larger one.
SMALL, CENTRAL = 48, 4
#: Line hashes that a task remembers, and (key, line) rows that it holds for one bucket.
SEEN, HELD = 1_000_000, 1 << 20

LINES = "row long, doc_id long, doc long, n_lines int, line_no int, line long, check long, norm string, bands array<long>"
_SIGNED, _HALF = 1 << 63, (1 << 64) - 1
_EMPTY = np.uint32(0xFFFFFFFF)


def normal_form(line: str) -> str:
    x = line.lower().strip()
    return " ".join(x.split()) if "  " in x or "\t" in x or "\r" in x or "\xa0" in x else x


def _mix(h: np.ndarray) -> np.ndarray:
    """The finalizer of a 64-bit hash (SplitMix64), in place."""
    t = h >> np.uint64(30)
    h ^= t
    h *= np.uint64(0xBF58476D1CE4E5B9)
    np.right_shift(h, np.uint64(27), out=t)
    h ^= t
    h *= np.uint64(0x94D049BB133111EB)
    np.right_shift(h, np.uint64(31), out=t)
    h ^= t
    return h


def _rolled(text: str) -> np.ndarray:
    """A hash of the SHINGLE characters from each place: those of 2, 4, 8 from those of 1, 2, 4."""
    h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    h += np.uint64(0x632BE59BD9B4E019)
    factor, step = 0x9E3779B97F4A7C15, 1
    while step < SHINGLE:
        h = h[:-step] * np.uint64(factor) + h[step:]
        factor = factor * factor & (1 << 64) - 1
        step *= 2
    return _mix(h)


def _signatures(lines: list[str]) -> np.ndarray:
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    h = _rolled("".join(lines))
    bins = BANDS * ROWS
    owner = np.repeat(np.arange(len(lines)) * bins, sizes)[: len(h)]
    cell = owner + ((h >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).view(np.int64)
    if len(lines) > 1:  # shingles over the end of a line belong to none
        cell[(np.cumsum(sizes[:-1])[:, None] - np.arange(1, SHINGLE)).ravel()] = len(lines) * bins
    sig = np.full(len(lines) * bins + 1, _EMPTY, np.uint32)
    np.minimum.at(sig, cell, h.astype(np.uint32))
    return sig[:-1].reshape(-1, bins)


def band_keys(lines: list[str], chunk: int = 1 << 15) -> np.ndarray:
    """Band keys, a row for each line; each line has SHINGLE characters at least."""
    parts, held, n = [], [], 0
    for x in lines:  # runs of lines that fit in a processor's cache
        held.append(x)
        n += len(x)
        if n >= chunk:
            parts.append(_signatures(held))
            held, n = [], 0
    if held:
        parts.append(_signatures(held))
    bins = BANDS * ROWS
    sig = np.concatenate(parts)
    lacking = np.flatnonzero((sig == _EMPTY).any(axis=1))
    if len(lacking):
        part, own = sig[lacking].copy(), sig[lacking]
        for k in range(1, bins):
            donor = np.roll(own, -k, axis=1)
            fill = (part == _EMPTY) & (donor != _EMPTY)
            part[fill] = donor[fill] + np.uint32(k * 0x85EBCA6B & 0xFFFFFFFF)
            if not (part == _EMPTY).any():
                break
        sig[lacking] = part
    key = np.zeros((len(lines), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        key = _mix(key * np.uint64(0xD6E8FEB86659FD93) + sig[:, r::ROWS])
    return key.view(np.int64)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    for b in slices(batches):
        rows: list[tuple] = []
        fresh: list[tuple[int, str]] = []
        if len(seen) > SEEN:
            seen.clear()
        for row, doc_id, doc, text in zip(*(b.column(c).to_pylist() for c in ("row", "doc_id", "doc", "text")), strict=True):
            lines = (text or "").split("\n")
            rows.append((row, doc_id, doc, len(lines), None, None, None))
            for k, line in enumerate(lines):
                norm = normal_form(line)
                if not norm:
                    continue
                both = xxh128_intdigest(norm.encode("utf-8", "replace"))
                h = (both >> 64) - _SIGNED
                if len(norm) >= SHINGLE and h not in seen:
                    seen.add(h)
                    fresh.append((len(rows), norm))
                rows.append((row, doc_id, doc, None, k, h, (both & _HALF) - _SIGNED))
        norms: list[str | None] = [None] * len(rows)
        for i, norm in fresh:
            norms[i] = norm
        keys = band_keys([n for _, n in fresh]).reshape(-1) if fresh else np.zeros(0, np.int64)
        has = np.zeros(len(rows), np.int64)
        has[[i for i, _ in fresh]] = BANDS
        offsets = np.concatenate(([0], np.cumsum(has))).astype(np.int32)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
        cols = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
        cols += [pa.array(norms, pa.string()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys))]
        yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in LINES.split(", ")])


def line_table(docs: DataFrame, row: str | None = None) -> DataFrame:
    """A row for each document (n_lines) and for each judged line (line_no, line, check), stored; row: a column that tells rows apart."""
    own = F.col(row) if row else F.monotonically_increasing_id()
    doc_id = F.col("doc_id").cast("long")
    return stored(docs.select(own.alias("row"), doc_id.alias("doc_id"), F.xxhash64(doc_id, F.col("text")).alias("doc"), "text").mapInArrow(_lines, LINES), "lines")


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, line) of buckets with two lines and more, where the group is the least line; rows come by key and line."""
    key, line, spilled = np.zeros(0, np.int64), np.zeros(0, np.int64), None

    def out(group: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(group, pa.int64()), pa.array(x, pa.int64())], ["group", "line"])

    def found(k: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        new = np.concatenate(([True], (k[1:] != k[:-1]) | (x[1:] != x[:-1])))
        k, x = k[new], x[new]
        first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        size = np.diff(np.append(first, len(k)))
        keep = np.repeat(size > 1, size)
        return out(np.repeat(x[first], size)[keep], x[keep])

    for b in batches:
        key, line = (np.concatenate((h, np.asarray(c))) for h, c in zip((key, line), b.columns, strict=True))
        if spilled is not None:
            more = key == spilled[0]
            yield out(np.full(more.sum(), spilled[1]), line[more])
            key, line = key[~more], line[~more]
        if not len(key):
            continue
        last = key == key[-1]
        if not last.all():
            yield found(key[~last], line[~last])
            key, line = key[last], line[last]
        if len(key) > HELD:
            spilled = int(key[0]), int(line[0])
            yield out(np.full(len(key), spilled[1]), line)
            key, line = key[:0], line[:0]
    if len(key):
        yield found(key, line)


def candidates(lines: DataFrame) -> DataFrame:
    """group and line: lines that share a band key with another line, stored."""
    banded = lines.where("norm is not null").select(F.explode("bands").alias("key"), "line")
    found = banded.repartition("key").sortWithinPartitions("key", "line").mapInArrow(_buckets, "group long, line long")
    return stored(found.distinct(), "line-candidates")


def shingles(norm: str) -> np.ndarray:
    """Hashes of the line's shingles, ascending, each once."""
    return np.unique(_rolled(norm))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    small, large = sorted((len(a), len(b)))
    if DENOMINATOR * small < NUMERATOR * large:
        return False
    both = np.concatenate((a, b))
    both.sort()
    n = int(np.count_nonzero(both[1:] == both[:-1]))
    return DENOMINATOR * n >= NUMERATOR * (small + large - n)


class Index:
    """Lines by shingle: similarities of a line to all of them at once."""

    def __init__(self, grams: list[np.ndarray]):
        self.sizes = np.array([len(g) for g in grams])
        owner = np.repeat(np.arange(len(grams)), self.sizes)
        flat = np.concatenate(grams)
        order = np.argsort(flat, kind="stable")
        flat, self.owner = flat[order], owner[order]
        self.gram, self.first, counts = np.unique(flat, return_index=True, return_counts=True)
        self.ends = self.first + counts
        common = np.bincount(self.owner, np.repeat(counts, counts).astype(float), len(grams)) / self.sizes
        self.central = np.argsort(-common, kind="stable")  # lines whose shingles most others have too

    def alike(self, g: np.ndarray) -> np.ndarray:
        """Numbers of the lines that are similar enough to one with these shingles."""
        at = np.minimum(np.searchsorted(self.gram, g), len(self.gram) - 1)
        at = at[self.gram[at] == g]
        first, many = self.first[at], self.ends[at] - self.first[at]
        total = int(many.sum())
        rows = np.repeat(first - np.cumsum(many) + many, many) + np.arange(total)
        both = np.bincount(self.owner[rows], minlength=len(self.sizes))
        return np.flatnonzero(DENOMINATOR * both >= NUMERATOR * (self.sizes + len(g) - both))


class Links:
    """A task's union-find over lines, and the shingles of those it has met last."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}
        self.grams: dict[int, np.ndarray] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent[x]
        return root

    def unite(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)

    def of(self, line: int, norm: str) -> np.ndarray:
        got = self.grams.get(line)
        if got is None:
            if len(self.grams) >= 2 * SHARD:
                self.grams.clear()
            got = self.grams[line] = shingles(norm)
        return got

    def verify(self, own: list[tuple[int, str]], queries: list[tuple[int, str]]) -> None:
        """Finds the links between queries and own lines that join components."""
        if not own or len({self.find(x) for x, _ in own} | {self.find(x) for x, _ in queries}) == 1:
            return
        if len(own) > SMALL:
            return self._verify_large(own, queries)
        for line, norm in queries:
            for other, form in own:
                if self.find(line) != self.find(other) and alike(self.of(line, norm), self.of(other, form)):
                    self.unite(line, other)

    def _verify_large(self, own: list[tuple[int, str]], queries: list[tuple[int, str]]) -> None:
        index = Index([self.of(*x) for x in own])
        for k in index.central[:CENTRAL].tolist():
            for near in index.alike(self.of(*own[k])).tolist():
                self.unite(own[k][0], own[near][0])
        hub = own[int(index.central[0])][0]
        mine = {x for x, _ in own}
        for line, norm in queries:
            if self.find(line) != self.find(hub):
                for near in index.alike(self.of(line, norm)).tolist():
                    self.unite(line, own[near][0])
            elif line not in mine:  # own lines outside the hub's component have their own turn
                for other, form in own:
                    if self.find(other) != self.find(hub) and alike(self.of(line, norm), self.of(other, form)):
                        self.unite(line, other)

    def verify_dealt(self, own: list[tuple[int, str]], queries: list[tuple[int, str]]) -> None:
        """Finds the links between a shard's own lines and the queries."""
        if own:
            index = Index([self.of(*x) for x in own])
            for line, norm in queries:
                for near in index.alike(self.of(line, norm)).tolist():
                    self.unite(line, own[near][0])

    def edges(self) -> pa.RecordBatch:
        pairs = [(x, self.find(x)) for x in list(self.parent)]
        self.parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (group, own, dealt, line, norm) come by group, a shard's own lines first."""
    links, group, apart, own, queries = Links(), None, False, [], []
    for b in batches:
        for g, mine, dealt, line, norm in zip(*(b.column(c).to_pylist() for c in ("group", "own", "dealt", "line", "norm")), strict=True):
            if g != group or len(queries) >= BLOCK:
                (links.verify_dealt if apart else links.verify)(own, queries)
                own, queries, group, apart = own if g == group else [], [], g, dealt
            queries.append((line, norm))
            if mine:
                own.append((line, norm))
        if len(links.parent) > HELD:
            yield links.edges()
    (links.verify_dealt if apart else links.verify)(own, queries)
    yield links.edges()


def _near_pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """group, line and near: a bit for each pivot that the line links with."""
    known: dict[int, list[np.ndarray]] = {}
    for b in batches:
        near = []
        for g, norm, pivots in zip(*(b.column(c).to_pylist() for c in ("group", "norm", "pivots")), strict=True):
            if g not in known:
                known.clear()
                known[g] = [shingles(p["norm"]) for p in pivots]
            own = shingles(norm)
            near.append(sum(1 << i for i, p in enumerate(known[g]) if alike(own, p)))
        yield pa.RecordBatch.from_arrays([b.column("group"), b.column("line"), pa.array(near, pa.int32())], ["group", "line", "near"])


def forms(lines: DataFrame, near: DataFrame) -> DataFrame:
    """line, check and norm of the candidates, one form for each line, stored."""
    wanted = stored(near.select("line").distinct(), "candidate-lines")
    own = lines.where("norm is not null").select("line", "check", "norm").join(wanted, "line", "left_semi")
    return stored(own.dropDuplicates(["line"]), "candidate-forms")


def links(near: DataFrame, norms: DataFrame) -> DataFrame:
    """Edges a, b between lines, verified, that connect all near-equal candidates; near has group and line, norms line and norm."""
    norms = norms.select("line", "norm")
    hot = stored(near.groupBy("group").count().where(F.col("count") > SHARD).select("group"), "hot-groups")
    no, yes = F.lit(False), F.lit(True)
    rows = near.join(hot, "group", "left_anti").join(norms, "line").select("group", yes.alias("own"), no.alias("dealt"), "line", "norm")
    by_group = lambda df: df.repartition("group").sortWithinPartitions("group", F.desc("own")).mapInArrow(_verify, "a long, b long")
    if hot.isEmpty():
        return by_group(rows)
    large = stored(near.join(hot, "group").join(norms, "line").select("group", "line", "norm"), "hot-lines")
    cells = large.groupBy("group", F.pmod(F.col("line"), F.lit(PIVOTS)).alias("cell")).agg(F.min(F.struct("line", "norm")).alias("pivot"))
    pivots = stored(cells.groupBy("group").agg(F.sort_array(F.collect_list("pivot")).alias("pivots")), "pivots")
    marked = stored(large.join(pivots, "group").select("group", "line", "norm", "pivots").mapInArrow(_near_pivots, "group long, line long, near int"), "near-pivots")
    seen = marked.groupBy("group", "near").agg(F.count("*").alias("n")).groupBy("group").agg(F.collect_list(F.struct("near", "n")).alias("seen"))  # 2 ** PIVOTS for a group at most
    hubs = seen.mapInArrow(pivot_hubs, "group long, hub int")
    to_pivots = marked.where("near <> 0").join(pivots, "group").select("line", F.explode(F.expr("filter(transform(pivots, (p, i) -> if((near >> i) & 1 = 1, p.line, null)), x -> x is not null)")).alias("b"))
    rest = stored(marked.join(hubs, "group").where(F.col("near").bitwiseAND(F.col("hub")) == 0).select("group", "line"), "hot-rest")
    shards = rest.groupBy("group").count().select("group", F.ceil(F.col("count") / SHARD).cast("int").alias("shards"))
    dealt = large.join(shards, "group").join(rest.withColumn("own", yes), ["group", "line"], "left")
    own_shard = F.pmod(F.xxhash64("line"), F.col("shards")).cast("int")
    dealt = dealt.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    dealt = dealt.select(F.xxhash64("group", "shard").alias("group"), (F.col("own").isNotNull() & (own_shard == F.col("shard"))).alias("own"), yes.alias("dealt"), "line", "norm")
    return by_group(rows.union(dealt)).union(to_pivots.select(F.col("line").alias("a"), "b"))


def decisions(docs: DataFrame, row: str | None = None) -> DataFrame:
    """doc_id, row (a number, or the column ``row``), n_lines and removed (numbers of the removed lines from 0, ascending) of every row."""
    lines = line_table(docs, row)
    near = candidates(lines)
    norms = forms(lines, near)
    checks = norms.select("line", "check")
    roots = components(links(near, norms)).select(F.col("node").alias("line"), "root")
    roots = roots.join(checks, "line").join(checks.select(F.col("line").alias("root"), F.col("check").alias("root_check")), "root")
    placed = lines.where("line is not null").select("row", "doc_id", "doc", "line_no", "line", "check").join(roots, ["line", "check"], "left")
    part = F.coalesce("root", "line").alias("part"), F.coalesce("root_check", "check").alias("part_check")
    placed = stored(placed.select(*part, F.struct("doc_id", "doc", "row", "line_no").alias("place")), "line-places")
    first = stored(placed.groupBy("part", "part_check").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "first-lines")
    removed = placed.join(first, ["part", "part_check"]).where(~F.col("place").eqNullSafe(F.col("first"))).groupBy(F.col("place.row").alias("row")).agg(F.sort_array(F.collect_list("place.line_no")).alias("removed"))
    heads = lines.where("n_lines is not null").select("doc_id", "row", "n_lines")
    return heads.join(removed, "row", "left").select("doc_id", "row", "n_lines", F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, with the removed lines cut from text (and n_chars, if there, counted anew).

    Documents keep their rows whatever is left of their texts.
    """
    key, gone = own_name(docs, "line_row"), own_name(docs, "line_gone")
    keyed = stored(docs.withColumn(key, F.monotonically_increasing_id()), "numbered-documents")
    cut = decisions(keyed, key).where("size(removed) > 0").select(F.col("row").alias(key), F.col("removed").alias(gone))
    joined = keyed.join(cut, key, "left")
    left = lambda x: F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col(gone)), lambda i: F.get(x, i))
    kept = F.array_join(let(F.split("text", "\n"), left), "\n")
    out = joined.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(kept))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(kind)))
    return out.select(*docs.columns)
