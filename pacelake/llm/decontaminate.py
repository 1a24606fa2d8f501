"""Benchmark decontamination by a distributed positional inverted index.

``build`` stores the postings of all training words in segments.  A segment holds whole
documents (about ``SEGMENT_BYTES`` of text, or one longer document): its words in order,
and for each word the ascending positions, as gaps in byte-aligned variable-length coding.
Positions number the words of the segment; documents stand ``GAP`` apart, so no match
spans two.  As the index is split by documents, a very frequent word is spread over all
segments, nothing is shuffled, and each segment is searched on its own.

``search`` takes the phrases of a query set.  A segment that lacks one of a phrase's
words is done with it at once; otherwise the list of its rarest word, less that word's
offset, is intersected with the other offset-adjusted lists from rare to frequent.  With a
slop, the result has proximity matches too, of which the exact ones are a part: there is a start s such that
each word of the phrase has a place of its own within the slop of s plus its offset, and the places
ascend as the words do.  The rarest word only picks the starts that are tried, so which
documents share a segment changes nothing.  Query sets go to the tasks in blocks of ``BLOCK_WORDS`` words, one after
another: each block's matches are stored before the next block is sent, so
what is broadcast and held has a fixed bound.

Null and empty texts have no words and no hits; items without words are never found.
Repeated rows are rows of the result as well; items with a null id are left out.  Extra
columns are not read; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored, words_of
from .token_file import pack, unpack

WINDOW, SLOP, GAP = 10, 2, 64
SEGMENT_BYTES, BLOCK_WORDS = 8 << 20, 2_000_000
SEGMENTS = "doc_ids binary, known binary, n_words binary, terms binary, list_ends binary, control binary, data binary"
FOUND = "doc_id long, n_words long, n_hit long, items array<string>, near_items array<string>"
MATCHES = "segment long, place int, doc_id long, item_id string, start long, end long, exact boolean"
PLACES = "segment long, place int, doc_id long, n_words long"


def _bounds(n_words: np.ndarray) -> np.ndarray:
    """Position of the first word of each document, and the end."""
    return np.concatenate(([0], np.cumsum(n_words + GAP)))


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, limit=SEGMENT_BYTES):
        words = [words_of(t) for t in b.column("text").to_pylist()]
        n_words = np.array([len(w) for w in words], np.int64)
        total = int(n_words.sum())
        terms = sorted(set().union(*words))
        number = dict(zip(terms, range(len(terms)), strict=True))
        code = np.fromiter(map(number.__getitem__, chain.from_iterable(words)), np.int64, total)
        at = np.repeat(_bounds(n_words)[:-1] - (np.cumsum(n_words) - n_words), n_words) + np.arange(total)
        both = np.sort(code << 32 | at)
        code, at = both >> 32, both & 0xFFFFFFFF
        ends = np.cumsum(np.bincount(code, minlength=len(terms)))
        gaps = np.diff(at, prepend=0)
        first = np.concatenate(([0], ends[:-1])) if len(terms) else ends
        gaps[first] = at[first]
        control, data = pack(gaps)
        known = np.packbits(np.asarray(b.column("doc_id").is_valid()))
        row = [np.asarray(b.column("doc_id").fill_null(0), "<i8"), known, n_words.astype("<i8"), b" ".join(terms), ends.astype("<i4"), control, data]
        yield pa.RecordBatch.from_arrays([pa.array([x if isinstance(x, bytes) else x.tobytes()], pa.binary()) for x in row], [c.split()[0] for c in SEGMENTS.split(", ")])


def build(docs: DataFrame) -> DataFrame:
    """The index of all texts as a stored table of segments."""
    segments = docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(_build, SEGMENTS)
    return stored(segments.withColumn("segment", F.monotonically_increasing_id()), "positional-index")


class Segment:
    """A segment that is being searched."""

    def __init__(self, row: dict):
        known = np.frombuffer(row["known"], np.uint8)
        self.n_words = np.frombuffer(row["n_words"], "<i8")
        self.doc_ids = np.frombuffer(row["doc_ids"], "<i8")
        self.known = np.unpackbits(known, count=len(self.n_words)).astype(bool)
        self.bounds = _bounds(self.n_words)
        terms = row["terms"].split()
        self.number = dict(zip(terms, range(len(terms)), strict=True))
        ends = np.frombuffer(row["list_ends"], "<i4").astype(np.int64)
        self.ends, self.first = ends, np.concatenate(([0], ends[:-1])) if len(ends) else ends
        self.gaps = unpack(row["control"], row["data"], int(ends[-1]) if len(ends) else 0)

    def postings(self, term: int) -> np.ndarray:
        return np.cumsum(self.gaps[self.first[term] : self.ends[term]], dtype=np.int64)

    def document(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, at, "right") - 1


class Phrases:
    """Distinct phrases of a block of queries, by length; ``owners`` has the items of each."""

    def __init__(self, items: list[tuple[str, list[list[bytes]]]]):
        self.words: list[bytes] = []
        number: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, phrases in items:
            for p in phrases:
                owners.setdefault(tuple(number.setdefault(w, len(number)) for w in p), set()).add(item)
        self.words = list(number)
        self.by_length: dict[int, list[tuple[int, ...]]] = {}
        for p in owners:
            self.by_length.setdefault(len(p), []).append(p)
        self.owners = owners

    def matches(self, seg: Segment, slop: int) -> Iterator[tuple[tuple[int, ...], np.ndarray, np.ndarray, np.ndarray]]:
        """Each phrase that occurs with its exact starts, and the first and last places of its matches within the slop."""
        if 2 * slop >= GAP:
            raise ValueError(f"a slop of {slop} reaches over the {GAP} places between documents")
        term = np.array([seg.number.get(w, -1) for w in self.words], np.int64)
        df = np.where(term >= 0, (seg.ends - seg.first)[term] if len(seg.ends) else 0, 0)
        lists: dict[int, np.ndarray] = {}

        def of(word: int) -> np.ndarray:
            if word not in lists:
                lists[word] = np.append(seg.postings(term[word]), 1 << 62)
            return lists[word]

        for length, phrases in self.by_length.items():
            all_words = np.array(phrases, np.int64)
            counts = df[all_words]
            for k in np.flatnonzero(counts.min(axis=1) > 0):
                lists_of = [of(w) for w in all_words[k].tolist()]
                order = np.argsort(counts[k], kind="stable").tolist()
                near = exact = lists_of[order[0]][:-1] - order[0]
                for offset in order[1:]:
                    postings = lists_of[offset]
                    if len(exact):
                        exact = exact[postings[np.searchsorted(postings, exact + offset)] == exact + offset]
                    if slop:  # two words of a match stand at most twice the slop from their distance
                        near = near[postings[np.searchsorted(postings, near + (offset - 2 * slop))] <= near + (offset + 2 * slop)]
                    if not len(near if slop else exact):
                        break
                if not slop:
                    first, last = exact, exact + (length - 1)
                elif len(near):
                    first, last = self._in_order(lists_of, *self._starts(seg, near, order[0], slop, length + 2 * slop >= GAP), slop)
                else:
                    continue
                if len(first):
                    yield phrases[k], exact, first, last

    @staticmethod
    def _starts(seg: Segment, anchors: np.ndarray, offset: int, slop: int, wide: bool) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
        """All starts that have an anchor within the slop and, where a match might reach into the next document, the bounds of theirs."""
        all_ = (anchors[:, None] + np.arange(-slop, slop + 1)).ravel()
        starts, at = np.unique(all_, return_index=True)
        if not wide:
            return starts, None, None
        d = seg.document(anchors[at // (2 * slop + 1)] + offset)
        return starts, seg.bounds[d], seg.bounds[d] + seg.n_words[d]

    @staticmethod
    def _in_order(lists_of: list[np.ndarray], starts: np.ndarray, low: np.ndarray | None, high: np.ndarray | None, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last places of the matches whose words take the leftmost places that ascend."""
        first = last = np.full(len(starts), -1) if low is None else low - 1
        for offset, postings in enumerate(lists_of):
            place = postings[np.searchsorted(postings, np.maximum(starts + (offset - slop), last + 1))]
            ok = place <= starts + (offset + slop)
            if high is not None:
                ok &= place < high
                high = high[ok]
            starts, last = starts[ok], place[ok]
            first = first[ok] if offset else last
        both = np.unique(first << 32 | last)
        return both >> 32, both & 0xFFFFFFFF


def _search(block: Broadcast, slop: int, spans: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    phrases: Phrases = block.value
    for b in batches:
        for row in b.to_pylist():
            seg = Segment(row)
            steps = np.zeros(seg.bounds[-1] + 1, np.int32)
            items: list[set[str]] = [set() for _ in seg.n_words]
            close: list[set[str]] = [set() for _ in seg.n_words]
            rows: list[tuple] = []
            for phrase, exact, first, last in phrases.matches(seg, slop):
                owners = phrases.owners[phrase]
                np.add.at(steps, exact, 1)
                np.add.at(steps, exact + len(phrase), -1)
                for d in set(seg.document(exact).tolist()):
                    items[d] |= owners
                for d in set(seg.document(first).tolist()):
                    close[d] |= owners
                if spans:
                    apart = last - first >= len(phrase)
                    first, end = np.concatenate((exact, first[apart])), np.concatenate((exact + len(phrase), last[apart] + 1))
                    for k, (at, to, d) in enumerate(zip(first.tolist(), end.tolist(), seg.document(first).tolist(), strict=True)):
                        base = int(seg.bounds[d])
                        rows += [(row["segment"], d, seg.doc_ids[d] if seg.known[d] else None, o, at - base, to - base, k < len(exact)) for o in sorted(owners)]
            if spans:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_())
                names = [c.split()[0] for c in MATCHES.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)
                continue
            hit = np.concatenate(([0], np.cumsum(np.cumsum(steps) > 0)))
            n_hit = hit[seg.bounds[1:]] - hit[seg.bounds[:-1]]
            lists = [pa.array([sorted(s) for s in x], pa.list_(pa.string())) for x in (items, close)]
            cols = [pa.array(seg.doc_ids, pa.int64(), mask=~seg.known), pa.array(seg.n_words, pa.int64()), pa.array(n_hit, pa.int64()), *lists]
            yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in FOUND.split(", ")])


def windows(text: str | None, size: int = WINDOW) -> list[list[bytes]]:
    """Runs of ``size`` words; a text of fewer words, but not none, is one run."""
    w = words_of(text)
    return [w[i : i + size] for i in range(max(1, len(w) - size + 1))] if w else []


def blocks(benchmark: DataFrame, size: int = WINDOW) -> Iterable[Phrases]:
    """The query set in blocks of bounded size; the driver holds two blocks at a time at most."""
    held, n = [], 0
    for r in benchmark.selectExpr("cast(item_id as string) as item_id", "text").where("item_id is not null").toLocalIterator():
        held.append((r.item_id, windows(r.text, size)))
        n += len(held[-1][1]) * size
        if n >= BLOCK_WORDS:
            yield Phrases(held)
            held, n = [], 0
    if held:
        yield Phrases(held)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of the segments."""
    for b in batches:
        for r in b.to_pylist():
            n_words, doc_ids = np.frombuffer(r["n_words"], "<i8"), np.frombuffer(r["doc_ids"], "<i8")
            known = np.unpackbits(np.frombuffer(r["known"], np.uint8), count=len(n_words)).astype(bool)
            cols = [pa.array(np.full(len(n_words), r["segment"])), pa.array(np.arange(len(n_words), dtype=np.int32)), pa.array(doc_ids, pa.int64(), mask=~known), pa.array(n_words, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in PLACES.split(", ")])


def _block_matches(index: DataFrame, phrases: Iterable[Phrases], slop: int) -> DataFrame:
    """All matches, a stored table for each block."""
    sc, out = index.sparkSession.sparkContext, index.sparkSession.createDataFrame([], MATCHES)
    for p in phrases:
        sent = sc.broadcast(p)
        out = out.unionByName(stored(index.mapInArrow(partial(_search, sent, slop, True), MATCHES), "block-matches"))
        sent.unpersist()
    return out


def search(index: DataFrame, benchmark: DataFrame, size: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """For every document: doc_id, n_words, n_hit (words inside occurrences of a window), items and
    near_items (items with windows that occur exactly, or within the slop), sorted as strings.

    A query set of one block is answered in one pass over the segments.  With more of them, the blocks are searched one
    after another, and a document's stored matches are put together.
    """
    phrases = iter(blocks(benchmark, size))
    first, second = next(phrases, Phrases([])), next(phrases, None)
    if second is None:
        return index.mapInArrow(partial(_search, index.sparkSession.sparkContext.broadcast(first), slop, False), FOUND)
    found = _block_matches(index, chain([first, second], phrases), slop)
    del first, second
    place = ["segment", "place"]
    spans = found.where("exact").select(*place, "start", "end").distinct()
    hits = spans.select(*place, F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("word")).distinct().groupBy(*place).agg(F.count("*").alias("n_hit"))
    items = found.groupBy(*place).agg(F.sort_array(F.collect_set(F.when(F.col("exact"), F.col("item_id")))).alias("items"), F.sort_array(F.collect_set("item_id")).alias("near_items"))
    out = index.mapInArrow(_places, PLACES).join(hits, place, "left").join(items, place, "left")
    none = F.array().cast("array<string>")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("near_items", none).alias("near_items"))


def matches(index: DataFrame, benchmark: DataFrame, size: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """segment and place (of the document in it), doc_id, item_id, start and end word, exact: every exact match, and the proximity
    matches, each with the leftmost places that its start allows."""
    return _block_matches(index, blocks(benchmark, size), slop).distinct()


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Matches over the whole table: exact ones with the digest of the items and the verdict, and number and digest of the near items."""
    found = search(build(docs), benchmark)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"), F.size("near_items").cast("long").alias("n_near_items"), F.sha2(F.concat_ws(",", "near_items"), 256).alias("near_items_sha256"),
    )
