"""Periodic runs of words, by internal pattern matching.

A run is a stretch of words with smallest period q and at least max(``MIN_WORDS``,
``MIN_EXPONENT`` * q) words that no neighbouring word extends.  Within one batch of texts:

* a suffix array of the words of each text comes from prefix doubling, whose round k names
  every stretch of 2^k words by its suffix array interval; only stretches that are not yet
  unique in their text are sorted again;
* a wavelet matrix over the suffix array answers range successor queries: the next, or
  previous, place of a dyadic block (2^k words from a multiple of 2^k) in the window of 2^k
  words beside it.  Places of a block in such a window are a progression whose difference
  is the block's period, so its first step is a candidate period;
* names of stretches extend each candidate to both sides (longest common extensions), and
  what is long enough is a run.

A run of period q with 2^(k-1) < q <= 2^k holds a dyadic block of 2^k words whose next or
previous place, q words off, lies in the run too; a shorter step within the run would give it a smaller
period.  So no run is missed, and a candidate that is no smallest period extends to the run of
the smallest one and is dropped there.

Work and memory follow the words of a batch times the logarithm of its longest repeat.  A batch
is about 1 MB of texts, or one longer text as a whole.  Nothing is shuffled: a lost executor
costs the tasks it held.

Null and empty texts have no words, so no runs.  Rows are read one by one: repeated rows give
repeated results, extra columns are not read, a null id comes back null, and an empty
table gives an empty table.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

MIN_WORDS, MIN_EXPONENT = 6, 4

#: Of a row's id and its words, the places of the words to read in their stead; None: as they stand.
Rewrite = Callable[[int | None, int], np.ndarray | None]


def suffix_levels(codes: np.ndarray, text: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[tuple[np.ndarray, np.ndarray]]]:
    """The suffix array of texts that lie one after another; for each level k the name (the first place of the
    suffix array interval) of the 2^k words from each word on, and the dyadic blocks that recur, with the sizes of their intervals.

    codes: a number of each word; text: the number of its text, ascending; start and end: those of the text, for each word.
    Stretches that cross a text's end have names of their own.
    """
    n = len(codes)
    inner = np.arange(n, dtype=np.int32) - start  # places within their text
    blocks: list[tuple[np.ndarray, np.ndarray]] = []

    def dyadic(size: np.ndarray) -> None:
        k = len(blocks)
        # a run shows at least so many places of its block: all its words for period 1, three for 2, else two
        least = MIN_WORDS if k == 0 else 3 if k == 1 else 2
        block = np.flatnonzero((size >= least) & (inner & ((1 << k) - 1) == 0))
        blocks.append((block, size[block]))

    order = np.lexsort((codes, text))
    fresh = np.ones(n, bool)
    fresh[1:] = (np.diff(codes[order]) != 0) | (np.diff(text[order]) != 0)
    at = np.flatnonzero(fresh)
    sizes = np.diff(np.append(at, n))
    name, size = np.empty(n, np.int32), np.empty(n, np.int32)
    name[order], size[order] = np.repeat(at, sizes), np.repeat(sizes, sizes)
    names, step = [name], 1
    dyadic(size)
    while True:
        open_ = np.flatnonzero(size[order] > 1)  # places whose interval holds others
        if not len(open_):
            return order, names, blocks
        words = order[open_]
        after = words + step
        second = np.where(after < end[words], name[np.minimum(after, n - 1)], -1)
        first = name[words]
        by = np.lexsort((second, first))
        words, first, second = words[by], first[by], second[by]
        order[open_] = words
        fresh = np.ones(len(words), bool)
        fresh[1:] = (np.diff(first) != 0) | (np.diff(second) != 0)
        fresh |= second < 0  # a stretch that its text's end cuts short is alone
        at = np.flatnonzero(fresh)
        sizes = np.diff(np.append(at, len(words)))
        name = name.copy()
        name[words], size[words] = np.repeat(open_[at], sizes), np.repeat(sizes, sizes)
        names.append(name)
        dyadic(size)
        step *= 2


class WaveletMatrix:
    """Range rank and range selection over an array of numbers from 0."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(values.max(initial=0)).bit_length())
        self.ones: list[np.ndarray] = []  # ones before each place, by bit from the highest
        self.zeros: list[int] = []
        for b in range(self.bits - 1, -1, -1):
            bit = (values >> b & 1).astype(bool)
            self.ones.append(np.concatenate((np.zeros(1, np.int32), np.cumsum(bit, dtype=np.int32))))
            self.zeros.append(len(values) - int(self.ones[-1][-1]))
            values = np.concatenate((values[~bit], values[bit]))

    def less(self, low: np.ndarray, high: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many of the values in [low, high) are less than x."""
        out = np.where(x >> self.bits > 0, high - low, 0)
        for k, b in enumerate(range(self.bits - 1, -1, -1)):
            one_low, one_high = self.ones[k][low], self.ones[k][high]
            up = (x >> b & 1).astype(bool)
            out += np.where(up, (high - low) - (one_high - one_low), 0) * (x >> self.bits == 0)
            low, high = np.where(up, self.zeros[k] + one_low, low - one_low), np.where(up, self.zeros[k] + one_high, high - one_high)
        return out

    def nth(self, low: np.ndarray, high: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The n-th smallest, from 0, of the values in [low, high); n has to be in the range."""
        out = np.zeros_like(n)
        for k, b in enumerate(range(self.bits - 1, -1, -1)):
            one_low, one_high = self.ones[k][low], self.ones[k][high]
            zeros = (high - low) - (one_high - one_low)
            up = n >= zeros
            out |= up.astype(out.dtype) << b
            n = np.where(up, n - zeros, n)
            low, high = np.where(up, self.zeros[k] + one_low, low - one_low), np.where(up, self.zeros[k] + one_high, high - one_high)
        return out

    def neighbours(self, low: np.ndarray, high: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest value below and the smallest value above x in [low, high), which holds x once; -1: none."""
        rank = self.less(low, high, x)
        before, after = np.full_like(x, -1), np.full_like(x, -1)
        has = np.flatnonzero(rank > 0)
        before[has] = self.nth(low[has], high[has], rank[has] - 1)
        has = np.flatnonzero(rank + 1 < high - low)
        after[has] = self.nth(low[has], high[has], rank[has] + 1)
        return before, after


def _candidates(order: np.ndarray, names: list[np.ndarray], blocks: list[tuple[np.ndarray, np.ndarray]], start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places i and periods p such that the words from i and from i + p on agree for a while: first steps of the blocks' progressions."""
    inner = np.arange(len(order), dtype=np.int32) - start
    matrix = None
    places, periods = [], []
    for k, (name, (block, count)) in enumerate(zip(names, blocks, strict=True)):
        if not len(block):
            continue
        m = 1 << k
        matrix = matrix or WaveletMatrix(inner[order])
        low = name[block]
        before, after = matrix.neighbours(low, low + count, inner[block])
        for other, ahead in ((after, True), (before, False)):
            step = np.where(other >= 0, np.abs(other - inner[block]), 0)
            good = np.flatnonzero((step <= m) & (step > m // 2))  # smaller steps are found at smaller blocks
            places.append(block[good] - (0 if ahead else step[good]))
            periods.append(step[good])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(places).astype(np.int64), np.concatenate(periods).astype(np.int64)


def _agreement(names: list[np.ndarray], i: np.ndarray, j: np.ndarray, low: np.ndarray, high: np.ndarray, ahead: bool) -> np.ndarray:
    """How many words agree from i and j (i < j) on, or before them; low and high bound the text."""
    total = np.zeros_like(i)
    for k in range(len(names) - 1, -1, -1):
        m = 1 << k
        while True:  # a level holds at most twice, but the top one
            a, b = (i + total, j + total) if ahead else (i - total - m, j - total - m)
            inside = (b + m <= high) if ahead else (a >= low)
            same = inside.copy()
            same[inside] = names[k][a[inside]] == names[k][b[inside]]
            if not same.any():
                break
            total += same * m
    return total


def find(codes: np.ndarray, text: np.ndarray, min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT) -> np.ndarray:
    """Rows (text, start, length, period) of all runs, by text, start and period; start counts within the text.

    min_words and min_exponent may be raised; below ``MIN_WORDS`` and ``MIN_EXPONENT`` the search is not complete.
    """
    none = np.zeros((0, 4), np.int64)
    if len(codes) < min_words:
        return none
    start, end = np.searchsorted(text, text, "left").astype(np.int32), np.searchsorted(text, text, "right").astype(np.int32)
    order, names, blocks = suffix_levels(codes, text, start, end)
    i, p = _candidates(order, names, blocks, start)
    if not len(i):
        return none
    low, high = start[i].astype(np.int64), end[i].astype(np.int64)
    right = _agreement(names, i, i + p, low, high, True)
    left = _agreement(names, i, i + p, low, high, False)
    length = left + p + right
    good = length >= np.maximum(min_words, min_exponent * p)
    first = i[good] - left[good]
    found = np.stack((text[i[good]].astype(np.int64), first - low[good], length[good], p[good]), 1)
    found = np.unique(found, axis=0)  # by text, start, length, period
    smallest = np.ones(len(found), bool)
    smallest[1:] = (np.diff(found[:, :3], axis=0) != 0).any(1)
    found = found[smallest]
    return found[np.lexsort((found[:, 3], found[:, 1], found[:, 0]))]


def _batch(ids: list, texts: list, rewrite: Rewrite | None) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """The words of each text as they are read, the runs, and where the runs of each text begin among them."""
    words = [t.encode("utf-8", "replace").split() if t else [] for t in texts]
    if rewrite:
        for k, (d, w) in enumerate(zip(ids, words, strict=True)):
            at = rewrite(d, len(w))
            if at is not None:
                words[k] = [w[x] for x in at.tolist()]
    text = np.repeat(np.arange(len(words), dtype=np.int32), [len(w) for w in words])
    codes = pa.array([x for w in words for x in w], pa.large_binary()).dictionary_encode().indices.to_numpy()
    found = find(codes, text)
    return words, found, np.searchsorted(found[:, 0], np.arange(len(words) + 1))


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The text without the words of each run after its first period, joined by one space; runs: rows (start, length, period)."""
    if not len(runs):
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return b" ".join(words[k] for k in np.flatnonzero(np.cumsum(edge)[:-1] == 0).tolist())


def _rows(rewrite: Rewrite | None, keep_text: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ids = b.column("doc_id").to_pylist()
            words, found, at = _batch(ids, b.column("text").to_pylist(), rewrite)
            lists, texts, digests = [], [], []
            for k, w in enumerate(words):
                own = found[at[k] : at[k + 1], 1:]
                lists.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in own.tolist()])
                text = collapsed(w, own)
                digests.append(hashlib.sha256(text).hexdigest())
                texts.append(text.decode("utf-8") if keep_text else None)
            columns = [b.column("doc_id"), pa.array(list(map(len, words)), pa.int64()), pa.array(lists, pa.list_(run)), pa.array(texts, pa.string()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed", "collapsed_sha256"])

    return rows


def runs(docs: DataFrame, rewrite: Rewrite | None = None, keep_text: bool = True) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period, by start and period), collapsed (null without keep_text) and its sha256."""
    schema = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string, collapsed_sha256 string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_rows(rewrite, keep_text), schema)


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """The periodic tail that every tenth id (by crc32 of the id as text) gets; a null id gets none."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def digests(found: DataFrame) -> DataFrame:
    """For each row the number of runs, the longest run (ties: smallest start, then period) and digests of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    out = found.withColumn("best", best).withColumn("lines", F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""))
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).cast("long").alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"), "collapsed_sha256",
    )
