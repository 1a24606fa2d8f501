"""Encoding whole texts through the tokenizers library, each distinct pre-token once.

``Encoder.pieces`` cuts the texts of an Arrow column into *pieces* where every pattern of the
vocabularies cuts too: before a blank, and between Latin letters, digits and marks.  The cuts are
found by numpy over the bytes of the column, and a piece is a view of them.  Arrow makes the
pieces of a batch distinct, a worker's cache of bounded size holds what is known of them, and
the ids of a text are gathered from those of its pieces.  A piece that isn't one plain pre-token goes to
the library as it stands; a text with unusual blanks or a special token's string is one
piece.  So the result is the library's own for any text.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers  # noqa: E402

#: Classes of bytes.
_LETTER, _DIGIT, _QUOTE, _MARK, _BLANK, _LINE, _OTHER = range(7)
_BY_CLASS = {_DIGIT: b"0123456789", _QUOTE: b"'", _BLANK: b" \t\r", _LINE: b"\n"}
_CLASS = np.array(
    [next((k for k, own in _BY_CLASS.items() if b in own), _LETTER if chr(b).isalpha() and b < 0x80 else _MARK if 0x20 < b < 0x7F else _OTHER) for b in range(256)], np.uint8
)
#: Whether a piece ends between a byte of one class and one of another (index: first class * 8 + second).
_CUT = np.zeros(64, bool)
for _a, _b in [
    *((a, b) for a in (_LETTER, _DIGIT, _QUOTE, _MARK, _OTHER) for b in (_BLANK, _LINE)),
    *((_LETTER, b) for b in (_DIGIT, _QUOTE, _MARK)), *((_DIGIT, b) for b in (_LETTER, _QUOTE, _MARK)), *((_MARK, b) for b in (_LETTER, _DIGIT)),
]:
    _CUT[_a * 8 + _b] = True
#: Blanks other than the four plain ones, for any engine's notion of a blank.
_OTHER_BLANKS = "\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u180e" + "".join(map(chr, range(0x2000, 0x200C))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
#: Their later bytes by their first.
_TAILS: dict[int, list[int]] = {}
for _c in _OTHER_BLANKS:
    _raw = _c.encode()
    _TAILS.setdefault(_raw[0], []).append(int.from_bytes(_raw[1:], "big"))
#: Pieces that are one pre-token, but for digits in a vocabulary that takes them one by one.
_PLAIN = re.compile(rb" ?(?:(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+|[!-/:-@\[-`{-~]+|([0-9]+))").fullmatch
#: Longer pieces are not kept: a cache of N entries stays small.
KEPT_BYTES = 48


def byte_table() -> dict[int, str]:
    """Byte to character of byte-level BPE: printable bytes stand for themselves, the rest for U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 token and rank on each line."""
    import base64

    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The merge list that a rank file implies: each token's last merge under the lower ranks."""
    merges = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) < 2:
            continue
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = min((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best >= rank:
                raise ValueError(f"rank {rank} can't be reached by merges")
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        merges.append((parts[0], parts[1]))
    return merges


def tokenizer_from_ranks(path: str, pattern: str) -> str:
    """The JSON of a tokenizers byte-level BPE for a rank file, splitting by ``pattern``."""
    ranks, table = load_ranks(path), byte_table()
    char = lambda token: "".join(table[b] for b in token)
    tok = Tokenizer(models.BPE(vocab={char(t): r for t, r in ranks.items()}, merges=[(char(a), char(b)) for a, b in merges_of(ranks)]))
    tok.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    tok.decoder = decoders.ByteLevel()
    return tok.to_str()


def texts_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its texts in them; null is an empty text."""
    col = col.fill_null("")
    offsets = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int32)
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


class Known:
    """What is known of pieces, in two generations of at most ``limit`` each: the older one goes when the younger is full."""

    def __init__(self, make: Callable[[bytes], object], limit: int):
        self.make, self.limit = make, limit
        self.young: dict[bytes, object] = {}
        self.old: dict[bytes, object] = {}

    def of(self, keys: list[bytes]) -> list:
        young, old, make = self.young, self.old, self.make
        out = list(map(young.get, keys))
        for i, got in enumerate(out):
            if got is None:
                key = keys[i]
                got = old.get(key)
                out[i] = got = make(key) if got is None else got
                if len(key) <= KEPT_BYTES:
                    young[key] = got
        if len(young) > self.limit:
            self.old, self.young = young, {}
        return out


class Encoder:
    """Texts to ids.

    tokenizer_json: of the tokenizers library.  lower: the vocabulary drops blanks,
    lower-cases and takes digits one by one.  ordinary: special tokens' strings are
    ordinary text.  kind: of the ids.  limit: pieces that each generation of the cache holds.
    """

    def __init__(self, tokenizer_json: str, kind: str = "<u4", *, lower: bool = False, ordinary: bool = False, limit: int = 400_000):
        self.tok = Tokenizer.from_str(tokenizer_json)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.tok.encode_special_tokens = ordinary
        self.special = [] if ordinary else [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.lower, self.kind, self.model = lower, np.dtype(kind), self.tok.model
        table = byte_table()
        self.chars, self.blank = [table[b] for b in range(256)], table[0x20]
        self.packed = Known(lambda piece: array(self.kind.char, self.ids(piece)).tobytes(), limit)
        self.counts = Known(lambda piece: len(self.ids(piece)), limit)

    def ids(self, piece: bytes) -> list[int]:
        """Ids of a piece; one pre-token is the model's to split, anything else the library's."""
        plain = _PLAIN(piece)
        if not plain or self.lower and plain.group(1) and len(plain.group(1)) > 1:
            return self.tok.encode(piece.decode(), add_special_tokens=False).ids
        if piece.isascii():  # these bytes stand for themselves, but for the blank
            char = piece.lstrip(b" ").lower().decode() if self.lower else f"{self.blank}{piece[1:].decode()}" if piece[:1] == b" " else piece.decode()
        else:
            raw = piece.lstrip(b" ").decode().lower().encode() if self.lower else piece
            char = raw.decode("latin-1").translate(self.chars)
        return [t.id for t in self.model.tokenize(char)]

    def _odd(self, col: pa.Array, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Numbers of the texts that are one piece."""
        at = []
        for lead, tails in _TAILS.items():
            found = np.flatnonzero(data == lead)
            if len(found) and lead >= 0x80:
                tail = data[found + 1].astype(np.int64)
                if lead >= 0xE0:
                    tail = tail << 8 | data[found + 2]
                found = found[np.isin(tail, tails)]
            at.append(found)
        odd = np.searchsorted(offsets, np.concatenate(at), "right") - 1
        for s in self.special:
            odd = np.append(odd, np.flatnonzero(np.asarray(pc.match_substring(col, s).fill_null(False))))
        return np.unique(odd)

    def pieces(self, col: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The pieces of all texts, and how many of them there are up to the end of each text."""
        data, offsets = texts_of(col)
        if not len(data):
            return pa.array([], pa.binary()), np.zeros(len(col), np.int64)
        kind = _CLASS[data]
        lead = np.flatnonzero(data == 0xC3)
        lead = lead[(data[lead + 1] & 0xDF) != 0x97]  # but for the signs of multiplication and division
        kind[lead] = kind[lead + 1] = _LETTER
        cut = np.ones(len(data) + 1, bool)
        cut[1:-1] = _CUT[kind[:-1] << 3 | kind[1:]]
        line = np.flatnonzero(kind == _LINE)  # a single line feed is a pre-token of its own
        line = line[(line > 0) & (line < len(data) - 1)]
        blank = (kind == _BLANK) | (kind == _LINE)
        cut[line[~blank[line - 1] & ~blank[line + 1]] + 1] = True
        for k in self._odd(col, data, offsets):
            cut[offsets[k] + 1 : offsets[k + 1]] = False
        cut[offsets] = True
        at = np.flatnonzero(cut).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)])
        return pieces, np.searchsorted(at, offsets[1:])

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order, and how many of them there are up to the end of each text."""
        pieces, ends = self.pieces(col)
        distinct = pieces.dictionary_encode()
        which = np.asarray(distinct.indices)
        packed = self.packed.of(distinct.dictionary.to_pylist())
        size = np.fromiter(map(len, packed), np.int64, len(packed)) // self.kind.itemsize
        flat = np.frombuffer(b"".join(packed), self.kind)
        many = size[which]
        stop = np.cumsum(many)
        shift = (np.cumsum(size) - size)[which] - (stop - many)
        return flat[np.repeat(shift, many) + np.arange(len(shift) and stop[-1])], np.concatenate(([0], stop))[ends]

    def count(self, col: pa.Array, table: pa.Array, lengths: np.ndarray) -> np.ndarray:
        """Numbers of ids of each text: pieces are looked up in the table, then in the worker's cache."""
        pieces, ends = self.pieces(col)
        hit = pc.index_in(pieces, value_set=table)
        missed = np.asarray(hit.is_null())
        many = np.zeros(len(pieces), np.int64)
        many[~missed] = lengths[np.asarray(hit.drop_null())]
        rest = pieces.filter(pa.array(missed)).dictionary_encode()
        if len(rest):
            many[missed] = np.array(self.counts.of(rest.dictionary.to_pylist()), np.int64)[np.asarray(rest.indices)]
        return np.diff(np.concatenate(([0], np.cumsum(many)))[ends], prepend=0)


_encoders: dict[tuple, Encoder] = {}


def encoder(key: tuple, make: Callable[[], Encoder]) -> Encoder:
    """The worker's encoder for these parameters; workers are reused, and so are their caches."""
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = make()
    return _encoders[key]


def binary_rows(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column: the bytes of the values up to each end."""
    values = np.ascontiguousarray(values)
    offsets = np.concatenate(([0], ends)).astype(np.int64) * values.dtype.itemsize
    whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(values)])
    return whole.cast(pa.binary())
