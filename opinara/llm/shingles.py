"""Word shingles of whole texts as 64-bit hashes, vectorised over the bytes of an Arrow batch.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, which on UTF-8 bytes needs no decoding.  A word's
hash is a polynomial over randomised byte values read off prefix sums; a shingle's hash combines its words
by position.  Two different shingles share a hash with a chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

WORDS = 5
#: Bytes of text that are hashed at once (a longer document is hashed alone, whole).
CHUNK_BYTES = 1 << 19
#: Bytes of one text that are hashed at once.
SLICE_BYTES = 1 << 22

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE_VALUE = mix(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95))
_PLACE = mix(np.arange(1, 65, dtype=_U) * _U(0xA0761D6478BD642F)) | _U(1)


@lru_cache(maxsize=2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n, inverse = 1 << bits, pow(_BASE, -1, 1 << 64)
    up = np.cumprod(np.concatenate([[_U(1)], np.full(n, _U(_BASE))]), dtype=_U)
    down = np.cumprod(np.concatenate([[_U(1)], np.full(n, _U(inverse))]), dtype=_U)
    return up, down


def string_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of an Arrow string array; nulls become empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column, "").cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw, at


def from_texts(texts) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of Python strings; None becomes empty."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    return np.frombuffer(b"".join(parts), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)]).astype(np.int64)


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of whole documents of about ``most`` bytes."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in text order, and the document (index) of each.

    Long texts are read in slices of about ``SLICE_BYTES`` that end between words, so memory stays bounded.
    """
    begin, end = int(offsets[0]), int(offsets[-1])
    hashes, places = [np.empty(0, _U)], [np.empty(0, np.int64)]
    while begin < end:
        stop = min(end, begin + SLICE_BYTES)
        while stop < end:  # to the next blank: a word is not cut
            gap = np.flatnonzero(_SPACE[raw[stop : stop + 65536]])
            if len(gap):
                stop += int(gap[0])
                break
            stop = min(end, stop + 65536)
        within = offsets[(offsets > begin) & (offsets < stop)] - begin
        found, starts = _slice_hashes(raw[begin:stop], within)
        hashes.append(found)
        places.append(starts + begin)
        begin = stop
    return np.concatenate(hashes), np.searchsorted(offsets, np.concatenate(places), "right") - 1


def _slice_hashes(raw: np.ndarray, within: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the words of some bytes; documents begin at the places ``within``."""
    data = _LOWER[raw]
    inside = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[[0, len(data)]] = True
    cut[within] = True
    before = np.empty(len(data), dtype=bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.empty(len(data), dtype=bool)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    up, down = _powers(max(16, int(len(data)).bit_length()))
    sums = np.zeros(len(data) + 1, dtype=_U)
    np.cumsum(_BYTE_VALUE[data] * up[: len(data)], dtype=_U, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts]), starts


def shingle_hashes(raw: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of each document, distinct and ascending, end to end; and their counts.

    A document with fewer words than ``words`` has its whole sequence as one shingle; without words, none.
    """
    hashes, owner = word_hashes(raw, offsets)
    docs = len(offsets) - 1
    per_doc = np.bincount(owner, minlength=docs)
    first = np.concatenate([[0], np.cumsum(per_doc)])
    n = len(hashes) - words + 1
    full = np.empty(0, _U)
    if n > 0:
        full = hashes[:n] * _PLACE[0]
        for k in range(1, words):
            full += hashes[k : k + n] * _PLACE[k]
        full = mix(full)
    out, counts = [], np.zeros(docs, dtype=np.int64)
    for d in range(docs):
        a, w = int(first[d]), int(per_doc[d])
        if w >= words:
            got = np.sort(full[a : a + w - words + 1])
            if len(got) > 1:
                keep = np.empty(len(got), dtype=bool)
                keep[0] = True
                np.not_equal(got[1:], got[:-1], out=keep[1:])
                got = got[keep]
        elif w:
            got = mix((hashes[a : a + w] * _PLACE[:w]).sum(dtype=_U, keepdims=True) + _U(w))
        else:
            continue
        counts[d] = len(got)
        out.append(got)
    return np.concatenate(out) if out else np.empty(0, _U), counts


def set_keys(flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A 128-bit key (two columns) of each document's set; equal sets have equal keys."""
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    keys = np.zeros((len(counts), 2), dtype=_U)
    some = counts > 0
    if some.any():
        for c, salt in enumerate((0x51ED270B0A1F39C1, 0x2545F4914F6CDD1D)):
            keys[some, c] = np.add.reduceat(mix(flat + _U(salt)), first[some])
    return keys


def jaccard_counts(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sizes of intersection and union of two ascending, distinct arrays."""
    if not len(a) or not len(b):
        return 0, len(a) + len(b)
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    common = int((b[at] == a).sum())
    return common, len(a) + len(b) - common
