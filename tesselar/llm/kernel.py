"""Vectorised text kernels: whole Arrow string buffers are cut into words and hashed by numpy, never word by word.

Words are maximal runs of ASCII letters, digits and non-ASCII characters; ASCII letters are folded to lower case. The
punctuation and blanks of Latin-1, of the general and of the East Asian blocks end a word, and each character of a script
that is written without blanks (Chinese, Japanese, Thai) is a word. A word's hash is a polynomial over its bytes modulo
2**64, found from prefix sums, so its cost doesn't depend on its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BLOCK = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))

FOLD = np.zeros(256, np.uint8)
for _c in range(256):
    if _c >= 0x80 or chr(_c).isalnum():
        FOLD[_c] = ord(chr(_c).lower()) if _c < 0x80 else _c

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the base and of its inverse."""
    if len(_powers[0]) < n:
        size = max(n, _BLOCK + 4096)
        for k, base in enumerate((_BASE, _BASE_INV)):
            full = np.full(size, base, np.uint64)
            full[0] = 1
            _powers[k] = np.multiply.accumulate(full)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string or binary column without a copy; a null is an empty text."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return offs, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of whole rows of about `most` bytes of text; one longer text is a run by itself."""
    for batch in batches:
        offs, _ = buffers(batch.column(column))
        n, at = batch.num_rows, 0
        while at < n:
            to = int(np.searchsorted(offs, offs[at] + most, "right")) - 1
            to = min(n, max(to, at + 1))
            yield batch.slice(at, to - at)
            at = to


def _marks() -> tuple[np.ndarray, np.ndarray]:
    """For the first two bytes of a character: whether it ends words; for the third after those of fullwidth forms."""
    two, wide = np.zeros(1 << 16, bool), np.zeros(1 << 16, bool)
    for b in range(0x80, 0xC0):
        # Latin-1: all but the ordinals, micro, superscript digits and fractions.
        two[0xC2 << 8 | b] = b not in (0xAA, 0xB2, 0xB3, 0xB5, 0xB9, 0xBA, 0xBC, 0xBD, 0xBE)
    two[[0xE280, 0xE281, 0xE380]] = True
    for cp in (*range(0xFF01, 0xFF10), *range(0xFF1A, 0xFF21), *range(0xFF3B, 0xFF41), *range(0xFF5B, 0xFF66)):
        raw = chr(cp).encode()
        wide[raw[1] << 8 | raw[2]] = True
    return two, wide


_ENDS, _WIDE = _marks()


def _characters(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of characters that end words, where characters that are words by themselves begin and end) in UTF-8 bytes."""
    at = np.flatnonzero(raw >= 0xC2)
    at = at[at + 1 < len(raw)]
    lead, pair = raw[at], raw[at].astype(np.int64) << 8 | raw[at + 1]
    size = 2 + (lead >= 0xE0) + (lead >= 0xF0)
    ends = _ENDS[pair]
    wide = np.flatnonzero((lead == 0xEF) & (at + 2 < len(raw)))
    ends[wide] = _WIDE[raw[at[wide] + 1].astype(np.int64) << 8 | raw[at[wide] + 2]]
    # Kana and ideographs, Thai, the ideographs beyond the first plane.
    alone = ~ends & ((lead >= 0xE3) & (lead <= 0xE9) | (pair == 0xE0B8) | (pair == 0xE0B9) | (pair >= 0xF0A0) & (pair <= 0xF0AF))
    gone = np.concatenate([at[ends], at[ends] + 1, at[ends & (size > 2)] + 2])
    return gone, np.concatenate([at[alone], at[alone] + size[alone]])


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of its first word for each text plus the total), in order."""
    offs, data = buffers(column)
    lo, hi = int(offs[0]), int(offs[-1])
    edges = np.unique(offs)
    hashes, begins = [], []
    at = lo
    while at < hi:
        to = min(at + _BLOCK, hi)
        while to < hi and FOLD[data[to - 1]] and FOLD[data[to]]:
            k = int(np.searchsorted(edges, to, "left"))
            stop = int(edges[k]) if k < len(edges) else hi
            run = np.flatnonzero(FOLD[data[to : min(stop, to + _BLOCK)]] == 0)
            if len(run):
                to += int(run[0])
            else:
                to = min(stop, to + _BLOCK)
                if to == stop:
                    break
        w = FOLD[data[at:to]]
        inside = w > 0
        cut = np.zeros(to - at + 1, bool)
        a, b = np.searchsorted(edges, [at, to])
        cut[edges[a:b] - at] = True
        cut[0] = cut[-1] = True
        gone, borders = _characters(data[at:to])
        inside[gone[gone < to - at]] = False
        cut[borders[borders < to - at]] = True
        before = np.empty(to - at + 1, bool)
        before[0] = False
        before[1:] = inside
        here = np.empty(to - at + 1, bool)
        here[-1] = False
        here[:-1] = inside
        start = np.flatnonzero(here & (~before | cut))
        end = np.flatnonzero(before & (~here | cut))
        pw, inv = powers(to - at + 1)
        total = np.zeros(to - at + 1, np.uint64)
        np.cumsum(w * pw[: to - at], out=total[1:])
        hashes.append(mix((total[end] - total[start]) * inv[start]))
        begins.append(start + at)
        at = to
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    where = np.concatenate(begins)
    return np.concatenate(hashes), np.searchsorted(where, offs, "left")


def grams(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of the runs of n words within each text, in order; a shorter text that has words is one run."""
    lengths = np.diff(first)
    of = np.repeat(np.arange(len(lengths)), lengths)
    if not len(h):
        return h, of
    m = len(h) - n + 1
    if m > 0:
        g = h[:m].copy()
        for k in range(1, n):
            g *= np.uint64(0xD6E8FEB86659FD93)
            g += h[k : k + m]
        whole = of[:m] == of[n - 1 :]
        g, doc = mix(g[whole]), of[:m][whole]
    else:
        g, doc = np.zeros(0, np.uint64), np.zeros(0, of.dtype)
    small = np.flatnonzero((lengths > 0) & (lengths < n))
    if len(small):
        extra = []
        for k in small:
            x = 0
            for t in h[first[k] : first[k + 1]].tolist():
                x = (x * 0xD6E8FEB86659FD93 + t) & 0xFFFFFFFFFFFFFFFF
            extra.append(x)
        g, doc = np.concatenate([g, mix(np.array(extra, np.uint64))]), np.concatenate([doc, small])
        order = np.argsort(doc, kind="stable")
        g, doc = g[order], doc[order]
    return g, doc


def bounds(doc: np.ndarray, n: int) -> np.ndarray:
    """First index of each of the n texts in the ascending doc, and the total."""
    return np.searchsorted(doc, np.arange(n + 1), "left")


def distinct(bucket: np.ndarray, doc: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (doc, bucket) pairs as (bucket, doc), by text; buckets have at most `bits` bits."""
    key = np.sort((doc.astype(np.uint64) << np.uint64(bits)) | bucket.astype(np.uint64))
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return (key & np.uint64((1 << bits) - 1)).astype(np.int64), (key >> np.uint64(bits)).astype(np.int64)


def counts_per(doc: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sum of values by text."""
    return np.bincount(doc, weights=values, minlength=n)
