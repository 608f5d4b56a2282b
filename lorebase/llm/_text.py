"""Words, shingles and crc32 folds of whole Arrow batches in numpy.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, A-Z lower-cased unless another fold is given; in UTF-8 that equals the same
rule on characters. Hashes are polynomials over random 64-bit byte values modulo 2**64 with a final mix, so they
depend on the text alone and agree between tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: For words that are told apart by case.
SAME = np.arange(256, dtype=np.uint8)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes of text that are worked on at once (a longer text is worked on alone).
CHUNK = 1 << 20
_powers: list[np.ndarray] = [np.empty(0, _U), np.empty(0, _U)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = max(1 << 14, 1 << (n - 1).bit_length())
        for i, base in enumerate((_BASE, _INV)):
            steps = np.full(n, base, _U)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=_U)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


def chunks(texts: pa.Array, limit: int = CHUNK):
    """(first row, row offsets, bytes) of runs of rows of a string array; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield a, off[a : b + 1] - off[a], data[off[a] : off[b]]
        a = b


def _pieces(off: np.ndarray, data: np.ndarray, fold: np.ndarray = LOWER):
    """(starts, raw hashes, lengths, whether the first word goes on from the piece before) of at most CHUNK bytes each."""
    n = len(data)
    begins = off[:-1][off[:-1] < off[1:]]
    for p in range(0, n, CHUNK):
        part = data[p : p + CHUNK]
        m = len(part)
        solid = ~_SPACE[part]
        own = begins[np.searchsorted(begins, p) : np.searchsorted(begins, p + m)] - p
        before = np.empty(m, bool)
        before[0] = False
        before[1:] = solid[:-1]
        before[own] = False
        starts = np.flatnonzero(solid & ~before)
        after = np.empty(m, bool)
        after[-1] = False
        after[:-1] = solid[1:]
        after[own[own > 0] - 1] = False
        ends = np.flatnonzero(solid & ~after) + 1
        up, down = _power(m)
        sums = np.zeros(m + 1, _U)
        np.cumsum(_BYTE[fold[part]] * up[:m], out=sums[1:])
        on = bool(p and solid[0] and not _SPACE[data[p - 1]] and not (len(own) and own[0] == 0))
        yield starts + p, (sums[ends] - sums[starts]) * down[starts], ends - starts, on


def word_hashes(off: np.ndarray, data: np.ndarray, fold: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and where each row's words begin among them (with the end).

    Long texts are worked on in pieces; a word that goes over from one piece to the next is put together.
    """
    starts, hashes = [np.empty(0, np.int64)], [np.empty(0, _U)]
    length = 0  # of the last word so far
    with np.errstate(over="ignore"):
        for at, raw, size, on in _pieces(off, data, fold):
            if on:
                hashes[-1][-1] += raw[0] * _U(pow(_BASE, length, 1 << 64))
                length = length + int(size[0]) if len(at) == 1 else int(size[-1])
                at, raw = at[1:], raw[1:]
            elif len(at):
                length = int(size[-1])
            if len(at):
                starts.append(at)
                hashes.append(raw)
        return mix(np.concatenate(hashes)), np.searchsorted(np.concatenate(starts), off)


def shingle_sets(off: np.ndarray, data: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingle hashes of each row, end to end, and the row offsets.

    A row with 1 to k - 1 words has its whole sequence as its one shingle; one without words has none.
    """
    words, first = word_hashes(off, data)
    count = np.diff(first)
    if not len(words):
        return words, np.zeros(len(off), np.int64)
    with np.errstate(over="ignore"):
        h = np.zeros(max(0, len(words) - k + 1), _U)
        for j in range(k):
            h *= _U(_BASE)
            h += words[j : len(words) - k + 1 + j]
        h = mix(h)
        parts, sizes = [], np.zeros(len(count), np.int64)
        for i in range(len(count)):
            c, f = int(count[i]), int(first[i])
            if c >= k:
                s = h[f : f + c - k + 1]
                s.sort()
                if len(s) > 1:
                    new = s[1:] != s[:-1]
                    if not new.all():
                        s = s[np.concatenate(([True], new))]
            elif c:
                v = 0
                for w in words[f : f + c]:
                    v = (v * _BASE + int(w)) & ((1 << 64) - 1)
                s = mix(np.array([v ^ (c * 0x5851F42D4C957F2D & ((1 << 64) - 1))], _U))
            else:
                continue
            parts.append(s)
            sizes[i] = len(s)
    return (np.concatenate(parts) if parts else words[:0]), np.concatenate(([0], np.cumsum(sizes)))
