"""Vectorised word hashing over Arrow string batches.

Words are hashed with a polynomial over 2**64 on a random byte table and then
mixed; ASCII upper case folds to lower case inside the byte table, so texts
are never copied or lower-cased.  Every function works on whole texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_CHUNK = 1 << 16
_MASK = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)
SHINGLE = 5


def _powers(base: int) -> np.ndarray:
    out = np.full(_CHUNK + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out)


_POW, _INV = _powers(_P), _powers(_PINV)
_BYTES = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
EXACT = _BYTES.copy()  # tells upper from lower case
_BYTES[65:91] = _BYTES[97:123]
_COEF = np.random.default_rng(977).integers(1, 2**63, 64, dtype=np.uint64) * U(2) + U(1)

#: True for bytes of a word: everything but blank and tab to carriage return.
WORD = np.ones(256, dtype=bool)
WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: True for ASCII letters and digits and every byte of a non-ASCII character.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = True
ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64); makes its own copy."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def word_hashes(data: np.ndarray, offs: np.ndarray, word: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and for each text the index of its first word (with the total at the end)."""
    out, starts, _ = hashed_spans(data, offs, word, _BYTES)
    return out, np.searchsorted(starts, offs).astype(np.int64)


def hashed_spans(data: np.ndarray, offs: np.ndarray, word: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, begin and end of each word: a run of bytes of `word` inside a text, by the values of `table`."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = word[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offs[:-1][offs[:-1] < offs[1:]]
    first[cuts] = inside[cuts]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends_at = offs[1:][offs[:-1] < offs[1:]] - 1
    last[ends_at] = inside[ends_at]
    ends = np.flatnonzero(last) + 1
    out = np.zeros(len(starts), np.uint64)
    total = np.empty(_CHUNK + 1, np.uint64)
    total[0] = 0
    lo = np.searchsorted(starts, np.arange(0, n + _CHUNK, _CHUNK))
    carry, carried, open_word = 0, 0, -1
    for c, at in enumerate(range(0, n, _CHUNK)):
        part = data[at : at + _CHUNK]
        m = len(part)
        np.cumsum(table[part] * _POW[:m], out=total[1 : m + 1])
        if open_word >= 0:  # a word that began in an earlier chunk
            stop = min(int(ends[open_word]) - at, m)
            carry = (carry + int(total[stop]) * pow(_P, carried, 1 << 64)) & _MASK
            carried += stop
            if ends[open_word] <= at + m:
                out[open_word] = carry
                open_word = -1
        a, b = lo[c], lo[c + 1]
        if b > a and ends[b - 1] > at + m:
            b -= 1
            open_word, s = int(b), int(starts[b]) - at
            carry = ((int(total[m]) - int(total[s])) * int(_INV[s])) & _MASK
            carried = m - s
        s, e = starts[a:b] - at, ends[a:b] - at
        out[a:b] = (total[e] - total[s]) * _INV[s]
    out = mix(out + (ends - starts).astype(np.uint64) * U(0xC2B2AE3D27D4EB4F))
    return out, starts, ends


def sequence_hash(h: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Hash of the `length` words from each start."""
    acc = np.full(len(starts), length * 0x632BE59BD9B4E019 & _MASK, dtype=np.uint64)
    for j in range(length):
        acc += h[starts + j] * _COEF[j]
    return mix(acc)


def shingles(h: np.ndarray, first: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k-word shingles of each text in order, and each text's first index among them.

    A text of fewer than k words has its whole sequence as one shingle, an
    empty text none.
    """
    count = np.diff(first)
    n_sh = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(n_sh)])
    out = np.zeros(at[-1], np.uint64)
    if len(h) >= k:
        acc = np.full(len(h) - k + 1, k * 0x632BE59BD9B4E019 & _MASK, dtype=np.uint64)
        for j in range(k):
            acc += h[j : len(h) - k + 1 + j] * _COEF[j]
        acc = mix(acc)
        long = count >= k
        ok = np.zeros(len(h) + 1, np.int32)
        np.add.at(ok, first[:-1][long], 1)
        np.add.at(ok, first[:-1][long] + n_sh[long], -1)
        inside = np.cumsum(ok[: len(acc)]) > 0
        where = np.repeat(long, n_sh)
        out[where] = acc[inside]
    for m in range(1, k):
        short = count == m
        if short.any():
            out[at[:-1][short]] = sequence_hash(h, first[:-1][short], m)
    return out, at


def distinct_per_text(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each text."""
    parts, sizes = [], np.zeros(len(at) - 1, np.int64)
    for i in range(len(at) - 1):
        x = values[at[i] : at[i + 1]]
        if len(x) > 1:
            x = np.sort(x)
            keep = np.empty(len(x), bool)
            keep[0] = True
            np.not_equal(x[1:], x[:-1], out=keep[1:])
            x = x[keep]
        sizes[i] = len(x)
        parts.append(x)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])
