"""Benchmark decontamination by SimHash windows and a multi-index over Hamming blocks.

Texts are lower-cased and split into runs of letters and digits.  For an item
of n words, every window of n words of a document that shares a five-word
shingle with some item is fingerprinted: a 64-bit SimHash of its words,
weighted by their number.  (A window that shares none has similarity 0, so
nothing is lost.)  Fingerprints are cut into four blocks of 16 bits; two that
differ in at most 15 bits have a block that differs in at most 3, so looking
up each block among all values within 3 bits of an item's finds every item
within the radius.  Candidates are then compared exactly: weighted Jaccard
similarity (sum of the smaller over sum of the larger counts) of five-word
shingles, at least 0.75.

The benchmark is cut into slices of bounded size that tasks load from the
shared folder one at a time; documents are read once and never shuffled.  A
text of any length is fingerprinted a stretch of words at a time, and only where
shingles were found.

Defined cases: null and empty texts and items match nothing; items of fewer
than five words match by their whole sequence; a document shorter than an item
is one window; repeated items and documents are each reported; ties go to the
smaller item id; an empty benchmark leaves all documents clean.
"""

from __future__ import annotations

import itertools
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from . import textvec as tv

RADIUS, BLOCKS, BITS = 15, 4, 16
NEAR = RADIUS // BLOCKS
#: Text bytes that are searched at once.
TEXT_BYTES = 4 << 20
#: Words whose running fingerprints are held at once.
RUN = 1 << 14
_MASKS = np.array([sum(1 << b for b in c) for r in range(NEAR + 1) for c in itertools.combinations(range(BITS), r)], np.uint16)
_LOADED: dict[str, "Slice"] = shared.kept("slices")


def words_of(column) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return tv.word_hashes(*tv.text_buffers(pc.utf8_lower(column.cast(pa.large_string()))), tv.ALNUM)


def signs(h: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of 64 bits of each word."""
    return (np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int8) * 2 - 1).astype(np.int32)


def fingerprint(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=-1, bitorder="little").view("<u8").reshape(sums.shape[:-1])


def summed(h: np.ndarray) -> np.ndarray:
    """The signs of all words, added up."""
    return sum((signs(h[at : at + RUN]).sum(axis=0, dtype=np.int64) for at in range(0, len(h), RUN)), np.zeros(64, np.int64))


def filled(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The numbers of all ranges from lo to before hi, range by range."""
    size = hi - lo
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - lo, size)


def windows(at: np.ndarray, shingle: int, size: int, words: int) -> np.ndarray:
    """Where windows of `size` words begin that hold one of the shingles at `at` (ascending, distinct)."""
    last = words - size
    lo, hi = np.clip(at - (size - shingle), 0, last), np.clip(at, 0, last) + 1
    lo[1:] = np.maximum(lo[1:], hi[:-1])
    return filled(lo, hi)


def fingers(w: np.ndarray, begin: np.ndarray, size: int):
    """Windows of `size` words that begin at `begin` (ascending) with their fingerprints, a stretch at a time.

    A stretch's first window is summed whole; the others differ from it by the
    words passed at either end.
    """
    new = np.flatnonzero((np.diff(begin, prepend=-size - 1) > size) | (np.diff(begin // RUN, prepend=-1) > 0))
    for lo, hi in zip(new.tolist(), [*new[1:].tolist(), len(begin)], strict=True):
        own, base = begin[lo:hi], int(begin[lo])
        span = int(own[-1]) - base
        change = np.zeros((span + 1, 64), np.int32)
        np.cumsum(signs(w[base + size : base + size + span]) - signs(w[base : base + span]), axis=0, out=change[1:])
        yield own, fingerprint(change[own - base] + summed(w[base : base + size]))


class Slice:
    """Some items, with the shingles and the Hamming blocks to find them by."""

    def __init__(self, ids: list, texts: list[str | None]):
        h, first = words_of(pa.array(texts, pa.string()))
        self.ids = ids
        self.words = [h[first[i] : first[i + 1]] for i in range(len(ids))]
        self.n = np.array([len(w) for w in self.words], np.int64)
        self.counts = [Counter(shingles_of(w)) for w in self.words]
        self.finger = np.array([fingerprint(summed(w)) if len(w) else 0 for w in self.words], np.uint64)
        some = self.n > 0
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k in sorted({min(int(n), tv.SHINGLE) for n in self.n[some]}):
            own = [i for i in np.flatnonzero(some).tolist() if min(self.n[i], tv.SHINGLE) == k]
            key = np.array([s for i in own for s in self.counts[i]], np.uint64)
            pairs = np.unique(np.stack([key, np.repeat(self.n[own], [len(self.counts[i]) for i in own]).astype(np.uint64)], axis=1), axis=0)
            self.by_size[k] = np.ascontiguousarray(pairs[:, 0]), pairs[:, 1].astype(np.int64)
        self.filters = {}
        for k, (key, _) in self.by_size.items():
            self.filters[k] = np.zeros(1 << 20, bool)
            self.filters[k][(key >> tv.U(44)).astype(np.int64)] = True
        who = np.flatnonzero(some)
        self.index = []
        for b in range(BLOCKS):
            value = ((self.finger[who] >> tv.U(BITS * b)) & tv.U(0xFFFF)).astype(np.uint16)
            near = (value[:, None] ^ _MASKS[None, :]).ravel()
            order = np.argsort(near, kind="stable")
            self.index.append((np.searchsorted(near[order], np.arange(65537)), np.repeat(who, len(_MASKS))[order]))

    def within(self, fingers: np.ndarray, size: int) -> np.ndarray:
        """(window, item of this size) pairs within the radius, in order."""
        found = [np.zeros((0, 2), np.int64)]
        for b in range(BLOCKS):
            at, items = self.index[b]
            v = ((fingers >> tv.U(BITS * b)) & tv.U(0xFFFF)).astype(np.int64)
            lo, hi = at[v], at[v + 1]
            w, i = np.repeat(np.arange(len(v)), hi - lo), items[filled(lo, hi)]
            ok = self.n[i] == size
            w, i = w[ok], i[ok]
            ok = np.bitwise_count(fingers[w] ^ self.finger[i]) <= RADIUS
            found.append(np.stack([w[ok], i[ok]], axis=1))
        return np.unique(np.concatenate(found), axis=0)

    def hits(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        """(text, size, word) wherever a text holds a shingle of an item of that size, in order and once each."""
        found = [np.zeros((0, 3), np.int64)]
        for k, (key, sizes) in self.by_size.items():
            for begin in range(0, len(h) - k + 1, TEXT_BYTES >> 3):
                near = h[begin : begin + (TEXT_BYTES >> 3) + k - 1]
                acc = np.full(len(near) - k + 1, k * 0x632BE59BD9B4E019 & ((1 << 64) - 1), dtype=np.uint64)
                for j in range(k):
                    acc += near[j : len(near) - k + 1 + j] * tv._COEF[j]
                acc = tv.mix(acc)
                some = np.flatnonzero(self.filters[k][(acc >> tv.U(44)).astype(np.int64)])
                at = begin + some
                lo, hi = np.searchsorted(key, acc[some], "left"), np.searchsorted(key, acc[some], "right")
                text = np.searchsorted(first, at, side="right") - 1
                ok = (hi > lo) & (at + k <= first[text + 1])
                text, at, lo, hi = text[ok], at[ok], lo[ok], hi[ok]
                found.append(np.stack([np.repeat(text, hi - lo), sizes[filled(lo, hi)], np.repeat(at - first[text], hi - lo)], axis=1))
        out = np.concatenate(found)
        return out[np.lexsort(out.T[::-1])]

    def matches(self, column, threshold: float) -> dict[int, dict[int, float]]:
        """For each text its items of at least the threshold, with the best similarity."""
        h, first = words_of(column)
        hits, found = self.hits(h, first), {}
        cut = np.flatnonzero(np.diff(hits[:, :2], axis=0, prepend=-1, append=-1).any(axis=1)).tolist() if len(hits) else []
        for lo, hi in itertools.pairwise(cut):
            t, n = hits[lo, :2].tolist()
            w = h[first[t] : first[t + 1]]
            size = min(n, len(w))
            for begin, prints in fingers(w, windows(hits[lo:hi, 2], min(n, tv.SHINGLE), size, len(w)), size):
                seen = None
                for x, i in self.within(prints, n).tolist():
                    if x != seen:
                        seen, own = x, Counter(shingles_of(w[begin[x] : begin[x] + size]))
                    b = self.counts[i]
                    both = sum(min(c, b[s]) for s, c in own.items() if s in b)
                    sim = both / (own.total() + b.total() - both)
                    if sim >= threshold:
                        best = found.setdefault(t, {})
                        best[i] = max(best.get(i, 0.0), sim)
        return found


def shingles_of(w: np.ndarray) -> list[int]:
    if not len(w):
        return []
    k = min(len(w), tv.SHINGLE)
    return tv.sequence_hash(w, np.arange(len(w) - k + 1), k).tolist()


def slices_of(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", items: int = 2048, size: int = 4 << 20) -> list[str]:
    """Writes the benchmark to the shared folder in slices of at most `items` items and about `size` bytes, each task its own, and returns their names."""
    folder = shared.fresh(benchmark.sparkSession, "benchmark")

    def cut(batches):
        from pyspark import TaskContext

        part, nth = TaskContext.get().partitionId(), 0
        for b in batches:
            for s in shared.slices(b, 1, size):
                for at in range(0, s.num_rows, items):
                    own, sink = s.slice(at, items), pa.BufferOutputStream()
                    with pa.ipc.new_file(sink, own.schema) as out:
                        out.write_batch(own)
                    file = f"{folder}/slice-{part:06d}-{nth:06d}.arrow"
                    shared.put_file(file, [sink.getvalue()])
                    nth += 1
                    yield pa.record_batch([pa.array([file])], ["file"])

    plain = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return sorted(r.file for r in shared.staged(plain.mapInArrow(shared.task(cut), "file string"), "benchmark-slices").collect())


def load(file: str) -> Slice:
    if file not in _LOADED:
        _LOADED.clear()
        fs, path = shared.open_shared(file)
        with fs.open_input_file(path) as f:
            own = pa.ipc.open_file(f).read_all()
        _LOADED[file] = Slice(own["id"].to_pylist(), own["text"].to_pylist())
    return _LOADED[file]


def _found(batch: pa.RecordBatch, column: int, files: list[str], threshold: float):
    """Cuts of a batch, each with its texts' items; a slice is loaded once for the whole batch."""
    cuts = list(shared.slices(batch, column, TEXT_BYTES))
    out: list[dict[int, list[tuple]]] = [{} for _ in cuts]
    for file in files:
        s = load(file)
        for cut, found in zip(cuts, out, strict=True):
            for t, own in s.matches(cut.column(column), threshold).items():
                found.setdefault(t, []).extend((-sim, s.ids[i] is None, s.ids[i] or 0, s.ids[i]) for i, sim in own.items())
    return zip(cuts, out, strict=True)


def report(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: contaminated, the number of items it holds, and the most similar of them."""
    files = slices_of(benchmark)
    schema = pa.schema([("doc_id", pa.int64()), ("contaminated", pa.bool_()), ("n_items", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64())])

    def each(batches):
        for batch in batches:
            for s, found in _found(batch, 1, files, threshold):
                rows = [min(found[t]) if t in found else None for t in range(s.num_rows)]
                yield pa.RecordBatch.from_arrays([s.column(0), pa.array([r is not None for r in rows]), pa.array([len(found.get(t, ())) for t in range(s.num_rows)], pa.int64()), pa.array([r and r[3] for r in rows], pa.int64()), pa.array([-r[0] if r else None for r in rows], pa.float64())], schema=schema)

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(shared.task(each, "slices"), "doc_id long, contaminated boolean, n_items long, item_id long, similarity double")


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.75, text_col: str = "text") -> DataFrame:
    """The documents that hold no item, with all their columns."""
    files, where = slices_of(benchmark), docs.columns.index(text_col)

    def each(batches):
        for batch in batches:
            for s, found in _found(batch, where, files, threshold):
                yield s.filter(pa.array([t not in found for t in range(s.num_rows)]))

    return docs.mapInArrow(shared.task(each, "slices"), docs.schema)
