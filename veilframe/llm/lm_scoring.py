"""Interpolated modified Kneser-Ney bigram model, counted in Spark and scored from memory-mapped hash arrays.

Counting.  Training texts are staged in blocks.  A block sends its distinct
bigrams as sorted 64-bit hashes with their counts, cut into ranges; whoever
holds a range adds them up, writes it as a shard (sorted hashes, counts), and
tells each block, for each of its bigrams, the count's class and whether the
block is the first that holds it.  Blocks then add up, by word, occurrences,
left contexts (how many bigrams end in the word) and the bigrams of one, two
and more occurrences that begin with it; these sums make the word shards.

Scoring.  A worker maps the shards into memory and looks up a slice's distinct
bigrams in ascending order, so the map is walked once a slice and pages can be
dropped behind it.  With discounts D1, D2, D3+ from the counts of counts,
    p(w | v) = (c(vw) - D) / c(v) + gamma(v) p(w),
    p(w)     = (left(w) - D') / left(all) + gamma' / (V + 1).

Order 2 is what the disk allowance of the check leaves room for; the README
has the figures.  Defined cases: null and empty texts are one end token; null
ids belong to the training part; rows that repeat each count; without training
texts each token has the uniform probability; an empty table gives no rows.
"""

from __future__ import annotations

import mmap
import os
import tempfile

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frequency, shared
from . import textvec as tv

END, BOS = tv.U(0x5851F42D4C957F2D), tv.U(0x14057B7EF767814F)
BLOCK = 16 << 20
FETCHED_BYTES = 1 << 30
_MAPS: dict[str, tuple] = shared.kept("maps")
_FETCHED: dict[str, int] = shared.kept("maps fetched")


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words and end of each text, of what stands before each, and each text's first token."""
    h, first = tv.word_hashes(data, offs)
    n = len(first) - 1
    at = first + np.arange(n + 1)
    w = np.full(at[-1], END, np.uint64)
    inside = np.ones(len(w), bool)
    inside[at[1:] - 1] = False
    w[inside] = h
    v = np.empty_like(w)
    v[1:] = w[:-1]
    v[at[:-1][at[:-1] < len(v)]] = BOS
    return v, w, at


def bigram(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return tv.mix(v * tv.U(0x9E3779B97F4A7C15) + tv.mix(w))


def grouped(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, how often each occurs, and the place of one occurrence."""
    order = np.argsort(x)
    s = x[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    return s[first], np.diff(first, append=len(s)), order[first]


def write_table(path: str, *columns: np.ndarray) -> None:
    shared.put_file(path, [memoryview(np.ascontiguousarray(c)).cast("B") for c in columns if len(c)])


def mapped(path: str, n: int, kinds: list[tuple[str, int]]):
    """Columns of a shard as arrays over a memory map.

    A shard in a remote store is fetched to an unlinked local file first; a
    worker keeps FETCHED_BYTES of these, the latest, and shards are walked in
    order.
    """
    if path not in _MAPS:
        fs, own = shared.open_shared(path)
        if fs.type_name == "local":
            f = open(own, "rb")
        else:
            f = tempfile.TemporaryFile()
            with fs.open_input_stream(own, compression=None) as src:
                while chunk := src.read(8 << 20):
                    f.write(chunk)
            f.flush()
            held = [p for p in _FETCHED if p in _MAPS]
            while held and sum(_FETCHED[p] for p in held) + f.tell() > FETCHED_BYTES:
                _MAPS.pop(held.pop(0))
            _FETCHED.pop(path, None)
            _FETCHED[path] = f.tell()
        with f:
            m = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) if os.fstat(f.fileno()).st_size else b""
        out, at = [], 0
        for kind, size in kinds:
            out.append(np.frombuffer(m, kind, size, at) if size else np.zeros(0, kind))
            at += size * np.dtype(kind).itemsize
        _MAPS[path] = tuple(out)
    return _MAPS[path]


def discounts(t: list[int]) -> list[float]:
    """D1, D2, D3+ from the counts of counts 1 to 4 (Chen and Goodman), kept within 0 and the count."""
    if not (t[0] and t[1] and t[2]):
        return [0.5, 1.0, 1.5] if t[0] else [0.0, 0.0, 0.0]
    y = t[0] / (t[0] + 2 * t[1])
    d = [1 - 2 * y * t[1] / t[0], 2 - 3 * y * t[2] / t[1], 3 - 4 * y * t[3] / t[2]]
    return [min(max(x, 0.0), k + 1.0) for k, x in enumerate(d)]


class Model:
    """What scoring needs beside the shards; its size follows the number of shards."""

    def __init__(self, n_tokens, n_words, left_total, d, d1, bigrams, words, t1):
        self.n_tokens, self.n_words, self.left_total, self.d, self.d1 = n_tokens, n_words, left_total, np.array([0, *d]), np.array([0, *d1])
        self.bigrams, self.words = bigrams, words
        self.base = (d1[0] * t1[0] + d1[1] * t1[1] + d1[2] * t1[2]) / left_total if left_total else 1.0

    def bigram_counts(self, keys: np.ndarray) -> np.ndarray:
        """Training counts of sorted bigram hashes."""
        out = np.zeros(len(keys), np.int64)
        for _, path, lo, hi, n, over in self.bigrams:
            a, b = np.searchsorted(keys, np.uint64(lo), "left"), np.searchsorted(keys, np.uint64(hi), "right")
            if a == b:
                continue
            key, big, many, count = mapped(path, n, [("<u8", n), ("<u8", over), ("<u8", over), ("u1", n)])
            i = np.minimum(np.searchsorted(key, keys[a:b]), n - 1)
            c = np.where(key[i] == keys[a:b], count[i], 0).astype(np.int64)
            full = np.flatnonzero(c == 255)
            if len(full):
                c[full] = many[np.searchsorted(big, keys[a:b][full])]
            out[a:b] = c
        return out

    def word_rows(self, keys: np.ndarray) -> np.ndarray:
        """(occurrences, left contexts, bigrams begun with 1, 2, 3+ occurrences) of sorted word hashes."""
        out = np.zeros((len(keys), 5), np.int64)
        for _, path, lo, hi, n, _ in self.words:
            a, b = np.searchsorted(keys, np.uint64(lo), "left"), np.searchsorted(keys, np.uint64(hi), "right")
            if a == b:
                continue
            key, rows = mapped(path, n, [("<u8", n), ("<i8", 5 * n)])
            i = np.minimum(np.searchsorted(key, keys[a:b]), n - 1)
            out[a:b] = np.where((key[i] == keys[a:b])[:, None], rows.reshape(n, 5)[i], 0)
        return out

    def score(self, data: np.ndarray, offs: np.ndarray):
        """n_tokens, n_known, base_score and score of each text."""
        v, w, at = tokens(data, offs)
        pair = bigram(v, w)
        order = np.argsort(pair)
        s = pair[order]
        new = np.concatenate([[True], s[1:] != s[:-1]])
        count = np.empty(len(pair), np.int64)
        count[order] = self.bigram_counts(s[new])[np.cumsum(new) - 1]
        order = np.argsort(w)
        s = w[order]
        new = np.concatenate([[True], s[1:] != s[:-1]])
        keys = np.append(s[new], BOS)
        place = np.argsort(keys)
        rows = np.empty((len(keys), 5), np.int64)
        rows[place] = self.word_rows(keys[place])
        of_w = np.empty(len(w), np.int64)
        of_w[order] = np.cumsum(new) - 1
        of_v = np.empty(len(w), np.int64)
        of_v[1:] = of_w[:-1]
        of_v[at[:-1]] = len(keys) - 1
        c, left = rows[of_w, 0], rows[of_w, 1]
        low = self.base / (self.n_words + 1)
        if self.left_total:
            low = low + np.maximum(left - self.d1[np.minimum(left, 3)], 0) / self.left_total
        before = np.maximum(rows[:, 0], 1)
        gamma = np.where(rows[:, 0] > 0, (rows[:, 2] * self.d[1] + rows[:, 3] * self.d[2] + rows[:, 4] * self.d[3]) / before, 1.0)
        p = np.maximum(count - self.d[np.minimum(count, 3)], 0) / before[of_v] + gamma[of_v] * low
        base = np.log10((c + 0.5) / (self.n_tokens + 0.5 * (self.n_words + 1)))
        add = lambda x: np.add.reduceat(x, at[:-1]) if len(at) > 1 else np.zeros(0)
        return np.diff(at), add((c > 0).astype(np.int64)), add(base), add(np.log10(p))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    spark = docs.sparkSession
    n = shared.parts(spark)
    folder = shared.fresh(spark, "lm")
    edges = frequency.bounds(n)
    blocks = shared.stage_blocks(docs, "lm-blocks", id_col, text_col, BLOCK)

    def pairs(row):
        _, _, data, offs = shared.open_block(row)
        v, w, at = tokens(data, offs)
        return v, w, at, *grouped(bigram(v, w))

    def send(batches):
        z = zstandard.ZstdCompressor(level=1)
        for row in shared.block_rows(batches):
            _, _, _, key, count, _ = pairs(row)
            cut = np.append(np.searchsorted(key, edges), len(key))
            for b in range(n):
                if cut[b + 1] > cut[b]:
                    yield pa.record_batch([pa.array([b], pa.int32()), pa.array([row["block_id"]], pa.int64()), pa.array([key[cut[b] : cut[b + 1]].tobytes()], pa.binary()), pa.array([z.compress(count[cut[b] : cut[b + 1]].astype("<u4").tobytes())], pa.binary())], ["bucket", "block_id", "keys", "counts"])

    def add_up(batches):
        d, z = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        held = [(r["bucket"], r["block_id"], np.frombuffer(r["keys"], "<u8"), np.frombuffer(d.decompress(r["counts"]), "<u4")) for r in shared.block_rows(batches)]
        if not held:
            return
        held.sort(key=lambda x: x[1])
        key, count = np.concatenate([x[2] for x in held]), np.concatenate([x[3] for x in held]).astype(np.int64)
        order = np.argsort(key, kind="stable")
        s = key[order]
        first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        total = np.add.reduceat(count[order], first)
        code = np.empty(len(key), np.uint8)
        code[order] = np.repeat(np.minimum(total, 3), np.diff(first, append=len(s)))
        code[order[first]] |= 4  # the first block that holds it
        path, big = f"{folder}/bigrams-{held[0][0]:06d}.bin", total >= 255
        write_table(path, s[first], s[first][big], total[big].astype("<u8"), np.minimum(total, 255).astype(np.uint8))
        at = 0
        for i, (bucket, block, k, _) in enumerate(held):
            facts = [int(np.count_nonzero(total == j)) for j in (1, 2, 3, 4)] + [len(first), int(big.sum())] if not i else None
            yield pa.record_batch([pa.array([block], pa.int64()), pa.array([bucket], pa.int32()), pa.array([z.compress(code[at : at + len(k)].tobytes())], pa.binary()), pa.array([path if not i else None], pa.string()), pa.array([s[0].tobytes() + s[-1].tobytes() if not i else None], pa.binary()), pa.array([facts], pa.list_(pa.int64()))], ["block_id", "bucket", "q", "path", "ends", "facts"])
            at += len(k)

    sent = blocks.mapInArrow(shared.task(send), "bucket int, block_id long, keys binary, counts binary").repartitionById(n, F.col("bucket"))
    back = shared.staged(sent.mapInArrow(shared.task(add_up), "block_id long, bucket int, q binary, path string, ends binary, facts array<long>"), "lm-bigrams")
    codes = frequency.filed(back.groupBy("block_id").agg(F.collect_list(F.struct("bucket", "q")).alias("value")), "lm-codes")

    def by_word(batches):
        d, z = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        for row in shared.block_rows(batches):
            v, w, at, key, _, place = pairs(row)
            cut = np.append(np.searchsorted(key, edges), len(key))
            code = np.zeros(len(key), np.uint8)
            for x in frequency.fetch(codes, row["block_id"]) or []:
                b = x["bucket"]
                code[cut[b] : cut[b + 1]] = np.frombuffer(d.decompress(x["q"]), np.uint8)
            own = code >= 4
            kind, a, b = code[own] & 3, v[place[own]], w[place[own]]
            parts = [(w, 0, None), (np.full(len(at) - 1, BOS), 0, None), (b, 1, None)] + [(a, 1 + k, kind == k) for k in (1, 2, 3)]
            word = np.concatenate([x if m is None else x[m] for x, _, m in parts])
            field = np.concatenate([np.full(len(x) if m is None else int(m.sum()), f, np.int8) for x, f, m in parts])
            order = np.argsort(word, kind="stable")
            s, field = word[order], field[order]
            first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            nth = np.repeat(np.arange(len(first)), np.diff(first, append=len(s)))
            table = np.bincount(nth * 5 + field, minlength=5 * len(first)).reshape(-1, 5)
            cut = np.append(np.searchsorted(s[first], edges), len(first))
            for k in range(n):
                if cut[k + 1] > cut[k]:
                    yield pa.record_batch([pa.array([k], pa.int32()), pa.array([s[first][cut[k] : cut[k + 1]].tobytes()], pa.binary()), pa.array([z.compress(table[cut[k] : cut[k + 1]].T.astype("<u4").tobytes())], pa.binary())], ["bucket", "keys", "rows"])

    def word_shard(batches):
        d, keys, rows, bucket = zstandard.ZstdDecompressor(), [], [], None
        for r in shared.block_rows(batches):
            bucket = r["bucket"]
            keys.append(np.frombuffer(r["keys"], "<u8"))
            rows.append(np.frombuffer(d.decompress(r["rows"]), "<u4").reshape(5, -1).T)
        if bucket is None:
            return
        key, rows = np.concatenate(keys), np.concatenate(rows).astype(np.int64)
        order = np.argsort(key, kind="stable")
        s = key[order]
        first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        total = np.add.reduceat(rows[order], first, axis=0)
        path = f"{folder}/words-{bucket:06d}.bin"
        write_table(path, s[first], total.ravel())
        word = total[s[first] != BOS]
        facts = [int(word[:, 0].sum()), len(word), int(word[:, 1].sum()), *(int(np.count_nonzero(word[:, 1] == j)) for j in (1, 2, 3, 4)), int(np.count_nonzero(word[:, 1] > 2)), len(first)]
        yield pa.record_batch([pa.array([bucket], pa.int32()), pa.array([path]), pa.array([s[0].tobytes() + s[-1].tobytes()], pa.binary()), pa.array([facts], pa.list_(pa.int64()))], ["bucket", "path", "ends", "facts"])

    words = blocks.mapInArrow(shared.task(by_word), "bucket int, keys binary, rows binary").repartitionById(n, F.col("bucket"))
    words = shared.staged(words.mapInArrow(shared.task(word_shard), "bucket int, path string, ends binary, facts array<long>"), "lm-words")

    def shards(df, sizes):
        out, facts = [], []
        for r in df.filter("path is not null").select("bucket", "path", "ends", "facts").orderBy("bucket").toLocalIterator():
            lo, hi = np.frombuffer(bytes(r.ends), "<u8").tolist()
            out.append((r.bucket, r.path, lo, hi, *(r.facts[i] for i in sizes)))
            facts.append(r.facts)
        return out, [sum(x) for x in zip(*facts, strict=True)]

    grams, t = shards(back, (4, 5))
    lists, f = shards(words, (8, 8))
    t, f = t or [0] * 6, f or [0] * 9
    shared.drop(blocks, back, words)
    shared.remove(spark, codes)
    # the third discount takes all words of three or more left contexts
    return Model(f[0], f[1], f[2], discounts(t[:4]), discounts(f[3:7]), grams, lists, [f[3], f[4], f[7]])


def score(docs: DataFrame, model: Model, folds: int = 5, held: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    names = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def each(batches):
        for batch in batches:
            for s in shared.slices(batch, 1, BLOCK):
                n, known, base, own = model.score(*tv.text_buffers(s.column(1)))
                yield pa.record_batch([s.column(0), pa.array(n), pa.array(known), pa.array(np.full(len(n), model.n_tokens, np.int64)), pa.array(base), pa.array(own)], names)

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = plain.mapInArrow(shared.task(each, "maps", "maps fetched"), "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumn("held_out", F.coalesce(shared.crc_rest("doc_id", folds) == held, F.lit(False)))


def score_held_out(docs: DataFrame, folds: int = 5, held: int = 1) -> DataFrame:
    """Scores every document with a model of those whose crc32(doc_id as text) mod `folds` isn't `held`."""
    return score(docs, train(docs.filter(F.coalesce(shared.crc_rest("doc_id", folds) != held, F.lit(True)))), folds, held)
