"""Exact removal of repeated 100-byte strings by suffix sorting in blocks.

1. Anchors.  Each 100-byte window of a text names its smallest 16-byte piece
   by hash (the leftmost of equals); a run of windows shares an anchor.  Equal
   windows have equal anchors at equal distance, so a window whose anchor
   occurs once can't repeat.  For frequent anchors the windows themselves are
   counted too and single ones dropped, so what surrounds a common passage
   stays where it is.
2. Only the runs left travel, each to the range of its anchor's hash; equal
   ones of a block travel once.  The windows of an anchor that stands in more
   places than a task should hold travel by their own hashes instead, equal
   ones of a block once, so no range gets them all.
3. There, the runs of some anchors make a block.  Its suffixes are sorted one
   bucket at a time (buckets go by first bytes): by their first 16 bytes, ties
   by the rank of the next position in a difference cover modulo 16.  Those
   ranks come first, for the cover's positions only, by doubling.  Anchors lie
   at multiples of the period, so equal windows reach the cover at the same
   shift.  Neighbours in the sorted bucket that agree on 100 bytes form a
   class; all but its earliest member repeat.  Memory follows the bytes of one
   block and the suffixes of one bucket.
4. The windows of a run overlap each other, so what its repeats cover is one
   interval; blocks get their intervals back and cut the texts.

Defined cases: null and empty texts have no bytes and keep the digest of
nothing; texts under 100 bytes keep everything; null ids come before all
others; rows that share an id rank in the order they were staged; repeated
rows lose all but the first copy's bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frequency, shared
from . import textvec as tv

LENGTH, K = 100, 16
SPAN = LENGTH - K + 1  # pieces of a window
PERIOD = 16
#: Differences of these cover all residues modulo 16.
COVER = (0, 1, 2, 5, 8)
#: From each residue to the next position of the cover, and which of the cover it is.
_AHEAD = np.array([next(d for d in range(PERIOD + 1) if (r + d) % PERIOD in COVER) for r in range(PERIOD)])
_NTH = np.array([COVER.index((r + d) % PERIOD) for r, d in enumerate(_AHEAD.tolist())])
FREQUENT = 6  # frequency class from which windows are counted too: 32 occurrences
HOT = 18  # frequency class from which windows travel by themselves: 131,072 occurrences, more than one task should hold
SLAB = 12_000  # runs of a block
BUCKET = 1 << 16  # suffixes of a bucket
_CHUNK = 1 << 14


def loads(data: np.ndarray, order: str = "<u8") -> np.ndarray:
    """The eight bytes from each position as an integer; zeros follow the end."""
    pad = np.zeros(len(data) + 7, np.uint8)
    pad[: len(data)] = data
    return np.ndarray(len(data), order, pad, strides=(1,)).astype(np.uint64)


def runs(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all windows inside texts: hash, position, and the first and last window of each run."""
    n = len(data) - LENGTH + 1
    empty = np.zeros(0, np.int64)
    nothing = np.zeros(0, np.uint64), empty, empty, empty
    if n < 1:
        return nothing
    edge = np.zeros(n + 1, np.int8)
    long = np.diff(offs) >= LENGTH
    np.add.at(edge, offs[:-1][long], 1)
    np.add.at(edge, offs[1:][long] - LENGTH + 1, -1)
    valid = np.cumsum(edge[:n], dtype=np.int8).view(bool)
    low, clear = tv.U((1 << 17) - 1), ~tv.U((1 << 17) - 1)
    words = np.ndarray(len(data) - 7, "<u8", np.ascontiguousarray(data), strides=(1,))
    count = np.arange(_CHUNK + SPAN, dtype=np.uint64)
    firsts, picks, before = [], [], -1
    for at in range(0, n, _CHUNK):
        m = min(_CHUNK, n - at)
        w = words[at : at + m + SPAN + 7].astype(np.uint64)
        x = w[: m + SPAN - 1] * tv.U(0x9E3779B97F4A7C15)
        w *= tv.U(0xC2B2AE3D27D4EB4F)
        w ^= w >> tv.U(31)
        x += w[8 : m + SPAN + 7]
        x ^= x >> tv.U(32)
        x *= tv.U(0xD6E8FEB86659FD93)
        x &= clear
        x |= count[: m + SPAN - 1]
        k = 1
        while 2 * k <= SPAN:
            x = np.minimum(x[:-k], x[k:])
            k *= 2
        x = np.minimum(x[: len(x) - (SPAN - k)], x[SPAN - k :])
        pick = (x & low).astype(np.int64)
        pick += at
        ok = valid[at : at + m]
        new = np.empty(m, bool)
        new[0] = pick[0] != before or not at or not valid[at - 1]
        np.not_equal(pick[1:], pick[:-1], out=new[1:])
        new[1:] |= ~ok[:-1]
        new &= ok
        f = np.flatnonzero(new)
        firsts.append(f + at)
        picks.append(pick[f])
        before = pick[-1] if ok[-1] else -1
    first, anchor = np.concatenate(firsts), np.concatenate(picks)
    if not len(first):
        return nothing
    stop = np.searchsorted(offs, first, side="right")
    last = np.minimum(np.append(first[1:], n) - 1, offs[stop] - LENGTH)
    key = words[anchor].astype(np.uint64) * tv.U(0x9E3779B97F4A7C15) + tv.mix(words[anchor + 8].astype(np.uint64))
    return tv.mix(key), anchor, first, last


def window_hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    word = loads(data)
    acc = np.zeros(len(at), np.uint64)
    for j in range(12):
        acc += word[at + 8 * j] * tv._COEF[j]
    return tv.mix(acc + word[at + 92] * tv._COEF[12])


def _expand(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    size = last - first + 1
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)


def _frequent(row: dict, anchors: str):
    """Runs of the block that may repeat, with the frequency classes of their anchors."""
    ids, known, data, offs = shared.open_block(row)
    h, anchor, first, last = runs(data, offs)
    q = frequency.read(h, anchors, row["block_id"])
    keep = q > 0
    return ids, known, data, offs, h[keep], anchor[keep], first[keep], last[keep], q[keep]


def _windows(row: dict, anchors: str) -> np.ndarray:
    _, _, data, _, _, _, first, last, q = _frequent(row, anchors)
    return window_hashes(data, _expand(first[q >= FREQUENT], last[q >= FREQUENT]))


def firsts(data: np.ndarray, at: np.ndarray, h: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Which of a block's windows are the first of equal ones, by their order `turn`."""
    order = np.lexsort((turn, h))
    first = frequency.starts(h[order])
    head = np.repeat(order[first], np.diff(first, append=len(h)))
    word, same = np.ndarray(len(data) - 7, "<u8", np.ascontiguousarray(data), strides=(1,)), order != head
    for j in (*range(0, 96, 8), LENGTH - 8):
        same &= word[at[order] + j] == word[at[head] + j]
    out = np.ones(len(at), bool)
    out[order[same]] = False
    return out


def laid(data: np.ndarray, at: np.ndarray, size: np.ndarray, ahead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs one after the other, each with its anchor at a multiple of the period, and where each begins."""
    slot = (size + 2 * PERIOD - 1) // PERIOD * PERIOD
    begin = np.cumsum(slot) - slot + -ahead % PERIOD
    text = np.zeros(int(slot.sum()) + 2 * LENGTH, np.uint8)
    text[np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)] = data[_expand(at, at + size - 1)]
    return text, begin


def cover_ranks(text: np.ndarray) -> np.ndarray:
    """Ranks of the suffixes at the cover's positions, a row for each period, by doubling from 16 bytes to over 100."""
    word = _words(text)
    at = np.arange(0, len(word) - PERIOD, PERIOD)[:, None] + np.array(COVER)

    def rank(x):
        order = np.argsort(x)
        s = x[order]
        r = np.empty(len(x), np.uint64)
        r[order] = np.cumsum(np.concatenate([[0], (s[1:] != s[:-1]).astype(np.uint64)])).astype(np.uint64)
        return r

    name = rank(rank(word[at].astype(np.uint64).ravel()) << tv.U(32) | rank(word[at + 8].astype(np.uint64).ravel()))
    step = 1
    while step * PERIOD < LENGTH:
        after = np.zeros(len(name), np.uint64)
        after[: -step * len(COVER)] = name[step * len(COVER) :] + tv.U(1)
        name = rank(name << tv.U(32) | after)
        step *= 2
    return name.reshape(at.shape)


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position, to be compared like the bytes; a view."""
    return np.ndarray(len(text) - 7, ">u8", text, strides=(1,))


def repeats(text: np.ndarray, begin: np.ndarray, windows: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each run of a block the first and last window that an earlier run has too, counted from its own first; -1 for none.

    `windows` is the number of a run's windows, `rank` its place in the order
    of occurrences.  Suffixes at the windows are split into buckets by their
    first bytes and sorted one bucket at a time.
    """
    word, cover = _words(text), cover_ranks(text)
    at, run = _expand(begin, begin + windows - 1), np.repeat(np.arange(len(begin)), windows)
    head = word[at].astype(np.uint64)
    edges = np.unique(np.sort(head[:: max(1, len(head) // 4096)])[:: max(1, min(len(head), 4096) * BUCKET // len(head))])
    bucket = np.searchsorted(edges, head, side="right")
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(len(edges) + 2))
    first, last = np.full(len(begin), np.iinfo(np.int64).max), np.full(len(begin), -1)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if b - a < 2:
            continue
        who = order[a:b]
        p = at[who]
        shift = p % PERIOD  # equal windows have their anchors, and so the next cover position, at one distance
        tie = cover[(p + _AHEAD[shift]) // PERIOD, _NTH[shift]]
        by = np.lexsort((tie, shift, word[p + 8].astype(np.uint64), head[who]))
        who, p = who[by], p[by]
        same = np.ones(len(p) - 1, bool)
        for j in (*range(0, 96, 8), LENGTH - 8):
            same &= word[p[1:] + j] == word[p[:-1] + j]
        cls = np.concatenate([[0], np.cumsum(~same)])
        least = np.full(cls[-1] + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, cls, rank[run[who]])
        dup = rank[run[who]] > least[cls]
        mine, spot = run[who[dup]], p[dup] - begin[run[who[dup]]]
        np.minimum.at(first, mine, spot)
        np.maximum.at(last, mine, spot)
    return np.where(last < 0, -1, first), last


def intervals(docs: DataFrame, rest: bool = False, hot: int = HOT) -> tuple[DataFrame, str]:
    """The staged blocks, and a folder with starts and ends of what repeats in each."""
    n = shared.parts(docs.sparkSession)
    staged = shared.stage_blocks(docs, "substring-blocks", rest=rest)
    blocks = staged.drop("rest")

    def anchor_hashes(row):
        _, _, data, offs = shared.open_block(row)
        return runs(data, offs)[0]

    anchors = frequency.replies(blocks, n, anchor_hashes, "anchors")
    windows = frequency.replies(blocks, n, lambda r: _windows(r, anchors), "windows")
    edges = frequency.bounds(n)
    names = ["bucket", "block_id", "head", "bytes", "cuts"]

    def send(batches):
        z = zstandard.ZstdCompressor(level=1)
        for row in shared.block_rows(batches):
            ids, known, data, offs, h, anchor, first, last, q = _frequent(row, anchors)
            often = q >= FREQUENT
            order_id = np.where(known, ids, np.iinfo(np.int64).min)
            single = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
            gone = np.zeros((0, 2), np.int64)
            if often.any():
                at = _expand(first[often], last[often])
                wh = window_hashes(data, at)
                run = np.repeat(np.flatnonzero(often), (last - first + 1)[often])
                some = frequency.read(wh, windows, row["block_id"]) > 0
                at, wh, run = at[some], wh[some], run[some]
                own = q[run] < hot
                lo, hi = np.full(len(h), np.iinfo(np.int64).max), np.full(len(h), -1)
                np.minimum.at(lo, run[own], at[own])
                np.maximum.at(hi, run[own], at[own])
                first, last = np.where(often, lo, first), np.where(often, hi, last)
                if not own.all():  # windows of hot anchors go by their own hashes, equal ones of the block once
                    at, wh, run = at[~own], wh[~own], run[~own]
                    d = np.searchsorted(offs, at, side="right") - 1
                    turn = np.empty(len(at), np.int64)
                    turn[np.lexsort((at, d, known[d], order_id[d]))] = np.arange(len(at))
                    ok = firsts(data, at, wh, turn)
                    single = at[ok], anchor[run[ok]], wh[ok]
                    p = np.sort(at[~ok])
                    if len(p):
                        new = np.flatnonzero(np.concatenate([[True], np.diff(p) > LENGTH]))
                        gone = np.stack([p[new], p[np.append(new[1:], len(p)) - 1] + LENGTH], axis=1)
                keep = last >= 0
                h, anchor, first, last = h[keep], anchor[keep], first[keep], last[keep]
            doc = np.searchsorted(offs, first, side="right") - 1
            turn = np.lexsort((first, doc, known[doc], order_id[doc]))
            raw, seen, cuts, keep = data.tobytes(), set(), [], []
            for i, a, f, t in zip(turn.tolist(), anchor[turn].tolist(), first[turn].tolist(), last[turn].tolist(), strict=True):
                key = (a - f, raw[f : t + LENGTH])
                if key in seen:
                    cuts.append((f, t + LENGTH))
                else:
                    seen.add(key)
                    keep.append(i)
            keep = np.array(keep, np.int64)
            first, last, anchor, h = (np.concatenate([x[keep], y]) for x, y in zip((first, last, anchor, h), (single[0], *single), strict=True))
            doc = np.searchsorted(offs, first, side="right") - 1
            keep = np.argsort(h, kind="stable")
            bucket = np.searchsorted(edges, h[keep], side="right") - 1
            local = np.concatenate([gone, np.array(cuts, np.int64).reshape(-1, 2)]).astype("<i8").tobytes()
            out = [(int(row["block_id"] % n), b"", b"", local)] if local else []
            for b in np.unique(bucket).tolist():
                i = keep[bucket == b]
                head = np.stack([order_id[doc[i]], known[doc[i]].astype(np.int64), doc[i], first[i], last[i], anchor[i], h[i].view(np.int64)])
                text = b"".join([raw[f : t + LENGTH] for f, t in zip(first[i].tolist(), last[i].tolist(), strict=True)])
                out.append((b, z.compress(head.astype("<i8").tobytes()), z.compress(text), b""))
            cols = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array([row["block_id"]] * len(out), pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])], names)

    def find(batches):
        d, heads, texts, owner = zstandard.ZstdDecompressor(), [], [], []
        for r in shared.block_rows(batches):
            if r["cuts"]:
                yield pa.record_batch([pa.array([r["block_id"]], pa.int64()), pa.array([r["cuts"]], pa.binary())], ["block_id", "cuts"])
                continue
            heads.append(np.frombuffer(d.decompress(r["head"]), "<i8").reshape(7, -1))
            texts.append(d.decompress(r["bytes"]))
            owner.append(r["block_id"])
        if not heads:
            return
        block = np.repeat(np.array(owner, np.int64), [x.shape[1] for x in heads])
        oid, known, doc, first, last, anchor, h = np.concatenate(heads, axis=1)
        raw = b"".join(texts)
        size = last - first + LENGTH
        at = np.cumsum(size) - size
        rank = np.empty(len(at), np.int64)
        rank[np.lexsort((first, doc, block, known, oid))] = np.arange(len(at))
        # equal runs: the earliest stands for them, the others repeat as a whole
        stand: dict[tuple, int] = {}
        whole = np.zeros(len(at), bool)
        for i, (o, s, m) in enumerate(zip((anchor - first).tolist(), at.tolist(), size.tolist(), strict=True)):
            j = stand.setdefault((o, raw[s : s + m]), i)
            if j != i:
                if rank[i] < rank[j]:
                    stand[(o, raw[s : s + m])] = i
                    i = j
                whole[i] = True
        begin, end = np.full(len(at), -1), np.full(len(at), -1)
        begin[whole], end[whole] = first[whole], last[whole] + LENGTH
        rest = np.flatnonzero(~whole)
        rest = rest[np.argsort(h[rest], kind="stable")]
        alike = np.diff(np.append(frequency.starts(h[rest]), len(rest)))
        rest = rest[np.repeat(alike, alike) > 1]  # what is left alone with its anchor repeats nowhere
        data = np.frombuffer(raw, np.uint8)
        a = 0
        while a < len(rest):
            b = min(a + SLAB, len(rest))
            while b < len(rest) and h[rest[b]] == h[rest[b - 1]]:  # an anchor's runs stay together
                b += 1
            own = rest[a:b]
            text, begins = laid(data, at[own], size[own], (anchor - first)[own])
            f, t = repeats(text, begins, (last - first)[own] + 1, rank[own])
            hit = t >= 0
            begin[own[hit]] = first[own[hit]] + f[hit]
            end[own[hit]] = first[own[hit]] + t[hit] + LENGTH
            a = b
        for x in np.unique(block).tolist():
            mine = (block == x) & (end >= 0)
            if mine.any():
                yield pa.record_batch([pa.array([x], pa.int64()), pa.array([np.stack([begin[mine], end[mine]], axis=1).astype("<i8").tobytes()], pa.binary())], ["block_id", "cuts"])

    sent = blocks.mapInArrow(shared.task(send), "bucket int, block_id long, head binary, bytes binary, cuts binary").repartitionById(n, F.col("bucket"))
    cuts = sent.mapInArrow(shared.task(find), "block_id long, cuts binary")
    folder = frequency.filed(cuts.groupBy("block_id").agg(F.collect_list("cuts").alias("value")), "cuts")
    for x in (anchors, windows):
        shared.remove(docs.sparkSession, x)
    return staged, folder


def spans(row: dict, cuts: str) -> tuple:
    """The block's texts and the maximal removed intervals of each, in bytes of the text."""
    ids, known, data, offs = shared.open_block(row)
    gone = np.zeros(len(data) + 1, np.int32)
    for c in frequency.fetch(cuts, row["block_id"]):
        x = np.frombuffer(c, "<i8").reshape(-1, 2)
        np.add.at(gone, x[:, 0], 1)
        np.add.at(gone, x[:, 1], -1)
    gone = np.cumsum(gone[:-1]) > 0
    return ids, known, data, offs, gone


def measured(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    blocks, cuts = intervals(docs, hot=hot)

    def each(batches):
        for row in shared.block_rows(batches):
            ids, known, data, offs, gone = spans(row, cuts)
            out = []
            for i in range(len(ids)):
                x, g = data[offs[i] : offs[i + 1]], gone[offs[i] : offs[i + 1]]
                cut = int(np.count_nonzero(g))
                starts = int(np.count_nonzero(g[1:] & ~g[:-1])) + int(cut > 0 and g[0])
                out.append((int(ids[i]) if known[i] else None, len(x), cut, starts, hashlib.sha256((x[~g] if cut else x).tobytes()).hexdigest()))
            cols = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4 + [pa.string()], strict=True)], names)

    return blocks.mapInArrow(shared.task(each), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def kept_texts(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The documents with what is left of their texts, and all their columns.

    Whole characters only: one that is covered in part stays.  A document that
    keeps nothing but white space goes, if it lost anything; a null text stays
    null; `length_col`, where it exists, gets the new number of characters.
    """
    schema = docs.schema
    blocks, cuts = intervals(docs, rest=True)

    def each(batches):
        for row in shared.block_rows(batches):
            ids, known, data, offs, gone = spans(row, cuts)
            at = np.flatnonzero((data & 0xC0) != 0x80)
            if len(at):
                gone = np.repeat(np.logical_and.reduceat(gone, at), np.diff(at, append=len(data)))
            left = np.concatenate([[0], np.cumsum(~gone)])[offs]
            texts = shared.text_array(data[~gone], left, row["given"])
            cut = np.flatnonzero(np.diff(left) < np.diff(offs))
            keep = np.ones(len(ids), bool)
            keep[cut] = [bool(texts[i].as_py().strip()) for i in cut.tolist()]
            out = shared.block_table(row, schema, text_col, texts)
            where = out.schema.get_field_index(length_col)
            if where >= 0:
                out = out.set_column(where, length_col, pc.if_else(pc.is_valid(texts), pc.utf8_length(texts), out.column(where).cast(pa.int64())).cast(out.column(where).type))
            yield from out.filter(pa.array(keep)).to_batches()

    return blocks.mapInArrow(shared.task(each), schema)
