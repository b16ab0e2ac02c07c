"""Spans of users' rules, whose patterns may match any number of times: read from marked texts, a batch at a time.

Patterns are matched in the JVM, in Java's dialect; what comes here is a copy of
each text for each rule, with a mark before and after each match.  Offsets and
the choice among overlaps are array operations over many texts, so a hit costs
the same in long and short texts.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa

MARK = "\ufdd0"
#: Bytes of texts that are worked on at a time.
SLICE = 1 << 22
#: Rounds in which all groups choose at once, before the rest is gone through one by one.
ROUNDS = 12

SPAN = pa.struct([("category", pa.string()), ("label", pa.string()), ("severity", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string()), ("confidence", pa.float64()), ("redact_by_default", pa.bool_())])


def greedy(lo: np.ndarray, hi: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Which spans are kept, strongest first, unless they meet a kept one; `lo` ascends, `order` has the strongest first.

    Spans fall into groups that don't meet: a group begins where as many have
    ended as begun.  In a round the strongest of each group is kept and what it
    meets goes; the others form new groups.
    """
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    kept, left = np.zeros(len(order), bool), np.arange(len(order))
    for _ in range(ROUNDS):
        if not len(left):
            return kept
        starts, ends = lo[left], hi[left]
        first = np.flatnonzero(np.concatenate([[True], np.sort(ends)[:-1] <= starts[1:]]))
        best = order[np.minimum.reduceat(rank[left], first)]
        kept[best] = True
        best = np.repeat(best, np.diff(np.append(first, len(left))))
        left = left[(starts >= hi[best]) | (ends <= lo[best])]
    begun, ended = [], []
    for k in left[np.argsort(rank[left])]:
        i = bisect.bisect_left(begun, lo[k])
        if (i == 0 or ended[i - 1] <= lo[k]) and (i == len(begun) or begun[i] >= hi[k]):
            begun.insert(i, lo[k])
            ended.insert(i, hi[k])
            kept[k] = True
    return kept


def between_marks(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, ...]:
    """Matches in texts of UTF-8 bytes, but for empty ones: row, start and end in code points of the unmarked text, first byte and the byte behind."""
    a, b, c = MARK.encode()
    at = np.flatnonzero(data[:-2] == a)
    at = at[(data[at + 1] == b) & (data[at + 2] == c)]
    row = np.searchsorted(offsets, at, "right") - 1
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    earlier = np.arange(len(at)) - np.searchsorted(at, offsets[row])
    spot = points[at] - points[offsets[row]] - earlier
    some = spot[1::2] > spot[::2]
    return row[::2][some], spot[::2][some], spot[1::2][some], at[::2][some] + len(MARK.encode()), at[1::2][some]


def cut(data: np.ndarray, first: np.ndarray, behind: np.ndarray) -> pa.Array:
    """Texts of stretches of bytes."""
    ends = np.concatenate([[0], np.cumsum(behind - first)])
    taken = data[np.arange(ends[-1]) + np.repeat(first - ends[:-1], behind - first)]
    return pa.StringArray.from_buffers(len(first), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(taken))


def _of_slice(texts: list[tuple[np.ndarray, np.ndarray]], rules: list[tuple], ranks: dict[str, int], n: int) -> pa.ListArray:
    """Spans of n texts, given their bytes for each rule."""
    own = [between_marks(*t) for t in texts]
    row, start, end = (np.concatenate([o[k] for o in own]) for k in range(3))
    rule = np.repeat(np.arange(len(own)), [len(o[0]) for o in own])
    base = np.array([ranks[severity] * 1000000.0 + confidence * 10000.0 for _, _, severity, confidence in rules])

    by_start = np.argsort(row << 32 | start, kind="stable")
    row, start, end, rule = (x[by_start] for x in (row, start, end, rule))
    order = np.lexsort((start, np.array([r[0] for r in rules])[rule], -(base[rule] + (end - start))))
    kept = np.flatnonzero(greedy(row << 32 | start, row << 32 | end, order))
    row, start, end, rule = (x[kept] for x in (row, start, end, rule))

    # texts rule by rule, then in order
    place = by_start[kept] - np.cumsum([0, *(len(o[0]) for o in own)])[rule]
    parts = [cut(data, o[3][place[rule == k]], o[4][place[rule == k]]) for k, (o, (_, data)) in enumerate(zip(own, texts, strict=True))]
    back = np.empty(len(kept), np.int64)
    back[np.argsort(rule, kind="stable")] = np.arange(len(kept))
    of = lambda values, kind: pa.array(values, kind).take(pa.array(rule))
    values = [
        of(["custom"] * len(rules), pa.string()), of([r[1] for r in rules], pa.string()), of([r[2] for r in rules], pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32()),
        pa.concat_arrays(parts).take(pa.array(back)), of([r[3] for r in rules], pa.float64()), of([r[2] != "low" for r in rules], pa.bool_()),
    ]
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32()), pa.StructArray.from_arrays(values, fields=list(SPAN)))


def with_texts(found: pa.ListArray, originals: pa.Array) -> pa.ListArray:
    """The same spans, with texts from the originals of those texts that held a mark, whose copies differ (others are null)."""
    values, ends = found.flatten(), found.offsets.to_numpy()
    texts = values.field("text").to_pylist()
    starts, behind = (values.field(c).to_numpy() for c in ("start", "end"))
    for row in np.flatnonzero(originals.is_valid().to_numpy(zero_copy_only=False)):
        whole = originals[int(row)].as_py()
        for k in range(ends[row], ends[row + 1]):
            texts[k] = whole[starts[k] : behind[k]]
    columns = [pa.array(texts, pa.string()) if f.name == "text" else values.field(f.name) for f in SPAN]
    return pa.ListArray.from_arrays(found.offsets, pa.StructArray.from_arrays(columns, fields=list(SPAN)))


def spans(rules: list[tuple], ranks: dict[str, int]):
    """A function of the texts that held a mark (others: null) and of each rule's marked texts; a rule is its ordinal, label, severity and confidence."""

    def run(originals: pa.Array, *marked: pa.Array) -> pa.Array:
        n = len(originals)
        texts = [m.cast(pa.large_string()) for m in marked]
        bounds = [np.frombuffer(t.buffers()[1], np.int64)[t.offset : t.offset + n + 1] if n else np.zeros(1, np.int64) for t in texts]
        bytes_ = [np.frombuffer(t.buffers()[2] or b"", np.uint8) for t in texts]
        so_far = sum((b - b[0] for b in bounds), np.zeros(n + 1, np.int64))
        out, begin = [], 0
        while begin < n and rules:
            end = max(begin + 1, int(np.searchsorted(so_far, so_far[begin] + SLICE, "right")) - 1)
            out.append(_of_slice([(b[begin : end + 1] - b[begin], d[b[begin] : b[end]]) for b, d in zip(bounds, bytes_, strict=True)], rules, ranks, end - begin))
            begin = end
        found = pa.concat_arrays(out) if out else pa.array([[]] * n, pa.list_(SPAN))
        return found if originals.null_count == n else with_texts(found, originals)

    return run
