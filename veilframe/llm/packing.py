"""Best-fit packing of documents into sequences by bin completion.

Only the number of pieces of each length matters to the packing, and there are
at most `capacity` lengths; so the search runs over that histogram on the
driver, whatever the number of documents.  It is a branch and bound: around
the largest length left it enumerates the undominated fillings, least waste
first, and cuts a branch once its waste rules out fewer sequences than the
incumbent has.  The first incumbent is best-fit decreasing; a lower bound that
the incumbent meets ends the search, as do `nodes` fillings tried or `steps` taken,
those of the dominance test included (the incumbent is then kept).  The result
tells the number of sequences and the bound.  A plan has at most a few patterns per length, each
with the number of its sequences.

Pieces then find their places by rank: pieces of one length are numbered by
block prefix sums, never gathered in one task, and a pattern's slots follow
from the rank by division.

Defined cases: null and empty texts are a document of the end id alone; null
and repeated ids are kept as they are, each row a document of its own; an
empty table gives no rows.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from .encoding import encoder, vocabulary

PIECES = "part long, doc_id long, piece int, start long, length long, ids_crc32 long"


def best_fit(counts: dict[int, int], cap: int) -> Counter:
    """Best-fit decreasing over a histogram: pattern (descending lengths) -> sequences."""
    open_bins: dict[int, Counter] = {}
    done: Counter = Counter()

    def put(space, pattern, n):
        if n:
            (open_bins.setdefault(space, Counter()) if space else done)[pattern] += n

    for s in sorted(counts, reverse=True):
        left = counts[s]
        while left:
            fits = [r for r in open_bins if r >= s]
            if not fits:
                m = cap // s
                put(cap - m * s, (s,) * m, left // m)
                if left % m:
                    put(cap - left % m * s, (s,) * (left % m), 1)
                break
            r = min(fits)
            m = r // s
            pattern, n = next(iter(open_bins[r].items()))
            take = min(n, left // m)
            k = m if take else left
            take = take or 1
            open_bins[r][pattern] -= take
            if not open_bins[r][pattern]:
                del open_bins[r][pattern]
                if not open_bins[r]:
                    del open_bins[r]
            put(r - k * s, pattern + (s,) * k, take)
            left -= take * k
    for group in open_bins.values():
        done.update(group)
    return done


def lower_bound(counts: dict[int, int], cap: int) -> int:
    """Sequences that any packing needs: by total length, and with what lengths over half leave unusable."""
    total = sum(s * c for s, c in counts.items())
    best = -(-total // cap)
    small = sorted(s for s in counts if 2 * s <= cap)
    for k in [0, *small]:
        wide = sum(c for s, c in counts.items() if s > cap - k)
        mid = [(s, c) for s, c in counts.items() if cap / 2 < s <= cap - k]
        rest = sum(s * c for s, c in counts.items() if k <= s <= cap / 2)
        n = sum(c for _, c in mid)
        best = max(best, wide + n + max(0, -(-(rest - (n * cap - sum(s * c for s, c in mid))) // cap)))
    return best


class Budget:
    """What a search may still spend."""

    def __init__(self, nodes: int, steps: int):
        self.nodes, self.steps = nodes, steps


def _holds(wide: dict[int, int], fine: dict[int, int], spend: Budget) -> bool:
    """Whether the items `fine` can be packed into bins of the sizes `wide`, both as size -> number; False once the steps are used up.

    What both have goes first: an item may as well lie in the bin of its own
    size, since whatever lies there fits where the item lay.
    """
    spend.steps -= 1 + len(fine) // 8
    items = sorted((s for s, n in fine.items() for _ in range(n - wide.get(s, 0))), reverse=True)
    bins = tuple(sorted(s for s, n in wide.items() for _ in range(n - fine.get(s, 0))))
    if not items:
        return True
    rest = [sum(items)]
    for s in items:
        rest.append(rest[-1] - s)
    levels = [(bins, 0)]  # bins in ascending order before an item is placed, and where to look for its bin
    while levels:
        bins, at = levels[-1]
        nth = len(levels) - 1
        spend.steps -= 1 + len(bins) // 16
        if spend.steps < 0:
            return False
        at = max(at, bisect.bisect_left(bins, items[nth]))
        while 0 < at < len(bins) and bins[at] == bins[at - 1] and at > bisect.bisect_left(bins, items[nth]):
            at += 1
        if at == len(bins) or sum(bins[bisect.bisect_left(bins, items[-1]) :]) < rest[nth]:
            levels.pop()
            continue
        levels[-1] = (bins, at + 1)
        if nth + 1 == len(items):
            return True
        levels.append((tuple(sorted((*bins[:at], bins[at] - items[nth], *bins[at + 1 :]))), 0))
    return False


class Sizes:
    """Lengths in descending order, and which sums the lengths from each on can make."""

    def __init__(self, counts: dict[int, int], cap: int):
        self.sizes = sorted(counts, reverse=True)
        self.sums, every, reach = [0] * len(self.sizes), (1 << (cap + 1)) - 1, 1
        for i in range(len(self.sizes) - 1, -1, -1):
            k = self.sizes[i]
            while k <= cap:
                reach |= reach << k & every
                k *= 2
            self.sums[i] = reach


def fillings(counts: dict[int, int], space: int, waste: int, spend: Budget, known: Sizes | None = None):
    """Undominated fillings of `space` that leave at most `waste`, least waste first and larger items first.

    A filling is dominated if another's items, as bins, hold its items: the
    other leaves the smaller ones for later.  Ends early when the steps of
    `spend` are used up.
    """
    known = known or Sizes({s: c for s, c in counts.items() if c}, max(space, 1))
    sizes, sums = known.sizes, known.sums
    start = bisect.bisect_left(sizes, -space, key=lambda s: -s)

    def from_(i, target):
        return max(i, bisect.bisect_left(sizes, -target, key=lambda s: -s))

    def exact(i, target):
        """Non-increasing choices of sizes from the i-th on that add up to `target`."""
        level, left, picks, runs = [from_(i, target)], [target], [], [0]
        while level:
            j, t = level[-1], left[-1]
            if not t:
                yield tuple(sizes[p] for p in picks)
            elif j < len(sizes) and sums[j] >> t & 1:
                spend.steps -= 1
                if spend.steps < 0:
                    return
                level[-1] = j + 1
                s, run = sizes[j], runs[-1] + 1 if picks and picks[-1] == j else 1
                if sums[j] >> (t - s) & 1 and run <= counts.get(s, 0):
                    picks.append(j)
                    runs.append(run)
                    level.append(from_(j, t - s))
                    left.append(t - s)
                continue
            level.pop()
            left.pop()
            runs.pop()
            if picks:
                picks.pop()

    before: list[Counter] = []
    for lost in range(min(waste, space) + 1):
        small = [s for s in sizes[from_(0, lost) :] if counts.get(s, 0)]
        for f in exact(start, space - lost):
            own = Counter(f)
            if small:
                spend.steps -= len(small) // 8
                if any(counts[s] > own[s] for s in small):
                    continue  # another item still fits
            spend.steps -= len(f) // 8
            if not any(_holds(g, own, spend) for g in before):
                if spend.steps < 0:
                    return
                before.append(own)
                yield f


def plan(counts: dict[int, int], cap: int, nodes: int = 6000, steps: int = 2_000_000) -> list[tuple[tuple[int, ...], int]]:
    """Patterns with their numbers of sequences.

    `nodes` fillings are tried at most and `steps` taken to find them: when
    either is used up the best plan so far stands.  A filling is applied as
    often as its lengths allow, so a search that ends without either limit
    proves nothing; meeting `lower_bound` does.
    """
    counts = {s: c for s, c in counts.items() if c}
    best = best_fit(counts, cap)
    n_best, least = sum(best.values()), lower_bound(counts, cap)
    total, spend = sum(s * c for s, c in counts.items()), Budget(nodes, steps)

    def children(left, used, wasted, known):
        top = max(left)
        rest = dict(left)
        rest[top] -= 1
        allowed = (n_best - 1) * cap - total - wasted
        for f in fillings(rest, cap - top, allowed, spend, known) if allowed >= 0 else ():
            pattern = (top, *f)
            need, lost = Counter(pattern), cap - top - sum(f)
            times = min(left[s] // k for s, k in need.items())
            room = (n_best - 1) * cap - total - wasted
            times = min(times, room // lost) if lost else times
            if times > 0:
                after = {s: c - times * need.get(s, 0) for s, c in left.items() if c > times * need.get(s, 0)}
                yield pattern, times, after, used + times, wasted + lost * times

    made: list[tuple[tuple[int, ...], int]] = []
    known = Sizes(counts, cap)
    stack = [(children(counts, 0, 0, known), known)] if n_best > least else []
    while stack and n_best > least and spend.nodes > 0 and spend.steps > 0:
        child = next(stack[-1][0], None)
        if child is None:
            stack.pop()
            if made:
                made.pop()
            continue
        spend.nodes -= 1
        pattern, times, after, used, wasted = child
        if (n_best - 1) * cap - total - wasted < 0:
            continue
        if not after:
            if used < n_best:
                best, n_best = Counter(), used
                for p, k in [*made, (pattern, times)]:
                    best[p] += k
            continue
        known = stack[-1][1]
        known = Sizes(after, cap) if len(after) < 0.8 * len(known.sizes) else known
        made.append((pattern, times))
        stack.append((children(after, used, wasted, known), known))
    return sorted(best.items(), key=lambda x: (-sum(x[0]), x[0]))


def pieces(docs: DataFrame, vocab: str = "byte_bpe_50k.json", end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Token pieces of every document; only the first of a longer document may be short."""

    def cut(batches):
        from pyspark import TaskContext

        enc, end, part = encoder(vocabulary(vocab)), struct.pack("<I", end_id), TaskContext.get().partitionId()
        for batch in batches:
            for s in shared.slices(batch, 1, 2 << 20):
                rows = []
                for i, ids in zip(s.column(0).to_pylist(), enc.encode(s.column(1)), strict=True):
                    ids += end
                    n, at, k = len(ids) // 4, 0, 0
                    while at < n:
                        to = at + ((n - at) % capacity or capacity) if not k else at + capacity
                        own = ids[4 * at : 4 * to]
                        rows.append((part, i, k, at, to - at, zlib.crc32(own), own) if keep_ids else (part, i, k, at, to - at, zlib.crc32(own)))
                        at, k = to, k + 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * keep_ids
    names = ["part", "doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return shared.staged(plain.mapInArrow(shared.task(cut, "encoders"), PIECES + ", ids binary" * keep_ids), "pieces")


def pack(docs: DataFrame, capacity: int = 1024, **options) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, (ids, if kept,) sequence_id, offset; and how many sequences there are and at least must be."""
    cut = pieces(docs, capacity=capacity, **options)
    by_part = shared.staged(cut.groupBy("length", "part").agg(F.count("*").alias("n")), "piece-counts")
    counts = {int(r.length): int(r.n) for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    seen: Counter = Counter()
    sequence = 0
    for pattern, times in plan(counts, capacity):
        at = 0
        for s, m in Counter(pattern).items():
            slots.setdefault(s, []).append((seen[s], m, sequence, at))
            seen[s] += m * times
            at += m * s
        sequence += times
    bound = lower_bound(counts, capacity)
    tables = {s: tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) for s, rows in slots.items()}

    # ranks of a length run over parts, then over rows of a part; both windows are as small as a part or a length's parts
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = by_part.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).select("length", "part", "before")
    order = ["doc_id", "piece", "start", "ids_crc32"]
    inner = Window.partitionBy("part", "length").orderBy(*order)
    ranked = cut.withColumn("rank", F.row_number().over(inner) - 1).join(firsts.hint("merge"), ["part", "length"])
    ranked = ranked.select(*[c for c in cut.columns if c != "part"], (F.col("rank") + F.col("before")).alias("rank"))

    def place(batches):
        for b in batches:
            length = b.column(b.schema.get_field_index("length")).to_numpy()
            rank = b.column(b.schema.get_field_index("rank")).to_numpy()
            sid, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for s in np.unique(length):
                here = length == s
                base, m, seq, at = tables[int(s)]
                i = np.searchsorted(base, rank[here], side="right") - 1
                k = rank[here] - base[i]
                sid[here], off[here] = seq[i] + k // m[i], at[i] + k % m[i] * s
            keep = [n for n in b.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in keep), pa.array(sid), pa.array(off)], [*keep, "sequence_id", "offset"])

    kept = ", ids binary" * ("ids" in cut.columns)
    placed = ranked.mapInArrow(shared.task(place), PIECES.removeprefix("part long, ") + kept + ", sequence_id long, offset long")
    return placed.withColumns({"sequences": F.lit(sequence).cast("long"), "fewest": F.lit(bound).cast("long")})
