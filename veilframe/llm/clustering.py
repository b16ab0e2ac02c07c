"""k-means over exact integers by Exponion search.

Each vector keeps its centroid, an upper bound u of the distance to it and a
lower bound l of the distance to any other.  After a round u grows by what its
own centroid moved and l shrinks by the most that another moved.  While u stays
under l, or under half the distance from its centroid to that one's nearest
neighbour, the vector can't change and isn't looked at.  Else u is measured; if
that doesn't settle it, only centroids within 2u + (distance to the nearest
neighbour) of its own are scanned, from a list of the others sorted by distance.
The nearest and the second nearest both lie in that ball.  Its radius is
inclusive and the tests to skip are strict, so ties are always seen and go to
the smaller number; bounds are floats rounded to the safe side, distances that
decide are exact integers.

Vectors lie in blocks (a row each) in a bucketed table; a round's bounds are a
table in the same buckets, so the two meet without a shuffle, and a round moves
nothing but a few sums a task.  Every round is written: a lost executor costs
its tasks only.  Centroids and their lists (k * k numbers) travel to the tasks:
`k` is the bound of that.

Defined cases: vectors that are null, of another length, or with a null or
non-finite component take no part and have no row; rows without an id take part
but come last where first centroids are chosen; rows that share an id are rows
of their own (equal hashes: by their components); fewer vectors than k give
fewer centroids, equal ones leave the later centroid empty, and it stays where
it is; an empty table gives no rows.  Components of 2**49 or more after scaling,
squared distances between vectors and centroids, and inertias, beyond 64 bits
raise OverflowError.  A round that moves no centroid is the last, as the rest
would repeat it.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, vectors

ROWS = 8192
LARGEST = 2.0**49
UP, DOWN = 1 + 2.0**-50, 1 - 2.0**-50
BLOCK = "block_id long, n int, ids binary, known binary, width int, vecs binary"
STATE = "block_id long, near binary, upper binary, lower binary, distance binary, sums binary, scanned long"


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows to a row, or to a row each: in doubles below 2**53, in 64 bits below 2**63, else in Python integers."""
    reach = float(np.abs(x).max(initial=0)) + float(np.abs(c).max(initial=0))
    top = reach * reach * max(x.shape[1], 1)
    if top < 2**53:
        d = x.astype(np.float64) - c
        return np.einsum("ij,ij->i", d, d).astype(np.int64)
    if top < 2**63:
        d = x - c
        return np.einsum("ij,ij->i", d, d)
    exact = [sum(int(v) * int(v) for v in row) for row in x - c]
    if any(v >= 2**63 for v in exact):
        raise OverflowError("a squared distance is beyond 64 bits")
    return np.array(exact, np.int64)


class Centres:
    """Centroids of a round, how far each has moved, and for each the others in order of distance."""

    def __init__(self, at: np.ndarray, before: np.ndarray):
        k = len(at)
        between = np.sqrt(np.array([squared(at, c) for c in at], np.float64).reshape(k, k))
        self.at = at
        others = [np.delete(np.arange(k), i) for i in range(k)]
        self.order = [o[np.argsort(between[i, o], kind="stable")] for i, o in enumerate(others)]
        self.reach = [between[i, o] for i, o in enumerate(self.order)]
        self.half = np.array([r[0] / 2 * DOWN if len(r) else np.inf for r in self.reach])
        moved = np.sqrt(squared(at, before).astype(np.float64)) * UP
        self.moved = moved
        self.most = np.array([np.delete(moved, i).max(initial=0.0) for i in range(k)])  # that any other has moved

    def search(self, x: np.ndarray, near: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Nearest centroid, its squared distance, and the distance of the second nearest, from squared distances to `near`."""
        best, dist, second = near.copy(), own.copy(), np.full(len(x), np.inf)
        scanned = 0
        for a in np.unique(near):
            rows = np.flatnonzero(near == a)
            if not len(self.order[a]):
                continue
            radius = (2 * np.sqrt(own[rows].astype(np.float64)) + self.reach[a][0]) * UP
            rows = rows[np.argsort(-radius, kind="stable")]
            within = np.searchsorted(np.sort(-radius), -self.reach[a] * DOWN, side="right")  # rows whose ball holds each of the list
            for j, m in zip(self.order[a], within.tolist(), strict=True):
                if not m:
                    break
                some = rows[:m]
                d, was = squared(x[some], self.at[j]), dist[some]
                nearer = (d < was) | (d == was) & (j < best[some])
                second[some] = np.minimum(second[some], np.sqrt(np.where(nearer, was, d).astype(np.float64)))
                dist[some] = np.where(nearer, d, was)
                best[some] = np.where(nearer, j, best[some])
                scanned += m
        return best, dist, second * DOWN, scanned

    def assign(self, x: np.ndarray, near: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """A round's assignment from the last one's; an empty `near` means that there was none."""
        if not len(near):
            near = np.zeros(len(x), np.int32)
            upper, lower = np.full(len(x), np.inf), np.zeros(len(x))
        else:
            upper = (upper + self.moved[near]) * UP
            lower = np.maximum(lower - self.most[near], 0) * DOWN
        near, scanned = near.copy(), 0
        open_ = np.flatnonzero(upper >= np.maximum(self.half[near], lower))
        own = squared(x[open_], self.at[near[open_]])
        scanned += len(open_)
        upper[open_] = np.sqrt(own.astype(np.float64)) * UP
        still = upper[open_] >= np.maximum(self.half[near[open_]], lower[open_])
        open_, own = open_[still], own[still]
        best, dist, second, n = self.search(x[open_], near[open_], own)
        near[open_], upper[open_], lower[open_] = best, np.sqrt(dist.astype(np.float64)) * UP, second
        return near, upper, lower, scanned + n


def stage(vecs: DataFrame, dim: int, scale: int, parts: int, id_col: str, vec_col: str) -> DataFrame:
    """Kept vectors in blocks of ROWS, dealt by block."""

    def pack(batches):
        from pyspark import TaskContext

        nth, ids, xs, held = TaskContext.get().partitionId() << 32, [], [], 0

        def flush():
            nonlocal nth, ids, xs, held
            own, x = pa.concat_arrays(ids), np.concatenate(xs)
            data, width = vectors.packed(x)
            known = own.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes()
            row = (nth, len(x), own.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes(), known, width, data)
            nth, ids, xs, held = nth + 1, [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary()), strict=True)], [c.split()[0] for c in BLOCK.split(", ")])

        for b in batches:
            rows, begin, size, flat = vectors.finite(b.column(1))
            fit = size == dim
            rows, begin = rows[fit], begin[fit]
            for at in range(0, len(rows), ROWS):
                some = slice(at, at + ROWS)
                xs.append(vectors.floors(flat[begin[some, None] + np.arange(dim)], scale, LARGEST))
                ids.append(b.column(0).take(pa.array(rows[some])))
                held += len(xs[-1])
                if held >= ROWS:
                    yield flush()
        if held:
            yield flush()

    blocks = vectors.plain(vecs, id_col, vec_col).mapInArrow(shared.task(pack), BLOCK)
    return vectors.bucketed(blocks.repartition(parts, "block_id"), parts, "block_id", "vector-blocks")


def first_centroids(blocks: DataFrame, k: int, dim: int, salt: str) -> np.ndarray:
    """The k vectors of the smallest hashes of salt and id; a block proposes k at most."""

    def propose(batches):
        for r in shared.block_rows(batches):
            x, ids, known = vectors.unpacked(r["vecs"], r["width"], dim), np.frombuffer(r["ids"], "<i8"), r["known"]
            named = sorted((not ok, hashlib.sha256(f"{salt}{i}".encode()).hexdigest() if ok else "", x[j].tolist()) for j, (i, ok) in enumerate(zip(ids.tolist(), known, strict=True)))[:k]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*named, strict=True), (pa.bool_(), pa.string(), pa.list_(pa.int64())), strict=True)], ["late", "hash", "x"])

    found = blocks.select("ids", "known", "width", "vecs").mapInArrow(shared.task(propose), "late boolean, hash string, x array<long>")
    return np.array([r.x for r in found.orderBy("late", "hash", "x").limit(k).collect()], np.int64).reshape(-1, dim)


def one_round(blocks: DataFrame, state: DataFrame, centres: Centres, dim: int, parts: int, last: bool) -> DataFrame:
    """The state after a round: assignment, bounds, and for each block the counts and sums of its clusters (the last time distances)."""
    k = len(centres.at)

    def each(batches):
        for r in shared.block_rows(batches):
            x = vectors.unpacked(r["vecs"], r["width"], dim)
            near, upper, lower, scanned = centres.assign(x, np.frombuffer(r["near"], "<i4"), np.frombuffer(r["upper"], "<f8").copy(), np.frombuffer(r["lower"], "<f8").copy())
            sums, dist = np.zeros((k, dim + 1), np.int64), b""
            for j in np.unique(near):
                own = near == j
                sums[j, 0], sums[j, 1:] = own.sum(), x[own].sum(axis=0)
            if last:
                own = squared(x, centres.at[near])
                dist, sums = own.astype("<i8").tobytes(), np.zeros((k, 3), np.int64)
                sums[:, 0] = np.bincount(near, minlength=k)
                for part, values in ((1, own >> 32), (2, own & 0xFFFFFFFF)):  # halves, so that no block's sum passes 64 bits
                    np.add.at(sums[:, part], near, values)
            row = (r["block_id"], near.astype("<i4").tobytes(), upper.astype("<f8").tobytes(), lower.astype("<f8").tobytes(), dist, sums.astype("<i8").tobytes(), scanned)
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64() if isinstance(v, int) else pa.binary()) for v in row], [c.split()[0] for c in STATE.split(", ")])

    both = blocks.select("block_id", "width", "vecs").join(state.select("block_id", "near", "upper", "lower").hint("merge"), "block_id")
    return vectors.bucketed(both.mapInArrow(shared.task(each), STATE), parts, "block_id", "cluster-state")


def cluster_sums(state: DataFrame, k: int, width: int) -> np.ndarray:
    """k rows of counts and sums over all blocks, as Python integers: k * width numbers reach the driver."""

    def add(batches):
        total, room = np.zeros(k * width, np.int64), 0
        at = np.arange(k * width)

        def cells():
            some = np.flatnonzero(total)
            return pa.record_batch([pa.array(at[some]), pa.array(total[some])], ["cell", "v"])

        for r in shared.block_rows(batches):
            own = np.frombuffer(r["sums"], "<i8")
            most = int(np.abs(own).max(initial=0))
            if room + most >= 2**62:
                yield cells()
                total, room = np.zeros(k * width, np.int64), 0
            total, room = total + own, room + most
        yield cells()

    out = np.zeros(k * width, object)
    for r in vectors.summed(state.select("sums").mapInArrow(shared.task(add), "cell long, v long"), "cell").collect():
        out[r.cell] = int(r.v)
    return out.reshape(k, width)


@dataclass
class Clusters:
    """Centroids, each cluster's size and inertia, the distances measured in each round, and the assignment by block."""

    centroids: np.ndarray
    sizes: list[int]
    inertias: list[int]
    scanned: list[int]
    blocks: DataFrame
    state: DataFrame


def fit(vecs: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, salt: str = "3:", id_col: str = "vec_id", vec_col: str = "embedding") -> Clusters | None:
    """`rounds` rounds and a last assignment; None where no vector is kept."""
    parts = shared.parts(vecs.sparkSession)
    blocks = stage(vecs, dim, scale, parts, id_col, vec_col)
    at = first_centroids(blocks, k, dim, salt)
    k = len(at)
    if not k:
        return None
    none = F.lit(b"")
    state = vectors.bucketed(blocks.select("block_id", none.alias("near"), none.alias("upper"), none.alias("lower")).repartition(parts, "block_id"), parts, "block_id", "cluster-state")
    before, scanned = at, []
    for nth in range(rounds + 1):
        last = nth == rounds or nth > 0 and np.array_equal(at, before)
        old, state = state, one_round(blocks, state, Centres(at, before), dim, parts, last)
        shared.drop(old)
        total = cluster_sums(state, k, 3 if last else dim + 1)
        scanned.append(state.agg(F.sum("scanned")).first()[0])
        if last:
            break
        before, at = at, np.array([[int(v) // int(t[0]) for v in t[1:]] if t[0] else c.tolist() for t, c in zip(total, at, strict=True)], np.int64)
    inertias = [(int(hi) << 32) + int(lo) for _, hi, lo in total]
    return Clusters(at, [int(t[0]) for t in total], inertias, scanned, blocks, state)


def assignments(found: Clusters) -> DataFrame:
    """vec_id, cluster and squared distance of every kept vector."""

    def rows(batches):
        for r in shared.block_rows(batches):
            ids = pa.array(np.frombuffer(r["ids"], "<i8"), mask=np.frombuffer(r["known"], np.uint8) == 0)
            yield pa.record_batch([ids, pa.array(np.frombuffer(r["near"], "<i4")), pa.array(np.frombuffer(r["distance"], "<i8"))], ["vec_id", "cluster", "distance"])

    both = found.blocks.select("block_id", "ids", "known").join(found.state.select("block_id", "near", "distance").hint("merge"), "block_id")
    return both.mapInArrow(shared.task(rows), "vec_id long, cluster int, distance long")


def clusters(vecs: DataFrame, **options) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    found = fit(vecs, **options)
    if found is None:
        return vecs.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    total = sum(found.inertias)
    if total >= 2**63:
        raise OverflowError("the inertia is beyond 64 bits")
    told = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids.tolist()]
    of = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster") + 1)
    return assignments(found).select("*", of(found.inertias, "long").alias("cluster_inertia"), F.lit(total).cast("long").alias("inertia"), of(told, "string").alias("centroid_sha256"))
