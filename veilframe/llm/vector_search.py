"""Exact top-k by inner product over a pivot-distance index.

With M the largest squared norm, a vector x gets one more component,
sqrt(M - |x|^2), and a query a zero; then d(q, x)^2 = |q|^2 + M - 2 q.x, so the
largest products are the nearest vectors and the triangle inequality holds.
Vectors are keyed by nearest pivot and their distance to it and sorted by that
key; a block of neighbours in this order is an annulus [dmin, dmax] around one
pivot, and |d(q, p) - d(x, p)| bounds d(q, x) from below for the whole block.

Distinct query vectors are searched once.  Each first searches the part whose
annuli lie nearest, which gives its k-th score; then it visits only parts with
an annulus that the bound leaves open, expanding them outwards and stopping
when the bound of the next is worse than the k-th score.  Distances are floats
and get a slack that follows the largest norm; scores are exact integers.
Pivots come from at most `sample` vectors (a documented bound; they change
speed, not results); every row is indexed.  Of equal vectors a part keeps the
k + 1 first in order: any other is beaten by k of them whatever the query, its
own row left out.

Defined cases: null vectors, null ids, and vectors with a null or non-finite
component take no part; components or scores beyond 64 bits raise
OverflowError; shorter vectors count as padded with zeros; rows that share an
id are rows of their own, as queries and as candidates; a row is left out of
its own result only; fewer than k candidates give fewer rows; an empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared

ROWS = "part int, kind int, pivot int, dmin double, dmax double, ids binary, own binary, vecs binary, least binary"
_NAMES = [c.split()[0] for c in ROWS.split(", ")]
_LOW = np.iinfo(np.int64).min


def quantised(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """row (a number of its own), vec_id and floor(256 * component) as packed 64-bit integers."""
    x = F.col(vec_col)
    plain = vectors.filter(F.col(id_col).isNotNull() & x.isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), x.cast("array<double>").alias("x"))

    def each(batches):
        from pyspark import TaskContext

        nth = TaskContext.get().partitionId() << 40
        for b in batches:
            col = b.column(1)
            offs = np.asarray(col.offsets, np.int64)
            flat = col.values.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become nan
            rows, ids, vecs = [], [], []
            for i, vid in enumerate(b.column(0).to_pylist()):
                v = flat[offs[i] : offs[i + 1]]
                if np.isfinite(v).all():
                    with np.errstate(over="ignore"):
                        c = np.floor(256 * v)
                    if not (np.abs(c) < 2.0**63).all():
                        raise OverflowError(f"vector {vid} has a component beyond 64 bits")
                    rows.append(nth)
                    ids.append(vid)
                    vecs.append(c.astype("<i8").tobytes())
                    nth += 1
            yield pa.record_batch([pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), pa.array(vecs, pa.binary())], ["row", "vec_id", "v"])

    return plain.mapInArrow(shared.task(each), "row long, vec_id long, v binary")


def matrix(rows: list[bytes], dim: int) -> np.ndarray:
    """Packed vectors as rows of 64-bit integers, padded with zeros."""
    if all(len(r) == 8 * dim for r in rows):
        return np.frombuffer(b"".join(rows), "<i8").reshape(len(rows), dim)
    out = np.zeros((len(rows), dim), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r) // 8] = np.frombuffer(r, "<i8")
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of integer rows: in doubles below 2**53, in 64 bits below 2**62, else in Python integers."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if top < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if top < 2**62:
        return a @ b.T
    exact = a.astype(object) @ b.T.astype(object)
    if any(abs(x) >= 2**63 - 1 for x in exact.ravel()):
        raise OverflowError("a score is beyond 64 bits")
    return exact.astype(np.int64)


def lifted(x: np.ndarray, top: float) -> np.ndarray:
    x = x.astype(np.float64)
    return np.concatenate([x, np.sqrt(np.maximum(top - (x * x).sum(axis=1), 0))[:, None]], axis=1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T, 0))


def pivots_of(sample: np.ndarray, n: int, rounds: int = 5) -> np.ndarray:
    """A few rounds of k-means over the sample."""
    c = sample[np.linspace(0, len(sample) - 1, min(n, len(sample))).astype(int)]
    for _ in range(rounds):
        near = distances(sample, c).argmin(axis=1)
        c = np.array([sample[near == i].mean(axis=0) if (near == i).any() else c[i] for i in range(len(c))])
    return c


def best_of(score: np.ndarray, ids: np.ndarray, own: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first n columns of each row by score, then id, then row number."""
    floor = np.partition(score, -n, axis=1)[:, -n] if score.shape[1] > n else np.full(len(score), _LOW)
    r, c = np.nonzero(score >= floor[:, None])
    order = np.lexsort((own[r, c], ids[r, c], -np.maximum(score[r, c], _LOW + 1), r))
    r, c = r[order], c[order]
    nth = np.arange(len(r)) - np.searchsorted(r, r, side="left")
    r, c, nth = r[nth < n], c[nth < n], nth[nth < n]
    out = np.full((len(score), n), _LOW), np.zeros((len(score), n), np.int64), np.zeros((len(score), n), np.int64)
    for x, y in zip(out, (score, ids, own), strict=True):
        x[r, nth] = y[r, c]
    return out


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, pivots: int = 48, sample: int = 4000, block: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best of each row whose id is divisible by `every`."""
    spark = vectors.sparkSession
    vecs = shared.staged(quantised(vectors, id_col, vec_col), "vectors")

    def extremes(batches):
        for b in batches:
            if b.num_rows:
                dim = max(len(v.as_buffer()) for v in b.column(0)) // 8
                x = np.abs(matrix(b.column(0).to_pylist(), dim)).astype(np.float64)
                yield pa.record_batch([pa.array([dim]), pa.array([float(x.max(initial=0))]), pa.array([float((x * x).sum(axis=1).max())])], ["dim", "most", "norm"])

    ends = vecs.select("v").mapInArrow(shared.task(extremes), "dim long, most double, norm double").agg(F.max("dim").alias("dim"), F.max("most").alias("most"), F.max("norm").alias("norm")).first()
    if ends.dim is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim, kind = max(ends.dim, 1), "<i4" if ends.most < 2**31 else "<i8"
    top = ends.norm * (1 + 1e-12) + 1e-9
    # rounding of a squared distance, a distance and a product, for vectors of norm up to sqrt(top)
    squared = 8 * (dim + 8) * 2.0**-53 * top
    slack, rough = 2 * (squared**0.5 + 2.0**-23 * top**0.5), 8 * squared
    some = vecs.orderBy(F.xxhash64("row")).limit(sample).select("v").collect()  # a bounded sample, to place the pivots
    centres = pivots_of(lifted(matrix([bytes(r.v) for r in some], dim), top), pivots)

    def keyed(batches):
        for b in batches:
            x = matrix(b.column(2).to_pylist(), dim)
            d = distances(lifted(x, top), centres)
            p = d.argmin(axis=1)
            near = d[np.arange(len(p)), p].astype(np.float32).astype(np.float64)
            yield pa.record_batch([b.column(0), b.column(1), pa.array([r.tobytes() for r in x.astype(kind)], pa.binary()), pa.array(p.astype(np.int32)), pa.array(near)], ["row", "vec_id", "v", "pivot", "dist"])

    n_parts = shared.parts(spark)

    def line(part, kind_, pivot, lo, hi, ids, own, vecs_, least=b""):
        kinds = [pa.int32()] * 3 + [pa.float64()] * 2 + [pa.binary()] * 4
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((part, kind_, pivot, lo, hi, ids, own, vecs_, least), kinds, strict=True)], _NAMES)

    def blocks(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        tables = [b for b in batches if b.num_rows]
        if not tables:
            return
        t = pa.Table.from_batches(tables).sort_by([(c, "ascending") for c in ("pivot", "dist", "v", "vec_id", "row")]).combine_chunks()
        v = t["v"].to_pylist()
        keep, run = [], 0
        for i in range(len(v)):
            run = run + 1 if i and v[i] == v[i - 1] else 0
            if run <= k:
                keep.append(i)
        p, d, ids, own = (t[c].to_numpy()[keep] for c in ("pivot", "dist", "vec_id", "row"))
        v = [v[i] for i in keep]
        at = 0
        while at < len(p):
            to = min(at + block, int(np.searchsorted(p, p[at], side="right")))
            yield line(part, 0, int(p[at]), d[at], d[at:to].max(), ids[at:to].astype("<i8").tobytes(), own[at:to].astype("<i8").tobytes(), b"".join(v[at:to]))
            at = to

    dealt = vecs.mapInArrow(shared.task(keyed), "row long, vec_id long, v binary, pivot int, dist double").repartitionByRange(n_parts, "pivot", "dist", "vec_id", "row")
    index = shared.staged(dealt.mapInArrow(shared.task(blocks), ROWS), "pivot-index")
    # a part's annuli: at most one row for each part and pivot that meet, that is parts + pivots rows
    rings = index.groupBy("part", "pivot").agg(F.min("dmin").alias("lo"), F.max("dmax").alias("hi")).orderBy("part", "pivot").collect()
    r_part, r_piv = np.array([r.part for r in rings]), np.array([r.pivot for r in rings])
    r_lo, r_hi = np.array([r.lo for r in rings]), np.array([r.hi for r in rings])
    last = int(r_part.max()) + 1

    def bounds(q, piv, lo, hi):
        """Largest product that each query can have with a vector of each annulus."""
        q = q.astype(np.float64)
        dq = distances(np.concatenate([q, np.zeros((len(q), 1))], axis=1), centres)[:, piv]
        low = np.maximum(np.maximum(dq - hi, lo - dq) - slack, 0)
        return ((q * q).sum(axis=1)[:, None] + top - low * low) / 2 + rough

    def route(home: bool):
        def each(batches):
            for b in batches:
                if not b.num_rows:
                    continue
                name, q = b.column(0).to_numpy(), matrix(b.column(1).to_pylist(), dim)
                ub = bounds(q, r_piv, r_lo, r_hi)
                best = r_part[ub.argmax(axis=1)]
                if home:
                    goes = {int(p): np.flatnonzero(best == p) for p in np.unique(best)}
                    least = np.full(len(q), _LOW)
                else:
                    least = b.column(2).fill_null(int(_LOW)).to_numpy(zero_copy_only=False)
                    open_ = ub >= least[:, None]
                    goes = {int(p): np.flatnonzero(open_[:, r_part == p].any(axis=1) & (best != p)) for p in np.unique(r_part)}
                for p, i in goes.items():
                    for at in range(0, len(i), 512):
                        j = i[at : at + 512]
                        yield line(p, 1, 0, 0.0, 0.0, b"", name[j].astype("<i8").tobytes(), q[j].astype(kind).tobytes(), least[j].astype("<i8").tobytes())

        return each

    def probe(batches):
        held = []
        for r in shared.block_rows(batches):
            own, v = np.frombuffer(r["own"], "<i8"), np.frombuffer(r["vecs"], kind).reshape(-1, dim)
            if not r["kind"]:
                held.append((r["pivot"], r["dmin"], r["dmax"], np.frombuffer(r["ids"], "<i8"), own, v))
                continue
            if not held:
                continue
            least, v = np.frombuffer(r["least"], "<i8").copy(), v.astype(np.int64)
            ub = bounds(v, *(np.array([h[j] for h in held]) for j in range(3)))
            best = np.full((len(own), k + 1), _LOW), np.zeros((len(own), k + 1), np.int64), np.zeros((len(own), k + 1), np.int64)
            for j in np.argsort(-ub.max(axis=0), kind="stable"):  # annuli from the nearest outwards
                i = np.flatnonzero(ub[:, j] >= least)
                if not len(i):
                    continue
                s = products(v[i], held[j][5].astype(np.int64))
                wide = [np.concatenate([x[i], np.broadcast_to(y, s.shape)], axis=1) for x, y in zip(best, (s, held[j][3], held[j][4]), strict=True)]
                for x, y in zip(best, best_of(*wide, k + 1), strict=True):
                    x[i] = y
                least = np.maximum(least, best[0][:, k])
            a, b = np.nonzero((best[0] != _LOW) & (best[0] >= np.frombuffer(r["least"], "<i8")[:, None]))
            yield pa.record_batch([pa.array(own[a]), *(pa.array(x[a, b]) for x in best)], ["q", "score", "vec_id", "row"])

    def visit(routed):
        both = index.unionByName(routed).repartitionById(last, F.col("part")).sortWithinPartitions("kind")
        return both.mapInArrow(shared.task(probe), "q long, score long, vec_id long, row long")

    queries = vecs.filter(F.col("vec_id") % every == 0)
    distinct = shared.staged(queries.groupBy("v").agg(F.min("row").alias("q")).select("q", "v"), "query-vectors")
    first = shared.staged(visit(distinct.mapInArrow(shared.task(route(True)), ROWS)), "nearest-part")
    kth = first.groupBy("q").agg(F.when(F.count("*") > k, F.min("score")).alias("least"))
    rest = visit(distinct.join(kth, "q", "left").select("q", "v", "least").mapInArrow(shared.task(route(False)), ROWS))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id", "row")
    best = first.unionByName(rest).withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k + 1)
    lists = best.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("nth", "score", "vec_id", "row"))).alias("best"))  # k + 1 at most
    found = shared.staged(distinct.join(lists, "q").select("v", "best"), "query-results")
    others = F.slice(F.filter("best", lambda x: x["row"] != F.col("row")), 1, k)
    return queries.join(found, "v").select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("pos", "x")).select("query_id", (F.col("pos") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
