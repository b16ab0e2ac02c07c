"""Whitening of embeddings from a tiled covariance.

Vectors become integer rows, in blocks of rows, and a block is cut into column
blocks of TILE dimensions.  Column blocks are dealt by row block, once, into
buckets; there every pair of column blocks of a row block (a tile of the
covariance, named by its two column blocks) meets without another shuffle and
is multiplied, each task adds up what it has for a tile, and Spark sums the
tiles' cells.  The driver gets dims * (dims + 1) / 2 numbers, puts the matrix
together and takes its eigenvectors: `most_dims` is the bound of that.

Everything up to the matrix is exact.  Rows are centred before they are
multiplied, by the integer next to each dimension's mean, which leaves sums of
small integers; what the fraction of the mean adds is taken off at the end.
Whitened values are written once; their own covariance, from those rows, gives
the identity error.

Defined cases: null vectors and such with a null or non-finite entry are left
out; shorter vectors count as padded with zero entries; null ids and rows that
share one are rows like any other; components whose eigenvalue can't be told
from 0 in doubles aren't returned, so equal rows, a single row and an empty table
give no rows; entries of 2**49 or more after scaling, products beyond 64 bits and,
in `report`, deviations beyond 64 bits raise OverflowError; more dimensions than
`most_dims` raise ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, vectors
from .vector_search import products

TILE = 32
BLOCK_ENTRIES = 1 << 18
LARGEST = 2.0**49
COLUMN = "block_id long, col int, n int, width int, ids binary, known binary, data binary"
ROWS = "block_id long, n int, ids binary, known binary, deviation binary, whitened binary, moments binary"
_TYPES = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _line(schema: str, *row) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], _TYPES[t]) for v, (_, t) in zip(row, fields, strict=True)], [n for n, _ in fields])


class Cells:
    """Sums of arrays of integers, by name, given out as (name, cell, v) before they could pass 64 bits."""

    NAMES = "tile int, cell int, v long"

    def __init__(self):
        self.totals: dict[int, np.ndarray] = {}
        self.room = 0

    def out(self) -> Iterator[pa.RecordBatch]:
        for name, total in self.totals.items():
            some = np.flatnonzero(total)
            yield pa.record_batch([pa.array(np.full(len(some), name), pa.int32()), pa.array(some, pa.int32()), pa.array(total.ravel()[some])], ["tile", "cell", "v"])
        self.totals, self.room = {}, 0

    def add(self, name: int, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        most = int(np.abs(x).max(initial=0))
        if self.room + most >= 2**62:
            yield from self.out()
        self.room += most
        self.totals[name] = self.totals[name] + x if name in self.totals else x


def dimensions(vecs: DataFrame) -> int:
    """The largest length among vectors that count."""

    def each(batches):
        for b in batches:
            _, _, size, _ = vectors.finite(b.column(0))
            yield pa.record_batch([pa.array([int(size.max(initial=0))])], ["dims"])

    return vecs.select("x").mapInArrow(shared.task(each), "dims long").agg(F.max("dims")).first()[0] or 0


def column_blocks(vecs: DataFrame, dims: int, scale: int, shift: int, parts: int) -> DataFrame:
    """floor(scale * entry) + shift in column blocks, dealt by row block; ids go with the first column block."""
    most = max(64, BLOCK_ENTRIES // dims)

    def pack(batches):
        from pyspark import TaskContext

        nth, held, size = TaskContext.get().partitionId() << 32, [], 0

        def flush():
            nonlocal nth, held, size
            ids, x = pa.concat_arrays([i for i, _ in held]), np.concatenate([v for _, v in held])
            for col in range(0, dims, TILE):
                data, width = vectors.packed(x[:, col : col + TILE])
                own = (ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes(), ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes()) if not col else (b"", b"")
                yield _line(COLUMN, nth, col // TILE, len(x), width, *own, data)
            nth, held, size = nth + 1, [], 0

        for b in batches:
            rows, begin, length, flat = vectors.finite(b.column(1))
            for at in range(0, len(rows), most):
                some = slice(at, at + most)
                place = begin[some, None] + np.arange(dims)
                inside = np.arange(dims) < length[some, None]
                x = vectors.floors(np.where(inside, flat[np.where(inside, place, 0)], 0.0) if len(flat) else np.zeros(inside.shape), scale, LARGEST) + shift
                held.append((b.column(0).take(pa.array(rows[some])), x))
                size += len(x)
                if size >= most:
                    yield from flush()
        if held:
            yield from flush()

    return vectors.bucketed(vecs.mapInArrow(shared.task(pack), COLUMN).repartition(parts, "block_id"), parts, "block_id", "column-blocks")


def totals(cols: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Number of rows and each dimension's exact sum."""

    def each(batches):
        sums = Cells()
        for r in shared.block_rows(batches):
            x = vectors.unpacked(r["data"], r["width"], min(TILE, dims - r["col"] * TILE))
            yield from sums.add(r["col"], x.sum(axis=0))
            if not r["col"]:
                yield from sums.add(-1, np.array([r["n"]]))
        yield from sums.out()

    cells = vectors.summed(cols.select("col", "n", "width", "data").mapInArrow(shared.task(each), Cells.NAMES), "tile", "cell").collect()
    n, sums = 0, [0] * dims
    for r in cells:
        if r.tile < 0:
            n = int(r.v)
        else:
            sums[r.tile * TILE + r.cell] = int(r.v)
    return n, sums


def middles(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The integer next to each mean, what n of them leave of the sum, and that as a fraction of n."""
    mid = [(2 * s + n) // (2 * n) for s in sums]
    left = [s - n * m for s, m in zip(sums, mid, strict=True)]
    return np.array(mid, np.int64), np.array(left, np.int64), np.array([v / n for v in left])


def tile_pairs(cols: DataFrame) -> DataFrame:
    """Every two column blocks of a row block, once; both sides lie in the same buckets."""
    a = cols.select("block_id", F.col("col").alias("i"), F.col("width").alias("wi"), F.col("data").alias("xi"))
    b = cols.select("block_id", F.col("col").alias("j"), F.col("width").alias("wj"), F.col("data").alias("xj"))
    return a.join(b.hint("merge"), "block_id").where("i <= j")


def covariance(cols: DataFrame, dims: int, n: int, sums: list[int]) -> np.ndarray:
    """The covariance over all rows, from exact sums of tiles."""
    mid, _, rest = middles(n, sums)
    across = -(-dims // TILE)

    def multiply(batches):
        cells = Cells()
        for r in shared.block_rows(batches):
            i, j = r["i"], r["j"]
            of = lambda c, width, data: vectors.unpacked(data, width, min(TILE, dims - c * TILE)) - mid[c * TILE : (c + 1) * TILE]
            tile = np.zeros((TILE, TILE), np.int64)
            own = products(of(i, r["wi"], r["xi"]).T, of(j, r["wj"], r["xj"]).T)
            tile[: own.shape[0], : own.shape[1]] = own
            yield from cells.add(i * across + j, np.triu(tile) if i == j else tile)
        yield from cells.out()

    found = vectors.summed(tile_pairs(cols).select("i", "j", "wi", "wj", "xi", "xj").mapInArrow(shared.task(multiply), Cells.NAMES), "tile", "cell").select("tile", "cell", F.col("v").cast("double").alias("v")).toArrow()
    tile, cell, v = (found[c].to_numpy() for c in ("tile", "cell", "v"))
    out = np.zeros((dims, dims))
    out[tile // across * TILE + cell // TILE, tile % across * TILE + cell % TILE] = v
    out += np.triu(out, 1).T
    return out / n - np.outer(rest, rest)


@dataclass
class Whitened:
    """What whitening found: eigenvalues and unit eigenvectors (columns), their shares, the identity error, and the rows."""

    n: int
    values: np.ndarray
    vectors: np.ndarray
    explained: list[float]
    identity_error: float
    rows: DataFrame


def fit(vecs: DataFrame, components: int = 8, scale: int = 1024, shift: int = 100_000, exact: bool = False, most_dims: int = 4096, id_col: str = "vec_id", vec_col: str = "embedding") -> Whitened | None:
    """Whitens all rows; with `exact`, each row's deviation too.  None where there is nothing to whiten."""
    given, parts = vectors.plain(vecs, id_col, vec_col), shared.parts(vecs.sparkSession)
    dims = dimensions(given)
    if dims > most_dims:
        raise ValueError(f"{dims} dimensions; the matrix is meant for {most_dims} at most")
    if not dims:
        return None
    cols = column_blocks(given, dims, scale, shift, parts)
    n, sums = totals(cols, dims)
    matrix = covariance(cols, dims, n, sums)
    values, axes = np.linalg.eigh(matrix)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(components, int((values > 16 * dims * np.finfo(float).eps * max(values[0], 0)).sum()))
    if not k:
        return None
    values, axes, trace = values[:k], axes[:, :k], float(np.trace(matrix))
    mid, left, rest = middles(n, sums)
    turn = axes / np.sqrt(values)

    def project(batches):
        for r in shared.block_rows(batches):
            w, dev = np.zeros((r["cols"][0]["n"], k)), np.zeros(r["cols"][0]["n"], np.int64)
            for c in r["cols"]:
                own = slice(c["col"] * TILE, min((c["col"] + 1) * TILE, dims))
                z = vectors.unpacked(c["data"], c["width"], own.stop - own.start) - mid[own]
                w += (z - rest[own]) @ turn[own]
                dev = dev + _squares(z, n, left[own]) if exact else dev
                if (dev < 0).any():
                    raise OverflowError("a deviation is beyond 64 bits")
            moments = np.concatenate([[w.sum(axis=0)], w.T @ w])
            yield _line(ROWS, r["block_id"], len(w), r["cols"][0]["ids"], r["cols"][0]["known"], dev.astype("<i8").tobytes() if exact else b"", w.astype("<f8").tobytes(), moments.astype("<f8").tobytes())

    # a row block's column blocks are few, and already lie together
    whole = cols.groupBy("block_id").agg(F.sort_array(F.collect_list(F.struct("col", "n", "width", "ids", "known", "data"))).alias("cols"))
    rows = shared.staged(whole.mapInArrow(shared.task(project), ROWS), "whitened")
    shared.drop(cols)

    def add(batches):
        total = sum((np.frombuffer(r["moments"], "<f8") for r in shared.block_rows(batches)), np.zeros((k + 1) * k))
        yield pa.record_batch([pa.array(range(len(total)), pa.int32()), pa.array(total)], ["cell", "v"])

    moments = np.zeros((k + 1) * k)
    for r in rows.select("moments").mapInArrow(shared.task(add), "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect():
        moments[r.cell] = r.v / n
    mean, second = moments[:k], moments[k:].reshape(k, k)
    error = float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())
    return Whitened(n, values, axes, [float(v) / trace for v in values], error, rows)


def _squares(z: np.ndarray, n: int, left: np.ndarray) -> np.ndarray:
    """Sums over dimensions of (n * z - left)**2, which is (n * x - S)**2."""
    most = n * float(np.abs(z).max(initial=0)) + float(np.abs(left).max(initial=0))
    if most * most * max(z.shape[1], 1) >= 2**62:
        exact = [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, left, strict=True)) for row in z]
        if any(v >= 2**62 for v in exact):
            raise OverflowError("a deviation is beyond 64 bits")
        return np.array(exact, np.int64)
    y = n * z - left
    return np.einsum("ij,ij->i", y, y)


def whiten(vecs: DataFrame, **options) -> DataFrame:
    """vec_id and its whitened values, an array of as many as there are components."""
    found = fit(vecs, **options)
    if found is None:
        return vecs.sparkSession.createDataFrame([], "vec_id long, whitened array<double>")
    k = len(found.values)

    def rows(batches):
        for r in shared.block_rows(batches):
            at = pa.array(np.arange(0, (r["n"] + 1) * k, k, dtype=np.int32))
            yield pa.record_batch([_ids(r), pa.ListArray.from_arrays(at, pa.array(np.frombuffer(r["whitened"], "<f8")))], ["vec_id", "whitened"])

    return found.rows.select("n", "ids", "known", "whitened").mapInArrow(shared.task(rows), "vec_id long, whitened array<double>")


def _ids(r: dict) -> pa.Array:
    return pa.array(np.frombuffer(r["ids"], "<i8"), mask=np.frombuffer(r["known"], np.uint8) == 0)


REPORT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def report(vecs: DataFrame, **options) -> DataFrame:
    """A row for each vector and component, with what the whole whitening came to."""
    found = fit(vecs, exact=True, **options)
    if found is None:
        return vecs.sparkSession.createDataFrame([], REPORT)
    k, n, share, error = len(found.values), found.n, np.array(found.explained), found.identity_error

    def rows(batches):
        for r in shared.block_rows(batches):
            m = r["n"]
            each = np.repeat(np.arange(m), k)
            yield pa.record_batch(
                [_ids(r).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), pa.array(np.frombuffer(r["deviation"], "<i8")[each]), pa.array(np.frombuffer(r["whitened"], "<f8")), pa.array(np.tile(share, m)), pa.array(np.full(m * k, error))],
                [c.split()[0] for c in REPORT.split(", ")],
            )

    return found.rows.select("n", "ids", "known", "deviation", "whitened").mapInArrow(shared.task(rows), REPORT)
