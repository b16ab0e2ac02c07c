"""k-means and whitening against brute force, on real vectors and on odd ones."""

import hashlib
import math
import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veilframe.llm import clustering, vectors, whitening

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, cluster string, n string"  # with names that clash with results


def odd_vectors(dim=64, n=60, seed=3):
    rng = random.Random(seed)
    v = lambda: [rng.choice([rng.gauss(0, 0.1), 0.25, -0.25]) for _ in range(dim)]
    same, grid = v(), [0.0] * dim
    rows = [(i, v()) for i in range(n)] + [(n + i, same) for i in range(9)] + [(n, same), (n + 3, v()), (None, v()), (None, same), (None, None)]
    rows += [(200, None), (201, []), (202, [0.5] * (dim - 1)), (203, [0.5] * (dim + 1)), (204, [float("nan")] + grid[1:]), (205, [float("inf")] + grid[1:]), (206, [None] + grid[1:]), (-7, grid), (-8, [-1.0] * dim)]
    return [(*r, "clash", "clash") for r in rows]


def kept(rows, dim):
    return [(i, [math.floor(1024 * c) for c in v]) for i, v, *_ in rows if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]


def brute_clusters(rows, k=8, rounds=10, dim=64):
    own = kept(rows, dim)
    named = sorted((i is None, hashlib.sha256(f"3:{i}".encode()).hexdigest() if i is not None else "", v) for i, v in own)
    cs = [v for _, _, v in named[:k]]
    square = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    assign = lambda: [min((square(v, c), j) for j, c in enumerate(cs)) for _, v in own]
    for _ in range(rounds):
        near = assign()
        for j in range(len(cs)):
            mine = [v for (_, v), (_, a) in zip(own, near, strict=True) if a == j]
            if mine:
                cs[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    near = assign()
    inertia = [sum(d for d, a in near if a == j) for j in range(len(cs))]
    return sorted(str((i, a, d, inertia[a], sum(inertia), hashlib.sha256(",".join(map(str, cs[a])).encode()).hexdigest())) for (i, _), (d, a) in zip(own, near, strict=True))


def shown(df):
    assert df.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted(str(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("n", [60, 2])
def test_clusters_of_odd_rows(spark, n, monkeypatch):
    monkeypatch.setattr(clustering, "ROWS", 16)
    rows = odd_vectors(n=n)
    assert shown(clustering.clusters(spark.createDataFrame(rows, SCHEMA).repartition(3))) == brute_clusters(rows)


def test_clusters_of_real_rows(spark):
    vecs = spark.read.parquet(f"{SF}/embeddings.parquet")
    want = brute_clusters([(r.vec_id, r.embedding) for r in vecs.collect()])
    assert shown(clustering.clusters(vecs)) == want


@pytest.mark.parametrize("rows", [[], [(1, None, "", "")], [(1, [0.5] * 64, "", "")], [(1, [0.5] * 64, "", "")] * 20])
def test_few_vectors(spark, rows):
    assert shown(clustering.clusters(spark.createDataFrame(rows, SCHEMA))) == brute_clusters(rows)


def test_rounds_without_a_move_end_early(spark):
    rows = [(i, [float(i % 3)] * 4, "", "") for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = clustering.fit(df, k=3, rounds=10, dim=4)
    assert len(found.scanned) < 11
    assert shown(clustering.clusters(df, k=3, dim=4)) == brute_clusters(rows, 3, 10, 4)


def test_large_components(spark):
    rows = [(i, [float(3 * 10**5 * ((i * j) % 7 - 3)), i / 7], "", "") for i, j in zip(range(50), range(3, 53))]
    assert shown(clustering.clusters(spark.createDataFrame(rows, SCHEMA), k=5, dim=2)) == brute_clusters(rows, 5, 10, 2)
    with pytest.raises(Exception, match="beyond 64 bits"):
        clustering.clusters(spark.createDataFrame([(1, [1e11], "", ""), (2, [-1e11], "", "")], SCHEMA), k=1, dim=1)
    with pytest.raises(Exception, match="too large"):
        clustering.clusters(spark.createDataFrame([(1, [1e300], "", "")], SCHEMA), k=1, dim=1)


@settings(max_examples=150, deadline=None)
@given(data=st.data())
def test_assignment_by_balls_is_the_plain_one(data):
    """Small grids are full of ties: between centroids, on radii, and of second nearest."""
    seed, n, k, dim, span = (data.draw(st.integers(a, b)) for a, b in ((0, 10**6), (1, 40), (1, 9), (1, 3), (1, 6)))
    rng = np.random.default_rng(seed)
    x = rng.integers(-span, span + 1, (n, dim))
    at = rng.integers(-span, span + 1, (k, dim))
    near, upper, lower, before = np.zeros(0, np.int32), np.zeros(0), np.zeros(0), at
    for _ in range(6):
        near, upper, lower, _ = clustering.Centres(at, before).assign(x, near, upper, lower)
        d = ((x[:, None] - at) ** 2).sum(axis=2)
        assert np.array_equal(near, d.argmin(axis=1))
        own = np.sqrt(d[np.arange(n), near])
        d[np.arange(n), near] = 10**9
        assert (upper >= own).all() and (lower <= np.sqrt(d.min(axis=1))).all()
        before, at = at, at + rng.integers(-1, 2, (k, dim)) * rng.integers(0, 2, (k, 1))


def test_bounds_spare_distances():
    rng = np.random.default_rng(4)
    centres = rng.integers(-10**5, 10**5, (100, 8))
    x = np.repeat(centres, 200, axis=0) + rng.integers(-3000, 3000, (20_000, 8))
    near, upper, lower, first = clustering.Centres(centres, centres).assign(x, np.zeros(0, np.int32), np.zeros(0), np.zeros(0))
    moved = centres + rng.integers(-50, 50, centres.shape)
    again, _, _, then = clustering.Centres(moved, centres).assign(x, near, upper, lower)
    assert np.array_equal(again, near) and then < 0.02 * len(x) * len(centres) < first


def test_rounds_do_not_shuffle_vectors(spark, capsys):
    vecs = spark.read.parquet(f"{SF}/embeddings.parquet")
    found = clustering.fit(vecs, rounds=1)
    plan = found.blocks.select("block_id", "vecs").join(found.state.select("block_id", "near").hint("merge"), "block_id")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert len(found.scanned) == 2 and sum(found.sizes) == 500 and clustering.assignments(found).count() == 500


def test_finite_rows_of_a_sliced_column():
    col = pa.array([[9.0], [1.0, 2.0], None, [], [float("nan")], [None], [3.0, float("inf")], [4.0]], pa.list_(pa.float64())).slice(1)
    rows, begin, size, flat = vectors.finite(col)
    assert rows.tolist() == [0, 2, 6] and [flat[b : b + s].tolist() for b, s in zip(begin, size, strict=True)] == [[1.0, 2.0], [], [4.0]]


def plain_whitening(rows, components=8):
    """The contract in doubles and Python integers, for rows of any length."""
    own = [(i, v) for i, v, *_ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dims = max((len(v) for _, v in own), default=0)
    x = [[math.floor(1024 * c) + 100000 for c in [*v, *[0.0] * (dims - len(v))]] for _, v in own]
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    z = np.array([[float(Fraction(a * n - t, n)) for a, t in zip(r, s, strict=True)] for r in x])
    cov = z.T @ z / n
    e, axes = np.linalg.eigh(cov)
    e, axes = e[::-1][:components], axes[:, ::-1][:, :components]
    deviation = [sum((n * a - t) ** 2 for a, t in zip(r, s, strict=True)) for r in x]
    return [i for i, _ in own], deviation, z, cov, e, axes


def assert_whitened(got, rows, components=8):
    ids, deviation, z, cov, e, axes = plain_whitening(rows, components)
    k = len(e)
    assert Counter((r.vec_id, r.component, r.n, r.deviation) for r in got) == Counter((i, c, len(ids), d) for i, d in zip(ids, deviation, strict=True) for c in range(1, k + 1))
    by = defaultdict(list)
    for r in got:
        by[r.component].append((str(r.vec_id), r.deviation, r.whitened))
        assert abs(r.explained / (e[r.component - 1] / np.trace(cov)) - 1) < 1e-9 and r.identity_error == got[0].identity_error < 1e-9
    for c, values in by.items():
        want = z @ axes[:, c - 1] / math.sqrt(e[c - 1])
        a = sorted(values)
        errors = []
        for sign in (1, -1):
            b = sorted((str(i), d, sign * w) for i, d, w in zip(ids, deviation, want, strict=True))
            errors.append(max(abs(p[2] - q[2]) for p, q in zip(a, b, strict=True)))
        assert min(errors) < 1e-6


@pytest.mark.parametrize("dim", [64, 33, 3])
def test_whitening_of_odd_rows(spark, dim, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_ENTRIES", 1)  # 64 rows a block
    rows = odd_vectors(dim, 300)
    got = whitening.report(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert_whitened(got.collect(), rows, min(8, dim + 1))


def test_whitening_of_real_rows(spark):
    vecs = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert_whitened(whitening.report(vecs).collect(), [(r.vec_id, r.embedding) for r in vecs.collect()])


@pytest.mark.parametrize("rows", [[], [(1, None, "", "")], [(1, [], "", "")], [(1, [0.5] * 9, "", "")], [(1, [0.5] * 9, "", "")] * 20])
def test_nothing_to_whiten(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    assert whitening.report(df).collect() == [] and whitening.whiten(df).collect() == []


def test_components_end_with_the_rank(spark):
    rows = [(i, [float(i % 5), 2.0 * (i % 5), float(i % 3), 7.0], "", "") for i in range(45)]
    got = whitening.report(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.component for r in got} == {1, 2}
    assert_whitened(got, rows, 2)


def test_whitened_arrays(spark):
    vecs = spark.read.parquet(f"{SF}/embeddings.parquet")
    w = np.array([r.whitened for r in whitening.whiten(vecs, components=20).collect()])
    assert w.shape == (500, 20) and np.abs(w.T @ w / 500 - np.eye(20)).max() < 1e-9


def test_whitening_limits(spark):
    make = lambda v: spark.createDataFrame([(i, [x], "", "") for i, x in enumerate(v)], SCHEMA)
    with pytest.raises(Exception, match="beyond 64 bits"):
        whitening.report(make([1e8, 0.0, -1e8]))
    assert whitening.whiten(make([1e5, 0.0, -1e5])).count() == 3
    with pytest.raises(Exception, match="too large"):
        whitening.report(make([1e300]))
    with pytest.raises(ValueError, match="dimensions"):
        whitening.fit(spark.createDataFrame([(1, [0.0] * 9, "", "")], SCHEMA), most_dims=8)


def test_tiles_meet_without_a_shuffle(spark):
    vecs = vectors.plain(spark.read.parquet(f"{SF}/embeddings.parquet"), "vec_id", "embedding")
    cols = whitening.column_blocks(vecs, 64, 1024, 100_000, 4)
    plan = whitening.tile_pairs(cols)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert {(r.i, r.j) for r in whitening.tile_pairs(cols).select("i", "j").collect()} == {(0, 0), (0, 1), (1, 1)}


def test_cells_never_pass_64_bits():
    cells, out = whitening.Cells(), []
    for _ in range(9):
        out += cells.add(3, np.array([2**61, 0, -(2**60)]))
    out += cells.out()
    total = defaultdict(int)
    for b in out:
        for t, c, v in zip(*(x.to_pylist() for x in b.columns), strict=True):
            total[t, c] += v
    assert total == {(3, 0): 9 * 2**61, (3, 2): -9 * 2**60}
