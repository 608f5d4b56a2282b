import math
from fractions import Fraction

import numpy as np
import pytest
from lorebase.llm import whitening as W

rng = np.random.default_rng(12)


def fitted(spark, rows, **options):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component string").repartition(3)
    return W.whiten(frame, **options)


def exact(vectors, scale=64, shift=1_000_000):
    """x, n, S and the exact covariance of vectors, in whole numbers and fractions."""
    width = max(map(len, vectors))
    x = [[math.floor(scale * c) + shift for c in v] + [shift] * (width - len(v)) for v in vectors]
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    far = [[n * a - b for a, b in zip(v, s, strict=True)] for v in x]
    cov = [[Fraction(sum(f[i] * f[j] for f in far), n**3) for j in range(width)] for i in range(width)]
    return x, n, s, far, cov


@pytest.mark.parametrize(("tile", "block"), [(32, 8192), (3, 7), (1, 1), (4, 50)])
def test_covariance_is_exact_whatever_the_tiles(spark, tile, block):
    vectors = (rng.normal(size=(60, 6)) @ rng.normal(size=(6, 6)) + 5).tolist()
    found, rows = fitted(spark, [(i, v, "") for i, v in enumerate(vectors)], tile=tile, block_rows=block)
    x, n, s, far, cov = exact(vectors)
    assert found.n == n and found.sums == s and found.covariance.tolist() == [[float(c) for c in r] for r in cov]
    got = {r.id: r for r in rows.collect()}
    assert {i: int(r.deviation) for i, r in got.items()} == {i: sum(a * a for a in f) for i, f in enumerate(far)}
    white = np.array([got[i].whitened for i in range(n)])
    assert np.abs(white.T @ white / n - np.eye(6)).max() < 1e-9 and found.identity_error < 1e-9
    values = np.linalg.eigvalsh(np.array([[float(c) for c in r] for r in cov]))[::-1]
    assert np.allclose(found.values, values, rtol=1e-10) and np.allclose(found.explained, values / values.sum())
    centred = np.array([[a / n for a in f] for f in far])
    assert np.allclose(white * np.sqrt(found.values), centred @ found.basis, rtol=1e-9, atol=1e-9)


def test_rows_that_take_no_part_repeats_and_lengths(spark):
    vectors = rng.normal(size=(40, 4)).tolist()
    rows = [(i, v, "x") for i, v in enumerate(vectors)]
    odd = [(50, None, ""), (51, [1.0, None, 0.0, 0.0], ""), (52, [math.nan, 0.0, 0.0, 0.0], ""), (53, [0.0, math.inf, 0.0, 0.0], "")]
    used = [*rows, (None, [0.5] * 4, None), (3, vectors[3], "again"), (60, [1.0, 2.0], ""), (61, [], "")]
    found, out = fitted(spark, used + odd)
    _, n, s, far, cov = exact([v for _, v, _ in used])
    assert found.n == n == 44 and found.sums == s and found.covariance.tolist() == [[float(c) for c in r] for r in cov]
    assert sorted(int(r.deviation) for r in out.collect()) == sorted(sum(a * a for a in f) for f in far)
    assert sum(r.id is None for r in out.collect()) == 1 and sum(r.id == 3 for r in out.collect()) == 2


@pytest.mark.parametrize("vectors", [[[1.0, 2.0, 3.0]], [[1.0, 2.0]] * 9, [[float(i), 5.0, 2.0 * i] for i in range(30)], [[1e9 + i % 2, 1e9 - i % 3] for i in range(50)]])
def test_directions_without_variance_are_left_out(spark, vectors):
    found, out = fitted(spark, [(i, v, "") for i, v in enumerate(vectors)])
    rank = int(np.linalg.matrix_rank(np.array(vectors) - np.mean(vectors, axis=0)))
    assert found.basis.shape[1] == rank and {len(r.whitened) for r in out.collect()} == {rank} and found.identity_error < 1e-6


def test_large_components_are_exact_and_too_large_ones_refused(spark):
    vectors = [[float(rng.integers(-(1 << 50), 1 << 50)), float(rng.integers(-(1 << 40), 1 << 40)), float(i)] for i in range(30)]
    found, out = fitted(spark, [(i, v, "") for i, v in enumerate(vectors)])
    _, n, s, far, cov = exact(vectors)
    assert found.sums == s and found.covariance.tolist() == [[float(c) for c in r] for r in cov]
    want = {i: sum(a * a for a in f) for i, f in enumerate(far)}
    assert {r.id: int(r.deviation) for r in out.collect()} == {i: v for i, v in want.items() if v < 10**38}
    with pytest.raises(Exception, match="does not fit in a long"):
        fitted(spark, [(0, [1e300], ""), (1, [1.0], "")])


def test_query_returns_every_row_and_component(spark):
    rows = W.query(spark, "/root/testdata/sf0.001")
    assert rows.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    table = rows.toPandas()
    given = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").toPandas()
    _, n, _, far, cov = exact([list(map(float, v)) for v in given.embedding])
    assert len(table) == 32 * n and (table.n == n).all() and table.identity_error.nunique() == 1 and table.identity_error[0] < 1e-4
    assert dict(zip(table.vec_id, table.deviation, strict=True)) == {int(i): sum(a * a for a in f) for i, f in zip(given.vec_id, far, strict=True)}
    values = np.linalg.eigvalsh(np.array(cov, dtype=float))[::-1][:32]
    share = table.drop_duplicates("component").sort_values("component").explained.to_numpy()
    assert np.allclose(share, values / float(sum(cov[i][i] for i in range(len(cov)))), rtol=1e-6)
    wide = table.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(np.cov(wide.T, bias=True) - np.eye(32)).max() < 1e-6


def test_no_rows_and_too_many_dimensions(spark, tmp_path):
    schema = "vec_id long, embedding array<float>"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert W.query(spark, str(tmp_path)).collect() == []
    with pytest.raises(ValueError, match="dimensions"):
        W.whiten(spark.createDataFrame([(1, [0.0] * (W.MAX_DIMENSIONS + 1))], schema))
