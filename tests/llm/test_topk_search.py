import math

import numpy as np
import pyarrow as pa
import pytest
from lorebase.llm import topk_search as K

rng = np.random.default_rng(3)


def plain(vec, every=20, k=20):
    """Ranks from (id, integer vector) rows by comparing all pairs."""
    out = []
    for q in sorted({i for i, _ in vec if i % every == 0}):
        pairs = [(-sum(a * b for a, b in zip(v, w, strict=False)), c) for i, v in vec if i == q for c, w in vec if c != q]
        out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(sorted(pairs)[:k])]
    return out


def asked(spark, rows, **options):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string").repartition(3)
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in K.top_k(frame, **options).collect())


@pytest.mark.parametrize("size", [1, 60, 3000, 1 << 20, 1 << 40])
@pytest.mark.parametrize("share", [0.05, 0.5, 1.0])
def test_scores_are_exact_in_any_width(size, share):
    q, c = ((rng.integers(-size, size + 1, shape) * (rng.random(shape) < share)).astype(np.int64) for shape in ((70, 9), (50, 9)))
    sides = [K.Sparse(pa.array(x.tolist(), pa.list_(pa.int64()))) for x in (q, c)]
    kind = K.width(sides[0].norm() * sides[1].norm())
    assert (K.scores(sides[0], sides[1].postings(kind), 50, kind) == q.astype(object) @ c.T.astype(object)).all()


def test_selection_with_ties_own_rows_and_extremes():
    for kind in (np.int16, np.int32, np.int64, object):
        for n, k in ((1, 20), (19, 20), (20, 20), (21, 20), (22, 20), (90, 7)):
            found = rng.integers(-3, 4, (40, n)).astype(kind)
            ids = np.sort(rng.integers(0, n, n))
            own = rng.integers(0, n + 5, 40)
            rows, cols = K.best(found, own, ids, k)
            for r in range(40):
                want = sorted((c for c in range(n) if ids[c] != own[r]), key=lambda c: (-found[r, c], c))[:k]
                assert sorted(cols[rows == r]) == sorted(want)


@pytest.mark.parametrize("n", [1, 19, 20, 21, 22, 100, 319, 320, 641])
def test_equals_brute_force_at_any_size(spark, n):
    near = [[x / 64 for x in v] for v in (rng.integers(-20, 20, (5, 6))).tolist()]  # neighbours come in clusters
    rows = [(i, [x + int(rng.integers(-1, 2)) / 64 for x in near[i % 5]], "") for i in range(n)]
    assert asked(spark, rows) == plain([(i, [math.floor(64 * x) for x in v]) for i, v, _ in rows])


def test_ties_nulls_repeats_and_blocks(spark):
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4) / 64], "label") for i in range(400)]
    whole = [(i, [math.floor(64 * x) for x in v]) for i, v, _ in rows]
    rows += rows[:50] + [(500, None, ""), (501, [1.0, None, 0.0, 0.0], ""), (520, [math.nan, 0.0, 0.0, 0.0], ""), (540, [math.inf, 0.0, 0.0, 0.0], ""), (None, [1.0] * 4, "")]
    for blocks in ({}, {"query_block": 5, "candidate_block": 37}):
        assert asked(spark, rows, **blocks) == plain(whole)


def test_several_vectors_of_one_id_and_lengths(spark):
    rows = [(i % 30, [float(x) / 64 for x in rng.integers(-4, 5, 1 + i % 4)], "") for i in range(90)] + [(20, [], ""), (7, [], "")]
    whole = list({(i, tuple(math.floor(64 * x) for x in v)) for i, v, _ in rows})
    got = asked(spark, rows)
    assert got == plain(whole) and all(q != c for q, _, c, _ in got)


def test_large_finite_components_take_part_and_are_never_wrapped(spark):
    rows = [(i, [float(i), 1.0], "") for i in range(30)] + [(31, [4e7, 0.0], ""), (32, [-3e9, 2e9], "")]
    assert asked(spark, rows) == plain([(i, [math.floor(64 * x) for x in v]) for i, v, _ in rows])
    for bad in ([(0, [1e14, 1e14], ""), (1, [1e14, 1e14], "")], [(0, [1e300], ""), (1, [1.0], "")]):
        with pytest.raises(Exception, match="does not fit in a long"):
            asked(spark, bad)


def test_few_rows_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    assert K.top_k(spark.createDataFrame([], schema)).collect() == []
    got = K.top_k(spark.createDataFrame([(0, [1.0]), (3, [0.5]), (5, [0.5])], schema)).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in sorted(got)] == [(0, 1, 3, 2048), (0, 2, 5, 2048)]
