import math

import numpy as np
import pytest

from tests.conftest import SF_SMALL
from tillroll.llm import whitening


def scatter(state):
    return state.vectors * state.values @ state.vectors.T


def centred(x):
    off = x - x.mean(axis=0)
    return off.T @ off


@pytest.mark.parametrize("seed", range(40))
def test_rank_one_updates_and_merges_give_the_scatter(seed):
    """Random, repeated, constant and low-rank vectors: deflation of both kinds."""
    rng = np.random.default_rng(seed)
    d, n = rng.integers(1, 12), rng.integers(1, 40)
    x = rng.integers(-5, 5, (n, d)) if seed % 2 else np.floor(rng.normal(0, 60, (n, d))).astype(int)
    if seed % 5 == 0:
        x[:, : max(1, d // 2)] = 3
    whole, a, b, blocks = (whitening.State(d) for _ in range(4))
    for at in range(0, n, 9):
        blocks.add_block(x[at : at + 9])
    for i, row in enumerate(x):
        whole.add(row)
        (a if i < n // 2 else b).add(row)
    a.merge(b)
    most = max(1, np.abs(centred(x)).max())
    for s in (whole, a, blocks, whitening.State.of(a.row())):
        assert s.n == n and (s.sums == x.sum(axis=0)).all()
        assert np.abs(scatter(s) - centred(x)).max() <= 1e-10 * most
        assert np.abs(s.vectors.T @ s.vectors - np.eye(d)).max() < 1e-11


def test_secular_roots_interlace():
    d, z = np.array([0.0, 1.0, 1.0 + 1e-9, 5.0]), np.array([1e-3, 2.0, 1e-6, 3.0])
    pole, t = whitening.secular_roots(d, z)
    roots = d[pole] + t
    assert (roots >= d).all() and (roots[:-1] <= d[1:]).all() and roots[-1] <= d[-1] + z @ z
    assert np.allclose(np.sort(np.linalg.eigvalsh(np.diag(d) + np.outer(z, z))), roots, rtol=1e-12, atol=1e-12)


def brute_force(rows):
    ours = [(i, [math.floor(64.0 * c) + 1_000_000 for c in v]) for i, v in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in ours}))
    n, sums = len(fit), fit.sum(axis=0)
    off = fit - sums / n
    e, u = np.linalg.eigh(off.T @ off / n)
    e, u = e[::-1][:16], u[:, ::-1][:, :16]
    return ours, n, sums, e, e / np.trace(off.T @ off / n), u


def compare(got, rows):
    ours, n, sums, e, explained, u = brute_force(rows)
    assert len(got) == len(ours) * len(e)
    by_row = {}
    for i, x in ours:
        x = np.array(x)
        by_row.setdefault(i, []).append((int(((n * x - sums) ** 2).sum()), (x - sums / n) @ u / np.sqrt(e)))
    sign = {}
    for r in sorted(got, key=lambda r: -abs(r.whitened)):
        k = r.component - 1
        deviation, white = by_row[r.vec_id][0]
        sign.setdefault(k, np.sign(white[k] * r.whitened))
        assert (r.n, r.deviation) == (n, deviation)
        assert r.whitened * sign[k] == pytest.approx(white[k], abs=1e-8)
        assert r.explained == pytest.approx(explained[k], rel=1e-9)
        assert r.identity_error < 1e-9


def test_sample_against_numpy(spark, duck):
    rows = duck.execute("SELECT vec_id, embedding FROM embeddings").fetchall()
    compare(whitening.op13_whitening(spark, SF_SMALL).collect(), rows)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr(
        "*", "vec_id AS x", "1 AS n", "2 AS whitened", "vec_id AS at")


def test_repeats_count_once_and_bad_vectors_not(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(0, 1, 5)]) for i in range(60)]
    rows += [(100 + i, rows[3][1]) for i in range(200)] + [(7, rows[7][1]), (None, rows[8][1])]
    bad = [(900, None), (901, [None] * 5), (902, [float("nan")] * 5), (903, [float("inf")] * 5)]
    df = frame(spark, rows + bad).repartition(5, "vec_id")
    compare(whitening.whitened(df).collect(), rows)


def test_odd_vectors(spark):
    assert whitening.whitened(frame(spark, [])).count() == 0
    assert whitening.whitened(frame(spark, [(1, []), (2, [1e30, 0.0])])).count() == 0
    (one,) = whitening.whitened(frame(spark, [(1, [0.5])])).collect()
    assert (one.n, one.deviation, one.whitened, one.explained, one.identity_error) == (1, 0, None, 0.0, 0.0)
    got = whitening.whitened(frame(spark, [(1, [0.0, 5.0]), (2, [1.0, 5.0]), (3, [1.0])])).collect()
    # Widths are spaces of their own; a component without variance has no whitened value.
    assert sorted((r.vec_id, r.component, r.n, r.whitened is None, round(r.explained, 9)) for r in got) == [
        (1, 1, 2, False, 1.0), (1, 2, 2, True, 0.0), (2, 1, 2, False, 1.0), (2, 2, 2, True, 0.0), (3, 1, 1, True, 0.0)]


def test_deviation_beyond_long_is_null(spark):
    rows = [(i, [float(2**40) * (1 - 2 * (i % 2)), float(i)]) for i in range(4)]
    got = whitening.whitened(frame(spark, rows)).collect()
    assert {r.deviation for r in got} == {None}
    assert all(r.identity_error < 1e-4 for r in got)


def test_states_of_many_partitions_meet_in_a_tree(spark):
    rng = np.random.default_rng(8)
    x = rng.integers(-60, 60, (700, 6))
    fit = spark.createDataFrame([(row.tolist(),) for row in x], "x array<long>").repartition(70)
    state = whitening._spectra(fit, 6)
    assert state.n == 700 and (state.sums == x.sum(axis=0)).all()
    assert np.abs(scatter(state) - centred(x)).max() <= 1e-9 * np.abs(centred(x)).max()
    f = whitening.fit_whitening(fit, 6)
    assert np.allclose(f.values, np.linalg.eigvalsh(centred(x) / 700)[::-1], rtol=1e-12)
