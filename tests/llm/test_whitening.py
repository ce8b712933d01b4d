import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeflow.llm import whitening

SF = "/root/testdata/sf0.001"


def plain(vectors, most=16):
    """Rows that stay, and eigenvectors, variances and sums from numpy's own decomposition."""
    kept = {k: np.floor(64 * np.asarray(v, float)).astype(np.int64) + 1_000_000 for k, v in vectors if v is not None and all(e is not None and np.isfinite(e) for e in v)}
    width = max(map(len, kept.values()))
    kept = {k: v for k, v in kept.items() if len(v) == width}
    fit = np.unique(np.stack([*kept.values()]), axis=0)
    n, S = len(fit), fit.sum(axis=0)
    centred = (n * fit - S) / n
    e, w = np.linalg.eigh(centred.T @ centred / n)
    e, w = e[::-1], w[:, ::-1]
    keep = min(most, int((e > 1e-12 * e[0]).sum()))
    return kept, n, S, e[:keep], w[:, :keep], e.sum()


def agree(rows, vectors):
    kept, n, S, e, w, trace = plain(vectors)
    assert sorted((r.vec_id, r.component) for r in rows) == sorted((k, c + 1) for k in kept for c in range(len(e)))
    white = {(r.vec_id, r.component): r.whitened for r in rows}
    for c in range(len(e)):
        got, want = (np.array(x) for x in zip(*((white[k, c + 1], ((n * x - S) / n) @ w[:, c] / np.sqrt(e[c])) for k, x in kept.items())))
        assert np.abs(got - want * np.sign(got @ want)).max() < 1e-6
    for r in rows:
        assert r.n == n and r.deviation == sum(int(d) ** 2 for d in n * kept[r.vec_id] - S)
        assert abs(r.explained / (e[r.component - 1] / trace) - 1) < 1e-9 and r.identity_error < 1e-9


def frame(spark, rows):
    return spark.createDataFrame([(k, v, 1, [1], "f") for k, v in rows], "vec_id long, embedding array<float>, label int, x array<int>, part string").repartition(5)


def vectors(n=300, d=20, seed=1):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, d)) @ draw.normal(size=(d, d))
    return [(k, v.astype(np.float32).tolist()) for k, v in enumerate(x)]


def test_whitening_equals_numpy(spark):
    rows = vectors()
    rows += [(1000 + k, rows[0][1]) for k in range(100)]  # copies count once in the fit
    rows += [(2000, None), (2001, [None] * 20), (2002, [float("nan")] + [0.0] * 19), (2003, [float("inf")] * 20), (2004, [1.0, 2.0]), (2005, [])]
    agree(whitening.whitened(frame(spark, rows)).collect(), rows)


def test_whitening_of_the_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    agree(whitening.op12_whitening(spark, SF).collect(), [(r.vec_id, r.embedding) for r in df.collect()])


@pytest.mark.parametrize("rows", [
    [(k, [float(k % 7), 3.0, float(k % 7) * 2, float(k % 3)]) for k in range(50)],  # dependent and constant dimensions
    [(0, [1.0, 2.0]), (1, [3.0, -1.0])],
    [(k, [float(k)]) for k in range(9)],
])
def test_directions_without_variance_have_no_component(spark, rows):
    agree(whitening.whitened(frame(spark, rows)).collect(), rows)


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])]):
        out = whitening.whitened(frame(spark, rows))
        assert out.collect() == [] and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_null_and_repeated_keys(spark):
    rows = [*vectors(40, 3), (None, [0.5, 1.5, -0.25]), (3, [9.0, 9.0, 9.0])]
    out = whitening.whitened(frame(spark, rows)).toPandas()
    assert len(out) == 42 * 3 and out.vec_id.isna().sum() == 3 and (out.vec_id == 3).sum() == 6


def test_far_entries(spark):
    out = whitening.whitened(frame(spark, [*vectors(40, 3), (77, [3e38, -3e38, 1.0])])).toPandas()
    # Beside that row nothing else has variance; its distance is beyond a long.
    assert len(out) == 41 and (out.component == 1).all() and out.deviation.isna().all() and np.isfinite(out.whitened).all()


@pytest.mark.parametrize("d", [1, 2, 6, 40])
def test_rank_one_updates(d):
    draw = np.random.default_rng(d)
    x = np.floor(draw.normal(size=(200, d)) * 30)
    x[20:60] = x[3]
    x[:, -1] = x[:, 0]  # equal and zero values deflate
    one, two = whitening.Spectrum(d), whitening.Spectrum(d)
    for r in x[:120]:
        one.add(r)
    for r in x[120:]:
        two.add(r)
    one.merge(two.m, two.sums, two.mean, two.values, two.vectors)
    scatter = (x - x.mean(axis=0)).T @ (x - x.mean(axis=0))
    assert np.allclose(one.vectors.T @ one.vectors, np.eye(d), atol=1e-11) and np.allclose(one.mean, x.mean(axis=0))
    assert np.abs(one.vectors * one.values @ one.vectors.T - scatter).max() < 1e-11 * np.trace(scatter)


def test_secular_roots_lie_between_the_poles():
    values, z = np.array([0.0, 1e-9, 1.0, 1.0 + 1e-10, 5.0]), np.array([1e-6, 2.0, 1e-3, 3.0, 0.5])
    x, poles = whitening.secular_roots(values, z)
    exact = np.linalg.eigvalsh(np.diag(values) + np.outer(z, z))
    assert np.allclose(values - np.diagonal(poles) + x, exact, rtol=1e-12, atol=1e-14)


def test_the_spectrum_alone_comes_close(spark):
    rows = vectors(200, 8)
    fit = whitening.scaled(frame(spark, rows), "embedding").select("x").repartition(7)
    found = whitening.spectrum(fit, fan=2)
    kept, n, S, e, w, trace = plain(rows)
    assert found.m == n and found.sums == S.tolist() and np.allclose(found.values[::-1] / n, e, rtol=1e-9)
    assert whitening.spectrum(fit.filter(F.lit(False))) is None
