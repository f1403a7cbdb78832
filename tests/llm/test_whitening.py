import math

import numpy as np
import pytest
from corpuscle.llm import whitening as w


def brute(vectors):
    """By numpy from the whole matrix: x, n, S, exact deviations, eigenvalues and vectors, trace."""
    x = np.array([[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors], object)
    n, s = len(x), x.sum(axis=0)
    c = x * n - s
    centred = c.astype(float) / n
    cov = centred.T @ centred / n
    values, basis = np.linalg.eigh(cov)
    return n, (c * c).sum(axis=1), centred, values[::-1], basis[:, ::-1], np.trace(cov)


def compare(rows, good, k=8):
    n, deviation, centred, values, basis, trace = brute([v for _, v in good])
    at = {i: r for r, (i, _) in enumerate(good)}
    k = min(k, len(values))
    want = centred @ basis[:, :k] / np.sqrt(values[:k])
    got = np.full((len(good), k), np.nan)
    for r in rows:
        got[at[r.vec_id], r.component - 1] = r.whitened
        assert r.n == n and r.deviation == deviation[at[r.vec_id]]
        assert abs(r.explained * trace / values[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-8
    assert len(rows) == got.size and not np.isnan(got).any()
    sign = np.sign((got * want).sum(axis=0))
    assert np.abs(got * sign - want).max() < 1e-7


@pytest.mark.parametrize("size", ["sf0.001", "sf0.1"])
def test_query_against_numpy(spark, size):
    folder = f"/root/testdata/{size}"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    good = [(r.vec_id, r.embedding) for r in rows if r.embedding and all(c is not None and math.isfinite(c) for c in r.embedding)]
    compare(w.op11(spark, folder).collect(), good)


def test_many_dimensions_close_values(spark):
    r = np.random.default_rng(2)
    v = r.standard_normal((700, 150)) * np.linspace(1.2, 1.0, 150)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    rows, fits = w.whiten(df)
    own = fits[150]
    n, _, centred, values, basis, trace = brute(v)
    assert np.abs(own.values / values[:8] - 1).max() < 1e-12
    assert np.abs(np.abs((own.basis * basis[:, :8]).sum(axis=0)) - 1).max() < 1e-12
    assert (own.residuals <= 1e-10 * values[0]).all() and own.identity_error < 1e-10


def test_edge_rows(spark):
    r = np.random.default_rng(4)
    good = [(i, r.standard_normal(5).tolist()) for i in range(30)]
    good += [(100, good[0][1]), (100, good[0][1]), (None, good[3][1])]
    bad = [(50, None), (51, [1.0, None, 2.0, 3.0, 4.0]), (52, [1.0, float("nan"), 2.0, 3.0, 4.0]), (53, [float("-inf")] * 5), (54, [])]
    rows = [(*x, "v", 1) for x in good + bad]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, v string, `c0` int")
    out, fits = w.whiten(df)
    assert out.columns[:4] == df.columns and set(fits) == {5} and fits[5].n == 33 and len(fits[5].values) == 5
    got = {x.vec_id: x for x in out.collect()}
    assert all(got[i][f"{w.OWN}whitened"] is None for i, _ in bad) and all(x.v == "v" for x in got.values())
    n, deviation, *_ = brute([v for _, v in good])
    assert got[100][f"{w.OWN}deviation"] == deviation[30] and len(got[None][f"{w.OWN}whitened"]) == 5
    # two lengths are two fits, a vector alone has no variance, large entries are held and their deviations may not fit
    mixed = spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 1.0]), (3, [0.5] * 3), (4, [0.5, 1e300]), (5, [0.0, -1e300])], df.select("vec_id", "embedding").schema)
    out, fits = w.whiten(mixed)
    got = {x.vec_id: x for x in out.collect()}
    assert sorted(fits) == [2, 3] and got[3][f"{w.OWN}whitened"] == [] and got[3][f"{w.OWN}deviation"] == 0 and got[4][f"{w.OWN}deviation"] is None
    assert w.whiten(df.limit(0))[0].count() == 0


def test_unfinished_iteration_is_an_error():
    a = np.diag(np.arange(1.0, 60.0))
    with pytest.raises(RuntimeError):
        w.lobpcg(lambda b: a @ b, 59, w.Params(passes=2))
    values, basis, residuals, passes = w.lobpcg(lambda b: a @ b, 59, w.Params())
    assert np.allclose(values, np.arange(59.0, 51.0, -1)) and residuals.max() < 1e-11
