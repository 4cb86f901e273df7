"""Whitening against numpy's own decomposition."""

import numpy as np
import pytest

from voxcohort.llm import whiten

SF = "/root/testdata/sf0.01"
NAMES = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def exact(vectors):
    x = np.floor(64 * np.array(vectors, np.float32).astype(float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    centred = lambda m: (m - s // n).astype(float) - (s % n) / n
    values, vecs = np.linalg.eigh(centred(fit).T @ centred(fit) / n)
    values, vecs = values[::-1], vecs[:, ::-1]
    deviation = [sum((n * int(v) - int(t)) ** 2 for v, t in zip(row, s)) for row in x]
    return n, deviation, centred(x) @ vecs, values


def check(df, ids, vectors, k):
    got = df.toPandas()
    n, deviation, projected, values = exact(vectors)
    assert list(got.columns) == NAMES and len(got) == len(ids) * k and (got.n == n).all()
    by = got.set_index(["vec_id", "component"]).sort_index()
    assert (got.identity_error < 1e-9).all() and got.identity_error.nunique() == 1
    for c in range(1, k + 1):
        one = by.xs(c, level="component").loc[ids]
        assert one.deviation.tolist() == deviation
        want = projected[:, c - 1] / np.sqrt(values[c - 1])
        sign = np.sign(one.whitened.iloc[np.abs(want).argmax()] * want[np.abs(want).argmax()])
        gap = min(abs(values[c - 1] - values[j]) for j in range(len(values)) if j != c - 1) / values[0]
        assert np.abs(sign * one.whitened - want).max() < 1e-11 / min(gap, 1)
        assert np.allclose(one.explained, values[c - 1] / values.sum(), rtol=1e-9)


def test_whitening_equals_a_full_decomposition(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = df.select("vec_id", "embedding").collect()
    check(whiten.whitening(df), [r.vec_id for r in rows], [r.embedding for r in rows], 16)


@pytest.mark.parametrize("d, spectrum", [(40, np.linspace(9, 8, 40)), (70, np.r_[np.full(15, 5.0), 4.9, 4.89, np.full(53, 4.8)]), (5, np.array([3, 2, 1.5, 1, .5])), (90, 10.0 ** -np.linspace(0, 3, 90))])
def test_leading_components_of_hard_spectra(d, spectrum):
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    v = (q * spectrum) @ q.T
    passes = []
    values, vectors = whiten.leading(lambda b: passes.append(1) or v @ b, d, 16)
    k = min(16, d)
    assert np.allclose(values, np.sort(spectrum)[::-1][:k], rtol=1e-12)
    assert np.abs(v @ vectors - vectors * values).max() < 1e-13 * spectrum.max() and np.allclose(vectors.T @ vectors, np.eye(k), atol=1e-13)


def test_whitening_on_awkward_and_empty_tables(spark):
    rng = np.random.default_rng(5)
    good = [(i, [float(v) for v in rng.standard_normal(4)]) for i in range(30)]
    good += [good[3], (None, good[4][1]), (77, [1e5, -1e5, 3.0, 0.0])]
    bad = [(100, None), (101, []), (102, [1.0, None, 0.0, 0.0]), (103, [float("nan")] * 4), (104, [float("inf"), 0.0, 0.0, 0.0]), (105, [1.0]), (106, [1.0] * 5)]
    extra = "vec_id long, embedding array<float>, x long, v string, d int, n int, component int, whitened double"
    df = spark.createDataFrame([(i, v, 1, "v", 2, 3, 4, 5.0) for i, v in good + bad], extra)
    kept = [(i, v) for i, v in good if i is not None]
    out = whiten.whitening(df)
    n, deviation, projected, values = exact([v for _, v in good])
    got = out.toPandas()
    assert len(got) == 4 * len(good) and got.vec_id.isna().sum() == 4 and set(got.vec_id.dropna()) == {i for i, _ in kept} and (got.n == n).all()
    assert got.groupby("component").deviation.sum().tolist() == [sum(deviation)] * 4
    assert np.allclose((got.set_index("component").whitened ** 2).groupby(level=0).sum(), (projected ** 2 / values).sum(0))
    flat = spark.createDataFrame([(i, [1.0, 2.0, float(i % 2)]) for i in range(6)], "vec_id long, embedding array<float>")
    assert whiten.whitening(flat).select("component").distinct().collect() == [(1,)]          # one direction only
    for none in (flat.where("vec_id = 1"), flat.where("vec_id < 0"), df.where("vec_id >= 100 AND vec_id < 105")):
        assert whiten.whitening(none).collect() == [] and whiten.whitening(none).columns == NAMES
    far = spark.createDataFrame([(i, [3e9 * i, float(i)]) for i in range(4)], "vec_id long, embedding array<double>")
    assert [r.deviation is None for r in whiten.whitening(far).where("component = 1").orderBy("vec_id").collect()] == [True] * 4
