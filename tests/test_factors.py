import itertools

import numpy as np
import pandas as pd
import pytest

from seamline.functions import evaluation
from seamline.operators import factors

COLUMNS = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def mixed(spark):
    rng = np.random.default_rng(5)
    sources = np.stack([np.sign(rng.normal(size=600)) + rng.normal(0, 0.1, 600), rng.laplace(size=600)], axis=1)
    x = sources @ np.array([[2.0, 1.0, 0.5, -1.0], [0.3, -1.0, 2.0, 1.0]]) + 5
    df = spark.createDataFrame(pd.DataFrame(x, columns=COLUMNS).assign(t=range(600)))
    return df.repartition(3), x, sources


def rows(df, *names):
    return df.toPandas().sort_values("t")[list(names)].to_numpy(float)


def test_moments_and_empty(spark, mixed):
    df, x, _ = mixed
    mean, cov = factors.moments(df, COLUMNS)
    assert np.allclose(mean, x.mean(axis=0)) and np.allclose(cov, np.cov(x.T, bias=True))
    with pytest.raises(ValueError):
        factors.moments(df.limit(0), COLUMNS)


def test_independent_components_are_the_sources(mixed):
    df, _, sources = mixed
    got = rows(factors.independent_components(df, COLUMNS, 4), "ic1", "ic2")
    match = np.abs(np.corrcoef(got.T, sources.T)[:2, 2:])
    assert match.max(axis=0).min() > 0.98 and set(match.argmax(axis=0)) == {0, 1}


def test_sparse_loadings():
    cov = np.diag([4.0, 3.9, 1.0, 0.5]) + 0.05
    assert np.abs(factors.sparse_loadings(cov, 1, 0.0)[:, 0] @ np.linalg.eigh(cov)[1][:, -1]) == pytest.approx(1)
    load = factors.sparse_loadings(cov, 2, 0.3)
    assert (load == 0).sum() >= 4 and np.allclose(np.linalg.norm(load, axis=0), 1)


def test_sparse_components(mixed):
    df, x, _ = mixed
    got = rows(factors.sparse_components(df, COLUMNS, 2, alpha=0.0), "sc1", "sc2")
    s = np.linalg.svd(x - x.mean(axis=0), compute_uv=False)
    assert np.allclose(np.linalg.norm(got, axis=0), s[:2], rtol=1e-4)


def test_robust_components_find_the_outliers(spark):
    rng = np.random.default_rng(2)
    clean = rng.normal(size=(300, 1)) @ np.array([[1.0, 2.0, -1.0, 0.5, 1.5]])
    x = clean.copy()
    hit = [(k * 17 % 300, k % 5) for k in range(15)]
    for i, j in hit:
        x[i, j] += 20
    names = list("abcde")
    got = factors.robust_components(spark.createDataFrame(pd.DataFrame(x, columns=names).assign(t=range(300))), names)
    low, sparse = rows(got, *(f"low_{c}" for c in names)), rows(got, *(f"sparse_{c}" for c in names))
    assert np.abs(low + sparse - (x - x.mean(axis=0))).max() < 1e-2
    assert min(sparse[i, j] for i, j in hit) > 10


def test_kernel_components(mixed):
    df, x, _ = mixed
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    got = rows(factors.kernel_components(df, COLUMNS, 2, "linear", key="t"), "kc1", "kc2")
    assert np.allclose(np.linalg.norm(got, axis=0), np.linalg.svd(z, compute_uv=False)[:2], rtol=1e-6)
    few = df.where("t < 80")
    got = rows(factors.kernel_components(few, COLUMNS, 2, "rbf", key="t", gamma=0.2), "kc1", "kc2")
    z = (x[:80] - x[:80].mean(axis=0)) / x[:80].std(axis=0)
    k = factors.kernel(z, z, "rbf", gamma=0.2)
    centre = np.eye(80) - 1 / 80
    values = np.linalg.eigvalsh(centre @ k @ centre)[::-1][:2]
    assert np.allclose((got**2).sum(axis=0), values, rtol=1e-3)


def test_dynamic_modes(spark):
    t = np.arange(60)
    x = np.stack([np.cos(0.3 * t), np.sin(0.3 * t), 0.5 * np.cos(0.3 * t)], axis=1) * 0.97 ** t[:, None]
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abc")).assign(t=t)).where("t <> 45")
    got = factors.dynamic_modes(df, list("abc"), 20, 10, 2).orderBy("window").collect()
    assert [r["start"] for r in got] == [0, 10, 20]
    assert np.hypot(got[0]["re"], got[0]["im"]) == pytest.approx([0.97, 0.97])
    assert factors.dynamic_modes(df, list("abc"), 5, 20, 2).count() == 3


def test_matching_is_optimal(spark):
    rng = np.random.default_rng(1)
    for n, m in ((3, 5), (4, 4), (5, 2), (0, 3)):
        a, b = rng.choice(100, n, replace=False).tolist(), rng.choice(100, m, replace=False).tolist()
        t, p = (spark.createDataFrame([("s", int(v)) for v in x], "series string, b long") for x in (a, b))
        got = evaluation.matched(t, p).collect()
        small, large = sorted((a, b), key=len)
        best = min((sum(abs(x - y) for x, y in zip(small, other, strict=True)) for other in itertools.permutations(large, len(small))), default=0)
        assert len(got) == min(n, m) and sum(r["distance"] for r in got) == best


@pytest.mark.parametrize("kind", ["rbf", "laplacian", "chi2", "linear"])
def test_nystroem_features_give_back_the_kernel(spark, kind):
    x = np.abs(np.random.default_rng(7).normal(size=(30, 3)))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "date int, a double, b double, c double")
    got = factors.feature_map(df, ["a", "b", "c"], "nystroem", n=30, kind=kind, gamma=0.5).orderBy("date").collect()
    z = np.array([r["z"] for r in got])
    assert np.allclose(z @ z.T, factors.kernel(x, x, kind, 0.5), atol=1e-5)
    assert factors.feature_map(df, ["a", "b", "c"]).first()["z"] == list(x[0])
    with pytest.raises(ValueError):
        factors.feature_map(df, ["a"], "other")
    with pytest.raises(ValueError):
        factors.kernel(-x, x, "chi2")


def test_modes_by_rule():
    t = np.arange(24)
    x = np.stack([np.cos(0.4 * t), np.sin(0.4 * t), 1e-3 * np.cos(1.1 * t)], axis=1)
    re, _, _, sigma = factors.modes(x, 3, "explained", 0.99)
    assert (sigma[:2] > 0).all() and sigma[2] == 0 and re[0] == pytest.approx(np.cos(0.4), abs=1e-2)
