"""Chains over blocks against the plain recursions over whole series."""

import numpy as np
import pytest

from seamline.operators import chains, detectors, volatility
from test_dynamic import panel_of


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(5)
    a = np.concatenate([rng.multivariate_normal(m, c, n) for m, c, n in (((0, 0), ((1, 0.8), (0.8, 1)), 40), ((3, -2), ((0.5, 0), (0, 2)), 35), ((0, 0), ((1, 0.8), (0.8, 1)), 30))])
    return {"a": a, "b": rng.normal(size=(23, 2)) + np.repeat([0, 4], [12, 11])[:, None]}


def plain_density(x, mean, cov):
    d = x - mean
    return -0.5 * np.einsum("ti,ij,tj->t", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(2 * np.pi * cov)[1]


def plain_round(x, start, trans, means, covs, floor):
    n, k = len(x), len(start)
    like = np.exp(np.array([plain_density(x, m, c) for m, c in zip(means, covs)]).T)
    fwd, bwd = np.zeros((n, k)), np.ones((n, k))
    fwd[0] = start * like[0]
    for t in range(1, n):
        fwd[t] = fwd[t - 1] @ trans * like[t]
    for t in range(n - 2, -1, -1):
        bwd[t] = trans @ (like[t + 1] * bwd[t + 1])
    total = fwd[-1].sum()
    post = fwd * bwd / total
    moves = sum(np.outer(fwd[t - 1], like[t] * bwd[t]) * trans / total for t in range(1, n))
    new_means = post.T @ x / post.sum(axis=0)[:, None]
    new_covs = []
    for s in range(k):
        values, vectors = np.linalg.eigh((post[:, s, None] * (x - new_means[s])).T @ (x - new_means[s]) / post[:, s].sum())
        new_covs.append((vectors * np.maximum(values, floor)) @ vectors.T)
    return post, np.log(total), (post[0], moves / moves.sum(axis=1, keepdims=True), new_means, np.array(new_covs))


def plain_best(start, trans, own):
    """Of all paths, by brute recursion with memory."""
    at, back = start + own[0], []
    for row in own[1:]:
        ways = at[:, None] + trans
        back.append(ways.argmax(axis=0))
        at = ways.max(axis=0) + row
    path = [int(at.argmax())]
    for b in back[::-1]:
        path.append(int(b[path[-1]]))
    return path[::-1]


@pytest.mark.parametrize("size", [512, 7])
def test_a_fit_is_the_plain_one(spark, series, size):
    panel = panel_of(spark, series, ("p", "q"))
    begin = chains.starting(panel, ["p", "q"], 2)
    chain = chains.hidden_markov(panel, ["p", "q"], 2, rounds=3, tolerance=-1, size=size, begin=begin)
    got = {r["series"]: (np.array(r["params"]), r["score"]) for r in chain.params.collect()}
    post = {}
    for r in chain.posteriors().collect():
        post.setdefault(r["series"], {})[r["t"]] = (r["p1"], r["p2"])
    path = {}
    for r in chain.path().collect():
        path.setdefault(r["series"], {})[r["t"]] = r["label"]
    for r in begin.collect():
        x, params = series[r["series"]], chain.law.unpacked(np.array(r["params"]))
        for _ in range(3):
            _, score, params = plain_round(x, *params, 1e-2)
        own, score_own = got[r["series"]]
        assert score_own == pytest.approx(score, abs=1e-4) and own == pytest.approx(np.concatenate([p.ravel() for p in params]), abs=1e-3)
        want = plain_round(x, *chain.law.unpacked(own), 1e-2)[0]
        assert np.array([post[r["series"]][t] for t in range(len(x))]) == pytest.approx(want, abs=1e-6)
        start, trans, means, covs = chain.law.unpacked(own)
        logs = np.array([plain_density(x, m, c) for m, c in zip(means, covs)]).T
        best = plain_best(np.log(start), np.log(trans), logs)
        assert [path[r["series"]][t] for t in range(len(x))] == best


def test_blocks_of_blocks_combine_in_order(spark):
    rng = np.random.default_rng(0)
    maps = rng.integers(0, 3, size=(30, 3)).astype(float)
    totals = spark.createDataFrame([("a", b, m.tolist()) for b, m in enumerate(maps)], "series string, block long, m array<double>")
    got = {r["block"]: r for r in chains.scanned(totals, chains._composed, size=3).collect()}
    for b in range(30):
        for side, elements in (("before", maps[:b]), ("after", maps[b + 1 :])):
            want = None
            for m in elements:
                want = m if want is None else want[m.astype(int)]
            assert (got[b][side] is None) == (want is None) and (want is None or list(got[b][side]) == want.tolist())


@pytest.mark.parametrize("size", [512, 9])
def test_the_jump_model_pays_for_jumps(spark, size):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(m, 1, n) for m, n in ((0, 40), (5, 30), (0, 25))])
    got = {r["t"]: r["label"] for r in chains.jump_model(panel_of(spark, {"a": x}), states=2, penalty=4.0, size=size).collect()}
    labels = np.array([got[t] for t in range(95)])
    z = (x - x.mean()) / x.std()
    for _ in range(3):  # the result is a fixed point of both turns
        centre = np.array([z[labels == s].mean() for s in (0, 1)])
        best = plain_best(np.zeros(2), -4.0 * (1 - np.eye(2)), -((z[:, None] - centre) ** 2))
        assert labels.tolist() == best
    assert np.abs(np.flatnonzero(np.diff(labels)) + 1 - [40, 70]).max() <= 2


def test_regimes_are_found_and_numbered(spark, series):
    panel = panel_of(spark, {"a": series["a"]}, ("p", "q"))
    got = [r["label"] for r in chains.hmm_labels(panel, ["p", "q"], 2, rounds=12).orderBy("t").collect()]
    truth = np.repeat([0, 1, 0], [40, 35, 30])
    assert got[0] == 0 and (np.array(got) == truth).mean() > 0.95
    rows = chains.switching_regression(panel, "p", 2, rounds=8).orderBy("t").collect()
    assert all(abs(r["p1"] + r["p2"] - 1) < 1e-9 for r in rows) and (np.array([r["label"] for r in rows]) == truth).mean() > 0.9
    lagged = [r["label"] for r in chains.switching_autoregression(panel, ["p"], 2, rounds=8).orderBy("t").collect()]
    assert len(lagged) == 105 and (np.array(lagged) == truth).mean() > 0.85


def test_flat_short_and_empty_series(spark):
    panel = panel_of(spark, {"flat": np.ones(30), "one": np.ones(1)})
    assert chains.hmm_labels(panel, states=2, rounds=2).where("series = 'flat'").count() == 30
    assert chains.jump_model(panel, states=2, rounds=2).count() == 31
    assert chains.jump_model(panel.limit(0), rounds=1).count() == 0


def plain_score(r, omega, alpha, beta):
    v, score = 1.0, 0.0
    for x in r:
        score -= 0.5 * (np.log(v) + x * x / v)
        v = omega + alpha * x * x + beta * v
    return score


@pytest.mark.parametrize("size", [512, 60])
def test_garch_finds_planted_parameters(spark, size):
    rng, v, x = np.random.default_rng(3), 1.0, [0.0]
    for z in rng.normal(size=1500):
        x.append(np.sqrt(v) * z)
        v = 0.1 + 0.15 * x[-1] ** 2 + 0.75 * v
    panel = panel_of(spark, {"a": np.cumsum(x), "flat": np.ones(20)})
    laws, sigma = volatility.fit_garch(panel, rounds=7, size=size)
    got = {r["series"]: r for r in laws.collect()}
    a = got["a"]
    assert abs(a["alpha"] - 0.15) < 0.07 and abs(a["beta"] - 0.75) < 0.12
    scale = np.sqrt(np.mean(np.square(x)))
    r = np.array(x) / scale
    own = plain_score(r, a["omega"] / scale**2, a["alpha"], a["beta"])
    assert own == pytest.approx(a["score"], abs=1e-6) and own >= plain_score(r, 0.1 / scale**2, 0.15, 0.75) - 1e-3
    for d in np.eye(3) * 0.02:  # no better law nearby
        near = [plain_score(r, *(np.array([a["omega"] / scale**2, a["alpha"], a["beta"]]) * (1 + s * d))) for s in (-1, 1)]
        assert max(near) <= own + 0.02
    series = [r["sigma"] for r in sigma.where("series = 'a'").orderBy("t").collect()]
    v = scale**2
    for t in range(200):
        assert series[t] == pytest.approx(np.sqrt(v))
        v = a["omega"] + a["alpha"] * x[t] ** 2 + a["beta"] * v


def test_garch_regimes_follow_the_volatility(spark):
    rng = np.random.default_rng(1)
    steps = rng.normal(size=600) * np.repeat([0.3, 3.0, 0.3], 200)
    got = np.array([r["label"] for r in volatility.garch_regimes(panel_of(spark, {"a": np.cumsum(steps)}), rounds=4).orderBy("t").collect()])
    loud = got[300]
    assert (got[220:390] == loud).all() and (got[20:195] != loud).all() and (got[450:580] != loud).mean() > 0.9


def test_detectors_by_name(spark, series):
    panel = panel_of(spark, {"a": series["a"]}, ("p", "q"))
    assert detectors.detect(panel, "jump", ["p", "q"], states=2).columns == ["series", "t", "label"]
    with pytest.raises(ValueError, match="unknown detector"):
        detectors.detect(panel, "other")


def test_wrong_arguments_are_told():
    assert detectors.problems("hmm", states=[2, 3], rounds=5) == [] and detectors.problems("jump", penalty=2.5) == []
    assert detectors.problems("other") == ["unknown detector 'other'"] and len(detectors.problems("hmm", states=[0, "x"], k=3)) == 3
    assert detectors.problems("garch", states=[]) == ["states has no value"] and detectors.problems("jump", states=True)
