"""Optimal transport between windows against plain loops, and the regimes it finds."""

import numpy as np
import pytest

from seamline.operators import detectors, transport
from test_dynamic import panel_of


def plain_cost(x, y, eps, rounds=100, tolerance=1e-3):
    c = np.array([[np.linalg.norm(p - q) for q in y] for p in x]) / eps
    n, m = c.shape
    soft = lambda v: -np.logaddexp.reduce(v)
    b = np.zeros(n)
    for _ in range(rounds - 1):
        a = np.array([soft([b[i] - np.log(n) - c[i, j] for i in range(n)]) for j in range(m)])
        new = np.array([soft([a[j] - np.log(m) - c[i, j] for j in range(m)]) for i in range(n)])
        gap, b = eps * np.abs(new - b).mean(), new
        if gap < tolerance:
            break
    a = np.array([soft([b[i] - np.log(n) - c[i, j] for i in range(n)]) for j in range(m)])
    b = np.array([soft([a[j] - np.log(m) - c[i, j] for j in range(m)]) for i in range(n)])
    return eps * (a.mean() + b.mean())


def plain_own(x, eps, rounds=100, tolerance=1e-3):
    c = np.array([[np.linalg.norm(p - q) for q in x] for p in x]) / eps
    step = lambda a: np.array([-np.logaddexp.reduce(a - np.log(len(x)) - c[i]) for i in range(len(x))])
    a = np.zeros(len(x))
    for _ in range(rounds - 1):
        new = (a + step(a)) / 2
        gap, a = eps * np.abs(new - a).mean(), new
        if gap < tolerance:
            break
    return eps * step(a).mean()


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(8)
    a = np.concatenate([rng.normal(0, 1, (40, 2)), rng.normal(0, 1, (40, 2)) * 4, rng.normal(0, 1, (33, 2))])
    return {"a": a, "b": np.concatenate([rng.normal(0, 1, (30, 2)), rng.normal(3, 1, (30, 2))]), "short": rng.normal(size=(4, 2))}


@pytest.fixture(scope="module")
def panel(spark, series):
    return panel_of(spark, series, ("p", "q"))


@pytest.mark.parametrize("eps", [0.001, 0.2])
def test_divergences_are_the_plain_ones(spark, series, panel, eps):
    held = transport.windows(panel, ["p", "q"], 10, 5)
    got = {(r["series"], r["m"], r["l"]): r["d"] for r in transport.divergences(held, 64, eps).collect()}
    for name in ("a", "b"):
        x = series[name]
        parts = [x[5 * m : 5 * m + 10] for m in range((len(x) - 5) // 5)]
        assert {k[1:] for k in got if k[0] == name} == {(i, j) for i in range(len(parts)) for j in range(len(parts))}
        for i, j in [(0, 1), (1, 0), (3, 9), (7, 7), (len(parts) - 1, 2)]:
            i, j = min(i, j), max(i, j)
            want = 0 if i == j else plain_cost(parts[i], parts[j], eps) - plain_own(parts[i], eps) - plain_own(parts[j], eps)
            assert got[name, i, j] == pytest.approx(want, abs=1e-9)
            assert got[name, j, i] == pytest.approx(want, abs=1e-9)
    assert not any(k[0] == "short" for k in got)


def test_labels_are_those_of_the_whole_matrix(spark, series, panel):
    """With all windows as landmarks: clusters, silhouettes and rows by plain loops over the matrix."""
    held = transport.windows(panel, ["p", "q"], 10, 5)
    dist = transport.divergences(held)
    got = {}
    for r in transport.transport_regimes(panel, ["p", "q"], 10, 5, most=4).collect():
        got.setdefault(r["series"], {})[r["t"]] = r["label"]
    for name in ("a", "b"):
        cells = [(r["m"], r["l"], r["d"]) for r in dist.where(f"series = '{name}'").collect()]
        n = max(m for m, _, _ in cells) + 1
        d = np.zeros((n, n))
        for m, k, v in cells:
            d[m, k] = v
        best = None
        for k in range(2, 5):
            chosen = [0]
            while len(chosen) < k:
                chosen.append(max(range(n), key=lambda i: (min(d[i, c] for c in chosen), -i)))
            labels = [min(range(k), key=lambda c: (d[i, chosen[c]], c)) for i in range(n)]
            while True:
                members = {c: [j for j in range(n) if labels[j] == c] for c in set(labels)}
                new = [min(members, key=lambda c: (np.mean([d[i, j] for j in members[c]]), c)) for i in range(n)]
                if new == labels:
                    break
                labels = new
            score = []
            for i in range(n):
                own = [j for j in range(n) if labels[j] == labels[i] and j != i]
                others = [np.mean([d[i, j] for j in range(n) if labels[j] == c]) for c in set(labels) - {labels[i]}]
                s = 0.0
                if own and others:
                    a, b = np.mean([d[i, j] for j in own]), min(others)
                    s = (b - a) / max(a, b)
                score.append(s)
            if best is None or np.mean(score) > best[0] + 1e-12:
                best = np.mean(score), labels
        rows = [best[1][min(n - 1, t // 5)] for t in range(len(series[name]))]
        seen = list(dict.fromkeys(rows))
        assert got[name] == {t: seen.index(c) for t, c in enumerate(rows)}, name
    assert "short" not in got


def test_regimes_of_another_spread_are_found_with_few_landmarks(spark, series, panel):
    got = [r["label"] for r in transport.transport_regimes(panel.where("series = 'a'"), ["p", "q"], 10, 2, 2, landmarks=20).orderBy("t").collect()]
    want = np.repeat([0, 1, 0], [40, 40, 33])
    assert len(got) == 113 and (np.array(got) == want).mean() > 0.85


def test_distances_say_the_same_as_labels(spark, panel):
    far = {(r["series"], r["t"]): (r["w1"], r["w2"]) for r in transport.transport_distances(panel, ["p", "q"], 10, 5).collect()}
    labels = {(r["series"], r["t"]): r["label"] for r in transport.transport_regimes(panel, ["p", "q"], 10, 5, 2).collect()}
    assert far.keys() == labels.keys()
    for name in ("a", "b"):
        kinds = {(labels[k], far[k][0] <= far[k][1]) for k in far if k[0] == name}
        assert len(kinds) == len({k for k, _ in kinds})


def test_empty_and_wrong_arguments(spark, panel):
    assert transport.transport_regimes(panel.where("false"), ["p", "q"], 10, 5).count() == 0
    with pytest.raises(ValueError, match="stride"):
        transport.transport_regimes(panel, ["p", "q"], 5, 6)
    assert detectors.problems("wasserstein", window=0, states=2.5) == ["window must be at least 1, not 0", "states must be an integer, not 2.5"]
    assert detectors.detect(panel, "wasserstein", ["p", "q"], window=10, stride=5, states=2).count() == 173
