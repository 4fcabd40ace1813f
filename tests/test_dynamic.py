"""Exact segmentation against plain dynamic programming."""

import numpy as np
import pytest

from seamline.operators import dynamic, search


def panel_of(spark, series, columns=("value",)):
    rows = [(name, t, *map(float, row)) for name, x in series.items() for t, row in enumerate(np.asarray(x, float).reshape(len(x), -1))]
    return spark.createDataFrame(rows, "series string, t int, " + ", ".join(f"{c} double" for c in columns))


def cost_of(x):
    x = np.asarray(x, float).reshape(len(x), -1)
    return lambda a, b: float(((x[a:b] - x[a:b].mean(axis=0)) ** 2).sum())


def plain_optimum(x, k, min_size, jump):
    n, cost = len(x), cost_of(x)
    nodes = sorted({*range(0, n, jump), n})
    best = {e: (cost(0, e), []) for e in nodes if e >= min_size}
    for _ in range(k):
        best = {e: min(((f + cost(s, e), [*b, s]) for s, (f, b) in best.items() if e - s >= min_size), default=None, key=lambda x: x[0]) for e in nodes}
        best = {e: x for e, x in best.items() if x}
    return best.get(n)


def plain_pelt(x, penalty, min_size, jump):
    n, cost = len(x), cost_of(x)
    best = {0: (-penalty, [])}
    for e in sorted({*range(0, n, jump), n}):
        ways = [(f + cost(s, e) + penalty, [*b, s]) for s, (f, b) in best.items() if e - s >= min_size]
        if e and ways:
            best[e] = min(ways, key=lambda x: x[0])
    return [b for b in best[n][1] if b] if n in best else []


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(8)
    steps = np.concatenate([rng.normal(m, 1, n) for m, n in ((0, 50), (4, 35), (-3, 43), (2.5, 31))])
    return {"steps": steps, "noise": rng.normal(0, 1, 93), "flat": np.ones(60), "short": rng.normal(0, 1, 17), "one": np.ones(1)}


@pytest.mark.parametrize(("k", "size", "jump", "least"), [(1, 256, 5, 10), (3, 8, 5, 10), (2, 40, 1, 2)])
def test_k_breaks_are_the_best_ones(spark, series, k, size, jump, least):
    got = {}
    for r in dynamic.optimal_splits(panel_of(spark, series), k, min_size=least, jump=jump, size=size).collect():
        got.setdefault(r["series"], {})[r["k"]] = (r["b"], r["cost"])
    for name, x in series.items():
        want = plain_optimum(x, k, least, jump)
        if want is None:
            assert name not in got
            continue
        assert sorted(got[name]) == list(range(1, k + 1))
        found, cost = [b for _, (b, _) in sorted(got[name].items())], got[name][1][1]
        assert cost == pytest.approx(want[0], abs=1e-8)
        edges = [0, *found, len(x)]
        assert sum(map(cost_of(x), edges, edges[1:])) == pytest.approx(want[0], abs=1e-8) and min(np.diff(edges)) >= least
        if name in ("steps", "noise"):
            assert found == want[1]


@pytest.mark.parametrize(("size", "jump", "least", "penalty"), [(256, 5, 10, None), (12, 5, 10, None), (70, 1, 2, 0.5)])
def test_penalised_breaks_are_the_best_ones(spark, series, size, jump, least, penalty):
    panel = panel_of(spark, series)
    got = {}
    for r in dynamic.penalised_splits(panel, penalty, min_size=least, jump=jump, size=size).collect():
        got.setdefault(r["series"], []).append(r["b"])
    for name in ("steps", "noise", "short", "one"):
        x = series[name]
        price = penalty if penalty is not None else np.log(max(len(x), 2)) * x.var()
        assert sorted(got.get(name, [])) == plain_pelt(x, price, least, jump), name


def test_several_columns_and_the_penalised_optimum_by_layers(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(m, 1, (n, 3)) for m, n in (((0, 0, 0), 60), ((2, 0, -2), 60), ((2, 3, 0), 45))])
    panel = panel_of(spark, {"a": x}, ("p", "q", "r"))
    found = sorted(r["b"] for r in dynamic.penalised_splits(panel, 40.0, ["p", "q", "r"], size=20).collect())
    by_layer = [dynamic.optimal_splits(panel, k, ["p", "q", "r"]).orderBy("k").collect() for k in (1, 2, 3)]
    best = min(by_layer, key=lambda rows: rows[0]["cost"] + 40.0 * len(rows))
    assert found == [r["b"] for r in best] == [60, 120]


def test_empty_panel(spark):
    empty = panel_of(spark, {"a": [1.0]}).limit(0)
    assert dynamic.optimal_splits(empty, 2).count() == 0 and dynamic.penalised_splits(empty).count() == 0
    with pytest.raises(ValueError, match="one break"):
        dynamic.optimal_splits(empty, 0)


def test_sums_go_on_from_block_to_block(spark):
    x = np.arange(50, dtype=float)
    got = search.edges_of(panel_of(spark, {"a": x, "b": x[:7]}), ["value"], block=8)
    want = {("a", t): x[:t].sum() for t in range(51)} | {("b", t): x[:t].sum() for t in range(8)}
    assert {(r["series"], r["t"]): r["sums"][0] for r in got.collect()} == want
