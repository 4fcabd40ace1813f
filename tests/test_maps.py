"""Feature maps, kernel costs by sums, and the segmentation that uses them."""

import numpy as np
import pytest

from seamline.operators import dynamic, maps, search
from seamline.plans import segmentation
from test_dynamic import panel_of


@pytest.fixture(scope="module")
def spread():
    """Rows whose variance changes at 60 and whose mean does not."""
    rng = np.random.default_rng(12)
    return np.concatenate([rng.normal(0, 0.5, (60, 2)), rng.normal(0, 4, (60, 2))])


def exact_cost(x, gamma):
    k = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    return lambda a, b: (b - a) - k[a:b, a:b].sum() / (b - a)


def test_bandwidth_rules(spark, spread):
    panel, v = panel_of(spark, {"a": spread, "b": 2 * spread}, ("p", "q")), spread.var(axis=0)
    d = np.sqrt(((spread[:, None] - spread) ** 2).sum(axis=2))
    want = {"median": 1 / (2 * np.median(d) ** 2), "sk_scale": 1 / (2 * spread.var()), "total_variance": 1 / (2 * v.sum()), "max_variance": 1 / (2 * v.max()), "unscaled_max_variance": 1 / (2 * v.max()), 0.3: 0.3}
    for rule, gamma in want.items():
        got = {r["series"]: r["gamma"] for r in maps.bandwidths(panel, ["p", "q"], rule).collect()}
        assert got["a"] == pytest.approx(gamma) and got["b"] == pytest.approx(gamma if rule == 0.3 else gamma / 4)
    with pytest.raises(ValueError, match="bandwidth"):
        maps.bandwidths(panel, ["p"], "other")


@pytest.mark.parametrize(("to", "error"), [("pairs", 0.05), ("rff", 0.09), ("nystroem", 0.05)])
def test_products_of_features_are_the_kernel(spark, spread, to, error):
    panel = panel_of(spark, {"a": spread}, ("p", "q"))
    if to == "pairs":
        out = maps.fourier_pairs(panel, ["p", "q"], 200, 0.2)
    else:
        out = maps.mapped(panel, ["p", "q"], to, n=200 if to == "rff" else 60, gamma=0.2)
    z = np.array([r["z"] for r in out.orderBy("t").collect()])
    k = np.exp(-0.2 * ((spread[:, None] - spread) ** 2).sum(axis=2))
    assert np.sqrt(((z @ z.T - k) ** 2).mean()) < error
    assert out.columns == [*panel.columns, "z"]
    if to == "pairs":
        assert np.allclose((z * z).sum(axis=1), 1)


def test_kernel_splits_are_near_the_exact_ones(spark, spread):
    panel = panel_of(spark, {"a": spread}, ("p", "q"))
    out, names = maps.kernel_costed(panel, ["p", "q"], "rbf", 0.2, n=300)
    r = dynamic.optimal_splits(out, 1, names).first()
    cost = exact_cost(spread, 0.2)
    best = min(range(10, 111, 5), key=lambda t: cost(0, t) + cost(t, 120))
    assert abs(r["b"] - best) <= 5 and r["cost"] == pytest.approx(cost(0, r["b"]) + cost(r["b"], 120), rel=0.02)
    found = search.candidates(panel, "dynp", "rbf", 1, 0.2, columns=["p", "q"]).first()
    assert abs(found["b"] - 60) <= 5


def test_grid_of_maps():
    got = maps.map_grid(["raw", "rff", "nystroem"], [10, 20], [{"gamma": "median"}, {"kernel": "linear"}], repeats=2)
    assert sum(g["to"] == "raw" for g in got) == 1 and sum(g["to"] == "rff" for g in got) == 4 and sum(g["to"] == "nystroem" for g in got) == 4
    with pytest.raises(ValueError, match="unknown map"):
        maps.map_grid(["other"])


def test_segmentation_by_a_kernel_sees_a_change_of_spread(spark, spread):
    panel = panel_of(spark, {"a": spread}, ("p", "q"))
    out, names = maps.kernel_costed(panel, ["p", "q"], "rbf", "median")
    got = segmentation.segment(out, ["p", "q"], {"base": {"depth": 1, "rounds": 99}}, searched=names).where("status = 'valid'").collect()
    assert len(got) == 1 and abs(got[0]["b"] - 60) <= 5


def test_segmentation_tests_several_candidates(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(m, 1, 70) for m in (0, 5, 0)])
    panel = panel_of(spark, {"a": x})
    configs = {m: {"depth": 1, "search": m, "n_breaks": 3, "kind": "hotelling", "width": 30} for m in ("dynp", "binseg", "wbs")} | {"pelt": {"search": "pelt", "depth": 2, "n_breaks": 2, "lag_rule": "decay", "width_rule": "ess", "share": 0.5, "kind": "ks"}}
    rows = segmentation.segment(panel, configs=configs).collect()
    for run in ("dynp", "binseg", "wbs"):
        own = [r for r in rows if r["run"] == run]
        assert len(own) >= 2 and sum(r["status"] == "valid" for r in own) == 1
        valid = next(r for r in own if r["status"] == "valid")
        assert all((r["p"], -r["stat"]) >= (valid["p"], -valid["stat"]) for r in own if r["status"] != "invalid")
        assert {r["status"] for r in own if abs(r["b"] - 70) <= 5 or abs(r["b"] - 140) <= 5} == {"valid", "passed over"}
    found = [r["b"] for r in rows if r["run"] == "pelt" and r["status"] == "valid"]
    assert len(found) == 2 and all(min(abs(b - 70), abs(b - 140)) <= 5 for b in found)


def test_at_most_so_many_candidates(spark):
    panel = panel_of(spark, {"a": np.random.default_rng(0).normal(size=300)})
    rows = segmentation.segment(panel, configs={"x": {"depth": 1, "search": "binseg", "n_breaks": 12, "most": 4, "kind": "hotelling"}}).collect()
    every = sorted(r["b"] for r in search.candidates(panel, "binseg", n_breaks=12).collect())
    picked = [every[i * (len(every) - 1) // 3] for i in range(4)]
    assert sorted(r["b"] for r in rows) == [b for b in picked if 5 < b < 295]


def test_binary_splits_are_those_of_the_plain_rounds(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(m, 1, n) for m, n in ((0, 60), (3, 40), (-1, 70), (2, 30))])
    cost = lambda a, b: float(((x[a:b] - x[a:b].mean()) ** 2).sum())
    edges, want = [0, 200], []
    for _ in range(6):
        ways = [(cost(a, z) - cost(a, b) - cost(b, z), -a, b) for a, z in zip(edges, edges[1:]) for b in range(a + 10, z - 9, 5)]
        gain, _, b = max(ways, key=lambda w: (w[0], w[1], -w[2]))
        edges = sorted([*edges, b])
        want.append((b, gain))
    got = search.binary_splits(panel_of(spark, {"a": x}), 6).orderBy("round").collect()
    assert [r["b"] for r in got] == [b for b, _ in want] and [r["gain"] for r in got] == pytest.approx([g for _, g in want])


def plain_wild(x, spans, least, most):
    """The rule of pools of intervals, depth first."""

    def best(a, z):
        ways = [(np.sqrt((b - a) * (z - b) / (z - a)) * np.linalg.norm(x[a:b].mean(axis=0) - x[b:z].mean(axis=0)), -b) for b in range(a + least, z - least + 1)]
        return max(ways, default=None)

    pool = [(*w, a, z) for a, z in spans if (w := best(a, z))]
    s = np.array([p[0] for p in pool])
    mad = np.median(np.abs(s - np.median(s)))
    limit, found = min(np.sqrt(2 * np.log(len(x))) * (1.4826 * mad + 1e-8), np.quantile(s, 0.75)), []

    def split(lo, hi):
        ways = [p[:2] for p in pool if p[2] >= lo and p[3] <= hi and lo + least <= -p[1] <= hi - least] + ([w] if (w := best(lo, hi)) else [])
        if hi - lo < 2 * least or not ways or max(ways)[0] <= limit or len(found) >= most:
            return
        b = -max(ways)[1]
        found.append(b)
        split(lo, b)
        split(b, hi)

    split(0, len(x))
    return found


def test_wild_splits_over_columns_and_up_to_a_number(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal((0, m), 1, (50, 2)) for m in (0, 6, -6, 2)])
    panel = panel_of(spark, {"a": x}, ("p", "q"))
    spans = [(r["lo"], r["hi"]) for r in search.random_spans(panel, 60).select("lo", "hi").distinct().collect()]
    for most in (99, 2):
        got = [r["b"] for r in search.wild_splits(panel, 60, columns=["p", "q"], limit="pool", n_breaks=most).collect()]
        assert sorted(got) == sorted(plain_wild(x, spans, 10, most))
    assert search.wild_splits(panel, 60, columns=["p", "q"], limit="pool", rows_a_break=200).count() == 1
