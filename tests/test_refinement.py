"""Refinement until the loss is small."""

import numpy as np

from seamline.plans import refinement
from test_dynamic import panel_of


def test_losses_are_those_of_the_regimes(spark):
    x = np.arange(10, dtype=float)
    panel = panel_of(spark, {"a": np.c_[x, x * x], "b": np.c_[x, x]}, ("p", "q"))
    breaks = spark.createDataFrame([("a", 4, 1), ("a", 0, 1), ("a", 99, 1)], "series string, b long, level int")
    got = {(r["series"], r["lo"], r["hi"], r["column"]): r["loss"] for r in refinement.regime_losses(panel, breaks, ["p", "q"]).collect()}
    want = {("a", 0, 4, "p"): x[:4].var(), ("a", 4, 10, "p"): x[4:].var(), ("a", 0, 4, "q"): (x * x)[:4].var(), ("a", 4, 10, "q"): (x * x)[4:].var(), ("b", 0, 10, "p"): x.var(), ("b", 0, 10, "q"): x.var()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_the_worst_regime_is_segmented_until_the_loss_is_small(spark):
    rng = np.random.default_rng(11)
    p = np.concatenate([rng.normal(m, 1, 60) for m in (0, 6, 6, 0)])
    q = np.concatenate([rng.normal(m, 1, 60) for m in (0, 0, 5, 5)])
    panel = panel_of(spark, {"a": np.c_[p, q], "calm": rng.normal(0, 1, (240, 2))}, ("p", "q"))
    held, steps = refinement.refine_until(panel, 2.0, ["p", "q"], worst_columns=1, depth=1, kind="hotelling", width=30)
    found = sorted(r["b"] for r in held.collect())
    assert len(found) == 3 and all(abs(b - k) <= 5 for b, k in zip(found, (60, 120, 180)))
    went = steps.orderBy("round").collect()
    assert {r["series"] for r in went} == {"a"} and went[0]["lo"] == 0 and went[0]["hi"] == 240 and all(r["found"] == 1 for r in went) and all(r["loss"] > 2 for r in went)
    again = refinement.regime_losses(panel, held, ["p", "q"]).agg({"loss": "max"}).first()[0]
    assert again <= 2.5
    none, _ = refinement.refine_until(panel, 100.0, ["p", "q"])
    assert none.count() == 0
    seeds = held.where("b < 100").select("series", "b", "level")
    more, steps = refinement.refine_until(panel, 0.1, ["p", "q"], seeds, rounds=1, depth=1, kind="hotelling", width=30)
    assert more.where("round = 0").count() == 1 and more.where("round = 1").count() >= 1 and {r["series"] for r in steps.collect()} == {"a", "calm"}
