import json

import numpy as np
import pytest

from seamline.functions import evaluation, features, labels
from seamline.operators import reduce
from seamline.plans import explain
from seamline.sources import sinks

BREAKS = "series string, b long"


def test_detection_matches_one_to_one_and_scores_what_is_missing(spark):
    truth = spark.createDataFrame([("a", 10), ("a", 50), ("only true", 5)], BREAKS)
    found = spark.createDataFrame([("a", 12), ("a", 13), ("a", 90), ("only found", 7)], BREAKS)
    got = {r["series"]: r for r in evaluation.detection(truth, found, 5).collect()}
    assert got["a"]["precision"] == pytest.approx(1 / 3) and got["a"]["recall"] == 0.5 and got["a"]["f1"] == pytest.approx(0.4)
    assert tuple(got["only true"])[1:] == (0, 0, 0, 0) and tuple(got["only found"])[1:] == (0, 0, 0, 1)
    assert evaluation.detection(truth.limit(0), found.limit(0)).count() == 0


def test_decay_lag_against_numpy(spark):
    rng = np.random.default_rng(1)
    x = np.convolve(rng.normal(size=260), np.ones(8), "valid")[:240]
    rows = spark.createDataFrame([("a", t, float(v)) for t, v in enumerate(x)], "series string, t int, value double")
    got = features.decay_lag(rows, spark.createDataFrame([("a", 120), ("a", 10)], BREAKS), 100, 40, 0.1).collect()
    y = x[20:220] - x[20:220].mean()
    r = np.array([(y[: 200 - k] * y[k:]).sum() / (y * y).sum() for k in range(41)])
    assert [tuple(g) for g in got] == [("a", 120, int(np.flatnonzero(abs(r) < 0.1)[0]))]
    flat = spark.createDataFrame([("a", t, 1.0) for t in range(40)], rows.schema)
    assert features.decay_lag(flat, spark.createDataFrame([("a", 20)], BREAKS), 20, 7).first()["lag"] == 7


def test_column_groups():
    got = features.column_groups(["EUR_Y1", "EUR_Y2", "AME_Y1", "other"])
    assert got == {"source EUR": ["EUR_Y1", "EUR_Y2"], "source AME": ["AME_Y1"], "tenor Y1": ["EUR_Y1", "AME_Y1"], "tenor Y2": ["EUR_Y2"], "all": ["EUR_Y1", "EUR_Y2", "AME_Y1", "other"]}


@pytest.fixture(scope="module")
def two(spark):
    rng = np.random.default_rng(4)
    rows = [("s", t, int(t >= 60), *(float(v + 8 * (t >= 60)) for v in rng.normal(size=4))) for t in range(120)]
    return spark.createDataFrame(rows, "series string, t int, label int, A_x double, A_y double, B_x double, B_y double")


def test_distances_and_probabilities(two):
    far = reduce.segment_distances(two, ["A_x", "B_x"]).where("(segment = 1) = (t >= 60) and distance > 5")
    assert far.count() == 0
    near = reduce.centre_distances(two, ["A_x", "B_x"], 2).selectExpr("label", "c1 < c2 as side").distinct().count()
    assert near == 2
    p = reduce.responsibilities(two, ["A_x", "B_x"], 2).selectExpr("abs(p1 + p2 - 1) as gap").agg({"gap": "max"}).first()[0]
    assert p < 1e-6


def test_tree_and_left_out_groups(two):
    depth, _, out = explain.tree_for(two, ["A_x", "B_x"], 0.95)
    assert depth == 1 and out.where("label <> predicted").count() <= 6
    got = {r["run"]: r["recovery"] for r in explain.without_groups(two, ["A_x", "A_y", "B_x", "B_y"], width=20).collect()}
    assert set(got) == {f"s without {g}" for g in ("source A", "source B", "tenor x", "tenor y")} and set(got.values()) == {1.0}
    with pytest.raises(ValueError):
        explain.without_groups(two, ["A_x"])


def test_event_lines_and_legends(spark, tmp_path):
    breaks = spark.createDataFrame([("s", 3, True), ("s", 9, False)], "series string, b long, confirmed boolean")
    sinks.write_events(breaks, "r1", f"{tmp_path}/events")
    lines = [json.loads(r["value"]) for r in spark.read.text(f"{tmp_path}/events").collect()]
    assert sorted(x["event"] for x in lines) == ["breakpoint_confirmed", "breakpoint_rejected", "run_complete", "run_started"]
    assert [(x["n_bkpts"], x["n_invalid"]) for x in lines if x["event"] == "run_complete"] == [(1, 1)]
    runs = spark.sql("select 2 as label, date'2020-01-01' as start, date'2020-02-01' as end")
    assert labels.legends(runs).first()["legend"] == "2 from 2020-01-01 to 2020-02-01"
