import datetime as dt

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from seamline.functions import evaluation, features, labels
from seamline.operators import detectors, frames, reduce, search, twosample
from seamline.plans import segmentation
from seamline.sources import panels
from seamline.streaming import incremental


@pytest.fixture(scope="module")
def step():
    rng = np.random.default_rng(3)
    return np.concatenate([rng.normal(0, 1, 100), rng.normal(6, 1, 100)])[:, None]


@pytest.mark.parametrize("name", list(search.KERNELS))
def test_kernels_find_a_planted_break(step, name):
    found = search.KERNELS[name](step, n_breaks=1) if name == "bottomup" else search.KERNELS[name]((6 - step) / 4)
    assert any(abs(b - 100) <= 5 for b in found)


def test_kernels_on_constant_series():
    flat = np.zeros((60, 1))
    assert search.online_bayes(flat) == []


def test_permutation_and_tails(step):
    same = twosample.permutation_test(step[:40], step[40:80])
    assert 0 < same[1] <= 1 and abs(twosample.f_tail(4.0, 1, 10) - 0.0734) < 1e-3
    assert twosample.crosier(step[:50], step[100:150]) > twosample.crosier(step[:50], step[50:100])


def test_dwell_keeps_long_runs():
    assert detectors.dwell(np.array([0, 0, 0, 1, 0, 0, 0, 2, 2, 2]), 2).tolist() == [0] * 7 + [2] * 3
    assert detectors.dwell(np.array([3, 0, 0, 0, 1, 2, 2, 2, 5]), 2).tolist() == [0] * 4 + [1] + [2] * 4  # ends give way, a run between two labels stays
    assert detectors.dwell(np.array([0, 0, 1, 0, 1, 1, 1]), 2).tolist() == [0, 0, 0, 0, 1, 1, 1]


def test_spark_search_agrees_with_kernel(spark, step):
    panel = spark.createDataFrame([("a", t, dt.date(2020, 1, 1) + dt.timedelta(t), float(v)) for t, v in enumerate(step[:, 0])], "series string, t int, date date, value double")
    b = search.cusum_split(panel).first()["b"]
    k = np.arange(10, 191)
    left, right = step[:, 0].cumsum()[k - 1] / k, (step.sum() - step[:, 0].cumsum()[k - 1]) / (200 - k)
    assert b == k[(np.sqrt(k * (200 - k) / 200) * abs(left - right)).argmax()]
    lab = labels.labels_of(panel, spark.createDataFrame([("a", 100)], "series string, b long"))
    assert labels.breaks_of(lab).first()["b"] == 100 and labels.intervals(lab).count() == 2
    found = [r["b"] for r in segmentation.segment(panel).where("status = 'valid' and level = 1").collect()]
    assert len(found) == 1 and abs(found[0] - 100) <= 5
    assert panels.business_days(spark, "2020-01-01", 10).count() == 10


def test_features_and_frames(spark):
    cols = ["USA_Y002p0", "USA_Y005p0", "USA_Y010p0", "DEU_Y010p0"]
    assert set(features.butterflies(cols)) == {"fly_USA_Y002p0_USA_Y005p0_USA_Y010p0"}
    assert set(features.cross_spreads(cols)) == {"DEU_USA_Y010p0_spd"}
    assert frames.clean_names(["a.b", "a_b", "x"]) == ["a_b", "a_b_2", "x"]
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (float("inf"),)], "x double")
    assert frames.finite(df, ["x"]).count() == 1
    ew = features.ewma(spark.createDataFrame([("a", t, None, float(t)) for t in range(5)], "series string, t int, date date, value double"), 3)
    y = [0.0]
    for t in range(1, 5):
        y.append(0.5 * y[-1] + 0.5 * t)
    assert [r["ewma"] for r in ew.orderBy("t").collect()] == pytest.approx(y)
    with pytest.raises(ValueError):
        features.expression("__import__('os')")
    assert reduce.rank_for(np.array([5.0, 3.0, 2.0]), 0.8) == 2


def test_csv_source(spark, tmp_path):
    (tmp_path / "x.csv").write_text("Date;a;b\n2020-01-01;1;2\n2020-01-05;3;4\nbad;5;6\n")
    df = panels.read(spark, "csv", str(tmp_path / "x.csv"), sep=";", columns=["a"], start="2020-01-02")
    assert [r["a"] for r in df.collect()] == [3]
    with pytest.raises(ValueError):
        panels.read(spark, "other", "x")
    with pytest.raises(KeyError):
        panels.read(spark, "csv", str(tmp_path / "x.csv"), sep=";", columns=["z"])


def test_locked_breaks_and_consensus(spark):
    assert incremental.locked([100, 300], [101, 290, 500], 500, 80, 5) == [100, 290, 300, 500]
    assert incremental.locked([338], [341], 500, 80, 5) == [341]  # from the frontier on the newer one counts
    assert incremental.locked([100], [103, 200], 500, 80, 5) == [100, 200]
    runs = spark.createDataFrame([("a", r, b) for r, b in (("x", 100), ("y", 102), ("z", 300), ("z", 300))], "series string, run string, b long")
    got = segmentation.consensus(runs, 5).collect()
    assert [(r["b"], round(r["support"], 3)) for r in got] == [(101, 0.667)]
    assert sorted(r["b"] for r in segmentation.consensus(runs, 5, how="union").collect()) == [101, 300]
    assert segmentation.consensus(runs, 5, how="intersection").count() == 0
    close = spark.createDataFrame([("a", "x", 101), ("a", "y", 102)], runs.schema)
    assert segmentation.consensus(close, 5).first()["b"] == 102  # 101.5, to even
    merged = labels.merge_close(spark.createDataFrame([("a", b) for b in (10, 12, 30)], "series string, b long"), 5)
    assert sorted(r["b"] for r in merged.collect()) == [12, 30]


def test_stream_buckets(spark, tmp_path):
    rows = spark.createDataFrame([(dt.datetime(2024, 1, 1, h, m), "a", float(m)) for h in range(9) for m in (5, 15)], "ts timestamp, kind string, v double")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    got = []
    incremental.each_batch(lambda df, _: got.extend(df.collect()), incremental.buckets(stream, "ts", "kind", "v"), str(tmp_path / "cp"), "update").awaitTermination(60)
    assert sorted(r["date"].hour for r in got) == list(range(9)) and all(r["value"] == 10.0 for r in got)


def test_precision_of_evaluation(spark):
    t = spark.createDataFrame([("a", 100), ("a", 200)], "series string, b long")
    f = spark.createDataFrame([("a", 103), ("a", 250)], "series string, b long")
    assert {r["b"]: r["near"] for r in evaluation.nearest(t, f).collect()} == {100: 103, 200: 250}
    assert evaluation.hausdorff(t, f).first()["distance"] == 50
    assert t.groupBy("series").agg(F.count("*")).count() == 1


def test_rolling_windows_test_every_row(spark, step):
    rows = [("a", t, float(v)) for t, v in enumerate(step[:, 0])]
    panel = spark.createDataFrame(rows, "series string, t int, value double")
    got = {r["label"]: r["stat"] for r in twosample.mmd(twosample.rolling_windows(panel), 0.1).collect()}
    assert set(got) == set(range(45, 156))
    k = np.exp(-0.1 * (step - step.T) ** 2)
    for b in (45, 83, 100, 155):
        x, y = np.arange(b - 45, b - 5), np.arange(b + 5, b + 45)
        assert abs(got[b] - (k[np.ix_(x, x)].mean() + k[np.ix_(y, y)].mean() - 2 * k[np.ix_(x, y)].mean())) < 1e-9
    assert abs(max(got, key=got.get) - 100) <= 5


def test_smirnov_is_what_sql_says_at_the_end_and_of_nulls(spark, tmp_path):
    from seamline import queries

    rng, first = np.random.default_rng(5), dt.datetime(2020, 1, 1)
    price = lambda t: None if t % 7 == 0 else float(rng.normal(1e6, 1e5))
    # the last row of "short" is its break, "long" has two rows behind the lag
    rows = [(s, first + dt.timedelta(t), price(t)) for s, days in (("short", 201), ("long", 207)) for t in range(days)]
    at = f"{tmp_path}/orders.parquet"
    spark.createDataFrame(rows, "o_orderpriority string, o_orderdate timestamp_ntz, o_totalprice double").write.parquet(at)
    with duckdb.connect() as db:
        db.execute(f"create view orders as select * from '{at}/*.parquet'")
        want = db.execute(queries.ORACLE["tst_kolmogorov_smirnov"]).fetchall()
    got = queries.QUERIES["tst_kolmogorov_smirnov"](spark, str(tmp_path)).collect()
    told = lambda rows: sorted((s, b, repr(float(v))) for s, b, v in rows)
    assert told(got) == told(want) and [s for s, _, v in got if np.isnan(v)] == ["short"] and len(got) == 2


def test_persistence_counts_runs_without_a_break(spark):
    breaks = spark.createDataFrame([("a", 100)], "series string, b long")
    runs = spark.createDataFrame([("a", "base", 100), ("a", "x", 140)], "series string, run string, b long")
    assert evaluation.persistence(breaks, runs, 7, 4).first()["persistence"] == 0.25
    assert tuple(evaluation.persistence(breaks, runs, 7, 4, low=0.5).first()) == ("a", 100, 0.25, 4, True)


def test_rates_of_all_sources(spark):
    from seamline import queries

    d = "/root/testdata/sf0.001"
    every = {(r["date"], r["source"]): r for r in queries.rates(spark, d).collect()}
    assert {s for _, s in every} == set(queries.SOURCES.values()) and len(queries.RATES) == 25
    got = {r["date"]: r for r in queries.QUERIES["src_rates_wide_all"](spark, d).collect()}
    assert set(got) == {m for m, _ in every}
    for (m, s), r in every.items():
        assert [got[m][f"{s}_{t}"] for t in queries.TENORS] == [r[t] for t in queries.TENORS]
    whole = {k for k, r in every.items() if None not in (r[t] for t in queries.TENORS)}
    assert {(r["date"], r["source"]) for r in queries.QUERIES["dr_nelson_siegel"](spark, d).collect()} == whole
