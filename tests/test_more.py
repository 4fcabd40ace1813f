import datetime as dt
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from seamline.functions import evaluation, features, hyper, insights, labels, scores
from seamline.operators import frames, reduce, search, twosample
from seamline.plans import explain, segmentation
from seamline.sources import panels, sinks
from seamline.streaming import incremental

BREAKS, LEVELS = "series string, b long", "series string, b long, level int"


def panel_of(spark, **series):
    rows = [(s, t, dt.date(2020, 1, 1) + dt.timedelta(t), float(v)) for s, x in series.items() for t, v in enumerate(x)]
    return spark.createDataFrame(rows, "series string, t int, date date, value double")


@pytest.fixture(scope="module")
def noise():
    return np.random.default_rng(8).normal(size=400)


@pytest.fixture(scope="module")
def steps(spark, noise):
    """Breaks at 100, 200 and 300, the middle one the largest."""
    return panel_of(spark, a=noise + np.repeat([0, 6, 30, 36], 100), flat=np.zeros(90), noise=noise[:200])


def test_levels_start_at_one_and_find_planted_breaks(steps):
    found = segmentation.segment(steps, configs={"one": {"depth": 1}, "two": {"depth": 2}}).collect()
    of = lambda run, level: sorted(r["b"] for r in found if r["series"] == "a" and r["run"] == run and r["level"] == level and r["status"] == "valid")
    assert of("one", 1) == of("two", 1) and abs(of("one", 1)[0] - 200) <= 5
    assert [round(b, -2) for b in of("two", 2)] == [100, 300]
    assert {r["level"] for r in found if r["run"] == "one"} == {1} and max(r["level"] for r in found) == 2
    with pytest.raises(KeyError):
        segmentation.segment(steps, configs={"x": {"dept": 1}})


def test_splits_near_the_ends_are_passed_over(spark):
    x = np.r_[np.full(12, 50.0), np.zeros(88)]
    got = segmentation.segment(panel_of(spark, a=x), configs={"x": {"depth": 1, "min_size": 2, "jump": 1, "lag": 0}}).first()
    assert got["b"] == 12
    early = segmentation.segment(panel_of(spark, a=np.r_[np.full(4, 50.0), np.zeros(96)]), configs={"x": {"depth": 1, "min_size": 2, "jump": 1}}).first()
    assert 5 < early["b"] < 95


def test_spans_are_segmented_alone(steps, spark):
    spans = spark.createDataFrame([("a", "tail", 200, 400), ("a", "head", 0, 150)], "series string, span string, lo long, hi long")
    got = {r["run"]: r["b"] for r in segmentation.segment(steps, configs={"base": {"depth": 1}}, spans=spans).where("status = 'valid'").collect()}
    assert abs(got["tail"] - 300) <= 5 and abs(got["head"] - 100) <= 5
    prefix = segmentation.prefix_runs(steps.where("series = 'a'"), (0.5,), depth=1).collect()
    assert [(r["run"], round(r["b"], -2)) for r in prefix] == [("first 0.5", 100)]
    wrong = labels.labels_of(steps, spark.createDataFrame([("a", 200)], BREAKS))
    assert sorted(round(r["b"], -2) for r in segmentation.refine(steps.where("series = 'a'"), wrong, 2, depth=1).where("status = 'valid'").collect()) == [100, 300]


def test_binary_and_wild_splits(steps):
    a = steps.where("series = 'a'")
    got = {r["round"]: r["b"] for r in search.binary_splits(a, 3).collect()}
    assert abs(got[1] - 200) <= 5 and sorted(round(got[k], -2) for k in (2, 3)) == [100, 300]
    assert search.binary_splits(a).count() == 8  # one for each 50 rows
    wild = {r["series"]: set() for r in steps.select("series").distinct().collect()}
    for r in search.wild_splits(steps, 60).collect():
        wild[r["series"]].add(round(r["b"], -1))
    assert {100, 200, 300} <= wild["a"] and not wild["flat"] and len(wild["noise"]) <= 1


def test_rbf_split_against_plain_costs(spark, noise):
    x = np.r_[noise[:40], noise[40:90] + 3]
    got = search.best_split_rbf(panel_of(spark, a=x), 0.5).first()
    k = np.exp(-np.clip(0.5 * (x[:, None] - x) ** 2, 1e-2, 1e2))
    np.fill_diagonal(k, 1)
    cost = lambda i, j: (j - i) - k[i:j, i:j].sum() / (j - i)
    best = min(range(10, 81, 5), key=lambda t: cost(0, t) + cost(t, 90))
    assert got["b"] == best and got["cost"] == pytest.approx(cost(0, best) + cost(best, 90))


@pytest.mark.parametrize("method", ["dynp", "binseg", "wbs", "cusum", "window", "pelt"])
def test_every_search_finds_the_step(spark, noise, method):
    p = panel_of(spark, a=noise[:120] + np.repeat([0, 9], 60))
    assert any(abs(r["b"] - 60) <= 5 for r in search.candidates(p, method).collect())
    with pytest.raises(ValueError):
        search.candidates(p, "other")


@pytest.mark.parametrize("kind", twosample.KINDS)
def test_tests_tell_a_shift_from_none(kind):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(40, 2)), rng.normal(size=(40, 2))
    far, near = twosample.two_sample(x, y + 3, kind), twosample.two_sample(x, y, kind)
    assert far[1] < 0.05 < near[1] and far[0] > near[0]
    assert twosample.two_sample(x[:4], y, kind) == (0.0, 1.0)


def test_exact_tail_of_the_gap():
    for n, m in ((4, 4), (3, 5)):
        every = list(itertools.combinations(range(n + m), n))
        gaps = []
        for own in every:
            steps = np.array([1 / n if i in own else -1 / m for i in range(n + m)])
            gaps.append(np.abs(steps.cumsum()).max())
        for g in (0.25, 0.5, 0.75, 1.0):
            assert twosample.ks_tail(g, n, m) == pytest.approx(np.mean(np.array(gaps) >= g - 1e-9))


def test_hotelling_against_its_formula():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(30, 2)), rng.normal(size=(25, 2)) + 0.4
    cov = (29 * np.cov(x.T) + 24 * np.cov(y.T)) / 53 + 1e-6 * np.eye(2)
    gap = x.mean(axis=0) - y.mean(axis=0)
    t2 = 30 * 25 / 55 * gap @ np.linalg.inv(cov) @ gap
    assert twosample.hotelling_test(x, y)[0] == pytest.approx(t2)


def test_exponential_means_of_long_series(spark):
    rng = np.random.default_rng(4)
    for span, n in ((3, 700), (200, 5000), (1, 50)):
        x = rng.normal(size=n) + 5
        q, y, z, w = 1 - 2 / (span + 1), [x[0]], [], 0.0
        for v in x[1:]:
            y.append(q * y[-1] + (1 - q) * v)
        top = 0.0
        for v in x:
            top, w = q * top + v, q * w + 1
            z.append(top / w)
        p = panel_of(spark, a=x, b=-x)
        got = {(r["series"], r["t"]): r["ewma"] for r in features.ewma(p, span).collect()}
        assert [got["a", t] for t in range(n)] == pytest.approx(y) and got["b", n - 1] == pytest.approx(-y[-1])
        got = {r["t"]: r["ewma"] for r in features.ewma(p.where("series = 'a'"), span, adjust=True, least=3).collect()}
        assert got[1] is None and [got[t] for t in range(2, n)] == pytest.approx(z[2:])


def test_feature_gate_hook_and_generators(spark):
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(t), float(t % 7), float(t % 5), float(t % 3), float(t)) for t in range(40)]
    p = spark.createDataFrame(rows, "date date, USA_Y002p0 double, USA_Y010p0 double, DEU_Y010p0 double, EURUSD double")
    out = features.curve_features(p, 5, 6)
    assert out.columns == ["date", "USA_Y002p0", "USA_Y010p0", "DEU_Y010p0", "USA_Y002p0_minus_USA_Y010p0", "DEU_USA_Y010p0_spd", "EURUSD", "USA_Y010p0_vol", "DEU_Y010p0_vol", "USA_Y010p0_DEU_Y010p0_corr"]
    assert out.count() == 35
    made = spark.createDataFrame([(1, 1.0)], "date int, f0 double")
    assert features.featured(made).columns == ["date", "f0"]
    with pytest.raises(ValueError):
        features.featured(p)
    assert features.featured(p, generate=False).columns == p.columns
    assert features.featured(p, generator=lambda df, k: df.select("date", (F.col("EURUSD") * k).alias("x")), k=2).where("x = 4").count() == 1
    with pytest.raises(AttributeError):
        features.resolved("seamline.functions.features.nothing")
    with pytest.raises(TypeError):
        features.featured(p, generator=lambda df: 1)
    ew = features.with_ewma(p, ["EURUSD"], 3, keep_levels=False)
    assert ew.columns == ["date", "EURUSD_ewma"] and ew.count() == 40
    with pytest.raises(KeyError):
        features.with_ewma(p, ["no"])
    assert features.named({"columns": ["a"]}) == ["a"] and features.named({"a": 1, "b": 2}) == ["a", "b"] == features.named(["a", "b"])
    assert set(features.panel_groups(["A_x", "B_x"])) == {"source A", "source B"} and features.panel_groups(["p", "q", "r"]) == {"first half": ["p"], "second half": ["q", "r"]}
    assert features.panel_groups(["p"]) == {"all": ["p"]} and features.panel_groups(["p", "q"], [["q"], []]) == {"g0": ["q"]}


def test_curve_factors_are_in_years(spark):
    years, decay = [1.0, 2.0, 5.0, 10.0], 0.0609
    x = [decay * y for y in years]
    slope = [(1 - np.exp(-v)) / v for v in x]
    rates = [4 + 2 * s - 3 * (s - np.exp(-v)) for s, v in zip(slope, x)]
    p = spark.createDataFrame([(1, *map(float, rates))], "date int, a double, b double, c double, d double")
    got = reduce.curve_factors(p, ["a", "b", "c", "d"], years).first()
    assert tuple(got)[1:] == pytest.approx((4, 2, -3), abs=1e-6)
    best = reduce.curve_decay(p, ["a", "b", "c", "d"], years).first()
    assert best["decay"] == decay and best["sse"] < 1e-12 and best["slope"] == pytest.approx(2, abs=1e-6)
    with pytest.raises(ValueError):
        features.nelson_siegel([1.0, 2.0])


def test_hyper_parameters(spark, steps):
    assert hyper.sample_size(40, 200) == 80 and hyper.sample_size(40, 30) == 30 and hyper.sample_size(40, share=0.1) == 50 and hyper.sample_size(20, share=0.1) == 40
    with pytest.raises(KeyError):
        hyper.sample_size(40)
    with pytest.raises(ValueError):
        hyper.sample_size(40, share=2)
    got = hyper.chosen(steps, spark.createDataFrame([("a", 200)], BREAKS), "decay", "ess", share=0.5).first()
    assert 0 < got["lag"] <= 40 and 20 <= got["width"] <= 120 and got["samples"] <= 2 * got["width"]
    wide = spark.createDataFrame([("", t, float(t % 9), float((t * 7) % 11)) for t in range(60)], "series string, t int, x double, y double")
    parts = hyper.component_panel(wide, ["x", "y"], 0.999)
    assert parts.select("series").distinct().count() == 2
    assert hyper.widest_lag(parts, spark.createDataFrame([(30,)], "b long"), width=20, most=6).count() == 1


def test_scores_against_plain_python(spark, noise):
    rows = [("a", int(t >= 130), t, float(v + 4 * (60 <= t < 130))) for t, v in enumerate(noise[:300])] + [("a", 2, 300, 1.0)]
    df = spark.createDataFrame(rows, "series string, label int, t int, value double")
    x = {k: np.array([r[3] for r in rows if r[1] == k]) for k in (0, 1, 2)}

    def split(v, stat):
        v = v[:: int(np.ceil(len(v) / 80))] if len(v) > 80 else v
        cuts = sorted({int(c) for c in np.linspace(10, len(v) - 11, 5)}) if len(v) > 20 else []
        return max([0.0, *(stat(v[:c], v[c:], v) for c in cuts)])

    def energy(a, b, _):
        d = lambda p, q: np.abs(p[:, None] - q).mean()
        return 2 * d(a, b) - d(a, a) - d(b, b)

    def linear(a, b, v):
        g = 1 / (2 * np.median(np.abs(v[:, None] - v)) ** 2)
        n, k = min(len(a), len(b)) // 2 * 2, lambda p, q: np.exp(-g * (p - q) ** 2)
        a1, a2, b1, b2 = a[:n:2], a[1:n:2], b[:n:2], b[1:n:2]
        return (k(a1, a2) + k(b1, b2) - k(a1, b2) - k(a2, b1)).mean()

    def cusum(v):
        if len(v) < 4:
            return 0.0
        ref, c, most = v[: len(v) // 2], 0.0, 0.0
        for z in (v - ref.mean()) / np.sqrt(max(ref.var(ddof=1), 1e-8)):
            s = c + z
            c = 0.0 if abs(s) <= 0.5 else s * (1 - 0.5 / abs(s))
            most = max(most, abs(c))
        return most

    for name, plain in (("energy_split", lambda v: split(v, energy)), ("mmd_split", lambda v: split(v, linear)), ("cusum_intensity", cusum)):
        got = {r["label"]: r["score"] for r in scores.score(df, name).collect()}
        assert [got[k] for k in (0, 1, 2)] == pytest.approx([plain(x[k]) for k in (0, 1, 2)]), name
    assert scores.score(df, "mse_on_diff", order=2).where("label = 2").first()["score"] == 0
    with pytest.raises(ValueError):
        scores.score(df, "other")


def test_factor_residual_against_numpy(spark, noise):
    x = np.stack([noise[:90], 2 * noise[:90] + noise[90:180], noise[180:270]], axis=1)
    df = spark.createDataFrame([(t // 45, *map(float, r)) for t, r in enumerate(x)] + [(9, 1.0, 2.0, 3.0)], "label int, a double, b double, c double")
    got = {(r["label"], r["column"]): r["score"] for r in scores.factor_residual(df, ["a", "b", "c"]).collect()}
    for k in (0, 1):
        c = x[45 * k : 45 * k + 45] - x[45 * k : 45 * k + 45].mean(axis=0)
        u, s, v = np.linalg.svd(c, full_matrices=False)
        left = ((c - s[0] * np.outer(u[:, 0], v[0])) ** 2).mean(axis=0)
        assert [got[k, n] for n in "abc"] == pytest.approx(left.tolist())
    assert got[9, "a"] == 0


def test_insights(spark, noise):
    df = spark.createDataFrame([(t // 50, float(a), float(b + (t // 50) * 3)) for t, (a, b) in enumerate(zip(noise[:200], noise[200:]))], "label int, x double, y double")
    got = {(r["a"], r["b"]): r["d"] for r in insights.mahalanobis(df, ["x", "y"]).collect()}
    v = np.array(df.select("x", "y").collect())
    inv = np.linalg.inv(np.cov(v.T) + 1e-6 * np.eye(2))
    m = v.reshape(4, 50, 2).mean(axis=1)
    assert got[0, 3] == pytest.approx(np.sqrt((m[0] - m[3]) @ inv @ (m[0] - m[3]))) and got[2, 2] == 0 and len(got) == 16
    groups = {r["label"]: r["group"] for r in insights.regime_groups(df, ["y"], 2).collect()}
    assert groups[0] == groups[1] != groups[2] == groups[3]
    model, _ = explain.tree(df, ["x", "y"], 2)
    p = {(r["a"], r["b"]): r["p"] for r in insights.leaf_transitions(explain.leaf_masses(model, df, ["x", "y"])).collect()}
    assert set(p.values()) == {0.25} and len(p) == 16
    assert explain.in_basis_points(df, ["x", "y"], ("y",)).select("y").first() == df.select("y").first()


def test_hamming_against_every_renaming(spark):
    rng = np.random.default_rng(6)
    for n_a, n_b in ((3, 3), (2, 4), (4, 2)):
        a, b = rng.integers(0, n_a, 60), rng.integers(0, n_b, 60)
        ids = [*range(n_a), *[-9 - k for k in range(n_b)]]
        right = max(sum(m[y] == x for x, y in zip(a, b)) for m in itertools.permutations(ids, n_b))
        got = evaluation.temporal_hamming(spark.createDataFrame([("s", int(x), int(y)) for x, y in zip(a, b)], "series string, a int, b int")).first()
        assert got["hamming"] == 60 - right and got["accuracy"] == pytest.approx(right / 60)


def test_empty_sides_and_bands(spark):
    t, f = spark.createDataFrame([("a", 100), ("b", 5)], BREAKS), spark.createDataFrame([("a", 103), ("c", 9)], BREAKS)
    n = spark.createDataFrame([(s, 400) for s in "abcd"], "series string, n long")
    assert {r["series"]: r["distance"] for r in evaluation.hausdorff(t, f, n).collect()} == {"a": 3, "b": 400, "c": 400, "d": 0}
    runs = spark.createDataFrame([("a", "x", 104), ("a", "y", 109), ("a", "z", 80), ("a", "z", 60)], "series string, run string, b long")
    got = {r["series"]: (r["lo"], r["hi"]) for r in evaluation.bands(t, runs, 10, n).collect()}
    assert got == {"a": (82, 108), "b": (1, 15)}  # quantiles of 80, 104 and 109; nothing near, and the start of the series
    ab = spark.createDataFrame([("s", 0, 0), ("s", 0, 1), ("s", 1, 1), ("s", 1, 1)], "series string, a int, b int")
    one, two = evaluation.information(ab).first(), evaluation.information(ab, 2.0).first()
    assert two["v"] == pytest.approx(3 * one["homogeneity"] * one["completeness"] / (2 * one["homogeneity"] + one["completeness"]))


def test_break_tables(spark):
    p = panel_of(spark, a=range(60), b=range(10))
    b = spark.createDataFrame([("a", 20, 1), ("a", 40, 2), ("a", 50, 2)], LEVELS)
    n = spark.createDataFrame([("a", 60), ("b", 10)], "series string, n long")
    seeds = labels.seed_table(p, b)
    assert seeds.where("series = 'b'").first()["level"] == 0 and seeds.count() == 5
    assert sorted(map(tuple, labels.breaks_of_seeds(p, seeds).collect())) == sorted(map(tuple, b.collect()))
    tree = {(r["level"], r["lo"], r["hi"]): (r["parent_lo"], r["parent_hi"]) for r in labels.interval_tree(b, n).where("series = 'a'").collect()}
    assert tree == {(0, 0, 60): (None, None), (1, 0, 20): (0, 60), (1, 20, 60): (0, 60), (2, 20, 40): (20, 60), (2, 40, 50): (20, 60), (2, 50, 60): (20, 60)}
    lines = [r["line"] for r in sinks.hierarchy_lines(labels.interval_tree(b, n).where("series = 'a'")).orderBy("level", "lo").collect()]
    assert lines[0] == "[0,60)" and lines[-1] == "    [50,60)"
    put = labels.attached(b, spark.createDataFrame([("a", 5, 3), ("a", 30, 3), ("a", 20, 9)], LEVELS), 20, 50)
    assert {(r["b"], r["level"]) for r in put.collect()} == {(20, 1), (40, 9), (50, 2), (25, 3)}
    assert {(r["b"], r["level"]) for r in labels.combined([b, b.where("b = 20").withColumn("level", F.lit(7))]).collect()} == {(20, 7), (40, 2), (50, 2)}
    moved = labels.inside(labels.shifted(b, spark.createDataFrame([("a", 15)], "series string, start long")), n)
    assert sorted(r["b"] for r in moved.collect()) == [35, 55]
    both = spark.range(9).select(labels.window_of_row(labels.row_of_window(F.col("id"), 3, 7), 3, 7).alias("x"), "id")
    assert both.where("x <> id").count() == 0


def test_frames_and_sources(spark, tmp_path):
    p = panel_of(spark, a=range(100))
    assert frames.thinned(p, 30).count() == 25 and [r["t"] for r in frames.spread_over(p, 5, "t").orderBy("t").collect()] == [0, 24, 49, 74, 99]
    assert frames.spread_over(p, 200, "t").count() == 100
    wide = p.select("t", "date", F.col("value").alias("x"), (F.col("value") * 2).alias("y"))
    assert frames.from_matrix(frames.matrix(wide, ["x", "y"]), ["x", "y"]).exceptAll(wide).count() == 0
    curves = frames.curves_of(spark.createDataFrame([(1, 1.0, 2.0, 3.0)], "date int, A_p double, A_q double, B_p double"), ["A", "B", "C"])
    assert sorted(map(str, curves.collect())) == sorted(map(str, spark.createDataFrame([(1, "A", 1.0, 2.0), (1, "B", 3.0, None)], curves.schema).collect()))
    p.withColumn("label", F.lit(1)).write.parquet(f"{tmp_path}/p")
    assert "label" not in panels.read(spark, "parquet", f"{tmp_path}/p").columns and "label" in panels.read(spark, "parquet", f"{tmp_path}/p", labels=True).columns
    assert panels.read(spark, "sql", "select date'2020-01-01' as date, 1 as x").count() == 1
    with pytest.raises(KeyError):
        panels.read(spark, "sql", "select 1 as x")
    long = spark.createDataFrame([(dt.date(2020, 1, d), s, 1.0) for d in (1, 2) for s in "AB"] + [(dt.date(2020, 1, 3), "A", 1.0)], "date date, source string, p double")
    fx = spark.createDataFrame([(dt.date(2020, 1, 1), 1, 0.9), (dt.date(2020, 1, 1), 2, 1.1), (dt.date(2020, 1, 2), 1, None)], "date date, k int, fx double")
    assert [(r["date"].day, r["fx"]) for r in panels.rates_and_fx(long, ["A", "B"], ["p"], fx, F.col("k")).collect()] == [(1, 1.1)]
    with pytest.raises(LookupError):
        panels.rates_and_fx(long, ["Z"], ["p"])
    (tmp_path / "s.csv").write_text("start,end\n2020-01-01,2020-02-01\n")
    assert panels.seeds(spark, None) is None and panels.seeds(spark, {"path": f"{tmp_path}/s.csv"}).count() == 1 == panels.seeds(spark, [{"start": "x"}]).count()
    assert panels.substituted("a: ${LOG_DIR}/x", LOG_DIR="/l") == "a: /l/x"
    with pytest.raises(KeyError):
        panels.substituted("${NO}")


def test_sinks_round_trip(spark, tmp_path):
    b = spark.createDataFrame([("a", 5)], BREAKS)
    bands = spark.createDataFrame([("a", 5, 3, 8)], "series string, b long, lo long, hi long")
    sinks.write_workbook(f"{tmp_path}/w", b, bands, b.withColumn("support", F.lit(0.5)), sinks.meta_table(spark, depth=2, kind="mmd"))
    read = lambda name: spark.read.csv(f"{tmp_path}/w/{name}", header=True, inferSchema=True)
    assert read("ci").first()["width"] == 5 and read("panel_support").first()["support"] == 0.5 and read("breakpoints").count() == 1
    assert {tuple(r) for r in read("meta").collect()} == {("depth", "2"), ("kind", "mmd")}
    perf = sinks.performance_rows(spark.createDataFrame([("a", 0.5, 1.0)], "series string, f1 double, recall double"), "r", depth=2).collect()
    assert {(r["metric"], r["value"], r["knobs"]) for r in perf} == {("f1", 0.5, '{"depth": 2}'), ("recall", 1.0, '{"depth": 2}')}


def test_replay_ends_where_the_batch_does(steps):
    a = steps.where("series = 'a'")
    got = {}
    for r in incremental.replay(a, step=80, history=160, depth=2).collect():
        got.setdefault(r["t_end"], []).append(r["b"])
    assert set(got) <= {160, 240, 320, 400} and [round(b, -2) for b in sorted(got[160])] == [100]
    assert [round(b, -2) for b in sorted(got[400])] == [100, 200, 300]
    rolling = incremental.replay(a, step=80, history=160, mode="rolling", window=200, depth=1)
    assert max(r["t_end"] for r in rolling.collect()) == 400
    with pytest.raises(ValueError):
        incremental.replay(a, mode="other")


def test_following_a_stream_keeps_its_state(spark, tmp_path, noise):
    rows = [("a", dt.datetime(2024, 1, 1) + dt.timedelta(hours=t), float(v + 9 * (t >= 60))) for t, v in enumerate(noise[:160])]
    schema = "series string, date timestamp, value double"
    for k, part in enumerate((rows[:90], rows[90:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        incremental.follow(stream, f"{tmp_path}/out", f"{tmp_path}/cp", step=20, depth=1, lag=2, width=25).awaitTermination(120)
        held = [r["b"] for r in spark.read.parquet(f"{tmp_path}/out/breaks/batch={k}").collect()]
        assert len(held) == 1 and abs(held[0] - 60) <= 5
    assert spark.read.parquet(f"{tmp_path}/out/rows").count() == 160


def test_panel_of_groups_agrees(spark, noise):
    p = spark.createDataFrame([("s", t, *(float(noise[(t + 50 * k) % 400] + 8 * (t >= 60)) for k in range(3))) for t in range(120)], "series string, t int, A_x double, B_x double, C_x double")
    every, agreed = segmentation.panel_breaks(p, features.panel_groups(["A_x", "B_x", "C_x"]) | {"none": ["Z"]}, depth=1)
    assert {r["run"] for r in every.collect()} == {"source A", "source B", "source C"}
    assert [(round(r["b"], -1), r["support"]) for r in agreed.collect()] == [(60, 1.0)]
    assert set(segmentation.grid(depth=[1, 2], alpha=[0.1])) == {"depth=1 alpha=0.1", "depth=2 alpha=0.1"}
    with pytest.raises(ValueError):
        segmentation.panel_breaks(p, {"x": []})
