"""Recursive segmentation of many series, one Spark job a level, and what is built on it.

Prefix sums of every series are made once. Each level finds the best split of all open segments of all series
and configurations, tests it on the windows beside it, and opens both halves of the accepted ones. A prefix of a
series, a trailing window or a regime is a segment to start from, so replays and refinements share the sums.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.features import decay_lag
from ..functions.hyper import ess_window
from ..operators.search import candidates, edges_of, split_gains
from ..operators.twosample import test_samples
from ..sources.scratch import written

#: Knobs of a segmentation. ``depth`` levels, the first is 1; ``search`` (``search.candidates``) finds ``n_breaks`` candidates in an open segment, ``most`` of which
#: are tested, on windows of ``width`` rows from ``lag`` rows off the break, of which the nearest ``samples`` a side are compared. ``lag_rule`` ``decay`` and
#: ``width_rule`` ``ess`` tell the two from the data instead, and a ``share`` above 0 gives the samples as a share of both windows, 50 at least.
BASE = {
    "depth": 2, "width": 40, "lag": 5, "samples": 80, "alpha": 0.05, "rounds": 50, "min_size": 10, "jump": 5, "kind": "mmd",
    "search": "dynp", "n_breaks": 1, "most": 40, "lag_rule": "given", "width_rule": "given", "share": 0.0,
}
LEAST, MARGIN = 30, 5
#: Searches whose single break is that of the least cost.
SINGLE = ("dynp", "pelt", "wbs", "bocpd", "binseg", "bottomup")


def _knobs(configs: dict[str, dict]) -> F.col:
    unknown = {k for c in configs.values() for k in c} - set(BASE)
    if unknown:
        raise KeyError(f"unknown knobs {sorted(unknown)}")
    each = [F.struct(F.lit(name).alias("run"), *(F.lit((BASE | c)[k]).cast({int: "int", float: "double", str: "string"}[type(BASE[k])]).alias(k) for k in BASE)) for name, c in configs.items()]
    return F.explode(F.array(*each)).alias("k")


def _found(panel: DataFrame, edges: DataFrame, open_: DataFrame, configs: dict[str, dict], columns: list[str] | str) -> DataFrame:
    """(series, run, lo, hi, b): the candidates of every open segment, all segments of one search in one plan."""
    key, out = ["series", "run", "lo", "hi"], []
    searches = {tuple((BASE | c)[k] for k in ("search", "n_breaks", "min_size")) for c in configs.values()}
    for method, n_breaks, least in sorted(searches):
        own = open_.where((F.col("search") == method) & (F.col("n_breaks") == n_breaks) & (F.col("min_size") == least))
        if n_breaks == 1 and method in SINGLE:
            out.append(split_gains(edges, own, columns, MARGIN).groupBy(*key).agg(F.max_by("b", F.struct("gain", (-F.col("b")).alias("first"))).alias("b")))
            continue
        named = own.select(*key).withColumn("_segment", F.concat_ws("|", *key))
        own_columns = [columns] if isinstance(columns, str) else columns
        rows = panel.select("series", F.col("t").cast("long").alias("_t"), *own_columns)
        inside = named.withColumn("_t", F.explode(F.sequence("lo", F.col("hi") - 1))).join(rows, ["series", "_t"])
        segments = written(inside.select(F.col("_segment").alias("series"), (F.col("_t") - F.col("lo")).cast("int").alias("t"), *own_columns), "segments")
        got = candidates(segments, method, n_breaks=n_breaks, min_size=least, columns=columns).withColumnRenamed("series", "_segment")
        out.append(named.join(got, "_segment").select(*key, (F.col("lo") + F.col("b")).alias("b")))
    # of more than ``most`` candidates as many at even steps, the first and the last among them
    both = reduce(DataFrame.union, out).join(open_.select(*key, "most", "n_breaks"), key)
    place = Window.partitionBy(*key).orderBy("b")
    both = both.withColumns({"_i": F.row_number().over(place) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy(*key))})
    steps = F.transform(F.sequence(F.lit(0), F.col("most") - 1), lambda k: F.floor(k * (F.col("_n") - 1) / F.greatest(F.col("most") - 1, F.lit(1))))
    some = both.where((F.col("n_breaks") == 1) | (F.col("_n") <= F.col("most")) | F.array_contains(steps, F.col("_i").cast("long")))
    return some.where((F.col("b") > F.col("lo") + MARGIN) & (F.col("b") < F.col("hi") - MARGIN)).select(*key, "b")


def _judged(panel: DataFrame, found: DataFrame, configs: dict[str, dict], columns: list[str] | str) -> DataFrame:
    """Candidates with the lag, the width and the rows a side of their tests, by the rules of their configurations."""
    rules, found = [BASE | c for c in configs.values()], found.withColumns({"_lag0": F.col("lag"), "_width0": F.col("width")})
    if any(c["lag_rule"] == "decay" for c in rules):
        long = panel.select(F.col("series").alias("_of"), "t", F.posexplode(_values(columns)).alias("c", "value"))
        long = long.select("_of", F.concat_ws("|", "_of", F.col("c").cast("string")).alias("series"), "t", "value")
        at = found.where("lag_rule = 'decay'").select(F.col("series").alias("_of"), "b").distinct().join(long.select("_of", "series").distinct(), "_of")
        told = decay_lag(long, at.select("series", "b")).join(at.select("_of", "series").distinct(), "series").groupBy(F.col("_of").alias("series"), F.col("label").alias("b")).agg(F.max("lag").cast("int").alias("_lag"))
        found = found.join(told, ["series", "b"], "left").withColumn("lag", F.when(F.col("lag_rule") == "decay", F.coalesce("_lag", "lag")).otherwise(F.col("lag"))).drop("_lag")
    if any(c["width_rule"] == "ess" for c in rules):
        own = ess_window(panel.select("series", "t", _values(columns)[0].alias("value"))).select("series", F.col("width").alias("_width"))
        found = found.join(own, "series").withColumn("width", F.when(F.col("width_rule") == "ess", F.col("_width")).otherwise(F.col("width"))).drop("_width")
    told = F.greatest(F.round(F.col("share") * 2 * F.col("width")), F.lit(50)).cast("int")
    return found.withColumn("reach", F.least("width", F.when(F.col("share") > 0, told).otherwise(F.col("samples"))))


def _values(columns: list[str] | str) -> Column:
    return F.col(columns) if isinstance(columns, str) else F.array(*(F.col(c).cast("double") for c in columns))


def segment(panel: DataFrame, columns: list[str] | str | None = None, configs: dict[str, dict] | None = None, spans: DataFrame | None = None, searched: list[str] | str | None = None) -> DataFrame:
    """Breaks of every series under every configuration: (series, run, b, level, stat, p, status).

    Each open segment has its candidates tested; of those that pass, the one with the smallest p value, then the largest statistic, then the
    first row is ``valid`` and opens both halves, others are ``passed over``, and the rest are ``invalid``. Segments shorter than 30 rows, and candidates within 5 rows of
    an end, are left out; a test with fewer than five rows to a side rejects. ``spans`` (series, span, lo, hi) are segments to start from instead of the whole series; ``run`` is
    then the span's name, and with several configurations both names. Candidates are looked for in the columns ``searched`` (such as a kernel's
    features, ``maps.kernel_costed``), else in those that are tested; both may be columns or the name of an array.
    """
    columns, configs = columns or ["value"], configs or {"base": {}}
    searched = searched or columns
    edges = written(edges_of(panel, searched), "edges")
    if spans is None:
        spans = edges.groupBy("series").agg(F.max("t").cast("long").alias("hi")).select("series", F.lit("").alias("span"), F.lit(0).cast("long").alias("lo"), "hi")
    name = F.concat_ws(" ", F.when(F.col("span") != "", F.col("span")), F.when((F.col("span") == "") | F.lit(len(configs) > 1), F.col("k.run")))
    open_ = spans.select("series", "span", F.col("lo").cast("long"), F.col("hi").cast("long"), _knobs(configs)).select("series", name.alias("run"), "lo", "hi", *(f"k.{k}" for k in BASE))
    rows = panel.select("series", F.col("t").cast("long").alias("t"), _values(columns).alias("x"))
    key, levels = ["series", "run"], []
    for level in range(1, max(BASE["depth"], *(c.get("depth", 0) for c in configs.values())) + 1):
        open_ = open_.where((F.col("hi") - F.col("lo") >= LEAST) & (F.col("depth") >= level))
        found = written(_judged(panel, open_.join(_found(panel, edges, open_, configs, searched), [*key, "lo", "hi"]), configs, columns), "found")
        near = found.select(*key, "lo", "hi", "b", "kind", "rounds", "lag", "reach").withColumn("d", F.explode(F.flatten(F.array(F.sequence(-F.col("lag") - F.col("reach"), -F.col("lag") - 1), F.sequence(F.col("lag"), F.col("lag") + F.col("reach") - 1)))))
        near = near.withColumn("t", F.col("b") + F.col("d")).where((F.col("t") >= F.col("lo")) & (F.col("t") < F.col("hi")))
        near = near.join(rows, ["series", "t"]).select(*key, F.col("b").alias("label"), "t", (F.col("d") >= 0).cast("int").alias("side"), "x", "kind", "rounds")
        told = test_samples(near).withColumnRenamed("label", "b")
        told = found.join(told, [*key, "b"], "left").withColumns({"stat": F.coalesce("stat", F.lit(0.0)), "p": F.coalesce("p", F.lit(1.0))})
        best = F.row_number().over(Window.partitionBy(*key, "lo", "hi").orderBy("p", F.desc("stat"), "b"))
        status = F.when(F.col("p") >= F.col("alpha"), "invalid").when(best == 1, "valid").otherwise("passed over")
        done = written(told.withColumns({"level": F.lit(level), "status": status}), "level")
        levels.append(done.select(*key, "b", "level", "stat", "p", "status"))
        if done.where("status = 'valid'").isEmpty():
            break
        halves = F.explode(F.array(F.struct(F.col("lo").alias("a"), F.col("b").alias("z")), F.struct(F.col("b").alias("a"), F.col("hi").alias("z")))).alias("half")
        knobs = [k for k in BASE if k not in ("lag", "width")]  # these two go back to what they were before the rules of the data
        back = done.where("status = 'valid'").select(*key, halves, *knobs, "_lag0", "_width0")
        open_ = back.select(*key, F.col("half.a").alias("lo"), F.col("half.z").alias("hi"), *knobs, F.col("_lag0").alias("lag"), F.col("_width0").alias("width"))
    return reduce(DataFrame.union, levels)


def perturbed(base: dict, **ranges: list) -> dict[str, dict]:
    """One-at-a-time changes of a configuration."""
    return {"base": base} | {f"{k}={v}": base | {k: v} for k, values in ranges.items() for v in values}


def grid(**ranges: list) -> dict[str, dict]:
    """Every combination of the knobs' values, a configuration each."""
    out: dict[str, dict] = {"": {}}
    for k, values in ranges.items():
        out = {f"{name} {k}={v}".strip(): c | {k: v} for name, c in out.items() for v in values}
    return out


def block_bootstrap(panel: DataFrame, block: int, samples: int, seed: int = 0) -> DataFrame:
    """Circular block resamples of each series: (series, sample, t, value), each block's start drawn by a hash (MD5)."""
    n = panel.groupBy("series").agg(F.count(F.lit(1)).alias("n"))
    slots = n.select("series", "n", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample")).select("*", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("t"))
    drawn = F.md5(F.concat_ws(":", F.lit(str(seed)), "series", F.col("sample").cast("string"), F.floor(F.col("t") / block).cast("string")))
    start = F.conv(F.substring(drawn, 1, 13), 16, 10).cast("long") % F.col("n")
    slots = slots.withColumn("src", ((start + F.col("t") % block) % F.col("n")).cast("int"))
    source = panel.select("series", F.col("t").alias("src"), "value")
    return slots.join(source, ["series", "src"]).select("series", "sample", "t", "value")


def consensus(runs: DataFrame, tolerance: int, share: float = 0.5, how: str = "majority", total: int | None = None) -> DataFrame:
    """Distinct breaks of runs (series, run, b) grouped greedily around their running median: (series, b, support).

    ``how`` keeps those with ``share`` of the runs (majority), all of them (intersection) or any (union). ``total`` counts the runs,
    those without a break too. The breaks of one series are few; its median is rounded half to even.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        n, groups = total or pdf["run"].nunique(), []
        for b in sorted(set(pdf["b"])):
            if groups and b - pd.Series(groups[-1]).median() <= tolerance:
                groups[-1].append(b)
            else:
                groups.append([b])
        rows = []
        for g in groups:
            mid = round(float(pd.Series(g).median()))
            hits = pdf.loc[(pdf["b"] - mid).abs() <= tolerance, "run"].nunique()
            if {"union": hits >= 1, "intersection": hits == n}.get(how, hits / n >= share):
                rows.append((pdf["series"].iat[0], mid, hits / n))
        return pd.DataFrame(rows, columns=["series", "b", "support"])

    return runs.groupBy("series").applyInPandas(one, "series string, b long, support double")


def by_groups(panel: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """(series, t, z): the panel once for each group of columns, whose array is z; the series' name has the group's before it, and a bar."""
    each = F.explode(F.array(*(F.struct(F.lit(g).alias("g"), F.array(*(F.col(c).cast("double") for c in cols)).alias("z")) for g, cols in groups.items()))).alias("x")
    return panel.select("series", "t", each).select(F.concat_ws("|", "x.g", "series").alias("series"), "t", "x.z")


def breaks_by_groups(panel: DataFrame, groups: dict[str, list[str]], **knobs) -> DataFrame:
    """(series, run, b): valid breaks by each group of columns, a run a group; all groups are series of one segmentation."""
    found = segment(written(by_groups(panel, groups), "groups"), "z", {"base": knobs}).where("status = 'valid'")
    at = F.instr("series", F.lit("|"))
    return found.select(F.substring("series", at + 1, F.length("series")).alias("series"), F.substring("series", F.lit(1), at - 1).alias("run"), "b")


def panel_breaks(panel: DataFrame, groups: dict[str, list[str]], tolerance: int = 5, share: float = 0.5, how: str = "majority", **knobs) -> tuple[DataFrame, DataFrame]:
    """Segment a wide panel by each group of columns: (series, run, b) of all groups, and their consensus.

    A group without columns, or with columns that the panel lacks, is passed over.
    """
    groups = {g: c for g, c in groups.items() if c and not set(c) - set(panel.columns)}
    if not groups:
        raise ValueError("no group of columns can be segmented")
    if any("|" in g for g in groups):
        raise ValueError("a group's name may not hold a bar")
    every = written(breaks_by_groups(panel, groups, **knobs), "panel")
    return every, consensus(every, tolerance, share, how, len(groups))


def prefix_runs(panel: DataFrame, shares: tuple[float, ...] = (0.6, 0.8), columns: list[str] | None = None, **knobs) -> DataFrame:
    """Valid breaks of the first part of each series: (series, run, b), a run a share."""
    n = panel.groupBy("series").agg(F.count(F.lit(1)).alias("n"))
    parts = F.explode(F.array(*(F.struct(F.lit(f"first {s:g}").alias("span"), F.floor(F.col("n") * s).alias("hi")) for s in shares))).alias("part")
    spans = n.select("series", parts).select("series", "part.span", F.lit(0).alias("lo"), "part.hi")
    return segment(panel, columns, {"base": knobs}, spans).where("status = 'valid'").select("series", "run", "b")


def refine(panel: DataFrame, labels: DataFrame, worst: int = 1, **knobs) -> DataFrame:
    """Segment anew the ``worst`` regimes of each series by within-regime variance; a regime is a run of one label, breaks are rows of the whole series."""
    w = Window.partitionBy("series").orderBy("t")
    rows = panel.join(labels.select("series", "t", "label"), ["series", "t"])
    rows = rows.withColumn("_new", F.when(F.lag("label").over(w).eqNullSafe(F.col("label")), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    loss = rows.groupBy("series", "_run").agg(F.var_pop("value").alias("loss"), F.min("t").alias("lo"), (F.max("t") + 1).alias("hi"))
    bad = loss.withColumn("k", F.row_number().over(Window.partitionBy("series").orderBy(F.desc("loss"), "lo"))).where(F.col("k") <= worst)
    found = segment(panel, configs={"base": knobs}, spans=bad.select("series", F.concat(F.lit("regime "), F.col("lo").cast("string")).alias("span"), "lo", "hi"))
    return found.select("series", "b", "level", "stat", "p", "status")
