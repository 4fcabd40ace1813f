"""Candidate breaks: splits and intervals as window sums and joins; a few sequential kernels in numpy, a series a group."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import written


def _prefixes(panel: DataFrame) -> DataFrame:
    run, whole = Window.partitionBy("series").orderBy("t").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("series")
    v = F.col("value")
    return panel.withColumns({"_s": F.coalesce(F.sum(v).over(run), F.lit(0.0)), "_all": F.sum(v).over(whole), "_n": F.count(F.lit(1)).over(whole)})


def cusum_split(panel: DataFrame, min_size: int = 10) -> DataFrame:
    """The split with the largest scaled difference of means, the first of equal ones: (series, b, stat)."""
    p = _prefixes(panel).where((F.col("t") >= min_size) & (F.col("_n") - F.col("t") >= min_size))
    left, right = F.col("_s") / F.col("t"), (F.col("_all") - F.col("_s")) / (F.col("_n") - F.col("t"))
    p = p.withColumn("stat", F.sqrt(F.col("t") * (F.col("_n") - F.col("t")) / F.col("_n")) * F.abs(left - right))
    top = p.groupBy("series").agg(F.max(F.struct("stat", (-F.col("t")).alias("b"))).alias("x"))
    return top.select("series", (-F.col("x.b")).cast("long").alias("b"), "x.stat")


def best_split(panel: DataFrame, min_size: int = 10, jump: int = 5) -> DataFrame:
    """The split on the jump grid with the least squared error of two constants: (series, b, gain)."""
    p = _prefixes(panel).where((F.col("t") % jump == 0) & (F.col("t") >= min_size) & (F.col("_n") - F.col("t") >= min_size))
    rest = F.col("_all") - F.col("_s")
    gain = F.col("_s") * F.col("_s") / F.col("t") + rest * rest / (F.col("_n") - F.col("t")) - F.col("_all") * F.col("_all") / F.col("_n")
    top = p.withColumn("gain", gain).groupBy("series").agg(F.max(F.struct("gain", (-F.col("t")).alias("b"))).alias("x"))
    return top.select("series", (-F.col("x.b")).cast("long").alias("b"), "x.gain")


def edges_of(panel: DataFrame, columns: list[str] | str, block: int = 4096) -> DataFrame:
    """(series, t, sums) for t from 0 to the series' length: the sums over the rows before t of columns, or of the array that ``columns`` names.

    Rows are summed in blocks of ``block`` of them, on top of what the blocks before hold, so a long series is many tasks.
    """
    if isinstance(columns, str):
        return _vector_edges(panel, columns, block)
    names = [f"_c{i}" for i in range(len(columns))]
    rows = panel.select("series", F.col("t").cast("long").alias("t"), *(F.col(c).cast("double").alias(n) for c, n in zip(columns, names, strict=True))).withColumn("_k", F.floor(F.col("t") / block))
    totals = rows.groupBy("series", "_k").agg(F.count(F.lit(1)).alias("_n"), *(F.coalesce(F.sum(n), F.lit(0.0)).alias(n) for n in names))
    earlier = Window.partitionBy("series").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("series", "_k", F.array(*(F.coalesce(F.sum(n).over(earlier), F.lit(0.0)) for n in names)).alias("_base"))
    inside = Window.partitionBy("series", "_k").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    own = rows.select("series", "_k", "t", F.array(*(F.coalesce(F.sum(n).over(inside), F.lit(0.0)) for n in names)).alias("_own"))
    before = own.join(carried, ["series", "_k"]).select("series", "t", F.zip_with("_base", "_own", lambda a, b: a + b).alias("sums"))
    return before.union(totals.groupBy("series").agg(F.sum("_n").alias("t"), F.array(*(F.sum(n) for n in names)).alias("sums")))


def _vector_edges(panel: DataFrame, column: str, block: int) -> DataFrame:
    kind = panel.schema["series"].dataType.simpleString()
    rows = panel.select("series", F.col("t").cast("long").alias("t"), F.floor(F.col("t") / block).alias("_k"), F.col(column).alias("sums"))

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        """Sums of a block's rows before each, and of all before the row after the last."""
        pdf = pdf.sort_values("t")
        z = np.stack(pdf["sums"]).cumsum(axis=0)
        before = np.vstack([np.zeros((1, z.shape[1])), z])
        return pd.DataFrame({"series": pdf["series"].iat[0], "_k": pdf["_k"].iat[0], "t": [*pdf["t"], pdf["t"].iat[-1] + 1], "_last": [False] * len(pdf) + [True], "sums": list(before)})

    own = written(rows.groupBy("series", "_k").applyInPandas(inside, f"series {kind}, _k long, t long, _last boolean, sums array<double>"), "blocks")
    earlier = Window.partitionBy("series", "pos").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    each = own.where("_last").select("series", "_k", F.posexplode("sums").alias("pos", "x")).withColumn("x", F.coalesce(F.sum("x").over(earlier), F.lit(0.0)))
    carried = each.groupBy("series", "_k").agg(F.sort_array(F.collect_list(F.struct("pos", "x")))["x"].alias("_base"))
    whole = own.groupBy("series").agg(F.max("t").alias("_n"))
    out = own.join(carried, ["series", "_k"]).join(whole, "series").where(~F.col("_last") | (F.col("t") == F.col("_n")))
    return out.select("series", "t", F.zip_with("_base", "sums", lambda a, b: a + b).alias("sums"))


def split_gains(edges: DataFrame, segments: DataFrame, columns: list[str] | str, margin: int = 0) -> DataFrame:
    """(..., b, gain) of every split of segments (..., series, lo, hi, min_size, jump) on their jump grid: how much two constants beat one.

    A segment meets the sums at its ends and at its candidates alone, by equality of series and row.
    """
    at = lambda name: edges.select("series", F.col("t").alias(name), F.col("sums").alias(f"_s_{name}"))
    own = segments.join(at("lo"), ["series", "lo"]).join(at("hi"), ["series", "hi"])
    least = F.greatest("min_size", F.lit(margin + 1))
    first = F.col("lo") + (F.ceil(least / F.col("jump")) * F.col("jump")).cast("long")
    own = own.withColumn("_last", F.col("hi") - least).where(first <= F.col("_last"))
    own = own.withColumn("b", F.explode(F.sequence(first, F.col("_last"), F.col("jump").cast("long")))).join(at("b"), ["series", "b"])
    nl, nr = F.col("b") - F.col("lo"), F.col("hi") - F.col("b")
    if isinstance(columns, str):
        square = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
        gain = square("_s_b", "_s_lo") / nl + square("_s_hi", "_s_b") / nr - square("_s_hi", "_s_lo") / (nl + nr)
    else:
        part = lambda i: (F.col("_s_b")[i] - F.col("_s_lo")[i], F.col("_s_hi")[i] - F.col("_s_b")[i], F.col("_s_hi")[i] - F.col("_s_lo")[i])
        gain = reduce(lambda x, y: x + y, (l * l / nl + r * r / nr - w * w / (nl + nr) for l, r, w in map(part, range(len(columns)))))
    return own.withColumn("gain", gain).drop("_s_lo", "_s_hi", "_s_b", "_last")


def _first(columns: list[str] | str) -> Column:
    return F.col(columns)[0] if isinstance(columns, str) else F.col(columns[0]).cast("double")


def _top(gains: DataFrame, *key: str) -> DataFrame:
    return gains.groupBy(*key).agg(F.max(F.struct("gain", (-F.col("b")).alias("_b"))).alias("_top")).select(*key, (-F.col("_top._b")).alias("b"), "_top.gain")


def best_split_rbf(panel: DataFrame, gamma: float = 1.0, min_size: int = 10, jump: int = 5) -> DataFrame:
    """The split on the jump grid with the least Gaussian-kernel cost of both parts: (series, b, cost).

    The cost of a part is its length less its kernel's sum over the length. Sums over all pairs before and after a row come
    from the pairs of rows, each once, grouped by its later and by its earlier row; gamma d^2 is held within [0.01, 100].
    Pairs are quadratic in a series' rows: use it on segments, not on long series.
    """
    v = panel.select("series", F.col("t").cast("long").alias("i"), F.col("value").alias("v"))
    w = panel.select("series", F.col("t").cast("long").alias("j"), F.col("value").alias("w"))
    k = F.exp(-F.least(F.lit(1e2), F.greatest(F.lit(1e-2), gamma * (F.col("v") - F.col("w")) * (F.col("v") - F.col("w")))))
    pairs = v.join(w, "series").where("i < j").select("series", "i", "j", (2 * k).alias("k"))
    both = pairs.select("series", F.explode(F.array(F.struct(F.col("j").alias("t"), F.col("k").alias("late"), F.lit(0.0).alias("early")), F.struct(F.col("i").alias("t"), F.lit(0.0).alias("late"), F.col("k").alias("early")))).alias("x"))
    sums = both.groupBy("series", "x.t").agg((F.sum("x.late") + 1).alias("late"), (F.sum("x.early") + 1).alias("early"))
    run, whole = Window.partitionBy("series").orderBy("t"), Window.partitionBy("series")
    told = sums.withColumns({
        "before": F.sum("late").over(run.rowsBetween(Window.unboundedPreceding, -1)),
        "after": F.sum("early").over(run.rowsBetween(0, Window.unboundedFollowing)),
        "n": F.count(F.lit(1)).over(whole),
    })
    told = told.where((F.col("t") % jump == 0) & (F.col("t") >= min_size) & (F.col("n") - F.col("t") >= min_size))
    cost = F.col("n") - F.col("before") / F.col("t") - F.col("after") / (F.col("n") - F.col("t"))
    top = told.withColumn("cost", cost).groupBy("series").agg(F.min(F.struct("cost", "t")).alias("x"))
    return top.select("series", F.col("x.t").alias("b"), "x.cost")


def binary_splits(panel: DataFrame, n_breaks: int | None = None, columns: list[str] | str | None = None, min_size: int = 10, jump: int = 5) -> DataFrame:
    """Binary segmentation, a job a level: (series, b, round, gain); each round splits that segment of a series which gains most.

    Without ``n_breaks`` a series has one break for each 50 rows, one at least. A segment's best split does not hang on the order of the rounds,
    so each level splits all open segments of all series, and the rounds are picked from the tree of splits afterwards. A segment can't be picked before those it lies in;
    where the least gain on its way from the root is below those of as many others as are wanted, or it lies in as many, it is not split further. The tree of a series has a row
    for a split, a small part of its rows, and its picking is one group.
    """
    columns = columns or ["value"]
    edges = written(edges_of(panel, columns), "edges")
    lengths = edges.groupBy("series").agg(F.max("t").cast("long").alias("hi"))
    want = lengths.select("series", (F.lit(n_breaks) if n_breaks else F.greatest(F.lit(1), F.floor(F.col("hi") / 50))).cast("int").alias("want"))
    knobs = [F.lit(min_size).alias("min_size"), F.lit(jump).alias("jump")]
    open_, tree = lengths.select("series", F.lit(0).cast("long").alias("lo"), "hi", F.lit(float("inf")).alias("way"), *knobs), None
    deep = 0
    while True:
        best = _top(split_gains(edges, open_, columns), "series", "lo", "hi", "way")
        level = written(best.withColumn("way", F.least("way", "gain")), "level")
        if level.isEmpty():
            break
        tree, deep = level if tree is None else tree.union(level), deep + 1
        rank = Window.partitionBy("series").orderBy(F.desc("way"))
        bar = tree.withColumn("_k", F.row_number().over(rank)).join(want, "series").where("_k = want").select("series", F.col("way").alias("_bar"))
        going = level.join(bar, "series", "left").join(want, "series").where((F.col("_bar").isNull() | (F.col("way") >= F.col("_bar"))) & (F.col("want") > deep))
        halves = F.explode(F.array(F.struct(F.col("lo").alias("a"), F.col("b").alias("z")), F.struct(F.col("b").alias("a"), F.col("hi").alias("z")))).alias("x")
        open_ = going.select("series", halves, "way").select("series", F.col("x.a").alias("lo"), F.col("x.z").alias("hi"), "way", *knobs)
    if tree is None:
        return panel.select("series", F.col("t").cast("long").alias("b"), F.lit(1).alias("round"), F.lit(0.0).alias("gain")).limit(0)

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        splits, heap, out = {(r.lo, r.hi): (r.b, r.gain) for r in pdf.itertuples()}, [], []

        def offer(lo: int, hi: int) -> None:
            if (lo, hi) in splits:
                heappush(heap, (-splits[lo, hi][1], lo, hi))

        offer(0, int(pdf["hi"].max()))
        while heap and len(out) < pdf["want"].iat[0]:
            _, lo, hi = heappop(heap)
            b, gain = splits[lo, hi]
            out.append((pdf["series"].iat[0], b, len(out) + 1, gain))
            offer(lo, b)
            offer(b, hi)
        return pd.DataFrame(out, columns=["series", "b", "round", "gain"])

    kind = panel.schema["series"].dataType.simpleString()
    return tree.join(want, "series").groupBy("series").applyInPandas(pick, f"series {kind}, b long, round int, gain double")


def random_spans(panel: DataFrame, intervals: int = 200, seed: int = 42) -> DataFrame:
    """(series, k, lo, hi): intervals whose ends an MD5 of series and number draws."""
    n = panel.groupBy("series").agg(F.count(F.lit(1)).alias("n"))
    each = n.select("series", "n", F.explode(F.sequence(F.lit(1), F.lit(intervals))).alias("k"))
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), "series", F.col("k").cast("string")))
    end = lambda at: F.conv(F.substring(h, at, 13), 16, 10).cast("long") % (F.col("n") + 1)
    return each.select("series", "k", F.least(end(1), end(14)).alias("lo"), F.greatest(end(1), end(14)).alias("hi"))


def span_splits(panel: DataFrame, spans: DataFrame, min_size: int = 10, columns: list[str] | str | None = None) -> DataFrame:
    """(series, lo, hi, b, stat): the best split of each interval by the scaled distance of its means."""
    columns = columns or ["value"]
    edges = edges_of(panel, columns)
    own = spans.select("series", "lo", "hi", F.lit(min_size).alias("min_size"), F.lit(1).alias("jump")).distinct()
    top = _top(split_gains(edges, own, columns), "series", "lo", "hi")
    return top.select("series", "lo", "hi", "b", F.sqrt(F.greatest(F.lit(0.0), F.col("gain"))).alias("stat"))


def pool_limits(pool: DataFrame, lengths: DataFrame) -> DataFrame:
    """(series, limit): the deviation of the intervals' statistics from their median, times sqrt(2 ln n), but at most their upper quartile."""
    mid = pool.groupBy("series").agg(F.percentile("stat", 0.5).alias("mid"), F.percentile("stat", 0.75).alias("top"))
    mad = pool.join(mid, "series").groupBy("series").agg(F.percentile(F.abs(F.col("stat") - F.col("mid")), 0.5).alias("mad"), F.max("top").alias("top"))
    limit = F.sqrt(2 * F.log(F.greatest("n", F.lit(3)))) * (1.4826 * (F.col("mad") + 1e-12) + 1e-8)
    return mad.join(lengths.select("series", F.col("hi").alias("n")), "series").select("series", F.least(limit, "top").alias("limit"))


def noise_limits(panel: DataFrame) -> DataFrame:
    """(series, limit): the deviation of the differences, from their median absolute deviation, times sqrt(2 ln n)."""
    w = Window.partitionBy("series").orderBy("t")
    d = panel.select("series", (F.col("value") - F.lag("value").over(w)).alias("d"))
    mid = d.groupBy("series").agg(F.percentile("d", 0.5).alias("mid"), F.count(F.lit(1)).alias("n"))
    mad = d.join(mid, "series").groupBy("series").agg(F.percentile(F.abs(F.col("d") - F.col("mid")), 0.5).alias("mad"), F.max("n").alias("n"))
    return mad.select("series", (1.4826 / math.sqrt(2) * F.col("mad") * F.sqrt(2 * F.log(F.greatest("n", F.lit(2))))).alias("limit"))


def wild_splits(panel: DataFrame, intervals: int = 200, min_size: int = 10, seed: int = 42, columns: list[str] | str | None = None, limit: str = "noise", n_breaks: int | None = None, rows_a_break: int | None = None) -> DataFrame:
    """Wild binary segmentation, a job a level: (series, b, level, stat).

    The best split of every random interval is found once. A segment takes the best among the intervals within it and itself, if it passes the
    limit, and opens both halves. The limit is that of the series' noise (``noise_limits``, of the first column) or, with ``pool``, of the intervals' own statistics (``pool_limits``).
    With ``n_breaks``, or a break for each ``rows_a_break`` rows (one at least), the first ones count: a break before those to its left, and these before those to its right.
    """
    columns = columns or ["value"]
    pool = written(span_splits(panel, random_spans(panel, intervals, seed), min_size, columns), "pool")
    whole = panel.groupBy("series").agg(F.count(F.lit(1)).alias("hi")).select("series", F.lit(0).cast("long").alias("lo"), "hi")
    limits = written(pool_limits(pool, whole) if limit == "pool" else noise_limits(panel.withColumn("value", _first(columns))), "limits")
    open_, level, out = whole.withColumn("path", F.lit("")), 1, []
    while True:
        inside = pool.select("series", "b", "stat", F.col("lo").alias("a"), F.col("hi").alias("z")).join(open_, "series").where("a >= lo and z <= hi").where(F.col("b").between(F.col("lo") + min_size, F.col("hi") - min_size))
        every = inside.select("series", "lo", "hi", "b", "stat").unionByName(span_splits(panel, open_, min_size, columns))
        best = every.groupBy("series", "lo", "hi").agg(F.max(F.struct("stat", (-F.col("b")).alias("first"))).alias("x"))
        best = best.join(limits, "series").where(F.col("x.stat") > F.col("limit")).join(open_, ["series", "lo", "hi"])
        best = written(best.select("series", "lo", "hi", "path", (-F.col("x.first")).alias("b"), "x.stat"), "level")
        out.append(best.select("series", "b", F.lit(level).alias("level"), "stat", "path"))
        if best.isEmpty():
            break
        halves = F.explode(F.array(F.struct(F.col("lo").alias("a"), F.col("b").alias("z"), F.lit("l").alias("to")), F.struct(F.col("b").alias("a"), F.col("hi").alias("z"), F.lit("r").alias("to")))).alias("x")
        open_ = best.select("series", "path", halves).select("series", F.col("x.a").alias("lo"), F.col("x.z").alias("hi"), F.concat("path", "x.to").alias("path")).where(F.col("hi") - F.col("lo") >= 2 * min_size)
        level += 1
    found = reduce(DataFrame.union, out)
    if n_breaks or rows_a_break:
        most = F.lit(n_breaks) if n_breaks else F.greatest(F.lit(1), F.floor(F.col("hi") / rows_a_break))
        found = found.join(whole.select("series", most.alias("_most")), "series").withColumn("_k", F.row_number().over(Window.partitionBy("series").orderBy("path"))).where("_k <= _most")
    return found.select("series", "b", "level", "stat")


def window_gain(panel: DataFrame, width: int = 40) -> DataFrame:
    """Gain of a split at each row over half a window to either side: (series, t, gain)."""
    h = width // 2
    w = Window.partitionBy("series").orderBy("t")
    left, right = w.rowsBetween(-h, -1), w.rowsBetween(0, h - 1)
    v = F.col("value")
    p = panel.withColumns({"_l": F.avg(v).over(left), "_r": F.avg(v).over(right), "_nl": F.count(v).over(left), "_nr": F.count(v).over(right)})
    return p.where((F.col("_nl") == h) & (F.col("_nr") == h)).select("series", "t", ((F.col("_l") - F.col("_r")) * (F.col("_l") - F.col("_r")) * h / 2).alias("gain"))


def _cost(x: np.ndarray) -> Callable[[int, int], float]:
    s, q = np.vstack([np.zeros(x.shape[1]), x.cumsum(axis=0)]), np.vstack([np.zeros(x.shape[1]), (x * x).cumsum(axis=0)])
    return lambda a, b: float((q[b] - q[a] - (s[b] - s[a]) ** 2 / (b - a)).sum())


def bottom_up(x: np.ndarray, n_breaks: int = 3, step: int = 5) -> list[int]:
    cost, edges = _cost(x), [*range(0, len(x) - step + 1, step), len(x)]
    while len(edges) - 2 > n_breaks:
        gains = [cost(a, c) - cost(a, b) - cost(b, c) for a, b, c in zip(edges, edges[1:], edges[2:])]
        del edges[int(np.argmin(gains)) + 1]
    return edges[1:-1]


def online_bayes(x: np.ndarray, hazard: float = 0.01, threshold: float = 0.5, min_size: int = 10, most: int = 250) -> list[int]:
    """Rows that begin a new run with a probability of ``threshold`` or more (``streaming.stateful.RunLengths``), ``min_size`` rows apart and from both ends."""
    from ..streaming.stateful import RunLengths

    runs, out, n = RunLengths(x.shape[1], hazard, most), [], len(x)
    for t, row in enumerate(x if n >= 2 * min_size else []):
        p = runs.update(np.asarray(row, float))
        if min_size <= t < n - min_size and p >= threshold and t - (out[-1] if out else -min_size) >= min_size:
            out.append(t)
    return out


KERNELS = {"bottomup": bottom_up, "bocpd": online_bayes}


def breaks(panel: DataFrame, method: str, columns: list[str] | str | None = None, **knobs) -> DataFrame:
    """Breaks of each series by a named kernel: (series, b). A series is one group, all series run in parallel."""
    kernel, columns = KERNELS[method], columns or ["value"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        x = np.stack(pdf[columns]) if isinstance(columns, str) else pdf[columns].to_numpy(float)
        found = kernel(x, **knobs) if len(pdf) > 1 else []
        return pd.DataFrame({"series": pdf["series"].iat[0], "b": np.array(found, "int64")})

    return panel.select("series", "t", *([columns] if isinstance(columns, str) else columns)).groupBy("series").applyInPandas(run, "series string, b long")


def candidates(panel: DataFrame, method: str = "dynp", kernel: str = "l2", n_breaks: int | None = None, gamma: str | float = 1.0, min_size: int = 10, width: int = 40, columns: list[str] | str | None = None, features: int = 100, penalty: float | None = None, **knobs) -> DataFrame:
    """Candidate breaks (series, b) of a named search over any columns, or the array that ``columns`` names, those at the very ends left out.

    ``dynp``: the ``n_breaks`` (one, unless told) of the least cost; ``pelt``: those of the least cost and ``penalty``; both, and ``binseg``, by the ``l2`` cost
    or the ``rbf`` kernel's with ``features`` Fourier pairs. ``binseg``, ``wbs`` and ``bottomup`` look for ``n_breaks``, else one for each 50 rows. ``cusum``: the best split of
    the first column. ``window``: rows whose gain is the largest within half a width. ``bottomup`` and ``bocpd`` are in numpy, a series a group.
    """
    from . import dynamic, maps

    columns = columns or ["value"]
    if kernel not in ("l2", "rbf"):
        raise ValueError(f"unknown cost {kernel!r}")
    costed, names = maps.kernel_costed(panel, columns, kernel, gamma, features) if method in ("dynp", "pelt", "binseg") else (panel, columns)
    first = panel.withColumn("value", _first(columns))
    if method == "dynp":
        found = dynamic.optimal_splits(costed, n_breaks or 1, names, min_size)
    elif method == "pelt":
        found = dynamic.penalised_splits(costed, penalty, names, min_size)
    elif method == "binseg":
        found = binary_splits(costed, n_breaks, names, min_size)
    elif method == "wbs":
        found = wild_splits(panel, min_size=min_size, columns=columns, limit="pool", n_breaks=n_breaks, rows_a_break=None if n_breaks else 50, **knobs)
    elif method == "cusum":
        found = cusum_split(first, min_size)
    elif method == "window":
        near = Window.partitionBy("series").orderBy("t").rowsBetween(-(width // 2), width // 2)
        found = window_gain(first, width).withColumn("top", F.max("gain").over(near)).where("gain = top").select("series", F.col("t").alias("b"))
    elif method in KERNELS:
        found = breaks(panel, method, columns, **(knobs | ({"n_breaks": n_breaks} if method == "bottomup" and n_breaks else {})))
    else:
        raise ValueError(f"unknown search {method!r}")
    n = panel.groupBy("series").agg(F.count(F.lit(1)).alias("n"))
    return found.join(n, "series").where((F.col("b") > 0) & (F.col("b") < F.col("n") - 1)).select("series", F.col("b").cast("long").alias("b")).distinct()
