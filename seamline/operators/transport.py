"""Regimes by optimal transport: windows of rows as samples, told apart by their Sinkhorn divergence.

Windows meet a bounded number of landmark windows of their series, spread evenly over it, in pairs of blocks: a group is
two blocks of a few windows each, whatever the length of the series. Clusters are fitted on the landmarks alone; every
window then joins the cluster whose landmarks are nearest in the mean, and the number of clusters is told by the silhouette of all
windows. Where a series has no more windows than landmarks, this is the clustering on the matrix of all pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import written

BLOCK, CELLS = 16, 1 << 21


def _softmin(x: np.ndarray, axis: int) -> np.ndarray:
    """-log sum exp along an axis."""
    top = x.max(axis=axis, keepdims=True)
    return -(np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis))


def _steps(state: np.ndarray, move, eps: float, rounds: int, tolerance: float) -> np.ndarray:
    """Repeat ``move(state, rows)`` for the rows of ``state`` that still change by ``tolerance`` or more in the mean."""
    active = np.arange(len(state))
    for _ in range(rounds - 1):
        after = move(state[active], active)
        gap = eps * np.abs(after - state[active]).mean(axis=1)
        state[active] = after
        active = active[gap >= tolerance]
        if not len(active):
            break
    return state


def between(x: np.ndarray, y: np.ndarray, eps: float = 1e-3, rounds: int = 100, tolerance: float = 1e-3) -> np.ndarray:
    """Entropic transport costs of pairs of samples, (pairs, rows, columns) each, by alternating steps in the log domain.

    Distances are Euclidean and weights uniform. A pair stops when its potentials move by less than ``tolerance`` in the mean.
    """
    cost = np.sqrt(np.maximum(((x[:, :, None] - y[:, None]) ** 2).sum(axis=3), 0)) / eps
    one, two = -np.log(x.shape[1]), -np.log(y.shape[1])
    across = lambda b, at: _softmin((b + one)[:, :, None] - cost[at], 1)
    back = lambda a, at: _softmin((a + two)[:, None] - cost[at], 2)
    b = _steps(np.zeros(x.shape[:2]), lambda b, at: back(across(b, at), at), eps, rounds, tolerance)
    every = np.arange(len(x))
    a = across(b, every)
    return eps * (a.mean(axis=1) + back(a, every).mean(axis=1))


def within(x: np.ndarray, eps: float = 1e-3, rounds: int = 100, tolerance: float = 1e-3) -> np.ndarray:
    """Half the entropic cost of each sample to itself, by averaged steps."""
    cost = np.sqrt(np.maximum(((x[:, :, None] - x[:, None]) ** 2).sum(axis=3), 0)) / eps
    one = -np.log(x.shape[1])
    step = lambda a, at: _softmin((a + one)[:, :, None] - cost[at], 1)
    a = _steps(np.zeros(x.shape[:2]), lambda a, at: (a + step(a, at)) / 2, eps, rounds, tolerance)
    return eps * step(a, np.arange(len(x))).mean(axis=1)


def windows(panel: DataFrame, columns: list[str], window: int, stride: int) -> DataFrame:
    """(series, m, n, points): window m holds the rows from ``stride`` m on, ``window`` of them; n windows in the series.

    Rows are numbered from 0 by t. Rows with a null in ``columns`` are an error of the caller; a series that is shorter than a window has none.
    """
    if not 1 <= stride <= window:
        raise ValueError("the stride must be from 1 to the window")
    sizes = panel.groupBy("series").agg(F.floor((F.count(F.lit(1)) - (window - stride)) / stride).cast("int").alias("n")).where("n > 0")
    t = F.col("t").cast("long")
    first = F.greatest(F.lit(0), F.ceil((t - window + 1) / stride))
    last = F.least(F.col("n") - 1, F.floor(t / stride))
    rows = panel.select("series", "t", F.array(*(F.col(c).cast("double") for c in columns)).alias("x")).join(sizes, "series").where(first <= last)
    each = rows.select("series", "n", "t", "x", F.explode(F.sequence(first.cast("int"), last.cast("int"))).alias("m"))
    held = each.groupBy("series", "m", "n").agg(F.array_sort(F.collect_list(F.struct("t", "x"))).alias("rows"))
    return held.select("series", "m", "n", F.col("rows.x").alias("points"))


def divergences(held: DataFrame, landmarks: int = 64, eps: float = 1e-3, rounds: int = 100, tolerance: float = 1e-3) -> DataFrame:
    """(series, m, l, d): the Sinkhorn divergence of every window to the landmark windows l of its series.

    The earlier window of a pair goes first, as steps that end before they converge tell the two apart.
    """
    place = lambda m: F.floor(m * landmarks / F.greatest(F.col("n"), F.lit(landmarks)))
    held = held.withColumn("mark", (F.col("m") == 0) | (place(F.col("m")) > place(F.col("m") - 1))).withColumn("rank", place(F.col("m")))
    block = lambda rows, by, name: rows.groupBy("series", F.floor(F.col(by) / BLOCK).alias(name)).agg(F.collect_list(F.struct("m", "points")).alias(f"in_{name}"))
    pairs = block(held, "m", "a").join(block(held.where("mark"), "rank", "b"), "series")
    kind = dict(held.dtypes)["series"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf.iloc[0]
        ids, marks = (np.array([w["m"] for w in row[c]]) for c in ("in_a", "in_b"))
        x, y = (np.array([[list(p) for p in w["points"]] for w in row[c]], float) for c in ("in_a", "in_b"))
        i, j = (g.ravel() for g in np.meshgrid(range(len(ids)), range(len(marks)), indexing="ij"))
        how, own = (eps, rounds, tolerance), []
        size = max(1, CELLS // (x.shape[1] ** 2 * x.shape[2]))
        for z in (x, y):
            own.append(np.concatenate([within(z[s : s + size], *how) for s in range(0, len(z), size)]))
        d = np.zeros(len(i))
        for s in range(0, len(i), size):
            at, to = i[s : s + size], j[s : s + size]
            early = (ids[at] <= marks[to])[:, None, None]
            d[s : s + size] = between(np.where(early, x[at], y[to]), np.where(early, y[to], x[at]), *how) - own[0][at] - own[1][to]
        d[ids[i] == marks[j]] = 0
        return pd.DataFrame({"series": row["series"], "m": ids[i], "l": marks[j], "d": d})

    return written(pairs.groupBy("series", "a", "b").applyInPandas(run, f"series {kind}, m int, l int, d double"), "divergences")


def landmark_clusters(d: np.ndarray, k: int, rounds: int = 100) -> np.ndarray:
    """Clusters of ``k`` landmarks' matrix of divergences: each joins the cluster that is nearest in the mean, until none moves.

    It begins from the first landmark and then always the one that is farthest from all chosen.
    """
    chosen = [0]
    while len(chosen) < k:
        chosen.append(int(d[:, chosen].min(axis=1).argmax()))
    labels = d[:, chosen].argmin(axis=1)
    for _ in range(rounds):
        mean = np.full((len(d), k), np.inf)
        for c in np.unique(labels):
            mean[:, c] = d[:, labels == c].mean(axis=1)
        after = mean.argmin(axis=1)
        if (after == labels).all():
            break
        labels = after
    return labels


def _clusters(dist: DataFrame, least: int, most: int) -> DataFrame:
    """(series, k, l, c): clusters of the landmarks for each number k; a series' landmarks are a bounded group."""
    marks = dist.join(dist.select("series", F.col("l").alias("m")).distinct(), ["series", "m"])
    kind = dict(dist.dtypes)["series"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        d = pdf.pivot(index="m", columns="l", values="d").sort_index().sort_index(axis=1)
        out = [pd.DataFrame({"series": pdf["series"].iloc[0], "k": k, "l": d.columns, "c": landmark_clusters(d.to_numpy(), k)}) for k in range(least, min(most, len(d)) + 1)]
        return pd.concat(out) if out else pd.DataFrame(columns=["series", "k", "l", "c"])

    return written(marks.groupBy("series").applyInPandas(run, f"series {kind}, k int, l int, c int"), "clusters")


def _to_clusters(dist: DataFrame, clusters: DataFrame) -> DataFrame:
    """(series, k, m, c, mean, other): mean divergence of each window to each cluster's landmarks, with itself and without."""
    own = F.sum((F.col("m") == F.col("l")).cast("int"))
    n = F.count(F.lit(1))
    return dist.join(clusters, ["series", "l"]).groupBy("series", "k", "m", "c").agg(F.avg("d").alias("mean"), F.when(n > own, F.sum("d") / (n - own)).alias("other"))


def silhouettes(gaps: DataFrame) -> DataFrame:
    """(series, k, silhouette): the mean over all windows; a window that is alone in its cluster counts 0."""
    near = F.min_by("c", F.struct("mean", "c"))
    own = gaps.groupBy("series", "k", "m").agg(near.alias("own"))
    both = gaps.join(own, ["series", "k", "m"]).groupBy("series", "k", "m").agg(F.max(F.when(F.col("c") == F.col("own"), F.col("other"))).alias("a"), F.min(F.when(F.col("c") != F.col("own"), F.col("mean"))).alias("b"))
    top = F.greatest("a", "b")
    value = F.when(F.col("a").isNull() | F.col("b").isNull() | (top == 0), 0.0).otherwise((F.col("b") - F.col("a")) / top)
    return both.groupBy("series", "k").agg(F.avg(value).alias("silhouette"))


def window_clusters(panel: DataFrame, columns: list[str], window: int, stride: int, states: int | None = None, most: int = 10, landmarks: int = 64, eps: float = 1e-3) -> DataFrame:
    """(series, n, m, k, c, mean, own): mean divergence of each window to each of the k clusters, and the cluster it is in.

    Without ``states``, k from 2 to ``most`` is the one of the largest mean silhouette in the series, the smallest such. A
    series with fewer windows than ``states``, or than two, has no row.
    """
    held = written(windows(panel, columns, window, stride), "windows")
    dist = divergences(held, landmarks, eps)
    clusters = _clusters(dist, states or 2, states or most)
    gaps = written(_to_clusters(dist, clusters), "gaps")
    if states is None:
        best = silhouettes(gaps).groupBy("series").agg(F.max_by("k", F.struct("silhouette", -F.col("k"))).alias("k"))
        gaps = gaps.join(best, ["series", "k"])
    own = gaps.groupBy("series", "m").agg(F.min_by("c", F.struct("mean", "c")).alias("own"))
    counts = held.groupBy("series").agg(F.max("n").alias("n"))
    return gaps.drop("other").join(own, ["series", "m"]).join(counts, "series").select("series", "n", "m", "k", "c", "mean", "own")


def _by_row(panel: DataFrame, told: DataFrame, stride: int) -> DataFrame:
    """Rows of the panel with what is told of the last window that begins at or before each; those after the last window have what it has."""
    counts = told.groupBy("series").agg(F.max("n").alias("n"))
    rows = panel.select("series", "t").join(counts, "series")
    return rows.withColumn("m", F.least(F.col("n") - 1, F.floor(F.col("t") / stride)).cast("int")).drop("n").join(told.drop("n"), ["series", "m"])


def transport_regimes(panel: DataFrame, columns: list[str], window: int = 20, stride: int = 5, states: int | None = None, **how) -> DataFrame:
    """(series, t, label): clusters of windows by optimal transport (``window_clusters``), numbered by their first row in the series.

    A row has the label of the last window that begins at or before it.
    """
    own = window_clusters(panel, columns, window, stride, states, **how).select("series", "n", "m", "own").distinct()
    rows = _by_row(panel, own, stride)
    first = rows.groupBy("series", "own").agg(F.min("t").alias("_first"))
    named = first.select("series", "own", (F.row_number().over(Window.partitionBy("series").orderBy("_first")) - 1).alias("label"))
    return rows.join(named, ["series", "own"]).select("series", "t", "label")


def transport_distances(panel: DataFrame, columns: list[str], window: int = 20, stride: int = 5, states: int = 2, **how) -> DataFrame:
    """(series, t, w1 ..): mean divergence of a row's window to the windows of each of ``states`` clusters; 0 for a cluster without any."""
    gaps = window_clusters(panel, columns, window, stride, states, **how)
    wide = gaps.groupBy("series", "n", "m").agg(*(F.coalesce(F.max(F.when(F.col("c") == c, F.col("mean"))), F.lit(0.0)).alias(f"w{c + 1}") for c in range(states)))
    return _by_row(panel, wide, stride).select("series", "t", *(f"w{c + 1}" for c in range(states)))
