"""Detectors that label every row of a series: (series, t, date, label)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.features import ewma, filled, rolling
from . import chains, density, transport, volatility
from .reduce import principal_components


def by_first(labels: DataFrame, order: str) -> DataFrame:
    """Labels numbered by their first row in ``order``, over the whole table; labels are few."""
    first = labels.groupBy(F.col("label").alias("_old")).agg(F.min(order).alias("_first"))
    named = first.select("_old", (F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("_first", "_old")) - 1).alias("_new"))
    return labels.join(named, labels["label"] == named["_old"]).withColumn("label", F.col("_new")).drop("_old", "_new")


def cluster(panel: DataFrame, columns: list[str], k: int = 3, method: str = "kmeans", seed: int = 42) -> DataFrame:
    """Clusters of the standardised rows by k-means or a Gaussian mixture, numbered by their first date if the panel has one."""
    v = VectorAssembler(inputCols=columns, outputCol="_v").transform(panel)
    v = StandardScaler(withMean=True, inputCol="_v", outputCol="features").fit(v).transform(v)
    model = (KMeans if method == "kmeans" else GaussianMixture)(k=k, seed=seed).fit(v)
    out = model.transform(v).select(*panel.columns, F.col("prediction").alias("label"))
    return by_first(out, "date") if "date" in panel.columns else out


def covariance_regimes(wide: DataFrame, columns: list[str], window: int = 40, k: int = 2, least: int = 10, seed: int = 42) -> DataFrame:
    """Clusters of at most three principal components of the rolling correlations of every two columns, short runs given away: (series, t, label); rows before the first whole window have none."""
    c = rolling_correlations(wide, columns, window).na.drop()
    names = [x for x in c.columns if x not in ("series", "t")]
    few = min(3, len(names))
    return smoothed(cluster(principal_components(c, names, few), [f"pc{i + 1}" for i in range(few)], k, seed=seed).select("series", "t", "label"), least)


#: What each detector's arguments must be: the kind, and the least value.
ARGUMENTS = {
    "kmeans": {"k": (int, 1), "seed": (int, 0)}, "gmm": {"k": (int, 1), "seed": (int, 0)},
    "hmm": {"states": (int, 1), "rounds": (int, 1), "tolerance": (float, None), "floor": (float, 0)}, "msar": {"states": (int, 1), "rounds": (int, 1), "tolerance": (float, None)},
    "jump": {"states": (int, 1), "penalty": (float, 0), "rounds": (int, 1)}, "ms_var": {"states": (int, 1), "lags": (int, 0), "least": (int, 1), "rounds": (int, 1)},
    "garch": {"states": (int, 1), "least": (int, 1), "rounds": (int, 1)},
    "wasserstein": {"window": (int, 1), "stride": (int, 1), "states": (int, 1), "most": (int, 2), "landmarks": (int, 2), "eps": (float, 0)},
    "hdbscan": {"least": (int, 2), "samples": (int, 1), "size": (int, 2), "lists": (int, 1), "band": (int, 1)},
}


def problems(method: str, **knobs) -> list[str]:
    """What is wrong with a detector's arguments, in words; nothing for those that it takes. A list stands for a grid, whose every value is looked at."""
    if method not in ARGUMENTS:
        return [f"unknown detector {method!r}"]
    out = []
    for name, given in knobs.items():
        if name not in ARGUMENTS[method]:
            out.append(f"{method} has no argument {name!r}")
            continue
        kind, least = ARGUMENTS[method][name]
        values = given if isinstance(given, list) else [given]
        if not values:
            out.append(f"{name} has no value")
        for v in values:
            if isinstance(v, bool) or not isinstance(v, int if kind is int else int | float):
                out.append(f"{name} must be {'an integer' if kind is int else 'a number'}, not {v!r}")
            elif least is not None and v < least:
                out.append(f"{name} must be at least {least}, not {v!r}")
    return out


def dwell(labels: np.ndarray, least: int) -> np.ndarray:
    """Give short runs away: from the left, a run of fewer than ``least`` rows joins the label to both its sides, or the one it has at an end.

    Works on the list of runs; a run that was given away counts with the one before it from then on.
    """
    starts = np.flatnonzero(np.diff(labels, prepend=np.nan) != 0)
    values, sizes = labels[starts], np.diff(np.append(starts, len(labels)))
    out: list[list] = []  # [label, rows]
    for k, (label, size) in enumerate(zip(values, sizes, strict=True)):
        sides = {x for x in (out[-1][0] if out else None, values[k + 1] if k + 1 < len(values) else None) if x is not None}
        if size < least and len(sides) == 1:
            label = sides.pop()
        if out and out[-1][0] == label:
            out[-1][1] += size
        else:
            out.append([label, size])
    return np.repeat([x for x, _ in out], [n for _, n in out]) if out else labels


#: Detectors by chains over blocks of rows (``chains``, ``volatility``) or by pairs of blocks (``transport``, ``density``).
CHAINED = {"hmm": chains.hmm_labels, "jump": chains.jump_model, "ms_var": chains.switching_autoregression, "garch": lambda p, c, **k: volatility.garch_regimes(p, c[0], **k), "msar": lambda p, c, **k: chains.switching_regression(p, c[0], **k), "wasserstein": transport.transport_regimes, "hdbscan": density.density_clusters}


def detect(panel: DataFrame, method: str, columns: list[str] | None = None, **knobs) -> DataFrame:
    """(series, t, date, label) by a named detector: ``hmm``, ``jump``, ``ms_var``, ``wasserstein``, ``hdbscan``; ``garch`` and ``msar`` look at the first column. The panel's date is kept if it has one."""
    if method not in CHAINED:
        raise ValueError(f"unknown detector {method!r}")
    if wrong := problems(method, **{k: v for k, v in knobs.items() if k != "size"}):
        raise ValueError("; ".join(wrong))
    told = CHAINED[method](panel, columns or ["value"], **knobs).select("series", F.col("t").cast(panel.schema["t"].dataType).alias("t"), "label")
    return panel.select("series", "t", *(c for c in panel.columns if c == "date")).join(told, ["series", "t"])


def smoothed(labels: DataFrame, least: int) -> DataFrame:
    """``dwell`` for each series of labels (series, t, label): only the runs go to Python, one group a series."""
    w = Window.partitionBy("series").orderBy("t")
    runs = labels.withColumn("_new", F.when(F.lag("label").over(w).eqNullSafe(F.col("label")), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    sizes = runs.groupBy("series", "_run", "label").agg(F.count(F.lit(1)).alias("n"))
    kinds = {f.name: f.dataType.simpleString() for f in sizes.schema}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_run")
        after = dwell(np.repeat(pdf["label"].to_numpy(), pdf["n"]), least)
        return pdf[["series", "_run"]].assign(label=after[np.cumsum(pdf["n"]) - pdf["n"]])

    told = sizes.groupBy("series").applyInPandas(run, f"series {kinds['series']}, _run {kinds['_run']}, label {kinds['label']}")
    return runs.drop("label", "_new").join(told, ["series", "_run"]).select(*labels.columns)


def volatility_levels(panel: DataFrame, window: int = 20, states: int = 2, least: int = 1) -> DataFrame:
    """Quantile bins of the log of a volatility: (series, t, date, label), runs shorter than ``least`` given away.

    The volatility is half the rolling mean of squared differences, with gaps filled from the left and then from the right, and half
    their exponential mean of the same span.
    """
    w = Window.partitionBy("series").orderBy("t")
    p = panel.withColumn("r", F.col("value") - F.lag("value").over(w)).where("r is not null").withColumn("value", F.col("r") * F.col("r"))
    p = ewma(p.select("series", "t", "date", "value"), window)
    p = p.withColumn("_m", rolling(F.col("value"), window, F.avg, 3))
    p = p.withColumn("lv", F.log(0.5 * filled(F.col("_m")) + 0.5 * F.col("ewma") + 1e-12))
    cuts = p.groupBy("series").agg(F.percentile("lv", [k / states for k in range(1, states)]).alias("cuts"))
    out = p.join(cuts, "series").select("series", "t", "date", F.expr("size(filter(cuts, c -> lv >= c))").cast("int").alias("label"))
    return out if least < 2 else smoothed(out, least)


def rolling_correlations(wide: DataFrame, columns: list[str], window: int = 40) -> DataFrame:
    """Correlation of every two columns over the last rows: one column a pair. ``wide`` has series and t."""
    from itertools import combinations

    from ..functions.features import rolling_corr

    return wide.select("series", "t", *(rolling_corr(F.col(a), F.col(b), window).alias(f"{a}_{b}") for a, b in combinations(columns, 2)))
