"""Scores of how badly a regime is explained, a row a series and label; rows: (series, label, t, value)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.twosample import median_gammas

_CELL = ("series", "label")


def mse_to_mean(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*_CELL).agg(F.var_pop("value").alias("score"))


def mad_to_median(rows: DataFrame) -> DataFrame:
    mid = rows.groupBy(*_CELL).agg(F.percentile("value", 0.5).alias("mid"))
    return rows.join(mid, list(_CELL)).groupBy(*_CELL).agg(F.avg(F.abs(F.col("value") - F.col("mid"))).alias("score"))


def mse_on_diff(rows: DataFrame, order: int = 1) -> DataFrame:
    """Population variance of the ``order``-th differences within each regime, 0 where there is none."""
    own = rows.withColumn("d", F.col("value"))
    for _ in range(order):
        own = own.withColumn("d", F.col("d") - F.lag("d").over(Window.partitionBy(*_CELL).orderBy("t")))
    return own.groupBy(*_CELL).agg(F.coalesce(F.var_pop("d"), F.lit(0.0)).alias("score"))


def factor_residual(rows: DataFrame, columns: list[str], components: int = 1) -> DataFrame:
    """(label, column, score): mean square that the regime's first principal components leave of each column.

    Spark sums each regime's covariances; only these, columns squared a regime, go to numpy. With fewer than two rows or columns
    nothing is explained.
    """
    pairs = [(i, j) for i in range(len(columns)) for j in range(len(columns))]
    cov = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.array(*(F.covar_pop(columns[i], columns[j]) for i, j in pairs)).alias("cov"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for label, n, c in zip(pdf["label"], pdf["n"], pdf["cov"], strict=True):
                c = np.array(c, float).reshape(len(columns), len(columns))
                left = np.diag(c).copy()
                if n >= 2 and len(columns) >= 2:
                    values, vectors = np.linalg.eigh(c)
                    k = max(1, min(components, len(columns) - 1, n - 1))
                    left -= (vectors[:, -k:] ** 2 * values[-k:]).sum(axis=1)
                out += [(label, name, max(0.0, float(x))) for name, x in zip(columns, left, strict=True)]
            yield pd.DataFrame(out, columns=["label", "column", "score"])

    kind = rows.schema["label"].dataType.simpleString()
    return cov.mapInPandas(run, f"label {kind}, column string, score double")


def _stepped(rows: DataFrame, most: int) -> DataFrame:
    """Each regime thinned by a stride to at most ``most`` rows: (series, label, k, value, n), k from 0."""
    w = Window.partitionBy(*_CELL)
    placed = rows.withColumns({"k": F.row_number().over(w.orderBy("t")) - 1, "n": F.count(F.lit(1)).over(w)})
    placed = placed.where(F.col("k") % F.greatest(F.lit(1), F.ceil(F.col("n") / most)) == 0)
    return placed.select(*_CELL, "value", (F.row_number().over(w.orderBy("k")) - 1).alias("k"), F.count(F.lit(1)).over(w).alias("n"))


def _split_samples(rows: DataFrame, splits: int, least: int, most: int) -> DataFrame:
    """The thinned rows of each regime once for each of ``splits`` places: (series, label, split, k, side, value)."""
    own = _stepped(rows, most).where(F.col("n") > 2 * least)
    span = F.col("n") - 2 * least - 1
    places = [F.floor(least + span * i / (splits - 1)) for i in range(splits)] if splits > 1 else [F.floor(F.col("n") / 2)]
    own = own.withColumn("split", F.explode(F.array_distinct(F.array(*places))))
    return own.select(*_CELL, "split", "k", (F.col("k") >= F.col("split")).cast("int").alias("side"), "value")


def _split_pairs(samples: DataFrame) -> DataFrame:
    key = [*_CELL, "split"]
    return samples.join(samples.select(*key, F.col("k").alias("k2"), F.col("side").alias("s2"), F.col("value").alias("v2")), key)


def _best_of(rows: DataFrame, stats: DataFrame) -> DataFrame:
    best = stats.groupBy(*_CELL).agg(F.greatest(F.lit(0.0), F.max("stat")).alias("best"))
    return rows.select(*_CELL).distinct().join(best, list(_CELL), "left").select(*_CELL, F.coalesce("best", F.lit(0.0)).alias("score"))


def _contrast(x: Column) -> Column:
    mean = lambda i, j: F.avg(F.when((F.col("side") == i) & (F.col("s2") == j), x))
    return mean(0, 0) + mean(1, 1) - 2 * mean(0, 1)


def energy_split(rows: DataFrame, splits: int = 5, least: int = 10, most: int = 80) -> DataFrame:
    """Largest energy distance of a regime's two parts over a few splits; at most ``most`` rows of a regime, by a stride, are compared, and short regimes score 0."""
    pairs = _split_pairs(_split_samples(rows, splits, least, most))
    return _best_of(rows, pairs.groupBy(*_CELL, "split").agg((-_contrast(F.abs(F.col("value") - F.col("v2")))).alias("stat")))


def mmd_split(rows: DataFrame, splits: int = 5, least: int = 10, most: int = 80, estimator: str = "linear", gamma: float | None = None) -> DataFrame:
    """The same by the squared mean discrepancy (``linear``, ``biased`` or ``unbiased``); without ``gamma`` by the median distance of the regime's rows."""
    samples = _split_samples(rows, splits, least, most)
    width = F.lit(gamma) if gamma is not None else F.col("gamma")
    if gamma is None:
        samples = samples.join(median_gammas(_stepped(rows, most), list(_CELL), ["value"]), list(_CELL))
    kernel = lambda a, b: F.exp(-width * (F.col(a) - F.col(b)) * (F.col(a) - F.col(b)))
    if estimator != "linear":
        pairs = _split_pairs(samples)
        pairs = pairs.where("k <> k2") if estimator == "unbiased" else pairs
        return _best_of(rows, pairs.groupBy(*_CELL, "split").agg(_contrast(kernel("value", "v2")).alias("stat")))
    key = [*_CELL, "split"]
    placed = samples.withColumn("i", F.row_number().over(Window.partitionBy(*key, "side").orderBy("k")) - 1)
    own = lambda side, odd, name: F.max(F.when((F.col("side") == side) & (F.col("i") % 2 == odd), F.col("value"))).alias(name)
    extra = [] if gamma is not None else [F.first("gamma").alias("gamma")]
    both = placed.groupBy(*key, F.floor(F.col("i") / 2).alias("pair")).agg(own(0, 0, "x"), own(0, 1, "x2"), own(1, 0, "y"), own(1, 1, "y2"), *extra).na.drop(subset=["x", "x2", "y", "y2"])
    stat = F.avg(kernel("x", "x2") + kernel("y", "y2") - kernel("x", "y2") - kernel("x2", "y"))
    return _best_of(rows, both.groupBy(*key).agg(stat.alias("stat")))


def cusum_intensity(rows: DataFrame, slack: float = 0.5) -> DataFrame:
    """Largest Crosier CUSUM within each regime, its first half in control; fewer than four rows score 0.

    A step depends on the one before, so each regime's rows pass a task in order, in Arrow batches with the state carried on;
    a regime is never held whole.
    """
    w = Window.partitionBy(*_CELL)
    placed = rows.withColumns({"k": F.row_number().over(w.orderBy("t")) - 1, "n": F.count(F.lit(1)).over(w)})
    first = placed.where(F.col("k") < F.floor(F.col("n") / 2)).groupBy(*_CELL).agg(F.avg("value").alias("mean"), F.var_samp("value").alias("var"))
    z = (F.col("value") - F.col("mean")) / F.sqrt(F.greatest("var", F.lit(1e-8)))
    scaled = placed.where("n >= 4").join(first.where("var is not null"), list(_CELL)).select(*_CELL, "k", z.alias("z"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema if f.name in _CELL}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, c, most = None, 0.0, 0.0
        for pdf in batches:
            out = []
            for cell, x in zip(zip(pdf["series"], pdf["label"], strict=True), pdf["z"], strict=True):
                if cell != at:
                    if at is not None:
                        out.append((*at, most))
                    at, c, most = cell, 0.0, 0.0
                s = c + x
                c = 0.0 if abs(s) <= slack else s * (1 - slack / abs(s))
                most = max(most, abs(c))
            yield pd.DataFrame(out, columns=[*_CELL, "stat"])
        if at is not None:
            yield pd.DataFrame([(*at, most)], columns=[*_CELL, "stat"])

    ordered = scaled.repartition(*_CELL).sortWithinPartitions(*_CELL, "k")
    return _best_of(rows, ordered.mapInPandas(run, f"series {kinds['series']}, label {kinds['label']}, stat double"))


def hotelling_within(rows: DataFrame) -> DataFrame:
    """Squared difference of the halves' means over their pooled variance; 0 for fewer than four rows."""
    w = Window.partitionBy(*_CELL)
    half = rows.withColumns({"k": F.row_number().over(w.orderBy("t")) - 1, "n": F.count(F.lit(1)).over(w)})
    left = F.col("k") < F.floor(F.col("n") / 2)
    side = lambda f, on: f(F.when(left if on else ~left, F.col("value")))
    got = half.groupBy(*_CELL).agg(F.first("n").alias("n"), *(side(f, on).alias(f"{name}{int(on)}") for on in (True, False) for name, f in (("m", F.avg), ("v", F.var_samp))))
    gap = F.col("m1") - F.col("m0")
    return got.select(*_CELL, F.when(F.col("n") < 4, 0.0).otherwise(gap * gap / ((F.col("v1") + F.col("v0")) / 2 + 1e-8)).alias("score"))


def energy_between(rows: DataFrame, side: str = "side") -> DataFrame:
    """Energy distance of the rows on side 0 and on side 1 of each cell, pairs of a cell being few (windows)."""
    b = rows.select(*_CELL, F.col(side).alias("s2"), F.col("value").alias("v2"))
    pair = rows.join(b, list(_CELL)).withColumn("d", F.abs(F.col("value") - F.col("v2")))
    mean = lambda i, j: F.avg(F.when((F.col(side) == i) & (F.col("s2") == j), F.col("d")))
    return pair.groupBy(*_CELL).agg((2 * mean(0, 1) - mean(0, 0) - mean(1, 1)).alias("score"))


def transitions(distances: DataFrame, gamma: float) -> DataFrame:
    """Row-normalised exp(-gamma d) of regime distances (a, b, d)."""
    mass = F.exp(-gamma * F.col("d"))
    return distances.select("a", "b", (mass / F.sum(mass).over(Window.partitionBy("a"))).alias("p"))


#: Scores by name; more may be added. Each takes (series, label, t, value) and gives (series, label, score).
SCORES: dict[str, Callable[..., DataFrame]] = {"mse_to_mean": mse_to_mean, "mad_to_median": mad_to_median, "mse_on_diff": mse_on_diff, "hotelling_within": hotelling_within, "cusum_intensity": cusum_intensity, "energy_split": energy_split, "mmd_split": mmd_split}


def score(rows: DataFrame, name: str, **knobs) -> DataFrame:
    """A named score, one row for each series and label of ``rows``."""
    if name not in SCORES:
        raise ValueError(f"unknown score {name!r}, known are {sorted(SCORES)}")
    out = SCORES[name](rows, **knobs)
    if set(out.columns) != {*_CELL, "score"}:
        raise ValueError(f"score {name!r} has columns {out.columns}")
    return rows.select(*_CELL).distinct().join(out, list(_CELL), "left").select(*_CELL, F.coalesce("score", F.lit(0.0)).alias("score"))
