"""Conditional volatility of long series: the variance recursion as affine maps over blocks of rows, fitted by likelihoods of whole grids of parameters."""

from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import written
from .chains import SIZE, _each, blocked, scanned

#: Parameters are sought as logits of the persistence alpha + beta and of alpha's share in it, and as the logarithm of the level of the variance.
CENTRE, REACH = (2.2, -1.7, 0.0), (2.6, 2.2, 0.8)
OFFSETS = np.array(list(product((-1.0, -0.5, 0.0, 0.5, 1.0), repeat=3)))


def laws(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """omega, alpha and beta of points (persistence, share, level), for rows of variance 1."""
    lasting, share = 1 / (1 + np.exp(-points[:, 0])), 1 / (1 + np.exp(-points[:, 1]))
    return np.exp(points[:, 2]) * (1 - lasting), lasting * share, lasting * (1 - share)


def _after(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two affine maps one after the other, for each candidate: factors, then constants."""
    (f, c), (g, d) = a.reshape(2, -1), b.reshape(2, -1)
    return np.concatenate([f * g, g * c + d])


def _map(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """How a block's rows take the variance of its first row to that of the row after its last."""
    omega, alpha, beta = laws(points)
    f, c = np.ones(len(points)), np.zeros(len(points))
    for r in x:
        f, c = f * beta, c * beta + omega + alpha * r * r
    return np.concatenate([f, c])


def _variances(x: np.ndarray, points: np.ndarray, before: np.ndarray | None) -> np.ndarray:
    """The variance of each row (rows) under each candidate (columns); a series begins with 1."""
    omega, alpha, beta = laws(points)
    v = np.ones(len(points)) if before is None else np.asarray(before).reshape(2, -1).sum(axis=0)
    out = np.empty((len(x), len(points)))
    for t, r in enumerate(x):
        out[t] = v
        v = omega + alpha * r * r + beta * v
    return out


def returns(panel: DataFrame, column: str = "value") -> DataFrame:
    """(series, t, r, scale): differences, 0 for the first row, over their deviation; a series that does not move has r = 0 and scale 0."""
    w = Window.partitionBy("series").orderBy("t")
    d = panel.select("series", "t", F.coalesce(F.col(column) - F.lag(column).over(w), F.lit(0.0)).alias("d"))
    scale = d.groupBy("series").agg(F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("scale"))
    return d.join(scale, "series").select("series", "t", F.when(F.col("scale") > 1e-12, F.col("d") / F.col("scale")).otherwise(0.0).alias("r"), "scale")


def fit_garch(panel: DataFrame, column: str = "value", rounds: int = 9, size: int = SIZE) -> tuple[DataFrame, DataFrame]:
    """GARCH(1, 1) of the differences of every series, without a mean: (series, omega, alpha, beta, score), and (series, t, sigma).

    Each round scores 125 candidates around the best so far of each series, in two passes over the blocks, and then looks half as
    far around the best. ``score`` is the log likelihood of the scaled differences, without constants; ``omega`` and ``sigma`` are in the units of the series.
    """
    own = written(returns(panel, column), "returns")
    blocks, kind = blocked(own, ["r"], size), panel.schema["series"].dataType.simpleString()
    element, scored = f"series {kind}, block long, m array<double>", f"series {kind}, scores array<double>"
    best = own.groupBy("series").agg(F.max("scale").alias("scale")).withColumns({"point": F.array(*map(F.lit, CENTRE)), "score": F.lit(float("-inf"))})
    for k in range(rounds):
        reach = np.array(REACH) / 2**k
        met = blocks.join(best.select("series", "point"), "series")
        around = scanned(_each(met, lambda r, h=reach: [(r.series, r.block, _map(r.x, np.asarray(r.point) + h * OFFSETS))], element), _after, size)

        def score(r, h=reach):
            v = _variances(r.x, np.asarray(r.point) + h * OFFSETS, r.before)
            return [(r.series, -0.5 * (np.log(v) + np.asarray(r.x)[:, None] ** 2 / v).sum(axis=0))]

        sums = _each(met.join(around, ["series", "block"]), score, scored).select("series", F.posexplode("scores").alias("i", "s")).groupBy("series", "i").agg(F.sum("s").alias("s"))
        top = sums.groupBy("series").agg(F.max(F.struct("s", (-F.col("i")).alias("i"))).alias("x"))
        offsets = F.array(*(F.array(*(F.lit(float(x)) for x in row)) for row in reach * OFFSETS))
        moved = F.zip_with("point", F.element_at(offsets, (1 - F.col("x.i")).cast("int")), lambda a, b: a + b)
        best = written(best.join(top, "series").select("series", "scale", moved.alias("point"), F.col("x.s").alias("score")), "best")

    def told(r):
        omega, alpha, beta = laws(np.asarray(r.point)[None])
        return [(r.series, float(omega[0] * r.scale**2), float(alpha[0]), float(beta[0]), float(r.score))]

    met = blocks.join(best.select("series", "point", "scale"), "series")
    around = scanned(_each(met, lambda r: [(r.series, r.block, _map(r.x, np.asarray(r.point)[None]))], element), _after, size)
    sigma = _each(met.join(around, ["series", "block"]), lambda r: [(r.series, t, float(np.sqrt(v) * r.scale)) for t, v in zip(r.t, _variances(r.x, np.asarray(r.point)[None], r.before)[:, 0], strict=True)], f"series {kind}, t long, sigma double")
    return _each(best, told, f"series {kind}, omega double, alpha double, beta double, score double"), sigma


def garch_regimes(panel: DataFrame, column: str = "value", states: int = 2, least: int = 10, **knobs) -> DataFrame:
    """(series, t, label): the log volatility by its quantiles, runs shorter than ``least`` given away, numbered by first row; a volatility that never moves is one regime."""
    from .chains import numbered
    from .detectors import smoothed

    log = written(fit_garch(panel, column, **knobs)[1].select("series", "t", F.log(F.greatest("sigma", F.lit(1e-12))).alias("s")), "sigma")
    cuts = log.groupBy("series").agg(F.percentile("s", [k / states for k in range(1, states)] or [0.5]).alias("cuts"), (F.max("s") - F.min("s")).alias("span"))
    label = F.when((F.col("span") < 1e-8) | F.lit(states < 2), 0).otherwise(F.size(F.filter("cuts", lambda c: F.col("s") >= c)))
    return numbered(smoothed(log.join(cuts, "series").select("series", "t", label.cast("int").alias("label")), least))
