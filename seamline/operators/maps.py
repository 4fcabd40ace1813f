"""Feature maps of panels (series, t, columns), whose inner products approach a kernel, and the bandwidths they need.

A segment's kernel cost is its length less the squared norm of its mapped rows' sum over that length, so a map turns kernel
searches into sums (``search``, ``dynamic``) in time linear in the rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .factors import kernel
from .twosample import median_gammas

RULES = ("median", "sk_scale", "total_variance", "max_variance", "unscaled_max_variance")


def bandwidths(panel: DataFrame, columns: list[str], rule: str | float = "median", most: int = 500) -> DataFrame:
    """(series, gamma) of a Gaussian kernel: a number, or told from each series by a rule.

    ``median`` takes all pairs of about ``most`` rows of a series, picked by a hash of their place; a series of at most that
    many rows is taken whole. The others are reciprocals of variances of all rows. A variance of 0 counts as 1e-16.
    """
    if not isinstance(rule, str):
        return panel.select("series").distinct().withColumn("gamma", F.lit(float(rule)))
    if rule not in RULES:
        raise ValueError(f"unknown bandwidth rule {rule!r}")
    if rule == "median":
        n = panel.groupBy("series").agg(F.count(F.lit(1)).alias("_n"))
        share = F.pmod(F.xxhash64("series", "t"), F.lit(1 << 20)) / (1 << 20)
        some = panel.select("series", "t", *columns).join(n, "series").where((F.col("_n") <= most) | (share < most / F.col("_n")))
        return median_gammas(some, ["series"], columns)
    if rule == "sk_scale":
        every = panel.select("series", F.explode(F.array(*(F.col(c).cast("double") for c in columns))).alias("x"))
        return every.groupBy("series").agg((1 / (len(columns) * F.greatest(F.var_pop("x"), F.lit(1e-16)))).alias("gamma"))
    own = panel.groupBy("series").agg(F.array(*(F.var_pop(c) for c in columns)).alias("v"))
    most_ = F.array_max("v")
    told = {"total_variance": 2 * F.aggregate("v", F.lit(0.0), lambda a, b: a + b), "max_variance": len(columns) * most_, "unscaled_max_variance": 2 * most_}[rule]
    return own.select("series", (1 / F.greatest(told, F.lit(1e-16))).alias("gamma"))


def _with(panel: DataFrame, columns: list[str], gammas: DataFrame, of: Callable[[np.ndarray], np.ndarray], out: str) -> DataFrame:
    """The panel with the array ``of`` each row's columns, scaled by sqrt(2 gamma) of its series, in Arrow batches."""
    x = F.transform(F.array(*(F.col(c).cast("double") for c in columns)), lambda v: v * F.sqrt(2 * F.col("gamma")))
    own = panel.drop(out).join(gammas.select("series", "gamma"), "series").withColumn("_x", x).drop("gamma")
    kept = [f for f in own.schema if f.name != "_x"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            z = of(np.array(pdf["_x"].tolist(), float).reshape(len(pdf), len(columns)))
            yield pdf.drop(columns="_x").assign(**{out: list(z)})

    return own.mapInPandas(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"`{out}` array<double>"]))


def fourier_pairs(panel: DataFrame, columns: list[str], n: int = 100, gamma: str | float = "median", seed: int = 42, out: str = "z") -> DataFrame:
    """The panel with ``out``, an array of 2 ``n`` features: cosines, then sines, at random frequencies.

    The product of two rows' features is the Gaussian kernel with a standard error of sqrt(1 / (2 n)) at most, a row's with itself
    is 1. The bandwidth is each series' own (``bandwidths``).
    """
    weights = np.random.default_rng(seed).normal(size=(len(columns), n))
    return _with(panel, columns, bandwidths(panel, columns, gamma), lambda x: np.hstack([np.cos(x @ weights), np.sin(x @ weights)]) / math.sqrt(n), out)


def phased(panel: DataFrame, columns: list[str], n: int = 50, gamma: str | float = "median", seed: int = 42, out: str = "z") -> DataFrame:
    """The panel with ``out``, an array of ``n`` random Fourier features with random phases."""
    rng = np.random.default_rng(seed)
    weights, phases = rng.normal(size=(len(columns), n)), rng.uniform(0, 2 * np.pi, n)
    return _with(panel, columns, bandwidths(panel, columns, gamma), lambda x: math.sqrt(2 / n) * np.cos(x @ weights + phases), out)


def nystroem(panel: DataFrame, columns: list[str], n: int = 50, kind: str = "rbf", gamma: str | float = "median", out: str = "z", **how) -> DataFrame:
    """The panel with ``out``, an array of Nystroem features from ``n`` rows, picked over all series by a hash of series and t; as many features as rows were picked.

    The Gaussian kernel has each series' own bandwidth; other kinds and their parameters are those of ``factors.kernel``.
    """
    gammas = bandwidths(panel, columns, gamma if kind == "rbf" else 0.5)
    if kind == "rbf":
        how = {**how, "gamma": 0.5}  # the columns are scaled instead
    elif not isinstance(gamma, str):
        how = {**how, "gamma": gamma}
    scaled = panel.join(gammas, "series").select("series", "t", *(F.col(c) * F.sqrt(2 * F.col("gamma")) for c in columns))
    picked = scaled.orderBy(F.xxhash64("series", "t"), "series", "t").limit(n).collect()
    marks = np.array([r[2:] for r in picked], float).reshape(len(picked), len(columns))
    u, s, v = np.linalg.svd(kernel(marks, marks, kind, **how)) if len(marks) else (np.zeros((0, 0)), np.zeros(0), np.zeros((0, 0)))
    root = (u / np.sqrt(np.maximum(s, 1e-12))) @ v
    return _with(panel, columns, gammas, lambda x: kernel(x, marks, kind, **how) @ root.T, out)


def mapped(panel: DataFrame, columns: list[str], to: str = "raw", out: str = "z", **how) -> DataFrame:
    """The panel with ``out``, the array of a named map's features: ``raw`` (the columns), ``rff`` or ``inv_rff``, ``nystroem``."""
    if to == "raw":
        return panel.withColumn(out, F.array(*(F.col(c).cast("double") for c in columns)))
    if to in ("rff", "inv_rff"):
        return phased(panel, columns, out=out, **how)
    if to == "nystroem":
        return nystroem(panel, columns, out=out, **how)
    raise ValueError(f"unknown map {to!r}")


def map_grid(maps: list[str], sizes: list[int] = (50,), kernels: list[dict] = ({},), repeats: int = 1) -> list[dict]:
    """Every map that a specification asks for, as arguments of ``mapped``: each size, kernel and repeat (with its own seed) of ``rff`` and ``nystroem``, ``raw`` once.

    A kernel is a dict of ``kernel`` (``rbf`` unless told), ``gamma`` (a number or a rule) and its other parameters; ``rff`` takes Gaussian ones alone.
    """
    out: list[dict] = []
    for to in maps:
        if to == "raw":
            out.append({"to": "raw"})
        elif to in ("rff", "inv_rff"):
            rbf = [k for k in kernels if k.get("kernel", "rbf") == "rbf"]
            out += [{"to": to, "n": n, "gamma": k.get("gamma", "median"), "seed": 42 + r} for n in sizes for k in rbf for r in range(repeats)]
        elif to == "nystroem":
            out += [{"to": to, "n": n, "kind": k.get("kernel", "rbf")} | {p: v for p, v in k.items() if p != "kernel"} for n in sizes for k in kernels]
        else:
            raise ValueError(f"unknown map {to!r}")
    return out


def kernel_costed(panel: DataFrame, columns: list[str] | str, cost: str = "l2", gamma: str | float = 1.0, n: int = 100, seed: int = 42, out: str = "phi") -> tuple[DataFrame, list[str] | str]:
    """The panel and what of it to sum, so that the squared distance of a segment's sums to their mean is the named cost: the columns for ``l2``, Fourier pairs of them for ``rbf``.

    ``columns`` may also name an array, such as the features of another map.
    """
    if cost == "l2":
        return panel, columns
    if cost != "rbf":
        raise ValueError(f"unknown cost {cost!r}")
    if not isinstance(columns, str):
        return fourier_pairs(panel, columns, n, gamma, seed, out), out
    size = panel.select(F.max(F.size(columns))).first()[0] or 0
    names = [f"_{columns}{i}" for i in range(size)]
    wide = panel.withColumns({c: F.col(columns)[i] for i, c in enumerate(names)})
    return fourier_pairs(wide, names, n, gamma, seed, out).drop(*names), out
