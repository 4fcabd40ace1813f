"""Factors of wide panels: independent, sparse, robust and kernel components, dynamic modes of windows.

What sums over the rows is a Spark aggregate whose result is as large as the columns squared,
never as the rows; the small matrices are then solved by numpy. Rows with nulls are to be dropped first
(``frames.finite``). An empty panel has no factors and raises ``ValueError``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .reduce import fourier_map, rank_for


def gram(panel: DataFrame, columns: list[str], of: Callable[[np.ndarray], np.ndarray] = np.asarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, column sums and Gram matrix of ``of(rows)``, summed in each task and then by entry."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            a = of(pdf.to_numpy(float))
            a = np.hstack([np.ones((len(a), 1)), a])
            total = a.T @ a if total is None else total + a.T @ a
        if total is not None:
            yield pd.DataFrame({"at": np.arange(total.size, dtype=np.int32), "value": total.ravel()})

    parts = panel.select(*columns).mapInPandas(run, "at int, value double")
    flat = [r["value"] for r in parts.groupBy("at").agg(F.sum("value").alias("value")).orderBy("at").collect()]
    if not flat or not flat[0]:
        raise ValueError("an empty panel has no factors")
    m = np.array(flat).reshape(int(len(flat) ** 0.5), -1)
    return int(m[0, 0]), m[0, 1:], m[1:, 1:]


def moments(panel: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Means and population covariance; the second pass is over centred rows, so that nothing cancels."""
    n, total, _ = gram(panel, columns)
    mean = total / n
    return mean, gram(panel, columns, lambda x: x - mean)[2] / n


def _leading(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    values, vectors = np.linalg.eigh(matrix)
    return values[::-1][:k], vectors[:, ::-1][:, :k]


def _upright(weights: np.ndarray) -> np.ndarray:
    """Each column with its largest entry positive."""
    top = weights[np.abs(weights).argmax(axis=0), np.arange(weights.shape[1])]
    return weights * np.where(top < 0, -1.0, 1.0)


def projected(columns: list[str], mean: np.ndarray, weights: np.ndarray, prefix: str) -> list[Column]:
    term = lambda j: sum(((F.col(c) - float(m)) * float(w) for c, m, w in zip(columns, mean, weights[:, j], strict=True)), F.lit(0.0))
    return [term(j).alias(f"{prefix}{j + 1}") for j in range(weights.shape[1])]


def independent_components(panel: DataFrame, columns: list[str], k: int, rounds: int = 100, tolerance: float = 1e-4, seed: int = 0) -> DataFrame:
    """``ic1`` .. by symmetric FastICA with the log-cosh contrast: a round is one aggregate over whitened rows.

    At most as many components as directions with variance.
    """
    mean, cov = moments(panel, columns)
    values, vectors = _leading(cov, k)
    some = values > 1e-10 * max(values[0], 1e-300)
    white = vectors[:, some] / np.sqrt(values[some])
    k = white.shape[1]
    rows = panel.select(*projected(columns, mean, white, "z")).persist()
    z = [F.col(f"z{i + 1}") for i in range(k)]
    w = np.linalg.qr(np.random.default_rng(seed).normal(size=(k, k)))[0]
    for _ in range(rounds):
        g = [F.tanh(sum((z[i] * float(w[j, i]) for i in range(k)), F.lit(0.0))) for j in range(k)]
        bent = rows.select(*z, *(x.alias(f"g{j}") for j, x in enumerate(g)))
        got = bent.agg(*(F.avg(F.col(f"g{j}") * z[i]) for j in range(k) for i in range(k)), *(F.avg(1 - F.col(f"g{j}") * F.col(f"g{j}")) for j in range(k))).first()
        new = np.array(got[: k * k]).reshape(k, k) - np.array(got[k * k :])[:, None] * w
        u, _, v = np.linalg.svd(new)
        new = u @ v
        moved = np.abs(np.abs((new * w).sum(axis=1)) - 1).max()
        w = new
        if moved < tolerance:
            break
    rows.unpersist()
    return panel.select(*panel.columns, *projected(columns, mean, _upright(white @ w.T), "ic"))


def sparse_loadings(cov: np.ndarray, k: int, alpha: float, rounds: int = 200) -> np.ndarray:
    """Loadings one by one: power steps whose entries under ``alpha`` times the largest are shrunk to zero, then deflation."""
    cov, out = np.array(cov, float), []
    for _ in range(k):
        v = _leading(cov, 1)[1][:, 0]
        for _ in range(rounds):
            u = cov @ v
            u = np.sign(u) * np.maximum(np.abs(u) - alpha * np.abs(u).max(), 0)
            if not (norm := np.linalg.norm(u)):
                break
            v, last = u / norm, v
            if np.abs(v - last).max() < 1e-9:
                break
        out.append(v)
        left = np.eye(len(cov)) - np.outer(v, v)
        cov = left @ cov @ left
    return _upright(np.stack(out, axis=1))


def sparse_components(panel: DataFrame, columns: list[str], k: int, alpha: float = 0.3) -> DataFrame:
    """``sc1`` .. : centred rows on sparse loadings; ``alpha`` 0 gives plain principal components."""
    mean, cov = moments(panel, columns)
    return panel.select(*panel.columns, *projected(columns, mean, sparse_loadings(cov, k, alpha), "sc"))


class _Alternating:
    """The rows' low-rank and sparse parts after the steps so far, replayed from the rows alone.

    A step is its penalty and a projection of columns by columns, so no state of the rows is
    kept between Spark jobs, and a lost executor costs nothing but its own tasks.
    """

    def __init__(self, mean: np.ndarray, weight: float, dual: float):
        self.mean, self.weight, self.dual = mean, weight, dual
        self.steps: list[tuple[float, np.ndarray]] = []

    def parts(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        m = x - self.mean
        low, sparse, y = np.zeros_like(m), np.zeros_like(m), m / self.dual
        for mu, project in self.steps:
            low = (m - sparse + y / mu) @ project
            a = m - low + y / mu
            sparse = np.sign(a) * np.maximum(np.abs(a) - self.weight / mu, 0)
            y = y + mu * (m - low - sparse)
        return m, low, sparse, y


def robust_components(panel: DataFrame, columns: list[str], rounds: int = 40, tolerance: float = 1e-6, weight: float | None = None) -> DataFrame:
    """``low_<column>`` and ``sparse_<column>``: centred rows as a low-rank part plus sparse outliers.

    Augmented Lagrangian steps; the singular-value threshold of a step is a projection that the
    columns' Gram matrix gives. ``weight`` is that of the outliers, by default one over the root of the rows.
    """
    n, total, _ = gram(panel, columns)
    mean, p = total / n, len(columns)
    second = gram(panel, columns, lambda x: x - mean)[2]
    top = float(np.sqrt(max(0.0, _leading(second, 1)[0][0])))
    largest = max(panel.agg(*(F.max(F.abs(F.col(c) - float(m))) for c, m in zip(columns, mean, strict=True))).first())
    weight = weight or 1 / np.sqrt(max(n, p))
    fit = _Alternating(mean, weight, max(top, largest / weight, 1e-300))
    mu, size = 1.25 / max(top, 1e-300), max(float(np.trace(second)), 1e-300)
    for _ in range(rounds if top else 0):

        def now(x: np.ndarray, mu: float = mu) -> np.ndarray:
            m, low, sparse, y = fit.parts(x)
            return np.hstack([m - sparse + y / mu, m - low - sparse])

        both = gram(panel, columns, now)[2]
        if fit.steps and np.trace(both[p:, p:]) < tolerance**2 * size:
            break
        values, vectors = np.linalg.eigh(both[:p, :p])
        s = np.sqrt(np.maximum(values, 0))
        keep = np.where(s > 1 / mu, 1 - 1 / mu / np.maximum(s, 1e-300), 0)
        fit.steps.append((mu, (vectors * keep) @ vectors.T))
        mu *= 1.5

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in panel.schema)
    new = [f"{k}_{c}" for k in ("low", "sparse") for c in columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            _, low, sparse, _ = fit.parts(pdf[columns].to_numpy(float))
            yield pd.concat([pdf, pd.DataFrame(np.hstack([low, sparse]), columns=new, index=pdf.index)], axis=1)

    return panel.mapInPandas(run, ", ".join([kinds, *(f"{c} double" for c in new)]))


def kernel(x: np.ndarray, z: np.ndarray, kind: str = "rbf", gamma: float = 1.0, degree: int = 3, constant: float = 1.0) -> np.ndarray:
    """Kernel of every row of ``x`` with every row of ``z``; the two chi-square kernels are for columns that are not negative."""
    if kind == "rbf":
        return np.exp(-gamma * np.maximum(0, (x * x).sum(axis=1)[:, None] + (z * z).sum(axis=1) - 2 * x @ z.T))
    if kind == "laplacian":
        return np.exp(-gamma * np.abs(x[:, None] - z).sum(axis=2))
    if kind in ("chi2", "additive_chi2"):
        if (x < 0).any() or (z < 0).any():
            raise ValueError("a chi-square kernel needs columns that are not negative")
        total = x[:, None] + z
        gap = -((x[:, None] - z) ** 2 / np.where(total == 0, 1, total)).sum(axis=2)
        return np.exp(gamma * gap) if kind == "chi2" else gap
    if kind == "cosine":
        length = lambda a: np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-300)
        return (x / length(x)) @ (z / length(z)).T
    dot = x @ z.T
    if kind == "linear":
        return dot
    if kind == "poly":
        return (gamma * dot + constant) ** degree
    if kind == "sigmoid":
        return np.tanh(gamma * dot + constant)
    raise ValueError(f"unknown kernel {kind!r}")


def nystroem_map(panel: DataFrame, columns: list[str], n: int = 50, kind: str = "rbf", key: str = "date", **how) -> DataFrame:
    """(key, z): features whose products approach the kernel, from ``n`` rows picked by a hash of ``key``; as many features as directions they span."""
    picked = panel.orderBy(F.xxhash64(key), *columns).limit(n).select(*columns).collect()
    z = np.array(picked, float)
    u, s, v = np.linalg.svd(kernel(z, z, kind, **how))
    root = (u / np.sqrt(np.maximum(s, 1e-12))) @ v

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "z": list(kernel(pdf[columns].to_numpy(float), z, kind, **how) @ root.T)})

    return panel.select(key, *columns).mapInPandas(run, f"{key} {panel.schema[key].dataType.simpleString()}, z array<double>")


def feature_map(panel: DataFrame, columns: list[str], to: str = "raw", **how) -> DataFrame:
    """(date, z) by a named map: ``raw`` columns, ``rff`` (or ``inv_rff``) random Fourier features, ``nystroem``."""
    if to == "raw":
        return panel.select("date", F.array(*(F.col(c).cast("double") for c in columns)).alias("z"))
    if to in ("rff", "inv_rff"):
        return fourier_map(panel, columns, **how)
    if to == "nystroem":
        return nystroem_map(panel, columns, **how)
    raise ValueError(f"unknown map {to!r}")


def kernel_components(panel: DataFrame, columns: list[str], k: int, kind: str = "rbf", landmarks: int = 100, key: str = "date", **how) -> DataFrame:
    """``kc1`` .. : principal components in a kernel's feature space, by Nystroem's method.

    At most ``landmarks`` rows, picked by a hash of ``key``, span the space; with as many landmarks as rows it is the
    exact kernel PCA, up to directions without variance. Columns are standardised first.
    """
    mean, cov = moments(panel, columns)
    scale = np.sqrt(np.diag(cov))
    scale[scale == 0] = 1
    picked = panel.orderBy(F.xxhash64(key), *columns).limit(landmarks).select(*columns).collect()
    z = (np.array(picked, float) - mean) / scale
    values, vectors = np.linalg.eigh(kernel(z, z, kind, **how))
    some = values > 1e-9 * values.max()
    root = vectors[:, some] / np.sqrt(values[some])
    raised = lambda x: kernel((x - mean) / scale, z, kind, **how) @ root
    n, total, _ = gram(panel, columns, raised)
    centre = total / n
    spread = gram(panel, columns, lambda x: raised(x) - centre)[2] / n
    load = _upright(_leading(spread, k)[1])
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in panel.schema)
    names = [f"kc{j + 1}" for j in range(load.shape[1])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = (raised(pdf[columns].to_numpy(float)) - centre) @ load
            yield pd.concat([pdf, pd.DataFrame(out, columns=names, index=pdf.index)], axis=1)

    return panel.mapInPandas(run, ", ".join([kinds, *(f"{c} double" for c in names)]))


def modes(x: np.ndarray, rank: int, rule: str | None = None, threshold: float = 0.95) -> list[np.ndarray]:
    """Real and imaginary parts of the eigenvalues, log amplitudes and singular values of one window's dynamics, padded with zeros.

    At most ``rank`` modes; a ``rule`` of ``rank_for`` may leave fewer of them.
    """
    before, after = x[:-1].T, x[1:].T
    u, s, v = np.linalg.svd(before, full_matrices=False)
    r = max(1, min(rank, int((s > 1e-10 * max(s[0], 1e-300)).sum())))
    if rule and s[0] > 0:
        r = min(r, rank_for(s * s, threshold, rule))
    u, sr, v = u[:, :r], s[:r], v[:r]
    step = u.T @ after @ v.T / np.maximum(sr, 1e-300)
    values, vectors = np.linalg.eig(step)
    amplitude = np.abs(np.linalg.lstsq(u @ vectors, before[:, 0].astype(complex), rcond=None)[0])
    order = np.lexsort((values.imag, -np.abs(values)))
    pad = lambda a: np.concatenate([np.real(a), np.zeros(rank - r)])
    return [pad(values.real[order]), pad(values.imag[order]), pad(np.log1p(amplitude[order])), pad(sr)]


def dynamic_modes(panel: DataFrame, columns: list[str], width: int, stride: int, rank: int, index: str = "t", rule: str | None = None, threshold: float = 0.95) -> DataFrame:
    """(window, start, re, im, amplitude, sigma) of each window of ``width`` steps that begins at a multiple of ``stride``.

    ``index`` numbers the steps from 0. Windows that lack a step are left out. A row goes to the few windows that hold it, and
    each window is solved by itself.
    """
    t = F.col(index).cast("long")
    first = F.greatest(F.lit(0).cast("long"), F.floor((t - F.lit(width) + F.lit(stride)) / stride))
    held = panel.withColumn("window", F.explode(F.sequence(first, F.floor(t / stride)))) if stride <= width else panel.withColumn("window", F.floor(t / stride)).where(t % stride < width)
    held = held.select("window", t.alias("_t"), *columns)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_t")
        if pdf["_t"].nunique() != width or len(pdf) != width:
            return pd.DataFrame(columns=["window", "start", "re", "im", "amplitude", "sigma"])
        got = modes(pdf[columns].to_numpy(float), rank, rule, threshold)
        return pd.DataFrame([[int(pdf["window"].iat[0]), int(pdf["_t"].iat[0]), *map(list, got)]], columns=["window", "start", "re", "im", "amplitude", "sigma"])

    return held.groupBy("window").applyInPandas(run, "window long, start long, re array<double>, im array<double>, amplitude array<double>, sigma array<double>")
