"""Reductions of wide panels to few columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.features import loadings, nelson_siegel


def principal_components(panel: DataFrame, columns: list[str], k: int) -> DataFrame:
    """``pc1`` .. of the centred columns, the largest loading of each made positive."""
    means = panel.agg(*(F.avg(c).alias(c) for c in columns)).first()
    centred = panel.withColumns({f"_c{i}": F.col(c) - F.lit(means[c]) for i, c in enumerate(columns)})
    vectors = VectorAssembler(inputCols=[f"_c{i}" for i in range(len(columns))], outputCol="_v").transform(centred)
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(vectors)
    load = model.pc.toArray()
    signs = [1.0 if load[np.abs(load[:, j]).argmax(), j] >= 0 else -1.0 for j in range(k)]
    out = model.transform(vectors).withColumn("_a", vector_to_array("_p"))
    return out.select(*panel.columns, *((F.get("_a", F.lit(j)) * signs[j]).alias(f"pc{j + 1}") for j in range(k)))


def raw(panel: DataFrame, columns: list[str]) -> DataFrame:
    """The columns as they are."""
    return panel.select("date", *columns)


def rank_of(panel: DataFrame, columns: list[str], threshold: float, rule: str = "explained") -> int:
    """Number of components of a panel by ``rank_for``; Spark sums the covariances."""
    cov = panel.agg(F.array(*(F.covar_samp(a, b) for a in columns for b in columns))).first()[0]
    values = np.linalg.eigvalsh(np.array([x or 0.0 for x in cov]).reshape(len(columns), -1))[::-1]
    return min(len(columns), rank_for(np.maximum(values, 0), threshold, rule))


def rank_for(eigenvalues: np.ndarray, threshold: float, rule: str = "explained") -> int:
    """Number of components: by explained variance, by entropy, or by the singular-value threshold."""
    v = np.asarray(eigenvalues, float)
    share = v / v.sum()
    if rule == "explained":
        return int(np.searchsorted(share.cumsum(), threshold) + 1)
    if rule == "entropy":
        h = -(share[share > 0] * np.log(share[share > 0])).sum()
        return max(1, int(np.ceil(threshold * len(v) * h / np.log(max(2, len(v))))))
    if rule == "svht":
        w = 0.56 * threshold**3 - 0.95 * threshold**2 + 1.82 * threshold + 1.43
        return max(1, int((np.sqrt(v) > w * np.median(np.sqrt(v))).sum()))
    raise ValueError(rule)


def curve_factors(panel: DataFrame, columns: list[str], years: list[float], decay: float = 0.0609) -> DataFrame:
    """Level, slope and curvature by least squares at a fixed decay: a constant projection of the columns."""
    matrix = nelson_siegel(years, decay)
    term = lambda row: sum((F.col(c) * w for c, w in zip(columns, row, strict=True)), F.lit(0.0))
    return panel.select("date", *(term(r).alias(n) for n, r in zip(("level", "slope", "curvature"), matrix, strict=True)))


#: Decays tried for each curve.
DECAYS = [0.01, 0.03, 0.0609, 0.1, 0.2, 0.3, 0.5, 0.8, 1.0]


def curve_decay(panel: DataFrame, columns: list[str], years: list[float], decays: list[float] | None = None) -> DataFrame:
    """For each row the decay of the grid whose curve fits it best, the first of equal ones, and its factors: (date, level, slope, curvature, decay, sse)."""
    fits = []
    dot = lambda row: sum((F.col(c) * float(w) for c, w in zip(columns, row, strict=True)), F.lit(0.0))
    for d in decays or DECAYS:
        load, inverse = np.array(loadings(years, d)), np.array(nelson_siegel(years, d))
        rest = [dot(row) for row in np.eye(len(years)) - load @ inverse]
        fits.append(F.struct(sum((p * p for p in rest), F.lit(0.0)).alias("sse"), F.lit(d).alias("decay"), *(dot(row).alias(n) for row, n in zip(inverse, ("level", "slope", "curvature"), strict=True))))
    best = F.array_min(F.array(*fits))
    return panel.select("date", *(best[c].alias(c) for c in ("level", "slope", "curvature", "decay", "sse")))


def smooth_across(columns: list[str], width: int = 3) -> dict:
    """Moving average along the columns, the ends repeated."""
    h = width // 2
    pick = lambda i: F.col(columns[min(max(i, 0), len(columns) - 1)])
    return {c: sum((pick(i + k) for k in range(-h, h + 1)), F.lit(0.0)) / (2 * h + 1) for i, c in enumerate(columns)}


def functional_components(panel: DataFrame, columns: list[str], k: int, width: int = 3) -> DataFrame:
    """Principal components of curves smoothed along their columns."""
    return principal_components(panel.withColumns(smooth_across(columns, width)), columns, k)


def random_features(x: np.ndarray, n: int, gamma: float, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.sqrt(2 / n) * np.cos(x @ rng.normal(0, np.sqrt(2 * gamma), (x.shape[1], n)) + rng.uniform(0, 2 * np.pi, n))


def fourier_map(panel: DataFrame, columns: list[str], n: int = 50, gamma: float = 1.0, seed: int = 0) -> DataFrame:
    """(date, z): random Fourier features of each row, in Arrow batches; the weights are the seed's."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"date": pdf["date"], "z": list(random_features(pdf[columns].to_numpy(float), n, gamma, seed))})

    kind = panel.schema["date"].dataType.simpleString()
    return panel.select("date", *columns).mapInPandas(run, f"date {kind}, z array<double>")


def segment_distances(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(series, t, segment, distance): from each row to the mean of each segment of its series; segments are few."""
    means = rows.groupBy("series", F.col("label").alias("segment")).agg(*(F.avg(c).alias(f"_m{i}") for i, c in enumerate(columns)))
    square = sum(((F.col(c) - F.col(f"_m{i}")) ** 2 for i, c in enumerate(columns)), F.lit(0.0))
    return rows.select("series", "t", *columns).join(means, "series").select("series", "t", "segment", F.sqrt(square).alias("distance"))


def _standardised(panel: DataFrame, columns: list[str]) -> DataFrame:
    v = VectorAssembler(inputCols=columns, outputCol="_v").transform(panel)
    return StandardScaler(withMean=True, inputCol="_v", outputCol="features").fit(v).transform(v)


def centre_distances(panel: DataFrame, columns: list[str], k: int = 3, seed: int = 42) -> DataFrame:
    """``c1`` ..: distances of the standardised row to the centres of k-means."""
    v = _standardised(panel, columns)
    model = KMeans(k=k, seed=seed).fit(v)
    gap = lambda c: F.sqrt(F.aggregate(F.zip_with(vector_to_array("features"), F.array(*map(F.lit, c.tolist())), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    return model.transform(v).select(*panel.columns, *(gap(c).alias(f"c{i + 1}") for i, c in enumerate(model.clusterCenters())))


def responsibilities(panel: DataFrame, columns: list[str], k: int = 2, seed: int = 42) -> DataFrame:
    """``p1`` ..: the probabilities of the components of a Gaussian mixture."""
    v = _standardised(panel, columns)
    out = GaussianMixture(k=k, seed=seed).fit(v).transform(v).withColumn("_a", vector_to_array("probability"))
    return out.select(*panel.columns, *(F.get("_a", F.lit(j)).alias(f"p{j + 1}") for j in range(k)))
