"""What sets regimes apart: their means, distances and groups, and which series fit them worst."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def regime_means(rows: DataFrame) -> DataFrame:
    """(series, label, mean)."""
    return rows.groupBy("series", "label").agg(F.avg("value").alias("mean"))


def distances(means: DataFrame) -> DataFrame:
    """(a, b, d): Euclidean distance of every two regimes over the series that both have; regimes are few."""
    other = means.select("series", F.col("label").alias("b"), F.col("mean").alias("mean2"))
    gap = F.col("mean") - F.col("mean2")
    return means.select("series", F.col("label").alias("a"), "mean").join(other, "series").groupBy("a", "b").agg(F.sqrt(F.sum(gap * gap)).alias("d"))


def mahalanobis(rows: DataFrame, columns: list[str], ridge: float = 1e-6) -> DataFrame:
    """(a, b, d): distance of every two regimes' means of a wide panel, by the covariance of all rows and a small ridge.

    Spark sums the covariances; the driver inverts a matrix of columns by columns.
    """
    n = len(columns)
    cov = rows.agg(F.array(*(F.covar_samp(a, b) for a in columns for b in columns))).first()[0]
    cov = np.array([x or 0.0 for x in cov], float).reshape(n, n)
    inverse = np.linalg.pinv(cov + ridge * np.eye(n))
    means = rows.groupBy("label").agg(F.array(*(F.avg(c) for c in columns)).alias("m"))
    pairs = means.select(F.col("label").alias("a"), F.col("m").alias("x"), F.lit(1).alias("_one")).join(means.select(F.col("label").alias("b"), F.col("m").alias("y"), F.lit(1).alias("_one")), "_one")
    gap = [F.col("x")[i] - F.col("y")[i] for i in range(n)]
    square = sum((float(inverse[i, j]) * gap[i] * gap[j] for i in range(n) for j in range(n)), F.lit(0.0))
    return pairs.select("a", "b", F.sqrt(F.greatest(F.lit(0.0), square)).alias("d"))


def worst_series(loss: DataFrame, k: int) -> DataFrame:
    """The ``k`` series of the largest total loss over their regimes: (series, loss)."""
    total = loss.groupBy("series").agg(F.sum("loss").alias("loss"))
    return total.orderBy(F.desc("loss"), "series").limit(k)


def regime_groups(rows: DataFrame, columns: list[str], k: int | None = None, seed: int = 42) -> DataFrame:
    """(label, group): k-means over the regimes' means, by default half as many groups as regimes, two at least."""
    means = rows.groupBy("label").agg(*(F.avg(c).alias(c) for c in columns))
    n = means.count()
    if n < 2:
        return means.select("label", F.lit(0).alias("group"))
    v = VectorAssembler(inputCols=columns, outputCol="features").transform(means)
    model = KMeans(k=k or max(2, n // 2), seed=seed).fit(v)
    return model.transform(v).select("label", F.col("prediction").alias("group"))


def leaf_transitions(leaves: DataFrame) -> DataFrame:
    """(a, b, p) that no regime decides: from any regime to b by b's share of the mass in the leaves (label, mass) of a tree."""
    mass = leaves.groupBy("label").agg(F.sum("mass").alias("mass")).where("mass > 0")
    share = mass.select("label", (F.col("mass") / F.sum("mass").over(Window.partitionBy(F.lit(1)))).alias("p"), F.lit(1).alias("_one"))  # one row a regime
    return share.select(F.col("label").alias("a"), "_one").join(share.select(F.col("label").alias("b"), "p", "_one"), "_one").select("a", "b", "p")
