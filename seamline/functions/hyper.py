"""Lag, window and sample size of the tests, given or told from the data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.reduce import principal_components, rank_of
from .features import decay_lag


def ess_window(panel: DataFrame, share: float = 0.1, least: int = 20, most: int = 120) -> DataFrame:
    """(series, ess, width): the effective sample size n (1 - r) / (1 + r), r the correlation with the row before, and a window of half a ``share`` of it.

    A series that does not move has r = 0.
    """
    w = Window.partitionBy("series").orderBy("t")
    own = F.when(F.col("_was").isNotNull(), F.col("value"))
    r = F.coalesce(F.try_divide(F.covar_samp("value", "_was"), F.stddev_samp(own) * F.stddev_samp("_was")), F.lit(0.0))
    c = panel.withColumn("_was", F.lag("value").over(w)).groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.greatest(F.lit(-0.99), F.least(F.lit(0.99), r)).alias("r"))
    ess = F.col("n") * (1 - F.col("r")) / (1 + F.col("r"))
    return c.select("series", ess.alias("ess"), F.greatest(F.lit(least), F.least(F.lit(most), F.round(share * ess / 2))).cast("int").alias("width"))


def component_panel(panel: DataFrame, columns: list[str], explained: float = 0.95) -> DataFrame:
    """(series, t, value): the leading principal components of a wide panel, a series each, as many as explain the share."""
    k = rank_of(panel, columns, explained)
    scores = principal_components(panel, columns, k)
    return scores.unpivot(["t"], [f"pc{i + 1}" for i in range(k)], "series", "value").select("series", "t", "value")


def widest_lag(components: DataFrame, breaks: DataFrame, **knobs) -> DataFrame:
    """(b, lag): the largest decay lag of all components at each break (b)."""
    every = breaks.select("b").withColumn("series", F.explode(F.array(*(F.lit(r["series"]) for r in components.select("series").distinct().collect()))))  # a few components
    return decay_lag(components, every, **knobs).groupBy(F.col("label").alias("b")).agg(F.max("lag").alias("lag"))


def sample_size(width: int, samples: int | None = None, share: float | None = None, least: int = 50) -> int:
    """Rows compared on each side of a break, as far as its window holds them: a number, or a share of both windows with a lower bound; never more than both windows."""
    if samples is None and share is None:
        raise KeyError("a number of samples or a share is needed")
    if samples is not None:
        return min(samples, 2 * width)
    if not 0 < share <= 1:
        raise ValueError("the share must be above 0 and at most 1")
    return min(2 * width, max(round(share * 2 * width), least))


def chosen(panel: DataFrame, breaks: DataFrame, lag: int | str = 5, width: int | str = 40, samples: int | None = None, share: float | None = 1.0, **knobs) -> DataFrame:
    """(series, b, lag, width, samples) for each break: ``lag`` and ``width`` are numbers, or ``decay`` and ``ess``."""
    out = breaks.select("series", "b")
    if lag == "decay":
        told = decay_lag(panel, breaks, **knobs).select("series", F.col("label").alias("b"), "lag")
        out = out.join(told, ["series", "b"], "left").withColumn("lag", F.coalesce("lag", F.lit(5)).cast("int"))
    else:
        out = out.withColumn("lag", F.lit(int(lag)))
    out = out.join(ess_window(panel).select("series", "width"), "series") if width == "ess" else out.withColumn("width", F.lit(int(width)))
    both = 2 * F.col("width")
    size = F.least(F.lit(samples), both) if samples is not None else F.least(both, F.greatest(F.round(share * both), F.lit(50)))
    return out.withColumn("samples", size.cast("int"))
