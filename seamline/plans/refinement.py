"""Refinement of a segmentation where it fits worst, until it fits well enough."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import written
from .segmentation import segment


def regime_losses(panel: DataFrame, breaks: DataFrame, columns: list[str], score: Callable[[Column], Column] = F.var_pop) -> DataFrame:
    """(series, lo, hi, column, loss): the score of each column's rows in each regime; without breaks a series is one regime, and breaks at 0 or outside don't count.

    A regime is told to its rows by the last break at or before them, so long series stay apart in ranges of rows.
    """
    n = panel.groupBy("series").agg((F.max("t") + 1).cast("long").alias("n"))
    starts = n.select("series", F.lit(0).cast("long").alias("lo")).union(breaks.join(n, "series").where("b > 0 and b < n").select("series", F.col("b").cast("long"))).distinct()
    spans = starts.join(n, "series").withColumn("hi", F.coalesce(F.lead("lo").over(Window.partitionBy("series").orderBy("lo")), "n")).drop("n")
    size = 4096
    each = spans.withColumn("_k", F.explode(F.sequence(F.floor(F.col("lo") / size), F.floor((F.col("hi") - 1) / size))))
    rows = panel.select("series", F.col("t").cast("long").alias("t"), *columns).withColumn("_k", F.floor(F.col("t") / size))
    met = rows.join(each, ["series", "_k"]).where("t >= lo and t < hi")
    return met.groupBy("series", "lo", "hi").agg(*(score(F.col(c).cast("double")).alias(c) for c in columns)).unpivot(["series", "lo", "hi"], columns, "column", "loss")


def refine_until(
    panel: DataFrame,
    threshold: float,
    columns: list[str] | None = None,
    breaks: DataFrame | None = None,
    rounds: int = 10,
    worst_columns: int = 5,
    score: Callable[[Column], Column] = F.var_pop,
    **knobs,
) -> tuple[DataFrame, DataFrame]:
    """Breaks (series, b, level, round), and how it went (series, round, lo, hi, column, loss, found).

    Each round takes in every series the regime and column with the largest loss. If that is above ``threshold``, the regime is segmented anew by its
    ``worst_columns`` worst columns; what is found joins the breaks, with its level within the regime. A series is done when its largest loss is at most
    ``threshold`` or nothing is found in its worst regime (``found`` is 0), and all end after ``rounds``. A round is one segmentation of all series that go on. ``breaks``
    (series, b, level) are those to begin with, of round 0.
    """
    columns = columns or ["value"]
    held = (panel.select("series", F.lit(0).cast("long").alias("b"), F.lit(1).alias("level")).limit(0) if breaks is None else breaks.select("series", "b", "level")).withColumn("round", F.lit(0))
    open_, steps = panel.select("series").distinct(), []
    values = F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*(F.col(c).cast("double") for c in columns)))
    for k in range(1, rounds + 1):
        own = panel.join(open_, "series", "left_semi")
        losses = regime_losses(own, held.join(open_, "series", "left_semi"), columns, score)
        by = Window.partitionBy("series", "lo").orderBy(F.desc("loss"), "column")
        ranked = losses.withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= worst_columns)
        regimes = ranked.groupBy("series", "lo", "hi").agg(F.max("loss").alias("loss"), F.sort_array(F.collect_list(F.struct("_r", "column")))["column"].alias("picked"))
        top = regimes.withColumn("_r", F.row_number().over(Window.partitionBy("series").orderBy(F.desc("loss"), "lo"))).where((F.col("_r") == 1) & (F.col("loss") > threshold))
        worst = written(top.select("series", "lo", "hi", "loss", "picked"), "worst")
        if worst.isEmpty():
            break
        rows = own.join(worst.select("series", "picked", "lo", "hi"), "series").where("t >= lo and t < hi")
        rows = rows.select("series", (F.col("t") - F.col("lo")).cast("int").alias("t"), F.transform("picked", lambda c: F.element_at(values, c)).alias("z"))
        found = segment(rows, "z", {"base": knobs}).where("status = 'valid'").join(worst.select("series", "lo"), "series").select("series", (F.col("b") + F.col("lo")).alias("b"), "level")
        found = written(found, "found")
        counts = found.groupBy("series").agg(F.count(F.lit(1)).alias("found"))
        steps.append(worst.join(counts, "series", "left").select("series", F.lit(k).alias("round"), "lo", "hi", F.col("picked")[0].alias("column"), "loss", F.coalesce("found", F.lit(0)).alias("found")))
        held = held.union(found.withColumn("round", F.lit(k)))
        open_ = counts.select("series")
    none = panel.select("series", F.lit(0).alias("round"), F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi"), F.lit("").alias("column"), F.lit(0.0).alias("loss"), F.lit(0).cast("long").alias("found")).limit(0)
    return held, reduce(DataFrame.union, steps, none)
