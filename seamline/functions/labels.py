"""Regime labels, breakpoints and intervals. Tables: labels (series, t, date, label), breaks (series, b)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _run() -> Window:
    return Window.partitionBy("series").orderBy("t")


def breaks_of(labels: DataFrame) -> DataFrame:
    changed = labels.withColumn("_was", F.lag("label").over(_run())).where("_was is not null and label <> _was")
    return changed.select("series", F.col("t").cast("long").alias("b"))


def labels_of(panel: DataFrame, breaks: DataFrame) -> DataFrame:
    """Number of breaks at or before each row; those at 0 or outside don't count."""
    at = breaks.where("b > 0").select("series", F.col("b").alias("t"), F.lit(1).alias("_hit")).distinct()
    return panel.join(at, ["series", "t"], "left").withColumn("label", F.sum(F.coalesce("_hit", F.lit(0))).over(_run()).cast("int")).drop("_hit")


def relabel(labels: DataFrame) -> DataFrame:
    """Labels numbered by their first row; one that comes back keeps its number."""
    first = F.min("t").over(Window.partitionBy("series", "label"))
    placed = labels.withColumn("_first", first)
    return placed.withColumn("label", F.dense_rank().over(Window.partitionBy("series").orderBy("_first")) - 1).drop("_first")


def intervals(labels: DataFrame) -> DataFrame:
    """A row a run of equal labels: first and last date, label, rows."""
    new = F.when(F.lag("label").over(_run()).eqNullSafe(F.col("label")), 0).otherwise(1)
    runs = labels.withColumn("_new", new).withColumn("run", F.sum("_new").over(_run()).cast("int"))
    return runs.groupBy("series", "run", "label").agg(F.min("date").alias("start"), F.max("date").alias("end"), F.count(F.lit(1)).alias("rows"))


def drop_short(breaks: DataFrame, lengths: DataFrame, least: int) -> DataFrame:
    """Breaks with at least ``least`` rows to either neighbour, all judged against the original ones; lengths: (series, n)."""
    w = Window.partitionBy("series").orderBy("b")
    near = breaks.join(lengths, "series").withColumn("_l", F.coalesce(F.lag("b").over(w), F.lit(0))).withColumn("_r", F.coalesce(F.lead("b").over(w), F.col("n")))
    return near.where((F.col("b") - F.col("_l") >= least) & (F.col("_r") - F.col("b") >= least)).select("series", "b")


def merge_close(breaks: DataFrame, tolerance: int) -> DataFrame:
    """In order, a break within ``tolerance`` of the last kept one takes its place."""
    fold = lambda kept, x: F.when((F.size(kept) > 0) & (x - F.element_at(kept, -1) <= tolerance), F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(x))).otherwise(F.concat(kept, F.array(x)))
    by = breaks.groupBy("series").agg(F.array_sort(F.collect_set("b")).alias("all"))
    return by.select("series", F.explode(F.aggregate("all", F.array().cast("array<bigint>"), fold)).alias("b"))


def legends(runs: DataFrame) -> DataFrame:
    """``intervals`` with a text for each: its label, first and last day."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return runs.withColumn("legend", F.concat_ws(" ", F.col("label").cast("string"), F.lit("from"), day("start"), F.lit("to"), day("end")))


def inside(breaks: DataFrame, lengths: DataFrame) -> DataFrame:
    """Breaks within (0, n) of their series, each once; lengths: (series, n)."""
    return breaks.join(lengths, "series").where((F.col("b") > 0) & (F.col("b") < F.col("n"))).drop("n").distinct()


def shifted(breaks: DataFrame, starts: DataFrame) -> DataFrame:
    """Breaks of slices as rows of the whole series; starts: (series, start)."""
    return breaks.join(starts, "series").withColumn("b", F.col("b") + F.col("start")).drop("start")


def combined(parts: list[DataFrame]) -> DataFrame:
    """Breaks (series, b, ...) of several components, each once; where they meet, the later one's columns count."""
    every = reduce(DataFrame.unionByName, (p.withColumn("_k", F.lit(k)) for k, p in enumerate(parts)))
    rest = [c for c in every.columns if c not in ("series", "b", "_k")]
    last = every.groupBy("series", "b").agg(*(F.max_by(c, "_k").alias(c) for c in rest)) if rest else every.select("series", "b").distinct()
    return last.select("series", "b", *rest)


def row_of_window(b: Column, stride: int = 1, width: int = 1) -> Column:
    """The row in the middle of a window of a reduction by windows."""
    return (b * stride + width // 2).cast("long")


def window_of_row(t: Column, stride: int = 1, width: int = 1) -> Column:
    """The window whose middle is at or before a row, 0 at least."""
    return F.greatest(F.lit(0), F.floor((t - width // 2) / stride)).cast("long")


def seed_table(panel: DataFrame, breaks: DataFrame) -> DataFrame:
    """(series, start, end, level): the dates of the regimes between breaks (series, b, level), and the level of the break that ends each; 0 at the end of a series."""
    edges = panel.select("series", "t", "date").join(breaks.select("series", F.col("b").alias("t"), "level"), ["series", "t"], "left").where("t = 0 or level is not null")
    ends = panel.groupBy("series").agg(F.max("date").alias("_last"))
    rows = edges.join(ends, "series").withColumns({"end": F.coalesce(F.lead("date").over(_run()), F.col("_last")), "_level": F.coalesce(F.lead("level").over(_run()), F.lit(0))})
    return rows.select("series", F.col("date").alias("start"), "end", F.col("_level").cast("int").alias("level"))


def breaks_of_seeds(panel: DataFrame, seeds: DataFrame) -> DataFrame:
    """(series, b, level) from a seed table: all ends but a series' last; dates that the panel lacks are passed over."""
    w = Window.partitionBy("series").orderBy("start")
    ends = seeds.withColumn("_more", F.lead("start").over(w).isNotNull()).where("_more").select("series", F.col("end").alias("date"), "level")
    at = panel.groupBy("series", "date").agg(F.min("t").cast("long").alias("b"))
    return ends.join(at, ["series", "date"]).where("b > 0").groupBy("series", "b").agg(F.max("level").alias("level"))


def attached(tree: DataFrame, part: DataFrame, start: int, end: int) -> DataFrame:
    """A hierarchy (series, b, level) with that of a slice put in its place: rows within (start, end) come from the slice."""
    own = part.withColumn("b", F.col("b") + start).where((F.col("b") > start) & (F.col("b") < end))
    return combined([tree.select("series", "b", "level"), own.select("series", "b", "level")])


def interval_tree(breaks: DataFrame, lengths: DataFrame) -> DataFrame:
    """(series, level, lo, hi, parent_lo, parent_hi): the intervals that each level's breaks (series, b, level) cut, with the one they are cut from.

    Level 0 is the whole series, without a parent. An interval that a level leaves whole has no row there.
    """
    levels = breaks.groupBy("series").agg(F.sort_array(F.collect_set("level")).alias("_levels"))
    top = lengths.select("series", F.lit(0).alias("level"), F.lit(0).cast("long").alias("lo"), F.col("n").cast("long").alias("hi"))
    # each break is an edge at its own level and all below
    cuts = breaks.join(levels, "series").select("series", "b", F.explode(F.filter("_levels", lambda x: x >= F.col("level"))).alias("level"))
    zero = levels.select("series", F.lit(0).cast("long").alias("b"), F.explode("_levels").alias("level"))
    w = Window.partitionBy("series", "level").orderBy("b")
    own = cuts.select("series", "b", "level").union(zero.select("series", "b", "level")).distinct().join(lengths, "series")
    own = top.union(own.select("series", "level", F.col("b").alias("lo"), F.coalesce(F.lead("b").over(w), F.col("n")).cast("long").alias("hi")))
    # an interval's first level is where it was cut; its parent is the interval that began at or before it one level up
    fresh = own.groupBy("series", "lo", "hi").agg(F.min("level").alias("level"))
    up = fresh.select("series", F.col("lo").alias("parent_lo"), F.col("hi").alias("parent_hi"), F.col("level").alias("_up"))
    pairs = fresh.join(up, "series", "left").where("_up is null or (_up < level and parent_lo <= lo and hi <= parent_hi) or level = 0")
    near = pairs.groupBy("series", "level", "lo", "hi").agg(F.max_by(F.struct("parent_lo", "parent_hi"), F.when(F.col("_up") < F.col("level"), F.col("_up"))).alias("p"))
    return near.select("series", "level", "lo", "hi", F.when(F.col("level") > 0, F.col("p.parent_lo")).alias("parent_lo"), F.when(F.col("level") > 0, F.col("p.parent_hi")).alias("parent_hi"))
