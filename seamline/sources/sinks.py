"""What a run leaves behind: event lines and tables of breaks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_lines(breaks: DataFrame, run_id: str) -> DataFrame:
    """(series, line): a JSON object a break and, for each series, one that opens and one that closes the run. ``breaks``: (series, b, confirmed)."""
    name = F.when(F.col("confirmed"), "breakpoint_confirmed").otherwise("breakpoint_rejected")
    # what a run starts from: its series
    begun = breaks.select("series").distinct().select("series", F.to_json(F.struct(F.lit("run_started").alias("event"), F.lit(run_id).alias("run_id"), "series")).alias("line"))
    each = breaks.select("series", F.to_json(F.struct(name.alias("event"), F.lit(run_id).alias("run_id"), "series", F.col("b").alias("bkpt"))).alias("line"))
    count = lambda c: F.count_if(c)
    ends = breaks.groupBy("series").agg(count(F.col("confirmed")).alias("n_bkpts"), count(~F.col("confirmed")).alias("n_invalid"))
    last = F.to_json(F.struct(F.lit("run_complete").alias("event"), F.lit(run_id).alias("run_id"), "series", "n_bkpts", "n_invalid"))
    return begun.unionByName(each).unionByName(ends.select("series", last.alias("line")))


def write_events(breaks: DataFrame, run_id: str, path: str, append: bool = True) -> None:
    event_lines(breaks, run_id).select("line").write.mode("append" if append else "overwrite").text(path)


def break_table(breaks: DataFrame, bands: DataFrame, tolerance: int, length: DataFrame) -> DataFrame:
    """Breaks with their interval, its width, and whether that is wider than three tolerances and a fiftieth of the series' length."""
    out = breaks.join(bands, ["series", "b"], "left").join(length, "series").withColumn("width", F.col("hi") - F.col("lo"))
    return out.withColumn("low_confidence", F.col("width") > F.greatest(F.lit(3.0 * tolerance), 0.02 * F.col("n"))).drop("n")


def meta_table(spark: SparkSession, **facts) -> DataFrame:
    """(key, value): what a run was, as text."""
    return spark.createDataFrame([(k, str(v)) for k, v in sorted(facts.items())], "key string, value string")


def write_workbook(folder: str, breaks: DataFrame, bands: DataFrame, support: DataFrame, meta: DataFrame) -> None:
    """A folder a sheet, CSV with a header: ``breakpoints``, ``ci``, ``panel_support`` and ``meta``."""
    for name, sheet in (("breakpoints", breaks), ("ci", bands.withColumn("width", F.col("hi") - F.col("lo"))), ("panel_support", support), ("meta", meta)):
        write_report(sheet, f"{folder}/{name}")


def write_report(rows: DataFrame, path: str) -> None:
    """A table as CSV with a header, for instance a persistence or stability report."""
    rows.write.mode("overwrite").option("header", True).csv(path)


def performance_rows(scores: DataFrame, run_id: str, **knobs) -> DataFrame:
    """Scores of a run (series, ...) as rows (run_id, knobs, series, metric, value), to be appended to a table of results."""
    metrics = [c for c in scores.columns if c != "series"]
    long = scores.select("series", *(F.col(c).cast("double").alias(c) for c in metrics)).unpivot(["series"], metrics, "metric", "value")
    return long.select(F.lit(run_id).alias("run_id"), F.lit(json.dumps(knobs, sort_keys=True)).alias("knobs"), "series", "metric", "value")


def hierarchy_lines(tree: DataFrame) -> DataFrame:
    """(series, level, lo, line): an interval tree as indented lines."""
    line = F.concat(F.repeat(F.lit("  "), F.col("level")), F.lit("["), F.col("lo").cast("string"), F.lit(","), F.col("hi").cast("string"), F.lit(")"))
    return tree.select("series", "level", "lo", line.alias("line"))
