"""Breaks in streams: event-time buckets with watermarks, and a segmentation that grows with each step.

A step segments the series up to its present end, or a trailing window, and settles the result with the breaks held so far: those
well behind the end are locked. ``replay`` runs all steps of a stored panel in one plan, as no step's
segmentation needs another's; only the settling of the few breaks goes in order. ``follow`` runs a step for each batch of a stream.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.segmentation import segment
from ..sources.scratch import written


def buckets(events: DataFrame, ts: str, series: str, value: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Tumbling means of a stream or table: (series, date, value); rows later than the watermark are dropped by a stream."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return rows.groupBy(F.window(ts, width).alias("w"), F.col(series).alias("series")).agg(F.avg(value).alias("value")).select("series", F.col("w.start").alias("date"), "value")


def merged(breaks: list[int], tolerance: int) -> list[int]:
    """In order, a break within ``tolerance`` of the last one takes its place."""
    out: list[int] = []
    for b in sorted(set(breaks)):
        if out and b - out[-1] <= tolerance:
            out.pop()
        out.append(b)
    return out


def locked(confirmed: list[int], proposed: list[int], t_end: int, step: int, tolerance: int) -> list[int]:
    """Breaks before the frontier, two steps behind the end, stay; proposals before it give way to those near them.

    From the frontier on proposals alone count. Where two are near each other, the later one stays.
    """
    frontier = max(0, t_end - 2 * step)
    kept = [b for b in confirmed if b < frontier]
    new = [b for b in proposed if b >= frontier or all(abs(b - k) > tolerance for k in kept)]
    return merged(kept + new, tolerance)


def replay(panel: DataFrame, step: int = 80, history: int = 200, mode: str = "expanding", window: int = 250, lock: bool = True, tolerance: int = 5, columns: list[str] | None = None, **knobs) -> DataFrame:
    """(series, t_end, b): the breaks held after each step, from ``history`` rows on to the end of each series.

    ``expanding`` looks at all rows so far, ``rolling`` at the last ``window``. All steps are segments of one segmentation; the settling of
    a series' breaks, as few as steps times breaks, is one small group.
    """
    if mode not in ("expanding", "rolling"):
        raise ValueError(f"unknown mode {mode!r}")
    first = max(step, history)
    n = panel.groupBy("series").agg(F.count(F.lit(1)).alias("n"))
    ends = F.array_distinct(F.concat(F.when(F.col("n") > first, F.sequence(F.lit(first).cast("long"), F.col("n"), F.lit(step).cast("long"))).otherwise(F.array()), F.array("n")))
    steps = written(n.select("series", F.explode(ends).alias("hi")), "steps")
    lo = F.lit(0).cast("long") if mode == "expanding" else F.greatest(F.lit(0), F.col("hi") - max(first, window)).cast("long")
    spans = steps.select("series", F.col("hi").cast("string").alias("span"), lo.alias("lo"), "hi")
    found = segment(panel, columns, {"base": knobs}, spans).where("status = 'valid'").select("series", F.col("run").cast("long").alias("t_end"), "b")
    every = steps.select("series", F.col("hi").alias("t_end")).join(found, ["series", "t_end"], "left")

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        held, rows = [], []
        for t_end, own in pdf.groupby("t_end"):
            new = [int(b) for b in own["b"].dropna()]
            held = locked(held, new, int(t_end), step, tolerance) if lock and held else merged(new, tolerance)
            rows += [(pdf["series"].iat[0], t_end, b) for b in held]
        return pd.DataFrame(rows, columns=["series", "t_end", "b"])

    kind = panel.schema["series"].dataType.simpleString()
    return every.groupBy("series").applyInPandas(settle, f"series {kind}, t_end long, b long")


def advance(panel: DataFrame, held: DataFrame, step: int = 80, lock: bool = True, tolerance: int = 5, **knobs) -> DataFrame:
    """One step: (series, b) after all rows of ``panel`` have come, given those held before (series, b)."""
    found = segment(panel, configs={"base": knobs}).where("status = 'valid'").select("series", "b", F.lit(True).alias("new"))
    n = panel.groupBy("series").agg(F.count(F.lit(1)).alias("n"))
    every = n.join(found.union(held.select("series", "b", F.lit(False))), "series")

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        old, new = pdf.loc[~pdf["new"], "b"].tolist(), pdf.loc[pdf["new"], "b"].tolist()
        out = locked(old, new, int(pdf["n"].iat[0]), step, tolerance) if lock and old else merged(new, tolerance)
        return pd.DataFrame({"series": pdf["series"].iat[0], "b": pd.Series(out, dtype="int64")})

    kind = panel.schema["series"].dataType.simpleString()
    return every.groupBy("series").applyInPandas(settle, f"series {kind}, b long")


def follow(stream: DataFrame, folder: str, checkpoint: str, **knobs):
    """Append each batch of a stream (series, date, value) to the rows in ``folder`` and take one step over all of them.

    ``folder``/rows holds the batches, each under its number, so a batch that runs again replaces its own; ``folder``/breaks the state (batch, series,
    b) after each. A bucket that comes again counts with its latest mean.
    """
    spark = stream.sparkSession
    empty = spark.createDataFrame([], "series string, b long")

    def take(rows: DataFrame, batch: int) -> None:
        rows.select("series", "date", "value").write.mode("overwrite").parquet(f"{folder}/rows/batch={batch}")
        every = spark.read.parquet(f"{folder}/rows").groupBy("series", "date").agg(F.max_by("value", "batch").alias("value"))
        panel = every.withColumn("t", F.row_number().over(Window.partitionBy("series").orderBy("date")) - 1)
        held = spark.read.parquet(f"{folder}/breaks/batch={batch - 1}") if batch else empty
        advance(written(panel, "panel"), held, **knobs).write.mode("overwrite").parquet(f"{folder}/breaks/batch={batch}")

    return each_batch(take, stream, checkpoint)


def sessions(events: DataFrame, ts: str, user: str, gap: str = "30 minutes") -> DataFrame:
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    by = rows.groupBy(F.col(user).alias("series"), F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("rows"))
    return by.select("series", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "rows")


def each_batch(step: Callable[[DataFrame, int], None], stream: DataFrame, checkpoint: str, mode: str = "append"):
    """Run ``step`` on every batch of a stream until its present end."""
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
