"""Reading dated panels: files, tables and long rates; long panels are (series, date, t, value)."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import database


def read(spark: SparkSession, kind: str, path: str, **options) -> DataFrame:
    """A wide panel from ``parquet``, ``csv``, ``jdbc`` or a ``database`` file (``database.scan``), or the rows of an ``sql`` text over views; its time column becomes ``date``.

    ``date_column`` names it, ``start`` and ``end`` are inclusive, ``columns`` projects, a ``label`` column is left out unless
    ``labels`` keeps it; filters and projection are pushed to the scan. An SQL text must give a ``date``.
    """
    date_column, start, end, columns = (options.pop(k, None) for k in ("date_column", "start", "end", "columns"))
    labels = options.pop("labels", False)
    if kind == "parquet":
        df = spark.read.options(**options).parquet(path)
    elif kind == "csv":
        df = spark.read.options(header=True, inferSchema=True, **options).csv(path)
    elif kind == "jdbc":
        df = spark.read.options(**options).jdbc(options["url"], path)
    elif kind == "database":
        df = database.scan(spark, path, **options)
    elif kind == "sql":
        df = spark.sql(path, **options)
        if "date" not in df.columns:
            raise KeyError("the query gives no column 'date'")
    else:
        raise ValueError(f"unknown source {kind!r}")
    names = [date_column] if date_column else ["Date", "DATE", "index", "__index_level_0__"]
    for name in names:
        if name in df.columns and "date" not in df.columns:
            df = df.withColumnRenamed(name, "date")
    if "date" in df.columns:
        df = df.withColumn("date", F.expr("try_to_timestamp(cast(date as string))"))
    if not labels and "label" in df.columns and "label" not in (columns or []):
        df = df.drop("label")
    if missing := set(columns or []) - set(df.columns):
        raise KeyError(f"no columns {sorted(missing)}")
    if columns:
        df = df.select("date", *columns)
    if start is not None:
        df = df.where(F.col("date") >= F.lit(start).cast("timestamp"))
    if end is not None:
        df = df.where(F.col("date") <= F.lit(end).cast("timestamp"))
    return df


def rates_and_fx(rates: DataFrame, sources: list[str], tenors: list[str], fx: DataFrame | None = None, order: Column | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Wide rates by date with the day's last FX row beside them, rows with a null left out, in order of date; no rates at all are an error."""
    picked = wide_by_source(rates, sources, tenors, start, end, complete=False)
    if picked.isEmpty():
        raise LookupError("no rates for these sources and dates")
    if fx is not None:
        picked = join_fx(picked, fx, order)
    return picked.na.drop().orderBy("date")


def seeds(spark: SparkSession, spec) -> DataFrame | None:
    """A table of known regimes: none, a DataFrame, the path of a CSV file (as text or ``{"path": ...}``), or a list of records."""
    if spec is None or isinstance(spec, DataFrame):
        return spec
    if isinstance(spec, dict):
        spec = spec["path"]
    if isinstance(spec, str):
        return spark.read.csv(spec, header=True, inferSchema=True)
    return spark.createDataFrame(list(spec)) if spec else None


def substituted(text: str, **values: str) -> str:
    """A configuration's text with ``${NAME}`` replaced; a name without a value is an error."""
    return re.sub(r"\$\{(\w+)\}", lambda m: str(values[m[1]]), text)


def long_panel(rows: DataFrame, series: Column, date: Column, value: Column) -> DataFrame:
    """One value a series and date, with ``t``, the place of the date in its series."""
    out = rows.groupBy(series.alias("series"), date.alias("date")).agg(value.alias("value"))
    return out.withColumn("t", F.row_number().over(Window.partitionBy("series").orderBy("date")) - 1)


def wide_by_source(rates: DataFrame, sources: list[str], tenors: list[str], start: str | None = None, end: str | None = None, complete: bool = True) -> DataFrame:
    """Long rates (date, source, tenors) to one row a date with ``SOURCE_TENOR`` columns; if ``complete``, rows with a null are dropped."""
    rows = rates.where(F.col("source").isin(sources))
    if start:
        rows = rows.where(F.col("date") >= F.lit(start).cast("date"))
    if end:
        rows = rows.where(F.col("date") <= F.lit(end).cast("date"))
    picked = rows.groupBy("date").pivot("source", sources).agg(*(F.first(t, ignorenulls=True).alias(t) for t in tenors))
    return picked.na.drop() if complete else picked


def join_fx(panel: DataFrame, fx: DataFrame, order: Column) -> DataFrame:
    """Left join of one row a date, the last by ``order``."""
    last = fx.withColumn("_r", F.row_number().over(Window.partitionBy("date").orderBy(order.desc()))).where("_r = 1").drop("_r")
    return panel.join(last, "date", "left")


def coverage(prices: DataFrame, *keys: str) -> DataFrame:
    return prices.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("date").alias("days"), F.min("date").alias("first"), F.max("date").alias("last"))


def business_days(spark: SparkSession, start: str, days: int) -> DataFrame:
    """The next ``days`` weekdays from ``start``, with their place."""
    every = spark.range(days * 2 + 7).select(F.date_add(F.lit(start).cast("date"), F.col("id").cast("int")).alias("date"))
    week = every.where(~F.dayofweek("date").isin(1, 7))
    return week.withColumn("t", F.row_number().over(Window.orderBy("date")) - 1).where(F.col("t") < days)


def synthetic(spark: SparkSession, lengths: list[int], features: int = 4, seed: int = 42) -> DataFrame:
    """Planted regimes: (t, date, label, f0..), each regime with its own mean and volatility and a few jumps."""
    total, edges = sum(lengths), [sum(lengths[:k]) for k in range(len(lengths))]
    df = spark.range(total).withColumnRenamed("id", "t")
    label = reduce(lambda c, k: F.when(F.col("t") >= edges[k], k).otherwise(c), range(1, len(lengths)), F.lit(0))
    df = df.withColumn("label", label).withColumn("date", F.date_add(F.lit("2000-01-01").cast("date"), F.col("t").cast("int")))
    draw = lambda k, what: F.pmod(F.xxhash64(F.lit(seed), F.lit(what), F.lit(k), F.col("label")), F.lit(1000)) / 1000.0
    for k in range(features):
        jump = F.when(F.rand(seed + 100 + k) < 0.05, F.randn(seed + 200 + k) * 1.5).otherwise(0.0)
        df = df.withColumn(f"f{k}", 1 + 7 * draw(k, "mean") + (0.05 + 0.35 * draw(k, "vol")) * F.randn(seed + k) + jump)
    return df
