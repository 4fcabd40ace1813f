"""Row and column operators on panels."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ensure_date(df: DataFrame, order: Column | None = None) -> DataFrame:
    """Parse ``date`` leniently; without one, give daily dates from 2000-01-01 in ``order``."""
    if "date" in df.columns:
        return df.withColumn("date", F.expr("try_to_timestamp(cast(date as string))"))
    place = F.row_number().over(Window.orderBy(order if order is not None else F.monotonically_increasing_id()))
    return df.withColumn("date", F.date_add(F.lit("2000-01-01").cast("date"), place - 1).cast("timestamp"))


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in ("date", "t", "series", "label")]


def finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose columns are neither null nor NaN nor infinite.

    One test over an array of them: a condition for each column makes the optimiser derive as many more for each that is an expression.
    """
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return df.where(F.forall(F.array(*(F.col(c).cast("double") for c in columns)), ok))


def slice_rows(df: DataFrame, start: int, end: int) -> DataFrame:
    return df.where((F.col("t") >= max(0, start)) & (F.col("t") < end))


def stride(df: DataFrame, step: int) -> DataFrame:
    return df.where(F.col("t") % step == 0)


def to_long(df: DataFrame, columns: list[str], ids: tuple[str, ...] = ("date",)) -> DataFrame:
    return df.unpivot(list(ids), columns, "series", "value")


def to_wide(df: DataFrame, values: list[str]) -> DataFrame:
    return df.groupBy("date").pivot("series", values).agg(F.first("value"))


def top_per_group(df: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)


def row_of_date(panel: DataFrame, dates: DataFrame) -> DataFrame:
    """First ``t`` of each series on each asked day."""
    return panel.join(F.broadcast(dates) if dates.isLocal() else dates, F.to_date(panel["date"]) == dates["day"]).groupBy("series", "day").agg(F.min("t").alias("t"))


def clean_names(names: list[str]) -> list[str]:
    """Dots become underscores, repeats get a number."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        n = re.sub(r"\.", "_", n)
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return out


def sorted_rows(df: DataFrame, *columns: str) -> DataFrame:
    """By date, then the given columns."""
    return df.orderBy("date", *columns)


def stacked(parts: list[DataFrame]) -> DataFrame:
    """The rows of all parts; columns that one lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def curves_of(wide: DataFrame, sources: list[str]) -> DataFrame:
    """(date, source, tenors) from columns ``SOURCE_TENOR``: a row a source, tenors that a source lacks are null."""
    own = lambda s: [c for c in wide.columns if c.startswith(f"{s}_")]
    return stacked([wide.select("date", F.lit(s).alias("source"), *(F.col(c).alias(c[len(s) + 1 :]) for c in own(s))) for s in sources if own(s)])


def matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(t, date, x): the columns as one array beside their row and date, so that dates stay with what is made of it."""
    return df.select("t", "date", F.array(*(F.col(c).cast("double") for c in columns)).alias("x"))


def from_matrix(rows: DataFrame, names: list[str]) -> DataFrame:
    return rows.select("t", "date", *(F.get("x", F.lit(i)).alias(n) for i, n in enumerate(names)))


def thinned(panel: DataFrame, most: int) -> DataFrame:
    """Every k-th row of each series, k the least that leaves at most ``most``."""
    n = F.count(F.lit(1)).over(Window.partitionBy("series"))
    return panel.withColumn("_n", n).where(F.col("t") % F.greatest(F.lit(1), F.ceil(F.col("_n") / most)) == 0).drop("_n")


def spread_over(rows: DataFrame, most: int, order: str = "b") -> DataFrame:
    """At most ``most`` rows of each series, evenly spaced in their order, the first and the last among them."""
    w = Window.partitionBy("series")
    placed = rows.withColumns({"_k": F.row_number().over(w.orderBy(order)) - 1, "_n": F.count(F.lit(1)).over(w)})
    # row k is taken if some i of 0 .. most - 1 has floor(i (n - 1) / (most - 1)) = k
    i = F.ceil(F.col("_k") * (most - 1) / F.greatest(F.lit(1), F.col("_n") - 1))
    taken = (F.col("_n") <= most) | (F.floor(i * (F.col("_n") - 1) / (most - 1)) == F.col("_k"))
    return placed.where(taken).drop("_k", "_n")
