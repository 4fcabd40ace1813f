"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations alone.

Token counts are summed into cells, one for each combination of the dimensions'
values. Each sweep rakes the cells' weights to one dimension's target shares after another.
A document of a cell is then kept with the probability that brings the
expected tokens of the cells to their raked shares of the budget.
"""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, free_name

NONE = "(none)"


def words(text: Column) -> Column:
    """Runs of characters between white space; a stand-in for tokens that needs no vocabulary."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r\f]+")), F.lit(0))


def uniform(key: Column, seed: str) -> Column:
    """A number in [0, 1) that ``key`` decides: the first 52 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), key.cast("string"))), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def register(text: Column) -> Column:
    """A topic where no table names one: the form of the text, told from its signs and length."""
    n = F.length(text)
    signs = lambda pattern: n - F.length(F.regexp_replace(text, pattern, ""))
    return (
        F.when(text.isNull() | (n == 0), "empty")
        .when(signs(r"\|") * 100 >= n, "table")
        .when(signs("[A-Z]") * 2 >= n, "shouting")
        .when(signs("[0-9]") * 10 >= n, "figures")
        .when(n < 600, "brief")
        .when(n < 4000, "article")
        .otherwise("long")
    )


def tempered(cells: DataFrame, dim: str, power: float) -> DataFrame:
    """Target shares of one dimension in proportion to a power of its tokens; 1 leaves them, 0 evens them out."""
    own = cells.groupBy(F.col(dim).alias("value")).agg(F.sum("tokens").alias("tokens")).where("tokens > 0")
    return own.select("value", F.pow(F.col("tokens").cast("double"), F.lit(float(power))).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], tolerance: float = 1e-9, most: int = 200, few: int = 10_000) -> DataFrame:
    """``cells`` (dimensions, tokens) with ``weight``: raked token shares, summing to 1.

    ``targets`` gives for each dimension (value, target); targets need not sum to 1.
    A value without a target, or with one of 0 or null, gets weight 0. Sweeps go on until no dimension's
    shares are off their targets by more than ``tolerance`` (relative); targets that no weights can meet, as some
    combinations are empty, end after ``most`` sweeps with a warning that tells the error. Cells are one a
    combination of values, whatever the number of documents; up to ``few`` of them lie in one partition, so that a
    sweep deals none of them out anew, and more are dealt out by each dimension in turn.
    """
    out = cells
    for dim, t in targets.items():
        t = t.groupBy("value").agg(F.max("target").alias("target")).where("target > 0")
        out = out.join(t.select(F.col("value").alias(dim), F.col("target").alias(f"_t_{dim}")), dim, "left")
    some = [f"coalesce(_t_{d}, 0) > 0" for d in targets]
    out = out.withColumn("weight", F.when(F.expr(" and ".join(some or ["true"])) & (F.col("tokens") > 0), F.col("tokens").cast("double")).otherwise(0.0))
    out, error = cut(out, "cells"), 1.0
    near = (lambda df: df.coalesce(1)) if out.count() <= few else (lambda df: df)
    out = near(out)
    for k in range(most):
        for dim in targets:
            now = F.sum("weight").over(Window.partitionBy(dim))
            out = out.withColumn("weight", F.when(now > 0, F.col("weight") * F.col(f"_t_{dim}") / now).otherwise(0.0))
        if k % 6 == 5 or k + 1 == most:
            out = near(cut(out, "cells"))
            shares = (out.groupBy(d).agg((F.sum("weight") / F.max(f"_t_{d}")).alias("r")).where("r > 0").agg((F.max("r") / F.min("r") - 1).alias("e")) for d in targets)
            error = reduce(DataFrame.union, shares).agg(F.max("e")).first()[0] or 0.0 if targets else 0.0
            if error <= tolerance:
                break
    if error > tolerance:
        warnings.warn(f"raking ends with marginals off by up to {error:.3g}", stacklevel=2)
    total = out.agg(F.sum("weight")).first()[0] or 1.0
    return cut(out.withColumn("weight", F.col("weight") / F.lit(total)).select(*cells.columns, "weight"), "cells")


def calibrate(cells: DataFrame, share: float) -> DataFrame:
    """Add each cell's ``probability``: expected tokens follow ``weight`` and sum to ``share`` of all tokens.

    No probability passes 1; what a full cell can't give, the others make up for in proportion. Each round finds the
    cells that the present scale fills, until there are no more of them. If all cells of any weight are full,
    the sum stays below the share.
    """
    w, n = F.col("weight"), F.col("tokens")
    budget, scale = share * (cells.agg(F.sum(n)).first()[0] or 0), 0.0
    full = lambda: (w * F.lit(scale) >= n) & (n > 0) & (w > 0)
    while True:
        used, rest = cells.agg(F.coalesce(F.sum(F.when(full(), n)), F.lit(0)), F.coalesce(F.sum(F.when(~full(), w)), F.lit(0.0))).first()
        new = max(0.0, budget - used) / rest if rest > 0 else scale
        if new <= scale:
            break
        scale = new
    return cells.withColumn("probability", F.when(full(), 1.0).when(n > 0, F.least(F.lit(1.0), w * F.lit(scale) / n)).otherwise(0.0))


def mix(docs: DataFrame, dims: dict[str, Column], tokens: Column, targets: dict[str, DataFrame] | dict[str, float], share: float, key: Column, seed: str = "mix", **how) -> DataFrame:
    """``docs`` with ``mix_weight`` (of its cell), ``mix_probability`` and ``mix_keep``.

    ``dims`` names columns to rake, ``targets`` gives each a table (value, target) or the power
    of its own tokens (``tempered``). A null value is a value like any other, ``(none)``; a document without a token has
    probability 0 if its cell has none. The key alone decides a draw, so repeated rows are kept or dropped together, and
    a null key draws like any other. The three columns replace any of the same name, all others stay, whatever
    their names. An empty table gives no row.
    """
    names = [free_name(docs, f"_dim_{d}") for d in dims]
    count = free_name(docs, "_tokens")
    keyed = docs.withColumns({n: F.coalesce(c.cast("string"), F.lit(NONE)) for n, c in zip(names, dims.values(), strict=True)} | {count: tokens.cast("long")})
    cells = cut(keyed.groupBy(*names).agg(F.sum(count).alias("tokens")), "cells")
    want = {n: t if isinstance(t, DataFrame) else tempered(cells, n, t) for n, t in zip(names, (targets[d] for d in dims), strict=True)}
    told = cut(calibrate(rake(cells, want, **how), share), "told")
    told = told.select(*names, F.col("weight").alias("mix_weight"), F.col("probability").alias("mix_probability"))
    kept = keyed.drop("mix_weight", "mix_probability", "mix_keep", count)
    # the cells are as many as combinations of values, not documents; Spark sees their size, written above
    out = kept.join(told, names, "left").drop(*names)
    return out.withColumn("mix_keep", uniform(F.coalesce(key.cast("string"), F.lit(NONE)), seed) < F.col("mix_probability"))
