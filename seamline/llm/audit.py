"""How filters act together: what each removes, alone and after the others, and its fair share of all that goes.

Every row has a mask of the filters that it fails, and rows are counted by part, mask and tallies, so that all further work is on
a small table of counts. From it come the removals of every coalition of filters. A filter's step in an order removes the
difference of two coalitions; its Shapley value is the solution of least squares over all coalitions, weighted by the Shapley
kernel and bound to share out what all filters remove, solved exactly in rationals.
"""

from __future__ import annotations

from fractions import Fraction
from functools import cache
from itertools import permutations
from math import comb, factorial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def words(text: Column) -> Column:
    """The words of a text: what stands between spaces, tabs and line breaks."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions of a text alone: few words, repeated words, capitals, signs of tables and code."""
    text, own = F.coalesce(text, F.lit("")), words(text)
    return {
        "A": F.size(own) < 100,
        "B": 100 * F.size(F.array_distinct(own)) < 80 * F.size(own),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def counted(rows: DataFrame, key: Column, text: Column, part: Column, filters: dict[str, Column], tallies: DataFrame | None = None, copies: str | None = None) -> DataFrame:
    """(part, mask, a column for each tally, n): the rows by part and failed filters; filter k has the bit 2 ** k, and ``copies`` names one more, the last.

    ``tallies`` has a column ``key`` and flags; a row has a flag if any row of its key has it. A row fails ``copies`` if its text is that of
    a row with a smaller key. A null text is an empty one, a null part the empty string; a row without a key has no flags, is no copy and has none.
    Keys that repeat with one text are no copies of each other. Texts are read once and do not move: their place is taken by a SHA-256.
    """
    bits = sum((F.when(fails, F.lit(1 << k)).otherwise(F.lit(0)) for k, fails in enumerate(filters.values())), F.lit(0))
    told = rows.select(key.alias("key"), F.coalesce(part.cast("string"), F.lit("")).alias("part"), bits.alias("mask"), F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256).alias("same"))
    flags = [] if tallies is None else [c for c in tallies.columns if c != "key"]
    if flags:
        # rows without a key find no partner; the second column only spreads them
        own = tallies.where("key is not null").groupBy("key").agg(*(F.max(F.coalesce(F.col(c), F.lit(False))).alias(c) for c in flags)).withColumn("_spread", F.lit(""))
        spread = F.when(F.col("key").isNull(), F.col("same")).otherwise(F.lit(""))
        told = told.withColumn("_spread", spread).join(own, ["key", "_spread"], "left").drop("_spread").fillna(False, flags)
    by = ["part", "mask", *flags]
    if copies is None:
        return told.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    # rows of one key and text first, so that a text's smallest key comes with the number of its rows; a large group of copies shrinks before it moves
    told = told.groupBy("same", "key", *by).agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.when(F.col("key").isNotNull(), F.struct("key", "n")))
    texts = told.groupBy("same", *by).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("key").isNull(), F.col("n")).otherwise(0)).alias("free"), first.alias("first"))
    least = F.min("first.key").over(Window.partitionBy("same"))
    texts = texts.withColumn("own", F.col("free") + F.when(F.col("first.key") == least, F.col("first.n")).otherwise(0))
    bit = 1 << len(filters)
    halves = F.array(F.struct(F.col("mask").alias("mask"), F.col("own").alias("n")), F.struct((F.col("mask") + bit).alias("mask"), (F.col("n") - F.col("own")).alias("n")))
    out = texts.select("part", *flags, F.explode(halves).alias("half")).select("part", *flags, F.col("half.mask").alias("mask"), F.col("half.n").alias("n"))
    return out.where("n > 0").groupBy(by).agg(F.sum("n").alias("n"))


@cache
def _inverse(n: int) -> list[list[Fraction]]:
    """Of the normal equations' matrix for ``n`` filters, with a last row and column for the sum of all shares."""
    kernel = {s: Fraction(n - 1, comb(n, s) * s * (n - s)) for s in range(1, n)}
    a = [[Fraction(i == j) for j in range(2 * n + 2)] for i in range(n + 1)]
    for row in a:
        row[: n + 1] = [Fraction(0)] * (n + 1)
    for s in range(1, 1 << n):
        for i in range(n):
            for j in range(n):
                if s >> i & s >> j & 1 and s.bit_count() < n:
                    a[i][j] += kernel[s.bit_count()]
    for i in range(n):
        a[i][n] = a[n][i] = Fraction(1)
    for i in range(n + 1):
        a[i][n + 1 + i] = Fraction(1)
    for c in range(n + 1):
        p = next(r for r in range(c, n + 1) if a[r][c])
        a[c], a[p] = a[p], [x for x in a[c]]
        a[c] = [x / a[c][c] for x in a[c]]
        for r in range(n + 1):
            if r != c and a[r][c]:
                a[r] = [x - a[r][c] * y for x, y in zip(a[r], a[c], strict=True)]
    return [row[n + 1 :] for row in a]


def shares(removed: list[int]) -> list[Fraction]:
    """Shapley values of the filters, from the removals of every coalition (by mask, from none to all)."""
    n = len(removed).bit_length() - 1
    if n == 1:
        return [Fraction(removed[1])]
    right = [Fraction(0)] * n + [Fraction(removed[-1])]
    for s in range(1, len(removed) - 1):
        size = s.bit_count()
        w = Fraction(n - 1, comb(n, size) * size * (n - size)) * removed[s]
        for i in range(n):
            if s >> i & 1:
                right[i] += w
    return [sum((a * b for a, b in zip(row, right, strict=True)), Fraction(0)) for row in _inverse(n)[:n]]


def coalitions(counts: dict[int, int], n: int) -> list[int]:
    """Rows removed by every coalition: those whose mask meets it. ``counts`` has rows by mask."""
    return [sum(c for mask, c in counts.items() if mask & s) for s in range(1 << n)]


def steps(counts: DataFrame, letters: str, tallies: list[str]) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, a lost_ column for each tally, shapley) for every part, order and step.

    ``counts`` is what ``counted`` gives, with a letter for each bit. ``shapley`` is a filter's share summed over all orders, thus an integer. A
    part's counts are at most 2 ** (filters + tallies) rows, whatever the input; no parts, no rows.
    """
    n = len(letters)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        gone = {name: coalitions((pdf["n"] * pdf[name] if name else pdf["n"]).groupby(pdf["mask"]).sum().to_dict(), n) for name in ["", *tallies]}
        every, rows = (1 << n) - 1, []
        alone = [gone[""][every] - gone[""][every & ~(1 << k)] for k in range(n)]
        fair = [int(x * factorial(n)) for x in shares(gone[""])]
        total = int(pdf["n"].sum())
        for order in permutations(range(n)):
            had = 0
            for step, k in enumerate(order, 1):
                has = had | 1 << k
                removed = {name: v[has] - v[had] for name, v in gone.items()}
                rows.append((pdf["part"].iat[0], "".join(letters[i] for i in order), step, total - gone[""][has], removed[""], gone[""][1 << k] - removed[""], alone[k], *(removed[t] for t in tallies), fair[k]))
                had = has
        return pd.DataFrame(rows, columns=names)

    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", *(f"lost_{t}" for t in tallies), "shapley"]
    kinds = {"part": "string", "filter_order": "string", "step": "int"}
    return counts.groupBy("part").applyInPandas(run, ", ".join(f"{c} {kinds.get(c, 'long')}" for c in names))
