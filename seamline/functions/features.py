"""Features of rate panels, as column expressions."""

from __future__ import annotations

import importlib
import math
import re
from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.frames import ensure_date, feature_columns, finite

_RATE = re.compile(r"^([A-Z]{3})_(Y(\d+)p(\d+))$")


def rate_columns(columns: list[str]) -> dict[str, list[tuple[float, str, str]]]:
    """Source to its (years, tenor, column), by years."""
    out: dict[str, list[tuple[float, str, str]]] = {}
    for c in columns:
        if m := _RATE.match(c):
            out.setdefault(m[1], []).append((float(f"{int(m[3])}.{m[4]}"), m[2], c))
    return {s: sorted(v) for s, v in out.items()}


def spreads(columns: list[str]) -> dict[str, Column]:
    """Short less long, for each pair of a source's tenors."""
    return {f"{a}_minus_{b}": F.col(a) - F.col(b) for own in rate_columns(columns).values() for (_, _, a), (_, _, b) in combinations(own, 2)}


def butterflies(columns: list[str]) -> dict[str, Column]:
    """Twice the middle less both ends, for each three tenors in a row."""
    out = {}
    for own in rate_columns(columns).values():
        for (_, _, a), (_, _, m), (_, _, b) in zip(own, own[1:], own[2:]):
            out[f"fly_{a}_{m}_{b}"] = 2 * F.col(m) - F.col(a) - F.col(b)
    return out


def cross_spreads(columns: list[str]) -> dict[str, Column]:
    """Between each two sources, on the tenors they share."""
    by = rate_columns(columns)
    out = {}
    for a, b in combinations(sorted(by), 2):
        mine, other = ({t: c for _, t, c in by[s]} for s in (a, b))
        for t in sorted(set(mine) & set(other)):
            out[f"{a}_{b}_{t}_spd"] = F.col(mine[t]) - F.col(other[t])
    return out


def trailing(window: int, series: str = "series") -> Window:
    return Window.partitionBy(series).orderBy("t").rowsBetween(1 - window, 0)


def rolling(value: Column, window: int, how=F.stddev_samp, least: int | None = None) -> Column:
    """A statistic of the last ``window`` rows, null until ``least`` of them have a value."""
    w = trailing(window)
    return F.when(F.count(value).over(w) >= (least or window), how(value).over(w))


def rolling_corr(a: Column, b: Column, window: int) -> Column:
    """Correlation over the last ``window`` rows, null until all of them have both values, and where a column does not move."""
    w = trailing(window)
    both = F.when(a.isNotNull() & b.isNotNull(), 1)
    spread = F.stddev_samp(F.when(both == 1, a)).over(w) * F.stddev_samp(F.when(both == 1, b)).over(w)
    return F.when(F.count(both).over(w) >= window, F.try_divide(F.covar_samp(a, b).over(w), spread))


def filled(value: Column, series: str = "series") -> Column:
    """Gaps take the last value before them; those at the start the first after."""
    w = Window.partitionBy(series).orderBy("t")
    before = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return F.coalesce(before, F.first(value, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))


def ewma(panel: DataFrame, span: float, column: str = "value", out: str = "ewma", adjust: bool = False, least: int = 1, block: int = 64) -> DataFrame:
    """Add ``ewma``: y = (1 - a) y' + a x with a = 2 / (span + 1), each series from its first value; null for the first ``least - 1`` rows.

    ``adjust`` divides the sum of the rows so far, each counting 1 - a times the one after, by its weights. Rows are summed within
    blocks in closed form; the blocks' ends, a row for each ``block`` rows, carry on in the same way, block upon block, so no series is
    ever held whole. Needs ``t`` without gaps from 0 and no null values.
    """
    a, w = 2.0 / (span + 1), Window.partitionBy("series").orderBy("t")
    place, q = F.row_number().over(w) - 1, 1 - a
    own = panel.withColumn("_k", place)
    # the start counts in full, as if rows of its value went before; adjusted sums have no start
    term = F.col(column) * a if adjust else F.when(F.col("_k") == 0, F.col(column)).otherwise(F.col(column) * a)
    sums = _decayed(own.select("series", F.col("_k").alias("k"), term.alias("x")), q, block)
    joined = own.join(sums.withColumnRenamed("k", "_k"), ["series", "_k"])
    y = F.col("y") / (1 - F.pow(F.lit(q), F.col("_k") + 1)) if adjust else F.col("y")
    return joined.withColumn(out, F.when(F.col("_k") + 1 >= least, y)).drop("_k", "y")


def _decayed(rows: DataFrame, q: float, block: int) -> DataFrame:
    """(series, k, y) with y(k) = q y(k-1) + x(k), for rows (series, k, x) with k from 0."""
    if q < 1e-60:  # what came before is beyond the digits of a double
        return rows.select("series", "k", F.col("x").alias("y"))
    block = max(2, min(block, int(400 / -math.log(q)) + 1))
    n, w = F.floor(F.col("k") / block), Window.partitionBy("series", "_b").orderBy("k")
    own = rows.withColumns({"_b": n, "_i": F.col("k") % block})
    # within a block powers stay finite: x counts q^-(i), the sum q^i
    local = F.pow(F.lit(q), F.col("_i")) * F.sum(F.col("x") * F.pow(F.lit(q), -F.col("_i"))).over(w)
    own = own.withColumn("_y", local)
    if rows.agg(F.max("k")).first()[0] in (None, *range(block)):
        return own.select("series", "k", F.col("_y").alias("y"))
    ends = own.where(F.col("_i") == block - 1).select("series", F.col("_b").alias("k"), F.col("_y").alias("x"))
    carried = _decayed(ends, q**block, block).select("series", (F.col("k") + 1).alias("_b"), F.col("y").alias("_c"))
    return own.join(carried, ["series", "_b"], "left").select("series", "k", (F.col("_y") + F.coalesce("_c", F.lit(0.0)) * F.pow(F.lit(q), F.col("_i") + 1)).alias("y"))


def expression(text: str) -> Column:
    """``2*{USA:Y010p0} - {USA:Y002p0}``: references become columns ``USA_Y010p0``; the rest is arithmetic."""
    plain = re.sub(r"\{(\w+):(\w+)\}", r"`\1_\2`", text)
    if not re.fullmatch(r"[\s\d.+\-*/()`\w]*", plain):
        raise ValueError(f"not an expression of columns: {text!r}")
    return F.expr(plain)


def loadings(years: list[float], decay: float) -> list[list[float]]:
    """Level, slope and curvature of each maturity in years: 1, (1 - e^-x) / x, and that less e^-x, with x = decay * years."""
    out = []
    for y in years:
        x = decay * y
        slope = 1 - x / 2 if abs(x) < 1e-8 else (1 - math.exp(-x)) / x
        out.append([1.0, slope, slope - math.exp(-x)])
    return out


def nelson_siegel(years: list[float], decay: float = 0.0609) -> list[list[float]]:
    """The constant 3 x n matrix that turns a curve into level, slope and curvature by least squares."""
    import numpy as np

    if len(years) < 3:
        raise ValueError("a curve needs three maturities")
    return np.linalg.pinv(np.array(loadings(years, decay))).tolist()


def column_groups(columns: list[str]) -> dict[str, list[str]]:
    """Rate columns by source and by tenor, then all of them: the groups a panel is segmented by."""
    groups: dict[str, list[str]] = {}
    for part, name in ((0, "source"), (1, "tenor")):
        for c in columns:
            if "_" in c:
                groups.setdefault(f"{name} {c.split('_', 1)[part]}", []).append(c)
    return groups | {"all": list(columns)}


def panel_groups(columns: list[str], explicit: list[list[str]] | None = None, by: str = "source") -> dict[str, list[str]]:
    """Groups of columns for a joint segmentation: those given, else by source or tenor, else two halves, else all."""
    if explicit:
        return {f"g{i}": list(own) for i, own in enumerate(explicit) if own}
    found = {k: v for k, v in column_groups(columns).items() if k.startswith(f"{by} ")}
    if len(found) > 1:
        return found
    if len(columns) < 2:
        return {"all": list(columns)}
    half = len(columns) // 2
    return {"first half": list(columns[:half]), "second half": list(columns[half:])}


def key_series(columns: list[str], most: int = 4) -> list[str]:
    """Of each source the ten-year rate, else the longest."""
    return [next((c for y, _, c in own if abs(y - 10) < 0.1), own[-1][2]) for own in rate_columns(columns).values()][:most]


def curve_features(panel: DataFrame, vol_window: int = 60, corr_window: int = 60, levels: bool = True, spread: bool = True, fly: bool = True, cross: bool = True) -> DataFrame:
    """Every feature of a wide rate panel by date: levels, spreads, butterflies, spreads between sources, the other columns as they are,
    and rolling deviations and correlations of the key series. Rows with a feature that is null or not finite go.

    A wide panel has one row a date; its rolling windows run over all of it, so many panels go in side by side by a ``series`` column.
    """
    columns = feature_columns(panel)
    rates = [c for own in rate_columns(columns).values() for _, _, c in own]
    made = {c: F.col(c) for c in rates} if levels else {}
    for on, parts in ((spread, spreads), (fly, butterflies), (cross, cross_spreads)):
        made |= parts(columns) if on else {}
    made |= {c: F.col(c) for c in columns if c not in rates}
    keys = key_series(columns)
    own = panel if "series" in panel.columns else panel.withColumn("series", F.lit(""))
    own = own.withColumn("t", F.row_number().over(Window.partitionBy("series").orderBy("date")))
    moving = {f"{c}_vol": rolling(F.col(c), vol_window) for c in keys} | {f"{a}_{b}_corr": rolling_corr(F.col(a), F.col(b), corr_window) for a, b in combinations(keys, 2)}
    held = [c for c in ("date", "series") if c in panel.columns]
    # differences of finite columns are finite, so the columns and what moves over them are looked at, not each feature
    whole = finite(own.select(*held, *columns, *(c.alias(n) for n, c in moving.items())), [*columns, *moving])
    return whole.select(*held, *(c.alias(n) for n, c in made.items()), *moving)


def unchanged(panel: DataFrame) -> DataFrame:
    return panel


def with_ewma(panel: DataFrame, columns: list[str] | None = None, span: float = 20, adjust: bool = False, least: int = 1, keep_levels: bool = True, drop_nulls: bool = True) -> DataFrame:
    """A wide panel with ``<column>_ewma`` for some columns, the first five if none are named."""
    every = feature_columns(panel)
    columns = every[:5] if columns is None else columns
    if missing := set(columns) - set(every):
        raise KeyError(f"no columns {sorted(missing)}")
    if not columns:
        raise ValueError("no column to smooth")
    own = panel if "series" in panel.columns else panel.withColumn("series", F.lit(""))
    own = own.withColumn("t", F.row_number().over(Window.partitionBy("series").orderBy("date")) - 1)
    long = own.unpivot(["series", "t"], columns, "_name", "value").select(F.concat_ws("|", "series", "_name").alias("series"), F.col("series").alias("_own"), "_name", "t", "value")
    smooth = ewma(long, span, adjust=adjust, least=least).groupBy(F.col("_own").alias("series"), "t").pivot("_name", columns).agg(F.first("ewma"))
    smooth = smooth.withColumnsRenamed({c: f"{c}_ewma" for c in columns})
    new = [f"{c}_ewma" for c in columns]
    held = [c for c in ("date", "series") if c in panel.columns]
    out = own.join(smooth, ["series", "t"]).select(*held, *(every if keep_levels else []), *new)
    return finite(out, [*(every if keep_levels else []), *new]) if drop_nulls else out


def resolved(generator: str | Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A feature generator given as a function of a panel, or as the dotted path of one."""
    if callable(generator):
        return generator
    module, _, name = str(generator).strip().rpartition(".")
    if not module or not name:
        raise ValueError(f"not a dotted path: {generator!r}")
    found = getattr(importlib.import_module(module), name, None)
    if not callable(found):
        raise AttributeError(f"no function {name!r} in {module!r}")
    return found


def featured(panel: DataFrame, generate: bool | None = None, generator: str | Callable[..., DataFrame] | None = None, **knobs) -> DataFrame:
    """The panel through a feature generator, if ``generate`` says so; unsaid, unless it has columns ``f0``, ``f1`` and so on, as made features do."""
    panel = ensure_date(panel)
    if generate is None:
        generate = not any(re.fullmatch(r"f\d+", c) for c in panel.columns)
    if not generate:
        return panel
    if generator is None:
        raise ValueError("features are wanted, but no generator is given")
    out = resolved(generator)(panel, **knobs)
    if not isinstance(out, DataFrame):
        raise TypeError(f"the generator returns {type(out)}, not a DataFrame")
    return ensure_date(out)


def named(spec: list[str] | dict) -> list[str]:
    """Feature names from a list, from a mapping's ``columns``, or its keys."""
    if isinstance(spec, dict):
        return list(spec["columns"]) if "columns" in spec else list(spec)
    return list(spec)


def decay_lag(panel: DataFrame, breaks: DataFrame, width: int = 100, most: int = 40, threshold: float = 0.1) -> DataFrame:
    """(series, label, lag): the first lag at which the autocorrelation of the 2 * width rows around break ``label`` falls below ``threshold``, else ``most``.

    Breaks nearer than ``width`` to an end give no row. The pairs of a break are bounded by width and lag.
    """
    w = Window.partitionBy("series", "label")
    near = breaks.select("series", F.col("b").alias("label"), F.explode(F.sequence(F.col("b") - width, F.col("b") + width - 1)).alias("t"))
    x = near.withColumn("t", F.col("t").cast(panel.schema["t"].dataType)).join(panel.select("series", "t", "value"), ["series", "t"])
    x = x.select("series", "label", "t", (F.col("value") - F.avg("value").over(w)).alias("x"), F.count(F.lit(1)).over(w).alias("_n")).where(F.col("_n") == 2 * width)
    ahead = x.select("series", "label", F.col("t").alias("t2"), F.col("x").alias("x2"))
    pairs = x.withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(most)))).withColumn("t2", F.col("t") + F.col("lag")).join(ahead, ["series", "label", "t2"])
    sums = pairs.groupBy("series", "label", "lag").agg(F.sum(F.col("x") * F.col("x2")).alias("s"))
    r = F.try_divide("s", F.max(F.when(F.col("lag") == 0, F.col("s"))).over(w))
    return sums.withColumn("r", r).groupBy("series", "label").agg(F.coalesce(F.min(F.when(F.abs("r") < threshold, F.col("lag"))), F.max("lag")).alias("lag"))
