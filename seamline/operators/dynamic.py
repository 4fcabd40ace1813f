"""Exact segmentation by dynamic programming, in blocks of candidate rows and without a series in one task.

The cost of a segment is the squared distance of its rows to their mean, told from prefix sums at its two ends alone; rows that a
kernel's feature map made (``maps``) give the kernel's cost. Candidate rows, the ``nodes``, lie on a jump grid and travel in blocks. The best costs up to
all nodes of a block, by way of all nodes of an earlier one, are a min-plus product of two blocks, a row of a DataFrame, and the least over the earlier blocks is an aggregate.

A fixed number of breaks takes one such job a break. With a penalty, a block's costs need those of the blocks before it,
so it is a job a block, over the few nodes that may still be a last break. In both cases a node that can't be the last break before any later
node is dropped first: to break again at some row between is no worse.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .search import edges_of

SIZE = 256


def grid(panel: DataFrame, columns: list[str] | str | None = None, jump: int = 5, size: int = SIZE) -> DataFrame:
    """(series, block, n, t, v): up to ``size`` nodes a row, the multiples of ``jump`` and the series' end n; v holds, node after node, the sums before it of the squares and of each column.

    Columns are centred first, which changes no cost and keeps the sums small. ``columns`` may name an array instead, which is taken as it is.
    """
    columns = columns or ["value"]
    if isinstance(columns, str):
        square = F.aggregate(columns, F.lit(0.0), lambda s, x: s + x * x)
        edges = edges_of(panel.select("series", "t", F.concat(F.array(square), F.col(columns)).alias("_z")), "_z")
    else:
        means = panel.groupBy("series").agg(*(F.avg(c).alias(f"_m{i}") for i, c in enumerate(columns)))
        own = panel.join(means, "series").select("series", "t", *((F.col(c) - F.col(f"_m{i}")).cast("double").alias(f"_v{i}") for i, c in enumerate(columns)))
        names = [f"_v{i}" for i in range(len(columns))]
        own = own.withColumn("_sq", reduce(lambda a, b: a + b, (F.col(c) * F.col(c) for c in names)))
        edges = edges_of(own, ["_sq", *names])
    nodes = edges.join(edges.groupBy("series").agg(F.max("t").alias("n")), "series").where((F.col("t") % jump == 0) | (F.col("t") == F.col("n")))
    nodes = nodes.withColumn("block", F.floor(F.ceil(F.col("t") / jump) / size))
    got = nodes.groupBy("series", "block").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("t", "sums"))).alias("x"))
    return written(got.select("series", "block", "n", F.col("x.t").alias("t"), F.flatten("x.sums").alias("v")), "grid")


def costs(start: np.ndarray, sums: np.ndarray, end: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Cost of the segment from each start (columns) to each end (rows); infinite where it has no rows."""
    n = end[:, None] - start[None]
    moved = np.zeros(n.shape)
    for k in range(1, sums.shape[1]):
        d = ends[:, k][:, None] - sums[:, k][None]
        moved += d * d
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n > 0, np.maximum(0, ends[:, 0][:, None] - sums[:, 0][None] - moved / n), np.inf)


def _relaxed(t, f, v, te, ve, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each end the least of f(start) + cost, and the first start that has it."""
    t, te = np.asarray(t), np.asarray(te)
    v, ve = np.asarray(v).reshape(len(t), -1), np.asarray(ve).reshape(len(te), -1)
    total = np.where(te[:, None] - t[None] >= least, np.asarray(f)[None] + costs(t, v, te, ve), np.inf)
    at = total.argmin(axis=1)
    best = total[np.arange(len(te)), at]
    return best, np.where(np.isfinite(best), t[at], -1)


def _least(pulled: DataFrame) -> DataFrame:
    """(series, block, f, last): the least over all rows of a block (series, block, f, last), node by node; equal ones by the smaller last break."""
    each = pulled.repartition("series", "block").select("series", "block", F.posexplode(F.arrays_zip("f", "last")).alias("at", "x"))
    best = each.groupBy("series", "block", "at").agg(F.min(F.struct("x.f", "x.last")).alias("x"))
    got = best.groupBy("series", "block").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("x"))
    return got.select("series", "block", F.col("x.x.f").alias("f"), F.col("x.x.last").alias("last"))


def _nodes(blocks: DataFrame) -> DataFrame:
    return blocks.select("series", "n", F.explode(F.arrays_zip("t", "f", "last")).alias("x")).select("series", "n", "x.t", "x.f", "x.last")


def optimal_splits(panel: DataFrame, n_breaks: int, columns: list[str] | str | None = None, min_size: int = 10, jump: int = 5, size: int = SIZE, blocks: DataFrame | None = None) -> DataFrame:
    """The ``n_breaks`` breaks on the jump grid of the least cost together: (series, k, b, cost), the k-th break and the whole cost. A job a break.

    Each regime has ``min_size`` rows at least; a series without room for all breaks gives no row. Of equal costs that with the
    smaller last break counts. ``blocks`` is a ``grid`` to use again.
    """
    if n_breaks < 1:
        raise ValueError("one break is the least")
    blocks = grid(panel, columns, jump, size) if blocks is None else blocks
    kind = panel.schema["series"].dataType.simpleString()
    behind = -(-min_size // jump)

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                v = np.asarray(r.v).reshape(len(r.t), -1)
                f = _relaxed([0], [0.0], np.zeros((1, v.shape[1])), r.t, v, min_size)[0]
                out.append((r.series, r.block, r.n, r.t, r.v, f, np.where(np.isfinite(f), 0, -1)))
            yield pd.DataFrame(out, columns=["series", "block", "n", "t", "v", "f", "last"])

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A block goes to each later one, with the nodes that none of the ``leads`` before that one rules out."""
        for pdf in batches:
            for r in pdf.itertuples():
                t, f = np.asarray(r.t), np.asarray(r.f)
                v, leads = np.asarray(r.v).reshape(len(t), -1), [x for x in r.leads if x["block"] >= r.block]
                alive, out = np.isfinite(f), []
                for lead in leads:
                    if alive.any():
                        out.append((r.series, lead["block"], t[alive], f[alive], v[alive].ravel()))
                    if lead["f"] is not None and np.isfinite(lead["f"]):
                        by = f + costs(t, v, np.array([lead["t"]]), np.asarray(lead["v"])[None])[0]
                        alive &= ~((by > lead["f"]) & (t < lead["t"]))
                yield pd.DataFrame(out, columns=["series", "block", "t", "f", "v"])

    def pull(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [_relaxed(r.t, r.f, r.v, r.te, r.ve, min_size) for r in pdf.itertuples()]
            yield pdf[["series", "block"]].assign(f=[x[0] for x in got], last=[x[1] for x in got])

    state_kind = f"series {kind}, block long, n long, t array<long>, v array<double>, f array<double>, last array<long>"
    layers = [written(blocks.mapInPandas(first, state_kind), "layer")]
    targets = blocks.select("series", "block", F.col("t").alias("te"), F.col("v").alias("ve"))
    for _ in range(n_breaks):
        state = layers[-1]
        at = F.greatest(F.size("t") - behind, F.lit(1))  # so far before the next block that any of its nodes may follow
        width = (F.size("v") / F.size("t")).cast("int")
        lead = F.struct("block", F.element_at("t", at).alias("t"), F.when(F.size("t") > behind, F.element_at("f", at)).alias("f"), F.slice("v", (at - 1) * width + 1, width).alias("v"))
        leads = state.groupBy("series").agg(F.sort_array(F.collect_list(lead)).alias("leads"))
        sent = state.join(leads, "series").mapInPandas(spread, f"series {kind}, block long, t array<long>, f array<double>, v array<double>")
        best = _least(sent.join(targets, ["series", "block"]).mapInPandas(pull, f"series {kind}, block long, f array<double>, last array<long>"))
        never = F.transform("t", lambda _: F.lit(float("inf"))), F.transform("t", lambda _: F.lit(-1).cast("long"))
        layers.append(written(blocks.join(best, ["series", "block"], "left").select("series", "block", "n", "t", "v", F.coalesce("f", never[0]).alias("f"), F.coalesce("last", never[1]).alias("last")), "layer"))
    found = _nodes(layers[-1]).where("t = n and last >= 0").select("series", F.col("last").alias("b"), F.col("f").alias("cost"))
    out = [found.select("series", F.lit(n_breaks).alias("k"), "b", "cost")]
    for k in range(n_breaks - 1, 0, -1):
        found = found.join(_nodes(layers[k]).select("series", F.col("t").alias("b"), F.col("last").alias("_last")), ["series", "b"]).select("series", F.col("_last").alias("b"), "cost")
        out.append(found.select("series", F.lit(k).alias("k"), "b", "cost"))
    return reduce(DataFrame.union, out)


def penalties(panel: DataFrame, columns: list[str] | str | None = None) -> DataFrame:
    """(series, penalty): the logarithm of the length times the variance of all values, two rows counted at least."""
    columns = columns or ["value"]
    values = F.col(columns) if isinstance(columns, str) else F.array(*(F.col(c).cast("double") for c in columns))
    every = panel.select("series", F.size(values).alias("_p"), F.explode(values).alias("x"))
    return every.groupBy("series").agg((F.log(F.greatest(F.count(F.lit(1)) / F.max("_p"), F.lit(2.0))) * F.var_pop("x")).alias("penalty"))


def penalised_splits(panel: DataFrame, penalty: float | None = None, columns: list[str] | str | None = None, min_size: int = 10, jump: int = 5, size: int = SIZE) -> DataFrame:
    """The breaks on the jump grid of the least cost and penalty for each together (pruned exact search): (series, b). A job a block of nodes.

    Without a ``penalty`` that of ``penalties`` holds. A series shorter than two regimes has no break.
    """
    blocks = grid(panel, columns, jump, size)
    prices = penalties(panel, columns) if penalty is None else panel.select("series").distinct().withColumn("penalty", F.lit(float(penalty)))
    kind = panel.schema["series"].dataType.simpleString()
    behind = -(-min_size // jump)
    state = f"series {kind}, block long, n long, penalty double, t array<long>, v array<double>, f array<double>, last array<long>"

    def pull(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [_relaxed(r.t, r.f, r.v, r.te, r.ve, min_size) for r in pdf.itertuples()]
            yield pd.DataFrame({"series": pdf["series"], "block": pdf["to"], "f": [x[0] + p for x, p in zip(got, pdf["penalty"], strict=True)], "last": [x[1] for x in got]})

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The costs within a block, in order, from those by way of earlier blocks."""
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                t = np.asarray(r.t)
                v = np.asarray(r.v).reshape(len(t), -1)
                f = np.full(len(t), np.inf) if r.f is None else np.array(r.f, float)
                last = np.full(len(t), -1) if r.last is None else np.array(r.last)
                if t[0] == 0:
                    f[0], last[0] = -r.penalty, -1
                within = np.where(t[:, None] - t[None] >= min_size, costs(t, v, t, v), np.inf)
                for k in range(1, len(t)):
                    by = f[:k] + within[k, :k] + r.penalty
                    at = int(by.argmin())
                    if by[at] < f[k]:
                        f[k], last[k] = by[at], t[at]
                out.append((r.series, r.block, r.n, r.penalty, r.t, r.v, f, last))
            yield pd.DataFrame(out, columns=["series", "block", "n", "penalty", "t", "v", "f", "last"])

    def prune(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                t, f = np.asarray(r.t), np.asarray(r.f)
                v, alive = np.asarray(r.v).reshape(len(t), -1), np.isfinite(f)
                if r.lead_f is not None and np.isfinite(r.lead_f):
                    alive &= ~((f + costs(t, v, np.array([r.lead_t]), np.asarray(r.lead_v)[None])[0] > r.lead_f) & (t < r.lead_t))
                if alive.any():
                    out.append((r.series, r.block, r.n, r.penalty, t[alive], v[alive].ravel(), f[alive], np.asarray(r.last)[alive]))
            yield pd.DataFrame(out, columns=["series", "block", "n", "penalty", "t", "v", "f", "last"])

    most = blocks.agg(F.max("block")).first()[0]
    open_, settled = None, []
    for k in range((-1 if most is None else most) + 1):
        own = blocks.where(F.col("block") == k).join(prices, "series")
        if open_ is None:
            told = own.withColumns({"f": F.lit(None).cast("array<double>"), "last": F.lit(None).cast("array<long>")})
        else:
            met = open_.join(own.select("series", F.col("block").alias("to"), F.col("t").alias("te"), F.col("v").alias("ve")), "series")
            told = own.join(_least(met.mapInPandas(pull, f"series {kind}, block long, f array<double>, last array<long>")), ["series", "block"], "left")
        done = written(told.select("series", "block", "n", "penalty", "t", "v", "f", "last").mapInPandas(settle, state), "settled")
        settled.append(done)
        if k == most:
            break
        at = F.greatest(F.size("t") - behind, F.lit(1))
        width = (F.size("v") / F.size("t")).cast("int")
        going = done.where(F.element_at("t", -1) < F.col("n"))
        lead = going.select("series", F.element_at("t", at).alias("lead_t"), F.when(F.size("t") > behind, F.element_at("f", at)).alias("lead_f"), F.slice("v", (at - 1) * width + 1, width).alias("lead_v"))
        open_ = written((going if open_ is None else open_.union(going)).join(lead, "series").mapInPandas(prune, state), "open")
    if not settled:
        return panel.select("series", F.col("t").cast("long").alias("b")).limit(0)
    return path(reduce(DataFrame.union, map(_nodes, settled)))


def path(nodes: DataFrame) -> DataFrame:
    """(series, b): the nodes above 0 on the way back from each series' end, by nodes (series, n, t, last). Hops double with each job."""
    hop = nodes.where("last > 0").select("series", F.col("t").alias("b"), F.col("last").alias("to"))
    found = fresh = nodes.where("t = n").select("series", F.col("t").alias("b"))
    while True:
        fresh = written(found.join(hop, ["series", "b"]).select("series", F.col("to").alias("b")).join(found, ["series", "b"], "left_anti").distinct(), "path")
        if fresh.isEmpty():
            break
        found = found.union(fresh)
        far = hop.select("series", F.col("b").alias("to"), F.col("to").alias("_far"))
        hop = written(hop.join(far, ["series", "to"]).select("series", "b", F.col("_far").alias("to")), "hops")
    return found.join(nodes.where("t = n").select("series", F.col("t").alias("b")), ["series", "b"], "left_anti")
