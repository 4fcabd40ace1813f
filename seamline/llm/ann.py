"""Nearest neighbours by few stable projections and a kd-tree, with a chi-square stopping test.

Vectors are scaled to length one, so that the nearest by cosine is the nearest by distance, and
projected to a few dimensions by Gaussian (2-stable) weights. For two vectors at distance s
the squared projected distance over s^2 follows a chi-square law. The upper part of a kd-tree over the
projections, fitted on a bounded sample, deals all vectors to cells; the lower part is built
within each cell. A query looks in its own cell first, then in the cells that could hold
a nearer vector. There the nearest leaf is verified on the original vectors, then its projected neighbours one after
the other, the nearest first; the search ends once a vector nearer than the k-th best so
far would, with the given confidence, have shown up already.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, cut, sampled

DIMS, LEAF = 48, 64
#: Vectors in a cell or a block of it, queries that meet it at once, vectors that the cells are fitted on.
CELL, ASKED, SAMPLE = 16_384, 16_384, 20_000


def chi2_quantile(share: float, dims: int) -> float:
    """Quantile of the chi-square law with an even number of degrees of freedom, by bisection."""
    if dims % 2:
        raise ValueError("an even number of dimensions is needed")

    def cdf(x: float) -> float:
        term = total = 1.0
        for k in range(1, dims // 2):
            term *= x / 2 / k
            total += term
        return 1 - math.exp(-x / 2) * total

    low, high = 0.0, 1.0
    while cdf(high) < share:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < share else (low, mid)
    return high


class KdTree:
    """A kd-tree over points: rows in the order of its leaves, and each leaf's edges and box."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF, leaves: int | None = None):
        self.points, self.order = points, np.arange(len(points))
        self.splits: list[tuple[int, float, int, int]] = []  # dimension, value, below, above; a leaf is -1 - its number
        self.edges: list[int] = [0]
        self.root = self._build(0, len(points), leaf, leaves or 1 << 62)
        self.edges = np.array(self.edges)
        own = points[self.order]
        self.low = np.stack([own[i:j].min(axis=0, initial=np.inf) for i, j in zip(self.edges, self.edges[1:])])
        self.high = np.stack([own[i:j].max(axis=0, initial=-np.inf) for i, j in zip(self.edges, self.edges[1:])])

    def _build(self, start: int, stop: int, leaf: int, leaves: int) -> int:
        own = self.points[self.order[start:stop]]
        spread = np.ptp(own, axis=0) if len(own) else np.zeros(1)
        if stop - start <= leaf or leaves < 2 or not spread.any():
            self.edges.append(stop)
            return -len(self.edges) + 1
        dim, mid = int(spread.argmax()), (stop - start) // 2
        part = np.argpartition(own[:, dim], mid)
        self.order[start:stop] = self.order[start:stop][part]
        me = len(self.splits)
        self.splits.append((dim, float(own[part[mid], dim]), 0, 0))
        below = self._build(start, start + mid, leaf, leaves // 2)
        self.splits[me] = (*self.splits[me][:2], below, self._build(start + mid, stop, leaf, leaves - leaves // 2))
        return me

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        """The leaf in whose part of the space each point lies."""
        out, todo = np.zeros(len(points), int), [(self.root, np.arange(len(points)))]
        while todo:
            at, rows = todo.pop()
            if at < 0:
                out[rows] = -1 - at
            elif len(rows):
                dim, value, below, above = self.splits[at]
                over = points[rows, dim] >= value
                todo += [(below, rows[~over]), (above, rows[over])]
        return out

    def gaps(self, q: np.ndarray) -> np.ndarray:
        """Squared distance of the query from each leaf's box."""
        return (np.maximum(0, np.maximum(self.low - q, q - self.high)) ** 2).sum(axis=1)


def weights(n: int, dims: int = DIMS, seed: int = 11) -> np.ndarray:
    return np.random.default_rng([seed, n]).normal(size=(n, dims))


def projected(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None] @ weights(vectors.shape[1])


def cosines(vectors: np.ndarray, norms: np.ndarray, q: np.ndarray, norm: float) -> np.ndarray:
    """In double precision; the sum runs along each row alone, so equal vectors get equal values."""
    return (vectors * q).sum(axis=1) / (norms * norm)


class Block:
    """One block of vectors of equal length, searched by one query after another."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, points: np.ndarray, confidence: float):
        self.tree, self.enough = KdTree(points), chi2_quantile(confidence, points.shape[1])
        self.ids, self.vectors, self.points = ids[self.tree.order], vectors[self.tree.order], points[self.tree.order]
        self.verified = 0
        self.norms = np.sqrt((self.vectors * self.vectors).sum(axis=1))
        self.unit = self.vectors / self.norms[:, None]

    def nearest(self, qid: int, q: np.ndarray, p: np.ndarray, k: int, worst: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and cosines of the k nearest found, none of them below ``worst``; rows of the query's own id are passed over."""
        gaps, norm = self.tree.gaps(p), float(np.sqrt((q * q).sum()))
        unit, edges, slack = q / norm, self.tree.edges, 1e-9
        rows, found = np.zeros(0, int), np.zeros(0)

        def verify(fresh: np.ndarray) -> None:
            nonlocal rows, found, worst
            c = self.unit[fresh] @ unit
            some = (c >= worst - slack) & (self.ids[fresh] != qid)
            rows, found = np.concatenate([rows, fresh[some]]), np.concatenate([found, c[some]])
            if len(found) >= k:
                worst = max(worst, float(np.partition(found, -k)[-k]))
                some = found >= worst - slack
                rows, found = rows[some], found[some]
            self.verified += len(fresh)

        # beyond this gap a vector nearer than the k-th best would have shown up already
        limit = lambda: self.enough * max(0.0, 2 - 2 * worst) + 1e-12
        first = int(gaps.argmin())
        verify(np.arange(edges[first], edges[first + 1]))
        near = np.flatnonzero(gaps <= limit())
        near = np.concatenate([np.arange(edges[i], edges[i + 1]) for i in near[near != first]] or [np.zeros(0, int)])
        far = ((self.points[near] - p) ** 2).sum(axis=1)
        order, at, step = np.argsort(far, kind="stable"), 0, 64
        while at < len(order):
            fresh = order[at : at + step]
            fresh = fresh[far[fresh] <= limit()]
            if not len(fresh):
                break
            verify(near[fresh])
            at, step = at + step, min(2 * step, 512)
        exact = cosines(self.vectors[rows], self.norms[rows], q, norm)
        best = np.lexsort((self.ids[rows], -exact))[:k]
        return self.ids[rows][best], exact[best]


def usable(vector: Column) -> Column:
    """Not null or empty, no null or non-finite component, not all zeros."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(rows: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", confidence: float = 0.99, cell: int = CELL, asked: int = ASKED, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, id, score): the k rows nearest to each query by cosine, ties to the smaller id.

    The cells are fitted on about ``sample`` vectors and hold about ``cell`` each; fuller ones are cut
    into blocks. Each vector is in one block. At most ``asked`` queries meet a block at once. A row is not its
    own neighbour: rows of the query's id are passed over. Vectors that are null, zero or not
    finite take no part, nor do null ids; vectors of another length than the query's are no candidates. Rows
    that repeat an id and vector count once; different vectors of one id are different rows. Of equal
    vectors only those of the k + 1 smallest ids can be among the nearest, so the rest stay behind. Too few candidates
    give fewer rows, an empty table none.
    """
    scratch = Scratch(rows.sparkSession)
    keep = scratch.cut
    kind = rows.schema[vector_col].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"

    def clean(df: DataFrame) -> DataFrame:
        df = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("v"))
        return df.where(F.col("id").isNotNull() & usable(F.col("v")))

    rows, queries = clean(rows), clean(queries)
    known = [np.array(r["v"], float) for r in sampled(rows, F.col("id"), sample).select("v").collect()]
    total, trees = rows.count(), {}
    for n in {len(x) for x in known}:
        own = projected(np.stack([x for x in known if len(x) == n]))
        trees[n] = KdTree(own, leaf=32, leaves=math.ceil(total * len(own) / len(known) / cell))

    def placed(df: DataFrame) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                lengths = pdf["v"].map(len).to_numpy()
                for n in np.unique(lengths).tolist():
                    own = pdf[lengths == n]
                    p = projected(np.stack(own["v"]).astype(float))
                    yield own.assign(n=n, p=list(p), cell=trees[n].leaf_of(p) if n in trees else 0)

        return df.mapInPandas(run, f"id long, v {kind}, n int, p array<double>, cell int")

    # first within small parts of the rows of a vector, as one vector may be that of many rows
    for by in (["v", F.pmod(F.xxhash64("id"), F.lit(256))], ["v"]):
        rows = rows.withColumn("nth", F.dense_rank().over(Window.partitionBy(*by).orderBy("id"))).where(F.col("nth") <= k + 1).drop("nth")
    rows = keep(placed(rows), "rows")
    queries = keep(placed(queries.dropDuplicates(["id", "v"])).withColumn("own", F.xxhash64("v")), "queries")
    sides = [f(F.col("p")[i]).alias(f"{name}_{i}") for i in range(DIMS) for name, f in (("low", F.min), ("high", F.max))]
    boxes = keep(rows.groupBy("n", "cell").agg(F.ceil(F.count(F.lit(1)) / cell).alias("blocks"), *sides), "boxes")
    rows = rows.join(boxes.select("n", "cell", "blocks"), ["n", "cell"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))).drop("blocks")
    unit = ["n", "cell", "block"]

    def run(own: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        got = []
        if len(own) and len(asking):
            if own["id"].duplicated().any():  # rows that repeat an id lie in one block; those with equal vectors count once
                own = own.assign(key=[x.tobytes() for x in own["v"]]).drop_duplicates(["id", "key"])
            block = Block(own["id"].to_numpy(), np.stack(own["v"]).astype(float), np.stack(own["p"]), confidence)
            for qid, key, q, p, worst in zip(asking["id"], asking["own"], asking["v"], asking["p"], asking["worst"], strict=True):
                found, score = block.nearest(qid, np.asarray(q, float), p, k, worst)
                got.append(pd.DataFrame({"query_id": qid, "own": key, "id": found, "score": score}))
        return pd.concat(got) if got else pd.DataFrame({"query_id": [], "own": [], "id": [], "score": []})

    def searched(routed: DataFrame, tag: str) -> DataFrame:
        """The k nearest of each query among the blocks that it is sent to."""
        routed = keep(routed.select("id", "own", "v", "p", "worst", "n", "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")), tag)
        parts = routed.groupBy(*unit).agg(F.ceil(F.count(F.lit(1)) / asked).alias("parts"))
        each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")
        own = rows.join(parts, unit).select(*unit, each, "id", "v", "p")
        asking = routed.join(parts, unit).select(*(F.col(c).alias(c) for c in (*unit, "id", "own", "v", "p", "worst")), F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"))
        found = own.groupBy(*unit, "part").cogroup(asking.groupBy(*unit, "part")).applyInPandas(run, "query_id long, own long, id long, score double")
        return ranked(found)

    def ranked(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id", "own").orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    near = keep(searched(queries.join(boxes, ["n", "cell"]).withColumn("worst", F.lit(-2.0)), "at_home"), "near")
    worst = near.where(F.col("rank") == k).select(F.col("query_id").alias("id"), "own", F.col("score").alias("worst"))
    gap = F.expr(" + ".join(f"pow(greatest(0, low_{i} - p[{i}], p[{i}] - high_{i}), 2)" for i in range(DIMS)))
    limit = chi2_quantile(confidence, DIMS) * F.greatest(F.lit(0.0), 2 - 2 * F.col("worst")) + 1e-12
    away = queries.join(worst, ["id", "own"], "left").withColumn("worst", F.coalesce("worst", F.lit(-2.0)))
    away = away.withColumnRenamed("cell", "home").join(boxes, "n").where((F.col("cell") != F.col("home")) & (gap <= limit))
    out = ranked(near.drop("rank").union(searched(away, "away").drop("rank")))
    out = cut(out.select("query_id", "rank", F.col("id").alias(id_col), "score"), "nearest")
    scratch.clear()
    return out
