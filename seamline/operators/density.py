"""Clusters by density: neighbours in blocks, a minimum spanning tree by Boruvka's rounds, and the hierarchy it condenses to.

Rows are dealt to the cells of a tree that a bounded sample tells, and stand there in blocks of bounded size; blocks meet only where
their boxes are near enough to matter. Every step is a join or a grouping of tables, and a group is a pair of blocks or a band
of edges. Results are those of the whole matrix of distances: lists of neighbours only save work, as a component whose best
listed edge could be beaten searches the blocks within reach.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import written

#: Least distance of which the inverse is taken, so that the density of equal rows is a number.
TINY = 1e-200


def _tree(x: np.ndarray, leaves: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Columns and thresholds of the inner nodes of a balanced tree of so many leaves (a power of 2), and the leaves' boxes."""
    dims, cuts = np.zeros(leaves, int), np.zeros(leaves)
    lo, hi = np.full((2 * leaves, x.shape[1]), -np.inf), np.full((2 * leaves, x.shape[1]), np.inf)
    held = {1: x}
    for node in range(1, leaves):
        own = held.pop(node)
        dims[node] = np.ptp(own, axis=0).argmax() if len(own) else 0
        cuts[node] = np.median(own[:, dims[node]]) if len(own) else 0.0
        left = own[:, dims[node]] <= cuts[node]
        for child, part in ((2 * node, own[left]), (2 * node + 1, own[~left])):
            held[child], lo[child], hi[child] = part, lo[node], hi[node]
        hi[2 * node, dims[node]] = lo[2 * node + 1, dims[node]] = cuts[node]
    return dims, cuts, lo[leaves:], hi[leaves:]


def _box_gap(lo, hi, to_lo, to_hi) -> np.ndarray:
    return np.sqrt((np.maximum(0, np.maximum(to_lo - hi, lo - to_hi)) ** 2).sum(axis=-1))


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2))


def _rows_of(held) -> np.ndarray:
    return np.array([list(r) for r in held], float)


class Space:
    """The rows of a panel, (series, t, id, x), in blocks (series, cell, block, ids, xs, lo, hi)."""

    def __init__(self, panel: DataFrame, columns: list[str], size: int = 256, sample: int = 20_000):
        self.kind, self.size = dict(panel.dtypes)["series"], size
        base = panel.select("series", "t", F.array(*(F.col(c).cast("double") for c in columns)).alias("x"))
        base = written(base.where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != math.inf))).withColumn("id", F.monotonically_increasing_id()), "points")
        n = base.count()
        picked = base if n <= sample else base.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(sample / n * (1 << 30)))
        known = np.array([r["x"] for r in picked.select("x").collect()], float).reshape(-1, len(columns))
        leaves = 1 << max(0, math.ceil(math.log2(max(1, min(n / size, len(known) / 16)))))
        self.tree = dims, cuts, *_ = _tree(known, leaves)

        def deal(batches):
            for pdf in batches:
                x, at = _rows_of(pdf["x"]).reshape(-1, len(columns)), np.ones(len(pdf), int)
                while leaves > 1 and len(at) and at[0] < leaves:
                    at = 2 * at + (x[np.arange(len(x)), dims[at]] > cuts[at])
                yield pdf.assign(cell=at - (leaves if leaves > 1 else 1))

        dealt = base.mapInPandas(deal, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in base.schema) + ", cell int")
        parts = dealt.groupBy("series", "cell").agg(F.ceil(F.count(F.lit(1)) / size).alias("parts"))
        dealt = dealt.join(parts, ["series", "cell"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        self.points = written(dealt.select("series", "t", "id", "x", "cell", F.struct("cell", "part").alias("block")), "dealt")

    def blocks(self, extra: DataFrame | None = None, columns: tuple[str, ...] = ()) -> DataFrame:
        """Blocks, each with lists of its rows' ``columns`` of ``extra`` (by id) too; rows that ``extra`` lacks are left out."""
        rows = self.points if extra is None else self.points.join(extra, "id")
        held = rows.groupBy("series", "cell", "block").agg(F.array_sort(F.collect_list(F.struct("id", "x", *columns))).alias("rows"))
        return held.select("series", "cell", "block", F.col("rows.id").alias("ids"), F.col("rows.x").alias("xs"), *(F.col(f"rows.{c}").alias(c) for c in columns))

    def within_reach(self, asking: DataFrame, asked: DataFrame) -> DataFrame:
        """Pairs of blocks: those ``asking``, with a ``reach``, and the blocks ``asked`` in the cells of the tree that lie within it."""
        _, _, lo, hi = self.tree
        named = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asking.schema)

        def run(batches):
            for pdf in batches:
                cells = []
                for xs, reach in zip(pdf["xs"], pdf["reach"], strict=True):
                    x = _rows_of(xs)
                    cells.append(np.flatnonzero(_box_gap(x.min(axis=0), x.max(axis=0), lo, hi) <= reach).tolist())
                yield pdf.assign(cells=cells)

        near = asking.repartition(F.col("series"), F.col("block")).mapInPandas(run, named + ", cells array<int>").withColumn("cell_b", F.explode("cells")).drop("cells", "cell")
        other = asked.select("series", F.col("cell").alias("cell_b"), *(F.col(c).alias(f"{c}_b") for c in asked.columns if c not in ("series", "cell")))
        return near.join(other, ["series", "cell_b"])

    def neighbours(self, k: int) -> DataFrame:
        """(series, id, near): the k nearest other rows of the series as (d, other), nearest first; fewer if there are fewer."""
        blocks = written(self.blocks(), "blocks")

        def own(batches):
            for pdf in batches:
                reach = []
                for xs in pdf["xs"]:
                    x = _rows_of(xs)
                    reach.append(float(np.partition(_distances(x, x), k, axis=1)[:, k].max()) if len(x) > k else math.inf)
                yield pdf.assign(reach=reach)

        asking = blocks.repartition(F.col("series"), F.col("block")).mapInPandas(own, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in blocks.schema) + ", reach double")

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            row = pdf.iloc[0]
            ids, others = np.array(row["ids"]), np.array(row["ids_b"])
            d = _distances(_rows_of(row["xs"]), _rows_of(row["xs_b"]))
            d[ids[:, None] == others[None]] = np.inf
            order = np.lexsort((np.broadcast_to(others, d.shape), d), axis=1)[:, :k]
            near = [[{"d": d[i, j], "other": others[j]} for j in order[i] if d[i, j] < np.inf] for i in range(len(ids))]
            return pd.DataFrame({"series": row["series"], "id": ids, "near": near})

        each = self.within_reach(asking, blocks).groupBy("series", "block", "block_b").applyInPandas(run, f"series {self.kind}, id long, near array<struct<d: double, other: long>>")
        return each.groupBy("series", "id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))


def _jumped(links: DataFrame, node: str = "c", to: str = "to") -> DataFrame:
    """Follow links until they end: a node that ends names itself. Each round doubles the steps."""
    while True:
        ends = links.select(F.col(node).alias(to), F.col(to).alias("_then"))
        after = written(links.join(ends, to, "left").select(node, F.coalesce("_then", to).alias("_new"), to), "jumps")
        moved = after.where(F.col("_new") != F.col(to)).limit(1).count()
        links = after.select(node, F.col("_new").alias(to))
        if not moved:
            return links


def spanning_tree(space: Space, least: int, lists: int = 16) -> DataFrame:
    """(series, a, b, w): the minimum spanning tree of mutual reachability, the largest of a distance and both rows' core distances.

    A core distance is that to the nearest of ``least`` rows, the row itself among them. Ties go to smaller ids. Each round joins every component to the nearest
    other one: by lists of neighbours where none unlisted could be nearer, and else by the blocks within reach of its best.
    """
    k = max(lists, least - 1)
    near = written(space.neighbours(k), "near")
    core = F.coalesce(F.try_element_at("near", F.lit(least - 1))["d"], F.try_element_at("near", F.lit(-1))["d"], F.lit(0.0)) if least > 1 else F.lit(0.0)
    known = written(near.select("series", "id", core.alias("core"), F.when(F.size("near") < k, math.inf).otherwise(F.try_element_at("near", F.lit(-1))["d"]).alias("bound")), "cores")
    each = near.select("series", F.col("id").alias("a"), F.explode("near").alias("n")).select("series", "a", F.col("n.other").alias("b"), F.col("n.d").alias("d"))
    cores = lambda c: known.select(F.col("id").alias(c), F.col("core").alias(f"core_{c}"))
    edges = written(each.join(cores("a"), "a").join(cores("b"), "b").select("series", "a", "b", F.greatest("d", "core_a", "core_b").alias("w")), "edges")
    comp, tree = known.select("series", "id", F.col("id").alias("c")), []
    first = F.struct("w", F.least("a", "b").alias("one"), F.greatest("a", "b").alias("two"))
    while True:
        of = lambda c, n: comp.select(F.col("id").alias(c), F.col("c").alias(n))  # noqa: E731, B023
        out = edges.join(of("a", "ca"), "a").join(of("b", "cb"), "b").where("ca <> cb")
        best = written(out.groupBy("series", F.col("ca").alias("c")).agg(F.min_by(F.struct("w", "a", "b", "cb"), first).alias("e")).select("series", "c", "e.*"), "best")
        if not comp.groupBy("series").agg(F.count_distinct("c").alias("n")).where("n > 1").limit(1).count():
            break
        state = written(comp.join(best.select("c", "w"), "c", "left").join(known.drop("series"), "id"), "state")
        # a bound for components that no list leaves: the first row of another component, one of two for the whole series
        heads = space.points.join(state.select("id", "c", "core"), "id").groupBy("series", "c").agg(F.min_by(F.struct("id", "x", "core"), "id").alias("h"))
        two = _first_two(heads)
        gap = F.sqrt(F.aggregate(F.zip_with("h.x", "o.x", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))
        far = heads.join(two, "series").where("c <> oc").groupBy("c").agg(F.min(F.greatest(gap, F.col("h.core"), F.col("o.core"))).alias("far"))
        open_ = state.join(far, "c").withColumn("limit", F.least(F.coalesce("w", F.lit(math.inf)), "far")).where(F.greatest("core", "bound") <= F.col("limit"))
        open_ = written(open_.select("id", "c", "core", "limit"), "open")
        if open_.limit(1).count():
            asking = space.blocks(open_, ("c", "core", "limit")).withColumn("reach", F.array_max("limit"))
            asked = written(space.blocks(state.select("id", "c", "core"), ("c", "core")), "labelled")
            found = space.within_reach(asking, asked).groupBy("series", "block", "block_b").applyInPandas(_nearest_other, f"series {space.kind}, ca long, w double, a long, b long, cb long")
            both = best.select("series", F.col("c").alias("ca"), "w", "a", "b", "cb").union(found.select("series", "ca", "w", "a", "b", "cb"))
            best = written(both.groupBy("series", F.col("ca").alias("c")).agg(F.min_by(F.struct("w", "a", "b", "cb"), first).alias("e")).select("series", "c", "e.*"), "best")
        tree.append(written(best.select("series", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w").distinct(), "tree"))
        back = best.select(F.col("c").alias("cb"), F.col("cb").alias("_back"))
        links = best.join(back, "cb").select("c", F.when((F.col("_back") == F.col("c")) & (F.col("c") < F.col("cb")), F.col("c")).otherwise(F.col("cb")).alias("to"))
        comp = written(comp.join(_jumped(written(links, "links")), "c", "left").select("series", "id", F.coalesce("to", "c").alias("c")), "components")
    empty = edges.select("series", "a", "b", "w").limit(0)
    return reduce(DataFrame.union, tree, empty)


def _first_two(heads: DataFrame) -> DataFrame:
    """(series, oc, o): the heads of the two components of the smallest names in each series."""
    name = F.struct(F.col("c"), F.col("h"))
    one = heads.groupBy("series").agg(F.min("c").alias("_c1"))
    rest = heads.join(one, "series")
    both = rest.groupBy("series").agg(F.min_by(name, "c").alias("p"), F.min_by(F.when(F.col("c") != F.col("_c1"), name), F.when(F.col("c") != F.col("_c1"), F.col("c"))).alias("q"))
    return both.select("series", F.explode(F.array("p", "q")).alias("e")).where("e is not null").select("series", F.col("e.c").alias("oc"), F.col("e.h").alias("o"))


def _nearest_other(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of a pair of blocks, the best edge of each component within its limit."""
    row = pdf.iloc[0]
    ids, others, c, cb = (np.array(row[x]) for x in ("ids", "ids_b", "c", "c_b"))
    w = np.maximum(_distances(_rows_of(row["xs"]), _rows_of(row["xs_b"])), np.maximum(np.array(row["core"])[:, None], np.array(row["core_b"])[None]))
    w[c[:, None] == cb[None]] = np.inf
    i, j = np.nonzero(w <= np.minimum(np.array(row["limit"])[:, None], np.finfo(float).max))
    out = pd.DataFrame({"series": row["series"], "ca": c[i], "w": w[i, j], "a": ids[i], "b": others[j], "cb": cb[j]})
    out = out.assign(one=np.minimum(ids[i], others[j]), two=np.maximum(ids[i], others[j])).sort_values(["w", "one", "two"])
    return out.drop_duplicates("ca")[["series", "ca", "w", "a", "b", "cb"]]


def merges(space: Space, tree: DataFrame, band: int = 500_000) -> DataFrame:
    """(series, node, l, r, w, nl, nr): the components that each edge of the tree joins, by growing weight, and their sizes.

    A row is a component by its id, and the component that an edge makes has a negative one. Edges go in bands of about ``band`` of a series, told from approximate quantiles;
    a band is a group, and meets components instead of rows. Edges of one weight may go in any order, so many of them are cut to bands by a hash.
    """
    tree = written(tree.withColumn("node", -1 - F.monotonically_increasing_id()), "numbered")
    most = tree.groupBy("series").count().agg(F.max("count")).first()[0] or 0
    n = max(1, math.ceil(most / band))
    if n > 1:
        cuts = tree.groupBy("series").agg(F.array_distinct(F.percentile_approx("w", [k / n for k in range(1, n)], 100 * n)).alias("cuts"))
        tree = tree.join(cuts, "series").withColumn("band", F.expr("size(filter(cuts, c -> c < w))")).drop("cuts")
        sizes = tree.groupBy("series", "band").agg(F.when(F.min("w") == F.max("w"), F.ceil(F.count(F.lit(1)) / band)).otherwise(1).alias("parts"))
        tree = written(tree.join(sizes, ["series", "band"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))).drop("parts"), "bands")
    else:
        tree = tree.withColumn("band", F.lit(0)).withColumn("part", F.lit(0))
    comp, out = space.points.select("id", F.col("id").alias("c"), F.lit(1).cast("long").alias("n")), []

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        up: dict[int, int] = {}
        size: dict[int, int] = {}

        def root(c):
            while c in up:
                up[c] = c = up.get(up[c], up[c])
            return c

        rows = []
        for e in pdf.sort_values(["w", "a", "b"]).itertuples():
            size.setdefault(e.ca, e.na)
            size.setdefault(e.cb, e.nb)
            x, y = root(e.ca), root(e.cb)
            rows.append((e.series, e.node, x, y, e.w, size[x], size[y]))
            up[x] = up[y] = e.node
            size[e.node] = size[x] + size[y]
        return pd.DataFrame(rows, columns=["series", "node", "l", "r", "w", "nl", "nr"])

    steps = [tuple(r) for r in tree.select("band", "part").distinct().orderBy("band", "part").collect()]
    for i, (b, p) in enumerate(steps):
        own = tree.where((F.col("band") == b) & (F.col("part") == p))
        for c in "ab":
            own = own.join(comp.select(F.col("id").alias(c), F.col("c").alias(f"c{c}"), F.col("n").alias(f"n{c}")), c)
        done = own.groupBy("series").applyInPandas(run, f"series {space.kind}, node long, l long, r long, w double, nl long, nr long")
        out.append(written(done, "merges"))
        if i + 1 < len(steps):
            links = out[-1].select(F.explode(F.array("l", "r")).alias("c"), F.col("node").alias("to"))
            ends = _jumped(written(links, "links")).join(out[-1].select(F.col("node").alias("to"), (F.col("nl") + F.col("nr")).alias("_n")), "to")
            comp = written(comp.join(ends, "c", "left").select("id", F.coalesce("to", "c").alias("c"), F.coalesce("_n", "n").alias("n")), "components")
    empty = space.points.select("series", *(F.lit(0).cast(t).alias(c) for c, t in (("node", "long"), ("l", "long"), ("r", "long"), ("w", "double"), ("nl", "long"), ("nr", "long")))).limit(0)
    return reduce(DataFrame.union, out, empty)


def condensed(space: Space, joined: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Clusters (series, c, parent, birth, size, stability, strongest) and rows (series, id, c, density).

    A cluster begins at a series' whole tree, or where a component falls into two of ``least`` rows or more; a row leaves its cluster at the density
    where it is in a component of fewer. The stability sums, over rows, the densities from birth to leaving.
    """
    level = 1 / F.greatest("w", F.lit(TINY))
    inner = written(joined.select("series", "node", "l", "r", "nl", "nr", level.alias("level"), (F.col("nl") + F.col("nr")).alias("n")), "inner")
    split = F.least("nl", "nr") >= least
    kids = inner.select("series", F.explode(F.array(F.struct(F.col("l").alias("c"), F.col("nl").alias("n")), F.struct(F.col("r").alias("c"), F.col("nr").alias("n")))).alias("k"), F.col("node").alias("up"), F.col("n").alias("up_n"), split.alias("split"), F.col("level").alias("up_level"))
    kids = written(kids.select("series", "k.*", "up", "up_n", "split", "up_level"), "kids")
    big = inner.where(F.col("n") >= least)
    links = big.select(F.col("node").alias("c"), "series").join(kids.select("c", "up", "split"), "c", "left")
    tops = written(links.select("c", F.when(F.col("up").isNull() | F.col("split"), F.col("c")).otherwise(F.col("up")).alias("to")), "links")
    tops = _jumped(tops)
    leave = F.when(F.greatest("nl", "nr") < least, F.col("n")).when(split, F.col("n")).otherwise(F.least("nl", "nr"))
    sums = big.withColumn("out", leave * F.col("level")).join(tops, big["node"] == tops["c"]).groupBy("series", F.col("to").alias("c")).agg(F.sum("out").alias("out"), F.max("level").alias("strongest"))
    births = kids.join(tops.select(F.col("c").alias("up"), F.col("to").alias("parent")), "up", "left").select("c", "parent", F.col("up_level").alias("birth"))
    sizes = inner.select(F.col("node").alias("c"), F.col("n").alias("size"))
    clusters = sums.join(sizes, "c").join(births, "c", "left").withColumn("birth", F.coalesce("birth", F.lit(0.0)))
    clusters = written(clusters.select("series", "c", "parent", "birth", "size", (F.col("out") - F.col("size") * F.col("birth")).alias("stability"), "strongest"), "clusters")
    small = kids.where(F.col("n") < least)
    first = _jumped(written(small.select("c", F.when(F.col("up_n") >= least, F.col("c")).otherwise(F.col("up")).alias("to")), "links"))
    rows = first.where("c >= 0").join(small.select(F.col("c").alias("to"), "up", "up_level", "up_n", "series"), "to").where(F.col("up_n") >= least)
    rows = rows.join(tops.select(F.col("c").alias("up"), F.col("to").alias("top")), "up")
    return clusters, written(rows.select("series", F.col("c").alias("id"), F.col("top").alias("c"), F.col("up_level").alias("density")), "members")


def chosen(clusters: DataFrame, method: str = "eom") -> DataFrame:
    """(c, pick): the chosen cluster that each cluster lies in. ``leaf`` chooses those without clusters inside, ``eom`` those that are more stable
    than what is inside them together; a job a level of the hierarchy. The whole tree of a series is never chosen."""
    if method not in ("eom", "leaf"):
        raise ValueError(f"unknown choice {method!r}")
    kids = clusters.where("parent is not null").groupBy(F.col("parent").alias("c")).agg(F.count(F.lit(1)).alias("kids"))
    todo = written(clusters.select("c", "parent", "stability").join(kids, "c", "left").select("c", "parent", "stability", F.coalesce("kids", F.lit(0)).alias("kids")), "todo")
    if method == "leaf":
        told = todo.select("c", "parent", (F.col("kids") == 0).alias("own"))
    else:
        levels = [written(todo.where("kids = 0").select("c", "parent", F.col("stability").alias("best"), F.lit(True).alias("own")), "level")]
        while True:
            done = reduce(DataFrame.union, levels)
            ready = done.groupBy(F.col("parent").alias("c")).agg(F.sum("best").alias("inside"), F.count(F.lit(1)).alias("n")).join(todo, "c").where("n = kids").join(done.select("c"), "c", "anti")
            level = written(ready.select("c", "parent", F.greatest("stability", "inside").alias("best"), (F.col("stability") >= F.col("inside")).alias("own")), "level")
            if not level.limit(1).count():
                break
            levels.append(level)
        told = done.select("c", "parent", "own")
    at = written(told.select("c", F.coalesce("parent", "c").alias("up"), F.when(F.col("own") & F.col("parent").isNotNull(), F.col("c")).alias("pick")), "picks")
    while True:  # the highest chosen one on the way up, in doubling steps
        above = at.select(F.col("c").alias("up"), F.col("up").alias("_up"), F.col("pick").alias("_pick"))
        after = written(at.join(above, "up").select("c", F.col("_up").alias("_to"), "up", F.coalesce("_pick", "pick").alias("pick")), "picks")
        moved = after.where(F.col("_to") != F.col("up")).limit(1).count()
        at = after.select("c", F.col("_to").alias("up"), "pick")
        if not moved:
            return at.select("c", "pick")


def density_members(panel: DataFrame, columns: list[str], least: int = 5, samples: int | None = None, method: str = "eom", size: int = 256, lists: int = 16, band: int = 500_000) -> tuple[Space, DataFrame]:
    """The space of the rows, and (series, id, pick, strength) of those in a cluster: the strength is the density where the row leaves, against the strongest of its cluster."""
    if least < 2:
        raise ValueError("a cluster has at least two rows")
    space = Space(panel, columns, size)
    clusters, rows = condensed(space, merges(space, spanning_tree(space, samples or least, lists), band), least)
    own = rows.join(chosen(clusters, method), "c").where("pick is not null")
    top = clusters.select(F.col("c").alias("pick"), "strongest")
    return space, written(own.join(top, "pick").select("series", "id", "pick", (F.least("density", "strongest") / F.col("strongest")).alias("strength")), "picked")


def density_clusters(panel: DataFrame, columns: list[str], least: int = 5, samples: int | None = None, method: str = "eom", **how) -> DataFrame:
    """(series, t, label): clusters of at least ``least`` rows by density (HDBSCAN), numbered by their first row in the series; -1 is noise.

    ``samples`` rows, as many as ``least`` if not given, make a core distance. Rows with a null or a number that isn't finite have no row.
    """
    space, picked = density_members(panel, columns, least, samples, method, **how)
    rows = space.points.select("series", "t", "id").join(picked.select("id", "pick"), "id", "left")
    first = rows.where("pick is not null").groupBy("series", "pick").agg(F.min("t").alias("_first"))
    named = first.select("pick", (F.row_number().over(Window.partitionBy("series").orderBy("_first")) - 1).alias("label"))
    return rows.join(named, "pick", "left").select("series", "t", F.coalesce("label", F.lit(-1)).alias("label"))


def density_distances(panel: DataFrame, columns: list[str], least: int = 5, samples: int | None = None, method: str = "eom", **how) -> DataFrame:
    """(series, t, cluster, distance): from each row to the centre of each cluster of its series, the mean of its rows by their strength; clusters by first row."""
    space, picked = density_members(panel, columns, least, samples, method, **how)
    rows = space.points.select("series", "t", "id", "x")
    own = rows.join(picked.select("id", "pick", "strength"), "id")
    means = [(F.sum(F.get("x", F.lit(i)) * F.col("strength")) / F.sum("strength")).alias(f"m{i}") for i in range(len(columns))]
    centres = own.groupBy("series", "pick").agg(F.min("t").alias("_first"), *means)
    centres = centres.select("series", (F.row_number().over(Window.partitionBy("series").orderBy("_first")) - 1).alias("cluster"), F.array(*(f"m{i}" for i in range(len(columns)))).alias("m"))
    gap = F.sqrt(F.aggregate(F.zip_with("x", "m", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))
    return rows.join(centres, "series").select("series", "t", "cluster", gap.alias("distance"))
