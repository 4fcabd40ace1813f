"""How well breaks and labels agree with the truth, and how homogeneous regimes are."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def regime_loss(rows: DataFrame) -> DataFrame:
    """Population variance of each series in each label."""
    return rows.groupBy("series", "label").agg(F.var_pop("value").alias("loss"))


def nearest(truth: DataFrame, found: DataFrame) -> DataFrame:
    """The found break nearest to each true one, the smaller of two; breaks of a series are few."""
    pairs = truth.join(found.select("series", F.col("b").alias("p")), "series")
    return pairs.groupBy("series", "b").agg(F.min_by("p", F.struct(F.abs(F.col("b") - F.col("p")), "p")).alias("near"))


def hausdorff(truth: DataFrame, found: DataFrame, lengths: DataFrame | None = None) -> DataFrame:
    """(series, distance): the largest distance from a true break to its nearest found one.

    With ``lengths`` (series, n) every series has a row: 0 without any break, its length where one side alone is empty.
    """
    out = nearest(truth, found).groupBy("series").agg(F.max(F.abs(F.col("b") - F.col("near"))).alias("distance"))
    if lengths is None:
        return out
    some = truth.select("series").distinct().withColumn("t", F.lit(True)).join(found.select("series").distinct().withColumn("f", F.lit(True)), "series", "full")
    every = lengths.select("series", "n").join(some, "series", "left").join(out, "series", "left")
    alone = F.coalesce("t", F.lit(False)) != F.coalesce("f", F.lit(False))
    return every.select("series", F.when(alone, F.col("n")).otherwise(F.coalesce("distance", F.lit(0))).cast("long").alias("distance"))


def covering(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Of each true interval [lo, hi) the largest share that one found interval covers, weighted by length."""
    p = found.select("series", F.col("lo").alias("plo"), F.col("hi").alias("phi"))
    pairs = truth.join(p, (truth["series"] == p["series"]) & (truth["lo"] < p["phi"]) & (p["plo"] < truth["hi"])).drop(p["series"])
    best = pairs.groupBy("series", "lo", "hi").agg(F.max(F.least("hi", "phi") - F.greatest("lo", "plo")).alias("over"))
    return best.groupBy("series").agg((F.sum("over") / F.sum(F.col("hi") - F.col("lo"))).alias("covering"))


def contingency(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("series", "a", "b").agg(F.count(F.lit(1)).alias("n"))


def adjusted_rand(pairs: DataFrame) -> DataFrame:
    cells = contingency(pairs)
    two = lambda x: F.sum(x * (x - 1) / 2)
    side = lambda k: cells.groupBy("series", k).agg(F.sum("n").alias("n")).groupBy("series").agg(two(F.col("n")).alias(f"s_{k}"))
    both = cells.groupBy("series").agg(two(F.col("n")).alias("s"), F.sum("n").alias("total"))
    out = both.join(side("a"), "series").join(side("b"), "series")
    expected = F.col("s_a") * F.col("s_b") / (F.col("total") * (F.col("total") - 1) / 2)
    top = (F.col("s_a") + F.col("s_b")) / 2 - expected
    return out.select("series", F.when(top == 0, 1.0).otherwise((F.col("s") - expected) / top).alias("ari"))


def information(pairs: DataFrame, beta: float = 1.0) -> DataFrame:
    """Homogeneity, completeness, V-measure (completeness counts ``beta`` times) and normalised mutual information (arithmetic mean)."""
    cells = contingency(pairs)
    of = lambda *k: Window.partitionBy("series", *k)
    cells = cells.withColumns({"na": F.sum("n").over(of("a")), "nb": F.sum("n").over(of("b")), "total": F.sum("n").over(of())})
    side = lambda k: cells.select("series", k, f"n{k}", "total").distinct().groupBy("series").agg((-F.sum(F.col(f"n{k}") / F.col("total") * F.log(F.col(f"n{k}") / F.col("total")))).alias(f"h_{k}"))
    mutual = cells.groupBy("series").agg(F.sum(F.col("n") / F.col("total") * F.log(F.col("n") * F.col("total") / (F.col("na") * F.col("nb")))).alias("mi"))
    out = mutual.join(side("a"), "series").join(side("b"), "series")
    out = out.withColumns({"homogeneity": F.when(F.col("h_a") == 0, 1.0).otherwise(F.col("mi") / F.col("h_a")), "completeness": F.when(F.col("h_b") == 0, 1.0).otherwise(F.col("mi") / F.col("h_b"))})
    h, c = F.col("homogeneity"), F.col("completeness")
    return out.select("series", "homogeneity", "completeness", F.when(beta * h + c == 0, 0.0).otherwise((1 + beta) * h * c / (beta * h + c)).alias("v"), F.when(F.col("h_a") + F.col("h_b") == 0, 1.0).otherwise(2 * F.col("mi") / (F.col("h_a") + F.col("h_b"))).alias("nmi"))


def benjamini_hochberg(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Tests (series, id, p) with ``rejected``: p at or below the largest p(k) that is at most k alpha / m."""
    w = Window.partitionBy("series")
    placed = tests.withColumns({"_k": F.row_number().over(w.orderBy("p", "id")), "_m": F.count(F.lit(1)).over(w)})
    cut = F.max(F.when(F.col("p") <= F.col("_k") * alpha / F.col("_m"), F.col("p"))).over(w)
    return placed.select(*tests.columns, F.coalesce(F.col("p") <= cut, F.lit(False)).alias("rejected"))


def persistence(breaks: DataFrame, runs: DataFrame, tolerance: int, total: int | None = None, low: float | None = None) -> DataFrame:
    """Share of the runs (series, run, b) that have a break within ``tolerance`` of each break: (series, b, persistence).

    ``total`` is the number of runs that ended well, those without a break too; if not given, runs with a break count. With
    ``low``, columns ``runs`` and ``low``, whether the share is below it, follow.
    """
    n = runs.groupBy("series").agg((F.countDistinct("run") if total is None else F.lit(total).cast("long")).alias("runs"))
    hit = _near(breaks, runs, tolerance, "run").groupBy("series", "b").agg(F.countDistinct("run").alias("hits"))
    out = breaks.select("series", "b").join(n, "series").join(hit, ["series", "b"], "left").select("series", "b", (F.coalesce("hits", F.lit(0)) / F.col("runs")).alias("persistence"), "runs")
    return out.drop("runs") if low is None else out.withColumn("low", F.col("persistence") < low)


def _near(breaks: DataFrame, runs: DataFrame, tolerance: int, *held: str) -> DataFrame:
    """(series, b, p, ...): the runs' breaks within ``tolerance`` of each break; each break names the rows it looks at, so the join is by equality."""
    want = breaks.select("series", "b").distinct().withColumn("p", F.explode(F.sequence(F.col("b") - tolerance, F.col("b") + tolerance)))
    return want.join(runs.select("series", F.col("b").cast("long").alias("p"), *held), ["series", "p"])


def bands(breaks: DataFrame, runs: DataFrame, tolerance: int, lengths: DataFrame, level: float = 0.9) -> DataFrame:
    """(series, b, lo, hi): quantiles of the nearest break of each run, if within twice ``tolerance``; without any, the tolerance itself.

    Ends are whole rows within the series (``lengths``: series, n), and hold the break.
    """
    near = _near(breaks, runs, 2 * tolerance, "run").groupBy("series", "b", "run").agg(F.min_by("p", F.struct(F.abs(F.col("p") - F.col("b")), "p")).alias("p"))
    got = near.groupBy("series", "b").agg(F.percentile("p", (1 - level) / 2).alias("l"), F.percentile("p", (1 + level) / 2).alias("h"))
    out = breaks.select("series", "b").join(got, ["series", "b"], "left").join(lengths, "series")
    b, n = F.col("b"), F.col("n")
    none = F.col("l").isNull()  # said first, as least and greatest pass over nulls
    lo = F.when(none, F.greatest(F.lit(1), b - tolerance)).otherwise(F.greatest(F.lit(0), F.least(F.floor(F.round("l", 6)), b)))
    hi = F.when(none, F.least(n - 2, b + tolerance)).otherwise(F.least(n - 1, F.greatest(F.floor(F.round("h", 6)), b)))
    return out.select("series", "b", lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))


def _paired(gain: np.ndarray) -> list[tuple[int, int]]:
    """Rows and columns matched one to one for the largest total, by successive shortest paths with potentials."""
    turned = gain.shape[0] > gain.shape[1]
    cost = -(gain.T if turned else gain).astype(float)
    n, m = cost.shape
    u, v, match = np.zeros(n), np.zeros(m), np.full(m, -1)
    for row in range(n):
        best, came, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        at, col, reach = row, -1, 0.0
        while at >= 0:
            step = reach + cost[at] - u[at] - v
            closer = ~done & (step < best)
            best[closer], came[closer] = step[closer], col
            col = int(np.where(done, np.inf, best).argmin())
            reach, done[col] = best[col], True
            at = match[col]
        u[row] += reach
        for j in np.flatnonzero(done):
            if j != col:
                u[match[j]] += reach - best[j]
            v[j] -= reach - best[j]
        while col >= 0:
            back = came[col]
            match[col] = row if back < 0 else match[back]
            col = back
    pairs = [(int(match[j]), j) for j in range(m) if match[j] >= 0]
    return sorted((j, i) if turned else (i, j) for i, j in pairs)


def temporal_hamming(pairs: DataFrame) -> DataFrame:
    """(series, hamming, annotation_error, accuracy) of labels (series, a, b), b's labels renamed one to one for the best agreement with a.

    A label of b without a partner agrees nowhere. The group of a series is its contingency table, labels by labels.
    """
    kind = pairs.schema["series"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        table = pdf.pivot_table(index="a", columns="b", values="n", fill_value=0).to_numpy(float)
        total, right = float(pdf["n"].sum()), sum(table[i, j] for i, j in _paired(table))
        return pd.DataFrame([(pdf["series"].iat[0], total - right, 1 - right / total, right / total)], columns=["series", "hamming", "annotation_error", "accuracy"])

    return contingency(pairs).groupBy("series").applyInPandas(run, f"series {kind}, hamming double, annotation_error double, accuracy double")


def _assigned(truth: list[int], found: list[int]) -> list[tuple[int, int]]:
    """Pairs of the least total distance, each break once: on a line an optimal assignment keeps the order."""
    a, b = sorted(truth), sorted(found)
    if len(a) > len(b):
        return [(x, y) for y, x in _assigned(b, a)]
    cost = np.full((len(a) + 1, len(b) + 1), np.inf)
    cost[0] = 0
    for i, x in enumerate(a, 1):
        for j in range(i, len(b) + 1):
            cost[i, j] = min(cost[i, j - 1], cost[i - 1, j - 1] + abs(x - b[j - 1]))
    out, j = [], len(b)
    for i in range(len(a), 0, -1):
        while cost[i, j] == cost[i, j - 1]:
            j -= 1
        out.append((a[i - 1], b[j - 1]))
        j -= 1
    return out[::-1]


def matched(truth: DataFrame, found: DataFrame) -> DataFrame:
    """(series, b, near, distance): one-to-one pairs of true and found breaks of the least total distance.

    The breaks of one series are few and go to one group; series are spread.
    """

    def run(own: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        pairs = _assigned(own["b"].drop_duplicates().tolist(), other["b"].drop_duplicates().tolist()) if len(own) and len(other) else []
        return pd.DataFrame([(own["series"].iat[0], x, y, abs(x - y)) for x, y in pairs], columns=["series", "b", "near", "distance"])

    kind = truth.schema["series"].dataType.simpleString()
    both = truth.select("series", "b").groupBy("series").cogroup(found.select("series", "b").groupBy("series"))
    return both.applyInPandas(run, f"series {kind}, b long, near long, distance long")


def detection(truth: DataFrame, found: DataFrame, tolerance: int = 5) -> DataFrame:
    """(series, precision, recall, f1, recovery) of breaks matched one to one within ``tolerance``.

    A series without found breaks scores 0, without true ones too; its recovery is then 1.
    """
    hits = matched(truth, found).where(F.col("distance") <= tolerance).groupBy("series").agg(F.count(F.lit(1)).alias("hits"))
    size = lambda breaks, name: breaks.select("series", "b").distinct().groupBy("series").agg(F.count(F.lit(1)).alias(name))
    all_ = size(truth, "t").join(size(found, "f"), "series", "full").join(hits, "series", "left").na.fill(0, ["t", "f", "hits"])
    share = lambda n: F.when(F.col(n) > 0, F.col("hits") / F.col(n)).otherwise(0.0)
    f1 = F.when(F.col("hits") > 0, 2 * F.col("hits") / (F.col("t") + F.col("f"))).otherwise(0.0)
    recovery = F.when(F.col("t") > 0, F.col("hits") / F.col("t")).otherwise(1.0)
    return all_.select("series", share("f").alias("precision"), share("t").alias("recall"), f1.alias("f1"), recovery.alias("recovery"))
