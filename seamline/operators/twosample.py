"""Two-sample statistics of the rows left and right of a break, as pair aggregates, and permutation tests in numpy.

Samples are windows, so the pairs of a break are bounded by the square of its width.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def windows(panel: DataFrame, breaks: DataFrame, width: int = 40, lag: int = 5) -> DataFrame:
    """(series, label, t, side, value) of the rows [b-lag-w, b-lag) and [b+lag, b+lag+w); label is the break.

    Each break names the rows that it needs, and these meet the panel by series and row.
    """
    offsets = [*range(-lag - width, -lag), *range(lag, lag + width)]
    want = breaks.select("series", F.col("b").alias("label"), F.explode(F.array(*map(F.lit, offsets))).alias("_d")).withColumn("t", (F.col("label") + F.col("_d")).cast(panel.schema["t"].dataType))
    rows = want.join(panel.select("series", "t", "value"), ["series", "t"])
    return rows.select("series", "label", "t", (F.col("_d") >= 0).cast("int").alias("side"), "value")


def rolling_windows(panel: DataFrame, width: int = 40, lag: int = 5) -> DataFrame:
    """The samples of ``windows`` at every row with whole windows to both sides; each row goes to the 2 ``width`` labels that it serves."""
    w = Window.partitionBy("series")
    rows = panel.select("series", F.col("t").cast("long").alias("t"), "value", F.max("t").over(w).alias("_last"))
    offsets = [*range(-lag - width, -lag), *range(lag, lag + width)]
    rows = rows.withColumn("_d", F.explode(F.array(*map(F.lit, offsets)))).withColumn("label", F.col("t") - F.col("_d"))
    rows = rows.where((F.col("label") >= lag + width) & (F.col("label") + lag + width - 1 <= F.col("_last")))
    return rows.select("series", "label", "t", (F.col("_d") >= 0).cast("int").alias("side"), "value")


def _pairs(samples: DataFrame) -> DataFrame:
    other = samples.select("series", "label", F.col("t").alias("t2"), F.col("side").alias("s2"), F.col("value").alias("v2"))
    return samples.join(other, ["series", "label"])


def mmd(samples: DataFrame, gamma: float, unbiased: bool = False) -> DataFrame:
    """Squared maximum mean discrepancy under a Gaussian kernel: (series, label, stat)."""
    p = _pairs(samples).withColumn("k", F.exp(-gamma * (F.col("value") - F.col("v2")) * (F.col("value") - F.col("v2"))))
    if unbiased:
        p = p.where("t <> t2")
    mean = lambda i, j: F.avg(F.when((F.col("side") == i) & (F.col("s2") == j), F.col("k")))
    return p.groupBy("series", "label").agg((mean(0, 0) + mean(1, 1) - 2 * mean(0, 1)).alias("stat"))


def mmd_linear(samples: DataFrame, gamma: float) -> DataFrame:
    """The linear-time estimate from disjoint pairs of neighbours on both sides."""
    w = Window.partitionBy("series", "label", "side").orderBy("t")
    placed = samples.withColumn("k", F.row_number().over(w) - 1)
    both = placed.groupBy("series", "label", "k").agg(*(F.max(F.when(F.col("side") == s, F.col("value"))).alias(n) for s, n in ((0, "x"), (1, "y"))))
    step = Window.partitionBy("series", "label").orderBy("k")
    both = both.withColumns({"x2": F.lead("x").over(step), "y2": F.lead("y").over(step)}).where("k % 2 = 0 and x is not null and y is not null and x2 is not null and y2 is not null")
    k = lambda a, b: F.exp(-gamma * (F.col(a) - F.col(b)) * (F.col(a) - F.col(b)))
    return both.groupBy("series", "label").agg(F.avg(k("x", "x2") + k("y", "y2") - k("x", "y2") - k("x2", "y")).alias("stat"))


def kolmogorov_smirnov(samples: DataFrame) -> DataFrame:
    """Largest gap of the two empirical distributions; as in SQL, nulls are the largest values, and a break with rows to one side only has NaN."""
    cell = Window.partitionBy("series", "label")
    up = cell.orderBy(F.asc_nulls_last("value")).rangeBetween(Window.unboundedPreceding, 0)
    count = lambda s: F.sum((F.col("side") == s).cast("int"))
    share = lambda s: F.coalesce(F.try_divide(count(s).over(up), count(s).over(cell)), F.lit(float("nan")))
    return samples.withColumn("gap", F.abs(share(0) - share(1))).groupBy("series", "label").agg(F.max("gap").alias("stat"))


def hotelling(samples: DataFrame) -> DataFrame:
    """T squared of one dimension, with the pooled variance."""
    side = lambda f, s: f(F.when(F.col("side") == s, F.col("value")))
    g = samples.groupBy("series", "label").agg(*(side(f, s).alias(f"{n}{s}") for s in (0, 1) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))))
    pooled = ((F.col("n0") - 1) * F.col("v0") + (F.col("n1") - 1) * F.col("v1")) / (F.col("n0") + F.col("n1") - 2) + 1e-6
    gap = F.col("m0") - F.col("m1")
    return g.select("series", "label", (F.col("n0") * F.col("n1") / (F.col("n0") + F.col("n1")) * gap * gap / pooled).alias("stat"))


def median_gammas(rows: DataFrame, key: list[str], columns: list[str], order: str = "t") -> DataFrame:
    """(key, gamma): 1 / (2 m^2), m the median distance of all pairs of a key's rows, those of a row with itself too; for samples, as pairs are quadratic."""
    x = F.array(*(F.col(c).cast("double") for c in columns))
    a, b = rows.select(*key, x.alias("_x")), rows.select(*key, x.alias("_y"))
    d = F.sqrt(F.aggregate(F.zip_with("_x", "_y", lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, v: s + v))
    mid = F.greatest(F.percentile(d, 0.5), F.lit(1e-8))
    return a.join(b, key).groupBy(*key).agg((1 / (2 * mid * mid)).alias("gamma"))


def median_gamma(x: np.ndarray) -> float:
    """1 / (2 median^2) over all pairwise distances, the zeros of the diagonal among them."""
    d = np.sqrt(np.maximum(0, ((x[:, None] - x[None]) ** 2).sum(axis=2)))
    return 1 / (2 * max(float(np.median(d)), 1e-8) ** 2)


def _gram(x: np.ndarray) -> np.ndarray:
    return np.exp(-median_gamma(x) * ((x[:, None] - x[None]) ** 2).sum(axis=2))


def _distance(x: np.ndarray) -> np.ndarray:
    return -np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))


def _within(k: np.ndarray, a: np.ndarray, b: np.ndarray) -> float:
    return float(k[np.ix_(a, a)].mean() + k[np.ix_(b, b)].mean() - 2 * k[np.ix_(a, b)].mean())


def _unbiased(k: np.ndarray, a: np.ndarray, b: np.ndarray) -> float:
    mean = lambda i: (k[np.ix_(i, i)].sum() - k[i, i].sum()) / max(1, len(i) * (len(i) - 1))
    return float(mean(a) + mean(b) - 2 * k[np.ix_(a, b)].mean())


def _linear(k: np.ndarray, a: np.ndarray, b: np.ndarray) -> float:
    n = min(len(a), len(b)) // 2 * 2
    a1, a2, b1, b2 = a[:n:2], a[1:n:2], b[:n:2], b[1:n:2]
    return float((k[a1, a2] + k[b1, b2] - k[a1, b2] - k[a2, b1]).mean()) if n else 0.0


#: Statistics that a permutation test judges: the kernel of the pooled rows, and the statistic of two index lists.
PERMUTED = {"mmd": (_gram, _within), "mmd_unbiased": (_gram, _unbiased), "mmd_linear": (_gram, _linear), "energy": (_distance, _within)}
#: Other names: (kind, rounds or None for those given).
ALIASES = {"mmd_no_ts": ("mmd", None), "mmd_ts": ("mmd", None), "mmd_perm": ("mmd", 100), "mmd_biased": ("mmd", None)}
KINDS = (*PERMUTED, "mcusum", "hotelling", "ks", *ALIASES)


def permutation_test(left: np.ndarray, right: np.ndarray, kind: str = "mmd", rounds: int = 50, seed: int = 0) -> tuple[float, float]:
    """Statistic and p value, the share of shuffles that reach it, the given order counted as one."""
    x, n = np.vstack([left, right]), len(left)
    if kind == "mcusum":
        stat = lambda order: crosier(x[order[:n]], x[order[n:]])
    else:
        kernel, of = PERMUTED[kind]
        k = kernel(x)
        stat = lambda order: of(k, order[:n], order[n:])
    rng = np.random.default_rng(seed)
    own = stat(np.arange(len(x)))
    above = sum(stat(rng.permutation(len(x))) >= own - 1e-12 for _ in range(rounds))
    return own, (above + 1) / (rounds + 1)


def crosier(left: np.ndarray, right: np.ndarray, slack: float = 0.5) -> float:
    """Largest norm of the multivariate CUSUM of all rows, whitened by the left ones."""
    centre = left.mean(axis=0)
    values, vectors = np.linalg.eigh(np.atleast_2d(np.cov(left.T)) + 1e-6 * np.eye(left.shape[1]))
    z = (np.vstack([left, right]) - centre) @ (vectors / np.sqrt(np.maximum(values, 1e-8)) @ vectors.T)
    c, most = np.zeros(left.shape[1]), 0.0
    for row in z:
        s = c + row
        size = float(np.sqrt(s @ s))
        c = np.zeros_like(s) if size <= slack else s * (1 - slack / size)
        most = max(most, float(np.sqrt(c @ c)))
    return most


def _leading(x: np.ndarray, most: int) -> np.ndarray:
    """Scores of at most ``most`` principal components."""
    c = x - x.mean(axis=0)
    u, s, _ = np.linalg.svd(c, full_matrices=False)
    return (u * s)[:, :most]


def hotelling_test(left: np.ndarray, right: np.ndarray, most: int = 5) -> tuple[float, float]:
    """T squared with the pooled covariance and its tail by the F law; more columns than ``most`` are reduced to as many components."""
    n, m = len(left), len(right)
    x = np.vstack([left, right])
    target = max(1, min(most, x.shape[1], n - 1, m - 1))
    if x.shape[1] > target:
        x = _leading(x, target)
    a, b, p = x[:n], x[n:], x.shape[1]
    cov = ((n - 1) * np.atleast_2d(np.cov(a.T)) + (m - 1) * np.atleast_2d(np.cov(b.T))) / (n + m - 2) + 1e-6 * np.eye(p)
    gap = a.mean(axis=0) - b.mean(axis=0)
    t2 = max(0.0, float(n * m / (n + m) * gap @ np.linalg.pinv(cov) @ gap))
    rest = n + m - p - 1
    return t2, f_tail(rest / (p * (n + m - 2)) * t2, p, rest) if rest > 0 and t2 > 0 else 1.0


def ks_tail(gap: float, n: int, m: int) -> float:
    """Exact chance of a gap of two empirical distributions at least this large, by the lattice paths that stay within it."""
    at, most = np.arange(m + 1), gap - 1e-9
    ways = (at / m < most).cumprod().astype(float)
    for i in range(1, n + 1):
        # each step keeps the share of paths: i of the next i + j steps came from the left sample
        inside, row = np.abs(i / n - at / m) < most, np.zeros(m + 1)
        for j in range(m + 1):
            if inside[j]:
                row[j] = ways[j] * i / (i + j) + (row[j - 1] * j / (i + j) if j else 0.0)
        ways = row
    return float(min(1.0, max(0.0, 1 - ways[m])))


def ks_test(left: np.ndarray, right: np.ndarray, most: int = 3) -> tuple[float, float]:
    """Largest gap and smallest p value over at most three components of the pooled rows, without correction."""
    n, m = len(left), len(right)
    x = _leading(np.vstack([left, right]), most)
    gaps = []
    for col in x.T:
        grid = np.sort(col)
        gaps.append(float(np.abs(np.searchsorted(np.sort(col[:n]), grid, "right") / n - np.searchsorted(np.sort(col[n:]), grid, "right") / m).max()))
    return max(gaps), min(ks_tail(g, n, m) for g in gaps)


def two_sample(left: np.ndarray, right: np.ndarray, kind: str = "mmd", rounds: int = 50) -> tuple[float, float]:
    """Statistic and p value of a named test; fewer than five rows to a side give (0, 1)."""
    if kind not in KINDS:
        raise ValueError(f"unknown test {kind!r}")
    if min(len(left), len(right)) < 5:
        return 0.0, 1.0
    kind, fixed = ALIASES.get(kind, (kind, None))
    if kind == "hotelling":
        return hotelling_test(left, right)
    return ks_test(left, right) if kind == "ks" else permutation_test(left, right, kind, fixed or rounds)


def test_samples(samples: DataFrame) -> DataFrame:
    """(series, run, label, stat, p) of samples (series, run, label, t, side, x, kind, rounds); each break is a task of its own."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        a, b = (np.array(pdf.loc[pdf["side"] == s, "x"].tolist(), float) for s in (0, 1))
        stat, p = two_sample(a, b, pdf["kind"].iat[0], int(pdf["rounds"].iat[0]))
        return pd.DataFrame({"series": pdf["series"].iat[0], "run": pdf["run"].iat[0], "label": [pdf["label"].iat[0]], "stat": [stat], "p": [p]})

    return samples.groupBy("series", "run", "label").applyInPandas(run, "series string, run string, label long, stat double, p double")


def differences(panel: DataFrame, columns: tuple[str, ...] = ("value",)) -> DataFrame:
    """First differences of each series, its first row left out."""
    w = Window.partitionBy("series").orderBy("t")
    return panel.withColumns({c: F.col(c) - F.lag(c).over(w) for c in columns}).where(F.col(columns[0]).isNotNull())


def test_breaks(panel: DataFrame, breaks: DataFrame, kind: str = "mmd", width: int = 40, lag: int = 5, rounds: int = 50, alpha: float = 0.05) -> DataFrame:
    """(series, b, stat, p, accepted) of each break by a named test; ``mmd_ts`` and ``mmd_perm`` look at differences. A break without rows to both sides gives no row."""
    rows = differences(panel) if kind in ("mmd_ts", "mmd_perm") else panel
    near = windows(rows, breaks, width, lag).select("series", F.lit("").alias("run"), "label", "t", "side", F.array("value").alias("x"), F.lit(kind).alias("kind"), F.lit(rounds).alias("rounds"))
    return test_samples(near).select("series", F.col("label").alias("b"), "stat", "p", (F.col("p") < alpha).alias("accepted"))


def f_tail(x: float, d1: int, d2: int) -> float:
    """Upper tail of the F law by the continued fraction of the incomplete beta function."""
    if x <= 0:
        return 1.0
    a, b, z = d2 / 2, d1 / 2, d2 / (d2 + d1 * x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(z) + b * math.log1p(-z))
    if z > (a + 1) / (a + b + 2):
        return 1 - f_tail(1 / x, d2, d1)
    f = c = 1.0
    d = 1 - (a + b) * z / (a + 1)
    d = f = 1 / d
    for m in range(1, 200):
        for num in (m * (b - m) * z / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * z / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + num * d), 1 + num / c
            f *= c * d
        if abs(c * d - 1) < 1e-12:
            break
    return front * f / a
