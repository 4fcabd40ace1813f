"""State-space models over blocks of rows: hidden Markov models, the jump model, switching regressions and volatilities, no series in one task.

A chain's step from row to row is a small matrix, and steps combine: by sums of products for probabilities, by
maxima of sums for best paths, by composition for the way back along them, by affine maps for recursions. So each block of rows is first
combined to one element, the elements before and after each block are combined from these (``scanned``, in levels), and then
every block runs on its own from what reaches it from both sides. A fit repeats this, a few jobs a round, over blocks written once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import written

SIZE = 512


def blocked(panel: DataFrame, columns: list[str], size: int = SIZE) -> DataFrame:
    """(series, block, t, x): ``size`` rows of a series a row, in order; x holds the columns row after row. Written."""
    rows = panel.select("series", F.col("t").cast("long").alias("t"), F.array(*(F.col(c).cast("double") for c in columns)).alias("x"))
    got = rows.groupBy("series", F.floor(F.col("t") / size).alias("block")).agg(F.sort_array(F.collect_list(F.struct("t", "x"))).alias("r"))
    return written(got.select("series", "block", F.col("r.t").alias("t"), F.flatten("r.x").alias("x")), "rows")


def scanned(totals: DataFrame, combine: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int = SIZE) -> DataFrame:
    """(series, block, before, after): the elements (series, block, m) before and after each block, combined in order; null where there are none.

    Up to ``size`` elements make a group; more are combined to one for each group first, and those scanned in turn.
    """
    totals = written(totals, "totals")
    kind = totals.schema["series"].dataType.simpleString()
    far = totals.withColumn("_group", F.floor(F.col("block") / size))

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        out = None
        for m in pdf.sort_values("block")["m"]:
            out = np.asarray(m) if out is None else combine(out, np.asarray(m))
        return pd.DataFrame({"series": pdf["series"].iat[0], "block": [pdf["_group"].iat[0]], "m": [out]})

    def parts(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        elements = [np.asarray(m) for m in pdf["m"]]
        before, after = [pdf["_before"].iat[0]], [pdf["_after"].iat[0]]
        for m in elements[:-1]:
            before.append(m if before[-1] is None else combine(np.asarray(before[-1]), m))
        for m in elements[:0:-1]:
            after.append(m if after[-1] is None else combine(m, np.asarray(after[-1])))
        return pdf[["series", "block"]].assign(before=before, after=after[::-1])

    if (totals.agg(F.max("block")).first()[0] or 0) < size:
        met = far.withColumns({"_before": F.lit(None).cast("array<double>"), "_after": F.lit(None).cast("array<double>")})
    else:
        outer = scanned(far.groupBy("series", "_group").applyInPandas(whole, f"series {kind}, block long, m array<double>"), combine, size)
        met = far.join(outer.select("series", F.col("block").alias("_group"), F.col("before").alias("_before"), F.col("after").alias("_after")), ["series", "_group"])
    return met.groupBy("series", "_group").applyInPandas(parts, f"series {kind}, block long, before array<double>, after array<double>")


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of two matrices, each with the logarithm of its scale behind it."""
    k = int(np.sqrt(len(a)))
    m = a[:-1].reshape(k, k) @ b[:-1].reshape(k, k)
    s = m.sum() + 1e-300
    return np.append((m / s).ravel(), a[-1] + b[-1] + np.log(s))


def _best(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Best sums by way of any state between."""
    k = int(np.sqrt(len(a)))
    return (a.reshape(k, k)[:, :, None] + b.reshape(k, k)[None]).max(axis=1).ravel()


def _composed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The state before both blocks for each state after them."""
    return a[b.astype(int)]


def _each(rows: DataFrame, of: Callable, schema: str) -> DataFrame:
    """What ``of`` makes of each row: any number of rows of ``schema``."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([row for r in pdf.itertuples() for row in of(r)], columns=names)

    return rows.mapInPandas(run, schema)


@dataclass(frozen=True)
class Gaussian:
    """States with Gaussian rows. Parameters are one list of numbers: start probabilities, transitions by rows, means and covariances of the states."""

    states: int
    width: int
    diagonal: bool = False

    def unpacked(self, params: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        k, p = self.states, self.width
        parts = np.split(np.asarray(params, float), np.cumsum([k, k * k, k * p]))
        return parts[0], parts[1].reshape(k, k), parts[2].reshape(k, p), parts[3].reshape(k, p, p)

    def logs(self, x: np.ndarray, params: np.ndarray) -> np.ndarray:
        """Log density of each row under each state."""
        _, _, means, covs = self.unpacked(params)
        rows, out = np.asarray(x).reshape(-1, self.width), []
        for mean, cov in zip(means, covs, strict=True):
            low = np.linalg.cholesky(cov)
            z = np.linalg.solve(low, (rows - mean).T)
            out.append(-0.5 * (z * z).sum(axis=0) - np.log(np.diag(low)).sum() - 0.5 * len(mean) * np.log(2 * np.pi))
        return np.array(out).T

    def total(self, r) -> np.ndarray:
        """The product of a block's transitions and densities."""
        _, trans, _, _ = self.unpacked(r.params)
        logs = self.logs(r.x, r.params)
        top = logs.max(axis=1)
        like, m, scale = np.exp(logs - top[:, None]), np.eye(self.states), top.sum()
        for t in range(len(like)):
            m = (m if t == 0 and r.block == 0 else m @ trans) * like[t]
            s = m.sum() + 1e-300
            m, scale = m / s, scale + np.log(s)
        return np.append(m.ravel(), scale)

    def smooth(self, r) -> tuple[np.ndarray, np.ndarray, float]:
        """A block's posteriors, its expected transitions (that into its first row too), and its part of the log likelihood."""
        k = self.states
        start, trans, _, _ = self.unpacked(r.params)
        logs = self.logs(r.x, r.params)
        top = logs.max(axis=1)
        like, n = np.exp(logs - top[:, None]), len(logs)
        a = start if r.before is None else start @ np.asarray(r.before)[:-1].reshape(k, k)
        a = a / (a.sum() + 1e-300)
        back = np.ones(k) if r.after is None else np.asarray(r.after)[:-1].reshape(k, k).sum(axis=1)
        # what comes after begins with a transition, so it weighs the states at the block's last row
        fwd, bwd, score, entry = np.empty((n, k)), np.empty((n, k)), top.sum(), a
        for t in range(n):
            a = (a if t == 0 and r.block == 0 else a @ trans) * like[t]
            s = a.sum() + 1e-300
            a, score = a / s, score + np.log(s)
            fwd[t] = a
        bwd[-1] = back / (back.sum() + 1e-300)
        for t in range(n - 2, -1, -1):
            b = trans @ (like[t + 1] * bwd[t + 1])
            bwd[t] = b / (b.sum() + 1e-300)
        post = fwd * bwd
        post /= post.sum(axis=1, keepdims=True) + 1e-300
        first = 1 if r.block == 0 else 0
        came = np.vstack([entry[None], fwd[:-1]])[first:]
        went = (like * bwd)[first:]
        weight = np.einsum("ti,ij,tj->t", came, trans, went) + 1e-300
        return post, trans * ((came / weight[:, None]).T @ went), score

    def sums(self, r) -> np.ndarray:
        """What a block adds to the next parameters: its first row's posteriors, moves, and the weighted moments of its rows; its score last."""
        post, moves, score = self.smooth(r)
        x = np.asarray(r.x).reshape(-1, self.width)
        second = np.einsum("tk,ti,tj->kij", post, x, x)
        return np.concatenate([post[0] if r.block == 0 else np.zeros(self.states), moves.ravel(), post.sum(axis=0), (post.T @ x).ravel(), second.ravel(), [score]])

    def fitted(self, sums: np.ndarray, floor: float) -> tuple[np.ndarray, float]:
        """The parameters that all blocks' sums make most likely, and the score of those before."""
        k, p = self.states, self.width
        first, moves, mass, one, two, score = np.split(np.asarray(sums), np.cumsum([k, k * k, k, k * p, k * p * p]))
        start, moves, mass = first + 1e-9, moves.reshape(k, k) + 1e-6, mass + 1e-9
        means = one.reshape(k, p) / mass[:, None]
        covs = two.reshape(k, p, p) / mass[:, None, None] - means[:, :, None] * means[:, None]
        if self.diagonal:
            covs = covs * np.eye(p)
        values, vectors = np.linalg.eigh((covs + covs.transpose(0, 2, 1)) / 2)
        covs = (vectors * np.maximum(values, floor)[:, None]) @ vectors.transpose(0, 2, 1)
        return np.concatenate([start / start.sum(), (moves / moves.sum(axis=1, keepdims=True)).ravel(), means.ravel(), covs.ravel()]), float(score[0])


@dataclass
class Chain:
    """A model of the rows of every series: blocks of rows, and each series' parameters (series, params, score)."""

    blocks: DataFrame
    params: DataFrame
    law: Gaussian

    def met(self) -> DataFrame:
        return self.blocks.join(self.params.select("series", "params"), "series")

    @property
    def kind(self) -> str:
        return self.blocks.schema["series"].dataType.simpleString()

    def reached(self) -> DataFrame:
        """Blocks with what reaches them from before and after, as products of transitions and densities."""
        law, met = self.law, self.met()
        totals = _each(met, lambda r: [(r.series, r.block, law.total(r))], f"series {self.kind}, block long, m array<double>")
        return met.join(scanned(totals, _product), ["series", "block"])

    def posteriors(self) -> DataFrame:
        """(series, t, p1 ..): the probability of each state at each row, given all rows."""
        law = self.law
        columns = ", ".join([f"series {self.kind}", "t long", *(f"p{i + 1} double" for i in range(law.states))])
        return _each(self.reached(), lambda r: [(r.series, t, *row) for t, row in zip(r.t, law.smooth(r)[0], strict=True)], columns)

    def step(self, floor: float) -> Chain:
        """One round of expectation and maximisation."""
        law, k, p = self.law, self.law.states, self.law.width
        sums = _each(self.reached(), lambda r: [(r.series, law.sums(r))], f"series {self.kind}, s array<double>")
        size = k + k * k + k + k * p + k * p * p + 1
        sums = sums.groupBy("series").agg(F.array(*(F.sum(F.col("s")[i]) for i in range(size))).alias("s"))
        fitted = _each(sums, lambda r: [(r.series, *law.fitted(r.s, floor))], f"series {self.kind}, params array<double>, score double")
        return replace(self, params=written(fitted, "params"))

    def path(self) -> DataFrame:
        """(series, t, label): the most likely states all together."""
        law = self.law

        def scores(r):
            start, trans, _, _ = law.unpacked(r.params)
            with np.errstate(divide="ignore"):
                return np.log(start), np.log(trans), law.logs(r.x, r.params)

        return best_path(self.met(), scores)


def best_path(met: DataFrame, scores: Callable) -> DataFrame:
    """(series, t, label) of the path with the greatest sum of start, move and row scores (``scores`` of a block); of equal ones, lower states first."""

    def total(r):
        start, moves, own = scores(r)
        m = np.where(np.eye(len(start), dtype=bool), 0.0, -np.inf)
        for t in range(len(own)):
            m = (m if t == 0 and r.block == 0 else (m[:, :, None] + moves[None]).max(axis=1)) + own[t]
        return [(r.series, r.block, m.ravel())]

    def forward(r) -> tuple[np.ndarray, np.ndarray]:
        """Best scores at the block's end, and for each row and state the state before it."""
        start, moves, own = scores(r)
        k = len(start)
        at = start if r.before is None else (start[:, None] + np.asarray(r.before).reshape(k, k)).max(axis=0)
        back = np.zeros(own.shape, int)
        for t in range(len(own)):
            if t == 0 and r.block == 0:
                at, back[t] = at + own[t], np.arange(k)
                continue
            ways = at[:, None] + moves
            back[t] = ways.argmax(axis=0)
            at = ways[back[t], np.arange(k)] + own[t]
        return at, back

    def way_back(r):
        at, back = forward(r)
        state = np.arange(len(at)) if r.after is not None else np.full(len(at), at.argmax())
        for row in back[::-1]:
            state = row[state]
        return [(r.series, r.block, state.astype(float))]

    def traced(r):
        at, back = forward(r)
        state = int(at.argmax()) if r.later is None else int(r.later[0])
        out = np.empty(len(back), int)
        for t in range(len(back) - 1, -1, -1):
            out[t] = state
            state = back[t, state]
        return [(r.series, int(t), int(s)) for t, s in zip(r.t, out, strict=True)]

    kind = met.schema["series"].dataType.simpleString()
    element = f"series {kind}, block long, m array<double>"
    reached = written(met.join(scanned(_each(met, total, element), _best), ["series", "block"]), "reached")
    later = scanned(_each(reached, way_back, element), _composed).select("series", "block", F.col("after").alias("later"))
    return _each(reached.join(later, ["series", "block"]), traced, f"series {kind}, t long, label int")


def numbered(labels: DataFrame) -> DataFrame:
    """Labels (series, t, label) numbered from 0 by the first row of each within its series."""
    first = labels.groupBy("series", "label").agg(F.min("t").alias("_first"))
    place = first.withColumn("_new", F.row_number().over(Window.partitionBy("series").orderBy("_first")) - 1).drop("_first")
    return labels.join(place, ["series", "label"]).select("series", "t", F.col("_new").cast("int").alias("label"))


def starting(panel: DataFrame, columns: list[str], states: int, floor: float = 1e-2, stay: float = 0.9) -> DataFrame:
    """(series, params) to begin a fit from: rows in as many bins of the first column's quantiles as there are states, whose means and covariances they give."""
    cuts = panel.groupBy("series").agg(F.percentile_approx(columns[0], [i / states for i in range(1, states)] or [0.5], 10_000).alias("_cuts"))
    bins = F.size(F.filter("_cuts", lambda c: F.col(columns[0]) > c)) if states > 1 else F.lit(0)
    v = [F.col(c).cast("double") for c in columns]
    own = panel.join(cuts, "series").withColumn("_bin", bins)
    stats = own.groupBy("series", "_bin").agg(F.array(*(F.avg(c) for c in v)).alias("mean"), F.array(*(F.covar_pop(a, b) for a in v for b in v)).alias("cov"))
    whole = panel.groupBy("series").agg(F.array(*(F.avg(c) for c in v)).alias("mean"), F.array(*(F.covar_pop(a, b) for a in v for b in v)).alias("cov"))
    every = stats.union(whole.select("series", F.lit(-1).alias("_bin"), "mean", "cov")).groupBy("series").agg(F.map_from_entries(F.collect_list(F.struct("_bin", F.struct("mean", "cov")))).alias("of"))
    p = len(columns)
    one = lambda i, name: F.coalesce(F.try_element_at("of", F.lit(i)), F.try_element_at("of", F.lit(-1)))[name]
    eye = F.array(*(F.lit(floor if i % (p + 1) == 0 else 0.0) for i in range(p * p)))
    away = (1 - stay) / max(1, states - 1)
    moves = [(stay if states > 1 else 1.0) if i % (states + 1) == 0 else away for i in range(states * states)]
    parts = [F.array(*(F.lit(1 / states) for _ in range(states))), F.array(*map(F.lit, moves)), *(one(i, "mean") for i in range(states)), *(F.zip_with(one(i, "cov"), eye, lambda a, b: a + b) for i in range(states))]
    return every.select("series", F.concat(*parts).alias("params"))


def hidden_markov(panel: DataFrame, columns: list[str] | None = None, states: int = 3, rounds: int = 100, tolerance: float = 1e-2, floor: float = 1e-2, diagonal: bool = False, size: int = SIZE, begin: DataFrame | None = None) -> Chain:
    """A hidden Markov model with Gaussian states of full (or ``diagonal``) covariance for every series, fitted by Baum and Welch.

    All series take rounds together until no log likelihood gains ``tolerance`` any more, ``rounds`` at most. Eigenvalues of a covariance are held
    at ``floor`` or above. The fit begins from ``starting``, or from given parameters (series, params).
    """
    columns = columns or ["value"]
    params = written(starting(panel, columns, states, floor) if begin is None else begin, "params")
    chain, had = Chain(blocked(panel, columns, size), params, Gaussian(states, len(columns), diagonal)), None
    for _ in range(rounds):
        chain = chain.step(floor)
        has = chain.params.select("series", "score")
        if had is not None:
            gain = has.join(had.withColumnRenamed("score", "_had"), "series").agg(F.max(F.col("score") - F.col("_had"))).first()[0]
            if gain is None or gain < tolerance:
                break
        had = has
    return chain


def jump_model(panel: DataFrame, columns: list[str] | None = None, states: int = 3, penalty: float = 5.0, rounds: int = 20, size: int = SIZE) -> DataFrame:
    """(series, t, label): rows assigned to means at a price for each jump; assignment and means take turns until neither moves, ``rounds`` times at most.

    Columns are standardised in each series. The first assignment is by quantiles of the first column; a mean that no row has keeps its place.
    """
    columns = columns or ["value"]
    spread = panel.groupBy("series").agg(*(F.avg(c).alias(f"_m{i}") for i, c in enumerate(columns)), *(F.stddev_pop(c).alias(f"_s{i}") for i, c in enumerate(columns)))
    own = panel.join(spread, "series").select("series", "t", *(((F.col(c) - F.col(f"_m{i}")) / (F.col(f"_s{i}") + 1e-12)).alias(f"_z{i}") for i, c in enumerate(columns)))
    own, names, p = written(own, "standard"), [f"_z{i}" for i in range(len(columns))], len(columns)
    blocks = blocked(own, names, size)
    centres = written(starting(own, names, states).select("series", F.slice("params", states + states * states + 1, states * p).alias("params")), "centres")

    def scores(r):
        centre, x = np.asarray(r.params).reshape(states, p), np.asarray(r.x).reshape(-1, p)
        return np.zeros(states), -penalty * (1 - np.eye(states)), -((x[:, None] - centre) ** 2).sum(axis=2)

    path = None
    for _ in range(rounds):
        new = written(best_path(blocks.join(centres, "series"), scores), "path")
        if path is not None and new.join(path.withColumnRenamed("label", "_was"), ["series", "t"]).where("label <> _was").isEmpty():
            break
        path = new
        means = own.join(path, ["series", "t"]).groupBy("series", "label").agg(F.array(*(F.avg(c) for c in names)).alias("mean"))
        told = means.groupBy("series").agg(F.map_from_entries(F.collect_list(F.struct("label", "mean"))).alias("of")).join(centres.withColumnRenamed("params", "_had"), "series")
        at = [F.coalesce(F.try_element_at("of", F.lit(i)), F.slice("_had", i * p + 1, p)) for i in range(states)]
        centres = written(told.select("series", F.concat(*at).alias("params")), "centres")
    return numbered(path)


def switching_regression(panel: DataFrame, column: str = "value", states: int = 2, **knobs) -> DataFrame:
    """(series, t, p1 .., label): smoothed probabilities of regimes with their own mean and variance of one column, and the likeliest regime of each row, numbered by first row."""
    chain = hidden_markov(panel, [column], states, **knobs)
    post = written(chain.posteriors(), "posteriors")
    names = [f"p{i + 1}" for i in range(states)]
    top = post.select("series", "t", F.array_position(F.array(*names), F.greatest(*names) if states > 1 else F.col("p1")).alias("label"))
    return post.join(numbered(top.withColumn("label", F.col("label") - 1)), ["series", "t"])


def switching_autoregression(panel: DataFrame, columns: list[str] | None = None, states: int = 2, lags: int = 1, least: int = 5, **knobs) -> DataFrame:
    """(series, t, label): a hidden Markov model with diagonal covariance of rows and their lags; the first rows have the first label, and runs shorter than ``least`` are given away."""
    from .detectors import smoothed

    columns = columns or ["value"]
    w = Window.partitionBy("series").orderBy("t")
    stacked = [f"{c}_{k}" for k in range(lags + 1) for c in columns]
    rows = panel.select("series", "t", *(F.lag(c, k).over(w).alias(f"{c}_{k}") for k in range(lags + 1) for c in columns)).where(F.col("t") >= lags)
    path = written(hidden_markov(rows.withColumn("t", F.col("t") - lags), stacked, states, diagonal=True, **knobs).path(), "path")
    first = path.where("t = 0").select("series", F.explode(F.sequence(F.lit(0), F.lit(lags - 1)).cast("array<bigint>")).alias("t"), "label") if lags else path.limit(0)
    return numbered(smoothed(path.withColumn("t", F.col("t") + lags).union(first), least))


def hmm_labels(panel: DataFrame, columns: list[str] | None = None, states: int = 3, **knobs) -> DataFrame:
    """(series, t, label): most likely states of a hidden Markov model, numbered by first row."""
    return numbered(hidden_markov(panel, columns, states, **knobs).path())
