"""Online change points with keyed state: a series' run lengths live in the state store from batch to batch, and no row is read twice."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class RunLengths:
    """Log probabilities of the rows since the last change, 0 to ``most`` of them, with each run's mean and spread.

    Columns are independent and normal with unknown mean and variance, their predictions normal with the predictive variance; a change is
    weighed by the prior's own prediction of the row, and comes with a constant hazard. The run before the first row has no row; each later one begins with its own.
    """

    def __init__(self, width: int, hazard: float = 0.01, most: int = 250):
        self.hazard, self.most = min(1 - 1e-6, max(1e-6, hazard)), most
        self.logs, self.counts, self.means, self.betas = np.zeros(1), np.zeros(1), np.zeros((1, width)), np.ones((1, width))

    def _predicted(self, x: np.ndarray, means: np.ndarray, counts: np.ndarray, betas: np.ndarray) -> np.ndarray:
        kappa, alpha = 1 + counts[:, None], 1 + 0.5 * counts[:, None]
        var = np.maximum(betas * (kappa + 1) / (alpha * kappa), 1e-8)
        return -0.5 * (np.log(2 * np.pi * var) + (x - means) ** 2 / var).sum(axis=1)

    def update(self, x: np.ndarray) -> float:
        """Take a row in; the probability that it begins a new run."""
        counts, prior = self.counts, (np.zeros((1, len(x))), np.ones((1, len(x))))
        grown = self.logs + math.log(1 - self.hazard) + self._predicted(x, self.means, counts, self.betas)
        new = np.logaddexp.reduce(self.logs) + math.log(self.hazard) + self._predicted(x, prior[0], np.zeros(1), prior[1])[0]
        logs = np.concatenate([[new], grown])[: self.most + 1]
        logs -= np.logaddexp.reduce(logs)
        kappa = 1 + counts[:, None]
        means, betas = (kappa * self.means + x) / (kappa + 1), self.betas + 0.5 * kappa * (x - self.means) ** 2 / (kappa + 1)
        self.means = np.vstack([x[None] / 2, means])[: self.most + 1]
        self.betas = np.vstack([prior[1] + 0.25 * x[None] ** 2, betas])[: self.most + 1]
        self.logs, self.counts = np.maximum(logs, math.log(1e-300)), np.concatenate([[1.0], counts + 1])[: self.most + 1]
        return float(np.exp(self.logs[0]))


class OnlineChanges(StatefulProcessor):
    """Rows of a series wait until the watermark has passed them, then go in order of time through ``RunLengths``."""

    def __init__(self, columns: list[str], hazard: float, threshold: float, least: int, most: int):
        self.columns, self.knobs = columns, (hazard, threshold, least, most)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.runs = handle.getValueState("runs", "n long, last long, seen long, logs array<double>, counts array<double>, means array<double>, betas array<double>")
        self.waiting = handle.getListState("waiting", "at long, x array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = self.runs.get()[2] if self.runs.exists() else -(1 << 62)
        for pdf in rows:
            at = pdf["date"].astype("datetime64[us]").astype("int64") // 1000
            fresh = [(int(a), [float(v) for v in x]) for a, x in zip(at, pdf[self.columns].to_numpy(float), strict=True) if a > seen]  # a row older than the last one taken in is too late
            if fresh:
                self.waiting.appendList(fresh)
                # a timer goes off when the watermark is past it
                self.handle.registerTimer(max(min(a for a, _ in fresh), timerValues.getCurrentWatermarkInMs() + 1))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        rows = sorted((int(a), list(x)) for a, x in self.waiting.get()) if self.waiting.exists() else []
        ready, later = [r for r in rows if r[0] <= mark], [r for r in rows if r[0] > mark]
        out = self._taken(key, ready)
        self.waiting.clear()
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(later[0][0])
        return iter([out] if len(out) else ())

    def _taken(self, key, rows: list[tuple[int, list[float]]]) -> pd.DataFrame:
        hazard, threshold, least, most = self.knobs
        runs, n, last, seen = RunLengths(len(self.columns), hazard, most), 0, -least, -(1 << 62)
        if self.runs.exists():
            n, last, seen, logs, counts, means, betas = self.runs.get()
            runs.logs, runs.counts = np.array(logs), np.array(counts)
            runs.means, runs.betas = np.array(means).reshape(len(logs), -1), np.array(betas).reshape(len(logs), -1)
        out = []
        for at, x in rows:
            if at <= seen:
                continue  # a second row of one time
            p = runs.update(np.array(x))
            if n >= least and p >= threshold and n - last >= least:
                out.append((key[0], pd.Timestamp(at, unit="ms"), n, p))
                last = n
            n, seen = n + 1, at
        if rows:
            self.runs.update((n, last, seen, runs.logs.tolist(), runs.counts.tolist(), runs.means.ravel().tolist(), runs.betas.ravel().tolist()))
        return pd.DataFrame(out, columns=["series", "date", "n", "p"])

    def close(self) -> None:
        pass


def online_changes(rows: DataFrame, columns: list[str] | None = None, late: str = "2 hours", hazard: float = 0.01, threshold: float = 0.5, least: int = 10, most: int = 250) -> DataFrame:
    """(series, date, n, p) of each row of a stream (series, date, columns) that begins a new run with a probability of ``threshold`` or more, ``least`` rows apart; n counts a series' rows from 0.

    A row is taken in once the watermark, ``late`` behind the newest row, has passed it, so rows may come in any order within that time; one that comes later
    still is left out, as is a second row of one time. The state of a series is ``most`` runs and the rows that wait. A table works as well: it is a stream of one batch, whose last
    rows wait for ever. Values should be of unit scale: the prior is a normal one around 0.
    """
    spark, columns = rows.sparkSession, columns or ["value"]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kind = rows.schema["series"].dataType.simpleString()
    own = rows.select("series", F.col("date").cast("timestamp").alias("date"), *(F.col(c).cast("double").alias(c) for c in columns)).withWatermark("date", late)
    return own.groupBy("series").transformWithStateInPandas(OnlineChanges(columns, hazard, threshold, least, most), f"series {kind}, date timestamp, n long, p double", "append", "EventTime")
