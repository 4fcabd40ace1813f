"""Online change points: the run lengths against a plain recursion, and a stream in batches against one pass."""

import datetime as dt
import math

import numpy as np
import pytest

from seamline.operators import search
from seamline.streaming import stateful


def plain_changes(x, hazard=0.01, most=250):
    """P(new run) at each row, run by run in plain loops; a run is (log probability, rows)."""

    def predicted(row, seen):
        total = 0.0
        for j, v in enumerate(row):
            mu, kappa, alpha, beta = 0.0, 1.0, 1.0, 1.0
            for s in seen:
                beta += kappa * (s[j] - mu) ** 2 / (2 * (kappa + 1))
                mu, kappa, alpha = (kappa * mu + s[j]) / (kappa + 1), kappa + 1, alpha + 0.5
            var = max(beta * (kappa + 1) / (alpha * kappa), 1e-8)
            total -= 0.5 * (math.log(2 * math.pi * var) + (v - mu) ** 2 / var)
        return total

    runs, out = [(0.0, [])], []
    for row in x:
        new = [(np.logaddexp.reduce([p for p, _ in runs]) + math.log(hazard) + predicted(row, []), [row])]
        new += [(p + math.log(1 - hazard) + predicted(row, seen), [*seen, row]) for p, seen in runs]
        total = np.logaddexp.reduce([p for p, _ in new[: most + 1]])
        runs = [(p - total, seen) for p, seen in new[: most + 1]]
        out.append(math.exp(runs[0][0]))
    return out


@pytest.mark.parametrize("most", [250, 12])
def test_run_lengths_are_the_plain_ones(most):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 0.3, (30, 2)), rng.normal((2, -2), 0.3, (20, 2))])
    runs = stateful.RunLengths(2, most=most)
    assert [runs.update(row) for row in x] == pytest.approx(plain_changes(x, most=most), abs=1e-9)


def test_changes_are_found_and_noise_is_quiet():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(2, 0.1, 80), rng.normal(-0.5, 0.1, 80)])[:, None]
    assert search.online_bayes(x)[:1] == [80] or abs(search.online_bayes(x)[0] - 80) <= 1
    assert search.online_bayes(np.zeros((60, 1))) == [] and search.online_bayes(x[:15]) == []
    assert search.online_bayes(x[:120]) == [b for b in search.online_bayes(x) if b < 110]


def test_a_stream_in_batches_is_one_pass(spark, tmp_path):
    rng, start = np.random.default_rng(4), dt.datetime(2024, 1, 1)
    values = {s: np.concatenate([rng.normal(m, 0.1, 40) for m in means]) for s, means in {"a": (2, -0.4, 2), "b": (-1, 1.5, 0.2)}.items()}
    rows = [(s, start + dt.timedelta(hours=t), float(v)) for s, x in values.items() for t, v in enumerate(x)]
    rows.sort(key=lambda r: r[1] + dt.timedelta(minutes=float(rng.integers(-80, 80))))  # out of order within the watermark's reach
    late = ("a", start + dt.timedelta(hours=3), 99.0)
    for k, part in enumerate([rows[:70], rows[70:71] * 2 + rows[71:150], [late, *rows[150:]]]):
        spark.createDataFrame(part, "series string, date timestamp, value double").coalesce(1).write.parquet(f"{tmp_path}/in/part={k}")
    stream = spark.readStream.schema("series string, date timestamp, value double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/part=*")
    out = stateful.online_changes(stream, late="3 hours")
    query = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(300)
    got = sorted((r["series"], r["n"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    want = []
    for s, x in values.items():
        last = -10
        for n, p in enumerate(plain_changes(x[:117, None])):  # the last three hours still wait
            if n >= 10 and p >= 0.5 and n - last >= 10:
                want.append((s, n))
                last = n
    assert got == sorted(want) and len(got) >= 3
