"""Registered queries of exact searches, kernel costs and chains, and the same in SQL where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .operators import chains, density, dynamic, maps, search, transport, volatility
from .plans import detection, refinement
from .queries import DAILY, curves, daily, hourly, query, r6
from .sources.scratch import shared_dir, written
from .streaming import functions, stateful

TENORS = [f"Y00{k}p0" for k in range(1, 6)]


def _layers(breaks: int) -> str:
    """Costs of all segments of ``daily`` on the jump grid, and the least costs d0 .. of so many breaks to each row, with the breaks."""
    steps = [
        DAILY,
        "x as (select series, t, value - avg(value) over (partition by series) as v, count(*) over (partition by series) as n from daily)",
        "s as (select series, t + 1 as t, n, sum(v) over w as s, sum(v * v) over w as q from x window w as (partition by series order by t))",
        "g as (select series, t, n, s, q from s where t % 5 = 0 or t = n union all select series, 0, any_value(n), 0, 0 from s group by series)",
        "c as materialized (select a.series, a.t as s, b.t as e, b.n, b.q - a.q - (b.s - a.s) * (b.s - a.s) / (b.t - a.t) as cost from g a join g b on a.series = b.series and b.t - a.t >= 10)",
        "d0 as (select series, e, n, cost as f, []::bigint[] as path from c where s = 0)",
    ]
    steps += [f"d{k} as materialized (select c.series, c.e, c.n, min(d.f + c.cost) as f, arg_min(list_append(d.path, c.s), d.f + c.cost) as path from d{k - 1} d join c on d.series = c.series and d.e = c.s group by all)" for k in range(1, breaks + 1)]
    return "with " + ",\n".join(steps)


@query(f"{_layers(3)} select series, unnest([1, 2, 3])::int as k, unnest(path) as b, round(f, 3) as cost from d3 where e = n")
def sch_dynp(spark, d):
    return dynamic.optimal_splits(daily(spark, d), 3).withColumn("cost", F.round("cost", 3))


@query(
    _layers(9)
    + ", prices as (select series, ln(count(*)) * var_pop(value) as penalty from daily group by series), a as ("
    + " union all ".join(f"select series, {k} as k, f, path from d{k} where e = n" for k in range(10))
    + ") select series, unnest(path) as b from (select series, arg_min(path, f + k * penalty) as path from a join prices using (series) group by series)"
)
def sch_pelt(spark, d):
    return dynamic.penalised_splits(daily(spark, d))


@query()
def sch_kernel(spark, d):
    return search.candidates(daily(spark, d), "dynp", "rbf", 3, "median")


@query()
def sch_pelt_kernel(spark, d):
    return search.candidates(hourly(spark, d), "pelt", "rbf", gamma="median", penalty=1.5)


@query(f"""with {DAILY} select series, round(1 / var_pop(value), 12) as sk_scale, round(1 / (2 * var_pop(value)), 12) as total_variance from daily group by series""")
def krn_rules(spark, d):
    rows = daily(spark, d)
    one, two = (maps.bandwidths(rows, ["value"], rule).select("series", F.round("gamma", 12).alias(rule)) for rule in ("sk_scale", "total_variance"))
    return one.join(two, "series")


@query()
def plan_detect(spark, d):
    grid = maps.map_grid(["rff"], [20], [{"gamma": "median"}])
    configs = {"one": {"depth": 2}, "several": {"depth": 1, "search": "binseg", "n_breaks": 3, "lag_rule": "decay", "width_rule": "ess", "share": 0.5, "kind": "energy"}}
    return detection.detect(daily(spark, d), maps=grid, configs=configs)


def _curve_rows(spark, d):
    """Curves by source, numbered by date."""
    from pyspark.sql.window import Window

    rows = curves(spark, d).select("date.date", F.col("date.source").alias("series"), *TENORS)
    return rows.withColumn("t", F.row_number().over(Window.partitionBy("series").orderBy("date")) - 1)


@query()
def det_hmm_curves(spark, d):
    return chains.hmm_labels(_curve_rows(spark, d), TENORS, 2, rounds=12)


@query()
def dr_hmm_posteriors(spark, d):
    return chains.hidden_markov(_curve_rows(spark, d), TENORS, 2, rounds=8).posteriors()


@query()
def det_transport(spark, d):
    return transport.transport_regimes(_curve_rows(spark, d), TENORS, 12, 3)


@query()
def dr_transport(spark, d):
    return transport.transport_distances(_curve_rows(spark, d), TENORS, 12, 3, 2)


@query()
def det_density(spark, d):
    return density.density_clusters(_curve_rows(spark, d), TENORS)


@query()
def dr_density(spark, d):
    return density.density_distances(_curve_rows(spark, d), TENORS).withColumn("distance", F.round("distance", 6))


@query()
def dr_switching(spark, d):
    return chains.switching_regression(hourly(spark, d), states=2, rounds=10)


@query()
def det_garch_laws(spark, d):
    laws = volatility.fit_garch(hourly(spark, d), rounds=6)[0]
    return laws.select("series", *(r6(c).alias(c) for c in ("omega", "alpha", "beta")))


@query()
def plan_refine_until(spark, d):
    """The worst regimes of each type of event, by the spread of their values, for three rounds."""
    held, _ = refinement.refine_until(hourly(spark, d), 0.0, rounds=3, depth=1, kind="ks", alpha=0.2)
    return held


def _scaled(spark, d):
    """Hourly values around 0 with unit spread."""
    rows = hourly(spark, d)
    unit = rows.groupBy("series").agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    return rows.join(unit, "series").select("series", "t", F.col("date").cast("timestamp").alias("date"), ((F.col("value") - F.col("_m")) / F.col("_s")).alias("value"))


@query()
def str_online_changes(spark, d):
    """The hourly values as a stream, to its present end."""
    at = f"{shared_dir(spark)}/seamline/stream-{uuid.uuid4().hex}"
    rows = _scaled(spark, d)
    rows.write.parquet(f"{at}/in")
    stream = spark.readStream.schema(rows.select("series", "t", "date", "value").schema).parquet(f"{at}/in")
    out = stateful.online_changes(stream, threshold=0.05)
    out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/out")


@query()
def sql_breakpoints(spark, d):
    functions.register(spark)
    written(_scaled(spark, d), "scaled").createOrReplaceTempView("seamline_hourly")
    return spark.sql("select series, date, row_number, probability from detect_breakpoints(table(seamline_hourly), threshold => 0.05)")
