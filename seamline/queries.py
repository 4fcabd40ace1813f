"""Registered queries of the regime engine, and the same in SQL where SQL can say it.

Three panels come from the given tables: ``daily`` (order value by priority and day), ``monthly`` (mean
price by region and month, a column a line number as tenor) and ``hourly`` (mean event value by type and hour).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import evaluation, features, hyper, insights, labels, scores
from .operators import detectors, factors, frames, search, twosample
from .operators import reduce as reductions
from .plans import explain, segmentation
from .sources import panels, sinks
from .sources.scratch import written
from .streaming import incremental

SOURCES = {"AFRICA": "AFR", "AMERICA": "AME", "ASIA": "ASI", "EUROPE": "EUR", "MIDDLE EAST": "MID"}
TENORS = [f"Y00{k}p0" for k in range(1, 6)]
RATES = [f"{s}_{t}" for s in SOURCES.values() for t in TENORS]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        name = f.__name__.rstrip("_")
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


def r6(c) -> F.col:
    """Rounded, as sums differ in their last digits from engine to engine."""
    return F.round(c, 6)


def load(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- panels -----------------------------------------------------------------------------------


def daily(spark: SparkSession, d: str) -> DataFrame:
    return panels.long_panel(load(spark, d, "orders"), F.col("o_orderpriority"), F.to_date("o_orderdate"), F.round(F.sum("o_totalprice") / 1000, 2))


DAILY = """p as (select o_orderpriority as series, o_orderdate::date as date, round(sum(o_totalprice) / 1000, 2) as value from orders group by all),
daily as (select *, (row_number() over (partition by series order by date) - 1)::int as t from p)"""


def rates(spark: SparkSession, d: str) -> DataFrame:
    """Long rates: (date, source, tenor columns), a month and region a row."""
    line, supplier, nation, region = (load(spark, d, n) for n in ("lineitem", "supplier", "nation", "region"))
    rows = line.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    source = reduce(lambda c, kv: F.when(F.col("r_name") == kv[0], kv[1]).otherwise(c), SOURCES.items(), F.substring("r_name", 1, 3))
    tenor = lambda k: F.round(F.avg(F.when((F.col("l_linenumber") - 1) % 5 == k, F.col("l_extendedprice"))) / 1000, 4).alias(TENORS[k])
    return rows.groupBy(F.trunc("l_shipdate", "month").alias("date"), source.alias("source")).agg(*map(tenor, range(5)))


_TENOR_SQL = ", ".join(f"round(avg(case when (l_linenumber - 1) % 5 = {k} then l_extendedprice end) / 1000, 4) as {t}" for k, t in enumerate(TENORS))
RATES_SQL = f"""rates as (select date_trunc('month', l_shipdate)::date as date,
  case r_name when 'MIDDLE EAST' then 'MID' else substr(r_name, 1, 3) end as source, {_TENOR_SQL}
  from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by all)"""


def wide(spark: SparkSession, d: str, sources: tuple[str, ...] = tuple(SOURCES.values()), complete: bool = True) -> DataFrame:
    return panels.wide_by_source(rates(spark, d), list(sources), TENORS, complete=complete)


def stored(spark: SparkSession, d: str) -> DataFrame:
    """``wide``, written once, for operators that pass over it again and again or add many columns to it."""
    return written(wide(spark, d), "rates")


def curves(spark: SparkSession, d: str) -> DataFrame:
    """A whole curve a row; ``date`` holds date and source, as operators keep that column."""
    return rates(spark, d).na.drop(subset=TENORS).select(F.struct("date", "source").alias("date"), *TENORS)


def by_source(rows: DataFrame) -> DataFrame:
    return rows.select("date.date", "date.source", *(c for c in rows.columns if c != "date"))


WIDE = (
    RATES_SQL
    + ",\nwide0 as (select date, "
    + ", ".join(f"max(case when source = '{s}' then {t} end) as {s}_{t}" for s in SOURCES.values() for t in TENORS)
    + " from rates group by date), wide as (select * from wide0 where "
    + " and ".join(f"{c} is not null" for c in RATES)
    + ")"
)
CURVES = RATES_SQL + ",\ncurves as (select * from rates where " + " and ".join(f"{t} is not null" for t in TENORS) + ")"


def hourly(spark: SparkSession, d: str) -> DataFrame:
    return panels.long_panel(load(spark, d, "events"), F.col("event_type"), F.date_trunc("hour", "ts"), F.round(F.avg("value"), 4))


HOURLY = """e as (select event_type as series, date_trunc('hour', ts) as date, round(avg(value), 4) as value from events group by all),
hourly as (select *, (row_number() over (partition by series order by date) - 1)::int as t from e)"""


# --- sources and frames -----------------------------------------------------------------------


@query(f"with {WIDE} select * from wide")
def src_rates_wide(spark, d):
    return wide(spark, d)


@query(f"""with {RATES_SQL}, fx as (select date_trunc('month', o_orderdate)::date as date, o_orderkey, o_totalprice as EURUSD from orders),
last as (select * from fx qualify row_number() over (partition by date order by o_orderkey desc) = 1)
select r.date, r.source, r.Y001p0, last.EURUSD from rates r left join last using (date)""")
def src_fx_join(spark, d):
    fx = load(spark, d, "orders").select(F.trunc("o_orderdate", "month").alias("date"), "o_orderkey", F.col("o_totalprice").alias("EURUSD"))
    return panels.join_fx(rates(spark, d).select("date", "source", "Y001p0"), fx, F.col("o_orderkey")).drop("o_orderkey")


@query("""select p_brand, p_type, count(*) as rows, count(distinct l_shipdate::date) as days, min(l_shipdate::date) as first, max(l_shipdate::date) as last
from lineitem join part on l_partkey = p_partkey group by all""")
def src_coverage(spark, d):
    rows = load(spark, d, "lineitem").join(load(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).withColumn("date", F.to_date("l_shipdate"))
    return panels.coverage(rows, "p_brand", "p_type")


@query("""with c as (select p_brand, p_type, count(*) as n from lineitem join part on l_partkey = p_partkey group by all)
select p_brand, p_type, n, (row_number() over (partition by p_brand order by n desc, p_type))::int as rank from c qualify rank <= 7""")
def frm_top_per_group(spark, d):
    rows = load(spark, d, "lineitem").join(load(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return frames.top_per_group(rows.groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n")), "p_brand", [F.desc("n"), F.col("p_type")], 7)


@query(f"with {WIDE} select * from (unpivot wide on {', '.join(RATES)} into name series value value)")
def frm_unpivot(spark, d):
    return frames.to_long(wide(spark, d), RATES)


@query(f"with {DAILY} select date, {', '.join(f'max(case when series = {chr(39)}{s}{chr(39)} then value end) as {chr(34)}{s}{chr(34)}' for s in ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'))} from daily group by date")
def frm_pivot(spark, d):
    return frames.to_wide(daily(spark, d), ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"])


@query("select l_orderkey, l_linenumber, ratio from (select l_orderkey, l_linenumber, case when l_discount = 0 then null else l_tax / l_discount end as ratio from lineitem) where ratio is not null and not isnan(ratio) and abs(ratio) < 'inf'::double")
def frm_finite(spark, d):
    rows = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.expr("case when l_discount = 0 then null else l_tax / l_discount end").alias("ratio"))
    return frames.finite(rows, ["ratio"])


@query(f"with {DAILY} select * from daily where t % 7 = 0 and t >= 10 and t < 500")
def frm_slice_stride(spark, d):
    return frames.stride(frames.slice_rows(daily(spark, d), 10, 500), 7)


@query(f"with {HOURLY}, asked as (select distinct ts::date as day from events) select series, day, min(t)::int as t from hourly join asked on hourly.date::date = day group by all")
def frm_row_of_date(spark, d):
    days = load(spark, d, "events").select(F.to_date("ts").alias("day")).distinct()
    return frames.row_of_date(hourly(spark, d), days)


# --- features ---------------------------------------------------------------------------------


def _sql(parts: dict[str, str]) -> str:
    return ", ".join(f"{v} as {k}" for k, v in parts.items())


def _feature_parts() -> dict[str, str]:
    out = {}
    for s in SOURCES.values():
        own = [f"{s}_{t}" for t in TENORS]
        out |= {f"{a}_minus_{b}": f"{a} - {b}" for i, a in enumerate(own) for b in own[i + 1 :]}
        out |= {f"fly_{a}_{m}_{b}": f"2 * {m} - {a} - {b}" for a, m, b in zip(own, own[1:], own[2:])}
    names = sorted(SOURCES.values())
    return out | {f"{a}_{b}_{t}_spd": f"{a}_{t} - {b}_{t}" for i, a in enumerate(names) for b in names[i + 1 :] for t in TENORS}


def _feature_sql() -> str:
    return _sql({k: f"round({v}, 6)" for k, v in _feature_parts().items()})


@query(f"with {WIDE} select date, {', '.join(RATES)}, {_feature_sql()} from wide")
def fea_curve(spark, d):
    made = features.spreads(RATES) | features.butterflies(RATES) | features.cross_spreads(RATES)
    return wide(spark, d).select("date", *RATES, *(r6(c).alias(n) for n, c in made.items()))


@query(f"with {WIDE} select date, {', '.join(f'round(2*{s}_Y003p0 - {s}_Y001p0 - {s}_Y005p0, 6) as {s}_belly' for s in SOURCES.values())}, round(0.2*({' + '.join(f'{s}_Y001p0' for s in SOURCES.values())}), 6) as mean1 from wide")
def fea_expression(spark, d):
    made = {f"{s}_belly": f"2*{{{s}:Y003p0}} - {{{s}:Y001p0}} - {{{s}:Y005p0}}" for s in SOURCES.values()}
    made["mean1"] = "0.2*(" + " + ".join(f"{{{s}:Y001p0}}" for s in SOURCES.values()) + ")"
    return wide(spark, d).select("date", *(r6(features.expression(x)).alias(n) for n, x in made.items()))


@query(f"""with {DAILY} select series, t, case when count(value) over w >= 60 then round(stddev_samp(value) over w, 6) end as vol,
case when count(value) over w >= 60 then round(corr(value, t) over w, 6) end as trend from daily window w as (partition by series order by t rows between 59 preceding and current row)""")
def fea_rolling(spark, d):
    p = daily(spark, d)
    return p.select("series", "t", r6(features.rolling(F.col("value"), 60)).alias("vol"), r6(features.rolling_corr(F.col("value"), F.col("t"), 60)).alias("trend"))


@query(f"""with {HOURLY} select series, t, round(pow(9.0::double / 11, t) * sum(value * case when t = 0 then 1 else 2.0::double / 11 * pow(11.0::double / 9, t) end) over (partition by series order by t), 6) as ewma from hourly""")
def fea_ewma(spark, d):
    return features.ewma(hourly(spark, d), 10).select("series", "t", r6("ewma").alias("ewma"))


@query(f"""with {DAILY} select series, t, round(value - lag(value) over w, 6) as diff, round(ln(value) - ln(lag(value) over w), 6) as ret, round(sum(value) over w, 4) as total,
round(value - min(value) over (partition by series), 6) as lifted from daily window w as (partition by series order by t)""")
def win_steps(spark, d):
    w = Window.partitionBy("series").orderBy("t")
    v = F.col("value")
    return daily(spark, d).select("series", "t", r6(v - F.lag(v).over(w)).alias("diff"), r6(F.log(v) - F.log(F.lag(v).over(w))).alias("ret"), F.round(F.sum(v).over(w), 4).alias("total"), r6(v - F.min(v).over(Window.partitionBy("series"))).alias("lifted"))


@query(f"""with {WIDE}, l as (select * from (unpivot wide on {', '.join(RATES)} into name series value value)),
v as (select series, var_pop(value) as v, count(*) as p from l group by all), a as (select var_pop(value) as a from l)
select round(1 / (25 * any_value(a)), 8) as sk_scale, round(1 / (2 * sum(v)), 8) as total_variance, round(1 / (25 * max(v)), 8) as max_variance, round(1 / (2 * max(v)), 8) as unscaled_max_variance from v, a""")
def krn_bandwidths(spark, d):
    return _bandwidths(frames.to_long(wide(spark, d), RATES))


def _bandwidths(long: DataFrame) -> DataFrame:
    # the variance of all cells from those of the series, so that one pass does
    v = long.groupBy("series").agg(F.var_pop("value").alias("v"), F.avg("value").alias("m"), F.count("value").alias("n"))
    n, m = F.sum("n"), F.sum(F.col("n") * F.col("m")) / F.sum("n")
    every = F.sum(F.col("n") * (F.col("v") + F.col("m") * F.col("m"))) / n - m * m
    p = F.count(F.lit(1))
    r8 = lambda c, name: F.round(1 / c, 8).alias(name)
    return v.agg(r8(p * every, "sk_scale"), r8(2 * F.sum("v"), "total_variance"), r8(p * F.max("v"), "max_variance"), r8(2 * F.max("v"), "unscaled_max_variance"))


@query(f"""with {DAILY}, c as (select series, count(*) as n, greatest(-0.99, least(0.99, corr(value, was))) as rho from (select *, lag(value) over (partition by series order by t) as was from daily) group by series)
select series, round(n * (1 - rho) / (1 + rho), 4) as ess, greatest(20, least(120, round(0.1 * n * (1 - rho) / (1 + rho) / 2)))::int as width from c""")
def hyp_ess_window(spark, d):
    return hyper.ess_window(daily(spark, d)).withColumn("ess", F.round("ess", 4))


# --- search and tests -------------------------------------------------------------------------

_PREFIX = """x as (select *, coalesce(sum(value) over (partition by series order by t rows between unbounded preceding and 1 preceding), 0) as s,
sum(value) over (partition by series) as a, count(*) over (partition by series) as n from daily)"""


@query(f"""with {DAILY}, {_PREFIX}, g as (select series, t, sqrt(t * (n - t) / n::double) * abs(s / t - (a - s) / (n - t)) as stat from x where t >= 10 and n - t >= 10)
select series, t::bigint as b, round(stat, 6) as stat from g qualify row_number() over (partition by series order by stat desc, t) = 1""")
def sch_cusum(spark, d):
    return search.cusum_split(daily(spark, d)).withColumn("stat", r6("stat"))


@query(f"""with {DAILY}, {_PREFIX}, g as (select series, t, s * s / t + (a - s) * (a - s) / (n - t) - a * a / n as gain from x where t % 5 = 0 and t >= 10 and n - t >= 10)
select series, t::bigint as b, round(gain, 3) as gain from g qualify row_number() over (partition by series order by gain desc, t) = 1""")
def sch_best_split(spark, d):
    return search.best_split(daily(spark, d)).withColumn("gain", F.round("gain", 3))


@query(f"""with {DAILY}, g as (select series, t, avg(value) over l as l, avg(value) over r as r, count(value) over l as nl, count(value) over r as nr from daily
window l as (partition by series order by t rows between 20 preceding and 1 preceding), r as (partition by series order by t rows between current row and 19 following))
select series, t, round((l - r) * (l - r) * 10, 7) as gain from g where nl = 20 and nr = 20""")
def sch_window(spark, d):
    return search.window_gain(daily(spark, d)).withColumn("gain", F.round("gain", 7))


def _breaks(spark, d, every: int = 200) -> DataFrame:
    p = daily(spark, d)
    return p.where((F.col("t") % every == 0) & (F.col("t") > 0)).select("series", F.col("t").cast("long").alias("b"))


_SAMPLES = """bs as (select series, t as label from daily where t % 200 = 0 and t > 0),
smp as (select d.series, label::bigint as label, d.t, case when d.t - label >= -45 and d.t - label < -5 then 0 when d.t - label >= 5 and d.t - label < 45 then 1 end as side, value
  from daily d join bs using (series) where (d.t - label >= -45 and d.t - label < -5) or (d.t - label >= 5 and d.t - label < 45)),
prs as (select a.series, a.label, a.t as t1, b.t as t2, a.side as s1, b.side as s2, a.value as v1, b.value as v2 from smp a join smp b using (series, label))"""


def _mean_sql(f: str) -> str:
    return f"avg(case when s1 = 0 and s2 = 0 then {f} end) + avg(case when s1 = 1 and s2 = 1 then {f} end) - 2 * avg(case when s1 = 0 and s2 = 1 then {f} end)"


def _samples(spark, d) -> DataFrame:
    return twosample.windows(daily(spark, d), _breaks(spark, d))


_K = "exp(-0.000001 * (v1 - v2) * (v1 - v2))"


@query(f"with {DAILY}, {_SAMPLES} select series, label, round({_mean_sql(_K)}, 6) as stat from prs group by all")
def tst_mmd_biased(spark, d):
    return twosample.mmd(_samples(spark, d), 1e-6).withColumn("stat", r6("stat"))


@query(f"with {DAILY}, {_SAMPLES} select series, label, round({_mean_sql(_K)}, 6) as stat from prs where t1 <> t2 group by all")
def tst_mmd_unbiased(spark, d):
    return twosample.mmd(_samples(spark, d), 1e-6, unbiased=True).withColumn("stat", r6("stat"))


@query(f"""with {DAILY}, {_SAMPLES}, k as (select *, row_number() over (partition by series, label, side order by t) - 1 as k from smp),
w as (select series, label, k, max(case when side = 0 then value end) as x, max(case when side = 1 then value end) as y from k group by all),
q as (select *, lead(x) over o as x2, lead(y) over o as y2 from w window o as (partition by series, label order by k))
select series, label, round(avg(exp(-0.000001 * (x - x2) * (x - x2)) + exp(-0.000001 * (y - y2) * (y - y2)) - exp(-0.000001 * (x - y2) * (x - y2)) - exp(-0.000001 * (x2 - y) * (x2 - y))), 6) as stat
from q where k % 2 = 0 and x is not null and y is not null and x2 is not null and y2 is not null group by all""")
def tst_mmd_linear(spark, d):
    return twosample.mmd_linear(_samples(spark, d), 1e-6).withColumn("stat", r6("stat"))


@query(f"with {DAILY}, {_SAMPLES} select series, label, round(-({_mean_sql('abs(v1 - v2)')}), 8) as score from prs group by all")
def tst_energy(spark, d):
    return scores.energy_between(_samples(spark, d)).withColumn("score", F.round("score", 8))


@query(f"""with {DAILY}, {_SAMPLES}, c as (select *, sum((side = 0)::int) over u / (sum((side = 0)::int) over c)::double - sum((side = 1)::int) over u / (sum((side = 1)::int) over c)::double as gap from smp
window u as (partition by series, label order by value range between unbounded preceding and current row), c as (partition by series, label)) select series, label, round(max(abs(gap)), 6) as stat from c group by all""")
def tst_kolmogorov_smirnov(spark, d):
    return twosample.kolmogorov_smirnov(_samples(spark, d)).withColumn("stat", r6("stat"))


@query(f"""with {DAILY}, {_SAMPLES}, g as (select series, label, avg(value) filter (side = 0) as m0, avg(value) filter (side = 1) as m1, var_samp(value) filter (side = 0) as v0, var_samp(value) filter (side = 1) as v1,
count(*) filter (side = 0) as n0, count(*) filter (side = 1) as n1 from smp group by all)
select series, label, round(n0 * n1 / (n0 + n1)::double * (m0 - m1) * (m0 - m1) / (((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2) + 1e-6), 6) as stat from g""")
def tst_hotelling(spark, d):
    return twosample.hotelling(_samples(spark, d)).withColumn("stat", r6("stat"))


@query()
def tst_permutation(spark, d):
    return twosample.test_breaks(daily(spark, d), _breaks(spark, d))


@query()
def sch_binseg(spark, d):
    return search.binary_splits(hourly(spark, d), 3).select("series", "b")


@query()
def sch_wbs(spark, d):
    return search.wild_splits(hourly(spark, d)).select("series", "b")


for _name in search.KERNELS:

    def _run(spark, d, name=_name):
        return search.breaks(hourly(spark, d), name)

    QUERIES[f"sch_{_name}"] = _run


# --- reductions and detectors -------------------------------------------------------------------

_YEARS = [1.0, 2.0, 3.0, 4.0, 5.0]
#: Level, slope and curvature of five yearly rates at a decay of 0.0609: the least-squares solution, worked out in decimals of 60 digits.
_FACTORS = {
    "level": [229.27988937649366, -134.35016910740012, -237.83746041644608, -103.60220665193248, 247.509946799285],
    "slope": [-227.38630520998734, 134.27283707521426, 236.96292071342643, 103.00358904982342, -246.85304162847677],
    "curvature": [-266.17077970925243, 148.01934828994797, 268.63495208159355, 120.97086353809101, -271.4543842003801],
}


def _dot(row) -> str:
    return " + ".join(f"({w!r}::double) * {c}" for c, w in zip(TENORS, row, strict=True))


@query(f"with {CURVES} select date, source, {', '.join(f'round({_dot(r)}, 2) as {n}' for n, r in _FACTORS.items())} from curves")
def dr_nelson_siegel(spark, d):
    out = by_source(reductions.curve_factors(curves(spark, d), TENORS, _YEARS))
    return out.select("date", "source", *(F.round(c, 2).alias(c) for c in ("level", "slope", "curvature")))


def _rest_sql(decay: float) -> str:
    """What a curve leaves: the squares along two axes at right angles to the three shapes, found by taking the shapes out of unit vectors."""
    shapes = [[1.0] * 5, [-math.expm1(-decay * y) / (decay * y) for y in _YEARS], [math.exp(-decay * y) for y in _YEARS]]
    base: list[list[float]] = []
    for v in shapes + [[float(i == k) for i in range(5)] for k in (0, 2, 4, 1, 3)]:
        for _ in range(3):
            for u in base:
                along = math.fsum(x * y for x, y in zip(u, v))
                v = [y - along * x for x, y in zip(u, v)]
        size = math.sqrt(math.fsum(x * x for x in v))
        if size > 1e-9:
            base.append([x / size for x in v])
    return " + ".join(f"pow({_dot(u)}, 2)" for u in base[3:5])


@query(f"""with {CURVES}, f as (select date, source, unnest([{', '.join(f"{{'sse': {_rest_sql(x)}, 'decay': {x}::double}}" for x in reductions.DECAYS)}]) as f from curves)
select date, source, min(f).decay as decay, round(min(f).sse, 4) as sse from f group by all""")
def dr_diebold_li(spark, d):
    out = by_source(reductions.curve_decay(curves(spark, d), TENORS, _YEARS))
    return out.select("date", "source", "decay", F.round("sse", 4).alias("sse"))


@query(f"with {CURVES} select date, source, {', '.join(f'round(({TENORS[max(i - 1, 0)]} + {c} + {TENORS[min(i + 1, 4)]}) / 3, 6) as {c}' for i, c in enumerate(TENORS))} from curves")
def dr_fpca_smooth(spark, d):
    return by_source(curves(spark, d).select("date", *(r6(c).alias(n) for n, c in reductions.smooth_across(TENORS).items())))


@query()
def dr_pca(spark, d):
    return reductions.principal_components(stored(spark, d), RATES, 3)


@query()
def dr_ica(spark, d):
    return factors.independent_components(stored(spark, d), RATES, 3)


@query()
def dr_sparse_pca(spark, d):
    return factors.sparse_components(stored(spark, d), RATES, 3)


@query()
def dr_robust_pca(spark, d):
    return factors.robust_components(stored(spark, d), RATES)


@query()
def dr_kernel_pca(spark, d):
    return factors.kernel_components(stored(spark, d), RATES, 3, "rbf", gamma=0.1)


@query()
def dr_dmd(spark, d):
    steps = stored(spark, d).withColumn("t", F.year("date") * 12 + F.month("date") - 1995 * 12 - 1)
    return factors.dynamic_modes(steps, RATES, 12, 3, 3)


@query()
def krn_fourier(spark, d):
    return reductions.fourier_map(stored(spark, d), RATES, gamma=1e-4)


@query()
def det_kmeans(spark, d):
    return detectors.cluster(stored(spark, d), RATES)


@query()
def det_gaussian_mixture(spark, d):
    return by_source(detectors.cluster(curves(spark, d), TENORS, 2, "gmm"))


for _name in detectors.CHAINED:

    def _run_detector(spark, d, name=_name):
        return detectors.detect(hourly(spark, d), name, **({"rounds": 15} if name in ("hmm", "ms_var", "msar") else {}))

    QUERIES[f"det_{_name}"] = _run_detector


@query(f"""with {HOURLY}, r as (select *, value - lag(value) over (partition by series order by t) as r from hourly), q as (select *, r * r as q, (row_number() over (partition by series order by t) - 1)::int as k from r where r is not null),
v as (select *, case when count(q) over w >= 3 then avg(q) over w end as m, pow(19.0::double / 21, k) * sum(q * case when k = 0 then 1 else 2.0::double / 21 * pow(21.0::double / 19, k) end) over (partition by series order by t) as e
  from q window w as (partition by series order by t rows between 19 preceding and current row)),
x as (select *, ln(0.5 * coalesce(m, first_value(m ignore nulls) over (partition by series order by t rows between current row and unbounded following)) + 0.5 * e + 1e-12) as lv from v),
c as (select series, quantile_cont(lv, 0.5) as cut from x group by series) select series, t, date, (lv >= cut)::int as label from x join c using (series)""")
def det_volatility(spark, d):
    return detectors.volatility_levels(hourly(spark, d))


@query(f"""with {CURVES}, x as (select *, source as series, (row_number() over (partition by source order by date) - 1)::int as t from curves)
select series, t, {', '.join(f'case when count(*) over w >= 24 then round(corr({a}, {b}) over w, 6) end as {a}_{b}' for i, a in enumerate(TENORS) for b in TENORS[i + 1 :])} from x window w as (partition by series order by t rows between 23 preceding and current row)""")
def det_rolling_correlations(spark, d):
    p = rates(spark, d).na.drop(subset=TENORS).withColumnRenamed("source", "series")
    p = p.withColumn("t", F.row_number().over(Window.partitionBy("series").orderBy("date")) - 1)
    out = detectors.rolling_correlations(p, TENORS, 24)
    return out.select("series", "t", *(r6(c).alias(c) for c in out.columns[2:]))


# --- labels, evaluation, scores -------------------------------------------------------------------


def _labels(spark, d) -> DataFrame:
    """A label by quarter of the year, so that labels come back."""
    return daily(spark, d).withColumn("label", F.quarter("date") - 1)


_LAB = f"{DAILY}, lab as (select *, (quarter(date) - 1)::int as label from daily)"


@query(f"with {_LAB}, w as (select *, lag(label) over (partition by series order by t) as was from lab) select series, t::bigint as b from w where was is not null and was <> label")
def lbl_breaks(spark, d):
    return labels.breaks_of(_labels(spark, d))


@query(f"with {DAILY} select series, date, value, t, (t // 200)::int as label from daily")
def lbl_from_breaks(spark, d):
    return labels.labels_of(daily(spark, d), _breaks(spark, d))


@query(f"with {_LAB}, f as (select *, min(t) over (partition by series, label) as f from lab) select series, date, value, t, (dense_rank() over (partition by series order by f) - 1)::int as label from f")
def lbl_relabel(spark, d):
    return labels.relabel(_labels(spark, d))


@query(f"""with {_LAB}, w as (select *, case when lag(label) over (partition by series order by t) = label then 0 else 1 end as fresh from lab),
r as (select *, sum(fresh) over (partition by series order by t) as run from w)
select series, run::int as run, label, min(date) as start, max(date) as end, count(*) as rows from r group by series, run, label""")
def lbl_intervals(spark, d):
    return labels.intervals(_labels(spark, d))


@query(f"""with {_LAB}, w as (select *, lag(label) over (partition by series order by t) as was, count(*) over (partition by series) as n from lab), b as (select series, t::bigint as b, n from w where was <> label),
g as (select *, coalesce(lag(b) over o, 0) as l, coalesce(lead(b) over o, n) as r from b window o as (partition by series order by b)) select series, b from g where b - l >= 62 and r - b >= 62""")
def lbl_drop_short(spark, d):
    rows = _labels(spark, d)
    n = rows.groupBy("series").agg(F.count(F.lit(1)).alias("n"))
    return labels.drop_short(labels.breaks_of(rows), n, 62)


@query(f"""with recursive {_LAB}, w as (select *, lag(label) over (partition by series order by t) as was from lab), bs as (select series, t::bigint as b, row_number() over (partition by series order by t) as k from w where was <> label),
r as (select series, k, b, 1 as g from bs where k = 1 union all select bs.series, bs.k, bs.b, case when bs.b - r.b <= 62 then r.g else r.g + 1 end as g from r join bs on bs.series = r.series and bs.k = r.k + 1)
select series, max(b) as b from r group by series, g""")
def lbl_merge_close(spark, d):
    return labels.merge_close(labels.breaks_of(_labels(spark, d)), 62)


@query(f"with {_LAB} select series, label, round(var_pop(value), 4) as loss from lab group by all")
def eva_regime_loss(spark, d):
    return evaluation.regime_loss(_labels(spark, d)).withColumn("loss", F.round("loss", 4))


_TWO = f"{_LAB}, w as (select *, lag(label) over (partition by series order by t) as was from lab), tr as (select series, t::bigint as b from daily where t % 200 = 0 and t > 0), fo as (select series, t::bigint as p from w where was <> label)"


@query(f"with {_TWO} select series, b, min_by(p, abs(b - p) * 1000000 + p) as near from tr join fo using (series) group by all")
def eva_nearest(spark, d):
    return evaluation.nearest(_breaks(spark, d), labels.breaks_of(_labels(spark, d)))


@query(f"with {_TWO}, q as (select series, p as b, row_number() over (partition by series order by p) as k from fo) select series, b, b + case when k % 3 = 0 then 30 else 4 end as near, case when k % 3 = 0 then 30 else 4 end::bigint as distance from q")
def eva_matched(spark, d):
    return evaluation.matched(_truth(spark, d), _shifted(spark, d))


@query(f"with {_TWO}, m as (select series, b, min(abs(b - p)) as near from tr join fo using (series) group by all) select series, max(near) as distance from m group by all")
def eva_hausdorff(spark, d):
    return evaluation.hausdorff(_breaks(spark, d), labels.breaks_of(_labels(spark, d)))


def _spans(spark, d, breaks: DataFrame) -> DataFrame:
    n = daily(spark, d).groupBy("series").agg(F.count(F.lit(1)).alias("n"))
    edges = n.select("series", F.lit(0).cast("long").alias("b")).union(breaks)
    w = Window.partitionBy("series").orderBy("b")
    return edges.join(n, "series").select("series", F.col("b").alias("lo"), F.coalesce(F.lead("b").over(w), F.col("n")).alias("hi"))


def _spans_sql(name: str, source: str, column: str) -> str:
    return f"{name}_e as (select series, 0 as b from nn union all select series, {column} as b from {source}), {name} as (select series, b as lo, coalesce(lead(b) over (partition by series order by b), n) as hi from {name}_e join nn using (series))"


@query(f"""with {_TWO}, nn as (select series, count(*) as n from daily group by all), {_spans_sql('ts', 'tr', 'b')}, {_spans_sql('fs', 'fo', 'p')},
o as (select ts.series, ts.lo, ts.hi, max(least(ts.hi, fs.hi) - greatest(ts.lo, fs.lo)) as best from ts join fs on ts.series = fs.series and ts.lo < fs.hi and fs.lo < ts.hi group by all)
select series, round(sum(best) / sum(hi - lo)::double, 6) as covering from o group by series""")
def eva_covering(spark, d):
    out = evaluation.covering(_spans(spark, d, _breaks(spark, d)), _spans(spark, d, labels.breaks_of(_labels(spark, d))))
    return out.withColumn("covering", r6("covering"))


def _pairs(spark, d) -> DataFrame:
    return _labels(spark, d).select("series", F.col("label").alias("a"), F.floor(F.col("t") / 200).cast("int").alias("b"))


_CELLS = f"{_LAB}, pr as (select series, label as a, (t // 200)::int as b from lab), ce as (select series, a, b, count(*) as n from pr group by all)"


@query(f"""with {_CELLS}, s as (select series, sum(n * (n - 1) / 2) as s, sum(n) as total from ce group by all), sa as (select series, sum(n * (n - 1) / 2) as sa from (select series, a, sum(n) as n from ce group by all) group by all),
sb as (select series, sum(n * (n - 1) / 2) as sb from (select series, b, sum(n) as n from ce group by all) group by all)
select series, round((s - sa * sb / (total * (total - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (total * (total - 1) / 2)), 6) as ari from s join sa using (series) join sb using (series)""")
def eva_adjusted_rand(spark, d):
    return evaluation.adjusted_rand(_pairs(spark, d)).withColumn("ari", r6("ari"))


@query(f"""with {_CELLS}, c as (select *, sum(n) over (partition by series, a) as na, sum(n) over (partition by series, b) as nb, sum(n) over (partition by series) as t from ce),
mi as (select series, sum(n / t::double * ln(n * t / (na * nb)::double)) as mi from c group by all),
ha as (select series, -sum(na / t::double * ln(na / t::double)) as ha from (select distinct series, a, na, t from c) group by all), hb as (select series, -sum(nb / t::double * ln(nb / t::double)) as hb from (select distinct series, b, nb, t from c) group by all)
select series, round(mi / ha, 6) as homogeneity, round(mi / hb, 6) as completeness, round(2 * (mi / ha) * (mi / hb) / (mi / ha + mi / hb), 6) as v, round(2 * mi / (ha + hb), 6) as nmi from mi join ha using (series) join hb using (series)""")
def eva_information(spark, d):
    out = evaluation.information(_pairs(spark, d))
    return out.select("series", *(r6(c).alias(c) for c in out.columns[1:]))


@query("""with p as (select event_type as series, event_id as id, round(value / (select max(value) + 1 from events), 6) as p from events where value >= 0),
k as (select *, row_number() over (partition by series order by p, id) as k, count(*) over (partition by series) as m from p),
c as (select *, max(case when p <= k * 0.5 / m then p end) over (partition by series) as cut from k) select series, id, p, coalesce(p <= cut, false) as rejected from c""")
def eva_benjamini_hochberg(spark, d):
    e = load(spark, d, "events")
    top = e.agg((F.max("value") + 1).alias("top"))
    tests = e.where("value >= 0").join(F.broadcast(top)).select(F.col("event_type").alias("series"), F.col("event_id").alias("id"), r6(F.col("value") / F.col("top")).alias("p"))
    return evaluation.benjamini_hochberg(tests, 0.5)


for _name, _f, _q in (
    ("sco_mse", scores.mse_to_mean, "select series, label, round(var_pop(value), 4) as score from lab group by all"),
    ("sco_mad", scores.mad_to_median, "select series, label, round(avg(abs(value - m)), 4) as score from lab join (select series, label, quantile_cont(value, 0.5) as m from lab group by all) using (series, label) group by all"),
    ("sco_mse_diff", scores.mse_on_diff, "select series, label, round(coalesce(var_pop(d), 0), 4) as score from (select *, value - lag(value) over (partition by series, label order by t) as d from lab) group by all"),
    ("sco_hotelling", scores.hotelling_within, """select series, label, round(case when n < 4 then 0 else (m1 - m0) * (m1 - m0) / ((v1 + v0) / 2 + 1e-8) end, 6) as score from (select series, label, max(n) as n, avg(value) filter (k < n // 2) as m1, avg(value) filter (k >= n // 2) as m0,
var_samp(value) filter (k < n // 2) as v1, var_samp(value) filter (k >= n // 2) as v0 from (select *, row_number() over (partition by series, label order by t) - 1 as k, count(*) over (partition by series, label) as n from lab) group by series, label)"""),
):

    def _score(spark, d, f=_f, digits=6 if _name == "sco_hotelling" else 4):
        return f(_labels(spark, d)).withColumn("score", F.round("score", digits))

    QUERIES[_name] = _score
    ORACLE[_name] = f"with {_LAB} {_q}"


def _means(spark, d) -> DataFrame:
    return insights.distances(insights.regime_means(_labels(spark, d)).withColumn("mean", F.round("mean", 4)))


_MEANS = f"{_LAB}, m as (select series, label, round(avg(value), 4) as m from lab group by all), ds as (select x.label as a, y.label as b, sqrt(sum((x.m - y.m) * (x.m - y.m))) as d from m x join m y using (series) group by all)"


@query(f"with {_MEANS} select a, b, round(d, 4) as d from ds")
def ins_distances(spark, d):
    return _means(spark, d).withColumn("d", F.round("d", 4))


@query(f"with {_MEANS} select a, b, round(exp(-0.01 * d) / sum(exp(-0.01 * d)) over (partition by a), 6) as p from ds")
def ins_transitions(spark, d):
    return scores.transitions(_means(spark, d), 0.01).withColumn("p", r6("p"))


@query(f"with {_LAB}, l as (select series, label, var_pop(value) as v from lab group by all) select series, round(sum(v), 4) as loss from l group by all order by loss desc, series limit 3")
def ins_worst_series(spark, d):
    return insights.worst_series(evaluation.regime_loss(_labels(spark, d)), 3).withColumn("loss", F.round("loss", 4))


# --- ensembles, plans, streams --------------------------------------------------------------------


def _runs(spark, d) -> DataFrame:
    """Breaks of five runs around each break, close to every second one and far around the others."""
    each = _breaks(spark, d).select("series", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("run"), "b")
    return each.withColumn("b", F.col("b") + (F.col("run") - 2) * F.when(F.col("b") % 400 == 0, 3).otherwise(20))


def _lengths(spark, d) -> DataFrame:
    return daily(spark, d).groupBy("series").agg(F.count(F.lit(1)).alias("n"))


_RUNS = f"{DAILY}, tr as (select series, t::bigint as b from daily where t % 200 = 0 and t > 0), ru as (select series, run, b + (run - 2) * case when b % 400 = 0 then 3 else 20 end as p from tr, range(5) g(run)), nl as (select series, count(*) as n from daily group by all)"
_BANDS = """nr as (select series, b, run, min_by(p, abs(b - p) * 1000000 + p) as p from tr join ru using (series) where abs(b - p) <= 40 group by all),
h as (select series, b, quantile_cont(p, 0.05) as l, quantile_cont(p, 0.95) as h from nr group by all),
bd as (select series, b, n, case when l is null then greatest(1, b - 20) else greatest(0, least(floor(round(l, 6))::bigint, b)) end as lo, case when l is null then least(n - 2, b + 20) else least(n - 1, greatest(floor(round(h, 6))::bigint, b)) end as hi from tr left join h using (series, b) join nl using (series))"""


@query(f"""with {_RUNS}, h as (select series, b, count(distinct run) as h from tr join ru using (series) where abs(b - p) <= 20 group by all), n as (select series, count(distinct run) as n from ru group by all)
select series, b, round(coalesce(h, 0) / n::double, 6) as persistence, n as runs, coalesce(h, 0) / n::double < 0.7 as low from tr join n using (series) left join h using (series, b)""")
def ens_persistence(spark, d):
    return evaluation.persistence(_breaks(spark, d), _runs(spark, d), 20, low=0.7).withColumn("persistence", r6("persistence"))


@query(f"with {_RUNS}, {_BANDS} select series, b, lo, hi from bd")
def ens_bands(spark, d):
    return evaluation.bands(_breaks(spark, d), _runs(spark, d), 20, _lengths(spark, d))


@query(f"""with {HOURLY}, nl as (select series, count(*) as n from hourly group by all), sl as (select series, n, sample, t from nl, range(4) g(sample), lateral (select unnest(range(n)) as t)),
src as (select series, sample, t, ((('0x' || substr(md5('0:' || series || ':' || sample || ':' || (t // 25)), 1, 13))::bigint % n + t % 25) % n)::int as src from sl)
select src.series, sample::int as sample, src.t::int as t, value from src join hourly h on h.series = src.series and h.t = src.src""")
def ens_bootstrap(spark, d):
    return segmentation.block_bootstrap(hourly(spark, d), 25, 4)


@query()
def plan_segment(spark, d):
    return segmentation.segment(hourly(spark, d))


@query()
def plan_robustness(spark, d):
    return segmentation.segment(hourly(spark, d), configs=segmentation.perturbed({}, depth=[1, 3], alpha=[0.01, 0.1]))


@query()
def plan_consensus(spark, d):
    return segmentation.consensus(plan_robustness(spark, d).where("status = 'valid'").select("series", "run", "b"), 5, 0.2)


@query()
def plan_refine(spark, d):
    p = hourly(spark, d)
    return segmentation.refine(p, p.withColumn("label", F.floor(F.col("t") / 240).cast("int")))


@query("select event_type as series, date_trunc('hour', ts) as date, round(avg(value), 6) as value from events group by all")
def str_buckets(spark, d):
    out = incremental.buckets(load(spark, d, "events"), "ts", "event_type", "value")
    return out.select("series", F.col("date").cast("timestamp_ntz").alias("date"), r6("value").alias("value"))


@query("""with g as (select *, case when ts < lag(ts) over (partition by user_id order by ts) + interval 30 minutes then 0 else 1 end as fresh from events), s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from g)
select user_id as series, min(ts) as start, max(ts) + interval 30 minutes as "end", count(*) as rows from s group by user_id, k""")
def str_sessions(spark, d):
    out = incremental.sessions(load(spark, d, "events"), "ts", "user_id")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


# --- sinks, explanations, what is left of breaks ----------------------------------------------------


@query(f"""with {DAILY}, bs as (select series, t as label from daily where t % 200 = 0 and t > 0),
xs as (select d.series, label, d.t, value - avg(value) over (partition by d.series, label) as x, count(*) over (partition by d.series, label) as n from daily d join bs on d.series = bs.series and d.t >= label - 100 and d.t < label + 100),
ps as (select a.series, a.label, b.t - a.t as lag, sum(a.x * b.x) as s from xs a join xs b on a.series = b.series and a.label = b.label and b.t - a.t between 0 and 40 where a.n = 200 group by all),
rs as (select *, s / max(case when lag = 0 then s end) over (partition by series, label) as r from ps)
select series, label::bigint as label, coalesce(min(lag) filter (abs(r) < 0.1), max(lag))::int as lag from rs group by all""")
def hyp_decay_lag(spark, d):
    return features.decay_lag(daily(spark, d), _breaks(spark, d))


@query(f"with {_LAB}, m as (select series, label as segment, avg(value) as m from lab group by all) select series, t, segment, round(abs(value - m), 4) as distance from lab join m using (series)")
def dr_segment_distances(spark, d):
    return reductions.segment_distances(_labels(spark, d), ["value"]).withColumn("distance", F.round("distance", 4))


@query()
def dr_centre_distances(spark, d):
    return reductions.centre_distances(stored(spark, d), RATES)


@query()
def dr_responsibilities(spark, d):
    return by_source(reductions.responsibilities(curves(spark, d), TENORS))


@query(f"""with {_LAB}, w as (select *, case when lag(label) over (partition by series order by t) = label then 0 else 1 end as fresh from lab),
r as (select *, sum(fresh) over (partition by series order by t) as run from w)
select series, run::int as run, label || ' from ' || strftime(min(date), '%Y-%m-%d') || ' to ' || strftime(max(date), '%Y-%m-%d') as legend from r group by series, run, label""")
def lbl_legends(spark, d):
    return labels.legends(labels.intervals(_labels(spark, d))).select("series", "run", "legend")


def _shifted(spark, d) -> DataFrame:
    """Breaks of the quarters, every third 30 rows on and the others 4; none is nearer to another break than to its own."""
    b = _truth(spark, d).withColumn("k", F.row_number().over(Window.partitionBy("series").orderBy("b")))
    return b.select("series", (F.col("b") + F.when(F.col("k") % 3 == 0, 30).otherwise(4)).alias("b"))


@query(f"""with {_TWO}, q as (select series, p as b, row_number() over (partition by series order by p) as k from fo), s as (select series, count(*) as n, count(*) filter (k % 3 <> 0) as hits from q group by all)
select series, round(hits / n::double, 6) as precision, round(hits / n::double, 6) as recall, round(2 * hits / (2.0 * n)::double, 6) as f1, round(hits / n::double, 6) as recovery from s""")
def eva_detection(spark, d):
    out = evaluation.detection(_truth(spark, d), _shifted(spark, d), 20)
    return out.select("series", *(r6(c).alias(c) for c in out.columns[1:]))


def _judged(spark, d) -> DataFrame:
    """Breaks of the quarters; those with 62 rows to both neighbours are confirmed."""
    rows = _labels(spark, d)
    every = labels.breaks_of(rows)
    kept = labels.drop_short(every, rows.groupBy("series").agg(F.count(F.lit(1)).alias("n")), 62).withColumn("confirmed", F.lit(True))
    return every.join(kept, ["series", "b"], "left").na.fill(False, ["confirmed"])


@query(f"""with {_LAB}, w as (select *, lag(label) over (partition by series order by t) as was, count(*) over (partition by series) as n from lab), b as (select series, t::bigint as b, n from w where was <> label),
g as (select *, coalesce(lag(b) over o, 0) as l, coalesce(lead(b) over o, n) as r from b window o as (partition by series order by b)), j as (select series, b, b - l >= 62 and r - b >= 62 as ok from g)
select series, '{{"event":"run_started","run_id":"run","series":"' || series || '"}}' as line from j group by series union all
select series, '{{"event":"' || case when ok then 'breakpoint_confirmed' else 'breakpoint_rejected' end || '","run_id":"run","series":"' || series || '","bkpt":' || b || '}}' as line from j union all
select series, '{{"event":"run_complete","run_id":"run","series":"' || series || '","n_bkpts":' || count(*) filter (ok) || ',"n_invalid":' || count(*) filter (not ok) || '}}' as line from j group by series""")
def snk_events(spark, d):
    return sinks.event_lines(_judged(spark, d), "run")


@query(f"with {_RUNS}, {_BANDS} select series, b, lo, hi, hi - lo as width, hi - lo > greatest(60, 0.02 * n) as low_confidence from bd")
def snk_breaks(spark, d):
    return sinks.break_table(_breaks(spark, d), ens_bands(spark, d), 20, _lengths(spark, d))


@query()
def exp_tree(spark, d):
    rows = stored(spark, d).withColumn("label", F.floor((F.year("date") - 1990) / 2).cast("int"))
    return explain.tree(rows, RATES)[1].select("date", "label", "predicted")


@query()
def ens_without_groups(spark, d):
    p = stored(spark, d).withColumns({"series": F.lit("rates"), "t": F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("date")) - 1})
    return explain.without_groups(p, RATES, width=10, lag=0, kind="ks", alpha=0.2)


# --- tests, evaluation and ensembles over what the engine finds ------------------------------------
# The queries above take every 200th row as the break; these take all rows or the engine's own breaks, and have no SQL.


def _every_sample(spark, d) -> DataFrame:
    return twosample.rolling_windows(daily(spark, d))


for _name, _f in (
    ("mmd_biased", lambda s: twosample.mmd(s, 1e-6)),
    ("mmd_unbiased", lambda s: twosample.mmd(s, 1e-6, unbiased=True)),
    ("mmd_linear", lambda s: twosample.mmd_linear(s, 1e-6)),
    ("energy", scores.energy_between),
    ("kolmogorov_smirnov", twosample.kolmogorov_smirnov),
    ("hotelling", twosample.hotelling),
):
    QUERIES[f"tst_{_name}_rows"] = lambda spark, d, f=_f: f(_every_sample(spark, d))


def _found(spark, d) -> DataFrame:
    return search.candidates(daily(spark, d), "pelt")


@query()
def tst_permutation_found(spark, d):
    return twosample.test_breaks(daily(spark, d), _found(spark, d))


def _truth(spark, d) -> DataFrame:
    return labels.breaks_of(_labels(spark, d))


for _name, _f in (("nearest", evaluation.nearest), ("matched", evaluation.matched), ("hausdorff", evaluation.hausdorff), ("detection", lambda t, f: evaluation.detection(t, f, 20))):
    QUERIES[f"eva_{_name}_found"] = lambda spark, d, f=_f: f(_truth(spark, d), _found(spark, d))


@query()
def eva_covering_found(spark, d):
    return evaluation.covering(_spans(spark, d, _truth(spark, d)), _spans(spark, d, _found(spark, d)))


def _found_pairs(spark, d) -> DataFrame:
    found = labels.labels_of(daily(spark, d), _found(spark, d)).select("series", "t", F.col("label").alias("b"))
    return _labels(spark, d).select("series", "t", F.col("label").alias("a")).join(found, ["series", "t"]).select("series", "a", "b")


@query()
def eva_adjusted_rand_found(spark, d):
    return evaluation.adjusted_rand(_found_pairs(spark, d))


@query()
def eva_information_found(spark, d):
    return evaluation.information(_found_pairs(spark, d))


_CONFIGS = segmentation.perturbed({}, depth=[1, 3], alpha=[0.01, 0.1])


def _planned(spark, d) -> tuple[DataFrame, DataFrame]:
    """Valid breaks of the base run, and of the run under each configuration."""
    runs = segmentation.segment(daily(spark, d), configs=_CONFIGS).where("status = 'valid'").select("series", "run", "b")
    return runs.where("run = 'base'").select("series", "b"), runs


@query()
def ens_persistence_found(spark, d):
    return evaluation.persistence(*_planned(spark, d), 7, len(_CONFIGS))


@query()
def ens_bands_found(spark, d):
    return evaluation.bands(*_planned(spark, d), 7, _lengths(spark, d))


@query()
def snk_breaks_found(spark, d):
    found, runs = _planned(spark, d)
    return sinks.break_table(found, evaluation.bands(found, runs, 7, _lengths(spark, d)), 7, _lengths(spark, d))


# --- rates with gaps ----------------------------------------------------------------------------
# The queries above need months with all 25 cells; these keep every cell there is.


def _long_rates(spark, d) -> DataFrame:
    """Every cell there is: (date, series, value)."""
    return frames.to_long(wide(spark, d, complete=False), RATES).where("value is not null")


_WIDE0 = WIDE[: WIDE.index(", wide as (select * from wide0")]


@query(f"with {_WIDE0} select * from wide0")
def src_rates_wide_all(spark, d):
    return wide(spark, d, complete=False)


@query(f"with {_WIDE0} select * from (unpivot wide0 on {', '.join(RATES)} into name series value value)")
def frm_unpivot_all(spark, d):
    return _long_rates(spark, d)


@query(f"with {_WIDE0} select date, {', '.join(RATES)}, {_feature_sql()} from wide0")
def fea_curve_all(spark, d):
    made = features.spreads(RATES) | features.butterflies(RATES) | features.cross_spreads(RATES)
    return wide(spark, d, complete=False).select("date", *RATES, *(r6(c).alias(n) for n, c in made.items()))


@query(f"""with {_WIDE0}, l as (select * from (unpivot wide0 on {', '.join(RATES)} into name series value value)),
v as (select series, var_pop(value) as v from l group by all), a as (select var_pop(value) as a from l)
select round(1 / (25 * any_value(a)), 8) as sk_scale, round(1 / (2 * sum(v)), 8) as total_variance, round(1 / (25 * max(v)), 8) as max_variance, round(1 / (2 * max(v)), 8) as unscaled_max_variance from v, a""")
def krn_bandwidths_all(spark, d):
    return _bandwidths(_long_rates(spark, d))


FLAGSHIP = plan_segment

from . import more, regimes  # noqa: E402, F401  register further queries
