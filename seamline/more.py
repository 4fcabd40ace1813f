"""Further registered queries of the regime engine: curves with gaps, hyper-parameters, searches, trees of breaks, scores, replays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import queries as q
from .functions import evaluation, features, hyper, insights, labels, scores
from .operators import detectors, factors, frames, search, twosample
from .operators import reduce as reductions
from .plans import explain, segmentation
from .queries import CURVES, DAILY, HOURLY, ORACLE, RATES, SOURCES, TENORS, WIDE, curves, daily, hourly, load, query, r6, rates, wide
from .sources import panels, sinks
from .streaming import incremental

_LAB, _FX = q._LAB, """fx as (select date_trunc('month', o_orderdate)::date as date, o_orderkey, o_totalprice as EURUSD from orders),
lastfx as (select date, EURUSD from fx qualify row_number() over (partition by date order by o_orderkey desc) = 1)"""

# --- sources and frames -----------------------------------------------------------------------


@query(f"with {WIDE}, {_FX} select wide.*, EURUSD from wide join lastfx using (date) where EURUSD is not null")
def src_rates_and_fx(spark, d):
    fx = load(spark, d, "orders").select(F.trunc("o_orderdate", "month").alias("date"), "o_orderkey", F.col("o_totalprice").alias("EURUSD"))
    return panels.rates_and_fx(rates(spark, d), list(SOURCES.values()), TENORS, fx, F.col("o_orderkey")).drop("o_orderkey")


@query("select o_orderdate::date::timestamp as date, count(*) as orders, round(sum(o_totalprice), 2) as total from orders where o_orderdate::date between '1994-01-01' and '1996-12-31' group by all")
def src_sql(spark, d):
    text = f"select cast(o_orderdate as date) as date, count(*) as orders, round(sum(o_totalprice), 2) as total from parquet.`{d}/orders.parquet` group by 1"
    return panels.read(spark, "sql", text, start="1994-01-01", end="1996-12-31")


@query(f"with {q.RATES_SQL} select * from rates")
def frm_sorted(spark, d):
    return frames.sorted_rows(rates(spark, d), "source")


@query(f"""with {q._WIDE0} select date, 'EUR' as source, {', '.join(f'EUR_{t} as {t}' for t in TENORS)} from wide0
union all select date, 'AME' as source, {', '.join(f'AME_{t} as {t}' for t in TENORS[:3])}, null, null from wide0""")
def frm_curves(spark, d):
    return frames.curves_of(wide(spark, d, complete=False).drop(*(f"AME_{t}" for t in TENORS[3:])), ["EUR", "AME"])


@query(f"with {WIDE} select (row_number() over (order by date) - 1)::int as t, date, {', '.join(RATES)} from wide")
def frm_matrix(spark, d):
    p = wide(spark, d).withColumn("series", F.lit("")).withColumn("t", F.row_number().over(Window.partitionBy("series").orderBy("date")) - 1)
    return frames.from_matrix(frames.matrix(p, RATES), RATES)


@query(f"with {DAILY}, x as (select *, count(*) over (partition by series) as n from daily) select series, date, value, t from x where t % greatest(1, ceil(n / 100.0)) = 0")
def frm_thinned(spark, d):
    return frames.thinned(daily(spark, d), 100)


@query(f"""with {DAILY}, x as (select series, date, t, row_number() over (partition by series order by t) - 1 as k, count(*) over (partition by series) as n from daily),
i as (select distinct series, floor(g * (n - 1) / 39.0)::bigint as k from x, range(40) r(g) where x.k = 0) select x.series, date, t from x join i using (series, k)""")
def frm_spread_over(spark, d):
    return frames.spread_over(daily(spark, d).select("series", "date", "t"), 40, "t")


# --- windows and features ---------------------------------------------------------------------


@query(f"""with {DAILY}, m as (select series, t, case when count(value) over w >= 3 then avg(value) over w end as m, case when count(value) over w >= 5 then round(stddev_samp(value) over w, 6) end as s from daily window w as (partition by series order by t rows between 19 preceding and current row))
select series, t, round(coalesce(last_value(m ignore nulls) over (partition by series order by t rows between unbounded preceding and current row), first_value(m ignore nulls) over (partition by series order by t rows between current row and unbounded following)), 6) as mean, s as deviation from m""")
def win_filled(spark, d):
    p = daily(spark, d).withColumn("m", features.rolling(F.col("value"), 20, F.avg, 3)).withColumn("deviation", r6(features.rolling(F.col("value"), 20, least=5)))
    return p.select("series", "t", r6(features.filled(F.col("m"))).alias("mean"), "deviation")


@query(f"""with {HOURLY} select series, t, case when t >= 4 then round(pow(9.0::double / 11, t) * sum(value * pow(11.0::double / 9, t)) over (partition by series order by t) * (2.0::double / 11) / (1 - pow(9.0::double / 11, t + 1)), 6) end as ewma from hourly""")
def fea_ewma_adjusted(spark, d):
    return features.ewma(hourly(spark, d), 10, adjust=True, least=5).select("series", "t", r6("ewma").alias("ewma"))


_KEYS = [f"{s}_{TENORS[-1]}" for s in SOURCES.values()][:4]
_KEY_SQL = {f"{c}_vol": f"case when count({c}) over w >= 12 then stddev_samp({c}) over w end" for c in _KEYS} | {
    f"{a}_{b}_corr": f"case when count(*) over w >= 12 then corr({a}, {b}) over w end" for i, a in enumerate(_KEYS) for b in _KEYS[i + 1 :]
}


@query(f"""with {WIDE}, f as (select *, {q._sql(_KEY_SQL)} from wide window w as (order by date rows between 11 preceding and current row))
select date, {', '.join(RATES)}, {q._feature_sql()}, {', '.join(f'round({c}, 6) as {c}' for c in _KEY_SQL)} from f where {' and '.join(f'{c} is not null' for c in _KEY_SQL)}""")
def fea_complete(spark, d):
    out = features.curve_features(q.stored(spark, d), 12, 12)
    return out.select("date", *(c if c in RATES else r6(c).alias(c) for c in out.columns[1:]))


_FIVE = RATES[:5]


def _ewma_sql(c: str) -> str:
    return f"round(pow(9.0::double / 11, t) * sum({c} * case when t = 0 then 1 else 2.0::double / 11 * pow(11.0::double / 9, t) end) over (order by t), 6) as {c}_ewma"


@query(f"with {WIDE}, x as (select *, (row_number() over (order by date) - 1)::int as t from wide) select date, {', '.join(RATES)}, {', '.join(map(_ewma_sql, _FIVE))} from x")
def fea_with_ewma(spark, d):
    out = features.with_ewma(q.stored(spark, d), span=10)
    return out.select("date", *(r6(c).alias(c) if c.endswith("_ewma") else c for c in out.columns[1:]))


@query(f"with {WIDE} select * replace (date::timestamp as date) from wide")
def fea_hook(spark, d):
    return features.featured(wide(spark, d), generator="seamline.functions.features.unchanged")


@query(f"""with {CURVES}, p as (select a.source, sqrt({' + '.join(f'(a.{t} - b.{t}) * (a.{t} - b.{t})' for t in TENORS)}) as d from curves a join curves b using (source))
select source, round(1 / (2 * pow(greatest(quantile_cont(d, 0.5), 1e-8), 2)), 8) as gamma from p group by all""")
def krn_median(spark, d):
    return twosample.median_gammas(rates(spark, d).na.drop(subset=TENORS), ["source"], TENORS).withColumn("gamma", F.round("gamma", 8))


@query()
def krn_nystroem(spark, d):
    return factors.feature_map(q.stored(spark, d), RATES, "nystroem", n=40, gamma=1e-4)


@query()
def dr_fpca(spark, d):
    return q.by_source(reductions.functional_components(curves(spark, d), TENORS, 2))


@query(f"with {DAILY}, x as (select series, date, t, round(value - lag(value) over (partition by series order by t), 6) as value from daily) select * from x where value is not null")
def krn_differences(spark, d):
    return twosample.differences(daily(spark, d)).select("series", "date", "t", r6("value").alias("value"))


# --- hyper-parameters, search and tests -----------------------------------------------------------


@query(f"""with l as ({ORACLE['hyp_decay_lag']}), e as ({ORACLE['hyp_ess_window']}), {DAILY}, tr as (select series, t::bigint as b from daily where t % 200 = 0 and t > 0)
select tr.series, b, coalesce(lag, 5)::int as lag, width, least(2 * width, greatest(round(0.5 * 2 * width), 50))::int as samples from tr left join l on l.series = tr.series and label = b join e on e.series = tr.series""")
def hyp_chosen(spark, d):
    return hyper.chosen(daily(spark, d), q._breaks(spark, d), "decay", "ess", share=0.5)


@query()
def hyp_component_lag(spark, d):
    p = q.stored(spark, d).withColumn("series", F.lit("")).withColumn("t", F.row_number().over(Window.partitionBy("series").orderBy("date")) - 1)
    return hyper.widest_lag(hyper.component_panel(p, RATES), p.where("t >= 20 and t < 60").select(F.col("t").cast("long").alias("b")), width=20, most=10)


@query(f"""with {HOURLY}, p as (select a.series, a.t as i, b.t as j, 2 * exp(-least(1e2, greatest(1e-2, 0.05 * (a.value - b.value) * (a.value - b.value)))) as k from hourly a join hourly b on a.series = b.series and a.t < b.t),
la as (select series, j as t, sum(k) as late from p group by all), ea as (select series, i as t, sum(k) as early from p group by all),
x as (select h.series, h.t, coalesce(late, 0) + 1 as late, coalesce(early, 0) + 1 as early, count(*) over (partition by h.series) as n from hourly h left join la on la.series = h.series and la.t = h.t left join ea on ea.series = h.series and ea.t = h.t),
y as (select *, sum(late) over (partition by series order by t rows between unbounded preceding and 1 preceding) as before, sum(early) over (partition by series order by t rows between current row and unbounded following) as after from x)
select series, t::bigint as b, round(n - before / t - after / (n - t), 4) as cost from y where t % 5 = 0 and t >= 10 and n - t >= 10 qualify row_number() over (partition by series order by n - before / t - after / (n - t), t) = 1""")
def sch_best_split_rbf(spark, d):
    return search.best_split_rbf(hourly(spark, d), 0.05).withColumn("cost", F.round("cost", 4))


#: One key for series and row, as three joins on the series alone would be tried first.
_EDGES = """ed as materialized (select series || '#' || t as k, s from (select series, t::bigint as t, coalesce(sum(value) over (partition by series order by t rows between unbounded preceding and 1 preceding), 0) as s from hourly
union all select series, count(*) as t, sum(value) as s from hourly group by series))"""


def _gain_sql(name: str, segments: str, jump: int = 5) -> str:
    return f"""{name}_t as materialized (select series, lo, hi, unnest(range(lo + {-(-10 // jump) * jump}, hi - 9, {jump})) as b from {segments}),
{name} as materialized (select g.series, g.lo, g.hi, g.b, pow(m.s - a.s, 2) / (g.b - g.lo) + pow(z.s - m.s, 2) / (g.hi - g.b) - pow(z.s - a.s, 2) / (g.hi - g.lo) as gain
from {name}_t g join ed a on a.k = g.series || '#' || g.lo join ed z on z.k = g.series || '#' || g.hi join ed m on m.k = g.series || '#' || g.b)"""


def _binseg_sql(rounds: int) -> str:
    steps = [HOURLY, _EDGES, "g1 as (select series, 0::bigint as lo, count(*) as hi from hourly group by all)"]
    for k in range(1, rounds + 1):
        steps.append(_gain_sql(f"c{k}", f"g{k}"))
        steps.append(f"x{k} as materialized (select * from c{k} qualify row_number() over (partition by series order by gain desc, lo, b) = 1)")
        steps.append(f"g{k + 1} as materialized (select series, lo, hi from g{k} anti join x{k} using (series, lo, hi) union all select series, lo, b from x{k} union all select series, b, hi from x{k})")
    return "with " + ",\n".join(steps) + " " + " union all ".join(f"select series, b from x{k}" for k in range(1, rounds + 1))


ORACLE["sch_binseg"] = _binseg_sql(3)
_SPANS = """nn as (select series, count(*) as n from hourly group by all), hx as (select series, n, md5('42:' || series || ':' || k) as h from nn, range(1, 61) g(k)),
en as (select series, ('0x' || substr(h, 1, 13))::bigint % (n + 1) as a, ('0x' || substr(h, 14, 13))::bigint % (n + 1) as z from hx), sp as materialized (select distinct series, least(a, z) as lo, greatest(a, z) as hi from en)"""


@query(f"""with {HOURLY}, {_EDGES}, {_SPANS}, {_gain_sql('ca', 'sp', 1)} select series, lo, hi, b, round(sqrt(greatest(0, gain)), 6) as stat from ca qualify row_number() over (partition by series, lo, hi order by gain desc, b) = 1""")
def sch_span_splits(spark, d):
    p = hourly(spark, d)
    return search.span_splits(p, search.random_spans(p, 60)).withColumn("stat", r6("stat"))


@query(f"""with {HOURLY}, dd as (select series, value - lag(value) over (partition by series order by t) as d from hourly), m as (select series, quantile_cont(d, 0.5) as m, count(*) as n from dd group by all)
select series, round(1.4826 / sqrt(2) * quantile_cont(abs(d - m), 0.5) * sqrt(2 * ln(max(n))), 6) as "limit" from dd join m using (series) group by series""")
def sch_noise_limits(spark, d):
    return search.noise_limits(hourly(spark, d)).withColumn("limit", r6("limit"))


@query(f"""with {DAILY}, g as (select series, t, avg(value) over l as l, avg(value) over r as r, count(value) over l as nl, count(value) over r as nr from daily
window l as (partition by series order by t rows between 20 preceding and 1 preceding), r as (partition by series order by t rows between current row and 19 following)),
k as (select series, t, (l - r) * (l - r) as g from g where nl = 20 and nr = 20), m as (select *, max(g) over (partition by series order by t rows between 20 preceding and 20 following) as top from k)
select series, t::bigint as b from m where g = top""")
def sch_candidates(spark, d):
    return search.candidates(daily(spark, d), "window")


for _kind in ("hotelling", "ks", "mcusum", "mmd_ts", "mmd_linear", "energy"):
    q.QUERIES[f"tst_{_kind}_p"] = lambda spark, d, kind=_kind: twosample.test_breaks(daily(spark, d), q._breaks(spark, d), kind)

# --- detectors and labels ---------------------------------------------------------------------------


@query()
def det_covariance(spark, d):
    p = rates(spark, d).na.drop(subset=TENORS).withColumnRenamed("source", "series")
    p = p.withColumn("t", F.row_number().over(Window.partitionBy("series").orderBy("date")) - 1)
    return detectors.covariance_regimes(p, TENORS, 24, least=5)


@query()
def det_smoothed(spark, d):
    return detectors.volatility_levels(hourly(spark, d), least=10)


def _levelled(spark, d) -> DataFrame:
    """Breaks of the quarters with levels 1 to 3."""
    b = q._truth(spark, d)
    return b.withColumn("level", (F.row_number().over(Window.partitionBy("series").orderBy("b")) % 3 + 1).cast("int"))


_LEVELS = f"{_LAB}, w0 as (select *, lag(label) over (partition by series order by t) as was from lab), lv as (select series, t::bigint as b, (row_number() over (partition by series order by t) % 3 + 1)::int as level from w0 where was <> label), nl as (select series, count(*) as n from daily group by all)"


@query(f"""with {_LEVELS}, o as (select series, t::bigint as b, 9 as level from daily where t % 200 = 0 and t > 0) select series, b, coalesce(o.level, lv.level)::int as level from lv full join o using (series, b)""")
def lbl_combined(spark, d):
    return labels.combined([_levelled(spark, d), q._breaks(spark, d).withColumn("level", F.lit(9))])


@query(f"""with {_LEVELS}, e as (select d.series, d.date as start, lead(d.date) over o as nx, lead(lv.level) over o as nl_, max(last) over (partition by d.series) as last
  from (select *, max(date) over (partition by series) as last from daily) d left join lv on lv.series = d.series and lv.b = d.t where d.t = 0 or lv.level is not null window o as (partition by d.series order by d.t))
select series, start, coalesce(nx, last) as "end", coalesce(nl_, 0)::int as level from e""")
def lbl_seed_table(spark, d):
    return labels.seed_table(daily(spark, d), _levelled(spark, d))


@query(f"with {_LEVELS} select series, b, level from lv")
def lbl_breaks_of_seeds(spark, d):
    p = daily(spark, d)
    return labels.breaks_of_seeds(p, labels.seed_table(p, _levelled(spark, d)))


_TREE = """lo_ as (select series, b, l::int as level from lv, range(1, 4) g(l) where l >= lv.level union all select series, 0, l::int from nl, range(1, 4) g(l)),
iv as (select lo_.series, lo_.level, b as lo, coalesce(lead(b) over (partition by lo_.series, lo_.level order by b), n) as hi from lo_ join nl on nl.series = lo_.series union all select series, 0, 0, n from nl),
fr as (select series, lo, hi, min(level)::int as level from iv group by all),
tr_ as (select fr.series, fr.level, fr.lo::bigint as lo, fr.hi::bigint as hi, up.lo::bigint as parent_lo, up.hi::bigint as parent_hi from fr left join iv up on up.series = fr.series and up.level = fr.level - 1 and up.lo <= fr.lo and fr.hi <= up.hi)"""


@query(f"with {_LEVELS}, {_TREE} select * replace (coalesce(parent_lo, -1) as parent_lo, coalesce(parent_hi, -1) as parent_hi) from tr_")
def lbl_interval_tree(spark, d):
    return labels.interval_tree(_levelled(spark, d), q._lengths(spark, d)).na.fill(-1, ["parent_lo", "parent_hi"])


@query(f"with {_LEVELS}, {_TREE} select series, level, lo, repeat('  ', level) || '[' || lo || ',' || hi || ')' as line from tr_")
def snk_hierarchy(spark, d):
    return sinks.hierarchy_lines(labels.interval_tree(_levelled(spark, d), q._lengths(spark, d)))


@query(f"with {DAILY} select series, t, (t * 3 + 6)::bigint as middle, greatest(0, floor((t - 6) / 3.0))::bigint as win from daily")
def lbl_windows(spark, d):
    return daily(spark, d).select("series", "t", labels.row_of_window(F.col("t"), 3, 12).alias("middle"), labels.window_of_row(F.col("t"), 3, 12).alias("win"))


@query(f"with {_LEVELS} select series, b + 300 as b, level from lv join nl using (series) where b + 300 < n")
def lbl_inside(spark, d):
    n = q._lengths(spark, d)
    return labels.inside(labels.shifted(_levelled(spark, d), n.select("series", F.lit(300).alias("start"))), n)


@query(f"with {_LEVELS} select series, b, level from lv where b <= 500 or b >= 900 union all select series, b + 500 as b, 4 as level from lv where b > 0 and b < 400 and b + 500 not in (select b from lv l2 where l2.series = lv.series and b <= 500 or b >= 900)")
def lbl_attached(spark, d):
    own = _levelled(spark, d)
    return labels.attached(own.where("b <= 500 or b >= 900"), own.withColumn("level", F.lit(4)), 500, 900)


# --- evaluation, scores and insights ------------------------------------------------------------------


@query()
def eva_temporal_hamming(spark, d):
    out = evaluation.temporal_hamming(q._pairs(spark, d))
    return out.select("series", "hamming", r6("annotation_error").alias("annotation_error"), r6("accuracy").alias("accuracy"))


@query(f"""with {q._TWO}, nl as (select series, count(*) as n from daily group by all), m as (select series, b, min(abs(b - p)) as near from tr join fo using (series) where series not like '5%' group by all)
select series, coalesce(max(near), any_value(n))::bigint as distance from nl left join m using (series) group by series""")
def eva_hausdorff_lengths(spark, d):
    return evaluation.hausdorff(q._breaks(spark, d).where("series not like '5%'"), q._truth(spark, d), q._lengths(spark, d))


@query(ORACLE["eva_information"].replace("round(2 * (mi / ha) * (mi / hb) / (mi / ha + mi / hb), 6) as v", "round(1.5 * (mi / ha) * (mi / hb) / (0.5 * (mi / ha) + mi / hb), 6) as v"))
def eva_v_beta(spark, d):
    out = evaluation.information(q._pairs(spark, d), 0.5)
    return out.select("series", *(r6(c).alias(c) for c in out.columns[1:]))


@query(f"""with {_LAB}, a as (select *, value - lag(value) over w as d1 from lab window w as (partition by series, label order by t)), b as (select *, d1 - lag(d1) over w as d2 from a window w as (partition by series, label order by t))
select series, label, round(coalesce(var_pop(d2), 0), 4) as score from b group by all""")
def sco_mse_diff2(spark, d):
    return scores.score(q._labels(spark, d), "mse_on_diff", order=2).withColumn("score", F.round("score", 4))


_SPLITS = f"""{_LAB}, k0 as (select series, label, value, t, row_number() over (partition by series, label order by t) - 1 as k, count(*) over (partition by series, label) as n from lab),
k1 as (select series, label, value, row_number() over (partition by series, label order by k) - 1 as k, count(*) over (partition by series, label) as n from k0 where k % greatest(1, ceil(n / 80.0))::bigint = 0),
k2 as (select *, unnest(list_distinct([floor(10 + (n - 21) * i / 4.0)::bigint for i in range(5)])) as split from k1 where n > 20),
k3 as (select *, (k >= split)::int as side from k2), prs as (select a.series, a.label, a.split, a.side as s1, b.side as s2, a.value as v1, b.value as v2 from k3 a join k3 b using (series, label, split))"""


@query(f"with {_SPLITS}, st as (select series, label, split, -({q._mean_sql('abs(v1 - v2)')}) as s from prs group by all) select series, label, round(greatest(0, max(s)), 6) as score from st group by all")
def sco_energy_split(spark, d):
    return scores.energy_split(q._labels(spark, d)).withColumn("score", r6("score"))


@query(f"with {_SPLITS}, st as (select series, label, split, {q._mean_sql(q._K)} as s from prs group by all) select series, label, round(greatest(0, max(s)), 6) as score from st group by all")
def sco_mmd_split(spark, d):
    return scores.mmd_split(q._labels(spark, d), estimator="biased", gamma=1e-6).withColumn("score", r6("score"))


@query()
def sco_mmd_split_median(spark, d):
    return scores.mmd_split(q._labels(spark, d)).withColumn("score", r6("score"))


@query()
def sco_cusum(spark, d):
    return scores.cusum_intensity(q._labels(spark, d)).withColumn("score", r6("score"))


def _eras(spark, d) -> DataFrame:
    return q.stored(spark, d).withColumn("label", F.floor((F.year("date") - 1990) / 2).cast("int"))


_ERA = f"{WIDE}, era as (select *, ((year(date) - 1990) // 2)::int as label from wide)"
_A, _B = "EUR_Y001p0", "AME_Y001p0"


@query()
def sco_factor_residual(spark, d):
    return scores.factor_residual(_eras(spark, d), RATES, 2).withColumn("score", r6("score"))


@query(f"""with {_ERA}, c as (select var_samp({_A}) + 1e-6 as a, covar_samp({_A}, {_B}) as b, var_samp({_B}) + 1e-6 as c from era), m as (select label, avg({_A}) as x, avg({_B}) as y from era group by all)
select p.label as a, r.label as b, round(sqrt(greatest(0, (c.c * (p.x - r.x) * (p.x - r.x) - 2 * c.b * (p.x - r.x) * (p.y - r.y) + c.a * (p.y - r.y) * (p.y - r.y)) / (c.a * c.c - c.b * c.b))), 6) as d from m p, m r, c""")
def ins_mahalanobis(spark, d):
    return insights.mahalanobis(_eras(spark, d), [_A, _B]).withColumn("d", r6("d"))


@query(f"with {_LAB} select series, label, round(avg(value), 4) as mean from lab group by all")
def ins_regime_means(spark, d):
    return insights.regime_means(q._labels(spark, d)).withColumn("mean", F.round("mean", 4))


@query()
def ins_regime_groups(spark, d):
    return insights.regime_groups(_eras(spark, d), RATES)


@query(f"with {_ERA}, s as (select label, count(*) / sum(count(*)) over () as p from era group by label) select x.label as a, y.label as b, round(y.p, 6) as p from s x, s y")
def ins_leaf_transitions(spark, d):
    rows = _eras(spark, d)
    model, _ = explain.tree(rows, RATES)
    return insights.leaf_transitions(explain.leaf_masses(model, rows, RATES)).withColumn("p", r6("p"))


@query(f"with {WIDE} select date, {', '.join(f'round({c} * 100, 4) as {c}' for c in RATES)} from wide")
def exp_basis_points(spark, d):
    return explain.in_basis_points(wide(spark, d), RATES).select("date", *(F.round(c, 4).alias(c) for c in RATES))


@query(f"with s as ({ORACLE['eva_information']}) select 'run' as run_id, '{{\"depth\": 2}}' as knobs, series, metric, value from (unpivot s on homogeneity, completeness, v, nmi into name metric value value)")
def snk_performance(spark, d):
    return sinks.performance_rows(q.eva_information(spark, d), "run", depth=2)


# --- ensembles and replays ------------------------------------------------------------------------------


@query()
def ens_prefix_runs(spark, d):
    return segmentation.prefix_runs(hourly(spark, d))


@query()
def ens_panel(spark, d):
    p = q.stored(spark, d).withColumns({"series": F.lit("rates"), "t": F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("date")) - 1})
    return segmentation.panel_breaks(p, features.panel_groups(RATES), 5, 0.3, width=10, lag=0, kind="ks", alpha=0.2)[1]


@query()
def str_replay(spark, d):
    return incremental.replay(hourly(spark, d), depth=1)


@query()
def str_replay_rolling(spark, d):
    return incremental.replay(hourly(spark, d), mode="rolling", depth=1)


