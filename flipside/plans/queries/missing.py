"""Missing values and masked statistics (D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from flipside.operators import labels as L
from flipside.operators import missing as M
from flipside.plans.inputs import BY, FEATURES, OF_SQL, SEED, U, UT, order_features, s, table
from flipside.plans.registry import R, query, rounded

_FIT = "label_str <> 'F'"
_SD = str(SEED)


@query(
    "d1_masked_mean",
    f"""with {OF_SQL} select dataset_id, {R("avg(case when f_4 > 0 then f_0 end)", 'mean', 3)},
 {R("1.0::double - count(case when f_4 > 0 then f_0 end)::double/count(*)", 'ignored')} from of_ group by dataset_id""",
)
def d1(spark, sf):
    out = order_features(spark, sf).groupBy("dataset_id").agg(
        F.round(M.masked_mean("f_0", F.col("f_4") > 0), 3).alias("mean"),
        F.round(M.ignored_share("f_0", F.col("f_4") > 0), 6).alias("ignored"),
    )
    return out


@query(
    "d2_masked_std",
    f"with {OF_SQL} select dataset_id, {R('stddev_samp(case when f_4 > 0 then f_0 end)', 'std', 3)} from of_ group by dataset_id",
)
def d2(spark, sf):
    return rounded(order_features(spark, sf).groupBy("dataset_id").agg(M.masked_std("f_0", F.col("f_4") > 0).alias("std")), 3)


@query(
    "d3_nan_mean_std",
    f"""with {OF_SQL} select dataset_id, {R('avg(f_2)', 'mean')}, {R('stddev_samp(f_2)', 'std')},
 {R('1.0::double - count(f_2)::double/count(*)', 'nan_share')} from of_ group by dataset_id""",
)
def d3(spark, sf):
    rows = order_features(spark, sf).withColumn("f_2", F.coalesce("f_2", F.lit(float("nan"))))
    return rounded(
        rows.groupBy("dataset_id").agg(M.nan_mean("f_2").alias("mean"), M.nan_std("f_2").alias("std"), M.nan_share("f_2").alias("nan_share"))
    )


_RATE = UT(_SD, "dataset_id", s("rate")) + "*0.4::double"


@query(
    "d4_inject_missing_random",
    f"with {OF_SQL} select row_id, "
    + ", ".join(f"case when {U(_SD, 'row_id', s(f), s('cell'))} < {_RATE} then null else {f} end as {f}" for f in FEATURES)
    + " from of_",
)
def d4(spark, sf):
    out = M.inject_missing_random(order_features(spark, sf), FEATURES, 0.4, "dataset_id", "row_id", SEED)
    return out.select("row_id", *FEATURES)


def _bounds_sql(cols, classes, src, seed=_SD):
    """CTEs bd_<col>: boundaries at keyed random rows, one list per dataset."""
    out = [f"ix_ as (select *, row_number() over (partition by dataset_id order by row_id)-1 as pos_, count(*) over (partition by dataset_id) as n_ from {src})"]
    for c in cols:
        out.append(
            f"bd_{c} as (select i.dataset_id, list(i.{c}) as b_{c} from ix_ i join (select dataset_id, k, floor({UT(seed, 'dataset_id', s(c), 'k')}*n_)::bigint as p_ "
            f"from (select distinct dataset_id, n_ from ix_) cross join (select unnest(range({classes - 1})) as k)) d on d.dataset_id=i.dataset_id and d.p_=i.pos_ where i.{c} is not null group by i.dataset_id)"
        )
    return ",\n".join(out)


_T = f"({UT(_SD, 'dataset_id', s('t1'))}*20.0::double*0.3::double*{UT(_SD, 'dataset_id', s('t2'))})"
_DV = ["f_0", "f_4"]


@query(
    "d5_inject_missing_by_value",
    f"with {OF_SQL}, {_bounds_sql(_DV, 20, 'of_')} select row_id, "
    + ", ".join(f"case when len(list_filter(b_{c}, lambda v: {c} > v)) < {_T} then null else {c} end as {c}" for c in _DV)
    + " from of_ " + " ".join(f"join bd_{c} using (dataset_id)" for c in _DV),
)
def d5(spark, sf):
    rows, codes = L.rank_codes(order_features(spark, sf), _DV, BY, "row_id", 20, SEED)
    return M.inject_missing_by_value(rows, codes, 0.3, "dataset_id", SEED).select("row_id", *_DV)


def _kind_sql(kind, value, name):
    k = [_SD, "event_id", s(kind)]
    pick = f"floor({U(*k, s('pick'))}*4.0::double)"
    sent = f"case {pick} when 0 then -999.0::double when 1 then 0.0::double when 2 then 1.0::double else 999.0::double end"
    return f"case when {U(*k, s('nan'))} < 0.6::double then '{value}' else cast({sent} as integer)::varchar end as {name}"


def _sched_sql():
    u = {k: UT(_SD, "event_type", s(k)) for k in ("any", "none", "reason", "mech")}
    on = f"{u['any']} > 0.5"
    return f"({on}) and {u['none']} < 0.5::double as has_none, ({on}) and {u['reason']} > 0.5 as has_reason, ({on}) as has_unknown, ({on}) and {u['mech']} >= 0.3::double as unknown_by_value"


@query(
    "d6_missing_kind_value",
    f"select event_id, {_kind_sql('unknown', 'NaN', 'unknown')}, {_kind_sql('none', '-Infinity', 'none')}, {_kind_sql('reason', 'Infinity', 'reason')}, {_sched_sql()} from events",
)
def d6(spark, sf):
    ev = table(spark, sf, "events")

    def shown(kind):
        v = M.missing_value_for(kind, 0.6, SEED, F.col("event_id"), kind)
        finite = ~F.isnan(v) & (F.abs(v) != float("inf"))
        return F.when(finite, F.when(finite, v).otherwise(0.0).cast("int").cast("string")).otherwise(v.cast("string")).alias(kind)

    out = M.attach_missing_schedule(ev.select("event_id", "event_type"), "event_type", SEED, 0.5, 0.2, 0.2, 0.3)
    return out.select("event_id", *[shown(k) for k in ("unknown", "none", "reason")], "has_none", "has_reason", "has_unknown", "unknown_by_value")


@query(
    "d7_missing_indicators",
    f"""with {OF_SQL}, i_ as (select row_id, dataset_id, coalesce(f_1, 0.0::double) as f_1, case when f_1 is null then -1.0::double when f_4 < -900 then 2.0::double when f_4 > 9900 then 1.0::double else 0.0::double end as k0,
  case when f_1 is null then -1.0::double else 0.0::double end as k1, case when f_4 < 0 then 2.0::double when f_4 > 9000 then 1.0::double else 0.0::double end as k4, case when f_4 < 0 or f_4 > 9000 then 0.0::double else f_4 end as f_4 from of_),
st as (select dataset_id, avg(k1) as m1, stddev_samp(k1) as s1, avg(k4) as m4, stddev_samp(k4) as s4 from i_ group by dataset_id)
select row_id, f_1, f_4, {R('(k1-m1)/(s1+0.000001::double)', 'f_1_miss')}, {R('(k4-m4)/(s4+0.000001::double)', 'f_4_miss')} from i_ join st using (dataset_id)""",
)
def d7(spark, sf):
    rows = order_features(spark, sf).withColumn(
        "f_4", F.when(F.col("f_4") < 0, F.lit(float("-inf"))).when(F.col("f_4") > 9000, F.lit(float("inf"))).otherwise(F.col("f_4"))
    )
    out = M.missing_indicators(rows, ["f_1", "f_4"], BY)
    return out.select("row_id", "f_1", "f_4", F.round("f_1_miss", 6).alias("f_1_miss"), F.round("f_4_miss", 6).alias("f_4_miss"))


@query("d8_fill_missing", f"with {OF_SQL} select row_id, {', '.join(f'coalesce({f},0.0::double) as {f}' for f in FEATURES)} from of_")
def d8(spark, sf):
    return M.fill_missing(order_features(spark, sf), FEATURES).select("row_id", *FEATURES)


@query(
    "d9_impute_mean",
    f"""with {OF_SQL}, st as (select dataset_id, {', '.join(f'avg(case when {_FIT} then {f} end) as m_{f}' for f in FEATURES)} from of_ group by dataset_id)
select row_id, {', '.join(R(f'coalesce({f}, m_{f})', f, 3) for f in FEATURES)} from of_ join st using (dataset_id)""",
)
def d9(spark, sf):
    return rounded(M.impute_mean(order_features(spark, sf), FEATURES, BY, F.expr(_FIT)).select("row_id", *FEATURES), 3)


@query("d10_categorical_missing", f"with {OF_SQL} select row_id, coalesce(f_1::int, -1) as f_1, coalesce(trunc(f_2)::int, -1) as f_2 from of_")
def d10(spark, sf):
    return M.categorical_missing_as_class(order_features(spark, sf), ["f_1", "f_2"]).select("row_id", "f_1", "f_2")
