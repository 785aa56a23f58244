"""Feature transforms (E)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from flipside.functions import stats as S
from flipside.operators import transforms as X
from flipside.plans.inputs import (
    BY,
    FEATURES,
    OF_SQL,
    SEED,
    Z_SQL,
    embedding_points,
    order_features,
    pairs,
    pairs_sql,
    scored_orders,
)
from flipside.plans.registry import R, query, r6, rounded
from flipside.session import checkpointed

_FIT = "label_str <> 'F'"


def _digits(f: str, digits: int) -> int:
    return 6 if f == "f_3" else digits  # discounts are fractions with up to 6 digits


def _each(fmt: str, digits: int = 6) -> str:
    return ", ".join(R(fmt.replace("#", f), f, _digits(f, digits)) for f in FEATURES)


def _stats(fmt: str) -> str:
    return ", ".join(fmt.replace("#", f) for f in FEATURES)


def _out(df, digits=6):
    return df.select("row_id", *[r6(f, f, _digits(f, digits)) for f in FEATURES])


_CLIP = "case when {0} < -100 then -100.0::double when {0} > 100 then 100.0::double else {0} end"


@query(
    "e1_zscore",
    f"""with {OF_SQL}, st as (select dataset_id, {_stats('avg(#) as m_#, stddev_samp(#) as s_#')} from of_ group by dataset_id)
select row_id, {_each(_CLIP.format('((#-m_#)/(s_#+0.000001::double))'))} from of_ join st using (dataset_id)""",
)
def e1(spark, sf):
    return _out(X.zscore(order_features(spark, sf), FEATURES, BY))


@query(
    "e1_zscore_fit_on",
    f"""with {OF_SQL}, st as (select dataset_id, {_stats(f'avg(case when {_FIT} then # end) as m_#, stddev_samp(case when {_FIT} then # end) as s_#')} from of_ group by dataset_id)
select row_id, {_each('(#-m_#)/(s_#+0.000001::double)')} from of_ join st using (dataset_id)""",
)
def e1_fit(spark, sf):
    return _out(X.zscore(order_features(spark, sf), FEATURES, BY, F.expr(_FIT), clip=None))


def _soft_clip_sql(n: float) -> str:
    return f"""with {OF_SQL}, a as (select dataset_id, {_stats('avg(#) as m_#, stddev_samp(#) as s_#')} from of_ group by dataset_id),
b as (select of_.dataset_id, {_stats(f'avg(case when # <= m_#+s_#*{n} and # >= m_#-s_#*{n} then # end) as n_#, stddev_samp(case when # <= m_#+s_#*{n} and # >= m_#-s_#*{n} then # end) as t_#')} from of_ join a using (dataset_id) group by of_.dataset_id),
c as (select row_id, {_stats(f'n_#, t_#, case when -ln(1.0::double+abs(#))+(n_#-t_#*{n}) > # then -ln(1.0::double+abs(#))+(n_#-t_#*{n}) else # end as #')} from of_ join b using (dataset_id))
select row_id, {_each(f'case when ln(1.0::double+abs(#))+(n_#+t_#*{n}) < # then ln(1.0::double+abs(#))+(n_#+t_#*{n}) else # end', 3)} from c"""


@query("e2_soft_clip_outliers", _soft_clip_sql(1.5))
def e2(spark, sf):
    return _out(X.soft_clip_outliers(order_features(spark, sf), FEATURES, BY, n_sigma=1.5), 3)


@query("e2_soft_clip_outliers_4sigma", _soft_clip_sql(4.0))
def e2b(spark, sf):
    return _out(X.soft_clip_outliers(order_features(spark, sf), FEATURES, BY), 3)


@query(
    "e3_to_ranking",
    f"with {OF_SQL}, c as ("
    + " union all ".join(f"select dataset_id, row_id, {i} as feat, {f} as value from of_ where {f} is not null" for i, f in enumerate(FEATURES))
    + ") select dataset_id, row_id, feat, (rank() over (partition by dataset_id, feat order by value) + count(*) over (partition by dataset_id, feat, value) - 1)::bigint as rank from c",
)
def e3(spark, sf):
    out = X.to_ranking(checkpointed(order_features(spark, sf)), FEATURES, BY, "row_id")
    return out.select("dataset_id", "row_id", "feat", F.col("rank").cast("long").alias("rank"))


@query(
    "e4_minmax_target",
    f"""with {Z_SQL}, st as (select dataset_id, min(y) as lo, max(y) as hi from so_ group by dataset_id)
select row_id, {R('(y-lo)/(hi-lo)', 'y')} from so_ join st using (dataset_id)""",
)
def e4(spark, sf):
    return rounded(X.minmax(scored_orders(spark, sf), ["y"], BY).select("row_id", "y"))


@query(
    "e5_minmax_features",
    f"""with {OF_SQL}, st as (select dataset_id, {_stats(f'min(case when {_FIT} then # end) as lo_#, max(case when {_FIT} then # end) as hi_#')} from of_ group by dataset_id)
select row_id, {_each('(#-lo_#)/(hi_#-lo_#)')} from of_ join st using (dataset_id)""",
)
def e5(spark, sf):
    return _out(X.minmax(order_features(spark, sf), FEATURES, BY, F.expr(_FIT)))


@query(
    "e6_robust_scale",
    f"""with {OF_SQL}, st as (select dataset_id, {_stats('quantile_cont(#,0.25) as a_#, quantile_cont(#,0.5) as b_#, quantile_cont(#,0.75) as c_#')} from of_ group by dataset_id)
select row_id, {_each('(#-b_#)/((c_#-a_#)/1.3489795003921634::double)')} from of_ join st using (dataset_id)""",
)
def e6(spark, sf):
    return _out(X.robust_scale(order_features(spark, sf), FEATURES, BY))


_LAMS = [0.5, 1.5, 0.0, 2.0, -0.5]


def _yj(f: str, lam: float) -> str:
    up = f"(pow({f}+1, {lam}::double)-1)/{lam}::double" if lam else f"ln(1.0::double+{f})"
    two = 2.0 - lam
    down = f"-(pow(1-{f}, {two}::double)-1)/{two}::double" if two else f"-ln(1.0::double-{f})"
    return f"case when {f} >= 0 then {up} else {down} end"


@query(
    "e7_power_transform",
    f"""with {Z_SQL}, t as (select row_id, dataset_id, {', '.join(f'{_yj(f, lam)} as {f}' for f, lam in zip(FEATURES, _LAMS))} from so_),
st as (select dataset_id, {_stats('avg(#) as m_#, stddev_pop(#) as s_#')} from t group by dataset_id)
select row_id, {_each('(#-m_#)/(case when s_#=0 then 1.0::double else s_# end)')} from t join st using (dataset_id)""",
)
def e7(spark, sf):
    return _out(X.power_transform(scored_orders(spark, sf), FEATURES, BY, lambdas=_LAMS))


def _fit_power_sql(rounds: int = 4, grid: int = 17, reach: float = 4.0) -> str:
    """The same narrowing grid: a round scores all candidates around the last best one."""
    ctes = ["v_ as (" + " union all ".join(f"select dataset_id, {i} as feat, {f} as v from so_ where {f} is not null" for i, f in enumerate(FEATURES)) + ")"]
    ctes.append("b0_ as (select distinct dataset_id, feat, 0.5::double as centre from v_)")
    up = "case when abs(lam) > 1e-12 then (pow(v + 1.0::double, lam) - 1.0::double)/lam else ln(1.0::double + v) end"
    down = "case when abs(2.0::double - lam) > 1e-12 then -(pow(1.0::double - v, 2.0::double - lam) - 1.0::double)/(2.0::double - lam) else -ln(1.0::double - v) end"
    width = reach
    for r in range(rounds):
        step = 2.0 * width / (grid - 1)
        ctes.append(f"l{r}_ as (select dataset_id, feat, centre + ({-width!r}::double + {step!r}::double*i) as lam from b{r}_ cross join (select unnest(range({grid})) as i))")
        ctes.append(
            f"s{r}_ as (select dataset_id, feat, lam, count(*) as n, var_pop(case when v >= 0 then {up} else {down} end) as vr, sum(sign(v)*ln(1.0::double + abs(v))) as sl from v_ join l{r}_ using (dataset_id, feat) group by dataset_id, feat, lam)"
        )
        ctes.append(f"b{r + 1}_ as (select dataset_id, feat, arg_max(lam, -n/2.0::double*ln(vr) + (lam - 1.0::double)*sl) as centre from s{r}_ where vr > 0 group by dataset_id, feat)")
        width = step
    return f"with {Z_SQL}, {', '.join(ctes)} select dataset_id, feat, {R('centre', 'lam')} from b{rounds}_"


@query("e7_fit_power", _fit_power_sql())
def e7_fit(spark, sf):
    return rounded(X.fit_power(scored_orders(spark, sf), FEATURES, BY))


def _horner(cs, x):
    acc = f"({cs[0]!r}::double)"
    for c in cs[1:]:
        acc = f"({acc}*{x}+({c!r}::double))"
    return acc


def _icdf(p):
    q, r = f"({p}-0.5::double)", f"(({p}-0.5::double)*({p}-0.5::double))"
    lo, hi = f"sqrt(-2.0::double*ln({p}))", f"sqrt(-2.0::double*ln(1.0::double-{p}))"
    mid = f"{_horner(S.ICDF_A, r)}*{q}/({_horner(S.ICDF_B, r)}*{r}+1.0::double)"

    def tail(t):
        return f"{_horner(S.ICDF_C, t)}/({_horner(S.ICDF_D, t)}*{t}+1.0::double)"

    return f"case when {p} < {S.ICDF_LOW} then {tail(lo)} when {p} > {1 - S.ICDF_LOW!r} then -({tail(hi)}) else {mid} end"


_PROBS = "[" + ", ".join(f"{i / 99!r}::double" for i in range(100)) + "]"


@query(
    "e8_quantile_normal",
    f"""with {OF_SQL}, st as (select dataset_id, {_stats(f'quantile_cont(#, {_PROBS}) as q_#')} from of_ group by dataset_id),
a as (select row_id, {_stats('#, q_#, len(list_filter(q_#, lambda v: v < #)) as b_#, len(list_filter(q_#, lambda v: v <= #)) as u_#')} from of_ join st using (dataset_id)),
b as (select row_id, {_stats('case when # is null then null when b_#=0 and u_#=0 then 0.0::double when b_#=100 then 1.0::double when u_# > b_# then (b_#+u_#-1)/198.0::double else (b_#-1+(#-q_#[b_#])/(q_#[b_#+1]-q_#[b_#]))/99.0::double end as #')} from a),
c as (select row_id, {_stats('case when # < 1e-7::double then 1e-7::double when # > 1-1e-7::double then 1-1e-7::double else # end as #')} from b)
select row_id, {', '.join(R(_icdf(f), f) for f in FEATURES)} from c""",
)
def e8(spark, sf):
    return _out(X.quantile_normal(checkpointed(order_features(spark, sf)), FEATURES, BY))


_PRIO = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(
    "e9_one_hot",
    """with cats as (select o_orderpriority as c, row_number() over (order by o_orderpriority)-1 as i from (select distinct o_orderpriority from orders where o_orderstatus <> 'F'))
select o_orderkey as row_id, """
    + ", ".join(
        f"coalesce((o_orderpriority = (select c from cats where i={i}))::int::double, 0.0::double) as o_orderpriority_{i}" for i in range(5)
    )
    + " from orders",
)
def e9(spark, sf):
    rows = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    out = X.one_hot(rows, "o_orderpriority", F.col("o_orderstatus") != "F")
    return out.drop("o_orderstatus").withColumnRenamed("o_orderkey", "row_id")


@query(
    "e9_one_hot_sparse",
    """with cats as (select o_custkey, row_number() over (order by o_custkey)-1 as i from (select distinct o_custkey from orders where o_orderstatus <> 'F'))
select o_orderkey as row_id, (select count(*) from cats)::bigint as size, i::bigint as entry, case when i is null then 0.0::double else 1.0::double end as value from orders left join cats using (o_custkey)""",
)
def e9_sparse(spark, sf):
    """One category per customer: too many for columns."""
    rows = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("row_id"), "o_custkey", "o_orderstatus")
    index = X.category_index(rows, "o_custkey", F.col("o_orderstatus") != "F")
    hot = X.one_hot_sparse(rows, "o_custkey", index, "hot")
    return hot.select("row_id", "hot.size", F.get("hot.indices", F.lit(0)).alias("entry"), F.coalesce(F.get("hot.values", F.lit(0)), F.lit(0.0)).alias("value"))



@query(
    "e10_label_encode",
    f"with {OF_SQL}, c as (select label_str, row_number() over (order by label_str)-1 as y from (select distinct label_str from of_)) select row_id, y::int as y from of_ join c using (label_str)",
)
def e10(spark, sf):
    out, _ = X.label_encode(order_features(spark, sf), "label_str")
    return out.select("row_id", "y")


_NL = """select vec_id as row_id, case when vec_id % 7 = 0 then -100 else label end as label, label % 3 as grp from embeddings"""


@query(
    "e11_normalize_labels",
    f"""with e as ({_NL}), c as (select grp, label, row_number() over (partition by grp order by label)-1 as code, count(*) over (partition by grp) as k from (select distinct grp, label from e where label <> -100))
select row_id, (case when e.label = -100 then -100 else (code + 2) % k end)::int as y from e left join c on c.grp=e.grp and c.label=e.label""",
)
def e11(spark, sf):
    e = embedding_points(spark, sf).select(
        "row_id",
        F.when(F.col("row_id") % 7 == 0, F.lit(-100)).otherwise(F.col("label")).alias("label"),
        (F.col("label") % 3).alias("grp"),
    )
    return X.normalize_labels(e, "label", ["grp"], shift=2).select("row_id", F.col("y").cast("int").alias("y"))


@query(
    "e12_drop_constant_features",
    f"with {OF_SQL} select row_id, {_each('#', 3)} from of_",
)
def e12(spark, sf):
    rows = order_features(spark, sf).withColumn("flat", F.lit(3.0))
    out = X.drop_constant_features(rows, [*FEATURES, "flat"])
    return out.select("row_id", *[r6(c, c, _digits(c, 3)) for c in out.columns if c not in ("row_id", "dataset_id", "label_str")])


@query(
    "e13_rescale_used_features",
    f"with {Z_SQL} select row_id, {_each('#/(5::double/100::double)')}, {', '.join(R(f'{f}/sqrt(5::double/100::double)', 'sq_' + f) for f in FEATURES)} from so_",
)
def e13(spark, sf):
    z = scored_orders(spark, sf)
    a = X.rescale_used_features(z.withColumns({f"sq_{f}": F.col(f) for f in FEATURES}), FEATURES, 100)
    b = X.rescale_used_features(a, [f"sq_{f}" for f in FEATURES], 100, sqrt=True)
    return rounded(b.select("row_id", *FEATURES, *[f"sq_{f}" for f in FEATURES]))


_ARR = "[" + ", ".join(f"coalesce(f_{i},0.0::double)" for i in range(5)) + "]"


def _arr():
    return F.array(*[F.coalesce(F.col(f), F.lit(0.0)) for f in FEATURES])


def _round_array(c):
    return F.transform(c, lambda v: F.round(v, 6) + 0.0)


@query(
    "e14_pad_features",
    f"""with {Z_SQL}, a as (select row_id, {_ARR} as x from so_)
select row_id, list_transform(x, lambda v: round(v,6)+0.0::double) || [0.0::double,0.0::double,0.0::double] as padded,
 list_transform(x, lambda v: round(v*(8::double/5::double),6)+0.0::double) || [0.0::double,0.0::double,0.0::double] as padded_rescaled from a""",
)
def e14(spark, sf):
    return scored_orders(spark, sf).select(
        "row_id",
        _round_array(X.pad_features(_arr(), 8)).alias("padded"),
        _round_array(X.pad_features(_arr(), 8, rescale=True)).alias("padded_rescaled"),
    )


@query(
    "e15_rotate_features",
    f"""with {Z_SQL}, a as (select row_id, list_transform({_ARR}, lambda v: round(v,6)+0.0::double) as x from so_)
select row_id, x[3:5] || x[1:2] as rotated from a""",
)
def e15(spark, sf):
    return scored_orders(spark, sf).select("row_id", X.rotate_features(_round_array(_arr()), 2).alias("rotated"))


@query(
    "e16_bucketize",
    f"with {Z_SQL} select row_id, {', '.join(f'greatest(0, least(99, floor(({f} + 2.0::double)/0.04::double)))::int as {f}' for f in ['f_0', 'f_4'])} from so_",
)
def e16(spark, sf):
    return scored_orders(spark, sf).select("row_id", X.bucketize(F.col("f_0")).alias("f_0"), X.bucketize(F.col("f_4")).alias("f_4"))


def _four_sql():
    parts = []
    for i in (0, 2, 4):
        w = repr(2.0 * math.pi / 10.0 * math.sqrt(2.0) ** i)
        parts += [f"round(sin(f_0*{w}::double),6)+0.0::double", f"round(cos(f_0*{w}::double),6)+0.0::double"]
    return "[" + ", ".join(parts) + "]"


@query("e17_fourier_features", f"with {Z_SQL} select row_id, {_four_sql()} as waves from so_")
def e17(spark, sf):
    return scored_orders(spark, sf).select("row_id", _round_array(X.fourier_features(F.col("f_0"), 6)).alias("waves"))


@query(
    "e18_center",
    f"""with {OF_SQL}, st as (select dataset_id, {_stats('avg(#) as m_#')} from of_ group by dataset_id)
select row_id, {_each('#-m_#', 3)} from of_ join st using (dataset_id)""",
)
def e18(spark, sf):
    return _out(X.center(order_features(spark, sf), FEATURES, BY), 3)


@query(
    "e19_row_zscore",
    """with c as (select vec_id, unnest(embedding)::double as v, unnest(range(64)) as i from embeddings),
m as (select vec_id, avg(v) as m, stddev_samp(v) as s from c group by vec_id)
select vec_id as row_id, list(round((v-m)/s, 6)+0.0::double order by i) as z from c join m using (vec_id) group by vec_id""",
)
def e19(spark, sf):
    return embedding_points(spark, sf).select("row_id", _round_array(X.row_zscore(F.col("features"))).alias("z"))


_NP_STATS = ", ".join(f"avg({f}) as mu_{f}, greatest(stddev_samp({f}),0.000001::double) as s_{f}" for f in FEATURES)
_NP_OUT = ", ".join([R(f"({f}-mu_{f})/s_{f}", f) for f in FEATURES] + [R(f"d_{f}/s_{f}", f"d_{f}") for f in FEATURES])


@query(
    "e20_normalize_pairs",
    f"""with {Z_SQL}, {pairs_sql('uniform_random')}, np_ as (select dataset_id, {_NP_STATS} from p_ group by dataset_id)
select row_id, {_NP_OUT}, m_f_0 as mask_0 from p_ join np_ using (dataset_id)""",
)
def e20(spark, sf):
    out = X.normalize_pairs(pairs(spark, sf, "uniform_random"), FEATURES, BY)
    return rounded(out.select("row_id", *FEATURES, *[f"d_{f}" for f in FEATURES], F.col("m_f_0").alias("mask_0")))


@query(
    "e21_normalize_with_stats",
    f"""with {OF_SQL}, st as (select {_stats(f'avg(#) as m_#, greatest(stddev_samp(#),0.000001::double) as s_#')} from of_ where {_FIT})
select row_id, {_each('(#-m_#)/s_#')} from of_ cross join st""",
)
def e21(spark, sf):
    rows = order_features(spark, sf)
    shared = X.fit_pair_stats(rows.filter(_FIT), FEATURES, [])
    return _out(X.normalize_with_stats(rows, FEATURES, shared, []))


@query("e22_denormalize", f"with {OF_SQL} select row_id, {_each('#', 3)} from of_")
def e22(spark, sf):
    rows = order_features(spark, sf)
    stats = X.fit_pair_stats(rows, FEATURES, BY)
    return _out(X.denormalize(X.normalize_with_stats(rows, FEATURES, stats, BY), FEATURES, stats, BY), 3)


@query(
    "e23_integer_codes",
    f"with {OF_SQL} select " + ", ".join(f"coalesce(not max({f} <> floor({f})), true) as {f}" for f in FEATURES) + " from of_",
)
def e23(spark, sf):
    return X.integer_codes_report(order_features(spark, sf), FEATURES)
