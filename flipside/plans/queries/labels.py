"""Label construction (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from flipside.operators import labels as L
from flipside.plans.inputs import BY, FEATURES, OF_SQL, SEED, U, UT, Z_SQL, pairs, pairs_sql, s, scored_orders, order_features
from flipside.plans.queries.missing import _bounds_sql
from flipside.plans.registry import R, query, r6, rounded

_SD = str(SEED)


@query(
    "f1_binarize_balanced",
    f"""with {Z_SQL}, {pairs_sql('uniform_random')}, m as (select quantile_disc(y_f,0.5) as a, quantile_disc(y_cf,0.5) as b from p_),
d as (select dataset_id, quantile_disc(y_f,0.5) as c from p_ group by dataset_id)
select row_id, (y_f > a)::int as y_f_cls, (y_cf > b)::int as y_cf_cls, (y_f > c)::int as y_f_ds from p_ cross join m join d using (dataset_id)""",
)
def f1(spark, sf):
    made = pairs(spark, sf, "uniform_random").select("row_id", "dataset_id", "y_f", "y_cf")
    both = L.binarize_balanced(made, ["y_f", "y_cf"], suffix="_cls")
    return L.binarize_balanced(both, ["y_f"], BY, suffix="_ds").select("row_id", "y_f_cls", "y_cf_cls", "y_f_ds")


@query("f2_binarize_threshold", f"with {Z_SQL} select row_id, (y > 0.25::double)::int as c from so_")
def f2(spark, sf):
    return scored_orders(spark, sf).select("row_id", L.binarize_threshold("y", 0.25).alias("c"))


@query("f3_calibrate_threshold", f"with {Z_SQL} select dataset_id, {R('threshold', 'threshold')} from th_")
def f3(spark, sf):
    return rounded(L.calibrate_threshold(scored_orders(spark, sf), "y", BY))


@query(
    "f4_multiclass_by_rank",
    f"with {OF_SQL}, {_bounds_sql(['f_0'], 5, 'of_')} select row_id, len(list_filter(b_f_0, lambda v: f_0 > v))::int as y_class from of_ join bd_f_0 using (dataset_id)",
)
def f4(spark, sf):
    return L.multiclass_by_rank(order_features(spark, sf), "f_0", BY, "row_id", 5, SEED).select("row_id", "y_class")


_B = [-1.2, -0.3, 0.4, 1.1]


@query(
    "f5_multiclass_by_value",
    f"with {Z_SQL} select row_id, ({' + '.join(f'(y > {b}::double)::int' for b in _B)})::int as y_class from so_",
)
def f5(spark, sf):
    return scored_orders(spark, sf).select("row_id", L.multiclass_by_value("y", _B).alias("y_class"))


@query(
    "f6_multiclass_sample",
    f"""with {Z_SQL}, w as (select row_id, {', '.join(f'pow(0.00001::double + 1.0::double/(1.0::double+exp(-coalesce({f},0.00001::double))), 3.0::double) as w{i}' for i, f in enumerate(FEATURES[:3]))} from so_),
u as (select *, {U(_SD, 'row_id', s('cls'))}*(w0+w1+w2) as u from w)
select row_id, case when u < w0 then 0 when u < w0+w1 then 1 else 2 end as y_class from u""",
)
def f6(spark, sf):
    z = scored_orders(spark, sf)
    return z.select("row_id", L.multiclass_sample([F.col(f) for f in FEATURES[:3]], SEED, F.col("row_id"), "cls").alias("y_class"))


@query(
    "f7_permute_classes",
    f"""with {Z_SQL}, c as (select row_id, dataset_id, ({' + '.join(f'(y > {b}::double)::int' for b in _B)})::int as c from so_),
pm as (select dataset_id, k, row_number() over (partition by dataset_id order by {UT(_SD, 'dataset_id', s('perm'), 'k')}, k)-1 as place from (select distinct dataset_id from c) cross join (select unnest(range(5)) as k)),
q as (select row_id, c.dataset_id, case when {UT(_SD, 'c.dataset_id', s('shuffle'))} > 0.3::double then k else c end as d from c join pm on pm.dataset_id=c.dataset_id and pm.place=c.c)
select row_id, (case when {UT(_SD, 'dataset_id', s('reverse'))} > 0.5 then 4-d else d end)::int as y_class from q""",
)
def f7(spark, sf):
    z = scored_orders(spark, sf)
    code = L.multiclass_by_value("y", _B)
    return L.permute_classes(z, code, 5, 0.3, BY, SEED).select("row_id", "y_class")


_SS = "ss_ as (select row_id, dataset_id, " + ", ".join(f"{f}/(1.0::double+abs({f})) as {f}" for f in FEATURES) + " from so_)"


@query(
    "f8_discretize_features",
    f"with {Z_SQL}, {_SS}, {_bounds_sql(FEATURES, 6, 'ss_')} select row_id, "
    + ", ".join(
        R(f"case when {UT(_SD, 'dataset_id', s(f), s('choose'))} < 0.5::double then len(list_filter(b_{f}, lambda v: {f} > v)) - 3.0::double else {f} end", f)
        for f in FEATURES
    )
    + " from ss_ " + " ".join(f"join bd_{f} using (dataset_id)" for f in FEATURES),
)
def f8(spark, sf):
    out = L.discretize_features(scored_orders(spark, sf), FEATURES, BY, "row_id", 0.5, 6, SEED)
    return rounded(out.select("row_id", *FEATURES))


@query(
    "f9_class_range",
    f"""select c_custkey as row_id, (case when {U(_SD, 'c_custkey', s('two'))} > 0.5 then floor(2.0::double + 8.0::double*{U(_SD, 'c_custkey', s('k'))} + 0.5::double) else 2 end)::int as k from customer""",
)
def f9(spark, sf):
    rows = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("row_id"))
    return rows.select("row_id", L.class_range(2, 10, SEED, F.col("row_id")).alias("k"))
