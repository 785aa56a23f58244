"""Dataset statistics (J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from flipside.operators import profile as J
from flipside.plans.inputs import BY, FEATURES, Z_SQL, embedding_points, pairs, pairs_sql, scored_orders
from flipside.plans.registry import R, query, rounded

_LONG = "l_ as (" + " union all ".join(f"select dataset_id, {i} as feat, {f} as v, y from so_" for i, f in enumerate(FEATURES)) + ")"
_MOM = f"{R('avg(v)', 'mean')}, {R('stddev_samp(v)', 'std')}, {R('min(v)', 'min')}, {R('max(v)', 'max')}, {R('max(v)-min(v)', 'range')}"


def _z(spark, sf):
    return scored_orders(spark, sf)


@query("j1_feature_moments", f"with {Z_SQL}, {_LONG} select dataset_id, feat, {_MOM} from l_ group by dataset_id, feat")
def j1(spark, sf):
    return rounded(J.feature_moments(_z(spark, sf), FEATURES, BY))


def _shape_ctes(src: str, keys: str, v: str) -> str:
    return f"""sa_ as (select {keys}, avg({v}) as m, greatest(stddev_samp({v}),1e-8::double) as s from {src} where {v} is not null group by {keys}),
sh_ as (select {keys}, avg(pow(({v}-m)/s,3)) as skew, avg(pow(({v}-m)/s,4))-3.0::double as kurt from {src} join sa_ using ({keys}) where {v} is not null group by {keys})"""


@query(
    "j2_feature_shape",
    f"with {Z_SQL}, {_LONG}, {_shape_ctes('l_', 'dataset_id, feat', 'v')} select dataset_id, feat, {R('skew', 'skew')}, {R('kurt', 'kurt')} from sh_",
)
def j2(spark, sf):
    return rounded(J.feature_shape(_z(spark, sf), FEATURES, BY))


_IQR = "quantile_cont(v,0.25) as q25, quantile_cont(v,0.75) as q75, quantile_cont(v,0.75)-quantile_cont(v,0.25) as iqr"


@query(
    "j3_feature_iqr",
    f"with {Z_SQL}, {_LONG} select dataset_id, feat, {R('quantile_cont(v,0.25)', 'q25')}, {R('quantile_cont(v,0.75)', 'q75')}, {R('quantile_cont(v,0.75)-quantile_cont(v,0.25)', 'iqr')} from l_ group by dataset_id, feat",
)
def j3(spark, sf):
    return rounded(J.feature_iqr(_z(spark, sf), FEATURES, BY))


_ALL = ["mean", "std", "min", "max", "range", "skew", "kurt", "iqr"]


@query(
    "j4_feature_summary",
    f"""with {Z_SQL}, {_LONG}, {_shape_ctes('l_', 'dataset_id, feat', 'v')},
mo_ as (select dataset_id, feat, avg(v) as mean, stddev_samp(v) as std, min(v) as min, max(v) as max, max(v)-min(v) as range, {_IQR} from l_ group by dataset_id, feat)
select dataset_id, {', '.join(R(f'avg({c})', c + '_mean') + ', ' + R(f'stddev_samp({c})', c + '_std') for c in _ALL)} from mo_ join sh_ using (dataset_id, feat) group by dataset_id""",
)
def j4(spark, sf):
    return rounded(J.feature_summary(_z(spark, sf), FEATURES, BY))


_CORR = "cm_ as (" + " union all ".join(
    f"select dataset_id, {i} as i, {j} as j, " + ("1.0::double" if i == j else f"corr({a}, {b})") + " as r from so_ group by dataset_id"
    for i, a in enumerate(FEATURES)
    for j, b in enumerate(FEATURES)
) + ")"


@query("j5_corr_matrix", f"with {Z_SQL}, {_CORR} select dataset_id, i, j, {R('r', 'r')} from cm_")
def j5(spark, sf):
    return rounded(J.corr_matrix(_z(spark, sf), FEATURES, BY))


@query(
    "j5_corr_matrix_vectors",
    """with c as (select vec_id, unnest(range(64)) as i, unnest(embedding)::double as v from embeddings)
select a.i::int as i, b.i::int as j, round(corr(a.v, b.v),6)+0.0::double as r from c a join c b using (vec_id) group by a.i, b.i""",
)
def j5v(spark, sf):
    return rounded(J.corr_matrix_vectors(embedding_points(spark, sf), "features"))


@query(
    "j6_corr_summary",
    f"with {Z_SQL}, {_CORR} select dataset_id, {R('avg(abs(r))', 'mean_abs')}, {R('quantile_disc(abs(r),0.5)', 'median_abs')}, {R('max(abs(r))', 'max_abs')} from cm_ where i<>j group by dataset_id",
)
def j6(spark, sf):
    return rounded(J.corr_summary(J.corr_matrix(_z(spark, sf), FEATURES, BY), BY))


_TC = "tc_ as (select dataset_id, feat, corr(v, y) as r from l_ group by dataset_id, feat)"


@query("j7_target_corr", f"with {Z_SQL}, {_LONG}, {_TC} select dataset_id, feat, {R('r', 'r')} from tc_")
def j7(spark, sf):
    return rounded(J.target_corr(_z(spark, sf), FEATURES, "y", BY))


@query(
    "j7_target_corr_summary",
    f"with {Z_SQL}, {_LONG}, {_TC} select dataset_id, {R('avg(abs(r))', 'mean_abs')}, {R('stddev_samp(abs(r))', 'std_abs')}, {R('max(abs(r))', 'max_abs')} from tc_ group by dataset_id",
)
def j7s(spark, sf):
    return rounded(J.target_corr_summary(J.target_corr(_z(spark, sf), FEATURES, "y", BY), BY))


_CB = "cb_ as (select dataset_id, label_str, count(*) as n from so_ group by dataset_id, label_str), cs_ as (select *, n::double/sum(n) over (partition by dataset_id) as p from cb_)"


@query(
    "j8_class_balance",
    f"with {Z_SQL}, {_CB} select dataset_id, count(*) as n_classes, {R('min(p)', 'min_ratio')}, {R('max(p)', 'max_ratio')}, {R('-sum(greatest(p,1e-10::double)*log2(greatest(p,1e-10::double)))', 'entropy')} from cs_ group by dataset_id",
)
def j8(spark, sf):
    return rounded(J.class_balance(_z(spark, sf), "label_str", BY))


@query("j8_class_ratios", f"with {Z_SQL}, {_CB} select dataset_id, label_str, n, {R('p', 'ratio')} from cs_")
def j8r(spark, sf):
    return rounded(J.class_ratios(_z(spark, sf), "label_str", BY))


@query(
    "j9_target_stats",
    f"""with {Z_SQL}, {_shape_ctes('so_', 'dataset_id', 'y')} select dataset_id, {R('avg(y)', 'mean')}, {R('stddev_samp(y)', 'std')}, {R('min(y)', 'min')}, {R('max(y)', 'max')}, {R('any_value(skew)', 'skew')}, {R('any_value(kurt)', 'kurt')}
from so_ join sh_ using (dataset_id) group by dataset_id""",
)
def j9(spark, sf):
    return rounded(J.target_stats(_z(spark, sf), "y", BY))


@query("j10_dataset_shape", f"with {Z_SQL} select count(*) as n_rows, 5 as n_features, count(distinct dataset_id) as n_datasets from so_")
def j10(spark, sf):
    return J.dataset_shape(_z(spark, sf), FEATURES, "dataset_id")


_HIST = "hb_ as (select dataset_id, " + ", ".join(f"min(d_{f}) as hlo_{f}, max(d_{f}) as hhi_{f}" for f in FEATURES) + " from p_ group by dataset_id), hc_ as (" + " union all ".join(
    f"select dataset_id, {i} as feat, case when hhi_{f}=hlo_{f} then 0 else least(floor((d_{f}-hlo_{f})/((hhi_{f}-hlo_{f})/30.0::double)+1e-9::double),29)::int end as bin from p_ join hb_ using (dataset_id)"
    for i, f in enumerate(FEATURES)
) + ")"


@query(
    "j11_delta_histogram",
    f"with {Z_SQL}, {pairs_sql('uniform_random')}, {_HIST} select dataset_id, feat, bin, count(*) as n from hc_ group by dataset_id, feat, bin",
)
def j11(spark, sf):
    return J.delta_histogram(pairs(spark, sf, "uniform_random"), [f"d_{f}" for f in FEATURES], BY)
