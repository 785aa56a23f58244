"""Classification and regression metrics (L)."""

from __future__ import annotations

from pyspark.sql import functions as F

from flipside.operators import metrics as L
from flipside.plans.inputs import BY, CLASS_SQL, PRED_SQL, Z_SQL, class_predictions, predictions, pairs, pairs_sql, table
from flipside.plans.registry import R, query, rounded

_K = ["method", "split", "dataset_id"]
_KS = "method, split, dataset_id"


def _auc_ctes(src: str, keys: str, y: str, score: str, tag: str = "") -> str:
    return f"""ar{tag}_ as (select {keys}, {y} as y, rank() over (partition by {keys} order by {score}) + (count(*) over (partition by {keys}, {score}) - 1)/2.0::double as r from {src}),
au{tag}_ as (select {keys}, (sum(case when y=1 then r end) - sum(y)*(sum(y)+1)/2.0::double)/nullif(sum(y)*sum(1-y),0)::double as auc from ar{tag}_ group by {keys})"""


@query("l1_auc", f"with {PRED_SQL}, {_auc_ctes('pred_', _KS, 'y', 'p1')} select {_KS}, {R('auc', 'auc')} from au_")
def l1(spark, sf):
    return rounded(L.auc(predictions(spark, sf), _K))


@query(
    "l1_auc_ties",
    """with d as (select lang as dataset_id, n_chars::double as s, toxic as y from documents join labels using (doc_id)),
r as (select dataset_id, y, rank() over (partition by dataset_id order by s) + (count(*) over (partition by dataset_id, s)-1)/2.0::double as r from d)
select dataset_id, round((sum(case when y=1 then r end) - sum(y)*(sum(y)+1)/2.0::double)/nullif(sum(y)*sum(1-y),0)::double, 6)+0.0::double as auc from r group by dataset_id""",
)
def l1t(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    d = d.select(F.col("lang").alias("dataset_id"), F.col("n_chars").cast("double").alias("s"), F.col("toxic").alias("y"))
    return rounded(L.auc(d, BY, F.col("y") == 1, F.col("s")))


_OVO = f"""{CLASS_SQL}, ij_ as (select a.method, a.dataset_id, a.row_id, a.k as i, b.k as j, (a.y=a.k)::int as y, a.p as s from cp1_ a join (select unnest(range(10)) as k) b on a.k <> b.k where a.y = a.k or a.y = b.k)"""


@query(
    "l2_auc_ovo",
    f"with {_OVO}, {_auc_ctes('ij_', 'method, dataset_id, i, j', 'y', 's')} select method, dataset_id, {R('avg(auc)', 'auc_ovo')} from au_ group by method, dataset_id",
)
def l2(spark, sf):
    return rounded(L.auc_ovo(class_predictions(spark, sf), ["method", "dataset_id"]))


@query("l3_accuracy", f"with {PRED_SQL} select {_KS}, {R('avg(((p1>0.5)::int=y)::int)', 'accuracy')} from pred_ group by {_KS}")
def l3(spark, sf):
    return rounded(predictions(spark, sf).groupBy(*_K).agg(L.accuracy().alias("accuracy")))


_AM = "am_ as (select method, dataset_id, row_id, any_value(y) as y, min_by(k, struct_pack(a := -p, b := k)) as c, max(p) as conf from cp1_ group by method, dataset_id, row_id)"


@query("l3_accuracy_multiclass", f"with {CLASS_SQL}, {_AM} select method, {R('avg((c=y)::int)', 'accuracy')} from am_ group by method")
def l3m(spark, sf):
    return rounded(class_predictions(spark, sf).groupBy("method").agg(L.accuracy().alias("accuracy")))


@query(
    "l4_balanced_accuracy",
    f"with {CLASS_SQL}, {_AM}, r as (select method, y, avg((c=y)::int) as r from am_ group by method, y) select method, {R('avg(r)', 'balanced_accuracy')} from r group by method",
)
def l4(spark, sf):
    return rounded(L.balanced_accuracy(class_predictions(spark, sf), ["method"]))


def _ap_sql(score: str) -> str:
    return f"""with {PRED_SQL}, a as (select {_KS}, {score} as s, sum(y) as p, sum(1-y) as n from pred_ group by {_KS}, {score}),
b as (select *, sum(p) over w as cp, sum(n) over w as cn, sum(p) over (partition by {_KS}) as ap from a window w as (partition by {_KS} order by s desc))
select {_KS}, {R('sum(p*cp::double/(cp+cn))/nullif(any_value(ap),0)', 'average_precision')} from b group by {_KS}"""


@query("l5_average_precision", _ap_sql("(p1>0.5)::int"))
def l5(spark, sf):
    return rounded(L.average_precision(predictions(spark, sf), _K))


@query("l5_average_precision_scores", _ap_sql("p1"))
def l5s(spark, sf):
    return rounded(L.average_precision(predictions(spark, sf), _K, hard=False))


@query("l6_brier", f"with {CLASS_SQL}, b as (select method, row_id, sum((p-(k=y)::int)*(p-(k=y)::int)) as b from cp1_ group by method, row_id) select method, {R('avg(b)', 'brier')} from b group by method")
def l6(spark, sf):
    return rounded(class_predictions(spark, sf).groupBy("method").agg(L.brier().alias("brier")))


@query(
    "l7_ece",
    f"""with {CLASS_SQL}, {_AM}, b as (select method, floor(conf*15.0::double) as bin, sum(conf) as c, sum((c=y)::int) as r, count(*) as n from am_ group by method, floor(conf*15.0::double))
select method, {R('sum(abs(r-c))/sum(n)', 'ece')} from b group by method""",
)
def l7(spark, sf):
    return rounded(L.ece(class_predictions(spark, sf), ["method"]))


@query(
    "l8_cross_entropy",
    f"with {PRED_SQL} select {_KS}, {R('avg(case when y=1 then -ln(p1) else -ln(1.0::double-p1) end)', 'cross_entropy')} from pred_ group by {_KS}",
)
def l8(spark, sf):
    return rounded(predictions(spark, sf).groupBy(*_K).agg(L.cross_entropy().alias("cross_entropy")))


@query(
    "l8_cross_entropy_multiclass",
    f"""with {CLASS_SQL}, a as (select method, row_id, max(case when k=y then p end) as own, ln(sum(exp(p))) as lse from cp1_ group by method, row_id)
select method, {R('avg(case when own>0 then -greatest(ln(case when own>0 then own else 1 end),-100) else 100 end)', 'ce')}, {R('avg(lse-own)', 'ce_logits')} from a group by method""",
)
def l8m(spark, sf):
    return rounded(
        class_predictions(spark, sf).groupBy("method").agg(L.cross_entropy().alias("ce"), L.cross_entropy(True).alias("ce_logits"))
    )


@query(
    "l9_l10_regression",
    f"""with {Z_SQL}, {pairs_sql('additive_noise')} select dataset_id, {R('sqrt(avg((y_cf-y_f)*(y_cf-y_f)))', 'rmse')}, {R('avg((y_cf-y_f)*(y_cf-y_f))', 'mse')}, {R('avg(abs(y_cf-y_f))', 'mae')},
 {R('-(1-sum((y_cf-y_f)*(y_cf-y_f))/(var_pop(y_cf)*count(*)))', 'neg_r2')}, {R('-(1-sum((y_cf-y_f)*(y_cf-y_f))/(var_pop(y_f)*count(*)))', 'neg_r2_standard')} from p_ group by dataset_id""",
)
def l9(spark, sf):
    made = pairs(spark, sf, "additive_noise")
    return rounded(
        made.groupBy("dataset_id").agg(
            L.rmse("y_cf", "y_f").alias("rmse"),
            L.mse("y_cf", "y_f").alias("mse"),
            L.mae("y_cf", "y_f").alias("mae"),
            L.neg_r2("y_cf", "y_f").alias("neg_r2"),
            L.neg_r2("y_cf", "y_f", standard=True).alias("neg_r2_standard"),
        )
    )


@query(
    "l11_time_count",
    f"with {PRED_SQL}, a as (select {_KS}, max(time_s) as t from pred_ group by {_KS}) select method, {R('sum(t)', 'time_sum')}, {R('avg(t)', 'time_mean')}, count(*) as n from a group by method",
)
def l11(spark, sf):
    scores = L.score_table(predictions(spark, sf), ["time", "count"])
    t = F.when(F.col("metric") == "time", F.col("value"))
    return rounded(
        scores.groupBy("method").agg(
            F.sum(t).alias("time_sum"),
            F.avg(t).alias("time_mean"),
            F.sum(F.when(F.col("metric") == "count", F.col("value"))).cast("long").alias("n"),
        )
    )


@query(
    "score_table",
    f"""with {PRED_SQL}, {_auc_ctes('pred_', _KS, 'y', 'p1')}, ag_ as (select {_KS}, avg(((p1>0.5)::int=y)::int) as accuracy, avg(case when y=1 then -ln(p1) else -ln(1.0::double-p1) end) as cross_entropy, max(time_s) as time from pred_ group by {_KS}),
u_ as (select {_KS}, 'auc' as metric, auc as value from au_ union all select {_KS}, 'accuracy', accuracy from ag_ union all select {_KS}, 'cross_entropy', cross_entropy from ag_ union all select {_KS}, 'time', time from ag_)
select {_KS}, 60 as max_time, 1000 as eval_pos, metric, {R('value', 'value')} from u_""",
)
def scores(spark, sf):
    return rounded(L.score_table(predictions(spark, sf), ["auc", "accuracy", "cross_entropy", "time"]))
