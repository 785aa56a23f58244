"""Score composition, leaderboards and run analytics (M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from flipside.operators import leaderboard as M
from flipside.operators import metrics as L
from flipside.plans.inputs import PRED_SQL, U, predictions, s, table
from flipside.plans.queries.metrics import _KS, _auc_ctes
from flipside.plans.queries.sources import _DAILY
from flipside.plans.registry import R, query, rounded
from flipside.session import checkpointed

METHODS = ["m0", "m1", "m2", "m3", "m4"]

# m0 has no result for one dataset, as if it had failed there.
SC_SQL = f"""{PRED_SQL}, {_auc_ctes('pred_', _KS, 'y', 'p1')}, ag_ as (select {_KS}, avg(((p1>0.5)::int=y)::int) as accuracy, avg(case when y=1 then -ln(p1) else -ln(1.0::double-p1) end) as cross_entropy, max(time_s) as time from pred_ group by {_KS}),
u_ as (select {_KS}, 'auc' as metric, auc as value from au_ union all select {_KS}, 'accuracy', accuracy from ag_ union all select {_KS}, 'cross_entropy', cross_entropy from ag_ union all select {_KS}, 'time', time from ag_),
sc_ as (select method, 60 as max_time, split, dataset_id, 1000 as eval_pos, metric, case when method='m0' and dataset_id='FURNITURE' and metric <> 'time' then null else value end as value from u_)"""


def score_rows(spark, sf, metrics=("auc", "accuracy", "cross_entropy", "time")):
    raw = L.score_table(predictions(spark, sf), metrics)
    failed = (F.col("method") == "m0") & (F.col("dataset_id") == "FURNITURE") & (F.col("metric") != "time")
    return raw.withColumn("value", F.when(~failed, F.col("value")))


_METRIC = "auc"


def _auc_rows(spark, sf):
    return score_rows(spark, sf, [_METRIC])


@query(
    "m1_compose_scores",
    f"""with {SC_SQL}, a as (select method, metric, dataset_id, eval_pos, avg(value) as v from sc_ group by all),
b as (select method, metric, eval_pos, avg(v) as v from a group by all), c as (select method, metric, dataset_id, avg(v) as v from a group by all), d as (select method, metric, avg(v) as v from b group by all)
select method, metric, 'dataset_pos' as level, dataset_id, eval_pos, {R('v', 'value')} from a union all select method, metric, 'pos', null, eval_pos, {R('v', 'value')} from b
union all select method, metric, 'dataset', dataset_id, null, {R('v', 'value')} from c union all select method, metric, 'overall', null, null, {R('v', 'value')} from d""",
)
def m1(spark, sf):
    return rounded(M.compose_scores(score_rows(spark, sf)))


def _matrix_sql(agg):
    return f"with {SC_SQL} select dataset_id, " + ", ".join(R(f"{agg}(value) filter (where method='{m}')", m) for m in METHODS) + " from sc_ where metric='auc' group by dataset_id"


@query("m2_metric_matrix", _matrix_sql("avg"))
def m2(spark, sf):
    return rounded(M.metric_matrix(_auc_rows(spark, sf), METHODS))


@query("m2_metric_matrix_std", _matrix_sql("stddev_samp"))
def m2s(spark, sf):
    return rounded(M.metric_matrix(_auc_rows(spark, sf), METHODS, "std"))


@query(
    "m2_split_matrix",
    f"with {SC_SQL} select dataset_id, split, " + ", ".join(R(f"avg(value) filter (where method='{m}')", m) for m in METHODS) + " from sc_ where metric='auc' group by dataset_id, split",
)
def m2p(spark, sf):
    return rounded(M.split_matrix(_auc_rows(spark, sf), METHODS))


_OVER = "tm_ as (select method, avg(value) as t from sc_ where metric='time' group by method), ov_ as (select sc_.*exclude(value), case when t > 40 then null else value end as value from sc_ join tm_ using (method))"


@query("m3_mask_over_budget", f"with {SC_SQL}, {_OVER} select method, split, dataset_id, metric, {R('value', 'value')} from ov_ where metric <> 'time'")
def m3(spark, sf):
    rows = score_rows(spark, sf)
    out = M.mask_over_budget(rows.filter("metric <> 'time'"), rows.filter("metric = 'time'"), 20)
    return rounded(out.select("method", "split", "dataset_id", "metric", "value"))


@query(
    "m4_fill_failures",
    f"with {SC_SQL} select method, split, dataset_id, metric, {R('''case when metric='cross_entropy' then -coalesce(value,-100.0::double) else coalesce(value,-1.0::double) end''', 'value')}, {R('''case when metric='cross_entropy' then -coalesce(value,100.0::double) else coalesce(value,-1.0::double) end''', 'worst')} from sc_ where metric <> 'time'",
)
def m4(spark, sf):
    rows = score_rows(spark, sf, ["auc", "accuracy", "cross_entropy"])
    both = rows.withColumn("raw", F.col("value"))
    filled = M.fill_failures(both).withColumnRenamed("value", "as_coded").withColumnRenamed("raw", "value")
    return rounded(M.fill_failures(filled, worst=True).select("method", "split", "dataset_id", "metric", F.col("as_coded").alias("value"), F.col("value").alias("worst")))


# Scores that are close to each other after rounding make ties on purpose.
_MEAN = "mm_ as (select method, dataset_id, avg(value) as value from sc_ where metric='{0}' group by method, dataset_id)"
_RANK = "rk_ as (select *, case when value is not null then rank() over (partition by dataset_id order by {0} desc nulls last) + (count(*) over (partition by dataset_id, {0})-1)/2.0::double end as rank from mm_)"


def _means(spark, sf, metric="auc", digits=None):
    rows = score_rows(spark, sf, [metric])
    return rows.groupBy("method", "dataset_id").agg(F.avg("value").alias("value"))


@query("m5_ranks_and_wins", f"with {SC_SQL}, {_MEAN.format('auc')}, {_RANK.format('round(value,2)')} select method, {R('avg(rank)', 'mean_rank')}, sum((rank=1.0)::int)::bigint as wins from rk_ group by method")
def m5(spark, sf):
    rows = _means(spark, sf).withColumn("value", F.round("value", 2))
    return rounded(M.ranks_and_wins(rows))


@query(
    "m6_win_tie_loss",
    f"""with {SC_SQL}, {_MEAN.format('auc')}, r as (select dataset_id, round(value,2) as ref from mm_ where method='m2')
select method, sum(case when method='m2' then 0 else coalesce((round(value,2)>ref)::int,0) end)::bigint as wins, sum(case when method='m2' then 0 else coalesce((round(value,2)=ref)::int,0) end)::bigint as ties, sum(case when method='m2' then 0 else coalesce((round(value,2)<ref)::int,0) end)::bigint as losses from mm_ join r using (dataset_id) group by method""",
)
def m6(spark, sf):
    return M.win_tie_loss(_means(spark, sf).withColumn("value", F.round("value", 2)), "m2")


@query(
    "m7_label_integrity",
    f"""with {PRED_SQL}, x as (select split, dataset_id, eval_pos, row_id, case when method='m4' and {U('row_id', s('wrong'))} < 0.001::double then 1-y else y end as y from pred_),
r as (select split, dataset_id, eval_pos, row_id, min(y) as lo, max(y) as hi from x group by all) select dataset_id, sum((lo<>hi)::int)::bigint as n_conflicts, count(*) as n_rows from r group by dataset_id""",
)
def m7(spark, sf):
    from flipside.functions.keyed import uniform01

    wrong = (F.col("method") == "m4") & (uniform01(F.col("row_id"), "wrong") < 0.001)
    rows = predictions(spark, sf).withColumn("y", F.when(wrong, 1 - F.col("y")).otherwise(F.col("y")))
    return M.label_integrity(rows)


_BUD = """bs_ as (select method, b as max_time, split, dataset_id, value - (60-b)/1000.0::double as value from sc_ cross join (values (15),(60)) t(b) where metric='auc'),
bt_ as (select method, b as max_time, avg(least(value, b::double)) as real_time from sc_ cross join (values (15),(60)) t(b) where metric='time' group by method, b),
bm_ as (select max_time, split, method, avg(value) as score, count(value) as n_datasets from bs_ group by all),
br_ as (select *, case when value is not null then rank() over (partition by max_time, split, dataset_id order by round(value,3) desc nulls last) + (count(*) over (partition by max_time, split, dataset_id, round(value,3))-1)/2.0::double end as rank from bs_),
bw_ as (select max_time, split, method, avg(rank) as mean_rank, sum((rank=1.0)::int)::bigint as wins from br_ group by all),
bo_ as (select * from bm_ join bw_ using (max_time, split, method) join bt_ using (max_time, method) where not (method='m4' and max_time < 30)),
bc_ as (select * from bo_ union all by name select * replace (3600 as max_time, 3600.0::double as real_time) from bo_ where method='m0' and max_time=60)"""


@query(
    "m8_budget_curve",
    f"with {SC_SQL}, {_BUD} select method, max_time, split, {R('score', 'score')}, n_datasets, {R('mean_rank', 'mean_rank')}, wins, {R('real_time', 'real_time')}, n_datasets <= 29 as few_datasets from bc_",
)
def m8(spark, sf):
    rows = checkpointed(score_rows(spark, sf, ["auc", "time"]))
    budgets = F.explode(F.array(F.lit(15), F.lit(60)))
    auc = rows.filter("metric = 'auc'").withColumn("max_time", budgets)
    auc = auc.withColumn("value", F.col("value") - (60 - F.col("max_time")) / F.lit(1000.0))
    times = rows.filter("metric = 'time'").withColumn("max_time", budgets)
    times = times.withColumn("value", F.least("value", F.col("max_time").cast("double")))
    return rounded(M.budget_curve(auc, times, carry={"m0": 3600}, minimum={"m4": 30}))


def _board_sql():
    ctes, joins, cols = [], [], ["method"]
    for metric in ("auc", "accuracy", "cross_entropy"):
        sg = "-" if metric == "cross_entropy" else ""
        t = metric
        ctes += [
            f"p_{t} as (select method, dataset_id, avg(value) as m, stddev_samp(value) as s from sc_ where metric='{metric}' group by method, dataset_id)",
            f"v_{t} as (select method, dataset_id, m, s, {sg}m as value from p_{t})",
            f"k_{t} as (select *, case when value is not null then rank() over (partition by dataset_id order by round(value,3) desc nulls last) + (count(*) over (partition by dataset_id, round(value,3))-1)/2.0::double end as rank from v_{t})",
            f"w_{t} as (select a.method, concat_ws('/', sum(case when a.method='m2' then 0 else coalesce((a.value>b.value)::int,0) end)::bigint, sum(case when a.method='m2' then 0 else coalesce((a.value=b.value)::int,0) end)::bigint, sum(case when a.method='m2' then 0 else coalesce((a.value<b.value)::int,0) end)::bigint) as {t}_wtl from v_{t} a join v_{t} b on a.dataset_id=b.dataset_id and b.method='m2' group by a.method)",
            f"g_{t} as (select method, {R('avg(m)', t + '_mean')}, {R('avg(s)', t + '_std')}, {R('avg(rank)', t + '_rank')}, sum((rank=1.0)::int)::bigint as {t}_wins from k_{t} group by method)",
        ]
        joins += [f"g_{t}", f"w_{t}"]
    return f"with {SC_SQL}, {', '.join(ctes)}, tm_ as (select method, {R('avg(value)', 'time_mean')} from sc_ where metric='time' group by method) select * from tm_ " + " ".join(f"join {j} using (method)" for j in joins)


@query("m9_leaderboard", _board_sql())
def m9(spark, sf):
    return rounded(M.leaderboard(score_rows(spark, sf), "m2"))


_REP = "rp_ as (select method, avg(value) filter (where metric='auc') as auc, avg(value) filter (where metric='cross_entropy') as cross_entropy, avg(value) filter (where metric='time') as time from sc_ group by method)"


@query("m10_best_by", f"with {SC_SQL}, {_REP} select arg_max(method, auc) as auc, arg_min(method, cross_entropy) as cross_entropy, arg_min(method, time) as time from rp_")
def m10(spark, sf):
    rep = score_rows(spark, sf).groupBy("method").pivot("metric", ["auc", "cross_entropy", "time"]).agg(F.avg("value"))
    return M.best_by(rep, "method", {"auc": True, "cross_entropy": False, "time": False})


@query(
    "m11_highlight_extremes",
    f"with {SC_SQL}, {_MEAN.format('auc')} select method, dataset_id, {R('value', 'value')}, coalesce(round(value,3) = max(round(value,3)) over (partition by dataset_id), false) as best from mm_",
)
def m11(spark, sf):
    return rounded(M.highlight_extremes(_means(spark, sf), ["dataset_id"]))


# Run logs: every event type is a run, its days are the epochs.
def run_log(spark, sf):
    return (
        table(spark, sf, "events")
        .groupBy(F.col("event_type").alias("run"), F.dayofmonth("ts").alias("epoch"))
        .agg(F.round(F.avg("value"), 4).alias("loss"))
    )


_LOG = f"{_DAILY}, lg_ as (select event_type as run, epoch, loss from dl_)"
_SUMM = "su_ as (select run, arg_min(loss, epoch) as initial_loss, arg_max(loss, epoch) as final_loss, min(loss) as best_loss, min(epoch) filter (where loss = lo)::int as best_epoch from (select *, min(loss) over (partition by run) as lo from lg_) group by run)"


@query("m12_training_summary", f"with {_LOG}, {_SUMM} select *, {R('case when initial_loss > 0 then 1-best_loss/initial_loss end', 'reduction')} from su_")
def m12(spark, sf):
    return rounded(M.training_summary(run_log(spark, sf)))


_CRIT = "cr_ as (select run, best_loss <= 9.0 as a, coalesce(1-best_loss/initial_loss,0) >= 0.2 as b from su_)"


@query(
    "m13_criteria_check",
    f"with {_LOG}, {_SUMM}, {_CRIT} select run, a and b as all_passed, (a::int+b::int)::bigint as n_passed, 2::bigint as n_criteria from cr_",
)
def m13(spark, sf):
    summ = M.training_summary(run_log(spark, sf))
    metrics = summ.select("run", F.explode(F.create_map(F.lit("best_loss"), F.col("best_loss"), F.lit("reduction"), F.col("reduction"))).alias("metric", "value"))
    thresholds = spark.createDataFrame([("best_loss", 9.0, True), ("reduction", 0.2, False)], "metric string, threshold double, at_most boolean")
    return M.criteria_check(metrics, thresholds)


_VAR = "va_ as (select lang as run, case source when (select min(source) from documents) then 'correct' when (select max(source) from documents) then 'wrong' else 'none' end as variant, avg(quality) as value from documents join labels using (doc_id) group by 1, 2)"


@query(
    "m14_ablation_gap",
    f"with {_VAR}, w as (select run, max(value) filter (where variant='correct') as correct, max(value) filter (where variant='wrong') as wrong, max(value) filter (where variant='none') as none from va_ group by run) select run, {R('correct', 'correct')}, {R('wrong', 'wrong')}, {R('none', 'none')}, {R('correct-wrong', 'gap')} from w",
)
def m14(spark, sf):
    d = table(spark, sf, "documents")
    ends = d.agg(F.min("source").alias("a"), F.max("source").alias("z")).first()
    v = F.when(F.col("source") == ends["a"], "correct").when(F.col("source") == ends["z"], "wrong").otherwise("none")
    rows = d.join(table(spark, sf, "labels"), "doc_id").groupBy(F.col("lang").alias("run"), v.alias("variant")).agg(F.avg("quality").alias("value"))
    return rounded(M.ablation_gap(rows))


@query(
    "m15_relative_change",
    f"""with {_LOG}, {_SUMM}, e as (select min(run) as a, max(run) as b from su_), l as (select run, unnest(['initial_loss','final_loss','best_loss']) as metric, unnest([initial_loss, final_loss, best_loss]) as value from su_),
j as (select x.metric, x.value as a, y.value as b from l x join l y using (metric) join e on x.run = e.a and y.run = e.b) select metric, a, b, {R('case when a=0 then 0.0::double else (b-a)/abs(a)*100 end', 'change_pct')} from j""",
)
def m15(spark, sf):
    summ = M.training_summary(run_log(spark, sf))
    names = ["initial_loss", "final_loss", "best_loss"]
    rows = summ.select("run", F.explode(F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))])).alias("metric", "value"))
    ends = summ.agg(F.min("run").alias("a"), F.max("run").alias("b")).first()
    return rounded(M.relative_change(rows, ends["a"], ends["b"]))


@query("m16_inverse_capped", "select event_id, round(1.0::double/greatest(value, 0.01::double), 6)+0.0::double as inv from events")
def m16(spark, sf):
    return rounded(table(spark, sf, "events").select("event_id", M.inverse_capped("value").alias("inv")))


@query(
    "m17_positional_loss",
    """with e as (select dayofmonth(ts) as epoch, (user_id % 8)::int as pos, case when value > 50 then null else value end as loss, (event_type='error')::int::double as nan_share, (event_type='purchase')::int::double as ignore_share from events)
select epoch::int as epoch, pos, round(avg(loss),6)+0.0::double as loss, round(avg(nan_share),6)+0.0::double as nan_share, round(avg(ignore_share),6)+0.0::double as ignore_share, count(loss) as n_steps from e group by 1, 2""",
)
def m17(spark, sf):
    steps = table(spark, sf, "events").select(
        F.dayofmonth("ts").alias("epoch"),
        (F.col("user_id") % 8).cast("int").alias("pos"),
        F.when(F.col("value") > 50, F.lit(float("nan"))).otherwise(F.col("value")).alias("loss"),
        (F.col("event_type") == "error").cast("double").alias("nan_share"),
        (F.col("event_type") == "purchase").cast("double").alias("ignore_share"),
    )
    return rounded(M.positional_loss(steps))


@query(
    "m18_throughput",
    """with b as (select min(event_type) as t from events), a as (select event_type as strategy, avg(value) as mean_s, stddev_pop(value) as std_s, avg(user_id)::double as points from events group by 1),
c as (select *, case when mean_s > 0 then points/mean_s else 0.0::double end as pps from a)
select strategy, round(mean_s,6)+0.0::double as mean_s, round(std_s,6)+0.0::double as std_s, round(points,6)+0.0::double as points, round(pps,6)+0.0::double as points_per_s, round(case when pps>0 then 1000000.0::double/pps end,3)+0.0::double as projected_s,
 round(mean_s/(select mean_s from c join b on strategy=t),6)+0.0::double as relative_cost from c""",
)
def m18(spark, sf):
    ev = table(spark, sf, "events")
    base = ev.agg(F.min("event_type")).first()[0]
    t = ev.select(F.col("event_type").alias("strategy"), F.col("value").alias("seconds"), F.col("user_id").alias("points"))
    out = rounded(M.throughput(t, base=base).withColumn("projected_s", F.round("projected_s", 3)))
    return out


@query(
    "m19_scaling_grid",
    """with a as (select o_orderkey+1 as n from orders), b as (select n, greatest(1, floor(sqrt(n*200.0::double)))::bigint as t from a), c as (select n, greatest(1, floor(n::double/t))::bigint as bb from b)
select n, 1::bigint as few_batch, n as few_seq, greatest(1, floor(n/200.0::double))::bigint as many_batch, 200::bigint as many_seq, bb as balanced_batch, floor(n::double/bb)::bigint as balanced_seq from c""",
)
def m19(spark, sf):
    rows = table(spark, sf, "orders").select((F.col("o_orderkey") + 1).alias("n"))
    return rows.select("n", *[c.alias(k) for k, c in M.scaling_grid("n").items()])


@query(
    "m20_param_grid",
    "select o_orderstatus as status, o_orderpriority as priority, k::int as k from (select distinct o_orderstatus from orders) cross join (select distinct o_orderpriority from orders) cross join (values (1),(5),(9)) t(k)",
)
def m20(spark, sf):
    o = table(spark, sf, "orders")
    return M.param_grid(spark, {"status": o.select("o_orderstatus"), "priority": o.select("o_orderpriority"), "k": [1, 5, 9]})
