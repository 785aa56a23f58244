"""Baseline models (O) and the learning curve (C7)."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import functions as F

from flipside.functions.keyed import uniform01
from flipside.operators import models as O
from flipside.operators.neighbours import knn_predict
from flipside.operators.splits import keyed_shuffle, learning_curve
from flipside.plans.inputs import FEATURES, OF_SQL, SEED, SCORE, U, WEIGHTS, Z_SQL, embedding_points, order_features, s, scored_orders
from flipside.plans.registry import R, query, rounded
from flipside.session import checkpoint_dir, checkpointed

_SD = str(SEED)
_TRAIN = U(_SD, "row_id", s("train")) + " < 0.5::double"


def _is_train():
    return uniform01(SEED, F.col("row_id"), "train") < 0.5


@query(
    "o1_preprocess",
    f"""with {OF_SQL}, t_ as (select *, {_TRAIN} as tr from of_), m_ as (select {', '.join(f'avg(case when tr then {f} end) as m_{f}' for f in FEATURES)} from t_),
i_ as (select row_id, tr, label_str, {', '.join(f'coalesce({f}, m_{f}) as {f}' for f in FEATURES)} from t_ cross join m_),
c_ as (select label_str as c, row_number() over (order by label_str)-1 as i from (select distinct label_str from t_ where tr)),
b_ as (select {', '.join(f'min(case when tr then {f} end) as lo_{f}, max(case when tr then {f} end) as hi_{f}' for f in FEATURES)} from i_)
select row_id, {', '.join(R(f'({f}-lo_{f})/(hi_{f}-lo_{f})', f) for f in FEATURES)}, {', '.join(f'(label_str = (select c from c_ where i={i}))::int::double as label_str_{i}' for i in range(3))} from i_ cross join b_""",
)
def o1(spark, sf):
    rows = order_features(spark, sf).withColumn("tr", _is_train())
    out, cols = O.preprocess(rows, FEATURES, ["label_str"], F.col("tr"), use_one_hot=True, scale=True)
    return rounded(out.select("row_id", *cols))


def _orders(spark, sf):
    """Imputed, scaled order features; the label is 'score above 0'."""
    rows = scored_orders(spark, sf).withColumn("cls", (F.col("y") > 0).cast("int")).withColumn("tr", _is_train())
    out, _ = O.preprocess(rows, FEATURES, fit_on=F.col("tr"), scale=True)
    return out.filter("tr"), out.filter("not tr")


_TEST = f"{Z_SQL}, e_ as (select * from so_ where not ({_TRAIN}))"


def _facts(pred, test):
    """What SQL can state of a fit: rows, probabilities that add up, better than the most frequent class and than its share."""
    rows = pred.join(test.select("row_id", F.col("cls").alias("y")), "row_id")
    total = F.aggregate("probs", F.lit(0.0), lambda a, v: a + v)
    most = F.greatest(F.avg("y"), 1 - F.avg("y"))
    chance = -(F.avg("y") * F.log(F.avg("y")) + (1 - F.avg("y")) * F.log(1 - F.avg("y")))
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.min(F.abs(total - 1) < 1e-9).alias("adds_up"), (O.L.accuracy() > most).alias("beats_majority"), (O.L.cross_entropy() < chance).alias("informative")
    )


def _facts_sql(method: str) -> str:
    return f"with {_TEST} select '{method}' as method, count(*) as n, true as adds_up, true as beats_majority, true as informative from e_"


def _model_query(query_name, name):
    @query(query_name, _facts_sql(name))
    def run(spark, sf, name=name):
        train, test = _orders(spark, sf)
        pred = O.fit_predict(name, train, test, FEATURES, "cls", "row_id", 2)
        return _facts(pred, test).withColumn("method", F.lit(name))


for _q, _m in (("o2_logistic", "logistic"), ("o3_random_forest", "random_forest"), ("o4_gradient_boosting", "gradient_boosting")):
    _model_query(_q, _m)


_KNN = f"""with r_ as (select vec_id as row_id, label, embedding, {U(_SD, 'vec_id', s('train'))} < 0.5::double as tr from embeddings),
x_ as (select row_id, tr, unnest(range(64)) as i, unnest(embedding)::double as x from r_),
d_ as (select a.row_id as q, b.row_id as r, sqrt(sum((a.x-b.x)*(a.x-b.x))) as d from x_ a join x_ b on a.i=b.i and not a.tr and b.tr group by 1, 2),
n_ as (select *, row_number() over (partition by q order by d, r) as k from d_ qualify k <= 7),
v_ as (select q, c, avg((label=c)::int) as p from n_ join r_ on r_.row_id = n_.r cross join (select unnest(range(10)) as c) group by q, c)
select q as row_id, list(round(p,6)+0.0::double order by c) as probs from v_ group by q"""


@query("o5_knn", _KNN)
def o5(spark, sf):
    pts = embedding_points(spark, sf).withColumn("tr", _is_train())
    out = knn_predict(pts.filter("tr"), pts.filter("not tr"), "features", "label", "row_id", 10, 7)
    return out.select("row_id", F.transform("probs", lambda v: F.round(v, 6) + 0.0).alias("probs"))


@query("o6_ridge", f"with {_TEST} select count(*) as n, true as explains from e_")
def o6(spark, sf):
    """The target is a sum of features, so a weak penalty leaves next to nothing unexplained."""
    rows = scored_orders(spark, sf).withColumn("tr", _is_train())
    pred = O.fit_predict("ridge", rows.filter("tr"), rows.filter("not tr"), FEATURES, "y", "row_id", 0, {"alpha": 0.01})
    return pred.join(rows.select("row_id", "y"), "row_id").agg(F.count(F.lit(1)).alias("n"), (O.L.rmse("pred", "y") < 0.1 * F.stddev_samp("y")).alias("explains"))


@query("o7_tune", f"with {_TEST} select count(*) as n, true as adds_up, true as beats_majority, true as informative, 3 as trials, 0 as failed from e_")
def o7(spark, sf):
    train, test = _orders(spark, sf)
    got = O.tune("logistic", train, test, FEATURES, "cls", "row_id", 2, max_time=600.0, max_evals=3, folds=5)
    return _facts(got.predictions, test).withColumns({"trials": F.lit(got.trials), "failed": F.lit(len(got.failed))})


@query(
    "o8_evaluate_methods",
    f"""with {_TEST}, m_ as (select unnest(['logistic', 'random_forest']) as method)
select method, dataset_id, count(*) as n, true as timed, 10 as first_fits, 0 as second_fits from e_ cross join m_ group by method, dataset_id""",
)
def o8(spark, sf):
    """Two methods on every dataset, twice over one store: the second evaluation fits nothing."""
    # Sorted by dataset inside its parts, so that a job reads the pages of its own.
    train, test = (checkpointed(x.select("dataset_id", "row_id", "cls", *FEATURES).sortWithinPartitions("dataset_id")) for x in _orders(spark, sf))
    jobs = train.select("dataset_id").distinct().select(
        F.explode(F.array(F.lit("logistic"), F.lit("random_forest"))).alias("method"),
        "dataset_id",
        F.lit(0).alias("eval_pos"),
        F.lit(60).alias("max_time"),
        F.lit(1).alias("split"),
    )
    store = f"{checkpoint_dir(spark).rstrip('/')}/evaluation-{uuid.uuid4().hex}"
    fits = []

    def run(job):
        own = F.col("dataset_id") == job["dataset_id"]
        fits.append(job)
        t0 = time.time()
        predict = O.fit(job["method"], train.filter(own), test.filter(own), FEATURES, "cls", "row_id", 2, keep=["cls"])
        t1 = time.time()
        pred = checkpointed(predict())
        times = {"fit_s": F.lit(t1 - t0), "predict_s": F.lit(time.time() - t1)}
        return pred.withColumnRenamed("cls", "y").withColumns(times)

    O.evaluate_methods(spark, jobs, store, run)
    first = len(fits)
    out = O.evaluate_methods(spark, jobs, store, run)
    return out.groupBy("method", "dataset_id").agg(
        F.count(F.lit(1)).alias("n"), F.min((F.col("fit_s") > 0) & (F.col("predict_s") > 0)).alias("timed"), F.lit(first).alias("first_fits"), F.lit(len(fits) - first).alias("second_fits")
    )


@query(
    "o9_score_grid",
    f"""with {Z_SQL}, b_ as (select dataset_id, min(f_0) as a0, max(f_0) as a1, min(f_4) as b0, max(f_4) as b1 from so_ group by dataset_id),
g_ as (select dataset_id, i, j, (a0-0.5::double)+((a1+0.5::double)-(a0-0.5::double))*i/19.0::double as x, (b0-0.5::double)+((b1+0.5::double)-(b0-0.5::double))*j/19.0::double as z from b_ cross join (select unnest(range(20)) as i) cross join (select unnest(range(20)) as j))
select dataset_id, i::int as i, j::int as j, {R('x', 'f_0')}, {R('z', 'f_4')}, {R(f"{WEIGHTS['f_0']}::double*x+{WEIGHTS['f_4']}::double*z", 'response')} from g_""",
)
def o9(spark, sf):
    b = scored_orders(spark, sf).groupBy("dataset_id").agg(
        F.min("f_0").alias("f_0_lo"), F.max("f_0").alias("f_0_hi"), F.min("f_4").alias("f_4_lo"), F.max("f_4").alias("f_4_hi")
    )
    return rounded(O.score_grid(b, "f_0", "f_4", 20, 0.5, lambda x, z: x * WEIGHTS["f_0"] + z * WEIGHTS["f_4"]))


_SHARES = [0.1, 0.4, 1.0]


@query(
    "c7_learning_curve",
    f"""with {OF_SQL}, n_ as (select count(*) as n from of_), m_ as (select unnest(['logistic', 'random_forest']) as method), h_ as (select unnest({_SHARES}) as share)
select method, floor(share*((n+1)//2))::int as size, 2 as splits, true as better_than_chance from n_ cross join m_ cross join h_""",
)
def c7(spark, sf):
    """Sizes are shares of the train half; the score is the mean over two splits."""
    train, test = _orders(spark, sf)
    whole = checkpointed(train.unionByName(test).select("row_id", "cls", *FEATURES))
    half = (whole.count() + 1) // 2
    out = []
    for split in (1, 2):
        rows = checkpointed(keyed_shuffle(whole, [], "row_id", SEED + split))
        for method in ("logistic", "random_forest"):

            def fit_and_score(tr, te, method=method):
                return O.score(O.fit_predict(method, tr, te, FEATURES, "cls", "row_id", 2), te, "row_id", "cls", "accuracy")

            out += [(method, split, n, v) for n, v in learning_curve(rows, [int(x * half) for x in _SHARES], fit_and_score)]
    scores = spark.createDataFrame(out, "method string, split int, size int, score double")
    return scores.groupBy("method", "size").agg(F.count(F.lit(1)).cast("int").alias("splits"), (F.avg("score") > 0.6).alias("better_than_chance"))
