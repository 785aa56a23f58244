"""Baseline models: MLlib estimators behind a registry, tuning, evaluation.

Fitting is distributed; the driver keeps the list of jobs, one number per
trial and the chosen settings.
"""

from __future__ import annotations

import itertools
import math
import random
import threading
import time
from collections import deque
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flipside.operators import metrics as L
from flipside.operators.missing import impute_mean
from flipside.operators.neighbours import knn_predict
from flipside.operators.splits import kfold
from flipside.operators.transforms import minmax, one_hot
from flipside.session import checkpointed
from flipside.sources.results import append_results, pending_jobs, read_results


def preprocess(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (), fit_on: Column | None = None, impute: bool = True, use_one_hot: bool = False, scale: bool = False) -> tuple[DataFrame, list[str]]:
    """Impute, then one-hot, then min-max, each fitted on the train rows."""
    out, cols = df, list(numeric)
    if impute:
        out = impute_mean(out, cols, [], fit_on)
    if use_one_hot:
        for c in categorical:
            before = set(out.columns)
            out = one_hot(out, c, fit_on)
            cols += [n for n in out.columns if n not in before]
    if scale:
        out = minmax(out, cols, [], fit_on).na.fill(0.0, cols)
    return out, cols


@dataclass(frozen=True)
class Model:
    """An estimator, its search space (value lists, or bounds of a log-uniform
    number) and the preprocessing that `fit` does for it."""

    build: Callable[..., object]
    space: Mapping[str, Sequence | LogUniform]
    one_hot: bool = False
    scale: bool = False
    task: str = "classification"


@dataclass(frozen=True)
class LogUniform:
    low: float
    high: float


def _logistic(classes: int, rows: int, **p):
    """C is the inverse weight of the penalty on the summed loss, which MLlib averages over the rows."""
    penalty = p.get("penalty", "l2")
    return LogisticRegression(
        maxIter=p.get("max_iter", 50),
        regParam=0.0 if penalty == "none" else 1.0 / (p.get("C", 1.0) * max(rows, 1)),
        elasticNetParam=1.0 if penalty == "l1" else 0.0,
        fitIntercept=p.get("fit_intercept", True),
        standardization=False,
        family="binomial" if classes == 2 else "multinomial",
    )


def _forest(classes: int, rows: int, **p):
    return RandomForestClassifier(numTrees=p.get("trees", 20), maxDepth=p.get("depth", 5), seed=p.get("seed", 0))


def _boosting(classes: int, rows: int, **p):
    gbt = GBTClassifier(maxIter=p.get("rounds", 10), maxDepth=p.get("depth", 3), stepSize=p.get("step", 0.1), seed=p.get("seed", 0))
    return gbt if classes == 2 else OneVsRest(classifier=gbt)


def _ridge(classes: int, rows: int, **p):
    return LinearRegression(regParam=p.get("alpha", 1.0), elasticNetParam=0.0)


MODELS: dict[str, Model] = {
    "logistic": Model(
        _logistic,
        {"C": LogUniform(1e-5, 1e5), "penalty": ["l2", "l1", "none"], "max_iter": [50, 100, 200], "fit_intercept": [True, False]},
        one_hot=True, scale=True,
    ),
    "random_forest": Model(_forest, {"trees": [10, 20, 40], "depth": [3, 5, 8]}),
    "gradient_boosting": Model(_boosting, {"rounds": [5, 10, 20], "depth": [2, 3, 5], "step": [0.05, 0.1, 0.3]}),
    "knn": Model(lambda classes, rows, **p: p.get("k", 5), {"k": [1, 3, 5, 9, 15]}, one_hot=True, scale=True),
    "ridge": Model(_ridge, {"alpha": [0.01, 0.1, 1.0, 10.0]}, task="regression"),
}


def register_model(name: str, build: Callable[..., object], space: Mapping[str, Sequence | LogUniform], **flags) -> None:
    """Add a user model: build(classes, rows, **params) -> MLlib estimator."""
    MODELS[name] = Model(build, space, **flags)


def _vectors(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol="features").transform(df)


@dataclass(frozen=True)
class Prepared:
    """Train and test rows after a model's own preprocessing, as one table: fits and predictions read it several times."""

    train: DataFrame
    test: DataFrame
    cols: list[str]


def prepared(name: str, rows: DataFrame, fit_on: Column, cols: Sequence[str], categorical: Sequence[str], keep: Sequence[str]) -> Prepared:
    """The preprocessing that `fit` does for the model; it is fitted on the rows where `fit_on` holds, the others are the test rows."""
    model = MODELS[name]
    wanted = [*dict.fromkeys([*keep, *cols, *categorical])]
    out, names = preprocess(rows.select(*wanted, fit_on.alias("__fit")), cols, categorical if model.one_hot else (), F.col("__fit"), use_one_hot=model.one_hot, scale=model.scale)
    out = checkpointed(out.select(*dict.fromkeys([*keep, *names]), "__fit"))
    return Prepared(out.filter("__fit").drop("__fit"), out.filter("not __fit").drop("__fit"), names)


def fit(name: str, train: DataFrame, test: DataFrame, cols: Sequence[str], label: str, key: str, classes: int, params: Mapping | None = None, categorical: Sequence[str] = (), keep: Sequence[str] = ()) -> Callable[[], DataFrame]:
    """Fits now; the returned function predicts (key, keep, probs) for the test rows, or (key, keep, pred) for a regression.

    `keep` names columns of the test rows that their predictions carry along.
    """
    wanted = [*dict.fromkeys([key, label, *keep, *cols, *categorical])]
    shared = [c for c in wanted if c in test.columns]
    both = train.select(*[c for c in wanted if c in train.columns]).withColumn("__part", F.lit(True)).unionByName(test.select(*shared).withColumn("__part", F.lit(False)), allowMissingColumns=True)
    return fit_prepared(name, prepared(name, both, F.col("__part"), cols, categorical, [key, label, *keep]), label, key, classes, params, keep)


def fit_prepared(name: str, data: Prepared, label: str, key: str, classes: int, params: Mapping | None = None, keep: Sequence[str] = ()) -> Callable[[], DataFrame]:
    """`fit` on rows that are prepared already, whatever the number of settings."""
    params = dict(params or {})
    model, train, test, cols = MODELS[name], data.train, data.test, data.cols
    carried = [*dict.fromkeys([key, *keep])]
    est = model.build(classes, train.count(), **params)
    if name == "knn":
        arr = F.array(*[F.col(c).cast("double") for c in cols]).alias("features")

        def nearest() -> DataFrame:
            pred = knn_predict(train.select(key, label, arr), test.select(key, arr), "features", label, key, classes, est)
            return pred.join(test.select(*carried), key).select(*carried, "probs") if carried != [key] else pred

        return nearest
    fitted = est.fit(_vectors(train.withColumn("label", F.col(label).cast("double")), cols).select("features", "label"))

    def predict() -> DataFrame:
        scored = fitted.transform(_vectors(test, cols).select(*carried, "features"))
        if model.task == "regression":
            return scored.select(*carried, F.col("prediction").alias("pred"))
        if "probability" in scored.columns:
            return scored.select(*carried, vector_to_array("probability").alias("probs"))
        raw = vector_to_array("rawPrediction")
        odds = F.transform(raw, lambda v: F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * v)))
        whole = F.aggregate(odds, F.lit(0.0), lambda a, v: a + v)
        return scored.select(*carried, odds.alias("o"), whole.alias("w")).select(*carried, F.transform("o", lambda v: v / F.col("w")).alias("probs"))

    return predict


def fit_predict(name: str, train: DataFrame, test: DataFrame, cols: Sequence[str], label: str, key: str, classes: int, params: Mapping | None = None, categorical: Sequence[str] = ()) -> DataFrame:
    return fit(name, train, test, cols, label, key, classes, params, categorical)()


def score(pred: DataFrame, truth: DataFrame, key: str, label: str, metric: str) -> float | None:
    """One number; larger is better whatever the metric."""
    return score_rows(pred.join(truth.select(key, F.col(label).alias("y")), key), metric)


def score_rows(rows: DataFrame, metric: str) -> float | None:
    """`score` of predictions that carry their label as `y`."""
    m = L.METRICS[metric]
    if m.kind == "table":
        value = m.build(rows, []).first()[0]
    else:
        value = rows.agg(m.build()).first()[0]
    if value is None:
        return None
    return float(value) if m.higher_is_better else -float(value)


@dataclass
class Tuned:
    """Seconds of the last fit and of its predictions, without the search; `failed` lists settings that could not be fitted."""

    params: dict
    cv_score: float | None
    fit_s: float
    predict_s: float
    trials: int
    predictions: DataFrame | None
    failed: list[str]


def sample_space(space: Mapping[str, Sequence | LogUniform], seed: int) -> Iterator[dict]:
    """All settings of a finite space in seeded random order, endless draws of another."""
    rng = random.Random(seed)
    if not any(isinstance(v, LogUniform) for v in space.values()):
        grid = [dict(zip(space, v)) for v in itertools.product(*space.values())]
        rng.shuffle(grid)
        yield from grid
        return
    while True:
        yield {k: math.exp(rng.uniform(math.log(v.low), math.log(v.high))) if isinstance(v, LogUniform) else rng.choice(v) for k, v in space.items()}


# What a setting that does not suit the data raises; programming errors pass through.
UNFIT = (PySparkException, Py4JJavaError, ValueError, ArithmeticError)


def in_order(items: Iterator, run: Callable, at_once: int, go_on: Callable[[], bool]) -> Iterator[tuple]:
    """(item, run(item)) in the order of the items; up to `at_once` run side by side, and none starts when `go_on` says no."""
    with ThreadPoolExecutor(at_once) as pool:
        waiting: deque = deque()
        for item in items:
            if not go_on():
                break
            waiting.append((item, pool.submit(run, item)))
            if len(waiting) == at_once:
                item, result = waiting.popleft()
                yield item, result.result()
        while waiting:
            item, result = waiting.popleft()
            yield item, result.result()


def tune(name: str, train: DataFrame, test: DataFrame, cols: Sequence[str], label: str, key: str, classes: int, metric: str = "cross_entropy", max_time: float = 60.0, max_evals: int | None = None, folds: int = 5, seed: int = 0, categorical: Sequence[str] = (), at_once: int = 4) -> Tuned:
    """Random search scored by cross-validation, until the time, the trials or the space are used up.

    The default settings are scored first and kept unless another setting is
    better; a trial that fails is skipped.  Up to `at_once` trials run side by
    side over one stored table of folds, and all of them fit on the same
    prepared rows of a fold, as settings do not enter the preprocessing; they
    are judged in the order in which they were drawn, so the choice does not
    depend on which of them ends first.
    """
    started, failed = time.time(), []
    cv = checkpointed(kfold(train.select(*dict.fromkeys([key, label, *cols, *categorical])), [], key, seed, folds))
    k = cv.agg(F.max("fold")).first()[0] + 1
    ready: dict[int, Prepared] = {}
    turn = [threading.Lock() for _ in range(k)]

    def fold(i: int) -> Prepared:
        """The rows of a fold, prepared by the first trial that comes to it."""
        with turn[i]:
            if i not in ready:
                ready[i] = prepared(name, cv, F.col("fold") != i, cols, categorical, [key, label])
            return ready[i]

    def cross_validate(params: dict) -> tuple[float, str | None]:
        got, why = [], None
        try:
            for i in range(k):
                pred = fit_prepared(name, fold(i), label, key, classes, params, [label])()
                got.append(score_rows(pred.withColumnRenamed(label, "y"), metric))
        except UNFIT as e:
            why = f"{params}: {type(e).__name__}: {e}"[:300]
        known = [g for g in got if g is not None]
        return (sum(known) / len(known) if len(got) == k and known else float("-inf")), why

    begun = itertools.count(1)
    best, best_score, trials = {}, float("-inf"), 0
    # The default settings are the first trial and start whatever the limits.
    drawn = itertools.chain([{}], sample_space(MODELS[name].space, seed))

    def go_on() -> bool:
        n = next(begun)
        return n == 1 or ((max_evals is None or n <= max_evals) and time.time() - started <= max_time)

    for params, (s, why) in in_order(drawn, cross_validate, at_once, go_on):
        trials += 1
        failed += [why] if why else []
        if s > best_score:
            best, best_score = params, s
    if best_score == float("-inf"):
        return Tuned({}, None, 0.0, 0.0, trials, None, failed)
    t0 = time.time()
    predict = fit(name, train, test, cols, label, key, classes, best, categorical)
    t1 = time.time()
    pred = checkpointed(predict())
    return Tuned(best, best_score, t1 - t0, time.time() - t1, trials, pred, failed)


JOB = ["method", "dataset_id", "eval_pos", "max_time", "split"]


def evaluate_methods(spark: SparkSession, jobs: DataFrame, store: str, run: Callable[[dict], DataFrame | None], budget: float | None = None) -> DataFrame | None:
    """Run every job that the store lacks and return the stored rows of all jobs (None: there are none).

    `jobs` is the small table (method, dataset_id, eval_pos, max_time, split);
    `run(job)` returns prediction rows, with fit_s and predict_s where it
    measures them, or None for a failed job.  A job's rows are stored when it
    ends, so an evaluation that is started again goes on where it stopped.
    After `budget` seconds no further job starts.
    """
    started = time.time()
    stored = read_results(spark, store)
    todo = jobs if stored is None else pending_jobs(jobs, stored.select(*JOB).distinct(), JOB)
    for job in todo.select(*JOB).orderBy(*JOB).toLocalIterator():
        if budget is not None and time.time() - started > budget:
            break
        part = run(job.asDict())
        if part is not None:
            tagged = part.withColumns({k: F.lit(job[k]) for k in JOB})
            append_results(tagged, store)
    stored = read_results(spark, store)
    return None if stored is None else stored.join(jobs.select(*JOB), JOB, "left_semi")


def score_grid(bounds: DataFrame, a: str, b: str, resolution: int, eps: float, score_of: Callable[[Column, Column], Column]) -> DataFrame:
    """Response on a mesh over two features, from min-eps to max+eps.

    `bounds` is one row per group with <f>_lo and <f>_hi.
    """
    def axis(f: str, i: Column) -> Column:
        low, high = F.col(f"{f}_lo") - F.lit(eps), F.col(f"{f}_hi") + F.lit(eps)
        return low + (high - low) * i / F.lit(float(resolution - 1))

    steps = F.sequence(F.lit(0), F.lit(resolution - 1))
    mesh = bounds.withColumn("i", F.explode(steps)).withColumn("j", F.explode(steps))
    mesh = mesh.withColumns({a: axis(a, F.col("i")), b: axis(b, F.col("j"))})
    return mesh.withColumn("response", score_of(F.col(a), F.col(b))).drop(f"{a}_lo", f"{a}_hi", f"{b}_lo", f"{b}_hi")
