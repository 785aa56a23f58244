"""Scores of predictions against labels, per group.

`probs` is an array of class probabilities and `y` an integer class.  Ranking
metrics merge equal scores first and use bucketed running totals, so a group
of any size is handled by many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flipside.functions.ranks import running_totals, value_buckets
from flipside.functions.stats import array_sum
from flipside.session import checkpointed

# Fixed value: lower bound of a logarithm in the binary cross-entropy.
LOG_FLOOR = -100.0


def positive_score(probs: str = "probs") -> Column:
    return F.element_at(F.col(probs), 2)


def hard_class(probs: str = "probs") -> Column:
    """Class 1 when its probability is above one half (two classes), else the first largest."""
    arg = F.array_position(F.col(probs), F.array_max(F.col(probs))) - 1
    return F.when(F.size(F.col(probs)) == 2, (positive_score(probs) > 0.5).cast("int")).otherwise(arg.cast("int"))


def _by_score(df: DataFrame, by: Sequence[str], positive: Column, score: Column) -> DataFrame:
    """Positive and negative rows of every distinct score, as a table: it is read several times, the predictions once.

    Rows without a label or a score are left out after the merge, so that a row's score is worked out once.
    """
    rows = df.select(*by, positive.cast("int").alias("__p"), score.cast("double").alias("__s"))
    merged = checkpointed(rows.groupBy(*by, "__s").agg(F.sum("__p").alias("pos"), F.sum(1 - F.col("__p")).alias("neg")))
    return merged.filter(F.col("__s").isNotNull() & F.col("pos").isNotNull())


def auc(df: DataFrame, by: Sequence[str], positive: Column | None = None, score: Column | None = None) -> DataFrame:
    """Rank-sum AUC with average ties; NULL when a group has one class only."""
    positive = (F.col("y") == 1) if positive is None else positive
    score = positive_score() if score is None else score
    distinct = _by_score(df, by, positive, score)
    run = running_totals(
        value_buckets(distinct, "__s"), by, [F.col("__s")], {"neg": F.col("neg"), "pos": F.col("pos")}
    )
    won = F.col("pos") * (F.col("run_neg") - F.col("neg") / 2.0)
    return run.groupBy(*by).agg(
        F.try_divide(F.sum(won), (F.first("all_pos").cast("double") * F.first("all_neg"))).alias("auc")
    )


def auc_ovo(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """One-versus-one AUC: mean over class pairs of (A(i|j)+A(j|i))/2.

    A row of class c is positive in the pairs (c,j) and negative in (j,c); it
    gives 2(K-1) score rows, which are merged by value before any shuffle.
    """
    k = F.size("probs")
    others = F.filter(F.sequence(F.lit(0), k - 1), lambda j: j != F.col("y"))
    duels = F.explode(
        F.flatten(
            F.transform(
                others,
                lambda j: F.array(
                    F.struct(F.col("y").alias("i"), j.alias("j"), F.lit(1).alias("p"), F.element_at("probs", F.col("y") + 1).alias("s")),
                    F.struct(j.alias("i"), F.col("y").alias("j"), F.lit(0).alias("p"), F.element_at("probs", j + 1).alias("s")),
                ),
            )
        )
    )
    rows = df.select(*by, duels.alias("d")).select(*by, "d.i", "d.j", "d.p", "d.s")
    per = auc(rows, [*by, "i", "j"], F.col("p") == 1, F.col("s"))
    return per.groupBy(*by).agg(F.avg("auc").alias("auc_ovo"))


def accuracy() -> Column:
    return F.avg((hard_class() == F.col("y")).cast("double"))


def balanced_accuracy(df: DataFrame, by: Sequence[str]) -> DataFrame:
    recall = df.groupBy(*by, "y").agg(accuracy().alias("recall"))
    return recall.groupBy(*by).agg(F.avg("recall").alias("balanced_accuracy"))


def average_precision(df: DataFrame, by: Sequence[str], hard: bool = True) -> DataFrame:
    """Sum of recall steps times precision; on hard predictions by default."""
    score = hard_class().cast("double") if hard else positive_score()
    distinct = _by_score(df, by, F.col("y") == 1, score).withColumn("__s", -F.col("__s"))
    run = running_totals(
        value_buckets(distinct, "__s"), by, [F.col("__s")], {"neg": F.col("neg"), "pos": F.col("pos")}
    )
    step = F.col("pos") * F.col("run_pos") / (F.col("run_pos") + F.col("run_neg"))
    return run.groupBy(*by).agg(F.try_divide(F.sum(step), F.first("all_pos")).alias("average_precision"))


def brier() -> Column:
    k = F.size("probs")
    sq = F.transform(
        F.col("probs"), lambda p, i: (p - (i == F.col("y")).cast("double")) * (p - (i == F.col("y")).cast("double"))
    )
    return F.avg(F.when(k > 0, array_sum(sq)))


def ece(df: DataFrame, by: Sequence[str], bins: int = 15) -> DataFrame:
    """L1 calibration error over equal bins of the winning probability."""
    conf = F.array_max("probs")
    right = (F.array_position(F.col("probs"), conf) - 1 == F.col("y")).cast("double")
    rows = df.select(*by, F.floor(conf * F.lit(float(bins))).alias("bin"), conf.alias("conf"), right.alias("right"))
    per = rows.groupBy(*by, "bin").agg(
        F.sum("conf").alias("conf"), F.sum("right").alias("right"), F.count(F.lit(1)).alias("n")
    )
    return per.groupBy(*by).agg((F.sum(F.abs(F.col("right") - F.col("conf"))) / F.sum("n")).alias("ece"))


def cross_entropy(as_logits: bool = False) -> Column:
    """Binary: -y ln p - (1-y) ln(1-p) with the logarithm kept above -100.
    More classes: -ln p of the true class, or log-softmax of the inputs when
    they are to be read as logits."""
    p = positive_score()

    def safe_log(v: Column) -> Column:
        return F.when(v > 0, F.greatest(F.log(v), F.lit(LOG_FLOOR))).otherwise(F.lit(LOG_FLOOR))

    binary = F.when(F.col("y") == 1, -safe_log(p)).otherwise(-safe_log(F.lit(1.0) - p))
    own = F.element_at(F.col("probs"), F.col("y") + 1)
    if as_logits:
        multi = F.log(array_sum(F.transform(F.col("probs"), lambda v: F.exp(v)))) - own
    else:
        multi = -safe_log(own)
    return F.avg(F.when(F.size("probs") == 2, binary).otherwise(multi))


def mse(pred: str, target: str) -> Column:
    return F.avg((F.col(pred) - F.col(target)) * (F.col(pred) - F.col(target)))


def rmse(pred: str, target: str) -> Column:
    return F.sqrt(mse(pred, target))


def mae(pred: str, target: str) -> Column:
    return F.avg(F.abs(F.col(pred) - F.col(target)))


def neg_r2(pred: str, target: str, standard: bool = False) -> Column:
    """-R^2 with the prediction taken as truth; standard=True swaps them back."""
    truth = target if standard else pred
    err = F.sum((F.col(pred) - F.col(target)) * (F.col(pred) - F.col(target)))
    spread = F.var_pop(truth) * F.count(truth)
    return -(F.lit(1.0) - F.try_divide(err, spread))


@dataclass(frozen=True)
class Metric:
    """`build` is an aggregate Column, or a function (df, by) -> DataFrame whose
    last column is the score."""

    build: Callable
    higher_is_better: bool
    task: str
    kind: str = "column"


METRICS: dict[str, Metric] = {
    "auc": Metric(auc, True, "binary", "table"),
    "auc_ovo": Metric(auc_ovo, True, "multiclass", "table"),
    "accuracy": Metric(accuracy, True, "classification"),
    "balanced_accuracy": Metric(balanced_accuracy, True, "classification", "table"),
    "average_precision": Metric(average_precision, True, "binary", "table"),
    "brier": Metric(brier, False, "classification"),
    "ece": Metric(ece, False, "classification", "table"),
    "cross_entropy": Metric(cross_entropy, False, "classification"),
    "count": Metric(lambda: F.lit(1.0) * F.max(F.lit(1)), True, "any"),
    "time": Metric(lambda: F.max("time_s"), False, "any"),
}


def register_metric(name: str, build: Callable, higher_is_better: bool, task: str = "classification", kind: str = "column") -> None:
    METRICS[name] = Metric(build, higher_is_better, task, kind)


def score_table(predictions: DataFrame, names: Sequence[str], by: Sequence[str] = ("method", "max_time", "split", "dataset_id", "eval_pos")) -> DataFrame:
    """Score table (by, metric, value): column metrics share one pass."""
    by = list(by)
    unknown = [n for n in names if n not in METRICS]
    if unknown:
        raise ValueError(f"unknown metrics {unknown}; known: {sorted(METRICS)}")
    plain = [n for n in names if METRICS[n].kind == "column"]
    parts = []
    if plain:
        wide = predictions.groupBy(*by).agg(*[METRICS[n].build().alias(n) for n in plain])
        cells = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in plain]))
        parts.append(wide.select(*by, cells.alias("c")).select(*by, "c.metric", "c.value"))
    for n in names:
        if METRICS[n].kind == "table":
            t = METRICS[n].build(predictions, by)
            parts.append(t.select(*by, F.lit(n).alias("metric"), F.col(t.columns[-1]).cast("double").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
