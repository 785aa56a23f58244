"""From score tables to leaderboards, and from run logs to comparisons.

Score tables have one row per (method, max_time, split, dataset_id, eval_pos,
metric); the windows below run over methods of one dataset, never over rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flipside.session import checkpointed

# Fixed values.
FAIL_CE = -100.0
FAIL_SCORE = -1.0
FEW_DATASETS = 29
INVERSE_FLOOR = 0.01


def compose_scores(scores: DataFrame, how: str = "mean", base: Sequence[str] = ("method", "metric")) -> DataFrame:
    """Staged averages: over splits, then datasets, then positions.

    The outer levels are means of means, so each stage works on the previous
    one.  NULL marks a failed or missing score and is left out.
    """
    base = list(base)
    agg = {"mean": F.avg, "sum": F.sum}[how]

    def level(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
        out = df.groupBy(*base, *keys).agg(agg("value").alias("value"))
        for c, t in (("dataset_id", "string"), ("eval_pos", "int")):
            if c not in keys:
                out = out.withColumn(c, F.lit(None).cast(t))
        return out.select(*base, F.lit(name).alias("level"), "dataset_id", "eval_pos", "value")

    cell = level(scores, ["dataset_id", "eval_pos"], "dataset_pos")
    per_pos = level(cell, ["eval_pos"], "pos")
    per_dataset = level(cell, ["dataset_id"], "dataset")
    overall = level(per_pos, [], "overall")
    return cell.unionByName(per_pos).unionByName(per_dataset).unionByName(overall)


def metric_matrix(scores: DataFrame, methods: Sequence[str], how: str = "mean") -> DataFrame:
    """dataset x method: mean (or sample deviation) over the runs of a method."""
    agg = {"mean": F.avg, "std": F.stddev_samp}[how]
    return scores.groupBy("dataset_id").pivot("method", list(methods)).agg(agg("value"))


def split_matrix(scores: DataFrame, methods: Sequence[str]) -> DataFrame:
    return scores.groupBy("dataset_id", "split").pivot("method", list(methods)).agg(F.avg("value"))


def mask_over_budget(scores: DataFrame, times: DataFrame, max_time: float | Column) -> DataFrame:
    """NULL out a method whose mean time is more than twice its budget."""
    spent = times.groupBy("method").agg(F.avg("value").alias("__t"))
    limit = max_time if isinstance(max_time, Column) else F.lit(float(max_time))
    out = scores.join(spent, "method", "left")
    return out.withColumn("value", F.when(F.col("__t") > limit * 2, F.lit(None).cast("double")).otherwise(F.col("value"))).drop("__t")


def fill_failures(scores: DataFrame, worst: bool = False) -> DataFrame:
    """Replace failed scores.  Cross-entropy: NULL -> -100, then negate (which
    makes a failure look best; worst=True gives it the worst value instead).
    Others: NULL -> -1."""
    ce = -F.coalesce(F.col("value"), F.lit(-FAIL_CE if worst else FAIL_CE))
    return scores.withColumn(
        "value", F.when(F.col("metric") == "cross_entropy", ce).otherwise(F.coalesce(F.col("value"), F.lit(FAIL_SCORE)))
    )


def method_ranks(scores: DataFrame, by: Sequence[str] = ("dataset_id",), digits: int = 3) -> DataFrame:
    """Average-tie rank of -round(value, digits) among the methods of a dataset."""
    v = F.round("value", digits)
    w = W.partitionBy(*by).orderBy(v.desc_nulls_last())
    ties = W.partitionBy(*by, v)
    rank = F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / F.lit(2.0)
    return scores.withColumn("rank", F.when(F.col("value").isNotNull(), rank))


def ranks_and_wins(scores: DataFrame, by: Sequence[str] = ("dataset_id",), per: Sequence[str] = ("method",)) -> DataFrame:
    """Mean rank and number of outright wins (ties at 1.5 do not count)."""
    return (
        method_ranks(scores, by)
        .groupBy(*per)
        .agg(F.avg("rank").alias("mean_rank"), F.sum((F.col("rank") == 1.0).cast("long")).alias("wins"))
    )


def win_tie_loss(scores: DataFrame, ref: str) -> DataFrame:
    """Per method: on how many datasets it beats, ties with or loses to `ref`."""
    base = scores.filter(F.col("method") == ref).select("dataset_id", F.col("value").alias("__ref"))
    both = scores.join(base, "dataset_id")
    own = F.col("method") == ref

    def n(cond: Column) -> Column:
        return F.sum(F.when(own, F.lit(0)).otherwise(F.coalesce(cond.cast("int"), F.lit(0)))).cast("long")

    return both.groupBy("method").agg(
        n(F.col("value") > F.col("__ref")).alias("wins"),
        n(F.col("value") == F.col("__ref")).alias("ties"),
        n(F.col("value") < F.col("__ref")).alias("losses"),
    )


def label_integrity(predictions: DataFrame, keys: Sequence[str] = ("split", "dataset_id", "eval_pos", "row_id")) -> DataFrame:
    """Datasets where methods saw different labels (empty = all is well).

    A row key is fine when its smallest and largest label agree: one
    aggregate, no self-join.
    """
    per_row = predictions.groupBy(*keys).agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    return (
        per_row.groupBy("dataset_id")
        .agg(F.sum((F.col("lo") != F.col("hi")).cast("long")).alias("n_conflicts"), F.count(F.lit(1)).alias("n_rows"))
    )


def require_same_labels(predictions: DataFrame) -> None:
    bad = label_integrity(predictions).filter("n_conflicts > 0").limit(1).collect()
    if bad:
        raise ValueError(f"methods saw different labels in dataset {bad[0]['dataset_id']}")


def budget_curve(scores: DataFrame, times: DataFrame, carry: Mapping[str, int] | None = None, minimum: Mapping[str, int] | None = None) -> DataFrame:
    """method x time budget x split: mean score, mean rank, wins, real time.

    `carry` maps a fast method to the larger budget its last result also
    stands for; `minimum` drops a method below its smallest useful budget.
    `few_datasets` warns when a cell covers no more than 29 datasets.
    """
    scores = checkpointed(scores)  # small next to the predictions behind it, and read several times
    keys = ["max_time", "split"]
    ranks = ranks_and_wins(scores, [*keys, "dataset_id"], [*keys, "method"])
    means = scores.groupBy(*keys, "method").agg(
        F.avg("value").alias("score"), F.count("value").alias("n_datasets")
    )
    real = times.groupBy("max_time", "method").agg(F.avg("value").alias("real_time"))
    out = means.join(ranks, [*keys, "method"]).join(real, ["max_time", "method"], "left")
    out = out.withColumn("few_datasets", F.col("n_datasets") <= FEW_DATASETS)
    for method, low in (minimum or {}).items():
        out = out.filter((F.col("method") != method) | (F.col("max_time") >= low))
    for method, target in (carry or {}).items():
        mine = out.filter(F.col("method") == method)
        last = mine.groupBy("split").agg(F.max("max_time").alias("max_time"))
        carried = mine.join(last, ["split", "max_time"]).withColumns(
            {"max_time": F.lit(target), "real_time": F.lit(float(target))}
        )
        out = out.unionByName(carried.select(*out.columns))
    return out


def leaderboard(scores: DataFrame, ref: str) -> DataFrame:
    """One row per method: wins, mean and deviation, mean rank, and counts
    against the reference method, for every metric; plus the mean time.

    `scores` has the metrics auc, accuracy, cross_entropy and time.
    """
    scores = checkpointed(scores)  # small next to the predictions behind it, and read a dozen times
    out = None
    for metric in ("auc", "accuracy", "cross_entropy"):
        sign = -1.0 if metric == "cross_entropy" else 1.0
        one = scores.filter(F.col("metric") == metric)
        per = one.groupBy("method", "dataset_id").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
        signed = per.select("method", "dataset_id", (F.col("m") * sign).alias("value"))
        summary = per.groupBy("method").agg(F.avg("m").alias(f"{metric}_mean"), F.avg("s").alias(f"{metric}_std"))
        ranks = ranks_and_wins(signed).withColumnsRenamed({"mean_rank": f"{metric}_rank", "wins": f"{metric}_wins"})
        wtl = win_tie_loss(signed, ref).select(
            "method", F.concat_ws("/", "wins", "ties", "losses").alias(f"{metric}_wtl")
        )
        part = summary.join(ranks, "method").join(wtl, "method")
        out = part if out is None else out.join(part, "method")
    times = scores.filter(F.col("metric") == "time").groupBy("method").agg(F.avg("value").alias("time_mean"))
    return out.join(times, "method", "left")


def best_by(report: DataFrame, name: str, directions: Mapping[str, bool]) -> DataFrame:
    """Best `name` per column; directions[column] is True when larger is better.

    Ties go to the smallest name.
    """
    picks = [
        F.min_by(name, F.struct((-F.col(c) if up else F.col(c)).alias("v"), F.col(name))).alias(c)
        for c, up in directions.items()
    ]
    return report.agg(*picks)


def highlight_extremes(table: DataFrame, by: Sequence[str], value: str = "value", largest: bool = True, digits: int = 3) -> DataFrame:
    r = F.round(value, digits)
    w = W.partitionBy(*by)
    edge = F.max(r).over(w) if largest else F.min(r).over(w)
    return table.withColumn("best", F.coalesce(r == edge, F.lit(False)))


def training_summary(log: DataFrame, by: Sequence[str] = ("run",)) -> DataFrame:
    """Initial, final and smallest loss, its first epoch, and the reduction."""
    out = log.groupBy(*by).agg(
        F.min_by("loss", "epoch").alias("initial_loss"),
        F.max_by("loss", "epoch").alias("final_loss"),
        F.min("loss").alias("best_loss"),
        F.min_by("epoch", F.struct("loss", "epoch")).alias("best_epoch"),
    )
    return out.withColumn(
        "reduction", F.when(F.col("initial_loss") > 0, F.lit(1.0) - F.col("best_loss") / F.col("initial_loss"))
    )


def criteria_check(metrics: DataFrame, thresholds: DataFrame, by: Sequence[str] = ("run",)) -> DataFrame:
    """Pass/fail of (run, metric, value) against (metric, threshold, at_most)."""
    passed = F.when(F.col("at_most"), F.col("value") <= F.col("threshold")).otherwise(F.col("value") >= F.col("threshold"))
    judged = metrics.join(thresholds, "metric").withColumn("passed", F.coalesce(passed, F.lit(False)))
    return judged.groupBy(*by).agg(
        F.bool_and("passed").alias("all_passed"),
        F.sum(F.col("passed").cast("long")).alias("n_passed"),
        F.count(F.lit(1)).alias("n_criteria"),
    )


def ablation_gap(validity: DataFrame, by: Sequence[str] = ("run",)) -> DataFrame:
    """correct minus wrong context, from rows (run, variant, value)."""
    wide = validity.groupBy(*by).pivot("variant", ["correct", "wrong", "none"]).agg(F.first("value"))
    return wide.withColumn("gap", F.col("correct") - F.col("wrong"))


def relative_change(metrics: DataFrame, run_a: str, run_b: str) -> DataFrame:
    """(b-a)/|a| in percent per metric; 0 when a is 0."""
    a = metrics.filter(F.col("run") == run_a).select("metric", F.col("value").alias("a"))
    b = metrics.filter(F.col("run") == run_b).select("metric", F.col("value").alias("b"))
    change = F.when(F.col("a") == 0, F.lit(0.0)).otherwise((F.col("b") - F.col("a")) / F.abs("a") * 100.0)
    return a.join(b, "metric").withColumn("change_pct", change)


def inverse_capped(v: str | Column) -> Column:
    c = F.col(v) if isinstance(v, str) else v
    return F.lit(1.0) / F.greatest(c, F.lit(INVERSE_FLOOR))


def positional_loss(steps: DataFrame, by: Sequence[str] = ("epoch",), pos: str = "pos") -> DataFrame:
    """Mean loss per evaluation position; steps with a NaN loss are skipped."""
    loss = F.when(~F.isnan(F.col("loss")), F.col("loss"))
    return steps.groupBy(*by, pos).agg(
        F.avg(loss).alias("loss"),
        F.avg("nan_share").alias("nan_share"),
        F.avg("ignore_share").alias("ignore_share"),
        F.count(loss).alias("n_steps"),
    )


def throughput(timings: DataFrame, by: Sequence[str] = ("strategy",), base: str = "fixed_magnitude", project_to: int = 1_000_000) -> DataFrame:
    """Mean and population deviation of the time, points per second, projected
    time, and the cost relative to a base strategy."""
    out = timings.groupBy(*by).agg(
        F.avg("seconds").alias("mean_s"), F.stddev_pop("seconds").alias("std_s"), F.avg("points").alias("points")
    )
    out = out.withColumn("points_per_s", F.when(F.col("mean_s") > 0, F.col("points") / F.col("mean_s")).otherwise(F.lit(0.0)))
    out = out.withColumn("projected_s", F.when(F.col("points_per_s") > 0, F.lit(float(project_to)) / F.col("points_per_s")))
    rest = [c for c in by if c != "strategy"]
    ref = out.filter(F.col("strategy") == base).select(*rest, F.col("mean_s").alias("__base"))
    if rest:
        out = out.join(ref, rest, "left")
    else:
        row = ref.first()
        out = out.withColumn("__base", F.lit(row["__base"] if row else None).cast("double"))
    return out.withColumn("relative_cost", F.when(F.col("__base") > 0, F.col("mean_s") / F.col("__base"))).drop("__base")


def scaling_grid(points: str | Column = "total_points", per_dataset: int = 200) -> dict[str, Column]:
    """(batch, seq) for the scaling modes few, many and balanced."""
    n = F.col(points) if isinstance(points, str) else points
    many = F.greatest(F.lit(1), F.floor(n / per_dataset))
    target = F.greatest(F.lit(1), F.floor(F.sqrt(n * per_dataset)))
    balanced = F.greatest(F.lit(1), F.floor(n / target))
    return {
        "few_batch": F.lit(1).cast("long"),
        "few_seq": n.cast("long"),
        "many_batch": many.cast("long"),
        "many_seq": F.lit(per_dataset).cast("long"),
        "balanced_batch": balanced.cast("long"),
        "balanced_seq": F.floor(n / balanced).cast("long"),
    }


def param_grid(spark: SparkSession, lists: Mapping[str, Sequence | DataFrame]) -> DataFrame:
    """Every combination of the named values (a configuration table).

    Values are a list, or a table of one column whose distinct values count.
    """
    out = spark.range(1).select(F.lit(0).alias("__all"))
    for name, values in lists.items():
        if isinstance(values, DataFrame):
            # The join key is the same everywhere: the result has to hold every combination.
            out = out.join(values.select(F.lit(0).alias("__all"), F.col(values.columns[0]).alias(name)).distinct(), "__all")
        else:
            out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out.drop("__all")
