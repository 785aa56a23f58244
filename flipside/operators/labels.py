"""Turning a continuous target (or feature) into classes."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flipside.functions.fitted import attach, attach_draws, drop_params, fit, materialise
from flipside.functions.keyed import rand_int_rounded, text_uniform01, uniform01
from flipside.functions.ranks import exact_quantiles, positions
from flipside.functions.stats import sigmoid


def calibrate_threshold(df: DataFrame, target: str, by: Sequence[str], name: str = "threshold") -> DataFrame:
    """Frozen lower median of the target per group (by=[] gives one for all)."""
    return materialise(
        exact_quantiles(df, by, [target], [0.5], "lower").withColumnRenamed(f"{target}_q0", name)
    )


def binarize_threshold(target: str | Column, threshold: str | float | Column) -> Column:
    x = F.col(target) if isinstance(target, str) else target
    t = threshold if isinstance(threshold, Column) else F.col(threshold) if isinstance(threshold, str) else F.lit(float(threshold))
    return (x > t).cast("int")


def binarize_balanced(df: DataFrame, targets: Sequence[str], by: Sequence[str] = (), suffix: str = "_class") -> DataFrame:
    """y > lower median.  by=() takes one median over everything; every target
    gets its own median, so factual and counterfactual sides differ."""
    stats = materialise(exact_quantiles(df, by, targets, [0.5], "lower"))
    out = attach(df, stats, by).withColumns({f"{t}{suffix}": binarize_threshold(t, f"{t}_q0") for t in targets})
    return drop_params(out, stats, by)


@dataclass
class ClassAssigner:
    """Turns a target into classes; `threshold` is a number, a table of one per group, or None before `fit`."""

    threshold: float | DataFrame | None = None

    def fit(self, df: DataFrame, target: str, by: Sequence[str] = ()) -> ClassAssigner:
        """Freezes the lower median of each group."""
        return ClassAssigner(calibrate_threshold(df, target, by))

    def assign(self, df: DataFrame, target: str, by: Sequence[str] = (), name: str = "y_class") -> DataFrame:
        if self.threshold is None:
            raise ValueError("fit the class assigner or give it a threshold first")
        if not isinstance(self.threshold, DataFrame):
            return df.withColumn(name, binarize_threshold(target, self.threshold))
        return attach(df, self.threshold, by).withColumn(name, binarize_threshold(target, "threshold")).drop("threshold")


ASSIGNERS: dict[str, Callable[..., ClassAssigner]] = {"balanced": ClassAssigner, "fixed": lambda threshold=0.0: ClassAssigner(float(threshold))}


def register_assigner(name: str, make: Callable[..., ClassAssigner]) -> None:
    """Add a user assigner: a function that returns an object with `threshold`, `fit` and `assign`."""
    ASSIGNERS[name] = make


def count_below(x: Column, bounds: Column) -> Column:
    return F.size(F.filter(bounds, lambda b: x > b))


def rank_boundaries(df: DataFrame, col: str, by: Sequence[str], key: str, classes: int, seed: int) -> DataFrame:
    """K-1 boundaries per group: values found at keyed random rows (with replacement)."""
    indexed = positions(df.select(*by, key, col), by, key)
    sizes = fit(df, by, [F.count(F.lit(1)).alias("__n")])
    picks = sizes.select(*by, "__n", F.explode(F.sequence(F.lit(0), F.lit(classes - 2))).alias("k")).select(
        *by,
        "k",
        F.floor(text_uniform01(seed, *[F.col(b) for b in by], col, F.col("k")) * F.col("__n")).cast("long").alias("pos"),
    )
    picked = indexed.join(picks, [*by, "pos"])
    return materialise(picked.groupBy(*by).agg(F.collect_list(F.col(col).cast("double")).alias(f"{col}_bounds")))


def multiclass_by_rank(df: DataFrame, col: str, by: Sequence[str], key: str, classes: int, seed: int, name: str = "y_class") -> DataFrame:
    bounds = rank_boundaries(df, col, by, key, classes, seed)
    out = attach(df, bounds, by).withColumn(name, count_below(F.col(col), F.col(f"{col}_bounds")))
    return drop_params(out, bounds, by)


def multiclass_by_value(col: str | Column, bounds: Sequence[float]) -> Column:
    x = F.col(col) if isinstance(col, str) else col
    return count_below(x, F.array(*[F.lit(float(b)) for b in bounds]))


def multiclass_sample(scores: Sequence[Column], *key) -> Column:
    """Draw a class with probability proportional to (1e-5+sigmoid(score))^3."""
    w = [F.pow(F.lit(1e-5) + sigmoid(F.coalesce(s, F.lit(1e-5))), F.lit(3.0)) for s in scores]
    mass = w[0]
    edges = [w[0]]
    for x in w[1:]:
        mass = mass + x
        edges.append(mass)
    u = uniform01(*key) * mass
    picked = F.lit(len(w) - 1)
    for i, e in reversed(list(enumerate(edges[:-1]))):
        picked = F.when(u < e, F.lit(i)).otherwise(picked)
    return picked.cast("int")


def keyed_permutation(classes: int, *key) -> Column:
    """Array p with p[c] = the class that takes place c, from a keyed sort."""
    drawn = F.transform(
        F.sequence(F.lit(0), F.lit(classes - 1)),
        lambda c: F.struct(text_uniform01(*key, c).alias("u"), c.alias("c")),
    )
    return F.transform(F.array_sort(drawn), lambda s: s["c"])


def permute_classes(df: DataFrame, code: Column, classes: int, ordered_p: float, by: Sequence[str], seed: int, name: str = "y_class") -> DataFrame:
    """With probability 1-ordered_p permute the classes of a group, then with
    probability one half reverse them.

    Each group's new classes are one short array, so a row only looks its own up.
    """
    group = [F.col(b) for b in by]
    same = F.sequence(F.lit(0), F.lit(classes - 1))
    placed = F.when(text_uniform01(seed, *group, "shuffle") > F.lit(float(ordered_p)), keyed_permutation(classes, seed, *group, "perm")).otherwise(same)
    turned = F.when(text_uniform01(seed, *group, "reverse") > 0.5, F.transform(placed, lambda c: F.lit(classes - 1) - c)).otherwise(placed)
    out = attach_draws(df, by, {"__classes": turned})
    return out.withColumn(name, F.get("__classes", code).cast("int")).drop("__classes")


def softsign(x: Column) -> Column:
    return x / (F.lit(1.0) + F.abs(x))


def rank_codes(df: DataFrame, cols: Sequence[str], by: Sequence[str], key: str, classes: int, seed: int) -> tuple[DataFrame, dict[str, Column]]:
    """Attach the boundaries of every column once and return their code Columns."""
    params = None
    indexed = positions(df.select(*by, key, *cols), by, key)
    sizes = fit(df, by, [F.count(F.lit(1)).alias("__n")])
    picks = sizes.select(*by, "__n", F.explode(F.sequence(F.lit(0), F.lit(classes - 2))).alias("k"))
    draws = picks.select(
        *by,
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(j).alias("feat"),
                        F.floor(text_uniform01(seed, *[F.col(b) for b in by], c, F.col("k")) * F.col("__n")).cast("long").alias("pos"),
                    )
                    for j, c in enumerate(cols)
                ]
            )
        ).alias("d"),
    ).select(*by, "d.feat", "d.pos")
    hit = indexed.join(draws, [*by, "pos"])
    params = materialise(
        hit.groupBy(*by).agg(
            *[F.collect_list(F.when(F.col("feat") == j, F.col(c).cast("double"))).alias(f"{c}_bounds") for j, c in enumerate(cols)]
        )
    )
    return attach(df, params, by), {c: count_below(F.col(c), F.col(f"{c}_bounds")) for c in cols}


def discretize_features(df: DataFrame, cols: Sequence[str], by: Sequence[str], key: str, p: float, classes: int, seed: int) -> DataFrame:
    """Softsign every feature; chosen ones become #boundaries below - K/2."""
    soft = df.withColumns({c: softsign(F.col(c)) for c in cols})
    out, codes = rank_codes(soft, cols, by, key, classes, seed)
    group = [F.col(b) for b in by]
    drawn = F.array(*[text_uniform01(seed, *group, c, "choose") < F.lit(float(p)) for c in cols])
    out = attach_draws(out, by, {"__chosen": drawn})
    new = {c: F.when(F.get("__chosen", F.lit(j)), codes[c].cast("double") - F.lit(classes / 2.0)).otherwise(F.col(c)) for j, c in enumerate(cols)}
    return out.withColumns(new).drop("__chosen", *[f"{c}_bounds" for c in cols])


def class_range(low: int, high: int, *key) -> Column:
    """Number of classes of a dataset: 2 half of the time, else uniform."""
    return F.when(uniform01(*key, "two") > 0.5, rand_int_rounded(low, high, *key, "k")).otherwise(F.lit(2)).cast("int")
