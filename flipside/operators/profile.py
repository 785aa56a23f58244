"""Statistics of a table of features and its target."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flipside.functions.fitted import attach, fit
from flipside.functions.ranks import exact_quantiles, long_form
from flipside.functions.stats import kurt_sample_std, skew_sample_std


def _unpack(wide: DataFrame, by: Sequence[str], features: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Turn one row per group with columns <f>__<name> into one row per feature."""
    cells = F.explode(
        F.array(
            *[
                F.struct(F.lit(i).alias("feat"), *[F.col(f"{f}__{n}").alias(n) for n in names])
                for i, f in enumerate(features)
            ]
        )
    )
    return wide.select(*by, cells.alias("c")).select(*by, "c.feat", *[f"c.{n}" for n in names])


def feature_moments(df: DataFrame, features: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Mean, sample deviation, min, max and range of every feature, in one pass."""
    stats = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "range": lambda c: F.max(c) - F.min(c)}
    wide = df.groupBy(*by).agg(*[a(f).alias(f"{f}__{n}") for f in features for n, a in stats.items()])
    return _unpack(wide, by, features, list(stats))


def feature_shape(df: DataFrame, features: Sequence[str], by: Sequence[str]) -> DataFrame:
    stats = {"skew": skew_sample_std, "kurt": kurt_sample_std}
    wide = df.groupBy(*by).agg(*[a(f).alias(f"{f}__{n}") for f in features for n, a in stats.items()])
    return _unpack(wide, by, features, list(stats))


def feature_iqr(df: DataFrame, features: Sequence[str], by: Sequence[str]) -> DataFrame:
    q = exact_quantiles(df, by, features, [0.25, 0.75])
    wide = q.select(
        *by,
        *[
            c
            for f in features
            for c in (
                F.col(f"{f}_q0").alias(f"{f}__q25"),
                F.col(f"{f}_q1").alias(f"{f}__q75"),
                (F.col(f"{f}_q1") - F.col(f"{f}_q0")).alias(f"{f}__iqr"),
            )
        ],
    )
    return _unpack(wide, by, features, ["q25", "q75", "iqr"])


def feature_summary(df: DataFrame, features: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Mean and deviation over the features of every per-feature number."""
    keys = [*by, "feat"]
    per = feature_moments(df, features, by).join(feature_shape(df, features, by), keys).join(
        feature_iqr(df, features, by), keys
    )
    names = ["mean", "std", "min", "max", "range", "skew", "kurt", "iqr"]
    return per.groupBy(*by).agg(
        *[a(n).alias(f"{n}_{t}") for n in names for t, a in (("mean", F.avg), ("std", F.stddev_samp))]
    )


def corr_matrix(df: DataFrame, features: Sequence[str], by: Sequence[str], only: Sequence[tuple[int, int]] | None = None) -> DataFrame:
    """Pearson correlations in long form (by, i, j, r), all i and j, or i = j and the pairs `only` (i < j) both ways.

    One aggregate holds all d(d-1)/2 co-moments; for wide vectors use
    `corr_matrix_vectors`.
    """
    d = len(features)
    pairs = [(i, j) for i in range(d) for j in range(i + 1, d)] if only is None else list(only)
    wide = df.groupBy(*by).agg(*[_corr(features[i], features[j]).alias(f"r_{i}_{j}") for i, j in pairs])
    cells = [F.struct(F.lit(i).alias("i"), F.lit(i).alias("j"), F.lit(1.0).alias("r")) for i in range(d)]
    for i, j in pairs:
        for a, b in ((i, j), (j, i)):
            cells.append(F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), F.col(f"r_{i}_{j}").alias("r")))
    return wide.select(*by, F.explode(F.array(*cells)).alias("c")).select(*by, "c.i", "c.j", "c.r")


def _corr(a: str, b: str) -> Column:
    """corr over complete pairs; NULL when one side does not vary."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    varies = (F.min(F.when(both, F.col(a))) != F.max(F.when(both, F.col(a)))) & (
        F.min(F.when(both, F.col(b))) != F.max(F.when(both, F.col(b)))
    )
    return F.when(varies, F.corr(a, b))


def corr_matrix_vectors(df: DataFrame, vector: str) -> DataFrame:
    """Correlations of an array column, d x d result only on the driver."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Correlation

    m = Correlation.corr(df.select(array_to_vector(F.col(vector)).alias("v")), "v").first()[0].toArray()
    rows = [(i, j, float(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1])]
    return df.sparkSession.createDataFrame(rows, "i int, j int, r double")


def corr_summary(matrix: DataFrame, by: Sequence[str]) -> DataFrame:
    off = matrix.filter(F.col("i") != F.col("j")).withColumn("a", F.abs("r"))
    # d*(d-1) values per group: small by construction, so the built-in percentile is fine here.
    return off.groupBy(*by).agg(
        F.avg("a").alias("mean_abs"),
        F.expr("percentile_disc(0.5) within group (order by a)").alias("median_abs"),
        F.max("a").alias("max_abs"),
    )


def target_corr(df: DataFrame, features: Sequence[str], target: str, by: Sequence[str]) -> DataFrame:
    wide = df.groupBy(*by).agg(*[_corr(f, target).alias(f"{f}__r") for f in features])
    return _unpack(wide, by, features, ["r"])


def target_corr_summary(corr: DataFrame, by: Sequence[str]) -> DataFrame:
    a = F.abs("r")
    return corr.groupBy(*by).agg(F.avg(a).alias("mean_abs"), F.stddev_samp(a).alias("std_abs"), F.max(a).alias("max_abs"))


def class_balance(df: DataFrame, label: str, by: Sequence[str]) -> DataFrame:
    counts = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*by).agg(F.sum("n").alias("n_all"))
    share = attach(counts, totals, by) if by else counts.withColumn("n_all", F.lit(counts.agg(F.sum("n")).first()[0]))
    p = F.col("n") / F.col("n_all")
    clamped = F.greatest(p, F.lit(1e-10))
    return share.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_classes"),
        F.min(p).alias("min_ratio"),
        F.max(p).alias("max_ratio"),
        F.sum(-clamped * F.log2(clamped)).alias("entropy"),
    )


def class_ratios(df: DataFrame, label: str, by: Sequence[str]) -> DataFrame:
    counts = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
    totals = fit(df, by, [F.count(F.lit(1)).alias("n_all")])
    return attach(counts, totals, by).select(*by, label, "n", (F.col("n") / F.col("n_all")).alias("ratio"))


def target_stats(df: DataFrame, target: str, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(
        F.avg(target).alias("mean"),
        F.stddev_samp(target).alias("std"),
        F.min(target).alias("min"),
        F.max(target).alias("max"),
        skew_sample_std(target).alias("skew"),
        kurt_sample_std(target).alias("kurt"),
    )


def dataset_shape(df: DataFrame, features: Sequence[str], by: str) -> DataFrame:
    per = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(
        F.sum("n").alias("n_rows"), F.lit(len(features)).alias("n_features"), F.count(F.lit(1)).alias("n_datasets")
    )


def delta_histogram(df: DataFrame, cols: Sequence[str], by: Sequence[str], bins: int = 30) -> DataFrame:
    """Equal-width histogram of each column: (by, feat, bin, n); the last bin is closed."""
    from flipside.operators.plausibility import histogram_bin

    bounds = fit(df, by, [a(c).alias(f"{n}_{i}") for i, c in enumerate(cols) for n, a in (("lo", F.min), ("hi", F.max))])
    cells = attach(df, bounds, by)

    def bin_of(i: int, c: str) -> Column:
        return histogram_bin(F.col(c), F.col(f"lo_{i}"), F.col(f"hi_{i}"), bins)

    tagged = F.explode(F.array(*[F.struct(F.lit(i).alias("feat"), bin_of(i, c).alias("bin")) for i, c in enumerate(cols)]))
    return (
        cells.select(*by, tagged.alias("c"))
        .filter(F.col("c.bin").isNotNull())
        .groupBy(*by, F.col("c.feat").alias("feat"), F.col("c.bin").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


