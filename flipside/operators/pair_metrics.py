"""Numbers about factual/counterfactual pairs and about predicted deltas.

Row-level measures are Column expressions over the wide pair columns
(f, cf_f, m_f, d_f; predictions p_f).  A NULL feature counts as unchanged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flipside.functions.ranks import exact_quantiles
from flipside.functions.stats import binary_cross_entropy_logit, sigmoid, total
from flipside.session import checkpointed

# Fixed values.
CHANGED = 1e-8
COS_FLOOR = 1e-8
NONTRIVIAL = 0.01
NEAR_ZERO = 0.05
TRUE_ZERO = 1e-6
PRED_ZERO = 0.1


def _diff(f: str) -> Column:
    return F.coalesce(F.col(f"cf_{f}") - F.col(f), F.lit(0.0))


def _z(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0.0))


def l2_norm(cols: Sequence[Column]) -> Column:
    return F.sqrt(total([c * c for c in cols]))


def validity(flipped: str = "label_flipped") -> list[Column]:
    hit = F.col(flipped).cast("long")
    return [
        F.avg(hit.cast("double")).alias("validity"),
        F.sum(hit).alias("n_valid"),
        F.sum(1 - hit).alias("n_invalid"),
        F.count(F.lit(1)).alias("n_total"),
    ]


DISTANCES = ["l1", "l2", "linf", "cosine", "changed_share"]


def pair_distances(pairs: DataFrame, features: Sequence[str]) -> DataFrame:
    d = [_diff(f) for f in features]
    dot = total([_z(f) * _z(f"cf_{f}") for f in features])
    na = l2_norm([_z(f) for f in features])
    nb = l2_norm([_z(f"cf_{f}") for f in features])
    cos = dot / (F.greatest(na, F.lit(COS_FLOOR)) * F.greatest(nb, F.lit(COS_FLOOR)))
    return pairs.withColumns(
        {
            "l1": total([F.abs(x) for x in d]),
            "l2": l2_norm(d),
            "linf": F.greatest(*[F.abs(x) for x in d]) if len(d) > 1 else F.abs(d[0]),
            "cosine": F.when(F.isnan(cos), F.lit(1.0)).otherwise(cos),
            "changed_share": total([(F.abs(x) > CHANGED).cast("double") for x in d]) / F.lit(float(len(features))),
        }
    )


def proximity(measured: DataFrame, by: Sequence[str], valid_only: bool = False, more: Sequence[Column] = ()) -> DataFrame:
    """Mean, sample deviation (0 for one pair) and lower median of each distance.

    Groups without any pair get zeros.  `more` are further aggregates of the
    same rows; all of them share the pass that brackets the medians.  The
    distances are kept as a table (with `more`, all columns that are given).
    """
    if not more:
        measured = measured.select(*by, *DISTANCES, *(["label_flipped"] if valid_only else []))
    measured = checkpointed(measured)
    rows = measured.filter("label_flipped") if valid_only else measured
    aggs = [*more, F.count(F.lit(1)).alias("num_pairs")]
    for c in DISTANCES:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"{c}_std")]
    out = exact_quantiles(rows, by, DISTANCES, [0.5], "lower", aggs).withColumnsRenamed({f"{c}_q0": f"{c}_median" for c in DISTANCES})
    if not by:
        return out
    if valid_only:
        out = measured.select(*by).distinct().join(out, list(by), "left")
    return out.na.fill(0)


def per_feature_mad(pairs: DataFrame, features: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Mean absolute change per feature, in long form (by, feat, mad)."""
    wide = pairs.groupBy(*by).agg(*[F.avg(F.abs(_diff(f))).alias(f) for f in features])
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("feat"), F.col(f).alias("mad")) for i, f in enumerate(features)]))
    return wide.select(*by, cells.alias("c")).select(*by, "c.feat", "c.mad")


def mad_summary(mad: DataFrame, by: Sequence[str]) -> DataFrame:
    return mad.groupBy(*by).agg(F.avg("mad").alias("mad_mean"), F.stddev_samp("mad").alias("mad_std"))


def proximity_ratio(measured: DataFrame, by: Sequence[str]) -> DataFrame:
    """L2 of valid pairs over L2 of all pairs; NULL without valid pairs."""
    return measured.groupBy(*by).agg(
        F.avg("l2").alias("l2_all"),
        F.avg(F.when(F.col("label_flipped"), F.col("l2"))).alias("l2_valid"),
        (F.avg(F.when(F.col("label_flipped"), F.col("l2"))) / F.avg("l2")).alias("l2_ratio"),
    )


def n_perturbed(features: Sequence[str]) -> Column:
    return total([F.col(f"m_{f}").cast("int") for f in features])


def features_perturbed(pairs: DataFrame, features: Sequence[str], by: Sequence[str]) -> DataFrame:
    n = n_perturbed(features).cast("double")
    valid = F.when(F.col("label_flipped"), n)
    return pairs.groupBy(*by).agg(
        F.avg(n).alias("mean_all"),
        F.stddev_samp(n).alias("std_all"),
        F.avg(valid).alias("mean_valid"),
        F.stddev_samp(valid).alias("std_valid"),
    )


def _cells(features: Sequence[str], of) -> Column:
    return total([of(f) for f in features])


def delta_mse(features: Sequence[str]) -> Column:
    return F.avg(_cells(features, lambda f: (F.col(f"p_{f}") - F.col(f"d_{f}")) * (F.col(f"p_{f}") - F.col(f"d_{f}"))) / len(features))


def pred_norm(features: Sequence[str]) -> Column:
    return l2_norm([F.col(f"p_{f}") for f in features])


def heuristic_validity(features: Sequence[str], limit: float = NONTRIVIAL) -> Column:
    return F.avg((pred_norm(features) > limit).cast("double"))


def pred_sparsity(features: Sequence[str], limit: float = NEAR_ZERO) -> Column:
    return F.avg(_cells(features, lambda f: (F.abs(F.col(f"p_{f}")) < limit).cast("double")) / len(features))


def sign_accuracy(features: Sequence[str], limit: float = TRUE_ZERO) -> Column:
    def counted(f: str) -> Column:
        return F.abs(F.col(f"d_{f}")) > limit

    right = _cells(features, lambda f: (counted(f) & ((F.col(f"p_{f}") > 0) == (F.col(f"d_{f}") > 0))).cast("double"))
    seen = _cells(features, lambda f: counted(f).cast("double"))
    return F.coalesce(F.try_divide(F.sum(right), F.sum(seen)), F.lit(-1.0))


def zero_feature_accuracy(features: Sequence[str], limit: float = PRED_ZERO) -> Column:
    def counted(f: str) -> Column:
        return F.abs(F.col(f"d_{f}")) < TRUE_ZERO

    right = _cells(features, lambda f: (counted(f) & (F.abs(F.col(f"p_{f}")) < limit)).cast("double"))
    seen = _cells(features, lambda f: counted(f).cast("double"))
    return F.coalesce(F.try_divide(F.sum(right), F.sum(seen)), F.lit(-1.0))


def eval_metrics(features: Sequence[str]) -> list[Column]:
    """All prediction measures as one aggregate (one pass over the rows)."""
    return [
        delta_mse(features).alias("delta_mse"),
        heuristic_validity(features).alias("validity_rate"),
        F.avg(pred_norm(features)).alias("proximity_mean"),
        F.stddev_samp(pred_norm(features)).alias("proximity_std"),
        pred_sparsity(features).alias("sparsity"),
        sign_accuracy(features).alias("sign_accuracy"),
        zero_feature_accuracy(features).alias("zero_feature_accuracy"),
        F.count(F.lit(1)).alias("num_query_points"),
    ]


def per_feature_mse(pairs: DataFrame, features: Sequence[str], by: Sequence[str]) -> DataFrame:
    wide = pairs.groupBy(*by).agg(
        *[F.avg((F.col(f"p_{f}") - F.col(f"d_{f}")) * (F.col(f"p_{f}") - F.col(f"d_{f}"))).alias(f) for f in features]
    )
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("feat"), F.col(f).alias("mse")) for i, f in enumerate(features)]))
    return wide.select(*by, cells.alias("c")).select(*by, "c.feat", "c.mse")


def masked_delta_loss(features: Sequence[str], weight: float) -> Column:
    """Squared error over the masked features plus weighted mask cross-entropy (logits g_f)."""
    mask = {f: F.col(f"m_{f}").cast("double") for f in features}
    err = _cells(features, lambda f: (F.col(f"p_{f}") - F.col(f"d_{f}")) * (F.col(f"p_{f}") - F.col(f"d_{f}")) * mask[f])
    count = F.greatest(total(list(mask.values())), F.lit(1.0))
    bce = _cells(features, lambda f: binary_cross_entropy_logit(F.col(f"g_{f}"), mask[f])) / len(features)
    return F.avg(err / count + F.lit(float(weight)) * bce)


def gaussian_nll(mu: Column, logvar: Column, target: Column, clamp: float = 10.0) -> Column:
    lv = F.greatest(F.least(logvar, F.lit(clamp)), F.lit(-clamp))
    return F.lit(0.5) * (lv + (target - mu) * (target - mu) / F.exp(lv))


def validity_objective(pred: DataFrame, features: Sequence[str], margin: Column, target: Column, by: Sequence[str], proximity_weight: float = 0.1, sparsity_weight: float = 0.01) -> DataFrame:
    """Mean over datasets of BCE(margin, target) + .1 mean L2 + .01 mean |delta|.

    `margin` is y_cf - threshold as a logit.
    """
    rows = pred.select(
        *by,
        binary_cross_entropy_logit(margin, target.cast("double")).alias("bce"),
        pred_norm(features).alias("norm"),
        (_cells(features, lambda f: F.abs(F.col(f"p_{f}"))) / len(features)).alias("size"),
    )
    per = rows.groupBy(*by).agg(
        F.avg("bce").alias("bce"), F.sum("norm").alias("norm"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")
    )
    return per.agg(
        (
            F.avg("bce")
            + F.lit(proximity_weight) * F.sum("norm") / F.sum("n")
            + F.lit(sparsity_weight) * F.sum("size") / F.sum("n")
        ).alias("objective"),
        F.avg("bce").alias("validity_loss"),
        (F.sum("norm") / F.sum("n")).alias("proximity_loss"),
        (F.sum("size") / F.sum("n")).alias("sparsity_loss"),
    )


def apply_predicted_mask(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Zero a predicted delta unless sigmoid(logit) > 0.5."""
    return df.withColumns(
        {f"p_{f}": F.when(sigmoid(F.col(f"g_{f}")) > 0.5, F.col(f"p_{f}")).otherwise(F.lit(0.0)) for f in features}
    )
