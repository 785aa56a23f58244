"""Dataset catalog: profiling, filtering, capping and de-duplicating suites."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flipside.functions.fitted import attach, drop_params, fit, materialise
from flipside.functions.keyed import text_uniform01, uniform01
from flipside.functions.stats import total
from flipside.functions.ranks import BUCKET, group_buckets, long_form, positions, running_totals, shuffled_positions, value_buckets

# The seed of the loading shuffle and the class kept first past the cap.
LOAD_SEED = 13
CLASS_CUT = 10
# Catalog columns that make two datasets the same.
SIGNATURE = [
    "majority",
    "max_nominal",
    "minority",
    "n_classes",
    "n_features",
    "n_instances",
    "n_rows_missing",
    "n_missing",
    "n_numeric",
    "n_symbolic",
]


def autocorrelation(df: DataFrame, label: str, by: str = "dataset_id", key: str = "row_id") -> DataFrame:
    """(dataset, autocorrelation): the share of consecutive rows, in key order, whose labels are equal.

    Rows without a label are left out; a dataset with fewer than two others has
    NULL.  The order is cut into buckets; labels are compared inside a bucket,
    and each bucket hands its last label to the next one of its dataset.
    """
    rows = df.select(by, key, F.col(label).alias("__y")).filter("__y is not null")
    inside = W.partitionBy(by, BUCKET).orderBy(key)
    same = value_buckets(rows, key).withColumn("__same", (F.col("__y") == F.lag("__y").over(inside)).cast("long"))
    ends = same.groupBy(by, BUCKET).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("__same"), F.lit(0)).alias("same"), F.min_by("__y", key).alias("first"), F.max_by("__y", key).alias("last")
    )
    border = F.col("first") == F.lag("last").over(W.partitionBy(by).orderBy(BUCKET))
    out = ends.withColumn("same", F.col("same") + F.coalesce(border.cast("long"), F.lit(0))).groupBy(by).agg(F.sum("n").alias("n"), F.sum("same").alias("same"))
    return out.select(by, F.when(F.col("n") > 1, F.col("same") / (F.col("n") - 1)).alias("autocorrelation"))


def stump_auc(df: DataFrame, features: Sequence[str], label: str, by: str = "dataset_id", max_classes: int = CLASS_CUT) -> DataFrame:
    """(dataset, stump_auc): the best AUC that one threshold on one feature reaches.

    A split scores class c against the rest with 1/2 + |share of c below - share
    of the others below| / 2; classes weigh by their rows.  Missing values lie
    below all others.  Datasets with one class, or more than `max_classes`, have
    NULL.  Equal values are merged first, then one pass of running totals, one
    per class, judges every threshold of every feature.
    """
    rows = df.select(by, *features, F.col(label).alias("__y")).filter("__y is not null")
    classes = rows.groupBy(by, "__y").agg(F.count(F.lit(1)).alias("__n"))
    sizes = classes.groupBy(by).agg(F.count(F.lit(1)).alias("__k"))
    few = classes.join(sizes.filter(F.col("__k").between(2, max_classes)), by)
    codes = materialise(few.select(by, "__y", (F.row_number().over(W.partitionBy(by).orderBy("__y")) - 1).alias("__c")))
    cells = long_form(rows.join(codes, [by, "__y"]), [by], features, ["__c"])
    keys = [by, "feat"]
    value = F.coalesce("value", F.lit(float("-inf"))).alias("value")
    distinct = cells.groupBy(*keys, value).agg(*[F.sum((F.col("__c") == c).cast("long")).alias(f"n{c}") for c in range(max_classes)])
    run = running_totals(group_buckets(distinct, keys, "value"), keys, [F.col("value")], {f"n{c}": F.col(f"n{c}") for c in range(max_classes)})
    below = total([F.col(f"run_n{c}") for c in range(max_classes)])
    rows_all = total([F.col(f"all_n{c}") for c in range(max_classes)])

    def weighed(c: int) -> Column:
        own, hit = F.col(f"all_n{c}"), F.col(f"run_n{c}")
        return F.when(own > 0, F.abs(hit / own - (below - hit) / (rows_all - own)) * own).otherwise(0.0)

    split = F.lit(0.5) + total([weighed(c) for c in range(max_classes)]) / (rows_all * 2.0)
    best = run.select(by, split.alias("auc")).groupBy(by).agg(F.max("auc").alias("stump_auc"))
    return sizes.select(by).join(best, by, "left")


def dataset_profile(df: DataFrame, features: Sequence[str], label: str, by: str = "dataset_id", symbolic: Sequence[str] = (), key: str | None = None) -> DataFrame:
    """One catalog row per dataset.

    Counting by (dataset, label) first keeps the shuffle to one row per class
    and map task.  With a `key` that orders the rows the catalog also holds
    `autocorrelation` and `stump_auc`.
    """
    if key is not None:
        plain = dataset_profile(df, features, label, by, symbolic)
        return plain.join(autocorrelation(df, label, by, key), by, "left").join(stump_auc(df, features, label, by), by, "left")
    holes = [F.col(f).isNull().cast("long") for f in features]
    missing = holes[0]
    for h in holes[1:]:
        missing = missing + h
    nominal = df.groupBy(by).agg(*[F.count_distinct(c).alias(f"__v{i}") for i, c in enumerate(symbolic)]) if symbolic else None
    per_class = df.groupBy(by, label).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(missing).alias("cells"),
        F.sum((missing > 0).cast("long")).alias("rows"),
    )
    has_label = F.col(label).isNotNull()
    out = per_class.groupBy(by).agg(
        F.sum("n").alias("n_instances"),
        F.lit(len(features)).alias("n_features"),
        F.lit(len(symbolic)).alias("n_symbolic"),
        F.lit(len(features) - len(symbolic)).alias("n_numeric"),
        F.sum("cells").alias("n_missing"),
        F.sum("rows").alias("n_rows_missing"),
        F.sum(has_label.cast("long")).alias("n_classes"),
        F.min(F.when(has_label, F.col("n"))).alias("minority"),
        F.max(F.when(has_label, F.col("n"))).alias("majority"),
    )
    if nominal is None:
        return out.withColumn("max_nominal", F.lit(0).cast("long"))
    most = F.greatest(F.lit(0).cast("long"), *[F.col(f"__v{i}") for i in range(len(symbolic))])
    return out.join(nominal, by).withColumn("max_nominal", most).drop(*[f"__v{i}" for i in range(len(symbolic))])


def catalog_filter(catalog: DataFrame, min_samples: int = 100, max_samples: int | None = None, max_features: int | None = 100, max_classes: int | None = 10, without_missing: bool = False) -> DataFrame:
    cond = F.col("n_instances") >= min_samples
    if max_samples is not None:
        cond = cond & (F.col("n_instances") <= max_samples)
    if max_features is not None:
        cond = cond & (F.col("n_features") <= max_features)
    if max_classes is not None:
        cond = cond & (F.col("n_classes") <= max_classes)
    if without_missing:
        cond = cond & (F.col("n_rows_missing") == 0)
    return catalog.filter(cond)


def apply_caps(df: DataFrame, features: Sequence[str], label: str, max_samples: int, max_features: int, max_classes: int, by: str = "dataset_id", key: str = "row_id", categorical: Sequence[int] = ()) -> tuple[DataFrame, list[int], DataFrame]:
    """First rows after the keyed shuffle, first columns, first classes.

    Returns (rows, categorical indices kept, flags per dataset).
    """
    kept = list(features)[:max_features]
    unit = uniform01(LOAD_SEED, F.col(key))
    shuffled = shuffled_positions(df, [by], unit, key)
    rows = shuffled.filter(F.col("pos") < max_samples)
    classes = materialise(
        rows.groupBy(by, label)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            by,
            label,
            (F.dense_rank().over(W.partitionBy(by).orderBy(label)) - 1).alias("__place"),
            F.count(F.lit(1)).over(W.partitionBy(by)).alias("__k"),
            F.sum("n").over(W.partitionBy(by)).alias("__rows"),
        )
    )
    flags = classes.groupBy(by).agg(
        (F.max("__rows") == max_samples).alias("samples_capped"),
        F.lit(len(features) > max_features).alias("feats_capped"),
        (F.max("__k") > max_classes).alias("classes_capped"),
    )
    tagged = rows.join(classes, [by, label])
    capped = tagged.filter((F.col("__k") <= max_classes) | (F.col("__place") < CLASS_CUT))
    dropped = [f for f in features if f not in kept]
    return (
        capped.drop("__place", "__k", "__rows", "pos_of", *dropped),
        [c for c in categorical if c < max_features],
        flags,
    )


def catalog_dedup(catalog: DataFrame, signature: Sequence[str] = tuple(SIGNATURE), order: str = "did", name: str = "name") -> DataFrame:
    """Keep the first dataset of each metadata signature, then of each name."""
    out = catalog
    for i, keys in enumerate((list(signature), [name])):
        first = W.partitionBy(*keys).orderBy(order)
        out = out.withColumn(f"__r{i}", F.row_number().over(first)).filter(F.col(f"__r{i}") == 1).drop(f"__r{i}")
    return out


def cfi_key() -> Column:
    return F.concat_ws("_", "n_classes", "n_features", "n_instances")


def catalog_exclude(catalog: DataFrame, other: DataFrame, substrings: Sequence[str] = (), ids: Sequence[int] = (), name: str = "name", id_col: str = "did") -> DataFrame:
    """Drop datasets the other suite already has (by name or by class/feature/
    instance counts), names with unwanted parts, and listed ids."""
    out = catalog.withColumn("cfi", cfi_key())
    taken = other.withColumn("cfi", cfi_key())
    out = out.join(taken.select(name), name, "left_anti").join(taken.select("cfi"), "cfi", "left_anti")
    for part in substrings:
        out = out.filter(~F.col(name).contains(part))
    return out.filter(~F.col(id_col).isin(list(ids))) if ids else out


def class_skew_filter(catalog: DataFrame, min_ratio: float = 0.05) -> DataFrame:
    """Keep datasets whose minority class is not too rare; drop the ones whose
    autocorrelation or stump AUC is exactly 1, where the profile computed them."""
    out = catalog.filter(F.col("minority") / F.col("majority") > min_ratio)
    for c in ("autocorrelation", "stump_auc"):
        if c in catalog.columns:
            out = out.filter(F.col(c).isNull() | (F.col(c) != 1))
    return out


def restrict_binary(df: DataFrame, label: str = "y") -> DataFrame:
    return df.filter(F.col(label) < 2)


def balanced_interleave(df: DataFrame, label: str, by: str = "dataset_id", key: str = "row_id", name: str = "pos") -> DataFrame:
    """Alternate the two classes of a binary dataset, as many rows of each as
    the rarer class has; `name` is the 0-based place in the result.

    Rows sort majority first, then by key; the last 2*m rows stay, the two
    halves are taken in turn and the whole is reversed.
    """
    sizes = fit(
        df,
        [by],
        [
            F.sum((F.col(label) == 1).cast("long")).alias("__ones"),
            F.count(F.lit(1)).alias("__all"),
        ],
    )
    ranked = attach(positions(df, [by, label], key, "__i"), sizes, [by])
    minority = F.when(F.col("__ones") * 2 < F.col("__all"), F.lit(1)).otherwise(F.lit(0))
    m = F.least(F.col("__ones"), F.col("__all") - F.col("__ones"))
    rare = F.col(label) == minority
    # The majority keeps its last m rows, so its places count from there.
    half = F.when(rare, F.col("__i")).otherwise(F.col("__i") - (F.col("__i_of") - m))
    spot = F.when(rare, half * 2 + 1).otherwise(half * 2)
    out = ranked.withColumns({"__h": half, name: m * 2 - 1 - spot}).filter((F.col("__h") >= 0) & (F.col("__h") < m))
    return drop_params(out, sizes, [by]).drop("__i", "__i_of", "__h")


def order_by_label(df: DataFrame, label: str, by: str = "dataset_id", key: str = "row_id", seed: int = LOAD_SEED, name: str = "pos") -> DataFrame:
    """Sort by label (direction drawn per dataset), cut in two halves, take them in turn.

    The label is an integer code; ties are broken by the key.
    """
    per = df.groupBy(by, label).agg(F.count(F.lit(1)).alias("n"))
    down = text_uniform01(seed, F.col(by), "direction") < 0.5
    order = F.when(down, -F.col(label)).otherwise(F.col(label))
    w = W.partitionBy(by).orderBy("__o")
    starts = materialise(
        per.withColumn("__o", order).select(
            by,
            label,
            (F.sum("n").over(w) - F.col("n")).alias("__start"),
            F.sum("n").over(W.partitionBy(by)).alias("__n"),
        )
    )
    out = positions(df, [by, label], key, "__i").join(starts, [by, label])
    i = F.col("__start") + F.col("__i")
    half = F.floor(F.col("__n") / 2)
    # An odd row out goes last, as a reshape into two halves needs an even count.
    spot = F.when(i < half, i * 2).when(i < half * 2, (i - half) * 2 + 1).otherwise(i)
    return out.withColumn(name, spot.cast("long")).drop("__i", "__i_of", "__start", "__n")


def capped_name_suffix(name: Column) -> Column:
    flags = F.concat(
        *[F.when(F.col(c), F.lit(t)).otherwise(F.lit("")) for c, t in (("samples_capped", "s"), ("feats_capped", "f"), ("classes_capped", "c"))]
    )
    return F.when(F.length(flags) == 0, name).otherwise(F.concat(name, F.lit(" ["), flags, F.lit("]")))
