"""Averaging the predictions of shifted and transformed copies of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flipside.functions.keyed import key_hash
from flipside.functions.stats import softmax
from flipside.operators.transforms import rotate_features

# Fixed value: softmax temperature (exp(ln 0.8)).
TEMPERATURE = 0.8
TRANSFORMS = ["none", "power"]
SIZES = [1, 5, 10, 20, 50, 100]


def ensemble_grid(spark: SparkSession, n_classes: int, n_features: int, n: int, seed: int, transforms: Sequence[str] = TRANSFORMS) -> DataFrame:
    """First n of (class shift x feature shift, in keyed order) x transforms."""
    shifts = spark.range(n_classes * n_features).select(
        (F.col("id") % n_classes).cast("int").alias("class_shift"),
        F.floor(F.col("id") / n_classes).cast("int").alias("feature_shift"),
        key_hash(seed, F.col("id")).alias("__h"),
        "id",
    )
    top = shifts.orderBy("__h", "id").limit(n)
    # At most n rows are left, so one window over them is small.
    placed = top.withColumn("__r", F.row_number().over(W.orderBy("__h", "id")) - 1)
    kinds = F.posexplode(F.array(*[F.lit(t) for t in transforms])).alias("__t", "transform")
    out = placed.select("class_shift", "feature_shift", "__r", kinds)
    rank = (F.col("__r") * len(transforms) + F.col("__t")).cast("int")
    return out.select(rank.alias("config_rank"), "class_shift", "feature_shift", "transform").filter(F.col("config_rank") < n)


def shift_labels(label: Column, shift: Column | int, n_classes: int) -> Column:
    return F.pmod(label + shift, F.lit(n_classes))


def config_literals(configs: DataFrame) -> Column:
    """The configuration table as an array literal; it has the rows that `ensemble_grid` was asked for."""
    rows = configs.collect()
    return F.array(*[F.struct(*[F.lit(r[c]).alias(c) for c in configs.columns]) for r in rows])


def expand_config_rows(df: DataFrame, configs: DataFrame, variants: dict[str, str], label: str, n_classes: int) -> DataFrame:
    """Every row under every configuration.

    `variants` maps a transform name to the array column that holds it, so a
    transform is computed once per row and not once per configuration.
    """
    out = df.withColumn("__c", F.explode(config_literals(configs)))
    chosen = F.lit(None)
    for name, column in variants.items():
        chosen = F.when(F.col("__c.transform") == name, F.col(column)).otherwise(chosen)
    return out.withColumns(
        {
            "config_rank": F.col("__c.config_rank"),
            "x": rotate_features(chosen, F.col("__c.feature_shift")),
            "y_shifted": shift_labels(F.col(label), F.col("__c.class_shift"), n_classes),
        }
    ).drop("__c", *variants.values())


def class_aligned(logits: Column, shift: Column, average_logits: bool, temperature: float = TEMPERATURE) -> Column:
    """Un-rotate the class axis and apply the temperature; probabilities unless
    the logits themselves are to be averaged."""
    scaled = F.transform(rotate_features(logits, shift), lambda v: v / F.lit(temperature))
    return scaled if average_logits else softmax(scaled)


def ensemble_average(outputs: DataFrame, key: Sequence[str], n_classes: int, average_logits: bool = True, temperature: float = TEMPERATURE) -> DataFrame:
    """(key, config_rank, class_shift, logits) -> (key, probs): sum over the
    configurations divided by their number."""
    rows = outputs.withColumn("__p", class_aligned(F.col("logits"), F.col("class_shift"), average_logits, temperature))
    mean = rows.groupBy(*key).agg(F.array(*[F.avg(F.col("__p")[c]) for c in range(n_classes)]).alias("probs"))
    return mean.withColumn("probs", softmax(F.col("probs"))) if average_logits else mean


def predict_label(df: DataFrame, classes: Sequence) -> DataFrame:
    """First largest class and its probability."""
    best = F.array_max("probs")
    at = F.array_position(F.col("probs"), best).cast("int")
    names = F.array(*[F.lit(c) for c in classes])
    return df.withColumns({"label": F.element_at(names, at), "winning_prob": best})


def ensemble_size_sweep(outputs: DataFrame, key: Sequence[str], n_classes: int, sizes: Sequence[int] = SIZES, average_logits: bool = True, temperature: float = TEMPERATURE) -> DataFrame:
    """(key, size, probs) for the average of the first N configurations.

    All sizes come from one aggregate with one condition per size.
    """
    rows = outputs.withColumn("__p", class_aligned(F.col("logits"), F.col("class_shift"), average_logits, temperature))
    wide = rows.groupBy(*key).agg(
        *[
            F.array(*[F.avg(F.when(F.col("config_rank") < n, F.col("__p")[c])) for c in range(n_classes)]).alias(f"__{n}")
            for n in sizes
        ]
    )
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("size"), F.col(f"__{n}").alias("probs")) for n in sizes]))
    out = wide.select(*key, cells.alias("c")).select(*key, "c.size", "c.probs")
    return out.withColumn("probs", softmax(F.col("probs"))) if average_logits else out
