"""Table shapes shared by the operators, and the check done at the door."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEYS = ["dataset_id", "row_id"]

PAIR_TABLE = T.StructType(
    [
        T.StructField("dataset_id", T.StringType()),
        T.StructField("row_id", T.LongType()),
        T.StructField("x_f", T.ArrayType(T.DoubleType())),
        T.StructField("x_cf", T.ArrayType(T.DoubleType())),
        T.StructField("y_f", T.DoubleType()),
        T.StructField("y_cf", T.DoubleType()),
        T.StructField("y_f_class", T.IntegerType()),
        T.StructField("y_cf_class", T.IntegerType()),
        T.StructField("label_flipped", T.BooleanType()),
        T.StructField("mask", T.ArrayType(T.BooleanType())),
        T.StructField("delta", T.ArrayType(T.DoubleType())),
    ]
)

PREDICTION_TABLE = T.StructType(
    [
        T.StructField("method", T.StringType()),
        T.StructField("max_time", T.IntegerType()),
        T.StructField("split", T.IntegerType()),
        T.StructField("dataset_id", T.StringType()),
        T.StructField("eval_pos", T.IntegerType()),
        T.StructField("row_id", T.LongType()),
        T.StructField("y", T.IntegerType()),
        T.StructField("probs", T.ArrayType(T.DoubleType())),
        T.StructField("time_s", T.DoubleType()),
    ]
)

SCORE_TABLE = T.StructType(
    [
        T.StructField("method", T.StringType()),
        T.StructField("max_time", T.IntegerType()),
        T.StructField("split", T.IntegerType()),
        T.StructField("dataset_id", T.StringType()),
        T.StructField("eval_pos", T.IntegerType()),
        T.StructField("metric", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)

RUN_RESULT = T.StructType(
    [
        T.StructField(
            "config",
            T.StructType(
                [
                    T.StructField("name", T.StringType()),
                    T.StructField("epochs", T.IntegerType()),
                    T.StructField("steps_per_epoch", T.IntegerType()),
                    T.StructField("batch_size", T.IntegerType()),
                    T.StructField("seq_len", T.IntegerType()),
                    T.StructField("num_features", T.IntegerType()),
                    T.StructField("loss_type", T.StringType()),
                ]
            ),
        ),
        T.StructField("scm_config", T.MapType(T.StringType(), T.StringType())),
        T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField(
            "training",
            T.StructType(
                [
                    T.StructField("initial_loss", T.DoubleType()),
                    T.StructField("final_loss", T.DoubleType()),
                    T.StructField("best_loss", T.DoubleType()),
                    T.StructField("best_epoch", T.IntegerType()),
                    T.StructField("loss_reduction", T.DoubleType()),
                    T.StructField("total_time_seconds", T.DoubleType()),
                ]
            ),
        ),
        T.StructField(
            "training_log",
            T.ArrayType(T.StructType([T.StructField("epoch", T.IntegerType()), T.StructField("loss", T.DoubleType())])),
        ),
        T.StructField("context_ablation", T.MapType(T.StringType(), T.DoubleType())),
    ]
)


def check_row_table(df: DataFrame, features: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Fail early when keys are missing or a feature column is not numeric."""
    types = dict(df.dtypes)
    missing = [c for c in [*keys, *features] if c not in types]
    if missing:
        raise ValueError(f"row table lacks columns {missing}")
    numeric = ("double", "float", "int", "bigint", "smallint", "tinyint", "decimal")
    bad = [c for c in features if not types[c].startswith(numeric)]
    if bad:
        raise ValueError(f"feature columns must be numeric: {bad}")
    return df


def to_pair_table(pairs: DataFrame, features: Sequence[str]) -> DataFrame:
    """Pack the wide pair columns (f, cf_f, m_f, d_f) into the array form."""
    return pairs.select(
        "dataset_id",
        "row_id",
        F.array(*[F.col(f) for f in features]).alias("x_f"),
        F.array(*[F.col(f"cf_{f}") for f in features]).alias("x_cf"),
        "y_f",
        "y_cf",
        F.col("y_f_class").cast("int").alias("y_f_class"),
        F.col("y_cf_class").cast("int").alias("y_cf_class"),
        "label_flipped",
        F.array(*[F.col(f"m_{f}") for f in features]).alias("mask"),
        F.array(*[F.col(f"d_{f}") for f in features]).alias("delta"),
    )
