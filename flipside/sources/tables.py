"""Reading row tables and changing between wide, long and array form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flipside.functions.ranks import long_form
from flipside.schema import check_row_table


def load_table(spark: SparkSession, path: str, key: str, features: Sequence[str], target: str | None = None, dataset: str | Column | None = None, categorical: Sequence[str] = (), fmt: str = "parquet", schema: T.StructType | str | None = None, **options) -> tuple[DataFrame, list[int]]:
    """Row table (dataset_id, row_id, features as DOUBLE, y) and the indices of
    the categorical features.  Only the named columns reach the scan."""
    reader = spark.read.format(fmt).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    raw = reader.load(path)
    ds = F.lit(path.rstrip("/").rsplit("/", 1)[-1].split(".")[0]) if dataset is None else (F.col(dataset) if isinstance(dataset, str) else dataset)
    out = raw.select(
        ds.cast("string").alias("dataset_id"),
        F.col(key).cast("long").alias("row_id"),
        *[F.col(f).cast("double").alias(f) for f in features],
        *([F.col(target).alias("y")] if target else []),
    )
    return check_row_table(out, features), [i for i, f in enumerate(features) if f in set(categorical)]


def wide_to_long(df: DataFrame, features: Sequence[str], keys: Sequence[str] = ("dataset_id", "row_id")) -> DataFrame:
    return long_form(df, list(keys), features)


def long_to_wide(df: DataFrame, features: Sequence[str], keys: Sequence[str] = ("dataset_id", "row_id")) -> DataFrame:
    """One aggregate with a column per feature: a row's cells meet in one entry, never one entry per cell."""
    return df.groupBy(*keys).agg(*[F.max(F.when(F.col("feat") == i, F.col("value"))).alias(f) for i, f in enumerate(features)])


def to_array_form(df: DataFrame, features: Sequence[str], keys: Sequence[str] = ("dataset_id", "row_id")) -> DataFrame:
    return df.select(*keys, F.array(*[F.col(f).cast("double") for f in features]).alias("features"))
