"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flipside.session import checkpoint_dir, shuffle_files_released

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder that driver and executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/flipside-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table in the shared folder: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    with shuffle_files_released(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is.

    lower() does the same to pure ASCII text at a third of the cost.
    """
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo `folds` (a missing id counts as '')."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def numbered(df: DataFrame, by: Sequence[str], spread: Sequence[Column], order: Sequence[Column], parts: int, name: str) -> DataFrame:
    """Gapless 0-based number `name` of each row in its group `by` (columns without nulls).

    Groups are cut into `parts` hash parts; the parts' row counts give their
    first numbers and a window numbers the rows inside one part, so no group
    meets in one task.  Only rows equal in `spread` must share a part.
    """
    part = f"__part_{name}"
    cut = df.withColumn(part, F.pmod(F.xxhash64(*spread), F.lit(max(1, parts))))
    counts = cut.groupBy(*by, part).agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(*by).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    first = counts.select(*by, part, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    inside = W.partitionBy(*by, part).orderBy(*order)
    out = cut.join(first, [*by, part]).withColumn(name, (F.col("__first") + F.row_number().over(inside) - 1).cast("long"))
    return out.drop(part, "__first")
