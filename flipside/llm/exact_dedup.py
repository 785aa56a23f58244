"""Exact dedup by skew-safe combining, in DataFrame operations only.

Copies are merged inside each task first, then per (salt, digest) group, and
the salts' winners are combined globally.  Every merge groups by digest *and*
full normalised text, so equal digests of different texts never merge.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flipside.llm.common import ascii_lower, written

SALTS = 64


def normal_text(text: Column) -> Column:
    """Null counts as empty; only A-Z are lower-cased."""
    return ascii_lower(F.coalesce(text, F.lit("")))


def sha256(norm: Column) -> Column:
    return F.sha2(norm, 256)


def _rows(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), normal_text(F.col("text")).alias("norm")).withColumn(
        "digest", digest(F.col("norm"))
    )


def text_groups(docs: DataFrame, digest: Callable[[Column], Column] = sha256, salts: int = SALTS) -> DataFrame:
    """One row per digest: keep_id, group_size and `texts`, the number of different texts under it."""
    rows = _rows(docs, digest).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    # The task's partial aggregate is the local stage: a task sends one row per different text.
    salted = rows.groupBy("digest", "salt", "norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # Dealt by digest alone, both groupings below need no further exchange.
    winners = salted.repartition("digest").groupBy("digest", "norm").agg(
        F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")
    )
    return winners.groupBy("digest").agg(
        F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.count(F.lit(1)).alias("texts")
    )


def exact_dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256, salts: int = SALTS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of `docs`.

    Reads doc_id and text only.  Of equal texts the row with the largest doc_id
    stays; a missing id is smaller than any other.  Of repeated rows (same id
    and text) one stays.  An empty table gives an empty table.
    """
    groups = written(text_groups(docs, digest, salts), "dedup-groups")
    rows = _rows(docs, digest)
    head = ["doc_id", "digest", F.sha2("norm", 256).alias("text_sha256")]
    single = groups.filter("texts = 1").select("digest", "keep_id", "group_size")
    out = rows.select(*head).join(single, "digest").drop("digest")
    clashing = groups.filter("texts > 1").select("digest")
    if not clashing.isEmpty():
        part = rows.join(clashing, "digest", "left_semi")
        whole = part.groupBy("digest", "norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        out = out.unionByName(part.join(whole, ["digest", "norm"]).select("doc_id", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size"))
    repeat = F.row_number().over(W.partitionBy("text_sha256", "doc_id").orderBy(F.lit(1)))
    return out.withColumn("__repeat", repeat).select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("__repeat") == 1)).alias("kept"), "text_sha256"
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, with their columns."""
    kept = exact_dedup(docs).filter("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"))
    keyed = docs.withColumn("__sha_of", F.sha2(normal_text(F.col("text")), 256))
    met = keyed.join(kept.hint("shuffle_hash"), F.col("__id").eqNullSafe(F.col("doc_id").cast("long")) & (F.col("__sha_of") == F.col("__sha")))
    again = F.row_number().over(W.partitionBy("__id", "__sha").orderBy(F.lit(1)))
    return met.withColumn("__again", again).filter("__again = 1").select(*docs.columns)
