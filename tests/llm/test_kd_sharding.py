"""Even bytes, gapless slots, hot values."""

import zlib

from pyspark.sql import functions as F

from flipside.llm.kd_sharding import kd_shards
from tests.llm.helpers import ODD, docs, empty, rows_of


def test_bytes_are_near_equal_with_a_hot_source(spark):
    df = spark.range(20_000).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") * 7919 % 300).cast("int")).alias("text"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 9)).alias("source"), F.lit("en").alias("lang"),
    )
    got = kd_shards(df, 40)
    per = got.groupBy("shard").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"), F.max("slot").alias("m"), F.countDistinct("slot").alias("d")).collect()
    mean = sum(r["b"] for r in per) / 40
    assert len(per) == 40 and max(abs(r["b"] - mean) for r in per) < 0.02 * mean
    assert all(r["m"] + 1 == r["n"] == r["d"] for r in per)
    assert len({r["shard"] for r in kd_shards(df, target_bytes=1 << 19).collect()}) == round(mean * 40 / (1 << 19))


def test_odd_rows(spark):
    got = kd_shards(docs(spark, clash=True), 4)
    assert sorted((r["size"], r["text_crc32"]) for r in got.collect()) == sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t, *_ in ODD)
    assert rows_of(got) == rows_of(kd_shards(docs(spark).coalesce(1), 4))
    assert kd_shards(empty(spark), 40).count() == 0
    assert {r["shard"] for r in kd_shards(docs(spark), 1).collect()} == {0}


def test_rows_that_are_all_alike(spark):
    df = spark.createDataFrame([(1, "same", "en", "a", 4)] * 50, "doc_id long, text string, lang string, source string, n_chars long")
    got = kd_shards(df, 4).collect()
    assert len(got) == 50 and len({(r["shard"], r["slot"]) for r in got}) == 50
