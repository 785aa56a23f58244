"""Held-out accuracy, calibration, and what a score may depend on."""

import numpy as np
from pyspark.sql import functions as F

from flipside.llm.kernel_quality import fit_quality, isotonic, keep_quality, score_quality, stats_table
from tests.llm.helpers import ODD, docs, empty, rows_of

SF = "/root/testdata/sf0.01"


def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_held_out_accuracy_and_clean_documents(spark):
    d, l = tables(spark)
    got = score_quality(d, l)
    assert got.count() == d.count() and got.filter("score < 0 or score > 1 or score is null").count() == 0
    held = got.filter("held_out").join(l, "doc_id")
    r = held.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double")).alias("a"), F.avg(F.when(F.col("quality") == 1, F.col("predicted"))).alias("good")).first()
    assert r["a"] > 0.95 and r["good"] > 0.98
    assert keep_quality(d, l).count() == got.filter("predicted = 1").count()
    assert keep_quality(d, l).columns == d.columns


def test_held_out_labels_and_other_columns_teach_nothing(spark):
    d, l = tables(spark)
    crc = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))
    turned = l.withColumn("quality", F.when(crc == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    moved = d.withColumns({"lang": F.lit("xx"), "source": F.lit("s")})
    a = {r["doc_id"]: r["score"] for r in score_quality(d, l).collect()}
    b = {r["doc_id"]: r["score"] for r in score_quality(moved, turned).collect()}
    assert max(abs(a[k] - b[k]) for k in a) < 1e-6


def test_normal_equations_do_not_depend_on_partitions(spark):
    d, l = tables(spark)
    a, b = fit_quality(stats_table(d.coalesce(1)), l), fit_quality(stats_table(d.repartition(9)), l)
    np.testing.assert_allclose(a.weights, b.weights, atol=1e-5)


def test_isotonic_like_brute_force():
    rng = np.random.default_rng(0)
    x, y, w = np.sort(rng.random(40)), rng.random(40), rng.integers(1, 5, 40).astype(float)
    c, m = isotonic(x, y, w)
    assert (np.diff(m) > 0).all() and (np.diff(c) > 0).all()
    # Max-min formula of the best rising fit.
    best = [max(min(np.average(y[i : j + 1], weights=w[i : j + 1]) for j in range(k, 40)) for i in range(k + 1)) for k in range(40)]
    np.testing.assert_allclose(sorted(set(np.round(best, 9))), np.round(m, 9))


def test_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, "z"), (2, 0, "z"), (2, 1, "z"), (None, 1, "z"), (9, None, "z"), (777, 0, "z")], "doc_id long, quality int, score string")
    got = score_quality(docs(spark, clash=True), labels)
    assert got.count() == len(ODD) and got.filter("score is null").count() == 0
    none = score_quality(docs(spark), labels.limit(0))
    assert {(r["score"], r["predicted"]) for r in none.collect()} == {(0.5, 1)}
    one = score_quality(docs(spark), labels.filter("doc_id = 1"))
    assert one.filter("score < 0 or score > 1").count() == 0
    assert score_quality(empty(spark), labels).count() == 0
    assert keep_quality(docs(spark, clash=True), labels).columns == docs(spark, clash=True).columns
    assert rows_of(keep_quality(empty(spark), labels)) == []
