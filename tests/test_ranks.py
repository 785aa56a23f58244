"""The bucketed path gives the same answers as plain windows, whatever the partitioning."""

import numpy as np
from pyspark.sql import functions as F

from flipside.functions.ranks import exact_quantiles, peer_ranks, positions, running_totals, shuffled_positions, value_buckets
from flipside.functions.keyed import uniform01
from flipside.operators import metrics, plausibility, transforms


def skewed(spark, n=3000):
    """Two groups; one value and one group hold well over a third of the rows."""
    return spark.range(n).select(
        F.col("id").alias("row_id"),
        F.when(F.col("id") % 10 < 8, "hot").otherwise("cold").alias("dataset_id"),
        F.when(F.col("id") % 5 < 2, F.lit(7.0)).otherwise(F.round(uniform01(F.col("id")) * 100, 2)).alias("x"),
    )


def test_quantiles(spark):
    df = skewed(spark)
    rows = df.toPandas()
    probs = [0.0, 0.05, 0.5, 0.9, 1.0]
    got = {r["dataset_id"]: r for r in exact_quantiles(df, ["dataset_id"], ["x"], probs).collect()}
    low = {r["dataset_id"]: r for r in exact_quantiles(df, ["dataset_id"], ["x"], [0.5], "lower").collect()}
    for ds, g in rows.groupby("dataset_id"):
        x = np.sort(g["x"].to_numpy())
        np.testing.assert_allclose([got[ds][f"x_q{i}"] for i in range(5)], np.quantile(x, probs))
        assert low[ds]["x_q0"] == x[(len(x) - 1) // 2]


def test_positions_agree_across_partitions(spark):
    df = skewed(spark)
    a = positions(df.repartition(8), ["dataset_id"], "row_id").select("row_id", "pos", "pos_of")
    s = shuffled_positions(df.coalesce(1), ["dataset_id"], uniform01(3, F.col("row_id")), "row_id").select("row_id", "pos")
    large, large_s = sorted(a.collect()), sorted(s.collect())
    b = positions(df.coalesce(1), ["dataset_id"], "row_id").select("row_id", "pos", "pos_of")
    t = shuffled_positions(df.repartition(5), ["dataset_id"], uniform01(3, F.col("row_id")), "row_id").select("row_id", "pos")
    assert large == sorted(b.collect())
    assert large_s == sorted(t.collect())


def test_running_totals_without_groups(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("w"))
    out = running_totals(value_buckets(df, "id"), [], [F.col("id")], {"w": F.col("w")}).orderBy("id").collect()
    want = np.cumsum([i % 7 for i in range(1000)])
    assert [r["run_w"] for r in out] == want.tolist()
    assert {r["all_w"] for r in out} == {int(want[-1])}


def test_positions_have_no_single_partition_exchange(spark):
    df = spark.range(1000).select("id")
    plan = positions(df, [], "id")._jdf.queryExecution().executedPlan().toString()
    # The bucket totals may meet in one place; the rows may not.
    assert "hashpartitioning(__bucket" in plan


def test_auc_and_ks_and_ranking(spark):
    df = skewed(spark).withColumn("y", (F.col("row_id") % 3 == 0).cast("int"))
    got = {r["dataset_id"]: r["auc"] for r in metrics.auc(df, ["dataset_id"], F.col("y") == 1, F.col("x")).collect()}
    pdf = df.toPandas()
    for ds, g in pdf.groupby("dataset_id"):
        p, n = g[g.y == 1].x.to_numpy(), g[g.y == 0].x.to_numpy()
        gap = p[:, None] - n[None, :]
        assert abs(got[ds] - ((gap > 0).mean() + 0.5 * (gap == 0).mean())) < 1e-12
    pairs = df.withColumn("cf_x", F.col("x") + F.when(F.col("y") == 1, 5.0).otherwise(0.0))
    ks = {r["dataset_id"]: r["ks"] for r in plausibility.ks_2samp(pairs, ["x"], ["dataset_id"]).collect()}
    for ds, g in pairs.toPandas().groupby("dataset_id"):
        grid = np.union1d(g.x, g.cf_x)
        f1 = np.searchsorted(np.sort(g.x), grid, side="right") / len(g)
        f2 = np.searchsorted(np.sort(g.cf_x), grid, side="right") / len(g)
        assert abs(ks[ds] - np.abs(f1 - f2).max()) < 1e-12
    rank = transforms.to_ranking(df, ["x"], ["dataset_id"], "row_id").toPandas()
    for ds, g in rank.groupby("dataset_id"):
        x = np.sort(g.value)
        assert (np.searchsorted(x, g.value, side="right") == g["rank"]).all()


def test_many_and_unordered_quantiles_with_heavy_ties(spark):
    df = skewed(spark).withColumn("y", F.when(F.col("row_id") % 3 > 0, F.floor(F.col("x")))).withColumn("none", F.lit(None).cast("double"))
    probs = [0.5, 0.99, 0.0, 0.013, 1.0, *[i / 98 for i in range(99)]]
    rows = df.toPandas()
    got = {r["dataset_id"]: r for r in exact_quantiles(df, ["dataset_id"], ["x", "y", "none"], probs).collect()}
    low = {r["dataset_id"]: r for r in exact_quantiles(df, ["dataset_id"], ["y"], probs, "lower").collect()}
    for ds, g in rows.groupby("dataset_id"):
        for c in ("x", "y"):
            np.testing.assert_allclose([got[ds][f"{c}_q{i}"] for i in range(len(probs))], np.nanquantile(g[c].astype(float), probs))
        y = np.sort(g["y"].dropna().to_numpy(float))
        assert [low[ds][f"y_q{i}"] for i in range(len(probs))] == [y[max(0, int(np.ceil(p * len(y))) - 1)] for p in probs]
        assert all(got[ds][f"none_q{i}"] is None for i in range(len(probs)))
    whole = exact_quantiles(df, [], ["x"], [0.25]).first()
    assert abs(whole["x_q0"] - np.quantile(rows["x"], 0.25)) < 1e-12


def test_frequent_values_are_ranked_in_many_tasks(spark):
    """A third and more of the rows share a value; no task of the ranking reads over twice what the median task reads."""
    df = spark.range(60_000).select(F.col("id"), F.when(F.col("id") % 5 < 2, F.lit(7.0)).otherwise(uniform01(F.col("id")) * 100).alias("x"))
    out = peer_ranks(df, [], "x", "id", buckets=32)
    rows = out.toPandas()
    x = np.sort(rows["x"])
    assert (np.searchsorted(x, rows["x"], side="right") == rows["rank"]).all()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = sorted(r[1] for r in peer_ranks(df, [], "x", "id", buckets=256).groupBy(F.spark_partition_id()).count().collect())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) >= 8 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
