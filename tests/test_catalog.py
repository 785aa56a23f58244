"""Autocorrelation across bucket borders and the best threshold, against plain loops."""

import numpy as np
from pyspark.sql import functions as F

from flipside.functions.ranks import count_below, group_buckets
from flipside.operators import catalog as B


def plain_auc(x, y):
    """Best one-threshold AUC of a dataset, missing values lowest."""
    best = 0.5
    names, n = np.unique(y, return_counts=True)
    for col in x.T:
        col = np.where(np.isnan(col), -np.inf, col)
        for t in np.unique(col):
            low = col <= t
            got = sum(k * abs(low[y == c].mean() - low[y != c].mean()) for c, k in zip(names, n) if k < len(y))
            best = max(best, 0.5 + got / (2 * len(y)))
    return best


def test_order_and_ease_against_loops(spark):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for name, n, classes in (("a", 400, 2), ("b", 300, 3), ("hot", 2000, 2), ("same", 50, 1), ("one", 1, 1), ("many", 60, 30), ("easy", 200, 2), ("sorted", 100, 2)):
        x = rng.normal(size=(n, 3)).round(1) * [1, 1000, 1e-3]
        x[rng.random((n, 3)) < 0.1] = np.nan
        y = rng.integers(0, classes, n)
        if name == "easy":
            y = (np.where(np.isnan(x[:, 1]), -np.inf, x[:, 1]) > 200).astype(int)
        if name == "sorted":
            y = np.arange(n) // 50
        want[name] = (np.mean(y[1:] == y[:-1]) if n > 1 else None, plain_auc(x, y) if 1 < len(set(y)) <= 10 else None)
        rows += [(name, i, *[None if np.isnan(v) else float(v) for v in r], f"c{c}") for i, (r, c) in enumerate(zip(x, y))]
    rows += [("a", 10_000, 1.0, 1.0, 1.0, None), ("unlabelled", 1, 1.0, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "dataset_id string, row_id long, f0 double, f1 double, f2 double, y string").repartition(5)
    got = {r["dataset_id"]: r for r in B.dataset_profile(df, ["f0", "f1", "f2"], "y", key="row_id").collect()}
    assert got["unlabelled"]["autocorrelation"] is None and got["unlabelled"]["stump_auc"] is None
    for name, (auto, auc) in want.items():
        for have, right in ((got[name]["autocorrelation"], auto), (got[name]["stump_auc"], auc)):
            assert (have is None) == (right is None) and (right is None or abs(have - right) < 1e-12), name
    assert got["easy"]["stump_auc"] == 1.0 and got["same"]["autocorrelation"] == 1.0
    kept = {r["dataset_id"] for r in B.class_skew_filter(B.dataset_profile(df, ["f0", "f1", "f2"], "y", key="row_id")).collect()}
    assert kept.isdisjoint({"easy", "same"}) and {"a", "b", "hot", "many"} <= kept


def test_group_buckets_follow_each_groups_own_scale(spark):
    df = spark.range(4000).select((F.col("id") % 2).alias("g"), (F.col("id") * F.when(F.col("id") % 2 == 0, 1e-6).otherwise(1e6)).alias("x"))
    sizes = group_buckets(df, ["g"], "x", 8).groupBy("g", "__bucket").count().collect()
    assert len(sizes) == 16 and max(r["count"] for r in sizes) < 400
    row = spark.createDataFrame([([1.0, 2.0, 2.0, 5.0], 2.0, 9.0, None, 0.0)], "a array<double>, x double, big double, none double, low double")
    both = [count_below(F.col("a"), F.col(c), 4, strict) for c in ("x", "big", "none", "low") for strict in (False, True)]
    assert list(row.select(*both).first()) == [3, 1, 4, 4, 0, 0, 0, 0]
