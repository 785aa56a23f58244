"""Work that grows with the rows is done once, whatever the number of passes over what comes out of it."""

import re
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from flipside.functions.ranks import exact_quantiles
from flipside.operators import metrics, perturb, plausibility, transforms
from flipside.operators.pair_metrics import DISTANCES, pair_distances, proximity
from flipside.plans.reports import sweep
from flipside.sources import tables


@pytest.fixture
def counted(spark):
    """A table whose rows are counted whenever they are made."""
    seen = spark.sparkContext.accumulator(0)

    def make(df):
        def count(batches):
            for pdf in batches:
                seen.add(len(pdf))
                yield pdf

        return df.mapInPandas(count, df.schema)

    return make, seen


@pytest.mark.parametrize("measure", [metrics.auc, metrics.average_precision, lambda d, by: metrics.average_precision(d, by, hard=False)])
def test_ranking_metrics_make_the_predictions_once(spark, counted, measure):
    make, seen = counted
    rows = [("a", 1, 0.9), ("a", 0, 0.9), ("a", 1, 0.2), ("a", 0, 0.1), ("b", 1, 0.7), ("b", None, 0.3), ("b", 0, None)]
    df = spark.createDataFrame(rows, "g string, y int, s double").withColumn("probs", F.array(1 - F.col("s"), F.col("s"))).drop("s")
    got = {r[0]: r[1] for r in measure(make(df), ["g"]).collect()}
    assert seen.value == len(rows)
    want = {
        metrics.auc: {"a": 0.625, "b": None},
        metrics.average_precision: {"a": 0.5, "b": 1.0},
    }.get(measure, {"a": 0.5 * 0.5 + 0.5 * 2 / 3, "b": 1.0})
    assert got == pytest.approx(want)


def _pairs(spark):
    rng = np.random.default_rng(3)
    x, d = rng.normal(size=(80, 3)), rng.normal(size=(80, 3))
    rows = [("ab"[i % 2], *x[i].tolist(), *(x[i] + d[i]).tolist()) for i in range(80)]
    return spark.createDataFrame(rows, "g string, p double, q double, r double, cf_p double, cf_q double, cf_r double")


def test_ks_makes_the_pairs_once(spark, counted):
    make, seen = counted
    assert plausibility.ks_2samp(make(_pairs(spark)), ["p", "q", "r"], ["g"]).count() == 6
    assert seen.value == 80


def test_mahalanobis_makes_the_pairs_twice(spark, counted):
    """Once for the moments, once for the distances; mean, deviation and quantiles read the distances."""
    make, seen = counted
    rows = plausibility.mahalanobis(make(_pairs(spark)), ["p", "q", "r"], ["g"]).collect()
    assert seen.value == 160 and {r["n"] for r in rows} == {40}


def test_power_rounds_make_the_rows_once(spark, counted):
    make, seen = counted
    df = spark.range(200).select(F.lit("a").alias("g"), (F.exp(F.randn(5)) - 1.5).alias("x"))
    df = spark.createDataFrame(df.collect(), df.schema)
    lam = transforms.fit_power(make(df), ["x"], ["g"]).first()["lam"]
    assert seen.value == 200
    x = np.array([r["x"] for r in df.collect()])

    def likelihood(lam):
        v = transforms.yeo_johnson(F.col("x"), float(lam))
        return -len(x) / 2 * np.log(df.select(F.var_pop(v)).first()[0]) + (lam - 1) * (np.sign(x) * np.log1p(np.abs(x))).sum()

    assert likelihood(lam) >= max(likelihood(lam - 0.01), likelihood(lam + 0.01))


def test_correlations_across_the_sides_are_not_computed(spark):
    out = plausibility.corr_preservation(_pairs(spark), ["p", "q", "r"], ["g"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    met = set(re.findall(r"corr\((\w+)#\d+, (\w+)#\d+", plan))
    assert len(met) == 6 and all(a.startswith("cf_") == b.startswith("cf_") for a, b in met)


def test_long_to_wide_keeps_one_entry_per_row(spark):
    df = spark.createDataFrame([("a", 1, 1.5, None), ("a", 2, None, None), ("b", 1, -2.0, 3.0)], "dataset_id string, row_id long, u double, v double")
    wide = tables.long_to_wide(tables.wide_to_long(df, ["u", "v"]), ["u", "v"])
    assert sorted(map(tuple, wide.collect())) == sorted(map(tuple, df.collect()))
    plan = wide._jdf.queryExecution().optimizedPlan().toString()
    assert "pivotfirst" not in plan.lower() and plan.count("Aggregate [") == 1


def test_sweep_makes_the_rows_once_for_all_strategies(spark, counted):
    make, seen = counted
    features, by = ["p", "q", "r"], ["g"]
    score = perturb.linear_score({"p": 1.0, "q": -0.5})
    rows = _pairs(spark).select("g", *features, F.monotonically_increasing_id().alias("row_id"))
    rows = spark.createDataFrame(rows.withColumn("q", F.when(F.col("p") < 1, F.col("q"))).collect(), rows.schema)
    spread = perturb.fit_spread(rows, features, by)
    threshold = spark.createDataFrame([("a", 0.1), ("b", -0.2)], "g string, threshold double")
    configs = {"x": perturb.PerturbConfig(score=score), "y": perturb.PerturbConfig(p=0.3, magnitude=0.5, k=0.3, score=score)}
    strategies = list(perturb.STRATEGIES)[:5]
    got = sweep(make(rows), features, by, strategies, configs, 2, score, threshold, spread).collect()
    assert seen.value == 80 and len(got) == 5 * 2 * 2

    def single(strategy, variant, repeat):
        cell = list(configs).index(variant) * 2 + repeat
        src = rows.withColumn("cell", F.lit(cell))
        cfg = replace(configs[variant], salt=F.col("cell"))
        made = perturb.label_pairs(perturb.perturb(src, features, strategy, by, cfg, spread), features, score, by, threshold)
        return pair_distances(made, features).agg(F.avg(F.col("label_flipped").cast("double")), F.count(F.lit(1)), F.avg("l1"), F.avg("l2"), F.avg("changed_share")).first()

    for r in got:
        if r["repeat"] == 1:
            assert tuple(r)[3:] == pytest.approx(tuple(single(r["strategy"], r["variant"], r["repeat"])))


def _measured(spark):
    made = pair_distances(_pairs(spark), ["p", "q", "r"]).withColumn("label_flipped", F.col("p") > 0)
    return spark.createDataFrame(made.collect(), made.schema)


def test_quantiles_make_the_rows_twice(spark, counted):
    """Once for the brackets, once for what lies inside them."""
    make, seen = counted
    df = _measured(spark)
    got = {r["g"]: r["l1_q0"] for r in exact_quantiles(make(df), ["g"], DISTANCES, [0.5], "lower").collect()}
    assert seen.value == 160
    rows = df.collect()
    assert got == {g: sorted(r["l1"] for r in rows if r["g"] == g)[19] for g in "ab"}


@pytest.mark.parametrize("valid_only", [False, True])
def test_proximity_makes_the_pairs_once(spark, counted, valid_only):
    make, seen = counted
    df = _measured(spark)
    more = [] if valid_only else [F.sum(F.col("label_flipped").cast("long")).alias("n_valid")]
    got = {r["g"]: r for r in proximity(make(df), ["g"], valid_only, more).collect()}
    assert seen.value == 80
    for g in "ab":
        rows = [r for r in df.collect() if r["g"] == g and (r["label_flipped"] or not valid_only)]
        assert got[g]["num_pairs"] == len(rows) and got[g]["l2_mean"] == pytest.approx(np.mean([r["l2"] for r in rows]))
        assert got[g]["cosine_median"] == sorted(r["cosine"] for r in rows)[(len(rows) + 1) // 2 - 1]
        assert valid_only or got[g]["n_valid"] == sum(r["label_flipped"] for r in rows)
