"""Invariants of perturbation, interventions and layouts on small tables."""

import math

import pytest
from pyspark.sql import functions as F

from flipside.functions.keyed import uniform01
from flipside.operators import causal, labels, layout, perturb
from flipside.operators.pair_metrics import DISTANCES, eval_metrics, pair_distances, proximity
from flipside.plans import inputs

FE = ["f_0", "f_1", "f_2"]
BY = ["dataset_id"]
SCORE = perturb.linear_score({"f_0": 1.0, "f_1": 0.5, "f_2": -0.5})


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(400).select(
        F.col("id").alias("row_id"),
        (F.col("id") % 4).cast("string").alias("dataset_id"),
        *[((uniform01(F.col("id"), f) - 0.5) * 4).alias(f) for f in FE],
    ).withColumn("f_2", F.when(F.col("row_id") % 11 != 0, F.col("f_2")))


@pytest.mark.parametrize("strategy", list(perturb.STRATEGIES))
def test_every_strategy_moves_masked_features_only(rows, strategy):
    cfg = perturb.PerturbConfig(score=SCORE)
    out = perturb.perturb(rows, FE, strategy, BY, cfg).collect()
    assert len(out) == 400
    for r in out:
        assert any(r[f"m_{f}"] for f in FE)
        for f in FE:
            if not r[f"m_{f}"]:
                assert r[f"d_{f}"] == 0.0 and r[f"cf_{f}"] == r[f]
            if r[f] is None:
                assert not r[f"m_{f}"] and r[f"cf_{f}"] is None
    assert sum(abs(r[f"d_{f}"]) > 0 for r in out for f in FE) > 200


def test_zero_magnitude_and_unknown_strategy(rows):
    out = perturb.perturb(rows, FE, "additive_noise", BY, perturb.PerturbConfig(magnitude=0.0))
    assert out.filter(" or ".join(f"d_{f} <> 0" for f in FE)).count() == 0
    with pytest.raises(ValueError):
        perturb.perturb(rows, FE, "no_such", BY, perturb.PerturbConfig())


def test_results_do_not_depend_on_partitioning(rows):
    cfg = perturb.PerturbConfig(score=SCORE)
    a = perturb.perturb(rows.coalesce(1), FE, "marginal_replacement", BY, cfg).select("row_id", *[f"d_{f}" for f in FE])
    b = perturb.perturb(rows.repartition(7), FE, "marginal_replacement", BY, cfg).select("row_id", *[f"d_{f}" for f in FE])
    assert sorted(a.collect()) == sorted(b.collect())


def test_flip_is_class_inequality_and_big_shifts_flip(rows):
    y = rows.withColumn("y", SCORE({f: F.col(f) for f in FE}))
    t = labels.calibrate_threshold(y, "y", BY)
    made = perturb.label_pairs(perturb.perturb(rows, FE, "fixed_magnitude", BY, perturb.PerturbConfig(k=5.0)), FE, SCORE, BY, t)
    assert made.filter(F.col("label_flipped") != (F.col("y_f_class") != F.col("y_cf_class"))).count() == 0
    assert made.filter("label_flipped").count() > 20


def test_fixed_threshold_values(spark):
    df = spark.createDataFrame([(0.49,), (0.51,), (0.5,), (7.0,), (-2.0,)], "y double")
    assert [r[0] for r in df.select(labels.binarize_threshold("y", 0.5)).collect()] == [0, 1, 0, 1, 0]


def test_interventions_keep_noise_and_upstream(rows):
    eq = {"f_1": lambda at: at["f_0"] * 0.5}
    base = causal.abduct(rows, FE, eq)
    same = causal.do_intervene(base, FE, eq, {})
    assert same.filter("abs(cf_f_1 - f_1) > 1e-12").count() == 0
    moved = causal.do_intervene(base, FE, eq, {"f_0": F.col("f_0") + 2.0})
    assert moved.filter("abs(cf_f_1 - f_1 - 1.0) > 1e-9").count() == 0
    pinned = causal.do_intervene(base, FE, eq, {"f_0": F.col("f_0") + 2.0, "f_1": F.lit(None).cast("double")}, scope="column")
    assert pinned.filter("cf_f_1 <> f_1").count() == 0
    root = causal.do_intervene(base, FE, eq, {"f_1": F.lit(9.0)})
    assert root.filter("cf_f_0 <> f_0 or cf_f_1 <> 9.0").count() == 0


def pairs_with_flips(spark, flips: dict, n=20):
    data = [
        (d, i, float(i), i < k, 0, 1 if i < k else 0, 1.0, True)
        for d, k in flips.items()
        for i in range(n)
    ]
    return spark.createDataFrame(
        data, "dataset_id string, row_id long, f_0 double, label_flipped boolean, y_f_class int, y_cf_class int, d_f_0 double, m_f_0 boolean"
    )


def test_layout_cases(spark):
    made = pairs_with_flips(spark, {"enough": 12, "few": 3, "none": 0})
    lay = layout.context_query_layout(made, ["f_0"], 12, 8)
    got = {}
    for r in lay.collect():
        got.setdefault(r["dataset_id"], {}).setdefault(r["role"], []).append((r["pos"], r["row_id"], r["f_0"], r["y"]))
    for d in ("enough", "none"):
        assert sorted(p for p, *_ in got[d]["context"]) == list(range(12))
    # Too few flipped rows: the context holds non-flipped rows only.
    assert sorted(p for p, *_ in got["few"]["context"]) == list(range(12))
    for d in got:
        assert sorted(p for p, *_ in got[d]["query"]) == list(range(12, 20))
    assert [r for _, r, *_ in sorted(got["enough"]["query"])] == list(range(8))
    assert [r for _, r, *_ in sorted(got["enough"]["context"])] == list(range(12, 20)) + list(range(8, 12))
    few = sorted(got["few"]["query"])
    assert [r for _, r, *_ in few] == [0, 1, 2, 0, 1, 2, 0, 1]
    assert [x for _, _, x, _ in few[:3]] == [0.0, 1.0, 2.0]
    assert all(0 < abs(x - r) < 0.1 for _, r, x, _ in few[3:])
    assert all(y == 1 for *_, y in few)
    assert [r for _, r, *_ in sorted(got["none"]["query"])] == list(range(8))
    mixed = layout.context_query_layout(pairs_with_flips(spark, {"d": 3}), ["f_0"], 12, 8, flip_only=False)
    q = sorted((r["pos"], r["row_id"]) for r in mixed.filter("role='query'").collect())
    assert [r for _, r in q] == [0, 1, 2, 3, 4, 5, 6, 7]


def test_distance_corner_cases(spark):
    df = spark.createDataFrame(
        [("a", 0.0, 0.0, 0.0, 0.0, False), ("a", 3.0, 4.0, 0.0, 0.0, True), ("b", 1.0, None, 1.0, None, False)],
        "dataset_id string, f_0 double, f_1 double, cf_f_0 double, cf_f_1 double, label_flipped boolean",
    )
    d = pair_distances(df, ["f_0", "f_1"])
    r = d.collect()
    assert (r[0]["l2"], r[0]["cosine"]) == (0.0, 0.0)
    assert (r[1]["l1"], r[1]["l2"], r[1]["linf"], r[1]["changed_share"]) == (7.0, 5.0, 4.0, 1.0)
    valid = {x["dataset_id"]: x for x in proximity(d, BY, valid_only=True).collect()}
    assert valid["a"]["l2_std"] == 0.0 and valid["a"]["num_pairs"] == 1
    assert valid["b"]["num_pairs"] == 0 and valid["b"]["l2_mean"] == 0.0


def test_eval_metric_defaults(spark):
    df = spark.createDataFrame([(0.0, 0.05)], "d_f_0 double, p_f_0 double")
    r = df.agg(*eval_metrics(["f_0"])).first()
    assert r["sign_accuracy"] == -1.0 and r["zero_feature_accuracy"] == 1.0
    assert math.isclose(r["delta_mse"], 0.0025)


def test_retry_switches_strategy(rows):
    y = rows.withColumn("y", SCORE({f: F.col(f) for f in FE}))
    t = labels.calibrate_threshold(y, "y", BY)

    def make(strategy, magnitude, attempt):
        cfg = perturb.PerturbConfig(score=SCORE, magnitude=magnitude if strategy != "additive_noise" else 0.0, salt=str(attempt))
        return perturb.label_pairs(perturb.perturb(rows, FE, strategy, BY, cfg), FE, SCORE, BY, t)

    _, log = perturb.retry_until_flip_rate(make, "additive_noise", 2.0)
    assert log[0]["flip_rate"] == 0.0 and log[1]["strategy"] == "uniform_random" and log[1]["magnitude"] == 3.0
    assert log[-1]["flip_rate"] >= 0.2


def test_fits_taken_together_are_those_taken_alone(rows):
    y = rows.withColumn("y", SCORE({f: F.col(f) for f in FE}))
    spread, threshold = perturb.fit_pairs(y, FE, "y", BY)
    alone = {r["dataset_id"]: r.asDict() for r in perturb.fit_spread(rows, FE, BY).collect()}
    frozen = {r["dataset_id"]: r["threshold"] for r in labels.calibrate_threshold(y, "y", BY).collect()}
    assert {r["dataset_id"]: r["threshold"] for r in threshold.collect()} == frozen
    for r in spread.collect():
        want = alone[r["dataset_id"]]
        assert set(r.asDict()) == set(want)
        assert all(r[c] == pytest.approx(want[c], rel=1e-12) for c in want if c != "dataset_id")
    whole, one = perturb.fit_pairs(y, FE, "y", [])
    assert one.count() == 1 and {"sd_f_0", "lo_f_1", "hi_f_2"} <= set(whole.columns)


def test_proximity_with_more_aggregates(rows):
    made = perturb.perturb(rows, FE, "fixed_magnitude", BY, perturb.PerturbConfig())
    made = pair_distances(perturb.label_pairs(made, FE, SCORE, BY, 0.0), FE)
    share = F.avg(F.col("label_flipped").cast("double")).alias("share")
    got = {r["dataset_id"]: r for r in proximity(made, BY, more=[share]).collect()}
    want = {r["dataset_id"]: r["share"] for r in made.groupBy(*BY).agg(share).collect()}
    assert {d: r["share"] for d, r in got.items()} == pytest.approx(want)
    assert sum(r["num_pairs"] for r in got.values()) == proximity(made, []).first()["num_pairs"] == 400


@pytest.mark.parametrize("strategy", [s for s in perturb.STRATEGIES if s in ("additive_noise", "gradient_guided", "fixed_magnitude", "uniform_random")])
def test_pairs_with_distances_are_short_enough_to_be_compiled(spark, strategy):
    """The JVM leaves methods of more than 8,000 bytes uncompiled."""
    made = pair_distances(inputs.pairs(spark, "/root/testdata/sf0.001", strategy), inputs.FEATURES)
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # a plan that is whole before it runs
    try:
        plan = made.select("dataset_id", "label_flipped", *DISTANCES)._jdf.queryExecution().executedPlan()
        parts = getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package").codegenStringSeq(plan)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)
    sizes = [parts.apply(i)._3().maxMethodCodeSize() for i in range(parts.size())]
    assert len(sizes) > 1 and 1000 < max(sizes) <= 8000
