"""Registered queries next to their SQL on the smallest tables, and corner cases."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from flipside.functions.stats import kolmogorov_pvalue, normal_icdf
from flipside.operators import labels, metrics, missing, splits, transforms
from flipside.sources import results
from tools.check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "flagship_flip_report", "a5_export_examples", "b8_balanced_interleave", "c3_valid_split", "d4_inject_missing_random",
    "e2_soft_clip_outliers", "e6_robust_scale", "f4_multiclass_by_rank", "h3_perturb_marginal_replacement",
    "h14_context_query_layout_mixed", "i13_eval_metrics", "j2_feature_shape", "k1_ks_2samp", "k3_js_divergence",
    "f3_calibrate_threshold", "l1_auc", "c1_keyed_shuffle", "b8_order_by_label", "j3_feature_iqr", "a4_pending_jobs", "a4_overwrite_results",
    "l2_auc_ovo", "l5_average_precision", "m5_ranks_and_wins", "n3_ensemble_average", "r1_stream_normalize",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows_of([tuple(r) for r in df.collect()], df.columns) == rows_of(cur.fetchall(), cols)


def test_constant_single_and_null_columns(spark):
    df = spark.createDataFrame(
        [("a", 1, 5.0, None, 1.0), ("a", 2, 5.0, None, 3.0), ("b", 3, 5.0, None, 2.0)],
        "dataset_id string, row_id long, c double, n double, x double",
    )
    z = {r["row_id"]: r for r in transforms.zscore(df, ["c", "n", "x"], ["dataset_id"]).collect()}
    assert z[1]["c"] == 0.0 and z[1]["n"] is None and z[3]["x"] is None
    m = {r["row_id"]: r for r in transforms.minmax(df, ["c", "x"], ["dataset_id"]).collect()}
    assert m[1]["c"] is None and (m[1]["x"], m[2]["x"]) == (0.0, 1.0)


def test_missing_kinds(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (2.0,)], "x double")
    assert [r[0] for r in df.select(missing.missing_kind("x")).collect()] == ["unknown", "reason", "none", None]


def test_lower_median_of_even_group(spark):
    df = spark.createDataFrame([("a", v) for v in (1.0, 2.0, 3.0, 4.0)], "dataset_id string, y double")
    assert labels.calibrate_threshold(df, "y", ["dataset_id"]).first()["threshold"] == 2.0


def test_one_class_auc_is_null(spark):
    df = spark.createDataFrame([("a", 1, [0.2, 0.8]), ("a", 1, [0.6, 0.4])], "dataset_id string, y int, probs array<double>")
    assert metrics.auc(df, ["dataset_id"]).first()["auc"] is None


def test_normal_icdf_and_pvalue(spark):
    r = spark.range(1).select(
        normal_icdf(F.lit(0.975)).alias("a"), normal_icdf(F.lit(0.001)).alias("b"),
        kolmogorov_pvalue(F.lit(0.136), F.lit(200.0), F.lit(200.0)).alias("p"),
    ).first()
    assert abs(r["a"] - 1.959964) < 1e-6 and abs(r["b"] + 3.090232) < 1e-6
    assert 0.045 < r["p"] < 0.055


def test_power_lambda_recovers_log_normal(spark):
    from flipside.functions.keyed import rand_normal

    df = spark.range(4000).select(F.lit("a").alias("d"), (F.exp(rand_normal(0, 1, F.col("id"))) - 1 + 1e-9).alias("x")).filter("x > 0")
    lam = transforms.fit_power(df, ["x"], ["d"]).first()["lam"]
    assert -2.5 < lam < 0.5


def test_write_results_modes(spark, tmp_path):
    path = str(tmp_path / "store")
    a = spark.createDataFrame([("m", "d1", 1.0)], "method string, dataset_id string, value double")
    b = spark.createDataFrame([("m", "d1", 9.0), ("m", "d2", 2.0)], a.schema)
    keys = ["method", "dataset_id"]
    results.write_results(a, path, keys)
    results.write_results(b, path, keys)
    assert sorted(r["value"] for r in results.read_results(spark, path).collect()) == [1.0, 2.0]
    results.write_results(b, path, keys, mode="fetch_only")
    results.write_results(b, path, keys, mode="overwrite")
    assert sorted(r["value"] for r in results.read_results(spark, path).collect()) == [2.0, 9.0]


def test_kfold_is_bounded_by_half_the_group(spark):
    df = spark.range(6).select(F.col("id").alias("row_id"), F.lit("a").alias("d"))
    folds = [r["fold"] for r in splits.kfold(df, ["d"], "row_id", 1).collect()]
    assert sorted(folds) == [0, 0, 1, 1, 2, 2]


def test_uniform_is_even(spark):
    from flipside.functions.keyed import uniform01

    r = spark.range(100_000).select(uniform01(1, F.col("id"), "x").alias("u"), uniform01(1, F.col("id"), "y").alias("v"))
    s = r.agg(F.avg("u"), F.var_pop("u"), F.corr("u", "v"), F.min("u"), F.max("u")).first()
    assert abs(s[0] - 0.5) < 0.005 and abs(s[1] - 1 / 12) < 0.002 and abs(s[2]) < 0.02
    assert 0 <= s[3] and s[4] < 1 and math.isfinite(s[4])
