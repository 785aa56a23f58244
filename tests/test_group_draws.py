"""Draws that depend on the group only: one per group, the same as drawn in each row."""

import pytest
from pyspark.sql import functions as F

from flipside.functions.fitted import attach_draws
from flipside.functions.keyed import text_uniform01
from flipside.operators import labels, missing


@pytest.fixture(scope="module")
def rows(spark):
    group = F.when(F.col("id") % 5 < 4, F.concat(F.lit("d"), (F.col("id") % 5).cast("string")))
    return spark.range(500).select(F.col("id").alias("row_id"), group.alias("d"), (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 4).cast("int").alias("c"))


def test_draws_are_those_of_the_rows_and_the_null_group_has_its_own(rows):
    draw = text_uniform01(7, F.col("d"), "u")
    out = attach_draws(rows, ["d"], {"u": draw}).withColumn("own", draw)
    assert out.count() == 500
    assert out.filter("u is null or u <> own").count() == 0
    assert out.select("d", "u").distinct().count() == 5


def test_no_groups_and_no_rows(rows):
    assert attach_draws(rows, [], {"u": text_uniform01(7, "u")}).select("u").distinct().count() == 1
    assert attach_draws(rows.limit(0), ["d"], {"u": text_uniform01(7, F.col("d"))}).count() == 0


def test_no_text_draw_in_a_row_expression(rows):
    out = missing.inject_missing_random(rows, ["x"], 0.5, "d", "row_id", 3)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" not in plan.split("InMemoryRelation")[0]
    assert out.columns == rows.columns


def test_classes_are_permuted_one_way_per_group(rows):
    out = labels.permute_classes(rows, F.col("c"), 4, 0.3, ["d"], 11)
    pairs = [(r["d"], r["c"], r["y_class"]) for r in out.select("d", "c", "y_class").distinct().collect()]
    assert len(pairs) == 20
    for d in {p[0] for p in pairs}:
        assert sorted(y for g, _, y in pairs if g == d) == [0, 1, 2, 3]


def test_missingness_schedule_is_one_per_group(rows):
    out = missing.attach_missing_schedule(rows, "d", 5, 0.5, 0.2, 0.2, 0.3)
    assert out.select("d", "has_none", "has_reason", "has_unknown", "unknown_by_value").distinct().count() == 5
