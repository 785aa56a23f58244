"""Preprocessing does not depend on a setting: it is done once per fold, and its rows are made once per fit."""

import pytest
from pyspark.sql import functions as F

from flipside.operators import models


@pytest.fixture
def data(spark):
    row = F.col("id").cast("double")
    return spark.range(80).select(F.col("id").alias("row_id"), row.alias("x"), F.when(F.col("id") % 5 > 0, row * row).alias("z"), (F.col("id") % 7 + F.col("id") / 20 > 5).cast("int").alias("y"))


def test_settings_share_the_prepared_folds(data, monkeypatch):
    calls = []
    monkeypatch.setattr(models, "preprocess", lambda *a, make=models.preprocess, **k: calls.append(1) or make(*a, **k))
    got = models.tune("random_forest", data, data, ["x", "z"], "y", "row_id", 2, folds=2, max_evals=3)
    assert got.trials == 3 and not got.failed and got.predictions.count() == 80
    assert len(calls) == 2 + 1  # the folds, and the last fit


def test_shared_folds_score_as_single_fits(data):
    cv = models.kfold(data, [], "row_id", 0, 2).cache()
    by_hand = []
    for i in range(2):
        part = cv.filter(F.col("fold") == i)
        by_hand.append(models.score(models.fit_predict("logistic", cv.filter(F.col("fold") != i), part, ["x", "z"], "y", "row_id", 2), part, "row_id", "y", "cross_entropy"))
    got = models.tune("logistic", data, data, ["x", "z"], "y", "row_id", 2, folds=2, max_evals=1)
    assert got.cv_score == pytest.approx(sum(by_hand) / 2, rel=1e-9)


@pytest.mark.parametrize("name", ["logistic", "knn", "random_forest"])
def test_rows_are_made_for_the_statistics_and_for_the_table_only(spark, data, name):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    train, test = (data.filter(F.col("row_id") % 2 == i).mapInPandas(count, data.schema) for i in (0, 1))
    pred = models.fit(name, train, test, ["x", "z"], "y", "row_id", 2, keep=["y"])().collect()
    assert {(r["row_id"], r["y"]) for r in pred} == {(r["row_id"], r["y"]) for r in data.filter("row_id % 2 = 1").collect()}
    assert seen.value <= 3 * 80  # means, bounds, table
