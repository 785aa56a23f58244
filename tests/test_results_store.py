"""The results store when a write stops half-way, and when two calls overlap."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from flipside.sources import results

KEYS = ["method", "dataset_id", "split"]
KIND = "method string, dataset_id string, split int, v double"


def rows(spark, values, kind=KIND):
    return spark.createDataFrame([(m, d, s, float(v)) for m, d, s, v in values], kind)


def stored(spark, path):
    return sorted(tuple(r) for r in results.read_results(spark, path).collect())


def test_an_overwrite_that_stops_half_way_leaves_the_old_rows(spark, tmp_path):
    path = str(tmp_path / "store")
    old = [("m", "d", i, i) for i in range(20)] + [("n", "7", 0, 3)]
    results.write_results(rows(spark, old), path, KEYS)
    before = stored(spark, path)
    assert before == sorted((m, d, s, float(v)) for m, d, s, v in old)  # a data set named 7 stays text
    broken = rows(spark, [("m", "d", i, -i) for i in range(20)]).repartition(4).withColumn("v", F.expr("if(split = 17, raise_error('lost'), v)"))
    for mode in ("overwrite", "keep"):
        with pytest.raises(Exception, match="lost"):
            results.write_results(broken, path, KEYS, mode=mode)
        assert stored(spark, path) == before
    half = results._Store(spark, path)
    half.write(rows(spark, [("m", "d", 1, 99)]), ["method", "dataset_id"])  # written, never committed
    assert stored(spark, path) == before


def test_overwrites_replace_keys_again_and_again(spark, tmp_path):
    path = str(tmp_path / "store")
    results.write_results(rows(spark, [("m", "d", i, i) for i in range(4)] + [("m", "e", 0, 0)]), path, KEYS)
    for turn in range(3):
        got = results.write_results(rows(spark, [("m", "d", 1, 10 + turn), ("m", "f", turn, turn)]), path, KEYS, mode="overwrite")
        assert got.filter("split = 1 and dataset_id = 'd'").first()["v"] == 10 + turn
    assert stored(spark, path) == [("m", "d", 0, 0.0), ("m", "d", 1, 12.0), ("m", "d", 2, 2.0), ("m", "d", 3, 3.0), ("m", "e", 0, 0.0), ("m", "f", 0, 0.0), ("m", "f", 1, 1.0), ("m", "f", 2, 2.0)]


def test_overlapping_calls_leave_no_double_key(spark, tmp_path):
    path = str(tmp_path / "store")
    calls = [[("m", f"d{i % 3}", i, 100 * k + i) for i in range(k, k + 6)] for k in range(4)]
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda c: results.write_results(rows(spark, c), path, KEYS), calls))
    got = stored(spark, path)
    assert [(m, d, s) for m, d, s, _ in got] == sorted({(m, d, s) for c in calls for m, d, s, _ in c})


def test_a_taken_version_is_told(spark, tmp_path):
    store = results._Store(spark, str(tmp_path / "store"))
    assert store.version().number == 0 and store.read(store.version()) is None
    assert store.commit([], rows(spark, []).schema.json(), 0) and not store.commit([], "{}", 0)
    assert store.version().number == 1 and store.read(store.version()).count() == 0
