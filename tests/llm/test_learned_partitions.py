"""Recall against all pairs, ties, copies and vectors that take no part."""

import numpy as np
from pyspark.sql import functions as F

from flipside.llm.learned_partitions import PartitionConfig, balanced_parts, nearest
from tests.llm.helpers import rows_of

KIND = "vec_id long, embedding array<float>, label int, cid string, part string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "y") for i, v in rows], KIND).repartition(3)


def plain(rows, is_query, k):
    out = {}
    for i, v in rows:
        if is_query(i):
            near = sorted((-float(np.dot(np.float64(np.float32(v)), np.float64(np.float32(w)))), j) for j, w in rows if j != i)[:k]
            out[i] = [j for _, j in near]
    return out


def test_recall_with_many_parts(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 32))
    x = centres[rng.integers(0, 12, 3000)] + rng.normal(size=(3000, 32)) * 0.8
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = nearest(df, F.col("vec_id") % 20 == 0, 20, PartitionConfig(rows_per_part=150, block=100))
    found = {r["query_id"]: r["ids"] for r in got.groupBy("query_id").agg(F.collect_list("vec_id").alias("ids")).collect()}
    score = x[::20] @ x.T
    hits = 0
    for n, q in enumerate(range(0, 3000, 20)):
        score[n, q] = -9
        hits += len(set(np.argsort(-score[n])[:20]) & set(found[q]))
        assert len(found[q]) == 20 and q not in found[q]
    assert hits / (20 * 150) >= 0.9
    r = got.filter("query_id = 40").orderBy("rank").collect()
    assert [x_["rank"] for x_ in r] == list(range(1, 21))
    assert all(abs(x_["score"] - float(x[40] @ x[x_["vec_id"]])) < 1e-12 for x_ in r)


def test_small_table_is_exact_with_copies_and_ties(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(a) for a in rng.normal(size=4)]) for i in range(60)] + [(100 + i, [1.0, 0.0, 0.0, 2.0]) for i in range(40)]
    got = nearest(table(spark, rows + rows[:7]), F.col("vec_id") % 5 == 0, 6)
    want = plain(rows, lambda i: i % 5 == 0, 6)
    for q, ids in want.items():
        assert [r["vec_id"] for r in got.filter(F.col("query_id") == q).orderBy("rank").collect()] == ids
    assert got.count() == 6 * len(want)


def test_vectors_without_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [0.0, 0.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [1.0]), (None, [1.0, 1.0]), (20, [2.0, 1.0]), (21, [-0.0, 1.0]), (40, [0.0, 1.0])]
    got = nearest(table(spark, rows), F.col("vec_id") % 20 == 0, 20)
    assert sorted((r["query_id"], r["vec_id"]) for r in got.collect()) == sorted((q, v) for q in (0, 20, 40) for v in (0, 20, 21, 40) if v != q)
    assert rows_of(nearest(table(spark, rows).limit(0), F.col("vec_id") % 20 == 0)) == []


def test_parts_are_balanced():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 8))
    graph = np.argsort(-(x @ x.T - 9 * np.eye(400)), axis=1)[:, :8]
    label = balanced_parts(x, graph, 7)
    sizes = np.bincount(label, minlength=7)
    assert sizes.max() <= 1.1 * 400 / 7 + 1 and sizes.min() > 0
    shuffled = rng.permutation(label)
    assert (label[graph] == label[:, None]).mean() > 1.5 * (shuffled[graph] == shuffled[:, None]).mean()


def test_ties_between_different_vectors_go_to_the_smaller_id(spark):
    """306 different vectors of -1, 0 and 1: nearly every score is shared by many."""
    rng = np.random.default_rng(7)
    x = np.unique(rng.integers(-1, 2, (320, 8)), axis=0)
    x = x[np.abs(x).sum(axis=1) > 0][rng.permutation(len(x) - int((np.abs(x).sum(axis=1) == 0).any()))]
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    want = plain(rows, lambda i: i % 10 == 0, 20)
    for cfg in (PartitionConfig(), PartitionConfig(block=50)):
        got = nearest(table(spark, rows), F.col("vec_id") % 10 == 0, 20, cfg)
        found = {q: [v for _, v in sorted(r)] for q, r in got.rdd.map(lambda r: (r["query_id"], [(r["rank"], r["vec_id"])])).reduceByKey(lambda a, b: a + b).collect()}
        assert found == want


def test_an_id_with_two_vectors_has_a_list_for_each(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (21, [3.0, 1.0]), (22, [1.0, 4.0]), (23, [2.0, 2.0])]
    got = nearest(table(spark, rows), F.col("vec_id") % 20 == 0, 20)
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got.collect()) == sorted([(1, 21, 3.0), (2, 23, 2.0), (3, 22, 1.0), (1, 22, 4.0), (2, 23, 2.0), (3, 21, 1.0)])
    other = nearest(table(spark, rows), F.col("vec_id") == 23, 20)
    assert [(r["vec_id"], r["score"]) for r in other.orderBy("rank").collect()] == [(22, 10.0), (21, 8.0), (20, 2.0), (20, 2.0)]
