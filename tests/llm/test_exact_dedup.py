"""Exact dedup against plain grouping, with forced digest clashes."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from flipside.llm.exact_dedup import drop_copies, exact_dedup
from tests.llm.helpers import ODD, docs, empty, rows_of

TABLE = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[(text or "").translate(TABLE)].append(doc_id)
    out = []
    for norm, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        left = True
        for i in sorted(ids, key=repr):
            kept = i == keep and left
            left = left and not kept
            out.append((i, len(ids), keep, kept, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("clash", [False, True])
def test_like_plain_grouping(spark, clash):
    got = exact_dedup(docs(spark, clash=clash)).select("doc_id", "group_size", "keep_id", "kept", "text_sha256")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(ODD)


def test_equal_digests_of_different_texts_stay_apart(spark):
    weak = lambda norm: (F.crc32(norm.cast("binary")) % 2).cast("string")
    assert rows_of(exact_dedup(docs(spark), digest=weak)) == rows_of(exact_dedup(docs(spark)))


def test_hot_copies_over_many_salts(spark):
    hot = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "Hot").otherwise(F.concat(F.lit("t"), "id")).alias("text")).repartition(40)
    got = exact_dedup(hot, salts=7)
    assert got.filter("kept").count() == 5000 - 1667 + 1
    assert got.filter("doc_id = 4998").first()["group_size"] == 1667
    assert got.count() == 5000


def test_kept_rows_have_their_columns(spark):
    df = docs(spark, clash=True)
    kept = drop_copies(df)
    assert kept.columns == df.columns
    # Three texts of the first group fold to two ids; the largest stays once.
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [2, 4, 6, 7, 7, 8, 9, 10]
    assert kept.filter("doc_id is null").count() == 1


def test_empty_table(spark):
    assert exact_dedup(empty(spark)).count() == 0
    assert drop_copies(empty(spark)).count() == 0
