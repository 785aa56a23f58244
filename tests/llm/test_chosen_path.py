"""Classes and link counts against all pairs."""

from itertools import combinations

import pytest
from pyspark.sql import functions as F

from flipside.llm.chosen_path import JoinConfig, drop_near_copies, jaccard_classes, shingles
from flipside.llm.components import components
from tests.llm.helpers import ODD, docs, empty, rows_of


def plain(rows, t=0.8):
    """doc_id -> (class_id, rep_id, links) by comparing all pairs of different sets."""
    sets = {}
    for doc_id, text, *_ in rows:
        sets.setdefault(frozenset(map(int, shingles(text or "", 5))), []).append(doc_id)
    keys = list(sets)
    root, links = list(range(len(keys))), [0] * len(keys)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(keys)), 2):
        a, b = keys[i], keys[j]
        if a and b and len(a & b) >= t * len(a | b) - 1e-9:
            links[i] += 1
            links[j] += 1
            root[find(i)] = find(j)
    least = {}
    for i, k in enumerate(keys):
        least.setdefault(find(i), []).extend(sets[k])
    low = lambda ids: min((x for x in ids if x is not None), default=None)
    return sorted(((d, low(least[find(i)]), low(sets[k]), links[i]) for i, k in enumerate(keys) for d in sets[k]), key=repr)


def got(df):
    return sorted(((r["doc_id"], r["class_id"], r["rep_id"], r["links"]) for r in df.collect()), key=repr)


def near_group(n, start=0):
    """Copies of a 150-word text with one or two words changed; some pairs fall below the threshold."""
    base = [f"w{start}x{i}" for i in range(150)]
    out = []
    for i in range(n):
        words = list(base)
        for j in range(1 + i % 3):
            words[(i * 37 + j * 61) % 150] = f"edit{i}y{j}"
        out.append((start + i, " ".join(words), "en", "a", 0))
    return out


def test_real_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert got(jaccard_classes(df)) == plain(rows)


def test_large_near_group_in_many_blocks(spark):
    rows = near_group(90) + near_group(3, 1000) + [(5000 + i, f"passage {' '.join(f'p{k}' for k in range(60))} own {' '.join(f'o{i}x{k}' for k in range(90))}", "en", "b", 0) for i in range(60)]
    cfg = JoinConfig(small=8, block=16)
    assert got(jaccard_classes(docs(spark, rows), cfg)) == plain(rows)


def test_recall_in_deep_nodes(spark):
    passage = [f"p{k}" for k in range(125)]
    rows = []
    for i in range(300):  # one passage in all, 150 pairs of 0.81
        own = [f"o{i // 2}x{k}" for k in range(25)]
        for j in (4, 12, 20):
            own[j] = f"edit{i}x{j}"
        rows.append((i, " ".join(passage + own), "en", "a", 0))
    cfg = JoinConfig(small=2, dense=2.0, recall=0.9)
    links = [r["links"] for r in jaccard_classes(docs(spark, rows), cfg).collect()]
    assert sum(n for *_, n in plain(rows)) == 300
    assert 0.9 * 300 <= sum(links) <= 300


@pytest.mark.parametrize("clash", [False, True])
def test_odd_rows(spark, clash):
    assert got(jaccard_classes(docs(spark, clash=clash))) == plain(ODD)
    kept = drop_near_copies(docs(spark, clash=clash))
    assert sorted(map(repr, (r["doc_id"] for r in kept.collect()))) == sorted(map(repr, [1, 3, 7, 9, 10, 7, None]))


def test_one_of_each_class_stays(spark):
    kept = drop_near_copies(docs(spark, near_group(20) + near_group(20)))
    assert [r["doc_id"] for r in kept.collect()] == [0]


def test_whole_texts_count(spark):
    head = " ".join(f"h{i}" for i in range(3000))
    rows = [(1, head + " " + " ".join(f"a{i}" for i in range(900)), "en", "a", 0), (2, head + " " + " ".join(f"b{i}" for i in range(900)), "en", "a", 0)]
    assert {r["links"] for r in jaccard_classes(docs(spark, rows)).collect()} == {0}


def test_empty_table(spark):
    assert jaccard_classes(empty(spark)).count() == 0
    assert drop_near_copies(empty(spark)).count() == 0


def test_runs_reach_the_recall():
    assert JoinConfig(recall=0.9).runs < JoinConfig(recall=0.999).runs <= 20


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(i, 7) for i in range(200, 260)]
    df = spark.createDataFrame(chain + star + [(5, 5), (300, 301), (301, 300)], "a long, b long")
    want = {(i, 100) for i in range(101, 161)} | {(i, 7) for i in range(200, 260)} | {(301, 300)}
    assert {(r["node"], r["least"]) for r in components(df).collect()} == want
    assert rows_of(components(df.limit(0))) == []
    assert df.filter(F.col("a") == 5).count() == 1


def test_missing_and_shared_ids(spark):
    rows = [(None if i % 3 else 5, text, *rest) for i, (_, text, *rest) in enumerate(near_group(60) + near_group(40, 1000))]
    rows += [(None, f"a text of its own number {i} without a neighbour", "en", "a", 0) for i in range(200)]
    assert got(jaccard_classes(docs(spark, rows))) == plain(rows)
    assert got(jaccard_classes(docs(spark, [(None, *r[1:]) for r in rows]))) == plain([(None, *r[1:]) for r in rows])
