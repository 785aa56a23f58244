"""Links and components against all pairs, with copies, hot groups and odd vectors."""

import numpy as np
import pytest

from flipside.llm.itq_dedup import ItqConfig, learn_planes, near_vectors, table_plan
from tests.llm.helpers import rows_of

KIND = "vec_id long, embedding array<float>, label int, cno string, codes string, root string, lab string"


def frame(spark, rows, kind=KIND):
    return spark.createDataFrame([(i, v, y, "x", "x", "x", "x") for i, v, y in rows], kind).repartition(3)


def plain(rows, limit=0.98):
    n = len(rows)
    good = [y is not None and v is not None and all(a is not None and np.isfinite(a) for a in v) and any(a != 0 for a in v) for _, v, y in rows]
    near = [set() for _ in rows]
    for a in range(n):
        for b in range(a + 1, n):
            if good[a] and good[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.float64(np.float32(rows[k][1])) for k in (a, b))
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= limit:
                    near[a].add(b)
                    near[b].add(a)
    out, seen = [None] * n, set()
    for a in range(n):
        if a in seen:
            continue
        part, todo = {a}, [a]
        while todo:
            for b in near[todo.pop()] - part:
                part.add(b)
                todo.append(b)
        seen |= part
        ids = [rows[b][0] for b in part if rows[b][0] is not None]
        for b in part:
            least = min(ids) if ids else None
            out[b] = (least, rows[b][0] == least, len(near[b]), rows[b][0])
    return sorted(out, key=repr)


def noisy(rng, centre, angle):
    v = rng.normal(size=len(centre))
    v -= (v @ centre) * centre
    return np.cos(angle) * centre + np.sin(angle) * v / np.linalg.norm(v)


def planted(rng, d, singles, groups):
    rows = []
    for _ in range(singles):
        rows.append(rng.normal(size=d))
    for size, angle in groups:
        centre = rng.normal(size=d)
        centre /= np.linalg.norm(centre)
        rows += [noisy(rng, centre, angle * rng.random()) * rng.uniform(0.5, 2) for _ in range(size)]
    order = rng.permutation(len(rows))
    return [(int(k), [float(a) for a in rows[j]], int(j % 2)) for k, j in enumerate(order)]


def test_links_of_planted_groups_equal_all_pairs(spark):
    rows = planted(np.random.default_rng(1), 32, 300, [(120, 0.12), (40, 0.19), (5, 0.1), (2, 0.05)])
    rows += [(1000 + i, [1.0] + [0.0] * 31, 1) for i in range(50)] + [(2000 + i, [2.0] + [0.0] * 31, 1) for i in range(9)]
    assert rows_of(near_vectors(frame(spark, rows), ItqConfig(block=16, bucket=4, recall=0.9999999))) == plain(rows)


def test_recall_at_the_threshold_with_long_codes(spark):
    """Pairs a hair above the threshold, few classes a bucket: what the tables lose at most."""
    rng = np.random.default_rng(2)
    rows = []
    for k in range(1500):
        c = rng.normal(size=64)
        c /= np.linalg.norm(c)
        rows += [(2 * k, [float(a) for a in c], 0), (2 * k + 1, [float(a) for a in noisy(rng, c, np.arccos(0.9802))], 0)]
    got = near_vectors(frame(spark, rows), ItqConfig(bucket=4))
    assert table_plan(3000, ItqConfig(bucket=4))[0] == 10
    assert got.filter("n_links = 1").count() >= 0.997 * 3000


def test_vectors_that_link_with_nothing_and_repeated_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.01], 1), (1, [1.0, 0.01], 1), (2, None, 1), (3, [0.0, 0.0], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [None, 1.0], 1)]
    rows += [(7, [1.0, 0.0], None), (8, [1.0, 0.0], 2), (9, [1.0, 0.0, 0.0], 1), (10, [2.0, 0.0, 0.0], 1), (11, [-0.0, 5.0], 1), (12, [0.0, 5.0], 1), (None, [1.0, 0.0], 1), (None, [3.0, 3.0], 1), (13, [], 1), (1, [5.0, 5.1], 1)]
    assert rows_of(near_vectors(frame(spark, rows))) == plain(rows)
    words = KIND.replace("label int", "label string").replace("array<float>", "array<double>")
    assert rows_of(near_vectors(frame(spark, [(i, v, y and f"L{y}") for i, v, y in rows], words))) == plain(rows)


def test_empty_table_and_one_class(spark):
    assert rows_of(near_vectors(frame(spark, []))) == []
    same = [(i, [0.5, 0.5, 0.1], 4) for i in range(30)]
    assert rows_of(near_vectors(frame(spark, same))) == plain(same)


def test_bits_are_balanced_and_quantise_better_than_a_random_rotation():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 16)) @ rng.normal(size=(16, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    planes, cut = learn_planes(x, 32, ItqConfig())
    assert np.abs((x @ planes >= cut).mean(axis=0) - 0.5).max() < 0.01
    v = (x - x.mean(axis=0)) @ planes[:, :16]
    other = (x - x.mean(axis=0)) @ np.linalg.qr(rng.normal(size=(16, 16)))[0]
    assert np.allclose(planes[:, :16].T @ planes[:, :16], np.eye(16), atol=1e-9)
    assert np.abs(v).sum() > np.abs(other).sum()


@pytest.mark.parametrize("classes", [1, 500, 10**6, 10**10])
def test_plan_reaches_recall(classes):
    cfg = ItqConfig()
    bits, tables = table_plan(classes, cfg)
    assert 1 - (1 - (1 - np.arccos(0.98) / np.pi) ** bits) ** tables >= cfg.recall
