"""Exact products against big integers, and negatives against all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flipside.llm.queries import moved_label
from flipside.llm.rns_negatives import NegativeConfig, Residues, exact_products, hard_negatives, primes_for
from tests.llm.helpers import rows_of

KIND = "vec_id long, embedding array<double>, label int, lab string, number string, chunk string, block string, q string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, y, *["x"] * 5) for i, v, y in rows], KIND).repartition(3)


def plain(rows, anchor, d):
    good = []
    for i, v, y in rows:
        if i is None or y is None or v is None or len(v) != d or any(a is None or not math.isfinite(a) for a in v):
            continue
        q = [math.floor(256 * a) for a in v]
        if sum(a * a for a in q) <= 1 << 56:
            good.append((i, q, (y + 1) % 10 if i % 7 == 0 else y))
    out = []
    for i, q, y in good:
        if not anchor(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, p)), j, z) for j, p, z in good)
        for s, j, _ in [x for x in scored if x[2] == y and x[1] != i][:5]:
            for rank, (t, k, _) in enumerate([x for x in scored if x[2] != y and 30 * -s <= 100 * -x[0] <= 90 * -s][:10]):
                out.append((i, k, -t, j, -s, rank + 1))
    return sorted(out, key=repr)


def test_products_are_exact_up_to_the_bound():
    rng = np.random.default_rng(1)
    for d, most in [(1, 3), (64, 300), (64, 2**24), (200, 5000), (1000, 2**22)]:
        a, b = rng.integers(-most, most + 1, (7, d)), rng.integers(-most, most + 1, (9, d))
        a[0], b[0], a[1] = most, most, -most
        bound = int(max(sum(int(v) ** 2 for v in r) for r in [*a, *b]))
        assert bound <= 1 << 56
        primes = primes_for(bound + 1)
        got = exact_products(Residues(a, primes), Residues(b, primes), slice(0, 7), primes)
        assert got.tolist() == [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]


def test_sums_of_residues_stay_exact_in_float32():
    for p in primes_for(1 << 56):
        assert (1 << 24) // (p // 2) ** 2 * (p // 2) ** 2 <= 1 << 24 and p // 2 <= 512
    with pytest.raises(ValueError):
        primes_for(10**6, 3)


@pytest.mark.parametrize("cfg", [NegativeConfig(), NegativeConfig(block=20, chunk=3, step=2, residue=40)])
def test_against_all_pairs_with_ties_copies_and_odd_rows(spark, cfg):
    rng = np.random.default_rng(2)
    rows = [(i, [float(a) for a in rng.integers(-2, 5, 3) / 4], int(rng.integers(0, 3))) for i in range(200)]
    rows += [(300 + i, [1.0, 0.5, 0.25], 2) for i in range(40)] + [(400 + i, [0.75, 0.25, 0.25], 1) for i in range(30)]
    nan, inf = float("nan"), float("inf")
    rows += [(10, [0.5, 0.5, 0.1], 1)] * 2 + [(20, [1.0, 1.0, 1.0], 1), (500, None, 1), (501, [nan, 1.0, 1.0], 1), (502, [inf, 0.0, 0.0], 1), (503, [None, 1.0, 0.0], 1)]
    rows += [(510, [1.0, 1.0, 1.0], None), (None, [1.0, 1.0, 1.0], 1), (520, [1.0], 1), (530, [0.0, 0.0, 0.0], 1), (540, [1e300, 1.0, 1.0], 1), (550, [9e5, 1.0, 1.0], 1)]
    got = hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0, moved_label(), cfg)
    assert rows_of(got) == plain(rows, lambda i: i % 10 == 0, 3)


def test_nothing_to_find(spark):
    assert rows_of(hard_negatives(frame(spark, []), F.col("vec_id") % 10 == 0, moved_label())) == []
    one = [(i, [1.0, 2.0], 3) for i in (10, 11, 12)]
    assert rows_of(hard_negatives(frame(spark, one), F.col("vec_id") % 10 == 0, moved_label())) == []
