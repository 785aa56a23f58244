"""Tries of a compatible split: groups of any size, and groups that no order can split."""

import pytest
from pyspark.sql import functions as F

from flipside.operators import splits


def plain(rows, draw, eval_pos, tries):
    """The same group by group, from the definition."""
    out = {}
    for g in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == g]
        for t in range(tries + 1):
            order = sorted(mine, key=lambda r: (0.0 if t == 0 else draw[t, r[1]], r[1]))
            train, rest = {r[2] for r in order[:eval_pos]}, {r[2] for r in order[eval_pos:]}
            if train == rest and len(train) > 1:
                out |= {r[1]: (g, r[2], i, t) for i, r in enumerate(order)}
                break
        else:
            out |= {r[1]: (g, -100, i, tries + 1) for i, r in enumerate(sorted(mine, key=lambda r: r[1]))}
    return out


@pytest.fixture(scope="module")
def data(spark):
    rows = [(g, 100 * g + i, (i * 7 + g) % 3 if g % 4 else int(i > 5)) for g in range(12) for i in range(4 + g)]
    rows += [(20, 2000, None), (20, 2001, None), (20, 2002, 1), (20, 2003, 1), (20, 2004, 1), (20, 2005, None)]
    keys = spark.createDataFrame([(r[1],) for r in rows], "row_id long")
    drawn = keys.select("row_id", *[splits.uniform01(5 * 1000 + t, F.col("row_id")).alias(f"u{t}") for t in range(1, 5)]).collect()
    return rows, {(t, r["row_id"]): r[f"u{t}"] for r in drawn for t in range(1, 5)}


@pytest.mark.parametrize("group_rows", [100_000, 9, 0])
def test_tries_follow_the_definition_in_tasks_and_in_buckets(spark, data, monkeypatch, group_rows):
    rows, draw = data
    monkeypatch.setattr(splits, "GROUP_ROWS", group_rows)
    df = spark.createDataFrame(rows, "dataset_id long, row_id long, y int")
    got = splits.split_compatible_or_ignore(df, ["dataset_id"], "row_id", "y", 4, 5, 4).collect()
    assert {r["row_id"]: (r["dataset_id"], r["y"], r["pos"], r["try"]) for r in got} == plain(rows, draw, 4, 4)
    assert len(got) == len(rows)


def test_groups_that_no_order_can_split_are_not_shuffled_again(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(splits, "checkpointed", lambda df, keep=splits.checkpointed: tables.append(1) or keep(df))
    rows = [(1, i, int(i == 0)) for i in range(9)] + [(2, 100 + i, 1) for i in range(9)] + [(3, 200 + i, i % 2) for i in range(5)]
    df = spark.createDataFrame(rows, "dataset_id long, row_id long, y int")
    got = splits.split_compatible_or_ignore(df, ["dataset_id"], "row_id", "y", 4, 5).collect()
    assert {(r["y"], r["try"]) for r in got} == {(-100, splits.LABEL_TRIES + 1)} and len(got) == 23
    assert len(tables) == 3
