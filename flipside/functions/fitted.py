"""Fit/apply: statistics computed once, then joined back to the rows.

A parameter table has one row per group.  It is computed and persisted when it
is fitted, so Spark knows its real size when it plans the join: small tables
are broadcast, larger ones go through a sort-merge join with AQE's skew split.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def materialise(params: DataFrame) -> DataFrame:
    kept = params.persist(StorageLevel.MEMORY_AND_DISK)
    kept.count()
    return kept


def fit(df: DataFrame, by: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    return materialise(df.groupBy(*by).agg(*aggs))


def attach(df: DataFrame, params: DataFrame, by: Sequence[str]) -> DataFrame:
    """Add the parameter columns to every row of its group."""
    by = list(by)
    if not by:
        row = params.first()
        schema = {f.name: f.dataType for f in params.schema.fields}
        values = row.asDict() if row is not None else {}
        return df.withColumns({c: F.lit(values.get(c)).cast(t) for c, t in schema.items()})
    return df.join(params, by, "left")


def attach_draws(df: DataFrame, by: Sequence[str], draws: Mapping[str, Column]) -> DataFrame:
    """Add columns that depend on the group alone, made once per group and not once per row.

    Unlike a statistic, a draw is also there for the group of rows whose key is NULL.
    """
    by = list(by)
    if not by:
        return df.withColumns(dict(draws))
    made = materialise(df.select(*by).distinct().withColumns(dict(draws)))
    keys = {b: f"__of_{i}" for i, b in enumerate(by)}
    same = reduce(and_, [F.col(b).eqNullSafe(F.col(k)) for b, k in keys.items()])
    return df.join(made.withColumnsRenamed(keys), same, "left").drop(*keys.values())


def where_fit(col: str | Column, fit_on: Column | None) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return c if fit_on is None else F.when(fit_on, c)


def drop_params(df: DataFrame, params: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.drop(*[c for c in params.columns if c not in set(by)])
