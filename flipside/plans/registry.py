"""Where the runnable queries and their SQL checks are kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def r6(col: str | Column, name: str | None = None, digits: int = 6) -> Column:
    """Rounded for comparison; adding 0 turns -0 into 0."""
    c = F.col(col) if isinstance(col, str) else col
    out = F.round(c, digits) + F.lit(0.0)
    if name is None and isinstance(col, str):
        name = col
    return out.alias(name) if name else out


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column."""
    return df.select(*[r6(c, c, digits) if t == "double" else F.col(c) for c, t in df.dtypes])


def R(expr: str, name: str, digits: int = 6) -> str:
    return f"round({expr}, {digits})+0.0::double as {name}"


def load_all() -> None:
    import importlib

    for module in (
        "sources",
        "catalog",
        "splits",
        "missing",
        "transforms",
        "labels",
        "whatif",
        "pairmetrics",
        "profile",
        "plausibility",
        "metrics",
        "leaderboard",
        "ensemble",
        "models",
        "streams",
    ):
        importlib.import_module(f"flipside.plans.queries.{module}")
