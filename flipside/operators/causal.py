"""Abduction and do-interventions on equations declared by the user.

``equations`` maps node -> function of its parents: ``{"f_1": lambda at: ...}``,
in topological order.  Nodes without an equation are roots.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flipside.functions.fitted import attach, drop_params
from flipside.operators.perturb import Score

Equations = Mapping[str, Callable[[Mapping[str, Column]], Column]]


def abduct(df: DataFrame, nodes: Sequence[str], equations: Equations) -> DataFrame:
    """Add u_<node> = observed - f(parents) for every node with an equation."""
    at = {n: F.col(n) for n in nodes}
    return df.withColumns({f"u_{n}": F.col(n) - f(at) for n, f in equations.items()})


def do_intervene(df: DataFrame, nodes: Sequence[str], equations: Equations, values: Mapping[str, Column], scope: str = "row", prefix: str = "cf_") -> DataFrame:
    """Replay the equations with the abducted noise and some nodes set.

    `values[n]` is the value a node is set to; NULL means "not set in this row".
    scope='row' sets only those rows.  scope='column' sets the node in every
    row (to its factual value where no new value is given), so its downstream
    effect is cut off everywhere.
    """
    out = df
    for n in nodes:
        done = {m: F.col(f"{prefix}{m}") for m in nodes[: list(nodes).index(n)]}
        natural = F.col(n)
        if n in equations:
            natural = equations[n](done) + F.col(f"u_{n}")
        if n in values:
            natural = F.coalesce(values[n], F.col(n) if scope == "column" else natural)
        out = out.withColumn(f"{prefix}{n}", natural)
    return out


def rescore_validity(pred: DataFrame, features: Sequence[str], score: Score, threshold: DataFrame | float, by: Sequence[str], stats: DataFrame | None = None, delta: str = "p_", target: str = "target_label") -> DataFrame:
    """Share of predicted counterfactuals whose replayed class is the target.

    x_cf = x + predicted delta, brought back to raw units with the frozen
    stats; every feature is set, so replaying is one projection per row.
    """
    out = pred.withColumns({f"__x_{f}": F.col(f) + F.col(f"{delta}{f}") for f in features})
    if stats is not None:
        out = attach(out, stats, by)
        out = out.withColumns({f"__x_{f}": F.col(f"__x_{f}") * F.col(f"{f}_sd") + F.col(f"{f}_mu") for f in features})
        out = drop_params(out, stats, by)
    out = out.withColumn("__y", score({f: F.col(f"__x_{f}") for f in features}))
    if isinstance(threshold, DataFrame):
        out, t = attach(out, threshold, by), F.col("threshold")
    else:
        t = F.lit(float(threshold))
    hit = ((F.col("__y") > t).cast("int") == F.col(target)).cast("int")
    return out.groupBy(*by).agg(
        F.avg(hit).alias("validity"), F.sum(hit).cast("long").alias("n_valid"), F.count(F.lit(1)).alias("n_points")
    )
