"""Reports that put several operators together."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flipside.functions.fitted import attach
from flipside.operators.pair_metrics import pair_distances
from flipside.operators.perturb import STRATEGIES, PerturbConfig, Score, classified, fit_spread, moved, slopes, with_donors
from flipside.session import checkpointed

_NUMBERS = ("p", "magnitude", "step", "k")


def sweep(rows: DataFrame, features: Sequence[str], by: Sequence[str], strategies: Sequence[str], configs: Mapping[str, PerturbConfig], repeats: int, score: Score, threshold: DataFrame | float, spread: DataFrame | None = None) -> DataFrame:
    """One report row per strategy x variant x repeat.

    What a row has in every setting (spread, factual class, slopes) is made
    once and kept as a table.  Each strategy reads it, repeats the rows per
    (variant, repeat) with the settings as columns, and builds all its cells in
    one projection, which so stays short enough to be compiled.
    """
    first = next(iter(configs.values()))
    base = attach(rows.select(*by, *first.key, *features), spread if spread is not None else fit_spread(rows, features, by), by)
    base = attach(base, threshold, by) if isinstance(threshold, DataFrame) else base.withColumn("threshold", F.lit(float(threshold)))
    base = classified(base, features, score, "f", F.col("threshold"))
    if any(STRATEGIES[s].slope for s in strategies):
        base = base.withColumns(slopes(features, first.score))
    base = checkpointed(base)

    settings = [(v, rep, c) for v, c in configs.items() for rep in range(repeats)]
    entries = [F.struct(F.lit(i).alias("cell"), *[F.lit(float(getattr(c, n))).alias(n) for n in _NUMBERS]) for i, (_, _, c) in enumerate(settings)]

    def repeated(df: DataFrame) -> DataFrame:
        out = df.withColumn("__set", F.explode(F.array(*entries)))
        return out.withColumns({f"__{n}": F.col(f"__set.{n}") for n in ("cell", *_NUMBERS)}).drop("__set")

    cell = replace(first, salt=F.col("__cell"), **{n: F.col(f"__{n}") for n in _NUMBERS})
    cells = None
    for number, strategy in enumerate(strategies):
        if STRATEGIES[strategy].needs == "donor":
            # Donors are drawn per cell, so positions are taken before the rows are repeated.
            src = with_donors(base, features, by, cell, repeated)
        else:
            src = repeated(base)
        made = classified(moved(src, features, strategy, cell), features, score, "cf", F.col("threshold"))
        one = pair_distances(made, features).select(
            F.lit(number).alias("__strategy"),
            "__cell",
            (F.col("y_f_class") != F.col("y_cf_class")).cast("double").alias("flip"),
            "l1",
            "l2",
            "changed_share",
        )
        cells = one if cells is None else cells.unionByName(one)
    report = cells.groupBy("__strategy", "__cell").agg(
        F.avg("flip").alias("validity"),
        F.count(F.lit(1)).alias("n"),
        F.avg("l1").alias("l1"),
        F.avg("l2").alias("l2"),
        F.avg("changed_share").alias("changed"),
    )
    names = {
        "strategy": F.get(F.array(*[F.lit(s) for s in strategies]), F.col("__strategy")),
        "variant": F.get(F.array(*[F.lit(v) for v, _, _ in settings]), F.col("__cell")),
        "repeat": F.get(F.array(*[F.lit(rep) for _, rep, _ in settings]), F.col("__cell")),
    }
    return report.select(*[c.alias(n) for n, c in names.items()], "validity", "n", "l1", "l2", "changed")
