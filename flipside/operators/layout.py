"""Context/query layout of pairs, and the context ablation built from it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flipside.functions.fitted import attach, drop_params, fit
from flipside.functions.keyed import rand_normal
from flipside.functions.ranks import positions, running_totals, value_buckets
from flipside.session import checkpointed

# Fixed value: deviation of the jitter on repeated query rows.
JITTER_SD = 0.01


Places = int | Callable[[Column, Column], Column]


def context_query_layout(pairs: DataFrame, features: Sequence[str], eval_pos: Places, n_query: Places, by: Sequence[str] = ("dataset_id",), key: str = "row_id", flip_only: bool = True, seed: int = 42) -> DataFrame:
    """Give each row its place: pos < eval_pos is context, the rest query.

    Flipped rows go first to the query slots, the others first to the context.
    Three cases per dataset: enough flipped rows; too few, so they are repeated
    in turn with a little jitter on x; none (or flip_only off), so non-flipped
    rows fill up the queries.  y is the factual class in context rows and the
    counterfactual class in query rows.

    `eval_pos` and `n_query` are numbers, or functions of a dataset's counts of
    flipped and other rows.  Rows beyond the places asked for have none.
    """
    by = list(by)
    ordered = positions(pairs, [*by, "label_flipped"], key, "__i")
    sizes = fit(
        pairs,
        by,
        [
            F.sum(F.col("label_flipped").cast("long")).alias("__flipped"),
            F.sum((~F.col("label_flipped")).cast("long")).alias("__kept"),
        ],
    )
    rows = attach(ordered, sizes, by)
    i, nf, nk = F.col("__i"), F.col("__flipped"), F.col("__kept")
    q, c = (p(nf, nk).cast("long") if callable(p) else F.lit(p) for p in (n_query, eval_pos))
    enough = nf >= q
    cycling = ~enough & F.lit(flip_only) & (nf > 0)
    fill = q - nf  # query slots that non-flipped rows take when not cycling

    def keep(place: Column, limit: Column) -> Column:
        return F.when(place < limit, place)

    context_slot = (
        F.when(enough & ~F.col("label_flipped"), keep(i, c))
        .when(enough & F.col("label_flipped") & (i >= q), keep(nk + i - q, c))
        .when(cycling & ~F.col("label_flipped"), keep(i, c))
        .when(~enough & ~cycling & ~F.col("label_flipped") & (i >= fill), keep(i - fill, c))
    )
    query_slot = (
        F.when(enough & F.col("label_flipped"), keep(i, q))
        .when(cycling & F.col("label_flipped"), i)
        .when(~enough & ~cycling & F.col("label_flipped"), i)
        .when(~enough & ~cycling & ~F.col("label_flipped") & (i < fill), nf + i)
    )
    # Cycling: the i-th flipped row serves the slots i, i+n, i+2n, ...
    slots = F.when(cycling & F.col("label_flipped"), F.sequence(i, q - 1, nf)).otherwise(F.array(query_slot))
    placed = rows.withColumns({"__c": context_slot, "__q": query_slot, "__slots": slots}).filter(
        F.col("__c").isNotNull() | F.col("__q").isNotNull()
    )
    placed = placed.withColumn("__slot", F.explode(F.when(F.col("__q").isNotNull(), F.col("__slots")).otherwise(F.array(F.col("__c")))))
    is_query = F.col("__q").isNotNull()
    repeat = is_query & (F.col("__slot") >= nf) & cycling
    jitter = {
        f: F.when(repeat, F.col(f) + rand_normal(0.0, JITTER_SD, seed, F.col(key), f, F.col("__slot"), "jitter")).otherwise(F.col(f))
        for f in features
    }
    out = placed.withColumns(
        {
            **jitter,
            "pos": F.when(is_query, F.col("__slot") + c).otherwise(F.col("__slot")).cast("int"),
            "role": F.when(is_query, F.lit("query")).otherwise(F.lit("context")),
            "y": F.when(is_query, F.col("y_cf_class")).otherwise(F.col("y_f_class")),
        }
    )
    return drop_params(out, sizes, by).drop("__i", "__i_of", "__c", "__q", "__slots", "__slot")


def encode_targets(features: Sequence[str], mask_supervision: bool = True) -> Column:
    """Target array: delta, or delta followed by the mask as 0/1."""
    delta = [F.col(f"d_{f}") for f in features]
    mask = [F.col(f"m_{f}").cast("double") for f in features] if mask_supervision else []
    return F.array(*delta, *mask)


def source_row_map(layout: DataFrame, by: Sequence[str] = ("dataset_id",), key: str = "row_id") -> DataFrame:
    return layout.filter(F.col("role") == "query").select(*by, "pos", F.col(key).alias("source_row"))


def context_ablation(layout: DataFrame, payload: Sequence[str], by: str = "dataset_id", random_seed: int | None = None) -> DataFrame:
    """Three variants per dataset: its own context, another dataset's context
    (the next one, or a keyed-random other one), and context labels set to 0."""
    from flipside.functions.keyed import text_uniform01

    # Datasets are numbered in order, in value buckets: names by the number that their first six bytes make.
    named = layout.schema[by].dataType.typeName() == "string"
    head = F.conv(F.rpad(F.hex(F.substring(F.col(by).cast("binary"), 1, 6)), 12, "0"), 16, 10) if named else F.col(by)
    ids = layout.select(by).distinct().withColumn("__head", head.cast("double"))
    n = ids.count()
    ranked = running_totals(value_buckets(ids, "__head"), [], [F.col(by)], {"n": F.lit(1)})
    numbered = checkpointed(ranked.select(by, (F.col("run_n") - 1).alias("q")))
    step = F.lit(1) if random_seed is None else F.lit(1) + F.floor(text_uniform01(random_seed, F.col(by), "other") * F.lit(n - 1))
    partner = numbered.withColumn("w", F.pmod(F.col("q") + step, F.lit(n))).select(by, "w").join(
        numbered.select(F.col(by).alias("__other"), F.col("q").alias("w")), "w"
    ).select(F.col(by).alias("__for"), F.col("__other").alias(by))
    cols = [by, "pos", "role", "y", *payload]
    base = layout.select(*cols)
    context, query = base.filter(F.col("role") == "context"), base.filter(F.col("role") == "query")
    swapped = context.join(partner, by).select(F.col("__for").alias(by), *cols[1:])
    return (
        base.withColumn("variant", F.lit("correct"))
        .unionByName(swapped.unionByName(query).withColumn("variant", F.lit("wrong")))
        .unionByName(
            context.withColumn("y", F.lit(0)).unionByName(query).withColumn("variant", F.lit("none"))
        )
    )
