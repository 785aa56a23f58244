"""Global and per-group ordering without putting a whole group in one task.

For positions and running totals the order column is cut into value buckets
holding about the same number of rows each.  Bucket totals (a small table) give
every bucket its starting offset, and an ordinary window then works inside one
bucket at a time.  Bucket edges are plain literals, so both passes agree
whatever happens to the tasks; they decide balance only, never the result.

Exact quantiles take two passes: an approximate one brackets every wanted rank,
and a second one counts what lies outside and orders only what lies inside.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flipside.functions.fitted import attach, materialise
from flipside.functions.stats import total
from flipside.session import checkpointed

BUCKET = "__bucket"
ACCURACY = 5000  # of the approximate quantiles: ranks are off by 1/5000 of the rows at most


def bucket_count(spark: SparkSession) -> int:
    return max(8, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def value_buckets(df: DataFrame, col: str, buckets: int | None = None) -> DataFrame:
    """Add BUCKET: an order-preserving bucket number of numeric column `col`."""
    n = buckets or bucket_count(df.sparkSession)
    shares = F.array(*[F.lit(i / n) for i in range(1, n)])
    found = df.agg(F.percentile_approx(F.col(col).cast("double"), shares, F.lit(4 * n))).first()[0]
    splits = [float("-inf"), *sorted(set(found or [0.0])), float("inf")]
    cut = Bucketizer(splits=splits, inputCol="__v", outputCol=BUCKET, handleInvalid="keep")
    return cut.transform(df.withColumn("__v", F.col(col).cast("double"))).drop("__v")


def count_below(ordered: Column, x: Column, most: int, strict: bool = False) -> Column:
    """How many of the at most `most` members of an ascending array are <= x (< x if strict), by halving steps."""
    if most <= 8:  # short enough to ask each, in generated code
        asked = [(F.get(ordered, F.lit(i)) < x) if strict else (F.get(ordered, F.lit(i)) <= x) for i in range(most)]
        return total([F.coalesce(a, F.lit(False)).cast("int") for a in asked])
    steps = [1 << b for b in range(most.bit_length() - 1, -1, -1)]

    def step(at: Column, by: Column) -> Column:
        member = F.get(ordered, at + by - 1)
        return F.when((member < x) if strict else (member <= x), at + by).otherwise(at)

    return F.aggregate(F.array(*[F.lit(n) for n in steps]), F.lit(0), step)


def group_buckets(df: DataFrame, by: Sequence[str], col: str, buckets: int | None = None) -> DataFrame:
    """Add BUCKET: an order-preserving bucket number of `col` inside each group.

    Unlike with `value_buckets`, every group has its own edges, so features on
    different scales are all cut into buckets of about equal row counts.
    """
    n = buckets or bucket_count(df.sparkSession)
    shares = F.array(*[F.lit(i / n) for i in range(1, n)])
    edges = materialise(df.groupBy(*by).agg(F.percentile_approx(F.col(col).cast("double"), shares, F.lit(4 * n)).alias("__edges")))
    return attach(df, edges, by).withColumn(BUCKET, count_below(F.col("__edges"), F.col(col), n - 1).cast("double")).drop("__edges")


def uniform_buckets(df: DataFrame, unit: Column, buckets: int | None = None) -> DataFrame:
    """Add BUCKET for an order column known to be uniform on [0,1)."""
    n = buckets or bucket_count(df.sparkSession)
    return df.withColumn(BUCKET, F.floor(unit * F.lit(float(n))).cast("double"))


def running_totals(
    bucketed: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    sums: Mapping[str, Column],
) -> DataFrame:
    """Inclusive running sums `run_<name>` and group totals `all_<name>`.

    `bucketed` carries BUCKET; `order` must be unique inside a group.
    """
    by = list(by)
    df = bucketed.withColumns({f"__s_{k}": v for k, v in sums.items()})
    totals = df.groupBy(*by, BUCKET).agg(*[F.sum(f"__s_{k}").alias(f"__t_{k}") for k in sums])
    before = W.partitionBy(*by).orderBy(BUCKET).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*by)
    offsets = totals.select(
        *by,
        BUCKET,
        *[F.coalesce(F.sum(f"__t_{k}").over(before), F.lit(0)).alias(f"__o_{k}") for k in sums],
        *[F.sum(f"__t_{k}").over(whole).alias(f"all_{k}") for k in sums],
    )
    inside = W.partitionBy(*by, BUCKET).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = df.join(offsets, [*by, BUCKET])
    out = out.withColumns({f"run_{k}": F.col(f"__o_{k}") + F.sum(f"__s_{k}").over(inside) for k in sums})
    return out.drop(BUCKET, *[f"__s_{k}" for k in sums], *[f"__o_{k}" for k in sums])


def positions(df: DataFrame, by: Sequence[str], key: str, name: str = "pos", descending: bool = False) -> DataFrame:
    """Dense 0-based position of each row in its group, ordered by a unique numeric key."""
    order = F.col(key).desc() if descending else F.col(key).asc()
    src = df
    if descending:
        src = df.withColumn("__k", -F.col(key))
        order = F.col("__k").asc()
    out = running_totals(value_buckets(src, "__k" if descending else key), by, [order], {"n": F.lit(1)})
    out = out.withColumn(name, (F.col("run_n") - 1).cast("long")).withColumn(f"{name}_of", F.col("all_n").cast("long"))
    return out.drop("run_n", "all_n", "__k")


def shuffled_positions(df: DataFrame, by: Sequence[str], unit: Column, key: str, name: str = "pos") -> DataFrame:
    """Dense 0-based position in keyed-random order (ties on the draw broken by `key`)."""
    src = uniform_buckets(df.withColumn("__u", unit), F.col("__u"))
    out = running_totals(src, by, [F.col("__u"), F.col(key)], {"n": F.lit(1)})
    out = out.withColumn(name, (F.col("run_n") - 1).cast("long")).withColumn(f"{name}_of", F.col("all_n").cast("long"))
    return out.drop("run_n", "all_n", "__u")


def long_form(df: DataFrame, by: Sequence[str], cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One row per (row, feature): feat is the 0-based index into `cols`."""
    cells = F.explode(
        F.array(*[F.struct(F.lit(i).alias("feat"), F.col(c).cast("double").alias("value")) for i, c in enumerate(cols)])
    )
    picked = [c for c in [*by, *keep] if c != "feat"]
    return df.select(*picked, cells.alias("__cell")).select(*picked, "__cell.feat", "__cell.value")


def peer_ranks(df: DataFrame, by: Sequence[str], col: str, key: str, name: str = "rank", buckets: int | None = None) -> DataFrame:
    """Add `name`: the number of rows of the group whose `col` (never NULL) is at most the row's.

    Approximate quantiles are the edges of segments; a value that is an edge has
    a segment of its own, whose rows all share the segment's last place.  So a
    frequent value, which is an edge for sure, needs no order and is dealt by
    `key` over many tasks; only rows between two edges are ordered, a segment at
    a time.
    """
    by = list(by)
    n = buckets or bucket_count(df.sparkSession)
    shares = F.array(*[F.lit(i / n) for i in range(1, n)])
    edges = materialise(df.groupBy(*by).agg(F.percentile_approx(F.col(col).cast("double"), shares, F.lit(4 * n)).alias("__edges")))
    below, upto = (count_below(F.col("__edges"), F.col(col), n - 1, strict) for strict in (True, False))
    cut = attach(df, edges, by).withColumns({"__below": below, "__upto": upto})
    cut = cut.withColumns({"__seg": F.col("__below") + F.col("__upto"), "__level": F.col("__upto") > F.col("__below")}).drop("__edges", "__below", "__upto")
    sizes = cut.groupBy(*by, "__seg").agg(F.count(F.lit(1)).alias("n"))
    ends = sizes.withColumn("end", F.sum("n").over(W.partitionBy(*by).orderBy("__seg")))
    # One ascending list of segments and of their last places per group, two per edge at most.
    listed = ends.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("__seg", "end"))).alias("e"))
    places = materialise(listed.select(*by, F.col("e.__seg").alias("__segs"), F.col("e.end").alias("__ends")))
    deal = F.when(F.col("__level"), F.pmod(F.xxhash64(key), F.lit(n))).otherwise(F.lit(0).cast("long"))
    out = attach(cut, places, by).withColumns({"__i": count_below(F.col("__segs"), F.col("__seg"), 2 * n), "__deal": deal})
    out = out.withColumns({"__end": F.get("__ends", F.col("__i") - 1), "__start": F.coalesce(F.get("__ends", F.col("__i") - 2), F.lit(0))}).drop("__segs", "__ends", "__i")
    inside = W.partitionBy(*by, "__seg", "__deal").orderBy(col).rangeBetween(W.unboundedPreceding, W.currentRow)
    rank = F.when(F.col("__level"), F.col("__end")).otherwise(F.col("__start") + F.count(F.lit(1)).over(inside))
    return out.withColumn(name, rank).drop("__seg", "__start", "__end", "__deal", "__level")


def quantile_lists(df: DataFrame, by: Sequence[str], cols: Sequence[str], probs: Sequence[float], kind: str = "linear") -> tuple[DataFrame, DataFrame]:
    """The groups (by), and (by, feat, qs): the exact quantiles of every column that has values, as a map from the number of the probability."""
    groups, found = _quantile_rows(df, by, cols, probs, kind, [])
    return groups, found.groupBy(*by, "feat").agg(F.map_from_entries(F.collect_list(F.struct("number", "part"))).alias("qs"))


def _quantile_rows(df: DataFrame, by: Sequence[str], cols: Sequence[str], probs: Sequence[float], kind: str, stats: Sequence[Column]) -> tuple[DataFrame, DataFrame]:
    """The groups (by, stats), and a row per exact quantile (by, feat, number of the probability, part).

    kind='lower' gives the smallest value with cumulative share >= p;
    kind='linear' interpolates between the two neighbouring order statistics.

    Pass 1 brackets every wanted rank by approximate quantiles 2/ACCURACY to
    both sides.  Pass 2 keeps what lies inside a bracket and counts the rest,
    one row per value in either case, as a table; running counts, which read it
    twice, then meet the sorted list of wanted ranks.  `stats` are further aggregates, taken along in pass 1.
    """
    by, m = list(by), len(probs)
    order = sorted(range(m), key=lambda i: probs[i])
    asked = [float(probs[i]) for i in order]
    gap = 2.0 / ACCURACY
    shares = [max(0.0, p - gap) for p in asked] + [min(1.0, p + gap) for p in asked]
    wanted = F.array(*[F.lit(p) for p in shares])

    def ends(found: Column, first: int, is_open: list[bool], value: float) -> Column:
        flags = F.array(*[F.lit(x) for x in is_open])
        return F.transform(F.slice(found, first, m), lambda x, i: F.when(F.get(flags, i), F.lit(value)).otherwise(x))

    around = df.groupBy(*by).agg(*[F.percentile_approx(F.col(c).cast("double"), wanted, F.lit(ACCURACY)).alias(f"__a{j}") for j, c in enumerate(cols)], *stats)
    both = [
        found.alias(f"__{n}{j}")
        for j in range(len(cols))
        for n, found in (
            ("lo", ends(F.col(f"__a{j}"), 1, [x <= 0.0 for x in shares[:m]], float("-inf"))),
            ("hi", ends(F.col(f"__a{j}"), m + 1, [x >= 1.0 for x in shares[m:]], float("inf"))),
        )
    ]
    brackets = materialise(around.select(*by, *both, *[c for c in around.columns if c not in {*by, *[f"__a{j}" for j in range(len(cols))]}]))
    bounds = [f"__{n}{j}" for n in ("lo", "hi") for j in range(len(cols))]
    rows = attach(df.select(*by, *cols), brackets.select(*by, *bounds), by)
    # `lo` and `hi` ascend, so how many brackets begin at or below a value and how many end below it
    # place it; both only grow with the value.  They are taken before a row is cut into its values.
    places = {}
    for j, c in enumerate(cols):
        x = F.col(c).cast("double")
        places |= {f"__u{j}": count_below(F.col(f"__lo{j}"), x, m), f"__o{j}": count_below(F.col(f"__hi{j}"), x, m, strict=True)}
    rows = rows.withColumns(places).drop(*bounds)
    values = [F.struct(F.lit(j).alias("feat"), F.col(c).cast("double").alias("v"), F.col(f"__u{j}").alias("under"), F.col(f"__o{j}").alias("over")) for j, c in enumerate(cols)]
    cells = rows.select(*by, F.explode(F.array(*values)).alias("__c")).select(*by, "__c.*").filter("v is not null")
    keys = [*by, "feat"]
    # Values inside a bracket stay, equal ones merged; those between two brackets merge to their count and ends.
    cells = cells.withColumns({BUCKET: F.col("under") + F.col("over"), "value": F.when(F.col("under") > F.col("over"), F.col("v"))})
    merged = cells.groupBy(*keys, BUCKET, "value").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
    run = running_totals(checkpointed(merged), keys, [F.col("value")], {"n": F.col("n")})
    run = run.withColumns({"high": F.col("run_n") - 1, "low": F.col("run_n") - F.col("n")})
    p, last = F.array(*[F.lit(x) for x in asked]), F.col("all_n") - 1
    # 0-based wanted ranks, ascending, and what each gives to its probability.
    if kind == "lower":
        sides = [F.transform(p, lambda x: F.greatest(F.lit(1.0), F.ceil(x * (last + 1)).cast("double")).cast("long") - 1)]
    else:
        sides = [F.transform(p, lambda x: F.floor(x * last)), F.transform(p, lambda x: F.ceil(x * last))]
    met = run.withColumn("side", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), ks.alias("ks")) for i, ks in enumerate(sides)])))
    met = met.withColumns({"up": F.col("side.i") == 1, "ks": F.col("side.ks")}).drop("side")
    met = met.withColumns({"first": count_below(F.col("ks"), F.col("low"), m, strict=True), "upto": count_below(F.col("ks"), F.col("high"), m)}).filter("upto > first")
    met = met.withColumn("q", F.explode(F.sequence(F.col("first"), F.col("upto") - 1)))
    value = F.when(F.get("ks", F.col("q")) == F.col("low"), F.col("least")).otherwise(F.col("most"))
    place = F.get(p, F.col("q")) * last
    met = met.select(*keys, "q", "up", value.alias("value"), (place - F.floor(place)).alias("over"))
    # Two rows per quantile: laid out by group once, for this and what the callers group by.
    met = met.repartition(*by) if by else met.coalesce(1)
    pair = met.groupBy(*keys, "q").agg(F.max(F.when(~F.col("up"), F.col("value"))).alias("down"), F.max(F.when(F.col("up"), F.col("value"))).alias("above"), F.max("over").alias("over"))
    if kind == "lower":
        part = F.col("down")
    else:
        # Equal neighbours give their value itself, not a rounded mixture.
        mixed = F.col("down") * (1.0 - F.col("over")) + F.col("above") * F.col("over")
        part = F.when((F.col("down") == F.col("above")) | (F.col("over") == 0), F.col("down")).otherwise(mixed)
    number = F.element_at(F.array(*[F.lit(i) for i in order]), F.col("q") + 1)
    return brackets.drop(*bounds), pair.select(*keys, number.alias("number"), part.alias("part"))


def exact_quantiles(
    df: DataFrame,
    by: Sequence[str],
    cols: Sequence[str],
    probs: Sequence[float],
    kind: str = "linear",
    stats: Sequence[Column] = (),
) -> DataFrame:
    """Exact quantiles of many columns: one row per group, columns `<col>_q<i>`, and further aggregates `stats`."""
    by, m = list(by), len(probs)
    groups, found = _quantile_rows(df, by, cols, probs, kind, stats)
    entry = F.struct((F.col("feat") * m + F.col("number")).alias("k"), "part")
    out = found.groupBy(*by).agg(F.map_from_entries(F.collect_list(entry)).alias("__qs"))
    out = out.select(*by, *[F.col("__qs")[j * m + i].alias(f"{c}_q{i}") for j, c in enumerate(cols) for i in range(m)])
    # Groups whose values are all unknown keep their row.
    if by:
        return groups.join(out, by, "left")
    return attach(out, groups, by) if stats else out
