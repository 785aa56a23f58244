"""Feature transforms: fit on some rows (`fit_on`), apply to all of them.

`by` is the list of group keys (normally the dataset); `fit_on` is a boolean
Column such as ``F.col("pos") < 500``; None fits on every row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flipside.functions.fitted import attach, drop_params, fit, materialise, where_fit
from flipside.functions.ranks import count_below, exact_quantiles, long_form, peer_ranks, quantile_lists
from flipside.functions.stats import array_sum, let, normal_icdf
from flipside.session import checkpointed

# Fixed values.
STD_EPS = 1e-6
Z_CLIP = 100.0
IQR_UNIT = 1.3489795003921634  # distance between the quartiles of N(0,1)


def _mean_std(cols: Sequence[str], fit_on: Column | None) -> list[Column]:
    return [
        agg(where_fit(c, fit_on)).alias(f"{c}_{name}")
        for c in cols
        for name, agg in (("mu", F.avg), ("sd", F.stddev_samp))
    ]


def _clip(x: Column, low: Column | float, high: Column | float) -> Column:
    lo = low if isinstance(low, Column) else F.lit(float(low))
    hi = high if isinstance(high, Column) else F.lit(float(high))
    return F.when(x < lo, lo).when(x > hi, hi).otherwise(x)


def zscore(df: DataFrame, cols: Sequence[str], by: Sequence[str], fit_on: Column | None = None, clip: float | None = Z_CLIP, params: DataFrame | None = None) -> DataFrame:
    """(x-mean)/(std+1e-6), clipped; NULL stays NULL."""
    stats = params if params is not None else fit(df, by, _mean_std(cols, fit_on))
    out = attach(df, stats, by)

    def z(c: str) -> Column:
        v = (F.col(c) - F.col(f"{c}_mu")) / (F.col(f"{c}_sd") + F.lit(STD_EPS))
        return v if clip is None else _clip(v, -clip, clip)

    return drop_params(out.withColumns({c: z(c) for c in cols}), stats, by)


def fit_zscore(df: DataFrame, cols: Sequence[str], by: Sequence[str], fit_on: Column | None = None) -> DataFrame:
    return fit(df, by, _mean_std(cols, fit_on))


def soft_clip_outliers(df: DataFrame, cols: Sequence[str], by: Sequence[str], n_sigma: float = 4.0, fit_on: Column | None = None) -> DataFrame:
    """Pull values beyond n sigma back logarithmically.

    The limits come from a second pass that leaves out the first pass's
    outliers; the upper side works on the already adjusted value.
    """
    first = fit(df, by, _mean_std(cols, fit_on))
    tagged = attach(df, first, by)

    def inside(c: str) -> Column:
        reach = F.col(f"{c}_sd") * F.lit(float(n_sigma))
        ok = (F.col(c) <= F.col(f"{c}_mu") + reach) & (F.col(c) >= F.col(f"{c}_mu") - reach)
        ok = ok if fit_on is None else ok & fit_on
        return F.when(ok, F.col(c))

    second = fit(
        tagged,
        by,
        [
            agg(inside(c)).alias(f"{c}_{name}")
            for c in cols
            for name, agg in (("mu2", F.avg), ("sd2", F.stddev_samp))
        ],
    )
    out = attach(df, second, by)

    def bounded(c: str) -> tuple[Column, Column]:
        reach = F.col(f"{c}_sd2") * F.lit(float(n_sigma))
        return F.col(f"{c}_mu2") - reach, F.col(f"{c}_mu2") + reach

    lifted = {}
    for c in cols:
        floor = -F.log(F.lit(1.0) + F.abs(F.col(c))) + bounded(c)[0]
        lifted[c] = F.when(floor > F.col(c), floor).otherwise(F.col(c))
    out = out.withColumns(lifted)
    lowered = {}
    for c in cols:
        roof = F.log(F.lit(1.0) + F.abs(F.col(c))) + bounded(c)[1]
        lowered[c] = F.when(roof < F.col(c), roof).otherwise(F.col(c))
    return drop_params(out.withColumns(lowered), second, by)


def to_ranking(df: DataFrame, cols: Sequence[str], by: Sequence[str], key: str) -> DataFrame:
    """Long form (by, key, feat, value, rank): rank = number of rows with value <= x.

    Frequent values have a place of their own and are dealt over many tasks.
    """
    cells = long_form(df, by, cols, [key]).filter(F.col("value").isNotNull())
    return peer_ranks(cells, [*by, "feat"], "value", key)


def minmax(df: DataFrame, cols: Sequence[str], by: Sequence[str], fit_on: Column | None = None) -> DataFrame:
    """(x-min)/(max-min); NULL when the range is 0."""
    stats = fit(
        df,
        by,
        [agg(where_fit(c, fit_on)).alias(f"{c}_{name}") for c in cols for name, agg in (("lo", F.min), ("hi", F.max))],
    )

    def scaled(c: str) -> Column:
        span = F.col(f"{c}_hi") - F.col(f"{c}_lo")
        return F.when(span != 0, (F.col(c) - F.col(f"{c}_lo")) / span)

    out = attach(df, stats, by).withColumns({c: scaled(c) for c in cols})
    return drop_params(out, stats, by)


def robust_scale(df: DataFrame, cols: Sequence[str], by: Sequence[str], fit_on: Column | None = None) -> DataFrame:
    """(x-median)/(IQR/1.349): unit variance for normal data."""
    rows = df if fit_on is None else df.filter(fit_on)
    stats = materialise(exact_quantiles(rows, by, cols, [0.25, 0.5, 0.75]))

    def scaled(c: str) -> Column:
        unit = (F.col(f"{c}_q2") - F.col(f"{c}_q0")) / F.lit(IQR_UNIT)
        return F.when(unit != 0, (F.col(c) - F.col(f"{c}_q1")) / unit)

    out = attach(df, stats, by).withColumns({c: scaled(c) for c in cols})
    return drop_params(out, stats, by)


def yeo_johnson(x: Column, lam: Column | float) -> Column:
    lm = lam if isinstance(lam, Column) else F.lit(float(lam))
    up = F.when(F.abs(lm) > 1e-12, (F.pow(x + 1.0, lm) - 1.0) / lm).otherwise(F.log1p(x))
    two = F.lit(2.0) - lm
    down = F.when(F.abs(two) > 1e-12, -(F.pow(F.lit(1.0) - x, two) - 1.0) / two).otherwise(-F.log1p(-x))
    return F.when(x >= 0, up).otherwise(down)


def fit_power(df: DataFrame, cols: Sequence[str], by: Sequence[str], fit_on: Column | None = None, rounds: int = 4, grid: int = 17, reach: float = 4.0) -> DataFrame:
    """Maximum-likelihood Yeo-Johnson lambda per (group, feature).

    Each round scores a whole grid of candidates for every feature in one
    aggregate, then narrows the grid around the best one.
    """
    rows = df if fit_on is None else df.filter(fit_on)
    keys = [*by, "feat"]
    # All rounds read one table of the logarithms: a power is then one exponential.
    x = F.col("value")
    cells = long_form(rows, by, cols).filter(x.isNotNull())
    cells = checkpointed(cells.select(*keys, F.log1p(F.abs(x)).alias("log"), F.when(x >= 0, F.lit(1.0)).otherwise(F.lit(-1.0)).alias("side")))

    def transformed(lam: Column) -> Column:
        """yeo_johnson of the value; values below 0 go the same way with 2 - lambda, turned round."""
        power = F.when(F.col("side") > 0, lam).otherwise(F.lit(2.0) - lam)
        flat = F.abs(power) <= 1e-12
        return F.col("side") * F.when(flat, F.col("log")).otherwise((F.exp(power * F.col("log")) - 1.0) / F.when(flat, F.lit(1.0)).otherwise(power))

    best, width = None, reach
    for _ in range(rounds):
        step = 2.0 * width / (grid - 1)
        src = cells.withColumn("centre", F.lit(0.5)) if best is None else attach(cells, best, keys)
        lams = [F.col("centre") + F.lit(-width + step * i) for i in range(grid)]
        scored = src.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n"),
            F.first("centre").alias("centre"),
            F.sum(F.col("side") * F.col("log")).alias("slog"),
            *[F.var_pop(transformed(lam)).alias(f"var{i}") for i, lam in enumerate(lams)],
        )

        def tried(i: int, lam: Column) -> Column:
            ll = -F.col("n") / 2.0 * F.log(F.col(f"var{i}")) + (lam - 1.0) * F.col("slog")
            return F.when(F.col(f"var{i}") > 0, F.struct(ll.alias("ll"), lam.alias("lam")))

        found = F.array_max(F.array(*[tried(i, lam) for i, lam in enumerate(lams)]))
        best = materialise(scored.select(*keys, found["lam"].alias("centre")).filter("centre is not null"))
        width = step
    return best.select(*keys, F.col("centre").alias("lam"))


def power_transform(df: DataFrame, cols: Sequence[str], by: Sequence[str], fit_on: Column | None = None, lambdas: Sequence[float] | None = None) -> DataFrame:
    """Yeo-Johnson, then standardise with the deviation over the population."""
    out = df
    if lambdas is not None:
        out = out.withColumns({c: yeo_johnson(F.col(c), lam) for c, lam in zip(cols, lambdas)})
    else:
        lam = fit_power(df, cols, by, fit_on)
        wide = materialise(
            lam.groupBy(*by).agg(*[F.max(F.when(F.col("feat") == i, F.col("lam"))).alias(f"{c}_lam") for i, c in enumerate(cols)])
        )
        out = attach(out, wide, by).withColumns({c: yeo_johnson(F.col(c), F.col(f"{c}_lam")) for c in cols})
        out = drop_params(out, wide, by)
    stats = fit(
        out,
        by,
        [agg(where_fit(c, fit_on)).alias(f"{c}_{n}") for c in cols for n, agg in (("mu", F.avg), ("sp", F.stddev_pop))],
    )
    res = attach(out, stats, by).withColumns(
        {
            c: (F.col(c) - F.col(f"{c}_mu")) / F.when(F.col(f"{c}_sp") == 0, F.lit(1.0)).otherwise(F.col(f"{c}_sp"))
            for c in cols
        }
    )
    return drop_params(res, stats, by)


def quantile_normal(df: DataFrame, cols: Sequence[str], by: Sequence[str], fit_on: Column | None = None, n_quantiles: int = 100) -> DataFrame:
    """Map each value to its share among the train quantiles, then to a normal score.

    Scores are clipped at the shares 1e-7 and 1-1e-7.  On a flat stretch of
    equal quantiles the middle share is used.
    """
    probs = [i / (n_quantiles - 1) for i in range(n_quantiles)]
    rows = df if fit_on is None else df.filter(fit_on)
    groups, lists = quantile_lists(rows, by, cols, probs)
    listed = F.transform(F.sequence(F.lit(0), F.lit(n_quantiles - 1)), lambda i: F.element_at("qs", i))
    wide = lists.groupBy(*by).agg(*[F.first(F.when(F.col("feat") == j, listed), ignorenulls=True).alias(f"{c}_qs") for j, c in enumerate(cols)])
    stats = materialise(groups.join(wide, list(by), "left") if by else wide)

    last = n_quantiles - 1

    def share(c: str) -> Column:
        qs, x, below, upto = F.col(f"{c}_qs"), F.col(c), F.col(f"{c}_below"), F.col(f"{c}_upto")
        left = F.element_at(qs, F.greatest(below, F.lit(1)))
        right = F.element_at(qs, F.least(below + 1, F.lit(n_quantiles)))
        between = (below - 1 + (x - left) / (right - left)) / F.lit(float(last))
        flat = (below + upto - 1) / F.lit(2.0 * last)
        return (
            F.when(x.isNull() | qs.isNull(), F.lit(None).cast("double"))
            .when(below == 0, F.when(upto == 0, F.lit(0.0)).otherwise(flat))
            .when(below == n_quantiles, F.lit(1.0))
            .when(upto > below, flat)
            .otherwise(between)
        )

    placed = attach(df, stats, by).withColumns(
        {f"{c}_{n}": count_below(F.col(f"{c}_qs"), F.col(c), n_quantiles, n == "below") for c in cols for n in ("below", "upto")}
    )
    placed = placed.withColumns({c: _clip(share(c), 1e-7, 1 - 1e-7) for c in cols})
    out = placed.withColumns({c: normal_icdf(F.col(c)) for c in cols})
    return drop_params(out.drop(*[f"{c}_{n}" for c in cols for n in ("below", "upto")]), stats, by)


def one_hot(df: DataFrame, col: str, fit_on: Column | None = None) -> DataFrame:
    """Replace `col` by one 0/1 column per category seen in the fit rows.

    The wide form: the result has as many columns as there are categories, so
    their list is what the plan needs on the driver.  For many categories use
    `category_index` with `one_hot_sparse`.
    """
    rows = df if fit_on is None else df.filter(fit_on)
    cats = sorted(r[0] for r in rows.select(col).filter(F.col(col).isNotNull()).distinct().collect())
    flags = {f"{col}_{i}": F.coalesce((F.col(col) == F.lit(v)).cast("double"), F.lit(0.0)) for i, v in enumerate(cats)}
    return df.withColumns(flags).drop(col)


def category_index(df: DataFrame, col: str, fit_on: Column | None = None) -> DataFrame:
    """(col, index): the categories of the fit rows in order, numbered from 0; a table, however many there are.

    Sorted parts number their own rows, and the parts' counts give where each begins.
    """
    rows = df if fit_on is None else df.filter(fit_on)
    mark = F.monotonically_increasing_id()  # part number in the high bits, row number in the low 33
    sorted_rows = checkpointed(rows.select(col).filter(F.col(col).isNotNull()).distinct().orderBy(col).select(col, F.shiftright(mark, 33).alias("__p"), mark.bitwiseAND(F.lit((1 << 33) - 1)).alias("__r")))
    sizes = sorted_rows.groupBy("__p").agg(F.count(F.lit(1)).alias("n"))
    before = W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    starts = materialise(sizes.select("__p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__s")))
    return sorted_rows.join(starts, "__p").select(col, (F.col("__s") + F.col("__r")).cast("long").alias("index"))


def one_hot_sparse(df: DataFrame, col: str, index: DataFrame, name: str | None = None) -> DataFrame:
    """Replace `col` by a sparse vector (size, indices, values); a missing or unseen category has no entry."""
    size = index.count()
    hit = F.col("__index").isNotNull()
    none = F.array().cast("array<bigint>"), F.array().cast("array<double>")
    entry = F.when(hit, F.array("__index")).otherwise(none[0]), F.when(hit, F.array(F.lit(1.0))).otherwise(none[1])
    out = df.join(index.withColumnRenamed("index", "__index"), col, "left")
    return out.withColumn(name or f"{col}_hot", F.struct(F.lit(size).cast("long").alias("size"), entry[0].alias("indices"), entry[1].alias("values"))).drop(col, "__index")


def label_codes(df: DataFrame, label: str, by: Sequence[str] = (), ignore: int | None = None, name: str = "code") -> DataFrame:
    """Lookup (by, label, code): sorted distinct labels -> 0..K-1.

    The lookup has one row per distinct label, whatever the row count.
    """
    rows = df.filter(F.col(label).isNotNull())
    if ignore is not None:
        rows = rows.filter(F.col(label) != ignore)

    distinct = rows.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
    order = W.partitionBy(*by).orderBy(label)
    return materialise(distinct.select(*by, label, (F.dense_rank().over(order) - 1).alias(name)))


def label_encode(df: DataFrame, label: str, name: str = "y") -> tuple[DataFrame, DataFrame]:
    """Encode labels as 0..K-1; returns the rows and the lookup (label, code)."""
    lookup = label_codes(df, label, name=name)
    if lookup.limit(2).count() < 2:
        raise ValueError("a label needs two different values at least")
    return df.join(lookup, [label], "left"), lookup


def normalize_labels(df: DataFrame, label: str, by: Sequence[str], ignore: int = -100, shift: int = 0, name: str = "y") -> DataFrame:
    """Per group: number of distinct smaller labels; -100 is left alone.

    With `shift` the codes are rotated modulo the number of classes.
    """
    lookup = label_codes(df, label, by, ignore, name="__c")
    if shift:
        sizes = materialise(lookup.groupBy(*by).agg((F.max("__c") + 1).alias("__k")))
        lookup = materialise(attach(lookup, sizes, by).withColumn("__c", F.pmod(F.col("__c") + shift, F.col("__k"))).drop("__k"))
    out = df.join(lookup, [*by, label], "left")
    return out.withColumn(name, F.when(F.col(label) == ignore, F.lit(ignore)).otherwise(F.col("__c"))).drop("__c")


def varying_features(df: DataFrame, cols: Sequence[str], fit_on: Column | None = None) -> list[str]:
    row = df.agg(*[(F.min(where_fit(c, fit_on)) != F.max(where_fit(c, fit_on))).alias(c) for c in cols]).first()
    return [c for c in cols if row[c]]


def drop_constant_features(df: DataFrame, cols: Sequence[str], fit_on: Column | None = None) -> DataFrame:
    kept = set(varying_features(df, cols, fit_on))
    return df.drop(*[c for c in cols if c not in kept])


def rescale_used_features(df: DataFrame, cols: Sequence[str], max_features: int, sqrt: bool = False) -> DataFrame:
    share = len(cols) / max_features
    d = math.sqrt(share) if sqrt else share
    return df.withColumns({c: F.col(c) / F.lit(d) for c in cols})


def pad_features(features: Column, width: int, rescale: bool = False) -> Column:
    """Append zeros up to `width`; optionally multiply by width/used first."""
    used = F.size(features)
    vals = F.transform(features, lambda v: v * (F.lit(float(width)) / used)) if rescale else features
    return F.concat(vals, F.array_repeat(F.lit(0.0), F.greatest(F.lit(width) - used, F.lit(0))))


def rotate_features(features: Column, shift: int | Column) -> Column:
    """Cyclic shift to the left by `shift` places."""
    n = F.size(features)
    s = F.pmod(F.lit(shift) if isinstance(shift, int) else shift, n)
    return F.when(n == 0, features).otherwise(F.concat(F.slice(features, s + 1, n - s), F.slice(features, F.lit(1), s)))


def bucketize(x: Column, n: int = 100, low: float = -2.0, high: float = 2.0) -> Column:
    """floor((x-low)/width) kept inside 0..n-1."""
    width = (high - low) / n
    return _clip(F.floor((x - F.lit(low)) / F.lit(width)).cast("double"), 0.0, float(n - 1)).cast("int")


def fourier_features(x: Column, k: int) -> Column:
    """sin and cos at the frequencies (2*pi/10)*sqrt(2)^i, i = 0, 2, 4, ... below k."""
    freqs = F.array(*[F.lit(2.0 * math.pi / 10.0 * math.sqrt(2.0) ** i) for i in range(0, k, 2)])
    return F.flatten(F.transform(freqs, lambda f: F.array(F.sin(x * f), F.cos(x * f))))


def center(df: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    stats = fit(df, by, [F.avg(c).alias(f"{c}_mu") for c in cols])
    out = attach(df, stats, by).withColumns({c: F.col(c) - F.col(f"{c}_mu") for c in cols})
    return drop_params(out, stats, by)


def row_zscore(features: Column) -> Column:
    """Standardise one row across its features, sample deviation."""
    n = F.size(features)

    def spread(mean: Column) -> Column:
        return F.sqrt(array_sum(F.transform(features, lambda v: (v - mean) * (v - mean))) / (n - 1))

    return let(
        array_sum(features) / n,
        lambda mean: let(spread(mean), lambda sd: F.transform(features, lambda v: F.try_divide(v - mean, sd))),
    )


def row_normalize(features: Column, mean: float, std: float) -> Column:
    return F.transform(features, lambda v: (v - F.lit(float(mean))) / F.lit(float(std)))


def fit_pair_stats(df: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Mean and clamped deviation per feature, to be frozen and reused."""
    return fit(
        df,
        by,
        [F.avg(c).alias(f"{c}_mu") for c in cols]
        + [F.greatest(F.stddev_samp(c), F.lit(STD_EPS)).alias(f"{c}_sd") for c in cols],
    )


def normalize_with_stats(df: DataFrame, cols: Sequence[str], params: DataFrame, by: Sequence[str], delta: str = "d_") -> DataFrame:
    """Standardise x and divide delta (not the mask) by the same deviation."""
    present = set(df.columns)
    out = attach(df, params, by)
    new = {c: (F.col(c) - F.col(f"{c}_mu")) / F.col(f"{c}_sd") for c in cols}
    new |= {f"{delta}{c}": F.col(f"{delta}{c}") / F.col(f"{c}_sd") for c in cols if f"{delta}{c}" in present}
    return drop_params(out.withColumns(new), params, by)


def normalize_pairs(df: DataFrame, cols: Sequence[str], by: Sequence[str], delta: str = "d_") -> DataFrame:
    return normalize_with_stats(df, cols, fit_pair_stats(df, cols, by), by, delta)


def denormalize(df: DataFrame, cols: Sequence[str], params: DataFrame, by: Sequence[str]) -> DataFrame:
    out = attach(df, params, by).withColumns({c: F.col(c) * F.col(f"{c}_sd") + F.col(f"{c}_mu") for c in cols})
    return drop_params(out, params, by)


def integer_codes_report(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row, one boolean per column: TRUE when it holds whole numbers only."""
    return df.agg(*[F.coalesce(~F.max(F.col(c) != F.floor(F.col(c))), F.lit(True)).alias(c) for c in cols])


def require_integer_codes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    row = integer_codes_report(df, cols).first()
    bad = [c for c in cols if not row[c]]
    if bad:
        raise ValueError(f"columns must hold integer codes: {bad}")
    return df
