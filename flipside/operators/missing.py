"""Missing values: masked statistics, injection, indicators, imputation.

NaN becomes NULL at the door; `miss_kind` keeps which kind it was:
'unknown' (NaN), 'none' (-inf, no reason), 'reason' (+inf).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flipside.functions.fitted import attach, attach_draws, drop_params, fit, where_fit
from flipside.functions.keyed import rand_int, text_uniform01, uniform01

# Stand-in numbers a disguised missing cell may carry.
SENTINELS = [-999.0, 0.0, 1.0, 999.0]
KIND_VALUE = {"unknown": float("nan"), "none": float("-inf"), "reason": float("inf")}
# Indicator code per kind of missing value.
KIND_CODE = {"unknown": -1.0, "reason": 1.0, "none": 2.0}


def nan_to_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.when(~F.isnan(F.col(c)), F.col(c)) for c in cols})


def missing_kind(c: str | Column) -> Column:
    v = F.col(c) if isinstance(c, str) else c
    return (
        F.when(v.isNull() | F.isnan(v), F.lit("unknown"))
        .when(v == float("inf"), F.lit("reason"))
        .when(v == float("-inf"), F.lit("none"))
    )


def masked_mean(col: str | Column, mask: Column) -> Column:
    return F.avg(where_fit(col, mask))


def ignored_share(col: str | Column, mask: Column) -> Column:
    return F.lit(1.0) - F.count(where_fit(col, mask)) / F.count(F.lit(1))


def masked_std(col: str | Column, mask: Column) -> Column:
    return F.stddev_samp(where_fit(col, mask))


def nan_mean(col: str) -> Column:
    return F.avg(F.when(~F.isnan(F.col(col)), F.col(col)))


def nan_std(col: str) -> Column:
    return F.stddev_samp(F.when(~F.isnan(F.col(col)), F.col(col)))


def nan_share(col: str) -> Column:
    return F.lit(1.0) - F.count(F.when(~F.isnan(F.col(col)), F.col(col))) / F.count(F.lit(1))


def inject_missing_random(df: DataFrame, cols: Sequence[str], p: float, by: str, key: str, seed: int, value: Column | None = None) -> DataFrame:
    """Each cell goes missing with probability u*p, one u per dataset."""
    gone = F.lit(None).cast("double") if value is None else value
    rated = attach_draws(df, [by], {"__rate": text_uniform01(seed, F.col(by), "rate") * F.lit(float(p))})
    return rated.withColumns(
        {c: F.when(uniform01(seed, F.col(key), c, "cell") < F.col("__rate"), gone).otherwise(F.col(c)) for c in cols}
    ).drop("__rate")


def value_threshold(p: float, by: str, seed: int) -> Column:
    return text_uniform01(seed, F.col(by), "t1") * 20.0 * float(p) * text_uniform01(seed, F.col(by), "t2")


def inject_missing_by_value(df: DataFrame, codes: dict[str, Column], p: float, by: str, seed: int, value: Column | None = None) -> DataFrame:
    """A cell goes missing when the class code of its value is below u*20*p*u'.

    `codes` holds, per column, the class code under a 20-class cut at random
    data values (see labels.rank_codes).
    """
    gone = F.lit(None).cast("double") if value is None else value
    limited = attach_draws(df, [by], {"__limit": value_threshold(p, by, seed)})
    return limited.withColumns({c: F.when(code < F.col("__limit"), gone).otherwise(F.col(c)) for c, code in codes.items()}).drop("__limit")


def missing_value_for(kind: str, set_value_to_nan: float, *key) -> Column:
    """The value a missing cell of this kind gets: the marker itself, or a sentinel."""
    pick = rand_int(0, len(SENTINELS), *key, "pick")
    sentinel = F.lit(SENTINELS[-1])
    for i, s in reversed(list(enumerate(SENTINELS[:-1]))):
        sentinel = F.when(pick == i, F.lit(s)).otherwise(sentinel)
    return F.when(uniform01(*key, "nan") < F.lit(float(set_value_to_nan)), F.lit(KIND_VALUE[kind])).otherwise(sentinel)


def missing_schedule(by: str, seed: int, p_none: float, p_reason: float, p_unknown: float, p_unknown_reason: float) -> dict[str, Column]:
    """Which kinds of missingness a dataset gets: only half of them get any.  Made to be attached per dataset."""
    u = {k: text_uniform01(seed, F.col(by), k) for k in ("any", "none", "reason", "mech")}
    on = (u["any"] > 0.5) & F.lit(p_none + p_reason + p_unknown > 0)
    by_value = u["mech"] >= F.lit(float(p_unknown_reason))
    return {
        "has_none": on & (u["none"] < F.lit(float(p_none))),
        "has_reason": on & F.lit(p_reason > 0) & (u["reason"] > 0.5),
        "has_unknown": on & F.lit(p_unknown > 0),
        "unknown_by_value": on & F.lit(p_unknown > 0) & by_value,
    }


def attach_missing_schedule(df: DataFrame, by: str, seed: int, p_none: float, p_reason: float, p_unknown: float, p_unknown_reason: float) -> DataFrame:
    """The schedule's columns on every row, drawn once per dataset."""
    return attach_draws(df, [by], missing_schedule(by, seed, p_none, p_reason, p_unknown, p_unknown_reason))


def missing_indicators(df: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Missing cells become 0 and get a z-scored indicator column `<col>_miss`."""
    from flipside.operators.transforms import zscore

    out = df
    added, filled = {}, {}
    for c in cols:
        kind = missing_kind(c)
        code = F.lit(0.0)
        for name, v in KIND_CODE.items():
            code = F.when(kind == name, F.lit(v)).otherwise(code)
        added[f"{c}_miss"] = code
        filled[c] = F.when(kind.isNotNull(), F.lit(0.0)).otherwise(F.col(c))
    out = out.withColumns(added).withColumns(filled)
    return zscore(out, list(added), by)


def fill_missing(df: DataFrame, cols: Sequence[str], value: float = 0.0) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.nanvl(F.col(c), F.lit(None).cast("double")), F.lit(value)) for c in cols})


def impute_mean(df: DataFrame, cols: Sequence[str], by: Sequence[str], fit_on: Column | None = None) -> DataFrame:
    params = fit(df, by, [F.avg(where_fit(c, fit_on)).alias(f"{c}_mu") for c in cols])
    out = attach(df, params, by).withColumns({c: F.coalesce(F.col(c), F.col(f"{c}_mu")) for c in cols})
    return drop_params(out, params, by)


def categorical_missing_as_class(df: DataFrame, cols: Sequence[str], code: int = -1) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("int"), F.lit(code)) for c in cols})
