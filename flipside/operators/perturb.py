"""What-if perturbations: choose features, compute deltas, build pairs.

A pair row keeps the factual columns ``f`` and adds ``m_f`` (was the feature
chosen), ``d_f`` (delta, 0 when not chosen) and ``cf_f`` (counterfactual).
A NULL feature is never chosen and stays NULL.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flipside.functions.fitted import attach, drop_params, fit, materialise
from flipside.functions.keyed import rand_normal, rand_sign, uniform01
from flipside.functions.ranks import exact_quantiles, positions
from flipside.functions.stats import total
from flipside.session import own_method

Score = Callable[[Mapping[str, Column]], Column]

# Smallest deviation used for scaling, finite-difference step.
STD_FLOOR = 1e-6
FD_EPS = 1e-3


@dataclass
class PerturbConfig:
    """Numbers and salt may be Columns, so one plan can run many settings."""

    p: float | Column = 0.5
    magnitude: float | Column = 2.0
    step: float | Column = 0.1
    k: float | Column = 1.0
    direction: str = "random"
    seed: int = 42
    salt: str | Column = ""
    score: Score | None = None
    key: Sequence[str] = field(default_factory=lambda: ["row_id"])

    def draw_key(self, feature: str, purpose: str) -> list:
        salted = isinstance(self.salt, Column) or bool(self.salt)
        head = [self.seed, self.salt] if salted else [self.seed]
        return [*head, *[F.col(k) for k in self.key], feature, purpose]


def _num(v: float | Column) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def select_targets(df: DataFrame, features: Sequence[str], cfg: PerturbConfig) -> DataFrame:
    """Boolean columns m_f: each feature with probability p; a row with none
    gets exactly one of its known features."""
    drawn = {
        f"m_{f}": F.col(f).isNotNull() & (uniform01(*cfg.draw_key(f, "mask")) < _num(cfg.p)) for f in features
    }
    out = df.withColumns(drawn)
    known = [F.col(f).isNotNull().cast("int") for f in features]
    out = out.withColumns(
        {
            "__none": F.lit(True) & ~_any([F.col(f"m_{f}") for f in features]),
            "__pick": F.floor(uniform01(*cfg.draw_key("", "one")) * total(known)).cast("int"),
        }
    )
    filled = {}
    for j, f in enumerate(features):
        before = total(known[:j]) if j else F.lit(0)
        chosen = F.col("__none") & F.col(f).isNotNull() & (before == F.col("__pick"))
        filled[f"m_{f}"] = F.col(f"m_{f}") | chosen
    return out.withColumns(filled).drop("__none", "__pick")


def _any(cols: Sequence[Column]) -> Column:
    acc = cols[0]
    for c in cols[1:]:
        acc = acc | c
    return acc


def spread_stats(features: Sequence[str]) -> list[Column]:
    """What every strategy but the donor one reads: deviation, least and greatest value of each feature."""
    return [
        a
        for f in features
        for a in (F.greatest(F.stddev_samp(f), F.lit(STD_FLOOR)).alias(f"sd_{f}"), F.min(f).alias(f"lo_{f}"), F.max(f).alias(f"hi_{f}"))
    ]


def fit_spread(df: DataFrame, features: Sequence[str], by: Sequence[str]) -> DataFrame:
    return fit(df, by, spread_stats(features))


def fit_pairs(df: DataFrame, features: Sequence[str], target: str, by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(spread, threshold) for `perturb` and `label_pairs`, fitted together.

    The pass that brackets the frozen median of the target takes the spread
    along, so the rows are read twice for all of it.
    """
    both = exact_quantiles(df, by, [target], [0.5], "lower", spread_stats(features)).withColumnRenamed(f"{target}_q0", "threshold")
    both = materialise(both)
    return both.drop("threshold"), both.select(*by, "threshold")


def with_donors(df: DataFrame, features: Sequence[str], by: Sequence[str], cfg: PerturbConfig, repeat: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One donor row per row, drawn with replacement inside its group.

    `repeat` copies the rows per setting, after they are numbered.
    """
    id_col = cfg.key[-1]
    indexed = positions(df, by, id_col, "__pos")
    donors = indexed.select(*by, F.col("__pos").alias("__donor"), *[F.col(f).alias(f"donor_{f}") for f in features])
    draw = uniform01(*cfg.draw_key("", "donor"))
    if repeat is not None:
        indexed = repeat(indexed)
    rows = indexed.withColumn("__donor", F.floor(draw * F.col("__pos_of")).cast("long"))
    return rows.join(donors, [*by, "__donor"]).drop("__donor", "__pos", "__pos_of")


def additive_noise(f: str, cfg: PerturbConfig) -> Column:
    return rand_normal(0.0, 1.0, *cfg.draw_key(f, "noise")) * F.col(f"sd_{f}") * _num(cfg.magnitude)


def marginal_replacement(f: str, cfg: PerturbConfig) -> Column:
    return F.col(f"donor_{f}")


def fixed_magnitude(f: str, cfg: PerturbConfig) -> Column:
    size = _num(cfg.k) * F.col(f"sd_{f}")
    return size if cfg.direction == "positive" else size * rand_sign(*cfg.draw_key(f, "sign"))


def uniform_random(f: str, cfg: PerturbConfig) -> Column:
    u = uniform01(*cfg.draw_key(f, "value"))
    return F.col(f"lo_{f}") + u * (F.col(f"hi_{f}") - F.col(f"lo_{f}"))


def slopes(features: Sequence[str], score: Score) -> dict[str, Column]:
    """up_f: the sign of a finite difference of the score, NULL where it is 0; a row has the same in every setting."""
    at = {g: F.col(g) for g in features}
    rise = {f: score({**at, f: F.col(f) + F.lit(FD_EPS)}) - score(at) for f in features}
    return {f"up_{f}": F.when(d > 0, F.lit(1.0)).when(d < 0, F.lit(-1.0)) for f, d in rise.items()}


def gradient_guided(f: str, cfg: PerturbConfig) -> Column:
    """Step along the sign of the slope; a random sign where the slope is 0,
    then a fair coin flips the direction."""
    towards = F.coalesce(F.col(f"up_{f}"), rand_sign(*cfg.draw_key(f, "flat")))
    coin = rand_sign(*cfg.draw_key(f, "coin"))
    return towards * coin * _num(cfg.step) * F.col(f"sd_{f}") * _num(cfg.magnitude)


@dataclass(frozen=True)
class Strategy:
    make: Callable[..., Column]  # the delta, or the new value when `replaces`
    needs: str  # which columns it reads: 'std', 'bounds' or 'donor'
    slope: bool = False
    replaces: bool = False


STRATEGIES: dict[str, Strategy] = {
    "additive_noise": Strategy(additive_noise, "std"),
    "marginal_replacement": Strategy(marginal_replacement, "donor", replaces=True),
    "gradient_guided": Strategy(gradient_guided, "std", slope=True),
    "fixed_magnitude": Strategy(fixed_magnitude, "std"),
    "uniform_random": Strategy(uniform_random, "bounds", replaces=True),
}


def register_strategy(name: str, make: Callable[[str, PerturbConfig], Column], needs: str = "std", replaces: bool = False) -> None:
    """Add a user strategy: a function (feature, config) -> delta Column, or the new value if it `replaces`."""
    if needs not in ("std", "bounds", "donor"):
        raise ValueError(f"unknown input {needs!r}")
    STRATEGIES[name] = Strategy(make, needs, replaces=replaces)


def perturb(df: DataFrame, features: Sequence[str], strategy: str, by: Sequence[str], cfg: PerturbConfig, spread: DataFrame | None = None) -> DataFrame:
    """Mask, delta and counterfactual columns under the named strategy.

    A strategy that replaces values sets cf_f to exactly the new value and
    derives the delta from it, so a copied row gets the copied row's class.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; known: {sorted(STRATEGIES)}")
    chosen = STRATEGIES[strategy]
    if chosen.slope and cfg.score is None:
        raise ValueError(f"{strategy} needs a score function")
    if chosen.needs == "donor":
        return moved(with_donors(df, features, by, cfg), features, strategy, cfg).drop(*[f"donor_{f}" for f in features])
    params = spread if spread is not None else fit_spread(df, features, by)
    src = attach(own_method(df), params, by)
    if chosen.slope:
        src = src.withColumns(slopes(features, cfg.score))
    return drop_params(moved(src, features, strategy, cfg), params, by).drop(*[f"up_{f}" for f in features])


def moved(src: DataFrame, features: Sequence[str], strategy: str, cfg: PerturbConfig) -> DataFrame:
    """`perturb` of rows that carry what the strategy reads: spread, slopes or donors."""
    chosen = STRATEGIES[strategy]
    masked = select_targets(src, features, cfg)
    raw = {f: chosen.make(f, cfg) for f in features}
    if chosen.replaces:
        out = masked.withColumns({f"cf_{f}": F.when(F.col(f"m_{f}"), F.coalesce(raw[f], F.col(f))).otherwise(F.col(f)) for f in features})
        return out.withColumns({f"d_{f}": F.coalesce(F.col(f"cf_{f}") - F.col(f), F.lit(0.0)) for f in features})
    out = masked.withColumns(
        {f"d_{f}": F.when(F.col(f"m_{f}"), F.coalesce(raw[f], F.lit(0.0))).otherwise(F.lit(0.0)) for f in features}
    )
    return out.withColumns({f"cf_{f}": F.col(f) + F.col(f"d_{f}") for f in features})


def linear_score(weights: Mapping[str, float], intercept: float = 0.0) -> Score:
    """Weighted sum of features; an unknown feature counts as 0."""

    def score(at: Mapping[str, Column]) -> Column:
        return total([F.lit(float(w)) * F.coalesce(at[f], F.lit(0.0)) for f, w in weights.items()]) + F.lit(intercept)

    return score


def classified(df: DataFrame, features: Sequence[str], score: Score, side: str, threshold: Column) -> DataFrame:
    """Score and class of one side of the pairs, 'f' or 'cf'."""
    prefix = "" if side == "f" else f"{side}_"
    out = df.withColumn(f"y_{side}", score({f: F.col(f"{prefix}{f}") for f in features}))
    return out.withColumn(f"y_{side}_class", (F.col(f"y_{side}") > threshold).cast("int"))


def label_pairs(pairs: DataFrame, features: Sequence[str], score: Score, by: Sequence[str], threshold: DataFrame | float) -> DataFrame:
    """Add y_f, y_cf, their classes under the frozen threshold, and label_flipped."""
    fitted = isinstance(threshold, DataFrame)
    out = own_method(pairs)
    out = attach(out, threshold, by) if fitted else out
    t = F.col("threshold") if fitted else F.lit(float(threshold))
    for side in ("f", "cf"):
        out = classified(out, features, score, side, t)
    out = out.withColumn("label_flipped", F.col("y_f_class") != F.col("y_cf_class"))
    return out.drop("threshold") if fitted else out


def multiple_counterfactuals(df: DataFrame, n: int) -> DataFrame:
    """n copies of every row, numbered cf_index = 1..n; use it as a draw key."""
    return df.withColumn("cf_index", F.explode(F.sequence(F.lit(1), F.lit(n))))


def retry_until_flip_rate(make: Callable[[str, float, int], DataFrame], strategy: str, magnitude: float, min_rate: float = 0.20, max_retries: int = 5) -> tuple[DataFrame, list[dict]]:
    """Regenerate while the flip rate is too low.

    Each miss switches to uniform_random and raises the magnitude by half; the
    salt changes with every try.  Only the flip rate reaches the driver.
    """
    log: list[dict] = []
    pairs = None
    for attempt in range(max_retries):
        pairs = make(strategy, magnitude, attempt)
        rate = pairs.agg(F.avg(F.col("label_flipped").cast("double"))).first()[0] or 0.0
        log.append({"attempt": attempt, "strategy": strategy, "magnitude": magnitude, "flip_rate": rate})
        if rate >= min_rate:
            break
        strategy, magnitude = "uniform_random", magnitude * 1.5
    return pairs, log
