"""Deterministic shuffles, splits, folds and samples."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flipside.functions.fitted import attach, drop_params, fit, materialise
from flipside.functions.keyed import cumulative, key_hash, softmax_weights, text_uniform01, uniform01
from flipside.functions.ranks import positions, shuffled_positions
from flipside.session import checkpointed

# Seeds tried for a valid split, and tries of the label check.
SPLIT_SEEDS = [13, 14, 15, 16, 17, 18, 19, 20]
LABEL_TRIES = 10
IGNORE_LABEL = -100
GROUP_ROWS = 100_000  # rows of a group that one task may order; larger groups are ordered in buckets


def keyed_shuffle(df: DataFrame, by: Sequence[str], key: str, seed: int, name: str = "pos") -> DataFrame:
    return shuffled_positions(df, by, uniform01(seed, F.col(key)), key, name)


def split_order(df: DataFrame, by: Sequence[str], key: str, split: int, name: str = "pos") -> DataFrame:
    """Row order of a split: split 1 keeps the key order, others are shuffled."""
    if split <= 1:
        return positions(df, by, key, name)
    return keyed_shuffle(df, by, key, split, name)


def effective_eval_pos(df: DataFrame, by: Sequence[str], bptt: int, eval_pos: int) -> DataFrame:
    """Per dataset: shrink eval_pos when the dataset is too small for it."""
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    room = F.least(F.col("n"), F.lit(bptt))
    pos = F.when(F.lit(2 * eval_pos) > room, F.floor(room * 0.5)).otherwise(F.lit(eval_pos)).cast("int")
    return n.select(*by, "n", pos.alias("eval_pos"), (pos * 2).alias("window"))


def _window_offsets(by: Sequence[str], seeds: Sequence[int], span: Column) -> Column:
    """Start offset per seed: a keyed integer in 0..span."""
    group = [F.col(b) for b in by]
    return F.array(
        *[
            F.when(span > 0, F.floor(text_uniform01(sd, *group, "offset") * (span + 1))).otherwise(F.lit(0)).cast("long")
            for sd in seeds
        ]
    )


def valid_split(df: DataFrame, by: Sequence[str], label: str, bptt: int, eval_pos: int, pos: str = "pos", seeds: Sequence[int] = SPLIT_SEEDS) -> DataFrame:
    """Rows of the first window [i, i+bptt) whose train and test part both hold
    every class of the dataset; datasets without such a window drop out.

    All candidate windows are judged in one aggregate per (dataset, class).
    """
    by = list(by)
    sizes = fit(df, by, [F.count(F.lit(1)).alias("__n")])
    starts = materialise(sizes.select(*by, _window_offsets(by, seeds, F.col("__n") - bptt).alias("__starts")))
    rows = attach(df, starts, by)

    def hits(j: int, low: int, high: int) -> Column:
        at = F.col(pos) - F.col("__starts")[j]
        return F.max(((at >= low) & (at < high)).cast("int"))

    per_class = rows.groupBy(*by, label).agg(
        *[
            c
            for j in range(len(seeds))
            for c in (hits(j, 0, eval_pos).alias(f"a{j}"), hits(j, eval_pos, bptt).alias(f"b{j}"))
        ]
    )
    judged = per_class.groupBy(*by).agg(
        *[F.min(F.least(f"a{j}", f"b{j}")).alias(f"ok{j}") for j in range(len(seeds))]
    )
    first = F.coalesce(*[F.when(F.col(f"ok{j}") == 1, F.lit(j)) for j in range(len(seeds))])
    chosen = materialise(
        judged.select(*by, first.alias("__j"))
        .join(starts, by)
        .filter(F.col("__j").isNotNull())
        .select(*by, F.element_at("__starts", F.col("__j") + 1).alias("start"), F.element_at(F.array(*[F.lit(sd) for sd in seeds]), F.col("__j") + 1).alias("seed"))
    )
    at = F.col(pos) - F.col("start")
    return (
        df.join(chosen, by)
        .filter((at >= 0) & (at < bptt))
        .withColumns(
            {
                "split_pos": at,
                "role": F.when(at < eval_pos, F.lit("train")).otherwise(F.lit("test")),
            }
        )
        .drop("start")
    )


def _judged_in_tasks(rows: DataFrame, by: list[str], key: str, label: str, order: Sequence[Column], eval_pos: int) -> DataFrame:
    """Rows with their position, whether both parts have all classes (`ok`), and whether any order could reach that
    (`possible`); every group is ordered by one task, and one shuffle serves all of it."""
    placed = rows.withColumn("pos", (F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1).cast("long"))
    inside = W.partitionBy(*by, label).orderBy("pos")
    whole = inside.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    group = W.partitionBy(*by)
    placed = placed.withColumns(
        {
            "__both": (F.min("pos").over(whole) < eval_pos) & (F.max("pos").over(whole) >= eval_pos),
            "__n": F.count(F.lit(1)).over(whole),
            "__first": (F.row_number().over(inside) == 1).cast("int"),
        }
    )
    placed = placed.withColumns({"ok": F.min("__both").over(group), "__least": F.min("__n").over(group), "__of": F.count(F.lit(1)).over(group), "__classes": F.sum("__first").over(group)})
    return _verdicts(placed, eval_pos).drop("__both", "__n", "__first", "__least", "__of", "__classes")


def _judged_in_buckets(ordered: DataFrame, by: list[str], label: str, eval_pos: int) -> DataFrame:
    """The same for groups that are too large for one task, from rows with their position."""
    per = ordered.groupBy(*by, label).agg(((F.min("pos") < eval_pos) & (F.max("pos") >= eval_pos)).alias("__both"), F.count(F.lit(1)).alias("__n"))
    found = per.groupBy(*by).agg(F.min("__both").alias("ok"), F.min("__n").alias("__least"), F.sum("__n").alias("__of"), F.count(F.lit(1)).alias("__classes"))
    return ordered.join(checkpointed(_verdicts(found, eval_pos).select(*by, "ok", "possible")), by)


def _verdicts(found: DataFrame, eval_pos: int) -> DataFrame:
    """`ok` and `possible` from a group's rows, classes and rows of its smallest class: each part needs a row of every class."""
    many = F.col("__classes") > 1
    room = (F.col("__least") > 1) & (F.col("__classes") <= eval_pos) & (F.col("__classes") <= F.col("__of") - eval_pos)
    return found.withColumns({"ok": F.col("ok") & many, "possible": many & room})


def split_compatible_or_ignore(df: DataFrame, by: Sequence[str], key: str, label: str, eval_pos: int, seed: int, tries: int = LABEL_TRIES) -> DataFrame:
    """Reshuffle until train and eval part have the same classes (more than
    one); after the last try the labels become -100.

    The train part of try t is the eval_pos smallest keyed draws.  Try 0 keeps
    the given order.  Groups that no order can split, such as those with a
    class of one row, are not shuffled again and end as after the last try.
    """
    by = list(by)
    # The tries work on keys and labels; the other columns are joined once at the end.  Rows without a group are in none.
    rows = checkpointed(df.select(*by, key, label).dropna(subset=by))
    large = checkpointed(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > GROUP_ROWS).drop("__n"))
    parts = [(rows, False)] if large.isEmpty() else [(rows.join(large, by, "left_anti"), False), (rows.join(large, by, "left_semi"), True)]
    names, done = [*by, key, label, "pos", "try"], []
    for pending, is_large in parts:
        for t in range(tries + 1):
            if is_large:
                ordered = positions(pending, by, key) if t == 0 else keyed_shuffle(pending, by, key, seed * 1000 + t)
                judged = _judged_in_buckets(ordered.drop("pos_of"), by, label, eval_pos)
            else:
                order = [F.col(key)] if t == 0 else [uniform01(seed * 1000 + t, F.col(key)), F.col(key)]
                judged = _judged_in_tasks(pending, by, key, label, order, eval_pos)
            if t == 0:
                judged = judged.withColumn("__given", F.col("pos"))
            judged = checkpointed(judged)
            done.append(judged.filter("ok").withColumn("try", F.lit(t)).select(*names))
            left = judged.filter("not ok")
            if t == 0:
                hopeless = left.filter("not possible")
            pending = left.filter("possible").drop("pos", "ok", "possible")
            if pending.isEmpty():
                break
        lost = hopeless.select(*by, key, "__given").unionByName(pending.select(*by, key, "__given"))
        done.append(lost.select(*by, key, F.lit(IGNORE_LABEL).alias(label), F.col("__given").alias("pos"), F.lit(tries + 1).alias("try")))
    out = reduce(DataFrame.unionByName, done)
    rest = [c for c in df.columns if c not in {*by, key, label}]
    return out.join(df.select(*by, key, *rest), [*by, key]) if rest else out


def eval_pos_weights(low: int, high: int, weighted: bool) -> list[float]:
    return [1.0 / (high - i) if weighted else 1.0 for i in range(low, high)]


def sample_eval_pos(low: int, high: int, weighted: bool, *key) -> Column:
    """Evaluation position in [low, high): uniform, or with weight 1/(high-i)."""
    edges = F.array(*[F.lit(e) for e in cumulative(eval_pos_weights(low, high, weighted))])
    u = uniform01(*key)
    return (F.lit(low) + F.size(F.filter(edges, lambda e: e <= u))).cast("int")


def kfold(df: DataFrame, by: Sequence[str], key: str, seed: int, k: int = 5, shuffled: bool = True) -> DataFrame:
    """Fold number per row; with shuffling k is at most half the group."""
    out = keyed_shuffle(df, by, key, seed)
    folds = F.least(F.lit(k), F.floor(F.col("pos_of") / 2)) if shuffled else F.lit(k)
    return out.withColumn("fold", F.pmod(F.col("pos"), F.greatest(folds, F.lit(1))).cast("int")).drop("pos", "pos_of")


def learning_curve(df: DataFrame, sizes: Sequence[int], fit_and_score: Callable[[DataFrame, DataFrame], float], pos: str = "pos", of: str = "pos_of") -> list[tuple[int, float]]:
    """50/50 split; the train prefix is cut to each size and scored.

    `fit_and_score(train, test)` does its work on Spark and returns one number,
    so only (size, score) reaches the driver.
    """
    train, test = df.filter(F.col(pos) * 2 < F.col(of)), df.filter(F.col(pos) * 2 >= F.col(of))
    return [(n, float(fit_and_score(train.filter(F.col(pos) < n), test))) for n in sizes]


def subsample_features(features: Sequence[str], limit: int, seed: int) -> list[str]:
    """Keyed choice of `limit` feature names, in their old order."""
    import hashlib

    if len(features) <= limit:
        return list(features)
    drawn = sorted(features, key=lambda f: hashlib.md5(f"{seed}|{f}".encode()).hexdigest())[:limit]
    return [f for f in features if f in set(drawn)]


def subsample_rows(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement: the smallest keyed hashes (a top-n, no full sort)."""
    return df.orderBy(key_hash(seed, F.col(key)), key).limit(n)


def mix_sources(slots: DataFrame, sources: Sequence[DataFrame], weights: Sequence[float], key: str, seed: int) -> DataFrame:
    """Every slot draws its source with p = softmax([1, *weights]).

    `weights` holds one number per further source; all sources share the key.
    """
    if len(weights) != len(sources) - 1:
        raise ValueError("one weight per source after the first")
    edges = cumulative(softmax_weights(weights))
    u = uniform01(seed, F.col(key), "source")
    out = None
    low = 0.0
    for i, (src, high) in enumerate(zip(sources, edges)):
        take = slots.filter((u >= low) & (u < high)).select(key)
        part = src.join(take, key, "left_semi").withColumn("source", F.lit(i))
        out = part if out is None else out.unionByName(part)
        low = high
    return out


def concat_batches(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


