"""Hard negatives by exact integer scores from a residue number system.

Scores are inner products of integer vectors.  Each vector is reduced modulo
several small primes; the residues are multiplied as float32 matrices, whose
sums stay below 2^24 and are therefore exact, and the signed score is put
together from its residues (Chinese remainders, in mixed radix).  So the bulk
of the work is fast matrix products, and the result is exact integers.

Anchors, in chunks, meet all rows, in blocks.  A first pass finds every
anchor's positives; a second pass, with the score windows that the positives
set, finds its negatives.  Only the best of a block leave a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flipside.llm.arrow_groups import key_runs
from flipside.llm.common import written

# A float32 holds every integer up to here.
EXACT = 1 << 24
# Squared length of an integer vector that still takes part: 100 times a score fits in 63 bits.
MOST_SQUARED = 1 << 56


@dataclass(frozen=True)
class NegativeConfig:
    scale: int = 256  # a component x becomes floor(scale * x)
    positives: int = 5
    negatives: int = 10
    low: int = 30  # a negative's score lies between low and high percent of the positive's
    high: int = 90
    residue: int = 512  # largest magnitude of a residue
    block: int = 65_536  # rows of a block at most
    chunk: int = 8192  # anchors of a chunk
    step: int = 256  # anchors multiplied at once


def primes_for(bound: int, residue: int = 512) -> list[int]:
    """The largest odd primes up to 2 * residue + 1 whose product exceeds twice the bound."""
    out, product = [], 1
    for p in range(2 * residue + 1, 2, -1):
        if product > 2 * bound:
            return out
        if all(p % q for q in range(2, math.isqrt(p) + 1)):
            out.append(p)
            product *= p
    if product <= 2 * bound:
        raise ValueError("residues too small for scores of this size")
    return out


def _centred(x: np.ndarray, p: int) -> np.ndarray:
    """Residues between -(p-1)/2 and (p-1)/2."""
    half = p // 2
    return (x + half) % p - half


class Residues:
    """Integer rows modulo each prime, as float32 pieces short enough for exact sums."""

    def __init__(self, x: np.ndarray, primes: list[int]):
        self.parts = []
        for p in primes:
            piece = max(1, EXACT // (p // 2) ** 2)
            r = _centred(x, p).astype(np.float32)
            self.parts.append([np.ascontiguousarray(r[:, at : at + piece]) for at in range(0, x.shape[1], piece)])


def exact_products(a: Residues, b: Residues, rows: slice, primes: list[int]) -> np.ndarray:
    """Signed inner products of rows `rows` of a with all rows of b, as int64."""
    digits: list[np.ndarray] = []
    for k, p in enumerate(primes):
        # Without pieces a row has no components, and its products are zero.
        r = sum((_centred((x[rows] @ y.T).astype(np.int32), p) for x, y in zip(a.parts[k], b.parts[k])), np.int32(0))
        for q, d in zip(primes, digits):  # take off the lower digits, divide by their primes
            r = _centred((r - d) * pow(q, -1, p), p)
        digits.append(_centred(np.asarray(r), p))
    # With centred digits no step leaves the range of the result, and a partial sum that wraps around comes back.
    out, weight = np.zeros(digits[0].shape, np.int64), 1
    for p, d in zip(primes, digits):
        out += d.astype(np.int64) * np.int64(weight)
        weight = (weight * p + (1 << 63)) % (1 << 64) - (1 << 63)
    return out


def _first(score: np.ndarray, ids: np.ndarray, many: int) -> np.ndarray:
    """Places of the `many` highest scores, ties by smaller id (ids ascend)."""
    if len(score) > 4 * many:
        least = np.partition(score, len(score) - many)[len(score) - many]
        above, level = np.flatnonzero(score > least), np.flatnonzero(score == least)
        some = np.concatenate([above, level[: many - len(above)]])
    else:
        some = np.arange(len(score))
    return some[np.lexsort((ids[some], -score[some]))][:many]


def _positives_of(score: np.ndarray, own: np.ndarray, other: np.ndarray, ids: np.ndarray, anchor: int, _, cfg: NegativeConfig):
    at = np.flatnonzero(own & other)
    at = at[_first(score[at], ids[at], cfg.positives)]
    yield 0, at


def _negatives_of(score: np.ndarray, own: np.ndarray, other: np.ndarray, ids: np.ndarray, anchor: int, goals, cfg: NegativeConfig):
    foe = np.flatnonzero(~own)
    s = score[foe]
    for goal in goals:
        at = foe[(100 * s >= cfg.low * goal) & (100 * s <= cfg.high * goal)]
        at = at[_first(score[at], ids[at], cfg.negatives)]
        yield goal, at


def _search(batches: Iterator[pa.RecordBatch], primes: list[int], cfg: NegativeConfig, negatives: bool) -> Iterator[pa.RecordBatch]:
    """(anchor, goal, vec_id, score) of a chunk's anchors in a block of rows."""
    pick = _negatives_of if negatives else _positives_of
    for group in key_runs(batches, 2):
        number, ids, lab = (np.asarray(group.column(k)) for k in (2, 3, 4))
        q = group.column(5).combine_chunks()
        x = np.asarray(q.flatten(), np.int64).reshape(len(q), -1)
        anchors = np.flatnonzero(number >= 0)
        rows = np.flatnonzero(number < 0)
        if not len(anchors) or not len(rows):
            continue
        rows = rows[np.argsort(ids[rows], kind="stable")]
        row_ids, row_lab = ids[rows], lab[rows]
        goals = group.column(6)
        a, b = Residues(x[anchors], primes), Residues(x[rows], primes)
        for at in range(0, len(anchors), cfg.step):
            part = slice(at, at + cfg.step)
            scores = exact_products(a, b, part, primes)
            out = []
            for n, score in zip(anchors[part], scores):
                wanted = goals[int(n)].as_py() if negatives else None
                for goal, found in pick(score, row_lab == lab[n], row_ids != ids[n], row_ids, ids[n], wanted, cfg):
                    if len(found):
                        out.append((np.full(len(found), number[n]), np.full(len(found), goal), row_ids[found], score[found]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out)], names=["anchor", "goal", "vec_id", "score"])


_FOUND = "anchor long, goal long, vec_id long, score long"


def _valid(vec: Column) -> Column:
    return vec.isNotNull() & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column, cfg: NegativeConfig = NegativeConfig()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Reads vec_id, embedding and what the two expressions name.  An anchor's
    positives are its first rows of the same label with another vec_id, by
    score, then smaller vec_id; for each of them the first rows of other labels
    whose score lies in the window that the positive's score sets.  A row takes
    no part when its id, label or vector is null, when the vector holds a null
    or non-finite component, has not the most frequent number of components, or
    is so long that 100 times a score would not fit in 63 bits.  A zero vector
    takes part.  Repeated rows count as often as they occur, as anchors too; a
    positive that is not above zero has no negatives but zeros for zero; an
    empty table gives an empty one.
    """
    lab = label.cast("long")
    vec = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), lab.alias("lab"), F.transform(F.when(_valid(vec), vec), lambda x: F.floor(x * cfg.scale)).alias("q"), is_anchor.alias("is_anchor"))
    length = F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("lab").isNotNull() & F.col("q").isNotNull()).withColumn("squared", length)
    rows = rows.filter(F.col("squared") <= float(MOST_SQUARED)).withColumn("q", F.col("q").cast("array<int>"))
    rows = written(rows.withColumn("number", F.monotonically_increasing_id()), "integer-vectors")
    top = rows.groupBy(F.size("q").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max("squared").alias("squared"), F.sum(F.col("is_anchor").cast("long")).alias("anchors")).orderBy(F.desc("n"), "d").first()
    d, n, squared, many = top if top else (0, 0, 0, 0)
    rows = rows.filter(F.size("q") == d)
    # No score exceeds the longest vector's square.
    primes = primes_for(int(squared or 0) + 1, cfg.residue)
    spark = vectors.sparkSession
    blocks = max(2 * spark.sparkContext.defaultParallelism, math.ceil(n / cfg.block))
    chunks = max(1, math.ceil((many or 0) / cfg.chunk))
    spread = F.xxhash64("number")
    none = F.array().cast("array<long>")
    feed = rows.withColumn("block", F.pmod(spread, F.lit(blocks)).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    feed = feed.select("chunk", "block", F.lit(-1).cast("long").alias("number"), "vec_id", "lab", "q", none.alias("goals"))

    def searched(anchors: DataFrame, negatives: bool) -> DataFrame:
        asks = anchors.withColumn("chunk", F.pmod(spread, F.lit(chunks)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        both = feed.unionByName(asks.select("chunk", "block", "number", "vec_id", "lab", "q", "goals"))
        dealt = both.repartition("chunk", "block").sortWithinPartitions("chunk", "block")
        return dealt.mapInArrow(partial(_search, primes=primes, cfg=cfg, negatives=negatives), _FOUND)

    def firsts(found: DataFrame, keys: list[str], most: int) -> DataFrame:
        order = W.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)

    anchors = rows.filter("is_anchor").withColumn("goals", none)
    positives = written(firsts(searched(anchors, False), ["anchor"], cfg.positives), "positives")
    wanted = positives.groupBy("anchor").agg(F.sort_array(F.collect_set("score")).alias("goals"))
    asked = anchors.drop("goals").join(wanted.withColumnRenamed("anchor", "number"), "number")
    negatives = firsts(searched(asked, True), ["anchor", "goal"], cfg.negatives)
    named = positives.select("anchor", F.col("vec_id").alias("positive_id"), F.col("score").alias("goal")).join(anchors.select(F.col("number").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    return named.join(negatives, ["anchor", "goal"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), F.col("goal").alias("positive_score"), F.col("score").alias("negative_score")
    )
