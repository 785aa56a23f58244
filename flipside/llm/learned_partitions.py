"""Approximate nearest neighbours by learned partitions.

A bounded sample is enough to learn the space: its neighbour graph is cut into
balanced parts that few edges cross, and a small classifier learns to name a
vector's part.  Every row is then indexed under its most probable part; a query
is compared with the rows of several most probable parts.

Equal vectors are one class, found once and expanded at the end, so a vector
that fills a third of the table costs as much as any other.
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


@dataclass(frozen=True)
class PartitionConfig:
    rows_per_part: int = 1500
    most_parts: int = 256
    sample_per_part: int = 256  # sampled rows to learn from, 16,384 at most
    graph_neighbours: int = 10
    hidden: int = 128
    epochs: int = 20
    mass: float = 0.998  # probe the most probable parts up to this share of probability
    least_probes: int = 10  # and at least so many parts
    block: int = 4096
    seed: int = 1


def _cut_in_two(x: np.ndarray, rows: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows on both sides of a cut across the widest direction, `share` of them on the first."""
    y = x[rows] - x[rows].mean(axis=0)
    v = np.ones(y.shape[1])
    for _ in range(12):
        v = y.T @ (y @ v)
        v /= max(np.linalg.norm(v), 1e-12)
    order = rows[np.argsort(y @ v, kind="stable")]
    k = round(len(order) * share)
    return order[:k], order[k:]


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, slack: float = 1.1, sweeps: int = 6) -> np.ndarray:
    """A part for every sampled row: even cuts first, then rows move to where most of their
    graph neighbours are, as long as no part outgrows `slack` times the mean."""
    label = np.zeros(len(x), np.int64)
    todo = [(np.arange(len(x)), 0, parts)]
    while todo:
        rows, low, many = todo.pop()
        if many == 1:
            label[rows] = low
            continue
        half = many // 2
        a, b = _cut_in_two(x, rows, half / many)
        todo += [(a, low, half), (b, low + half, many - half)]
    size, most = np.bincount(label, minlength=parts), slack * len(x) / parts
    # The graph in both directions, as lists.
    src, dst = np.repeat(np.arange(len(x)), graph.shape[1]), graph.ravel()
    both = np.concatenate([np.stack([src, dst]), np.stack([dst, src])], axis=1)
    both = both[:, np.argsort(both[0], kind="stable")]
    cuts = np.searchsorted(both[0], np.arange(len(x) + 1))
    for _ in range(sweeps):
        moved = 0
        for i in range(len(x)):
            near = np.bincount(label[both[1, cuts[i] : cuts[i + 1]]], minlength=parts)
            best = int(near.argmax())
            if near[best] > near[label[i]] and size[best] + 1 <= most:
                size[label[i]] -= 1
                size[best] += 1
                label[i] = best
                moved += 1
        if moved < len(x) // 200:
            break
    return label


@dataclass
class Router:
    """One hidden layer and a softmax over the parts."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0.0) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.logits(x)
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def train_router(x: np.ndarray, label: np.ndarray, parts: int, cfg: PartitionConfig) -> Router:
    rng = np.random.default_rng(cfg.seed)
    d = x.shape[1]
    p = [rng.normal(0, math.sqrt(2 / d), (d, cfg.hidden)), np.zeros(cfg.hidden), rng.normal(0, math.sqrt(1 / cfg.hidden), (cfg.hidden, parts)), np.zeros(parts)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    step = 0
    for _ in range(cfg.epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 256):
            rows = order[at : at + 256]
            h = x[rows] @ p[0] + p[1]
            a = np.maximum(h, 0)
            z = a @ p[2] + p[3]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            g = z / z.sum(axis=1, keepdims=True)
            g[np.arange(len(rows)), label[rows]] -= 1
            g /= len(rows)
            back = (g @ p[2].T) * (h > 0)
            step += 1
            for i, grad in enumerate((x[rows].T @ back, back.sum(axis=0), a.T @ g, g.sum(axis=0))):
                m[i] = 0.9 * m[i] + 0.1 * grad
                v[i] = 0.999 * v[i] + 0.001 * grad**2
                p[i] = p[i] - 3e-3 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Router(*p)


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _neighbours(batches: Iterator[pa.RecordBatch], sample: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """The k nearest other rows of the sample for each row number."""
    for b in batches:
        rows = np.asarray(b.column(0))
        score = sample[rows] @ sample.T
        score[np.arange(len(rows)), rows] = -np.inf
        near = np.argpartition(-score, min(k, score.shape[1] - 1) - 1, axis=1)[:, :k]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(near.astype(np.int32)), pa.list_(pa.int32()))], names=["row", "near"])


def learn_router(classes: DataFrame, parts: int, cfg: PartitionConfig) -> Router | None:
    """Neighbour graph of a bounded sample (in tasks), its balanced parts and the classifier."""
    if parts == 1:
        return None
    most = min(16_384, parts * cfg.sample_per_part)
    picked = classes.select("cid", "vec").orderBy(F.xxhash64(F.lit(cfg.seed), "cid"), "cid").limit(most).collect()
    sample = np.array([r["vec"] for r in picked], np.float64)
    spark = classes.sparkSession
    k = min(cfg.graph_neighbours, len(sample) - 1)
    rows = spark.range(0, len(sample), 1, max(1, len(sample) // 1024))
    got = rows.mapInArrow(partial(_neighbours, sample=sample, k=k), "row long, near array<int>").collect()
    graph = np.zeros((len(sample), k), np.int64)
    for r in got:
        graph[r["row"]] = r["near"]
    return train_router(sample, balanced_parts(sample, graph, parts), parts, cfg)


def _index(batches: Iterator[pa.RecordBatch], router: Router | None) -> Iterator[pa.RecordBatch]:
    for b in batches:
        part = router.logits(_matrix(b.column(2))).argmax(axis=1) if router is not None and len(b) else np.zeros(len(b), int)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part, pa.int32())], names=[*b.schema.names, "part"])


def _probe(batches: Iterator[pa.RecordBatch], router: Router | None, sizes: np.ndarray, least: int, cfg: PartitionConfig) -> Iterator[pa.RecordBatch]:
    """(cid, first, vec, part) for the parts that a query visits."""
    for b in batches:
        if not len(b):
            continue
        if router is None:
            rows, part = np.arange(len(b)), np.zeros(len(b), int)
        else:
            p = router.probabilities(_matrix(b.column(2)))
            order = np.argsort(-p, axis=1, kind="stable")
            sure = np.cumsum(np.take_along_axis(p, order, axis=1), axis=1)
            rows_so_far = np.cumsum(sizes[order], axis=1)
            first = np.arange(p.shape[1]) < cfg.least_probes
            # A part is visited while those before it are too few, too improbable or hold too few rows.
            before = np.hstack([np.zeros((len(p), 1)), sure[:, :-1]]) < cfg.mass
            few = np.hstack([np.zeros((len(p), 1)), rows_so_far[:, :-1]]) < least
            rows, at = np.nonzero(first[None, :] | before | few)
            part = order[rows, at]
        taken = b.take(pa.array(rows))
        yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(part, pa.int32())], names=["cid", "first", "vec", "part"])


_LISTS = "qid long, cids array<long>, firsts array<long>, scores array<double>"


def _lists(qids: list, cids: list, firsts: list, scores: list) -> pa.RecordBatch:
    long, double = pa.list_(pa.int64()), pa.list_(pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(qids, pa.int64()), pa.array(cids, long), pa.array(firsts, long), pa.array(scores, double)], names=["qid", "cids", "firsts", "scores"])


def _best(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """One row per query of a chunk: its k best classes of a block, ties by the class's smallest id."""
    for group in key_runs(batches, 3):
        query = np.asarray(group.column(3)).astype(bool)
        if not query.any() or query.all():
            continue
        cid, first, x = np.asarray(group.column(4)), np.asarray(group.column(5)), _matrix(group.column(6))
        q, c, cids, firsts = x[query], x[~query], cid[~query], first[~query]
        many = min(k, len(c))
        # What rounding can change decides by the measure itself, taken row by row.
        slack = 1e-12 * np.sqrt((q * q).sum(axis=1) * (c * c).sum(axis=1).max())
        out: list[list] = [[], [], []]
        for at in range(0, len(q), 64):
            part = q[at : at + 64]
            score = part @ c.T
            edge = np.partition(score, len(c) - many, axis=1)[:, len(c) - many] - slack[at : at + 64]
            i, j = np.nonzero(score >= edge[:, None])
            exact = np.einsum("nd,nd->n", part[i], c[j])
            order = np.lexsort((firsts[j], -exact, i))
            i, j, exact = i[order], j[order], exact[order]
            starts = np.searchsorted(i, np.arange(len(part)))
            for lo, hi in zip(starts, np.append(starts[1:], len(i))):
                top = slice(lo, min(hi, lo + many))
                for kept, values in zip(out, (cids[j[top]], firsts[j[top]], exact[top])):
                    kept.append(values)
        yield _lists(cid[query], *out)


def _merge(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """One row per query: the k best of all its parts and blocks."""
    rows = []
    for group in key_runs(batches, 1):
        cid, first, score = (np.asarray(group.column(i).combine_chunks().flatten()) for i in (1, 2, 3))
        order = np.lexsort((first, -score))[:k]
        rows.append((group.column(0)[0].as_py(), cid[order], first[order], score[order]))
    yield _lists(*map(list, zip(*rows))) if rows else _lists([], [], [], [])


def _valid(vec: Column) -> Column:
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vec.isNotNull() & ~bad & F.exists(vec, lambda x: x != 0)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, cfg: PartitionConfig = PartitionConfig()) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each query row, by inner product.

    Reads vec_id and embedding.  A row takes no part when its id or vector is
    null, when the vector is all zeros, holds a null or non-finite component, or
    has not the most frequent number of components.  Equal scores go by the
    smaller vec_id, whether the vectors are equal or not; repeated rows (same id
    and vector) count once.  An id with several vectors is a candidate with each
    of them, and as a query has one list, with its own ranks, per vector; its
    own id is in none of them.  Fewer candidates give fewer rows, an empty table
    none.
    """
    vec = F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec"), is_query.alias("query"))
    rows = rows.filter(F.col("vec_id").isNotNull() & _valid(F.col("vec")))
    rows = written(rows.withColumns({"k1": F.xxhash64("vec"), "k2": F.hash("vec")}), "vectors")
    top = rows.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    rows = rows.filter(F.size("vec") == (top["d"] if top else 0))
    # A class keeps the k + 1 smallest ids of its rows: a query leaves out itself at most.
    first = rows.select("k1", "k2", "vec_id").distinct().withColumn("n", F.row_number().over(W.partitionBy("k1", "k2").orderBy("vec_id"))).filter(F.col("n") <= k + 1)
    ids = first.groupBy("k1", "k2").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    one = rows.join(ids.select("k1", "k2", "ids", F.col("ids")[0].alias("first")), ["k1", "k2"]).filter("vec_id = first").dropDuplicates(["k1", "k2"])
    classes = written(one.select(F.monotonically_increasing_id().alias("cid"), "first", "vec", "ids", "k1", "k2"), "classes")
    n = classes.count()
    parts = min(cfg.most_parts, max(1, n // cfg.rows_per_part))
    router = learn_router(classes, parts, cfg)
    kind = "cid long, first long, vec array<double>, part int"
    indexed = written(classes.select("cid", "first", "vec").mapInArrow(partial(_index, router=router), kind), "index")
    held = np.zeros(parts)
    for r in indexed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect():  # most_parts rows
        held[r["part"]] = r["n"]
    asked = rows.filter("query").select("k1", "k2").distinct().join(classes, ["k1", "k2"]).select("cid", "first", "vec")
    probes = written(asked.mapInArrow(partial(_probe, router=router, sizes=held, least=k + 1, cfg=cfg), kind), "probes")
    blocks = [max(1, math.ceil(h / cfg.block)) for h in held]
    asks = {r["part"]: r["n"] for r in probes.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    chunks = [max(1, math.ceil(asks.get(i, 0) / cfg.block)) for i in range(parts)]

    def of_part(values: list[int]) -> Column:
        return F.array(*[F.lit(v) for v in values])[F.col("part")]

    def side(df: DataFrame, query: bool) -> DataFrame:
        own, other = (chunks, blocks) if query else (blocks, chunks)
        mine = F.pmod(F.xxhash64("cid"), of_part(own)).cast("int")
        df = df.select("part", mine.alias("mine"), F.explode(F.sequence(F.lit(0), of_part(other) - 1)).alias("other"), "cid", "first", "vec")
        block, chunk = ("other", "mine") if query else ("mine", "other")
        return df.select("part", F.col(block).alias("block"), F.col(chunk).alias("chunk"), F.lit(query).alias("query"), "cid", "first", "vec")

    fed = side(probes, True).unionByName(side(indexed, False)).repartition("part", "block", "chunk").sortWithinPartitions("part", "block", "chunk")
    hits = fed.mapInArrow(partial(_best, k=k + 1), _LISTS).repartition("qid").sortWithinPartitions("qid").mapInArrow(partial(_merge, k=k + 1), _LISTS)
    hits = hits.select("qid", F.explode(F.arrays_zip("cids", "scores")).alias("c")).select("qid", F.col("c.cids").alias("cid"), F.col("c.scores").alias("score"))
    rows_hit = hits.join(classes.select("cid", "ids"), "cid").select("qid", "score", F.explode("ids").alias("vec_id"))
    best = rows_hit.withColumn("n", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))).filter(F.col("n") <= k + 1)
    lists = written(best.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("found")), "found")
    keyed = classes.select("k1", "k2", "cid").join(lists, F.col("cid") == F.col("qid")).select("k1", "k2", "found")
    queries = rows.filter("query").select(F.col("vec_id").alias("query_id"), "k1", "k2").distinct()
    own = queries.join(keyed, ["k1", "k2"])
    near = F.slice(F.filter("found", lambda f: f["vec_id"] != F.col("query_id")), 1, k)
    return own.select("query_id", F.posexplode(near).alias("at", "f")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("f.vec_id").alias("vec_id"), F.col("f.score").alias("score")
    )
