"""Near copies among embeddings by iterative quantisation and multi-index Hamming tables.

A bounded sample teaches rotations that turn a vector into bits which halve the
sample each: principal axes, then the rotation that loses least when every
coordinate becomes its sign.  The bits are cut into tables; two vectors are
compared when they agree on all bits of some table, and the cosine of the
original vectors decides.

Equal vectors of a label are one class with a number of copies.  Classes of a
bucket are compared in block pairs inside tasks, each pair only in the first
table that holds it together, and what leaves a task is one row per class: how
many vectors it is linked with there and the least class it hangs together
with.  So a group of a million near copies costs its comparisons, never a row
per pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flipside.llm.arrow_groups import key_runs
from flipside.llm.common import written
from flipside.llm.components import components


@dataclass(frozen=True)
class ItqConfig:
    similarity: float = 0.98
    recall: float = 0.9995  # wanted for a pair at the threshold; closer pairs are found more surely
    bucket: int = 64  # classes of the largest label that shall meet in a bucket
    most_bits: int = 24  # of a table
    sample: int = 16_384  # vectors to learn the rotations from
    sweeps: int = 30
    block: int = 2048
    seed: int = 1


def table_plan(classes: int, cfg: ItqConfig) -> tuple[int, int]:
    """(bits of a table, tables): buckets of about `bucket` classes, and so many tables that a pair
    at the threshold, whose bits differ with probability angle / pi, agrees in one with `recall`."""
    bits = min(cfg.most_bits, max(2, math.ceil(math.log2(max(1, classes / cfg.bucket)))))
    same = (1 - math.acos(max(-1.0, min(1.0, cfg.similarity))) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - cfg.recall) / math.log(max(1e-12, 1 - same))))


def learn_planes(sample: np.ndarray, bits: int, cfg: ItqConfig) -> tuple[np.ndarray, np.ndarray]:
    """(d x bits matrix, thresholds) for unit vectors: as many learnt rotations as the bits need."""
    d = sample.shape[1]
    rng = np.random.default_rng(cfg.seed)
    mean = sample.mean(axis=0)
    centred = sample - mean
    axes = np.linalg.eigh(centred.T @ centred)[1][:, ::-1]
    v = centred @ axes
    planes = []
    for _ in range(math.ceil(bits / d)):
        r = np.linalg.qr(rng.standard_normal((d, d)))[0]
        for _ in range(cfg.sweeps):
            left, _, right = np.linalg.svd(v.T @ np.where(v @ r >= 0, 1.0, -1.0))
            r = left @ right
        planes.append(axes @ r)
    planes = np.concatenate(planes, axis=1)[:, :bits]
    return planes, np.median(sample @ planes, axis=0)


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _codes(x: np.ndarray, bits: int, tables: int, planes: tuple[np.ndarray, np.ndarray] | None, seed: int) -> np.ndarray:
    """One integer per table; vectors of a length the planes were not learnt for are cut by random planes."""
    d = x.shape[1]
    if planes is None or planes[0].shape[0] != d:
        planes = np.random.default_rng((seed, d)).standard_normal((d, bits * tables)), np.zeros(bits * tables)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    on = (unit @ planes[0] >= planes[1]).reshape(len(x), tables, bits)
    return on @ (1 << np.arange(bits, dtype=np.int64))


def _encode(batches: Iterator[pa.RecordBatch], bits: int, tables: int, planes: tuple | None, seed: int) -> Iterator[pa.RecordBatch]:
    """The class rows with their codes."""
    for b in batches:
        size = np.asarray(b.column(2))
        for d in np.unique(size):
            part = b.take(pa.array(np.flatnonzero(size == d)))
            codes = _codes(_matrix(part.column(3)), bits, tables, planes, seed)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(codes), pa.list_(pa.int64()))], names=[*part.schema.names, "codes"])


def _least(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The least number reachable from each of n numbers by the links (i, j)."""
    now = np.arange(n)
    while True:
        new = now.copy()
        np.minimum.at(new, i, now[j])
        np.minimum.at(new, j, now[i])
        new = new[new]
        if (new == now).all():
            return now
        now = new


def cosines(x: np.ndarray, y: np.ndarray, limit: float) -> np.ndarray:
    """All cosines of two blocks; those next to the limit are taken row by row, so that they do not depend on the blocks."""
    nx, ny = np.sqrt(np.einsum("ij,ij->i", x, x)), np.sqrt(np.einsum("ij,ij->i", y, y))
    s = (x / nx[:, None]) @ (y / ny[:, None]).T
    i, j = np.nonzero(np.abs(s - limit) < 1e-9)
    if len(i):
        s[i, j] = np.einsum("ij,ij->i", x[i], y[j]) / (nx[i] * ny[j])
    return s


def _tile(batches: Iterator[pa.RecordBatch], limit: float) -> Iterator[pa.RecordBatch]:
    """(cno, links, root) of each class with a link in a block pair of a bucket."""
    for group in key_runs(batches, 6):
        if group.num_rows < 2:
            continue
        tab, low, high = (int(group.column(k)[0].as_py()) for k in (2, 4, 5))
        side, cno, copies = (np.asarray(group.column(k)) for k in (6, 7, 8))
        codes, x = np.asarray(group.column(9).combine_chunks().flatten()).reshape(len(cno), -1), _matrix(group.column(10))
        a = np.flatnonzero(side == low)
        b = a if low == high else np.flatnonzero(side == high)
        if not len(a) or not len(b):
            continue
        hit = cosines(x[a], x[b], limit) >= limit
        if low == high:
            hit = np.triu(hit, 1)
        if not hit.any():
            continue
        for t in range(tab):  # met there already
            hit &= codes[a, t][:, None] != codes[b, t][None, :]
        i, j = np.nonzero(hit)
        i, j = a[i], b[j]
        links = np.bincount(i, copies[j], len(cno)) + np.bincount(j, copies[i], len(cno))
        order = np.argsort(cno, kind="stable")
        place = np.empty(len(cno), np.int64)
        place[order] = np.arange(len(cno))
        root = cno[order][_least(place[i], place[j], len(cno))][place]
        some = np.flatnonzero(links > 0)
        yield pa.RecordBatch.from_arrays([pa.array(cno[some]), pa.array(links[some].astype(np.int64)), pa.array(root[some])], names=["cno", "links", "root"])


def _valid(vec: Column) -> Column:
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vec.isNotNull() & ~bad & F.exists(vec, lambda x: x != 0)


def near_vectors(vectors: DataFrame, cfg: ItqConfig = ItqConfig()) -> DataFrame:
    """One row per row of `vectors` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Two rows are linked when their labels are equal and not null, their vectors
    have as many components, and the cosine is at least `similarity`.  A vector
    that is null, all zeros or holds a null or non-finite component links with
    nothing.  Repeated rows count as often as they occur.  component_id is the
    smallest vec_id reachable, null where only null ids are; `kept` says that
    it is the row's own (also null) id.  Other columns are not read; an empty
    table gives an empty one.
    """
    element = vectors.schema["embedding"].dataType.elementType
    kind = "array<float>" if isinstance(element, T.FloatType) else "array<double>"
    whole = isinstance(vectors.schema["label"].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    lab = F.col("label").cast("long") if whole else F.when(F.col("label").isNotNull(), F.xxhash64(F.col("label").cast("string")))
    vec = F.col("embedding").cast(kind)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), lab.alias("lab"), F.when(_valid(vec) & lab.isNotNull(), vec).alias("vec"))
    alone, rows = rows.filter("vec is null"), rows.filter("vec is not null")
    grouped = rows.groupBy("lab", "vec").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least_id"))
    classes = written(grouped.select(F.monotonically_increasing_id().alias("cno"), "lab", F.size("vec").alias("d"), "vec", "copies", "least_id"), "vector-classes")
    top = classes.groupBy("d").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    most = classes.groupBy("lab", "d").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    bits, tables = table_plan(most, cfg)
    planes = None
    if top is not None:
        picked = classes.filter(F.col("d") == top["d"]).select("cno", "vec").orderBy(F.xxhash64(F.lit(cfg.seed), "vec"), "vec").limit(cfg.sample).collect()
        x = np.array([r["vec"] for r in picked], np.float64)
        planes = learn_planes(x / np.linalg.norm(x, axis=1, keepdims=True), bits * tables, cfg)
    encode = partial(_encode, bits=bits, tables=tables, planes=planes, seed=cfg.seed)
    coded = written(classes.select("cno", "lab", "d", "vec", "copies").mapInArrow(encode, f"cno long, lab long, d int, vec {kind}, copies long, codes array<long>"), "codes")
    bucket = ["lab", "d", "tab", "code"]
    where = coded.select("lab", "d", F.posexplode("codes").alias("tab", "code")).groupBy(*bucket).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # Buckets that one block holds are the rule; the others are listed with their number of blocks.
    large = written(where.filter(F.col("n") > cfg.block).select(*bucket, F.ceil(F.col("n") / cfg.block).cast("int").alias("blocks")), "large-buckets")
    placed = coded.select("lab", "d", F.posexplode("codes").alias("tab", "code"), "cno", "copies", "codes", "vec").join(large, bucket, "left")
    placed = placed.withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("mine", F.pmod(F.xxhash64("cno"), F.col("blocks")).cast("int"))
    tiles = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = tiles.select(*bucket, F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "mine", "cno", "copies", "codes", "vec")
    keys = [*bucket, "low", "high"]
    met = tiles.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(partial(_tile, limit=cfg.similarity), "cno long, links long, root long")
    met = written(met, "vector-links")
    links = met.groupBy("cno").agg(F.sum("links").alias("links"))
    tied = components(met.select(F.col("cno").alias("a"), F.col("root").alias("b")))
    known = classes.select("cno", "copies", "least_id").join(links, "cno", "left").join(tied.withColumnRenamed("node", "cno"), "cno", "left")
    known = known.select("cno", F.coalesce("least", "cno").alias("root"), "least_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    least = known.groupBy("root").agg(F.min("least_id").alias("component_id"))
    facts = written(known.join(least, "root").select("cno", "n_links", "component_id"), "vector-facts")
    by_vec = classes.select("cno", "lab", "vec").join(facts, "cno").select("lab", "vec", "n_links", "component_id")
    out = rows.join(by_vec, ["lab", "vec"]).select("vec_id", "n_links", "component_id")
    single = alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(single).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
