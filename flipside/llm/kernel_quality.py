"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

A text becomes a short vector of statistics.  Random Fourier features turn it
into an approximation of a Gaussian kernel; every partition of the labelled
rows sums its part of the normal equations, and the sums, whose size depends on
the number of features alone, are solved for the ridge weights.  Rows held back
from the fit calibrate the ridge scores by isotonic regression.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flipside.llm.common import crc_fold, written

N_STATS = 16
SCORE_STEPS = 1024  # score bins per unit for the calibration, between -1 and 2


@dataclass(frozen=True)
class KernelConfig:
    features: int = 256
    gamma: float = 0.05  # of exp(-gamma |x - y|^2) on standardised statistics
    ridge: float = 1e-3  # per labelled row
    calibration_fifths: int = 1  # fifths of the labelled rows held back from the fit
    seed: int = 6


def text_stats(text: str) -> list[float]:
    """Statistics of a whole text: sizes, character classes, repetition of words and lines."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    n = max(len(raw), 1)
    by = np.bincount(raw, minlength=256) if len(raw) else np.zeros(256, int)
    words = text.split()
    m = max(len(words), 1)
    counts = Counter(words)
    lines = text.split("\n")
    upper, lower, digits = by[65:91].sum(), by[97:123].sum(), by[48:58].sum()
    marks = by[33:48].sum() + by[58:65].sum() + by[91:97].sum() + by[123:127].sum()
    usual = by[44] + by[46]
    top = sum(c for _, c in counts.most_common(3))
    return [
        math.log1p(len(text)), math.log1p(len(words)), math.sqrt(len(text) / m), upper / max(upper + lower, 1), digits / n,
        math.sqrt(max(marks - usual, 0) / n), math.sqrt(by[33] / m), math.sqrt(by[124] / m), math.sqrt((by[35] + by[36] + by[37] + by[38] + by[42]) / m),
        usual / m, len(counts) / m, math.sqrt(top / m), len(set(lines)) / len(lines), math.log1p(len(words) / len(lines)), by[128:].sum() / n, math.sqrt(digits / m),
    ]


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [text_stats(t.as_py() or "") for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "stats"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


@dataclass
class KernelMap:
    """Standardisation and the random features cos(xW + b)."""

    mean: np.ndarray
    scale: np.ndarray
    cfg: KernelConfig

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(self.cfg.seed)
        w = rng.normal(0.0, math.sqrt(2 * self.cfg.gamma), (len(self.mean), self.cfg.features))
        b = rng.uniform(0.0, 2 * math.pi, self.cfg.features)
        x = np.clip((stats - self.mean) / self.scale, -8.0, 8.0)
        z = math.sqrt(2.0 / self.cfg.features) * np.cos(x @ w + b)
        return np.hstack([z, np.ones((len(z), 1))])


def _normal_sums(batches: Iterator[pa.RecordBatch], kernel: KernelMap) -> Iterator[pa.RecordBatch]:
    """Row i of this partition's sum of [Z'Z | Z'y | n]."""
    d = kernel.cfg.features + 1
    total = np.zeros((d, d + 1))
    for b in batches:
        z = kernel(_matrix(b.column(0)))
        y = np.asarray(b.column(1), dtype=np.float64)
        total[:, :d] += z.T @ z
        total[:, d] += z.T @ y
    yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "v"])


def _add_up(group: pa.Table) -> pa.Table:
    """One row of the sums: as many rows come in as there are partitions."""
    v = _matrix(group.column("v").combine_chunks()).sum(axis=0)
    return pa.table({"i": group.column("i").slice(0, 1), "v": pa.array([v], pa.list_(pa.float64()))})


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over sorted x: block centres and their rising means."""
    blocks: list[list[float]] = []
    for xi, yi, wi in zip(x, y, w):
        blocks.append([xi * wi, yi * wi, wi])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


@dataclass
class QualityModel:
    kernel: KernelMap | None  # none: nothing was labelled
    weights: np.ndarray | None = None
    steps: tuple[np.ndarray, np.ndarray] | None = None

    def scores(self, stats: np.ndarray) -> np.ndarray:
        if self.kernel is None or not len(stats):
            return np.full(len(stats), 0.5)
        return np.interp(self.kernel(stats) @ self.weights, *self.steps)


def _apply(batches: Iterator[pa.RecordBatch], model: QualityModel) -> Iterator[pa.RecordBatch]:
    for b in batches:
        score = pa.array(model.scores(_matrix(b.column(2))), pa.float64())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), score], names=["doc_id", "held_out", "score"])


def _keep(batches: Iterator[pa.RecordBatch], model: QualityModel, text: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        stats = np.array([text_stats(t.as_py() or "") for t in b.column(text)]).reshape(len(b), N_STATS)
        yield b.filter(pa.array(model.scores(stats) >= 0.5))


def _with_raw(batches: Iterator[pa.RecordBatch], kernel: KernelMap, weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw = kernel(_matrix(b.column(1))) @ weights if len(b) else np.zeros(0)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.float64())], names=["y", "raw"])


def stats_table(docs: DataFrame, folds: int = 3, held_out_fold: int = 1) -> DataFrame:
    """doc_id, held_out and the statistics of every text, written to the shared folder."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held = crc_fold(F.col("doc_id"), folds) == held_out_fold
    return written(narrow.mapInArrow(_stats, "doc_id long, stats array<double>").select("doc_id", held.alias("held_out"), "stats"), "quality-stats")


def fit_quality(rows: DataFrame, labels: DataFrame, cfg: KernelConfig = KernelConfig()) -> QualityModel:
    """Learns from the rows of a stats table that have a label and are not held out."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y")).filter("y is not null and doc_id is not null")
    marks = marks.groupBy("doc_id").agg(F.avg("y").alias("y"))
    known = written(rows.filter(~F.col("held_out")).join(marks, "doc_id").select("doc_id", "stats", "y"), "quality-known")
    moments = [f(F.col("stats")[i]).alias(f"{k}{i}") for i in range(N_STATS) for k, f in (("m", F.avg), ("s", F.stddev_pop))]
    row = known.agg(F.count(F.lit(1)).alias("n"), *moments).first()
    if not row["n"]:
        return QualityModel(None)
    scale = np.array([row[f"s{i}"] for i in range(N_STATS)])
    kernel = KernelMap(np.array([row[f"m{i}"] for i in range(N_STATS)]), np.where(scale > 1e-9, scale, 1.0), cfg)
    fifth = F.pmod(F.xxhash64(F.lit(cfg.seed), "doc_id"), F.lit(5))
    few = row["n"] < 50
    fit = known if few else known.filter(fifth >= cfg.calibration_fifths)
    back = known if few else known.filter(fifth < cfg.calibration_fifths)
    d = cfg.features + 1
    sums = fit.select("stats", "y").mapInArrow(partial(_normal_sums, kernel=kernel), "i int, v array<double>")
    sums = sums.groupBy("i").applyInArrow(_add_up, "i int, v array<double>")
    total = np.array([r["v"] for r in sorted(sums.collect(), key=lambda r: r["i"])])  # (features + 1) x (features + 2) numbers
    gram, rhs = total[:, :d], total[:, d]
    penalty = np.eye(d) * cfg.ridge * max(gram[d - 1, d - 1], 1.0) / cfg.features
    penalty[d - 1, d - 1] = 1e-9
    weights = np.linalg.solve(gram + penalty, rhs)
    raw = back.select("y", "stats").mapInArrow(partial(_with_raw, kernel=kernel, weights=weights), "y double, raw double")
    bin_ = F.floor(F.greatest(F.lit(-1.0), F.least(F.lit(2.0), F.col("raw"))) * SCORE_STEPS)
    bins = raw.groupBy(bin_.alias("bin")).agg(F.avg("raw").alias("x"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("w")).orderBy("bin").collect()  # 3 * SCORE_STEPS at most
    return QualityModel(kernel, weights, isotonic(*[np.array([float(b[k]) for b in bins]) for k in ("x", "y", "w")]))


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out_fold: int = 1, cfg: KernelConfig = KernelConfig()) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs`.

    Reads doc_id and text of `docs`, doc_id and quality of `labels`; statistics
    of the text are the only inputs of a score.  Rows of the held-out fold and
    null labels teach nothing; a document labelled repeatedly has the mean
    label.  Null texts are empty, and empty texts are scored like others.  With
    fewer than 50 labelled rows the calibration learns from the rows that the
    weights were fitted on, from 50 on from a fifth held back for it.  With no
    label every score is 0.5; an empty table gives an empty table.
    """
    rows = stats_table(docs, folds, held_out_fold)
    model = fit_quality(rows, labels, cfg)
    out = rows.select("doc_id", "held_out", "stats").mapInArrow(partial(_apply, model=model), "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_quality(docs: DataFrame, labels: DataFrame, cfg: KernelConfig = KernelConfig()) -> DataFrame:
    """The rows of `docs` whose text is predicted to be good, with their columns."""
    model = fit_quality(stats_table(docs), labels, cfg)
    return docs.mapInArrow(partial(_keep, model=model, text=docs.columns.index("text")), docs.schema)
