"""LM scoring by deleted interpolation of bigram, unigram and uniform estimates.

P(w | h) = l2(b) c(h w) / c(h) + l1(b) c(w) / N + l0(b) / (V + 1), where b is
the bucket of h by the logarithm of its count.  The weights of a bucket are
learned by expectation-maximisation on held-out counts: part of the training
documents is deleted from the counts, and its bigrams are explained by the
counts of the rest.  Scores then use the counts of all training documents.

Counting is a sum over n-gram hashes.  Documents are dealt into batches of
bounded size; a batch sends each of its distinct n-grams once, with its count,
to the n-gram's hash part, and gets the total back in the same order.  A
frequent n-gram is thus one number per batch, and no n-gram table is collected
or broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flipside.llm.common import crc_fold, written

U64 = np.uint64
CACHE_WORDS = 200_000  # frequent words come early; later ones are hashed each time
END, START = U64(0x656E64), U64(0x7374617274)
RATIO_STEPS = 16  # bins per factor of two of an estimate over the uniform one, for the held-out counts


@dataclass(frozen=True)
class LmConfig:
    folds: int = 7
    test_fold: int = 2
    deleted_fold: int = 3  # training documents whose counts are held out for the weights
    batch_bytes: int = 16 << 20
    part_keys: int = 2_000_000
    rounds: int = 25


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (fixed constants of murmur3)."""
    x = np.asarray(x, U64).copy()
    x ^= x >> U64(33)
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) < CACHE_WORDS:
            self[word] = value
        return value


_HASHES = _WordHashes()


def token_hashes(text: str) -> np.ndarray:
    """Hashes of the words, A-Z lower-cased, and of the end.

    bytes.lower changes A-Z only, and bytes.split cuts at the six ASCII white
    space characters only.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    out = np.empty(len(words) + 1, U64)
    out[:-1] = np.fromiter(map(_HASHES.__getitem__, words), U64, len(words))
    out[-1] = END
    return out


def unigram_keys(tokens: np.ndarray) -> np.ndarray:
    return mix(tokens) | U64(1)


def bigram_keys(tokens: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[firsts] = START
    return mix(before * U64(0x9E3779B97F4A7C15) + mix(tokens)) & ~U64(1)


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, sorted, and each value's place among them (one sort; np.unique hashes, which is slower here)."""
    order = np.argsort(values)
    ordered = values[order]
    new = np.ones(len(values), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    place = np.empty(len(values), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    return ordered[new], place


@dataclass
class Batch:
    """Documents of one batch: `keys` are their distinct n-grams, sorted; uni and bi are the tokens' places there."""

    lengths: np.ndarray
    firsts: np.ndarray
    keys: np.ndarray
    uni: np.ndarray
    bi: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> Batch:
        parts = [token_hashes(t) for t in texts]
        lengths = np.array([len(p) for p in parts], np.int64)
        tokens = np.concatenate(parts) if parts else np.zeros(0, U64)
        firsts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if parts else np.zeros(0, np.int64)
        keys, place = distinct(np.concatenate([unigram_keys(tokens), bigram_keys(tokens, firsts)]))
        return cls(lengths, firsts, keys, place[: len(tokens)], place[len(tokens) :])


def _texts(column) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def _count(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """One Spark partition is one batch: its distinct keys and training counts, cut by hash part."""
    table = pa.Table.from_batches(got) if (got := list(batches)) else None
    if table is None or not len(table):
        return
    number, deleted = table.column("batch")[0].as_py(), table.column("deleted")[0].as_py()
    b = Batch.of(_texts(table.column("text")))
    learns = np.repeat(np.asarray(table.column("learns").combine_chunks().cast(pa.int8())), b.lengths).astype(bool)
    places = np.concatenate([b.uni[learns], b.bi[learns]])
    counts = np.bincount(places, minlength=len(b.keys)).astype(np.uint32)
    part = (b.keys >> U64(32)) * U64(parts) >> U64(32)  # rises with the key
    cuts = np.searchsorted(part, np.arange(parts + 1))
    for p in range(parts):
        s = slice(cuts[p], cuts[p + 1])
        if cuts[p + 1] > cuts[p]:
            row = [[number], [deleted], [p], [b.keys[s].tobytes()], [counts[s].tobytes()]]
            types = (pa.int32(), pa.bool_(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)], names=["batch", "deleted", "part", "keys", "counts"])


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One Spark partition is one hash part: every batch's keys again, with their totals."""
    rows = [r for b in batches for r in b.to_pylist()]
    if not rows:
        return
    keys = [np.frombuffer(r["keys"], U64) for r in rows]
    found, at = distinct(np.concatenate(keys))
    counts = np.concatenate([np.frombuffer(r["counts"], np.uint32) for r in rows])
    kept = np.where(np.repeat([r["deleted"] for r in rows], [len(k) for k in keys]), 0, counts)
    total = np.bincount(at, weights=counts, minlength=len(found)).astype(np.int64)
    rest = np.bincount(at, weights=kept, minlength=len(found)).astype(np.int64)
    word = (found & U64(1)).astype(bool)
    facts = [int(total[word].sum()), int((total[word] > 0).sum()), int(rest[word].sum()), int((rest[word] > 0).sum())]
    start = 0
    for i, (r, k) in enumerate(zip(rows, keys)):
        own = at[start : start + len(k)]
        start += len(k)
        kept_bytes = rest[own].astype(np.uint32).tobytes() if r["deleted"] else b""
        row = [[r["batch"]], [r["deleted"]], [r["part"]], [total[own].astype(np.uint32).tobytes()], [kept_bytes], [facts if i == 0 else None]]
        types = (pa.int32(), pa.bool_(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)], names=["batch", "deleted", "part", "total", "rest", "facts"])


def _meet(docs: DataFrame, totals: DataFrame, which: str, batches: int) -> DataFrame:
    """Documents and totals of a batch in one Spark partition: first the documents, then the totals by part."""
    texts = docs.select("batch", F.lit(-1).alias("part"), "doc_id", "held_out", F.col("text").alias("text"), F.lit(None).cast("binary").alias("counts"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("doc_id", "long"), ("held_out", "boolean"), ("text", "string"))]
    counts = totals.select("batch", "part", *none, F.col(which).alias("counts"))
    return texts.unionByName(counts).repartitionById(batches, F.col("batch")).sortWithinPartitions("batch", "part")


def _met(batches: Iterator[pa.RecordBatch]) -> tuple[list, list, Batch, np.ndarray] | None:
    ids, held, texts, counts = [], [], [], []
    for b in batches:
        parts = np.asarray(b.column("part"))
        n = int((parts < 0).sum())
        ids += b.column("doc_id").slice(0, n).to_pylist()
        held += b.column("held_out").slice(0, n).to_pylist()
        texts += _texts(b.column("text").slice(0, n))
        counts += [np.frombuffer(c, np.uint32) for c in b.column("counts").slice(n).to_pylist()]
    if not texts:
        return None
    return ids, held, Batch.of(texts), np.concatenate(counts)


def _context_counts(b: Batch, uni: np.ndarray, starts: int) -> np.ndarray:
    out = np.empty(len(uni), np.int64)
    out[1:] = uni[:-1]
    out[b.firsts] = starts
    return out


def bucket_of(context: np.ndarray) -> np.ndarray:
    """0 for a context that was never seen, else 1 + floor(log2 of its count)."""
    return np.frexp(context.astype(np.float64))[1].astype(np.int64)


def _bins(estimate: np.ndarray, uniform: float) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(estimate > 0, np.round(np.log2(np.maximum(estimate, 1e-300) / uniform) * RATIO_STEPS), -9999).astype(np.int64)


def _held_out_counts(batches: Iterator[pa.RecordBatch], total: int, types: int, starts: int) -> Iterator[pa.RecordBatch]:
    """How often which (bucket, bigram estimate, unigram estimate) explains a held-out token; estimates in bins."""
    met = _met(batches)
    if met is None:
        return
    _, _, b, counts = met
    c1, c12 = counts[b.uni].astype(np.int64), counts[b.bi].astype(np.int64)
    context = _context_counts(b, c1, starts)
    uniform = 1.0 / (types + 1)
    bins = [bucket_of(context), _bins(c12 / np.maximum(context, 1), uniform), _bins(c1 / max(total, 1), uniform)]
    shift = 1 << 20  # bins lie far within 20 bits to both sides
    found, at = distinct((bins[0] << 42) + ((bins[1] + shift // 2) << 21) + bins[2] + shift // 2)
    times = np.bincount(at)
    cols = [pa.array(c, pa.int64()) for c in (found >> 42, ((found >> 21) & (2 * shift - 1)) - shift // 2, (found & (2 * shift - 1)) - shift // 2)]
    yield pa.RecordBatch.from_arrays([*cols, pa.array(times, pa.int64())], names=["bucket", "r2", "r1", "times"])


def learn_weights(held: DataFrame, rounds: int) -> dict[int, tuple[float, float, float]]:
    """(l2, l1, l0) per bucket by EM; a round is one aggregate that returns a row per bucket (64 at most)."""
    start = (0.4, 0.4, 0.2)
    weights: dict[int, tuple[float, float, float]] = {}

    def ratio(col: str):
        return F.when(F.col(col) == -9999, 0.0).otherwise(F.pow(F.lit(2.0), F.col(col) / RATIO_STEPS))

    rows = held.select("bucket", "times", ratio("r2").alias("p2"), ratio("r1").alias("p1"))
    for _ in range(rounds):
        table = [weights.get(i, start) for i in range(66)]
        l2, l1, l0 = (F.array(*[F.lit(w[k]) for w in table])[F.col("bucket").cast("int")] for k in range(3))
        a, b, c = l2 * F.col("p2"), l1 * F.col("p1"), l0
        shares = [F.sum(F.col("times") * x / (a + b + c)).alias(n) for x, n in ((a, "a"), (b, "b"), (c, "c"))]
        got = rows.groupBy("bucket").agg(F.sum("times").alias("n"), *shares).collect()
        # A small even share keeps every estimate possible.
        new = {r["bucket"]: tuple((r[k] + 1e-3) / (r["n"] + 3e-3) for k in "abc") for r in got}
        moved = max((abs(x - y) for k, w in new.items() for x, y in zip(w, weights.get(k, start))), default=0.0)
        weights = new
        if moved < 1e-4:
            break
    return weights


def _score(batches: Iterator[pa.RecordBatch], total: int, types: int, starts: int, weights: dict) -> Iterator[pa.RecordBatch]:
    met = _met(batches)
    if met is None:
        return
    ids, held, b, counts = met
    c1, c12 = counts[b.uni].astype(np.int64), counts[b.bi].astype(np.int64)
    context = _context_counts(b, c1, starts)
    known = sorted(weights)
    table = np.array([weights.get(i) or weights[min(known, key=lambda k: abs(k - i))] if known else (0.4, 0.4, 0.2) for i in range(66)])
    w = table[bucket_of(context)]
    p = w[:, 0] * c12 / np.maximum(context, 1) + w[:, 1] * c1 / max(total, 1) + w[:, 2] / (types + 1)
    base = np.log10((c1 + 1) / (total + types + 1))
    cols = [
        pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(b.lengths, pa.int64()), pa.array(np.add.reduceat((c1 > 0).astype(np.int64), b.firsts)),
        pa.array(np.add.reduceat(base, b.firsts)), pa.array(np.add.reduceat(np.log10(p), b.firsts)),
    ]
    out = pa.Table.from_arrays(cols, names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])
    yield from out.to_batches(max_chunksize=10_000)


def score_documents(docs: DataFrame, cfg: LmConfig = LmConfig()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of `docs`.

    Reads doc_id and text; learns from all rows outside the test fold.  A null
    text is empty and scores its end alone.  Repeated rows count and are scored
    each.  With nothing to learn from, every estimate is uniform; an empty table
    gives an empty table.  N-grams are told apart by 63 bits of a hash.
    """
    spark = docs.sparkSession
    fold = crc_fold(F.col("doc_id"), cfg.folds)
    text = F.coalesce(F.col("text"), F.lit(""))
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    at_least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rest_batches = max(at_least, -(-size["b"] // cfg.batch_bytes))
    deleted_batches = max(1, rest_batches // cfg.folds)
    batches = rest_batches + deleted_batches
    parts = max(at_least, -(-size["b"] // (8 * cfg.part_keys)))
    h = F.xxhash64("doc_id", text)
    deleted = fold == cfg.deleted_fold
    own = F.when(deleted, F.pmod(h, F.lit(deleted_batches))).otherwise(deleted_batches + F.pmod(h, F.lit(rest_batches))).cast("int")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), (fold == cfg.test_fold).alias("held_out"),
        (fold != cfg.test_fold).alias("learns"), deleted.alias("deleted"), own.alias("batch"),
    )
    counted = rows.select("batch", "deleted", "learns", "text").repartitionById(batches, F.col("batch")).mapInArrow(
        partial(_count, parts=parts), "batch int, deleted boolean, part int, keys binary, counts binary"
    )
    totals = written(
        counted.repartitionById(parts, F.col("part")).mapInArrow(_total, "batch int, deleted boolean, part int, total binary, rest binary, facts array<long>"),
        "lm-totals",
    )
    facts = totals.filter("facts is not null").agg(*[F.coalesce(F.sum(F.col("facts")[i]), F.lit(0)).alias(f"f{i}") for i in range(4)]).first()
    starts = rows.agg(F.count_if("learns").alias("all"), F.count_if(F.col("learns") & ~F.col("deleted")).alias("rest")).first()
    held = _meet(rows.filter("deleted"), totals.filter("deleted"), "rest", batches).mapInArrow(
        partial(_held_out_counts, total=facts["f2"], types=facts["f3"], starts=starts["rest"]), "bucket long, r2 long, r1 long, times long"
    )
    weights = learn_weights(written(held.groupBy("bucket", "r2", "r1").agg(F.sum("times").alias("times")), "lm-held-out"), cfg.rounds)
    out = _meet(rows, totals, "total", batches).mapInArrow(
        partial(_score, total=facts["f0"], types=facts["f1"], starts=starts["all"], weights=weights),
        "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double",
    )
    return out.withColumn("train_tokens", F.lit(facts["f0"]).cast("long"))
