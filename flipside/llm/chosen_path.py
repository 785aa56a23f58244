"""N-gram Jaccard join by chosen paths.

A text is the set of its five-word shingles, and a set is sketched by T
minimum hashes.  A run starts with all sets at one node.  A node chooses 1/t
hash positions on average (t: the similarity asked for) and sends each set to
one child per chosen position, named after the set's hash there; sets that
agree often meet again and again.  Small nodes, and nodes that choosing further
would not thin out, are compared pair by pair; other large nodes are split
again.  Runs are repeated until a pair at the threshold is found with the
target recall.  Sets of nodes that are split below `design_depth` go through
more runs, as a pair is lost more easily on a longer path.  Every compared pair is judged on the exact shingle sets.

Equal sets are one class from the start.  Large nodes are compared in pairs of
blocks, so neither copies nor near copies meet in one task, and no pair leaves
the task that finds it: out come link counts and the edges of a forest.  A pair
that meets in several nodes counts in the least one only.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flipside.llm.arrow_groups import key_runs, rows_per_batch
from flipside.llm.common import written
from flipside.llm.components import components

U64 = np.uint64
CACHE_WORDS = 200_000  # frequent words come early; later ones are hashed each time


@dataclass(frozen=True)
class JoinConfig:
    words: int = 5
    threshold: float = 0.8
    hashes: int = 128  # T
    recall: float = 0.999  # of a pair at the threshold, however deep its nodes are
    design_depth: int = 4
    max_depth: int = 8
    small: int = 256  # sets that a node may hold to be compared at once
    dense: float = 0.7  # a child with this share of its parent's sets is not split further
    block: int = 1024
    slack: float = 0.18  # sketches this far below the threshold are still compared exactly: 5 standard deviations
    seed: int = 5

    def _runs(self, depth: int, part: float) -> int:
        """Runs until a pair at the threshold that must go `depth` nodes deep is missed by `part` of 1 - recall at most.

        All runs read one sketch, so the pair's agreement there is the same in
        each: the misses are averaged over that binomial number.
        """
        low = math.floor(1 / self.threshold)
        more = 1 / self.threshold - low
        agree = np.arange(self.hashes + 1)
        ways = [math.lgamma(self.hashes + 1) - math.lgamma(k + 1) - math.lgamma(self.hashes - k + 1) for k in range(self.hashes + 1)]
        odds = np.exp(ways + agree * math.log(self.threshold) + (self.hashes - agree) * math.log1p(-self.threshold))
        meet = np.ones(self.hashes + 1)
        for _ in range(depth):
            miss = 1 - agree / self.hashes * meet
            meet = 1 - (1 - more) * miss**low - more * miss ** (low + 1)
        runs = 1
        while odds @ (1 - meet) ** runs > (1 - self.recall) * part:
            runs += 1
        return runs

    @property
    def runs(self) -> int:
        """Runs of all sets."""
        return self._runs(self.design_depth, 0.55)

    @property
    def deep_runs(self) -> int:
        """Runs, the first ones included, of sets in nodes that are split below `design_depth`.

        A pair is lost when no run takes it to `design_depth`, or when one does
        into a node that is split again, which gives both sets these runs, and
        all of them miss it: 1 - recall at most together.
        """
        return self._runs(max(self.max_depth, self.design_depth), 0.45)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (fixed constants of splitmix64)."""
    x = np.asarray(x, U64).copy()
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) < CACHE_WORDS:
            self[word] = value
        return value


_HASHES = _WordHashes()


def shingles(text: str, k: int) -> np.ndarray:
    """Sorted 64-bit hashes of the text's k-word shingles; fewer words make one shingle, none make none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, U64)
    h = np.fromiter(map(_HASHES.__getitem__, words), U64, len(words))
    k = min(k, len(h))
    step = U64(0x9E3779B97F4A7C15)
    out = np.full(len(h) - k + 1, k, U64)
    for j in range(k):
        out = out * step + mix(h[j : len(h) - k + 1 + j])
    return np.unique(mix(out))


def sketch(sets: np.ndarray, hashes: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 63, hashes, dtype=np.uint64) * U64(2) + U64(1)
    b = rng.integers(0, 1 << 63, hashes, dtype=np.uint64)
    best = np.full(hashes, np.iinfo(np.uint64).max, U64)
    for at in range(0, len(sets), 8192):
        hashed = np.multiply.outer(a, sets[at : at + 8192])
        hashed += b[:, None]
        np.minimum(best, hashed.min(axis=1), out=best)
    return (best >> U64(32)).astype(np.uint32)


def _sketches(batches: Iterator[pa.RecordBatch], cfg: JoinConfig) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "text_hash", "sid", "n", "sig"]
    for b in batches:
        sids, ns, sigs = [], [], []
        for text in b.column(2):
            s = shingles(text.as_py() or "", cfg.words)
            sids.append(int.from_bytes(hashlib.md5(s.tobytes()).digest()[:8], "little", signed=True))
            ns.append(len(s))
            sigs.append(sketch(s, cfg.hashes, cfg.seed).tobytes() if len(s) else b"")
        arrays = [b.column(0), b.column(1), pa.array(sids, pa.int64()), pa.array(ns, pa.int32()), pa.array(sigs, pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=names)


def _sig_matrix(column: pa.ChunkedArray | pa.Array, hashes: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, hashes)


def _children(nodes: np.ndarray, sigs: np.ndarray, cfg: JoinConfig) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, child nodes) for each of the positions that the nodes choose."""
    least = math.floor(1 / cfg.threshold)
    share = 1 / cfg.threshold - least
    extra = (mix(nodes ^ U64(0xA5A5A5A5)) >> U64(11)).astype(np.float64) / 2.0**53 < share
    for j in range(least + 1):
        rows = np.arange(len(nodes)) if j < least else np.flatnonzero(extra)
        v = nodes[rows]
        position = mix(v + U64(j + 1)) % U64(cfg.hashes)
        value = sigs[rows, position.astype(np.int64)].astype(U64)
        yield rows, mix(v ^ mix((position << U64(32)) + value + U64(1)))


def _roots(batches: Iterator[pa.RecordBatch], cfg: JoinConfig, runs: range) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not len(b):
            continue
        sids, sigs = np.asarray(b.column(0)), _sig_matrix(b.column(1), cfg.hashes)
        for run in runs:
            root = np.full(len(b), mix(np.array([cfg.seed * 1000 + run]))[0], U64)
            for rows, child in _children(root, sigs, cfg):
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(sids[rows])], names=["node", "sid"])


def _split(batches: Iterator[pa.RecordBatch], cfg: JoinConfig) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not len(b):
            continue
        nodes, sids, sizes = (np.asarray(b.column(i)) for i in range(3))
        for rows, child in _children(nodes.view(U64), _sig_matrix(b.column(3), cfg.hashes), cfg):
            yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(sids[rows]), pa.array(sizes[rows])], names=["node", "sid", "above"])


def _run_leaves(sigs: DataFrame, cfg: JoinConfig, runs: range) -> tuple[DataFrame, DataFrame | None]:
    """(node, sid, size): the nodes to compare of some runs, level by level; sids of nodes split below `design_depth`."""
    members = sigs.mapInArrow(partial(_roots, cfg=cfg, runs=runs), "node long, sid long").withColumn("above", F.lit(None).cast("long"))
    leaves = deep = None
    for depth in range(1, cfg.max_depth + 1):
        members = written(members, "paths")
        sizes = members.groupBy("node").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        met = members.join(sizes, "node")
        last = (F.col("size") <= cfg.small) | F.coalesce(F.col("size") >= cfg.dense * F.col("above"), F.lit(False)) | F.lit(depth == cfg.max_depth)
        level = written(met.select("node", "sid", "size", last.alias("leaf")), "nodes")
        done = level.filter("leaf").select("node", "sid", "size")
        leaves = done if leaves is None else leaves.unionByName(done)
        large = level.filter("not leaf")
        if large.isEmpty():
            break
        if depth == cfg.design_depth:
            deep = large.select("sid").distinct()
        fed = large.join(sigs, "sid").select("node", "sid", "size", "sig")
        members = fed.mapInArrow(partial(_split, cfg=cfg), "node long, sid long, above long")
    return leaves, deep


def _leaves(sets: DataFrame, cfg: JoinConfig) -> DataFrame:
    """(node, sid, size): all nodes to compare."""
    sigs = sets.filter("n > 0").select("sid", "sig")
    leaves, deep = _run_leaves(sigs, cfg, range(cfg.runs))
    if deep is None or cfg.deep_runs <= cfg.runs:
        return leaves
    more, _ = _run_leaves(written(sigs.join(deep, "sid"), "deep-sets"), cfg, range(cfg.runs, cfg.deep_runs))
    return leaves.unionByName(more)


def _block_pairs(leaves: DataFrame, cfg: JoinConfig) -> DataFrame:
    """Every set of a node in each of the block pairs (bi <= bj) it has to meet; `mine` is its own block."""
    blocks = F.ceil(F.col("size") / cfg.block).cast("int")
    df = leaves.withColumn("mine", F.pmod(F.xxhash64("sid"), blocks).cast("int"))
    df = df.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return df.select("node", F.least("mine", "other").alias("bi"), F.greatest("mine", "other").alias("bj"), "mine", "sid")


def _grouped(df: DataFrame) -> DataFrame:
    return df.repartition("node", "bi", "bj").sortWithinPartitions("node", "bi", "bj")


def _sides(group: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    bi, bj = group.column(1)[0].as_py(), group.column(2)[0].as_py()
    mine = np.asarray(group.column(3))
    return np.flatnonzero(mine == bi), np.flatnonzero(mine == bj), bi == bj


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if a.shape[0] * b.shape[0] * a.shape[1] <= 1 << 20:
        return (a[:, None, :] == b[None, :, :]).sum(axis=2)
    out = np.zeros((len(a), len(b)), np.int32)
    for i in range(a.shape[1]):
        out += a[:, i, None] == b[None, :, i]
    return out


def _likely(batches: Iterator[pa.RecordBatch], cfg: JoinConfig) -> Iterator[pa.RecordBatch]:
    """Sets with a partner in their block pair whose sketch may reach the threshold."""
    need = (cfg.threshold - cfg.slack) * cfg.hashes

    def rows():
        for group in key_runs(batches, 3):
            left, right, same = _sides(group)
            if len(left) < 1 or len(right) < 1:
                continue
            sigs, sids = _sig_matrix(group.column(5), cfg.hashes), group.column(4).to_pylist()
            close = _agreement(sigs[left], sigs[right]) >= need
            if same:
                np.fill_diagonal(close, False)
            node = group.column(0)[0].as_py()
            for i in {*left[close.any(axis=1)], *right[close.any(axis=0)]}:
                yield node, sids[i]

    yield from rows_per_batch(20_000, pa.schema([("node", pa.int64()), ("sid", pa.int64())]), rows())


def _sets_of(batches: Iterator[pa.RecordBatch], cfg: JoinConfig) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep_sid, keep = [], []
        for sid, text in zip(b.column(0).to_pylist(), b.column(1)):
            s = shingles(text.as_py() or "", cfg.words)
            if int.from_bytes(hashlib.md5(s.tobytes()).digest()[:8], "little", signed=True) == sid:
                keep_sid.append(sid)
                keep.append(s.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(keep_sid, pa.int64()), pa.array(keep, pa.binary())], names=["sid", "shingles"])


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, through 0/1 matrices over the tokens that both sides hold."""
    out = np.zeros((len(left), len(right)), np.float32)
    la, ra = np.repeat(np.arange(len(left)), [len(s) for s in left]), np.repeat(np.arange(len(right)), [len(s) for s in right])
    lv, rv = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(lv, rv)
    li, ri = np.searchsorted(shared, lv), np.searchsorted(shared, rv)
    for (v, i, r) in ((lv, li, 0), (rv, ri, 1)):
        np.minimum(i, max(len(shared) - 1, 0), out=i)
    if not len(shared):
        return out
    lk, rk = shared[li] == lv, shared[ri] == rv
    li, la, ri, ra = li[lk], la[lk], ri[rk], ra[rk]
    for at in range(0, len(shared), 4096):
        width = min(4096, len(shared) - at)
        a, b = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        k = (li >= at) & (li < at + width)
        a[la[k], li[k] - at] = 1
        k = (ri >= at) & (ri < at + width)
        b[ra[k], ri[k] - at] = 1
        out += a @ b.T
    return out


def _seen_before(keys: list[np.ndarray], left: np.ndarray, right: np.ndarray, node: int) -> np.ndarray:
    """Pairs that also meet in a node before this one."""
    seen = np.zeros((len(left), len(right)), bool)
    at: dict[int, tuple[list[int], list[int]]] = {}
    for side, rows in enumerate((left, right)):
        for place, r in enumerate(rows):
            for k in keys[r]:
                if k < node:
                    at.setdefault(k, ([], []))[side].append(place)
    for a, b in at.values():
        if a and b:
            seen[np.ix_(a, b)] = True
    return seen


def _roots_of(hits: np.ndarray) -> np.ndarray:
    """Least member of each row's component in a symmetric boolean matrix."""
    label = np.arange(len(hits))
    while True:
        low = np.where(hits, label[None, :], len(hits)).min(axis=1)
        new = np.minimum(label, low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _verify(batches: Iterator[pa.RecordBatch], cfg: JoinConfig) -> Iterator[pa.RecordBatch]:
    """(sid, links, root): exact links of a block pair and the sets' components there."""

    def rows():
        for group in key_runs(batches, 3):
            left, right, same = _sides(group)
            if len(left) < 1 or len(right) < 1 or (same and len(left) < 2):
                continue
            node = group.column(0)[0].as_py()
            keys = group.column(6).to_pylist()
            seen = _seen_before(keys, left, right, node)
            if same:
                np.fill_diagonal(seen, True)
            if seen.all():
                continue
            sids = np.asarray(group.column(4))
            sets = [np.frombuffer(s, U64) for s in group.column(5).to_pylist()]
            inter = _overlaps([sets[i] for i in left], [sets[i] for i in right]).astype(np.float64)
            n = np.array([len(s) for s in sets], np.float64)
            hits = (inter >= cfg.threshold * (n[left][:, None] + n[right][None, :] - inter) - 1e-9) & ~seen
            if not hits.any():
                continue
            if same:
                members, links, whole = left, hits.sum(axis=1), hits
            else:
                members = np.concatenate([left, right])
                links = np.concatenate([hits.sum(axis=1), hits.sum(axis=0)])
                whole = np.zeros((len(members), len(members)), bool)
                whole[: len(left), len(left) :] = hits
                whole |= whole.T
            root = _roots_of(whole)
            for i in np.flatnonzero(links):
                yield int(sids[members[i]]), int(links[i]), int(sids[members[root[i]]])

    yield from rows_per_batch(20_000, pa.schema([("sid", pa.int64()), ("links", pa.int64()), ("root", pa.int64())]), rows())


def jaccard_classes(docs: DataFrame, cfg: JoinConfig = JoinConfig()) -> DataFrame:
    """doc_id, text_hash, class_key, class_id, rep_id, links, n_shingles for every row of `docs`.

    Reads doc_id and text.  `rep_id` is the least doc_id with the same shingle
    set, `links` the number of different shingle sets at the threshold or
    above, and `class_id` the least doc_id that links, directly or through
    others, lead to.  `class_key` tells classes apart even where ids are
    missing or used twice.  Texts without words (null, empty) form one class without
    links.  Repeated rows and copies share everything; a missing id is named by
    null only if its whole class has none.  An empty table gives an empty table.
    Sets are named by 64 bits of their digest.
    """
    text_hash = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash.alias("text_hash"), "text")
    rows = written(narrow.mapInArrow(partial(_sketches, cfg=cfg), "doc_id long, text_hash long, sid long, n int, sig binary"), "sketches")
    rep = F.min(F.struct(F.isnull("doc_id"), "doc_id", "text_hash"))  # a missing id names a set only if all its ids are missing
    grouped = rows.groupBy("sid").agg(rep.alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    sets = written(grouped.select("sid", F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_hash").alias("rep_hash"), "n", "sig"), "sets")
    leaves = _leaves(sets, cfg)
    fed = _block_pairs(leaves, cfg).join(sets.select("sid", "sig"), "sid").select("node", "bi", "bj", "mine", "sid", "sig")
    likely = written(_grouped(fed).mapInArrow(partial(_likely, cfg=cfg), "node long, sid long").distinct(), "likely")
    wanted = likely.select("sid").distinct().join(sets, "sid").select("sid", F.col("rep_id").alias("__rep"), F.col("rep_hash").alias("__hash"))
    own = (F.col("text_hash") == F.col("__hash")) & F.col("doc_id").eqNullSafe(F.col("__rep"))
    texts = narrow.join(wanted.hint("shuffle_hash"), own).select("sid", "text")
    exact = written(texts.mapInArrow(partial(_sets_of, cfg=cfg), "sid long, shingles binary").dropDuplicates(["sid"]), "exact-sets")
    keys = likely.groupBy("sid").agg(F.sort_array(F.collect_set("node")).alias("keys"))
    sized = likely.join(likely.groupBy("node").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "node")
    fed = _block_pairs(sized, cfg).join(exact.join(keys, "sid"), "sid").select("node", "bi", "bj", "mine", "sid", "shingles", "keys")
    found = written(_grouped(fed).mapInArrow(partial(_verify, cfg=cfg), "sid long, links long, root long"), "links")
    links = found.groupBy("sid").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("sid").alias("a"), F.col("root").alias("b")))
    named = sets.select("sid", "rep_id", "n").join(joined.select(F.col("node").alias("sid"), "least"), "sid", "left")
    named = named.withColumn("least", F.coalesce("least", "sid"))
    least = named.groupBy("least").agg(F.min("rep_id").alias("class_id"))
    named = written(named.join(least, "least").join(links, "sid", "left").select("sid", "rep_id", "n", F.col("least").alias("class_key"), "class_id", F.coalesce("links", F.lit(0)).cast("long").alias("links")), "classes")
    return rows.select("doc_id", "text_hash", "sid").join(named, "sid").select("doc_id", "text_hash", "class_key", "class_id", "rep_id", "links", F.col("n").cast("long").alias("n_shingles"))


def drop_near_copies(docs: DataFrame, cfg: JoinConfig = JoinConfig()) -> DataFrame:
    """The rows of `docs` with the least doc_id of their class; of rows that share it, one."""
    first = W.partitionBy("class_key").orderBy("text_hash")
    classes = jaccard_classes(docs, cfg).filter(F.col("doc_id").eqNullSafe(F.col("class_id")))
    kept = classes.withColumn("__n", F.row_number().over(first)).filter("__n = 1").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    keyed = docs.withColumn("__hash_of", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    met = keyed.join(kept.hint("shuffle_hash"), F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__hash_of") == F.col("__hash")))
    again = F.row_number().over(W.partitionBy("__id", "__hash").orderBy(F.lit(1)))
    return met.withColumn("__again", again).filter("__again = 1").select(*docs.columns)
