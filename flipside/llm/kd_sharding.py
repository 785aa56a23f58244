"""Sharding by a k-d tree over document metadata with distributed weighted medians.

The root holds all documents and as many leaves as shards are wanted.  Every
node is split on its widest metadata dimension, at the value that leaves its
bytes in proportion to the leaves of the two sides, until each node is one
leaf.  All nodes of a level are split together: ranges, then byte histograms
that close in on the wanted value, are small aggregates over the metadata
table; documents' texts are read once and never move.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flipside.llm.common import numbered, written

DIMENSIONS = ("lang", "source", "size", "doc_id")
ROW_BYTES = 16
BINS = 1024
ROUNDS = 5
ROWS_PER_PART = 20_000


@dataclass
class Node:
    """Leaves [low, high); once split: the dimension, its cut value and the two sides."""

    low: int
    high: int
    dim: int = -1
    cut: float = 0.0
    left: Node | None = None
    right: Node | None = None


def _text_number(col: str) -> Column:
    """The first four bytes as a number in byte order (null: 0)."""
    head = F.rpad(F.hex(F.substring(F.coalesce(F.col(col), F.lit("")).cast("binary"), 1, 4)), 8, "0")
    return F.conv(head, 16, 10).cast("double")


def metadata(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and one coordinate per dimension.

    A fraction drawn from id and content is added to every coordinate, so equal
    values (one source holding a third of the rows) can be split anywhere.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        *[(_text_number(c) if c in docs.columns else F.lit(0.0)).alias(f"x_{c}") for c in ("lang", "source")],
    )

    def unit(salt: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(salt), "doc_id", "text_crc32"), F.lit(1 << 20)) / float(1 << 20)

    return base.withColumns(
        {
            "x_lang": F.col("x_lang") + unit(1),
            "x_source": F.col("x_source") + unit(2),
            "x_size": F.floor(F.log2("size") * 1024) + unit(3),
            "x_doc_id": F.coalesce(F.col("doc_id"), F.lit(0)).cast("double") + unit(4),
        }
    )


def _walk(node: Node, leaf) -> Column:
    if node.left is None:
        return F.lit(leaf(node))
    return F.when(F.col(f"x_{DIMENSIONS[node.dim]}") < node.cut, _walk(node.left, leaf)).otherwise(_walk(node.right, leaf))


def _pick(values: list) -> Column:
    return F.array(*[F.lit(v) for v in values])[F.col("node")]


def _split_level(meta: DataFrame, root: Node, active: list[Node], extent: list[float]) -> None:
    place = {id(n): i for i, n in enumerate(active)}
    rows = meta.withColumn("node", _walk(root, lambda n: place.get(id(n), -1))).filter("node >= 0")
    found = rows.groupBy("node").agg(
        F.sum("size").alias("bytes"), *[f(f"x_{d}").alias(f"{k}_{d}") for d in DIMENSIONS for k, f in (("min", F.min), ("max", F.max))]
    ).collect()
    ranges = {r["node"]: r for r in found}
    low, high, dims, wanted = [], [], [], []
    for i, n in enumerate(active):
        r = ranges.get(i)
        widths = [0.0 if r is None else (r[f"max_{d}"] - r[f"min_{d}"]) / w for d, w in zip(DIMENSIONS, extent)]
        dims.append(max(range(len(DIMENSIONS)), key=lambda k: (widths[k], -k)))
        d = DIMENSIONS[dims[i]]
        low.append(0.0 if r is None else float(r[f"min_{d}"]))
        high.append(1.0 if r is None else float(r[f"max_{d}"]) * (1 + 1e-12) + 1e-9)
        wanted.append(0.0 if r is None else r["bytes"] * ((n.high - n.low) // 2) / (n.high - n.low))
    exact = [w * 1e-3 for w in wanted]
    coordinate = F.array(*[F.col(f"x_{d}") for d in DIMENSIONS])[_pick(dims)]
    cuts = high
    for _ in range(ROUNDS):
        at = rows.select("node", "size", coordinate.alias("x")).filter((F.col("x") >= _pick(low)) & (F.col("x") < _pick(high)))
        cell = F.least(F.lit(BINS - 1), F.floor((F.col("x") - _pick(low)) / (_pick(high) - _pick(low)) * BINS))
        upto = W.partitionBy("node").orderBy("cell").rowsBetween(W.unboundedPreceding, W.currentRow)
        sums = at.groupBy("node", cell.alias("cell")).agg(F.sum("size").alias("bytes")).withColumn("upto", F.sum("bytes").over(upto))
        # The first cell that reaches the wanted bytes: one row per node comes back.
        hit = sums.filter(F.col("upto") >= _pick(wanted)).groupBy("node").agg(F.min(F.struct("cell", "bytes", "upto")).alias("h")).collect()
        cuts, done = list(high), True
        for r in hit:
            i, h = r["node"], r["h"]
            step = (high[i] - low[i]) / BINS
            wanted[i] -= h["upto"] - h["bytes"]
            low[i], high[i] = low[i] + step * h["cell"], low[i] + step * (h["cell"] + 1)
            cuts[i] = high[i] if wanted[i] * 2 >= h["bytes"] else low[i]
            done = done and h["bytes"] <= max(exact[i], 1.0)
        if done:
            break
    for i, n in enumerate(active):
        n.dim, n.cut = dims[i], cuts[i]
        half = n.low + (n.high - n.low) // 2
        n.left, n.right = Node(n.low, half), Node(half, n.high)


def grow_tree(meta: DataFrame, shards: int) -> Node:
    root = Node(0, shards)
    row = meta.agg(*[(F.max(f"x_{d}") - F.min(f"x_{d}")).alias(d) for d in DIMENSIONS]).first()
    extent = [float(row[d] or 0.0) or 1.0 for d in DIMENSIONS]
    active = [root] if shards > 1 else []
    while active:
        _split_level(meta, root, active, extent)
        active = [c for n in active for c in (n.left, n.right) if c.high - c.low > 1]
    return root


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of `docs`.

    Reads doc_id, text and, where present, lang and source.  Give the number of
    shards or the bytes a leaf should reach.  Size is the text's UTF-8 bytes plus
    16; a null text has none, a null lang or source sorts first, a null id counts
    as 0.  Rows with equal id, text and metadata share all coordinates and stay
    together; equal texts of different documents may lie in different shards, as
    the tree cuts by metadata and the law is that of near equal bytes.  An empty table
    gives an empty table.
    """
    meta = written(metadata(docs), "shard-meta")
    row = meta.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first()
    if shards is None:
        shards = max(1, round(row["b"] / target_bytes))
    tree = grow_tree(meta, shards)
    placed = meta.select("doc_id", "size", "text_crc32", _walk(tree, lambda n: n.low).alias("shard"))
    parts = max(1, row["n"] // (shards * ROWS_PER_PART))
    return numbered(placed, ["shard"], [F.col("doc_id"), F.col("text_crc32")], [F.col("doc_id"), F.col("text_crc32")], parts, "slot")
