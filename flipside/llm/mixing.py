"""Mixing sources to target weights: Sainte-Lague apportionment, DataFrame operations only.

Each source gets a target number of words from its weight.  The mix is made of
blocks of equal word count; a departure from that are sources whose target is
less than `per_source` blocks, which get shorter ones, equal within the source.  Sainte-Lague deals the blocks to the sources by highest
quotient (target / block length) / (2k+1) until the mix is full, and the order
of the awards spreads them over the output shards, which gives an integer quota
per shard and source.  A source's documents are laid in seeded random order on a line of words, the line
is cut into blocks, and seeded draws choose as many blocks as were awarded.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flipside.llm.common import written

WORD = r"[^\x20\x09-\x0D]+"
ROWS_PER_PART = 4096


@dataclass(frozen=True)
class MixConfig:
    weights: Sequence[float] = (5.0, 2.0, 1.0)  # by sources in code point order, null last, repeating
    repeat: int = 3  # no source and no document is taken more often
    blocks: int = 8192  # blocks of the whole mix; at least 64 a source
    per_source: int = 128  # blocks that each source's target is cut into at least, while they hold a word
    shards: int = 16
    seed: int = 8


def source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s:"), source), F.lit("null"))


def source_targets(sizes: DataFrame, cfg: MixConfig) -> DataFrame:
    """Adds `target` to one row per source (source, source_size).

    Targets share the sum of all sizes by weight; one above `repeat` times its
    source's size stops there and the excess is shared again.  That is a water
    level: with the sources in order of size over weight, the level is the
    largest of (words left) / (weights left) over all numbers of stopped sources.
    The windows here run over one row per source.
    """
    everything = W.partitionBy()
    place = F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1
    weights = F.array(*[F.lit(float(w)) for w in cfg.weights])
    df = sizes.withColumn("place", place).withColumn("weight", weights[F.col("place") % len(cfg.weights)])
    df = df.withColumn("stop", (F.col("source_size") * cfg.repeat).cast("double"))
    earlier = W.orderBy(F.col("stop") / F.col("weight"), "place").rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("stop").over(earlier), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))
    df = df.withColumn("__level", left / weight_left).withColumn("__level", F.max("__level").over(everything))
    return df.withColumn("target", F.least(F.col("stop"), F.col("__level") * F.col("weight"))).drop("__level", "stop")


def awards(targets: DataFrame, block: int, sources: int, total: int) -> DataFrame:
    """One row per awarded block: key, k (the source's k-th award), begin (words awarded before it).

    Quotients count in blocks of the source's own `length`, at most `block`.
    Awards go on while fewer than `total` words are dealt; rounding moves that
    point by half a block a source and one more, so that many quotients of each
    source are enough.
    """
    share = F.col("target") / F.col("length")
    most = F.ceil(share * (1 + (sources + 2) * block / (2 * max(total, 1)))) + 1
    quotients = targets.filter("target > 0").select(
        "key", "place", "length", share.alias("share"), F.explode(F.sequence(F.lit(0).cast("long"), most.cast("long"))).alias("k")
    )
    best = W.orderBy((F.col("share") / (2 * F.col("k") + 1)).desc(), "place", "k").rowsBetween(W.unboundedPreceding, -1)
    return quotients.withColumn("begin", F.coalesce(F.sum("length").over(best), F.lit(0))).filter(F.col("begin") < total).select("key", "k", "begin")


def _sized(docs: DataFrame) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    text_hash = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    return docs.withColumns({"__size": size, "__key": source_key(F.col("source")), "__text": text_hash})


def _plan(sized: DataFrame, cfg: MixConfig) -> tuple[DataFrame, DataFrame, int]:
    """Source table (key, source_size, target, length of a block), block plan (key, block, epoch, shard), rows."""
    sizes = written(
        sized.groupBy("__key").agg(F.first("source").alias("source"), F.sum("__size").alias("source_size"), F.count(F.lit(1)).alias("rows")),
        "mix-sizes",
    )
    row = sizes.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("t"), F.count(F.lit(1)).alias("s"), F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first()
    total, sources = int(row["t"]), int(row["s"])
    block = max(1, -(-total // max(cfg.blocks, 64 * sources)))
    own = F.greatest(F.lit(1), F.floor(F.col("target") / cfg.per_source))
    targets = source_targets(sizes.withColumnRenamed("__key", "key"), cfg).withColumn("length", F.least(F.lit(block), own).cast("long"))
    won = awards(targets, block, sources, total)
    counts = won.groupBy("key").agg(F.count(F.lit(1)).alias("seats"))
    src = targets.join(counts, "key", "left").withColumn("seats", F.coalesce("seats", F.lit(0)))
    size, length = F.col("source_size"), F.col("length")
    words = F.least(F.col("seats") * length, size * cfg.repeat)
    src = src.withColumn("full", F.when(size > 0, F.floor(words / size)).otherwise(0).cast("long"))
    src = src.withColumn("more", F.round((words - F.col("full") * size) / length).cast("long"))
    whole = F.floor(size / length)
    src = src.withColumn("over", F.col("more") > whole)
    src = src.withColumns({"full": F.col("full") + F.col("over").cast("long"), "more": F.when(F.col("over"), 0).otherwise(F.col("more")), "whole": whole, "n_blocks": F.ceil(size / length)})
    src = written(src.select("key", "source_size", "target", "length", "full", "more", "whole", "n_blocks", "seats"), "mix-sources")
    # Blocks in seeded order, once per epoch; the last epoch takes the first `more` of the full-length ones.
    cells = src.filter("n_blocks > 0 and seats > 0").select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") * (F.col("full") + 1) - 1)).alias("cell")
    )
    cells = cells.withColumns({"epoch": F.floor(F.col("cell") / F.col("n_blocks")), "block": F.col("cell") % F.col("n_blocks")})
    draw = F.xxhash64(F.lit(cfg.seed), "key", "epoch", "block")
    order = W.partitionBy("key", "epoch").orderBy((F.col("block") >= F.col("whole")).cast("int"), draw, "block")
    cells = cells.withColumn("turn", F.row_number().over(order) - 1).filter((F.col("epoch") < F.col("full")) | (F.col("turn") < F.col("more")))
    cells = cells.withColumn("k", F.least(F.col("epoch") * F.col("n_blocks") + F.col("turn"), F.col("seats") - 1))
    plan = cells.join(won, ["key", "k"]).select("key", "block", "epoch", F.floor(F.col("begin") * cfg.shards / max(total, 1)).cast("int").alias("shard"))
    return src.select("key", "source_size", "target", "length"), written(plan, "mix-plan"), int(row["n"])


def shard_quotas(docs: DataFrame, cfg: MixConfig = MixConfig()) -> DataFrame:
    """Blocks each source gives to each shard: key, shard, blocks."""
    _, plan, _ = _plan(_sized(docs), cfg)
    return plan.groupBy("key", "shard").agg(F.count(F.lit(1)).alias("blocks"))


def _on_line(sized: DataFrame, rows: int, cfg: MixConfig) -> DataFrame:
    """Adds `__pos`, the row's first word on its source's line, in seeded order.

    The line of a source is laid out in hash parts of a few thousand rows, so a
    hot source never meets in one task, nor do rows that share an id or have none.
    """
    placed = sized.withColumn("__draw", F.xxhash64(F.lit(cfg.seed), "doc_id", "__text"))
    placed = placed.withColumn("__part", F.pmod("__draw", F.lit(max(1, rows // ROWS_PER_PART))))
    sums = placed.groupBy("__key", "__part").agg(F.sum("__size").alias("__words"))
    before = W.partitionBy("__key").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    first = sums.select("__key", "__part", F.coalesce(F.sum("__words").over(before), F.lit(0)).alias("__first"))
    inside = W.partitionBy("__key", "__part").orderBy("__draw", "doc_id", "__text", "__size").rowsBetween(W.unboundedPreceding, -1)
    placed = placed.withColumn("__inside", F.coalesce(F.sum("__size").over(inside), F.lit(0)))
    return placed.join(first, ["__key", "__part"]).withColumn("__pos", F.col("__first") + F.col("__inside"))


def _pieces(line: DataFrame, src: DataFrame) -> DataFrame:
    """One row per (document, block it reaches into); documents without words none."""
    block = F.col("__length")
    line = line.join(src.select(F.col("key").alias("__key"), F.col("length").alias("__length")), "__key")
    last = F.floor((F.col("__pos") + F.col("__size") - 1) / block)
    out = line.filter("__size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("__pos") / block), last)))
    start = F.greatest(F.col("__pos"), F.col("block") * block)
    end = F.least(F.col("__pos") + F.col("__size"), (F.col("block") + 1) * block)
    return out.withColumns({"__from": start - F.col("__pos"), "__words": end - start})


def mix_totals(docs: DataFrame, cfg: MixConfig = MixConfig()) -> DataFrame:
    """doc_id, size, source_size, target, taken: words of every row that the mix takes.

    Reads doc_id, source and text.  Size counts words; a null text has none.
    Null is a source of its own, the last one.  Repeated rows are separate rows;
    rows that share an id (or have none) are told apart by their texts.  All-empty tables take nothing; an empty table gives an empty table.
    """
    sized = _sized(docs.select("doc_id", "source", "text")).drop("text")
    src, plan, rows = _plan(sized, cfg)
    line = written(_on_line(sized.drop("source"), rows, cfg).select("doc_id", "__key", "__size", "__pos"), "mix-line")
    times = plan.groupBy(F.col("key").alias("__key"), "block").agg(F.count(F.lit(1)).alias("times"))
    taken = _pieces(line, src).join(times, ["__key", "block"], "left").select(
        "doc_id", "__key", "__size", "__pos", (F.col("__words") * F.coalesce("times", F.lit(0))).alias("__taken")
    )
    none = line.filter("__size = 0").select("doc_id", "__key", "__size", "__pos", F.lit(0).cast("long").alias("__taken"))
    per = taken.groupBy("doc_id", "__key", "__size", "__pos").agg(F.sum("__taken").alias("__taken")).unionByName(none)
    return per.join(src.drop("length").withColumnRenamed("key", "__key"), "__key").select(
        F.col("doc_id"), F.col("__size").alias("size"), "source_size", "target", F.col("__taken").alias("taken")
    )


def mix_documents(docs: DataFrame, cfg: MixConfig = MixConfig()) -> DataFrame:
    """The mix itself: the columns of `docs`, and `mix_shard`, `mix_epoch`.

    One row per document and epoch that takes any of its words.  A document
    taken whole keeps its text; otherwise its chosen words, joined by spaces,
    replace the text (and n_chars, where that column exists).  Documents
    without words go, as no block holds them.
    """
    docs = docs.drop("mix_shard", "mix_epoch")
    sized = _sized(docs)
    src, plan, rows = _plan(sized.select("__key", "source", "__size"), cfg)
    line = written(_on_line(sized, rows, cfg).drop("__draw", "__text", "__part", "__inside", "__first"), "mix-texts")
    pieces = _pieces(line.select("__key", "__pos", "__size"), src)
    chosen = pieces.join(plan.withColumnRenamed("key", "__key"), ["__key", "block"]).groupBy("__key", "__pos", F.col("epoch").alias("__epoch")).agg(
        F.sort_array(F.collect_list(F.struct("__from", "__words"))).alias("__cuts"), F.min("shard").alias("__shard"), F.sum("__words").alias("__got")
    )
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    cut = F.array_join(F.flatten(F.transform("__cuts", lambda c: F.slice(words, c["__from"].cast("int") + 1, c["__words"].cast("int")))), " ")
    out = line.filter("__size > 0").join(chosen, ["__key", "__pos"])
    partial = F.col("__got") < F.col("__size")
    out = out.withColumn("text", F.when(partial, cut).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(partial, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns, F.col("__shard").alias("mix_shard"), F.col("__epoch").cast("int").alias("mix_epoch"))
