"""Targets and quotas against plain loops, and what the mix takes."""

from collections import Counter

from pyspark.sql import functions as F

from flipside.llm.mixing import ROWS_PER_PART, MixConfig, _on_line, _plan, _sized, mix_documents, mix_totals, shard_quotas
from tests.llm.helpers import docs, empty, rows_of


def plain_targets(sizes, weights=(5, 2, 1), repeat=3):
    """Share by weight, stop what is above its limit, share the rest again."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, free = {}, sum(sizes.values()), set(names)
    while free:
        per = left / sum(w[s] for s in free)
        over = [s for s in free if per * w[s] > repeat * sizes[s]]
        if not over:
            return target | {s: per * w[s] for s in free}
        for s in over:
            target[s] = float(repeat * sizes[s])
            left -= target[s]
            free.discard(s)
    return target


def corpus(spark, n=3000):
    source = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, "tiny").when(F.col("id") % 7 == 1, None).otherwise(F.concat(F.lit("s"), F.col("id") % 5))
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.col("id") * 37 % 83), lambda i: F.concat(F.lit("w"), F.col("id") * 100 + i)), " ")
    return spark.range(n).select(F.col("id").alias("doc_id"), text.alias("text"), source.alias("source"), F.lit("en").alias("lang"), F.length(text).cast("long").alias("n_chars"))


def by_source(df):
    return [r.asDict() for r in df.groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.count(F.lit(1)).alias("n")).collect()]


def test_targets_quotas_and_taken_words(spark):
    df = corpus(spark)
    sizes = {r[0]: r[1] for r in df.groupBy("source").agg(F.sum(F.size(F.split("text", " ")))).collect()}
    want = plain_targets(sizes)
    got = mix_totals(df)
    for r in by_source(got):
        source = next(s for s, n in sizes.items() if n == r["source_size"])
        assert abs(r["target"] - want[source]) < 1e-6 * want[source] + 1e-9
        assert abs(r["taken"] - r["target"]) <= 0.01 * r["target"] + 30
    assert got.filter("taken > 3 * size").count() == 0
    # Highest quotients, one award after the other.
    total = sum(sizes.values())
    block = -(-total // max(8192, 64 * len(sizes)))
    seats = Counter()
    names = sorted(sizes, key=lambda s: (s is None, s))
    for _ in range(-(-total // block)):
        seats[max(names, key=lambda s: (want[s] / (2 * seats[s] + 1), -names.index(s)))] += 1
    quotas = shard_quotas(df)
    blocks = {r["key"]: r["n"] for r in quotas.groupBy("key").agg(F.sum("blocks").alias("n")).collect()}
    for s in names:
        n = blocks.get("null" if s is None else f"s:{s}", 0)
        assert abs(n - seats[s]) <= 3  # a source's last block is shorter than the others
    per_shard = [r["n"] for r in quotas.groupBy("shard").agg(F.sum("blocks").alias("n")).collect()]
    assert len(per_shard) == 16 and max(per_shard) - min(per_shard) <= 0.1 * max(per_shard) + 8


def test_documents_hold_the_words_taken(spark):
    df = corpus(spark, 600)
    cfg = MixConfig(blocks=200)
    taken = {r["doc_id"]: r["taken"] for r in mix_totals(df, cfg).collect()}
    mixed = mix_documents(df, cfg)
    assert mixed.columns == [*df.columns, "mix_shard", "mix_epoch"]
    words = {r["doc_id"]: r["n"] for r in mixed.groupBy("doc_id").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()}
    assert {k: v for k, v in taken.items() if v} == words
    texts = {r["doc_id"]: r["text"].split(" ") for r in df.collect()}
    for r in mixed.collect():
        assert set(r["text"].split(" ")) <= set(texts[r["doc_id"]])
        assert r["n_chars"] == len(r["text"])


def test_small_sources_beside_a_huge_one(spark):
    i = F.col("doc_id")
    name = F.when(i == 7, "tiny").when(i == 8, None).when(i == 9, "word").when(i < 40, F.concat(F.lit("s"), i % 4)).otherwise("huge")
    df = corpus(spark).withColumns({"source": name, "text": F.when(i == 9, "one").otherwise(F.col("text"))})
    cfg = MixConfig(blocks=16)  # of about 250 words each; "tiny" has 11
    got = by_source(mix_totals(df, cfg))
    assert len(got) == 8 and min(r["source_size"] for r in got) == 1
    for r in got:
        assert abs(r["taken"] - r["target"]) <= max(0.03 * r["target"], 1)
    kept = {r["source"] for r in mix_documents(df, cfg).select("source").distinct().collect()}
    assert kept == {"tiny", None, "word", "huge", "s0", "s1", "s2", "s3"}
    src, plan, _ = _plan(_sized(df), cfg)
    words = [r["n"] for r in plan.join(src, "key").groupBy("shard").agg(F.sum("length").alias("n")).collect()]
    assert len(words) == 16 and max(words) - min(words) <= 0.1 * max(words) + 500


def test_reruns_and_partitions_agree(spark):
    df = corpus(spark, 500)
    assert rows_of(mix_totals(df.repartition(7))) == rows_of(mix_totals(df.coalesce(1)))


def test_odd_rows(spark):
    got = rows_of(mix_totals(docs(spark)))
    assert got == rows_of(mix_totals(docs(spark, clash=True)))
    assert len(got) == 13
    assert mix_documents(docs(spark, clash=True)).filter("text is null").count() == 0
    nothing = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r["size"], r["taken"], r["target"]) for r in mix_totals(nothing).collect()] == [(0, 0, 0.0)] * 2
    assert mix_totals(empty(spark)).count() == 0
    assert mix_documents(empty(spark)).count() == 0


def test_missing_ids_are_dealt_by_text(spark):
    df = corpus(spark, 1200).withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")))
    line = _on_line(_sized(df), 80 * ROWS_PER_PART, MixConfig())
    per = {r["__part"]: r["n"] for r in line.filter("doc_id is null").groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert len(per) > 60 and max(per.values()) < 30  # 600 rows over 80 parts
    cfg = MixConfig(blocks=300)
    assert rows_of(mix_documents(df.repartition(7), cfg)) == rows_of(mix_documents(df.coalesce(1), cfg))
    assert rows_of(mix_totals(df.repartition(5), cfg)) == rows_of(mix_totals(df.coalesce(1), cfg))
