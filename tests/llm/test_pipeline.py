"""The pipeline's stages on the rows each gets, against plain versions."""

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from flipside.llm.common import written
from flipside.llm.kernel_quality import score_quality
from flipside.llm.mixing import mix_totals
from flipside.llm.queries import word_tokenizer
from tests.llm.helpers import rows_of
from tests.llm.test_chosen_path import plain as plain_classes
from tests.llm.test_exact_dedup import plain as plain_copies

SF = "/root/testdata/sf0.001"


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in P.STAGES] == ["quality", "exact_copies", "near_copies", "mix", "pack"]
    stage = dict(P.STAGES)

    good = written(stage["quality"](spark, docs, SF), "t")
    scores = score_quality(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids(good) == ids(scores.filter("predicted = 1")) and good.columns == columns

    single = written(stage["exact_copies"](spark, good, SF), "t")
    rows = [(r["doc_id"], r["text"]) for r in good.collect()]
    assert ids(single) == sorted(r[0] for r in plain_copies(rows) if r[3]) and single.columns == columns

    apart = written(stage["near_copies"](spark, single, SF), "t")
    rows = [(r["doc_id"], r["text"]) for r in single.collect()]
    assert ids(apart) == sorted({c for _, c, *_ in plain_classes(rows)}) and apart.columns == columns

    mixed = written(stage["mix"](spark, apart, SF), "t")
    words = {r["doc_id"]: r["n"] for r in mixed.groupBy("doc_id").agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).alias("n")).collect()}
    assert words == {r["doc_id"]: r["taken"] for r in mix_totals(apart).collect() if r["taken"]} and mixed.columns == columns

    packed = stage["pack"](spark, mixed, SF).collect()
    tok = Tokenizer.from_file(word_tokenizer())
    want = sorted(tuple([*tok.encode(r["text"], add_special_tokens=False).ids, 1]) for r in mixed.collect())
    assert sum(r["length"] for r in packed) == sum(map(len, want))
    first = sorted(tuple(np.frombuffer(r["ids"], "<u4")) for r in packed if r["start"] == 0)
    assert first == sorted(t[: len(f)] for t in want for f in [binary_head(t)])


def binary_head(ids_):
    from flipside.llm.pow2_packing import binary_lengths

    return ids_[: binary_lengths(len(ids_))[0]]


def test_run_is_the_chain_of_the_stages(spark):
    a, b = P.run(spark, SF), P.run(spark, SF)
    cols = ["doc_id", "start", "length", "ids", "doc_tokens"]
    assert rows_of(a.select(cols)) == rows_of(b.select(cols))
    assert a.filter("offset <> 0").count() == 0


def test_empty_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0
