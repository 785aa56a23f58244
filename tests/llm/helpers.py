"""Tables with everything that can be odd about them."""

from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# Names that operators use inside; as columns of the input they must do no harm.
CLASH = ["size", "block", "epoch", "key", "part", "node", "sid", "score", "row", "batch", "digest", "norm", "shard", "slot", "stats", "blob", "taken", "mix_shard", "host", "tokens", "query", "cid", "__size", "__key"]

LONG = " ".join(f"word{i % 997} of" for i in range(60_000))

ODD = [
    (1, "The Quick brown fox jumps over the lazy dog", "en", "b", 43),
    (1, "The Quick brown fox jumps over the lazy dog", "en", "b", 43),
    (2, "the quick BROWN fox jumps over the lazy dog", "en", "a", 43),
    (3, None, "en", "a", None),
    (4, "", None, None, 0),
    (None, "a text without an id", "fr", None, 20),
    (None, "a text without an id", "fr", None, 20),
    (6, " \n\t ", "de", "c", 4),
    (7, "É accented É words ÀÉ", "fr", "c", 21),
    (8, "é accented é words àé", "fr", "c", 21),
    (9, LONG, "en", "b", len(LONG)),
    (10, "one", "en", "a", 3),
    (7, "another text under a used id", "fr", "c", 28),
]


def docs(spark, rows=ODD, clash=False):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, DOCS).repartition(3)
    return df.withColumns({c: F.lit("x") for c in CLASH}) if clash else df


def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df):
    cols = sorted(df.columns)
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
