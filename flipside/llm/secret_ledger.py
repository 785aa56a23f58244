"""Secret scans with an incremental blob ledger.

Every version of every path is addressed by the SHA-256 of its content.  The
ledger is a table of (blob, rule_version, spans); a scan reads only blobs that
the ledger lacks under the current rules, appends what it found - also when
that is nothing - and joins the findings back to all paths of a blob.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flipside.llm.common import shared_path, shuffle_files_released

# Kinds in their order, pattern, least length, and the group the length is of.
# A match under the least length is dropped, and the search goes on behind it.
RULES = (
    ("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
    ("access", r"AKIA[A-Z0-9]+", 16, 0),
    ("hex", r"[0-9a-f]{32,}", 32, 0),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    ("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    ("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    ("signed_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
)
BASE_KINDS = ("assign", "access", "hex")
# Texts without any of these cannot match the rule; looking for them is much cheaper than the pattern.
NEEDED = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("AKIA",), "private_key": ("-----BEGIN",), "code_host": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "chat": ("xox",), "signed_token": ("eyJ",),
}

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def rule_version(rules=RULES) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def find_spans(text: str, rules=RULES) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then by the rules' order."""
    found, low = [], None
    for order, (kind, pattern, least, group) in enumerate(rules):
        need = NEEDED.get(kind)
        if need:
            if kind == "assign":
                low = low if low is not None else text.lower()
            if not any(n in (low if kind == "assign" else text) for n in need):
                continue
        for m in re.finditer(pattern, text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), order, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    version, seen = rule_version(), set()
    for batch in batches:
        blobs, spans = [], []
        for blob, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            if blob in seen:  # repeated rows of one path
                continue
            seen.add(blob)
            blobs.append(blob)
            spans.append([{"kind": k, "start": s, "end": e} for k, s, e in find_spans(text.as_py())])
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary()), pa.array([version] * len(blobs), pa.string()), pa.array(spans, kind)], names=["blob", "rule_version", "spans"])


def read_ledger(spark, path: str) -> DataFrame:
    """The ledger's rows as written; none when it was never written.  Two scans at once may both have added a blob."""
    schema = T.StructType([T.StructField("blob", T.BinaryType()), T.StructField("rule_version", T.StringType()), T.StructField("spans", SPANS)])
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def _known(spark, ledger: str) -> DataFrame:
    """One row per blob scanned under the present rules."""
    return read_ledger(spark, ledger).filter(F.col("rule_version") == rule_version()).dropDuplicates(["blob"])


def scan_secrets(docs: DataFrame, ledger: str | None = None, path: str = "doc_id") -> DataFrame:
    """path, blob, spans for every row of `docs`.

    Reads the path column and text; a null text is empty and has no spans, a
    null path is a path like any other, and a path may repeat with equal or
    different texts.  `ledger` is the table's folder, by
    default a new one in the shared folder.  Copies are scanned once, whatever
    their number; repeated rows get the same spans.  An empty table gives an
    empty table.
    """
    spark = docs.sparkSession
    ledger = ledger or shared_path(spark, "secret-ledger")
    text = F.coalesce(F.col("text"), F.lit(""))
    versions = docs.select(F.col(path).alias("__path"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("blob"))
    known = _known(spark, ledger)
    # One path carries each unseen blob to the scan; texts are dealt by path and blob, so copies do not meet.
    carriers = versions.groupBy("blob").agg(F.min("__path").alias("__carrier")).join(known.select("blob"), "blob", "left_anti")
    carriers = carriers.withColumnRenamed("blob", "__blob")
    unseen = versions.join(carriers.hint("shuffle_hash"), F.col("__path").eqNullSafe(F.col("__carrier")) & (F.col("blob") == F.col("__blob")))
    with shuffle_files_released(spark):
        # Repeated rows of the carrying path may be scanned by several tasks.
        scanned = unseen.select("blob", "text").mapInArrow(_scan, read_ledger(spark, ledger).schema).dropDuplicates(["blob"])
        scanned.write.mode("append").parquet(ledger)
    found = _known(spark, ledger).select("blob", "spans")
    return versions.select("__path", "blob").join(found, "blob").select(F.col("__path").alias(path), "blob", "spans")
