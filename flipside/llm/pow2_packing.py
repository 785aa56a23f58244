"""Packing by power-of-two decomposition.

Every document is cut into pieces whose lengths are powers of two, the longest
first and none above the limit.  Pieces of one length form a bucket, and each
piece is a sequence of its own, so batches of one bucket hold equal lengths, no
sequence crosses documents and nothing is padded.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flipside.llm.common import written

LIMIT = 2048
END_ID = 1
CACHE_WORDS = 700_000
FLUSH_BYTES = 8 << 20

# Marks between a Latin letter or digit and white space are one piece of their own; splitting them off keeps words few.
_MARK = re.compile(r"(?<=[0-9A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF])([!-/:-@\[-`{-~]+)(?=[ \n])")


def _simple(text: str) -> bool:
    """Latin-1 without the start of a special token: lower-casing maps letter to letter, and normal form C changes nothing."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return "<|" not in text


class WordIds(dict):
    """Ids of blank-separated words as little-endian uint32 bytes.

    The tokenizer drops white space and never joins characters across it, so a
    text's ids are those of its words one after the other.  The first `most`
    words stay in memory, the frequent ones among them; later ones are encoded
    for their text alone.
    """

    def __init__(self, tokenizer, most: int = CACHE_WORDS):
        self.tokenizer, self.most, self.unknown = tokenizer, most, []
        ends = np.zeros(tokenizer.get_vocab_size(), bool)
        for token, number in tokenizer.get_vocab().items():
            ends[number] = token.endswith("</w>")
        self.ends = ends

    def __missing__(self, word: str) -> None:
        self.unknown.append(word)

    def _encode(self, words: list[str]) -> None:
        """Words of letters alone are one piece each, so one call encodes them all: a piece ends where a token says so."""
        plain = [w for w in words if w.isalpha()]
        other = [w for w in words if not w.isalpha()]
        ids = np.asarray(self.tokenizer.encode_batch_fast([" ".join(plain)], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) == len(plain):
            raw, cuts = ids.tobytes(), (4 * cuts).tolist()
            self.update(zip(plain, map(raw.__getitem__, map(slice, [0, *cuts[:-1]], cuts))))
        else:
            other = words
        for word, found in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False)):
            self[word] = np.asarray(found.ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        if _simple(text):
            text = _MARK.sub(r" \1", text.lower())
        words = text.replace("\n", " ").split(" ")
        found = list(map(self.__getitem__, words))
        if self.unknown:
            missed, self.unknown = self.unknown, []
            new = list(dict.fromkeys(missed))
            self._encode(new)
            at = -1
            for word in missed:  # in the order of their places
                at = found.index(None, at + 1)
                found[at] = self[word]
            if len(self) > self.most:
                for word in new:
                    del self[word]
        return b"".join(found)


@lru_cache(maxsize=1)
def word_ids(tokenizer_file: str) -> WordIds:
    """One cache per worker process; Spark's tasks are the parallelism, so the tokenizer starts no threads."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return WordIds(Tokenizer.from_file(tokenizer_file))


def binary_lengths(total: int, limit: int = LIMIT) -> list[int]:
    """Powers of two that add up to `total`, longest first, none above `limit`."""
    rest = total % limit
    return [limit] * (total // limit) + [1 << b for b in range(limit.bit_length() - 2, -1, -1) if rest >> b & 1]


def _cut(batches: Iterator[pa.RecordBatch], tokenizer_file: str, limit: int) -> Iterator[pa.RecordBatch]:
    words, part = word_ids(tokenizer_file), TaskContext.get().partitionId()
    end = np.asarray([END_ID], "<u4").tobytes()
    turns: dict[int, int] = {}
    rows: list[tuple] = []
    held = 0

    def batch() -> pa.RecordBatch:
        cols = list(zip(*rows))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64())
        names = ["doc_id", "start", "length", "doc_tokens", "ids", "part", "turn"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    for got in batches:
        for doc_id, text in zip(got.column(0).to_pylist(), got.column(1)):
            ids = words.ids(text.as_py() or "") + end
            total, start = len(ids) // 4, 0
            for length in binary_lengths(total, limit):
                turn = turns.get(length, 0)
                turns[length] = turn + 1
                rows.append((doc_id, start, length, total, ids[4 * start : 4 * (start + length)], part, turn))
                start += length
            held += len(ids)
            if held > FLUSH_BYTES:
                yield batch()
                rows, held = [], 0
    if rows:
        yield batch()


def pack_pow2(docs: DataFrame, tokenizer_file: str, limit: int = LIMIT) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, ids (little-endian uint32), sequence_id, offset.

    Reads doc_id and text; a null or empty text is the end id alone.  Repeated
    rows are packed as separate documents.  Sequence ids are gapless from 0,
    shorter lengths first; an empty table gives an empty table.  Pieces are
    numbered inside the task that cuts them, and the written counts of tasks and
    lengths give the first numbers, so ids are never shuffled.
    """
    kind = "doc_id long, start long, length long, doc_tokens long, ids binary, part int, turn long"
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = written(narrow.mapInArrow(partial(_cut, tokenizer_file=tokenizer_file, limit=limit), kind), "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy("length").agg(F.sum("n").alias("n"))
    shorter = sizes.select("length", F.coalesce(F.sum("n").over(W.orderBy("length").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("bucket"))
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    first = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(shorter, "length")
    first = written(first.select("length", "part", (F.col("bucket") + F.col("before")).alias("first")), "piece-counts")
    return pieces.join(first, ["length", "part"]).select(
        "doc_id", "start", "length", "doc_tokens", "ids", (F.col("first") + F.col("turn")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
