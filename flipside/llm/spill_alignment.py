"""Cross-tokenizer alignment with external spill counting.

Two tokenizers cut the same bytes.  Where both end a token, a group ends; inside
a group every pair of tokens that share a byte is a link.  How often an id pair
is linked in the whole corpus needs one count per pair, and every document
wants the counts of its own pairs back, so:

* a task aligns documents until it holds `run_links` links, sorts the records
  (pair, document, how often) and cuts them by radix of the B id into one
  zstd-compressed run per radix, a row of the run table;
* a k-way heap merge adds up the runs' pair counts, `fan_in` runs at a time,
  level by level, until a radix has one sorted list of totals.  The order is by
  B id first, so a B id's pairs pass together and its highest count is known
  when they have passed;
* the totals stream past the runs of their radix once more, and each run hands
  every one of its documents the sum of its pairs' counts.

A pair that fills a third of the table is one total per run; documents meet
only in the batch that aligned them.  The number of radixes is fixed, so the
run table grows in proportion to the text.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import zstandard

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flipside.llm.common import written

SPACE = "▁"
FIELD = 40  # bits of a packed count of one text's tokens


@dataclass(frozen=True)
class AlignConfig:
    radixes: int = 16  # a power of two
    run_links: int = 2_000_000  # links a task holds before it writes a run
    frame: int = 16_384  # pairs of a compressed frame
    fan_in: int = 64  # runs merged at once
    text_bytes: int = 4 << 20  # text aligned at once
    cache_words: int = 250_000


# --- compressed columns ---


def _pack(*columns: np.ndarray) -> bytes:
    """Integer columns as one zstd frame; the bytes of equal weight lie together."""
    raw = [np.array([len(c) for c in columns], "<u8").tobytes()]
    raw += [np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.dtype.itemsize).T.tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(raw))


def _unpack(frame: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(frame)
    at, out = 8 * len(kinds), []
    for n, kind in zip(np.frombuffer(raw, "<u8", len(kinds)).tolist(), kinds):
        width = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
        at += n * width
    return out


# --- tokens and links ---


def _byte_letters() -> dict[str, int]:
    """Byte-level vocabularies spell each byte as a printable letter: itself, or the next free code point from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    odd = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(odd)}


class Aligner:
    """Both tokenizers, their tokens' bytes, and the alignments of frequent words.

    A text whose blanks all stand alone between visible characters is cut at its
    blanks: neither tokenizer joins characters across such a place, so its
    alignment is that of its words one after the other.  Other texts are
    encoded whole.
    """

    def __init__(self, a_file: str, b_file: str, cfg: AlignConfig):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.cfg = cfg
        self.a, self.b = Tokenizer.from_file(a_file), sentencepiece.SentencePieceProcessor(model_file=b_file)
        self.a.encode_special_tokens = True
        letters = _byte_letters()
        n_a, n_b = self.a.get_vocab_size(), self.b.get_piece_size()
        self.a_bytes = [b""] * n_a
        for token, number in self.a.get_vocab().items():
            self.a_bytes[number] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.b_bytes = []
        for number in range(n_b):
            piece = self.b.id_to_piece(number)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(number) else piece.replace(SPACE, " ").encode())
        self.a_size = np.array([len(t) for t in self.a_bytes], np.int64)
        self.b_size = np.array([len(t) for t in self.b_bytes], np.int64)
        self.a_bits, b_bits = max(1, (n_a - 1).bit_length()), max(1, (n_b - 1).bit_length())
        radix_bits = cfg.radixes.bit_length() - 1
        if self.a_bits + max(b_bits, radix_bits) > 32:
            raise ValueError("an id pair must fit in 32 bits")
        # The radix (the lowest bits of the B id) comes first, then the rest of the B id, then the A id.
        ids = np.arange(n_b, dtype=np.uint32)
        self.b_key = (((ids & (cfg.radixes - 1)) << max(0, b_bits - radix_bits)) | (ids >> radix_bits)) << np.uint32(self.a_bits)
        self.radix_shift = self.a_bits + max(0, b_bits - radix_bits)
        self.a_text = [np.array([f"{i}{end}" for i in range(n_a)], object) for end in ",|"]
        self.b_text = [np.array([f"{i}{end}" for i in range(n_b)], object) for end in ",;"]
        self.words: dict[str, tuple[bytes, int, str]] = {}

    def links(self, texts: list[str]) -> list[tuple[bytes, int, str] | None]:
        """Per text: its links' pair keys, its packed counts and its groups; None where bytes are not the text's."""
        a = [e.ids for e in self.a.encode_batch([f" {t}" for t in texts], add_special_tokens=False)]
        b = self.b.encode(texts, num_threads=1)
        good = []
        for t, x, y in zip(texts, a, b):
            raw = f" {t}".encode()
            good.append(b"".join(map(self.a_bytes.__getitem__, x)) == raw and b"".join(map(self.b_bytes.__getitem__, y)) == raw)
        a, b = [x for x, ok in zip(a, good) if ok], [y for y, ok in zip(b, good) if ok]
        out: list = [None] * len(texts)
        if not a:
            return out
        n_a, n_b = np.array([len(x) for x in a]), np.array([len(y) for y in b])
        ids_a, ids_b = np.concatenate([np.array(x, np.int64) for x in a]), np.concatenate([np.array(y, np.int64) for y in b])
        # Ends count on through all texts: every text's last byte ends a token on both sides.
        end_a, end_b = np.cumsum(self.a_size[ids_a]), np.cumsum(self.b_size[ids_b])
        ends = np.union1d(end_a, end_b)
        key = self.b_key[ids_b[np.searchsorted(end_b, ends)]] | ids_a[np.searchsorted(end_a, ends)].astype(np.uint32)
        last_a, last_b = np.isin(end_a, end_b, assume_unique=True), np.isin(end_b, end_a, assume_unique=True)
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        # A token stands after the B tokens of earlier groups, a B token after the A tokens of its group and before.
        said = np.empty(len(ids_a) + len(ids_b), object)
        at_a = np.arange(len(ids_a)) + np.searchsorted(group_b, group_a)
        at_b = np.arange(len(ids_b)) + np.searchsorted(group_a, group_b, side="right")
        said[at_a] = np.where(last_a, self.a_text[1][ids_a], self.a_text[0][ids_a])
        said[at_b] = np.where(last_b, self.b_text[1][ids_b], self.b_text[0][ids_b])
        to_a, to_b = np.cumsum(n_a), np.cumsum(n_b)
        to_link = np.searchsorted(ends, end_a[to_a - 1], side="right")
        to_group = np.cumsum(last_a)[to_a - 1]
        raw, words = key.astype("<u4").tobytes(), said.tolist()
        bounds = [np.concatenate([[0], x]).tolist() for x in (to_a, to_b, to_link, to_group)]
        found = iter(range(len(a)))
        for i, ok in enumerate(good):
            if ok:
                k = next(found)
                (a0, a1), (b0, b1), (l0, l1), (g0, g1) = ((x[k], x[k + 1]) for x in bounds)
                counts = (a1 - a0) | (b1 - b0) << FIELD | (g1 - g0) << 2 * FIELD
                out[i] = (raw[4 * l0 : 4 * l1], counts, "".join(words[a0 + b0 : a1 + b1])[:-1])
        return out

    def documents(self, texts: list[str]) -> Iterator[tuple[bytes, int, str]]:
        """Pair keys, packed counts and groups of each text; nothing for texts without tokens."""
        cut = [t.split(" ") if t and not _TOGETHER.search(t) else None for t in texts]
        new = list(dict.fromkeys(w for words in cut if words for w in words if w not in self.words))
        known = self.words
        if new:
            fresh = dict(zip(new, self.links(new)))
            if len(known) + len(fresh) <= self.cfg.cache_words:
                known.update(fresh)
            else:
                known = _Both(fresh, known)
        whole = [t for t, words in zip(texts, cut) if t and not words]
        aligned = iter(self.links(whole) if whole else ())
        for t, words in zip(texts, cut):
            if not t:
                yield b"", 0, ""
            elif words:
                parts = list(map(known.__getitem__, words))
                if None in parts:
                    yield b"", 0, ""
                else:
                    keys, counts, groups = zip(*parts)
                    yield b"".join(keys), sum(counts), ";".join(groups)
            else:
                yield next(aligned) or (b"", 0, "")


class _Both(dict):
    """Words of one call, then those that stay."""

    def __init__(self, first: dict, then: dict):
        super().__init__(first)
        self.then = then

    def __missing__(self, word: str):
        return self.then[word]


# Blanks side by side, at an end, or between other white space.
_TOGETHER = re.compile(r"\s \s|  |\A | \Z")


@lru_cache(maxsize=1)
def aligner(a_file: str, b_file: str, cfg: AlignConfig) -> Aligner:
    """One for each worker process."""
    return Aligner(a_file, b_file, cfg)


def _texts(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[tuple[int | None, str]]]:
    """(id, text) lists of about `most` bytes."""
    held, size = [], 0
    for b in batches:
        for i, text in zip(b.column(0).to_pylist(), b.column(1)):
            held.append((i, text.as_py() or ""))
            size += len(held[-1][1])
            if size >= most:
                yield held
                held, size = [], 0
    if held:
        yield held


# --- runs ---

_RUN = "batch long, radix int, pairs array<binary>, docs binary"
_RUN_TYPES = [("batch", pa.int64()), ("radix", pa.int32()), ("pairs", pa.list_(pa.binary())), ("docs", pa.binary())]


def _record(rows: list[tuple], types: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(zip(*rows), types)], names=[n for n, _ in types])


def _frames(keys: np.ndarray, counts: np.ndarray, frame: int) -> list[bytes]:
    """Sorted pairs and their counts as frames; a key is the step from the one before in its frame."""
    out = []
    for at in range(0, len(keys), frame):
        k = keys[at : at + frame]
        out.append(_pack(np.diff(k, prepend=k.dtype.type(0)).astype("<u4"), counts[at : at + frame].astype("<u8")))
    return out


def _read_frame(frame: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, counts = _unpack(frame, "<u4", "<u8")
    return np.cumsum(steps, dtype=np.uint32), counts


def _facts(held: list[tuple]) -> bytes:
    """The documents of a batch: ids, counts of A, B, groups and links, digests."""
    ids = np.array([i if i is not None else 0 for i, *_ in held], "<i8")
    null = np.array([i is None for i, *_ in held], "u1")
    mask = (1 << FIELD) - 1
    counts = [np.array([c >> shift & mask for _, _, c, _ in held], "<u8") for shift in (0, FIELD, 2 * FIELD)]
    links = np.array([len(k) // 4 for _, k, _, _ in held], "<u8")
    digest = np.frombuffer(b"".join(d for *_, d in held), "u1")
    return _pack(ids, null, *counts, links, digest)


def _runs(batches: Iterator[pa.RecordBatch], a_file: str, b_file: str, cfg: AlignConfig) -> Iterator[pa.RecordBatch]:
    tool, part, turn = aligner(a_file, b_file, cfg), TaskContext.get().partitionId(), 0
    held: list[tuple] = []
    links = 0

    def flush() -> pa.RecordBatch:
        batch = part << 32 | turn
        rows: list[tuple] = [(batch, -1, [], _facts(held))]
        key = np.frombuffer(b"".join(k for _, k, _, _ in held), "<u4").astype(np.uint64)
        doc = np.repeat(np.arange(len(held), dtype=np.uint64), [len(k) // 4 for _, k, _, _ in held])
        record = np.sort(key << np.uint64(32) | doc)
        first = np.flatnonzero(np.diff(record, prepend=~record[:1]) != 0)
        often = np.diff(first, append=len(record)).astype("<u4")
        pair, doc = (record[first] >> np.uint64(32)).astype(np.uint32), record[first].astype(np.uint32)
        cuts = np.searchsorted(pair >> np.uint32(tool.radix_shift), np.arange(cfg.radixes + 1))
        for radix, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])):
            if lo < hi:
                p, d, m = pair[lo:hi], doc[lo:hi], often[lo:hi]
                start = np.flatnonzero(np.diff(p, prepend=~p[:1]) != 0)
                frames = _frames(p[start], np.add.reduceat(m.astype("<u8"), start), cfg.frame)
                many = np.diff(start, append=len(p)).astype("<u4")
                rows.append((batch, radix, frames, _pack(many, np.diff(d, prepend=np.uint32(0)).astype("<u4"), m)))
        return _record(rows, _RUN_TYPES)

    for texts in _texts(batches, cfg.text_bytes):
        for (i, _), (keys, counts, groups) in zip(texts, tool.documents([t for _, t in texts])):
            held.append((i, keys, counts, hashlib.sha256(groups.encode()).hexdigest().encode() if counts else b" " * 64))
            links += len(keys) // 4
            if links >= cfg.run_links:
                yield flush()
                held, links, turn = [], 0, turn + 1
    if held:
        yield flush()


# --- merging ---


def merged(runs: list[list[bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """k-way merge of sorted runs, equal pairs added up; one frame of each run is open at a time.

    The heap holds the last key of every open frame.  Up to the smallest of
    them nothing can be missing, so all open frames are merged to there and the
    run whose frame is used up opens its next.
    """
    rest = [iter(r) for r in runs]
    heap, opened = [], {}

    def advance(i: int) -> None:
        frame = next(rest[i], None)
        if frame is None:
            opened.pop(i, None)
        else:
            opened[i] = _read_frame(frame)
            heapq.heappush(heap, (int(opened[i][0][-1]), i))

    for i in range(len(runs)):
        advance(i)
    while heap:
        cut, ended = heapq.heappop(heap)[0], []
        keys, counts = [], []
        for i, (k, c) in opened.items():
            n = np.searchsorted(k, cut, side="right")
            if n:
                keys.append(k[:n])
                counts.append(c[:n])
                opened[i] = (k[n:], c[n:])
                if n == len(k):
                    ended.append(i)
        while heap and heap[0][0] == cut:  # frames that end at the same key are used up too
            heapq.heappop(heap)
        for i in ended:
            advance(i)
        key, count = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.diff(key, prepend=~key[:1]) != 0)
        yield key[first], np.add.reduceat(count[order], first)


def _blocks(stream: Iterator[tuple[np.ndarray, np.ndarray]], frame: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same records in blocks of at least `frame`."""
    held, n = [], 0
    for block in stream:
        held.append(block)
        n += len(block[0])
        if n >= frame:
            yield np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held])
            held, n = [], 0
    if held:
        yield np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held])


def with_maxima(stream: Iterator[tuple[np.ndarray, np.ndarray]], side_shift: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Each block with a mark on the pairs whose count is the highest of their B id.

    A block's last B id may go on in the next block, so it waits for it; what
    waits is at most one B id's pairs, no more than the A vocabulary.
    """
    key, count = np.zeros(0, np.uint32), np.zeros(0, "<u8")

    def marked(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        side = key >> np.uint32(side_shift)
        start = np.flatnonzero(np.diff(side, prepend=~side[:1]) != 0)
        high = np.repeat(np.maximum.reduceat(count, start), np.diff(start, append=len(key)))
        return key, count, (count == high).astype("u1")

    for k, c in stream:
        key, count = np.concatenate([key, k]), np.concatenate([count, c])
        side = key >> np.uint32(side_shift)
        done = int(np.searchsorted(side, side[-1]))
        if done:
            yield marked(key[:done], count[:done])
            key, count = key[done:], count[done:]
    if len(key):
        yield marked(key, count)


_MERGED = "radix int, chunk long, pairs array<binary>"
_MERGED_TYPES = [("radix", pa.int32()), ("chunk", pa.int64()), ("pairs", pa.list_(pa.binary()))]


def _merge_chunks(batches: Iterator[pa.RecordBatch], cfg: AlignConfig, side_shift: int | None) -> Iterator[pa.RecordBatch]:
    """One row per (radix, chunk): its runs merged; with `side_shift` the maxima are marked too."""
    held: list[list[bytes]] = []
    last = None

    def out() -> pa.RecordBatch:
        blocks = _blocks(merged(held), cfg.frame)
        if side_shift is None:
            frames = [f for k, c in blocks for f in _frames(k, c, 4 * cfg.frame)]
        else:
            frames = [_pack(k, c, best) for k, c, best in with_maxima(blocks, side_shift)]
        return _record([(*last, frames)], _MERGED_TYPES)

    for b in batches:
        for key, frames in zip(zip(b.column(0).to_pylist(), b.column(1).to_pylist()), b.column(2)):
            if key != last and held:
                yield out()
                held = []
            last = key
            held.append(frames.as_py())
    if held:
        yield out()


def _contribute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per run: what its pairs add to the documents of its batch."""
    key = count = best = None
    for b in batches:
        rows = []
        for chunk_kind, batch, frames, docs in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4), b.column(5)):
            if chunk_kind == 0:  # the totals of a radix come before its runs
                columns = [_unpack(f, "<u4", "<u8", "u1") for f in frames.as_py()]
                key, count, best = (np.concatenate(c) for c in zip(*columns))
                continue
            pairs = np.concatenate([_read_frame(f)[0] for f in frames.as_py()])
            many, doc, often = _unpack(docs.as_py(), "<u4", "<u4", "<u4")
            doc = np.cumsum(doc, dtype=np.uint32)
            at = np.repeat(np.searchsorted(key, pairs), many)
            # Sorted by document so that sums stay integers.
            order = np.argsort(doc, kind="stable")
            doc, at, often = doc[order], at[order], often[order].astype("<u8")
            first = np.flatnonzero(np.diff(doc, prepend=~doc[:1]) != 0)
            rows.append((batch, _pack(doc[first], np.add.reduceat(often * count[at], first), np.add.reduceat(often * best[at], first))))
        if rows:
            yield _record(rows, [("batch", pa.int64()), ("docs", pa.binary())])


_OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _give_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document: its facts and what all radixes added."""
    facts: list | None = None
    total = best = None

    def out() -> pa.RecordBatch:
        ids, null, n_a, n_b, groups, links, digest = facts
        sha = [d.decode().strip() for d in np.ascontiguousarray(digest).view("S64").tolist()]
        counts = [pa.array(c.astype(np.int64)) for c in (n_a, n_b, groups, links, best, total)]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=null.astype(bool)), *counts, pa.array(sha, pa.string())], names=[c.split()[0] for c in _OUT.split(", ")])

    for b in batches:
        for kind, blob in zip(b.column(1).to_pylist(), b.column(2)):
            if kind == 0:
                if facts is not None:
                    yield out()
                facts = _unpack(blob.as_py(), "<i8", "u1", "<u8", "<u8", "<u8", "<u8", "u1")
                total, best = np.zeros(len(facts[0]), "<u8"), np.zeros(len(facts[0]), "<u8")
            else:
                doc, more, high = _unpack(blob.as_py(), "<u4", "<u8", "<u8")
                total[doc] += more
                best[doc] += high
    if facts is not None:
        yield out()


def _levels(runs: DataFrame, cfg: AlignConfig, side_shift: int, chunks: int) -> DataFrame:
    """The totals of every radix, merged `fan_in` runs at a time."""
    now = runs.select("radix", "chunk", "pairs")
    while True:
        last = chunks == 1
        dealt = now.repartition("radix", "chunk").sortWithinPartitions("radix", "chunk")
        now = written(dealt.mapInArrow(partial(_merge_chunks, cfg=cfg, side_shift=side_shift if last else None), _MERGED), "totals")
        if last:
            return now
        chunks = -(-chunks // cfg.fan_in)
        now = now.withColumn("chunk", F.pmod("chunk", F.lit(chunks)))


def _run_table(docs: DataFrame, a_file: str, b_file: str, cfg: AlignConfig) -> tuple[DataFrame, DataFrame, int]:
    """Documents' facts per batch, runs with their chunk, and the number of chunks."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    runs = written(narrow.mapInArrow(partial(_runs, a_file=a_file, b_file=b_file, cfg=cfg), _RUN), "runs")
    facts = runs.filter("radix < 0").select("batch", "docs")
    chunks = max(1, -(-facts.count() // cfg.fan_in))
    own = runs.filter("radix >= 0").withColumn("chunk", F.pmod(F.xxhash64("batch"), F.lit(chunks)))
    return facts, own, chunks


def align_documents(docs: DataFrame, a_file: str, b_file: str, cfg: AlignConfig = AlignConfig()) -> DataFrame:
    """One row per row of `docs` (doc_id, text): n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A text that is null or empty, or whose tokens' bytes on either side are not
    the bytes of a blank and the text, has no tokens: zeros and an empty digest.
    Repeated rows are documents of their own and their links count as often;
    a null id stays null; ties for a B id's highest count all count as best;
    other columns are not read; an empty table gives an empty one.
    """
    facts, runs, chunks = _run_table(docs, a_file, b_file, cfg)
    shift = aligner(a_file, b_file, cfg).a_bits
    totals = _levels(runs, cfg, shift, chunks)
    no = F.lit(None)
    sent = totals.select("radix", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk"), F.lit(0).alias("kind"), no.cast("long").alias("batch"), "pairs", no.cast("binary").alias("docs"))
    both = sent.unionByName(runs.select("radix", "chunk", F.lit(1).alias("kind"), "batch", "pairs", "docs"))
    back = both.repartition("radix", "chunk").sortWithinPartitions("radix", "chunk", "kind").mapInArrow(_contribute, "batch long, docs binary")
    met = facts.select("batch", F.lit(0).alias("kind"), "docs").unionByName(back.select("batch", F.lit(1).alias("kind"), "docs"))
    return met.repartition("batch").sortWithinPartitions("batch", "kind").mapInArrow(_give_back, _OUT)


def _pair_rows(batches: Iterator[pa.RecordBatch], a_file: str, b_file: str, cfg: AlignConfig) -> Iterator[pa.RecordBatch]:
    tool = aligner(a_file, b_file, cfg)
    back = np.argsort(tool.b_key, kind="stable")
    for b in batches:
        for frames in b.column(0):
            for f in frames.as_py():
                key, count, best = _unpack(f, "<u4", "<u8", "u1")
                b_id = back[np.searchsorted(tool.b_key[back], key >> np.uint32(tool.a_bits) << np.uint32(tool.a_bits))]
                cols = [pa.array((key & np.uint32((1 << tool.a_bits) - 1)).astype(np.int64)), pa.array(b_id.astype(np.int64)), pa.array(count.astype(np.int64)), pa.array(best.astype(bool))]
                yield pa.RecordBatch.from_arrays(cols, names=["a_id", "b_id", "links", "best"])


def aligned_pairs(docs: DataFrame, a_file: str, b_file: str, cfg: AlignConfig = AlignConfig()) -> DataFrame:
    """One row per linked id pair of the corpus: a_id, b_id, links, best (no other A id is linked more often with b_id)."""
    _, runs, chunks = _run_table(docs, a_file, b_file, cfg)
    totals = _levels(runs, cfg, aligner(a_file, b_file, cfg).a_bits, chunks)
    kind = "a_id long, b_id long, links long, best boolean"
    return totals.select("pairs").mapInArrow(partial(_pair_rows, a_file=a_file, b_file=b_file, cfg=cfg), kind)


def _group_rows(batches: Iterator[pa.RecordBatch], a_file: str, b_file: str, cfg: AlignConfig) -> Iterator[pa.RecordBatch]:
    tool = aligner(a_file, b_file, cfg)
    for texts in _texts(batches, cfg.text_bytes):
        groups = [g for _, _, g in tool.documents([t for _, t in texts])]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in texts], pa.int64()), pa.array(groups, pa.string())], names=["doc_id", "groups"])


def token_groups(docs: DataFrame, a_file: str, b_file: str, cfg: AlignConfig = AlignConfig()) -> DataFrame:
    """doc_id and `groups`, the ids of each group as `a1,a2|b1;a3|b2,b3`; '' for a text without tokens."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return narrow.mapInArrow(partial(_group_rows, a_file=a_file, b_file=b_file, cfg=cfg), "doc_id long, groups string")
