"""Alignment against a plain token-by-token version, and the merge by itself."""

import hashlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers

from flipside.llm.spill_alignment import AlignConfig, Aligner, _frames, align_documents, aligned_pairs, merged, token_groups, with_maxima
from tests.llm.helpers import DOCS, ODD, docs, empty, rows_of

FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SMALL = AlignConfig(radixes=4, run_links=200, frame=16, fan_in=2, text_bytes=500, cache_words=40)
HARD = ["a  b", "  a", "a ", " ", "\n", "a\n\nb c", "a\n \tb x", "a \n b", "<|endoftext|> <s> hi", "x▁y", "é日本 \u0085 z", "a\x1c b\x1c \x1cc", "a\r\n b;\r\n c", "ﬁ don't 123 4567'll s", " " * 40 + "a" + " " * 17, "nul \x00 here"]


@lru_cache(maxsize=1)
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=FILES[1])


def spans(text):
    """((id, start, end) of A, of B), or nothing."""
    a, b = tokenizers()
    raw = f" {text}".encode()
    letters = {}
    free = 256
    for x in range(256):
        if 33 <= x < 127 or 161 <= x < 173 or x > 173:
            letters[chr(x)] = x
        else:
            letters[chr(free)] = x
            free += 1
    out = []
    for ids, said in (
        (a.encode(f" {text}", add_special_tokens=False).ids, lambda i: bytes(letters[c] for c in a.id_to_token(i))),
        (b.encode(text), lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()),
    ):
        at, got = 0, []
        for i in ids:
            got.append((i, at, at + len(said(i))))
            at += len(said(i))
        if b"".join(map(said, ids)) != raw:
            return [], []
        out.append(got)
    return out


def plain(rows):
    facts, count = [], Counter()
    for i, text in rows:
        a, b = spans(text) if text else ([], [])
        links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]] if len(a) < 3000 else None
        if links is None:  # the same by bytes, for the long text
            of_a = {p: n for n, x in enumerate(a) for p in range(x[1], x[2])}
            of_b = {p: n for n, y in enumerate(b) for p in range(y[1], y[2])}
            links = [(a[m][0], b[n][0]) for m, n in {(of_a[p], of_b[p]) for p in of_a}]
        ends = sorted({x[2] for x in a} & {y[2] for y in b})
        groups, low = [], 0
        if len(a) < 3000:
            for e in ends:
                groups.append("|".join(",".join(str(x[0]) for x in side if low < x[2] <= e) for side in (a, b)))
                low = e
        facts.append((i, len(a), len(b), len(ends), links, ";".join(groups)))
        count.update(links)
    high = defaultdict(int)
    for (_, y), n in count.items():
        high[y] = max(high[y], n)
    out = [(i, na, nb, ng, len(k), sum(count[x] == high[x[1]] for x in k), sum(count[x] for x in k), g) for i, na, nb, ng, k, g in facts]
    return out, count, high


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def check(spark, rows, cfg):
    kind = spark.createDataFrame(rows, DOCS).repartition(3)
    got = align_documents(kind, *FILES, cfg)
    want, count, high = plain([(r[0], r[1]) for r in rows])
    assert sorted(map(repr, (tuple(r[c] for c in COLUMNS) for r in got.collect()))) == sorted(repr(r[:7]) for r in want)
    short = Counter((i, n, hashlib.sha256(g.encode()).hexdigest() if n else "") for i, n, *_, g in want if n < 3000)
    assert Counter((r["doc_id"], r["n_a"], r["groups_sha256"]) for r in got.collect() if r["n_a"] < 3000) == short
    pairs = {(r["a_id"], r["b_id"]): (r["links"], r["best"]) for r in aligned_pairs(kind, *FILES, cfg).collect()}
    assert pairs == {k: (n, n == high[k[1]]) for k, n in count.items()}
    said = Counter((r["doc_id"], r["groups"]) for r in token_groups(kind, *FILES, cfg).collect() if len(r["groups"]) < 20_000)
    assert said == Counter((i, g) for i, n, *_, g in want if n < 3000)


def test_against_plain_version_with_many_small_runs(spark):
    words = ["alpha", "beta", "gamma-ray", "don't", "naïve", "日本語", "x_1", "the", "the", "the"]
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(words, rng.integers(1, 30))), None, None, None) for i in range(60)]
    rows += [(100 + i, t, None, None, None) for i, t in enumerate(HARD)] + [(7, "the the", None, None, None)] * 40 + [(None, "the end", None, None, None)] * 3
    check(spark, rows, SMALL)


def test_odd_rows_and_the_long_text(spark):
    check(spark, ODD, AlignConfig(run_links=5000))


def test_empty_table_and_clashing_columns(spark):
    assert rows_of(align_documents(empty(spark), *FILES)) == []
    assert align_documents(docs(spark, clash=True), *FILES).count() == len(ODD)
    assert rows_of(align_documents(docs(spark, clash=True), *FILES)) == rows_of(align_documents(docs(spark), *FILES))
    nothing = [(1, None, None, None, None), (2, "", None, None, None), (3, "x▁y", None, None, None)]
    assert [(r[0], r["n_links"], r["groups_sha256"]) for r in align_documents(docs(spark, nothing), *FILES).orderBy("doc_id").collect()] == [(i, 0, "") for i in (1, 2, 3)]


def test_words_cut_apart_align_like_whole_texts():
    tool = Aligner(*FILES, AlignConfig(cache_words=3))
    texts = [*HARD, "many plain words, and many MORE plain words.", "many plain words", "don't 12 345 x"]
    whole = iter(tool.links([t for t in texts if t]))
    for text, got in zip(texts, tool.documents(texts)):
        assert got == (next(whole) or (b"", 0, "")), text


def test_merge_adds_equal_pairs_and_marks_maxima_across_blocks():
    rng = np.random.default_rng(2)
    want = Counter()
    runs = []
    for _ in range(9):
        key = np.unique(rng.integers(0, 4000, 700)).astype(np.uint32)
        count = rng.integers(1, 9, len(key))
        want.update(dict(zip(key.tolist(), count.tolist())))
        runs.append(_frames(key, count.astype("<u8"), 50))
    blocks = list(merged([*runs, []]))
    key, count = np.concatenate([k for k, _ in blocks]), np.concatenate([c for _, c in blocks])
    assert (np.diff(key.astype(int)) > 0).all() and dict(zip(key.tolist(), count.tolist())) == dict(want)
    high = defaultdict(int)
    for k, n in want.items():
        high[k >> 7] = max(high[k >> 7], n)
    marked = [(int(k), int(n), bool(m)) for block in with_maxima(iter(blocks), 7) for k, n, m in zip(*block)]
    assert marked == [(k, want[k], want[k] == high[k >> 7]) for k in sorted(want)]
