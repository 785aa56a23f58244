"""Every id once, power-of-two sequences, ids as the tokenizer gives them."""

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from flipside.llm.pow2_packing import WordIds, binary_lengths, pack_pow2
from flipside.llm.queries import word_tokenizer
from tests.llm.helpers import ODD, docs, empty


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(word_tokenizer())


def test_lengths():
    for n in [*range(1, 70), 2047, 2048, 2049, 100_000]:
        got = binary_lengths(n, 2048)
        assert sum(got) == n and all(x & (x - 1) == 0 and x <= 2048 for x in got)
        assert sum(x < 2048 for x in got) == len({x for x in got if x < 2048})


def test_words_give_the_texts_ids(tok):
    random.seed(4)
    parts = list("abcXYZ.,!'_ \n\t\r ..,,<|>") + ["é", "İ", "Σ", "\u0301", "½", "'s", "<|endoftext|>", "<|ENDOFTEXT|>", "\x1c", "\xa0", "ﬁ", "12", " the, ", "\u0958", "\x00"]
    words = WordIds(tok, most=200)
    for _ in range(5000):
        text = "".join(random.choice(parts) for _ in range(random.randint(0, 12)))
        assert words.ids(text) == np.asarray(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)
    assert len(words) <= 200 + 60


@pytest.mark.parametrize("clash", [False, True])
def test_round_trip(spark, tok, clash):
    rows = pack_pow2(docs(spark, clash=clash), word_tokenizer()).collect()
    want = sorted(tuple([*tok.encode(t or "", add_special_tokens=False).ids, 1]) for _, t, *_ in ODD)
    by_id = {}
    for r in sorted(rows, key=lambda r: (r["start"], r["sequence_id"])):
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] and r["length"] & (r["length"] - 1) == 0 and r["length"] <= 2048 and r["offset"] == 0
        by_id.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], ids))
    assert sum(r["length"] for r in rows) == sum(map(len, want))
    single = {tuple(x for _, ids in v for x in ids) for k, v in by_id.items() if sum(len(i) for _, i in v) == k[1]}
    assert single <= set(want) and len(single) == 6
    assert sorted(r["sequence_id"] for r in rows) == list(range(len(rows)))
    lengths = [r["length"] for r in sorted(rows, key=lambda r: r["sequence_id"])]
    assert lengths == sorted(lengths)


def test_empty_table(spark):
    assert pack_pow2(empty(spark), word_tokenizer()).count() == 0
