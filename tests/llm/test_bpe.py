"""The encoder against the tokenizers library, word by word and text by text."""

import random

import numpy as np
import public_tokenizers
import pytest
from fieldspan.llm import bpe
from tokenizers import Tokenizer

from .corpus import frame, texts

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "it's we'll they'd I'M don't 'S", "ΣΑΣ İstanbul ǅ ß ẞ ﬁ é ́x a b c　d\u0085e\x1cf\x1dg", "123 4½ ٣٤ ⅷ", "<|endoftext|> a<|startoftext|>b <|endoftext|><|endoftext|>'s",
    "</w> a</w>b <|end", "😀👩‍👩‍👧 ñ 中文字 日本 한국어 ไทย", "x" * 3000, "ab" * 1500, "\0 a\0b", "!!!???... --- ===>", "aAaA bBb\tc\nd\x0be\x0cf\rg",
]


@pytest.fixture(scope="module")
def coder():
    with open(PATH, encoding="utf-8") as f:
        return bpe.WordBPE(f.read())


def test_words(coder):
    lib = Tokenizer.from_file(PATH)
    r = random.Random(1)
    pieces = [t.replace("</w>", "") for t in r.sample(list(lib.get_vocab()), 3000)]
    words = [r.choice(pieces) + r.choice(pieces) for _ in range(4000)]
    words += ["".join(r.choice("aeinorst") for _ in range(r.randrange(1, 25))) for _ in range(6000)]
    words += ["".join(r.choice("thean") for _ in range(r.randrange(1, 12))) for _ in range(6000)]
    words = [w for w in words if w and "'" not in w and "<|" not in w]
    got = coder.words(words)
    failed = 0
    for w, g in zip(words, got):
        assert g == coder.exact(w), w
        failed += coder.greedy(w) != g
    assert 0 < failed < len(words)


def test_texts(spark, coder):
    lib = Tokenizer.from_file(PATH)
    values = texts(8) + ODD
    rows = bpe.decode(bpe.encode(frame(spark, values), PATH), PATH).collect()
    assert len(rows) == len(values)
    for r in rows:
        e = lib.encode(r.text or "", add_special_tokens=False)
        assert np.frombuffer(r.token_ids, "<u4").tolist() == e.ids, r.text
        assert r.n_tokens == len(e.ids)
        assert r.decoded == lib.decode(e.ids, skip_special_tokens=False)


def test_small_cache(spark, monkeypatch, coder):
    monkeypatch.setattr(bpe, "CACHE", 5)
    lib = Tokenizer.from_file(PATH)
    coder.cache.clear()
    values = [(t or "").encode() for t in texts(9, 10)]
    for t, ids in zip(values, coder.encode(values)):
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode(t.decode(), add_special_tokens=False).ids


def test_empty(spark):
    assert bpe.encode(frame(spark, ["a"]).filter("false"), PATH).count() == 0
