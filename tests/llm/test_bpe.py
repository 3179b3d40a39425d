import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from manloom.llm import bpe

WHOLE = bpe.load(bpe.default_vocabulary())
LIBRARY = Tokenizer.from_file(bpe.default_vocabulary())


def same(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    assert WHOLE.encode(text).tolist() == ids
    assert WHOLE.decode(WHOLE.encode(text)) == LIBRARY.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize(
    "text",
    [
        "", " \n\t", "Hello, world! It's 42 o'clock'S", "a\x1cb\x1fc \x85x　y", "ÜBER straße ΣΑΣ ΟΔΟΣ İstanbul", "é café ẛ̣",
        "<|endoftext|>x <|startoftext|> <|endoftext|", "½²Ⅷ٣ 12345", "日本語テキスト 한국어 \U0001f600\U0001f468‍\U0001f469", "a" * 3000, "ab" * 700 + "!!!" * 200, "'ll'd 're",
        "naïve_under_score--dash", "​zero​width﻿",
    ],
)
def test_like_the_library(text):
    same(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(codec="utf-8", max_codepoint=0x2FFF), max_size=60))
def test_any_text_like_the_library(text):
    if all(unicodedata.category(c) != "Cn" for c in unicodedata.normalize("NFC", text)):
        same(text)


def test_scan_and_heap_merge_alike():
    rng = random.Random(5)
    for _ in range(200):
        raw = "".join(rng.choice("theranois") for _ in range(rng.randint(1, 64))).encode()
        ids = [WHOLE.inner[b] for b in raw[:-1]] + [WHOLE.last[raw[-1]]]
        assert WHOLE._long_word(list(ids)) == WHOLE.word(raw)


def test_bounded_table():
    small = bpe.WordBpe(bpe.default_vocabulary(), max_kept=3)
    text = " ".join(f"word{i}" for i in range(50))
    assert small.encode(text).tolist() == WHOLE.encode(text).tolist()
    assert len(small) <= 3


def test_rows(spark):
    docs = spark.createDataFrame([(1, "A b", "x"), (1, "A b", "x"), (None, None, None), (3, "  ", "ids")], "doc_id long, text string, decoded string")
    got = sorted(bpe.digests(docs).collect(), key=str)
    assert len(got) == 4 and sum(r.n_tokens for r in got) == 4
    full = {(r.doc_id, tuple(r.ids), r.decoded) for r in bpe.encode(docs).collect()}
    assert full == {(1, tuple(LIBRARY.encode("A b", add_special_tokens=False).ids), "a</w> b</w>"), (None, (), ""), (3, (), "")}
    assert bpe.digests(docs.limit(0)).count() == 0


def test_table_is_bounded_in_bytes():
    """Long blank-free pieces are encoded each time and leave nothing behind."""
    own = bpe.WordBpe(bpe.default_vocabulary())
    rng = random.Random(4)
    for _ in range(20):
        own.encode("".join(rng.choice("abcdefgh123.") for _ in range(40_000)))
    assert len(own) == 0
    own.encode("a" * bpe.KEPT_CHARS + " " + "b" * (bpe.KEPT_CHARS + 1))
    assert list(own) == ["a" * bpe.KEPT_CHARS]


def test_very_long_word_like_the_library():
    rng = random.Random(5)
    same("".join(rng.choice("etaoinshrdlu") for _ in range(300_000)))
