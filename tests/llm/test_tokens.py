"""Encoding in parts equals encoding at once; defined ids for null and empty texts."""

import random
from pathlib import Path

import pytest

from framewright.llm import tokens as T

pytestmark = pytest.mark.skipif(not Path(T.VOCABULARY).exists(), reason="no vocabulary")
ALPHABETS = ["a", "ab", "aé", "!?'", "0123", " \n", "あ亜", "abc 's!1\n", "  a", "aaaaaaab", "the ", "😀a", "-=_", "́a", "\x85 a\t"]


@pytest.mark.parametrize("size", [1, 3, 50])
def test_parts_against_whole(size):
    rng = random.Random(size)
    for i in range(400):
        text = "".join(rng.choice(rng.choice(ALPHABETS) if i % 2 else ALPHABETS[i % len(ALPHABETS)]) for _ in range(rng.randint(0, 250)))
        text = text[:9] * rng.randint(1, 20) if i % 5 == 0 else text
        assert "".join(x for _, _, x in T.pieces(text, size)) == text
        assert T.encode_long(text, size=size) == T.encode_piece(text)


def test_giant_stretch():
    for text in ("a" * 20001, "ab" * 9000 + "c", " " * 9001 + "x", "!" * 9000, "7" * 8999, "é" * 5000):
        assert T.encode_long(text, size=512) == T.encode_piece(text)


def test_against_the_other_library():
    tokenizers = pytest.importorskip("tokenizers")
    other = tokenizers.Tokenizer.from_file(str(Path(T.VOCABULARY).with_suffix(".json")))
    other.encode_special_tokens = True
    for text in ("Hello <|endoftext|> world", "naïve 東京\n\n  x", "don't I'LL"):
        assert other.encode(text, add_special_tokens=False).ids == T.encode_piece(text)


def test_table(spark):
    long = "word, " * 300 + "x" * 700 + " end"
    rows = [(1, None, 5), (2, "", 5), (3, "hi <|endoftext|>", 5), (4, long, 5), (4, long, 5), (None, long + "!", 5), (6, "   ", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = sorted((r.doc_id or 0, tuple(r.ids)) for r in T.encode(df, long=100, piece=64).collect())
    assert got == sorted((i or 0, tuple(T.encode_piece(t)) if t else ()) for i, t, _ in rows)
    assert T.encode(df.where("false")).count() == 0
    assert [r.tokens for r in T.count(df.where("doc_id = 2")).collect()] == [0]
