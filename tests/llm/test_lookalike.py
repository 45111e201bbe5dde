"""Texts that look the same become equal, texts that don't stay different."""

import unicodedata

import pytest

from framewright.llm import lookalike as L

CORPUS = {c: n for c, n in zip("abcdefghijklmnopqrstuvwxyzABCDEFGHIKMNOPSTXYZé 'аеорсухіјѕһԁ", range(1000, 0, -1), strict=False)} | {c: 1 for c in "ﬁａｂＣＡ​ οΌ­ガカﾞｶ⼈人〱"}
PATTERNS = frozenset(L.rewriting(CORPUS).items())


@pytest.mark.parametrize(
    ("a", "b"),
    [("ａｂＣ", "abC"), ("café", "café"), ("a​b", "ab"), ("a b", "a b"), ("ﬁx", "fix"), ("раreѕ", "pares"), ("οΟ", "oO"), ("ｶﾞ", "ガ"), ("⼈", "人"), ("a­b", "ab"), ("a  b ", "a b"), ("е́", "é")],
)
def test_same(a, b):
    assert L.consistent(a, PATTERNS) == L.consistent(b, PATTERNS)


@pytest.mark.parametrize(("a", "b"), [("A", "a"), ("é", "e"), ("ab", "a b"), ("l", "I"), ("0", "O"), ("и", "u"), ("カ", "ガ"), ("x", "x²")])
def test_different(a, b):
    assert L.consistent(a, PATTERNS) != L.consistent(b, PATTERNS)


def test_a_longer_pattern_wins_over_its_first_character():
    patterns = L.rewriting({c: 9 for c in "abcdefghijklmnopqrstuvwxyzø"} | {"ı": 1, "…": 50, "...": 3, "і": 2})
    assert patterns["ı"] == "i" and patterns["ı̇"] == "i" and patterns["o\u0338"] == "ø"
    frozen = frozenset(patterns.items())
    assert L.consistent("ıstanbul i̇zmir ı̇", frozen) == "istanbul izmir i"
    assert L.consistent("o\u0338l", frozen) == L.consistent("øl", frozen) == "øl"
    # The more frequent of a string and its short form, wherever the short form began.
    assert L.consistent("a... b…. c.… d....", frozen) == "a… b…. c…. d…."
    spelled = frozenset(L.rewriting({"…": 1, "...": 30, ".": 90}).items())
    assert L.consistent("a... b…", spelled) == "a... b..."
    assert L.consistent("і\u0307", frozen) == "i"  # by the letter it has become


def test_more_scripts():
    for a, b in (("Ꮪtop"[1:], "top"), ("Ꭺlpha", "Alpha"), ("ⲟld", "old"), ("ǀ", "|"), ("ǁ", "||"), ("ⲢⲞ", "PO")):
        assert L.consistent(a, PATTERNS) == L.consistent(b, PATTERNS)


def test_relations_from_a_file(tmp_path):
    (tmp_path / "c.txt").write_text("\ufeff# head\n0271 ;\t006D ;\tMA\t# ɱ\n\n10E7 ; 0079 ; MA\nA7F0 ; 0072 006E ; MA\n", encoding="utf-8")
    frozen = frozenset(L.rewriting(CORPUS, str(tmp_path / "c.txt")).items())
    assert L.consistent("ɱaყ ꟰", frozen) == L.consistent("may rn", frozen) == "may rn"


def test_form_is_stable():
    for text in ("Нет, это не то", "café ﬁ", "ガパ", ""):
        once = L.consistent(text, PATTERNS)
        assert L.consistent(once, PATTERNS) == once and unicodedata.is_normalized("NFC", once)


def test_representative_is_the_frequent_one():
    mostly_cyrillic = dict(L.rewriting({"а": 90, "a": 2}).items())
    assert mostly_cyrillic["a"] == "а" and "а" not in mostly_cyrillic


def test_classes_are_transitive():
    c = L.Classes()
    for a, b in (("1", "2"), ("3", "4"), ("2", "3")):
        c.union(a, b)
    assert sorted(map(sorted, c.groups().values())) == [["1", "2", "3", "4"]]


def test_found(spark):
    recog = spark.createDataFrame([(1, "u", "ｈi"), (1, "u", "ｈi"), (2, "u", "hi"), (3, "u", "ho"), (4, "v", "​"), (5, None, "ｈi"), (6, "u", None), (7, "w", ""), (8, "x", "һi there")], "recog_id long, utt_id string, text string")
    trans = spark.createDataFrame([("u", "hi"), ("u", "hi"), ("v", "x"), ("w", "​"), ("x", "hi  there"), (None, "hi"), ("y", None)], "utt_id string, text string")
    patterns = L.corpus_patterns([recog, trans])
    assert {r.recog_id for r in L.same_looking(recog, trans, patterns).collect()} == {1, 8}
    empty = recog.where("false")
    assert L.corpus_patterns([empty]) and L.same_looking(empty, trans, patterns).count() == 0
    texts = L.with_consistent(recog, {"text": "text"}, patterns).collect()
    assert [r.text for r in texts if r.recog_id in (6, 7)] == [None, ""]
