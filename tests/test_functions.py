"""Hand-made cases of the column functions."""

import pytest
from pyspark.sql import functions as F

from framewright.functions import frames as L
from framewright.functions import text as T
from framewright.operators import dialogue as D
from framewright.operators import tokens as K


def ints(*x):
    return F.array(*[F.lit(v) for v in x]) if x else F.array().cast("array<int>")


def strings(*x):
    return F.array(*[F.lit(v) for v in x]) if x else F.array().cast("array<string>")


def events(*x):
    return F.array(*[F.struct(F.lit(a).alias("label"), F.lit(b).alias("start"), F.lit(c).alias("end")) for a, b, c in x])


def labels(*x):
    return F.array(*[F.struct(F.lit(a).alias("frame_idx"), F.lit(b).alias("label")) for a, b in x])


@pytest.mark.parametrize(("text", "want"), [("He's gonna don't, stop", "he is going to dont stop"), ("", ""), ("  A  b ", "a b"), (None, None)])
def test_normalize(one, text, want):
    assert one(T.normalize_hypothesis(F.lit(text).cast("string"))) == want


def test_curly_quotes_stay_unless_told(one):
    assert one(T.remove_punctuation(F.lit("a’b\"c"))) == "a’bc" and one(T.remove_punctuation(F.lit("a’b"), True)) == "ab"


@pytest.mark.parametrize(("text", "want"), [("a<b>c", "ac"), ("a<b", "a"), ("<x>", "")])
def test_strip_tags(one, text, want):
    assert one(T.strip_tags(F.lit(text))) == want


def test_char_tokens(one):
    assert one(T.char_tokens(F.lit("hello, 世界<unk> x"))) == ["hello,", "世", "界", "<unk>", "x"]


@pytest.mark.parametrize(("word", "want"), [("12", "Number"), ("明", "Mandarin"), ("don't", "English"), ("はこ", "Japanese"), ("a1", "Other"), ("-", "Other"), ("é", "English")])
def test_cluster(one, word, want):
    assert one(T.script_cluster(F.lit(word))) == want


def test_words_at_edges(one):
    assert one(T.edge_punctuation(F.lit(' "He\'s," '))) == "he's"
    assert one(T.full_punctuation(F.lit("It's a-b"))) == "its ab"
    assert one(T.words(F.lit("　a b\t"))) == ["a", "b"]


def test_spelled_letters(one):
    assert one(T.upper_spelled(F.lit("b a r e I l l y"))) == "B A R E I L L Y"
    assert one(T.upper_spelled(F.lit("i 's"))) == "i 's"
    assert one(T.upper_spelled(F.lit("a b 's"))) == "a b 's"


def test_speech_lines(one):
    assert one(T.speech_line(F.lit("u-round1\tab-b  cd…"))) == "u-round1\tab b cd"
    assert one(T.speech_line(F.lit("u-round1 x_y"))) == "u-round1\tx y"
    assert one(T.speech_line(F.lit("plain line"))) == "plain line"


def test_strip_round_is_greedy(one):
    assert one(T.strip_round(F.lit("x-round1-round2"))) == "x-round1" and one(T.strip_round(F.lit("-round1"))) == "-round1"


def test_final_tags(one):
    text = F.lit("<FINAL> a <unknown>b</unknown>")
    assert one(T.finalized(text)) is True and one(T.remove_dialogue_tags(text)) == " a b"


@pytest.mark.parametrize(("text", "score", "ok"), [("Rating: 4", 4.0, True), ("", 0.0, False), ("Rating: four", 0.0, False)])
def test_rating(one, text, score, ok):
    assert one(T.rating(F.lit(text))) == score and one(T.rated(F.lit(text))) is ok


def test_paint_takes_the_largest_label(one):
    assert one(L.paint(events((1, 0.0, 0.1), (5, 0.04, 0.06)), F.lit(6))) == [1, 1, 5, 1, 1, 0]
    assert one(L.paint(events((2, -1.0, 9.0)), F.lit(3))) == [2, 2, 2]
    assert one(L.paint(events((2, 0.5, 0.4)), F.lit(2))) == [0, 0]


def test_first_applied(one):
    assert one(L.first_applied(events((2, 0.0, 3.0), (1, 1.0, 4.0), (5, 2.0, 3.0)), F.lit(5), hop=1.0)) == [2, 2, 5, 1, 0]


@pytest.mark.parametrize(("n", "want"), [(43200, 135), (0, 0), (1, 1), (320, 1), (321, 2)])
def test_frame_count(one, n, want):
    assert one(L.frame_count(F.lit(n))) == want


@pytest.mark.parametrize(("method", "want"), [("first", [2, 0, 4]), ("max", [2, 3, 4]), ("majority", [1, 0, 4])])
def test_downsample(one, method, want):
    assert one(L.downsample(ints(2, 2, 1, 1, 0, 3, 3, 0, 4), 4, method)) == want


def test_downsample_nothing(one):
    assert one(L.downsample(ints(), 4)) == []


def test_expand_tokens(one):
    t = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(c).alias("label")) for a, b, c in ((0, 2, 0), (2, 2, 1), (2, 4, 2))])
    assert [tuple(x) for x in one(L.expand_tokens(t))] == [(0, 0), (1, 0), (2, 2), (3, 2), (4, 2)]


def test_labels(one):
    assert [tuple(x) for x in one(L.dedup_last(labels((3, 1), (0, 2), (3, 5))))] == [(0, 2), (3, 5)]
    assert [x.label for x in one(L.remap(labels((0, 0), (1, 1), (2, 2), (3, 3)), 6))] == [0, 6]
    assert [x.label for x in one(L.remap(labels((0, 0), (1, 1), (2, 2), (3, 3)), -1, True))] == [0, 6, 2, 7]
    assert one(L.dense(labels((1, 4), (1, 5)), F.lit(3))) == [None, 5, None]
    assert one(L.filter_labels(ints(0, 1, 2), True)) == [0, 1] and one(L.filter_labels(ints(0, 1, 2), False, True)) == [0, 1] and one(L.filter_labels(ints(0, 1, 2), False, True, True)) == [0, 1, 1]
    assert one(L.label_text(L.parse_labels(F.lit("[5:0,3:1]"), True))) == "[3:1,5:0]" and one(L.label_text(L.parse_labels(F.lit("[]")))) == "[]"


def test_runs(one):
    assert one(L.run_starts(ints(3, 4, 5, 9, 11, 12))) == [3, 9, 11] and one(L.run_starts(ints())) == []


@pytest.mark.parametrize(("x", "want"), [((1,), 1), ((1, 0), 0), ((1, 1), 1), ((1, 1, 0), 1), ((1, 0, 0), 0)])
def test_majority_error(one, x, want):
    assert one(L.majority_error(ints(*x))) == want


def test_merged_sources_vote_together(one):
    merged = L.merge_max(ints(1, 0, 0), ints(0, 1))
    assert one(merged) == [1, 1] and one(L.majority_error(merged)) == 1


@pytest.mark.parametrize(("x", "want"), [((0, 2, 2, 5), True), ((0, 3, 2), False), ((1,), True), ((), True)])
def test_monotone(one, x, want):
    assert one(L.monotone_starts(ints(*x))) is want


def test_best_word(one):
    spans = lambda *x: F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in x])
    assert one(K.best_words(spans((2, 4)), spans((0, 3), (2, 6)))) == [1]
    assert one(K.best_words(spans((9, 9)), spans((0, 1), (2, 3)))) == [0]


def test_mark_text(one):
    errors = F.array(*[F.struct(F.lit(i).alias("idx"), F.lit(t).alias("type")) for i, t in ((0, "unclear"), (1, "unknown"))])
    assert one(K.mark_text(strings("Hi", ",", "bob"), errors, ints(0, 3, 3))) == "<del> <unclear>hi</unclear> , bob <del> <del>"


def test_word_evaluation_of_one_utterance():
    chars, starts = ["he", "y ", "bo", "b"], [0.0, 0.1, 0.2, 0.3]
    got = K.evaluate("hey rob now", "Hey, bob", ["he", "y", "bo", "b"], starts, [s + 0.1 for s in starts], [0, 0, 1, 0], [0, 0, 0], [0] * 20 + [1, 1])
    assert got["truth"] == [1] and got["gone"] == [1] and got["said_gone"] == [2] and got["word_count"] == 2
    assert got["words"] == ["Hey,", "bob"] and chars
    assert K.original_positions(["a", "b"], ["A", "-", "b!"]) == {0: 0, 1: 2}


def test_word_times_estimate_what_is_not_found():
    assert K.word_times(["ab", "cd"], [0.0, 1.0], [1.0, 2.0], ["ab", "xx"]) == [("ab", 0.0, 1.0), ("xx", 1.0, 2.0)]
    assert K.word_times([], [], [], ["a"]) == []
    assert K.word_errors([1], ["ab", "cd"], ["ab", "cd"]) == [1, 0]


def test_dialogue_context(one):
    assert one(D.context(F.lit(1), F.lit("q"), F.lit("a"))) == "None"
    assert one(D.context(F.lit(3), F.lit("q"), F.lit("a"))) == "Round 2:\nquestion: q\nanswer: a"


def test_rounds_shrink(spark):
    df = spark.createDataFrame([("1", "<unknown>a</unknown> <unclear>b</unclear>"), ("2", "x"), ("3", "<FINAL> <unknown>c</unknown>")], "utt_id string, text string")
    state = D.rounds(df, D.rule_responder, D.rule_answerer)
    assert {(r.utt_id, r.round, r.finalized) for r in state.collect()} == {("1", 1, False), ("1", 2, True), ("2", 1, True), ("3", 1, True)}
    assert {(r.utt_id, r.text.strip()) for r in D.assemble(state).collect()} == {("1", "a b"), ("2", "x"), ("3", "c")}
