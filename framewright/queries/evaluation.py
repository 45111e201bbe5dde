"""Queries of word evaluation, simulation, dialogue, classifier heads, files and streams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from framewright.catalog import query
from framewright.functions import frames as L
from framewright.functions import text as T
from framewright.operators import align as A
from framewright.operators import dialogue as D
from framewright.operators import distort as S
from framewright.operators import heads as H
from framewright.operators import joins as J
from framewright.operators import metrics as M
from framewright.operators import tokens as K
from framewright.plans.tables import staged_path, table
from framewright.queries import text as Q
from framewright.queries.align import EQUALITY, LABELS, d_ops, d_pairs, d_paths, pairs
from framewright.queries.metrics import JUDGED
from framewright.queries.joins import D_BEST, D_OFFSETS, offsets, segments, spoken, with_offsets
from framewright.sources import readers as R
from framewright.sources import writers as W
from framewright.streaming import frames as ST


def utterances(spark, d, late=False):
    """recog_id, ref, hyp, tokens in seconds, and predictions made of the ids: hearing, intelligibility (one shorter), deleted frames."""
    texts = pairs(spark, d, lambda c: c, lambda c: c).withColumnsRenamed({"ref": "ref", "hyp": "hyp"})
    seconds = F.transform("tokens", lambda t: F.struct(t["char"].alias("char"), (t["start"] * K.FRAME).alias("start"), (t["end"] * K.FRAME).alias("end")))
    # Late keeps tokens out of the shuffle; a generator over an evaluation needs a join between (Spark would evaluate Python in its filter).
    both = offsets(texts.join(spoken(spark, d), "recog_id")).withColumn("tokens", seconds) if late else texts.join(with_offsets(spark, d).select("recog_id", seconds.alias("tokens")), "recog_id")
    n = F.size("tokens")
    by = lambda m, e, k: F.transform(L.span(F.lit(0), k), lambda i: F.when((i * m + F.col("recog_id")) % e == 0, 1).otherwise(0).cast("int"))
    last = F.coalesce(F.ceil(F.array_max(F.transform("tokens", lambda t: t["end"])) / K.FRAME).cast("int"), F.lit(0))
    gone = F.transform(L.span(F.lit(0), last), lambda f: F.when((f * f + F.col("recog_id")) % 9 < 2, 1).otherwise(0).cast("int"))
    return both.select("recog_id", "lang", "ref", "hyp", "tokens", by(7, 5, n).alias("hearing"), by(3, 4, n - 1).alias("intelligibility"), gone.alias("deleted"))


def evaluated(spark, d, late=False):
    return K.evaluate_words(utterances(spark, d, late))


# The same evaluation in the other dialect. Words are made of whole tokens here, so a word's tokens follow from the lengths.
D_VOTE = lambda labels: f"list_sum(list_transform(range(w.first, w.first + w.cnt), lambda q: coalesce({labels}[q + 1], 0))) > w.cnt // 2"
D_EVALUATED = f"""WITH a AS (SELECT recog_id, path, len(hyp) AS n_clean FROM {d_paths(EQUALITY['ALN05_word_eval'][1], A.WORD_TIES)}),
o AS (SELECT recog_id, words, tokens, len(tokens) AS nt, coalesce(ceil(list_max(list_transform(tokens, lambda t: t.end * 0.08::DOUBLE)) / 0.08::DOUBLE), 0)::INT AS nf FROM {D_OFFSETS}),
l AS (SELECT *, list_transform(range(0, nt - 1), lambda i: CASE WHEN (i * 3 + recog_id) % 4 = 0 THEN 1 ELSE 0 END) AS intel,
  list_transform(range(0, nt - 1), lambda i: CASE WHEN (i * 7 + recog_id) % 5 = 0 OR (i * 3 + recog_id) % 4 = 0 THEN 1 ELSE 0 END) AS hear,
  list_filter(range(0, nf), lambda f: (f * f + recog_id) % 9 < 2 AND len(list_filter(tokens, lambda t: NOT (t.end * 0.08::DOUBLE < greatest(0, f - 1) * 0.08::DOUBLE OR t.start * 0.08::DOUBLE > least(nf, f + 2) * 0.08::DOUBLE))) = 0) AS free,
  list_filter(list_transform(range(1, len(words) + 1), lambda i: {{'i': i - 1, 'word': words[i].word, 'start': words[i].start * 0.08::DOUBLE, 'cnt': (len(words[i].word) + 1) // 2, 'first': coalesce(list_sum(list_transform(words[1:i - 1], lambda x: (len(x.word) + 1) // 2)), 0)::BIGINT}}),
    lambda x: regexp_matches(x.word, '[{Q.RE_WORD}]')) AS names FROM o),
v AS (SELECT *, list_transform(names, lambda w: {D_VOTE('hear')}) AS hv, list_transform(names, lambda w: {D_VOTE('intel')}) AS iv FROM l),
x AS (SELECT v.recog_id, a.n_clean, v.words, names, iv, list_transform(list_filter(range(1, len(names) + 1), lambda k: (hv[k] OR iv[k]) AND k <= n_clean), lambda k: (k - 1)::INT) AS wrong,
  list_transform(list_filter(range(1, len(path) + 1), lambda k: path[k] IN ('S', 'I')), lambda k: (len(replace(path[:k], 'D', '')) - 1)::INT) AS truth, list_transform(list_filter(range(1, len(path) + 1), lambda k: path[k] = 'D'), lambda k: len(replace(path[:k], 'D', ''))::INT) AS gone,
  list_transform(list_filter(free, lambda f: NOT list_contains(free, f - 1)), lambda f: coalesce(list_min(list_filter(range(0, len(names)), lambda k: names[k + 1].start > f * 0.08::DOUBLE)), n_clean)::INT) AS said FROM v JOIN a USING (recog_id)),
e AS (SELECT *, list_transform(wrong, lambda k: names[k + 1].i::INT) AS "at", list_transform(wrong, lambda k: CASE WHEN iv[k + 1] THEN 'unknown' ELSE 'unclear' END) AS kinds,
  list_transform(gone, lambda g: CASE WHEN g >= n_clean THEN len(words) ELSE names[g + 1].i END::INT) AS gone_original, list_transform(said, lambda g: CASE WHEN g >= n_clean THEN len(words) ELSE names[g + 1].i END::INT) AS said_original FROM x)"""


@query("JON16_predecessor_positions", f"SELECT recog_id, list_transform(list_filter(range(1, len(path) + 1), lambda k: path[k] = 'D'), lambda k: len(replace(path[:k], 'D', ''))::INT) AS positions FROM {d_paths(EQUALITY['ALN05_word_eval'][1], A.WORD_TIES)}")
def predecessor_positions(spark, d):
    w, _, ties = EQUALITY["ALN05_word_eval"]
    rows = pairs(spark, d, w, w).withColumn("ops", A.align(F.col("ref"), F.col("hyp"), ties))
    return rows.select("recog_id", K.deletion_positions(F.col("ops")).alias("positions"))


@query("LBL14_token_labels", f"""SELECT recog_id, '[' || array_to_string(list_transform(range(1, len(tokens) + 1), lambda i: tokens[i].start || ':' || coalesce(w[best[i] + 1], 0)), ',') || ']' AS labels
  FROM (SELECT recog_id, tokens, {D_BEST} AS best FROM {D_OFFSETS}) JOIN (SELECT recog_id, list(label ORDER BY hyp_idx) FILTER (hyp_idx >= 0) AS w FROM (SELECT recog_id, -1 AS hyp_idx, 0 AS label FROM {d_paths(EQUALITY['ALN03_token_labels'][1], A.TOKEN_TIES)} UNION ALL FROM {LABELS}) GROUP BY recog_id) USING (recog_id)""")
def token_labels(spark, d):
    words, _, ties = EQUALITY["ALN03_token_labels"]
    ops = pairs(spark, d, words, words).select("recog_id", A.align(F.col("ref"), F.col("hyp"), ties).alias("ops"))
    lab = ops.select("recog_id", F.transform(F.filter("ops", lambda o: o["op"] != "D"), lambda o: F.when(o["op"] == "C", 0).otherwise(1)).alias("w"))
    t = offsets(spoken(spark, d).join(lab, "recog_id"))
    return t.select("recog_id", L.label_text(K.token_labels(F.col("w"), K.best_words(F.col("tokens"), F.col("words")), F.col("tokens"))).alias("labels"))


@query("LBL15_frame_events", f"""WITH o AS (SELECT recog_id, k, CASE WHEN op = 'D' THEN ref_idx ELSE hyp_idx END * 4 AS s, CASE op WHEN 'C' THEN 0 WHEN 'D' THEN 2 ELSE 1 END AS label FROM {d_ops(EQUALITY['ALN04_pairs'][1], A.PAIR_TIES)}),
r AS (SELECT *, row_number() OVER (PARTITION BY recog_id ORDER BY s DESC, k DESC) AS back FROM o),
f AS (SELECT recog_id, s, k, label, unnest(range(s, s + CASE WHEN back = 1 THEN 4 ELSE 3 END)) AS frame FROM r)
SELECT p.recog_id, '[' || coalesce(labels, '') || ']' AS labels FROM {d_paths(EQUALITY['ALN04_pairs'][1], A.PAIR_TIES)} p LEFT JOIN (SELECT recog_id, string_agg(frame || ':' || label, ',' ORDER BY s, k, frame) AS labels FROM f GROUP BY recog_id) USING (recog_id)""")
def frame_events(spark, d):
    words, _, ties = EQUALITY["ALN04_pairs"]
    rows = pairs(spark, d, words, words).withColumn("ops", A.align(F.col("ref"), F.col("hyp"), ties))
    tok = lambda c: F.transform(c, lambda w, i: F.struct((i * 4).alias("start"), (i * 4 + 3).alias("end")))
    e = K.frame_events(F.col("ops"), tok(F.col("ref")), tok(F.col("hyp")))
    return rows.select("recog_id", L.label_text(F.transform(L.expand_tokens(e), lambda x: x)).alias("labels"))


@query("LBL19_word_times", f"""SELECT recog_id, list_transform(words, lambda w: w.word || '|' || round(w.start * 80)::BIGINT || '|' || round(w.end * 80)::BIGINT) AS words FROM {D_OFFSETS}
  JOIN (SELECT recog_id FROM {d_pairs(lambda x: x)}) USING (recog_id)""")
def word_times(spark, d):
    """Words of a recognised text with the times of the tokens that hold them."""
    t = utterances(spark, d).select("recog_id", "hyp", "tokens")

    @F.pandas_udf("array<struct<word:string,start:double,end:double>>")
    def run(hyp, chars, starts, ends):
        import pandas as pd

        return pd.Series([[{"word": w, "start": a, "end": z} for w, a, z in K.word_times(list(c), list(s), list(e), h.split())] for h, c, s, e in zip(hyp, chars, starts, ends)], dtype=object)

    at = lambda n: F.transform("tokens", lambda x: x[n])
    ms = lambda x: F.round(x * 1000).cast("long").cast("string")
    return t.select("recog_id", run("hyp", F.transform("tokens", lambda x: T.token_first(x["char"])), at("start"), at("end")).alias("w")).select("recog_id", F.transform("w", lambda x: F.concat_ws("|", x["word"], ms(x["start"]), ms(x["end"]))).alias("words"))


@query("LBL20_word_labels", f"{D_EVALUATED} SELECT recog_id, wrong AS predicted, n_clean::INT AS word_count FROM e")
def word_labels(spark, d):
    return evaluated(spark, d).select("recog_id", "predicted", "word_count")


@query("LBL22_original_positions", f"{D_EVALUATED} SELECT recog_id, \"at\" AS positions FROM e")
def original_positions(spark, d):
    return evaluated(spark, d).select("recog_id", F.transform("errors", lambda e: e["idx"]).alias("positions"))


@query("LBL23_position_remap", f"{D_EVALUATED} SELECT recog_id, gone_original, said_original AS said_gone_original FROM e")
def position_remap(spark, d):
    return evaluated(spark, d, late=True).select("recog_id", "gone_original", "said_gone_original")


@query("LBL24_error_types", f"{D_EVALUATED} SELECT type, count(*) AS n FROM (SELECT unnest(kinds) AS type FROM e) GROUP BY type")
def error_types(spark, d):
    e = evaluated(spark, d).select(F.explode("errors").alias("e"))
    return e.groupBy(F.col("e.type").alias("type")).agg(F.count("*").alias("n"))


D_MARKED = f"""list_transform(range(0, len(words)), lambda i: CASE WHEN list_contains(said_original, i) THEN '<del> ' ELSE '' END || CASE WHEN list_contains("at", i) AND regexp_matches(words[i + 1].word, '[{Q.RE_WORD}]')
  THEN '<' || kinds[list_position("at", i)] || '>' || lower(words[i + 1].word) || '</' || kinds[list_position("at", i)] || '>' ELSE lower(words[i + 1].word) END)"""


@query("LBL25_marked_text", f"{D_EVALUATED} SELECT recog_id, array_to_string(list_concat({D_MARKED}, list_transform(list_filter(said_original, lambda p: p >= len(words)), lambda p: '<del>')), ' ') AS marked FROM e")
def marked_text(spark, d):
    return evaluated(spark, d).select("recog_id", K.mark_text(F.col("words"), F.col("errors"), F.col("said_gone_original")).alias("marked"))


D_SET = lambda k, t, p, n: f"SELECT '{k}' AS kind, len(list_filter(list_distinct({t}), lambda q: list_contains({p}, q))) AS tp, len(list_filter(list_distinct({p}), lambda q: NOT list_contains({t}, q))) AS fp, len(list_filter(list_distinct({t}), lambda q: NOT list_contains({p}, q))) AS fn FROM e"
D_BEYOND = lambda x, y: f"list_concat({x}, list_transform({y}, lambda g: (g + n_clean)::INT))"


@query("AGG13_word_evaluation", f"""{D_EVALUATED}, c AS ({D_SET('words', 'truth', 'wrong', 'n_clean')} UNION ALL {D_SET('deletions', 'gone_original', 'said_original', '0')} UNION ALL {D_SET('overall', D_BEYOND('truth', 'gone'), D_BEYOND('wrong', 'said'), 'n_clean')}),
  t AS (SELECT kind, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM c GROUP BY kind), q AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END AS r FROM t)
SELECT kind, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM q""")
def word_evaluation(spark, d):
    """Corpus scores of word errors, deletions and both, from per-utterance index sets."""
    e = evaluated(spark, d)
    beyond = lambda c: F.transform(c, lambda p: p + F.col("word_count"))
    kinds = {
        "words": M.index_metrics(F.col("truth"), F.col("predicted"), F.col("word_count")),
        "deletions": M.index_metrics(F.col("gone_original"), F.col("said_gone_original"), F.lit(0)),
        "overall": M.index_metrics(F.array_union("truth", beyond("gone")), F.array_union("predicted", beyond("said_gone")), F.col("word_count")),
    }
    sums = e.agg(*[F.sum(v).alias(f"{k}_{n}") for k, m in kinds.items() for n, v in m.items()])
    parts = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), *[F.col(f"{k}_{n}").alias(n) for n in ("tp", "fp", "fn", "tn")]) for k in kinds]))
    return M.binary_scores(sums.select(parts.alias("x")).select("x.*")).drop("fpr", "tn")


AUDIO = "(SELECT DISTINCT archive_id, list_transform(audio, lambda x: x::DOUBLE) AS x FROM encoder_archive WHERE len(audio) > 0)"
RMS = lambda c: f"sqrt(list_sum(list_transform({c}, lambda v: v * v)) / len({c}) + 1e-12)"


def audio(spark, d):
    x = F.transform("audio", lambda v: v.cast("double"))
    return table(spark, d, "encoder_archive").where(F.size("audio") > 0).select("archive_id", x.alias("x")).distinct()


@query("DSP01_snr_scale", f"SELECT archive_id, round({RMS('x')} / pow(10, 0.5::DOUBLE) / {RMS('n')}, 4) AS scale FROM (SELECT archive_id, x, list_transform(x, lambda v: v * v + 0.1::DOUBLE) AS n FROM {AUDIO})")
def snr_scale(spark, d):
    n = F.transform("x", lambda v: v * v + 0.1)
    return audio(spark, d).select("archive_id", F.round(S.snr_scale(F.col("x"), n, 10.0), 4).alias("scale"))


@query("DSP03_fade", f"""SELECT archive_id, round(list_sum(list_transform(range(0, len(x)), lambda i: x[i + 1] * (CASE WHEN i < n THEN i::DOUBLE / (n - 1) ELSE 1 END) * (CASE WHEN i >= len(x) - n THEN (len(x) - 1 - i)::DOUBLE / (n - 1) ELSE 1 END))), 4) AS total
  FROM (SELECT *, least(80, len(x) // 2) AS n FROM {AUDIO})""")
def fade(spark, d):
    y = S.fade(F.col("x"))
    return audio(spark, d).select("archive_id", F.round(F.aggregate(y, F.lit(0.0), lambda a, v: a + v), 4).alias("total"))


def d_room(number: int, taps: int = 32) -> str:
    h = S.room(number, taps)
    return "[" + ", ".join(f"{v!r}::DOUBLE" for v in h.tolist()) + "]"


def d_convolved(number: int, shift: int = 0) -> str:
    """Samples shift.. of the full convolution of x with a room, as many as x has."""
    return f"list_transform(range({shift}, len(x) + {shift}), lambda i: list_sum(list_transform(range(greatest(0, i - len(x) + 1), least(i + 1, 32)), lambda k: x[i - k + 1] * h[k + 1])))"


@query("DSP04_rir_convolution", f"""SELECT archive_id, round({RMS('z')}, 4) AS rms, round(list_max(list_transform(z, lambda v: abs(v))), 4) AS peak FROM (SELECT archive_id, list_transform(y, lambda v: greatest(-1.0::DOUBLE, least(1.0::DOUBLE, v * ({RMS('x')} / {RMS('y')})))) AS z
  FROM (SELECT *, {d_convolved(3)} AS y FROM (SELECT *, {d_room(3)} AS h FROM {AUDIO})))""")
def rir_convolution(spark, d):
    y = F.transform(S.signal(lambda x: S.convolve(x, S.room(3)), F.col("x")), lambda v: v.cast("double"))
    return audio(spark, d).select("archive_id", y.alias("y")).select("archive_id", F.round(L.rms(F.col("y")), 4).alias("rms"), F.round(L.peak(F.col("y")), 4).alias("peak"))


@query("DSP05_noise_mix", f"""SELECT archive_id, round({RMS('y')} / greatest(1.0::DOUBLE, list_max(list_transform(y, lambda v: abs(v)))), 4) AS rms, round(list_sum(list_transform(range(1, len(y) + 1), lambda i: y[i] * x[i])) / greatest(1.0::DOUBLE, list_max(list_transform(y, lambda v: abs(v)))), 3) AS dot
  FROM (SELECT archive_id, x, list_transform(range(1, len(x) + 1), lambda i: x[i] + r[i] * ({RMS('x')} / pow(10, 0.5::DOUBLE) / {RMS('r')})) AS y FROM (SELECT *, list_reverse(x) AS r FROM {AUDIO}))""")
def noise_mix(spark, d):
    y = F.transform(S.signal(lambda x: S.mix_noise(x, x[::-1], 10.0), F.col("x")), lambda v: v.cast("double"))
    mixed = audio(spark, d).select("archive_id", "x", y.alias("y"))
    dot = F.aggregate(F.zip_with("x", "y", lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    return mixed.select("archive_id", F.round(L.rms(F.col("y")), 4).alias("rms"), F.round(dot, 3).alias("dot"))


@query("DSP09_zero_segment", f"SELECT archive_id, len(list_filter(list_transform(range(0, len(x)), lambda i: CASE WHEN i >= 16 AND i < 48 THEN 0 ELSE x[i + 1] END), lambda v: v = 0)) + CASE WHEN x[16] <> 0 THEN 1 ELSE 0 END + CASE WHEN x[49] <> 0 THEN 1 ELSE 0 END AS zeros FROM {AUDIO}")
def zero_segment_all(spark, d):
    """Recordings of any length: ramps and interval are clamped to it."""
    y = S.zero_segment(F.col("x"), F.lit(0.001), F.lit(0.003))
    return audio(spark, d).select("archive_id", F.size(F.filter(y, lambda v: v == 0)).cast("long").alias("zeros"))


@query("DSP11_synthetic_noise")
def synthetic_noise(spark, d):
    y = S.signal(lambda n, k: S.synthetic_noise(n, "pink", k), F.size("x"), F.col("archive_id"))
    return audio(spark, d).select("archive_id", F.round(L.rms(F.transform(y, lambda v: v.cast("double"))), 4).alias("rms"))


@query("DSP12_synthetic_room", f"SELECT archive_id, round({RMS('y')}, 4) AS rms, round(y[1], 4) AS first FROM (SELECT archive_id, {d_convolved(2, 15)} AS y FROM (SELECT *, {d_room(2)} AS h FROM {AUDIO} WHERE len(x) >= 32))")
def synthetic_room(spark, d):
    """Reverberation cut around the middle, for audio at least as long as the room's response."""
    y = F.transform(S.signal(lambda x: S.reverb(x, S.room(2)), F.col("x")), lambda v: v.cast("double"))
    return audio(spark, d).where(F.size("x") >= 32).select("archive_id", y.alias("y")).select("archive_id", F.round(L.rms(F.col("y")), 4).alias("rms"), F.round(F.get("y", F.lit(0)), 4).alias("first"))


@query("DSP13_power_mix", f"""SELECT archive_id, round({RMS('y')}, 4) AS rms FROM (SELECT archive_id, CASE WHEN p > 0 THEN list_transform(range(1, len(x) + 1), lambda i: x[i] + x[len(x) + 1 - i] * sqrt(p / (p * pow(10, 0.5::DOUBLE)))) ELSE x END AS y
  FROM (SELECT *, list_sum(list_transform(x, lambda v: v * v)) / len(x) AS p FROM {AUDIO}))""")
def power_mix(spark, d):
    y = F.transform(S.signal(lambda x: S.mix_by_power(x, x[::-1], 5.0), F.col("x")), lambda v: v.cast("double"))
    return audio(spark, d).select("archive_id", F.round(L.rms(y), 4).alias("rms"))


@query("DSP20_resample")
def resample(spark, d):
    y = F.transform(S.signal(lambda x: S.resample(x, 16000, 8000), F.col("x")), lambda v: v.cast("double"))
    return audio(spark, d).select("archive_id", y.alias("y")).select("archive_id", F.size("y").alias("n"), F.round(L.rms(F.col("y")), 4).alias("rms"))


# --- Dialogue: the documents that carry marks of uncertainty ---


def open_texts(spark, d):
    docs = table(spark, d, "documents").where(F.col("text").isNotNull() & (F.col("text").rlike("</?(unknown|unclear)>|<del>|<FINAL>")))
    return docs.select(F.col("doc_id").cast("string").alias("utt_id"), "text")


# The rule-based responder in the other dialect: the first pair of tags in the first line goes, then marks.
D_PREFIX = lambda x, t: f"CASE WHEN regexp_matches({x}, '^[^\\n\\r\\x{{85}}\\x{{2028}}\\x{{2029}}]*?<{t}>[^\\n\\r\\x{{85}}\\x{{2028}}\\x{{2029}}]*?</{t}>') THEN len(regexp_extract({x}, '^([^\\n\\r\\x{{85}}\\x{{2028}}\\x{{2029}}]*?)<{t}>[^\\n\\r\\x{{85}}\\x{{2028}}\\x{{2029}}]*?</{t}>', 1)) ELSE 999999999 END"
D_UNTAG = lambda x, t: f"regexp_replace({x}, '^([^\\n\\r\\x{{85}}\\x{{2028}}\\x{{2029}}]*?)<{t}>([^\\n\\r\\x{{85}}\\x{{2028}}\\x{{2029}}]*?)</{t}>', '\\1\\2')"
D_ONCE = lambda x: f"replace(CASE WHEN {D_PREFIX(x, 'unknown')} <= {D_PREFIX(x, 'unclear')} THEN {D_UNTAG(x, 'unknown')} ELSE {D_UNTAG(x, 'unclear')} END, '<FINAL>', '')"
D_OPEN = "(contains(text, '<FINAL>') OR NOT regexp_matches(text, '</?unknown>|<del>|</?unclear>'))"
D_ROUNDS = f"""WITH RECURSIVE r(utt_id, round, text, question, finalized) AS (SELECT doc_id::VARCHAR, 0, text, '', false FROM documents WHERE regexp_matches(text, '</?(unknown|unclear)>|<del>|<FINAL>')
  UNION ALL SELECT utt_id, round, text, question, {D_OPEN} FROM (SELECT utt_id, round, regexp_replace(once, '<del> ?', '', 'g') AS text, regexp_extract(once, '<(?:unknown|unclear)>([^<]*)<', 1) AS question
    FROM (SELECT utt_id, round + 1 AS round, {D_ONCE('text')} AS once FROM r WHERE round < 4 AND NOT finalized)))"""


@query("ITR01_rounds", f"{D_ROUNDS} SELECT round, finalized, count(*) AS n, count(*) FILTER (question <> '') AS questions FROM r WHERE round > 0 GROUP BY round, finalized")
def clarification_rounds(spark, d):
    state = D.rounds(open_texts(spark, d), D.rule_responder, D.rule_answerer)
    return state.groupBy("round", "finalized").agg(F.count("*").alias("n"), F.count_if(F.col("question") != "").alias("questions"))


@query("ITR02_assembled", f"{D_ROUNDS} SELECT utt_id, regexp_replace(text, '</?(unknown|unclear)>|<del>|<FINAL>', '', 'g') AS text FROM r WHERE round = 4 OR round > 0 AND finalized")
def assembled(spark, d):
    return D.assemble(D.rounds(open_texts(spark, d), D.rule_responder, D.rule_answerer))


@query("ITR03_context", """SELECT utt_id, CASE WHEN r >= 2 THEN 'Round ' || (r - 1) || ':' || chr(10) || 'question: ' || q || chr(10) || 'answer: ' || q ELSE 'None' END AS shown
  FROM (SELECT DISTINCT utt_id, recog_id % 3 + 1 AS r, asr_run AS q FROM recog WHERE utt_id IS NOT NULL AND asr_run IS NOT NULL)""")
def shown_context(spark, d):
    r = table(spark, d, "recog").where("utt_id IS NOT NULL AND asr_run IS NOT NULL").select("utt_id", (F.col("recog_id") % 3 + 1).alias("r"), F.col("asr_run").alias("q")).distinct()
    return r.select("utt_id", D.context(F.col("r"), F.col("q"), F.col("q")).alias("shown"))


@query("ITR07_judge", f"SELECT 'scale' AS form, count(*) AS n, round(avg(score) * 20, 6) AS score, round(avg(ok), 6) AS success FROM {JUDGED} UNION ALL SELECT 'binary', count(*), round(avg(score) * 100, 6), round(avg(ok), 6) FROM {JUDGED}")
def judged(spark, d):
    replies = table(spark, d, "documents").where("source = 'judge_reply'")
    form = lambda n, b: D.judge(replies, "text", b).withColumn("form", F.lit(n))
    return form("scale", False).unionByName(form("binary", True))


@query("JON10_utterance_context", """SELECT u.utt_id, u.recog_id, CASE WHEN q IS NOT NULL AND a IS NOT NULL THEN 'Round 1:' || chr(10) || 'question: ' || q || chr(10) || 'answer: ' || a ELSE 'None' END AS shown
  FROM (SELECT DISTINCT utt_id, recog_id FROM recog WHERE utt_id IS NOT NULL) u LEFT JOIN (SELECT utt_id, min(text) AS q, max(lang) AS a FROM transcription WHERE utt_id IS NOT NULL GROUP BY utt_id) t ON u.utt_id = t.utt_id""")
def utterance_context(spark, d):
    """Every recognised utterance with what is known of it (here its transcription and language), if anything is."""
    u = table(spark, d, "recog").where("utt_id IS NOT NULL").select("utt_id", "recog_id").distinct()
    qa = table(spark, d, "transcription").where("utt_id IS NOT NULL").groupBy("utt_id").agg(F.min("text").alias("q"), F.max("lang").alias("a"))
    return J.inner_all([u], "utt_id", [qa]).select("utt_id", "recog_id", D.context(F.lit(2), F.col("q"), F.col("a")).alias("shown"))


TRIPLE = "(SELECT utt_id, arg_min(text, recog_id) AS first, arg_max(text, recog_id) AS last FROM recog WHERE utt_id IS NOT NULL AND text IS NOT NULL GROUP BY utt_id)"


@query("JON11_judge_triple", f"SELECT r.utt_id, r.reference, h.first AS question, h.last AS prediction FROM (SELECT utt_id, max(text) AS reference FROM transcription WHERE utt_id IS NOT NULL AND text IS NOT NULL GROUP BY utt_id) r JOIN {TRIPLE} h ON r.utt_id = h.utt_id")
def judge_triple(spark, d):
    """Reference, question and prediction of an utterance: one row a side, so no pairs within it."""
    r = table(spark, d, "transcription").where("utt_id IS NOT NULL AND text IS NOT NULL").groupBy("utt_id").agg(F.max("text").alias("reference"))
    h = table(spark, d, "recog").where("utt_id IS NOT NULL AND text IS NOT NULL").groupBy("utt_id").agg(F.min_by("text", "recog_id").alias("question"), F.max_by("text", "recog_id").alias("prediction"))
    return J.inner_all([r, h], "utt_id")


@query("TXT22_request", """SELECT doc_id, json_extract_string(line, '$.custom_id') AS id, json_extract_string(json_extract_string(line, '$.body.input[1].content'), '$.asr') AS asr, 'POST /v1/responses model None system user' AS rest FROM (
  SELECT doc_id, json_object('custom_id', doc_id::VARCHAR, 'body', json_object('input', json_array(json_object('content', ''), json_object('content', json_object('asr', text)::VARCHAR)))) AS line FROM documents WHERE text IS NOT NULL)""")
def request(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    line = D.request(F.col("doc_id").cast("string"), F.col("text"), F.lit("None"))
    back = docs.select("doc_id", line.alias("line"))
    at = lambda p: F.get_json_object("line", p)
    inner = at("$.body.input[1].content")
    rest = F.concat_ws(" ", at("$.method"), at("$.url"), at("$.body.model"), F.get_json_object(inner, "$.context"), at("$.body.input[0].role"), at("$.body.input[1].role"))
    return back.select("doc_id", at("$.custom_id").alias("id"), F.get_json_object(inner, "$.asr").alias("asr"), rest.alias("rest"))


def _responses(spark, d):
    """A response whose message carries the reply as JSON text."""
    inner = F.to_json(F.struct(F.lit(2).alias("round"), F.array(F.col("source"), F.col("lang")).alias("clarification_question"), F.col("text").alias("fixed_asr")))
    part = lambda kind, t: F.struct(F.lit(kind).alias("type"), F.array(F.struct(t.alias("text"))).alias("content"))
    out = F.struct(F.struct(F.array(part("reasoning", F.lit("")), part("message", inner)).alias("output")).alias("body"))
    docs = table(spark, d, "documents").where("text IS NOT NULL AND source IS NOT NULL AND lang IS NOT NULL")
    return docs.select("doc_id", F.from_json(F.to_json(out), D.RESPONSE).alias("response"))


REPLIES = "SELECT doc_id, source || ' ' || lang AS question, text AS fixed FROM documents WHERE text IS NOT NULL AND source IS NOT NULL AND lang IS NOT NULL"


def register_reply(name: str, typed: bool) -> None:
    @query(name, REPLIES)
    def run(spark, d):
        return _responses(spark, d).select("doc_id", D.parse_reply(D.message_text(F.col("response"), typed)).alias("x")).select("doc_id", "x.question", "x.fixed")


register_reply("TXT24_reply_positional", False)
register_reply("TXT25_reply_typed", True)


# --- Classifier heads over embeddings: weights are made of indices, so that both dialects have the same ---

W10 = [[((3 * i + 5 * j) % 7 - 3) / 7.0 for j in range(64)] for i in range(10)]


def weights(head: int) -> list[list[float]]:
    return [[((3 * i + 5 * j + head) % 7 - 3) / 7.0 for j in range(64)] for i in range(10)]


def d_logits(head: int = 0) -> str:
    return f"list_transform(range(0, 10), lambda i: round(list_sum(list_transform(range(0, 64), lambda j: greatest(embedding[j + 1]::DOUBLE, 0) * ((3 * i + 5 * j + {head}) % 7 - 3) / 7.0::DOUBLE)), 4) + 0.0::DOUBLE)"


def logits(head: int = 0):
    return F.transform(H.linear(F.col("embedding"), weights(head), [0.0] * 10), lambda v: F.round(v, 4) + F.lit(0.0))


@query("MDL02_linear_head", f"SELECT vec_id, {d_logits()} AS logits FROM embeddings")
def linear_head(spark, d):
    return table(spark, d, "embeddings").select("vec_id", logits().alias("logits"))


def utterance_frames(spark, d):
    e = table(spark, d, "embeddings").withColumn("utt", F.floor(F.col("vec_id") / 50))
    return e.groupBy("utt").agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda x: x["embedding"]).alias("frames"))


D_DOT = lambda x, i, n, shift="0": f"list_sum(list_transform(range(0, {n}), lambda j: {x} * ((3 * {i} + 5 * j + {shift}) % 7 - 3) / 7.0::DOUBLE))"
D_CLASS = "list(list_position(l, list_max(l))::INT - 1 ORDER BY vec_id) AS classes"


@query("MDL03_two_layer_head", f"""SELECT utt, {D_CLASS} FROM (SELECT vec_id, vec_id // 50 AS utt, list_transform(range(0, 10), lambda i: {D_DOT('h[j + 1]', 'i', 10)}) AS l
  FROM (SELECT vec_id, list_transform(range(0, 10), lambda i: greatest({D_DOT('greatest(embedding[j + 1]::DOUBLE, 0)', 'i', 64)}, 0)) AS h FROM embeddings)) GROUP BY utt""")
def two_layer_head(spark, d):
    w1, w2 = np.array(W10), np.array(W10)[:, :10]
    return utterance_frames(spark, d).select("utt", H.predict(F.col("frames"), H.two_layer, w1, np.zeros(10), w2, np.zeros(10)).alias("classes"))


@query("MDL04_cnn_head", f"""WITH s AS (SELECT vec_id, vec_id // 50 AS utt, list_transform(range(0, 8), lambda i: {D_DOT('embedding[j + 1]::DOUBLE', 'i', 64)} / 5) AS s FROM embeddings),
  y AS (SELECT vec_id, utt, [{', '.join(f'greatest(sum(s[{o}]) OVER w / sqrt(1.00001::DOUBLE), 0)' for o in range(1, 9))}] AS h FROM s WINDOW w AS (PARTITION BY utt ORDER BY vec_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
SELECT utt, {D_CLASS} FROM (SELECT vec_id, utt, list_transform(range(0, 10), lambda i: {D_DOT('h[j + 1]', 'i', 8)}) AS l FROM y) GROUP BY utt""")
def cnn_head(spark, d):
    kernel = np.stack([np.array(W10[:8])] * 5, axis=2) / 5
    one = np.ones(8)
    return utterance_frames(spark, d).select("utt", H.predict(F.col("frames"), H.cnn, [(kernel, one * 0, one * 0, one, one, one * 0)], np.array(W10)[:, :8], np.zeros(10)).alias("classes"))


@query("MDL07_cross_entropy", "SELECT vec_id, round(ln(list_sum(list_transform(e, lambda v: exp(v)))) - e[label + 1], 4) AS loss FROM (SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings)")
def cross_entropy(spark, d):
    e = F.transform("embedding", lambda v: v.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", F.round(H.cross_entropy(e, F.col("label")), 4).alias("loss"))


@query("MDL10_four_heads", "SELECT vec_id, " + ", ".join(f"list_position(l{h}, list_max(l{h}))::INT - 1 AS head_{h}" for h in range(4)) + f" FROM (SELECT vec_id, {', '.join(f'{d_logits(h)} AS l{h}' for h in range(4))} FROM embeddings)")
def four_heads(spark, d):
    """Four heads, each with its own weights, over the same frames in one pass: the class each of them gives."""
    out = table(spark, d, "embeddings").select("vec_id", *[logits(h).alias(f"l{h}") for h in range(4)])
    return out.select("vec_id", *[L.arg_max(F.col(f"l{h}")).alias(f"head_{h}") for h in range(4)])


# --- Files: tables are written in the other formats and read again ---


def round_trip(spark, df, line, name):
    W.text_lines(df, line, path := staged_path(spark, name))
    return path


@query("SRC01_scp", "SELECT rec_id, min(audio_path) AS audio_path FROM recordings WHERE audio_path IS NOT NULL GROUP BY rec_id")
def src_scp(spark, d):
    r = table(spark, d, "recordings").where("audio_path IS NOT NULL").groupBy("rec_id").agg(F.min("audio_path").alias("audio_path"))
    return R.scp(spark, round_trip(spark, r, F.concat_ws(" ", "rec_id", "audio_path"), "scp"))


@query("SRC02_segments", "SELECT DISTINCT segment_id, recording_id, start_sec, end_sec FROM segments WHERE recording_id IS NOT NULL AND start_sec IS NOT NULL AND end_sec IS NOT NULL AND NOT isnan(start_sec) AND NOT isnan(end_sec)")
def src_segments(spark, d):
    s = segments(spark, d).where("recording_id IS NOT NULL AND start_sec IS NOT NULL AND end_sec IS NOT NULL AND NOT isnan(start_sec) AND NOT isnan(end_sec)")
    s = s.select("segment_id", "recording_id", "start_sec", "end_sec").distinct()
    return R.segments(spark, round_trip(spark, s, F.concat_ws(" ", "segment_id", "recording_id", F.col("start_sec").cast("string"), F.col("end_sec").cast("string")), "segments"))


@query("SRC04_cut_samples", "SELECT archive_id, audio[17:160] AS samples FROM encoder_archive WHERE audio IS NOT NULL")
def src_cut(spark, d):
    a = table(spark, d, "encoder_archive").where("audio IS NOT NULL")
    return a.select("archive_id", R.cut(F.col("audio"), F.lit(16000), F.lit(0.001), F.lit(0.01)).alias("samples"))


@query("SRC05_rejected_commands", "SELECT CASE WHEN audio_path IS NULL THEN 'no path' ELSE 'shell command' END AS reason, count(*) AS n FROM recordings WHERE audio_path IS NULL OR audio_path LIKE '%|' GROUP BY 1")
def src_rejected(spark, d):
    return R.playable(table(spark, d, "recordings"))[1].groupBy("reason").agg(F.count("*").alias("n"))


@query("SRC06_resources", "SELECT DISTINCT segment_id AS resource_id, audio_path, start_sec, end_sec FROM (SELECT DISTINCT segment_id, recording_id, start_sec, end_sec FROM segments) s JOIN (SELECT rec_id, min(audio_path) AS audio_path FROM recordings WHERE audio_path NOT LIKE '%|' GROUP BY rec_id) r ON recording_id = rec_id WHERE NOT isnan(start_sec) AND NOT isnan(end_sec)")
def src_resources(spark, d):
    r = R.playable(table(spark, d, "recordings"))[0].groupBy("rec_id").agg(F.min("audio_path").alias("audio_path"))
    return R.resources(r, segments(spark, d).where("start_sec IS NOT NULL AND end_sec IS NOT NULL AND NOT isnan(start_sec) AND NOT isnan(end_sec)")).distinct()


@query("SRC07_timestamps", f"SELECT recog_id::VARCHAR AS utt_id, list_transform(words, lambda w: w.word) AS words, list_transform(words, lambda w: w.start) AS starts FROM {D_OFFSETS}")
def src_timestamps(spark, d):
    """Words as a list of Python literals, quotes and backslashes escaped, and read again."""
    w = with_offsets(spark, d)
    quoted = lambda x: F.regexp_replace(x["word"], '(["\\\\])', "\\\\$1")
    item = F.transform("words", lambda x: F.concat(F.lit("{'word': \""), quoted(x), F.lit("\", 'start_offset': "), x["start"].cast("string"), F.lit(", 'end_offset': "), x["end"].cast("string"), F.lit(", 'start': None}")))
    path = round_trip(spark, w, F.concat(F.col("recog_id").cast("string"), F.lit("\t["), F.array_join(item, ", "), F.lit("]")), "timestamps")
    at = lambda n: F.transform("tokens", lambda t: t[n])
    return R.timestamps(spark, path)[0].select("utt_id", at("word").alias("words"), at("start_offset").alias("starts"))


UTT = f"(SELECT utt_id, max({Q.d_collapse('text')}) AS t FROM transcription WHERE utt_id IS NOT NULL AND text IS NOT NULL GROUP BY utt_id)"


def _transcribed(spark, d):
    return table(spark, d, "transcription").where("utt_id IS NOT NULL AND text IS NOT NULL").groupBy("utt_id").agg(F.max(T.collapse(F.col("text"))).alias("t"))


def register_transcription(name: str, sql: str, **options) -> None:
    @query(name, sql)
    def run(spark, d):
        return R.transcriptions(spark, round_trip(spark, _transcribed(spark, d), F.concat_ws(" ", "utt_id", "t"), "transcription"), **options)


register_transcription("SRC08_word_lists", f"SELECT utt_id, list_filter(str_split(t, ' '), lambda w: w <> '') AS words FROM {UTT}")
register_transcription("SRC09_strings_keep", f"SELECT utt_id, t AS text FROM {UTT}", form="string")
register_transcription("SRC10_strings_drop", f"SELECT utt_id, t AS text FROM {UTT} WHERE t <> ''", form="string", empty="drop")
register_transcription("SRC11_single_space", f"SELECT utt_id, t AS text FROM {UTT}", form="string", separator="space")


CONFIDENCES = "SELECT DISTINCT pred_id::VARCHAR AS utt_id, list_transform(predictions, lambda x: round(x * 0.25::DOUBLE, 4)) AS confidences FROM predictions WHERE predictions IS NOT NULL"


def confidence_rows(spark, d):
    p = table(spark, d, "predictions").where("predictions IS NOT NULL")
    return p.select(F.col("pred_id").cast("string").alias("utt_id"), F.transform("predictions", lambda x: (x * 0.25).cast("float")).alias("c")).distinct()


def register_confidences(name: str) -> None:
    @query(name, CONFIDENCES)
    def run(spark, d):
        """Written as objects of at most 1000 utterances each, and read again."""
        W.confidence_files(confidence_rows(spark, d), "utt_id", "c", path := staged_path(spark, "confidence"))
        return R.confidences(spark, path).select("utt_id", F.transform("word_confidence", lambda v: F.round(v.cast("double"), 4)).alias("confidences"))


register_confidences("SRC15_confidence_json")
register_confidences("SNK08_confidence_object")


@query("SRC16_prediction_lines", """SELECT file_id, x.num_frames AS num_frames, x.predictions AS predictions FROM (SELECT file_id, max({'num_frames': num_frames, 'predictions': predictions}) AS x FROM predictions
  WHERE file_id IS NOT NULL AND model_name = 'deletion' AND predictions IS NOT NULL AND num_frames IS NOT NULL GROUP BY file_id)""")
def src_predictions(spark, d):
    p = table(spark, d, "predictions").where("file_id IS NOT NULL AND model_name = 'deletion' AND predictions IS NOT NULL AND num_frames IS NOT NULL")
    p = p.groupBy("file_id").agg(F.max(F.struct("num_frames", "predictions")).alias("x")).select("file_id", "x.*")
    W.json_lines(p, path := staged_path(spark, "predictions"), "file_id", "num_frames", "predictions")
    return R.predictions(spark, path).select("file_id", "num_frames", "predictions")


@query("SNK02_sharded_parquet", "SELECT ((row_number() OVER (ORDER BY uttid) - 1) // 1000)::INT AS shard, uttid, rows, samples FROM (SELECT uttid, count(*) AS rows, sum(coalesce(len(audio), 0))::BIGINT AS samples FROM encoder_archive WHERE uttid IS NOT NULL GROUP BY uttid)")
def sharded_parquet(spark, d):
    """Records at 1000 ids a file, written and read again."""
    records = table(spark, d, "encoder_archive").where("uttid IS NOT NULL").groupBy("uttid").agg(F.count("*").alias("rows"), F.sum(F.coalesce(F.size("audio"), F.lit(0))).alias("samples"))
    return W.sharded(records, "uttid", staged_path(spark, "shards"), 1000).select("shard", "uttid", "rows", "samples")


@query("SNK10_two_ways", "SELECT CASE WHEN contains(text, '<FINAL>') OR NOT regexp_matches(text, '</?unknown>|<del>|</?unclear>') THEN 'finalized' ELSE 'not_finalized' END AS side, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1")
def sink_two_ways(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text")
    W.two_ways(docs, T.finalized(F.col("text")), path := staged_path(spark, "sides"))
    return spark.read.parquet(path).groupBy("side").agg(F.count("*").alias("n"))


@query("SRC21_paired", f"""SELECT DISTINCT utt_id, text FROM transcription WHERE utt_id IN (SELECT uttid FROM encoder_archive WHERE len(audio) > 0) AND len({Q.d_words('text')}) <= 10""")
def src_paired(spark, d):
    heard = table(spark, d, "encoder_archive").where("uttid IS NOT NULL").where(F.size("audio") > 0).select(F.col("uttid").alias("utt_id"))
    return R.paired(table(spark, d, "transcription").where("text IS NOT NULL").select("utt_id", "text"), heard).distinct()


# A record's first row with audio, by its number, as the three files of a segment.
TRIPLES = """(SELECT uttid, arg_min({'audio': audio, 'rate': sample_rate, 'labels': targets.labels}, archive_id) AS x FROM encoder_archive
  WHERE uttid IS NOT NULL AND len(audio) > 0 AND sample_rate > 0 AND targets.labels IS NOT NULL GROUP BY uttid)"""
SOUND = "list_transform(x.audio, lambda v: floor(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, v::DOUBLE)) * 32767 + 0.5)::BIGINT)"


def triples(spark, d):
    """Where the wav, npy and json files of every archived record have been written."""
    a = table(spark, d, "encoder_archive").where("uttid IS NOT NULL AND targets.labels IS NOT NULL AND sample_rate > 0").where(F.size("audio") > 0)
    a = a.groupBy("uttid").agg(F.min_by(F.struct("audio", "sample_rate", F.transform("targets.labels", lambda x: x["label"]).alias("labels")), "archive_id").alias("x"))
    rows = a.select("uttid", "x.audio", "x.sample_rate", "x.labels", F.to_json(F.struct("uttid", F.size("x.labels").alias("labels"))).alias("meta"))
    return W.triples(rows, "uttid", "audio", "sample_rate", "labels", "meta", staged_path(spark, "triples"))


def sound(spark, path):
    return R.wav_samples(spark, path).select(F.col("utt_id"), F.transform("samples", lambda v: F.round(v * 32768).cast("long")).alias("s"), "sample_rate")


@query("SNK01_segment_triples", f"SELECT uttid AS utt_id, x.rate AS sample_rate, len(x.audio) AS samples, list_sum({SOUND})::BIGINT AS total, list_transform(x.labels, lambda l: l.label) AS labels, len(x.labels)::INT AS meta FROM {TRIPLES}")
def segment_triples(spark, d):
    """Audio, labels and metadata of every record as three files, and what they hold."""
    path = triples(spark, d)
    heard = sound(spark, path).select("utt_id", "sample_rate", F.size("s").cast("long").alias("samples"), F.aggregate("s", F.lit(0).cast("long"), lambda a, v: a + v).alias("total"))
    meta = R.files(spark, path, ".json").select(F.col("content").cast("string").alias("value")).select(F.get_json_object("value", "$.uttid").alias("utt_id"), F.get_json_object("value", "$.labels").cast("int").alias("meta"))
    return J.inner_all([heard, R.npy_labels(spark, path), meta], "utt_id")


@query("SRC17_npy_labels", f"SELECT uttid AS utt_id, list_transform(x.labels, lambda l: l.label) AS labels FROM {TRIPLES}")
def src_npy(spark, d):
    return R.npy_labels(spark, triples(spark, d))


@query("SRC20_wav_folder", f"SELECT uttid AS utt_id, x.rate AS sample_rate, {SOUND} AS s FROM {TRIPLES}")
def src_wav(spark, d):
    return sound(spark, triples(spark, d))


@query("SRC03_range_read", f"SELECT uttid AS utt_id, {SOUND}[floor(0.0013 * x.rate)::BIGINT + 1:least(len(x.audio), floor(0.0103 * x.rate)::BIGINT)] AS s FROM {TRIPLES}")
def src_range(spark, d):
    """A range of seconds of wav files, at the rate they have."""
    path = triples(spark, d)
    part = R.wav_range(spark, path, F.lit(0.0013), F.lit(0.0103))
    return part.select("utt_id", F.transform("samples", lambda v: F.round(v * 32768).cast("long")).alias("s"))


@query("SRC22_formats", "SELECT * FROM (VALUES ('labels', false), ('lines', true), ('named.jsonl', true)) t(name, is_json)")
def src_formats(spark, d):
    p = table(spark, d, "predictions").where("file_id IS NOT NULL AND predictions IS NOT NULL").select(F.col("file_id").alias("uttid"), F.transform("predictions", lambda x, i: F.struct(i.alias("frame_idx"), x.alias("label"))).alias("predictions"))
    W.json_lines(p, lines := staged_path(spark, "lines"), "uttid")
    W.label_lines(p, "uttid", "predictions", labels := staged_path(spark, "labels"))
    W.json_lines(p, named := staged_path(spark, "named") + ".jsonl", "uttid")
    rows = [(n, R.looks_like_json(spark, x)) for n, x in (("labels", labels), ("lines", lines), ("named.jsonl", named))]
    return spark.createDataFrame(rows, "name string, is_json boolean")


@query("SRC23_streamed_dataset", "SELECT archive_id, uttid, split_name, coalesce(len(audio), -1)::INT AS samples FROM encoder_archive")
def src_stream(spark, d):
    """The dataset as a stream of files, each micro-batch in an order by hash, written as it comes."""
    files = staged_path(spark, "parts")
    table(spark, d, "encoder_archive").select("archive_id", "uttid", "split_name", F.coalesce(F.size("audio"), F.lit(-1)).alias("samples")).repartition(6).write.parquet(files)
    return R.streamed(spark, files, staged_path(spark, "streamed"), staged_path(spark, "progress"), "archive_id")


PRED_COUNTS = """(SELECT model_name, count(*) FILTER (p = 1 AND t = 1) AS tp, count(*) FILTER (p = 1 AND t <> 1) AS fp, count(*) FILTER (p <> 1 AND t = 1) AS fn, count(*) FILTER (p <> 1 AND t <> 1) AS tn FROM
  (SELECT model_name, unnest(predictions[1:least(len(predictions), len(labels))]) AS p, unnest(labels[1:least(len(predictions), len(labels))]) AS t FROM predictions WHERE model_name IS NOT NULL AND predictions IS NOT NULL AND labels IS NOT NULL) GROUP BY model_name)"""
SCORED = """model_name, tp, fp, fn, tn, round(CASE WHEN tp + fp + fn + tn > 0 THEN (tp + tn)::DOUBLE / (tp + fp + fn + tn) ELSE 0 END, 6) AS accuracy, round(CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END, 6) AS precision,
  round(CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1"""


@query("SNK06_metrics_json", f"SELECT {SCORED} FROM {PRED_COUNTS}")
def metrics_json(spark, d):
    """Accuracy, precision, recall, F1 and the confusion counts of each model as a JSON object; written and read again."""
    p = table(spark, d, "predictions").where("model_name IS NOT NULL AND predictions IS NOT NULL AND labels IS NOT NULL")
    n = F.least(F.size("predictions"), F.size("labels"))
    pairs_ = p.select("model_name", F.explode(F.zip_with(F.slice("predictions", F.lit(1), n), F.slice("labels", F.lit(1), n), lambda a, b: F.struct(a.alias("p"), b.alias("t")))).alias("x"))
    counts = pairs_.groupBy("model_name").agg(*[c.alias(k) for k, c in M.binary_counts(F.col("x.t") == 1, F.col("x.p") == 1).items()])
    W.metrics_json(counts, "model_name", path := staged_path(spark, "metrics"))
    return spark.read.schema("model_name string, tp long, fp long, fn long, tn long, accuracy double, precision double, recall double, f1 double").json(path)


@query("SNK12_report", f"""SELECT model_name || ': accuracy ' || printf('%.2f', 100 * accuracy) || ' % [ ' || (tp + tn) || ' / ' || (tp + fp + fn + tn) || ', ' || fp || ' false alarms, ' || fn || ' missed ]' AS line FROM (SELECT {SCORED} FROM {PRED_COUNTS})""")
def report(spark, d):
    """The lines of a printed report."""
    m = metrics_json(spark, d)
    line = F.format_string("%s: accuracy %.2f %% [ %d / %d, %d false alarms, %d missed ]", "model_name", F.col("accuracy") * 100, F.expr("tp + tn"), F.expr("tp + fp + fn + tn"), "fp", "fn")
    return m.select(line.alias("line"))


@query("SNK11_replaced", "SELECT utt_id, text || ' (2)' AS text, 'new' AS which FROM (SELECT utt_id, max(text) AS text FROM transcription WHERE utt_id IS NOT NULL AND text IS NOT NULL GROUP BY utt_id) UNION ALL SELECT utt_id, max(text), 'backup' FROM transcription WHERE utt_id IS NOT NULL AND text IS NOT NULL GROUP BY utt_id")
def replaced(spark, d):
    """A dataset rewritten in its place: the new version stands beside it until it is whole, and the old one is kept."""
    t = table(spark, d, "transcription").where("utt_id IS NOT NULL AND text IS NOT NULL").groupBy("utt_id").agg(F.max("text").alias("text"))
    t.write.parquet(path := staged_path(spark, "in-place"))
    backup = W.replace(spark, path, lambda df: df.withColumn("text", F.expr("text || ' (2)'")))
    return spark.read.parquet(path).withColumn("which", F.lit("new")).unionByName(spark.read.parquet(backup).withColumn("which", F.lit("backup")))


@query("SNK07_request_lines", "SELECT doc_id::VARCHAR AS id, text AS asr FROM documents WHERE text IS NOT NULL")
def request_lines(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    W.text_lines(docs, D.request(F.col("doc_id").cast("string"), F.col("text"), F.lit("None")), path := staged_path(spark, "requests"))
    content = F.get_json_object(F.get_json_object("value", "$.body.input[1].content"), "$.asr")
    return spark.read.text(path).select(F.get_json_object("value", "$.custom_id").alias("id"), content.alias("asr"))


BATCHES = "(SELECT pred_id, predictions, (row_number() OVER (ORDER BY len(predictions), pred_id) - 1) // 32 AS batch FROM (SELECT DISTINCT pred_id, predictions FROM predictions WHERE predictions IS NOT NULL AND pred_id IS NOT NULL))"


@query("PRT03_padded_batches", f"""SELECT batch, pred_id, list_transform(range(1, widest + 1), lambda i: coalesce(predictions[i], -100)) AS padded, list_transform(range(1, widest + 1), lambda i: CASE WHEN i <= len(predictions) THEN 1 ELSE 0 END) AS mask
  FROM (SELECT *, max(len(predictions)) OVER (PARTITION BY batch) AS widest FROM {BATCHES})""")
def padded_batches(spark, d):
    """Batches of 32 sequences of like length, padded to the longest of their batch (DSP21), with a mask."""
    p = table(spark, d, "predictions").where("predictions IS NOT NULL AND pred_id IS NOT NULL").select("pred_id", "predictions").distinct()
    return J.padded_batches(p, "pred_id", "predictions", 32, -100).select("batch", "pred_id", "padded", "mask")


@query("PRT02_rank_shards", f"SELECT pred_id, r % 3 AS rank, r // 3 AS place FROM (SELECT pred_id, row_number() OVER (ORDER BY pred_id) - 1 AS r FROM (SELECT DISTINCT pred_id FROM predictions WHERE pred_id IS NOT NULL))")
def rank_shards(spark, d):
    return J.rank_shards(table(spark, d, "predictions").where("pred_id IS NOT NULL").select("pred_id").distinct(), "pred_id", 3)


@query("SNK09_question_and_text", REPLIES)
def question_and_text(spark, d):
    """Both outputs of one pass: the questions and the repaired texts, joined again from what was written."""
    r = _responses(spark, d).select("doc_id", D.parse_reply(D.message_text(F.col("response"))).alias("x")).select("doc_id", "x.question", "x.fixed")
    r.write.parquet(path := staged_path(spark, "replies"))
    q, f = spark.read.parquet(path).select("doc_id", "question"), spark.read.parquet(path).select("doc_id", "fixed")
    return q.join(f, "doc_id")


@query("SRC18_dataset", "SELECT archive_id, uttid, sample_rate, split_name, dataset, len(audio)::INT AS samples, round(list_sum(list_transform(audio, lambda v: v::DOUBLE)), 4) AS total, len(targets.labels)::INT AS labels, targets.raw AS raw FROM encoder_archive")
def src_dataset(spark, d):
    a = R.dataset(spark, f"{d}/encoder_archive.parquet")
    total = F.when(F.size("audio") > 0, F.round(F.aggregate("audio", F.lit(0.0), lambda s, v: s + v.cast("double")), 4))
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c))
    return a.select("archive_id", "uttid", "sample_rate", "split_name", "dataset", size("audio").alias("samples"), total.alias("total"), size("targets.labels").alias("labels"), F.col("targets.raw").alias("raw"))


@query("STR01_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling(spark, d):
    w = ST.tumbling(table(spark, d, "events"), "ts", ["event_type"])
    return w.select(F.col("window.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("STR02_sessions", """SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM (SELECT *, sum(CASE WHEN before IS NULL OR ts > before + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s
  FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events)) GROUP BY user_id, s""")
def sessions(spark, d):
    w = ST.sessions(table(spark, d, "events"), "ts", ["user_id"])
    return w.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
