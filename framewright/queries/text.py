"""Queries of the text functions over transcriptions, recognised texts and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.catalog import query
from framewright.functions import text as T
from framewright.plans.tables import table

RE_BLANK, RE_WORD = T.BLANK, T.WORD
quoted = lambda s: "'" + s.replace("'", "''") + "'"
KEYS = "[" + ",".join(quoted(k) for k in T.CONTRACTIONS) + "]"
VALUES = "[" + ",".join(quoted(v) for v in T.CONTRACTIONS.values()) + "]"


# The same functions in the other dialect.
def d_words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{RE_BLANK}+'), lambda w: w <> '')"


def d_collapse(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '{RE_BLANK}+', ' ', 'g'), '^ | $', '', 'g')"


def d_trim(x: str) -> str:
    return f"regexp_replace({x}, '^{RE_BLANK}+|{RE_BLANK}+$', '', 'g')"


def d_expand(x: str) -> str:
    return f"array_to_string(list_transform({d_words(f'lower({x})')}, lambda w: coalesce({VALUES}[list_position({KEYS}, w)], w)), ' ')"


def d_unpunct(x: str) -> str:
    return f"translate({x}, {quoted(T.PUNCTUATION)}, '')"


def d_normal(x: str) -> str:
    return d_collapse(d_unpunct(d_expand(x)))


def d_full(x: str, low: bool = True) -> str:
    return f"regexp_replace({f'lower({x})' if low else x}, '[^{RE_WORD}{RE_BLANK[1:-1]}]', '', 'g')"


def d_edge(x: str) -> str:
    return f"regexp_replace({d_trim(f'lower({x})')}, '^[^{RE_WORD}'']+|[^{RE_WORD}'']+$', '', 'g')"


def d_tags(x: str) -> str:
    return f"regexp_replace({x}, '<[^>]*(>|$)', '', 'g')"


def d_unnamed(x: str) -> str:
    return f"regexp_replace({x}, '[\\p{{Cc}}\\p{{Co}}]', '', 'g')"


def d_upper(x: str) -> str:
    """With the capitals of more than one letter."""
    for a, b in (("ﬃ", "FFI"), ("ﬄ", "FFL"), ("ﬀ", "FF"), ("ﬁ", "FI"), ("ﬂ", "FL"), ("ẞ", "SS")):
        x = f"replace({x if a != 'ﬃ' else f'upper({x})'}, '{a}', '{b}')"
    return x


DOC = "FROM documents"


def on_documents(name: str, expr, sql: str) -> None:
    @query(name, f"SELECT doc_id, {sql} AS out {DOC}")
    def run(spark, d):
        return table(spark, d, "documents").select("doc_id", expr(F.col("text")).alias("out"))


def on_recog(name: str, expr, sql: str) -> None:
    @query(name, f"SELECT recog_id, utt_id, {sql} AS out FROM recog")
    def run(spark, d):
        return table(spark, d, "recog").select("recog_id", "utt_id", expr(F.col("text")).alias("out"))


on_documents("TXT01_expand_contractions", T.expand_contractions, d_expand("text"))
on_documents("TXT02_remove_punctuation", T.remove_punctuation, d_unpunct("text"))
on_recog("TXT02_remove_punctuation_curly", lambda c: T.remove_punctuation(c, True), f"translate(text, {quoted(T.PUNCTUATION + T.CURLY)}, '')")
on_documents("TXT03_normalize_hypothesis", T.normalize_hypothesis, d_normal("text"))
on_recog("TXT03_normalize_recog", T.normalize_hypothesis, d_normal("text"))
on_documents("TXT05_strip_tags", T.strip_tags, d_tags("text"))
on_documents("TXT06_remove_unnamed", T.remove_unnamed, d_unnamed("text"))
on_documents("TXT07_token_list", lambda c: T.token_list(T.words(c), ("<DEL>",)), f"list_filter(list_transform(list_filter(list_transform({d_words('text')}, lambda x: {d_upper(d_unnamed('x'))}), lambda x: x <> '' AND x <> '<DEL>'), lambda x: {d_tags('x')}), lambda x: x <> '')")
on_recog("TXT07_split_tokens", lambda c: T.split_tokens(T.words(F.lower(c)), {"cannot": ["can", "not"], "office": ["off", "ice"]}), f"flatten(list_transform({d_words('lower(text)')}, lambda w: CASE w WHEN 'cannot' THEN ['can','not'] WHEN 'office' THEN ['off','ice'] ELSE [w] END))")
on_documents("TXT09_edge_punctuation", T.edge_punctuation, d_edge("text"))
on_documents("TXT10_full_punctuation", T.full_punctuation, d_full("text"))
on_documents("TXT10_full_punctuation_case", lambda c: T.full_punctuation(c, True), d_full("text", False))
on_documents("TXT13_tokenise", T.words, d_words("text"))
on_documents("TXT15_spoken_reply", T.spoken_reply, f"""trim(regexp_replace(regexp_replace(regexp_replace(text, '{RE_BLANK}+', ' ', 'g'), '[''"`‘’“”\\-‑—–*\\[\\]{{}}()\\\\/_…]+', ' ', 'g'), ' +', ' ', 'g'))""")
on_documents("TXT16_speakable", T.speakable, d_trim("""regexp_replace(regexp_replace(text, '[\\-‑…*_\\[\\]{}()\\\\/]', ' ', 'g'), ' +', ' ', 'g')"""))
on_documents("TXT20_remove_dialogue_tags", T.remove_dialogue_tags, "regexp_replace(text, '</?(unknown|unclear)>|<del>|<FINAL>', '', 'g')")
on_documents("TXT21_collapse", T.collapse, d_collapse("text"))
on_documents("FLT03_finalized", T.finalized, "contains(text, '<FINAL>') OR NOT regexp_matches(text, '</?unknown>|<del>|</?unclear>')")
LAST = f"{d_words('text')}[-1]"
on_documents("TXT23_rating", T.rating, f"coalesce(try_cast({LAST} AS DOUBLE), 0.0)")


@query("TXT14_punctuation_only", f"""SELECT word, count(*) AS n FROM (SELECT unnest({d_words('text')}) AS word FROM documents)
  WHERE NOT regexp_matches(word, '[{RE_WORD}]') AND regexp_matches(word, '[^{RE_WORD}{RE_BLANK[1:-1]}]') GROUP BY word""")
def punctuation_words(spark, d):
    words = table(spark, d, "documents").select(F.explode(T.words(F.col("text"))).alias("word"))
    return words.where(T.punctuation_only(F.col("word"))).groupBy("word").agg(F.count("*").alias("n"))


def d_cluster(word: str) -> str:
    t = f"regexp_replace({d_unnamed(word)}, '[&''@℃=.\\-_#+;]', '', 'g')"
    return f"""CASE WHEN regexp_matches({t}, '^[0-9]+$') THEN 'Number'
    WHEN regexp_matches({t}, '^[\\x{{3400}}-\\x{{4DBF}}\\x{{4E00}}-\\x{{9FFF}}\\x{{F900}}-\\x{{FAFF}}\\x{{20000}}-\\x{{323AF}}]+$') THEN 'Mandarin'
    WHEN regexp_matches({t}, '^[A-Za-zÀ-ÖØ-öø-ɏḀ-ỿ]+$') THEN 'English' WHEN regexp_matches({t}, '^[ぁ-ゖ]+$') THEN 'Japanese' ELSE 'Other' END"""


@query("TXT08_script_cluster", f"SELECT cluster, count(*) AS n FROM (SELECT {d_cluster('word')} AS cluster FROM (SELECT unnest({d_words('text')}) AS word FROM documents)) GROUP BY cluster")
def script_clusters(spark, d):
    words = table(spark, d, "documents").select(F.explode(T.words(F.col("text"))).alias("word"))
    return words.groupBy(T.script_cluster(F.col("word")).alias("cluster")).agg(F.count("*").alias("n"))


@query("TXT04_char_tokens")
def char_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", T.char_tokens(F.col("text")).alias("out"))


@query("TXT17_upper_spelled")
def upper_spelled(spark, d):
    return table(spark, d, "documents").select("doc_id", T.upper_spelled(F.lower("text")).alias("out"))


@query("TXT16_speech_lines")
def speech_lines(spark, d):
    line = F.concat_ws("\t", F.concat(F.col("utt_id"), F.lit("-round1")), F.col("text"))
    return table(spark, d, "recog").where("text IS NOT NULL").select("recog_id", T.speech_line(line).alias("line"))


@query("TXT18_strip_round", "SELECT archive_id, regexp_replace(uttid, '^(.+)-round[0-9]+$', '\\1') AS out FROM encoder_archive")
def strip_round(spark, d):
    return table(spark, d, "encoder_archive").select("archive_id", T.strip_round(F.col("uttid")).alias("out"))


@query("TXT19_prefix", "SELECT DISTINCT 'tts_' || utt_id AS out FROM transcription WHERE utt_id IS NOT NULL")
def prefix(spark, d):
    return table(spark, d, "transcription").where("utt_id IS NOT NULL").select(T.prefixed("tts", F.col("utt_id")).alias("out")).distinct()


# Tokens of two characters per word stand for a recogniser's tokens: char is a list, as recognisers write it.
TOKENS = f"(SELECT recog_id, unnest({d_words('text')}) AS w FROM recog)"


@query("TXT11_token_text", f"SELECT w AS out, count(*) AS n FROM {TOKENS} GROUP BY w")
def token_text(spark, d):
    w = table(spark, d, "recog").select(F.explode(T.words(F.col("text"))).alias("w")).withColumn("char", F.filter(F.split("w", ""), lambda c: c != ""))
    return w.groupBy(T.token_text(F.col("char"), F.col("w")).alias("out")).agg(F.count("*").alias("n"))


@query("TXT12_token_first", f"SELECT substr(w, 1, 1) AS out, count(*) AS n FROM {TOKENS} GROUP BY 1")
def token_first(spark, d):
    w = table(spark, d, "recog").select(F.explode(T.words(F.col("text"))).alias("w")).withColumn("char", F.filter(F.split("w", ""), lambda c: c != ""))
    return w.groupBy(T.token_first(F.col("char")).alias("out")).agg(F.count("*").alias("n"))
