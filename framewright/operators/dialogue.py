"""Clarification rounds: requests, replies, the shrinking set of open utterances, and judging."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions import text as T
from framewright.plans.tables import stage

ROUNDS = 4
REPLY = "round INT, clarification_question ARRAY<STRING>, fixed_asr STRING"
RESPONSE = "STRUCT<body: STRUCT<output: ARRAY<STRUCT<type: STRING, content: ARRAY<STRUCT<text: STRING>>>>>>"


def context(round_no: Column, question: Column, answer: Column, default: str = "None") -> Column:
    """What a round sees: the round before it, if there is one."""
    before = F.concat(F.lit("Round "), (round_no - 1).cast("string"), F.lit(":\nquestion: "), question, F.lit("\nanswer: "), answer)
    return F.when((round_no >= 2) & question.isNotNull() & answer.isNotNull(), before).otherwise(default)


def request(key: Column, text: Column, shown: Column, model: str = "model", system: str = "Repair the transcription.") -> Column:
    """A batch request as a JSON line; non-ASCII characters stay."""
    user = F.to_json(F.struct(shown.alias("context"), text.alias("asr")))
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    body = F.struct(F.lit(model).alias("model"), F.array(message("system", F.lit(system)), message("user", user)).alias("input"))
    return F.to_json(F.struct(key.alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/responses").alias("url"), body.alias("body")))


def message_text(response: Column, typed: bool = True) -> Column:
    """The reply's text: of the first output of type message, or of the second output."""
    out = response["body"]["output"]
    one = F.get(F.filter(out, lambda o: o["type"] == "message"), F.lit(0)) if typed else F.get(out, F.lit(1))
    return F.get(one["content"], F.lit(0))["text"]


def parse_reply(text: Column) -> Column:
    """The reply's own JSON: questions joined by a space, and the repaired text. Null if it is none."""
    r = F.from_json(text, REPLY)
    return F.struct(r["round"].alias("round"), F.array_join(F.coalesce(r["clarification_question"], F.array().cast("array<string>")), " ").alias("question"), r["fixed_asr"].alias("fixed"))


def rounds(utterances: DataFrame, responder: Callable[[DataFrame], DataFrame], answerer: Callable[[DataFrame], DataFrame], n: int = ROUNDS) -> DataFrame:
    """utt_id, round, text, question, answer, finalized for every utterance and round it took part in.

    ``utterances`` has utt_id and text. In each round ``responder`` turns utt_id, round, text, context into utt_id, text,
    question; only what is not finalized goes on, with the answer ``answerer`` gives to utt_id, round, question. Rounds are
    staged, since a responder may be costly or differ between calls. The first round's answers are asked for all
    utterances with a question, as later ones for the open ones.
    """
    open_ = utterances.select("utt_id", "text").withColumns({"question": F.lit(None).cast("string"), "answer": F.lit(None).cast("string")})
    out: DataFrame | None = None
    for k in range(1, n + 1):
        asked = open_.select("utt_id", F.lit(k).alias("round"), "text", context(F.lit(k), F.col("question"), F.col("answer")).alias("context"))
        replied = stage(responder(asked).select("utt_id", F.lit(k).alias("round"), "text", "question", T.finalized(F.col("text")).alias("finalized")), f"round-{k}")
        answers = answerer(replied.where("question <> ''").select("utt_id", "round", "question")).select("utt_id", "answer")
        state = stage(replied.join(answers, "utt_id", "left"), f"answers-{k}") if k < n else replied.withColumn("answer", F.lit(None).cast("string"))
        out = state if out is None else out.unionByName(state)
        open_ = state.where("NOT finalized").select("utt_id", "text", "question", "answer")
    return out


def assemble(state: DataFrame, n: int = ROUNDS) -> DataFrame:
    """utt_id, text: everything of the last round and what was finalized before it, without tags."""
    return state.where((F.col("round") == n) | F.col("finalized")).select("utt_id", T.remove_dialogue_tags(F.col("text")).alias("text"))


def rule_responder(asked: DataFrame) -> DataFrame:
    """A deterministic stand-in for a model: resolves one tag a round, and asks about the first that is left."""
    once = F.regexp_replace(F.regexp_replace("text", "^(.*?)<(unknown|unclear)>(.*?)</\\2>", "$1$3"), "<FINAL>", "")
    left = F.regexp_extract(once, "<(?:unknown|unclear)>([^<]*)<", 1)
    question = F.when(left != "", F.concat(F.lit("What does "), left, F.lit(" mean?"))).otherwise("")
    return asked.select("utt_id", F.regexp_replace(once, "<del> ?", "").alias("text"), question.alias("question"))


def rule_answerer(asked: DataFrame) -> DataFrame:
    return asked.select("utt_id", T.spoken_reply(F.concat(F.lit("It is "), F.regexp_extract("question", "^What does (.*) mean", 1))).alias("answer"))


def judge(replies: DataFrame, response: str = "response", binary: bool = False) -> DataFrame:
    """n, score (mean x 20, or x 100), success rate; nulls for no replies. A reply without a rating counts 0."""
    score, ok = T.rating(F.coalesce(F.col(response), F.lit(""))), T.rated(F.coalesce(F.col(response), F.lit("")))
    scaled = F.avg(score) * (100 if binary else 20)
    return replies.agg(F.count("*").alias("n"), F.round(scaled, 6).alias("score"), F.round(F.avg(ok.cast("double")), 6).alias("success"))


