"""Queries of the language-model operators and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.llm import mixing, splits, tokens
from framewright.llm.crosssplit import CrossSplit, overlaps
from framewright.llm.lookalike import corpus_patterns, same_looking, with_consistent
from framewright.llm.mojibake import repair_texts
from framewright.llm.tokens import encode
from framewright.plans.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("p9_found")
def p9_found(spark, d):
    return repair_texts(table(spark, d, "documents").select("doc_id", "text")).where("garbled").select("doc_id")


@query("p9_restored")
def p9_restored(spark, d):
    found = repair_texts(table(spark, d, "documents").select("doc_id", "text")).where("garbled")
    return found.select("doc_id", "restored", "restored_text", F.array_join("layers", " | ").alias("layers"))


@query("p7_ids")
def p7_ids(spark, d):
    return encode(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "ids")


def _patterns(recog, transcription):
    return corpus_patterns([recog, transcription])


@query("p4_found")
def p4_found(spark, d):
    recog, transcription = table(spark, d, "recog"), table(spark, d, "transcription")
    return same_looking(recog, transcription, _patterns(recog, transcription))


@query("p4_texts")
def p4_texts(spark, d):
    recog, transcription = table(spark, d, "recog"), table(spark, d, "transcription")
    both = recog.select(F.lit("recog").alias("in_table"), F.col("recog_id").cast("string").alias("row_key"), "text")
    both = both.unionByName(transcription.select(F.lit("transcription").alias("in_table"), F.col("utt_id").alias("row_key"), "text"))
    return with_consistent(both, {"text": "consistent_text"}, _patterns(recog, transcription)).drop("text")


@query("p6_found")
def p6_found(spark, d):
    return overlaps(table(spark, d, "encoder_archive"))


@query("p6_report")
def p6_report(spark, d):
    return CrossSplit(table(spark, d, "encoder_archive")).report()


FILLED = "('" + "','".join(splits.FILLERS) + "')"
TIES = rf"""ties AS (SELECT DISTINCT rec_id, t FROM (
  SELECT rec_id, 'speaker:' || lower(trim(speaker_id)) AS t FROM recordings WHERE lower(trim(speaker_id)) NOT IN {FILLED}
  UNION ALL SELECT rec_id, 'session:' || session_id FROM recordings WHERE lower(trim(session_id)) NOT IN {FILLED}
  UNION ALL SELECT rec_id, 'file:' || CASE WHEN audio_path LIKE '%|' THEN regexp_extract(audio_path, '(/[^ |]+)', 1) ELSE trim(audio_path) END
    FROM recordings WHERE audio_path IS NOT NULL AND trim(audio_path) <> '') WHERE rec_id IS NOT NULL),
edges AS (SELECT DISTINCT a.rec_id AS x, b.rec_id AS y FROM ties a JOIN ties b ON a.t = b.t AND a.rec_id <> b.rec_id)"""


@query("p1_found", f"""WITH RECURSIVE {TIES},
reach(x, y) AS (SELECT x, y FROM edges UNION SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x)
SELECT min(y) AS group_rec_id, x AS rec_id FROM reach GROUP BY x HAVING min(y) < x""")
def p1_found(spark, d):
    groups = splits.tied_groups(table(spark, d, "recordings"))
    return groups.where("group_rec_id <> rec_id").select("group_rec_id", "rec_id")


@query("p1_splits")
def p1_splits(spark, d):
    return splits.split_segments(table(spark, d, "segments"), table(spark, d, "recordings"))


@query("p1_shares", f"""WITH n AS (SELECT count(*) AS n FROM (SELECT DISTINCT segment_id, recording_id FROM segments WHERE segment_id IS NOT NULL)),
w AS (SELECT split, CASE split WHEN 'train' THEN n - 2 * round(n * {splits.RATIOS['test']!r}::DOUBLE)::BIGINT ELSE round(n * {splits.RATIOS['test']!r}::DOUBLE)::BIGINT END AS segments, target_share, n
  FROM (VALUES ('train', {splits.RATIOS['train']!r}), ('valid', {splits.RATIOS['valid']!r}), ('test', {splits.RATIOS['test']!r})) t(split, target_share), n)
SELECT split, segments, round(segments::DOUBLE / n, 6) AS share, target_share::DOUBLE AS target_share FROM w""")
def p1_shares(spark, d):
    return splits.shares(p1_splits(spark, d))


def _mixed(spark, d):
    documents = table(spark, d, "documents").select("doc_id", "source", "text")
    return mixing.mix(tokens.count(documents).drop("text"), table(spark, d, "mix_targets"))


@query("p8_mix")
def p8_mix(spark, d):
    return _mixed(spark, d)


@query("p8_shares")
def p8_shares(spark, d):
    return mixing.shares(_mixed(spark, d), table(spark, d, "mix_targets"))
