"""Queries of the general data problems: small files, orphan references, intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.catalog import query
from framewright.operators.compaction import Compaction, compaction_plan, reconcile
from framewright.operators.intervals import Intervals, whole_ms
from framewright.operators.references import orphans, per_period, speech_graph
from framewright.plans.tables import table

TARGET_BYTES = 128 << 20
RANKED = """SELECT r.*, row_number() OVER (PARTITION BY segment_id, dataset, part_name, num_frames, labels_raw
    ORDER BY f.written_at NULLS LAST, r.file_path, r.row_idx) AS copy, regexp_extract(r.file_path, '^(/[^/]*/[^/]*/[^/]*)/', 1) AS dir
  FROM shard_rows r LEFT JOIN shard_files f ON r.file_path = f.file_path"""


def _compaction(spark, d):
    return Compaction(table(spark, d, "shard_rows"), compaction_plan(table(spark, d, "shard_files"), TARGET_BYTES))


@query("p2_found", f"SELECT file_path, row_idx FROM ({RANKED}) WHERE copy > 1")
def p2_found(spark, d):
    return _compaction(spark, d).surplus()


@query("p2_plan", f"""SELECT file_path, target_dir, (before // {TARGET_BYTES})::BIGINT AS file_no FROM (
  SELECT file_path, regexp_extract(file_path, '^(/[^/]*/[^/]*/[^/]*)/', 1) AS target_dir,
    sum(n_bytes) OVER (PARTITION BY target_dir ORDER BY file_path ROWS UNBOUNDED PRECEDING)::BIGINT - n_bytes AS before FROM shard_files)""")
def p2_plan(spark, d):
    return compaction_plan(table(spark, d, "shard_files"), TARGET_BYTES).select("file_path", "target_dir", "file_no")


@query("p2_reconciled", f"""SELECT dir AS target_dir, count(*) AS records_in, count(*) FILTER (copy > 1) AS copies, count(*) FILTER (copy = 1) AS records_out, true AS whole
  FROM ({RANKED}) GROUP BY dir""")
def p2_reconciled(spark, d):
    work = _compaction(spark, d)
    return reconcile(work, work.rewrite()).select("target_dir", "records_in", "copies", "records_out", "whole")


SEGMENT_ORPHANS = """SELECT DISTINCT 'segments' AS ref_table, segment_id AS row_key, created_at AS seen_at, 'direct' AS kind FROM segments s
  WHERE recording_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM recordings r WHERE r.rec_id = s.recording_id
    AND r.added_at <= s.created_at AND (r.deleted_at IS NULL OR s.created_at < r.deleted_at))"""
PREDICTION_ORPHANS = """SELECT DISTINCT 'predictions' AS ref_table, pred_id::VARCHAR AS row_key, decoded_at AS seen_at, 'direct' AS kind FROM predictions p
  WHERE file_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM segments s WHERE s.segment_id = p.file_id AND s.created_at <= p.decoded_at)"""
INHERITED = f"""SELECT DISTINCT 'predictions' AS ref_table, pred_id::VARCHAR AS row_key, decoded_at AS seen_at, 'inherited' AS kind FROM predictions p
  WHERE file_id IS NOT NULL AND EXISTS (SELECT 1 FROM segments s WHERE s.segment_id = p.file_id AND s.created_at <= p.decoded_at)
  AND NOT EXISTS (SELECT 1 FROM segments s WHERE s.segment_id = p.file_id AND s.created_at <= p.decoded_at
    AND (s.segment_id, s.created_at) NOT IN (SELECT (row_key, seen_at) FROM ({SEGMENT_ORPHANS})))"""


def _orphans(spark, d):
    return orphans(speech_graph(*(table(spark, d, t) for t in ("recordings", "segments", "predictions"))))


@query("p3_found", f"SELECT DISTINCT ref_table, row_key FROM ({SEGMENT_ORPHANS} UNION ALL {PREDICTION_ORPHANS})")
def p3_found(spark, d):
    return _orphans(spark, d).where("kind = 'direct'").select("ref_table", "row_key").distinct()


@query("p3_report", f"""SELECT ref_table, strftime(seen_at, '%Y-%m') AS period, kind, count(DISTINCT row_key) AS orphans
  FROM ({SEGMENT_ORPHANS} UNION ALL {PREDICTION_ORPHANS} UNION ALL {INHERITED}) GROUP BY ALL""")
def p3_report(spark, d):
    return per_period(_orphans(spark, d))


COVER = """WITH c AS (SELECT recording_id, round(start_sec * 1000)::BIGINT AS s, round(end_sec * 1000)::BIGINT AS e FROM segments
  WHERE recording_id IS NOT NULL AND start_sec IS NOT NULL AND end_sec IS NOT NULL AND NOT isnan(start_sec) AND NOT isnan(end_sec)
    AND round(end_sec * 1000) > round(start_sec * 1000)),
b AS (SELECT *, max(e) OVER (PARTITION BY recording_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c)"""


def _covered(spark, d):
    return Intervals(table(spark, d, "segments"), "recording_id", whole_ms(F.col("start_sec")), whole_ms(F.col("end_sec")))


@query("p5_found", f"{COVER} SELECT recording_id, before AS gap_start_ms, s AS gap_end_ms FROM b WHERE before < s")
def p5_found(spark, d):
    return _covered(spark, d).gaps("gap_start_ms", "gap_end_ms")


@query("p5_periods", f"""{COVER}, i AS (SELECT *, sum(CASE WHEN before IS NULL OR before < s THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id ORDER BY s, e
    ROWS UNBOUNDED PRECEDING) AS island FROM b)
SELECT recording_id, min(s) AS start_ms, max(e) AS end_ms, count(DISTINCT s) AS starts FROM i GROUP BY recording_id, island""")
def p5_periods(spark, d):
    return _covered(spark, d).periods("start_ms", "end_ms", "starts")
