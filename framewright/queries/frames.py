"""Queries of interval and frame labels: distortion labels of archived records, segments as interval events."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.catalog import query
from framewright.functions import frames as L
from framewright.plans.tables import table

# Archived records with their sparse labels.
PARSED = """(SELECT file_path, row_idx, num_frames, list_transform(list_filter(str_split(trim(labels_raw, '[]'), ','), lambda x: x LIKE '%:%'),
  lambda x: {'frame_idx': str_split(x, ':')[1]::INT, 'label': str_split(x, ':')[2]::INT}) AS labels FROM shard_rows)"""
KEY = ["file_path", "row_idx"]


def parsed(spark, d):
    return table(spark, d, "shard_rows").select(*KEY, "num_frames", L.parse_labels(F.col("labels_raw")).alias("labels"))


# Segments of a recording as events: the label from the part, times from the recording's start.
LABEL = "CASE part_name WHEN 'noise' THEN 1 WHEN 'rir' THEN 2 WHEN 'interference' THEN 3 WHEN 'packet_loss' THEN 4 WHEN 'missing' THEN 5 ELSE 0 END"
EVENTS = f"""(SELECT segment_id, recording_id, {LABEL} AS label, start_sec AS s, end_sec AS e FROM (SELECT DISTINCT segment_id, recording_id, part_name, start_sec, end_sec FROM segments)
  WHERE recording_id IS NOT NULL AND start_sec >= 0 AND end_sec > start_sec AND NOT isnan(start_sec) AND NOT isnan(end_sec) AND NOT isinf(end_sec))"""
HOP = 1.0


def events(spark, d):
    s = table(spark, d, "segments").select("segment_id", "recording_id", "part_name", "start_sec", "end_sec").distinct()
    ok = "recording_id IS NOT NULL AND start_sec >= 0 AND end_sec > start_sec AND NOT isnan(start_sec) AND NOT isnan(end_sec) AND end_sec < double('inf')"
    return s.where(ok).select("segment_id", "recording_id", F.expr(LABEL).alias("label"), F.col("start_sec").alias("s"), F.col("end_sec").alias("e"))


@query("LBL01_paint", f"""SELECT recording_id, list(label ORDER BY f) AS labels FROM (SELECT r.recording_id, f, coalesce(max(label), 0) AS label FROM
  (SELECT recording_id, unnest(range(0, n)) AS f FROM (SELECT recording_id, max(ceil(round(e / {HOP}, 9)))::BIGINT AS n FROM {EVENTS} GROUP BY recording_id)) r
  LEFT JOIN {EVENTS} v ON v.recording_id = r.recording_id AND ceil(round(s / {HOP}, 9)) <= f AND f < ceil(round(e / {HOP}, 9)) GROUP BY r.recording_id, f) GROUP BY recording_id""")
def paint(spark, d):
    """Per recording: frames are painted from exploded events, so a recording with very many events never meets in one row."""
    e = events(spark, d).select("recording_id", "label", L.to_frame(F.col("s"), HOP).alias("a"), L.to_frame(F.col("e"), HOP).alias("z"))
    painted = e.select("recording_id", "label", F.explode(L.span(F.col("a"), F.col("z"))).alias("f")).groupBy("recording_id", "f").agg(F.max("label").alias("label"))
    n = e.groupBy("recording_id").agg(F.max("z").alias("n"))
    held = painted.groupBy("recording_id").agg(F.collect_list(F.struct(F.col("f").alias("frame_idx"), "label")).alias("m"))
    return n.join(held, "recording_id", "left").select("recording_id", L.dense(F.coalesce("m", F.array().cast("array<struct<frame_idx:int,label:int>>")), F.col("n"), 0).alias("labels"))


@query("LBL01_paint_row", f"""SELECT file_path, row_idx, list_transform(range(0, num_frames), lambda f: coalesce(list_max(list_transform(list_filter(ev, lambda x: x.a <= f AND f < x.z), lambda x: x.label)), 0)) AS painted
  FROM (SELECT file_path, row_idx, num_frames, list_transform(labels, lambda x: {{'label': x.label, 'a': ceil(round(x.frame_idx * 0.5 / 0.5, 9)), 'z': ceil(round((x.frame_idx * 0.5 + 0.75) / 0.5, 9))}}) AS ev FROM {PARSED})""")
def paint_row(spark, d):
    ev = F.transform("labels", lambda x: F.struct(x["label"].alias("label"), (x["frame_idx"] * 0.5).alias("start"), (x["frame_idx"] * 0.5 + 0.75).alias("end")))
    return parsed(spark, d).select(*KEY, L.paint(ev, F.col("num_frames"), 0.5).alias("painted"))


@query("LBL02_frame_count", "SELECT archive_id, CASE WHEN len(audio) = 0 THEN 0 ELSE (len(audio) - 1) // 320 + 1 END::INT AS frames FROM encoder_archive WHERE audio IS NOT NULL")
def frame_count(spark, d):
    return table(spark, d, "encoder_archive").where("audio IS NOT NULL").select("archive_id", L.frame_count(F.size("audio")).alias("frames"))


@query("LBL03_zero_labels", "SELECT file_path, row_idx, list_transform(range(0, num_frames), lambda x: 0) AS labels FROM shard_rows WHERE part_name = 'all_clean'")
def zero_labels(spark, d):
    return table(spark, d, "shard_rows").where("part_name = 'all_clean'").select(*KEY, L.zeros(F.col("num_frames")).alias("labels"))


@query("LBL04_mask_labels", """SELECT archive_id, list_transform(range(0, (len(audio) + 319) // 320), lambda k: CASE WHEN list_contains(list_transform(audio[k * 320 + 1:(k + 1) * 320], lambda x: x = 0), true) THEN 5 ELSE 0 END) AS labels
  FROM encoder_archive WHERE len(audio) > 0""")
def mask_labels(spark, d):
    """A frame is missing (5) if one of its samples was silenced."""
    n = F.ceil(F.size("audio") / 320).cast("int")
    silent = lambda k: F.when(F.exists(F.slice("audio", k * 320 + 1, F.lit(320)), lambda x: x == 0), 5).otherwise(0)
    return table(spark, d, "encoder_archive").where(F.size("audio") > 0).select("archive_id", F.transform(L.span(F.lit(0), n), silent).alias("labels"))


@query("LBL05_first_applied", f"""SELECT file_path, row_idx, list_transform(range(0, num_frames), lambda f: list_reduce(list_concat([0], list_transform(list_filter(labels, lambda x: x.frame_idx <= f AND f < x.frame_idx + 12), lambda x: x.label)),
  lambda acc, x: CASE WHEN acc = 0 OR x IN (4, 5) THEN x ELSE acc END)) AS painted FROM {PARSED}""")
def first_applied(spark, d):
    ev = F.transform("labels", lambda x: F.struct(x["label"].alias("label"), x["frame_idx"].cast("double").alias("start"), (x["frame_idx"] + 12).cast("double").alias("end")))
    return parsed(spark, d).select(*KEY, L.first_applied(ev, F.col("num_frames"), hop=1.0).alias("painted"))


@query("LBL06_dominance", "SELECT segment_id, CASE WHEN snr < 10 THEN 1 ELSE 2 END AS label FROM (SELECT DISTINCT segment_id, (round(start_sec * 1000)::BIGINT % 250) / 10.0::DOUBLE - 5 AS snr FROM segments WHERE start_sec >= 0 AND NOT isnan(start_sec))")
def dominance(spark, d):
    snr = (F.round(F.col("start_sec") * 1000).cast("long") % 250) / 10.0 - 5
    s = table(spark, d, "segments").where("start_sec >= 0 AND NOT isnan(start_sec)").select("segment_id", snr.alias("snr")).distinct()
    return s.select("segment_id", L.dominance(F.col("snr")).alias("label"))


WINDOWS = "list_transform(range(0, (len(predictions) + 3) // 4), lambda k: predictions[k * 4 + 1:k * 4 + 4])"
PREDS = "(SELECT DISTINCT pred_id, predictions FROM predictions WHERE predictions IS NOT NULL)"


def preds(spark, d):
    return table(spark, d, "predictions").where("predictions IS NOT NULL").select("pred_id", "predictions").distinct()


@query("LBL07_downsample", f"""SELECT pred_id, list_transform(w, lambda x: x[1]) AS first, list_transform(w, lambda x: list_max(x)) AS largest,
  list_transform(w, lambda x: -list_max(list_transform(x, lambda y: len(list_filter(x, lambda z: z = y)) * 1000 - y)) + 1000 * list_max(list_transform(x, lambda y: len(list_filter(x, lambda z: z = y)))))::INT[] AS majority FROM (SELECT pred_id, {WINDOWS} AS w FROM {PREDS})""")
def downsample(spark, d):
    p = F.col("predictions")
    return preds(spark, d).select("pred_id", L.downsample(p, 4, "first").alias("first"), L.downsample(p, 4, "max").alias("largest"), L.downsample(p, 4, "majority").alias("majority"))


@query("LBL08_expand_tokens", f"""SELECT file_path, row_idx, flatten(list_transform(range(1, len(labels) + 1), lambda i: list_transform(range(labels[i].frame_idx, CASE WHEN i = len(labels) THEN labels[i].frame_idx + 2 ELSE labels[i + 1].frame_idx END),
  lambda f: f * 10 + labels[i].label))) AS painted FROM {PARSED}""")
def expand_tokens(spark, d):
    n = F.size("labels")
    tokens = F.transform("labels", lambda x, i: F.struct(x["frame_idx"].alias("start"), F.when(i == n - 1, x["frame_idx"] + 1).otherwise(F.get("labels", i + 1)["frame_idx"]).alias("end"), x["label"].alias("label")))
    return parsed(spark, d).select(*KEY, F.transform(L.expand_tokens(tokens), lambda x: (x["frame_idx"] * 10 + x["label"]).cast("long")).alias("painted"))


@query("LBL09_dedup_last", f"""SELECT file_path, row_idx, list_sort(list_filter(list_transform(range(1, len(half) + 1), lambda i: CASE WHEN list_contains(list_transform(half[i + 1:], lambda y: y // 10), half[i] // 10) THEN NULL ELSE half[i] END), lambda x: x IS NOT NULL)) AS kept
  FROM (SELECT file_path, row_idx, list_transform(labels, lambda x: (x.frame_idx // 8) * 10 + x.label) AS half FROM {PARSED})""")
def dedup_last(spark, d):
    half = F.transform("labels", lambda x: F.struct(F.floor(x["frame_idx"] / 8).cast("int").alias("frame_idx"), x["label"].alias("label")))
    return parsed(spark, d).select(*KEY, F.transform(L.dedup_last(half), lambda x: x["frame_idx"] * 10 + x["label"]).alias("kept"))


@query("LBL10_remap", f"""SELECT file_path, row_idx, list_transform(list_filter(labels, lambda x: x.label IN (0, 1)), lambda x: x.frame_idx * 10 + CASE WHEN x.label = 1 THEN 6 ELSE 0 END) AS reformed,
  list_transform(labels, lambda x: x.frame_idx * 10 + CASE x.label WHEN 1 THEN 6 WHEN 3 THEN 7 ELSE x.label END) AS with_rir FROM {PARSED}""")
def remap(spark, d):
    code = lambda c: F.transform(c, lambda x: x["frame_idx"] * 10 + x["label"])
    return parsed(spark, d).select(*KEY, code(L.remap(F.col("labels"), 6)).alias("reformed"), code(L.remap(F.col("labels"), -1, True)).alias("with_rir"))


@query("LBL11_dense", f"SELECT file_path, row_idx, list_transform(range(0, num_frames), lambda f: list_filter(labels, lambda x: x.frame_idx = f)[-1].label) AS dense FROM {PARSED}")
def dense(spark, d):
    return parsed(spark, d).select(*KEY, L.dense(F.col("labels"), F.col("num_frames")).alias("dense"))


@query("LBL12_filter_labels", f"""SELECT pred_id, list_filter(predictions, lambda x: x <> 2) AS no_deletions, list_transform(list_filter(predictions, lambda x: x <> 1), lambda x: CASE WHEN x = 2 THEN 1 ELSE x END) AS frame_level,
  list_transform(predictions, lambda x: CASE WHEN x = 2 THEN 1 ELSE x END) AS word_level FROM {PREDS}""")
def filter_labels(spark, d):
    p = F.col("predictions")
    return preds(spark, d).select("pred_id", L.filter_labels(p, True).alias("no_deletions"), L.filter_labels(p, False, True).alias("frame_level"), L.filter_labels(p, False, True, True).alias("word_level"))


@query("LBL16_run_starts", f"SELECT pred_id, list_filter(hit, lambda i: NOT list_contains(hit, i - 1)) AS starts FROM (SELECT pred_id, list_filter(range(0, len(predictions)), lambda i: predictions[i + 1] > 0)::INT[] AS hit FROM {PREDS})")
def run_starts(spark, d):
    at = F.filter(F.transform("predictions", lambda x, i: F.when(x > 0, i)), lambda x: x.isNotNull())
    return preds(spark, d).select("pred_id", L.run_starts(at).alias("starts"))


@query("LBL18_pad", "SELECT DISTINCT pred_id, list_transform(range(1, num_frames + 1), lambda i: coalesce(predictions[i], 0)) AS padded FROM predictions WHERE predictions IS NOT NULL")
def pad(spark, d):
    p = table(spark, d, "predictions").where("predictions IS NOT NULL").select("pred_id", L.pad_to(F.col("predictions"), F.col("num_frames")).alias("padded"))
    return p.distinct()


@query("LBL27_arg_max", "SELECT vec_id, list_position(embedding, list_max(embedding))::INT - 1 AS cls FROM embeddings")
def arg_max(spark, d):
    return table(spark, d, "embeddings").select("vec_id", L.arg_max(F.col("embedding")).alias("cls"))


@query("FLT01_no_empty_list", "SELECT file_path, row_idx FROM shard_rows WHERE NOT contains(labels_raw, '[]')")
def no_empty_list(spark, d):
    return table(spark, d, "shard_rows").where(~F.contains(F.col("labels_raw"), F.lit("[]"))).select(*KEY)


STARTS = "list_transform(labels, lambda x: (x.frame_idx * 7 + row_idx) % 401)"


@query("FLT02_monotone_starts", f"SELECT file_path, row_idx, len(list_filter(range(2, len(s) + 1), lambda i: s[i] < s[i - 1])) = 0 AS monotone FROM (SELECT file_path, row_idx, {STARTS} AS s FROM {PARSED})")
def monotone_starts(spark, d):
    s = F.transform("labels", lambda x: (x["frame_idx"] * 7 + F.col("row_idx")) % 401)
    return parsed(spark, d).select(*KEY, L.monotone_starts(s).alias("monotone"))


@query("FLT04_length_match", "SELECT pred_id, count(*) AS n FROM predictions WHERE len(predictions) = len(labels) GROUP BY pred_id")
def length_match(spark, d):
    return table(spark, d, "predictions").where(F.size("predictions") == F.size("labels")).groupBy("pred_id").agg(F.count("*").alias("n"))


@query("FLT05_length_retry", f"""SELECT file_path, row_idx, CASE WHEN len(half) = want THEN 'as is' WHEN len(list_distinct(list_transform(half, lambda y: y // 10))) = want THEN 'once per frame' ELSE 'rejected' END AS status
  FROM (SELECT file_path, row_idx, (num_frames % 8) + 1 AS want, list_transform(labels, lambda x: (x.frame_idx // 8) * 10 + x.label) AS half FROM {PARSED})""")
def length_retry(spark, d):
    half = F.transform("labels", lambda x: F.struct(F.floor(x["frame_idx"] / 8).cast("int").alias("frame_idx"), x["label"].alias("label")))
    want = F.col("num_frames") % 8 + 1
    status = F.when(F.size("labels") == want, "as is").when(F.size(L.dedup_last(half)) == want, "once per frame").otherwise("rejected")
    return parsed(spark, d).select(*KEY, status.alias("status"))


@query("FLT06_max_length", "SELECT archive_id FROM encoder_archive WHERE len(audio) <= 0.02 * sample_rate")
def max_length(spark, d):
    return table(spark, d, "encoder_archive").where("audio IS NOT NULL").where(F.size("audio") <= 0.02 * F.col("sample_rate")).select("archive_id")


@query("FLT07_require_labels", "SELECT DISTINCT pred_id, list_transform(list_filter(range(1, len(labels) + 1), lambda i: labels[i] <> 0), lambda i: i - 1) AS kept, list_filter(labels, lambda x: x <> 0) AS values FROM predictions WHERE labels IS NOT NULL")
def require_labels(spark, d):
    """Rows with labels, without the frames that the ignored index (here 0) masks."""
    at = F.filter(F.transform("labels", lambda x, i: F.when(x != 0, i.cast("long"))), lambda x: x.isNotNull())
    return table(spark, d, "predictions").where("labels IS NOT NULL").select("pred_id", at.alias("kept"), F.filter("labels", lambda x: x != 0).alias("values")).distinct()


@query("FLT08_drop_blanks", f"SELECT pred_id, CASE WHEN len(predictions) > 2 THEN list_filter(predictions, lambda x: x <> 0) ELSE predictions END AS emitted FROM {PREDS}")
def drop_blanks(spark, d):
    return preds(spark, d).select("pred_id", F.when(F.size("predictions") > 2, F.filter("predictions", lambda x: x != 0)).otherwise(F.col("predictions")).alias("emitted"))


@query("FLT09_skip_comments", "SELECT doc_id, line FROM (SELECT doc_id, unnest(str_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> '' AND NOT starts_with(trim(line), '[')")
def skip_comments(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.where((F.trim("line") != "") & ~F.startswith(F.trim("line"), F.lit("[")))


@query("FLT10_head", "SELECT archive_id FROM (SELECT DISTINCT archive_id FROM encoder_archive) ORDER BY archive_id LIMIT 100")
def head(spark, d):
    return table(spark, d, "encoder_archive").select("archive_id").distinct().orderBy("archive_id").limit(100)


@query("SNK03_label_text", f"SELECT file_path, row_idx, '[' || array_to_string(list_transform(labels, lambda x: x.frame_idx || ':' || x.label), ',') || ']' AS line FROM {PARSED}")
def label_text(spark, d):
    return parsed(spark, d).select(*KEY, L.label_text(F.col("labels")).alias("line"))


@query("SRC12_labels_sorted", f"SELECT file_path, row_idx, list_transform(list_sort(list_transform(labels, lambda x: x.frame_idx * 1000 + x.label)), lambda x: x % 1000) AS labels FROM {PARSED}")
def labels_sorted(spark, d):
    t = table(spark, d, "shard_rows").select(*KEY, L.parse_labels(F.col("labels_raw"), True).alias("labels"))
    return t.select(*KEY, F.transform("labels", lambda x: x["label"]).alias("labels"))


@query("SRC13_labels_ordered", f"SELECT file_path, row_idx, list_transform(labels, lambda x: x.frame_idx) AS frames, list_transform(labels, lambda x: x.label) AS labels FROM {PARSED}")
def labels_ordered(spark, d):
    return parsed(spark, d).select(*KEY, F.transform("labels", lambda x: x["frame_idx"]).alias("frames"), F.transform("labels", lambda x: x["label"]).alias("labels"))


@query("SNK05_label_names", f"SELECT pred_id, array_to_string(list_transform(predictions, lambda x: coalesce(['clean','noise','rir','interference'][x + 1], 'Class_' || x)), ' ') AS line FROM {PREDS}")
def label_names(spark, d):
    names = F.array(*[F.lit(x) for x in ("clean", "noise", "rir", "interference")])
    return preds(spark, d).select("pred_id", F.array_join(F.transform("predictions", lambda x: F.coalesce(F.get(names, x), F.concat(F.lit("Class_"), x.cast("string")))), " ").alias("line"))


def d_member(name: str, value: str) -> str:
    return f"CASE WHEN {name} IS NOT NULL THEN '\"{name}\":' || {value} END"


D_LINE = "'{' || concat_ws(',', " + ", ".join([d_member("file_id", "to_json(file_id)"), d_member("num_frames", "num_frames"), *[d_member(c, f"'[' || array_to_string({c}, ',') || ']'") for c in ("predictions", "labels")]]) + ") || '}'"


@query("SNK04_prediction_json", f"SELECT {D_LINE} AS line FROM predictions")
def prediction_json(spark, d):
    return table(spark, d, "predictions").select(F.to_json(F.struct("file_id", "num_frames", "predictions", "labels")).alias("line"))
