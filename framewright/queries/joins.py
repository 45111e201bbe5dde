"""Queries of joins, sets, orders and shards."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.catalog import query
from framewright.functions import frames as L
from framewright.operators import joins as J
from framewright.operators import tokens as K
from framewright.plans.tables import table
from framewright.queries import text as Q
from framewright.functions import text as T

SEGMENTS = "(SELECT DISTINCT segment_id, recording_id, part_name, start_sec, end_sec, created_at FROM segments)"
RECORDINGS = "(SELECT DISTINCT rec_id, audio_path, dataset FROM recordings WHERE audio_path IS NOT NULL)"


def segments(spark, d):
    return table(spark, d, "segments").select("segment_id", "recording_id", "part_name", "start_sec", "end_sec", "created_at").distinct()


def recordings(spark, d):
    return table(spark, d, "recordings").where("audio_path IS NOT NULL").select("rec_id", "audio_path", "dataset").distinct()


@query("JON01_segment_recording", f"SELECT segment_id, recording_id, audio_path FROM {SEGMENTS} JOIN {RECORDINGS} ON recording_id = rec_id")
def segment_recording(spark, d):
    return segments(spark, d).join(recordings(spark, d), F.col("recording_id") == F.col("rec_id")).select("segment_id", "recording_id", "audio_path")


PRED_SIZE = "(SELECT DISTINCT file_id, pred_id, len(predictions) AS n_p FROM predictions WHERE model_name = 'deletion' AND file_id IS NOT NULL)"
LABEL_SIZE = "(SELECT DISTINCT segment_id, num_frames AS n_l FROM shard_rows)"


@query("JON02_predictions_labels_audit", f"""SELECT CASE WHEN segment_id IS NULL THEN 'left only' WHEN file_id IS NULL THEN 'right only' WHEN n_p <> n_l THEN 'mismatch' ELSE 'both' END AS status, count(*) AS n
  FROM {PRED_SIZE} FULL JOIN {LABEL_SIZE} ON file_id = segment_id GROUP BY 1""")
def predictions_labels(spark, d):
    p = table(spark, d, "predictions").where("model_name = 'deletion' AND file_id IS NOT NULL").select("file_id", "pred_id", F.size("predictions").alias("n_p")).distinct()
    s = table(spark, d, "shard_rows").select(F.col("segment_id").alias("file_id"), F.col("num_frames").alias("n_l")).distinct()
    return J.audit(J.keyed_full_join(p, s, "file_id", F.col("n_p") == F.col("n_l")))


REF = "(SELECT DISTINCT utt_id, text AS r FROM transcription WHERE utt_id IS NOT NULL)"
HYP = "(SELECT DISTINCT utt_id, recog_id, text AS h FROM recog WHERE utt_id IS NOT NULL)"


def ref(spark, d):
    return table(spark, d, "transcription").where("utt_id IS NOT NULL").select("utt_id", F.col("text").alias("r")).distinct()


def hyp(spark, d):
    return table(spark, d, "recog").where("utt_id IS NOT NULL").select("utt_id", "recog_id", F.col("text").alias("h")).distinct()


@query("JON03_hyp_ref_audit", f"SELECT CASE WHEN r.utt_id IS NULL THEN 'left only' WHEN h.utt_id IS NULL THEN 'right only' ELSE 'both' END AS status, count(*) AS n FROM {HYP} h FULL JOIN {REF} r ON h.utt_id = r.utt_id GROUP BY 1")
def hyp_ref(spark, d):
    return J.audit(J.keyed_full_join(hyp(spark, d), ref(spark, d), "utt_id"))


@query("JON04_clean_distorted", """SELECT coalesce(a.base, b.base) AS base, CASE WHEN b.base IS NULL THEN 'left only' WHEN a.base IS NULL THEN 'right only' ELSE 'both' END AS status FROM
  (SELECT DISTINCT segment_id AS base FROM shard_rows WHERE part_name = 'all_clean') a FULL JOIN (SELECT DISTINCT segment_id AS base FROM shard_rows WHERE part_name <> 'all_clean') b ON a.base = b.base""")
def clean_distorted(spark, d):
    s = table(spark, d, "shard_rows")
    side = lambda c: s.where(c).select(F.col("segment_id").alias("base")).distinct()
    return J.keyed_full_join(side("part_name = 'all_clean'"), side("part_name <> 'all_clean'"), "base").select("base", "status")


@query("JON05_three_way", f"SELECT h.utt_id, recog_id, n FROM {HYP} h JOIN {REF} r ON h.utt_id = r.utt_id JOIN (SELECT file_id, count(DISTINCT pred_id) AS n FROM predictions WHERE file_id IS NOT NULL GROUP BY file_id) p ON p.file_id = h.utt_id")
def three_way(spark, d):
    p = table(spark, d, "predictions").where("file_id IS NOT NULL").groupBy(F.col("file_id").alias("utt_id")).agg(F.count_distinct("pred_id").alias("n"))
    return J.inner_all([hyp(spark, d), ref(spark, d), p], "utt_id").select("utt_id", "recog_id", "n")


@query("JON06_four_way", f"""SELECT h.utt_id, recog_id, p.n, s.parts FROM {HYP} h JOIN {REF} r ON h.utt_id = r.utt_id JOIN (SELECT file_id, count(DISTINCT pred_id) AS n FROM predictions WHERE file_id IS NOT NULL GROUP BY file_id) p ON p.file_id = h.utt_id
  LEFT JOIN (SELECT segment_id, count(DISTINCT part_name) AS parts FROM shard_rows GROUP BY segment_id) s ON s.segment_id = h.utt_id""")
def four_way(spark, d):
    p = table(spark, d, "predictions").where("file_id IS NOT NULL").groupBy(F.col("file_id").alias("utt_id")).agg(F.count_distinct("pred_id").alias("n"))
    s = table(spark, d, "shard_rows").groupBy(F.col("segment_id").alias("utt_id")).agg(F.count_distinct("part_name").alias("parts"))
    return J.inner_all([hyp(spark, d), ref(spark, d), p], "utt_id", [s]).select("utt_id", "recog_id", "n", "parts")


@query("JON07_semi_join", "SELECT DISTINCT utt_id FROM recog WHERE utt_id IN (SELECT utt_id FROM transcription)")
def semi_join(spark, d):
    line = table(spark, d, "recog").where("utt_id IS NOT NULL").select(F.concat_ws("\t", "utt_id", F.lit("x")).alias("line"))
    return J.ids_in_lines(line, "line", table(spark, d, "transcription").where("utt_id IS NOT NULL"), "utt_id").select(F.substring_index("line", "\t", 1).alias("utt_id"))


@query("JON07_substring", "SELECT DISTINCT line FROM (SELECT 'a' || utt_id || 'b' AS line FROM recog WHERE utt_id IS NOT NULL) l WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT utt_id FROM transcription WHERE utt_id <> '') t WHERE contains(l.line, t.utt_id))")
def substring_join(spark, d):
    """Ids anywhere in a line, inside of words too."""
    line = table(spark, d, "recog").where("utt_id IS NOT NULL").select(F.concat(F.lit("a"), "utt_id", F.lit("b")).alias("line"))
    return J.ids_in_lines(line, "line", table(spark, d, "transcription"), "utt_id", whole_words=False)


@query("JON08_ref_question", f"SELECT r.utt_id, r, coalesce(q, '') AS q FROM {REF} r LEFT JOIN (SELECT utt_id, min(h) AS q FROM {HYP} GROUP BY utt_id) h ON r.utt_id = h.utt_id WHERE r <> ''")
def ref_question(spark, d):
    q = hyp(spark, d).groupBy("utt_id").agg(F.min("h").alias("q"))
    return ref(spark, d).where("r <> ''").join(q, "utt_id", "left").select("utt_id", "r", F.coalesce("q", F.lit("")).alias("q"))


ARCHIVED = "(SELECT DISTINCT regexp_replace(uttid, '-round[0-9]+$', '') AS base, uttid FROM encoder_archive WHERE uttid IS NOT NULL)"


@query("JON09_question_answer", f"SELECT q.uttid AS question, a.uttid AS answer FROM {ARCHIVED} q JOIN {ARCHIVED} a ON q.base = a.base WHERE q.uttid = q.base AND a.uttid <> a.base")
def question_answer(spark, d):
    u = table(spark, d, "encoder_archive").where("uttid IS NOT NULL").select(T.strip_round(F.col("uttid")).alias("base"), "uttid").distinct()
    q = u.where("uttid = base").select("base", F.col("uttid").alias("question"))
    return q.join(u.where("uttid <> base").select("base", F.col("uttid").alias("answer")), "base").select("question", "answer")


@query("JON09_unanswered", "SELECT DISTINCT utt_id AS answer FROM recog r WHERE utt_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM transcription t WHERE t.utt_id = r.utt_id)")
def unanswered(spark, d):
    """Answers (recognised texts) whose question (transcription) is missing."""
    return hyp(spark, d).select("utt_id").distinct().join(ref(spark, d), "utt_id", "left_anti").select(F.col("utt_id").alias("answer"))


@query("JON12_archive_intersect", "SELECT DISTINCT segment_id AS id FROM segments WHERE segment_id IN (SELECT segment_id FROM shard_rows)")
def archive_intersect(spark, d):
    return segments(spark, d).select(F.col("segment_id").alias("id")).intersect(table(spark, d, "shard_rows").select(F.col("segment_id").alias("id")))


# Words of recognised texts with offsets (a frame a character), and tokens of two characters.


def spoken(spark, d):
    """recog_id, said: each recognised text once, its words parted by one blank. Words have none, so ``offsets`` gets them back."""
    return table(spark, d, "recog").where("text IS NOT NULL").select("recog_id", F.array_join(T.words(F.col("text")), " ").alias("said")).distinct()


def offsets(df):
    """words and tokens with their offsets in place of ``said``: many times its size, so they are made after joins."""
    w = df.withColumn("_w", T.words(F.col("said"))).drop("said")
    start = F.transform("_w", lambda x, i: F.aggregate(F.slice("_w", F.lit(1), i), F.lit(0), lambda a, y: a + F.length(y) + 1))
    words = F.zip_with(start, F.col("_w"), lambda a, x: F.struct(a.alias("start"), (a + F.length(x)).alias("end"), x.alias("word")))
    piece = lambda x: F.transform(L.span(F.lit(0), F.ceil(F.length(x["word"]) / 2).cast("int")), lambda k: F.struct((x["start"] + 2 * k).alias("start"), F.least(x["start"] + 2 * k + 2, x["end"]).alias("end"), F.array(F.substring(x["word"], 2 * k + 1, 2)).alias("char")))
    return w.withColumn("words", words).drop("_w").withColumn("tokens", F.flatten(F.transform("words", piece)))


def with_offsets(spark, d):
    return offsets(spoken(spark, d))


# The same words and tokens in the other dialect, offsets from prefix sums of the lengths.
D_OFFSETS = f"""(SELECT recog_id, words, flatten(list_transform(words, lambda x: list_transform(range(0, (len(x.word) + 1) // 2), lambda k: {{'start': x.start + 2 * k, 'end': least(x.start + 2 * k + 2, x.end), 'char': substr(x.word, 2 * k + 1, 2)}}))) AS tokens
  FROM (SELECT recog_id, list_transform(range(1, len(w) + 1), lambda i: {{'start': (len(array_to_string(w[1:i], ' ')) - len(w[i]))::INT, 'end': len(array_to_string(w[1:i], ' '))::INT, 'word': w[i]}}) AS words
  FROM (SELECT DISTINCT recog_id, {Q.d_words('text')} AS w FROM recog WHERE text IS NOT NULL)))"""
D_SCORES = "list_transform(words, lambda w: greatest(0, least(t.end, w.end) - greatest(t.start, w.start)) + CASE WHEN w.start <= t.start AND t.start <= w.end THEN 10 ELSE 0 END)"
D_BEST = f"list_transform(tokens, lambda t: list_position({D_SCORES}, list_max({D_SCORES}))::INT - 1)"


@query("JON13_best_word", f"SELECT recog_id, {D_BEST} AS word_of_token FROM {D_OFFSETS}")
def best_word(spark, d):
    t = with_offsets(spark, d)
    return t.select("recog_id", K.best_words(F.col("tokens"), F.col("words")).alias("word_of_token"))


@query("JON14_uncovered_frames", """SELECT pred_id, list_filter(range(0, len(predictions)), lambda f: predictions[f + 1] = 1 AND len(list_filter(toks, lambda t: NOT (t + 1 < greatest(0, f - 1) OR t > least(len(predictions), f + 2)))) = 0) AS free
  FROM (SELECT DISTINCT pred_id, predictions, list_transform(range(0, len(predictions) // 7), lambda k: k * 7) AS toks FROM predictions WHERE predictions IS NOT NULL)""")
def uncovered_frames(spark, d):
    p = table(spark, d, "predictions").where("predictions IS NOT NULL").select("pred_id", "predictions").distinct()
    toks = F.transform(L.span(F.lit(0), F.floor(F.size("predictions") / 7).cast("int")), lambda k: F.struct((k * 7).alias("start"), (k * 7 + 1).alias("end")))
    hit = F.filter(F.transform("predictions", lambda x, i: F.when(x == 1, i)), lambda x: x.isNotNull())
    return p.select("pred_id", F.transform(K.uncovered_frames(hit, toks, F.size("predictions"), 1), lambda x: x.cast("long")).alias("free"))


@query("LBL17_deletion_frames", """SELECT pred_id, list_filter(free, lambda f: NOT list_contains(free, f - 1)) AS deletions FROM (SELECT pred_id, list_filter(range(0, len(predictions)), lambda f: predictions[f + 1] = 1 AND len(list_filter(toks, lambda t: NOT (t + 1 < greatest(0, f - 1) OR t > least(len(predictions), f + 2)))) = 0) AS free
  FROM (SELECT DISTINCT pred_id, predictions, list_transform(range(0, len(predictions) // 7), lambda k: k * 7) AS toks FROM predictions WHERE predictions IS NOT NULL))""")
def deletion_frames(spark, d):
    p = table(spark, d, "predictions").where("predictions IS NOT NULL").select("pred_id", "predictions").distinct()
    toks = F.transform(L.span(F.lit(0), F.floor(F.size("predictions") / 7).cast("int")), lambda k: F.struct((k * 7).alias("start"), (k * 7 + 1).alias("end")))
    return p.select("pred_id", F.transform(K.deletion_frames(F.col("predictions"), toks, 1), lambda x: x.cast("long")).alias("deletions"))


@query("JON15_first_word_after", """SELECT file_path, row_idx, list_transform(fr, lambda f: coalesce(list_min(list_filter(range(0, len(st)), lambda i: st[i + 1] > f)), len(st))) AS at
  FROM (SELECT file_path, row_idx, list_transform(x, lambda y: str_split(y, ':')[1]::INT) AS st, list_transform(x, lambda y: str_split(y, ':')[2]::INT * 9) AS fr FROM (SELECT file_path, row_idx, list_filter(str_split(trim(labels_raw, '[]'), ','), lambda z: z LIKE '%:%') AS x FROM shard_rows))""".replace("AS at\n", 'AS "at"\n'))
def first_word_after(spark, d):
    t = table(spark, d, "shard_rows").select("file_path", "row_idx", L.parse_labels(F.col("labels_raw")).alias("x"))
    starts = F.transform("x", lambda y: y["frame_idx"])
    return t.select("file_path", "row_idx", F.transform("x", lambda y: K.first_word_after(y["label"] * 9, starts).cast("long")).alias("at"))


@query("SRC14_last_wins", "SELECT rec_id, audio_path, added_at FROM (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY added_at DESC, coalesce(audio_path, '') DESC) AS r FROM recordings) WHERE r = 1")
def last_wins(spark, d):
    r = table(spark, d, "recordings").select("rec_id", "audio_path", "added_at")
    return J.last_wins(r, "rec_id", [F.col("added_at"), F.coalesce("audio_path", F.lit(""))])


@query("ORD01_sorted_ids", "SELECT DISTINCT utt_id FROM transcription WHERE utt_id IS NOT NULL ORDER BY utt_id")
def sorted_ids(spark, d):
    return table(spark, d, "transcription").where("utt_id IS NOT NULL").select("utt_id").distinct().orderBy("utt_id")


@query("ORD03_indexed", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM documents")
def indexed(spark, d):
    from framewright.plans.scan import ranked

    docs = table(spark, d, "documents").select("doc_id", F.lit(0).alias("g"))
    return ranked(docs, ["g"], ["doc_id"], "r", "index").select("doc_id", (F.col("r") - 1).alias("idx"))


@query("SET01_intersection", "SELECT utt_id FROM transcription WHERE utt_id IS NOT NULL INTERSECT SELECT utt_id FROM recog")
def set_intersection(spark, d):
    return table(spark, d, "transcription").where("utt_id IS NOT NULL").select("utt_id").intersect(table(spark, d, "recog").select("utt_id"))


@query("SET02_union", "SELECT utt_id FROM transcription WHERE utt_id IS NOT NULL UNION SELECT utt_id FROM recog WHERE utt_id IS NOT NULL")
def set_union(spark, d):
    ids = table(spark, d, "transcription").select("utt_id").union(table(spark, d, "recog").select("utt_id"))
    return ids.where("utt_id IS NOT NULL").distinct()


@query("SET03_concatenation", "SELECT 'ref_' || utt_id AS id, text FROM transcription WHERE utt_id IS NOT NULL UNION ALL SELECT 'hyp_' || utt_id AS id, text FROM recog WHERE utt_id IS NOT NULL")
def set_concatenation(spark, d):
    part = lambda n, p: table(spark, d, n).where("utt_id IS NOT NULL").select(T.prefixed(p, F.col("utt_id")).alias("id"), "text")
    return part("transcription", "ref").unionByName(part("recog", "hyp"))


@query("SET04_index_sets", """SELECT pred_id, list_sort(list_distinct(list_filter(predictions, lambda x: NOT list_contains(labels, x)))) AS only_predicted, list_sort(list_intersect(predictions, labels)) AS both
  FROM (SELECT DISTINCT pred_id, predictions, labels FROM predictions WHERE predictions IS NOT NULL AND labels IS NOT NULL)""")
def index_sets(spark, d):
    p = table(spark, d, "predictions").where("predictions IS NOT NULL AND labels IS NOT NULL").select("pred_id", "predictions", "labels").distinct()
    return p.select("pred_id", F.sort_array(F.array_except("predictions", "labels")).alias("only_predicted"), F.sort_array(F.array_intersect("predictions", "labels")).alias("both"))


@query("SET05_split", "SELECT doc_id, CASE WHEN contains(text, '<FINAL>') OR NOT regexp_matches(text, '</?unknown>|<del>|</?unclear>') THEN 'finalized' ELSE 'not_finalized' END AS side FROM documents WHERE text IS NOT NULL")
def set_split(spark, d):
    side = F.when(T.finalized(F.col("text")), "finalized").otherwise("not_finalized")
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", side.alias("side"))


@query("PRT01_fixed_shards", "SELECT uttid, ((row_number() OVER (ORDER BY uttid) - 1) // 100)::INT AS shard, printf('archive_%05d.parquet', (row_number() OVER (ORDER BY uttid) - 1) // 100) AS file_name FROM (SELECT DISTINCT uttid FROM encoder_archive WHERE uttid IS NOT NULL)")
def fixed_shards(spark, d):
    ids = table(spark, d, "encoder_archive").where("uttid IS NOT NULL").select("uttid").distinct()
    return J.fixed_shards(ids, "uttid", 100, "archive")


@query("LBL16_islands", "SELECT segment_id, min(f) AS first, max(f) AS last, count(*) AS length FROM (SELECT segment_id, f, f - row_number() OVER (PARTITION BY segment_id ORDER BY f) AS g FROM (SELECT DISTINCT segment_id, str_split(x, ':')[1]::INT // 5 AS f FROM (SELECT segment_id, unnest(str_split(trim(labels_raw, '[]'), ',')) AS x FROM shard_rows) WHERE x LIKE '%:%')) GROUP BY segment_id, g")
def label_islands(spark, d):
    f = table(spark, d, "shard_rows").select("segment_id", F.explode(L.parse_labels(F.col("labels_raw"))).alias("x"))
    return J.islands(f.select("segment_id", F.floor(F.col("x.frame_idx") / 5).cast("int").alias("f")), ["segment_id"], "f")
