"""Queries of thresholds, confusion counts and scores, over predictions and their labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.catalog import query
from framewright.functions import frames as L
from framewright.operators import metrics as M
from framewright.plans.tables import table

# A prediction's frame labels against its reference labels; num_frames says nothing here. Repeated rows count once.
ROWS = "(SELECT DISTINCT pred_id, model_name, predictions AS p, labels AS t FROM predictions WHERE predictions IS NOT NULL AND labels IS NOT NULL)"
FRAMES = f"(SELECT pred_id, model_name, x.p AS p, x.t AS t FROM (SELECT pred_id, model_name, unnest(list_transform(range(1, least(len(p), len(t)) + 1), lambda i: {{'p': p[i], 't': t[i]}})) AS x FROM {ROWS}))"


def rows(spark, d):
    df = table(spark, d, "predictions").where("predictions IS NOT NULL AND labels IS NOT NULL")
    return df.select("pred_id", "model_name", F.col("predictions").alias("p"), F.col("labels").alias("t")).distinct()


def frames(spark, d):
    n = F.least(F.size("p"), F.size("t"))
    both = F.arrays_zip(F.slice("p", F.lit(1), n).alias("p"), F.slice("t", F.lit(1), n).alias("t"))
    return rows(spark, d).select("pred_id", "model_name", F.explode(both).alias("x")).select("pred_id", "model_name", "x.*")


# Scores: 1 - confidence of each recognised word, as single-precision numbers.
SCORES = "(SELECT part_name, ((frame_no * 31 + num_frames * 17) % 97)::FLOAT / 97::FLOAT AS conf, label > 0 AS bad FROM (SELECT part_name, num_frames, str_split(x, ':')[1]::INT AS frame_no, str_split(x, ':')[2]::INT AS label FROM (SELECT part_name, num_frames, unnest(str_split(trim(labels_raw, '[]'), ',')) AS x FROM shard_rows) WHERE x LIKE '%:%'))"


def scores(spark, d):
    x = table(spark, d, "shard_rows").select("part_name", "num_frames", F.explode(L.parse_labels(F.col("labels_raw"))).alias("x"))
    conf = ((F.col("x.frame_idx") * 31 + F.col("num_frames") * 17) % 97).cast("float") / F.lit(97).cast("float")
    return x.select("part_name", conf.cast("float").alias("conf"), (F.col("x.label") > 0).alias("bad"))


@query("LBL26_error_probability", f"SELECT part_name, count(*) AS n, round(sum((1::FLOAT - conf)::DOUBLE), 4) AS total FROM {SCORES} GROUP BY part_name")
def error_probability(spark, d):
    p = (F.lit(1).cast("float") - F.col("conf")).cast("double")
    return scores(spark, d).groupBy("part_name").agg(F.count("*").alias("n"), F.round(F.sum(p), 4).alias("total"))


FPR = 0.0113
P = "(1::FLOAT - conf)"
LIMIT = f"""(SELECT part_name, p AS threshold, n AS n_correct, k FROM (SELECT part_name, {P} AS p, row_number() OVER (PARTITION BY part_name ORDER BY {P} DESC) AS r,
  count(*) OVER (PARTITION BY part_name) AS n, ceil(count(*) OVER (PARTITION BY part_name) * {FPR}::DOUBLE)::BIGINT AS k FROM {SCORES} WHERE NOT bad) WHERE r = greatest(1, least(k, n)))"""


@query("AGG06_threshold_at_fpr", f"SELECT * FROM {LIMIT}")
def threshold(spark, d):
    df = scores(spark, d).withColumn("p", (F.lit(1).cast("float") - F.col("conf")).cast("float"))
    return M.threshold_at_fpr(df, "p", ~F.col("bad"), FPR, ["part_name"])


COUNTS = "count(*) FILTER (bad AND p >= threshold) AS tp, count(*) FILTER (NOT bad AND p >= threshold) AS fp, count(*) FILTER (bad AND p < threshold) AS fn, count(*) FILTER (NOT bad AND p < threshold) AS tn"
DERIVED = """round(CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END, 6) AS recall,
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp::DOUBLE / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1, round(CASE WHEN fp + tn > 0 THEN fp::DOUBLE / (fp + tn) ELSE 0 END, 6) AS fpr"""


@query("AGG09_recall_at_fpr", f"SELECT *, {DERIVED} FROM (SELECT part_name, threshold, {COUNTS} FROM (SELECT *, {P} AS p FROM {SCORES}) JOIN {LIMIT} USING (part_name) GROUP BY part_name, threshold)")
def recall_at_fpr(spark, d):
    df = scores(spark, d).withColumn("p", (F.lit(1).cast("float") - F.col("conf")).cast("float"))
    return M.recall_at_fpr(df, "p", F.col("bad"), FPR, ["part_name"])


BINARY = f"(SELECT model_name, t > 0 AS bad, p > 0 AS said FROM {FRAMES} WHERE t IS NOT NULL AND p IS NOT NULL)"


@query("AGG07_binary_counts", f"SELECT model_name, count(*) FILTER (bad AND said) AS tp, count(*) FILTER (NOT bad AND said) AS fp, count(*) FILTER (bad AND NOT said) AS fn, count(*) FILTER (NOT bad AND NOT said) AS tn FROM {BINARY} GROUP BY model_name")
def binary_counts(spark, d):
    return frames(spark, d).groupBy("model_name").agg(*[c.alias(k) for k, c in M.binary_counts(F.col("t") > 0, F.col("p") > 0).items()])


@query("AGG08_binary_scores", f"SELECT *, {DERIVED} FROM (SELECT model_name, count(*) FILTER (bad AND said) AS tp, count(*) FILTER (NOT bad AND said) AS fp, count(*) FILTER (bad AND NOT said) AS fn, count(*) FILTER (NOT bad AND NOT said) AS tn FROM {BINARY} GROUP BY model_name)")
def binary_scores(spark, d):
    return M.binary_scores(binary_counts(spark, d))


INDEXED = f"""(SELECT pred_id, list_filter(range(0, len(t)), lambda i: t[i + 1] > 0) AS g, list_filter(range(0, len(p)), lambda i: p[i + 1] > 0) AS q, len(t) AS total FROM {ROWS})"""
SETS = f"(SELECT pred_id, len(list_intersect(g, q))::BIGINT AS tp, len(q)::BIGINT - len(list_intersect(g, q)) AS fp, len(g)::BIGINT - len(list_intersect(g, q)) AS fn, total - len(g) - (len(q)::BIGINT - len(list_intersect(g, q))) AS tn FROM {INDEXED})"


def index_rows(spark, d):
    at = lambda c: F.filter(F.transform(F.col(c), lambda x, i: F.when(x > 0, i)), lambda x: x.isNotNull())
    df = rows(spark, d).select("pred_id", at("t").alias("g"), at("p").alias("q"), F.size("t").alias("total"))
    return df.select("pred_id", *[c.alias(k) for k, c in M.index_metrics(F.col("g"), F.col("q"), F.col("total")).items()])


@query("AGG10_word_metrics", f"SELECT *, {DERIVED} FROM {SETS}")
def word_metrics(spark, d):
    return M.binary_scores(index_rows(spark, d))


@query("AGG13_micro_metrics", f"SELECT *, {DERIVED} FROM (SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(tn)::BIGINT AS tn FROM {SETS})")
def micro_metrics(spark, d):
    return M.binary_scores(index_rows(spark, d).agg(*[F.sum(x).alias(x) for x in ("tp", "fp", "fn", "tn")]))


@query("ORD02_top_200_by_f1", f"SELECT * FROM (SELECT pred_id, tp, fp, fn, {DERIVED.split(' AS fpr')[0].rpartition('round(')[0].rstrip().rstrip(',')} FROM {SETS}) ORDER BY f1 DESC, pred_id LIMIT 200")
def top_200(spark, d):
    df = M.binary_scores(index_rows(spark, d)).select("pred_id", "tp", "fp", "fn", "precision", "recall", "f1")
    return M.top_k(df, [F.desc("f1"), F.asc("pred_id")], 200)


# Distinct (deletion) positions of the original words: a set, so that repeated ones collapse.
@query("AGG11_deletion_metrics", f"""SELECT pred_id, len(list_intersect(g, q))::BIGINT AS tp, len(list_distinct(q))::BIGINT - len(list_intersect(g, q)) AS fp, len(list_distinct(g))::BIGINT - len(list_intersect(g, q)) AS fn
  FROM (SELECT pred_id, list_distinct(list_transform(g, lambda x: x // 2)) AS g, list_distinct(list_transform(q, lambda x: x // 2)) AS q FROM {INDEXED})""")
def deletion_metrics(spark, d):
    at = lambda c: F.filter(F.transform(F.col(c), lambda x, i: F.when(x > 0, F.floor(i / 2))), lambda x: x.isNotNull())
    m = M.index_metrics(at("t"), at("p"), F.size("t"))
    return rows(spark, d).select("pred_id", m["tp"].alias("tp"), m["fp"].alias("fp"), m["fn"].alias("fn"))


# Word errors and, beyond the word count, positions of deletions (here every frame labelled 2 or more) in one set.
@query("AGG12_overall_metrics", f"""SELECT pred_id, len(list_intersect(g, q))::BIGINT AS tp, len(q)::BIGINT - len(list_intersect(g, q)) AS fp, len(g)::BIGINT - len(list_intersect(g, q)) AS fn FROM (
  SELECT pred_id, list_distinct(list_concat(list_filter(range(0, len(t)), lambda i: t[i + 1] = 1), list_transform(list_filter(range(0, len(t)), lambda i: t[i + 1] >= 2), lambda i: i + len(t)))) AS g,
    list_distinct(list_concat(list_filter(range(0, len(p)), lambda i: p[i + 1] = 1), list_transform(list_filter(range(0, len(p)), lambda i: p[i + 1] >= 2), lambda i: i + len(t)))) AS q FROM {ROWS})""")
def overall_metrics(spark, d):
    n = F.size("t")
    words = lambda c: F.filter(F.transform(F.col(c), lambda x, i: F.when(x == 1, i)), lambda x: x.isNotNull())
    gone = lambda c: F.filter(F.transform(F.col(c), lambda x, i: F.when(x >= 2, i + n)), lambda x: x.isNotNull())
    m = M.index_metrics(F.array_union(words("t"), gone("t")), F.array_union(words("p"), gone("p")), n)
    return rows(spark, d).select("pred_id", m["tp"].alias("tp"), m["fp"].alias("fp"), m["fn"].alias("fn"))


K = 6
CLASSES = f"""(SELECT label, coalesce(tp, 0) AS tp, coalesce(predicted, 0) AS predicted, coalesce(support, 0) AS support FROM (SELECT unnest(range(0, {K}))::INT AS label)
  LEFT JOIN (SELECT t AS label, count(*) FILTER (t = p) AS tp, count(*) AS support FROM {FRAMES} WHERE p IS NOT NULL AND t IS NOT NULL GROUP BY t) USING (label)
  LEFT JOIN (SELECT p AS label, count(*) AS predicted FROM {FRAMES} WHERE p IS NOT NULL AND t IS NOT NULL GROUP BY p) USING (label))"""
PRF = """CASE WHEN predicted > 0 THEN tp::DOUBLE / predicted ELSE 0 END AS p, CASE WHEN support > 0 THEN tp::DOUBLE / support ELSE 0 END AS r,
  CASE WHEN predicted + support > 0 THEN 2 * tp::DOUBLE / (predicted + support) ELSE 0 END AS f"""


@query("AGG15_class_scores", f"SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, support FROM (SELECT *, {PRF} FROM {CLASSES})")
def class_scores(spark, d):
    return M.class_scores(M.class_counts(frames(spark, d), "t", "p", K))


@query("AGG14_weighted_scores", f"""SELECT round(sum(tp)::DOUBLE / sum(support), 6) AS accuracy, round(sum(p * support) / sum(support), 6) AS precision, round(sum(r * support) / sum(support), 6) AS recall,
  round(sum(f * support) / sum(support), 6) AS f1, sum(support)::BIGINT AS frames FROM (SELECT *, {PRF} FROM {CLASSES})""")
def weighted_scores(spark, d):
    return M.weighted_scores(M.class_counts(frames(spark, d), "t", "p", K))


@query("AGG16_confusion_matrix", f"""SELECT actual, {', '.join(f'coalesce(p{k}, 0) AS p{k}' for k in range(K))} FROM (SELECT unnest(range(0, {K}))::INT AS actual) LEFT JOIN
  (SELECT t AS actual, {', '.join(f'count(*) FILTER (p = {k}) AS p{k}' for k in range(K))} FROM {FRAMES} WHERE p BETWEEN 0 AND {K - 1} GROUP BY t) USING (actual)""")
def confusion_matrix(spark, d):
    return M.confusion_matrix(frames(spark, d), "t", "p", K)


@query("AGG17_gathered_metrics", f"""SELECT model_name, count(DISTINCT pred_id) AS predictions, count(*) AS frames, count(*) FILTER (p = t) AS correct, round(count(*) FILTER (p = t)::DOUBLE / count(*), 6) AS accuracy,
  count(*) FILTER (t > 0 AND p > 0) AS tp, count(*) FILTER (t <= 0 AND p > 0) AS fp, count(*) FILTER (t > 0 AND p <= 0) AS fn FROM {FRAMES} WHERE p IS NOT NULL AND t IS NOT NULL GROUP BY model_name""")
def gathered_metrics(spark, d):
    """The metrics of all partitions in one aggregate: partial counts are what is gathered."""
    f = frames(spark, d).where("p IS NOT NULL AND t IS NOT NULL")
    right = F.count_if(F.col("p") == F.col("t"))
    n = f.groupBy("model_name").agg(F.count_distinct("pred_id").alias("predictions"), F.count("*").alias("frames"), right.alias("correct"), *[c.alias(k) for k, c in M.binary_counts(F.col("t") > 0, F.col("p") > 0).items()])
    return n.withColumn("accuracy", F.round(F.col("correct") / F.col("frames"), 6)).drop("tn")


@query("AGG18_majority_label", f"SELECT pred_id, t AS label FROM (SELECT pred_id, t, row_number() OVER (PARTITION BY pred_id ORDER BY count(*) DESC, t) AS r FROM {FRAMES} WHERE t IS NOT NULL GROUP BY pred_id, t) WHERE r = 1")
def majority_label(spark, d):
    df = frames(spark, d).where("t IS NOT NULL").select("pred_id", F.col("t").alias("label"))
    return M.majority(df, ["pred_id"], "label")


@query("AGG19_majority_error", f"SELECT pred_id, CASE WHEN list_sum(list_transform(p, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END)) > len(p) // 2 THEN 1 ELSE 0 END AS error FROM {ROWS}")
def majority_error(spark, d):
    return rows(spark, d).select("pred_id", L.majority_error(F.transform("p", lambda x: F.when(x > 0, 1).otherwise(0))).alias("error"))


@query("AGG20_any_error", f"SELECT pred_id, CASE WHEN list_contains(p, 1) THEN 1 ELSE 0 END AS error FROM {ROWS}")
def any_error(spark, d):
    return rows(spark, d).select("pred_id", L.any_error(F.col("p")).alias("error"))


@query("AGG21_merge_max", f"SELECT pred_id, list_transform(range(1, least(len(p), len(t)) + 1), lambda i: greatest(p[i], t[i])) AS merged FROM {ROWS}")
def merge_max(spark, d):
    return rows(spark, d).select("pred_id", L.merge_max(F.col("p"), F.col("t")).alias("merged"))


# Judge replies carry a rating as their last word.
JUDGED = """(SELECT doc_id, coalesce(try_cast(w[-1] AS DOUBLE), 0.0) AS score, CASE WHEN try_cast(w[-1] AS DOUBLE) IS NOT NULL THEN 1 ELSE 0 END AS ok FROM (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{blank}+'), lambda x: x <> '') AS w FROM documents WHERE source = 'judge_reply'))"""
from framewright.functions import text as T  # noqa: E402

JUDGED = JUDGED.replace("{blank}", T.BLANK)


def judged(spark, d):
    df = table(spark, d, "documents").where("source = 'judge_reply'").withColumn("text", F.coalesce("text", F.lit("")))
    return df.select("doc_id", T.rating(F.col("text")).alias("score"), T.rated(F.col("text")).cast("int").alias("ok"))


@query("AGG22_judge_score", f"SELECT count(*) AS n, round(avg(score) * 20, 6) AS scale_score, round(avg(CASE WHEN score >= 3 THEN 1 ELSE 0 END) * 100, 6) AS binary_score, round(avg(ok) * 100, 6) AS success FROM {JUDGED}")
def judge_score(spark, d):
    good = F.when(F.col("score") >= 3, 1).otherwise(0)
    return judged(spark, d).agg(F.count("*").alias("n"), F.round(F.avg("score") * 20, 6).alias("scale_score"), F.round(F.avg(good) * 100, 6).alias("binary_score"), F.round(F.avg("ok") * 100, 6).alias("success"))


@query("AGG23_corpus_counters", "SELECT CASE WHEN labels IS NULL THEN 'no labels' WHEN len(predictions) <> num_frames THEN 'length' ELSE 'kept' END AS status, count(*) AS n FROM predictions GROUP BY 1")
def corpus_counters(spark, d):
    status = F.when(F.col("labels").isNull(), "no labels").when(F.size("predictions") != F.col("num_frames"), "length").otherwise("kept")
    return table(spark, d, "predictions").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("AGG24_rms_peak", "SELECT archive_id, round(sqrt(list_sum(list_transform(audio, lambda x: x::DOUBLE * x::DOUBLE)) / len(audio) + 1e-12), 6) AS rms, round(list_max(list_transform(audio, lambda x: abs(x)))::DOUBLE, 6) AS peak FROM encoder_archive WHERE len(audio) > 0")
def rms_peak(spark, d):
    x = F.transform("audio", lambda v: v.cast("double"))
    return table(spark, d, "encoder_archive").where(F.size("audio") > 0).select("archive_id", F.round(L.rms(x), 6).alias("rms"), F.round(L.peak(x), 6).alias("peak"))
