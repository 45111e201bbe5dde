"""Queries of alignment and error rates: reference transcriptions against recognised texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.catalog import query
from framewright.functions import text as T
from framewright.operators import align as A
from framewright.plans.tables import table
from framewright.queries import text as Q


def pairs(spark, d, ref, hyp):
    """recog_id, lang, ref, hyp: each recognised text of an utterance once, with the utterance's transcription."""
    h = table(spark, d, "recog").where("utt_id IS NOT NULL AND text IS NOT NULL").select("recog_id", "utt_id", F.col("text").alias("h")).distinct()
    r = table(spark, d, "transcription").where("utt_id IS NOT NULL AND text IS NOT NULL").select("utt_id", F.coalesce("lang", F.lit("none")).alias("lang"), F.col("text").alias("r")).distinct()
    return h.join(r, "utt_id").select("recog_id", "lang", ref(F.col("r")).alias("ref"), hyp(F.col("h")).alias("hyp"))


def d_pairs(words) -> str:
    return f"""(SELECT recog_id, lang, {words('r')} AS ref, {words('h')} AS hyp FROM
  (SELECT DISTINCT recog_id, utt_id, text AS h FROM recog WHERE utt_id IS NOT NULL AND text IS NOT NULL)
  JOIN (SELECT DISTINCT utt_id, coalesce(lang, 'none') AS lang, text AS r FROM transcription WHERE utt_id IS NOT NULL AND text IS NOT NULL) USING (utt_id))"""


def d_paths(words, ties: str) -> str:
    """recog_id, lang, ref, hyp, path (a letter C, S, D or I per operation) by a recursive query over the rows of the cost table.

    Every cell holds its cost and the operations that led to it, so the path that tie order chooses is there as well."""
    same = "p.ref[t.k + 1] = p.hyp[x[1]]"
    cell = lambda cost, path: f"{{'c': ({cost})::BIGINT, 'p': {path}}}"
    moves = {
        "m": (f"t.cells[x[1]].c + CASE WHEN {same} THEN 0 ELSE 1 END", f"t.cells[x[1]].p || CASE WHEN {same} THEN 'C' ELSE 'S' END"),
        "d": ("t.cells[x[1] + 1].c + 1", "t.cells[x[1] + 1].p || 'D'"),
        "i": ("acc[x[1]].c + 1", "acc[x[1]].p || 'I'"),
    }
    (a, pa), (b, pb), (c, pc) = (moves[x] for x in ties)
    best = f"CASE WHEN {a} <= {b} AND {a} <= {c} THEN {cell(a, pa)} WHEN {b} <= {c} THEN {cell(b, pb)} ELSE {cell(c, pc)} END"
    # The first argument of a reduction must have the type of its result, so columns go as lists of one cell.
    row = f"list_reduce(list_transform(range(1, len(p.hyp) + 1), lambda q: [{cell('q', chr(39) * 2)}]), lambda acc, y: list_append(acc, {best.replace('x[1]', 'y[1].c')}), [{cell('t.cells[1].c + 1', 't.cells[1].p || ' + chr(39) + 'D' + chr(39))}])"
    return f"""(WITH RECURSIVE p AS (SELECT row_number() OVER () AS id, * FROM {d_pairs(words)}),
t(id, k, cells) AS (SELECT id, 0, list_transform(range(0, len(hyp) + 1), lambda q: {cell('q', "repeat('I', q::INT)")}) FROM p
  UNION ALL SELECT t.id, t.k + 1, {row} FROM t JOIN p ON t.id = p.id WHERE t.k < len(p.ref))
SELECT p.recog_id, p.lang, p.ref, p.hyp, t.cells[-1].p AS path FROM t JOIN p ON t.id = p.id AND t.k = len(p.ref))"""


def d_number(op: str) -> str:
    return f"len(path) - len(replace(path, '{op}', ''))"


def d_table(words, ties: str) -> str:
    """recog_id, lang, n, c, s, d, i, path."""
    return f"(SELECT recog_id, lang, len(ref)::BIGINT AS n, {', '.join(f'({d_number(op)})::BIGINT AS {op.lower()}' for op in 'CSDI')}, path FROM {d_paths(words, ties)})"


def d_ops(words, ties: str) -> str:
    """recog_id, lang, ref, hyp, k, op, ref_idx, hyp_idx: a row per operation, indices from 0."""
    before = lambda op: f"len(replace(path[:k], '{op}', '')) - 1"
    return f"(SELECT *, path[k] AS op, {before('I')} AS ref_idx, {before('D')} AS hyp_idx FROM (SELECT *, unnest(range(1, len(path) + 1)) AS k FROM {d_paths(words, ties)}))"


def path(ops):
    return F.array_join(F.transform(ops, lambda o: o["op"]), "")


def wer_words(c):
    return T.token_list(T.words(T.normalize_hypothesis(c)))


def d_wer_words(x: str) -> str:
    return f"list_filter(list_transform({Q.d_words(Q.d_normal(x))}, lambda w: {Q.d_upper(Q.d_unnamed('w'))}), lambda w: w <> '')"


def edge_words(c):
    return F.transform(T.words(c), T.edge_punctuation)


EQUALITY = {
    "ALN01_wer": (wer_words, d_wer_words, A.WER_TIES),
    "ALN02_confidence": (lambda c: T.words(F.lower(c)), lambda x: Q.d_words(f"lower({x})"), A.CONFIDENCE_TIES),
    "ALN03_token_labels": (edge_words, lambda x: f"list_transform({Q.d_words(x)}, lambda w: {Q.d_edge('w')})", A.TOKEN_TIES),
    "ALN04_pairs": (lambda c: F.transform(T.words(c), lambda w: T.full_punctuation(w)), lambda x: f"list_transform({Q.d_words(x)}, lambda w: {Q.d_full('w')})", A.PAIR_TIES),
    "ALN05_word_eval": (lambda c: T.words(T.full_punctuation(c)), lambda x: Q.d_words(Q.d_full(x)), A.WORD_TIES),
}


def counted(spark, d, name: str):
    words, _, ties = EQUALITY[name]
    rows = pairs(spark, d, words, words).withColumn("ops", A.align(F.col("ref"), F.col("hyp"), ties))
    return rows.select("recog_id", "lang", F.size("ref").cast("long").alias("n"), *[c.alias(k) for k, c in A.op_counts(F.col("ops")).items()], path(F.col("ops")).alias("path"))


def register(name: str) -> None:
    _, words, ties = EQUALITY[name]

    @query(name, f"SELECT * FROM {d_table(words, ties)}")
    def run(spark, d):
        return counted(spark, d, name)


for _name in EQUALITY:
    register(_name)

WER_TABLE = d_table(d_wer_words, A.WER_TIES)


@query("AGG01_wer_per_utterance", f"SELECT recog_id, lang, round(CASE WHEN n > 0 THEN (s + d + i) * 100.0::DOUBLE / n ELSE 0 END, 6) AS wer FROM {WER_TABLE}")
def wer_per_utterance(spark, d):
    return counted(spark, d, "ALN01_wer").select("recog_id", "lang", F.round(A.wer(F.expr("s + d + i"), F.col("n")), 6).alias("wer"))


SUMS = "sum(n)::BIGINT AS n, sum(c)::BIGINT AS c, sum(s)::BIGINT AS s, sum(d)::BIGINT AS d, sum(i)::BIGINT AS i"
RATE = "round(CASE WHEN sum(n) > 0 THEN (sum(s) + sum(d) + sum(i)) * 100.0::DOUBLE / sum(n) ELSE 0 END, 6) AS wer"


@query("AGG02_wer_by_lang", f"SELECT lang, {SUMS}, {RATE} FROM {WER_TABLE} GROUP BY lang")
def wer_by_lang(spark, d):
    sums = counted(spark, d, "ALN01_wer").groupBy("lang").agg(*[F.sum(x).alias(x) for x in "ncsdi"])
    return sums.withColumn("wer", F.round(A.wer(F.expr("s + d + i"), F.col("n")), 6))


@query("AGG02_edits_by_lang", f"SELECT lang, sum(s + d + i)::BIGINT AS edits, sum(n)::BIGINT AS n FROM {d_table(EQUALITY['ALN05_word_eval'][1], 'mdi')} GROUP BY lang")
def edits_by_lang(spark, d):
    words = EQUALITY["ALN05_word_eval"][0]
    return pairs(spark, d, words, words).groupBy("lang").agg(F.sum(A.distance(F.col("ref"), F.col("hyp"))).alias("edits"), F.sum(F.size("ref")).alias("n"))


@query("AGG05_op_stats", f"""SELECT sum(c)::BIGINT AS c, sum(s)::BIGINT AS s, sum(d)::BIGINT AS d, sum(i)::BIGINT AS i,
  round(sum(s + d + i)::DOUBLE / sum(c + s + d + i), 6) AS error_rate FROM {d_table(EQUALITY['ALN02_confidence'][1], 'mid')}""")
def op_stats(spark, d):
    return counted(spark, d, "ALN02_confidence").agg(*[F.sum(x).alias(x) for x in "csdi"], F.round(F.expr("sum(s + d + i) / sum(c + s + d + i)"), 6).alias("error_rate"))


def _tokens(spark, d):
    rows = pairs(spark, d, wer_words, wer_words).withColumn("ops", A.align(F.col("ref"), F.col("hyp"), A.WER_TIES))
    return A.token_counters(rows, "ref", "hyp", "ops")


D_TOKENS = f"""(SELECT CASE WHEN op = 'I' THEN hyp[hyp_idx + 1] ELSE ref[ref_idx + 1] END AS token, count(*) FILTER (op <> 'I') AS n_all, count(*) FILTER (op = 'C') AS cor, count(*) FILTER (op = 'S') AS sub,
  count(*) FILTER (op = 'D') AS del, count(*) FILTER (op = 'I') AS ins FROM {d_ops(d_wer_words, A.WER_TIES)} GROUP BY 1)"""


@query("AGG03_token_counters", f"SELECT * FROM {D_TOKENS}")
def token_counters(spark, d):
    return _tokens(spark, d)


@query("AGG04_cluster_wer", f"""SELECT cluster, sum(n_all)::BIGINT AS n_all, sum(cor)::BIGINT AS cor, sum(sub)::BIGINT AS sub, sum(del)::BIGINT AS del, sum(ins)::BIGINT AS ins,
  round(CASE WHEN sum(n_all) > 0 THEN (sum(sub) + sum(del) + sum(ins)) * 100.0::DOUBLE / sum(n_all) ELSE 0 END, 6) AS wer FROM (SELECT {Q.d_cluster('token')} AS cluster, * FROM {D_TOKENS}) GROUP BY cluster""")
def cluster_wer(spark, d):
    by = _tokens(spark, d).groupBy(T.script_cluster(F.col("token")).alias("cluster")).agg(*[F.sum(x).alias(x) for x in ("n_all", "cor", "sub", "del", "ins")])
    return by.withColumn("wer", F.round(A.wer(F.expr("sub + del + ins"), F.col("n_all")), 6))


LABELS = f"(SELECT recog_id, hyp_idx::INT AS hyp_idx, CASE WHEN op = 'C' THEN 0 ELSE 1 END AS label FROM {d_ops(EQUALITY['ALN03_token_labels'][1], A.TOKEN_TIES)} WHERE op <> 'D')"


@query("LBL13_hyp_word_labels", f"SELECT * FROM {LABELS}")
def hyp_word_labels(spark, d):
    words, _, ties = EQUALITY["ALN03_token_labels"]
    ops = pairs(spark, d, words, words).select("recog_id", F.explode(A.align(F.col("ref"), F.col("hyp"), ties)).alias("o"))
    return ops.where("o.op <> 'D'").select("recog_id", F.col("o.hyp_idx").alias("hyp_idx"), F.when(F.col("o.op") == "C", 0).otherwise(1).alias("label"))
