"""Queries of distortion simulation: draws, events, frame labels and changed audio. Draws are MD5 sums, which SQL has as well."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.catalog import query
from framewright.functions import frames as L
from framewright.operators import distort as S
from framewright.operators import joins as J
from framewright.plans.tables import table
from framewright.queries.evaluation import AUDIO, audio
from framewright.queries.joins import D_OFFSETS, with_offsets

TIMED = """(SELECT segment_id AS key, x.e - x.s AS t FROM (SELECT segment_id, min({'s': start_sec, 'e': end_sec}) AS x FROM segments
  WHERE start_sec >= 0 AND end_sec > start_sec AND NOT isnan(end_sec) AND NOT isinf(end_sec) AND segment_id IS NOT NULL GROUP BY segment_id))"""
CENTS = lambda c, n: F.round(c * n).cast("long").cast("string")


def timed(spark, d):
    """Each segment with a duration once: of several the one that starts, then ends, first."""
    s = table(spark, d, "segments").where("start_sec >= 0 AND end_sec > start_sec AND NOT isnan(end_sec) AND end_sec < double('inf') AND segment_id IS NOT NULL")
    s = s.groupBy("segment_id").agg(F.min(F.struct("start_sec", "end_sec")).alias("x"))
    return s.select("segment_id", (F.col("x.end_sec") - F.col("x.start_sec")).alias("seconds"))


def shown(events):
    """Events as text, with times in milliseconds and levels in hundredths, to compare."""
    return F.transform(events, lambda e: F.concat_ws("|", e["type"], e["label"].cast("string"), CENTS(e["start"], 1000), CENTS(e["end"], 1000), CENTS(e["snr_db"], 100)))


def d_draw(*parts) -> str:
    return f"(('0x' || substr(md5(concat_ws(':', {', '.join(map(str, parts))})), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


def d_event(kind: str, label, start: str, end: str, snr: str = "NULL") -> str:
    return f"{{'type': '{kind}', 'label': ({label})::INT, 'start': ({start})::DOUBLE, 'end': ({end})::DOUBLE, 'snr': ({snr})::DOUBLE}}"


def d_triangular(seed: int) -> str:
    u = d_draw(seed, "key", 1)
    return f"(CASE WHEN {u} < 0.5 THEN -5 + 25 * sqrt({u} / 2) ELSE 20 - 25 * sqrt((1 - {u}) / 2) END)"


def d_placed(lo: float, hi: float, most: int, kind: str, seed: int, snr: bool = False, label: int | None = None) -> str:
    n = f"(floor({d_draw(seed, 'key', 0)} * {most})::INT + 1)"
    u = lambda k: d_draw(seed, "key", k, "i")
    dur = f"least({lo}::DOUBLE + {hi - lo}::DOUBLE * {u(1)}, 0.8::DOUBLE * t / {n})"
    at = f"({u(2)} * (t - {dur}))"
    return f"list_transform(range(0, {n}), lambda i: {d_event(kind, S.LABELS[kind] if label is None else label, at, f'{at} + {dur}', f'5.0::DOUBLE + 15.0::DOUBLE * {u(3)}' if snr else 'NULL')})"


KINDS = ("noise", "interference", "packet_loss", "missing")


def d_chosen(seed: int, kinds=KINDS, lo: int = 2, hi: int = 4) -> str:
    order = ", ".join(f"{{'h': {d_draw(seed, 'key', chr(39) + k + chr(39))}, 'kind': '{k}'}}" for k in kinds)
    return f"list_transform(list_sort([{order}])[1:floor({d_draw(seed, 'key', 91)} * {hi - lo + 1})::INT + {lo}], lambda one: one.kind)"


def d_packed(kinds: str, seed: int) -> str:
    dur = f"least(0.3::DOUBLE + 1.7::DOUBLE * {d_draw(seed, 'key', 'k', 'q', chr(39) + 'd' + chr(39))}, 0.3::DOUBLE * t)"
    draw = lambda x: d_draw(seed, "key", "k", "q", f"'{x}'")
    want = f"list_sort(flatten(list_transform({kinds}, lambda k: list_transform(range(0, floor({d_draw(seed, 'key', 'k', chr(39) + 'n' + chr(39))} * 2)::INT + 1), lambda q: {{'m': -{dur}, 'type': k, 'q': q, 'u': {draw('t')}, 's': {draw('s')}}}))))"
    label = "CASE w.type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in S.LABELS.items()) + " END"
    cells = f"list_transform({want}, lambda w: [{{'type': w.type, 'label': ({label})::INT, 'start': w.u, 'end': -w.m, 'snr': CASE WHEN w.type IN ('noise', 'interference') THEN w.s * 25.0::DOUBLE - 5.0::DOUBLE END}}])"
    starts = f"list_transform(range(0, 100), lambda j: ((y[1].start + j * {S.GOLDEN!r}::DOUBLE) % 1.0::DOUBLE) * (t - y[1].end))"
    free = f"list_filter({starts}, lambda a: len(list_filter(acc, lambda e: a + y[1].end + 0.1::DOUBLE > e.start AND a < e.end + 0.1::DOUBLE)) = 0)[1:1]"
    put = f"list_concat(acc, list_transform({free}, lambda a: {{'type': y[1].type, 'label': y[1].label, 'start': a, 'end': a + y[1].end, 'snr': y[1].snr}}))"
    placed = f"list_reduce({cells}, lambda acc, y: CASE WHEN t - y[1].end > 0 THEN {put} ELSE acc END, []::STRUCT(type VARCHAR, label INT, start DOUBLE, \"end\" DOUBLE, snr DOUBLE)[])"
    by_start = f"list_sort(list_transform({placed}, lambda e: {{'start': e.start, 'type': e.type, 'label': e.label, 'end': e.end, 'snr': e.snr}}))"
    return f"list_transform({by_start}, lambda e: {{'type': e.type, 'label': e.label, 'start': e.start, 'end': e.end, 'snr': e.snr}})"


def d_program(name: str, seed: int) -> str:
    """The events of a program for columns key and t."""
    tri = d_triangular(seed)
    if name == "clean":
        return "[]::STRUCT(type VARCHAR, label INT, start DOUBLE, \"end\" DOUBLE, snr DOUBLE)[]"
    if name == "multi_dist_rir":
        label = "CASE WHEN e.type IN ('noise', 'interference') AND e.snr >= 10 THEN 2 ELSE e.label END"
        return f"list_transform({d_packed(d_chosen(seed), seed)}, lambda e: {{'type': e.type, 'label': ({label})::INT, 'start': e.start, 'end': e.end, 'snr': e.snr}})"
    return {
        "noise": lambda: f"[{d_event('noise', 1, '0', 't', tri)}]", "rir": lambda: f"[{d_event('rir', 2, '0', 't')}]",
        "rir_noise": lambda: f"[{d_event('rir_noise', f'CASE WHEN {tri} < 10 THEN 1 ELSE 2 END', '0', 't', tri)}]",
        "interference": lambda: d_placed(1.0, 4.0, 3, "interference", seed, True), "noise_partial": lambda: d_placed(1.0, 4.0, 3, "noise", seed, True),
        "packet_loss": lambda: d_placed(0.2, 1.0, 1, "packet_loss", seed), "missing": lambda: d_placed(0.1, 0.5, 3, "missing", seed),
        "multi_dist_no_rir": lambda: d_packed(d_chosen(seed), seed),
    }[name]()


D_SHOWN = "list_transform(ev, lambda e: concat_ws('|', e.type, e.label, round(e.start * 1000)::BIGINT, round(e.end * 1000)::BIGINT, round(e.snr * 100)::BIGINT))"
D_LABELS = "list_transform(range(0, n), lambda f: coalesce(list_max(list_transform(list_filter(ev, lambda e: ceil(round(e.start / 0.02, 9)) <= f AND f < ceil(round(e.end / 0.02, 9))), lambda e: e.label)), 0))"


def d_events(source: str, name: str, seed: int) -> str:
    return f"(SELECT *, {d_program(name, seed)} AS ev FROM {source})"


def d_simulated(name: str, seed: int) -> str:
    count = "CASE WHEN floor(t * 16000) <= 0 THEN 0 ELSE (floor(t * 16000)::BIGINT - 1) // 320 + 1 END::INT"
    return f"SELECT key AS segment_id, '{name}' AS program, n AS num_frames, {D_SHOWN} AS events, {D_LABELS} AS labels FROM (SELECT *, {count} AS n FROM {d_events(TIMED, name, seed)})"


NAMES = ("clean", "noise", "rir", "rir_noise", "interference", "noise_partial", "packet_loss", "missing", "multi_dist_rir", "multi_dist_no_rir")
POOL = "(SELECT row_number() OVER (ORDER BY archive_id) - 1 AS no, x AS src FROM au WHERE len(list_filter(x, lambda v: v <> 0)) > 0)"
RMS = lambda c: f"sqrt(list_sum(list_transform({c}, lambda v: v * v)) / len({c}) + 1e-12)"


def d_audio(name: str, seed: int) -> str:
    """archive_id, events, labels, and of the changed samples their number, level, zeros and largest."""
    in_room = name in S.IN_A_ROOM
    taps = "list_transform(range(0, 32), lambda k: exp(-6.9078::DOUBLE * k / 32) * cos(k * (room + 1.0::DOUBLE)))"
    direct = "list_transform(range(0, len(x)), lambda i: list_sum(list_transform(range(0, least(i + 1, 32)), lambda k: x[i - k + 1] * h[k + 1])))"
    lost = f"{d_draw(seed, 'key', 'e.i', '(i - e.a) // 32')} < 0.5"
    factor = f"""CASE WHEN e.type = 'packet_loss' AND i >= e.a AND i < e.z THEN CASE WHEN {lost} THEN 0.0::DOUBLE ELSE 1.0 END
      WHEN e.type = 'missing' AND e.z > e.a THEN CASE WHEN i >= e.a AND i < e.z THEN 0.0::DOUBLE WHEN i >= e.a - e.b AND i < e.a THEN 1 - CASE WHEN e.b > 1 THEN (i - (e.a - e.b))::DOUBLE / (e.b - 1) ELSE 0 END
        WHEN i >= e.z AND i < e.z + e.c THEN CASE WHEN e.c > 1 THEN (i - e.z)::DOUBLE / (e.c - 1) ELSE 0 END ELSE 1 END ELSE 1.0 END"""
    return f"""WITH au AS MATERIALIZED (SELECT * FROM {AUDIO}), p AS MATERIALIZED (SELECT * FROM {POOL}),
b AS (SELECT archive_id, archive_id AS key, x, len(x) / 16000.0::DOUBLE AS t, ((len(x) - 1) // 320 + 1)::INT AS n FROM au), e0 AS MATERIALIZED (SELECT * FROM {d_events('b', name, seed)}),
o AS (SELECT archive_id, key, x, i, ev[i + 1] AS e, CASE WHEN ev[i + 1].type IN ('noise', 'interference', 'rir_noise') THEN floor({d_draw(seed, 'key', "'pool'", 'i')} * (SELECT count(*) FROM p))::BIGINT END AS no FROM (SELECT *, unnest(range(0, len(ev))) AS i FROM e0)),
q AS (SELECT *, least(len(x), floor(e.start * 16000))::BIGINT AS a, least(len(x), floor(e.end * 16000))::BIGINT AS z FROM o LEFT JOIN p USING (no)),
r AS (SELECT *, CASE WHEN z > a AND src IS NOT NULL AND e.snr IS NOT NULL THEN list_transform(range(0, z - a), lambda j: src[j % len(src) + 1]) END AS part FROM q),
s AS (SELECT archive_id, list({{'i': i, 'type': e.type, 'a': a, 'z': z, 'b': least(80, a), 'c': least(80, len(x) - z), 'part': part, 'scale': CASE WHEN part IS NOT NULL THEN {RMS('x[a + 1:z]')} / pow(10, e.snr / 20) / {RMS('part')} END}} ORDER BY i) AS es FROM r GROUP BY archive_id),
h AS (SELECT archive_id, key, x, ev, n, coalesce(es, []) AS es, floor({d_draw(seed, 'key', "'room'")} * {S.ROOMS})::INT AS room FROM e0 LEFT JOIN s USING (archive_id)),
g AS (SELECT * REPLACE (list_transform(h, lambda v: v / list_max(list_transform(h, lambda w: abs(w)))) AS h) FROM (SELECT *, {taps} AS h FROM h)),
y1 AS (SELECT archive_id, key, ev, n, es, {"list_transform(y, lambda v: greatest(-1.0::DOUBLE, least(1.0::DOUBLE, v * (" + RMS('x') + " / " + RMS('y') + "))))" if in_room else 'x'} AS y FROM (SELECT *, {direct if in_room else 'x'} AS y FROM g)),
y2 AS (SELECT archive_id, key, ev, n, es, list_transform(range(0, len(y)), lambda i: y[i + 1] + coalesce(list_sum(list_transform(list_filter(es, lambda e: e.part IS NOT NULL AND i >= e.a AND i < e.z), lambda e: e.part[i - e.a + 1] * e.scale)), 0)) AS y FROM y1),
y3 AS (SELECT *, greatest(1.0::DOUBLE, list_max(list_transform(y, lambda v: abs(v)))) AS top FROM y2),
y4 AS (SELECT archive_id, ev, n, list_transform(range(0, len(y)), lambda i: y[i + 1] / top * coalesce(list_product(list_transform(es, lambda e: {factor})), 1)) AS y FROM y3)
SELECT archive_id, '{name}' AS program, {D_SHOWN} AS events, {D_LABELS} AS labels, len(y) AS samples, round({RMS('y')}, 4) AS rms, len(list_filter(y, lambda v: abs(v) < 1e-9)) AS zeros, round(list_max(list_transform(y, lambda v: abs(v))), 4) AS peak FROM y4"""


def register_program(i: int, name: str) -> None:
    @query(f"GEN{i:02d}_{name}", d_simulated(name, 100))
    def run(spark, d):
        return S.simulate(timed(spark, d), (name,), 1).withColumn("events", shown(F.col("events")))

    @query(f"GEN{i:02d}_{name}_audio", d_audio(name, 100))
    def run_audio(spark, d):
        """The changed samples of every archived recording; noise and interference come from the others."""
        out = S.simulate_audio(audio(spark, d), (name,), 1)
        level = F.round(L.rms(F.col("y")), 4)
        return out.select("archive_id", "program", shown(F.col("events")).alias("events"), "labels", F.size("y").cast("long").alias("samples"), level.alias("rms"), F.size(F.filter("y", lambda v: F.abs(v) < 1e-9)).cast("long").alias("zeros"), F.round(L.peak(F.col("y")), 4).alias("peak"))


for _i, _name in enumerate(NAMES, 1):
    register_program(_i, _name)

#: The six programs that are driven in one go, each with its own number.
DRIVEN = ("noise", "rir", "rir_noise", "interference", "packet_loss", "missing")


@query("GEN11_all_programs", "SELECT program, label, count(*) AS frames FROM (" + " UNION ALL ".join(f"SELECT program, unnest(labels) AS label FROM ({d_simulated(n, 100 + i)})" for i, n in enumerate(DRIVEN)) + ") GROUP BY program, label")
def all_programs(spark, d):
    every = S.simulate(timed(spark, d), DRIVEN, 1)
    return every.select("program", F.explode("labels").alias("label")).groupBy("program", "label").agg(F.count("*").alias("frames"))


U = d_draw(1, "key", 0)


@query("DSP02_snr_draws", f"SELECT key AS segment_id, round(-5 + 25 * {U}, 6) AS uniform, round({d_triangular(1)}, 6) AS triangular FROM {TIMED}")
def snr_draws(spark, d):
    k = F.col("segment_id")
    return timed(spark, d).select("segment_id", F.round(S.draw_snr(k, -5, 20, 1), 6).alias("uniform"), F.round(S.draw_snr(k, -5, 20, 1, 1, True), 6).alias("triangular"))


def d_flat(source: str, events: str) -> str:
    return f"SELECT key AS segment_id, e FROM (SELECT key, unnest(list_transform(ev, lambda e: concat_ws('|', e.type, e.label, round(e.start * 1000)::BIGINT, round(e.end * 1000)::BIGINT, round(e.snr * 100)::BIGINT))) AS e FROM (SELECT *, {events} AS ev FROM {source}))"


def flat(spark, d, events):
    return timed(spark, d).select("segment_id", F.explode(shown(events)).alias("e"))


@query("DSP08_packet_loss_event", d_flat(TIMED, d_placed(0.2, 1.0, 1, "packet_loss", 8)))
def packet_loss_event(spark, d):
    """The event only: the codec is outside."""
    return flat(spark, d, S.placed(F.col("segment_id"), F.col("seconds"), 0.2, 1.0, 1, "packet_loss", 8))


@query("DSP17_placement", d_flat(TIMED, d_placed(0.1, 0.5, 3, "missing", 17)))
def placement(spark, d):
    return flat(spark, d, S.placed(F.col("segment_id"), F.col("seconds"), 0.1, 0.5, 3, "missing", 17))


@query("DSP18_packing", d_flat(TIMED, d_packed("['noise', 'interference', 'missing']", 18)))
def packing(spark, d):
    kinds = F.array(*[F.lit(x) for x in ("noise", "interference", "missing")])
    return flat(spark, d, S.packed_events(F.col("segment_id"), F.col("seconds"), kinds, 18))


@query("DSP19_distortion_sets", f"SELECT key AS segment_id, {d_chosen(19)} AS kinds FROM {TIMED}")
def distortion_sets(spark, d):
    return timed(spark, d).select("segment_id", S.chosen_set(F.col("segment_id"), KINDS, 2, 4, 19).alias("kinds"))


@query("DSP06_resource_mix", f"""WITH au AS MATERIALIZED (SELECT * FROM {AUDIO}), p AS MATERIALIZED (SELECT * FROM {POOL}),
m AS (SELECT archive_id, archive_id AS key, x, -5 + 25 * {d_draw(3, 'archive_id', 0)} AS snr, floor({d_draw(6, 'archive_id', 0)} * (SELECT count(*) FROM p))::BIGINT AS no FROM au),
n AS (SELECT *, list_transform(range(0, len(x)), lambda j: src[j % len(src) + 1]) AS part FROM m JOIN p USING (no)),
y AS (SELECT archive_id, no, snr, list_transform(range(1, len(x) + 1), lambda i: x[i] + part[i] * ({RMS('x')} / pow(10, snr / 20) / {RMS('part')})) AS y FROM n)
SELECT archive_id, no, round(snr, 4) AS snr, round({RMS('y')} / greatest(1.0::DOUBLE, list_max(list_transform(y, lambda v: abs(v)))), 4) AS rms FROM y""")
def resource_mix(spark, d):
    """A recording of the pool drawn by hash, joined, and mixed at a drawn level."""
    a = audio(spark, d)
    from framewright.plans.scan import ranked

    sounds = a.where(F.exists("x", lambda v: v != 0)).withColumn("g", F.lit(0))
    pool = ranked(sounds, ["g"], ["archive_id"], "n", "pool").select((F.col("n") - 1).alias("no"), F.col("x").alias("source"))
    size = pool.count()
    drawn = a.withColumns({"no": F.floor(J.uniform(F.col("archive_id"), 6) * size), "snr": S.draw_snr(F.col("archive_id"), -5, 20, 3)}).join(pool, "no")
    y = S.signal(lambda x, n, level: S.mix_noise(x, n, level), F.col("x"), F.col("source"), F.col("snr"))
    return drawn.select("archive_id", "no", F.round("snr", 4).alias("snr"), F.round(L.rms(F.transform(y, lambda v: v.cast("double"))), 4).alias("rms"))


AUGMENTED = f"""(SELECT recog_id, words, list_filter(list_transform(range(1, len(words) + 1), lambda i: {{'u': {d_draw('SEED', 'recog_id', 'i - 1')}, 'start': words[i].start, 'end': words[i].end}}), lambda e: e.u < 0.4) AS hit FROM {D_OFFSETS})"""
BAND = "CASE WHEN e.u < 0.1 THEN 'missing' WHEN e.u < 0.2 THEN 'packet_loss' WHEN e.u < 0.1 + 0.1 + 0.1::DOUBLE THEN 'interference' ELSE 'noise' END"


@query("DSP10_word_augmentation", f"SELECT recog_id, {BAND} AS type, e.start AS start, e.end AS \"end\" FROM (SELECT recog_id, unnest(hit) AS e FROM {AUGMENTED.replace('SEED', '10')})")
def word_augmentation(spark, d):
    w = with_offsets(spark, d)
    return w.select("recog_id", F.explode(S.word_augmentation(F.col("words"), F.col("recog_id"), seed=10)).alias("e")).select("recog_id", "e.*")


CODE = BAND.replace("'missing'", "5").replace("'packet_loss'", "4").replace("'interference'", "3").replace("'noise'", "1")


@query("DSP16_integrated", f"""SELECT recog_id, list_transform(range(0, coalesce(list_max(list_transform(words, lambda w: w.end)), 0)), lambda f: coalesce(list_max(list_transform(list_filter(hit, lambda e: e.start <= f AND f < e.end), lambda e: {CODE})), 0)) AS labels FROM {AUGMENTED.replace('SEED', '16')}""")
def integrated(spark, d):
    """Words' draws become events, and events frame labels."""
    w = with_offsets(spark, d)
    e = S.word_augmentation(F.col("words"), F.col("recog_id"), seed=16)
    code = lambda x: F.when(x["type"] == "missing", 5).when(x["type"] == "packet_loss", 4).when(x["type"] == "interference", 3).otherwise(1)
    ev = F.transform(e, lambda x: F.struct(code(x).alias("label"), x["start"].cast("double").alias("start"), x["end"].cast("double").alias("end")))
    n = F.coalesce(F.array_max(F.transform("words", lambda x: x["end"])), F.lit(0))
    return w.select("recog_id", L.paint(ev, n, 1.0).alias("labels"))


def d_dropped(rate: float, packet: int, seed: int) -> str:
    gone = f"j < len(x) // {packet} AND {d_draw(seed, 'archive_id', 'j')} < {rate}"
    return f"SELECT archive_id, len(list_filter(y, lambda v: v = 0)) AS zeros, round(sqrt(list_sum(list_transform(y, lambda v: v * v)) / len(y) + 1e-12), 4) AS rms FROM (SELECT archive_id, flatten(list_transform(range(0, len(x) // {packet} + 1), lambda j: list_transform(x[j * {packet} + 1:(j + 1) * {packet}], lambda v: CASE WHEN {gone} THEN 0 ELSE v END))) AS y FROM {AUDIO})"


def register_drops(name: str, rate: float, packet: int, seed: int) -> None:
    @query(name, d_dropped(rate, packet, seed))
    def run(spark, d):
        y = S.drop_packets(F.transform("x", lambda v: v.cast("float")), F.col("archive_id"), rate, packet, seed)
        dropped = audio(spark, d).select("archive_id", F.transform(y, lambda v: v.cast("double")).alias("y"))
        return dropped.select("archive_id", F.size(F.filter("y", lambda v: v == 0)).cast("long").alias("zeros"), F.round(L.rms(F.col("y")), 4).alias("rms"))


register_drops("DSP14_packet_drops", 0.3, 32, 14)
register_drops("DSP15_missing_blocks", 0.1, 80, 15)


@query("JON17_random_resource", f"SELECT DISTINCT segment_id, 'noise_' || lpad(floor({d_draw(7, 'segment_id', 0)} * 50)::INT::VARCHAR, 3, '0') AS resource FROM segments")
def random_resource(spark, d):
    return J.assign_resource(table(spark, d, "segments").select("segment_id").distinct(), "segment_id", [f"noise_{k:03d}" for k in range(50)], 7)


@query("ORD04_seeded_shuffle", f"SELECT doc_id, (row_number() OVER (ORDER BY {d_draw(42, 'doc_id')}, doc_id) - 1)::BIGINT AS place FROM documents")
def seeded_shuffle(spark, d):
    """Documents in an order by hash, with their places, which are counted over partitions."""
    from framewright.plans.scan import ranked

    docs = table(spark, d, "documents").select("doc_id", F.lit(0).alias("g"), J.draw(42, F.col("doc_id")).alias("u"))
    return ranked(docs, ["g"], ["u", "doc_id"], "r", "shuffle").select("doc_id", (F.col("r") - 1).alias("place"))
