"""Readers of the text and binary formats, with the lines that can't be read."""

import io
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.operators import distort as S
from framewright.operators import heads as H
from framewright.sources import readers as R
from framewright.sources import writers as W
from framewright.streaming import frames as ST


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def as_dict(df, key):
    return {r[key]: r for r in df.collect()}


def test_scp(spark, tmp_path):
    path = put(tmp_path / "wav.scp", "a /x/a.wav\nb sox b.wav -t wav - |\na /x/new.wav\n\nlonely\n")
    got = as_dict(R.scp(spark, path), "rec_id")
    assert got["a"].audio_path == "/x/new.wav" and got["b"].audio_path == "sox b.wav -t wav - |" and len(got) == 2
    assert as_dict(R.scp(spark, path, "second"), "rec_id")["b"].audio_path == "sox"
    assert set(as_dict(R.scp(spark, path, "exact"), "rec_id")) == {"a"}
    good, bad = R.playable(R.scp(spark, path))
    assert {r.rec_id for r in good.collect()} == {"a"} and [(r.rec_id, r.reason) for r in bad.collect()] == [("b", "shell command")]


def test_segments_and_resources(spark, tmp_path):
    segs = R.segments(spark, put(tmp_path / "segments", "s1 r1 0.5 3.2 extra\ns2 r1 x 1\nshort\ns3 r2 1 2\n"))
    assert {(r.segment_id, r.start_sec) for r in segs.collect()} == {("s1", 0.5), ("s3", 1.0)}
    rec = spark.createDataFrame([("r1", "/a")], "rec_id string, audio_path string")
    assert [r.resource_id for r in R.resources(rec, segs).collect()] == ["s1"] and [r.resource_id for r in R.resources(rec).collect()] == ["r1"]


def test_timestamps(spark, tmp_path):
    text = "u\t[{'char': ['h'], 'start_offset': 0, 'end_offset': 1, 'start': 0.0, 'end': None}]\nv\tnonsense\nno tab\nw\t[{'word': \"it's None, ok\", 'start_offset': 2}]\n"
    got, bad = R.timestamps(spark, put(tmp_path / "t", text))
    rows = as_dict(got, "utt_id")
    assert rows["u"].tokens[0].char == ["h"] and rows["u"].tokens[0].end is None and rows["w"].tokens[0].word == "it's None, ok"
    assert {r.reason for r in bad.collect()} == {"no tab", "no list"}


def test_transcriptions(spark, tmp_path):
    path = put(tmp_path / "text", "u1 hello  world\nu2\nu1\tbye now\n")
    assert {(r.utt_id, tuple(r.words)) for r in R.transcriptions(spark, path).collect()} == {("u1", ("bye", "now")), ("u2", ())}
    assert {(r.utt_id, r.text) for r in R.transcriptions(spark, path, "string", "drop").collect()} == {("u1", "bye now")}
    assert {r.utt_id for r in R.transcriptions(spark, path, "string", "keep", "space").collect()} == {"u1", "u2", "u1\tbye"}


def test_labels_and_json(spark, tmp_path):
    got = R.labels(spark, put(tmp_path / "l", "u\t[5:0,0:1]\nv [3:2]\nbad\n"))
    assert {(r.utt_id, tuple(x.label for x in r.labels)) for r in got.collect()} == {("u", (1, 0)), ("v", (2,))}
    conf = R.confidences(spark, put(tmp_path / "c.json", '{"u": {"word_confidence": [0.5, 1.0]}, "v": {}}'))
    assert [(r.utt_id, r.word_confidence) for r in conf.collect()] == [("u", [0.5, 1.0])]
    pred = R.predictions(spark, put(tmp_path / "p.jsonl", '{"file_id":"u","predictions":[0,1]}\nbroken\n{"file_id":"u","predictions":[1],"num_frames":7}\n'))
    assert [(r.file_id, r.num_frames, r.predictions) for r in pred.collect()] == [("u", 7, [1])]
    assert R.looks_like_json(spark, str(tmp_path / "p.jsonl")) and not R.looks_like_json(spark, put(tmp_path / "x.txt", "u text\n"))


def test_files_are_listed_in_tasks(spark, tmp_path, monkeypatch):
    """The driver knows none of the files, and all of them are read."""
    monkeypatch.setattr(R, "LISTED", 2, raising=False)
    (tmp_path / "below").mkdir()
    for k in range(7):
        np.save(tmp_path / ("below" if k % 3 == 0 else "") / f"{'_' * (k == 4)}n{k}.npy", np.array([k]))
    put(tmp_path / "n9.json", "{}")
    df = R.npy_labels(spark, f"file://{tmp_path}")
    assert df.inputFiles() == []
    assert sorted((r.utt_id.lstrip("_"), r.labels) for r in df.collect()) == [(f"n{k}", [k]) for k in range(7)]
    (tmp_path / "none").mkdir()
    assert R.files(spark, str(tmp_path / "none"), ".wav").count() == 0
    assert [r.content for r in R.files(spark, str(tmp_path / "n9.json"), ".json").collect()] == [b"{}"]


def test_binary(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.array([0, 2]))
    (tmp_path / "b.npy").write_bytes(b"junk")
    assert {(r.utt_id, tuple(r.labels or ())) for r in R.npy_labels(spark, str(tmp_path)).collect()} == {("a", (0, 2)), ("b", ())}
    buf = io.BytesIO()
    with wave.open(buf, "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(np.array([[16384, 0], [-16384, 16384]], "<i2").tobytes())
    (tmp_path / "x.wav").write_bytes(buf.getvalue())
    assert [(r.utt_id, r.samples, r.sample_rate) for r in R.wav_samples(spark, str(tmp_path)).collect()] == [("x", [0.5, -0.5], 8000)]
    assert R.wav_samples(spark, str(tmp_path), "mean").collect()[0].samples == [0.25, 0.0]
    texts = spark.createDataFrame([("x", "a b"), ("y", "a")], "utt_id string, text string")
    assert [r.utt_id for r in R.paired(texts, R.wav_files(spark, str(tmp_path)), 2).collect()] == ["x"]


def test_sinks_and_streams(spark, tmp_path):
    df = spark.createDataFrame([(f"u{i}", [i]) for i in range(7)], "id string, x array<int>")
    back = W.sharded(df, "id", str(tmp_path / "s"), 3, keep=F.col("id") != "u1")
    assert sorted((r.id, r.shard) for r in back.collect()) == [("u0", 0), ("u2", 0), ("u3", 1), ("u4", 1), ("u5", 1), ("u6", 2)]
    W.label_lines(spark.createDataFrame([("u", [(1, 2)])], "id string, l array<struct<frame_idx:int,label:int>>"), "id", "l", str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t")).collect()[0].value == "u\t[1:2]"
    path = str(tmp_path / "ev")
    spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 'a' AS k, 1.5D AS value UNION ALL SELECT timestamp'2024-01-01 00:20:00', 'a', 2D UNION ALL SELECT timestamp'2024-01-02 00:00:00', 'a', 1D").write.parquet(path)
    rows = ST.run_once(ST.tumbling(R.stream(spark, path), "ts", ["k"]), "windows").collect()
    assert [(r.n, r.total) for r in rows] == [(2, 3.5)]


def test_signals():
    x = np.sin(np.arange(400) / 5)
    assert np.allclose(S.convolve(x, np.array([1.0])), x, atol=1e-6)
    y = S.mix_noise(x * 0.1, np.ones(7), 20.0)
    assert np.isclose(S._rms(y - x * 0.1), S._rms(x * 0.1) / 10, rtol=1e-6)
    z = S.mix_by_power(x, np.ones(3), 10.0)
    assert np.isclose(np.mean((z - x) ** 2), np.mean(x**2) / 10)
    assert len(S.resample(x, 16000, 8000)) == 200 and len(S.resample(x[:0], 2, 1)) == 0
    low = np.sin(2 * np.pi * np.arange(400) * 4 / 400)
    assert np.allclose(S.resample(low, 2, 1), low[::2], atol=1e-6)
    up = S.resample(np.cos(np.pi * np.arange(8)), 1, 2)  # the highest frequency of an even length is shared out
    assert np.allclose(up[::2], np.cos(np.pi * np.arange(8))) and np.allclose(up[1::2], 0)
    for kind in ("white", "pink", "brown"):
        assert np.isclose(S._rms(S.synthetic_noise(500, kind, "k")), 1, atol=1e-3)


def test_draws_do_not_depend_on_partitions(spark):
    df = spark.range(40).selectExpr("cast(id AS string) AS segment_id", "3.0 + id AS seconds")
    a, b = ({r.segment_id: (r.events, r.labels) for r in S.simulate(df.repartition(n), ("interference", "multi_dist_rir"), 3).where("program = 'multi_dist_rir'").collect()} for n in (1, 7))
    assert a == b and len(a) == 40


def test_packed_events_never_meet(spark):
    df = spark.range(60).selectExpr("cast(id AS string) AS k", "cast(0.05 + id * 0.7 AS double) AS t")
    kinds = F.array(*[F.lit(x) for x in ("noise", "missing", "packet_loss")])
    n = 0
    for r in df.select("t", S.packed_events(F.col("k"), F.col("t"), kinds, 5).alias("e")).collect():
        e, n = r.e, n + len(r.e)
        assert e == sorted(e, key=lambda x: x.start) and all(0 <= x.start and x.end <= r.t + 1e-9 and x.end - x.start <= 0.3 * r.t + 1e-9 for x in e)
        assert all(x.end + 0.1 <= y.start + 1e-9 for x, y in zip(e, e[1:], strict=False))
    assert n > 100


def test_audio_of_the_programs(spark):
    rng = np.random.default_rng(1)
    rows = [(k, (rng.normal(size=400) * 0.1).tolist()) for k in range(6)] + [(6, []), (7, None), (8, [0.0] * 50)]
    df = spark.createDataFrame(rows, "archive_id long, x array<double>")
    got = {(r.archive_id, r.program): r for r in S.simulate_audio(df, seed=2).collect()}
    assert len(got) == 8 * len(S.PROGRAMS) and all(len(r.y) == len(rows[k][1]) for (k, _), r in got.items())
    assert np.allclose(got[0, "clean"].y, rows[0][1])
    e = got[0, "noise"].events[0]
    x = np.array(rows[0][1])
    added = np.array(got[0, "noise"].y) - x
    assert np.abs(added).max() > 0 and e.type == "noise"
    for e in got[1, "missing"].events:
        assert not any(got[1, "missing"].y[int(e.start * 16000) : int(e.end * 16000)])
    assert S.simulate_audio(df.where("false"), ("noise",)).count() == 0


def test_silence_and_fades(one):
    x = F.array_repeat(F.lit(1.0), 400)
    y = one(S.zero_segment(x, F.lit(0.01), F.lit(0.015)))
    want = np.ones(400)
    want[160:240], want[80:160], want[240:320] = 0, np.linspace(1, 0, 80), np.linspace(0, 1, 80)
    assert np.allclose(y, want)
    want = np.ones(400)
    want[:80], want[-80:] = np.linspace(0, 1, 80), np.linspace(1, 0, 80)
    assert np.allclose(one(S.fade(x)), want)
    z = one(S.drop_packets(F.array_repeat(F.lit(1.0).cast("float"), 100), F.lit(1), 1.0, 32))
    assert z == [0.0] * 96 + [1.0] * 4


def test_heads(spark, one):
    rng = np.random.default_rng(0)
    x, w, b = rng.normal(size=(6, 4)), rng.normal(size=(3, 4)), rng.normal(size=3)
    got = one(H.linear(F.array(*[F.lit(float(v)) for v in x[0]]), w.tolist(), b.tolist()))
    assert np.allclose(got, np.maximum(x[0], 0) @ w.T + b)
    kernel = rng.normal(size=(4, 4, 3))
    one4 = np.ones(4)
    y = H.cnn(x, [(kernel, one4 * 0, one4 * 0, one4, one4, one4 * 0)], w, b)
    padded = np.vstack([np.zeros(4), x, np.zeros(4)])
    conv = np.array([[(padded[t : t + 3] * kernel[o].T).sum() for o in range(4)] for t in range(6)])
    assert np.allclose(y, np.maximum(conv / np.sqrt(1 + 1e-5), 0) @ w.T + b)
    loss = one(H.cross_entropy(F.array(*[F.lit(v) for v in (1.0, 2.0, 3.0)]), F.lit(2)))
    assert loss == pytest.approx(np.log(np.exp([1, 2, 3]).sum()) - 3)


def test_zero_segment_of_every_length(spark, tmp_path):
    import duckdb

    from framewright import catalog

    catalog.load()
    rows = [(i, [0.5 + k % 3 for k in range(n)]) for i, n in enumerate((1, 10, 15, 16, 17, 30, 48, 49, 50, 100, 129, 160, 161, 400))]
    path = str(tmp_path / "encoder_archive.parquet")
    spark.createDataFrame([*rows, (99, []), (100, None)], "archive_id long, audio array<float>").write.parquet(path)
    got = {r.archive_id: r.zeros for r in catalog.QUERIES["DSP09_zero_segment"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW encoder_archive AS SELECT * FROM '{path}/*.parquet'")
    assert got == dict(con.sql(catalog.SQL["DSP09_zero_segment"]).fetchall())
    assert set(got) == {i for i, _ in rows} and got[0] == 0 and got[13] == 34


def test_triples_batches_and_replacement(spark, tmp_path):
    from framewright.operators.joins import padded_batches, rank_shards
    from framewright.sources import writers as W

    rows = [("a/b", [0.5, -1.5, 0.0], 8000, [1, 0], "{}"), ("ü", [1.0], 16000, [], '{"x": 1}')]
    df = spark.createDataFrame(rows, "k string, x array<float>, r int, l array<int>, m string")
    for _ in range(2):  # a task that runs twice does no harm
        path = W.triples(df, "k", "x", "r", "l", "m", f"file://{tmp_path}/t")
    files = sorted(p.name for p in (tmp_path / "t").iterdir())
    assert len(files) == 6 and not any(f.endswith(".part") for f in files)
    got = {r.sample_rate: [round(v * 32768) for v in r.samples] for r in R.wav_samples(spark, path).collect()}
    assert got == {8000: [16384, -32767, 0], 16000: [32767]}
    half = {r.sample_rate for r in R.wav_range(spark, path, F.lit(0.0), F.lit(1.0), 8000).collect()}
    assert half == {8000}
    d = spark.createDataFrame([(k, list(range(k % 5))) for k in range(23)], "k long, v array<int>")
    out = padded_batches(d, "k", "v", 4, -1).collect()
    assert len(out) == 23 and all(len(r.padded) == len(r.mask) and sum(r.mask) == r.k % 5 for r in out)
    assert {r.k: (r.rank, r.place) for r in rank_shards(d.select("k"), "k", 3).collect()} == {k: (k % 3, k // 3) for k in range(23)}
    d.write.parquet(at := f"file://{tmp_path}/d")
    for n in (1, 2):
        old = W.replace(spark, at, lambda x: x.withColumn("k", x.k + 100))
        assert spark.read.parquet(at).agg(F.min("k")).first()[0] == 100 * n and spark.read.parquet(old).agg(F.min("k")).first()[0] == 100 * (n - 1)


def test_a_stream_keeps_all_rows(spark, tmp_path):
    spark.range(500).withColumn("s", F.lit("x")).repartition(7).write.parquet(at := f"file://{tmp_path}/in")
    out = R.streamed(spark, at, f"file://{tmp_path}/out", f"file://{tmp_path}/progress", "id")
    assert sorted(r.id for r in out.collect()) == list(range(500))


def test_confidences_in_several_objects(spark, tmp_path):
    from framewright.sources import writers as W

    df = spark.createDataFrame([(f"u{k:03d}", [0.25 * (k % 4)]) for k in range(95)], "k string, c array<float>")
    W.confidence_files(df, "k", "c", f"file://{tmp_path}/c", 10)
    got = {r.utt_id: r.word_confidence for r in R.confidences(spark, f"file://{tmp_path}/c").collect()}
    assert got == {f"u{k:03d}": [0.25 * (k % 4)] for k in range(95)}
