"""Tied groups and splits against a plain union-find and exhaustive subset sums."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from framewright.llm import splits as S


def plain_components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("shape", ["random", "path", "star", "none"])
def test_components(spark, shape):
    rng = random.Random(4)
    edges = {
        "random": [(f"n{rng.randint(0, 80):03d}", f"n{rng.randint(0, 80):03d}") for _ in range(60)],
        "path": [(f"n{i:03d}", f"n{(i * 37) % 101:03d}") for i in range(100)] + [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(40)],
        "star": [("z", f"n{i:03d}") for i in range(60)] * 2,
        "none": [],
    }[shape]
    df = spark.createDataFrame([*edges, (None, "n000")], "a string, b string")
    got = {r.node: r.root for r in S.components(df).collect()}
    assert got == plain_components([e for e in edges if e[0] != e[1]])


def test_groups_of_recordings(spark):
    rows = [
        ("r1", " Spk1", "s1", "/d/a.wav"), ("r2", "spk1 ", None, "sox /d/b.wav -t wav - |"), ("r3", "UNKNOWN", "none", "/d/b.wav"), ("r4", "unk", "", "flac -c -d -s /d/c.flac |"),
        ("r5", None, "S1", "/d/e.wav"), ("r6", "n/a", "s1 ", None), ("r7", "-", None, "  "), ("r7", "-", None, "  "), (None, "spk1", "s1", "/d/a.wav"), ("r8", "?", None, "cat |"), ("r9", "?", None, "cat |"),
    ]
    df = spark.createDataFrame(rows, "rec_id string, speaker_id string, session_id string, audio_path string").withColumn("tie", F.lit(1))
    assert {(r.rec_id, r.group_rec_id) for r in S.tied_groups(df).collect()} == {("r1", "r1"), ("r2", "r1"), ("r3", "r1")}
    assert S.tied_groups(df.where("false")).count() == 0


def test_hot_tie_goes_through_shares(spark):
    df = spark.createDataFrame([(f"r{i:03d}", "t") for i in range(300)], "rec_id string, tie string")
    edges = S.tie_edges(df, salts=8).collect()
    assert len(edges) == 299 or len(edges) < 310
    assert {r.root for r in S.components(S.tie_edges(df, salts=8)).collect()} == {"r000"}


def test_closest_subsets():
    rng = random.Random(6)
    for _ in range(200):
        sizes = {rng.randint(1, 12): rng.randint(1, 3) for _ in range(rng.randint(0, 5))}
        flat = [s for s, n in sizes.items() for _ in range(n)]
        target = rng.randint(0, sum(flat) + 3)
        (got,) = S.choose(sizes, [target])
        assert all(0 < n <= sizes[s] for s, n in got.items())
        best = min(abs(target - sum(c)) for k in range(len(flat) + 1) for c in itertools.combinations(flat, k))
        assert abs(target - sum(s * n for s, n in got.items())) == best


@pytest.mark.parametrize("window", [1, 4, 64, 1 << 16])
def test_any_window_gives_the_closest_total(window):
    """Filling a part of the target first changes nothing about how close it gets."""
    assert sum(s * n for s, n in S.choose({6: 3, 5: 4}, [20], window)[0].items()) == 20
    rng = random.Random(9)
    for _ in range(150):
        sizes = {rng.randint(1, 9) * rng.choice([1, 1, 3]): rng.randint(1, 3) for _ in range(rng.randint(1, 5))}
        flat = [s for s, n in sizes.items() for _ in range(n)]
        target = rng.randint(0, sum(flat) + 3)
        (got,) = S.choose(sizes, [target], window)
        assert all(0 < n <= sizes[s] for s, n in got.items())
        best = min(abs(target - sum(c)) for k in range(len(flat) + 1) for c in itertools.combinations(flat, k))
        assert abs(target - sum(s * n for s, n in got.items())) == best


def test_targets_beyond_the_window():
    (got,) = S.choose({1000: 900, 7: 100, 1: 3}, [500_123], window=5000)
    assert sum(s * n for s, n in got.items()) == 500_122  # 123 can't be made of sevens and three ones
    # The largest components are shared out like the others.
    test, valid = S.choose({5_000_000: 4, 10: 10_000_000}, [30_000_000, 30_000_000])
    assert all(sum(s * n for s, n in p.items()) == 30_000_000 and p.get(5_000_000, 0) <= 2 for p in (test, valid))
    sizes = {s: 2_000_000_000 // s**2 for s in range(1, 20_000)}
    total = sum(s * n for s, n in sizes.items())
    (got,) = S.choose(sizes, [total // 10])
    assert sum(s * n for s, n in got.items()) == total // 10 and total > 1 << 34


def test_many_rounds(spark):
    """A path whose smallest neighbours alternate takes several rounds; all end at one root."""
    n = 600
    order = [f"n{(i * 389) % n:04d}" for i in range(n)]
    df = spark.createDataFrame(list(zip(order, order[1:], strict=False)), "a string, b string")
    got = S.components(df).collect()
    assert len(got) == n and {r.root for r in got} == {"n0000"}


def test_splits_keep_groups_and_shares(spark):
    rng = random.Random(8)
    rec = spark.createDataFrame([(f"r{i}", f"s{i // 3}", None, f"/x/{i}.wav") for i in range(60)], "rec_id string, speaker_id string, session_id string, audio_path string")
    rows = [(f"g{i}", rng.choice(["r0", "r1", f"r{rng.randint(2, 59)}", "absent", None])) for i in range(400)]
    seg = spark.createDataFrame([*rows, rows[0], (None, "r1")], "segment_id string, recording_id string").withColumn("split", F.lit("old"))
    got = S.split_segments(seg, rec)
    table = got.collect()
    assert sorted(r.segment_id for r in table) == sorted(x for x, _ in rows)
    group = {f"r{i}": i // 3 for i in range(60)}
    seen = {}
    for r in table:
        if r.recording_id:
            assert seen.setdefault(group.get(r.recording_id, r.recording_id), r.split) == r.split
    assert {(r.split, r.segments) for r in S.shares(got).collect()} == {("train", 320), ("valid", 40), ("test", 40)}
    assert {(r.segment_id, r.split) for r in S.split_segments(seg.repartition(5), rec).collect()} == {(r.segment_id, r.split) for r in table}
    assert S.split_segments(seg.where("false"), rec).count() == 0 and S.split_segments(seg, rec.where("false")).count() == 400
