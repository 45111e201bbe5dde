"""Overlaps between splits against all pairs by full cross-correlation."""

import numpy as np
import pytest

from framewright.llm import crosssplit as C

SCHEMA = "archive_id long, uttid string, audio array<float>, sample_rate int, split_name string, dataset string"


def brute(rows):
    out = set()
    for i, u, x, _, s, _ in rows:
        for j, v, y, _, t, _ in rows:
            if s != "train" or t not in ("valid", "test") or i == j:
                continue
            if u is not None and u == v:
                out.add((min(i, j), max(i, j)))
            elif x and y and any(x) and any(y):
                a, b = np.array(x, np.float64), np.array(y, np.float64)
                if len(a) < C.SHORTEST or len(b) < C.SHORTEST:
                    same = x == y
                else:
                    same = max(C.correlation(a, b, lag) for lag in range(-len(a) + 1, len(b))) >= C.SAME
                if same:
                    out.add((min(i, j), max(i, j)))
    return out


def make(rng):
    f = lambda x: np.asarray(x, np.float32).tolist()
    base = [rng.normal(size=rng.integers(160, 300)) * 0.2 for _ in range(12)]
    rows = [(k, f"t{k}", f(b), 16000, "train", "d") for k, b in enumerate(base)]
    changed = [base[0], base[1] * 0.3, base[2][12:], np.pad(base[3], (9, 4)), base[4] + rng.normal(size=len(base[4])) * 0.04, np.where(np.arange(len(base[5])) // 20 == 3, 0, base[5]), -base[6], base[7][:90], rng.normal(size=200)]
    rows += [(100 + k, f"e{k}", f(x), 8000, "valid" if k % 2 else "test", "d") for k, x in enumerate(changed)]
    rows += [(200, "t3", None, 1, "test", "d"), (201, None, [], 1, "valid", "d"), (202, None, [0.0] * 90, 1, "test", "d"), (203, None, [0.0] * 90, 1, "train", "d"), (204, "t1", f(base[8]), 1, None, "d")]
    rows += [(205, None, [0.5, -0.5], 1, "train", None), (206, None, [0.5, -0.5], 1, "test", None), (207, None, [0.25, -0.25], 1, "test", None), (208, "x", f(np.sin(np.arange(30.0))), 1, "train", "d"), (209, "y", f(2 * np.sin(np.arange(30.0))), 1, "valid", "d")]
    rows += [(300 + k, None, f(base[9]), 1, ("train", "test")[k % 2], "d") for k in range(8)]
    return rows + rows[:3] + rows[12:15]


def test_against_all_pairs(spark):
    rows = make(np.random.default_rng(11))
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = [(r.archive_id_a, r.archive_id_b) for r in C.overlaps(df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    side = {i: s for i, _, _, _, s, _ in rows}
    where = {i: (s, d) for i, _, _, _, s, d in rows if s != "train"}
    partners = [(where[i], i) for pair in got for i in pair if side[i] in ("valid", "test")]
    report = {(r.split_name, r.dataset): (r.pairs, r.eval_rows) for r in C.CrossSplit(df).report().collect()}
    assert report == {k: (sum(w == k for w, _ in partners), len({i for w, i in partners if w == k})) for k, _ in partners}


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert C.overlaps(df).count() == 0 and C.CrossSplit(df).report().count() == 0
    only_eval = spark.createDataFrame([(1, "a", [1.0], 1, "test", "d"), (2, "a", [1.0], 1, "valid", "d")], SCHEMA)
    assert C.overlaps(only_eval).count() == 0


def test_window_maximum():
    x = np.random.default_rng(0).normal(size=200)
    for w in (1, 3, 8):
        want = [x[max(0, i - w) : i + w + 1].max() for i in range(200)]
        inner = slice(w, 200 - w)
        assert np.allclose(C._window_max(x, w)[inner], np.array(want)[inner])


CLASSES = {
    "gain": lambda x, r: x * r.uniform(0.05, 1) * r.choice([-1, 1]),
    "noise": lambda x, r: x + r.normal(size=len(x)) * np.std(x) * 0.25,
    "trim": lambda x, r: x[r.integers(0, 40) : len(x) - r.integers(0, 40)],
    "excerpt": lambda x, r: x[60:140],
    "drop-out": lambda x, r: np.where(np.arange(len(x)) // 30 == r.integers(1, 5), 0, x),
}


def kinds(name, n, rng):
    f = lambda x: np.asarray(x, np.float32).tolist()
    if name in CLASSES:
        base = [np.convolve(rng.normal(size=300), rng.normal(size=3), "same") for _ in range(n)]
        other = [CLASSES[name](x, rng) for x in base]
    elif name == "short":
        base = [rng.normal(size=24 + k % 20) for k in range(n)]
        other = [x * 0.4 + rng.normal(size=len(x)) * 0.01 for x in base]
    else:  # tones, each of another pitch
        t = np.arange(320) / 16000
        base = [np.sin(2 * np.pi * (90 + 37 * k) * t) for k in range(n)]
        other = [0.5 * x[5:] + rng.normal(size=315) * 0.02 for x in base]
    return [(k, None, f(x), 1, "train", name) for k, x in enumerate(base)] + [(1000 + k, None, f(x), 1, "test", name) for k, x in enumerate(other)]


@pytest.mark.parametrize("name", [*CLASSES, "short", "tone"])
def test_recall_by_class(spark, name):
    """Of each kind of processing nearly all copies are found, and nothing that is not alike."""
    rows = kinds(name, 24, np.random.default_rng(5))
    got = {(r.archive_id_a, r.archive_id_b) for r in C.overlaps(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = brute(rows)
    assert got <= want
    # Neighbouring tones are alike by their samples too, without being copies.
    assert len(got & {(k, 1000 + k) for k in range(24)}) >= 0.97 * 24, (name, len(got), len(want))


@pytest.mark.parametrize("bits", [24, 36, 48])
def test_wider_keys(spark, monkeypatch, bits):
    """The width that more rows would give finds the same copies here."""
    rows = make(np.random.default_rng(11))
    monkeypatch.setattr(C, "width", lambda n: bits)
    assert {(r.archive_id_a, r.archive_id_b) for r in C.overlaps(spark.createDataFrame(rows, SCHEMA)).collect()} == brute(rows)


def test_width():
    assert [C.width(n) for n in (0, 1, 1 << 16, 1 << 20, 1 << 36, 1 << 60)] == [24, 24, 24, 28, 44, 48]


def test_hot_families(spark):
    """A waveform of a third of all rows, in copies and with other gains, gives all its pairs."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=200)
    f = lambda x: np.asarray(x, np.float32).tolist()
    rows = [(k, None, f(base * (1 + k % 3)), 1, ("train", "test")[k % 2], "d") for k in range(60)] + [(100 + k, None, f(rng.normal(size=200)), 1, ("train", "valid")[k % 2], "d") for k in range(120)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {(r.archive_id_a, r.archive_id_b) for r in C.overlaps(df).collect()} == {(min(i, j), max(i, j)) for i in range(0, 60, 2) for j in range(1, 60, 2)}


def test_width_whatever_the_rows(spark, monkeypatch):
    """Keys are as wide in a large table as in a small one."""
    asked, real = [], C.width
    monkeypatch.setattr(C, "width", lambda n: asked.append(n) or real(n))
    for n in (1, 3):
        C.CrossSplit(spark.createDataFrame([(k, None, [0.5, -0.5], 1, "train", "d") for k in range(n)], SCHEMA))
    assert asked[0] == asked[1]
