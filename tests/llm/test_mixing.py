"""Mixtures reach their shares, respect the caps, and don't depend on partitions."""

import random
from collections import defaultdict

import pytest

from framewright.llm import mixing as M


def documents(spark, n=3000):
    rng = random.Random(3)
    rows = [(i, rng.choices(["big", "mid", "small", None], [70, 25, 4, 1])[0], rng.choice([0, 1, 5, 20, 90, 400, None])) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, source string, tokens long")


TARGETS = [("a", "big", 0.5, 1), ("a", "mid", 30.0 / 100, 3), ("a", "small", 0.2, 5), ("b", "small", 1.0, 2), ("b", "absent", 1.0, 4), ("c", "big", 2.0, 1), ("c", "mid", 1.0, 1), ("d", "absent", 1.0, 1), ("c", "small", 0.0, 1), ("c", "big", None, 1)]
SCHEMA = "mix_name string, source string, target_share double, max_repeats int"


def test_shares_and_caps(spark):
    targets = spark.createDataFrame([t for t in TARGETS if t[2] is not None], SCHEMA)
    mixed = M.mix(documents(spark), targets)
    rows = mixed.collect()
    caps = {(m, s): c for m, s, _, c in TARGETS}
    assert all(1 <= r.repeats <= caps[r.mix_name, r.source] for r in rows)
    assert len({(r.mix_name, r.doc_id) for r in rows}) == len(rows)
    total = defaultdict(lambda: defaultdict(int))
    for r in rows:
        total[r.mix_name][r.source] += r.tokens * r.repeats
    for m, wanted in {"a": {"big": 0.5, "mid": 0.3, "small": 0.2}, "b": {"small": 1.0}, "c": {"big": 2 / 3, "mid": 1 / 3}}.items():
        size = sum(total[m].values())
        for s, share in wanted.items():
            assert total[m][s] / size == pytest.approx(share, abs=300 / size + 0.005)
    # The binding source of b gives everything it has, as often as it may.
    assert all(r.repeats == 2 for r in rows if r.mix_name == "b") and "d" not in total
    report = {(r.mix_name, r.source): r for r in M.shares(mixed, targets).collect()}
    assert report["b", "absent"].share == 0 and report["d", "absent"].documents == 0
    again = M.mix(documents(spark).repartition(7), targets)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))


def test_total_and_nothing(spark):
    targets = spark.createDataFrame([TARGETS[1], ("a", "big", 0.7, 1)], SCHEMA)
    rows = M.mix(documents(spark), targets, total=10_000).collect()
    assert abs(sum(r.tokens * r.repeats for r in rows) - 10_000) < 500
    assert M.mix(documents(spark).where("false"), targets).count() == 0
    assert M.mix(documents(spark), targets.where("false")).count() == 0


def test_expected_copies_sum_up_to_the_budget():
    rng = random.Random(1)
    for _ in range(100):
        classes = [(2.0 ** (-c / 2), 1, rng.randint(1, 1000)) for c in range(rng.randint(1, 8))]
        cap = rng.randint(1, 4)
        budget = rng.uniform(0.01, 1) * cap * sum(t for _, _, t in classes)
        copies = M._copies(classes, cap, budget)
        assert sum(k * t for k, (_, _, t) in zip(copies, classes, strict=True)) == pytest.approx(budget)
        assert all(0 <= k <= cap for k in copies)


def test_longer_documents_are_drawn_less_often(spark):
    rows = M.mix(documents(spark), spark.createDataFrame([("m", "big", 0.2, 1), ("m", "mid", 0.8, 1)], SCHEMA)).collect()
    drawn = defaultdict(int)
    for r in rows:
        if r.source == "big":
            drawn[r.tokens] += 1
    assert drawn[5] > 2 * drawn[400] > 0


def test_documents_are_drawn_as_often_as_planned(spark):
    """The sample ends at a size, not at a number of documents; still each size class comes in by its inclusion probability."""
    docs = documents(spark, 6000)
    targets = [("m", "big", 0.35, 1), ("m", "mid", 0.65, 1)]
    rows = M.mix(docs, spark.createDataFrame(targets, SCHEMA)).collect()
    by_class = defaultdict(lambda: [0, 0])
    for r in docs.where("tokens > 0 AND source IS NOT NULL").collect():
        c = by_class[r.source, r.tokens.bit_length() - 1]
        c[0], c[1] = c[0] + 1, c[1] + r.tokens
    drawn = defaultdict(int)
    for r in rows:
        drawn[r.source, r.tokens.bit_length() - 1] += r.repeats
    sizes = [(s, c, n, t) for (s, c), (n, t) in by_class.items()]
    for _, s, c, copies, _, _ in M.plan(sizes, targets):
        n = by_class[s, c][0]
        pi = copies - int(copies + 1e-9)
        assert abs(drawn[s, c] - n * copies) <= 4 * (n * max(pi, 0) * (1 - pi)) ** 0.5 + 3, (s, c, n, copies, drawn[s, c])
