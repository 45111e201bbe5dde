"""Alignment against a plain table with backtracking, and its invariants."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framewright.operators import align as A

WORDS = st.lists(st.sampled_from("abc"), max_size=9)


def plain(ref, hyp, ties):
    n, m = len(ref), len(hyp)
    cost = [[i + j if not i or not j else 0 for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            cost[i][j] = min(cost[i - 1][j - 1] + (ref[i - 1] != hyp[j - 1]), cost[i - 1][j] + 1, cost[i][j - 1] + 1)
    out, i, j = [], n, m
    while i or j:
        ways = {}
        if i and j and cost[i][j] == cost[i - 1][j - 1] + (ref[i - 1] != hyp[j - 1]):
            ways["m"] = ("C" if ref[i - 1] == hyp[j - 1] else "S", i - 1, j - 1, i - 1, j - 1)
        if i and cost[i][j] == cost[i - 1][j] + 1:
            ways["d"] = ("D", i - 1, -1, i - 1, j)
        if j and cost[i][j] == cost[i][j - 1] + 1:
            ways["i"] = ("I", -1, j - 1, i, j - 1)
        op, a, b, i, j = ways[next(t for t in ties if t in ways)]
        out.append((op, a, b))
    return out[::-1], cost[n][m]


@settings(max_examples=300, deadline=None)
@given(WORDS, WORDS, st.sampled_from(["dim", "mid", "mdi"]))
def test_ops(ref, hyp, ties):
    ops, cost = plain(ref, hyp, ties)
    got = A.edit_ops(ref, hyp, ties)
    assert got == ops
    n = {k: sum(o[0] == k for o in got) for k in "CSDI"}
    assert n["C"] + n["S"] + n["D"] == len(ref) and n["C"] + n["S"] + n["I"] == len(hyp) and n["S"] + n["D"] + n["I"] == cost
    assert [o[1] for o in got if o[1] >= 0] == list(range(len(ref))) and [o[2] for o in got if o[2] >= 0] == list(range(len(hyp)))


def test_empty():
    assert A.edit_ops([], ["a", "b"]) == [("I", -1, 0), ("I", -1, 1)] and A.edit_ops([], []) == []


def test_columns(spark):
    rng = random.Random(3)
    pairs = [([rng.choice("abcd") for _ in range(rng.randint(0, 8))], [rng.choice("abcd") for _ in range(rng.randint(0, 8))]) for _ in range(60)]
    df = spark.createDataFrame([*pairs, (None, ["a"])], "ref array<string>, hyp array<string>").repartition(4)
    got = df.select("ref", "hyp", A.align(F.col("ref"), F.col("hyp"), "mid").alias("ops"), A.distance(F.col("ref"), F.col("hyp")).alias("n")).collect()
    for r in got:
        if r.ref is None:
            assert r.ops is None
        else:
            ops, cost = plain(r.ref, r.hyp, "mid")
            assert [tuple(o) for o in r.ops] == ops and r.n == cost


@pytest.mark.parametrize("ties", ["dim", "mid", "mdi"])
def test_cost_is_the_same_for_all_ties(ties):
    ref, hyp = list("abcabcab"), list("bcaabbc")
    assert sum(o[0] != "C" for o in A.edit_ops(ref, hyp, ties)) == plain(ref, hyp, "mdi")[1]


@pytest.mark.parametrize("ties", ["dim", "mid", "mdi"])
def test_long_pairs_take_the_same_path(ties):
    """With few rows of the table kept the path is the one of the whole table."""
    import random

    rng = random.Random(2)
    for n, m in ((0, 5), (1, 0), (7, 9), (40, 33), (90, 120), (101, 100)):
        a, b = [rng.choice("abc") for _ in range(n)], [rng.choice("abcd") for _ in range(m)]
        assert A.edit_ops(a, b, ties, cells=1) == A.edit_ops(a, b, ties)


def test_many_different_words(one):
    """More words than the basic plane has places for; equal words at the end."""
    words = lambda a, z: F.transform(F.sequence(F.lit(a), F.lit(z)), lambda i: i.cast("string"))
    assert one(A.distance(words(1, 400), words(2, 401))) == 2
    assert one(F.size(F.array_distinct(F.transform(F.sequence(F.lit(30000), F.lit(30020)), lambda i: F.decode(F.unhex(F.lpad(F.hex(F.lit(0x10000) + i), 8, "0")), "UTF-32"))))) == 21
