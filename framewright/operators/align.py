"""Alignment of a reference and a hypothesis word list with exact tie-breaking, and error rates from it.

Five aligners share unit costs and differ in which words are equal and which of several cheapest moves is taken. The moves
are read back from the end, each cell choosing the first cheapest one in ``ties`` (d: deletion, i: insertion, m: match or
substitution). Costs are filled a row at a time in NumPy; the words are coded as integers first.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPS = "array<struct<op:string,ref_idx:int,hyp_idx:int>>"
WER_TIES, CONFIDENCE_TIES, TOKEN_TIES, PAIR_TIES, WORD_TIES = "dim", "mid", "mid", "mdi", "mdi"


CELLS = 1 << 22  # of the cost table that are kept at once; beyond, rows are kept at intervals and those between made again


def edit_ops(ref: list[str], hyp: list[str], ties: str = "mdi", cells: int = CELLS) -> list[tuple[str, int, int]]:
    """(op, ref_idx, hyp_idx) in order: C equal, S other, D only in ref, I only in hyp; -1 where there is no index.

    Of a long pair every k-th row of the table is kept, k the square root of the rows, and the rows between are made again on
    the way back: the same path in memory that grows with the root of the table.
    """
    codes: dict[str, int] = {}
    r = np.fromiter((codes.setdefault(w, len(codes)) for w in ref), np.int64, len(ref))
    h = np.fromiter((codes.setdefault(w, len(codes)) for w in hyp), np.int64, len(hyp))
    n, m = len(r), len(h)
    along = np.arange(m + 1, dtype=np.int32)
    step = n + 1 if (n + 1) * (m + 1) <= cells else isqrt(n) + 1

    def after(i: int, above: np.ndarray) -> np.ndarray:
        row = np.empty(m + 1, np.int32)
        row[0] = i
        np.minimum(above[:-1] + (h != r[i - 1]), above[1:] + 1, out=row[1:])
        return np.minimum.accumulate(row - along) + along

    kept, row = {0: along}, along
    if step <= n:
        for i in range(1, n + 1):
            row = after(i, row)
            if i % step == 0:
                kept[i] = row
    out: list[tuple[str, int, int]] = []
    i, j = n, m
    base = n // step * step
    cost = [kept[base]]
    while len(cost) <= n - base:
        cost.append(after(base + len(cost), cost[-1]))
    while i or j:
        if i == base and i:  # the rows above
            base -= step
            cost = [kept[base]]
            while len(cost) <= step:
                cost.append(after(base + len(cost), cost[-1]))
        here, above = cost[i - base], cost[i - base - 1] if i else None
        now = here[j]
        for move in ties:
            if move == "m" and i and j and above[j - 1] + (r[i - 1] != h[j - 1]) == now:
                i, j = i - 1, j - 1
                out.append(("C" if r[i] == h[j] else "S", i, j))
                break
            if move == "d" and i and above[j] + 1 == now:
                i -= 1
                out.append(("D", i, -1))
                break
            if move == "i" and j and here[j - 1] + 1 == now:
                j -= 1
                out.append(("I", -1, j))
                break
    return out[::-1]


def align(ref: Column, hyp: Column, ties: str = "mdi") -> Column:
    """Two string arrays -> the operations that turn one into the other. Null if either is null."""

    @F.pandas_udf(OPS)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for rs, hs in batches:
            yield pd.Series([None if r is None or h is None else [{"op": o, "ref_idx": a, "hyp_idx": b} for o, a, b in edit_ops(list(r), list(h), ties)] for r, h in zip(rs, hs, strict=True)], dtype=object)

    return run(ref, hyp)


def op_counts(ops: Column) -> dict[str, Column]:
    n = lambda op: F.size(F.filter(ops, lambda x: x["op"] == op)).cast("long")
    return {"c": n("C"), "s": n("S"), "d": n("D"), "i": n("I")}


def distance(ref: Column, hyp: Column) -> Column:
    """Number of edits between two word arrays, in the JVM: words become code points beyond the basic plane, then levenshtein.

    There are a million of them; a pair with more different words, whose table nothing could hold, has a null distance.
    """
    from framewright.functions.frames import let

    def edits(voc: Column) -> Column:
        sign = lambda w: F.decode(F.unhex(F.lpad(F.hex(F.lit(0x10000) + F.array_position(voc, w)), 8, "0")), "UTF-32")
        coded = lambda a: F.array_join(F.transform(a, sign), "")
        return F.when(F.size(voc) < (1 << 20) - 2, F.levenshtein(coded(ref), coded(hyp)))

    return let(F.array_distinct(F.concat(ref, hyp)), edits)


def wer(errors: Column, n: Column) -> Column:
    return F.when(n > 0, errors * 100.0 / n).otherwise(0.0)


def token_counters(df: DataFrame, ref: str, hyp: str, ops: str, by: list[str] | None = None) -> DataFrame:
    """token, n_all, cor, sub, del, ins: all but ins count reference tokens, ins hypothesis tokens."""
    by = by or []
    one = df.select(*by, F.col(ref).alias("_r"), F.col(hyp).alias("_h"), F.explode(ops).alias("o"))
    tok = F.when(F.col("o.op") == "I", F.get("_h", F.col("o.hyp_idx"))).otherwise(F.get("_r", F.col("o.ref_idx")))
    is_ = lambda op: F.count_if(F.col("o.op") == op)
    return one.groupBy(*by, tok.alias("token")).agg(F.count_if(F.col("o.op") != "I").alias("n_all"), is_("C").alias("cor"), is_("S").alias("sub"), is_("D").alias("del"), is_("I").alias("ins"))
