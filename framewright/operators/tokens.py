"""Words, tokens and frames of an utterance: mapping between them, deletions, and marked text."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions import frames as L
from framewright.functions import text as T
from framewright.operators.align import WORD_TIES, edit_ops

BONUS = 10
FRAME = 0.08


def best_words(tokens: Column, words: Column) -> Column:
    """For each token the 0-based word with the largest overlap of offsets, plus 10 if it holds the token's start; the first of several."""

    def score(t: Column, w: Column) -> Column:
        overlap = F.greatest(F.lit(0), F.least(t["end"], w["end"]) - F.greatest(t["start"], w["start"]))
        return overlap + F.when((w["start"] <= t["start"]) & (t["start"] <= w["end"]), BONUS).otherwise(0)

    best = lambda t, ws: -F.array_max(F.transform(ws, lambda w, i: F.struct(score(t, w).alias("s"), (-i).alias("i"))))["i"]
    return L.let(words, lambda ws: F.when(F.size(ws) > 0, F.transform(tokens, lambda t: best(t, ws))).otherwise(L.none()))


def uncovered_frames(frames: Column, tokens: Column, n: Column, frame: float = FRAME, tolerance: int = 1) -> Column:
    """Frames without a token in the window of ``tolerance`` frames around them; touching counts as overlap."""

    def free(f: Column, ts: Column) -> Column:
        lo, hi = F.greatest(F.lit(0), f - tolerance) * frame, F.least(n, f + tolerance + 1) * frame
        return ~F.exists(ts, lambda t: ~((t["end"] < lo) | (t["start"] > hi)))

    return L.let(tokens, lambda ts: F.filter(frames, lambda f: free(f, ts)))


def deletion_frames(predictions: Column, tokens: Column, frame: float = FRAME) -> Column:
    """First frames of the runs of frames predicted deleted (1) that no token covers."""
    hit = F.filter(F.transform(predictions, lambda x, i: F.when(x == 1, i)), lambda x: x.isNotNull())
    return L.run_starts(uncovered_frames(hit, tokens, F.size(predictions), frame))


def first_word_after(time: Column, starts: Column) -> Column:
    """Index of the first word that starts after a time, else their number."""
    later = F.filter(F.transform(starts, lambda s, i: F.when(s > time, i)), lambda x: x.isNotNull())
    return F.coalesce(F.get(later, F.lit(0)), F.size(starts))


def deletion_positions(ops: Column) -> Column:
    """For each deletion of an alignment the position after the last hypothesis word before it: what stands before it and is no deletion."""
    at = F.filter(F.transform(ops, lambda o, i: F.when(o["op"] == "D", i)), lambda x: x.isNotNull())
    return F.transform(at, lambda i, k: i - k)


def frame_events(ops: Column, ref_tokens: Column, hyp_tokens: Column) -> Column:
    """array<struct<start,label,end>> in order of start: 0 equal, 1 other or inserted (the hypothesis' offsets), 2 deleted (the reference's)."""

    def event(o: Column, i: Column, rs: Column, hs: Column) -> Column:
        t = F.when(o["op"] == "D", F.get(rs, o["ref_idx"])).otherwise(F.get(hs, o["hyp_idx"]))
        label = F.when(o["op"] == "C", 0).when(o["op"] == "D", 2).otherwise(1)
        return F.struct(t["start"].alias("start"), i.alias("at"), t["end"].alias("end"), label.alias("label"))

    events = L.let(ref_tokens, lambda rs: L.let(hyp_tokens, lambda hs: F.transform(ops, lambda o, i: event(o, i, rs, hs))))
    return F.transform(F.array_sort(events), lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["label"].alias("label")))


def token_labels(word_labels: Column, word_of_token: Column, tokens: Column) -> Column:
    """array<struct<frame_idx,label>>: each token's start with its word's label, 0 for a word without one."""
    one = lambda t, i, ls, ws: F.struct(t["start"].alias("frame_idx"), F.coalesce(F.get(ls, F.get(ws, i)), F.lit(0)).alias("label"))
    return L.let(word_labels, lambda ls: L.let(word_of_token, lambda ws: F.transform(tokens, lambda t, i: one(t, i, ls, ws))))


def error_type(hearing: Column, intelligibility: Column) -> Column:
    return F.when(intelligibility == 1, "unknown").when(hearing == 1, "unclear").otherwise("unknown")


def mark_text(words: Column, errors: Column, deletions: Column) -> Column:
    """words: array<string>; errors: array<struct<idx,type>>; deletions: array<int>.

    Lower-cased words, errors in their tags unless they are punctuation; <del> once before a word, but at the end once per
    entry.
    """

    def one(w: Column, i: Column) -> Column:
        kind = F.get(F.filter(errors, lambda e: e["idx"] == i), F.lit(0))["type"]
        tag = F.when(kind.isNotNull() & ~T.punctuation_only(w), F.concat(F.lit("<"), kind, F.lit(">"), F.lower(w), F.lit("</"), kind, F.lit(">"))).otherwise(F.lower(w))
        return F.when(F.array_contains(deletions, i), F.array(F.lit("<del>"), tag)).otherwise(F.array(tag))

    tail = F.transform(F.filter(deletions, lambda p: p >= F.size(words)), lambda p: F.lit("<del>"))
    return F.array_join(F.concat(F.flatten(F.transform(words, one)), tail), " ")


# --- What runs over the words of an utterance with a cursor ---

_WORD, _MARK = re.compile(r"\w"), re.compile(r"[^\w\s]")


def marks_only(w: str) -> bool:
    return not _WORD.search(w) and bool(_MARK.search(w))


def original_positions(clean: list[str], original: list[str]) -> dict[int, int]:
    """cleaned word index -> index in the original words, matched greedily; what is passed over is never taken again."""
    out: dict[int, int] = {}
    bare = [None if marks_only(w) else _MARK.sub("", w).lower() for w in original]
    at = 0
    for i, w in enumerate(clean):
        low = w.lower()
        found = next((k for k in range(at, len(bare)) if bare[k] == low), None)
        if found is None:
            break  # the cursor has run to the end
        out[i], at = found, found + 1
    return out


class Cursor:
    """Finds words in the text of an utterance's tokens from left to right, regardless of case."""

    def __init__(self, chars: list[str]):
        self.text = "".join(chars).lower()
        self.ends = list(accumulate(len(c) for c in chars))
        self.total = self.ends[-1] if self.ends else 0
        self.at = 0

    def find(self, word: str) -> int:
        return self.text.find(word.lower(), self.at)

    def token_at(self, position: int) -> int:
        """The token that holds a character."""
        return bisect_right(self.ends, position)

    def token_ending(self, position: int) -> int:
        """The first token that reaches as far as ``position``."""
        return next((i for i, e in enumerate(self.ends) if e >= position), len(self.ends))


def word_times(chars: list[str], starts: list[float], ends: list[float], words: list[str]) -> list[tuple[str, float, float]]:
    """Each word with the start of its first and the end of its last token; a word that isn't found gets its share of the time."""
    c, out = Cursor(chars), []
    for w in words:
        p = c.find(w)
        if p >= 0 and c.token_at(p) < len(chars):
            last = min(c.token_ending(p + len(w)), len(chars) - 1)
            out.append((w, starts[c.token_at(p)], ends[last]))
            c.at = p + len(w)
        elif c.total:
            whole = ends[-1] - starts[0]
            a = starts[0] + c.at / c.total * whole
            out.append((w, a, a + len(w) / c.total * whole))
            c.at += len(w)
    return out


def word_errors(predictions: list[int], chars: list[str], words: list[str]) -> list[int]:
    """1 for words most of whose tokens (more than half, rounded down) are errors; for words not found, any of an even share."""
    n = len(chars)
    p = (list(predictions) + [0] * n)[:n]
    c, out = Cursor(chars), []
    for k, w in enumerate(words):
        at = c.find(w)
        if not w.strip():
            out.append(0)
        elif at >= 0:
            first = c.token_at(at)
            if first >= n:
                out.append(0)
                continue
            end = c.token_ending(at + len(w))
            stop = end + 1 if end < n else first + 1
            out.append(int(sum(p[first:stop]) > (stop - first) // 2))
            c.at = at + len(w)
        else:
            share = n / len(words)
            out.append(int(any(x == 1 for x in p[int(k * share) : min(int((k + 1) * share), n)])))
    return out


def _positions(clean_positions: list[int], mapped: dict[int, int], n_clean: int, n_original: int) -> list[int]:
    out = []
    for p in clean_positions:
        if p >= n_clean:
            out.append(n_original)
        elif p in mapped:
            out.append(mapped[p])
        else:
            out.append(next((mapped[i] + 1 for i in range(p, -1, -1) if i in mapped), p))
    return out


def evaluate(ref: str, hyp: str, chars: list[str], starts: list[float], ends: list[float], hearing: list[int] | None, intelligibility: list[int] | None, deleted: list[int] | None, frame: float = FRAME) -> dict:
    """Truth and prediction of word errors and deletions of one utterance, as index lists.

    With both error sources their larger label counts as the hearing source's, as far as the shorter goes, before words vote.
    """
    if hearing is not None and intelligibility is not None:
        hearing = [max(a, b) for a, b in zip(hearing, intelligibility, strict=False)]
    r, h = _MARK.sub("", ref).split(), _MARK.sub("", hyp).split()
    original = hyp.split()
    mapped = original_positions(h, original)
    ops = edit_ops([w.lower() for w in r], [w.lower() for w in h], WORD_TIES)
    times = [x for x in word_times(chars, starts, ends, original) if not marks_only(x[0])]
    if len(times) != len(h):
        times = [(w, 0.0, 0.0) for w in h]
    names = [x[0] for x in times]
    hear = word_errors(hearing, chars, names) if hearing is not None else []
    intel = word_errors(intelligibility, chars, names) if intelligibility is not None else []
    n = max(len(hear), len(intel))
    either = [max(hear[i] if i < len(hear) else 0, intel[i] if i < len(intel) else 0) for i in range(n)]
    wrong = [i for i, x in enumerate(either) if x == 1 and i < len(h)]
    truth = sorted({j for op, _, j in ops if op in "SI"})
    gone, last = [], 0
    for op, _, j in ops:
        if op == "D":
            gone.append(last)
        else:
            last = j + 1
    free: list[int] = []
    if deleted is not None:
        for f, x in enumerate(deleted):
            lo, hi = max(0, f - 1) * frame, min(len(deleted), f + 2) * frame
            if x == 1 and not any(not (e < lo or s > hi) for s, e in zip(starts, ends, strict=True)):
                free.append(f)
    runs = [f for i, f in enumerate(free) if not i or free[i - 1] != f - 1]
    said_gone = [next((i for i, (_, s, _) in enumerate(times) if s > f * frame), len(h)) for f in runs]
    kinds = [(mapped[i], "unknown" if i < len(intel) and intel[i] == 1 else "unclear") for i in wrong if i in mapped]
    return {
        "words": original, "word_count": len(h), "truth": truth, "predicted": wrong, "gone": gone, "said_gone": said_gone,
        "gone_original": _positions(gone, mapped, len(h), len(original)), "said_gone_original": _positions(said_gone, mapped, len(h), len(original)),
        "errors": [{"idx": i, "type": k} for i, k in kinds],
    }


EVALUATION = "words array<string>, word_count int, truth array<int>, predicted array<int>, gone array<int>, said_gone array<int>, gone_original array<int>, said_gone_original array<int>, errors array<struct<idx:int,type:string>>"


def evaluate_words(df: DataFrame, frame: float = FRAME) -> DataFrame:
    """Columns ref, hyp, tokens array<struct<char,start,end>>, hearing, intelligibility, deleted -> EVALUATION in place of them."""

    @F.pandas_udf(EVALUATION)
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for cols in batches:
            as_list = lambda x: None if x is None else list(x)
            rows = [
                evaluate(r, h, list(c), list(s), list(e), as_list(a), as_list(b), as_list(g), frame)
                for r, h, c, s, e, a, b, g in zip(*cols, strict=True)
            ]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in EVALUATION.replace("struct<idx:int,type:string>", "x").split(", ")])

    at = lambda name: F.transform("tokens", lambda t: t[name])
    rest = [c for c in df.columns if c not in ("ref", "hyp", "tokens", "hearing", "intelligibility", "deleted")]
    out = run("ref", "hyp", F.transform("tokens", lambda t: T.token_first(t["char"])), at("start"), at("end"), "hearing", "intelligibility", "deleted")
    return df.select(*rest, out.alias("x")).select(*rest, "x.*")
