"""Frame labels as array functions: painting, downsampling, remapping and expansion. No function shuffles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

HOP = 0.02
TOKEN_FRAME = 0.08


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once. Inside a lambda any other expression from outside is computed at each step."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def none(kind: str = "array<int>") -> Column:
    return F.array().cast(kind)


def span(a: Column, b: Column) -> Column:
    """The integers of [a, b); empty if b <= a (Spark's sequence would count down)."""
    return F.when(b > a, F.sequence(a, b - 1)).otherwise(none().cast("array<int>"))


def frame_count(samples: Column, rate: int = 16000, hop: float = HOP) -> Column:
    """(samples - 1) // hop + 1, none for no samples."""
    return F.when(samples <= 0, 0).otherwise(F.floor((samples - 1) / int(hop * rate)) + 1).cast("int")


def to_frame(seconds: Column, hop: float = HOP) -> Column:
    return F.ceil(F.round(seconds / hop, 9)).cast("int")


def paint(events: Column, frames: Column, hop: float = HOP) -> Column:
    """events array<struct<label,start,end>> -> a label per frame: the largest of those whose [ceil(start), ceil(end)) holds it, else 0.

    Whole stretches are laid over an array of zeros in the order of their labels.
    """
    clamp = lambda f: F.greatest(F.lit(0), F.least(f, frames))
    at = F.array_sort(F.transform(events, lambda e: F.struct(e["label"].cast("int").alias("l"), clamp(to_frame(e["start"], hop)).alias("a"), clamp(to_frame(e["end"], hop)).alias("z"))))

    def lay(acc: Column, e: Column) -> Column:
        over = F.concat(F.slice(acc, F.lit(1), e["a"]), F.array_repeat(e["l"], e["z"] - e["a"]), F.slice(acc, e["z"] + 1, F.size(acc) - e["z"]))
        return F.when(e["z"] > e["a"], over).otherwise(acc)

    return F.aggregate(at, F.array_repeat(F.lit(0), frames), lay)


def first_applied(events: Column, frames: Column, overwriting: tuple[int, ...] = (4, 5), hop: float = HOP) -> Column:
    """The other priority: in the order applied, a label only takes frames that are still 0, except those that overwrite."""
    events_at = F.transform(events, lambda e: F.struct(e["label"].alias("l"), to_frame(e["start"], hop).alias("a"), to_frame(e["end"], hop).alias("z")))

    def fold(f: Column, at: Column) -> Column:
        hits = F.filter(at, lambda e: (e["a"] <= f) & (f < e["z"]))
        return F.aggregate(hits, F.lit(0), lambda acc, e: F.when((acc == 0) | e["l"].isin(*overwriting), e["l"]).otherwise(acc))

    return let(events_at, lambda at: F.transform(span(F.lit(0), frames), lambda f: fold(f, at)))


def zeros(n: Column) -> Column:
    return F.array_repeat(F.lit(0), n)


def dominance(snr: Column, threshold: float = 10.0, louder: int = 1, room: int = 2) -> Column:
    return F.when(snr < threshold, louder).otherwise(room)


def downsample(labels: Column, ratio: int = 4, method: str = "majority") -> Column:
    """Windows of ``ratio`` frames, the last may be short: the first, the largest or the most frequent label (the smallest of several)."""

    def window(w: Column) -> Column:
        if method == "first":
            return F.get(w, F.lit(0))
        if method == "max":
            return F.array_max(w)
        votes = F.transform(F.array_distinct(w), lambda x: F.struct(F.size(F.filter(w, lambda y: y == x)).alias("n"), (-x).alias("l")))
        return -F.array_max(votes)["l"]

    def windows(ls: Column) -> Column:
        n = F.ceil(F.size(ls) / ratio).cast("int")
        return F.transform(F.transform(span(F.lit(0), n), lambda k: F.slice(ls, k * ratio + 1, F.lit(ratio))), window)

    return let(labels, windows)


def expand_tokens(tokens: Column) -> Column:
    """array<struct<start,end,label>> -> array<struct<frame_idx,label>>: [start, end), for the last token [start, end]."""
    part = lambda t, last: F.transform(span(t["start"], t["end"] + F.when(last, 1).otherwise(0)), lambda f: F.struct(f.alias("frame_idx"), t["label"].alias("label")))
    return let(tokens, lambda ts: F.flatten(F.transform(ts, lambda t, i: part(t, i == F.size(ts) - 1))))


def dedup_last(labels: Column) -> Column:
    """One label per frame, the last one given, sorted by frame. Sorted once, then each is compared with the next."""
    placed = F.array_sort(F.transform(labels, lambda x, i: F.struct(x["frame_idx"].alias("frame_idx"), i.alias("i"), x["label"].alias("label"))))
    last = let(placed, lambda ls: F.filter(ls, lambda x, i: ~x["frame_idx"].eqNullSafe(F.get(ls, i + 1)["frame_idx"]) | (i == F.size(ls) - 1)))
    return F.transform(last, lambda x: F.struct(x["frame_idx"].alias("frame_idx"), x["label"].alias("label")))


def remap(labels: Column, reform: int = -1, add_rir: bool = False) -> Column:
    """-1: unchanged, or 1 to 6 and 3 to 7 with ``add_rir``; otherwise 0 stays, 1 becomes ``reform`` and other labels go."""
    if reform == -1:
        if not add_rir:
            return labels
        return F.transform(labels, lambda x: F.struct(x["frame_idx"].alias("frame_idx"), F.when(x["label"] == 1, 6).when(x["label"] == 3, 7).otherwise(x["label"]).alias("label")))
    kept = F.filter(labels, lambda x: x["label"].isin(0, 1))
    return F.transform(kept, lambda x: F.struct(x["frame_idx"].alias("frame_idx"), F.when(x["label"] == 1, reform).otherwise(x["label"]).alias("label")))


def dense(labels: Column, length: Column, fill: int | None = None) -> Column:
    """A label per frame of 0..length-1, the last one given; null (or ``fill``) where there is none. Frames beyond are left out.

    The labels lie in order with the gaps before them filled, so a row takes time in proportion to its length.
    """
    nothing = F.lit(fill).cast("int")
    inside = F.filter(dedup_last(labels), lambda x: (x["frame_idx"] >= 0) & (x["frame_idx"] < length))

    def lay(ls: Column) -> Column:
        before = lambda i: F.when(i > 0, F.get(ls, i - 1)["frame_idx"]).otherwise(-1)
        part = F.transform(ls, lambda x, i: F.concat(F.array_repeat(nothing, x["frame_idx"] - before(i) - 1), F.array(x["label"].cast("int"))))
        tail = length - 1 - before(F.size(ls))
        return F.concat(F.flatten(part), F.array_repeat(nothing, tail))

    return F.when(length.isNotNull(), let(inside, lay))


def filter_labels(labels: Column, remove_deletions: bool = False, sub_ins: bool = False, word_level: bool = False) -> Column:
    """Drop 2; or, with ``sub_ins``, drop 1 (not at word level) and make 2 a 1."""
    if remove_deletions:
        labels = F.filter(labels, lambda x: x != 2)
    if sub_ins:
        labels = labels if word_level else F.filter(labels, lambda x: x != 1)
        labels = F.transform(labels, lambda x: F.when(x == 2, 1).otherwise(x))
    return labels


def run_starts(frames: Column) -> Column:
    """First frames of the runs of consecutive ones."""
    return let(F.array_sort(F.array_distinct(frames)), lambda fs: F.filter(fs, lambda f, i: (i == 0) | (F.get(fs, i - 1) != f - 1)))


def pad_to(values: Column, n: Column) -> Column:
    return F.slice(F.concat(values, F.array_repeat(F.lit(0), F.greatest(n, F.lit(0)))), F.lit(1), n)


def arg_max(values: Column) -> Column:
    """0-based position of the first largest value."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def majority_error(predictions: Column) -> Column:
    """1 if more than half (rounded down) of the labels are errors."""
    total = F.aggregate(predictions, F.lit(0), lambda a, x: a + x)
    return F.when(total > F.floor(F.size(predictions) / 2), 1).otherwise(0)


def any_error(predictions: Column) -> Column:
    return F.when(F.exists(predictions, lambda x: x == 1), 1).otherwise(0)


def merge_max(a: Column, b: Column) -> Column:
    """Larger of both, as far as the shorter goes."""
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: F.greatest(x, y))


def parse_labels(raw: Column, ordered: bool = False) -> Column:
    """'[0:1,5:0]' -> array<struct<frame_idx,label>>, sorted by frame if ``ordered``; pairs that are no integers go."""
    pairs = F.filter(F.split(F.regexp_replace(raw, r"[\[\]]", ""), ","), lambda x: x.rlike(r"^\s*-?[0-9]+:-?[0-9]+\s*$"))
    out = F.transform(pairs, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).cast("int").alias("frame_idx"), F.trim(F.substring_index(x, ":", -1)).cast("int").alias("label")))
    return F.array_sort(out, lambda x, y: F.when(x["frame_idx"] < y["frame_idx"], -1).when(x["frame_idx"] > y["frame_idx"], 1).otherwise(0)) if ordered else out


def label_text(labels: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(labels, lambda x: F.concat_ws(":", x["frame_idx"].cast("string"), x["label"].cast("string"))), ","), F.lit("]"))


def monotone_starts(starts: Column) -> Column:
    """No start before the one ahead of it."""
    n = F.size(starts)
    later = F.slice(starts, F.lit(2), F.greatest(n - 1, F.lit(0)))
    return ~F.exists(F.zip_with(later, F.slice(starts, F.lit(1), F.greatest(n - 1, F.lit(0))), lambda c, p: c < p), lambda x: x)


def rms(x: Column) -> Column:
    """Root of the mean square plus 1e-12."""
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v) / F.size(x) + 1e-12)


def peak(x: Column) -> Column:
    return F.array_max(F.transform(x, F.abs))


def power(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v) / F.size(x)
