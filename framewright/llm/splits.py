"""Train, validation and test splits that keep tied records together.

Ties (same speaker, session, audio file) are edges between recordings. Components come from parallel hooking and shortcutting
over parent arrays in joined tables. Subset sums over the sizes' multiplicities, as bitsets, then choose how many components
of each size go to which split, so that the totals come as close to the targets as the sizes allow.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.plans.scan import ranked
from framewright.plans.tables import release, stage

# Fillers that name nobody, lower case and trimmed.
FILLERS = ("", "-", "--", "?", "unknown", "unk", "n/a", "na", "none", "null", "nil", "nan", "anonymous", "anon", "tbd", "not available", "unnamed", "undefined", "missing", "<unk>")
SALTS = 32
RATIOS = {"train": 0.8, "valid": 0.1, "test": 0.1}
WINDOW = 1 << 16


def names_someone(value: Column, fillers: tuple[str, ...] = FILLERS) -> Column:
    return value.isNotNull() & ~F.lower(F.trim(value)).isin(*fillers)


def audio_file(path: Column) -> Column:
    """The file a recording plays: of a command ending in '|', the word that is an absolute path or ends like an audio file."""
    file = F.regexp_extract(path, r"(?:^|\s)['\"]?(/[^\s|'\"]+|[^\s|'\"]+\.(?i:wav|flac|mp3|ogg|opus|sph|m4a|aac|aiff?|raw))(?=['\"]?(?:\s|\||$))", 1)
    plain = F.trim(path)
    return F.when(plain.endswith("|"), F.when(file != "", file)).when(plain != "", plain)


def recording_ties(recordings: DataFrame) -> DataFrame:
    """rec_id, tie: a row for each thing that ties a recording. Speakers regardless of case and outer blanks, sessions as written."""
    who = F.lower(F.trim("speaker_id"))
    ties = F.array(
        F.when(names_someone(F.col("speaker_id")), F.concat(F.lit("speaker:"), who)),
        F.when(names_someone(F.col("session_id")), F.concat(F.lit("session:"), F.col("session_id"))),
        F.concat(F.lit("file:"), audio_file(F.col("audio_path"))),
    )
    return recordings.where("rec_id IS NOT NULL").select("rec_id", F.explode(ties).alias("tie")).where("tie IS NOT NULL").distinct()


def tie_edges(ties: DataFrame, node: str = "rec_id", tie: str = "tie", salts: int = SALTS) -> DataFrame:
    """a > b: edges that connect the nodes of each tie, one per node, through its smallest node.

    A node is linked to the smallest of its salted share of the tie, and that to the smallest of all: no share of a hot tie
    is larger than a part in ``salts``, and the second step sees at most ``salts`` rows a tie.
    """
    salted = ties.select(F.col(node).alias("n"), F.col(tie).alias("t"), F.pmod(F.xxhash64(node), F.lit(salts)).alias("s"))
    hubs = salted.groupBy("t", "s").agg(F.min("n").alias("h"))
    top = hubs.groupBy("t").agg(F.min("h").alias("g"))
    low = salted.join(hubs, ["t", "s"]).select(F.col("n").alias("a"), F.col("h").alias("b"))
    high = hubs.join(top, "t").select(F.col("h").alias("a"), F.col("g").alias("b"))
    return low.unionByName(high).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: for each node of an edge (a, b) the smallest node of its component.

    Each round hooks every root onto its smallest neighbouring root if that is smaller, shortcuts the parents until they
    point to roots, and contracts the edges to the roots; it ends when no edge joins two roots. Hooking goes to smaller
    nodes only, so it makes no cycles, and the larger end of every edge is hooked, so every round leaves fewer roots. A node
    is hooked once, so all rounds' parents together are no more than the nodes; they are put together from the last round
    backwards, each joined once. Every table is written before it is read again.
    """
    hooks: list[DataFrame] = []
    e = stage(edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct(), "edges")
    while not e.isEmpty():
        before = e
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = stage(both.groupBy("a").agg(F.min("b").alias("p")).where("p < a").select(F.col("a").alias("node"), "p"), "parent")
        while True:  # shortcut: parent of parent, until all parents are roots
            up = parent.select(F.col("node").alias("p"), F.col("p").alias("pp"))
            jumped = stage(parent.join(up, "p", "left").select("node", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("moved")), "parent")
            release(parent)
            parent = jumped.select("node", "p")
            parent._staged_path = jumped._staged_path
            if jumped.where("moved").isEmpty():
                break
        hooks.append(parent)
        pa_, pb = parent.select(F.col("node").alias("a"), F.col("p").alias("ra")), parent.select(F.col("node").alias("b"), F.col("p").alias("rb"))
        e = e.join(pa_, "a", "left").join(pb, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).where("a <> b").distinct()
        old, e = before, stage(e, "edges")
        release(old)
    if not hooks:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = hooks.pop()
    for parent in reversed(hooks):
        up = found.select(F.col("node").alias("p"), F.col("p").alias("pp"))
        below = found
        found = stage(parent.join(up, "p", "left").select("node", F.coalesce("pp", "p").alias("p")).unionByName(below), "found")
        release(parent, below)
    roots = found.select(F.col("p").alias("node")).distinct()
    return found.select("node", F.col("p").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))


def tied_groups(recordings: DataFrame) -> DataFrame:
    """rec_id, group_rec_id for recordings in groups of two or more tied ones. Staged."""
    found = components(tie_edges(recording_ties(recordings)))
    return stage(found.select(F.col("node").alias("rec_id"), F.col("root").alias("group_rec_id")), "groups")


def choose(sizes: dict[int, int], targets: list[int], window: int = WINDOW) -> list[dict[int, int]]:
    """For each target in turn, how many components of each size give the closest total that the sizes left over allow.

    Sizes are divided by their common divisor. A part of the target is filled first, by a fixed rule: of every size the
    target's share, rounded down, so that a split gets large and small components alike, then whole components in an order
    by hash, until ``window`` units are left. A bitset finds the best total for those. If that isn't the best there can be at
    all, nothing but the bitset is known to be exact, and the window grows until it is, or nothing is filled.
    """
    left = {s: n for s, n in sizes.items() if s > 0 and n > 0}
    out = []
    for target in targets:
        picked = _closest(left, max(0, target), window)
        left = {s: n - picked.get(s, 0) for s, n in left.items() if n > picked.get(s, 0)}
        out.append(picked)
    return out


def _closest(sizes: dict[int, int], target: int, window: int) -> dict[int, int]:
    if not sizes or not target:
        return {}
    unit = math.gcd(*sizes)
    total = sum(s * n for s, n in sizes.items())
    ideal = min(target % unit, unit - target % unit) if target < total else target - total
    off = lambda p: abs(target - sum(s * n for s, n in p.items()))
    best: dict[int, int] = {}
    fill = True
    while True:
        picked: dict[int, int] = {}
        rest = min(target, total)
        if fill:
            for s, n in sizes.items():
                if take := n * rest // total:
                    picked[s] = take
            rest -= sum(s * n for s, n in picked.items())
            for s in sorted(sizes, key=_scattered):
                if take := max(0, min(sizes[s] - picked.get(s, 0), (rest - window * unit) // s)):
                    picked[s], rest = picked.get(s, 0) + take, rest - s * take
        goal = target - sum(s * n for s, n in picked.items())
        now = {s // unit: n - picked.get(s, 0) for s, n in sizes.items()}
        for s, n in _subset(now, goal // unit, goal % unit / unit).items():
            picked[s * unit] = picked.get(s * unit, 0) + n
        best = min(best, picked, key=off)
        if not fill or off(best) == ideal:
            return best
        fill, window = rest > window * unit // 16, window * 16


def _scattered(n: int) -> int:
    return (n * 0x9E3779B97F4A7C15 ^ n >> 7) & (1 << 64) - 1


def _shifted(bits: int, size: int, n: int, mask: int) -> int:
    """Add up to n copies of size to every total."""
    step = 1
    while n:
        take = min(step, n)
        bits |= (bits << (size * take)) & mask
        n, step = n - take, step * 2
    return bits


def _subset(sizes: dict[int, int], target: int, over: float = 0.0) -> dict[int, int]:
    """How many of each size give the total nearest to ``target + over``, 0 <= over < 1; the smaller of two.

    Bit t of a bitset says that a total t can be made. Only totals up to a little over the target are kept, and a size with
    multiplicity m costs log m shifts. Bitsets are kept for every k-th size, and those between are made again when the
    counts are read back, so memory stays at the square root of the number of sizes.
    """
    items = sorted(((s, n) for s, n in sizes.items() if n > 0 and s > 0), reverse=True)
    if not items or target < 0:
        return {}
    # A total further above the target than that is no closer than the empty one or the one without its smallest part.
    limit = min(sum(s * n for s, n in items), 2 * target + 1, target + items[0][0])
    items = [(s, min(n, limit // s)) for s, n in items if s <= limit]
    mask = (1 << (limit + 1)) - 1
    every = max(1, math.isqrt(len(items)))
    kept, bits = {0: 1}, 1
    for i, (s, n) in enumerate(items, 1):
        bits = _shifted(bits, s, n, mask)
        if i % every == 0:
            kept[i] = bits
    below = (bits & ((1 << (target + 1)) - 1)).bit_length() - 1
    above = bits >> (target + 1)
    beyond = target + 1 + (above & -above).bit_length() - 1 if above else None
    total = below if beyond is None or target + over - below <= beyond - target - over else beyond
    picked: dict[int, int] = {}
    at = len(items)
    while at and total:
        base = (at - 1) // every * every
        row = [kept[base]]
        for s, n in items[base : at - 1]:
            row.append(_shifted(row[-1], s, n, mask))
        for i in range(at - 1, base - 1, -1):
            s, n = items[i]
            c = next(c for c in range(n + 1) if c * s <= total and row[i - base] >> (total - c * s) & 1)
            if c:
                picked[s] = c
            total -= c * s
        at = base
    return picked


def assign(weights: DataFrame, group: str, weight: str, ratios: dict[str, float] = RATIOS) -> DataFrame:
    """group, split: each group whole in one split. ``weights`` has one row per group with its size (0 allowed).

    Only the number of groups per size comes to the driver, at most about the square root of twice the total size in rows;
    so does the table of bounds, which is small enough to be broadcast by Spark's own size check where it is.
    Within a size, groups are ranked by a hash of their id over all partitions, so the same input gives the same splits.
    The first ratio takes what is left; no group gives an empty table.
    """
    by_size = weights.groupBy(F.col(weight).cast("long").alias("size")).agg(F.count("*").alias("groups"))
    counts = {r.size: r.groups for r in by_size.toLocalIterator()}
    total, wanted = sum(s * n for s, n in counts.items()), sum(ratios.values())
    first, *others = ratios
    others.sort(key=lambda x: ratios[x])
    picked = choose(counts, [round(total * ratios[x] / wanted) for x in others])
    bounds = [(s, lo, lo + n, name) for name, before, p in zip(others, [{}, *_running(picked)], picked, strict=False) for s, n in p.items() for lo in [before.get(s, 0)]]
    spark = weights.sparkSession
    bounds_df = spark.createDataFrame(bounds, "size long, lo long, hi long, split string")
    named = weights.select(F.col(group).alias("g"), F.col(weight).cast("long").alias("size"), F.xxhash64(group).alias("h"))
    rank = ranked(named, ["size"], ["h", "g"], "r", "ranks")
    hit = (rank["size"] == bounds_df["size"]) & (F.col("r") > F.col("lo")) & (F.col("r") <= F.col("hi"))
    return rank.join(bounds_df, hit, "left").select(F.col("g").alias(group), F.coalesce("split", F.lit(first)).alias("split"))


def _running(picked: list[dict[int, int]]) -> list[dict[int, int]]:
    out: list[dict[int, int]] = []
    so_far: dict[int, int] = {}
    for p in picked:
        so_far = {s: so_far.get(s, 0) + p.get(s, 0) for s in {*so_far, *p}}
        out.append(so_far)
    return out


def split_segments(segments: DataFrame, recordings: DataFrame, ratios: dict[str, float] = RATIOS) -> DataFrame:
    """segment_id, recording_id, split: every segment once, all segments of tied recordings in one split.

    Repeated segments (same segment_id and recording_id) count once. A recording that the table of recordings lacks, or that
    nothing ties, is a group by itself; a segment without recording_id is one too. Null segment_ids are left out.
    """
    groups = tied_groups(recordings)
    rows = segments.where("segment_id IS NOT NULL").select("segment_id", "recording_id").distinct()
    # Sizes are summed per recording before the join, so a hot recording is one row in it.
    per_recording = rows.groupBy("recording_id", F.when(F.col("recording_id").isNull(), F.col("segment_id")).alias("alone")).agg(F.count("*").alias("n"))
    tied = per_recording.join(groups, per_recording.recording_id == groups.rec_id, "left")
    own = F.coalesce(F.concat(F.lit("r:"), F.coalesce("group_rec_id", "recording_id")), F.concat(F.lit("s:"), F.col("alone")))
    tied = stage(tied.select("recording_id", "alone", own.alias("grp"), "n"), "tied")
    splits = assign(tied.groupBy("grp").agg(F.sum("n").alias("n")), "grp", "n", ratios)
    where = stage(tied.join(splits, "grp").select(F.col("recording_id").alias("w_rec"), F.col("alone").alias("w_alone"), "split"), "where")
    alone = rows.where("recording_id IS NULL").join(where.where("w_rec IS NULL"), F.col("segment_id") == F.col("w_alone"))
    within = rows.where("recording_id IS NOT NULL").join(where.where("w_rec IS NOT NULL"), F.col("recording_id") == F.col("w_rec"))
    return within.select("segment_id", "recording_id", "split").unionByName(alone.select("segment_id", "recording_id", "split"))


def shares(assigned: DataFrame, ratios: dict[str, float] = RATIOS) -> DataFrame:
    """split, segments, share, target_share; a split that got nothing has a row too."""
    spark = assigned.sparkSession
    wanted = spark.createDataFrame([(k, v / sum(ratios.values())) for k, v in ratios.items()], "split string, target_share double")
    n = assigned.groupBy("split").agg(F.count("*").alias("segments"))
    both = wanted.join(n, "split", "left").withColumn("segments", F.coalesce("segments", F.lit(0).cast("long")))
    both = both.withColumn("total", F.sum("segments").over(Window.partitionBy(F.lit(0))))  # a row per split
    return both.select("split", "segments", F.round(F.col("segments") / F.col("total"), 6).alias("share"), F.round("target_share", 6).alias("target_share"))
