"""Records of an evaluation split that are in the training split too, exactly or almost: same key, or same sound.

Sound is fingerprinted by similarity-hash bits that survive gain, noise, trimming, padding and short drop-outs: around each
local peak of the absolute signal, two codes of 48 bits say whether the samples before and after it, nearest first, have the
peak's sign. Every peak is thus in two permuted tables, one led by the bits before it and one by the bits after it. A table is
joined on the first ``width`` bits of its code, where the evaluation side also looks up the codes with one of its four or two of
its three weakest bits turned; the width is fixed, so rows that are added to the table change nothing for the pairs of the others.
Pairs stay if the next bits and those of the other code lie within a Hamming radius, and are verified on the samples: the
correlation over the overlap at their offset. Slow sounds get codes from the signal averaged over four samples as well; sounds without two
telling codes get one for all of their samples.

Exact copies of a waveform form a class and go through as one representative; classes are expanded at the end, and not at all
in the report. The samples are read once for codes and hashes, and once more for the candidates.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.plans.tables import release, ship, stage

PEAK = 8  # a peak is no smaller than the samples this far around it
BITS = 48
LEAST_WIDTH, SPARE = 24, 8  # bits of a join key: SPARE more than the logarithm of the training rows it is meant for, of which a code then meets some 2^-4 by chance
MEANT_FOR = 1 << 16  # training rows; the number that the input has must not decide, since wider keys find fewer pairs
RADIUS = 1 / 3  # of the bits that are compared after the join
WEAK = 4  # bits of the smallest samples, which are turned on the evaluation side
TURNS = ((0,), (1,), (2,), (3,), (0, 1), (0, 2), (1, 2))  # the smallest sample is 0
MORE, OPPOSITE = 16, 32  # bits that are compared after the join: those after the key's, and those of the code on the other side
SAME = 0.8
SHORTEST = 16  # waveforms with fewer samples match exact copies only
FEW = 6  # with fewer bits to compare only the samples decide
SLOW, SLOWNESS = 4, 0.6  # samples averaged for the codes of slow sounds, which keep that part of their energy then
POWERS = (1 << np.arange(BITS)).astype(np.int64)
LOW = (1 << BITS) - 1
TELLS, SLOWED = 1 << 54, 1 << 55  # marks above a code's bits and the six bits that say how many of them are there
AFTER, WHOLE = 1 << 56, 1 << 57  # marks of join keys: which table


def width(rows: int) -> int:
    return min(BITS, max(LEAST_WIDTH, ceil(log2(max(rows, 1))) + SPARE))


def _window_max(m: np.ndarray, w: int) -> np.ndarray:
    """Maximum over w samples on either side, by doubling."""
    span, size, out = 2 * w + 1, 1, m.copy()
    while size < span:
        step = min(size, span - size)
        out[:-step] = np.maximum(out[:-step], out[step:])
        size += step
    return np.concatenate([m[:w], out])[: len(m)] if w else out


def codes(values: np.ndarray, lengths: np.ndarray, bits: int) -> tuple[np.ndarray, ...]:
    """row, position, code before, code after, and the weakest of each code's first ``bits`` bits (six bits each), of every peak."""
    pad = BITS + PEAK + 1
    starts = np.concatenate([[0], np.cumsum(lengths + pad)[:-1]]).astype(np.int64) + pad if len(lengths) else np.zeros(0, np.int64)
    flat = np.zeros(int((lengths + pad).sum()) + pad, np.float32)
    row = np.repeat(np.arange(len(lengths)), lengths)
    within = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    flat[starts[row] + within] = values
    m = np.abs(flat)
    at = np.flatnonzero((m > 0) & (m >= _window_max(m, PEAK)))
    owner = np.searchsorted(starts, at, "right") - 1
    pos = at - starts[owner]
    sign = np.sign(flat[at])[:, None]
    out, weak = [], np.zeros(len(at), np.int64)
    for k, (step, room) in enumerate(((-1, pos), (1, lengths[owner] - 1 - pos))):
        around = flat[at[:, None] + step * np.arange(1, BITS + 1)[None, :]]
        same = around * sign > 0
        silent = around == 0
        ones = same[:, :bits].sum(1)
        # Codes beyond the ends or in silence, or with nearly equal bits, tell nothing apart.
        tells = (room >= bits) & (silent[:, :bits].sum(1) <= bits // 3) & (ones >= 3) & (ones <= bits - 3)
        there = np.minimum(room, BITS)
        there = np.where(silent.sum(1) - (BITS - there) > there // 3, np.where(tells, bits, 0), there)
        out.append(same @ POWERS | there << BITS | np.where(tells, TELLS, 0))
        if len(at):
            size = np.abs(around[:, :bits])
            least = np.argpartition(size, WEAK - 1, axis=1)[:, :WEAK]
            least = np.take_along_axis(least, np.take_along_axis(size, least, 1).argsort(1), 1).astype(np.int64)
            weak |= (least << 6 * np.arange(k * WEAK, (k + 1) * WEAK)).sum(1)
    return owner, pos, *out, weak


def slowed(values: np.ndarray, lengths: np.ndarray, by: int = SLOW) -> tuple[np.ndarray, np.ndarray]:
    """Means of ``by`` samples each, of the sounds that keep most of their energy; a last part that is shorter is left out."""
    n = lengths // by
    energy = lambda x, k: np.add.reduceat(np.append(x.astype(np.float64) ** 2, 0), np.minimum(np.cumsum(k) - k, len(x))) * (k > 0) if len(k) else np.zeros(0)
    every = _means(values, lengths, n, by)
    slow = by * energy(every, n) >= SLOWNESS * energy(values, lengths)
    return every[np.repeat(slow, n)], n * slow


def _means(values: np.ndarray, lengths: np.ndarray, n: np.ndarray, by: int) -> np.ndarray:
    at = np.repeat(np.cumsum(lengths) - lengths, n) + by * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    return values[at[:, None] + np.arange(by)[None, :]].mean(1) if len(at) else np.zeros(0, np.float32)


def _mixed(n: np.ndarray) -> np.ndarray:
    """A random number of 56 bits for each integer, always the same."""
    with np.errstate(over="ignore"):
        z = (n.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) & np.uint64(AFTER - 1)).astype(np.int64)


def whole_code(x: np.ndarray) -> list[int]:
    """One code for all samples: an exclusive or of a number for each with the sign of the largest, and the numbers of the weakest."""
    m = np.abs(x)
    numbers = _mixed(np.arange(len(x)))
    code = np.bitwise_xor.reduce(numbers[x * np.sign(x[m.argmax()]) > 0]) ^ _mixed(np.array([-1 - len(x)]))[0]
    return [int(code) | WHOLE, *numbers[m.argsort(kind="stable")[:WEAK]].tolist()]


def _lists(owner: np.ndarray, n: int, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))


def _sketches(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """The last column, audio, becomes the codes of its peaks, and a code for the whole where they tell too little."""
    for b in batches:
        audio = b.column(b.num_columns - 1)
        n = b.num_rows
        lengths = np.maximum(np.nan_to_num(audio.value_lengths().to_numpy(zero_copy_only=False).astype(np.float64)), 0).astype(np.int64)
        values = np.nan_to_num(audio.flatten().to_numpy(zero_copy_only=False).astype(np.float32), nan=0.0, posinf=0.0, neginf=0.0)
        fast, slow = codes(values, lengths, bits), codes(*slowed(values, lengths), bits)
        owner, pos, before, after, weak = (np.concatenate([x, y]) for x, y in zip(fast, (*slow[:2], slow[2] | SLOWED, slow[3] | SLOWED, slow[4]), strict=True))
        # Only the evaluation side turns bits.
        weak = np.where((b.column(b.schema.get_field_index("side")).to_numpy() == 2)[owner], weak, 0) if n else weak
        use = (before | after) & TELLS != 0
        owner, pos, before, after, weak = (x[use] for x in (owner, pos, before, after, weak))
        order = np.argsort(owner, kind="stable")
        told = sum(np.bincount(owner[c & TELLS != 0], minlength=n) for c in (before, after))
        ends = np.cumsum(lengths)
        whole = [whole_code(x) if told[i] < 2 and lengths[i] >= SHORTEST and (x := values[ends[i] - lengths[i] : ends[i]]).any() else None for i in range(n)]
        lists = [_lists(owner[order], n, x[order], t) for x, t in ((pos, pa.int32()), (before, pa.int64()), (after, pa.int64()), (weak, pa.int64()))]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], *lists, pa.array(whole, pa.list_(pa.int64()))], names=[*b.schema.names[:-1], "pos", "before", "after", "weak", "whole"])


def correlation(x: np.ndarray, y: np.ndarray, lag: int) -> float:
    """Of x[n] with y[n + lag] over their overlap, whatever the gain; 0 if they share too little."""
    a, z = max(0, -lag), min(len(x), len(y) - lag)
    if z - a < max(SHORTEST, min(len(x), len(y)) // 2):
        return 0.0
    u, v = x[a:z].astype(np.float64), y[a + lag : z + lag].astype(np.float64)
    norm = np.sqrt((u @ u) * (v @ v))
    return float(abs(u @ v) / norm) if norm > 0 else 0.0


def _verified(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """id_e, id_t, lags (twice the lag, and one more where it is exact), x, y -> the pairs that correlate at one of the lags or near it."""
    for b in batches:
        e, t, lags, x, y = b.columns
        keep = []
        for i in range(b.num_rows):
            u, v = x[i].values.to_numpy(zero_copy_only=False), y[i].values.to_numpy(zero_copy_only=False)
            coded = lags[i].values.to_numpy(zero_copy_only=False)
            near = {int(c >> 1) + s for c in coded for s in (range(1) if c & 1 else range(1 - SLOW, SLOW))}
            if any(correlation(u, v, k) >= least for k in sorted(near)):
                keep.append(i)
        at = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([e.take(at), t.take(at)], names=["id_e", "id_t"])


def _shifted(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int"))


def _turned(key: Column, masks: list[Column]) -> Column:
    """The key, and with some of its weak bits turned."""
    return F.explode(F.array(key, *[reduce(lambda k, i: k.bitwiseXOR(masks[i]), turn, key) for turn in TURNS]))


def _keys(sketches: DataFrame, bits: int, turn: bool) -> DataFrame:
    """key, id, pos, rest: of each telling code and of whole waveforms; with ``turn`` also under the keys with turned bits.

    ``rest`` holds what is compared after the join: MORE bits of the code after the key's, OPPOSITE bits of the other code, and
    how many of them there are (five and six bits)."""
    peak = sketches.select(F.col("archive_id").alias("id"), F.explode(F.arrays_zip("pos", "before", "after", "weak")).alias("p")).select("id", "p.*")

    def side(own: str, other: str, mark: int, first: int) -> Column:
        key = F.col(own).bitwiseAND((1 << bits) - 1).bitwiseOR(F.col(own).bitwiseAND(SLOWED)).bitwiseOR(F.lit(mark))
        bits_of = lambda c, first, n: F.shiftright(F.col(c), first).bitwiseAND((1 << n) - 1)
        there = lambda c, first, n: F.least(F.greatest(F.shiftright(c, BITS).bitwiseAND(63) - first, F.lit(0)), F.lit(n))
        up = lambda c, n: F.shiftleft(c.cast("long"), n)
        rest = bits_of(own, bits, MORE) if bits < BITS else F.lit(0).cast("long")
        rest = rest.bitwiseOR(up(bits_of(other, 0, OPPOSITE), MORE)).bitwiseOR(up(there(F.col(own), bits, MORE), MORE + OPPOSITE)).bitwiseOR(up(there(F.col(other), 0, OPPOSITE), MORE + OPPOSITE + 5))
        masks = [_shifted(F.shiftright("weak", 6 * (first + i)).bitwiseAND(63)) for i in range(WEAK)]
        return F.when(F.col(own).bitwiseAND(TELLS) != 0, F.struct(key.alias("key"), rest.alias("rest"), F.array(*masks).alias("masks")))

    tables = F.explode(F.array(side("before", "after", 0, 0), side("after", "before", AFTER, WEAK))).alias("k")
    coded = peak.select("id", "pos", tables).where("k IS NOT NULL").select("id", "pos", "k.*")
    whole = sketches.where("whole IS NOT NULL").select(F.col("archive_id").alias("id"), F.lit(0).alias("pos"), F.get("whole", F.lit(0)).alias("key"), F.lit(0).cast("long").alias("rest"), F.slice("whole", 2, WEAK).alias("masks"))
    rows = coded.unionByName(whole)
    return rows.select(_turned(F.col("key"), [F.get("masks", F.lit(i)) for i in range(WEAK)]).alias("key"), "id", "pos", "rest") if turn else rows.drop("masks")


class CrossSplit:
    """Overlaps of the evaluation splits with the training split.

    Rows with another or no split take no part. Null uttids match nothing; they are compared as written. Null, empty and
    all-zero audio resembles nothing; other waveforms of fewer than 16 samples match exact copies. sample_rate is ignored.
    Repeated rows count once. An empty table gives no pairs. No number of partners is limited; a key that very many rows
    share is an equi-join that AQE splits, and its pairs are reduced by the other bits of their codes before anything is
    written. An archive_id must stand for one waveform.

    ``meant_for`` sets the width of the join keys. A larger number makes chance matches rarer, which grow with the training rows
    times the evaluation rows, and misses some more pairs; what is found never depends on the number of rows that there are.
    """

    def __init__(self, archive: DataFrame, train: str = "train", evals: tuple[str, ...] = ("valid", "test"), radius: float = RADIUS, least: float = SAME, meant_for: int = MEANT_FOR):
        ship(archive.sparkSession)
        side = F.when(F.col("split_name") == train, 1).when(F.col("split_name").isin(*evals), 2)
        rows = archive.where(side.isNotNull() & F.col("archive_id").isNotNull())
        bits = width(meant_for)
        sounds = F.coalesce(F.exists("audio", lambda x: x != 0), F.lit(False))
        heard = F.when(sounds, F.col("audio"))
        given = rows.select("archive_id", "uttid", side.alias("side"), "split_name", "dataset", F.when(sounds, F.xxhash64("audio")).alias("h1"), F.when(sounds, F.xxhash64(F.lit(7), "audio")).alias("h2"), heard.alias("audio"))
        fields = ", ".join(f"{c} {t}" for c, t in given.drop("audio").dtypes)
        sketches = given.mapInArrow(lambda batches: _sketches(batches, bits), f"{fields}, pos array<int>, before array<long>, after array<long>, weak array<long>, whole array<long>")
        sketches = stage(sketches, "sketches")
        meta = sketches.select("archive_id", "uttid", "side", "split_name", "dataset", "h1", "h2").distinct()
        heard_rows = meta.where("h1 IS NOT NULL")
        classes = heard_rows.groupBy("h1", "h2").agg(F.min("archive_id").alias("rep"), F.bit_or("side").alias("sides"))
        self.members = stage(meta.join(classes, ["h1", "h2"], "left").drop("h1", "h2"), "members")
        # Rows that differ from "its own class, on its own side": few, unless most sounds are copies. Spark broadcasts them if small.
        others = self.members.where("archive_id <> rep OR sides <> side").select("archive_id", F.when(F.col("archive_id") == F.col("rep"), F.col("sides")).alias("as_sides")).distinct()
        others = stage(others, "others")
        chosen = sketches.where("h1 IS NOT NULL").join(others.withColumn("other_row", F.lit(True)), "archive_id", "left").where("other_row IS NULL OR as_sides IS NOT NULL").withColumn("sides", F.coalesce("as_sides", "side"))
        # Repeated rows give repeated keys; they vanish in the aggregate below.
        t = _keys(chosen.where("sides & 1 <> 0"), bits, False).withColumnsRenamed({"id": "id_t", "pos": "pos_t", "rest": "rest_t"})
        e = _keys(chosen.where("sides & 2 <> 0"), bits, True).withColumnsRenamed({"id": "id_e", "pos": "pos_e", "rest": "rest_e"})
        there = lambda first, n: F.least(*[F.shiftright(c, MORE + OPPOSITE + first).bitwiseAND((1 << n) - 1) for c in ("rest_t", "rest_e")])
        n_more, n_other = there(0, 5), there(5, 6)
        mask = (_shifted(n_more) - 1).bitwiseOR(F.shiftleft(_shifted(n_other) - 1, MORE))
        differ = F.bit_count(F.col("rest_t").bitwiseXOR(F.col("rest_e")).bitwiseAND(mask))
        alike = (n_more + n_other < FEW) | (differ <= (n_more + n_other) * radius)
        exact = F.when(F.col("key").bitwiseAND(SLOWED) != 0, (F.col("pos_t") - F.col("pos_e")) * (2 * SLOW)).otherwise((F.col("pos_t") - F.col("pos_e")) * 2 + 1)
        pairs = t.join(e, "key").where((F.col("id_t") != F.col("id_e")) & alike).select("id_e", "id_t", exact.alias("lag"))
        candidates = stage(pairs.groupBy("id_e", "id_t").agg(F.collect_set("lag").alias("lags")), "candidates")  # a lag per pair of peaks at most
        needed = stage(candidates.select(F.explode(F.array("id_e", "id_t")).alias("archive_id")).distinct(), "needed")
        audio = stage(rows.select("archive_id", "audio").join(needed, "archive_id", "left_semi").dropDuplicates(["archive_id"]), "audio")
        both = candidates.join(audio.select(F.col("archive_id").alias("id_e"), F.col("audio").alias("x")), "id_e").join(audio.select(F.col("archive_id").alias("id_t"), F.col("audio").alias("y")), "id_t")
        checked = both.select("id_e", "id_t", "lags", "x", "y").mapInArrow(lambda batches: _verified(batches, least), "id_e long, id_t long")
        copies = self.members.where("sides = 3").select(F.col("rep").alias("id_e"), F.col("rep").alias("id_t")).distinct()
        #: Pairs of classes, by their smallest archive_id: the evaluation side's, the training side's.
        self.alike = stage(checked.unionByName(copies).distinct(), "alike")
        release(sketches, others, candidates, needed, audio)

    def pairs(self) -> DataFrame:
        """archive_id_a < archive_id_b: each pair of a training and an evaluation row with the same uttid or the same sound, once."""
        member = self.members.select("archive_id", "side", "rep").where("rep IS NOT NULL").distinct()
        me = member.where("side = 2").select(F.col("rep").alias("id_e"), F.col("archive_id").alias("e"))
        mt = member.where("side = 1").select(F.col("rep").alias("id_t"), F.col("archive_id").alias("t"))
        sound_pairs = self.alike.join(me, "id_e").join(mt, "id_t").select("e", "t")
        by_id = self.members.where("uttid IS NOT NULL").select("uttid", "side", "archive_id").distinct()
        id_pairs = by_id.where("side = 2").select("uttid", F.col("archive_id").alias("e")).join(by_id.where("side = 1").select("uttid", F.col("archive_id").alias("t")), "uttid").select("e", "t")
        every = sound_pairs.unionByName(id_pairs).where("e <> t")
        return every.select(F.least("e", "t").alias("archive_id_a"), F.greatest("e", "t").alias("archive_id_b")).distinct()

    def report(self) -> DataFrame:
        """split_name, dataset, pairs, eval_rows: the evaluation rows with a partner, and their partners, per evaluation split and dataset.

        Counted from the sizes of classes and of groups of one uttid, without a row per pair: the partners of a row are those
        with a sound like its own, and those with its uttid, without those that have both.
        """
        m = self.members
        mt = m.where("side = 1").select(F.col("archive_id").alias("t"), F.col("rep").alias("id_t"), F.col("uttid").alias("ut")).distinct()
        me = m.where("side = 2").select("archive_id", "rep", "uttid", "split_name", "dataset").distinct()
        of_class = self.alike.join(mt.groupBy("id_t").agg(F.count("*").alias("n")), "id_t").groupBy(F.col("id_e").alias("rep")).agg(F.sum("n").alias("by_sound"))
        of_id = mt.where("ut IS NOT NULL").groupBy(F.col("ut").alias("uttid")).agg(F.count("*").alias("by_id"))
        asked = me.where("uttid IS NOT NULL AND rep IS NOT NULL").select(F.col("rep").alias("id_e"), F.col("uttid").alias("ut")).distinct()
        sized = mt.where("id_t IS NOT NULL").join(asked.select("ut").distinct(), "ut", "left_semi").groupBy("id_t", "ut").agg(F.count("*").alias("n"))
        of_both = asked.join(sized, "ut").join(self.alike, ["id_e", "id_t"], "left_semi").groupBy(F.col("id_e").alias("rep"), F.col("ut").alias("uttid")).agg(F.sum("n").alias("by_both"))
        # The row itself, where an archive_id stands in both splits.
        twice = me.select("archive_id", F.col("rep").alias("id_e"), "uttid").join(mt, F.col("archive_id") == F.col("t")).join(self.alike.withColumn("_a", F.lit(True)), ["id_e", "id_t"], "left")
        itself = twice.where("_a OR uttid = ut").select("archive_id").distinct().withColumn("itself", F.lit(1))
        rows = me.join(of_class, "rep", "left").join(of_id, "uttid", "left").join(of_both, ["rep", "uttid"], "left").join(itself, "archive_id", "left").na.fill(0, ["by_sound", "by_id", "by_both", "itself"])
        partners = F.expr("by_sound + by_id - by_both - itself")
        return rows.select("split_name", "dataset", partners.alias("n")).where("n > 0").groupBy("split_name", "dataset").agg(F.sum("n").alias("pairs"), F.count("*").alias("eval_rows"))


def overlaps(archive: DataFrame, **options) -> DataFrame:
    return CrossSplit(archive, **options).pairs()
