"""Distortion simulation: schedules as columns, signals as Arrow functions. Every draw is a hash of the row's key."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions import frames as L
from framewright.operators.joins import draw, uniform
from framewright.plans.scan import ranked

LABELS = {"clean": 0, "noise": 1, "rir": 2, "interference": 3, "packet_loss": 4, "missing": 5, "rir_noise": 6, "rir_interference": 7}
EVENT = "array<struct<type:string,label:int,start:double,end:double,snr_db:double>>"
RATE = 16000


def snr_scale(clean: Column, noise: Column, snr_db: float | Column) -> Column:
    """Factor for the noise: rms(clean) / 10^(snr/20) / rms(noise)."""
    snr = F.lit(snr_db) if not isinstance(snr_db, Column) else snr_db
    return L.rms(clean) / F.pow(F.lit(10.0), snr / 20) / L.rms(noise)


def draw_snr(key: Column, lo: float, hi: float, seed: int = 0, k: int = 0, triangular: bool = False) -> Column:
    """Uniform, or triangular with its mode in the middle, by the inverse of the distribution."""
    u = uniform(key, seed, k)
    if not triangular:
        return lo + (hi - lo) * u
    return F.when(u < 0.5, lo + (hi - lo) * F.sqrt(u / 2)).otherwise(hi - (hi - lo) * F.sqrt((1 - u) / 2))


def fade(x: Column, rate: int = RATE, ms: float = 5.0, fade_in: bool = True, fade_out: bool = True) -> Column:
    """Linear ramps at both ends, no longer than half."""
    n = F.least(F.lit(int(ms * rate / 1000)), F.floor(F.size(x) / 2).cast("int"))
    size = F.size(x)
    up = lambda i: F.when((i < n) & (n > 1), i / (n - 1)).when(i < n, 0.0).otherwise(1.0)
    down = lambda i: F.when((i >= size - n) & (n > 1), (size - 1 - i) / (n - 1)).when(i >= size - n, 1.0).otherwise(1.0)
    return F.transform(x, lambda v, i: v * (up(i) if fade_in else F.lit(1.0)) * (down(i) if fade_out else F.lit(1.0)))


def zero_segment(x: Column, start: Column, end: Column, rate: int = RATE, ms: float = 5.0) -> Column:
    """Silence [start, end) seconds, with linear ramps outside of it."""
    a, z, n, size = F.floor(start * rate).cast("int"), F.floor(end * rate).cast("int"), int(ms * rate / 1000), F.size(x)
    before = F.least(F.lit(n), a)
    after = F.least(F.lit(n), size - z)
    ramp = lambda k, m: F.when(m > 1, k / (m - 1)).otherwise(1.0)

    def one(v: Column, i: Column) -> Column:
        down = v * (1.0 - F.when(before > 1, (i - (a - before)) / (before - 1)).otherwise(0.0))
        return F.when((i >= a) & (i < z), 0.0).when((i >= a - before) & (i < a), down).when((i >= z) & (i < z + after), v * F.when(after > 1, ramp(i - z, after)).otherwise(0.0)).otherwise(v)

    return F.transform(x, one)


def drop_packets(x: Column, key: Column, rate_lost: float = 0.1, packet: int = 320, seed: int = 0) -> Column:
    """Silence whole packets, each with the given probability; what is left after the last whole packet stays."""
    lost = lambda p: draw(seed, key, p) < rate_lost

    def packets(v: Column) -> Column:
        whole = F.floor(F.size(v) / packet).cast("int")
        silence = F.array_repeat(F.lit(0).cast("float"), F.lit(packet))
        kept = F.flatten(F.transform(L.span(F.lit(0), whole), lambda p: F.when(lost(p), silence).otherwise(F.slice(v, p * packet + 1, F.lit(packet)))))
        return F.concat(kept, F.slice(v, whole * packet + 1, F.size(v) - whole * packet))

    return L.let(x, packets)


def word_augmentation(words: Column, key: Column, p_missing: float = 0.1, p_packet: float = 0.1, p_interference: float = 0.1, p_noise: float = 0.1, pools: tuple[str, ...] = ("interference", "noise"), seed: int = 0) -> Column:
    """One draw a word, in bands missing, packet loss, interference, noise; a band whose pool is absent does nothing."""

    def one(w: Column, i: Column) -> Column:
        u = draw(seed, key, i)
        kind = F.when(u < p_missing, "missing").when(u < p_missing + p_packet, "packet_loss")
        kind = kind.when(u < p_missing + p_packet + p_interference, "interference" if "interference" in pools else None).when(u < p_missing + p_packet + p_interference + p_noise, "noise" if "noise" in pools else None)
        return F.struct(kind.alias("type"), w["start"].alias("start"), w["end"].alias("end"))

    return F.filter(F.transform(words, one), lambda e: e["type"].isNotNull())


def event(kind: str, start: Column, end: Column, snr: Column | None = None, label: Column | int | None = None) -> Column:
    mark = F.lit(LABELS[kind] if label is None else label) if not isinstance(label, Column) else label
    return F.struct(F.lit(kind).alias("type"), mark.cast("int").alias("label"), start.cast("double").alias("start"), end.cast("double").alias("end"), (snr if snr is not None else F.lit(None)).cast("double").alias("snr_db"))


def placed(key: Column, total: Column, lo: float, hi: float, n_max: int, kind: str, seed: int, snr: tuple[float, float] | None = None) -> Column:
    """1..n_max intervals of lo..hi seconds, no longer than 0.8 of the total divided by their number; they may overlap."""
    n = F.floor(uniform(key, seed, 0) * n_max).cast("int") + 1

    def one(i: Column) -> Column:
        u = lambda k: draw(seed, key, k, i)
        dur = F.least(lo + (hi - lo) * u(1), 0.8 * total / n)
        at = u(2) * (total - dur)
        return event(kind, at, at + dur, (snr[0] + (snr[1] - snr[0]) * u(3)) if snr else None)

    return F.transform(L.span(F.lit(0), n), one).cast(EVENT)


def rng_of(*key: object) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.blake2b(repr(key).encode(), digest_size=8).digest(), "big"))


def chosen_set(key: Column, kinds: tuple[str, ...], lo: int, hi: int, seed: int) -> Column:
    """lo..hi of the kinds without replacement."""
    n = F.floor(uniform(key, seed, 91) * (hi - lo + 1)).cast("int") + lo
    order = F.array_sort(F.array(*[F.struct(draw(seed, key, k).alias("h"), F.lit(k).alias("kind")) for k in kinds]))
    return F.transform(F.slice(order, F.lit(1), n), lambda x: x["kind"])


GOLDEN = 0.6180339887498949


def packed_events(key: Column, total: Column, kinds: Column, seed: int, lo: float = 0.3, hi: float = 2.0, gap: float = 0.1, tries: int = 100, most: float = 0.3) -> Column:
    """Non-overlapping intervals, one or two of each kind, of lo..hi seconds but at most 0.3 of the total, with a gap between.

    The longest is placed first, where the first of 100 tries finds room; what finds none is dropped. The tries of an interval
    start at a draw and go on in steps of the golden ratio, around the total.
    """

    def wanted(k: Column) -> Column:
        def one(q: Column) -> Column:
            dur = F.least(lo + (hi - lo) * draw(seed, key, k, q, "d"), most * total)
            return F.struct((-dur).alias("minus"), k.alias("type"), q.alias("q"), draw(seed, key, k, q, "t").alias("u"), draw(seed, key, k, q, "s").alias("s"))

        return F.transform(L.span(F.lit(0), F.floor(draw(seed, key, k, "n") * 2).cast("int") + 1), one)

    label = lambda k: reduce(lambda c, x: c.when(k == x, LABELS[x]), list(LABELS)[1:], F.when(k == "clean", 0))

    def place(placed: Column, w: Column) -> Column:
        room = total + w["minus"]
        at = lambda lo, hi: F.transform(F.sequence(F.lit(lo), F.lit(hi - 1)), lambda i: F.pmod(w["u"] + i * F.lit(GOLDEN), F.lit(1.0)) * room)
        ok = lambda a: ~F.exists(placed, lambda e: (a - w["minus"] + gap > e["start"]) & (a < e["end"] + gap))
        # Later tries are only computed if the early ones find no room.
        cuts = [0, *[c for c in (4, 16) if c < tries], tries]
        found = F.array(F.coalesce(*[F.get(F.filter(at(lo, hi), ok), F.lit(0)) for lo, hi in zip(cuts, cuts[1:], strict=False)]))
        free = F.filter(found, lambda a: a.isNotNull())
        snr = F.when(w["type"].isin("noise", "interference"), w["s"] * 25.0 - 5.0)
        first = F.transform(free, lambda a: F.struct(w["type"].alias("type"), label(w["type"]).cast("int").alias("label"), a.alias("start"), (a - w["minus"]).alias("end"), snr.alias("snr_db")))
        return F.when(room > 0, F.concat(placed, first.cast(EVENT))).otherwise(placed)

    order = F.array_sort(F.flatten(F.transform(kinds, wanted)))
    by_start = lambda x, y: F.when(x["start"] < y["start"], -1).when(x["start"] > y["start"], 1).otherwise(0)
    return F.array_sort(F.aggregate(order, F.array().cast(EVENT), place), by_start)


def signal(f: Callable[..., np.ndarray], *columns: Column) -> Column:
    """An array function in NumPy over whole arrays of a batch."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for cols in batches:
            cols = (cols,) if isinstance(cols, pd.Series) else cols
            yield pd.Series([None if any(x is None for x in row) else np.asarray(f(*row), np.float32) for row in zip(*cols, strict=True)], dtype=object)

    return run(*columns)


def _rms(x: np.ndarray) -> float:
    return float(np.sqrt(np.mean(np.square(x)) + 1e-12)) if len(x) else 0.0


def convolve(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Full convolution by FFT, cut to the length of x, brought to its level and clipped to +-1."""
    x, h = np.asarray(x, float), np.asarray(h, float)
    if not len(x) or not len(h):
        return x
    n = 1 << (len(x) + len(h) - 2).bit_length()
    y = np.fft.irfft(np.fft.rfft(x, n) * np.fft.rfft(h, n), n)[: len(x)]
    level = _rms(y)
    return np.clip(y * (_rms(x) / level) if level > 0 else y, -1, 1)


def reverb(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The middle of the convolution, as long as the longer of both."""
    x, h = np.asarray(x, float), np.asarray(h, float)
    return np.convolve(x, h, "same") if len(x) and len(h) else x


def mix_noise(x: np.ndarray, noise: np.ndarray, snr_db: float, onset: int = 0) -> np.ndarray:
    """Add noise from ``onset``, repeated if too short, at the given level below the signal; divided by the peak if that is over 1."""
    x, noise = np.asarray(x, float), np.asarray(noise, float)
    if not len(x) or not len(noise):
        return x
    if len(noise) - onset < len(x):
        noise = np.tile(noise, -(-(len(x) + onset) // len(noise)))
    part = noise[onset : onset + len(x)]
    y = x + part * (_rms(x) / 10 ** (snr_db / 20) / _rms(part))
    top = np.abs(y).max()
    return y / top if top > 1 else y


def mix_by_power(x: np.ndarray, other: np.ndarray, sir_db: float) -> np.ndarray:
    x, other = np.asarray(x, float), np.asarray(other, float)
    if not len(x) or not len(other):
        return x
    other = np.resize(other, len(x))
    power = np.mean(other**2)
    return x + other * np.sqrt(np.mean(x**2) / (power * 10 ** (sir_db / 10))) if power > 0 else x


def synthetic_noise(n: int, kind: str, key: object, seed: int = 0) -> np.ndarray:
    """White, pink (spectrum falling as 1/sqrt(f)) or brown (running sum of white) noise of unit level."""
    w = rng_of(seed, kind, key).standard_normal(n)
    if kind == "pink" and n > 1:
        s = np.fft.rfft(w)
        w = np.fft.irfft(s / np.sqrt(np.maximum(np.arange(len(s)), 1)), n)
    elif kind == "brown":
        w = np.cumsum(w)
    return w / (_rms(w) or 1.0)


def synthetic_room(rt60: float, key: object, rate: int = RATE, seed: int = 0) -> np.ndarray:
    """Noise that decays by 60 dB in rt60 seconds, after a direct impulse."""
    n = max(1, int(rt60 * rate))
    h = rng_of(seed, "room", key).standard_normal(n) * np.exp(-6.9078 * np.arange(n) / n)
    h[0] = 1.0
    return h / np.abs(h).max()


def resample(x: np.ndarray, rate: int, to: int) -> np.ndarray:
    """By FFT to int(n * to / rate) samples."""
    x = np.asarray(x, float)
    m = int(len(x) * to / rate)
    if not len(x) or m == 0:
        return x[:0]
    s = np.fft.rfft(x)
    out = np.zeros(m // 2 + 1, complex)
    k = min(len(s), len(out))
    out[:k] = s[:k]
    if m < len(x) and m % 2 == 0:  # what was at both signs of the new highest frequency
        out[-1] = out[-1].real * 2
    elif m > len(x) and len(x) % 2 == 0:  # the old highest one is shared out again
        out[k - 1] = out[k - 1] / 2
    return np.fft.irfft(out, m) * m / len(x)


# --- The generator programs: a segment with its duration -> events and frame labels ---

PROGRAMS: dict[str, Callable[[Column, Column, int], Column]] = {}


def program(name: str):
    def add(f):
        PROGRAMS[name] = f
        return f

    return add


none = lambda: F.array().cast(EVENT)
program("clean")(lambda key, t, seed: none())
program("noise")(lambda key, t, seed: F.array(event("noise", F.lit(0.0), t, draw_snr(key, -5, 20, seed, 1, True))).cast(EVENT))
program("rir")(lambda key, t, seed: F.array(event("rir", F.lit(0.0), t)).cast(EVENT))
program("interference")(lambda key, t, seed: placed(key, t, 1.0, 4.0, 3, "interference", seed, (5.0, 20.0)))
program("packet_loss")(lambda key, t, seed: F.slice(placed(key, t, 0.2, 1.0, 1, "packet_loss", seed), 1, 1))
program("missing")(lambda key, t, seed: placed(key, t, 0.1, 0.5, 3, "missing", seed))


@program("noise_partial")
def _noise_partial(key: Column, t: Column, seed: int) -> Column:
    """As interference, from its pool, but called noise."""
    as_noise = lambda e: F.struct(F.lit("noise").alias("type"), F.lit(1).alias("label"), e["start"].alias("start"), e["end"].alias("end"), e["snr_db"].alias("snr_db"))
    return F.transform(placed(key, t, 1.0, 4.0, 3, "interference", seed, (5.0, 20.0)), as_noise).cast(EVENT)


@program("rir_noise")
def _rir_noise(key: Column, t: Column, seed: int) -> Column:
    snr = draw_snr(key, -5, 20, seed, 1, True)
    return F.array(event("rir_noise", F.lit(0.0), t, snr, L.dominance(snr))).cast(EVENT)


@program("multi_dist_no_rir")
def _multi(key: Column, t: Column, seed: int) -> Column:
    return packed_events(key, t, chosen_set(key, ("noise", "interference", "packet_loss", "missing"), 2, 4, seed), seed)


@program("multi_dist_rir")
def _multi_rir(key: Column, t: Column, seed: int) -> Column:
    """A room over everything: only the events are labelled; a loud room (level 10 dB and more) labels noise and interference 2."""

    def dominated(e: Column) -> Column:
        label = F.when(e["type"] == "noise", L.dominance(e["snr_db"], 10.0, 1)).when(e["type"] == "interference", L.dominance(e["snr_db"], 10.0, 3)).otherwise(e["label"])
        return F.struct(e["type"].alias("type"), label.alias("label"), e["start"].alias("start"), e["end"].alias("end"), e["snr_db"].alias("snr_db"))

    return F.transform(_multi(key, t, seed), dominated).cast(EVENT)


def simulate(segments: DataFrame, programs: tuple[str, ...] | None = None, seed: int = 0, key: str = "segment_id", seconds: str = "seconds", rate: int = RATE) -> DataFrame:
    """Each segment under each program: key, program, events, num_frames, labels. Rows without a positive duration are left out."""
    programs = programs or tuple(PROGRAMS)
    t = segments.where(F.col(seconds) > 0).select(key, F.col(seconds).alias("_t"))
    parts = []
    for i, name in enumerate(programs):
        e = t.withColumn("program", F.lit(name)).withColumn("events", PROGRAMS[name](F.col(key), F.col("_t"), seed * 100 + i))
        parts.append(e.withColumn("num_frames", L.frame_count(F.floor(F.col("_t") * rate), rate)).withColumn("labels", L.paint(F.col("events"), F.col("num_frames"))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.drop("_t")


# --- The same programs on audio ---

ROOMS = 5


def room(number: int, taps: int = 32) -> np.ndarray:
    """A short room response: a direct impulse and echoes that decay by 60 dB, another one for each number."""
    k = np.arange(taps)
    h = np.exp(-6.9078 * k / taps) * np.cos(k * (number + 1.0))
    return h / np.abs(h).max()


def apply_events(x: np.ndarray, events: list, sources: dict, rate: int, room_no: int | None, lost: dict, ramp_ms: float = 5.0, packet: int = 32) -> np.ndarray:
    """The room over everything, then what is added, at its level below the clean signal of its interval, then what is lost.

    ``sources``: event number -> waveform, repeated if too short. ``lost``: event number -> which of its packets are gone.
    A missing stretch has linear ramps outside of it. A peak over 1 scales the whole.
    """
    x = np.asarray(x, float)
    n = len(x)
    y = convolve(x, room(room_no)) if room_no is not None else x.copy()
    span = lambda e: (min(n, int(e["start"] * rate)), min(n, int(e["end"] * rate)))
    for i, e in enumerate(events):
        a, z = span(e)
        if i in sources and z > a and e["snr_db"] is not None:
            part = np.resize(np.asarray(sources[i], float), z - a)
            y[a:z] += part * (_rms(x[a:z]) / 10 ** (e["snr_db"] / 20) / _rms(part))
    top = np.abs(y).max() if n else 0.0
    y = y / top if top > 1 else y
    for i, e in enumerate(events):
        a, z = span(e)
        if e["type"] == "packet_loss":
            for p, gone in enumerate(lost.get(i, [])):
                if gone:
                    y[a + p * packet : min(z, a + (p + 1) * packet)] = 0
        elif e["type"] == "missing" and z > a:
            m = int(ramp_ms * rate / 1000)
            b, c = min(m, a), min(m, n - z)
            y[a - b : a] *= 1 - (np.arange(b) / (b - 1) if b > 1 else np.zeros(b))
            y[z : z + c] *= np.arange(c) / (c - 1) if c > 1 else np.zeros(c)
            y[a:z] = 0
    return y


ADDED = ("noise", "interference", "rir_noise")
IN_A_ROOM = ("rir", "rir_noise", "multi_dist_rir")


def simulate_audio(recordings: DataFrame, programs: tuple[str, ...] | None = None, seed: int = 0, key: str = "archive_id", audio: str = "x", rate: int = RATE, packet: int = 32, p_lost: float = 0.5) -> DataFrame:
    """Each recording under each program: key, program, events, room, num_frames, labels, y (the changed samples).

    ``recordings`` has one row per key. Noise and interference come from the other recordings, which are the pool: each event
    draws the number of one, and an equi-join on that number brings its samples. Null, empty and silent recordings are no
    part of the pool; empty ones stay as they are and null ones are left out. Events per recording are few, so they are
    gathered again by key.
    """
    programs = programs or tuple(PROGRAMS)
    base = recordings.where(F.col(audio).isNotNull()).select(key, F.col(audio).alias("x"), (F.size(audio) / rate).alias("_t"))
    sounds = base.where(F.exists("x", lambda v: v != 0)).withColumn("_g", F.lit(0))
    pool = ranked(sounds.select("_g", key, "x"), ["_g"], [key], "_n", "pool").select((F.col("_n") - 1).alias("_no"), F.col("x").alias("source"))
    size = pool.count()
    parts = []
    for i, name in enumerate(programs):
        s = seed * 100 + i
        events = PROGRAMS[name](F.col(key), F.col("_t"), s)
        room_no = F.floor(draw(s, F.col(key), "room") * ROOMS).cast("int") if name in IN_A_ROOM else F.lit(None).cast("int")
        parts.append(base.select(key, F.lit(name).alias("program"), F.lit(s).alias("_s"), "x", "_t", events.alias("events"), room_no.alias("room")))
    df = reduce(lambda a, b: a.unionByName(b), parts)
    e = df.select(key, "program", "_s", "_t", F.posexplode("events").alias("i", "e"))
    drawn = e.withColumn("_no", F.when(F.col("e.type").isin(*ADDED) & F.lit(size > 0), F.floor(draw(F.col("_s"), F.col(key), "pool", F.col("i")) * size)))
    packets = F.transform(L.span(F.lit(0), F.when(F.col("e.type") == "packet_loss", F.ceil((F.col("e.end") - F.col("e.start")) * rate / packet) + 1).otherwise(0).cast("int")), lambda p: draw(F.col("_s"), F.col(key), F.col("i"), p) < p_lost)
    got = drawn.join(pool, "_no", "left").groupBy(key, "program").agg(F.collect_list(F.struct("i", "source", packets.alias("lost"))).alias("parts"))
    joined = df.join(got, [key, "program"], "left")

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for xs, evs, rooms, ps in batches:
            out = []
            for x, ev, r, p in zip(xs, evs, rooms, ps, strict=True):
                p = [] if p is None else list(p)
                sources = {int(q["i"]): q["source"] for q in p if q["source"] is not None}
                out.append(apply_events(x, list(ev), sources, rate, None if r is None or r != r else int(r), {int(q["i"]): q["lost"] for q in p}, packet=packet))
            yield pd.Series(out, dtype=object)

    frames = L.frame_count(F.size("x"), rate)
    return joined.select(key, "program", "events", "room", frames.alias("num_frames"), L.paint(F.col("events"), frames).alias("labels"), run("x", "events", "room", "parts").alias("y"))
