"""Garbled text from a wrong character encoding: find it, and undo it by round trips.

A text is re-encoded under a candidate legacy encoding and decoded strictly as the intended one; this is repeated for nested
layers. A change is accepted when a garbling cost drops: the cost counts characters beyond ASCII by how unlikely they are,
and symbols or capitals inside words. Because ASCII bytes survive every candidate, only the damaged stretches change.

Candidates: UTF-8 read as a code page of one byte (any number of layers); Cyrillic, Greek, Hebrew and Arabic code pages and
Japanese, Korean and Chinese encodings read as Latin; Cyrillic or Western code pages taken for one another. Text that was
lower- or upper-cased after the damage is recognised. U+FFFD marks damage that can't be undone. A text counts as restored only
if no sign of damage is left in it. Before a candidate is tried, the characters it could have come from are looked for.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache, lru_cache
from math import log
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UTF8_READ_AS = ("cp1252", "cp437", "cp850", "mac_roman", "cp1251", "koi8_r", "cp866", "cp1250")
# The other code pages of one byte that Python has; a reading under one of them must explain nearly all that is not ASCII.
RARELY = (
    *(f"cp{n}" for n in (1253, 1254, 1255, 1256, 1257, 1258, 737, 775, 852, 855, 857, 858, 860, 861, 862, 863, 864, 865, 869, 874)),
    *(f"iso8859_{n}" for n in (2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 13, 14, 15, 16)), "koi8_u", "mac_cyrillic", "mac_greek", "mac_iceland", "mac_latin2", "mac_turkish", "ptcp154", "kz1048", "hp_roman8",
)
CYRILLIC = ("cp1251", "koi8_r", "cp866", "mac_cyrillic", "iso8859_5")
GREEK, HEBREW, ARABIC = ("cp1253", "iso8859_7"), ("cp1255", "iso8859_8"), ("cp1256", "iso8859_6")
EAST_ASIAN = ("cp932", "euc_jp", "cp949", "gbk", "big5")
WESTERN = ("cp1252", "cp437", "cp850", "mac_roman")
RUSSIAN = "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфё"  # by frequency
WEST_LOWER = set("àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßœ")
WEST_OTHER = set("ÀÁÂÄÇÈÉÊËÍÎÏÑÓÔÖØÙÚÜŒ¿¡«»°±µ½¼£§ºª²³×·")
TYPOGRAPHIC = set("‘’‚“”„†‡•…–—‹›€™£§°±µ½¼«»©®¿¡№·×º")


class Repair(NamedTuple):
    garbled: bool
    restored: bool
    text: str
    layers: tuple[str, ...]


@cache
def _to_byte(enc: str) -> dict[int, int]:
    """Code point -> byte; a byte the encoding leaves open stands for the control character of that number, as decoders in the wild do."""
    out = {}
    for b in range(128, 256):
        try:
            out[ord(bytes([b]).decode(enc))] = b
        except UnicodeDecodeError:
            pass
        if b < 160:
            out.setdefault(b, b)
    return out


@cache
def _as_bytes(enc: str) -> dict[int, str]:
    """For str.translate: what the encoding holds becomes the character numbered as its byte, other characters beyond ASCII a blank sign."""
    return _Default({c: chr(b) for c, b in _to_byte(enc).items()})


class _Default(dict):
    def __init__(self, table: dict[int, str]):
        super().__init__({c: chr(c) for c in range(128)} | table)

    def __missing__(self, c: int) -> str:
        return "￿"


_CONT = "[\x80-\xbf]"
_UTF8 = re.compile(f"[\xc2-\xdf]{_CONT}|\xe0[\xa0-\xbf]{_CONT}|[\xe1-\xec\xee\xef]{_CONT}{{2}}|\xed[\x80-\x9f]{_CONT}|\xf0[\x90-\xbf]{_CONT}{{2}}|[\xf1-\xf3]{_CONT}{{3}}")
# What texts are made of: letters of any script in use, typographic signs, emoji.
_PLAUSIBLE = re.compile(
    "[ -ſƒȘ-țˆ˜\u0300-\u0304\u0306-\u030c\u0323\u0327\u0328\u0370-\u03ffЁ-џҐґ\u0531-\u0587\u05b0-\u05ea\u060c-\u066d\u067e-\u06d5\u0901-\u0d7f\u0e01-\u0e5b\u10d0-\u10fa\u1e00-\u1fff‐-…‰′″‹›€№™←-↓∀-⋿─-◿✓　-ヿ一-鿿\uac00-\ud7a3＀-￯﻿​-‍\U0001f300-\U0001faff️]|[\x80-\x9f]"
)
_WIDE = re.compile("[\u0901-\u0d7f\u0e01-\u0e5b\u10d0-\u10fa\u1e00-\u1fff　-鿿\uac00-\ud7a3＀-￯∀-◿\U0001f300-\U0001faff]")
# Scripts of which a text has several letters or none.
_SEVERAL = re.compile("[\u0300-\u036f\u0531-\u0587\u05b0-\u05ea\u060c-\u066d\u067e-\u06d5]")
# Sequences that are as well a proper word or sign of another script.
_ONE_SCRIPT = re.compile("[А-Яа-яЁё№«»]+|[\u0370-\u03ff«»]+|[\u0590-\u05ff]+|[\u0600-\u06ff]+|[\u0e00-\u0e7f]+")


@cache
def _leads(enc: str) -> tuple[frozenset[str], frozenset[str]]:
    """Characters that UTF-8's first bytes and its continuation bytes become under an encoding."""
    table = _to_byte(enc).items()
    return frozenset(chr(c) for c, b in table if 0xC2 <= b <= 0xF4), frozenset(chr(c) for c, b in table if 0x80 <= b <= 0xBF)


def cost(s: str) -> float:
    """How garbled a stretch looks: 0 for ASCII, more for symbols, controls and characters that stand oddly inside words."""
    total = 0.0
    for i, ch in enumerate(s):
        if ch < "\x80":
            continue
        if ch == "�" or "\x80" <= ch < "\xa0" or "─" <= ch < "☀":
            total += 3
        elif not ch.isalpha():
            total += 1 if ch in TYPOGRAPHIC else 2
        else:
            total += 1
        if i and s[i - 1].islower() and (ch.isupper() or not ch.isalnum()):
            total += 0.5
    return total


def _whole_runs(raw: str) -> dict[int, bool]:
    """For each sequence's start: whether sequences fill most of the stretch of re-encoded characters around it."""
    out = {}
    for run in re.finditer("[\x80-\xff]+", raw):
        found = [m for m in _UTF8.finditer(raw, *run.span())]
        filled = sum(len(m[0]) for m in found) >= 0.6 * len(run[0])
        out |= {m.start(): filled for m in found}
    return out


_RUNS = re.compile("[^\x00-\x7f]{2,}")
_PROPER_RUNS = re.compile("[А-Яа-яЁё«»№ ]+|[぀-ヿ一-鿿　-〿＀-￯…— ]+")


def _utf8_layer(text: str) -> tuple[str, str] | None:
    """The best single re-reading as UTF-8, or None."""
    best: tuple[float, str, str] | None = None
    runs = " ".join(_RUNS.findall(text))
    if not runs or _PROPER_RUNS.fullmatch(runs):
        return None
    there, explained = set(runs), 0
    for enc in (*UTF8_READ_AS, *RARELY):
        if enc == RARELY[0] and best and explained == sum(c > "\x7f" for c in text):
            break
        first, more = _leads(enc)
        if there.isdisjoint(first) or there.isdisjoint(more) or not _UTF8.search(runs.translate(_as_bytes(enc))):
            continue
        raw = text.translate(_as_bytes(enc))
        whole = _whole_runs(raw)
        got: list[tuple[int, int, str]] = []
        strong = wide = several = 0
        end_before = -1
        for m in _UTF8.finditer(raw):
            ch = m[0].encode("latin-1").decode("utf-8")
            if not _PLAUSIBLE.match(ch):
                continue
            a, z = m.span()
            lead, near = text[a], end_before == a
            end_before = z
            got.append((a, z, ch))
            wide += bool(_WIDE.match(ch))
            if _ONE_SCRIPT.fullmatch(text, a, z) or not whole[a]:
                continue
            if _SEVERAL.match(ch):
                several += near
                strong += near and several == 3
                continue
            if lead in "–—" and not near or _WIDE.match(ch) and wide < 2 or "\x80" <= ch < "\xa0":
                continue
            strong += 1
        if several < 3:
            got = [x for x in got if not _SEVERAL.match(x[2])]
        if not strong or enc in RARELY and (strong < 2 or sum(z - a for a, z, _ in got) < 0.8 * sum(c > "\x7f" for c in text)):
            continue
        gain = sum(cost(text[a:z]) - cost(ch) for a, z, ch in got)
        if gain > 0 and (best is None or gain > best[0]):
            out, at = [], 0
            for a, z, ch in got:
                out += [text[at:a], ch]
                at = z
            best = (gain, "".join([*out, text[at:]]), enc)
            explained = sum(z - a for a, z, _ in got)
    return (best[1], f"utf-8 as {best[2]}") if best else None


_FOLDED = re.compile("([\xe2\xe3\xe4\xe5\xf0\xf1])([\x80-\xbf\xff])(?![\x80-\xbf])")


def _folded_layer(text: str) -> tuple[str, str] | None:
    """UTF-8 read as cp1252 and then lower-cased: the lead bytes lost their capitals."""
    hits = []
    if not re.search("[ãâðñäå][^\x00-\x7f]", text):
        return None
    raw = text.translate(_as_bytes("cp1252"))
    for m in _FOLDED.finditer(raw):
        cont = 0x9F if m[2] == "\xff" else ord(m[2])
        ch = bytes([ord(m[1]) - 0x20, cont]).decode("utf-8").lower()
        # A proper lower-case letter before a blank or a closing quote is no lead byte.
        if (ch in WEST_LOWER or ch in WEST_OTHER or "а" <= ch <= "џ") and not (text[m.start(2)] in "\xa0»”’…—–" and ch not in "àûő"):
            hits.append((m.start(), m.end(), ch))
    hits = [h for h in hits if text[h[0]] in "ãâðñåä"]
    if not any(text[a] in "ãðâ" or len(hits) > 1 for a, _, _ in hits):
        return None
    out, at = [], 0
    for a, z, ch in hits:
        out += [text[at:a], ch]
        at = z
    new = "".join([*out, text[at:]])
    return (new, "lower-cased utf-8 as cp1252") if cost(new) < cost(text) else None


_UPPER = re.compile("Â€[\x80-\xbf‘’‚“”„†‡•…–—˜™š›œžŸ¦¢\"]")


def _upper_layer(text: str) -> tuple[str, str] | None:
    """UTF-8 punctuation read as cp1252 and then upper-cased."""
    if not _UPPER.search(text):
        return None

    def back(m: re.Match) -> str:
        try:
            return ("â" + m[0][1:]).translate(_as_bytes("cp1252")).encode("latin-1").decode("utf-8")
        except UnicodeError:
            return m[0]

    new = _UPPER.sub(back, text)
    return (new, "upper-cased utf-8 as cp1252") if cost(new) < cost(text) else None


_LATIN_RUN = re.compile("[À-ÖØ-öø-ÿ¨¸÷×]{3,}")


# Letters of other scripts by frequency, with the code pages they may have been in.
SCRIPTS = (
    (RUSSIAN, CYRILLIC), ("αοιετσνηυρπκμλςωδγχθφβξζψάίέόήύώ", GREEK), ("יוהלאמתרבשנעדקחפכסגטםןצזךףץ", HEBREW), ("اليمنترودبعهسفكحقجةذشطصخضزىثئظغءأإآؤ", ARABIC),
)


def _points(s: str, letters: str = RUSSIAN) -> float:
    """Points for letters by frequency; capitals that don't begin a word and what is no letter of the script cost some."""
    total = 0.0
    for i, ch in enumerate(s):
        at = letters.find(ch.lower())
        total += -3 if at < 0 else 1.5 - at * 32 / len(letters) / 16
        if at >= 0 and ch.isupper() and i and s[i - 1].islower():
            total -= 3
    return total


def _decoded(run: str, enc: str) -> str | None:
    """A run of characters as the bytes they are in cp1252, strictly decoded."""
    try:
        return run.translate(_as_bytes("cp1252")).encode("latin-1").decode(enc)
    except UnicodeError:
        return None


def _cyrillic_layer(text: str, sure: bool = False) -> tuple[str, str] | None:
    """A script of its own, in a code page of one byte, read as Latin: the code page under which the runs are the most fluent."""
    runs = _LATIN_RUN.findall(text)
    if not runs or max(map(len, runs)) < 5 and len(runs) < 2:
        return None
    sample = " ".join(runs)
    if sum(ch in "ÃÂÐÑ" for ch in sample) > 0.3 * len(sample):  # lead bytes of UTF-8
        return None
    read = [(_points(got.replace(" ", ""), letters) - 0.01 * i - 0.3 * len(got) * got.isupper(), enc, letters) for letters, encs in SCRIPTS for i, enc in enumerate(encs) if (got := _decoded(sample, enc)) is not None]
    if not read:
        return None
    points, enc, letters = max(read)
    if points <= 0 or sure and (points < 0.6 * len(sample) or len(sample) < 15):
        return None
    if letters != RUSSIAN and (points < 0.45 * len(sample) or len(sample) < 12):
        return None

    def back(run: str) -> str:
        got = _decoded(run, enc)
        return run if got is None else got

    def piece(s: str) -> str:
        if not _LATIN_RUN.search(s):
            return s
        if not re.search("[A-Za-z]", re.sub("<[^>]*>", "", s)):
            return re.sub("[\x80-\xff‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ€]+", lambda m: back(m[0]), s)
        return re.sub("(?<![A-Za-z])[À-ÖØ-öø-ÿ¨¸÷×]{3,}(?![A-Za-z])", lambda m: back(m[0]), s)

    new = "".join(piece(s) for s in re.split("(?<=[.!?\n])", text))
    return (new, f"{enc} as cp1252") if new != text else None


FREQUENCY = dict(zip("оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё", (1097, 845, 801, 735, 670, 626, 547, 473, 454, 440, 349, 321, 298, 281, 262, 201, 190, 174, 170, 165, 159, 144, 121, 97, 94, 73, 64, 48, 36, 32, 26, 20, 20), strict=True))
VOWELS = "аеёиоуыэюя"
# Every mix-up of Cyrillic code pages gives capitals in a row or inside words, letters that Russian lacks, or signs beside letters.
_CYRILLIC_ODD = re.compile("[Ѐ-ӿ][А-ЯЁ]|[ЂЃЄЅІЇЈЉЊЋЌЎЏѐђ-џҐґ]|[─-▟]|[Ѐ-ӿ][^\x00-\x7fЀ-ӿ\xa0«»“”„’…–—№]|[^\x00-\x7fЀ-ӿ\xa0«»“”„‘’…–—№][Ѐ-ӿ]")
_CYRILLIC = re.compile("[Ѐ-ӿ─-▟]")
SWITCH = 4.0  # what the start or end of a damaged stretch costs, in nats; less where a text or sentence begins, more inside a word
SURE = 7.0  # what all stretches must gain


@lru_cache(1 << 17)
def _fluency(before: str, ch: str, first: str) -> float:
    """Log odds of a character beyond ASCII in Russian, given the one before and the one before that."""
    low, prev = ch.lower(), before.lower()
    if low not in FREQUENCY:
        if ch in TYPOGRAPHIC or ch == "\xa0":
            return -3.0 if before.isalpha() and ch.isalpha() else -0.5
        return -3.0 if "Ѐ" <= ch <= "ӿ" else -4.0
    points = log(FREQUENCY[low] * 33 / 10000)
    if prev not in FREQUENCY:
        return points - 4 * (low in "ьъы") - (3 if before in TYPOGRAPHIC and before not in "«“„‘—–№" else 0)
    if ch.isupper() and before.islower() or ch.islower() and before.isupper() and first.isupper():
        points -= 4
    if low in "ьъ" and prev in VOWELS + "ьъй" or low == "ы" and prev in VOWELS + "гкхжшчщй" or low == "й" and prev not in VOWELS:
        points -= 3
    if low not in VOWELS + "ьъ" and prev not in VOWELS + "ьъ" and (f := first.lower()) in FREQUENCY and f not in VOWELS + "ьъ":
        points -= 1
    return points


@cache
def _cyrillic_pair(read: str, meant: str) -> dict[str, str]:
    out = {}
    for c, b in _to_byte(read).items():
        try:
            out[chr(c)] = bytes([b]).decode(meant)
        except UnicodeDecodeError:
            pass
    return out


def _cyrillic_pages_layer(text: str) -> tuple[str, str] | None:
    """One Cyrillic code page read as another: the stretches that are better Russian under the other one.

    The best way through two states, as read and as meant, is sought for each pair of code pages, so a stretch may begin
    inside a word and proper words around it stay.
    """
    if not _CYRILLIC.search(text) or not _CYRILLIC_ODD.search(" ".join(_RUNS.findall(text))) or len(re.findall("[Ѐ-ӿ─-▟]", text)) < 4:
        return None
    at = [i for i, ch in enumerate(text) if ch > "\x7f"]
    starts = {m.end() for m in re.finditer("[.!?]\\s+|\n", text)}
    begins = {m.end() for m in re.finditer("[^\\W\\d_],? ", text)}

    def points(s: str, before: str) -> list[float]:
        # A capital in mid-sentence costs some.
        return [_fluency(before[i - 1] if i else " ", s[i], before[i - 2] if i > 1 else " ") - (1.5 if i in begins and s[i].isupper() and s[i + 1 : i + 2].islower() else 0) for i in at]

    now = points(text, text)
    joined = [i > 0 and not {text[i], text[i - 1]} & TYPOGRAPHIC and text[i - 1] > "\x7f" for i in at]
    switch = [SWITCH - 2 * (k == 0 or i in starts) + 2 * joined[k] for k, i in enumerate(at)]
    best: tuple[float, str, str] | None = None
    for read in CYRILLIC:
        for meant in CYRILLIC:
            if read == meant:
                continue
            table = _cyrillic_pair(read, meant)
            other = "".join(ch if ch < "\x80" else table.get(ch, "\ufffd") for ch in text)
            gain = [x - y for x, y in zip(points(other, other), now, strict=True)]
            if sum(g for g in gain if g > 0) <= SURE:
                continue
            # Best gain so far that ends inside or outside a damaged stretch, and whether this character changed between them.
            inside, outside, came = float("-inf"), 0.0, []
            for g, n, x, y, w in zip(gain, now, points(other, text), points(text, other), switch, strict=True):
                enter, leave = outside - w + x - n, inside - w + y - n
                came.append((enter > inside + g, leave > outside))
                inside, outside = max(inside + g, enter), max(outside, leave)
            total = max(inside, outside)
            if total <= SURE or best and total <= best[0]:
                continue
            new, damaged = list(text), inside > outside
            for i, (entered, left) in zip(reversed(at), reversed(came), strict=True):
                if damaged and other[i] != "�" and ("Ѐ" <= other[i] <= "ӿ" or "Ѐ" <= text[i] <= "ӿ"):
                    new[i] = other[i]
                damaged = damaged != (entered if damaged else left)
            best = (total, "".join(new), f"{meant} as {read}")
    return best[1:] if best and best[1] != text else None


_HIGH = set("\x80\x81\x8d\x8f\x90\x9d€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ") | {chr(c) for c in range(0x80, 0xA0)}
_KANA = re.compile("[、。ぁ-ヿ一-鿿]")
_HANGUL, _HAN = re.compile("[가-힣]"), re.compile("[一-鿿、。，！？：；]")
# Frequent syllables and characters, by which Korean and Chinese are known.
KOREAN = set("이다는을가에의하고지은로를서기도사한나어인자리아시그니라해있대것수일요습")
CHINESE = set("的一是不了在人有我他这这个们中来上大为和国地到以说时要就出会可也你对生能而子那得于着下自之年过发后作里用道行所然家种事成方多经么去法学如都同现當没动面起看定天分還还进好小部其这這個們來為國說時會對們過發後裡種經沒動")
_EASTERN = re.compile("(?:[" + "".join(map(re.escape, sorted(_HIGH))) + "][^\x00-\x20]){2}|[\x80-\xffŒœŠšŽžŸƒ€]{4}")


def _fluent(new: str, enc: str, high: int) -> bool:
    """Whether a decoded token is a text in the language of its encoding."""
    wide = [ch for ch in new if ch > "\x7f"]
    part = lambda ok: sum(map(bool, map(ok, wide))) / len(wide)
    if enc in ("cp932", "euc_jp"):
        return len(wide) >= (4 if enc == "euc_jp" else 2) and (enc == "euc_jp" or high >= 2) and part(_KANA.match) > 0.8 and any("ぁ" <= ch <= "ヿ" for ch in wide)
    if enc == "cp949":
        return len(wide) >= 3 and part(_HANGUL.match) > 0.9 and part(KOREAN.__contains__) >= 0.3
    return len(wide) >= 5 and part(_HAN.match) > 0.9 and part(CHINESE.__contains__) >= 0.2


def _east_asian_layer(text: str) -> tuple[str, str] | None:
    if not _EASTERN.search(text):
        return None
    layers = []

    def back(m: re.Match) -> str:
        token = m[0]
        if token.isascii() or "￿" in token.translate(_as_bytes("cp1252")):
            return token
        high = sum(ch in _HIGH for ch in token)
        for enc in EAST_ASIAN:
            new = _decoded(token, enc)
            if new and not new.isascii() and _fluent(new, enc, high):
                layers.append(enc)
                return new
        # Words that are too short to tell alone, where the text around them has told.
        return token

    new = re.sub("[!-\xffŒœŠšŽžŸƒˆ˜–—‘’‚“”„†‡•…‰‹›€™]+", back, text)
    if not layers:
        return None
    if (enc := max(layers, key=layers.count)) in ("cp949", "gbk", "big5"):
        new = re.sub("[^\x00-\x20]*[\x80-\xff‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ€]{2}[^\x00-\x20]*", lambda m: _decoded(m[0], enc) or m[0], new)
    return new, f"{enc} as cp1252"


_NEUTRAL = "’‘'–—…\x85\xa0·\u200d\u200b\xad"
_WORD = re.compile("(?:[A-Za-z]|[^\x00-\x7f])+")
# Where a character beyond ASCII may tell of damage: inside a lower-case word, at its end or start, or a sign before a number.
_INSIDE = re.compile("(?<=[a-z])[^\x00-\x7f](?=[a-z])")
_BEFORE = re.compile("(?<=[a-z])[^\x00-\x7f](?=[à-öø-ÿß][a-z])|(?<![A-Za-z][A-Z])(?<=[A-Z])[^\x00-\x7f](?=[a-z]{2})")
_EDGE = re.compile("(?<=[a-z][a-z])[‚¢\x80-\x84\x86-\x9fÀ-ÖØ-ÞŒŠŽΑ-Ω](?![^\\W\\d_])|(?<![^\\W\\d_])[\x80-\x84\x86-\x9f™](?=[a-z]{2})")
# Signs that have become a letter or another sign, by what stands beside them: what is read, and what it has to be.
_LONE = {
    "ñ": ("(?<![^ ])ñ(?=[0-9])", "±"), "œ": ("(?<![^ (])œ(?=[0-9])", "£"), "ø": ("(?<=[0-9] )ø(?=[CFK]\\b)|(?<=[0-9])ø(?=[CFK]?\\b)|(?<=\\b[Nn])ø(?= ?[0-9])", "°"), "ú": ("(?<![^ \n])ú(?= [0-9]|$)", "·"),
    "æ": ("(?<=[0-9] )æ(?=[AFVWgms]\\b)", "µ"), "§": ("(?<=\\b[Nn])§(?= ?[0-9])", "º"), "¨": ("(?<![^ \n\"(])¨(?=[A-ZÁÉÍÓÚ][a-zà-ÿ])", "¿"),
}
_NUMBER = re.compile("|".join(p for p, _ in _LONE.values()))


# One of those, where no proper lower-case letter or mark of the middle of a word stands.
_WESTERN = re.compile("(?<=[a-z])[^\x00-\x7fß-öø-ÿœšžſ’‘–—…\xa0·\u200d\u200b\xad\u0400-\u1fff\u3000-\uffff](?=[a-zß-öø-ÿ])|(?<=[A-Z])[^\x00-\x7fß-öø-ÿ’‘–—…\xa0](?=[a-z]{2})|" + "|".join(p.pattern for p in (_EDGE, _NUMBER)))


_WEST_SIGN = re.compile("[^\x00-\x7f\u0400-\u1fff\u3000-\uffff]")


def _odd(ch: str) -> bool:
    return (not ch.isalpha() or ch.isupper() or "Ͱ" <= ch < "Ѐ") and ch not in _NEUTRAL


@cache
def _western_pair(read: str, meant: str) -> dict[str, str]:
    """Character as read -> as meant, where that is a letter or sign of Western texts."""
    out = {}
    for c, b in _to_byte(read).items():
        try:
            out[chr(c)] = bytes([b]).decode(meant)
        except UnicodeDecodeError:
            pass
    return {c: x for c, x in out.items() if x in WEST_LOWER or x in WEST_OTHER}


def _western_layer(text: str) -> tuple[str, str] | None:
    """One Western code page read as another: symbols, capitals or Greek stand in lower-case words where letters belong.

    Each word is judged by itself: damaged, proper (it has a letter that damage can't give), or neither. What is neither
    changes anywhere if no word is proper, else only near damaged words, up to the next proper word or end of a sentence.
    What could as well be proper changes only between damaged words, or in a text of several damaged words and no proper one.
    """
    if not _WESTERN.search(" ".join([text[max(0, m.start() - 3) : m.end() + 4] for m in _WEST_SIGN.finditer(text)])):
        return None
    inside = {m.start() for m in _INSIDE.finditer(text)}
    odd = {i for i in inside | {m.start() for m in _BEFORE.finditer(text)} if _odd(text[i])}
    edge = {m.start() for m in _EDGE.finditer(text)}
    number = {m.start() for m in _NUMBER.finditer(text)}
    if not odd and not edge and not number:
        return None
    words = [(m.span(), [i for i in range(*m.span()) if text[i] > "\x7f"]) for m in _WORD.finditer(text) if not m[0].isascii()]
    best: tuple[float, str, str] | None = None
    for read in WESTERN:
        for meant in WESTERN:
            if read == meant:
                continue
            back = _western_pair(read, meant)
            damaged: list[int] = []
            proper: list[int] = []
            strong = 0
            for k, (_, at) in enumerate(words):
                signs = sum(i in odd and back.get(text[i]) in WEST_LOWER or i in edge and back.get(text[i], "-").isalpha() or i in number and back.get(text[i]) == _LONE[text[i]][1] for i in at)
                against = any(i in inside and text[i] not in _NEUTRAL and back.get(text[i]) not in WEST_LOWER for i in at)
                if signs and not against:
                    damaged.append(k)
                    strong += signs
                elif against or any(text[i] in WEST_LOWER and text[i] not in back for i in at):
                    proper.append(k)
            if not damaged:
                continue
            out = list(text)
            for lo, hi in _between(damaged, proper):
                whole = not proper and len(damaged) > 2
                a = 0 if not proper else max([words[lo][0][0] - len(re.split("[.!?\n]", text[: words[lo][0][0]])[-1]), *(words[k][0][1] for k in proper if k < lo)])
                z = len(text) if not proper else min([words[hi][0][1] + len(re.split("[.!?\n]", text[words[hi][0][1] :])[0]), *(words[k][0][0] for k in proper if k > hi)])
                for k, ((w, _), at) in enumerate(words):
                    if not a <= w < z or k in proper:
                        continue
                    for i in at:
                        ch = text[i]
                        quote = ch in "“”" and i not in inside | odd
                        low = ch == "‚" and i and (text[i - 1].isalpha() or text[i - 1] == "'") or ch == "‡" and re.search("^‡[a-z]| ‡[a-z]", text[max(0, i - 1) : i + 2]) or ch == "«" and "»" not in text
                        could = not low and (ch in _NEUTRAL or ch in TYPOGRAPHIC or ch.isalpha() and (ch in WEST_LOWER or ch in WEST_OTHER) and re.search("[a-z]", text[max(0, i - 1) : i + 2]))
                        if ch in back and not quote and (k in damaged or whole or not could or lo < k < hi):
                            out[i] = back[ch]
            new = "".join(out)
            drop = cost(text) - cost(new) + strong
            if drop > 0 and (best is None or drop > best[0]):
                best = (drop, new, f"{meant} as {read}")
    return best[1:] if best else None


def _between(damaged: list[int], proper: list[int]) -> list[tuple[int, int]]:
    """First and last of the damaged words that no proper word parts."""
    out: list[tuple[int, int]] = []
    for k in damaged:
        if out and not any(out[-1][1] < p < k for p in proper):
            out[-1] = (out[-1][0], k)
        else:
            out.append((k, k))
    return out


def _sure_cyrillic_layer(text: str) -> tuple[str, str] | None:
    """Much fluent Russian: tried first, for parts of it may by chance be valid UTF-8 under another code page."""
    return _cyrillic_layer(text, True)


# What no proper text has: lost characters, controls, box drawings, and two scripts within a word.
_LEFT = re.compile("[\ufffd\x80-\x84\x86-\x9f\u2500-\u259f]|[A-Za-zÀ-ÖØ-öø-ɏ][\u0370-\u06ff]|[\u0370-\u06ff][A-Za-zÀ-ÖØ-öø-ɏ]|[\u0370-\u04ff][ÂÃâ€Ð¬°][\u0370-\u04ff]")


def repair(text: str | None) -> Repair:
    """Null, empty and ASCII texts are never garbled. ``restored``: something was changed, and no sign of damage is left.

    Steps are taken until none changes the text, or one would bring back an earlier form of it.
    """
    if not text or text.isascii():
        return Repair(False, False, text, ())
    layers: list[str] = []
    now, seen = text, {text}
    while now:
        for step in (_east_asian_layer, _sure_cyrillic_layer, _utf8_layer, _cyrillic_layer, _cyrillic_pages_layer, _western_layer, _folded_layer, _upper_layer):
            if (got := step(now)) and got[0] not in seen:
                now = got[0]
                seen.add(now)
                layers.append(got[1])
                break
        else:
            break
    return Repair(bool(layers) or "\ufffd" in now, bool(layers) and not _LEFT.search(now), now, tuple(layers))


SCHEMA = "garbled boolean, restored boolean, restored_text string, layers array<string>"


def repair_texts(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with garbled, restored, restored_text and layers. One narrow Arrow pass, no shuffle; ASCII texts skip Python.

    restored_text is the text itself where nothing was found, null for a null text. Columns of those names are replaced.
    """

    @F.pandas_udf(SCHEMA)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            got = [repair(x) for x in s]
            yield pd.DataFrame({"garbled": [g.garbled for g in got], "restored": [g.restored for g in got], "restored_text": [g.text for g in got], "layers": [list(g.layers) for g in got]})

    r = F.when(F.col(text).rlike("[^\\x00-\\x7F]"), run(F.col(text)))
    return df.withColumn("_r", r).withColumns(
        {"garbled": F.coalesce("_r.garbled", F.lit(False)), "restored": F.coalesce("_r.restored", F.lit(False)), "restored_text": F.coalesce("_r.restored_text", F.col(text)), "layers": F.coalesce("_r.layers", F.array().cast("array<string>"))}
    ).drop("_r")
