"""One consistent form for texts that look the same but differ in their characters.

Look-alike classes are the transitive closure, by union-find, of single relations over code points and strings: width and form
variants and ligatures with what they stand for (by the compatibility rules of Unicode), blanks with the plain blank,
invisible characters with nothing, letters of other scripts with the letters they look like, and strings that make up one
letter (a letter and a stroke or dot laid over it, two letters drawn as a ligature) with that letter. The representative of a
class is its most frequent member in the corpus. Texts are decomposed, rewritten from left to right by a multi-pattern
automaton that takes the longest match, again as long as that changes anything, and composed. A string and its short form
(three dots and an ellipsis) first become the string, so that it does not matter where the short form began, and then what is
the more frequent. Case, accents and words stay.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters of other scripts that are drawn like the letter after them.
OTHER_SCRIPTS = """
аa еe оo рp сc уy хx ѕs іi јj һh ԁd ԛq ԝw ӏl ҽe ѵv
АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT ХX ҮY ԚQ ԜW ӀI ԌG ѴV
οo ρp νv ϳj ϲc
ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC ͿJ
օo սu հh զq ոn ցg ՏS ՍU ՕO ԼL
ɡg ɑa ıi ƽs ᴏo ᴄc ᴠv ᴡw ᴢz ѡw ꞌ' ꓮA ꓐB ꓚC ꓓD ꓰE ꓝF ꓖG ꓧH ꓲI ꓙJ ꓗK ꓡL ꓟM ꓠN ꓳO ꓑP ꓣR ꓢS ꓔT ꓴU ꓦV ꓪW ꓫX ꓬY ꓜZ
ᎪA ᏴB ᏟC ᎠD ᎬE ᏀG ᎻH ᎫJ ᏦK ᏞL ᎷM ᏢP ᎡR ᏚS ᏙV ᎳW ᏃZ ᎢT
ⲂB ⲈE ⲎH ⲒI ⲔK ⲘM ⲚN ⲞO ⲟo ⲢP ⲣp ⲤC ⲥc ⲦT ⲨY ⲬX ⲭx
ǀ| ∣| ׀| ꓸ. ܁. ꓽ: ׃: ։: ꞉:
ヘへ 二ニ 八ハ 工エ 力カ 夕タ 卜ト 口ロ
"""
# Strings that are drawn like the letter after them.
STRINGS = (("i̇", "i"), ("ı̇", "i"), ("j̇", "j"), ("ȷ̇", "j"), ("וו", "װ"), ("וי", "ױ"), ("יי", "ײ"), ("||", "ǁ"))
FOLD = "\x00"  # marks patterns of the second step, in which strings become their short forms
VISIBLE_FORMS = ("<super>", "<sub>", "<circle>", "<fraction>", "<square>")  # forms that a reader tells apart
INVISIBLE = re.compile("[\\u034f\\u115f\\u1160\\u17b4\\u17b5\\u180b-\\u180f\\u3164\\ufe00-\\ufe0f\\uffa0\\U000e0100-\\U000e01ef]")
COUNTED_STRINGS = ("ff", "fi", "fl", "ffi", "ffl", "st", "ij", "IJ", "..", "...", "!!", "??", "?!", "!?", "°C", "No", "TM", "||")


def seeds(confusables: str | None = None) -> list[tuple[str, str]]:
    """Single relations of letters and strings; those of a file in the format of Unicode's confusables (hex ; hex ; ...) as well."""
    out = [(w[0], w[-1]) for w in OTHER_SCRIPTS.split()] + list(STRINGS) + _strokes()
    if confusables:
        with open(confusables, encoding="utf-8-sig") as f:
            for line in f:
                parts = [p.split() for p in line.split("#")[0].split(";")[:2]]
                if len(parts) == 2 and all(parts):
                    out.append(tuple("".join(chr(int(x, 16)) for x in p) for p in parts))
    return out


@lru_cache(1)
def _strokes() -> list[tuple[str, str]]:
    """A Latin letter with a short or long stroke laid over it, and the letter that is named so."""
    out = []
    for n in range(0xC0, 0x250):
        name = unicodedata.name(chr(n), "")
        if name.startswith("LATIN ") and name.endswith(" WITH STROKE") and len(name.split()) == 6 and len(name.split()[3]) == 1:
            base = unicodedata.lookup(name.removesuffix(" WITH STROKE"))
            out += [(base + "\u0335", chr(n)), (base + "\u0338", chr(n))]
    return out


def invisible(ch: str) -> bool:
    return unicodedata.category(ch) == "Cf" or bool(INVISIBLE.match(ch))


def stands_for(ch: str) -> str:
    """What a code point is a form of, decomposed; itself if of nothing."""
    if invisible(ch):
        return ""
    if unicodedata.category(ch) == "Zs" or ch in "\t\n\r\v\f\x85  ":
        return " "
    if unicodedata.decomposition(ch).startswith(VISIBLE_FORMS):
        return ch
    return "".join(" " if unicodedata.category(x) == "Zs" else x for x in unicodedata.normalize("NFKD", ch) if not invisible(x))


class Classes:
    """Union-find over strings and code points. Its size is bounded by Unicode, not by the corpus."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def union(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def groups(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = defaultdict(list)
        for x in self.parent:
            out[self.find(x)].append(x)
        return out


def rewriting(frequency: dict[str, int], confusables: str | None = None) -> dict[str, str]:
    """pattern -> what takes its place, for all members of classes that change. ``frequency`` names what occurs in the corpus.

    Patterns are code points and strings. Those that begin with FOLD belong to the second step.
    """
    classes = Classes()
    for a, b in seeds(confusables):
        classes.union(unicodedata.normalize("NFD", a), unicodedata.normalize("NFD", b))
    for ch in {c for x in frequency for c in x}:
        for x in unicodedata.normalize("NFD", ch):
            if (form := stands_for(x)) != x:
                classes.union(x, form)
    chosen: dict[str, str] = {}
    short: dict[str, str] = {}
    often = lambda m: frequency.get(unicodedata.normalize("NFC", m), 0) or frequency.get(m, 0)
    for members in classes.groups().values():
        letters = [m for m in members if len(m) == 1 and stands_for(m) == m]
        if "" in members or " " in members:
            best = "" if "" in members else " "
        elif letters:
            best = max(letters, key=lambda m: (often(m), m < "\x80", m))
            if not often(best) and any(len(m) > 1 for m in members):
                best = max((m for m in members if len(m) > 1), key=lambda m: (often(m), len(m), m))
        else:  # only a string and its short forms
            best = max(members, key=lambda m: (len(m), often(m), m))
            most = max(members, key=lambda m: (often(m), m == best, m))
            if most != best:
                short[best] = most
        chosen |= dict.fromkeys(members, best)
    patterns = {m: r for m, r in chosen.items() if m and m != r}
    # Strings are met in the form that their letters have got, too.
    one = {ord(m): r for m, r in patterns.items() if len(m) == 1}
    for m in [m for m in chosen if len(m) > 1]:
        if (now := m.translate(one)) != m and now != chosen[m]:
            patterns.setdefault(now, chosen[m])
    first = frozenset(patterns.items())
    out = {m: r for m, r in ((m, _stable(r, first)) for m, r in patterns.items()) if m != r}
    return out | {FOLD + x: r for m, r in short.items() if (x := _stable(m, first)) != r}


@lru_cache(4)
def _automaton(patterns: frozenset[tuple[str, str]], fold: bool = False):
    import ahocorasick

    a = ahocorasick.Automaton()
    for p, r in patterns:
        if p.startswith(FOLD) == fold:
            p = p.removeprefix(FOLD)
            a.add_word(p, (len(p), r))
    if len(a):
        a.make_automaton()
    return a


def _rewritten(s: str, automaton) -> str:
    """One pass from left to right, the longest match first."""
    if not len(automaton):
        return s
    out, at = [], 0
    for end, (n, r) in automaton.iter_long(s):
        out += [s[at : end + 1 - n], r]
        at = end + 1
    return "".join([*out, s[at:]]) if out else s


def _stable(s: str, patterns: frozenset[tuple[str, str]]) -> str:
    """Rewritten until nothing changes. A pass leaves no pattern where it was, so what can change shrinks; a form that comes back ends it."""
    automaton, seen = _automaton(patterns), set()
    while s not in seen:
        seen.add(s)
        s = _rewritten(s, automaton)
    return s


@lru_cache(4)
def _plain(patterns: frozenset[tuple[str, str]]) -> bool:
    """Whether a text in ASCII stays as it is, but for blanks."""
    return not any(p.removeprefix(FOLD).isascii() and p not in "\t\n\r\v\f" for p, _ in patterns)


def consistent(text: str, patterns: frozenset[tuple[str, str]]) -> str:
    """A text in the consistent form; rows of blanks count as one, outer blanks as none."""
    if not text.isascii() or not _plain(patterns):
        text = _rewritten(_stable(unicodedata.normalize("NFD", text), patterns), _automaton(patterns, True))
    return " ".join(unicodedata.normalize("NFC", text).split())


def frequencies(texts: DataFrame, column: str) -> DataFrame:
    """member, n: how often each code point and each counted string occurs. Batches are counted in Python before the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            joined = "\x00".join(x for x in b[column] if x)
            n = Counter(joined) + Counter({s: joined.count(s) for s in COUNTED_STRINGS})
            n.pop("\x00", None)
            yield pd.DataFrame({"member": list(n), "n": list(n.values())})

    return texts.select(column).where(F.col(column).isNotNull()).mapInPandas(run, "member string, n long").groupBy("member").agg(F.sum("n").alias("n"))


def corpus_patterns(texts: Iterable[DataFrame], column: str = "text", confusables: str | None = None) -> frozenset[tuple[str, str]]:
    """The rewriting for a corpus: its inventory has at most a row per code point, whatever the corpus's size."""
    total: Counter = Counter()
    for df in texts:
        total.update({r.member: r.n for r in frequencies(df, column).toLocalIterator()})
    return frozenset(rewriting(total, confusables).items())


def with_consistent(df: DataFrame, columns: dict[str, str], patterns: frozenset[tuple[str, str]]) -> DataFrame:
    """``df`` with each text column's consistent form under the given name; null stays null, empty stays empty."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: None if x is None else consistent(x, patterns))

    return df.withColumns({new: run(F.col(old)) for old, new in columns.items()})


def same_looking(recog: DataFrame, transcription: DataFrame, patterns: frozenset[tuple[str, str]]) -> DataFrame:
    """recog_id of recognised texts that look like their utterance's transcription without being equal to it.

    Null and empty texts and null ids are no cases; repeated rows count once; an utterance with several transcriptions is a
    case if one of them looks the same. Only pairs that differ go to Python.
    """
    r = recog.where("utt_id IS NOT NULL AND text <> ''").select("recog_id", "utt_id", F.col("text").alias("_h")).distinct()
    t = transcription.where("utt_id IS NOT NULL AND text <> ''").select("utt_id", F.col("text").alias("_r")).distinct()
    pairs = with_consistent(r.join(t, "utt_id").where("_h <> _r"), {"_h": "_hc", "_r": "_rc"}, patterns)
    return pairs.where("_hc = _rc").select("recog_id").distinct()
