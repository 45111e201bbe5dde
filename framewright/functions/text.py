"""Text functions as column expressions. Blanks, words and letters mean the same as in Unicode-aware regular expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"[\t\n\x0B\f\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
SOLID = BLANK.replace("[", "[^", 1)
WORD = r"\p{L}\p{N}_"

# Words and what they are short for.
CONTRACTIONS = {
    "i'm": "i am", "i've": "i have", "i'll": "i will", "i'd": "i would",
    "you're": "you are", "you've": "you have", "you'll": "you will", "you'd": "you would",
    "he's": "he is", "he'll": "he will", "he'd": "he would", "she's": "she is", "she'll": "she will", "she'd": "she would",
    "it's": "it is", "it'll": "it will", "it'd": "it would",
    "we're": "we are", "we've": "we have", "we'll": "we will", "we'd": "we would",
    "they're": "they are", "they've": "they have", "they'll": "they will", "they'd": "they would",
    "that's": "that is", "that'll": "that will", "that'd": "that would",
    "who's": "who is", "who'll": "who will", "who'd": "who would", "what's": "what is", "what'll": "what will", "what'd": "what would",
    "where's": "where is", "where'll": "where will", "where'd": "where would", "when's": "when is", "when'll": "when will", "when'd": "when would",
    "why's": "why is", "why'll": "why will", "why'd": "why would", "how's": "how is", "how'll": "how will", "how'd": "how would",
    "isn't": "is not", "aren't": "are not", "wasn't": "was not", "weren't": "were not", "hasn't": "has not", "haven't": "have not", "hadn't": "had not",
    "doesn't": "does not", "don't": "do not", "didn't": "did not", "won't": "will not", "wouldn't": "would not", "shan't": "shall not",
    "shouldn't": "should not", "can't": "cannot", "couldn't": "could not", "mustn't": "must not", "mightn't": "might not", "needn't": "need not",
    "let's": "let us", "here's": "here is", "there's": "there is", "there'll": "there will", "there'd": "there would",
    "'cause": "because", "'em": "them", "gonna": "going to", "gotta": "got to", "wanna": "want to",
    "coulda": "could have", "woulda": "would have", "shoulda": "should have", "musta": "must have",
    "kinda": "kind of", "sorta": "sort of", "outta": "out of", "lotta": "lot of", "dunno": "do not know", "gimme": "give me", "lemme": "let me",
    "c'mon": "come on", "y'all": "you all", "ma'am": "madam", "o'clock": "of the clock",
}
# Marks that count as nothing in word error rates. Curly quotes are not among them by default.
SKIPPED = "!,?、。！，；？：「」︰『』《》"
PUNCTUATION = SKIPPED + ".;:\"'()[]{}-_/\\@#$%^&*+=<>~`|…—–«»¿¡"
CURLY = "‘’“”"


def blank_trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def collapse(c: Column) -> Column:
    """Runs of blanks become one space, outer ones nothing."""
    return F.regexp_replace(F.regexp_replace(c, f"{BLANK}+", " "), "^ | $", "")


def words(c: Column) -> Column:
    """The stretches without blanks; an empty array for a text without any."""
    return F.filter(F.split(c, f"{BLANK}+"), lambda w: w != "")


def expand_contractions(c: Column, table: dict[str, str] = CONTRACTIONS) -> Column:
    """Lower-cased words, whole ones looked up; a word with a mark on it is not expanded."""
    known = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.array_join(F.transform(words(F.lower(c)), lambda w: F.coalesce(F.try_element_at(known, w), w)), " ")


def remove_punctuation(c: Column, strip_curly: bool = False) -> Column:
    return F.translate(c, PUNCTUATION + CURLY * strip_curly, "")


def normalize_hypothesis(c: Column, strip_curly: bool = False) -> Column:
    return collapse(remove_punctuation(expand_contractions(c), strip_curly))


def strip_tags(c: Column) -> Column:
    """Delete <...>; an unclosed < deletes the rest."""
    return F.regexp_replace(c, "<[^>]*(>|$)", "")


def remove_unnamed(c: Column) -> Column:
    """Drop controls and unassigned or private characters, which have no name. Format characters have one and stay."""
    return F.regexp_replace(c, r"[\p{Cc}\p{Cn}\p{Co}\p{Cs}]", "")


def token_list(tokens: Column, ignore: tuple[str, ...] = (), case_sensitive: bool = False) -> Column:
    """Tokens without unnamed characters and tags, upper-cased unless told otherwise, without ignored and empty ones."""
    t = F.transform(tokens, remove_unnamed)
    t = t if case_sensitive else F.transform(t, lambda x: F.upper(x))
    t = F.filter(t, lambda x: (x != "") & ~x.isin(*ignore)) if ignore else F.filter(t, lambda x: x != "")
    return F.filter(F.transform(t, strip_tags), lambda x: x != "")


def split_tokens(tokens: Column, split: dict[str, list[str]]) -> Column:
    """Replace tokens of the dictionary by their parts."""
    if not split:
        return tokens
    parts = F.create_map(*[x for k, v in split.items() for x in (F.lit(k), F.array(*[F.lit(p) for p in v]))])
    return F.flatten(F.transform(tokens, lambda w: F.coalesce(F.try_element_at(parts, w), F.array(w))))


def char_tokens(c: Column) -> Column:
    """Letters without case (as in Han or kana) one by one; other stretches to the next blank or character beyond ASCII, <...> as one."""
    skip = "".join(SKIPPED).replace("[", "\\[")
    first = rf"[^\p{{Zs}}\p{{Cn}}\t\r\n{skip}]"
    # A stretch begins with one character of any kind and goes on through ASCII.
    pattern = rf"(\p{{Lo}}|<[^>\x{{80}}-\x{{10FFFF}} \t\r\n]*>?|{first}[^\x{{80}}-\x{{10FFFF}} \t\r\n]*>?)"
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(1))


_IGNORED = "&'@℃=.\\-_#+;"


def script_cluster(c: Column) -> Column:
    """Number, Mandarin, English, Japanese, or Other for a mixture or anything else; some signs don't count."""
    t = F.regexp_replace(remove_unnamed(c), f"[{_IGNORED}]", "")
    return (
        F.when(t.rlike(r"^[0-9]+$"), "Number")
        .when(t.rlike(r"^[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{323AF}]+$"), "Mandarin")
        .when(t.rlike(r"^[A-Za-zÀ-ÖØ-öø-ɏḀ-ỿ]+$"), "English")
        .when(t.rlike(r"^[ぁ-ゖ]+$"), "Japanese")
        .otherwise("Other")
    )


def edge_punctuation(c: Column) -> Column:
    return F.regexp_replace(blank_trim(F.lower(c)), f"^[^{WORD}']+|[^{WORD}']+$", "")


def full_punctuation(c: Column, keep_case: bool = False) -> Column:
    blank = BLANK[1:-1]
    return F.regexp_replace(c if keep_case else F.lower(c), f"[^{WORD}{blank}]", "")


def token_text(char: Column, word: Column) -> Column:
    return F.when(F.size(char) > 0, F.array_join(char, "")).otherwise(F.coalesce(word, F.lit("")))


def token_first(char: Column) -> Column:
    return F.coalesce(F.get(char, F.lit(0)), F.lit(""))


def punctuation_only(c: Column) -> Column:
    return ~c.rlike(f"[{WORD}]") & c.rlike(f"[^{WORD}{BLANK[1:-1]}]")


def spoken_reply(c: Column) -> Column:
    c = F.regexp_replace(c, f"{BLANK}+", " ")
    c = F.regexp_replace(c, r"""['"`‘’“”\-‑—–*\[\]{}()\\/_…]+""", " ")
    return blank_trim(F.regexp_replace(c, " +", " "))


def speakable(c: Column) -> Column:
    """Content for speech synthesis, before spelled letters are upper-cased."""
    return blank_trim(F.regexp_replace(F.regexp_replace(c, r"[\-‑…*_\[\]{}()\\/]", " "), " +", " "))


def upper_spelled(c: Column) -> Column:
    """Rows of three or more single letters in capitals, unless a possessive follows."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pattern = re.compile(r"\b(?:[a-zA-Z] ){2,}[a-zA-Z](?!\s+'s\b)")
        for s in batches:
            yield s.map(lambda x: None if x is None else pattern.sub(lambda m: m[0].upper(), x))

    return run(c)


def speech_line(line: Column) -> Column:
    """id<TAB>content with the content made speakable; lines of another form and empty ones pass unchanged."""
    tab = F.instr(line, "\t") > 0
    spaced = line.rlike(rf"^{SOLID}+-round[0-9]+{BLANK}+.+$")
    key = F.when(tab, F.substring_index(line, "\t", 1)).otherwise(F.regexp_extract(line, rf"^({SOLID}+-round[0-9]+){BLANK}+(.+)$", 1))
    content = F.when(tab, F.substring(line, F.instr(line, "\t") + 1, F.length(line))).otherwise(F.regexp_extract(line, rf"^({SOLID}+-round[0-9]+){BLANK}+(.+)$", 2))
    return F.when(tab | spaced, F.concat_ws("\t", key, upper_spelled(speakable(content)))).otherwise(line)


def strip_round(c: Column) -> Column:
    return F.regexp_replace(c, r"^(.+)-round[0-9]+$", "$1")


def prefixed(prefix: str, c: Column) -> Column:
    return F.concat(F.lit(f"{prefix}_"), c)


def remove_dialogue_tags(c: Column) -> Column:
    return F.regexp_replace(c, "</?(unknown|unclear)>|<del>|<FINAL>", "")


def rating(c: Column) -> Column:
    """The last word as a number, 0.0 if it is none."""
    return F.coalesce(F.try_element_at(words(c), F.lit(-1)).try_cast("double"), F.lit(0.0))


def rated(c: Column) -> Column:
    """Whether the last word is a number."""
    return F.try_element_at(words(c), F.lit(-1)).try_cast("double").isNotNull()


def finalized(c: Column) -> Column:
    """A <FINAL> mark, or no mark of uncertainty."""
    return c.contains("<FINAL>") | ~c.rlike("</?unknown>|<del>|</?unclear>")
