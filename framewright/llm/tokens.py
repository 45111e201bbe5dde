"""Encoding of a whole corpus with a byte-level BPE vocabulary, long texts in parallel parts that are joined exactly.

A short text is encoded in one narrow Arrow pass. A long text is cut before blanks into pieces that are encoded in different
tasks. A stretch that the vocabulary's pattern leaves whole (a giant run of letters, digits, signs or blanks) is halved until
it is small; its halves are encoded apart and joined up a tree. At a join a window of tokens on both sides is decoded and
encoded anew, and grows until its first tokens equal the left half's and its last tokens the right half's. Then the joined
list is the one encoding of the whole: a list of tokens is a text's BPE encoding exactly if every neighbouring pair is the
encoding of its own text, and outside the window the pairs are as they were.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.plans.tables import ship, stage

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published pre-tokenisation pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG = 8192
PIECE = 4096


@lru_cache(2)
def _encodings(path: str):
    """The vocabulary with its pattern, and without (a text is one unsplit stretch)."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    make = lambda name, pat: tiktoken.Encoding(name, pat_str=pat, mergeable_ranks=ranks, special_tokens={})
    return make("split", PATTERN), make("unsplit", r"[\s\S]+")


@lru_cache(1)
def _pattern():
    import regex

    return regex.compile(PATTERN)


def halves(text: str, size: int) -> list[str]:
    """A stretch halved until no part is longer than ``size``."""
    if len(text) <= size:
        return [text]
    mid = len(text) // 2
    return [*halves(text[:mid], size), *halves(text[mid:], size)]


def pieces(text: str, size: int = PIECE) -> list[tuple[bool, bool, str]]:
    """(goes on the stretch of the piece before, is unsplit, text) in order.

    A piece is a row of whole pattern matches that ends in no blank, since the pattern looks ahead of blanks; or a single
    match, or a part of one, to be encoded unsplit.
    """
    out: list[tuple[bool, bool, str]] = []
    start = blank = 0  # the piece that grows, and where the blank matches at its end begin

    def close(a: int) -> None:
        nonlocal start, blank
        if blank > start:
            out.append((False, False, text[start:blank]))
        out.extend((False, True, x) for x in singles)
        singles.clear()
        start = blank = a

    singles: list[str] = []
    for m in _pattern().finditer(text):
        a, z = m.span()
        if a > start and z - start > size and not singles and (text[a] in " \n" and "!" <= text[a - 1] <= "~" or z - start > 2 * size):
            close(a)
        if z - a > size:
            close(a)
            out += [(i > 0, True, x) for i, x in enumerate(halves(text[a:z], size))]
            start = blank = z
        elif text[z - 1].isspace():
            singles.append(text[a:z])
        else:
            singles.clear()
            blank = z
    close(len(text))
    return out


def join(left: list[int], right: list[int], encode, decode, window: int = 8) -> list[int]:
    """The encoding of the text of both lists, from the encodings of its two parts."""
    k = window
    while True:
        a, b = left[-k:], right[:k]
        new = encode(decode(a) + decode(b))
        agree = min(2, k)
        if (len(left) <= k or new[:agree] == a[:agree]) and (len(right) <= k or new[-agree:] == b[-agree:]):
            return left[: len(left) - len(a)] + new + right[len(b) :]
        k *= 2


def concatenate(parts: list[list[int]], encode, decode) -> list[int]:
    """Join neighbours pairwise until one list is left."""
    while len(parts) > 1:
        parts = [join(parts[i], parts[i + 1], encode, decode) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] if parts else []


def encode_piece(text: str, path: str = VOCABULARY, unsplit: bool = False) -> list[int]:
    return _encodings(path)[unsplit].encode_ordinary(text)


def _bytes_coders(path: str):
    enc = _encodings(path)[1]
    return enc._encode_single_piece if hasattr(enc, "_encode_single_piece") else lambda b: enc.encode_ordinary(b.decode("utf-8")), enc.decode_bytes


def encode_long(text: str, path: str = VOCABULARY, size: int = PIECE) -> list[int]:
    """What the distributed way computes, in one place."""
    return assemble([(on, encode_piece(x, path, whole)) for on, whole, x in pieces(text, size)], path)


def assemble(parts: list[tuple[bool, list[int]]], path: str = VOCABULARY) -> list[int]:
    encode, decode = _bytes_coders(path)
    out: list[int] = []
    stretch: list[list[int]] = []
    for on, ids in parts:
        if not on and stretch:
            out += concatenate(stretch, encode, decode)
            stretch = []
        stretch.append(ids)
    return out + concatenate(stretch, encode, decode)


def _lists(rows: list[list[int]]) -> pa.ListArray:
    return pa.array(rows, pa.list_(pa.int32()))


def encode(df: DataFrame, text: str = "text", ids: str = "ids", vocabulary: str = VOCABULARY, long: int = LONG, piece: int = PIECE) -> DataFrame:
    """``df`` with the list of token ids of each text; a null or empty text has an empty list.

    Strings that look like special tokens are ordinary text. A column named ``ids`` is replaced. Repeated rows stay; a long
    text that occurs often is encoded once. Long and short texts go apart, so a giant text never holds up a task.
    """
    ship(df.sparkSession)
    rest = [c for c in df.columns if c != ids]
    df = df.select(*rest)
    short_schema = T.StructType([*df.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run_short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encodings(vocabulary)[0]
        for b in batches:
            texts = b.column(rest.index(text)).to_pylist()
            got = _lists([enc.encode_ordinary(x) if x else [] for x in texts])
            yield pa.RecordBatch.from_arrays([*b.columns, got], names=[*b.schema.names, ids])

    size = F.coalesce(F.length(text), F.lit(0))
    short = df.where(size <= long).mapInArrow(run_short, short_schema)

    wide = stage(df.where(size > long), "long")  # few, and read twice
    key = F.sha2(F.col(text), 256)
    texts = wide.select(key.alias("_key"), F.col(text).alias("_text")).dropDuplicates(["_key"])

    def run_cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                cut = pieces(t, piece)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k] * len(cut)), pa.array(range(len(cut)), pa.int32()), pa.array([x[0] for x in cut]), pa.array([x[1] for x in cut]), pa.array([x[2] for x in cut], pa.string())], names=["_key", "no", "goes_on", "unsplit", "part"]
                )

    def run_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encs = _encodings(vocabulary)
        for b in batches:
            got = [encs[u].encode_ordinary(x) for u, x in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], _lists(got)], names=["_key", "no", "goes_on", "part_ids"])

    def run_join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = [assemble([(x["goes_on"], x["part_ids"]) for x in sorted(row, key=lambda x: x["no"])], vocabulary) for row in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(whole)], names=["_key", ids])

    cut = texts.mapInArrow(run_cut, "_key string, no int, goes_on boolean, unsplit boolean, part string")
    parts = cut.repartition("_key", "no").mapInArrow(run_parts, "_key string, no int, goes_on boolean, part_ids array<int>")
    whole = parts.groupBy("_key").agg(F.collect_list(F.struct("no", "goes_on", "part_ids")).alias("parts"))
    encoded = whole.mapInArrow(run_join, f"_key string, `{ids}` array<int>")
    return short.unionByName(wide.withColumn("_key", key).join(encoded, "_key").drop("_key"))


def count(df: DataFrame, text: str = "text", n: str = "tokens", **options) -> DataFrame:
    """``df`` with the number of tokens of each text (0 for null and empty)."""
    return encode(df, text, "_ids", **options).withColumn(n, F.size("_ids").cast("long")).drop("_ids")
