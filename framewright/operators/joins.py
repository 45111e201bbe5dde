"""Joins that can lose rows, with an account of what they lost."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keyed_full_join(left: DataFrame, right: DataFrame, key: str, match: Column | None = None) -> DataFrame:
    """Full outer join on a key with a status: both, left only, right only, or mismatch where ``match`` fails. Null keys are one-sided."""
    a = left.withColumn("_l", F.lit(True))
    b = right.withColumnRenamed(key, "_key").withColumn("_r", F.lit(True))
    j = a.join(b, a[key] == b["_key"], "full_outer").withColumn(key, F.coalesce(key, "_key"))
    status = F.when(F.col("_r").isNull(), "left only").when(F.col("_l").isNull(), "right only")
    status = status.when(~match, "mismatch").otherwise("both") if match is not None else status.otherwise("both")
    return j.withColumn("status", status).drop("_key", "_l", "_r")


def audit(joined: DataFrame, by: list[str] | None = None) -> DataFrame:
    return joined.groupBy(*(by or []), "status").agg(F.count("*").alias("n"))


def inner_all(tables: list[DataFrame], key: str, optional: list[DataFrame] = ()) -> DataFrame:
    """Inner joins on one key, then left joins with the optional tables."""
    df = reduce(lambda a, b: a.join(b, key), tables)
    return reduce(lambda a, b: a.join(b, key, "left"), optional, df)


def last_wins(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row per key, the last in order; order must be total. A partial aggregate, so a hot key is no hot task."""
    rest = [c for c in df.columns if c != key]
    first = F.max(F.struct(F.struct(*order).alias("o"), F.struct(*rest).alias("r")))
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(first.alias("m")).select(key, "m.r.*")


def ids_in_lines(lines: DataFrame, line: str, ids: DataFrame, id_column: str, whole_words: bool = True) -> DataFrame:
    """Lines that hold one of the ids as a word, or anywhere: an exact semi-join in place of a search of every id in every line.

    As a word, the line's words are joined; anywhere, its parts of each length that an id has. An empty id is in no line.
    """
    text = lines.select(line).where(F.col(line).isNotNull()).distinct()
    known = ids.select(F.col(id_column).alias("_w")).where("_w <> ''").distinct()
    if whole_words:
        parts = F.array_distinct(F.split(line, r"[\s,;:=|()\[\]{}\"']+"))
    else:
        lengths = sorted(r[0] for r in known.select(F.length("_w")).distinct().collect())  # at most the length of an id
        of = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(line) - n + 1, F.lit(1))), lambda i: F.substring(F.col(line), i, F.lit(n)))
        parts = F.array_distinct(F.concat(F.array().cast("array<string>"), *[of(n) for n in lengths]))
    hit = text.select(line, F.explode(parts).alias("_w")).join(known, "_w", "left_semi")
    return hit.select(line).distinct()


def assign_resource(df: DataFrame, key: str, resources: list[str], seed: int = 0, k: int = 0, name: str = "resource") -> DataFrame:
    """A resource for each row, drawn by a hash of its key: the same whatever the partitions, and after a retry."""
    at = F.floor(uniform(F.col(key), seed, k) * len(resources))
    return df.withColumn(name, F.get(F.array(*[F.lit(r) for r in resources]), at.cast("int")))


def draw(*parts: Column | int | str) -> Column:
    """A number in [0, 1) from the MD5 of the parts between colons: the same in any engine, on any partition and after a retry."""
    text = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def uniform(key: Column, seed: int, k: int = 0) -> Column:
    return draw(seed, key, k)


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    return df.orderBy(draw(seed, F.col(key)), key)


def fixed_shards(df: DataFrame, key: str, per_file: int = 1000, prefix: str = "part") -> DataFrame:
    """Ids in order, ``per_file`` of them a file: adds shard and file_name. Ranks are counted over partitions, not in one task."""
    from framewright.plans.scan import ranked

    rank = ranked(df.withColumn("_one", F.lit(0)), ["_one"], [key], "_r", "shards").drop("_one")
    shard = F.floor((F.col("_r") - 1) / per_file).cast("int")
    return rank.withColumns({"shard": shard, "file_name": F.format_string(prefix + "_%05d.parquet", shard)}).drop("_r")


def rank_shards(df: DataFrame, key: str, world: int) -> DataFrame:
    """rank, place: row r of the order by key goes to rank r mod ``world``, as its row r div ``world``."""
    from framewright.plans.scan import ranked

    r = ranked(df.withColumn("_one", F.lit(0)), ["_one"], [key], "_r", "ranks").drop("_one")
    return r.withColumns({"rank": F.pmod(F.col("_r") - 1, F.lit(world)), "place": F.floor((F.col("_r") - 1) / world)}).drop("_r")


def padded_batches(df: DataFrame, key: str, values: str, size: int, fill: int) -> DataFrame:
    """batch, padded, mask: ``size`` rows of like length a batch, in the order of length and key, each filled up to its batch's longest."""
    from framewright.plans.scan import ranked

    r = ranked(df.withColumns({"_one": F.lit(0), "_len": F.size(values)}), ["_one"], ["_len", key], "_r", "batches")
    r = r.withColumn("batch", F.floor((F.col("_r") - 1) / size)).drop("_one", "_r")
    widest = F.max("_len").over(Window.partitionBy("batch"))  # a batch has ``size`` rows
    more = F.col("_w") - F.col("_len")
    out = r.withColumn("_w", widest).withColumns({"padded": F.concat(values, F.array_repeat(F.lit(fill), more)), "mask": F.concat(F.array_repeat(F.lit(1), F.col("_len")), F.array_repeat(F.lit(0), more))})
    return out.drop("_w", "_len")


def islands(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Runs of consecutive positions per key: first, last, length. Ranks are counted over partitions, so no key is a hot task."""
    from framewright.plans.scan import ranked

    rows = df.select(*keys, position).where(" AND ".join(f"`{c}` IS NOT NULL" for c in [*keys, position])).distinct()
    g = ranked(rows, keys, [position], "_r", "islands").withColumn("_g", F.col(position) - F.col("_r"))
    return g.groupBy(*keys, "_g").agg(F.min(position).alias("first"), F.max(position).alias("last"), F.count("*").alias("length")).drop("_g")
