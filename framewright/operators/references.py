"""References to records that do not exist, or not yet, or no longer: direct orphans and those that inherit it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.operators.intervals import Intervals
from framewright.plans.tables import stage

FOREVER = (1 << 63) - 1


def micros(ts: Column) -> Column:
    """A timestamp without zone as microseconds since 1970, independent of the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


@dataclass
class Table:
    """A table of the foreign-key graph. Its records are there from ``start`` (null: never) until ``end`` (null or no such
    column: for ever, exclusive); ``at`` is the time at which its own references are judged.

    With ``at`` null in a row, its reference is judged without time: it holds if the record exists at any time.
    """

    name: str
    df: DataFrame
    key: str
    at: str | None = None
    start: str | None = None
    end: str | None = None
    refs: dict[str, str] = field(default_factory=dict)  # column -> name of the table referred to


def available(t: Table, rows: DataFrame) -> DataFrame:
    """key, from, until (microseconds): the disjoint periods in which a record with that key is there.

    Records without an end are reduced to the earliest start, others merged as intervals, so that a key has few rows
    however often it was delivered.
    """
    start = F.coalesce(micros(F.col(t.start)), F.lit(FOREVER)) if t.start else F.lit(-FOREVER)
    if not t.end:
        return rows.where(F.col(t.key).isNotNull()).groupBy(F.col(t.key).alias("_pk")).agg(F.min(start).alias("_from")).withColumn("_until", F.lit(FOREVER))
    ends = F.coalesce(micros(F.col(t.end)), F.lit(FOREVER))
    return Intervals(rows.select(F.col(t.key).alias("_pk"), start.alias("_a"), ends.alias("_z")), "_pk", "_a", "_z").periods("_from", "_until")


def _at(t: Table) -> Column:
    return F.col(t.at).cast("timestamp_ntz") if t.at else F.lit(None).cast("timestamp_ntz")


def orphans(tables: list[Table]) -> DataFrame:
    """ref_table, row_key (string), column, ref_key, at, kind ('direct' or 'inherited'), round: each orphaned row once.

    Direct: no record with the key is available at the row's time. Inherited: there is one, but all such are orphans
    themselves. The first round anti-joins every reference; each later one semi-joins the children of records that the round
    before orphaned, and judges only those by what is left of their parents, until a round finds nothing new. A round only
    adds orphans, so this ends, with a cycle as well. Null references are no orphans. The joins are on the reference, with a
    row or a few per key on the other side, so AQE splits a hot key without repeating much. Repeated rows count once.
    """
    spark = tables[0].df.sparkSession
    by = {t.name: t for t in tables}
    links = [(t, c, by[p]) for t in tables for c, p in t.refs.items()]
    if not links:
        return spark.createDataFrame([], "ref_table string, row_key string, column string, ref_key string, at timestamp_ntz, kind string, round int")

    def judged(t: Table, c: str, parent: DataFrame, touched: DataFrame | None = None) -> DataFrame:
        """The references of a column that hold nowhere in ``parent``, of all rows or of those that refer to touched keys."""
        rows = t.df.where(F.col(c).isNotNull()).select(F.lit(t.name).alias("ref_table"), F.col(t.key).cast("string").alias("row_key"), F.lit(c).alias("column"), F.col(c).alias("_ref"), _at(t).alias("at"))
        if touched is not None:
            rows = rows.join(touched, F.col("_ref").cast("string") == F.col("_tk"), "left_semi")
        when = micros(F.col("at"))
        holds = (F.col("_ref") == F.col("_pk")) & (F.col("at").isNull() | ((F.col("_from") <= when) & (when < F.col("_until"))))
        return rows.join(parent, holds, "left_anti").select("ref_table", "row_key", "column", F.col("_ref").cast("string").alias("ref_key"), "at").distinct()

    def union(parts: list[DataFrame]) -> DataFrame:
        return reduce(lambda a, b: a.unionByName(b), parts)

    sound = {p.name: available(p, p.df) for _, _, p in links}
    r, found = 0, []
    new = stage(union([judged(t, c, sound[p.name]) for t, c, p in links]).withColumns({"kind": F.lit("direct"), "round": F.lit(0)}), "orphans-0")
    while not new.isEmpty():
        found.append(new)
        r += 1
        parts = []
        for t, c, parent in links:
            if not parent.refs:  # nothing in it can be orphaned
                continue
            lost = union([df.where(F.col("ref_table") == parent.name).select("row_key", "at") for df in found])
            touched = new.where(F.col("ref_table") == parent.name).select(F.col("row_key").alias("_tk")).distinct()
            again = judged(t, c, available(parent, _without(parent, lost, touched)), touched)
            known = union([df.where((F.col("ref_table") == t.name) & (F.col("column") == c)) for df in found]).select("row_key", F.col("ref_key").alias("_rk"), F.col("at").alias("_at"))
            old = again.row_key.eqNullSafe(known.row_key) & (F.col("ref_key") == F.col("_rk")) & F.col("at").eqNullSafe(F.col("_at"))
            parts.append(again.join(known.join(touched, F.col("_rk") == F.col("_tk"), "left_semi"), old, "left_anti"))
        if not parts:
            break
        new = stage(union(parts).withColumns({"kind": F.lit("inherited"), "round": F.lit(r)}), f"orphans-{r}")
    return union(found) if found else new


def _without(t: Table, lost: DataFrame, touched: DataFrame) -> DataFrame:
    """A table's rows with touched keys that are no orphans so far."""
    rows = t.df.join(touched, F.col(t.key).cast("string") == F.col("_tk"), "left_semi")
    df = lost.join(touched, F.col("row_key") == F.col("_tk"), "left_semi").select(F.col("row_key").alias("_lk"), F.col("at").alias("_la"))
    return rows.join(df, (F.col(t.key).cast("string") == F.col("_lk")) & _at(t).eqNullSafe(F.col("_la")), "left_anti")


def per_period(found: DataFrame, period: Callable[[Column], Column] | str = "month") -> DataFrame:
    """Number of orphans per table, period of the referring row's time and kind."""
    when = F.date_format("at", "yyyy-MM") if period == "month" else period(F.col("at"))
    return found.groupBy("ref_table", when.alias("period"), "kind").agg(F.count_distinct("row_key").alias("orphans"))


def speech_graph(recordings: DataFrame, segments: DataFrame, predictions: DataFrame) -> list[Table]:
    return [
        Table("recordings", recordings, "rec_id", start="added_at", end="deleted_at"),
        Table("segments", segments, "segment_id", at="created_at", start="created_at", refs={"recording_id": "recordings"}),
        Table("predictions", predictions, "pred_id", at="decoded_at", refs={"file_id": "segments"}),
    ]
