"""Overlapping and gapped intervals: merge them into covered periods and list the gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.plans.scan import PID, OrderedScan


def whole_ms(seconds: Column) -> Column:
    """Seconds as whole milliseconds; null for null, NaN and infinite values and for what a BIGINT can't hold."""
    return F.when(seconds.isNotNull() & ~F.isnan(seconds) & (F.abs(seconds) < 9e15), F.round(seconds * 1000).cast("long"))


class Intervals:
    """Half-open integer intervals [start, end) per entity, sorted by start, with the running maximum of the ends before.

    Each start is compared with the running maximum of all earlier ends of its entity: where it is greater, an island
    begins. Intervals of one entity with equal starts are first reduced to the longest (map side), so repeated rows cost
    nothing. Rows with a null entity or bound, and those with end <= start, cover nothing. Empty input gives no periods
    and no gaps. Touching intervals are one period. Extra columns are ignored.
    """

    def __init__(self, df: DataFrame, entity: str, start: str | Column, end: str | Column):
        col = lambda x: F.col(x) if isinstance(x, str) else x
        rows = df.select(F.col(entity).alias("_e"), col(start).cast("long").alias("_s"), col(end).cast("long").alias("_t"))
        rows = rows.where("_e IS NOT NULL AND _s IS NOT NULL AND _t IS NOT NULL AND _t > _s").groupBy("_e", "_s").agg(F.max("_t").alias("_t"))
        self.entity = entity
        self.scan = OrderedScan(rows, ["_e"], ["_s"], "intervals")
        self.rows = self.scan.running(self.scan.df, {"_before": (F.col("_t"), "max")}, exclusive=True)

    def gaps(self, start: str = "gap_start", end: str = "gap_end") -> DataFrame:
        """Each longest uncovered stretch between two covered moments of an entity."""
        return self.rows.where("_before < _s").select(F.col("_e").alias(self.entity), F.col("_before").alias(start), F.col("_s").alias(end))

    def periods(self, start: str = "period_start", end: str = "period_end", n: str | None = None) -> DataFrame:
        """The continuous covered periods; ``n`` counts the distinct starts in each."""
        begins = F.when(F.col("_before").isNull() | (F.col("_before") < F.col("_s")), 1).otherwise(0).cast("long")
        island = self.scan.running(self.rows.withColumn("_begins", begins), {"_island": (F.col("_begins"), "sum")})
        aggs = [F.min("_s").alias(start), F.max("_t").alias(end), *([F.count("*").alias(n)] if n else [])]
        return island.groupBy("_e", "_island").agg(*aggs).select(F.col("_e").alias(self.entity), start, end, *([n] if n else []))
