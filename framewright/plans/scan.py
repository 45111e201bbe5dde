"""Running values, ranks and prefix sums per key that no hot key can pull into one task.

Rows are range-partitioned by (key, order) - a hot key then spans many partitions - and staged once. Each partition
computes its own running values; what earlier partitions contribute (the carry) is at most one row per partition, since
only the last key of a partition can go on in the next one. That table is broadcast: its rows are bounded by the number of
shuffle partitions, whatever the input's size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.plans.tables import stage

PID = "_fw_pid"
_AGG = {"max": (F.max, lambda a, b: F.greatest(a, b)), "sum": (F.sum, lambda a, b: F.coalesce(a + b, a, b))}


class OrderedScan:
    """Rows of ``df`` in the order (keys, order), staged, for any number of running aggregates.

    ``order`` must be total within a key up to rows that are equal in all columns read later, else ties may fall either way.
    Keys must not be null.
    """

    def __init__(self, df: DataFrame, keys: list[str], order: list[str], name: str = "scan"):
        self.keys, self.order = list(keys), list(order)
        n = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        ranged = df.repartitionByRange(n, *[F.col(c) for c in [*self.keys, *self.order]]).withColumn(PID, F.spark_partition_id())
        self.df = stage(ranged, name)

    def window(self, last: int = 0):
        return Window.partitionBy(PID, *self.keys).orderBy(*self.order).rowsBetween(Window.unboundedPreceding, last)

    def running(self, df: DataFrame, values: dict[str, tuple[Column, str]], exclusive: bool = False) -> DataFrame:
        """Add the running ``max`` or ``sum`` of each value over its key, in order; ``exclusive`` leaves the row itself out (null for the first)."""
        key = F.struct(*[F.col(k) for k in self.keys]) if self.keys else F.struct(F.lit(0).alias("k"))
        totals = df.groupBy(PID, key.alias("_k")).agg(*[_AGG[op][0](v).alias(f"_t_{c}") for c, (v, op) in values.items()])
        ends = totals.groupBy(PID).agg(
            F.min("_k").alias("_first"), F.max("_k").alias("_last"), F.max_by(F.struct(*[f"_t_{c}" for c in values]), "_k").alias("_t")
        )
        # At most one row per partition: a single small task.
        along = Window.partitionBy("_last").orderBy(PID).rowsBetween(Window.unboundedPreceding, 0)
        ends = ends.select(PID, "_first", "_last", *[_AGG[op][0](F.col("_t")[f"_t_{c}"]).over(along).alias(f"_p_{c}") for c, (_, op) in values.items()])
        before = Window.partitionBy(F.lit(0)).orderBy(PID)
        same = F.lag("_last").over(before).eqNullSafe(F.col("_first"))
        carry = ends.select(
            F.col(PID).alias("_cp"), F.col("_first").alias("_ck"), *[F.when(same, F.lag(f"_p_{c}").over(before)).alias(f"_c_{c}") for c in values]
        ).where(reduce(lambda a, b: a | b, [F.col(f"_c_{c}").isNotNull() for c in values]))
        w = self.window(-1 if exclusive else 0)
        out = df.select("*", *[_AGG[op][0](v).over(w).alias(f"_l_{c}") for c, (v, op) in values.items()])
        out = out.join(F.broadcast(carry), (F.col(PID) == F.col("_cp")) & key.eqNullSafe(F.col("_ck")), "left")
        for c, (_, op) in values.items():
            out = out.withColumn(c, _AGG[op][1](F.col(f"_l_{c}"), F.col(f"_c_{c}")))
        return out.drop("_cp", "_ck", *[f"_c_{c}" for c in values], *[f"_l_{c}" for c in values])


def ranked(df: DataFrame, keys: list[str], order: list[str], rank: str, name: str = "rank") -> DataFrame:
    """``row_number`` per key in ``order``, 1-based; ``order`` must be unique within a key."""
    scan = OrderedScan(df, keys, order, name)
    return scan.running(scan.df, {rank: (F.lit(1).cast("long"), "sum")}).drop(PID)
