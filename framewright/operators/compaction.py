"""Far too many small files: plan few well-sized ones, rewrite every record once and reconcile the counts.

Planning is SQL only. The manifest is frozen (one row per path, written down), in the order of target directory and path, cut
into ranges; a window sums the bytes before each file within its range, and another one the ranges' totals, so the order is
that of the paths at any size and no window sees more than a range. A file belongs to the output file in whose interval of
``target_bytes`` its first byte falls.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.plans.tables import stage, staged_path

FREEZE = """
SELECT *, spark_partition_id() AS slice FROM (
  SELECT /*+ REPARTITION_BY_RANGE({slices}, target_dir, file_path) */ * FROM (
    SELECT file_path, coalesce(regexp_extract(file_path, '{pattern}', 1), '') AS target_dir, min(written_at) AS written_at,
           coalesce(max(CASE WHEN n_bytes >= 0 THEN n_bytes END), (SELECT cast(ceil(avg(n_bytes)) AS BIGINT) FROM {manifest} WHERE n_bytes >= 0), 0) AS n_bytes
    FROM {manifest} WHERE file_path IS NOT NULL GROUP BY file_path))
"""
PLAN = """
WITH summed AS (
  SELECT *, sum(n_bytes) OVER (PARTITION BY target_dir, slice ORDER BY file_path ROWS UNBOUNDED PRECEDING) - n_bytes AS before FROM {frozen}),
offsets AS (
  SELECT target_dir, slice, sum(total) OVER (PARTITION BY target_dir ORDER BY slice ROWS UNBOUNDED PRECEDING) - total AS skipped
  FROM (SELECT target_dir, slice, sum(n_bytes) AS total FROM {frozen} GROUP BY target_dir, slice))
SELECT s.file_path, s.n_bytes, s.written_at, s.target_dir, (s.before + o.skipped) DIV {target_bytes} AS file_no
FROM summed s JOIN offsets o ON s.target_dir = o.target_dir AND s.slice = o.slice
"""


def compaction_plan(manifest: DataFrame, target_bytes: int = 128 << 20, dir_pattern: str = "^(/[^/]*/[^/]*/[^/]*)/", slices: int | None = None) -> DataFrame:
    """file_path, n_bytes, written_at, target_dir, file_no: which output file takes which input file.

    ``dir_pattern``'s first group is the directory within which files may be merged; a path without it goes to ''. Null and
    negative sizes count as the mean of the others, repeated paths once, null paths not at all; an empty manifest gives an
    empty plan. An output file gets less than ``target_bytes`` plus one input file.
    """
    spark = manifest.sparkSession
    n = max(1, slices or int(spark.conf.get("spark.sql.shuffle.partitions")))
    frozen = spark.sql(FREEZE.replace("{pattern}", dir_pattern).replace("{slices}", str(n)), manifest=manifest.select("file_path", "n_bytes", "written_at"))
    return spark.sql(PLAN.replace("{target_bytes}", str(int(target_bytes))), frozen=stage(frozen, "frozen"))


class Compaction:
    """Stored records (file_path, row_idx unique) put through a plan.

    Records are copies if they agree in every other column, nulls alike. The copy whose file was written first stays (files
    without a time last), then the smallest file_path and row_idx. Copies meet by the SHA-256 of their content, so contents
    are not shuffled; they are reduced by a partial aggregate, and the rest is taken away by the unique (file_path, row_idx),
    so neither a hot content nor a hot file meets in one task. The join with the plan has one plan row per file, and AQE splits
    a file that holds a great part of all rows. Records of a file that the manifest lacks count as written last; they go to
    files of at most ``max_rows`` records or so, with negative numbers, in target directory ''.
    """

    def __init__(self, rows: DataFrame, plan: DataFrame, path: str = "file_path", idx: str = "row_idx", max_rows: int = 1_000_000):
        self.path, self.idx, self.max_rows = path, idx, max_rows
        self.content = [c for c in rows.columns if c not in (path, idx)]
        self.plan = plan
        known = plan.select(F.col("file_path").alias("_p"), F.col("written_at").alias("_w"), F.col("target_dir").alias("_dir"), F.col("file_no").alias("_no"))
        self.rows = rows.join(known, F.col(path) == F.col("_p"), "left").drop("_p").withColumn("_dir", F.coalesce("_dir", F.lit("")))
        # Nulls sort first in a struct, hence the flag.
        first = F.min(F.struct(F.col("_w").isNull().alias("late"), F.col("_w").alias("w"), F.col(path).alias("p"), F.col(idx).alias("i")))
        digest = F.unhex(F.sha2(F.to_json(F.struct(*self.content)), 256))
        self.kept = self.rows.groupBy(digest.alias("_digest")).agg(first.alias("_first")).select(F.col("_first.p").alias("_kp"), F.col("_first.i").alias("_ki"))

    def _of(self, how: str) -> DataFrame:
        return self.rows.join(self.kept, F.col(self.path).eqNullSafe(F.col("_kp")) & F.col(self.idx).eqNullSafe(F.col("_ki")), how)

    def surplus(self) -> DataFrame:
        """(file_path, row_idx) of the copies that the rewritten files don't hold."""
        return self._of("left_anti").select(self.path, self.idx)

    def records(self) -> DataFrame:
        """Every record once, with the output file that takes it."""
        unknown = self.rows.where("_no IS NULL").count()
        at = -1 - F.pmod(F.xxhash64(self.path, self.idx), F.lit(max(1, ceil(unknown / self.max_rows))))
        return self._of("left_semi").select(F.col("_dir").alias("target_dir"), F.coalesce("_no", at).alias("file_no"), *self.content)

    def rewrite(self, out: str | None = None) -> DataFrame:
        """Write the output files below ``out`` (else the shared folder), a folder per target directory, and read them again.

        Output files are numbered through, and each is the one file of one task, whose size is bounded by the plan. Only the
        numbers of files per target directory come to the driver.
        """
        spark = self.rows.sparkSession
        records = self.records()
        path = out or staged_path(spark, "compacted")
        bounds = self.plan.groupBy("target_dir").agg(F.max("file_no").alias("hi")).toLocalIterator()
        counts = {r.target_dir: r.hi + 1 for r in bounds}
        lost = max(1, ceil(self.rows.where("_no IS NULL").count() / self.max_rows))
        starts, n = [], lost
        for d in sorted(counts):
            starts.append((d, n))
            n += counts[d]
        places = spark.createDataFrame(starts, "target_dir string, _start long")
        numbered = records.join(places, "target_dir", "left").withColumn("out_file", F.when(F.col("file_no") < 0, -1 - F.col("file_no")).otherwise(F.col("_start") + F.col("file_no")).cast("int")).drop("_start")
        sorted_ = numbered.repartitionById(n, "out_file").sortWithinPartitions("target_dir", *[c for c in self.content if not dict(records.dtypes)[c].startswith("map")])
        sorted_.write.partitionBy("target_dir").parquet(path)
        return spark.read.schema(numbered.schema).parquet(path)


def reconcile(work: Compaction, written: DataFrame) -> DataFrame:
    """Per target directory: files and records before, copies left out, files and records after; ``whole`` if nothing was lost or doubled."""
    before = work.rows.groupBy(F.col("_dir").alias("target_dir")).agg(F.count("*").alias("records_in"), F.count_distinct(work.path).alias("files_in"))
    after = written.groupBy("target_dir").agg(F.count("*").alias("records_out"), F.count_distinct("out_file").alias("files_out"))
    gone = work._of("left_anti").groupBy(F.col("_dir").alias("target_dir")).agg(F.count("*").alias("copies"))
    both = before.join(after, "target_dir", "full").join(gone, "target_dir", "left").na.fill(0)
    return both.withColumn("whole", F.expr("records_in = records_out + copies"))
