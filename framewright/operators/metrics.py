"""Thresholds, confusion counts and the scores made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.plans.scan import OrderedScan


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def threshold_at_fpr(scores: DataFrame, score: str, correct: Column, fpr: float, by: list[str] | None = None) -> DataFrame:
    """The score such that at most ``fpr`` of the correct items lie above it, by group: threshold, n_correct, k.

    With n correct items and k = ceil(fpr * n), it is the k-th largest of their scores, the largest for k = 0. Exact: equal
    scores are counted first, and a running sum over the distinct ones finds the k-th, over all partitions. A group without
    correct items has no row.
    """
    by = by or []
    keys = by or ["_all"]
    items = scores.where(correct & F.col(score).isNotNull()).withColumn("_all", F.lit(0))
    counts = items.groupBy(*keys, F.col(score).alias("_p")).agg(F.count("*").alias("_n")).withColumn("_desc", -F.col("_p"))
    totals = counts.groupBy(*keys).agg(F.sum("_n").alias("n_correct")).withColumn("k", F.ceil(F.col("n_correct") * fpr).cast("long"))
    scan = OrderedScan(counts, keys, ["_desc"], "threshold")
    upto = scan.running(scan.df, {"_upto": (F.col("_n"), "sum")})
    at = F.greatest(F.lit(1), F.least("k", "n_correct"))
    hit = upto.join(totals, keys).where(F.col("_upto") >= at)
    return hit.groupBy(*keys).agg(F.max("_p").alias("threshold"), F.first("n_correct").alias("n_correct"), F.first("k").alias("k")).drop("_all")


def binary_counts(truth: Column, predicted: Column) -> dict[str, Column]:
    return {
        "tp": F.count_if(truth & predicted), "fp": F.count_if(~truth & predicted), "fn": F.count_if(truth & ~predicted), "tn": F.count_if(~truth & ~predicted),
    }


def binary_scores(df: DataFrame, digits: int = 6) -> DataFrame:
    """Add precision, recall, f1 and fpr to tp, fp, fn, tn; 0 where nothing is divided."""
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return df.withColumns({"precision": F.round(p, digits), "recall": F.round(r, digits), "f1": F.round(f1(p, r), digits), "fpr": F.round(ratio(F.col("fp"), F.col("fp") + F.col("tn")), digits)})


def recall_at_fpr(scores: DataFrame, score: str, error: Column, fpr: float, by: list[str] | None = None) -> DataFrame:
    """Threshold at the target rate and what it reaches: an item is predicted an error if its score is at least the threshold."""
    by = by or []
    keys = by or ["_one"]
    scores = scores if by else scores.withColumn("_one", F.lit(0))
    limits = threshold_at_fpr(scores, score, ~error, fpr, keys)
    # Without groups it is one row; the limits of groups are broadcast only if Spark finds them small.
    joined = scores.join(limits if by else F.broadcast(limits), keys)
    counted = joined.where(F.col(score).isNotNull()).groupBy(*by, "threshold").agg(*[c.alias(k) for k, c in binary_counts(error, F.col(score) >= F.col("threshold")).items()])
    return binary_scores(counted)


def index_metrics(truth: Column, predicted: Column, total: Column) -> dict[str, Column]:
    """From two index arrays of a row: counts of the sets; the true negatives are what the total leaves."""
    g, p = F.array_distinct(truth), F.array_distinct(predicted)
    tp, fp, fn = (F.size(x).cast("long") for x in (F.array_intersect(g, p), F.array_except(p, g), F.array_except(g, p)))
    return {"tp": tp, "fp": fp, "fn": fn, "tn": total.cast("long") - F.size(g).cast("long") - fp}


def class_counts(frames: DataFrame, truth: str, predicted: str, classes: int) -> DataFrame:
    """label, tp, predicted, support for the classes 0..classes-1, those without frames too."""
    pairs = frames.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull()).groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    both = pairs.select(F.explode(F.array(F.struct(F.col("t").alias("label"), F.lit(True).alias("real")), F.struct(F.col("p").alias("label"), F.lit(False).alias("real")))).alias("x"), "t", "p", "n")
    hit = F.col("t") == F.col("p")
    n = both.groupBy(F.col("x.label").alias("label")).agg(
        F.sum(F.when(F.col("x.real") & hit, F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(~F.col("x.real"), F.col("n")).otherwise(0)).alias("predicted"), F.sum(F.when(F.col("x.real"), F.col("n")).otherwise(0)).alias("support")
    )
    every = frames.sparkSession.range(classes).select(F.col("id").cast("int").alias("label"))
    return every.join(n, "label", "left").na.fill(0)


def class_scores(counts: DataFrame, digits: int = 6) -> DataFrame:
    p, r = ratio(F.col("tp"), F.col("predicted")), ratio(F.col("tp"), F.col("support"))
    return counts.select("label", F.round(p, digits).alias("precision"), F.round(r, digits).alias("recall"), F.round(f1(p, r), digits).alias("f1"), "support")


def weighted_scores(counts: DataFrame, digits: int = 6) -> DataFrame:
    """accuracy and support-weighted precision, recall and f1 over all frames."""
    p, r = ratio(F.col("tp"), F.col("predicted")), ratio(F.col("tp"), F.col("support"))
    w = lambda x: F.round(ratio(F.sum(x * F.col("support")), F.sum("support")), digits)
    return counts.agg(F.round(ratio(F.sum("tp"), F.sum("support")), digits).alias("accuracy"), w(p).alias("precision"), w(r).alias("recall"), w(f1(p, r)).alias("f1"), F.sum("support").alias("frames"))


def confusion_matrix(frames: DataFrame, truth: str, predicted: str, classes: int) -> DataFrame:
    """A row per actual class, a column p0.. per predicted one; other classes are left out."""
    known = frames.where(F.col(truth).between(0, classes - 1) & F.col(predicted).between(0, classes - 1))
    counts = known.groupBy(F.col(truth).alias("actual")).agg(*[F.count_if(F.col(predicted) == k).alias(f"p{k}") for k in range(classes)])
    every = frames.sparkSession.range(classes).select(F.col("id").cast("int").alias("actual"))
    return every.join(counts, "actual", "left").na.fill(0)


def majority(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """The most frequent label per key, the smallest one of several."""
    n = df.groupBy(*keys, label).agg(F.count("*").alias("_n"))
    return n.groupBy(*keys).agg(F.max_by(label, F.struct("_n", -F.col(label))).alias(label))


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def top_k_per(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")
