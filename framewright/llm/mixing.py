"""Mix sources to target shares of the total size, repeating small sources up to a cap.

The largest total is taken at which every source can give its share within its cap. A document's expected number of copies
falls with its size class, so that a few long documents don't make up a small source; it is capped by max_repeats. Its whole
part is allocated with certainty. The fraction is its inclusion probability in a Pareto order sample: documents are ranked by
random odds divided by inclusion odds and the first ones are taken, until the source's remaining size is reached.
"""

from __future__ import annotations

from collections import defaultdict
from math import floor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.plans.scan import OrderedScan
from framewright.plans.tables import stage

DAMPING = 0.5
SEED = 42


def _copies(classes: list[tuple[float, int, int]], cap: int, budget: float) -> list[float]:
    """Expected copies per size class, min(cap, scale * weight), so that they sum up to the budget. classes: (weight, documents, tokens)."""
    free = sorted((c for c in classes), key=lambda c: -c[0])
    used = 0.0
    scale = 0.0
    for i, (w, _, tokens) in enumerate(free):
        mass = sum(x[0] * x[2] for x in free[i:])
        scale = (budget - used) / mass if mass else 0.0
        if scale * w <= cap:
            break
        used += cap * tokens
    return [min(float(cap), scale * w) for w, _, _ in classes]


def plan(sizes: list[tuple[str, int, int, int]], targets: list[tuple[str, str, float, int]], damping: float = DAMPING, total: float | None = None) -> list[tuple]:
    """(mix, source, size class, copies, budget, certain) from (source, class, documents, tokens) and (mix, source, share, max_repeats).

    ``certain`` is the size of the whole copies of all classes of the source, which leave the rest of the budget to the draw.

    Shares are relative within a mix; sources without tokens can give nothing and are left out of the division. The plan is
    made of one row per source and power of two, so it is small whatever the corpus.
    """
    by_source: dict[str, list[tuple[int, int, int]]] = defaultdict(list)
    for s, c, n, t in sizes:
        by_source[s].append((c, n, t))
    mixes: dict[str, list[tuple[str, float, int]]] = defaultdict(list)
    for m, s, share, cap in targets:
        if s in by_source and share and share > 0 and cap and cap > 0:
            mixes[m].append((s, share, int(cap)))
    out = []
    for m, parts in mixes.items():
        whole = sum(p[1] for p in parts)
        size = min(cap * sum(t for _, _, t in by_source[s]) / (share / whole) for s, share, cap in parts)
        size = min(size, total) if total else size
        for s, share, cap in parts:
            budget = size * share / whole
            classes = [(2.0 ** (-damping * c), n, t) for c, n, t in by_source[s]]
            every = [min(float(cap), x) for x in _copies(classes, cap, budget)]
            certain = sum(floor(x + 1e-9) * t for x, (_, _, t) in zip(every, by_source[s], strict=True))
            out += [(m, s, c, x, budget, certain) for (c, _, _), x in zip(by_source[s], every, strict=True)]
    return out


def mix(documents: DataFrame, targets: DataFrame, key: str = "doc_id", source: str = "source", tokens: str = "tokens", damping: float = DAMPING, total: float | None = None, seed: int = SEED) -> DataFrame:
    """mix_name, doc_id, source, tokens, repeats: the chosen documents of each mix.

    Documents without a source, a key or tokens take no part, nor do targets with a null or non-positive share or cap. Ids
    must be unique. Equal random keys are told apart by the id. ``total`` limits a mix's tokens.
    """
    spark = documents.sparkSession
    size_class = F.floor(F.log2(F.col(tokens))).cast("int")
    # The sources that the targets name are few, as is the plan: a row per mix, source and power of two. Spark broadcasts both if small.
    named = targets.where("target_share > 0 AND max_repeats > 0").select(F.col("source").alias("_s")).distinct()
    documents = documents.join(named, F.col(source) == F.col("_s"), "left_semi")
    docs = documents.where(F.col(source).isNotNull() & F.col(key).isNotNull() & (F.col(tokens) > 0))
    docs = stage(docs.select(F.col(key).alias("k"), F.col(source).alias("s"), F.col(tokens).cast("long").alias("t"), size_class.alias("c")), "sized")
    sizes = [tuple(r) for r in docs.groupBy("s", "c").agg(F.count("*").alias("n"), F.sum("t").alias("t")).toLocalIterator()]
    wanted = [tuple(r) for r in targets.select("mix_name", "source", "target_share", "max_repeats").distinct().toLocalIterator()]
    rows = plan(sizes, wanted, damping, total)
    plan_df = spark.createDataFrame(rows, "mix_name string, s string, c int, copies double, budget double, certain long")
    e = docs.join(plan_df, ["s", "c"])
    sure = F.floor(F.col("copies") + 1e-9).cast("long")
    e = e.withColumns({"sure": sure, "pi": F.greatest(F.col("copies") - sure, F.lit(0.0))})
    u = (F.pmod(F.xxhash64(F.lit(seed), "mix_name", "s", "k"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    odds = (u / (1 - u)) / (F.col("pi") / (1 - F.col("pi")))
    drawn = e.where("pi > 1e-9").select("mix_name", "s", odds.alias("q"), "k", "t", (F.col("budget") - F.col("certain")).alias("left"))
    scan = OrderedScan(drawn, ["mix_name", "s"], ["q", "k"], "pareto")
    upto = scan.running(scan.df, {"upto": (F.col("t"), "sum")})
    # The prefix whose size is nearest to what the certain copies leave.
    extra = upto.where(F.col("upto") - F.col("t") / 2 <= F.col("left")).select("mix_name", "k", F.lit(1).cast("long").alias("n"), "s", "t")
    fixed = e.where("sure > 0").select("mix_name", "k", F.col("sure").alias("n"), "s", "t")
    every = fixed.unionByName(extra).groupBy("mix_name", "k", "s", "t").agg(F.sum("n").alias("repeats"))
    return every.select("mix_name", F.col("k").alias(key), F.col("s").alias("source"), F.col("t").alias("tokens"), "repeats")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """mix_name, source, target_share, share, documents, tokens, most_repeats; a source that gave nothing has a row with 0."""
    wanted = targets.select("mix_name", "source", "target_share").distinct()
    goal = wanted.groupBy("mix_name").agg(F.sum("target_share").alias("goal"))
    n = mixed.groupBy("mix_name", "source").agg(F.count("*").alias("documents"), F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most_repeats"))
    total = n.groupBy("mix_name").agg(F.sum("tokens").alias("total"))
    both = wanted.join(n, ["mix_name", "source"], "left").join(goal, "mix_name").join(total, "mix_name", "left").na.fill(0, ["documents", "tokens", "most_repeats"])
    share = F.when(F.col("total") > 0, F.col("tokens") / F.col("total")).otherwise(0.0)
    return both.select("mix_name", "source", F.round(F.col("target_share") / F.col("goal"), 6).alias("target_share"), F.round(share, 6).alias("share"), "documents", "tokens", "most_repeats")
