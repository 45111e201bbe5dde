"""Small files, orphans, intervals and ordered scans: against brute force, with nulls, ties, empty tables and odd columns."""

import datetime as dt
import random

from pyspark.sql import functions as F

from framewright.operators.compaction import Compaction, compaction_plan, reconcile
from framewright.operators.intervals import Intervals, whole_ms
from framewright.operators.joins import fixed_shards, ids_in_lines, islands, keyed_full_join, last_wins
from framewright.operators.metrics import threshold_at_fpr
from framewright.operators.references import Table, orphans, per_period, speech_graph
from framewright.plans.scan import PID, OrderedScan, ranked

T = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)


def test_ordered_scan_against_a_loop(spark):
    rng = random.Random(5)
    rows = [(rng.choice("aaaaaaab"), i, rng.randint(0, 99)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, o int, v int").repartition(5)
    scan = OrderedScan(df, ["k"], ["o"])
    got = {(r.k, r.o): (r.m, r.s, r.b) for r in scan.running(scan.running(scan.df, {"m": (F.col("v"), "max"), "s": (F.col("v"), "sum")}), {"b": (F.col("v"), "max")}, exclusive=True).collect()}
    seen = {}
    for k, o, v in sorted(rows):
        m, s = seen.get(k, (None, 0))
        now = (v if m is None else max(m, v), s + v)
        assert got[k, o] == (*now, m)
        seen[k] = now
    assert scan.df.select(PID).distinct().count() > 2
    assert ranked(df.where("false"), ["k"], ["o"], "r").count() == 0


def covered(rows):
    out = {}
    for e, s, t in rows:
        if e is not None and s is not None and t is not None and t > s:
            out.setdefault(e, set()).update(range(s, t))
    gaps, periods = set(), set()
    for e, ms in out.items():
        a = sorted(ms)
        start = a[0]
        for x, y in zip(a, [*a[1:], None], strict=True):
            if y != x + 1:
                periods.add((e, start, x + 1))
                if y is not None:
                    gaps.add((e, x + 1, y))
                start = y
    return gaps, periods


def test_intervals_against_sets(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["h", "h", "h", "x", None]), rng.choice([None, *range(60)] if i % 9 == 0 else range(60)), rng.randint(-5, 70)) for i in range(120)]
    rows += rows[:10]
    df = spark.createDataFrame([(e, s, t, 1, 2) for e, s, t in rows], "rec string, s long, t long, _s int, _before int")
    iv = Intervals(df.select("rec", "s", "t"), "rec", "s", "t")
    gaps, periods = covered(rows)
    assert {tuple(r) for r in iv.gaps().collect()} == gaps
    assert {tuple(r) for r in iv.periods().collect()} == periods
    assert len(Intervals(df, "rec", "s", "t").periods().collect()) == len(periods)
    assert Intervals(df.where("false"), "rec", "s", "t").gaps().count() == 0


def test_times(one):
    for x, want in ((1.0004, 1000), (None, None), (float("nan"), None), (float("inf"), None), (-0.25, -250)):
        assert one(whole_ms(F.lit(x).cast("double"))) == want


def test_orphans_direct_and_inherited(spark):
    rec = spark.createDataFrame([("r1", "x", T(0), T(5)), ("r1", "x", T(0), T(5)), ("r1", "y", T(8), None), ("r2", "z", None, None)], "rec_id string, audio_path string, added_at timestamp_ntz, deleted_at timestamp_ntz")
    seg = spark.createDataFrame([("s1", "r1", T(1)), ("s2", "r1", T(5)), ("s3", "r1", T(9)), ("s4", None, T(1)), ("s5", "gone", T(1)), ("s6", "r2", T(1)), ("s7", "r1", None), ("s1", "r1", T(1))], "segment_id string, recording_id string, created_at timestamp_ntz")
    pred = spark.createDataFrame([(1, "s1", T(2)), (2, "s1", T(0)), (3, "s2", T(9)), (4, None, T(1)), (5, "nix", T(1)), (5, "nix", T(1)), (6, "s5", None)], "pred_id long, file_id string, decoded_at timestamp_ntz")
    got = {(r.ref_table, r.row_key, r.kind) for r in orphans(speech_graph(rec, seg, pred)).collect()}
    assert got == {("segments", x, "direct") for x in ("s2", "s5", "s6")} | {("predictions", x, "direct") for x in "25"} | {("predictions", x, "inherited") for x in "36"}
    report = {tuple(r) for r in per_period(orphans(speech_graph(rec, seg, pred))).collect()}
    assert ("segments", "2024-01", "direct", 3) in report
    empty = [t.where("false") for t in (rec, seg, pred)]
    assert orphans(speech_graph(*empty)).count() == 0
    assert orphans(speech_graph(empty[0], seg, pred)).where("kind = 'direct' AND ref_table = 'segments'").count() == 6


def test_orphans_in_a_chain_and_a_cycle(spark):
    node = spark.createDataFrame([("a", "missing"), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x")], "id string, up string")
    got = {(r.row_key, r.kind, r.round) for r in orphans([Table("node", node, "id", refs={"up": "node"})]).collect()}
    assert got == {("a", "direct", 0), ("b", "inherited", 1), ("c", "inherited", 2)}
    chain = spark.createDataFrame([(f"k{i}", f"k{i - 1}") for i in range(14)], "id string, up string")
    got = {(r.row_key, r.round) for r in orphans([Table("node", chain, "id", refs={"up": "node"})]).collect()}
    assert got == {(f"k{i}", i) for i in range(14)}


def test_orphans_with_several_parents(spark):
    """A child is an orphan only when all records with its key are; one found late is judged again."""
    a = spark.createDataFrame([("a1",)], "id string")
    b = spark.createDataFrame([("b1", "gone", T(0)), ("b1", "a1", T(1)), ("b2", "gone", T(0)), ("b3", "a1", T(0))], "id string, up string, t timestamp_ntz")
    c = spark.createDataFrame([("c1", "b1", "b2", T(2)), ("c2", "b3", "b1", T(0)), ("c3", "b3", None, T(5))], "id string, one string, two string, t timestamp_ntz")
    graph = [Table("a", a, "id"), Table("b", b, "id", at="t", start="t", refs={"up": "a"}), Table("c", c, "id", at="t", refs={"one": "b", "two": "b"})]
    got = {(r.ref_table, r.row_key, r.column, r.kind) for r in orphans(graph).collect()}
    assert got == {("b", "b1", "up", "direct"), ("b", "b2", "up", "direct"), ("c", "c1", "two", "inherited"), ("c", "c2", "two", "inherited")}


def test_compaction_keeps_every_record_once(spark, tmp_path):
    rng = random.Random(2)
    files = [(f"/arc/d/p{i % 2}/f{i:02d}", rng.choice([10, 40, None]), T(rng.randint(0, 9))) for i in range(20)]
    rows = [(rng.choice(files)[0], i, rng.choice(["s1", "s2", None, f"u{i}"]), rng.choice([1, None])) for i in range(100)]
    rows.append(("/elsewhere", 0, "s1", 1))
    df = spark.createDataFrame(rows, "file_path string, row_idx int, segment_id string, w int").repartition(3)
    manifest = spark.createDataFrame([*files, *files[:3]], "file_path string, n_bytes long, written_at timestamp_ntz")
    plan = compaction_plan(manifest, 100)
    got = plan.collect()
    assert len(got) == 20 and {r.target_dir for r in got} == {"/arc/d/p0", "/arc/d/p1"}
    size = {f: b or 0 for f, b, _ in files}
    by_file = {}
    for r in got:
        by_file[r.target_dir, r.file_no] = by_file.get((r.target_dir, r.file_no), 0) + size[r.file_path]
    assert max(by_file.values()) < 100 + 40
    # However many ranges, the order and the groups are the same.
    same = lambda p: sorted((r.file_path, r.target_dir, r.file_no) for r in p.collect())
    assert same(compaction_plan(manifest, 100, slices=13)) == same(compaction_plan(manifest, 100, slices=1)) == same(plan)
    work = Compaction(df, plan)
    when = {f: t for f, _, t in files}
    best = {}
    for f, i, s, w in rows:
        key = (f not in when, when.get(f, T(0)), f, i)
        best[s, w] = min(best.get((s, w), key), key)
    kept = {(k[2], k[3]) for k in best.values()}
    assert {tuple(r) for r in work.surplus().collect()} == {(f, i) for f, i, _, _ in rows} - kept
    written = work.rewrite(str(tmp_path / "out"))
    assert sorted((r.segment_id or "", r.w or 0) for r in written.collect()) == sorted((s or "", w or 0) for s, w in best)
    assert all(r.whole for r in reconcile(work, written).collect())
    files_of = written.select("target_dir", "out_file", F.input_file_name().alias("f")).distinct().collect()
    assert len({r.f for r in files_of}) == len({(r.target_dir, r.out_file) for r in files_of}) == len(files_of)
    # Files that the manifest lacks: bounded output files, nothing lost.
    lost = Compaction(df, compaction_plan(manifest.where("false"), 100), max_rows=20)
    parts = lost.rewrite(str(tmp_path / "lost")).groupBy("out_file").count().collect()
    assert sum(r["count"] for r in parts) == len(best) and len(parts) > 3 and lost.surplus().count() == len(rows) - len(best)
    none = Compaction(df.where("false"), compaction_plan(manifest.where("false"), 100))
    assert none.surplus().count() == 0 and none.rewrite(str(tmp_path / "none")).count() == 0


def test_joins(spark):
    a = spark.createDataFrame([("1", 5), ("2", 6), (None, 7)], "id string, x int")
    b = spark.createDataFrame([("1", 5), ("2", 9), ("3", 1), (None, 2)], "id string, y int")
    got = sorted((r.id or "", r.status) for r in keyed_full_join(a, b, "id", F.col("x") == F.col("y")).collect())
    assert got == [("", "left only"), ("", "right only"), ("1", "both"), ("2", "mismatch"), ("3", "right only")]
    assert {tuple(r) for r in last_wins(spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), (None, 3, "c")], "k string, o int, v string"), "k", [F.col("o")]).collect()} == {("k", 2, "b")}
    lines = spark.createDataFrame([("u1\tx",), ("u10 y",), ("z",)], "line string")
    assert {r.line for r in ids_in_lines(lines, "line", spark.createDataFrame([("u1",)], "id string"), "id").collect()} == {"u1\tx"}
    assert {tuple(r) for r in islands(spark.createDataFrame([("a", x) for x in (1, 2, 2, 5)], "k string, p int"), ["k"], "p").collect()} == {("a", 1, 2, 2), ("a", 5, 5, 1)}
    shards = fixed_shards(spark.createDataFrame([(f"i{x:02d}",) for x in range(25)], "id string").repartition(4), "id", 10, "n").collect()
    assert {(r.id, r.shard) for r in shards} == {(f"i{x:02d}", x // 10) for x in range(25)} and shards[0].file_name.startswith("n_0000")


def test_threshold_with_ties(spark):
    df = spark.createDataFrame([(p, True) for p in (0.9, 0.8, 0.8, 0.1)] + [(0.95, False)], "p double, ok boolean")
    for fpr, want in ((0.5, (0.8, 4, 2)), (0.0, (0.9, 4, 0)), (1.0, (0.1, 4, 4))):
        assert [tuple(r) for r in threshold_at_fpr(df, "p", F.col("ok"), fpr).collect()] == [want]
    assert threshold_at_fpr(df.where("false"), "p", F.col("ok"), 0.5).count() == 0


def test_recall_at_a_rate_without_groups(spark):
    from framewright.operators.metrics import recall_at_fpr

    df = spark.createDataFrame([(0.9, True), (0.8, False), (0.7, True), (0.1, False)], "p double, bad boolean")
    (r,) = recall_at_fpr(df, "p", F.col("bad"), 0.5).collect()
    assert (r.threshold, r.tp, r.fp, r.fn, r.tn) == (0.8, 1, 1, 1, 1)
