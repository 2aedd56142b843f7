"""Hand-computed cases and invariants of the core operators."""

import hashlib
import hmac
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import expr
from tessera.functions.text import weak_labels
from tessera.operators import association, donors, evaluation, joins, select, splits, validation
from tessera.operators.curation import Policy
from tessera.sources import readers


def one(df):
    return df.collect()[0]


def test_casts_and_fallbacks(spark):
    df = spark.createDataFrame([("", "2", " 0.5 "), ("abc", "2", "nan"), (None, None, "1")], "a string, b string, c string")
    got = df.select(expr.first_filled(["a", "b"], -1).alias("x"), expr.first_number(["a", "b"], -1).alias("y"), expr.number("c").alias("z")).collect()
    assert [r.x for r in got] == [2.0, -1.0, -1.0]
    assert [r.y for r in got] == [2.0, 2.0, -1.0]
    assert got[0].z == 0.5 and got[1].z != got[1].z


def test_opaque_id_is_hmac(spark):
    got = one(spark.range(1).select(expr.opaque_id("nonce", F.lit("sample")).alias("x"))).x
    assert got == hmac.new(b"nonce", b"sample", hashlib.sha256).hexdigest()[:16]


def test_half_even_and_frame(spark):
    row = one(spark.range(1).select(expr.frame(F.lit(0.25), 10.0).alias("a"), expr.frame(F.lit(0.35), 10.0).alias("b"), expr.timed_id(F.lit("t"), F.lit(3)).alias("c")))
    assert (row.a, row.b, row.c) == (2, 4, "t:3.000")


def test_lexicon(spark):
    df = spark.createDataFrame([("open drawer", "reach"), ("something happens", None), ("", "hold_on"), (None, None)], "a string, b string")
    got = [r.w for r in df.select(weak_labels("a", "b").alias("w")).collect()]
    assert [(w.effect, w.contact, w.valid) for w in got] == [(3, 2, True), (7, 4, False), (2, 1, True), (7, 4, False)]


def test_band_and_overlap(spark):
    t = spark.createDataFrame([("a", 1, 1.0, 1.5)], "g string, id int, s double, e double").withColumn("mid", F.lit(1.25))
    events = spark.createDataFrame([("a", 1.2), ("a", 3.0)], "g string, at double")
    assert [r.at for r in joins.band(t, events, "g", "mid", "at", 0.75).collect()] == [1.2]
    steps = spark.createDataFrame([("a", 0.0, 1.1, "reach"), ("a", 1.1, 2.0, "grasp")], "g string, s2 double, e2 double, step string")
    got = joins.overlapping(t, steps, "g", ("s", "e", "s2", "e2"), 10.0).orderBy(F.desc("overlap")).collect()
    assert [r.step for r in got] == ["grasp", "reach"]


def test_nearest_tolerance_and_tie(spark):
    left = spark.createDataFrame([("a", 1, 10.9), ("a", 2, 11.1), ("a", 3, 9.5)], "g string, id int, t double")
    right = spark.createDataFrame([("a", 10.0, 10), ("a", 9.0, 9)], "g string, at double, frame int")
    got = {r.id: r.frame for r in joins.nearest(left, right, "g", "id", "t", "at", "at", 1.0, ["frame"]).collect()}
    assert got == {1: 10, 3: 9}


def test_donors_share_group_and_gap(spark):
    df = spark.range(40).select((F.col("id") % 2).alias("g"), "id", F.col("id").cast("double").alias("t"))
    pairs = donors.same_group_pairs(df, "g", "id", "t", 2.0, 5.0, [])
    bad = pairs.join(df.select(F.col("id").alias("id_d"), F.col("g").alias("g_d")), "id_d").where("g <> g_d OR gap < 2 OR gap > 5 OR id = id_d")
    assert pairs.count() > 0 and bad.count() == 0
    moved = donors.derangement(df, "g", "id", "s")
    assert moved.where("id = donor").count() == 0 and moved.select("donor").distinct().count() == 40


def test_other_phase_donor(spark):
    df = spark.createDataFrame([("a", 0, 0.0, "X"), ("a", 1, 1.0, "y"), ("a", 2, 2.0, "Z"), ("b", 3, 0.0, "x"), ("b", 4, 1.0, "X")], "g string, id long, t double, p string")
    assert {r.id for r in donors.other_phase(df, "g", "id", "t", "p", 1).collect()} == {0, 1, 2}


def test_selection_counts(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("g"), "id", (F.col("id") % 7).cast("double").alias("s"))
    assert select.time_bins(df, "g", ["id"], "s", 5).groupBy("g").count().where("count = 5").count() == 3
    assert select.evenly_spaced(df, "g", ["id"], 4).count() == 12
    assert select.balanced_allocation(df, "g", "id", 11, "x").count() == 11
    assert select.stratified(df, "g", "id", 10, "x").count() == 10
    assert select.weighted_draw(df, "id", "s", 50, "x").count() == 50


def test_split_has_no_leak(spark):
    df = spark.range(100).select((F.col("id") % 10).alias("g"), "id")
    got = splits.group_split(df, "g", 0.2, "s")
    assert got.where("split = 'heldout'").select("g").distinct().count() == 2
    assert got.groupBy("g").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0


def test_stride_rows(spark):
    df = spark.createDataFrame([("ok", 1.0, 10.0), ("short", 1.0, 1.2)], "k string, s double, e double")
    got = splits.stride_rows(df, "k", "s", "e", 1.0, 0.5, 8).collect()
    assert [r.t for r in got if r.k == "ok"] == [float(i) for i in range(1, 9)]
    assert [(r.t, r.status) for r in got if r.k == "short"] == [(None, "insufficient_duration")]


def test_macro_f1_and_nmi(spark):
    df = spark.createDataFrame(list(zip("abab", "abbb")), "t string, p string")
    assert one(evaluation.macro_f1(df, "t", "p", ["a", "b"])).macro_f1 == pytest.approx((2 / 3 + 0.8) / 2)
    df = spark.createDataFrame(list(zip("aabb", "xxyy")), "t string, p string")
    assert one(association.association(df, "t", "p")).nmi == pytest.approx(1.0)


BOOT_ROWS = [(c, "a", "a" if c % 3 else "b", "b" if c % 2 else "a") for c in range(40)] + [(c, "b", "b", "a") for c in range(0, 40, 4)] + [(90, "x", "y", "x"), (91, None, None, None)]


def boot_counts(at):
    """Macro F1 over a and b of each draw, by hand; 90 and 91 have no label and count as clusters."""
    users = sorted({r[0] for r in BOOT_ROWS}, key=lambda u: (hashlib.sha256(str(u).encode()).hexdigest(), u))
    out = []
    for i in range(20):
        drawn = [users[int(hashlib.sha256(f"s:{i}:{j}".encode()).hexdigest()[:8], 16) % len(users)] for j in range(len(users))]
        rows, f = [(r[1], r[at]) for u in drawn for r in BOOT_ROWS if r[0] == u], []
        for x in "ab":
            tp, fp, fn = (sum(1 for t, g in rows if ((t == x), (g == x)) == k) for k in ((True, True), (False, True), (True, False)))
            f.append(2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0.0)
        out.append(sum(f) / 2)
    return out


def joins_of(df, column):
    """Kinds of the joins on a column in a query's plan."""
    return re.findall(rf"(\w+Join) \[{column}#", df._jdf.queryExecution().executedPlan().toString())


def test_cluster_bootstrap_by_hand_and_without_broadcast(spark):
    df = spark.createDataFrame(BOOT_ROWS, "u long, t string, p string, o string")
    got = evaluation.cluster_bootstrap(df, "u", "t", "p", ["a", "b"], 20, "s")
    assert joins_of(got, "place") == ["SortMergeJoin"]  # draws grow with the clusters
    want, row = boot_counts(2), one(got)
    assert (row.iterations, row.mean) == (20, pytest.approx(sum(want) / 20))
    assert min(want) <= row.low < row.high <= max(want)
    row = one(evaluation.cluster_bootstrap(df.where("false"), "u", "t", "p", ["a", "b"], 20, "s"))
    assert (row.iterations, row.mean, row.low) == (0, None, None)


def test_paired_bootstrap_by_hand_and_without_broadcast(spark):
    df = spark.createDataFrame(BOOT_ROWS, "u long, t string, p string, o string")
    got = evaluation.paired_bootstrap(df, "u", "t", "p", "o", ["a", "b"], 20, "s")
    assert joins_of(got, "place") == ["SortMergeJoin"]
    deltas, row = sorted(a - b for a, b in zip(boot_counts(2), boot_counts(3))), one(got)
    at = 0.025 * 19
    assert row.iterations == 20 and row.low == pytest.approx(deltas[0] + at * (deltas[1] - deltas[0])) and row.high == pytest.approx(deltas[19] - at * (deltas[19] - deltas[18]))
    scores = [one(evaluation.macro_f1(df, "t", x, ["a", "b"])).macro_f1 for x in "po"]
    assert row.delta == pytest.approx(scores[0] - scores[1])


def test_go_rule(spark):
    cols = "a double, b double, c double, low double, seeds boolean, leak double"
    df = spark.createDataFrame([(0.06, 0.04, 0.04, 0.01, True, 0.01), (0.06, 0.04, 0.04, 0.01, True, 0.021)], cols)
    decision, reasons = evaluation.go_decision([F.col(c) for c in "abc"], [0.05, 0.03, 0.03], F.col("low"), F.col("seeds"), F.col("leak"))
    assert [tuple(r) for r in df.select(decision, reasons).collect()] == [("GO", ""), ("NO_GO", "leakage")]


def test_gate_never_passes_nan(spark):
    df = spark.createDataFrame([(float("nan"), 0.0, "min"), (1.0, 0.0, "min"), (None, 0.0, "max")], "v double, t double, d string")
    assert [r.passed for r in evaluation.gates(df, "v", "t", "d").collect()] == [False, True, False]


def test_capability_completion_and_failures(spark):
    df = spark.sql("SELECT map('pose', true, 'other', true) AS m UNION ALL SELECT CAST(NULL AS map<string,boolean>)")
    got = [r.m for r in df.select(validation.completed_capabilities("m", ["pose", "flow"]).alias("m")).collect()]
    assert got == [{"flow": False, "pose": True}, {"flow": False, "pose": False}]
    bad = validation.failures(spark.createDataFrame([("a", 1), ("a", 2), (None, 3)], "k string, v int"), "k", [("big", F.col("v") > 1)])
    assert sorted((r.k or "", r.rule) for r in bad.collect()) == [("", "big"), ("", "missing_key"), ("a", "big"), ("a", "duplicate_key")]


def test_policy_modes():
    p = Policy()
    assert p.mode("strict").main_prob == pytest.approx(0.68) and p.mode("balanced").contact == pytest.approx(0.28)
    assert p.mode("balanced").main_diagnostic == pytest.approx(0.68) and p.mode("policy") is p


def test_readers(spark, tmp_path):
    path = f"file://{tmp_path}/rows.jsonl"
    assert readers.read_jsonl(spark, path, "a int").count() == 0
    (tmp_path / "rows.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert readers.read_jsonl(spark, path, "a int").count() == 2
    (tmp_path / "ids.txt").write_text('u1 extra\n{"take_uid": "u2"}\n\n')
    assert {r.take_uid for r in readers.read_ids(spark, f"file://{tmp_path}/ids.txt").collect()} == {"u1", "u2"}
    (tmp_path / "doc.json").write_text('{"samples": [{"x": 1}, {"x": 2}]}')
    assert readers.read_records(spark, f"file://{tmp_path}/doc.json").count() == 2
    with pytest.raises(ValueError):
        readers.assert_unique(spark.createDataFrame([(1,), (1,)], "k int"), "k")
    a, b = spark.createDataFrame([(1, "x")], "k int, v string"), spark.createDataFrame([(2,)], "k int")
    assert readers.merge_shards([a, b], "k", a.select("k").unionAll(b)).count() == 2
    readers.publish(a, f"file://{tmp_path}/out")
    with pytest.raises(Exception):
        readers.publish(a, f"file://{tmp_path}/out")


def test_streaming_window(spark, tmp_path):
    from tessera.streaming import windows

    spark.read.parquet("/root/testdata/sf0.001/events.parquet").write.parquet(f"file://{tmp_path}/in")
    schema = spark.read.parquet(f"file://{tmp_path}/in").schema
    stream = spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in")
    q = windows.tumbling(stream, "ts", "event_type", "value", "1 day").writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.sql("SELECT sum(n) FROM daily").first()[0] == spark.read.parquet(f"file://{tmp_path}/in").count()


def test_lineage_of_long_chains_and_cycles(spark):
    chain = [(i, i + 1) for i in range(1_000)] + [(1_000, None)]
    cycles = [(2_001, 2_002), (2_002, 2_001), (2_005, 2_005), (2_010, 2_002), (2_011, 2_010)]
    got = {r.node: (r.root, r.depth) for r in joins.lineage(spark.createDataFrame(chain + cycles, "c long, p long"), "c", "p").collect()}
    assert all(got[i] == (1_000, 1_000 - i) for i in range(1_000))
    assert all(got[c] == (None, None) for c, _ in cycles) and len(got) == 1_005
    assert joins.lineage(spark.createDataFrame([], "c long, p long"), "c", "p").count() == 0


def test_weighted_draws_follow_the_weights(spark):
    df = spark.createDataFrame([("a", 1), ("b", 0), ("c", 7), ("d", None)], "id string, w long")
    got = {r.id: r["count"] for r in select.weighted_draw(df, "id", "w", 4_000, "x").groupBy("id").count().collect()}
    assert set(got) == {"a", "c"} and sum(got.values()) == 4_000 and 380 < got["a"] < 620


def test_published_digest(spark):
    got = splits.published_digest(spark.createDataFrame([("b",), (None,), ("a10",), ("a9",)], "id string"), "id").first()
    assert tuple(got) == (3, hashlib.sha256(b"a10\na9\nb\n").hexdigest())
