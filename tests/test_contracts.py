"""Contracts, artifacts, donors, losses and samplers on hand-made rows."""

import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F

from tessera.operators import contracts, enrich, losses, reports, select
from tessera.sources import artifacts, readers

GOOD = ("t1", "A_interaction_rich", "2", "1", "1", "2", "0", "ok", "tokenizer_main")
TAKE = "take_uid string, " + ", ".join(f"{c} string" for c in contracts.TAKE_ENUMS)


def rules(df, key):
    return sorted((r[key], r.rule) for r in df.collect())


def test_take_annotations(spark):
    empty = ("t2", *[None] * 8)
    broken = ("t3", "D_scene_only", "0", "0", "0", "0", "2", "bad", "tokenizer_main")
    rows = spark.createDataFrame([GOOD, empty, broken, broken[:1] + GOOD[1:], (" ", *GOOD[1:])], TAKE)
    got = rules(contracts.take_annotation_failures(rows), "take_uid")
    assert [x for x in got if x[0] == "t2"] == [("t2", f"missing_{c}") for c in sorted(contracts.TAKE_ENUMS)]
    assert {r for k, r in got if k == "t3"} == {
        "duplicate_key", "main_not_interaction_rich", "main_without_signal", "main_with_scene_risk", "main_with_bad_sync", "scene_only_in_training",
    }
    assert ("", "missing_key") in got and not any(k == "t1" for k, _ in got)
    assert not any(k == "t2" for k, _ in rules(contracts.take_annotation_failures(rows, allow_empty=True), "take_uid"))


def test_gold_and_blind_rows(spark):
    gold = "sample_id string, representation_training_valid string, effect_label string, contact_label string, ambiguous_reason string, annotator_id string"
    rows = [("a", "false", "no_effect", "none", "", "x1"), ("b", "0", "ambiguous", "stable", " ", "x1"), ("b", "true", "odd", "often", "", "")]
    got = rules(contracts.gold_failures(spark.createDataFrame(rows, gold)), "sample_id")
    assert got == [("b", r) for r in sorted(["annotator_missing", "duplicate_key", "invalid_contact", "invalid_effect", "reason_missing", "training_valid"])]
    head = "review_id string, image string, " + ", ".join(f"{c} string" for c in contracts.EDITABLE)
    template = spark.createDataFrame([(i, f"{i}.png", "", "", "", "", "") for i in "abc"], head)
    sent = [("a", "a.png", "ambiguous", "none", "hidden", "ann.1", ""), ("b", "x.png", "no_effect ", "none", "why", "a", "n" * 1001), ("d", "d.png", "no_effect", "none", "", "ann.1", "")]
    got = rules(contracts.blind_failures(template, spark.createDataFrame(sent, head), tasks=3, annotator="ann.1"), "review_id")
    assert [r for k, r in got if k == "b"] == ["image_changed", "invalid_annotator", "notes_too_long", "reason_not_blank", "untrimmed_effect_label"]
    assert ("c", "missing_row") in got and ("d", "unexpected_row") in got and ("", "several_annotators") in got
    assert rules(contracts.blind_failures(template.drop("notes"), template), "review_id") == [("template", "columns")]


def test_training_roles(spark):
    rows = spark.createDataFrame([("train",), ("Val",), ("locked-dev",), ("my probe",), ("training",), (None,)], "role string")
    assert sorted(r.role or "" for r in contracts.training_rows(rows, ["role"]).collect()) == ["", "train", "training"]
    with pytest.raises(ValueError, match="may not train"):
        contracts.training_rows(rows, ["role"], drop=False)
    with pytest.raises(ValueError, match="unexpected columns"):
        contracts.assert_columns(rows, ["take"])


def test_masked_losses_ignore_what_the_mask_hides(spark):
    rows = spark.createDataFrame([(1.0, 1.5, 1.0), (0.0, 3.0, 2.0), (9.0, float("nan"), 0.0), (9.0, None, None)], "p double, t double, w double")
    got = rows.agg(*[losses.masked(losses.pointwise(F.col("p"), F.col("t"), x), F.col("w")).alias(x) for x in ("l1", "mse", "smooth_l1")]).first()
    assert got.l1 == (0.5 + 6) / 3 and got.mse == (0.25 + 18) / 3 and got.smooth_l1 == (0.125 + 5) / 3
    assert rows.agg(losses.masked(F.col("p"), F.lit(None).cast("double")).alias("x")).first().x == 0
    assert rows.agg(losses.masked(F.col("p"), F.lit(0.25)).alias("x")).first().x == 0.25 * 19 / 1.0
    with pytest.raises(Exception, match="finite"):
        rows.agg(losses.masked(F.col("p"), F.lit(-1.0)).alias("x")).collect()


def test_cross_entropy_and_schedules(spark):
    one = spark.range(1)
    got = one.select(losses.cross_entropy(F.array(F.lit(1.0), F.lit(2.0), F.lit(1000.0)), F.lit(2)).alias("a"), losses.cross_entropy(F.array(F.lit(0.0), F.lit(0.0)), F.lit(1)).alias("b")).first()
    assert got.a == 0 and math.isclose(got.b, math.log(2))
    steps = spark.range(11).select(*[c.alias(n) for n, c in losses.loss_schedule(F.col("id"), 10).items()], losses.aux_schedule(F.col("id"), 10, 0.4, 0.5, 0.25).alias("aux")).collect()
    assert [r["self"] for r in steps] == [1.0, 1.0] + [0.2] * 9 and math.isclose(steps[1].swap, 0.25) and steps[1].kl == 0 and steps[2].kl == 0.1
    assert steps[5].aux == 0 and math.isclose(steps[6].aux, 0.16) and steps[9].aux == 0.4


def test_motion_losses_of_a_perfect_and_a_still_guess(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], [0.0, 0.0]), (1, [0.0, 3.0], [0.0, 0.0])], "k int, target array<double>, current array<double>")
    perfect = losses.motion_losses(rows.withColumn("recon", F.col("target")), "k").first()
    assert (perfect.plain, perfect.focused, perfect.delta) == (0, 0, 0)
    still = losses.motion_losses(rows.withColumn("recon", F.col("current")), "k").first()
    assert math.isclose(still.plain, 2.5) and still.focused > still.plain and math.isclose(still.delta, 1.25, rel_tol=1e-5)


def test_donors_in_batches(spark):
    rows = spark.createDataFrame([("g", i, float(i)) for i in range(5)] + [("h", 9, 0.0)], "g string, id int, t double")
    got = {r.id: r.donor for r in enrich.cyclic_shift(rows, ["g"], "id", ["t"], 2).collect()}
    assert got == {0: 3, 1: 4, 2: 0, 3: 1, 4: 2, 9: 9}
    assert {r.id: r.donor for r in enrich.cyclic_shift(rows, ["g"], "id", ["t"], 5).collect()}[0] == 4
    members = spark.createDataFrame([(0, 1), (0, 2), (0, 3), (1, 4)], "b int, id int")
    ranked = spark.createDataFrame([(1, 4, 1, 0.9), (1, 2, 2, 0.5), (2, 2, 1, 0.4), (2, 3, 2, -1.0), (4, 1, 1, 1.0)], "id int, donor int, rank int, score double")
    found = {r.id: (r.donor, r.weight) for r in enrich.batch_donors(members, ranked, "b", "id", 2).collect()}
    assert found == {1: (2, 1.0), 2: (3, 0.0), 3: (None, 0.0), 4: (None, 0.0)}
    alone = enrich.action_donors(members.withColumns({"g": F.col("b"), "c": F.array(F.col("id").cast("double")), "a": F.array((F.col("id") * 2).cast("double")), "w": F.lit(1.0)}), ["b", "g"], "id", "c", "a", "w")
    picked = {r.id: (r.donor, round(r.weight, 6)) for r in alone.collect()}
    assert {i: d for i, (d, _) in picked.items()} == {1: 3, 2: 1, 3: 1, 4: 4} and picked[4][1] == 0


def test_lookups(spark):
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "u string")
    weights = spark.createDataFrame([("a", "0.9", 1), ("a", "x", 2), ("b", "3", 1), (" ", "7", 1)], "u string, w string, n int")
    got = {r.u: (r.weight, r.matched) for r in enrich.weight_lookup(keys, weights, "u", "w", "n", floor=0.25).collect()}
    assert got == {"a": (0.25, True), "b": (3.0, True), "c": (0.0, False)}
    with pytest.raises(Exception, match="negative"):
        enrich.quality_index(keys, keys.withColumn("bucket", F.lit("x")), keys.withColumn("weight", F.lit(-1.0)), "u").collect()
    rows = spark.createDataFrame([(1, "same", 5)], "k int, body string, hint int")
    cand = spark.createDataFrame([(1, "same", 9), (1, "same", 1), (1, "same", 20), (1, "other", 5)], "k int, body string, frame int")
    assert tuple(enrich.content_match(rows, cand, "k", "body", "frame", "hint").first()) == (1, 1, 3)


def test_dense_index_and_quota(spark):
    df = spark.createDataFrame([(x,) for x in ("c", "a", None, "b", "a")], "k string").repartition(3)
    assert [tuple(r) for r in select.dense_index(df, "k", "i").orderBy("i").collect()] == [(None, 0), ("a", 1), ("b", 2), ("c", 3)]
    rows = spark.range(400).select((F.col("id") % 3).alias("label"), (F.col("id") % 40).alias("g"), "id")
    got = select.capped_quota(rows, "label", "g", "id", {0: 5, 1: 200}, 2, "s", default=3).groupBy("label").agg(F.count("*").alias("n"), F.max("pick").alias("p")).collect()
    assert sorted(tuple(r) for r in got) == [(0, 5, 5), (1, 133, 133), (2, 3, 3)]


def test_manifest_lines(spark, tmp_path):
    good = {"schema_version": "1", "sample_key": "k1", "sample_id": "s", "take_uid": "t", "split": "train", "row_index": 3, "capability_validity": {"pose": True}}
    path = tmp_path / "m.jsonl"
    path.write_text(json.dumps(good) + "\n\n" + json.dumps(good | {"sample_key": "k2"}) + "\n")
    rows = artifacts.read_manifest(spark, f"file://{path}")
    assert sorted(r.sample_key for r in rows.collect()) == ["k1", "k2"] and rows.columns == readers.MANIFEST.names
    path.write_text(json.dumps(good) + "\n{broken\n")
    with pytest.raises(ValueError, match="broken"):
        artifacts.read_manifest(spark, f"file://{path}")
    path.write_text(json.dumps(good) + "\n" + json.dumps(good) + "\n")
    with pytest.raises(ValueError, match="repeated"):
        artifacts.read_manifest(spark, f"file://{path}")


def test_verified_rows_subsets_and_resume(spark):
    body = "payload"
    rows = spark.createDataFrame([("a", body, hashlib.sha256(body.encode()).hexdigest().upper())], "id string, body string, digest string")
    assert artifacts.verified(rows, "body", "digest").count() == 1
    with pytest.raises(Exception, match="does not match"):
        artifacts.verified(rows.withColumn("body", F.lit("x")), "body", "digest").collect()
    parent = spark.range(10).select(F.col("id").alias("i"), (F.col("id") * 2).alias("v"), F.lit("z").alias("ego_x"))
    wanted = parent.where("i IN (2, 5)")
    assert sorted(r.source_row_index for r in artifacts.verified_rows_at(parent, "i", wanted, ["v"]).collect()) == [2, 5]
    with pytest.raises(ValueError, match="differs"):
        artifacts.verified_rows_at(parent, "i", wanted.withColumn("v", F.lit(0)), ["v"])
    with pytest.raises(ValueError, match="repeated"):
        artifacts.verified_rows_at(parent, "i", wanted.unionAll(wanted), ["v"])
    assert artifacts.view_columns(parent, "ego").columns == ["x"]
    todo = parent.select("i", F.lit("cfg").alias("c"))
    assert artifacts.pending(todo, todo.where("i < 4"), "i", "c").count() == 6 and artifacts.pending(todo, None, "i", "c").count() == 10
    with pytest.raises(ValueError, match="another configuration"):
        artifacts.pending(todo, todo.where("i < 4").withColumn("c", F.lit("old")), "i", "c")


def test_merged_features_and_shapes(spark, tmp_path):
    a = spark.createDataFrame([(2, [1.0, 2.0], "x")], "id int, f array<double>, ck string")
    b = spark.createDataFrame([(1, [1.0, 2.0], "x")], "id int, f array<double>, ck string")
    assert [r.id for r in artifacts.merge_features([a, b], "id", "f", "ck").collect()] == [1, 2]
    with pytest.raises(ValueError, match="checkpoints"):
        artifacts.merge_features([a, b.withColumn("ck", F.lit("y"))], "id", "f", "ck")
    a.unionAll(b).write.parquet(f"file://{tmp_path}/t")
    assert artifacts.table_shape(spark, f"file://{tmp_path}/t") == (2, ["id", "f", "ck"])


def test_files(tmp_path):
    path = tmp_path / "policy.yaml"
    path.write_text("# a policy\nversion: 2\nthresholds:\n  main: 0.5 # share\n  names: [a, 'b']\n  deep:\n    on: true\nlast: 'x y'\n")
    assert artifacts.read_policy(str(path)) == {"version": 2, "thresholds": {"main": 0.5, "names": ["a", "b"], "deep": {"on": True}}, "last": "x y"}
    data, digest = artifacts.snapshot(str(path))
    assert data == path.read_bytes() and digest == hashlib.sha256(data).hexdigest()
    other = tmp_path / "other.yaml"
    other.write_text("{}")
    assert artifacts.resolve([str(tmp_path / "no"), str(path)]) == str(path) and artifacts.read_policy(str(other)) == {}
    assert artifacts.resolve([], str(tmp_path / "*.yaml")) == str(other)
    with pytest.raises(ValueError):
        artifacts.resolve([str(path), str(other)], strict=True)
    with pytest.raises(FileNotFoundError):
        artifacts.resolve([str(tmp_path / "no")])
    artifacts.claim(str(tmp_path / "claim"), {"run": 1})
    with pytest.raises(FileExistsError):
        artifacts.claim(str(tmp_path / "claim"), {"run": 2})


def test_reports(spark):
    df = spark.createDataFrame([("a|b", 1), (None, 2)], "k string, n int")
    assert artifacts.markdown(df, "Keys").splitlines()[2:] == ["| k | n |", "| --- | --- |", "| a\\|b | 1 |", "|  | 2 |"]
    with pytest.raises(ValueError):
        artifacts.markdown(df, "Keys", limit=1)
    got = reports.review_fraction(spark.createDataFrame([("yes", "YES "), ("yes", "no")], "a string, b string"), ["a", "b"], 0.5).first()
    assert (got.n, got.n_passed, got.invalid, got.fraction, got.gate) == (2, 1, 0, 0.5, True)
    assert reports.review_fraction(spark.createDataFrame([("yes", None)], "a string, b string"), ["a", "b"], 0.0).first().gate is False
    order = reports.in_custom_order(spark.createDataFrame([("z",), ("b",), ("a",), (None,)], "k string"), "k", ["b", "z"], "k")
    assert [r.k for r in order.collect()][:2] == ["b", "z"]
    kept = spark.range(2_000).select(enrich.kept_by_hash(0.25, "s", "id").alias("m")).agg(F.avg("m")).first()[0]
    assert 0.7 < kept < 0.8
