"""Bindings of assignment, agreement, motion and masked losses.

The vectors of the embeddings are two views of 32 components, each four slots of eight codes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import losses as L
from .metrics import _COUNTS, _LABELS, ITERATIONS, PAIRED, TYPES, paired
from .tables import EVENTS_SQL, events, r6, read

EV = f"ev AS ({EVENTS_SQL})"


def _double(c: str) -> F.Column:
    return F.transform(c, lambda x: x.cast("double"))


def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(view, sample, group, slot, probs, code): softmax of 8 x over each slot's components."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample"), F.col("label").alias("group"), _double("embedding").alias("v"))
    e = e.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(7))))
    e = e.select("sample", "group", F.when(F.col("at") < 4, "ego").otherwise("exo").alias("view"), (F.col("at") % 4).alias("slot"), F.transform(F.slice("v", F.col("at") * 8 + 1, 8), lambda x: F.exp(8.0 * x)).alias("x"))
    total = F.aggregate("x", F.lit(0.0), lambda a, x: a + x)
    e = e.withColumn("t", total).select("sample", "group", "view", "slot", F.transform("x", lambda x: x / F.col("t")).alias("probs"))
    return e.withColumn("code", (F.array_position("probs", F.array_max("probs")) - 1).cast("int"))


ASSIGN = """e0 AS (SELECT vec_id AS sample, label AS grp, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
e1 AS (SELECT sample, grp, CASE WHEN a < 4 THEN 'ego' ELSE 'exo' END AS view, a % 4 AS slot, list_transform(v[a * 8 + 1:a * 8 + 8], lambda x: exp(8e0 * x)) AS x FROM e0, range(8) r(a)),
s AS (SELECT sample, grp, view, slot, list_transform(x, lambda y: y / list_sum(x)) AS probs, list_position(x, list_max(x)) - 1 AS code FROM e1),
lg AS (SELECT sample, grp, view, slot, c, probs[c + 1] AS p FROM s, range(8) r(c))"""


def usage_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.usage_losses(assignments(spark, sf_dir), 8, entropy_target=0.5, max_fraction=0.126).select("loss", r6("value", "value"))


_H = "-sum(greatest(p, 1e-8) * ln(greatest(p, 1e-8)))"
_SHORT = "pow(greatest(ln(6e0) - h, 0e0), 2) / ln(8e0)"
USAGE_LOSSES_SQL = f"""WITH {ASSIGN}, hs AS (SELECT vw, sl, c, count(sample) AS n FROM (SELECT 'ego' AS vw UNION ALL SELECT 'exo'), range(4) x(sl), range(8) r(c) LEFT JOIN s ON view = vw AND slot = sl AND code = c GROUP BY 1, 2, 3),
q1 AS (SELECT vw, c, sum(n) / (SELECT sum(n) / 2e0 FROM hs) AS p FROM hs GROUP BY 1, 2), q2 AS (SELECT vw, sl, c, n / (SELECT sum(n) / 8e0 FROM hs) AS p FROM hs), q0 AS (SELECT c, sum(n) / (SELECT sum(n) * 1e0 FROM hs) AS p FROM hs GROUP BY 1),
sh AS (SELECT avg(x) AS x FROM (SELECT vw, {_SHORT} AS x FROM (SELECT vw, {_H} AS h FROM q1 GROUP BY 1) UNION ALL SELECT vw, avg({_SHORT}) FROM (SELECT vw, sl, {_H} AS h FROM q2 GROUP BY 1, 2) GROUP BY 1)),
ov AS (SELECT view, sample, sum(n * n) AS sq FROM (SELECT view, sample, code, count(*) AS n FROM s GROUP BY 1, 2, 3) GROUP BY 1, 2),
r AS (SELECT 'balance' AS loss, sum(0.125e0 * (ln(0.125e0) - ln(greatest(q, 1e-8)))) AS value FROM (SELECT c, avg(p) AS q FROM lg GROUP BY 1)
 UNION ALL SELECT 'slot_balance', avg(k) FROM (SELECT view, slot, sum(0.125e0 * (ln(0.125e0) - ln(greatest(q, 1e-8)))) AS k FROM (SELECT view, slot, c, avg(p) AS q FROM lg GROUP BY 1, 2, 3) GROUP BY 1, 2)
 UNION ALL SELECT 'hard_balance', sum(0.125e0 * (ln(0.125e0) - ln(greatest(p, 1e-8)))) FROM q0
 UNION ALL SELECT 'assignment_entropy', avg(a) FROM (SELECT view, avg(greatest(h / ln(8e0) - 0.5e0, 0e0)) AS a FROM (SELECT view, sample, slot, {_H} AS h FROM lg GROUP BY 1, 2, 3) GROUP BY 1)
 UNION ALL SELECT 'hard_entropy_shortfall', x FROM sh UNION ALL SELECT 'capacity_excess', sum(pow(greatest(p - 0.126e0, 0e0), 2)) * 8 FROM q0
 UNION ALL SELECT 'slot_overlap', avg(o) FROM (SELECT view, avg((sq - 4) / 12e0) AS o FROM ov GROUP BY 1)) SELECT loss, round(value, 6) AS value FROM r"""


def group_uniformity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.group_uniformity(assignments(spark, sf_dir)).select("loss", r6("value", "value"))


def _uniform(by: str, cell: str, src: str) -> str:
    keys = f"{by}, {cell}"
    return f"""(SELECT avg(k) FROM (SELECT {by}, grp, sum(greatest(q, 1e-8) * (ln(greatest(q, 1e-8)) - ln(greatest(o, 1e-8)))) AS k FROM (SELECT {keys}, grp, avg(p) AS o FROM {src} GROUP BY ALL) JOIN (SELECT {keys}, avg(p) AS q FROM {src} GROUP BY ALL) USING ({keys})
 WHERE grp IN (SELECT grp FROM s GROUP BY 1 HAVING count(DISTINCT sample) > 1) GROUP BY {by}, grp))"""


UNIFORMITY_SQL = f"""WITH {ASSIGN}, jt AS (SELECT a.view, a.grp, a.slot, b.slot AS slot2, a.c, b.c AS c2, a.p * b.p AS p FROM lg a JOIN lg b ON a.view = b.view AND a.sample = b.sample AND a.slot < b.slot)
SELECT 'group' AS loss, round({_uniform("view", "c", "lg")}, 6) AS value UNION ALL SELECT 'group_slot', round({_uniform("view, slot", "c", "lg")}, 6) UNION ALL SELECT 'group_pair', round({_uniform("view, slot, slot2", "c, c2", "jt")}, 6)"""


def view_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = L.view_agreement(assignments(spark, sf_dir), "ego", "exo", uncertainty=0.5, disagreement=1.0, bias=-0.25)
    return got.select("n", *[r6(c, c) for c in ("consistency", "gated_kl", "agreement")])


AGREEMENT_SQL = f"""WITH {ASSIGN}, j AS (SELECT a.sample, a.slot, greatest(a.p, 1e-8) AS e, greatest(b.p, 1e-8) AS x, a.c FROM lg a JOIN lg b ON a.view = 'ego' AND b.view = 'exo' AND a.sample = b.sample AND a.slot = b.slot AND a.c = b.c),
k AS (SELECT sample, slot, 0.5e0 * (sum(e * (ln(e) - ln(0.5e0 * (e + x)))) + sum(x * (ln(x) - ln(0.5e0 * (e + x))))) AS js, sum(x * (ln(x) - ln(e))) AS kl, 1e0 + sum(x * ln(x)) / ln(8e0) AS wx, 1e0 + sum(e * ln(e)) / ln(8e0) AS we FROM j GROUP BY 1, 2),
m AS (SELECT js, kl * wx / (1e0 + exp(-(-0.25e0 + 0.5e0 * (1e0 - we) + sqrt(greatest(js, 0e0) / ln(8e0))))) AS g FROM k)
SELECT count(*) AS n, round(avg(js), 6) AS consistency, round(avg(g), 6) AS gated_kl, (SELECT round(avg(CASE WHEN a.code = b.code THEN 1e0 ELSE 0e0 END), 6) FROM s a JOIN s b ON a.view = 'ego' AND b.view = 'exo' AND a.sample = b.sample AND a.slot = b.slot) AS agreement FROM m"""


def motion_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector is four patches; the state before is the vector backwards, two mixtures are the guesses."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", _double("embedding").alias("v")).withColumn("u", F.reverse("v")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(3))))
    cut = lambda c: F.slice(c, F.col("i") * 16 + 1, 16)
    rows = e.select("vec_id", cut("v").alias("target"), cut("u").alias("current"))
    mix = lambda a: F.zip_with("target", "current", lambda t, c: a * t + (1.0 - a) * c + 0.01)
    good = L.motion_losses(rows.withColumn("recon", mix(0.75)), "vec_id")
    bad = L.motion_losses(rows.withColumn("recon", mix(0.4)), "vec_id").select("vec_id", F.col("delta").alias("bad_delta"))
    return good.join(bad, "vec_id").select("vec_id", *[r6(c, c) for c in ("plain", "focused", "delta", "bad_delta")])


def _motion(a: float, name: str) -> str:
    return f"""{name}0 AS (SELECT vec_id, t, list_transform(list_zip(t, c), lambda z: z[1] - z[2]) AS m, list_transform(list_zip(t, c), lambda z: {a}e0 * z[1] + (1e0 - {a}e0) * z[2] + 0.01e0 - z[2]) AS r, list_transform(list_zip(t, c), lambda z: {a}e0 * z[1] + (1e0 - {a}e0) * z[2] + 0.01e0 - z[1]) AS d FROM pa),
{name}1 AS (SELECT vec_id, list_inner_product(m, m) / 16e0 AS motion, list_inner_product(d, d) / 16e0 AS err, greatest(sqrt(list_inner_product(m, m)), 1e-6) AS tn, greatest(sqrt(list_inner_product(r, r)), 1e-6) AS rn, list_inner_product(m, r) AS mr FROM {name}0),
{name}2 AS (SELECT vec_id, avg(err) AS plain, avg((least(greatest(1e0 - mr / (tn * rn), 0e0), 2e0) + 0.25e0 * pow((rn - tn) / greatest(tn, 0.05e0), 2)) * tn) / greatest(avg(tn), 1e-6) AS delta, greatest(avg(motion), 1e-8) AS mm FROM {name}1 GROUP BY 1),
{name} AS (SELECT vec_id, any_value(plain) AS plain, any_value(delta) AS delta, avg(least(1e0 + 2e0 * motion / mm, 6e0) * err) / greatest(avg(least(1e0 + 2e0 * motion / mm, 6e0)), 1e-8) AS focused FROM {name}1 JOIN {name}2 USING (vec_id) GROUP BY 1)"""


PATCHES = "pa AS (SELECT vec_id, v[i * 16 + 1:i * 16 + 16] AS t, list_reverse(v)[i * 16 + 1:i * 16 + 16] AS c FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), range(4) r(i))"
MOTION_SQL = f"WITH {PATCHES}, {_motion(0.75, 'g')}, {_motion(0.4, 'b')} SELECT vec_id, round(g.plain, 6) AS plain, round(g.focused, 6) AS focused, round(g.delta, 6) AS delta, round(b.delta, 6) AS bad_delta FROM g JOIN b USING (vec_id)"


def action_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Margin penalties per event type: its own value against the reversed scale, weighted by k."""
    e = events(spark, sf_dir).select("event_type", (F.col("value") / 100.0).alias("good"), (1.0 - F.col("value") / 150.0).alias("bad"), (F.col("k") % 4).cast("double").alias("w"))
    return e.groupBy("event_type").agg(r6(L.contrast(e, "good", "bad", 0.05), "plain"), r6(L.contrast(e, "good", "bad", 0.05, "w"), "weighted"))


CONTRAST_SQL = f"WITH {EV}, a AS (SELECT event_type, greatest(0.05e0 + value / 100e0 - (1e0 - value / 150e0), 0e0) AS p, CAST(k % 4 AS DOUBLE) AS w FROM ev) SELECT event_type, round(avg(p), 6) AS plain, round(avg(p * w) / greatest(avg(w), 1e-6), 6) AS weighted FROM a GROUP BY 1"


def loss_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss weights with doc_id as the step."""
    d = read(spark, sf_dir, "documents").select("doc_id")
    total = d.agg(F.max("doc_id")).scalar()
    weights = L.loss_schedule(F.col("doc_id"), total)
    aux = L.aux_schedule(F.col("doc_id"), total, 0.3, 0.25, 0.5)
    return d.select("doc_id", *[r6(c, f"w_{n}") for n, c in weights.items()], r6(aux, "w_aux"), r6(L.aux_schedule(F.col("doc_id"), total, 0.3, 0.25, 0.0), "w_step"))


SCHEDULE_SQL = """WITH a AS (SELECT doc_id, least(greatest(doc_id / greatest((SELECT max(doc_id) FROM documents), 1), 0e0), 1e0) AS p FROM documents)
SELECT doc_id, CASE WHEN p < 0.2e0 THEN 1e0 ELSE 0.2e0 END AS w_self, round(CASE WHEN p < 0.2e0 THEN 0.5e0 * (p / 0.2e0) ELSE 1e0 END, 6) AS w_swap, round(CASE WHEN p >= 0.2e0 THEN 0.1e0 WHEN p < 0.1e0 THEN 0e0 ELSE 0.1e0 * ((p - 0.1e0) / 0.1e0) END, 6) AS w_kl,
 round(CASE WHEN p <= 0.25e0 THEN 0e0 ELSE 0.3e0 * least((p - 0.25e0) / 0.5e0, 1e0) END, 6) AS w_aux, CASE WHEN p <= 0.25e0 THEN 0e0 ELSE 0.3e0 END AS w_step FROM a"""


def masked_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three regression losses under a mask that may be missing; targets under no mask are NaN."""
    e = events(spark, sf_dir).withColumn("w", F.when(F.col("k") % 7 == 0, None).otherwise((F.col("k") % 3).cast("double")))
    e = e.withColumn("target", F.when(F.coalesce(F.col("w"), F.lit(0.0)) == 0, F.lit(float("nan"))).otherwise(F.col("value") / 25.0)).withColumn("guess", F.col("k") / 3.0)
    return e.groupBy("event_type").agg(*[r6(L.masked(L.pointwise(F.col("guess"), F.col("target"), x), F.col("w")), x) for x in ("l1", "mse", "smooth_l1")], r6(L.masked(F.col("target"), F.lit(None).cast("double")), "no_mask"))


MASKED_LOSSES_SQL = f"""WITH {EV}, a AS (SELECT event_type, CASE WHEN k % 7 = 0 THEN 0 ELSE k % 3 END * 1e0 AS w, abs(k / 3e0 - value / 25e0) AS d FROM ev)
SELECT event_type, round(sum(w * d) / greatest(sum(w), 1e0), 6) AS l1, round(sum(w * d * d) / greatest(sum(w), 1e0), 6) AS mse, round(sum(w * CASE WHEN d < 1 THEN 0.5e0 * d * d ELSE d - 0.5e0 END) / greatest(sum(w), 1e0), 6) AS smooth_l1, 0e0 AS no_mask FROM a GROUP BY 1"""


def masked_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross entropy over eight components as logits; every fifth label is missing (-1) and masked."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.slice(_double("embedding"), 1, 8).alias("z"), F.when(F.col("vec_id") % 5 == 0, -1).otherwise(F.col("vec_id") % 8).alias("y"))
    valid = (F.col("y") >= 0).cast("double")
    return e.groupBy((F.col("vec_id") % 10).alias("part")).agg(r6(L.masked(L.cross_entropy(F.col("z"), F.greatest("y", F.lit(0))), valid), "loss"))


CLASSES_SQL = """WITH a AS (SELECT vec_id, list_transform(embedding[1:8], lambda x: CAST(x AS DOUBLE)) AS z FROM embeddings)
SELECT vec_id % 10 AS part, round(coalesce(sum(CASE WHEN vec_id % 5 <> 0 THEN ln(list_sum(list_transform(z, lambda x: exp(x)))) - z[vec_id % 8 + 1] END), 0e0) / greatest(count(*) FILTER (WHERE vec_id % 5 <> 0), 1), 6) AS loss FROM a GROUP BY 1"""


def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro F1 of one guess minus another's, with bounds from the same drawn users."""
    rows = paired(spark, sf_dir).withColumn("other", F.when(F.col("k") % 3 == 0, F.col("truth")).otherwise(F.lit("click")))
    got = E.paired_bootstrap(rows, "user_id", "truth", "guess", "other", TYPES, ITERATIONS, "boot")
    return got.select("iterations", *[r6(c, c) for c in ("delta", "low", "high")])


def _f1_of(guess: str) -> str:
    counts = _COUNTS.replace("guess", guess)
    return f"{guess}_c AS (SELECT user_id, label, {counts} FROM pr2, {_LABELS} GROUP BY 1, 2)"


_F1 = "CASE WHEN 2 * tp + fp + fn > 0 THEN 2e0 * tp / (2 * tp + fp + fn) ELSE 0e0 END"
PAIRED_BOOTSTRAP_SQL = f"""WITH {PAIRED}, pr2 AS (SELECT *, CASE WHEN k % 3 = 0 THEN truth ELSE 'click' END AS other FROM pr), {_f1_of("guess")}, {_f1_of("other")},
c AS (SELECT 1 AS s, * FROM guess_c UNION ALL SELECT -1, * FROM other_c), u AS (SELECT user_id, row_number() OVER (ORDER BY sha256(CAST(user_id AS VARCHAR)), user_id) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT user_id FROM pr)),
d AS (SELECT i.range AS iteration, CAST('0x' || substr(sha256('boot:' || i.range || ':' || j.range), 1, 8) AS BIGINT) % (SELECT max(n) FROM u) AS place FROM range({ITERATIONS}) i, range((SELECT max(n) FROM u)) j),
x AS (SELECT iteration, s, label, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM d JOIN u USING (place) JOIN c USING (user_id) GROUP BY 1, 2, 3), f AS (SELECT iteration, sum(s * {_F1}) / 5e0 AS f FROM x GROUP BY 1),
p AS (SELECT sum(s * {_F1}) / 5e0 AS delta FROM (SELECT s, label, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM c GROUP BY 1, 2))
SELECT count(*) AS iterations, round(any_value(delta), 6) AS delta, round(quantile_cont(f, 0.025), 6) AS low, round(quantile_cont(f, 0.975), 6) AS high FROM f, p"""

QUERIES = {
    "usage_losses": (usage_losses, USAGE_LOSSES_SQL),
    "group_uniformity": (group_uniformity, UNIFORMITY_SQL),
    "view_agreement": (view_agreement, AGREEMENT_SQL),
    "motion_losses": (motion_losses, MOTION_SQL),
    "action_contrast": (action_contrast, CONTRAST_SQL),
    "loss_schedule": (loss_schedule, SCHEDULE_SQL),
    "masked_losses": (masked_losses, MASKED_LOSSES_SQL),
    "masked_classes": (masked_classes, CLASSES_SQL),
    "paired_bootstrap": (paired_bootstrap, PAIRED_BOOTSTRAP_SQL),
}
