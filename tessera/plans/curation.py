"""Curation queries: scores, buckets, review, weights, phase and label rules."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import band, clip, first_filled, first_number, scaled
from ..functions.text import LEXICON, phrase_labels, with_phrase
from ..operators import curation as C
from ..operators import normalize, weights
from ..operators.validation import failures
from .tables import EVENTS_SQL, TAKES_SQL, events, r6, read, takes

P = C.Policy()


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All score columns, kept: many queries and branches read them, and filters must not be
    pushed below, which would copy the nested score expressions into each predicate."""
    return kept(C.review_flags(C.classify(C.suitability(takes(spark, sf_dir)), P), P))


def kept(df: DataFrame) -> DataFrame:
    """``df`` held in memory or on disk; what a lost executor held is computed again."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def _clip(e: str) -> str:
    return f"greatest(0e0, least(1e0, {e}))"


_BLEND = "CASE WHEN vlm_confidence <= 0 THEN {b} ELSE " + _clip("(1e0 - a) * {b} + a * {m}") + " END"
_R = "round_even({e}, 6)"


def _rounded(e: str) -> str:
    return f"CAST(round_even({e}, 6) AS DOUBLE)"


SCORED_CTE = f"""takes AS ({TAKES_SQL}),
s1 AS (SELECT *, {_clip("0.25e0 + 0.55e0 * vlm_confidence")} AS a,
  {_clip("0.35e0 * temporal_diversity_score + 0.35e0 * contact_state_change_score + 0.30e0 * pose_state_change_score")} AS ph FROM takes),
s2 AS (SELECT *,
  {_clip("0.24e0 * interaction_score + 0.24e0 * hand_object_contact_score + 0.18e0 * interacting_object_score + 0.18e0 * ph + 0.16e0 * (1e0 - scene_only_score)")} AS bm,
  {_clip("0.32e0 * loco_score + 0.28e0 * exo_body_visibility_score + 0.24e0 * loco_motion_score + 0.16e0 * greatest(ph, pose_state_change_score)")} AS bl,
  {_clip("0.50e0 * scene_only_score + 0.25e0 * (1e0 - greatest(hand_object_contact_score, exo_body_visibility_score)) + 0.15e0 * (1e0 - ph) + 0.10e0 * (1e0 - greatest(interaction_score, loco_score))")} AS bd FROM s1),
s3 AS (SELECT *, {_clip("0.45e0 * fine_dexterous_score + 0.25e0 * abs(bm - bl) + 0.30e0 * (1e0 - greatest(bm, bl, bd))")} AS bg FROM s2),
s4 AS (SELECT *, {_rounded("ph")} AS phase_v2,
  {_rounded(_BLEND.format(b="bm", m="vlm_prob_tokenizer_main"))} AS pm, {_rounded(_BLEND.format(b="bl", m="vlm_prob_loco_aux"))} AS pl,
  {_rounded(_BLEND.format(b="bd", m="vlm_prob_discard"))} AS pd, {_rounded(_BLEND.format(b="bg", m="vlm_prob_diagnostic_candidate"))} AS pg,
  {_rounded(_clip("CASE WHEN vlm_confidence > 0 THEN greatest(abs(vlm_prob_tokenizer_main - bm), abs(vlm_prob_loco_aux - bl), abs(vlm_prob_discard - bd)) ELSE greatest(abs(hand_object_contact_score - interaction_score), abs(exo_body_visibility_score - loco_score), abs(scene_only_score - bd)) * 0.45e0 END"))} AS dis FROM s3),
s5 AS (SELECT *, CASE
  WHEN pm >= 0.60 AND (hand_object_contact_score >= 0.35 OR vlm_prob_tokenizer_main >= 0.78) AND phase_v2 >= 0.18 AND scene_only_score <= 0.42 AND pd <= 0.45 AND pg <= 0.58 THEN 1
  WHEN pl >= 0.58 AND exo_body_visibility_score >= 0.35 AND body_phase_diversity_score >= 0.18 AND scene_only_score <= 0.55 AND pd <= 0.50 THEN 2
  WHEN pg >= 0.52 OR fine_dexterous_score >= 0.62 OR dis >= 0.45 THEN 3
  WHEN scene_only_score >= 0.55 OR pd >= 0.45 THEN 4 ELSE 5 END AS rule FROM s4),
s6 AS (SELECT *, CASE rule WHEN 1 THEN 'A_interaction_rich' WHEN 2 THEN 'B_loco_body' WHEN 3 THEN CASE WHEN fine_dexterous_score >= 0.62 THEN 'E_fine_dexterous' ELSE 'F_bad_or_unclear' END
  WHEN 4 THEN 'D_scene_only' ELSE 'C_active_view_only' END AS relevance,
  CASE rule WHEN 1 THEN 'tokenizer_main' WHEN 2 THEN 'loco_aux' WHEN 3 THEN 'diagnostic_candidate' ELSE 'discard' END AS usable,
  {_rounded(_clip("CASE rule WHEN 1 THEN pm WHEN 2 THEN pl WHEN 3 THEN greatest(pg, dis) WHEN 4 THEN pd ELSE greatest(pd, 1e0 - greatest(pm, pl)) END"))} AS conf FROM s5),
s7 AS (SELECT *, least(abs(pm - 0.60e0), abs(pl - 0.58e0)) AS margin,
  list_filter([CASE WHEN conf < 0.62 THEN 'low_confidence' END, CASE WHEN dis >= 0.35 THEN 'signal_disagreement' END,
   CASE WHEN least(abs(pm - 0.60e0), abs(pl - 0.58e0)) <= 0.08e0 THEN 'near_policy_boundary' END,
   CASE WHEN usable = 'tokenizer_main' AND hand_object_contact_score < 0.35 THEN 'fact_main_low_contact' END,
   CASE WHEN usable = 'discard' AND greatest(hand_object_contact_score, exo_body_visibility_score) >= 0.65 THEN 'possible_false_drop' END], lambda x: x IS NOT NULL) AS reasons FROM s6),
scored AS (SELECT *, array_to_string(reasons, ';') AS review_reasons, CAST(len(reasons) > 0 AS INTEGER) AS needs_review,
  {_rounded(_clip("0.35e0 * (1e0 - conf) + 0.35e0 * dis + 0.20e0 * (1e0 - least(margin / 0.25e0, 1e0)) + 0.10e0 * len(reasons)"))} AS priority FROM s7)"""


def suitability_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scored(spark, sf_dir)
    return out.select(
        "take_uid",
        r6("prob_tokenizer_main", "pm"),
        r6("prob_loco_aux", "pl"),
        r6("prob_discard", "pd"),
        r6("prob_diagnostic_candidate", "pg"),
        r6("auto_disagreement_score", "dis"),
        F.col("auto_take_relevance").alias("relevance"),
        F.col("auto_usable_for").alias("usable"),
        r6("auto_confidence", "conf"),
    )


SUITABILITY_SQL = f"WITH {SCORED_CTE} SELECT take_uid, round(pm, 6) AS pm, round(pl, 6) AS pl, round(pd, 6) AS pd, round(pg, 6) AS pg, round(dis, 6) AS dis, relevance, usable, round(conf, 6) AS conf FROM scored"


def review_queue(spark: SparkSession, sf_dir: str, top: int = 50, fraction: float = 0.10) -> DataFrame:
    """The highest priorities, and a hash-ranked audit share of the rest."""
    rows = scored(spark, sf_dir).select("take_uid", F.col("auto_review_priority").alias("priority"), "review_reasons", F.col("needs_human_review").alias("needs_review"))
    first = rows.where("needs_review = 1").orderBy(F.desc("priority"), "take_uid").limit(top).withColumn("picked_as", F.lit("priority"))
    rest = rows.join(first.select("take_uid"), "take_uid", "left_anti")
    share = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit("audit"), F.col("take_uid").cast("string")), 256), 1, 8), 16, 10).cast("double") / float(2**32)
    audit = rest.where(share < fraction).withColumn("picked_as", F.lit("audit"))
    return first.unionByName(audit).select("take_uid", r6("priority", "priority"), "review_reasons", "picked_as")


REVIEW_SQL = f"""WITH {SCORED_CTE}, top AS (SELECT * FROM scored WHERE needs_review = 1 ORDER BY priority DESC, take_uid LIMIT 50)
SELECT take_uid, round(priority, 6) AS priority, review_reasons, 'priority' AS picked_as FROM top
UNION ALL SELECT take_uid, round(priority, 6), review_reasons, 'audit' FROM scored WHERE take_uid NOT IN (SELECT take_uid FROM top)
 AND CAST(('0x' || substr(sha256('audit:' || take_uid), 1, 8)) AS BIGINT) / 4294967296e0 < 0.1e0"""


def bucket_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir)
    out = rows.select("take_uid")
    for mode in ("policy", "strict", "balanced"):
        got = C.policy_bucket(rows, P.mode(mode), manual="usable_for" if mode == "policy" else None)
        rows = got.withColumnRenamed("bucket", f"bucket_{mode}")
    return rows.select("take_uid", "bucket_policy", "bucket_strict", "bucket_balanced")


def _bucket_sql(p: C.Policy) -> str:
    return f"""CASE WHEN (usable = 'tokenizer_main' OR pm >= {p.main_prob}e0) AND hand_object_contact_score >= {p.contact}e0 AND phase_v2 >= {p.phase}e0 AND scene_only_score <= {p.main_scene}e0
 AND pd <= {p.main_discard}e0 AND pg <= {p.main_diagnostic}e0 AND ego_hand_visibility_prob >= {p.ego_hand}e0 THEN 'fact_main'
 WHEN (usable = 'loco_aux' OR pl >= {p.loco_prob}e0) AND exo_body_visibility_score >= {p.exo_body}e0 AND body_phase_diversity_score >= {p.body_phase}e0 AND scene_only_score <= {p.loco_scene}e0 AND pd <= {p.loco_discard}e0 THEN 'loco_aux'
 WHEN usable = 'diagnostic_candidate' OR pg >= {p.diagnostic_prob}e0 THEN 'diagnostic_candidate' ELSE 'discard' END"""


BUCKET_SQL = f"""WITH {SCORED_CTE} SELECT take_uid, coalesce(CASE usable_for WHEN 'tokenizer_main' THEN 'fact_main' WHEN '' THEN NULL ELSE usable_for END, {_bucket_sql(P)}) AS bucket_policy,
 {_bucket_sql(P.mode("strict"))} AS bucket_strict, {_bucket_sql(P.mode("balanced"))} AS bucket_balanced FROM scored"""


def blocked_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-version policy with blocked probability columns."""
    rows = scored(spark, sf_dir)
    out = C.blocked_bucket(
        rows, "prob_tokenizer_main", "prob_loco_aux", "temporal_diversity_score", "scene_only_score",
        fact={"prob": 0.5, "phase": 0.2, "scene": 0.6}, aux={"prob": 0.45, "scene": 0.7}, fact_block={"prob_discard": 0.55, "prob_diagnostic_candidate": 0.6}, loco_block={"prob_discard": 0.6},
    )
    return out.groupBy("split", "bucket").agg(F.count("*").alias("n"))


BLOCKED_SQL = f"""WITH {SCORED_CTE}, b AS (SELECT split, CASE WHEN NOT (pd >= 0.55e0 OR pg >= 0.6e0) AND pm >= 0.5e0 AND temporal_diversity_score >= 0.2e0 AND scene_only_score <= 0.6e0 THEN 'fact_main'
 WHEN pd >= 0.6e0 THEN 'discard' WHEN pl >= 0.45e0 AND scene_only_score <= 0.7e0 THEN 'loco_aux' ELSE 'discard' END AS bucket FROM scored)
SELECT split, bucket, count(*) AS n FROM b GROUP BY 1, 2"""


def relevance_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = C.relevance_scores(takes(spark, sf_dir).select("take_uid", "parent_task"), "parent_task")
    names = ("ego_motion", "body_motion", "temporal", "object_motion", "scene_only", "interaction", "loco", "relevance")
    return out.select("take_uid", "parent_task", *[r6(n, n) for n in names], "auto_bucket")


RELEVANCE_SQL = f"""WITH t AS ({TAKES_SQL}), p AS (SELECT take_uid, parent_task,
 CASE parent_task WHEN 'Cooking' THEN 0.85e0 WHEN 'Music' THEN 0.50e0 WHEN 'Soccer' THEN 0.25e0 ELSE 0.35e0 END AS i,
 CASE parent_task WHEN 'Cooking' THEN 0.20e0 WHEN 'Music' THEN 0.15e0 WHEN 'Soccer' THEN 0.85e0 ELSE 0.35e0 END AS l,
 CASE parent_task WHEN 'Cooking' THEN 0.10e0 WHEN 'Music' THEN 0.20e0 WHEN 'Soccer' THEN 0.35e0 ELSE 0.45e0 END AS s,
 CASE parent_task WHEN 'Cooking' THEN 0.35e0 WHEN 'Music' THEN 0.70e0 WHEN 'Soccer' THEN 0.05e0 ELSE 0.20e0 END AS f FROM t),
a AS (SELECT *, {_clip("0.55e0*i+0.25e0*f+0.20e0*l")} AS ego_motion, {_clip("0.55e0*l+0.30e0*i+0.15e0*f")} AS body_motion, {_clip("0.45e0*greatest(i,l)+0.25e0*f+0.15e0")} AS temporal, {_clip("0.70e0*i+0.30e0*f")} AS object_motion, {_clip("s")} AS scene_only FROM p),
b AS (SELECT *, {_clip("0.45e0*i+0.20e0*object_motion+0.20e0*temporal+0.15e0*(1e0-scene_only)")} AS interaction, {_clip("0.50e0*l+0.35e0*body_motion+0.15e0*temporal")} AS loco FROM a)
SELECT take_uid, parent_task, round(ego_motion,6) AS ego_motion, round(body_motion,6) AS body_motion, round(temporal,6) AS temporal, round(object_motion,6) AS object_motion, round(scene_only,6) AS scene_only, round(interaction,6) AS interaction, round(loco,6) AS loco,
 round({_clip("0.35e0*interaction+0.20e0*loco+0.15e0*temporal+0.15e0*object_motion+0.15e0*body_motion-0.25e0*scene_only")},6) AS relevance,
 CASE WHEN scene_only >= 0.68 AND interaction < 0.45 AND loco < 0.55 THEN 'D_scene_only' WHEN interaction >= 0.62 THEN 'A_interaction_rich' WHEN loco >= 0.62 THEN 'B_loco_body' WHEN f >= 0.62 THEN 'E_fine_dexterous' WHEN scene_only >= 0.48 THEN 'C_active_view_only' ELSE 'F_uncertain' END AS auto_bucket FROM b"""


def weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir)
    c = F.col
    label = F.coalesce(F.nullif("usable_for", F.lit("")), F.lit(""))
    probs = {k: c(f"prob_{k}") for k in ("tokenizer_main", "loco_aux", "diagnostic_candidate", "discard")}
    rows = s.select(
        "take_uid", "split", "task_name", "parent_task",
        weights.bucket_or_argmax(label, probs).alias("bucket"),
        c("prob_tokenizer_main").alias("p_main"), c("prob_loco_aux").alias("p_loco"), c("prob_diagnostic_candidate").alias("p_diag"), c("prob_discard").alias("p_discard"),
        clip("interaction_score").alias("interaction"), clip("object_motion_proxy").alias("object_motion"), clip("phase_diversity_score_v2").alias("phase"),
        clip("motion_state_change_score").alias("motion_change"), clip("temporal_diversity_score").alias("temporal"), clip("fine_dexterous_score").alias("fine"),
        clip("pose_state_change_score").alias("prior"), clip("loco_score").alias("loco"), clip("exo_body_motion_score").alias("body"), clip("scene_only_score").alias("scene"),
        clip("auto_disagreement_score").alias("disagreement"), c("auto_take_relevance").alias("relevance"), F.lit("F_uncertain").alias("auto_bucket"),
    )
    rows = kept(weights.quality_weight(weights.group_balance(rows, "split", "task_name", "parent_task")))
    rows = weights.mass_balance(rows.withColumn("weight", c("raw_weight")), "weight", ("parent_task", "task_name"))
    return weights.scale_to_max(kept(rows), "weight")


def take_weight_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted(spark, sf_dir).select("take_uid", "bucket", r6("diversity", "diversity"), r6("raw_weight", "raw_weight"), r6("mass_multiplier", "mass_multiplier"), r6("weight", "weight"))


WEIGHT_CTE = f"""{SCORED_CTE}, w0 AS (SELECT *, CASE WHEN usable_for <> '' THEN usable_for WHEN pm >= greatest(pm, pl, pg, pd) THEN 'tokenizer_main' WHEN pl >= greatest(pm, pl, pg, pd) THEN 'loco_aux'
  WHEN pg >= greatest(pm, pl, pg, pd) THEN 'diagnostic_candidate' ELSE 'discard' END AS bucket FROM scored),
tc AS (SELECT split, task_name, count(*) AS n FROM w0 GROUP BY 1, 2), tm AS (SELECT split, avg(n) AS m FROM tc GROUP BY 1),
pc AS (SELECT split, parent_task, count(*) AS n FROM w0 GROUP BY 1, 2), pmn AS (SELECT split, avg(n) AS m FROM pc GROUP BY 1),
w1 AS (SELECT w0.*, greatest(0.65e0, least(1.35e0, pow(tm.m / tc.n, 0.35e0) * pow(pmn.m / pc.n, 0.20e0))) AS diversity FROM w0 JOIN tc USING (split, task_name) JOIN tm USING (split) JOIN pc USING (split, parent_task) JOIN pmn USING (split)),
w2 AS (SELECT *, {_clip("0.28e0*interaction_score+0.18e0*object_motion_proxy+0.14e0*phase_v2+0.14e0*" + _rounded("temporal_diversity_score") + "+0.10e0*temporal_diversity_score+0.08e0*pose_state_change_score+0.08e0*fine_dexterous_score")} AS fq,
  {_clip("0.40e0*loco_score+0.24e0*pl+0.20e0*exo_body_motion_score+0.16e0*phase_v2")} AS lq, {_clip("0.45e0*pg+0.30e0*dis+0.25e0*temporal_diversity_score")} AS gq FROM w1),
w3 AS (SELECT *, CASE bucket WHEN 'discard' THEN 0e0 WHEN 'loco_aux' THEN 0.42e0*0.46e0+0.32e0*0.46e0*lq+0.18e0*pm+0.08e0*0.13e0*gq
  WHEN 'diagnostic_candidate' THEN 0.45e0*0.13e0+0.25e0*0.13e0*gq+0.25e0*pm+0.05e0*0.46e0*pl ELSE 0.50e0+0.35e0*pm+0.10e0*0.46e0*pl+0.05e0*0.13e0*pg END AS mix,
  greatest(0.04e0, least(1e0, 1e0-0.78e0*pd-0.55e0*scene_only_score-0.18e0*pg-0.10e0*dis)) * CASE relevance WHEN 'D_scene_only' THEN 0.35e0 WHEN 'C_active_view_only' THEN 0.74e0 ELSE 1e0 END AS risk FROM w2),
w4 AS (SELECT *, pow(mix * (0.45e0 + 0.75e0 * fq) * risk * CASE WHEN bucket = 'discard' THEN 1e0 ELSE diversity END, 1.15e0) AS r0 FROM w3),
w5 AS (SELECT *, CASE WHEN r0 > 0 THEN greatest(0.02e0, r0) ELSE r0 END AS raw_weight FROM w4),
mp AS (SELECT parent_task, sum(raw_weight) AS m FROM w5 WHERE raw_weight > 0 GROUP BY 1), mt AS (SELECT task_name, sum(raw_weight) AS m FROM w5 WHERE raw_weight > 0 GROUP BY 1),
w6 AS (SELECT w5.*, CASE WHEN raw_weight > 0 THEN greatest(0.70e0, least(1.45e0, pow((SELECT avg(m) FROM mp) / mp.m, 0.35e0) * pow((SELECT avg(m) FROM mt) / mt.m, 0.35e0))) ELSE 1e0 END AS mass_multiplier
  FROM w5 LEFT JOIN mp USING (parent_task) LEFT JOIN mt USING (task_name)),
weighted AS (SELECT *, raw_weight * mass_multiplier / (SELECT max(raw_weight * mass_multiplier) FROM w6) AS weight FROM w6)"""
WEIGHT_SQL = f"WITH {WEIGHT_CTE} SELECT take_uid, bucket, round(diversity, 6) AS diversity, round(raw_weight, 6) AS raw_weight, round(mass_multiplier, 6) AS mass_multiplier, round(weight, 6) AS weight FROM weighted"


def effective_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted(spark, sf_dir).groupBy("bucket").agg(
        F.count("*").alias("n"), F.count_if(F.col("weight") > 0).alias("positive"), r6(F.avg(F.when(F.col("weight") > 0, F.col("weight"))), "mean_positive"), F.round(weights.effective_size("weight"), 4).alias("effective")
    )


EFFECTIVE_SQL = f"""WITH {WEIGHT_CTE} SELECT bucket, count(*) AS n, count(*) FILTER (WHERE weight > 0) AS positive, round(avg(weight) FILTER (WHERE weight > 0), 6) AS mean_positive,
 round(CASE WHEN sum(weight * weight) > 0 THEN pow(sum(weight), 2) / sum(weight * weight) ELSE 0e0 END, 4) AS effective FROM weighted GROUP BY 1"""


def simple_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir)
    w = weights.simple_weight(F.col("auto_usable_for"), F.greatest("auto_confidence", "prob_tokenizer_main"), F.col("scene_only_score"), F.col("prob_discard"))
    return s.select("take_uid", r6(w, "weight"))


SIMPLE_SQL = f"""WITH {SCORED_CTE}, x AS (SELECT take_uid, CASE usable WHEN 'tokenizer_main' THEN 1e0 WHEN 'loco_aux' THEN 0.4e0 WHEN 'diagnostic_candidate' THEN 0.18e0 ELSE 0e0 END
 * (0.65e0 + 0.35e0 * {_clip("greatest(conf, pm)")}) * greatest(0.25e0, 1e0 - 0.5e0 * scene_only_score - 0.35e0 * pd) AS w FROM scored)
SELECT take_uid, round(CASE WHEN w > 0 THEN greatest(0.02e0, w) ELSE w END, 6) AS weight FROM x"""


def top_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights.largest_groups(weighted(spark, sf_dir), "task_name", "weight", 10).select("task_name", r6("mass", "mass"))


TOP_MASS_SQL = f"WITH {WEIGHT_CTE} SELECT task_name, round(sum(weight), 6) AS mass FROM weighted GROUP BY 1 ORDER BY sum(weight) DESC, 1 LIMIT 10"


def phased(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = normalize.robust_norm(events(spark, sf_dir), "value", "signal")
    e = normalize.phase_change(e, "user_id", ["t", "event_id"], "signal", "change")
    return normalize.robust_norm(e, "change", "phase")


def phase_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phased(spark, sf_dir).select("event_id", r6("signal", "signal"), r6("change", "change"), r6("phase", "phase"))


def _norm(col: str, frm: str) -> str:
    lo, hi = f"(SELECT quantile_cont({col}, 0.1) FROM {frm})", f"(SELECT quantile_cont({col}, 0.9) FROM {frm})"
    return f"CASE WHEN {hi} <= {lo} + 1e-8 THEN 0e0 ELSE greatest(0e0, least(1e0, ({col} - {lo}) / ({hi} - {lo}))) END"


PHASE_CTE = f"""ev AS ({EVENTS_SQL}), n1 AS (SELECT *, {_norm("value", "ev")} AS signal FROM ev),
n2 AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY user_id) < 3 THEN signal ELSE greatest(abs(signal - coalesce(lag(signal) OVER w, signal)), abs(coalesce(lead(signal) OVER w, signal) - signal)) END AS change
 FROM n1 WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)), phased AS (SELECT *, {_norm("change", "n2")} AS phase FROM n2)"""
PHASE_SQL = f"WITH {PHASE_CTE} SELECT event_id, round(signal, 6) AS signal, round(change, 6) AS change, round(phase, 6) AS phase FROM phased"


def transition_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interaction score, rule label and label weight of every transition."""
    e = phased(spark, sf_dir).withColumn("ego", F.col("signal")).withColumn("exo", ((F.col("k") * 37 + F.col("event_id") * 11) % 101) / F.lit(100.0))
    both = F.sqrt(clip(F.col("ego") * F.col("exo")))
    e = e.withColumn("sync", clip(1.0 - F.abs(F.col("ego") - F.col("exo"))) * both).withColumn("scene", clip(F.col("ego") * (1.0 - clip(F.col("exo") / 2.0))))
    inter = clip(0.35 * F.col("ego") + 0.20 * F.col("exo") + 0.20 * F.col("ego") + 0.15 * F.col("sync") + 0.10 * F.col("phase") - 0.20 * F.col("scene"))
    e = e.withColumn("interaction", inter)
    label = C.transition_label(F.col("interaction"), F.col("sync"), F.col("scene"), F.col("phase"), F.greatest("ego", "exo"))
    weight = F.element_at(F.create_map(*[F.lit(x) for x in ("main_interaction", 1.0, "phase_context", 0.45, "loco_only", 0.25, "discard", 0.02)]), F.col("label"))
    return e.withColumn("label", label).select("event_id", r6("interaction", "interaction"), "label", weight.alias("weight"))


TRANSITION_SQL = f"""WITH {PHASE_CTE}, a AS (SELECT event_id, signal AS ego, ((k * 37 + event_id * 11) % 101) / 100e0 AS exo, phase FROM phased),
b AS (SELECT *, {_clip("1e0 - abs(ego - exo)")} * sqrt({_clip("ego * exo")}) AS sync, {_clip("ego * (1e0 - " + _clip("exo / 2e0") + ")")} AS scene FROM a),
c AS (SELECT *, {_clip("0.35e0*ego+0.20e0*exo+0.20e0*ego+0.15e0*sync+0.10e0*phase-0.20e0*scene")} AS interaction FROM b),
d AS (SELECT *, CASE WHEN scene >= 0.82 OR interaction < 0.65e0*0.24e0 THEN 'discard' WHEN interaction >= 0.58 AND sync >= 0.35 AND scene <= 0.68 THEN 'main_interaction'
 WHEN interaction >= 0.36 OR phase >= 0.55 THEN 'phase_context' WHEN greatest(ego, exo) >= 0.24 THEN 'loco_only' ELSE 'discard' END AS label FROM c)
SELECT event_id, round(interaction, 6) AS interaction, label, CASE label WHEN 'main_interaction' THEN 1e0 WHEN 'phase_context' THEN 0.45e0 WHEN 'loco_only' THEN 0.25e0 ELSE 0.02e0 END AS weight FROM d"""


def safe_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Casts and fallbacks on messy text: bad numbers, blanks, bands."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "n_chars", F.when(F.col("doc_id") % 4 == 0, "").when(F.col("doc_id") % 4 == 1, "abc").otherwise(F.col("n_chars").cast("string")).alias("a"), F.col("doc_id").cast("string").alias("b"))
    return docs.select(
        "doc_id", first_filled(["a", "b"], -1.0).alias("first_filled"), first_number(["a", "b"], -1.0).alias("first_number"), r6(scaled("n_chars", 5000.0), "scaled"),
        band(scaled("n_chars", 5000.0), [(0.66, "high"), (0.33, "mid")], "low").alias("band"),
    )


SAFE_SQL = f"""WITH x AS (SELECT doc_id, n_chars, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'abc' ELSE CAST(n_chars AS VARCHAR) END AS a, CAST(doc_id AS VARCHAR) AS b FROM documents)
SELECT doc_id, coalesce(TRY_CAST(coalesce(nullif(a, ''), nullif(b, '')) AS DOUBLE), -1e0) AS first_filled, coalesce(TRY_CAST(a AS DOUBLE), TRY_CAST(b AS DOUBLE), -1e0) AS first_number,
 round({_clip("n_chars / 5000e0")}, 6) AS scaled, CASE WHEN {_clip("n_chars / 5000e0")} >= 0.66e0 THEN 'high' WHEN {_clip("n_chars / 5000e0")} >= 0.33e0 THEN 'mid' ELSE 'low' END AS band FROM x"""


def lexicon_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations by the phrase found in the text, else in the role; labels per phrase."""
    found = with_phrase(read(spark, sf_dir, "conversations"), "text", "role").groupBy("phrase").agg(F.count("*").alias("n"))
    return found.withColumns(phrase_labels(F.col("phrase"))).select("phrase", "effect", "contact", "valid", "n")


def _phrase_sql(text: str) -> str:
    return "CASE " + " ".join(f"WHEN contains({text}, '{p}') THEN '{p}'" for _, _, ps in LEXICON for p in ps) + " END"


def _of(i: int, rest: int) -> str:
    return "CASE " + " ".join(f"WHEN phrase IN ({', '.join(repr(p) for p in row[2])}) THEN {row[i]}" for row in LEXICON) + f" ELSE {rest} END"


_NORM_TEXT = "trim(regexp_replace(regexp_replace(replace(lower(coalesce({c}, '')), '_', '-'), '[^a-z0-9\\- ]+', ' ', 'g'), '\\s+', ' ', 'g'))"
LEXICON_SQL = f"""WITH a AS (SELECT {_NORM_TEXT.format(c="text")} AS x, {_NORM_TEXT.format(c="role")} AS y FROM conversations), b AS (SELECT coalesce({_phrase_sql("x")}, {_phrase_sql("y")}) AS phrase FROM a)
SELECT phrase, {_of(0, 7)} AS effect, {_of(1, 4)} AS contact, phrase IS NOT NULL AS valid, count(*) AS n FROM b GROUP BY ALL"""


def validate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken rules per row of the labelled documents; keys missing or repeated among them."""
    rows = takes(spark, sf_dir)
    rules = [
        ("unknown_label", ~F.col("usable_for").isin("tokenizer_main", "loco_aux", "discard", "diagnostic_candidate")),
        ("main_without_contact", (F.col("usable_for") == "tokenizer_main") & (F.col("hand_object_contact_score") < 0.05)),
        ("discard_but_relevant", (F.col("usable_for") == "discard") & (F.col("interaction_score") > 0.9)),
        ("too_short", F.col("n_chars") < 20),
    ]
    return failures(rows, "take_uid", rules).groupBy("rule").agg(F.count("*").alias("n"))


VALIDATE_SQL = f"""WITH t AS ({TAKES_SQL}), r AS (SELECT unnest([CASE WHEN usable_for NOT IN ('tokenizer_main','loco_aux','discard','diagnostic_candidate') THEN 'unknown_label' END,
 CASE WHEN usable_for = 'tokenizer_main' AND hand_object_contact_score < 0.05 THEN 'main_without_contact' END, CASE WHEN usable_for = 'discard' AND interaction_score > 0.9 THEN 'discard_but_relevant' END,
 CASE WHEN n_chars < 20 THEN 'too_short' END]) AS rule FROM t UNION ALL SELECT 'duplicate_key' FROM t GROUP BY take_uid HAVING count(*) > 1)
SELECT rule, count(*) AS n FROM r WHERE rule IS NOT NULL GROUP BY 1"""


def class_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases of class names mapped to canonical classes, probabilities summed and clipped."""
    raw = takes(spark, sf_dir).select("take_uid", F.element_at(F.array(*[F.lit(x) for x in ("Fact-Main", "loco body", "E_fine_dexterous", "Drop", "unknown thing")]), (F.col("take_uid") % 5 + 1).cast("int")).alias("cls"), F.col("interaction_score").alias("p"))
    pairs = raw.unionAll(raw.select("take_uid", F.lit("interaction rich"), F.col("p") / 2))
    known = pairs.withColumn("canonical", C.canonical_class("cls")).where("canonical IS NOT NULL")
    return known.groupBy("take_uid", "canonical").agg(r6(clip(F.sum("p")), "p"))


ALIAS_SQL = f"""WITH t AS ({TAKES_SQL}), r AS (SELECT take_uid, ['tokenizer_main', 'loco_aux', 'diagnostic_candidate', 'discard', NULL][take_uid % 5 + 1] AS canonical, interaction_score AS p FROM t
 UNION ALL SELECT take_uid, 'tokenizer_main', interaction_score / 2e0 FROM t)
SELECT take_uid, canonical, round({_clip("sum(p)")}, 6) AS p FROM r WHERE canonical IS NOT NULL GROUP BY 1, 2"""

QUERIES = {
    "suitability_scores": (suitability_scores, SUITABILITY_SQL),
    "review_queue": (review_queue, REVIEW_SQL),
    "bucket_policy": (bucket_policy, BUCKET_SQL),
    "blocked_bucket": (blocked_bucket, BLOCKED_SQL),
    "relevance_scores": (relevance_scores, RELEVANCE_SQL),
    "take_weight_v2": (take_weight_v2, WEIGHT_SQL),
    "effective_sample": (effective_sample, EFFECTIVE_SQL),
    "simple_weight": (simple_weight, SIMPLE_SQL),
    "top_mass": (top_mass, TOP_MASS_SQL),
    "phase_change": (phase_change, PHASE_SQL),
    "transition_label": (transition_label, TRANSITION_SQL),
    "safe_scalars": (safe_scalars, SAFE_SQL),
    "lexicon_label": (lexicon_label, LEXICON_SQL),
    "validate_rows": (validate_rows, VALIDATE_SQL),
    "class_alias": (class_alias, ALIAS_SQL),
}
