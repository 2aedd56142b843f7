"""Scores, policy buckets, review flags and weights of curated groups."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import clip, clip_finite, first_filled, first_number, number, ordered_case, violated

# Priors (interaction, locomotion, scene, fine) by parent task, and for the rest.
TASK_PRIORS = {
    "Cooking": (0.85, 0.20, 0.10, 0.35),
    "Bike Repair": (0.85, 0.25, 0.10, 0.30),
    "Health": (0.75, 0.20, 0.15, 0.25),
    "Music": (0.50, 0.15, 0.20, 0.70),
    "Basketball": (0.25, 0.85, 0.35, 0.05),
    "Soccer": (0.25, 0.85, 0.35, 0.05),
    "Dance": (0.15, 0.80, 0.45, 0.05),
    "Rock Climbing": (0.35, 0.65, 0.35, 0.10),
}
OTHER_PRIOR = (0.35, 0.35, 0.45, 0.20)


@dataclass(frozen=True)
class Policy:
    """Thresholds of the bucket policy; the defaults are the published second version."""

    main_prob: float = 0.60
    contact: float = 0.35
    phase: float = 0.18
    main_scene: float = 0.42
    main_discard: float = 0.45
    main_diagnostic: float = 0.58
    ego_hand: float = 0.0
    override_prob: float = 0.78
    loco_prob: float = 0.58
    exo_body: float = 0.35
    body_phase: float = 0.18
    loco_scene: float = 0.55
    loco_discard: float = 0.50
    diagnostic_prob: float = 0.52
    fine: float = 0.62
    disagreement: float = 0.45
    low_confidence: float = 0.62
    review_disagreement: float = 0.35
    margin: float = 0.08
    variants: dict = field(default_factory=dict)

    def mode(self, name: str) -> Policy:
        """``strict`` or ``balanced`` thresholds; explicit variants win over the offsets."""
        sign = {"strict": 1, "balanced": -1}.get(name, 0)
        if not sign:
            return self
        up = (0.08, 0.10, 0.07) if sign > 0 else (0.05, 0.07, 0.04)
        down = (0.08, 0.10, 0.08) if sign > 0 else (0.05, 0.05, 0.10)
        moved = {
            "main_prob": max(0.0, self.main_prob + sign * up[0]),
            "contact": max(0.0, self.contact + sign * up[1]),
            "phase": max(0.0, self.phase + sign * up[2]),
            "main_scene": min(1.0, max(0.0, self.main_scene - sign * down[0])),
            "main_discard": min(1.0, max(0.0, self.main_discard - sign * down[1])),
            "main_diagnostic": min(1.0, max(0.0, self.main_diagnostic - sign * down[2])),
            "ego_hand": 0.30 if sign > 0 else 0.22,
        }
        return Policy(**{k: v for k, v in self.__dict__.items() if k != "variants"} | moved | self.variants.get(name, {}))


def with_priors(df: DataFrame, parent: str) -> DataFrame:
    """Adds the four prior columns of the parent task (literals fold into the plan)."""
    names = ("prior_interaction", "prior_loco", "prior_scene", "prior_fine")
    return df.withColumns(
        {n: ordered_case([(F.col(parent) == k, float(v[i])) for k, v in TASK_PRIORS.items()], float(OTHER_PRIOR[i])) for i, n in enumerate(names)}
    )


def relevance_scores(df: DataFrame, parent: str) -> DataFrame:
    """Metadata proxies and the relevance family, from the parent's priors alone."""
    out = with_priors(df, parent)
    i, lo, sc, fi = (F.col(c) for c in ("prior_interaction", "prior_loco", "prior_scene", "prior_fine"))
    out = out.withColumns(
        {
            "ego_motion": clip(0.55 * i + 0.25 * fi + 0.20 * lo),
            "body_motion": clip(0.55 * lo + 0.30 * i + 0.15 * fi),
            "temporal": clip(0.45 * F.greatest(i, lo) + 0.25 * fi + 0.15),
            "object_motion": clip(0.70 * i + 0.30 * fi),
            "scene_only": clip(sc),
        }
    )
    body, temporal, obj, scene = (F.col(c) for c in ("body_motion", "temporal", "object_motion", "scene_only"))
    out = out.withColumns(
        {"interaction": clip(0.45 * i + 0.20 * obj + 0.20 * temporal + 0.15 * (1.0 - scene)), "loco": clip(0.50 * lo + 0.35 * body + 0.15 * temporal)}
    )
    inter, loco = F.col("interaction"), F.col("loco")
    return out.withColumns(
        {
            "relevance": clip(0.35 * inter + 0.20 * loco + 0.15 * temporal + 0.15 * obj + 0.15 * body - 0.25 * scene),
            "auto_bucket": auto_bucket(inter, loco, scene, fi),
        }
    )


def auto_bucket(interaction: Column, loco: Column, scene: Column, fine: Column) -> Column:
    return ordered_case(
        [
            ((scene >= 0.68) & (interaction < 0.45) & (loco < 0.55), "D_scene_only"),
            (interaction >= 0.62, "A_interaction_rich"),
            (loco >= 0.62, "B_loco_body"),
            (fine >= 0.62, "E_fine_dexterous"),
            (scene >= 0.48, "C_active_view_only"),
        ],
        "F_uncertain",
    )


def blended(base: Column, model: Column, confidence: Column) -> Column:
    """Mix of a detector and a model probability by the model's confidence."""
    alpha = clip_finite(0.25 + 0.55 * confidence)
    return F.when(confidence <= 0, clip_finite(base)).otherwise(clip_finite((1.0 - alpha) * base + alpha * model))


def suitability(df: DataFrame) -> DataFrame:
    """Four independent suitability scores, phase diversity and disagreement."""
    n = lambda *names: first_number([x for x in names if x in df.columns])
    out = df.withColumns(
        {
            "_scene": n("scene_only_score"),
            "_inter": n("interaction_score"),
            "_loco": n("loco_score"),
            "_fine": n("fine_dexterous_score"),
            "_temporal": n("temporal_diversity_score"),
            "_contact": n("hand_object_contact_score", "object_motion_proxy"),
            "_object": n("interacting_object_score", "object_motion_score", "object_motion_proxy"),
            "_exo": n("exo_body_visibility_score", "exo_body_motion_score"),
            "_loco_motion": n("loco_motion_score", "exo_body_motion_score_v2", "exo_body_motion_score"),
            "_pose": n("pose_state_change_score"),
            "_sure": n("vlm_confidence"),
        }
    )
    c = {k: F.col(f"_{k}") for k in ("scene", "inter", "loco", "fine", "temporal", "contact", "object", "exo", "loco_motion", "pose", "sure")}
    out = out.withColumn("_phase", clip_finite(0.35 * c["temporal"] + 0.35 * n("contact_state_change_score") + 0.30 * c["pose"]))
    phase = F.col("_phase")
    out = out.withColumns(
        {
            "_main": clip_finite(0.24 * c["inter"] + 0.24 * c["contact"] + 0.18 * c["object"] + 0.18 * phase + 0.16 * (1.0 - c["scene"])),
            "_aux": clip_finite(0.32 * c["loco"] + 0.28 * c["exo"] + 0.24 * c["loco_motion"] + 0.16 * F.greatest(phase, c["pose"])),
            "_drop": clip_finite(
                0.50 * c["scene"] + 0.25 * (1.0 - F.greatest(c["contact"], c["exo"])) + 0.15 * (1.0 - phase) + 0.10 * (1.0 - F.greatest(c["inter"], c["loco"]))
            ),
        }
    )
    main, aux, drop = F.col("_main"), F.col("_aux"), F.col("_drop")
    diag = clip_finite(0.45 * c["fine"] + 0.25 * F.abs(main - aux) + 0.30 * (1.0 - F.greatest(main, aux, drop)))
    models = [n(f"vlm_prob_{x}") for x in ("tokenizer_main", "loco_aux", "discard", "diagnostic_candidate")]
    apart = F.when(c["sure"] > 0, F.greatest(F.abs(models[0] - main), F.abs(models[1] - aux), F.abs(models[2] - drop))).otherwise(
        F.greatest(F.abs(c["contact"] - c["inter"]), F.abs(c["exo"] - c["loco"]), F.abs(c["scene"] - drop)) * 0.45
    )
    out = out.withColumns(
        {
            "phase_diversity_score_v2": F.bround(phase, 6),
            "motion_state_change_score": F.bround(F.coalesce(number("motion_state_change_score", None), c["temporal"]), 6) if "motion_state_change_score" in df.columns else F.bround(c["temporal"], 6),
            "prob_tokenizer_main": F.bround(blended(main, models[0], c["sure"]), 6),
            "prob_loco_aux": F.bround(blended(aux, models[1], c["sure"]), 6),
            "prob_discard": F.bround(blended(drop, models[2], c["sure"]), 6),
            "prob_diagnostic_candidate": F.bround(blended(diag, models[3], c["sure"]), 6),
            "auto_disagreement_score": F.bround(clip_finite(apart), 6),
        }
    )
    return out.drop(*[x for x in out.columns if x.startswith("_")])


def classify(df: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """auto_take_relevance, auto_usable_for and auto_confidence by ordered policy rules."""
    p = policy
    main, loco, drop, diag = (F.col(f"prob_{x}") for x in ("tokenizer_main", "loco_aux", "discard", "diagnostic_candidate"))
    contact, phase, scene = number("hand_object_contact_score"), number("phase_diversity_score_v2"), number("scene_only_score")
    exo, body, fine, apart = number("exo_body_visibility_score"), number("body_phase_diversity_score"), number("fine_dexterous_score"), number("auto_disagreement_score")
    strong = number("vlm_prob_tokenizer_main") >= p.override_prob
    is_main = (main >= p.main_prob) & ((contact >= p.contact) | strong) & (phase >= p.phase) & (scene <= p.main_scene) & (drop <= p.main_discard) & (diag <= p.main_diagnostic)
    is_loco = (loco >= p.loco_prob) & (exo >= p.exo_body) & (body >= p.body_phase) & (scene <= p.loco_scene) & (drop <= p.loco_discard)
    is_diag = (diag >= p.diagnostic_prob) | (fine >= p.fine) | (apart >= p.disagreement)
    scenic = (scene >= 0.55) | (drop >= 0.45)

    def row(kind: object, usable: str, confidence: Column) -> Column:
        kind = kind if isinstance(kind, Column) else F.lit(kind)
        return F.struct(kind.alias("relevance"), F.lit(usable).alias("usable"), F.bround(clip_finite(confidence), 6).alias("confidence"))

    found = ordered_case(
        [
            (is_main, row("A_interaction_rich", "tokenizer_main", main)),
            (is_loco, row("B_loco_body", "loco_aux", loco)),
            (is_diag, row(F.when(fine >= p.fine, "E_fine_dexterous").otherwise("F_bad_or_unclear"), "diagnostic_candidate", F.greatest(diag, apart))),
            (scenic, row("D_scene_only", "discard", drop)),
        ],
        row("C_active_view_only", "discard", F.greatest(drop, 1.0 - F.greatest(main, loco))),
    )
    return df.withColumn("_c", found).withColumns(
        {"auto_take_relevance": F.col("_c.relevance"), "auto_usable_for": F.col("_c.usable"), "auto_confidence": F.col("_c.confidence")}
    ).drop("_c")


def review_flags(df: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """review_reasons, needs_human_review and auto_review_priority."""
    p = policy
    sure, apart = number("auto_confidence"), number("auto_disagreement_score")
    contact = number("hand_object_contact_score")
    margin = F.least(F.abs(number("prob_tokenizer_main") - p.main_prob), F.abs(number("prob_loco_aux") - p.loco_prob))
    reasons = violated(
        [
            ("low_confidence", sure < p.low_confidence),
            ("signal_disagreement", apart >= p.review_disagreement),
            ("near_policy_boundary", margin <= p.margin),
            ("fact_main_low_contact", (F.col("auto_usable_for") == "tokenizer_main") & (contact < p.contact)),
            ("possible_false_drop", (F.col("auto_usable_for") == "discard") & (F.greatest(contact, number("exo_body_visibility_score")) >= 0.65)),
        ]
    )
    out = df.withColumn("_reasons", reasons)
    size = F.size("_reasons")
    priority = 0.35 * (1.0 - sure) + 0.35 * apart + 0.20 * (1.0 - F.least(margin / 0.25, F.lit(1.0))) + 0.10 * size
    return out.withColumns(
        {"review_reasons": F.array_join("_reasons", ";"), "needs_human_review": (size > 0).cast("int"), "auto_review_priority": F.bround(clip_finite(priority), 6)}
    ).drop("_reasons")


def policy_bucket(df: DataFrame, policy: Policy = Policy(), manual: str | None = None) -> DataFrame:
    """bucket: the manual label where it is known, else the policy's ordered conjunctions."""
    p = policy
    auto = F.col("auto_usable_for")
    main = first_filled(["prob_tokenizer_main", "interaction_score"])
    loco = first_filled(["prob_loco_aux", "loco_score"])
    drop, diag, scene = first_filled(["prob_discard"]), first_filled(["prob_diagnostic_candidate"]), first_filled(["scene_only_score"])
    phase = first_filled(["phase_diversity_score_v2", "temporal_diversity_score"])
    contact = first_filled(["hand_object_contact_score", "object_motion_proxy"])
    hand = first_filled(["ego_hand_visibility_prob"], 1.0) if "ego_hand_visibility_prob" in df.columns else F.lit(1.0)
    exo, body = first_filled(["exo_body_visibility_score", "exo_body_motion_score"]), first_filled(["body_phase_diversity_score", "phase_diversity_score_v2"])
    found = ordered_case(
        [
            (
                ((auto == "tokenizer_main") | (main >= p.main_prob))
                & (contact >= p.contact)
                & (phase >= p.phase)
                & (scene <= p.main_scene)
                & (drop <= p.main_discard)
                & (diag <= p.main_diagnostic)
                & (hand >= p.ego_hand),
                "fact_main",
            ),
            (
                ((auto == "loco_aux") | (loco >= p.loco_prob)) & (exo >= p.exo_body) & (body >= p.body_phase) & (scene <= p.loco_scene) & (drop <= p.loco_discard),
                "loco_aux",
            ),
            ((auto == "diagnostic_candidate") | (diag >= p.diagnostic_prob), "diagnostic_candidate"),
        ],
        "discard",
    )
    if manual:
        known = {"tokenizer_main": "fact_main", "loco_aux": "loco_aux", "diagnostic_candidate": "diagnostic_candidate", "discard": "discard"}
        label = ordered_case([(F.trim(manual) == k, v) for k, v in known.items()], F.lit(None).cast("string"))
        found = F.coalesce(label, found)
    return df.withColumn("bucket", found)


def blocked_bucket(
    df: DataFrame, main: str, loco: str, phase: str, scene: str, fact: dict[str, float], aux: dict[str, float], fact_block: dict[str, float], loco_block: dict[str, float]
) -> DataFrame:
    """First-version buckets: a blocked main falls through, a blocked locomotion is discarded."""
    any_of = lambda m: F.coalesce(
        F.exists(F.array(*[number(c) >= t for c, t in m.items()]), lambda x: x) if m else F.lit(False), F.lit(False)
    )
    found = ordered_case(
        [
            (~any_of(fact_block) & (number(main) >= fact["prob"]) & (number(phase) >= fact["phase"]) & (number(scene) <= fact["scene"]), "fact_main"),
            (any_of(loco_block), "discard"),
            ((number(loco) >= aux["prob"]) & (number(scene) <= aux["scene"]), "loco_aux"),
        ],
        "discard",
    )
    return df.withColumn("bucket", found)


def transition_label(interaction: Column, sync: Column, scene: Column, phase: Column, motion: Column, main: float = 0.58, context: float = 0.36, loco: float = 0.24) -> Column:
    return ordered_case(
        [
            ((scene >= 0.82) | (interaction < 0.65 * loco), "discard"),
            ((interaction >= main) & (sync >= 0.35) & (scene <= 0.68), "main_interaction"),
            ((interaction >= context) | (phase >= 0.55), "phase_context"),
            (motion >= loco, "loco_only"),
        ],
        "discard",
    )


def canonical_class(c: str) -> Column:
    """Lower case with underscores, aliases mapped to four canonical classes."""
    v = F.regexp_replace(F.lower(F.trim(c)), "[- ]+", "_")
    aliases = {
        "tokenizer_main": ("tokenizer_main", "fact_main", "main", "a_interaction_rich", "interaction_rich"),
        "loco_aux": ("loco_aux", "loco", "b_loco_body", "loco_body"),
        "diagnostic_candidate": ("diagnostic_candidate", "diagnostic", "e_fine_dexterous", "fine_dexterous"),
        "discard": ("discard", "drop", "d_scene_only"),
    }
    return ordered_case([(v.isin(*names), k) for k, names in aliases.items()], F.lit(None).cast("string"))
