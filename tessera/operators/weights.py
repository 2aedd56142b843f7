"""Sampling weights: quality mix, diversity and mass balance, effective size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import clip, ordered_case

# Base weight per bucket.
BASE = {"tokenizer_main": 1.0, "loco_aux": 0.46, "diagnostic_candidate": 0.13, "discard": 0.0}
BASE_V1 = {"tokenizer_main": 1.0, "loco_aux": 0.40, "diagnostic_candidate": 0.18, "discard": 0.0}


def bucket_or_argmax(label: Column, probs: dict[str, Column]) -> Column:
    """A known label, else the largest probability; ties in the order of ``probs``."""
    top = F.greatest(*probs.values()) if len(probs) > 1 else next(iter(probs.values()))
    known = F.when(label.isin("tokenizer_main", "fact_main"), "tokenizer_main").when(label.isin("loco_aux", "diagnostic_candidate", "discard"), label)
    return F.coalesce(known, ordered_case([(p >= top, k) for k, p in probs.items()], "discard"))


def group_balance(df: DataFrame, split: str, task: str, parent: str, task_strength: float = 0.35, parent_strength: float = 0.20, low: float = 0.65, high: float = 1.35) -> DataFrame:
    """Adds ``diversity``: mean group size over own size, per split, for task and parent.

    Counts are aggregated first (a row per group) and joined back, so no window gathers a
    split in one task.
    """
    out = df
    factors = []
    for name, key, strength in (("_t", task, task_strength), ("_p", parent, parent_strength)):
        sizes = df.groupBy(split, key).agg(F.count("*").alias(f"{name}_n"))
        means = sizes.groupBy(split).agg(F.avg(f"{name}_n").alias(f"{name}_mean"))
        out = out.join(sizes.join(means, split), [split, key], "left")
        factors.append(F.pow(F.col(f"{name}_mean") / F.col(f"{name}_n"), F.lit(strength)))
    return out.withColumn("diversity", clip(factors[0] * factors[1], low, high)).drop("_t_n", "_t_mean", "_p_n", "_p_mean")


def quality_weight(df: DataFrame, temperature: float = 1.15, floor: float = 0.02) -> DataFrame:
    """Adds ``raw_weight`` from bucket, probabilities (p_*), features and ``diversity``."""
    c = F.col
    q = clip(0.28 * c("interaction") + 0.18 * c("object_motion") + 0.14 * c("phase") + 0.14 * c("motion_change") + 0.10 * c("temporal") + 0.08 * c("prior") + 0.08 * c("fine"))
    loco_q = clip(0.40 * c("loco") + 0.24 * c("p_loco") + 0.20 * c("body") + 0.16 * c("phase"))
    diag_q = clip(0.45 * c("p_diag") + 0.30 * c("disagreement") + 0.25 * c("temporal"))
    m, lo, d, x = BASE["tokenizer_main"], BASE["loco_aux"], BASE["diagnostic_candidate"], BASE["discard"]
    mix = ordered_case(
        [
            (c("bucket") == "discard", x * (0.35 + 0.65 * (1.0 - c("p_discard")))),
            (c("bucket") == "loco_aux", 0.42 * lo + 0.32 * lo * loco_q + 0.18 * m * c("p_main") + 0.08 * d * diag_q),
            (c("bucket") == "diagnostic_candidate", 0.45 * d + 0.25 * d * diag_q + 0.25 * m * c("p_main") + 0.05 * lo * c("p_loco")),
        ],
        0.50 * m + 0.35 * m * c("p_main") + 0.10 * lo * c("p_loco") + 0.05 * d * c("p_diag"),
    )
    risk = clip(1.0 - 0.78 * c("p_discard") - 0.55 * c("scene") - 0.18 * c("p_diag") - 0.10 * c("disagreement"), 0.04, 1.0)
    risk = risk * ordered_case([(c("relevance") == "D_scene_only", 0.35), (c("relevance") == "C_active_view_only", 0.74)], 1.0)
    risk = risk * F.when(c("auto_bucket").isin("D_scene_only", "discard"), 0.5).otherwise(1.0)
    spread = F.when(c("bucket") == "discard", 1.0).otherwise(c("diversity"))
    raw = F.pow(mix * (0.45 + 0.75 * q) * risk * spread, F.lit(temperature))
    return df.withColumn("raw_weight", F.when(raw > 0, F.greatest(F.lit(floor), raw)).otherwise(raw))


def mass_balance(df: DataFrame, weight: str, keys: tuple[str, str], strengths: tuple[float, float] = (0.35, 0.35), low: float = 0.70, high: float = 1.45) -> DataFrame:
    """Rescales positive weights by (mean mass / own mass) of two groupings over all rows."""
    out, factors = df, []
    for n, (key, strength) in enumerate(zip(keys, strengths)):
        mass = df.where(F.col(weight) > 0).groupBy(key).agg(F.sum(weight).alias(f"_m{n}"))
        mean = mass.agg(F.avg(f"_m{n}"))
        out = out.join(mass, key, "left")
        factors.append(F.pow(mean.scalar() / F.greatest(F.col(f"_m{n}"), F.lit(1e-12)), F.lit(strength)))
    factor = F.when(F.col(weight) > 0, clip(factors[0] * factors[1], low, high)).otherwise(1.0)
    return out.withColumn("mass_multiplier", factor).withColumn(weight, F.col(weight) * F.col("mass_multiplier")).drop("_m0", "_m1")


def scale_to_max(df: DataFrame, weight: str, target: float = 1.0) -> DataFrame:
    """Largest weight becomes ``target``; unchanged when none is positive. One scalar subquery."""
    top = df.agg(F.max(weight)).scalar()
    return df.withColumn(weight, F.when(top > 0, F.col(weight) * F.lit(target) / top).otherwise(F.col(weight)))


def effective_size(weight: str) -> Column:
    """(sum w)^2 / sum w^2, 0 without mass."""
    return F.coalesce(F.try_divide(F.pow(F.sum(weight), F.lit(2.0)), F.sum(F.col(weight) * F.col(weight))), F.lit(0.0))


def simple_weight(bucket: Column, confidence: Column, scene: Column, discard: Column, floor: float = 0.02) -> Column:
    """First-version weight: base, confidence and risk."""
    base = ordered_case([(bucket == k, v) for k, v in BASE_V1.items()], 0.0)
    w = base * (0.65 + 0.35 * clip(confidence)) * F.greatest(F.lit(0.25), 1.0 - 0.50 * F.greatest(scene, F.lit(0.0)) - 0.35 * F.greatest(discard, F.lit(0.0)))
    return F.when(w > 0, F.greatest(F.lit(floor), w)).otherwise(w)


def largest_groups(df: DataFrame, key: str, weight: str, n: int = 10) -> DataFrame:
    """Top groups by mass (a report; ties by key)."""
    return df.groupBy(key).agg(F.sum(weight).alias("mass")).orderBy(F.desc("mass"), key).limit(n)


def rank_in(*partition: str, order: list[Column]) -> Column:
    return F.row_number().over(Window.partitionBy(*partition).orderBy(*order))


def labelled_weight(label: Column, confidence: Column, auto: Column, group_weight: Column, weights: dict[str, float], least: float, unlabelled: str = "auto") -> dict[str, Column]:
    """Label, its source and the weight of a row: a human label of enough confidence wins.

    A confidence that is no number counts 1. Without a human label the automatic one is used
    (``unlabelled="auto"``) or none (``"zero"``: discard). Labels without a weight weigh 0.
    """
    given = F.nullif(F.trim(label), F.lit(""))
    sure = F.coalesce(confidence.try_cast("double"), F.lit(1.0)) >= least
    human = given.isNotNull() & sure
    chosen = F.when(human, given).otherwise(F.trim(auto) if unlabelled == "auto" else F.lit("discard"))
    base = F.coalesce(*[F.when(chosen == k, F.lit(float(v))) for k, v in weights.items()], F.lit(0.0))
    return {
        "label": chosen,
        "label_source": F.when(human, "human").otherwise("auto"),
        "weight": F.greatest(base * F.coalesce(group_weight.try_cast("double"), F.lit(1.0)), F.lit(0.0)),
    }


def next_recipe(used_codes: Column, group_nmi: Column) -> Column:
    """Which repair a round's gate values ask for; first_round where there are none."""
    return (
        F.when(used_codes.isNull() & group_nmi.isNull(), "first_round")
        .when((used_codes < 45) & (group_nmi <= 0.45), "usage_repair")
        .when(used_codes < 45, "dense_group_repair")
        .when(group_nmi > 0.35, "leakage_repair")
        .otherwise("causality_repair")
    )
