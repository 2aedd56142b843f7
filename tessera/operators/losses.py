"""Statistics of code assignments, view agreement, motion losses and masked losses.

Assignments are rows (view, sample, group, slot, probs array<double>, code int). What is a
mean over a batch in training is here an aggregate over the table, combined before a shuffle.
Floors of 1e-8 under probabilities are part of the definitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLOOR = 1e-8


def floored(c: Column) -> Column:
    return F.greatest(c, F.lit(FLOOR))


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def kl(p: Column, q: Column) -> Column:
    """Sum of p (ln p - ln q) over two arrays, both floored."""
    return _sum(F.zip_with(p, q, lambda a, b: floored(a) * (F.ln(floored(a)) - F.ln(floored(b)))))


def entropy(p: Column) -> Column:
    return _sum(F.transform(p, lambda x: -floored(x) * F.ln(floored(x))))


def js(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence of two arrays."""
    middle = F.zip_with(p, q, lambda a, b: 0.5 * (floored(a) + floored(b)))
    return 0.5 * (kl(p, middle) + kl(q, middle))


def _named(df: DataFrame, name: str, value: Column) -> DataFrame:
    return df.agg(value.alias("value")).select(F.lit(name).alias("loss"), F.coalesce("value", F.lit(0.0)).alias("value"))


def _mean_probs(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by..., code, q): mean probability of every code."""
    return rows.select(*by, F.posexplode("probs").alias("c", "p")).groupBy(*by, "c").agg(F.avg("p").alias("q"))


def _hard_shares(rows: DataFrame, by: list[str], codes: int) -> DataFrame:
    """(by..., shares): share of rows per code, zero for a code that never occurs."""
    counts = rows.groupBy(*by, "code").agg(F.count(F.lit(1)).alias("n"))
    per = counts.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("code", "n"))).alias("m"), F.sum("n").alias("t"))
    each = F.transform(F.sequence(F.lit(0), F.lit(codes - 1)), lambda c: F.coalesce(F.element_at("m", c), F.lit(0)) / F.col("t"))
    return per.select(*by, each.alias("shares"))


def usage_losses(rows: DataFrame, codes: int, entropy_target: float = 0.0, target_fraction: float = 0.75, max_fraction: float = 0.2) -> DataFrame:
    """(loss, value): how evenly codes are used, softly and by the chosen code alone."""
    even = 1.0 / codes
    to_even = lambda q: F.sum(even * (F.log(F.lit(even)) - F.ln(floored(q))))
    slot = _mean_probs(rows, ["view", "slot"]).groupBy("view", "slot").agg(to_even(F.col("q")).alias("kl"))
    hard = _hard_shares(rows, [], codes)
    hinge = F.greatest(entropy(F.col("probs")) / F.log(F.lit(float(codes))) - entropy_target, F.lit(0.0))
    per_view = rows.groupBy("view").agg(F.avg(hinge).alias("h"))
    target = F.log(F.lit(max(1.0, min(target_fraction, 1.0) * codes)))
    short = lambda s: F.pow(F.greatest(target - entropy(F.col(s)), F.lit(0.0)), 2) / F.log(F.lit(float(codes)))
    flat = _hard_shares(rows, ["view"], codes).select("view", short("shares").alias("s"))
    by_slot = _hard_shares(rows, ["view", "slot"], codes).groupBy("view").agg(F.avg(short("shares")).alias("s"))
    excess = _sum(F.transform("shares", lambda s: F.pow(F.greatest(s - max_fraction, F.lit(0.0)), 2))) * float(codes)
    same = rows.groupBy("view", "sample", "code").agg(F.count(F.lit(1)).alias("n")).groupBy("view", "sample").agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("sq"))
    overlap = same.where("s > 1").groupBy("view").agg(F.avg((F.col("sq") - F.col("s")) / (F.col("s") * (F.col("s") - 1))).alias("o"))
    even_shares = F.array_repeat(F.lit(even), codes)
    parts = [
        _named(_mean_probs(rows, []), "balance", to_even(F.col("q"))),
        _named(slot, "slot_balance", F.avg("kl")),
        _named(hard, "hard_balance", F.max(kl(even_shares, F.col("shares")))),
        _named(per_view, "assignment_entropy", F.avg("h")),
        _named(flat.unionAll(by_slot), "hard_entropy_shortfall", F.avg("s")),
        _named(hard, "capacity_excess", F.max(excess)),
        _named(overlap, "slot_overlap", F.avg("o")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def _against_batch(rows: DataFrame, by: list[str], cell: list[str], value: str) -> Column | DataFrame:
    """Mean over (by, group) of the divergence of the batch's mean from the group's mean."""
    own = rows.groupBy(*by, "group", *cell).agg(F.avg(value).alias("own"))
    batch = rows.groupBy(*by, *cell).agg(F.avg(value).alias("all"))
    both = own.join(batch, [*by, *cell])
    term = floored(F.col("all")) * (F.ln(floored(F.col("all"))) - F.ln(floored(F.col("own"))))
    return both.groupBy(*by, "group").agg(F.sum(term).alias("kl"))


def group_uniformity(rows: DataFrame) -> DataFrame:
    """(loss, value): how far the codes of a group of two or more samples are from those of all.

    Over all slots together, per slot, and per pair of slots (joint codes).
    """
    sizes = rows.groupBy("group").agg(F.count_distinct("sample").alias("samples")).where("samples > 1").select("group")
    long = rows.select("view", "sample", "group", "slot", F.posexplode("probs").alias("c", "p"))
    right = long.select("view", "sample", F.col("slot").alias("slot2"), F.col("c").alias("c2"), F.col("p").alias("p2"))
    joint = long.join(right, ["view", "sample"]).where("slot < slot2").withColumn("joint", F.col("p") * F.col("p2"))
    several = lambda d: d.join(sizes, "group", "left_semi")
    return (
        _named(several(_against_batch(long, ["view"], ["c"], "p")), "group", F.avg("kl"))
        .unionAll(_named(several(_against_batch(long, ["view", "slot"], ["c"], "p")), "group_slot", F.avg("kl")))
        .unionAll(_named(several(_against_batch(joint, ["view", "slot", "slot2"], ["c", "c2"], "joint")), "group_pair", F.avg("kl")))
    )


def view_agreement(rows: DataFrame, student: str, teacher: str, uncertainty: float = 0.0, disagreement: float = 0.0, bias: float = 0.0) -> DataFrame:
    """One row: consistency (JS), divergence weighted by the teacher's confidence, equal codes.

    With a correction (any of the three weights set), the teacher's weight is also gated by the
    student's uncertainty and by how far the views disagree.
    """
    a = rows.where(F.col("view") == student).select("sample", "slot", F.col("probs").alias("s"), F.col("code").alias("sc"))
    b = rows.where(F.col("view") == teacher).select("sample", "slot", F.col("probs").alias("t"), F.col("code").alias("tc"))
    pair = a.join(b, ["sample", "slot"])
    top = F.log(F.size("t").cast("double"))
    sure = lambda p: 1.0 - entropy(F.col(p)) / top
    pair = pair.select("sc", "tc", js(F.col("s"), F.col("t")).alias("js"), kl(F.col("t"), F.col("s")).alias("kl"), sure("t").alias("wt"), sure("s").alias("ws"), top.alias("top"))
    weight = F.col("wt")
    if uncertainty or disagreement or bias:
        raw = bias + uncertainty * (1.0 - F.col("ws")) + disagreement * F.sqrt(F.greatest(F.col("js"), F.lit(0.0)) / F.col("top"))
        weight = weight / (1.0 + F.exp(-raw))
    return pair.agg(F.avg("js").alias("consistency"), F.avg(F.col("kl") * weight).alias("gated_kl"), F.avg((F.col("sc") == F.col("tc")).cast("double")).alias("agreement"), F.count(F.lit(1)).alias("n"))


# --------------------------------------------------------------------------- motion


def _dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def _minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def motion_losses(patches: DataFrame, key: str, gamma: float = 2.0, max_weight: float = 6.0, magnitude: float = 0.25) -> DataFrame:
    """(key, plain, focused, delta) from patch rows (key, target, current, recon arrays).

    plain: mean square error; focused: the same, weighted by each patch's motion; delta: 1 - cosine
    of the two changes plus the relative error of their length, weighted by the true length.
    """
    moved, made, error = _minus(F.col("target"), F.col("current")), _minus(F.col("recon"), F.col("current")), _minus(F.col("recon"), F.col("target"))
    per = patches.select(key, _dot(moved, moved).alias("mm"), _dot(made, made).alias("rr"), _dot(moved, made).alias("mr"), _dot(error, error).alias("ee"), F.size("target").alias("d"))
    norm = lambda c: F.greatest(F.sqrt(c), F.lit(1e-6))
    per = per.withColumns({"tn": norm(F.col("mm")), "rn": norm(F.col("rr")), "motion": F.col("mm") / F.col("d"), "error": F.col("ee") / F.col("d")})
    turn = F.least(F.greatest(1.0 - F.col("mr") / (F.col("tn") * F.col("rn")), F.lit(0.0)), F.lit(2.0))
    size = F.pow((F.col("rn") - F.col("tn")) / F.greatest(F.col("tn"), F.lit(0.05)), 2)
    per = per.withColumn("delta", (turn + magnitude * size) * F.col("tn"))
    got = per.groupBy(key).agg(
        F.avg("error").alias("plain"), (F.avg("delta") / F.greatest(F.avg("tn"), F.lit(1e-6))).alias("delta"), F.avg("motion").alias("m"), F.collect_list(F.struct("motion", "error")).alias("x")
    )
    raw = lambda v: 1.0 + gamma * v["motion"] / floored(F.col("m"))
    held = (lambda v: F.least(raw(v), F.lit(max_weight))) if max_weight > 0 else raw
    total = _sum(F.transform("x", held)) / F.size("x")
    focused = _sum(F.transform("x", lambda v: held(v) * v["error"])) / F.size("x") / floored(total)
    return got.select(key, "plain", focused.alias("focused"), "delta")


def contrast(df: DataFrame, good: str, bad: str, margin: float, weight: str | None = None) -> Column:
    """Mean of max(0, margin + good - bad), each times its weight over the mean weight."""
    penalty = F.greatest(F.lit(margin) + F.col(good) - F.col(bad), F.lit(0.0))
    if weight is None:
        return F.avg(penalty)
    return F.avg(penalty * F.col(weight)) / F.greatest(F.avg(weight), F.lit(1e-6))


# --------------------------------------------------------------------------- schedules and masks


def loss_schedule(step: Column, total: Column | int) -> dict[str, Column]:
    """Weights of the three base losses at a step: a ramp over the first fifth, then constant."""
    p = F.least(F.greatest(step / F.greatest(F.lit(total) if isinstance(total, int) else total, F.lit(1)), F.lit(0.0)), F.lit(1.0))
    early = p < 0.2
    return {
        "self": F.when(early, 1.0).otherwise(0.2),
        "swap": F.when(early, 0.5 * (p / 0.2)).otherwise(1.0),
        "kl": F.when(~early, 0.1).when(p < 0.1, 0.0).otherwise(0.1 * ((p - 0.1) / 0.1)),
    }


def aux_schedule(step: Column, total: Column | int, base: float, start: float, ramp: float) -> Column:
    """Zero up to ``start``, then a linear ramp to ``base``; at once where the ramp has no length."""
    if base <= 0:
        return F.lit(0.0)
    p = F.least(F.greatest(step / F.greatest(F.lit(total) if isinstance(total, int) else total, F.lit(1)), F.lit(0.0)), F.lit(1.0))
    rising = F.lit(base) if ramp <= 0 else base * F.least((p - start) / ramp, F.lit(1.0))
    return F.when(p <= start, 0.0).otherwise(rising)


def pointwise(prediction: Column, target: Column, loss: str = "smooth_l1") -> Column:
    """l1, mse or smooth_l1 (quadratic below 1) of one value."""
    d = F.abs(prediction - target)
    if loss == "l1":
        return d
    if loss == "mse":
        return d * d
    if loss == "smooth_l1":
        return F.when(d < 1, 0.5 * d * d).otherwise(d - 0.5)
    raise ValueError(f"no such loss: {loss}")


def cross_entropy(logits: Column, label: Column) -> Column:
    """ln of the summed exponentials minus the logit of ``label`` (from 0)."""
    top = F.array_max(logits)
    return top + F.ln(_sum(F.transform(logits, lambda x: F.exp(x - top)))) - F.element_at(logits, label.cast("int") + 1)


def masked(value: Column, weight: Column) -> Column:
    """Aggregate: sum(w v) / max(sum(w), 1) over rows with a positive weight.

    A missing mask (null weight) is no supervision, and a value under it, also NaN, counts
    nothing. A negative or non-finite weight raises.
    """
    bad = F.isnan(weight) | (weight < 0) | (weight == float("inf"))
    w = F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit("mask weights must be finite and not negative")).cast("double")).otherwise(F.coalesce(weight.cast("double"), F.lit(0.0)))
    return F.coalesce(F.sum(F.when(w > 0, w * value)), F.lit(0.0)) / F.greatest(F.sum(w), F.lit(1.0))
