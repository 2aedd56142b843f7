"""Counts, shares, roll-ups, ordered picks and text helpers for reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import yes


def strata_counts(df: DataFrame, label: str, flags: Sequence[str]) -> DataFrame:
    """(stratum, n): ``label|flag=true|...`` of every row."""
    parts = [F.coalesce(F.col(label).cast("string"), F.lit(""))]
    parts += [F.concat(F.lit(f"{f}="), F.coalesce(F.col(f).cast("string"), F.lit("false"))) for f in flags]
    return df.groupBy(F.concat_ws("|", *parts).alias("stratum")).agg(F.count(F.lit(1)).alias("n"))


def group_mass(df: DataFrame, group: str, weight: str) -> DataFrame:
    """(group, mass): weights summed, those below 0 as 0."""
    return df.groupBy(group).agg(F.sum(F.greatest(F.coalesce(weight, F.lit(0.0)), F.lit(0.0))).alias("mass"))


def offset_stats(df: DataFrame, by: Sequence[str], offset: str) -> DataFrame:
    """Greatest, median and 90th percentile of absolute offsets."""
    gap = F.abs(F.col(offset))
    return df.groupBy(*by).agg(F.max(gap).alias("most"), F.percentile(gap, 0.5).alias("median"), F.percentile(gap, 0.9).alias("p90"))


def mapped_precision(df: DataFrame, mapped: str, matches: dict[str, Column], least: float) -> DataFrame:
    """One row: share of all rows that are mapped and right, per name, coverage, and a gate.

    The denominator is all rows, so a row that is not mapped is wrong.
    """
    ok = F.coalesce(F.col(mapped), F.lit(False))
    shares = [F.avg((ok & F.coalesce(c, F.lit(False))).cast("double")).alias(f"{n}_precision") for n, c in matches.items()]
    out = df.agg(F.count(F.lit(1)).alias("n"), F.avg(ok.cast("double")).alias("coverage"), *shares)
    names = [F.col(f"{n}_precision") for n in matches]
    return out.withColumn("passed", (F.least(*names) if len(names) > 1 else names[0]) >= least)


def review_fraction(df: DataFrame, decisions: Sequence[str], least: float) -> DataFrame:
    """One row: rows, those with all decisions yes, their share, rows with another word, and a gate.

    A row that is neither yes nor no somewhere is invalid and keeps the gate shut.
    """
    v = [F.lower(F.trim(F.coalesce(F.col(c), F.lit("")))) for c in decisions]
    bad, good = F.lit(False), F.lit(True)
    for x in v:
        bad, good = bad | ~x.isin("yes", "no"), good & (x == "yes")
    out = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(good).alias("n_passed"), F.count_if(bad).alias("invalid"))
    share = F.coalesce(F.try_divide(F.col("n_passed").cast("double"), F.col("n")), F.lit(0.0))
    return out.withColumn("fraction", share).withColumn("gate", (F.col("invalid") == 0) & (share >= least))


def token_report(rows: DataFrame, codes: int, code: str = "code", probs: str = "probs") -> DataFrame:
    """One row over assignments: codes' range, confidence, entropy (floored probabilities), in range or not."""
    h = -F.aggregate(F.transform(probs, lambda p: p * F.ln(F.least(F.greatest(p, F.lit(1e-8)), F.lit(1.0)))), F.lit(0.0), lambda a, x: a + x)
    sure = 1.0 - h / F.log(F.lit(float(codes)))
    got = rows.select(F.col(code).alias("c"), h.alias("h"), sure.alias("s")).agg(
        F.count(F.lit(1)).alias("n"), F.min("c").alias("token_min"), F.max("c").alias("token_max"), F.min("s").alias("confidence_min"),
        F.avg("s").alias("confidence_mean"), F.max("s").alias("confidence_max"), F.avg("h").alias("entropy_mean"), F.count_distinct("c").alias("used_codes"),
    )
    return got.withColumn("in_range", F.coalesce((F.col("token_min") >= 0) & (F.col("token_max") < codes), F.lit(False)))


def campaign_rollup(df: DataFrame, control: str, seed: str, score: str, leak: str, baseline: str) -> DataFrame:
    """Per control: mean score, its delta to the baseline, seeds with a positive delta, and the
    worst leakage, the greatest difference of mean leakages."""
    per = df.groupBy(control, seed).agg(F.avg(score).alias("s"), F.avg(leak).alias("l"))
    base = per.where(F.col(control) == baseline).select(seed, F.col("s").alias("s0"), F.col("l").alias("l0"))
    met = per.where(F.col(control) != baseline).join(base, seed)
    return met.groupBy(control).agg(
        F.count(F.lit(1)).alias("seeds"),
        F.avg(F.col("s") - F.col("s0")).alias("delta"),
        F.count_if(F.col("s") > F.col("s0")).alias("positive_seeds"),
        F.max(F.col("l") - F.col("l0")).alias("worst_leakage"),
    )


def top_examples(df: DataFrame, mask: Column, confidence: str, key: str, n: int = 12) -> DataFrame:
    """The n rows of a mask with the greatest confidence, ties by key; in that order."""
    return df.where(mask).orderBy(F.desc(confidence), key).limit(n)


def in_custom_order(df: DataFrame, column: str, values: Sequence[str], *rest: str) -> DataFrame:
    """Rows by the place of ``column`` in ``values`` (others last), then by the rest."""
    place = F.array_position(F.array(*[F.lit(v) for v in values]), F.col(column))
    return df.orderBy(F.when(F.coalesce(place, F.lit(0)) == 0, len(values) + 1).otherwise(place), *rest)


def page(df: DataFrame, position: str, start: int, limit: int | None) -> DataFrame:
    """Rows at positions start, start + 1, ... of an indexed table; all of them without a limit."""
    out = df.where(F.col(position) >= start)
    return out if limit is None else out.where(F.col(position) < start + limit)


def strongest(df: DataFrame, by: Sequence[str], what: str, delta: str) -> DataFrame:
    """(by..., what, delta) of the greatest delta per group, ties to the smaller name."""
    best = F.min_by(F.struct(delta, what), F.struct(-F.col(delta), F.col(what))).alias("__best")
    return df.groupBy(*by).agg(best).select(*by, "__best.*")


def partition_proof(parts: dict[str, DataFrame], whole: DataFrame, key: str) -> DataFrame:
    """One row: keys, keys in several parts, keys in no part, keys of parts that are not in the whole."""
    every = None
    for name, df in parts.items():
        p = df.select(key).distinct().withColumn("__p", F.lit(name))
        every = p if every is None else every.unionAll(p)
    per = every.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    met = whole.select(key).distinct().withColumn("__w", F.lit(True)).join(per, key, "full")
    return met.agg(
        F.count_if(F.col("__w")).alias("keys"),
        F.count_if(F.col("__n") > 1).alias("shared"),
        F.count_if(F.col("__w") & F.col("__n").isNull()).alias("uncovered"),
        F.count_if(F.col("__w").isNull()).alias("foreign"),
    )


def slug(c: str | Column) -> Column:
    """Lower case, runs of anything but letters and digits as one dash, none at the ends."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def padded(c: str | Column, width: int = 4) -> Column:
    """A whole number with leading zeros; longer ones stay whole."""
    c = F.col(c) if isinstance(c, str) else c
    s = c.cast("string")
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, "0"))


def after_last(c: str | Column, mark: str) -> Column:
    """What follows the last mark; all of the text without one."""
    c = F.col(c) if isinstance(c, str) else c
    return F.substring_index(c, mark, -1)


def is_sha256(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.rlike("^[0-9a-f]{64}$")


def checkpoint_step(c: str | Column) -> Column:
    """The whole number behind ``step`` in a file name, else null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.regexp_extract(c, r"step[_-]?(\d+)", 1), F.lit("")).cast("bigint")


def bool_and_of(columns: Sequence[str]) -> Column:
    """Whether every bool-like column is set; null counts as not."""
    out = F.lit(True)
    for c in columns:
        out = out & F.coalesce(yes(c), F.lit(False))
    return out


def first_per(df: DataFrame, by: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
