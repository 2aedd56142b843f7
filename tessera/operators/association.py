"""Counts, entropies and association between categorical columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _plogp(n: Column, total: Column) -> Column:
    p = n / total
    return F.when(n > 0, -p * F.ln(p)).otherwise(0.0)


def association(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """n, entropies, mutual information, NMI by the geometric mean, purity both ways.

    Works on the contingency table (one row per pair of values), not on the rows.
    """
    by = list(by)
    n = df.groupBy(*by, a, b).agg(F.count("*").cast("double").alias("n_ab"))
    wa, wb, w = Window.partitionBy(*by, a), Window.partitionBy(*by, b), Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    t = n.withColumns({"n_a": F.sum("n_ab").over(wa), "n_b": F.sum("n_ab").over(wb), "n": F.sum("n_ab").over(w)})
    t = t.withColumns(
        {
            "r_a": F.row_number().over(wa.orderBy(F.desc("n_ab"), b)),
            "r_b": F.row_number().over(wb.orderBy(F.desc("n_ab"), a)),
        }
    )
    mi = F.sum(F.col("n_ab") / F.col("n") * F.ln(F.col("n_ab") * F.col("n") / (F.col("n_a") * F.col("n_b"))))
    ha = F.sum(F.when(F.col("r_a") == 1, _plogp(F.col("n_a"), F.col("n"))).otherwise(0.0))
    hb = F.sum(F.when(F.col("r_b") == 1, _plogp(F.col("n_b"), F.col("n"))).otherwise(0.0))
    got = t.groupBy(*by).agg(
        F.max("n").cast("bigint").alias("n"),
        ha.alias("h_a"),
        hb.alias("h_b"),
        mi.alias("mi"),
        (F.sum(F.when(F.col("r_b") == 1, F.col("n_ab"))) / F.max("n")).alias("purity_a_given_b"),
        (F.sum(F.when(F.col("r_a") == 1, F.col("n_ab"))) / F.max("n")).alias("purity_b_given_a"),
    )
    root = F.sqrt(F.col("h_a") * F.col("h_b"))
    return got.withColumn("nmi", F.when(root > 0, F.col("mi") / root).otherwise(0.0)).withColumn("h_a_given_b", F.col("h_a") - F.col("mi")).withColumn("h_b_given_a", F.col("h_b") - F.col("mi"))


def conditional_association(df: DataFrame, a: str, b: str, condition: str, least: int) -> DataFrame:
    """Size-weighted mean NMI and MI over the groups of a condition with enough rows."""
    per = association(df, a, b, [condition]).where(F.col("n") >= least)
    total = F.sum("n")
    return per.agg(
        F.count("*").alias("groups"), F.sum("n").alias("rows"), (F.sum(F.col("nmi") * F.col("n")) / total).alias("nmi"), (F.sum(F.col("mi") * F.col("n")) / total).alias("mi")
    )


def top_conditional(df: DataFrame, key: str, value: str, least: int, keys: int, values: int) -> DataFrame:
    """Top values of each of the largest keys; counts under ``least`` go first, ties by name."""
    n = df.groupBy(key, value).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    kept = n.groupBy(key).agg(F.sum("n").alias("retained")).orderBy(F.desc("retained"), key).limit(keys)
    w = Window.partitionBy(key).orderBy(F.desc("n"), value)
    return n.join(kept, key).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= values)


def usage(df: DataFrame, code: str, codes: int) -> DataFrame:
    """used, fraction, effective codes exp(H) and the largest share."""
    n = df.groupBy(code).agg(F.count("*").cast("double").alias("c"))
    p = F.col("c") / n.agg(F.sum("c")).scalar()
    shares = n.withColumn("p", p)
    return shares.agg(
        F.count("*").alias("used"), (F.count("*") / F.lit(codes)).alias("usage_fraction"), F.exp(F.sum(-F.col("p") * F.ln("p"))).alias("effective_codes"), F.max("p").alias("max_fraction")
    )


def zero_filled(df: DataFrame, code: str, codes: int) -> DataFrame:
    """(code, n) for every code 0..codes-1."""
    n = df.groupBy(F.col(code).cast("long").alias("code")).agg(F.count("*").alias("n"))
    return df.sparkSession.range(codes).withColumnRenamed("id", "code").join(n, "code", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def describe(value: str) -> list[Column]:
    """count, mean, population deviation, standard error, lower median, p90, min, max."""
    x = F.col(value)
    n = F.count(x)
    return [
        n.alias("n"),
        F.avg(x).alias("mean"),
        F.stddev_pop(x).alias("std"),
        (F.stddev_pop(x) / F.sqrt(n.cast("double"))).alias("stderr"),
        F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{value}`)").alias("lower_median"),
        F.percentile(x, 0.9).alias("p90"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
    ]


def ablation(metrics: DataFrame, key: str, mode: str, value: str, base: str) -> DataFrame:
    """Each mode against the base mode on the same key: mean delta, ratio, fraction worse."""
    b = metrics.where(F.col(mode) == base).select(key, F.col(value).alias("__base"))
    joined = metrics.where(F.col(mode) != base).join(b, key)
    delta = F.col(value) - F.col("__base")
    return joined.groupBy(mode).agg(
        F.count("*").alias("n"),
        F.avg(delta).alias("delta_mean"),
        F.percentile(delta, 0.5).alias("delta_median"),
        F.try_divide(F.avg(value), F.avg("__base")).alias("ratio"),
        F.avg((delta > 0).cast("double")).alias("fraction_worse"),
    )


def kl_to_uniform(df: DataFrame, slot: str, code: str, prob: str, codes: int) -> DataFrame:
    """KL(uniform || mean assignment) per slot from long (slot, code, probability) rows."""
    mean = df.groupBy(slot, code).agg(F.avg(prob).alias("q"))
    u = 1.0 / codes
    return mean.groupBy(slot).agg(F.sum(F.lit(u) * F.ln(F.lit(u) / F.greatest(F.col("q"), F.lit(1e-9)))).alias("kl"))


def masked_mean(value: Column, weight: Column) -> Column:
    """sum(w x) / max(sum(w), 1); rows with a null or NaN value have no weight."""
    fine = value.isNotNull() & ~F.isnan(value)
    w = F.when(fine, F.coalesce(weight, F.lit(0.0))).otherwise(0.0)
    return F.coalesce(F.sum(w * F.when(fine, value).otherwise(0.0)), F.lit(0.0)) / F.greatest(F.coalesce(F.sum(w), F.lit(0.0)), F.lit(1.0))
