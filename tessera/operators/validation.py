"""Row rules, submissions and manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import violated


def failures(df: DataFrame, key: str, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """(key, rule) of every broken rule, and of repeated or missing keys."""
    broken = df.select(F.col(key).cast("string").alias(key), F.explode(violated([*rules, ("missing_key", F.coalesce(F.trim(F.col(key).cast("string")) == "", F.lit(True)))])).alias("rule"))
    again = df.groupBy(F.col(key).cast("string").alias(key)).agg(F.count("*").alias("n")).where("n > 1").select(key, F.lit("duplicate_key").alias("rule"))
    return broken.unionAll(again)


def submission_failures(expected: DataFrame, submitted: DataFrame, key: str, frozen: Sequence[str], rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """(key, rule): coverage, frozen columns (typed, null-safe) and rules on submitted columns.

    Columns of the submission are named ``s_<name>`` inside rules.
    """
    there = submitted.select(F.col(key), *[F.col(c).alias(f"s_{c}") for c in submitted.columns if c != key], F.lit(True).alias("__s"))
    joined = expected.withColumn("__e", F.lit(True)).join(there, key, "full")
    both = F.col("__e") & F.col("__s")
    checks = [("missing_row", F.col("__s").isNull()), ("unexpected_row", F.col("__e").isNull())]
    checks += [(f"changed_{c}", both & ~F.col(c).eqNullSafe(F.col(f"s_{c}"))) for c in frozen]
    checks += [(name, both & F.coalesce(rule, F.lit(True))) for name, rule in rules]
    return joined.select(F.col(key).cast("string").alias(key), F.explode(violated(checks)).alias("rule"))


def manifest_audit(df: DataFrame, split: str, group: str, time: str, capabilities: Sequence[str]) -> DataFrame:
    """Per split: rows, groups, rows per group (least, most), time range, true counts per capability."""
    per = df.groupBy(split, group).agg(F.count("*").alias("n"), F.min(time).alias("t0"), F.max(time).alias("t1"), *[F.count_if(c).alias(c) for c in capabilities])
    return per.groupBy(split).agg(
        F.sum("n").alias("rows"), F.count("*").alias("groups"), F.min("n").alias("least_rows"), F.max("n").alias("most_rows"), F.min("t0").alias("first_time"), F.max("t1").alias("last_time"),
        *[F.sum(c).alias(f"{c}_true") for c in capabilities],
    )


def completed_capabilities(column: str, names: Sequence[str]) -> Column:
    """A complete capability map: missing keys are false."""
    blank = F.create_map(*[x for n in names for x in (F.lit(n), F.lit(False))])
    given = F.map_filter(F.coalesce(F.col(column), blank), lambda k, v: k.isin(*names) & v.isNotNull())
    rest = F.map_filter(blank, lambda k, v: ~F.map_contains_key(given, k))
    return F.map_concat(rest, given)


def assert_empty(df: DataFrame, what: str) -> None:
    """Raise ValueError when ``df`` has a row."""
    row = df.limit(1).collect()
    if row:
        raise ValueError(f"{what}: {row[0].asDict()}")
