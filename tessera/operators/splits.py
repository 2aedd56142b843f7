"""Leak-free splits, overlap audits, stride rows, allow lists and subset proofs."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import hash_order
from .select import global_rank

# Roles that never train, after lower-casing and ``-`` to ``_``.
FORBIDDEN_PARTS = ("probe", "diagnostic", "locked")


def group_split(df: DataFrame, group: str, fraction: float, seed: str) -> DataFrame:
    """Adds split: the first max(1, round(n f)) groups in hash order are held out."""
    groups = df.select(group).distinct()
    n = groups.agg(F.count("*")).scalar()
    ranked = global_rank(groups.withColumn("__h", hash_order(seed, group)), "__h", group, "__rank")
    held = F.greatest(F.lit(1), F.rint(n * F.lit(fraction)).cast("bigint"))
    side = ranked.select(group, F.when(F.col("__rank") <= held, "heldout").otherwise("train").alias("split"))
    return df.join(side, group)


def set_overlap(left: DataFrame, right: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """(kind, shared): distinct values of each kind on both sides."""
    parts = []
    for kind, column in kinds.items():
        a, b = left.select(F.col(column).cast("string").alias("v")).distinct(), right.select(F.col(column).cast("string").alias("v")).distinct()
        parts.append(a.join(b, "v", "left_semi").agg(F.count("*").alias("shared")).select(F.lit(kind).alias("kind"), "shared"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def pairwise_overlap(df: DataFrame, name: str, value: str) -> DataFrame:
    """(left, right, shared) of every pair of named sets that share a value."""
    v = df.select(name, value).distinct()
    a = v.select(F.col(name).alias("left_name"), value)
    b = v.select(F.col(name).alias("right_name"), value)
    return a.join(b, value).where("left_name < right_name").groupBy("left_name", "right_name").agg(F.count("*").alias("shared"))


def frames_of(start: Column, seconds: float, fps: float) -> Column:
    """Frames between the rounded ends of an interval, both included."""
    first, last = F.rint(start * fps).cast("bigint"), F.rint((start + seconds) * fps).cast("bigint")
    return F.sequence(first, F.greatest(first, last))


def stride_rows(df: DataFrame, key: str, start: str, end: str, stride: float, length: float, most: int) -> DataFrame:
    """(key, row, t) at a fixed stride, and status; groups without room give one row with null t."""
    room = F.floor((F.col(end) - length - F.col(start)) / stride) + 1
    n = F.least(F.lit(most), F.greatest(room, F.lit(0)))
    status = F.when(room < 1, "insufficient_duration").when(room < most, "partial").otherwise("ok")
    rows = df.select(key, start, n.cast("int").alias("n"), status.alias("status"))
    rows = rows.withColumn("row", F.explode_outer(F.when(F.col("n") > 0, F.sequence(F.lit(0), F.col("n") - 1))))
    return rows.select(key, "row", (F.col(start) + F.col("row") * stride).alias("t"), "status")


def forbidden_role(columns: Sequence[str], exact: Sequence[str] = ()) -> Column:
    """Any role column that names a probe, diagnostic or locked use, or an exact value."""
    norm = lambda c: F.replace(F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))), F.lit("-"), F.lit("_"))
    bad = lambda v: F.array_contains(F.array(*[F.lit(x) for x in exact]), v) if exact else F.lit(False)
    out = F.lit(False)
    for c in columns:
        v = norm(c)
        for part in FORBIDDEN_PARTS:
            out = out | v.contains(part)
        out = out | bad(v)
    return out


def subset_mismatch(child: DataFrame, parent: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """One row: child rows without parent, and rows that differ in any column (null-safe)."""
    p = parent.select(F.col(key), *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__there"))
    joined = child.select(key, *columns).join(p, key, "left")
    differ = F.lit(False)
    for c in columns:
        differ = differ | ~F.col(c).eqNullSafe(F.col(f"__{c}"))
    return joined.agg(
        F.count("*").alias("rows"), F.count_if(F.col("__there").isNull()).alias("orphans"), F.count_if(F.col("__there").isNotNull() & differ).alias("differing")
    )


def published_digest(df: DataFrame, key: str) -> DataFrame:
    """(n, digest): sha256 of the sorted ids as text, a newline after each; of nothing for no ids.

    A digest of one text is read in order, so the sorted ids stream through the driver, one
    partition at a time; ``id_digest`` compares large tables without that.
    """
    total, n = hashlib.sha256(), 0
    for row in df.select(F.col(key).cast("string").alias("id")).where("id IS NOT NULL").orderBy("id").toLocalIterator():
        total.update(row.id.encode() + b"\n")
        n += 1
    return df.sparkSession.createDataFrame([(n, total.hexdigest())], "n long, digest string")


def id_digest(df: DataFrame, key: str) -> DataFrame:
    """sha256 over the sorted ids, each followed by a newline, per two-digit hash slice and over the slices.

    Slices bound what one row collects: the digest of digests equals on both sides exactly
    when the id multisets do.
    """
    text = F.col(key).cast("string")
    slices = df.groupBy(F.substring(F.sha2(text, 256), 1, 2).alias("slice")).agg(F.array_join(F.sort_array(F.collect_list(text)), "\n").alias("ids"), F.count("*").alias("n"))
    each = slices.select("slice", "n", F.sha2(F.concat("ids", F.lit("\n")), 256).alias("digest"))
    return each.agg(F.sum("n").alias("n"), F.sha2(F.concat(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "slice", "digest"))), "\n"), F.lit("\n")), 256).alias("digest"))
