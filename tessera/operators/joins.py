"""As-of, band, overlap, tiered and coverage joins; every one keeps an equi key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored


def override(base: DataFrame, extra: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Left join where a non-empty right value replaces the left one."""
    right = extra.select(F.col(key), *[F.nullif(F.col(c).cast("string"), F.lit("")).alias(f"__{c}") for c in columns])
    out = base.join(right, key, "left")
    for c in columns:
        kind = base.schema[c].dataType if c in base.columns else "string"
        out = out.withColumn(c, F.coalesce(F.col(f"__{c}").try_cast(kind), F.col(c)) if c in base.columns else F.col(f"__{c}"))
    return out.drop(*[f"__{c}" for c in columns])


def _bucketed(left: DataFrame, right: DataFrame, time: str, at: str, width: float) -> tuple[DataFrame, DataFrame]:
    """Time-bucket equi key for a band of ``width``: left rows go to the three near buckets."""
    slot = F.floor(F.col(at) / width)
    near = left.withColumn("__slot", F.explode(F.sequence(F.floor(F.col(time) / width) - 1, F.floor(F.col(time) / width) + 1)))
    return near, right.withColumn("__slot", slot)


def band(left: DataFrame, right: DataFrame, group: str, time: str, at: str, width: float) -> DataFrame:
    """All pairs of a group with |time - at| <= width. Right columns must differ from left's.

    Long groups are cut by a time bucket in the join key, so a hot group spreads over tasks.
    """
    near, slotted = _bucketed(left, right, time, at, width)
    return near.join(slotted, [group, "__slot"]).where(F.abs(F.col(time) - F.col(at)) <= width).drop("__slot")


def nearest(left: DataFrame, right: DataFrame, group: str, key: str, time: str, at: str, tie: str, width: float, carry: Sequence[str]) -> DataFrame:
    """As-of nearest within ``width`` (+1e-9); ties to the smallest ``tie``; unmatched rows are dropped."""
    pairs = band(left, right, group, time, at, width + 1e-9)
    row = F.struct(F.abs(F.col(time) - F.col(at)).alias("gap"), F.col(tie).alias("tie"), *[F.col(c) for c in carry])
    best = pairs.groupBy(group, key, time).agg(F.min(row).alias("__best"))
    return best.select(group, key, time, F.col("__best.gap").alias("gap"), *[F.col(f"__best.{c}").alias(c) for c in carry])


def overlapping(left: DataFrame, right: DataFrame, group: str, spans: tuple[str, str, str, str], width: float) -> DataFrame:
    """Pairs of a group whose intervals share a positive length (column ``overlap``).

    Both sides are exploded over the time buckets they touch; a pair is kept in the bucket
    where the overlap starts, so it appears once.
    """
    s, e, s2, e2 = spans
    cut = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.greatest(F.col(a), F.col(b)) / width)))
    a, b = left.withColumn("__slot", cut(s, e)), right.withColumn("__slot", cut(s2, e2))
    shared = F.least(e, e2) - F.greatest(s, s2)
    out = a.join(b, [group, "__slot"]).withColumn("overlap", shared)
    return out.where((F.col("overlap") > 0) & (F.col("__slot") == F.floor(F.greatest(s, s2) / width))).drop("__slot")


def containing(left: DataFrame, right: DataFrame, group: str, key: str, time: str, span: tuple[str, str], order: Sequence[str], carry: Sequence[str], width: float) -> DataFrame:
    """First closed interval (by start, then ``order``) that contains each row's time."""
    s, e = span
    slots = right.withColumn("__slot", F.explode(F.sequence(F.floor(F.col(s) / width), F.floor(F.greatest(F.col(s), F.col(e)) / width))))
    points = left.where(F.col(time).isNotNull() & ~F.isnan(time)).withColumn("__slot", F.floor(F.col(time) / width))
    pairs = points.join(slots, [group, "__slot"]).where(F.col(time).between(F.col(s), F.col(e)))
    row = F.struct(F.col(s).alias("s"), *[F.col(c).alias(f"o_{c}") for c in order], *[F.col(c) for c in carry])
    best = pairs.groupBy(group, key).agg(F.min(row).alias("__best"))
    return best.select(group, key, *[F.col(f"__best.{c}").alias(c) for c in carry])


def last_of(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row per key by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def tiered(left: DataFrame, right: DataFrame, tiers: Sequence[Sequence[str]], value: str, order: Sequence[str]) -> DataFrame:
    """Left join by the first key set that matches; each tier's right side keeps its last row."""
    out, found = left, []
    for n, keys in enumerate(tiers):
        side = last_of(right.dropna(subset=list(keys)), keys, order).select(*keys, F.col(value).alias(f"__v{n}"))
        out = out.join(side, list(keys), "left")
        found.append(F.col(f"__v{n}"))
    tier = F.coalesce(*[F.when(c.isNotNull(), F.lit(n + 1)) for n, c in enumerate(found)], F.lit(0))
    return out.withColumn(value, F.coalesce(*found)).withColumn("tier", tier).drop(*[f"__v{n}" for n in range(len(tiers))])


def coverage(expected: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """Counts of keys that only one side has; exact coverage is (0, 0)."""
    a, b = expected.select(key).distinct(), observed.select(key).distinct()
    return a.withColumn("__e", F.lit(1)).join(b.withColumn("__o", F.lit(1)), key, "full").agg(
        F.count_if(F.col("__o").isNull()).alias("missing"), F.count_if(F.col("__e").isNull()).alias("unexpected"), F.count("*").alias("total")
    )


def lineage(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """(node, root, depth) of every child: the end of its chain of parents and the steps to it.

    Pointer jumping: each round doubles the steps that a node looks ahead, so a chain of any
    length takes its logarithm in rounds, each a join of two tables in the shared folder. Nodes
    on a cycle, and nodes that run into one, reach no root: root and depth are null. A child
    with several parents follows the least.
    """
    pairs = edges.where(F.col(parent).isNotNull()).groupBy(F.col(child).alias("node")).agg(F.min(parent).alias("at"))
    now = stored(pairs.withColumn("depth", F.lit(1).cast("long")), "lineage")
    ended = None
    left = now.count()
    for _ in range(max(1, left).bit_length() + 1):
        there = now.select(F.col("node").alias("at"), F.col("at").alias("next"), F.col("depth").alias("more"))
        ahead = stored(now.join(there, "at", "left"), "lineage")
        found = ahead.where("next IS NULL").select("node", F.col("at").alias("root"), "depth")
        # what has ended serves those that still walk, so it stays in the table that is looked up
        now = ahead.select("node", F.coalesce("next", "at").alias("at"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        ended = found
        left = ahead.where("next IS NOT NULL").count()
        if not left:
            break
    walked = now.select("node").join(ended, "node", "left")
    return walked.select("node", "root", F.col("depth").cast("int").alias("depth"))
