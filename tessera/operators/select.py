"""Time-covering, balanced, quota and round-robin selection; all shuffles are hash orders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import hash_order
from ..session import stored


def global_rank(df: DataFrame, hashed: str, tie: str, out: str, digits: int = 3) -> DataFrame:
    """1-based rank in the order of a hex hash, in two levels: inside a prefix of ``digits``, and
    before it (16^digits counts), so no task sorts the whole table."""
    keyed = df.withColumn("__pre", F.substring(hashed, 1, digits))
    counts = keyed.groupBy("__pre").agg(F.count("*").alias("__c"))
    upto = F.sum("__c").over(Window.orderBy("__pre"))
    before = counts.select("__pre", (upto - F.col("__c")).alias("__before"))
    inner = F.row_number().over(Window.partitionBy("__pre").orderBy(hashed, tie))
    return keyed.join(F.broadcast(before), "__pre").withColumn(out, F.col("__before") + inner).drop("__pre", "__before")


def dense_index(df: DataFrame, key: str, out: str, parts: int | None = None) -> DataFrame:
    """(key, out): distinct keys in ascending order as 0, 1, ...; null comes first.

    Keys are dealt by range; a task numbers its own and adds the counts of the ranges before.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.select(key).distinct().repartitionByRange(n, key).sortWithinPartitions(key)
    dealt = stored(dealt.withColumn("__part", F.spark_partition_id()), "dense-index")
    counts = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__c"))
    before = counts.select("__part", (F.sum("__c").over(Window.orderBy("__part")) - F.col("__c")).alias("__before"))
    inner = F.row_number().over(Window.partitionBy("__part").orderBy(key)) - 1
    return dealt.join(F.broadcast(before), "__part").select(key, (F.col("__before") + inner).cast("bigint").alias(out))


def time_bins(df: DataFrame, group: str, time: Sequence[str], score: str, k: Column | int) -> DataFrame:
    """Best row of each of k equal time bins per group; groups of at most k rows stay whole.

    Bins are those of a near-even split: the first ``n mod k`` bins have one row more.
    """
    k = F.lit(k) if isinstance(k, int) else k
    by_time = Window.partitionBy(group).orderBy(*time)
    ranked = df.withColumn("__k", k).withColumn("__n", F.count("*").over(Window.partitionBy(group))).withColumn("__i", F.row_number().over(by_time) - 1)
    base, extra = F.floor(F.col("__n") / F.col("__k")), F.col("__n") % F.col("__k")
    long_part = extra * (base + 1)
    bin_of = F.when(F.col("__i") < long_part, F.floor(F.col("__i") / (base + 1))).otherwise(extra + F.floor((F.col("__i") - long_part) / F.greatest(base, F.lit(1))))
    binned = ranked.withColumn("__bin", F.when(F.col("__n") <= F.col("__k"), F.col("__i")).otherwise(bin_of))
    best = Window.partitionBy(group, "__bin").orderBy(F.desc(score), *time)
    return binned.withColumn("__rn", F.row_number().over(best)).where("__rn = 1 AND __k > 0").drop("__k", "__n", "__i", "__bin", "__rn")


def evenly_spaced(df: DataFrame, group: str, order: Sequence[str], k: int) -> DataFrame:
    """Rows at positions round(linspace(0, n-1, k)) of each group, halves to even."""
    w = Window.partitionBy(group).orderBy(*order)
    ranked = df.withColumn("__i", F.row_number().over(w) - 1).withColumn("__n", F.count("*").over(Window.partitionBy(group)))
    if k <= 1:
        return ranked.where("__i = 0").drop("__i", "__n") if k == 1 else df.limit(0)
    step = (F.col("__n") - 1) / F.lit(k - 1)
    wanted = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.rint(j * step).cast("int"))
    return ranked.where((F.col("__n") <= k) | F.array_contains(wanted, F.col("__i"))).drop("__i", "__n")


def middle_row(df: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """Row (n-1)//2 of each group."""
    w = Window.partitionBy(group).orderBy(*order)
    out = df.withColumn("__i", F.row_number().over(w) - 1).withColumn("__n", F.count("*").over(Window.partitionBy(group)))
    return out.where("__i = floor((__n - 1) / 2)").drop("__i", "__n")


def hash_first(df: DataFrame, key: str, n: int, seed: str, by: Sequence[str] = ()) -> DataFrame:
    """First n rows in hash order, per ``by`` group or over all."""
    ranked = df.withColumn("__h", hash_order(seed, key))
    if by:
        w = Window.partitionBy(*by).orderBy("__h", key)
        return ranked.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__h", "__rn")
    return ranked.orderBy("__h", key).limit(n).drop("__h")


def round_robin(df: DataFrame, strata: Sequence[str], key: str, n: int, seed: str) -> DataFrame:
    """Strata in turn, each in hash order, until n rows."""
    w = Window.partitionBy(*strata).orderBy("__h", key)
    turn = df.withColumn("__h", hash_order(seed, key)).withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= n)
    return turn.orderBy("turn", *strata).limit(n).drop("__h")


def two_level_round_robin(df: DataFrame, parent: str, sub: str, order: Sequence[str], n: int) -> DataFrame:
    """Cycle parents; inside each, cycle its sub keys; rows of a sub key in ``order``."""
    inner = Window.partitionBy(parent, sub).orderBy(*order)
    outer = Window.partitionBy(parent).orderBy("__turn", sub)
    out = df.withColumn("__turn", F.row_number().over(inner)).withColumn("round", F.row_number().over(outer)).where(F.col("round") <= n)
    return out.orderBy("round", parent).limit(n).drop("__turn")


def capped_quota(df: DataFrame, label: str, group: str, key: str, quota: dict[str, int], cap: int, seed: str, default: int = 0, slices: int = 64) -> DataFrame:
    """Per label: hash order with at most ``cap`` rows per group first, the rest as backfill.

    Labels without a quota get ``default``. A label is ranked in slices first, each of which
    passes on no more than the quota, so that a frequent label is not sorted in one task.
    """
    w = Window.partitionBy(label, group).orderBy("__h", key)
    ranked = df.withColumn("__h", hash_order(seed, key)).withColumn("__g", F.row_number().over(w))
    limit = F.coalesce(*[F.when(F.col(label) == k, F.lit(v)) for k, v in quota.items()], F.lit(default))
    ranked = ranked.withColumn("over_cap", (F.col("__g") > cap).cast("int")).withColumn("__slice", F.pmod(F.xxhash64(key), F.lit(slices)))
    for keys in ([label, "__slice"], [label]):
        pick = Window.partitionBy(*keys).orderBy("over_cap", "__h", key)
        ranked = ranked.withColumn("pick", F.row_number().over(pick)).where(F.col("pick") <= limit)
    return ranked.drop("__h", "__g", "__slice")


def stratified(df: DataFrame, stratum: str, key: str, n: int, seed: str) -> DataFrame:
    """max(1, n // groups) rows per stratum in hash order, then backfill to n by hash."""
    groups = df.agg(F.count_distinct(stratum)).scalar()
    each = F.greatest(F.lit(1), F.floor(F.lit(n) / groups))
    w = Window.partitionBy(stratum).orderBy("__h", key)
    ranked = df.withColumn("__h", hash_order(seed, key)).withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n)
    return ranked.withColumn("__late", (F.col("__r") > each).cast("int")).orderBy("__late", "__h", key).limit(n).drop("__h", "__r", "__late")


def balanced_allocation(df: DataFrame, group: str, key: str, n: int, seed: str) -> DataFrame:
    """n rows over all groups: base per group, the first ``remainder`` groups (hash order) one more."""
    groups = df.select(group).distinct()
    total = groups.agg(F.count("*")).scalar()
    place = groups.withColumn("__gh", hash_order(seed, group))
    place = global_rank(place, "__gh", group, "__place")
    quota = F.floor(F.lit(n) / total) + F.when(F.col("__place") <= F.lit(n) % total, 1).otherwise(0)
    place = place.withColumn("quota", quota).select(group, "quota")
    rows = Window.partitionBy(group).orderBy("__h", key)
    return df.join(place, group).withColumn("__h", hash_order(seed, key)).withColumn("__r", F.row_number().over(rows)).where("__r <= quota").drop("__h", "__r")


def weighted_draw(df: DataFrame, key: str, weight: str, draws: int, seed: str, digits: int = 3) -> DataFrame:
    """(draw, key): ``draws`` samples with replacement in proportion to whole positive weights.

    Keys lie on a line in the order of their hash, each as long as its weight; a draw's own hash
    is a point on it. Running sums are taken in two levels (inside a hash prefix of ``digits``,
    and before it), so no window spans the table; sums of whole numbers are exact.
    """
    rows = df.where(F.col(weight) > 0).select(key, F.col(weight).cast("bigint").alias("w"), F.sha2(F.col(key).cast("string"), 256).alias("h"))
    rows = rows.withColumn("slice", F.substring("h", 1, digits))
    sums = rows.groupBy("slice").agg(F.sum("w").alias("s"))
    offsets = sums.withColumn("upto", F.sum("s").over(Window.orderBy("slice"))).select("slice", (F.col("upto") - F.col("s")).alias("lo"), F.col("upto").alias("hi"))
    inner = Window.partitionBy("slice").orderBy("h", key)
    cumulative = rows.join(F.broadcast(offsets), "slice").withColumn("to", F.col("lo") + F.sum("w").over(inner)).withColumn("from", F.col("to") - F.col("w"))
    total = sums.agg(F.sum("s")).scalar()
    unit = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("draw").cast("string")), 256), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
    points = df.sparkSession.range(draws).withColumnRenamed("id", "draw").withColumn("x", F.floor(unit * total.cast("double")))
    bounds = points.join(F.broadcast(offsets), (F.col("x") >= F.col("lo")) & (F.col("x") < F.col("hi"))).select("draw", "x", "slice")
    return cumulative.join(bounds, "slice").where("x >= `from` AND x < `to`").select("draw", key)
