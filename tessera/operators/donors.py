"""Counterpart rows: same-group top-k, other-phase, offset, permutation and nearest donors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def same_group_pairs(df: DataFrame, group: str, key: str, time: str, low: float, high: float, carry: Sequence[str]) -> DataFrame:
    """Ordered pairs of a group with low <= |dt| <= high; donor columns get the suffix ``_d``.

    The gap is part of the equi key through time buckets of width ``high``, so a long group
    is a local join and not a product.
    """
    a = df.select(group, key, time, *carry)
    b = df.select(group, F.col(key).alias(f"{key}_d"), F.col(time).alias(f"{time}_d"), *[F.col(c).alias(f"{c}_d") for c in carry])
    width = max(float(high), 1e-9)
    slot = F.floor(F.col(time) / width)
    a = a.withColumn("__slot", F.explode(F.sequence(slot - 1, slot + 1)))
    b = b.withColumn("__slot", F.floor(F.col(f"{time}_d") / width))
    gap = F.abs(F.col(time) - F.col(f"{time}_d"))
    return a.join(b, [group, "__slot"]).where((F.col(key) != F.col(f"{key}_d")) & gap.between(low, high)).withColumn("gap", gap).drop("__slot")


def top_donors(pairs: DataFrame, key: str, score: Column, k: int, tie: str) -> DataFrame:
    """Adds score and rank (1..k) per anchor; ties by donor. The rank filter prunes inside the sort."""
    w = Window.partitionBy(key).orderBy(F.desc("score"), tie)
    return pairs.withColumn("score", score).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def other_phase(df: DataFrame, group: str, key: str, time: str, phase: str, seed: int) -> DataFrame:
    """One donor of the same group and another phase: farthest in time, ties by seeded hash.

    Only the rows at the two time ends of each phase can be farthest, so those are the
    candidates and the join stays linear in the group.
    """
    low = F.lower(F.trim(phase))
    rows = df.select(group, key, time, low.alias("ph"))
    ends = rows.groupBy(group, "ph").agg(F.min(time).alias("lo"), F.max(time).alias("hi"))
    cand = rows.join(ends, [group, "ph"]).where((F.col(time) == F.col("lo")) | (F.col(time) == F.col("hi")))
    cand = cand.select(group, F.col(key).alias("donor"), F.col(time).alias("t_d"), F.col("ph").alias("ph_d"))
    pairs = rows.join(cand, group).where("ph <> ph_d")
    tie = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), F.col("donor").cast("string")), 256)
    w = Window.partitionBy(key).orderBy(F.desc("far"), "tie")
    return pairs.withColumn("far", F.abs(F.col(time) - F.col("t_d"))).withColumn("tie", tie).withColumn("rn", F.row_number().over(w)).where("rn = 1").select(group, key, "donor", "far")


def offset_donor(df: DataFrame, group: str, key: str, order: Sequence[str], k: int) -> DataFrame:
    """The row k later, else k earlier, else the row itself."""
    w = Window.partitionBy(group).orderBy(*order)
    ahead, back = F.lead(key, k).over(w), F.lag(key, k).over(w)
    return df.withColumn("donor", F.coalesce(ahead, back, F.col(key)))


def derangement(df: DataFrame, group: str, key: str, seed: str) -> DataFrame:
    """Next row of the group in hash order, cyclically: never itself in groups of two or more."""
    tie = F.sha2(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")), 256)
    w = Window.partitionBy(group).orderBy(tie)
    return df.withColumn("donor", F.coalesce(F.lead(key).over(w), F.first(key).over(w)))


def nearest_across(left: DataFrame, right: DataFrame, key: str, vector: str, block: int = 1_024) -> DataFrame:
    """(key, match, cosine): cosine top-1 of every left row in ``right``; ties to the smaller id.

    Both sides are packed into blocks of bounded size which meet by an equi-join on the block
    number; each block pair is one matrix product and leaves one row per left row.
    """
    n_right = max(1, -(-right.count() // block))
    n_left = max(1, -(-left.count() // block))

    def packed(df: DataFrame, n: int, name: str) -> DataFrame:
        def pack(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            x = np.stack(pdf["v"].to_numpy()).astype(np.float64)
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-8)
            return pd.DataFrame({name: [k[0]], "width": [x.shape[1]], "ids": [pdf["i"].to_numpy(np.int64).tobytes()], "data": [x.tobytes()]})

        rows = df.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("i"), F.col(vector).cast("array<double>").alias("v"))
        return rows.withColumn(name, F.pmod(F.xxhash64("i"), F.lit(n))).groupBy(name).applyInPandas(pack, f"{name} long, width int, ids binary, data binary")

    a = packed(left, n_left, "lb").select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_right - 1).cast("long"))).alias("rb"), "width", F.col("ids").alias("l_ids"), F.col("data").alias("l_data")
    )
    b = packed(right, n_right, "rb")

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                x, y = (np.frombuffer(d).reshape(-1, r.width) for d in (r.l_data, r.data))
                ids = np.frombuffer(r.ids, np.int64)
                order = np.argsort(ids)
                sims = x @ y[order].T
                best = sims.argmax(1)
                yield pd.DataFrame({key: np.frombuffer(r.l_ids, np.int64), "match": ids[order][best], "cosine": sims[np.arange(len(best)), best]})

    found = b.join(a, ["rb", "width"]).select("width", "ids", "data", "l_ids", "l_data").mapInPandas(match, f"{key} long, match long, cosine double")
    best = found.groupBy(key).agg(F.min(F.struct((-F.col("cosine")).alias("c"), "match")).alias("m"))
    return best.select(key, F.col("m.match").alias("match"), (-F.col("m.c")).alias("cosine"))
