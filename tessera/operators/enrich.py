"""Lookups, donors inside batches, substitutions and reports over joined rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import hash_order, number
from . import joins


def weight_lookup(keys: DataFrame, weights: DataFrame, key: str, weight: str, order: str, floor: float = 0.0, default: float = 0.0) -> DataFrame:
    """(key, weight, matched) of the distinct keys; the last row of a key wins.

    A weight is at least ``floor``; one that is no number counts 0 first, and a key without a
    row gets ``default``.
    """
    last = joins.last_of(weights.where(F.trim(F.col(key).cast("string")) != ""), [key], [order])
    last = last.select(key, F.greatest(number(weight, 0.0), F.lit(float(floor))).alias("weight"), F.lit(True).alias("matched"))
    got = keys.select(key).distinct().join(last, key, "left")
    return got.select(key, F.coalesce("weight", F.lit(float(default))).alias("weight"), F.coalesce("matched", F.lit(False)).alias("matched"))


def nearest_frame_rows(targets: DataFrame, entries: DataFrame, group: str, key: str, target: str, frame: str, most: float, carry: Sequence[str]) -> DataFrame:
    """All entries on the one frame of the group that is nearest to the target, ties to the earlier."""
    frames = entries.select(group, frame).distinct().select(group, F.col(frame).alias("__at"), F.col(frame).alias("__frame"))
    near = joins.nearest(targets.select(group, key, target), frames, group, key, target, "__at", "__at", most, ["__frame"])
    return near.select(group, key, F.col("__frame").alias(frame)).join(entries.select(group, frame, *carry), [group, frame])


def mask_entries(df: DataFrame, subject: str, camera: str, prefix: str, mask: str) -> DataFrame:
    """Entries of other things than hands and wrists, of cameras with a prefix, that have a mask."""
    name = F.regexp_replace(F.lower(F.col(subject)), "[- ]", "_")
    hands = name.contains("hand") | name.contains("wrist")
    return df.where(~hands & F.col(camera).startswith(prefix) & (F.coalesce(F.col(mask).cast("string"), F.lit("")) != ""))


def donor_failures(df: DataFrame, key: str, group: str, phase: str, donor: str) -> DataFrame:
    """(key, rule): unique keys and known phases; a donor is another row of the group and another phase."""
    known = F.coalesce(F.lower(F.trim(phase)), F.lit(""))
    d = df.select(F.col(key).alias("__d"), F.col(group).alias("__dg"), known.alias("__dp"))
    met = df.join(d, F.col(donor) == F.col("__d"), "left")
    rules = [
        ("unknown_phase", known.isin("", "unknown", "none")),
        ("own_donor", F.col(donor) == F.col(key)),
        ("donor_missing", F.col("__d").isNull()),
        ("donor_of_other_group", F.col("__dg") != F.col(group)),
        ("donor_of_same_phase", (F.col("__dp") == known) & (F.col(donor) != F.col(key))),
    ]
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules]))
    again = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key, F.lit("repeated_key").alias("rule"))
    return met.select(key, F.explode(names).alias("rule")).unionAll(again)


def eligibility_report(df: DataFrame, valid: str, phase: str, donor: str) -> DataFrame:
    """One row: rows, those dropped by the first reason that holds, those that stay."""
    known = ~F.coalesce(F.lower(F.trim(phase)), F.lit("")).isin("", "unknown", "none")
    ok = F.coalesce(F.col(valid), F.lit(False))
    has = F.col(donor).isNotNull()
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~ok).alias("nontraining"),
        F.count_if(ok & ~known).alias("unknown_phase"),
        F.count_if(ok & known & ~has).alias("no_donor"),
        F.count_if(ok & known & has).alias("eligible"),
    )


def cyclic_shift(df: DataFrame, by: Sequence[str], key: str, order: Sequence[str], shift: int) -> DataFrame:
    """Adds donor: the row ``shift`` places earlier in the group's order, cyclically.

    A shift that is a multiple of the group's size counts as one; a single row is its own donor.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    ranked = df.withColumn("__i", F.row_number().over(w) - 1).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    step = F.when(F.lit(shift) % F.col("__n") == 0, F.lit(1)).otherwise(F.lit(shift) % F.col("__n"))
    ranked = ranked.withColumn("__from", F.pmod(F.col("__i") - step, F.col("__n")))
    there = ranked.select(*by, F.col("__i").alias("__from"), F.col(key).alias("donor"))
    return ranked.join(there, [*by, "__from"]).drop("__i", "__n", "__from")


def _distance(a: str, b: str) -> Column:
    gap = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x))


def action_donors(df: DataFrame, by: Sequence[str], key: str, context: str, action: str, confidence: str, context_weight: float = 0.35) -> DataFrame:
    """(key, donor, weight): the row of the same batch and group with the most different action
    in the most similar context; ties to the smaller key.

    ``by`` names the batch and the group; a batch is of bounded size, so its pairs are too. The
    weight is the lower confidence times the action distance over its mean in the batch, held
    within 0.25 and 2. A row without a partner keeps itself with weight 0.
    """
    right = df.select(*by, F.col(key).alias("donor"), F.col(context).alias("__c"), F.col(action).alias("__a"), F.col(confidence).alias("__w"))
    pairs = df.join(right, list(by)).where(F.col(key) != F.col("donor"))
    pairs = pairs.withColumn("__ad", _distance(action, "__a")).withColumn("__s", F.round(F.col("__ad") - context_weight * _distance(context, "__c"), 9))
    best = pairs.groupBy(*by, key).agg(F.min_by(F.struct("donor", "__ad", F.least(F.col(confidence), F.col("__w")).alias("w")), F.struct(-F.col("__s"), F.col("donor"))).alias("__best"))
    scale = F.greatest(F.avg("__best.__ad").over(Window.partitionBy(by[0])), F.lit(1e-6))
    held = F.least(F.greatest(F.col("__best.__ad") / scale, F.lit(0.25)), F.lit(2.0))
    found = best.select(key, F.col("__best.donor").alias("donor"), (F.col("__best.w") * held).alias("weight"))
    return df.select(key).join(found, key, "left").select(key, F.coalesce("donor", key).alias("donor"), F.coalesce("weight", F.lit(0.0)).alias("weight"))


def other_code(code: Column, codes: int, draw: Column) -> Column:
    """A code that is not ``code``, by a draw of whole numbers."""
    return (code + 1 + draw % (codes - 1)) % codes if codes > 1 else code


def batch_donors(members: DataFrame, ranked: DataFrame, batch: str, key: str, top_k: int) -> DataFrame:
    """(batch, key, donor, weight): the best ranked donor that is in the anchor's own batch.

    ``ranked`` has key, donor, rank (from 1) and score. Weights are scores of at least 0 over
    the batch's mean positive one; without a donor it is null with weight 0.
    """
    wanted = ranked.where((F.col("rank") <= top_k) & (F.col("donor") != F.col(key))).select(key, "donor", "rank", "score")
    there = members.select(batch, F.col(key).alias("donor"))
    met = members.select(batch, key).join(wanted, key).join(there, [batch, "donor"])
    best = met.groupBy(batch, key).agg(F.min_by(F.struct("donor", "score"), "rank").alias("__best"))
    raw = F.greatest(F.coalesce("__best.score", F.lit(0.0)), F.lit(0.0))
    all_rows = members.select(batch, key).join(best, [batch, key], "left").select(batch, key, F.col("__best.donor").alias("donor"), raw.alias("__w"))
    mean = F.avg(F.when(F.col("__w") > 0, F.col("__w"))).over(Window.partitionBy(batch))
    return all_rows.select(batch, key, "donor", F.coalesce(F.col("__w") / F.greatest(mean, F.lit(1e-6)), F.lit(0.0)).alias("weight"))


def quality_index(rows: DataFrame, human: DataFrame, weights: DataFrame, key: str) -> DataFrame:
    """``rows`` with quality bucket and weight, a capability flag, references and provenance.

    ``human`` has key and bucket, ``weights`` key and weight; a negative weight raises.
    """
    h = human.select(key, F.trim("bucket").alias("quality_bucket"), F.lit(True).alias("__h"))
    checked = F.when(F.col("weight") < 0, F.raise_error(F.lit("negative sample weight")).cast("double")).otherwise(F.col("weight"))
    w = weights.select(key, checked.alias("quality_weight"), F.lit(True).alias("__w"))
    got = rows.join(h, key, "left").join(w, key, "left")
    refs = F.map_concat(
        F.when(F.col("__h"), F.create_map(F.lit("human_take_quality"), F.col("quality_bucket"))).otherwise(F.create_map().cast("map<string,string>")),
        F.when(F.col("__w"), F.create_map(F.lit("derived_sampling_weight"), F.col("quality_weight").cast("string"))).otherwise(F.create_map().cast("map<string,string>")),
    )
    return got.select(
        *rows.columns,
        F.coalesce("quality_bucket", F.lit("unlabeled")).alias("quality_bucket"),
        F.coalesce("quality_weight", F.lit(1.0)).alias("quality_weight"),
        F.coalesce("__h", F.lit(False)).alias("take_quality"),
        F.coalesce("__w", F.lit(False)).alias("derived_weight_valid"),
        refs.alias("annotation_refs"),
    )


def fill_empty(df: DataFrame, dimension: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Empty cells of ``columns`` are filled from the dimension; filled ones stay."""
    d = dimension.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    out = df.join(d, key, "left")
    return out.withColumns({c: F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.col(f"__{c}").cast("string")) for c in columns}).drop(*[f"__{c}" for c in columns])


def labelled_report(rows: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """One row: rows with a label, rows without, labels of no row."""
    a = rows.select(key).distinct().withColumn("__r", F.lit(1))
    b = labels.select(key).distinct().withColumn("__l", F.lit(1))
    both = a.join(b, key, "full")
    return both.agg(
        F.count_if(F.col("__r").isNotNull() & F.col("__l").isNotNull()).alias("matched"),
        F.count_if(F.col("__l").isNull()).alias("unlabelled_rows"),
        F.count_if(F.col("__r").isNull()).alias("labels_without_row"),
    )


def positions_of(allowed: DataFrame, dataset: DataFrame, key: str, place: str, position: str) -> DataFrame:
    """(place, key, position): where each key of the allow-list stands in the data set; null: nowhere."""
    return allowed.select(key, place).join(dataset.select(key, position), key, "left").select(place, key, position)


def substituted(df: DataFrame, donors: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``df`` with ``columns`` taken from each row's donor; rows without one keep their own."""
    other = df.select(F.col(key).alias("donor"), *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__d"))
    out = df.join(donors.select(key, "donor"), key, "left").join(other, "donor", "left")
    return out.withColumns({c: F.when(F.col("__d"), F.col(f"__{c}")).otherwise(F.col(c)) for c in columns}).select(*df.columns, "donor")


def source_lookup(wanted: DataFrame, sources: dict[str, DataFrame], key: str, group: str, time: str, tolerance: float = 1e-3) -> DataFrame:
    """(key, source, status) of each wanted row among several sources.

    A key must be in one source, once; then its group must be equal and its time near.
    """
    every = None
    for name, df in sources.items():
        part = df.select(key, F.col(group).alias("__g"), F.col(time).alias("__t"), F.lit(name).alias("source"))
        every = part if every is None else every.unionAll(part)
    per = every.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), F.min("source").alias("source"), F.min("__g").alias("__g"), F.min("__t").alias("__t"))
    status = (
        F.when(F.col("__n").isNull(), "missing").when(F.col("__n") > 1, "ambiguous").when(~F.col("__g").eqNullSafe(F.col(group)), "other_group")
        .when(~F.coalesce(F.abs(F.col("__t") - F.col(time)) <= tolerance, F.lit(False)), "other_time").otherwise("ok")
    )
    return wanted.join(per, key, "left").select(key, F.when(F.col("__n") == 1, F.col("source")).alias("source"), status.alias("status"))


def content_match(rows: DataFrame, candidates: DataFrame, key: str, content: str, place: str, hint: str) -> DataFrame:
    """(key, place, matches): the candidate with the row's very content, nearest to its hint.

    Contents are compared by sha256; of equal ones the nearest place wins, then the smaller.
    """
    a = rows.select(key, F.sha2(F.col(content).cast("binary"), 256).alias("__h"), hint)
    b = candidates.select(key, F.sha2(F.col(content).cast("binary"), 256).alias("__h"), place)
    met = a.join(b, [key, "__h"], "left")
    return met.groupBy(key).agg(F.min_by(place, F.struct(F.abs(F.col(place) - F.col(hint)), F.col(place))).alias(place), F.count(place).alias("matches"))


def deblinded(frozen: DataFrame, first: DataFrame, second: DataFrame, key: str, labels: Sequence[str]) -> DataFrame:
    """Frozen fields with both annotators' labels (``a_``, ``b_``); rows both have, names that differ.

    Annotators whose names are equal in lower case are one, and their rows leave.
    """
    side = lambda df, p: df.select(key, *[F.col(c).alias(f"{p}_{c}") for c in (*labels, "annotator_id")])
    out = frozen.join(side(first, "a"), key).join(side(second, "b"), key)
    return out.where(F.lower(F.trim("a_annotator_id")) != F.lower(F.trim("b_annotator_id")))


def raster_union(df: DataFrame, by: Sequence[str], bits: str) -> DataFrame:
    """(by..., bits): the union of bit rasters given as arrays of whole numbers (64 cells each)."""
    cells = df.select(*by, F.posexplode(bits).alias("__i", "__b")).groupBy(*by, "__i").agg(F.bit_or("__b").alias("__b"))
    packed = cells.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", "__b"))), lambda x: x["__b"]).alias(bits))
    return packed


def group_batches(df: DataFrame, group: str, key: str, batches: int, groups_per_batch: int, rows_per_group: int, seed: str) -> DataFrame:
    """(batch, place, group, key): groups drawn evenly with replacement, then rows inside them.

    Draws are hashes, so batches repeat in any engine.
    """
    from .select import dense_index

    groups = dense_index(df, group, "__g")
    n = groups.agg(F.count(F.lit(1))).scalar()
    word = lambda *parts: F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), *[p.cast("string") for p in parts]), 256), 1, 8), 16, 10).cast("bigint")
    slots = df.sparkSession.range(batches).select(F.col("id").alias("batch"), F.explode(F.sequence(F.lit(0), F.lit(groups_per_batch - 1))).alias("slot"))
    picked = slots.withColumn("__g", word(F.col("batch"), F.col("slot")) % n).join(groups, "__g")
    w = Window.partitionBy(group).orderBy(key)
    members = df.select(group, key, (F.row_number().over(w) - 1).alias("__i"), F.count(F.lit(1)).over(Window.partitionBy(group)).alias("__n"))
    sizes = members.groupBy(group).agg(F.max("__n").alias("__n"))
    seats = picked.join(sizes, group).withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(rows_per_group - 1))))
    seats = seats.withColumn("__i", word(F.col("batch"), F.col("slot"), F.col("row")) % F.col("__n"))
    place = F.col("slot") * rows_per_group + F.col("row")
    return seats.join(members.drop("__n"), [group, "__i"]).select("batch", place.alias("place"), group, key)


def pair_batches(anchors: DataFrame, ranked: DataFrame, key: str, per_batch: int, seed: str, top_k: int) -> DataFrame:
    """(batch, key, donor): anchors in hash order, ``per_batch`` a batch, each with one of its
    first ``top_k`` donors by a hash; an anchor without a donor is its own."""
    from .select import global_rank

    place = global_rank(anchors.select(key).withColumn("__h", hash_order(seed, key)), "__h", key, "__p")
    cand = ranked.where((F.col("rank") <= top_k) & (F.col("donor") != F.col(key)))
    drawn = cand.groupBy(key).agg(F.min_by("donor", F.struct(hash_order(seed, key, "donor"), F.col("donor"))).alias("donor"))
    got = place.join(drawn, key, "left")
    return got.select(F.floor((F.col("__p") - 1) / per_batch).alias("batch"), key, F.coalesce("donor", key).alias("donor"))


def kept_by_hash(probability: float, seed: str, *keys: str) -> Column:
    """1 where a hash-uniform draw is at least the probability, else 0: a dropout mask."""
    if not 0.0 <= probability <= 1.0:
        raise ValueError(f"a dropout probability lies within 0 and 1: {probability}")
    word = F.conv(F.substring(hash_order(seed, *keys), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
    return (word >= probability).cast("int")
