"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Candidates are found per document, hashed, and counted over the corpus by distinct
repositories (documents) and owners (sources). A value that few repositories and few owners
have and that looks random is owner-specific and live-looking: it gets an added ``owner`` span
on the value. A value that many repositories or many owners share is a widely copied example
and keeps its base span only.

Copies of one text say nothing about its values, so a text counts once, for the repository
that comes first. A text that holds nothing but its candidates is the copied value itself, and
each of its rows counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: kind, pattern, capture group of the value, least length of the value
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = [("assign", ASSIGN, 2, 6), ("access", r"AKIA[A-Z0-9]{16,}", 0, 20), ("hex", r"[0-9a-f]{24,}", 0, 24)]
OWNER_KIND = "owner"
ANY_KIND = "|".join(pattern for _, pattern, *_ in KINDS)
SPAN = "struct<start:int,ord:int,end:int,kind:string,value:string>"


def find_spans(text: Column, order: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """Leftmost non-overlapping matches of ``pattern`` as spans, in code points.

    A match starts where the text between matches and the matches before it end, so the
    pieces that ``split`` leaves and the matches give every position in one pass.
    """
    rx = F.lit(pattern)
    matches = F.regexp_extract_all(text, rx, 0)
    pairs = F.arrays_zip(
        F.slice(F.split(text, pattern, -1), 1, F.size(matches)).alias("gap"), matches.alias("hit"), F.regexp_extract_all(text, rx, group).alias("value")
    )
    empty = F.array().cast(f"array<{SPAN}>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        span = F.struct(start.alias("start"), F.lit(order).alias("ord"), end.alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.when(F.length(x["value"]) >= least, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    walked = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("out")), step)["out"]
    return F.when(text.rlike(pattern), walked).otherwise(empty)


def joined(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined in order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def looks_live(value: Column) -> Column:
    """A value of ten or more characters with a digit and at least eight different characters."""
    return (F.length(value) >= 10) & value.rlike("[0-9]") & (F.size(F.array_distinct(F.split(value, ""))) >= 8)


def scan_secrets(docs: DataFrame, owner: str = "source", repository: str = "doc_id", max_owners: int = 2, max_repositories: int = 10) -> DataFrame:
    """``docs`` rows with base (sorted base spans), live (owner-specific spans) and counts.

    Adds row_id, base, live, n_copied (base spans whose value more than ``max_owners`` owners
    or more than ``max_repositories`` repositories have in texts of their own). Null texts count as empty; a null owner or repository counts as one value of its
    own; repeated rows stay; an empty table gives none. Only ids and spans are shuffled; the
    text leaves after the scan. Returned columns: doc_id, row_id, text_key, base,
    live, n_copied.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    found = F.concat(*[find_spans(text, i, *k) for i, k in enumerate(KINDS)])
    scanned = docs.select(
        F.monotonically_increasing_id().alias("row_id"),
        F.col("doc_id"),
        F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"),
        F.coalesce(F.col(repository).cast("string"), F.lit("")).alias("repository"),
        F.xxhash64(text).alias("text_key"),
        F.sort_array(found).alias("base"),
        text.alias("text"),
    )
    bare = F.when(F.size("base") > 0, ~F.regexp_replace("text", ANY_KIND, "").rlike(r"[\p{L}\p{N}]")).otherwise(False)
    scanned = materialize(scanned.withColumn("bare", bare).drop("text"), "secret-spans")
    live = ownership(scanned, max_owners, max_repositories)
    empty = F.array().cast(f"array<{SPAN}>")
    return scanned.join(live, "row_id", "left").select(
        "doc_id", "row_id", "text_key", "base", F.coalesce("live", empty).alias("live"), F.coalesce("n_copied", F.lit(0)).alias("n_copied")
    )


def ownership(scanned: DataFrame, max_owners: int, max_repositories: int) -> DataFrame:
    """Owner-specific spans and the number of copied ones per row_id."""
    hits = scanned.where(F.size("base") > 0).select("row_id", "owner", "repository", "text_key", "bare", F.explode("base").alias("s"))
    hits = hits.withColumn("value_hash", F.sha2("s.value", 256))
    own_row = F.when(F.col("bare"), F.struct("repository", "owner")).alias("own_row")
    spread = (
        hits.groupBy("value_hash", "text_key", own_row)
        .agg(F.min(F.struct("repository", "owner")).alias("first"))
        .select("value_hash", "first.owner", "first.repository")
        .distinct()
        .groupBy("value_hash", "owner")
        .agg(F.count("*").alias("n"))
        .groupBy("value_hash")
        .agg(F.sum("n").alias("n_repositories"), F.count("*").alias("n_owners"))
    )
    judged = hits.join(spread, "value_hash").withColumn("copied", (F.col("n_owners") > max_owners) | (F.col("n_repositories") > max_repositories))
    span = F.struct(
        (F.col("s.end") - F.length("s.value")).alias("start"), F.lit(len(KINDS)).alias("ord"), F.col("s.end").alias("end"), F.lit(OWNER_KIND).alias("kind"), F.col("s.value").alias("value")
    )
    specific = F.when(~F.col("copied") & looks_live(F.col("s.value")), span)
    return judged.groupBy("row_id").agg(F.sort_array(F.collect_set(specific)).alias("live"), F.count_if("copied").alias("n_copied"))


def secret_digests(docs: DataFrame) -> DataFrame:
    """The digest columns of every document's spans."""
    def count_of(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count_of(kind) for kind, *_ in KINDS]
    return scan_secrets(docs).select(
        "doc_id",
        *counts,
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.sort_array(F.concat("base", "live"))).alias("spans"),
        F.size("live").cast("long").alias("n_owner_specific"),
        F.col("n_copied").cast("long").alias("n_copied"),
    )


def redact(docs: DataFrame, mask: str = "<secret>", **options) -> DataFrame:
    """``docs`` with owner-specific values replaced by ``mask``; all columns are kept."""
    found = scan_secrets(docs, **options).where(F.size("live") > 0)
    live = found.groupBy(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).agg(F.max("live").alias("__live"))

    def step(acc: Column, s: Column) -> Column:
        inside = s["start"] < acc["at"]
        kept = F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"), F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], kept, F.lit(mask))).alias("out")
        )

    walked = F.aggregate("__live", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    text = F.when(F.col("__live").isNull(), F.col("text")).otherwise(F.concat(walked["out"], F.substring(F.col("text"), walked["at"] + 1, 2**31 - 1)))
    same = docs["doc_id"].eqNullSafe(live["__id"]) & (F.xxhash64("text") == live["__key"])
    return docs.join(live, same, "left").withColumn("text", text).select(docs.columns)
