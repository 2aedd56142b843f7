"""Removal of repeated word windows with prefix-partitioned suffix trees.

A window is ``window`` consecutive words. Suffixes are indexed where repeats can start:

1. Each window has one anchor, the smallest 8-word hash inside it. Consecutive windows share
   anchors, so a document has few; the words of the windows of one anchor are a run. Documents
   with the same word sequence as an earlier one are set aside first: all their windows repeat.
2. Runs with the same words are one content, which knows its least document. Anchors that one
   document alone has are dropped; an anchor with a single content needs no tree.
3. The anchor is the prefix that partitions the suffixes. Prefixes of few contents are grouped
   into partitions of bounded size; a prefix of too many is lengthened, first to about half a
   window to either side of the anchor (each window holds one of the two), then to the window.
4. A group becomes a suffix tree in its array form: suffixes sorted by prefix doubling over
   exact words, with the longest common prefix of neighbours. Its internal nodes of window
   depth are the repeats, and each knows the least document below it.
5. What a content learns goes to its members, which are as many as the runs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KeyTable, grouped, materialize, mix, rolling, runs_of, span_hashes, utf8, word_hashes

PREFIX = 8
NONE = np.iinfo(np.int64).max


def anchors(hashes: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(prefix hash, position, first window, last window) of each anchor of a document.

    The anchor of a window is the leftmost of its smallest k-word hashes, so equal windows
    have equal anchors at equal places.
    """
    grams = rolling(hashes, k)
    n = len(hashes) - window + 1
    span = window - k + 1
    if n <= 0:
        empty = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), empty, empty, empty
    best = np.arange(len(grams))
    width = 1
    while width * 2 <= span:  # doubling minima, leftmost on ties
        left, right = best[: len(best) - width], best[width:]
        best = np.where(grams[right] < grams[left], right, left)
        width *= 2
    if width < span:
        left, right = best[:n], best[span - width : span - width + n]
        best = np.where(grams[right] < grams[left], right, left)
    best = best[:n]
    cut = np.flatnonzero(np.diff(best)) + 1
    first = np.concatenate([[0], cut])
    last = np.append(cut, n) - 1
    return grams[best[first]], best[first], first, last


def suffix_order(runs: list[np.ndarray], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(run, start, place, lcp) of the suffixes of at least ``window`` words, in sorted order.

    ``place`` is the suffix's place in the runs laid end to end. ``lcp`` is the length of the
    common prefix with the suffix before, counted up to ``window``. Ranks of words come from
    exact word numbers; ranks of 2w words from pairs of ranks of w words.
    """
    _, rank = np.unique(np.concatenate(runs), return_inverse=True)
    ranks, width = [rank.astype(np.int64)], 1
    while width * 2 <= window:
        low = ranks[-1]
        right = np.zeros(len(low), np.int64)
        right[: max(0, len(low) - width)] = low[width:] + 1
        ranks.append(np.unique(low * (int(low.max(initial=0)) + 2) + right, return_inverse=True)[1].astype(np.int64))
        width *= 2
    sizes = np.array([len(r) for r in runs])
    counts = np.maximum(sizes - window + 1, 0)
    run = np.repeat(np.arange(len(runs)), counts)
    start = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    place = (np.cumsum(sizes) - sizes)[run] + start
    order = np.lexsort((ranks[-1][place + window - width], ranks[-1][place]))
    run, start, place = run[order], start[order], place[order]
    lcp = np.zeros(len(place), np.int64)
    left, right = place[:-1], place[1:]
    for k in range(len(ranks) - 1, -1, -1):
        low, step = ranks[k], 1 << k
        fits = np.flatnonzero(lcp[1:] + step <= window)
        at = lcp[1:][fits]
        lcp[1 + fits[low[left[fits] + at] == low[right[fits] + at]]] += step
    return run, start, place, lcp


def deep_nodes(runs: list[np.ndarray], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, start, node) of the suffixes; suffixes below one node of depth ``window`` share its id."""
    run, start, _, lcp = suffix_order(runs, window)
    return run, start, np.cumsum(lcp < window) - 1


def covered(starts: np.ndarray, n_words: int, window: int) -> np.ndarray:
    """Mask of the words inside a window that starts at one of ``starts``."""
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + window, n_words), -1)
    return np.cumsum(edge[:-1]) > 0


def _least_below(runs: list[np.ndarray], docs: np.ndarray, window: int) -> list[np.ndarray]:
    """Per run, the least document that has the window at each start (``docs``: one per run)."""
    run, start, node = deep_nodes(runs, window)
    below = np.full(int(node.max(initial=-1)) + 1, NONE)
    np.minimum.at(below, node, docs[run])
    counts = np.array([max(0, len(r) - window + 1) for r in runs])
    flat = np.empty(len(run), np.int64)
    flat[(np.cumsum(counts) - counts)[run] + start] = below[node]
    return np.split(flat, np.cumsum(counts)[:-1])


_LEARNT = "prefix long, run long, offset int, leasts binary, least long"


def _cut(docs: DataFrame, contents: DataFrame, cutter, schema: str) -> DataFrame:
    """Rows that ``cutter(doc_id, words, hashes, mark)`` gives for the marks of each document.

    ``contents`` (doc_id, text_key, prefix, run, first, last, most) names the document that a
    content's words are taken from, so every content is read once.
    """
    marks = contents.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("prefix", "run", "first", "last", "most")).alias("marks"))
    names = [c.split()[0] for c in schema.split(", ")]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc_id, text, marks in zip(pdf["doc_id"], pdf["text"], pdf["marks"]):
                raw = utf8(text)
                words, hashes = raw.split(), word_hashes(raw)[0]
                for m in marks:
                    rows.extend(cutter(doc_id, words, hashes, m))
            if rows:
                yield pd.DataFrame(rows, columns=names)

    once = docs.join(marks.hint("merge"), ["doc_id", "text_key"]).select("doc_id", "text", "marks")
    return once.mapInPandas(cut, schema)


def _trees(rows: DataFrame, window: int, buckets: int) -> DataFrame:
    """What the contents of each prefix group learn; rows (key, prefix, run, offset, doc_id, most, words)."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in runs_of(batches, "bucket"):
            numbers: dict[bytes, int] = {}
            runs = [np.array([numbers.setdefault(w, len(numbers)) for w in r.split()], np.int64) for r in group["words"]]
            leasts = _least_below(runs, group["doc_id"].to_numpy(), window)
            useful = [bool((x < m).any()) for x, m in zip(leasts, group["most"])]
            if any(useful):
                found = group.loc[useful, ["prefix", "run", "offset"]]
                yield found.assign(leasts=[x.astype("<i8").tobytes() for x, u in zip(leasts, useful) if u], least=None)

    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets))).drop("key")
    return grouped(dealt, "bucket").mapInPandas(build, _LEARNT)


def repeated_starts(docs: DataFrame, window: int = 50, max_runs: int = 256, group_runs: int = 6_000) -> tuple[DataFrame, DataFrame]:
    """(summary, affected) of ``docs`` (doc_id, text).

    summary: doc_id, text_key, n_words, word_sha, copy (an earlier document has all its
    words). affected: doc_id, text_key, text, marks of documents that may have windows that
    also start in a document with a smaller doc_id. A prefix of more than ``max_runs``
    contents is lengthened; groups of smaller ones hold about ``group_runs``.
    """
    spark = docs.sparkSession
    docs = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("text_key"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["prefix", "run", "first", "last"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                n_words, shas, sizes, found = [], [], [], [[], [], [], []]
                for text in part.column(1):
                    raw = utf8(text.as_py())
                    hashes, _, _ = word_hashes(raw)
                    n_words.append(len(hashes))
                    shas.append(hashlib.sha256(b" ".join(raw.split())).hexdigest())
                    prefix, _, first, last = anchors(hashes, window, PREFIX)
                    sizes.append(len(prefix))
                    if len(prefix):
                        for held, x in zip(found, (prefix.view(np.int64), span_hashes(hashes, first, last + window).view(np.int64), first, last)):
                            held.append(x)
                flat = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), k) for x, k in zip(found, kinds)]
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(flat, names))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(n_words, pa.int64()), pa.array(shas), lists], names=["doc_id", "text_key", "n_words", "word_sha", "anchors"]
                )

    schema = "doc_id long, text_key long, n_words long, word_sha string, anchors array<struct<prefix:long,run:long,first:int,last:int>>"
    scanned = materialize(docs.select("doc_id", "text", "text_key").mapInArrow(scan, schema), "anchors")

    long = scanned.where(F.col("n_words") >= window).select("doc_id", "text_key", "word_sha")
    same = KeyTable.of(long, ["word_sha"], "word-classes", F.min("doc_id").alias("least"), F.max("doc_id").alias("greatest"), having="least < greatest")
    copies = same.join(long).where("doc_id > least").select("doc_id", "text_key").distinct()
    copies = materialize(copies.withColumn("copy", F.lit(True)), "copies")
    summary = scanned.select("doc_id", "text_key", "n_words", "word_sha").join(copies, ["doc_id", "text_key"], "left").withColumn("copy", F.coalesce("copy", F.lit(False)))

    places = scanned.select("doc_id", "text_key", F.inline("anchors"))
    shared = KeyTable.of(places, ["prefix"], "shared-prefixes", F.min("doc_id").alias("least"), F.max("doc_id").alias("greatest"), having="least < greatest")
    places = shared.join(places).select("doc_id", "text_key", "prefix", "run", "first", "last").join(copies, ["doc_id", "text_key"], "left_anti")
    places = materialize(places, "live-anchors")
    source = F.min(F.struct("doc_id", "text_key", "first", "last")).alias("source")
    contents = places.groupBy("prefix", "run").agg(source, F.max("doc_id").alias("most"), F.count(F.lit(1)).alias("members"))
    per_prefix = contents.groupBy("prefix").agg(F.min("source.doc_id").alias("least"), F.max("most").alias("greatest"), F.count(F.lit(1)).alias("runs"))
    prefixes = KeyTable(per_prefix.where("least < greatest").select("prefix", "runs"), ["prefix"], "runs", "prefixes")
    contents = materialize(prefixes.join(contents).select("prefix", "run", "source.*", "most", "members", "runs"), "contents")

    # the texts are dealt once for the documents that may have repeats; the plan is the same at every size
    owners = places.select("doc_id", "text_key").distinct()
    docs = materialize(docs.join(owners.hint("merge"), ["doc_id", "text_key"], "left_semi").dropDuplicates(["doc_id", "text_key"]), "affected", codec="zstd")

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(4 * parts, -(-prefixes.total // group_runs))

    def whole(doc_id: int, words: list[bytes], hashes: np.ndarray, m: dict) -> Iterator[tuple]:
        yield m["prefix"], m["prefix"], m["run"], 0, doc_id, m["most"], b" ".join(words[m["first"] : m["last"] + window])

    tree_schema = "key long, prefix long, run long, offset int, doc_id long, most long, words binary"
    few = _cut(docs, contents.where(f"runs BETWEEN 2 AND {max_runs}"), whole, tree_schema)
    learnt = _trees(few, window, buckets)
    if prefixes.most > max_runs:
        learnt = learnt.unionAll(_lengthened(docs, contents.where(f"runs > {max_runs}"), window, max_runs, buckets))
    alone = contents.where("runs = 1 AND doc_id < most").select("prefix", "run", F.lit(0).alias("offset"), F.lit(None).cast("binary").alias("leasts"), F.lit(None).cast("long").alias("least"))

    packed = learnt.unionAll(alone).groupBy("prefix", "run").agg(F.collect_list(F.struct("offset", "leasts", "least")).alias("learnt"))
    told = packed.join(contents.select("prefix", "run", F.col("doc_id").alias("least"), "members"), ["prefix", "run"])
    told = KeyTable(told, ["prefix", "run"], "members", "learnt")
    marks = told.join(places).groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("first", "last", "least", "learnt")).alias("marks"))
    return summary, docs.join(marks.hint("merge"), ["doc_id", "text_key"]).select("doc_id", "text_key", "text", "marks")


def _lengthened(docs: DataFrame, contents: DataFrame, window: int, max_runs: int, buckets: int) -> DataFrame:
    """What contents of a prefix that too many share learn, by longer prefixes.

    The windows of a run are parted: those that start less than half a window before the end
    of the prefix hold its right context, the others its left context. Either context is the
    longer prefix of its part. Where that is still too frequent, it is lengthened to whole
    windows, whose nodes are single: a minimum per node, combined before the shuffle.
    """

    def parted(doc_id: int, words: list[bytes], hashes: np.ndarray, m: dict) -> Iterator[tuple]:
        grams = rolling(hashes[m["first"] : m["last"] + window], PREFIX)
        at = m["first"] + int(np.flatnonzero(grams.view(np.int64) == m["prefix"])[0])
        half = (window - PREFIX) // 2
        left, right = (at - half, at + PREFIX), (at, at + window - half)
        for first, last, context in ((m["first"], min(m["last"], at - half - 1), left), (max(m["first"], at - half), m["last"], right)):
            if first <= last:
                key = span_hashes(hashes, np.array([context[0]]), np.array([context[1]])).view(np.int64)[0]
                yield int(key), m["prefix"], m["run"], first - m["first"], doc_id, m["most"], b" ".join(words[first : last + window])

    schema = "key long, prefix long, run long, offset int, doc_id long, most long, words binary"
    parts = materialize(_cut(docs, contents, parted, schema), "longer-prefixes")
    keys = KeyTable.of(parts.select("key", "doc_id", "most"), ["key"], "longer-keys", F.min("doc_id").alias("least"), F.max("most").alias("greatest"), having="least < greatest")
    live = keys.join(parts).select("key_rows", *parts.columns)
    learnt = _trees(live.where(f"key_rows <= {max_runs}").drop("key_rows"), window, buckets)
    if keys.most <= max_runs:
        return learnt

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), 1_000):
                out = []
                for prefix, run, offset, doc_id, most, words in pdf.iloc[a : a + 1_000][["prefix", "run", "offset", "doc_id", "most", "words"]].itertuples(index=False):
                    hashes, _, _ = word_hashes(words)
                    node = rolling(hashes, window).view(np.int64)
                    check = rolling(mix(hashes), window, seed=1).view(np.int64)
                    out.append(pd.DataFrame({"node": node, "check": check, "doc_id": doc_id, "most": most, "prefix": prefix, "run": run, "offset": np.int32(offset) + np.arange(len(node), dtype=np.int32)}))
                yield pd.concat(out)

    leaf = live.where(f"key_rows > {max_runs}").mapInPandas(windows, "node long, check long, doc_id long, most long, prefix long, run long, offset int")
    leaf = materialize(leaf, "whole-windows")
    nodes = KeyTable.of(leaf, ["node", "check"], "window-nodes", F.min("doc_id").alias("least"), F.max("most").alias("greatest"), having="least < greatest")
    found = nodes.join(leaf).where("least < most").select("prefix", "run", "offset", F.lit(None).cast("binary").alias("leasts"), "least")
    return learnt.unionAll(found)


def removed_words(docs: DataFrame, window: int = 50, **options) -> DataFrame:
    """(doc_id, text_key, n_words, n_removed, kept_sha256, kept) of every row with a doc_id.

    Removed is every word covered by a window whose word sequence also starts in a document
    with a smaller doc_id. ``kept`` is the kept words joined by one space, and null where
    nothing is removed. Null texts have no words; texts shorter than a window keep all;
    rows that repeat a doc_id never count as earlier than each other; other columns are
    ignored; an empty table gives no rows.
    """
    summary, marked = repeated_starts(docs, window, **options)

    def strip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc_id, key, text, marks in zip(pdf["doc_id"], pdf["text_key"], pdf["text"], pdf["marks"]):
                words, starts = utf8(text).split(), []
                for m in marks:
                    for part in m["learnt"]:
                        if part["leasts"] is not None:  # one least document per start
                            leasts = np.frombuffer(part["leasts"], "<i8")
                            starts.append(m["first"] + part["offset"] + np.flatnonzero(leasts < doc_id))
                        elif part["least"] is not None:  # of one start
                            starts.append(np.arange(1)[: part["least"] < doc_id] + m["first"] + part["offset"])
                        elif m["least"] < doc_id:  # the run is a single content
                            starts.append(np.arange(m["first"], m["last"] + 1))
                gone = covered(np.unique(np.concatenate(starts)) if starts else np.zeros(0, np.int64), len(words), window)
                if gone.any():
                    kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
                    rows.append((doc_id, key, int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")))
            if rows:
                yield pd.DataFrame(rows, columns=["doc_id", "text_key", "n_removed", "sha", "kept"])

    changed = marked.mapInPandas(strip, "doc_id long, text_key long, n_removed long, sha string, kept string")
    gone = F.col("copy")
    return summary.join(changed, ["doc_id", "text_key"], "left").select(
        "doc_id",
        "text_key",
        "n_words",
        F.when(gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("sha", "word_sha")).alias("kept_sha256"),
        F.when(gone, F.lit("")).otherwise(F.col("kept")).alias("kept"),
    )


def remove_repeats(docs: DataFrame, window: int = 50, **options) -> DataFrame:
    """``docs`` with repeated windows cut out of text; other texts and all columns unchanged."""
    found = removed_words(docs, window, **options).where("n_removed > 0").select(
        F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.col("kept").alias("__kept")
    ).distinct()
    same = (docs["doc_id"] == found["__id"]) & (F.coalesce(F.xxhash64(docs["text"]), F.lit(0)) == found["__key"])
    joined = docs.join(found.hint("merge"), same, "left")
    return joined.withColumn("text", F.when(F.col("__id").isNotNull(), F.col("__kept")).otherwise(F.col("text"))).select(docs.columns)
