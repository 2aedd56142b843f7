"""N-gram Jaccard self-join through prefix trees, with connected classes of documents.

1. Every document becomes a set of shingle fingerprints. Blocks of documents send them to
   buckets as packed arrays; a bucket counts each shingle's documents and sends back only
   shingles that two or more documents share, with their frequency.
2. The global order is (frequency, fingerprint), rarest first. Sets that meet the threshold
   share a shingle among the first ``n - ceil(t n) + 1`` of either; shingles of one document
   only fill that prefix first, so few documents have anything left in it.
3. Documents with equal sets become one class; only its head goes on.
4. A block is a bounded number of ordered sets (most frequent first) in a trie. It is
   traversed once with the overlaps of all probes at hand: a path adds each shared prefix
   once, and a subtree is left when no probe can still reach its required overlap with the
   remaining length.
5. Sets that agree in a minimum of hashed shingles meet first, in blocks, under two hashes.
   This finds most links and labels what they connect.
6. Every prefix shingle whose sets then carry two or more labels is still open: those outside
   its most frequent label meet all of its sets, in blocks. Sets of one label are connected
   already, and linked sets share a prefix shingle, so no link between labels is lost, while
   pairs inside a group of near copies are never enumerated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import KeyTable, grouped, materialize, mix, rolling, runs_of, utf8, word_hashes
from .components import components

BITS = 48
_MASK = np.uint64((1 << BITS) - 1)


def shingles(text: str | None, k: int = 4) -> np.ndarray:
    """Distinct 64-bit shingle fingerprints of a whole text; fewer words than k: one shingle."""
    hashes, _, _ = word_hashes(utf8(text), lower=True)
    return np.unique(rolling(hashes, min(k, max(1, len(hashes)))))


def prefix_length(n: int, num: int, den: int) -> int:
    """Number of first shingles among which a partner at the threshold must share one."""
    return n - -(-num * n // den) + 1


# --------------------------------------------------------------------------- the trie


def trie_links(keys: list[np.ndarray], sizes: np.ndarray, num: int, den: int, indexed: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spanning links of the threshold graph over ordered sets (keys ascending, rarest first).

    ``indexed`` marks the sets stored in the trie; every set probes it. Pairs that are already
    connected are not tested, so the links are those of a spanning forest.
    """
    m = len(keys)
    store = np.arange(m) if indexed is None else np.flatnonzero(indexed)
    if m < 2 or not len(store):
        return []
    vocabulary, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    ends = np.cumsum([len(x) for x in keys])
    owner = np.repeat(np.arange(m), [len(x) for x in keys])
    order = np.argsort(inverse, kind="stable")
    posting, first = owner[order], np.searchsorted(inverse[order], np.arange(len(vocabulary) + 1))
    path = [(len(vocabulary) - 1 - inverse[e - len(k) : e][::-1]).astype(">u4") for k, e in zip(keys, ends)]
    leaves = sorted(store.tolist(), key=lambda i: path[i].tobytes())
    lcp = np.zeros(len(leaves) + 1, np.int64)
    for x in range(1, len(leaves)):
        a, b = path[leaves[x - 1]], path[leaves[x]]
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[:n] != b[:n])
        lcp[x] = differ[0] if len(differ) else n
    depth = np.array([len(path[i]) for i in leaves])
    size_of = sizes[leaves]
    root = np.arange(m)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def overlaps(segment: np.ndarray) -> np.ndarray:
        token = len(vocabulary) - 1 - segment.astype(np.int64)
        starts, counts = first[token], first[token + 1] - first[token]
        at = np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        return np.bincount(posting[at], minlength=m)

    links = []
    stack = [(0, len(leaves), 0, np.zeros(m, np.int64))]
    while stack:
        lo, hi, at, have = stack.pop()
        to = int(depth[lo]) if hi - lo == 1 else int(lcp[lo + 1 : hi].min())
        if to > at:
            have = have + overlaps(path[leaves[lo]][at:to])
        rest = int(depth[lo:hi].max()) - to
        least = int(size_of[lo:hi].min())
        # overlap o is enough for sizes a, b when den*o >= num*(a+b-o)
        able = (den + num) * (have + rest) >= num * (least + sizes)
        if not able.any():
            continue
        if hi - lo > 1:
            cuts = [lo, *(lo + 1 + np.flatnonzero(lcp[lo + 1 : hi] == to)).tolist(), hi]
            stack.extend((a, b, to, have) for a, b in zip(cuts, cuts[1:]))
            continue
        i = leaves[lo]
        for j in np.flatnonzero(able).tolist():
            if j != i and find(j) != find(i) and den * have[j] >= num * (sizes[i] + sizes[j] - have[j]):
                root[find(j)] = find(i)
                links.append((i, j))
    return links


# --------------------------------------------------------------------------- shared shingles


def shared_sets(docs: DataFrame, k: int, num: int, den: int, buckets: int, block_tokens: int = 1 << 20) -> DataFrame:
    """(rid, doc_id, text_key, n, copy_key, near1, near2, keys) per row of ``docs``.

    Keys are there only where the prefix reaches shared shingles, as packed uint64
    ``frequency << 48 | fingerprint`` in global order; near1 and near2 are then the least
    shared shingles under two hashes, and copy_key a digest of a set that is shared whole.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        ids: list[int] = []
        text_keys: list[int] = []
        ns: list[int] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            block = part << 24 | seq
            tokens = np.concatenate(held)
            place = np.repeat(np.arange(len(held), dtype="<u2"), [len(x) for x in held])
            order = np.argsort(tokens, kind="stable")
            tokens, place = tokens[order], place[order]
            bucket = (tokens * np.uint64(buckets) >> np.uint64(BITS)) if buckets < 1 << 16 else tokens % np.uint64(buckets)
            if buckets >= 1 << 16:
                order = np.argsort(bucket, kind="stable")
                tokens, place, bucket = tokens[order], place[order], bucket[order]
            cuts = np.flatnonzero(np.diff(bucket)) + 1 if len(bucket) else np.zeros(0, np.int64)
            rows = [(int(bucket[a]), tokens[a:b], place[a:b]) for a, b in zip(np.concatenate([[0], cuts]), np.append(cuts, len(bucket))) if b > a]
            base = [int(t[0]) for _, t, _ in rows]
            steps = [np.diff(t) for _, t, _ in rows]
            wide = [bool(len(s) and s.max() >= 1 << 32) for s in steps]
            packed = [s.astype("<u8" if w else "<u4").tobytes() for s, w in zip(steps, wide)]
            out = {
                "bucket": [r[0] for r in rows] + [block % buckets],
                "block": [block] * (len(rows) + 1),
                "base": base + [-1],
                "steps": packed + [np.array(ids + text_keys, "<i8").tobytes()],
                "places": [r[2].tobytes() for r in rows] + [np.array(ns, "<i8").tobytes()],
            }
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("base", pa.int64()), ("steps", pa.binary()), ("places", pa.binary())]))

        for batch in batches:
            for doc_id, text, text_key in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                full = shingles(text.as_py(), k)
                held.append(np.unique(full >> np.uint64(64 - BITS)))
                ids.append(doc_id)
                text_keys.append(text_key)
                ns.append(len(full))
                size += len(full)
                if size >= block_tokens or len(held) == 60_000:
                    yield from flush()
                    held, ids, text_keys, ns, size, seq = [], [], [], [], 0, seq + 1
        if held:
            yield from flush()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in runs_of(batches, "bucket"):
            meta = group[group["base"] < 0]
            if len(meta):
                yield pd.DataFrame({"block": meta["block"], "keys": meta["steps"], "places": meta["places"], "meta": True})
            group = group[group["base"] >= 0]
            if not len(group):
                continue
            parts = []
            for base, steps, places in zip(group["base"], group["steps"], group["places"]):
                n = len(places) // 2
                step = np.frombuffer(steps, "<u4" if len(steps) == 4 * (n - 1) else "<u8").astype(np.uint64)
                parts.append(np.concatenate([[np.uint64(base)], np.uint64(base) + np.cumsum(step, dtype=np.uint64)]))
            tokens = np.concatenate(parts)
            order = np.argsort(tokens, kind="stable")
            ranked = tokens[order]
            edge = np.flatnonzero(np.diff(ranked)) + 1
            starts = np.concatenate([[0], edge])
            counts = np.diff(np.append(starts, len(ranked)))
            frequency = np.empty(len(tokens), np.uint64)
            frequency[order] = np.repeat(counts, counts).astype(np.uint64)
            keys = np.minimum(frequency, np.uint64(65_535)) << np.uint64(BITS) | tokens
            out, at = [], 0
            for block, part, places in zip(group["block"], parts, group["places"]):
                keep = frequency[at : at + len(part)] >= 2
                if keep.any():
                    out.append((block, keys[at : at + len(part)][keep].tobytes(), np.frombuffer(places, "<u2")[keep].tobytes(), False))
                at += len(part)
            if out:
                yield pd.DataFrame(out, columns=["block", "keys", "places", "meta"])

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in runs_of(batches, "block"):
            meta = group[group["meta"]].iloc[0]
            (ids, text_keys), ns = np.frombuffer(meta["keys"], "<i8").reshape(2, -1), np.frombuffer(meta["places"], "<i8")
            rows = group[~group["meta"]]
            keys = np.frombuffer(b"".join(rows["keys"]), "<u8")
            place = np.frombuffer(b"".join(rows["places"]), "<u2").astype(np.int64)
            order = np.lexsort((keys, place))
            keys, place = keys[order], place[order]
            cut = np.searchsorted(place, np.arange(len(ids) + 1))
            packed, copies, near = [], [], np.zeros((2, len(ids)), np.int64)
            hashed = [mix((keys & _MASK) + np.uint64(seed)) >> np.uint64(1) for seed in (1, 2)]
            for d, n in enumerate(ns.tolist()):
                own = keys[cut[d] : cut[d + 1]]
                live = bool(n) and prefix_length(n, num, den) > n - len(own)
                packed.append(own.tobytes() if live else None)
                copies.append(hashlib.md5(np.sort(own & _MASK).tobytes()).hexdigest() if live and len(own) == n else None)
                if live:
                    near[:, d] = [h[cut[d] : cut[d + 1]].min() for h in hashed]
            block = int(group["block"].iloc[0])
            yield pd.DataFrame({"rid": (block << 16) + np.arange(len(ids)), "doc_id": ids, "text_key": text_keys, "n": ns, "copy_key": copies, "near1": near[0], "near2": near[1], "keys": packed})

    sent = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key")).where("doc_id IS NOT NULL").mapInArrow(
        spread, "bucket long, block long, base long, steps binary, places binary"
    )
    counted = grouped(sent, "bucket").mapInPandas(count, "block long, keys binary, places binary, meta boolean")
    return grouped(counted, "block").mapInPandas(gather, "rid long, doc_id long, text_key long, n long, copy_key string, near1 long, near2 long, keys binary")


# --------------------------------------------------------------------------- the join


def _join_blocks(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Edges (a, b) of blocks: rows (block string, rid, n, keys, indexed)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in runs_of(batches, "block"):
            group = group.sort_values(["rid", "indexed"]).drop_duplicates("rid", keep="last")
            rid = group["rid"].to_numpy()
            found = trie_links([np.frombuffer(x, "<u8") for x in group["keys"]], group["n"].to_numpy(), num, den, group["indexed"].to_numpy(bool))
            if found:
                a, b = np.array(found).T
                yield pd.DataFrame({"a": rid[a], "b": rid[b]})

    return grouped(rows.select("block", "rid", "n", "keys", "indexed"), "block").mapInPandas(run, "a long, b long")


def prefix_postings(live: DataFrame, num: int, den: int) -> DataFrame:
    """(rid, token) of the shared shingles in the prefix of every set that has any."""

    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rids, tokens = [], []
            for rid, n, packed in zip(pdf["rid"], pdf["n"], pdf["keys"]):
                own = np.frombuffer(packed, "<u8")
                own = own[: prefix_length(n, num, den) - (n - len(own))]
                rids.append(np.full(len(own), rid))
                tokens.append(own.view(np.int64))
            if rids:
                yield pd.DataFrame({"rid": np.concatenate(rids), "token": np.concatenate(tokens)})

    return live.select("rid", "n", "keys").mapInPandas(prefixes, "rid long, token long")


def jaccard_components(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100, block_rows: int = 64, buckets: int | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row with a doc_id; link: den*|I| >= num*|U|.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered. A text with fewer than k words is one
    shingle; null texts and texts without words are empty and link with nothing. component_id
    is the smallest doc_id reachable. Repeated rows are documents of their own with equal
    ids; other columns are ignored; an empty table gives no rows. Sets are held as 48-bit
    fingerprints: a false match inside a pair of 500-shingle sets has a chance below 1e-9.
    """
    ids = row_labels(docs, k, num, den, block_rows, buckets)
    least = KeyTable.of(ids.where("label IS NOT NULL"), ["label"], "least-ids", F.min("doc_id").alias("least"))
    return (
        least.join(ids)
        .select("doc_id", "n_shingles", F.col("least").alias("component_id"))
        .unionAll(ids.where("label IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    )


def row_labels(docs: DataFrame, k: int, num: int, den: int, block_rows: int = 64, buckets: int | None = None) -> DataFrame:
    """(rid, doc_id, text_key, n_shingles, label) of every row with a doc_id.

    Rows of one component share a label; it is null for a row that is linked with no other.
    text_key is xxhash64 of the text.
    """
    spark = docs.sparkSession
    if buckets is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), size // 4_000_000, 1)
    sets = materialize(shared_sets(docs, k, num, den, buckets), "shingle-sets")

    live = sets.where("keys IS NOT NULL")

    whole = live.where("copy_key IS NOT NULL").select("rid", "n", "copy_key")
    classes = KeyTable.of(whole, ["n", "copy_key"], "copy-classes", F.min("rid").alias("head"), having="key_rows > 1")
    copies = materialize(classes.join(whole).where("rid <> head").select(F.col("rid").alias("a"), F.col("head").alias("b")), "copies")
    is_copy = copies.select(F.col("a").alias("rid"))

    postings = materialize(prefix_postings(live, num, den).join(is_copy, "rid", "left_anti"), "postings")

    near = F.explode(F.array(*[F.struct(F.lit(i).alias("hash"), F.col(f"near{i}").alias("least")) for i in (1, 2)])).alias("x")
    meets = live.select("rid", near).select("rid", "x.*").join(is_copy, "rid", "left_anti")
    meeting = KeyTable.of(meets, ["hash", "least"], "near-keys", having="key_rows > 1").join(meets)
    part = F.pmod(F.xxhash64("rid", "hash"), F.ceil(F.col("key_rows") / block_rows))
    seats = meeting.select("rid", F.concat_ws(":", "hash", "least", part).alias("block"), F.lit(True).alias("indexed"))
    links = materialize(_join_blocks(live.select("rid", "n", "keys").join(seats, "rid"), num, den), "links")

    final = materialize(components(links.unionAll(copies)).select(F.col("node").alias("rid"), "label"), "classes")
    across = _open_links(postings, final, live, num, den, block_rows)
    if across is not None:
        known = final.where("rid <> label").select(F.col("rid").alias("a"), F.col("label").alias("b"))
        final = materialize(components(known.unionAll(across)).select(F.col("node").alias("rid"), "label"), "classes")

    return sets.select("rid", "doc_id", "text_key", F.col("n").alias("n_shingles")).join(final, "rid", "left")


def _open_links(postings: DataFrame, labels: DataFrame, live: DataFrame, num: int, den: int, block_rows: int) -> DataFrame | None:
    """Links between sets of different labels, or None where no prefix shingle has two labels.

    Open shingles are gathered by a leader, the set that comes first by a hash among those of
    the shingle; shingles of the same sets so meet once. The sets of a leader that are outside
    its most frequent label probe all of its sets, block by block.
    """
    placed = postings.join(labels, "rid", "left").select("rid", "token", F.coalesce("label", "rid").alias("label"))
    leader = F.min(F.struct(F.xxhash64("rid").alias("hash"), "rid"))
    per = placed.groupBy("token", "label").agg(F.count(F.lit(1)).alias("c"), leader.alias("first"))
    several = per.groupBy("token").agg(F.sum("c").alias("members"), F.count(F.lit(1)).alias("labels"), F.min("first").alias("first"))
    tokens = KeyTable(several.where("labels > 1").select("token", "members", F.col("first.rid").alias("leader")), ["token"], "members", "open-shingles")
    if not tokens.n_keys:
        return None
    met = materialize(tokens.join(placed).select("leader", "rid", "label").distinct(), "open-sets")
    per = met.groupBy("leader", "label").agg(F.count(F.lit(1)).alias("c"))
    main = per.groupBy("leader").agg(F.sum("c").alias("members"), F.max(F.struct("c", "label")).alias("main"))
    main = main.select("leader", "members", F.col("main.label").alias("main"), (F.col("members") - F.col("main.c")).alias("outside"))
    met = KeyTable(main, ["leader"], "members", "open-leaders").join(met).withColumns({"blocks": F.ceil(F.col("members") / block_rows), "chunks": F.ceil(F.col("outside") / block_rows)})
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    stored = met.withColumn("first", F.pmod(F.xxhash64("rid", F.lit(3)), "blocks")).withColumn("chunk", every("chunks")).withColumn("indexed", F.lit(True))
    probes = met.where("label <> main").withColumn("chunk", F.pmod(F.xxhash64("rid", F.lit(4)), "chunks")).withColumn("first", every("blocks")).withColumn("indexed", F.lit(False))
    seats = stored.unionByName(probes).select("rid", F.concat_ws(":", "leader", "first", "chunk").alias("block"), "indexed")
    return materialize(_join_blocks(live.select("rid", "n", "keys").join(seats, "rid"), num, den), "open-links")


def keep_first_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, **options) -> DataFrame:
    """``docs`` with one row per component: the row of the smallest doc_id (ties: by text hash).

    Components are of rows: texts that are not linked are both kept, also under one doc_id;
    rows equal in doc_id and text are one. All columns are kept; rows with a null doc_id stay.
    The texts are shuffled once at most, for the join that takes rows out.
    """
    ids = row_labels(docs.select("doc_id", "text"), k, num, den, **options).select("doc_id", "text_key", "label")
    ids = materialize(ids, "row-labels")
    linked = ids.where("label IS NOT NULL")
    first = KeyTable.of(linked, ["label"], "first-rows", F.min(F.struct("doc_id", "text_key")).alias("first"))
    per_row = first.join(linked).select("doc_id", "text_key", (F.struct("doc_id", "text_key") != F.col("first")).alias("later"))
    per_row = per_row.unionAll(ids.where("label IS NULL").select("doc_id", "text_key", F.lit(False).alias("later")))
    odd = per_row.groupBy(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).agg(F.max("later").alias("__later"), F.count(F.lit(1)).alias("__rows"))
    odd = materialize(odd.where("__later OR __rows > 1"), "odd-rows")
    # the plan is the same at every size: texts are dealt once, for the join and the window alike
    dealt = docs.withColumns({"__id": F.col("doc_id"), "__key": F.xxhash64("text")}).join(odd.hint("merge"), ["__id", "__key"], "left")
    nth = F.row_number().over(Window.partitionBy("__id", "__key").orderBy("__id"))
    kept = dealt.withColumn("__nth", nth).where("__later IS NULL OR (NOT __later AND __nth = 1)")
    return kept.select(*[f"`{c}`" for c in docs.columns])
