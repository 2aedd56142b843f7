"""Exact top-k inner products by block-at-a-time pruning.

Vectors are the "documents", their components the "terms". Every shard orders its vectors by
nearest pivot and cuts them into ranges (blocks); a block keeps its forward index (the rows)
and, per term, the largest and smallest weight. For a query, a block's bound is the sum of
its term maxima weighted by the query. A query's best block is scored first; the others follow
in one order for a batch of queries, each for the queries whose k-th score so far its bound
reaches. The k-th score over a bounded pivot set seeds that threshold, so shards prune before
they have seen k rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quantized(column: str, scale: float = 1_024.0) -> Column:
    """floor(scale * x) of every component; null if one is null or not finite."""
    x = F.col(column)
    fine = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    return F.when(fine, F.transform(x, lambda v: F.floor(v.cast("double") * F.lit(scale)).cast("bigint")))


def _norm(rows: np.ndarray) -> float:
    """The largest length of a row."""
    return max((float(np.sqrt(np.square(rows[a : a + 4_096].astype(np.float64)).sum(1).max())) for a in range(0, len(rows), 4_096)), default=0.0)


class BlockIndex:
    """Forward index of one shard in pivot-ordered ranges, with term extrema per range."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, pivots: np.ndarray, block_rows: int):
        weights = rows.astype(np.float32)  # an order only
        near = np.argmax(weights @ pivots.T.astype(np.float32) - 0.5 * (pivots * pivots).sum(1, dtype=np.float64), 1) if len(pivots) else np.zeros(len(ids), np.int64)
        order = np.lexsort((ids, near))
        self.ids, self.rows = ids[order], rows[order]
        cuts = np.arange(0, len(ids), block_rows)
        self.cuts = np.append(cuts, len(ids))
        self.high = np.maximum.reduceat(self.rows, cuts, 0).astype(np.float64)
        self.low = np.minimum.reduceat(self.rows, cuts, 0).astype(np.float64)
        self.first = np.minimum.reduceat(self.ids, cuts)
        self.norm, self.most, self.cast = _norm(self.rows), max(np.abs(self.high).max(), np.abs(self.low).max()), {}
        self.scored = 0  # blocks whose rows were scored, over all searches

    def _exact(self, queries: np.ndarray) -> type:
        """The narrowest type in which no partial sum of a product is rounded (int64 beyond 2^50)."""
        if self.most * np.abs(queries.astype(np.float64)).max(initial=0) * queries.shape[1] >= 1 << 50:
            return np.int64
        return np.float32 if self.norm * _norm(queries) < 1 << 23 else np.float64

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, seeds: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query id, scores, ids) of each query's k best rows here, or fewer where the seed rules them out."""
        n, kind = len(query_ids), self._exact(queries)
        if kind not in self.cast:
            self.cast = {kind: self.rows.astype(kind)}
        rows, asked = self.cast[kind], queries.astype(kind)
        if kind is np.int64:  # sums beyond what bounds can hold: every block is scored
            bounds, floor = np.full((n, len(self.first)), np.inf), np.full(n, np.iinfo(np.int64).min)
        else:
            wide = queries.astype(np.float64)
            bounds, floor = np.maximum(wide, 0) @ self.high.T + np.minimum(wide, 0) @ self.low.T, np.array(seeds, np.float64)
        last = np.full(n, np.iinfo(np.int64).max)  # a row at the floor counts if its id is smaller
        best = (np.zeros(0, np.int64), np.zeros(0, floor.dtype), np.zeros(0, np.int64))
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        waiting = 0

        def score(b: int, of: np.ndarray) -> None:
            nonlocal waiting
            self.scored += len(of)
            a, z = self.cuts[b], self.cuts[b + 1]
            scores = rows[a:z] @ asked[of].T
            fit = np.flatnonzero(scores >= floor[of].astype(kind))
            at, q = np.divmod(fit, len(of) or 1)
            values, q, ids = scores.ravel()[fit].astype(floor.dtype), of[q], self.ids[a:z][at]
            keep = (ids != query_ids[q]) & ((values > floor[q]) | (values == floor[q]) & (ids < last[q]))
            held.append((q[keep], values[keep], ids[keep]))
            waiting += int(keep.sum())

        def settle() -> None:
            """Keeps the k best of what was found, and raises the floors of queries that have k."""
            nonlocal best, waiting
            q, values, ids = (np.concatenate(x) for x in zip(best, *held))
            order = np.lexsort((ids, -values, q))
            q, values, ids = q[order], values[order], ids[order]
            start = np.searchsorted(q, np.arange(n + 1))
            keep = np.arange(len(q)) - start[q] < k
            full = np.flatnonzero(np.diff(start) >= k)
            kth = start[full] + k - 1
            floor[full], last[full] = values[kth], ids[kth]
            best, waiting = (q[keep], values[keep], ids[keep]), 0
            held.clear()

        blocks = len(self.first)
        top = np.argmax(bounds, 1) if n and blocks else np.zeros(0, np.int64)
        for b in np.unique(top):
            score(b, np.flatnonzero((top == b) & (bounds[:, b] >= floor)))
        settle()
        for b in np.argsort(-bounds.sum(0), kind="stable"):
            bound = bounds[:, b]
            score(b, np.flatnonzero((top != b) & ((bound > floor) | (bound == floor) & (self.first[b] <= last))))
            if waiting > 4 * k * n:
                settle()
        settle()
        start = np.searchsorted(best[0], np.arange(n + 1))
        for q in range(n):
            yield int(query_ids[q]), best[1][start[q] : start[q + 1]], best[2][start[q] : start[q + 1]]


def _packed(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """(keys..., dim, ids, data): up to ``most`` rows of equal keys and length, in the narrowest whole numbers."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, ids = batch.column("q"), batch.column("vec_id").to_numpy()
            flat, ends = vectors.flatten().to_numpy(), np.cumsum(vectors.value_lengths().to_numpy())
            by = [batch.column(c).to_numpy() for c in (*keys, "dim")]
            order = np.lexsort(by[::-1])
            edge = np.flatnonzero(np.any([np.diff(x[order]) != 0 for x in by], 0)) + 1
            out = []
            for group in np.split(order, edge):
                dim = int(by[-1][group[0]]) if len(group) else 0
                for a in range(0, len(group), most):
                    part = group[a : a + most]
                    values = flat[(ends[part] - dim)[:, None] + np.arange(dim)]
                    top = max(int(values.max()), -int(values.min()))
                    kind = "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8"
                    out.append([*(int(x[part[0]]) for x in by), ids[part].astype("<i8").tobytes(), values.astype(kind).tobytes()])
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * len(types), types)], names=names)

    names, types = [*keys, "dim", "ids", "data"], [*[pa.int64()] * len(keys), pa.int32(), pa.binary(), pa.binary()]
    return rows.select(*keys, "dim", "vec_id", "q").mapInArrow(pack, "".join(f"{c} long, " for c in keys) + "dim int, ids binary, data binary")


def _unpack(pieces: list[tuple[bytes, bytes]], dim: int) -> tuple[np.ndarray, np.ndarray]:
    ids = [np.frombuffer(i, "<i8") for i, _ in pieces]
    return np.concatenate(ids), np.concatenate([np.frombuffer(d, f"<i{len(d) // (len(i) * dim)}").reshape(-1, dim) for i, (_, d) in zip(ids, pieces)])


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 10, shard_rows: int = 4_096, query_rows: int = 512, block_rows: int = 128, max_pivots: int = 64, most_shards: int = 64, most_rows: int = 65_536
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of ``vectors`` for each query row.

    ``vectors`` has vec_id and q (array<bigint>, null: takes no part). Ties go to the smaller
    vec_id; a query's own id is no candidate. Rows that repeat a vec_id are candidates each, and
    ask once, with the smallest vector. Vectors meet only vectors of their own length; a null vec_id takes no
    part; an empty table gives no rows; other columns are ignored. Shards have ``shard_rows``, or as many
    more (``most_rows`` at most) as keep them to ``most_shards``. Every query goes to every shard: a
    shard's task reads its rows, then queries ``query_rows`` at a time. Nothing is joined or broadcast.
    """

    def usable(df: DataFrame) -> DataFrame:
        return df.where("vec_id IS NOT NULL AND q IS NOT NULL AND size(q) > 0").select(
            F.col("vec_id").cast("long").alias("vec_id"), "q", F.size("q").alias("dim"), is_query.alias("is_query")
        )

    rows, total = usable(vectors), vectors.where("vec_id IS NOT NULL").count()  # without computing q
    n_shards = max(1, min(-(-total // shard_rows), max(most_shards, -(-total // most_rows))))
    near = usable(vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, total // (8 * max_pivots)))) == 0))
    pivots = near.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max_pivots).select("vec_id", "q", "dim").toPandas().drop_duplicates("vec_id")
    by_dim = {d: (g["vec_id"].to_numpy(np.int64), np.stack(g["q"].to_numpy()).astype(np.float64)) for d, g in pivots.groupby("dim")}

    held = _packed(rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", "q"), F.lit(n_shards))), ["shard"], most_rows).withColumn("asks", F.lit(False))
    asked = _packed(rows.where("is_query").groupBy("vec_id", "dim").agg(F.min("q").alias("q")), [], query_rows)
    asked = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_shards - 1).cast("long"))).alias("shard"), "dim", "ids", "data", F.lit(True).alias("asks"))
    dealt = held.unionByName(asked).repartitionById(n_shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "asks", "dim")

    def found(index: BlockIndex, q_ids: np.ndarray, q_rows: np.ndarray, dim: int) -> Iterator[pa.RecordBatch]:
        p_ids, p_rows = by_dim.get(dim, (np.zeros(0, np.int64), np.zeros((0, dim))))
        for a in range(0, len(q_ids), query_rows):
            ids, asking = q_ids[a : a + query_rows], q_rows[a : a + query_rows]
            seeds = np.full(len(ids), -np.inf)
            if len(p_ids) > k:
                scores = np.where(ids[:, None] == p_ids[None, :], -np.inf, asking.astype(np.float64) @ p_rows.T)
                seeds = np.sort(scores, 1)[:, -k]
            got = list(index.search(ids, asking, k, seeds))
            columns = np.repeat(ids, [len(x[1]) for x in got]), np.concatenate([x[2] for x in got]), np.concatenate([x[1] for x in got])
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in columns], names=["query_id", "vec_id", "score"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, pieces, indexes, asking, waiting = None, {}, {}, [], 0
        for batch in batches:
            for row in batch.to_pylist():
                if asking and (row["shard"] != shard or row["dim"] != asking_dim or waiting >= query_rows):
                    if asking_dim in indexes:
                        yield from found(indexes[asking_dim], *_unpack(asking, asking_dim), asking_dim)
                    asking, waiting = [], 0
                if row["shard"] != shard:
                    shard, pieces, indexes = row["shard"], {}, {}
                if not row["asks"]:
                    pieces.setdefault(row["dim"], []).append((row["ids"], row["data"]))
                    continue
                for dim in list(pieces):
                    indexes[dim] = BlockIndex(*_unpack(pieces.pop(dim), dim), by_dim.get(dim, (None, np.zeros((0, dim))))[1], block_rows)
                asking_dim = row["dim"]
                asking.append((row["ids"], row["data"]))
                waiting += len(row["ids"]) // 8
        if asking and asking_dim in indexes:
            yield from found(indexes[asking_dim], *_unpack(asking, asking_dim), asking_dim)

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    each = dealt.select("shard", "asks", "dim", "ids", "data").mapInArrow(search, "query_id long, vec_id long, score long")
    return each.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
