"""Connected components of an edge table, with alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import materialize

#: An edge table of at most so many rows is finished in one task (16 bytes a row).
TASK_EDGES = 1 << 20


def least_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) of the edges a - b, by hooking and pointer jumping."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[u], root[v]
        if (x == y).all():
            return nodes, nodes[root]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def _contract(edges: DataFrame, with_roots: bool = False) -> DataFrame:
    """Edges (node, least node) of the components inside each partition; the roots too if asked."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts: list[np.ndarray] = []
        held = 0

        def shrink() -> np.ndarray:
            joined = np.concatenate(parts, 1)
            node, label = least_labels(joined[0], joined[1])
            return np.stack([node, label])

        for pdf in batches:
            parts.append(pdf[["a", "b"]].to_numpy(np.int64).T)
            held += len(pdf)
            if held > TASK_EDGES:
                parts = [shrink()]
                held = parts[0].shape[1] // 2  # what cannot shrink is not tried again at once
        if parts:
            node, label = shrink()
            if not with_roots:
                node, label = node[node != label], label[node != label]
            for x in range(0, len(node), 1 << 18):
                yield pd.DataFrame({"a": node[x : x + (1 << 18)], "b": label[x : x + (1 << 18)]})

    return edges.mapInPandas(run, "a long, b long")


def _counted(edges: DataFrame) -> tuple[DataFrame, int, object]:
    """The edges in the shared folder, their number and an order-free digest of them."""
    seen = Observation()
    now = materialize(edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("digest")), "edges")
    return now, seen.get["n"] or 0, seen.get["digest"]


def components(edges: DataFrame, max_rounds: int = 60, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, label) for every node of ``edges`` (a long, b long); label: least node.

    Each partition first contracts its own edges to stars. Large-star and small-star steps
    then alternate until the edges no longer change, or until at most ``task_edges`` are left,
    which one task of bounded memory finishes. A step is a minimum per node (combined before
    the shuffle) and a join with it, so a hub is never gathered in one task. Rounds are cut by
    tables in the shared folder; the result does not depend on ``task_edges``. Edges of a node
    with itself are ignored.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now, n, state = _counted(_contract(now))
    if n <= task_edges:
        return _contract(now.repartition(1), with_roots=True).toDF("node", "label")
    for _ in range(max_rounds):
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        pairs = large.join(least, "a")
        small = pairs.select(F.greatest("b", "m").alias("a"), F.col("m").alias("b")).unionAll(pairs.select("a", F.col("m").alias("b")))
        before = state
        now, _, state = _counted(small.where("a <> b").distinct())
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.toDF("node", "label").unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
