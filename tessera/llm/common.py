"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

DEFAULT_WORD_BPE = "word_bpe_49k.json"


def tokenizer_path(name: str = DEFAULT_WORD_BPE) -> str:
    """Place of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared folder the session names.

    The folder of ``spark.checkpoint.dir`` is used. Where that is unset, a session on a single
    machine (local master, tests) gets a temporary one; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    This cuts the lineage: after it, losing an executor costs only re-reading files.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class KeyTable:
    """Aggregates per key that are joined back without gathering a frequent key in one task.

    The table keeps each key's number of rows, whose sum is known, so at most ``SLOTS`` keys
    can have more than a ``SLOTS``-th of all rows. Those are broadcast; the other keys, of
    bounded size, are joined by a shuffle. Rows whose key is null or not in the table leave.
    """

    SLOTS, LIGHT = 8_192, 64

    def __init__(self, table: DataFrame, keys: list[str], rows: str, name: str):
        seen = Observation()
        self.keys, self.rows = keys, rows
        watched = table.observe(seen, F.sum(rows).alias("total"), F.max(rows).alias("most"), F.count(F.lit(1)).alias("keys"))
        self.table = materialize(watched, name)
        self.total, self.most, self.n_keys = seen.get["total"] or 0, seen.get["most"] or 0, seen.get["keys"] or 0

    @classmethod
    def of(cls, df: DataFrame, keys: list[str], name: str, *aggs: Column, having: str = "true") -> KeyTable:
        """The table of ``df`` grouped by ``keys``, its rows counted in ``key_rows``."""
        return cls(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("key_rows"), *aggs).where(having), keys, "key_rows", name)

    def join(self, df: DataFrame) -> DataFrame:
        least = max(self.LIGHT, self.total // self.SLOTS)
        if self.most <= least:
            return df.join(self.table, self.keys)
        heavy, light = self.table.where(F.col(self.rows) > least), self.table.where(F.col(self.rows) <= least)
        rest = df.join(F.broadcast(heavy.select(self.keys)), self.keys, "left_anti")
        return df.join(F.broadcast(heavy), self.keys).unionByName(rest.join(light, self.keys))


def filesystem(uri: str):
    """(pyarrow filesystem, path) of a file or HDFS style URI."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), os.path.abspath(uri)
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


# --------------------------------------------------------------------------- words as numbers

_MULT = 0x9E3779B97F4A7C15
_INV = pow(_MULT, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


class _Tables:
    """Powers of the multiplier and of its inverse, grown on demand."""

    up = _powers(1 << 16, _MULT)
    down = _powers(1 << 16, _INV)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(cls.up):
            size = 1 << (n - 1).bit_length()
            up, down = _powers(size, _MULT), _powers(size, _INV)
            if size > 1 << 22:
                return up, down
            cls.up, cls.down = up, down
        return cls.up, cls.down


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` in UTF-8 bytes."""
    edge = np.empty(len(data) + 2, np.int8)
    edge[0] = edge[-1] = 0
    edge[1:-1] = ~_SPACE[data]
    step = np.diff(edge)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(raw: bytes, lower: bool = False, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash, start and end of every word of ``raw``; ``lower`` folds A-Z first."""
    data = np.frombuffer(raw, np.uint8)
    if lower:
        data = _LOWER[data]
    starts, ends = word_bounds(data)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends
    up, down = _Tables.get(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1 + seed)) * up[: len(data)], out=total[1:])
        value = (total[ends] - total[starts]) * down[starts]
        value += (ends - starts).astype(np.uint64) << np.uint64(48)
    return mix(value), starts, ends


def rolling(hashes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of every run of ``k`` consecutive word hashes."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = _MULT if not seed else 0xD6E8FEB86659FD93
    inverse = pow(base, -1, 1 << 64)
    with np.errstate(over="ignore"):
        if k <= 8:
            acc = np.zeros(n, np.uint64)
            for i in range(k):
                acc = acc * np.uint64(base) + hashes[i : i + n]
            return mix(acc)
        up, down = (_Tables.get(len(hashes) + 1)) if not seed else (_powers(len(hashes) + 1, base), _powers(len(hashes) + 1, inverse))
        total = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * up[: len(hashes)], out=total[1:])
        return mix((total[k:] - total[:-k])[:n] * down[:n])


def span_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the word hashes of every span ``[start, end)``; its length takes part."""
    up, down = _Tables.get(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(hashes * up[: len(hashes)], out=total[1:])
        value = (total[ends] - total[starts]) * down[starts]
        value += (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix(value)


def utf8(text: str | None) -> bytes:
    """UTF-8 of a text; null counts as empty, a lone surrogate is replaced."""
    return b"" if text is None else text.encode("utf-8", "replace")


# --------------------------------------------------------------------------- grouped streams


def grouped(df: DataFrame, key: str, partitions: int | None = None) -> DataFrame:
    """``df`` dealt by ``key`` with every key's rows together and in order."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, key).sortWithinPartitions(key)


def runs_of(batches, key: str):
    """Pandas frames of one key each, from batches whose keys are in order."""
    import pandas as pd

    held, now = [], None
    for pdf in batches:
        keys = pdf[key].to_numpy()
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        for a, b in zip(np.concatenate([[0], cuts]), np.append(cuts, len(keys))):
            if a == b:
                continue
            if held and keys[a] != now:
                yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True)
                held = []
            now = keys[a]
            held.append(pdf.iloc[a:b])
    if held:
        yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True)
