"""Token-id output: one shared zstandard dictionary, one frame per document.

A data set is a folder: ``dictionary.bin`` (trained once on serialised id arrays),
``shard-NNNNNN.bin`` and ``manifest.json``. A shard is::

    magic(8) dictionary sha256(32) frame ... frame index footer

Each frame is one document's ids (little-endian uint32), compressed on its own against the
dictionary, so a short document is read with one small ranged read. The index holds
``doc_id`` (int64), ``offset`` (uint64, n+1 values) and ``n_tokens`` (uint32); the footer
holds the number of documents, the index position, the number of documents whose doc_id is
null (they come first) and the magic again.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import filesystem, shared_dir, tokenizer_path

MAGIC = b"TSRTOK02"
FOOTER = struct.Struct("<QQQ8s")


def train_dictionary(samples: list[bytes], size: int = 65_536) -> bytes:
    """Dictionary bytes from serialised id arrays; with too few samples, their raw content."""
    import zstandard

    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:size] or bytes(8)


def _dictionary(raw: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(raw)


class ShardWriter:
    """Writes one shard; published under its name only when complete."""

    def __init__(self, folder: str, shard: int, dictionary: bytes, attempt: str, level: int = 3):
        import zstandard

        self.fs, root = filesystem(folder)
        self.path = f"{root}/shard-{shard:06d}.bin"
        self.part = f"{root}/.{shard:06d}-{attempt}"
        self.out = self.fs.open_output_stream(self.part)
        self.codec = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(dictionary), write_content_size=True)
        self.out.write(MAGIC + hashlib.sha256(dictionary).digest())
        self.nulls = 0
        self.ids: list[int] = []
        self.offsets: list[int] = [40]
        self.counts: list[int] = []
        self.at = 40

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        frame = self.codec.compress(ids.astype("<u4", copy=False).tobytes())
        self.out.write(frame)
        self.at += len(frame)
        self.ids.append(-(2**63) if doc_id is None else doc_id)
        self.nulls += doc_id is None
        self.offsets.append(self.at)
        self.counts.append(len(ids))

    def close(self) -> int:
        self.out.write(np.array(self.ids, "<i8").tobytes() + np.array(self.offsets, "<u8").tobytes() + np.array(self.counts, "<u4").tobytes())
        self.out.write(FOOTER.pack(len(self.ids), self.at, self.nulls, MAGIC))
        self.out.close()
        self.fs.move(self.part, self.path)
        return self.at


class ShardReader:
    """Random access to the documents of one shard."""

    def __init__(self, path: str, dictionary: bytes):
        import zstandard

        fs, where = filesystem(path)
        self.file = fs.open_input_file(where)
        size = self.file.size()
        head = self.file.read_at(40, 0)
        n, at, self.nulls, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if head[:8] != MAGIC or magic != MAGIC:
            raise ValueError(f"not a token shard: {path}")
        if head[8:] != hashlib.sha256(dictionary).digest():
            raise ValueError(f"dictionary of {path} is another one")
        index = self.file.read_at(size - FOOTER.size - at, at)
        self.doc_ids = np.frombuffer(index, "<i8", n)
        self.offsets = np.frombuffer(index, "<u8", n + 1, 8 * n)
        self.counts = np.frombuffer(index, "<u4", n, 16 * n + 8)
        self.codec = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def __len__(self) -> int:
        return len(self.doc_ids)

    def ids(self, i: int) -> np.ndarray:
        """Ids of the i-th document of the shard."""
        a, b = int(self.offsets[i]), int(self.offsets[i + 1])
        raw = self.codec.decompress(self.file.read_at(b - a, a), max_output_size=4 * int(self.counts[i]) + 1)
        return np.frombuffer(raw, "<u4")

    def find(self, doc_id: int) -> np.ndarray | None:
        """Ids of a document by its id (ids ascend in a shard), or None."""
        i = self.nulls + int(np.searchsorted(self.doc_ids[self.nulls :], doc_id))
        return self.ids(i) if i < len(self) and self.doc_ids[i] == doc_id else None


def write_tokens(
    docs: DataFrame, folder: str | None = None, path: str | None = None, end_id: int = 2, sample_docs: int = 1_000, sample_bytes: int = 8 << 20, dictionary_bytes: int = 65_536
) -> str:
    """Encode ``docs`` (doc_id, text) into shards in ascending doc_id order; returns the folder.

    Null texts count as empty (one end id). Rows that repeat a doc_id are all written, ordered
    by text. Rows with a null doc_id come first and keep it. Other columns are ignored. The
    dictionary is trained on at most ``sample_docs`` documents and ``sample_bytes`` of text, first
    by a hash of their id; it affects sizes only. An empty table gives a data set without shards.
    """
    from .wordbpe import encoder

    spark = docs.sparkSession
    path = path or tokenizer_path()
    folder = folder or shared_dir(spark, "tokens")
    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.octet_length("text").alias("bytes"))
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("text_key")]
    upto = F.sum("bytes").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    first = keyed.where(F.col("bytes") <= sample_bytes // 16).orderBy(*order).limit(sample_docs).withColumn("upto", upto)
    picked = first.where(F.col("upto") <= sample_bytes).select("doc_id", "text_key").distinct()
    chosen = docs.withColumn("text_key", F.xxhash64("text")).join(F.broadcast(picked), ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"])
    sample = chosen.orderBy("doc_id", "text").select("text").toPandas()["text"]
    dictionary = train_dictionary([encoder(path).encode(t).tobytes() for t in sample], dictionary_bytes)
    with fs.open_output_stream(f"{root}/dictionary.bin") as f:
        f.write(dictionary)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        out, enc, total, low = None, encoder(path), 0, None
        end = np.array([end_id], "<u4")
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if out is None:
                    out, low = ShardWriter(folder, task.partitionId(), dictionary, str(task.taskAttemptId())), doc_id
                ids = np.concatenate([enc.encode(text.as_py()), end])
                total += len(ids)
                out.add(doc_id, ids)
        if out is not None:
            size = out.close()
            yield pa.RecordBatch.from_pydict({"shard": [task.partitionId()], "low": [low], "n_docs": [len(out.ids)], "n_tokens": [total], "bytes": [size]})

    shards = (
        docs.repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(write, "shard long, low long, n_docs long, n_tokens long, bytes long")
        .toPandas()
        .sort_values("shard")
    )
    base = 0
    entries = []
    for row in shards.itertuples():
        entries.append({"shard": int(row.shard), "file": f"shard-{row.shard:06d}.bin", "start": base, "n_docs": int(row.n_docs), "n_tokens": int(row.n_tokens)})
        base += int(row.n_tokens)
    manifest = {"format": MAGIC.decode(), "dictionary_sha256": hashlib.sha256(dictionary).hexdigest(), "end_id": end_id, "n_tokens": base, "shards": entries}
    with fs.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return folder


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, frame_bytes[, ids]) of every stored document."""
    fs, root = filesystem(folder)
    with fs.open_input_stream(f"{root}/manifest.json") as f:
        entries = json.loads(f.read())["shards"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, frame_bytes long" + ", ids array<long>" * with_ids
    if not entries:
        return spark.createDataFrame([], schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = filesystem(folder)
        with store.open_input_stream(f"{top}/dictionary.bin") as f:
            dictionary = f.read()
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = ShardReader(f"{folder}/{name}", dictionary)
                starts = base + np.concatenate([[0], np.cumsum(shard.counts, dtype=np.int64)])[:-1]
                for a in range(0, len(shard), 2_000):
                    rows = range(a, min(a + 2_000, len(shard)))
                    ids = [shard.ids(i) for i in rows]
                    out = {
                        "doc_id": pa.array(shard.doc_ids[a : a + len(rows)], mask=np.asarray(rows) < shard.nulls),
                        "start": starts[a : a + len(rows)],
                        "n_tokens": np.array([len(x) for x in ids], np.int64),
                        "ids_crc32": np.array([zlib.crc32(x.tobytes()) for x in ids], np.int64),
                        "frame_bytes": np.diff(shard.offsets[a : a + len(rows) + 1].astype(np.int64)),
                    }
                    if with_ids:
                        out["ids"] = pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_pydict(out)

    files = spark.createDataFrame([(e["file"], e["start"], e["shard"]) for e in entries], "file string, start long, shard long")
    return files.repartitionByRange(len(entries), "shard").select("file", "start").mapInArrow(read, schema)
