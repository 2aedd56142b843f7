"""ISO base media containers: write losslessly, then read tables from nested boxes.

A payload becomes one video track of uncompressed 8-bit frames (24 x 24 samples, 576 bytes
each) in an ``ftyp``/``moov``/``mdat`` file. :func:`probe` walks the boxes, decodes the
sample tables and reports codec, timing and the byte range of every keyframe; it never
looks inside ``mdat``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import materialize, utf8

UNIT = 576
SIDE = 24
CODEC = b"raw "
TIMESCALE = 25
KEY_EVERY = 12
_NEST = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta"}
_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def padded(raw: bytes, unit: int = UNIT) -> bytes:
    """``raw`` with bytes 255 appended up to a positive multiple of ``unit``."""
    return raw + b"\xff" * (unit - len(raw) % unit if len(raw) % unit or not raw else 0)


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def mux(payload: bytes, unit: int = UNIT, timescale: int = TIMESCALE, key_every: int = KEY_EVERY) -> bytes:
    """An ISO media file whose samples are the ``unit``-byte frames of ``payload``."""
    n = len(payload) // unit
    keys = range(1, n + 1, key_every)
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    wide = len(payload) + 8 >= 1 << 32

    def moov(at: int) -> bytes:
        entry = _box(
            CODEC, bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", SIDE, SIDE, 72 << 16, 72 << 16, 0, 1), bytes(32), struct.pack(">Hh", 8, -1)
        )
        chunk = _full(b"co64", struct.pack(">IQ", 1, at)) if wide else _full(b"stco", struct.pack(">II", 1, at))
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, n, 1)),
            _full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            _full(b"stsc", struct.pack(">IIII", 1, 1, n, 1)),
            _full(b"stsz", struct.pack(">II", unit, n)),
            chunk,
        )
        dinf = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))
        minf = _box(b"minf", _full(b"vmhd", bytes(8), flags=1), dinf, stbl)
        mdia = _box(
            b"mdia",
            _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, timescale, n, 0x55C4, 0)),
            _full(b"hdlr", bytes(4), b"vide", bytes(12), b"frames\0"),
            minf,
        )
        tkhd = _full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n), bytes(16), _MATRIX, struct.pack(">II", SIDE << 16, SIDE << 16), flags=7)
        mvhd = _full(b"mvhd", struct.pack(">IIIIIH", 0, 0, timescale, n, 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    at = len(ftyp) + len(moov(0)) + (16 if wide else 8)
    return ftyp + moov(at) + _box(b"mdat", payload)


def boxes(data: bytes, start: int = 0, end: int | None = None, path: tuple = ()) -> Iterator[tuple[tuple, int, int]]:
    """(path, body start, body end) of every box, depth first; 32-bit, 64-bit and to-the-end sizes."""
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if body + 8 > end:
                raise ValueError("cut 64-bit box size")
            size, body = struct.unpack_from(">Q", data, body)[0], body + 8
        stop = end if size == 0 else start + size
        if stop > end or stop < body:
            raise ValueError(f"box {kind!r} at {start} leaves its parent")
        yield (*path, kind), body, stop
        if kind in _NEST:
            yield from boxes(data, body, stop, (*path, kind))
        start = stop


def _ints(data: bytes, at: int, n: int, width: int = 4) -> np.ndarray:
    return np.frombuffer(data, f">u{width}", n, at).astype(np.int64)


def _sample_table(data: bytes, found: dict[bytes, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
    """Offset and size of every sample, total ticks, and indexes of the sync samples."""
    at, _ = found[b"stsz"]
    same, n = struct.unpack_from(">II", data, at + 4)
    sizes = np.full(n, same, np.int64) if same else _ints(data, at + 12, n)
    if b"co64" in found:
        at, _ = found[b"co64"]
        chunks = _ints(data, at + 8, struct.unpack_from(">I", data, at + 4)[0], 8)
    else:
        at, _ = found[b"stco"]
        chunks = _ints(data, at + 8, struct.unpack_from(">I", data, at + 4)[0])
    at, _ = found[b"stsc"]
    runs = _ints(data, at + 8, 3 * struct.unpack_from(">I", data, at + 4)[0]).reshape(-1, 3)
    last = np.append(runs[1:, 0], len(chunks) + 1)
    per_chunk = np.repeat(runs[:, 1], last - runs[:, 0])
    owner = np.repeat(np.arange(len(chunks)), per_chunk)[:n]
    before = np.cumsum(sizes) - sizes
    first = np.searchsorted(owner, np.arange(len(chunks)))
    offsets = chunks[owner] + before - before[np.minimum(first[owner], max(n - 1, 0))]
    at, _ = found[b"stts"]
    times = _ints(data, at + 8, 2 * struct.unpack_from(">I", data, at + 4)[0]).reshape(-1, 2)
    if b"stss" in found:
        at, _ = found[b"stss"]
        sync = _ints(data, at + 8, struct.unpack_from(">I", data, at + 4)[0]) - 1
    else:
        sync = np.arange(n)
    return offsets, sizes, int((times[:, 0] * times[:, 1]).sum()), sync


def probe(data: bytes) -> dict:
    """Codec, timing, samples and keyframe byte ranges of the first track with samples."""
    track: dict[bytes, tuple[int, int]] = {}
    for path, body, stop in boxes(data):
        if path[-1] == b"trak" and b"stsz" in track:
            break
        if path[:2] == (b"moov", b"trak") and len(path) > 2:
            track[path[-1]] = (body, stop)
    if b"stsd" not in track or b"stsz" not in track:
        raise ValueError("no sample table")
    codec = data[track[b"stsd"][0] + 12 : track[b"stsd"][0] + 16].decode("latin-1")
    at = track[b"mdhd"][0]
    scale = struct.unpack_from(">I", data, at + (20 if data[at] == 1 else 12))[0]
    offsets, sizes, ticks, sync = _sample_table(data, track)
    return {"codec": codec, "timescale": scale, "duration": ticks, "offsets": offsets, "sizes": sizes, "keys": sync}


def payload_of(data: bytes, info: dict) -> bytes:
    """The stored samples in order, by their byte ranges."""
    if len(info["sizes"]) and info["offsets"][0] + info["sizes"].sum() == info["offsets"][-1] + info["sizes"][-1]:
        at = int(info["offsets"][0])
        return data[at : at + int(info["sizes"].sum())]
    return b"".join(data[a : a + n] for a, n in zip(info["offsets"].tolist(), info["sizes"].tolist()))


def feature_of(info: dict) -> str:
    """Stable text of a track's columns; keyframe ranges as count, first range and digest."""
    keys = info["keys"]
    ranges = ",".join(f"{a}+{n}" for a, n in zip(info["offsets"][keys].tolist(), info["sizes"][keys].tolist()))
    return (
        f"codec={info['codec'].strip()};timescale={info['timescale']};duration={info['duration']};samples={len(info['sizes'])};"
        f"keyframes={len(keys)};first={ranges.split(',')[0]};ranges={hashlib.sha256(ranges.encode()).hexdigest()[:16]}"
    )


def store_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) with each text as an ISO media file; a null text is empty."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                raw = [utf8(t.as_py()) for t in part.column(1)]
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": part.column(0), "n_bytes": pa.array([len(x) for x in raw], pa.int64()), "media": pa.array([mux(padded(x)) for x in raw], pa.binary())}
                )

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(build, "doc_id long, n_bytes long, media binary")


MEDIA_COLUMNS = "codec string, timescale long, duration long, n_samples long, keyframes array<struct<offset:long,length:long>>"


def media_columns(stored: DataFrame, column: str = "media", with_payload: bool = False) -> DataFrame:
    """``stored`` with codec, duration and keyframe byte ranges beside ``column``.

    A null or malformed file gives nulls in the added columns. With ``with_payload`` the
    digests of the samples read back stand in the place of ``column`` and the ranges.
    """
    keep = [c for c in stored.columns if c != column or not with_payload]
    digest = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stored.select(*keep).schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(column)
            rows = []
            for value in batch.column(at):
                data = value.as_py()
                try:
                    info = probe(data)
                except (ValueError, KeyError, struct.error, TypeError, IndexError):
                    rows.append((None,) * (6 if with_payload else 5))
                    continue
                if with_payload:
                    body = payload_of(data, info)
                    rows.append((len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature_of(info)))
                else:
                    keys = info["keys"]
                    ranges = [{"offset": a, "length": n} for a, n in zip(info["offsets"][keys].tolist(), info["sizes"][keys].tolist())]
                    rows.append((info["codec"], info["timescale"], info["duration"], len(info["sizes"]), ranges))
            names = [c.split()[0] for c in (digest if with_payload else MEDIA_COLUMNS).split(", ")]
            kinds = (
                [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                if with_payload
                else [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))]
            )
            cols = list(zip(*rows)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in keep] + [pa.array(c, k) for c, k in zip(cols, kinds)], names=keep + names
            )

    return stored.mapInArrow(read, f"{kept}, {digest if with_payload else MEDIA_COLUMNS}")


def media_digests(docs: DataFrame) -> DataFrame:
    """Store every text as a media file in the shared folder, read the bytes back, digest them.

    Null texts count as empty, repeated rows stay, an empty table gives none, other columns
    are ignored.
    """
    return media_columns(materialize(store_media(docs), "media", codec="zstd"), with_payload=True)
