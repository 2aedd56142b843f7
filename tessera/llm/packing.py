"""Sum-of-squares online packing of documents into fixed token windows.

Each document is cut into full windows and a remainder. A remainder goes to the open fill
level that minimises the sum of squared counts of partially filled windows; the counts are
one array indexed by fill level. An item that reaches the end of a window is cut there and
what is left of it is placed anew, at a price that keeps such cuts rare, so the sum of squares
also bounds the number of open windows. The few that stay partial when a partition ends are
joined by cutting, so a partition pads at most one window.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import tokenizer_path

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class SumOfSquaresPacker:
    """Online packer; ``add`` yields the pieces of windows that became final.

    Level l holds the open windows with ``l * quantum`` to ``(l + 1) * quantum - 1`` tokens. A
    cut that leaves up to a quantum of an item is free, a longer one costs ``cut_price``.
    """

    def __init__(self, window: int = 2_048, levels: int = 32, cut_price: int = 6):
        self.window, self.cut_price = window, cut_price
        self.quantum = max(1, -(-window // levels))
        n = -(-window // self.quantum)
        self.level = [0] * (n + 1)  # open windows per level; the last entry stays 0
        self.open: list[list[tuple[int, list]]] = [[] for _ in range(n)]  # (fill, pieces)
        self.fill = [0] * n  # of the window that would be taken next
        self.live: set[int] = set()  # levels with open windows: few, so a choice is a short loop
        self.next = 0
        self.closed = self.joined = self.whole = 0  # windows by the rule, by the last flush, of one document

    def choose(self, size: int) -> int:
        """Level whose window takes an item so that the sum of squares rises least; -1: a new one.

        Moving a window from level h to t changes the sum by 2(N[t] - N[h] + 1), a new window
        by 2 N[t] + 1, closing one by 1 - 2 N[h]; a rest that a cut leaves is counted as a new
        window and its price. Ties take the fullest window.
        """
        level, window, quantum = self.level, self.window, self.quantum
        best, least, top = -1, 2 * level[size // quantum] + 1, -1
        for h in self.live:
            end = self.fill[h] + size
            if end < window:
                t = end // quantum
                cost = 0 if t == h else 2 * (level[t] - level[h] + 1)
            elif end == window:
                cost = 1 - 2 * level[h]
            else:
                over = end - window
                cost = 2 - 2 * level[h] + 2 * level[over // quantum] + (self.cut_price if over > quantum else 0)
            if cost < least or cost == least and h > top:
                best, least, top = h, cost, h
        return best

    @property
    def n_open(self) -> int:
        return sum(self.level)

    def _emit(self, pieces: list) -> Iterator[tuple]:
        at = 0
        for doc_id, start, ids, total in pieces:
            yield doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next, at
            at += len(ids)
        self.next += 1

    def _take(self, level: int) -> tuple[int, list]:
        own = self.open[level]
        taken = own.pop()
        self.level[level] -= 1
        if own:
            self.fill[level] = own[-1][0]
        else:
            self.live.discard(level)
        return taken

    def _put(self, fill: int, pieces: list) -> None:
        level = fill // self.quantum
        self.open[level].append((fill, pieces))
        self.level[level] += 1
        self.fill[level] = fill
        self.live.add(level)

    def add(self, doc_id: int, ids: np.ndarray) -> Iterator[tuple]:
        total, at = len(ids), 0
        while total - at >= self.window:
            yield from self._emit([(doc_id, at, ids[at : at + self.window], total)])
            self.whole += 1
            at += self.window
        while at < total:
            level = self.choose(total - at)
            fill, pieces = self._take(level) if level >= 0 else (0, [])
            part = ids[at : at + self.window - fill]
            pieces.append((doc_id, at, part, total))
            at, fill = at + len(part), fill + len(part)
            if fill == self.window:
                self.closed += 1
                yield from self._emit(pieces)
            else:
                self._put(fill, pieces)

    def flush(self) -> Iterator[tuple]:
        """Join the windows still open by cutting; only the last of them may be incomplete."""
        pieces, size = [], 0
        for own in reversed(self.open):
            for _, parts in own:
                for doc_id, start, ids, total in parts:
                    while len(ids):
                        cut = ids[: self.window - size]
                        pieces.append((doc_id, start, cut, total))
                        size, start, ids = size + len(cut), start + len(cut), ids[len(cut) :]
                        if size == self.window:
                            self.joined += 1
                            yield from self._emit(pieces)
                            pieces, size = [], 0
            own.clear()
        self.level = [0] * len(self.level)
        self.live.clear()
        if pieces:
            self.joined += 1
            yield from self._emit(pieces)


def pack_documents(docs: DataFrame, path: str | None = None, window: int = 2_048, end_id: int = 1) -> DataFrame:
    """One row per piece of every document of ``docs`` (doc_id, text).

    A document is its ids and ``end_id``; a null text is an empty one (just ``end_id``).
    Repeated rows are packed each. Input partitions are packed apart (no shuffle);
    ``sequence_id`` carries the partition above bit 33. Other columns are ignored, an empty
    table gives no rows. Results depend on the partitioning, each is a valid packing.
    """
    from .wordbpe import encoder

    path = path or tokenizer_path()
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 33
        packer, enc, rows = SumOfSquaresPacker(window), encoder(path), []
        end = np.array([end_id], "<u4")

        def batch_of(rows: list) -> pa.RecordBatch:
            cols = list(zip(*rows))
            cols[5] = [base + x for x in cols[5]]
            return pa.RecordBatch.from_pydict({n: pa.array(c, pa.int64()) for n, c in zip(names, cols)})

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows.extend(packer.add(doc_id, np.concatenate([enc.encode(text.as_py()), end])))
            if len(rows) >= 5_000:
                yield batch_of(rows)
                rows = []
        rows.extend(packer.flush())
        if rows:
            yield batch_of(rows)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(pack, SCHEMA)
