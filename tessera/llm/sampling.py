"""SentencePiece segmentations sampled without replacement, and their decoding.

The lattice of a text has its character positions as nodes and vocabulary pieces as arcs.
Arc probabilities are normalised by a backward pass, so any prefix knows its exact log
probability. Gumbel top-k then is an A* search over prefixes: a node carries a perturbed log
probability, its likeliest-perturbed child inherits it and the other children get values
truncated below it, so completing the best open node emits the next distinct sample. White
space starts a new piece, therefore equal words share one sub-lattice, and completing a node
is one vectorised walk over all words of a batch of texts.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import tokenizer_path

SPACE = "▁"
_CHUNK = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_HIDDEN = ""  # stands for a literal SPACE character of the text while it is cut
_MUL = np.uint64(0x100000001B3)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class PieceModel:
    """Pieces of a SentencePiece file with log weights.

    A unigram file's scores are log probabilities. A BPE file's scores are merge ranks; its
    pieces weigh -log(2 + rank), a Zipf law.
    """

    def __init__(self, path: str, inverse_temperature: float = 1.0):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        scores = np.array([sp.get_score(i) for i in range(n)])
        if all(float(scores[i]).is_integer() for i in normal[:1000]):
            ranks = np.zeros(n)
            ranks[normal] = np.arange(len(normal))
            scores = -np.log(2 + ranks)
        self.weight = scores * inverse_temperature
        self.weight[[i for i in range(n) if sp.is_byte(i)]] = float(self.weight[normal].min()) - 1.0
        self.byte_id = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        self.unk = sp.unk_id()
        self.byte_weight = float(self.weight[normal].min()) - 1.0
        self.raw = [p.replace(SPACE, " ").encode() for p in self.pieces]
        for b, i in self.byte_id.items():
            self.raw[i] = bytes([b])
        self.size = np.array([len(x) for x in self.raw], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.blob = np.frombuffer(b"".join(self.raw), np.uint8)
        usable = [i for i in normal if SPACE not in self.pieces[i].lstrip(SPACE)]
        self.tables = []
        for size in range(1, max((len(self.pieces[i]) for i in usable), default=0) + 1):
            ids = [i for i in usable if len(self.pieces[i]) == size]
            codes = self.codes([self.pieces[i] for i in ids])
            order = np.argsort(codes)
            bloom = np.zeros(1 << 20, bool)
            bloom[(codes * _SPREAD >> np.uint64(44)).astype(np.int64)] = True
            self.tables.append((codes[order], np.array(ids, np.int64)[order], bloom))

    @staticmethod
    def codes(words: list[str]) -> np.ndarray:
        out = np.zeros(len(words), np.uint64)
        with np.errstate(over="ignore"):
            for i, w in enumerate(words):
                code = np.uint64(0)
                for ch in w:
                    code = code * _MUL + np.uint64(ord(ch))
                out[i] = code
        return out

    def stand_in(self, chars: np.ndarray) -> np.ndarray:
        """Arc label of characters without a piece: a byte piece, or -1 - character if it takes more."""
        if len(self.byte_id) < 256:
            return -1 - chars
        single = np.array([self.byte_id[b] for b in range(128)])
        return np.where(chars < 128, single[np.minimum(chars, 127)], -1 - chars)

    def fallback(self, char: str) -> list[int]:
        """Byte pieces of a character without a piece (the unknown piece, if there are none)."""
        raw = (SPACE if char == _HIDDEN else char).encode("utf-8", "replace")
        return [self.byte_id[b] for b in raw] if len(self.byte_id) == 256 else [self.unk]

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """Text of pieces: bytes joined, the leading dummy space dropped."""
        ids = np.asarray(ids, np.int64)
        size = self.size[ids]
        at = np.repeat(self.at[ids] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        raw = self.blob[at].tobytes()
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def chunks_of(text: str) -> list[str]:
    """Cut a text at white-space starts, with the dummy prefix space."""
    return _CHUNK.findall(SPACE + text.replace(SPACE, _HIDDEN).replace(" ", SPACE))


class Lattice:
    """Sub-lattices of distinct words: arcs by node, with normalised log probabilities.

    Nodes are numbered along the words, ``base`` is each word's first one. Arcs are grouped by
    node, nodes nearest to their word's end first (``rank``), so the backward pass runs over
    slices. ``best`` is a node's likeliest arc and ``top`` its probability; ``until`` is the
    rank plus the cumulated share of the other arcs.
    """

    def __init__(self, model: PieceModel, words: list[str]):
        size = np.fromiter(map(len, words), np.int64, len(words))
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        n_nodes = len(chars)
        self.base = np.cumsum(size) - size
        left = np.repeat(self.base + size, size) - np.arange(n_nodes)
        found: list[tuple[np.ndarray, int, np.ndarray]] = []
        at, code = np.arange(n_nodes), np.zeros(n_nodes, np.uint64)
        bare = at
        with np.errstate(over="ignore"):
            for n, (codes, ids, bloom) in enumerate(model.tables, 1):
                if n > 1:
                    live = left[at] >= n
                    at, code = at[live], code[live]
                if not len(at):
                    break
                code = code * _MUL + chars[at + n - 1]
                if not len(codes):
                    continue
                maybe = np.flatnonzero(bloom[(code * _SPREAD >> np.uint64(44)).astype(np.int64)])
                where = np.minimum(np.searchsorted(codes, code[maybe]), len(codes) - 1)
                hit = codes[where] == code[maybe]
                found.append((at[maybe[hit]], n, ids[where[hit]]))
                if n == 1:
                    covered = np.zeros(n_nodes, bool)
                    covered[found[0][0]] = True
                    bare = np.flatnonzero(~covered)
        found.append((bare, 1, model.stand_in(chars[bare].astype(np.int64))))
        counts = np.zeros(n_nodes, np.int64)
        for node, _, _ in found:
            counts[node] += 1
        short = left.astype(np.uint16) if left.max(initial=0) < 1 << 16 else left
        order = np.argsort(short, kind="stable")
        self.rank = np.empty(n_nodes, np.int64)
        self.rank[order] = np.arange(n_nodes)
        sizes = counts[order]
        starts = np.cumsum(sizes) - sizes
        self.first = starts[self.rank]
        self.count = counts.astype(np.int32)
        n_arcs = int(counts.sum())
        self.reach, self.piece = np.empty(n_arcs, np.int32), np.empty(n_arcs, np.int32)
        fill = self.first.copy()
        for node, n, ids in found:
            slot = fill[node]
            self.reach[slot], self.piece[slot] = n, ids
            fill[node] += 1
        score = np.where(self.piece >= 0, model.weight[np.maximum(self.piece, 0)], 4 * model.byte_weight)
        # backward log sums, one distance from the word end at a time; nodes in rank order
        own = np.repeat(np.arange(n_nodes), sizes)
        target = order[own] + self.reach
        ends = left[order][own] == self.reach
        to = np.where(ends, n_nodes, self.rank[np.where(ends, 0, target)])
        beta = np.zeros(n_nodes + 1)
        self.logq = np.empty(n_arcs)
        levels = np.searchsorted(left[order], np.arange(1, int(left.max(initial=0)) + 2))
        cuts = np.append(starts, n_arcs)
        for i, j in zip(levels[:-1], levels[1:]):
            if i == j:
                continue
            x, y = cuts[i], cuts[j]
            value = score[x:y] + beta[to[x:y]]
            inner = starts[i:j] - x
            peak = np.maximum.reduceat(value, inner)
            total = peak + np.log(np.add.reduceat(np.exp(value - np.repeat(peak, sizes[i:j])), inner))
            beta[i:j] = total
            self.logq[x:y] = value - np.repeat(total, sizes[i:j])
        share = np.exp(self.logq)
        top = np.maximum.reduceat(share, starts) if n_nodes else np.zeros(0)
        likeliest = np.flatnonzero(share == np.repeat(top, sizes))
        best = np.empty(n_nodes, np.int64)
        best[own[likeliest][::-1]] = likeliest[::-1]
        self.best, self.top = best[self.rank], top[self.rank]
        share[best] = 0.0
        run = np.cumsum(share)
        before = np.concatenate([[0.0], run])[starts]
        rest = np.maximum(np.append(run, 0.0)[cuts[1:] - 1] - before, 1e-300)
        self.until = own + np.minimum((run - np.repeat(before, sizes)) / np.repeat(rest, sizes), 1.0)
        self.until[cuts[1:] - 1] = np.arange(n_nodes) + 1.0

    def extended(self, other: Lattice) -> Lattice:
        """One lattice with the words of both, ``other`` behind."""
        out = object.__new__(Lattice)
        nodes, arcs = len(self.top), len(self.reach)
        shift = {"base": nodes, "rank": nodes, "until": nodes, "first": arcs, "best": arcs}
        for name in ("base", "rank", "first", "count", "best", "top", "until", "reach", "piece", "logq"):
            setattr(out, name, np.concatenate([getattr(self, name), getattr(other, name) + shift.get(name, 0)]))
        return out

    def choose(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """Arc of each node drawn by its uniform number."""
        arc, top = self.best[node], self.top[node]
        rest = np.flatnonzero(u >= top)
        if len(rest):
            n = node[rest]
            again = np.minimum((u[rest] - top[rest]) / np.maximum(1.0 - top[rest], 1e-300), 1.0 - 2.0**-53)
            got = np.searchsorted(self.until, self.rank[n] + again, side="right")
            got = np.clip(got, self.first[n], self.first[n] + self.count[n] - 1)
            # a draw on the likeliest arc's empty share comes from rounding only
            stuck = got == arc[rest]
            got[stuck & (got > self.first[n])] -= 1
            arc[rest] = got
        return arc


class LatticeCache:
    """The lattice of a batch's words; repeated words are kept for later batches, to a bound."""

    KEPT = 60_000

    def __init__(self, model: PieceModel):
        self.model = model
        self.numbers: dict[str, int] = {}
        self.kept: Lattice | None = None
        self.lattice: Lattice | None = None

    def of(self, words: list[str]) -> np.ndarray:
        """Word numbers in ``self.lattice``."""
        counts = Counter(words)
        new = [w for w in counts if w not in self.numbers]
        room = max(0, self.KEPT - len(self.numbers))
        stay = [w for w in new if counts[w] > 1 and len(w) <= 64][:room]
        if stay:
            self.numbers.update(zip(stay, range(len(self.numbers), len(self.numbers) + len(stay))))
            built = Lattice(self.model, stay)
            self.kept = built if self.kept is None else self.kept.extended(built)
        once = [w for w in new if w not in self.numbers]
        here = dict(zip(once, range(len(self.numbers), len(self.numbers) + len(once))))
        self.lattice = self.kept
        if once:
            built = Lattice(self.model, once)
            self.lattice = built if self.kept is None else self.kept.extended(built)
        numbers = self.numbers | here
        return np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))


@lru_cache(maxsize=2)
def _pieces(path: str, inverse_temperature: float) -> PieceModel:
    """The piece model of this Python process."""
    return PieceModel(path, inverse_temperature)


def _uniform(rng: np.random.Generator) -> float:
    return max(float(rng.random()), 2.0**-54)


def _below(location: float, bound: float, rng: np.random.Generator) -> float:
    """A Gumbel variate at ``location`` given that it is at most ``bound``."""
    return min(bound, location - math.log(math.exp(min(location - bound, 700.0)) - math.log(_uniform(rng))))


class _Search:
    """Open nodes of one text.

    A node is a set of segmentations that leave an emitted path: first at a step of a range,
    or at one step by an arc that is not yet used there. Its value is the largest perturbed
    log probability in the set, so sets are split only when they are the best open ones.
    """

    __slots__ = ("a", "b", "words", "key", "heap", "paths")

    def __init__(self, a: int, b: int, words: tuple[int, int], key: int):
        self.a, self.b, self.words, self.key = a, b, words, key
        self.heap: list = []
        self.paths: list = []  # (positions of steps, arcs, log prefix before each step and at the end, value)

    def push_range(self, path: int, x: int, y: int, bound: float, rng: np.random.Generator) -> None:
        """Segmentations that leave ``path`` first at a step in [x, y)."""
        phi = self.paths[path][2]
        mass = -math.expm1(phi[y] - phi[x]) if y > x else 0.0
        if mass > 0:
            location = phi[x] + math.log(mass)
            heapq.heappush(self.heap, (-_below(location, bound, rng), len(self.heap), path, x, y, None))

    def push_arcs(self, path: int, x: int, used: tuple, lattice: Lattice, bound: float, rng: np.random.Generator) -> None:
        """Segmentations that leave ``path`` at step ``x`` by an arc not in ``used``."""
        mass = sum(math.exp(lattice.logq[i]) for i in self.others(path, x, used, lattice))
        if mass > 0:
            location = self.paths[path][2][x] + math.log(mass)
            heapq.heappush(self.heap, (-_below(location, bound, rng), len(self.heap), path, x, x, used))

    def others(self, path: int, x: int, used: tuple, lattice: Lattice) -> list[int]:
        node = int(self.paths[path][4][x])
        first = int(lattice.first[node])
        return [i for i in range(first, first + int(lattice.count[node])) if i not in used]

    def pop(self, lattice: Lattice, rng: np.random.Generator) -> tuple[float, int, int, int]:
        """(value, path, step, arc) of the best open segmentation; the rest of its set stays open."""
        value, _, path, x, y, used = heapq.heappop(self.heap)
        value = -value
        _, arcs, phi, _, _ = self.paths[path]
        if used is None:
            aim = phi[x] + math.log1p(-_uniform(rng) * -math.expm1(phi[y] - phi[x]))
            t = x + int(np.searchsorted(-phi[x + 1 : y + 1], -aim))
            t = min(t, y - 1)
            self.push_range(path, x, t, value, rng)
            self.push_range(path, t + 1, y, value, rng)
            x, used = t, (int(arcs[t]),)
        free = self.others(path, x, used, lattice)
        weight = np.exp(lattice.logq[free])
        arc = free[min(int(np.searchsorted(np.cumsum(weight), rng.random() * weight.sum(), side="right")), len(free) - 1)]
        self.push_arcs(path, x, (*used, arc), lattice, value, rng)
        return value, path, x, arc


def _stream(seed: int, key: int, turn: int) -> np.random.Generator:
    """The random numbers of one row and sample, a function of the row key only."""
    digest = hashlib.blake2b(f"{seed}:{key}:{turn}".encode(), digest_size=16).digest()
    return np.random.Generator(np.random.Philox(key=int.from_bytes(digest, "little")))


def sample_batch(
    model: PieceModel | LatticeCache, texts: list[str | None], keys: list[int], k: int, seed: int = 0
) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """Per text up to ``k`` distinct segmentations: (ids, log probability, perturbed, log inclusion).

    They come in descending order of the perturbed log probability. The inclusion score is
    the log probability that the segmentation's Gumbel exceeds the best one left open. An
    empty text has one segmentation, the empty one.
    """
    cache = model if isinstance(model, LatticeCache) else LatticeCache(model)
    model = cache.model
    cut = [chunks_of(t) if t else [] for t in texts]
    flat = [w for c in cut for w in c]
    if not flat:
        return [[(np.zeros(0, np.int64), 0.0, 0.0, 0.0)] for _ in texts]
    own = cache.of(flat)
    lattice = cache.lattice
    sizes = np.fromiter(map(len, flat), np.int64, len(flat))
    end = np.cumsum(sizes)
    start = end - sizes
    n_chars, shift = int(end[-1]), lattice.base[own] - start  # node = position + shift of its word
    word_at = np.repeat(np.arange(len(own), dtype=np.int32), sizes)
    states, w = [], 0
    for c, key in zip(cut, keys):
        a, b = (int(start[w]), int(end[w + len(c) - 1])) if c else (0, 0)
        states.append(_Search(a, b, (w, w + len(c)), key))
        w += len(c)

    def walk(place: np.ndarray, u: np.ndarray, arcs: np.ndarray) -> None:
        """Draw the rest of each word from the given positions; arcs by start position."""
        word = word_at[place]
        stop, move = end[word], shift[word]
        while len(place):
            arc = lattice.choose(place + move, u[place])
            arcs[place] = arc
            place = place + lattice.reach[arc]
            on = np.flatnonzero(place < stop)
            place, stop, move = place[on], stop[on], move[on]

    u = np.empty(n_chars)
    for turn in range(k):
        arcs = np.full(n_chars, -1, np.int32)
        begin, live = [], []
        for s in states:
            if turn and not s.heap:
                continue
            rng = _stream(seed, s.key, turn)
            if not turn:
                live.append((s, rng, -math.log(-math.log(_uniform(rng))), 0))
                begin.append(start[s.words[0] : s.words[1]])
            else:
                value, path, x, arc = s.pop(lattice, rng)
                places, old = s.paths[path][:2]
                arcs[places[:x]] = old[:x]
                p = int(places[x])
                arcs[p] = arc
                after, word = p + int(lattice.reach[arc]), int(word_at[p])
                begin.append(start[word + 1 : s.words[1]])
                if after < end[word]:
                    begin.append(np.array([after]))
                live.append((s, rng, value, x + 1))
            u[s.a : s.b] = rng.random(s.b - s.a)
        if not live:
            break
        walk(np.concatenate(begin), u, arcs)
        steps = np.flatnonzero(arcs >= 0)
        taken = arcs[steps]
        gain = lattice.logq[taken]
        nodes = steps + shift[word_at[steps]]
        for s, rng, value, since in live:
            i, j = np.searchsorted(steps, (s.a, s.b))
            phi = np.concatenate([[0.0], np.cumsum(gain[i:j])])
            s.paths.append((steps[i:j], taken[i:j], phi, value, nodes[i:j]))
            s.push_range(len(s.paths) - 1, since, int(j - i), value, rng)
    out: list[list] = []
    for s in states:
        bar = -s.heap[0][0] if s.heap else -np.inf
        rows = []
        for _, taken, phi, value, _ in s.paths:
            total = float(phi[-1])
            x = total - bar
            inclusion = 0.0 if x > 36 else float(np.log(-np.expm1(-np.exp(x)))) if x > -30 else x
            ids = lattice.piece[taken]
            if len(ids) and ids.min() < 0:
                ids = np.array([i for v in ids.tolist() for i in ([v] if v >= 0 else model.fallback(chr(-1 - v)))], np.int32)
            rows.append((ids, total, float(value), inclusion))
        out.append(rows)
    return out


SCHEMA = "doc_id long, rank int, n_pieces long, log_prob double, perturbed double, log_inclusion double"


def sample_segmentations(docs: DataFrame, k: int = 2, path: str | None = None, seed: int = 0, inverse_temperature: float = 1.0, with_ids: bool = True) -> DataFrame:
    """Up to ``k`` distinct segmentations of every text of ``docs`` (doc_id, text).

    Columns: doc_id, rank (from 1), n_pieces, log_prob, perturbed, log_inclusion, then ids, or
    without ``with_ids`` the digests ids_crc32 and decoded_sha256. Sampling is seeded by
    doc_id alone, so it does not depend on partitions and repeated rows give equal samples.
    Null texts count as empty and have one empty segmentation; a null doc_id seeds like -1;
    an empty table gives no rows; other columns are ignored.
    """
    path = path or tokenizer_path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = LatticeCache(_pieces(path, inverse_temperature))
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            a = 0
            while a < len(ids):
                b, size = a, 0
                while b < len(ids) and (b == a or size + len(texts[b] or "") <= 2_000_000):
                    size += len(texts[b] or "")
                    b += 1
                rows = []
                for doc_id, found in zip(ids[a:b], sample_batch(model, texts[a:b], [-1 if i is None else i for i in ids[a:b]], k, seed)):
                    for rank, (pieces, phi, g, inclusion) in enumerate(found, 1):
                        rows.append((doc_id, rank, len(pieces), phi, g, inclusion, pieces))
                cols = list(zip(*rows))
                out = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), *(pa.array(c, pa.float64()) for c in cols[3:6])]
                names = [c.split()[0] for c in SCHEMA.split(", ")]
                if with_ids:
                    out.append(pa.array([p.astype(np.int32) for p in cols[6]], pa.list_(pa.int32())))
                    names.append("ids")
                else:
                    out.append(pa.array([zlib.crc32(p.astype("<u4").tobytes()) for p in cols[6]], pa.int64()))
                    out.append(pa.array([hashlib.sha256(model.model.decode(p).encode("utf-8", "replace")).hexdigest() for p in cols[6]]))
                    names += ["ids_crc32", "decoded_sha256"]
                yield pa.RecordBatch.from_arrays(out, names=names)
                a = b

    extra = "ids array<int>" if with_ids else "ids_crc32 long, decoded_sha256 string"
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, f"{SCHEMA}, {extra}")


def decode_pieces(rows: DataFrame, path: str | None = None) -> DataFrame:
    """``rows`` with text beside ids (array<int>); null ids give a null text."""
    path = path or tokenizer_path("piece_bpe_32k.model")
    keep = [c for c in rows.columns if c != "text"]
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel(path)
        for batch in batches:
            at = batch.schema.get_field_index("ids")
            text = pa.array([None if x is None else model.decode([i for i in x if i is not None]) for x in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, text], names=[*keep, "text"])

    return rows.select(*keep).mapInArrow(run, f"{kept}, text string")
