"""Language of words and documents by a linear-chain conditional random field.

A word's emission scores come from hashed character n-grams with word boundaries (the
affixes are those that touch a boundary) and from a learned lexicon. Transitions between
words are learned on sequences spliced from documents of different languages, so that
code-switched text is labelled word by word; forward-backward gives the marginals.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LETTER = re.compile(r"[^\W\d_]")
BUCKETS = 1 << 16
GRAMS = 4
CHUNK = 32
UNDETERMINED = "und"
ROWS = 256  # texts whose words are held at a time


def gram_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word index, bucket) of every 1- to 4-gram of ``\\x02word\\x03``, lower-cased words."""
    text = "".join(f"\x02{w}\x03" for w in words)
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    owner = np.cumsum(chars == 2) - 1
    index, bucket = [], []
    code = np.zeros(len(chars), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, GRAMS + 1):
            code = code[: len(chars) - n + 1] * np.uint64(0x100000001B3) + chars[n - 1 :] + np.uint64(n)
            inside = owner[: len(code)] == owner[n - 1 :]
            index.append(owner[: len(code)][inside])
            bucket.append((code[inside] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.int64))
    return np.concatenate(index), np.concatenate(bucket)


def letterless(words: list[str]) -> np.ndarray:
    """Mask of the words without a letter of any script."""
    return np.fromiter((not w.isalpha() and LETTER.search(w) is None for w in words), bool, len(words))


@dataclass
class Crf:
    """Emission weights, lexicon and transitions of a learned label set."""

    labels: list[str]
    weight: np.ndarray
    transition: np.ndarray
    lexicon: dict[str, int] = field(default_factory=dict)  # word -> row of lexicon_rows
    lexicon_rows: np.ndarray | None = None
    lexicon_weight: float = 1.0

    def lexical(self, words: list[str]) -> np.ndarray:
        """Lexicon scores of ``words``; unknown words score nothing."""
        out = np.zeros((len(words), len(self.labels)))
        rows = np.fromiter((self.lexicon.get(w, -1) for w in words), np.int64, len(words))
        known = rows >= 0
        if known.any():
            out[known] = self.lexicon_rows[rows[known]]
        return out

    def emissions(self, words: list[str]) -> np.ndarray:
        """Score of every label for every word; words without letters score nothing."""
        n, k = len(words), len(self.labels)
        if not n:
            return np.zeros((0, k))
        index, bucket = gram_features(words)
        size = np.maximum(np.bincount(index, minlength=n), 1)
        got = self.weight[bucket]
        out = np.stack([np.bincount(index, got[:, c], n) for c in range(k)], 1) / np.sqrt(size)[:, None]
        out += self.lexicon_weight * self.lexical(words)
        out[letterless(words)] = 0
        return out


def forward_backward(emission: np.ndarray, lengths: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Label marginals of every word of several sequences laid end to end.

    Each sequence is cut into chunks; the chunks' transfer matrices are multiplied up in
    parallel, scanned per sequence, and the inside of all chunks is done together. All steps
    are normalised, so lengths do not matter for precision.
    """
    n, k = emission.shape
    if not n:
        return emission.copy()
    a = np.exp(transition - transition.max())
    b = np.exp(emission - emission.max(1, keepdims=True))
    n_chunks = -(-lengths // CHUNK)
    first = np.cumsum(n_chunks) - n_chunks
    seq = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(n) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    row, col = first[seq] + place // CHUNK, place % CHUNK
    total = int(n_chunks.sum())
    grid = np.ones((total, CHUNK, k))
    grid[row, col] = b
    used = np.zeros((total, CHUNK), bool)
    used[row, col] = True

    whole = np.broadcast_to(np.eye(k), (total, k, k)).copy()
    for t in range(CHUNK):
        on = used[:, t]
        if not on.any():
            break
        moved = (whole[on].reshape(-1, k) @ a).reshape(-1, k, k) * grid[on, t][:, None, :]
        whole[on] = moved / moved.sum((1, 2), keepdims=True)
    left, right = np.full((total, k), 1.0 / k), np.full((total, k), 1.0 / k)
    for r in range(1, int(n_chunks.max(initial=0))):
        at = first[n_chunks > r] + r
        v = np.einsum("ni,nij->nj", left[at - 1], whole[at - 1])
        left[at] = v / v.sum(1, keepdims=True)
        at = (first + n_chunks)[n_chunks > r] - 1 - r
        v = np.einsum("nij,nj->ni", whole[at + 1], right[at + 1])
        right[at] = v / v.sum(1, keepdims=True)

    alpha, beta = np.empty_like(grid), np.empty_like(grid)
    now = left
    for t in range(CHUNK):
        v = np.where(used[:, t, None], (now @ a) * grid[:, t], now)
        now = alpha[:, t] = v / v.sum(1, keepdims=True)
    now = right
    for t in range(CHUNK - 1, -1, -1):
        beta[:, t] = now
        v = np.where(used[:, t, None], (now * grid[:, t]) @ a.T, now)
        now = v / v.sum(1, keepdims=True)
    gamma = alpha[row, col] * beta[row, col]
    return gamma / gamma.sum(1, keepdims=True)


def spliced(by_label: list[list[list[str]]], n: int, length: int, rng: np.random.Generator) -> tuple[list[str], np.ndarray]:
    """``n`` sequences of ``length`` words that switch language at random places."""
    words, truth = [], []
    live = [c for c, docs in enumerate(by_label) if docs]
    for _ in range(n):
        got: list[str] = []
        while len(got) < length:
            c = int(rng.choice(live))
            doc = by_label[c][rng.integers(len(by_label[c]))]
            size = min(int(rng.integers(4, 30)), length - len(got))
            at = int(rng.integers(max(1, len(doc) - size + 1)))
            part = doc[at : at + size]
            got += part
            truth += [c] * len(part)
        words += got
    return words, np.array(truth, np.int64)


def fit(texts: list[str], langs: list[str], sequences: int = 6_000, length: int = 40, epochs: int = 3, rate: float = 0.3, seed: int = 11) -> Crf:
    """Learn lexicon, emissions and transitions by gradient steps on spliced sequences."""
    labels = sorted(set(langs))
    k = len(labels)
    by_label: list[list[list[str]]] = [[] for _ in labels]
    counts: dict[str, Counter] = defaultdict(Counter)
    for text, lang in zip(texts, langs):
        words = text.lower().split()
        if words:
            c = labels.index(lang)
            by_label[c].append(words)
            for w in set(words):
                counts[w][c] += 1
    model = Crf(labels, np.zeros((BUCKETS, k)), np.zeros((k, k)))
    if k < 2 or sum(map(bool, by_label)) < 2:
        return model
    docs = np.array([max(1, len(d)) for d in by_label], float)
    common = [w for w, per in counts.items() if sum(per.values()) >= 3]
    model.lexicon = {w: i for i, w in enumerate(common)}
    logs = np.log((np.array([[counts[w][c] for c in range(k)] for w in common]).reshape(-1, k) + 0.1) / docs)
    model.lexicon_rows = np.clip(logs - logs.mean(1, keepdims=True), -3, 3)
    counts.clear()
    rng = np.random.default_rng(seed)
    words, truth = spliced(by_label, sequences, length, rng)
    unique, inverse = np.unique(np.array(words, object), return_inverse=True)
    unique = unique.tolist()
    index, bucket = gram_features(unique)
    share = 1 / np.sqrt(np.maximum(np.bincount(index, minlength=len(unique)), 1))
    ends = np.searchsorted(index, np.arange(len(unique) + 1), sorter=(order := np.argsort(index, kind="stable")))
    bucket = bucket[order]
    lexical, plain = model.lexical(unique), letterless(unique)
    squares, batch = np.full((BUCKETS, k), 1e-6), 250 * length
    t_square, l_square = np.full((k, k), 1e-6), 1e-6
    for _ in range(epochs):
        for at in range(0, len(words), batch):
            ids, y = inverse[at : at + batch], truth[at : at + batch]
            own, back = np.unique(ids, return_inverse=True)
            spans = [bucket[ends[i] : ends[i + 1]] for i in own]
            sizes = np.array([len(s) for s in spans])
            flat, who = np.concatenate(spans), np.repeat(np.arange(len(own)), sizes)
            got = model.weight[flat]
            em = np.stack([np.bincount(who, got[:, c], len(own)) for c in range(k)], 1) * share[own][:, None] + model.lexicon_weight * lexical[own]
            em[plain[own]] = 0
            gamma = forward_backward(em[back], np.full(len(ids) // length, length), model.transition)
            error = -gamma
            error[np.arange(len(y)), y] += 1
            error[plain[ids]] = 0
            per_word = np.stack([np.bincount(back, error[:, c], len(own)) for c in range(k)], 1)
            step = per_word[who] * share[own][who][:, None]
            grad = np.stack([np.bincount(flat, step[:, c], BUCKETS) for c in range(k)], 1) - 1e-3 * model.weight
            squares += grad * grad
            model.weight += rate * grad / np.sqrt(squares)
            slope = float((error * lexical[ids]).sum())
            l_square += slope * slope
            model.lexicon_weight = max(0.0, model.lexicon_weight + 0.1 * slope / np.sqrt(l_square))
            g, y2 = gamma.reshape(-1, length, k), y.reshape(-1, length)
            seen = np.zeros((k, k))
            np.add.at(seen, (y2[:, :-1].ravel(), y2[:, 1:].ravel()), 1)
            grad_t = seen - expected_pairs(em[back].reshape(-1, length, k), g, model.transition)
            t_square += grad_t * grad_t
            model.transition += 0.3 * grad_t / np.sqrt(t_square)
    return model


def expected_pairs(emission: np.ndarray, gamma: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Expected label bigrams: pair marginals follow from the word marginals and the step factor."""
    a = np.exp(transition - transition.max())
    b = np.exp(emission - emission.max(2, keepdims=True))
    now, out = np.full((len(b), b.shape[2]), 1.0 / b.shape[2]), np.zeros_like(a)
    for t in range(b.shape[1]):
        v = (now @ a) * b[:, t]
        if t:
            # P(i, j) = alpha_i a_ij b_j beta_j with beta_j proportional to gamma_j / alpha_j
            ratio = gamma[:, t] / np.maximum(v, 1e-300)
            out += (now[:, :, None] * a[None] * (b[:, t] * ratio)[:, None, :]).sum(0)
        now = v / v.sum(1, keepdims=True)
    return out


class Labeller:
    """Applies a model to texts; emissions of seen words are kept, within a bound."""

    KEPT, PART = 150_000, 100_000

    def __init__(self, model: Crf):
        self.model = model
        self.row: dict[str, int] = {}
        self.kept = np.zeros((0, len(model.labels)))

    def emissions(self, words: list[str]) -> np.ndarray:
        new = [w for w in dict.fromkeys(words) if w not in self.row]
        if new:
            if len(self.row) + len(new) > self.KEPT:
                new = list(dict.fromkeys(words))
                self.row, self.kept = {}, np.zeros((0, len(self.model.labels)))
            base = len(self.row)
            self.row.update(zip(new, range(base, base + len(new))))
            self.kept = np.concatenate([self.kept, *(self.model.emissions(new[i : i + 20_000]) for i in range(0, len(new), 20_000))])
        return self.kept[np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))]

    def marginals(self, texts: list[str]) -> Iterator[tuple[list[str], np.ndarray]]:
        """(words, label marginals) of every text."""
        start = 0
        split = [t.lower().split() for t in texts]
        while start < len(split):
            stop, size = start, 0
            while stop < len(split) and (stop == start or size + len(split[stop]) <= self.PART):
                size += len(split[stop])
                stop += 1
            words = [w for s in split[start:stop] for w in s]
            lengths = np.array([len(s) for s in split[start:stop]])
            live = lengths > 0
            gamma = forward_backward(self.emissions(words), lengths[live], self.model.transition)
            at = 0
            for s in split[start:stop]:
                yield s, gamma[at : at + len(s)]
                at += len(s)
            start = stop

    def documents(self, texts: list[str | None]) -> Iterator[tuple[str, float]]:
        """(label, share of the word marginals) of every text; ``und`` without letters."""
        if not self.model.labels:  # nothing was learned
            yield from ((UNDETERMINED, 0.0) for _ in texts)
            return
        good = [t if t and LETTER.search(t) else "" for t in texts]
        for text, (words, gamma) in zip(good, self.marginals(good)):
            if not words:
                yield UNDETERMINED, 0.0
                continue
            mass = gamma.sum(0)
            yield self.model.labels[int(mass.argmax())], float(min(1.0, mass.max() / mass.sum()))


def train_language(docs: DataFrame, is_training: Column, max_docs: int = 2_400, max_bytes: int = 16 << 20) -> Crf:
    """Learn from at most ``max_docs`` documents and ``max_bytes`` of text, an equal share per language.

    They are those whose hash of doc_id has the fewest bits; null texts and null languages are left out, rows
    that repeat count once, and a text longer than its language's share of the bytes is not
    sampled. Every language is learned; more languages than ``max_docs`` are an error. The fit
    runs in one task over the sample, so that the driver holds the learned weights alone.
    """
    rows = docs.where(is_training & F.col("text").isNotNull() & F.col("lang").isNotNull())
    keys = rows.select("doc_id", "lang", F.xxhash64("text").alias("text_key"), F.octet_length("text").alias("bytes"))
    hashed = keys.withColumn("hash", F.xxhash64("doc_id")).withColumn("bits", F.length(F.bin("hash")))
    # a hash of few bits is rare: per language, the rows of so few bits that just enough are left
    counts: dict[str, dict[int, int]] = defaultdict(dict)
    for lang, bits, n in hashed.groupBy("lang", "bits").count().limit(65 * (max_docs + 1)).collect():
        counts[lang][bits] = n
    langs = sorted(counts)
    if not langs:
        return fit([], [])
    if len(langs) > max_docs:
        raise ValueError(f"at least {len(langs)} languages cannot share {max_docs} documents")
    share, each = max_bytes // len(langs), max_docs // len(langs)
    most = {x: next((b for b in range(65) if sum(n for at, n in counts[x].items() if at <= b) >= 2 * each), 64) for x in langs}
    limits = docs.sparkSession.createDataFrame(sorted(most.items()), "lang string, most int")
    near = hashed.join(F.broadcast(limits), "lang").where("bits <= most")
    order = Window.partitionBy("lang").orderBy("bits", "hash", "doc_id", "text_key")
    first = near.where(F.col("bytes") <= share).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= each)
    so_far = F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    picked = first.withColumn("upto", so_far).where(F.col("upto") <= share).select("doc_id", "lang", "text_key").distinct()
    full = rows.select("doc_id", "lang", "text", F.xxhash64("text").alias("text_key")).join(F.broadcast(picked), ["doc_id", "lang", "text_key"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted({row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(3)))}, key=lambda r: (r[0] is None, r[0] or 0, r[2], r[1]))
        model = fit([r[2] for r in got], [r[1] for r in got])
        model.weight = model.weight.astype(np.float32)
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(model)], pa.binary())})

    learned = full.select("doc_id", "lang", "text").repartition(1).mapInArrow(learn, "model binary").first()
    return pickle.loads(learned[0]) if learned else fit([], [])


def predict_language(docs: DataFrame, model: Crf) -> DataFrame:
    """``docs`` columns without text, plus lang_pred and score, of every row.

    ``und`` with score 0 for null texts and texts without a letter. Repeated rows stay, an
    empty table gives none; a column named lang_pred or score is replaced.
    """
    keep = [c for c in docs.columns if c not in ("text", "lang_pred", "score")]
    return _labelled(docs.select(F.struct(*[f"`{c}`" for c in keep]).alias("row"), "text"), model, lambda batch: batch.column(1)).select("row.*", "lang_pred", "score")


def explained_rows(docs: DataFrame, model: Crf, least_share: float) -> DataFrame:
    """Rows of ``docs``, all columns, whose language has ``least_share`` of the word marginals.

    Null texts and texts without a letter are not among them; rows that repeat stay.
    """
    found = _labelled(docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row")), model, lambda batch: batch.column(0).field("text"))
    return found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least_share)).select("row.*")


def _labelled(rows: DataFrame, model: Crf, text_of: Callable[[pa.RecordBatch], pa.Array]) -> DataFrame:
    """(row, lang_pred, score) of rows (row struct, ...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(model)
        parts = (batch.slice(a, ROWS) for batch in batches for a in range(0, batch.num_rows, ROWS))
        for part in parts:
            found = list(labeller.documents(text_of(part).to_pylist()))
            lang, score = pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())
            yield pa.RecordBatch.from_arrays([part.column(0), lang, score], names=["row", "lang_pred", "score"])

    schema = T.StructType([rows.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, schema)
