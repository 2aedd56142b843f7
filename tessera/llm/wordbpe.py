"""Whole-text encoding with a word-bounded BPE file of the tokenizers library.

The library spends most of its time on normalising and on words it has already seen. Where
the vocabulary file has the shape checked in :class:`WordEncoder` (NFC, white space folded,
lower case, no token across white space), a text's ids are the concatenation of its
white-space chunks' ids, so chunks are kept in a bounded cache and only the model is called.
Texts outside that shape go to the library as they are; both ways give the same ids.
"""

from __future__ import annotations

import json
import os
import sys
from array import array
from collections.abc import Callable

import numpy as np

_PLAIN = r"[^\x00-\x1b\x20-ɏ‐-‧‰-›€]"


def _packed(ids: list[int]) -> bytes:
    """Little-endian 16-bit numbers."""
    out = array("H", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def _filled(seen: dict[str, bytes], keys: list[str], make: Callable[[str], bytes]) -> list[bytes]:
    """The kept value of every key, made where it is not kept."""
    found = list(map(seen.get, keys))
    if None in found:
        for i, x in enumerate(found):
            if x is None:
                key = keys[i]
                found[i] = seen.get(key) or make(key)
    return found


class WordEncoder:
    """``encode(text)`` -> little-endian uint32 ids, special strings as the file has them."""

    CHUNKS, WORDS = 400_000, 300_000

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.fast = (
            kinds == ["NFC", "Replace", "Lowercase"]
            and [x.get("type") for x in parts] == ["Split", "ByteLevel"]
            and not parts[1].get("add_prefix_space")
            and len(spec["model"]["vocab"]) <= 1 << 16
        )
        if self.fast:
            self.split = regex.compile(parts[0]["pattern"]["Regex"]).findall
            self.special = [x["content"] for x in spec.get("added_tokens", [])]
            self.odd = regex.compile(_PLAIN).search
            self.model = self.tokenizer.model
            printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
            rest = [b for b in range(256) if b not in set(printable)]
            self.bytemap = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}
            self.words: dict[str, bytes] = {}
            self.chunks: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        mapped = word if word.isascii() and word.isprintable() else word.encode("utf-8").decode("latin-1").translate(self.bytemap)
        ids = _packed([t.id for t in self.model.tokenize(mapped)])
        if len(self.words) >= self.WORDS:
            self.words.clear()
        self.words[word] = ids
        return ids

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isalpha():  # letters alone are one word of the split
            out = self.words.get(chunk) or self._word(chunk)
        else:
            out = b"".join(_filled(self.words, self.split(chunk), self._word))
        if len(chunk) <= 64:
            if len(self.chunks) >= self.CHUNKS:
                self.chunks.clear()
            self.chunks[chunk] = out
        return out

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u4")
        if not self.fast or any(s in text for s in self.special) or self.odd(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        ids = b"".join(_filled(self.chunks, text.lower().split(), self._chunk))
        return np.frombuffer(ids, "<u2").astype("<u4")


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The encoder of this Python process for ``path``."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
