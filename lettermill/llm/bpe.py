"""Exact byte-level BPE over a whole corpus, in time linear in the text.

The text is cut by the tokenizer's pattern; each piece becomes UTF-8 bytes, read as Latin-1 characters so that an Aho-Corasick automaton
of all tokens (pyahocorasick works on strings) finds every token that starts at every place in one pass.  From the longest token at
a place the encoder steps on, keeps a step only if the two adjacent tokens could stand side by side in a BPE result, and backs up
to the next shorter token otherwise; places found dead are never entered again.  Whether two tokens may be adjacent is found
by undoing their last merges and is memoised.  The result is what applying the merges in order gives.

Defined results: null and empty texts give an empty list; special tokens' strings are ordinary text; invalid lone surrogates cannot occur
in a Spark string; texts of any length are encoded whole.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.session import spread

TOKENIZERS = "/opt/tokenizers"
NAME = "byte_bpe_50k.json"
# Fixed value: the pattern of this public tokenizer that cuts a text into pieces.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CACHE_PIECE, _CACHE_SIZE = 64, 400_000


def _printable_bytes() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file, by its rule: printable Latin-1 stands for itself, the others follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Encodes strings with one vocabulary file."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte = _printable_bytes()
        latin = lambda t: "".join(chr(byte[c]) for c in t)
        vocab = model["vocab"]
        self.pieces = regex.compile(PATTERN).findall
        self.size: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.single: dict[str, int] = {}
        for m in model["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            pair = (vocab[a], vocab[b])
            self.parts[vocab[a + b]] = pair
            self.merged[pair] = vocab[a + b]
        self.automaton = ahocorasick.Automaton()
        for t, i in vocab.items():
            # a token that no merge makes, and that is no single byte, is a special token: its string is ordinary text
            if len(t) == 1 or i in self.parts:
                s = latin(t)
                self.size[i] = len(s)
                if len(s) == 1:
                    self.single[s] = i
                self.automaton.add_word(s, (i, len(s)))
        self.automaton.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        self.cache: dict[str, tuple[int, ...]] = {}

    def adjacent(self, a: int, b: int) -> bool:
        """Can ``a`` directly before ``b`` be part of a BPE result?  Undo the younger of the two merges, step by step, and see whether a merge across the border would have come first."""
        got = self.fits.get((a, b))
        if got is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            got = self.fits[(a, b)] = self._adjacent(a, b)
        return got

    def _adjacent(self, a: int, b: int) -> bool:
        parts, merged = self.parts, self.merged
        before = 1 << 60  # a merge across the border counts only if it is older than this
        while True:
            m = merged.get((a, b))
            if m is not None and m < before:
                return False
            # ids of merged tokens rise with the order of their merges; bytes come first of all
            age_a, age_b = (a if a in parts else -1), (b if b in parts else -1)
            if age_a < 0 and age_b < 0:
                return True
            if age_a > age_b:
                before, a = a, parts[a][1]
            else:
                # on a tie the left one of two equal merges happens first, so one across the border of that age loses to nothing
                before, b = b + 1, parts[b][0]

    def piece(self, text: str) -> tuple[int, ...]:
        """Ids of one piece."""
        got = self.cache.get(text)
        if got is None:
            got = self._piece(text.encode("utf-8").decode("latin-1"))
            if len(text) <= _CACHE_PIECE:
                if len(self.cache) >= _CACHE_SIZE:
                    self.cache.clear()
                self.cache[text] = got
        return got

    def _piece(self, s: str) -> tuple[int, ...]:
        n = len(s)
        starts: list[list[int]] = [[] for _ in range(n)]  # ids of the tokens that start here, shorter first
        for end, (i, size) in self.automaton.iter(s):
            starts[end - size + 1].append(i)
        if n and len(starts[0]) and self.size[starts[0][-1]] == n and self._whole(starts[0][-1]):
            return (starts[0][-1],)
        out: list[int] = []
        tried: list[int] = []  # for each token of out, which of the tokens starting at its place it is
        dead = bytearray(n + 1)
        pos, k = 0, len(starts[0]) - 1 if n else -1
        while pos < n:
            while k >= 0:
                t = starts[pos][k]
                end = pos + self.size[t]
                if not dead[end] and (self.adjacent(out[-1], t) if out else True) and self._whole(t):
                    break
                k -= 1
            if k >= 0:
                out.append(t)
                tried.append(k)
                pos = end
                k = len(starts[pos]) - 1 if pos < n else -1
            else:
                dead[pos] = 1
                t = out.pop()
                pos -= self.size[t]
                k = tried.pop() - 1
        return tuple(out)

    @lru_cache(maxsize=None)  # noqa: B019 - at most one entry a token of the vocabulary
    def _whole(self, t: int) -> bool:
        """Does BPE of the token's own bytes give the token?  Its two parts must be whole and fit until this very merge."""
        if t not in self.parts:
            return True
        a, b = self.parts[t]
        return self._whole(a) and self._whole(b) and self._fits_before(a, b, t)

    def _fits_before(self, a: int, b: int, limit: int) -> bool:
        """As ``adjacent`` with the merge that makes ``limit`` itself left out."""
        parts, merged, before, first = self.parts, self.merged, limit, True
        while True:
            m = merged.get((a, b))
            if m is not None and m < before and not first:
                return False
            first = False
            age_a, age_b = (a if a in parts else -1), (b if b in parts else -1)
            if age_a < 0 and age_b < 0:
                return True
            if age_a > age_b:
                before, a = min(before, a), parts[a][1]
            else:
                before, b = min(before, b + 1), parts[b][0]

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if text:
            get, piece, extend = self.cache.get, self.piece, out.extend
            for p in self.pieces(text):
                extend(get(p) or piece(p))
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encoded(docs: DataFrame, keep: list[str], text: str = "text", folder: str = TOKENIZERS, name: str = NAME) -> DataFrame:
    """The columns ``keep`` and ``ids``, the token ids of ``text``."""
    path = os.path.join(folder, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path).encode
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                ids = pa.array([enc(t) for t in part.column(len(keep)).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], ids], names=[*keep, "ids"])

    src = spread(docs.select(*keep, F.col(text).alias("_text")))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    return src.mapInArrow(run, f"{kinds}, ids array<int>")


def counted(docs: DataFrame, keep: list[str], text: str = "text", folder: str = TOKENIZERS, name: str = NAME) -> DataFrame:
    """The columns ``keep`` and ``n_tokens``; the ids do not leave the Python worker."""
    path = os.path.join(folder, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            n = pa.array([len(enc.encode(t)) for t in batch.column(len(keep)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], n], names=[*keep, "n_tokens"])

    src = spread(docs.select(*keep, F.col(text).alias("_text")))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    return src.mapInArrow(run, f"{kinds}, n_tokens long")


def size_of(ids: Column | str) -> Column:
    return F.size(ids)
