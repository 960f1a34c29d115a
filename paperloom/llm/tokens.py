"""Encoding texts with a public byte-level BPE vocabulary by longest-match backtracking."""

from __future__ import annotations

import base64
import os

import ahocorasick
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.runtime import map_rows, spread

#: Fixed value: the published pre-tokenisation pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = os.environ.get("PAPERLOOM_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"
CACHE_ROWS = 200_000


def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """Token bytes -> rank (= id) of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Encoder:
    """Exact byte-pair ids in time linear in the text.

    The bytes of a pre-token are read as Latin-1, one automaton pass finds every vocabulary token
    at every position, and the longest one is taken as long as it stands next to its predecessor
    the way the merges would leave it; otherwise a shorter one, or the predecessor is taken back.
    Whether two tokens may be neighbours is decided once per pair and remembered.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for b, i in ranks.items():
            self.automaton.add_word(b.decode("latin-1"), (i, len(b)))
        self.automaton.make_automaton()
        self.pattern = regex.compile(PATTERN)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.cache: dict[str, tuple[int, ...]] = {}

    def merge(self, data: bytes) -> list[int]:
        """Ids by the merges themselves, lowest rank first; quadratic, for short strings only."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges leave these two tokens side by side."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= 5 * CACHE_ROWS:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        """Ids of one pre-token."""
        data = piece.encode("utf-8", "replace")
        whole = self.ranks.get(data)
        if whole is not None:
            return (whole,)
        found: list[list[tuple[int, int]]] = [[] for _ in data]
        for end, (i, n) in self.automaton.iter(data.decode("latin-1")):
            found[end - n + 1].append((i, n))  # ends ascend, so the longest of a start comes last
        reachable = [True] * (len(data) + 1)
        out: list[int] = []
        tried: list[int] = []  # which candidate each position of the stack uses
        pos, k = 0, len(found[0]) - 1
        while pos < len(data):
            here = found[pos]
            while k >= 0:
                i, n = here[k]
                if reachable[pos + n] and (not out or self.compatible(out[-1], i)):
                    break
                k -= 1
            if k >= 0:
                out.append(i)
                tried.append(k)
                pos += n
                k = len(found[pos]) - 1 if pos < len(data) else -1
            else:
                reachable[pos] = False
                i, k = out.pop(), tried.pop()
                pos -= len(self.bytes_of[i])
        return tuple(out)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text; the empty list for NULL and empty texts."""
        if not text:
            return []
        out: list[int] = []
        cache = self.cache
        for piece in self.pattern.findall(text):
            ids = cache.get(piece)
            if ids is None:
                ids = self.encode_piece(piece)
                if len(piece) <= 64:
                    if len(cache) >= CACHE_ROWS:
                        cache.clear()
                    cache[piece] = ids
            out.extend(ids)
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str = VOCABULARY) -> Encoder:
    """The encoder of a rank file, built once per process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(load_ranks(path))
    return _ENCODERS[path]


def encode_column(df: DataFrame, key: str, text: str, path: str = VOCABULARY) -> DataFrame:
    """(key, ids): the ids of each row's whole text, without special tokens.

    NULL and empty texts give the empty list, blank texts are encoded as they are; repeated rows
    stay. Narrow map without shuffle; the vocabulary file is read once per worker, so a cluster
    needs it at ``path`` on every node.
    """
    src = df.select(F.col(key).alias("k"), F.col(text).alias("t"))

    def run(cols: dict[str, list]) -> dict[str, list]:
        codec = encoder(path)
        return {"k": cols["k"], "ids": [codec.encode(t) for t in cols["t"]]}

    return map_rows(spread(src), f"k {dict(src.dtypes)['k']}, ids array<int>", run).select(F.col("k").alias(key), "ids")
