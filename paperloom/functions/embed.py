"""Deterministic hash embeddings and vector distances."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.runtime import map_rows

#: Words that a worker remembers the hash of.
CACHE_ROWS = 500_000


class _Buckets(dict):
    """word -> signed one-based bucket of its SHA-256, remembered up to a bounded number of words."""

    def __init__(self, dim: int):
        super().__init__()
        self.dim = dim

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_ROWS:
            self.clear()
        h = hashlib.sha256(word.encode("utf-8", "surrogatepass")).digest()
        bucket = int.from_bytes(h[:4], "big") % self.dim + 1
        value = self[word] = bucket if h[4] % 2 == 0 else -bucket
        return value


_KNOWN: dict[int, _Buckets] = {}


def embed_text(text: str | None, dim: int = 64) -> list[float]:
    """Signed counts of white-space tokens in lower case, as a unit vector: the bucket is the
    first four bytes of a token's SHA-256 modulo ``dim``, the sign + if the fifth byte is even.
    Zeros for NULL and blank texts."""
    known = _KNOWN.setdefault(dim, _Buckets(dim))
    ws = (text or "").lower().split()
    signed = np.fromiter(map(known.__getitem__, ws), dtype=np.int64, count=len(ws))
    v = np.bincount(np.abs(signed) - 1, weights=np.sign(signed), minlength=dim) if len(ws) else np.zeros(dim)
    norm = float(np.sqrt((v * v).sum()))
    return (v / norm if norm else v).tolist()


def hash_embedding(df: DataFrame, key: str, text: str, dim: int = 64) -> DataFrame:
    """(key, embedding) of each row; a narrow map without shuffle. Tokens recur so much that hashing
    each distinct one once per worker beats a hash expression per token."""
    src = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    out = map_rows(src, f"k {dict(src.dtypes)['k']}, embedding array<double>", lambda c: {"k": c["k"], "embedding": [embed_text(t, dim) for t in c["t"]]})
    return out.select(F.col("k").alias(key), "embedding")


def squared_l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two arrays, in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine of two arrays, NULL if one is all zero."""
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


#: Embedding providers by name: functions (df, key, text) -> (key, embedding).
PROVIDERS: dict[str, Callable[[DataFrame, str, str], DataFrame]] = {"hash": hash_embedding, "local_hash": hash_embedding, "test": hash_embedding}


def get_provider(name: str) -> Callable[[DataFrame, str, str], DataFrame]:
    """A provider by name; remote ones are registered by the user."""
    try:
        return PROVIDERS[(name or "").strip().lower()]
    except KeyError:
        raise ValueError(f"no embedding provider {name!r}; registered: {sorted(PROVIDERS)}") from None
