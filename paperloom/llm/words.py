"""Words, shingles and stable hashes shared by the text operators of this subpackage."""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A word is a longest run of letters and digits.
WORD = re.compile(r"[^\W_]+")
CACHE_ROWS = 500_000


def words(text: str | None) -> list[str]:
    """Lower-cased words of a text; none for NULL and blank texts."""
    return WORD.findall(text.lower()) if text else []


class Hashes(dict):
    """word -> stable 64-bit hash, remembered up to a bounded number of words."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_ROWS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


HASHES = Hashes()
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (a bijection with good avalanche)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


#: So many characters of texts are worked on at once.
CHARACTERS = 2_000_000
_BASE = 0x9E3779B97F4A7C15
_TABLES: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What is known of code points (0 nothing, 1 no letter or digit, 2 one), a random value of
    each, and the powers of the base and of its inverse up to ``n``; made once per process."""
    if not _TABLES:
        _TABLES["alnum"] = np.zeros(0x110000, dtype=np.int8)
        _TABLES["value"] = mix(np.arange(1, 0x110001, dtype=np.uint64))
    if len(_TABLES.get("power", ())) < n:
        for name, base in (("power", _BASE), ("inverse", pow(_BASE, -1, 1 << 64))):
            _TABLES[name] = np.cumprod(np.concatenate([np.ones(1, dtype=np.uint64), np.full(n, base, dtype=np.uint64)]))
    return _TABLES["alnum"], _TABLES["value"], _TABLES["power"], _TABLES["inverse"]


def _hash_joined(joined: str) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of a lower-cased text, and where each begins."""
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    alnum, value, power, inverse = _tables(max(CHARACTERS, len(codes)))
    kind = alnum[codes]
    if not kind.all():
        for c in np.unique(codes[kind == 0]).tolist():
            alnum[c] = 1 + chr(c).isalnum()
        kind = alnum[codes]
    edge = np.diff(kind, prepend=1, append=1)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(value[codes] * power[: len(codes)])])
    return mix((sums[ends] - sums[starts]) * inverse[starts]), starts


def _parts(text: str) -> list[str]:
    """A text in parts of about CHARACTERS characters, cut between words."""
    if len(text) <= CHARACTERS:
        return [text]
    out, at = [], 0
    while at < len(text):
        stop = min(len(text), at + CHARACTERS)
        while stop < len(text) and text[stop].isalnum():
            stop += 1
        out.append(text[at:stop])
        at = stop
    return out


def hash_texts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, end to end, and how many words each text has."""
    hashes, counts = [np.zeros(0, dtype=np.uint64)], []
    group: list[str] = []
    size = 0

    def flush() -> None:
        nonlocal group, size
        if group:
            h, starts = _hash_joined("\n".join(group))
            ends = np.cumsum([len(t) + 1 for t in group])
            hashes.append(h)
            counts.extend(np.diff(np.searchsorted(starts, ends), prepend=0).tolist())
        group, size = [], 0

    for text in texts:
        low = text.lower()
        if len(low) > CHARACTERS:
            flush()
            n = 0
            for part in _parts(low):
                h, _ = _hash_joined(part)
                hashes.append(h)
                n += len(h)
            counts.append(n)
            continue
        if size + len(low) > CHARACTERS:
            flush()
        group.append(low)
        size += len(low) + 1
    flush()
    return np.concatenate(hashes), np.array(counts, dtype=np.int64)


def hash_words(ws: list[str]) -> np.ndarray:
    """Stable 64-bit hashes of words, in order."""
    return np.fromiter(map(HASHES.__getitem__, ws), dtype=np.uint64, count=len(ws))


def shingle_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive words, given the words' hashes (not made distinct)."""
    if len(h) < n:
        return h[:0]
    out = np.zeros(len(h) - n + 1, dtype=np.uint64)
    for i in range(n):
        out = out * _MULT[0] + h[i : len(h) - n + 1 + i] * _MULT[1 + i % 4]
    return mix(out)


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark's signed BIGINT."""
    return x.view(np.int64)


def most_frequent(counts: DataFrame, by: str, most: int) -> DataFrame:
    """At most ``most`` rows, those of the higher counts, without a sort: counts are told apart by
    quarters of a power of two, of which there are few."""
    level = F.floor(4 * F.log2(F.col(by))).cast("int")
    sizes = counts.where(F.col(by) > 0).groupBy(level.alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect()
    least, total = 10**6, 0
    for r in sizes:
        total += r["n"]
        if total > most:
            break
        least = r["level"]
    return counts.where((F.col(by) > 0) & (level >= least))
