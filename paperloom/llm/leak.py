"""Evaluation passages inside a corpus: rare n-gram seeds, then Smith-Waterman."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.words import hash_texts, mix
from paperloom.runtime import durable, map_rows, spread

WINDOW_WORDS = 10
#: Of every so many words of a passage the rarest seed is kept, however common, for edited copies.
RUN_WORDS = 5
MATCH, MISMATCH, GAP = 2, -1, -1
#: A seed is an ordered pair of words at most so far apart, however far: edits between them don't matter.
SEED_REACH = 2
#: A seed is rare if at most this share of the documents (or so many) hold it.
RARE_SHARE, RARE_LEAST = 0.01, 20
#: So many words of passages (40 bytes each) are broadcast at once; more are met in several passes.
BROADCAST_WORDS = 1_000_000
#: So many cells of a row of alignment matrices, and of words of pairs, are worked on at once.
CELLS, PAIR_WORDS = 100_000, 1_000_000


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int, int]:
    """Smith-Waterman over word hashes with linear gaps: (score, matched words on the best path's
    diagonal cells, longest run of equal consecutive words, end of the best alignment in ``b``)."""
    prev = np.zeros(len(b) + 1, dtype=np.int32)
    hits = np.zeros(len(b) + 1, dtype=np.int32)
    run = np.zeros(len(b) + 1, dtype=np.int32)
    slope = np.arange(len(b) + 1, dtype=np.int32) * -GAP
    best, matched, longest, end = 0, 0, 0, 0
    for x in a:
        same = b == x
        diag = prev[:-1] + np.where(same, MATCH, MISMATCH)
        up = prev[1:] + GAP
        cell = np.zeros_like(prev)
        cell[1:] = np.maximum(np.maximum(diag, up), 0)
        count = np.zeros_like(hits)
        count[1:] = np.where(diag >= up, hits[:-1] + same, hits[1:])
        lifted = cell + slope
        reach = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == reach, np.arange(len(lifted)), 0))
        cell, hits = reach - slope, count[source]
        hits[cell <= 0] = 0
        cell = np.maximum(cell, 0)
        nxt = np.zeros_like(run)
        nxt[1:] = np.where(same, run[:-1] + 1, 0)
        run, prev = nxt, cell
        top = int(cell.argmax())
        if cell[top] > best:
            best, matched, end = int(cell[top]), int(hits[top]), top
        longest = max(longest, int(run.max()))
    return best, matched, longest, end


def _passages(items: DataFrame, key: str, sides: list[str]) -> DataFrame:
    src = items.select(F.col(key).alias("item"), F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("t")) for s in sides])).alias("x")).select("item", "x.side", "x.t")
    return src.where("item is not null and t is not null").distinct()


def align_all(pairs: list[tuple[np.ndarray, np.ndarray]], track: bool = True) -> np.ndarray:
    """(score, matched, longest run) of ``align`` for many pairs at once, those of like lengths side by
    side; only the score (and zeros) unless ``track``, which is three times as fast."""
    out = np.zeros((len(pairs), 3), dtype=np.int32)
    order = sorted((k for k in range(len(pairs)) if len(pairs[k][0]) and len(pairs[k][1])), key=lambda k: (len(pairs[k][1]), len(pairs[k][0])))
    at = 0
    while at < len(order):
        n = 1
        while at + n < len(order) and (n + 1) * len(pairs[order[at + n]][1]) <= CELLS:
            n += 1
        part = order[at : at + n]
        at += n
        a = np.full((n, max(len(pairs[k][0]) for k in part)), -2, dtype=np.int64)
        b = np.full((n, max(len(pairs[k][1]) for k in part)), -1, dtype=np.int64)
        for r, k in enumerate(part):
            a[r, : len(pairs[k][0])] = pairs[k][0]
            b[r, : len(pairs[k][1])] = pairs[k][1]
        width = b.shape[1] + 1
        prev, hits, run = (np.zeros((n, width), dtype=np.int32) for _ in range(3))
        place = np.arange(width, dtype=np.int32)
        slope, rows = place * -GAP, np.arange(n)
        best, matched, longest = (np.zeros(n, dtype=np.int32) for _ in range(3))
        for i in range(a.shape[1]):
            same = b == a[:, i : i + 1]
            diag = prev[:, :-1] + np.where(same, np.int32(MATCH), np.int32(MISMATCH))
            up = prev[:, 1:] + np.int32(GAP)
            cell = np.zeros_like(prev)
            if not track:
                cell[:, 1:] = np.maximum(np.maximum(diag, up), 0)
                prev = np.maximum.accumulate(cell + slope, axis=1) - slope
                np.maximum(best, prev.max(axis=1), out=best)
                continue
            count = np.zeros_like(prev)
            cell[:, 1:] = np.maximum(np.maximum(diag, up), 0)
            count[:, 1:] = np.where(diag >= up, hits[:, :-1] + same, hits[:, 1:])
            lifted = cell + slope
            reach = np.maximum.accumulate(lifted, axis=1)
            source = np.maximum.accumulate(np.where(lifted == reach, place, 0), axis=1)
            cell, hits = reach - slope, np.take_along_axis(count, source, axis=1)
            hits[cell <= 0] = 0
            prev = np.maximum(cell, 0)
            grown = np.zeros_like(run)
            grown[:, 1:] = np.where(same, run[:, :-1] + 1, 0)
            run = grown
            top = prev.argmax(axis=1)
            more = prev[rows, top] > best
            best[more], matched[more] = prev[rows, top][more], hits[rows, top][more]
            np.maximum(longest, run.max(axis=1), out=longest)
        out[part] = np.stack([best, matched, longest], axis=1)
    return out


def _best_ranges(value: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The best sum of a range within each of the lists that ``value`` holds end to end (none is empty)."""
    stops = np.cumsum(sizes + 1) - 1
    flat = np.empty(len(value) + len(sizes), dtype=np.int64)
    inside = np.ones(len(flat), dtype=bool)
    inside[stops] = False
    flat[inside] = value
    flat[stops] = -4 * int(sizes.max()) * int(np.abs(value).max()) - 1  # no range gains by crossing it
    total = np.cumsum(flat)
    gain = total - np.minimum.accumulate(np.concatenate([[0], total[:-1]]))
    return np.maximum.reduceat(gain, np.concatenate([[0], stops[:-1] + 1]))


def seed_pairs(h: np.ndarray, apart: int) -> np.ndarray:
    """The seed of each word (given by hashes) and the one ``apart`` places later."""
    return mix(h[:-apart] * np.uint64(0xC2B2AE3D27D4EB4F) + h[apart:])


class Block:
    """Passages of one pass: their words as numbers, and their seeds."""

    def __init__(self, rows: list[tuple], least: int):
        hashed, sizes = hash_texts([t for _, _, t in rows])
        parts = np.split(hashed, np.cumsum(sizes)[:-1]) if len(sizes) else []
        kept = [k for k, h in enumerate(parts) if len(h) >= least]
        self.keys = [rows[k][:2] for k in kept]
        hashes = [parts[k] for k in kept]
        self.vocabulary = np.unique(np.concatenate(hashes)) if hashes else np.empty(0, dtype=np.uint64)
        self.words = [np.searchsorted(self.vocabulary, h) for h in hashes]
        self.sizes = np.array([len(w) for w in self.words], dtype=np.int64)
        self.flat = np.concatenate(self.words) if hashes else np.empty(0, dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        runs = [[seed_pairs(h, apart) for apart in range(1, SEED_REACH + 1)] for h in hashes]
        self.seeds = np.unique(np.concatenate([r for run in runs for r in run])) if runs else np.empty(0, dtype=np.uint64)
        self.runs = [[np.searchsorted(self.seeds, r) for r in run] for run in runs]
        # (passage, word) pairs that there are
        self.held = np.unique(np.repeat(np.arange(len(kept)), self.sizes) * len(self.vocabulary) + self.flat)

    def choose(self, df: np.ndarray, documents: int, edited: bool) -> None:
        """Keep the seeds to be joined on, given in how many documents each stands: the rarest that
        occurs of each window of ten words, by which no exact run of ten is lost; for edited copies
        that of each window of five, and all rare ones."""
        width = RUN_WORDS if edited else WINDOW_WORDS
        rare = (df > 0) & (df <= max(RARE_LEAST, RARE_SHARE * documents))
        seeds, passages = [], []
        for k, run in enumerate(self.runs):
            windows = max(1, int(self.sizes[k]) - width + 1)
            least, own = np.full(windows, np.iinfo(np.int64).max), np.zeros(windows, dtype=np.int64)
            for x in run:
                n = np.where(df[x] > 0, df[x], np.iinfo(np.int64).max)
                view = np.lib.stride_tricks.sliding_window_view(n, len(n) - windows + 1)
                first = np.arange(windows) + view.argmin(axis=1)
                own, least = np.where(n[first] < least, x[first], own), np.minimum(n[first], least)
            chosen = [own[least < np.iinfo(np.int64).max], *([x[rare[x]] for x in run] if edited else [])]
            seeds.append(np.unique(np.concatenate(chosen)))
            passages.append(np.full(len(seeds[-1]), k))
        seed = np.concatenate(seeds) if seeds else np.empty(0, dtype=np.int64)
        order = np.argsort(seed, kind="stable")
        self.passages = np.concatenate(passages)[order] if passages else seed
        used, first = np.unique(seed[order], return_index=True)
        self.first, self.last = first, np.append(first[1:], len(seed))
        self.seeds, self.runs = self.seeds[used], []

    def seeds_of(self, hashed: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, seed): the distinct seeds that each of the documents holds."""
        doc = np.repeat(np.arange(len(sizes)), sizes)
        hits = [np.empty(0, dtype=np.int64)]
        for apart in range(1, SEED_REACH + 1) if len(self.seeds) and len(hashed) > SEED_REACH else ():
            pairs = seed_pairs(hashed, apart)
            place = np.minimum(np.searchsorted(self.seeds, pairs), len(self.seeds) - 1)
            hit = (self.seeds[place] == pairs) & (doc[:-apart] == doc[apart:])
            hits.append(doc[:-apart][hit] * len(self.seeds) + place[hit])
        return np.divmod(np.unique(np.concatenate(hits)), max(1, len(self.seeds)))

    def candidates(self, hashed: np.ndarray, sizes: np.ndarray, floor: int, miss: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, passage) pairs that share a seed and whose alignment can reach ``floor``, and the
        documents' words as numbers.

        A local alignment covers a range of either side. Each word of the range scores MATCH if it
        is aligned to an equal one, which the other side must hold, and else costs ``miss`` at least.
        So no alignment exceeds the best range sum with MATCH for words that the other side holds.
        """
        none = len(self.vocabulary)
        doc, seed = self.seeds_of(hashed, sizes)
        count = self.last[seed] - self.first[seed] if len(seed) else np.empty(0, dtype=np.int64)
        at = np.repeat(self.first[seed] - np.cumsum(count) + count, count) + np.arange(count.sum()) if len(seed) else count
        doc, passage = np.divmod(np.unique(np.repeat(doc, count) * len(self.keys) + self.passages[at]), max(1, len(self.keys)))
        place = np.minimum(np.searchsorted(self.vocabulary, hashed), max(0, none - 1))
        numbers = np.where(self.vocabulary[place] == hashed, place, none) if none else np.zeros(len(hashed), dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        own = np.unique(np.repeat(np.arange(len(sizes)), sizes) * (none + 1) + numbers)
        own = own[own % (none + 1) < none]
        good = [np.empty(0, dtype=np.int64)]
        load = np.cumsum(self.sizes[passage] + sizes[doc]) // PAIR_WORDS
        for part in np.split(np.arange(len(doc)), np.flatnonzero(np.diff(load)) + 1) if len(doc) else ():
            d, k = doc[part], passage[part]
            value = self.flat[_ranges(self.starts[k], self.sizes[k])]
            reached = _best_ranges(np.where(_among(own, np.repeat(d, self.sizes[k]) * (none + 1) + value), MATCH, miss), self.sizes[k]) >= floor
            part, d, k = part[reached], d[reached], k[reached]
            if not len(part):
                continue
            value = numbers[_ranges(starts[d], sizes[d])]
            held = (value < none) & _among(self.held, np.repeat(k, sizes[d]) * none + np.minimum(value, none - 1))
            good.append(part[_best_ranges(np.where(held, MATCH, miss), sizes[d]) >= floor])
        good = np.concatenate(good)
        return doc[good], passage[good], numbers


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all ranges, end to end."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def _among(known: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(x), dtype=bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def leaks(documents: DataFrame, doc_key: str, text: str, items: DataFrame, item_key: str, sides: list[str], min_score: int = 2 * WINDOW_WORDS * MATCH // 2, edited: bool = True, block_words: int = BROADCAST_WORDS) -> DataFrame:
    """(doc, item, side, score, matched, longest_run): documents that hold a passage of an item.

    Kept are alignments of at least ``min_score`` (ten matched words) or with an exact run of ten
    words, edited copies included; without ``edited`` only those with an exact run. Documents and
    passages meet in seeds, ordered pairs of words one or two places apart: of each window of ten
    passage words the rarest that occurs at all, so that no exact run of ten is lost; for edited
    copies of each window of five, so that none with a run of five is lost, and every rare seed. Seeds are counted over all documents (copies once a task, so that a hot
    text doesn't make its own seeds common). What meets and can reach the score, by a bound that no
    alignment exceeds, is aligned by Smith-Waterman over the whole text. An alignment of ten matched
    words shares at least nine seeds; lost are those without a run of five of which all are common
    and none the rarest of its window.

    NULL keys or texts and blank texts come out nowhere, nor do passages too short for the score;
    repeated rows count once. Passages of up to ``block_words`` words are broadcast at once; more are
    met in several passes over the documents. Documents are read in narrow maps, only counts of
    seeds and what is found are shuffled.
    """
    docs = documents.select(F.col(doc_key).alias("doc"), F.col(text).alias("t")).where("doc is not null and t is not null")
    passages = durable(_passages(items, item_key, sides))
    count, size = passages.agg(F.count("*"), F.sum(F.length("t") / 2)).first()  # a word and its separator are two characters at least
    blocks = max(1, min(count, -(-int(size or 0) // max(1, block_words))))
    floor = min(min_score, MATCH * WINDOW_WORDS) if edited else MATCH * WINDOW_WORDS
    miss = max(MISMATCH, GAP) if edited else -MATCH * WINDOW_WORDS  # an exact run has no miss: one costs all
    source, types = spread(docs), {"doc": dict(docs.dtypes)["doc"], "item": dict(passages.dtypes)["item"]}
    found = None
    for n in range(blocks):
        rows = [tuple(r) for r in passages.where(F.pmod(F.xxhash64("item", "side", "t"), F.lit(blocks)) == n).select("item", "side", "t").collect()]
        block = Block(rows, -(-floor // MATCH))
        df, total = _seed_counts(source, block)
        block.choose(df, total, edited)
        part = _aligned(source, types, documents.sparkSession.sparkContext.broadcast(block), floor, miss, min_score, edited)
        found = part if found is None else found.union(part)
    return found.groupBy("doc", "item", "side").agg(F.max("score").alias("score"), F.max("matched").alias("matched"), F.max("longest_run").alias("longest_run"))


def _seed_counts(source: DataFrame, block: Block) -> tuple[np.ndarray, int]:
    """In how many documents each of the block's seeds stands, and how many documents there are;
    copies of a text that a task meets count once."""
    df = np.zeros(len(block.seeds) + 1, dtype=np.int64)
    if not len(block.seeds):
        return df[:-1], 0
    shared = source.sparkSession.sparkContext.broadcast(block)
    seen: set[int] = set()  # each task has its own

    def run(cols: dict[str, list]) -> dict[str, list | pa.Array]:
        if len(seen) > 500_000:
            seen.clear()
        texts = list({hash(t): t for t in cols["t"] if hash(t) not in seen}.values())
        seen.update(map(hash, texts))
        _, seed = shared.value.seeds_of(*hash_texts(texts))
        place, n = np.unique(seed, return_counts=True)
        last = len(shared.value.seeds)
        return {"seed": pa.array(np.append(place, last).astype(np.int32)), "n": pa.array(np.append(n, len(texts)).astype(np.int64))}

    for r in map_rows(source.select("t"), "seed int, n bigint", run).groupBy("seed").agg(F.sum("n").alias("n")).collect():
        df[r["seed"]] = r["n"]
    return df[:-1], int(df[-1])


def _aligned(source: DataFrame, types: dict[str, str], shared, floor: int, miss: int, min_score: int, edited: bool) -> DataFrame:
    def run(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("doc", "item", "side", "score", "matched", "longest_run")}
        block = shared.value
        hashed, sizes = hash_texts(cols["t"])
        doc, passage, numbers = block.candidates(hashed, sizes, floor, miss)
        each = np.split(numbers, np.cumsum(sizes)[:-1])
        pairs = list(zip(doc.tolist(), passage.tolist()))
        reached = align_all([(block.words[k], each[d]) for d, k in pairs], track=False)[:, 0] >= floor
        pairs = [x for x, ok in zip(pairs, reached) if ok]
        for (d, k), (score, matched, longest) in zip(pairs, align_all([(block.words[k], each[d]) for d, k in pairs]).tolist()):
            if longest >= WINDOW_WORDS or (edited and score >= min_score):
                for name, v in (("doc", cols["doc"][d]), ("item", block.keys[k][0]), ("side", block.keys[k][1]), ("score", score), ("matched", matched), ("longest_run", longest)):
                    out[name].append(v)
        return out

    return map_rows(source, f"doc {types['doc']}, item {types['item']}, side string, score int, matched int, longest_run int", run)
