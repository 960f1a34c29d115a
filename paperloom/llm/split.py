"""Splitting oversized texts at natural boundaries (structure-tree packing)."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.runtime import map_rows, spread

TOKEN = re.compile(r"\b\w+(?:[-']\w+)?\b|[^\w\s]")
HEADING = re.compile(r"^(?:#{1,6}\s+\S.*|\d+(?:\.\d+)*\.?\s+[A-Z][^.!?\n]{1,90}|[A-Z][A-Z0-9 ,:&/-]{2,99})$", re.M)
#: Boundaries inside a block, from the strongest to the weakest: each pattern's match ends a unit.
LEVELS = (
    re.compile(r"\n[^\S\n]*\n\s*"),  # paragraphs
    re.compile(r"\n(?=[^\S\n]*(?:[-*•‣–]|\(?\d{1,3}[.)]|\(?[a-z][.)]|\|)\s)"),  # list items and table rows
    re.compile(r"(?<=[.!?…])[\"'”»)\]]*\s+(?=[\"'“«(\[¿¡]?[^\Wa-z_])"),  # sentences
    re.compile(r"(?<=[;:,])\s+|\n"),  # clauses and lines
    re.compile(r"\s+"),  # words
)
PIECE = "array<struct<piece_index:int,start:int,stop:int,token_count:int,text:string>>"


def estimate_tokens(text: str | None) -> int:
    """0 if blank, else the larger of the token matches and a quarter of the characters, rounded up."""
    if not text or not text.strip():
        return 0
    return max(len(TOKEN.findall(text)), -(-len(text) // 4))


class _Measure:
    """Token counts of spans of one text by two prefix lookups; exact for spans that cut no token."""

    def __init__(self, text: str):
        self.text = text
        self.starts, self.stops = [], []
        for m in TOKEN.finditer(text):
            self.starts.append(m.start())
            self.stops.append(m.end())

    def __call__(self, a: int, b: int) -> int:
        if a >= b:
            return 0
        n = bisect_left(self.starts, b) - bisect_right(self.stops, a)
        return max(n, -(-(b - a) // 4))


def _cut(text: str, a: int, b: int, pattern: re.Pattern, at_start: bool) -> list[tuple[int, int]]:
    points = [m.start() if at_start else m.end() for m in pattern.finditer(text, a, b)]
    edges = [a, *[p for p in points if a < p < b], b]
    return [(x, y) for x, y in zip(edges, edges[1:]) if x < y]


def _children(text: str, a: int, b: int, level: int) -> tuple[list[tuple[int, int]], int]:
    """The parts of a node at the strongest level that divides it, and the level below."""
    if level < 0:
        parts = _cut(text, a, b, HEADING, True)
        if len(parts) > 1:
            return parts, 0
        level = 0
    while level < len(LEVELS):
        parts = _cut(text, a, b, LEVELS[level], False)
        level += 1
        if len(parts) > 1:
            return parts, level
    return [], level


def _pack(measure: _Measure, a: int, b: int, limit: int, level: int) -> list[tuple[int, int]]:
    """Spans of at most ``limit`` tokens that cover [a, b): oversized nodes are descended into,
    adjacent siblings are merged bottom-up while they fit."""
    if measure(a, b) <= limit:
        return [(a, b)]
    parts, below = _children(measure.text, a, b, level)
    if not parts:  # one unbroken run: no natural boundary is left
        starts = measure.starts[bisect_left(measure.starts, a) : bisect_left(measure.starts, b)]
        step, out, x = limit * 4, [], a
        while x < b:
            y = min(b, x + step)
            inside = bisect_left(starts, y) - bisect_left(starts, x)
            if inside > limit:
                y = min(y, starts[bisect_left(starts, x) + limit])
            out.append((x, y))
            x = y
        return out
    spans: list[tuple[int, int]] = []
    for x, y in parts:
        for piece in _pack(measure, x, y, limit, below):
            if spans and measure(spans[-1][0], piece[1]) <= limit:
                spans[-1] = (spans[-1][0], piece[1])
            else:
                spans.append(piece)
    return spans


def split_text(text: str | None, max_tokens: int = 520, overlap_tokens: int = 80) -> list[tuple[int, int, int, str]]:
    """Ordered pieces (start, stop, token_count, text) of one text.

    A text of at most ``max_tokens`` is one piece; NULL and blank texts give none. A longer text
    is packed into spans of ``max_tokens - overlap_tokens`` new tokens; every further piece begins
    with up to ``overlap_tokens`` of the piece before, from a sentence start if there is one, else
    from a word. All pieces but for white space at their ends tile the text in order.
    """
    if not text or not text.strip():
        return []
    if estimate_tokens(text) <= max_tokens:
        return [(0, len(text), estimate_tokens(text), text)]
    measure = _Measure(text)
    spans = _pack(measure, 0, len(text), max_tokens - overlap_tokens, -1)
    out = []
    for i, (a, b) in enumerate(spans):
        start = a
        if i and overlap_tokens:
            floor, back = spans[i - 1][0], a
            first = bisect_left(measure.starts, a)
            low = max(bisect_left(measure.starts, floor), first - overlap_tokens)
            options = [measure.starts[k] for k in range(low, first) if measure(measure.starts[k], a) <= overlap_tokens]
            if options:
                back = options[0]
                ends = [m.end() for m in LEVELS[2].finditer(text, max(0, back - 2), a)]
                back = next((e for e in ends if back <= e < a), back)
                words = [o for o in options if o >= back and (o == 0 or text[o - 1].isspace())]
                back = words[0] if words and back not in options else back
            start = back
        piece = text[start:b]
        while estimate_tokens(piece) > max_tokens and start < a:  # a cut inside a run can shift a match
            start = next((s for s in measure.starts[bisect_right(measure.starts, start) :] if s <= a), a)
            piece = text[start:b]
        lead = len(piece) - len(piece.lstrip())
        piece = piece.strip()
        if piece:
            out.append((start + lead, start + lead + len(piece), estimate_tokens(piece), piece))
    return out


def split_oversized(df: DataFrame, text: str, keys: list[str], max_tokens: int = 520, overlap_tokens: int = 80, oversized_only: bool = False) -> DataFrame:
    """One row per piece of each text: ``keys``, tokens (of the whole text), piece_index, start,
    stop, token_count, piece. A narrow map, no shuffle; each text is handled whole.

    NULL and blank texts give no piece; texts within the limit come out as one piece, or not at
    all with ``oversized_only``; repeated rows give repeated pieces. Only ``keys`` are carried, so
    other columns of the input can't clash.
    """
    src = df.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(text).alias("t"))
    types = dict(src.dtypes)
    names = [f"k{i}" for i in range(len(keys))]
    # a text of so few characters can't exceed the limit, as every token has a character
    if oversized_only:
        src = src.where(F.length("t") > max_tokens)

    def run(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {n: [] for n in [*names, "tokens", "piece_index", "start", "stop", "token_count", "piece"]}
        for i, t in enumerate(cols["t"]):
            n = estimate_tokens(t)
            if n == 0 or oversized_only and n <= max_tokens:
                continue
            for j, (a, b, c, p) in enumerate(split_text(t, max_tokens, overlap_tokens)):
                for k in names:
                    out[k].append(cols[k][i])
                for k, v in (("tokens", n), ("piece_index", j), ("start", a), ("stop", b), ("token_count", c), ("piece", p)):
                    out[k].append(v)
        return out

    schema = ", ".join([*(f"{n} {types[n]}" for n in names), "tokens int, piece_index int, start int, stop int, token_count int, piece string"])
    return map_rows(spread(src), schema, run).select(*[F.col(n).alias(k) for n, k in zip(names, keys)], "tokens", "piece_index", "start", "stop", "token_count", "piece")


def texts_to_split(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """All chunk texts and section texts as (kind, item_key, position, text)."""
    def row(kind: str, key: Column, position: Column, text: Column) -> list[Column]:
        return [F.lit(kind).alias("kind"), key.alias("item_key"), position.cast("int").alias("position"), text.alias("text")]

    sections = documents.select("document_id", F.explode("sections").alias("s"))
    return chunks.select(*row("chunk", F.col("chunk_id"), F.col("chunk_index"), F.col("text"))).unionByName(
        sections.select(*row("section", F.col("document_id"), F.col("s.order"), F.col("s.text")))
    )
