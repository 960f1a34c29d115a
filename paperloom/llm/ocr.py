"""Repair of text that came off scanned pages: an averaged-perceptron character editor.

Three perceptrons share one training routine and are fitted on a bounded sample of clean sections
that are made noisy here: a character editor for words (keep, replace, delete, insert), one for
line ends (break, join with a space, join a word over its hyphen sign), and one for lines
(prose, running head, page number, both) with page-position features.
"""

from __future__ import annotations

import random
import re
import textwrap
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.perceptron import Perceptron
from paperloom.llm.words import most_frequent
from paperloom.runtime import durable, map_rows, spread

WORD = re.compile(r"[^\W_]+")
#: Usual confusions of scanners, as printed -> as read.
CONFUSIONS = (
    ("m", "rn"), ("w", "vv"), ("d", "cl"), ("u", "ii"), ("n", "ri"), ("h", "li"), ("k", "lc"), ("rn", "m"), ("cl", "d"), ("vv", "w"),
    ("l", "1"), ("i", "1"), ("o", "0"), ("s", "5"), ("g", "9"), ("z", "2"), ("b", "6"), ("e", "c"), ("c", "e"), ("t", "f"), ("f", "t"),
    ("h", "b"), ("b", "h"), ("a", "á"), ("e", "é"), ("o", "ó"), ("i", "í"), ("u", "ü"), ("i", "l"), ("l", "i"), ("n", "u"), ("u", "n"), ("y", "v"), ("v", "y"), ("q", "g"),
)
HYPHENS = "-­¬‐‑"
#: Bounds of the training sample: documents read, and words of the editor.
SAMPLE_DOCUMENTS, EDITOR_WORDS = 400, 6000
#: The line and line-end models know so many words and compounds, most frequent first; a rarer one
#: counts as unknown there. Which words are repaired doesn't depend on it.
VOCABULARY = 500_000
#: A correction is believed if its word is at least so many times as frequent as what was read; one
#: of two letters without a digit, which other abbreviations resemble, needs more.
RATIO, SHORT_RATIO = 4, 100


_BROKEN = re.compile(rf"(?<=\w)[{HYPHENS}][^\S\n]*\n\s*(?=\w)")


def plain_words(text: str) -> list[str]:
    """Lower-cased runs of letters and digits."""
    return WORD.findall(text.lower())


_SEPARATORS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def whole_words(text: str) -> set[bytes]:
    """Distinct words of a text in UTF-8, those broken at a line end put together again."""
    low = (_BROKEN.sub("", text) if "\n" in text else text).lower()
    found = set(low.encode("utf-8", "surrogatepass").translate(_SEPARATORS).split())
    if low.isascii():
        return found
    odd = [w for w in found if not w.isascii()]  # may hold other signs beyond ASCII
    found.difference_update(odd)
    found.update(x.encode("utf-8", "surrogatepass") for w in odd for x in WORD.findall(w.decode("utf-8", "surrogatepass")))
    return found


def compounds(text: str) -> set[bytes]:
    """Distinct pairs of letter runs around a hyphen, lower-cased."""
    out = set()
    k = text.find("-")
    while k >= 0:
        if 0 < k < len(text) - 1 and text[k - 1].isalpha() and text[k + 1].isalpha():
            i, j = k - 1, k + 2
            while i > 0 and text[i - 1].isalpha():
                i -= 1
            while j < len(text) and text[j].isalpha():
                j += 1
            out.add(text[i:j].lower().encode("utf-8", "surrogatepass"))
        k = text.find("-", k + 1)
    return out


# --- the character editor -----------------------------------------------------------------------


def char_features(word: str, i: int, last: str) -> list[str]:
    """Windows of characters around place ``i`` of a padded word, and the operation before."""
    w = f"^^^{word}$$$$"
    j = i + 3
    c = w[j]
    return [
        "b", "0" + c, "p" + last, "q" + last + c, "a" + w[j - 1 : j + 1], "n" + w[j : j + 2], "t" + w[j - 1 : j + 2], "l" + w[j - 2 : j + 1], "r" + w[j : j + 3],
        "5" + w[j - 2 : j + 3], "L" + w[j - 3 : j + 1], "R" + w[j : j + 4], "7" + w[j - 3 : j + 4],
    ]


def edit(model: Perceptron, word: str, memo: dict[str, str] | None = None) -> str:
    """The word after the editor's operations, from left to right. An operation depends on three
    characters on either side and the one before; ``memo`` remembers it."""
    out, last = [], "K"
    memo = {} if memo is None else memo
    w = f"^^^{word}$$$$"
    for i in range(len(word) + 1):
        seen = f"{w[i : i + 7]}{last}"
        op = memo.get(seen)
        if op is None:
            op = memo[seen] = model.predict(char_features(word, i, last), "K")
        c = word[i] if i < len(word) else ""
        if op[0] == "K":
            out.append(c)
        elif op[0] == "R":
            out.append(op[1:])
        elif op[0] == "I":
            out.append(op[1:] + c)
        last = op
    return "".join(out)


def misread(word: str, rng: random.Random) -> tuple[str, list[str]] | None:
    """A word with one or two confusions and the operations that undo them."""
    places = [(i, a, b) for a, b in CONFUSIONS for i in range(len(word)) if word.startswith(a, i)]
    if not places:
        return None
    chosen = sorted(rng.sample(places, min(len(places), 1 if rng.random() < 0.8 else 2)))
    out, ops, i = "", [], 0
    for at, a, b in chosen:
        if at < i:
            continue
        ops += ["K"] * (at - i)
        out += word[i:at] + b
        if len(a) == 1:
            ops += ["R" + a] + ["D"] * (len(b) - 1)
        else:
            ops += ["R" + a[0]]
        i = at + len(a)
        if len(a) > 1:  # what is missing comes before the next kept character
            ops += ["I" + a[1:]]
            if i < len(word):
                out += word[i]
                i += 1
            else:
                return (out, ops) if out != word else None
    ops += ["K"] * (len(word) - i) + ["K"]
    out += word[i:]
    return (out, ops) if out != word else None


def train_editor(words: list[tuple[str, int]], seed: int = 11) -> Perceptron:
    """The editor, from (word, count) of clean text: each word as it is and misread."""
    rng, examples = random.Random(seed), []
    known = {w for w, _ in words}
    more = min(20, max(1, EDITOR_WORDS // (2 * max(1, len(words)))))  # few words are misread in more ways
    for w, n in words:
        if w.isdigit():
            continue
        for k in range((6 if n > 20 else 2) * more):
            noisy = misread(w, rng) if k % 6 else None
            if noisy and noisy[0] in known:
                continue
            form, ops = noisy or (w, ["K"] * (len(w) + 1))
            last = "K"
            for i, op in enumerate(ops):
                examples.append((char_features(form, i, last), op))
                last = op
    return Perceptron.train(examples, "K", epochs=4)


# --- lines and line ends --------------------------------------------------------------------------


@dataclass
class Paper:
    """What is known of a document beside a line."""

    title: frozenset[str] = frozenset()
    journal: frozenset[str] = frozenset()
    authors: frozenset[str] = frozenset()

    @classmethod
    def of(cls, metadata: dict | None) -> "Paper":
        m = metadata or {}
        names = " ".join(a for a in m.get("authors") or [] if a)
        return cls(frozenset(plain_words(m.get("title") or "")), frozenset(plain_words(m.get("journal") or "")), frozenset(plain_words(names)))


_NUMBER = re.compile(r"^[\s\-–—.\[\](){}|·]*(?:p\.?|pp\.?|pg\.?|page|seite|s)?[\s.]*[a-z]?\d{1,5}(?:\s*(?:of|/|von|de|sur)\s*\d{1,5})?[\s\-–—.\[\](){}|·]*$", re.I)
_SIDE = re.compile(r"^\s*[A-Za-z]?\d{1,5}(?:\s{2,}|\t)\S|\S(?:\s{2,}|\t)[A-Za-z]?\d{1,5}\s*$")
_DIGIT = re.compile(r"\d")
_ETAL = re.compile(r"\bet al\.?", re.I)
_VOLUME = re.compile(r"\b\d{1,4}\s*\(\d{4}\)")
_OF = re.compile(r"\d\s+of\s+\d")
_BULLET = re.compile(r"^\s*(?:[-*•‣–]|\(?\d{1,3}[.)]|\(?[a-z][.)])\s+\S")


def _around(lines: list[str]) -> tuple[list[str], list[str]]:
    """The next line with characters before and after each line ('' for none)."""
    before, after, last = [], [""] * len(lines), ""
    for s in lines:
        before.append(last)
        last = s if s.strip() else last
    last = ""
    for i in range(len(lines) - 1, -1, -1):
        after[i] = last
        last = lines[i] if lines[i].strip() else last
    return before, after


def _char(c: str) -> str:
    return "low" if c.islower() else "up" if c.isupper() else "dig" if c.isdigit() else "sym" if c else "none"


def line_shape(s: str, before: str, after: str, width: int) -> tuple[str, ...]:
    """What is quickly seen of a line: length, in characters and beside the widest, first and last
    character, gaps, and how the lines around it end and begin."""
    core = s.strip()
    n = len(core)
    last = before.rstrip()[-1:]
    return (
        f"n{n if n < 12 else 12 + n // 8 if n < 256 else 99}", f"len{min(9, 10 * n // max(1, width))}", "first" + _char(core[:1]), "second" + _char(core[1:2]), "last" + (core[-1:] if core[-1:] in ".!?;:,-|])" else _char(core[-1:])),
        f"gap{int('  ' in core)}{int(chr(9) in s)}", f"prev{'hyphen' if last and last in HYPHENS else 'stop' if last and last in '.!?:' else 'open'}", "next" + _char(after.lstrip()[:1]),
    )


def masked(line: str) -> bytes:
    """The letters of a line in lower case, as it recurs from page to page."""
    return b" ".join(line.lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split())


@dataclass
class Page:
    """Where a line stands: of how many lines, how often it recurs in its document but for digits,
    and how many lines with characters ago the last furniture was (0: none yet)."""

    lines: int
    again: int = 0
    since: int = 0


def line_features(s: str, i: int, before: str, after: str, blank: tuple[bool, bool], paper: Paper, common: set[bytes] | frozenset[bytes], width: int, page: Page) -> list[str]:
    """Page-position, shape and content features of line ``i`` of its section, the longest of which
    has ``width`` characters; ``blank``: whether the neighbouring lines are."""
    core = s.strip()
    number = len(core) < 40 and _NUMBER.match(core)
    side = ("  " in s or "\t" in s) and _SIDE.search(s)
    ws = plain_words(core)
    alpha = [w for w in ws if not w.isdigit()]
    letters = sum(map(str.isalpha, core))
    upper = sum(map(str.isupper, core)) / letters if letters else 0.0
    share = lambda bag: int(4 * sum(map(bag.__contains__, alpha)) / len(alpha)) if alpha else -1
    known = int(4 * sum(w.encode("utf-8", "surrogatepass") in common for w in alpha) / len(alpha)) if alpha else -1
    first, last = core[:1], before.rstrip()[-1:]
    ends = "hyphen" if last in HYPHENS and last else "stop" if last in ".!?:" and last else "open"
    start = "low" if after.lstrip()[:1].islower() else "up" if after.lstrip()[:1].isupper() else "other"
    f = [
        "b", f"len{min(9, int(10 * len(core) / max(1, width)))}", f"words{min(12, len(alpha))}", f"up{int(upper * 4)}", f"first{'low' if first.islower() else 'up' if first.isupper() else 'dig' if first.isdigit() else 'sym'}",
        f"prev{ends}", f"next{start}", f"flow{ends}{start}", f"blank{int(blank[0])}{int(blank[1])}",
        f"edge{int(not before)}{int(not after)}", f"title{share(paper.title)}", f"journal{share(paper.journal)}", f"author{share(paper.authors)}", f"common{known}",
    ]
    for name, test in (
        ("number", number), ("side", side), ("bullet", _BULLET.match(s)), ("tab", "\t" in s), ("bar", "|" in s), ("slash", " / " in s), ("etal", "al" in core.lower() and _ETAL.search(core)),
        ("volume", "(" in core and _VOLUME.search(core)), ("of", " of " in core and _OF.search(core)), ("stop", core[-1:] in ".!?;:,"), ("dash", " - " in core), ("digit", _DIGIT.search(core)), ("paren", ("(" in core) != (")" in core)),
    ):
        f.append(f"{name}{int(bool(test))}")
    f += [f"w{w}" for w in (alpha[:1] + alpha[-1:])]
    f += [f"x{f[4]}{f[7]}up{int(upper * 4)}", f"y{f[7]}{f[-3]}", f"z{ends}{start}{int(bool(number))}{int(bool(side))}"]
    f.append(f"rest{int(bool(number))}{int(('(' in core) != (')' in core))}{int(before.count('(') > before.count(')'))}{int(core[-1:] in '.,;')}")
    f += [f"at{4 * i // max(1, page.lines)}", f"again{min(3, page.again)}", f"since{0 if not page.since else 1 if page.since < 3 else 2 if page.since < 12 else 3}"]
    return f


def is_page(kind: str) -> bool:
    return kind in ("page", "both")


def is_head(kind: str) -> bool:
    return kind in ("head", "both")


def classify_lines(models: "Models", lines: list[str], paper: Paper, recurring: Counter) -> list[str]:
    """The kind of each line of a section, given how often masked lines recur in its document. The
    gate, a model of the lines' shapes alone, tells which lines are no furniture for sure; the rest
    is scored by the line model. Furniture stands between lines of prose, by its definition."""
    kinds: list[str] = []
    width = max(map(len, lines))
    before, after = _around(lines)
    since = 0
    for i, s in enumerate(lines):
        kind = "prose"
        if s.strip() and models.gate.passes(line_shape(s, before[i], after[i], width)):
            blank = i > 0 and not lines[i - 1].strip(), i + 1 < len(lines) and not lines[i + 1].strip()
            page = Page(len(lines), recurring[masked(s)] - 1 if recurring else 0, since)
            kind = models.lines.predict(line_features(s, i, before[i], after[i], blank, paper, models.common, width, page), "prose")
        since = 1 if kind != "prose" else since + 1 if since and s.strip() else since
        kinds.append(kind)
    prose = [k for k, x in enumerate(kinds) if x == "prose" and lines[k].strip()]
    for i, k in enumerate(kinds):
        if k != "prose" and not (prose and prose[0] < i < prose[-1]):
            kinds[i] = "prose"
    return kinds


def recurring_lines(texts: list[str | None]) -> Counter:
    """How many of a document's section lines of page width are alike but for digits; only of those that recur."""
    c: Counter[bytes] = Counter()
    for t in texts:
        if t and "\n" in t:
            c.update(masked(s) for s in t.split("\n") if 0 < len(s) < 120)
    return Counter({k: n for k, n in c.items() if n > 1 and k})


def break_features(left: str, right: str, common: set[bytes] | frozenset[bytes], hyphenated: set[bytes] | frozenset[bytes]) -> list[str]:
    """Features of the end of line ``left`` before line ``right``."""
    l, r = left.rstrip(), right.lstrip()
    sign = l[-1:] if l[-1:] in HYPHENS else ""
    a = (re.findall(r"[^\W_]+$", l.rstrip(HYPHENS) if sign else l) or [""])[0].lower()
    b = (re.findall(r"^[^\W_]+", r) or [""])[0].lower()
    x, y = a.encode("utf-8", "surrogatepass"), b.encode("utf-8", "surrogatepass")
    known = f"{int(x + y in common)}{int(x in common)}{int(y in common)}{int(x + b'-' + y in hyphenated)}"
    return [
        "b", f"sign{sign}", f"known{known}" if sign else "nosign", f"signknown{'-' if sign == '-' else bool(sign)}{known}" if sign else "nosign2", f"low{int(r[:1].islower())}", f"signlow{bool(sign)}{int(r[:1].islower())}",
        f"stop{int(l[-1:] in '.!?:')}", f"bullet{int(bool(_BULLET.match(right)))}", f"tab{int(chr(9) in left)}{int(chr(9) in right)}", f"empty{int(not l)}{int(not r)}", f"gap{int(l.endswith(' '))}", f"alpha{int(a.isalpha())}{int(b.isalpha())}",
    ]


# --- training -------------------------------------------------------------------------------------


def _furniture(paper: dict, rng: random.Random, page: int) -> tuple[str, str]:
    """An invented head or page number of a paper, and its kind."""
    title, journal = (paper.get("title") or "A study of animals").split(), paper.get("journal") or "Journal of Studies"
    names = [a.split()[-1] for a in paper.get("authors") or [] if a and a.split()] or ["Author"]
    who = names[0] if len(names) == 1 else f"{names[0]} and {names[1]}" if len(names) == 2 else f"{names[0]} et al."
    short = " ".join(title[: rng.randint(3, 5)])
    head = rng.choice([
        f"{short} | {journal.upper()}", f"{journal} {rng.randint(1, 90)} ({rng.randint(1980, 2024)})", f"{who} / {journal}", who.upper(), short.upper(), f"{who}: {short}", journal.upper(), f"{journal} | {who}",
        f"Downloaded copy - {who} - reading room use only", f"Downloaded from {journal} - for personal use only", f"{who} - {short}",
    ])
    number = rng.choice([f"{page}", f"- {page} -", f"[{page}]", f"p. {page}", f"S{page}", f"{page}.", f"Page {page} of {page + rng.randint(1, 40)}", f"– {page} –", f"({page})"])
    kind = rng.choice(["head", "head", "page", "page", "both"])
    if kind == "both":
        n = rng.choice([f"{page}", f"S{page}"])
        return rng.choice([f"{n}    {head}", f"{head}    {n}"]), kind
    return (head, kind) if kind == "head" else (number, kind)


def _wrapped(paragraph: str, rng: random.Random, hyphens: bool) -> list[tuple[str, str]]:
    """A paragraph cut into lines, each with how it goes on: space, join, keep (a compound's own hyphen)."""
    width = rng.randint(50, 90)
    sign = rng.choice("---­¬‐")
    out: list[tuple[str, str]] = []
    line = ""
    for word in paragraph.split():
        if len(line) + 1 + len(word) <= width or not line:
            line = f"{line} {word}" if line else word
            continue
        room = width - len(line) - 2
        core = word.strip(".,;:()")
        if "-" in core and 2 < word.find("-") < room:
            k = word.find("-") + 1
            out.append((f"{line} {word[: k - 1]}{sign}", "join") if hyphens and sign != "-" else (f"{line} {word[:k]}", "keep"))  # another sign is the scanner's
            line = word[k:]
        elif hyphens and core == word and word.isalpha() and len(word) > 5 and room >= 3 and rng.random() < 0.7:
            k = rng.randint(2, max(2, min(room, len(word) - 2)))
            out.append((f"{line} {word[:k]}{sign}", "join"))
            line = word[k:]
        else:
            out.append((line, "space"))
            line = word
    out.append((line, "break"))
    return out


class Gate:
    """A perceptron over line shapes that lets through whatever may be furniture: all that scores at
    least as high as the least likely furniture of its training, less a margin."""

    def __init__(self, examples: list[tuple[tuple[str, ...], str]], margin: float = 1.0):
        self.model = Perceptron.train([(list(f), "prose" if k == "prose" else "page") for f, k in examples], "prose", 4)
        scored = [self._score(f) for f in {f for f, k in examples if k != "prose"}]
        self.least = min(scored, default=0.0) - margin
        self.memo: dict[tuple[str, ...], bool] = {}

    def _score(self, shape: tuple[str, ...]) -> float:
        s = self.model.scores(shape)
        return s.get("page", 0.0) - s.get("prose", 0.0)

    def passes(self, shape: tuple[str, ...]) -> bool:
        hit = self.memo.get(shape)
        if hit is None:
            if len(self.memo) > 200_000:
                self.memo.clear()
            hit = self.memo[shape] = self._score(shape) >= self.least
        return hit


@dataclass
class Models:
    """What the tasks need: the four models and the bounded word lists."""

    editor: Perceptron
    gate: Gate
    lines: Perceptron
    breaks: Perceptron
    common: frozenset[bytes] = field(default_factory=frozenset)
    hyphenated: frozenset[bytes] = field(default_factory=frozenset)


def _noisy_section(metadata: dict, paragraphs: list[str], rng: random.Random, heads: list[tuple[str, str]]) -> tuple[list[str], list[str], list[str | None]]:
    """Lines of a section as a scanner may leave them, with each line's kind and how it goes on."""
    noisy = rng.random() < 0.7
    lines, kinds, ends = [], [], []
    page = rng.randint(1, 600)

    def put(line: str, kind: str, end: str | None) -> None:
        lines.append(line)
        kinds.append(kind)
        ends.append(end)

    for p in paragraphs:
        for line, end in _wrapped(re.sub(r"\s+", " ", p), rng, noisy):
            if noisy and lines and rng.random() < 0.15:
                for _ in range(rng.choice([1, 1, 2])):
                    extra, kind = rng.choice(heads) if heads and rng.random() < 0.3 else _furniture(metadata, rng, page)
                    if kind == "head":
                        heads.append((extra, kind))
                    pad = rng.random() < 0.3
                    for x, k in [("", "blank")] * pad + [(extra, kind)] + [("", "blank")] * pad:
                        put(x, k, None)
                page += 1
            put(line, "prose", end)
        if rng.random() < 0.3:
            for _ in range(rng.randint(2, 4)):
                name = rng.choice(metadata.get("authors") or ["Group"]) or "Group"
                put(rng.choice([f"{name}\t{rng.random() * 9:.2f}\t{rng.randint(1, 500)}", f"- {p[:60]}", f"{rng.randint(1, 9)}. {p[:50]}", f"{rng.randint(10, 999)} {p[:50]}"]), "prose", "break")
        if rng.random() < 0.3:  # the last line of a paragraph may be the end of a bracket
            n = rng.choice([f"{rng.randint(2, 999)}", f"{rng.random():.3f}", f"{rng.random() * 90:.2f}"])
            a, b = rng.choice([("Taken together, groups were much alike (n =", f"{n})."), ("There was no difference between breeds (p =", f"{n})."), ("The effect was small (95% CI 0.51-", f"{n}).")])
            put(a, "prose", "space")
            put(b, "prose", "break")
        if rng.random() < 0.3:  # paragraphs that no page's width has cut
            put(re.sub(r"\s+", " ", p), "prose", "break")
        put("", "blank", None)
    if rng.random() < 0.4:
        lines = [_blur(x, rng) for x in lines]
    return lines, kinds, ends


def train_models(papers: list[tuple[dict | None, list[str]]], words: list[tuple[str, int]], hyphenated: set[bytes], seed: int = 5) -> Models:
    """Fit on clean sections (metadata, texts) made noisy here, and on words with their counts."""
    rng = random.Random(seed)
    common = frozenset(w.encode("utf-8", "surrogatepass") for w, _ in words)
    shapes, found, break_examples = [], [], []
    for metadata, texts in papers:
        paper = Paper.of(metadata if rng.random() < 0.8 else None)
        heads: list[tuple[str, str]] = []
        sections = [_noisy_section(metadata or {}, ps, rng, heads) for t in texts[:3] if (ps := [p for p in re.split(r"\n\s*\n", t) if len(p) > 200][:2])]
        recurring = recurring_lines(["\n".join(lines) for lines, _, _ in sections])
        for lines, kinds, ends in sections:
            width, (before, after), since = max(map(len, lines)), _around(lines), 0
            for i, k in enumerate(kinds):
                if k == "blank":
                    continue
                shape = line_shape(lines[i], before[i], after[i], width)
                blank = i > 0 and not lines[i - 1].strip(), i + 1 < len(lines) and not lines[i + 1].strip()
                shapes.append((shape, k))
                found.append((shape, (lines[i], i, before[i], after[i], blank, paper, common, width, Page(len(lines), recurring[masked(lines[i])] - 1 if recurring else 0, since)), k))
                since = 1 if k != "prose" else since + 1 if since else 0
            prose = [(lines[i], ends[i]) for i, k in enumerate(kinds) if k == "prose"]
            break_examples += [(break_features(a, b, common, hyphenated), end) for (a, end), (b, _) in zip(prose, prose[1:]) if end]
    gate = Gate(shapes)
    line_examples = [(line_features(*x), k) for shape, x, k in found if gate.passes(shape)]
    return Models(train_editor(words[:EDITOR_WORDS]), gate, Perceptron.train(line_examples, "prose", 6), Perceptron.train(break_examples, "space", 6), common, frozenset(hyphenated))


def _blur(line: str, rng: random.Random) -> str:
    if rng.random() < 0.6:
        return line
    ws = line.split(" ")
    k = rng.randrange(len(ws))
    noisy = misread(ws[k], rng) if ws[k].isalpha() else None
    if noisy:
        ws[k] = noisy[0]
    return " ".join(ws)


# --- operators ------------------------------------------------------------------------------------


def _rows(df: DataFrame) -> DataFrame:
    return df.where("document_id is not null and size(sections) > 0").select("document_id", F.struct("metadata.title", "metadata.journal", "metadata.authors").alias("metadata"), F.expr("transform(sections, s -> struct(s.order as o, s.text as t))").alias("sections"))


_WRAPPED = re.compile(r"[^\n]\n[^\n]")


def word_counts(df: DataFrame) -> DataFrame:
    """(word, n, clean): in how many section texts each word and each hyphenated compound stands, and
    in how many of those without single line breaks, which no scanner left; counts are summed per
    task first."""

    def batch_of(clean: Counter, wrapped: Counter) -> pa.RecordBatch:
        every = list(clean.keys() | wrapped.keys())
        return pa.RecordBatch.from_pydict({"word": pa.array([w.decode("utf-8", "replace") for w in every], type=pa.string()), "n": pa.array([clean[w] + wrapped[w] for w in every], type=pa.int64()), "clean": pa.array([clean[w] for w in every], type=pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clean: Counter[bytes] = Counter()
        wrapped: Counter[bytes] = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    counter = wrapped if "\n" in t and _WRAPPED.search(t) else clean
                    counter.update(whole_words(t))
                    counter.update(compounds(t))
            if len(clean) + len(wrapped) > 300_000:
                yield batch_of(clean, wrapped)
                clean, wrapped = Counter(), Counter()
        yield batch_of(clean, wrapped)

    texts = df.select(F.explode("sections").alias("s")).select("s.text").where("text is not null")
    return spread(texts).mapInArrow(run, "word string, n bigint, clean bigint").groupBy("word").agg(F.sum("n").alias("n"), F.sum("clean").alias("clean"))


def fit(df: DataFrame, counts: DataFrame) -> Models:
    """Models from a bounded sample: the clean sections of the SAMPLE_DOCUMENTS documents least by
    hash; with the VOCABULARY most frequent words and compounds of all."""
    clean = F.expr("transform(filter(sections, s -> s.text is not null and length(s.text) > 200 and not s.text rlike '[^\\\\n]\\\\n[^\\\\n]'), s -> s.text)")
    # the least hashes first, so that texts are read, and sent to the driver, of the sample only
    least = df.where("size(sections) > 1").select(F.xxhash64("document_id").alias("h")).distinct().orderBy("h").limit(SAMPLE_DOCUMENTS)
    chosen = df.select(F.xxhash64("document_id").alias("h"), "metadata", "sections").join(F.broadcast(least), "h").dropDuplicates(["h"])
    sample = chosen.select("h", F.struct("metadata.title", "metadata.journal", "metadata.authors").alias("metadata"), F.slice(clean, 1, 3).alias("texts")).where("size(texts) > 0")
    rows = sample.orderBy("h").collect()
    papers = [(r["metadata"].asDict() if r["metadata"] else None, list(r["texts"])) for r in rows]
    # words of clean sections; where all were scanned, of all, but for the rare ones (misread forms are)
    some = counts.where("clean > 1").limit(1).count() > 0
    by = "clean" if some else "n"
    kept = [(r["word"], r[by]) for r in most_frequent(counts, by, VOCABULARY).select("word", by).collect()]
    floor = 2 if some else max(2, sum(n for _, n in kept) // 200_000)
    kept = sorted(((w, n) for w, n in kept if n >= floor or "-" in w), key=lambda x: (-x[1], x[0]))
    return train_models(papers, [x for x in kept if "-" not in x[0]], {w.encode("utf-8", "surrogatepass") for w, _ in kept if "-" in w})


def corrections(counts: DataFrame, models: Models) -> DataFrame:
    """(word, repaired): words that the editor changes into a much more frequent word, in clean
    sections too, or whose letters it frees from digits. Words with a digit at either end only
    (``s42``) are no words, single characters aren't judged, two letters without a digit only
    against a far more frequent word."""
    shared = counts.sparkSession.sparkContext.broadcast(models.editor.weights)
    rare = counts.where("length(word) > 1 and not word rlike '^[0-9]+$|-'")
    memo: dict[str, str] = {}  # each task has its own

    def run(cols: dict[str, list]) -> dict[str, list]:
        editor = Perceptron(shared.value)
        if len(memo) > 500_000:
            memo.clear()
        out: dict[str, list] = {"word": [], "n": [], "clean": [], "repaired": []}
        for w, n, c in zip(cols["word"], cols["n"], cols["clean"]):
            fixed = edit(editor, w, memo)
            if fixed != w and fixed:
                for k, v in (("word", w), ("n", n), ("clean", c), ("repaired", fixed)):
                    out[k].append(v)
        return out

    spread = rare.repartition(int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "word")
    changed = map_rows(spread, "word string, n bigint, clean bigint, repaired string", run)
    known = counts.select(F.col("word").alias("repaired"), F.col("n").alias("m"), F.col("clean").alias("mc"))
    judged = changed.join(known, "repaired", "left")
    freed = F.col("word").rlike("[a-zà-ÿ][0-9]+[a-zà-ÿ]|^[0-9][a-zà-ÿ]{3,}") & ~F.col("repaired").rlike("[0-9]")
    ratio = F.when((F.length("word") > 2) | F.col("word").rlike("[0-9]"), RATIO).otherwise(SHORT_RATIO)
    more = (F.col("m") >= ratio * F.col("n")) & (F.col("mc") >= ratio * F.col("clean"))
    return judged.where(more | (F.col("m").isNull() & freed & (F.length("word") > 3))).select("word", "repaired")


def _never_repaired(models: Models, fixes: DataFrame) -> frozenset[bytes]:
    """The models' words but for those that are repaired: they needn't be looked up text by text."""
    shared = fixes.sparkSession.sparkContext.broadcast(models.common)
    both = map_rows(fixes.select("word"), "word string", lambda c: {"word": [w for w in c["word"] if w.encode("utf-8", "surrogatepass") in shared.value]})
    return models.common - {r["word"].encode("utf-8", "surrogatepass") for r in both.collect()}


def _signs(lines: list[str], kinds: list[str], models: Models) -> bool:
    prose = [s for s, k in zip(lines, kinds) if k == "prose" and s.strip()]
    for a, b in zip(prose, prose[1:]):
        if a.rstrip()[-1:] in HYPHENS and b.lstrip()[:1].isalnum():
            if models.breaks.predict(break_features(a, b, models.common, models.hyphenated), "space") == "join":
                return True
    return False


def scan_noise(df: DataFrame) -> DataFrame:
    """(document_id, section_order, noise): the kinds of scan noise of each section.

    hyphen: the line-end model joins a word over its hyphen sign; running_head and page_number:
    the line model takes a line between lines of prose for furniture; misread: a word that the
    character editor repairs. Two passes over the texts: word counts (summed per task before the
    shuffle), then lines and rare words; repairs are decided once per distinct word and joined.

    NULL sections, texts and document ids give nothing; a NULL order stays NULL; repeated rows
    count once.
    """
    spark = df.sparkSession
    counts = durable(word_counts(df))
    models = fit(df, counts)
    fixes = durable(corrections(counts, models))
    shared = spark.sparkContext.broadcast((models, _never_repaired(models, fixes)))

    def run(cols: dict[str, list]) -> dict[str, list]:
        m, skip = shared.value
        out: dict[str, list] = {"document_id": [], "o": [], "noise": [], "word": []}

        def add(d: str, o: int | None, noise: str | None, word: str | None) -> None:
            for k, v in (("document_id", d), ("o", o), ("noise", noise), ("word", word)):
                out[k].append(v)

        for d, metadata, sections in zip(cols["document_id"], cols["metadata"], cols["sections"]):
            paper = None
            for s in sections:
                if not s or not s["t"]:
                    continue
                t, o = s["t"], s["o"]
                for w in whole_words(t) - skip:
                    if len(w) > 1 and not w.isdigit():
                        add(d, o, None, w.decode("utf-8", "replace"))
                if "\n" not in t:
                    continue
                if paper is None:
                    paper, recurring = Paper.of(metadata), recurring_lines([x["t"] for x in sections if x])
                lines = t.split("\n")
                kinds = classify_lines(m, lines, paper, recurring)
                if any(map(is_head, kinds)):
                    add(d, o, "running_head", None)
                if any(map(is_page, kinds)):
                    add(d, o, "page_number", None)
                if _signs(lines, kinds, m):
                    add(d, o, "hyphen", None)
        return out

    seen = durable(map_rows(spread(_rows(df)), "document_id string, o int, noise string, word string", run))
    bad = seen.where("word is not null").join(fixes.select("word"), "word", "left_semi").select("document_id", "o", F.lit("misread").alias("noise"))
    return seen.where("noise is not null").select("document_id", "o", "noise").union(bad).distinct().select("document_id", F.col("o").alias("section_order"), "noise")


def repair_sections(df: DataFrame) -> DataFrame:
    """(document_id, section_order, text, repaired): each section's text as continuous paragraphs.

    Furniture lines go, lines are joined as the line-end model says (with a space, over a hyphen
    sign, or keeping a compound's own hyphen), words get the editor's repairs. Blank lines, tables
    and lists keep their lines. Texts without noise come out as they are, NULL texts as NULL;
    repeated rows stay. The repairs of a section travel to it as a map of its own words only.
    """
    counts = durable(word_counts(df))
    models = fit(df, counts)
    fixes = durable(corrections(counts, models))
    shared = df.sparkSession.sparkContext.broadcast((models, _never_repaired(models, fixes)))

    def recur(cols: dict[str, list]) -> dict[str, list]:
        return cols | {"recurring": [list(recurring_lines([s["t"] for s in x if s]).items()) for x in cols["sections"]]}

    section = "struct<o:int,t:string>"
    rows = map_rows(_rows(df), f"document_id string, metadata struct<title:string,journal:string,authors:array<string>>, sections array<{section}>, recurring map<binary,bigint>", recur)
    base = durable(rows.select("document_id", "metadata", "recurring", F.posexplode("sections").alias("at", "s")).select("document_id", "metadata", "recurring", "at", F.col("s.o").alias("o"), F.col("s.t").alias("t"), F.xxhash64("document_id", "s.t").alias("h")))

    def rare(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"h": [], "word": []}
        for h, t in zip(cols["h"], cols["t"]):
            for w in whole_words(t) - shared.value[1]:
                out["h"].append(h)
                out["word"].append(w.decode("utf-8", "replace"))
        return out

    own = map_rows(base.where("t is not null").select("h", "t").dropDuplicates(["h"]), "h bigint, word string", rare).join(fixes, "word").groupBy("h").agg(F.map_from_entries(F.collect_set(F.struct("word", "repaired"))).alias("fixes"))

    def run(cols: dict[str, list]) -> dict[str, list]:
        fixed = [repair_text(t, dict(f or []), Paper.of(md), shared.value[0], Counter(dict(r or []))) for t, md, f, r in zip(cols["t"], cols["metadata"], cols["fixes"], cols["recurring"])]
        return {"document_id": cols["document_id"], "o": cols["o"], "t": cols["t"], "repaired": fixed}

    joined = base.join(own, "h", "left").select("document_id", "o", "t", "metadata", "fixes", "recurring")
    out = map_rows(joined, "document_id string, o int, t string, repaired string", run)
    return out.select("document_id", F.col("o").alias("section_order"), F.col("t").alias("text"), "repaired")


def repair_text(text: str | None, fixes: dict[str, str], paper: Paper, models: Models, recurring: Counter) -> str | None:
    """One repaired text."""
    if not text:
        return text
    lines = text.split("\n")
    kinds = classify_lines(models, lines, paper, recurring) if len(lines) > 1 else ["prose"] * len(lines)
    removed = [k != "prose" for k in kinds]
    kept = []
    for i, s in enumerate(lines):  # a blank line beside furniture is the page's, not a paragraph's
        if removed[i] or not s.strip() and any(removed[k] for k in (i - 1, i + 1) if 0 <= k < len(lines)):
            continue
        kept.append(s)
    out = kept[0] if kept else ""
    for a, b in zip(kept, kept[1:]):
        how = "break" if not a.strip() or not b.strip() else models.breaks.predict(break_features(a, b, models.common, models.hyphenated), "space")
        if how == "join":
            out = out.rstrip().rstrip(HYPHENS) + b.lstrip()
        elif how == "keep":
            out = out.rstrip() + b.lstrip()
        else:
            out = out.rstrip() + " " + b.lstrip() if how == "space" else out.rstrip(" \t") + "\n" + b
    if not fixes:
        return out

    def fix(m: re.Match) -> str:
        new = fixes.get(m[0].lower())
        return m[0] if new is None else new.upper() if m[0].isupper() and len(m[0]) > 1 else new.capitalize() if m[0][:1].isupper() else new

    return WORD.sub(fix, out)
