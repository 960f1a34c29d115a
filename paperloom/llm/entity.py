"""Matching records of two sources without a common key, by loopy belief propagation."""

from __future__ import annotations

import math
import re
import unicodedata
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.words import most_frequent
from paperloom.runtime import durable, map_rows

#: Title words of the keyed side to which misspelt ones are led back, most frequent first (an aid to
#: spelling: to rarer words nothing is led back), and those whose number of titles is known, as hashes.
SPELLING, KNOWN_WORDS = 20_000, 2_000_000
#: With more surnames than these, names don't help to tell early that two records can't match.
SURNAMES = 50_000
#: A word in more than this share of the titles tells nothing and makes no key.
COMMON_SHARE = 0.08
#: A title's keys are sets of KEY_SIZE of any KEY_SPAN rarer words in a row.
KEY_SPAN, KEY_SIZE = 7, 4
#: What shared keys must count together.
MEET = 60
#: A candidate below this log-odds is no match (messages only lower it) and weighs less than
#: 0.0001 on the odds of others: it takes no part.
FLOOR = -10.0
#: Messages count as settled when none moves by more; damping grows until they are.
TOLERANCE, MOST_ROUNDS = 1e-3, 100
#: The most that titles speak for a match.
TITLE_MOST = 13.0
#: What a known title word costs that only the noisier title has.
ODD_WORD = 3.5
#: English function words, which styles and typing leave out.
FUNCTION_WORDS = frozenset("a an the of on in at by to for from with and or as is are does do how during after".split())
FIELDS = "title string, authors array<string>, doi string, journal string, date string"


def fold(text: str | None) -> str:
    """Lower case without accents, compatibility forms resolved."""
    t = unicodedata.normalize("NFKD", text or "").lower()
    return "".join(c for c in t if not unicodedata.combining(c))


def title_words(text: str | None) -> list[str]:
    """Words of a title, bracketed remarks like [abstract] or (preprint) left out."""
    t = re.sub(r"[\[(](?:abstract|preprint|article|full text|pdf|online|poster)[\])]", " ", fold(text))
    t = re.sub(r"\bbehavior", "behaviour", t).replace("&", " and ")
    return re.findall(r"[^\W_]+", t)


def clean_doi(text: str | None) -> str:
    """A DOI without address, label, case and closing marks; empty if there is none."""
    t = re.sub(r"\s+", "", (text or "").lower())
    m = re.search(r"10\.\d{3,}/\S+", t)
    return m[0].rstrip(".,;") if m else ""


def doi_keys(doi: str) -> list[str]:
    """The DOI and each form of it with one character of its last number unknown."""
    m = re.search(r"[^./-]*$", doi)
    if not doi or not m:
        return []
    a = m.start()
    return [doi, *(f"{doi[:i]}?{doi[i + 1 :]}" for i in range(a, len(doi)))]


def compare_doi(a: str, b: str) -> float:
    """Log-odds of two DOIs: equal, equal but for one misread digit, or different."""
    if not a or not b:
        return 0.0
    if a == b:
        return 14.0
    if len(a) == len(b):
        off = [(x, y) for x, y in zip(a, b) if x != y]
        if len(off) == 1 and off[0][0].isdigit() != off[0][1].isdigit():
            return 5.0
    return -8.0


def claim(a: str, b: str) -> str | None:
    """What ``a`` says a work's DOI is: that of ``b`` if it may be meant; nothing if it is misread."""
    if not a or compare_doi(a, b) > 0:
        return b if a else None
    last = re.search(r"[^./-]*$", a)
    return None if last and re.search(r"\D", last[0]) else a


def years(text: str | None) -> list[int]:
    """Years in a date of any style."""
    return [int(y) for y in re.findall(r"(?<!\d)(?:18|19|20)\d\d(?!\d)", text or "")]


def name_tokens(authors: list[str] | None) -> list[list[str]]:
    """Name parts of each author of at least two letters, 'et al.' left out."""
    out = []
    for a in authors or []:
        for one in re.split(r";", a or ""):
            ws = [w for w in re.findall(r"[^\W\d_]+", fold(one)) if len(w) > 1 and w not in ("et", "al")]
            if ws:
                out.append(ws)
    return out


def near(a: str, b: str) -> bool:
    """Equal, or one edit (swap included) apart in words of at least five letters."""
    if a == b:
        return True
    if min(len(a), len(b)) < 5 or abs(len(a) - len(b)) > 1:
        return False
    p = 0
    while p < min(len(a), len(b)) and a[p] == b[p]:
        p += 1
    x, y = a[p:], b[p:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or x[:2] == y[1::-1] and x[2:] == y[2:]


def _journal_words(text: str | None) -> list[str]:
    return [w for w in re.findall(r"[^\W_]+", fold(text)) if w not in ("of", "the", "and", "for")]


def journal_agrees(a: str | None, b: str | None) -> bool | None:
    """Whether two journal names agree in full or by the beginnings of their words; None if one is missing."""
    x, y = _journal_words(a), _journal_words(b)
    if not x or not y:
        return None
    if len(x) != len(y):
        x, y = (x, y) if len(x) < len(y) else (y, x)
        return all(any(w.startswith(v[:3]) for w in y) for v in x)
    return all(v.startswith(w[:3]) or w.startswith(v[:3]) for v, w in zip(x, y))


def word_hash(w: str) -> int:
    """The engine's own 64-bit hash of a word."""
    h = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), seed=42)
    return h - (1 << 64) if h >> 63 else h


def _cuts(w: str) -> list[str]:
    """A word and, if it has more than three letters, the word with each letter left out."""
    return [w, *dict.fromkeys(w[:i] + w[i + 1 :] for i in range(len(w)))] if len(w) > 3 else [w]


class Titles:
    """In how many titles each word stands, and where misspelt words are led back to."""

    def __init__(self, spelling: dict[str, int], hashes: np.ndarray, counts: np.ndarray, total: int):
        self.spelling, self.total = spelling, max(1, total)
        self.prior = -math.log(self.total + 1) - 1.0
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]
        self.deletes: dict[str, set[str]] = {}
        for w in spelling:
            for k in _cuts(w):
                self.deletes.setdefault(k, set()).add(w)
        self.memo: dict[str, str] = {}
        self.seen: dict[str, int] = {}

    def df(self, w: str) -> int:
        """In how many titles the word stands; 0 if it is unknown."""
        n = self.seen.get(w)
        if n is None:
            if len(self.seen) > 200_000:
                self.seen.clear()
            h = word_hash(w)
            k = int(np.searchsorted(self.hashes, h))
            n = self.seen[w] = int(self.counts[k]) if k < len(self.hashes) and self.hashes[k] == h else 0
        return n

    def canonical(self, w: str) -> str:
        """The spelling word within one edit of an unknown word, else the word."""
        if self.df(w):
            return w
        hit = self.memo.get(w)
        if hit is None:
            found = {x for k in _cuts(w) for x in self.deletes.get(k, ())}
            hit = max(found, key=lambda x: (self.spelling[x], x)) if found else w
            if len(self.memo) > 200_000:
                self.memo.clear()
            self.memo[w] = hit
        return hit

    def words(self, title: str | None) -> list[str]:
        """Canonical words of a title; two words of which a blank was misplaced are set right."""
        ws = title_words(title)
        out: list[str] = []
        i = 0
        while i < len(ws):
            w = ws[i]
            if not self.df(w) and i + 1 < len(ws) and not self.df(ws[i + 1]):
                nxt = ws[i + 1]
                for a, b in ((w + nxt[:1], nxt[1:]), (w[:-1], w[-1:] + nxt)):
                    if self.df(a) and self.df(b):
                        out += [a, b]
                        i += 2
                        break
                else:
                    out.append(self.canonical(w))
                    i += 1
                continue
            if not self.df(w) and self.canonical(w) == w and len(w) > 4:  # two words run together, with or without a stray letter
                cut = next(((w[:k], w[k + g :]) for g in (0, 1) for k in range(1, len(w) - 1) if self.df(w[:k]) and self.df(w[k + g :])), None)
                out += list(cut) if cut else [w]
            else:
                out.append(self.canonical(w))
            i += 1
        return out

    def content(self, words: list[str]) -> list[str]:
        """The words that are rare enough to tell titles apart, each once, in order."""
        return [w for w in dict.fromkeys(words) if self.df(w) <= max(2, COMMON_SHARE * self.total)]

    def rarity(self, w: str) -> float:
        """Log of the inverse share of titles that have the word."""
        return math.log(self.total / min(self.total, max(1, self.df(w))))

    def compare(self, a: list[str], b: list[str]) -> float:
        """Log-odds of two titles (``a`` the noisier): the rarity of the words they share in order,
        against words that only one has. Function words weigh little, a missing end (a shortened
        title) little, other known words that one lacks or that stand elsewhere weigh most."""
        if not a or not b:
            return 0.0
        taken, seen, place = [False] * len(b), 0.0, -1
        odd, moved = [], 0
        for w in a:
            k = next((i for i in range(place + 1, len(b)) if not taken[i] and b[i] == w), None)
            if k is None:
                k = next((i for i in range(len(b)) if not taken[i] and b[i] == w), None)
                moved += k is not None and w not in FUNCTION_WORDS
            if k is None:
                odd.append(w)
                continue
            taken[k] = True
            place = k if k > place else place
            seen += self.rarity(w)
        left = [i for i in range(len(b)) if not taken[i]]
        if "".join(odd) == "".join(b[i] for i in left):  # split or joined words only
            odd, left = [], []
        alike: dict[str, list[int]] = {}  # words one edit apart have a cut in common
        for i in left if odd else ():
            for k in _cuts(b[i]):
                alike.setdefault(k, []).append(i)
        for w in list(odd) if alike else ():
            i = min((i for k in _cuts(w) for i in alike.get(k, ()) if i in left and near(w, b[i])), default=None)
            if i is not None:
                odd.remove(w)
                left.remove(i)
                seen += 0.5 * self.rarity(b[i])
                moved += 0.4 * bool(self.df(w) and self.df(b[i]))
        known = sum(1.0 for w in odd if self.df(w) and w not in FUNCTION_WORDS)
        other = len(odd) - known
        tail = 0
        while left and left[-1] == len(b) - 1 - tail:
            left.pop()
            tail += 1
        inner = sum(0.4 if b[i] in FUNCTION_WORDS else 2.5 for i in left) * (0.5 if other else 1.0)
        return min(TITLE_MOST, 0.55 * seen) - ODD_WORD * known - 1.0 * other - inner - 2.0 * moved - (0.4 + 0.12 * tail if tail else 0.0)


class Record:
    """What comparisons need of one record, worked out once."""

    __slots__ = ("doi", "words", "surnames", "tokens", "years", "journal")

    def __init__(self, title: str | None, authors: list[str] | None, doi: str | None, journal: str | None, date: str | None, titles: Titles):
        self.doi, self.words, self.years = clean_doi(doi), titles.words(title), years(date)
        names = name_tokens(authors)
        self.surnames, self.tokens = [one[-1] for one in names], [frozenset(one) for one in names]
        self.journal = journal


def score(a: Record, b: Record, titles: Titles) -> float:
    """Log-odds that two records describe one work; ``a`` is the noisier one. The prior is one in
    all works. Titles, which cost most, aren't compared where even equal ones would change nothing."""
    total = titles.prior + compare_doi(a.doi, b.doi)
    x, y = a.tokens, b.surnames
    if x and y:
        ys = set(y)
        hits = sum(bool(one & ys) or any(near(t, n) or len(n) > 4 and n in t for t in one for n in y) for one in x)
        total += min(6.0, 4.0 + 1.0 * (hits - 1)) - 1.0 * (len(x) - hits) if hits else -5.0
        if hits and len(x) != len(y) and len(x) == hits:
            total -= 0.2
    if a.years and b.years:
        gap = abs(a.years[-1] - b.years[-1])
        total += 2.2 if gap == 0 else -0.7 if gap == 1 else -3.5
    j = journal_agrees(a.journal, b.journal)
    if j is not None:
        total += 1.5 if j else -2.0
    if total + TITLE_MOST <= FLOOR:
        return total
    return total + max(-14.0, titles.compare(a.words, b.words))


def _keys(record: tuple, titles: Titles, noisy: bool) -> list[tuple[int, str]]:
    """Blocking keys with what a match in each counts; records meet if all they share count MEET.

    A DOI, a short title, or author and year where either side has no title words are enough. Of
    keys of author, year and title word three are needed (one, if the title has fewer than four
    rarer words); of sets of four out of seven title words in a row two, which is five words, and
    six in titles of more than seven rarer words; one, if there are at most five of them and the
    record has neither DOI nor author and year.
    """
    doi, ys = clean_doi(record[2]), years(record[4])[-1:]
    out = [(MEET, f"d{k}") for k in doi_keys(doi)]
    names = {t for one in name_tokens(record[1]) for t in (one if noisy else one[-1:]) if len(t) > 2}
    content = titles.content(titles.words(record[0]))
    born = [f"a{n}{y + d}" for n in names for y in ys for d in ((-1, 0, 1) if noisy else (0,))]
    out += [(MEET // (1 if len(content) < 4 else 3), f"{k} {w}") for k in born for w in content]
    out += [(MEET, f"{side}{k}") for side, own in (("left", noisy), ("right", not noisy)) if own or not content for k in born]  # the other side has no title words
    sets = 6 if len(content) > KEY_SPAN else 1 if len(content) <= KEY_SIZE + 1 and not doi and not born else 2
    for at in range(max(1, len(content) - KEY_SPAN + 1)):
        span = content[at : at + KEY_SPAN]
        if len(span) >= KEY_SIZE:
            out += [(MEET // sets, "t" + " ".join(sorted(c))) for c in combinations(span, KEY_SIZE) if at == 0 or span[-1] in c]
    sizes = (len(content),) if noisy and len(content) <= KEY_SIZE else () if noisy else range(2, KEY_SIZE + 1)
    out += [(MEET, "p" + " ".join(sorted(content[:k]))) for k in sizes if 1 < k <= len(content)]
    return list(dict.fromkeys(out))


class Signer:
    """Signatures of records, of which ``hopeful`` tells whether two can match."""

    def __init__(self, titles: Titles, surnames: list[str] | None):
        """``surnames``: all of the keyed side; None if they are too many to be listed."""
        self.titles, self.surnames = titles, None if surnames is None else set(surnames)
        self.deletes: dict[str, list[str]] = {}
        for n in surnames or ():
            for k in _cuts(n):
                self.deletes.setdefault(k, []).append(n)
        self.memo: dict[tuple[str, str], int | frozenset[int]] = {}

    def _once(self, kind: str, w: str, fn):
        hit = self.memo.get((kind, w))
        if hit is None:
            if len(self.memo) > 200_000:
                self.memo.clear()
            hit = self.memo[kind, w] = fn(w)
        return hit

    def _like(self, w: str) -> int:
        """Bits of a keyed title's word and of all listed words that may stand for it or its halves."""
        listed = self.titles.spelling
        out = {w, *(x for k in _cuts(w) for x in self.titles.deletes.get(k, ()) if near(w, x))}
        out |= {x for k in range(1, len(w)) if w[:k] in listed and w[k:] in listed for x in (w[:k], w[k:])}
        return sum({_bit(x) for x in out - FUNCTION_WORDS})

    def _surnames(self, token: str) -> frozenset[int]:
        """Signatures of the surnames that a part of a name equals, nearly equals or contains."""
        out = {token, *(n for k in _cuts(token) for n in self.deletes.get(k, ()))}
        out |= {token[i:j] for i in range(len(token)) for j in range(i + 5, len(token) + 1)}
        return frozenset(map(_number, out & self.surnames))

    def sign(self, record: tuple, noisy: bool) -> tuple[int, list[int], int]:
        """(words, names, facts): a bit for each title word, numbers of surnames, and packed: year, both
        halves of the DOI, that there are no names, what they add at most, that there is no title, a bit
        for each initial of the journal."""
        words, parts = self.titles.words(record[0]), name_tokens(record[1])
        bits = 0
        if noisy:
            for w in words:
                bits |= _bit(w) if w in self.titles.spelling and w not in FUNCTION_WORDS else 0
        else:
            for w in (*words, *(a + b for a, b in zip(words, words[1:]) if a + b in self.titles.spelling)):
                bits |= self._once("w", w, self._like)
        if self.surnames is None:
            names = [0]
        else:
            names = sorted({x for one in parts for t in one for x in self._once("n", t, self._surnames)} if noisy else {_number(one[-1]) for one in parts})
        doi, ys = clean_doi(record[2]), years(record[4])[-1:]
        facts = ys[0] - 1799 if ys else 0
        for i, half in enumerate((doi[: len(doi) // 2], doi[len(doi) // 2 :])):
            facts |= (1 + xxhash.xxh64_intdigest(half.encode("utf-8", "surrogatepass")) % 255 if doi else 0) << 9 + 8 * i
        facts |= (not parts) << 25 | min(3, len(parts)) << 26 | (not words) << 28
        for w in _journal_words(record[3]):
            facts |= 1 << 29 + ord(w[0]) % 30
        return bits - (1 << 64) if bits >> 63 else bits, names, facts


def _bit(w: str) -> int:
    return 1 << (xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) & 63)


def _number(w: str) -> int:
    return 1 + xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), seed=1) % 32767


def hopeful(prior: float) -> str:
    """SQL: whether records whose DOIs share no key can have a ``score`` over FLOOR, from the signatures
    (``Signer.sign``) lwords, lnames, lfacts and rwords, rnames, rfacts; names are compared last, if they decide."""
    both = lambda at, n: [f"(shiftright({side}facts, {at}) & {(1 << n) - 1}L)" for side in "lr"]
    (y, z), (a, b), (c, d), (j, k) = both(0, 9), both(9, 8), both(17, 8), both(29, 30)
    rest = f"""{prior - FLOOR + 1e-6!r}D
        + CASE WHEN {j} = 0L OR {k} = 0L THEN 0D WHEN {j} & {k} = {j} OR {j} & {k} = {k} THEN 1.5D ELSE -2D END
        + CASE WHEN ((lfacts | rfacts) & {1 << 28}L) != 0L THEN 0D ELSE greatest(-14D, {TITLE_MOST}D - {ODD_WORD}D * bit_count(lwords & ~rwords)) END
        + CASE WHEN {y} = 0L OR {z} = 0L THEN 0D WHEN {y} = {z} THEN 2.2D WHEN abs({y} - {z}) = 1L THEN -0.7D ELSE -3.5D END
        + CASE WHEN {a} = 0L OR {b} = 0L THEN 0D WHEN {a} = {b} OR {c} = {d} THEN 5D ELSE -8D END"""
    agree, lack = f"3D + {both(26, 2)[0]}", f"((lfacts | rfacts) & {1 << 25}L) != 0L"
    return f"({rest} + CASE WHEN {lack} THEN 0D ELSE {agree} END > 0D) AND ({lack} OR arrays_overlap(lnames, rnames) OR {rest} - 5D > 0D)"


def meetings(left: DataFrame, right: DataFrame, titles: Titles, shared) -> DataFrame:
    """(key, l, points, r, ...): the keys in which records meet that can score more than FLOOR.

    Pairs that share some words of their titles grow with the square of the tables. So signatures
    travel with the keys and tell where keys meet, before anything is shuffled by pair, that a pair
    can't match (``hopeful``). Pairs by DOI are few and all kept."""
    names = [f.split()[0] for f in FIELDS.split(", ")]

    def keyed(df: DataFrame, noisy: bool, name: str) -> DataFrame:
        def run(cols: dict[str, list]) -> dict[str, list]:
            t, signer = _titles(shared.value)
            rows = list(zip(*(cols[n] for n in names)))
            keys = [_keys(r, t, noisy) for r in rows]
            signs = zip(*(signer.sign(r, noisy) for r in rows))
            return {"id": cols["id"], "keys": [[{"points": p, "key": k} for p, k in x] for x in keys]} | dict(zip(("words", "names", "facts"), signs))

        kind = dict(df.dtypes)["id"]
        out = map_rows(df.select("id", *names), f"id {kind}, keys array<struct<points:int,key:string>>, words bigint, names array<smallint>, facts bigint", run)
        out = out.select(F.col("id").alias(name), F.explode("keys").alias("x"), "words", "names", "facts")
        # records that meet by author have a name in common, those that meet by DOI need no test
        by = F.substring("x.key", 1, 1)
        named = F.when(by.isin("t", "p"), F.col("names")).otherwise(F.array(F.lit(0).cast("smallint")))
        sign = [F.coalesce(c, zero).alias(name + n) for n, c, zero in (("words", F.col("words"), F.lit(0)), ("names", named, F.array(F.lit(0).cast("smallint"))), ("facts", F.col("facts"), F.lit(0)))]
        return out.select(name, F.xxhash64("x.key").alias("key"), F.col("x.points").alias("points"), *sign, *([(by == "d").alias("free")] if noisy else []))

    # by shuffle: the engine's estimates don't know how many keys a record has
    met = keyed(left, True, "l").hint("merge").join(keyed(right, False, "r").drop("points").hint("merge"), "key")
    return met.where(F.col("free") | F.expr(hopeful(titles.prior)))


def candidates(left: DataFrame, right: DataFrame, titles: Titles, surnames: list[str] | None = None) -> DataFrame:
    """(l, r, theta): pairs that share a key, scored; ``left`` is the noisier side. Both have
    ``id`` and the columns of FIELDS. Pairs are those that share enough blocking keys (``_keys``)
    and score more than FLOOR. Only key hashes, signatures and ids are shuffled; records travel to
    the distinct pairs afterwards. ``surnames``: all of ``right``, None if they are too many."""
    spark = left.sparkSession
    shared = spark.sparkContext.broadcast((titles.spelling, titles.hashes, titles.counts, titles.total, surnames))
    names = [f.split()[0] for f in FIELDS.split(", ")]
    pairs = meetings(left, right, titles, shared).groupBy("l", "r").agg(F.sum("points").alias("points")).where(F.col("points") >= MEET).select("l", "r")

    def judge(cols: dict[str, list]) -> dict[str, list]:
        t, _ = _titles(shared.value)
        known: dict = {}

        def record(side: str, i: int) -> Record:
            k = side, cols[side][i]
            if k not in known:
                c = "a" if side == "l" else "b"
                known[k] = Record(*(cols[c + n][i] for n in names), t)
            return known[k]

        theta = [score(record("l", i), record("r", i), t) for i in range(len(cols["l"]))]
        keep = [i for i, x in enumerate(theta) if x > FLOOR]
        return {"l": [cols["l"][i] for i in keep], "r": [cols["r"][i] for i in keep], "theta": [max(-30.0, min(30.0, theta[i])) for i in keep], "claim": [claim(clean_doi(cols["adoi"][i]), clean_doi(cols["bdoi"][i])) for i in keep]}

    x = left.select(F.col("id").alias("l"), *[F.col(n).alias("a" + n) for n in names])
    y = right.select(F.col("id").alias("r"), *[F.col(n).alias("b" + n) for n in names])
    types = dict(pairs.dtypes)
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a fixed number isn't coalesced: scoring is Python's
    return map_rows(pairs.join(x, "l").repartition(width, "r").join(y, "r"), f"l {types['l']}, r {types['r']}, theta double, claim string", judge, rows=10_000)


_BUILT: list = [None, None]


def _titles(value: tuple[dict[str, int], np.ndarray, np.ndarray, int, list[str] | None]) -> tuple[Titles, Signer]:
    """Titles and signer of a broadcast value, built once per process."""
    if _BUILT[0] is not value:
        titles = Titles(*value[:4])
        _BUILT[:] = [value, (titles, Signer(titles, value[4]))]
    return _BUILT[1]


def propagate(pairs: DataFrame, rounds: int = MOST_ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """(l, r, theta, confidence): marginals of the match variables of pairs (l, r, theta, claim).

    Factors: a record ``l`` describes at most one ``r``; an ``r`` is at most one of the works that
    the records claim by an identifier of their own (records with the same claim, or none, may all
    describe it, as works recur). Messages -log(1 + sum of the others' odds) are exchanged by
    aggregations and joins, damped more and more, until none moves by more than ``tolerance``; it is
    an error if some still do after ``rounds``. Sums over a work are partial per task, so one cited
    by a third of all records is no single task's group; a record has few works.
    """
    own = Window.partitionBy("l")
    state = durable(pairs.select("l", "r", "theta", "claim", F.lit(0.0).alias("ml"), F.lit(0.0).alias("mr")))
    for step in range(rounds):
        out = state.withColumn("a", F.exp(F.col("theta") + F.col("mr")))
        keep = 0.0 if step == 0 else 1 - 0.7 * 0.97**step
        out = out.withColumn("s", F.sum("a").over(own)).withColumn("nl", keep * F.col("ml") - (1 - keep) * F.log1p(F.greatest(F.lit(0.0), F.col("s") - F.col("a"))))
        claims = out.where("claim is not null").groupBy("r", "claim").agg(F.exp(F.max(F.col("theta") + F.col("nl"))).alias("e"))
        total = claims.groupBy("r").agg(F.sum("e").alias("t"), F.count("*").alias("k")).where("k > 1")
        rivals = claims.join(total, "r").select("r", "claim", "t", "e")
        out = out.join(rivals, ["r", "claim"], "left")
        out = out.withColumn("nr", keep * F.col("mr") - (1 - keep) * F.log1p(F.greatest(F.lit(0.0), F.coalesce(F.col("t") - F.col("e"), F.lit(0.0)))))
        out = durable(out.select("l", "r", "theta", "claim", F.col("nl").alias("ml"), F.col("nr").alias("mr"), F.greatest(F.abs(F.col("nl") - F.col("ml")), F.abs(F.col("nr") - F.col("mr"))).alias("moved")))
        moved = out.agg(F.max("moved")).first()[0]
        state = out.drop("moved")
        if moved is None or moved < tolerance:
            break
    else:
        raise RuntimeError(f"messages still move by {moved} after {rounds} rounds")
    return state.select("l", "r", "theta", (1 / (1 + F.exp(-(F.col("theta") + F.col("ml") + F.col("mr"))))).alias("confidence"))


def match_records(left: DataFrame, right: DataFrame) -> DataFrame:
    """(l, r, theta, confidence) for records of ``left`` (noisy, recurring) and ``right``, both
    (id, title, authors, doi, journal, date). Rows with a NULL id match nothing; missing
    attributes speak neither for nor against; a record without title, DOI and authors has no key
    and matches nothing; repeated rows count once; other columns are not read."""
    names = [f.split()[0] for f in FIELDS.split(", ")]
    left = left.where("id is not null").select("id", *names).dropDuplicates(["id"])
    right = durable(right.where("id is not null").select("id", *names).dropDuplicates(["id"]))

    def spell(cols: dict[str, list]) -> dict[str, list]:
        return {"w": [w for t in cols["title"] for w in set(title_words(t))]}

    counted = durable(map_rows(right.select("title"), "w string", spell).groupBy("w").agg(F.count("*").alias("n")))
    spelling = {r["w"]: r["n"] for r in counted.orderBy(F.desc("n"), "w").limit(SPELLING).collect()}
    known = most_frequent(counted, "n", KNOWN_WORDS).select(F.xxhash64("w").alias("h"), "n").toArrow()
    titles = Titles(spelling, known["h"].to_numpy(), known["n"].to_numpy(), right.count())

    def last(cols: dict[str, list]) -> dict[str, list]:
        return {"n": [n for a in cols["authors"] for n in {one[-1] for one in name_tokens(a)}]}

    surnames = [r["n"] for r in map_rows(right.select("authors"), "n string", last).distinct().limit(SURNAMES + 1).collect()]
    return propagate(candidates(left, right, titles, surnames if len(surnames) <= SURNAMES else None))
