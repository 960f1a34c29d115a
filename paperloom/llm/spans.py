"""Long verbatim spans shared between texts, by sharded automata of recurring phrases."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.words import CHARACTERS, mix
from paperloom.runtime import durable, map_rows, spread

#: Characters of a phrase; phrases of one automaton; texts a shard streams before it is salted.
PHRASE, SHARD_PHRASES, SHARD_TEXTS = 160, 2000, 4000
#: A phrase of more texts than this is compared window by window over all tasks, not in one group.
GROUP = 256
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, made once per process."""
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, dtype=np.uint64), np.full(max(n, CHARACTERS), x, dtype=np.uint64)])) for x in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _POWERS[0][:n], _POWERS[1][:n]


def rolling(text: str, size: int) -> np.ndarray:
    """64-bit hashes of all ``size``-character windows of a text (polynomial, wrapping)."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    if len(codes) < size:
        return np.zeros(0, dtype=np.uint64)
    power, inverse = _powers(len(codes))
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix(codes + np.uint64(1)) * power)])
    window = sums[size:] - sums[:-size]
    return mix(window * inverse[: len(window)])  # brought to the same power for every start


def _argmin_windows(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the (first) least value of every window, by sparse-table doubling."""
    place = np.arange(len(h))
    size = 1
    while size * 2 <= width:
        a, b = place[: len(place) - size], place[size:]
        place = np.where(h[b] < h[a], b, a)
        size *= 2
    n = len(h) - width + 1
    a, b = place[:n], place[width - size : width - size + n]
    return np.where(h[b] < h[a], b, a)


def anchors(texts: list[str], span: int) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For groups of texts of at least ``span`` characters: their places in the list, where each begins
    in the group, and all ``span``-sized windows (text, start, hash of the least phrase, its start).

    The least phrase of a window, by hash, is chosen by content alone, so equal windows choose equal
    phrases. Texts are worked on together, about CHARACTERS characters at a time.
    """
    group: list[int] = []
    size = 0
    for k, t in enumerate(texts):
        if group and size + len(t) > CHARACTERS:
            yield _anchors([texts[i] for i in group], group, span)
            group, size = [], 0
        group.append(k)
        size += len(t)
    if group:
        yield _anchors([texts[i] for i in group], group, span)


def _anchors(texts: list[str], places: list[int], span: int) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    h = rolling("".join(texts), PHRASE)
    least = _argmin_windows(h, span - PHRASE + 1)
    sizes = np.array([len(t) for t in texts])
    begins = np.cumsum(sizes) - sizes
    inside = np.arange(len(least)) <= np.repeat(begins + sizes - span, sizes)[: len(least)]  # not over two texts
    start = np.flatnonzero(inside)
    text = np.repeat(np.arange(len(texts)), sizes)[start]
    return places, text, start - begins[text], h[least[start]].view(np.int64), least[start] - begins[text]


def _edges(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where the text or its phrase changes."""
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(text)), dtype=bool), (text[1:] != text[:-1]) | (at[1:] != at[:-1])]))


def _phrases(texts: DataFrame, span: int) -> DataFrame:
    def run(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"rep": [], "phrase": []}
        for places, text, _, phrase, at in anchors(cols["t"], span):
            first = _edges(text, at)  # neighbouring windows mostly have the same phrase
            for k, p in set(zip(text[first].tolist(), phrase[first].tolist())):
                out["rep"].append(cols["rep"][places[k]])
                out["phrase"].append(p)
        return out

    return map_rows(spread(texts), f"rep {dict(texts.dtypes)['rep']}, phrase bigint", run)


def _contexts(texts: DataFrame, recurring: DataFrame, span: int, most: int) -> DataFrame:
    """(route, rep, ats, lead, windows, context, window, before): where texts hold a recurring phrase
    that is the least of some windows: those windows' text, how far in the phrase begins, how many
    windows it has and where it stands in the text, to be grouped by the phrase (route). Of phrases
    of more than ``most`` texts one row a window instead: 128-bit hashes of it and of the window one
    character earlier, if that is among them too.

    Phrases are sharded by hash; a text goes to the shards of the phrases it was found to hold, and
    a shard's texts are salted. Each task compiles one shard's automaton after another from the
    phrase rows that come first in its sort order, and streams the texts behind them through it.
    """
    spark = texts.sparkSession
    kind = dict(texts.dtypes)["rep"]
    total = recurring.select("phrase").distinct().count()
    shards = max(1, -(-total // SHARD_PHRASES))
    routed = recurring.select("rep", F.pmod("phrase", F.lit(shards)).alias("shard")).distinct()
    salts = routed.groupBy("shard").agg(F.count("*").alias("n")).select("shard", F.ceil(F.col("n") / SHARD_TEXTS).cast("int").alias("salts"))
    speaker = recurring.groupBy("phrase").agg(F.min("rep").alias("rep"), (F.max("n") > most).alias("hot"))

    def cut(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"shard": [], "word": [], "hot": []}
        for phrases, t in zip(cols["phrases"], cols["t"]):
            h = rolling(t, PHRASE).view(np.int64)
            wanted = {p["phrase"]: p["hot"] for p in phrases}
            for i in np.flatnonzero(np.isin(h, np.array(list(wanted)))).tolist():
                hot = wanted.pop(int(h[i]), None)
                if hot is not None:
                    out["shard"].append(int(h[i]) % shards)
                    out["word"].append(t[i : i + PHRASE])
                    out["hot"].append(int(hot))
        return out

    spoken = speaker.groupBy("rep").agg(F.collect_list(F.struct("phrase", "hot")).alias("phrases")).join(texts, "rep").select("phrases", "t")
    words = map_rows(spoken, "shard bigint, word string, hot int", cut)
    a = words.join(salts, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("hot").alias("kind"), F.lit(None).cast(kind).alias("rep"), F.col("word").alias("t"))
    b = routed.join(salts, "shard").join(texts, "rep").select("shard", F.pmod(F.xxhash64("rep"), F.col("salts")).cast("int").alias("salt"), F.lit(2).alias("kind"), "rep", "t")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stream = a.union(b).repartition(n, "shard", "salt").sortWithinPartitions("shard", "salt", "kind")
    schema = f"route bigint, rep {kind}, ats array<int>, lead int, windows int, context string, window binary, before binary"
    names = [c.split()[0] for c in schema.split(", ")]
    current: list = [None, None, False]  # shard and salt, its automaton, whether it is compiled; each task has its own

    def run(cols: dict[str, list]) -> dict[str, list]:
        found: list[dict[int, int]] = []
        out: dict[str, list] = {c: [] for c in names}
        for shard, salt, what, t in zip(cols["shard"], cols["salt"], cols["kind"], cols["t"]):
            if (shard, salt) != current[0]:
                current[:] = (shard, salt), ahocorasick.Automaton(), False
            automaton = current[1]
            if what < 2:
                automaton.add_word(t, what)
                found.append({})
                continue
            if not current[2]:
                automaton.make_automaton()
                current[2] = True
            found.append({end - PHRASE + 1: hot for end, hot in automaton.iter(t)} if len(automaton) else {})
        texts = [i for i, f in enumerate(found) if f]
        for places, text, start, phrase, at in anchors([cols["t"][i] for i in texts], span):
            edge = _edges(text, at)
            stops = np.append(edge[1:], len(text))
            same: dict[tuple, int] = {}
            last: tuple = (None, None, None)  # the row and the window before, if that was hot
            for k, s, p, lead, count in zip(text[edge].tolist(), start[edge].tolist(), phrase[edge].tolist(), at[edge].tolist(), (stops - edge).tolist()):
                i = texts[places[k]]
                hot = found[i].get(lead)
                if hot is None:
                    continue
                context = cols["t"][i][s : s + count - 1 + span]
                if not hot:
                    seen = same.get((i, p, context))
                    if seen is not None:
                        out["ats"][seen].append(s)
                        continue
                    same[i, p, context] = len(out["rep"])
                    rows = [(p, cols["rep"][i], [s], lead - s, count, context, None, None)]
                else:
                    rows = []
                    for j in range(count):
                        w = xxhash.xxh3_128_digest(context[j : j + span].encode("utf-8", "surrogatepass"))
                        rows.append((int.from_bytes(w[:7], "big"), cols["rep"][i], [s + j], 0, 1, None, w, last[2] if last[:2] == (i, s + j - 1) else None))
                        last = i, s + j, w
                for row in rows:
                    for c, v in zip(names, row):
                        out[c].append(v)
        return out

    return map_rows(stream, schema, run)


def _common(a: str, b: str) -> int:
    """How many characters two texts have in common at their beginning."""
    lo, hi = 0, min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return hi
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid)
    return lo


def _compare(rows: list[tuple], span: int) -> tuple[list[tuple[int, int, int]], set[tuple]]:
    """Of the contexts (rep, lead, windows, context) of one phrase: the runs of windows (row, first,
    last) that another text has too, and the pairs of texts that share one. Equal means equal
    character by character."""
    runs: list[tuple[int, int, int]] = []
    if len(rows) == 2:
        (ra, la, na, a), (rb, lb, nb, b) = rows
        if ra == rb:
            return [], set()
        after, before = _common(a[la:], b[lb:]), _common(a[:la][::-1], b[:lb][::-1])
        for k, lead, n in ((0, la, na), (1, lb, nb)):
            first, last = max(0, lead - before), min(n - 1, lead + after - span)
            if first <= last:
                runs.append((k, first, last))
        return runs, {(min(ra, rb), max(ra, rb))} if runs else set()
    holders: dict[str, list[int]] = {}
    for k, (_, _, n, context) in enumerate(rows):
        for j in range(n):
            holders.setdefault(context[j : j + span], []).append(k)
    known: dict[tuple[int, ...], bool] = {}
    pairs: set[tuple] = set()
    for who in map(tuple, holders.values()):
        if who not in known:
            reps = sorted({rows[k][0] for k in who})
            known[who] = len(reps) > 1
            pairs.update(combinations(reps, 2))
    for k, (_, _, n, context) in enumerate(rows):
        shared = [j for j in range(n) if known[tuple(holders[context[j : j + span]])]]
        for j in shared:
            if runs and runs[-1][0] == k and runs[-1][2] == j - 1:
                runs[-1] = k, runs[-1][1], j
            else:
                runs.append((k, j, j))
    return runs, pairs


def _shared(contexts: DataFrame, span: int) -> DataFrame:
    """(rep, start, stop, other, window, before): runs of shared windows (start, stop), pairs of texts
    (other), and the windows of hot phrases as they came. Contexts of a phrase are one group of bounded size."""
    kind = dict(contexts.dtypes)["rep"]
    schema = f"rep {kind}, start int, stop int, other {kind}, window binary, before binary"
    names = [c.split()[0] for c in schema.split(", ")]
    n = int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stream = contexts.repartition(n, "route").sortWithinPartitions("route")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        route = None

        def rows_of(group: list[tuple]) -> Iterator[tuple]:
            runs, pairs = _compare([g[:4] for g in group], span) if len(group) > 1 else ([], set())
            for k, first, last in runs:
                for at in group[k][4]:
                    yield group[k][0], at + first, at + last + span, None, None, None
            for a, b in pairs:
                yield a, None, None, b, None, None

        def packed(rows: list[tuple], like: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [[]] * len(names)
            types = [like, pa.int32(), pa.int32(), like, pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types)], names=names)

        like = None
        for batch in batches:
            like = batch.schema.field("rep").type
            out: list[tuple] = []
            for r in zip(*(batch.column(c).to_pylist() for c in ("route", "rep", "lead", "windows", "context", "ats", "window", "before"))):
                if r[6] is not None:
                    out.append((r[1], r[5][0], r[5][0] + span, None, r[6], r[7]))
                    continue
                if r[0] != route:
                    out.extend(rows_of(group))
                    group, route = [], r[0]
                group.append(r[1:6])
            yield packed(out, like)
        if group:
            yield packed(list(rows_of(group)), like)

    return stream.mapInArrow(run, schema)


def shared_spans(df: DataFrame, key: str, text: str, span: int = 300, group: int = GROUP) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Texts that share spans of at least ``span`` characters, equal character by character.

    Returns ``members`` (id, rep): every id with a text of at least ``span`` characters and the
    least id with the very same text; ``runs`` (rep, start, stop): spans of the text, of at least
    ``span`` characters, every ``span`` of which another text has too; ``pairs`` (a, b), a < b, of
    distinct texts that share a window of ``span`` characters.

    Phrases are chosen by content (a window's least phrase), confirmed as recurring by a count over
    the whole corpus, compiled into sharded automata, and all texts that can hold one are streamed
    through; what surrounds a phrase is compared with what surrounds it elsewhere, on characters.
    Windows of phrases of more than ``group`` texts are compared by 128-bit hashes over all tasks:
    a pair is joined there where its run of common windows begins (equal windows after different
    ones). Copies are one text until the end.

    NULL ids or texts and texts shorter than ``span`` share nothing; what only recurs within one text
    isn't shared; repeated rows count once. Equal texts are told by their 96-bit hash and length.
    """
    src = df.select(F.col(key).alias("id"), F.col(text).alias("t")).where(F.col("id").isNotNull() & (F.length("t") >= span))
    marked = src.select("id", F.xxhash64("t").alias("h1"), F.hash("t").alias("h2"), F.length("t").alias("n"))
    classes = marked.groupBy("h1", "h2", "n").agg(F.min("id").alias("rep"))
    members = durable(marked.join(classes, ["h1", "h2", "n"]).select("id", "rep").distinct())
    texts = durable(src.join(members.where("id = rep").select("rep").distinct(), F.col("id") == F.col("rep")).groupBy("rep").agg(F.min("t").alias("t")))
    phrases = durable(_phrases(texts, span))
    often = phrases.groupBy("phrase").agg(F.count("*").alias("n")).where("n > 1")
    recurring = durable(phrases.hint("merge").join(often.hint("merge"), "phrase"))
    found = durable(_shared(_contexts(texts, recurring, span, group), span))
    windows = found.where("window is not null")
    none = F.expr("X''")
    sizes = windows.groupBy("window").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.min(F.coalesce("before", none)).alias("b0"), F.max(F.coalesce("before", none)).alias("b1"))
    shared = windows.hint("merge").join(sizes.where("lo <> hi").select("window", "b0", "b1").hint("merge"), "window")
    begins = shared.where("length(b0) = 0 or b0 <> b1").select("rep", "window", "before").distinct()
    x, y = begins.hint("merge").alias("x"), begins.hint("merge").alias("y")
    differ = F.col("x.before").isNull() | F.col("y.before").isNull() | (F.col("x.before") != F.col("y.before"))
    hot = x.join(y, (F.col("x.window") == F.col("y.window")) & (F.col("x.rep") < F.col("y.rep")) & differ)
    pairs = found.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b")).union(hot.select(F.col("x.rep"), F.col("y.rep"))).distinct()
    runs = found.where("window is null and start is not null").select("rep", "start", "stop").union(shared.select("rep", "start", "stop"))
    return members, runs, pairs


def expand_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id_a, id_b), smaller first: pairs of ids from equal or paired texts; distinct."""
    m, n = members.alias("m"), members.alias("n")
    same = m.join(n, (F.col("m.rep") == F.col("n.rep")) & (F.col("m.id") < F.col("n.id"))).select(F.col("m.id").alias("id_a"), F.col("n.id").alias("id_b"))
    x = pairs.join(members.select(F.col("rep").alias("a"), F.col("id").alias("i")), "a").join(members.select(F.col("rep").alias("b"), F.col("id").alias("j")), "b")
    return same.union(x.select(F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b"))).where("id_a <> id_b").distinct()


def coverage(df: DataFrame, key: str, text: str, span: int = 300, group: int = GROUP) -> DataFrame:
    """(id, rep, n_chars, spans, shared_chars, copies, links): one row per id with a text of at least
    ``span`` characters: the maximal spans [start, stop) of it that other texts hold too (the
    whole text if it has a copy), how many characters they cover, how many ids have its text, and
    how many other texts share a span with it."""
    members, flat, pairs = shared_spans(df, key, text, span, group)
    links = pairs.select(F.col("a").alias("rep")).union(pairs.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("links"))
    flat = flat.groupBy("rep", "start").agg(F.max("stop").alias("stop"))
    # windows less than a span apart overlap: merge by the running maximum of the ends
    order = Window.partitionBy("rep").orderBy("start")
    cut = F.col("start") > F.coalesce(F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    merged = flat.withColumn("k", F.sum(cut.cast("int")).over(order)).groupBy("rep", "k").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    spans = merged.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    copies = members.groupBy("rep").agg(F.count("*").alias("copies"))
    length = df.select(F.col(key).alias("id"), F.length(text).alias("n_chars")).where(F.col("n_chars") >= span).distinct()
    out = members.join(copies, "rep").join(length, "id").join(spans, "rep", "left").join(links, "rep", "left")
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_chars").alias("stop")))
    out = out.withColumn("spans", F.when(F.col("copies") > 1, whole).otherwise(F.coalesce("spans", F.slice(whole, 1, 0))))
    return out.select("id", "rep", "n_chars", "spans", F.expr("aggregate(spans, 0, (a, x) -> a + x.stop - x.start)").alias("shared_chars"), "copies", F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))
