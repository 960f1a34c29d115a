"""Near-duplicate texts by meet-in-the-middle ball hashing of set fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.words import hash_texts, mix, shingle_hashes
from paperloom.runtime import durable, map_rows, spread

#: Fingerprints per text, symbols of a fingerprint, and the edit radius of the ball around one
#: (symbols exchanged); each side walks half of that way, so it drops RADIUS // 2 symbols.
FINGERPRINTS, SYMBOLS, RADIUS = 20, 5, 2
#: Colliding texts are compared by this many bits of as many min-hashes before their words are: at a
#: similarity of 0.6 a bit differs with probability 0.2, so that more than MAX_BITS differ for one pair in 150000.
SKETCH_BITS, MAX_BITS = 128, 46
#: Bytes of a variant's key; more bits of it choose the shuffle partition.
KEY_BYTES = 6
#: Classes that share one variant are paired where they meet up to this number; more are paired in
#: blocks of it, each two blocks a group of rows of its own.
BLOCK = 256
#: So many keys are held by a task (about 60 bytes each); the rest is paired by the engine's joins.
HELD = 8_000_000
#: Up to so many classes (16 bytes each) are broadcast to fetch their texts; more are met by a shuffled join.
BROADCAST_CLASSES = 100_000


def _shingles_of(hashed: np.ndarray, sizes: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingle hashes of texts of at least ``shingle`` words, end to end, and where each text
    begins; from the hashes of all words and the texts' numbers of words."""
    flat = shingle_hashes(hashed, shingle)
    ends = np.cumsum(sizes)
    inside = np.ones(len(flat), dtype=bool)
    for k in range(1, shingle):  # sequences over two texts are none
        inside[ends[:-1] - k] = False
    return flat[inside], np.concatenate([[0], (ends - np.arange(1, len(ends) + 1) * (shingle - 1))[:-1]])


def sketch(flat: np.ndarray, starts: np.ndarray, count: int) -> np.ndarray:
    """Min-hash values of many non-empty shingle lists at once, which follow each other: one row per text."""
    out = np.empty((len(starts), count), dtype=np.uint64)
    odd = mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    for k, multiplier in enumerate(odd):
        out[:, k] = np.minimum.reduceat(flat * multiplier, starts)
    return mix(out)


def variant_keys(symbols: np.ndarray, fingerprints: int = FINGERPRINTS, size: int = SYMBOLS, radius: int = RADIUS) -> np.ndarray:
    """64-bit keys of all fingerprint variants half the radius away, by dropping radius // 2 symbols;
    one row per text.

    Two fingerprints at most ``radius`` apart (radius // 2 symbols exchanged on either side) meet
    in a variant that both emit.
    """
    weight = mix(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
    keys = []
    for f in range(fingerprints):
        own = symbols[:, f * size : (f + 1) * size] * weight
        total = own.sum(axis=1)
        for dropped in combinations(range(size), radius // 2):
            salt = mix(np.array([f * 1009 + sum(1 << i for i in dropped) + 1], dtype=np.uint64))[0]
            keys.append(mix((total - own[:, list(dropped)].sum(axis=1)) ^ salt))
    return np.stack(keys, axis=1)


def _packed(cols: dict[str, list], shingle: int, partitions: int, seen: set[int]) -> dict[str, list | pa.Array]:
    """Rows (part, class, s1, s2, keys) of texts: the keys of a text that go to the same partition
    travel in one row. A class that the task has met before is passed over."""
    if len(seen) > 500_000:
        seen.clear()
    new = {c: t for c, t in zip(cols["class"], cols["t"]) if c not in seen}
    seen.update(new)
    hashed, sizes = hash_texts(list(new.values()))
    enough = sizes >= shingle
    classes = np.array(list(new), dtype=np.int64)[enough]
    if not len(classes):
        return {"part": [], "class": [], "s1": [], "s2": [], "keys": []}
    hashed, sizes = hashed[np.repeat(enough, sizes)], sizes[enough]
    count = FINGERPRINTS * SYMBOLS
    values = sketch(*_shingles_of(hashed, sizes, shingle), max(count, SKETCH_BITS))
    bits = np.packbits((values[:, :SKETCH_BITS] >> np.uint64(20)).astype(np.uint8) & 1, axis=1).view(np.int64)
    keys = variant_keys(values[:, :count] & np.uint64(0xFFFF))
    part = ((keys >> np.uint64(8 * KEY_BYTES)) % np.uint64(partitions)).astype(np.int64)
    place = np.arange(len(classes))[:, None] * partitions + part
    order = np.argsort(place, axis=None, kind="stable")
    place = place.reshape(-1)[order]
    starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    body = np.ascontiguousarray(keys.reshape(-1)[order].astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - KEY_BYTES :])
    offsets = np.append(starts, len(place)).astype(np.int32) * KEY_BYTES
    row, part = np.divmod(place[starts], partitions)
    packed = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(body)])
    return {"part": pa.array(part.astype(np.int32)), "class": pa.array(classes[row]), "s1": pa.array(bits[row, 0]), "s2": pa.array(bits[row, 1]), "keys": packed}


COLLISION = "a bigint, b bigint, key bigint, s1 bigint, s2 bigint"


def _collide(batches: Iterator[pa.RecordBatch], most: int = BLOCK, hold: int = HELD) -> Iterator[pa.RecordBatch]:
    """Rows of COLLISION from the packed rows of one partition: the distinct pairs (a, b) of classes
    with a key in common that are near in their sketches. Of keys with more than ``most`` classes, and
    of all keys of a partition with more than ``hold`` of them, come out the single classes instead
    (a, key, s1, s2; b NULL), which are paired elsewhere: memory is bounded."""
    types = {"bigint": pa.int64()}
    schema = pa.schema([(c.split()[0], types[c.split()[1]]) for c in COLLISION.split(", ")])
    bodies: list[np.ndarray] = []
    heads: list[np.ndarray] = []  # class, s1, s2 and number of keys of each packed row
    held, full = 0, False

    def unpacked() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        nonlocal bodies, heads, held
        width = np.zeros((held, 8), dtype=np.uint8)
        width[:, 8 - KEY_BYTES :] = np.concatenate(bodies).reshape(-1, KEY_BYTES)
        keys = width.reshape(-1).view(">u8").astype(np.int64)
        rows = np.concatenate(heads)
        bodies, heads, held = [], [], 0
        return keys, rows, np.repeat(np.arange(len(rows)), rows[:, 3])

    def single(keys: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(keys), 10_000):
            k, r = keys[at : at + 10_000], rows[at : at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(r[:, 0]), pa.nulls(len(k), pa.int64()), pa.array(k), pa.array(r[:, 1]), pa.array(r[:, 2])], schema=schema)

    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(4)
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset :][: batch.num_rows + 1]
        bodies.append(np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]])
        heads.append(np.stack([*(batch.column(i).to_numpy() for i in (1, 2, 3)), np.diff(offsets) // KEY_BYTES], axis=1))
        held += len(bodies[-1]) // KEY_BYTES
        if held > hold or full and held:
            full = True
            keys, rows, row = unpacked()
            yield from single(keys, rows[row])
    if not held:
        return
    keys, rows, row = unpacked()
    order = np.argsort(keys)
    keys, row = keys[order], row[order]
    same = keys[1:] == keys[:-1]
    shared = np.flatnonzero(np.concatenate([same, [False]]) | np.concatenate([[False], same]))  # keys of one row only meet nothing
    keys, row = keys[shared], row[shared]
    starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), dtype=bool), keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(starts, len(keys)))
    hot = np.repeat(sizes > most, sizes)
    yield from single(keys[hot], rows[row[hot]])
    keys, row = keys[~hot], row[~hot]
    met = [np.zeros((0, 2), dtype=np.int64)]
    for d in range(1, most):
        x = np.flatnonzero(keys[d:] == keys[:-d])
        if not len(x):
            break
        p, q = rows[row[x]], rows[row[x + d]]
        near = (np.bitwise_count((p[:, 1:3] ^ q[:, 1:3]).view(np.uint64)).sum(axis=1) <= MAX_BITS) & (p[:, 0] != q[:, 0])
        met.append(np.sort(np.stack([p[near, 0], q[near, 0]], axis=1), axis=1))
    pairs = np.unique(np.concatenate(met), axis=0)
    for at in range(0, len(pairs), 10_000):
        part = pairs[at : at + 10_000]
        none = pa.nulls(len(part), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(part[:, 0].copy()), pa.array(part[:, 1].copy()), none, none, none], schema=schema)


def _block_pairs(single: DataFrame, most: int = BLOCK) -> DataFrame:
    """(a, b): the near pairs of the classes (a, key, s1, s2) under each key. The classes of a key are
    split into blocks of about ``most``, and each two blocks are a group of their own."""
    far = F.bit_count(F.col("x.s1").bitwiseXOR(F.col("y.s1"))) + F.bit_count(F.col("x.s2").bitwiseXOR(F.col("y.s2"))) > MAX_BITS
    h = single.select(F.col("a").alias("class"), "key", "s1", "s2")
    sizes = h.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / most).cast("int").alias("blocks"))
    h = h.hint("merge").join(sizes.hint("merge"), "key").withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    x = h.select("class", "s1", "s2", "key", F.col("block").alias("p"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("q")).hint("merge").alias("x")
    y = h.select("class", "s1", "s2", "key", F.explode(F.sequence(F.lit(0), "block")).alias("p"), F.col("block").alias("q")).hint("merge").alias("y")
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.p") == F.col("y.p")) & (F.col("x.q") == F.col("y.q")))
    met = met.where(~far & (F.col("x.class") != F.col("y.class")))
    return met.select(F.least("x.class", "y.class").alias("a"), F.greatest("x.class", "y.class").alias("b"))


def _verify(pairs: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """Pairs (a, b, text_a, text_b) whose distinct shingles overlap enough, as (a, b, similarity)."""

    def run(cols: dict[str, list]) -> dict[str, list]:
        texts = dict(zip(cols["a"], cols["text_a"])) | dict(zip(cols["b"], cols["text_b"]))
        hashed, sizes = hash_texts(list(texts.values()))
        sets = {c: np.unique(shingle_hashes(h, shingle)) for c, h in zip(texts, np.split(hashed, np.cumsum(sizes)[:-1]))}
        out: dict[str, list] = {"a": [], "b": [], "similarity": []}
        for a, b in zip(cols["a"], cols["b"]):
            x, y = sets[a], sets[b]
            if min(len(x), len(y)) < threshold * max(len(x), len(y)):
                continue
            every = np.sort(np.concatenate([x, y]))
            both = int(np.count_nonzero(every[1:] == every[:-1]))
            if both and both >= threshold * (len(x) + len(y) - both):
                out["a"].append(a)
                out["b"].append(b)
                out["similarity"].append(both / (len(x) + len(y) - both))
        return out

    return map_rows(pairs, "a bigint, b bigint, similarity double", run)


def near_duplicates(df: DataFrame, key: str, text: str, shingle: int = 5, threshold: float = 0.8, block: int = BLOCK, hold: int = HELD) -> tuple[DataFrame, DataFrame]:
    """Classes of equal word sequences and the similar pairs among them.

    Returns ``members`` (id, class), one row per text of at least ``shingle`` words, and ``links``
    (a, b, similarity), class a < class b, with a Jaccard similarity of distinct word shingles of
    at least ``threshold``, verified on the texts. Copies are never expanded into pairs here.

    A class is a text but for case, by its 64-bit hash. Fingerprints of min-hash symbols emit every
    variant within half the radius; the shuffle is on the variants, those of a text that go to one
    partition in one row. There classes under the same variant are paired if their sketches are near;
    a variant of more than ``block`` classes is split into pairs of blocks over all tasks. The distinct pairs are verified on the texts. With the defaults a pair of similarity 0.6
    is met with probability 0.9997 (20 fingerprints, each met if 4 of its 5 symbols agree: 0.337),
    one of 0.65 with 0.99999, one of 0.7 practically always.

    NULL ids and NULL, blank or too short texts come out nowhere; repeated rows count once.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    src = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("t"), F.xxhash64(F.lower(text)).alias("class"))
    word, gap = r"[\p{L}\p{N}]", r"[^\p{L}\p{N}]"
    members = src.where(F.col("t").rlike(f"(?<!{word})(?:{word}++{gap}++){{{shingle - 1}}}{word}")).select("id", "class").distinct()
    seen: set[int] = set()  # each task has its own
    packed = map_rows(spread(src.select("class", "t")), "part int, class bigint, s1 bigint, s2 bigint, keys binary", lambda cols: _packed(cols, shingle, partitions, seen))
    met = durable(packed.repartitionById(partitions, "part").mapInArrow(lambda batches: _collide(batches, block, hold), COLLISION))
    pairs = durable(met.where("b is not null").select("a", "b").union(_block_pairs(met.where("b is null"), block)).distinct())
    needed = pairs.select(F.col("a").alias("class")).union(pairs.select(F.col("b").alias("class"))).distinct()
    few = needed.count() <= BROADCAST_CLASSES
    texts = src.join(F.broadcast(needed) if few else needed.hint("merge"), "class").groupBy("class").agg(F.min("t").alias("t"))
    both = pairs.join(texts.select(F.col("class").alias("a"), F.col("t").alias("text_a")).hint("merge"), "a").join(texts.select(F.col("class").alias("b"), F.col("t").alias("text_b")).hint("merge"), "b")
    return members, durable(_verify(both.select("a", "b", "text_a", "text_b"), shingle, threshold))


def expand_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id_a, id_b), smaller first, of different ids in equal or linked classes; distinct."""
    m = members.alias("m")
    n = members.alias("n")
    same = m.join(n, (F.col("m.class") == F.col("n.class")) & (F.col("m.id") < F.col("n.id"))).select(F.col("m.id").alias("id_a"), F.col("n.id").alias("id_b"))
    x = links.join(members.select(F.col("class").alias("a"), F.col("id").alias("i")), "a").join(members.select(F.col("class").alias("b"), F.col("id").alias("j")), "b")
    linked = x.where("i <> j").select(F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b"))
    return same.union(linked).distinct()


def components(links: DataFrame) -> DataFrame:
    """(class, component): connected components of the links by large-star/small-star rounds, until
    nothing changes.

    Every round shrinks paths by half; the labels are pre-aggregated minima, so a class with very
    many links is no single task's group. Only classes with links come out.
    """
    edges = durable(links.select(F.col("a").alias("u"), F.col("b").alias("v")).distinct())
    while True:
        sym = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = sym.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        small_low = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        lowest = small_low.groupBy("u").agg(F.min("v").alias("m"))
        small = small_low.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        nxt = durable(small.union(lowest.select("u", F.col("m").alias("v"))).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        same = nxt.count() == edges.count() and nxt.exceptAll(edges).isEmpty()
        edges = nxt
        if same:
            break
    return edges.select(F.col("u").alias("class"), F.col("v").alias("component")).union(edges.select(F.col("v"), F.col("v"))).distinct()


def groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id, class, component, links): one row per text with its class, its group and the number of
    classes linked to its own. A text like no other is its own group with no link."""
    comp = components(links)
    degree = links.select(F.col("a").alias("class")).union(links.select(F.col("b").alias("class"))).groupBy("class").agg(F.count("*").alias("links"))
    return members.join(comp, "class", "left").join(degree, "class", "left").select("id", "class", F.coalesce("component", "class").alias("component"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))
