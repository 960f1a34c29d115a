import random
import string

import pytest

from paperloom.llm import leak, neardup, spans
from paperloom.llm.words import hash_texts, words


def vocabulary(rng, n=400):
    return ["".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(3, 8))) for _ in range(n)]


def brute_pairs(rows, shingle, threshold):
    s = {}
    for k, t in rows:
        w = words(t)
        if k is not None and len(w) >= shingle:
            s.setdefault(k, []).append(set(zip(*(w[i:] for i in range(shingle)))))
    keys = sorted(s)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if any(len(x & y) >= threshold * len(x | y) for x in s[a] for y in s[b])}


def test_words_are_hashed_in_bulk_as_they_are_one_by_one(monkeypatch):
    from paperloom.llm import words as w

    texts = ["Hello World, ça va? ß_x 12", "", " ", "x", "İstanbul WORLD hello ca", "a-b-c " * 20, "日本語 text", "\ud800 lone"]
    for size in (2_000_000, 37):
        monkeypatch.setattr(w, "CHARACTERS", size)
        hashes, counts = w.hash_texts(texts)
        each = [words(t) for t in texts]
        assert counts.tolist() == list(map(len, each))
        known = {}
        for word, h in zip(sum(each, []), hashes.tolist()):
            assert known.setdefault(word, h) == h
        assert len(set(known.values())) == len(known)


@pytest.mark.parametrize("shingle, threshold, block, hold", [(3, 0.6, 256, 10**6), (5, 0.8, 256, 10**6), (3, 0.6, 2, 10**6), (3, 0.6, 256, 300)])
def test_near_duplicates(spark, shingle, threshold, block, hold):
    rng = random.Random(9)
    voc = vocabulary(rng)
    rows = []
    for k in range(40):
        base = [rng.choice(voc) for _ in range(rng.randint(30, 90))]
        rows.append((f"k{k}", " ".join(base)))
        for v in range(rng.choice([0, 1, 3])):
            t = list(base)
            for _ in range(rng.randint(0, 3)):
                i = rng.randrange(len(t))
                t[i : i + 1] = rng.choice([[], [rng.choice(voc)], [t[i], rng.choice(voc)]])
            rows.append((f"k{k}v{v}", "  ".join(t).upper() if v == 2 else " ".join(t)))
    rows += [("e1", ""), ("e2", None), (None, rows[0][1]), ("s1", "two words"), ("s2", "two words"), rows[0], rows[1]]
    df = spark.createDataFrame(rows, "id string, text string").selectExpr("*", "1 as class", "2 as key")
    members, links = neardup.near_duplicates(df, "id", "text", shingle, threshold, block, hold)
    got = {tuple(r) for r in neardup.expand_pairs(members, links).collect()}
    assert got == brute_pairs(rows, shingle, threshold)
    g = neardup.groups(members, links).collect()
    assert len(g) == len({k for k, t in rows if k and len(words(t)) >= shingle})
    comp = {r["id"]: r["component"] for r in g}
    assert all(comp[a] == comp[b] for a, b in got) and len(set(comp.values())) >= 40


def test_many_copies_stay_one_class(spark):
    rows = [(i, "the same text of quite a few words stands here again and again") for i in range(300)] + [(1000, "another text that has nothing at all in common with it")]
    members, links = neardup.near_duplicates(spark.createDataFrame(rows, "id bigint, text string"), "id", "text")
    assert links.count() == 0 and members.select("class").distinct().count() == 2


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 30) if i % 10] + [(100, 50)], "a bigint, b bigint").selectExpr("least(a, b) a", "greatest(a, b) b", "1.0D similarity")
    got = {r["class"]: r["component"] for r in neardup.components(links).collect()}
    assert {got[i] for i in range(1, 11)} == {1} and {got[i] for i in range(11, 21)} == {11} and got[100] == got[50] == 50


def test_empty(spark):
    df = spark.createDataFrame([], "id bigint, text string")
    members, links = neardup.near_duplicates(df, "id", "text")
    assert neardup.groups(members, links).count() == 0 and neardup.expand_pairs(members, links).count() == 0
    m, w, p = spans.shared_spans(df, "id", "text")
    assert spans.expand_pairs(m, p).count() == 0 and spans.coverage(df, "id", "text").count() == 0
    items = spark.createDataFrame([], "item bigint, question string, answer string")
    assert leak.leaks(df, "id", "text", items, "item", ["question", "answer"]).count() == 0


def brute_spans(rows, n):
    t = {k: v for k, v in rows if k is not None and v and len(v) >= n}
    w = {k: {v[i : i + n] for i in range(len(v) - n + 1)} for k, v in t.items()}
    return {(a, b) for a in t for b in t if a < b and w[a] & w[b]}, t, w


@pytest.mark.parametrize("group", [1, 3, 256])
def test_shared_spans(spark, monkeypatch, group):
    monkeypatch.setattr(spans, "SHARD_PHRASES", 2)
    monkeypatch.setattr(spans, "SHARD_TEXTS", 3)
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdefgh é\n") for _ in range(n))
    passages = [text(n) for n in (299, 300, 301, 420, 700)]
    rows = []
    for k in range(40):
        body = text(rng.randint(0, 400))
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(passages)
            at = rng.randint(0, len(body))
            body = body[:at] + p + body[at:]
        rows.append((k, body))
    rows += [(90, rows[0][1]), (91, rows[0][1]), (92, None), (93, ""), (None, passages[4]), rows[3], (94, passages[1]), (95, passages[1])]
    once = text(350)
    rows += [(96, once + text(60) + once), (97, "ab" * 400), (98, "xy" + "ab" * 300), (99, "z" * 900)]  # within a text, and periodic ones
    df = spark.createDataFrame(rows, "id bigint, text string").selectExpr("*", "1 as rep", "2 as t")
    members, _, pairs = spans.shared_spans(df, "id", "text", group=group)
    expected, t, w = brute_spans(rows, 300)
    assert {tuple(r) for r in spans.expand_pairs(members, pairs).collect()} == expected
    got = {r["id"]: r for r in spans.coverage(df, "id", "text", group=group).collect()}
    assert set(got) == set(t) and got[96]["shared_chars"] == 0
    reps = {k: min(o for o in t if t[o] == t[k]) for k in t}
    assert all(got[k]["links"] == len({reps[b if a == k else a] for a, b in expected if k in (a, b)} - {reps[k]}) for k in t)
    for k, v in t.items():
        hit = set()
        for i in range(len(v) - 299):
            if any(v[i : i + 300] in w[o] for o in t if o != k):
                hit |= set(range(i, i + 300))
        assert got[k]["shared_chars"] == len(hit), k


def test_alignment_against_plain():
    import numpy as np

    def plain(a, b):
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        run, best, longest = [[0] * (len(b) + 1) for _ in range(len(a) + 1)], 0, 0
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (leak.MATCH if x == y else leak.MISMATCH), h[i - 1][j] + leak.GAP, h[i][j - 1] + leak.GAP)
                run[i][j] = run[i - 1][j - 1] + 1 if x == y else 0
                best, longest = max(best, h[i][j]), max(longest, run[i][j])
        return best, longest

    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 14))] for _ in range(2))
        got = leak.align(np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64))
        assert (got[0], got[2]) == plain(a, b)


@pytest.mark.parametrize("broadcast", [0, 10**6])
@pytest.mark.parametrize("edited", [True, False])
def test_leaks(spark, broadcast, edited):
    rng = random.Random(6)
    voc = vocabulary(rng, 200)
    text = lambda n: [rng.choice(voc) for _ in range(n)]
    items = [(i, " ".join(text(rng.randint(5, 25))), " ".join(text(rng.randint(0, 30)))) for i in range(12)] + [(50, None, ""), (51, "short one", None)]
    docs = []
    for d in range(60):
        body = text(rng.randint(5, 60))
        src = (rng.choice(items)[1] or "").split()
        k = rng.choice([0, 8, 9, 10, 11, 15])
        docs.append((d, " ".join(body + src[:k] + text(5)) if d % 3 else ", ".join(body + [w.upper() for w in src[:k]])))
    docs += [(98, None), (99, ""), docs[1]]

    def grams(t):
        w = words(t)
        return {tuple(w[i : i + 10]) for i in range(len(w) - 9)}

    expected = {(d, i) for d, t in docs for i, q, a in items if grams(t) & (grams(q) | grams(a))}
    df = spark.createDataFrame(docs, "doc bigint, text string").selectExpr("*", "1 as item", "2 as side")
    it = spark.createDataFrame(items, "item bigint, question string, answer string").selectExpr("*", "3 as doc")
    got = leak.leaks(df, "doc", "text", it, "item", ["question", "answer"], edited=edited, block_words=broadcast)
    assert {(r["doc"], r["item"]) for r in got.where("longest_run >= 10").collect()} == expected


def test_very_long_texts(spark):
    rng = random.Random(1)
    voc = vocabulary(rng, 3000)
    long = " ".join(rng.choice(voc) for _ in range(60_000))
    other = long[:200_000] + " something else " + long[200_000:]
    df = spark.createDataFrame([(1, long), (2, other), (3, "short text of a few words only here now then and when")], "id bigint, text string")
    members, links = neardup.near_duplicates(df, "id", "text")
    assert {tuple(r) for r in neardup.expand_pairs(members, links).collect()} == {(1, 2)}
    m, _, p = spans.shared_spans(df, "id", "text")
    assert {tuple(r) for r in spans.expand_pairs(m, p).collect()} == {(1, 2)}
    item = spark.createDataFrame([(7, " ".join(long.split()[30_000:30_020]), None)], "item bigint, question string, answer string")
    got = leak.leaks(df, "id", "text", item, "item", ["question", "answer"]).collect()
    assert {(r["doc"], r["longest_run"]) for r in got} == {(1, 20), (2, 20)}


def test_alignments_at_once_are_those_one_by_one():
    import numpy as np

    rng = random.Random(12)
    pairs = [tuple(np.array([rng.randint(0, 6) for _ in range(rng.randint(0, 40))], dtype=np.int64) for _ in range(2)) for _ in range(400)]
    each = [leak.align(a, b)[:3] if len(a) and len(b) else (0, 0, 0) for a, b in pairs]
    assert [tuple(x) for x in leak.align_all(pairs).tolist()] == each
    assert leak.align_all(pairs, track=False)[:, 0].tolist() == [e[0] for e in each]


@pytest.mark.parametrize("broadcast", [200, 10**6])
def test_edited_leaks_against_brute_force(spark, broadcast):
    rng = random.Random(8)
    voc = vocabulary(rng, 150)
    text = lambda n: [rng.choice(voc) for _ in range(n)]
    items = [(i, " ".join(text(rng.randint(8, 45))), " ".join(text(rng.randint(0, 20)))) for i in range(15)]
    docs = [(100 + i, " ".join(text(9) + q.split() + text(4))) for i, q, _ in items]  # the exact item stands in one document
    for d in range(80):
        body, at = rng.choice(items)[1].split(), rng.randint(1, 4)
        step = rng.randint(2, 6)
        for j in range(len(body) - at, -1, -step):  # an edit every few words
            body[j : j + 1] = rng.choice([[], [rng.choice(voc)], ["new", body[j]]])
        docs.append((d, " ".join(text(rng.randint(0, 30)) + body + text(rng.randint(0, 30)))))
    h = lambda t: hash_texts([t])[0]
    expected = set()
    for d, t in docs:
        for i, *sides in items:
            for side, p in zip(("question", "answer"), sides):
                score, matched, longest, _ = leak.align(h(p), h(t)) if p else (0, 0, 0, 0)
                if score >= 20 or longest >= 10:
                    expected.add((d, i, side, score, matched, longest))
    assert sum(e[5] < 5 for e in expected) >= 5  # some share no five words in a row
    df = spark.createDataFrame(docs, "doc bigint, text string")
    it = spark.createDataFrame(items, "item bigint, question string, answer string")
    assert {tuple(r) for r in leak.leaks(df, "doc", "text", it, "item", ["question", "answer"], block_words=broadcast).collect()} == expected
    exact = leak.leaks(df, "doc", "text", it, "item", ["question", "answer"], edited=False, block_words=broadcast)
    assert {tuple(r) for r in exact.collect()} == {e for e in expected if e[5] >= 10}


def test_edited_copies_of_a_hot_text_are_found(spark):
    rng = random.Random(5)
    voc = vocabulary(rng, 2000)
    item = [rng.choice(voc) for _ in range(60)]
    docs, step = [(0, " ".join(item))], {}
    for d in range(1, 400):  # copies with an edit every 6 to 9 words, and a hot family with the same edits
        t = list(item)
        step[d] = 7 if d > 200 else rng.randint(6, 9)
        for j in range(step[d], 60, step[d]):
            t[j] = "edited" if d > 200 else rng.choice(voc)
        docs.append((d, " ".join([rng.choice(voc) for _ in range(20)] + t)))
    docs += [(1000 + d, " ".join(rng.choice(voc) for _ in range(80))) for d in range(200)]
    df = spark.createDataFrame(docs, "doc bigint, text string")
    it = spark.createDataFrame([(1, " ".join(item), None)], "item bigint, question string, answer string")
    got = {r["doc"]: r["longest_run"] for r in leak.leaks(df, "doc", "text", it, "item", ["question", "answer"]).collect()}
    assert set(got) == set(range(400)) and max(got[d] for d in range(1, 400)) < 10


def test_pairs_just_at_the_threshold_are_met(spark):
    rng = random.Random(3)
    voc = vocabulary(rng, 3000)
    rows = []
    for k in range(1500):  # 8 of 100 words exchanged: 74 of 98 sequences stay, a similarity of 0.607
        base = [rng.choice(voc) for _ in range(100)]
        other = list(base)
        for i in range(8):
            other[12 * i + 6] = rng.choice(voc)
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
    df = spark.createDataFrame(rows, "id bigint, text string")
    members, links = neardup.near_duplicates(df, "id", "text", 3, 0.6)
    grams = [set(zip(w, w[1:], w[2:])) for w in (t.split() for _, t in rows)]
    expected = {(2 * k, 2 * k + 1) for k in range(1500) if len(grams[2 * k] & grams[2 * k + 1]) >= 0.6 * len(grams[2 * k] | grams[2 * k + 1])}
    assert len(expected) > 1000
    got = {tuple(r) for r in neardup.expand_pairs(members, links).collect()}
    assert got <= expected and len(expected - got) <= 2  # 0.0003 of them by design
