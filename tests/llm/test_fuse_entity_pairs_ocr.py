import random

from paperloom.llm import entity, ocr, pairs, rankfuse

WORDS = "dogs owners attention kennel reward playback sessions analysis urban rural gaze duration salivary cortisol behaviour response inhibition training hearing vigilance barking intensity measured observers".split()


def test_fusion_against_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for run in range(30):
        for s in range(rng.randint(1, 7)):
            rows.append((run, f"s{s}", *[rng.choice([None, float("nan"), rng.randint(0, 4) * scale, rng.random() * scale]) for scale in (5.0, 1.0, 100.0)]))
    rows += [rows[0], (None, "s0", 1.0, 1.0, 1.0), (1, None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "run_id bigint, strategy string, a double, b double, c double").selectExpr("*", "1 as rank", "2 as s")
    fused = rankfuse.fuse_scores(df, "run_id", "strategy", ["a", "b", "c"])
    got = {r["run_id"]: r["strategy"] for r in rankfuse.winners(fused, "run_id", "strategy").collect()}
    ranked = {(r["run_id"], r["fused_rank"]): r["strategy"] for r in rankfuse.ranking(fused, "run_id", "strategy").collect()}
    table = {}
    for g, i, *v in rows:
        if g is not None and i is not None:
            table.setdefault(g, {})[i] = [x if x is not None and x == x else None for x in v]
    for g, items in table.items():
        total = {}
        for i, v in items.items():
            f = z = 0.0
            for k, x in enumerate(v):
                col = [o[k] for o in items.values() if o[k] is not None]
                if x is not None:
                    f += 1 / (60 + 1 + sum(y > x for y in col))
                    z += (x - min(col)) / (max(col) - min(col)) if max(col) > min(col) else 0.5
            total[i] = (-round(f, 12), -round(z, 9), i)
        best = sorted(total.values())
        assert got[g] == best[0][2] and [ranked[g, n + 1] for n in range(len(best))] == [b[2] for b in best]
    assert rankfuse.winners(rankfuse.fuse_scores(df.where("false"), "run_id", "strategy", ["a"]), "run_id", "strategy").count() == 0


TITLE_WORDS = [a + b for a in ("kel", "sor", "vib", "tan", "ol", "grem", "dis", "mont", "par", "ul", "fen", "cas", "rid", "hov", "em") for b in ("ation", "ity", "ment", "ance", "ing", "ure", "ism", "ery", "age", "hood", "ics", "ide")]
SCHEMA = "id bigint, title string, authors array<string>, doi string, journal string, date string"


def papers(rng, n):
    surnames = [a + b for a in ("Kro", "Vas", "Til", "Mor", "Zan", "Pel", "Gru", "Dax") for b in ("bek", "lund", "stein", "ford", "nitz", "vale", "mark", "holm")]
    out = []
    for i in range(n):
        title = " ".join(rng.sample(TITLE_WORDS, 7) + rng.sample(WORDS[:2], 1))
        out.append((i, title, [f"Ann {rng.choice(surnames)}", f"Bo {rng.choice(surnames)}"], f"10.9000/x.{2000 + i % 20}.{1000 + i}", rng.choice(["Annals of Dog Studies", "Letters of Kennels"]), f"{2000 + i % 20}-03-04"))
    return out


def test_matching(spark):
    rng = random.Random(12)
    base = papers(rng, 120)
    src, truth = [], set()
    for k, (i, t, a, d, j, y) in enumerate(base[:80] * 2):
        kind = rng.randrange(6)
        title = [t, t.upper(), " ".join(t.split()[:5]), t.replace("dogs", "dgos"), None, t][kind]
        authors = [a, [x.split()[1] + ", A." for x in a], None, a[:1], a, list(reversed(a))][kind]
        doi = [None, "https://doi.org/" + d.upper(), d, None, d[:-1] + "O", ""][kind]
        src.append((1000 + k, title, authors, doi, [j, "Ann. Dog. Stu." if j.startswith("A") else "Let. Ken.", None][k % 3], y[:4] if kind != 5 else None))
        truth.add((i, 1000 + k))
    for k, (_, t, _, _, j, y) in enumerate(papers(random.Random(99), 40)):
        src.append((5000 + k, t, ["Zed Other"], f"10.9000/y.1990.{9000 + k}", j, "1990"))
    src += [(9000, None, None, None, None, None), (None, base[0][1], None, base[0][3], None, None), src[0]]
    left = spark.createDataFrame(src, SCHEMA).selectExpr("*", "1 as theta", "2 as l")
    right = spark.createDataFrame([*base, base[0], (777, "", [], "", "", "")], SCHEMA)
    got = {(r["r"], r["l"]) for r in entity.match_records(left, right).where("confidence >= 0.5").collect()}
    assert len(got & truth) / len(truth) >= 0.97 and len(got - truth) <= 2, (truth - got, got - truth)
    assert entity.match_records(left.where("false"), right).count() == 0 and entity.match_records(left, right.where("false")).count() == 0


def test_one_record_takes_one_work(spark):
    rows = [(1, 10, 3.0, None), (1, 11, 3.0, None), (2, 10, 4.0, "a"), (3, 10, 1.0, "b"), (4, 12, 2.0, "a"), (5, 12, 2.0, "a")]
    got = {(r["l"], r["r"]): r["confidence"] for r in entity.propagate(spark.createDataFrame(rows, "l bigint, r bigint, theta double, claim string")).collect()}
    assert got[1, 10] + got[1, 11] < 1.0 and abs(got[1, 10] - got[1, 11]) < 1e-6
    assert got[2, 10] > 0.9 and got[3, 10] < 0.1  # rival claims of one work
    assert got[4, 12] > 0.8 and got[5, 12] > 0.8  # the same claim recurs


def test_defects(spark):
    rng = random.Random(3)
    q = lambda: f"How does {rng.choice(WORDS)} change {rng.choice(WORDS)} of {rng.choice(WORDS)} dogs in the {rng.choice(WORDS)} test at {rng.randint(1, 99)} weeks?"
    s = lambda: f"The sources report that {rng.choice(WORDS)} and {rng.choice(WORDS)} were higher for the dogs with {rng.choice(WORDS)} in {rng.randint(2, 90)} trials."
    de = lambda: f"Die Quellen berichten, dass die Hunde mit {rng.choice(WORDS)} nach {rng.randint(2, 90)} Tagen ruhiger waren und sich das nicht mehr änderte."
    rows, truth = [], {}
    for i in range(900):
        ask, answer = q(), " ".join(s() for _ in range(rng.randint(1, 4)))
        if i % 10 == 7:
            ask, answer = f"Wie wirkt {rng.choice(WORDS)} auf die Hunde und was ist nach {i} Tagen mit der Ruhe?", " ".join(de() for _ in range(rng.randint(1, 3)))
        rows.append([i, ask, answer])
    for k, i in enumerate(range(0, 900, 10)):
        kind = pairs.LABELS[k % 5]
        ask, answer = rows[i][1:]
        rows[i][2] = {"empty_answer": rng.choice(["", None, "N/A", "...", " \t"]), "refusal": rng.choice(["I cannot answer this question.", "Sorry, I am unable to help with that."]), "truncated_answer": " ".join(answer.split()[:-4]) + " was", "copied_question": rng.choice([ask, f"You asked: {ask.lower()}"]), "other_language": de()}[kind]
        truth[i] = kind
    rows += [list(rows[0]), [None, "q", "a"], [5000, None, None]]
    truth[5000] = "empty_answer"
    df = spark.createDataFrame([tuple(r) for r in rows], "id bigint, q string, a string").selectExpr("*", "1 as k", "2 as defect")
    got = {r["id"]: r["defect"] for r in pairs.defects(df, "id", "q", "a").collect()}
    right = sum(got.get(i) == k for i, k in truth.items())
    assert right / len(truth) >= 0.95 and len(set(got) - set(truth)) <= 5, ({i: (k, got.get(i)) for i, k in truth.items() if got.get(i) != k}, set(got) - set(truth))


def test_defects_of_nothing(spark):
    df = spark.createDataFrame([], "id bigint, q string, a string")
    assert pairs.defects(df, "id", "q", "a").count() == 0


DOC = "document_id string, metadata struct<title:string,journal:string,authors:array<string>>, sections array<struct<section_type:string,heading:string,text:string,order:int,level:int>>"


def scanned(rng):
    rows, truth = [], set()
    sentence = lambda: ("The " + " ".join(rng.choice(WORDS) for _ in range(rng.randint(8, 14))) + ".")
    for d in range(120):
        meta = (" ".join(rng.sample(WORDS, 6)).capitalize(), "Annals of Dog Studies", ["Ann Krobek"])
        sections = []
        for o in range(3):
            text = " ".join(sentence() for _ in range(8))
            if d % 3 == 0:
                kinds = set(rng.sample(["hyphen", "misread", "running_head", "page_number"], rng.randint(0, 2)))
                lines = ocr._wrapped(text, rng, "hyphen" in kinds)
                if "hyphen" in kinds and not any(e == "join" for _, e in lines):
                    kinds.discard("hyphen")
                lines = [x for x, _ in lines]
                if "misread" in kinds:
                    k = rng.randrange(len(lines))
                    lines[k] = lines[k].replace("e", "c", 1) if "the" not in lines[k][:4] else lines[k]
                    w = [x for x in WORDS if "m" in x]
                    lines[k] += " " + rng.choice(w).replace("m", "rn")
                if "running_head" in kinds:
                    lines.insert(len(lines) // 2, rng.choice(["Krobek / Annals of Dog Studies", "Annals of Dog Studies 12 (2010)"]))
                if "page_number" in kinds:
                    lines.insert(len(lines) // 3, rng.choice(["- 17 -", "[203]", "S41"]))
                text = "\n".join(lines)
                truth |= {(f"d{d}", o, k) for k in kinds}
            sections.append(("body", "H", text, o, 1))
        rows.append((f"d{d}", meta, sections))
    return rows, truth


def test_scan_noise(spark):
    rows, truth = scanned(random.Random(21))
    rows += [rows[0], ("n1", None, None), (None, None, rows[0][2]), ("n2", (None, None, None), [("body", None, None, None, 1), ("body", "", "", 1, 1)])]
    df = spark.createDataFrame(rows, DOC)
    got = {tuple(r) for r in ocr.scan_noise(df).collect()}
    assert len(got & truth) / len(truth) >= 0.93 and len(got - truth) <= 0.07 * len(truth), (truth - got, got - truth)
    fixed = {(r["document_id"], r["section_order"]): r for r in ocr.repair_sections(df).collect()}
    assert ("n1", 0) not in fixed and fixed["n2", None]["repaired"] is None
    for d, o, kind in truth:
        if kind in ("running_head", "page_number", "hyphen"):
            assert "Annals of Dog" not in fixed[d, o]["repaired"] or kind != "running_head"
    clean = [r for (d, o), r in fixed.items() if d == "d1"]
    assert all(r["text"] == r["repaired"] for r in clean)


def test_editor_learns_its_confusions():
    model = ocr.train_editor([(w, 50) for w in WORDS])
    assert all(ocr.edit(model, w) == w for w in WORDS)
    assert ocr.edit(model, "kcnnel") == "kennel" and ocr.edit(model, "0wners") == "owners"


def test_no_documents(spark):
    df = spark.createDataFrame([], DOC)
    assert ocr.scan_noise(df).count() == 0 and ocr.repair_sections(df).count() == 0


def test_words_and_compounds():
    texts = ["The owner-re-\nported 0f x_y naïve-Bayes café — “quoted” 日本 end-", "", "-a b-", "plain words only"]
    for t in texts:
        whole = ocr._BROKEN.sub("", t)
        assert {w.decode() for w in ocr.whole_words(t)} == set(ocr.plain_words(whole)), t
    assert ocr.compounds("State-of-the-art non-\nbreaking naïve-Bayes 3-d - a-b") == {b"state-of", b"of-the", b"the-art", "naïve-bayes".encode(), b"a-b"}


def test_short_misread_words_are_repaired(spark):
    rng = random.Random(3)
    rows = []
    for d in range(150):
        text = " ".join(f"The {rng.choice(WORDS)} of {rng.choice(WORDS)} in the {rng.choice(WORDS)}." for _ in range(20))
        rows.append((f"d{d}", None, [("body", "H", text if d else text.replace(" of ", " 0f ", 1) + "\nand more", 0, 1)]))
    df = spark.createDataFrame(rows, DOC)
    assert {tuple(r) for r in ocr.scan_noise(df).where("noise = 'misread'").collect()} == {("d0", 0, "misread")}
    fixed = ocr.repair_sections(df).where("document_id = 'd0'").first()["repaired"]
    assert "0f" not in fixed and fixed.split()[2] == "of"


def test_word_hashes_are_the_engines(spark):
    words = ["dog", "", "über", "a" * 100]
    got = {r["w"]: r["h"] for r in spark.createDataFrame([(w,) for w in words], "w string").selectExpr("w", "xxhash64(w) as h").collect()}
    assert got == {w: entity.word_hash(w) for w in words}


def test_words_beyond_the_spelling_list_keep_their_counts():
    import numpy as np

    counts = {"dog": 900, "gaze": 40, "cortisol": 7}
    t = entity.Titles({"dog": 900}, np.array([entity.word_hash(w) for w in counts], dtype=np.int64), np.array(list(counts.values())), 1000)
    assert [t.df(w) for w in ("dog", "gaze", "cortisol", "zzz")] == [900, 40, 7, 0] and t.canonical("dogg") == "dog" and t.canonical("gaz") == "gaz"
    long = [f"word{i}x" for i in range(300)]
    assert t.compare(long, [w[:-1] + "yx" for w in long]) == entity.TITLE_MOST  # typing errors are found in titles of any length
    keys = [dict((k, p) for p, k in entity._keys((" ".join(f"w{i}" for i in range(n)), None, None, None, None), t, True)) for n in (5, 6, 12)]
    assert any("w11" in k for k in keys[2]) and [set(x.values()) for x in keys] == [{60}, {30}, {10}]


def test_titles_alone_need_four_words(spark):
    rng = random.Random(4)
    base = papers(rng, 12)
    src = [(1000 + i, " ".join(t.split()[:4]), None, None, None, None) for i, t, *_ in base]
    got = {(r["l"], r["r"]) for r in entity.match_records(spark.createDataFrame(src, SCHEMA), spark.createDataFrame(base, SCHEMA)).collect()}
    assert {(1000 + i, i) for i in range(12)} <= got


def test_only_pairs_that_can_match_leave_the_join_of_keys(spark):
    from collections import Counter

    import numpy as np

    rng = random.Random(8)
    phrases = [" ".join("".join(rng.choices("abcdefghiklmnoprstuvw", k=8)) for _ in range(4)) for _ in range(60)]
    base = [(i, " ".join(rng.sample(phrases, 2)), *rest) for i, _, *rest in papers(rng, 300)]
    src = []
    for i, t, a, d, j, y in base:
        ws, who = t.split(), a[0].split()[1]
        src += [(1000 + i, t.replace(ws[2], ws[2][:-1]), [who[:-1] + "x, A."], d.replace("0", "O", 1) if i % 3 else None, j, y), (2000 + i, ws[0] + t[len(ws[0]) + 1 :], [f"ann{who}"], None, None, y if i % 2 else None)]
        src += [(3000 + i, " ".join(ws[:6]), None, None, j, None), (4000 + i, None, a[:1], None, None, y)]
    counts = Counter(w for r in base for w in set(entity.title_words(r[1])))
    titles = entity.Titles(dict(counts), np.array([entity.word_hash(w) for w in counts], dtype=np.int64), np.array(list(counts.values())), len(base))
    surnames = sorted({one[-1] for r in base for one in entity.name_tokens(r[2])})
    keyed: dict = {}
    for r in base:
        for _, k in entity._keys(r[1:], titles, False):
            keyed.setdefault(k, []).append(r)
    pairs, expected = 0, set()
    for s in src:
        points: Counter = Counter()
        for p, k in entity._keys(s[1:], titles, True):
            for r in keyed.get(k, ()):
                points[r[0]] += p
        pairs += len(points)
        a = entity.Record(*s[1:], titles)
        expected |= {(s[0], i) for i, p in points.items() if p >= entity.MEET and entity.score(a, entity.Record(*base[i][1:], titles), titles) > entity.FLOOR}
    left, right = spark.createDataFrame(src, SCHEMA), spark.createDataFrame(base, SCHEMA)
    for known in (surnames, None):  # names that are too many to be listed cost time, never pairs
        assert {(r["l"], r["r"]) for r in entity.candidates(left, right, titles, known).collect()} == expected
    shared = spark.sparkContext.broadcast((titles.spelling, titles.hashes, titles.counts, titles.total, surnames))
    met = entity.meetings(left, right, titles, shared).select("l", "r").distinct().count()
    assert len(expected) > 600 and met < pairs / 2, (len(expected), met, pairs)


def test_messages_that_never_settle_are_an_error(spark):
    import pytest

    rows = spark.createDataFrame([(1, 10, 3.0, None), (1, 11, 2.9, None), (2, 10, 2.0, None)], "l bigint, r bigint, theta double, claim string")
    with pytest.raises(RuntimeError):
        entity.propagate(rows, rounds=1, tolerance=1e-9)
