import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.functions import embed
from paperloom.operators import retrieve


def test_hash_embedding_matches_definition(spark):
    import hashlib

    texts = [(1, "Dogs bark dogs"), (2, ""), (3, None), (4, " A b ")]
    got = {r[0]: r[1] for r in embed.hash_embedding(spark.createDataFrame(texts, "k int, t string"), "k", "t").collect()}
    for k, t in texts:
        v = np.zeros(64)
        for w in (t or "").lower().split():
            h = hashlib.sha256(w.encode()).digest()
            v[int.from_bytes(h[:4], "big") % 64] += 1 if h[4] % 2 == 0 else -1
        n = np.linalg.norm(v) or 1
        assert np.allclose(got[k], v / n), k


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_knn_against_brute_force(spark, metric, monkeypatch):
    monkeypatch.setattr(retrieve, "BLOCK", 7)
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.0, 0.0, 1.0, 2.0]) + 0.5 for _ in range(4)]) for i in range(40)] + [(99, None), (None, [1.0] * 4)]
    df = spark.createDataFrame(rows, "id int, v array<float>").withColumn("rank", F.lit("clash"))
    got = {}
    for r in retrieve.knn(df.where("id % 5 = 0"), df, "id", "id", "v", 6, metric).collect():
        got.setdefault(r["query"], []).append((r["rank"], r["id"]))
    vs = {i: np.array(v) for i, v in rows if v and i is not None}
    for q, hits in got.items():
        d = lambda i: round(float(((vs[q] - vs[i]) ** 2).sum()) if metric == "l2" else float(1 - vs[q] @ vs[i] / np.linalg.norm(vs[q]) / np.linalg.norm(vs[i])), 9)
        assert [i for _, i in sorted(hits)] == sorted(vs, key=lambda i: (d(i), i))[:6]
    assert set(got) == set(range(0, 40, 5))
    assert retrieve.knn(df.where("false"), df, "id", "id", "v", 3).count() == 0


def test_top_k_one_query(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.9, 0.1])], "id int, v array<double>")
    assert [r["id"] for r in retrieve.top_k(df, "id", "v", [1.0, 0.0], 2).collect()] == [1, 3]


def test_fusion(spark):
    rows = [("q", "a", 0, 1), ("q", "b", 0, 2), ("q", "b", 1, 1), ("q", "c", 1, 2), ("q", None, 1, 3)]
    got = retrieve.fuse_ranked(spark.createDataFrame(rows, "g string, i string, list int, rank int"), "g", "i", 2).orderBy("rank").collect()
    assert [r["i"] for r in got] == ["b", "a"] and got[0]["fusion_score"] == pytest.approx(1 / 61 + 1 / 62)


def test_reranking(spark):
    rows = [("q", "x", 1, "red dog", "a blue cat"), ("q", "y", 2, "red dog", "the red dog"), ("q", "z", 3, "red dog", None)]
    hits = spark.createDataFrame(rows, "query string, chunk_id string, rank int, query_text string, text string")
    assert [r["chunk_id"] for r in retrieve.lexical_rerank(hits, 2).orderBy("rank").collect()] == ["y", "x"]
    assert retrieve.get_reranker("off") is retrieve.no_rerank and retrieve.no_rerank(hits, 1).count() == 1
    with pytest.raises(ValueError):
        retrieve.get_reranker("nope")


def test_context(spark):
    rows = [("g", 2, "T", "d", "", "body", "10.1/x", "two"), ("g", 1, None, "d", "H", "body", None, "one")]
    df = spark.createDataFrame(rows, "g string, r int, title string, doc string, heading string, kind string, doi string, text string")
    b = retrieve.context_block(*[F.col(c) for c in ("title", "doc", "heading", "kind", "doi", "text")])
    got = retrieve.format_context(df.withColumn("b", b), "g", "r", "b").first()["context"]
    assert got == "[Source 1] d; H\none\n\n[Source 2] T; body; DOI: 10.1/x\ntwo"


def test_history(spark):
    turns = [("c", i, "user" if i % 2 == 0 else "system", f"q  {i}" if i != 4 else " ") for i in range(9)]
    df = spark.createDataFrame(turns, "c string, i int, role string, content string")
    r = retrieve.history_text(df, "c", ["i"]).first()
    assert r["history"].splitlines() == ["Assistant: q 3", "User: ", "Assistant: q 5", "User: q 6", "Assistant: q 7", "User: q 8"]
    assert r["user_questions"] == "- q 6\n- q 8"
    long = spark.createDataFrame([("c", 0, "user", "ab " * 600)], "c string, i int, role string, content string")
    assert retrieve.history_text(long, "c", ["i"]).first()["history"].endswith(" ...")


def test_strategies(spark):
    from paperloom.operators.strategies import Strategies, StrategyConfig

    chunks = spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(["red dogs bark", "blue cats sleep", "dogs and cats", "birds sing", "red birds"])], "chunk_id string, text string")
    vectors = embed.hash_embedding(chunks, "chunk_id", "text")
    q = [(1, "red dogs bark", "birds sing", '{"queries": ["blue cats sleep", "birds sing"]}', '{"sufficient": true}'), (2, "dogs", "blue cats sleep", "none", '{"sufficient": false, "improved_query": "birds sing"}')]
    s = Strategies(chunks, vectors, spark.createDataFrame(q, "item_id int, question string, passage string, query_json string, verdict_json string"), StrategyConfig(2, 4, 3, 3, 4))
    first = lambda name: {r["item_id"]: r["chunk_id"] for r in s.run(name).where("rank = 1").collect()}
    assert first("classic")[1] == "c0" and first("hyde") == {1: "c3", 2: "c1"} and first("hyde_reranked") == {1: "c3", 2: "c1"}
    assert first("reranked")[1] == "c0" and first("agentic")[2] == "c3" and first("agentic")[1] == "c0"
    assert s.run("multi_query").where("item_id = 1").count() == 2
    with pytest.raises(ValueError):
        s.run("other")


def test_vectors_meet_those_of_their_length(spark):
    rows = [(i, [float(i), 1.0]) for i in range(6)] + [(10 + i, [float(i), 1.0, 2.0]) for i in range(6)] + [(20, []), (21, None), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    got = retrieve.knn(df, df, "id", "id", "v", 2).collect()
    assert {r["query"] for r in got} == {*range(6), *range(10, 16)} and all(r["query"] // 10 == r["id"] // 10 for r in got)
    assert all(r["id"] == r["query"] for r in got if r["rank"] == 1)
