import pytest
from pyspark.sql import functions as F

from paperloom.operators import evaluate
from paperloom.operators.relational import as_number, collect_outer, forward_fill_group, keep_first, last_write_wins, rank_in_groups, upsert

CHUNKS = "chunks array<struct<document_id:string,title:string,source_identifier:string,doi:string>>, expected array<string>"


def test_question_groups(spark):
    rows = [(0, None, None, None, "lost", None), (1, "1.0", "What?", "narrow ", "A1", "s1"), (2, " ", None, None, "A2", "s2"), (3, "", "", None, "A3", "s1"), (4, None, "Second?", None, "", None), (5, "x", "", None, None, "s9")]
    df = spark.createDataFrame(rows, "item_id int, question_nr string, question string, question_type string, answer string, source string").withColumn("head", F.lit(1)).drop("head")
    got = evaluate.question_groups(df).orderBy("head").collect()
    assert [(r["question_id"], r["question"], r["reference_answers"], r["expected_sources"]) for r in got] == [("1", "What?", ["A1", "A2", "A3"], ["s1", "s2"]), ("2", "Second?", [], []), ("x", "", [], ["s9"])]
    assert evaluate.question_groups(df.where("false")).count() == 0


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_forward_fill_over_ranges(spark, parts):
    df = spark.createDataFrame([(i, i % 7 == 3) for i in range(50)], "i int, h boolean")
    got = {r["i"]: (r["head"], r["ordinal"]) for r in forward_fill_group(df, "i", F.col("h"), parts).collect()}
    assert got == {i: (max((j for j in range(i + 1) if j % 7 == 3), default=None), sum(j % 7 == 3 for j in range(i + 1))) for i in range(50)}


@pytest.mark.parametrize("competition", [False, True])
def test_rank_in_groups(spark, competition):
    import random

    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.7 else f"g{i % 5}", i, float(rng.randint(0, 60))) for i in range(400)]
    got = rank_in_groups(spark.createDataFrame(rows, "g string, i int, s double"), ["g"], "s", [F.asc("i")], "r", 7, competition).collect()
    for r in got:
        own = [(-s, i) for g, i, s in rows if g == r["g"]]
        assert r["r"] == 1 + (sum(o[0] < -r["s"] for o in own) if competition else sorted(own).index((-r["s"], r["i"])))
    assert len(got) == 400


def test_metrics(spark):
    c = [(None, "Wrong one", None, None), (None, "Dogs and owners", None, None), ("dogs-and-owners.pdf", None, None, "10.1/a")]
    rows = [(c, ["Dogs and owners", "Missing"]), (c, []), (None, ["x"]), ([], None)]
    df = spark.createDataFrame(rows, CHUNKS)
    got = df.select(*[v.alias(k) for k, v in evaluate.retrieval_metrics(F.col("chunks"), F.col("expected")).items()]).collect()
    assert (got[0]["retrieval_recall"], got[0]["retrieval_precision"], got[0]["mrr"], got[0]["matched_source_count"]) == (0.5, 0.5, 0.5, 1)
    assert got[1]["retrieved_source_count"] == 2 and got[1]["mrr"] == 0.0
    assert got[2]["expected_source_count"] == 1 and got[2]["retrieval_recall"] == 0.0 and got[3]["expected_source_count"] == 0


def judge(spark, raw):
    return spark.createDataFrame([(raw,)], "r string").select(evaluate.parse_judge(F.col("r")).alias("j")).first()["j"]


def test_parse_judge(spark):
    j = judge(spark, '```json\n{"faithfulness": 9, "completeness": "bad", "overall_quality": -1, "answer_relevance": "4.5", "reason": " ok "}\n```')
    assert (j["faithfulness"], j["completeness"], j["overall_quality"], j["answer_relevance"], j["reason"]) == (5.0, 0.0, 0.0, 4.5, "ok")
    assert judge(spark, "no json") is None and judge(spark, None) is None


def queries(spark, raw, q="orig", n=3):
    return spark.createDataFrame([(raw, q)], "r string, q string").select(evaluate.parse_query_list(F.col("r"), F.col("q"), n).alias("x")).first()["x"]


def test_query_list(spark):
    assert queries(spark, 'Here: {"queries": ["a", "A ", "b", "c"]}') == ["orig", "a", "b"]
    assert queries(spark, '["b", "orig"]') == ["b", "orig"]
    assert queries(spark, "nothing") == ["orig"]


def test_agent_decision(spark):
    d = lambda raw: tuple(spark.createDataFrame([(raw,)], "r string").select(evaluate.parse_agent_decision(F.col("r"), F.lit("q")).alias("d")).first()["d"])
    assert d('{"sufficient": true, "reason": "x"}') == (True, "x", "q")
    assert d('so {"sufficient": "false", "improved_query": "better"}')[0] is True
    assert d('{"sufficient": false, "improved_query": "better"}') == (False, "", "better")
    assert d("junk") == (False, "", "q")


def test_summaries(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("a", None), ("b", None)], "strategy string, m double")
    s = evaluate.valid_means(df, "strategy", ["m"])
    assert {tuple(r) for r in s.collect()} == {("a", 3, 1, 1.0), ("b", 1, 0, None)}
    assert evaluate.has_valid_metric(s).first()[0] is True and evaluate.has_valid_metric(s.where("false")).first()[0] is False


def test_collection(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "strategy string, n int")
    b = spark.createDataFrame([("y", 3), ("z", 4)], "strategy string, n int")
    assert {tuple(r) for r in collect_outer({"p": a, "q": b}, "strategy").collect()} == {("x", 1, None), ("y", 2, 3), ("z", None, 4)}
    w = spark.createDataFrame([("x", 1, 5, None), ("x", 2, None, 7), ("x", 3, 6, None)], "strategy string, run int, u int, v int")
    assert tuple(last_write_wins(w, "strategy", ["run"], ["u", "v"]).first()) == ("x", 6, 7)
    v = spark.createDataFrame([("1.23456",), ("nan",), ("",), (None,), ("x",)], "v string")
    assert [r[0] for r in v.select(as_number(F.col("v"))).collect()] == [1.2346, None, None, None, None]


def test_keep_first_and_upsert(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 1, "a"), (None, 1, "n")], "k int, o int, v string")
    assert {tuple(r) for r in keep_first(df, ["k"], ["o"]).collect()} == {(1, 1, "a"), (None, 1, "n")}
    new = spark.createDataFrame([(1, 9, "new"), (7, 7, "x")], "k int, o int, v string")
    assert {tuple(r) for r in upsert(df.where("k = 1").limit(1), new, "k").collect()} == {(1, 9, "new"), (7, 7, "x")}
