import pytest

from paperloom.config import RetrievalProfile
from paperloom.functions import embed, llm_text
from paperloom.operators import serve
from paperloom.sources import connectors

SECTIONS = "document_id string, sections array<struct<section_type:string,text:string>>, error string"


def test_search_and_chat(spark):
    chunks = spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(["red dogs bark", "blue cats sleep", "birds sing"])], "chunk_id string, text string")
    vectors = embed.hash_embedding(chunks, "chunk_id", "text")
    asked = spark.createDataFrame([(1, "blue cats sleep", "", ""), (2, " ", "", ""), (3, None, None, None)], "request_id int, query string, history string, user_questions string")
    p = RetrievalProfile(top_k=3, top_n=1)
    got = serve.search(asked, chunks, vectors, p).collect()
    assert [(r["request_id"], r["chunk_id"], r["rerank_score"]) for r in got] == [(1, "c1", 1.0)]
    plain = serve.search(asked, chunks, vectors, RetrievalProfile(top_k=3, top_n=2, reranker="off")).collect()
    assert len(plain) == 2 and plain[0]["rerank_score"] is None
    answers = {r["request_id"]: (r["answer"], r["sources"]) for r in serve.chat(asked, chunks, vectors, p).collect()}
    assert answers[1] == (llm_text.NO_ANSWER, 1) and answers[2][1] == 0 and answers[3] == (llm_text.NO_ANSWER, 0)
    assert tuple(serve.health(vectors, p).first()) == ("ok", 3, "reranked", 3, 1, True)


def test_identifiers(spark):
    req = spark.createDataFrame([("10.1/A",), ("doi:10.1/b",), ("10.1/c",), (None,)], "doi string")
    look = spark.createDataFrame([("10.1/a", "7", "PMC1"), ("10.1/b", "8", " "), ("10.1/b", "9", None)], "doi string, pmid string, pmcid string")
    assert {tuple(r) for r in connectors.resolve_identifiers(req, look).collect()} == {("10.1/a", "7", "PMC1", "full_text"), ("10.1/b", "8", None, "abstract_only"), ("10.1/c", None, None, "not_found")}


def test_fallback(spark):
    long, short = [("body", "x" * 300)], [("body", "x")]
    a = spark.createDataFrame([("ok", long, None), ("thin", short, None), ("down", None, "boom"), ("both", None, "boom")], SECTIONS)
    b = spark.createDataFrame([("thin", long, None), ("down", short, None), ("both", None, "bang"), ("only", short, None)], SECTIONS)
    got = {r["document_id"]: (r["fallback_used"], r["fallback_reason"], r["error"]) for r in connectors.with_fallback(a, b).collect()}
    assert got == {"ok": (False, None, None), "thin": (True, "too little structured text", None), "down": (True, "boom", None), "both": (True, "boom", "boom; bang"), "only": (True, "not tried", None)}


def test_service_and_resume(spark, tmp_path):
    def make():
        def client(texts):
            if any("bad" in t for t in texts):
                raise RuntimeError("refused")
            return [t.upper() for t in texts]

        return client

    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, t string")
    assert {tuple(r) for r in connectors.call_service(df, "id", "t", make).collect()} == {(1, "A", None), (2, "", None)}
    assert connectors.call_service(df.selectExpr("id", "'bad' t"), "id", "t", make).where("error like '%refused%'").count() == 2
    rows = spark.createDataFrame([("q1", "s", 1), ("q1", "s", 2), ("q2", "s", 3)], "question_id string, strategy string, score int")
    p = str(tmp_path / "judged")
    assert connectors.append_missing(rows.where("score <> 3"), p, ["question_id", "strategy"]).columns == rows.columns
    connectors.append_missing(rows, p, ["question_id", "strategy"])
    assert spark.read.parquet(p).count() == 2


def test_retries():
    from paperloom.errors import ServiceError

    waits, calls = [], []

    def send(*errors):
        left = list(errors)

        def run():
            calls.append(1)
            if left:
                raise left.pop(0)
            return ["ok"]

        return run

    again = lambda f, **k: connectors.with_retries(f, pause=waits.append, **k)
    assert again(send(ServiceError("x", 503), ServiceError("x", 429, "90"), ConnectionError("lost"))) == ["ok"] and waits == [10, 90, 30]
    with pytest.raises(ServiceError):
        again(send(ServiceError("bad", 400)))
    with pytest.raises(ServiceError):
        again(send(*[ServiceError("x", 500)] * 9), attempts=3)
    waits.clear()
    assert again(send(RuntimeError("RESOURCE_EXHAUSTED")), quota_wait=7) == ["ok"] and waits == [7]
    with pytest.raises(ConnectionError):
        again(send(ConnectionError("lost")), quota_wait=7)


def test_http_clients(spark):
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Handler(BaseHTTPRequestHandler):
        failed = False

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            if self.path == "/embeddings" and not Handler.failed:
                Handler.failed = True
                self.send_response(503)
                self.end_headers()
                return
            if self.path == "/embeddings":
                out = {"data": [{"index": i, "embedding": [len(t)]} for i, t in reversed(list(enumerate(body["input"])))]}
            elif self.path == "/chat/completions":
                out = {"choices": [{"message": {"content": body["messages"][0]["content"].upper()}}]}
            elif self.path == "/rerank":
                out = {"results": [{"index": i, "relevance_score": len(d)} for i, d in enumerate(body["documents"])][::-1]}
            else:
                out = {"nothing": 1}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(out).encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    df = spark.createDataFrame([(1, "ab"), (2, "c")], "id int, t string")
    got = connectors.embed_remote(df, "id", "t", lambda: connectors.embedding_service("openai", url, "m"), 1, quota_wait=0.0).collect()
    assert {r["id"]: r["embedding"] or "503" in r["error"] for r in got} in ({1: [2.0], 2: [1.0]}, {1: True, 2: True}, {1: [2.0], 2: True}, {1: True, 2: [1.0]})
    got = connectors.call_service(df, "id", "t", lambda: connectors.embedding_service("openai", url, "m"), 1).collect()
    assert {r["id"]: r["answer"] for r in got} == {1: "[2]", 2: "[1]"}
    assert connectors.chat_service(url, "m")(["a", "b"]) == ["A", "B"]
    assert connectors.rerank_service(url + "/rerank", "m")([json.dumps({"query": "q", "documents": ["aaa", "b"]})]) == ["[3, 1]"]
    assert connectors.call_service(df, "id", "t", lambda: connectors.embedding_service("ollama", url, "m"), 1, 1).where("error like 'ServiceError%'").count() == 2
    server.shutdown()


def test_judge(spark, tmp_path):
    from pyspark.sql import functions as F

    from paperloom import jobs
    from paperloom.operators import judge

    schema = "question_id string, strategy string, question string, answer string, reference_answer string, expected_sources array<string>, blocks array<struct<source:string,heading:string,text:string>>, contexts array<string>"
    rows = [("1", "a", "Why do dogs bark?", "Dogs bark.", "Dogs bark at night.", ["s"], [("s", "h", "word " * 4000)], ["Dogs bark at night."]), ("2", "a", None, None, None, None, None, None), ("3", "b", "bad", "x", "y", [], [], [])]
    df = spark.createDataFrame([*rows, rows[0]], schema)

    def model(d, k, t):  # refuses long prompts and one question
        bad = (F.length(t) > 8000) | F.col(t).contains("Question: bad")
        return d.select(k, F.when(~bad, F.lit('{"faithfulness": 9, "completeness": "3", "reason": " ok "}')).alias("answer"), F.when(bad, F.lit("too long")).alias("error"))

    got = {r["question_id"]: r for r in judge.judge_answers(df, model, 12_000).collect()}
    assert len(got) == 3 and got["1"]["faithfulness"] == 5.0 and got["1"]["completeness"] == 3.0 and got["1"]["reason"] == "ok" and got["1"]["error"] is None
    assert got["2"]["error"] is None and got["3"]["error"] == "too long" and got["3"]["faithfulness"] is None
    out = str(tmp_path / "j")
    assert {r["strategy"]: r["n_questions"] for r in jobs.run_judge(spark, df, model, out).collect()} == {"a": 2}
    assert jobs.run_judge(spark, df, model, out).count() == 1 and spark.read.parquet(out).count() == 2
    m = {r["question_id"]: r for r in judge.support_metrics(df).collect()}
    assert m["1"]["faithfulness"] == 1.0 and m["1"]["context_recall"] == 1.0 and m["1"]["context_precision"] == 1.0 and m["1"]["answer_relevancy"] == 0.5 and m["2"]["faithfulness"] is None
    assert jobs.run_ragas(spark, df, str(tmp_path / "r")).count() == 2
    scored = judge.remote_metrics(df, lambda d, k, t: d.select(k, F.lit('{"faithfulness": 0.5, "context_recall": "NaN"}').alias("answer"), F.lit(None).cast("string").alias("error"))).first()
    assert scored["faithfulness"] == 0.5 and scored["context_recall"] is None
