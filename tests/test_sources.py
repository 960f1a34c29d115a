import json

import pytest
from pyspark.sql import functions as F

from paperloom import jobs
from paperloom.config import ChunkConfig, RetrievalProfile, env_bool, env_number
from paperloom.functions import llm_text
from paperloom.sources import readers, sinks

DOC = {"document_id": "d1", "schema_version": "1.0", "source_type": "pdf", "source_identifier": "x", "extraction_method": "m", "metadata": {"title": "T", "doi": "10.1/x", "authors": []}, "sections": [{"section_type": "body", "heading": "R", "text": "Dogs bark. Cats sleep.", "order": 0, "level": 1}], "references": [], "warnings": [], "provenance": {}}


def test_documents_chunks_and_store(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/a.json").write_text(json.dumps(DOC, indent=1))
    (tmp_path / "docs/b.json").write_text("{broken")
    good, bad = readers.read_documents(spark, str(tmp_path / "docs"))
    assert good.count() == 1 and bad.count() == 1
    m = jobs.run_chunk(spark, str(tmp_path / "docs/a.json"), str(tmp_path / "chunks"), ChunkConfig())
    assert [tuple(r) for r in m.collect()] == [("d1", 1, 6)]
    store = sinks.VectorStore(spark, str(tmp_path / "store"))
    assert store.read().count() == 0
    assert jobs.run_upload(spark, str(tmp_path / "chunks"), store) == {"considered": 1, "uploaded": 1, "skipped": 0}
    assert jobs.run_upload(spark, str(tmp_path / "chunks"), store, skip_existing=True)["skipped"] == 1
    assert jobs.run_upload(spark, str(tmp_path / "chunks"), store, check_only=True) == {"count": 1, "dimensions": 64}
    with pytest.raises(ValueError):
        jobs.run_upload(spark, str(tmp_path / "chunks"), store, reset=True, check_only=True)
    store.reset()
    assert store.preflight()["count"] == 0


def test_chunk_without_id_fails(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"chunk_id": "a", "text": ""}\n\n{"text": ""}\n')
    with pytest.raises(Exception, match="no chunk_id"):
        readers.read_chunks(spark, str(tmp_path / "c.jsonl")).collect()


def test_absent_inputs(spark, tmp_path):
    assert readers.scan_pdfs(spark, str(tmp_path / "none")).count() == 0
    assert readers.read_csv_or_empty(spark, str(tmp_path / "none.csv"), "a string").count() == 0
    assert readers.load_manifest(spark, str(tmp_path / "m")).count() == 0
    (tmp_path / "a.json").write_text(json.dumps(DOC))
    assert readers.load_manifest(spark, str(tmp_path / "m"), str(tmp_path / "a.json")).first()["source_key"] == "doi:10.1/x"
    (tmp_path / "x.pdf").write_bytes(b"abc")
    assert readers.scan_pdfs(spark, str(tmp_path)).count() == 1


def test_questions_csv(spark, tmp_path):
    (tmp_path / "q.csv").write_text('Question Nr,Question,Type (narrow/broad),Answer,Source\n1.0,"What, and why?",narrow,A1,s1\n,,,A2,s2\n')
    from paperloom.operators.evaluate import question_groups

    r = question_groups(readers.read_questions(spark, str(tmp_path / "q.csv"))).first()
    assert (r["question_id"], r["question"], r["reference_answers"], r["expected_sources"]) == ("1", "What, and why?", ["A1", "A2"], ["s1", "s2"])


def test_extract_job(spark, tmp_path):
    xml = "<article><front><article-meta><article-title>T</article-title></article-meta></front></article>"
    files = spark.createDataFrame([("a", bytearray(xml.encode())), ("b", bytearray(b"<broken"))], "path string, content binary")
    args = ("jats", str(tmp_path / "m"), str(tmp_path / "out"))
    assert {r["path"]: r["status"] for r in jobs.run_extract(spark, files, *args).collect()} == {"a": "new_pdf", "b": "failed"}
    assert readers.load_manifest(spark, str(tmp_path / "m")).count() == 1
    assert {r["path"]: r["status"] for r in jobs.run_extract(spark, files.where("path = 'a'"), *args).collect()} == {"a": "unchanged_pdf"}


def test_writers(spark, tmp_path):
    a = spark.createDataFrame([("x", 1)], "strategy string, n int")
    b = spark.createDataFrame([("y", 2.0)], "strategy string, m double")
    u = sinks.union_columns([a, b], ["m", "strategy"])
    assert u.columns == ["m", "strategy", "n"] and sinks.markdown(a, ["strategy", "zz", "n"]) == "| strategy | n |\n| --- | --- |\n| x | 1 |"
    for kind in ("json", "csv", "parquet"):
        sinks.write_table(a, str(tmp_path / kind), kind)
    docs = a.selectExpr("strategy as document_id", "'<x/>' as raw_xml")
    sinks.write_documents(docs, str(tmp_path / "d"))
    assert spark.read.json(str(tmp_path / "d")).columns == ["document_id"] and spark.read.parquet(str(tmp_path / "d_xml")).count() == 1


def test_stream(spark, tmp_path):
    from paperloom.streaming.ingest import index_stream, stream_documents

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(json.dumps(DOC))
    store = sinks.VectorStore(spark, str(tmp_path / "store"))
    for n in (1, 1):
        index_stream(stream_documents(spark, str(tmp_path / "in")), store, str(tmp_path / "ck")).awaitTermination()
        assert store.read().count() == n


def test_settings(monkeypatch):
    monkeypatch.setenv("X_B", " Yes ")
    monkeypatch.setenv("X_N", " ")
    assert env_bool("X_B") and not env_bool("X_NONE") and env_number("X_N", 5) == 5
    assert RetrievalProfile().resolve(5, 5, False) == (20, 8, True)
    assert RetrievalProfile(allow_overrides=True, reranker="off").resolve(0, 3, None) == (20, 3, False)


def test_model_texts(spark):
    from pyspark.sql import functions as F

    rows = [('{"choices": [{"message": {"content": " hi "}}]}',), ('{"output": [{"content": [{"text": "yo"}]}]}',), ("{}",), (None,)]
    assert [r[0] for r in spark.createDataFrame(rows, "p string").select(llm_text.message_text(F.col("p"))).collect()] == ["hi", "yo", "", ""]
    assert llm_text.is_quota_error("RESOURCE_EXHAUSTED") and not llm_text.is_quota_error("bad") and llm_text.is_retriable(503) and not llm_text.is_retriable(404)
    assert llm_text.retry_wait(2) == 20 and llm_text.retry_wait(50) == 120 and llm_text.retry_wait(1, "33") == 33 and llm_text.retry_wait(1, "x") == 10
    p = spark.createDataFrame([("q", "c")], "q string, c string").select(llm_text.mock_generate(llm_text.agent_prompt(F.col("q"), F.col("c"))).alias("a"), llm_text.mock_generate(llm_text.answer_prompt(F.col("q"), F.col("c"))).alias("b")).first()
    assert "sufficient" in p["a"] and p["b"] == llm_text.NO_ANSWER


def test_evaluation_jobs(spark, tmp_path):
    from paperloom.functions import embed

    chunks = spark.createDataFrame([("c1", "dogs_2010", "red dogs bark"), ("c2", "cats_2011", "blue cats sleep")], "chunk_id string, document_id string, text string")
    store = sinks.VectorStore(spark, str(tmp_path / "store"))
    store.upsert(chunks.join(embed.hash_embedding(chunks, "chunk_id", "text"), "chunk_id"))
    q = spark.createDataFrame([(1, "red dogs", "red dogs bark", "none", "none", ["dogs_2010.pdf"]), (2, "cats", "blue cats sleep", "none", "none", ["other.pdf"])], "item_id int, question string, passage string, query_json string, verdict_json string, expected_sources array<string>")
    out = str(tmp_path / "results")
    got = {r["strategy"]: r for r in jobs.run_evaluate(spark, q, store, out, ("classic", "hyde")).collect()}
    assert set(got) == {"classic", "hyde"} and got["hyde"]["mean_retrieval_recall"] == 0.5 and got["hyde"]["mean_mrr"] == 0.5
    assert jobs.run_evaluate(spark, q, store, out, ("classic",)).count() == 2 and spark.read.parquet(out).count() == 4
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    sinks.write_table(spark.createDataFrame([("classic", "4.0", "nan")], "strategy string, faithfulness string, completeness string"), a, "csv")
    sinks.write_table(spark.createDataFrame([("classic", "", "3"), ("other", "1", "")], "strategy string, faithfulness string, completeness string"), b, "csv")
    c = {r["strategy"]: r.asDict() for r in jobs.run_collect(spark, [f"{out}_summary"], [a, b], [], str(tmp_path / "final")).collect()}
    assert c["classic"]["judge_faithfulness"] == 4.0 and c["classic"]["judge_completeness"] == 3.0 and c["classic"]["custom_mean_mrr"] is not None and c["other"]["judge_completeness"] is None


def test_judge_budgets():
    assert llm_text.judge_budgets(12000) == (12000, 6000) and llm_text.judge_budgets(4000) == (4000, 3000)


def test_a_broken_store_is_no_empty_store(spark, tmp_path):
    rows = spark.createDataFrame([(f"c{i}", "d", "t", [float(i)]) for i in range(50)], sinks.VectorStore.SCHEMA)
    store = sinks.VectorStore(spark, str(tmp_path / "s"), buckets=4)
    store.upsert(rows)
    before = sinks.current_parts(spark, str(tmp_path / "s"))
    store.upsert(rows.where("chunk_id = 'c7'").withColumn("text", F.lit("new")))
    after = sinks.current_parts(spark, str(tmp_path / "s"))
    assert sum(before[k] != after[k] for k in before) == 1  # only the bucket of that key was written
    got = {r["chunk_id"]: r["text"] for r in sinks.VectorStore(spark, str(tmp_path / "s")).read().collect()}
    assert len(got) == 50 and got["c7"] == "new" and got["c8"] == "t"
    for part in after.values():
        for f in (tmp_path / "s").glob(f"{part}/*.parquet"):
            f.write_bytes(b"broken")
    with pytest.raises(Exception):
        store.upsert(rows)
    assert sinks.current_parts(spark, str(tmp_path / "s")) == after


def test_a_table_is_swapped_as_a_whole(spark, tmp_path):
    path = str(tmp_path / "t")
    assert sinks.read_table(spark, path) is None
    for n in (1, 2, 3):
        old = sinks.read_table(spark, path)
        sinks.replace_table(spark.range(n), path)
        assert sinks.read_table(spark, path).count() == n and (old is None or old.count() == n - 1)  # readers of the old version go on
    assert len(list((tmp_path / "t").glob("v-*"))) == 2
    spark.range(4).write.parquet(str(tmp_path / "plain"))
    assert sinks.read_table(spark, str(tmp_path / "plain")).count() == 4


def test_command_line(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.xml").write_text("<article><front><article-meta><article-title>T</article-title></article-meta></front><body><p>Dogs bark.</p></body></article>")
    args = ["extract", "jats", str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "m")]
    assert jobs.main(args) == 0 and readers.load_manifest(spark, str(tmp_path / "m")).count() == 1
    (tmp_path / "in/b.xml").write_text("<broken")
    assert jobs.main(args) == 1 and spark.read.json(str(tmp_path / "out")).count() == 1


def test_settings_and_keys():
    from paperloom.config import Settings, api_key_accepted
    from paperloom.errors import ConfigurationError

    s = Settings.load({"LLM_PROVIDER": "OpenAI_Compatible", "LLM_MODEL_NAME": "m", "OPENAI_COMPATIBLE_MODEL": " own ", "RETRIEVAL_TOP_K": " ", "OPENAI_API_KEY": "k"})
    assert s.active_model == "own" and s.retrieval_top_k == 20 and s.key("X_API_KEY", "OPENAI_API_KEY") == "k" and Settings.load({"LLM_MODEL_NAME": "m"}).active_model == "m"
    for bad in (lambda: Settings.load({"RERANK_TOP_N": "x"}), lambda: s.key("NONE_API_KEY")):
        with pytest.raises(ConfigurationError):
            bad()
    assert api_key_accepted("", None) and api_key_accepted("a", "a") and not api_key_accepted("a", "b") and not api_key_accepted("a", None)
