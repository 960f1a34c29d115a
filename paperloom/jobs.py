"""Batch jobs: extract, chunk, upload, evaluate, collect."""

from __future__ import annotations

import argparse
import functools
from collections.abc import Callable
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.config import ChunkConfig, Settings
from paperloom.errors import PaperloomError
from paperloom.functions import embed, llm_text
from paperloom.operators import chunk, corpus, evaluate, extract, judge
from paperloom.operators.relational import as_number, collect_outer, last_write_wins
from paperloom.operators.strategies import Strategies
from paperloom.runtime import durable
from paperloom.sources import connectors, readers, sinks

STRATEGIES = ("classic", "reranked", "hyde", "hyde_reranked", "multi_query", "agentic")


def run_extract(spark: SparkSession, xml: DataFrame, kind: str, manifest_path: str, output: str) -> DataFrame:
    """O1 and O2 over (path, content): new and changed files are parsed, unchanged ones skipped; the
    manifest is swapped as a whole. Returns one status row per file."""
    files = corpus.fingerprint(xml)
    manifest = readers.load_manifest(spark, manifest_path)
    plan = durable(corpus.incremental_plan(files, manifest))  # the manifest is replaced below
    todo = files.join(plan.where("status <> 'unchanged_pdf'").select("path"), "path", "left_semi")
    parsed = extract.parse_xml(todo.select("path", F.col("content").cast("string").alias("content")), "path", "content", kind)
    parsed = durable(parsed)
    good = parsed.where("error is null")
    good.drop("error").write.mode("append").json(output)
    fields = [f.strip().split(" ") for f in readers.MANIFEST.split(",")]
    values = {"source": F.col("path"), "source_type": F.lit(kind), "doi": F.col("doi"), "section_count": F.size("sections"), "output_path": F.lit(output), "fallback_used": F.lit(False)}
    rows = good.withColumnRenamed("source", "path").join(files.select("path", "source_key", "fingerprint"), "path")
    new = rows.select(*[values.get(n, F.col(n) if n in rows.columns else F.lit(None)).cast(t).alias(n) for n, t in fields])
    sinks.replace_table(durable(corpus.invalidate(manifest, files).unionByName(new)), manifest_path)
    failed = parsed.where("error is not null").select(F.col("source").alias("path"), F.col("error"))
    out = plan.join(failed, "path", "left").select("path", F.when(F.col("error").isNotNull(), "failed").otherwise(F.col("status")).alias("status"), "error")
    return out


def run_chunk(spark: SparkSession, documents: str, output: str, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """O3: chunk all documents of a folder; returns the manifest."""
    docs, _ = readers.read_documents(spark, documents)
    chunk.chunk_documents(docs, config).write.mode("overwrite").json(output)
    return chunk.chunk_manifest(spark.read.schema(readers.CHUNK).json(output))


def run_upload(spark: SparkSession, chunks: str, store: sinks.VectorStore, reset: bool = False, skip_existing: bool = False, check_only: bool = False, provider: str = "hash") -> dict:
    """Embed chunks and put them into the store; resetting excludes the other two modes."""
    if reset and (skip_existing or check_only):
        raise ValueError("reset can't be combined with skip_existing or check_only")
    if check_only:
        return store.preflight()
    if reset:
        store.reset()
    rows = readers.read_chunks(spark, chunks).select("chunk_id", "document_id", "text")
    missing, skipped = store.missing(rows) if skip_existing else (rows, rows.limit(0))
    vectors = embed.get_provider(provider)(missing, "chunk_id", "text")
    n = {"considered": rows.count(), "uploaded": missing.count(), "skipped": skipped.select("chunk_id").distinct().count()}
    store.upsert(missing.join(vectors, "chunk_id").select("chunk_id", "document_id", "text", "embedding"))
    return n


def run_evaluate(spark: SparkSession, questions: DataFrame, store: sinks.VectorStore, output: str, names: tuple[str, ...] = STRATEGIES) -> DataFrame:
    """Every strategy over questions (item_id, question, passage, query_json, verdict_json,
    expected_sources), answered by the offline provider; results, the questions, the summary by
    strategy and a manifest of the run are written, the summary is returned. Results that the
    output has are kept (resume)."""
    rows = store.read()
    s = Strategies(rows.select("chunk_id", "text"), rows.select("chunk_id", "embedding"), questions)
    found = reduce(DataFrame.unionByName, [s.run(n).withColumn("strategy", F.lit(n)) for n in names])
    hits = found.join(rows.select("chunk_id", "document_id"), "chunk_id")
    chunk = F.struct("document_id", F.lit("").alias("title"), F.lit("").alias("source_identifier"), F.lit("").alias("doi"))
    per = hits.groupBy("item_id", "strategy").agg(F.sort_array(F.collect_list(F.struct("rank", chunk.alias("c")))).alias("x"))  # at most context_k each
    asked = questions.select("item_id", "question", "expected_sources").crossJoin(F.broadcast(spark.createDataFrame([(n,) for n in names], "strategy string")))
    out = asked.join(per, ["item_id", "strategy"], "left").withColumn("chunks", F.transform("x", lambda e: e.c))
    metrics = evaluate.retrieval_metrics(F.col("chunks"), F.col("expected_sources"))
    results = out.select("item_id", "strategy", "question", llm_text.mock_generate(F.col("question")).alias("answer"), F.lit(False).alias("second_retrieval_used"), *[c.alias(n) for n, c in metrics.items()])
    connectors.append_missing(durable(results), output, ["item_id", "strategy"])
    summary = durable(evaluate.strategy_summary(spark.read.parquet(output)))
    sinks.write_table(summary, f"{output}_summary", "csv")
    sinks.write_table(questions.select("item_id", "question", "expected_sources"), f"{output}_questions", "json")
    sinks.write_record(spark, {"strategies": list(names), "questions": questions.count(), "results": spark.read.parquet(output).count(), "finished_at": datetime.now(timezone.utc).isoformat(timespec="seconds")}, f"{output}_manifest.json")
    return summary


Call = Callable[[DataFrame, str, str], DataFrame]


def run_judge(spark: SparkSession, results: DataFrame, call: Call, output: str, limit: int = 12_000) -> DataFrame:
    """Results (see ``judge_answers``) that the output lacks are judged and added, failed
    ones are left for the next run and written beside it; returns the summary by strategy."""
    there = sinks.read_table(spark, output)
    todo = results if there is None else results.join(there.select(*judge.KEYS).distinct(), judge.KEYS, "left_anti")
    judged = durable(judge.judge_answers(todo, call, limit))
    connectors.append_missing(judged.where("error is null").drop("error"), output, judge.KEYS)
    sinks.write_table(judged.where("error is not null"), f"{output}_failures", "json")
    summary = durable(evaluate.valid_means(spark.read.parquet(output), "strategy", list(evaluate.JUDGE_FIELDS)))
    sinks.write_table(summary, f"{output}_summary", "csv")
    return summary


def run_ragas(spark: SparkSession, samples: DataFrame, output: str, call: Call | None = None) -> DataFrame:
    """The four metrics of samples that the output lacks, by a service or, without one, by
    supported sentences; returns the summary by strategy. It is an error if no metric is valid."""
    there = sinks.read_table(spark, output)
    todo = samples if there is None else samples.join(there.select(*judge.KEYS).distinct(), judge.KEYS, "left_anti")
    scored = judge.remote_metrics(todo, call) if call else judge.support_metrics(todo)
    connectors.append_missing(scored.select(*judge.KEYS, *judge.RAGAS_FIELDS), output, judge.KEYS)
    summary = durable(evaluate.valid_means(spark.read.parquet(output), "strategy", list(judge.RAGAS_FIELDS)))
    if not evaluate.has_valid_metric(summary).first()[0]:
        raise PaperloomError("no metric has a valid score")
    sinks.write_table(summary, f"{output}_summary", "csv")
    return summary


def run_collect(spark: SparkSession, custom: list[str], judge: list[str], ragas: list[str], output: str) -> DataFrame:
    """Summaries of several runs (CSV folders with a strategy column, later ones winning
    column by column) joined by strategy and written."""
    parts = {}
    for name, paths in (("custom", custom), ("judge", judge), ("ragas", ragas)):
        runs = []
        for i, p in enumerate(paths):
            df = spark.read.option("header", True).csv(p)
            runs.append(df.select("strategy", F.lit(i).alias("run"), *[as_number(F.col(c)).alias(c) for c in df.columns if c != "strategy"]))
        if runs:
            rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), runs)
            parts[name] = last_write_wins(rows, "strategy", ["run"], [c for c in rows.columns if c not in ("strategy", "run")])
    out = durable(collect_outer(parts, "strategy"))
    sinks.write_table(out, output, "csv")
    return out


def _xml_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").option("recursiveFileLookup", "true").load(path).select("path", "content")


def main(argv: list[str] | None = None) -> int:
    """Commands ``extract``, ``chunk``, ``upload``, ``judge``, ``ragas`` and ``collect``; exit code 1 if
    a file or an answer failed."""
    p = argparse.ArgumentParser(prog="paperloom")
    sub = p.add_subparsers(dest="command", required=True)
    x = sub.add_parser("extract", help="parse the XML files of a folder, new and changed ones only")
    x.add_argument("kind", choices=sorted(extract.PARSERS))
    for name in ("input", "output", "manifest"):
        x.add_argument(name)
    c = sub.add_parser("chunk")
    c.add_argument("documents")
    c.add_argument("output")
    for name, default in (("target", 400), ("maximum", 520), ("overlap", 80), ("minimum", 80)):
        c.add_argument(f"--{name}", type=int, default=default)
    u = sub.add_parser("upload")
    u.add_argument("chunks")
    u.add_argument("store")
    for flag in ("reset", "skip-existing", "check-only"):
        u.add_argument(f"--{flag}", action="store_true")
    j = sub.add_parser("judge", help="score results by the chat server in OPENAI_COMPATIBLE_BASE_URL")
    j.add_argument("--max-context-chars", type=int, default=12_000)
    r = sub.add_parser("ragas", help="score results by supported sentences")
    for q in (j, r):
        q.add_argument("results", help="parquet of results")
        q.add_argument("output")
    k = sub.add_parser("collect")
    for name in ("custom", "judge", "ragas"):
        k.add_argument(f"--{name}", nargs="*", default=[])
    k.add_argument("output")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("paperloom").getOrCreate()
    if a.command == "extract":
        out = durable(run_extract(spark, _xml_files(spark, a.input), a.kind, a.manifest, a.output))
        out.groupBy("status").count().show()
        return int(not out.where("status = 'failed'").isEmpty())
    if a.command == "chunk":
        run_chunk(spark, a.documents, a.output, ChunkConfig(a.target, a.maximum, a.overlap, a.minimum)).show()
    elif a.command == "upload":
        print(run_upload(spark, a.chunks, sinks.VectorStore(spark, a.store), a.reset, a.skip_existing, a.check_only))
    elif a.command == "judge":
        s = Settings.load()
        url, key = s.key("OPENAI_COMPATIBLE_BASE_URL", "OPENAI_BASE_URL"), (s.keys or {}).get("OPENAI_COMPATIBLE_API_KEY", "")
        make = functools.partial(connectors.chat_service, url, s.active_model, key, s.llm_temperature, max(s.llm_max_tokens, 4000))
        run_judge(spark, spark.read.parquet(a.results), lambda df, k, t: connectors.call_service(df, k, t, make), a.output, a.max_context_chars).show()
        return int(not spark.read.text(f"{a.output}_failures").isEmpty())
    elif a.command == "ragas":
        run_ragas(spark, spark.read.parquet(a.results), a.output).show()
    else:
        run_collect(spark, a.custom, a.judge, a.ragas, a.output).show()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
