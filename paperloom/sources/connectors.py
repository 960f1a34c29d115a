"""Outside services as interfaces, and what can be done without them."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.errors import ConfigurationError, ServiceError
from paperloom.functions import text as T
from paperloom.functions.llm_text import is_quota_error, is_retriable, retry_wait
from paperloom.runtime import durable
from paperloom.sources.sinks import read_table


class Client(Protocol):
    """A service that turns texts into texts; made once per task."""

    def __call__(self, texts: list[str]) -> list[str]: ...


def with_retries(send: Callable[[], list[str]], attempts: int = 5, pause: Callable[[float], None] = time.sleep, quota_wait: float | None = None) -> list[str]:
    """What ``send`` returns, tried again after errors that may pass: HTTP 429 and 5xx,
    lost connections, messages about quota. Waits grow with the attempts, and are longer if the
    server says so; with ``quota_wait`` only quota errors are tried again, after that many seconds."""
    for attempt in range(1, attempts + 1):
        try:
            return send()
        except Exception as e:
            status = getattr(e, "status", None)
            quota = is_quota_error(str(e), status)
            again = quota if quota_wait is not None else quota or isinstance(e, (ConnectionError, TimeoutError)) or status is not None and is_retriable(status)
            if not again or attempt == attempts:
                raise
            pause(quota_wait if quota_wait is not None else retry_wait(attempt, getattr(e, "retry_after", None)))
    raise ValueError("attempts must be positive")


def call_service(df: DataFrame, key: str, text: str, make: Callable[[], Client], parallel: int = 4, attempts: int = 5, pause: Callable[[float], None] = time.sleep, quota_wait: float | None = None) -> DataFrame:
    """(key, answer, error): each batch of texts sent by a client that the task makes once; at most
    ``parallel`` tasks run, which bounds the calls at a time. Errors that may pass are tried again
    (``with_retries``); of a batch that is refused for good the texts are sent one by one, and only
    those that fail alone give error rows. NULL texts are sent as empty ones."""
    src = df.select(F.col(key).alias("k"), F.col(text).alias("t")).repartition(parallel)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = make()

        def send(texts: list[str]) -> list[tuple[str | None, str | None]]:
            try:
                answers = with_retries(lambda: client(texts), attempts, pause, quota_wait)
                if len(answers) != len(texts):
                    raise ServiceError(f"{len(answers)} answers to {len(texts)} texts")
                return [(a, None) for a in answers]
            except Exception as e:  # the service's errors are rows, not failures of the job
                if len(texts) > 1 and not is_quota_error(str(e), getattr(e, "status", None)):
                    return [x for t in texts for x in send([t])]
                return [(None, f"{type(e).__name__}: {e}")] * len(texts)

        for batch in batches:
            got = send([t or "" for t in batch.column("t").to_pylist()]) if batch.num_rows else []
            yield pa.RecordBatch.from_pydict({"k": batch.column("k"), "answer": pa.array([a for a, _ in got], type=pa.string()), "error": pa.array([e for _, e in got], type=pa.string())})

    return src.mapInArrow(run, f"k {dict(src.dtypes)['k']}, answer string, error string").withColumnRenamed("k", key)


@dataclass
class JsonService:
    """A client of an HTTP service that takes and gives JSON; ``make_body`` builds the
    request of a batch of texts, ``read_body`` takes the answers out of what comes back."""

    url: str
    make_body: Callable[[list[str]], dict]
    read_body: Callable[[dict], list[str]]
    key: str = ""
    timeout: float = 60.0

    def __call__(self, texts: list[str]) -> list[str]:
        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        request = urllib.request.Request(self.url, json.dumps(self.make_body(texts)).encode(), head)
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                return self.read_body(json.loads(answer.read()))
        except urllib.error.HTTPError as e:
            raise ServiceError(f"HTTP {e.code}: {e.read()[:300].decode(errors='replace')}", e.code, e.headers.get("Retry-After")) from e
        except urllib.error.URLError as e:
            raise ConnectionError(str(e.reason)) from e
        except (ValueError, LookupError, TypeError) as e:
            raise ServiceError(f"unexpected answer: {e}") from e


def embedding_service(kind: str, url: str, model: str, key: str = "") -> JsonService:
    """A client of an embedding server (``openai``, ``ollama``, ``google``); each answer is a JSON list of numbers."""
    forms = {
        "openai": ("/embeddings", lambda t: {"model": model, "input": t}, lambda b: [json.dumps(x["embedding"]) for x in sorted(b["data"], key=lambda x: x.get("index", 0))]),
        "ollama": ("/api/embed", lambda t: {"model": model, "input": t}, lambda b: [json.dumps(x) for x in b["embeddings"]]),
        "google": (f"/models/{model}:batchEmbedContents", lambda t: {"requests": [{"model": f"models/{model}", "content": {"parts": [{"text": x}]}} for x in t]}, lambda b: [json.dumps(x["values"]) for x in b["embeddings"]]),
    }
    if kind not in forms:
        raise ConfigurationError(f"no embedding service {kind!r}; known: {sorted(forms)}")
    path, body, read = forms[kind]
    return JsonService(url.rstrip("/") + path, body, read, key)


def chat_service(url: str, model: str, key: str = "", temperature: float = 0.1, max_tokens: int = 900) -> Client:
    """E5: a client of a chat server of the usual form, one prompt a request."""
    body = lambda t: {"model": model, "messages": [{"role": "user", "content": t[0]}], "temperature": temperature, "max_tokens": max_tokens}
    one = JsonService(url.rstrip("/") + "/chat/completions", body, lambda b: [b["choices"][0]["message"]["content"]], key)
    return lambda texts: [one([t])[0] for t in texts]


def rerank_service(url: str, model: str, key: str = "") -> Client:
    """A client of a reranking server; each text is JSON {query, documents}, each answer the
    JSON list of the documents' relevance scores."""

    def body(t: list[str]) -> dict:
        asked = json.loads(t[0])
        return {"model": model, "query": asked["query"], "documents": asked["documents"], "top_n": len(asked["documents"])}

    one = JsonService(url, body, lambda b: [json.dumps([x["relevance_score"] for x in sorted(b["results"], key=lambda x: x["index"])])], key)
    return lambda texts: [one([t])[0] for t in texts]


def embed_remote(df: DataFrame, key: str, text: str, make: Callable[[], Client], parallel: int = 4, attempts: int = 5, quota_wait: float = 30.0, pause: Callable[[float], None] = time.sleep) -> DataFrame:
    """(key, embedding, error) of a remote provider; quota errors wait, others are rows."""
    out = call_service(df, key, text, make, parallel, attempts, pause, quota_wait)
    return out.select(key, F.from_json("answer", "array<double>").alias("embedding"), "error")


def resolve_identifiers(requests: DataFrame, lookup: DataFrame, allow_abstract: bool = True) -> DataFrame:
    """S6 and S7 over requests (doi) and lookup (doi, pmid, pmcid): (doi, pmid, pmcid, status).

    Full text needs a PMCID; with a PMID alone the abstract will do where that is allowed. Lookup
    rows of one DOI count once, by their smallest ids; blank ids are absent.
    """
    blank = lambda c: F.nullif(T.strip(F.coalesce(c, F.lit(""))), F.lit(""))
    known = lookup.select(T.normalize_doi(F.coalesce("doi", F.lit(""))).alias("doi"), blank(F.col("pmid")).alias("pmid"), blank(F.col("pmcid")).alias("pmcid")).where("doi <> ''").groupBy("doi").agg(F.min("pmid").alias("pmid"), F.min("pmcid").alias("pmcid"))
    out = requests.select(T.normalize_doi(F.coalesce("doi", F.lit(""))).alias("doi")).where("doi <> ''").distinct().join(known, "doi", "left")
    short = F.lit("abstract_only" if allow_abstract else "no_full_text")
    return out.withColumn("status", F.when(F.col("pmcid").isNotNull(), F.lit("full_text")).when(F.col("pmid").isNotNull(), short).otherwise(F.lit("not_found")))


def with_fallback(primary: DataFrame, fallback: DataFrame, minimum: int = 200) -> DataFrame:
    """E11 over (document_id, sections, error) of two extractors: the primary result if it has
    enough text in body and conclusion, else the fallback's, with the reason; the error of both if
    neither worked. Documents of either side come out."""
    body = lambda c: F.aggregate(F.transform(F.filter(c, lambda s: s.section_type.isin("body", "conclusion")), lambda s: F.coalesce(F.length(s.text), F.lit(0))), F.lit(0), lambda a, x: a + x)
    a = primary.select("document_id", F.col("sections").alias("a"), F.col("error").alias("ea"), F.lit(True).alias("tried"))
    b = fallback.select("document_id", F.col("sections").alias("b"), F.col("error").alias("eb"))
    j = a.join(b, "document_id", "full_outer")
    good = F.col("ea").isNull() & F.coalesce("tried", F.lit(False)) & (F.coalesce(body(F.col("a")), F.lit(0)) >= minimum)
    reason = F.when(F.col("ea").isNotNull(), F.col("ea")).when(F.col("tried").isNull(), F.lit("not tried")).otherwise(F.lit("too little structured text"))
    failed = ~good & (F.col("eb").isNotNull() | F.col("b").isNull())
    return j.select(
        "document_id", F.when(good, F.col("a")).otherwise(F.col("b")).alias("sections"), (~good).alias("fallback_used"), F.when(~good, reason).alias("fallback_reason"),
        F.when(failed, F.concat_ws("; ", reason, F.coalesce("eb", F.lit("no fallback")))).alias("error"),
    )


def append_missing(results: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Append the results whose keys (NULL is a key like others) the table at ``path``
    lacks; what is there isn't touched. Returns the rows that were added."""
    old = read_table(results.sparkSession, path)
    fresh = results.dropDuplicates(keys)
    if old is not None:
        there = old.select(*[F.col(k).alias(f"_old_{k}") for k in keys]).distinct()
        fresh = fresh.join(there, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_old_{k}")) for k in keys]), "left_anti")
    fresh = durable(fresh)
    fresh.write.mode("append").parquet(path)
    return fresh
