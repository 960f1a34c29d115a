"""Queries of the incremental corpus, stores and manifests, over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import corpus
from paperloom.operators.relational import keep_first, split_existing, upsert
from paperloom.operators.serve import request_error
from paperloom.runtime import table
from paperloom.sources.connectors import resolve_identifiers, with_fallback


def _doi_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The DOIs of sources as a list file, one line each, with comments among them."""
    s = table(spark, sf, "sources").select(F.col("source_id").alias("line_number"), "doi", "journal").distinct()
    return s.select("line_number", F.when(F.pmod("line_number", F.lit(11)) == 0, F.concat(F.lit("# "), F.coalesce("journal", F.lit("")))).otherwise(F.col("doi")).alias("line"))


def doi_list(spark: SparkSession, sf: str) -> DataFrame:
    """Valid DOIs by their first line, and failures."""
    good, bad = corpus.read_doi_lines(_doi_lines(spark, sf))
    return good.select("line_number", F.col("doi").alias("value"), F.lit("doi").alias("status")).union(bad.select("line_number", "value", F.col("reason")))


def lookup_dois(spark: SparkSession, sf: str) -> DataFrame:
    """DOIs as a lookup service gets them."""
    return table(spark, sf, "sources").select("source_id", T.clean_doi(F.coalesce("doi", F.lit(""))).alias("doi")).distinct()


def _files(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.concat(F.lit("/in/"), F.col("doc_id").cast("string")).alias("path"), "doc_id", F.coalesce("text", F.lit("")).alias("content"))
    return corpus.fingerprint(d)


def _manifest(spark: SparkSession, sf: str) -> DataFrame:
    """An earlier run over two thirds of the files; each tenth had another content then, and each
    seventh record is an alias of the record before."""
    f = _files(spark, sf).where("doc_id % 3 <> 0")
    old = F.when(F.pmod("doc_id", F.lit(10)) == 1, F.concat(F.lit("pdf:sha256:"), F.sha2(F.concat("content", F.lit("v1")), 256))).otherwise(F.col("source_key"))
    rep = F.when(F.pmod("doc_id", F.lit(7)) == 0, F.concat(F.lit("pdf:sha256:"), F.sha2(F.concat("content", F.lit("v1")), 256)))
    return f.select(F.col("path").alias("source"), old.alias("source_key"), rep.alias("represented_by"))


def incremental_plan(spark: SparkSession, sf: str) -> DataFrame:
    """What a run would skip, extract anew, or extract."""
    return corpus.incremental_plan(_files(spark, sf), _manifest(spark, sf)).select("path", "status")


def invalidated(spark: SparkSession, sf: str) -> DataFrame:
    """The manifest after records of changed files and their aliases went."""
    m = _manifest(spark, sf)
    alias = m.join(_files(spark, sf).select(F.col("path").alias("source"), "doc_id"), "source")
    # aliases of changed files: their representative's old key
    rep = alias.where("doc_id % 10 = 1").select(F.col("source_key").alias("rep"), (F.col("doc_id") + 1).alias("doc_id"))
    m = alias.join(rep, "doc_id", "left").select("source", "source_key", F.col("rep").alias("represented_by"))
    return corpus.invalidate(m, _files(spark, sf)).select("source", "source_key")


def doi_aliases(spark: SparkSession, sf: str) -> DataFrame:
    """Source rows of one DOI, the first standing for the rest."""
    return corpus.alias_by_doi(table(spark, sf, "sources"), "source_id", "doi", [])


def online_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Listed DOIs against documents at hand, some of them from an online run before."""
    good, _ = corpus.read_doi_lines(_doi_lines(spark, sf))
    d = table(spark, sf, "extracted_documents").select("document_id", F.col("metadata.doi").alias("doi"), "source_type").distinct()
    n = T.normalize_doi(F.coalesce("doi", F.lit("")))
    key = F.when(F.col("source_type") == "pdf", F.concat(F.lit("pdf:sha256:"), F.sha2("document_id", 256))).otherwise(F.concat(F.lit("doi:"), n))
    return corpus.online_plan(good.select("doi"), d.select(key.alias("source_key"), "doi"))


def document_records(spark: SparkSession, sf: str) -> DataFrame:
    """Manifest rows of documents."""
    return corpus.document_records(table(spark, sf, "extracted_documents"))


def corpus_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """K2, K3 and K6: one row of totals, partial counts first."""
    r = corpus.document_records(table(spark, sf, "extracted_documents"))
    return r.agg(F.count("*").alias("document_count"), F.sum("section_count").alias("sections"), F.sum("character_count").alias("characters"), F.count_distinct(F.when(F.col("doi") != "", F.col("doi"))).alias("dois"))


def extraction_route(spark: SparkSession, sf: str) -> DataFrame:
    """Which documents go to the fallback extractor."""
    return corpus.valid_structured(table(spark, sf, "extracted_documents"))


def _store(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    c = keep_first(table(spark, sf, "chunks").select("chunk_id", "text", "chunk_index", "loaded_at"), ["chunk_id"], ["loaded_at"]).drop("loaded_at")
    old = c.where("chunk_index % 3 = 0").withColumn("text", F.concat(F.lit("old "), F.coalesce("text", F.lit(""))))
    return old, c.where("chunk_index % 2 = 0 and coalesce(text, '') <> ''")


def upload_skip(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks that the store has and those to be embedded, blank texts left out."""
    old, new = _store(spark, sf)
    missing, skipped = split_existing(new, old, "chunk_id")
    return missing.select("chunk_id", F.lit("upload").alias("status")).union(skipped.select("chunk_id", F.lit("skip")))


def upsert_store(spark: SparkSession, sf: str) -> DataFrame:
    """The store after new versions of chunks came in."""
    old, new = _store(spark, sf)
    return upsert(old, new, "chunk_id").select("chunk_id", F.md5(F.coalesce("text", F.lit(""))).alias("digest"), "chunk_index")


def resolved_ids(spark: SparkSession, sf: str) -> DataFrame:
    """DOIs of sources resolved by the ids of documents at hand."""
    d = table(spark, sf, "extracted_documents").select("metadata.doi", "metadata.pmid", "metadata.pmcid")
    return resolve_identifiers(table(spark, sf, "sources").select("doi"), d)


def fallback_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose first extraction has too little text or failed, taken from a second one."""
    d = keep_first(table(spark, sf, "extracted_documents").select("document_id", "sections", "extraction_method", "extracted_at"), ["document_id"], ["extracted_at"])
    first = d.where("extraction_method is null or extraction_method <> 'pubmed_abstract'").select("document_id", "sections", F.when(F.col("extraction_method").isNull(), F.lit("service down")).alias("error"))
    second = d.where("extraction_method is null or extraction_method <> 'pmc_jats'").select("document_id", "sections", F.lit(None).cast("string").alias("error"))
    return with_fallback(first, second).select("document_id", F.greatest(F.size("sections"), F.lit(0)).alias("n_sections"), "fallback_used", "fallback_reason", "error")


def request_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Requests made of results, with why they are refused."""
    r = table(spark, sf, "strategy_results").select("result_id", "question", "run_id").distinct()
    e = request_error(F.when(F.pmod("result_id", F.lit(13)) == 0, F.lit(" ")).otherwise(F.col("question")), (F.pmod("result_id", F.lit(120))).cast("int"), (F.pmod("run_id", F.lit(40))).cast("int"), F.pmod("result_id", F.lit(8)).cast("int"))
    return r.select("result_id", e.alias("error"))


QUERIES = {f.__name__: f for f in (doi_list, lookup_dois, incremental_plan, invalidated, doi_aliases, online_plan, document_records, corpus_manifest, extraction_route, upload_skip, upsert_store, resolved_ids, fallback_documents, request_checks)}

_T = r"regexp_replace({x}, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')"


def _t(x: str) -> str:
    return _T.replace("{x}", x)


def _doi(x: str) -> str:
    return f"lower(regexp_replace({_t('regexp_replace(regexp_replace(' + _t(x) + ', ' + chr(39) + '(?i)^https?://(dx[.])?doi[.]org/' + chr(39) + ', ' + chr(39) * 2 + '), ' + chr(39) + '(?i)^doi:[ ]*' + chr(39) + ', ' + chr(39) * 2 + ')')}, '[.,;]+$', ''))"


_LINES = "(SELECT DISTINCT source_id AS line_number, CASE WHEN source_id % 11 = 0 THEN '# ' || coalesce(journal, '') ELSE doi END AS line FROM sources)"
_GOOD = f"l AS (SELECT line_number, {_t(chr(99) + 'oalesce(line, ' + chr(39) * 2 + ')')} AS line FROM {_LINES}), p AS (SELECT line_number, line, {_doi('line')} AS doi FROM l WHERE line <> '' AND NOT starts_with(line, '#')), good AS (SELECT doi, min(line_number) AS line_number FROM p WHERE regexp_matches(doi, '(?i)^10\\.\\d{{4,9}}/\\S+$') GROUP BY 1)"
_FILES = "f AS (SELECT '/in/' || doc_id AS path, doc_id, coalesce(text, '') AS content, 'pdf:sha256:' || sha256(coalesce(text, '')) AS source_key FROM documents)"
_MANIFEST = "m AS (SELECT path AS source, doc_id, CASE WHEN doc_id % 10 = 1 THEN 'pdf:sha256:' || sha256(content || 'v1') ELSE source_key END AS source_key FROM f WHERE doc_id % 3 <> 0)"
_ONCE = "(SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY extracted_at) AS rn FROM extracted_documents) WHERE rn = 1)"
_RECORDS = f"""d AS (SELECT document_id, source_type, source_identifier, extraction_method, {_doi("coalesce(metadata.doi, '')")} AS doi, CAST(len(coalesce(sections, [])) AS INT) AS section_count, CAST(len(list_filter(coalesce("references", []), lambda r: trim(coalesce(r, '')) <> '')) AS INT) AS reference_count,
 CAST(coalesce(list_sum(list_transform(coalesce(sections, []), lambda s: coalesce(length(s.text), 0))), 0) AS BIGINT) AS character_count FROM {_ONCE})"""
_CHUNKS = "c AS (SELECT * EXCLUDE (rn) FROM (SELECT chunk_id, text, chunk_index, row_number() OVER (PARTITION BY chunk_id ORDER BY loaded_at) AS rn FROM chunks) WHERE rn = 1), old AS (SELECT chunk_id, 'old ' || coalesce(text, '') AS text, chunk_index FROM c WHERE chunk_index % 3 = 0), new AS (SELECT * FROM c WHERE chunk_index % 2 = 0 AND coalesce(text, '') <> '')"

ORACLES = {
    "resolved_ids": f"""WITH k AS (SELECT {_doi("coalesce(metadata.doi, '')")} AS doi, min(nullif(trim(metadata.pmid), '')) AS pmid, min(nullif(trim(metadata.pmcid), '')) AS pmcid FROM extracted_documents GROUP BY 1), q AS (SELECT DISTINCT {_doi("coalesce(doi, '')")} AS doi FROM sources)
SELECT q.doi, pmid, pmcid, CASE WHEN pmcid IS NOT NULL THEN 'full_text' WHEN pmid IS NOT NULL THEN 'abstract_only' ELSE 'not_found' END AS status FROM q LEFT JOIN k ON k.doi = q.doi AND k.doi <> '' WHERE q.doi <> ''""",
    "fallback_documents": f"""WITH d AS (SELECT document_id, coalesce(sections, []) AS s, extraction_method AS m, coalesce(list_sum(list_transform(list_filter(coalesce(sections, []), lambda s: s.section_type IN ('body', 'conclusion')), lambda s: coalesce(length(s.text), 0))), 0) AS n FROM {_ONCE}),
x AS (SELECT *, coalesce(m <> 'pubmed_abstract' AND n >= 200, false) AS good, coalesce(m <> 'pmc_jats', true) AS second, CASE WHEN m IS NULL THEN 'service down' WHEN m = 'pubmed_abstract' THEN 'not tried' ELSE 'too little structured text' END AS reason FROM d)
SELECT document_id, CAST(CASE WHEN good OR second THEN len(s) ELSE 0 END AS INT) AS n_sections, NOT good AS fallback_used, CASE WHEN NOT good THEN reason END AS fallback_reason, CASE WHEN NOT good AND NOT second THEN reason || '; no fallback' END AS error FROM x""",
    "request_checks": """SELECT DISTINCT result_id, CASE WHEN result_id % 13 = 0 OR trim(coalesce(question, '')) = '' THEN 'empty_query' WHEN result_id % 8 > 6 THEN 'too_many_turns' WHEN result_id % 120 NOT BETWEEN 1 AND 100 THEN 'top_k_out_of_range' WHEN run_id % 40 NOT BETWEEN 1 AND 30 THEN 'top_n_out_of_range' END AS error FROM strategy_results""",
    "doi_list": f"WITH {_GOOD} SELECT line_number, doi AS value, 'doi' AS status FROM good UNION ALL SELECT line_number, line, 'invalid_doi' FROM p WHERE NOT regexp_matches(doi, '(?i)^10\\.\\d{{4,9}}/\\S+$')",
    "lookup_dois": f"SELECT DISTINCT source_id, {_t('regexp_replace(coalesce(doi, ' + chr(39) * 2 + '), ' + chr(39) + '(?i)^(https?://(dx[.])?doi[.]org/|doi:[ ]*)' + chr(39) + ', ' + chr(39) * 2 + ')')} AS doi FROM sources",
    "incremental_plan": f"WITH {_FILES}, {_MANIFEST} SELECT path, CASE WHEN source_key IN (SELECT source_key FROM m) THEN 'unchanged_pdf' WHEN path IN (SELECT source FROM m) THEN 'changed_pdf' ELSE 'new_pdf' END AS status FROM f",
    "invalidated": f"WITH {_FILES}, {_MANIFEST}, a AS (SELECT m.source, m.source_key, r.source_key AS represented_by FROM m LEFT JOIN m r ON r.doc_id = m.doc_id - 1 AND r.doc_id % 10 = 1), stale AS (SELECT m.source_key FROM m JOIN f ON f.path = m.source GROUP BY m.source, m.source_key HAVING NOT bool_or(f.source_key = m.source_key)) SELECT source, source_key FROM a WHERE source_key NOT IN (SELECT source_key FROM stale) AND (represented_by IS NULL OR represented_by NOT IN (SELECT source_key FROM stale))",
    "doi_aliases": f"""WITH r AS (SELECT DISTINCT source_id, {_doi("coalesce(doi, '')")} AS doi FROM sources), f AS (SELECT doi, min(source_id) AS rep FROM r WHERE doi <> '' GROUP BY 1)
SELECT source_id, doi, CASE WHEN rep <> source_id THEN rep END AS represented_by, CASE WHEN rep <> source_id THEN 'doi_already_in_corpus' ELSE 'represented' END AS reason FROM r LEFT JOIN f USING (doi)""",
    "online_plan": f"""WITH {_GOOD}, d AS (SELECT DISTINCT document_id, {_doi("coalesce(metadata.doi, '')")} AS doi, source_type FROM extracted_documents)
SELECT doi, CASE WHEN doi IN (SELECT doi FROM d WHERE source_type IS NULL OR source_type <> 'pdf') THEN 'already_extracted' WHEN doi IN (SELECT doi FROM d WHERE source_type = 'pdf' AND doi <> '') THEN 'doi_present_in_pdf' ELSE 'to_extract' END AS status FROM good""",
    "document_records": f"WITH {_RECORDS} SELECT * FROM d",
    "corpus_manifest": f"WITH {_RECORDS} SELECT count(*) AS document_count, CAST(sum(section_count) AS BIGINT) AS sections, CAST(sum(character_count) AS BIGINT) AS characters, count(DISTINCT CASE WHEN doi <> '' THEN doi END) AS dois FROM d",
    "extraction_route": "WITH b AS (SELECT DISTINCT document_id, CAST(coalesce(list_sum(list_transform(list_filter(coalesce(sections, []), lambda s: s.section_type IN ('body', 'conclusion')), lambda s: coalesce(length(s.text), 0))), 0) AS BIGINT) AS body_characters FROM extracted_documents) SELECT *, CASE WHEN body_characters >= 200 THEN 'structured' ELSE 'fallback' END AS route FROM b",
    "upload_skip": f"WITH {_CHUNKS} SELECT chunk_id, CASE WHEN chunk_id IN (SELECT chunk_id FROM old) THEN 'skip' ELSE 'upload' END AS status FROM new",
    "upsert_store": f"WITH {_CHUNKS}, u AS (SELECT chunk_id, text, chunk_index FROM new UNION ALL SELECT chunk_id, text, chunk_index FROM old WHERE chunk_id NOT IN (SELECT chunk_id FROM new)) SELECT chunk_id, md5(coalesce(text, '')) AS digest, chunk_index FROM u",
}
