"""Incremental corpus bookkeeping: lists of DOIs, fingerprints, skips, aliases, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators.relational import keep_first


def read_doi_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S3 over (line_number, line): (dois, failures). Blank lines and lines that begin with # are
    skipped, the rest normalised; valid ones come once, by their first line, invalid ones fail."""
    text = T.strip(F.regexp_replace(F.coalesce("line", F.lit("")), "^﻿", ""))
    used = lines.select("line_number", text.alias("line")).where((F.col("line") != "") & ~F.col("line").startswith("#"))
    parsed = used.withColumn("doi", T.normalize_doi(F.col("line")))
    good = parsed.where(F.col("doi").rlike(T.DOI)).groupBy("doi").agg(F.min("line_number").alias("line_number"))
    bad = parsed.where(~F.col("doi").rlike(T.DOI)).select("line_number", F.col("line").alias("value"), F.lit("invalid_doi").alias("reason"))
    return good, bad


def fingerprint(files: DataFrame, content: str = "content") -> DataFrame:
    """Files with their SHA-256 ``fingerprint`` and ``source_key``."""
    h = F.sha2(F.col(content).cast("binary"), 256)
    return files.withColumn("fingerprint", h).withColumn("source_key", F.concat(F.lit("pdf:sha256:"), h))


def incremental_plan(files: DataFrame, manifest: DataFrame, outputs: DataFrame | None = None) -> DataFrame:
    """J1 and J2 over files (path, source_key) and manifest (source, source_key, represented_by):
    each file as unchanged (skipped), changed (its path had another key) or new.

    With ``outputs`` (output_path, the paths that exist), records whose output is gone don't count,
    so their files are extracted again (F10)."""
    if outputs is not None:
        manifest = manifest.join(outputs.select("output_path").distinct(), "output_path", "left_semi")
    keys = manifest.select("source_key").distinct().withColumn("known", F.lit(True))
    paths = manifest.select(F.col("source").alias("path")).distinct().withColumn("seen", F.lit(True))
    out = files.join(keys, "source_key", "left").join(paths, "path", "left")
    status = F.when(F.col("known"), "unchanged_pdf").when(F.col("seen"), "changed_pdf").otherwise("new_pdf")
    return out.select("path", "source_key", status.alias("status"))


def invalidate(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """The manifest without records of changed files and without aliases that those represent
    (one level)."""
    current = files.select(F.col("path").alias("source"), F.col("source_key").alias("now")).distinct()
    stale = manifest.join(current, "source").groupBy("source", "source_key").agg(F.bool_or(F.col("now") == F.col("source_key")).alias("same")).where("not same").select("source_key").distinct()
    left = manifest.join(stale, "source_key", "left_anti")
    return left.join(stale.withColumnRenamed("source_key", "represented_by"), "represented_by", "left_anti").select(*manifest.columns)


def alias_by_doi(records: DataFrame, key: str, doi: str, order: list[str]) -> DataFrame:
    """(key, doi, represented_by, reason): of the records with one DOI the first stands for the
    rest; a record without a DOI stands for itself. One partial minimum per DOI, no sort."""
    d = T.normalize_doi(F.coalesce(F.col(doi), F.lit("")))
    rows = records.select(F.col(key).alias("k"), d.alias("d"), F.struct(*order, key).alias("o")).distinct()
    first = rows.where("d <> ''").groupBy("d").agg(F.min("o").alias("f"))
    out = rows.join(first.select("d", F.col(f"f.{key}").alias("rep")), "d", "left")
    is_alias = F.col("rep").isNotNull() & (F.col("rep") != F.col("k"))
    return out.select(F.col("k").alias(key), F.col("d").alias("doi"), F.when(is_alias, F.col("rep")).alias("represented_by"), F.when(is_alias, "doi_already_in_corpus").otherwise("represented").alias("reason"))


def online_plan(dois: DataFrame, manifest: DataFrame) -> DataFrame:
    """J4 over dois (doi) and manifest (source_key, doi): already_extracted, doi_present_in_pdf or to_extract."""
    own = manifest.select(F.col("source_key")).distinct().withColumn("own", F.lit(True))
    pdf = manifest.where(F.col("source_key").startswith("pdf:")).select(T.normalize_doi(F.coalesce("doi", F.lit(""))).alias("doi")).where("doi <> ''").distinct().withColumn("in_pdf", F.lit(True))
    out = dois.withColumn("source_key", F.concat(F.lit("doi:"), "doi")).join(own, "source_key", "left").join(pdf, "doi", "left")
    return out.select("doi", F.when(F.col("own"), "already_extracted").when(F.col("in_pdf"), "doi_present_in_pdf").otherwise("to_extract").alias("status"))


def document_records(documents: DataFrame) -> DataFrame:
    """One manifest row per document; counts are worked out from the arrays."""
    once = keep_first(documents.select("document_id", "source_type", "source_identifier", "extraction_method", F.col("metadata.doi").alias("doi"), "sections", F.col("references").alias("refs"), "extracted_at"), ["document_id"], ["extracted_at"])
    chars = F.aggregate(F.transform("sections", lambda s: F.coalesce(F.length(s.text), F.lit(0))), F.lit(0).cast("bigint"), lambda a, x: a + x)
    kept = F.size(F.filter("refs", lambda r: T.strip(F.coalesce(r, F.lit(""))) != ""))
    return once.select("document_id", "source_type", "source_identifier", "extraction_method", T.normalize_doi(F.coalesce("doi", F.lit(""))).alias("doi"), F.greatest(F.size("sections"), F.lit(0)).alias("section_count"), F.greatest(kept, F.lit(0)).alias("reference_count"), F.coalesce(chars, F.lit(0).cast("bigint")).alias("character_count"))


def full_text(documents: DataFrame, include_references: bool = True) -> DataFrame:
    """(document_id, full_text): non-blank section texts, then references, divided by blank lines."""
    blank = lambda c: T.strip(F.coalesce(c, F.lit(""))) == ""
    once = keep_first(documents.select("document_id", "sections", F.col("references").alias("refs"), "extracted_at"), ["document_id"], ["extracted_at"])
    parts = F.filter(F.transform("sections", lambda s: s.text), lambda t: ~blank(t))
    if include_references:
        parts = F.concat(parts, F.filter(F.coalesce("refs", F.array().cast("array<string>")), lambda r: ~blank(r)))
    return once.select("document_id", F.array_join(F.coalesce(parts, F.array().cast("array<string>")), "\n\n").alias("full_text"))


def valid_structured(documents: DataFrame, minimum: int = 200) -> DataFrame:
    """(document_id, body_characters, route): documents whose body and conclusion have
    too few characters are routed to the fallback extractor."""
    body = F.filter("sections", lambda s: s.section_type.isin("body", "conclusion"))
    n = F.aggregate(F.transform(body, lambda s: F.coalesce(F.length(s.text), F.lit(0))), F.lit(0).cast("bigint"), lambda a, x: a + x)
    rows = documents.select("document_id", F.coalesce(n, F.lit(0).cast("bigint")).alias("body_characters")).distinct()
    return rows.withColumn("route", F.when(F.col("body_characters") >= minimum, "structured").otherwise("fallback"))
