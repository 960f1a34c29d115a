"""Readers of documents, chunks, questions and manifests."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.sources.sinks import read_table

DOCUMENT = "document_id string, schema_version string, source_type string, source_identifier string, extraction_method string, metadata struct<title:string,doi:string,journal:string,pmid:string,pmcid:string,publication_date:string,authors:array<string>>, sections array<struct<section_type:string,heading:string,text:string,order:int,level:int>>, references array<string>, warnings array<string>, provenance map<string,string>"
CHUNK = "chunk_id string, document_id string, text string, chunk_index int, section_type string, heading string, section_order int, extraction_method string, source_type string, source_identifier string, token_count int, sentence_count int, metadata struct<title:string,doi:string,journal:string,pmid:string,pmcid:string,publication_date:string,authors:array<string>>"
MANIFEST = "source_key string, source_type string, source string, fingerprint string, document_id string, output_path string, extraction_method string, fallback_used boolean, doi string, section_count int, character_count bigint, updated_at string, represented_by string"


def scan_pdfs(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(path, length, content) of PDF files; a missing folder gives no row."""
    try:
        return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", "length", "content")
    except AnalysisException:
        return spark.createDataFrame([], "path string, length bigint, content binary")


def read_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(documents, failures) of JSON files, one document each; what can't be read fails alone."""
    raw = spark.read.schema(DOCUMENT + ", _broken string").option("multiLine", True).option("columnNameOfCorruptRecord", "_broken").json(path).withColumn("source", F.input_file_name())
    return raw.where("_broken is null and document_id is not null").drop("_broken"), raw.where("_broken is not null or document_id is null").select("source", F.lit("unreadable_document").alias("reason"))


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of JSON lines with a text; a line without chunk_id is an error, whatever its text."""
    rows = spark.read.schema(CHUNK).json(path)
    checked = rows.withColumn("chunk_id", F.when(F.coalesce("chunk_id", F.lit("")) == "", F.raise_error(F.lit("a chunk has no chunk_id")).cast("string")).otherwise(F.col("chunk_id")))
    return checked.where((F.col("chunk_id") != "") & (F.coalesce("text", F.lit("")) != ""))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON lines; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark rows of a CSV file in the columns of the question table, numbered in file order."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    names = {"Question Nr": "question_nr", "Question": "question", "Type (narrow/broad)": "question_type", "Answer": "answer", "Source": "source"}
    out = raw.select(*[(F.col(f"`{a}`") if a in raw.columns else F.lit(None).cast("string")).alias(b) for a, b in names.items()])
    return out.withColumn("item_id", F.monotonically_increasing_id())


def read_csv_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file, or no rows if it is absent."""
    try:
        return spark.read.schema(schema).option("header", True).csv(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def load_manifest(spark: SparkSession, path: str, documents: str | None = None) -> DataFrame:
    """The corpus manifest; if it is absent, one is built from the documents, keyed by DOI."""
    there = read_table(spark, path, MANIFEST)
    if there is not None:
        return there
    if documents is None:
        return spark.createDataFrame([], MANIFEST)
    docs, _ = read_documents(spark, documents)
    doi = T.normalize_doi(F.coalesce("metadata.doi", F.lit("")))
    rows = docs.select("*", doi.alias("d")).where("d <> ''")
    values = {"source_key": F.concat(F.lit("doi:"), F.col("d")), "source_type": F.col("source_type"), "source": F.col("source_identifier"), "document_id": F.col("document_id"), "output_path": F.col("source"), "extraction_method": F.col("extraction_method"), "doi": F.col("d"), "section_count": F.size("sections")}
    fields = [f.strip().split(" ") for f in MANIFEST.split(",")]
    return rows.select(*[values.get(n, F.lit(None)).cast(t).alias(n) for n, t in fields])
