"""Writers, and a keyed vector table of parquet versions."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators.relational import split_existing
from paperloom.runtime import durable


def write_documents(df: DataFrame, path: str) -> None:
    """K1: one JSON line per document; raw XML, if there, in a table of its own."""
    if "raw_xml" in df.columns:
        df.where("raw_xml is not null").select("document_id", "raw_xml").write.mode("overwrite").parquet(f"{path}_xml")
        df = df.drop("raw_xml")
    df.write.mode("overwrite").json(path)


POINTER = "_CURRENT"


def _file(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def current_parts(spark: SparkSession, path: str) -> dict[str, str] | None:
    """Part -> folder below ``path`` of the table's current version; None where no version was written."""
    pointer, fs = _file(spark, f"{path.rstrip('/')}/{POINTER}")
    if not fs.exists(pointer):
        return None
    source = fs.open(pointer)
    try:
        return json.loads(bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode())["parts"]
    finally:
        source.close()


def set_current(spark: SparkSession, path: str, parts: dict[str, str]) -> None:
    """Make these folders the table's current version: a pointer file written beside the old one and
    renamed over it, so readers see the old or the new version and a crash leaves the old one. Folders
    of the version before stay for its readers; older ones go."""
    jvm, root = spark.sparkContext._jvm, path.rstrip("/")
    pointer, fs = _file(spark, f"{root}/{POINTER}")
    before = current_parts(spark, path) or {}
    fresh, _ = _file(spark, f"{root}/{POINTER}.{uuid.uuid4().hex}")
    out = fs.create(fresh, True)
    out.write(json.dumps({"parts": parts}).encode())
    out.close()
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(pointer.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fresh, pointer, over)
    kept = {p.split("/")[0] for p in [*parts.values(), *before.values()]}
    for status in fs.listStatus(pointer.getParent()):
        if status.isDirectory() and status.getPath().getName().startswith("v-") and status.getPath().getName() not in kept:
            fs.delete(status.getPath(), True)


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """The current version of a table, or a plain parquet folder; None where nothing was written. A
    table that is there and can't be read is an error, never an empty table."""
    parts = current_parts(spark, path)
    reader = spark.read.schema(schema) if schema else spark.read
    if parts is not None:
        return reader.parquet(*[f"{path.rstrip('/')}/{p}" for p in parts.values()]) if parts else spark.createDataFrame([], schema or "")
    target, fs = _file(spark, path)
    return reader.parquet(path) if fs.exists(target) and fs.listStatus(target) else None


def replace_table(df: DataFrame, path: str) -> None:
    """K3: write a new version of the table, then point to it."""
    version = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path.rstrip('/')}/{version}")
    set_current(df.sparkSession, path, {"": version})


def write_table(df: DataFrame, path: str, kind: str = "json") -> None:
    """A result as JSON lines, CSV with a header, or parquet."""
    w = df.write.mode("overwrite")
    {"json": w.json, "csv": w.option("header", True).csv, "parquet": w.parquet}[kind](path)


def write_record(spark: SparkSession, record: dict, path: str) -> None:
    """K6, K8: one JSON object as one small file."""
    target, fs = _file(spark, path)
    out = fs.create(target, True)
    out.write(json.dumps(record, indent=1, ensure_ascii=False).encode())
    out.close()


def union_columns(parts: list[DataFrame], preferred: list[str]) -> DataFrame:
    """Rows of all parts over the union of their columns, preferred ones first."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    first = [c for c in preferred if c in out.columns]
    return out.select(*first, *[c for c in out.columns if c not in first])


def markdown(df: DataFrame, columns: list[str], limit: int = 1000) -> str:
    """A report table of the present columns; a report has ``limit`` rows at most."""
    cols = [c for c in columns if c in df.columns]
    rows = df.select(*cols).limit(limit).collect()
    lines = ["| " + " | ".join(cols) + " |", "|" + " --- |" * len(cols)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows])


class VectorStore:
    """Chunks with embeddings, keyed by chunk_id, in buckets of the key's hash.

    An upsert rewrites only the buckets that it touches, into a new version; all of them become
    current at once. ``buckets`` is fixed when the store is first written: with about 10^6 rows a
    bucket, small upserts stay small.
    """

    SCHEMA = "chunk_id string, document_id string, text string, embedding array<double>"

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path = spark, path.rstrip("/")
        parts = current_parts(spark, self.path)
        self.buckets = int(parts["buckets"].rpartition("=")[2]) if parts else buckets

    def _parts(self) -> dict[str, str]:
        return {k: v for k, v in (current_parts(self.spark, self.path) or {}).items() if k != "buckets"}

    def _load(self, parts: list[str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(*[f"{self.path}/{p}" for p in parts])

    def read(self) -> DataFrame:
        """All rows; none before the first upsert."""
        return self._load(list(self._parts().values()))

    def missing(self, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Chunks to be embedded and chunks that are there already."""
        return split_existing(chunks, self.read(), "chunk_id")

    def upsert(self, rows: DataFrame) -> None:
        """Insert or replace by key."""
        bucket = F.pmod(F.xxhash64("chunk_id"), F.lit(self.buckets))
        new = rows.dropDuplicates(["chunk_id"]).select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in self.SCHEMA.split(", ")])
        new = durable(new.withColumn("bucket", bucket))
        touched = [str(r[0]) for r in new.select("bucket").distinct().collect()]
        parts = self._parts()
        old = self._load([parts[b] for b in touched if b in parts]).withColumn("bucket", bucket)
        version = f"v-{uuid.uuid4().hex}"
        merged = old.join(new.select("bucket", "chunk_id"), ["bucket", "chunk_id"], "left_anti").unionByName(new)
        merged.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{version}")
        self._point(parts | {b: f"{version}/bucket={b}" for b in touched})

    def _point(self, parts: dict[str, str]) -> None:
        set_current(self.spark, self.path, parts | {"buckets": f"buckets={self.buckets}"})

    def reset(self) -> None:
        """An empty table."""
        self._point({})

    def preflight(self) -> dict:
        """K7: rows and dimensions."""
        r = self.read().agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d")).first()
        return {"count": r["n"], "dimensions": r["d"]}
