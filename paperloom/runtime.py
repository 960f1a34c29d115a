"""Session helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from paperloom.errors import ConfigurationError


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the folder that ``spark.checkpoint.dir`` names.

    All executors share that folder, so the result outlives a lost executor. Only a session on one
    machine (tests, a laptop) may leave it unset: a folder of that machine is used then; on a
    cluster that is an error.
    """
    spark = df.sparkSession
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and spark.sparkContext.master.split("[")[0] != "local":
            raise ConfigurationError("spark.checkpoint.dir has to name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), "paperloom-checkpoints"))
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """The rows over as many partitions as there are cores, if they keep fewer than half of them busy.

    For work in Python over plans without a shuffle (scans) and over checkpointed rows. Larger
    inputs have partitions enough and stay as they are; a small file is one partition.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if 2 * df._jdf.rdd().getNumPartitions() <= n else df


def map_rows(df: DataFrame, schema: str, fn: Callable[[dict[str, list]], dict[str, list]], rows: int = 1000) -> DataFrame:
    """Run ``fn`` on slices of Arrow batches as columns of Python lists; it returns columns of ``schema``
    (lists, or Arrow arrays of the right type).

    Slices of at most ``rows`` rows stream, so a task's memory is bounded by one slice and its
    output. An empty result is allowed.
    """
    struct = StructType.fromDDL(schema)
    target = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                cols = fn({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                arrays = [c if isinstance(c := cols[f.name], pa.Array) else pa.array(c, type=f.type) for f in target]
                yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return df.mapInArrow(run, struct)
