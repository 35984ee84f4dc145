"""Sinks."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write(df: DataFrame, folder: str, name: str, fmt: str = "parquet", partition_by=(), mode: str = "overwrite") -> str:
    """Write one dataset per result as parquet, csv or json, and return its path."""
    path = f"{str(folder).rstrip('/')}/{name}"
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return path


def _input_key(df: DataFrame) -> str:
    """Name of a result: its plan, its schema, and the input files with their times and sizes."""
    parts = [str(df.semanticHash()), df.schema.json()]
    files = sorted(df.inputFiles())
    if files:
        listed = df.sparkSession.read.format("binaryFile").load(files).select("path", "modificationTime", "length")  # contents are not read
        parts += sorted(f"{r[0]} {r[1].isoformat()} {r[2]}" for r in listed.collect())
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()[:32]


def _published(spark: SparkSession, base: str) -> str | None:
    """The run that all readers use: the first by name of those that have been published."""
    try:
        return spark.read.schema("run string").parquet(f"{base}/mark-*").agg(F.min("run")).first()[0]
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e.getCondition()):
            return None
        raise


def cached(df: DataFrame, path: str, partition_by=()) -> DataFrame:
    """Materialise once in shared storage and read it back; later stages reuse the files.

    What is stored is named by the plan and by the input files with their times and
    sizes, so another input, or a changed one, never meets an old result. A result
    is written to a folder of its own, and only after that write has been committed a mark
    naming the folder is written; readers look for marks alone. So a write that
    fails half-way is never read, and of several writers at a time each publishes a
    whole result and all later readers take the same one. Nothing is renamed, so
    object stores serve as well.
    """
    spark, schema = df.sparkSession, df.schema
    base = f"{path.rstrip('/')}/{_input_key(df)}"
    run = _published(spark, base)
    if run is None:
        own = f"run-{uuid.uuid4().hex}"
        writer = df.write.mode("errorifexists")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(f"{base}/{own}")
        spark.createDataFrame([(own,)], "run string").coalesce(1).write.parquet(f"{base}/mark-{own}")
        run = _published(spark, base)
    return spark.read.schema(schema).parquet(f"{base}/{run}")
