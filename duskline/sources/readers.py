"""Readers and scan-time shaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duskline.functions.numeric import try_double


def read_readings(spark: SparkSession, path: str, cols=None) -> DataFrame:
    """Parquet scan of the named columns only."""
    df = spark.read.parquet(path)
    return df if cols is None else df.select(*cols)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, cols=None, **options) -> DataFrame:
    """CSV scan with a declared schema (no inference pass); a byte-order mark is stripped."""
    df = spark.read.options(header=True, **options).schema(schema).csv(path)
    return df if cols is None else df.select(*cols)


def read_json_documents(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One JSON object per file."""
    return spark.read.schema(schema).json(path, multiLine=True)


def parse_ts(c, fmt: str) -> Column:
    """Explicit timestamp format, read as UTC wall clock; unparseable text is NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return F.try_to_timestamp(c, F.lit(fmt)).cast("timestamp_ntz")


def coerce(df: DataFrame, cols, to: str = "double") -> DataFrame:
    """Lenient numeric coercion; text that does not parse (and NaN) becomes NULL."""
    if to == "double":
        return df.withColumns({k: try_double(k) for k in cols})
    return df.withColumns({k: F.col(k).try_cast(to) for k in cols})


def explode_parallel_arrays(df: DataFrame, arrays, keep=()) -> DataFrame:
    """Parallel arrays of a document to one row per position."""
    return df.select(*keep, F.inline(F.arrays_zip(*[F.col(a) for a in arrays])))


def dedupe_by_key(df: DataFrame, keys, priority) -> tuple[DataFrame, DataFrame]:
    """Collapse several requests onto distinct grid keys, keeping the first by priority.

    Returns the kept rows and the request-to-key map. The keep is an aggregate
    (least struct per key), so it combines map-side.
    """
    keys, priority = list(keys), list(priority)
    rest = [c for c in df.columns if c not in keys and c not in priority]
    kept = df.groupBy(*keys).agg(F.min_by(F.struct(*priority, *rest), F.struct(*priority)).alias("__r"))
    return kept.select(*keys, *[F.col(f"__r.{c}").alias(c) for c in priority + rest]), df.select(*priority, *keys)


def distinct_on(df: DataFrame, keys, order) -> DataFrame:
    """First row per key in ascending order of the named columns.

    A least-struct aggregate, so a hot key is combined map-side and never sorted in one task.
    """
    keys, order = list(keys), list(order)
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return first.select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest]).select(*df.columns)
