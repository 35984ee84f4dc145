"""Input checks. Each returns a small DataFrame of findings; `require` turns findings into an error."""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duskline.session import settled


class CheckFailed(ValueError):
    """Raised with every failed check at once."""


def require(findings: DataFrame, what: str, shown: int = 20) -> None:
    """Raise if there are findings: all of them are counted and kept as a table, some are shown."""
    kept = settled(findings)
    n = kept.count()
    if n:
        rows = "; ".join(str(r.asDict()) for r in kept.limit(shown).collect())
        raise CheckFailed(f"{what}: {n} findings, all in {kept.inputFiles()[0].rsplit('/', 1)[0]}; {rows}")


def require_columns(df: DataFrame, cols, label: str = "table") -> list[str]:
    """Missing columns, from the schema alone."""
    missing = sorted(set(cols) - set(df.columns))
    if missing:
        raise CheckFailed(f"{label} is missing required columns: {missing}")
    return missing


def checksums(df: DataFrame, key: str, content: str) -> DataFrame:
    """SHA-256 per item. For files use `file_digests`."""
    return df.select(F.col(key).alias("key"), F.sha2(F.col(content), 256).alias("observed"))


def _hashing(batches):
    """Lines of files, in order -> one row per file. Lines are joined again; the file's size tells what its ends were."""
    path, digest, size, read, lines, done = None, None, 0, 0, 0, []

    def close():
        missing = size - read
        if missing == 1:
            digest.update(b"\n")
        done.append((path, size, lines, digest.hexdigest() if missing in (0, 1) else None))

    def out():
        columns = list(zip(*done, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["path", "size", "lines", "sha256"])

    for b in batches:
        for p, n, line in zip(b["path"].to_pylist(), b["size"].to_pylist(), b["line"], strict=True):
            if p != path:
                if path is not None:
                    close()
                path, digest, size, read, lines = p, hashlib.sha256(), n, 0, 0
            else:
                digest.update(b"\n")
                read += 1
            raw = line.as_buffer()
            digest.update(raw)
            read, lines = read + raw.size, lines + 1
        if done:
            yield out()
            done.clear()
    if path is not None:
        close()
        yield out()


def file_digests(spark: SparkSession, paths) -> DataFrame:
    """path, size, lines and sha256 of every file under the paths, of any size.

    Files are read in splits through Spark's own reader, as byte runs between
    line feeds; the runs of a file pass one task in order, as a stream, so neither a file nor a
    split is held whole. The digest is NULL where the reader changes bytes
    (compressed suffixes, a byte-order mark). Empty files have no rows to read and are not listed.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(paths)
    at = F.col("_metadata")
    rows = lines.select(at["file_path"].alias("path"), at["file_size"].alias("size"), at["file_block_start"].alias("start"), F.col("value").cast("binary").alias("line"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    ordered = rows.repartition("path").sortWithinPartitions("path", "start", "row").select("path", "size", "line")
    return ordered.mapInArrow(_hashing, "path string, size long, lines long, sha256 string")


def verify_files(spark: SparkSession, paths, manifest: DataFrame) -> DataFrame:
    """file, size, sha256 and status of a manifest (file, expected): ok, altered, missing, or unexpected for files that it does not name.

    file: the path below the folder that was given, or its last part.
    """
    roots = [p.rstrip("/") for p in ([paths] if isinstance(paths, str) else paths)]
    name = F.element_at(F.split("path", "/"), -1)
    for root in roots:
        inside = F.instr("path", root + "/")
        name = F.when(inside > 0, F.substring("path", inside + F.lit(len(root) + 1), F.length("path"))).otherwise(name)
    seen = file_digests(spark, roots).withColumn("file", name)
    both = manifest.join(seen, "file", "full")
    status = (F.when(F.col("path").isNull(), "missing").when(F.col("expected").isNull(), "unexpected")
              .when(F.col("sha256") == F.col("expected"), "ok").otherwise("altered"))
    return both.select("file", "size", "sha256", status.alias("status"))


def validate_manifest(observed: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest (key, expected) against observed checksums: ok, mismatch or missing."""
    j = manifest.join(observed, "key", "left")
    status = (
        F.when(F.col("observed").isNull(), "missing")
        .when(F.col("observed") == F.col("expected"), "ok")
        .otherwise("mismatch")
    )
    return j.select("key", status.alias("status"))


def check_invariants(df: DataFrame, rules: dict[str, tuple[Column, Column]]) -> DataFrame:
    """All rules in one aggregate pass: rule -> (observed aggregate, test on 'observed').

    A rule's test is a Column over `observed`, the aggregate as a double. Every
    failure is reported, not only the first.
    """
    names = list(rules)
    row = df.agg(*[rules[n][0].cast("double").alias(n) for n in names])
    long = row.unpivot([], names, "rule", "observed")
    ok = reduce(lambda acc, n: acc.when(F.col("rule") == n, rules[n][1]), names[1:],
                F.when(F.col("rule") == names[0], rules[names[0]][1]))
    return long.withColumn("ok", F.coalesce(ok, F.lit(False)))


def duplicate_keys(df: DataFrame, keys) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def assert_unique(df: DataFrame, keys) -> None:
    require(duplicate_keys(df, keys), f"duplicate keys {keys}")


def checked_join(left: DataFrame, right: DataFrame, on, how: str = "inner", validate: str = "one_to_one") -> DataFrame:
    """Join after checking the promised cardinality of each side."""
    sides = {"one_to_one": (left, right), "many_to_one": (right,), "one_to_many": (left,)}[validate]
    for side in sides:
        assert_unique(side, on)
    return left.join(right, on, how)


def uncovered(a: DataFrame, b: DataFrame, key) -> DataFrame:
    """Keys of b that never occur in a."""
    key = [key] if isinstance(key, str) else list(key)
    return b.select(*key).distinct().join(a.select(*key), key, "left_anti")


def not_finite(df: DataFrame, cols) -> DataFrame:
    """Per column, the number of NULL, NaN and infinite values."""
    bad = {
        c: F.count_if(F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))).alias(c) for c in cols
    }
    return df.agg(*bad.values()).unpivot([], list(cols), "field", "n_bad")


def disagreement(a: DataFrame, b: DataFrame, key, left: str, right: str, tol: float = 1e-12) -> DataFrame:
    """One row: matched rows, largest absolute difference, rows beyond tol, one-sided NULLs."""
    j = a.select(key, F.col(left).alias("__l")).join(b.select(key, F.col(right).alias("__r")), key)
    d = F.abs(F.col("__l") - F.col("__r"))
    return j.agg(
        F.count("*").alias("n"),
        F.max(d).alias("max_abs_diff"),
        F.count_if(d > tol).alias("n_beyond"),
        F.count_if(F.col("__l").isNull() != F.col("__r").isNull()).alias("n_null_mismatch"),
    )


def metric_rows(df: DataFrame, category: str, metrics: dict[str, Column], units: dict[str, str] | None = None) -> DataFrame:
    """Long register of aggregates of one table: category, metric, numeric_value, units."""
    units = units or {}
    row = df.agg(*[e.cast("double").alias(k) for k, e in metrics.items()])
    long = row.unpivot([], list(metrics), "metric", "numeric_value")
    unit = F.create_map(*[F.lit(x) for k in metrics for x in (k, units.get(k, ""))])
    return long.select(F.lit(category).alias("category"), "metric", "numeric_value", unit[F.col("metric")].alias("units"))


def flatten_text(c) -> Column:
    """Collapse every run of white space to one blank."""
    return F.regexp_replace(c, r"\s+", " ")


def claims_in_text(claims: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """For each (claim, needle), in how many texts it occurs after white-space folding.

    Claims are a written list; they ride as one array through a single pass over
    the texts, and only counts are shuffled.
    """
    arr = claims.agg(F.collect_list(F.struct("claim", "needle")).alias("a")).scalar()
    flat = docs.select(flatten_text(F.col(text)).alias("__t"))
    hits = flat.withColumn("c", F.explode(arr)).where(
        F.col("__t").contains(F.col("c.needle"))
    ).groupBy(F.col("c.claim").alias("claim")).agg(F.count("*").alias("n_texts"))
    return claims.join(hits, "claim", "left").select(
        "claim", "needle", F.coalesce("n_texts", F.lit(0)).alias("n_texts"), F.col("n_texts").isNotNull().alias("found")
    )
