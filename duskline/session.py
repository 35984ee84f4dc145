"""Session factory and the few settings the library depends on."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


# Unions of co-partitioned sides may otherwise be zipped partition by partition,
# which fails when adaptive execution gives the sides different partition counts.
SAFE_UNION = ("spark.sql.unionOutputPartitioning", "false")


def get_session(master: str | None = None, app: str = "duskline", **conf: str) -> SparkSession:
    """Build (or reuse) a session with UTC time and adaptive execution.

    On a cluster, pass no master: it comes from spark-submit. Shuffle
    partitions are left to adaptive coalescing, starting from the configured
    value, so the same job fits eight threads and a thousand executors.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config(*SAFE_UNION)
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's spark.checkpoint.dir; set one only where none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if shared:
        sc.setCheckpointDir(shared)
        return
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running iterative operators")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp")))


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, for the operators that solve in Python."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="spark-")) / "duskline.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(target))
    _SHIPPED.add(sc.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: the cluster's checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()


_SCOPES: list[list[str]] = []


def settled(df: DataFrame) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    Used where a folded table feeds several later steps: the raw readings are
    scanned once, lineage is cut, and the files outlive lost executors. The
    read side keeps column pruning and known sizes, so small tables broadcast.
    Its folder is `settled_at` of the result and belongs to the enclosing
    `settled_scope`, if any.
    """
    path = f"{shared_folder(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


@contextmanager
def settled_scope() -> Iterator[list[str]]:
    """Folders that `settled` writes in this block; what is not released in it passes to the block around it."""
    paths: list[str] = []
    _SCOPES.append(paths)
    try:
        yield paths
    finally:
        _SCOPES.pop()
        if _SCOPES:
            _SCOPES[-1].extend(paths)


def release(spark: SparkSession, paths: list[str], keep: Iterable[DataFrame] = ()) -> None:
    """Delete settled folders, but those of `keep`, and take them out of the list. Nothing may read them any more."""
    kept = {df.settled_at for df in keep}
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in [p for p in paths if p not in kept]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
        paths.remove(path)


def forget(spark: SparkSession) -> None:
    """Let executors delete the shuffle files of plans that nothing refers to: Spark does so when the driver's garbage is collected."""
    gc.collect()
    spark._jvm.System.gc()
