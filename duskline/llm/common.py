"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession

from duskline.session import SAFE_UNION, ship_package

#: Rows of one Arrow batch; documents can be long, so batches are kept short.
BATCH_ROWS = 500
LAST = np.iinfo(np.int64).max


def prepare(spark: SparkSession) -> None:
    """Ship the package to the executors and keep Arrow batches of long texts small."""
    ship_package(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set(*SAFE_UNION)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """A side that is never broadcast. Spark sizes a table from its compressed file, and rows that a Python step or an explode
    makes as if there were one for each of its input: what it takes for a few MB can be hundreds of times as much."""
    return df.hint("merge")


def width(spark: SparkSession) -> int:
    """Buckets of a shuffle: the cluster's own setting, so they grow as it does."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a column and len + 1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = pc.fill_null(pc.cast(column, pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0]:offs[-1]], offs - offs[0]


def integers(column) -> np.ndarray:
    """A long column as int64; null sorts last."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(pc.fill_null(column, LAST)).astype(np.int64, copy=False)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of equal length, column after column, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def unpack(blobs, *dtypes) -> list[np.ndarray]:
    """Inverse of `pack` over a list of blobs, concatenated. A dtype may carry a row shape: ('u1', 84)."""
    one = [np.dtype(d) if not isinstance(d, tuple) else np.dtype((d[0], (d[1],))) for d in dtypes]
    row = sum(d.itemsize for d in one)
    found: list[list[np.ndarray]] = [[] for _ in one]
    for blob in blobs:
        raw = zstandard.ZstdDecompressor().decompress(blob)
        n, at = len(raw) // row, 0
        for into, d in zip(found, one, strict=True):
            into.append(np.frombuffer(raw, d.base, count=n * (d.itemsize // d.base.itemsize), offset=at).reshape((n, *d.shape)))
            at += n * d.itemsize
    return [np.concatenate(x) if x else np.zeros((0, *d.shape), d.base) for x, d in zip(found, one, strict=True)]


def by_bucket(bucket: np.ndarray, *arrays: np.ndarray):
    """(bucket, packed rows) of each bucket that has rows, rows in their order."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    starts = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
    arrays = [a[order] for a in arrays]
    for lo, hi in zip(starts, [*starts[1:], len(b)], strict=True):
        yield int(b[lo]), pack(*(a[lo:hi] for a in arrays))


def blob_batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "blob"])


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class Remembered(dict):
    """Key -> line of ids that are kept flat; unknown keys get the next line and wait in `fresh` until `fill`."""

    def __init__(self):
        super().__init__()
        self.fresh: list = []
        self.flat, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def __missing__(self, key) -> int:
        line = len(self)
        self[key] = line
        self.fresh.append(key)
        return line

    def lines(self, lists: list[list]) -> tuple[np.ndarray, np.ndarray]:
        """Lines of all keys of all lists, and len + 1 offsets of the lists."""
        offs = np.cumsum([0, *map(len, lists)])
        return np.fromiter((i for keys in lists for i in map(self.__getitem__, keys)), np.int64, int(offs[-1])), offs

    def fill(self, sizes: list[int], ids: np.ndarray) -> None:
        """Ids of the fresh keys one after another, in their order, and how many each has."""
        self.ends = np.r_[self.ends, self.ends[-1] + np.cumsum(sizes, dtype=np.int64)]
        self.flat = np.concatenate([self.flat, ids]).astype(np.uint32, copy=False)
        self.fresh = []

    def ids(self, lines: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all lists and their offsets."""
        first = self.ends[lines]
        n = self.ends[lines + 1] - first
        ends = np.r_[0, np.cumsum(n)]
        at = np.repeat(first - ends[:-1], n)
        at += np.arange(len(at))
        return self.flat[at], ends[offs]
