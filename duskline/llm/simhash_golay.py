"""Near-duplicate documents by SimHash fingerprints, found through Golay-code keys.

Fingerprints of 64 bits come from 3-word shingles. Two fingerprints link at
MAX_BITS = 3 or fewer differing bits. To find links without comparing all pairs,
a fingerprint is cut into three segments of 22, 21 and 21 bits. Each segment is
decoded by the perfect (23, 12) Golay code: every 23-bit word lies within three
bits of exactly one codeword, named by its 12 data bits. A segment's own index
is `near`; with one bit flipped in turn it decodes to at most six indices.
Three errors over three segments leave at least two segments with one error or
none, and there the own index of one side is among the flipped indices of the
other. So each fingerprint is stored under 3 keys (own indices of a pair of
segments) and looked up under about 80. An equi-join brings candidates together,
and the bit count of the exclusive or verifies them. No link is lost.

Equal fingerprints are folded before the join, so copies never make pairs.
Adaptive skew joins split keys that are met by many fingerprints.

Defined cases: null and empty texts have fingerprint zero and link like any
other; fewer than three words make one shingle; a null id takes part but a
component is named by its smallest non-null id (null if it has none).
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duskline.llm.common import dealt
from duskline.llm.graph import components
from duskline.session import settled

MAX_BITS = 3
SEED = 42
SHINGLE = 3
#: Low bit and length of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the binary Golay code.
GENERATOR = 0b101011100011


def fingerprint(text: bytes) -> int:
    """Majority bits of the hashes of all shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    k = min(SHINGLE, len(words))
    lows, highs = [0, *(ends[:len(words) - k] + 1).tolist()], ends[k - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(joined[a:b], SEED) for a, b in zip(lows, highs, strict=True)], np.uint64))


def majority(hashes: np.ndarray) -> int:
    """Bits that are set in over half the hashes; zero if there are none."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(text_col: str, names: list[str]):
    def run(batches):
        for b in batches:
            fp = np.array([fingerprint((t or "").encode()) for t in b[text_col].to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b[c] for c in names), pa.array(fp, pa.int64())], names=[*names, "_sg_fp"])

    return run


def _syndrome(words: np.ndarray) -> np.ndarray:
    left = words.copy()
    for bit in range(22, 10, -1):
        left ^= np.where(left >> np.uint32(bit) & np.uint32(1), np.uint32(GENERATOR << (bit - 11)), np.uint32(0))
    return left


@cache
def _nearest() -> np.ndarray:
    """Index of the codeword nearest to each 23-bit word, piece by piece: a worker holds little more than the table."""
    light = np.array([sum(1 << b for b in bits) for k in range(4) for bits in combinations(range(23), k)], np.uint32)
    error = np.zeros(1 << 11, np.uint32)
    error[_syndrome(light)] = light
    out, piece = np.empty(1 << 23, np.uint16), 1 << 18
    for lo in range(0, len(out), piece):
        n = np.arange(lo, lo + piece, dtype=np.uint32)
        out[lo:lo + piece] = (n ^ error[_syndrome(n)]) >> np.uint32(11)
    return out


def _parts(fp: np.ndarray) -> list[np.ndarray]:
    return [((fp >> np.uint64(low)) & np.uint64((1 << length) - 1)).astype(np.int64) for low, length in SEGMENTS]


def own_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): the three keys a fingerprint is stored under."""
    near, segs = _nearest(), _parts(fp)
    rows, keys = [], []
    for pair, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
        keys.append((pair << 24) | (near[segs[a]].astype(np.int64) << 12) | near[segs[b]])
        rows.append(np.arange(len(fp)))
    return np.concatenate(rows), np.concatenate(keys)


def looked_up_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): all pairs of indices reached with at most one flipped bit in each of two segments."""
    near, reach = _nearest(), []
    for seg, (_, length) in zip(_parts(fp), SEGMENTS, strict=True):
        flips = np.r_[0, 1 << np.arange(length)]
        found = np.sort(near[seg[:, None] ^ flips], axis=1)
        fresh = np.ones(found.shape, bool)
        fresh[:, 1:] = found[:, 1:] != found[:, :-1]
        slot = np.cumsum(fresh, axis=1) - 1
        few = np.full((len(fp), 6), -1, np.int64)
        r, c = np.nonzero(fresh)
        few[r, slot[r, c]] = found[r, c]
        reach.append(few)
    rows, keys = [], []
    for pair, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
        x, y = reach[a][:, :, None], reach[b][:, None, :]
        both = (x >= 0) & (y >= 0)
        rows.append(np.nonzero(both)[0])
        keys.append(((pair << 24) | (x << 12) | y)[both])
    return np.concatenate(rows), np.concatenate(keys)


def _keys(make):
    def run(batches):
        for b in batches:
            fp = b["_sg_fp"].to_numpy()
            rows, keys = make(fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), pa.array(fp[rows])], names=["k", "fp"])

    return run


def links(prints: DataFrame) -> DataFrame:
    """(u, v) for all pairs of different fingerprints (column `_sg_fp`, distinct) with MAX_BITS or fewer differing bits."""
    own = prints.mapInArrow(_keys(own_keys), "k int, fp long")
    seek = prints.mapInArrow(_keys(looked_up_keys), "k int, fp long")
    a, b = own.alias("a"), seek.alias("b")
    close = (F.col("a.k") == F.col("b.k")) & (F.col("a.fp") < F.col("b.fp")) & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= MAX_BITS)
    return a.join(dealt(b), close).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v")).distinct()


def near_groups(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` (default: all) of docs, `_sg_fp` (long), `_sg_group` (smallest id of the group) and `_sg_first` (one row of each group).

    The first row of a group is the one with its smallest id; of rows equal in
    that, any one. Texts are read once; the fingerprints are settled.
    """
    keep = docs.columns if keep is None else keep
    names = list(dict.fromkeys([*keep, id_col]))
    picked = docs.select(*{f"`{c}`": 0 for c in [*names, text_col]})
    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField("_sg_fp", T.LongType())])
    marked = settled(picked.mapInArrow(_fingerprints(text_col, names), schema).withColumn("_sg_row", F.monotonically_increasing_id()))
    lowest = F.min(F.struct(F.col(f"`{id_col}`").isNull().alias("no"), F.col(f"`{id_col}`").cast("long").alias("id"), F.col("_sg_row").alias("row")))
    prints = settled(marked.groupBy("_sg_fp").agg(lowest.alias("low")))
    tied = components(links(prints.select("_sg_fp")))
    rooted = prints.join(tied, prints["_sg_fp"] == tied["u"], "left").select("_sg_fp", F.coalesce("v", "_sg_fp").alias("root"), "low")
    roots = rooted.groupBy("root").agg(F.min("low").alias("low"))
    named = rooted.drop("low").join(roots, "root").select("_sg_fp", F.col("low.id").alias("_sg_group"), F.col("low.row").alias("_sg_least"))
    out = marked.join(dealt(named), "_sg_fp")
    return out.select(*[f"`{c}`" for c in keep], "_sg_fp", "_sg_group", (F.col("_sg_row") == F.col("_sg_least")).alias("_sg_first"))
