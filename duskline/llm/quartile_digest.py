"""Document fingerprints: quartile bucket digests.

Byte triplets of a text (three neighbours, and two neighbours with the third
one place further) are hashed into BUCKETS counters. A digest holds, for every
counter, the quartile its count falls in (two bits), and the length of the text
on a logarithmic scale. Two digests are compared by the sum of quartile steps
(a step over all three counts double) and of lengths; the sum is bounded, and
likeness runs from 0 to 1.

`chain` pairs every document with the next one in descending id. Documents are
dealt to ranges of ids; the first document of each range also goes to the range
before it, so one shuffle of the texts is enough and no task sees more than one
range. The cut points (one id per range) are all that passes the driver.

Defined cases: a null text counts as empty; texts under three bytes have zero
counts; a null id is the smallest; rows with equal ids follow each other in
order of their texts; a lone row is its own next; other columns may be kept.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskline.llm.common import width

BUCKETS = 256
#: Difference at which likeness is 0.
BOUND = 320
_LOWEST = -(1 << 63)


def counters(texts: list[bytes]) -> np.ndarray:
    """Counts of hashed triplets, one line per text."""
    buf = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    n = len(buf)
    counts = np.zeros(len(texts) * BUCKETS, np.int64)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32) * BUCKETS, np.diff(np.r_[0, ends]))
    wide = buf.astype(np.uint32)
    for gap, salt in ((2, 0x9E3779B1), (3, 0x85EBCA6B)):
        if n <= gap:
            continue
        h = (wide[:-gap] << np.uint32(16)) | (wide[1:n - gap + 1] << np.uint32(8))
        h |= wide[gap:]
        h *= np.uint32(salt)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0xC2B2AE35)
        at = (h >> np.uint32(24)).astype(np.int32)
        at += doc[:-gap]
        inside = doc[:-gap] == doc[gap:]
        counts += np.bincount(at[inside], minlength=len(counts))
    return counts.reshape(-1, BUCKETS)


def digests(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Quartile codes (texts x BUCKETS) and length codes."""
    counts = counters(texts)
    q = np.sort(counts, axis=1)[:, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = (counts[:, :, None] > q[:, None, :]).sum(axis=2).astype(np.uint8)
    length = np.round(8 * np.log2(1 + np.array([len(t) for t in texts], np.float64))).astype(np.int64)
    return codes, np.minimum(length, 0xFFFF)


def as_text(codes: np.ndarray, length: np.ndarray) -> list[str]:
    """Hex digits: four of the length, then two bits per counter."""
    four = codes.reshape(len(codes), -1, 4)
    packed = (four << np.array([6, 4, 2, 0], np.uint8)).sum(axis=2).astype(np.uint8)
    return [f"{int(n):04x}{row.tobytes().hex()}" for n, row in zip(length, packed, strict=True)]


def parse(prints: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Inverse of as_text."""
    raw = np.frombuffer(bytes.fromhex("".join(p[4:] for p in prints)), np.uint8).reshape(len(prints), -1)
    return (raw[:, :, None] >> np.array([6, 4, 2, 0], np.uint8) & 3).reshape(len(prints), -1), np.array([int(p[:4], 16) for p in prints])


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """1 for equal digests, down to 0 at a difference of BOUND or more; line by line."""
    step = np.abs(a[0].astype(np.int16) - b[0])
    diff = np.where(step == 3, 6, step).sum(axis=1) + np.abs(a[1] - b[1])
    return 1.0 - np.minimum(diff, BOUND) / BOUND


def _chained(batches):
    carry: list[tuple] = []
    for b in batches:
        rows = carry + list(zip(b["_qd_ctx"].to_pylist(), b["doc_id"].to_pylist(), [t or "" for t in b["_qd_text"].to_pylist()], strict=True))
        carry = rows[-1:]
        at = [i for i in range(len(rows) - 1) if not rows[i][0]]
        if not at:
            continue
        plain = digests([r[2].encode() for r in rows])
        edited = []
        for i in at:
            t, after = rows[i][2], rows[i + 1][2]
            k = len(t) // 3
            edited.append((t[:len(t) - k] + after[:k]).encode())
        ed = digests(edited)
        own = (plain[0][at], plain[1][at])
        after = (plain[0][np.array(at) + 1], plain[1][np.array(at) + 1])
        yield pa.RecordBatch.from_arrays([
            pa.array([rows[i][1] for i in at], pa.int64()), pa.array([len(rows[i][2]) for i in at], pa.int64()),
            pa.array([hashlib.sha256(e).hexdigest() for e in edited]), pa.array(as_text(*own)), pa.array(as_text(*ed)),
            pa.array(likeness(own, ed)), pa.array(likeness(own, after))],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def chain(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    ranges = 2 * width(docs.sparkSession)
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("_qd_text"))
    key = F.coalesce("doc_id", F.lit(_LOWEST))
    cuts = base.agg(F.percentile_approx(key, [i / ranges for i in range(1, ranges)], 20 * ranges).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts))
    steps = F.array(*map(F.lit, cuts)).cast("array<bigint>")
    ranged = base.withColumn("_qd_key", key).withColumn("_qd_part", F.size(F.filter(steps, lambda c: c < F.col("_qd_key"))))
    tops = {r["_qd_part"]: r["top"] for r in ranged.groupBy("_qd_part").agg(F.max("_qd_key").alias("top")).collect()}
    parts = sorted(tops)
    goes = [(tops[below], part) for below, part in zip(parts, parts[1:] + parts[:1], strict=True)]
    # the first of a range follows the last of the range above; the first of all follows the last of all
    goes = F.create_map(*[F.lit(x) for pair in goes for x in pair]) if goes else F.create_map().cast("map<bigint,int>")
    also = F.try_element_at(goes, F.col("_qd_key"))
    places = F.array(F.struct(F.col("_qd_part").alias("part"), F.lit(False).alias("ctx")), F.when(also.isNotNull(), F.struct(also.alias("part"), F.lit(True).alias("ctx"))))
    dealt = ranged.withColumn("_qd_place", F.explode(F.array_compact(places))).select("doc_id", "_qd_text", "_qd_key", "_qd_place.part", F.col("_qd_place.ctx").alias("_qd_ctx"))
    sorted_ = dealt.repartition(ranges, "part").sortWithinPartitions("part", "_qd_ctx", F.col("_qd_key").desc(), "_qd_text")
    one = sorted_.withColumn("_qd_more", F.lit(0)).select("doc_id", "_qd_text", "_qd_ctx", "part")
    return one.mapInArrow(_ends_at_context, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _ends_at_context(batches):
    """Only the first context row of a range (the largest id, ties by text) follows its last document; further ties are dropped."""

    def trimmed():
        last = (None, False)
        for b in batches:
            keep = []
            for part, ctx in zip(b["part"].to_pylist(), b["_qd_ctx"].to_pylist(), strict=True):
                keep.append(not (ctx and last == (part, True)))
                last = (part, ctx)
            yield b.filter(pa.array(keep, pa.bool_()))

    yield from _chained(trimmed())
