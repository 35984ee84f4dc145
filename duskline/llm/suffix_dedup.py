"""Removal of repeated byte strings by merging Burrows-Wheeler transforms.

What is found: every byte that is covered by a WIDTH-byte string which also
starts in a document with a smaller id.

How it is spread. Each WIDTH-byte string owns one anchor: the GRAM bytes in it
whose hash is smallest (leftmost on ties). Equal strings own equal anchors, so
1. anchors are found on the scan and packed by hash bucket (about one anchor
   in 18 bytes); only those met in two or more documents stay;
2. for these, the text around the anchor (a window of SIDE + WIDTH bytes) goes
   to the bucket of the anchor. Windows are aligned at the anchor, so the
   suffixes that start at one column form one family;
3. in a bucket, each shard of windows has its own transform, column by column:
   the symbols that precede its sorted suffixes. Shards are merged by refining
   the interleave, one symbol further left at a time: the interleave vector is
   distributed stably by the preceding symbols and never re-sorted. Common
   prefix lengths follow from range minima between neighbours that land
   together. Runs with a common prefix of at least WIDTH are the repeated
   intervals; their smallest id decides what is marked;
4. marks return to their documents, where runs are cut out.

No step gathers more than one bucket; the number of buckets is the session's
number of shuffle partitions. Documents travel once: both cogroups reuse one
exchange. Everything is one lazy plan, so a lost executor recomputes its part.

Defined cases: a null or empty text has no strings and stays as it is; a null
id counts as larger than every id; rows with equal ids never remove each
other's bytes; equal rows get equal results; other columns are passed through
untouched (internal columns start with `_sd_`); an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duskline.llm.common import LAST, blob_batch, by_bucket, integers, mix64, pack, text_bytes, unpack, width

WIDTH = 50
GRAM = 16
SIDE = WIDTH - GRAM
WINDOW = SIDE + WIDTH
#: Bytes of text whose anchors are found at a time; must stay below 2^24.
BLOCK = 1 << 20
SHARDS = 4
#: Windows of a bucket that are merged at a time, about.
ROWS = 1 << 15
_POS = np.uint64((1 << 24) - 1)
_BLOBS = "bucket int, blob binary"


def anchors(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and 40-bit hashes of the anchors of all WIDTH-byte strings inside [start, end) ranges of buf."""
    n = len(buf)
    if n < WIDTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = buf.astype(np.uint64) + np.uint64(1)
    for i, step in enumerate((1, 2, 4, 8)):
        left = h[:-step] * np.uint64(0xBF58476D1CE4E5B9 + 2 * i)
        left += h[step:]
        h = left
    h = mix64(h)
    h &= ~_POS
    h |= np.arange(len(h), dtype=np.uint64)
    for step in (1, 2, 4, 8, 16, 3):  # minimum over SIDE + 1 = 35 grams
        h = np.minimum(h[:-step], h[step:])
    inside = np.ones(len(h), bool)
    tails = ends[:, None] - 1 - np.arange(WIDTH - 1)
    tails = tails[(tails >= starts[:, None]) & (tails < len(h))]
    inside[tails] = False
    h = h[inside]
    if len(h):
        h = h[np.r_[True, h[1:] != h[:-1]]]
    return (h & _POS).astype(np.int64), h >> np.uint64(24)


def _blocks(offs: np.ndarray):
    """(first row, end row, low, high): runs of whole documents of about BLOCK bytes, or overlapping pieces of one long document."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + BLOCK, side="right")) - 1)
        if offs[j] - offs[i] <= 2 * BLOCK:
            yield i, j, offs[i], offs[j]
        else:
            for lo in range(int(offs[i]), int(offs[j]), BLOCK):
                yield i, j, lo, min(lo + BLOCK + WIDTH - 1, int(offs[j]))
        i = j


def _runs(offs: np.ndarray) -> list[tuple[int, int]]:
    """Runs of whole documents of about BLOCK bytes, or one longer document; one empty run if there are none."""
    n, i, out = len(offs) - 1, 0, []
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + BLOCK, side="right")) - 1)
        out.append((i, j))
        i = j
    return out or [(0, 0)]


def _anchor_task(buckets: int):
    def run(batches):
        for batch in batches:
            keys, ids = integers(batch["_sd_key"]), integers(batch["_sd_id"])
            buf, offs = text_bytes(batch["_sd_text"])
            got = []
            for i, j, lo, hi in _blocks(offs):
                s, e = np.maximum(offs[i:j], lo), np.minimum(offs[i + 1:j + 1], hi)
                pos, h = anchors(buf[lo:hi], s - lo, e - lo)
                row = np.searchsorted(offs, pos + lo, side="right") - 1
                got.append((h, keys[row].astype(np.int32), ids[row], (pos + lo - offs[row]).astype(np.int32)))
            if got:
                h, k, d, p = (np.concatenate(x) for x in zip(*got, strict=True))
                rows = list(by_bucket((h % np.uint64(buckets)).astype(np.int32), (h & np.uint64(0xFFFFFFFF)).astype(np.uint32), (h >> np.uint64(32)).astype(np.uint8), k, d, p))
                if rows:
                    yield blob_batch(rows)

    return run


def _shared_task(buckets: int):
    def run(group: pa.Table) -> pa.Table:
        low, high, key, doc, pos = unpack(group["blob"].to_pylist(), "u4", "u1", "i4", "i8", "i4")
        h = low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32))
        order = np.argsort(h, kind="stable")
        hs, ds = h[order], doc[order]
        first = np.flatnonzero(np.r_[True, hs[1:] != hs[:-1]])
        several = np.minimum.reduceat(ds, first) < np.maximum.reduceat(ds, first)
        keep = order[np.repeat(several, np.diff(np.r_[first, len(hs)]))]
        key, doc, pos = key[keep], doc[keep], pos[keep]
        return pa.Table.from_batches([blob_batch(list(by_bucket((key % buckets).astype(np.int32), key, doc, pos)))])

    return run


def _find(keys: np.ndarray, ids: np.ndarray, key: np.ndarray, doc: np.ndarray, pos: np.ndarray):
    """(row, position, entry) for each row with the key and id of an entry; equal rows have equal keys."""
    order = np.argsort(keys, kind="stable")
    sk = keys[order]
    lo, hi = np.searchsorted(sk, key, "left"), np.searchsorted(sk, key, "right")
    entry = np.repeat(np.arange(len(key)), hi - lo)
    within = np.arange(len(entry)) - np.repeat(np.r_[0, np.cumsum(hi - lo)[:-1]], hi - lo)
    row = order[lo[entry] + within]
    own = ids[row] == doc[entry]
    return row[own], pos[entry[own]], entry[own]


def _gram_hash(grams: np.ndarray) -> np.ndarray:
    words = np.ascontiguousarray(grams).view(np.uint64)
    return mix64(words[:, 0] ^ mix64(words[:, 1]))


def _window_task(buckets: int, text_col: str):
    def run(docs: pa.Table, marks: pa.Table) -> pa.Table:
        key, doc, pos = unpack(marks["blob"].to_pylist(), "i4", "i8", "i4")
        if not len(key) or not docs.num_rows:
            return pa.Table.from_batches([blob_batch([])])
        keys, ids = integers(docs["_sd_key"]), integers(docs["_sd_id"])
        first = np.unique(np.stack([keys, ids]), axis=1, return_index=True)[1]  # equal rows need one window
        buf, offs = text_bytes(docs[text_col])
        row, pos, _ = _find(keys[first], ids[first], key, doc, pos)
        row = first[row]
        left, right = np.minimum(pos, SIDE), np.minimum(offs[row + 1] - offs[row] - pos, WIDTH)
        padded = np.concatenate([np.zeros(SIDE, np.uint8), buf, np.zeros(WIDTH, np.uint8)])
        at = offs[row] + pos
        b = (_gram_hash(sliding_window_view(padded, GRAM)[at + SIDE]) % np.uint64(buckets)).astype(np.int32)
        order, out = np.argsort(b, kind="stable"), []
        for some in np.split(order, np.flatnonzero(np.diff(b[order])) + 1) if len(order) else []:  # windows of one bucket at a time
            out.append((int(b[some[0]]), pack(sliding_window_view(padded, WINDOW)[at[some]], keys[row[some]].astype(np.int32), ids[row[some]], pos[some],
                                              left[some].astype(np.uint8), right[some].astype(np.uint8))))
        return pa.Table.from_batches([blob_batch(out)])

    return run


def shard_transform(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Transform of one shard of aligned windows.

    Line c of the first result: the symbols of column c in the order of the
    suffixes that start at column c + 1. Line c of the second, for the columns
    where a WIDTH-byte string can start: the rows in suffix order.
    """
    columns = np.ascontiguousarray(rows.T)
    order = np.arange(len(rows), dtype=np.int32)
    bwt, orders = np.empty_like(columns), np.empty((SIDE + 1, len(rows)), np.int32)
    for c in range(WINDOW - 1, -1, -1):
        bwt[c] = columns[c][order]
        order = order[np.argsort(bwt[c], kind="stable")]
        if c <= SIDE:
            orders[c] = order
    return bwt, orders


def _range_minima(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """min(values[lo..hi]) for each pair, both ends included."""
    level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
    n, tables = len(values), [values]
    for k in range(int(level.max(initial=0))):
        t = tables[-1].copy()
        np.minimum(t[:n - (1 << k)], tables[-1][1 << k:], out=t[:n - (1 << k)])
        tables.append(t)
    flat, base = np.concatenate(tables), level.astype(np.int64) * n
    return np.minimum(flat[base + lo], flat[base + hi - (np.int64(1) << level.astype(np.int64)) + 1])


def merge_transforms(shards: list[tuple[np.ndarray, np.ndarray]]):
    """Merge shard transforms; yields (column, rows in merged order, common prefix with the row before) where strings can start.

    The interleave says which shard each merged suffix comes from. One pass per
    column reads every shard's symbols in interleave order and distributes the
    interleave stably by symbol: it is then right for suffixes one longer.
    """
    sizes = [b.shape[1] for b, _ in shards]
    base = np.cumsum([0, *sizes])
    inter = np.repeat(np.arange(len(shards), dtype=np.uint8), sizes)
    lcp = np.zeros(len(inter), np.uint8)
    sym = np.empty(len(inter), np.uint8)
    for c in range(WINDOW - 1, -1, -1):
        for s, (bwt, _) in enumerate(shards):
            sym[inter == s] = bwt[c]
        step = np.argsort(sym, kind="stable")
        same = sym[step[1:]] == sym[step[:-1]]
        fresh = np.zeros(len(inter), np.uint8)
        at = np.flatnonzero(same) + 1
        fresh[at] = _range_minima(lcp, step[at - 1] + 1, step[at]) + 1 if c < WINDOW - 1 else 1
        lcp, inter = fresh, inter[step]
        if c <= SIDE:
            rows = np.empty(len(inter), np.int64)
            for s, (_, orders) in enumerate(shards):
                rows[inter == s] = orders[c] + base[s]
            yield c, rows, lcp


def repeated_starts(wins: np.ndarray, doc: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Bit c of a row: the WIDTH-byte string at its column c is whole and starts in a document with a smaller id too."""
    cuts = np.linspace(0, len(wins), min(SHARDS, max(1, len(wins))) + 1).astype(int)
    shards = [shard_transform(wins[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
    bits = np.zeros(len(wins), np.uint64)
    for c, rows, lcp in merge_transforms(shards):
        whole = (SIDE - c <= left[rows]) & (WIDTH - SIDE + c <= right[rows])
        d = doc[rows]
        first = np.flatnonzero(np.r_[True, lcp[1:] < WIDTH])
        least = np.repeat(np.minimum.reduceat(np.where(whole, d, LAST), first), np.diff(np.r_[first, len(rows)]))
        hit = rows[whole & (least < d)]
        bits[hit] |= np.uint64(1 << c)
    return bits


def _starts_by_part(wins: np.ndarray, doc: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """repeated_starts of a bucket, in parts of about ROWS windows; equal strings own equal anchors, so windows of one anchor stay together."""
    parts = -(-len(wins) // ROWS)
    if parts <= 1:
        return repeated_starts(wins, doc, left, right)
    part = ((_gram_hash(wins[:, SIDE:SIDE + GRAM]) >> np.uint64(32)) % np.uint64(parts)).astype(np.int32)
    order, bits = np.argsort(part, kind="stable"), np.zeros(len(wins), np.uint64)
    for some in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
        bits[some] = repeated_starts(wins[some], doc[some], left[some], right[some])
    return bits


def _merge_task(buckets: int):
    def run(group: pa.Table) -> pa.Table:
        wins, key, doc, pos, left, right = unpack(group["blob"].to_pylist(), ("u1", WINDOW), "i4", "i8", "i4", "u1", "u1")
        bits = _starts_by_part(wins, doc, left, right)
        hit = bits > 0
        return pa.Table.from_batches([blob_batch(list(by_bucket((key[hit] % buckets).astype(np.int32), key[hit], doc[hit], pos[hit], bits[hit])))])

    return run


def _cut_task(names: list[str], text_col: str):
    def run(docs: pa.Table, marks: pa.Table) -> pa.Table:
        sizes = pc.fill_null(pc.binary_length(docs[text_col]), 0).to_numpy()
        offs = np.cumsum(np.r_[0, sizes], dtype=np.int64)
        key, doc, pos, bits = unpack(marks["blob"].to_pylist(), "i4", "i8", "i4", "u8")
        start = np.zeros(offs[-1], bool)
        if len(key) and docs.num_rows:
            row, p, entry = _find(integers(docs["_sd_key"]), integers(docs["_sd_id"]), key, doc, pos)
            at = offs[row] + p - SIDE
            for c in range(SIDE + 1):
                start[at[(bits[entry] >> np.uint64(c)) & np.uint64(1) == 1] + c] = True
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        some = docs.select(names)
        return pa.concat_tables([cut(some.slice(i, j - i), start[offs[i]:offs[j]], kind) for i, j in _runs(offs)])

    def cut(docs: pa.Table, start: np.ndarray, kind: pa.DataType) -> pa.Table:
        buf, offs = text_bytes(docs[text_col])
        seen = np.cumsum(start, dtype=np.int32)  # a text is below 2^31 bytes
        gone = seen > 0
        gone[WIDTH:] = seen[WIDTH:] > seen[:-WIDTH]
        spans, kept = [], []
        for a, b in zip(offs[:-1], offs[1:], strict=True):
            part = gone[a:b]
            if part.any():
                edge = np.flatnonzero(np.diff(np.r_[False, part, False]))
                spans.append([{"start": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2], strict=True)])
                kept.append(buf[a:b][~part].tobytes())
            else:
                spans.append([])
                kept.append(buf[a:b].tobytes())
        rest = [k.decode("utf-8", "ignore") for k in kept]
        columns = [docs[c].combine_chunks() if docs[c].num_chunks != 1 else docs[c].chunk(0) for c in names]
        return pa.Table.from_arrays([*columns, pa.array(kept, pa.binary()), pa.array(spans, kind), pa.array(rest, pa.string())],
                                    names=[*names, "_sd_kept", "_sd_spans", "_sd_text"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs, `_sd_kept` (bytes left), `_sd_spans` (array of removed byte ranges, maximal and in order) and
    `_sd_text` (what is left as text; bytes of characters that a cut went through are left out)."""
    n = width(docs.sparkSession)
    m = 2 * n  # buckets of documents; evens out how they hash to partitions
    names = docs.columns
    text, key = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    keyed = docs.withColumns({"_sd_id": key.cast("long"), "_sd_key": F.pmod(F.xxhash64(key, text), F.lit(2**31 - 1))})
    texts = keyed.withColumn("_sd_bucket", (F.col("_sd_key") % m).cast("int"))
    found = keyed.select("_sd_key", "_sd_id", text.alias("_sd_text")).mapInArrow(_anchor_task(n), _BLOBS)
    shared = found.groupBy("bucket").applyInArrow(_shared_task(m), _BLOBS)
    wins = texts.groupBy("_sd_bucket").cogroup(shared.groupBy("bucket")).applyInArrow(_window_task(n, text_col), _BLOBS)
    marks = wins.groupBy("bucket").applyInArrow(_merge_task(m), _BLOBS)
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([*docs.schema.fields, T.StructField("_sd_kept", T.BinaryType()), T.StructField("_sd_spans", span), T.StructField("_sd_text", T.StringType())])
    return texts.groupBy("_sd_bucket").cogroup(marks.groupBy("bucket")).applyInArrow(_cut_task(names, text_col), schema)
