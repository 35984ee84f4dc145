"""Byte-level BPE encoding and decoding by recursive SQL inside each partition.

A task cuts its texts by the tokenizer's pattern and gathers the different
pieces. DuckDB, embedded in the task, encodes them all at once: a recursive
query starts from one row per byte, (piece, position, token); every round joins
neighbouring rows with the merge table, finds each piece's lowest rank (leftmost
on ties), contracts that pair, and renumbers; a piece leaves when no pair of it
merges. The merge table holds every split of every token into two tokens.
Decoding joins token-position rows with the vocabulary and aggregates the bytes
in order of position.

Pieces already encoded by the same worker are kept in a table of bounded size.
There is no shuffle: texts are read once and leave as ids. The rank file is a
parameter and is read by name inside each worker (it must be there on all
executors, as an installed package is).

Defined cases: a null or empty text has no ids and decodes to no bytes; equal
rows get equal results; other columns are passed through.
"""

from __future__ import annotations

import base64
from functools import cache

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from duskline.llm.common import Remembered

#: Bytes of text whose pieces are encoded together, and pieces remembered by a worker.
BLOCK = 2 << 20
REMEMBERED = 300_000
#: Pieces encoded by one recursive query.
AT_ONCE = 10_000
#: Tokens decoded at a time.
DECODED = 200_000
#: Positions of one piece in a key of the recursion; pieces over four times as long go by rounds.
_ROOM = 16
#: Above any token id; two ids make one join key.
_WIDE = 1 << 24

_ENCODE = """
WITH RECURSIVE
rows(k, tok, round) AS (
    SELECT k, tok, 0 FROM start
    UNION ALL
    (WITH pairs AS (SELECT k, merged FROM (SELECT k, tok, lead(k) OVER (ORDER BY k) AS nk, lead(tok) OVER (ORDER BY k) AS nt FROM rows)
                    JOIN merges ON pair = tok * {wide} + nt WHERE nk = k + 1 AND nk // {room} = k // {room}),
    best AS (SELECT k // {room} AS piece, min(merged * {room} + k % {room}) AS code FROM pairs GROUP BY piece)
    SELECT CASE WHEN r.k % {room} > code % {room} THEN r.k - 1 ELSE r.k END,
           CASE WHEN r.k % {room} = code % {room} THEN code // {room} ELSE r.tok END, r.round + 1
    FROM rows r JOIN best ON best.piece = r.k // {room}
    WHERE r.k % {room} <> code % {room} + 1)
)
SELECT k // {room} AS piece, k % {room} AS pos, tok
FROM rows JOIN (SELECT k // {room} AS done, max(round) AS last FROM rows GROUP BY done) ON done = k // {room} AND round = last
ORDER BY k
"""
#: For long pieces: every place of the lowest rank is contracted in one round, from
#: the left where places overlap. That is what one pair after another comes to,
#: as a pair with the new token always ranks higher. Only the last round is kept.
_ENCODE_LONG = """
WITH RECURSIVE
rows(piece, pos, tok, round) USING KEY (piece, pos) AS (
    SELECT piece, pos, tok, 0 FROM long_start
    UNION
    (WITH near AS (SELECT *, lead(tok) OVER (PARTITION BY piece ORDER BY pos) AS nt FROM rows),
    low AS (SELECT near.*, merged, min(merged) OVER (PARTITION BY piece) AS least FROM near LEFT JOIN merges ON pair = tok * {wide} + nt),
    hit AS (SELECT *, coalesce(merged = least, false) AS h FROM low WHERE least IS NOT NULL),
    run AS (SELECT *, pos - sum(h::INT) OVER (PARTITION BY piece ORDER BY pos ROWS UNBOUNDED PRECEDING) AS island FROM hit),
    pick AS (SELECT *, h AND row_number() OVER (PARTITION BY piece, island, h ORDER BY pos) % 2 = 1 AS c FROM run),
    moved AS (SELECT *, lag(c) OVER w AS gone, coalesce(sum(c::INT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift
              FROM pick WINDOW w AS (PARTITION BY piece ORDER BY pos))
    SELECT piece, CAST(pos - shift AS BIGINT), CASE WHEN c THEN least ELSE tok END, round + 1 FROM moved WHERE gone IS NOT TRUE)
)
SELECT piece, pos, tok
FROM rows JOIN (SELECT piece AS done, max(round) AS last FROM rows GROUP BY done) ON done = piece AND round = last
ORDER BY piece, pos
"""
_DECODE = """
SELECT doc, list(v.bytes ORDER BY pos) AS parts FROM toks JOIN vocab v USING (tok) GROUP BY doc ORDER BY doc
"""


@cache
def _database(ranks_path: str):
    """(connection with the merge and vocabulary tables, id of each single byte)."""
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    rows = [(ranks[t[:i]] * _WIDE + ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    con = duckdb.connect(config={"threads": "1", "memory_limit": "250MB", "preserve_insertion_order": "false"})
    merges = pa.table({n: pa.array([r[i] for r in rows], pa.int64()) for i, n in enumerate(("pair", "merged"))})
    vocab = pa.table({"tok": pa.array(list(ranks.values()), pa.int64()), "bytes": pa.array(list(ranks), pa.binary())})
    for name, t in (("merges", merges), ("vocab", vocab)):
        con.register("loaded", t)
        con.execute(f"CREATE TABLE {name} AS SELECT * FROM loaded")
        con.unregister("loaded")
    return con, np.array([ranks[bytes([b])] for b in range(256)], np.int64)


def encode_pieces(pieces: list[bytes], ranks_path: str) -> list[np.ndarray]:
    """Token ids of each piece, by the recursive query."""
    con, single = _database(ranks_path)
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(pieces)
    sizes = np.array([len(p) for p in pieces], np.int64)
    low = 0
    for room in (_ROOM, 4 * _ROOM, 0):
        some = np.flatnonzero((sizes > low) & ((sizes <= room) | (room == 0)))
        low = room
        if not len(some):
            continue
        n = sizes[some]
        buf = np.frombuffer(b"".join(pieces[i] for i in some), np.uint8)
        pos, piece = np.arange(len(buf)) - np.repeat(np.cumsum(n) - n, n), np.repeat(np.arange(len(some)), n)
        name, cols, sql = ("start", {"k": piece * room + pos}, _ENCODE) if room else ("long_start", {"piece": piece, "pos": pos}, _ENCODE_LONG)
        con.register(name, pa.table(cols | {"tok": single[buf]}))
        got = con.sql(sql.format(room=room, wide=_WIDE)).to_arrow_table()
        con.unregister(name)
        piece, tok = got["piece"].to_numpy(), got["tok"].to_numpy().astype(np.uint32)
        cuts = np.searchsorted(piece, np.arange(len(some) + 1))
        for i, x, y in zip(some.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            out[i] = tok[x:y]
    return out


def decode_ids(flat: np.ndarray, offs: np.ndarray, ranks_path: str) -> list[bytes]:
    """Bytes of each id list flat[offs[i]:offs[i + 1]]: rows (list, position, token) joined with the vocabulary, aggregated in order."""
    con, _ = _database(ranks_path)
    n, low = np.diff(offs), offs[0]
    out = [b""] * len(n)
    if n.sum():
        con.register("toks", pa.table({"doc": np.repeat(np.arange(len(n)), n), "pos": np.arange(n.sum()) - np.repeat(offs[:-1] - low, n), "tok": flat[low:offs[-1]]}))
        got = con.sql(_DECODE).to_arrow_table().combine_chunks()
        con.unregister("toks")
        parts = got["parts"].combine_chunks() if got["parts"].num_chunks != 1 else got["parts"].chunk(0)
        cuts, values = np.asarray(parts.offsets), parts.values
        ends, data = np.frombuffer(values.buffers()[1], np.int32)[values.offset:values.offset + len(values) + 1], values.buffers()[2]
        raw = memoryview(data) if data is not None else b""
        for d, x, y in zip(got["doc"].to_pylist(), ends[cuts[:-1]].tolist(), ends[cuts[1:]].tolist(), strict=True):
            out[d] = bytes(raw[x:y])
    return out


_MEMORY: dict[str, Remembered] = {}


def encode_flat(texts: list[str | None], pattern: str, ranks_path: str) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all texts, and len + 1 offsets."""
    cut = regex.compile(pattern).findall
    known = _MEMORY.get(ranks_path)
    if known is None or len(known) > REMEMBERED:
        known = _MEMORY[ranks_path] = Remembered()
    lines, offs = known.lines([cut(t) if t else [] for t in texts])
    if known.fresh:
        found = []
        for at in range(0, len(known.fresh), AT_ONCE):
            found += encode_pieces([p.encode() for p in known.fresh[at:at + AT_ONCE]], ranks_path)
        known.fill([len(x) for x in found], np.concatenate(found))
    return known.ids(lines, offs)


def encode_texts(texts: list[str | None], pattern: str, ranks_path: str) -> list[np.ndarray]:
    """Token ids of each text."""
    flat, offs = encode_flat(texts, pattern, ranks_path)
    return np.split(flat, offs[1:-1])


def _blocks(batches, text_col: str):
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b[text_col].nbytes
        if size >= BLOCK:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _encoding(text_col: str, pattern: str, ranks_path: str, back: bool):
    def run(batches):
        for t in _blocks(batches, text_col):
            flat, offs = encode_flat(t[text_col].to_pylist(), pattern, ranks_path)
            column = pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(flat.astype(np.int32), pa.int32()))
            t = t.append_column("_bp_ids", column)
            if back:
                t, done, i = t.drop_columns([text_col]), [], 0
                while i < len(offs) - 1:  # about DECODED tokens at a time
                    j = max(i + 1, int(np.searchsorted(offs, offs[i] + DECODED, side="right")) - 1)
                    done += decode_ids(flat, offs[i:j + 1], ranks_path)
                    i = j
                t = t.append_column("_bp_bytes", pa.array(done, pa.binary()))
            yield from t.to_batches()
            pa.default_memory_pool().release_unused()

    return run


def _decoding(ids_col: str, ranks_path: str):
    def run(batches):
        for b in batches:
            ids = pc.fill_null(b[ids_col], pa.scalar([], b[ids_col].type))
            done = decode_ids(np.asarray(ids.values), np.asarray(ids.offsets).astype(np.int64), ranks_path)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(done, pa.binary())], names=[*b.schema.names, "_bp_bytes"])

    return run


def encode(docs: DataFrame, pattern: str, ranks_path: str, text_col: str = "text") -> DataFrame:
    """All columns of docs and `_bp_ids` (array<int>)."""
    schema = T.StructType([*docs.schema.fields, T.StructField("_bp_ids", T.ArrayType(T.IntegerType(), True))])
    return docs.mapInArrow(_encoding(text_col, pattern, ranks_path, False), schema)


def round_trip(docs: DataFrame, pattern: str, ranks_path: str, text_col: str = "text") -> DataFrame:
    """Columns of docs but the text, `_bp_ids` and `_bp_bytes`, which is decoded from the ids, in one pass of one worker."""
    kept = [f for f in docs.schema.fields if f.name != text_col]
    schema = T.StructType([*kept, T.StructField("_bp_ids", T.ArrayType(T.IntegerType(), True)), T.StructField("_bp_bytes", T.BinaryType())])
    return docs.mapInArrow(_encoding(text_col, pattern, ranks_path, True), schema)


def decode(docs: DataFrame, ranks_path: str, ids_col: str = "_bp_ids") -> DataFrame:
    """All columns of docs and `_bp_bytes`, the decoded bytes."""
    return docs.mapInArrow(_decoding(ids_col, ranks_path), T.StructType([*docs.schema.fields, T.StructField("_bp_bytes", T.BinaryType())]))
