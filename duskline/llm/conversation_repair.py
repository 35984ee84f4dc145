"""Cheapest repair of conversations to alternating turns, by depth-first branch and bound.

A repaired conversation is empty, or an optional system turn and then one or
more user and assistant turns in alternation. Rows are kept (free), given the
role user or assistant (REROLE), deleted (DELETE; the only choice for blank and
duplicate rows), and empty turns are inserted (INSERT); a truncated row that
stays costs TRUNCATED. Of all repairs with the least cost the one with the least
audit (the edits' initials, by ASCII) is taken.

The search goes through (row, state) nodes on an explicit stack, edits in the
order of their initials, so complete repairs come in the order of their audits.
Suffix bounds give for every row and state what the rest costs at least if it
may end anywhere; the incumbent (cost, audit) starts as the repair along those
bounds with its end mended by insertions. A prefix is dropped if cost and bound
cannot beat the incumbent, or if the node's dominance table holds a prefix that
came earlier and cost no more. The search ends with an empty stack, that is,
proved. Bounds and incumbent differ by two insertions at most, so no node is
entered more than a few times: work is linear in the rows.

Faults, order and digests are Spark's work: rows are read in order of turn as a
stream, a task holds one byte per row of one conversation, and texts are hashed
in a second stream that meets the audit first. An audit and a digest are one
value over all rows of a conversation, so these streams are not split further.

Defined cases: null role and text read as one space, a null turn comes first; a
null conv_id is a conversation of its own; rows of one turn go by role and text;
roles whose initial is not s, u or a cannot be kept; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duskline.session import settled

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Characters that are no text.
BLANKS = " \t\n\x0b\x0c\r"
FAULTS = ("", "blank", "duplicate", "truncated")
#: States: nothing yet, after system, after user, after assistant; the initial read next leads on.
_NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: State after an inserted turn.
_AFTER = (2, 2, 3, 2)
_ENDS = (0, 3)
_NEIGHBOURS = {b"su", b"ua", b"au"}
_FAR = 1 << 60


def _choices(initial: str, fault: int) -> list[list[tuple[int, int, int]]]:
    """(edit, cost, next state) of a row for each state, in the order of the edits' initials."""
    out = []
    for state in range(4):
        found = [(ord("D"), DELETE, state)]
        if fault not in (1, 2):
            more = TRUNCATED if fault == 3 else 0
            if (state, initial) in _NEXT:
                found.append((ord("K"), more, _NEXT[state, initial]))
            found.append((ord("R"), REROLE + more, _AFTER[state]))
        out.append(found)
    return out


_TABLE = [_choices(i, f) for i in "sua?" for f in range(4)]


def suffix_bounds(codes: bytes) -> list[tuple[int, int, int, int]]:
    """Least cost of the rows from each row on, by state, if the end may be any state."""
    rest = (0, 0, 0, 0)
    out = [rest]
    for code in reversed(codes):
        plain = [min(cost + rest[to] for _, cost, to in options) for options in _TABLE[code]]
        rest = tuple(min(plain[s], INSERT + plain[_AFTER[s]], 2 * INSERT + plain[_AFTER[_AFTER[s]]]) for s in range(4))
        out.append(rest)
    return out[::-1]


def _first_repair(codes: bytes, bounds) -> tuple[int, bytes]:
    """A repair along the bounds; insertions mend its end."""
    state, cost, audit = 0, 0, bytearray()
    for i, code in enumerate(codes):
        while True:
            edit, more, to = min(_TABLE[code][state], key=lambda e: e[1] + bounds[i + 1][e[2]])
            if more + bounds[i + 1][to] <= bounds[i][state]:
                break
            audit.append(ord("I"))
            cost, state = cost + INSERT, _AFTER[state]
        audit.append(edit)
        cost, state = cost + more, to
    while state not in _ENDS:
        audit.append(ord("I"))
        cost, state = cost + INSERT, _AFTER[state]
    return cost, bytes(audit)


def repair(codes: bytes) -> tuple[int, bytes]:
    """Least cost and least audit. codes: 4 * initial (s, u, a, other) + fault for each row in order."""
    bounds, n = suffix_bounds(codes), len(codes)
    best, audit = _first_repair(codes, bounds)
    reached = np.full((n + 1) * 4, _FAR, np.int64) if n > 1000 else [_FAR] * ((n + 1) * 4)
    path, in_order = bytearray(), False
    stack = [(0, 0, 0, 0, 0)]
    while stack:
        row, state, cost, depth, edit = stack.pop()
        if depth:
            del path[depth - 1:]
            path.append(edit)
        hope = cost + bounds[row][state]
        # Repairs found by the search come in the order of audits: a later one of the same cost is no better.
        if hope > best or (in_order and hope == best) or cost >= reached[4 * row + state]:
            continue
        reached[4 * row + state] = cost
        if row == n and state in _ENDS:
            if cost < best or bytes(path) <= audit:
                best, audit, in_order = cost, bytes(path), True
            continue
        after = [(row + 1, to, cost + more, depth + 1, e) for e, more, to in _TABLE[codes[row]][state]] if row < n else []
        after.append((row, _AFTER[state], cost + INSERT, depth + 1, ord("I")))
        stack += sorted(after, key=lambda c: -c[4])
    return best, audit


class Repaired:
    """Digest of the repaired rows, fed one row after another."""

    def __init__(self, audit: bytes):
        self.audit, self.at, self.state, self.started = audit, 0, 0, False
        self.digest = hashlib.sha256()

    def _line(self, role: str, text: str) -> None:
        self.digest.update(f"{chr(10) if self.started else ''}{role}:{text}".encode())
        self.started = True

    def _made(self, text: str) -> None:
        self.state = _AFTER[self.state]
        self._line("assistant" if self.state == 3 else "user", text)

    def _inserted(self) -> None:
        while self.audit[self.at:self.at + 1] == b"I":
            self.at += 1
            self._made("")

    def row(self, role: str, text: str) -> None:
        self._inserted()
        edit = self.audit[self.at:self.at + 1]
        self.at += 1
        if edit == b"K":
            self.state = _NEXT[self.state, role[0]]
            self._line(role, text)
        elif edit == b"R":
            self._made(text)

    def end(self) -> str:
        self._inserted()
        return self.digest.hexdigest()


_STATS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class _Conversation:
    def __init__(self, conv_id):
        self.conv_id, self.codes, self.turns, self.first, self.last = conv_id, bytearray(), 0, None, None

    def solved(self) -> tuple:
        codes = bytes(self.codes)
        a = np.frombuffer(codes, np.uint8)
        faults = np.bincount(a & 3, minlength=4)
        initials = b"sua?"
        pairs = np.bincount((a[:-1] >> 2) * 4 + (a[1:] >> 2), minlength=16)
        illegal = sum(int(pairs[4 * i + j]) for i in range(4) for j in range(4) if bytes([initials[i], initials[j]]) not in _NEIGHBOURS)
        cost, audit = repair(codes)
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return self.conv_id, gaps, *map(int, faults[1:]), illegal, cost, audit.decode()


def _solving(batches):
    """Rows in order of conversation and turn -> one row per conversation."""
    now, done, schema = None, [], None

    def out():
        columns = list(zip(*done, strict=True))
        kinds = [schema.field("conv_id").type, *[pa.int64()] * len(_STATS), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", *_STATS, "audit"])

    for b in batches:
        schema = b.schema
        for conv, turn, code in zip(b["conv_id"].to_pylist(), b["turn"].to_pylist(), b["code"].to_pylist(), strict=True):
            if now is None or conv != now.conv_id:
                if now is not None:
                    done.append(now.solved())
                now = _Conversation(conv)
            now.codes.append(code)
            if turn is not None and turn != now.last:
                now.first, now.last, now.turns = turn if now.first is None else now.first, turn, now.turns + 1
        if done:
            yield out()
            done.clear()
    if now is not None:
        done.append(now.solved())
        yield out()


def _hashing(batches):
    """Heads (an audit each) followed by their rows in order -> heads with digests."""
    head, work, done, schema = None, None, [], None

    def out():
        names = ["head", "digest"]
        return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], schema.field("head").type), pa.array([d[1] for d in done], pa.string())], names=names)

    for b in batches:
        schema = b.schema
        for h, role, text in zip(b["head"].to_pylist(), b["role"].to_pylist(), b["text"].to_pylist(), strict=True):
            if h is None:
                work.row(role, text)
                continue
            if head is not None:
                done.append((head, work.end()))
            head, work = h, Repaired(h["audit"].encode())
        if done:
            yield out()
            done.clear()
    if head is not None:
        done.append((head, work.end()))
        yield out()


def marked(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copy and code (4 * initial + fault) of every row. rows: those columns without the code."""
    stripped = F.rtrim("text", F.lit(BLANKS))
    ends = F.substring(stripped, F.length(stripped), F.lit(1))
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.asc_nulls_first("turn"), "copy")) > 1
    fault = F.when(stripped == "", 1).when(F.col("seen"), 2).when(~ends.isin(".", "!", "?"), 3).otherwise(0)
    first = F.substring("role", 1, 1)
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    return rows.withColumn("seen", seen).select("conv_id", "turn", "role", "text", "copy", (4 * initial + fault).alias("code"))


def repaired(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per conv_id of `conversations`: faults, illegal neighbours, cost, audit and repaired_sha256 of its rows.

    rows: conv_id, turn, role, text, copy, without null role or text; rows of one
    turn go by role, text and copy.
    """
    coded = settled(marked(rows))
    order = [F.asc_nulls_first("turn"), "role", "text", "copy"]
    lines = coded.repartition("conv_id").sortWithinPartitions("conv_id", *order).select("conv_id", "turn", "code")
    conv = T.StructField("conv_id", rows.schema["conv_id"].dataType)
    facts = T.StructType([conv, *[T.StructField(n, T.LongType()) for n in _STATS], T.StructField("audit", T.StringType())])
    found = lines.mapInArrow(_solving, facts).withColumnRenamed("conv_id", "other")
    ids = conversations.select("conv_id").distinct()
    heads = ids.join(found, F.col("conv_id").eqNullSafe(F.col("other")), "left").na.fill(0, list(_STATS)).na.fill("", ["audit"])
    heads = heads.select("conv_id", F.struct(*[F.col(n) for n in facts.names]).alias("head"))
    stream = heads.unionByName(coded.select("conv_id", "turn", "role", "text", "copy"), allowMissingColumns=True)
    stream = stream.repartition("conv_id").sortWithinPartitions("conv_id", F.isnull("head"), *order).select("head", "role", "text")
    hashed = stream.mapInArrow(_hashing, T.StructType([T.StructField("head", facts), T.StructField("digest", T.StringType())]))
    return hashed.select("head.*", F.col("digest").alias("repaired_sha256"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows of conversations with planted faults, by the CRC-32 of conv_id:turn modulo 20, for `repaired`."""
    key = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c != ":" else F.lit(c) for c in ("conv_id", ":", "turn")])
    rows = conversations.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")], (F.crc32(key.cast("binary")) % 20).alias("k"))
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.sequence(F.lit(0), F.when(F.col("k") == 3, 1).otherwise(0)))
    return rows.where("k <> 0").select("conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy"))
