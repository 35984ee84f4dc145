from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from duskline.llm import conversation_repair as M


def exhaustive(rows):
    """Least (cost, audit) over all edits with at most two insertions at a place. rows: (initial, fault)."""
    best = (10**9, "")

    def go(i, made, cost, audit, run):
        nonlocal best
        if cost > best[0] or not re.fullmatch("(s?(ua)*u?)?", made):
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", made):
            best = min(best, (cost, audit))
        if run < 2:
            for x in "ua":
                go(i, made + x, cost + 3, audit + "I", run + 1)
        if i < len(rows):
            initial, fault = rows[i]
            go(i + 1, made, cost + 4, audit + "D", 0)
            if fault not in (1, 2):
                more = 3 * (fault == 3)
                if initial != "?":
                    go(i + 1, made + initial, cost + more, audit + "K", 0)
                for x in "ua":
                    go(i + 1, made + x, cost + 3 + more, audit + "R", 0)

    go(0, "", 0, "", 0)
    return best


def codes(rows):
    return bytes(4 * "sua?".index(i) + f for i, f in rows)


def by_prefixes(rows):
    """Least (cost, audit) row by row over the states, as a second way for long conversations."""
    after = {0: {0: (0, "")}, 1: {}, 2: {}, 3: {}}
    best = {0: (0, "")}

    def filled(best):
        out = {}
        for s, (c, a) in best.items():
            for k in range(3):
                out[s] = min(out.get(s, (10**9, "")), (c + 3 * k, a + "I" * k))
                s = {0: 2, 1: 2, 2: 3, 3: 2}[s]
        return out

    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    for initial, fault in rows:
        new = {}
        for s, (c, a) in filled(best).items():
            found = [(s, c + 4, "D")]
            if fault not in (1, 2):
                more = 3 * (fault == 3)
                found += [(step[s, x], c + more + (0 if e == "K" else 3), e) for x, e in ((initial, "K"), ("u", "R"), ("a", "R")) if (s, x) in step]
            for to, cost, e in found:
                new[to] = min(new.get(to, (10**9, "")), (cost, a + e))
        best = new
    return min(v for s, v in filled(best).items() if s in (0, 3)) if after else None


def test_all_short_conversations():
    rnd = random.Random(1)
    cases = [[(i, f)] for i in "sua?" for f in range(4)] + [[(rnd.choice("sua?"), rnd.choice([0, 0, 0, 1, 2, 3])) for _ in range(rnd.randint(0, 4))] for _ in range(250)]
    for rows in cases:
        cost, audit = M.repair(codes(rows))
        assert (cost, audit.decode()) == exhaustive(rows), rows


@pytest.mark.parametrize("weights", ["sua?", "uuua", "aaas", "ssu?", "uuuu"])
def test_long_conversations(weights):
    rnd = random.Random(weights)
    for n in (30, 300, 2000):
        rows = [(rnd.choice(weights), rnd.choice([0, 0, 0, 1, 2, 3])) for _ in range(n)]
        cost, audit = M.repair(codes(rows))
        assert (cost, audit.decode()) == by_prefixes(rows)


def test_work_is_linear_in_the_rows():
    import time

    took = []
    for n in (20_000, 80_000):
        rnd = random.Random(5)
        c = codes([(rnd.choice("uuas?"), rnd.choice([0, 0, 3, 1])) for _ in range(n)])
        start = time.perf_counter()
        M.repair(c)
        took.append(time.perf_counter() - start)
    assert took[1] < 12 * took[0] + 1


def plain(rows):
    """The whole query for (conv_id, turn, role, text) rows."""
    out = {}
    for conv in {r[0] for r in rows}:
        kept = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            role, text = (" " if x is None else x for x in (role, text))
            h = zlib.crc32(":".join(" " if x is None else str(x) for x in (c, turn)).encode()) % 20
            text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
            kept += [(turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, marks = set(), []
        for _, role, text in kept:
            body = text.strip(" \t\n\x0b\x0c\r")
            fault = 1 if not body else 2 if (role, text) in seen else 3 if body[-1] not in ".!?" else 0
            seen.add((role, text))
            marks.append((role[:1] if role[:1] in ("s", "u", "a") else "?", fault))
        cost, audit = by_prefixes(marks)
        made, at, state = [], iter(kept), 0
        for e in audit:
            if e == "I":
                state = {0: 2, 1: 2, 2: 3, 3: 2}[state]
                made.append("user:" if state == 2 else "assistant:")
                continue
            _, role, text = next(at)
            if e == "K":
                state = {"s": 1, "u": 2, "a": 3}[role[0]]
                made.append(f"{role}:{text}")
            elif e == "R":
                state = {0: 2, 1: 2, 2: 3, 3: 2}[state]
                made.append(f"{'user' if state == 2 else 'assistant'}:{text}")
        turns = [r[0] for r in kept if r[0] is not None]
        pairs = [a[0] + b[0] for a, b in zip(marks, marks[1:], strict=False)]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[sum(f == k for _, f in marks) for k in (1, 2, 3)],
                     sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest())
    return out


def test_rows_of_all_kinds(docs_of):
    rnd = random.Random(9)
    texts = ["Yes.", "no", " \n", "", None, "What? ", "é!", "Yes.", "long " * 50 + "\r\n"]
    rows = [(rnd.choice([1, 2, 3, None, 40]), rnd.choice([None, 0, 1, 2, 5, 9, 9]), rnd.choice(["user", "assistant", "system", None, "", "tool", "usher"]), rnd.choice(texts)) for _ in range(120)]
    rows += [(100 + i, t, rnd.choice(["user", "assistant"]), rnd.choice(texts)) for i in range(60) for t in range(rnd.randint(1, 7))]
    table = docs_of(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS code", "'x' AS head", "2 AS copy").repartition(5)
    got = {r["conv_id"]: tuple(r)[1:] for r in M.repaired(M.damaged(table), table).collect()}
    assert got == plain(rows)


def test_no_rows_and_nothing_left(docs_of):
    schema = "conv_id long, turn long, role string, text string"
    empty = docs_of([], schema)
    assert M.repaired(M.damaged(empty), empty).count() == 0
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    table = docs_of([(gone, 0, "user", "Hi.")], schema)
    assert [tuple(r) for r in M.repaired(M.damaged(table), table).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
