"""How the word use of one source differs from another's, priced on shared segment trees.

Term counts per (language, source) are gathered once. The kept terms of a
language are dealt into blocks by hash; in a block every source has a segment
tree over the block's terms. Nodes are hash-consed level by level: a leaf is a
count, an inner node the pair of its children's numbers, so equal count subtrees
of any sources are one node. Two trees are walked together from the root down,
level by level: each different pair of nodes of two sources is expanded once,
with the number of places where it stands, and ends in pairs of counts that are
priced once. Sums over blocks are left to Spark.

Prices are exact integers: with p = 1 + floor(SCALE * (count + 2) / (N + 2 V)),
N the total of the counts and V the kept terms of the language, two shares p and
q are floor((p - q)^2 / (p + q)) apart. N + 2 V may reach 2.8e14.

Defined cases: null text, language and source read as empty; rows are documents,
also repeated ones; a language without kept terms has distance 0 between its
sources; no rows give no rows; extra columns are not looked at.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duskline.session import settled

SCALE = 1_000_000_000
#: Documents of a language in which a term must stand.
LEAST = 10
#: Counts (sources x terms) of one block.
CELLS = 1 << 19
#: Pairs of sources walked together.
PAIRS = 256
#: Different terms that a task counts before it passes them on.
HELD = 300_000
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
_OUT = "lang string, source string, part string, item string, value long"


def terms(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and characters beyond ASCII; only A-Z is lower-cased."""
    return (text or "").encode().translate(_FOLD).split()


def _counted(batches):
    n, docs, held = defaultdict(Counter), defaultdict(Counter), 0

    def out():
        for (lang, source), c in n.items():
            d = docs[lang, source]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array([source] * len(c), pa.string()), pa.array(list(c), pa.binary()).cast(pa.string()),
                                              pa.array(list(c.values()), pa.int64()), pa.array([d[t] for t in c], pa.int64())], names=["lang", "source", "term", "n", "docs"])

    for b in batches:
        for lang, source, text in zip(b["lang"].to_pylist(), b["source"].to_pylist(), b["text"].to_pylist(), strict=True):
            found, key = Counter(terms(text)), (lang, source)
            held -= len(n[key])
            n[key].update(found)
            held += len(n[key])
            docs[key].update(found.keys())
        if held > HELD:
            yield from out()
            n, docs, held = defaultdict(Counter), defaultdict(Counter), 0
    yield from out()


def shares(counts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (counts + 2) / size) without overflow: SCALE is taken in two factors."""
    part, rest = np.divmod((counts + 2) * 31_250, size)
    return 1 + part * 32_000 + rest * 32_000 // size


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


class Trees:
    """Segment trees of several count vectors; equal subtrees are one node."""

    def __init__(self, counts: np.ndarray):
        """counts: one row per source, one column per term."""
        high = max(0, int(counts.shape[1] - 1).bit_length())
        wide = np.full((counts.shape[0], 1 << high), -1, np.int64)
        wide[:, :counts.shape[1]] = counts
        #: Count of each leaf; -1 where there is no term.
        self.leaves, at = np.unique(wide, return_inverse=True)
        at = at.reshape(wide.shape)
        #: Children of the nodes of each level, from the leaves up.
        self.children: list[tuple[np.ndarray, np.ndarray]] = []
        room = len(self.leaves)
        while at.shape[1] > 1:
            nodes, up = np.unique(at[:, ::2] * room + at[:, 1::2], return_inverse=True)
            self.children.append((nodes // room, nodes % room))
            at, room = up.reshape(at.shape[0], -1), len(nodes)
        self.roots = at[:, 0]

    def meet(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For the pairs of sources (a[i], b[i]): i, both counts, and at how many terms they meet; each pair of counts once for an i."""
        which, x, y, times = np.arange(len(a)), self.roots[a], self.roots[b], np.ones(len(a), np.int64)
        for left, right in reversed(self.children):
            which, times = np.r_[which, which], np.r_[times, times]
            x, y = np.r_[left[x], right[x]], np.r_[left[y], right[y]]
            room_x, room_y = int(x.max()) + 1, int(y.max()) + 1
            keys, at = np.unique((which * room_x + x) * room_y + y, return_inverse=True)
            times = np.bincount(at, times, len(keys)).astype(np.int64)
            which, x, y = keys // (room_x * room_y), keys // room_y % room_x, keys % room_y
        real = self.leaves[x] >= 0
        return which[real], self.leaves[x[real]], self.leaves[y[real]], times[real]


def _priced(top: int):
    def run(key, counts: pa.Table, groups: pa.Table) -> pa.Table:
        lang = key[0].as_py()
        sources = groups["source"].to_pylist()
        size = np.asarray(groups["size"].combine_chunks()).astype(np.int64)
        whole = int(groups["whole"][0].as_py()) if len(sources) else 1
        place = {s: i for i, s in enumerate(sources)}
        names = sorted(set(counts["term"].to_pylist()))
        column = {t: i for i, t in enumerate(names)}
        n = np.zeros((len(sources), len(names)), np.int64)
        s, t = ([at[v] for v in counts[c].to_pylist()] for at, c in ((place, "source"), (column, "term")))
        n[s, t] = np.asarray(counts["n"].combine_chunks())
        out: list[tuple] = []
        if names:
            q = shares(n.sum(axis=0), np.int64(whole))
            for i, source in enumerate(sources):
                p = shares(n[i], size[i])
                value = apart(p, q)
                some = np.flatnonzero((n[i] > 0) & (p > q))
                out += [(source, "term", names[k], int(value[k])) for k in some[np.lexsort((some, -value[some]))][:top]]
            trees = Trees(n)
        first, second = np.triu_indices(len(sources), 1)
        for lo in range(0, len(first), PAIRS):
            a, b = first[lo:lo + PAIRS], second[lo:lo + PAIRS]
            total = np.zeros(len(a), np.int64)
            if names:
                which, x, y, times = trees.meet(a, b)
                np.add.at(total, which, times * apart(shares(x, size[a[which]]), shares(y, size[b[which]])))
            for i, j, v in zip(a, b, total.tolist(), strict=True):
                out += [(sources[i], "pair", sources[j], v), (sources[j], "pair", sources[i], v)]
        columns = [list(c) for c in zip(*out, strict=True)] or [[], [], [], []]
        return pa.table([pa.array([lang] * len(out), pa.string()), *[pa.array(c, pa.string()) for c in columns[:3]], pa.array(columns[3], pa.int64())],
                        names=["lang", "source", "part", "item", "value"])

    return run


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST, top: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank: distance to every other source of the language (part pair), and the `top`
    terms that a source uses more than its language does (part term)."""
    read = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    parts = read.mapInArrow(_counted, "lang string, source string, term string, n long, docs long").repartition("lang", "term")
    each = parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    over = Window.partitionBy("lang", "term")
    each = each.withColumns({"all": F.sum("docs").over(over), "least": F.min("source").over(over)}).where(F.col("all") >= least)
    kept = settled(each.select("lang", "source", "term", "n", (F.col("source") == F.col("least")).cast("long").alias("one")))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("total"), F.sum("one").alias("v"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = read.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs.withColumnRenamed("total", "whole"), "lang", "left")
    v = F.coalesce("v", F.lit(0))
    groups = settled(groups.select("lang", "source", "v", (F.coalesce("total", F.lit(0)) + 2 * v).alias("size"), (F.coalesce("whole", F.lit(0)) + 2 * v).alias("whole")))
    widest = groups.groupBy("lang").agg((F.count("*") * F.max("v")).alias("cells")).agg(F.max("cells")).first()[0]
    blocks = 1 + int(widest or 0) // CELLS
    dealt = kept.select("lang", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int").alias("block"), "source", "term", "n")
    there = groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    priced = dealt.groupBy("lang", "block").cogroup(there.groupBy("lang", "block")).applyInArrow(_priced(top), _OUT)
    summed = priced.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return summed.withColumn("rank", F.row_number().over(order)).where((F.col("part") == "pair") | (F.col("rank") <= top))
