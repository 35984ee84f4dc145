"""Near-duplicate documents by SimHash, Golay keys and the exact Jaccard similarity of word shingles.

Documents are sets of SHINGLE-word shingles (64-bit hashes). Two sets link if
their Jaccard similarity is at least LIKE = 4 / 5; groups are the components of
the links. Every candidate pair is verified on the whole sets, so no pair below
the threshold links.

Equal sets are folded first, so copies never make pairs. Candidates come first
from `simhash_golay`: majority fingerprints of the shingles, joined by their Golay
keys, at most three bits apart. Of each fingerprint all sets meet the smallest, and
the smallest ones of linked fingerprints meet.

Three bits are far from all pairs at 0.8, which differ in some ten bits of 64, and no
bound on the bits is certain. So what is still in different groups is completed:
such candidates share a band, BANDS bands of ROWS min-hashes each. A pair at 0.8
shares none with probability (1 - 0.8 ** 5) ** 32 = 3e-6, a closer pair with less.
Of each bucket (band and its value) every set is first compared with the smallest
one of another group only. Sets of buckets that still hold several groups are then joined exactly: shingles are
ordered by how many of these sets have them, rarest first; two sets that are alike share a
shingle of their first fifths, and the places of the first one bound what they can share. So do
parities: of each set BITS bits, every shingle turning one. What two sets have in common cancels out, so they differ
in at least as many shingles as bits. Pairs
within a group are not formed: of each such shingle, sets outside its largest
group meet the others. So pairs follow the rare shingles that different groups
share, not the size of a bucket, and what is formed of a crowd that shares many shingles
is nearly its links alone. No link is lost by that.

Defined cases: null and empty texts are equal and link to nothing else; fewer
than SHINGLE words make one shingle; a null id takes part but a group is named
by its smallest non-null id (null if it has none).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duskline.llm.common import dealt, mix64
from duskline.llm.graph import components
from duskline.llm.simhash_golay import links as near_prints
from duskline.llm.simhash_golay import majority
from duskline.session import release, settled, settled_scope

SHINGLE = 5
#: Least Jaccard similarity of a link, as numerator and denominator.
LIKE = (4, 5)
BANDS, ROWS = 32, 5
SEED = 42
#: Parity bits of a set.
BITS = 512
#: Shingles hashed at a time.
CHUNK = 2048
_RNG = np.random.default_rng(SEED)
_XOR = _RNG.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64)
_ODD = _RNG.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)
_MIX = _RNG.integers(0, 1 << 64, (BANDS, ROWS), np.uint64) | np.uint64(1)


def shingles(text: bytes) -> np.ndarray:
    """Different hashes of all shingles, ascending."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    k = min(SHINGLE, len(words))
    lows, highs = [0, *(ends[:len(words) - k] + 1).tolist()], ends[k - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(lows, highs, strict=True)], np.uint64))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """Key of each band; none for an empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), CHUNK):
        np.minimum(least, ((hashes[at:at + CHUNK] ^ _XOR) * _ODD).min(axis=1), out=least)
    return mix64(mix64(least.reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def parities(hashes: np.ndarray) -> np.ndarray:
    """Which of BITS bits an odd number of the shingles turn, as 64-bit words."""
    odd = np.bincount((hashes % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(flat.view(np.int64), pa.int64()))


def _marks(text_col: str):
    def run(batches):
        for b in batches:
            sets = [shingles((t or "").encode()) for t in b[text_col].to_pylist()]
            names = pa.array(np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64), pa.int64())
            prints = pa.array(np.array([majority(s) for s in sets], np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, names, pa.array(list(map(len, sets)), pa.int32()), prints, _lists([band_keys(s) for s in sets])],
                                             names=[*b.schema.names, "_sj_set", "_sj_n", "_sj_fp", "_sj_bands"])

    return run


def _whole(text_col: str):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["s"], _lists([shingles((t or "").encode()) for t in b[text_col].to_pylist()])], names=["s", "held"])

    return run


def _bits(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([b["s"], _lists([parities(np.array(h, np.int64).view(np.uint64)) for h in b["held"].to_numpy(zero_copy_only=False)])], names=["s", "bits"])


def _alike(both, n, m):
    """Jaccard similarity of LIKE or more, from the sizes of the intersection and the two sets."""
    return (LIKE[0] + LIKE[1]) * both >= LIKE[0] * (n + m)


def _sized(n, m):
    """Sets of these sizes can be alike."""
    return _alike(F.least(n, m), n, m)


def _few_apart(a, b, n, m):
    """Sets of these parities and sizes can be alike: alike sets have at most a LIKE-th part of n + m in one of them only."""
    words = [F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(BITS // 64)]
    return (LIKE[0] + LIKE[1]) * sum(words[1:], words[0]) <= (LIKE[1] - LIKE[0]) * (n + m)


def _golay_pairs(sets: DataFrame) -> DataFrame:
    """Pairs u < v of different sets (s, n, fp): all of a fingerprint with its smallest, and the smallest ones of linked fingerprints."""
    least = sets.groupBy("fp").agg(F.min(F.struct("s", "n")).alias("c"))
    same = sets.join(least, "fp").where(F.col("s") != F.col("c.s")).select(F.struct("s", "n").alias("a"), F.col("c").alias("b"))
    u, v = (least.select(F.col("fp").alias(end), F.col("c").alias(c)) for end, c in (("u", "a"), ("v", "b")))
    linked = near_prints(least.select(F.col("fp").alias("_sg_fp"))).join(u, "u").join(v, "v").select("a", "b")
    both = same.unionByName(linked).where(_sized(F.col("a.n"), F.col("b.n")))
    return both.select(F.least("a.s", "b.s").alias("u"), F.greatest("a.s", "b.s").alias("v")).distinct()


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (u, v) whose sets are alike."""
    a, b = sets.select(F.col("s").alias("u"), F.col("held").alias("x")), sets.select(F.col("s").alias("v"), F.col("held").alias("y"))
    met = dealt(pairs.select("u", "v")).join(b, "v").join(dealt(a), "u")
    return met.where(_alike(F.size(F.array_intersect("x", "y")), F.size("x"), F.size("y"))).select("u", "v")


def _prefixes(apart: DataFrame, sets: DataFrame) -> DataFrame:
    """(h, s, n, g, bits, left, earlier): shingles of each set's first fifth, rarest first, that another set of `apart` has too.

    left: how many of the set's shingles come from here on; earlier: those of its first fifth that came before; bits: its parities.

    apart: different sets s with their size n and group g.
    """
    whole = apart.select("s").join(sets, "s").select("s", "held")
    tokens = whole.select("s", F.explode("held").alias("h"))
    often = tokens.groupBy("h").agg(F.count("*").alias("times")).where("times > 1")
    shared = tokens.join(dealt(often), "h").groupBy("s").agg(F.array_sort(F.collect_list(F.struct("times", "h"))).alias("held"))
    own = F.col("n") - F.size("held")  # shingles that no other set has stand first
    length = F.floor(F.col("n") * (LIKE[1] - LIKE[0]) / LIKE[1]).cast("int") + 1
    first = shared.join(apart, "s").join(whole.mapInArrow(_bits, "s long, bits array<long>"), "s").withColumn("own", own)
    first = first.withColumn("held", F.transform(F.slice("held", F.lit(1), F.greatest(F.lit(0), length - F.col("own"))), lambda t: t["h"]))
    first = first.select("s", "n", "g", "bits", "own", "held", F.posexplode("held").alias("at", "h"))
    return first.select("h", "s", "n", "g", "bits", (F.col("n") - F.col("own") - F.col("at")).alias("left"), F.slice("held", F.lit(1), F.col("at")).alias("earlier"))


def _prefix_pairs(first: DataFrame) -> DataFrame:
    """Pairs (u, v) of different groups that share a prefix shingle and can be alike by places and parities, each at the first shingle it shares."""
    groups = first.groupBy("h", "g").agg(F.count("*").alias("size")).groupBy("h").agg(F.max_by("g", F.struct("size", "g")).alias("large"), F.count("*").alias("groups"))
    met = settled(first.join(dealt(groups.where("groups > 1").select("h", "large")), "h"))
    a, b = met.where("g <> large").alias("a"), met.alias("b")
    once = (F.col("b.g") == F.col("b.large")) | (F.col("a.s") < F.col("b.s"))
    room = _alike(F.least("a.left", "b.left"), F.col("a.n"), F.col("b.n"))
    few = _few_apart(F.col("a.bits"), F.col("b.bits"), F.col("a.n"), F.col("b.n"))
    new = ~F.arrays_overlap("a.earlier", "b.earlier")
    pairs = a.join(dealt(b), (F.col("a.h") == F.col("b.h")) & (F.col("a.g") != F.col("b.g")) & once & room & few & new)
    return pairs.select(F.least("a.s", "b.s").alias("u"), F.greatest("a.s", "b.s").alias("v")).distinct()


def near_groups(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` (default: all) of docs, `_sj_group` (smallest id of the group) and `_sj_first` (one row of each group).

    The first row of a group is the one with its smallest id; of rows equal in
    that, any one.
    """
    with settled_scope() as made:
        return _near_groups(docs, text_col, id_col, keep, made)


def _near_groups(docs: DataFrame, text_col: str, id_col: str, keep: list[str] | None, made: list[str]) -> DataFrame:
    keep = docs.columns if keep is None else keep
    names = list(dict.fromkeys([*keep, id_col, text_col]))
    picked = docs.select(*[f"`{c}`" for c in names])
    schema = T.StructType([*picked.schema.fields, T.StructField("_sj_set", T.LongType()), T.StructField("_sj_n", T.IntegerType()),
                           T.StructField("_sj_fp", T.LongType()), T.StructField("_sj_bands", T.ArrayType(T.LongType()))])
    marked = settled(picked.mapInArrow(_marks(text_col), schema).withColumn("_sj_row", F.monotonically_increasing_id()))
    lowest = F.min(F.struct(F.col(f"`{id_col}`").isNull().alias("no"), F.col(f"`{id_col}`").cast("long").alias("id"), F.col("_sj_row").alias("row")))
    prints = settled(marked.groupBy("_sj_set").agg(lowest.alias("low"), F.first("_sj_n").alias("n"), F.first("_sj_fp").alias("fp"), F.first("_sj_bands").alias("bands")))
    near = settled(_golay_pairs(prints.where("n > 0").select(F.col("_sj_set").alias("s"), "n", "fp")))
    members = prints.select(F.col("_sj_set").alias("s"), "n", F.explode("bands").alias("k"))
    shared = members.groupBy("k").agg(F.min(F.struct("s", "n")).alias("c"), F.max("s").alias("d")).where("c.s <> d").select("k", "c")
    here = settled(members.join(dealt(shared), "k"))
    rows = here.select("s").union(near.select("u")).union(near.select("v")).distinct().join(prints, F.col("s") == F.col("_sj_set")).select("s", F.col("low.row").alias("_sj_row"))
    sets = settled(marked.select("_sj_row", f"`{text_col}`").join(rows, "_sj_row").select("s", f"`{text_col}`").mapInArrow(_whole(text_col), "s long, held array<long>"))

    alike = settled(_links(near, sets))
    tied = components(alike)
    grouped = here.join(tied.select(F.col("u").alias("s"), F.col("v").alias("g")), "s", "left").select("k", "s", "n", "c", F.coalesce("g", "s").alias("g"))
    met = grouped.join(tied.select(F.col("u").alias("cs"), F.col("v").alias("cg")), F.col("c.s") == F.col("cs"), "left")
    first = met.where((F.col("g") != F.coalesce("cg", "c.s")) & _sized(F.col("n"), F.col("c.n"))).select(F.col("c.s").alias("u"), F.col("s").alias("v")).distinct()
    first = settled(first)
    links = settled(_links(first, sets).unionByName(alike))
    tied = components(links)
    placed = here.select("k", "s", "n").join(tied.select(F.col("u").alias("s"), F.col("v").alias("g")), "s", "left").select("k", "s", "n", F.coalesce("g", "s").alias("g"))
    mixed = placed.groupBy("k").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo <> hi").select("k")
    apart = settled(placed.join(mixed, "k").select("s", "n", "g").distinct())
    others = _prefix_pairs(_prefixes(apart, sets)).join(dealt(first), ["u", "v"], "left_anti")
    tied = components(links.unionByName(_links(others, sets)))
    rooted = prints.join(tied, prints["_sj_set"] == tied["u"], "left").select("_sj_set", F.coalesce("v", "_sj_set").alias("root"), "low")
    roots = rooted.groupBy("root").agg(F.min("low").alias("low"))
    named = rooted.drop("low").join(roots, "root").select("_sj_set", F.col("low.id").alias("_sj_group"), F.col("low.row").alias("_sj_least"))
    named = settled(named)
    release(docs.sparkSession, made, keep=(marked, named))
    out = marked.drop("_sj_bands", "_sj_n").join(dealt(named), "_sj_set")
    return out.select(*[f"`{c}`" for c in keep], "_sj_group", (F.col("_sj_row") == F.col("_sj_least")).alias("_sj_first"))
