"""Token ids kept in wavelet-matrix files, one per shard.

Texts are encoded with the tokenizers library and end with id END. Encoded
documents are dealt to ranges of ids, and each run of about SHARD_TOKENS tokens
becomes one shard: a wavelet matrix of bit planes (bit by bit from the highest,
stably parted into zeros and ones), with counts of ones before every 64-bit
word. The file of a shard is a self-contained byte string: it gives access to
any token, counts an id in any stretch, finds its k-th place, and decodes whole
documents. Files are written as rows of one binary column, so that any store
Spark can write to will do; a lost executor's shards are written again.

Encoding works on the different words of a task, cut where neither the normaliser
nor the pattern of the tokenizer looks across: at blanks, and between letters and
marks. Lower-case Latin words go straight to the tokenizer's model; all others
through the whole tokenizer. Words already encoded by a worker are kept in a
table of bounded size.

Defined cases: a null or empty text is END alone; null ids come first; rows
with equal ids follow each other in order of their token ids.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duskline.llm.common import Remembered, text_bytes, width
from duskline.session import shared_folder

END = 1
SHARD_TOKENS = 4 << 20
REMEMBERED = 600_000
MAGIC = b"WVM1"


class WaveletMatrix:
    """Succinct sequence of small integers."""

    def __init__(self, n: int, planes: list[np.ndarray]):
        self.n, self.planes = n, planes  # planes: 64-bit words, lowest bit first
        self.before = [np.r_[0, np.cumsum(np.bitwise_count(p), dtype=np.int64)] for p in planes]
        self.zeros = [n - int(b[-1]) for b in self.before]

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        planes, now, n = [], ids, len(ids)
        for level in range(bits - 1, -1, -1):
            bit = (now >> level & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            planes.append(np.r_[packed, np.zeros(-len(packed) % 8, np.uint8)].view(np.uint64))
            now = np.concatenate([now[~bit], now[bit]])
        return cls(n, planes)

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones of a plane before each position."""
        word = at >> 6
        plane = np.r_[self.planes[level], np.uint64(0)]
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[level][word] + np.bitwise_count(plane[word] & mask)

    def _bit(self, level: int, at: np.ndarray) -> np.ndarray:
        return self.planes[level][at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)

    def access(self, at: np.ndarray) -> np.ndarray:
        """Ids at the given places."""
        at, out = np.asarray(at, np.int64), np.zeros(len(at), np.int64)
        for level in range(len(self.planes)):
            bit, ones = self._bit(level, at).astype(bool), self._ones(level, at)
            at = np.where(bit, self.zeros[level] + ones, at - ones)
            out = out << 1 | bit
        return out

    def _narrow(self, value: int, at: np.ndarray) -> np.ndarray:
        for level in range(len(self.planes)):
            ones = self._ones(level, at)
            at = self.zeros[level] + ones if value >> (len(self.planes) - 1 - level) & 1 else at - ones
        return at

    def count(self, value: int, low: int, high: int) -> int:
        """How often the id stands in [low, high)."""
        a, b = self._narrow(value, np.array([low, high], np.int64))
        return int(b - a)

    def places(self, value: int) -> np.ndarray:
        """All places of the id, in order: selects from the last plane up."""
        a, b = self._narrow(value, np.array([0, self.n], np.int64))
        at = np.arange(a, b)
        for level in range(len(self.planes) - 1, -1, -1):
            bit = np.unpackbits(self.planes[level].view(np.uint8), bitorder="little")[:self.n]
            one = value >> (len(self.planes) - 1 - level) & 1
            at = np.flatnonzero(bit == one)[at - (self.zeros[level] if one else 0)]
        return at

    def everything(self) -> np.ndarray:
        """The whole sequence, from the last plane up."""
        out = np.zeros(self.n, np.uint32)
        for level in range(len(self.planes) - 1, -1, -1):
            bit = np.unpackbits(self.planes[level].view(np.uint8), bitorder="little")[:self.n].astype(bool)
            prev = np.empty_like(out)
            prev[~bit] = out[:self.zeros[level]]
            prev[bit] = out[self.zeros[level]:] | np.uint32(1 << (len(self.planes) - 1 - level))
            out = prev
        return out


def write_shard(ids: np.ndarray, doc_ids: np.ndarray, known: np.ndarray, ends: np.ndarray, bits: int) -> bytes:
    """One file: header, document ids, which of them are known, ends of documents, planes."""
    matrix, squeeze = WaveletMatrix.build(ids, bits), zstandard.ZstdCompressor(level=1).compress
    blocks = [squeeze(a.tobytes()) for a in (doc_ids.astype(np.int64), known.astype(np.uint8), ends.astype(np.int64), *matrix.planes)]
    return MAGIC + struct.pack("<qqq", len(ids), len(doc_ids), bits) + np.array([len(b) for b in blocks], np.int64).tobytes() + b"".join(blocks)


def read_shard(raw: bytes) -> tuple[WaveletMatrix, np.ndarray, np.ndarray, np.ndarray]:
    """(matrix, document ids, which are known, ends of documents)."""
    if raw[:4] != MAGIC:
        raise ValueError("not a shard file")
    n, _, bits = struct.unpack_from("<qqq", raw, 4)
    sizes, at, out = np.frombuffer(raw, np.int64, 3 + bits, 28), 28 + 8 * (3 + bits), []
    for s, kind in zip(sizes.tolist(), [np.int64, np.uint8, np.int64] + [np.uint64] * bits, strict=True):
        out.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[at:at + s]), kind))
        at += s
    return WaveletMatrix(n, out[3:]), out[0], out[1], out[2]


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def _bits(path: str) -> int:
    return max(1, int(max(_tokenizer(path).get_vocab(with_added_tokens=True).values())).bit_length())


@cache
def _letters() -> dict[int, str]:
    """Characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = re.compile(r"[a-zß-öø-ÿ]+").fullmatch
_BLANK, _LETTER, _MARK, _QUOTE = 1, 2, 3, 4


@cache
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Class of every byte (0: digits, bytes of longer characters, controls) and the byte in lower case, A-Z only."""
    kind = np.zeros(256, np.uint8)
    kind[np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8)] = _BLANK
    kind[ord("a"):ord("z") + 1] = _LETTER
    kind[np.frombuffer(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~", np.uint8)] = _MARK
    kind[ord("'")] = _QUOTE
    low = np.arange(256, dtype=np.uint8)
    low[ord("A"):ord("Z") + 1] += 32
    return kind, low


def _words(buf: np.ndarray, offs: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Words of all texts, and how many words stand before each text's end.

    A word is cut at blanks, and between a Latin letter and a mark: the pattern
    never matches across the first, nor across the second unless the mark is an
    apostrophe before the letter. Batches with a sign of special tokens in them
    (written `<|`) are cut at blanks alone and keep their case.
    """
    kinds, low = _classes()
    special = bool(np.any((buf[:-1] == ord("<")) & (buf[1:] == ord("|"))))
    text = buf if special else low[buf]
    kind = kinds[text]
    cut = np.zeros(len(text) + 1, bool)
    if not special:
        left, right = kind[:-1], kind[1:]
        cut[1:-1] = ((left == _LETTER) & (right >= _MARK)) | ((left == _MARK) & (right == _LETTER))
    cut[offs] = True
    full = kind != _BLANK
    start = full & (cut[:-1] | ~np.r_[False, full[:-1]])
    at = np.flatnonzero(cut[:-1])
    return np.insert(text, at, ord(" ")).tobytes().split(), np.searchsorted(np.flatnonzero(start), offs[1:])


def _word_ids(words: list[bytes], path: str) -> list[list[int]]:
    """Ids of words."""
    tok, letters, hard = _tokenizer(path), _letters(), []
    out: list = [None] * len(words)
    model = tok.model.tokenize
    for n, w in enumerate(words):
        if w.isalpha() and w.islower():  # bytes: ASCII letters only
            out[n] = [t.id for t in model(w.decode())]
        elif _LETTERS(w.decode()):
            out[n] = [t.id for t in model(w.decode("latin-1").translate(letters))]
        else:
            hard.append(n)
    for n, e in zip(hard, tok.encode_batch_fast([words[n].decode() for n in hard], add_special_tokens=False), strict=True):
        out[n] = e.ids
    return out


_WORDS: dict[str, Remembered] = {}


def encode_flat(buf: np.ndarray, offs: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts (their bytes and len + 1 offsets), END after each, and len + 1 offsets of the ids."""
    known = _WORDS.get(path)
    if known is None or len(known) > REMEMBERED:
        known = _WORDS[path] = Remembered()
        known[b""]  # no word is empty: the first line is END
    words, ends = _words(buf, offs)
    lines = np.insert(np.fromiter(map(known.__getitem__, words), np.int64, len(words)), ends, 0)
    if known.fresh:
        found = [[END]] * (known.fresh[0] == b"") + _word_ids([w for w in known.fresh if w], path)
        sizes = [len(x) for x in found]
        known.fill(sizes, np.fromiter(chain.from_iterable(found), np.uint32, sum(sizes)))
    return known.ids(lines, np.r_[0, ends + np.arange(1, len(ends) + 1)])


def encode_texts(texts: list[str | None], path: str) -> list[np.ndarray]:
    """Ids of each text and END."""
    flat, offs = encode_flat(*text_bytes(pa.array(texts, pa.string())), path)
    return np.split(flat, offs[1:-1])


def _encoding(path: str):
    def run(batches):
        kind = np.uint16 if _bits(path) <= 16 else np.uint32
        for b in batches:
            flat, offs = encode_flat(*text_bytes(b["_wm_text"]), path)
            raw, at = flat.astype(kind).tobytes(), (offs * np.dtype(kind).itemsize).tolist()
            ids = [raw[x:y] for x, y in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([b["part"], b["doc_id"], pa.array(ids, pa.binary())], names=["part", "doc_id", "ids"])

    return run


def _writing(path: str, shard_tokens: int):
    def run(batches):
        kind = np.uint16 if _bits(path) <= 16 else np.uint32
        docs, held, size, part, seq = [], [], 0, None, 0

        def shard():
            ends = np.cumsum([len(x) for x in held])
            raw = write_shard(np.concatenate(held), np.array([d or 0 for d in docs]), np.array([d is not None for d in docs]), ends, _bits(path))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([int(ends[-1])], pa.int64()), pa.array([raw], pa.binary())],
                                              names=["part", "seq", "n_tokens", "file"])

        for b in batches:
            for p, d, raw in zip(b["part"].to_pylist(), b["doc_id"].to_pylist(), b["ids"].to_pylist(), strict=True):
                if p != part:
                    if held:
                        yield shard()
                    docs, held, size, part, seq = [], [], 0, p, 0
                docs.append(d)
                held.append(np.frombuffer(raw, kind))
                size += len(held[-1])
                if size >= shard_tokens:
                    yield shard()
                    docs, held, size, seq = [], [], 0, seq + 1
        if held:
            yield shard()

    return run


def _reading(batches):
    for b in batches:
        for part, seq, raw in zip(b["part"].to_pylist(), b["seq"].to_pylist(), b["file"].to_pylist(), strict=True):
            matrix, docs, known, ends = read_shard(raw)
            ids, starts = matrix.everything(), np.r_[0, ends[:-1]]
            sums = [zlib.crc32(ids[a:e].tobytes()) for a, e in zip(starts.tolist(), ends.tolist(), strict=True)]
            n = len(docs)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int32()), pa.array(docs, pa.int64(), mask=known == 0), pa.array(starts), pa.array(ends - starts), pa.array(sums, pa.int64())],
                names=["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"])


def write_files(docs: DataFrame, path: str, folder: str, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode all documents and write their shards under folder, in ascending order of ids (part, then seq)."""
    n = 2 * width(docs.sparkSession)
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("_wm_text"))
    # cut points from the ids alone: a range shuffle would encode everything once more for its sample
    cuts = base.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n).alias("c")).first()["c"] or []
    steps = F.array(*map(F.lit, sorted(set(cuts)))).cast("array<bigint>")
    part = F.when(F.col("doc_id").isNull(), 0).otherwise(F.size(F.filter(steps, lambda c: c < F.col("doc_id"))))
    ids = base.withColumn("part", part).mapInArrow(_encoding(path), "part int, doc_id long, ids binary").repartition(n, "part").sortWithinPartitions("part", "doc_id", "ids")
    ids.mapInArrow(_writing(path, shard_tokens), "part int, seq int, n_tokens long, file binary").write.parquet(folder)


def read_files(spark, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the shards."""
    files = spark.read.schema("part int, seq int, n_tokens long, file binary").parquet(folder)
    # one row per shard: a shard holds millions of tokens
    before = F.coalesce(F.sum("n_tokens").over(W.orderBy("part", "seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = files.select("part", "seq", "n_tokens").withColumn("before", before).drop("n_tokens")
    read = files.select("part", "seq", "file").mapInArrow(_reading, "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return read.join(starts, ["part", "seq"]).select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def store(docs: DataFrame, path: str, **names) -> DataFrame:
    """Write shards to a fresh place in the shared folder and read them back."""
    folder = f"{shared_folder(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write_files(docs, path, folder, **names)
    return read_files(docs.sparkSession, folder)
