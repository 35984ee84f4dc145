"""Toxicity by a small convolutional classifier, trained here in numpy.

A word's embedding is the sum of four table rows: two hashes of the word and two
of its first PREFIX letters (inflected forms share them). A word is only mistaken
for another where both hashes meet. Filters of widths 1,
2 and 3 run over the words, the highest and the second highest (different)
response in the document are taken, rectified, and a logistic unit reads them. The first embedding column starts at the
log-odds of the hash in toxic documents. Thresholds are set per language
on all labelled rows that were not fitted on, from their counts in score bins; a score is shifted so that its language's threshold
becomes 0.3. The language is guessed from function words of the text: neither
labels, lang, source nor ids are inputs of a score.

Training reads a bounded sample of labelled rows (TRAIN_ROWS per class, chosen
by hash of the id, whole texts) in one task; its model has a fixed size and goes
to all scoring tasks. `classify` reads every whole text once: language and logit
are settled beside the columns to keep, that table's ids, languages and logits
meet the labels for the thresholds, and scores are shifted as columns. Texts are
in no shuffle.

Defined cases: null and empty texts have no words and get the score of the bare
bias; a null id is scored and never trained on; repeated label rows count once
(toxic if any says so); with no labelled rows of a class, every score is 0.
"""

from __future__ import annotations

import io
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duskline.session import settled

BUCKETS = 1 << 16
DIM = 8
FILTERS = 8
WIDTHS = (1, 2, 3)
TABLES = 4
PREFIX = 4
EPOCHS = 6
RATE = 0.05
TRAIN_ROWS = 2500
CUT = 0.3
#: Score bins a unit of the logit, and the largest logit with a bin of its own.
BINS, FAR = 64, 64
_PUNCT = b".,;:!?\"'()[]{}|*#%&$-_"
#: Function words that tell the language of a text.
FUNCTION_WORDS = {
    "en": "the of and to in is that it was for on with as be at by this",
    "de": "der die und das von den mit ist des im nicht ein eine auf zu",
    "fr": "le la les et des du est que une dans qui par pour au sur",
    "es": "el los las y del que una con para por su se al lo es",
}
_LANG = {w.encode(): i for i, ws in enumerate(FUNCTION_WORDS.values(), 1) for w in ws.split()}


class _Codes(dict):
    """Word -> line of `hashes` and `langs`."""

    def __init__(self):
        super().__init__()
        self.hashes, self.langs = array("H"), array("B")

    def __missing__(self, word: bytes) -> int:
        bare = word.strip(_PUNCT) or word
        start = bare.decode()[:PREFIX].encode()
        self.hashes.extend(zlib.crc32(salt + part) % BUCKETS for salt, part in ((b"1", bare), (b"2", bare), (b"3", start), (b"4", start)))
        self.langs.append(_LANG.get(bare, 0))
        self[word] = len(self.langs) - 1
        return self[word]


_CODES = [_Codes()]


def encode(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words (words x TABLES), offsets of documents, and the guessed language of each (0: none)."""
    if len(_CODES[0]) > 400_000:  # words a worker remembers
        _CODES[0] = _Codes()
    known = _CODES[0]
    lists = [(t or "").encode().lower().split() for t in texts]
    offs = np.cumsum([0, *map(len, lists)])
    at = np.fromiter((c for ws in lists for c in map(known.__getitem__, ws)), np.int64, int(offs[-1]))
    hashes, langs = np.array(known.hashes, np.uint16).reshape(-1, TABLES), np.array(known.langs, np.int64)
    doc, n = np.repeat(np.arange(len(texts)), np.diff(offs)), len(FUNCTION_WORDS) + 1
    votes = np.bincount(doc * n + langs[at], minlength=n * len(texts)).reshape(-1, n)
    votes[:, 0] = 0
    return hashes[at], offs, np.where(votes.any(axis=1), votes.argmax(axis=1), 0)


class Model:
    """Weights of the classifier; `forward` gives the maxima and where they stand."""

    NAMES = ("words", "filters", "bias", "top", "level")

    def __init__(self, rng: np.random.Generator):
        self.words = np.zeros((TABLES * BUCKETS, DIM), np.float32)
        self.filters = rng.normal(0, 0.2, (sum(WIDTHS), DIM, FILTERS)).astype(np.float32)
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.top = rng.normal(0, 0.1, 2 * len(WIDTHS) * FILTERS).astype(np.float32)
        self.level = np.zeros(1, np.float32)

    def embed(self, hashes: np.ndarray) -> np.ndarray:
        return sum(self.words[hashes[:, t].astype(np.int64) + t * BUCKETS] for t in range(TABLES))

    def maxima(self, hashes: np.ndarray, offs: np.ndarray, where: bool = False):
        """Rectified maxima, then second maxima (documents x 2 filters); with `where`, also the words at which they stand (-1: none)."""
        docs, k = len(offs) - 1, len(WIDTHS) * FILTERS
        best, spot = np.zeros((docs, 2 * k), np.float32), np.full((docs, 2 * k), -1, np.int64)
        seen, row = self.embed(hashes), 0
        for i, w in enumerate(WIDTHS):
            n = len(seen) - w + 1
            live = np.flatnonzero(np.diff(offs) >= w)
            if n > 0 and len(live):
                out = np.empty((len(seen) + 1, FILTERS), np.float32)
                out[n:] = -np.inf
                out[:n] = sum(seen[j:j + n] @ self.filters[row + j] for j in range(w)) + self.bias[i * FILTERS:(i + 1) * FILTERS]
                edges = np.stack([offs[live], offs[live + 1] - w + 1], axis=1).ravel()
                for rank in (0, 1):
                    cols = slice(rank * k + i * FILTERS, rank * k + (i + 1) * FILTERS)
                    high = np.maximum.reduceat(out, edges, axis=0)[::2]
                    best[live, cols] = np.maximum(high, 0)
                    if where:
                        for d in live:
                            part = out[offs[d]:offs[d + 1] - w + 1]
                            spot[d, cols] = np.where(best[d, cols] > 0, part.argmax(axis=0) + offs[d], -1)
                    if rank == 0:
                        every = np.full((docs, FILTERS), np.inf, np.float32)
                        every[live] = high
                        out[:-1][out[:-1] == np.repeat(every, np.diff(offs), axis=0)] = -np.inf
            row += w
        return (best, spot) if where else best

    def logits(self, hashes: np.ndarray, offs: np.ndarray) -> np.ndarray:
        return self.maxima(hashes, offs) @ self.top + self.level[0]

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, **{n: getattr(self, n).astype(np.float16 if n == "words" else np.float32) for n in self.NAMES}, cuts=self.cuts)
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> Model:
        model, data = cls.__new__(cls), np.load(io.BytesIO(raw))
        for n in (*cls.NAMES, "cuts"):
            setattr(model, n, data[n].astype(np.float32))
        return model


def _start_at_log_odds(model: Model, hashes: np.ndarray, offs: np.ndarray, y: np.ndarray) -> None:
    doc = np.repeat(np.arange(len(y)), np.diff(offs))
    for t in range(TABLES):
        pairs = np.unique(doc * BUCKETS + hashes[:, t])
        held, toxic = pairs % BUCKETS, y[pairs // BUCKETS] > 0
        pos, neg = np.bincount(held[toxic], minlength=BUCKETS), np.bincount(held[~toxic], minlength=BUCKETS)
        odds = np.log((pos + 0.5) / (y.sum() + 1)) - np.log((neg + 0.5) / ((1 - y).sum() + 1))
        model.words[t * BUCKETS:(t + 1) * BUCKETS, 0] = odds * (pos + neg) / (pos + neg + 3.0) / TABLES
    model.filters[:, 0, 0] = 1.0 / np.repeat(WIDTHS, WIDTHS)
    model.top[::FILTERS] = 1.0


def train(texts: list[str | None], y: np.ndarray, kept_out: np.ndarray, seed: int = 11) -> Model:
    """Fit on the rows that are not kept out; thresholds by language from the others."""
    rng = np.random.default_rng(seed)
    model = Model(rng)
    hashes, offs, lang = encode(texts)
    y = y.astype(np.float64)

    def of(rows):
        words = np.concatenate([np.arange(offs[r], offs[r + 1]) for r in rows]) if len(rows) else np.zeros(0, int)
        return hashes[words], np.cumsum([0, *(offs[rows + 1] - offs[rows])])

    fit = np.flatnonzero(~kept_out)
    _start_at_log_odds(model, *of(fit), y[fit])
    weight = np.where(y > 0, 0.5 / max(1, y[fit].sum()), 0.5 / max(1, (1 - y[fit]).sum())) * len(fit)
    squares = {n: np.full(getattr(model, n).shape, 1e-2, np.float32) for n in Model.NAMES}

    def step(name, grad, at=...):
        squares[name][at] += grad * grad
        getattr(model, name)[at] -= RATE * grad / np.sqrt(squares[name][at])

    for _ in range(EPOCHS):
        for rows in np.array_split(rng.permutation(fit), max(1, len(fit) // 64)):
            h, o = of(rows)
            best, spot = model.maxima(h, o, where=True)
            err = ((1 / (1 + np.exp(-(best @ model.top + model.level[0]))) - y[rows]) * weight[rows] / len(rows)).astype(np.float32)
            back = err[:, None] * model.top
            step("top", best.T @ err)
            step("level", err.sum(keepdims=True))
            row, at, pushed = 0, [], []
            grads = {n: np.zeros_like(getattr(model, n)) for n in ("filters", "bias")}
            for i, w in enumerate(WIDTHS):
                for c in (*range(i * FILTERS, (i + 1) * FILTERS), *range((len(WIDTHS) + i) * FILTERS, (len(WIDTHS) + i + 1) * FILTERS)):
                    f = c % FILTERS
                    live = np.flatnonzero(spot[:, c] >= 0)
                    g, first = back[live, c], spot[live, c]
                    grads["bias"][i * FILTERS + f] += g.sum()
                    for j in range(w):
                        grads["filters"][row + j, :, f] += g @ model.embed(h[first + j])
                        at.append(first + j)
                        pushed.append(g[:, None] * model.filters[row + j, :, f])
                row += w
            at, pushed = np.concatenate(at), np.concatenate(pushed)
            lines, inv = np.unique((h[at].astype(np.int64) + np.arange(TABLES) * BUCKETS).ravel(), return_inverse=True)
            total = np.zeros((len(lines), DIM), np.float32)
            np.add.at(total, inv, np.repeat(pushed, TABLES, axis=0))
            step("words", total, lines)
            for n, grad in grads.items():
                step(n, grad)
    held = np.flatnonzero(kept_out)
    held = held if len(set(y[held])) == 2 else np.arange(len(y))
    z = model.logits(*of(held))
    every = _threshold(z, y[held])
    model.cuts = np.array([every] + [_threshold(z[m], y[held][m]) if 10 <= y[held][m].sum() and 10 <= (1 - y[held][m]).sum() else every
                                     for k in range(1, len(FUNCTION_WORDS) + 1) for m in [lang[held] == k]], np.float32)
    return model


def _threshold(z: np.ndarray, y: np.ndarray) -> float:
    """Middle of the gap at the cut with the best balance of caught toxic and spared clean rows; spared ones weigh more."""
    order = np.argsort(-z)
    caught, hurt = np.cumsum(y[order]) / max(1, y.sum()), np.cumsum(1 - y[order]) / max(1, (1 - y).sum())
    last = np.r_[z[order][1:] != z[order][:-1], True]
    gain = np.where(last, caught - 2 * hurt, -9)
    i = int(np.argmax(gain))
    below = z[order][i + 1] if i + 1 < len(z) else z[order][i] - 1
    return float((z[order][i] + below) / 2)


def _binned_threshold(bins: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> float:
    """`_threshold` from the counts of both classes in ascending score bins."""
    caught, hurt = np.cumsum(toxic[::-1])[::-1] / max(1, toxic.sum()), np.cumsum(clean[::-1])[::-1] / max(1, clean.sum())
    gain = caught - 2 * hurt
    i = len(gain) - 1 - int(np.argmax(gain[::-1]))
    below = bins[i - 1] + 1 if i else bins[i] - BINS
    return float(bins[i] + below) / 2 / BINS


def _measuring(raw: bytes, text_col: str):
    def run(batches):
        model = Model.load(raw)
        for b in batches:
            hashes, offs, lang = encode(b[text_col].to_pylist())
            z = np.asarray(model.logits(hashes, offs), np.float64)
            yield pa.RecordBatch.from_arrays([*[b[n] for n in b.schema.names if n != "_tx_text"], pa.array(lang.astype(np.int32)), pa.array(z)],
                                             names=[*[n for n in b.schema.names if n != "_tx_text"], "_tx_lang", "_tx_logit"])

    return run


def measured(docs: DataFrame, raw: bytes, text_col: str, id_col: str, keep: list[str]) -> DataFrame:
    """Columns `keep` of docs, `_tx_id`, and each text's guessed language and logit, settled."""
    picked = docs.select(*[f"`{c}`" for c in keep], F.col(f"`{id_col}`").alias("_tx_id"), F.col(f"`{text_col}`").alias("_tx_text"))
    fields = [*picked.drop("_tx_text").schema.fields, T.StructField("_tx_lang", T.IntegerType()), T.StructField("_tx_logit", T.DoubleType())]
    return settled(picked.mapInArrow(_measuring(raw, "_tx_text"), T.StructType(fields)))


def thresholds(raw: bytes, scores: DataFrame, labels: DataFrame) -> np.ndarray:
    """Thresholds by language (0: all) from the logits of all labelled rows; the model's own if a class is missing.

    scores: `_tx_id`, `_tx_lang`, `_tx_logit`. labels: `_tx_id`, y.
    """
    cell = F.least(F.greatest(F.floor(F.col("_tx_logit") * BINS), F.lit(-FAR * BINS)), F.lit(FAR * BINS)).cast("int").alias("bin")
    met = scores.select("_tx_id", F.col("_tx_lang").alias("lang"), cell).join(labels, "_tx_id")
    counts = met.groupBy("lang", "bin").agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean"))
    got = np.array([tuple(r) for r in counts.collect()], np.int64).reshape(-1, 4)

    def cut(rows, least, other):
        if rows[:, 2].sum() < least or rows[:, 3].sum() < least:
            return other
        bins, at = np.unique(rows[:, 1], return_inverse=True)
        return _binned_threshold(bins, np.bincount(at, rows[:, 2]), np.bincount(at, rows[:, 3]))

    every = cut(got, 1, None)
    if every is None:
        return Model.load(raw).cuts
    return np.array([every] + [cut(got[got[:, 0] == k], 10, every) for k in range(1, len(FUNCTION_WORDS) + 1)], np.float32)


def _training(batches):
    rows = [(t, y, k) for b in batches for t, y, k in zip(b["text"].to_pylist(), b["y"].to_pylist(), b["k"].to_pylist(), strict=True)]
    rows.sort(key=lambda r: (r[2], r[0] or ""))
    y = np.array([r[1] for r in rows])
    if len(set(y)) == 2:
        yield pa.RecordBatch.from_arrays([pa.array([train([r[0] for r in rows], y, np.array([r[2] for r in rows]) % 3 == 0).dump()], pa.binary())], names=["model"])


def _trained(docs: DataFrame, labels: DataFrame, text_col: str, id_col: str, rows: int) -> tuple[bytes | None, DataFrame]:
    """Model from at most `rows` labelled rows of each class (None if a class has none), and the labels of all others."""
    known = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max("toxic").cast("int").alias("y"))
    known = known.withColumn("k", F.shiftrightunsigned(F.xxhash64(F.lit(5), id_col), 1))
    chosen = known.where("y = 1").orderBy("k", id_col).limit(rows).unionByName(known.where("y = 0").orderBy("k", id_col).limit(rows))
    chosen = chosen.select(F.col(id_col).alias("_tx_id"), "y", "k")
    sample = docs.select(F.col(f"`{id_col}`").alias("_tx_id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(chosen), "_tx_id")
    got = sample.select("text", "y", "k").repartition(1).mapInArrow(_training, "model binary").collect()
    rest = known.select(F.col(id_col).alias("_tx_id"), "y").join(chosen.where("k % 3 <> 0").select("_tx_id"), "_tx_id", "left_anti")
    return bytes(got[0]["model"]) if got else None, rest


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", rows: int = TRAIN_ROWS) -> bytes | None:
    """Model for `score` on other texts: from at most `rows` labelled rows of each class, thresholds from all others. labels: id_col, toxic."""
    raw, rest = _trained(docs, labels, text_col, id_col, rows)
    if raw is None:
        return None
    model = Model.load(raw)
    model.cuts = thresholds(raw, measured(docs, raw, text_col, id_col, []), rest)
    return model.dump()


def classify(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", keep: list[str] | None = None, rows: int = TRAIN_ROWS) -> DataFrame:
    """Columns `keep` (default: all) of docs and `_tx_score`, from a model of their own labels, as `fit` and `score` in one pass over the texts."""
    keep = docs.columns if keep is None else keep
    raw, rest = _trained(docs, labels, text_col, id_col, rows)
    if raw is None:
        return docs.select(*[f"`{c}`" for c in keep], F.lit(0.0).alias("_tx_score"))
    known = measured(docs, raw, text_col, id_col, keep)
    shift = F.get(F.array(*[F.lit(float(c)) for c in thresholds(raw, known, rest)]), F.col("_tx_lang"))
    return known.select(*[f"`{c}`" for c in keep], _squashed(F.col("_tx_logit") - shift).alias("_tx_score"))


def _squashed(above: Column) -> Column:
    """Score of a logit's distance from its threshold."""
    z = F.least(F.greatest(above + float(np.log(CUT / (1 - CUT))), F.lit(-60.0)), F.lit(60.0))
    return 1 / (1 + F.exp(-z))


def score(docs: DataFrame, model: bytes | None, text_col: str = "text") -> DataFrame:
    """All columns of docs and `_tx_score`."""
    if model is None:
        return docs.withColumn("_tx_score", F.lit(0.0))
    cuts = F.array(*[F.lit(float(c)) for c in Model.load(model).cuts])
    fields = [*docs.schema.fields, T.StructField("_tx_lang", T.IntegerType()), T.StructField("_tx_logit", T.DoubleType())]
    known = docs.mapInArrow(_measuring(model, text_col), T.StructType(fields))
    return known.withColumn("_tx_score", _squashed(F.col("_tx_logit") - F.get(cuts, F.col("_tx_lang")))).drop("_tx_lang", "_tx_logit")


def held_out(id_: Column) -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(id_.cast("string")) % 4 == 2, F.lit(False))
