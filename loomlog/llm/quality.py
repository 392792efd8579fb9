"""Quality classifier: random-indexing word vectors, pooled per document, and a small network.

Every token owns a sparse ternary index vector, given by its hash. A token's word vector is
the sum of the index vectors of its neighbours over the training sample (random indexing).
A document is the mean and the spread of its tokens' vectors. Two dense layers in numpy
give a logit, which one temperature, fitted on rows set aside, turns into a probability.

Tokens are runs of letters, runs of digits, single other characters, and the shape of each
word (lower, capital, upper case, or a repetition); texts are handled as bytes, without a loop over words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import pieces
from .common import NULL_ID, null_ids, table, tidy, with_ids

#: Labelled rows that the classifier is fitted on, at most (smallest hash of doc_id first).
SAMPLE_ROWS = 8000
#: Slots of the token table, and dimensions of a vector.
SLOTS, DIM, NONZERO, REACH = 1 << 14, 48, 6, 2
#: Tokens whose vectors are gathered at a time, and characters that are parsed at a time.
STEP, PART = 1 << 15, 1 << 18
LEAST_SEEN = 10
SHAPES = 8  # the first slots are word shapes
PARTS = 8  # tasks that sum word vectors; each sends SLOTS x DIM numbers at most

_CLASS = np.zeros(256, dtype=np.uint8)  # 0 white space, 1 letter, 2 digit, 3 other
_CLASS[33:128] = 3
_CLASS[48:58] = 2
_CLASS[65:91] = _CLASS[97:123] = 1
_CLASS[128:] = 1
_UPPER = np.zeros(256, dtype=np.uint8)
_UPPER[65:91] = 1


def index_vectors() -> np.ndarray:
    """The ternary vector of each slot, the same on every machine."""
    rng = np.random.Generator(np.random.PCG64(1234))
    out = np.zeros((SLOTS, DIM), dtype=np.float32)
    at = rng.integers(0, DIM, size=(SLOTS, NONZERO))
    sign = rng.choice(np.array([-1.0, 1.0], dtype=np.float32), size=(SLOTS, NONZERO))
    np.put_along_axis(out, at, sign, axis=1)
    return out


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all tokens of all texts, in order, and where each text's begin (one more entry than texts).

    The hash of a word is a polynomial in its bytes, taken from running sums.
    """
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    edge = np.cumsum([0, *[len(b) + 1 for b in raw]])
    data = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    kind = _CLASS[data]
    begin = np.ones(len(data), dtype=bool)
    begin[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 3)
    starts = np.flatnonzero(begin)
    ends = np.append(starts[1:], len(data))
    real = kind[starts] > 0
    starts, ends = starts[real], ends[real]
    base, inverse = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(len(data), base, dtype=np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power)])
        back = np.cumprod(np.full(len(data), inverse, dtype=np.uint64))
        h = (sums[ends] - sums[starts]) * back[starts]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        slot = (h >> np.uint64(40)).astype(np.int64) % (SLOTS - SHAPES) + SHAPES
    of = kind[starts]
    slot[of == 2] = SHAPES - 1  # all numbers are one token
    word = of == 1
    first, second = _UPPER[data[starts]], _UPPER[data[np.minimum(starts + 1, len(data) - 1)]] * (ends - starts > 1)
    shape = first + 2 * (first & second)
    said = np.flatnonzero(word)
    shape[said[1:][slot[said[1:]] == slot[said[:-1]]]] = 4
    # words are followed by their shape: 0 lower, 1 capital, 3 upper, 4 the word before again; others stand alone
    width = np.where(word, 2, 1)
    place = np.cumsum(width) - width
    out = np.zeros(int(width.sum()), dtype=np.int64)
    out[place] = slot
    out[place[word] + 1] = shape[word]
    bounds = np.append(place, len(out))[np.searchsorted(starts, edge)]
    return out, bounds


def sections(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """(rows, parts): the texts in batches of about PART characters; longer texts are cut at spaces."""
    owner: list[int] = []
    parts: list[str] = []
    size = 0
    for i, text in enumerate(texts):
        at = 0
        while at < len(text) or not text:
            end = len(text) if len(text) - at <= PART else text.rfind(" ", at + 1, at + PART)
            end = at + PART if end <= at else end
            if parts and size + end - at > PART:
                yield owner, parts
                owner, parts, size = [], [], 0
            owner.append(i)
            parts.append(text[at:end])
            size += end - at
            at = end
            if not text:
                break
    if parts:
        yield owner, parts


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


class Model:
    """Word vectors, the two layers and the temperature."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.mean = self.scale = None
        self.layers: list[np.ndarray] = []
        self.temperature = 1.0

    def pool(self, texts: list[str]) -> np.ndarray:
        """Mean and spread of the token vectors of each text; zeros for texts without tokens.

        Vectors are gathered for some tokens at a time, whatever the length of a text.
        """
        total, square, count = np.zeros((len(texts), DIM)), np.zeros((len(texts), DIM)), np.zeros(len(texts))
        for owner, parts in sections(texts):
            slot, bounds = tokens(parts)
            of = np.repeat(np.asarray(owner), np.diff(bounds))
            count += np.bincount(of, minlength=len(texts))
            for i in range(0, len(slot), STEP):
                v, rows = self.vectors[slot[i : i + STEP]], of[i : i + STEP]
                first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
                total[rows[first]] += np.add.reduceat(v, first, axis=0, dtype=np.float64)
                square[rows[first]] += np.add.reduceat(v * v, first, axis=0, dtype=np.float64)
        n = np.maximum(count, 1)[:, None]
        mean = total / n
        return np.concatenate([mean, np.sqrt(np.maximum(square / n - mean * mean, 0))], axis=1)

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return (np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2).ravel()

    def score(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(self.pool(texts)) / self.temperature, -50, 50)))

    def train(self, x: np.ndarray, y: np.ndarray, aside: np.ndarray, hidden: int = 32, epochs: int = 60) -> None:
        """Adam on the log loss, classes weighted alike; the rows `aside` only set the temperature."""
        rng = np.random.Generator(np.random.PCG64(7))
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        d = x.shape[1]
        self.layers = [rng.normal(0, 1 / np.sqrt(d), (d, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), (hidden, 1)), np.zeros(1)]
        z, t = ((x - self.mean) / self.scale)[~aside], y[~aside].astype(float)
        weight = np.where(t > 0.5, 0.5 / max(t.mean(), 1e-3), 0.5 / max(1 - t.mean(), 1e-3))
        m, v, step = [np.zeros_like(p) for p in self.layers], [np.zeros_like(p) for p in self.layers], 0
        for _ in range(epochs):
            order = rng.permutation(len(z))
            for i in range(0, len(order), 128):
                r = order[i : i + 128]
                w1, b1, w2, b2 = self.layers
                h = np.tanh(z[r] @ w1 + b1)
                p = 1 / (1 + np.exp(-np.clip((h @ w2 + b2).ravel(), -50, 50)))
                g = ((p - t[r]) * weight[r] / len(r))[:, None]
                back = g @ w2.T * (1 - h * h)
                grads = [z[r].T @ back + 1e-4 * w1, back.sum(axis=0), h.T @ g + 1e-4 * w2, g.sum(axis=0)]
                step += 1
                for k, q in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * q
                    v[k] = 0.999 * v[k] + 0.001 * q * q
                    self.layers[k] = self.layers[k] - 0.003 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        if aside.any():
            s, t = self.logits(x[aside]), y[aside].astype(float)
            losses = {k: -np.mean(t * -np.logaddexp(0, -s / k) + (1 - t) * -np.logaddexp(0, s / k)) for k in np.exp(np.linspace(-1, 3, 81))}
            self.temperature = min(losses, key=losses.get)


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, y, text) of at most `most` labelled rows that aren't held out, one row an id.

    Rows with a null label or id, and null texts, are left out; an id that is labelled or
    stands more than once counts once, with its largest label and its text of smallest hash.
    """
    wanted = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) != 1)
    once = wanted.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    picked = once.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id")
    return rows.groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """A model of labels.quality from the texts that are not held out; None if either class has no row.

    At most sample_rows labelled rows are used, those whose hashed doc_id is smallest (see sample()).
    """
    rows = sample(docs, labels, "quality", sample_rows).repartition(PARTS).persist()
    index = index_vectors()

    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, seen = np.zeros((SLOTS, DIM), dtype=np.float32), np.zeros(SLOTS, dtype=np.int64)
        for pdf in batches:
            texts = pdf.text.tolist()
            for owner, parts in sections(texts):
                slot, bounds = tokens(parts)
                of = np.repeat(np.asarray(owner), np.diff(bounds))
                for i in range(0, len(slot), STEP):
                    lo, hi = i, min(len(slot), i + STEP)
                    near = np.zeros((hi - lo, DIM), dtype=np.float32)
                    for k in (*range(-REACH, 0), *range(1, REACH + 1)):
                        at = np.arange(lo, hi) + k
                        ok = (at >= 0) & (at < len(slot))
                        ok[ok] = of[at[ok]] == of[np.arange(lo, hi)[ok]]
                        near[ok] += index[slot[at[ok]]]
                    order = np.argsort(slot[lo:hi], kind="stable")
                    which, first = np.unique(slot[lo:hi][order], return_index=True)
                    sums[which] += np.add.reduceat(near[order], first, axis=0)
                seen += np.bincount(slot, minlength=SLOTS)
        some = np.flatnonzero(seen)
        if len(some):
            yield pd.DataFrame({"slot": some, "seen": seen[some], "sums": [x.tobytes() for x in sums[some]]})

    vectors, seen = np.zeros((SLOTS, DIM), dtype=np.float64), np.zeros(SLOTS)
    for r in rows.select("text").mapInPandas(tidy(contexts), "slot int, seen long, sums binary").collect():
        vectors[r.slot] += np.frombuffer(r.sums, dtype=np.float32)
        seen[r.slot] += r.seen
    # rare tokens keep their index vector: their contexts would be those of the very texts trained on
    mixed = np.where(seen[:, None] >= LEAST_SEEN, vectors, 0) + 2.0 * index
    vectors = (mixed / np.maximum(np.linalg.norm(mixed, axis=1, keepdims=True), 1e-9)).astype(np.float32)
    model = Model(vectors)

    def pooled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf.text.tolist()
            for a, b in pieces(texts):
                yield pd.DataFrame({"doc_id": pdf.doc_id.iloc[a:b].to_numpy(), "y": pdf.y.iloc[a:b].to_numpy(), "x": list(model.pool(texts[a:b]))})

    got = sorted((r.doc_id, r.y, r.x) for r in rows.select("doc_id", "y", "text").mapInPandas(tidy(pooled), "doc_id long, y int, x array<double>").collect())
    rows.unpersist()
    y = np.array([r[1] for r in got])
    if not len(y) or y.min() == y.max():
        return None
    aside = np.array([zlib.crc32(b"aside" + str(r[0]).encode()) % 5 == 0 for r in got])
    if len(np.unique(y[~aside])) < 2:
        aside[:] = False
    model.train(np.array([r[2] for r in got]), y, aside)
    return model


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score, predicted for each row: null texts are scored as empty ones, which have no tokens.

    Without a model (no labels of both classes) every score is 0.5. Repeated rows get a row
    each, an empty table gives none; a text of any length is scored whole, in parts of bounded
    size. doc_id must be a whole number or null.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, ids = pdf.text.fillna("").tolist(), pdf.doc_id.to_numpy()
            for a, b in pieces(texts):
                s = model.score(texts[a:b]) if model else np.full(b - a, 0.5)
                yield pd.DataFrame({"doc_id": ids[a:b], "held_out": [i != NULL_ID and held_out(i) for i in ids[a:b].tolist()], "score": s, "predicted": (s >= 0.5).astype(np.int32)})

    return null_ids(with_ids(docs.select("doc_id", "text")).mapInPandas(tidy(run), "doc_id long, held_out boolean, score double, predicted int"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


def keep_good(docs: DataFrame, model: Model | None, least: float = 0.5) -> DataFrame:
    """Rows of docs, all columns, whose own text scores at least `least`. Without a model all are kept."""

    if model is None:
        return docs

    @F.pandas_udf("double")
    def scored(text: pd.Series) -> pd.Series:
        texts = text.fillna("").tolist()
        return pd.Series(np.concatenate([model.score(texts[a:b]) for a, b in pieces(texts)]) if texts else np.zeros(0))

    return docs.where(scored("text") >= least)
