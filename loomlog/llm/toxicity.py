"""Toxicity: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams.

Features of a text, each present or not: its words, the stems of its words (their first 4 to
8 bytes), pairs of neighbouring words, and pairs of words that one or two others stand
between; each hashed to a slot. The learner keeps two numbers a slot (z, the shifted sum of
gradients, and n, the sum of their squares), so each coordinate has a rate of its own, and
L1 leaves few weights: they are what is handed to the tasks that score.

Training reads a bounded sample, dealt to shards by hash. A shard takes up a slot once it has
come in LEAST_SEEN texts, and after each round hands on those whose |z| reaches LEAST_Z (the
others are far from a weight and start anew); these states are averaged, and the weights are
taken from the averages. Texts are handled as bytes, in parts of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import pieces
from .common import NULL_ID, cut, null_ids, table, tidy, with_ids
from .quality import held_out, sample, sections

#: Labelled rows that the weights are learned from, at most (smallest hash of doc_id first).
SAMPLE_ROWS = 12_000
SHARDS, ROUNDS, LEAST_SEEN, LEAST_Z = 4, 3, 3, 1.0
#: Slots of the weight table; slot 0 is the bias.
SLOTS = 1 << 22
#: Rates and penalties: w = -(z - sign(z) L1) / ((BETA + sqrt(n)) / ALPHA + L2) where |z| > L1.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 3.0, 0.0
STEMS = range(4, 9)
SKIPS = (1, 2, 3)
#: A score from which a text counts as toxic.
LEAST = 0.7

_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _slot(h: np.ndarray, kind: int) -> np.ndarray:
    """Slots 1 and up of hashes; each kind of feature has hashes of its own."""
    h = h + np.uint64(kind * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return (h % np.uint64(SLOTS - 1)).astype(np.int64) + 1


def features(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text numbers, slots) of all features of texts, part by part, repeats included.

    A hash of some bytes is a difference of running sums of a polynomial, so words and their
    stems cost the same. Pairs don't cross the parts that very long texts are cut into.
    """
    for owner, parts in sections(texts):
        raw = [t.lower().encode("utf-8", "surrogatepass") for t in parts]
        edge = np.cumsum([0, *[len(b) + 1 for b in raw]])
        data = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
        inside = np.concatenate([[False], _WORD[data], [False]])
        turns = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = turns[::2], turns[1::2]
        if not len(start):
            continue
        of = np.asarray(owner)[np.searchsorted(edge, start, side="right") - 1]
        with np.errstate(over="ignore"):
            power = np.cumprod(np.full(len(data), _BASE, dtype=np.uint64))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power)])
            back = np.cumprod(np.full(len(data), _BACK, dtype=np.uint64))[start]
            word = (sums[end] - sums[start]) * back
            yield of, _slot(word, 1)
            for n in STEMS:
                longer = np.flatnonzero(end - start > n)
                yield of[longer], _slot((sums[start[longer] + n] - sums[start[longer]]) * back[longer], 2)
            for gap in SKIPS:
                same = np.flatnonzero(of[gap:] == of[:-gap])
                yield of[same], _slot(word[same] * np.uint64(3) + word[same + gap], 2 + gap)


def rows_of(texts: list[str]) -> list[np.ndarray]:
    """The distinct slots of each text, the bias first."""
    found = [(of * SLOTS + slot) for of, slot in features(texts)]
    keys = np.unique(np.concatenate([np.arange(len(texts)) * SLOTS, *found]))
    return np.split(keys % SLOTS, np.searchsorted(keys, np.arange(1, len(texts)) * SLOTS))


def weights(at: np.ndarray, z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The weights of slots `at` by their z and n."""
    over = np.where(at > 0, L1, 0.0)
    w = -(z - np.sign(z) * over) / ((BETA + np.sqrt(n)) / ALPHA + L2)
    return np.where(np.abs(z) > over, w, 0.0)


class State:
    """z and n of all slots."""

    def __init__(self) -> None:
        self.z, self.n = np.zeros(SLOTS, dtype=np.float32), np.zeros(SLOTS, dtype=np.float32)

    def weights(self, at: np.ndarray) -> np.ndarray:
        return weights(at, self.z[at].astype(np.float64), self.n[at].astype(np.float64))

    def learn(self, at: np.ndarray, y: int) -> None:
        """One text: distinct slots and its label."""
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -50, 50))) - y
        n = self.n[at].astype(np.float64)
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] += g * g


class Model:
    """The slots that have a weight, and their weights."""

    def __init__(self, slots: np.ndarray, weights: np.ndarray):
        self.slots, self.weights = slots.astype(np.int32), weights.astype(np.float32)

    def score(self, texts: list[str]) -> np.ndarray:
        """The probability of each text: the bias alone for a text without words."""
        table = np.zeros(SLOTS, dtype=np.float32)
        table[self.slots] = self.weights
        some, held = table != 0, [np.arange(len(texts)) * SLOTS]
        for of, slot in features(texts):
            hit = np.flatnonzero(some[slot])
            held.append(of[hit] * SLOTS + slot[hit])
        keys = np.unique(np.concatenate(held))
        sums = np.bincount(keys // SLOTS, weights=table[keys % SLOTS].astype(np.float64), minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(sums, -50, 50)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Weights for `label` (0 or 1) from texts that are not held out; None if either class has no row.

    Shards are fixed by the hash of doc_id and read in that order, so a lost executor changes
    nothing; a round's states are averaged on the driver (slots handed on only).
    """
    spark = docs.sparkSession
    order = F.xxhash64("doc_id")
    rows = sample(docs, labels, label, sample_rows).withColumn("shard", F.pmod(order, F.lit(SHARDS)).cast("int"))
    rows = cut(rows.repartition(SHARDS, "shard"), "toxic")
    if rows.select("y").distinct().count() < 2:
        return None
    taken, z, n = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.float32), np.zeros(0, dtype=np.float32)
    for _ in range(ROUNDS):
        before = spark.sparkContext.broadcast((taken, z, n))

        def learn(group: pd.DataFrame) -> pd.DataFrame:
            state, seen = State(), np.zeros(SLOTS, dtype=np.uint8)
            at, state.z[at], state.n[at] = before.value
            seen[at] = LEAST_SEEN
            group = group.sort_values(["o", "doc_id"])
            texts, labelled = group.text.tolist(), group.y.tolist()
            for a, b in pieces(texts):
                for slots, y in zip(rows_of(texts[a:b]), labelled[a:b], strict=True):
                    seen[slots] += seen[slots] < LEAST_SEEN
                    state.learn(slots[seen[slots] >= LEAST_SEEN], y)
            some = np.flatnonzero(np.abs(state.z) >= LEAST_Z)
            return pd.DataFrame({"at": [some.astype(np.int32).tobytes()], "z": [state.z[some].tobytes()], "n": [state.n[some].tobytes()]})

        shards = rows.withColumn("o", order).groupBy("shard").applyInPandas(learn, "at binary, z binary, n binary").collect()  # one row a shard
        taken, back = np.unique(np.concatenate([np.frombuffer(r["at"], dtype=np.int32) for r in shards]), return_inverse=True)
        z, n = ((np.bincount(back, np.concatenate([np.frombuffer(r[c], dtype=np.float32) for r in shards])) / len(shards)).astype(np.float32) for c in ("z", "n"))
        before.unpersist()
    w = weights(taken, z, n)
    return Model(taken[w != 0], w[w != 0])


def score(docs: DataFrame, model: Model | None, least: float = LEAST) -> DataFrame:
    """doc_id, held_out, score, predicted for each row: null texts are scored as empty ones.

    Without a model (no labels of both classes) every score is 0. Repeated rows get a row
    each; an empty table gives none; texts of any length are scored whole.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, ids = pdf.text.fillna("").tolist(), pdf.doc_id.to_numpy()
            for a, b in pieces(texts):
                s = model.score(texts[a:b]) if model else np.zeros(b - a)
                yield pd.DataFrame({"doc_id": ids[a:b], "held_out": [i != NULL_ID and held_out(i) for i in ids[a:b].tolist()], "score": s, "predicted": (s >= least).astype(np.int32)})

    return null_ids(with_ids(docs.select("doc_id", "text")).mapInPandas(tidy(run), "doc_id long, held_out boolean, score double, predicted int"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
