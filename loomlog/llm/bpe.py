"""Byte-level BPE encoding and decoding in numpy.

Words of the pattern are encoded once each: those not seen yet are put into padded
matrices by length, and in every round each row merges its leftmost pair of lowest rank.
Pairs are looked up in a hash table of 64-bit keys; merged rows are compacted. A row costs
its length times its merges, so words above a width leave the matrices: a heap of their
pairs gives the same merges in the same order in n log n.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import null_ids, table, tidy, with_ids

#: Words that one Python process remembers; the memory is emptied when it is full.
CACHE_WORDS = 400_000
#: Bytes up to which a word is a row of a matrix, and characters up to which it is remembered.
ROW_BYTES, CACHE_CHARS = 1024, 256
NONE = np.int64(1 << 60)


class ByteBPE:
    """ranks: bytes -> id, where a token's id is also its merge rank. pattern: splits a text into words."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern)
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        self.size = max(ranks.values()) + 1
        self.tokens = [b""] * self.size
        for token, i in ranks.items():
            self.tokens[i] = token
        lengths = np.array([len(x) for x in self.tokens], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(lengths)])
        self.lengths = lengths
        self.bytes = np.frombuffer(b"".join(self.tokens), dtype=np.uint8)
        keys, merged = [], []
        for token, i in ranks.items():  # every split of a token into two tokens may become it
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    keys.append(a * self.size + b)
                    merged.append(i)
        order = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
        self._table(np.array(keys, dtype=np.int64)[order], np.array(merged, dtype=np.int64)[order])
        self.cache: dict[str, np.ndarray] = {}
        self.pairs: dict[int, int] | None = None

    @classmethod
    def from_file(cls, path: str, pattern: str) -> ByteBPE:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}, pattern)

    def _table(self, keys: np.ndarray, ids: np.ndarray) -> None:
        """An open hash table of pair -> merged id, twice to four times as large as its entries."""
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slot_key = np.full(1 << bits, -1, dtype=np.int64)
        self.slot_id = np.full(1 << bits, NONE, dtype=np.int64)
        left, at = np.arange(len(keys)), self._hash(keys)
        while len(left):  # all that found a free slot settle, the others step on
            free = self.slot_key[at] == -1
            cand, pos = left[free], at[free]
            first = np.unique(pos, return_index=True)[1]
            self.slot_key[pos[first]], self.slot_id[pos[first]] = keys[cand[first]], ids[cand[first]]
            stay = self.slot_key[at] != keys[left]
            left, at = left[stay], (at[stay] + 1) & self.mask

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _lookup(self, keys: np.ndarray) -> np.ndarray:
        out, at = np.full(keys.shape, NONE, dtype=np.int64), self._hash(keys)
        left = np.arange(len(keys))
        while len(left):
            there = self.slot_key[at]
            hit = there == keys[left]
            out[left[hit]] = self.slot_id[at[hit]]
            go = ~hit & (there != -1)
            left, at = left[go], (at[go] + 1) & self.mask
        return out

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.full(a.shape, NONE, dtype=np.int64)
        real = (a >= 0) & (b >= 0)
        out[real] = self._lookup(a[real] * self.size + b[real])
        return out

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """ids of each word, of any length."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(words)
        lens = np.array([len(w) for w in words], dtype=np.int64)
        bucket = np.ceil(np.log2(np.maximum(lens, 1)) * 2).astype(np.int64)  # lengths within a factor of 1.4
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        for rows in np.split(order, cuts):
            for r in rows[lens[rows] > ROW_BYTES].tolist():
                out[r] = self._encode_long(words[r])
            rows = rows[lens[rows] <= ROW_BYTES]
            width = int(lens[rows].max()) if len(rows) else 0
            if width == 0:
                continue
            step = max(1, (1 << 21) // width)
            for i in range(0, len(rows), step):
                self._encode_matrix([words[r] for r in rows[i : i + step]], rows[i : i + step], width, out)
        return out

    def _encode_matrix(self, words: list[bytes], rows: np.ndarray, width: int, out: list[np.ndarray]) -> None:
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), dtype=np.uint8).reshape(len(words), width)
        ids = self.byte_ids[raw]
        n = np.array([len(w) for w in words])
        ids[np.arange(width)[None, :] >= n[:, None]] = -1
        rank = self._ranks(ids[:, :-1], ids[:, 1:])
        while len(rows):
            least = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(rows), np.int64)
            value = rank[np.arange(len(rows)), least] if rank.shape[1] else np.full(len(rows), NONE)
            go = value < NONE
            if not go.all():
                for r, x, k in zip(rows[~go], ids[~go], n[~go], strict=True):
                    out[r] = x[:k].copy()
                rows, ids, rank, n, least, value = rows[go], ids[go], rank[go], n[go], least[go], value[go]
                if not len(rows):
                    break
            at = np.arange(len(rows))
            keep = np.ones(ids.shape, dtype=bool)  # compaction: each row loses the right half of its pair
            ids[at, least] = value
            keep[at, least + 1] = False
            ids = ids[keep].reshape(len(rows), -1)
            n = n - 1
            if rank.shape[1] < 2:
                rank = rank[:, :0]
                continue
            drop = np.ones(rank.shape, dtype=bool)
            drop[at, least] = False
            rank = rank[drop].reshape(len(rows), -1)
            m = rank.shape[1]
            right = least < m  # the pairs left and right of the merged token are new
            r, c = at[right], least[right]
            rank[r, c] = self._ranks(ids[r, c], ids[r, c + 1])
            r, c = at[least > 0], least[least > 0] - 1
            rank[r, c] = self._ranks(ids[r, c], ids[r, c + 1])

    def _encode_long(self, word: bytes) -> np.ndarray:
        """As a row of a matrix: the leftmost pair of lowest rank merges first. Entries of the heap are rank * n + place; outdated ones are skipped."""
        if self.pairs is None:
            used = self.slot_key >= 0
            self.pairs = dict(zip(self.slot_key[used].tolist(), self.slot_id[used].tolist(), strict=True))
        get, size, n = self.pairs.get, self.size, len(word)
        start = self.byte_ids[np.frombuffer(word, dtype=np.uint8)]
        rank = self._ranks(start[:-1], start[1:])
        at = np.flatnonzero(rank < NONE)
        heap = (rank[at] * n + at).tolist()
        heapq.heapify(heap)
        ids, right, left = start.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            value, i = divmod(heapq.heappop(heap), n)
            j = right[i]
            if ids[i] < 0 or j >= n or get(ids[i] * size + ids[j]) != value:
                continue
            k, h = right[j], left[i]
            ids[i], ids[j], right[i] = value, -1, k
            if k < n:
                left[k] = i
                new = get(value * size + ids[k])
                if new is not None:
                    heapq.heappush(heap, new * n + i)
            if h >= 0:
                new = get(ids[h] * size + value)
                if new is not None:
                    heapq.heappush(heap, new * n + h)
        out = np.array(ids, dtype=np.int64)
        return out[out >= 0]

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.pattern.findall(t) for t in texts]
        words = {w for ws in split for w in ws}
        known = {w: self.cache[w] for w in words if w in self.cache}
        new = list(words.difference(known))
        for w, ids in zip(new, self.encode_words([w.encode("utf-8") for w in new]), strict=True):
            known[w] = ids.astype(np.int32)
        if len(self.cache) + len(new) > CACHE_WORDS:
            self.cache = {}
        self.cache.update((w, known[w]) for w in new if len(w) <= CACHE_CHARS)
        get = known.__getitem__
        return [np.concatenate(list(map(get, ws))) if ws else np.zeros(0, np.int32) for ws in split]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the tokens, gathered by offset; no ids: empty."""
        if not len(ids):
            return b""
        lens = self.lengths[ids]
        ends = np.cumsum(lens)
        at = np.arange(ends[-1]) + np.repeat(self.starts[ids] - (ends - lens), lens)
        return self.bytes[at].tobytes()


_loaded: dict[tuple[str, str], ByteBPE] = {}


def tokenizer(path: str, pattern: str) -> ByteBPE:
    """One per Python process."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = ByteBPE.from_file(path, pattern)
    return _loaded[path, pattern]


def pieces(texts: list[str], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` characters each, so that memory doesn't follow Arrow's batch size."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if len(texts):
        yield start, len(texts)


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def public_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, name: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """doc_id, ids array<int>: the ids of each whole text, no special tokens. Null and empty texts: no ids.

    path: the ranks file on every executor (its default is the public file `name` there).
    Repeated rows are encoded each; other columns are not read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = tokenizer(path or public_path(name), pattern or public_pattern())
        for pdf in batches:
            texts = pdf.text.fillna("").tolist()
            for a, b in pieces(texts):
                yield pd.DataFrame({"doc_id": pdf.doc_id.iloc[a:b], "ids": bpe.encode_batch(texts[a:b])})

    return null_ids(with_ids(docs.select("doc_id", "text")).mapInPandas(tidy(run), "doc_id long, ids array<int>"))


def decode(encoded: DataFrame, path: str | None = None, pattern: str | None = None, name: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """doc_id, bytes binary from doc_id, ids array<int>; null or empty ids: no bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = tokenizer(path or public_path(name), pattern or public_pattern())
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf.doc_id, "bytes": [bpe.decode(np.asarray([] if x is None else x, dtype=np.int64)) for x in pdf.ids]})

    return null_ids(with_ids(encoded.select("doc_id", "ids")).mapInPandas(tidy(run), "doc_id long, bytes binary"))


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None, name: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode and decode in one pass, so that no ids leave the worker.

    Null: as empty (0 tokens, digests of no bytes). One row for each input row.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = tokenizer(path or public_path(name), pattern or public_pattern())
        for pdf in batches:
            texts = pdf.text.fillna("").tolist()
            for a, b in pieces(texts):
                ids = bpe.encode_batch(texts[a:b])
                yield pd.DataFrame(
                    {
                        "doc_id": pdf.doc_id.iloc[a:b].to_numpy(),
                        "n_tokens": [len(x) for x in ids],
                        "ids_sha256": [hashlib.sha256(str(x.tolist())[1:-1].replace(" ", "").encode()).hexdigest() for x in ids],
                        "decoded_sha256": [hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids],
                    }
                )

    return null_ids(with_ids(docs.select("doc_id", "text")).mapInPandas(tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents").select(F.col("doc_id"), F.col("text")))
