"""Suffix-array dedup: bytes that a document shares with one of smaller id, 50 or more at a time.

All windows of n bytes are compared, in four passes over tables of text chunks:

1. Each window is named by its smallest m-gram hash. Consecutive windows of one name form a
   run. Chunks send the names they hold; names met by one document only are done.
2. The runs of shared names, once for each text and chunk, go to the buckets of their names,
   so equal windows meet. Runs of one name with different texts are concatenated; their
   suffix array to depth n gives a Burrows-Wheeler transform, on which intervals are
   extended backwards, breadth first: round l finds all places whose common prefix with the
   place before is l bytes. After round n - 1 what is left undivided shares n bytes or more.
   Each window's smallest doc_id goes back to the chunks.
3. Each chunk marks the windows that a smaller id has, and cuts the bytes they cover.

A bucket or chunk holds a bounded share of the corpus, whatever is common in it: a passage
of every document is one run a chunk. A name that very many chunks hold, say of a phrase
that many texts go on from in their own ways, would bring all its runs together; its
windows are named one by one instead, by all their n bytes, so that only equal ones meet.
Texts are never cut short; a text larger than a chunk is a chunk of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Carried, cut, null_ids, release, table, tidy, tidy_group, with_ids

MIN_BYTES = 50
#: Bytes of text in a chunk, of text for each bucket, and of runs in one suffix array.
CHUNK, BUCKET, ARRAY = 3 << 19, 16 << 20, 1 << 19
#: Chunks that may hold a name before its windows are named one by one.
HOT = 1000
CHUNKS = "g long, ids binary, lens binary, body binary, meta binary"
FAR = np.iinfo(np.int64).max


def _zip(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def _unzip(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return x


def chunks(rows: DataFrame) -> DataFrame:
    """Texts as UTF-8 in chunks, written once, so that every pass sees the same ones; rows: doc_id, text, columns to hand on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count, held, slices, size = TaskContext.get().partitionId(), 0, [], [], 0

        def row() -> pa.RecordBatch:
            ids = np.array([x[0] for x in held], dtype=np.int64)
            lens = np.array([len(x[1]) for x in held], dtype=np.int64)
            return pa.RecordBatch.from_pydict({"g": [(part << 32) + count], "ids": [ids.tobytes()], "lens": [lens.tobytes()], "body": [_zip(b"".join(x[1] for x in held))], "meta": [Carried.pack(slices)]})

        for batch in batches:
            first = 0
            for at, (i, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                body = (text or "").encode("utf-8", "surrogatepass")
                if held and size + len(body) > CHUNK:
                    slices.append(batch.slice(first, at - first))
                    yield row()
                    count, held, slices, size, first = count + 1, [], [], 0, at
                held.append((i, body))
                size += len(body)
            slices.append(batch.slice(first))
        if held:
            yield row()

    return cut(rows.mapInArrow(tidy(run), CHUNKS), "chunks")


class Runs:
    """A chunk's runs: start (byte), count (windows), name (48 bits), doc (row in the chunk)."""

    def __init__(self, ids: bytes, lens: bytes, body: bytes, n: int):
        self.ids, self.lens = np.frombuffer(ids, dtype=np.int64), np.frombuffer(lens, dtype=np.int64)
        self.data, self.n = _unzip(body), n
        size, m = len(self.data), max(4, n // 2 - 1)
        self.ends = np.cumsum(self.lens)
        if size < n:  # no window: no runs
            self.start = self.count = self.doc = self.of = np.zeros(0, dtype=np.int64)
            self.buf, self.name = self.data + b"\0" * 64, np.zeros(0, dtype=np.uint64)
            self.words, self.uniq = np.ndarray((size + 56,), dtype="<u8", buffer=self.buf, strides=(1,)), self.name
            return
        self.buf = self.data + b"\0" * 64
        self.words = np.ndarray((size + 56,), dtype="<u8", buffer=self.buf, strides=(1,))
        h = np.zeros(size, dtype=np.uint64)
        for o in [*range(0, max(1, m - 7), 8), *([m - 8] if m > 8 and m % 8 else [])]:
            x = self.words[o : o + size]
            h ^= x if m >= 8 else x & np.uint64((1 << 8 * m) - 1)
            h *= np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h >>= np.uint64(16)
        low, width, k = h, n - m + 1, 1
        while 2 * k <= width:
            np.minimum(low[: size - k], low[k:], out=low[: size - k])
            k *= 2
        if width > k:
            np.minimum(low[: size - (width - k)], low[width - k :], out=low[: size - (width - k)])
        inside = np.zeros(size + 1, dtype=np.int32)  # windows that don't cross documents
        has = self.lens >= n
        np.add.at(inside, (self.ends - self.lens)[has], 1)
        np.add.at(inside, (self.ends - n + 1)[has], -1)
        at = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
        names = low[at]
        first = np.flatnonzero(np.concatenate([[True], (names[1:] != names[:-1]) | (np.diff(at) > 1)])) if len(at) else at
        self.start, self.name = at[first], names[first]
        self.count = np.diff(np.append(first, len(at)))
        self.doc = np.searchsorted(self.ends, self.start, side="right")
        self.uniq, self.of = np.unique(self.name, return_inverse=True)

    def local(self) -> np.ndarray:
        """Of uniq: whether two ids of this chunk have the name."""
        low, high = np.full(len(self.uniq), FAR), np.full(len(self.uniq), -FAR)
        np.minimum.at(low, self.of, self.ids[self.doc])
        np.maximum.at(high, self.of, self.ids[self.doc])
        return low < high

    def whole(self, at: np.ndarray) -> np.ndarray:
        """Names of single windows, by all their bytes."""
        h = np.full(len(at), 0x51ED270B, dtype=np.uint64)
        for o in [*range(0, self.n - 7, 8), self.n - 8]:
            h = _mix(h ^ self.words[at + o])
        return _mix(h) >> np.uint64(16)

    def by_bucket(self, buckets: int) -> list[tuple[int, np.ndarray]]:
        """(bucket, rows of uniq in it, ascending)."""
        at = (self.uniq % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        which, first = np.unique(at[order], return_index=True)
        return list(zip(which.tolist(), np.split(order, first[1:]), strict=True)) if len(order) else []

    def shared(self, buckets: int, replies: list) -> None:
        """Keep the runs of shared names, and find which have the same text: entry of each run, and each entry's first run."""
        known, answer = self.local(), {r: mask for r, mask in replies}
        hot = np.zeros(len(known), dtype=bool)
        for r, rows in self.by_bucket(buckets):
            if r in answer:
                bits = np.unpackbits(np.frombuffer(answer[r], dtype=np.uint8), count=2 * len(rows)).astype(bool)
                known[rows] |= bits[: len(rows)]
                hot[rows] = bits[len(rows) :]
        keep = np.flatnonzero(known[self.of])
        hot = hot[self.of[keep]]
        self.start, self.count, self.name, self.doc = self.start[keep], self.count[keep], self.name[keep], self.doc[keep]
        if hot.any():
            alone = gather(self.start[hot], self.count[hot])
            self.doc = np.concatenate([self.doc[~hot], np.repeat(self.doc[hot], self.count[hot])])
            self.name = np.concatenate([self.name[~hot], self.whole(alone)])
            self.start = np.concatenate([self.start[~hot], alone])
            self.count = np.concatenate([self.count[~hot], np.ones(len(alone), dtype=np.int64)])
        self.size = self.count + self.n - 1
        self.entry, self.rep = same_texts(self.buf, self.words, self.start, self.size, self.name)
        self.low = np.full(len(self.rep), FAR)
        np.minimum.at(self.low, self.entry, self.ids[self.doc])
        at = (self.name[self.rep] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        which, first = np.unique(at[order], return_index=True)
        self.entries = list(zip(which.tolist(), np.split(order, first[1:]), strict=True)) if len(order) else []


def gather(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of all bytes of the given stretches, in order."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


def same_texts(buf: bytes, words: np.ndarray, start: np.ndarray, size: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which stretches are equal: (class of each, first member of each class). Hashes only sort; bytes decide."""
    h = size.astype(np.uint64)
    for o in (0, 8, 16, 24, 32, 40):
        h = _mix(h ^ words[start + np.minimum(o, size - 8)])
    h = _mix(h ^ words[start + size - 8])
    order = np.lexsort((start, h, name))
    a, b = order[1:], order[:-1]
    like = (name[a] == name[b]) & (h[a] == h[b]) & (size[a] == size[b])
    pairs, data = np.flatnonzero(like), np.frombuffer(buf, dtype=np.uint8)
    for i in range(0, len(pairs), 8192):
        p = pairs[i : i + 8192]
        x, y, s = start[a[p]], start[b[p]], size[a[p]]
        equal = data[gather(x, s)] == data[gather(y, s)]
        like[p] = np.logical_and.reduceat(equal, np.cumsum(s) - s)
    fresh = np.concatenate([[True], ~like]) if len(order) else np.zeros(0, bool)
    entry = np.zeros(len(order), dtype=np.int64)
    entry[order] = np.cumsum(fresh) - 1
    return entry, order[fresh]


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Rotations of text in the order of their first `depth` bytes, by doubling ranks."""
    rank, k = text.astype(np.int64), 1
    while k * 2 <= min(depth, 4):
        rank = (rank << (8 * k)) | np.roll(rank, -k)
        k *= 2
    order = None
    while True:
        order = np.argsort(rank)
        if k >= depth:
            return order
        value = rank[order]
        dense = np.empty(len(text), dtype=np.int64)
        dense[order] = np.cumsum(np.concatenate([[0], value[1:] != value[:-1]]))
        step = min(k, depth - k)
        rank = dense * len(text) + np.roll(dense, -step)
        k += step


def divided(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Of each place in the order: whether its common prefix with the place before is shorter than `depth`.

    Round l takes the intervals of l-byte strings found last, extends each backwards by
    every byte before it, and marks the ends not marked yet: there the common prefix is l.
    """
    n = len(text)
    last = text[order - 1]
    by_byte = np.argsort(last, kind="stable")
    step = np.empty(n, dtype=np.int32)  # LF
    step[by_byte] = np.arange(n, dtype=np.int32)
    again = np.full(n, n, dtype=np.int32)  # the next place with the same byte before it
    same = last[by_byte[1:]] == last[by_byte[:-1]]
    again[by_byte[:-1][same]] = by_byte[1:][same]
    mark = np.zeros(n + 1, dtype=bool)
    mark[0] = mark[n] = True
    left, right = np.zeros(1, dtype=np.int64), np.full(1, n, dtype=np.int64)
    for _ in range(depth):
        width = right - left
        at = gather(left, width)
        ends = at[again[at] >= np.repeat(right, width)]  # the last of each byte in each interval
        cuts = step[ends].astype(np.int64) + 1
        cuts = np.unique(cuts[~mark[cuts]])
        if not len(cuts):
            break
        mark[cuts] = True
        marks = np.flatnonzero(mark)
        right = cuts
        left = marks[np.searchsorted(marks, cuts) - 1]
    return mark[:n]


def smallest_ids(texts: list[bytes] | np.ndarray, start: np.ndarray, size: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """For each window of each stretch, in order: the smallest doc that has its n bytes in any of the stretches."""
    data = np.frombuffer(texts, dtype=np.uint8)
    joined = np.zeros(int(size.sum() + len(size)), dtype=np.uint8)  # 0 stands between; UTF-8 has no byte 255
    at = np.cumsum(size + 1) - size - 1
    joined[gather(at, size)] = data[gather(start, size)] + 1
    order = suffix_order(joined, n)
    mark = divided(joined, order, n)
    windows = gather(at, size - n + 1)
    value = np.full(len(joined), FAR)
    value[windows] = np.repeat(doc, size - n + 1)
    firsts = np.flatnonzero(mark)
    low = np.minimum.reduceat(value[order], firsts)
    out = np.empty(len(joined), dtype=np.int64)
    out[order] = np.repeat(low, np.diff(np.append(firsts, len(joined))))
    return out[windows]


def answer_names(pdf: pd.DataFrame, crowd: int) -> pd.DataFrame:
    """Of one bucket: for each chunk, which of its names another chunk has too, and which of them very many have."""
    sizes = np.array([len(b) // 6 for b in pdf.names], dtype=np.int64)
    raw = np.frombuffer(b"".join(pdf.names), dtype=np.uint8).reshape(-1, 6)
    names = np.zeros((len(raw), 8), dtype=np.uint8)
    names[:, :6] = raw
    names = names.view("<u8").ravel()
    order = np.argsort(names, kind="stable")
    same = names[order[1:]] == names[order[:-1]]
    shared = np.zeros(len(names), dtype=bool)
    shared[order[1:][same]] = shared[order[:-1][same]] = True
    firsts = np.flatnonzero(np.concatenate([[True], ~same]))
    holders = np.diff(np.append(firsts, len(names)))
    hot = np.zeros(len(names), dtype=bool)
    hot[order] = np.repeat(holders >= crowd, holders)
    cuts = np.cumsum(sizes)[:-1]
    masks = [np.packbits(np.concatenate([a, b])).tobytes() for a, b in zip(np.split(shared, cuts), np.split(hot, cuts), strict=True)]
    return pd.DataFrame({"g": pdf.g, "r": pdf.r, "answer": masks})


def pack_entries(runs: Runs, rows: np.ndarray) -> bytes:
    rep = runs.rep[rows]
    data = np.frombuffer(runs.buf, dtype=np.uint8)[gather(runs.start[rep], runs.size[rep])]
    head = np.stack([runs.name[rep].astype(np.int64), runs.size[rep], runs.low[rows]])
    return _zip(np.int64(len(rows)).tobytes() + head.tobytes() + data.tobytes())


def answer_entries(pdf: pd.DataFrame, n: int, most: int) -> pd.DataFrame:
    """Of one bucket: for each chunk's entries the smallest doc_id of each window, as stretches of equal ones."""
    heads, bodies = [], []
    for blob in pdf.entries:
        raw = _unzip(blob)
        k = int(np.frombuffer(raw, dtype=np.int64, count=1)[0])
        heads.append(np.frombuffer(raw, dtype=np.int64, count=3 * k, offset=8).reshape(3, k))
        bodies.append(raw[8 + 24 * k :])
    name, size, low = np.concatenate(heads, axis=1)
    body = b"".join(bodies)
    start, buf = np.cumsum(size) - size, body + b"\0" * 64
    words = np.ndarray((len(body) + 56,), dtype="<u8", buffer=buf, strides=(1,))
    entry, rep = same_texts(buf, words, start, size, name.astype(np.uint64))
    least = np.full(len(rep), FAR)
    np.minimum.at(least, entry, low)
    # classes come sorted by name; a name with one text needs no array
    names, text_size = name[rep], size[rep]
    bounds = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1], [True]]))
    many = np.repeat(np.diff(bounds) > 1, np.diff(bounds))
    windows = text_size - n + 1
    place = np.cumsum(windows) - windows
    value = np.repeat(least, windows)
    firsts = bounds[:-1][np.diff(bounds) > 1]
    stops = bounds[1:][np.diff(bounds) > 1]
    load = np.cumsum(np.where(many, text_size + 1, 0))
    i = 0
    while i < len(firsts):  # names are independent: some at a time in one array
        j = max(i + 1, int(np.searchsorted(load[stops - 1], (load[firsts[i] - 1] if firsts[i] else 0) + most, side="right")))
        rows = np.concatenate([np.arange(a, b) for a, b in zip(firsts[i:j], stops[i:j], strict=True)])
        value[gather(place[rows], windows[rows])] = smallest_ids(buf, start[rep[rows]], text_size[rows], least[rows], n)
        i = j
    cutat = np.zeros(len(value) + 1, dtype=bool)
    cutat[place], cutat[-1] = True, True
    cutat[1:-1] |= value[1:] != value[:-1]
    seg = np.flatnonzero(cutat)
    seg_low, seg_len = value[seg[:-1]], np.diff(seg)
    seg_from = np.searchsorted(seg, place)
    seg_many = np.diff(np.append(seg_from, len(seg) - 1))
    out, done = [], 0
    for h in heads:
        e = entry[done : done + h.shape[1]]
        done += h.shape[1]
        at = gather(seg_from[e], seg_many[e])
        out.append(_zip(np.int64(len(e)).tobytes() + seg_many[e].tobytes() + seg_len[at].tobytes() + seg_low[at].tobytes()))
    return pd.DataFrame({"g": pdf.g, "r": pdf.r, "answer": out})


def covered(runs: Runs, answers: list) -> np.ndarray:
    """Of each byte of the chunk: whether a window that a smaller id has covers it."""
    size, got = len(runs.data), {r: _unzip(a) for r, a in answers}
    change = np.zeros(size + 1, dtype=np.int64)
    where = np.zeros(len(runs.rep), dtype=np.int64)
    many = np.zeros(len(runs.rep), dtype=np.int64)
    lens, lows, done = [], [], 0
    for r, rows in runs.entries:
        raw = np.frombuffer(got[r], dtype=np.int64)
        k = int(raw[0])
        per = raw[1 : 1 + k]
        total = int(per.sum())
        where[rows], many[rows] = done + np.cumsum(per) - per, per
        lens.append(raw[1 + k : 1 + k + total])
        lows.append(raw[1 + k + total : 1 + k + 2 * total])
        done += total
    if lens:
        seg_len, seg_low = np.concatenate(lens), np.concatenate(lows)
        per = many[runs.entry]
        at = gather(where[runs.entry], per)
        length, low = seg_len[at], seg_low[at]
        run = np.repeat(np.arange(len(per)), per)
        before = np.cumsum(length) - length
        begin = runs.start[run] + before - np.repeat(before[np.cumsum(per) - per], per)
        hit = low < runs.ids[runs.doc[run]]
        change += np.bincount(begin[hit], minlength=size + 1)
        change -= np.bincount(begin[hit] + length[hit] - 1 + runs.n, minlength=size + 1)
    return np.cumsum(change[:-1]) > 0


def removed(docs: DataFrame, n: int = MIN_BYTES) -> DataFrame:
    """A row for each row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256. Other columns are not read.

    A byte goes if a string of n bytes that covers it also starts in a document of smaller
    doc_id; strings are taken from the input. Rows of one doc_id don't remove each other's
    bytes. Null texts are empty; texts under n bytes stay whole. A null doc_id is one id,
    smaller than all others. A text of any length is one row of one chunk. An empty table
    gives no rows.
    """

    def show(x, ids: np.ndarray, lens: np.ndarray, gone: np.ndarray, spans: np.ndarray, kept: list[bytes]) -> pd.DataFrame:
        return pd.DataFrame({"doc_id": ids, "n_bytes": lens, "n_removed": gone, "n_spans": spans, "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in judged(batches, n):
            yield pa.RecordBatch.from_pandas(show(*x), preserve_index=False)

    rows = with_ids(docs.select("doc_id", "text"))
    return null_ids(marked(rows, n).mapInArrow(tidy(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))


def dedup(docs: DataFrame, n: int = MIN_BYTES) -> DataFrame:
    """docs with the repeated bytes cut from text; n_chars, where there is one, follows the text. All rows and columns stay.

    The bytes of a character that was cut apart go too. Null texts become empty ones.
    """
    carried = Carried(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, ids, _, _, _, kept in judged(batches, n):
            yield Carried.unpack(ids.tolist(), [k.decode("utf-8", "ignore") for k in kept], x["meta"])

    return carried.whole(marked(carried.rows, n).mapInArrow(tidy(run), carried.schema))


def marked(rows: DataFrame, n: int) -> DataFrame:
    """Chunks (g, ids, lens, body, and meta if rows have other columns) with the answers of both passes: answers (names) and found (entries)."""
    if n < 10:
        raise ValueError("n must be 10 at least")
    store = chunks(rows)
    total = store.agg(F.sum(F.length("body")), F.count("*")).first()
    buckets, crowd, array = max(1, -(-3 * int(total[0] or 0) // BUCKET)), HOT, ARRAY

    def send_names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for x in pdf.itertuples(index=False):
                runs = Runs(x.ids, x.lens, x.body, n)
                rows = [(r, x.g, runs.uniq[at].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()) for r, at in runs.by_bucket(buckets)]
                if rows:
                    yield pd.DataFrame(rows, columns=["r", "g", "names"])

    names = store.select("g", "ids", "lens", "body").mapInPandas(tidy(send_names), "r int, g long, names binary")
    shared = names.groupBy("r").applyInPandas(tidy_group(lambda pdf: answer_names(pdf, crowd)), "g long, r int, answer binary")

    def joined(answers: DataFrame) -> DataFrame:
        per = answers.groupBy("g").agg(F.collect_list(F.struct("r", "answer")).alias("answers"))
        return store.join(per, "g", "left")

    def send_entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for x in pdf.itertuples(index=False):
                runs = Runs(x.ids, x.lens, x.body, n)
                runs.shared(buckets, got(x.answers))
                rows = [(r, x.g, pack_entries(runs, at)) for r, at in runs.entries]
                if rows:
                    yield pd.DataFrame(rows, columns=["r", "g", "entries"])

    masks = cut(shared, "names")
    entries = joined(masks).select("g", "ids", "lens", "body", "answers").mapInPandas(tidy(send_entries), "r int, g long, entries binary")
    found = entries.groupBy("r").applyInPandas(tidy_group(lambda pdf: answer_entries(pdf, n, array)), "g long, r int, answer binary")
    both = masks.withColumn("kind", F.lit(0)).unionByName(found.withColumn("kind", F.lit(1)))
    last = both.groupBy("g").agg(*[F.collect_list(F.when(F.col("kind") == k, F.struct("r", "answer"))).alias(name) for k, name in enumerate(("answers", "found"))])

    held = store if len(rows.columns) > 2 else store.drop("meta")  # the same columns as above, so that their shuffle is used again
    return held.join(last, "g", "left").withColumn("buckets", F.lit(buckets))


def got(answers) -> list:
    return [] if answers is None else [(a["r"], a["answer"]) for a in answers]


def judged(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple]:
    """(chunk, ids, n_bytes, n_removed, n_spans, kept bytes) of each chunk of marked()."""
    for batch in batches:
        for x in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
            runs = Runs(x["ids"], x["lens"], x["body"], n)
            runs.shared(x["buckets"], got(x["answers"]))
            gone = covered(runs, got(x["found"]))
            begins = runs.ends - runs.lens
            rise = gone.copy()
            rise[1:] &= ~gone[:-1]
            inner = begins[(runs.lens > 0) & (begins > 0)]
            rise[inner] = gone[inner]
            count = np.concatenate([[0], np.cumsum(gone)])
            spans = np.concatenate([[0], np.cumsum(rise)])
            left = np.frombuffer(runs.data, dtype=np.uint8)[~gone].tobytes()
            lo, hi = (begins - count[begins]).tolist(), (runs.ends - count[runs.ends]).tolist()
            yield x, runs.ids, runs.lens, count[runs.ends] - count[begins], spans[runs.ends] - spans[begins], [left[a:b] for a, b in zip(lo, hi, strict=True)]
            del x, runs, gone, rise, count, spans, left
            release()


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(table(spark, sf_dir, "documents"))
