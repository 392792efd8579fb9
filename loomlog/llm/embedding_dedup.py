"""Embedding near-duplicates by randomised-rotation binary codes with stored corrections.

A unit vector is rotated at random; the signs of its coordinates are its code, and the inner
product of code and vector is stored beside it. From a code and another vector rotated alike,
<code, other> / stored is an unbiased estimate of the cosine, off by at most a confidence
bound that the stored number gives as well. Only pairs whose bound reaches the threshold are
computed exactly, in double precision; only those links count.

Which pairs meet at all is decided by signs of further rotations, a wide code of 256 bits:
tables of a few of its bits each, as many that a pair at the threshold misses all of them
once in a thousand times. What a table moves of a vector is its id and its wide code; pairs
whose codes differ in too many bits to be at the threshold end there. Only vectors that
have a partner left are fetched, once for each bucket where a pair is new.

A crowded bucket is cut into blocks that meet two at a time, so a task holds two blocks at most.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounds, connected_components, cut, grouped, null_ids, sides, table, tidy, with_ids

THRESHOLD = 0.95
#: Rows that a bucket should have, rows of a block, bits of the wide code, chance to miss a pair at the threshold, width of the confidence bound.
BUCKET_ROWS, BLOCK, WIDE, MISS, EPSILON = 256, 1536, 256, 1e-3, 4.0
_rotations: dict[tuple[int, int], np.ndarray] = {}


def rotation(dim: int, number: int) -> np.ndarray:
    """A random orthogonal matrix, the same on every machine."""
    if (dim, number) not in _rotations:
        q, r = np.linalg.qr(np.random.Generator(np.random.PCG64([dim, number])).normal(size=(dim, dim)))
        _rotations[dim, number] = q * np.sign(np.diag(r))
    return _rotations[dim, number]


def differing(threshold: float) -> np.ndarray:
    """The chance of each number of wide-code bits in which a pair at the threshold differs."""
    p = math.acos(threshold) / math.pi
    log = [math.lgamma(WIDE + 1) - math.lgamma(h + 1) - math.lgamma(WIDE - h + 1) + h * math.log(p) + (WIDE - h) * math.log(1 - p) for h in range(WIDE + 1)]
    return np.exp(np.array(log))


def plan(n: int, threshold: float, miss: float = MISS) -> tuple[int, int, int]:
    """(bits of a table, tables, most differing bits) for n vectors. 32 bits serve 10^12 vectors; beyond, buckets grow and are cut into blocks."""
    chance = differing(threshold)
    bits = min(32, max(2, math.ceil(math.log2(max(1, n) / BUCKET_ROWS))))
    h = np.arange(WIDE - bits + 1)
    agree = np.zeros(WIDE + 1)  # that a table's bits are all among the equal ones
    agree[: len(h)] = [math.exp(math.lgamma(WIDE - x + 1) - math.lgamma(WIDE - x - bits + 1) - math.lgamma(WIDE + 1) + math.lgamma(WIDE - bits + 1)) for x in h]
    tables = 1
    while (chance * (1 - agree) ** tables).sum() > miss:
        tables += 1
    most = int(np.searchsorted(np.cumsum(chance), 1 - miss / 10))
    return bits, tables, most


def places(bits: int, tables: int) -> np.ndarray:
    """Which bits of the wide code make each table's key, the same on every machine."""
    rng = np.random.Generator(np.random.PCG64([bits, 99]))
    return np.stack([rng.permutation(WIDE)[:bits] for _ in range(tables)])


def wide_codes(unit: np.ndarray) -> np.ndarray:
    """Signs of as many further rotations as that takes (rotation 0 is the code's), packed: WIDE / 8 bytes each."""
    dim = unit.shape[1]
    return np.packbits(np.concatenate([unit @ rotation(dim, 1 + i).T > 0 for i in range(-(-WIDE // dim))], axis=1)[:, :WIDE], axis=1)


def table_keys(wide: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The key of each vector in each table of places `at`."""
    bits = np.unpackbits(wide, axis=1)
    out = np.zeros((len(wide), len(at)), dtype=np.int64)
    for i in range(at.shape[1]):
        out |= bits[:, at[:, i]].astype(np.int64) << i
    return out


def codes(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs of the rotated vectors, and the stored inner products of code and vector."""
    turned = unit @ rotation(unit.shape[1], 0).T
    return np.packbits(turned > 0, axis=1), (np.abs(turned).sum(axis=1) / math.sqrt(unit.shape[1])).astype(np.float32)


def candidates(code: np.ndarray, stored: np.ndarray, left: slice, right: slice, turned: np.ndarray, threshold: float, epsilon: float = EPSILON) -> np.ndarray:
    """Which pairs (left x right) may reach the threshold, by either vector's code."""
    dim = turned.shape[1]
    signs = (np.unpackbits(code, axis=1, count=dim).astype(np.float32) * 2 - 1) / np.float32(math.sqrt(dim))
    error = epsilon * np.sqrt(np.maximum(1 - stored**2, 0)) / stored / math.sqrt(max(1, dim - 1))
    least = (threshold - error) * stored
    by_left = signs[left] @ turned[right].T >= least[left][:, None]
    return by_left | ((signs[right] @ turned[left].T).T >= least[right][None, :])


def smallest_linked(n: int, a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each of n rows the smallest id of its component under the links a-b."""
    low = ids.copy()
    while True:
        before = low.copy()
        np.minimum.at(low, a, before[b])
        np.minimum.at(low, b, low[a])
        if (low == before).all():
            return low


def near_codes(wide: np.ndarray, left: slice, right: slice, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (left x right, each once) whose wide codes differ in `most` bits at most."""
    words, shift = wide.view("<u8"), right.start
    a, b = [], []
    for i in range(left.start, left.stop, 256):
        j = min(i + 256, left.stop)
        lo = max(right.start, i + 1)  # within one block only pairs with a later row
        count = np.bitwise_count(words[i:j, None, :] ^ words[None, lo : right.stop, :]).sum(axis=2, dtype=np.uint16)
        x, y = np.nonzero(count <= most)
        x, y = x + i, y + lo
        ok = y > x if shift < j else slice(None)
        a.append(x[ok])
        b.append(y[ok])
    return np.concatenate(a), np.concatenate(b)


def fresh_pairs(a: np.ndarray, b: np.ndarray, wide: np.ndarray, t: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that no table before t brings together."""
    if t and len(a):
        rows = np.unique(np.concatenate([a, b]))
        keys = table_keys(wide[rows], at[:t])
        x, y = np.searchsorted(rows, a), np.searchsorted(rows, b)
        for u in range(t):
            new = keys[x, u] != keys[y, u]
            a, b, x, y = a[new], b[new], x[new], y[new]
    return a, b


def links_of_group(ids: np.ndarray, copies: np.ndarray, raw: np.ndarray, code: np.ndarray, stored: np.ndarray, wide: np.ndarray, t: int, at: np.ndarray, most: int, block: np.ndarray, threshold: float) -> tuple | None:
    """(row, links that no earlier table has, smallest id linked) of one bucket or pair of blocks."""
    n = len(ids)
    left, right = sides(block)
    norm = np.sqrt(np.einsum("ij,ij->i", raw, raw))
    turned = (raw / norm[:, None] @ rotation(raw.shape[1], 0).T).astype(np.float32)
    a, b = near_codes(wide, left, right, most)
    may = candidates(code, stored, left, right, turned, threshold)[a - left.start, b - right.start]
    a, b = fresh_pairs(a[may], b[may], wide, t, at)
    ok = np.zeros(len(a), dtype=bool)
    for i in range(0, len(a), 1 << 16):
        x, y = a[i : i + (1 << 16)], b[i : i + (1 << 16)]
        ok[i : i + (1 << 16)] = np.einsum("ij,ij->i", raw[x], raw[y]) / (norm[x] * norm[y]) >= threshold
    a, b = a[ok], b[ok]
    if not len(a):
        return None
    count = np.bincount(a, weights=copies[b], minlength=n) + np.bincount(b, weights=copies[a], minlength=n)
    low = smallest_linked(n, a, b, ids)
    rows = np.unique(np.concatenate([a, b]))
    return ids[rows], count[rows].astype(np.int64), low[rows]


GROUP = ["dim", "k", "p", "q"]


def blob(column: pd.Series, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.uint8).reshape(len(column), width)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of (vec_id, embedding).

    Null, empty and zero vectors, and those with null or non-finite components, link with
    nothing and are their own component. Vectors of different length don't meet. Equal
    vectors are one for the search and count as links of each other. kept: the row's vec_id
    is its component's smallest. No links below the threshold are given; a pair at it is
    missed with a chance of about MISS. A null vec_id is one id, smaller than all others.
    An empty table gives no rows. Other columns are not read.
    """
    kind = "<f4" if dict(vectors.dtypes)["embedding"] == "array<float>" else "<f8"
    size = int(kind[-1])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            dims = np.array([0 if v is None else len(v) for v in pdf.v])
            body: list[bytes | None] = [None] * len(pdf)
            for dim in np.unique(dims[dims > 0]):
                at = np.flatnonzero(dims == dim)
                raw = np.stack([np.asarray(pdf.v.iloc[i], dtype=np.float64) for i in at])  # null components become nan
                good = np.isfinite(raw).all(axis=1) & (raw != 0).any(axis=1)
                for i, x in zip(at[good].tolist(), (raw[good] + 0.0).astype(kind), strict=True):  # -0 + 0 is 0
                    body[i] = x.tobytes()
            yield pd.DataFrame({"vec_id": pdf.vec_id, "h": [None if b is None else hashlib.blake2b(b, digest_size=16).digest() for b in body], "v": body})

    rows = cut(with_ids(vectors.select("vec_id", F.col("embedding").alias("v")), "vec_id").mapInPandas(tidy(read), "vec_id long, h binary, v binary"), "vectors")
    distinct = rows.where("h is not null").groupBy("h").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.first("v").alias("v"))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            dims = pdf.v.map(len).to_numpy() // size
            for dim in np.unique(dims):
                part = pdf[dims == dim]
                raw = np.frombuffer(b"".join(part.v), dtype=kind).reshape(len(part), dim).astype(np.float64)
                unit = raw / np.sqrt(np.einsum("ij,ij->i", raw, raw))[:, None]
                code, stored = codes(unit)
                yield pd.DataFrame({"h": part.h, "first": part["first"], "copies": part.copies, "dim": dim, "v": part.v, "code": [x.tobytes() for x in code], "stored": stored, "wide": [x.tobytes() for x in wide_codes(unit)]})

    made = distinct.mapInPandas(tidy(encode), "h binary, first long, copies long, dim int, v binary, code binary, stored float, wide binary")
    coded = cut(made.withColumn("id", F.monotonically_increasing_id()), "codes")  # a number for each vector, as vec_ids may repeat
    bits, tables, most = plan(coded.count(), threshold)
    at, width, block = places(bits, tables), WIDE // 8, BLOCK

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys = table_keys(blob(pdf.wide, width), at)
            for t in range(tables):
                yield pd.DataFrame({"dim": pdf.dim, "k": (t << 32) + keys[:, t], "id": pdf.id, "wide": pdf.wide})

    def meet(batches: Iterator[pd.DataFrame], by: list[str], room: int) -> Iterator[pd.DataFrame]:
        """Rows that have a new partner near by their codes; those of crowded buckets all, with their codes."""
        for pdf, crowd in grouped(batches, by, room):
            if crowd:
                yield pdf.assign(crowd=True)
                continue
            keep, full = [], []
            for x, y in bounds(pdf, by):
                if y - x > room:
                    full.append(pdf.iloc[x:y])
                elif y - x > 1:
                    own = pdf.own.to_numpy()[x:y]
                    if pdf.p.iat[x] != pdf.q.iat[x] and own[0] == own[-1]:
                        continue
                    wide = blob(pdf.wide.iloc[x:y], width)
                    a, b = fresh_pairs(*near_codes(wide, *sides(own), most), wide, int(pdf.k.iat[x]) >> 32, at)
                    if len(a):
                        keep.append(np.unique(np.concatenate([a, b])) + x)
            if keep:
                yield pdf.iloc[np.concatenate(keep)].assign(wide=None, crowd=False)
            if full:
                yield pd.concat(full).assign(crowd=True)

    columns = "dim int, k long, p int, q int, own int, id long, wide binary, crowd boolean"
    dealt = coded.select("dim", "id", "wide").mapInPandas(tidy(deal), "dim int, k long, id long, wide binary")
    zero = [F.lit(0).alias(c) for c in ("p", "q", "own")]
    dealt = dealt.repartition("dim", "k").sortWithinPartitions("dim", "k", "id").select("dim", "k", *zero, "id", "wide")
    first = cut(dealt.mapInPandas(tidy(lambda x: meet(x, ["dim", "k"], block)), columns), "met")
    crowded = first.where("crowd")
    sized = crowded.groupBy("dim", "k").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dense = crowded.drop("own", "p", "q", "crowd").join(sized, ["dim", "k"]).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dense = dense.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("dim", "k", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "id", "wide")
    dense = dense.repartition(*GROUP).sortWithinPartitions(*GROUP, "own", "id")
    again = dense.mapInPandas(tidy(lambda x: meet(x, GROUP, 1 << 62)), columns)
    needed = first.where("NOT crowd").unionByName(again).select(*GROUP, "own", "id")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, _ in grouped(batches, GROUP, 1 << 62):
            out = []
            for x, y in bounds(pdf, GROUP):
                part = pdf.iloc[x:y]
                dim = int(part.dim.iat[0])
                raw = np.frombuffer(b"".join(part.v), dtype=kind).reshape(len(part), dim).astype(np.float64)
                found = links_of_group(part.id.to_numpy(), part.copies.to_numpy(), raw, blob(part.code, -(-dim // 8)), part.stored.to_numpy(), blob(part.wide, width), int(part.k.iat[0]) >> 32, at, most, part.own.to_numpy(), threshold)
                if found:
                    out.append(found)
            if out:
                yield pd.DataFrame({"id": np.concatenate([x[0] for x in out]), "n": np.concatenate([x[1] for x in out]), "low": np.concatenate([x[2] for x in out])})

    fetched = needed.join(coded.drop("h", "dim", "first"), "id").repartition(*GROUP).sortWithinPartitions(*GROUP, "own", "id")
    found = cut(fetched.mapInPandas(tidy(search), "id long, n long, low long"), "found")
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    parts = connected_components(found.select(F.col("id").alias("a"), F.col("low").alias("b")))
    named = coded.select("h", "id", "first", "copies").join(counts, "id", "left").join(parts.withColumnRenamed("node", "id"), "id", "left")
    named = named.select("h", "first", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "id").alias("root"))
    lowest = named.groupBy("root").agg(F.min("first").alias("component"))
    out = rows.select("vec_id", "h").join(named.join(lowest, "root").select("h", "n", "component"), "h", "left")
    component = F.coalesce("component", "vec_id")
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
    return null_ids(out, "vec_id", "component_id")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
