"""SimHash near-duplicates by covering locality-sensitive hashing.

Radius r takes 2^(r+1) - 1 tables. Bit i of a fingerprint has a code phi(i) of r+1 bits;
table v keeps the bits whose code has odd parity with v. For any r bits some v is
orthogonal to all their codes, so two fingerprints that differ in at most r bits agree on
the kept bits of some table: no pair is missed.

The members of a bucket then link in the bucket's free bits without comparing all pairs:
each proposes itself and its neighbours by up to r // 2 flipped free bits as midpoints.
Two within radius 2 share a midpoint, and all that share one are within radius 2. A
midpoint has at most one member more than there are free bits, however many copies exist.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shingles
from .bpe import pieces
from .common import connected_components, cut, null_ids, only, table, tidy, with_ids

RADIUS = 2
SEED = 42


def covering_masks(bits: int = 64, radius: int = RADIUS) -> list[int]:
    """The kept bits of each table, as signed 64-bit integers. Codes are dealt in turn, so each table keeps about 4 bits of 7 for radius 2."""
    codes = (1 << (radius + 1)) - 1
    masks = []
    for v in range(1, codes + 1):
        mask = sum(1 << i for i in range(bits) if bin((1 + i % codes) & v).count("1") % 2)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """A uint64 for each shingle, repeats included: A-Z lowered, words between ASCII white space, `width` of them.

    Fewer words: the whole sequence is the one shingle; none: empty.
    """
    h = xxhash.xxh64_intdigest
    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    joined = b" ".join(words)
    if n <= width:
        return np.array([h(joined, SEED)] if n else [], dtype=np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(sizes + 1)
    starts = (ends - sizes - 1)[: n - width + 1].tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    return np.array([h(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], dtype=np.uint64)


def fingerprints_of(hashes: list[np.ndarray]) -> np.ndarray:
    """A uint64 for each list of hashes: bits that over half of them have; 0 for none. Counted some hashes at a time."""
    counts = np.array([len(x) for x in hashes], dtype=np.int64)
    values = np.concatenate(hashes) if counts.sum() else np.zeros(0, dtype=np.uint64)
    owner, ones = np.repeat(np.arange(len(hashes)), counts), np.zeros((len(hashes), 64), dtype=np.int64)
    for i in range(0, len(values), 1 << 16):
        of = owner[i : i + (1 << 16)]
        bits = np.unpackbits(values[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        ones[of[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > counts[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def fingerprint_texts(texts: list[str], width: int) -> np.ndarray:
    return fingerprints_of([shingle_hashes(x, width) for x in texts])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id (NULL_ID for null), fp (long): a row for each input row. Null texts are empty: 0. Other columns are not read.

    An empty table gives no rows; a text of any length is hashed whole, with its shingles in
    memory. doc_id must be a whole number or null.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, ids = pdf.text.fillna("").tolist(), pdf.doc_id.to_numpy()
            for a, b in pieces(texts, 1 << 19):
                yield pd.DataFrame({"doc_id": ids[a:b], "fp": fingerprint_texts(texts[a:b], width).view(np.int64)})

    return with_ids(docs.select("doc_id", "text")).mapInPandas(tidy(run), "doc_id long, fp long")


def links(distinct: DataFrame, masks: list[int] | None = None) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that connect all pairs within radius 2.

    Every link joins two within radius 2; those of a bucket that share a midpoint are joined
    to their smallest member. Buckets with one member are dropped by a count, pre-aggregated per
    task and joined back, so a bucket is never gathered.
    """
    masks = covering_masks() if masks is None else masks
    tables = F.explode(F.array(*[F.struct(F.lit(1 << i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)]))
    keyed = distinct.select("fp", tables.alias("b")).select("fp", "b.t", "b.key")
    shared = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1").select("t", "key")
    met = keyed.join(shared, ["t", "key"], "left_semi").select("fp", "t")
    flip = lambda i: F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63)))
    middles = None
    for t, m in enumerate(masks):  # in the free bits of the table, so a midpoint names its bucket too
        own = F.array(F.col("fp"), *[flip(i) for i in range(64) if not (m >> i) & 1])
        middles = F.when(F.col("t") == 1 << t, own) if middles is None else middles.when(F.col("t") == 1 << t, own)
    around = met.select("fp", "t", F.explode(middles).alias("middle")).groupBy("t", "middle").agg(F.collect_set("fp").alias("near")).where(F.size("near") > 1)
    low = F.array_min("near")
    return around.select(F.explode("near").alias("a"), low.alias("b")).where("a <> b").distinct()


def components(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable over links within radius 2.

    Equal fingerprints are one vertex (its smallest doc_id stands for it), so copies cost
    nothing beyond their own row. Repeated rows and null texts keep their rows; texts
    without words share fingerprint zero. A null doc_id is one id, smaller than all others.
    An empty table gives no rows.
    """
    fps = cut(fingerprints(docs, width), "fingerprints")
    owners = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("owner")), "owners")
    found = connected_components(links(owners.select("fp")))
    by_fp = owners.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    root = by_fp.groupBy("root").agg(F.min("owner").alias("component_id"))
    named = by_fp.join(root, "root").select("fp", "component_id")
    out = fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
    return null_ids(out, "doc_id", "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"))


def dedup(docs: DataFrame, width: int = 3) -> DataFrame:
    """Rows of docs, all columns, whose doc_id is its component's smallest (within radius 2); a repeated doc_id keeps all its rows."""
    return only(docs, with_ids(components(docs, width).where("doc_id <=> component_id").select("doc_id").distinct()))


def dedup_similar(docs: DataFrame, width: int = shingles.WIDTH) -> DataFrame:
    """Rows of docs, all columns, whose doc_id is the smallest of its group: documents linked by shingle sets of likeness 0.8 and more.

    64 bits can't tell 0.8 (pairs of it differ in 4 to 14 bits), so the covering tables bring
    the nearest pairs together, prefixes of the shingle sets the others, and every link is
    checked on whole sets: no link is lost, none below 0.8 is made. Texts of equal sets are
    one; those without words too. A repeated doc_id keeps all its rows. A null doc_id is one
    id, smaller than all others; null texts are empty. An empty table gives no rows.
    """

    def read(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
        hashes = [shingle_hashes(x, width) for x in texts]
        return [np.unique(x.view(np.int64)) for x in hashes], fingerprints_of(hashes).view(np.int64)

    def near(nodes: DataFrame) -> DataFrame:
        """(a, b): nodes of one fingerprint with the smallest of them, and those of linked fingerprints."""
        of = cut(nodes.groupBy("fp").agg(F.min("node").alias("b")), "fingerprints")
        same = nodes.join(of, "fp").select(F.col("node").alias("a"), "b").where("a <> b")
        pairs = links(of.select("fp")).join(of.select(F.col("fp").alias("a"), F.col("b").alias("x")), "a").join(of.select(F.col("fp").alias("b"), F.col("b").alias("y")), "b")
        return same.unionByName(pairs.select(F.col("x").alias("a"), F.col("y").alias("b")))

    return only(docs, shingles.kept(docs, read, near))
