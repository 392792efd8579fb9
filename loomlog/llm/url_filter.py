"""URL filters: Bloom filter cascades give exact membership of listed keys without joins.

A rule is a host and a path; it fits its host, all subdomains, and paths that start with
the rule's. A url is turned into the keys it could be listed under. Level 1 of a cascade
encodes the listed keys, level 2 those of the corpus's other keys that level 1 takes for
listed, level 3 the listed keys that level 2 takes for those, and so on until no key of
the corpus is misjudged. The universe is complete, so the answer is exact for each of its keys.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tidy

# The rules of the query, (action, host, path).
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; null or no ://: empty."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def keys_of(host: Column, path: Column, path_lengths: list[int]) -> Column:
    """Every (host suffix + path prefix) the url can be listed under, longest first.

    path_lengths: the lengths of the listed paths; other prefixes can't be listed.
    Keys are 'host' + 'path', where a path is empty or starts with '/', so no two rules share one.
    """
    parts = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))

    def with_prefix(n: int) -> Column:
        return F.transform(suffixes, lambda s: F.when(F.length(path) >= n, F.concat(s, F.substring(path, 1, n))))

    each = [with_prefix(n) for n in sorted(set(path_lengths), reverse=True)]
    keys = F.array_distinct(F.array_compact(F.concat(*each)))
    longest = lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0)
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_sort(keys, longest))


def hash_pair(key: str) -> tuple[int, int]:
    """As Spark's xxhash64(key) and xxhash64(key, 1 bigint), unsigned."""
    a = xxhash.xxh64_intdigest(key.encode("utf-8"), 42)
    return a, xxhash.xxh64_intdigest((1).to_bytes(8, "little"), a)


def hashes(keys: Column) -> tuple[Column, Column]:
    return F.transform(keys, lambda k: F.xxhash64(k)), F.transform(keys, lambda k: F.xxhash64(k, F.lit(1).cast("long")))


class Bloom:
    """Double hashing over a bit array; level salts the probes, so that levels err independently."""

    def __init__(self, h: np.ndarray, fpr: float, level: int):
        n = max(1, len(h))
        self.k = max(1, round(-math.log2(fpr)))
        self.m = np.uint64(max(64, math.ceil(n * -math.log(fpr) / math.log(2) ** 2)))
        self.level = np.uint64(level)
        self.bits = np.zeros(int(self.m), dtype=bool)
        for at in self._probes(h):
            self.bits[at] = True
        self.bits = np.packbits(self.bits, bitorder="little")

    def _probes(self, h: np.ndarray) -> Iterator[np.ndarray]:
        a = h[:, 0] ^ np.uint64(int(self.level) * 0x9E3779B97F4A7C15 % 2**64)
        a = (a ^ (a >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        b = h[:, 1] | np.uint64(1)
        for i in range(self.k):
            x = a + np.uint64(i) * b
            yield ((x ^ (x >> np.uint64(29))) % self.m).astype(np.int64)

    def __contains__(self, _):
        raise TypeError("use has()")

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), dtype=bool)
        for at in self._probes(h):
            out &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return out


class Cascade:
    """Levels of Bloom filters; member() is exact over the universe they were built on."""

    def __init__(self, listed: np.ndarray, false_positives: np.ndarray, first: Bloom):
        self.levels = [first]
        inside, outside = listed, false_positives
        while len(outside):
            self.levels.append(Bloom(outside, 0.5, len(self.levels) + 1))
            outside, inside = inside[self.levels[-1].has(inside)], outside
            if len(self.levels) > 200:
                raise RuntimeError("two keys share both hashes")

    def member(self, h: np.ndarray) -> np.ndarray:
        """The first level that doesn't hold a key decides: even levels encode what isn't listed."""
        out, left = np.zeros(len(h), dtype=bool), np.arange(len(h))
        for i, level in enumerate(self.levels):
            has = level.has(h[left])
            out[left[~has]] = i % 2 == 1
            left = left[has]
        out[left] = len(self.levels) % 2 == 1
        return out


def _flat(*columns: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    lens = columns[0].map(len).to_numpy(dtype=np.int64)
    return lens, np.stack([np.concatenate([np.asarray(x, dtype=np.int64) for x in c]) if lens.sum() else np.zeros(0, np.int64) for c in columns], axis=1).view(np.uint64)


def build(keyed: DataFrame, lists: list[list[str]]) -> list[Cascade]:
    """A cascade for each list of keys over the universe of keyed.keys (array<string>), all in two scans of it.

    The first level's error rate is set from the universe's size (an approximate count), so
    that its false positives, all that the driver gathers beside listed keys, number about 0.7
    for each listed key. Memory follows the lists, not the corpus; filters are broadcast.
    """
    spark = keyed.sparkSession
    hashed = [np.array([hash_pair(k) for k in listed], dtype=np.uint64).reshape(-1, 2) for listed in lists]
    size = keyed.select(F.explode("keys").alias("k")).agg(F.approx_count_distinct("k")).first()[0] if any(lists) else 0
    rate = lambda listed: min(0.5, max(1e-12, len(listed) / (math.sqrt(2) * max(1, size))))
    firsts = [Bloom(h, rate(listed), 1) for h, listed in zip(hashed, lists, strict=True)]
    if not any(lists):
        return [Cascade(h, h, first) for h, first in zip(hashed, firsts, strict=True)]
    shared = spark.sparkContext.broadcast([first if listed else None for first, listed in zip(firsts, lists, strict=True)])

    def passing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[tuple[int, str]] = set()
        for pdf in batches:
            _, hh = _flat(pdf.h1, pdf.h2)
            names = [k for ks in pdf["keys"] for k in ks]
            new = {(n, names[i]) for n, first in enumerate(shared.value) if first is not None for i in np.flatnonzero(first.has(hh))} - seen
            seen |= new
            if new:
                yield pd.DataFrame(sorted(new), columns=["n", "key"])

    h1, h2 = hashes(F.col("keys"))
    found = keyed.select("keys", h1.alias("h1"), h2.alias("h2")).mapInPandas(tidy(passing), "n int, key string").distinct().collect()
    out = []
    for n, (h, listed, first) in enumerate(zip(hashed, lists, firsts, strict=True)):
        wrong = {r.key for r in found if r.n == n}.difference(listed)
        out.append(Cascade(h, np.array(sorted(map(hash_pair, wrong)), dtype=np.uint64).reshape(-1, 2), first))
    return out


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict for each row.

    rules: (allow or block, host, path); the longest fitting rule (host and path together)
    decides. A url that no rule lists isn't in the block cascade: allow. Null urls and those
    without :// have no host, no path and no rule. Repeated rows are judged each; other columns
    are not read. An empty table gives no rows; a url of any length is one row.
    """
    rules = RULES if rules is None else rules
    lengths = [len(p) for _, _, p in rules] or [0]
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    keyed = urls.withColumn("keys", keys_of(F.col("host"), F.col("path"), lengths))
    allow, block = build(keyed, [sorted({h + p for a, h, p in rules if a == action}) for action in ("allow", "block")])

    @F.pandas_udf("int")
    def decide(h1: pd.Series, h2: pd.Series) -> pd.Series:
        """Place of the deciding key, from 1; negative: blocked; 0: none is listed."""
        lens, h = _flat(h1, h2)
        good, bad = allow.member(h), block.member(h)
        owner = np.repeat(np.arange(len(lens)), lens)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(lens) - lens, lens)
        hit = np.flatnonzero(good | bad)
        rows, first = np.unique(owner[hit], return_index=True)  # keys are longest first
        at = np.zeros(len(lens), dtype=np.int32)
        at[rows] = (inside[hit[first]] + 1) * np.where(bad[hit[first]], -1, 1)
        return pd.Series(at)

    h1, h2 = hashes(F.col("keys"))
    at = F.col("at")
    rule = F.when(at != 0, F.try_element_at("keys", F.abs(at)))
    return keyed.withColumn("at", decide(h1, h2)).select("page_id", "host", "path", rule.alias("rule"), F.when(at < 0, "block").otherwise("allow").alias("verdict"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def oracle() -> str:
    longest = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    case = lambda of: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{of(a, h, p)}'" for a, h, p in longest)
    return rf"""
WITH urls AS (SELECT page_id,
  translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages)
SELECT page_id, host, path, {case(lambda a, h, p: h + p)} ELSE NULL END AS rule, {case(lambda a, h, p: a)} ELSE 'allow' END AS verdict FROM urls"""
