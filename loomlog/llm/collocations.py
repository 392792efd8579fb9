"""Phrase collocations: counts of all phrases of up to four words, and how firmly each holds together.

A shard of texts is counted into a trie of depth four: its windows (the four words from each
place on, fewer at the end of a piece) in order, equal ones counted. The trie is serialised in
order, each window as the depth it shares with the one before and the words that follow, and
cut at the bounds of prefix ranges. A range's runs from all shards are decoded and merged, and
sums over equal first words are the counts of its nodes. A node whose windows go on in another
range is among the first or last of its range, so those partial counts are added up after.

Left parts of a phrase are its ancestors: nodes are read in trie order with a stack. Right
parts are the ancestors in the trie of reversed phrases, which is where suffix links lead. What
a partition's first node needs from the partitions before (three nodes at most) is looked up.

No phrase and no word gathers its rows in one task: a shard sends a window once, and parts
are found by order, not by joins on them.
"""

from __future__ import annotations

import string
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomlog.operators.windows import rank_globally

from .common import cut, release, table, tidy, tidy_group

DEPTH, LEAST, TOP, SCALE = 4, 30, 2000, 2_000_000
#: A longer phrase of this share (percent) of a phrase's occurrences stands for it.
COVER = 80
#: Words of a shard's trie at a time, bytes of text parsed at a time, bytes of text a prefix range stands for.
SHARD_WORDS, PART_BYTES, RANGE_BYTES = 2_000_000, 1 << 20, 8 << 20
#: One text in so many is looked at to place the bounds of ranges (they change no count), and one window in so many of it.
SAMPLE_TEXTS, SAMPLE_WINDOWS, BOUND_CHARS = 200, 32, 64

_END = 0xFF  # no UTF-8 text holds it
_MAP = bytes(_END if chr(b) in ".,;:!?\n\x0b\x0c\r" else b + 32 if chr(b) in string.ascii_uppercase else b for b in range(256))
_SPLIT = bytes([_END])


def parts(text: str) -> Iterator[list[bytes]]:
    """Words of a text in order, lower-cased (A-Z), with _SPLIT between pieces; long texts in lists cut between pieces."""
    data = text.encode("utf-8", "surrogatepass").translate(_MAP)
    at = 0
    while at < len(data):
        end = data.find(_SPLIT, at + PART_BYTES)
        end = len(data) if end < 0 else end
        yield data[at:end].replace(_SPLIT, b" " + _SPLIT + b" ").split()
        at = end + 1


def windows(ids: np.ndarray) -> np.ndarray:
    """The window of each word: rows of DEPTH ids, 0 behind a piece's end. 0 in ids separates pieces."""
    out = np.zeros((len(ids), DEPTH), dtype=np.uint32)
    out[:, 0] = ids
    for d in range(1, DEPTH):
        out[:-d, d] = np.where(out[:-d, d - 1] > 0, ids[d:], 0)
    return out[ids > 0]


def merged(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal windows as one, in order. Counts are added."""
    if not len(rows):
        return rows, counts
    wide = rows.astype(np.uint64)
    high, low = wide[:, 0] << np.uint64(32) | wide[:, 1], wide[:, 2] << np.uint64(32) | wide[:, 3]
    order = np.lexsort((low, high))
    high, low = high[order], low[order]
    first = np.flatnonzero(np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])]))
    return rows[order[first]], np.add.reduceat(counts[order], first)


def encode(rows: np.ndarray, counts: np.ndarray, words: list[bytes]) -> bytes:
    """Ordered windows as bytes: shared depths, counts, the words that differ, and the words used."""
    same = np.zeros(len(rows), dtype=np.uint8)
    equal = np.ones(len(rows) - 1, dtype=bool)
    for d in range(DEPTH):
        equal &= rows[1:, d] == rows[:-1, d]
        same[1:] += equal
    tails = rows[np.arange(DEPTH) >= same[:, None]]
    used, tails = np.unique(tails, return_inverse=True)
    own = [words[i] for i in used]
    head = np.array([len(rows), len(tails), len(own)], dtype=np.int64)
    sizes = np.array([len(w) for w in own], dtype=np.uint32)
    body = b"".join([head.tobytes(), same.tobytes(), counts.astype(np.int64).tobytes(), tails.astype(np.uint32).tobytes(), sizes.tobytes(), *own])
    return len(body).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)


def decode(blob: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    body = pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    n, t, w = np.frombuffer(body, dtype=np.int64, count=3).tolist()
    at, out = 24, []
    for kind, size in ((np.uint8, n), (np.int64, n), (np.uint32, t), (np.uint32, w)):
        out.append(np.frombuffer(body, dtype=kind, count=size, offset=at))
        at += size * np.dtype(kind).itemsize
    same, counts, tails, sizes = out
    ends = (at + np.cumsum(sizes, dtype=np.int64)).tolist()
    words = [body[a:b] for a, b in zip([at, *ends], ends, strict=False)]
    rows, place = np.zeros((n, DEPTH), dtype=np.uint32), np.arange(n)
    rows[np.arange(DEPTH) >= same[:, None]] = tails
    for d in range(DEPTH):
        rows[:, d] = rows[np.maximum.accumulate(np.where(same <= d, place, 0)), d]
    return rows, counts, words


class Trie:
    """Counts of one language's windows in a shard."""

    def __init__(self) -> None:
        self.ids: dict[bytes, int] = {_SPLIT: 0}
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, words: list[bytes]) -> None:
        known = self.ids
        got = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.uint32, count=len(words))
        self.held += [got, np.zeros(1, dtype=np.uint32)]
        self.size += len(got) + 1

    def ordered(self) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """(windows in order, counts, words by id from 1, an empty one before)."""
        words = sorted(w for w in self.ids if w != _SPLIT)
        rank = np.zeros(len(self.ids), dtype=np.uint32)
        rank[[self.ids[w] for w in words]] = np.arange(1, len(words) + 1)
        rows = windows(rank[np.concatenate(self.held)])
        return *merged(rows, np.ones(len(rows), dtype=np.int64)), [b"", *words]


def place(bound: tuple[bytes, ...], rows: np.ndarray, words: list[bytes]) -> int:
    """The first of the ordered windows that isn't below bound."""
    low, high = 0, len(rows)
    for d in range(DEPTH):
        at = bisect_left(words, bound[d])
        column = rows[low:high, d]
        low, high = low + int(np.searchsorted(column, at)), low + int(np.searchsorted(column, at, side="right"))
        if at == len(words) or words[at] != bound[d]:
            return low  # windows with this id are above the bound already
    return low


def nodes(rows: np.ndarray, counts: np.ndarray, words: list[bytes], least: int) -> Iterator[tuple[str, int, int]]:
    """(phrase, words, count) of a range's nodes: those of at least `least`, and all that may go on in another range.

    The first has no words: it counts the range's windows, that is, words.
    """
    yield "", 0, int(counts.sum())
    change = np.zeros(len(rows), dtype=bool)
    change[0] = True
    for d in range(DEPTH):
        change[1:] |= rows[1:, d] != rows[:-1, d]
        first = np.flatnonzero(change)
        total = np.add.reduceat(counts, first)
        keep = total >= least
        keep[[0, -1]] = True
        for i in np.flatnonzero(keep & (rows[first, d] > 0)).tolist():
            yield b" ".join(words[w] for w in rows[first[i], : d + 1]).decode("utf-8", "surrogatepass"), d + 1, int(total[i])


def bounds(texts: DataFrame) -> list[tuple[str, tuple[bytes, ...]]]:
    """Where prefix ranges begin, as (lang, window): one range for RANGE_BYTES of text. Only these reach the driver."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    many = size // RANGE_BYTES
    if not many:
        return []

    def some(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lang, text in zip(pdf["lang"].tolist(), pdf["text"].tolist(), strict=True):
                for words in parts(text):
                    at = [i for i in range(0, len(words), SAMPLE_WINDOWS) if words[i] != _SPLIT]
                    found = [words[i : i + DEPTH] for i in at]
                    found = [" ".join(w.decode("utf-8", "surrogatepass")[:BOUND_CHARS] for w in f[: f.index(_SPLIT) if _SPLIT in f else DEPTH]) for f in found]
                    if found:
                        yield pd.DataFrame({"lang": [lang] * len(found), "path": found})

    looked = texts.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE_TEXTS)) == 0).mapInPandas(tidy(some), "lang string, path string").withColumn("path", F.split("path", " "))
    looked = cut(looked, "sample")
    step = max(1, -(-looked.count() // many))
    ranked = rank_globally(looked, ["lang", "path"]).where(F.col("_rank") % step == 0).select("lang", "path").distinct()
    found = [(r["lang"], tuple(w.encode("utf-8", "surrogatepass") for w in [*r["path"], *[""] * DEPTH][:DEPTH])) for r in ranked.collect()]
    return sorted(found, key=lambda b: (b[0].encode("utf-8", "surrogatepass"), b[1]))


def counted(texts: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, phrase, m, a): phrases of 1 to DEPTH words that occur at least `least` times, and per lang a row of m = 0 with the count of all words.

    texts: (lang, text), no nulls. A word is counted where it stands, overlaps included.
    """
    ranges = texts.sparkSession.sparkContext.broadcast(bounds(texts))

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[str, Trie] = {}
        held = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            for lang, trie in tries.items():
                rows, counts, words = trie.ordered()
                if not len(rows):
                    continue
                key = lang.encode("utf-8", "surrogatepass")
                below = [b[0].encode("utf-8", "surrogatepass") for b in ranges.value]
                base = sum(k < key for k in below)
                own = [place(b, rows, words) for (_, b), k in zip(ranges.value, below, strict=True) if k == key]
                edge = [0, *own, len(rows)]
                for i, (a, b) in enumerate(zip(edge, edge[1:], strict=False)):
                    if b > a:
                        yield pa.RecordBatch.from_arrays([pa.array([base + i], pa.int32()), pa.array([lang]), pa.array([encode(rows[a:b], counts[a:b], words)], pa.binary())], ["part", "lang", "trie"])
            tries.clear()
            release()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                for words in parts(text.as_py()):
                    trie = tries.setdefault(lang, Trie())
                    size = trie.size
                    trie.add(words)
                    held += trie.size - size
                    if held >= SHARD_WORDS:
                        yield from flushed()
                        held = 0
        yield from flushed()

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        runs = [decode(b) for b in group["trie"]]
        words = sorted({w for _, _, own in runs for w in own} | {b""})
        rank = {w: i for i, w in enumerate(words)}
        mapped = [np.array([rank[w] for w in own], dtype=np.uint32)[rows] for rows, _, own in runs]
        rows, counts = merged(np.concatenate(mapped), np.concatenate([c for _, c, _ in runs]))
        out = pd.DataFrame(list(nodes(rows, counts, words, least)), columns=["phrase", "m", "a"])
        return out.assign(lang=group["lang"].iat[0])

    tries = texts.select("lang", "text").mapInArrow(shards, "part int, lang string, trie binary")
    found = tries.groupBy("part", "lang").applyInPandas(tidy_group(merge), "phrase string, m int, a long, lang string")
    return found.groupBy("lang", "phrase", "m").agg(F.sum("a").alias("a")).where((F.col("a") >= least) | (F.col("m") == 0))


def _words(phrase: str = "phrase") -> Column:
    return F.split(phrase, " ")


def with_parts(found: DataFrame, name: str, back: bool) -> DataFrame:
    """found (lang, phrase, m, a, others) with the columns {name}1 to {name}3: counts of its first words, or of its last ones (back).

    Rows are put in the order of the trie of phrases (of reversed ones), where the rows of its
    first words stand before a phrase; every such row must be there.
    """
    spark = found.sparkSession
    path = F.reverse(_words()) if back else _words()
    columns, depths = found.columns, range(1, DEPTH)
    parts_per = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lang, stack = None, []  # (word, count) by depth; count unknown where an earlier partition has the node
        for pdf in batches:
            got: list[list[int | None]] = []
            for own, phrase, a in zip(pdf["lang"].tolist(), pdf["phrase"].tolist(), pdf["a"].tolist(), strict=True):
                words = phrase.split(" ")[:: -1 if back else 1]
                if own != lang:
                    lang, stack = own, []
                same = 0
                while same < min(len(stack), len(words)) and stack[same][0] == words[same]:
                    same += 1
                stack = [*stack[:same], *[(w, None) for w in words[same:]]]
                stack[len(words) - 1] = (words[-1], a)
                got.append([stack[d - 1][1] if d < len(words) else None for d in depths])
            yield pdf.assign(**{f"{name}{d}": pd.array([g[d - 1] for g in got], dtype="Int64") for d in depths})

    kinds = ", ".join(f"`{c}` {t}" for c, t in found.dtypes)
    dealt = found.withColumn("_path", path).repartitionByRange(parts_per, "lang", "_path").sortWithinPartitions("lang", "_path").drop("_path")
    walked = cut(dealt.mapInPandas(tidy(walk), f"{kinds}, {', '.join(f'{name}{d} long' for d in depths)}"), "walked")

    def part(d: int) -> Column:
        return F.array_join(F.slice(_words(), -d if back else 1, d), " ")

    asked = None
    for d in depths:
        rows = walked.where(F.col(f"{name}{d}").isNull() & (F.col("m") > d)).select("lang", part(d).alias("phrase"))
        asked = rows if asked is None else asked.unionByName(rows)
    # at most three nodes a partition: those above its first row
    told = cut(found.join(F.broadcast(asked.distinct()), ["lang", "phrase"]).select("lang", F.col("phrase").alias("_part"), F.col("a").alias("_a")), "told")
    for d in depths:
        given = walked.withColumn("_part", F.when(F.col("m") > d, part(d))).join(F.broadcast(told), ["lang", "_part"], "left")
        walked = given.withColumn(f"{name}{d}", F.coalesce(f"{name}{d}", "_a")).drop("_part", "_a")
    return walked.select(*columns, *[f"{name}{d}" for d in depths])


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, cover: int = COVER) -> DataFrame:
    """Each lang's first `top` phrases: lang, rank, phrase, a, l, r, n, score, cut (words left of the scored cut).

    docs: lang, text. A null lang is `und`, one with the lang of that name; null and empty
    texts have no words. Repeated rows count each time. Ties of score and a are in byte order
    of the phrase. An empty table gives no rows. Texts of any length are read whole, in parts.
    """
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    found = cut(counted(texts, least), "phrases")
    sizes = found.where("m = 0").select("lang", F.col("a").alias("n"))
    phrases = with_parts(with_parts(found.where("m > 0"), "l", False), "r", True).where("m > 1")
    phrases = cut(phrases, "parts")
    # what one word more does to a phrase tells of all longer ones, as their counts are no larger
    longer = phrases.where("m > 2").select("lang", "a", F.explode(F.array(F.array_join(F.slice(_words(), F.lit(1), F.col("m") - 1), " "), F.array_join(F.slice(_words(), F.lit(2), F.col("m") - 1), " "))).alias("phrase"))
    longest = longer.groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    kept = phrases.join(longest, ["lang", "phrase"], "left").where(F.col("_longer").isNull() | (F.col("_longer").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * cover))
    cuts = []
    for k in range(1, DEPTH):
        right = f"CASE m {' '.join(f'WHEN {m} THEN r{m - k}' for m in range(k + 1, DEPTH + 1))} END"
        score = f"(CAST({SCALE} AS DECIMAL(8,0)) * CAST(a AS DECIMAL(20,0))) DIV (CAST(l{k} AS DECIMAL(20,0)) + CAST({right} AS DECIMAL(20,0)))"
        cuts.append(F.expr(f"IF(m > {k}, STRUCT({score} AS score, {k} AS cut, l{k} AS l, {right} AS r), NULL)"))
    best = kept.withColumn("_best", F.array_min(F.array_compact(F.array(*cuts)))).select("lang", "phrase", "a", "_best.*")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score", "cut")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents")).drop("cut")


def oracle() -> str:
    """DuckDB SQL for op13_collocations, over all phrases and all cuts."""
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    grams = " UNION ALL ".join(f"SELECT lang, {m} AS m, array_to_string(w[i:i + {m - 1}], ' ') AS phrase FROM pieces, LATERAL (SELECT unnest(range(1, len(w) - {m} + 2)) AS i)" for m in range(1, DEPTH + 1))
    return f"""
WITH texts AS (SELECT coalesce(lang, 'und') AS lang, translate(text, '{upper}', '{lower}') AS t FROM documents WHERE text IS NOT NULL),
split AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS p FROM texts),
pieces AS (SELECT lang, list_filter(string_split_regex(p, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM split),
f AS (SELECT lang, m, phrase, count(*) AS a FROM ({grams}) GROUP BY ALL),
sizes AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
often AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE a >= {LEAST}),
cuts AS (
  SELECT c.lang, c.phrase, c.a, k, x.a AS l, y.a AS r, CAST({SCALE}::HUGEINT * c.a // (x.a + y.a) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM often WHERE m > 1) c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1:c.m], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (
  SELECT lang, array_to_string(w[i:i + size - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest(range(1, m - size + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS size FROM often WHERE m > 2)) GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best LEFT JOIN inner_ USING (lang, phrase) JOIN sizes USING (lang)
WHERE longer IS NULL OR 100 * longer < {COVER} * a
QUALIFY rank <= {TOP}
"""
