"""Packing documents into training sequences by first-fit decreasing.

Documents are tokenised where they are read. Stretches that fill a sequence by themselves
are cut off there; only what is left of each document (less than a sequence) goes to a
randomised group. In each group first-fit decreasing finds the first bin with room by a
tournament tree of bin capacities. At last the emptiest bins are taken apart to fill the
gaps of the others, so that at most one sequence of a group needs padding.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import pieces, public_path, public_pattern
from .common import null_ids, table, tidy, tidy_group, with_ids

SEQUENCE = 2048
END_ID = 1
#: Documents in a group, on average: some 10 MB of ids at most.
GROUP_DOCS = 4096
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def byte_of_symbol() -> dict[str, int]:
    """The rule by which byte-level vocabularies write bytes as printable characters."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


_loaded: dict[str, object] = {}


def encoder(path: str):
    """A tiktoken encoding of the vocabulary in a tokenizers file; its ids are ranks, added tokens in a text are their ids. One per process."""
    if path not in _loaded:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        special = {x["content"]: x["id"] for x in model["added_tokens"]}
        symbols = byte_of_symbol()
        ranks = {bytes(symbols[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
        _loaded[path] = tiktoken.Encoding("packing", pat_str=public_pattern(), mergeable_ranks=ranks, special_tokens=special)
    return _loaded[path]


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item. The tree holds at each node the most room of any bin below."""
    n = len(sizes)
    leaves = 1 << max(0, (n - 1).bit_length())
    tree = [capacity] * (2 * leaves)
    out = np.zeros(n, dtype=np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        s, node = int(sizes[i]), 1
        while node < leaves:
            node *= 2
            if tree[node] < s:
                node += 1
        out[i] = node - leaves
        tree[node] -= s
        while node > 1:
            node >>= 1
            best = tree[2 * node]
            tree[node] = best if best >= tree[2 * node + 1] else tree[2 * node + 1]
    return out


def fill(bins: list[list[tuple[int, int, int]]], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Take the emptiest bins apart to fill the others' gaps. Entries: (item, start, length)."""
    room = [capacity - sum(x[2] for x in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda i: (room[i], i))
    lo, hi = 0, len(order) - 1
    while lo < hi:
        to, of = order[lo], order[hi]
        if room[to] == 0:
            lo += 1
        elif not bins[of]:
            hi -= 1
        else:
            item, start, length = bins[of].pop()
            take = min(length, room[to])
            bins[to].append((item, start, take))
            room[to] -= take
            room[of] += take
            if take < length:
                bins[of].append((item, start + take, length - take))
    return [b for b in bins if b]


def pack_group(pdf: pd.DataFrame, sequence: int = SEQUENCE) -> pd.DataFrame:
    """The pieces of one group; its own numbering, without gaps, makes sequence_id."""
    pdf = pdf.sort_values(["doc_id", "doc_tokens", "tail"], kind="stable")
    docs, totals = pdf.doc_id.to_numpy(), pdf.doc_tokens.to_numpy()
    tails = [np.frombuffer(x, dtype="<u4") for x in pdf["tail"]]
    sizes = np.array([len(t) for t in tails], dtype=np.int64)
    has = np.flatnonzero(sizes)
    where = first_fit_decreasing(sizes[has], sequence)
    bins: list[list[tuple[int, int, int]]] = [[] for _ in range(int(where.max()) + 1 if len(where) else 0)]
    for i, b in zip(has.tolist(), where.tolist(), strict=True):
        bins[b].append((i, 0, int(sizes[i])))
    rows, number = [], 0
    for b in fill(bins, sequence):
        offset = 0
        for i, start, length in b:
            rows.append((docs[i], totals[i] - sizes[i] + start, length, zlib.crc32(tails[i][start : start + length].tobytes()), totals[i], number, offset))
            offset += length
        number += 1
    for i, crcs in enumerate(pdf["full"]):
        for j, c in enumerate(crcs):
            rows.append((docs[i], j * sequence, sequence, c, totals[i], number, 0))
            number += 1
    out = pd.DataFrame(rows, columns=[x.split()[0] for x in PIECES.split(", ")], dtype="int64")
    out["sequence_id"] += int(pdf.grp.iloc[0]) << 32
    return out


def pack(docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE, end_id: int = END_ID, group_docs: int = GROUP_DOCS) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are the end id alone. Each id of each row, repeated rows included,
    lies in exactly one piece. An empty table gives no rows. Other columns are not read.
    path: a byte-level vocabulary for tokenizers, on every executor.
    """

    def tokenise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path or public_path("byte_bpe_50k.json"))
        for pdf in batches:
            texts, ids_of = pdf.text.fillna("").tolist(), pdf.doc_id.to_numpy()
            for a, b in pieces(texts):
                rows = []
                for doc, text in zip(ids_of[a:b], texts[a:b], strict=True):
                    ids = np.array([*enc.encode(text, allowed_special="all"), end_id], dtype="<u4")
                    n = len(ids) // sequence * sequence
                    full = [zlib.crc32(ids[i : i + sequence].tobytes()) for i in range(0, n, sequence)]
                    rows.append((doc, len(ids), full, ids[n:].tobytes(), zlib.crc32(ids.tobytes())))
                yield pd.DataFrame(rows, columns=["doc_id", "doc_tokens", "full", "tail", "crc"])

    tokens = with_ids(docs.select("doc_id", "text")).mapInPandas(tidy(tokenise), "doc_id long, doc_tokens long, full array<long>, tail binary, crc long")
    groups = max(1, -(-docs.count() // group_docs))
    spread = F.pmod(F.xxhash64("doc_id", "crc", F.lit(0x5EED)), F.lit(groups)).cast("int")
    return null_ids(tokens.withColumn("grp", spread).drop("crc").groupBy("grp").applyInPandas(tidy_group(lambda pdf: pack_group(pdf, sequence)), PIECES))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
