"""Line dedup by a tree of line templates.

A line is parsed to a leaf of fixed depth: its number of tokens, then its leading tokens.
Tokens that hold a digit are variable fields. In a leaf, lines in byte order join the most
similar template so far, and where they differ the template generalises to a variable
field; lines too different open a template. A template that enough documents hold recurs:
its lines stay in the document of smallest id only.

A leaf is whole, however many lines it has: what a line joins never depends on the size of
the table. Templates that a line may join are looked up by runs of tokens, one of which they
must have in common. Lines so short that no token may differ join nothing but equal ones,
so they are dealt by all their tokens.

Texts are parsed once, in chunks. A chunk sends each different line once to the bucket of
its leaf, with the smallest ids that hold it, so a line that is everywhere is a few rows;
the answer goes back to the chunks by line number.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Carried, cut, null_ids, table, tidy, tidy_group, with_ids
from .suffix_dedup import BUCKET, CHUNK, _unzip, _zip

#: Leading tokens on the way to a leaf; share of equal tokens that joins a line to a template; documents that make it recur.
DEPTH, SIMILAR, MIN_DOCS = 3, 0.8, 3
#: Templates of a leaf that are all compared with a line; of more, those that have a run of tokens in common with it. The answer is the same.
SCANNED = 64
FIELD = "<*>"
_DIGIT = re.compile(r"\d")
NEVER = np.iinfo(np.int64).max


def masked(line: str) -> list[str]:
    """The line's tokens, those with digits as variable fields."""
    tokens = line.split()
    if _DIGIT.search(line):
        tokens = [FIELD if _DIGIT.search(t) else t for t in tokens]
    return tokens


def leaf(tokens: list[str], depth: int) -> str:
    return f"{len(tokens)} {' '.join(tokens[:depth])}"


def alone(width: int, similar: float) -> bool:
    """Whether lines of so many tokens join equal ones only."""
    return math.ceil(similar * width) >= width


class Runs:
    """Templates by their runs of tokens: where at most `differ` tokens of a line and a template differ, one of differ + 1 runs is equal."""

    def __init__(self, found: np.ndarray, differ: int):
        edges = np.arange(differ + 2) * found.shape[1] // (differ + 1) * found.itemsize
        self.runs = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
        self.held: list[dict[bytes, set[int]]] = [{} for _ in self.runs]
        for t, row in enumerate(found):
            self.add(t, row.tobytes())

    def add(self, t: int, row: bytes) -> None:
        for held, (a, b) in zip(self.held, self.runs, strict=True):
            held.setdefault(row[a:b], set()).add(t)

    def change(self, t: int, old: bytes, new: bytes) -> None:
        for held, (a, b) in zip(self.held, self.runs, strict=True):
            if old[a:b] != new[a:b]:
                held[old[a:b]].discard(t)
                if not held[old[a:b]]:
                    del held[old[a:b]]
                held.setdefault(new[a:b], set()).add(t)

    def near(self, row: bytes, most: int) -> list[int] | None:
        """Templates with a run of this row, in order; None where they are more than `most`."""
        sets = [x for held, (a, b) in zip(self.held, self.runs, strict=True) if (x := held.get(row[a:b]))]
        if sum(map(len, sets)) > most:
            return None
        return sorted(set().union(*sets))


def templates(lines: Iterable[list[str]], similar: float) -> list[int]:
    """The template of each line of one leaf, taken in the given order."""
    known: dict[str, int] = {}
    rest = iter(lines)
    head = next(rest)
    width = len(head)
    codes = np.fromiter((known.setdefault(t, len(known) + 1) for line in chain([head], rest) for t in line), dtype=np.int32).reshape(-1, width)
    codes[codes == known.get(FIELD, -1)] = 0  # variable fields are equal to nothing, and to each other only as fields
    codes = np.ascontiguousarray(codes[:, (codes != codes[0]).any(axis=0)])  # other tokens are equal throughout
    need = math.ceil(similar * width) - (width - codes.shape[1])
    found = np.empty((16, codes.shape[1]), dtype=np.int32)
    n, out, runs = 0, [], None
    for line in codes:
        near = runs.near(line.tobytes(), max(SCANNED, n // 8)) if runs else None
        some = found[:n] if near is None else found[near]
        if len(some):
            same = some == line
            score = same.sum(axis=1)
            best = int(score.argmax())
            if score[best] >= need:
                t, differs = best if near is None else near[best], ~same[best]
                if found[t][differs].any():
                    old = found[t].tobytes()
                    found[t][differs] = 0
                    if runs:
                        runs.change(t, old, found[t].tobytes())
                out.append(t)
                continue
        if n == len(found):
            found = np.concatenate([found, np.empty_like(found)])
        found[n] = line
        out.append(n)
        if runs:
            runs.add(n, line.tobytes())
        n += 1
        if n == SCANNED:
            runs = Runs(found[:n], codes.shape[1] - need)
    return out


PARSED = pa.schema({"g": pa.int64(), "ids": pa.binary(), "counts": pa.binary(), "odd_at": pa.binary(), "odd": pa.binary(), "meta": pa.binary(), "places": pa.binary(), "lines": pa.binary(), "owners": pa.binary(), "hashes": pa.binary()})


def leaf_hash(tokens: list[str], depth: int, width: int | None = None) -> int:
    """Of the leaf that leading tokens name; width: how many the line has."""
    x = xxhash.xxh64_intdigest(f"{len(tokens) if width is None else width} {' '.join(tokens[:depth])}".encode("utf-8", "surrogatepass"))
    return x - (1 << 64) if x >> 63 else x


def parse(rows: DataFrame, depth: int, similar: float, min_docs: int) -> DataFrame:
    """Chunks: the entry of each line, the entries with their owners and leaves, and the lines that differ from their entry's text; written once.

    rows: doc_id, text, columns to hand on.
    """

    def hashed(line: str) -> int:
        width = line.count(" ") + 1
        return leaf_hash(line.split(" ", depth), width if alone(width, similar) else depth, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        slices: list[pa.RecordBatch] = []
        size = 0

        def row() -> pa.RecordBatch:
            entries: dict[str, int] = {}
            owners: list[list[int]] = []
            where: list[int] = []
            counts: list[int] = []
            odd: list[tuple[int, str]] = []
            for doc, text in held:
                lines = text.split("\n")
                counts.append(len(lines))
                for line in lines:
                    tokens = masked(line)
                    entry = " ".join(tokens)
                    if entry != line:
                        odd.append((len(where), line))
                    if not tokens:
                        where.append(-1)
                        continue
                    e = entries.setdefault(entry, len(owners))
                    if e == len(owners):
                        owners.append([doc])
                    elif doc not in owners[e]:
                        owners[e].append(doc)
                        if len(owners[e]) > 4 * min_docs:
                            owners[e] = sorted(owners[e])[:min_docs]
                    where.append(e)
            own = np.full((len(owners), min_docs), NEVER, dtype=np.int64)
            for i, some in enumerate(owners):
                least = sorted(some)[:min_docs]
                own[i, : len(least)] = least
            hashes = np.array([hashed(line) for line in entries], dtype=np.int64)
            ids = np.array([x[0] for x in held], dtype=np.int64)
            whole = {
                "g": (part << 32) + count,
                "ids": ids.tobytes(),
                "counts": np.array(counts, dtype=np.int32).tobytes(),
                "odd_at": np.array([i for i, _ in odd], dtype=np.int32).tobytes(),
                "odd": _zip("\n".join(x for _, x in odd).encode("utf-8", "surrogatepass")),
                "meta": Carried.pack(slices),
                "places": _zip(np.array(where, dtype=np.int32).tobytes()),
                "lines": _zip("\n".join(entries).encode("utf-8", "surrogatepass")),
                "owners": _zip(own.tobytes()),
                "hashes": hashes.tobytes(),
            }
            return pa.RecordBatch.from_pylist([whole], schema=PARSED)

        for batch in batches:
            first = 0
            for at, (doc, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                text = text or ""
                if held and size + len(text) > CHUNK:
                    slices.append(batch.slice(first, at - first))
                    yield row()
                    count, held, slices, size, first = count + 1, [], [], 0, at
                held.append((doc, text))
                size += len(text)
            slices.append(batch.slice(first))
        if held:
            yield row()

    schema = "g long, ids binary, counts binary, odd_at binary, odd binary, meta binary, places binary, lines binary, owners binary, hashes binary"
    return cut(rows.mapInArrow(tidy(run), schema), "lines")


def answer(pdf: pd.DataFrame, depth: int, similar: float, min_docs: int) -> pd.DataFrame:
    """Of one bucket: for each chunk's entries the only doc_id that keeps the line, or NEVER where it doesn't recur."""
    lines: dict[str, int] = {}
    per, sets = [], []
    for blob, own in zip(pdf.lines, pdf.owners, strict=True):
        per.append(np.array([lines.setdefault(line, len(lines)) for line in _unzip(blob).decode("utf-8", "surrogatepass").split("\n")], dtype=np.int32))
        sets.append(np.frombuffer(own, dtype=np.int64))
    leaves: dict[str, list[str]] = {}
    for line in lines:
        if not alone(line.count(" ") + 1, similar):
            leaves.setdefault(leaf(line.split(" "), depth), []).append(line)
    group = np.arange(len(lines), dtype=np.int32)  # a template is named by the line that opened it
    for some in leaves.values():
        if len(some) > 1:
            some.sort()
            at = np.array([lines[x] for x in some], dtype=np.int32)
            found = np.array(templates((x.split(" ") for x in some), similar))
            group[at] = at[np.unique(found, return_index=True)[1]][found]
    keeper = recurring(np.repeat(group[np.concatenate(per)], min_docs), np.concatenate(sets), len(lines), min_docs)[group]
    return pd.DataFrame({"g": pdf.g, "entries": pdf.entries, "keepers": [keeper[at].tobytes() for at in per]})


def recurring(group: np.ndarray, ids: np.ndarray, n: int, min_docs: int) -> np.ndarray:
    """For each of n groups: its smallest id if it has min_docs different ones, else NEVER (which is no id)."""
    real = ids != NEVER
    group, ids = group[real], ids[real]
    order = np.lexsort((ids, group))
    group, ids = group[order], ids[order]
    new = np.ones(len(ids), dtype=bool)
    new[1:] = (group[1:] != group[:-1]) | (ids[1:] != ids[:-1])
    group, ids = group[new], ids[new]
    which, first, size = np.unique(group, return_index=True, return_counts=True)
    out = np.full(n, NEVER, dtype=np.int64)
    out[which[size >= min_docs]] = ids[first[size >= min_docs]]
    return out


def chunks_in(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def send(buckets: int, min_docs: int):
    """The entries of each chunk, to the buckets of their leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in chunks_in(batches):
            hashes = np.frombuffer(x["hashes"], dtype=np.int64)
            lines = _unzip(x["lines"]).decode("utf-8", "surrogatepass").split("\n")
            own = np.frombuffer(_unzip(x["owners"]), dtype=np.int64).reshape(-1, min_docs)
            where = hashes % buckets
            order = np.argsort(where, kind="stable").astype(np.int32)
            which, first = np.unique(where[order], return_index=True)
            out = []
            for r, some in zip(which.tolist(), np.split(order, first[1:]) if len(order) else [], strict=True):
                out.append({"r": r, "g": x["g"], "entries": some.tobytes(), "owners": own[some].tobytes(), "lines": _zip("\n".join([lines[e] for e in some.tolist()]).encode("utf-8", "surrogatepass"))})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=SENT)

    return run


def judged(rows: DataFrame, depth: int, similar: float, min_docs: int) -> DataFrame:
    """Parsed chunks with the answers to their entries."""
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-int(total) // BUCKET))
    store = parse(rows, depth, similar, min_docs)
    sent = store.select("g", "lines", "owners", "hashes").mapInArrow(tidy(send(buckets, min_docs)), "r int, g long, entries binary, owners binary, lines binary")
    keepers = sent.groupBy("r").applyInPandas(tidy_group(lambda pdf: answer(pdf, depth, similar, min_docs)), "g long, entries binary, keepers binary")
    per = keepers.groupBy("g").agg(F.collect_list(F.struct("entries", "keepers")).alias("answers"))
    return store.select("g", "ids", "counts", "odd_at", "odd", "meta", "places", "lines").join(per, "g", "left")


SENT = pa.schema({"r": pa.int32(), "g": pa.int64(), "entries": pa.binary(), "owners": pa.binary(), "lines": pa.binary()})


def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(chunk, ids, kept texts, lines, lines dropped) of each chunk of judged()."""
    for batch in batches:
        for x in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
            places = np.frombuffer(_unzip(x["places"]), dtype=np.int32)
            keeper = np.full(int(places.max(initial=-1)) + 2, NEVER, dtype=np.int64)  # the last is for blank lines
            for a in x["answers"] or []:
                keeper[np.frombuffer(a["entries"], dtype=np.int32)] = np.frombuffer(a["keepers"], dtype=np.int64)
            who = keeper[places]
            ids = np.frombuffer(x["ids"], dtype=np.int64)
            entry = _unzip(x["lines"]).decode("utf-8", "surrogatepass").split("\n")
            text = ["" if e < 0 else entry[e] for e in places.tolist()]
            for i, line in zip(np.frombuffer(x["odd_at"], dtype=np.int32).tolist(), _unzip(x["odd"]).decode("utf-8", "surrogatepass").split("\n"), strict=False):
                text[i] = line
            kept, counts, drops, at = [], [], [], 0
            for doc, n in zip(ids.tolist(), np.frombuffer(x["counts"], dtype=np.int32).tolist(), strict=True):
                own = who[at : at + n]
                gone = (own != NEVER) & (own != doc)
                counts.append(int((places[at : at + n] >= 0).sum()))
                drops.append(int(gone.sum()))
                kept.append("\n".join(line for line, g in zip(text[at : at + n], gone.tolist(), strict=True) if not g))
                at += n
            yield x, ids.tolist(), kept, counts, drops


def cleaned(docs: DataFrame, depth: int = DEPTH, similar: float = SIMILAR, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, kept, n_lines, n_dropped for each row of docs. Other columns are not read.

    Lines end at line feeds. Blank lines are no lines: they stay and aren't counted. A line
    whose template `min_docs` or more doc_ids hold stays only where doc_id is the smallest
    of them (there every one of its lines stays). Null texts are empty; repeated rows are
    one holder. The template depends on all lines of its leaf, in byte order, and on nothing
    else; a leaf of any size is judged by one task. A text of any length is one row of one chunk. A null doc_id is one id, smaller than all others. An
    empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, kept, counts, drops in finish(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kept, pa.string()), pa.array(counts, pa.int64()), pa.array(drops, pa.int64())], ["doc_id", "kept", "n_lines", "n_dropped"])

    rows = judged(with_ids(docs.select("doc_id", "text")), depth, similar, min_docs)
    return null_ids(rows.mapInArrow(tidy(run), "doc_id long, kept string, n_lines long, n_dropped long"))


def dedup(docs: DataFrame, depth: int = DEPTH, similar: float = SIMILAR, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs without the lines that cleaned() drops; n_chars, where there is one, follows the text. All rows and columns stay. Null texts become empty ones."""
    carried = Carried(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, ids, kept, _, _ in finish(batches):
            yield Carried.unpack(ids, kept, x["meta"])

    return carried.whole(judged(carried.rows, depth, similar, min_docs).mapInArrow(tidy(run), carried.schema))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cleaned(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
