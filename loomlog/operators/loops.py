"""Suppression of repeated error lines, and template mining: what needs state."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.functions import rules as r
from loomlog.functions import text as t

# A row within WINDOW of the last one is suppressed; a summary comes INTERVAL after the last emission.
WINDOW_MS, INTERVAL_MS = 300_000, 300_000
EMITTED = "server_id string, key string, ts_ms long, event_id long, suppressed long"


class Entry:
    """The state of one key: when it was last seen and last emitted, and what has been held back."""

    def __init__(self, last: int = 0, emitted: int = 0, held: int = 0):
        self.last, self.emitted, self.held = last, emitted, held

    def feed(self, ts: int, event_id: int, fresh: bool) -> list[tuple[int, int | None, int]]:
        """(ts, event_id or None for a summary, rows it stands for) that this row brings out."""
        if fresh or ts - self.last > WINDOW_MS:
            out = [(self.last, None, self.held)] if self.held else []
            self.last = self.emitted = ts
            self.held = 0
            return [*out, (ts, event_id, 0)]
        self.held += 1
        self.last = ts
        if ts - self.emitted >= INTERVAL_MS:
            out = [(ts, None, self.held)]
            self.held, self.emitted = 0, ts
            return out
        return []

    def drain(self) -> list[tuple[int, int | None, int]]:
        out = [(self.last, None, self.held)] if self.held else []
        self.held = 0
        return out


def run(rows: Iterable[tuple[int, int]]) -> list[tuple[int, int | None, int]]:
    """All that comes out of (ts, event_id) rows of one key in order, drained at the end."""
    entry, out = Entry(), []
    for i, (ts, event_id) in enumerate(rows):
        out += entry.feed(ts, event_id, i == 0)
    return out + entry.drain()


def candidate(level: Column, text: Column) -> Column:
    """Whether a line may be an error loop, by its level or its words; all others pass the filter as they are. Never null."""
    return F.coalesce(F.upper(level).isin(r.LOOP_LEVELS) | F.lower(text).rlike(t.any_of(r.LOOP_WORDS)), F.lit(False))


def suppress(rows: DataFrame, server: str = "server_id", key: str = "key", ts: str = "ts_ms", event_id: str = "event_id") -> DataFrame:
    """Rows that pass (event_id set) and summaries (null, with the rows they stand for): originals and sums make up the input.

    A group starts anew after a gap longer than the window, so keys are cut there first. The
    rows of a group run through the state in order, batch by batch; none is held whole.
    """
    from loomlog.operators.windows import sessions

    group = [server, key, "session"]
    cut = sessions(rows, [server, key], ts, event_id, WINDOW_MS).select(*group, ts, event_id)

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, entry = None, Entry()
        for pdf in batches:
            out = []
            for at, t, e in zip(zip(*[pdf[c].tolist() for c in group], strict=True), pdf[ts].tolist(), pdf[event_id].tolist(), strict=True):
                if at != now:
                    out += [(*now[:2], *x) for x in entry.drain()] if now else []
                    now, entry = at, Entry()
                    out += [(*at[:2], *x) for x in entry.feed(t, e, True)]
                else:
                    out += [(*at[:2], *x) for x in entry.feed(t, e, False)]
            if out:
                yield made(out)
        if now and entry.held:
            yield made([(*now[:2], *x) for x in entry.drain()])

    return cut.repartition(*group).sortWithinPartitions(*group, ts, event_id).mapInPandas(stream, EMITTED)


def made(out: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(out, columns=["server_id", "key", "ts_ms", "event_id", "suppressed"]).astype({"event_id": "Int64"})


#: Levels of the tree below the number of tokens, least share of equal tokens, servers with a tree of their own.
DEPTH, SIMILAR, NAMESPACES = 3, 0.4, 16
ANY = "<*>"
TEMPLATED = "namespace string, leaf string, ts_ms long, event_id long, template_no long, template string, size long, is_new boolean"


class Leaf:
    """Templates of one leaf, all of the same number of tokens, in the order in which they came up.

    A line joins the template with the largest share of equal tokens, the first of several, if
    that share is SIMILAR or more; tokens that differ become ANY, which equals nothing. Tokens
    are numbered, so a line is compared with all templates at once.
    """

    def __init__(self, state: list | None = None, similar: float = SIMILAR):
        self.similar = similar
        self.words: list[list[str]] = [t.split(" ") for t, _ in state or []]
        self.sizes = [n for _, n in state or []]
        self.ids: dict[str, int] = {ANY: -1}
        self.table = np.full((max(8, len(self.words)), len(self.words[0]) if self.words else 0), -1, dtype=np.int64)
        for i, t in enumerate(self.words):
            self.table[i] = [self.ids.setdefault(w, len(self.ids)) for w in t]

    def dump(self) -> list | None:
        return [[" ".join(t), n] for t, n in zip(self.words, self.sizes, strict=True)] or None

    def add(self, tokens: list[str], n: int = 1) -> tuple[int, str, int, bool]:
        """(number of the template, the template with this line, its lines so far, whether it is new)."""
        line = np.array([self.ids.setdefault(w, len(self.ids)) for w in tokens], dtype=np.int64)
        if not self.words:
            self.table = np.full((8, len(tokens)), -1, dtype=np.int64)
        have = len(self.words)
        same = ((self.table[:have] == line) & (line >= 0)).sum(axis=1)
        best = int(same.argmax()) if have else -1
        fresh = not have or same[best] < self.similar * len(tokens)
        if fresh:
            best = have
            if have == len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
            self.table[have] = line
            self.words.append(list(tokens))
            self.sizes.append(0)
        else:
            for i in np.flatnonzero(self.table[best] != line).tolist():
                self.table[best, i], self.words[best][i] = -1, ANY
        self.sizes[best] += n
        return best, " ".join(self.words[best]), self.sizes[best], fresh


def masked(text: str) -> Column:
    """Tokens of a text, those with digits as ANY."""
    return F.transform(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "), lambda w: F.when(w.rlike("[0-9]"), ANY).otherwise(w))


def leaves(rows: DataFrame, server: str, text: str, namespaces: list[str] | None = None, depth: int = DEPTH) -> DataFrame:
    """rows with namespace, leaf (number of tokens and the first `depth` of them) and tokens, joined by spaces.

    namespaces: the servers with a tree of their own, of which the first NAMESPACES count; rows
    of others go to `default`. None: every server has one. A null text has one empty token.
    """
    own = F.col(server) if namespaces is None else F.when(F.col(server).isin(namespaces[:NAMESPACES]), F.col(server)).otherwise("default")
    tokens = masked(F.coalesce(F.col(text), F.lit("")))
    found = rows.withColumn("_tokens", tokens).withColumn("namespace", F.coalesce(own, F.lit("default")))
    leaf = F.concat_ws(" ", F.size("_tokens").cast("string"), F.array_join(F.slice("_tokens", 1, depth), " "))
    return found.withColumn("leaf", leaf).withColumn("tokens", F.array_join("_tokens", " ")).drop("_tokens")


def templates(rows: DataFrame, server: str, text: str, ts: str = "ts_ms", seq: str = "event_id", namespaces: list[str] | None = None) -> DataFrame:
    """Each row's template as it is when the row comes, how many rows it has by then, and whether it is new.

    The tree's upper levels are dealt out as keys; a leaf's rows are read in the order of
    (ts, seq), batch by batch, and only its templates are held.
    """
    group = ["namespace", "leaf"]

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, leaf = None, Leaf()
        for pdf in batches:
            out = []
            for n, k, t, e, tokens in zip(*[pdf[c].tolist() for c in (*group, ts, seq, "tokens")], strict=True):
                if (n, k) != now:
                    now, leaf = (n, k), Leaf()
                out.append((n, k, t, e, *leaf.add(tokens.split(" "))))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in TEMPLATED.split(", ")])

    dealt = leaves(rows, server, text, namespaces).select(*group, ts, seq, "tokens")
    return dealt.repartition(*group).sortWithinPartitions(*group, ts, seq).mapInPandas(stream, TEMPLATED)


def mine_templates(rows: DataFrame, server: str, text: str, depth: int = DEPTH) -> DataFrame:
    """server, template_id, template, n: the templates of each server's tree over its distinct masked lines in order.

    Lines are counted as distinct masked ones first; a leaf's lines are read in order, batch
    by batch, so servers and leaves are mined in parallel and only templates are held.
    """
    group = ["namespace", "leaf"]
    lines = leaves(rows, server, text, depth=depth).groupBy(*group, "tokens").agg(F.count("*").alias("n"))

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, leaf = None, Leaf()

        def made() -> pd.DataFrame:
            return pd.DataFrame([(now[0], t, n) for t, n in leaf.dump() or []], columns=["server_id", "template", "n"])

        for pdf in batches:
            for s, k, tokens, n in zip(*[pdf[c].tolist() for c in (*group, "tokens", "n")], strict=True):
                if (s, k) != now:
                    if now:
                        yield made()
                    now, leaf = (s, k), Leaf()
                leaf.add(tokens.split(" "), n)
        if now:
            yield made()

    mined = lines.repartition(*group).sortWithinPartitions(*group, "tokens").mapInPandas(stream, "server_id string, template string, n long")
    return mined.groupBy("server_id", "template").agg(F.sum("n").alias("n")).select("server_id", F.substring(F.sha1(F.concat_ws("|", "server_id", "template")), 1, 16).alias("template_id"), "template", "n")
