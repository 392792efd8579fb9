"""The streaming forms: same columns, same rules, with watermarks and keyed state.

Operators that go by the order of rows hold them in their state until the watermark has passed
their time: no row can come before them any more then, so a stream gives what its batch twin
gives on the same rows, however they were shuffled within the watermark's delay.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from operator import add
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomlog.functions import text as t
from loomlog.operators import windows
from loomlog.operators.loops import EMITTED, TEMPLATED, WINDOW_MS, Entry, Leaf, candidate, leaves
from loomlog.sources.tail import tail

LATE_MS = 600_000
LATE = f"{LATE_MS // 60_000} minutes"
#: Bytes of a row group of a micro-batch's file: what one task reads of it at least.
ROW_GROUP = 1 << 20
#: Templates of a server that have a baseline, and how long an unseen one keeps it.
MOST_TEMPLATES, TTL_MS = 500, 24 * 3_600_000


def with_time(rows: DataFrame, ts: str = "ts_ms", late: str = LATE) -> DataFrame:
    """rows with ts (timestamp) and its watermark; rows later than that are dropped by stateful operators."""
    return rows.withColumn("ts", F.timestamp_millis(ts)).withWatermark("ts", late)


def distinct(rows: DataFrame, key: str = "dedupe_key") -> DataFrame:
    """One row of each key while the watermark holds it; within a micro-batch any of them."""
    return with_time(rows).dropDuplicatesWithinWatermark([key])


def first_of_slot(rows: DataFrame, keys: list[str], slot: str, order: list[str]) -> DataFrame:
    """The first row (by order) of each key and time slot, once the slot is closed: keys, order and no other columns."""
    w = F.window("ts", slot)
    best = F.min(F.struct(*order)).alias("_first")
    return with_time(rows).groupBy(*keys, w).agg(best).select(*keys, *[F.col(f"_first.{c}").alias(c) for c in order])


def minutes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts per key and minute, emitted when the minute is closed: the input of the anomaly baseline."""
    return with_time(rows).groupBy(*keys, F.window("ts", "1 minute")).agg(F.count("*").alias("n")).select(*keys, F.unix_millis("window.start").alias("minute_ms"), "n")


def sessions(rows: DataFrame, keys: list[str], gap: str = "5 minutes") -> DataFrame:
    """Stretches of a key without a gap of more than `gap`, emitted when closed."""
    w = F.session_window("ts", gap)
    return with_time(rows).groupBy(*keys, w).agg(F.count("*").alias("n"), F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("end_ms")).select(*keys, "start_ms", "end_ms", "n")


def in_order(rows: DataFrame, keys: list[str], columns: list[str], machine: Callable[[Any], Any], schema: str) -> DataFrame:
    """What machines (one a key) give for the rows of their key, fed by (ts, seq): rows of `schema`, the keys first.

    columns: ts and seq, whole numbers, and what else a machine is fed. machine(state) makes
    one from what its dump() gave (None: a new one); feed(row) and expire(now) give rows, due()
    the event time from which it waits for no row (None: it waits for ever). A machine whose
    time is over and that has nothing to dump goes. Rows that wait are those of the watermark's delay.
    """
    names = [x.split()[0] for x in schema.split(", ")]

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, kept = (json.loads(x) for x in state.get) if state.exists else ([], None)
        if not state.hasTimedOut:
            for pdf in batches:
                held += zip(*[pdf[c].tolist() for c in columns], strict=True)
        now, own, out = state.getCurrentWatermarkMs(), machine(kept), []
        held = sorted(map(tuple, held), key=lambda r: r[:2])
        ready = next((i for i, r in enumerate(held) if r[0] > now), len(held))
        for r in held[:ready]:
            out += own.feed(*r)
        held = held[ready:]
        if own.due() is not None and own.due() <= now:
            out += own.expire(now)
        kept = own.dump()
        if held or kept is not None:
            state.update((json.dumps(held), json.dumps(kept)))
            times = [x for x in (held[0][0] if held else None, own.due()) if x is not None]
            if times:
                state.setTimeoutTimestamp(min(times))
        elif state.exists:
            state.remove()
        if out:
            made = pd.DataFrame([(*k, *x) for x in out], columns=names)
            yield made.astype({n: "Int64" for n, kind in (x.split() for x in schema.split(", ")) if kind == "long" and n not in keys})

    keyed = with_time(rows, columns[0]).groupBy(*keys)
    return keyed.applyInPandasWithState(step, schema, "held string, kept string", "append", GroupStateTimeout.EventTimeTimeout)


class Suppressor:
    """The loop filter of a key (see operators.loops.Entry)."""

    def __init__(self, state: list | None):
        self.fresh, self.entry = state is None, Entry(*(state or (0, 0, 0)))

    def dump(self) -> list | None:
        return None if self.fresh else [self.entry.last, self.entry.emitted, self.entry.held]

    def feed(self, ts: int, seq: int) -> list[tuple]:
        fresh, self.fresh = self.fresh, False
        return self.entry.feed(ts, seq, fresh)

    def due(self) -> int | None:
        return None if self.fresh else self.entry.last + WINDOW_MS

    def expire(self, now: int) -> list[tuple]:
        self.fresh = True
        return self.entry.drain()


def suppress(rows: DataFrame, server: str = "server_id", key: str = "key", ts: str = "ts_ms", event_id: str = "event_id") -> DataFrame:
    """The loop filter as keyed state; what is held back comes out when event time has passed the window."""
    return in_order(rows, [server, key], [ts, event_id], Suppressor, EMITTED)


def loop_filter(rows: DataFrame, level: str = "level", text: str = "message", server: str = "server_id", key: str = "key", ts: str = "ts_ms", event_id: str = "event_id") -> DataFrame:
    """All rows through the loop filter: those that may be a loop by suppress(), all others as they come."""
    may = candidate(F.col(level), F.col(text))
    others = rows.where(~may).select(F.col(server).alias("server_id"), F.col(key).alias("key"), F.col(ts).alias("ts_ms"), F.col(event_id).alias("event_id"), F.lit(0).cast("long").alias("suppressed"))
    return suppress(rows.where(may), server, key, ts, event_id).unionByName(others)


class Minutes:
    """The baseline of a key: its average, the open minute, its count and the total; a minute comes out when it is over."""

    def __init__(self, state: list | None):
        self.ewma, self.minute, self.n, self.total = state or (0.0, None, 0, 0)

    def dump(self) -> list | None:
        return [self.ewma, self.minute, self.n, self.total] if self.total else None

    def _closed(self) -> list[tuple]:
        n, before, self.n = self.n, self.ewma, 0
        if not n:
            return []
        self.ewma = windows.ALPHA * n + (1 - windows.ALPHA) * before
        return [(self.minute * windows.BUCKET_MS, n, before, self.total >= windows.LEAST_TOTAL and before > 0 and n >= windows.SPIKE * before)]

    def feed(self, ts: int, seq: int) -> list[tuple]:
        out = self._closed() if ts // windows.BUCKET_MS != self.minute else []
        self.minute, self.n, self.total = ts // windows.BUCKET_MS, self.n + 1, self.total + 1
        return out

    def due(self) -> int | None:
        if self.minute is None:
            return None
        return (self.minute + 1) * windows.BUCKET_MS - 1 if self.n else self.minute * windows.BUCKET_MS + TTL_MS

    def expire(self, now: int) -> list[tuple]:
        out = self._closed()
        if now >= self.minute * windows.BUCKET_MS + TTL_MS:
            self.total, self.minute = 0, None
        return out


def baseline(rows: DataFrame, keys: list[str], seq: str = "event_id") -> DataFrame:
    """Anomaly state per key: keys, minute_ms, n, ewma (before the minute) and spike, for each minute once it is closed.

    The state is dropped a day after the last row.
    """
    types = dict(rows.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in keys) + ", minute_ms long, n long, ewma double, spike boolean"
    return in_order(rows, keys, ["ts_ms", seq], Minutes, schema)


class Baselines:
    """The baselines of a server's templates: by template when last seen, rows so far, average, last counts, open minute and its count."""

    def __init__(self, state: list | None, most: int = MOST_TEMPLATES, ttl_ms: int = TTL_MS):
        self.most, self.ttl = most, ttl_ms
        self.known = {k: list(v) for k, *v in state or []}  # longest unseen first

    def dump(self) -> list | None:
        return [[k, *v] for k, v in self.known.items()] or None

    def feed(self, ts: int, seq: int, template: str) -> list[tuple]:
        last, total, ewma, ring, minute, n = self.known.pop(template, (ts, 0, 0.0, [], None, 0))
        if ts - last > self.ttl:
            total, ewma, ring, minute, n = 0, 0.0, [], None, 0
        if minute != ts // windows.BUCKET_MS:
            if n:
                ewma, ring = windows.ALPHA * n + (1 - windows.ALPHA) * ewma, [*ring, n][-windows.RING :]
            minute, n = ts // windows.BUCKET_MS, 0
        total, n = total + 1, n + 1
        self.known[template] = [ts, total, ewma, ring, minute, n]
        if len(self.known) > self.most:
            del self.known[next(iter(self.known))]
        p95 = float(sorted(ring)[min(int(len(ring) * windows.PERCENTILE), len(ring) - 1)]) if len(ring) >= windows.LEAST_WINDOW else None
        return [(template, ts, seq, n, total, ewma, p95, *windows.scored(n, total, ewma, p95))]

    def due(self) -> int | None:
        return next(iter(self.known.values()))[0] + self.ttl if self.known else None

    def expire(self, now: int) -> list[tuple]:
        self.known = {k: v for k, v in self.known.items() if v[0] + self.ttl > now}
        return []


def anomalies(rows: DataFrame, server: str = "server_id", template: str = "template_id", ts: str = "ts_ms", seq: str = "event_id", most: int = MOST_TEMPLATES, ttl_ms: int = TTL_MS) -> DataFrame:
    """Each row's place in its minute and its template's baseline, as operators.windows.anomalies has them.

    A server is one state: of more than `most` templates the one unseen for longest is
    forgotten, and so is one that wasn't seen for ttl_ms. A server with more rows than one task
    can feed is to be split by a hash of the template (as a part of `server`), each part with a `most` of its own.
    """
    types = dict(rows.dtypes)
    schema = f"{server} {types[server]}, {template} string, {ts} long, {seq} long, in_bucket long, total long, ewma double, p95 double, score double, reason string, is_anomaly boolean"
    return in_order(rows.withColumn(template, F.col(template).cast("string")), [server], [ts, seq, template], lambda state: Baselines(state, most, ttl_ms), schema)


class Templates:
    """The templates of a leaf of a server's tree."""

    def __init__(self, state: list | None):
        self.leaf = Leaf(state)

    def dump(self) -> list | None:
        return self.leaf.dump()

    def feed(self, ts: int, seq: int, tokens: str) -> list[tuple]:
        number, template, size, fresh = self.leaf.add(tokens.split(" "))
        return [(ts, seq, number, template, size, fresh)]

    def due(self) -> None:
        return None


def templates(rows: DataFrame, server: str = "server_id", text: str = "message", ts: str = "ts_ms", seq: str = "event_id", namespaces: list[str] | None = None) -> DataFrame:
    """Each row's template as it is then, how many rows it has, and whether it is new: operators.loops.templates as a stream.

    The upper levels of the tree (number of tokens, first tokens) are the key, a leaf's
    templates are the state, which is kept for good.
    """
    return in_order(leaves(rows, server, text, namespaces), ["namespace", "leaf"], [ts, seq, "tokens"], Templates, TEMPLATED)


def late_apart(rows: DataFrame, folder: str, late_ms: int = LATE_MS, ts: str = "ts_ms", seconds: int = 3600, step: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Run a stream over all that is there; (rows in time, rows behind the watermark), each a table in the folder.

    The watermark of a step is the largest time of those before less late_ms. A step is a
    micro-batch or, where `step` names a column of whole numbers, its rows of one number: a
    micro-batch may hold many, but none may go on in the next one. What is kept goes by
    micro-batch, so one that is run again is split alike and replaces itself.
    """
    spark = rows.sparkSession
    marks = f"{folder}/marks"

    def split(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        before = read(session, "batch long, high long", marks).where(F.col("batch") < number).agg(F.max("high")).first()[0]
        known = F.lit(before).cast("long")
        batch.persist()
        marked = batch.withColumn("_high", known)
        if step:
            tops = batch.groupBy(F.col(step).alias("_step")).agg(F.max(ts).cast("long").alias("_top"))  # a row a step, so few
            ahead = F.max("_top").over(Window.orderBy("_step").rowsBetween(Window.unboundedPreceding, -1))
            each = tops.select("_step", F.greatest(ahead, known).alias("_high"))
            marked = batch.join(F.broadcast(each), F.col(step).eqNullSafe(F.col("_step")), "left").drop("_step")
        late = F.coalesce(F.col(ts) < F.col("_high") - late_ms, F.lit(False))
        for name, chosen in (("in_time", ~late), ("late", late)):
            marked.where(chosen).drop("_high").write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
        high = batch.agg(F.greatest(F.max(ts), known).alias("high"))
        high.select(F.lit(number).cast("long").alias("batch"), F.col("high").cast("long")).write.mode("overwrite").parquet(f"{marks}/n={number}")
        batch.unpersist()

    def read(session: SparkSession, schema: str, path: str) -> DataFrame:
        at = session._jvm.org.apache.hadoop.fs.Path(path)
        if not at.getFileSystem(session._jsc.hadoopConfiguration()).exists(at):
            return session.createDataFrame([], schema)
        return session.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)

    query = rows.writeStream.foreachBatch(split).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    if not query.awaitTermination(seconds):
        query.stop()
        raise TimeoutError(f"the stream took more than {seconds} s")
    return tuple(read(spark, rows.schema, f"{folder}/{name}") for name in ("in_time", "late"))


def alerts(issues: DataFrame, cooldown_ms: int = 600_000) -> DataFrame:
    """(server, category, tag, first_ms) of alerts: none within the cooldown after the last one of its key.

    The state of a key is the time of its last alert, and is dropped when that is over.
    """
    types = {"server": "server string", "category": "category string", "tag": "tag string"}

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, out = state.get[0] if state.exists else None, []
        for ms in sorted(int(x) for pdf in batches for x in pdf.first_ms):
            if last is None or ms - last >= cooldown_ms:
                last = ms
                out.append((*k, ms))
        if last is not None:
            state.update((last,))
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + cooldown_ms + 1)
        if out:
            yield pd.DataFrame(out, columns=[*types, "first_ms"])

    rows = issues.where("alert").select("category", "tag", "first_ms", F.explode("servers").alias("server"))
    keyed = with_time(rows, "first_ms").groupBy(*types)
    return keyed.applyInPandasWithState(step, ", ".join(types.values()) + ", first_ms long", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def arriving(rows: DataFrame, arrival: Column, folder: str, slice_ms: int, end: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """A stream of rows as they arrive: each slice of arrival times is a micro-batch. Rows of `end` come after all others, a micro-batch each of its column `slice`.

    most: neighbouring slices make one micro-batch until they hold one in `most` of all rows,
    so there are no more than twice as many, however long the rows' time is. Each is written by
    a task of its own.
    """
    spark = rows.sparkSession
    sliced = rows.withColumn("slice", F.floor(arrival / slice_ms).cast("long"))
    if most:
        firsts = joined(sliced.groupBy("slice").agg(F.count("*").alias("n")).collect(), most)  # one number a slice
        at_least = [F.coalesce((F.col("slice") >= x).cast("long"), F.lit(0)) for x in firsts]  # one case each: a filter of a list isn't compiled
        sliced = sliced.withColumn("slice", reduce(add, at_least, F.lit(0).cast("long")))
    if end is not None:
        last = len(firsts) if most else sliced.agg(F.max("slice")).first()[0] or 0
        sliced = sliced.unionByName(end.withColumn("slice", F.col("slice") + F.lit(last + 1)), allowMissingColumns=True)
    dealt = sliced.repartitionById(len(firsts) + 1, F.col("slice").cast("int")) if most else sliced.repartition("slice")
    dealt.write.partitionBy("slice").option("parquet.block.size", ROW_GROUP).parquet(folder)  # a micro-batch is written by one task, and read by as many as it has row groups
    fs = spark._jvm.org.apache.hadoop.fs
    root = fs.Path(folder)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    folders = sorted((int(x.getPath().getName().partition("=")[2]), x.getPath()) for x in system.listStatus(root) if "=" in x.getPath().getName())
    for i, (_, at) in enumerate(folders):  # files come in the order of their times
        for f in system.listStatus(at):
            system.setTimes(f.getPath(), 1_600_000_000_000 + i * 1000, -1)
    schema = sliced.drop("slice").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("maxFileAge", "36500d").parquet(folder)


def joined(sizes: Iterable[tuple[int, int]], most: int) -> list[int]:
    """The first slices of stretches of (slice, rows) that hold one in `most` of all rows or are a slice that is larger."""
    sizes = sorted(tuple(x) for x in sizes)
    firsts, held, least = [], 0, sum(n for _, n in sizes) / most
    for number, n in sizes:
        if not firsts or held + n > least:
            firsts.append(number)
            held = 0
        held += n
    return firsts


def run_once(rows: DataFrame, folder: str, mode: str = "append", seconds: int = 3600, parts: int | None = None) -> DataFrame:
    """Run a stream over all that is there, into a table in the folder, and read that. Called again, it goes on where it stopped; an error after `seconds`.

    parts: in how many parts keyed state is dealt at most, which the first run settles. Each of
    them is a task of every micro-batch, whether it has rows or not. None: the session's number.
    """
    conf, name = rows.sparkSession.conf, "spark.sql.shuffle.partitions"
    before = conf.get(name)
    if parts:
        conf.set(name, str(min(parts, int(before))))
    try:  # a query takes the session's settings when it starts
        query = rows.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/out").trigger(availableNow=True).start()
    finally:
        conf.set(name, before)
    if not query.awaitTermination(seconds):
        query.stop()
        raise TimeoutError(f"the stream took more than {seconds} s")
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{folder}/out")


def ingest(spark: SparkSession, path: str, folder: str, now_ms: int, server_id: str | None = None, **options: str) -> DataFrame:
    """Lines appended to log files since the last call, parsed and stored; all stored rows, each event once.

    The server is the folder of a file, unless it is given. Files may be renamed, gzipped or
    begun anew between calls (see sources.tail). Event ids are made of server, time and print
    of a line, so an archive that is read a second time brings the same events.
    """
    lines = tail(spark, path, state=f"{folder}/files", **options).where(F.trim("line") != "")
    server = F.regexp_extract("path", "([^/]+)/[^/]+$", 1) if server_id is None else F.lit(server_id)
    ts = t.timestamp_ms(t.time_parts(F.col("line")), t.file_date(F.col("path")), F.lit(0), F.lit(now_ms))
    row = lines.select(server.alias("server_id"), ts.alias("ts_ms"), t.level(F.col("line")).alias("level"), "line")
    event = t.event_id(F.col("server_id"), F.col("ts_ms"), F.sha1("line"), F.lit(""))
    stored = run_once(row.withColumn("event_id", event), folder)
    return stored.groupBy("event_id").agg(*[F.first(c).alias(c) for c in ("server_id", "ts_ms", "level", "line")])
