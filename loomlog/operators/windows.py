"""Time windows: running counts, baselines, anomalies, floods and gap sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlog.functions import text as t
from loomlog.sources.shared import written

# Bucket, smoothing, spike factor, least total; percentile, its least history and ring; scores.
BUCKET_MS, ALPHA, SPIKE, LEAST_TOTAL = 60_000, 0.3, 3.0, 5
PERCENTILE, LEAST_WINDOW, RING = 0.95, 10, 50
#: Weights of older buckets than this vanish in a double.
EWMA_REACH = 110
HIGH_RATE, REPEAT, MEANINGLESS = (30_000, 8), (300_000, 5), (300_000, 3)
GAP_MS = 300_000


def history(rows: DataFrame, keys: list[str], ts: str = "ts_ms") -> DataFrame:
    """Per key and minute: n, before (rows of earlier minutes), ewma and p95 of closed minutes (null with too few).

    Rows are counted by minute first, so a busy key brings as many rows here as it has minutes.
    """
    counts = rows.withColumn("bucket", F.floor(F.col(ts) / BUCKET_MS)).groupBy(*keys, "bucket").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy("bucket")
    past = F.collect_list("n").over(w.rowsBetween(-EWMA_REACH, -1))
    ring = F.sort_array(F.collect_list("n").over(w.rowsBetween(-RING, -1)))
    at = F.least(F.floor(F.size("ring") * PERCENTILE).cast("int"), F.size("ring") - 1)
    out = counts.withColumn("past", past).withColumn("ring", ring).withColumn("before", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ewma = F.aggregate("past", F.lit(0.0), lambda a, x: ALPHA * x + (1 - ALPHA) * a)
    return out.select(*keys, "bucket", "n", "before", ewma.alias("ewma"), F.when(F.size("ring") >= LEAST_WINDOW, F.get("ring", at)).cast("double").alias("p95"))


def running(rows: DataFrame, keys: list[str], order: list[str], ts: str = "ts_ms") -> DataFrame:
    """rows with bucket, in_bucket (count so far in the minute), total (so far), ewma and p95."""
    w = Window.partitionBy(*keys, "bucket").orderBy(*order)
    own = rows.withColumn("bucket", F.floor(F.col(ts) / BUCKET_MS)).withColumn("in_bucket", F.row_number().over(w))
    return own.join(history(rows, keys, ts).drop("n"), [*keys, "bucket"]).withColumn("total", F.col("before") + F.col("in_bucket")).drop("before")


def anomalies(rows: DataFrame, keys: list[str], order: list[str], ts: str = "ts_ms") -> DataFrame:
    """running() with score, reason and is_anomaly of each row."""
    c, e, p = F.col("in_bucket"), F.col("ewma"), F.col("p95")
    spike = (F.col("total") >= LEAST_TOTAL) & (e > 0) & (c >= e * SPIKE)
    by_ewma = F.when(spike, F.least(F.lit(1.0), (c / F.greatest(e, F.lit(0.1)) - 1) / 10)).otherwise(0.0)
    by_rank = F.when((p > 0) & (c > p * 1.5), F.least(F.lit(1.0), (c / F.greatest(p, F.lit(0.1)) - 1) / 5)).otherwise(0.0)
    first = F.col("total") == 1
    out = running(rows, keys, order, ts).withColumn("e", by_ewma).withColumn("r", by_rank)
    reason = F.when(F.col("r") > F.col("e"), "percentile_spike").when(spike, "ewma_spike").when(first, "new_template").otherwise("")
    score = F.greatest("e", "r", F.when(first, 0.3).otherwise(0.0))
    return out.withColumn("score", score).withColumn("reason", reason).withColumn("is_anomaly", score >= 0.5).drop("e", "r")


def scored(in_bucket: int, total: int, ewma: float, p95: float | None) -> tuple[float, str, bool]:
    """(score, reason, is_anomaly) of one row, as anomalies() has them: for rows that are fed one by one."""
    spike = total >= LEAST_TOTAL and ewma > 0 and in_bucket >= ewma * SPIKE
    by_ewma = min(1.0, (in_bucket / max(ewma, 0.1) - 1) / 10) if spike else 0.0
    by_rank = min(1.0, (in_bucket / max(p95, 0.1) - 1) / 5) if p95 and in_bucket > p95 * 1.5 else 0.0
    reason = "percentile_spike" if by_rank > by_ewma else "ewma_spike" if spike else "new_template" if total == 1 else ""
    score = max(by_ewma, by_rank, 0.3 if total == 1 else 0.0)
    return score, reason, score >= 0.5


#: Length of the time slots that one key's rows are dealt into.
SLOT_MS = 3_600_000


def first_crowd(rows: DataFrame, key: str, ts: str, seq: str, window_ms: int, least: int, slot_ms: int = SLOT_MS) -> DataFrame:
    """Per key the first row from which `least` rows or more lie within window_ms: key, start_ms, end_ms, n.

    A key's rows are dealt into time slots, each with a copy of the rows just behind it, so a
    busy key is many groups; the first of a key's slots is an aggregate.
    """
    slot = F.floor(F.col(ts) / slot_ms)
    behind = F.when(F.col(ts) - slot * slot_ms <= window_ms, F.struct((slot - 1).alias("slot"), F.lit(True).alias("copy")))
    dealt = rows.select(key, ts, seq, F.inline(F.array_compact(F.array(F.struct(slot.alias("slot"), F.lit(False).alias("copy")), behind))))
    at = F.row_number().over(Window.partitionBy(key, "slot").orderBy(ts, seq))
    ahead = Window.partitionBy(key, "slot").orderBy(ts).rangeBetween(Window.unboundedPreceding, window_ms)
    counted = dealt.select(key, ts, seq, "copy", (F.count("*").over(ahead) - at + 1).alias("n"), F.max(ts).over(ahead).alias("end_ms"))
    best = F.min_by(F.struct(ts, "end_ms", "n"), F.struct(ts, seq))
    return counted.where((F.col("n") >= least) & ~F.col("copy")).groupBy(key).agg(best.alias("b")).select(key, F.col(f"b.{ts}").alias("start_ms"), "b.end_ms", "b.n")


def with_key(rows: DataFrame, message: str) -> DataFrame:
    """Rows whose message has a key, as norm; a generator keeps the expression in one place."""
    return rows.select("*", F.explode(F.filter(F.array(t.message_key(F.col(message))), lambda x: x != "")).alias("norm"))


#: Rows of one key, text and slot that one task pairs others with at most, about.
PIECE = 20_000


def repeat_pairs(rows: DataFrame, key: str, ts: str, seq: str, message: str, window_ms: int, piece: int = PIECE) -> DataFrame:
    """Similar messages of one key within window_ms, earlier first: key, a_ts, a_seq, b_ts, b_seq, once for each two rows.

    Texts of a key and time slot are compared once, however many rows have them. A row then
    meets the rows of its own text and of those found similar, in its slot and the next; a pair
    comes out of one such meeting only, so pairs are neither shuffled nor made distinct. Where
    a slot holds more than `piece` rows of one text, they are dealt to several tasks.
    """
    made = with_key(rows, message).select(key, F.col(ts).alias("ts"), F.col(seq).alias("seq"), "norm", F.floor(F.col(ts) / window_ms).alias("slot"))
    norm = written(made.where("slot IS NOT NULL"), "said")
    cells = norm.groupBy(key, "slot", "norm").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    cells = written(cells, "cells")
    busy = cells.where(F.col("n") > piece).groupBy(key, "norm").agg(F.ceil(F.max("n") / piece).cast("int").alias("pieces"))  # one in `piece` rows at most
    deal = lambda df: df.join(F.broadcast(busy), [key, "norm"], "left").withColumn("pieces", F.coalesce("pieces", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("ts", "seq"), F.col("pieces")).cast("int"))
    others = lambda name: F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias(name)
    a_rows = norm.select(key, "norm", "slot", F.col("ts").alias("a_ts"), F.col("seq").alias("a_seq"))
    own = a_rows.select(key, "norm", F.explode(F.array("slot", F.col("slot") + 1)).alias("slot"), "a_ts", "a_seq")
    links = similar_cells(cells, key, window_ms)
    linked = a_rows.join(links, [key, "norm", "slot"]).select(key, F.col("b_norm").alias("norm"), F.col("b_slot").alias("slot"), "a_ts", "a_seq")
    met = [key, "norm", "slot", "i", "j"]
    a = deal(own.unionByName(linked).select("*", F.col("a_ts").alias("ts"), F.col("a_seq").alias("seq"))).select(key, "norm", "slot", F.col("own").alias("i"), others("j"), "a_ts", "a_seq")
    b = deal(norm).select(key, "norm", "slot", others("i"), F.col("own").alias("j"), F.col("ts").alias("b_ts"), F.col("seq").alias("b_seq"))
    later = (F.col("b_ts") > F.col("a_ts")) | ((F.col("b_ts") == F.col("a_ts")) & (F.col("b_seq") > F.col("a_seq")))
    return a.join(b, met).where(later & (F.col("b_ts") - F.col("a_ts") <= window_ms)).select(key, "a_ts", "a_seq", "b_ts", "b_seq")


def similar_cells(cells: DataFrame, key: str, window_ms: int) -> DataFrame:
    """Different similar texts of one key (norm, slot, b_norm, b_slot) of which rows may lie within window_ms, b's not before a's slot.

    cells: key, slot, norm, first and last (times). Two similar texts share a similarity key, so
    it is an equi-join on those; of several the smallest gives the pair.
    """
    keyed = cells.select("*", F.explode(t.similarity_keys(F.col("norm"))).alias("sk"))
    b = keyed.select(key, "sk", F.explode(F.array("slot", F.col("slot") - 1)).alias("slot"), F.col("slot").alias("b_slot"), F.col("norm").alias("b_norm"), F.col("first").alias("b_first"), F.col("last").alias("b_last"))
    near = (F.col("b_last") >= F.col("first")) & (F.col("b_first") - F.col("last") <= window_ms)
    met = keyed.join(b, [key, "sk", "slot"]).where(near & (F.col("norm") != F.col("b_norm")) & t.similar(F.col("norm"), F.col("b_norm")))
    shared = F.array_min(F.array_intersect(t.similarity_keys(F.col("norm")), t.similarity_keys(F.col("b_norm"))))
    return met.where(F.col("sk") == shared).select(key, "norm", "slot", "b_norm", "b_slot")


def first_repeat(rows: DataFrame, key: str, ts: str, seq: str, message: str, window_ms: int = REPEAT[0], least: int = REPEAT[1]) -> DataFrame:
    """Per key the repetition that is complete first: key, start_ms, end_ms, n.

    Equal messages alone give a bound by a window function; what comes behind it can't be
    first and is dropped before the join, so floods of equal messages don't multiply.
    """
    equal = Window.partitionBy(key, "norm").orderBy(ts, seq)
    norm = with_key(rows, message)
    done = norm.withColumn("done", F.lead(F.struct(ts, seq), least - 1).over(equal)).where(F.col(f"done.{ts}") - F.col(ts) <= window_ms)
    bound = done.groupBy(key).agg(F.min("done").alias("bound"))
    early = norm.join(bound, key, "left").where(F.col("bound").isNull() | (F.struct(ts, seq) <= F.col("bound"))).drop("norm", "bound")
    pairs = repeat_pairs(early, key, ts, seq, message, window_ms)
    nth = Window.partitionBy(key, "a_ts", "a_seq").orderBy("b_ts", "b_seq")
    full = pairs.withColumn("nth", F.row_number().over(nth)).where(F.col("nth") == least - 1)
    best = F.min_by(F.struct("a_ts", "b_ts"), F.struct("b_ts", "b_seq", "a_ts", "a_seq"))
    return full.groupBy(key).agg(best.alias("b")).select(key, F.col("b.a_ts").alias("start_ms"), F.col("b.b_ts").alias("end_ms"), F.lit(least).cast("long").alias("n"))


def floods(chat: DataFrame, key: str = "player", ts: str = "ts_ms", seq: str = "seq", message: str = "chat_message") -> DataFrame:
    """All flood events of chat rows: key, kind, start_ms, end_ms, n. Rows without a player are no one's."""
    chat = written(chat.where(F.coalesce(F.col(key), F.lit("")) != "").select(key, ts, seq, message), "chat")  # parsed once for all kinds
    kinds = [
        ("high_frequency", first_crowd(chat, key, ts, seq, *HIGH_RATE)),
        ("repeat_content", first_repeat(chat, key, ts, seq, message)),
        ("meaningless", first_crowd(chat.where(t.meaningless(F.col(message))), key, ts, seq, *MEANINGLESS)),
    ]
    out = None
    for kind, rows in kinds:
        rows = rows.select(key, F.lit(kind).alias("kind"), "start_ms", "end_ms", "n")
        out = rows if out is None else out.unionByName(rows)
    return out


def slots(rows: DataFrame, keys: list[str], ts: str, gap_ms: int | Column, last: str | None = None) -> tuple[Column, DataFrame]:
    """The time slot of a row, and (keys, slot, session) for all slots.

    Rows less than a gap apart share a session, so slots as long as the gap hold one session
    each: rows are counted down to slots first, and only those are ordered per key. last: where
    a row stands for several of one slot, whose first time is ts, their last time.
    """
    gap = F.lit(gap_ms) if isinstance(gap_ms, int) else gap_ms
    slot = time_slot(ts, gap)
    short = rows.groupBy(*keys, slot.alias("_slot")).agg(F.min(ts).alias("_first"), F.max(last or ts).alias("_last"), F.first(gap).alias("_gap"))
    order = Window.partitionBy(*keys).orderBy(F.col("_slot").asc_nulls_last())
    split = F.when(F.col("_slot").isNotNull() & (F.col("_first") - F.lag("_last").over(order) > F.col("_gap")), 1).otherwise(0)
    return slot, short.withColumn("_split", split).select(*keys, "_slot", F.sum("_split").over(order).alias("session"))


def time_slot(ts: str, gap: Column) -> Column:
    """The number of the slot of a gap's length that a time lies in; null: without time."""
    return F.when(F.col(ts) != 0, F.floor(F.col(ts) / gap))


def sessions(rows: DataFrame, keys: list[str], ts: str = "ts_ms", seq: str = "seq", gap_ms: int | Column = GAP_MS) -> DataFrame:
    """rows with session: a new one begins after a gap of more than gap_ms. Rows without time (0) stand last and don't split."""
    slot, found = slots(rows, keys, ts, gap_ms)
    right = found.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_slot").alias("_s"), "session")
    cond = F.col("_slot").eqNullSafe(F.col("_s"))
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.withColumn("_slot", slot).join(right, cond).drop("_slot", "_s", *[f"_{k}" for k in keys])


def hours(rows: DataFrame, keys: list[str], ts: str = "ts_ms", cycle: int = 8) -> DataFrame:
    """rows with hour (start, ms) and cycle (of `cycle` hours from the first hour of the keys), aligned to UTC."""
    hour = F.floor(F.col(ts) / 3_600_000) * 3_600_000
    first = rows.groupBy(*keys).agg(F.min(hour).alias("_first"))
    return rows.withColumn("hour", hour).join(first, keys).withColumn("cycle", F.floor((F.col("hour") - F.col("_first")) / (3_600_000 * cycle))).drop("_first")


def even_sample(rows: DataFrame, order: list[str], k: int) -> DataFrame:
    """k rows at even steps, both ends kept; half steps go to the even neighbour. At most k rows: all.

    Ranks come from partition counts over a range-partitioned sort, not from one task.
    """
    spark = rows.sparkSession
    n = rows.count()
    if n <= k:
        return rows
    wanted = [n - 1] if k == 1 else sorted({round(i * ((n - 1) / (k - 1))) for i in range(k)})
    ranked = rank_globally(rows, order)
    places = spark.createDataFrame([(i,) for i in wanted], "_rank long")
    return ranked.join(F.broadcast(places), "_rank", "left_semi").drop("_rank")


def rank_globally(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with _rank from 0 in the given order, without a single-task window. Rows of equal order go by a hash of all columns (maps apart)."""
    hashed = [c for c, kind in rows.dtypes if "map<" not in kind and "variant" not in kind]
    order = [*order, F.xxhash64(*hashed)] if hashed else order
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = written(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranked")
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("n")).collect()  # one number a partition
    start, at = {}, 0
    for p, n in sorted((r["_part"], r["n"]) for r in sizes):
        start[p], at = at, at + n
    offset = F.element_at(F.create_map(*[F.lit(x).cast("long") for kv in start.items() for x in kv]), F.col("_part").cast("long")) if start else F.lit(0)
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.withColumn("_rank", offset + local - 1).drop("_part")
