"""Joins of the engine: intervals, nearest rows, neighbours, containment, lifecycle, routing, reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlog.operators.windows import rank_globally
from loomlog.sources.shared import written


def tag_intervals(rows: DataFrame, events: DataFrame, key: str, ts: str, row_id: str, slot_ms: int = 300_000) -> DataFrame:
    """rows with kind: that of the first event (start, kind) of its key whose [start_ms, end_ms] holds ts, else null.

    Events are spread over the time slots they touch, so it is an equi-join on key and slot.
    """
    slot = F.explode(F.sequence(F.floor(F.col("start_ms") / slot_ms), F.floor(F.col("end_ms") / slot_ms)))
    spread = events.select(F.col(key).alias("_k"), "kind", "start_ms", "end_ms", slot.alias("_slot"))
    cond = (F.col(key) == F.col("_k")) & (F.floor(F.col(ts) / slot_ms) == F.col("_slot")) & F.col(ts).between(F.col("start_ms"), F.col("end_ms"))
    hits = rows.join(spread, cond).groupBy(row_id).agg(F.min(F.struct("start_ms", "kind")).alias("_e"))
    return rows.join(hits, row_id, "left").withColumn("kind", F.col("_e.kind")).drop("_e")


def neighbours(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, left_ts: str, right_id: str, right_ts: str, slot_ms: int = 3_600_000) -> DataFrame:
    """left_id with _back and _ahead: struct<t, i> of the last right row of equal keys up to its time and the first one from it on; of equal times the smallest id.

    By merging both sides in time order: the last right row before and the first one after
    each left row are running values, so no pairs are made. They run within time slots; what
    is last or first beyond a slot comes from one row a slot, so a busy key is many groups.
    """
    a = left.select(*keys, F.col(left_id).alias("_id"), F.col(left_ts).alias("_ts"), F.lit(1).alias("_side"))
    b = right.select(*keys, F.col(right_id).alias("_id"), F.col(right_ts).alias("_ts"), F.lit(0).alias("_side"))
    both = a.unionByName(b).withColumn("_slot", F.floor(F.col("_ts") / slot_ms))
    mine = F.when(F.col("_side") == 0, F.struct(F.col("_ts").alias("t"), F.col("_id").alias("i")))
    ends = both.groupBy(*keys, "_slot").agg(F.max_by(mine, F.when(F.col("_side") == 0, F.struct("_ts", -F.col("_id")))).alias("_last"), F.min(mine).alias("_first"))
    over = Window.partitionBy(*keys).orderBy("_slot")
    over_back = Window.partitionBy(*keys).orderBy(F.desc("_slot"))
    beyond = ends.select(*keys, "_slot", F.last("_last", True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.last("_first", True).over(over_back.rowsBetween(Window.unboundedPreceding, -1)).alias("_after"))
    back = Window.partitionBy(*keys, "_slot").orderBy("_ts", "_side", F.desc("_id")).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys, "_slot").orderBy(F.desc("_ts"), "_side", F.desc("_id")).rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("_b", F.last(mine, True).over(back)).withColumn("_f", F.last(mine, True).over(ahead)).where("_side = 1").join(beyond, [*keys, "_slot"])
    return near.select(*keys, F.col("_id").alias(left_id), F.col("_ts").alias(left_ts), F.coalesce("_b", "_before").alias("_back"), F.coalesce("_f", "_after").alias("_ahead"))


def _nearer(ts: Column) -> Column:
    """struct<d, i> of the nearer neighbour, the smaller id of two equally near; null without any."""
    gap = lambda c: F.when(c.isNotNull(), F.struct(F.abs(c["t"] - ts).alias("d"), c["i"].alias("i")))
    return F.least(gap(F.col("_back")), gap(F.col("_ahead")))


def nearest(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, left_ts: str, right_id: str, right_ts: str, slot_ms: int = 3_600_000) -> DataFrame:
    """left_id with the right_id of equal keys that is nearest in time; ties go to the smaller id. Null without any."""
    found = neighbours(left, right, keys, left_id, left_ts, right_id, right_ts, slot_ms)
    return found.select(left_id, _nearer(F.col(left_ts))["i"].alias(right_id))


def located(issues: DataFrame, records: DataFrame, issue: str, samples: str, record: str, text: str, ts: str, most: int = 20) -> DataFrame:
    """Where the evidence of issues stands: (issue, tier, record), the first `most` records of an issue by id.

    issues: a whole-number id, first_ms, last_ms and an array of sample texts. Tier 1: for each
    sample the record of equal text nearest to first_ms. Issues without any: tier 2, the first
    record of [first_ms, last_ms] (either way round), else tier 3, the record nearest to its
    start. No pairs are made: each tier is a merge in time order. Without records, no rows.
    """
    low, high = F.least("first_ms", "last_ms"), F.greatest("first_ms", "last_ms")
    told = issues.select(F.col(issue).alias("_issue"), F.coalesce("first_ms", "last_ms").alias("_at"), low.alias("_low"), high.alias("_high"), F.col(samples).alias("_samples"))
    lines = told.select("_issue", "_at", F.explode(F.array_distinct("_samples")).alias("_text")).where("_text IS NOT NULL")
    seen = records.select(F.col(record).alias("_record"), F.col(ts).alias("_ts"), F.col(text).alias("_text"))
    # one left row a text and time, as issues may share both
    asked = lines.groupBy("_text", "_at").agg(F.min("_issue").alias("_one"), F.collect_set("_issue").alias("_issues"))
    same = neighbours(asked.select("_text", "_at", "_one"), seen, ["_text"], "_one", "_at", "_record", "_ts")
    same = same.withColumn("_record", _nearer(F.col("_at"))["i"]).where("_record IS NOT NULL")
    by_text = same.join(asked.select("_text", "_at", "_issues"), ["_text", "_at"]).select(F.explode("_issues").alias("_issue"), "_record").distinct()
    by_text = written(by_text, "by_text")  # read twice, as is the rest
    rest = told.join(by_text.select("_issue").distinct(), "_issue", "left_anti").where("_low IS NOT NULL").withColumn("_all", F.lit(0)).drop("_samples")
    rest = written(rest, "rest")
    near = neighbours(rest.select("_all", "_issue", "_low"), seen.withColumn("_all", F.lit(0)), ["_all"], "_issue", "_low", "_record", "_ts")
    near = near.join(rest.select("_issue", "_high"), "_issue").where("_back IS NOT NULL OR _ahead IS NOT NULL")
    inside = F.coalesce(F.col("_ahead.t") <= F.col("_high"), F.lit(False))
    by_time = near.select("_issue", F.when(inside, 2).otherwise(3).alias("tier"), F.when(inside, F.col("_ahead.i")).otherwise(_nearer(F.col("_low"))["i"]).alias("_record"))
    ranked = by_text.withColumn("_n", F.row_number().over(Window.partitionBy("_issue").orderBy("_record"))).where(F.col("_n") <= most)
    out = ranked.select("_issue", F.lit(1).alias("tier"), "_record").unionByName(by_time)
    return out.select(F.col("_issue").alias(issue), "tier", F.col("_record").alias(record))


def top_matches(rows: DataFrame, wanted: DataFrame, keys: list[str], order: list, k: int = 3) -> DataFrame:
    """The last k rows of each wanted key. Rows are ranked before the keys are joined."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.join(wanted.select(*keys).distinct(), keys, "left_semi").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)


def contained(samples: DataFrame, rows: DataFrame, sample: str, text: str, most: int = 1000, order: list | None = None) -> DataFrame:
    """Pairs where one text holds the other. rows: only the first `most` by `order` are compared; that bound makes it fit to broadcast."""
    few = rows.orderBy(*(order or [text])).limit(most)
    return samples.join(F.broadcast(few), F.col(sample).contains(F.col(text)) | F.col(text).contains(F.col(sample)))


def around(rows: DataFrame, hits: Column, order: list[str], n: int, keys: list[str] | None = None) -> DataFrame:
    """Rows that stand at most n places from a hit, in the given order, within keys (not null) or over all rows.

    Places are ranks of one range-partitioned sort by keys and order, so no key is a task;
    the hits' neighbouring ranks are what is joined.
    """
    keys = keys or []
    placed = rank_globally(rows, [*keys, *order])
    near = placed.where(hits).select(*keys, F.explode(F.sequence(F.col("_rank") - n, F.col("_rank") + n)).alias("_rank")).distinct()
    return placed.join(near, [*keys, "_rank"], "left_semi").drop("_rank")


def lifecycle(now: DataFrame, before: DataFrame, key: str, ts: str, continuity_ms: int = 1_800_000) -> DataFrame:
    """key and status: new, ongoing (seen before, within the continuity gap), or recovered (no more seen)."""
    a, b = now.select(key, F.col(ts).alias("now_ms")), before.select(key, F.col(ts).alias("before_ms"))
    both = a.join(b, key, "full_outer")
    status = F.when(F.col("now_ms").isNull(), "recovered").when(F.col("before_ms").isNull() | (F.col("now_ms") - F.col("before_ms") > continuity_ms), "new").otherwise("ongoing")
    return both.select(key, status.alias("status"))


def route(rows: DataFrame, targets: DataFrame, everywhere: list[str], server: str = "server_id") -> DataFrame:
    """rows once for each target of their server, and for each global one. targets: (server, target), a configured list."""
    known = targets.groupBy(server).agg(F.collect_set("target").alias("_t"))
    all_of = F.array(*[F.lit(x) for x in everywhere]).cast("array<string>")
    out = rows.join(F.broadcast(known), server, "left")
    return out.withColumn("target", F.explode(F.array_distinct(F.concat(F.coalesce("_t", F.array().cast("array<string>")), all_of)))).drop("_t")


def merge_suggestions(issues: DataFrame, suggestions: DataFrame, keys: list[str], order: list) -> DataFrame:
    """issues with the first suggestion of their key; suggestions for no issue fall away."""
    first = suggestions.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")
    return issues.join(first, keys, "left")


def drop_reviewed(issues: DataFrame, decisions: DataFrame, keys: list[str], least: float = 0.65) -> DataFrame:
    """issues without those a review drops with confidence."""
    return issues.join(decisions.where((F.col("decision") == "drop") & (F.col("confidence") >= least)), keys, "left_anti")
