"""Rollups, rankings and bounded samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomlog.functions.text import any_of
from loomlog.operators.windows import hours, rank_globally
from loomlog.sources.shared import written

STOP = ["the", "and", "for", "you", "that", "this"]


def gate(rows: DataFrame, active: list[str]) -> DataFrame:
    """Rows of the active categories; daily ones always pass."""
    return rows.where(F.col("gate").isin([*active, "daily"]))


def specific(rows: DataFrame, template: str) -> DataFrame:
    """Without templates of two or more fields that fix no longer word."""
    words = F.split(template, " ")
    fields = F.size(F.filter(words, lambda w: w.contains("<")))
    fixed = F.size(F.filter(words, lambda w: ~w.contains("<") & (F.length(w) > 3)))
    return rows.where(~((fields >= 2) & (fixed == 0)))


def terms(rows: DataFrame, keys: list[str], text: str, words: list[str], most: int = 8) -> DataFrame:
    """Which of the words occur, in the words' order."""
    hit = [F.max(F.lower(text).rlike(any_of([w]))).alias(f"w{i}") for i, w in enumerate(words)]
    found = F.array_compact(F.array(*[F.when(F.col(f"w{i}"), w) for i, w in enumerate(words)]))
    return rows.groupBy(*keys).agg(*hit).select(*keys, F.slice(found, 1, most).alias("terms"))


def levels(rows: DataFrame, keys: list[str], level: str = "level", tags: str = "tags", suppressed: str = "loop_suppressed") -> DataFrame:
    """keys, records, errors, warnings and suppressed: rows by level, by their tags where the level is empty, and the rows that summaries of loops stand for."""
    name, has = F.upper(F.trim(F.coalesce(F.col(level), F.lit("")))), lambda *x: F.coalesce(F.arrays_overlap(tags, F.array(*[F.lit(y) for y in x])), F.lit(False))
    error = name.isin("ERROR", "FATAL", "SEVERE") | ((name == "") & has("error"))
    warning = name.isin("WARN", "WARNING") | ((name == "") & has("warn", "warning"))
    held = F.when(has("loop_suppressed"), F.coalesce(F.col(suppressed).cast("long"), F.lit(0))).otherwise(0)
    return rows.groupBy(*keys).agg(F.count("*").alias("records"), F.count_if(error).alias("errors"), F.count_if(warning & ~error).alias("warnings"), F.sum(held).alias("suppressed"))


def topics(chat: DataFrame) -> DataFrame:
    """(what, name, n): histograms of category, severity and label, the five players who say most, and the number of players."""
    facts = F.concat(F.array(F.struct(F.lit("category").alias("what"), F.col("chat_category").alias("name")), F.struct(F.lit("severity").alias("what"), F.col("chat_severity").alias("name"))), F.transform("chat_labels", lambda x: F.struct(F.lit("label").alias("what"), x.alias("name"))))
    counts = chat.select(F.explode(facts).alias("f")).groupBy("f.what", "f.name").agg(F.count("*").alias("n"))
    talkers = chat.where("chat_player <> ''").groupBy(F.col("chat_player").alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(5)
    counts = counts.unionByName(talkers.select(F.lit("talker").alias("what"), "name", "n"))
    return counts.unionByName(chat.agg(F.count_distinct("chat_player").alias("n")).select(F.lit("players").alias("what"), F.lit("distinct").alias("name"), "n"))


def keywords(rows: DataFrame, text: str, k: int) -> DataFrame:
    """The k most frequent words of three letters and more, and pairs of CJK characters, seen twice at least."""
    latin = F.regexp_extract_all(F.lower(text), F.lit("[a-z]{3,}"), F.lit(0))
    runs = F.regexp_extract_all(F.col(text), F.lit("[\\x{4e00}-\\x{9fff}]{2,}"), F.lit(0))
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
    words = rows.select(F.explode(F.concat(latin, pairs)).alias("word")).where(~F.col("word").isin(STOP))
    return words.groupBy("word").agg(F.count("*").alias("n")).where("n >= 2").orderBy(F.desc("n"), "word").limit(k)


def anticheat(rows: DataFrame, most: int = 3) -> DataFrame:
    """player, n (weighted), checks: its most weighted checks."""
    by = rows.groupBy(F.col("cheat_player").alias("player"), F.col("cheat_check").alias("c")).agg(F.sum("weight").alias("w"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("w"), "c")))
    return by.groupBy("player").agg(F.sum("w").alias("n"), ranked.alias("r")).select("player", "n", F.array_join(F.transform(F.slice("r", 1, most), lambda x: x["c"]), ",").alias("checks"))


def anticheat_checks(rows: DataFrame) -> DataFrame:
    """check, n (weighted), players, first_ms, last_ms of anticheat rows."""
    by = rows.groupBy(F.col("cheat_check").alias("check"))
    return by.agg(F.sum("weight").alias("n"), F.count_distinct("cheat_player").alias("players"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"))


def samples(rows: DataFrame, keys: list[str], text: str, order: list[str], most: int = 5) -> DataFrame:
    """keys, n, samples: the first `most` different texts of each key, in order. Texts are reduced to their first row before any list is made."""
    once = rows.groupBy(*keys, text).agg(F.min(F.struct(*order)).alias("_at"), F.count("*").alias("_n"))
    first = per_group(once, keys, ["_at"], most)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_at", text))), lambda x: x[text])
    total = once.groupBy(*keys).agg(F.sum("_n").alias("n"))
    return total.join(first.groupBy(*keys).agg(F.array_join(listed, "|").alias("samples")), keys)


def review_evidence(rows: DataFrame, per_player: int = 3, most: int = 10) -> DataFrame:
    """Chat rows for a review: in a flood, of an abuse, or with a class of words; three of a player and reason, ten in all, the weightiest reasons first."""
    reason = F.when(F.col("chat_flood"), "flood").when(F.col("chat_abuse"), "abuse").when(F.col("class").isNotNull(), "hint")
    found = rows.withColumn("reason", reason).where("reason IS NOT NULL")
    some = per_group(found, ["chat_player", "reason"], ["ts_ms", "seq"], per_player)
    weight = F.when(F.col("reason") == "flood", 0).when(F.col("reason") == "abuse", 1).otherwise(2)
    return some.orderBy(weight, "ts_ms", "seq").limit(most)


def per_group(rows: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= k).drop("_r")


def hourly(log: DataFrame) -> DataFrame:
    hour = F.floor(F.col("ts_ms") / 3_600_000) * 3_600_000
    level = lambda x: F.count_if(F.col("level") == x)
    return log.groupBy("server_id", hour.alias("hour")).agg(F.count("*").alias("records"), level("ERROR").alias("errors"), level("WARN").alias("warnings"), level("INFO").alias("infos"))


def cycle(by_hour: DataFrame) -> DataFrame:
    """Hours rolled up again, eight to a cycle; the log isn't read twice."""
    out = hours(by_hour.withColumnRenamed("hour", "ts"), ["server_id"], "ts")
    return out.groupBy("server_id", "cycle").agg(F.count("*").alias("hours"), F.sum("records").alias("records"), F.sum("errors").alias("errors"))


def timeline(rows: DataFrame, order: list[str], chunks: int) -> DataFrame:
    """The ordered rows in `chunks` stretches of equal number; with the three tags that are most frequent, where rows have tags."""
    columns = [x for x in dict.fromkeys([*order, "ts_ms", "level", "tag"]) if x in rows.columns]
    rows = written(rows.select(*columns), "timeline")  # made once: rows are counted, sampled and dealt
    per = -(-rows.count() // chunks) or 1
    cut = rank_globally(rows, order).withColumn("chunk", F.floor(F.col("_rank") / per))
    whole = cut.groupBy("chunk").agg(F.count("*").alias("n"), F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("end_ms"), F.count_if(F.col("level") == "ERROR").alias("errors"))
    if "tag" not in rows.columns:
        return whole
    counts = cut.groupBy("chunk", "tag").agg((-F.count("*")).alias("_n"))
    top = counts.groupBy("chunk").agg(F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("_n", "tag"))), 1, 3), lambda x: x["tag"]), ",").alias("tags"))
    return whole.join(top, "chunk")


def facts(issues: DataFrame) -> DataFrame:
    names = lambda c: F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))), ",").alias(c)
    return issues.groupBy("category").agg(F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"), *[names(c) for c in ("servers", "players", "plugins", "files", "worlds", "positions")])


def titles(issues: DataFrame, title) -> DataFrame:
    """title, n, rank, first_ms, servers: issues by display title."""
    names = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("servers")))), ",")
    return issues.groupBy(title.alias("title")).agg(F.sum("n").alias("n"), F.max("rank").alias("rank"), F.min("first_ms").alias("first_ms"), names.alias("servers"))


def player_problems(issues: DataFrame, action, most: int = 6) -> DataFrame:
    """category, action, players (their number), names (the first six): what troubles players."""
    each = issues.select("category", action.alias("action"), F.explode("players").alias("player")).distinct()
    first = per_group(each, ["category", "action"], ["player"], most).groupBy("category", "action").agg(F.array_join(F.array_sort(F.collect_list("player")), ",").alias("names"))
    return each.groupBy("category", "action").agg(F.count("*").alias("players")).join(first, ["category", "action"])


def sections(issues: DataFrame) -> DataFrame:
    """Fixed sections of eight bullets at most, the weightiest first."""
    section = F.when(F.col("category").isin("chat_review", "community", "moderation"), "community").when(F.col("category") == "player_feedback", "players").when(F.col("rank") >= 4, "urgent").otherwise("operations")
    bullet = F.substring(F.concat(F.col("tag"), F.lit(": "), F.col("n").cast("string"), F.lit(" rows, "), F.col("severity")), 1, 220)
    top = per_group(issues.select(section.alias("section"), bullet.alias("bullet"), "rank", "n", "first_ms"), ["section"], [F.desc("rank"), F.desc("n"), "first_ms", "bullet"], 8)
    listed = F.array_sort(F.collect_list(F.struct((-F.col("rank")).alias("r"), (-F.col("n")).alias("n"), "first_ms", "bullet")))
    return top.groupBy("section").agg(listed.alias("b")).select("section", F.array_join(F.transform("b", lambda x: x["bullet"]), "\n").alias("bullets"))


def flagship(rows: DataFrame) -> DataFrame:
    hour = F.floor(F.col("ts_ms") / 3_600_000) * 3_600_000
    return rows.groupBy("server_id", hour.alias("hour")).agg(F.count("*").alias("records"), F.count_if(F.col("level") == "ERROR").alias("errors"), F.count_if(F.col("category") != "daily").alias("notable"), F.count_distinct("phrase").alias("templates"))
