"""A deterministic log made of the events table, the same in Spark and in SQL.

The tables at hand hold no log lines, so each event becomes one: a server, a player, a
level and a phrase chosen by its payload. Time is compressed 60-fold, which makes the
sparse events dense enough for sessions and spikes; BURST of each PERIOD events are one
player's same words, two seconds apart, as a flood is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.sources.shared import written

# Phrases by number; P is the player, K the payload's number.
PHRASES = [
    "Database connection timed out after 30000ms id=K",
    "Connection reset by peer 10.0.0.K",
    "<P> hello there",
    "[Vulcan] P failed Speed (Type A) (2/20)",
    "Saving chunks for world overworld took K.5 ms",
    "Can't keep up! Running 2104ms or K ticks behind",
    "P joined the game from 192.168.1.K",
    "[Global] P >> Buy cheap diamonds now!",
    "java.lang.NullPointerException in plugin Shop",
    "at com.example.Shop.buy(Shop.java:42)",
    "- missing key in config.yml for [Shop]",
    "Failed to load plugin Essentials v1.2.K",
    "See https://example.com/help?id=K or mail admin@example.com",
    "Player 123e4567-e89b-12d3-a456-426614174000 used token abcdefghijklmnopqrstuvwxyz0123456789",
    "aaaaaaaaaaaaaaaaaaaa",
    "!!!! ???? ---- ////",
    "<P> !!!!!!!!",
    "Out of memory: Java heap space",
    "<P> server is lagging again",
    "Economy transaction rollback failed for P amount=K",
    "world/region/r.1.2.mca saved at 0xFFK",
    "[Vulcan] Loading checks",
    "P lost connection: Timed out",
    "Backup failed: disk full on /data",
    "Broken pipe during packet flush",
    "Could not load plugin EssentialsX-2.K.jar",
    "Plugin DependsOnVault missing dependency: Vault",
    "java.lang.OutOfMemoryError: GC overhead limit exceeded",
    "A single server tick took 60.K seconds",
    "Failed to load chunk K, 12",
    "服务器内存溢出，进程崩溃 K",
    "<P> 又掉线了，全服都卡",
    "<P> 建议加个新商店功能",
    "<P> 管理员在吗，有人偷东西",
    "<P> 加群 1K 代练便宜",
    "<P> 你好",
    "<P> go to discord.gg/free now",
    "lost connection: Disconnected",
    "P left the game",
    "Session ticker running behind by K ticks",
    "Failed to check for updates for plugin Shop",
    "kicked P for spamming",
    "Vote reward announcement sent to P today",
    "Velocity forwarding secret mismatch for backend server K",
    "UUID of player P is 123e4567-e89b-12d3-a456-42661417400K",
    "<P> 有人飞行疑似开挂，求处理",
    "<P> 我要威胁开盒你",
    "QuickShop transaction failed for P at world/overworld 10.5, 64, -20",
]
PERIOD, BURST, BURST_PHRASE = 997, 12, 18
LEVELS = {"error": "ERROR", "click": "WARN", "signup": "INFO", "purchase": "INFO", "view": "INFO"}


def concatenated(phrases: list[str]) -> str:
    """The message of a phrase's number as one case each."""
    parts = []
    for i, p in enumerate(phrases):
        quoted = "'" + p.replace("'", "''") + "'"
        quoted = quoted.replace("P ", "' || player || ' ", 1) if p.startswith("P ") else quoted.replace("<P>", "<' || player || '>").replace(" P ", " ' || player || ' ")
        head, sep, tail = quoted.rpartition("K")
        if sep and p not in (PHRASES[14], PHRASES[15]):
            quoted = f"{head}' || CAST(k AS STRING) || '{tail}"
        parts.append(f"WHEN {i} THEN {quoted}")
    return f"CASE phrase {' '.join(parts)} END"


def said(phrases: list[str]) -> str:
    """The same, as an entry of a fixed list that names are put into: code for that many cases is too long for the JVM to compile."""
    texts = []
    for p in phrases:
        text = p.replace("P ", "{player} ", 1) if p.startswith("P ") else p.replace("<P>", "<{player}>").replace(" P ", " {player} ")
        head, sep, tail = text.rpartition("K")
        texts.append(f"{head}{{k}}{tail}" if sep else text)
    text = "get(array(" + ", ".join("'" + x.replace("'", "\\'") + "'" for x in texts) + "), phrase)"
    for name, value in (("{player}", "player"), ("{k}", "CAST(k AS STRING)")):
        text = f"if(contains({text}, '{name}'), replace({text}, '{name}', {value}), {text})"
    return text


def log_sql(spark: bool) -> str:
    """SELECT of the log. Columns: event_id, seq, ts_ms, server_id, player, level, k, phrase, message, line, path."""
    ts = "floor(unix_micros(CAST(ts AS TIMESTAMP)) / 1000)" if spark else "floor(epoch_us(ts) / 1000)"
    k = "CAST(get_json_object(props, '$.k') AS INT)" if spark else "CAST(json_extract_string(props, '$.k') AS INT)"
    level = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in LEVELS.items())
    message = said(PHRASES) if spark else concatenated(PHRASES)
    clock = "lpad(CAST(CAST(floor(ts_ms / 3600000) AS BIGINT) % 24 AS STRING), 2, '0') || ':' || lpad(CAST(CAST(floor(ts_ms / 60000) AS BIGINT) % 60 AS STRING), 2, '0') || ':' || lpad(CAST(CAST(floor(ts_ms / 1000) AS BIGINT) % 60 AS STRING), 2, '0')"
    burst, block = f"event_id % {PERIOD} < {BURST}", f"CAST(floor(event_id / {PERIOD}) AS BIGINT)"
    ts = f"CASE WHEN {burst} THEN 1601740000000 + {block} * 600000 + (event_id % {PERIOD}) * 2000 ELSE CAST(floor(({ts} - 1600000000000) / 60) AS BIGINT) + 1600000000000 END"
    phrase = f"CASE WHEN {burst} THEN {BURST_PHRASE} ELSE CAST((k0 * 7 + event_id) % {len(PHRASES)} AS INT) END"
    return f"""
SELECT *, '[' || {clock} || '] [Server thread/' || level || ']: ' || message AS line,
  's' || CAST(user_id % 4 AS STRING) || '/2024-01-0' || CAST(1 + user_id % 3 AS STRING) || '-1.log.gz' AS path FROM (
SELECT *, {message} AS message FROM (
SELECT event_id, event_id AS seq, user_id, CAST({ts} AS BIGINT) AS ts_ms, 's' || CAST(user_id % 4 AS STRING) AS server_id,
  'p' || CAST(user_id % 40 AS STRING) AS player, CASE event_type {level} ELSE 'INFO' END AS level, {'k0' if spark else k} AS k, {phrase} AS phrase
FROM (SELECT event_id, event_type, props, ts, CASE WHEN {burst} THEN 7 ELSE user_id END AS user_id, {k} AS k0 FROM events) e) l) m"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as a DataFrame; the temporary view's name is fixed by the folder, so calls don't clash."""
    name = "events_" + "".join(c if c.isalnum() else "_" for c in sf_dir)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "props")
    spread(events, "event_id").createOrReplaceTempView(name)
    return spark.sql(log_sql(True).replace("FROM events)", f"FROM {name})"))


def spread(df: DataFrame, key: str) -> DataFrame:
    """df (of files, key: a column without a value of many rows) in about even parts, as many as there are cores at least.

    A file is split by its bytes, but a row group is read by one task, so a large file of few
    row groups is a few tasks' work in any number of partitions. Rows of a partition are counted
    from the files' footers; where the largest holds over 1.5 times a core's share, rows are
    dealt by key and written once, however often they are read. A file too small to be split is dealt as it is read.
    """
    cores, parts = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    if parts < cores:
        return df.repartition(cores, key)
    rows, most = df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).agg(F.sum("n"), F.max("n")).first()
    return written(df.repartition(parts, key), "dealt") if rows and most * cores > 1.5 * rows else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text"))
