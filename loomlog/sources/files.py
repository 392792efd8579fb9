"""Log files, JSON lines and stores: readers and writers."""

from __future__ import annotations

import datetime
import hashlib
import re
import urllib.parse

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomlog.functions import text as t

OBSERVATION = "event_id string, kind string, server_id string, server_name string, backend_server string, proxy_id string, player_name string, player_uuid_hash string, content string, ts_ms long, tags array<string>, context map<string, string>, raw map<string, string>"
DATED = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}")
# What names of server types stand for.
TYPES = {"minecraft": "minecraft", "paper": "minecraft", "spigot": "minecraft", "bukkit": "minecraft", "mc": "minecraft", "velocity": "velocity"}


def sources(spark: SparkSession, entries: list[str | dict]) -> DataFrame:
    """The dimension of sources from paths or dicts: id, name, type, path. Incomplete ones and repeated ids are left out."""
    rows, seen = [], set()
    for e in entries:
        e = {"root": e} if isinstance(e, str) else dict(e)
        path = resolve(e)
        parts = [p for p in (e.get("root") or path or "").rstrip("/").split("/") if p]
        ident = str(e.get("id") or (parts[-1] if parts else ""))
        if not path or not ident or ident in seen or e.get("enabled") is False:
            continue
        seen.add(ident)
        rows.append((ident, str(e.get("name") or ident), TYPES.get(str(e.get("type", "")).lower(), "minecraft"), path))
    return spark.createDataFrame(rows, "server_id string, server_name string, server_type string, path string")


def resolve(entry: dict) -> str | None:
    """The path of a source: its file, else its log folder, else logs under its root."""
    if entry.get("log_file"):
        return entry["log_file"]
    if entry.get("logs_dir"):
        return entry["logs_dir"]
    return f"{entry['root'].rstrip('/')}/logs" if entry.get("root") else None


def listed(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(path, modification time in ms, size) of the log files below a folder, through its own file system: nothing is opened."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    files, found = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(root, True), []
    while files.hasNext():
        f = files.next()
        name = f.getPath().toString()
        if name.endswith((".log", ".log.gz")):
            found.append((name, f.getModificationTime(), f.getLen()))
    return found


def dated(name: str) -> datetime.date | None:
    """The date in a file's name, None without one."""
    found = DATED.search(name.rsplit("/", 1)[-1])
    try:
        return datetime.date.fromisoformat(found[0]) if found else None
    except ValueError:
        return None


def newest_first(files: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The file that is still written, then by the date in the name, then by time of change."""
    return sorted(files, key=lambda f: (dated(f[0]) or datetime.date.max, f[1], f[0]), reverse=True)


def candidates(spark: SparkSession, path: str, cutoff: datetime.date, most: int) -> DataFrame:
    """(path, modified_ms): log files worth reading: latest.log, or dated, or else changed, a day before the cutoff or later; newest first, `most` at most."""
    day = cutoff - datetime.timedelta(days=1)
    changed = lambda ms: datetime.datetime.fromtimestamp(ms / 1000, datetime.UTC).date()
    fits = [f for f in listed(spark, path) if f[0].endswith("/latest.log") or (dated(f[0]) or changed(f[1])) >= day]
    return spark.createDataFrame([f[:2] for f in newest_first(fits)[:most]], "path string, modified_ms long")


def between(spark: SparkSession, path: str, from_ms: int, to_ms: int, now_ms: int) -> DataFrame:
    """Lines of [from_ms, to_ms). Files whose name has a date outside, a day of slack each way, are not opened."""
    low, high = (datetime.datetime.fromtimestamp(x / 1000, datetime.UTC).date() for x in (from_ms, to_ms))
    slack = datetime.timedelta(days=1)
    files = [f for f, _, _ in listed(spark, path) if dated(f) is None or low - slack <= dated(f) <= high + slack]
    if not files:
        return spark.createDataFrame([], "path string, line_no long, line string, ts_ms long")
    return scan(spark, files, now_ms).where((F.col("ts_ms") >= from_ms) & (F.col("ts_ms") < to_ms))


def backfill(spark: SparkSession, path: str, from_ms: int, now_ms: int, most: int, most_files: int = 1000) -> DataFrame:
    """The first `most` lines from from_ms on, newest files first; in a file in the order of its lines."""
    cutoff = datetime.datetime.fromtimestamp(from_ms / 1000, datetime.UTC).date()
    files = [r.path for r in candidates(spark, path, cutoff, most_files).collect()]  # names, most_files at most
    if not files:
        return spark.createDataFrame([], "path string, line_no long, line string, ts_ms long")
    places = spark.createDataFrame([(plain_path(f), i) for i, f in enumerate(files)], "_f string, _place int")
    rows = scan(spark, files, now_ms).where(F.col("ts_ms") >= from_ms).withColumn("_f", F.regexp_replace("path", "^file:/+", "/"))
    return rows.join(F.broadcast(places), "_f").orderBy("_place", "line_no").limit(most).drop("_place", "_f")


def plain_path(path: str) -> str:
    """A local path as it is, whatever slashes its scheme came with."""
    return re.sub("^file:/+", "/", path)


def write_logs(rows: DataFrame, root: str, path: str, order: list[str], line: str) -> str:
    """One file for each value of `path` (such as s1/2024-01-01-1.log.gz; gzip by its ending) below root, its lines in order; root. A file that is there is replaced."""
    spark = rows.sparkSession
    out = rows.select(F.col(path).alias("_p"), F.col(line).alias("value"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(order)])
    keys = [f"_{i}" for i in range(len(order))]
    out = out.repartition("_p").sortWithinPartitions("_p", *keys).select("_p", "value")
    packed = F.col("_p").endswith(".gz")
    out.where(packed).write.partitionBy("_p").option("compression", "gzip").text(f"{root}/_parts")
    out.where(~packed).write.mode("append").partitionBy("_p").text(f"{root}/_parts")
    jvm = spark.sparkContext._jvm
    P = jvm.org.apache.hadoop.fs.Path
    parts = P(f"{root}/_parts")
    system = parts.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for folder in system.listStatus(parts):
        name = folder.getPath().getName()
        if name.startswith("_p="):
            to = P(f"{root}/{urllib.parse.unquote(name[3:])}")
            system.mkdirs(to.getParent())
            for f in system.listStatus(folder.getPath()):
                if f.getPath().getName().startswith("part-"):
                    system.delete(to, False)
                    system.rename(f.getPath(), to)
    system.delete(parts, True)
    return root


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, line_no, line of text files, plain or gzip; broken archives end where they break; blank lines are left out.

    A gzip file is one task; a plain file is split, and line numbers count within a split
    (monotonically increasing with the place in the file).
    """
    raw = spark.read.option("ignoreCorruptFiles", "true").text(path).select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))
    return raw.where(F.trim("line") != "")


def carry_forward(rows: DataFrame, key: str, order: list[str], ts: str) -> DataFrame:
    """rows whose null ts is the last known before it in its file."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(ts, F.last(ts, True).over(w))


def scan(spark: SparkSession, path: str | list[str], now_ms: int, size: int = 4000) -> DataFrame:
    """lines() with ts_ms (of the line, else of the line before, else now) and the line cut to `size`."""
    got = lines(spark, path)
    parts = t.time_parts(F.col("line"))
    own = t.timestamp_ms(parts, t.file_date(F.col("path")), F.lit(0), F.lit(None).cast("long"))
    own = F.when(parts["time"] != "", t.timestamp_ms(parts, t.file_date(F.col("path")), F.lit(0), F.lit(now_ms))).otherwise(own)
    out = carry_forward(got.withColumn("ts_ms", own), "path", ["line_no"], "ts_ms")
    return out.withColumn("ts_ms", F.coalesce("ts_ms", F.lit(now_ms))).withColumn("line", t.truncate(F.col("line"), size))


def cached_scan(spark: SparkSession, path: str, cache: str, now_ms: int) -> DataFrame:
    """scan() of all log files below a folder, each parsed once: rows are kept under cache by the file's name, size and time of change."""
    names = [(f, hashlib.sha1(f"{f}:{ms}:{size}".encode()).hexdigest()) for f, ms, size in listed(spark, path)]
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    have = {x.getPath().getName().removeprefix("key=") for x in system.listStatus(root)} if system.exists(root) else set()
    new = [(f, k) for f, k in names if k not in have]
    if new:
        keys = spark.createDataFrame([(plain_path(f), k) for f, k in new], "_f string, key string")
        rows = scan(spark, [f for f, _ in new], now_ms).withColumn("_f", F.regexp_replace("path", "^file:/+", "/")).join(F.broadcast(keys), "_f").drop("_f")
        rows.write.mode("append").partitionBy("key").parquet(cache)
    kept = spark.read.parquet(cache) if names else spark.createDataFrame([], "path string, line_no long, line string, ts_ms long, key string")
    return kept.where(F.col("key").cast("string").isin([k for _, k in names])).drop("key")


def deliver(rows: DataFrame, path: str, target: str = "target") -> None:
    """Messages as JSON lines in an outbox folder of each target, from which a sender takes them; appended, so a retry may repeat a message."""
    rows.write.mode("append").partitionBy(target).json(path)


def read_jsonl_range(spark: SparkSession, path: str, from_ms: int, to_ms: int) -> DataFrame:
    """Observations of [from_ms, to_ms), and those without a time."""
    return read_jsonl(spark, path).where(F.col("ts_ms").isNull() | ((F.col("ts_ms") >= from_ms) & (F.col("ts_ms") < to_ms)))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Observations from JSON lines; lines that aren't objects, and fields that don't fit, are left out or null."""
    got = spark.read.schema(OBSERVATION + ", _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return got.where("_bad IS NULL OR event_id IS NOT NULL OR content IS NOT NULL").drop("_bad")


def write_jsonl(rows: DataFrame, path: str, compress: bool = True) -> None:
    """One file a partition, as JSON lines. An existing export stays as it is: the name is decided by what it holds."""
    rows.write.mode("ignore").option("compression", "gzip" if compress else "none").json(path)


def store(rows: DataFrame, path: str, now_ms: int, retention_days: int = 30) -> None:
    """Append observations by server and day; only server logs, and none older than the retention."""
    kept = rows.where("kind = 'SERVER_LOG'").where((F.col("ts_ms") == 0) | (F.col("ts_ms") >= now_ms - retention_days * 86_400_000))
    day = F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd")
    kept.withColumn("day", day).repartition("server_id", "day").sortWithinPartitions("ts_ms").write.mode("append").partitionBy("server_id", "day").parquet(path)


def read_store(spark: SparkSession, path: str, server_id: str | None, from_ms: int, to_ms: int) -> DataFrame:
    """Stored rows of [from_ms, to_ms): days and servers are pruned, the time filter reaches the scan."""
    rows = spark.read.option("basePath", path).parquet(path)
    days = [datetime.datetime.fromtimestamp(x / 1000, datetime.UTC).strftime("%Y-%m-%d") for x in (from_ms, to_ms)]
    rows = rows.where(F.col("day").cast("string").between(*days) & (F.col("ts_ms") >= from_ms) & (F.col("ts_ms") < to_ms))
    return rows.where(F.col("server_id") == server_id) if server_id else rows


def drop_expired(spark: SparkSession, path: str, before: datetime.date) -> list[str]:
    """Delete day folders older than `before` through the file system of the store; their names."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = []
    for s in fs.listStatus(root):
        if s.isDirectory():
            for d in fs.listStatus(s.getPath()):
                name = d.getPath().getName()
                if name.startswith("day=") and name[4:] < before.isoformat():
                    fs.delete(d.getPath(), True)
                    gone.append(f"{s.getPath().getName()}/{name}")
    return sorted(gone)


def write_hourly(rows: DataFrame, path: str) -> None:
    """Hourly rows by server and hour; an hour written again replaces itself only."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("server_id", "hour").parquet(path)
