"""Queries of sources, sinks, the smaller scalars and what streams do, as batches."""

from __future__ import annotations

import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomlog.functions import rules as r
from loomlog.functions import text as t
from loomlog.operators import advice, joins
from loomlog.operators import aggregates as agg
from loomlog.operators import classify as k
from loomlog.operators import sampling as s
from loomlog.plans import duck as d
from loomlog.plans.base import over_log, query
from loomlog.plans.relations import LOOP
from loomlog.plans.reports import DOMAIN, HOURLY, ISSUES, iss
from loomlog.plans.scalars import column
from loomlog.plans.windows import with_history
from loomlog.sources import files
from loomlog.sources.eventlog import log
from loomlog.sources.shared import shared_path
from loomlog.sources.tail import opened, tail
from loomlog.streaming import queries as streams

# sources
CONFIG = ["/srv/alpha", {"id": "beta", "logs_dir": "/var/beta", "type": "paper"}, {"root": "/srv/gamma", "type": "velocity", "name": "Gamma"}, {"id": "none"}, {"id": "beta", "root": "/again"}, {"id": "off", "root": "/x", "enabled": False}, {"id": "one", "log_file": "/one/latest.log", "root": "/y"}]
query("src_config", "SELECT * FROM (VALUES ('alpha', 'alpha', 'minecraft', '/srv/alpha/logs'), ('beta', 'beta', 'minecraft', '/var/beta'), ('gamma', 'Gamma', 'velocity', '/srv/gamma/logs'), ('one', 'one', 'minecraft', '/one/latest.log')) v(server_id, server_name, server_type, path)")(lambda spark, sf: files.sources(spark, CONFIG))
PLACES = [{"root": "/srv/a/"}, {"logs_dir": "/var/b", "root": "/srv/b"}, {"log_file": "/c/latest.log", "logs_dir": "/d"}, {"id": "none"}]
query("src_resolve", "SELECT * FROM (VALUES (0, '/srv/a/logs'), (1, '/var/b'), (2, '/c/latest.log'), (3, NULL)) v(place, path)")(lambda spark, sf: spark.createDataFrame([(i, files.resolve(e)) for i, e in enumerate(PLACES)], "place int, path string"))


def observations(log):
    """The log as rows of the store."""
    none = F.lit("")
    return log.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.when(F.col("k") % 9 == 0, "METRIC").otherwise("SERVER_LOG").alias("kind"),
        "server_id",
        F.upper("server_id").alias("server_name"),
        *[none.alias(x) for x in ("backend_server", "proxy_id")],
        F.col("player").alias("player_name"),
        none.alias("player_uuid_hash"),
        F.col("message").alias("content"),
        "ts_ms",
        F.array(F.lower("level")).alias("tags"),
        F.create_map(F.lit("level"), F.col("level")).alias("context"),
        F.create_map(F.lit("line"), F.col("line")).alias("raw"),
    )


over_log("src_text_scan", lambda log: text_scan_of_all(log), "SELECT server_id, sha1(line) AS h FROM log WHERE trim(line) <> ''")


def text_scan_of_all(log):
    """Lines of all servers, a path for each."""
    found = None
    for r in log.select("server_id").distinct().orderBy("server_id").collect():
        path = shared_path(log.sparkSession, "text")
        log.where(F.col("server_id") == r.server_id).select("line").write.option("compression", "gzip").text(path)
        lines = files.lines(log.sparkSession, path).select(F.lit(r.server_id).alias("server_id"), F.sha1("line").alias("h"))
        found = lines if found is None else found.unionByName(lines)
    return log.select("server_id", F.sha1("line").alias("h")) if found is None else found


def exported(log):
    path = shared_path(log.sparkSession, "export")
    files.write_jsonl(observations(log), path)
    return files.read_jsonl(log.sparkSession, path)


EXPORT = "SELECT event_id::VARCHAR AS event_id, CASE WHEN k % 9 = 0 THEN 'METRIC' ELSE 'SERVER_LOG' END AS kind, message AS content, level FROM log"
over_log("src_jsonl", lambda log: exported(log).select("event_id", "kind", "content", F.col("context")["level"].alias("level")), EXPORT)
over_log("snk_export", lambda log: exported(log).groupBy("kind", "server_id").agg(F.count("*").alias("n"), F.max("ts_ms").alias("last_ms")), "SELECT CASE WHEN k % 9 = 0 THEN 'METRIC' ELSE 'SERVER_LOG' END AS kind, server_id, count(*) AS n, max(ts_ms) AS last_ms FROM log GROUP BY ALL")
NOW = 1601760000000


def stored(log):
    path = shared_path(log.sparkSession, "store")
    files.store(observations(log), path, NOW, 1)
    return path


over_log("snk_store", lambda log: files.read_store(log.sparkSession, stored(log), "s1", NOW - 20_000_000, NOW - 10_000_000).select("event_id", "ts_ms"), f"SELECT event_id::VARCHAR AS event_id, ts_ms FROM log WHERE k % 9 <> 0 AND ts_ms >= {NOW} - 86400000 AND server_id = 's1' AND ts_ms >= {NOW} - 20000000 AND ts_ms < {NOW} - 10000000")


def retained(log):
    spark, path = log.sparkSession, stored(log)
    files.drop_expired(spark, path, datetime.date(2020, 10, 4))
    rows = spark.read.option("basePath", path).parquet(f"{path}/*/*")
    return rows.groupBy("server_id", F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n"))


over_log("snk_retention", retained, f"SELECT server_id, strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d') AS day, count(*) AS n FROM log WHERE k % 9 <> 0 AND ts_ms >= {NOW} - 86400000 AND ts_ms >= 1601769600000 GROUP BY ALL")


def hours_written(log):
    path = shared_path(log.sparkSession, "hourly")
    by_hour = agg.hourly(log)
    files.write_hourly(by_hour, path)
    files.write_hourly(by_hour.where("server_id = 's1'").withColumn("records", F.col("records") + 1), path)
    return log.sparkSession.read.parquet(path).select("server_id", F.col("hour").cast("long").alias("hour"), "records", "errors")


over_log("snk_hourly", hours_written, f"SELECT server_id, hour, records + CASE WHEN server_id = 's1' THEN 1 ELSE 0 END AS records, errors FROM ({HOURLY}) h -- log")


def states(log):
    path = shared_path(log.sparkSession, "state")
    agg.hourly(log).write.json(path)
    return log.sparkSession.read.schema("server_id string, hour long, records long").json(path).where("hour >= 1601740800000")


over_log("src_state", states, f"SELECT server_id, hour, records FROM ({HOURLY}) h WHERE hour >= 1601740800000 -- log")


def scopes(log):
    """Each scope's set of keys is replaced as a whole; others stay."""
    path = shared_path(log.sparkSession, "lifecycle")
    keys = log.select("server_id", "phrase").distinct()
    write = lambda rows: rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("server_id").parquet(path)
    write(keys)
    write(keys.where("server_id = 's2' AND phrase < 5"))
    return log.sparkSession.read.parquet(path).groupBy("server_id").agg(F.count("*").alias("n"))


over_log("snk_lifecycle", scopes, "SELECT server_id, count(DISTINCT phrase) AS n FROM log WHERE server_id <> 's2' OR phrase < 5 GROUP BY 1")

# log files: written below a folder, and read through the readers of sources.files
FILED_NOW = 1704499200000
DAY_2, HOUR = 1704153600000, 3_600_000
_CLOCK = " + ".join(f"CAST(regexp_extract(line, '([0-9]{{2}}):([0-9]{{2}}):([0-9]{{2}})', {i}) AS BIGINT) * {m}" for i, m in ((1, 3600000), (2, 60000), (3, 1000)))
SCANNED = f"""-- log
, sc AS (SELECT *, coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY path ORDER BY ts_ms, seq ROWS UNBOUNDED PRECEDING), {FILED_NOW}) AS t, row_number() OVER (PARTITION BY path ORDER BY ts_ms, seq) AS no, regexp_extract(path, '([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})', 1) AS day
 FROM (SELECT *, CASE WHEN k % 3 <> 0 THEN epoch_ms(CAST(regexp_extract(path, '([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})', 1) AS DATE)) + {_CLOCK} END AS x, CASE WHEN k % 3 = 0 THEN message ELSE line END AS body FROM log) y)"""


def filed(log):
    """The log as files, a third of its lines without a time; the folder."""
    rows = log.withColumn("body", F.when(F.col("k") % 3 == 0, F.col("message")).otherwise(F.col("line")))
    return files.write_logs(rows, shared_path(log.sparkSession, "logs"), "path", ["ts_ms", "seq"], "body")


def shown(rows):
    return rows.select(F.regexp_extract("path", "([^/]+/[^/]+)$", 1).alias("path"), F.sha1("line").alias("h"), F.col("ts_ms").alias("t"))


def cached_twice(log):
    root, cache = filed(log), shared_path(log.sparkSession, "cache")
    files.cached_scan(log.sparkSession, f"{root}/s1", cache, FILED_NOW)
    return shown(files.cached_scan(log.sparkSession, root, cache, FILED_NOW))


over_log("src_candidates", lambda log: files.candidates(log.sparkSession, filed(log), datetime.date(2024, 1, 3), 100).select(F.regexp_extract("path", "([^/]+/[^/]+)$", 1).alias("path")), "SELECT DISTINCT path FROM log WHERE regexp_extract(path, '([0-9]{4}-[0-9]{2}-[0-9]{2})', 1) >= '2024-01-02'")
over_log("src_ts_scan", lambda log: shown(files.scan(log.sparkSession, f"{filed(log)}/*", FILED_NOW)), f"{SCANNED} SELECT path, sha1(body) AS h, t FROM sc")
over_log("src_backfill", lambda log: shown(files.backfill(log.sparkSession, f"{filed(log)}/s1", DAY_2, FILED_NOW, 500)), f"{SCANNED} SELECT path, sha1(body) AS h, t FROM sc WHERE server_id = 's1' AND day >= '2024-01-01' AND t >= {DAY_2} ORDER BY path DESC, no LIMIT 500")
over_log("src_hour_range", lambda log: shown(files.between(log.sparkSession, filed(log), DAY_2 + 14 * HOUR, DAY_2 + 18 * HOUR, FILED_NOW)), f"{SCANNED} SELECT path, sha1(body) AS h, t FROM sc WHERE day BETWEEN '2024-01-01' AND '2024-01-03' AND t >= {DAY_2 + 14 * HOUR} AND t < {DAY_2 + 18 * HOUR}")
over_log("src_gz_cache", cached_twice, f"{SCANNED} SELECT path, sha1(body) AS h, t FROM sc")


def jsonl_range(log):
    path = shared_path(log.sparkSession, "export")
    files.write_jsonl(observations(log).withColumn("ts_ms", F.when(F.col("event_id").cast("long") % 7 == 0, None).otherwise(F.col("ts_ms"))), path)
    return files.read_jsonl_range(log.sparkSession, path, 1601737200000, 1601740800000).select("event_id")


over_log("src_jsonl_range", jsonl_range, "SELECT event_id::VARCHAR AS event_id FROM log WHERE event_id % 7 = 0 OR (ts_ms >= 1601737200000 AND ts_ms < 1601740800000)")
over_log("src_partition_prune", lambda log: files.read_store(log.sparkSession, stored(log), "s2", NOW - 30_000_000, NOW).groupBy("server_id", F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n")), f"SELECT server_id, strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d') AS day, count(*) AS n FROM log WHERE k % 9 <> 0 AND ts_ms >= {NOW} - 86400000 AND server_id = 's2' AND ts_ms >= {NOW} - 30000000 AND ts_ms < {NOW} GROUP BY ALL")


def dated_lines(log):
    """Lines with their whole time, in files of servers that are still written."""
    return log.withColumn("body", F.concat(F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd HH:mm:ss"), F.lit(" "), F.col("message"), F.lit(" #"), F.col("event_id").cast("string")))


BODY = "strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d %H:%M:%S') || ' ' || message || ' #' || event_id"
MIDDLE, LATER = 1601740000000, 1601760000000


def put(rows, root, name, whole=True):
    """What servers write: rows as the file `name` (a column) of each server, replaced if it is there; without whole, no line feed behind the last line."""

    def write(batches):
        now, out, between = None, None, b""
        for pdf in batches:
            for path, lines in pdf.groupby("file", sort=False)["body"]:
                if path != now:
                    if out is not None:
                        out.write(b"\n" if whole else b"")
                        out.close()
                    system, at = opened(f"{root}/{path}")
                    system.create_dir(at.rpartition("/")[0], recursive=True)
                    now, out, between = path, system.open_output_stream(at), b""  # gzip by its ending
                out.write(between + "\n".join(lines).encode())
                between = b"\n"
        if out is not None:
            out.write(b"\n" if whole else b"")
            out.close()
            yield pdf.iloc[:0][["file"]]

    files_of = rows.withColumn("file", F.concat("server_id", F.lit("/"), name)).repartition("server_id").sortWithinPartitions("file", "ts_ms", "seq")
    files_of.select("file", "body").mapInPandas(write, "file string").count()


def tailed(log):
    """A part of each file, then all of it: every line comes once."""
    spark, rows = log.sparkSession, dated_lines(log)
    root, folder = shared_path(spark, "tail"), shared_path(spark, "tailed")
    for some in (rows.where(F.col("ts_ms") < MIDDLE), rows):
        put(some, root, F.lit("latest.log"))
        got = streams.run_once(tail(spark, root, maxBytes=str(1 << 30)), folder)
    return got.select(F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("server_id"), F.sha1("line").alias("h")).groupBy("server_id", "h").agg(F.count("*").alias("n"))


def rotated(log):
    """Files are read in part, go on, and are then moved away: renamed (s0), gzipped (s1, s3), or cut to nothing (s2); new ones are begun.

    What is moved away ends without a line feed. Every line comes once.
    """
    spark, rows = log.sparkSession, dated_lines(log)
    root, folder = shared_path(spark, "rotate"), shared_path(spark, "rotated")
    first, middle, last = rows.where(F.col("ts_ms") < MIDDLE), rows.where(F.col("ts_ms") < LATER), rows.where(F.col("ts_ms") >= LATER)
    poll = lambda: streams.run_once(tail(spark, root, maxBytes=str(1 << 30), state=f"{folder}/files"), folder)
    put(first, root, F.lit("latest.log"))
    poll()
    put(middle.where("server_id = 's2'"), root, F.lit("latest.log"))
    poll()
    put(middle.where("server_id <> 's2'"), root, F.when(F.col("server_id") == "s0", "2020-10-03-1.log").otherwise("2020-10-03-1.log.gz"), False)
    put(last, root, F.lit("latest.log"))
    got = poll()
    return got.select(F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("server_id"), F.sha1("line").alias("h")).groupBy("server_id", "h").agg(F.count("*").alias("n"))


ONCE = f"SELECT server_id, sha1({BODY}) AS h, 1::BIGINT AS n FROM log"
over_log("src_tail", tailed, ONCE)
over_log("st_tail_loop", lambda log: tailed(log).groupBy("server_id").agg(F.count("*").alias("lines"), F.max("n").alias("most")), "SELECT server_id, count(*) AS lines, 1::BIGINT AS most FROM log GROUP BY server_id")
over_log("src_rotate", rotated, ONCE)


def delivered(log):
    path = shared_path(log.sparkSession, "outbox")
    routes = log.sparkSession.createDataFrame([("s0", "room-a"), ("s1", "room-b")], "server_id string, target string")
    files.deliver(joins.route(log.where("level = 'ERROR'").select("server_id", "event_id"), routes, ["all"]), path)
    return log.sparkSession.read.schema("server_id string, event_id long, target string").json(path)


over_log("snk_deliver", delivered, "SELECT l.server_id, l.event_id, t.target FROM log l JOIN (VALUES ('s0', 'room-a'), ('s1', 'room-b'), ('s0', 'all'), ('s1', 'all'), ('s2', 'all'), ('s3', 'all')) t(server_id, target) USING (server_id) WHERE l.level = 'ERROR'")


def alerted(log):
    """Issues as a stream, alerts with a cooldown after each."""
    spark, source, folder = log.sparkSession, shared_path(log.sparkSession, "issues"), shared_path(log.sparkSession, "alerts")
    found = k.issues(k.classify(log)).select("category", "tag", "first_ms", "servers", "alert")
    found.coalesce(1).write.parquet(source)
    return streams.run_once(streams.alerts(spark.readStream.schema(found.schema).parquet(source)), folder)


over_log("st_alert", alerted, f"""{ISSUES}, al AS (SELECT unnest(servers) AS server, category, tag, first_ms FROM iss WHERE alert),
ar AS (SELECT *, row_number() OVER (PARTITION BY server, category, tag ORDER BY first_ms) AS r FROM al),
go AS (WITH RECURSIVE g(server, category, tag, r, first_ms, last, sent) AS (SELECT server, category, tag, r, first_ms, first_ms, true FROM ar WHERE r = 1
 UNION ALL SELECT a.server, a.category, a.tag, a.r, a.first_ms, CASE WHEN a.first_ms - g.last >= 600000 THEN a.first_ms ELSE g.last END, a.first_ms - g.last >= 600000 FROM g JOIN ar a ON a.server = g.server AND a.category = g.category AND a.tag = g.tag AND a.r = g.r + 1) SELECT * FROM g)
SELECT server, category, tag, first_ms FROM go WHERE sent""")

# scalars
over_log("fn_position", lambda log: log.select("event_id", t.position(F.when(F.col("k") % 3 == 0, "nether"), F.col("k"), F.when(F.col("k") % 5 > 0, 64), -F.col("phrase")).alias("out")), "SELECT event_id, CASE WHEN k % 5 > 0 THEN CASE WHEN k % 3 = 0 THEN 'nether ' ELSE '' END || '(' || k || ', 64, ' || -phrase || ')' END AS out FROM log")
BACKEND, WORLD = "CASE WHEN k % 4 = 0 THEN server_id WHEN k % 4 = 1 THEN 'hub' || phrase % 3 WHEN k % 4 = 2 THEN '' END", "CASE WHEN k % 3 = 0 THEN 'nether' WHEN k % 3 = 1 THEN '' END"
over_log("fn_location", lambda log: log.select("event_id", t.location(F.col("server_id"), F.expr(BACKEND), F.expr(WORLD)).alias("out")), f"SELECT event_id, server_id || CASE WHEN k % 4 = 1 THEN '/hub' || phrase % 3 ELSE '' END || CASE WHEN k % 3 = 0 THEN '@nether' ELSE '' END AS out FROM log")
over_log("fn_config_files", lambda log: log.select("event_id", F.array_join(t.found_all(F.col("message"), t.CONFIG_FILE), ",").alias("files"), F.size(t.found_all(F.col("message"), t.HOST)).alias("hosts")), f"SELECT event_id, array_to_string(regexp_extract_all(message, {d.q(t.CONFIG_FILE)}, 1), ',') AS files, len(list_distinct(regexp_extract_all(message, {d.q(t.HOST)}, 1)))::INT AS hosts FROM log")


def compacted(log):
    """Contexts of three levels: texts, a list that is too long, an object with a deeper one, a map with a key that is left out."""
    ops = F.struct(F.lit("x").alias("attributes"), F.col("k").alias("level"), F.struct(F.col("player").alias("by"), F.struct(F.lit("deep").alias("c")).alias("deep")).alias("inner"), F.lit(" ").alias("blank"))
    extra = F.create_map(F.lit("content"), F.lit("gone"), F.lit("where"), F.col("server_id"), F.lit("who"), F.when(F.col("k") % 2 == 0, F.col("player")))
    rows = log.select("event_id", F.struct("level", F.col("message").alias("source"), F.lit("secret").alias("hidden"), F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: F.concat(F.when(i == 3, "").otherwise("n"), F.when(i == 3, "").otherwise(i.cast("string")))).alias("params"), ops.alias("ops"), extra.alias("extra")).alias("context"))
    return rows.select("event_id", t.compact_context(F.col("context"), rows.schema["context"].dataType, ["level", "source", "params", "ops", "extra"]).alias("out"))


_SOURCE = d.clean_text("message")
over_log("fn_compact_context", compacted, f"""SELECT event_id, '{{"level":"' || level || '"' || CASE WHEN s = '' THEN '' ELSE ',"source":"' || CASE WHEN length(s) > 220 THEN substr(s, 1, 217) || '...' ELSE s END || '"' END
 || ',"params":["n1","n2","n4","n5","n6","n7","n8"],"ops":{{"level":' || k || ',"inner":{{"by":"' || player || '"}}}},"extra":{{"where":"' || server_id || '"' || CASE WHEN k % 2 = 0 THEN ',"who":"' || player || '"' ELSE '' END || '}}}}' AS out FROM (SELECT *, {_SOURCE} AS s FROM log) x""")
iss("fn_issue_bounds", lambda i: i.select("tag", "session", F.least("first_ms", "last_ms").alias("a"), F.greatest("first_ms", "last_ms").alias("b")), "SELECT tag, session, first_ms AS a, last_ms AS b FROM iss")


def tightened(log):
    """Issues, shown by the times in the lines of their evidence."""
    rows = k.classify(log)
    return k.shown_spans(rows, k.issues(rows))


NEAR_DAY = "CASE WHEN y - a > 43200000 THEN y - 86400000 WHEN a - y > 43200000 THEN y + 86400000 ELSE y END"
TIGHT = f"category IN ({', '.join(map(d.q, t.TIGHTENED))}) AND last_ms - first_ms > {t.TIGHTEN_MS} AND low IS NOT NULL"
over_log("fn_tighten", tightened, f"""{ISSUES},
tm AS (SELECT category, tag, session, min({NEAR_DAY}) AS low, max({NEAR_DAY}) AS high FROM (SELECT i.category, i.tag, i.session, i.first_ms AS a, (i.first_ms // 86400000) * 86400000 + {_CLOCK} AS y FROM se l JOIN iss i ON i.category = l.category AND i.tag = l.tag AND i.session = l.session) z GROUP BY ALL)
SELECT category, tag, session, CASE WHEN {TIGHT} THEN low ELSE first_ms END AS first_ms, CASE WHEN {TIGHT} THEN high ELSE last_ms END AS last_ms FROM iss LEFT JOIN tm USING (category, tag, session)""")
over_log("fn_window_arg", lambda log: log.agg(*[F.lit(t.window_minutes(x)).alias(f"w{n}") for n, x in enumerate(("30m", "8h", "24", "soon"))]), "SELECT 30 AS w0, 480 AS w1, 1440 AS w2, 480 AS w3")
over_log("fn_target", lambda log: log.select(F.lower(F.trim(F.concat(F.lit(" Room:"), F.col("server_id")))).alias("target")).distinct(), "SELECT DISTINCT 'room:' || server_id AS target FROM log")

# the rest
over_log("smp_budget", lambda log: budget(log), """-- log
, cu AS (SELECT *, sum(length(line)) OVER (ORDER BY r) AS chars FROM (SELECT event_id, line, row_number() OVER (ORDER BY ts_ms, seq) AS r FROM log) x WHERE r <= 120),
go AS (WITH RECURSIVE g(n) AS (SELECT count(*) FROM cu UNION ALL SELECT greatest(0, least(n - 1, n * 3 // 4)) FROM g WHERE coalesce((SELECT chars FROM cu WHERE r = n), 0) > 2000) SELECT min(n) AS n FROM g)
SELECT event_id FROM cu WHERE r <= (SELECT n FROM go)""")
iss("cls_plan", lambda i: advice.plans(i).select("category", "tag", "session", "place", "step", "check"), f"""SELECT category, tag, session, place, p.step AS step, v."check" FROM (SELECT category, tag, session, generate_subscripts(steps, 1)::INT AS place, unnest(steps) AS step FROM (SELECT *, {advice.plan.sql} AS steps FROM iss) a) p
JOIN (VALUES {', '.join(f"({d.q(c)}, {d.q(x)})" for c, _, x, *_ in advice.STEPS)}) v(step, "check") USING (step)""")
iss("cls_action", lambda i: i.select("category", "tag", "session", advice.action.make().alias("action")), f"SELECT category, tag, session, {advice.action.sql} AS action FROM iss")


#: A stream over the log runs in twice as many micro-batches at most.
BATCHES = 16


def streamed(log, make):
    """A stream over the log, whose rows come up to five minutes late, in slices of an hour and more and in as many parts as there are cores; two far later rows bring out what waits."""
    rows = log.select("event_id", "seq", "ts_ms", "server_id", "player", "level", "phrase", "message")
    spark, far = log.sparkSession, 4_000_000_000_000
    end = spark.createDataFrame([("end", far * (i + 1), -1 - i, -1 - i, -1, "ERROR", "end", i) for i in range(2)], "server_id string, ts_ms long, event_id long, seq long, phrase int, level string, message string, slice long")
    source = streams.arriving(rows, F.col("ts_ms") + F.col("event_id") * 7919 % 300_000, shared_path(spark, "arrived"), HOUR, end, BATCHES)
    return streams.run_once(make(source), shared_path(spark, "streamed"), parts=spark.sparkContext.defaultParallelism)


def late_rows(log):
    """Rows come up to 25 minutes late, the watermark moves by the hour: those in time and those behind it make up the log."""
    spark = log.sparkSession
    arrival = F.col("ts_ms") + F.col("event_id") * 7919 % 1_500_000
    rows = log.select("event_id", "ts_ms", F.floor(arrival / HOUR).cast("long").alias("hour"))
    source = streams.arriving(rows, arrival, shared_path(spark, "arrived"), HOUR, most=BATCHES)
    kept, late = streams.late_apart(source, shared_path(spark, "apart"), step="hour")
    return kept.select("event_id", F.lit(False).alias("late")).unionByName(late.select("event_id", F.lit(True).alias("late")))


over_log("st_anomaly", lambda log: streamed(log, lambda s: streams.anomalies(s, template="phrase", seq="event_id")).where("server_id <> 'end'").select("event_id", "in_bucket", "total", F.round("ewma", 6).alias("ewma"), "p95", F.round("score", 6).alias("score"), "reason"), with_history("SELECT event_id, in_bucket, total::BIGINT AS total, round(ewma, 6) AS ewma, p95, round(greatest(e, q, CASE WHEN total = 1 THEN 0.3 ELSE 0.0 END), 6) AS score, CASE WHEN q > e THEN 'percentile_spike' WHEN total >= 5 AND ewma > 0 AND in_bucket >= ewma * 3 THEN 'ewma_spike' WHEN total = 1 THEN 'new_template' ELSE '' END AS reason FROM s"))
over_log("st_late", late_rows, f"""-- log
, sl AS (SELECT event_id, ts_ms, (ts_ms + event_id * 7919 % 1500000) // {HOUR} AS slice FROM log),
hi AS (SELECT slice, max(max(ts_ms)) OVER (ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM sl GROUP BY slice)
SELECT event_id, coalesce(ts_ms < high - {streams.LATE_MS}, false) AS late FROM sl JOIN hi USING (slice)""")
over_log("st_dedupe", lambda log: streamed(log, lambda s: streams.first_of_slot(s, ["server_id", "message"], "2 minutes", ["ts_ms", "seq", "event_id"])).where("server_id <> 'end'").select("event_id"), "SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY server_id, message, ts_ms // 120000 ORDER BY ts_ms, seq) AS r FROM log) x WHERE r = 1")
MAY_LOOP = f"coalesce(upper(level) IN ({', '.join(map(d.q, r.LOOP_LEVELS))}) OR {d.has('lower(message)', t.any_of(r.LOOP_WORDS))}, false)"
LOOP_ALL = LOOP.replace("level IN ('WARN', 'ERROR')", MAY_LOOP).replace("out_id AS event_id, out_n", "coalesce(out_id, -1) AS event_id, out_n").replace("pre_ts, NULL,", "pre_ts, -1,").replace("last, NULL,", "last, -1,")
over_log("st_loop_filter", lambda log: streamed(log, lambda s: streams.loop_filter(s.withColumn("key", F.col("phrase").cast("string")))).where("server_id <> 'end'").withColumn("event_id", F.coalesce("event_id", F.lit(-1))), f"{LOOP_ALL}\nUNION ALL SELECT server_id, phrase::VARCHAR, ts_ms, coalesce(event_id, -1), 0 FROM log WHERE NOT {MAY_LOOP}")
query("st_template")(lambda spark, sf: streamed(log(spark, sf), streams.templates).where("namespace <> 'end'").select("namespace", "event_id", "template", "size", "is_new"))
over_log("st_periodic", lambda log: log.groupBy("server_id", (F.floor(F.col("ts_ms") / 28_800_000) * 28_800_000).alias("due_ms")).agg(F.count("*").alias("n")), "SELECT server_id, (ts_ms // 28800000) * 28800000 AS due_ms, count(*) AS n FROM log GROUP BY ALL")
over_log("st_backpressure", lambda log: log.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy("server_id").orderBy("ts_ms", "seq")) - 1) / 200)).groupBy("server_id", "batch").agg(F.count("*").alias("n"), F.min("ts_ms").alias("start_ms")), "SELECT server_id, batch, count(*) AS n, min(ts_ms) AS start_ms FROM (SELECT *, (row_number() OVER (PARTITION BY server_id ORDER BY ts_ms, seq) - 1) // 200 AS batch FROM log) x GROUP BY ALL")


def budget(log):
    """Rows of a bounded sample, shortened on the driver until their text fits."""
    rows = log.orderBy("ts_ms", "seq").limit(120).select("event_id", "line").collect()
    kept = len(s.fit_budget([r.line for r in rows], 2000))
    return log.sparkSession.createDataFrame([(r.event_id,) for r in rows[:kept]], "event_id long")
