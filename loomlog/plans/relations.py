"""Queries of joins, samples, distinct rows, loops and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomlog.functions import catalogue as c
from loomlog.functions import text as t
from loomlog.operators import aggregates as agg
from loomlog.operators import joins as j
from loomlog.operators import loops, sampling as s, windows as w
from loomlog.operators import classify as k
from loomlog.plans import duck as d
from loomlog.plans.base import over_log, query
from loomlog.plans.reports import ISSUES
from loomlog.plans.windows import CHAT, FLOODS, chat_rows, named, with_history

# joins
over_log(
    "join_flood_tag",
    lambda log: (lambda chat: j.tag_intervals(named(chat.drop("player")), named(w.floods(chat.drop("player"), "chat_player")), "player", "ts_ms", "event_id").select("event_id", "player", "kind"))(chat_rows(log)),
    f"SELECT c.event_id, c.chat_player AS player, f.kind FROM ({CHAT}) c LEFT JOIN (SELECT c.event_id, arg_min(f.kind, (f.start_ms, f.kind)) AS kind FROM ({CHAT}) c JOIN ({FLOODS}) f ON f.player = c.chat_player AND c.ts_ms BETWEEN f.start_ms AND f.end_ms GROUP BY 1) f ON f.event_id = c.event_id",
)
over_log("join_nearest_key", lambda log: j.nearest(log.where("level = 'ERROR'").withColumnRenamed("event_id", "err"), log.where("level = 'WARN'").withColumnRenamed("event_id", "warn"), ["server_id"], "err", "ts_ms", "warn", "ts_ms"), "SELECT e.event_id AS err, arg_min(x.event_id, (abs(x.ts_ms - e.ts_ms), x.event_id)) AS warn FROM log e LEFT JOIN (SELECT * FROM log WHERE level = 'WARN') x ON x.server_id = e.server_id WHERE e.level = 'ERROR' GROUP BY 1")


def evidence_places(log):
    """Errors of a server and phrase as issues, warnings as the records among which their texts are looked for."""
    found = log.where("level = 'ERROR'").groupBy("server_id", "phrase").agg(F.min("event_id").alias("issue"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"), F.array(F.min_by("message", F.struct("ts_ms", "seq")), F.max_by("message", F.struct("ts_ms", "seq"))).alias("samples"))
    single = log.where("level = 'ERROR'").select(F.col("event_id").alias("issue"), F.col("ts_ms").alias("first_ms"), F.col("ts_ms").alias("last_ms"), F.array("line").alias("samples"))
    return j.located(found.drop("server_id", "phrase").unionByName(single.where("issue > 0").withColumn("issue", -F.col("issue"))), log.where("level = 'WARN'"), "issue", "samples", "event_id", "message", "ts_ms")


over_log("join_nearest", evidence_places, """-- log
, wa AS (SELECT event_id, ts_ms, message FROM log WHERE level = 'WARN'),
iu AS (SELECT min(event_id) AS issue, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms, list_distinct([arg_min(message, (ts_ms, seq)), arg_max(message, (ts_ms, seq))]) AS samples FROM log WHERE level = 'ERROR' GROUP BY server_id, phrase
 UNION ALL SELECT -event_id, ts_ms, ts_ms, [line] FROM log WHERE level = 'ERROR' AND event_id > 0),
t1 AS (SELECT issue, x.s, arg_min(w.event_id, (abs(w.ts_ms - x.first_ms), w.event_id)) AS event_id FROM (SELECT issue, first_ms, unnest(samples) AS s FROM iu) x JOIN wa w ON w.message = x.s GROUP BY issue, x.s),
ti AS (SELECT DISTINCT issue, event_id FROM t1),
wt AS (SELECT ts_ms, min(event_id) AS event_id FROM wa GROUP BY ts_ms),
re AS (SELECT * FROM iu WHERE issue NOT IN (SELECT issue FROM ti)),
ah AS (SELECT r.issue, r.first_ms, r.last_ms, w.ts_ms AS t, w.event_id AS i FROM re r ASOF LEFT JOIN wt w ON r.first_ms <= w.ts_ms),
ba AS (SELECT r.issue, w.ts_ms AS t, w.event_id AS i FROM re r ASOF LEFT JOIN wt w ON r.first_ms >= w.ts_ms)
SELECT issue, 1 AS tier, event_id FROM (SELECT *, row_number() OVER (PARTITION BY issue ORDER BY event_id) AS n FROM ti) z WHERE n <= 20
UNION ALL SELECT ah.issue, CASE WHEN ah.t <= last_ms THEN 2 ELSE 3 END,
 CASE WHEN ah.t <= last_ms THEN ah.i WHEN ah.t IS NULL THEN ba.i WHEN ba.t IS NULL THEN ah.i WHEN (ah.t - first_ms, ah.i) < (first_ms - ba.t, ba.i) THEN ah.i ELSE ba.i END
FROM ah JOIN ba USING (issue)""")
over_log("join_anomaly_evidence", lambda log: j.top_matches(log, w.anomalies(log, ["server_id", "phrase"], ["ts_ms", "seq"]).where("score > 0.3"), ["server_id", "phrase"], [F.desc("ts_ms"), F.desc("seq")]).select("server_id", "phrase", "event_id"), with_history("SELECT server_id, phrase, event_id FROM (SELECT l.server_id, l.phrase, l.event_id, row_number() OVER (PARTITION BY l.server_id, l.phrase ORDER BY l.ts_ms DESC, l.seq DESC) AS n FROM log l SEMI JOIN (SELECT * FROM s WHERE greatest(e, q) > 0.3) z ON z.server_id = l.server_id AND z.phrase = l.phrase) y WHERE n <= 3"))
over_log("join_substring", lambda log: j.contained(log.select("event_id", "message"), log.select(F.col("player").alias("name")).distinct(), "message", "name").select("event_id", "name"), "SELECT event_id, name FROM (SELECT event_id, message FROM log) a JOIN (SELECT DISTINCT player AS name FROM log ORDER BY name LIMIT 1000) b ON contains(message, name) OR contains(name, message)")
NEAR = "SELECT DISTINCT a.event_id FROM (SELECT *, row_number() OVER ({p} ORDER BY ts_ms, seq) AS p FROM log) a JOIN (SELECT *, row_number() OVER ({p} ORDER BY ts_ms, seq) AS p FROM log) b ON abs(a.p - b.p) <= {n} AND b.phrase = 17 {k}"
over_log("join_positional", lambda log: j.around(log, F.col("phrase") == 17, ["ts_ms", "seq"], 2, ["server_id"]).select("event_id"), NEAR.format(p="PARTITION BY server_id", n=2, k="AND a.server_id = b.server_id"))
over_log("join_positional_global", lambda log: j.around(log, F.col("phrase") == 17, ["ts_ms", "seq"], 20).select("event_id"), NEAR.format(p="", n=20, k=""))
over_log("join_positional_file", lambda log: j.around(log, F.col("phrase") == 27, ["ts_ms", "seq"], 40, ["path"]).select("event_id"), NEAR.replace("b.phrase = 17", "b.phrase = 27").format(p="PARTITION BY path", n=40, k="AND a.path = b.path"))
HALF = "SELECT server_id || ':' || phrase AS key, max(ts_ms) AS ts_ms FROM log WHERE ts_ms {} 1601740000000 AND level = 'ERROR' AND phrase % 5 <> {} GROUP BY 1"


def half(log, now: bool):
    rows = log.where("level = 'ERROR'").where(F.col("ts_ms") >= 1601740000000 if now else F.col("ts_ms") < 1601740000000).where(F.col("phrase") % 5 != (1 if now else 2))
    return rows.groupBy(F.concat_ws(":", "server_id", F.col("phrase").cast("string")).alias("key")).agg(F.max("ts_ms").alias("ts_ms"))


LIFE = f"SELECT coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NULL THEN 'recovered' WHEN b.key IS NULL OR a.ts_ms - b.ts_ms > 1800000 THEN 'new' ELSE 'ongoing' END AS status FROM ({HALF.format('>=', 1)}) a FULL JOIN ({HALF.format('<', 2)}) b ON a.key = b.key"
over_log("join_lifecycle", lambda log: j.lifecycle(half(log, True), half(log, False), "key", "ts_ms"), f"SELECT * FROM ({LIFE}) x -- log")
over_log("st_lifecycle", lambda log: j.lifecycle(half(log, True), half(log, False), "key", "ts_ms").groupBy("status").agg(F.count("*").alias("n")), f"SELECT status, count(*) AS n FROM ({LIFE}) x -- log\n GROUP BY 1")
over_log("set_except", lambda log: half(log, False).join(half(log, True), "key", "left_anti").select("key"), f"SELECT key FROM ({HALF.format('<', 2)}) b WHERE key NOT IN (SELECT key FROM ({HALF.format('>=', 1)}) a) -- log")
over_log("join_routing", lambda log: j.route(log, log.sparkSession.createDataFrame([("s0", "room-a"), ("s1", "room-b"), ("s1", "room-c")], "server_id string, target string"), ["all"]).groupBy("server_id", "target").agg(F.count("*").alias("n")), "SELECT l.server_id, t.target, count(*) AS n FROM log l JOIN (VALUES ('s0', 'room-a'), ('s1', 'room-b'), ('s1', 'room-c'), ('s0', 'all'), ('s1', 'all'), ('s2', 'all'), ('s3', 'all')) t(server_id, target) USING (server_id) GROUP BY ALL")
over_log("join_rules", lambda log: log.join(F.broadcast(log.sparkSession.createDataFrame([(h[0], h[2]) for h in c.HINTS], "code string, severity string")), c.hint(F.col("line"), F.col("level"))["code"] == F.col("code")).select("event_id", "code", "severity"), "SELECT l.event_id, r.code, r.severity FROM log l JOIN (VALUES " + ", ".join(f"('{h[0]}', '{h[2]}')" for h in c.HINTS) + f") r(code, severity) ON r.code = {c.hint_sql('line', 'level')}")
over_log("join_ai_merge", lambda log: (lambda i: j.merge_suggestions(i.select("tag", "session"), i.sparkSession.createDataFrame([("server_log_error", n % 7, f"try {n}", n) for n in range(20)], "tag string, session long, suggestion string, at int"), ["tag", "session"], ["at"]).select("tag", "session", "suggestion"))(k.issues(k.classify(log))), f"{ISSUES} SELECT i.tag, i.session, s.suggestion FROM iss i LEFT JOIN (SELECT 'server_log_error' AS tag, n AS session, 'try ' || n AS suggestion FROM range(7) r(n)) s ON s.tag = i.tag AND s.session = i.session")
over_log("join_review_drop", lambda log: (lambda i: j.drop_reviewed(i.select("tag", "session"), i.sparkSession.createDataFrame([("server_log_error", n, "drop", 0.5 + n * 0.05) for n in range(8)], "tag string, session long, decision string, confidence double"), ["tag", "session"]))(k.issues(k.classify(log))), f"{ISSUES} SELECT tag, session FROM iss WHERE NOT (tag = 'server_log_error' AND session BETWEEN 0 AND 7 AND 0.5 + session * 0.05 >= 0.65)")
REVIEWS = [("server_log_error", n, "drop" if n % 2 == 0 else "keep", 0.5 + n * 0.05) for n in range(12)]
over_log("flt_drop_decision", lambda log: (lambda i: j.drop_reviewed(i.select("tag", "session"), i.sparkSession.createDataFrame(REVIEWS, "tag string, session long, decision string, confidence double"), ["tag", "session"]))(k.issues(k.classify(log))), f"{ISSUES} SELECT tag, session FROM iss i WHERE NOT EXISTS (SELECT 1 FROM (VALUES " + ", ".join(f"('{a}', {b}, '{c_}', {d_})" for a, b, c_, d_ in REVIEWS) + ") v(tag, session, decision, confidence) WHERE v.tag = i.tag AND v.session = i.session AND v.decision = 'drop' AND v.confidence >= 0.65)")

# samples, limits, distinct rows
PRIORITY = f"CASE WHEN {d.has('lower(message) || chr(32) || lower(level)', t.any_of(t.PRIORITY_WORDS))} THEN 5.0 ELSE 1.0 END"


def priority():
    return t.priority(F.lit("SERVER_LOG"), F.col("message"), F.array(F.lower("level")))


over_log("top_priority", lambda log: s.top(log, priority(), [F.desc("seq")], 50).select("event_id"), f"SELECT event_id FROM log ORDER BY {PRIORITY} DESC, seq DESC LIMIT 50")
WORTH_SQL = f"({PRIORITY} * 10 + CASE level WHEN 'ERROR' THEN 30.0 WHEN 'WARN' THEN 5.0 ELSE 0.0 END)"
over_log("top_evidence", lambda log: s.evidence(log, ["server_id"], t.normalised(F.col("line")), priority() * 10 + F.when(F.col("level") == "ERROR", 30.0).when(F.col("level") == "WARN", 5.0).otherwise(0.0), ["ts_ms", "seq"], 12).select("server_id", "event_id"), f"""-- log
, sc AS (SELECT server_id, event_id, ts_ms, seq, {d.normalised('line')} AS m, {WORTH_SQL} AS p FROM log),
tx AS (SELECT server_id, m, max(p) AS p, arg_min((ts_ms, seq, event_id), (-p, ts_ms, seq)) AS best, arg_min((ts_ms, seq, event_id), (ts_ms, seq)) FILTER (p >= 50) AS worthy FROM sc GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY server_id ORDER BY p DESC, best) AS r FROM tx),
st AS (SELECT *, CASE WHEN r <= 7 THEN 1 WHEN worthy IS NOT NULL THEN 2 ELSE 3 END AS step FROM rk),
nu AS (SELECT *, row_number() OVER (PARTITION BY server_id ORDER BY step, CASE WHEN step = 2 THEN worthy END, r) AS n FROM st)
SELECT server_id, CASE WHEN step = 2 THEN worthy[3] ELSE best[3] END AS event_id FROM nu WHERE n <= 12""")
over_log("lim_caps", lambda log: log.orderBy("ts_ms", "seq").limit(200).select("event_id"), "SELECT event_id FROM log ORDER BY ts_ms, seq LIMIT 200")
DRAWN = f"sha1('{s.SEED}:' || event_id)"
over_log("smp_reservoir", lambda log: s.reservoir(log, "event_id", 100).select("event_id"), f"SELECT event_id FROM log ORDER BY {DRAWN}, event_id LIMIT 100")
over_log("smp_merge", lambda log: s.bounded(log, "event_id", priority(), ["ts_ms", "seq"], 90).select("event_id"), f"""-- log
, fi AS (SELECT event_id FROM log WHERE {PRIORITY} > 1 ORDER BY {PRIORITY} DESC, ts_ms, seq LIMIT 60),
re AS (SELECT event_id FROM log ORDER BY {DRAWN}, event_id LIMIT 90),
le AS (SELECT event_id, row_number() OVER (ORDER BY {DRAWN}, event_id) AS r FROM re WHERE event_id NOT IN (SELECT event_id FROM fi))
SELECT event_id FROM fi UNION ALL SELECT event_id FROM le WHERE r <= 90 - (SELECT count(*) FROM fi)""")
query("smp_prompt")(lambda spark, sf: (lambda log: s.prompt_sample(log.withColumn("h", t.clean_hash(F.col("message"))), "h", priority(), F.col("level") == "INFO", priority() - 1, ["ts_ms", "seq"], "event_id", 60).select("event_id"))(_log(spark, sf)))
over_log("set_union", lambda log: log.where("level = 'ERROR'").select("event_id").unionByName(log.where("level = 'WARN'").select("event_id")), "SELECT event_id FROM log WHERE level = 'ERROR' UNION ALL SELECT event_id FROM log WHERE level = 'WARN'")
over_log("set_distinct_first", lambda log: s.distinct_first(log.withColumn("fp", t.fingerprint(F.col("line"))), ["server_id", "fp"], ["ts_ms", "seq"]).select("server_id", "event_id"), f"SELECT server_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY server_id, {d.fingerprint('line')} ORDER BY ts_ms, seq) AS r FROM log) x WHERE r = 1")
over_log("set_distinct_best", lambda log: s.distinct_best(log.withColumn("h", t.clean_hash(F.col("message"))), ["h"], F.col("k"), ["ts_ms", "seq"]).select("event_id"), f"SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY {d.clean_text('message')} ORDER BY k DESC, ts_ms, seq) AS r FROM log) x WHERE r = 1")
over_log("set_intersect", lambda log: k.issues(k.classify(log)).where(F.arrays_overlap("servers", F.array(F.lit("s1"), F.lit("s3")))).select("tag", "session"), f"{ISSUES} SELECT tag, session FROM iss WHERE list_has_any(servers, ['s1', 's3'])")
def _log(spark, sf):
    from loomlog.sources.eventlog import log

    return log(spark, sf)


# state: rows of one key are suppressed within five minutes of the last
def looped(log):
    return loops.suppress(log.where("level IN ('WARN', 'ERROR')").select("server_id", F.col("phrase").cast("string").alias("key"), "ts_ms", "event_id"))


LOOP = """-- log
, lr AS (SELECT server_id, phrase::VARCHAR AS key, ts_ms, event_id, row_number() OVER (PARTITION BY server_id, phrase ORDER BY ts_ms, event_id) AS r, count(*) OVER (PARTITION BY server_id, phrase) AS total FROM log WHERE level IN ('WARN', 'ERROR')),
go AS (WITH RECURSIVE g(server_id, key, r, total, last, emitted, held, out_ts, out_id, out_n, pre_ts, pre_n) AS (
 SELECT server_id, key, r, total, ts_ms, ts_ms, 0::BIGINT, ts_ms, event_id, 0::BIGINT, NULL::BIGINT, 0::BIGINT FROM lr WHERE r = 1
 UNION ALL SELECT l.server_id, l.key, l.r, l.total, l.ts_ms, CASE WHEN l.ts_ms - g.last > 300000 OR l.ts_ms - g.emitted >= 300000 THEN l.ts_ms ELSE g.emitted END,
 CASE WHEN l.ts_ms - g.last > 300000 OR l.ts_ms - g.emitted >= 300000 THEN 0 ELSE g.held + 1 END,
 CASE WHEN l.ts_ms - g.last > 300000 OR l.ts_ms - g.emitted >= 300000 THEN l.ts_ms END, CASE WHEN l.ts_ms - g.last > 300000 THEN l.event_id END,
 CASE WHEN l.ts_ms - g.last > 300000 THEN 0 WHEN l.ts_ms - g.emitted >= 300000 THEN g.held + 1 ELSE 0 END,
 CASE WHEN l.ts_ms - g.last > 300000 AND g.held > 0 THEN g.last END, CASE WHEN l.ts_ms - g.last > 300000 THEN g.held ELSE 0 END
 FROM g JOIN lr l ON l.server_id = g.server_id AND l.key = g.key AND l.r = g.r + 1) SELECT * FROM g)
SELECT server_id, key, out_ts AS ts_ms, out_id AS event_id, out_n AS suppressed FROM go WHERE out_ts IS NOT NULL
UNION ALL SELECT server_id, key, pre_ts, NULL, pre_n FROM go WHERE pre_ts IS NOT NULL
UNION ALL SELECT server_id, key, last, NULL, held FROM go WHERE r = total AND held > 0"""
over_log("st_drain", lambda log: looped(log).agg(F.count("event_id").alias("passed"), F.sum("suppressed").alias("held")), LOOP.rpartition("SELECT server_id, key, out_ts")[0] + "SELECT (SELECT count(*) FROM go WHERE out_id IS NOT NULL) AS passed, (SELECT count(*) FROM lr) - (SELECT count(*) FROM go WHERE out_id IS NOT NULL) AS held")
over_log("agg_anomaly_snapshot", lambda log: (lambda a: a.groupBy("server_id", "phrase").agg(F.max_by(F.round("score", 6), F.struct("ts_ms", "seq")).alias("score"), F.count("*").alias("n")).orderBy(F.desc("score"), F.desc("n"), "server_id", "phrase").limit(20))(w.anomalies(log, ["server_id", "phrase"], ["ts_ms", "seq"])), with_history("SELECT server_id, phrase, arg_max(round(greatest(e, q, CASE WHEN total = 1 THEN 0.3 ELSE 0.0 END), 6), (s.ts_ms, s.event_id)) AS score, count(*) AS n FROM s GROUP BY ALL ORDER BY score DESC, n DESC, server_id, phrase LIMIT 20"))


def flood_players(log):
    """Players with their floods and five different messages from them."""
    chat, events = chat_rows(log.drop("player")), named(w.floods(chat_rows(log).drop("player"), "chat_player"))
    said = j.tag_intervals(named(chat), events, "player", "ts_ms", "event_id").where("kind IS NOT NULL")
    texts = agg.samples(said, ["player"], "chat_message", ["ts_ms", "seq"]).select("player", "samples")
    return events.groupBy("player").agg(F.count("*").alias("floods"), F.sum("n").alias("messages")).join(texts, "player")


over_log("agg_flood_players", flood_players, f"""SELECT player, floods, messages, samples FROM (SELECT player, count(*) AS floods, sum(n)::BIGINT AS messages FROM ({FLOODS}) f GROUP BY 1) t
JOIN (SELECT player, array_to_string(list_slice(list(chat_message ORDER BY ts_ms, seq), 1, 5), '|') AS samples FROM (SELECT c.chat_player AS player, c.chat_message, min(c.ts_ms) AS ts_ms, arg_min(c.seq, (c.ts_ms, c.seq)) AS seq FROM ({CHAT}) c SEMI JOIN ({FLOODS}) f ON f.player = c.chat_player AND c.ts_ms BETWEEN f.start_ms AND f.end_ms GROUP BY ALL) s GROUP BY 1) u USING (player)""")

# sources
over_log("src_tail_n", lambda log: j.top_matches(log, log, ["path"], [F.desc("ts_ms"), F.desc("seq")], 10).select("path", "event_id"), "SELECT path, event_id FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts_ms DESC, seq DESC) AS r FROM log) x WHERE r <= 10")
over_log("src_sparse_index", lambda log: log.withColumn("back", F.col("ts_ms") < F.lag("ts_ms").over(_by_path())).groupBy("path").agg((~F.coalesce(F.max("back"), F.lit(False))).alias("monotonic"), F.count("*").alias("n")), "SELECT path, NOT coalesce(bool_or(back), false) AS monotonic, count(*) AS n FROM (SELECT *, ts_ms < lag(ts_ms) OVER (PARTITION BY path ORDER BY event_id) AS back FROM log) x GROUP BY 1")


def _by_path():
    from pyspark.sql import Window

    return Window.partitionBy("path").orderBy("event_id")
