"""Queries of time windows and behaviour."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomlog.functions import text as t
from loomlog.operators import windows as w
from loomlog.plans import duck as d
from loomlog.plans.base import over_log

KEYS, ORDER = ["server_id", "phrase"], ["ts_ms", "seq"]
CHAT = f"SELECT * FROM (SELECT *, {d.chat('line')[0]} AS chat_player, {d.chat('line')[1]} AS chat_message FROM log) c0 WHERE chat_player <> ''"


def chat_rows(log):
    """Rows with a player and a message; made by a generator, so that the parser runs once a row."""
    c = t.chat(F.col("line"))
    made = F.array(F.struct(c["player"].alias("chat_player"), c["message"].alias("chat_message")))
    return log.select("*", F.inline(F.filter(made, lambda x: x["chat_player"] != "")))


HISTORY = """h AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY server_id, phrase ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
 list(n) OVER (PARTITION BY server_id, phrase ORDER BY bucket ROWS BETWEEN 110 PRECEDING AND 1 PRECEDING) AS past,
 list_sort(list(n) OVER (PARTITION BY server_id, phrase ORDER BY bucket ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)) AS ring
 FROM (SELECT server_id, phrase, ts_ms // 60000 AS bucket, count(*) AS n FROM log GROUP BY ALL) b),
r AS (SELECT l.event_id, l.server_id, l.phrase, l.ts_ms, l.ts_ms // 60000 AS bucket, row_number() OVER (PARTITION BY l.server_id, l.phrase, l.ts_ms // 60000 ORDER BY ts_ms, seq) AS in_bucket FROM log l),
a AS (SELECT r.*, h.before + r.in_bucket AS total, coalesce(list_reduce(list_transform(h.past, lambda x: x::DOUBLE), lambda p, x: 0.3 * x + 0.7 * p, 0.0::DOUBLE), 0.0) AS ewma,
 CASE WHEN len(h.ring) >= 10 THEN h.ring[least(floor(len(h.ring) * 0.95)::INT, len(h.ring) - 1) + 1] END::DOUBLE AS p95 FROM r JOIN h USING (server_id, phrase, bucket)),
s AS (SELECT *, CASE WHEN total >= 5 AND ewma > 0 AND in_bucket >= ewma * 3 THEN least(1.0, (in_bucket / greatest(ewma, 0.1) - 1) / 10) ELSE 0.0 END AS e,
 CASE WHEN p95 > 0 AND in_bucket > p95 * 1.5 THEN least(1.0, (in_bucket / greatest(p95, 0.1) - 1) / 5) ELSE 0.0 END AS q FROM a)"""


def with_history(tail: str) -> str:
    """The log's own WITH goes on."""
    return f"-- log\n, {HISTORY} {tail}"


over_log("win_bucket", lambda log: w.running(log, KEYS, ORDER).select("event_id", "bucket", F.col("in_bucket").cast("long").alias("n")), with_history("SELECT event_id, bucket, in_bucket AS n FROM a"))
over_log("win_total", lambda log: w.running(log, KEYS, ORDER).select("event_id", F.col("total").cast("long").alias("n")), with_history("SELECT event_id, total::BIGINT AS n FROM a"))
over_log("win_ewma", lambda log: w.running(log, KEYS, ORDER).select("event_id", F.round("ewma", 6).alias("ewma")), with_history("SELECT event_id, round(ewma, 6) AS ewma FROM a"))
over_log("win_pctl", lambda log: w.running(log, KEYS, ORDER).select("event_id", "p95"), with_history("SELECT event_id, p95 FROM a"))
over_log(
    "win_anomaly",
    lambda log: w.anomalies(log, KEYS, ORDER).select("event_id", F.round("score", 6).alias("score"), "reason", "is_anomaly"),
    with_history("SELECT event_id, round(greatest(e, q, CASE WHEN total = 1 THEN 0.3 ELSE 0.0 END), 6) AS score, CASE WHEN q > e THEN 'percentile_spike' WHEN total >= 5 AND ewma > 0 AND in_bucket >= ewma * 3 THEN 'ewma_spike' WHEN total = 1 THEN 'new_template' ELSE '' END AS reason, greatest(e, q, CASE WHEN total = 1 THEN 0.3 ELSE 0.0 END) >= 0.5 AS is_anomaly FROM s"),
)
over_log("win_new_template", lambda log: w.running(log, KEYS, ORDER).where("total = 1").select("server_id", "phrase", "event_id"), "SELECT server_id, phrase, arg_min(event_id, (ts_ms, seq)) AS event_id FROM log GROUP BY ALL")


def crowd_sql(rows: str, ms: int, least: int) -> str:
    return f"""SELECT player, b.ts_ms AS start_ms, b.end_ms AS end_ms, b.n AS n FROM (SELECT chat_player AS player, arg_min({{'ts_ms': ts_ms, 'end_ms': end_ms, 'n': n}}, (ts_ms, seq)) AS b FROM (
 SELECT chat_player, ts_ms, seq, count(*) OVER f - row_number() OVER (PARTITION BY chat_player ORDER BY ts_ms, seq) + 1 AS n, max(ts_ms) OVER f AS end_ms FROM ({rows}) c
 WINDOW f AS (PARTITION BY chat_player ORDER BY ts_ms RANGE BETWEEN UNBOUNDED PRECEDING AND {ms} FOLLOWING)) x WHERE n >= {least} GROUP BY 1) y"""


REPEAT = f"""SELECT player, b.a_ts AS start_ms, b.b_ts AS end_ms, 5::BIGINT AS n FROM (SELECT player, arg_min({{'a_ts': a_ts, 'b_ts': b_ts}}, (b_ts, b_seq, a_ts, a_seq)) AS b FROM (
 SELECT a.player, a.ts_ms AS a_ts, a.seq AS a_seq, b.ts_ms AS b_ts, b.seq AS b_seq, row_number() OVER (PARTITION BY a.player, a.seq ORDER BY b.ts_ms, b.seq) AS nth
 FROM (SELECT chat_player AS player, ts_ms, seq, {d.message_key('chat_message')} AS m FROM ({CHAT}) c) a JOIN (SELECT chat_player AS player, ts_ms, seq, {d.message_key('chat_message')} AS m FROM ({CHAT}) c) b
 ON a.player = b.player AND (b.ts_ms, b.seq) > (a.ts_ms, a.seq) AND b.ts_ms - a.ts_ms <= 300000 AND {d.similar('a.m', 'b.m')}) x WHERE nth = 4 GROUP BY 1) y"""
NONSENSE = f"SELECT * FROM ({CHAT}) c WHERE {d.meaningless('chat_message')}"


def named(df):
    return df.withColumnRenamed("chat_player", "player")


over_log("win_flood_hf", lambda log: named(w.first_crowd(chat_rows(log), "chat_player", "ts_ms", "seq", *w.HIGH_RATE)), crowd_sql(CHAT, *w.HIGH_RATE))
over_log("win_flood_meaningless", lambda log: named(w.first_crowd(chat_rows(log).where(t.meaningless(F.col("chat_message"))), "chat_player", "ts_ms", "seq", *w.MEANINGLESS)), crowd_sql(NONSENSE, *w.MEANINGLESS))
over_log("win_flood_repeat", lambda log: named(w.first_repeat(chat_rows(log), "chat_player", "ts_ms", "seq", "chat_message")), REPEAT)
over_log("join_repeat_self", lambda log: named(w.repeat_pairs(chat_rows(log), "chat_player", "ts_ms", "seq", "chat_message", 300_000)), f"SELECT a.player, a.ts_ms AS a_ts, a.seq AS a_seq, b.ts_ms AS b_ts, b.seq AS b_seq FROM (SELECT chat_player AS player, ts_ms, seq, {d.message_key('chat_message')} AS m FROM ({CHAT}) c) a JOIN (SELECT chat_player AS player, ts_ms, seq, {d.message_key('chat_message')} AS m FROM ({CHAT}) c) b ON a.player = b.player AND (b.ts_ms, b.seq) > (a.ts_ms, a.seq) AND b.ts_ms - a.ts_ms <= 300000 AND {d.similar('a.m', 'b.m')}")
FLOODS = " UNION ALL ".join(f"SELECT player, '{k}' AS kind, start_ms, end_ms, n FROM ({s}) f" for k, s in (("high_frequency", crowd_sql(CHAT, *w.HIGH_RATE)), ("repeat_content", REPEAT), ("meaningless", crowd_sql(NONSENSE, *w.MEANINGLESS))))
over_log("behaviour_floods", lambda log: named(w.floods(chat_rows(log), "chat_player")), FLOODS)
SESSIONS = "SELECT *, sum(split) OVER (PARTITION BY server_id, phrase ORDER BY ts_ms, seq ROWS UNBOUNDED PRECEDING) AS session FROM (SELECT *, CASE WHEN ts_ms - lag(ts_ms) OVER (PARTITION BY server_id, phrase ORDER BY ts_ms, seq) > 300000 THEN 1 ELSE 0 END AS split FROM log) x"
over_log("win_gap_sessions", lambda log: w.sessions(log, KEYS).groupBy("server_id", "phrase", "session").agg(F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("end_ms"), F.count("*").alias("n")), f"SELECT server_id, phrase, session::BIGINT AS session, min(ts_ms) AS start_ms, max(ts_ms) AS end_ms, count(*) AS n FROM ({SESSIONS}) s -- log\n GROUP BY ALL")
over_log("win_partition_chat", lambda log: w.sessions(log.withColumn("is_chat", t.chat(F.col("line")).isNotNull()), ["server_id", "is_chat"]).groupBy("server_id", "is_chat", "session").agg(F.count("*").alias("n")), f"SELECT server_id, is_chat, session::BIGINT AS session, count(*) AS n FROM (SELECT *, sum(split) OVER (PARTITION BY server_id, is_chat ORDER BY ts_ms, seq ROWS UNBOUNDED PRECEDING) AS session FROM (SELECT *, CASE WHEN ts_ms - lag(ts_ms) OVER (PARTITION BY server_id, is_chat ORDER BY ts_ms, seq) > 300000 THEN 1 ELSE 0 END AS split FROM (SELECT *, ({d.chat('line')[0]}) IS NOT NULL AS is_chat FROM log) z) x) y GROUP BY ALL")
over_log("win_hour", lambda log: w.hours(log, ["server_id"]).groupBy("server_id", "hour").agg(F.count("*").alias("n")), "SELECT server_id, (ts_ms // 3600000) * 3600000 AS hour, count(*) AS n FROM log GROUP BY ALL")
over_log("win_cycle", lambda log: w.hours(log, ["server_id"]).groupBy("server_id", "cycle").agg(F.count("*").alias("n")), "SELECT server_id, (hour - first) // 28800000 AS cycle, count(*) AS n FROM (SELECT server_id, (ts_ms // 3600000) * 3600000 AS hour, min((ts_ms // 3600000) * 3600000) OVER (PARTITION BY server_id) AS first FROM log) x GROUP BY ALL")
over_log("win_recent", lambda log: log.join(F.broadcast(log.agg(F.max("ts_ms").alias("now"))), F.col("ts_ms") >= F.col("now") - 3_600_000).select("event_id", "ts_ms"), "SELECT event_id, ts_ms FROM log WHERE ts_ms >= (SELECT max(ts_ms) FROM log) - 3600000")
over_log("win_even_sample", lambda log: w.even_sample(log, ORDER, 40).select("event_id", "ts_ms"), "SELECT event_id, ts_ms FROM (SELECT *, row_number() OVER (ORDER BY ts_ms, seq) - 1 AS r, count(*) OVER () AS n FROM log) x WHERE n <= 40 OR r IN (SELECT round_even(i * ((SELECT count(*) FROM log) - 1) / 39.0, 0)::BIGINT FROM range(40) q(i))")
