"""Queries of classification, filters, aggregates, issues and incidents."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomlog.functions import catalogue as c
from loomlog.functions import rules as r
from loomlog.functions import text as t
from loomlog.operators import aggregates as agg
from loomlog.operators import classify as k
from loomlog.operators import joins
from loomlog.plans import duck as d
from loomlog.plans.base import over_log
from loomlog.plans.windows import FLOODS

NAMES = "['info', 'low', 'medium', 'high', 'critical']"
CLS = f"-- log\n, {d.classified()}"
_CHATS = f"(SELECT event_id, ts_ms, seq, {d.chat('line')[0]} AS chat_player, {d.chat('line')[1]} AS chat_message FROM log)"
BEHAVIOUR = f"""-- log
, rc AS (SELECT *, {c.review_class_sql('chat_message')} AS class FROM {_CHATS} x WHERE chat_player <> ''),
ab AS (SELECT DISTINCT event_id FROM rc SEMI JOIN (SELECT chat_player, class FROM rc WHERE class IS NOT NULL GROUP BY ALL HAVING count(*) >= CASE WHEN class = 'sensitive' THEN 1 ELSE 2 END) a ON a.chat_player = rc.chat_player AND a.class = rc.class),
fl AS (SELECT DISTINCT rc.event_id FROM rc JOIN ({FLOODS}) f ON f.player = rc.chat_player AND rc.ts_ms BETWEEN f.start_ms AND f.end_ms),
lb AS (SELECT log.*, fl.event_id IS NOT NULL AS chat_flood, ab.event_id IS NOT NULL AS chat_abuse FROM log LEFT JOIN fl ON fl.event_id = log.event_id LEFT JOIN ab ON ab.event_id = log.event_id),
{d.classified('lb', 'chat_flood', 'chat_abuse')}"""
TALK = "[" + ", ".join(f"'{label}'" for group, label, _ in r.CHAT if group in ("small_talk", "building")) + ", 'chatting']"
SERIOUS = "(ops_admin OR ops_severity IN ('medium', 'high', 'critical'))"


def issues_sql(classes: str) -> str:
    """The WITH chain on to iss: issues of the rows of cls."""
    first = lambda pattern: f"nullif(regexp_extract(message, {d.q(pattern)}, 1), '')"
    named = {"plugin": first(t.PLUGIN), "file": first(t.CONFIG_FILE), "world": first(t.WORLD), "position": first(t.POSITION), "label": f"list_filter(coalesce(chat_labels, []::VARCHAR[]), lambda x: NOT list_contains({TALK}, x))"}
    sets = ", ".join(f"list_sort(list_distinct({'flatten(list(label))' if v == 'label' else f'list({v})'})) AS {s}" for s, v in k.SETS.items())
    flags = ", ".join(f"bool_or(f_{n}) AS f_{n}" for n in k.FLAGS)
    return f"""{classes}, ev AS (SELECT * REPLACE (CASE WHEN {SERIOUS} THEN ops_subtype END AS ops_subtype, CASE WHEN {SERIOUS} THEN ops_category END AS ops_category), {', '.join(f'{v} AS {n}' for n, v in named.items())} FROM cls WHERE evidence),
se AS (SELECT *, sum(split) OVER (PARTITION BY category, tag ORDER BY ts_ms, seq ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM (SELECT *, CASE WHEN ts_ms - lag(ts_ms) OVER (PARTITION BY category, tag ORDER BY ts_ms, seq) > CASE WHEN category = 'player_feedback' THEN 900000 ELSE 300000 END THEN 1 ELSE 0 END AS split FROM ev) x),
i0 AS (SELECT category, tag, session, count(*) AS n, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms, {sets}, max(own_rank) AS own, bool_and(plain_info) AS plain_info, {flags} FROM se GROUP BY ALL),
i1 AS (SELECT *, {k.LADDER_SQL} AS base FROM i0),
i2 AS (SELECT *, greatest(own, CASE WHEN plain_info THEN CASE WHEN n <= 2 THEN 1 ELSE least(base, 2) END ELSE base END) AS r0 FROM i1),
i3 AS (SELECT *, CASE WHEN r0 <= 1 AND category IN ('chat_review', 'community', 'community_ops', 'moderation') THEN 2 ELSE r0 END AS rank FROM i2),
iss AS (SELECT *, {NAMES}[rank + 1] AS severity, round(least(0.98, 0.5 + 0.08 * n), 4)::DOUBLE AS confidence, {k.ALERT_SQL} AS alert FROM i3 WHERE rank > 1 AND category <> 'daily')"""


ISSUES = issues_sql(CLS)
DOMAIN, FAMILY = k.DOMAIN_SQL, k.FAMILY_SQL


def cls(name: str, make, sql: str) -> None:
    over_log(name, lambda log: make(k.classify(log)), f"{CLS} {sql}")


def iss(name: str, make, sql: str) -> None:
    over_log(name, lambda log: make(k.issues(k.classify(log))), f"{ISSUES} {sql}")


# classification
cls("cls_chat", lambda r: r.where("chat_message IS NOT NULL").select("event_id", F.array_join("chat_labels", ",").alias("labels"), "chat_category", "chat_severity"), "SELECT event_id, array_to_string(chat_labels, ',') AS labels, chat_category, chat_severity FROM cls WHERE chat_message IS NOT NULL")
cls("cls_chat_to_cat", lambda r: r.where("chat_message IS NOT NULL").groupBy("chat_category", "category").agg(F.count("*").alias("n")), "SELECT chat_category, category, count(*) AS n FROM cls WHERE chat_message IS NOT NULL GROUP BY ALL")
cls("cls_ops", lambda r: r.select("event_id", "ops_category", "ops_subtype", "ops_severity"), "SELECT event_id, ops_category, ops_subtype, ops_severity FROM cls")
cls("cls_ops_to_cat", lambda r: r.groupBy("ops_subtype", "category").agg(F.count("*").alias("n")), "SELECT ops_subtype, category, count(*) AS n FROM cls GROUP BY ALL")
cls("cls_category", lambda r: r.select("event_id", "category"), "SELECT event_id, category FROM cls")
cls("cls_tag", lambda r: r.select("event_id", "tag", "severity"), "SELECT event_id, tag, severity FROM cls")
cls("cls_gate", lambda x: x.select("event_id", "category", "gate"), "SELECT event_id, category, gate FROM cls")
over_log("cls_behaviour", lambda log: k.classify(k.behaviour(log)).where("chat_message IS NOT NULL").select("event_id", "chat_flood", "chat_abuse", "category", "tag"), f"{BEHAVIOUR} SELECT event_id, chat_flood, chat_abuse, category, tag FROM cls WHERE chat_message IS NOT NULL")
iss("cls_family", lambda i: i.select("tag", "session", k.family(F.col("category")).alias("family")), f"SELECT tag, session, {FAMILY} AS family FROM iss")
iss("cls_domain", lambda i: i.select("tag", "session", k.domain(F.col("category"), F.col("ops_categories")).alias("domain")), f"SELECT tag, session, {DOMAIN} AS domain FROM iss")
iss("cls_scopes", lambda i: i.select("tag", "session", F.explode(k.scopes()).alias("scope")), f"SELECT tag, session, unnest({k.SCOPES_SQL}) AS scope FROM iss")

# filters
over_log("flt_kind", lambda log: log.withColumn("kind", F.when(F.col("k") % 5 == 0, "METRIC").otherwise("SERVER_LOG")).where("kind = 'SERVER_LOG'").select("event_id"), "SELECT event_id FROM log WHERE k % 5 <> 0")
over_log("flt_retention", lambda log: log.join(F.broadcast(log.agg(F.max("ts_ms").alias("now"))), (F.col("ts_ms") == 0) | (F.col("ts_ms") >= F.col("now") - 7_200_000)).select("event_id"), "SELECT event_id FROM log WHERE ts_ms = 0 OR ts_ms >= (SELECT max(ts_ms) FROM log) - 7200000")
over_log("flt_window", lambda log: log.where("server_id = 's1' AND ts_ms >= 1601734000000 AND ts_ms < 1601745000001").select("event_id", "ts_ms"), "SELECT event_id, ts_ms FROM log WHERE server_id = 's1' AND ts_ms >= 1601734000000 AND ts_ms < 1601745000001")
cls("flt_category_gate", lambda x: agg.gate(x, ["network", "bug"]).select("event_id", "gate"), "SELECT event_id, gate FROM cls WHERE gate IN ('network', 'bug', 'daily')")
cls("flt_benign", lambda x: x.where("ops_subtype = 'machinery'").select("event_id"), "SELECT event_id FROM cls WHERE ops_subtype = 'machinery'")
cls("flt_evidence", lambda x: k.evidence(x).select("event_id"), "SELECT event_id FROM cls WHERE evidence")
iss("flt_passive", lambda i: i.where("tag <> 'server_log_anticheat_vulcan' AND category <> 'daily'").select("tag", "session"), "SELECT tag, session FROM iss WHERE tag <> 'server_log_anticheat_vulcan' AND category <> 'daily'")
iss("flt_actionable", lambda i: i.where("(alert OR rank >= 2) AND tag <> 'server_log_anticheat_vulcan'").select("tag", "session"), "SELECT tag, session FROM iss WHERE (alert OR rank >= 2) AND tag <> 'server_log_anticheat_vulcan'")
iss("flt_alert", lambda i: i.where("alert").select("tag", "session", "n", "severity"), "SELECT tag, session, n, severity FROM iss WHERE alert")
cls("flt_low_value", lambda r: r.where("NOT (category = 'daily' OR endswith(tag, '_observation'))").select("event_id", "severity"), "SELECT event_id, severity FROM cls WHERE category <> 'daily' AND NOT ends_with(tag, '_observation')")
over_log("flt_downsample", lambda log: log.where(c.track(F.col("message"), F.col("level"), "warn_error")["template"]).select("event_id"), "SELECT event_id FROM log WHERE level IN ('WARN', 'WARNING', 'ERROR', 'FATAL', 'SEVERE')")
over_log("flt_overgeneral", lambda log: agg.specific(log.select("event_id", t.normalised(F.col("line")).alias("template")), "template").select("event_id"), f"SELECT event_id FROM (SELECT event_id, string_split({d.normalised('line')}, ' ') AS w FROM log) x WHERE NOT (len(list_filter(w, lambda y: contains(y, '<'))) >= 2 AND len(list_filter(w, lambda y: NOT contains(y, '<') AND length(y) > 3)) = 0)")

# aggregates


def tagged_levels(classified):
    """Every third row without a level of its own, every fifth a summary of a loop."""
    rows = classified.withColumn("tags", F.array(F.lower("level"), F.when(F.col("k") % 5 == 0, "loop_suppressed").otherwise("server_log")))
    return agg.levels(rows.withColumn("level", F.when(F.col("k") % 3 > 0, F.col("level"))).withColumn("loop_suppressed", F.col("k")), ["server_id"])


cls("agg_levels", tagged_levels, "SELECT server_id, count(*) AS records, count_if(level IN ('ERROR', 'FATAL', 'SEVERE'))::BIGINT AS errors, count_if(level IN ('WARN', 'WARNING'))::BIGINT AS warnings, sum(CASE WHEN k % 5 = 0 THEN k ELSE 0 END)::BIGINT AS suppressed FROM cls GROUP BY 1")
cls("agg_buckets", lambda r: r.groupBy("category", "tag").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("server_id")), ",").alias("servers"), F.array_join(F.array_sort(F.collect_set("level")), ",").alias("levels")), "SELECT category, tag, count(*) AS n, array_to_string(list_sort(list_distinct(list(server_id))), ',') AS servers, array_to_string(list_sort(list_distinct(list(level))), ',') AS levels FROM cls GROUP BY ALL")
LISTS = ["servers", "players", "subtypes", "ops_categories", "labels", "plugins", "files", "worlds", "positions"]
iss("agg_issue", lambda i: i.select("category", "tag", "session", "n", "first_ms", "last_ms", *[F.array_join(x, ",").alias(x) for x in LISTS], "severity", "confidence", "alert"), "SELECT category, tag, session, n, first_ms, last_ms, " + ", ".join(f"array_to_string({x}, ',') AS {x}" for x in LISTS) + ", severity, confidence, alert FROM iss")
over_log("agg_issue_behaviour", lambda log: k.issues(k.classify(k.behaviour(log))).where("category = 'chat_review'").select("tag", "session", "n", "severity", "alert", F.array_join("players", ",").alias("players")), f"{issues_sql(BEHAVIOUR)} SELECT tag, session, n, severity, alert, array_to_string(players, ',') AS players FROM iss WHERE category = 'chat_review'")
iss("agg_severity", lambda i: i.groupBy("severity").agg(F.count("*").alias("issues"), F.sum("n").alias("rows")), "SELECT severity, count(*) AS issues, sum(n)::BIGINT AS rows FROM iss GROUP BY ALL")
iss("agg_max_severity", lambda i: i.agg(F.max("rank").alias("rank"), F.max("alert").alias("any_alert")), "SELECT max(rank) AS rank, bool_or(alert) AS any_alert FROM iss")
TERMS = [*r.CRITICAL, *r.ERRORS[:4], *r.PERFORMANCE[:7], *r.CATEGORY_WORDS["network"][:11]]
cls("agg_terms", lambda x: agg.terms(k.evidence(x), ["category"], "message", TERMS).select("category", F.array_join("terms", ",").alias("terms")), "SELECT category, array_to_string(list_slice(list_filter([" + ", ".join(f"CASE WHEN bool_or({c.contains_sql('message', [w])}) THEN {d.q(w)} END" for w in TERMS) + "], lambda x: x IS NOT NULL), 1, 8), ',') AS terms FROM cls WHERE evidence GROUP BY category")
cls("agg_chat_topics", lambda r: agg.topics(r.where("chat_message IS NOT NULL")), "SELECT 'category' AS what, chat_category AS name, count(*) AS n FROM cls WHERE chat_message IS NOT NULL GROUP BY 2 UNION ALL SELECT 'severity', chat_severity, count(*) FROM cls WHERE chat_message IS NOT NULL GROUP BY 2 UNION ALL SELECT 'label', label, count(*) FROM (SELECT unnest(chat_labels) AS label FROM cls WHERE chat_message IS NOT NULL) x GROUP BY 2 UNION ALL SELECT 'players', 'distinct', count(DISTINCT chat_player) FROM cls WHERE chat_message IS NOT NULL UNION ALL SELECT 'talker', name, n FROM (SELECT chat_player AS name, count(*) AS n FROM cls WHERE chat_player <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5) y")
cls("agg_keywords", lambda r: agg.keywords(r.where("chat_message IS NOT NULL"), "chat_message", 10), "SELECT word, n FROM (SELECT word, count(*) AS n FROM (SELECT unnest(list_concat(regexp_extract_all(lower(chat_message), '[a-z]{3,}'), flatten(list_transform(regexp_extract_all(chat_message, '[\\x{4e00}-\\x{9fff}]{2,}'), lambda r: list_transform(range(1, length(r)), lambda i: substr(r, i::INT, 2)))))) AS word FROM cls WHERE chat_message IS NOT NULL) x WHERE word NOT IN ('the', 'and', 'for', 'you', 'that', 'this') GROUP BY 1) y WHERE n >= 2 ORDER BY n DESC, word LIMIT 10")
cls("agg_anticheat", lambda r: agg.anticheat(r.where("cheat_player IS NOT NULL").withColumn("weight", F.greatest(F.lit(1), F.col("k") % 3))), "SELECT player, n, array_to_string(list_transform(list_slice(list_sort(list({'w': -w, 'c': cheat_check})), 1, 3), lambda x: x.c), ',') AS checks FROM (SELECT cheat_player AS player, cheat_check, sum(greatest(1, k % 3))::BIGINT AS w, sum(sum(greatest(1, k % 3))) OVER (PARTITION BY cheat_player)::BIGINT AS n FROM cls WHERE cheat_player IS NOT NULL GROUP BY 1, 2) x GROUP BY ALL")
cls("agg_anticheat_checks", lambda x: agg.anticheat_checks(x.where("cheat_player IS NOT NULL").withColumn("weight", F.greatest(F.lit(1), F.col("k") % 3))), 'SELECT cheat_check AS "check", sum(greatest(1, k % 3))::BIGINT AS n, count(DISTINCT cheat_player) AS players, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms FROM cls WHERE cheat_player IS NOT NULL GROUP BY 1')
cls("agg_player_samples", lambda x: agg.samples(x.where("chat_player <> ''"), ["chat_player"], "chat_message", ["ts_ms", "seq"]), "SELECT chat_player, sum(c)::BIGINT AS n, array_to_string(list_slice(list(chat_message ORDER BY t, q), 1, 5), '|') AS samples FROM (SELECT chat_player, chat_message, count(*) AS c, min(ts_ms) AS t, arg_min(seq, (ts_ms, seq)) AS q FROM cls WHERE chat_player <> '' GROUP BY 1, 2) x GROUP BY 1")
ABUSE = f"SELECT player, class, count(*) AS n FROM (SELECT chat_player AS player, {c.review_class_sql('chat_message')} AS class FROM cls WHERE chat_player <> '') x WHERE class IS NOT NULL GROUP BY ALL HAVING count(*) >= CASE WHEN class = 'sensitive' THEN 1 ELSE 2 END"
cls("agg_abuse", lambda x: k.abuses(x.where("chat_message IS NOT NULL")), ABUSE)


def abuse_players(rows):
    """Players with their abuses, classes and five different messages of those classes."""
    chat = rows.where("chat_message IS NOT NULL")
    found = k.abuses(chat)
    said = chat.withColumn("class", c.review_class(F.col("chat_message"))).join(found.select(F.col("player").alias("chat_player"), "class"), ["chat_player", "class"])
    texts = agg.samples(said.withColumnRenamed("chat_player", "said_by"), ["said_by"], "chat_message", ["ts_ms", "seq"])
    totals = found.groupBy("player").agg(F.sum("n").alias("n"), F.array_join(F.array_sort(F.collect_set("class")), ",").alias("classes"))
    return totals.join(texts.select(F.col("said_by").alias("player"), "samples"), "player")


SAMPLED = "SELECT player, array_to_string(list_slice(list(chat_message ORDER BY ts_ms, seq), 1, 5), '|') AS samples FROM (SELECT player, chat_message, min(ts_ms) AS ts_ms, arg_min(seq, (ts_ms, seq)) AS seq FROM ({}) s0 GROUP BY ALL) s1 GROUP BY 1"
cls("agg_abuse_players", abuse_players, f"SELECT player, n, classes, samples FROM (SELECT player, sum(n)::BIGINT AS n, array_to_string(list_sort(list(class)), ',') AS classes FROM ({ABUSE}) y GROUP BY 1) t JOIN ({SAMPLED.format(f"SELECT a.player, x.chat_message, x.ts_ms, x.seq FROM (SELECT *, {c.review_class_sql('chat_message')} AS class FROM cls WHERE chat_player <> '') x JOIN ({ABUSE}) a ON a.player = x.chat_player AND a.class = x.class")}) u USING (player)")
over_log(
    "agg_review_evidence",
    lambda log: agg.review_evidence(k.classify(k.behaviour(log)).where("chat_player <> ''").withColumn("class", c.review_class(F.col("chat_message")))).select("event_id", "chat_player", "reason"),
    f"""{BEHAVIOUR}, rv AS (SELECT event_id, chat_player, ts_ms, seq, CASE WHEN chat_flood THEN 'flood' WHEN chat_abuse THEN 'abuse' WHEN {c.review_class_sql('chat_message')} IS NOT NULL THEN 'hint' END AS reason FROM cls WHERE chat_player <> ''),
rn AS (SELECT *, row_number() OVER (PARTITION BY chat_player, reason ORDER BY ts_ms, seq) AS r FROM rv WHERE reason IS NOT NULL)
SELECT event_id, chat_player, reason FROM rn WHERE r <= 3 ORDER BY CASE reason WHEN 'flood' THEN 0 WHEN 'abuse' THEN 1 ELSE 2 END, ts_ms, seq LIMIT 10""",
)
over_log("agg_window_totals", lambda log: log.groupBy("server_id").agg(F.count("*").alias("n"), F.count_distinct("player").alias("players")), "SELECT server_id, count(*) AS n, count(DISTINCT player) AS players FROM log GROUP BY ALL")
HOURLY = "SELECT server_id, (ts_ms // 3600000) * 3600000 AS hour, count(*) AS records, count_if(level = 'ERROR')::BIGINT AS errors, count_if(level = 'WARN')::BIGINT AS warnings, count_if(level = 'INFO')::BIGINT AS infos FROM log GROUP BY ALL"
over_log("agg_hourly", agg.hourly, HOURLY)
over_log("agg_cycle", lambda log: agg.cycle(agg.hourly(log)), f"SELECT server_id, cycle, count(*) AS hours, sum(records)::BIGINT AS records, sum(errors)::BIGINT AS errors FROM (SELECT *, (hour - min(hour) OVER (PARTITION BY server_id)) // 28800000 AS cycle FROM ({HOURLY}) h) x -- log\n GROUP BY ALL")
cls("agg_timeline", lambda x: agg.timeline(x, ["ts_ms", "seq"], 8), ", ck AS (SELECT *, (row_number() OVER (ORDER BY ts_ms, seq) - 1) // ceil(count(*) OVER () / 8.0)::BIGINT AS chunk FROM cls), tg AS (SELECT chunk, array_to_string(list_slice(list(tag ORDER BY n DESC, tag), 1, 3), ',') AS tags FROM (SELECT chunk, tag, count(*) AS n FROM ck GROUP BY ALL) x GROUP BY 1) SELECT chunk, count(*) AS n, min(ts_ms) AS start_ms, max(ts_ms) AS end_ms, count_if(level = 'ERROR')::BIGINT AS errors, any_value(tags) AS tags FROM ck JOIN tg USING (chunk) GROUP BY 1")
over_log("agg_templates", lambda log: log.groupBy("server_id", t.fingerprint(F.col("line")).alias("template")).agg(F.count("*").alias("n")), f"SELECT server_id, {d.fingerprint('line')} AS template, count(*) AS n FROM log GROUP BY ALL")
FACTS = ["servers", "players", "plugins", "files", "worlds", "positions"]
iss("agg_facts", lambda i: agg.facts(i), "SELECT category, min(first_ms) AS first_ms, max(last_ms) AS last_ms, " + ", ".join(f"array_to_string(list_sort(list_distinct(flatten(list({x})))), ',') AS {x}" for x in FACTS) + " FROM iss GROUP BY 1")
iss("agg_notes", lambda i: i.select(F.explode("servers").alias("s"), "tag").agg(F.count_distinct("s").alias("servers"), F.count_distinct("tag").alias("tags")), "SELECT count(DISTINCT s) AS servers, count(DISTINCT tag) AS tags FROM (SELECT unnest(servers) AS s, tag FROM iss) x")
iss("agg_title_rollup", lambda i: agg.titles(i, c.title("tag").make()), f"SELECT {c.title('tag').sql} AS title, sum(n)::BIGINT AS n, max(rank) AS rank, min(first_ms) AS first_ms, array_to_string(list_sort(list_distinct(flatten(list(servers)))), ',') AS servers FROM iss GROUP BY 1")
iss("agg_player_problems", lambda i: agg.player_problems(i, c.shown("severity", 0).make()), f"SELECT category, action, count(*) AS players, array_to_string(list_slice(list_sort(list(player)), 1, 6), ',') AS names FROM (SELECT DISTINCT category, {c.shown('severity', 0).sql} AS action, unnest(players) AS player FROM iss) x GROUP BY ALL")
cls("agg_observations", lambda r: r.where("endswith(tag, '_observation')").groupBy("tag").agg(F.count("*").alias("n")), "SELECT tag, count(*) AS n FROM cls WHERE ends_with(tag, '_observation') GROUP BY 1")
SPLIT_MS = 1601740000000


def life(i):
    """Issues before and from a moment on, by tag and server: which are new, go on, or have recovered, beside what needs a review."""
    at = lambda rows: rows.select("tag", F.explode("servers").alias("server"), "last_ms").groupBy(F.concat_ws(":", "tag", "server").alias("key")).agg(F.max("last_ms").alias("ts_ms"))
    states = joins.lifecycle(at(i.where(F.col("first_ms") >= SPLIT_MS)), at(i.where(F.col("first_ms") < SPLIT_MS)), "key", "ts_ms")
    counts = states.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("new", "ongoing", "recovered")])
    return counts.crossJoin(i.agg(F.count_if("alert").alias("needs_review"), F.count_if(F.col("rank") >= 4).alias("immediate"), F.count("*").alias("all")))


_AT = "SELECT tag || ':' || server AS key, max(last_ms) AS ts_ms FROM (SELECT tag, unnest(servers) AS server, last_ms FROM iss WHERE first_ms {} " + str(SPLIT_MS) + ") x GROUP BY 1"
iss("agg_lifecycle_counts", life, f"""SELECT count_if(status = 'new')::BIGINT AS new, count_if(status = 'ongoing')::BIGINT AS ongoing, count_if(status = 'recovered')::BIGINT AS recovered, (SELECT count_if(alert)::BIGINT FROM iss) AS needs_review, (SELECT count_if(rank >= 4)::BIGINT FROM iss) AS immediate, (SELECT count(*) FROM iss) AS "all"
FROM (SELECT CASE WHEN a.key IS NULL THEN 'recovered' WHEN b.key IS NULL OR a.ts_ms - b.ts_ms > 1800000 THEN 'new' ELSE 'ongoing' END AS status FROM ({_AT.format('>=')}) a FULL JOIN ({_AT.format('<')}) b ON a.key = b.key) s""")
iss("fn_labels", lambda i: i.select("tag", "session", *[c.shown("severity", n).make().alias(x) for n, x in enumerate(("label", "timing", "impact"))], c.title("tag").make().alias("title")), f"SELECT tag, session, {c.shown('severity', 0).sql} AS label, {c.shown('severity', 1).sql} AS timing, {c.shown('severity', 2).sql} AS impact, {c.title('tag').sql} AS title FROM iss")
iss("agg_sections", lambda i: agg.sections(i), "SELECT section, array_to_string(list_slice(list(bullet ORDER BY rank DESC, n DESC, first_ms, bullet), 1, 8), chr(10)) AS bullets FROM (SELECT CASE WHEN category IN ('chat_review', 'community', 'moderation') THEN 'community' WHEN category = 'player_feedback' THEN 'players' WHEN rank >= 4 THEN 'urgent' ELSE 'operations' END AS section, substr(tag || ': ' || n || ' rows, ' || severity, 1, 220) AS bullet, rank, n, first_ms FROM iss) x GROUP BY 1")
iss("sort_issues", lambda i: i.orderBy(F.desc("rank"), "first_ms", "tag", "session").limit(20).select("tag", "session", "rank"), "SELECT tag, session, rank FROM iss ORDER BY rank DESC, first_ms, tag, session LIMIT 20")
iss("sort_managed", lambda i: i.where("alert").orderBy(F.desc("rank"), "first_ms", "tag", "session").limit(3).select("tag", "session"), "SELECT tag, session FROM iss WHERE alert ORDER BY rank DESC, first_ms, tag, session LIMIT 3")

# incidents
INCIDENTS = f"""{ISSUES}, kd AS (SELECT *, category || ':' || tag || ':' || session AS issue, {FAMILY} AS family FROM iss WHERE tag <> 'server_log_anticheat_vulcan'),
ke AS (SELECT *, CASE WHEN family = 'operations' THEN {DOMAIN} ELSE '' END AS domain FROM kd),
kf AS (SELECT *, CASE WHEN len({k.SCOPES_SQL}) = 0 THEN ['window'] ELSE {k.SCOPES_SQL} END AS scopes FROM ke),
per AS (SELECT issue, family, domain, first_ms, last_ms, unnest(scopes) AS scope FROM kf),
ch AS (SELECT *, sum(split) OVER (PARTITION BY family, domain, scope ORDER BY first_ms, issue ROWS UNBOUNDED PRECEDING) AS chain FROM (SELECT *, CASE WHEN first_ms > max(last_ms) OVER (PARTITION BY family, domain, scope ORDER BY first_ms, issue ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 300000 THEN 1 ELSE 0 END AS split FROM per) x),
ln AS (SELECT issue, family || '|' || domain || '|' || scope || '|' || chain AS c FROM ch),
reach AS (WITH RECURSIVE go(a, b) AS (SELECT issue, issue FROM ke UNION SELECT go.a, l2.issue FROM go JOIN ln l1 ON l1.issue = go.b JOIN ln l2 ON l2.c = l1.c) SELECT a, min(b) AS incident FROM go GROUP BY 1),
inc AS (SELECT incident, any_value(family) AS family, any_value(domain) AS domain, count(*) AS issues, sum(n)::BIGINT AS n, min(first_ms) AS start_ms, max(last_ms) AS end_ms, list_sort(list_distinct(flatten(list(scopes)))) AS scopes, list_sort(list_distinct(flatten(list(subtypes)))) AS subtypes, list_sort(list_distinct(list(tag))) AS tags, list_sort(list_distinct(flatten(list(labels)))) AS labels, bool_or(f_accident) AS accident, max(rank) AS rank, bool_or(alert) AS alert FROM kf JOIN reach ON reach.a = kf.issue GROUP BY incident)"""


def inc(name: str, make, sql: str) -> None:
    over_log(name, lambda log: make(k.incidents(k.issues(k.classify(log)))), f"{INCIDENTS} {sql}")


inc("agg_incident", lambda i: i.select("incident", "family", "domain", "issues", "n", "start_ms", "end_ms", F.array_join("scopes", ",").alias("scopes"), "rank", "alert"), "SELECT incident, family, domain, issues, n, start_ms, end_ms, array_to_string(scopes, ',') AS scopes, rank, alert FROM inc")
inc("join_overlap_merge", lambda i: i.groupBy("family", "domain").agg(F.count("*").alias("incidents"), F.sum("issues").alias("issues")), "SELECT family, domain, count(*) AS incidents, sum(issues)::BIGINT AS issues FROM inc GROUP BY ALL")
inc("cls_signature", lambda i: k.identified(i).select("incident", "state_key", "id"), """, sg AS (SELECT incident, start_ms, substr(sha256(concat_ws('|', family, array_to_string(scopes, ','), array_to_string(tags, ','), array_to_string(list_sort(list_distinct(list_concat(subtypes, labels))), ','))), 1, 16) AS sign FROM inc),
st AS (SELECT incident, CASE WHEN nth = 1 THEN sign ELSE sign || ':' || nth END AS state_key FROM (SELECT *, row_number() OVER (PARTITION BY sign ORDER BY start_ms, incident) AS nth FROM sg) x)
SELECT incident, state_key, 'MS-' || upper(substr(sha256(state_key), 1, 12)) AS id FROM st""")
inc("flt_suppressed", lambda i: i.where(~k.suppressed(F.col("family"), F.col("rank"), F.col("n"))).select("incident", "family"), "SELECT incident, family FROM inc WHERE NOT (family = 'operations' AND rank <= 2 AND n <= 1)")
inc("flt_observation", lambda i: i.select("incident", k.observation(F.col("family"), F.col("rank"), F.col("labels"), F.col("accident")).alias("observation")), "SELECT incident, CASE WHEN family = 'community' THEN len(labels) = 0 AND rank <= 2 WHEN family = 'community_ops' THEN NOT (rank >= 3 AND accident) WHEN family = 'chat_review' THEN rank < 3 ELSE false END AS observation FROM inc")
over_log("flagship", lambda log: agg.flagship(k.classify(log)), f"{CLS} SELECT server_id, (ts_ms // 3600000) * 3600000 AS hour, count(*) AS records, count_if(level = 'ERROR')::BIGINT AS errors, count_if(category <> 'daily')::BIGINT AS notable, count(DISTINCT phrase) AS templates FROM cls GROUP BY ALL")
