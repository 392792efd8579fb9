"""Rows with their category, tag and severity, and what issues are made of them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlog.functions import catalogue as c
from loomlog.functions import rules as r
from loomlog.functions import text as t
from loomlog.operators.windows import sessions, slots, time_slot
from loomlog.sources.shared import written

FEEDBACK_GAP_MS, ISSUE_GAP_MS = 900_000, 300_000
#: Categories whose low issues count as medium.
LIFTED = ["chat_review", "community", "community_ops", "moderation"]
FLAGS = list(c.FLAGS)
#: Rows of a class that make an abuse of one player's chat.
ABUSE_LEAST = {"sensitive": 1}


def classify(log: DataFrame, line: str = "line", message: str = "message", level: str = "level") -> DataFrame:
    """log with chat_player, chat_message, cheat_player, cheat_check, the columns of catalogue.COLUMNS and NAMED.

    Rows whose boolean columns chat_flood, chat_abuse or loop_suppressed are set, where the
    log has them, count as such. Rules read a line but for its clock, the message, the level
    and those marks: each different set of them is judged once, to a written table that rows
    are joined with (broadcast or not by its size). Where no two rows are alike, that is one
    row each, and the join.
    """
    mark = lambda name: F.coalesce(F.col(name), F.lit(False)) if name in log.columns else F.lit(False)
    read = {"_line": without_clock(F.col(line)), "_message": F.col(message), "_level": F.col(level), "_flood": mark("chat_flood"), "_abuse": mark("chat_abuse"), "_loop": mark("loop_suppressed")}
    parts = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number keeps short tables of lines, which take long, from one task
    each = written(judged(log.select(*[v.alias(k) for k, v in read.items()]).distinct().repartition(parts, *read)), "judged")
    made = [*PARTS, *c.COLUMNS, *NAMED]
    right = each.select(*[F.col(k).alias(f"r{k}") for k in read], *made)
    same = [F.col(k).eqNullSafe(F.col(f"r{k}")) for k in read]  # of columns: a key's expression is evaluated twice
    return log.withColumns(read).join(right, reduce(and_, same), "left").select(*log.columns, *made)


PARTS = ["chat_player", "chat_message", "cheat_player", "cheat_check"]
#: What a line names that issues hold (named()).
NAMED = ["named_label", "named_plugin", "named_file", "named_world", "named_position"]


def named(message: Column) -> dict[str, Column]:
    """NAMED: chat labels but for small talk, and the first plugin, file, world and position of a message."""
    talk = [x[1] for x in r.CHAT if x[0] in ("small_talk", "building")]
    first = [F.get(F.regexp_extract_all(message, F.lit(p), F.lit(1)), 0) for p in (t.PLUGIN, t.CONFIG_FILE, t.WORLD, t.POSITION)]
    return dict(zip(NAMED, [F.filter("chat_labels", lambda x: ~x.isin(*talk, "chatting")), *first], strict=True))


def without_clock(line: Column) -> Column:
    """A line whose clock is set to zero where a bracket that ends in ]: follows, as no rule reads that clock."""
    return F.regexp_replace(line, r"^\[[0-9]{2}:[0-9]{2}:[0-9]{2}\](?= \[[^\]]*\]:)", "[00:00:00]")


def judged(rows: DataFrame) -> DataFrame:
    """rows (_line, _message, _level, _flood, _abuse, _loop) with PARTS, catalogue.COLUMNS and NAMED.

    Made in steps of one generator each: what later steps use again is a column by then, and
    filters and joins on it never repeat the rules.
    """
    step = lambda rows, columns: rows.select("*", F.inline(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))))
    own = rows.columns
    rows = step(rows, {"_chat": t.chat(F.col("_line")), "_cheat": t.anticheat(F.col("_line"))} | c.features(F.col("_line"), F.col("_message"), F.col("_level")))
    said = F.col("_chat.message")
    parts = dict(zip(PARTS, [F.col("_chat.player"), said, F.col("_cheat.player"), F.col("_cheat.check")], strict=True))
    rows = step(rows, parts | {"_kinds": c.kinds(F.col("_bare")), "_w": c.LINE.found(F.col("_t")), "_cw": F.when(said.isNotNull(), t.let(F.lower(said), c.SAID.found))})
    for made in c.STEPS:
        rows = step(rows, {k: e.make() for k, e in made.items()})
    return rows.select(*own, *PARTS, *c.COLUMNS, *[v.alias(k) for k, v in named(F.col("_message")).items()])


def abuses(chat: DataFrame, key: str = "chat_player", message: str = "chat_message") -> DataFrame:
    """(player, class, n): players whose chat holds words of one class of reviews often enough: sensitive ones once, others twice."""
    rows = chat.where(F.col(key) != "").select(F.col(key).alias("player"), c.review_class(F.col(message)).alias("class")).where("class IS NOT NULL")
    least = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ABUSE_LEAST.items() for x in kv]), F.col("class")), F.lit(2))
    return rows.groupBy("player", "class").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def behaviour(log: DataFrame, event_id: str = "event_id") -> DataFrame:
    """log with chat_flood and chat_abuse: chat rows inside a flood of their player, and those of a class of words that its player abuses.

    Chat is parsed once, to a written table that floods and abuses read.
    """
    from loomlog.operators.joins import tag_intervals
    from loomlog.operators.windows import floods

    parsed = t.chat(F.col("line"))
    made = F.array(F.struct(parsed["player"].alias("chat_player"), parsed["message"].alias("chat_message")))
    chat = written(log.select(event_id, "ts_ms", "seq", F.inline(F.filter(made, lambda x: x["chat_player"] != ""))), "chat")
    flooded = tag_intervals(chat.withColumnRenamed("chat_player", "player"), floods(chat, "chat_player").withColumnRenamed("chat_player", "player"), "player", "ts_ms", event_id).where("kind IS NOT NULL").select(event_id, F.lit(True).alias("chat_flood"))
    found = abuses(chat).select(F.col("player").alias("chat_player"), F.col("class").alias("_class"), F.lit(True).alias("chat_abuse"))
    abused = chat.withColumn("_class", c.review_class(F.col("chat_message"))).join(found, ["chat_player", "_class"]).select(event_id, "chat_abuse")
    marked = written(flooded.join(abused, event_id, "full"), "behaviour")
    out = log.join(marked, event_id, "left")
    return out.select(*log.columns, *[F.coalesce(x, F.lit(False)).alias(x) for x in ("chat_flood", "chat_abuse")])


def evidence(rows: DataFrame) -> DataFrame:
    """Rows that can be evidence: behaviour, anticheat, chat that needs an admin, trouble; not daily, not healthy INFO, not observations."""
    return rows.where("evidence")


def ladder(n: Column, flags: dict[str, Column]) -> Column:
    """The severity of a group from its rows' flags and their number; the first hit decides."""
    return (
        F.when(flags["critical"], "critical")
        .when(flags["loop"] | flags["load_failure"] | flags["sensitive"] | flags["accident"], "high")
        .when(flags["trouble"], F.when(n >= 2, "high").otherwise("medium"))
        .when(flags["slow"], F.when(n >= 3, "high").otherwise("medium"))
        .when(flags["network"], F.when(n >= 5, "high").when(n >= 2, "medium").otherwise("low"))
        .when(flags["review"] | flags["operations"], "medium")
        .when(flags["feedback"], F.when(n >= 3, "medium").otherwise("low"))
        .when(flags["warned"], F.when(n >= 2, "medium").otherwise("low"))
        .when(flags["identity"], "medium")
        .otherwise("low")
    )


#: The ladder in SQL, over columns n and f_<flag>, as ranks.
LADDER_SQL = (
    "CASE WHEN f_critical THEN 4 WHEN f_loop OR f_load_failure OR f_sensitive OR f_accident THEN 3 WHEN f_trouble THEN CASE WHEN n >= 2 THEN 3 ELSE 2 END"
    " WHEN f_slow THEN CASE WHEN n >= 3 THEN 3 ELSE 2 END WHEN f_network THEN CASE WHEN n >= 5 THEN 3 WHEN n >= 2 THEN 2 ELSE 1 END WHEN f_review OR f_operations THEN 2"
    " WHEN f_feedback THEN CASE WHEN n >= 3 THEN 2 ELSE 1 END WHEN f_warned THEN CASE WHEN n >= 2 THEN 2 ELSE 1 END WHEN f_identity THEN 2 ELSE 1 END"
)


def group_rank(n: Column, flags: dict[str, Column], plain_info: Column, anomaly: Column, own: Column, category: Column) -> Column:
    """The rank of a group: the ladder; groups of plain INFO are capped, spikes lift to high, rows' own severity counts, some categories are never low."""
    base = c.severity_rank(ladder(n, flags))
    capped = F.when(plain_info, F.when(n <= 2, 1).otherwise(F.least(base, F.lit(2)))).when(anomaly >= 0.6, F.greatest(base, F.lit(3))).otherwise(base)
    rank = F.greatest(capped, own)
    return F.when((rank <= 1) & category.isin(LIFTED), 2).otherwise(rank)


#: Sets of an issue, and the columns that they are made of.
SETS = {"servers": "server_id", "players": "player", "levels": "level", "subtypes": "ops_subtype", "ops_categories": "ops_category", "labels": "label", "plugins": "plugin", "files": "file", "worlds": "world", "positions": "position"}


def gap() -> Column:
    return F.when(F.col("category") == "player_feedback", FEEDBACK_GAP_MS).otherwise(ISSUE_GAP_MS)


def shown_spans(rows: DataFrame, found: DataFrame) -> DataFrame:
    """category, tag, session, first_ms, last_ms of issues (issues(rows)) as they are shown: by the times in all lines of their evidence. No issue gathers its lines."""
    keys = ["category", "tag", "session"]
    lines = sessions(evidence(rows).select("category", "tag", "ts_ms", "line"), keys[:2], "ts_ms", gap_ms=gap())
    times = t.sample_times(F.array("line"), F.col("first_ms"))
    met = lines.join(found.select(*keys, "first_ms"), keys).select(*keys, times.alias("times"))
    reach = met.groupBy(*keys).agg(F.min(F.array_min("times")).alias("low"), F.max(F.array_max("times")).alias("high"))
    shown = t.tightened_to(F.col("category"), F.col("first_ms"), F.col("last_ms"), F.col("low"), F.col("high"))
    return found.select(*keys, "first_ms", "last_ms").join(reach, keys, "left").select(*keys, shown.alias("x")).select(*keys, "x.*")


def alike(rows: DataFrame) -> DataFrame:
    """Evidence for issues(): n rows of one slot that differ in nothing which issues hold are one, with their first and last time and largest anomaly_score.

    What it is of is bounded by what rows of a slot say, not by how many they are; each task
    reduces its own rows before they are shuffled.
    """
    serious = F.col("ops_admin") | F.col("ops_severity").isin("medium", "high", "critical")
    own = {k.removeprefix("named_"): F.col(k) for k in NAMED} | {"ops_subtype": F.when(serious, F.col("ops_subtype")), "ops_category": F.when(serious, F.col("ops_category"))}
    score = F.col("anomaly_score").cast("double") if "anomaly_score" in rows.columns else F.lit(0.0)
    same = ["category", "tag", "server_id", "player", "level", "plain_info", "own_rank", *[f"f_{k}" for k in FLAGS]]
    facts = evidence(rows).select(*same, "ts_ms", time_slot("ts_ms", gap()).alias("slot"), score.alias("anomaly"), *[v.alias(k) for k, v in own.items()])
    return facts.groupBy(*same, "slot", *own).agg(F.count("*").alias("n"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"), F.max("anomaly").alias("anomaly"))


def issues(rows: DataFrame) -> DataFrame:
    """One row for each stretch of evidence of a (category, tag) without a long gap; written, as is the evidence.

    Severity is group_rank's (of a column anomaly_score, where rows have one); low and daily
    issues go. The rules are evaluated once: evidence is reduced to alike() rows and written,
    then to slots where it lies, slots to issues, so no category gathers its rows.
    """
    keys = ["category", "tag"]
    facts = written(alike(rows), "evidence")
    slot, found = slots(facts, keys, "first_ms", gap(), "last_ms")
    sets = [(F.array_distinct(F.flatten(F.collect_set(v))) if v == "label" else F.collect_set(v)).alias(k) for k, v in SETS.items()]
    short = facts.groupBy(*keys, slot.alias("_slot")).agg(
        F.sum("n").alias("n"), F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"), *sets, F.max("own_rank").alias("own"), F.min("plain_info").alias("plain_info"), F.max("anomaly").alias("anomaly"), *[F.max(f"f_{k}").alias(f"f_{k}") for k in FLAGS]
    )
    right = found.select(*[F.col(x).alias(f"_{x}") for x in keys], F.col("_slot").alias("_s"), "session")
    met = short.join(right, (F.col("category") == F.col("_category")) & (F.col("tag") == F.col("_tag")) & F.col("_slot").eqNullSafe(F.col("_s")))
    merged = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(k)))).alias(k) for k in SETS]
    out = met.groupBy(*keys, "session").agg(
        F.sum("n").alias("n"), F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"), *merged, F.max("own").alias("own"), F.min("plain_info").alias("plain_info"), F.max("anomaly").alias("anomaly"), *[F.max(f"f_{k}").alias(f"f_{k}") for k in FLAGS]
    )
    flags = {k: F.col(f"f_{k}") for k in FLAGS}
    rank = group_rank(F.col("n"), flags, F.col("plain_info"), F.col("anomaly"), F.col("own"), F.col("category"))
    out = out.withColumn("rank", rank.cast("int")).where("rank > 1 AND category <> 'daily'")
    confidence = F.least(F.lit(0.98), 0.5 + 0.08 * F.col("n"))
    out = out.withColumn("severity", F.get(F.array(*[F.lit(s) for s in c.SEVERITIES]), F.col("rank"))).withColumn("confidence", F.round(confidence, 4))
    out = out.withColumn("alert", alert(F.col("category"), F.col("rank"), F.col("n"), F.size("servers"), flags))
    return written(out.select("category", "tag", "session", "n", "first_ms", "last_ms", *SETS, "severity", "rank", "confidence", "alert", "f_accident"), "issues")


def alert(category: Column, rank: Column, n: Column, servers: Column, flags: dict[str, Column], least_rank: int = 3, least: int = 3) -> Column:
    """Critical alerts, loops that are high, medium ones of several servers; then by category: reviews that are high, sensitive, of behaviour or many, never feedback, operations of a community if high; else high ones with enough evidence."""
    return (
        F.when(rank >= 4, True)
        .when(flags["loop"] & (rank >= 3), True)
        .when((servers >= 2) & (rank >= 2), True)
        .when(category == "chat_review", (rank >= 3) | flags["sensitive"] | flags["behaviour"] | (n >= 5))
        .when(category == "player_feedback", False)
        .when(category == "community_ops", rank >= 3)
        .when(rank < least_rank, False)
        .otherwise(n >= least)
    )


ALERT_SQL = "CASE WHEN rank >= 4 THEN true WHEN f_loop AND rank >= 3 THEN true WHEN len(servers) >= 2 AND rank >= 2 THEN true WHEN category = 'chat_review' THEN rank >= 3 OR f_sensitive OR f_behaviour OR n >= 5 WHEN category = 'player_feedback' THEN false WHEN category = 'community_ops' THEN rank >= 3 WHEN rank < 3 THEN false ELSE n >= 3 END"
FAMILIES = ["community", "chat_review", "player_feedback", "community_ops", "moderation"]
FAMILY_SQL = "CASE WHEN category IN (" + ", ".join(f"'{x}'" for x in FAMILIES) + ") THEN category ELSE 'operations' END"
#: Failure domains: of a category, else of the first operations category that an issue has.
BY_CATEGORY = {"network": "network", "cross_server": "network", "economy": "economy", "complaint": "performance", "plugin": "plugin"}
BY_OPERATIONS = [("storage", "database"), ("economy", "economy"), ("network", "network"), ("performance", "performance"), ("position", "position"), ("world", "world"), ("permission", "permission"), ("plugin", "plugin")]
DOMAIN_SQL = "CASE " + " ".join(f"WHEN category = '{k}' THEN '{v}'" for k, v in BY_CATEGORY.items()) + " " + " ".join(f"WHEN list_contains(ops_categories, '{k}') THEN '{v}'" for k, v in BY_OPERATIONS) + " ELSE category END"


def family(category: Column) -> Column:
    return F.when(category.isin(FAMILIES), category).otherwise("operations")


def domain(category: Column, ops_categories: Column) -> Column:
    """The technical domain of an issue, which keeps incidents of different causes apart."""
    out = None
    for k, v in BY_CATEGORY.items():
        out = F.when(category == k, v) if out is None else out.when(category == k, v)
    for k, v in BY_OPERATIONS:
        out = out.when(F.array_contains(ops_categories, k), v)
    return out.otherwise(category)


#: Kinds of scopes, and the sets of an issue that they are made of.
SCOPES = {"server": "servers", "plugin": "plugins", "position": "positions"}
SCOPES_SQL = "list_sort(list_concat(" * len(SCOPES) + "[]::VARCHAR[]" + "".join(f", list_transform({v}, lambda x: '{k}:' || x)))" for k, v in SCOPES.items())
SCOPES_SQL = f"list_sort(list_concat({SCOPES_SQL}, CASE WHEN len(players) = 1 THEN ['player:' || players[1]] ELSE []::VARCHAR[] END))"


def scopes(issue: Callable[[str], Column] = F.col) -> Column:
    """What an issue is about, as typed names: its servers, plugins and positions, and its player if it has one only; sorted.

    A world's name is that of many servers, so worlds are no scope; an issue without any scope
    is one of the whole window.
    """
    typed = lambda kind, names: F.transform(names, lambda x: F.concat(F.lit(f"{kind}:"), x))
    kinds = [typed(kind, issue(v)) for kind, v in SCOPES.items()]
    alone = F.when(F.size(issue("players")) == 1, typed("player", issue("players")))
    return F.array_sort(F.array_distinct(F.concat(*kinds, F.coalesce(alone, F.array().cast("array<string>")))))


def incidents(found: DataFrame, window_ms: int = 300_000) -> DataFrame:
    """Issues of one family and domain that share a scope and touch within window_ms, as one incident each.

    An issue joins the incidents of all its scopes: scopes grow over the whole chain. Chains in
    time are cut by gaps per (family, domain, scope), then those that share an issue are joined
    by their smallest member, as connected components.
    """
    from loomlog.operators.graph import components

    keyed = found.withColumn("family", family(F.col("category"))).withColumn("domain", F.when(family(F.col("category")) == "operations", domain(F.col("category"), F.col("ops_categories"))).otherwise(""))
    keyed = keyed.where("tag <> 'server_log_anticheat_vulcan'").withColumn("issue", F.concat_ws(":", "category", "tag", F.col("session").cast("string")))
    whole = F.array(F.lit("window"))
    keyed = keyed.withColumn("_scopes", scopes()).withColumn("scopes", F.when(F.size("_scopes") == 0, whole).otherwise(F.col("_scopes"))).drop("_scopes")
    per = keyed.select("issue", "family", "domain", "first_ms", "last_ms", F.explode("scopes").alias("scope"))
    w = Window.partitionBy("family", "domain", "scope").orderBy("first_ms", "issue")
    reach = F.max("last_ms").over(w.rowsBetween(Window.unboundedPreceding, -1))
    chained = per.withColumn("split", F.when(F.col("first_ms") > reach + window_ms, 1).otherwise(0)).withColumn("chain", F.sum("split").over(w))
    links = chained.withColumn("head", F.min("issue").over(Window.partitionBy("family", "domain", "scope", "chain"))).select(F.col("issue").alias("a"), F.col("head").alias("b"))
    named = components(links).withColumnRenamed("node", "issue")
    out = keyed.join(named, "issue", "left").withColumn("incident", F.coalesce("component", "issue"))
    return out.groupBy("incident").agg(
        F.first("family").alias("family"),
        F.first("domain").alias("domain"),
        F.count("*").alias("issues"),
        F.sum("n").alias("n"),
        F.min("first_ms").alias("start_ms"),
        F.max("last_ms").alias("end_ms"),
        *[F.array_sort(F.array_distinct(F.flatten(F.collect_list(x)))).alias(x) for x in ("scopes", "servers", "labels", "subtypes")],
        F.array_sort(F.collect_set("tag")).alias("tags"),
        F.max("f_accident").alias("accident"),
        F.max("rank").alias("rank"),
        F.max("alert").alias("alert"),
    )


def suppressed(family_: Column, rank: Column, n: Column) -> Column:
    """Groups of operations that are a single row of no more than medium weight."""
    return (family_ == "operations") & (rank <= 2) & (n <= 1)


def observation(family_: Column, rank: Column, labels: Column, accident: Column) -> Column:
    """Groups that are reported as observations: unlabelled community ones, operations of a community without an accident, chat reviews below high."""
    return F.when(family_ == "community", (F.size(labels) == 0) & (rank <= 2)).when(family_ == "community_ops", ~((rank >= 3) & accident)).when(family_ == "chat_review", rank < 3).otherwise(False)


def signature(family_: Column, scopes_: Column, tags_: Column, semantics: Column) -> Column:
    """16 hex digits of what an incident is about, whenever it happens."""
    return F.substring(F.sha2(F.concat_ws("|", family_, F.array_join(scopes_, ","), F.array_join(tags_, ","), F.array_join(semantics, ",")), 256), 1, 16)


def identified(found: DataFrame) -> DataFrame:
    """incidents with state_key and id: of several with one signature the second and later ones, by start, get its number as a suffix."""
    sign = signature(F.col("family"), F.col("scopes"), F.col("tags"), F.array_sort(F.array_distinct(F.concat("subtypes", "labels"))))
    nth = F.row_number().over(Window.partitionBy("_sign").orderBy("start_ms", "incident"))
    rows = found.withColumn("_sign", sign).withColumn("_nth", nth)
    key = F.when(F.col("_nth") == 1, F.col("_sign")).otherwise(F.concat_ws(":", "_sign", "_nth"))
    rows = rows.withColumn("state_key", key).drop("_sign", "_nth")
    return rows.withColumn("id", F.concat(F.lit("MS-"), F.upper(F.substring(F.sha2("state_key", 256), 1, 12))))
