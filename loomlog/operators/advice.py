"""What to do about an issue: one action, and a plan of ordered checks.

Conditions are expressions over an issue's columns; texts are a small table of their own, so a
plan is an array of step codes until it is shown.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.functions.catalogue import Expr, case, col, lit, starts
from loomlog.operators.classify import FAMILY_SQL

MOST_STEPS = 6


def holds(column: str, *names: str) -> Expr:
    """Whether an array column holds one of the names."""
    some = ", ".join(f"'{n}'" for n in names)
    return Expr(f"arrays_overlap({column}, array({some}))", f"list_has_any({column}, [{some}])")


_about = lambda *x: holds("ops_categories", *x)
_kind = lambda *x: holds("subtypes", *x)
_category = lambda *x: col("category").is_in(list(x))
_family = Expr(FAMILY_SQL, FAMILY_SQL)

database = _about("storage") | _kind("database_connection", "database_timeout", "save_failed")
configuration = _kind("config_error", "content_definition", "api_credentials", "missing_dependency", "unsafe_mode")
economy = _about("economy") | _category("economy")
network = _about("network") | _category("network", "cross_server") | col("tag").is_in(["server_log_network"])
access = _about("access_security") | _kind("unauthenticated") | _category("moderation")
performance = _about("performance") | _category("complaint")
position = _about("position", "world") | _kind("teleport", "chunk_error")
conduct = Expr(f"({FAMILY_SQL} IN ('community', 'chat_review', 'moderation'))", f"({FAMILY_SQL} IN ('community', 'chat_review', 'moderation'))") & ~access
feedback = _category("player_feedback") & ~position
plain = ~(database | economy | configuration | network | access | performance | position) & Expr(f"({FAMILY_SQL} = 'operations')", f"({FAMILY_SQL} = 'operations')")

#: (code, when it applies, what to check, when it is passed, what to do otherwise), in order.
STEPS = [
    ("locate", None, "find the first line, its whole trace and the last occurrence", "each line has a time, a server and a component", "read 40 lines around each hit"),
    ("database_reach", database, "reach the database with a read-only account; look at connections, slow queries and disk", "no timeout, connections below their limit", "mend database, network or disk before any plugin"),
    ("database_pool", database, "compare the pool's size, timeouts and lifetimes with the database's", "broken connections are replaced", "settle pools plugin by plugin"),
    ("database_assets", database & economy, "match payments, goods and balances with committed rows", "each payment has its goods", "list differences, stop refunds until the cause is known"),
    ("economy_ledger", economy & ~database, "match the shop's ledger with balances by player and time", "no double or lost entry", "correct entry by entry from the ledger"),
    ("economy_hold", economy & ~database, "hold back refunds until the ledger is whole", "refunds follow the ledger", "tell players when"),
    ("configuration", configuration, "parse the file that is named, after a backup; compare fields with the version's manual", "it parses, and only meant fields differ", "restore the backup"),
    ("network", network, "check the way from proxy to server: ports, forwarding, secret, state of backends", "backends answer and accept forwarding", "take the backend out of the list"),
    ("access", access, "check login mode, forwarding secret and who may reach the backend", "only the proxy reaches it", "close the port"),
    ("performance", performance, "look at ticks, collector, entities, chunks and slow tasks at that time", "20 ticks a second for half an hour", "profile, then stop the slowest plugin"),
    ("position", position, "repeat the teleport or chunk load at the place that is named", "players arrive and chunks load", "restore the region from a backup"),
    ("conduct", conduct, "read what was said before and after, by player and channel", "each measure has its evidence", "ask for a second reading"),
    ("feedback", feedback, "repeat what the player describes, on that server", "it is understood and has an owner", "ask the player for the time and place"),
    ("plugin", plain, "check the version, dependencies and last change of the component named first", "it starts without errors", "go back to the version before"),
    ("verify", None, "watch for the same lines for half an hour after the change", "none has come, and change and time are written down", "the incident stays open"),
]

#: (code, when, text); the first that fits.
ACTIONS = [
    ("urgent", col("severity").is_in(["critical"]), "read the live log, crash reports and the last changes; consider going back"),
    ("loop", starts("tag", "server_log_loop_"), "mend the component of the first line, so that it stops repeating"),
    ("conduct", _category("community"), "have the measure reviewed with its evidence"),
    ("chat", _category("chat_review"), "have the chat reviewed with what was said around it"),
    ("feedback", _category("player_feedback"), "collect it as feedback, with how often it comes up"),
    ("events", _category("community_ops"), "answer the players, and set the announcement or the rules right"),
    ("performance", _category("complaint") | col("tag").is_in(["server_log_performance"]), "look at ticks, memory, entities, chunks and slow tasks"),
    ("network", _category("network") | col("tag").is_in(["server_log_network"]), "check the way from proxy to backend, ports and forwarding"),
    ("plugin", _category("plugin") | col("tag").is_in(["server_log_plugin"]), "check the plugin of the first trace, its version and dependencies"),
    ("proxy", _category("cross_server") | col("tag").is_in(["server_log_cross_server"]), "check forwarding mode and secret of proxy and backends"),
    ("access", _category("moderation") | col("tag").is_in(["server_log_auth"]), "check login mode, permissions and who may connect"),
    ("economy", _category("economy") | col("tag").is_in(["server_log_economy"]), "match the ledger with balances and goods"),
    ("disk", _about("storage") & _kind("disk_full"), "free the disk, then check that saves and databases were written"),
    ("saves", _about("storage") & _kind("save_failed"), "check player and world files of that time against the backup"),
    ("database", _about("storage"), "check the database, its connections and its pool"),
    ("position", _about("position"), "repeat the teleport at that time and place"),
    ("world", _about("world"), "check the region files that are named"),
    ("permission", _about("permission"), "check groups, commands and login mode"),
    ("trace", col("severity").is_in(["high"]), "follow the first trace to its component"),
    ("watch", col("severity").is_in(["medium"]), "watch whether it spreads, and keep the lines"),
]
CALM = ("none", "nothing to do at once")

action = case([(when, lit(code)) for code, when, _ in ACTIONS], lit(CALM[0]))
TEXTS = {code: text for code, _, text in ACTIONS} | dict([CALM])
_steps = [(lit(code) if when is None else case([(when, lit(code))], Expr("NULL", "NULL"))) for code, when, *_ in STEPS]
plan = Expr(f"slice(array_compact(array({', '.join(x.spark for x in _steps)})), 1, {MOST_STEPS})", f"list_slice(list_filter([{', '.join(x.sql for x in _steps)}], lambda x: x IS NOT NULL), 1, {MOST_STEPS})")


def plans(issues: DataFrame) -> DataFrame:
    """issues with place (from 1), step, check, expected and otherwise: MOST_STEPS ordered checks at most, in rows."""
    texts = issues.sparkSession.createDataFrame([(c, *x) for c, _, *x in STEPS], "step string, check string, expected string, otherwise string")
    rows = issues.select("*", F.posexplode(plan.make()).alias("place", "step")).withColumn("place", F.col("place") + 1)
    return rows.join(F.broadcast(texts), "step")
