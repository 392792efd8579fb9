"""The rules of rules.py as columns, and as SQL that says the same.

Each expression is written once, as an Expr that holds both forms as text. Words are searched once a
line: the words that a line holds become a short list, on which all rules are set tests.
Short ASCII words count as whole tokens where a rule means keys, and anywhere where it
means parts (they are listed as ~word then).
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as r
from . import text as t
from .text import keys_match

SEVERITIES = ["info", "low", "medium", "high", "critical"]
ISSUE_LEVELS = ["WARN", "WARNING", "ERROR", "FATAL", "SEVERE"]
CATEGORY_WORDS, HINTS, NOISE, INTERESTING = r.CATEGORY_WORDS, r.HINTS, r.NOISE, r.INTERESTING
ACTIONS = {"fatal": "act now", "severe": "act now", "error": "check today", "warn": "watch", "info": "none"}
#: What a report says of a severity: (label, when to act, what it means), and of a tag.
SHOWN = {"critical": ("act now", "within minutes", "players or data are at risk"), "high": ("check today", "within hours", "a function fails"), "medium": ("watch", "this week", "single players notice"), "low": ("note", "when convenient", "hardly noticed"), "info": ("none", "never", "context only")}
TITLES = {"server_log_performance": "Performance", "server_log_network": "Connections", "server_log_plugin": "Plugins", "server_log_cross_server": "Proxy and backends", "server_log_auth": "Logins and permissions", "server_log_economy": "Economy", "server_log_community": "Conduct", "server_log_chat_review": "Chat", "server_log_player_feedback": "Feedback", "server_log_community_ops": "Events", "server_log_anticheat_vulcan": "Anticheat"}


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(words: list[str]) -> str:
    return "[" + ", ".join(map(_q, words)) + "]::VARCHAR[]"


def _literal(x: str | int | bool) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(x, str) else str(x).lower()


NO_WORDS = "cast(array() AS array<string>)"


def _words(words: list[str]) -> str:
    return f"array({', '.join(map(_literal, words))})" if words else NO_WORDS


def _array(words: list[str]) -> Column:
    """A fixed list, parsed at once: a call for each word takes longer than the query."""
    return F.expr(_words(words))


class Expr:
    """One expression in Spark's SQL and in that of the oracle."""

    def __init__(self, spark: str, sql: str):
        self.spark, self.sql = spark, sql

    def make(self) -> Column:
        return F.expr(self.spark)

    def __and__(self, other: Expr) -> Expr:
        return Expr(f"({self.spark} AND {other.spark})", f"({self.sql} AND {other.sql})")

    def __or__(self, other: Expr) -> Expr:
        return Expr(f"({self.spark} OR {other.spark})", f"({self.sql} OR {other.sql})")

    def __invert__(self) -> Expr:
        return Expr(f"(NOT {self.spark})", f"(NOT {self.sql})")

    def at_least(self, n: int) -> Expr:
        return Expr(f"({self.spark} >= {n})", f"({self.sql} >= {n})")

    def is_in(self, words: list[str]) -> Expr:
        return Expr(f"({self.spark} IN ({', '.join(map(_literal, words))}))", f"({self.sql} IN ({', '.join(map(_q, words))}))") if words else FALSE

    def known(self) -> Expr:
        return Expr(f"({self.spark} IS NOT NULL)", f"({self.sql} IS NOT NULL)")


def lit(v: str | int | bool | None, kind: str = "string") -> Expr:
    if v is None:
        return Expr(f"cast(NULL AS {kind})", "NULL")
    return Expr(_literal(v), _q(v) if isinstance(v, str) else str(v).lower())


FALSE = lit(False)


def col(name: str) -> Expr:
    return Expr(name, name)


def any_(each: list[Expr]) -> Expr:
    out = each[0] if each else FALSE
    for e in each[1:]:
        out = out | e
    return out


def case(pairs: list[tuple[Expr, Expr]], otherwise: Expr) -> Expr:
    """The value of the first condition that holds."""
    if not pairs:
        return otherwise
    return Expr(*("CASE " + " ".join(f"WHEN {getattr(c, form)} THEN {getattr(v, form)}" for c, v in pairs) + f" ELSE {getattr(otherwise, form)} END" for form in ("spark", "sql")))


def greatest(*each: Expr) -> Expr:
    return Expr(f"greatest({', '.join(e.spark for e in each)})", f"greatest({', '.join(e.sql for e in each)})")


def at(table: list, index: Expr, kind: str) -> Expr:
    """An entry of a fixed list, by number from 0."""
    flat = isinstance(table[0], str | int | bool)
    shown = ", ".join((_q(x) if isinstance(x, str) else str(x).lower()) if flat else _list(x) for x in table)
    fixed = ", ".join((_literal if flat else _words)(x) for x in table)
    return Expr(f"cast(get(array({fixed}), {index.spark}) AS {kind})", f"([{shown}])[{index.sql} + 1]")


def matches(name: str, pattern: str) -> Expr:
    return Expr(f"({name} RLIKE {_literal(pattern)})", f"regexp_matches({name}, {_q(pattern)})")


def starts(name: str, word: str) -> Expr:
    return Expr(f"startswith({name}, {_literal(word)})", f"starts_with({name}, {_q(word)})")


def times(name: str, part: str) -> Expr:
    """How often a text of one or two characters stands in a column."""
    n = len(part)
    return Expr(f"((char_length({name}) - char_length(replace({name}, {_literal(part)}, ''))) DIV {n})", f"((length({name}) - length(replace({name}, {_q(part)}, ''))) // {n})")


class Words:
    """The words that rules ask of one column; found() lists those that a text holds."""

    def __init__(self, name: str):
        self.name = name
        self.tokens: dict[str, None] = {}
        self.parts: dict[str, None] = {}
        self.short_parts: dict[str, None] = {}

    def _test(self, names: list[str]) -> Expr:
        return Expr(f"arrays_overlap({self.name}, {_words(names)})", f"list_has_any({self.name}, {_list(names)})") if names else FALSE

    def keys(self, words: list[str]) -> Expr:
        """Short words as whole tokens, others anywhere."""
        for w in words:
            (self.tokens if t.is_token(w) else self.parts)[w] = None
        return self._test(words)

    def has(self, words: list[str]) -> Expr:
        """All words anywhere."""
        for w in words:
            (self.short_parts if t.is_token(w) else self.parts)[w] = None
        return self._test([f"~{w}" if t.is_token(w) else w for w in words])

    def has_all(self, words: list[str]) -> Expr:
        out = self.has([words[0]])
        for w in words[1:]:
            out = out & self.has([w])
        return out

    def found(self, text: Column) -> Column:
        inside = lambda words: F.filter(_array(list(words)), lambda w: F.contains(text, w))
        tokens = F.filter(F.split(text, "[^a-z0-9_]+"), lambda x: x.isin(*self.tokens))
        return F.concat(tokens, inside(self.parts), F.transform(inside(self.short_parts), lambda w: F.concat(F.lit("~"), w)))

    def found_sql(self, text: str) -> str:
        inside = lambda words: f"list_filter({_list(list(words))}, lambda w: contains({text}, w))"
        tokens = f"list_intersect(regexp_split_to_array({text}, '[^a-z0-9_]+'), {_list(list(self.tokens))})"
        return f"list_concat(list_concat({tokens}, {inside(self.parts)}), list_transform({inside(self.short_parts)}, lambda w: '~' || w))"


LINE, SAID = Words("_w"), Words("_cw")
level, text = col("_lv"), "_t"
issue_level, quiet = level.is_in(r.ISSUE_LEVELS), level.is_in(["info", ""])
chat, cheat = col("chat_message").known(), col("cheat_player").known()

# --- hints ------------------------------------------------------------------------------
_open = issue_level | LINE.has(r.HINT_WORDS)
#: The number of the first hint, -1 without one.
_hint = case([(~_open, lit(-1))] + [(LINE.has(w) & ~LINE.has(no), lit(i)) for i, (_, _, _, w, no) in enumerate(r.HINTS)], lit(-1))

# --- lines of the machinery -------------------------------------------------------------
_inventory = (starts("_body", "- ") & times("_body", ", ").at_least(8) & times("_body", "(").at_least(8) & times("_body", ")").at_least(8)) | (
    LINE.has(["[server thread/info]:"]) & times("_body", ", ").at_least(5) & matches("_body", r"^-?\s*[a-z0-9_.+-]+(?:\s*\([^)]+\))?")
)
_banner = (
    (col("_bare").is_in([""]))
    | matches("_bare", r"^[^a-z]*(?:(?:warning|warn)[^a-z]+)*(?:warning|warn)[^a-z]*$")
    | (~matches("_bare", "[a-z]") & col("_kinds").is_in(["1", "2"]) & matches("_bare", r"(?s)\S\s*\S"))
)
_benign_info = _inventory | LINE.has(r.BENIGN_INFO) | any_([LINE.has_all(x) for x in r.BENIGN_INFO_ALL]) | (LINE.has(["hikaripool", "hikari pool"]) & LINE.has(r.BENIGN_POOL))
_benign_warn = any_([LINE.has_all(x) for x in r.BENIGN_WARN_ALL]) | _banner | LINE.has(r.BENIGN_WARN)
benign = (quiet & _benign_info) | (level.is_in(["warn"]) & _benign_warn) | (~_hint.at_least(0) & (col("_kind").is_in(["stacktrace_frame", "diagnostic_detail"]) | (level.is_in(["warn"]) & col("_repeats"))))

# --- operations -------------------------------------------------------------------------


_rank = SEVERITIES.index
# what a line can be: (category, subtype, severity, needs an admin whatever its severity (None: by severity and level), observation, reports, decides first)
_KINDS = [("lifecycle", "machinery", 0, False, False, [], True), ("metrics", "metrics", 0, False, False, [], True)]
_BY_SUBTYPE = {x[0]: x for x in r.OPS}
_KINDS += [(_BY_SUBTYPE[s][1], s, _rank(sev), None, _BY_SUBTYPE[s][7], _BY_SUBTYPE[s][8], True) for _, s, sev, _, _ in r.HINTS]
_RULES_AT = len(_KINDS)
_KINDS += [(x[1], x[0], _rank(x[2]), False if x[7] else None, x[7], x[8], True) for x in r.OPS]
_DEFAULTS_AT = len(_KINDS)
_KINDS += [("lifecycle", "fatal_error", 4, None, False, ["bug"], False), ("lifecycle", "severe_error", 3, None, False, ["bug"], False), ("plugin", "unattributed_error", 2, None, False, ["bug"], False), ("plugin", "unattributed_warning", 1, False, False, ["bug"], False), ("lifecycle", "routine", 0, False, False, [], False)]


def _fits(x: tuple) -> Expr:
    out = LINE.keys(x[3])
    if x[5]:
        out = out & LINE.has_all(x[5])
    if x[4]:
        out = out & ~LINE.has(x[4])
    return out & issue_level if x[6] else out


_which = case(
    [(col("_benign"), lit(0)), (col("_hint").at_least(0), col("(_hint + 2)")), (LINE.keys(r.METRICS), lit(1))]
    + [(_fits(x), lit(_RULES_AT + i)) for i, x in enumerate(r.OPS)]
    + [(level.is_in([lv]), lit(_DEFAULTS_AT + i)) for i, lv in enumerate(["fatal", "severe", "error", "warn"])],
    lit(len(_KINDS) - 1),
)
_kind = lambda i, kind: at([k[i] for k in _KINDS], col("_ops"), kind)
_lifted = col("_ops").at_least(2)  # neither machinery nor metrics
_ops_rank = case(
    [(_lifted & level.is_in(["fatal"]), lit(4)), (_lifted & level.is_in(["severe"]), greatest(_kind(2, "int"), lit(3))), (col("_benign") & level.is_in(["warn"]), lit(1))],
    _kind(2, "int"),
)
_ops_admin = at([k[3] is not False for k in _KINDS], col("_ops"), "boolean") & (_ops_rank.at_least(2) | level.is_in(["error", "severe", "fatal"]))
_weighty = _ops_admin | at([k[4] for k in _KINDS], col("_ops"), "boolean") | _ops_rank.at_least(2)
_own_reports = at([k[5] or r.OPS_REPORTS.get(k[0], []) for k in _KINDS], col("_ops"), "array<string>")
_reports = case([(_weighty & ~chat, _own_reports)], Expr(NO_WORDS, "[]::VARCHAR[]"))
in_reports = lambda c: Expr(f"array_contains(_reports, {_q(c)})", f"list_contains(_reports, {_q(c)})")
_first = at([k[6] for k in _KINDS], col("_ops"), "boolean")
ops_is = lambda *names: ~chat & at([k[0] in names for k in _KINDS], col("_ops"), "boolean")

# --- chat -------------------------------------------------------------------------------


def _label_fits(label: str, words: list[str]) -> Expr:
    return SAID.keys(words) & SAID.has(r.CHAT_NEEDS[label]) if label in r.CHAT_NEEDS else SAID.keys(words)


_labels_of = [(label, _label_fits(label, words)) for _, label, words in r.CHAT]
_labels = Expr(
    "array_compact(array(" + ", ".join(f"CASE WHEN {f.spark} THEN {_q(label)} END" for label, f in _labels_of) + "))",
    "list_filter([" + ", ".join(f"CASE WHEN {f.sql} THEN {_q(label)} END" for label, f in _labels_of) + "], lambda x: x IS NOT NULL)",
)
labelled = lambda names: Expr(f"arrays_overlap(_labels, {_words(names)})", f"list_has_any(_labels, {_list(names)})")
_groups = sorted(r.GROUP_PRIORITY, key=lambda g: -r.GROUP_PRIORITY[g])
_chat_group = case([(labelled([x[1] for x in r.CHAT if x[0] == g]), lit(g)) for g in _groups], lit("small_talk"))
_any_label = labelled([x[1] for x in r.CHAT])
_chat_rank = case(
    [
        (labelled(r.CHAT_CRITICAL) | (SAID.has(r.EVERYONE) & labelled(r.EVERYONE_LABELS)), lit(4)),
        (labelled(r.CHAT_HIGH), lit(3)),
        (_chat_group.is_in(r.CHAT_SERIOUS), lit(2)),
        (_any_label, lit(1)),
    ],
    lit(0),
)
_chat_fits = {c: chat & labelled(ls) for c, ls in r.CHAT_REPORTS.items()} | {
    "player_feedback": chat & col("_group").is_in(["admin"]),
    "economy": chat & col("_group").is_in(["economy"]) & ~labelled(r.CHAT_COMMUNITY),
}

# --- categories -------------------------------------------------------------------------
_frame = starts("_m", "at ") | starts("_m", "caused by:")
_identity_only = LINE.has(["uuid='", "uuid="]) & ~LINE.keys(r.IDENTITY_WORDS)
_own = {c: LINE.keys(ws) for c, ws in r.CATEGORY_WORDS.items()}
_own["community"] = cheat | (~LINE.has(["issued server command: /fly"]) & (LINE.keys(r.COMMUNITY_STRONG) | (LINE.has(r.COMMUNITY_CONTEXT) & LINE.keys(r.COMMUNITY_SOFT))))
_own["community_ops"] = ~(LINE.has(["prism"]) & LINE.has(["activityquery", "purge", "purged", "activity records"])) & LINE.keys(r.OPERATIONS_WORDS)
_own["community_ops"] &= ~(ops_is("plugin", "position", "storage", "network", "world") & LINE.keys(r.EVENT_FAILURES))
_own["network"] &= ~LINE.has(["lost connection: flying is not enabled"])
_own["complaint"] &= ~LINE.has(["if this lead to server tps drop"]) & ~(LINE.has(["hikari", "poolbase"]) & LINE.has(["failed to validate connection"]))
_own["moderation"] &= ~_identity_only
_own["bug"] &= ~(quiet & LINE.has(r.MILD_TROUBLE) & ~LINE.has(r.CLEAR_BUGS))
_own["plugin"] &= ~LINE.has(["update here:", "update available"]) & ~(quiet & ~LINE.has(r.PLUGIN_TROUBLE))
_own["player_feedback"] = (chat & LINE.keys(r.FEEDBACK_ACCESS)) | LINE.keys(r.FEEDBACK_STRONG) | (LINE.keys(r.FEEDBACK_SOFT) & LINE.keys(r.FEEDBACK_CONTEXT))
for _c in ("complaint", "network", "cross_server", "player_feedback"):
    _own[_c] &= ~ops_is("storage")
for _c in ("complaint", "network", "cross_server", "moderation", "economy", "community", "community_ops", "player_feedback"):
    _own[_c] &= ~_frame
_review_words = [*r.REVIEW_SENSITIVE, *r.REVIEW_LINKS, *r.REVIEW_TRADE, *r.REVIEW_ABUSE]
_behaviour = col("_flood") | col("_abuse")
_ops_first = [(~chat & _first & in_reports(c), lit(c)) for c in r.PRIORITY]
_in_order = [(c, any_([*([_chat_fits[c]] if c in _chat_fits else []), in_reports(c), _own[c]])) for c in r.PRIORITY if c != "chat_review"]
_before = [(col("_noise"), lit("daily")), (_behaviour, lit("chat_review")), (col("_benign"), lit("daily"))]
_category = case([*_before, *_ops_first, *[(f, lit(c)) for c, f in _in_order]], lit("daily"))
_with_reviews = [(c, f) for c, f in [_in_order[0], ("chat_review", chat & LINE.keys(_review_words)), *_in_order[1:]]]
_gate = case([*_before, *_ops_first, *[(f, lit(c)) for c, f in _with_reviews], (chat, lit("chat_review"))], lit("daily"))
TAGS = {"community": "community", "chat_review": "chat_review", "player_feedback": "player_feedback", "community_ops": "community_ops", "complaint": "performance", "network": "network", "plugin": "plugin", "cross_server": "cross_server", "moderation": "auth", "economy": "economy"}
_observation = (~chat & at([k[4] for k in _KINDS], col("_ops"), "boolean")) | (col("category").is_in(["community_ops", "player_feedback"]) & quiet & ~col("chat_admin") & ~col("ops_admin"))
_joined = lambda *each: Expr("(" + " || ".join(e.spark for e in each) + ")", "(" + " || ".join(e.sql for e in each) + ")")
_shown_level = case([(level.is_in([""]), lit("info"))], level)
_tag = case(
    [(col("_loop"), _joined(lit("server_log_loop_"), _shown_level)), (cheat, lit("server_log_anticheat_vulcan"))]
    + [(col("category").is_in([c]), _joined(lit(f"server_log_{n}"), case([(_observation, lit("_observation"))], lit("")))) for c, n in TAGS.items()],
    _joined(lit("server_log_"), _shown_level),
)
_ops_null = lambda e, kind="string": case([(chat, lit(None, kind))], e)
_said_null = lambda e, kind="string": case([(chat, e)], lit(None, kind))
_evidence = ~col("category").is_in(["daily"]) & (
    _behaviour
    | cheat
    | col("_loop")
    | (chat & (col("chat_admin") | col("_cr").at_least(2) | col("category").is_in(["community", "chat_review", "player_feedback", "community_ops"])))
    | (
        ~(~chat & at([k[4] for k in _KINDS], col("_ops"), "boolean") & ~col("ops_admin"))
        & ((~chat & (col("ops_admin") | col("_or").at_least(2))) | issue_level | (quiet & LINE.has([*r.CRITICAL, *r.ERRORS, *r.WARNINGS, *r.ACTIONABLE])))
    )
)
_plain_info = quiet & ~_behaviour & ~cheat & ~col("_loop") & ~col("ops_admin") & ~col("chat_admin") & ~(~chat & col("_or").at_least(2)) & ~col("_cr").at_least(2)
#: What a group's severity is taken of, in order of the ladder.
FLAGS = {
    "critical": LINE.has(r.CRITICAL),
    "loop": col("_loop"),
    "load_failure": LINE.has(r.LOAD_FAILURES),
    "sensitive": LINE.has(r.SENSITIVE),
    "accident": LINE.has(r.ACCIDENTS),
    "trouble": LINE.has(r.ERRORS),
    "slow": LINE.keys(r.PERFORMANCE),
    "network": LINE.keys(r.CATEGORY_WORDS["network"]),
    "review": LINE.keys(_review_words),
    "operations": LINE.keys(r.OPERATIONS_WORDS),
    "feedback": LINE.keys([*r.FEEDBACK_STRONG, *r.FEEDBACK_SOFT]),
    "warned": LINE.has(r.WARNINGS),
    "identity": LINE.keys(r.CATEGORY_WORDS["moderation"]) & ~_identity_only,
    "behaviour": _behaviour,
}
_worst = greatest(case([(chat, lit(0))], col("_or")), col("_cr"))

#: The columns of classification, step by step: each step reads what the ones before made.
STEPS: list[dict[str, Expr]] = [
    {"_hint": _hint, "_benign": benign, "_labels": _labels},
    {"_ops": _which},
    {
        "_or": _ops_rank,
        "_group": _chat_group,
        "_cr": case([(chat, _chat_rank)], lit(0)),
        "_reports": _reports,
        "ops_admin": ~chat & _ops_admin,
        "chat_admin": chat & (_chat_group.is_in(r.CHAT_SERIOUS) | _chat_rank.at_least(2)),
    },
    {"category": _category, "gate": _gate},
    {
        "tag": _tag,
        "ops_category": _ops_null(_kind(0, "string")),
        "ops_subtype": _ops_null(_kind(1, "string")),
        "ops_severity": _ops_null(at(SEVERITIES, col("_or"), "string")),
        "chat_labels": _said_null(case([(_any_label, col("_labels"))], Expr("array('chatting')", "['chatting']")), "array<string>"),
        "chat_category": _said_null(col("_group")),
        "chat_severity": _said_null(at(SEVERITIES, col("_cr"), "string")),
        "severity": at(SEVERITIES, _worst, "string"),
        "evidence": _evidence,
        "plain_info": _plain_info,
        "own_rank": greatest(col("_cr"), case([(~chat & ~ops_is("metrics") & (col("ops_admin") | col("_or").at_least(2)), col("_or"))], lit(0))),
    }
    | {f"f_{k}": e for k, e in FLAGS.items()},
]
#: What classification adds to a log.
COLUMNS = ["category", "gate", "tag", "ops_category", "ops_subtype", "ops_severity", "ops_admin", "chat_labels", "chat_category", "chat_severity", "chat_admin", "severity", "evidence", "plain_info", "own_rank", *[f"f_{k}" for k in FLAGS]]


def noise_pattern(patterns: list[str] | None = None) -> str:
    """One pattern for all; those that aren't valid are left out. An empty list: the default ones."""
    fine = []
    for p in patterns or r.NOISE:
        try:
            re.compile(p)
        except re.error:
            continue
        fine.append(f"(?:{p})")
    return "(?i)" + "|".join(fine) if fine else "(?!)"


def daily_noise(line: Column, lv: Column, patterns: list[str] | None = None) -> Column:
    """Routine lines; only INFO can be."""
    return (lv == "INFO") & line.rlike(noise_pattern(patterns))


def daily_noise_sql(line: str, lv: str) -> str:
    return f"({lv} = 'INFO' AND regexp_matches({line}, {_q(noise_pattern())}))"


def features(line: Column, message: Column, lv: Column) -> dict[str, Column]:
    """What rules read of a line, before its words are looked up."""
    low = F.lower(line)
    body = t.strip(F.regexp_replace(low, r"(?s)^.*\]:", ""))
    bare = F.regexp_replace(body, r"^(?:\[[^\]]*\]\s*)+", "")
    return {"_t": low, "_m": F.lower(F.ltrim(message)), "_lv": F.when(F.lower(lv) == "warning", "warn").otherwise(F.lower(F.coalesce(lv, F.lit("")))), "_body": body, "_bare": bare, "_kind": t.line_kind(line), "_repeats": t.repeat_run(message, 12), "_noise": daily_noise(line, F.upper(lv))}


def kinds(bare: Column) -> Column:
    """How many different characters a text has, but for white space."""
    return F.size(F.array_distinct(F.filter(F.split(F.regexp_replace(bare, r"\s+", ""), ""), lambda x: x != ""))).cast("string")


# --- words of one text ------------------------------------------------------------------


def contains_sql(c: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({c}), {_q(w)})" for w in words) + ")" if words else "false"


def contains(c: Column, words: list[str]) -> Column:
    """Whether any of the words occurs; plain searches are faster than an alternation."""
    out = F.lit(False)
    for i, w in enumerate(words):
        hit = F.contains(F.lower(c), F.lit(w))
        out = hit if i == 0 else out | hit
    return out


def hint(c: Column, lv: Column) -> Column:
    """struct(code, severity, markers) of the first hint, null without; rows of no issue level need a word of trouble."""
    low, out = F.lower(c), None
    for code, _, severity, words, forbidden in r.HINTS:
        markers = F.slice(F.filter(_array(words), lambda w: low.contains(w)), 1, 6)
        fits = contains(c, words) & ~contains(c, forbidden)
        value = F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), markers.alias("markers"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return F.when(lv.isin(ISSUE_LEVELS) | contains(c, r.HINT_WORDS), out)


def hint_sql(c: str, lv: str) -> str:
    cases = " ".join(f"WHEN {contains_sql(c, w)} AND NOT {contains_sql(c, no)} THEN '{code}'" for code, _, _, w, no in r.HINTS)
    return f"CASE WHEN {lv} IN ({', '.join(map(_q, ISSUE_LEVELS))}) OR {contains_sql(c, r.HINT_WORDS)} THEN CASE {cases} END END"


def track(c: Column, lv: Column, mode: str = "all", track_info: bool = False) -> Column:
    """struct(template, anomaly): whether a row is parsed for templates and watched for anomalies."""
    warn = lv.isin(ISSUE_LEVELS)
    if mode == "warn_error":
        both = (warn, warn)
    elif mode == "interesting":
        both = (warn | contains(c, r.INTERESTING),) * 2
    else:
        both = (F.lit(True), warn | F.lit(track_info))
    return F.struct(both[0].alias("template"), both[1].alias("anomaly"))


def track_sql(c: str, lv: str) -> str:
    hit = f"({lv} IN ({', '.join(map(_q, ISSUE_LEVELS))}) OR {contains_sql(c, r.INTERESTING)})"
    return f"CASE WHEN {hit} THEN 'true|true' ELSE 'false|false' END"


def review_class(c: Column) -> Column:
    """sensitive, url, trade_ad or abuse_language: the first class whose words a chat line holds; null without one."""
    out = None
    for name, words in (("sensitive", r.REVIEW_SENSITIVE), ("url", r.REVIEW_LINKS), ("trade_ad", r.REVIEW_TRADE), ("abuse_language", r.REVIEW_ABUSE)):
        hit = keys_match(c, words)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def review_class_sql(c: str) -> str:
    from loomlog.plans.duck import keys_match as km

    return "CASE " + " ".join(f"WHEN {km(c, words)} THEN '{name}'" for name, words in (("sensitive", r.REVIEW_SENSITIVE), ("url", r.REVIEW_LINKS), ("trade_ad", r.REVIEW_TRADE), ("abuse_language", r.REVIEW_ABUSE))) + " END"


def severity_rank(c: Column) -> Column:
    return F.array_position(_array(SEVERITIES), c) - 1


def action_label(lv: Column) -> Column:
    out = F.lit("none")
    for k, v in ACTIONS.items():
        out = F.when(lv == k, v).otherwise(out)
    return out


def action_label_sql(lv: str) -> str:
    return "CASE " + " ".join(f"WHEN {lv} = '{k}' THEN '{v}'" for k, v in ACTIONS.items()) + " ELSE 'none' END"


#: Unsafe verbs as whole words, beside the pattern of fixed values.
UNSAFE = rf"(?:^|[^a-z0-9_-])(?:{'|'.join(r.UNSAFE_VERBS)})(?:[^a-z0-9_-]|$)"


def action_safe(action: Column, issue: Column) -> Column:
    """Whether an advice asks for nothing destructive, and each domain that it names occurs in the issue too. An empty advice isn't safe."""
    low, known = F.lower(F.coalesce(action, F.lit(""))), F.coalesce(issue, F.lit(""))
    out = (F.trim(low) != "") & ~low.rlike(r.UNSAFE_ACTION) & ~low.rlike(UNSAFE)
    for named, evidence in r.ACTION_DOMAINS:
        out = out & (~contains(low, named) | contains(known, evidence))
    return out


def action_safe_sql(action: str, issue: str) -> str:
    domains = " AND ".join(f"(NOT {contains_sql(action, named)} OR {contains_sql(issue, evidence)})" for named, evidence in r.ACTION_DOMAINS)
    return f"(trim({action}) <> '' AND NOT regexp_matches({action}, {_q(r.UNSAFE_ACTION)}) AND NOT regexp_matches(lower({action}), {_q(UNSAFE)}) AND {domains})"


def compact_evidence(c: Column, hit: Column, lines: int = 5, size: int = 520) -> Column:
    """The header and the lines nearest the hit, `lines` in all, cut to `size`."""
    ls = F.split(c, "\n")
    place = F.greatest(F.lit(1), F.array_position(F.transform(ls, lambda x: F.when(x.contains(hit), "y").otherwise("n")), "y"))
    near = F.array_sort(F.transform(ls, lambda x, i: F.struct(F.when(i == 0, -1).otherwise(F.abs(i + 1 - place)).alias("d"), i.alias("i"))))
    keep = F.transform(F.slice(near, 1, lines), lambda s: s["i"])
    return F.substring(F.array_join(F.filter(ls, lambda x, i: F.array_contains(keep, i)), "\n"), 1, size)


def shown(severity: str, field: int) -> Expr:
    """label (0), timing (1) or impact (2) of a severity's column."""
    return case([(col(severity).is_in([k]), lit(v[field])) for k, v in SHOWN.items()], lit(""))


def title(tag: str) -> Expr:
    """The display title of a tag's column: that of its group; levels are shown as errors."""
    return case([(starts(tag, k), lit(v)) for k, v in TITLES.items()], lit("Server errors"))
