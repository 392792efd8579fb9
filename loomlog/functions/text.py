"""Cleaning and feature columns of one log line; all are built-in expressions.

Character classes are written out in ASCII where engines differ on Unicode ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from loomlog.functions import rules as r

# The formats that lines are recognised by.
ANSI = r"\x1b\[[0-9;]*[A-Za-z]"
TRANSPORT = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x{FEFF}\x{200B}\x{200C}\x{200D}\x{2060}]"
FULL_TIME = r"^\[?([0-9]{4}-[0-9]{2}-[0-9]{2})[ T]([0-9]{2}:[0-9]{2}:[0-9]{2})(?:[.,]([0-9]{1,6}))?"
CLOCK = r"^\[?([0-9]{2}:[0-9]{2}:[0-9]{2})(?:[.,]([0-9]{1,6}))?\]?"
PREFIX = r"(?i)^\[?[0-9]{2}:[0-9]{2}:[0-9]{2}(?:[.,][0-9]{1,6})?\]?\s*(?:\[[^\]]+\]\s*)?(?:\[[A-Z]+\]\s*)?"
LEVEL = r"(?i)(?:^|[\[/\s:])(FATAL|SEVERE|ERROR|WARN|WARNING|INFO|DEBUG|TRACE)(?:[\]/\s:]|$)"
IPV4 = r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"
URL = r"(?i)https?://[^\s<>\"]+|www\.[^\s<>\"]+"
EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
UUID = r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b"
HEX = r"(?i)\b0x[0-9a-f]+\b"
TOKEN = r"\b[A-Za-z0-9_-]{32,}\b"
NUMBER = r"(?<![A-Za-z_])-?[0-9]+(?:\.[0-9]+)?"
FRAME = r"(?i)^(?:at\s+\S+\([^\r\n]*\)(?:\s+~\[[^\]]*\])?|\.\.\.\s+[0-9]+\s+more)$"
DETAIL = r"^[»›▶→]\s*\S"
CHAT_THREAD = r"(?i)\[Async Chat Thread[^\]]*\]\s*:?\s*"
CHAT_PLUGIN = r"(?:\[Not Secure\]\s*)?(?:\[[^\]]{1,30}\]\s*)*([A-Za-z0-9_]{1,16})\s*>>\s*(.+)$"
CHAT_NATIVE = r"^\s*<([^>\s]{1,40})>\s*(.*)$"
ANTICHEAT = r"(?i)\[Vulcan\][\]:>\s]*([A-Za-z0-9_]{1,16})\s+failed\s+([A-Za-z]+(?:\s*\([^)]+\))?)"
# Severity numbers, words that give a row priority, and what each flag costs.
SEVERITY = {"TRACE": 1, "DEBUG": 5, "INFO": 9, "WARN": 13, "WARNING": 13, "ERROR": 17, "FATAL": 21, "SEVERE": 21}
PRIORITY_WORDS = ["loop_suppressed", "fatal", "severe", "error", "exception", "failed", "timeout", "warn", "warning", "ban", "kick", "mute", "report", "spam", "grief", "cheat"]
REDACTIONS = [("url", URL), ("email", EMAIL), ("uuid", UUID), ("ip", IPV4), ("token", TOKEN)]
PENALTIES = {"empty": 80, "low_signal_repetition": 35, "low_signal_symbols": 35, "stacktrace_frame": 18, "diagnostic_detail": 10, "control_stripped": 8, "truncated": 8, "whitespace_collapsed": 2}
CJK = "一-鿿"


def text_of(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def truncate(c: Column, n: int) -> Column:
    if n <= 3:
        return F.substring(c, 1, max(0, n))
    return F.when(F.char_length(c) > n, F.concat(F.substring(c, 1, n - 3), F.lit("..."))).otherwise(c)


def strip_transport(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, ANSI, ""), TRANSPORT, "")


def transport_changed(c: Column) -> Column:
    """Whether control or zero-width characters went; terminal colours alone don't count."""
    bare = F.regexp_replace(c, ANSI, "")
    return F.regexp_replace(bare, TRANSPORT, "") != bare


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def sanitize(c: Column) -> Column:
    return strip(F.regexp_replace(strip_transport(c), IPV4, "<ip>"))


def level(c: Column) -> Column:
    found = F.upper(F.regexp_extract(c, LEVEL, 1))
    low = F.lower(c)
    return (
        F.when(found == "WARNING", "WARN")
        .when(found != "", found)
        .when(low.rlike("fatal|severe|error|exception"), "ERROR")
        .when(low.rlike("warn|failed|timeout"), "WARN")
        .otherwise("INFO")
    )


def time_parts(c: Column) -> Column:
    """struct(date, time, ms) at the start of a line, empty where absent."""
    t = strip(F.regexp_replace(strip(F.regexp_replace(c, ANSI, "")), r"^[\x{FEFF}\x{200B}\x{200C}\x{200D}\x{2060}]+", ""))
    full = F.regexp_extract(t, FULL_TIME, 1) != ""
    part = lambda i, j: F.when(full, F.regexp_extract(t, FULL_TIME, i)).otherwise(F.regexp_extract(t, CLOCK, j))
    return F.struct(F.regexp_extract(t, FULL_TIME, 1).alias("date"), part(2, 1).alias("time"), part(3, 2).alias("ms"))


def timestamp_ms(parts: Column, file_date: Column, before_ms: Column, now_ms: Column) -> Column:
    """Date and time; else the file's date and the time, a day earlier if over an hour ahead; else the line before; else now."""
    clock = F.split(parts["time"], ":")
    ms = F.rpad(F.substring(parts["ms"], 1, 3), 3, "0")
    of_day = (F.try_element_at(clock, F.lit(1)).cast("long") * 3600 + F.try_element_at(clock, F.lit(2)).cast("long") * 60 + F.try_element_at(clock, F.lit(3)).cast("long")) * 1000 + F.when(parts["ms"] == "", 0).otherwise(ms.cast("long"))
    day = lambda d: F.unix_date(d).cast("long") * 86_400_000
    own = day(F.to_date(F.nullif(parts["date"], F.lit("")))) + of_day
    filed = day(file_date) + of_day
    filed = F.when(filed - now_ms > 3_600_000, filed - 86_400_000).otherwise(filed)
    has_time = parts["time"] != ""
    return F.when(has_time & (parts["date"] != ""), own).when(has_time & file_date.isNotNull(), filed).when(before_ms > 0, before_ms).otherwise(now_ms)


def file_date(path: Column) -> Column:
    return F.to_date(F.nullif(F.regexp_extract(F.regexp_extract(path, r"([^/]*)$", 1), r"([0-9]{4}-[0-9]{2}-[0-9]{2})", 1), F.lit("")))


def body(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, PREFIX, ""), r"^[ :\t]+", "")


def line_kind(c: Column) -> Column:
    b = body(c)
    return F.when(b.rlike(FRAME), "stacktrace_frame").when(b.rlike(DETAIL), "diagnostic_detail").otherwise("message")


def normalised(c: Column) -> Column:
    """What a fingerprint is taken of: lower case, no prefix, ids and numbers masked."""
    t = F.lower(sanitize(c))
    for pattern, by in ((PREFIX, ""), (FULL_TIME, ""), (CLOCK, ""), (UUID, "<uuid>"), (IPV4, "<ip>"), (HEX, "0x<num>"), (NUMBER, "<num>"), (r"\s+", " ")):
        t = F.regexp_replace(t, pattern, by)
    t = strip(t)
    return F.when(t == "", "empty").otherwise(t)


def fingerprint(c: Column) -> Column:
    return F.substring(F.sha1(normalised(c)), 1, 24)


def redact(c: Column) -> Column:
    for name, pattern in REDACTIONS:
        c = F.regexp_replace(c, pattern, f"<{name}>")
    return c


def clean_text(c: Column) -> Column:
    return strip(F.regexp_replace(redact(strip_transport(c)), r"\s+", " "))


def clean(c: Column) -> Column:
    """struct(text, redactions, flags): redacted text with its white space collapsed, and what was found on the way."""
    t = strip_transport(c)
    counts, flags = [], [F.when(transport_changed(c), "control_stripped")]
    for name, pattern in REDACTIONS:
        n = F.regexp_count(t, F.lit(pattern))
        counts.append(n)
        flags.append(F.when(n > 0, f"redacted_{name}"))
        t = F.regexp_replace(t, pattern, f"<{name}>")
    text = strip(F.regexp_replace(t, r"\s+", " "))
    flags += [
        F.when(text != strip(t), "whitespace_collapsed"),
        F.when(text == "", "empty"),
        F.when(repeat_run(text, 12), "low_signal_repetition"),
        F.when(symbol_heavy(text), "low_signal_symbols"),
    ]
    total = counts[0]
    for n in counts[1:]:
        total = total + n
    return F.struct(text.alias("text"), total.alias("redactions"), F.array_compact(F.array(*flags)).alias("flags"))


def clean_hash(c: Column) -> Column:
    return F.substring(F.sha1(clean_text(c)), 1, 24)


def quality(redactions: Column, flags: Column) -> Column:
    """0 to 100: 3 off for each of up to 8 redactions, and each flag's penalty (4 for one without)."""
    score = F.lit(100) - F.least(F.greatest(redactions, F.lit(0)), F.lit(8)) * 3
    cost = lambda f: F.when(f.startswith("redacted_"), 0)

    def each(f: Column) -> Column:
        out = cost(f)
        for name, n in PENALTIES.items():
            out = out.when(f == name, n)
        return out.otherwise(4)

    score = F.aggregate(flags, score, lambda a, f: a - each(f))
    return F.greatest(F.lit(0), F.least(F.lit(100), score))


def repeat_run(c: Column, n: int) -> Column:
    return c.rlike(rf"(?s)(.)\1{{{n - 1},}}")


def symbol_heavy(c: Column) -> Column:
    return (F.char_length(c) >= 8) & (F.char_length(F.regexp_replace(c, r"[^\p{L}\p{N}]", "")) * 4 < F.char_length(c))


def let(value: Column, body) -> Column:
    """body(x) with x bound to value, which is then computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def chat(c: Column) -> Column:
    """struct(player, message), null for lines that aren't chat. Lines without a > or the chat thread's name aren't parsed."""
    made = lambda p, m: F.struct(p.alias("player"), m.alias("message"))

    def parse(s: Column) -> Column:
        plugin, native = strip(F.regexp_extract(s, CHAT_PLUGIN, 2)), strip(F.regexp_extract(s, CHAT_NATIVE, 2))
        by_native = let(native, lambda m: F.when(m != "", made(F.regexp_extract(s, CHAT_NATIVE, 1), m)).when(c.rlike(CHAT_THREAD) & (s != ""), made(F.lit(""), s)))
        by_plugin = let(plugin, lambda m: F.when(m != "", made(F.regexp_extract(s, CHAT_PLUGIN, 1), m)))
        return F.coalesce(F.when(s.contains(">>"), by_plugin), by_native)

    bare = F.regexp_replace(strip(F.regexp_replace(strip(F.regexp_replace(c, CHAT_THREAD, "")), PREFIX, "")), r"^[ :\t]+", "")
    return F.when(c.contains(">") | F.lower(c).contains("[async chat thread"), let(bare, parse))


def meaningless(c: Column) -> Column:
    """One character 8 times in a row, or 3 characters and more without a letter or digit."""
    return repeat_run(c, 8) | ((F.char_length(c) >= 3) & ~c.rlike(r"[\p{L}\p{N}]"))


def anticheat(c: Column) -> Column:
    """struct(player, check), null for other lines."""
    check = F.regexp_replace(F.regexp_extract(c, ANTICHEAT, 2), r"^[ :,.]+|[ :,.]+$", "")
    found = let(F.regexp_extract(c, ANTICHEAT, 1), lambda p: F.when(p != "", F.struct(p.alias("player"), check.alias("check"))))
    return F.when(F.lower(c).contains("[vulcan]"), found)


def message_key(c: Column) -> Column:
    """Messages that differ in case, white space or punctuation only have one key."""
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"\s+", "")), r"[^\p{L}\p{N}_]", "")


def similar(a: Column, b: Column) -> Column:
    """Equal; or of nearly the same length and one inside the other; or, of 3 to 8 characters, an edit apart."""
    la, lb = F.char_length(a), F.char_length(b)
    near = (F.abs(la - lb) <= 2) & (a.contains(b) | b.contains(a) | (F.greatest(la, lb).between(3, 8) & F.levenshtein(a, b, 1).between(0, 1)))
    return (a != "") & (b != "") & ((a == b) | near)


def similarity_keys(c: Column) -> Column:
    """Keys of which two similar messages share one: itself, without one character, without up to two at its ends."""
    n = F.char_length(c)
    drop = F.when((n >= 2) & (n <= 8), F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, n)))).otherwise(F.array().cast("array<string>"))
    ends = [F.when(n > a + b, F.substring(c, F.lit(a + 1), n - a - b)) for a in range(3) for b in range(3 - a)]
    return F.array_distinct(F.concat(F.array(c), F.array_compact(F.array(*ends)), drop))


def event_id(server: Column, ts_ms: Column, print_: Column, file_name: Column) -> Column:
    key = F.concat_ws(":", server, ts_ms.cast("string"), print_, file_name)
    return F.concat(F.lit("local-log:"), server, F.lit(":"), F.substring(F.sha1(key), 1, 20))


def dedupe_key(event: Column, kind: Column, server: Column, identity: Column, content: Column, ts_ms: Column, seconds: int = 120) -> Column:
    """The event's id, else a digest of what, where, who and when, to `seconds`."""
    raw = F.concat_ws("|", kind, server, identity, norm(content), F.floor(ts_ms / (seconds * 1000)).cast("string"))
    return F.coalesce(F.nullif(event, F.lit("")), F.concat(F.lit("h:"), F.substring(F.sha2(raw, 256), 1, 32)))


def norm(c: Column) -> Column:
    return strip(F.regexp_replace(F.lower(c), r"\s+", " "))


def severity_number(level_: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, n in SEVERITY.items():
        out = F.when(F.upper(level_) == name, n).otherwise(out)
    return F.coalesce(out, F.lit(9))


def any_of(words: list[str]) -> str:
    """An alternation that finds any of the words as they stand."""
    return "|".join("".join("\\" + ch if ch in r".^$*+?()[]{}|\\/" else ch for ch in w) for w in words)


def priority(kind: Column, content: Column, tags: Column) -> Column:
    hit = F.concat_ws(" ", F.lower(content), F.lower(F.array_join(tags, " "))).rlike(any_of(PRIORITY_WORDS))
    return F.when(kind != "SERVER_LOG", 0.0).when(hit, 5.0).otherwise(1.0)


def tags(level_: Column, server_type: Column, content: Column, new_template: Column, anomaly: Column, downsampled: Column, noise: Column, chat_: Column, meaningless_: Column, cheat: Column) -> Column:
    proxy = server_type == "velocity"
    return F.array_compact(
        F.array(
            F.lit("server_log"),
            F.lit("runtime_log"),
            F.lower(level_),
            F.when(proxy, "velocity").otherwise("minecraft"),
            F.when(proxy, "proxy"),
            F.when(F.lower(content).contains("exception"), "exception"),
            F.when(level_.isin("ERROR", "FATAL", "SEVERE"), "error").when(level_.isin("WARN", "WARNING"), "warning"),
            F.when(new_template, "new_template"),
            F.when(anomaly, "anomaly_spike"),
            F.when(downsampled, "info_downsampled"),
            F.when(noise, "daily_noise"),
            F.when(chat_, "chat_message"),
            F.when(chat_ & meaningless_, "chat_meaningless"),
            F.when(cheat, "anticheat_vulcan"),
        )
    )


def otel(ts_ms: Column, observed_ms: Column, level_: Column, text: Column, event: Column, server: Column, server_type: Column, server_name: Column, path: Column) -> Column:
    """The row in OpenTelemetry's log data model."""
    return F.struct(
        ts_ms.alias("timestamp"),
        observed_ms.alias("observedTimestamp"),
        level_.alias("severityText"),
        severity_number(level_).alias("severityNumber"),
        text.alias("body"),
        event.alias("eventName"),
        F.struct(server.alias("service_name"), server_type.alias("service_namespace"), server_name.alias("host_name")).alias("resource"),
        F.create_map(F.lit("log.file.name"), F.regexp_extract(path, r"([^/]*)$", 1), F.lit("log.file.path"), path).alias("attributes"),
    )


def cap_entries(m: Column, n: int = 16, size: int = 4000) -> Column:
    """The first n entries of a map, values cut to `size` characters."""
    return F.map_from_entries(F.transform(F.slice(F.map_entries(m), 1, n), lambda e: F.struct(e["key"], truncate(e["value"], size))))


def is_token(word: str) -> bool:
    """Short ASCII words are looked for as whole tokens, since longer words hold them by chance."""
    return word.isascii() and word.isalpha() and len(word) <= 6


def keys_match(c: Column, words: list[str]) -> Column:
    """Short ASCII words match whole tokens, longer ones and others anywhere; one expression for all of them."""
    short = [w for w in words if is_token(w)]
    long = [w for w in words if w not in short]
    parts = [rf"(?<![a-z0-9_])(?:{any_of(short)})(?![a-z0-9_])"] if short else []
    return F.lower(c).rlike("|".join([*parts, *([any_of(long)] if long else [])]))


def mask(c: Column, categories: dict[str, list[str]]) -> Column:
    """One bit for each category whose words occur."""
    out = F.lit(0)
    for i, words in enumerate(categories.values()):
        out = out.bitwiseOR(F.when(keys_match(c, words), 1 << i).otherwise(0))
    return out


def safe_name(c: Column) -> Column:
    """A file name part: other characters become _, no leading dot, 80 at most."""
    s = F.regexp_replace(c, r"[^A-Za-z0-9_.-]+", "_")
    s = F.substring(F.regexp_replace(s, r"^\.+", ""), 1, 80)
    return F.when(s == "", "unknown").otherwise(s)


def object_at(chars: Column, start: Column) -> Column:
    """The text from a `{` at place `start` (from 1) to the brace that closes it, braces inside strings apart; null if none does."""
    state = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.lit(0).alias("read"), F.lit(0).alias("end"))

    def read(s: Column, c: Column) -> Column:
        depth = s["depth"] + F.when(s["quoted"], 0).when(c == "{", 1).when(c == "}", -1).otherwise(0)
        quoted = s["quoted"] != ((c == '"') & ~s["escaped"])
        escaped = s["quoted"] & (c == "\\") & ~s["escaped"]
        closed = (depth == 0) & ~s["quoted"] & (c == "}")
        after = F.struct(depth.alias("depth"), quoted.alias("quoted"), escaped.alias("escaped"), (s["read"] + 1).alias("read"), F.when(closed, s["read"] + 1).otherwise(0).alias("end"))
        return F.when(s["end"] > 0, s).otherwise(after)

    end = F.aggregate(F.slice(chars, start, F.size(chars)), state, read)["end"]
    return F.when(end > 0, F.array_join(F.slice(chars, start, end), ""))


def first_json(c: Column) -> Column:
    """The first JSON object in a text, read from each `{` on in turn; null without one."""
    chars = F.split(c, "")
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.size(chars), F.lit(1))), lambda i: F.get(chars, i - 1) == "{")
    found = F.transform(places, lambda i: object_at(chars, i))
    return F.get(F.filter(found, lambda x: x.isNotNull() & F.try_parse_json(x).isNotNull()), 0)


def sample_times(samples: Column, anchor_ms: Column) -> Column:
    """The times [hh:mm:ss] in an array of texts, each on the day that brings it within 12 hours of the anchor."""
    day, clock = 86_400_000, r"\[([0-9]{2}:[0-9]{2}:[0-9]{2})\]"
    found = F.flatten(F.transform(samples, lambda x: F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(clock), F.lit(1))))

    def placed(x: Column) -> Column:
        part = lambda i: F.get(F.split(x, ":"), i).cast("long")
        at = F.floor(anchor_ms / day) * day + (part(0) * 3600 + part(1) * 60 + part(2)) * 1000
        return F.when(at - anchor_ms > day / 2, at - day).when(anchor_ms - at > day / 2, at + day).otherwise(at)

    return F.transform(found, placed)


#: The categories whose issues are shown by the times in their samples, and how long they must last for that.
TIGHTENED = ["complaint", "network", "plugin", "cross_server", "bug", "economy"]
TIGHTEN_MS = 30 * 60 * 1000


def tightened(category: Column, first_ms: Column, last_ms: Column, samples: Column) -> Column:
    """struct(first_ms, last_ms) to show: those of a long technical issue are the earliest and latest time in its samples, if they have any."""
    times = sample_times(samples, first_ms)
    return tightened_to(category, first_ms, last_ms, F.array_min(times), F.array_max(times))


def tightened_to(category: Column, first_ms: Column, last_ms: Column, low: Column, high: Column) -> Column:
    """tightened() by the earliest and latest time in the samples, null without any."""
    long = category.isin(TIGHTENED) & (last_ms - first_ms > TIGHTEN_MS) & low.isNotNull()
    shrunk = lambda c, to: F.when(F.coalesce(long, F.lit(False)), to).otherwise(c)
    return F.struct(shrunk(first_ms, low).alias("first_ms"), shrunk(last_ms, high).alias("last_ms"))


#: The most characters, list items, entries, key characters and levels of a context, and keys that are left out of it.
CONTEXT_CHARS, CONTEXT_ITEMS, CONTEXT_ENTRIES, CONTEXT_KEY, CONTEXT_DEPTH = 220, 8, 12, 64, 2
CONTEXT_SKIP = ["attributes", "content", "event"]


def compact_value(c: Column, kind: DataType, depth: int = 0) -> Column:
    """A nested value cut to what a prompt may hold, null where nothing is left.

    Texts are cleaned and cut; lists and objects keep their first items that aren't empty,
    keys of CONTEXT_SKIP left out; objects deeper than CONTEXT_DEPTH go. The walk follows the type.
    """
    if isinstance(kind, StringType):
        return F.nullif(truncate(clean_text(c), CONTEXT_CHARS), F.lit(""))
    if isinstance(kind, ArrayType):
        items = F.transform(F.slice(c, 1, CONTEXT_ITEMS), lambda x: compact_value(x, kind.elementType, depth + 1))
        kept = F.filter(items, lambda x: x.isNotNull())
        return F.when(F.size(kept) > 0, kept)
    if isinstance(kind, StructType | MapType) and depth >= CONTEXT_DEPTH:
        return F.lit(None).cast("string")
    if isinstance(kind, MapType):
        entries = F.transform(F.map_entries(c), lambda e: F.struct(truncate(e["key"], CONTEXT_KEY).alias("key"), compact_value(e["value"], kind.valueType, depth + 1).alias("value")))
        kept = F.slice(F.filter(entries, lambda e: e["value"].isNotNull() & ~e["key"].isin(CONTEXT_SKIP)), 1, CONTEXT_ENTRIES)
        return F.when(F.size(kept) > 0, F.map_from_entries(kept))
    if isinstance(kind, StructType):
        fields, before = [], F.lit(0)
        for f in kind.fields:
            if f.name not in CONTEXT_SKIP:
                value = compact_value(c[f.name], f.dataType, depth + 1)
                fields.append(F.when(before < CONTEXT_ENTRIES, value).alias(f.name[:CONTEXT_KEY]))
                before = before + value.isNotNull().cast("int")
        return F.when(before > 0, F.struct(*fields)) if fields else F.lit(None).cast("string")
    return c


def compact_context(c: Column, kind: StructType, fields: list[str]) -> Column:
    """JSON of the listed fields of a context, each cut by compact_value(); {} where nothing is left."""
    types = {f.name: f.dataType for f in kind.fields}
    return F.to_json(F.struct(*[compact_value(c[f], types[f]).alias(f) for f in fields if f in types]))


def free_text(c: Column, size: int = 500) -> Column:
    """Controls and phrases that address a reader as instructions dropped, redacted, cut; null is empty."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    for pattern in r.INJECTIONS:
        t = F.regexp_replace(t, pattern, "")
    return truncate(strip(F.regexp_replace(redact(t), r"\s+", " ")), size)


def hms_near(c: Column, anchor_ms: Column) -> Column:
    """The first hh:mm:ss of a text, on the day that brings it within 12 hours of the anchor; null without one."""
    h = F.regexp_extract(c, r"([0-9]{2}):([0-9]{2}):([0-9]{2})", 1)
    part = lambda i: F.regexp_extract(c, r"([0-9]{2}):([0-9]{2}):([0-9]{2})", i).cast("long")
    day = 86_400_000
    t = F.floor(anchor_ms / day) * day + (part(1) * 3600 + part(2) * 60 + part(3)) * 1000
    near = F.when(t - anchor_ms > day / 2, t - day).when(anchor_ms - t > day / 2, t + day).otherwise(t)
    return F.when(h != "", near)


def found_all(c: Column, pattern: str, group: int = 1, most: int = 8) -> Column:
    """Matches in order, each once whatever its case, `most` at most."""
    hits = F.regexp_extract_all(c, F.lit(pattern), F.lit(group))
    first = F.filter(hits, lambda x, i: F.array_position(F.transform(hits, lambda y: F.lower(y)), F.lower(x)) == i + 1)
    return F.slice(first, 1, most)


def firsts(names: Column, key: Callable[[Column], Column], most: int | None = None) -> Column:
    """The first name of each key, in order, `most` at most; names without a key go."""
    named = F.filter(names, lambda x: x.isNotNull() & (key(x) != ""))
    keys = F.transform(named, key)
    out = F.filter(named, lambda x, i: F.array_position(keys, key(x)) == i + 1)
    return out if most is None else F.slice(out, 1, most)


def mentioned(c: Column, patterns: list[str], fields: list[Column]) -> Column:
    """Names in structured fields, then what group 1 of each pattern finds in a text."""
    found = [F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(p), F.lit(1)) for p in patterns]
    return F.concat(F.array(*fields).cast("array<string>"), *found)


def plugin_names(c: Column, *fields: Column) -> Column:
    """Plugins and components that a line names, by structured fields and by its prefixes, paths and pools; servers, levels and packages are none."""

    def settled(x: Column) -> Column:
        bare = F.regexp_replace(x, r"^[\[\](){}:;,.\s]+|[\[\](){}:;,.\s]+$", "")
        name = F.regexp_replace(bare, r.PLUGIN_SUFFIX, "")
        bad = (F.char_length(bare) > 64) | bare.rlike(r"[./\\]") | F.lower(name).isin(r.NO_PLUGINS) | name.rlike(r.NO_PLUGIN)
        return F.when(~bad, name)

    return firsts(F.transform(mentioned(c, r.PLUGIN_PATTERNS, list(fields)), settled), lambda x: F.regexp_replace(F.lower(x), "[^a-z0-9]", ""), r.MOST_PLUGINS)


def person_names(c: Column, *fields: Column) -> Column:
    """Players that a line names, by structured fields and what it says of them; sorted."""
    names = F.transform(mentioned(c, r.PERSON_PATTERNS, list(fields)), lambda x: F.trim(x))
    return F.array_sort(F.filter(firsts(names, F.lower), lambda x: ~F.lower(x).isin(r.NO_PERSONS)))


def file_name(path: Column) -> Column:
    """The last part of a path, whichever slashes it has."""
    return F.regexp_extract(F.coalesce(path, F.lit("")), r"([^/\\]*)$", 1)


def world_name(context: Column) -> Column:
    """The world of a row's context: the first of its fields for one that isn't empty."""
    return F.coalesce(*[F.nullif(F.trim(F.try_element_at(context, F.lit(k))), F.lit("")) for k in ("world", "dimension", "location.world", "location.dimension")])


def location(server: Column, backend: Column, world: Column) -> Column:
    """server/backend@world, as far as they are known and differ."""
    s, b, w = (F.trim(F.coalesce(x.cast("string"), F.lit(""))) for x in (server, backend, world))
    base = F.when((s != "") & (b != "") & (s != b), F.concat(s, F.lit("/"), b)).when(b != "", b).otherwise(s)
    return F.when(w == "", base).when(base == "", w).otherwise(F.concat(base, F.lit("@"), w))


def position(world: Column, x: Column, y: Column, z: Column) -> Column:
    """world (x, y, z); null where a coordinate is missing."""
    at = F.concat(F.lit("("), x.cast("string"), F.lit(", "), y.cast("string"), F.lit(", "), z.cast("string"), F.lit(")"))
    w = F.trim(F.coalesce(world, F.lit("")))
    return F.when(w == "", at).otherwise(F.concat(w, F.lit(" "), at))


PLUGIN = r"(?i)plugin '?([A-Za-z][A-Za-z0-9_-]{1,30})"
PERSON = r"<([A-Za-z0-9_]{1,16})>"
CONFIG_FILE = r"([A-Za-z0-9_./-]+\.(?:yml|yaml|json|toml|properties|conf))"
WORLD = r"(?i)world[ /]([a-z0-9_-]{1,30})"
POSITION = r"(-?[0-9]+(?:\.[0-9]+)?, ?-?[0-9]+(?:\.[0-9]+)?, ?-?[0-9]+(?:\.[0-9]+)?)"
HOST = r"((?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?::[0-9]{2,5})?)"


def window_minutes(text: str, default: int = 480) -> int:
    """30m, 8h or 24 (hours) in minutes."""
    text = text.strip().lower()
    number, unit = (text[:-1], text[-1]) if text[-1:] in ("m", "h") else (text, "h")
    return max(1, int(number) * (60 if unit == "h" else 1)) if number.isdigit() else default
