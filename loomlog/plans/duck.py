"""SQL of the scalar columns, written for engines with RE2 expressions: no lookbehind, no backreferences."""

from __future__ import annotations

from loomlog.functions import text as t


def q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def sub(s: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({s}, {q(pattern)}, '{by}', 'g')"


def get(s: str, pattern: str, group: int) -> str:
    return f"regexp_extract({s}, {q(pattern)}, {group})"


def has(s: str, pattern: str) -> str:
    return f"regexp_matches({s}, {q(pattern)})"


def strip(s: str) -> str:
    return sub(s, r"^\s+|\s+$")


def transport(s: str) -> str:
    return sub(sub(s, t.ANSI), t.TRANSPORT)


def sanitize(s: str) -> str:
    return strip(sub(transport(s), t.IPV4, "<ip>"))


def level(s: str) -> str:
    found = f"upper({get(s, t.LEVEL, 1)})"
    return f"CASE WHEN {found} = 'WARNING' THEN 'WARN' WHEN {found} <> '' THEN {found} WHEN {has(f'lower({s})', 'fatal|severe|error|exception')} THEN 'ERROR' WHEN {has(f'lower({s})', 'warn|failed|timeout')} THEN 'WARN' ELSE 'INFO' END"


def numbers(s: str) -> str:
    """Numbers masked, but for a digit or minus right behind a letter: those are put aside as control characters first."""
    s = f"regexp_replace({s}, '([A-Za-z_])-', '\\1' || chr(2), 'g')"
    for d in range(10):
        s = f"regexp_replace({s}, '([A-Za-z_]){d}', '\\1' || chr({16 + d}), 'g')"
    s = sub(s, r"-?[0-9]+(?:\.[0-9]+)?", "<num>")
    return f"translate({s}, chr(2) || " + " || ".join(f"chr({16 + d})" for d in range(10)) + ", '-0123456789')"


def normalised(s: str) -> str:
    x = f"lower({sanitize(s)})"
    for p, by in ((t.PREFIX, ""), (t.FULL_TIME, ""), (t.CLOCK, ""), (t.UUID, "<uuid>"), (t.IPV4, "<ip>"), (t.HEX, "0x<num>")):
        x = sub(x, p, by)
    x = strip(sub(numbers(x), r"\s+", " "))
    return f"CASE WHEN {x} = '' THEN 'empty' ELSE {x} END"


def fingerprint(s: str) -> str:
    return f"substr(sha1({normalised(s)}), 1, 24)"


def redacted(s: str) -> tuple[str, list[str]]:
    counts = []
    for name, p in t.REDACTIONS:
        counts.append(f"len(regexp_extract_all({s}, {q(p)}))")
        s = sub(s, p, f"<{name}>")
    return s, counts


def clean_text(s: str) -> str:
    return strip(sub(redacted(transport(s))[0], r"\s+", " "))


def run_of(s: str, n: int) -> str:
    """Whether one character stands n times in a row: by comparing each place with those behind it."""
    return f"len(list_filter(range(1, length({s}) - {n - 2}), lambda i: substr({s}, i, {n}) = repeat(substr({s}, i, 1), {n}))) > 0"


def symbols(s: str) -> str:
    return f"(length({s}) >= 8 AND length({sub(s, '[^\\p{L}\\p{N}]')}) * 4 < length({s}))"


def flags(s: str) -> str:
    bare = sub(s, t.ANSI)
    full, counts = redacted(transport(s))
    text = clean_text(s)
    each = [f"CASE WHEN {sub(bare, t.TRANSPORT)} <> {bare} THEN 'control_stripped' END"]
    each += [f"CASE WHEN {n} > 0 THEN 'redacted_{name}' END" for (name, _), n in zip(t.REDACTIONS, counts, strict=True)]
    each += [f"CASE WHEN {text} <> {strip(full)} THEN 'whitespace_collapsed' END", f"CASE WHEN {text} = '' THEN 'empty' END", f"CASE WHEN {run_of(text, 12)} THEN 'low_signal_repetition' END", f"CASE WHEN {symbols(text)} THEN 'low_signal_symbols' END"]
    return f"list_filter([{', '.join(each)}], lambda x: x IS NOT NULL)"


def quality(n: str, fs: str) -> str:
    cost = "CASE " + " ".join(f"WHEN f = '{k}' THEN {v}" for k, v in t.PENALTIES.items()) + " WHEN starts_with(f, 'redacted_') THEN 0 ELSE 4 END"
    return f"greatest(0, least(100, 100 - least({n}, 8) * 3 - coalesce(list_sum(list_transform({fs}, lambda f: {cost})), 0)))::INT"


def chat(s: str) -> tuple[str, str]:
    x = sub(strip(sub(strip(sub(s, t.CHAT_THREAD)), t.PREFIX)), r"^[ :\t]+")
    plugin, native = strip(get(x, t.CHAT_PLUGIN, 2)), strip(get(x, t.CHAT_NATIVE, 2))
    player = f"CASE WHEN {plugin} <> '' THEN {get(x, t.CHAT_PLUGIN, 1)} WHEN {native} <> '' THEN {get(x, t.CHAT_NATIVE, 1)} WHEN {has(s, t.CHAT_THREAD)} AND {x} <> '' THEN '' END"
    message = f"CASE WHEN {plugin} <> '' THEN {plugin} WHEN {native} <> '' THEN {native} WHEN {has(s, t.CHAT_THREAD)} AND {x} <> '' THEN {x} END"
    return player, message


def meaningless(s: str) -> str:
    return f"({run_of(s, 8)} OR (length({s}) >= 3 AND NOT {has(s, '[\\p{L}\\p{N}]')}))"


def message_key(s: str) -> str:
    return sub(f"lower({sub(s, '\\s+')})", r"[^\p{L}\p{N}_]")


def norm(s: str) -> str:
    return strip(sub(f"lower({s})", r"\s+", " "))


def body(s: str) -> str:
    return sub(sub(s, t.PREFIX), r"^[ :\t]+")


def line_kind(s: str) -> str:
    return f"CASE WHEN {has(body(s), t.FRAME)} THEN 'stacktrace_frame' WHEN {has(body(s), t.DETAIL)} THEN 'diagnostic_detail' ELSE 'message' END"


def severity(s: str) -> str:
    return "CASE " + " ".join(f"WHEN upper({s}) = '{k}' THEN {v}" for k, v in t.SEVERITY.items()) + " ELSE 9 END::INT"


def similar(a: str, b: str) -> str:
    return f"({a} <> '' AND {b} <> '' AND ({a} = {b} OR (abs(length({a}) - length({b})) <= 2 AND (contains({a}, {b}) OR contains({b}, {a}) OR (greatest(length({a}), length({b})) BETWEEN 3 AND 8 AND levenshtein({a}, {b}) <= 1)))))"


def keys_match(s: str, words: list[str]) -> str:
    short = [w for w in words if t.is_token(w)]
    long = [w for w in words if w not in short]
    parts = []
    if short:
        parts.append(f"list_has_any(regexp_split_to_array(lower({s}), '[^a-z0-9_]+'), [{', '.join(q(w) for w in short)}])")
    if long:
        parts.append("(" + " OR ".join(f"contains(lower({s}), {q(w)})" for w in long) + ")")
    return "(" + " OR ".join(parts) + ")"


def words_of(step: str, columns: dict[str, str], source: str) -> str:
    """One link of a chain of WITH: source and further columns."""
    return f"{step} AS (SELECT *, " + ", ".join(f"{sql} AS {name}" for name, sql in columns.items()) + f" FROM {source})"


def classified(source: str = "log", flood: str = "false", abuse: str = "false", loop: str = "false") -> str:
    """The WITH chain that ends in cls: source (line, message, level) with all columns of classification."""
    from loomlog.functions import catalogue as c

    cheat = f"CASE WHEN {get('line', t.ANTICHEAT, 1)} <> '' THEN "
    body = strip(r"regexp_replace(_t, '(?s)^.*\]:', '')")
    chain = [
        words_of("c0", {"chat_player": chat("line")[0], "chat_message": chat("line")[1], "cheat_player": f"{cheat}{get('line', t.ANTICHEAT, 1)} END", "cheat_check": f"{cheat}{sub(get('line', t.ANTICHEAT, 2), '^[ :,.]+|[ :,.]+$')} END", "_t": "lower(line)", "_m": "lower(ltrim(message))", "_lv": "CASE WHEN lower(level) = 'warning' THEN 'warn' ELSE lower(coalesce(level, '')) END", "_kind": line_kind("line"), "_repeats": run_of("message", 12), "_noise": c.daily_noise_sql("line", "upper(level)"), "_flood": flood, "_abuse": abuse, "_loop": loop}, source),
        words_of("c1", {"_body": body}, "c0"),
        words_of("c2", {"_bare": sub("_body", r"^(?:\[[^\]]*\]\s*)+")}, "c1"),
        words_of("c3", {"_kinds": r"len(list_distinct(list_filter(string_split(regexp_replace(_bare, '\s+', '', 'g'), ''), lambda x: x <> '')))::VARCHAR", "_w": c.LINE.found_sql("_t"), "_cw": f"CASE WHEN chat_message IS NOT NULL THEN {c.SAID.found_sql('lower(chat_message)')} END"}, "c2"),
    ]
    last = "c3"
    for i, step in enumerate(c.STEPS):
        name = "cls" if i == len(c.STEPS) - 1 else f"c{4 + i}"
        chain.append(words_of(name, {k: e.sql for k, e in step.items()}, last))
        last = name
    return ",\n".join(chain)
