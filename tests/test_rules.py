"""What lines mean: expected values are written by hand, not made of the rule tables."""

import pytest
from pyspark.sql import functions as F

from loomlog.functions import catalogue
from loomlog.operators import classify as k

T0 = 1_700_000_000_000
SCHEMA = "event_id long, seq long, ts_ms long, server_id string, player string, level string, message string, line string"


def log(spark, lines, step=1000):
    """lines: (level, message) or (level, message, server)."""
    rows = []
    for i, (level, message, *server) in enumerate(lines):
        thread = "Async Chat Thread - #1" if message.startswith("<") else "Server thread"
        rows.append((i, i, T0 + i * step, server[0] if server else "survival", "p", level, message, f"[10:00:{i % 60:02d}] [{thread}/{level}]: {message}"))
    return spark.createDataFrame(rows, SCHEMA)


CASES = [
    ("WARN", "io.netty.channel.unix.Errors$NativeConnectException: connect(..) failed: Connection refused", "network", "server_log_network"),
    ("WARN", "Broken pipe during packet flush", "network", "server_log_network"),
    ("ERROR", "Could not load plugin EssentialsX-2.20.1.jar", "plugin", "server_log_plugin"),
    ("ERROR", "Plugin DependsOnVault missing dependency: Vault", "economy", "server_log_economy"),  # the hint of the economy comes first
    ("ERROR", "Plugin Foo missing dependency: Worldedit", "plugin", "server_log_plugin"),
    ("ERROR", "Could not load plugin; see stacktrace below", "plugin", "server_log_plugin"),
    ("ERROR", "Could not load 'plugins/Foo.jar'", "plugin", "server_log_plugin"),
    ("ERROR", "Unknown dependency Worldedit", "plugin", "server_log_plugin"),
    ("FATAL", "OutOfMemoryError: Java heap space", "bug", "server_log_fatal"),
    ("ERROR", "java.lang.OutOfMemoryError: GC overhead limit", "bug", "server_log_error"),
    ("WARN", "Anticheat flagged Steve for kill aura (TPS drop reported)", "community", "server_log_community"),
    ("WARN", "Can't keep up! Player disconnected due to lag", "complaint", "server_log_performance"),
    ("ERROR", "java.net.SocketException: Connection reset", "network", "server_log_network"),
    ("ERROR", "服务器内存溢出，进程崩溃", "bug", "server_log_error"),
    ("ERROR", "商店扣款失败", "economy", "server_log_economy"),
    ("WARN", "**** SERVER IS RUNNING IN OFFLINE/INSECURE MODE!", "moderation", "server_log_auth"),
    ("ERROR", "communications link failure", "bug", "server_log_error"),
    ("WARN", "Velocity forwarding secret mismatch", "network", "server_log_network"),
    ("ERROR", "backup failed for world", "bug", "server_log_error"),
    ("WARN", "Failed to check for updates for plugin Foo", "plugin", "server_log_plugin_observation"),
    ("WARN", "Session ticker running behind by 3 ticks", "complaint", "server_log_performance_observation"),
    ("INFO", "Steve joined the game", "daily", "server_log_info"),
    ("INFO", "Steve lost connection: Disconnected", "daily", "server_log_info"),
    ("INFO", "UUID of player Steve is 069a79f4-44e9-4726-a5be-fca90e38aaf5", "daily", "server_log_info"),
    ("INFO", "HikariPool-1 - Start completed.", "daily", "server_log_info"),
    ("INFO", "Vote reward announcement sent", "community_ops", "server_log_community_ops_observation"),
    ("WARN", "a new version of Foo", "daily", "server_log_warn"),
    ("INFO", "<Steve> 又掉线了", "complaint", "server_log_performance"),  # a word of complaints, which come before the network
    ("INFO", "<Steve> 我进不去，连接失败", "player_feedback", "server_log_player_feedback"),
    ("INFO", "<Steve> 连不上了", "network", "server_log_network"),
    ("INFO", "<Steve> 管理员在吗", "player_feedback", "server_log_player_feedback"),
    ("INFO", "<Steve> 建议加个新功能", "player_feedback", "server_log_player_feedback_observation"),
    ("INFO", "<Steve> 有人飞行，疑似开挂", "community", "server_log_community"),
    ("INFO", "<Steve> 我在飞行", "daily", "server_log_info"),
    ("INFO", "<Steve> 商店异常，扣了金币", "bug", "server_log_info"),  # a word of bugs, which come before the economy
    ("INFO", "<Steve> 扣了钱没到账", "economy", "server_log_economy"),
    ("INFO", "<Steve> you find it on discord.gg/abc", "daily", "server_log_info"),
    ("INFO", "<Steve> 你好", "daily", "server_log_info"),
    ("INFO", "[Vulcan] Steve failed Speed (Type A) (2/20)", "community", "server_log_anticheat_vulcan"),
]


def test_categories_and_tags(spark):
    got = {r.event_id: r for r in k.classify(log(spark, [x[:2] for x in CASES])).collect()}
    wrong = [(x, got[i].category, got[i].tag) for i, x in enumerate(CASES) if (got[i].category, got[i].tag) != x[2:]]
    assert not wrong


@pytest.mark.parametrize(
    "message, labels, group, severity",
    [
        ("全服都掉线了", ["dropped"], "performance", "critical"),
        ("又掉线了", ["dropped"], "performance", "high"),
        ("传送失败了", ["teleport"], "performance", "high"),
        ("传送到主城", ["route", "main_city"], "building", "low"),
        ("好卡啊", ["lag"], "performance", "medium"),
        ("有人刷钱", ["economy_exploit"], "economy", "critical"),
        ("举报 Steve", ["report"], "admin", "medium"),
        ("hello everyone", ["greeting"], "small_talk", "low"),
        ("ok", ["chatting"], "small_talk", "info"),
        ("this", ["chatting"], "small_talk", "info"),
    ],
)
def test_chat_labels(spark, message, labels, group, severity):
    r = k.classify(log(spark, [("INFO", f"<Steve> {message}")])).first()
    assert (r.chat_labels, r.chat_category, r.chat_severity) == (labels, group, severity)


@pytest.mark.parametrize(
    "level, message, category, subtype, severity",
    [
        ("ERROR", "Failed to load chunk", "world", "chunk_error", "high"),
        ("WARN", "No space left on device", "storage", "disk_full", "critical"),
        ("INFO", "HikariPool-1 - Connection is not available, request timed out", "storage", "database_timeout", "high"),
        ("WARN", "HikariPool-1 - Added connection", "plugin", "unattributed_warning", "low"),
        ("SEVERE", "Could not fetch skin", "plugin", "external_fetch", "high"),
        ("FATAL", "Could not fetch skin", "plugin", "external_fetch", "critical"),
        ("ERROR", "something odd", "plugin", "unattributed_error", "medium"),
        ("WARN", "something odd", "plugin", "unattributed_warning", "low"),
        ("INFO", "something", "lifecycle", "routine", "info"),
        ("WARN", "TPS from last 1m: 19.9", "metrics", "metrics", "info"),
    ],
)
def test_operations(spark, level, message, category, subtype, severity):
    r = k.classify(log(spark, [(level, message)])).first()
    assert (r.ops_category, r.ops_subtype, r.ops_severity) == (category, subtype, severity)


def test_stack_frames_are_machinery(spark):
    r = k.classify(log(spark, [("ERROR", "at com.example.Foo.run(Foo.java:42)")])).first()
    assert (r.ops_subtype, r.category, r.evidence) == ("machinery", "daily", False)


def severities(spark, lines, **more):
    rows = k.classify(log(spark, lines))
    for name, v in more.items():
        rows = rows.withColumn(name, F.lit(v))
    return sorted((r.category, r.severity, r.n, r.alert) for r in k.issues(rows).collect())


def test_severity_of_groups(spark):
    assert severities(spark, [("FATAL", "OutOfMemoryError: Java heap space")]) == [("bug", "critical", 1, True)]
    assert severities(spark, [("ERROR", "Server thread froze for 60 seconds (tick took too long)")]) == [("complaint", "critical", 1, True)]
    assert severities(spark, [("ERROR", "Could not enable plugin 'FooUI' - dependency missing")]) == [("plugin", "high", 1, False)]
    assert severities(spark, [("WARN", "Server is lagging badly, TPS dropped to 5")] * 3) == [("complaint", "high", 3, True)]
    assert severities(spark, [("WARN", f"Connection reset by peer (player{i})") for i in range(5)]) == [("network", "high", 5, True)]
    assert severities(spark, [("ERROR", "Failed to load chunk", "a"), ("ERROR", "Failed to load chunk", "b")]) == [("complaint", "high", 2, True)]
    assert severities(spark, [("INFO", "Steve joined the game")] * 9) == []
    assert severities(spark, [("WARN", "Plugin Foo was reloaded")]) == []
    assert severities(spark, [("WARN", "Plugin Foo was reloaded")], anomaly_score=0.7) == [("plugin", "high", 1, False)]


def test_one_link_is_no_behaviour_two_are(spark):
    lines = [("INFO", "<Steve> see www.a.b"), ("INFO", "<Alex> look at discord.gg/x"), ("INFO", "<Alex> discord.gg/x again"), ("INFO", "<Bob> 威胁你")]
    got = {r.event_id: (r.chat_abuse, r.category, r.gate) for r in k.classify(k.behaviour(log(spark, lines))).select("*").withColumnRenamed("evidence", "e").collect()}
    assert got == {0: (False, "daily", "chat_review"), 1: (True, "chat_review", "chat_review"), 2: (True, "chat_review", "chat_review"), 3: (True, "chat_review", "chat_review")}
    flood = [("INFO", f"<Carl> 一二三四 {'x' * i}") for i in range(9)]
    assert {r.chat_flood for r in k.classify(k.behaviour(log(spark, flood))).collect()} == {True}


def test_noise_patterns_of_the_user(spark):
    one = lambda patterns: spark.range(1).select(catalogue.daily_noise(F.lit("custom Ping 17"), F.lit("INFO"), patterns).alias("x")).first().x
    assert one([r"custom ping \d+"]) and not one(["("]) and not one(None) and one(["(", "ping"])


def test_components_of_links(spark):
    from loomlog.operators.graph import components

    links = spark.createDataFrame([("a", "b"), ("c", "b"), ("d", "e"), ("f", "f"), ("z", "a")], "a string, b string")
    want = {"a": "a", "b": "a", "c": "a", "z": "a", "d": "d", "e": "d", "f": "f"}
    assert {r.node: r.component for r in components(links).collect()} == want
    assert components(links.limit(0)).count() == 0


ISSUE = "category string, tag string, session long, n long, first_ms long, last_ms long, servers array<string>, plugins array<string>, positions array<string>, players array<string>, labels array<string>, subtypes array<string>, ops_categories array<string>, f_accident boolean, rank int, alert boolean"


def issue(session, first, servers, plugins=(), players=("p", "q"), category="plugin", last=None):
    return (category, "t", session, 1, first, first + 1000 if last is None else last, list(servers), list(plugins), [], list(players), [], [], [], False, 2, False)


def test_incidents_merge_over_any_kind_of_scope(spark):
    rows = [issue(1, 0, ["a"], ["Shop"]), issue(2, 200_000, ["b"], ["Shop"]), issue(3, 400_000, ["b"], ["Vault"]), issue(4, 100_000, ["c"], ["Other"]), issue(5, 10_000_000, ["a"], ["Shop"]), issue(6, 0, ["d"], players=["eve"]), issue(7, 100, ["e"], players=["eve"]), issue(8, 0, ["a"], ["Shop"], category="network")]
    got = k.identified(k.incidents(spark.createDataFrame(rows, ISSUE))).collect()
    sets = {r.incident: (r.issues, r.scopes) for r in got}
    assert sets == {
        "plugin:t:1": (3, ["plugin:Shop", "plugin:Vault", "server:a", "server:b"]),
        "plugin:t:4": (1, ["plugin:Other", "server:c"]),
        "plugin:t:5": (1, ["plugin:Shop", "server:a"]),
        "plugin:t:6": (2, ["player:eve", "server:d", "server:e"]),
        "network:t:8": (1, ["plugin:Shop", "server:a"]),
    }
    again = {r.incident: r for r in got}
    assert ":" not in again["plugin:t:1"].state_key and again["network:t:8"].state_key == again["plugin:t:5"].state_key.split(":")[0] and again["plugin:t:5"].state_key.endswith(":2")
    assert len({r.id for r in got}) == 5 and all(r.id.startswith("MS-") and len(r.id) == 15 for r in got)


def test_incidents_without_a_scope_are_of_the_window(spark):
    rows = [issue(1, 0, []), issue(2, 1000, []), issue(3, 0, ["a"])]
    assert {(r.incident, r.issues) for r in k.incidents(spark.createDataFrame(rows, ISSUE)).collect()} == {("plugin:t:1", 2), ("plugin:t:3", 1)}
