"""Reading of answers, advice, sample times, and file order: cases by hand."""

import gzip
import os

import pytest
from pyspark.sql import functions as F

from loomlog.functions import catalogue
from loomlog.functions import text as t
from loomlog.operators.windows import rank_globally
from loomlog.sources import files


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("out")).first().out


@pytest.mark.parametrize(
    "text,want",
    [
        ('{bad {"a":1} tail}', '{"a":1}'),
        ('{"a":1} and {"b":2}', '{"a":1}'),
        ('say {"a":"}{ \\" {"} end}', '{"a":"}{ \\" {"}'),
        ('{"a":{"b":[1,{"c":2}]}}', '{"a":{"b":[1,{"c":2}]}}'),
        ('{"a":1', None),
        ("no braces", None),
        ("", None),
        (None, None),
        ("{}", "{}"),
        ('x } { "a" : 1 } {', '{ "a" : 1 }'),
        ('a string "{" then {"k":2}', '{"k":2}'),
    ],
)
def test_first_json_object(spark, text, want):
    assert one(spark, t.first_json(F.col("x").cast("string")), x=text) == want


@pytest.mark.parametrize(
    "action,issue,safe",
    [
        ("check the information page", "any", True),
        ("format the drive", "any", False),
        ("then Format it", "any", False),
        ("rm -rf /data", "disk", False),
        ("立即封禁该玩家", "外挂", False),
        ("执行 rcon", "x", False),
        ("restart MySQL", "the jdbc pool is empty", True),
        ("restart mysql", "slow ticks", False),
        ("look at the heap", "GC overhead", True),
        ("reformatting is not a verb here", "x", True),
        ("", "x", False),
        (None, "x", False),
    ],
)
def test_advice_is_safe_and_grounded(spark, action, issue, safe):
    assert one(spark, catalogue.action_safe(F.col("a").cast("string"), F.col("i")), a=action, i=issue) is safe


def test_long_technical_issues_are_shown_by_their_samples(spark):
    t0 = 1_700_006_400_000  # midnight and 4000 s
    rows = [
        ("plugin", t0, t0 + 3_600_000, ["[00:20:00] a", "x [00:40:10] b [00:30:00]"]),
        ("daily", t0, t0 + 3_600_000, ["[00:20:00] a"]),
        ("plugin", t0, t0 + 60_000, ["[00:20:00] a"]),
        ("plugin", t0, t0 + 3_600_000, ["no time", None]),
        ("bug", t0, t0 + 3_600_000, ["[23:59:00]"]),
    ]
    df = spark.createDataFrame(rows, "c string, a long, b long, s array<string>")
    got = [tuple(r.x) for r in df.select(t.tightened(F.col("c"), F.col("a"), F.col("b"), F.col("s")).alias("x")).collect()]
    day = t0 // 86_400_000 * 86_400_000
    assert got == [(day + 1_200_000, day + 2_410_000), (t0, t0 + 3_600_000), (t0, t0 + 60_000), (t0, t0 + 3_600_000), (day - 60_000, day - 60_000)]


def test_backfill_is_newest_file_first_whatever_folders_are_called(spark, tmp_path):
    now = 1_704_499_200_000
    for top, name, text in [("x", "2024-01-05-1.log.gz", "five x"), ("y", "2024-01-05-1.log.gz", "five y"), ("x", "2024-01-04-1.log.gz", "four x"), ("y", "latest.log", "live y")]:
        folder = tmp_path / top / "logs"
        folder.mkdir(parents=True, exist_ok=True)
        body = f"[10:00:00] {text} 1\n[10:00:01] {text} 2\n".encode()
        (folder / name).write_bytes(gzip.compress(body) if name.endswith(".gz") else body)
        os.utime(folder / name, (1_704_450_000 + len(text) + (top == "y"), 1_704_450_000 + len(text) + (top == "y")))
    got = [r.line.split("] ")[1] for r in files.backfill(spark, str(tmp_path), 1_704_326_400_000, now, 7).collect()]
    assert got == ["live y 1", "live y 2", "five y 1", "five y 2", "five x 1", "five x 2", "four x 1"]


def test_cached_files_are_read_again_when_their_size_changes(spark, tmp_path):
    log, cache = tmp_path / "logs" / "latest.log", str(tmp_path / "cache")
    log.parent.mkdir()
    log.write_text("[10:00:00] one\n")
    os.utime(log, (1_704_450_000, 1_704_450_000))
    assert files.cached_scan(spark, str(log.parent), cache, 1_704_499_200_000).count() == 1
    log.write_text("[10:00:00] one\n[10:00:01] two\n")
    os.utime(log, (1_704_450_000, 1_704_450_000))
    assert files.cached_scan(spark, str(log.parent), cache, 1_704_499_200_000).count() == 2


def test_equal_rows_are_ranked_alike_whatever_their_partitions(spark):
    df = spark.range(200).selectExpr("id", "id % 3 AS k", "map('a', id) AS m")
    ranks = lambda n: {r.id: r._rank for r in rank_globally(df.repartition(n), ["k"]).collect()}
    assert ranks(2) == ranks(7) and sorted(ranks(3).values()) == list(range(200))


@pytest.mark.parametrize(
    "line,want",
    [
        ("[1] [Craft Scheduler Thread - 7 - Shop/WARN]: x", ["Shop"]),
        ("[a]: [Vault] reads plugins/vault/config.yml and plugins/Essentials/x", ["Vault", "Essentials"]),
        ("LuckPerms-HikariPool-1 waits, Quick-Shop-Pool too", ["LuckPerms", "Quick-Shop"]),
        ("[a]: [Server] [b]: [INFO] pool-1-HikariPool com_x-Pool plugins/a.b/x", []),
        ("[Chunky-worker-3/INFO] [chunky-thread/INFO]", ["Chunky"]),
        (None, []),
    ],
)
def test_plugins_of_a_line(spark, line, want):
    assert one(spark, t.plugin_names(F.col("x").cast("string")), x=line) == want
    assert one(spark, t.plugin_names(F.col("x").cast("string"), F.lit("[Own-Database]"), F.lit(None).cast("string"))[0], x=line) == "Own"


@pytest.mark.parametrize("line,want", [("a: Bob lost connection: x: bob issued server command: /x", ["bob"]), ("UUID of player Zed is 1: Al[/1.2.3.4:5] logged in", ["Al", "Zed"]), ("console issued server command: /stop", []), ("", [])])
def test_players_of_a_line(spark, line, want):
    assert one(spark, t.person_names(F.col("x")), x=line) == want


def test_places(spark):
    at = lambda *v: one(spark, t.location(*[F.lit(x).cast("string") for x in v]))
    assert [at("s", "b", "w"), at("s", "s", None), at("s", "", "w"), at(None, "b", " "), at("", None, "w"), at(None, None, None)] == ["s/b@w", "s", "s@w", "b", "w", ""]
    assert one(spark, t.position(F.lit("w"), F.lit(1), F.lit(2.5), F.lit(-3))) == "w (1, 2.5, -3)" and one(spark, t.position(F.lit(None), F.lit(1), F.lit(None), F.lit(3))) is None
    assert one(spark, t.file_name(F.lit("C:\\logs/x\\latest.log"))) == "latest.log"


def test_evidence_by_score_then_in_order_then_by_score(spark):
    """Against the rule, row by row."""
    import random

    from loomlog.operators import sampling

    rng = random.Random(3)
    rows = [(g, i, rng.choice("abcdefghijklm"), float(rng.choice([5, 40, 50, 55, 60, 90]))) for g in "xy" for i in range(40)]
    df = spark.createDataFrame(rows, "g string, i long, m string, s double")
    for k in (1, 4, 10, 30):
        want = set()
        for g in "xy":
            mine = [r for r in rows if r[0] == g]
            ranked = sorted(mine, key=lambda r: (-r[3], r[1]))
            seen, got = set(), []
            for some, most in ((ranked, max(1, k * 3 // 5)), ([r for r in mine if r[3] >= 50], k), (ranked, k)):
                for r in some:
                    if len(got) >= most:
                        break
                    if r[2] not in seen:
                        seen.add(r[2])
                        got.append(r)
            want |= {(r[0], r[1]) for r in got}
        found = sampling.evidence(df, ["g"], F.col("m"), F.col("s"), ["i"], k)
        assert {(r.g, r.i) for r in found.collect()} == want


def test_plans_and_actions(spark):
    from loomlog.operators import advice

    rows = [
        ("plugin", "t", "high", ["storage", "economy"], ["config_error"]),
        ("network", "t", "low", [], []),
        ("plugin", "server_log_loop_x", "low", ["plugin"], []),
        ("chat_review", "t", "critical", [], []),
        ("bug", "t", "medium", ["storage"], ["disk_full"]),
        ("bug", "t", "high", ["storage", "network", "performance", "position"], ["config_error", "database_timeout"]),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, category string, tag string, severity string, ops_categories array<string>, subtypes array<string>")
    steps = {i: [] for i in range(len(rows))}
    for r in sorted(advice.plans(df).collect(), key=lambda r: (r.id, r.place)):
        steps[r.id].append(r.step)
        assert len(steps[r.id]) == r.place and r.check and r.expected and r.otherwise
    assert steps[0] == ["locate", "database_reach", "database_pool", "database_assets", "configuration", "verify"]
    assert steps[1] == ["locate", "network", "verify"] and steps[2] == ["locate", "plugin", "verify"] and steps[3] == ["locate", "conduct", "verify"]
    assert steps[5] == ["locate", "database_reach", "database_pool", "configuration", "network", "performance"]
    assert [r.a for r in df.orderBy("id").select(advice.action.make().alias("a")).collect()] == ["plugin", "network", "loop", "urgent", "disk", "database"]
    assert set(advice.TEXTS) >= {"none", "urgent"}


def test_prompt_samples_by_hand(spark):
    """Best of equal texts, without low ones if enough are left, 2 of 3 by score, the rest at even steps, then in order."""
    import random

    from loomlog.operators import sampling

    rng = random.Random(4)
    rows = [(i, rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice("12"), float(rng.randint(0, 9)), rng.random() < 0.3, float(rng.choice([0, 0, 1, 2, 5]))) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, text string, rank double, low boolean, score double")
    for k in (6, 20, 45):
        best = {}
        for r in rows:
            if r[1] not in best or (-r[2], r[0]) < (-best[r[1]][2], best[r[1]][0]):
                best[r[1]] = r
        pool = sorted(best.values())
        worth = [r for r in pool if not r[3]]
        pool = worth if len(worth) >= k else pool
        if len(pool) > k:
            first = sorted([r for r in pool if r[4] > 0], key=lambda r: (-r[4], r[0]))[: max(1, k * 2 // 3)]
            m = k - k * 2 // 3 + 2
            even = pool if len(pool) <= m else [pool[j] for j in sorted({round(i * ((len(pool) - 1) / (m - 1))) for i in range(m)})]
            picked = first + [r for r in even if r not in first][: max(0, k - len(first))]
            picked += [r for r in pool if r not in picked][: max(0, k - len(picked))]
        else:
            picked = pool
        got = sampling.prompt_sample(df, "text", F.col("rank"), F.col("low"), F.col("score"), ["id"], "id", k)
        assert sorted(r.id for r in got.collect()) == sorted(r[0] for r in picked)


def test_contexts_are_cut_level_by_level(spark):
    import json

    kind = "struct<level: string, n: int, list: array<string>, a: struct<event: string, b: struct<x: string, c: struct<d: string>>>, m: map<string, array<string>>, other: string>"
    rows = [
        (("ERROR", 3, [str(i) for i in range(12)], ("no", ("ab " * 150, ("deep",))), {"content": ["no"], "k" * 70: ["a", "", None], "z": []}, "left out"),),
        ((None, None, ["", None], ("no", ("", None)), {}, "left out"),),
        ((" see https://a.b/c ", 0, None, None, None, None),),
    ]
    df = spark.createDataFrame(rows, f"c {kind}")
    got = [json.loads(r.x) for r in df.select(t.compact_context(F.col("c"), df.schema["c"].dataType, ["level", "n", "list", "a", "m", "absent"]).alias("x")).collect()]
    assert got[0] == {"level": "ERROR", "n": 3, "list": list("01234567"), "a": {"b": {"x": ("ab " * 150)[:217] + "..."}}, "m": {"k" * 61 + "...": ["a"]}}
    assert got[1] == {} and got[2] == {"level": "see <url>", "n": 0}
