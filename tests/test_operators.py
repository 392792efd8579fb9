"""Operators on small hand-made rows: boundaries, ties, nulls and empty input."""

import datetime
import gzip
import random
import re

import pytest
from pyspark.sql import functions as F

from loomlog.functions import catalogue
from loomlog.functions import text as t
from loomlog.operators import aggregates, classify, joins, loops, sampling, windows
from loomlog.operators.graph import components
from loomlog.sources import files

T0 = 1_700_000_000_000


def one(spark, make, *values):
    row = spark.range(1).select(make(*[F.lit(v) for v in values]).alias("out")).first()
    return row.out


@pytest.mark.parametrize("text, want", [("", "empty"), ("foo123 x", "foo1<num> x"), ("a -5 b", "a <num> b"), ("[10:11:12] [main/INFO] id=7.5", "id=<num>"), ("0xFF at 1.2.3.4", "<num>x<num> at <ip>")])
def test_fingerprint_text(spark, text, want):
    assert one(spark, t.normalised, text) == want


@pytest.mark.parametrize("a, b, want", [("abc", "abc", True), ("abcd", "abxd", True), ("ab", "ac", False), ("", "", False), ("message0", "message1", True), ("longmessage0", "longmessage1", False), ("jiaqun", "jiaquna", True)])
def test_similar(spark, a, b, want):
    assert one(spark, t.similar, a, b) is want


def test_similar_texts_share_a_key(spark):
    random.seed(3)
    words = ["".join(random.choice("abc") for _ in range(random.randint(1, 9))) for _ in range(120)]
    w = spark.createDataFrame([(x,) for x in set(words)], "a string")
    keyed = w.withColumn("k", F.explode(t.similarity_keys(F.col("a"))))
    met = keyed.join(keyed.withColumnRenamed("a", "b"), "k").select("a", "b").distinct()
    pairs = w.crossJoin(w.withColumnRenamed("a", "b")).where(t.similar(F.col("a"), F.col("b")))
    assert pairs.exceptAll(pairs.join(met, ["a", "b"], "left_semi")).count() == 0


def test_quality_and_truncate(spark):
    got = spark.range(1).select(t.clean(F.lit("see https://a.b/c  a@b.co")).alias("c")).select(t.quality(F.col("c.redactions"), F.col("c.flags")).alias("q"), "c.text").first()
    assert got.text == "see <url> <email>" and got.q == 100 - 6 - 2
    assert one(spark, lambda c: t.truncate(c, 5), "abcdefg") == "ab..."
    assert one(spark, lambda c: t.truncate(c, 2), "abcdefg") == "ab"


def test_future_clock_is_yesterday(spark):
    now = 1_704_153_600_000
    make = lambda c: t.timestamp_ms(t.time_parts(c), F.lit(datetime.date(2024, 1, 2)), F.lit(0), F.lit(now))
    assert one(spark, make, "[23:00:00] x") == now - 3_600_000
    assert one(spark, make, "[00:30:00] x") == now + 1_800_000
    assert one(spark, make, "2024-01-01 00:00:01.5 x") == 1_704_067_201_500


def test_gap_sessions_split_above_the_gap_only(spark):
    rows = spark.createDataFrame([("a", T0, 1), ("a", T0 + 300_000, 2), ("a", T0 + 600_001, 3), ("a", 0, 4)], "k string, ts_ms long, seq long")
    got = {r.seq: r.session for r in windows.sessions(rows, ["k"]).collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 1}


def chat(spark, texts, step):
    return spark.createDataFrame([("p", T0 + i * step, i, x) for i, x in enumerate(texts)], "player string, ts_ms long, seq long, chat_message string")


def test_floods(spark):
    kinds = lambda rows: {r.kind for r in windows.floods(rows).collect()}
    words = ["alpha", "bravo", "charlie", "delta", "echo", "foxtrot", "golf", "hotel"]
    assert kinds(chat(spark, words, 4000)) == {"high_frequency"}
    assert kinds(chat(spark, words[:5], 12_000)) == set()
    assert kinds(chat(spark, ["same words"] * 5, 60_000)) == {"repeat_content"}
    assert kinds(chat(spark, ["!!!", "???", "...."], 60_000)) == {"meaningless"}
    assert windows.floods(chat(spark, words, 1).where("false")).count() == 0


def test_repeat_pairs_are_those_of_all_rows(spark):
    """Against all pairs, rows that are there twice counted twice; slots of more rows than a task pairs are dealt; pairs aren't shuffled."""
    rng = random.Random(11)
    words = ["hello", "hallo", "hello there", "hello there x", "spam", "spam!", "spa", "!!", "", None, "加群1", "加群2"]
    rows = [(rng.choice("pq"), T0 + rng.choice([0, 0, 1, 1000, 299_999, 300_000, 300_001, 700_000]) + rng.randrange(3), i // 2 if i < 60 else i, rng.choice(words)) for i in range(240)]
    rows += rows[:20]
    df = spark.createDataFrame(rows, "player string, ts_ms long, seq long, chat_message string")
    norm = windows.with_key(df, "chat_message").select("player", F.col("ts_ms").alias("ts"), "seq", "norm")
    a, b = (norm.select("player", *[F.col(c).alias(f"{x}_{c}") for c in ("ts", "seq", "norm")]) for x in "ab")
    every = a.join(b, "player").where(t.similar(F.col("a_norm"), F.col("b_norm")) & (F.col("b_ts") - F.col("a_ts") <= 300_000) & (F.struct("b_ts", "b_seq") > F.struct("a_ts", "a_seq")))
    want = sorted(map(tuple, every.select("player", "a_ts", "a_seq", "b_ts", "b_seq").collect()))
    assert len(want) > 1000 and len(set(want)) < len(want)
    for piece in (windows.PIECE, 3):
        got = windows.repeat_pairs(df, "player", "ts_ms", "seq", "chat_message", 300_000, piece)
        assert sorted(map(tuple, got.collect())) == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [player#" not in plan.split("Join Inner")[0]


def test_spike_scores(spark):
    rows = [("s", "t", T0 // 60_000 * 60_000 + i * 60_000, i) for i in range(5)]
    rows += [("s", "t", T0 // 60_000 * 60_000 + 300_000 + i * 100, 5 + i) for i in range(20)]
    got = windows.anomalies(spark.createDataFrame(rows, "server string, tpl string, ts_ms long, seq long"), ["server", "tpl"], ["ts_ms", "seq"]).collect()
    assert max(r.score for r in got) >= 0.5 and sum(r.reason == "new_template" for r in got) == 1


def test_loops_keep_totals_in_any_order(spark):
    random.seed(5)
    ts = [T0]
    for _ in range(300):
        ts.append(ts[-1] + random.choice([0, 1000, 40_000, 299_999, 300_000, 300_001, 900_000]))
    rows = [("s", "k", x, i) for i, x in enumerate(ts)]
    random.shuffle(rows)
    got = loops.suppress(spark.createDataFrame(rows, "server_id string, key string, ts_ms long, event_id long")).collect()
    assert sum(r.event_id is not None for r in got) + sum(r.suppressed for r in got) == len(ts)
    want = loops.run(zip(ts, range(len(ts)), strict=True))
    assert sorted((r.ts_ms, -1 if r.event_id is None else r.event_id, r.suppressed) for r in got) == sorted((a, -1 if b is None else b, c) for a, b, c in want)


def test_nearest_ties_and_absence(spark):
    left = spark.createDataFrame([("a", 1, 100), ("a", 2, 150), ("b", 3, 5)], "k string, l long, ts long")
    right = spark.createDataFrame([("a", 10, 90), ("a", 11, 110), ("a", 12, 200)], "k string, r long, rts long")
    assert {x.l: x.r for x in joins.nearest(left, right, ["k"], "l", "ts", "r", "rts").collect()} == {1: 10, 2: 11, 3: None}


def test_components(spark):
    links = spark.createDataFrame([("a", "b"), ("c", "b"), ("d", "e"), ("f", "f")], "a string, b string")
    assert {r.node: r.component for r in components(links).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "f"}


def test_samples_are_reproducible_and_bounded(spark):
    rows = spark.range(1000).withColumnRenamed("id", "event_id")
    a = {r.event_id for r in sampling.reservoir(rows, "event_id", 50).collect()}
    assert a == {r.event_id for r in sampling.reservoir(rows.repartition(7), "event_id", 50).collect()} and len(a) == 50
    assert [r.event_id for r in windows.even_sample(rows, ["event_id"], 3).orderBy("event_id").collect()] == [0, 500, 999]
    assert sampling.fit_budget(["abc"] * 10, 12) == ["abc"] * 3


def test_sources(spark, tmp_path):
    (tmp_path / "2024-01-01-1.log.gz").write_bytes(gzip.compress(b"[10:00:00] [main/ERROR]: a\n\nno time\n"))
    (tmp_path / "latest.log").write_text("[11:00:00] [main/INFO]: b\n")
    got = files.scan(spark, str(tmp_path), 1_800_000_000_000).orderBy("path", "line_no").collect()
    assert [(r.line, r.ts_ms) for r in got][:2] == [("[10:00:00] [main/ERROR]: a", 1_704_103_200_000), ("no time", 1_704_103_200_000)]
    assert len(got) == 3
    assert files.candidates(spark, str(tmp_path), datetime.date(2030, 1, 1), 5).count() == 1
    assert files.sources(spark, ["/srv/a", {"id": "a", "root": "/x"}, {"id": "b"}, {"log_file": "/y/z.log", "id": "c", "type": "velocity"}]).count() == 2


def test_store_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("1", "SERVER_LOG", "s", T0), ("2", "CHAT", "s", T0), ("3", "SERVER_LOG", "s", T0 - 90 * 86_400_000)], "event_id string, kind string, server_id string, ts_ms long")
    path = str(tmp_path / "store")
    files.store(rows, path, T0)
    assert [r.event_id for r in files.read_store(spark, path, "s", T0 - 1, T0 + 1).collect()] == ["1"]
    assert files.drop_expired(spark, path, datetime.date(2100, 1, 1)) == ["server_id=s/day=2023-11-14"]
    files.write_jsonl(rows.select("event_id", "kind"), str(tmp_path / "out"))
    (tmp_path / "bad.jsonl").write_text('{"event_id": "x", "ts_ms": 5}\nnot json\n')
    assert files.read_jsonl(spark, str(tmp_path / "out")).count() == 3 and files.read_jsonl(spark, str(tmp_path / "bad.jsonl")).count() == 1


def test_a_leaf_of_many_templates_keeps_unlike_lines_apart(spark):
    from loomlog.operators import loops

    code = lambda i: "".join(chr(97 + int(c)) for c in f"{i:03d}")
    rows = [("s0", f"1 2 3 {code(i)} x{code(i)} y{code(i)} z{code(i)}") for i in range(130)]
    got = loops.mine_templates(spark.createDataFrame(rows, "server_id string, message string"), "server_id", "message").collect()
    assert len(got) == 130 and all(r.n == 1 for r in got)


def test_files_are_pruned_by_their_dates(spark, tmp_path):
    for day in ("2024-01-01", "2024-01-02", "2024-01-05"):
        (tmp_path / f"{day}-1.log.gz").write_bytes(gzip.compress(f"[10:00:00] [main/INFO]: {day}\n  more\n".encode()))
    (tmp_path / "2024-01-09-1.log.gz").write_bytes(b"no archive at all")
    (tmp_path / "notes.txt").write_text("[10:00:00] no log\n")
    ms = lambda d: int(datetime.datetime.fromisoformat(d + "T00:00:00+00:00").timestamp() * 1000)
    got = files.between(spark, str(tmp_path), ms("2024-01-02"), ms("2024-01-03"), ms("2024-02-01")).collect()
    assert sorted(r.line for r in got) == ["  more", "[10:00:00] [main/INFO]: 2024-01-02"]
    assert files.between(spark, str(tmp_path), ms("2030-01-01"), ms("2030-01-02"), 0).count() == 0
    back = files.backfill(spark, str(tmp_path), ms("2024-01-02"), ms("2024-02-01"), 3).collect()
    assert [r.line for r in back] == ["[10:00:00] [main/INFO]: 2024-01-05", "  more", "[10:00:00] [main/INFO]: 2024-01-02"]
    assert [r.path.rsplit("/", 1)[-1][:10] for r in files.candidates(spark, str(tmp_path), datetime.date(2024, 1, 3), 9).collect()] == ["2024-01-09", "2024-01-05", "2024-01-02"]


def test_scans_are_kept_by_file(spark, tmp_path):
    logs, cache = tmp_path / "logs", str(tmp_path / "cache")
    logs.mkdir()
    (logs / "2024-01-01-1.log").write_text("[10:00:00] a\n")
    scan = lambda: sorted(r.line for r in files.cached_scan(spark, str(logs), cache, 0).collect())
    assert scan() == ["[10:00:00] a"] and scan() == ["[10:00:00] a"]
    (logs / "2024-01-01-1.log").write_text("[10:00:00] changed\n")
    (logs / "2024-01-02-1.log").write_text("[10:00:00] b\n")
    assert scan() == ["[10:00:00] b", "[10:00:00] changed"]


def test_store_reads_prune_servers_and_days(spark, tmp_path):
    rows = spark.createDataFrame([("1", "SERVER_LOG", s, T0 + d * 86_400_000) for s in "ab" for d in range(3)], "event_id string, kind string, server_id string, ts_ms long")
    path = str(tmp_path / "store")
    files.store(rows, path, T0 + 3 * 86_400_000)
    got = files.read_store(spark, path, "a", T0, T0 + 1)
    plan = got._jdf.queryExecution().executedPlan().toString()
    pruned = plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert got.count() == 1 and "server_id" in pruned and "day" in pruned and "GreaterThanOrEqual(ts_ms" in plan


def test_evidence_is_located_by_text_then_in_range_then_anywhere(spark):
    issues = spark.createDataFrame([(1, 100, 200, ["x", "y", "none"]), (2, 100, 200, ["z"]), (3, 200, 100, []), (4, 900, 950, None), (5, None, 40, ["-"]), (6, None, None, ["-"]), (7, 100, 150, ["x"])], "issue long, first_ms long, last_ms long, samples array<string>")
    records = spark.createDataFrame([(10, "x", 90), (11, "x", 105), (12, "x", 95), (13, "y", 5000), (14, "-other", 150), (15, "w", 150), (16, None, 890), (17, "q", 910)], "id long, text string, ts_ms long")
    got = sorted(tuple(r) for r in joins.located(issues, records, "issue", "samples", "id", "text", "ts_ms").collect())
    assert got == [(1, 1, 11), (1, 1, 13), (2, 2, 11), (3, 2, 11), (4, 2, 17), (5, 3, 10), (7, 1, 11)]
    assert [tuple(r) for r in joins.located(issues.where("issue = 4"), records.where("id <> 17"), "issue", "samples", "id", "text", "ts_ms").collect()] == [(4, 3, 16)]
    assert joins.located(issues, records.limit(0), "issue", "samples", "id", "text", "ts_ms").count() == 0


def test_a_line_is_judged_once_whatever_its_clock(spark, monkeypatch):
    """Rows that differ in clock, server and player only are one row for the rules; nulls and marks keep rows apart, and no row is lost."""
    said = [("INFO", "<p1> hello there"), ("ERROR", "Backup failed: disk full on /data"), ("INFO", "[Vulcan] p2 failed Speed (Type A) (2/20)"), (None, "Backup failed: disk full on /data"), ("WARN", None)]
    rows = [(10 * i + j, f"[{i:02d}:59:0{i}] [Server thread/{lv}]: {m}" if m else None, m, lv, i == 3) for i in range(9) for j, (lv, m) in enumerate(said)]
    log = spark.createDataFrame(rows, "event_id long, line string, message string, level string, chat_flood boolean")
    seen, judged = [], classify.judged

    def counted(lines):
        seen.append(lines.count())
        return judged(lines)

    monkeypatch.setattr(classify, "judged", counted)
    got = {r.event_id: r for r in classify.classify(log).collect()}
    assert seen == [10] and len(got) == len(rows)
    alone = judged(log.selectExpr("line _line", "message _message", "level _level", "chat_flood _flood", "false _abuse", "false _loop", "event_id"))
    columns = [*classify.PARTS, "category", "gate", "tag", "severity", "evidence", "own_rank"]
    assert all([r[x] for x in columns] == [got[r.event_id][x] for x in columns] for r in alone.collect())
    assert len({r.category for r in got.values()}) > 2


def test_no_rule_reads_a_clock():
    """No word of the rules lies within [dd:dd:dd], which classification sets to zero."""
    words = [w for x in (catalogue.LINE, catalogue.SAID) for kind in (x.tokens, x.parts, x.short_parts) for w in kind]
    assert len(words) > 500 and not [w for w in words if re.fullmatch(r"[\[\]0-9: ]+", w)]


def test_a_timeline_makes_its_rows_once(spark):
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for pdf in batches:
            made.add(len(pdf))
            yield pdf

    rows = spark.createDataFrame([(T0 + i, i, "ERROR" if i % 4 == 0 else "INFO", f"t{i % 2}", "x") for i in range(20)], "ts_ms long, seq long, level string, tag string, line string")
    got = sorted(tuple(r) for r in aggregates.timeline(rows.mapInPandas(run, rows.schema), ["ts_ms", "seq"], 4).collect())
    assert made.value == 20
    assert got[0] == (0, 5, T0, T0 + 4, 2, "t0,t1") and [r[1] for r in got] == [5, 5, 5, 5]


def test_issues_are_shown_by_all_lines_of_their_evidence(spark):
    """An hour of failures, one a minute, whose lines tell times of the inner fifty minutes; no line is left out as a sample."""
    day = 1_700_006_400_000  # midnight
    at = lambda i: min(max(i, 5), 55)
    text = "Failed to load plugin Essentials"
    rows = [(i, i, day + i * 60_000, "s0", "p", "ERROR", text, f"[00:{at(i):02d}:00] [Server thread/ERROR]: {text}") for i in range(61)]
    log = spark.createDataFrame([(*r[:7], r[7]) for r in rows], "event_id long, seq long, ts_ms long, server_id string, player string, level string, message string, line string")
    judged = classify.classify(log)
    found = classify.issues(judged)
    got = classify.shown_spans(judged, found).collect()
    assert [(r.first_ms, r.last_ms) for r in found.collect()] == [(day, day + 3_600_000)]
    assert [(r.first_ms, r.last_ms) for r in got] == [(day + 300_000, day + 3_300_000)]


def test_spans_are_those_of_all_issues():
    """Their SQL reads all issues, with all lines of their evidence."""
    from loomlog.plans.registry import ORACLES

    assert "FROM iss LEFT JOIN tm" in ORACLES["fn_tighten"] and "event_id % 5" not in ORACLES["fn_tighten"]


def test_levels_are_those_of_classified_rows():
    from loomlog.plans.registry import ORACLES

    assert ORACLES["agg_levels"].rstrip().endswith("FROM cls GROUP BY 1")


def test_evidence_that_differs_in_nothing_is_one_row(spark):
    """Ten failures in one slot, of two players, and one in the next slot: three rows that stand for eleven; the issue counts and bounds all of them."""
    day, text = 1_700_006_400_000, "Failed to load plugin Essentials at 1, 2, 3"
    rows = [(i, i, day + i * 1000, "s0", f"p{i % 2}", "ERROR", text, f"[00:00:{i:02d}] [Server thread/ERROR]: {text}") for i in range(10)]
    rows.append((10, 10, day + 400_000 - 100_000, "s0", "p0", "ERROR", text, f"[00:05:00] [Server thread/ERROR]: {text}"))
    log = spark.createDataFrame(rows, "event_id long, seq long, ts_ms long, server_id string, player string, level string, message string, line string")
    judged = classify.classify(log)
    assert sorted((r.n, r.first_ms - day, r.last_ms - day, r.plugin, r.position) for r in classify.alike(judged).collect()) == [(1, 300_000, 300_000, "Essentials", "1, 2, 3"), (5, 0, 8000, "Essentials", "1, 2, 3"), (5, 1000, 9000, "Essentials", "1, 2, 3")]
    assert [(r.n, r.first_ms - day, r.last_ms - day, r.players, r.plugins) for r in classify.issues(judged).collect()] == [(11, 0, 300_000, ["p0", "p1"], ["Essentials"])]


def test_messages_from_a_list_are_those_of_the_cases(spark):
    """Whatever is null or no phrase's number; and the log is made from the list."""
    from loomlog.sources import eventlog as e

    odd = [(i, p, k) for i in [-1, *range(len(e.PHRASES) + 1), None] for p in ("p7", None) for k in (0, -12, None)]
    rows = spark.createDataFrame(odd, "phrase int, player string, k int")
    cases = e.concatenated([x.replace("'", "`") for x in e.PHRASES])
    got = rows.selectExpr("phrase", "player", "k", f"{e.said(e.PHRASES)} AS a", f"replace({cases}, '`', chr(39)) AS b").collect()
    assert len(got) == len(odd) and all(r.a == r.b for r in got) and sum(r.a is not None for r in got) > 150
    assert e.said(e.PHRASES) in e.log_sql(True) and e.concatenated(e.PHRASES) in e.log_sql(False)


def test_log_of_one_row_group_is_dealt_to_all_cores(spark, tmp_path):
    """A file split by its bytes whose rows all lie in one row group isn't one task's work; the log has its rows once each."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from loomlog.sources import eventlog as e

    n = 20_000
    start = datetime.datetime(2024, 1, 1)
    table = pa.table({"event_id": range(n), "ts": [start + datetime.timedelta(seconds=i) for i in range(n)], "user_id": [i % 50 for i in range(n)], "event_type": ["error", "view"] * (n // 2), "value": [0.5] * n, "props": ['{"k": %d}' % (i % 9) for i in range(n)]})
    sizes = {"spark.sql.files.maxPartitionBytes": "20000", "spark.sql.files.openCostInBytes": "0"}
    for groups, dealt in ((1, True), (40, False)):
        (tmp_path / str(groups)).mkdir()
        pq.write_table(table, tmp_path / str(groups) / "events.parquet", row_group_size=n // groups)
        for k, v in sizes.items():
            spark.conf.set(k, v)
        try:
            log = e.log(spark, str(tmp_path / str(groups)))
            per = [r["count"] for r in log.groupBy(F.spark_partition_id()).count().collect()]
            assert sum(per) == n and max(per) <= 1.5 * n / spark.sparkContext.defaultParallelism
            assert log.select("event_id").distinct().count() == n
            assert any("dealt-" in f for f in log.inputFiles()) is dealt
        finally:
            for k in sizes:
                spark.conf.unset(k)
