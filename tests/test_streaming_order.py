"""Streams over shuffled micro-batches give what batches give, and what hand-written rules say."""

import random

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from loomlog.operators import loops, windows
from loomlog.streaming import queries as q

T0 = 1_700_000_040_000  # a whole minute
SCHEMA = "server_id string, key string, ts_ms long, event_id long, message string"


def log(seed=1, n=400):
    rng, rows, ts = random.Random(seed), [], T0
    for i in range(n):
        ts += rng.choice([0, 500, 1000, 3000, 20_000, 61_000, 301_000])
        rows.append((rng.choice(["s", "t"]), rng.choice("abbbc"), ts, i, f"user u{i % 7} {rng.choice(['did', 'saw', 'lost'])} {rng.choice(['a b', 'c d', 'x y'])} {i}"))
    return rows


def stream(spark, tmp_path, make, rows, slice_ms=900_000, jitter=300_000):
    """make(stream of rows that come up to `jitter` late, in slices) as a table, all of it brought out by two far later rows."""
    df = spark.createDataFrame(rows, SCHEMA)
    end = spark.createDataFrame([("end", "z", T0 + 10**9 * (i + 1), 10_000 + i, "end", i) for i in range(2)], SCHEMA + ", slice long")
    arrival = F.col("ts_ms") + F.pmod(F.xxhash64("event_id"), F.lit(jitter))
    source = q.arriving(df, arrival, str(tmp_path / "in"), slice_ms, end)
    return df, q.run_once(make(source), str(tmp_path / "run"))


def show(rows, *columns):
    return sorted(tuple(round(r[c], 6) if isinstance(r[c], float) else -1 if r[c] is None else r[c] for c in columns) for r in rows)


def test_anomalies(spark, tmp_path):
    df, got = stream(spark, tmp_path, lambda s: q.anomalies(s, template="key"), log())
    want = windows.anomalies(df, ["server_id", "key"], ["ts_ms", "event_id"]).collect()
    columns = ["server_id", "key", "ts_ms", "event_id", "in_bucket", "total", "ewma", "p95", "score", "reason", "is_anomaly"]
    assert show(got.where("server_id <> 'end'").collect(), *columns) == show(want, *columns)
    assert any(r.is_anomaly for r in want) or any(r.score for r in want)


def test_a_minute_is_closed_once(spark, tmp_path):
    """Minutes 5, 4, 5: one row each."""
    rows = [("s", "a", T0 + m * 60_000 + i, i, "") for i, m in enumerate([5, 5, 5, 4, 4, 5, 5])]
    _, got = stream(spark, tmp_path, lambda s: q.baseline(s, ["server_id", "key"]), rows, slice_ms=1_000, jitter=90_000)
    assert show(got.where("server_id <> 'end'").collect(), "minute_ms", "n") == [(T0 + 240_000, 2), (T0 + 300_000, 5)]


def test_baselines(spark, tmp_path):
    df, got = stream(spark, tmp_path, lambda s: q.baseline(s, ["key"]), log(2))
    want = {(r.key, r.bucket * 60_000): (r.n, round(r.ewma, 6)) for r in windows.history(df, ["key"]).collect()}
    assert {(r.key, r.minute_ms): (r.n, round(r.ewma, 6)) for r in got.where("key <> 'z'").collect()} == want


def test_loop_filter(spark, tmp_path):
    df, got = stream(spark, tmp_path, q.suppress, log(3))
    want = loops.suppress(df).collect()
    assert show(got.where("server_id <> 'end'").collect(), "server_id", "key", "ts_ms", "event_id", "suppressed") == show(want, "server_id", "key", "ts_ms", "event_id", "suppressed")


def test_first_of_slot(spark, tmp_path):
    rows = log(4)
    _, got = stream(spark, tmp_path, lambda s: q.first_of_slot(s, ["server_id", "key"], "2 minutes", ["ts_ms", "event_id"]), rows)
    first = {}
    for s, k, ts, e, _ in sorted(rows, key=lambda r: r[2:4]):
        first.setdefault((s, k, ts // 120_000), (s, k, ts, e))
    assert show(got.where("server_id <> 'end'").collect(), "server_id", "key", "ts_ms", "event_id") == sorted(first.values())


def brute_templates(rows):
    """Each row against all templates of its leaf, token by token."""
    found, out = {}, []
    for server, _, ts, e, message in sorted(rows, key=lambda r: r[2:4]):
        tokens = ["<*>" if any(c.isdigit() for c in w) else w for w in message.split()]
        leaf = found.setdefault((server, len(tokens), tuple(tokens[:3])), [])
        scores = [sum(a == b != "<*>" for a, b in zip(tokens, t, strict=True)) for t, _ in leaf]
        best = max(range(len(leaf)), key=lambda i: (scores[i], -i), default=None)
        new = best is None or scores[best] < 0.4 * len(tokens)
        if new:
            best = len(leaf)
            leaf.append([tokens, 0])
        else:
            leaf[best][0] = [a if a == b else "<*>" for a, b in zip(tokens, leaf[best][0], strict=True)]
        leaf[best][1] += 1
        out.append((server, ts, e, best, " ".join(leaf[best][0]), leaf[best][1], new))
    return sorted(out)


def test_templates(spark, tmp_path):
    """In any batching: each row's template, its size, and whether it was new."""
    rng = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "x1", "y2", "zeta"]
    rows = [(s, k, ts, e, " ".join(["job", rng.choice("ab"), "did"] + [rng.choice(words) for _ in range(rng.choice([3, 5]))])) for s, k, ts, e, _ in log(5)]
    want = brute_templates(rows)
    assert sum(r[-1] for r in want) > 20 and max(r[-2] for r in want) > 5
    df, got = stream(spark, tmp_path, q.templates, rows, slice_ms=1_200_000)
    columns = ["namespace", "ts_ms", "event_id", "template_no", "template", "size", "is_new"]
    assert show(got.where("namespace <> 'end'").collect(), *columns) == want
    assert show(loops.templates(df, "server_id", "message").collect(), *columns) == want


def test_namespaces_beyond_those_known_share_one_tree(spark):
    df = spark.createDataFrame([(s, "k", T0 + i, i, "same words here") for i, s in enumerate("abcab")] + [(None, "k", T0 + 9, 9, None)], SCHEMA)
    got = loops.templates(df, "server_id", "message", namespaces=["a"]).collect()
    assert show(got, "namespace", "event_id", "size") == [("a", 0, 1), ("a", 3, 2), ("default", 1, 1), ("default", 2, 2), ("default", 4, 3), ("default", 9, 1)]


def test_leaf_with_many_templates_is_searched_as_a_scan_would():
    rng = random.Random(1)
    leaf, slow = loops.Leaf(), []
    for _ in range(600):
        tokens = [rng.choice("abcdefghijklmnop") for _ in range(6)]
        scores = [sum(a == b != "<*>" for a, b in zip(tokens, t, strict=True)) for t in slow]
        best = max(range(len(slow)), key=lambda i: (scores[i], -i), default=None)
        new = best is None or scores[best] < 2.4
        if new:
            best = len(slow)
            slow.append(tokens)
        else:
            slow[best] = [a if a == b else "<*>" for a, b in zip(tokens, slow[best], strict=True)]
        assert leaf.add(tokens)[:2] == (best, " ".join(slow[best]))
        if rng.random() < 0.05:
            leaf = loops.Leaf(leaf.dump())  # state goes out and comes back
    assert len(slow) > 50


def test_oldest_template_is_forgotten_and_so_is_one_not_seen_for_a_day():
    own = q.Baselines(None, most=2, ttl_ms=1000)
    feed = lambda ts, name: own.feed(ts, 0, name)[0][4]  # noqa: E731 total
    assert [feed(0, "a"), feed(1, "b"), feed(2, "a"), feed(3, "c"), feed(4, "a"), feed(5, "b")] == [1, 1, 2, 1, 3, 1]
    assert feed(1004, "a") == 4 and feed(2005, "a") == 1
    own = q.Baselines(own.dump(), most=2, ttl_ms=1000)
    assert feed(2006, "a") == 2 and own.due() == 1005 and own.expire(1005) == [] and own.due() == 3006


def test_late_rows_are_set_apart(spark, tmp_path):
    times = [0, 1000, 700_000, 650_000, 99_999, 100_001, None, 2_000_000, 1_500_000, 1_399_999]  # two a micro-batch
    rows = [("s", "k", None if ms is None else T0 + ms, i, "") for i, ms in enumerate(times)]
    df = spark.createDataFrame(rows, SCHEMA)
    source = q.arriving(df, F.floor(F.col("event_id") / 2), str(tmp_path / "in"), 1)
    kept, late = q.late_apart(source, str(tmp_path / "run"))
    assert sorted(r.event_id for r in late.collect()) == [4, 9]
    assert sorted(r.event_id for r in kept.union(late).collect()) == list(range(10))


def test_slices_are_joined_to_few_micro_batches(spark, tmp_path):
    assert q.joined([(0, 10), (1, 1), (2, 1), (3, 1), (9, 50), (11, 1)], 4) == [0, 9, 11] and q.joined([], 4) == []
    df = spark.createDataFrame([("s", "k", T0 + i * 1000, i, "") for i in range(300)], SCHEMA)
    source = q.arriving(df, F.col("ts_ms"), str(tmp_path / "in"), 1000, most=4)
    assert 4 <= len(list((tmp_path / "in").glob("slice=*"))) <= 8
    assert sorted(r.event_id for r in q.run_once(source, str(tmp_path / "run")).collect()) == list(range(300))


def test_micro_batches_are_written_by_a_task_each_and_read_by_several(spark, tmp_path):
    """Six slices of more than 1 MB: six tasks wrote them, and each has several row groups, which tasks share."""
    df = spark.range(60_000).select(F.lit("s").alias("server_id"), F.lit("k").alias("key"), (T0 + F.col("id")).alias("ts_ms"), F.col("id").alias("event_id"), F.sha2(F.col("id").cast("string"), 512).alias("message"))
    source = q.arriving(df, F.col("ts_ms"), str(tmp_path / "in"), 10_000, most=6)
    files = sorted((tmp_path / "in").glob("slice=*/*.parquet"))
    assert len(files) == len({f.name.split("-")[1] for f in files}) >= 6
    assert min(pq.ParquetFile(f).num_row_groups for f in files if f.stat().st_size > 1_300_000) > 1
    assert q.run_once(source.select("event_id"), str(tmp_path / "run")).distinct().count() == 60_000


def test_late_rows_go_by_steps_however_many_a_micro_batch_holds(spark, tmp_path):
    times = [0, 1000, 700_000, 650_000, 99_999, 100_001, None, 2_000_000, 1_500_000, 1_399_999]  # two a step
    for most in (1, 2):
        df = spark.createDataFrame([("s", "k", None if ms is None else T0 + ms, i, "") for i, ms in enumerate(times)], SCHEMA).withColumn("step", F.floor(F.col("event_id") / 2))
        source = q.arriving(df, F.col("step"), str(tmp_path / f"in{most}"), 1, most=most)
        kept, late = q.late_apart(source, str(tmp_path / f"run{most}"), step="step")
        assert sorted(r.event_id for r in late.collect()) == [4, 9]
        assert sorted(r.event_id for r in kept.union(late).collect()) == list(range(10))


def test_state_is_dealt_in_as_many_parts_as_asked_for(spark, tmp_path):
    """Two keys of state, and the session's four partitions: two tasks a micro-batch, the same rows, and the setting as it was."""
    df = spark.createDataFrame(log(3), SCHEMA)
    end = spark.createDataFrame([("end", "z", T0 + 10**9 * (i + 1), 10_000 + i, "end", i) for i in range(2)], SCHEMA + ", slice long")
    source = q.arriving(df, F.col("ts_ms"), str(tmp_path / "in"), 900_000, end, 8)
    got = q.run_once(q.suppress(source), str(tmp_path / "run"), parts=2).where("server_id <> 'end'").collect()
    columns = ["server_id", "key", "ts_ms", "event_id", "suppressed"]
    assert show(got, *columns) == show(loops.suppress(df).collect(), *columns)
    assert sorted(x.name for x in (tmp_path / "run/checkpoint/state/0").iterdir() if x.name.isdigit()) == ["0", "1"]
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"


def test_loop_filter_holds_candidates_and_passes_all_others(spark, tmp_path):
    """By level or by words, whatever the level; other rows, and those of neither, come out one by one."""
    said = [("INFO", "Connection Timed out"), ("INFO", "hello"), ("WARNING", "hello"), (None, "备份失败"), ("fatal", None), (None, None)]
    rows = [("s", "k" + str(i), T0 + j * 1000, i * 10 + j, text, level) for i, (level, text) in enumerate(said) for j in range(3)]
    df = spark.createDataFrame(rows, SCHEMA + ", level string")
    end = spark.createDataFrame([("end", "z", T0 + 10**9 * (i + 1), 10_000 + i, "error", "ERROR", i) for i in range(2)], SCHEMA + ", level string, slice long")
    source = q.arriving(df, F.col("ts_ms"), str(tmp_path / "in"), 900_000, end)
    got = q.run_once(q.loop_filter(source), str(tmp_path / "run")).where("server_id <> 'end'").collect()
    held = [(f"k{i}", T0 + (0 if n == 0 else 2000), i * 10 if n == 0 else -1, n) for i in (0, 2, 3, 4) for n in (0, 2)]
    passed = [(f"k{i}", T0 + j * 1000, i * 10 + j, 0) for i in (1, 5) for j in range(3)]
    assert show(got, "key", "ts_ms", "event_id", "suppressed") == sorted(held + passed)


def test_loop_filter_reads_all_of_the_log(spark):
    """What comes out and what it stands for make up all rows of the table."""
    from conftest import SF
    from loomlog.plans.registry import ORACLES, QUERIES

    got = QUERIES["st_loop_filter"](spark, SF).agg(F.sum("suppressed") + F.count_if(F.col("event_id") >= 0)).first()[0]
    assert got == spark.read.parquet(f"{SF}/events.parquet").count()
    assert "level IN ('WARN', 'ERROR')" not in ORACLES["st_loop_filter"] and "level IN ('WARN', 'ERROR')" in ORACLES["st_drain"]
