"""Streams give what the batch operators give on the same rows."""

import random

from pyspark.sql import functions as F

from loomlog.operators import loops, windows
from loomlog.streaming import queries as q

T0 = 1_700_000_000_000
SCHEMA = "server_id string, key string, ts_ms long, event_id long"


def write(spark, path, parts):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/{i:03d}")


def run(spark, path, make, tmp_path, name):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)
    query = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    assert query.awaitTermination(180)
    return spark.table(name)


def parts():
    random.seed(1)
    rows, ts = [], T0
    for i in range(120):
        ts += random.choice([1000, 20_000, 61_000, 301_000])
        rows.append(("s", random.choice("ab"), ts, i))
    end = [("s", "z", ts + 10_000_000, 1000), ("s", "z", ts + 20_000_000, 1001)]
    return [rows[:40], rows[40:80], rows[80:], end[:1], end[1:]], rows


def test_loop_filter_stream_is_batch(spark, tmp_path):
    chunks, rows = parts()
    write(spark, str(tmp_path / "in"), chunks)
    got = run(spark, str(tmp_path / "in"), lambda s: q.suppress(s), tmp_path, "loops").where("key <> 'z'").collect()
    want = loops.suppress(spark.createDataFrame(rows, SCHEMA)).collect()
    show = lambda xs: sorted((r.key, r.ts_ms, r.event_id or -1, r.suppressed) for r in xs)
    assert sum(r.suppressed for r in got) + sum(r.event_id is not None for r in got) == len(rows)
    assert show(got) == show(want)


def test_distinct_minutes_and_sessions(spark, tmp_path):
    chunks, rows = parts()
    write(spark, str(tmp_path / "in"), [*chunks, chunks[0]])
    got = run(spark, str(tmp_path / "in"), lambda s: q.minutes(s, ["key"]), tmp_path, "minutes").where("key <> 'z'")
    batch = spark.createDataFrame(rows, SCHEMA)
    assert got.agg(F.sum("n")).first()[0] == len(rows)
    s = run(spark, str(tmp_path / "in"), lambda s: q.sessions(s, ["key"]), tmp_path, "sessions").where("key <> 'z'").collect()
    want = windows.sessions(batch, ["key"], seq="event_id").groupBy("key", "session").agg(F.count("*").alias("n"), F.min("ts_ms").alias("a")).collect()
    assert sorted((r.key, r.start_ms, r.n) for r in s) == sorted((r.key, r.a, r.n) for r in want)


def test_baseline_stream(spark, tmp_path):
    chunks, rows = parts()
    write(spark, str(tmp_path / "in"), chunks)
    got = run(spark, str(tmp_path / "in"), lambda s: q.baseline(s, ["key"]), tmp_path, "base").where("key <> 'z'").collect()
    want = {(r.key, r.bucket * 60_000): (r.n, round(r.ewma, 6)) for r in windows.history(spark.createDataFrame(rows, SCHEMA), ["key"]).collect()}
    assert got and all(want[r.key, r.minute_ms] == (r.n, round(r.ewma, 6)) for r in got)


def test_alerts_cool_down_after_the_last_one(spark, tmp_path):
    rows = [("bug", "t", T0 + ms, ["a", "b"] if ms else ["a"], True) for ms in (0, 1, 599_999, 600_000, 1_300_000)] + [("bug", "u", T0, ["a"], False)]
    source = str(tmp_path / "issues")
    df = spark.createDataFrame(rows, "category string, tag string, first_ms long, servers array<string>, alert boolean")
    df.coalesce(1).write.parquet(source)
    got = q.run_once(q.alerts(spark.readStream.schema(df.schema).parquet(source)), str(tmp_path / "run")).collect()
    assert sorted((r.server, r.first_ms - T0) for r in got) == [("a", 0), ("a", 600_000), ("a", 1_300_000), ("b", 1), ("b", 1_300_000)]


def test_tail_reads_each_line_once(spark, tmp_path):
    from loomlog.sources.tail import tail

    root, folder = tmp_path / "logs", str(tmp_path / "run")
    root.mkdir()
    log = root / "latest.log"
    read = lambda: sorted(r.line for r in q.run_once(tail(spark, str(root), maxBytes="10"), folder).collect())
    log.write_text("one\ntwo\nunfinished")
    assert read() == ["one", "two"]
    assert read() == ["one", "two"]
    with log.open("a") as f:
        f.write(" line\n" + "long " * 20 + "\r\n\nlast")
    assert read() == ["", "long " * 20, "one", "two", "unfinished line"]
    log.rename(root / "latest.log.1")  # not a .log file any more
    log.write_text("new file that is longer than the one before it was, so its size says nothing " * 3 + "\nsecond\n")
    got = read()
    assert "second" in got and len(got) == 7


def test_tail_from_the_end_sees_new_lines_only(tmp_path):
    from loomlog.sources.tail import TailReader

    log = tmp_path / "a.log"
    log.write_text("old\npart")
    reader = TailReader({"path": str(tmp_path), "start": "end"})
    start = reader.initialOffset()
    with log.open("a") as f:
        f.write("ial\nnew\n")
    end = reader.latestOffset()
    lines = [x for p in reader.partitions(start, end) for b in reader.read(p) for x in b.column("line").to_pylist()]
    assert lines == ["partial", "new"] and reader.partitions(end, end) == []
    again = TailReader({"path": str(tmp_path), "maxbytes": "1"})  # a restarted stream knows no limit at first, so offsets don't go back
    assert again.latestOffset() == end
