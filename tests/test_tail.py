"""Tailing: each line once, whatever happens to the files."""

import gzip
import random

import pytest

from loomlog.sources.tail import TailReader
from loomlog.streaming import queries as q


class Poll:
    """A stream's view of a folder, batch by batch."""

    def __init__(self, root, restart=False, **options):
        self.options, self.restart = {"path": str(root), **{k.lower(): str(v) for k, v in options.items()}}, restart
        self.reader = TailReader(self.options)
        self.at = self.reader.initialOffset()

    def __call__(self):
        if self.restart:
            self.reader = TailReader(self.options)
        end = self.reader.latestOffset()
        parts = self.reader.partitions(self.at, end)
        self.at = end
        return [x for p in parts for b in self.reader.read(p) for x in b.column("line").to_pylist()]

    def all(self):
        got = []
        while more := self():
            got += more
        return got


def zipped(path, text):
    path.write_bytes(gzip.compress(text.encode()))


@pytest.fixture(params=[False, True])
def poll(request, tmp_path):
    root = tmp_path / "logs"
    root.mkdir()
    return root, lambda **options: Poll(root, request.param, state=tmp_path / "state", **options)


def test_gzipped_rotation_loses_nothing(poll):
    root, make = poll
    log, read = root / "latest.log", make()
    log.write_text("".join(f"line {i}\n" for i in range(5)))
    assert read() == [f"line {i}" for i in range(5)]
    zipped(root / "2024-01-01-1.log.gz", "".join(f"line {i}\n" for i in range(8)) + "line 8")  # no line feed behind the last
    log.write_text("line 9\n")
    assert sorted(read()) == [f"line {i}" for i in range(5, 10)]
    assert read() == []


def test_renamed_then_gzipped(poll):
    root, make = poll
    log, read = root / "latest.log", make()
    log.write_text("a\nb\nunfinis")
    assert read() == ["a", "b"]
    log.write_text("a\nb\nunfinished\nc\nend")
    log.rename(root / "2024-01-01-1.log")
    log.write_text("a\nB\nunfinished, but another one that is longer\n")  # begins with the same line
    assert sorted(read()) == ["B", "a", "c", "end", "unfinished", "unfinished, but another one that is longer"]
    zipped(root / "2024-01-01-1.log.gz", (root / "2024-01-01-1.log").read_text())
    assert read() == []  # both are there while gzip works
    (root / "2024-01-01-1.log").unlink()
    assert read() == []
    with log.open("a") as f:
        f.write("more\n")
    assert read() == ["more"]


def test_archive_turns_up_after_the_file_that_took_its_name(poll):
    root, make = poll
    log, read = root / "latest.log", make()
    log.write_text("one\ntwo\n")
    assert read() == ["one", "two"]
    log.write_text("new\n")
    (root / "old.log.gz").write_bytes(gzip.compress(b"one\ntwo\nthree\nfour")[:-6])  # still being written
    assert read() == ["new"]
    assert read() == []
    zipped(root / "old.log.gz", "one\ntwo\nthree\nfour")
    assert read() == ["three", "four"]
    assert read() == []


def test_truncated_in_place_and_rotated_twice_between_polls(poll):
    root, make = poll
    log, read = root / "latest.log", make()
    log.write_text("one\ntwo\n")
    assert read() == ["one", "two"]
    log.write_text("x\n")
    assert read() == ["x"]
    zipped(root / "1.log.gz", "x\ny\n")
    zipped(root / "2.log.gz", "never seen\n")
    log.write_text("z\n")
    assert sorted(read()) == ["never seen", "y", "z"]


def test_limits_hold_in_renamed_files_too(tmp_path):
    root = tmp_path / "logs"
    root.mkdir()
    log, read = root / "latest.log", Poll(root, maxBytes=30)
    text = "".join(f"line number {i}\n" for i in range(20)) + "the last line, longer than the limit is"
    log.write_text(text[:50])
    got = read()
    assert got == ["line number 0", "line number 1"]
    log.write_text(text)
    log.rename(root / "old.log")
    while more := read():
        assert sum(map(len, more)) <= 60
        got += more
    assert got == text.split("\n")


def test_files_of_many_servers_that_begin_alike(poll):
    root, make = poll
    read = make()
    banner = "".join(f"banner {i} " + "x" * 100 + "\n" for i in range(100))
    for s in "ab":
        (root / s).mkdir()
        (root / s / "latest.log").write_text(banner + f"server {s}\n")
    assert len(read()) == 202
    for s in "ab":
        zipped(root / s / "1.log.gz", banner + f"server {s}\nlast of {s}\n")
        (root / s / "latest.log").write_text(banner[:3000].rpartition("\n")[0] + "\n")
    got = read()
    assert sorted(x for x in got if "banner" not in x) == ["last of a", "last of b"] and len(got) == 2 + 2 * (3000 // 110)


def test_start_at_the_end_leaves_archives_alone(tmp_path):
    (tmp_path / "a.log").write_text("old\npart")
    zipped(tmp_path / "1.log.gz", "older\n")
    read = Poll(tmp_path, start="end")
    with (tmp_path / "a.log").open("a") as f:
        f.write("ial\nnew\n")
    assert read() == ["partial", "new"]


@pytest.mark.parametrize("seed", range(12))
def test_any_sequence_of_writes_and_rotations(poll, seed):
    """Lines come once each, in any mix of appends, cuts within a line, renames, gzip and polls."""
    root, make = poll
    rng, read, log = random.Random(seed), make(maxBytes=1 << 30), root / "latest.log"
    sent, got, text, n, there = [], [], "", 0, 0
    for step in range(40):
        for _ in range(rng.randint(0, 4)):
            text += f"{'same start ' * rng.randint(0, 2)}{'é' * rng.randint(0, 3)} {n}\n"
            sent.append(text.split("\n")[-2])
            n += 1
        there = max(there, len(text) - (rng.randint(0, 5) if rng.random() < 0.5 else 0))
        log.write_text(text[:there])
        if rng.random() < 0.5:
            got += read()
        if rng.random() < 0.25 and text:
            renamed = rng.random() < 0.5
            seen = renamed and "\n" in log.read_text() and (got.extend(read()) or True)
            # nothing tells a renamed file of which nothing was read from a new one, so its last line is whole
            log.write_text(text.rstrip("\n") if there < len(text) and (seen or not renamed) else text)
            to = root / f"old-{step}.log"
            if renamed:
                log.rename(to)
                if rng.random() < 0.3:
                    got += read()
                    zipped(root / f"old-{step}.log.gz", to.read_text())
                    to.unlink()
            else:
                zipped(root / f"old-{step}.log.gz", log.read_text())
            log.write_text("")
            text, there = "", 0
    log.write_text(text)
    got += read() + read()
    assert sorted(got) == sorted(sent)


def test_ingest_over_rotations_of_several_servers(spark, tmp_path):
    root, folder = tmp_path / "logs", str(tmp_path / "run")
    for s in ("s0", "s1"):
        (root / s).mkdir(parents=True)
        (root / s / "latest.log").write_text(f"2024-01-01 10:00:00 start of {s}\n2024-01-01 10:00:01 next")
    read = lambda: sorted((r.server_id, r.line[20:]) for r in q.ingest(spark, str(root), folder, 1_704_499_200_000, maxBytes=str(1 << 30)).collect())
    assert read() == [("s0", "start of s0"), ("s1", "start of s1")]
    (root / "s0" / "latest.log").rename(root / "s0" / "2024-01-01-1.log")
    zipped(root / "s1" / "2024-01-01-1.log.gz", (root / "s1" / "latest.log").read_text() + " one")
    for s in ("s0", "s1"):
        (root / s / "latest.log").write_text("2024-01-02 00:00:00 new day\n")
    want = [("s0", "new day"), ("s0", "next"), ("s0", "start of s0"), ("s1", "new day"), ("s1", "next one"), ("s1", "start of s1")]
    assert read() == want and read() == want
