"""Tailing of growing log files as a streaming source: format("log_tail").

A file is known by what stands before its offset: digests of its first bytes and of those just
before the offset, not by its name. So a file goes on under a new name, and gzipped under
`.gz`, from where it was read; a name whose file got shorter or begins otherwise has a new
file, read from its start. A file that was moved away isn't written any more, nor is a gzipped
one: their last line counts without a line feed. In a file that is still written, a line
without one waits. An identity whose file is gone is kept until a file that goes on with it
turns up, so an archive may appear later than the file that took its name.

Options: path (a folder of any file system that pyarrow knows), suffix (.log; its gzipped form
is read too), start (end: only what is written from now on; else all), maxBytes (of one file
in one batch; a gzipped file is read in one), state (a folder where a restarted stream finds
what it last saw; without it the last line of a file that is renamed while the stream is
stopped waits for a line feed).
"""

from __future__ import annotations

import hashlib
import io
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes read at a time, bytes of a digest, and the most that one file gives a batch (fixed value: the poll limit of a source).
STEP, HEAD, MOST = 1 << 20, 4096, 256 << 10
#: Gzipped bytes taken at a time.
ZIPPED = 64 << 10
#: Mark of an identity whose file is gone or has another name; paths hold no such character.
GONE = "\x00"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def digest(data: bytes) -> str:
    return hashlib.blake2b(data, digest_size=8).hexdigest()


class Stretch(InputPartition):
    """Bytes [start, stop) of a file; whole lines, but for the last of a file that isn't written any more."""

    def __init__(self, path: str, start: int, stop: int):
        super().__init__(None)
        self.path, self.start, self.stop = path, start, stop


def unzipped(f) -> Iterator[bytes]:
    """The content of a gzip stream in blocks; EOFError where it isn't whole (yet)."""
    inner, data = zlib.decompressobj(31), b""
    while True:
        data = data or f.read(ZIPPED)
        if not data:
            if inner is None:
                return
            raise EOFError
        inner = inner or zlib.decompressobj(31)
        try:
            yield inner.decompress(data)
        except zlib.error as e:
            raise EOFError from e
        data = b""
        if inner.eof:
            data, inner = inner.unused_data, None


def blocks(system: fs.FileSystem, path: str, start: int, stop: int | None) -> Iterator[bytes]:
    """The content of a file from start to stop (None: its end), gunzipped, in blocks of STEP or so."""
    if not path.endswith(".gz"):
        with system.open_input_file(path) as f:
            end = f.size() if stop is None else stop
            while start < end:
                data = f.read_at(min(STEP, end - start), start)
                if not data:
                    return
                yield data
                start += len(data)
        return
    at = 0
    with system.open_input_stream(path, compression=None) as f:
        for data in unzipped(f):
            low, high = max(start - at, 0), len(data) if stop is None else min(len(data), stop - at)
            if high > low:
                yield data[low:high]
            at += len(data)
            if stop is not None and at >= stop:
                return


class Entry:
    """What is known of a file: where reading stopped, what stands before, its size as it lies there, and whether it is still written."""

    def __init__(self, stop: int, head: str, seam: str, raw: int, closed: bool):
        self.stop, self.head, self.seam, self.raw, self.closed = stop, head, seam, raw, closed

    def dump(self) -> list:
        return [self.stop, self.head, self.seam, self.raw, self.closed]

    def same_place(self, other: Entry) -> bool:
        return (self.stop, self.head, self.seam) == (other.stop, other.head, other.seam)


class Folder:
    """The log files below a folder."""

    def __init__(self, root: str, suffix: str):
        self.root, self.suffix = root, suffix
        self.system, self.at = opened(root)

    def sizes(self) -> dict[str, int]:
        found = self.system.get_file_info(fs.FileSelector(self.at, recursive=True, allow_not_found=True))
        return {f.path: f.size for f in found if f.type == fs.FileType.File and f.path.endswith((self.suffix, self.suffix + ".gz"))}

    def entry(self, path: str, stop: int | None, raw: int, closed: bool) -> Entry:
        """The identity of a file at a place (None: its end)."""
        if path.endswith(".gz"):
            head, seam, size = b"", b"", 0
            for data in blocks(self.system, path, 0, stop):
                head, seam, size = (head + data)[:HEAD] if len(head) < HEAD else head, (seam + data)[-HEAD:], size + len(data)
            return Entry(size, digest(head), digest(seam), raw, closed)
        stop = raw if stop is None else stop
        head = b"".join(blocks(self.system, path, 0, min(HEAD, stop)))
        seam = b"".join(blocks(self.system, path, max(0, stop - HEAD), stop))
        return Entry(stop, digest(head), digest(seam), raw, closed)

    def goes_on(self, path: str, raw: int, before: Entry) -> bool:
        """Whether a file begins with all that was read of another one."""
        if before.stop == 0 or (not path.endswith(".gz") and raw < before.stop):
            return False
        try:
            return self.entry(path, before.stop, raw, False).same_place(before)
        except EOFError:
            return False

    def look(self, known: dict[str, Entry]) -> dict[str, int]:
        """Sizes of all files; `stays` says which of the known ones still are what they were."""
        self.now = self.sizes()
        self.stays = {}
        for key, e in known.items():
            raw = self.now.get(key)
            unchanged = e.stop == 0 or (e.closed and raw == e.raw)
            self.stays[key] = raw is not None and (unchanged or self.goes_on(key, raw, e))
        return self.now

    def begins(self, path: str, raw: int, known: dict[str, Entry]) -> tuple[int, str | None]:
        """(where to go on reading a file, the key of the identity that it continues).

        Its own, if it still is what it was; else one whose file is gone, or an archive of the
        same folder that it is a copy of.
        """
        if self.stays.get(path):
            return known[path].stop, path
        near = path.rpartition("/")[0]
        others = [(e.stop, key) for key, e in known.items() if key != path and (not self.stays[key] or (e.closed and key.rpartition("/")[0] == near))]
        return max(((stop, key) for stop, key in others if self.goes_on(path, raw, known[key])), default=(0, None))

    def line_end(self, path: str, start: int, stop: int) -> int:
        """Behind the last line feed of [start, stop); start if there is none."""
        with self.system.open_input_file(path) as f:
            while stop > start:
                low = max(start, stop - STEP)
                at = f.read_at(stop - low, low).rfind(b"\n")
                if at >= 0:
                    return low + at + 1
                stop = low
        return start


class TailReader(DataSourceStreamReader):
    """What is new in the files of a folder. Listing, digests and the search for the last line feed run on the driver, reading on executors."""

    def __init__(self, options: dict[str, str]):
        self.folder = Folder(options["path"], options.get("suffix", ".log"))
        self.most, self.from_end = int(options.get("maxbytes", MOST)), options.get("start") == "end"
        self.state = options.get("state")
        self.known: dict[str, Entry] = self._remembered()
        self.fresh = False  # whether known is all there is: a restarted stream may have read more

    def _remembered(self) -> dict[str, Entry]:
        if not self.state:
            return {}
        system, at = opened(self.state)
        if system.get_file_info(f"{at}/seen.json").type != fs.FileType.File:
            return {}
        with system.open_input_stream(f"{at}/seen.json") as f:
            return {k: Entry(*e) for k, e in json.loads(f.read()).items()}

    def _remember(self) -> None:
        if self.state:
            system, at = opened(self.state)
            system.create_dir(at, recursive=True)
            with system.open_output_stream(f"{at}/seen.json") as f:
                f.write(json.dumps({k: e.dump() for k, e in self.known.items()}).encode())

    def _dump(self) -> dict:
        return {k: e.dump() for k, e in self.known.items()}

    def initialOffset(self) -> dict:
        self.fresh, self.known = True, {}
        if self.from_end:
            for path, raw in self.folder.look({}).items():
                zipped = path.endswith(".gz")
                try:
                    self.known[path] = self.folder.entry(path, None if zipped else self.folder.line_end(path, 0, raw), raw, zipped)
                except EOFError:
                    continue
        return self._dump()

    def latestOffset(self) -> dict:
        now, known = {}, self.known
        claimed = set()
        for path, raw in sorted(self.folder.look(known).items()):
            before = known.get(path)
            if before is not None and before.closed and before.raw == raw:
                if path.endswith(".gz") or before.stop == raw:
                    now[path] = before
                    claimed.add(path)
                    continue
            try:
                start, key = self.folder.begins(path, raw, known)
                closed = path.endswith(".gz") or (key is not None and (key != path or known[key].closed))
                now[path] = self.folder.entry(path, self._stop(path, start, raw, closed), raw, closed)
                claimed.add(key)
            except EOFError:  # a gzip file that is still written
                continue
        for key, entry in known.items():  # whose files have gone on elsewhere, or nowhere yet
            if key not in claimed and entry.stop:
                now[key if GONE in key else f"{key}{GONE}{entry.head}{entry.stop}"] = entry
        self.known, self.fresh = now, True
        self._remember()
        return self._dump()

    def _stop(self, path: str, start: int, raw: int, closed: bool) -> int | None:
        if path.endswith(".gz"):
            return None
        if closed and (not self.fresh or raw - start <= self.most):
            return raw
        stop = self.folder.line_end(path, start, min(raw, start + self.most) if self.fresh else raw)
        if stop == start and raw > start + self.most:  # a line longer than the limit is taken whole
            stop = self.folder.line_end(path, start, raw)
            stop = raw if closed and stop == start else stop
        return stop

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        before, out = {k: Entry(*e) for k, e in start.items()}, []
        self.folder.look(before)
        for path, values in sorted(end.items()):
            to = Entry(*values)
            if GONE in path or (path in before and before[path].same_place(to)):
                continue
            begin = self.folder.begins(path, to.raw, before)[0]
            if to.stop > begin:
                out.append(Stretch(path, begin, to.stop))
        return out

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.folder.root)

        def made(lines: list[bytes], at: int) -> pa.RecordBatch:
            places = []
            for line in lines:
                places.append(at)
                at += len(line) + 1
            text = [x.decode("utf-8", "replace").rstrip("\r") for x in lines]
            return pa.RecordBatch.from_pydict({"path": [partition.path] * len(text), "offset": places, "line": text}, schema=SCHEMA)

        at, rest = partition.start, io.BytesIO()
        for data in blocks(system, partition.path, partition.start, partition.stop):
            cut = data.rfind(b"\n")
            if cut < 0:
                rest.write(data)
                continue
            whole = rest.getvalue() + data[:cut]
            yield made(whole.split(b"\n"), at)
            at, rest = at + len(whole) + 1, io.BytesIO()
            rest.write(data[cut + 1 :])
        if rest.getvalue():
            yield made([rest.getvalue()], at)

    def commit(self, end: dict) -> None:
        """Nothing to do: offsets are in the checkpoint."""


SCHEMA = pa.schema({"path": pa.string(), "offset": pa.int64(), "line": pa.string()})


class LogTail(DataSource):
    """path, offset (of the line's first byte), line."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "path string, offset long, line string"

    def streamReader(self, schema) -> TailReader:
        return TailReader({k.lower(): v for k, v in self.options.items()})


def tail(spark: SparkSession, path: str, **options: str):
    """A streaming DataFrame of the lines that are appended to the files of a folder."""
    spark.dataSource.register(LogTail)
    reader = spark.readStream.format("log_tail").option("path", path)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()
