"""A streaming source that follows all growing meter files of a folder.

    spark.dataSource.register(MeterTails)
    spark.readStream.format("meter_tails").option("path", "/data/live").option("state", "/data/live-state").load()

Each file has its own offset and its own task, which reads and parses on an executor; the driver looks at sizes and at the
ends of what grew only. A half-written last line waits for its end. A header in mid-file sets the columns anew: the
task that meets it leaves a mark in the state folder, which the tasks of later micro-batches look up. A file that became
shorter is a new session, read from its start. New files are read from their start; of those that are there
at the beginning, startingOffset latest (default) skips what they hold, earliest reads it. maxBytesPerFile bounds what a
micro-batch takes of each. The state folder is one for each stream and shared by all executors; after a restart the
next micro-batch may take twice as much.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..schema import MEASURES, METER_COLUMNS
from .replay import _store
from .tail import MOST_BYTES, TAIL_SCHEMA, moment, number, parse_lines

#: Bytes that are looked at for the end of a line at a time.
LOOK = 1 << 16


class Growth(InputPartition):
    """Whole lines of one file: bytes [start, end) of a session."""

    def __init__(self, file: str, session: int, start: int, end: int):
        self.file, self.session, self.start, self.end = file, session, start, end


def _bytes(store, file: str, start: int, end: int) -> bytes:
    with store.open_input_file(file) as f:
        f.seek(start)
        return f.read(end - start)


def _line_end(store, file: str, low: int, high: int, size: int) -> int:
    """The byte after the last whole line of [low, high), or of a single longer line that goes on; low if there is none."""
    at = high
    while at > low:
        begin = max(low, at - LOOK)
        found = _bytes(store, file, begin, at).rfind(b"\n")
        if found >= 0:
            return begin + found + 1
        at = begin
    while high < size:  # a line longer than what was asked for
        found = _bytes(store, file, high, min(size, high + LOOK)).find(b"\n")
        if found >= 0:
            return high + found + 1
        high += LOOK
    return low


class TailsReader(DataSourceStreamReader):
    def __init__(self, options):
        get = lambda name, default=None: options.get(name.lower(), options.get(name, default))
        self.path, self.state = get("path").rstrip("/"), get("state", "").rstrip("/")
        if not self.state:
            raise ValueError("option state, a folder of the stream's own, is needed")
        self.most = int(get("maxBytesPerFile", MOST_BYTES))
        known = self._committed()
        self.twice = known is not None
        sizes = self._sizes()
        skip = get("startingOffset", "latest") != "earliest"
        self.at = known if known is not None else {f: {"pos": self._whole(f, n) if skip else 0, "session": 0} for f, n in sizes.items()}
        self.begin = json.loads(json.dumps(self.at))

    def _sizes(self) -> dict[str, int]:
        from pyarrow import fs

        store, base = _store(self.path)
        files = store.get_file_info(fs.FileSelector(base, allow_not_found=True))
        return {f.base_name: f.size for f in files if f.type == fs.FileType.File and f.base_name.endswith(".csv")}

    def _whole(self, name: str, size: int) -> int:
        store, base = _store(self.path)
        return _line_end(store, f"{base}/{name}", 0, size, size)

    def _committed(self) -> dict | None:
        from pyarrow import fs

        store, base = _store(self.state)
        file = f"{base}/offset.json"
        return json.loads(store.open_input_file(file).read()) if store.get_file_info(file).type == fs.FileType.File else None

    def initialOffset(self) -> dict:
        return {"files": self.begin}

    def latestOffset(self) -> dict:
        store, base = _store(self.path)
        most = self.most * (2 if self.twice else 1)
        self.twice = False
        now = dict(self.at)
        for name, size in self._sizes().items():
            was = now.get(name, {"pos": 0, "session": 0})
            if size < was["pos"]:
                was = {"pos": 0, "session": was["session"] + 1}
            high = min(size, was["pos"] + most)
            end = _line_end(store, f"{base}/{name}", was["pos"], high, size) if high > was["pos"] else was["pos"]
            now[name] = {"pos": end, "session": was["session"]}
        self.at = now
        return {"files": now}

    def partitions(self, start: dict, end: dict):
        out = []
        for name, to in end["files"].items():
            was = start["files"].get(name, {"pos": 0, "session": 0})
            low = was["pos"] if was["session"] == to["session"] else 0
            if to["pos"] > low:
                out.append(Growth(name, to["session"], low, to["pos"]))
        return out

    def _marks(self, name: str, session: int) -> str:
        return f"{_store(self.state)[1]}/headers/{hashlib.md5(name.encode()).hexdigest()}-{session}"

    def _header_at(self, name: str, session: int, start: int) -> list[str]:
        """The columns in force at byte `start`: the last header before it, the fixed columns without one."""
        from pyarrow import fs

        store, _ = _store(self.state)
        marks = store.get_file_info(fs.FileSelector(self._marks(name, session), allow_not_found=True))
        before = [int(f.base_name) for f in marks if f.base_name.isdigit() and int(f.base_name) < start]
        if before:
            return json.loads(store.open_input_file(f"{self._marks(name, session)}/{max(before)}").read())
        store, base = _store(self.path)
        first = _bytes(store, f"{base}/{name}", 0, LOOK).split(b"\n", 1)[0]
        return parse_lines([first.decode("utf-8", "replace")], METER_COLUMNS)[1]

    def read(self, partition: Growth):
        store, base = _store(self.path)
        file, header = f"{base}/{partition.file}", self._header_at(partition.file, partition.session, partition.start)
        at = partition.start
        while at < partition.end:
            high = min(partition.end, at + MOST_BYTES)
            end = _line_end(store, file, at, high, partition.end)
            raw = _bytes(store, file, at, end)
            for line in raw.splitlines(keepends=True):
                rows, now = parse_lines([line.decode("utf-8", "replace").rstrip("\r\n")], header)
                if now is not header:
                    header = now
                    self._mark(partition, at, header)
                at += len(line)
                for r in rows:
                    when = moment(r.get("timestamp_iso", ""))
                    if when is not None:
                        yield (f"{self.path}/{partition.file}", partition.session, when, *[number(r.get(c, "")) for c in MEASURES])

    def _mark(self, partition: Growth, at: int, header: list[str]) -> None:
        store, _ = _store(self.state)
        folder = self._marks(partition.file, partition.session)
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(f"{folder}/{at}") as out:
            out.write(json.dumps(header).encode())

    def commit(self, end: dict) -> None:
        store, base = _store(self.state)
        store.create_dir(base, recursive=True)
        with store.open_output_stream(f"{base}/offset.json") as out:
            out.write(json.dumps(end["files"]).encode())


class MeterTails(DataSource):
    @classmethod
    def name(cls) -> str:
        return "meter_tails"

    def schema(self) -> str:
        return TAIL_SCHEMA

    def streamReader(self, schema):
        return TailsReader(self.options)
