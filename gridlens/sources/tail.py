"""A streaming source that follows one growing meter file.

    spark.dataSource.register(MeterTail)
    spark.readStream.format("meter_tail").option("path", "/data/live.csv").load()

A half-written last line waits for its end; a header in mid-file sets the columns anew, also for later
micro-batches, as the offset holds it; rows of another
length are dropped; a file that became shorter is read again from its start. startingOffset is
latest (default) or earliest. A growing local file has one reader by nature.
"""

from __future__ import annotations

import os
from datetime import datetime, timezone

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ..schema import MEASURES, METER_COLUMNS

TAIL_SCHEMA = "series_id string, session int, timestamp_iso timestamp, " + ", ".join(f"{c} double" for c in MEASURES)


def number(text: str) -> float | None:
    try:
        value = float(text)
    except ValueError:
        return None
    return value if value == value and abs(value) != float("inf") else None


def moment(text: str) -> datetime | None:
    try:
        at = datetime.fromisoformat(text.strip().replace("Z", "+00:00"))
    except ValueError:
        return None
    return at if at.tzinfo else at.replace(tzinfo=timezone.utc)


def parse_lines(lines: list[str], header: list[str]) -> tuple[list[dict], list[str]]:
    """Rows as dicts by column name, and the header in force at the end."""
    rows = []
    for line in lines:
        cells = [c.strip() for c in line.lstrip("﻿").split(",")]
        if "timestamp_iso" in cells:
            header = cells
        elif len(cells) == len(header) and any(cells):
            rows.append(dict(zip(header, cells)))
    return rows, header


#: Bytes that one micro-batch reads at most, unless a single line is longer.
MOST_BYTES = 8 << 20


def read_from(path: str, pos: int, most: int = MOST_BYTES) -> tuple[list[str], int]:
    """Whole lines from byte pos on, of about `most` bytes, and the byte after the last of them."""
    with open(path, "rb") as f:
        f.seek(pos)
        data = f.read(most)
        while data and b"\n" not in data and (more := f.read(most)):
            data += more
    end = data.rfind(b"\n") + 1
    return data[:end].decode("utf-8", "replace").splitlines(), pos + end


def header_of(path: str) -> list[str]:
    """The first line's columns, or the fixed ones where it is no header."""
    with open(path, "rb") as f:
        cells = [c.strip() for c in f.readline().decode("utf-8", "replace").lstrip("﻿").split(",")]
    return cells if "timestamp_iso" in cells else METER_COLUMNS


class TailReader(SimpleDataSourceStreamReader):
    def __init__(self, options):
        self.path = options["path"]
        self.earliest = options.get("startingoffset", options.get("startingOffset", "latest")) == "earliest"

    def initialOffset(self) -> dict:
        there = os.path.exists(self.path)
        return {"pos": 0 if self.earliest or not there else os.path.getsize(self.path), "session": 0, "header": header_of(self.path) if there else METER_COLUMNS}

    def _rows(self, parsed: list[dict], session: int):
        rows = []
        for r in parsed:
            at = moment(r.get("timestamp_iso", ""))
            if at is not None:
                rows.append((self.path, session, at, *[number(r.get(c, "")) for c in MEASURES]))
        return iter(rows)

    def read(self, start: dict):
        pos, session, header = start["pos"], start["session"], start["header"]
        if not os.path.exists(self.path):
            return iter([]), start
        if os.path.getsize(self.path) < pos:  # truncated: a new session
            pos, session, header = 0, session + 1, header_of(self.path)
        lines, end = read_from(self.path, pos)
        parsed, header = parse_lines(lines, header)
        return self._rows(parsed, session), {"pos": end, "session": session, "header": header}

    def readBetweenOffsets(self, start: dict, end: dict):
        same = start["session"] == end["session"]
        pos = start["pos"] if same else 0
        with open(self.path, "rb") as f:
            f.seek(pos)
            data = f.read(end["pos"] - pos)
        header = start["header"] if same else header_of(self.path)
        return self._rows(parse_lines(data.decode("utf-8", "replace").splitlines(), header)[0], end["session"])


class MeterTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "meter_tail"

    def schema(self) -> str:
        return TAIL_SCHEMA

    def simpleStreamReader(self, schema):
        return TailReader(self.options)
