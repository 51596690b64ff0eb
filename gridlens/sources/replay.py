"""A streaming source that replays recordings by time.

    write_replay(recordings, "/data/replay")
    spark.dataSource.register(Replay)
    spark.readStream.format("replay").option("path", "/data/replay").option("batchSeconds", 10).load()

Recordings are stored in buckets of series and chunks of time, so a micro-batch reads only its own time, a task for each
bucket. Offsets count ticks of batchSeconds. Without `speed` all ticks are due at once; with it, they become due with
the clock, `speed` times as fast as recorded since startedAt (seconds since 1970, else the reader's start). A micro-batch
admits mostTicks of those due (1, with speed 6). After the end, one beat without a series carries the clock drainSeconds
on, so that timers of what went silent run.

A reader is not told where its stream's checkpoint stands. The file of option `progress`, one for each stream, tells it
what was committed last; without that option the first micro-batch admits all that is due, so that offsets never go back.
"""

from __future__ import annotations

import json
import math
import time
from datetime import datetime, timezone

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

REPLAY_SCHEMA = "series_id string, t_sec double, p double, q double, thd double, arrived timestamp"
#: `arrived` counts from here; a watermark of streams begins in 1970 and would drop rows of that moment.
BEGIN = datetime(2000, 1, 1, tzinfo=timezone.utc)
_ROWS = ["series_id", "t_sec", "p", "q", "thd", "due"]


def write_replay(recordings: DataFrame, path: str, buckets: int = 8, chunk_s: float = 60.0) -> None:
    """Store recordings (series_id, t_sec, p, q, thd, optionally `due`, the second at which a row arrives, else t_sec)
    for replay; times are from 0 on. Rows without a series or a time are left out."""
    rows = recordings if "due" in recordings.columns else recordings.withColumn("due", F.col("t_sec"))
    rows = rows.where("series_id IS NOT NULL AND t_sec IS NOT NULL AND due IS NOT NULL")
    placed = rows.select(*_ROWS, F.pmod(F.xxhash64("series_id"), F.lit(buckets)).alias("bucket"), F.floor(F.col("due") / chunk_s).cast("long").alias("chunk"))
    placed.repartition("bucket", "chunk").write.mode("overwrite").partitionBy("bucket", "chunk").parquet(f"{path}/rows")
    span = recordings.sparkSession.read.schema("due double").parquet(f"{path}/rows").agg(F.min("due").alias("low"), F.max("due").alias("high"))
    span.select(F.to_json(F.struct("low", "high", F.lit(buckets).alias("buckets"), F.lit(float(chunk_s)).alias("chunk_s"))).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/span")


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


class Slice(InputPartition):
    """The rows of one bucket that are due in [low, high) seconds; bucket None: the beat at `low`."""

    def __init__(self, bucket: int | None, low: float, high: float):
        self.bucket, self.low, self.high = bucket, low, high


class ReplayReader(DataSourceStreamReader):
    def __init__(self, options):
        from pyarrow import fs

        get = lambda name, default: float(options.get(name.lower(), options.get(name, default)))
        self.path = options["path"].rstrip("/")
        self.tick, self.drain = get("batchSeconds", 10), get("drainSeconds", 0)
        self.speed, self.started = get("speed", 0), get("startedAt", 0) or time.time()
        self.most = int(get("mostTicks", 6 if self.speed else 1))
        self.progress = options.get("progress")
        store, base = _store(self.path)
        span = {}
        for f in store.get_file_info(fs.FileSelector(f"{base}/span")):
            if f.type == fs.FileType.File and f.base_name.startswith("part-"):
                text = store.open_input_file(f.path).read().decode()
                span = json.loads(text) if text.strip() else span
        self.buckets, self.chunk = int(span.get("buckets", 1)), float(span.get("chunk_s", 60.0))
        low, high = span.get("low"), span.get("high")
        self.empty = low is None
        self.first = 0 if self.empty else math.floor(low / self.tick)
        self.last = 0 if self.empty else math.floor(high / self.tick) + 1  # the tick after the last rows
        self.at = self._committed()

    def _committed(self) -> int | None:
        """The tick from which on a micro-batch's admission counts, None if that is not known."""
        from pyarrow import fs

        if not self.progress:
            return None
        store, file = _store(self.progress)
        if store.get_file_info(file).type != fs.FileType.File:
            return self.first
        # the last micro-batch may be done and not told yet, so the next may admit twice as much
        return int(store.open_input_file(file).read().decode()) + self.most

    def initialOffset(self) -> dict:
        return {"tick": self.first}

    def latestOffset(self) -> dict:
        end = self.last + (1 if self.drain and not self.empty else 0)
        due = end
        if self.speed:
            due = min(end, self.first + math.floor((time.time() - self.started) * self.speed / self.tick))
        self.at = due if self.at is None else max(self.at, min(due, self.at + self.most))
        return {"tick": self.at}

    def partitions(self, start: dict, end: dict):
        low, high = start["tick"], end["tick"]
        out = [Slice(b, low * self.tick, min(high, self.last) * self.tick) for b in range(self.buckets)] if low < min(high, self.last) else []
        if high > self.last:
            out.append(Slice(None, self.last * self.tick + self.drain, 0.0))
        return out

    def commit(self, end: dict) -> None:
        if self.progress:
            store, file = _store(self.progress)
            with store.open_output_stream(file) as out:
                out.write(str(end["tick"]).encode())

    def batches(self, partition: Slice):
        """The rows of a slice as Arrow batches of REPLAY_SCHEMA."""
        import pyarrow as pa
        import pyarrow.dataset as ds
        from pyarrow import fs

        kinds = pa.schema([("series_id", pa.string()), *[(c, pa.float64()) for c in ("t_sec", "p", "q", "thd")], ("arrived", pa.timestamp("us", "UTC"))])
        begin = int(BEGIN.timestamp()) * 1_000_000
        moment = lambda due: pa.array(begin + np.rint(np.asarray(due) * 1e6).astype("int64")).cast(kinds.field("arrived").type)
        if partition.bucket is None:
            yield pa.RecordBatch.from_arrays([*[pa.nulls(1, f.type) for f in kinds][:-1], moment([partition.low])], schema=kinds)
            return
        store, base = _store(self.path)
        for chunk in range(math.floor(partition.low / self.chunk), math.floor((partition.high - 1e-9) / self.chunk) + 1):
            folder = f"{base}/rows/bucket={partition.bucket}/chunk={chunk}"
            if store.get_file_info(folder).type != fs.FileType.Directory:
                continue
            rows = ds.dataset(folder, filesystem=store, format="parquet").scanner(columns=_ROWS, filter=(ds.field("due") >= partition.low) & (ds.field("due") < partition.high))
            for batch in rows.to_batches():
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([*[batch.column(f.name).cast(f.type) for f in list(kinds)[:-1]], moment(batch.column("due").to_numpy())], schema=kinds)

    def read(self, partition: Slice):
        for batch in self.batches(partition):
            yield from zip(*(column.to_pylist() for column in batch.columns))


class BatchReplayReader(ReplayReader):
    """Gives Spark whole batches; of a row at a time, turning it into a row costs more than all else."""

    def read(self, partition: Slice):
        return self.batches(partition)


class Replay(DataSource):
    @classmethod
    def name(cls) -> str:
        return "replay"

    def schema(self) -> str:
        return REPLAY_SCHEMA

    def streamReader(self, schema):
        return BatchReplayReader(self.options)
