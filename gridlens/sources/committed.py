"""A table that streaming queries write with a commit for each micro-batch.

    spark.dataSource.register(Committed)
    stream.writeStream.format("committed").option("path", "/data/events").option("checkpointLocation", ...).start()
    spark.read.format("committed").option("path", "/data/events").load()

Tasks write files of their own; a micro-batch counts from the moment its list of files is put in place, whole. The
files of a batch that fails are removed, and one that was committed before is not committed again, so after any restart
each row is there once. `compacted` rewrites the small files of many batches as few large ones, with Spark.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamArrowWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .replay import _store

#: Rows that a file of the table holds at most.
FILE_ROWS = 1_000_000


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


def _put(path: str, name: str, text: str) -> None:
    """Put a small file in place as a whole."""
    store, base = _store(path)
    folder = f"{base}/{name}".rpartition("/")[0]
    store.create_dir(folder, recursive=True)
    draft = f"{folder}/_{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as out:
        out.write(text.encode())
    store.move(draft, f"{base}/{name}")


def _lists(path: str) -> dict[int, dict]:
    """The committed lists by number of the last batch that each one covers."""
    from pyarrow import fs

    store, base = _store(path)
    found = store.get_file_info(fs.FileSelector(f"{base}/commits", allow_not_found=True))
    numbers = [int(f.base_name.removesuffix(".json")) for f in found if f.base_name[0].isdigit()]
    return {n: json.loads(store.open_input_file(f"{base}/commits/{n}.json").read()) for n in sorted(numbers)}


def live_files(path: str) -> list[str]:
    """The files of the table: those of the last compaction and of the batches after it."""
    lists = _lists(path)
    whole = max((n for n, x in lists.items() if x["compacted"]), default=None)
    return [f for n, x in lists.items() if whole is None or n >= whole for f in x["files"]]


class CommittedWriter(DataSourceStreamArrowWriter):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema

    def write(self, iterator):
        import pyarrow.parquet as pq

        store, base = _store(self.path)
        store.create_dir(f"{base}/data", recursive=True)
        files, writer, rows = [], None, 0
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                if writer is None or rows >= FILE_ROWS:
                    if writer is not None:
                        writer.close()
                    files.append(f"data/{uuid.uuid4().hex}.parquet")
                    writer, rows = pq.ParquetWriter(f"{base}/{files[-1]}", batch.schema, filesystem=store), 0
                writer.write_batch(batch)
                rows += batch.num_rows
        finally:
            if writer is not None:
                writer.close()
        return Written(files)

    def _remove(self, messages) -> None:
        from pyarrow import fs

        store, base = _store(self.path)
        for file in (f for m in messages if m is not None for f in m.files):
            if store.get_file_info(f"{base}/{file}").type == fs.FileType.File:
                store.delete_file(f"{base}/{file}")

    def commit(self, messages, batchId: int) -> None:
        lists = _lists(self.path)
        if any(n == batchId or n > batchId and x["compacted"] for n, x in lists.items()):
            self._remove(messages)  # done before the last restart
            return
        if not lists:
            _put(self.path, "schema.json", self.schema.json())
        _put(self.path, f"commits/{batchId}.json", json.dumps({"compacted": False, "files": [f for m in messages if m is not None for f in m.files]}))

    def abort(self, messages, batchId: int) -> None:
        self._remove(messages)


class Files(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


class CommittedReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema

    def partitions(self):
        return [Files([f]) for f in live_files(self.path)] or [Files([])]

    def read(self, partition: Files):
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import to_arrow_schema

        store, base = _store(self.path)
        wanted = to_arrow_schema(self.schema)  # Spark's own files have times of another unit
        for file in partition.files:
            for batch in pq.ParquetFile(store.open_input_file(f"{base}/{file}"), coerce_int96_timestamp_unit="us").iter_batches(columns=wanted.names):
                yield batch.select(wanted.names).cast(wanted)


class Committed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "committed"

    @property
    def path(self) -> str:
        return self.options["path"].rstrip("/")

    def schema(self) -> StructType:
        store, base = _store(self.path)
        return StructType.fromJson(json.loads(store.open_input_file(f"{base}/schema.json").read()))

    def reader(self, schema: StructType):
        return CommittedReader(self.path, schema)

    def streamWriter(self, schema: StructType, overwrite: bool):
        return CommittedWriter(self.path, schema)


def committed(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(Committed)
    return spark.read.format("committed").option("path", path).load()


def compacted(spark: SparkSession, path: str, files: int = 1, keep: int = 0) -> list[str]:
    """Rewrite what is committed as `files` files and let the table be these; gives the files that are in no list any more.
    Readers that began before may still need them: delete them later, with keep batches of grace."""
    lists = _lists(path)
    if len(lists) <= max(1, keep):
        return []
    last = max(lists)
    old = live_files(path)
    folder = f"data/compact-{uuid.uuid4().hex}"
    committed(spark, path).repartition(files).write.parquet(f"{path}/{folder}")
    from pyarrow import fs

    store, base = _store(path)
    new = [f"{folder}/{f.base_name}" for f in store.get_file_info(fs.FileSelector(f"{base}/{folder}")) if f.base_name.startswith("part-")]
    _put(path, f"commits/{last}.json", json.dumps({"compacted": True, "files": new}))
    for n in lists:
        if n != last:
            store.delete_file(f"{base}/commits/{n}.json")
    return old
