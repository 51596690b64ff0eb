"""What the training-data operators share: staged tables, byte-level tokenising and components.

Word separators are the six characters of ``[\\x20\\x09-\\x0D]`` everywhere.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEPARATORS = " \t\n\x0b\x0c\r"
#: Text bytes that one vectorised pass handles at most (a longer single text is a pass of its own).
SLICE_BYTES = 1 << 19
#: A table of at most this many slim rows may be broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 300_000

_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; in local mode without that setting, a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.applicationId not in _local_dirs:
        _local_dirs[sc.applicationId] = tempfile.mkdtemp(prefix="gridlens-")
    return _local_dirs[sc.applicationId]


def stage(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there, and lost
    executors cost no more than a reread."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage/{name}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a staged slim table for broadcast if its counted rows are within limit."""
    return F.broadcast(df) if df.count() <= limit else df


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Column names made of `names` that df does not have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shuffle_width(spark: SparkSession, factor: int = 1) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))) * factor


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n+1 offsets; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, np.int64, len(col) + 1, col.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of at most `most` bytes, or of one row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, b
        a = b


def frugal(run):
    """`run`, a function for mapInArrow, whose worker gives freed Arrow memory back after each batch
    and at its end: workers are reused by later tasks, and would hold it through all of them."""

    def rows(batches):
        def freeing():
            for batch in batches:
                yield batch
                pa.default_memory_pool().release_unused()

        yield from run(freeing())
        pa.default_memory_pool().release_unused()

    return rows


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SEPARATORS.encode())] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CODE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BACK)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Spans:
    """Hashes of byte ranges of one buffer, each in constant time from prefix sums."""

    def __init__(self, data: np.ndarray):
        self.up, self.down = _power_tables(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_CODE[data] * self.up[: len(data)], out=self.sums[1:])

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.sums[ends] - self.sums[starts]) * self.down[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_bounds(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in a buffer of texts, and words before each text (n+1). apart: whether
    a byte separates words."""
    inside = ~apart[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = offsets[1:-1]
    at = edge[edge < len(data)]
    first[at] = inside[at]
    at = edge[edge > 0] - 1
    last[at] = inside[at]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, A-Z lower-cased if asked, and the words before each text."""
    starts, ends, before = word_bounds(data, offsets)
    return Spans(_LOWER[data] if lower else data).hash(starts, ends), before


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of `edges`: the smallest node reachable.

    Labels fall to the least neighbour's, then to the label's label, until none changes. Each
    round is joins and aggregates of slim rows over the staged edges; the driver sees one count.
    """
    both = stage(
        edges.select(F.col(a).alias("src"), F.col(b).alias("dst"))
        .where("src <> dst")
        .unionByName(edges.select(F.col(b).alias("src"), F.col(a).alias("dst")).where("src <> dst"))
        .distinct(),
        "edges",
    )
    label = stage(both.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("node"), F.least("src", "m").alias("label")), "label")
    while True:
        heard = both.join(label.select(F.col("node").alias("dst"), "label"), "dst").groupBy("src").agg(F.min("label").alias("heard"))
        near = stage(
            label.join(heard.select(F.col("src").alias("node"), "heard"), "node", "left").select("node", F.col("label").alias("was"), F.least("label", "heard").alias("label")),
            "near",
        )
        up = near.select(F.col("node").alias("label"), F.col("label").alias("top"))
        label = stage(near.join(up, "label", "left").select("node", "was", F.coalesce("top", "label").alias("label")), "label")
        if label.where("label <> was").isEmpty():
            return label.select("node", F.col("label").alias("component"))
        label = label.select("node", "label")
