"""Exact deduplication over a sharded cuckoo-filter index.

An index is a table of live keys, one shard per digest range, each kept with its place in the shard's
cuckoo filter: the bucket and the short fingerprint. A probe whose fingerprint is in neither of its two
buckets is new without a look at any stored key; one that is found there is verified against the
digest and length that the bucket holds beside it. Deletion takes a key out of its bucket. When an
insertion finds no free slot after MAX_KICKS moves, the filter doubles and is filled again from the
stored keys.

Every row goes through such an index: mapping tasks probe one of their own, so that the copies they see
become one key with a count, and the shards' tasks probe theirs with what comes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SEPARATORS, free_names, frugal, shuffle_width, small, stage

SLOTS = 4
MAX_KICKS = 200
#: Keys that a mapping task holds before it sends them on.
HELD_KEYS = 200_000
#: Keys of a shard, at most about.
SHARD_KEYS = 500_000


class CuckooIndex:
    """Cuckoo filter of 16-bit fingerprints with partial-key placement. A slot is [fingerprint, digest,
    chars, keep_id, group_size]; what follows the fingerprint is looked at only where that one matches."""

    def __init__(self, expected: int = 64, size: int | None = None):
        self.size = size or 1 << max(2, int(np.ceil(np.log2(max(1, expected) / (SLOTS * 0.8) + 1))))
        self.buckets: list[list[list]] = [[] for _ in range(self.size)]
        self.resizes = self.denied = self.verified = self.count = 0

    def _place(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[8:10], "little") or 1
        one = int.from_bytes(digest[10:18], "little") & (self.size - 1)
        return mark, one, self._other(one, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & (self.size - 1)

    def find(self, digest: bytes, chars: int | None = None) -> list | None:
        """The live slot of a digest (and length of its normalised text, if given), else None."""
        mark, one, two = self._place(digest)
        seen = False
        for bucket in (one,) if one == two else (one, two):
            for slot in self.buckets[bucket]:
                if slot[0] == mark:
                    seen = True
                    if slot[1] == digest:
                        self.verified += 1
                        return slot
        self.denied += not seen
        return None

    def _put(self, slot: list) -> list | None:
        """Place a slot; the slot that is left over if MAX_KICKS moves find no room."""
        _, at, two = self._place(slot[1])
        for bucket in (at, two):
            if len(self.buckets[bucket]) < SLOTS:
                self.buckets[bucket].append(slot)
                return None
        for kick in range(MAX_KICKS):
            bucket = self.buckets[at]
            k = (slot[0] + kick) % SLOTS
            slot, bucket[k] = bucket[k], slot
            at = self._other(at, slot[0])
            if len(self.buckets[at]) < SLOTS:
                self.buckets[at].append(slot)
                return None
        return slot

    def add(self, digest: bytes, chars: int, keep_id: int | None, group_size: int) -> bool:
        """Insert a key, or join it to its live one, of which the better row stays. Whether it was new."""
        slot = self.find(digest)
        if slot is not None:
            if _rank(chars, keep_id) < _rank(slot[2], slot[3]):
                slot[2:4] = chars, keep_id
            slot[4] += group_size
            return False
        self.count += 1
        left = self._put([self._place(digest)[0], digest, chars, keep_id, group_size])
        if left is not None:
            self._grow(left)
        return True

    def _grow(self, left: list) -> None:
        stored = [slot for bucket in self.buckets for slot in bucket] + [left]
        while True:
            self.size *= 2
            self.resizes += 1
            self.buckets = [[] for _ in range(self.size)]
            if all(self._put(slot) is None for slot in stored):
                return

    def delete(self, digest: bytes) -> bool:
        slot = self.find(digest)
        if slot is None:
            return False
        mark, one, two = self._place(digest)
        home = next(b for b in (one, two) if any(s is slot for s in self.buckets[b]))
        self.buckets[home] = [s for s in self.buckets[home] if s is not slot]
        self.count -= 1
        return True

    def load(self, bucket: int, slot: list) -> None:
        """A stored slot back in its bucket."""
        self.buckets[bucket].append(slot)
        self.count += 1

    def table(self, shard: int = 0) -> pa.Table:
        rows = [(shard, self.size, b, *slot) for b, bucket in enumerate(self.buckets) for slot in bucket]
        cols = list(zip(*rows)) or [()] * 8
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES)], _INDEX_NAMES)


def _rank(chars: int, keep_id: int | None) -> tuple:
    """Longest first, then smallest id, null last."""
    return -chars, keep_id is None, keep_id


_INDEX = "shard int, size long, bucket long, mark int, digest binary, chars long, keep_id long, group_size long"
_INDEX_NAMES = [c.split()[0] for c in _INDEX.split(", ")]
_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
_KEYS = "digest binary, chars long, keep_id long, group_size long"


def _combine(batches):
    """The rows of a task as keys: each row probes the task's index."""
    index = CuckooIndex(1 << 12)
    keys = [c.split()[0] for c in _KEYS.split(", ")]
    for batch in batches:
        for doc_id, chars, digest in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "chars", "digest"))):
            index.add(digest, chars, doc_id, 1)
            if index.count >= HELD_KEYS:
                yield from index.table().select(keys).to_batches()
                index = CuckooIndex(1 << 12)
    yield from index.table().select(keys).to_batches()


def _apply(rows: pa.Table) -> pa.Table:
    """Run one shard's operations: its live keys in their buckets, then deletions, then insertions."""
    pa.default_memory_pool().release_unused()  # of the group before
    cols = {c: rows.column(c).to_pylist() for c in ("shard", "op", *_INDEX_NAMES[1:])}
    ops = cols["op"]
    live = [i for i, op in enumerate(ops) if op == "live"]
    index = CuckooIndex(len(ops), size=cols["size"][live[0]] if live else None)
    for i in live:
        index.load(cols["bucket"][i], [cols[c][i] for c in ("mark", "digest", "chars", "keep_id", "group_size")])
    for i, op in enumerate(ops):
        if op == "delete":
            index.delete(cols["digest"][i])
    for i, op in enumerate(ops):
        if op == "insert":
            index.add(*(cols[c][i] for c in ("digest", "chars", "keep_id", "group_size")))
    return index.table(cols["shard"][0])


def normalised(text) -> F.Column:
    """Text without word separators; null counts as empty."""
    return F.translate(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), SEPARATORS, "")


def digested(docs: DataFrame) -> DataFrame:
    """(doc_id, chars, digest) of whole texts."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("chars"), F.unhex(F.sha2(normalised("text"), 256)).alias("digest"))


def update_index(inserts: DataFrame, live: DataFrame | None = None, deletes: DataFrame | None = None, shards: int | None = None) -> DataFrame:
    """The index after deleting the digests of `deletes` and inserting `inserts` (doc_id, chars, digest):
    shard, size (of its filter), bucket, mark, digest, chars, keep_id, group_size.

    live: an index that this function made; it keeps its shards. Copies meet in the mapping tasks'
    indexes before the shuffle, so a digest that a third of all rows share reaches its shard as few
    keys. Without `live` the shards grow in number with the rows; one shard's keys are all that a task
    holds. group_size counts the rows inserted since the key came in.
    """
    if live is not None:
        if "shards" not in live.columns and not shards:
            raise ValueError("live has lost its column shards; give the number of shards it was made with")
        shards = (live.agg(F.max("shards")).first()[0] if "shards" in live.columns else None) or shards
    shards = shards or max(shuffle_width(inserts.sparkSession, 2), inserts.count() // SHARD_KEYS)
    keys = inserts.select("doc_id", "chars", "digest").mapInArrow(frugal(_combine), _KEYS)
    blank = lambda df: df.withColumns({"size": F.lit(0).cast("long"), "bucket": F.lit(0).cast("long"), "mark": F.lit(0)})
    shard = F.pmod(F.conv(F.substring(F.hex("digest"), 1, 7), 16, 10).cast("long"), F.lit(shards)).cast("int").alias("shard")
    cols = ["op", *_INDEX_NAMES[1:]]
    rows = blank(keys).withColumn("op", F.lit("insert")).select(shard, *cols)
    if live is not None:
        rows = rows.unionByName(live.withColumn("op", F.lit("live")).select("shard", *cols))
    if deletes is not None:
        none = F.lit(0).cast("long")
        rows = rows.unionByName(blank(deletes.select("digest", none.alias("chars"), none.alias("keep_id"), none.alias("group_size"))).withColumn("op", F.lit("delete")).select(shard, *cols))
    return rows.groupBy("shard").applyInArrow(_apply, _INDEX).withColumn("shards", F.lit(shards))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without word separators; of equal texts the longest original,
    then the smallest doc_id, stays. Null text is empty, and empty texts equal each other. A null
    doc_id ranks last. Rows that repeat a doc_id and text are kept or dropped together, as they
    can't be told apart here; `kept_documents` keeps one of them. Other columns are ignored.
    """
    rows = stage(digested(docs), "digests")
    index = stage(update_index(rows).select("digest", "keep_id", "group_size"), "cuckoo")
    return rows.join(index, "digest").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, one per distinct text, with all their columns.

    Where doc_ids are set and unique, the ids that go are taken out and no text moves as long as
    these ids are few enough to be broadcast. Rows without a doc_id and rows that repeat one are
    told apart by their digests and come as one row per doc_id and text.
    """
    verdict = stage(exact_dedup(docs), "verdict")
    twice = stage(verdict.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").select("doc_id"), "twice")
    gone = stage(verdict.where("NOT kept AND doc_id IS NOT NULL").select("doc_id").union(twice.where("doc_id IS NOT NULL")).distinct(), "gone")
    plain = docs.where(F.col("doc_id").isNotNull()).join(small(gone), "doc_id", "left_anti").select(*docs.columns)
    if twice.isEmpty():
        return plain
    row, sha = free_names(docs, "row", "sha")
    odd = docs.withColumn(sha, F.sha2(normalised("text"), 256)).withColumn(row, F.col("doc_id").cast("long"))
    stay = verdict.where("kept").join(twice.withColumnRenamed("doc_id", "again"), F.col("doc_id").eqNullSafe(F.col("again")), "left_semi")
    stay = stay.select(F.col("doc_id").alias("stay_id"), F.col("text_sha256").alias("stay_sha")).distinct().alias("stay")
    odd = odd.alias("odd").join(stay, F.col(f"odd.{row}").eqNullSafe(F.col("stay.stay_id")) & (F.col(f"odd.{sha}") == F.col("stay.stay_sha")), "left_semi")
    return plain.unionByName(odd.dropDuplicates([row, sha]).select(*docs.columns))


def op5_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
k AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id NULLS LAST) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM k
"""
