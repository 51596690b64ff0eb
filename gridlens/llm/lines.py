"""Line deduplication by two Bloom filters.

The keys of all lines are dealt by hash over ranges. A range holds two Bloom filters, one of the keys seen
in a document and one of those seen in a second; its keys come block by block as packed hashes, and every
block learns which of its keys the second filter has. Only these suspected repeats are shuffled as digests:
their documents are counted exactly, and the document that keeps the line is chosen. What a document
loses goes back to its text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ranges
from .common import SEPARATORS, free_names, frugal, shuffle_width, stage, utf8

#: Code points from which a line's key can be a repeat, and the documents that make it one.
LEAST_CHARS, LEAST_DOCS = 20, 3
#: Keys of a block, at most about.
BLOCK_KEYS = 1_000_000
#: Bits a key in each filter, and the bits that a key sets.
BITS, PROBES = 10, 4
DIGEST = 16
_SPACES = SEPARATORS.encode()
_CONTINUATION = bytes(range(0x80, 0xC0))
_ONE = np.uint64(1)


class BloomFilter:
    """Bits of a set of 64-bit hashes; never denies a member."""

    def __init__(self, expected: int):
        self.size = 1 << max(6, (max(1, expected) * BITS - 1).bit_length())
        self.bytes = np.zeros(self.size >> 3, np.uint8)

    def _bits(self, hashes: np.ndarray) -> np.ndarray:
        step = (hashes >> np.uint64(32)) | _ONE
        return (hashes[None, :] + step[None, :] * np.arange(PROBES, dtype=np.uint64)[:, None]) & np.uint64(self.size - 1)

    def add(self, hashes: np.ndarray) -> None:
        bits = self._bits(hashes).ravel()
        np.bitwise_or.at(self.bytes, bits >> np.uint64(3), np.left_shift(_ONE, bits & np.uint64(7)).astype(np.uint8))

    def has(self, hashes: np.ndarray) -> np.ndarray:
        bits = self._bits(hashes)
        return (self.bytes[bits >> np.uint64(3)] >> (bits & np.uint64(7)).astype(np.uint8) & 1).all(axis=0)


def suspects(tags: list[np.ndarray], counts: list[np.ndarray]) -> list[np.ndarray]:
    """Per block, 1 for each key that may stand in a second document, of this block or another."""
    expected = sum(map(len, tags))
    once, twice = BloomFilter(expected), BloomFilter(expected)
    for tag, count in zip(tags, counts):
        twice.add(tag[once.has(tag) | (count > 1)])
        once.add(tag)
    return [twice.has(tag).astype(np.int64) for tag in tags]


def line_key(line: bytes, least: int) -> bytes | None:
    """The digest of a line's key, None if the key is shorter than `least` code points."""
    if len(line) < least:
        return None
    key = line.strip(_SPACES).lower()  # of bytes: A-Z only
    if len(key) < least or (len(key) < 4 * least and len(key.translate(None, _CONTINUATION)) < least):
        return None
    return hashlib.blake2b(key, digest_size=DIGEST).digest()


_ROWS = f"kind int, doc_id long, sha binary, keys binary, {ranges.ASK}"


def _asker(least: int, parts: int):
    names = [c.split()[0] for c in _ROWS.split(", ")]

    def question(block: int, held: list[bytes]) -> pa.RecordBatch:
        halves = np.frombuffer(b"".join(held), "<u8").reshape(-1, 2)
        order = np.lexsort((halves[:, 1], halves[:, 0]))
        halves = halves[order]
        first = np.flatnonzero(np.concatenate([[True], (halves[1:] != halves[:-1]).any(axis=1)]))
        ask = ranges.asked(block, halves[first, 0], halves[first, 1], np.diff(np.append(first, len(halves))), parts)
        none = [pa.nulls(ask.num_rows, t) for t in (pa.int64(), pa.binary(), pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array(np.ones(ask.num_rows, np.int32)), *none, *ask.columns], names)

    def run(batches):
        block, held, count = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            data, at = utf8(batch.column("text"))
            keys = []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                own = {line_key(line, least): None for line in data[a:b].tobytes().split(b"\n")}
                own.pop(None, None)
                keys.append(b"".join(own))
                count += len(own)
            held += keys
            some = np.array([len(k) > 0 for k in keys], bool)
            n = int(some.sum())
            mask = pa.array(some)
            cols = [pa.array(np.zeros(n, np.int32)), batch.column("doc_id").filter(mask), batch.column("sha").filter(mask), pa.array([k for k in keys if k], pa.binary())]
            yield pa.RecordBatch.from_arrays([*cols, pa.nulls(n, pa.int32()), pa.array(np.full(n, block)), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], names)
            if count >= BLOCK_KEYS:
                yield question(block, held)
                block, held, count = block + 1, [], 0
        if count:
            yield question(block, held)

    return run


def _opened(docs: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The digests of a block's documents as two numbers each, and the row of the document."""
    keys = docs.column("keys").to_pylist()
    return np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2), np.repeat(np.arange(len(keys)), [len(k) // DIGEST for k in keys])


def _grouped(halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by digest, and the number of the distinct digest at each place in that order."""
    order = np.lexsort((halves[:, 1], halves[:, 0]))
    return order, np.cumsum(np.concatenate([[False], (halves[order][1:] != halves[order][:-1]).any(axis=1)])) if len(order) else order


def _ids(docs: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """doc_ids, and whether they are set."""
    col = docs.column("doc_id").combine_chunks()
    return col.fill_null(0).to_numpy(), col.is_valid().to_numpy(zero_copy_only=False)


_SUSPECT = "block long, digest binary, docs long, last long"


def _suspected(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """Of each suspected key of a block: its documents there and the largest doc_id among them."""
    halves, doc = _opened(docs)
    order, key = _grouped(halves)
    wanted = ranges.told(answers, int(key[-1]) + 1 if len(key) else 0) > 0
    places = np.flatnonzero(wanted[key]) if len(key) else np.zeros(0, np.int64)
    order, key = order[places], key[places]
    ids, known = _ids(docs)
    ids, known = ids[doc[order]], known[doc[order]]
    best = np.lexsort((ids, known, key))  # null first
    key = key[best]
    last = np.flatnonzero(np.concatenate([key[1:] != key[:-1], [True]])) if len(key) else np.zeros(0, np.int64)
    raw = halves[order[best[last]]].astype("<u8").tobytes()
    cols = [
        pa.array(np.full(len(last), docs.column("block")[0].as_py() if docs.num_rows else 0, np.int64)),
        pa.array([raw[i : i + DIGEST] for i in range(0, len(raw), DIGEST)], pa.binary()),
        pa.array(np.diff(np.concatenate([[-1], last]))),
        pa.array(ids[best[last]], mask=~known[best[last]]),
    ]
    return pa.Table.from_arrays(cols, names=["block", "digest", "docs", "last"])


_LOSS = "doc_id long, sha binary, gone binary"


def _losses(docs: pa.Table, repeats: pa.Table) -> pa.Table:
    """The digests that each document of a block loses."""
    keeper = dict(zip(repeats.column("digest").to_pylist(), repeats.column("last").to_pylist()))
    out = []
    if keeper:
        for doc_id, keys in zip(docs.column("doc_id").to_pylist(), docs.column("keys").to_pylist()):
            own = [keys[i : i + DIGEST] for i in range(0, len(keys), DIGEST)]
            out.append(b"".join(k for k in own if k in keeper and keeper[k] != doc_id))
    lost = pa.array([len(g) > 0 for g in out] or [False] * docs.num_rows, pa.bool_())
    return pa.Table.from_arrays([docs.column("doc_id").filter(lost), docs.column("sha").filter(lost), pa.array([g for g in out if g], pa.binary())], names=["doc_id", "sha", "gone"])


def _cutter(least: int, text_at: int, width: int, names: list[str]):
    def run(batches):
        for batch in batches:
            data, at = utf8(batch.column(text_at))
            texts, lines, dropped = [], [], []
            for a, b, gone in zip(at[:-1].tolist(), at[1:].tolist(), batch.column(width).to_pylist()):
                raw = data[a:b].tobytes()
                count = raw.count(b"\n") + 1
                lines.append(count)
                if gone:
                    lost = {gone[i : i + DIGEST] for i in range(0, len(gone), DIGEST)}
                    kept = [line for line in raw.split(b"\n") if line_key(line, least) not in lost]
                    raw = b"\n".join(kept)
                    count -= len(kept)
                dropped.append(count if gone else 0)
                texts.append(raw)
            cols = [batch.column(i) for i in range(width)]
            cols[text_at] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], names)

    return run


def repeated_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(doc_id, sha, gone): the documents that lose lines, told by doc_id and the md5 of the text, with the
    16-byte digests of the keys of these lines, end to end."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), _sha("text").alias("sha"), "text")
    # a line that can repeat has least_chars bytes at least
    most = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // max(1, least_chars)
    rows = stage(docs.mapInArrow(frugal(_asker(least_chars, ranges.range_count(shuffle_width(spark), most))), _ROWS), "lines", "kind")
    own = rows.where("kind = 0").select("block", "doc_id", "sha", "keys")
    said = ranges.answers(rows.where("kind = 1"), suspects)
    found = own.groupBy("block").cogroup(said.groupBy("block")).applyInArrow(_suspected, _SUSPECT)
    over = Window.partitionBy("digest")  # a row for each block that holds the key
    found = found.select("block", "digest", F.sum("docs").over(over).alias("all"), F.max("last").over(over).alias("last")).where(F.col("all") >= least_docs)
    repeats = stage(found.select("block", "digest", "last"), "repeats")
    return stage(own.groupBy("block").cogroup(repeats.groupBy("block")).applyInArrow(_losses, _LOSS).dropDuplicates(["doc_id", "sha"]), "losses")


def _sha(text: str):
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def without_repeated_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """docs with repeated lines taken out of `text`, and n_lines (before that) and n_dropped.

    A line's key is the line without word separators at its ends, A-Z lower-cased. Keys of least_chars code
    points or more that stand in least_docs rows or more lose all their lines, except in the rows of the
    largest doc_id that holds them, where all stay. Shorter lines stay everywhere. Null text is empty
    and comes back empty, with one line. Each row is a document; rows that share a doc_id keep a line together,
    and null is the smallest doc_id. doc_ids are whole numbers. Other columns stay as they are, but
    columns named n_lines and n_dropped are replaced. Keys are compared by 128-bit digests.
    """
    docs = docs.drop("n_lines", "n_dropped")
    lost = repeated_lines(docs, least_chars, least_docs)
    row, sha, doc_id, key, gone = free_names(docs, "row", "sha", "lost_id", "lost_sha", "gone")
    lost = lost.select(F.col("doc_id").alias(doc_id), F.col("sha").alias(key), F.col("gone").alias(gone)).hint("shuffle_hash")  # texts are not sorted
    rows = docs.withColumns({row: F.col("doc_id").cast("long"), sha: _sha("text")}).join(lost, F.col(row).eqNullSafe(F.col(doc_id)) & (F.col(sha) == F.col(key)), "left")
    out = docs.withColumns({"text": F.lit(""), "n_lines": F.lit(0).cast("long"), "n_dropped": F.lit(0).cast("long")}).schema
    at = [c.lower() for c in docs.columns].index("text")
    return rows.select(*docs.columns, gone).mapInArrow(frugal(_cutter(least_chars, at, len(docs.columns), out.names)), out)


def op13_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return without_repeated_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS w FROM documents),
l AS (
  SELECT r, doc_id, i, w[i] AS line,
         translate(regexp_replace(w[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT r, doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
g AS (SELECT k, count(DISTINCT r) AS n, max(doc_id) AS last FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT r) >= 3),
m AS (SELECT l.*, g.k IS NOT NULL AND l.doc_id IS DISTINCT FROM g.last AS gone FROM l LEFT JOIN g ON l.k = g.k)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r
"""
