"""Substring deduplication by content-defined spans of a gear hash.

A gear rolling hash over words gives every window of MIN_WORDS words a seed, the least hash in it, so
equal windows have equal seeds wherever they stand. Windows side by side that share a seed are a span.
Seeds that occur in several documents are found first; where all spans of a seed are equal, that settles
their windows, else each window is looked up by its own digest. Every repeated window is thereby found,
and stays in the document with the smallest id that holds it.

`chunks` cuts texts at the boundaries of a gear hash over 32 bytes, where insertions move no far boundary.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Spans, _power_tables, mix, slices, stage, utf8, word_bounds

#: Chunk sizes in bytes: least, most, and the mean distance of hash boundaries.
LEAST, MOST, MEAN = 16, 128, 32
#: Words from which equal text in several documents counts as a repeated passage.
MIN_WORDS = 51
WINDOW = 32
_GEAR = np.random.default_rng(77).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of GEAR[data[i-j]] << j over the last 32 bytes, by doubling the window."""
    h = _GEAR[data]
    width = 1
    while width < WINDOW:
        wider = h.copy()
        wider[width:] += h[:-width] << np.uint32(width)
        h, width = wider, 2 * width
    return h


def chunk_ends(cuts: list[int], start: int, end: int, least: int = LEAST, most: int = MOST) -> list[int]:
    """Ends of the chunks of text [start, end): at hash boundaries `least` or more after the last
    end, and after `most` bytes without one."""
    ends, last = [], start
    for cut in cuts:
        while cut - last > most:
            last += most
            ends.append(last)
        if cut - last >= least:
            ends.append(cut)
            last = cut
    while end - last > most:
        last += most
        ends.append(last)
    if last < end:
        ends.append(end)
    return ends


_CHUNK = "doc_id long, seq int, start int, end int, words int, digest long"


def _chunker(least: int, most: int, mean: int):
    bar = np.uint32((1 << 32) // mean - 1)

    def rows(batches):
        for batch in batches:
            data, at = utf8(batch.column("text"))
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b in slices(at):
                text, offsets = data[at[a] : at[b]], at[a : b + 1] - at[a]
                cuts = np.flatnonzero(gear(text) <= bar) + 1
                span = np.searchsorted(cuts, np.minimum(offsets[:-1] + WINDOW, offsets[1:]))
                stop = np.searchsorted(cuts, offsets[1:], "right")
                cuts = cuts.tolist()
                ends = [chunk_ends(cuts[i:j], x, y, least, most) for i, j, x, y in zip(span, stop, offsets[:-1].tolist(), offsets[1:].tolist())]
                n = np.array([len(e) for e in ends], np.int64)
                end = np.array([e for es in ends for e in es], np.int64)
                if not len(end):
                    continue
                doc = np.repeat(np.arange(b - a), n)
                seq = np.arange(len(end)) - np.repeat(np.cumsum(n) - n, n)
                start = np.where(seq == 0, offsets[doc], np.roll(end, 1))
                words = word_bounds(text, offsets)[0]
                cols = [ids[a:b][doc], seq.astype(np.int32), (start - offsets[doc]).astype(np.int32), (end - offsets[doc]).astype(np.int32), (np.searchsorted(words, end) - np.searchsorted(words, start)).astype(np.int32), Spans(text).hash(start, end).astype(np.int64)]
                for k in range(0, len(end), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[k : k + 50_000]) for c in cols], ["doc_id", "seq", "start", "end", "words", "digest"])

    return rows


def chunks(docs: DataFrame, least: int = LEAST, most: int = MOST, mean: int = MEAN) -> DataFrame:
    """doc_id, seq, start, end (byte offsets), words (that begin in it), digest."""
    return docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long"), "text").mapInArrow(_chunker(least, most, mean), _CHUNK)


class _Words(Spans):
    """Hashes of word ranges of a buffer of texts."""

    def __init__(self, values: np.ndarray):
        self.up, self.down = _power_tables(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=self.sums[1:])


def seeds_of(values: np.ndarray, least: int) -> np.ndarray:
    """For each window of `least` words, the least scrambled gear hash of the word groups in it."""
    group, h, width = 1 << (max(1, least // 3).bit_length() - 1), values, 1
    while width < group:
        h, width = (h[:-width] << np.uint64(width)) + h[width:], 2 * width
    h, span, width = mix(h), least - group + 1, 1
    while width < span:
        step = min(width, span - width)
        h, width = np.minimum(h[:-step], h[step:]), width + step
    return h


_SPAN = "doc_id long, text_key long, seed long, digest long, at int, n int, start int, end int"
_WINDOW = "doc_id long, text_key long, digest long, digest2 int, at int, start int, end int"


def _batches(cols: list[np.ndarray], names: list[str]):
    for k in range(0, len(cols[0]), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(c[k : k + 50_000]) for c in cols], names)


def _sliced(batch):
    """Row range, bytes, offsets, word bounds and hashes of each slice of texts."""
    data, at = utf8(batch.column("text"))
    for a, b in slices(at):
        text, offsets = data[at[a] : at[b]], at[a : b + 1] - at[a]
        starts, ends, before = word_bounds(text, offsets)
        yield a, b, offsets, starts, ends, before, Spans(text).hash(starts, ends)


def _spanner(least: int):
    names = [c.split()[0] for c in _SPAN.split(", ")]

    def rows(batches):
        for batch in batches:
            ids, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "text_key"))
            for a, b, offsets, starts, ends, before, values in _sliced(batch):
                if len(values) < least:
                    continue
                doc = np.repeat(np.arange(b - a), np.diff(before))
                at = np.flatnonzero(doc[: len(doc) - least + 1] == doc[least - 1 :])
                if not len(at):
                    continue
                seed, doc = seeds_of(values, least)[at], doc[at]
                new = np.flatnonzero(np.concatenate([[True], (seed[1:] != seed[:-1]) | (doc[1:] != doc[:-1])]))
                n = np.diff(np.append(new, len(at)))
                at, seed, doc = at[new], seed[new], doc[new]
                stop = at + n + least - 1
                digest = _Words(values).hash(at, stop)
                whole = [seed.view(np.int64), digest.view(np.int64), at - before[doc], n, starts[at] - offsets[doc], ends[stop - 1] - offsets[doc]]
                yield from _batches([ids[a:b][doc], keys[a:b][doc], *whole[:2], *(c.astype(np.int32) for c in whole[2:])], names)

    return rows


def _windows(least: int):
    names = [c.split()[0] for c in _WINDOW.split(", ")]

    def rows(batches):
        for batch in batches:
            ids, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "text_key"))
            spans = batch.column("spans")
            for a, b, offsets, starts, ends, before, values in _sliced(batch):
                part = spans.slice(a, b - a)
                flat, sizes = part.flatten(), np.array([len(x) for x in part], np.int64)
                first, n = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("at", "n"))
                doc = np.repeat(np.repeat(np.arange(b - a), sizes), n)
                at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum()) + before[doc]
                once, again = _Words(values), _Words(mix(values ^ np.uint64(0x5851F42D4C957F2D)))
                for k in range(0, len(at), 50_000):
                    x, d = at[k : k + 50_000], doc[k : k + 50_000]
                    digest2 = (again.hash(x, x + least) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                    whole = [x - before[d], starts[x] - offsets[d], ends[x + least - 1] - offsets[d]]
                    yield from _batches([ids[a:b][d], keys[a:b][d], once.hash(x, x + least).view(np.int64), digest2, *(c.astype(np.int32) for c in whole)], names)

    return rows


def _texts(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text")


def _passages(docs: DataFrame, least: int) -> DataFrame:
    """The rows of repeated_passages with text_key, which tells the texts of a doc_id apart."""
    row, texts = ["doc_id", "text_key"], _texts(docs)
    spans = texts.mapInArrow(_spanner(least), _SPAN)
    seeds = spans.groupBy("seed").agg(F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("last"), (F.min("digest") != F.max("digest")).alias("mixed")).where("first_doc_id < last")
    seeds = stage(seeds.select("seed", "first_doc_id", "mixed"), "repeated")
    hits = stage(spans.join(seeds, "seed").select(*row, "at", "n", "start", "end", "first_doc_id", "mixed"), "spans")
    mixed = hits.where("mixed").groupBy(row).agg(F.collect_set(F.struct("at", "n")).alias("spans"))
    windows = stage(texts.join(mixed, row).mapInArrow(_windows(least), _WINDOW), "windows")
    often = windows.groupBy("digest", "digest2").agg(F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("last")).where("first_doc_id < last").drop("last")
    found = windows.join(stage(often, "repeated-windows"), ["digest", "digest2"]).withColumn("n", F.lit(1))
    cols = [*row, "at", "n", "start", "end", "first_doc_id"]
    known = hits.where("NOT mixed").select(cols).unionByName(found.select(cols)).repartition(*row).dropDuplicates([*row, "at"])
    order = Window.partitionBy(row).orderBy("at")
    goes_on = (F.lag(F.col("at") + F.col("n")).over(order) == F.col("at")) & (F.lag("first_doc_id").over(order) == F.col("first_doc_id"))
    runs = (
        known.withColumn("new", F.when(goes_on, 0).otherwise(1))
        .withColumn("run", F.sum("new").over(order))
        .groupBy(*row, "run", "first_doc_id")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("at").alias("at"), (F.max(F.col("at") + F.col("n")) + least - 1).alias("stop"))
    )
    kept = F.col("first_doc_id") == F.col("doc_id")
    # what a kept run covers stays, so a cut one between kept ones is what they leave; runs ahead may reach over several
    ahead, beyond = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    from_ = lambda c, other: F.when(kept, F.col(c)).otherwise(F.greatest(c, F.coalesce(F.max(F.when(kept, F.col(other))).over(ahead), F.col(c)))).alias(c)
    until = lambda c, other: F.when(kept, F.col(c)).otherwise(F.least(c, F.coalesce(F.min(F.when(kept, F.col(other))).over(beyond), F.col(c)))).alias(c)
    trimmed = [from_("start", "end"), until("end", "start"), from_("at", "stop"), until("stop", "at")]
    return runs.select(*row, "first_doc_id", *trimmed, kept.alias("kept")).withColumn("n_words", (F.col("stop") - F.col("at")).cast("long")).where("n_words > 0")


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Passages of min_words equal words and more that occur in several documents, one row per occurrence:
    doc_id, start, end (byte offsets of whole words), n_words, first_doc_id (smallest id in which its windows of
    min_words words occur) and kept (this is the first document).

    All such passages are found. One is split where first_doc_id changes. Kept parts are listed whole, so each window
    of min_words words stands whole in the first document that holds it; of a part that is not kept only what no
    kept part of its document covers is listed, so it may be shorter than min_words. Words are compared with their case, separators between them are not.
    Null texts and rows without doc_id have none; rows that repeat a doc_id count as one document,
    so passages within a document only are not listed. Other columns are ignored.
    """
    return _passages(docs, min_words).select("doc_id", "start", "end", "n_words", "first_doc_id", "kept")


_CUT = "doc_id long, text string"


def _without(batches):
    for batch in batches:
        out = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            raw, last, keep = (text or "").encode(), 0, []
            for span in sorted(spans, key=lambda s: s["start"]):
                keep.append(raw[last : span["start"]])
                last = max(last, span["end"])
            out.append(b"".join([*keep, raw[last:]]).decode("utf-8", "ignore"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text) of the documents that lose a repeated passage, with it cut out."""
    row = ["doc_id", "text_key"]
    gone = _passages(docs, min_words).where("NOT kept").groupBy(row).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return _texts(docs).join(stage(gone, "cuts"), row).mapInArrow(_without, _CUT)


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
