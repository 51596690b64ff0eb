"""Bigram language model by deleted interpolation, over n-gram counts that never leave the executors.

Documents are taken in blocks. Each block sends its distinct n-grams with their training counts to
the ranges of the key space that own them; a range adds up and answers each block in the order of its
keys. So counts of all documents meet their uses in two shuffles of packed keys, and no task holds more
than a block or a range. Maximum-likelihood and unigram estimates are mixed with weights by bucket of the
context's frequency; the weights come from expectation-maximisation on held-out training documents,
each of whose events is deleted from the counts before it is predicted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, mix, shuffle_width, slices, stage, utf8, word_hashes

#: Rows with crc32(doc_id as text) mod FOLDS equal to HELD_OUT are not learned from; those equal to
#: TUNING are training rows whose deleted counts teach the mixture weights.
FOLDS, HELD_OUT, TUNING = 10, 0, 1
#: The unigram's added count.
ADDED = 0.1
BUCKETS = 24
#: Histogram cells per unit of the natural logarithm of an event's likelihood ratio.
CELLS = 64
BLOCK_BYTES = 16 << 20
#: Bytes of text for each range of keys.
RANGE_BYTES = 32 << 20
END, BEGIN = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def fold() -> F.Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


class Events:
    """The tokens of a block's texts, each with its word and bigram key; every text ends in END."""

    def __init__(self, column: pa.Array):
        data, at = utf8(column)
        parts = [word_hashes(data[at[a] : at[b]], at[a : b + 1] - at[a]) for a, b in slices(at)]
        count = np.concatenate([np.diff(before) for _, before in parts]) + 1 if parts else np.zeros(0, np.int64)
        self.doc = np.repeat(np.arange(len(count)), count)
        self.tokens = count
        self.word = np.full(int(count.sum()), END, np.uint64)
        last = np.cumsum(count) - 1
        inner = np.ones(len(self.word), bool)
        inner[last] = False
        self.word[inner] = np.concatenate([h for h, _ in parts]) if parts else []
        self.before = np.empty_like(self.word)
        self.before[1:] = self.word[:-1]
        self.before[last[:-1] + 1 if len(last) else []] = BEGIN
        if len(self.before):
            self.before[0] = BEGIN
        pair = mix(self.before * np.uint64(0x9FB21C651E98DF25) + mix(self.word))
        self.words, self.word_at = np.unique(self.word, return_inverse=True)
        self.pairs, self.pair_at = np.unique(pair, return_inverse=True)

    def context_counts(self, word_counts: np.ndarray, documents: int) -> np.ndarray:
        """How often each token's context stands before a token in training."""
        at = np.minimum(np.searchsorted(self.words, self.before), max(0, len(self.words) - 1))
        return np.where(self.before == BEGIN, documents, word_counts[at])


def _range(keys: np.ndarray, ranges: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)


def _blocks(batches):
    """(block number, rows) in the order of a scan, so that every pass over the same scan agrees.
    Tuning rows have blocks of their own, with odd numbers."""
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        _, at = utf8(batch.column("text"))
        for a, b in slices(at, BLOCK_BYTES):
            part = batch.slice(a, b - a)
            tuning = part.column("fold").to_numpy(zero_copy_only=False) == TUNING
            for odd in (0, 1):
                if (rows := np.flatnonzero(tuning == odd)).size:
                    yield number + odd, part.take(pa.array(rows))
            number += 2


def _packed(values: np.ndarray) -> bytes:
    """Counts in the narrowest of three widths, told by the first byte."""
    top = int(values.max()) if len(values) else 0
    width = 1 if top < 1 << 8 else 4 if top < 1 << 32 else 8
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


_ASK = "kind int, part int, block long, keys binary, counts binary"
_ANSWER = "kind int, part int, block long, counts binary, total long, distinct long"


def _asker(ranges: int):
    def rows(batches):
        for block, docs in _blocks(batches):
            events = Events(docs.column("text"))
            train = docs.column("fold").to_numpy(zero_copy_only=False)[events.doc] != HELD_OUT
            out = []
            for kind, (keys, at) in enumerate(((events.words, events.word_at), (events.pairs, events.pair_at))):
                counts = np.bincount(at[train], minlength=len(keys))
                cut = np.searchsorted(_range(keys, ranges), np.arange(ranges + 1))
                # a range owns the leading bits, so 48 further bits tell its keys apart
                low = keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
                for r in np.flatnonzero(np.diff(cut)):
                    a, b = cut[r], cut[r + 1]
                    out.append((kind, int(r), block, low[a:b].tobytes(), _packed(counts[a:b])))
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["kind", "part", "block", "keys", "counts"])

    return rows


def _answer(rows: pa.Table) -> pa.Table:
    pa.default_memory_pool().release_unused()  # of the group before
    blobs = rows.column("keys").to_pylist()
    length = np.array([len(b) // 6 for b in blobs])
    wide = np.zeros((int(length.sum()), 8), np.uint8)
    wide[:, :6] = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, 6)
    _, at = np.unique(wide.view("<u8").ravel(), return_inverse=True)
    counts = np.concatenate([_unpacked(c) for c in rows.column("counts").to_pylist()])
    totals = np.bincount(at, weights=counts).astype(np.int64)
    cut = np.concatenate([[0], np.cumsum(length)])
    said = [_packed(totals[at[a:b]]) for a, b in zip(cut[:-1], cut[1:])]
    n = len(blobs)
    first = np.arange(n) == 0  # the range's own figures, once
    return pa.Table.from_arrays(
        [rows.column("kind"), rows.column("part"), rows.column("block"), pa.array(said, pa.binary()), pa.array(np.where(first, counts.sum(), 0)), pa.array(np.where(first, (totals > 0).sum(), 0))],
        names=["kind", "part", "block", "counts", "total", "distinct"],
    )


def _placer(tuning_only: bool):
    def rows(batches):
        for block, docs in _blocks(batches):
            if block % 2 or not tuning_only:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(docs.num_rows, block)), docs.column("doc_id"), docs.column("fold"), docs.column("text")], ["block", "doc_id", "fold", "text"])

    return rows


class Model:
    """Corpus totals and mixture weights by context bucket."""

    def __init__(self, tokens: int, types: int, documents: int):
        self.tokens, self.types, self.documents = tokens, types, documents
        self.weights = np.zeros(BUCKETS)

    def unigram(self, counts: np.ndarray, deleted: int = 0) -> np.ndarray:
        return (counts - deleted + ADDED) / (self.tokens - deleted + ADDED * (self.types + 1))

    def tune(self, bucket: np.ndarray, cell: np.ndarray, n: np.ndarray, rounds: int = 60) -> None:
        """Expectation-maximisation of each bucket's weight on a histogram of likelihood ratios."""
        for b in range(BUCKETS):
            own = bucket == b
            if not own.any():
                continue
            ratio = np.where(cell[own] == NEVER, 0.0, np.exp((cell[own] + 0.5) / CELLS))
            mass, w = n[own].astype(float), 0.5
            for _ in range(rounds):
                w = float((mass * w * ratio / (w * ratio + 1 - w)).sum() / mass.sum())
            self.weights[b] = min(max(w, 1e-6), 1 - 1e-3)


#: The histogram cell of events whose bigram the counts have not seen.
NEVER = -(1 << 20)


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(context, 1)).astype(np.int64), BUCKETS - 1)


def _counts_of(events: Events, answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    kind, part = answers.column("kind").to_numpy(), answers.column("part").to_numpy()
    said = answers.column("counts").to_pylist()
    out = []
    for k, keys in enumerate((events.words, events.pairs)):
        order = [i for i in np.argsort(part, kind="stable") if kind[i] == k]
        counts = np.concatenate([_unpacked(said[i]) for i in order] or [np.zeros(0, np.int64)])
        if len(counts) != len(keys):
            raise ValueError("a block's answers do not fit its texts: the documents changed between two passes; stage them first")
        out.append(counts)
    return out[0], out[1]


def _histogram(model: Model):
    def rows(docs: pa.Table, answers: pa.Table) -> pa.Table:
        pa.default_memory_pool().release_unused()  # of the block before
        events = Events(docs.column("text"))
        words, pairs = _counts_of(events, answers)
        context = events.context_counts(words, model.documents) - 1
        both, single = pairs[events.pair_at] - 1, words[events.word_at]
        seen = context > 0
        ratio = np.maximum(both[seen], 0) / context[seen] / model.unigram(single[seen], 1)
        cell = np.where(ratio > 0, np.floor(np.log(np.maximum(ratio, 1e-300)) * CELLS), NEVER).astype(np.int64)
        keys, n = np.unique(np.stack([_bucket(context[seen]), cell]), axis=1, return_counts=True)
        return pa.Table.from_arrays([pa.array(keys[0]), pa.array(keys[1]), pa.array(n)], names=["bucket", "cell", "n"])

    return rows


_SCORED = "doc_id long, fold long, n_tokens long, n_known long, base_score double, score double"


def _scorer(model: Model):
    def rows(docs: pa.Table, answers: pa.Table) -> pa.Table:
        pa.default_memory_pool().release_unused()  # of the block before
        events = Events(docs.column("text"))
        words, pairs = _counts_of(events, answers)
        context = events.context_counts(words, model.documents)
        single = words[events.word_at]
        plain = model.unigram(single)
        share = np.where(context > 0, model.weights[_bucket(context)], 0.0)
        mixed = share * pairs[events.pair_at] / np.maximum(context, 1) + (1 - share) * plain
        n = docs.num_rows
        add = lambda x: np.bincount(events.doc, x, n)
        return pa.Table.from_arrays(
            [docs.column("doc_id"), docs.column("fold"), pa.array(events.tokens), pa.array(add(single > 0).astype(np.int64)), pa.array(add(np.log10(plain))), pa.array(add(np.log10(mixed)))],
            names=["doc_id", "fold", "n_tokens", "n_known", "base_score", "score"],
        )

    return rows


def lm_scores(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null text is empty and has one token, the end; so have empty texts. A null doc_id counts as the
    empty string when folds are dealt. With no training rows every count is 0 and both scores are those of
    the added counts. docs is scanned several times and must give the same rows in the same order each
    time, as a table does; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long"), fold().cast("long").alias("fold"), "text")
    if not ranges:  # a range's keys are what one task answers, so ranges grow in number with the texts
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        ranges = max(shuffle_width(docs.sparkSession, 4), size // RANGE_BYTES)
    asked = docs.mapInArrow(frugal(_asker(ranges)), _ASK)
    answers = stage(asked.groupBy("kind", "part").applyInArrow(_answer, _ANSWER), "counts")
    sums = answers.where("kind = 0").agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n"), F.coalesce(F.sum("distinct"), F.lit(0)).alias("v")).first()
    model = Model(sums["n"], sums["v"], docs.where(F.col("fold") != HELD_OUT).count())
    said = answers.select("kind", "part", "block", "counts")
    placed = "block long, doc_id long, fold long, text string"
    together = lambda tuning: docs.mapInArrow(frugal(_placer(tuning)), placed).groupBy("block").cogroup((said.where("block % 2 = 1") if tuning else said).groupBy("block"))
    bars = together(True).applyInArrow(_histogram(model), "bucket long, cell long, n long")
    bars = bars.groupBy("bucket", "cell").agg(F.sum("n").alias("n")).toPandas()  # at most BUCKETS times the cells
    model.tune(bars["bucket"].to_numpy(), bars["cell"].to_numpy(), bars["n"].to_numpy())
    scored = together(False).applyInArrow(_scorer(model), _SCORED)
    return scored.select("doc_id", (F.col("fold") == HELD_OUT).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op10_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
