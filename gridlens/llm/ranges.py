"""Blocks of rows ask about their keys; the ranges of the key space that own the keys answer.

A block sends its distinct keys with its own counts, packed, to the ranges. A range sees all blocks' keys
of its part of the space and answers each block in the order of its keys. So what all blocks know of a key
meets in one shuffle of packed keys and comes back in another, and no task holds more than a range or a
block. A key is told by 64 bits (its tag) and by the range, which depends on other bits of its own.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

ASK = "part int, block long, tags binary, counts binary"
ANSWER = "part int, block long, said binary"
#: Keys that a range gets, at most about.
RANGE_KEYS = 1_000_000
_ASK_NAMES, _ANSWER_NAMES = ([c.split()[0] for c in s.split(", ")] for s in (ASK, ANSWER))


def packed(values: np.ndarray) -> bytes:
    """Whole numbers from 0 in the narrowest of four widths, told by the first byte."""
    top = int(values.max()) if len(values) else 0
    width = next(w for w in (1, 2, 4, 8) if w == 8 or top < 1 << 8 * w)
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def range_count(width: int, keys: int) -> int:
    return int(min(1 << 30, max(width, keys // RANGE_KEYS)))


def asked(block: int, keys: np.ndarray, tags: np.ndarray, counts: np.ndarray, ranges: int) -> pa.RecordBatch:
    """The rows by which a block asks about its keys, which are in ascending order."""
    part = ((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
    cut = [*first.tolist(), len(part)]
    raw, n = tags.astype("<u8"), len(first)
    cols = [
        pa.array(part[first].astype(np.int32)),
        pa.array(np.full(n, block, np.int64)),
        pa.array([raw[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary()),
        pa.array([packed(counts[a:b]) for a, b in zip(cut, cut[1:])], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(cols, _ASK_NAMES)


def answers(questions: DataFrame, judge: Callable[[list[np.ndarray], list[np.ndarray]], list[np.ndarray]]) -> DataFrame:
    """The answers to rows of ASK. judge takes a range's tags and counts, an array per block, and gives an
    array of whole numbers from 0 per block."""

    def run(rows: pa.Table) -> pa.Table:
        tags = [np.frombuffer(t, "<u8") for t in rows.column("tags").to_pylist()]
        counts = [unpacked(c) for c in rows.column("counts").to_pylist()]
        said = pa.array([packed(s) for s in judge(tags, counts)], pa.binary())
        pa.default_memory_pool().release_unused()  # workers are reused
        return pa.Table.from_arrays([rows.column("part"), rows.column("block"), said], names=_ANSWER_NAMES)

    return questions.select(*_ASK_NAMES).groupBy("part").applyInArrow(run, ANSWER)


def told(rows: pa.Table, expected: int) -> np.ndarray:
    """What a block's answers say of its keys, in their order."""
    said = rows.column("said").to_pylist()
    out = [unpacked(said[i]) for i in np.argsort(rows.column("part").to_numpy())]
    found = np.concatenate(out) if out else np.zeros(0, np.int64)
    if len(found) != expected:
        raise ValueError(f"{len(found)} answers to {expected} questions: the rows changed between two passes; stage them first")
    return found
