"""Line deduplication."""

import random
from collections import defaultdict

import numpy as np
import pytest

from gridlens.llm import lines, ranges
from gridlens.llm.common import SEPARATORS

from .helpers import CLASHING, lower, odd_docs, odd_rows


def brute(rows, least=20, docs=3):
    key = lambda line: lower(line.strip(SEPARATORS))
    holds = defaultdict(dict)
    for r, (doc_id, text, *_) in enumerate(rows):
        for line in (text or "").split("\n"):
            holds[key(line)][r] = doc_id
    gone = {k: max((i for i in own.values() if i is not None), default=None) for k, own in holds.items() if len(k) >= least and len(own) >= docs}
    out = []
    for doc_id, text, *_ in rows:
        all_lines = (text or "").split("\n")
        stay = [x for x in all_lines if key(x) not in gone or gone[key(x)] == doc_id]
        out.append((doc_id, len(all_lines), len(all_lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


def line_rows():
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice(["alpha", "Beta", "gamma", "Délta", "epsilon"]) + str(rng.randint(0, 9)) for _ in range(n))
    pool = [say(rng.randint(2, 6)) for _ in range(25)]
    rows = []
    for i in range(120):
        own = [rng.choice(pool) if rng.random() < 0.6 else say(5) for _ in range(rng.randint(0, 9))]
        own = [rng.choice(["", " ", "\t\r"]) + (x.upper() if rng.random() < 0.2 else x) + rng.choice(["", "  ", "\x0b"]) for x in own]
        rows.append((i * 7 - 50, "\n".join(own), "en", "web", 0))
    hot = "the very same line in a third of all the rows"
    rows += [(1000 + i, f"{hot}\nown line number {i} of this row\n{hot}\n", None, None, 0) for i in range(60)]
    rows += [(None, f"{hot}\n", None, None, 0), (None, "null line, long enough to be a repeat", None, None, 0)] * 2
    rows += [(None, "null line, long enough to be a repeat", None, None, 0), rows[3], rows[3]]
    rows += [(2000 + i, "ß" * 19 + "\n" + "ß" * 20 + "\n\n", None, None, 0) for i in range(4)]  # short by code points, not by bytes
    rows += [(2**62 + i, "line of very large ids, twenty points", None, None, 0) for i in range(3)]
    return rows


def got(df):
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("make", [odd_rows, line_rows])
def test_lines_brute_force(spark, make):
    rows = make()
    assert got(lines.without_repeated_lines(odd_docs(spark, rows))) == brute(rows)


def test_lines_other_limits_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(lines, "BLOCK_KEYS", 7)  # many blocks, many answers
    rows = line_rows()
    assert got(lines.without_repeated_lines(odd_docs(spark, rows), 5, 2)) == brute(rows, 5, 2)


def test_lines_empty_table_and_columns(spark):
    assert lines.without_repeated_lines(odd_docs(spark, [])).count() == 0
    docs = odd_docs(spark, [(1, None, None, None, 0), (2, "", None, None, 0)])
    out = lines.without_repeated_lines(docs)
    assert set(CLASHING) <= set(out.columns) and got(out) == [(1, 1, 0, ""), (2, 1, 0, "")]


def test_suspects_miss_no_repeat_and_few_else():
    rng = np.random.default_rng(2)
    space = rng.integers(1, 1 << 62, 60_000, dtype=np.uint64)
    tags = [np.unique(rng.choice(space, 4_000)) for _ in range(12)]
    counts = [rng.integers(1, 20, len(t)) // 19 + 1 for t in tags]
    seen = defaultdict(int)
    for tag, count in zip(tags, counts):
        for t, c in zip(tag.tolist(), count.tolist()):
            seen[t] += c
    said = lines.suspects(tags, counts)
    wrong = once = 0
    for tag, marks in zip(tags, said):
        for t, mark in zip(tag.tolist(), marks.tolist()):
            assert mark or seen[t] < 2
            once += seen[t] < 2
            wrong += bool(mark and seen[t] < 2)
    assert wrong < 0.03 * once


def test_ranges_answer_in_the_order_of_the_keys(spark):
    rng = np.random.default_rng(3)
    blocks = {b: np.unique(rng.integers(0, 1 << 63, 500, dtype=np.uint64)) for b in range(4)}
    blocks[3] = blocks[1]
    frames = [ranges.asked(b, k, k, np.arange(len(k)) * 300, 9).to_pandas() for b, k in blocks.items()]
    import pandas as pd

    asked = spark.createDataFrame(pd.concat(frames), ranges.ASK)
    total = lambda tags, counts: [np.array([sum(int(c[np.flatnonzero(t == x)].sum()) for t, c in zip(tags, counts)) for x in tag]) for tag in tags]
    import pyarrow as pa

    out = pa.Table.from_pandas(ranges.answers(asked, total).toPandas(), preserve_index=False)
    for b, k in blocks.items():
        own = out.filter(pa.array((out.column("block").to_numpy() == b)))
        assert ranges.told(own, len(k)).tolist() == (np.arange(len(k)) * 300 * (2 if b in (1, 3) else 1)).tolist()
    with pytest.raises(ValueError):
        ranges.told(out, 3)
