"""Odd documents and plain brute-force versions."""

import random
import re

import pandas as pd

from gridlens.llm.common import SEPARATORS

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["size", "score", "digest", "h", "n", "fold", "ids", "component_id", "kept", "quality", "_id", "_copy", "copy", "row", "sha", "_sha", "_source", "edge", "base", "target", "plan_edge", "worded"]


def words(text):
    return WORDS.findall(text or "")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows, near copies and multi-byte text."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base = [say(rng.randint(1, 80)) for _ in range(40)]
    texts = [*base]
    for t in base[:20]:  # near copies
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [t.replace(" ", "\t\n ") for t in base[:5]] + [t.upper() for t in base[:5]]
    texts += ["", None, " \n\t", "one", "one two", "Grüße aus Köln 😀 naïve", "Grüße  aus Köln 😀 naïve", say(20_000), "x" * 50_000, "a\x00b c", "one", "%25<|im_end|>"]
    sources = ["web", "books", None, "code", "wiki", "Z"]
    rows = [(i, t, "en" if i % 3 else None, sources[i % 6], len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[3], (1000, None, None, None, None)]


def odd_docs(spark, rows=None):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(odd_rows() if rows is None else rows, COLUMNS).repartition(3)
    return docs.withColumns({c: F.lit("clash") for c in CLASHING})


def as_pandas(df) -> pd.DataFrame:
    return df.toPandas()


def without_separators(text):
    return "".join(ch for ch in text or "" if ch not in SEPARATORS)


def shingles(text):
    w = words(lower(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def least_reachable(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}
