"""Phrase collocations."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridlens.llm import phrases

from .helpers import lower, odd_docs, odd_rows

PIECES, WORDS = re.compile("[.,;:!?\x0a-\x0d]"), re.compile("[^\x20\x09]+")


def pieces(text):
    return [WORDS.findall(p) for p in PIECES.split(lower(text))]


def brute(rows, longest=3, least=10, percent=50, top=2000):
    out = []
    by_lang = {}
    for _, text, lang, *_ in rows:
        by_lang.setdefault(lang or "und", []).append(text)
    for lang, texts in by_lang.items():
        f = Counter()
        for text in texts:
            for w in pieces(text):
                f.update(tuple(w[i : i + m]) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
        n = sum(c for x, c in f.items() if len(x) == 1)
        cand = {x: a for x, a in f.items() if len(x) > 1 and a >= least}
        rank = []
        for x, a in cand.items():
            inside = any(len(y) > len(x) and 100 * b >= percent * a and any(y[i : i + len(x)] == x for i in range(len(y))) for y, b in cand.items())
            if not inside:
                score, _, left, right = min((1000000 * a * a // (f[x[:k]] * f[x[k:]]), k, f[x[:k]], f[x[k:]]) for k in range(1, len(x)))
                rank.append((-score, -a, " ".join(x).encode(), left, right))
        for i, (score, a, phrase, left, right) in enumerate(sorted(rank)[:top], 1):
            out.append((lang, i, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def phrase_rows():
    rng = random.Random(9)
    vocabulary = ["New", "york", "City", "of", "the", "straße", "x", "y", "zz", "naïve"]
    fixed = ["New York City", "san francisco bay area", "of the", "a b c d", "Straße nach Köln"]
    rows = []
    for i in range(150):
        parts = [rng.choice(fixed) if rng.random() < 0.3 else rng.choice(vocabulary) for _ in range(rng.randint(0, 25))]
        rows.append((i, "".join(p + rng.choice([" ", "  ", "\t", ". ", ",", "\n", "!?", "\x0b "]) for p in parts), rng.choice(["en", "en", "de", None, "und"]), None, 0))
    rows += [(1000 + i, "same words again and again", "en", None, 0) for i in range(80)]
    rows += [(None, "same words again and again", None, None, 0), (None, None, None, None, 0), (5, "", "fr", None, 0), rows[4], rows[4]]
    return rows


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("make,how", [(odd_rows, {"least": 2}), (phrase_rows, {}), (phrase_rows, {"longest": 5, "least": 3, "percent": 70}), (phrase_rows, {"least": 3, "top": 7})])
def test_collocations_brute_force(spark, monkeypatch, make, how):
    monkeypatch.setattr(phrases, "SHARD_BYTES", 2000)
    monkeypatch.setattr(phrases.ranges, "RANGE_KEYS", 500)
    rows = make()
    docs = odd_docs(spark, rows).withColumns({c: F.lit("clash") for c in ("phrase", "a", "rank", "shard", "l", "block", "own")})
    want = brute(rows, **how)
    assert want and got(phrases.collocations(docs, **how)) == want


def test_collocations_empty(spark):
    assert phrases.collocations(odd_docs(spark, [])).count() == 0
    assert phrases.collocations(odd_docs(spark, [(1, None, None, None, 0), (2, " .,\n", "en", None, 0)])).count() == 0


def test_scores_of_counts_beyond_64_bits(spark):
    # the score's expression on counts whose products pass 64 bits
    a, left, right = 3_000_000_000_000, 3_000_000_000_001, 4_000_000_000_000
    big = "CAST({} AS DECIMAL(19, 0))"
    row = spark.createDataFrame([(a, left, right)], "a long, l long, r long")
    said = row.selectExpr(f"1000000 * ({big.format('a')} * {big.format('a')}) div ({big.format('l')} * {big.format('r')}) AS s").first()["s"]
    assert said == 1000000 * a * a // (left * right)


def test_suffix_order_and_prefixes():
    texts = pa.array(["b a b a b, a b", "a b a", "", "b a b"])
    shard = phrases.Shard(texts, pa.array(["en"] * 4))
    order, _ = shard.suffixes(8)
    suffix = lambda i: tuple(shard.number[i : i + shard.left[i]].tolist())
    assert [suffix(i) for i in order] == sorted(suffix(i) for i in range(len(shard.word)))
    lcp = shard.common_prefixes(order, 9)
    for x, y, n in zip(order, order[1:], lcp):
        a, b = suffix(x), suffix(y)
        assert n == next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
    want = Counter()
    for p in ["b a b a b", "a b", "a b a", "b a b"]:
        w = p.split()
        want.update(" ".join(w[i : i + m]) for m in (1, 2, 3) for i in range(len(w) - m + 1))
    said = {shard.phrase(p, m): c for m, (places, counts, _) in enumerate(shard.phrases(3), 1) for p, c in zip(places.tolist(), counts.tolist())}
    assert said == want


def test_languages_keep_their_words_apart():
    shard = phrases.Shard(pa.array(["a b", "a b"]), pa.array(["en", "de"]))
    places, counts, _ = shard.phrases(2)[1]
    assert counts.tolist() == [1, 1] and sorted(shard.langs[shard.lang[p]] for p in places) == ["de", "en"]


def test_ranked_over_many_tasks(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 5)).alias("g"), (F.col("id") % 4).alias("v"), "id").repartition(7)
    said = phrases.ranked(rows, "g", [F.col("v").desc(), F.col("id").asc()], 50).collect()
    table = rows.collect()
    for g in {r["g"] for r in table}:
        own = sorted((-r["v"], r["id"]) for r in table if r["g"] == g)[:50]
        assert [(r["rank"], -r["v"], r["id"]) for r in sorted(said, key=lambda r: r["rank"]) if r["g"] == g] == [(i, *x) for i, x in enumerate(own, 1)]


def test_unicode_in_shards():
    shard = phrases.Shard(pa.array(["ÄB äb", "x" * 100_000 + " y", None]), pa.array(["de", "de", "und"]))
    assert np.diff(np.stack([shard.starts, shard.ends]), axis=0).ravel().tolist() == [3, 3, 100_000, 1]
