"""Phrase collocations from word-id suffix arrays.

Documents are dealt into shards. A shard numbers its words and sorts its suffixes by prefix doubling, until
prefixes are as long as the longest phrase; the intervals of suffixes whose common prefix is at least m words
long are its phrases of m words, and an interval's length is the phrase's count. Shards send keys and
counts to the ranges of the key space and get the counts over all shards back, so one shard per
phrase, the first that its range saw, can write it down with the counts of all of its parts: a shard that holds a
phrase holds them too. What longer phrases take is found there as well.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ranges
from .common import _LOWER, Spans, mix, shuffle_width, slices, small, stage, utf8, word_bounds

#: Words of the longest phrase, its least count, the share of a phrase's count (percent) in one longer phrase
#: that makes it a part of that, and the phrases listed for a language.
LONGEST, LEAST, PART_PERCENT, TOP = 3, 10, 50, 2000
#: Bytes of text in a shard, at most about (a longer single text is in one shard).
SHARD_BYTES = 5 << 20
#: A text has a key per phrase length and word, words are this many bytes at least on average.
WORD_BYTES = 5
UNKNOWN = "und"
_ENDS_PIECE = np.zeros(256, bool)
_ENDS_PIECE[list(b".,;:!?\n\x0b\x0c\r")] = True
_APART = _ENDS_PIECE.copy()
_APART[list(b" \t")] = True
_ORDER, _TAG = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Shard:
    """The words of some texts in a row: where they are, a hash of each with its text's language, and
    the words left in the piece from each on."""

    def __init__(self, column: pa.Array, lang: pa.Array):
        data, at = utf8(column)
        self.text = _LOWER[data]
        names = lang.combine_chunks() if isinstance(lang, pa.ChunkedArray) else lang
        coded = names.dictionary_encode()
        self.langs = coded.dictionary.to_pylist()
        lang_of = coded.indices.to_numpy(zero_copy_only=False)
        salt = np.array([int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little") for name in self.langs], np.uint64)
        starts, ends, words, pieces, doc = [], [], [], [], []
        before = 0
        for a, b in slices(at):
            part, offsets = self.text[at[a] : at[b]], at[a : b + 1] - at[a]
            s, e, count = word_bounds(part, offsets, _APART)
            own = np.repeat(np.arange(a, b), np.diff(count))
            breaks = np.cumsum(_ENDS_PIECE[part])
            starts.append(s + at[a])
            ends.append(e + at[a])
            words.append(Spans(part).hash(s, e))
            doc.append(own)
            # a piece is told by its text and the breaks before it
            pieces.append((breaks[s] if len(s) else s) + own + before)
            before += int(breaks[-1]) if len(breaks) else 0
        cat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.starts, self.ends = cat(starts, np.int64), cat(ends, np.int64)
        self.lang = lang_of[cat(doc, np.int64)] if len(self.starts) else np.zeros(0, np.int64)
        self.word = mix(cat(words, np.uint64) ^ salt[self.lang]) if len(self.starts) else np.zeros(0, np.uint64)
        piece = cat(pieces, np.int64)
        first = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]])) if len(piece) else np.zeros(0, np.int64)
        length = np.diff(np.append(first, len(piece)))
        self.left = np.repeat(first + length, length) - np.arange(len(piece))

    def suffixes(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes in the order of their first words, of `depth` words or more (an order of word numbers,
        a piece's end comes before all words), and the first words of each as its number."""
        n = len(self.word)
        order = np.argsort(self.word, kind="stable")
        rank, known = _ranks(order, self.word), 1
        self.number = rank.copy()
        while known < depth:
            key = rank * (n + 1)
            far = np.flatnonzero(self.left > known)
            key[far] += rank[far + known] + 1
            order = np.argsort(key, kind="stable")
            rank, known = _ranks(order, key), 2 * known
        return order, rank

    def common_prefixes(self, order: np.ndarray, most: int) -> np.ndarray:
        """Of each suffix but the first in order: the words, up to `most`, that it shares with the one before."""
        if not len(order):
            return np.zeros(0, np.int64)
        a, b = order[:-1], order[1:]
        lcp, same = np.zeros(len(b), np.int64), np.ones(len(b), bool)
        for m in range(most):
            same &= (self.left[a] > m) & (self.left[b] > m)
            at = np.flatnonzero(same)
            same[at] = self.number[a[at] + m] == self.number[b[at] + m]
            lcp += same
        return lcp

    def phrases(self, longest: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each length m from 1: a place of each phrase, its count, and the phrase's number at every place
        (-1 where fewer than m words are left)."""
        order, _ = self.suffixes(longest)
        lcp = self.common_prefixes(order, longest)
        out = []
        for m in range(1, longest + 1):
            new = np.concatenate([[True], lcp < m]) if len(order) else np.zeros(0, bool)
            opens = np.flatnonzero(new)
            count = np.diff(np.append(opens, len(order)))
            full = self.left[order[opens]] >= m
            number = np.where(full, np.cumsum(full) - 1, -1)
            at = np.empty(len(order), np.int64)
            at[order] = np.repeat(number, count)
            out.append((order[opens[full]], count[full], at))
        return out

    def keys(self, places: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
        """Two independent hashes of the phrases of m words at places: one orders, one tells apart."""
        order = tag = np.full(len(places), m, np.uint64)
        for k in range(m):
            word = self.word[places + k]
            order, tag = (order + word) * _ORDER, mix(tag * _TAG + word)
        return mix(order), tag

    def phrase(self, place: int, m: int) -> str:
        return b" ".join(self.text[a:b].tobytes() for a, b in zip(self.starts[place : place + m].tolist(), self.ends[place : place + m].tolist())).decode("utf-8", "replace")


def _ranks(order: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The dense rank of each key, given their order."""
    rank = np.empty(len(key), np.int64)
    if len(key):
        sorted_ = key[order]
        rank[order] = np.cumsum(np.concatenate([[False], sorted_[1:] != sorted_[:-1]]))
    return rank


def _questions(shard: Shard, longest: int):
    """The shard's phrases, and all their keys, tags and counts in the order of the keys."""
    found = shard.phrases(longest)
    both = [shard.keys(places, m) for m, (places, _, _) in enumerate(found, 1)]
    keys, tags = (np.concatenate(x) for x in zip(*both))
    order = np.argsort(keys, kind="stable")
    return found, keys, tags, order


def _asker(longest: int, parts: int):
    def run(rows: pa.Table) -> pa.Table:
        found, keys, tags, order = _questions(Shard(rows.column("text"), rows.column("lang")), longest)
        counts = np.concatenate([count for _, count, _ in found])
        ask = ranges.asked(rows.column("shard")[0].as_py(), keys[order], tags[order], counts[order], parts)
        pa.default_memory_pool().release_unused()  # workers are reused
        return pa.Table.from_batches([ask])

    return run


def _totals(least: int):
    def judge(tags: list[np.ndarray], counts: list[np.ndarray]) -> list[np.ndarray]:
        """Twice the count over all shards, 0 below least, and 1 more in the first shard that holds the key."""
        _, first, at = np.unique(np.concatenate(tags), return_index=True, return_inverse=True)
        total = np.zeros(len(first), np.int64)
        np.add.at(total, at, np.concatenate(counts))
        total[total < least] = 0
        said = 2 * total[at]
        said[first] += total > 0
        return np.split(said, np.cumsum([len(t) for t in tags])[:-1])

    return judge


_FOUND = "lang string, phrase string, a long, ls array<long>, rs array<long>"


def _writer(longest: int, percent: int):
    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        shard = Shard(rows.column("text"), rows.column("lang"))
        found, keys, _, order = _questions(shard, longest)
        said = np.empty(len(keys), np.int64)
        said[order] = ranges.told(answers, len(keys))
        langs, phrases, counts, lefts, rights = [], [], [], [], []
        totals, cut = [], 0  # totals[m - 1]: the count of the m words from each place on
        for places, _, at in found:
            own = said[cut : cut + len(places)]
            cut += len(places)
            totals.append(np.where(at >= 0, np.append(own >> 1, 0)[at], 0))
        cut = len(found[0][0]) if found else 0
        for m, (places, _, _) in enumerate(found[1:], 2):
            own = said[cut : cut + len(places)]
            cut += len(places)
            here = places[(own & 1) > 0]
            a = totals[m - 1][here]
            langs += [shard.langs[i] for i in shard.lang[here].tolist()]
            phrases += [shard.phrase(p, m) for p in here.tolist()]
            counts += a.tolist()
            lefts += np.stack([totals[k - 1][here] for k in range(1, m)], 1).tolist()
            rights += np.stack([totals[m - k - 1][here + k] for k in range(1, m)], 1).tolist()
            for size in range(2, m):
                for k in range(m - size + 1):  # parts of which this phrase takes the share
                    takes = np.flatnonzero(100 * a >= percent * totals[size - 1][here + k])
                    langs += [shard.langs[i] for i in shard.lang[here[takes]].tolist()]
                    phrases += [shard.phrase(p + k, size) for p in here[takes].tolist()]
                    for more in (counts, lefts, rights):
                        more += [None] * len(takes)
        each = np.bincount(shard.lang, minlength=len(shard.langs))
        langs += shard.langs
        phrases += [None] * len(shard.langs)
        counts += each.tolist()
        lefts += [None] * len(each)
        rights += [None] * len(each)
        whole = pa.list_(pa.int64())
        pa.default_memory_pool().release_unused()
        del shard, found, keys, order, said, totals
        return pa.Table.from_arrays([pa.array(langs, pa.string()), pa.array(phrases, pa.string()), pa.array(counts, pa.int64()), pa.array(lefts, whole), pa.array(rights, whole)], names=["lang", "phrase", "a", "ls", "rs"])

    return run


def ranked(rows: DataFrame, group: str, order: list, top: int) -> DataFrame:
    """The first `top` rows of each group with their `rank` from 1. Rows are sorted over all tasks by group and
    order, so neither a large group nor ties gather in a task; ranks come from the counts of the tasks."""
    width = shuffle_width(rows.sparkSession)
    keys = [F.col(group).asc(), *order]
    run = F.shiftright("_at", 33)
    cut = stage(rows.repartitionByRange(width, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()).withColumn("_run", run), "sorted")
    runs = cut.groupBy(group, "_run").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(group).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = stage(runs.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).where(F.col("_before") < top).select(group, "_run", "_first", "_before"), "runs")
    return cut.join(small(runs), [group, "_run"]).withColumn("rank", F.col("_at") - F.col("_first") + F.col("_before") + 1).where(F.col("rank") <= top).drop("_at", "_run", "_first", "_before")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, percent: int = PART_PERCENT, top: int = TOP) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score, all numbers long.

    Words are runs of bytes other than blanks and tabs inside pieces, which end at . , ; : ! ? and line breaks;
    A-Z are lower-cased. Phrases have 2 to `longest` words of one piece and `least` occurrences (a); l and r
    are those of the two parts of the cut with the lowest floor(1000000 * a * a / (l * r)), the first of equal
    ones; n is the language's words. Phrases of which one longer phrase holds `percent` of the occurrences
    or more are left out. Null lang is `und`, together with rows whose lang is that; null text is empty. Rows that repeat
    count each. Ties in score go to the larger a, then to the phrase in byte order. Languages without
    such phrases have no rows. Other columns are ignored. Phrases are told by 64-bit hashes within a range
    of hashes of another kind. doc_id and text deal the rows to shards.
    """
    spark = docs.sparkSession
    docs = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.col("doc_id").cast("string"), "text").alias("own"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(shuffle_width(spark), size // SHARD_BYTES)
    rows = docs.select(F.pmod("own", F.lit(shards)).alias("shard"), "lang", "text").groupBy("shard")
    parts = ranges.range_count(shuffle_width(spark), longest * size // WORD_BYTES // 2)
    said = ranges.answers(rows.applyInArrow(_asker(longest, parts), ranges.ASK), _totals(least))
    found = stage(rows.cogroup(said.withColumnRenamed("block", "shard").groupBy("shard")).applyInArrow(_writer(longest, percent), _FOUND), "phrases")
    n = stage(found.where("phrase IS NULL").groupBy("lang").agg(F.sum("a").alias("n")), "words")
    gone = found.where("phrase IS NOT NULL AND a IS NULL").select("lang", "phrase").distinct()
    stay = found.where("phrase IS NOT NULL AND a IS NOT NULL").join(gone, ["lang", "phrase"], "left_anti")
    # products of counts pass 64 bits; a score is at most 1000000, as no part is rarer than the phrase
    big = "CAST({} AS DECIMAL(19, 0))"
    score = f"1000000 * ({big.format('a')} * {big.format('a')}) div ({big.format('ls[k]')} * {big.format('rs[k]')})"
    worst = F.expr(f"array_min(transform(sequence(0, size(ls) - 1), k -> struct({score} AS score, k AS k, ls[k] AS l, rs[k] AS r)))")
    scored = stage(stay.select("lang", "phrase", "a", worst.alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"), "scored")
    best = ranked(scored, "lang", [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()], top)
    return best.join(small(n), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrase_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
u AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, w[i:i + m - 1] AS x
  FROM u, (VALUES (1), (2), (3)) AS s(m) WHERE i + m - 1 <= len(w)),
f AS MATERIALIZED (SELECT lang, m, phrase, any_value(x) AS x, CAST(count(*) AS HUGEINT) AS f FROM g GROUP BY lang, m, phrase HAVING count(*) >= 10),
n AS (SELECT lang, count(*) AS n FROM g WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, x, f AS a, unnest(range(1, m)) AS k FROM f WHERE m >= 2),
s AS (
  SELECT c.lang, c.m, c.phrase, c.a, c.k, y.f AS l, z.f AS r, 1000000 * c.a * c.a // (y.f * z.f) AS score
  FROM c JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.x[1:k], ' ')
         JOIN f z ON z.lang = c.lang AND z.phrase = array_to_string(c.x[k + 1:c.m], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
t AS (
  SELECT lang, array_to_string(x[1:2], ' ') AS phrase, f FROM f WHERE m = 3
  UNION ALL SELECT lang, array_to_string(x[2:3], ' '), f FROM f WHERE m = 3),
h AS (SELECT lang, phrase, max(f) AS top FROM t GROUP BY lang, phrase),
k AS (SELECT b.* FROM b LEFT JOIN h ON h.lang = b.lang AND h.phrase = b.phrase AND b.m = 2 WHERE h.top IS NULL OR 100 * h.top < 50 * b.a),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM k)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score
FROM o JOIN n USING (lang) WHERE rank <= 2000
"""
