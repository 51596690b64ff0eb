"""Exact dedup, mixing, Jaccard join, substring dedup, encoding, language model and classifier."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlens.llm import exact_dedup, lm, mixing, partenum, pieces, quality, substrings

from .helpers import lower, least_reachable, odd_docs, odd_rows, shingles, without_separators, words


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---- exact dedup ----------------------------------------------------------------------------


def test_exact_dedup_brute_force(spark):
    rows = odd_rows()
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[without_separators(text)].append((-len(text or ""), doc_id))
    want = []
    for doc_id, text, *_ in rows:
        own = groups[without_separators(text)]
        keep = min(own)[1]
        want.append((doc_id, keep, len(own), doc_id == keep, hashlib.sha256(without_separators(text).encode()).hexdigest()))
    assert rows_of(exact_dedup.exact_dedup(odd_docs(spark))) == sorted(want, key=repr)


def test_exact_dedup_kept_documents(spark):
    docs = odd_docs(spark)
    kept = exact_dedup.kept_documents(docs).collect()
    assert len(kept) == len({without_separators(r[1]) for r in odd_rows()})
    assert kept[0].asDict().keys() == set(docs.columns)


def test_exact_dedup_empty(spark):
    assert exact_dedup.exact_dedup(odd_docs(spark, [])).count() == 0
    assert exact_dedup.kept_documents(odd_docs(spark, [])).count() == 0


def test_cuckoo_index_insert_delete_resize():
    index = exact_dedup.CuckooIndex(4)
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    assert all(index.add(k, 1, i, 1) for i, k in enumerate(keys))
    assert index.resizes > 0 and index.count == 3000 and max(map(len, index.buckets)) <= exact_dedup.SLOTS
    assert index.denied > 2900  # nearly all new keys were told apart without a look at stored ones
    assert not index.add(keys[7], 2, 9, 5) and index.find(keys[7])[2:] == [2, 9, 6] and index.verified == 2
    assert all(index.find(k) for k in keys)
    assert all(index.delete(k) for k in keys[::2]) and not index.delete(keys[0])
    assert all(index.find(k) for k in keys[1::2]) and not any(index.find(k) for k in keys[::2])
    assert index.add(keys[0], 1, 5, 1)


def test_cuckoo_index_verifies_equal_fingerprints():
    index = exact_dedup.CuckooIndex(4)
    one, two = b"a" * 8 + b"markplace!" + b"x" * 14, b"b" * 8 + b"markplace!" + b"y" * 14
    assert index.add(one, 1, 1, 1) and index.find(two) is None and index.denied == 1
    assert index.add(two, 1, 2, 1) and index.find(one)[3] == 1 and index.find(two)[3] == 2
    for i in range(40):  # more of one place than two buckets hold: the filter can't grow out of it
        assert index.find(one) is not None
    assert index.delete(one) and index.find(one) is None and index.find(two)[3] == 2


def test_update_index_deletes_live_keys(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "ab"), (3, "c"), (6, "e")], "doc_id long, text string")
    live = exact_dedup.stage(exact_dedup.update_index(exact_dedup.digested(docs)), "live")
    gone = exact_dedup.digested(docs.where("doc_id IN (1, 3)")).select("digest")
    more = exact_dedup.digested(spark.createDataFrame([(4, "  a b"), (5, "d"), (7, " e ")], docs.schema))
    out = exact_dedup.update_index(more, live=live, deletes=gone)
    assert sorted((r["keep_id"], r["group_size"]) for r in out.collect()) == [(4, 1), (5, 1), (7, 2)]
    assert {r["bucket"] < r["size"] for r in out.collect()} == {True}
    with pytest.raises(ValueError, match="shards"):
        exact_dedup.update_index(more, live=live.drop("shards"))


def test_lm_ranges_grow_with_the_texts(spark, sf_dir, monkeypatch):
    few = lm.op10_lm_scoring(spark, sf_dir).orderBy("doc_id").collect()
    monkeypatch.setattr(lm, "RANGE_BYTES", 1 << 12)
    many = lm.op10_lm_scoring(spark, sf_dir).orderBy("doc_id").collect()
    assert [r["score"] for r in many] == pytest.approx([r["score"] for r in few], rel=1e-9)
    assert [r["n_known"] for r in many] == [r["n_known"] for r in few]


def test_copies_meet_in_the_index(monkeypatch):
    import pyarrow as pa

    digests = [hashlib.sha256(t.encode()).digest() for t in ("a", "b", "a", "a")]
    batch = pa.RecordBatch.from_pydict({"doc_id": [4, 2, 3, None], "chars": [1, 1, 1, 1], "digest": digests})
    out = {r["digest"]: (r["keep_id"], r["group_size"]) for b in exact_dedup._combine([batch]) for r in b.to_pylist()}
    assert out == {digests[0]: (3, 3), digests[1]: (2, 1)}
    monkeypatch.setattr(exact_dedup.CuckooIndex, "find", lambda self, digest, chars=None: None)  # without the filter copies do not meet
    assert sum(b.num_rows for b in exact_dedup._combine([batch])) == 4


def test_exact_dedup_large_ids(spark):
    ids = [2**62 + 5, 2**62 + 6, 2**63 - 1, -(2**63)]
    docs = odd_docs(spark, [(i, "same text", None, None, 0) for i in ids[:3]] + [(ids[3], "other", None, None, 0), (None, "same  text", None, None, 0), (None, "only", None, None, 0)])
    out = {(r["doc_id"], r["group_size"]): r["keep_id"] for r in exact_dedup.exact_dedup(docs).collect()}
    assert out[ids[0], 4] is None  # the longest text has no id
    assert {r["doc_id"] for r in exact_dedup.kept_documents(docs.where("doc_id IS NOT NULL")).collect()} == {ids[0], ids[3]}
    assert sorted(r["text"] for r in exact_dedup.kept_documents(docs).collect()) == ["only", "other", "same  text"]


# ---- mixing ---------------------------------------------------------------------------------


def test_mixing_totals(spark):
    rows = odd_rows()
    out = mixing.mix_sources(odd_docs(spark)).toPandas()
    assert len(out) == len(rows)
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in out.itertuples():
        key = None if r.source is None or r.source != r.source else r.source
        size[key] += r.size
        taken[key] += r.taken
        target[key] = r.target
        assert 0 <= r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
    true = defaultdict(int)
    for _, text, _, source, _ in rows:
        true[source] += len(words(text))
    assert size == true
    total = sum(true.values())
    # water filling by hand
    names = sorted([s for s in true if s is not None]) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full, want = set(), {}
    while True:
        rest = 1.5 * total - sum(2 * true[s] for s in full)
        open_ = [s for s in names if s not in full]
        want = {s: 2 * true[s] if s in full else rest * weight[s] / sum(weight[t] for t in open_) for s in names}
        over = [s for s in open_ if want[s] > 2 * true[s]]
        if not over:
            break
        full |= set(over)
    for s in names:
        assert target[s] == pytest.approx(want[s])
        largest = max(len(words(t)) for _, t, _, x, _ in rows if x == s)
        assert abs(taken[s] - want[s]) <= 3 * largest  # rows of one id go together


def test_mixed_documents_match_the_verdict(spark):
    docs = odd_docs(spark)
    taken = Counter()
    for r in mixing.mix_sources(docs).where("size > 0").collect():
        taken[r["doc_id"]] += r["taken"] // r["size"]
    out = Counter(r["doc_id"] for r in mixing.mixed_documents(docs).select("doc_id", "text").collect() if words(r["text"]))
    assert out == Counter({k: v for k, v in taken.items() if v})
    again = Counter(r["doc_id"] for r in mixing.mixed_documents(docs.repartition(5)).select("doc_id", "text").collect() if words(r["text"]))
    assert again == out


def test_mixing_empty(spark):
    assert mixing.mix_sources(odd_docs(spark, [])).count() == 0
    assert mixing.mix_sources(odd_docs(spark, [(1, None, None, "a", 0)])).first()["taken"] == 0


# ---- Jaccard join ---------------------------------------------------------------------------


def jaccard_of_rows(rows):
    """(doc_id, shingles, component) of each row; rows are told apart by id and text."""
    sets = {(doc_id, text or ""): shingles(text) for doc_id, text, *_ in rows}
    keys = sorted(sets)
    links = [(a, b) for i, a in enumerate(keys) for b in keys[:i] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    comp = least_reachable(range(len(keys)), [(keys.index(a), keys.index(b)) for a, b in links])
    at = {k: (len(sets[k]), keys[comp[i]][0]) for i, k in enumerate(keys)}
    return [(doc_id, *at[doc_id, text or ""]) for doc_id, text, *_ in rows]


def jaccard_wanted(rows):
    return {doc_id: (n, c) for doc_id, n, c in jaccard_of_rows(rows)}


def test_jaccard_tells_rows_of_one_id_apart(spark):
    base, clean = said(31, 160), said(32, 150)
    near = base.replace(base.split()[80], "changed", 1)
    rows = [(1, base), (2, near), (2, clean), (2, clean), (3, clean.upper()), (3, ""), (4, near), (4, base), (5, said(33, 90)), (7, None), (7, "")]
    rows += [(9, said(40 + i, 30)) for i in range(6)] + [(9, said(43, 30))]
    rows = [(i, t, "en", "web", 0) for i, t in rows]
    out = partenum.jaccard_components(odd_docs(spark, rows)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out) == sorted(jaccard_of_rows(rows))
    kept = partenum.kept_documents(odd_docs(spark, rows))
    assert set(kept.columns) == set(odd_docs(spark, rows).columns)
    left = sorted((r["doc_id"], r["text"] or "") for r in kept.collect())
    assert left == sorted({(1, base), (2, clean), (3, ""), (5, said(33, 90)), (7, ""), *((9, said(40 + i, 30)) for i in range(6))})


def check_jaccard(spark, rows):
    want = jaccard_wanted(rows)
    out = partenum.jaccard_components(odd_docs(spark, rows)).collect()
    assert len(out) == len(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == want


@pytest.mark.parametrize("owners", [0, 1, 300, (1 << 24) + 1])
def test_jaccard_followers_of_buckets(owners):
    draw = np.random.default_rng(owners)
    own, n = np.arange(owners) * 3, 2000 if owners else 0
    sign, at = draw.integers(0, 1 << 40, 1500).astype("<u8")[draw.integers(0, 1500, n)], draw.integers(0, max(owners, 1), n)
    got = partenum._followers(sign.view(np.uint8).reshape(-1, 8)[:, :5], own, at)
    buckets = {}
    for s, i in zip(sign.tolist(), at.tolist()):
        buckets.setdefault(s, []).append(3 * i)
    want = [(s, sorted(ids)[0], i) for s, ids in buckets.items() for i in sorted(ids)[1:]]
    assert sorted(zip(*(c.tolist() for c in got))) == sorted(want)


def test_jaccard_brute_force(spark):
    check_jaccard(spark, odd_rows())


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_chains_of_near_copies(spark, seed):
    """Families whose members drift, so that links are near the threshold and buckets break apart."""
    rng = random.Random(seed)
    rows = []
    for family in range(8):
        text = [f"w{rng.randrange(60)}" for _ in range(rng.choice([4, 5, 6, 9, 12, 25, 60, 150]))]
        for _ in range(12):
            rows.append((len(rows), " ".join(text), "en", "web", 0))
            text = list(text)
            for _ in range(rng.randint(0, max(1, len(text) // 40))):
                kind, at = rng.random(), rng.randrange(len(text))
                if kind < 0.4:
                    text[at] = f"w{rng.randrange(60)}"
                elif kind < 0.7:
                    text.insert(at, f"v{rng.randrange(60)}")
                elif len(text) > 3:
                    del text[at]
    check_jaccard(spark, rows)


def test_jaccard_sf(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    out = partenum.op8_jaccard_join(spark, sf_dir).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == jaccard_wanted(rows)


def test_signatures_lose_no_pair():
    """Every pair of sets at the threshold shares a signature, sets at the edge of a band included."""
    rng = np.random.default_rng(4)
    for size in [*range(1, 40), 63, 80, 81, 100, 300, 1000, 2500]:
        for _ in range(4):
            a = np.unique(rng.integers(1, 1 << 62, size).astype(np.uint64))
            most = partenum.farthest(len(a), len(a))
            gone = int(rng.integers(0, most // 2 + 1))
            b = np.unique(np.append(a[gone:], rng.integers(1, 1 << 62, min(gone, most - gone)).astype(np.uint64)))
            shared = len(np.intersect1d(a, b))
            if len(a) > shared and shared * 100 >= (len(a) + len(b) - shared) * 80:  # equal sets meet by digest
                owner, sign = partenum.signatures([a, b])
                assert set(sign[owner == 0]) & set(sign[owner == 1]), size


def test_jaccard_crowds_are_signed_again(spark, monkeypatch):
    monkeypatch.setattr(partenum, "CROWD", 3)
    monkeypatch.setattr(partenum, "BLOCK", 4)
    test_jaccard_chains_of_near_copies(spark, 3)


def test_jaccard_round_by_round(spark, monkeypatch):
    monkeypatch.setattr(partenum, "MANY", 0)
    test_jaccard_chains_of_near_copies(spark, 4)


def test_jaccard_without_ids(spark):
    rows = [(1, "a b c d e f", None, None, 0), (None, "a b c d e f", None, None, 0), (None, None, None, None, 0)]
    out = sorted((r["n_shingles"], r["component_id"] is None) for r in partenum.jaccard_components(odd_docs(spark, rows)).collect())
    assert out == [(0, True), (2, False), (2, True)]


def test_jaccard_kept_and_empty(spark):
    docs = odd_docs(spark)
    kept = partenum.kept_documents(docs)
    assert kept.columns == docs.columns
    want = {i for i, (_, c) in jaccard_wanted(odd_rows()).items() if i == c}
    assert {r["doc_id"] for r in kept.collect()} == want
    assert partenum.jaccard_components(odd_docs(spark, [])).count() == 0


# ---- substring dedup ------------------------------------------------------------------------


def passage_rows():
    rng = random.Random(3)
    say = lambda n: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(n))
    passage, rows = say(80), []
    for i in range(12):
        own = [say(rng.randint(20, 200)), say(rng.randint(20, 200))]
        text = f"{own[0]} {passage} {own[1]}" if i in (2, 5, 9) else " ".join(own)
        rows.append((i, text, "en", "web", 0))
    return [*rows, (20, "", None, None, 0), (21, None, None, None, 0), (22, say(40_000), None, None, 0)], passage


def test_repeated_passages_are_found_whole(spark):
    rows, passage = passage_rows()
    out = substrings.repeated_passages(odd_docs(spark, rows)).collect()
    assert sorted((r["doc_id"], r["kept"]) for r in out) == [(2, True), (5, False), (9, False)]
    texts = {r[0]: r[1].encode() for r in rows if r[1]}
    for r in out:
        found = texts[r["doc_id"]][r["start"] : r["end"]].decode()
        assert len(set(found.split()) & set(passage.split())) >= 60 and r["n_words"] >= 60


def test_without_repeats_cuts_the_later_copies(spark):
    rows, passage = passage_rows()
    out = {r["doc_id"]: r["text"] for r in substrings.without_repeats(odd_docs(spark, rows)).collect()}
    assert sorted(out) == [5, 9]
    middle = " ".join(passage.split()[15:65])
    assert all(middle not in t for t in out.values())


def test_chunks_cover_whole_texts_and_resist_insertions(spark):
    rows, _ = passage_rows()
    by = defaultdict(list)
    for r in substrings.chunks(odd_docs(spark, rows)).collect():
        by[r["doc_id"]].append((r["seq"], r["start"], r["end"]))
    for doc_id, text, *_ in rows:
        if text:
            parts = sorted(by[doc_id])
            assert parts[0][1] == 0 and parts[-1][2] == len(text.encode()) and all(a[2] == b[1] for a, b in zip(parts, parts[1:]))
    text = rows[0][1]
    moved = odd_docs(spark, [(1, text, "", "", 0), (2, "inserted words " + text, "", "", 0)])
    seen = defaultdict(set)
    for r in substrings.chunks(moved).collect():
        seen[r["doc_id"]].add(r["digest"])
    assert len(seen[1] & seen[2]) >= len(seen[1]) - 4


def test_substrings_empty_and_ties(spark):
    assert substrings.repeated_passages(odd_docs(spark, [])).count() == 0
    rows, _ = passage_rows()
    twice = substrings.repeated_passages(odd_docs(spark, [rows[0], rows[0]])).count()
    assert twice == 0  # one document


def said(seed, n, least=2, most=9):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(least, most))) for _ in range(n))


@pytest.mark.parametrize("overlap", [0, 20])
def test_adjacent_passages_keep_one_copy_each(spark, overlap):
    whole = said(1, 200).split()
    a, b = " ".join(whole[: 100 + overlap // 2]), " ".join(whole[100 - overlap // 2 :])
    texts = {3: f"{said(3, 60)} {a} {said(4, 60)}", 5: f"{said(5, 60)} {' '.join(whole)} {said(6, 60)}", 9: f"{said(7, 60)} {b} {said(8, 60)}"}
    texts |= without(spark, texts)
    for at, first in ((25, 3), (125, 5)):
        middle = " ".join(whole[at : at + 50])
        assert [d for d, t in sorted(texts.items()) if middle in t] == [first]


def test_a_short_fragment_elsewhere_does_not_cut_every_copy(spark):
    a = said(11, 150)
    fragment = " ".join(a.split()[60:80])
    texts = {1: f"{said(12, 60)} {fragment} {said(13, 60)}", 5: f"{said(14, 60)} {a} {said(15, 60)}", 9: f"{said(16, 60)} {a} {said(17, 60)}"}
    texts |= without(spark, texts)
    for k in (5, 90):
        middle = " ".join(a.split()[k : k + 45])
        assert [d for d, t in sorted(texts.items()) if middle in t] == [5]


def repeated_windows(texts, least):
    """(doc, first doc) of each word range [i, i + least) that several documents hold, by plain lookup."""
    held = defaultdict(set)
    for d, t in texts.items():
        w = words(t)
        for i in range(len(w) - least + 1):
            held[tuple(w[i : i + least])].add(d)
    for d, t in texts.items():
        w = words(t)
        yield from ((d, i, min(held[tuple(w[i : i + least])])) for i in range(len(w) - least + 1) if len(held[tuple(w[i : i + least])]) > 1)


@pytest.mark.parametrize("most", [9, 5])
def test_passages_of_51_to_60_short_words_match_brute_force(spark, most):
    texts = {}
    for k in range(40):
        passage = said(1000 + k, 49 + k % 12, 1, most)
        for copy in range(2 + k % 2):
            texts[100 * copy + k] = f"{said(2000 + 10 * k + copy, 30 + k, 1, most)} {passage} {said(3000 + 10 * k + copy, 70, 1, most)}"
    texts[300], texts[301] = texts[7] + " end", "x " + texts[107].replace(" ", "\n")  # near copies
    texts[302], texts[303] = "a " * 120, "b " + "a " * 70
    want, listed = cut_words(texts, 51)
    cut, seen = defaultdict(set), defaultdict(set)
    for r in substrings.repeated_passages(odd_docs(spark, [(d, t, None, None, 0) for d, t in texts.items()])).collect():
        raw = texts[r["doc_id"]].encode()
        at, n = len(words(raw[: r["start"]].decode())), len(words(raw[r["start"] : r["end"]].decode()))
        assert n == r["n_words"] and r["kept"] == (r["first_doc_id"] == r["doc_id"])
        seen[r["doc_id"]] |= set(range(at, at + n))
        if not r["kept"]:
            cut[r["doc_id"]] |= set(range(at, at + n))
        else:
            assert n >= 51
    assert cut == want and seen == listed and len(want) > 40


def cut_words(texts, least):
    """By document the words that are cut (in a window that is first elsewhere, and in none that is first here)
    and those in any repeated window."""
    cut, kept = defaultdict(set), defaultdict(set)
    for d, i, first in repeated_windows(texts, least):
        (cut if first < d else kept)[d] |= set(range(i, i + least))
    want = {d: c - kept[d] for d, c in cut.items() if c - kept[d]}
    return want, {d: cut[d] | kept[d] for d in {*cut, *kept}}


def test_a_passage_across_two_others_stays_where_it_is_first(spark):
    a, b = said(21, 60), said(22, 60)
    texts = {1: b, 2: f"{a} {b}", 3: " ".join(a.split()[30:] + b.split()[:30])}
    left = {d: words(t) for d, t in (texts | without(spark, texts)).items()}
    assert left == {1: b.split(), 2: a.split() + b.split()[:30], 3: []}


@pytest.mark.parametrize("seed", range(3))
def test_each_repeated_window_stands_whole_in_its_first_document(spark, seed):
    rng = random.Random(seed)
    pool = said(500 + seed, 400).split()
    texts = {}
    for d in range(14):
        parts = [said(1000 * seed + 10 * d + k, rng.randint(0, 30)).split() + pool[(at := rng.randrange(330)) : at + rng.randint(20, 150)] for k in range(rng.randint(1, 3))]
        texts[d] = " ".join(w for p in parts for w in p)
    left = texts | without(spark, texts)
    stands = {d: {tuple(w[i : i + 51]) for i in range(len(w) - 50)} for d, w in ((d, words(t)) for d, t in left.items())}
    want, _ = cut_words(texts, 51)
    assert want
    for d, i, first in repeated_windows(texts, 51):
        assert tuple(words(texts[d])[i : i + 51]) in stands[first]
    for d, t in texts.items():
        w = words(t)
        assert words(left[d]) == [x for i, x in enumerate(w) if i not in want.get(d, set())]


def without(spark, texts):
    docs = odd_docs(spark, [(d, t, None, None, 0) for d, t in texts.items()])
    return {r["doc_id"]: r["text"] for r in substrings.without_repeats(docs).collect()}


# ---- encoding -------------------------------------------------------------------------------


def viterbi(text, table, byte_ids, byte_weight):
    """Least weight over all segmentations, by plain dynamic programming."""
    text = " " + text
    best = [0] + [math.inf] * len(text)
    longest = max(map(len, table))
    for j in range(1, len(text) + 1):
        best[j] = best[j - 1] + byte_weight * len(text[j - 1].encode())
        for i in range(max(0, j - longest), j):
            if text[i:j] in table:
                best[j] = min(best[j], best[i] + table[text[i:j]])
    return best[-1]


def test_encoding_is_a_shortest_path_and_decodes(spark):
    vocabulary = pieces.read_pieces()
    machine = pieces.compiled(tuple(vocabulary))
    lexicon = [(t.replace(pieces.MARK, " "), i) for t, i, byte in vocabulary if byte < 0]
    cost = {}
    for text, i in lexicon:
        state = machine.root
        for ch in text:
            state = state[0][ch]
        assert state[1] == i
        cost[text] = state[2]
    of_id = {i: cost[t] for t, i in lexicon}
    samples = ["Hello world", "  two  spaces", "tab\there\nnewline", "naïve café 😀", "▁ literal mark", "ünïcödé 漢字", "a" * 300, "x \r\n y", " "]
    for text in samples:
        ids = machine.encode(text)
        assert machine.decode(ids) == text
        weight = sum(of_id.get(i, machine.byte_weight) for i in ids)
        assert weight == viterbi(text, cost, machine.byte_ids, machine.byte_weight)
    assert machine.encode("") == [] and machine.decode([]) == ""


def test_encoded_documents(spark):
    out = pieces.encoded(odd_docs(spark)).select("doc_id", "text", "ids", "n_pieces", "decodes", "ids_sha256")
    rows = out.collect()
    assert len(rows) == len(odd_rows()) and all(r["decodes"] for r in rows)
    for r in rows:
        assert r["n_pieces"] == len(r["ids"]) and (r["n_pieces"] > 0) == bool(r["text"])
    back = {(r["doc_id"], r["text"]) for r in pieces.decoded(out).collect()}
    assert back == {(r[0], r[1] or "") for r in odd_rows()}
    assert pieces.encoded(odd_docs(spark, [])).count() == 0


# ---- language model -------------------------------------------------------------------------


def lm_wanted(rows):
    """Counts, base scores and the interpolated model by plain loops; tokens are tuples of words."""
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10
    toks = [(i, fold(i), [*words(lower(t)), None]) for i, t, *_ in rows]
    single, pair = Counter(), Counter()
    for _, f, ws in toks:
        if f:
            single.update(ws)
            pair.update(zip(["^", *ws], ws))
    n, v, begins = sum(single.values()), len(single), sum(1 for _, f, _ in toks if f)
    return toks, single, pair, n, v, begins


def test_lm_against_plain_loops(spark):
    rows = [r for r in odd_rows() if r[0] != 67]
    out = lm.lm_scores(odd_docs(spark, rows)).collect()
    toks, single, pair, n, v, begins = lm_wanted(rows)
    got = defaultdict(list)
    for r in out:
        got[r["doc_id"]].append(r)
    p = lambda w, gone=0: (single[w] - gone + 0.1) / (n - gone + 0.1 * (v + 1))
    bucket = lambda c: min(int(math.log2(max(c, 1))), lm.BUCKETS - 1)
    events = defaultdict(list)
    for _, f, ws in toks:
        if f == 1:
            for a, b in zip(["^", *ws], ws):
                c = (begins if a == "^" else single[a]) - 1
                if c > 0:
                    events[bucket(c)].append((max(pair[a, b] - 1, 0) / c, p(b, 1)))
    weights = {}
    for k, es in events.items():
        w = 0.5
        for _ in range(60):
            w = sum(w * m / (w * m + (1 - w) * q) for m, q in es) / len(es)
        weights[k] = min(max(w, 1e-6), 1 - 1e-3)
    for i, f, ws in toks:
        base = sum(math.log10(p(w)) for w in ws)
        full = 0.0
        for a, b in zip(["^", *ws], ws):
            c = begins if a == "^" else single[a]
            lam = weights.get(bucket(c), 0.0) if c else 0.0
            full += math.log10(lam * pair[a, b] / max(c, 1) + (1 - lam) * p(b))
        for r in got[i]:
            assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (f == 0, len(ws), n)
            if len(got[i]) == 1:
                assert r["n_known"] == sum(single[w] > 0 for w in ws)
                assert r["base_score"] == pytest.approx(base, rel=1e-9)
                assert r["score"] == pytest.approx(full, rel=2e-3)


def test_lm_beats_the_unigram_on_held_out_text(spark, sf_dir):
    out = lm.op10_lm_scoring(spark, sf_dir).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > out[1]


def test_lm_empty(spark):
    assert lm.lm_scores(odd_docs(spark, [])).count() == 0
    only = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:2]  # nothing to learn from
    out = lm.lm_scores(odd_docs(spark, [(i, "a b", None, None, 0) for i in only])).collect()
    assert all(r["n_known"] == 0 and r["held_out"] for r in out) and len(out) == 2


# ---- quality classifier ---------------------------------------------------------------------


def test_risk_gradient_against_plain_loops():
    """The step goes down the risk prior E_p[l(+)] + max(0, E_u[l(-)] - prior E_p[l(-)]) where its bracket is
    positive, and up the bracket where it is not; by finite differences of plain loops."""
    rng = np.random.default_rng(3)
    for shift, prior in ((0.0, 0.4), (0.0, 0.9), (3.0, 0.95)):
        p, u = rng.normal(size=(6, 5)) + shift, rng.normal(size=(9, 5))
        model = quality.PUClassifier(rng.normal(size=(20, 5)), rng.normal(size=(20, 5)), 0.5, rounds=1, least_steps=1)

        def parts(w):
            def out(x):
                hidden = [math.tanh(sum(x[d] * w[0][d][k] for d in range(5)) + w[1][k]) for k in range(quality.HIDDEN)]
                return sum(h * v for h, v in zip(hidden, w[2])) + w[3][0]

            loss = lambda x, y: math.log1p(math.exp(-y * out(x)))
            mean = lambda xs, y: sum(loss(x, y) for x in xs) / len(xs)
            return prior * mean(p, 1), mean(u, -1) - prior * mean(p, -1)

        risk = lambda w: parts(w)[0] + parts(w)[1] if parts(model.w)[1] >= 0 else -parts(w)[1]
        got = model._gradient(p, u, prior)
        for k, at in ((0, (2, 3)), (1, (4,)), (2, (7,)), (3, (0,))):
            moved = [[x.copy() for x in model.w] for _ in range(2)]
            moved[0][k][at] += 1e-5
            moved[1][k][at] -= 1e-5
            assert got[k][at] == pytest.approx((risk(moved[0]) - risk(moved[1])) / 2e-5, rel=1e-4, abs=1e-7)


def test_quality_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    out = [r for r in quality.op3_quality_classifier(spark, sf_dir).collect()]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in out)
    held = [(r["score"], r["predicted"], labels[r["doc_id"]]) for r in out if r["held_out"] and r["doc_id"] in labels]
    good, bad = [s for s, _, y in held if y == 1], [s for s, _, y in held if y == 0]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    assert auc > 0.99
    assert np.mean([p == y for _, p, y in held]) > 0.97


def test_quality_ignores_identity_columns(spark):
    rows = [(i, ("clear words stand here in good order. " * 5 if i % 2 else "$$$ !!! 1 1 1 zzz ") + str(i), "en", "web", 0) for i in range(80)]
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(0, 60)] + [(3, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    docs = odd_docs(spark, [*rows, (900, None, None, None, None), (901, "", None, None, None), (902, "y" * 100_000, None, None, None)])
    out = {r["doc_id"]: r["score"] for r in quality.scored(docs, labels).collect()}
    assert len(out) == 83 and out[900] == out[901]
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("yy"))
    assert {r["doc_id"]: r["score"] for r in quality.scored(other, labels).collect()} == pytest.approx(out)
    assert quality.kept_documents(docs, labels).columns == docs.columns


def test_quality_without_labels_or_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = odd_docs(spark)
    assert {r["score"] for r in quality.scored(docs, labels).collect()} == {0.5}
    assert quality.scored(odd_docs(spark, []), labels).count() == 0


def test_classifier_without_positives_keeps_all_documents(spark):
    labels = spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int")
    docs = odd_docs(spark)
    assert quality.kept_documents(docs, labels).count() == docs.count()


def test_classifier_samples_are_bounded_by_rows(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(quality, "PUClassifier", lambda p, u, prior: taken.append((len(p), len(u))))
    ids = spark.range(1000).withColumnRenamed("id", "doc_id")
    hot = ids.where(~quality.held_out()).orderBy(F.xxhash64("doc_id", F.lit(3))).first()[0]
    rows = [(i, f"text {i} of words", None, None, 0) for i in range(1000)] + [(hot, "the same text", None, None, 0)] * 600 + [(hot, f"other text {i}", None, None, 0) for i in range(600)]
    labels = spark.createDataFrame([(i, 1, 0) for i in {hot, *range(40)}], "doc_id long, quality int, toxic int")
    quality.fit(odd_docs(spark, rows), labels, positives=20, unlabelled=200)
    assert 1 <= taken[0][0] <= 20 and 100 <= taken[0][1] <= 300
