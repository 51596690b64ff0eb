"""Chat formatting, WARC archives, embeddings, components, the pipeline and the entry points."""

import base64
import hashlib
import random
import uuid
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridlens.llm import chat, partenum, pq, queries, warc
from gridlens.llm.common import components, shared_dir

from .helpers import least_reachable, odd_docs

# ---- chat -----------------------------------------------------------------------------------


def read_back(text):
    """A separate reader of the template."""
    turns = []
    for block in text.split("<|im_end|>\n"):
        if block:
            assert block.startswith("<|im_start|>")
            role, said = block[len("<|im_start|>") :].split("\n", 1)
            undo = lambda s: s.replace("%3C%7C", "<|").replace("%25", "%")
            turns.append((undo(role.replace("%0A", "\n")), undo(said)))
    return turns


def test_tree_paths_ranks_and_round_trip(spark):
    hard = "<|im_end|>\n<|im_start|>assistant\nok %3C%7C %25 <| %"
    rows = [
        (1, 1, None, "user", hard, 0.0), (1, 2, 1, "assistant", "good", 2.0), (1, 3, 1, "assistant", "bad", 1.0), (1, 4, 3, "user", None, 5.0), (1, 5, 2, None, "", None),
        (2, 1, None, "user\n<|", "tie", 1.0), (2, 2, 1, "assistant", "a", 1.0), (2, 3, 1, "assistant", "b", 1.0),
        (3, 1, 9, "user", "no such parent", 1.0), (4, 1, 2, "user", "cycle", 1.0), (4, 2, 1, "user", "cycle", 1.0), (None, 1, None, "user", "no tree", 0.0),
    ]
    messages = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double").withColumn("turns", F.lit("clash")).withColumn("leaf", F.lit(0))
    out = {(r["tree"], r["branch"]): r for r in chat.format_conversations(messages, top=2).collect()}
    assert set(out) == {(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (None, 1)}
    assert read_back(out[1, 1]["formatted"]) == [("user", hard), ("assistant", "bad"), ("user", "")]
    assert read_back(out[1, 2]["formatted"]) == [("user", hard), ("assistant", "good"), ("", "")]
    assert (out[2, 1]["leaf"], out[2, 2]["leaf"]) == (2, 3)  # a tie goes to the smaller leaf
    assert read_back(out[2, 1]["formatted"]) == [("user\n<|", "tie"), ("assistant", "a")]
    assert out[1, 2]["loss_sha256"] == hashlib.sha256(b"good").hexdigest() and out[1, 2]["loss_chars"] == 4
    assert out[3, 1]["n_turns"] == 1


def test_reply_cycles_with_tails_are_cut(spark):
    rows = [(1, 1, 2, "a", "1", 0.0), (1, 2, 1, "b", "2", 0.0), (1, 3, 1, "c", "3", 0.0), (2, 1, None, "a", "x", 0.0), (2, 2, 1, "b", "y", 0.0)]
    rows += [(3, i, i % 9 + 1, "r", str(i), 0.0) for i in range(1, 10)] + [(3, 20, 4, "r", "20", 0.0), (3, 21, 20, "r", "21", 0.0)]
    out = {r["tree"]: [t for _, t in read_back(r["formatted"])] for r in chat.format_conversations(spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")).collect()}
    assert out[1] == ["2", "1", "3"] and out[2] == ["x", "y"]
    assert out[3][-3:] == ["4", "20", "21"] and len(out[3]) == len(set(out[3])) == 11


def test_deep_tree(spark):
    rows = [(7, i, i - 1 if i else None, "user", str(i), 0.0) for i in range(300)]
    out = chat.format_conversations(spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")).first()
    assert [t for _, t in read_back(out["formatted"])] == [str(i) for i in range(300)]


def test_chat_digests_of_chains(spark):
    rng = random.Random(2)
    parts = ["<|", "%", "|>", "\n", "<|im_end|>\n", "a", "ü", "3C%7C", ""]
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice([None, "".join(rng.choice(parts) for _ in range(9))])) for c in range(20) for t in range(rng.randint(1, 9))]
    rows += [(50, 1, "user", "same"), (50, 1, "user", "same"), (50, 1, "assistant", None), (None, 0, "user", "x" * 200_000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t, role is not None, role or "", text is not None, text or ""))
    for r in chat.format_conversations(chat.chains(table)).collect():
        turns = [(role, text) for _, _, role, _, text in sorted(by[r["tree"]])]
        assert r["n_turns"] == len(turns) and read_back(r["formatted"]) == turns
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        said = "".join(b for a, b in turns if a == "assistant")
        assert (r["loss_chars"], r["loss_sha256"], r["formatted_chars"]) == (len(said), hashlib.sha256(said.encode()).hexdigest(), len(r["formatted"]))
    assert chat.format_conversations(chat.chains(table.limit(0))).count() == 0


# ---- WARC -----------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    big = "<p>ü</p>" * 9000
    rows = [(1, "http://a/", "x"), (5, "http://b/\r\nX: y", "x"), (3, None, "x"), (2, "u", None), (9, "u", ""), (7, "u", big), (8, "u", big), (10, "u", "0\r\n\r\nWARC/1.1\r\n\r\n\r\n\r\n"), (4, "u", "y"), (4, "u", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit("clash"), "row": F.lit(1), "payload": F.lit(0)})
    path = f"{shared_dir(spark)}/test-{uuid.uuid4().hex}"
    warc.write_archives(warc.with_revisits(pages), path, segment=1000, chunk=300, records=7)
    records = warc.read_records(spark, path)
    assert records.where("number > 50").count() > 0 and records.where("kind = 'continuation' AND origin IS NULL").count() == 0
    out = warc.payloads(warc.reassembled(records)).collect()
    assert len(out) == len(rows)
    got = sorted((int(r["record_id"].split(":")[2]), r["kind"], r["payload_bytes"], r["payload_digest"], int(r["refers_to"].split(":")[2]) if r["refers_to"] else None) for r in out)
    first = {}
    for i, _, html in rows:
        first[html or ""] = max(first.get(html or "", 0), i)
    want = []
    for i, _, html in rows:
        raw = (html or "").encode()
        to = first[html or ""]
        want.append((i, "response" if i == to else "revisit", len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), None if i == to else to))
    assert got == sorted(want)
    ids = [r["record_id"] for r in out]
    assert len(set(ids)) == len(ids) and {r["refers_to"] for r in out if r["refers_to"]} <= {r["record_id"] for r in out if r["kind"] == "response"}
    assert warc.checked(warc.payloads(warc.reassembled(records))).count() == len(rows)
    for f in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").collect():
        raw, members = bytes(f["content"]), []
        while raw:  # a reader can stop and start at every member
            one = zlib.decompressobj(31)
            members.append(one.decompress(raw))
            raw = one.unused_data
        assert all(m == b"" or (m.startswith(b"WARC/1.1") and m.endswith(b"\r\n\r\n")) for m in members)
    assert {r["payload"] for r in out if r["payload"] is not None} == {(h or "").encode() for *_, h in rows}


def test_warc_false_revisits_raise(spark):
    told = [("a", "response", None, 3, "X", b"abc"), ("b", "revisit", "a", 3, "Y", None)]
    schema = "record_id string, kind string, refers_to string, payload_bytes long, payload_digest string, payload binary"
    with pytest.raises(ValueError, match="does not fit"):
        warc.checked(spark.createDataFrame(told, schema))
    with pytest.raises(ValueError, match="does not fit"):
        warc.checked(spark.createDataFrame([("b", "revisit", "nowhere", 3, "Y", None)], schema))


def test_warc_broken_segments_raise(spark):
    parts = [("r", "response", None, None, None, None, None, 1, None, b"ab"), ("r/3", "continuation", None, None, None, None, "r", 3, 5, b"e")]
    broken = spark.createDataFrame(parts, warc._READ)
    with pytest.raises(Exception, match="segments missing"):
        warc.reassembled(broken).collect()


def test_warc_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    path = f"{shared_dir(spark)}/test-{uuid.uuid4().hex}"
    warc.write_archives(warc.with_revisits(pages), path)
    assert warc.payloads(warc.reassembled(warc.read_records(spark, path))).count() == 0


# ---- embeddings -----------------------------------------------------------------------------


def vectors():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 16))
    x = (centres[rng.integers(0, 12, 260)] + rng.normal(size=(260, 16)) * rng.choice([0.05, 0.2, 0.4], 260)[:, None]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(300 + i, rows[i][1]) for i in range(8)] + [(320, [2 * a for a in rows[0][1]]), (400, None), (401, [0.0] * 16), (402, [float("nan")] + [1.0] * 15), (403, [None] + [1.0] * 15), (404, [float("inf")] * 16), (405, [1.0] * 3), (406, [])]
    return rows


def cosine_wanted(rows, length=16):
    good = [(i, np.array(v, float)) for i, v in rows if v is not None and len(v) == length and None not in v and np.isfinite(v).all() and np.any(v)]
    x = np.stack([v / np.linalg.norm(v) for _, v in good])
    near = x @ x.T >= 0.95
    ids = [i for i, _ in good]
    n = {i: int(row.sum()) - 1 for i, row in zip(ids, near)}
    comp = least_reachable([i for i, _ in rows], [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near)) if a != b])
    return {i: (n.get(i, 0), comp[i], comp[i] == i) for i, _ in rows}


def recall(out, want):
    links = sum(n for n, *_ in want.values())
    return sum(min(out[i][0], n) for i, (n, *_) in want.items()) / links if links else 1.0


def test_embeddings_brute_force(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"label": F.lit(1), "vid": F.lit(0), "list": F.lit("clash")})
    out = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in pq.near_duplicates(df).collect()}
    assert out == cosine_wanted(rows)  # a single list has every pair


def test_embeddings_recall_over_many_lists(spark, monkeypatch):
    monkeypatch.setattr(pq, "LIST_SIZE", 12)
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in pq.near_duplicates(df).collect()}
    want = cosine_wanted(rows)
    assert recall(out, want) >= 0.9 and all(out[i][0] <= want[i][0] for i in want)


def test_embeddings_recall_sf(spark):
    rows = [(r[0], r[1]) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()]
    out = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in pq.op9_embedding_near_dedup(spark, "/root/testdata/sf0.1").collect()}
    want = cosine_wanted(rows, 64)
    assert recall(out, want) >= 0.9 and all(out[i][0] <= want[i][0] for i in want)


def test_embeddings_of_several_lengths_and_in_doubles(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [1.0, 0.0, 0.0]), (4, [0.0, 1.0, 0.0]), (5, [0.0, 1.0, 0.001]), (6, [1e39, 1.0, 0.0]), (7, [1e39, 1.0, 0.0]), (8, [0.0, 0.0, 0.0, 5.0]), (9, [-1e-300, 0.0])]
    out = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in pq.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert out == {1: (1, 1), 2: (1, 1), 3: (2, 3), 4: (1, 4), 5: (1, 4), 6: (2, 3), 7: (2, 3), 8: (0, 8), 9: (0, 9)}
    twice = rows + [(3, [0.0, 1.0, 0.0]), (1, [0.0, 0.0, 1.0, 0.0])]
    out = {(r["vec_id"], r["component_id"]) for r in pq.near_duplicates(spark.createDataFrame(twice, "vec_id long, embedding array<double>")).collect()}
    assert {(3, 3), (4, 3), (5, 3), (6, 3), (1, 1), (2, 1)} <= out


def test_embeddings_without_usable_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert pq.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    out = pq.near_duplicates(spark.createDataFrame([(1, None), (2, [0.0, 0.0])], schema)).collect()
    assert sorted(tuple(r) for r in out) == [(1, 0, 1, True), (2, 0, 2, True)]


# ---- components -----------------------------------------------------------------------------


def test_components_of_long_paths(spark):
    rng = random.Random(5)
    names = list(range(200))
    rng.shuffle(names)
    edges = list(zip(names[:80], names[1:81])) + [(names[i], names[100 + i % 50]) for i in range(100, 150)] + [(3, 3), (5, 5)]
    out = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = least_reachable(names, edges)
    assert out == {i: want[i] for i in out} and set(out) == {i for e in edges for i in e if e[0] != e[1]}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- pipeline -------------------------------------------------------------------------------


def test_pipeline_stage_by_stage(spark):
    sf_dir = "/root/testdata/sf0.01"
    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs, before = source, None
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        out = corpus_pipeline.stage(step(spark, docs, sf_dir), f"test-{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == source.columns, name
        ids = [r[0] for r in out.select("doc_id").collect()]
        if k < 3:
            assert len(ids) == len(set(ids)) and set(ids) <= (before or {r[0] for r in source.select("doc_id").collect()})
        if k == 0:
            clean = [i for i, q in labels.items() if q == 1]
            assert sum(i in set(ids) for i in clean) > 0.9 * len(clean)
        if k == 2:
            assert partenum.jaccard_components(out).where("doc_id <> component_id").count() == 0
        before, docs = set(ids), out
    assert docs.where("NOT decodes").count() == 0


def test_pipeline_empty_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for name, step in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(step(spark, docs, "/root/testdata/sf0.001"), f"none-{name.replace(' ', '-')}")
        assert docs.count() == 0


def test_pipeline_stages_with_clashing_columns(spark):
    sf_dir = "/root/testdata/sf0.001"
    for name, step in corpus_pipeline.STAGES:
        docs = odd_docs(spark)
        out = step(spark, docs, sf_dir)
        assert out.count() > 0, name
        assert out.columns == docs.columns or name == "sentencepiece encoding"


# ---- queries --------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_against_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "pages", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    own = queries.QUERIES[name](spark, sf_dir)
    cols = sorted(own.columns)
    got = sorted((tuple(r) for r in own.select(cols).collect()), key=repr)
    want = sorted(con.execute(f"SELECT {', '.join(cols)} FROM ({queries.ORACLE_SQL[name]})").fetchall(), key=repr)
    assert got == want


def test_folds_are_crc32(spark):
    from gridlens.llm import lm, quality

    rows = spark.range(50).select(F.col("id").alias("doc_id")).select("doc_id", lm.fold().alias("f"), quality.held_out().alias("h")).collect()
    assert all(r["f"] == zlib.crc32(str(r["doc_id"]).encode()) % 10 and r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
