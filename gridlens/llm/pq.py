"""Embedding near-duplicates by an inverted file with product-quantised residuals.

Equal vectors form one class first. Each class lies in the list of its nearest coarse centroid with
its residual as one code per subspace and the length of the quantisation error. A query probes the
lists whose bisecting plane it is near to; table look-ups give its distance to a list's codes, and a
code within the link radius plus its own error is a candidate. The triangle inequality makes that
test lossless, so only the choice of probes is approximate. Candidates are then compared by cosine
in double precision. Lists and their queries are cut into blocks, so a cell has a bounded size.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, stage

COSINE = 0.95
SUBSPACES = 8
CODES = 256
#: Classes per coarse list aimed at, the most lists, and the sampled classes that fit the index: at least,
#: per list, and bytes of them at most.
LIST_SIZE = 1600
MOST_LISTS = 16_384
SAMPLE = 20_000
SAMPLE_PER_LIST = 64
SAMPLE_BYTES = 128 << 20
#: Share of the link radius within which a list's bisecting plane is probed.
REACH = 0.6
BLOCK = 2048
QUERY_BLOCK = 4096


def _kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        count = np.bincount(near, minlength=k)
        full = count > 0
        centres[full] = sums[full] / count[full, None]
        if not full.all():
            centres[~full] = x[rng.choice(len(x), int((~full).sum()))]
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(1) / 2
    return np.concatenate([np.argmax(x[a : a + 4096] @ centres.T - half, 1) for a in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


class Quantiser:
    """Coarse centroids and one codebook per subspace of the residuals of unit vectors."""

    def __init__(self, sample: np.ndarray, lists: int, subspaces: int = SUBSPACES):
        self.cuts = np.linspace(0, sample.shape[1], min(subspaces, sample.shape[1]) + 1).astype(int)
        self.coarse = _kmeans(sample, lists)
        left = sample - self.coarse[_nearest(sample, self.coarse)]
        self.books = [_kmeans(left[:, a:b], CODES, seed=a) for a, b in zip(self.cuts[:-1], self.cuts[1:])]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and error length of unit vectors."""
        home = _nearest(x, self.coarse)
        left = x - self.coarse[home]
        codes = np.stack([_nearest(left[:, a:b], book) for a, b, book in zip(self.cuts[:-1], self.cuts[1:], self.books)], 1).astype(np.uint8)
        for s, (a, b) in enumerate(zip(self.cuts[:-1], self.cuts[1:])):
            left[:, a:b] -= self.books[s][codes[:, s]]
        return home, codes, np.linalg.norm(left, axis=1)

    def probes(self, x: np.ndarray, home: np.ndarray, reach: float) -> list[np.ndarray]:
        """For each vector the later lists whose bisecting plane with its own list is within reach.
        Earlier lists' vectors probe in turn, so each pair of lists is looked at from one side."""
        half = (self.coarse**2).sum(1) / 2
        worth = x @ self.coarse.T - half
        apart = np.sqrt(np.maximum(2 * (half[home][:, None] + half[None] - self.coarse[home] @ self.coarse.T), 1e-12))
        near = (worth[np.arange(len(x)), home][:, None] - worth) / apart <= reach
        near &= np.arange(len(self.coarse))[None] > home[:, None]
        return [np.flatnonzero(row) for row in near]

    def table(self, q: np.ndarray, home: int) -> list[np.ndarray]:
        """Squared distances of each query's residual to each code, by subspace."""
        left = q - self.coarse[home]
        out = []
        for a, b, book in zip(self.cuts[:-1], self.cuts[1:], self.books):
            part = left[:, a:b]
            out.append((part**2).sum(1)[:, None] + (book**2).sum(1)[None] - 2 * part @ book.T)
        return out


def _matrix(col) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1) if len(col) else np.zeros((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


_INDEXED = "vid long, mult long, vector {kind}, list int, codes binary, err double, probes array<int>"


def _indexer(model: Quantiser, reach: float):
    def rows(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                x = _unit(_matrix(part.column("vector")))
                home, codes, err = model.encode(x)
                cols = [part.column("vid"), part.column("mult"), part.column("vector"), pa.array(home.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(err), pa.array(model.probes(x, home, reach), pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(cols, ["vid", "mult", "vector", "list", "codes", "err", "probes"])

    return rows


def _cell(model: Quantiser, cosine: float, radius: float):
    def links(rows: pa.Table) -> pa.Table:
        get = lambda c: rows.column(c).to_numpy()
        side, vid, mult, err = get("side"), get("vid"), get("mult"), get("err")
        own, home = bool(rows.column("own")[0].as_py()), rows.column("list")[0].as_py()
        x = _unit(_matrix(rows.column("vector")))
        m, q = np.flatnonzero(side <= 0), np.flatnonzero(side >= 0)
        codes = np.frombuffer(b"".join(rows.column("codes").take(pa.array(m)).to_pylist()), np.uint8).reshape(len(m), -1)
        count = np.zeros(len(vid), np.int64)
        label = vid.copy()
        found = []
        for at in range(0, len(q), 512):
            some = q[at : at + 512]
            far = np.zeros((len(some), len(m)))
            for s, t in enumerate(model.table(x[some], home)):
                far += t[:, codes[:, s]]
            near = far <= (radius + err[m] + 1e-6)[None] ** 2
            if own:  # a pair inside one block is looked at once
                near &= (side[some][:, None] != side[m][None]) | (some[:, None] > m[None])
            i, j = np.nonzero(near)
            i, j = some[i], m[j]
            for k in range(0, len(i), 1 << 16):
                a, b = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                true = np.einsum("ij,ij->i", x[a], x[b]) >= cosine
                a, b = a[true], b[true]
                np.add.at(count, a, mult[b])
                np.add.at(count, b, mult[a])
                found.append((a, b))
        a = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
        b = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
        while len(a):  # least id reachable within the cell
            low = np.minimum(label[a], label[b])
            before = label.copy()
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            if (label == before).all():
                break
        hit = np.flatnonzero(count)
        return pa.Table.from_arrays([pa.array(vid[hit]), pa.array(count[hit]), pa.array(label[hit])], names=["vid", "n", "root"])

    return links


def near_duplicates(rows: DataFrame, cosine: float = COSINE, reach: float = REACH) -> DataFrame:
    """One row per row of rows (vec_id, embedding): vec_id, n_links, component_id, kept.

    Two vectors link when they are of one length and their cosine in double precision is at least
    `cosine`; each length that occurs has an index of its own. Null and zero vectors and those with
    null or non-finite components link with nothing. Rows that repeat a vec_id count as vectors of
    their own and share its component.
    """
    kind = "array<float>" if rows.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = rows.select("vec_id", F.col("embedding").cast(kind).alias("vector"))
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0)
    good = F.coalesce(F.col("vec_id").isNotNull() & finite, F.lit(False))
    usable = rows.where(good)
    lengths = [r["d"] for r in usable.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).where("n > 1").orderBy("d").collect()]  # those of the models that made the vectors
    out = rows.where(~good | ~F.size("vector").isin(lengths)) if lengths else rows
    out = out.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    parts = [_linked(usable.where(F.size("vector") == d), kind, cosine, reach) for d in lengths]
    if len(parts) > 1:  # a vec_id with vectors of several lengths ties their components together
        named = stage(reduce(DataFrame.unionByName, parts), "named")
        tied = components(named.select(F.col("vec_id").alias("a"), F.col("component_id").alias("b")))
        parts = [named.join(tied.withColumnRenamed("node", "vec_id"), "vec_id", "left").select("vec_id", "n_links", F.coalesce("component", "component_id").alias("component_id"))]
    out = reduce(DataFrame.unionByName, parts, out)
    return out.select("*", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _linked(usable: DataFrame, kind: str, cosine: float, reach: float) -> DataFrame:
    """(vec_id, n_links, component_id) of usable vectors of one length."""
    usable = usable.withColumn("vec_id", F.col("vec_id").cast("long"))
    classes = stage(usable.groupBy("vector").agg(F.min("vec_id").alias("vid"), F.count("*").alias("mult")), "classes")
    lists = max(1, min(MOST_LISTS, classes.count() // LIST_SIZE))
    width = usable.select(F.size("vector")).first()[0]
    size = max(1, min(max(SAMPLE, lists * SAMPLE_PER_LIST), SAMPLE_BYTES // (8 * width)))
    sample = classes.orderBy(F.xxhash64("vector"), "vid").select("vector").limit(size).toArrow().column("vector")
    model = Quantiser(_unit(_matrix(sample)), lists)
    radius = float(np.sqrt(2 - 2 * cosine))
    index = stage(classes.select("vid", "mult", "vector").mapInArrow(_indexer(model, reach * radius), _INDEXED.format(kind=kind)), "index")

    asks = index.select("vid", "mult", "vector", F.explode("probes").alias("list"))
    blocks = index.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("mblocks"))
    turns = asks.groupBy("list").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("qblocks"))
    shape = F.broadcast(stage(blocks.join(turns, "list", "full").select("list", F.coalesce("mblocks", F.lit(0)).alias("mblocks"), F.coalesce("qblocks", F.lit(0)).alias("qblocks")), "shape"))  # one row per list at most
    block = lambda n: F.pmod(F.xxhash64("vid", "vector"), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)))
    members = index.join(shape, "list").withColumn("mb", block("mblocks"))
    inside = members.withColumn("ob", upto("mblocks")).select(
        F.lit(True).alias("own"), "list", F.least("mb", "ob").alias("x"), F.greatest("mb", "ob").alias("y"), F.signum(F.col("mb") - F.col("ob")).cast("int").alias("side"), "vid", "mult", "vector", "codes", "err"
    )
    held = members.withColumn("y", upto("qblocks")).select(F.lit(False).alias("own"), "list", F.col("mb").alias("x"), "y", F.lit(-1).alias("side"), "vid", "mult", "vector", "codes", "err")
    asked = asks.join(shape, "list").withColumn("y", block("qblocks")).withColumn("x", upto("mblocks")).select(
        F.lit(False).alias("own"), "list", "x", "y", F.lit(1).alias("side"), "vid", "mult", "vector", F.lit(None).cast("binary").alias("codes"), F.lit(0.0).alias("err")
    )
    cells = inside.unionByName(held).unionByName(asked)
    links = stage(cells.groupBy("own", "list", "x", "y").applyInArrow(_cell(model, cosine, radius), "vid long, n long, root long"), "links")
    # rows that repeat a vec_id tie their classes together
    same = usable.groupBy("vec_id").agg(F.count_distinct("vector").alias("n")).where("n > 1").select("vec_id")
    ties = classes.select(F.col("vid").alias("b"), "vector").join(usable.join(same, "vec_id", "left_semi").select(F.col("vec_id").alias("a"), "vector"), "vector").select("a", "b")
    comp = components(links.where("vid <> root").select(F.col("vid").alias("a"), F.col("root").alias("b")).unionByName(ties))
    told = (
        classes.select("vid", "mult", "vector")
        .join(links.groupBy("vid").agg(F.sum("n").alias("n")), "vid", "left")
        .join(comp.withColumnRenamed("node", "vid"), "vid", "left")
        .select("vector", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "vid").alias("component_id"))
    )
    return usable.join(stage(told, "told"), "vector").select("vec_id", "n_links", "component_id")


def op9_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP9_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, CAST(component_id AS BIGINT) AS component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""
