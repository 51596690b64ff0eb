"""Quality classifier by positive-unlabelled learning.

Texts become counts of byte classes, bytes and hashed byte pairs plus shape statistics. A small
network is fitted by minimising the non-negative unbiased risk: trusted positives, an unlabelled
sample of the web text, and an estimated class prior. Negative labels take no part in the risk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SEPARATORS, Spans, free_names, frugal, slices, utf8, word_bounds

#: Rows with crc32(doc_id as text) mod FOLDS equal to HELD_OUT teach nothing.
FOLDS, HELD_OUT = 4, 2
CUT = 0.7
#: Trusted positives and unlabelled documents that fit the model, at most.
POSITIVES, UNLABELLED = 8_000, 16_000
PAIR_CELLS = 512
HIDDEN = 24
_SPACE = np.zeros(256, bool)
_SPACE[list(SEPARATORS.encode())] = True
_KIND = np.zeros(256, np.int64)  # other, space, lower, upper, digit, punctuation, multi-byte
_KIND[_SPACE] = 1
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 2, 3, 4
_KIND[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = 5
_KIND[128:] = 6
SHAPE = 14
WIDTH = 256 + PAIR_CELLS + 49 + SHAPE


def features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row per text: square roots of the shares of bytes, of byte-pair cells and of pairs of
    byte kinds, then shape statistics. Whole texts; an empty text gives zeros."""
    n = len(at) - 1
    size = np.diff(at)
    doc = np.repeat(np.arange(n), size)
    one = np.maximum(size, 1).astype(float)[:, None]
    table = lambda cell, width, owner: np.bincount(owner * width + cell, minlength=n * width).reshape(n, width)
    byte = table(data.astype(np.int64), 256, doc) / one
    same = doc[1:] == doc[:-1]
    first, second = data[:-1][same].astype(np.int64), data[1:][same].astype(np.int64)
    pair = table((first * 40503 + second * 9973) % PAIR_CELLS, PAIR_CELLS, doc[1:][same]) / one
    kinds = table(_KIND[first] * 7 + _KIND[second], 49, doc[1:][same]) / one
    starts, ends, before = word_bounds(data, at)
    words = np.diff(before)
    w = np.maximum(words, 1).astype(float)
    owner = np.repeat(np.arange(n), words)
    length = (ends - starts).astype(float)
    mean = np.bincount(owner, length, n) / w
    var = np.maximum(np.bincount(owner, length**2, n) / w - mean**2, 0)
    hashes = Spans(data).hash(starts, ends)
    order = np.lexsort((hashes, owner))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    distinct = np.bincount(owner[order][new], minlength=n)
    kind = table(_KIND[data], 7, doc) / one
    tail = _KIND[data[ends - 1]] if len(ends) else np.zeros(0, np.int64)
    mid = np.bincount(owner, tail == 5, n) / w
    shout = np.bincount(owner, (_KIND[data[starts]] == 3) & (tail == 3) if len(ends) else None, n) / w if len(ends) else np.zeros(n)
    lines = np.bincount(doc[data == 10], minlength=n)
    shape = np.stack([np.log1p(size) / 10, np.log1p(words) / 8, mean / 10, np.sqrt(var) / 10, distinct / w, mid, shout, np.log1p(lines) / 5, lines / w, *kind.T[2:]], 1)
    out = np.concatenate([np.sqrt(byte), np.sqrt(pair), np.sqrt(kinds), shape], 1)
    out[size == 0] = 0
    return out


class PUClassifier:
    """One hidden layer fitted by the non-negative PU risk with the logistic loss and Adam.

    risk = prior * E_p[l(+)] + max(0, E_u[l(-)] - prior * E_p[l(-)])
    Where the bracket falls under zero, the step goes against it instead (Kiryo et al., 2017).
    """

    def __init__(self, positives: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = 40, seed: int = 5, least_steps: int = 800):
        rng = np.random.default_rng(seed)
        n = len(positives) + len(unlabelled)
        self.mean = (positives.sum(0, dtype=np.float64) + unlabelled.sum(0, dtype=np.float64)) / n
        square = sum(np.einsum("ij,ij->j", x, x, dtype=np.float64) for x in (positives, unlabelled)) / n
        self.std = np.sqrt(np.maximum(square - self.mean**2, 0)) + 1e-3
        p, u = self._scaled(positives), self._scaled(unlabelled)
        d = p.shape[1]
        self.w = [rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        m, v = [np.zeros_like(x) for x in self.w], [np.zeros_like(x) for x in self.w]
        step = 0
        batches = max(1, min(len(u), len(p) * 4) // 512)
        rounds = max(rounds, least_steps // batches)  # small samples take as many steps as large ones
        for r in range(rounds):
            pi, ui = rng.permutation(len(p)), rng.permutation(len(u))
            for ps, us in zip(np.array_split(pi, batches), np.array_split(ui, batches)):
                if not len(ps) or not len(us):
                    continue
                step += 1
                grads = self._gradient(p[ps], u[us], prior)
                for k, g in enumerate(grads):
                    g = g + 3e-4 * self.w[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.w[k] = self.w[k] - 2e-3 * (0.5 ** (3 * r // rounds)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        out = x - self.mean.astype(x.dtype)
        out /= self.std.astype(x.dtype)
        return np.clip(out, -8, 8, out=out)

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.tanh(x @ self.w[0] + self.w[1])
        return hidden, hidden @ self.w[2] + self.w[3]

    def _gradient(self, p: np.ndarray, u: np.ndarray, prior: float) -> list[np.ndarray]:
        x = np.concatenate([p, u])
        hidden, z = self._forward(x)
        good = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        soft = np.logaddexp(0, z)  # the loss of calling x negative
        n, k = len(p), len(u)
        rest = soft[n:].mean() - prior * soft[:n].mean()
        dz = np.zeros(n + k)
        if rest >= 0:
            dz[:n] = prior * ((good[:n] - 1) - good[:n]) / n
            dz[n:] = good[n:] / k
        else:
            dz[:n] = prior * good[:n] / n
            dz[n:] = -good[n:] / k
        back = dz[:, None] * self.w[2] * (1 - hidden**2)
        return [x.T @ back, back.sum(0), hidden.T @ dz, np.array([dz.sum()])]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self._forward(self._scaled(x))[1]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _featured(batches):
    for batch in batches:
        data, at = utf8(batch.column("text"))
        for a, b in slices(at, 1 << 19):
            x = features(data[at[a] : at[b]], at[a : b + 1] - at[a]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("quality").slice(a, b - a), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), WIDTH).cast(pa.list_(pa.float32()))], ["quality", "x"])


def _scorer(model: PUClassifier, names: list[str]):
    def rows(batches):
        for batch in batches:
            data, at = utf8(batch.column("text"))
            scores = [model.score(features(data[at[a] : at[b]], at[a : b + 1] - at[a])) for a, b in slices(at, 1 << 19)]
            cols = [batch.column(i) for i in range(len(names) - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.concatenate(scores) if scores else np.zeros(0))], names)

    return rows


def held_out() -> F.Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD_OUT


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> PUClassifier | None:
    """Fit on bounded samples, the rows of smallest id hash: trusted positives from labels that are
    not held out, unlabelled text from all documents. Of rows that repeat a doc_id, one text is a
    positive, and equal ones are drawn once as unlabelled. The class prior is the share of quality 1
    among the labels that are not held out, plus one of each. None if nothing is labelled 1.
    """
    known = labels.where(~held_out() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n = known.agg(F.count("*").alias("n"), F.coalesce(F.sum("quality"), F.lit(0)).alias("good")).first()
    if not n["good"]:
        return None
    prior = (n["good"] + 1) / (n["n"] + 2)
    trusted = known.where("quality = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(positives)
    text = docs.select("doc_id", "text")
    good = text.join(F.broadcast(trusted.select("doc_id")), "doc_id").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # at most `positives` rows
    among = docs.count()
    drawn = text if among <= unlabelled else text.where(F.xxhash64("doc_id", "text", F.lit(3)) < F.lit((1 << 64) * unlabelled // among - (1 << 63)))
    rest = drawn.groupBy("doc_id", F.xxhash64("text").alias("text_key")).agg(F.first("text").alias("text"))
    sample = good.select(F.lit(1).alias("quality"), "text").unionByName(rest.select(F.lit(0).alias("quality"), "text")).mapInArrow(_featured, "quality int, x array<float>").toArrow()
    mark = sample.column("quality").to_numpy()
    x, at = np.empty((len(mark), WIDTH), np.float32), 0
    for part in sample.column("x").chunks:
        x[at : at + len(part)] = part.flatten().to_numpy().reshape(-1, WIDTH)
        at += len(part)
    del sample
    order = np.lexsort((*x[:, :8].T, x.sum(1)))  # the same order at every run
    if not (mark == 1).any():
        return None  # no labelled document is there
    if not (mark == 0).any():
        raise ValueError(f"no unlabelled document was drawn from {among}")
    good, rest = (x[order[mark[order] == k]] for k in (1, 0))
    del x
    return PUClassifier(good, rest, prior)


def scored(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """docs with `score`, the chance of quality 1, from whole texts alone. Null text is empty;
    without positive labels every score is 0.5. doc_id chooses samples and the held-out fold, and
    is no input of a score. A column `score` of docs is replaced, and no input either."""
    return _scored(docs, fit(docs, labels, **how), "score")


def _scored(docs: DataFrame, model: PUClassifier | None, name: str) -> DataFrame:
    docs = docs.drop(name)
    out = docs.withColumn(name, F.lit(0.5))
    return out if model is None else docs.mapInArrow(frugal(_scorer(model, out.columns)), out.schema)


def kept_documents(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The rows of docs with a score of at least cut, with all their columns; all rows if no positive
    label gives a model."""
    model = fit(docs, labels)
    if model is None:
        return docs
    (name,) = free_names(docs, "score")
    return _scored(docs, model, name).where(F.col(name) >= cut).select(*docs.columns)


def op3_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return scored(docs, labels).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
