"""Whitening of embeddings by a compensated covariance.

Vectors are whole numbers of 1/scale. Their mean is exact; centred vectors and the sums of their outer products are
double-doubles. A block's outer products come from an error-free transformation: each centred column is
split into slices of so few bits that matrix products of slices are exact in doubles, and these are added up
with their rounding errors kept. Tasks' high and low parts are merged row by row of the matrix. The
eigen-solve is that of numpy's eigh (LAPACK's syevd: reduction to tridiagonal form, then divide and conquer),
followed by one step of refinement against high and low parts in extended precision.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

#: Whole numbers to 1, and the components of a result.
SCALE, COMPONENTS = 256, 4
#: Rows of one matrix product; slices of a centred column, and the bits of each: 2 * bits + log2(rows) <= 53.
ROWS, SLICES, SLICE_BITS = 256, 4, 22
#: Vector lengths of a table; each is a space of its own.
MOST_LENGTHS = 100
#: Partial sums that meet in one task.
FAN_IN = 512


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a + b as its rounded value and the error of that."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def plus(high: np.ndarray, low: np.ndarray, more: np.ndarray, less: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """A sum of double-doubles."""
    s, e = two_sum(high, more)
    return two_sum(s, e + (low + less))


def as_doubles(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit whole numbers as double-doubles, exactly."""
    return two_sum((x >> 32).astype(float) * 2.0**32, (x & 0xFFFFFFFF).astype(float))


def mean_of(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    exact = [Fraction(s, n) for s in sums]
    high = [float(m) for m in exact]
    return np.array(high), np.array([float(m - Fraction(h)) for m, h in zip(exact, high)])


def slices_of(high: np.ndarray, low: np.ndarray) -> list[np.ndarray]:
    """Columns split into SLICES parts that are multiples of a column's unit, at most 2**SLICE_BITS of it."""
    top = np.abs(high).max(axis=0, initial=0.0)
    unit = np.exp2(np.ceil(np.log2(np.where(top > 0, top, 1.0))) - SLICE_BITS)
    out = []
    for _ in range(SLICES):
        part = np.rint(high / unit) * unit
        high, low = two_sum(high - part, low)
        out.append(part)
        unit = unit * 2.0**-SLICE_BITS
    return out


class Products:
    """The sum of outer products of centred vectors, as high and low parts."""

    def __init__(self, n: int, sums: list[int]):
        self.mean = mean_of(n, sums)
        self.high = np.zeros((len(sums), len(sums)))
        self.low = np.zeros_like(self.high)

    def add(self, x: np.ndarray) -> None:
        for at in range(0, len(x), ROWS):
            high, low = as_doubles(x[at : at + ROWS])
            parts = slices_of(*plus(high, low, -self.mean[0], -self.mean[1]))
            for i in range(SLICES):
                for j in range(i, SLICES - i):
                    exact = parts[i].T @ parts[j]
                    for product in (exact,) if i == j else (exact, exact.T):
                        self.high, error = two_sum(self.high, product)
                        self.low += error
            self.high, self.low = two_sum(self.high, self.low)


def eigen(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of the symmetric matrix high + low, falling, and their unit vectors as columns."""
    _, vectors = np.linalg.eigh(high)
    wide = high.astype(np.longdouble) + low
    x = vectors.astype(np.longdouble)
    image = wide @ x
    gram = np.eye(len(x), dtype=np.longdouble) - x.T @ x
    s = x.T @ image
    s, gram = (s + s.T) / 2, (gram + gram.T) / 2  # else a rounding error over a small gap turns a pair of vectors
    values = np.diag(s) / (1 - np.diag(gram))
    gap = values[None, :] - values[:, None]
    off = s - np.diag(np.diag(s))
    noise = 2 * (np.abs(off).max(initial=0) + np.abs(values).max(initial=0) * np.abs(gram).max(initial=0))
    apart = np.abs(gap) > noise
    turn = np.where(apart, (s + values[None, :] * gram) / np.where(apart, gap, 1), gram / 2)
    np.fill_diagonal(turn, np.diag(gram) / 2)
    x = x + x @ turn
    x /= np.sqrt((x * x).sum(axis=0))
    order = np.argsort(-values, kind="stable")
    return values[order].astype(float), x[:, order].astype(float)


@dataclass
class Space:
    """The vectors of one length: how many distinct ones, their sums, and the components."""

    n: int
    sums: list[int]
    vectors: np.ndarray | None = None
    values: np.ndarray | None = None
    explained: np.ndarray | None = None
    identity_error: float | None = None

    def solve(self, high: np.ndarray, low: np.ndarray, components: int) -> None:
        values, vectors = eigen(high, low)
        trace = float((np.diag(high).astype(np.longdouble) + np.diag(low)).sum())
        k = min(components, len(values))
        spread = values[:k] > len(values) * np.finfo(float).eps * max(values[0], 0.0) if k else np.zeros(0, bool)
        vectors = vectors[:, :k]
        # of either sign the one whose largest entry is positive
        vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)
        self.vectors, self.values = vectors, np.where(spread, values[:k], 0.0) / self.n
        self.explained = np.where(spread, values[:k], 0.0) / trace if trace > 0 else np.zeros(k)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """sum((n * x - sums)**2) of each row, None beyond 64 bits."""
        most = max(1, int(np.abs(x.astype(float)).max(initial=0.0)) * self.n + max(map(abs, self.sums), default=0) + 1)
        if most * most * max(1, len(self.sums)) < 1 << 62:
            d = x * self.n - np.array(self.sums, np.int64)
            return (d * d).sum(axis=1).tolist()
        exact = [sum((int(c) * self.n - s) ** 2 for c, s in zip(row, self.sums)) for row in x.tolist()]
        return [d if d < 1 << 63 else None for d in exact]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        mean = mean_of(self.n, self.sums)
        high, low = plus(*as_doubles(x), -mean[0], -mean[1])
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > 0, (high @ self.vectors + low @ self.vectors) / np.sqrt(self.values), np.nan)


def whole(vectors: DataFrame, column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vectors without the rows whose vector is null or holds null or non-finite entries, and with `x`: the rest's
    entries as whole numbers, floor(scale * entry)."""
    fine = F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    x = F.transform(column, lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("long"))
    return vectors.where(F.col(column).isNotNull() & fine).withColumn("x", x)


def _by_length(column: pa.Array):
    """(length, rows, matrix) of the vectors of a list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    length = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    start = np.cumsum(length) - length
    for d in np.unique(length).tolist():
        rows = np.flatnonzero(length == d)
        yield d, rows, flat[start[rows][:, None] + np.arange(d)]


def _sums(batches):
    """Rows of each length and the sums of their entries, halves of 32 bits apart so that they stay exact."""
    total: dict[int, np.ndarray] = {}
    count: dict[int, int] = {}
    for batch in batches:
        for d, rows, x in _by_length(batch.column("x")):
            total[d] = total.get(d, 0) + np.stack([(x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)])
            count[d] = count.get(d, 0) + len(rows)
    for d, halves in total.items():
        cols = [np.full(d, d), np.arange(d), np.full(d, count[d]), *halves]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], ["d", "j", "n", "high", "low"])


_PART = "d long, i long, salt long, high binary, low binary"
_PART_NAMES = [c.split()[0] for c in _PART.split(", ")]


def _outer(spaces: dict[int, Space]):
    def run(batches):
        own: dict[int, Products] = {}
        for batch in batches:
            for d, _, x in _by_length(batch.column("x")):
                if d not in own:
                    own[d] = Products(spaces[d].n, spaces[d].sums)
                own[d].add(x)
        salt = TaskContext.get().partitionId()
        for d, sums in own.items():
            cols = [[d] * d, range(d), [salt] * d, *([part[i, i:].tobytes() for i in range(d)] for part in (sums.high, sums.low))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES)], _PART_NAMES)

    return run


_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]


def _merge(rows: pa.Table) -> pa.Table:
    """The sum of the high and low parts of one row of a matrix, in an order that reruns agree on."""
    parts = sorted(zip(rows.column("high").to_pylist(), rows.column("low").to_pylist()))
    high, low = (np.zeros(len(parts[0][0]) // 8) for _ in range(2))
    for h, l in parts:
        high, low = plus(high, low, np.frombuffer(h), np.frombuffer(l))
    cols = [[rows.column(c)[0].as_py()] for c in _PART_NAMES[:3]] + [[high.tobytes()], [low.tobytes()]]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES)], names=_PART_NAMES)


def _solver(spaces: dict[int, Space], components: int):
    def run(rows: pa.Table) -> pa.Table:
        d = rows.column("d")[0].as_py()
        high, low = np.zeros((d, d)), np.zeros((d, d))
        for i, h, l in zip(*(rows.column(c).to_pylist() for c in ("i", "high", "low"))):
            high[i, i:] = high[i:, i] = np.frombuffer(h)
            low[i, i:] = low[i:, i] = np.frombuffer(l)
        space = spaces[d]
        space.solve(high, low, components)
        made = [[d], [space.vectors.ravel().tolist()], [space.values.tolist()], [space.explained.tolist()]]
        return pa.Table.from_arrays([pa.array(made[0]), *(pa.array(m, pa.list_(pa.float64())) for m in made[1:])], names=["d", "vectors", "vals", "explained"])

    return run


def fit(fitted: DataFrame, components: int = COMPONENTS) -> dict[int, Space]:
    """The spaces of the vectors in `x` of fitted (a staged table), by length. What reaches the driver is a sum and
    `components` numbers per dimension; more than MOST_LENGTHS lengths are an error."""
    spark = fitted.sparkSession
    exact = F.sum("high").cast("decimal(38,0)") * F.lit(1 << 32) + F.sum("low")
    sums = fitted.where(F.size("x") > 0).mapInArrow(_sums, "d long, j long, n long, high long, low long").groupBy("d", "j").agg(F.sum("n").alias("n"), exact.cast("decimal(38,0)").alias("s"))
    sums = stage(sums, "sums")
    lengths = sums.select("d").distinct().limit(MOST_LENGTHS + 1).collect()
    if len(lengths) > MOST_LENGTHS:
        raise ValueError(f"vectors of more than {MOST_LENGTHS} lengths")
    spaces: dict[int, Space] = {}
    for r in sums.orderBy("d", "j").collect():
        spaces.setdefault(r["d"], Space(r["n"], [])).sums.append(int(r["s"]))
    if not spaces:
        return spaces
    parts = fitted.where(F.size("x") > 0).mapInArrow(_outer(spaces), _PART)
    parts = parts.withColumn("salt", F.floor(F.col("salt") / FAN_IN)).groupBy("d", "i", "salt").applyInArrow(_merge, _PART)
    parts = stage(parts.groupBy("d", "i").applyInArrow(_merge, _PART), "covariance")
    solved = parts.groupBy("d").applyInArrow(_solver(spaces, components), "d long, vectors array<double>, vals array<double>, explained array<double>")
    for r in solved.collect():
        space = spaces[r["d"]]
        space.values, space.explained = np.array(r["vals"]), np.array(r["explained"])
        space.vectors = np.array(r["vectors"]).reshape(r["d"], -1)
    # the whitened vectors' own covariance
    k = components
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    white = fitted.where(F.size("x") > 0).mapInArrow(_projector(spaces), "d long, w array<double>")
    seen = white.groupBy("d").agg(*[F.covar_pop(F.get("w", F.lit(i)), F.get("w", F.lit(j))).alias(f"c{i}_{j}") for i, j in pairs])
    for r in seen.collect():
        off = [abs(r[f"c{i}_{j}"] - (i == j)) for i, j in pairs if r[f"c{i}_{j}"] is not None]
        spaces[r["d"]].identity_error = max(off) if off else None
    return spaces


def _projector(spaces: dict[int, Space]):
    def run(batches):
        for batch in batches:
            for d, rows, x in _by_length(batch.column("x")):
                w = spaces[d].whitened(x)
                flat = pa.array(w.ravel(), mask=np.isnan(w.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), d)), pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * w.shape[1]), flat)], ["d", "w"])

    return run


_WHITE = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _writer(spaces: dict[int, Space]):
    names = [c.split()[0] for c in _WHITE.split(", ")]

    def run(batches):
        for batch in batches:
            ids = batch.column("vec_id")
            for d, rows, x in _by_length(batch.column("x")):
                space = spaces[d]
                w, k = space.whitened(x), len(space.values)
                each = np.repeat(rows, k)
                cols = [
                    ids.take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
                    pa.array(np.full(len(each), space.n)),
                    pa.array(space.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(len(rows)), k))),
                    pa.array(w.ravel(), mask=np.isnan(w.ravel())),
                    pa.array(np.tile(space.explained, len(rows))),
                    pa.array([space.identity_error] * len(each), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def whitening(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row per vector and component.

    Vectors (`embedding`) that are null or hold null or non-finite entries are dropped, also from the fit; entries
    count in whole numbers floor(scale * entry), at most those of 64 bits. The fit takes each distinct
    vector once, so repeated rows do not weigh more; each row has its result. Vectors of another length are a
    space of their own, with their own n and components; an empty vector has no components and no row.
    Components are numbered by falling eigenvalue, at most as many as dimensions. One without spread (a single
    vector, or all on a plane) has null in whitened and 0 in explained, and counts in no identity_error.
    deviation is null beyond 64 bits. vec_ids are whole numbers; null and repeated ones stay as they are. Other columns are ignored.
    """
    rows = whole(vectors.select(F.col("vec_id").cast("long"), "embedding"), scale=scale).select("vec_id", "x").where(F.size("x") > 0)
    spaces = fit(stage(rows.select("x").distinct(), "distinct"), components)
    return rows.mapInArrow(_writer(spaces), _WHITE)


def op12_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    return whitening(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
