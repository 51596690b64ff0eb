"""Scaling, neighbours, clusters, classifiers and novelty over feature vectors."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import step_features
from ..staging import new_folder, staged

#: Rows of one side of a block of distances.
BLOCK = 2048
#: Rows of one side of a pair of blocks that meets in one task at most, and sums by row and label that it holds.
LARGEST_BLOCK, BLOCK_CELLS = 1 << 16, 1 << 22
#: Trees of a forest that are grown at a time.
FOREST_PART = 25
#: Rows times trees that the driver grows at most at once, as a tree has fewer nodes than twice its rows, and rows of
#: one task: each task makes a table of counts for each open node, so more tasks than the rows need cost more.
FOREST_ROWS, FOREST_TASK_ROWS = 800_000, 20_000


def scaled(df: DataFrame, vector: str = "vector") -> DataFrame:
    """df with the vector's components less their mean over their population deviation (1 where 0).
    The means are as many as the vector is long."""
    parts = df.select(F.posexplode(vector).alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    fit = parts.agg(F.array_sort(F.collect_list(F.struct("pos", "m", F.when(F.col("s") == 0, 1.0).otherwise(F.col("s")).alias("s")))).alias("_fit"))
    return df.join(F.broadcast(fit), F.lit(True)).withColumn(vector, F.zip_with(vector, "_fit", lambda x, f: (x - f["m"]) / f["s"])).drop("_fit")


def _blocks(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    n = max(1, -(-df.count() // BLOCK))
    return df.withColumn(name, F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")), n


def _paired(queries: DataFrame, rows: DataFrame):
    """Both sides grouped by (query block, row block), each block on every block of the other side."""
    apart = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns])  # noqa: E731  the sides may share a source
    q, nq = _blocks(apart(queries), "qb")
    r, nr = _blocks(apart(rows), "rb")
    q = q.withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(nr - 1))))
    r = r.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    return q.groupBy("qb", "rb").cogroup(r.groupBy("qb", "rb"))


def _distances(q: pd.DataFrame, r: pd.DataFrame) -> np.ndarray:
    a, b = np.array(q["vector"].tolist(), float), np.array(r["vector"].tolist(), float)
    return np.sqrt(np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T, 0))


def neighbours(queries: DataFrame, rows: DataFrame, k: int = 5) -> DataFrame:
    """(id, near): the k nearest rows of each query, other than itself, as {dist, id, label}.

    queries: id, vector; rows: id, label, vector. Blocks give their k nearest, which are merged.
    """

    def part(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(r):
            return pd.DataFrame({"id": [], "dist": [], "other": [], "label": []})
        d = _distances(q, r)
        d[q["id"].to_numpy()[:, None] == r["id"].to_numpy()[None]] = np.inf
        near = np.argsort(d, 1, kind="stable")[:, :k]
        at = np.repeat(np.arange(len(q)), near.shape[1])
        out = pd.DataFrame({"id": q["id"].to_numpy()[at], "dist": d[at, near.ravel()], "other": r["id"].to_numpy()[near.ravel()], "label": r["label"].to_numpy()[near.ravel()]})
        return out[np.isfinite(out["dist"])]

    kind = dict(rows.dtypes)["label"]
    found = _paired(queries.select("id", "vector"), rows.select("id", "label", "vector")).applyInPandas(part, f"id long, dist double, other long, label {kind}")
    return found.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("dist", F.col("other").alias("id"), "label"))), 1, k).alias("near"))


def knn_classify(queries: DataFrame, rows: DataFrame, k: int = 5) -> DataFrame:
    """(id, predicted): the most frequent label of the k nearest rows, of equal ones the smallest."""
    votes = neighbours(queries, rows, k).select("id", F.explode("near").alias("n"))
    return votes.groupBy("id").agg(F.mode("n.label", True).alias("predicted"))


def silhouette_blocks(n: int, labels: int, tasks: int) -> int:
    """How many blocks n rows make: as many as give each task some pairs of blocks, more only where a block would
    outgrow its bounds. Each row moves once a block, so until then the shuffle grows as the rows do."""
    least = max(BLOCK, min(LARGEST_BLOCK, BLOCK_CELLS // max(1, labels)))
    return max(1, -(-n // least), min(-(-n // BLOCK), math.isqrt(8 * tasks) + 1))


def _label_sums(q: pd.DataFrame, r: pd.DataFrame | None = None) -> pd.DataFrame:
    """(id, own, other, total): sums of distances from each row of q to each label's rows in r and the other way
    round, of each pair once; without r, within q. By tiles of BLOCK rows."""
    sides = [q] if r is None else [q, r]
    coded = [pd.factorize(s["label"]) for s in sides]  # no code for null
    sums = [np.zeros((len(s), len(names))) for s, (_, names) in zip(sides, reversed(coded))]
    ones = [lambda at, c=codes, n=len(names): (c[at, None] == np.arange(n)).astype(float) for codes, names in coded]
    tiles = [[slice(i, i + BLOCK) for i in range(0, len(s), BLOCK)] for s in sides]
    for i in tiles[0]:
        for j in tiles[-1]:
            if r is None and j.start < i.start:
                continue
            d = _distances(q[i], sides[-1][j])
            if r is None and i == j:
                np.fill_diagonal(d, 0.0)
            sums[0][i] += d @ ones[-1](j)
            if r is not None or i != j:
                sums[-1][j] += d.T @ ones[0](i)
    parts = []
    for s, total, (_, names) in zip(sides, sums, reversed(coded)):
        at = np.repeat(np.arange(len(s)), len(names))
        parts.append(pd.DataFrame({"id": s["id"].to_numpy()[at], "own": s["label"].to_numpy()[at], "other": np.tile(np.asarray(names), len(s)), "total": total.ravel()}))
    return pd.concat(parts)


def silhouettes(rows: DataFrame) -> DataFrame:
    """(id, silhouette) by exact Euclidean distances; rows: id, label, vector. Alone in a cluster: 0.
    Blocks of rows meet in pairs, each pair once; the work is quadratic by nature."""

    def part(key: tuple, both: pd.DataFrame) -> pd.DataFrame:
        q, r = (both[both["block"] == k].reset_index(drop=True) for k in key)
        if key[0] == key[1]:
            return _label_sums(q)
        return _label_sums(q, r) if len(q) and len(r) else pd.DataFrame({"id": [], "own": [], "other": [], "total": []})

    kind = dict(rows.dtypes)["label"]
    n, labels = rows.agg(F.count("*"), F.count_distinct("label")).first()
    blocks = silhouette_blocks(n, labels, rows.sparkSession.sparkContext.defaultParallelism)
    cols = rows.select("id", "label", "vector").withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    cols = cols.withColumn("with", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumns({"a": F.least("block", "with"), "b": F.greatest("block", "with")}).drop("with")
    sums = cols.groupBy("a", "b").applyInPandas(part, f"id long, own {kind}, other {kind}, total double").groupBy("id", "own", "other").agg(F.sum("total").alias("total"))
    sizes = rows.groupBy(F.col("label").alias("other")).agg(F.count("*").alias("n"))
    means = sums.join(sizes, "other").withColumn("mean", F.when(F.col("own") == F.col("other"), F.try_divide("total", F.col("n") - 1)).otherwise(F.col("total") / F.col("n")))
    a, b = F.max(F.when(F.col("own") == F.col("other"), F.col("mean"))), F.min(F.when(F.col("own") != F.col("other"), F.col("mean")))
    ab = means.groupBy("id").agg(a.alias("a"), b.alias("b"))
    return ab.select("id", F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)).alias("silhouette"))


def _vectors(df: DataFrame) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.withColumn("features", array_to_vector("vector"))


def kmeans(df: DataFrame, k: int, starts: int = 10, seed: int = 0) -> DataFrame:
    """df with `cluster`, from the start of least cost."""
    from pyspark.ml.clustering import KMeans

    data = _vectors(df).persist()
    models = [KMeans(k=k, seed=seed + i).fit(data) for i in range(starts)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    data.unpersist()
    out = best.transform(_vectors(df)).withColumnRenamed("prediction", "cluster").drop("features")
    return out


def silhouette_curve(df: DataFrame, ks=range(2, 16), starts: int = 1) -> list[tuple[int, float]]:
    """(k, mean exact silhouette) for each number of clusters."""
    out = []
    for k in ks:
        labelled = kmeans(df, k, starts).select("id", F.col("cluster").alias("label"), "vector")
        out.append((k, silhouettes(labelled).agg(F.avg("silhouette")).first()[0]))
    return out


class Fitted:
    """A fitted classifier: predicts for any table with `vector`, and can be stored and read again."""

    def __init__(self, index, model):
        self.index, self.model = index, model

    def predict(self, df: DataFrame, name: str = "predicted", with_shares: bool = False, confidence: str = "confidence") -> DataFrame:
        """df with `name`, the likeliest label, of equally likely ones the first by name, and its probability as `confidence`;
        with_shares: also `shares`, the probability of each label in the order of `labels`. Columns of df with
        these names are replaced."""
        from pyspark.ml.functions import vector_to_array

        known = len(self.index.labels)
        said = self.model.transform(_vectors(df.drop(confidence, "shares")))
        said = said.withColumn("shares", F.slice(vector_to_array("probability"), 1, known)).drop("features", "rawPrediction", "probability", "said_no")
        # the earliest of the largest; labels are sorted by name
        best = F.array_position("shares", F.array_max("shares")).cast("int") - 1
        said = said.withColumns({name: F.get(F.array(*[F.lit(x) for x in self.index.labels]), best), confidence: F.array_max("shares")})
        return said if with_shares else said.drop("shares")

    @property
    def labels(self) -> list[str]:
        return list(self.index.labels)

    def save(self, path: str) -> None:
        self.index.write().overwrite().save(f"{path}/labels")
        self.model.write().overwrite().save(f"{path}/model")

    @staticmethod
    def load(path: str, kind) -> Fitted:
        """kind: the model's class, such as RandomForestClassificationModel."""
        from pyspark.ml.feature import StringIndexerModel

        return Fitted(StringIndexerModel.load(f"{path}/labels"), kind.load(f"{path}/model"))


def fitted(train: DataFrame, learner) -> Fitted:
    """train: label, vector."""
    from pyspark.ml.feature import StringIndexer

    data = _vectors(train).withColumn("label", F.col("label").cast("string"))
    index = StringIndexer(inputCol="label", outputCol="label_no", stringOrderType="alphabetAsc", handleInvalid="keep").fit(data)
    return Fitted(index, learner.setLabelCol("label_no").setPredictionCol("said_no").fit(index.transform(data)))


def _classified(train: DataFrame, test: DataFrame, learner) -> DataFrame:
    return fitted(train, learner).predict(test.withColumn("label", F.col("label").cast("string"))).select("id", "label", "predicted")


def step_vectors(steps: DataFrame) -> DataFrame:
    """steps with `vector`, the seven features of a step."""
    made = step_features("delta_p", "delta_q")
    return steps.withColumn("vector", F.array(*made.values()))


def step_forest(labelled: DataFrame, trees: int = 300, depth: int = 20, seed: int = 0) -> Fitted:
    """A forest that names the device of a step. labelled: label, delta_p, delta_q, as true events tell them."""
    from pyspark.ml.classification import RandomForestClassifier

    return fitted(step_vectors(labelled).select("label", "vector"), RandomForestClassifier(numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", seed=seed))


def with_said(steps: DataFrame, forest: Fitted) -> DataFrame:
    """steps with `said`, the forest's device for each as if it were switched on; the tracker's near-ties go by it."""
    turned = F.when(F.col("delta_p") >= 0, 1.0).otherwise(-1.0)
    as_on = steps.withColumns({"_p": F.col("delta_p"), "_q": F.col("delta_q"), "delta_p": F.abs("delta_p"), "delta_q": F.col("delta_q") * turned})
    said = forest.predict(step_vectors(as_on), "said", confidence="_sure").drop("vector", "_sure")
    return said.withColumns({"delta_p": F.col("_p"), "delta_q": F.col("_q")}).drop("_p", "_q")


def onboarded(labelled: DataFrame, name: str, dp: float, dq: float, copies: int = 40, spread: float = 0.02, seed: int = 0) -> Fitted:
    """The step forest trained anew with a further device, of which `copies` steps around (dp, dq) are made."""
    turn = 1.0 if dp >= 0 else -1.0
    u = lambda k: (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(2001)) - 1000) / 1000.0 * spread
    more = labelled.sparkSession.range(copies).select(F.lit(name).alias("label"), (F.lit(abs(float(dp))) * (1 + u("p"))).alias("delta_p"), (F.lit(float(dq) * turn) * (1 + u("q"))).alias("delta_q"))
    return step_forest(labelled.select("label", "delta_p", "delta_q").unionByName(more), seed=seed)


def false_alarms(means: DataFrame, repeats: int = 20, noise: float = 0.05, seed: int = 0, k: float = 2.0) -> DataFrame:
    """(label, alarms, n): how often a known device, its means moved by noise * the components' sample
    deviations over the devices, looks novel."""
    from .synthesis import normal

    dev = means.groupBy("pos").agg(F.coalesce(F.stddev_samp("x"), F.lit(0.0)).alias("s"))
    tries = means.join(dev, "pos").withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    moved = tries.withColumn("x", F.col("x") + normal(0.0, noise * F.col("s"), F.lit(seed), "label", "pos", "repeat"))
    rows = moved.groupBy("label", "repeat").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda c: c["x"]).alias("vector"))
    return novel_rows(rows, means, k).groupBy("label").agg(F.count_if("novel").alias("alarms"), F.count("*").alias("n"))


class Parts:
    """Forests that are parts of one: a row's votes are the sums of theirs."""

    def __init__(self, models: list):
        self.models = models

    def transform(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import array_to_vector, vector_to_array

        out, votes = df, None
        for i, model in enumerate(self.models):
            # each part adds its votes and nothing else
            out = model.setRawPredictionCol(f"_votes{i}").setProbabilityCol("").setPredictionCol("").transform(out)
            own = vector_to_array(f"_votes{i}")
            votes = own if votes is None else F.zip_with(votes, own, lambda a, b: a + b)
        out = out.withColumn("_votes", votes).drop(*[f"_votes{i}" for i in range(len(self.models))])
        share = F.transform("_votes", lambda x: x / F.lit(float(sum(m.getNumTrees for m in self.models))))
        return out.withColumn("probability", array_to_vector(share)).drop("_votes")


def _growing(train: DataFrame, depth: int, seed: int):
    """(rows, to be unpersisted, their number, index of labels, function that grows the i-th part of some trees)."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import StringIndexer

    stored = staged(train.select(F.col("label").cast("string").alias("label"), "vector"), "train")
    n = stored.count()
    # in one order, as the trees' samples go by it
    data = _vectors(stored.repartition(max(1, -(-n // FOREST_TASK_ROWS))).sortWithinPartitions("label", "vector")).persist()
    index = StringIndexer(inputCol="label", outputCol="label_no", stringOrderType="alphabetAsc", handleInvalid="keep").fit(data)
    rows = index.transform(data)

    def grown(i: int, trees: int):
        return RandomForestClassifier(numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", seed=seed + i, labelCol="label_no", predictionCol="said_no").fit(rows)

    return data, n, index, grown


def _side_by_side(spark, work, sizes: list[int], most: int) -> list:
    """work(i, sizes[i]) of each part, `most` of them at a time."""
    from multiprocessing.pool import ThreadPool

    from pyspark import inheritable_thread_target

    with ThreadPool(max(1, min(len(sizes), most, spark.sparkContext.defaultParallelism))) as pool:
        return pool.map(inheritable_thread_target(spark)(lambda i: work(i, sizes[i])), range(len(sizes)), chunksize=1)


def forest_in_parts(train: DataFrame, trees: int, depth: int, seed: int, part: int = FOREST_PART) -> Fitted:
    """A forest whose trees are grown `part` at a time, parts side by side. Growing needs a table of counts for each open
    node on each partition, so many trees over many partitions move more counts than rows. The driver holds all
    trees; `forest_votes` does not. train: label, vector."""
    data, _, index, grown = _growing(train, depth, seed)
    models = _side_by_side(train.sparkSession, grown, [min(part, trees - begin) for begin in range(0, trees, part)], trees)
    data.unpersist()
    return Fitted(index, Parts(models))


def forest_plan(rows: int, trees: int, cores: int, part: int = FOREST_PART, most: int = FOREST_ROWS) -> tuple[list[int], int]:
    """(trees of each part, parts at a time): as many trees at a time as `most` allows, one at least, in parts enough
    for all cores, a task for FOREST_TASK_ROWS."""
    at_once = max(1, most // max(1, rows))
    beside = max(1, cores // max(1, -(-rows // FOREST_TASK_ROWS)))
    size = min(part, max(1, at_once // beside))
    return [min(size, trees - begin) for begin in range(0, trees, size)], max(1, at_once // size)


def forest_votes(train: DataFrame, test: DataFrame, trees: int, depth: int, seed: int, most: int = FOREST_ROWS) -> tuple[DataFrame, list[str]]:
    """(test with `votes`, the sum of its trees' votes for each label, labels in order of name) by a forest that never
    stands whole anywhere: the votes of each part are stored and its trees dropped before others are grown, so
    the driver holds max(1, most / rows) trees at a time. train: label, vector; test: vector and any others."""
    from pyspark.ml.functions import vector_to_array

    spark = train.sparkSession
    data, n, index, grown = _growing(train, depth, seed)
    sizes, at_once = forest_plan(n, trees, spark.sparkContext.defaultParallelism, most=most)
    asked = staged(test.withColumn("_row", F.monotonically_increasing_id()), "test")
    features, folder, known = _vectors(asked.select("_row", "vector")).drop("vector"), new_folder(spark, "votes"), len(index.labels)

    def vote(i: int, size: int) -> None:
        model = grown(i, size).setRawPredictionCol("_votes").setProbabilityCol("").setPredictionCol("")
        model.transform(features).select("_row", F.slice(vector_to_array("_votes"), 1, known).alias("votes")).write.parquet(f"{folder}/part={i}")

    _side_by_side(spark, vote, sizes, at_once)
    data.unpersist()
    parts = spark.read.schema("_row long, votes array<double>, part int").parquet(folder)
    ordered = F.array_sort(F.collect_list(F.struct("part", "votes")))  # sums of one order
    none = F.array_repeat(F.lit(0.0), known)
    summed = parts.groupBy("_row").agg(F.aggregate(ordered, none, lambda a, x: F.zip_with(a, x["votes"], lambda u, v: u + v)).alias("votes"))
    return asked.join(summed, "_row").drop("_row"), list(index.labels)


def random_forest(train: DataFrame, test: DataFrame, trees: int = 300, depth: int = 20, seed: int = 0) -> DataFrame:
    """(id, label, predicted) of test; both: id, label, vector."""
    said, labels = forest_votes(train, test, trees, depth, seed)
    # the earliest of the largest; labels are sorted by name
    best = F.array_position("votes", F.array_max("votes")).cast("int") - 1
    return said.select("id", F.col("label").cast("string").alias("label"), F.get(F.array(*[F.lit(x) for x in labels]), best).alias("predicted"))


def logistic(train: DataFrame, test: DataFrame, rounds: int = 2000) -> DataFrame:
    """(id, label, predicted) of test by multinomial logistic regression with unit ridge; scale the vectors first."""
    from pyspark.ml.classification import LogisticRegression

    return _classified(train, test, LogisticRegression(maxIter=rounds, regParam=1.0 / max(1, train.count()), standardization=False, family="multinomial"))


def importances(train: DataFrame, names: list[str], trees: int = 300, depth: int = 20, seed: int = 0) -> DataFrame:
    """(feature, importance) of a random forest, largest first."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import StringIndexer

    data = _vectors(train).withColumn("label", F.col("label").cast("string"))
    data = StringIndexer(inputCol="label", outputCol="label_no").fit(data).transform(data)
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", seed=seed, labelCol="label_no").fit(data)
    rows = [(n, float(x)) for n, x in zip(names, model.featureImportances.toArray())]
    return train.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def principal(df: DataFrame, k: int = 2) -> DataFrame:
    """(id, components, explained): centred vectors on the first k principal axes. An axis' sign is arbitrary."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    mean = df.select(F.posexplode("vector").alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("m")).agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("_m"))
    data = df.join(F.broadcast(mean), F.lit(True)).select("id", array_to_vector(F.zip_with("vector", "_m", lambda x, m: x - m["m"])).alias("features"))
    model = PCA(k=k, inputCol="features", outputCol="pc").fit(data)
    return model.transform(data).select("id", vector_to_array("pc").alias("components"), F.array(*[F.lit(float(x)) for x in model.explainedVariance.toArray()]).alias("explained"))


def ward_merges(df: DataFrame, most: int = 2000) -> DataFrame:
    """(step, a, b, height, size) of Ward's linkage, as for a dendrogram of at most `most` rows; merged
    clusters are numbered on from the row count. It is a picture's data, so its size is checked."""
    n = df.count()
    if n > most:
        raise ValueError(f"a dendrogram of {n} rows cannot be read; aggregate them first")

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        x = np.array(rows["vector"].tolist(), float).reshape(len(rows), -1)
        centre, size, live = {i: v for i, v in enumerate(x)}, dict.fromkeys(range(len(x)), 1), list(range(len(x)))
        out = []
        for step in range(len(x) - 1):
            c, s = np.stack([centre[i] for i in live]), np.array([size[i] for i in live], float)
            d = ((c[:, None] - c[None]) ** 2).sum(2) * (2 * s[:, None] * s[None] / (s[:, None] + s[None]))
            d[np.tril_indices(len(live))] = np.inf
            i, j = np.unravel_index(np.argmin(d), d.shape)
            a, b, new = live[i], live[j], len(x) + step
            size[new] = size[a] + size[b]
            centre[new] = (centre[a] * size[a] + centre[b] * size[b]) / size[new]
            out.append((step, a, b, float(np.sqrt(d[i, j])), size[new]))
            live = [k for k in live if k not in (a, b)] + [new]
        return pd.DataFrame(out, columns=["step", "a", "b", "height", "size"])

    return df.select("id", "vector", F.lit(0).alias("picture")).groupBy("picture").applyInPandas(merge, "step int, a int, b int, height double, size int")


def label_means(df: DataFrame) -> DataFrame:
    """(label, pos, x): the mean of each component by label. df: label, vector."""
    return df.select("label", F.posexplode("vector").alias("pos", "v")).groupBy("label", "pos").agg(F.avg("v").alias("x"))


def leave_one_out(means: DataFrame, k: float = 2.0) -> DataFrame:
    """(held, nearest, threshold, novel): whether each device is novel to the others.

    Without `held`, the others are scaled by their own means and deviations; the threshold is the
    median of their nearest distances plus k deviations. means: label, pos, x. Devices are a site's:
    the work is their number cubed times the components.
    """
    held = means.select(F.col("label").alias("held")).distinct()
    pair = held.join(means, F.col("held") != F.col("label"))
    fit = pair.groupBy("held", "pos").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).withColumn("s", F.when(F.col("s") == 0, 1.0).otherwise(F.col("s")))
    z = pair.join(fit, ["held", "pos"]).select("held", "label", "pos", ((F.col("x") - F.col("m")) / F.col("s")).alias("z"))
    own = means.withColumnRenamed("label", "held").join(fit, ["held", "pos"]).select("held", "pos", ((F.col("x") - F.col("m")) / F.col("s")).alias("zo"))
    square = lambda a, b: F.sqrt(F.sum((F.col(a) - F.col(b)) * (F.col(a) - F.col(b))))
    to_own = z.join(own, ["held", "pos"]).groupBy("held", "label").agg(square("z", "zo").alias("d")).groupBy("held").agg(F.min("d").alias("nearest"))
    other = z.select("held", "pos", F.col("label").alias("label2"), F.col("z").alias("z2"))
    inner = z.join(other, ["held", "pos"]).where("label <> label2").groupBy("held", "label", "label2").agg(square("z", "z2").alias("d"))
    bar = inner.groupBy("held", "label").agg(F.min("d").alias("d")).groupBy("held").agg((F.median("d") + k * F.stddev_pop("d")).alias("threshold"))
    return to_own.join(bar, "held").withColumn("novel", F.col("nearest") > F.col("threshold"))


def novel_rows(rows: DataFrame, means: DataFrame, k: float = 2.0, most: int = 10_000) -> DataFrame:
    """rows (id, vector) with nearest, threshold and novel, against devices known by their means."""
    fit = means.groupBy("pos").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).withColumn("s", F.when(F.col("s") == 0, 1.0).otherwise(F.col("s")))
    z = means.join(fit, "pos").select("label", "pos", ((F.col("x") - F.col("m")) / F.col("s")).alias("z"))
    a, b = z.select("label", "pos", "z"), z.select(F.col("label").alias("label2"), "pos", F.col("z").alias("z2"))
    near = a.join(b, "pos").where("label <> label2").groupBy("label", "label2").agg(F.sqrt(F.sum((F.col("z") - F.col("z2")) ** 2)).alias("d")).groupBy("label").agg(F.min("d").alias("d"))
    known = z.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "z"))).alias("zs")).agg(F.collect_list("zs").alias("known"))
    scale = fit.agg(F.array_sort(F.collect_list(F.struct("pos", "m", "s"))).alias("fit"))
    bar = near.agg((F.median("d") + k * F.stddev_pop("d")).alias("threshold"))
    if means.select("label").distinct().count() > most:
        raise ValueError(f"more than {most} known labels are too many to travel with every row")
    one = known.join(scale).join(bar)
    placed = rows.join(F.broadcast(one), F.lit(True)).withColumn("zv", F.zip_with("vector", "fit", lambda x, f: (x - f["m"]) / f["s"]))
    far = F.transform("known", lambda zs: F.sqrt(F.aggregate(F.zip_with("zv", zs, lambda x, y: (x - y["z"]) * (x - y["z"])), F.lit(0.0), lambda s, x: s + x)))
    return placed.withColumn("nearest", F.array_min(far)).withColumn("novel", F.col("nearest") > F.col("threshold")).drop("known", "fit", "zv")


