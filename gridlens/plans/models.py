"""Queries of scaling, neighbours, clusters, classifiers and scores, over the embeddings and labels tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation, learning
from .signal import rounded


def rows_of(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("label").alias("label"), F.col("embedding").cast("array<double>").alias("vector"))


def zscore(spark, sf_dir):
    out = learning.scaled(rows_of(spark, sf_dir)).select("id", F.posexplode("vector").alias("pos", "z"))
    return rounded(out, "z")


def knn5(spark, sf_dir):
    """A search: every row whose id is divisible by 20 asks all rows."""
    rows = learning.scaled(rows_of(spark, sf_dir))
    queries = rows.where("id % 20 = 0")
    return learning.knn_classify(queries, rows).join(queries.select("id", "label"), "id").withColumn("correct", F.col("label") == F.col("predicted"))


def silhouette_exact(spark, sf_dir):
    return rounded(learning.silhouettes(rows_of(spark, sf_dir)), "silhouette")


def _judged(spark, sf_dir):
    """Labels as predictions: documents marked toxic against documents of low quality."""
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"), (1 - F.col("toxic")).alias("predicted"))


def confusion(spark, sf_dir):
    return evaluation.confusion(_judged(spark, sf_dir), "label", "predicted")


def accuracy(spark, sf_dir):
    return rounded(evaluation.accuracy(_judged(spark, sf_dir), "label", "predicted"), "accuracy")


def _clustered(spark, sf_dir):
    """A clustering by rule: the position of the largest of the first twelve components."""
    best = F.array_max(F.transform(F.slice("vector", 1, 12), lambda x, i: F.struct(x.alias("x"), (-i).alias("i"))))
    return rows_of(spark, sf_dir).withColumn("cluster", -best["i"])


def purity(spark, sf_dir):
    return rounded(evaluation.purity(_clustered(spark, sf_dir), "label", "cluster"), "purity")


def ari(spark, sf_dir):
    return rounded(evaluation.adjusted_rand(_clustered(spark, sf_dir), "label", "cluster"), "ari")


def cluster_majority(spark, sf_dir):
    """Every tenth vector plays a real row, the others are the synthetic ones whose clusters it is placed in."""
    c = _clustered(spark, sf_dir).withColumn("label", F.col("label").cast("string"))
    out = evaluation.placements(c.where("id % 10 = 0"), c.where("id % 10 <> 0"), "cluster", "label")
    return out.select("id", "cluster", "label", "majority", "match")


def novelty_loo(spark, sf_dir):
    return rounded(learning.leave_one_out(learning.label_means(rows_of(spark, sf_dir))), "nearest", "threshold")


def novelty_rows(spark, sf_dir):
    rows = rows_of(spark, sf_dir)
    return rounded(learning.novel_rows(rows.drop("label"), learning.label_means(rows)).select("id", "nearest", "threshold", "novel"), "nearest", "threshold")


def kmeans_purity(spark, sf_dir):
    c = learning.kmeans(rows_of(spark, sf_dir), k=10)
    return evaluation.purity(c, "label", "cluster").join(evaluation.adjusted_rand(c, "label", "cluster"))


def _split(spark, sf_dir):
    rows = learning.scaled(rows_of(spark, sf_dir))
    return rows.where("id % 5 <> 0"), rows.where("id % 5 = 0")


def rf_accuracy(spark, sf_dir):
    return evaluation.accuracy(learning.random_forest(*_split(spark, sf_dir)), "label", "predicted")


def rf_shares(spark, sf_dir):
    """Each test row's likeliest label, its probability and the sum of all labels' probabilities, which is 1."""
    from pyspark.ml.classification import RandomForestClassifier

    train, test = _split(spark, sf_dir)
    said = learning.fitted(train, RandomForestClassifier(numTrees=100, maxDepth=12, featureSubsetStrategy="sqrt", seed=0)).predict(test, with_shares=True)
    whole = F.round(F.aggregate("shares", F.lit(0.0), lambda a, x: a + x), 6)
    return rounded(said.select("id", F.col("label").cast("string").alias("label"), "predicted", "confidence", whole.alias("whole")), "confidence")


def lr_accuracy(spark, sf_dir):
    return evaluation.accuracy(learning.logistic(*_split(spark, sf_dir)), "label", "predicted")


def pca2(spark, sf_dir):
    return learning.principal(rows_of(spark, sf_dir))


QUERIES = {
    "zscore": zscore, "knn5": knn5, "silhouette_exact": silhouette_exact, "confusion": confusion, "accuracy": accuracy, "purity": purity, "ari": ari, "cluster_majority": cluster_majority,
    "novelty_loo": novelty_loo, "novelty_rows": novelty_rows, "kmeans_purity": kmeans_purity, "rf_accuracy": rf_accuracy, "rf_shares": rf_shares, "lr_accuracy": lr_accuracy, "pca2": pca2,
}

_ROWS = "e AS (SELECT vec_id AS id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)"
_SCALED = f"{_ROWS}, f AS (SELECT pos, avg(x) AS m, stddev_pop(x) AS s FROM e GROUP BY pos), z AS (SELECT id, label, e.pos, (x - m) / CASE WHEN s = 0 THEN 1 ELSE s END AS z FROM e JOIN f USING (pos)), v AS (SELECT id, label, list(z ORDER BY pos) AS v FROM z GROUP BY ALL)"
_CLUSTERED = "c AS (SELECT vec_id AS id, label, CAST(list_position(embedding[1:12], list_max(embedding[1:12])) - 1 AS INTEGER) AS cluster FROM embeddings)"
_MEANS = f"{_ROWS}, mn AS (SELECT label, pos, avg(x) AS x FROM e GROUP BY ALL)"
_LABELS = "j AS (SELECT quality AS label, 1 - toxic AS predicted FROM labels)"
ORACLE_SQL = {
    "zscore": f"WITH {_SCALED} SELECT id, CAST(pos AS INTEGER) AS pos, round(z, 6) + 0.0 AS z FROM z",
    "knn5": f"""WITH {_SCALED}, n AS (SELECT a.id, a.label AS own, b.label FROM v a JOIN v b ON a.id % 20 = 0 AND a.id <> b.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) <= 5),
w0 AS (SELECT id, own, label AS predicted, count(*) AS votes FROM n GROUP BY ALL), w AS (SELECT * FROM w0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY votes DESC, predicted) = 1)
SELECT id, predicted, own AS label, own = predicted AS correct FROM w""",
    "silhouette_exact": """WITH v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
d AS (SELECT a.id, a.label AS own, b.label AS other, sum(list_distance(a.v, b.v)) AS t, count(*) AS n FROM v a, v b GROUP BY ALL),
m AS (SELECT id, max(CASE WHEN own = other THEN t / nullif(n - 1, 0) END) AS a, min(CASE WHEN own <> other THEN t / n END) AS b FROM d GROUP BY id)
SELECT id, round(coalesce((b - a) / greatest(a, b), 0), 6) + 0.0 AS silhouette FROM m""",
    "confusion": f"WITH {_LABELS} SELECT label, predicted, count(*) AS n FROM j GROUP BY ALL",
    "accuracy": f"WITH {_LABELS} SELECT count(*) FILTER (label IS NOT DISTINCT FROM predicted) AS correct, count(*) AS n, round(count(*) FILTER (label IS NOT DISTINCT FROM predicted) / count(*), 6) + 0.0 AS accuracy FROM j",
    "purity": f"WITH {_CLUSTERED}, k AS (SELECT cluster, label, count(*) AS n FROM c GROUP BY ALL), b AS (SELECT max(n) AS m, sum(n) AS n FROM k GROUP BY cluster) SELECT round(sum(m) / sum(n), 6) + 0.0 AS purity FROM b",
    "ari": f"""WITH {_CLUSTERED}, k AS (SELECT cluster, label, count(*) AS n FROM c GROUP BY ALL), s AS (SELECT sum(n * (n - 1) / 2) AS both_, sum(n) AS n FROM k),
a AS (SELECT sum(n * (n - 1) / 2) AS t FROM (SELECT sum(n) AS n FROM k GROUP BY label)), b AS (SELECT sum(n * (n - 1) / 2) AS t FROM (SELECT sum(n) AS n FROM k GROUP BY cluster))
SELECT round((both_ - a.t * b.t / (s.n * (s.n - 1) / 2)) / ((a.t + b.t) / 2 - a.t * b.t / (s.n * (s.n - 1) / 2)), 6) + 0.0 AS ari FROM s, a, b""",
    "cluster_majority": f"""WITH {_CLUSTERED}, k0 AS (SELECT cluster, CAST(label AS VARCHAR) AS majority, count(*) AS n FROM c WHERE id % 10 <> 0 GROUP BY ALL), k AS (SELECT * FROM k0 QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, majority) = 1)
SELECT id, c.cluster, CAST(label AS VARCHAR) AS label, coalesce(majority, '(none)') AS majority, coalesce(majority, '(none)') = CAST(label AS VARCHAR) AS match FROM c LEFT JOIN k USING (cluster) WHERE id % 10 = 0""",
    "novelty_loo": f"""WITH {_MEANS}, h AS (SELECT DISTINCT label AS held FROM mn), pa AS (SELECT held, label, pos, x FROM h JOIN mn ON held <> label),
ft AS (SELECT held, pos, avg(x) AS m, CASE WHEN stddev_pop(x) = 0 THEN 1 ELSE stddev_pop(x) END AS s FROM pa GROUP BY ALL),
z AS (SELECT held, label, pos, (x - m) / s AS z FROM pa JOIN ft USING (held, pos)), o AS (SELECT ft.held, ft.pos, (x - m) / s AS zo FROM mn JOIN ft ON ft.held = mn.label AND ft.pos = mn.pos),
d1 AS (SELECT held, label, sqrt(sum((z - zo) * (z - zo))) AS d FROM z JOIN o USING (held, pos) GROUP BY ALL), n AS (SELECT held, min(d) AS nearest FROM d1 GROUP BY held),
d2 AS (SELECT a.held, a.label, b.label AS l2, sqrt(sum((a.z - b.z) * (a.z - b.z))) AS d FROM z a JOIN z b ON a.held = b.held AND a.pos = b.pos AND a.label <> b.label GROUP BY ALL),
t AS (SELECT held, median(d) + 2 * stddev_pop(d) AS threshold FROM (SELECT held, label, min(d) AS d FROM d2 GROUP BY ALL) GROUP BY held)
SELECT held, round(nearest, 6) + 0.0 AS nearest, round(threshold, 6) + 0.0 AS threshold, nearest > threshold AS novel FROM n JOIN t USING (held)""",
    "novelty_rows": f"""WITH {_MEANS}, ft AS (SELECT pos, avg(x) AS m, CASE WHEN stddev_pop(x) = 0 THEN 1 ELSE stddev_pop(x) END AS s FROM mn GROUP BY pos), z AS (SELECT label, pos, (x - m) / s AS z FROM mn JOIN ft USING (pos)),
d2 AS (SELECT a.label, b.label AS l2, sqrt(sum((a.z - b.z) * (a.z - b.z))) AS d FROM z a JOIN z b ON a.pos = b.pos AND a.label <> b.label GROUP BY ALL), t AS (SELECT median(d) + 2 * stddev_pop(d) AS threshold FROM (SELECT label, min(d) AS d FROM d2 GROUP BY label)),
q AS (SELECT id, e.pos, (x - m) / s AS zo FROM e JOIN ft USING (pos)), n AS (SELECT id, min(d) AS nearest FROM (SELECT id, label, sqrt(sum((z - zo) * (z - zo))) AS d FROM q JOIN z USING (pos) GROUP BY ALL) GROUP BY id)
SELECT id, round(nearest, 6) + 0.0 AS nearest, round(threshold, 6) + 0.0 AS threshold, nearest > threshold AS novel FROM n, t""",
}
