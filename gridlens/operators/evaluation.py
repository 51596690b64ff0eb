"""Scores of detections, running sets, clusters and predictions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import CHUNK_SECONDS, carried, dealt, in_chunk

MATCH_SCHEMA = "series_id string, detected_no int, truth_no int, dt double"


def match_to_truth(detected: DataFrame, truth: DataFrame, tol_s: float = 2.0, chunk_s: float = CHUNK_SECONDS) -> DataFrame:
    """One-to-one matches: each detected step, in its order, takes the unused true event of its sign
    that is nearest in time and within tol_s; of equally near ones the first.

    The exclusion is sequential, but events farther apart than tol_s are no rivals: a signal is cut where nothing
    happens for longer than that, and its parts are matched apart, those that begin in one chunk of time together.
    Events without a time match nothing.

    detected, truth: series_id, no, t_sec, delta_p.
    """

    def pairs(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        d, t = rows[rows["_found"]], rows[~rows["_found"]].sort_values("no").reset_index(drop=True)
        sign = (t["delta_p"] > 0).astype(int) - (t["delta_p"] < 0).astype(int)
        free = pd.Series(True, t.index)
        out = []
        for no, at, dp in d.sort_values("no")[["no", "t_sec", "delta_p"]].itertuples(index=False):
            far = (t["t_sec"] - at).abs()[free & (sign == (dp > 0) - (dp < 0))]
            if len(far) and far.min() <= tol_s:
                hit = far.idxmin()
                free[hit] = False
                out.append((key[0], no, t["no"][hit], far[hit]))
        return pd.DataFrame(out, columns=["series_id", "detected_no", "truth_no", "dt"])

    cols = ["series_id", "no", "t_sec", "delta_p"]
    both = detected.select(*cols, F.lit(True).alias("_found")).unionByName(truth.select(*cols, F.lit(False).alias("_found"))).where("t_sec IS NOT NULL")
    nearer = lambda a, b: F.coalesce(a, b)
    ahead = {"_before": (F.max("t_sec").over(in_chunk("t_sec", last=-1)), F.max("t_sec"), lambda c, by: F.max(c).over(by), nearer)}
    both = carried(both, ahead, chunk_s=chunk_s)
    both = both.withColumn("_start", F.when(F.col("_before").isNull() | (F.col("t_sec") - F.col("_before") > tol_s), F.col("t_sec")))
    parts = {"_part": (F.max("_start").over(in_chunk("t_sec")), F.max("_start"), lambda c, by: F.max(c).over(by), nearer)}
    both = carried(both, parts, chunk_s=chunk_s).withColumn("_part", F.floor(F.col("_part") / chunk_s))
    return dealt(both.select(*cols, "_found", "_part"), "series_id", "_part").groupBy("series_id", "_part").applyInPandas(pairs, MATCH_SCHEMA)


def precision_recall(matches: DataFrame, detected: DataFrame, truth: DataFrame) -> DataFrame:
    n = lambda df, name: df.agg(F.count("*").alias(name))
    one = n(matches, "matched").join(n(detected, "detected")).join(n(truth, "truth"))
    share = lambda c: F.coalesce(F.try_divide("matched", c), F.lit(0.0))
    return one.withColumns({"precision": share("detected"), "recall": share("truth")})


def scores_by(matches: DataFrame, detected: DataFrame, truth: DataFrame, groups: DataFrame, by: str) -> DataFrame:
    """precision_recall of each group of signals, `by` being a column of groups (series_id, by)."""
    n = lambda df, name: df.join(groups, "series_id").groupBy(by).agg(F.count("*").alias(name))
    each = groups.select(by).distinct()
    for df, name in ((matches, "matched"), (detected, "detected"), (truth, "truth")):
        each = each.join(n(df, name), by, "left")
    each = each.na.fill(0, ["matched", "detected", "truth"])
    share = lambda c: F.coalesce(F.try_divide("matched", c), F.lit(0.0))
    return each.withColumns({"precision": share("detected"), "recall": share("truth")})


def _asof(left: DataFrame, right: DataFrame, value: str, forward: bool, chunk_s: float = CHUNK_SECONDS) -> DataFrame:
    """left (series_id, t, ...) with the value of right (series_id, t, value) at the last t before or at
    each t, or the first at or after it. A sort of the union by chunks of time and a value carried over from
    chunk to chunk; no row pairs."""
    both = left.withColumn("_left", F.lit(True)).unionByName(right.select("series_id", "t", F.col(value).alias("_value"), F.lit(False).alias("_left")), allowMissingColumns=True)
    inside = F.last("_value", ignorenulls=True).over(in_chunk(F.col("t").desc() if forward else F.col("t").asc(), F.col("_left").asc()))
    own = (F.min_by if forward else F.max_by)("_value", F.when(F.col("_value").isNotNull(), F.col("t")))
    made = {value: (inside, own, lambda c, by: F.last(c, ignorenulls=True).over(by), lambda a, b: F.coalesce(a, b))}
    return carried(both, made, "t", forward, chunk_s).where("_left").drop("_left", "_value")


def active_at(checks: DataFrame, active: DataFrame) -> DataFrame:
    """checks (series_id, t) with the true `active` set: the first row at or after t, past the end the last row."""
    got = _asof(checks, active, "active", forward=True)
    last = active.groupBy("series_id").agg(F.max_by("active", "t").alias("_last"))
    return got.join(last, "series_id", "left").withColumn("active", F.coalesce("active", "_last")).drop("_last")


def predicted_at(checks: DataFrame, timeline: DataFrame, delay_s: float = 0.5) -> DataFrame:
    """checks (series_id, t) with `predicted`: the set of the last step until t + delay_s, else none.
    Of steps at one time the later one counts."""
    last = timeline.groupBy("series_id", F.col("t_sec").alias("t")).agg(F.max_by("active", "step_no").alias("predicted"))
    got = _asof(checks.withColumn("t", F.col("t") + delay_s), last, "predicted", forward=False)
    return got.withColumns({"t": F.col("t") - delay_s, "predicted": F.coalesce("predicted", F.array().cast("array<string>"))})


def jaccard(a: str, b: str) -> Column:
    """Overlap of two sets; two empty ones agree."""
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(either, F.lit(1)))


def set_scores(df: DataFrame, truth: str = "active", predicted: str = "predicted") -> DataFrame:
    """Mean overlap and rate of equal sets over all checks."""
    return df.agg(F.avg(jaccard(truth, predicted)).alias("jaccard"), F.avg((F.array_sort(F.array_distinct(truth)) == F.array_sort(F.array_distinct(predicted))).cast("double")).alias("exact_set_rate"), F.count("*").alias("n_checks"))


def purity(df: DataFrame, label: str, cluster: str) -> DataFrame:
    best = df.groupBy(cluster, label).count().groupBy(cluster).agg(F.max("count").alias("m"), F.sum("count").alias("n"))
    return best.agg((F.sum("m") / F.sum("n")).alias("purity"))


def adjusted_rand(df: DataFrame, label: str, cluster: str) -> DataFrame:
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    cells = df.groupBy(label, cluster).agg(F.count("*").alias("n"))
    a = cells.agg(pairs("n").alias("both"), F.sum("n").alias("all"))
    b = cells.groupBy(label).agg(F.sum("n").alias("n")).agg(pairs("n").alias("by_label"))
    c = cells.groupBy(cluster).agg(F.sum("n").alias("n")).agg(pairs("n").alias("by_cluster"))
    expected = F.col("by_label") * F.col("by_cluster") / (F.col("all") * (F.col("all") - 1) / 2)
    most = (F.col("by_label") + F.col("by_cluster")) / 2
    return a.join(b).join(c).select(F.when(most == expected, 1.0).otherwise(F.try_divide(F.col("both") - expected, most - expected)).alias("ari"))


def confusion(df: DataFrame, label: str, predicted: str, labels: list | None = None) -> DataFrame:
    """Counts of (label, predicted); with `labels` as one column each, in that order."""
    if labels is None:
        return df.groupBy(label, predicted).agg(F.count("*").alias("n"))
    return df.groupBy(label).pivot(predicted, labels).count().na.fill(0)


def accuracy(df: DataFrame, label: str, predicted: str) -> DataFrame:
    return df.agg(F.count_if(F.col(label).eqNullSafe(F.col(predicted))).alias("correct"), F.count("*").alias("n")).withColumn("accuracy", F.try_divide("correct", "n"))


def majorities(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """(cluster, majority): the most frequent label of each cluster, of equal ones the smallest."""
    return df.groupBy(cluster).agg(F.mode(label, True).alias("majority"))


def placements(real: DataFrame, synthetic: DataFrame, cluster: str, label: str) -> DataFrame:
    """real with the majority label of its cluster among synthetic rows, '(none)' where it has none, and match."""
    out = real.join(majorities(synthetic, cluster, label), cluster, "left")
    return out.withColumn("majority", F.coalesce("majority", F.lit("(none)"))).withColumn("match", F.col("majority") == F.col(label))
