"""Exact medians of groups of any size.

The median of a short group is an aggregate with a buffer. That of a long one is found by histograms: its values' range
is cut into buckets, the counts tell which bucket holds the middle, and only that bucket's range is cut again, until it
is a single value. Each round counts with partial sums; no task holds a group's values.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import staged

#: Rows up to which a group's median is a plain aggregate, and the buckets of a round.
LONG_ROWS, BUCKETS = 1_000_000, 1024
#: Groups that may be broadcast.
FEW = 100_000


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= FEW else df


def _refined(values: DataFrame, by: str) -> DataFrame:
    """(by, median) of values (by, x), x not null."""
    ends = values.groupBy(by).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    middle = F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2))
    targets = staged(ends.select(by, "low", "high", F.posexplode(middle).alias("side", "rank")), "medians")
    # rounds by size alternate with rounds by magnitude, so values of very different sizes settle soon too
    scales = [lambda c: F.col(c) / 2, lambda c: F.when(F.col(c) == 0, 0.0).otherwise(F.signum(c) * (F.ln(F.abs(c)) + 750))]
    for turn in itertools.count():
        unsettled = targets.where("low < high")
        if unsettled.isEmpty():
            break
        at = scales[turn % 2]
        inside = values.join(_few(unsettled), by).where(F.col("x").between(F.col("low"), F.col("high")))
        share = F.try_divide(at("x") - at("low"), at("high") - at("low"))
        bucket = F.coalesce(F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1)), F.when(F.col("x") > F.col("low"), BUCKETS - 1).otherwise(0)).cast("int")
        counts = inside.groupBy(by, "side", "rank", bucket.alias("bucket")).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
        upto = F.sum("n").over(Window.partitionBy(by, "side").orderBy("bucket"))  # BUCKETS rows at most
        found = counts.withColumn("upto", upto).where("upto > rank AND upto - n <= rank")
        found = found.select(by, "low", "high", "side", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"))
        targets = staged(found.unionByName(targets.where("low >= high")), "medians")
    return targets.groupBy(by).agg((F.min("low") / 2 + F.max("low") / 2).alias("median"))


def medians(df: DataFrame, columns: dict[str, str], by: str = "series_id", more: tuple[Column, ...] = (), long_rows: int = LONG_ROWS) -> DataFrame:
    """(by, a column for each name of `columns`, `more`): exact medians of df's columns by group, null where all are
    null, and further aggregates. Counts the groups first; of a df that is dear to make, give a staged one."""
    plain = [F.median(c).alias(name) for name, c in columns.items()]
    long_ = df.groupBy(by).agg(F.count("*").alias("_n")).where(F.col("_n") > long_rows).select(by)
    if long_.isEmpty():
        return df.groupBy(by).agg(*plain, *more)
    long_ = _few(staged(long_, "long"))
    out = df.join(long_, by, "left_anti").groupBy(by).agg(*plain, *more)
    found = long_
    for name, c in columns.items():
        values = df.join(long_, by, "left_semi").select(by, F.col(c).cast("double").alias("x")).where("x IS NOT NULL")
        found = found.join(_refined(values, by).withColumnRenamed("median", name), by, "left")
    if more:
        found = found.join(df.join(long_, by, "left_semi").groupBy(by).agg(*more), by)
    return out.unionByName(found)
