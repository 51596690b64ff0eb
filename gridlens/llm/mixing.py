"""Mixing sources to target weights by hash-threshold histograms.

Each document gets a 52-bit hash of its id. Per source, words are summed by hash bucket; a running
sum over the buckets finds the bucket in which the budget ends, and only that bucket's documents are
summed again by finer buckets, until a bucket is a single hash value. A document is in when its hash
is under its source's threshold: no sort of documents, and a smaller budget's choice is contained in
a larger one's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, small, stage

#: Source weights, repeating over the sources in code-point order with null last.
WEIGHTS = (5, 2, 1)
#: The mix's size over that of all sources, and the most copies of a source.
SHARE, MOST = 1.5, 2
#: Bits of the hash that each level of histograms resolves.
LEVELS = (12, 12, 12, 16)
BITS = sum(LEVELS)


def word_count(text: str) -> F.Column:
    """Number of words of a text column; null has none."""
    spaced = F.translate(F.coalesce(F.col(text), F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.filter(F.split(spaced, " +"), lambda w: w != "")).cast("long")


def hashed(key: str) -> F.Column:
    """The leading 52 bits of the md5 of an id; null counts as the empty string."""
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size) with target: min(most * size, level * weight), where the level makes
    the targets sum to share * all sizes. Resharing the excess by weight ends at this level; it is
    found by running sums over the sources in the order in which they fill up. One row per source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    pattern = F.array(*[F.lit(w) for w in weights])
    w = sizes.withColumn("weight", F.element_at(pattern, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"))
    w = w.withColumn("cap", F.col("source_size") * most)
    full = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    w = w.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
    w = w.withColumn("rest", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    w = w.withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    w = w.withColumn("level", F.col("rest") / F.col("open").cast("double"))
    # the first source that does not fill up sets the level for all after it
    w = w.withColumn("short", F.when(F.col("level") * F.col("weight") < F.col("cap"), F.col("level")))
    w = w.withColumn("level", F.first("short", ignorenulls=True).over(full.rowsBetween(Window.unboundedPreceding, 0)))
    target = F.when(F.col("level").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")))
    return w.select("source", "source_size", target.alias("target"))


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, edge, edge_in): documents with hash < edge are in, those at edge if edge_in.

    rows: source, size, h. budgets: source, budget. The words taken are as near the budget as a cut
    between hash values allows; a tie leaves the edge out.
    """
    prefix = budgets.select("source", F.lit(0).cast("long").alias("prefix"), F.col("budget").alias("left"))
    done = 0
    level = None
    for bits in LEVELS:
        done += bits
        shift = BITS - done
        near = rows.alias("r").join(prefix.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")) & (F.shiftright("r.h", shift + bits) == F.col("p.prefix")))
        sums = near.groupBy(F.col("r.source").alias("source"), F.shiftright("r.h", shift).alias("bucket")).agg(F.sum("r.size").alias("words"), F.first("p.left").alias("left"))
        order = Window.partitionBy("source").orderBy("bucket")
        sums = sums.withColumn("upto", F.sum("words").over(order))
        # the first bucket that reaches the budget
        level = sums.where("upto >= left AND upto - words < left").select("source", "bucket", (F.col("left") - F.col("upto") + F.col("words")).alias("left"), "words")
        level = stage(level, "boundary")
        prefix = level.select("source", F.col("bucket").alias("prefix"), "left")
    return level.select("source", F.col("bucket").alias("edge"), (F.col("words") - F.col("left") < F.col("left")).alias("edge_in"))


def _plan(rows: DataFrame, weights, share: float, most: int) -> DataFrame:
    """One row per source: source, source_size, target, base (whole copies), edge, edge_in. rows: source, size, h."""
    totals = stage(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "totals")
    aims = targets(totals, weights, share, most)
    aims = aims.withColumn("base", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(F.lit(0)).cast("long"))
    aims = stage(aims.withColumn("budget", F.col("target") - F.col("base") * F.col("source_size")), "targets")
    edge = thresholds(rows, aims.where("budget > 0").select("source", "budget"))
    plan = aims.alias("a").join(edge.alias("e"), F.col("a.source").eqNullSafe(F.col("e.source")), "left").select("a.*", "edge", "edge_in")
    return stage(plan, "plan")


def _sized(docs: DataFrame) -> DataFrame:
    return stage(docs.select("doc_id", "source", word_count("text").alias("size"), hashed("doc_id").alias("h")), "sizes")


def _copies(h: str, base: str = "base", edge: str = "edge", edge_in: str = "edge_in") -> F.Column:
    inside = (F.col(h) < F.col(edge)) | ((F.col(h) == F.col(edge)) & F.col(edge_in))
    return F.col(base) + F.when(inside, 1).otherwise(0)


def mix_sources(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, taken.

    A target is whole copies of the source plus a remainder that a hash threshold takes. Null text
    has no words; null source is a source of its own, last in order; null doc_ids and repeated ones
    hash alike and are in or out together. Sources without words have target 0. The number of
    sources is that of a catalogue: their totals pass through one task, documents do not.
    """
    rows = _sized(docs)
    plan = _plan(rows, weights, share, most)
    return (
        rows.alias("r")
        .join(small(plan).alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")))
        .select("doc_id", "r.source", "size", "source_size", "target", (F.col("size") * _copies("h")).alias("taken"))
    )


def mixed_documents(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The rows of docs that the mix takes, each as often as it takes them, with all their columns.

    How often is a function of the row and of its source's row of the plan, so no text moves. A text
    without words adds nothing to any source and is taken once.
    """
    plan = _plan(_sized(docs), weights, share, most)
    own = {c: name for c, name in zip(plan.columns, free_names(docs, *(f"plan_{c}" for c in plan.columns)))}
    copy, times, h, worded = free_names(docs, "copy", "times", "h", "worded")
    rows = docs.withColumns({h: hashed("doc_id"), worded: F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))})
    plan = small(plan.select(*[F.col(c).alias(name) for c, name in own.items()]))
    number = F.when(F.col(worded), _copies(h, own["base"], own["edge"], own["edge_in"])).otherwise(1).cast("int")
    joined = rows.join(plan, F.col("source").eqNullSafe(F.col(own["source"]))).withColumn(times, number).where(F.col(times) > 0)
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("source")


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, 2 * source_size AS cap,
         [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) + 1] AS weight FROM s),
f AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) * CAST(1.5 AS DOUBLE)
             - CAST(coalesce(sum(cap) OVER o, 0) AS DOUBLE) AS rest,
         CAST(sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS DOUBLE) AS open_weight
  FROM w
  WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (
  SELECT *, first_value(CASE WHEN rest / open_weight * weight < cap THEN rest / open_weight END IGNORE NULLS)
            OVER (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lvl
  FROM f),
t AS (
  SELECT source, source_size, CASE WHEN lvl IS NULL THEN CAST(cap AS DOUBLE) ELSE least(CAST(cap AS DOUBLE), lvl * weight) END AS target FROM l),
b AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(least(floor(target / source_size), 2) AS BIGINT) ELSE 0 END AS base FROM t),
g AS (SELECT source, h, sum(size) AS words FROM d GROUP BY source, h),
c AS (
  SELECT g.source, g.h, sum(words) OVER (PARTITION BY g.source ORDER BY h) AS upto, words, target - base * source_size AS budget
  FROM g JOIN b ON g.source IS NOT DISTINCT FROM b.source),
i AS (
  SELECT source, h FROM c
  WHERE budget > 0 AND (upto < budget OR (upto - words < budget AND upto - budget < budget - (upto - words))))
SELECT d.doc_id, d.size, b.source_size, b.target,
       CAST(d.size * (b.base + CASE WHEN i.h IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
LEFT JOIN i ON d.source IS NOT DISTINCT FROM i.source AND d.h = i.h
"""
