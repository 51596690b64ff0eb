"""On-regions: stretches in which smoothed power leaves the baseline."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .windows import islands, odd_width, own_rows, smooth, with_halo


@dataclass(frozen=True)
class RegionRules:
    sps: int = 5
    baseline_s: float = 3.0
    k_noise: float = 6.0
    floor_w: float = 3.0
    min_on_s: float = 3.0
    max_gap_s: float = 2.0
    smooth_s: float = 0.6

    def rows(self, seconds: float) -> int:
        return int(seconds * self.sps)


def baselines(df: DataFrame, rules: RegionRules) -> DataFrame:
    """(series_id, baseline_w, threshold) from the first rows of each series."""
    first = df.where(F.col("idx") < max(3, rules.rows(rules.baseline_s))).withColumn("p", F.coalesce("p", F.lit(0.0)))
    return first.groupBy("series_id").agg(F.median("p").alias("baseline_w"), F.greatest(rules.k_noise * F.stddev_pop("p"), F.lit(rules.floor_w)).alias("threshold"))


def detect_regions(df: DataFrame, rules: RegionRules = RegionRules()) -> DataFrame:
    """REGION_SCHEMA, off_idx being the last row above the threshold; times are not rounded.

    Null power is 0. Gaps inside a region are bridged up to max_gap_s; a series' ends are not. The
    samples move once, by series and chunk; only rows above the threshold go on.
    """
    width = odd_width(rules.smooth_s, rules.sps)
    power = df.select("series_id", "idx", "t_sec", F.coalesce("p", F.lit(0.0)).alias("p"))
    smoothed = own_rows(with_halo(power, width // 2, width // 2).withColumn("ps", smooth("p", width)))
    base = baselines(df, rules)
    above = smoothed.join(base, "series_id").where(F.abs(F.col("ps") - F.col("baseline_w")) > F.col("threshold"))
    # a run begins and ends with rows that are marked, so their times and the baseline come along
    runs = islands(above, rules.rows(rules.max_gap_s), F.min_by("t_sec", "idx").alias("on_t"), F.max_by("t_sec", "idx").alias("off_t"), F.first("baseline_w").alias("baseline_w"))
    found = runs.where(F.col("last") - F.col("first") + 1 >= rules.rows(rules.min_on_s))
    return found.select("series_id", F.col("first").alias("on_idx"), F.col("last").alias("off_idx"), "on_t", "off_t", "baseline_w", F.lit(rules.sps).alias("sps"))


def longest_regions(regions: DataFrame) -> DataFrame:
    """The main region of each series; of equal lengths the earliest."""
    by = Window.partitionBy("series_id").orderBy((F.col("off_idx") - F.col("on_idx")).desc(), "on_idx")
    return regions.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def by_rate(df: DataFrame, rates: DataFrame, run) -> DataFrame:
    """run(part, sps) for each sample rate that occurs, united; rates: series_id, sps."""
    rated = df.join(rates, "series_id")
    found = [r["sps"] for r in rates.select("sps").distinct().orderBy("sps").collect()]  # sample rates of meters: a handful
    parts = [run(rated.where(F.col("sps") == sps).drop("sps"), sps) for sps in found or [5]]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
