"""Switching steps of a signal."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import filled, odd_width, own_rows, rolling_std, smooth, window_difference, with_halo, with_length


@dataclass(frozen=True)
class StepRules:
    sps: int = 5
    win_s: float = 3.0
    floor_w: float = 5.0
    k_noise: float = 4.5
    smooth_s: float = 1.5
    q_floor: float = 8.0
    sustain: float = 0.5
    noise_s: float = 5.0

    @property
    def w(self) -> int:
        return max(1, int(self.win_s * self.sps))


def median_of(values: Column) -> Column:
    """Median of a bounded array; null for none."""
    s = F.array_sort(values)
    n = F.size(s)
    at = lambda i: F.get(s, i.cast("int"))
    return F.when(n > 0, (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2)


def once(df: DataFrame, **made: Column) -> DataFrame:
    """df with further columns, each computed once: what reads them later, a filter too, is not unfolded into
    their expressions again, which inside array functions would be for every element."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in made.items()]))))


def change_scores(df: DataFrame, rules: StepRules) -> DataFrame:
    """(series_id, idx, n, diff_p, diff_q, diff_noise, above) of every row."""
    w, width, k = rules.w, odd_width(rules.smooth_s, rules.sps), int(rules.noise_s * rules.sps)
    half = width // 2
    signal = with_length(df).select("series_id", "idx", "n", F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("q", F.lit(0.0)).alias("q"))
    reach = half + max(k, w)
    s = with_halo(signal, reach, reach).withColumns({"ps": smooth("p", width), "qs": smooth("q", width)})
    # the halo's outermost rows have cut frames; no frame of an own row reaches them
    s = s.withColumn("off", F.col("p") - F.col("ps")).withColumn("noise", rolling_std("off", k)).withColumn("noise", filled("noise"))
    s = s.withColumns({"diff_p": window_difference("ps", w, F.col("n")), "diff_q": window_difference("qs", w, F.col("n")), "diff_noise": F.col("noise") * math.sqrt(2.0 / w)})
    loud = F.abs("diff_p") >= F.greatest(F.lit(rules.floor_w), rules.k_noise * F.coalesce("diff_noise", F.lit(0.0)))
    above = (F.col("idx") >= w) & (F.col("idx") < F.col("n") - w) & (loud | (F.abs("diff_q") >= rules.q_floor))
    return own_rows(s.withColumn("above", above)).select("series_id", "idx", "n", "diff_p", "diff_q", "diff_noise", "above")


def detect_steps(df: DataFrame, rules: StepRules = StepRules()) -> DataFrame:
    """STEP_SCHEMA (not rounded) and idx, the row of the onset.

    Each run of rows with a marked change gives its strongest row; the 4w rows around it come by an
    equi-join on position and are judged as one bounded array: levels by medians, the onset by the
    half-way crossing, and whether the level lasts.
    """
    w = rules.w
    scores = change_scores(df, rules)
    marked = scores.where("above").withColumn("force", F.hypot("diff_p", "diff_q"))
    run = F.col("idx") - F.row_number().over(Window.partitionBy("series_id").orderBy("idx"))
    best = marked.withColumn("run", run).groupBy("series_id", "run").agg(F.max_by("idx", F.struct("force", -F.col("idx"))).alias("k"), F.first("n").alias("n")).drop("run")
    near = best.withColumn("idx", F.explode(F.sequence(F.greatest(F.col("k") - 2 * w, F.lit(0)), F.least(F.col("k") + 2 * w - 1, F.col("n") - 1))))
    rows = near.join(df.select("series_id", "idx", "t_sec", F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("q", F.lit(0.0)).alias("q"), "thd"), ["series_id", "idx"])
    around = rows.groupBy("series_id", "k", "n").agg(F.collect_list(F.struct("idx", "t_sec", "p", "q", "thd")).alias("r"))
    k = F.col("k")
    part = lambda lo, hi, c: F.transform(F.filter("r", lambda x: (x["idx"] >= lo) & (x["idx"] < hi)), lambda x: x[c])
    level = lambda lo, hi, c: median_of(part(lo, hi, c))
    s = once(around, p_before=level(k - w, k, "p"), p_after=level(k, k + w, "p"), q_before=level(k - w, k, "q"), q_after=level(k, k + w, "q"), later=level(k + w, k + 2 * w, "p"), thd_i_after=median_of(F.filter(part(k, k + w, "thd"), lambda x: x.isNotNull())))
    s = once(s, delta_p=F.col("p_after") - F.col("p_before"), delta_q=F.col("q_after") - F.col("q_before"))
    gone = (k + 2 * w <= F.col("n")) & (F.abs("delta_p") > 1e-6) & (F.abs(F.col("later") - F.col("p_after")) > rules.sustain * F.abs("delta_p"))
    s = s.where(((F.abs("delta_p") >= rules.floor_w) | (F.abs("delta_q") >= rules.q_floor)) & ~gone)
    low = F.filter("r", lambda x: (x["idx"] > F.greatest(k - 2 * w, F.lit(0))) & (x["idx"] <= k) & (F.try_divide(x["p"] - F.col("p_before"), F.col("delta_p")) < 0.5))
    onset = F.when(F.abs("delta_p") > 1e-6, F.coalesce(F.array_max(F.transform(low, lambda x: x["idx"])), F.greatest(k - w, F.lit(0)))).otherwise(k)
    s = once(s, idx=onset)
    s = once(s, t_sec=F.get(F.transform(F.filter("r", lambda x: x["idx"] == F.col("idx")), lambda x: x["t_sec"]), F.lit(0)))
    return s.select("series_id", "idx", "t_sec", "delta_p", "delta_q", "p_before", "p_after", "thd_i_after")
