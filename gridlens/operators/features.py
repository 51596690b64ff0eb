"""Aggregates over on-regions: twelve features of a cycle, and a series' fingerprint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import guarded, load_character, q_sign
from .windows import rows_within

FEATURES = ["p_mean", "q_mean", "q_sign", "qp_ratio", "thd_i_mean", "inrush_ratio", "p_std", "thd_u_mean", "settling_s", "crest_factor", "n_state_changes", "s_mean"]


def steady(regions: DataFrame, settle_s: float) -> DataFrame:
    """regions with first and last row of the steady part [on + settle, off), or [on, off) if that is empty."""
    late = F.col("on_idx") + F.floor(F.lit(settle_s) * F.col("sps"))
    return regions.withColumns({"steady_from": F.when(late < F.col("off_idx"), late).otherwise(F.col("on_idx")), "last_idx": F.col("off_idx") - 1})


def _in_region(regions: DataFrame, df: DataFrame, settle_s: float) -> DataFrame:
    return rows_within(steady(regions, settle_s), df, "on_idx", "last_idx").withColumn("is_steady", F.col("idx") >= F.col("steady_from"))


def in_steady(c: str) -> Column:
    return F.when(F.col("is_steady"), F.col(c))


def state_changes(rows: DataFrame, means: DataFrame, dwell_s: float = 2.0, jump: float = 0.25) -> DataFrame:
    """(series_id, on_idx, n_state_changes): jumps between means of consecutive whole blocks of dwell_s."""
    win = F.greatest(F.lit(1), F.floor(dwell_s * F.col("sps")))
    length = F.col("off_idx") - F.col("on_idx")
    whole = rows.where((length >= 3 * F.col("sps")) & (F.floor((F.col("idx") - F.col("on_idx")) / win) < F.floor(length / win)))
    blocks = whole.groupBy("series_id", "on_idx", F.floor((F.col("idx") - F.col("on_idx")) / win).alias("block")).agg(F.avg("p").alias("level"))
    before = blocks.select("series_id", "on_idx", (F.col("block") + 1).alias("block"), F.col("level").alias("was"))
    jumps = blocks.join(before, ["series_id", "on_idx", "block"]).join(means, ["series_id", "on_idx"])
    return jumps.groupBy("series_id", "on_idx").agg(F.count_if((F.col("p_mean") >= 1e-6) & (F.abs(F.col("level") - F.col("was")) > jump * F.col("p_mean"))).alias("n_state_changes"))


def region_features(regions: DataFrame, df: DataFrame, settle_s: float = 1.0) -> DataFrame:
    """series_id, on_idx and FEATURES of each region; not rounded.

    df: series_id, idx, p, q, s, i, thd_i, thd_u. Regions meet their rows by an equi-join on bins
    of positions. Nulls are skipped; a mean of nothing is 0.
    """
    rows = _in_region(regions, df, settle_s)
    keys = ["series_id", "on_idx", "off_idx", "sps"]
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    sums = rows.groupBy(*keys).agg(
        *[zero(F.avg(in_steady(c))).alias(f"{name}_mean") for c, name in (("p", "p"), ("q", "q"), ("s", "s"), ("thd_i", "thd_i"), ("thd_u", "thd_u"))],
        zero(F.stddev_pop(in_steady("p"))).alias("p_std"),
        F.max(F.when(F.col("idx") < F.col("on_idx") + F.col("sps"), F.col("p"))).alias("inrush"),
        F.max(in_steady("i")).alias("i_max"), F.avg(in_steady("i")).alias("i_avg"),
    )
    reach = rows.join(sums.select("series_id", "on_idx", "p_mean"), ["series_id", "on_idx"]).where(F.col("p") >= 0.9 * F.col("p_mean")).groupBy("series_id", "on_idx").agg(F.min("idx").alias("reached"))
    jumps = state_changes(rows, sums.select("series_id", "on_idx", "p_mean"))
    out = sums.join(reach, ["series_id", "on_idx"], "left").join(jumps, ["series_id", "on_idx"], "left")
    return out.select(
        "series_id", "on_idx", "p_mean", "q_mean", q_sign("q_mean").alias("q_sign"), guarded(F.col("q_mean"), F.col("p_mean")).alias("qp_ratio"), "thd_i_mean",
        guarded(F.coalesce("inrush", "p_mean"), F.col("p_mean"), 1.0).alias("inrush_ratio"), "p_std", "thd_u_mean",
        zero((F.col("reached") - F.col("on_idx")) / F.col("sps")).alias("settling_s"),
        F.when(F.col("i_avg") > 1e-6, F.try_divide("i_max", "i_avg")).otherwise(1.0).alias("crest_factor"),
        F.coalesce("n_state_changes", F.lit(0)).alias("n_state_changes"), "s_mean",
    )


def cycles(regions: DataFrame, least_s: float = 4.0) -> DataFrame:
    """Regions that last least_s or more."""
    return regions.where(F.col("off_t") - F.col("on_t") >= least_s)


def fingerprints(main: DataFrame, df: DataFrame, settle_s: float = 1.0) -> DataFrame:
    """One row per series with its main region: steady means and sample deviations, the level before
    it, inrush, mean voltage and the character of the load; not rounded.

    df: series_id, idx, p, q, thd_i, thd_u, pf, u. The level before is that of the rows ahead of the
    region if there are more than five, else of the first five.
    """
    rows = _in_region(main, df, settle_s)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    mean = lambda c, name: zero(F.avg(in_steady(c))).alias(f"{name}_mean")
    spread = lambda c, name: zero(F.stddev_samp(in_steady(c))).alias(f"{name}_std")
    on = rows.groupBy("series_id", "on_t", "off_t", "sps").agg(
        mean("p", "on_p"), spread("p", "on_p"), mean("q", "on_q"), spread("q", "on_q"), mean("pf", "on_pf"), mean("thd_i", "on_thd_i"), spread("thd_i", "on_thd_i"), mean("thd_u", "on_thd_u"),
        F.max(F.when(F.col("idx") < F.col("on_idx") + F.col("sps"), F.col("p"))).alias("inrush"),
    )
    ahead = main.select("series_id", F.lit(0).cast("long").alias("from_idx"), (F.when(F.col("on_idx") > 5, F.col("on_idx")).otherwise(5) - 1).alias("to_idx"))
    off = rows_within(ahead, df, "from_idx", "to_idx").groupBy("series_id").agg(F.avg("p").alias("off_p_mean"), F.avg("q").alias("off_q_mean"))
    volts = df.groupBy("series_id").agg(F.avg("u").alias("voltage_mean"))
    out = on.join(off, "series_id").join(volts, "series_id")
    ratio = F.when(F.col("on_p_mean") > 1, F.try_divide("inrush", "on_p_mean")).otherwise(1.0)
    return out.withColumns({"inrush_ratio": ratio, "load_character": load_character("on_pf_mean", "on_q_mean", "on_thd_i_mean")}).drop("inrush")


def band_check(real: DataFrame, runs: DataFrame, informational=("pf",), least_runs: int = 20, least_values: int = 5) -> DataFrame:
    """Whether a device's steady mean and deviation lie within the 5th to 95th percentile of its runs'.

    real: device, feature, value; runs: device, run, feature, value; both steady rows only. Runs with
    fewer than least_values values do not count; with fewer than least_runs runs nothing passes. The
    runs' deviation is the sample one, the real one the population's.
    """
    own = real.groupBy("device", "feature").agg(F.count("value").alias("n"), F.avg("value").alias("real_mean"), F.stddev_pop("value").alias("real_std")).where(F.col("n") >= least_values)
    each = runs.groupBy("device", "feature", "run").agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.stddev_samp("value").alias("s")).where(F.col("n") >= least_values)
    edge = lambda c, at: F.when(F.count("*") >= least_runs, F.percentile(c, F.lit(at)))
    bands = each.groupBy("device", "feature").agg(edge("m", 0.05).alias("synth_mean_p05"), edge("m", 0.95).alias("synth_mean_p95"), edge("s", 0.05).alias("synth_std_p05"), edge("s", 0.95).alias("synth_std_p95"))
    inside = lambda x, which: F.coalesce(F.col(x).between(F.col(f"synth_{which}_p05"), F.col(f"synth_{which}_p95")), F.lit(False))
    return own.drop("n").join(bands, ["device", "feature"], "left").withColumns({"mean_pass": inside("real_mean", "mean"), "noise_pass": inside("real_std", "std"), "informational": F.col("feature").isin(*informational)})


def pass_counts(checks: DataFrame) -> DataFrame:
    """Passes per device of the bands that are not informational."""
    real = ~F.col("informational")
    return checks.groupBy("device").agg(F.count_if(real).alias("checks"), F.count_if(real & F.col("mean_pass")).alias("mean_passes"), F.count_if(real & F.col("noise_pass")).alias("noise_passes"))


