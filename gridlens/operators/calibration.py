"""Calibration: device powers measured from recordings that switch known devices in a known order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def calibrate(steps: DataFrame, order: DataFrame) -> DataFrame:
    """(device, P, Q, n_obs), means over all observations, not rounded.

    steps: series_id, t_sec, delta_p, delta_q. order: series_id, pos (from 1), device. The k-th ON step
    of a recording is its k-th device, steps of one time in the order of their sizes; an OFF step belongs to
    the device of the recording whose ON step was nearest in size, of equal ones the first.
    """
    rank = F.row_number().over(Window.partitionBy("series_id").orderBy("t_sec", "delta_p", "delta_q"))
    on = steps.where("delta_p > 0").withColumn("pos", rank).join(order, ["series_id", "pos"]).select("series_id", "pos", "device", F.abs("delta_p").alias("P"), F.col("delta_q").alias("Q"))
    off = steps.where("delta_p < 0").withColumn("off_no", rank).select("series_id", "off_no", F.abs("delta_p").alias("size"), (-F.col("delta_q")).alias("off_q"))
    near = off.join(on, "series_id").groupBy("series_id", "off_no").agg(F.min_by(F.struct("device", F.col("size").alias("P"), F.col("off_q").alias("Q")), F.struct(F.abs(F.col("P") - F.col("size")), "pos")).alias("o"))
    seen = on.select("device", "P", "Q").unionByName(near.select("o.*"))
    return seen.groupBy("device").agg(F.avg("P").alias("P"), F.avg("Q").alias("Q"), F.count("*").alias("n_obs"))


def apply_calibration(devices: DataFrame, measured: DataFrame) -> DataFrame:
    """Devices with measured values laid over them; measured devices that are not known are added
    after the known ones. The generator mark is the known one's.

    measured: device, P, Q and any of family, varies, thd_i, p_lo, p_hi, thd_lo, thd_hi. A null keeps
    what is known. Both are site tables; the join is on device.
    """
    extra = ["family", "varies", "thd_i", "p_lo", "p_hi", "thd_lo", "thd_hi"]
    kinds = dict(devices.dtypes)
    m = measured.select("device", F.col("P").alias("mP"), F.col("Q").alias("mQ"), *[(F.col(c) if c in measured.columns else F.lit(None).cast(kinds[c])).alias(f"m_{c}") for c in extra], F.lit(True).alias("hit"))
    both = devices.join(m, "device", "full_outer")
    added = F.row_number().over(Window.partitionBy(F.col("ord").isNull()).orderBy("device")) - 1
    known = devices.agg(F.coalesce(F.max("ord") + 1, F.lit(0)).alias("_known"))
    both = both.withColumn("_added", added).join(F.broadcast(known), F.lit(True))
    over = {c: F.coalesce(f"m_{c}", c) for c in extra if c != "varies"}
    return both.withColumns({
        "ord": F.coalesce("ord", (F.col("_known") + F.col("_added")).cast("int")), "P": F.coalesce("mP", "P"), "Q": F.coalesce("mQ", "Q"), **over,
        "varies": F.coalesce(F.col("m_varies") | F.col("varies"), "m_varies", "varies", F.lit(False)), "generator": F.coalesce("generator", F.lit(False)),
        "calibrated": F.coalesce("hit", "calibrated", F.lit(False)),
    }).select(*devices.columns)


def candidates(devices: DataFrame) -> DataFrame:
    """The calibrated devices, or all if none is."""
    any_ = devices.agg(F.coalesce(F.bool_or("calibrated"), F.lit(False)).alias("_any"))
    return devices.join(F.broadcast(any_), F.lit(True)).where(F.col("calibrated") | ~F.col("_any")).drop("_any")


def onboard(devices: DataFrame, name: str, dp: float, dq: float) -> DataFrame:
    """devices with one more, taken from an unknown step; it counts as one observation."""
    p, q = abs(dp), dq if dp >= 0 else -dq
    row = devices.sparkSession.createDataFrame([(name, float(round(p, 2)), float(round(q, 2)))], "device string, P double, Q double")
    return apply_calibration(devices, row)
