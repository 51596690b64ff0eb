"""Matching of steps and levels to devices and combinations of devices.

The device table of a site is small. It is folded into one array that is joined to every row as a
constant, so a match is a projection: no row is multiplied and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import confidence, device_residual, pick_sign, single_score
from ..staging import staged
from .medians import medians

#: Devices or combinations that may travel with every row, at most.
MOST_ENTRIES = 100_000
IDLE_VA = 3.0


def folded(table: DataFrame, name: str, most: int = MOST_ENTRIES) -> DataFrame:
    """table as one row with an array of its rows, for `with_constant`; its size is checked."""
    if not table.limit(most + 1).offset(most).isEmpty():
        raise ValueError(f"more than {most} {name} are too many to travel with every step; narrow the devices or the combination size")
    return table.coalesce(1).agg(F.collect_list(F.struct(*table.columns)).alias(name))


def with_constant(df: DataFrame, one_row: DataFrame) -> DataFrame:
    return df.join(F.broadcast(one_row), F.lit(True))


def combinations(devices: DataFrame, smallest: int, largest: int) -> DataFrame:
    """(size, ords, members, P, Q, least_va, uncalibrated) of all device sets of those sizes, by
    inequality self-joins on ord."""
    one = devices.select(F.lit(1).alias("size"), F.array("ord").alias("ords"), F.array("device").alias("members"), "P", "Q", F.hypot("P", "Q").alias("least_va"), F.when(F.col("calibrated"), 0).otherwise(1).alias("uncalibrated"))
    one = one.coalesce(1)  # a site's devices; joins without keys multiply partitions
    level, out = one, None
    single = F.broadcast(one.select(*[F.col(c).alias(f"_{c}") for c in one.columns]))
    for size in range(1, largest + 1):
        if size > 1:
            level = level.join(single, F.col("_ords")[0] > F.element_at("ords", -1)).select(
                (F.col("size") + 1).alias("size"), F.concat("ords", "_ords").alias("ords"), F.concat("members", "_members").alias("members"),
                (F.col("P") + F.col("_P")).alias("P"), (F.col("Q") + F.col("_Q")).alias("Q"), F.least("least_va", "_least_va").alias("least_va"), (F.col("uncalibrated") + F.col("_uncalibrated")).alias("uncalibrated"),
            )
        if size >= smallest:
            out = level if out is None else out.unionByName(level)
    return out


def nearest_device(steps: DataFrame, devices: DataFrame, penalty: float = 2.0) -> DataFrame:
    """steps with nearest {err, ord, device}: least distance to the step plus `penalty` if the device is
    not calibrated; of equal ones the first device."""
    p, q = pick_sign("delta_p", "delta_q")
    near = F.transform("devs", lambda d: F.struct((F.hypot(d["P"] - p, d["Q"] - q) + F.when(d["calibrated"], 0.0).otherwise(penalty)).alias("err"), d["ord"].alias("ord"), d["device"].alias("device")))
    return with_constant(steps, folded(devices, "devs")).withColumn("nearest", F.array_min(near)).drop("devs")


def nearest_known(steps: DataFrame, devices: DataFrame, k: int = 2) -> DataFrame:
    """steps with nearest: array of the k nearest {dist, ord, device}, by distance to two digits, then order."""
    p, q = pick_sign("delta_p", "delta_q")
    far = F.transform("devs", lambda d: F.struct(F.bround(F.hypot(d["P"] - p, d["Q"] - q), 2).alias("dist"), d["ord"].alias("ord"), d["device"].alias("device")))
    return with_constant(steps, folded(devices, "devs")).withColumn("nearest", F.slice(F.array_sort(far), 1, k)).drop("devs")


def match_steps(steps: DataFrame, devices: DataFrame, largest: int = 3, penalty: float = 6.0, penalty_share: float = 0.0, tol_abs: float = 10.0, tol_share: float = 0.18) -> DataFrame:
    """steps with members, ords, err and ok: the set of up to `largest` devices nearest to the step, each
    device after the first costing max(penalty, penalty_share * size); ok if err is within tolerance."""
    p, q = pick_sign("delta_p", "delta_q")
    mag = F.hypot("delta_p", "delta_q")
    extra = F.greatest(F.lit(penalty), penalty_share * mag)
    tried = F.transform("combos", lambda c: F.struct((F.hypot(c["P"] - p, c["Q"] - q) + extra * (c["size"] - 1)).alias("err"), c["size"].alias("size"), c["ords"].alias("ords"), c["members"].alias("members")))
    out = with_constant(steps, folded(combinations(devices, 1, largest), "combos")).withColumn("_best", F.array_min(tried))
    return out.withColumns({"members": F.array_sort("_best.members"), "ords": F.col("_best.ords"), "err": F.col("_best.err"), "ok": F.col("_best.err") <= F.greatest(F.lit(tol_abs), tol_share * mag)}).drop("combos", "_best")


def is_novel_step(steps: DataFrame, devices: DataFrame, threshold: float = 30.0) -> DataFrame:
    """steps with err and novel: no set of up to three devices comes within threshold."""
    return match_steps(steps, devices).withColumn("novel", F.col("err") > threshold).drop("members", "ords", "ok")


def best_of_onset(matched: DataFrame, *order: str) -> DataFrame:
    """Of the steps of a series that begin at one row (series_id, idx), the one that comes first by `order`."""
    rest = [c for c in matched.columns if c not in ("series_id", "idx", *order)]
    return matched.groupBy("series_id", "idx").agg(F.min(F.struct(*order, *rest)).alias("_first")).select("series_id", "idx", "_first.*")


def snapshots(df: DataFrame) -> DataFrame:
    """One steady level per series: median P and Q, their deviations, median distortion."""
    spread = (F.stddev_pop("p").alias("p_std"), F.stddev_pop("q").alias("q_std"))
    return medians(staged(df.select("series_id", "p", "q", "thd"), "levels"), {"P_now": "p", "Q_now": "q", "thd_now": "thd"}, more=spread)


def standing_loads(levels: DataFrame, devices: DataFrame, largest: int = 3, tol_abs: float = 8.0, tol_share: float = 0.10, min_share: float = 0.10, alternatives: int = 3) -> DataFrame:
    """levels (P_now, Q_now, thd_now) with idle, best, residual, confidence, single, alternatives and note.

    The best single device is that of least score (distortion included); a combination, judged by
    power alone and made of devices that each matter, must beat it by a margin. Not rounded.
    """
    mag = F.hypot("P_now", "Q_now")
    tol = F.greatest(F.lit(tol_abs), tol_share * mag)
    margin = F.greatest(F.lit(2.0), 0.03 * mag)
    score = lambda d: F.struct(single_score("P_now", "Q_now", "thd_now", d.getItem).alias("score"), d["ord"].alias("ord"), d["device"].alias("device"), device_residual("P_now", "Q_now", d.getItem).alias("residual"), d["varies"].alias("varies"))
    out = with_constant(levels, folded(devices, "devs")).withColumn("singles", F.array_sort(F.transform("devs", score)))
    out = with_constant(out, folded(combinations(devices, 2, largest), "combos"))
    fitting = F.filter("combos", lambda c: c["least_va"] >= min_share * mag)
    combo = F.array_min(F.transform(fitting, lambda c: F.struct((F.hypot(c["P"] - F.col("P_now"), c["Q"] - F.col("Q_now")) + 4.0 * (c["size"] - 1)).alias("residual"), c["size"].alias("size"), c["ords"].alias("ords"), c["members"].alias("members"))))
    out = out.withColumns({"_combo": combo, "_single": F.col("singles")[0]})
    wins = F.coalesce(F.col("_combo.residual") + margin < F.col("_single.residual"), F.lit(False))
    out = out.withColumns({"idle": mag < IDLE_VA, "_wins": wins, "residual": F.when(wins, F.col("_combo.residual")).otherwise(F.col("_single.residual"))})
    out = out.withColumn("_ok", F.col("residual") <= tol)
    others = F.filter(F.slice("singles", 2, alternatives), lambda s: s["residual"] <= tol * 1.5)
    none = F.array().cast("array<string>")
    # fixed values: the sentences of a note
    note = (
        F.when(F.col("idle"), "Nothing is drawing power.")
        .when(~F.col("_ok"), "The standing load does not match any known device or combination.")
        .when(F.col("_wins"), "Several devices explain this level. Distortion cannot separate them, because it does not add up when devices run together.")
        .when(F.col("_single.varies"), "This device's power changes while it runs, so it is recognised mainly by its current distortion rather than by how many watts it draws.")
        .when(F.col("thd_now").isNull(), "Distortion was not available, so this rests on power alone.")
        .otherwise("")
    )
    return out.select(
        *levels.columns, "idle",
        F.when(F.col("idle") | ~F.col("_ok"), none).when(F.col("_wins"), F.array_sort("_combo.members")).otherwise(F.array("_single.device")).alias("best"),
        F.when(F.col("idle"), 0.0).otherwise(F.col("residual")).alias("residual"),
        F.when(F.col("idle"), 100).when(~F.col("_ok"), 0).otherwise(confidence(F.col("residual"), tol)).alias("confidence"),
        (~F.col("idle") & F.col("_ok") & ~F.col("_wins")).alias("single"),
        F.when(F.col("idle") | ~F.col("_ok"), none).otherwise(F.transform(others, lambda s: s["device"])).alias("alternatives"),
        note.alias("note"),
    )
