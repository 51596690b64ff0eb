"""Column expressions for names, load descriptions, step features and device residuals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names that are replaced, and letters of file names.
RENAMED = {"Laptop_Ravi": "Laptop"}
SLUG_LETTERS = [(" ", "_"), (".", "p"), ("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")]
#: Scales of the single-device score.
SCALE_W, SCALE_VARYING_W, SCALE_THD = 2.0, 15.0, 20.0
#: Reactive share up to which a load is resistive; size bands in watts and what they suggest.
RESISTIVE_SHARE = 0.15
SIZES = {
    "resistive": [(800, "a large heating element such as a kettle, heater, toaster, or coffee machine"), (250, "a heating element or an incandescent lamp"), (40, "a small heater or a filament lamp"), (None, "a small resistive load")],
    "inductive": [(500, "a large motor or a transformer"), (60, "a motor, a pump, or a compressor"), (None, "a small motor, a fan, or a lamp with a magnetic ballast")],
    "capacitive": [(100, "a larger power supply, an inverter, or a charger"), (20, "a computer, a monitor, or a television"), (None, "a small electronic device such as an LED lamp, a charger, or a USB supply")],
}
#: What the kinds of load do.
NATURE = {
    "resistive": "draws current in phase with the voltage, so nearly all of its power does real work",
    "inductive": "draws current that lags the voltage, which means magnetic windings",
    "capacitive": "draws current that leads the voltage, typical of a switched-mode power supply",
}


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_name(c: str | Column) -> Column:
    name = F.trim(col(c))
    for old, new in RENAMED.items():
        name = F.when(name == old, F.lit(new)).otherwise(name)
    return name


def slug(c: str | Column) -> Column:
    out = F.lower(clean_name(c))
    for a, b in SLUG_LETTERS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def load_character(pf: str | Column, q: str | Column, thd: str | Column) -> Column:
    """The tags of a steady load, joined by ' + '."""
    pf, q, thd = col(pf), col(q), col(thd)
    tags = F.concat_ws(" + ", F.when(thd > 25, "non-linear"), F.when(q > 15, "inductive").when(q < -15, "capacitive/leading"))
    return F.when((pf > 0.97) & (thd.isNull() | (thd < 5)), "resistive").when(tags == "", "mostly resistive").otherwise(tags)


def pick_sign(dp: str | Column, dq: str | Column) -> tuple[Column, Column]:
    """The step as the load that it switches: power positive, reactive power turned along."""
    dp, dq = col(dp), col(dq)
    return F.abs(dp), F.when(dp >= 0, dq).otherwise(-dq)


def describe_load(dp: str | Column, dq: str | Column) -> Column:
    """A struct of class, label, description, p_w, q_var, s_va, pf and angle_deg, not rounded."""
    p, q = pick_sign(dp, dq)
    s = F.hypot(p, q)
    none = s < 1e-6
    pf = F.when(s > 1e-6, F.try_divide(p, s)).otherwise(0.0)
    kind = F.when(F.abs(q) <= RESISTIVE_SHARE * F.greatest(p, F.lit(1e-6)), "resistive").when(q > 0, "inductive").otherwise("capacitive")

    def by_kind(options: dict) -> Column:
        out = None
        for name, value in options.items():
            out = F.when(kind == name, value) if out is None else out.when(kind == name, value)
        return out

    def banded(bands: list) -> Column:
        out = None
        for least, text in bands[:-1]:
            out = F.when(p >= least, text) if out is None else out.when(p >= least, text)
        return out.otherwise(bands[-1][1])

    said = F.concat(F.lit("About "), F.format_string("%.0f", s), F.lit(" VA at power factor "), F.format_string("%.2f", pf), F.lit(". It "), by_kind({k: F.lit(v) for k, v in NATURE.items()}), F.lit(". This is most likely "), by_kind({k: banded(v) for k, v in SIZES.items()}), F.lit("."))
    number = lambda c: F.when(none, 0.0).otherwise(c)
    return F.struct(
        F.when(none, "none").otherwise(kind).alias("class"),
        F.when(none, "No load").otherwise(F.concat(F.lit("Unknown "), kind, F.lit(" load"))).alias("label"),
        F.when(none, "").otherwise(said).alias("description"),
        number(p).alias("p_w"), number(q).alias("q_var"), number(s).alias("s_va"), number(pf).alias("pf"), number(F.degrees(F.atan2(q, p))).alias("angle_deg"),
    )


def step_features(dp: str | Column, dq: str | Column) -> dict[str, Column]:
    dp, dq = col(dp), col(dq)
    return {"abs_dp": F.abs(dp), "abs_dq": F.abs(dq), "mag": F.hypot(dp, dq), "angle": F.atan2(dq, dp), "qp_ratio": F.when(F.abs(dp) > 1e-6, F.try_divide(dq, dp)).otherwise(0.0)}


def q_sign(q: str | Column) -> Column:
    q = col(q)
    return F.when(q > 5, 1).when(q < -5, -1).otherwise(0)


def guarded(top: Column, below: Column, otherwise: float = 0.0) -> Column:
    """top / below where below is larger than a millionth in size."""
    return F.when(F.abs(below) > 1e-6, F.try_divide(top, below)).otherwise(otherwise)


def apparent(p: str | Column, q: str | Column, volts: str | Column) -> dict[str, Column]:
    """s_va, i_a and pf of a load; a missing or zero voltage is 230 V, and pf is null without power."""
    s = F.hypot(col(p), col(q))
    v = F.when(F.coalesce(col(volts), F.lit(0.0)) == 0, 230.0).otherwise(col(volts))
    return {"s_va": s, "i_a": s / v, "pf": F.when(s > 1e-6, F.try_divide(col(p), s))}


def device_params(p_std: str | Column, q_std: str | Column, least: float = 0.01) -> dict[str, Column]:
    """P_std and Q_std of a device, at least `least` and so where they are missing."""
    return {name: F.greatest(F.coalesce(col(c), F.lit(0.0)), F.lit(least)) for name, c in (("P_std", p_std), ("Q_std", q_std))}


def clean_value(c: str | Column) -> Column:
    """A dashboard number: 0 where it is none, two digits."""
    return F.bround(F.coalesce(F.nanvl(col(c).try_cast("double"), F.lit(0.0)), F.lit(0.0)), 2)


def edge_distance(x: Column, lo: Column, hi: Column) -> Column:
    return F.when(x < lo, lo - x).when(x > hi, x - hi).otherwise(0.0)


def device_residual(p: str | Column, q: str | Column, of=F.col) -> Column:
    """Distance in the (P, Q) plane of a level to a device, whose fields `of` gives by name; inside a
    varying device's power range only Q counts."""
    p, q = col(p), col(q)
    dp = F.when(of("varies") & of("p_lo").isNotNull(), edge_distance(p, of("p_lo"), of("p_hi"))).otherwise(of("P") - p)
    return F.hypot(dp, of("Q") - q)


def thd_term(thd: str | Column, of=F.col) -> Column:
    """Distance in distortion, null where it is unknown."""
    x = col(thd)
    return F.when(of("thd_lo").isNotNull(), edge_distance(x, of("thd_lo"), of("thd_hi")) / SCALE_THD).otherwise((of("thd_i") - x) / SCALE_THD)


def single_score(p: str | Column, q: str | Column, thd: str | Column, of=F.col) -> Column:
    scale = F.when(of("varies"), SCALE_VARYING_W).otherwise(SCALE_W)
    square = lambda c: c * c
    known = F.when(col(thd).isNotNull(), square(thd_term(thd, of)))
    return F.sqrt(square((of("P") - col(p)) / scale) + square((of("Q") - col(q)) / scale) + F.coalesce(known, F.lit(0.0)))


def confidence(residual: Column, tolerance: Column) -> Column:
    return F.greatest(F.lit(5), F.least(F.lit(99), F.bround(100.0 * (1.0 - residual / tolerance)).cast("int")))
