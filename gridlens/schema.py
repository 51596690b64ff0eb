"""Schemas of recordings and of what is derived from them, and the fixed device table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: A normalised recording: one long table of all series. Missing measurements are null, never NaN.
METER_SCHEMA = (
    "series_id string, timestamp_iso timestamp, device_name string, run_id string, sample_interval_ms int, "
    "u_l1_n_v double, i_l1_a double, p_total_w double, s_total_va double, s_calc_va double, q_total_var double, "
    "pf_total double, frequency_hz double, thd_u_l1_percent double, thd_i_l1_percent double, "
    "block_time_difference_ms int, idx long, t_sec double"
)
#: Columns of a meter file in their order; the header that a live tail assumes when a file has none.
METER_COLUMNS = [c.split()[0] for c in METER_SCHEMA.split(", ")[1:-2]]
MEASURES = ["u_l1_n_v", "i_l1_a", "p_total_w", "s_total_va", "s_calc_va", "q_total_var", "pf_total", "frequency_hz", "thd_u_l1_percent", "thd_i_l1_percent"]
WHOLE = ["sample_interval_ms", "block_time_difference_ms"]

#: What the detectors read: power p, reactive power q, distortion thd (null if absent).
SIGNAL_SCHEMA = "series_id string, idx long, t_sec double, p double, q double, thd double"
REGION_SCHEMA = "series_id string, on_idx long, off_idx long, on_t double, off_t double, baseline_w double, sps int"
STEP_SCHEMA = "series_id string, t_sec double, delta_p double, delta_q double, p_before double, p_after double, thd_i_after double"
DEVICE_SCHEMA = "ord int, device string, P double, Q double, thd_i double, family string, varies boolean, generator boolean, p_lo double, p_hi double, thd_lo double, thd_hi double, calibrated boolean"
TIMELINE_SCHEMA = "series_id string, step_no int, t_sec double, active array<string>, unknown_residual double"

#: The site's measured devices in their order, which breaks ties.
DEVICES = [
    (0, "COOLER_FAN1", 32.93, 55.87, 12.0, "Cooler", False, False, None, None, None, None),
    (1, "COOLER_FAN1 Stufe 1", 22.34, 36.02, 12.6, "Cooler", False, False, None, None, None, None),
    (2, "COOLER_FAN1 Stufe 2", 29.05, 45.1, 11.5, "Cooler", False, False, None, None, None, None),
    (3, "TABLE_FAN", 17.13, 23.6, 10.8, None, False, False, None, None, None, None),
    (4, "Monitor", 16.26, 0.62, 165.5, None, False, False, None, None, None, None),
    (5, "INCENDESCENT_LIGHT", 493.16, -2.91, 4.8, None, False, False, None, None, None, None),
    (6, "COFFEE_MACHINE", 1231.54, -4.02, 2.3, None, False, False, None, None, None, None),
    (7, "WATER_HEATER", 946.04, -2.92, 2.1, None, False, False, None, None, None, None),
    (8, "Toaster", 708.97, 1.04, 2.2, None, False, False, None, None, None, None),
    (9, "Foen Stufe 1", 197.13, -0.18, 6.4, "Foen", False, False, None, None, None, None),
    (10, "Foen Stufe 2", 225.98, -188.43, 76.1, "Foen", False, False, None, None, None, None),
    (11, "Foen Stufe 3", 991.51, 2.8, 2.4, "Foen", False, False, None, None, None, None),
    (12, "USB Ladegerät", 30.45, -3.15, 156.1, None, True, False, 1.5, 32.0, 144.0, 248.0),
    (13, "PV", -7.0, -17.3, 26.0, None, True, True, -35.0, 1.0, 20.0, 40.0),
]


def devices(spark: SparkSession, rows=DEVICES, calibrated: bool = True) -> DataFrame:
    """The device dimension: a small table by construction."""
    return spark.createDataFrame([(*r, calibrated) for r in rows], DEVICE_SCHEMA).coalesce(1)


def devices_sql(rows=DEVICES) -> str:
    """The same table as a VALUES list named dev."""
    lit = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    cast = lambda v, i: f"CAST({lit(v)} AS {'VARCHAR' if i in (1, 5) else 'BOOLEAN' if i in (6, 7) else 'INTEGER' if i == 0 else 'DOUBLE'})"
    body = ", ".join("(" + ", ".join(cast(v, i) for i, v in enumerate(r)) + ")" for r in rows)
    return f"dev(ord, device, P, Q, thd_i, family, varies, generator, p_lo, p_hi, thd_lo, thd_hi) AS (VALUES {body})"
