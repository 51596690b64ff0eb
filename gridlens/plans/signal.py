"""Signal queries over the driver's event table, with their SQL.

The table stands in for meter recordings: one series per user, one row per second, and windows of a
few rows (sources.meter.meter_view).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import step_features
from ..operators import features, regions, steps, windows
from ..operators.synthesis import spread
from ..sources.meter import meter_view, read_recordings
from ..staging import new_folder, staged

REGIONS = regions.RegionRules(sps=1, baseline_s=3, k_noise=1.0, floor_w=3.0, min_on_s=3, max_gap_s=1, smooth_s=3)
STEPS = steps.StepRules(sps=1, win_s=3, floor_w=5.0, k_noise=1.0, smooth_s=3, q_floor=40.0, noise_s=5)

#: Events that one task writes as meter files.
EVENTS_A_TASK = 50_000


def meter(spark, sf_dir):
    return meter_view(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "value", "props"))


def rounded(df, *names, digits=6):
    """Doubles rounded at the outermost projection, as sums differ in their last bits between engines."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in names})


METER = """meter AS (
  SELECT CAST(user_id AS VARCHAR) AS series_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx,
         date_diff('microsecond', min(ts) OVER (PARTITION BY user_id), ts) / 1e6 AS t_sec, value AS p,
         CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) - 50 AS DOUBLE) AS q
  FROM events),
len AS (SELECT series_id, count(*) AS n FROM meter GROUP BY series_id)"""


def _smooth(width: int) -> str:
    h = width // 2
    return f"""sm AS (SELECT *, sum(p) OVER w / {width} AS ps, sum(q) OVER w / {width} AS qs FROM meter
  WINDOW w AS (PARTITION BY series_id ORDER BY idx ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING))"""


def _noise(k: int) -> str:
    ahead = (k - 1) // 2
    return f"""no0 AS (SELECT *, CASE WHEN count(*) OVER w >= 3 THEN stddev_samp(p - ps) OVER w END AS raw FROM sm
  WINDOW w AS (PARTITION BY series_id ORDER BY idx ROWS BETWEEN {k - 1 - ahead} PRECEDING AND {ahead} FOLLOWING)),
  no AS (SELECT *, coalesce(first_value(raw IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
                          last_value(raw IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS noise FROM no0)"""


def _diff(w: int) -> str:
    return f"""di AS (
  SELECT no.*, n, CASE WHEN idx >= {w} AND idx < n - {w} THEN avg(ps) OVER a - avg(ps) OVER b ELSE 0 END AS diff_p,
         CASE WHEN idx >= {w} AND idx < n - {w} THEN avg(qs) OVER a - avg(qs) OVER b ELSE 0 END AS diff_q, noise * sqrt(2.0 / {w}) AS diff_noise
  FROM no JOIN len USING (series_id)
  WINDOW a AS (PARTITION BY series_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING), b AS (PARTITION BY series_id ORDER BY idx ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING))"""


SMOOTH, NOISE, DIFF = _smooth(3), _noise(5), _diff(3)
REGION_CTE = f"""{METER}, {SMOOTH},
base AS (SELECT series_id, median(p) AS baseline_w, greatest(1.0 * stddev_pop(p), 3.0) AS threshold FROM meter WHERE idx < 3 GROUP BY series_id),
ab AS (SELECT sm.series_id, idx FROM sm JOIN base USING (series_id) WHERE abs(ps - baseline_w) > threshold),
fr AS (SELECT *, CASE WHEN idx - lag(idx) OVER (PARTITION BY series_id ORDER BY idx) <= 2 THEN 0 ELSE 1 END AS fresh FROM ab),
ru AS (SELECT *, sum(fresh) OVER (PARTITION BY series_id ORDER BY idx) AS run FROM fr),
re AS (SELECT series_id, min(idx) AS on_idx, max(idx) AS off_idx FROM ru GROUP BY series_id, run HAVING max(idx) - min(idx) + 1 >= 3),
regions AS (SELECT re.*, a.t_sec AS on_t, b.t_sec AS off_t, baseline_w, 1 AS sps
  FROM re JOIN meter a ON a.series_id = re.series_id AND a.idx = on_idx JOIN meter b ON b.series_id = re.series_id AND b.idx = off_idx JOIN base ON base.series_id = re.series_id),
longest AS (SELECT * FROM regions QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY off_idx - on_idx DESC, on_idx) = 1)"""


def step_cte(source: str, rules: steps.StepRules) -> str:
    """CTEs down to `steps` over a CTE `meter` (and `len`) that `source` defines."""
    w, width, k = rules.w, windows.odd_width(rules.smooth_s, rules.sps), int(rules.noise_s * rules.sps)
    return f"""{source}, {_smooth(width)}, {_noise(k)}, {_diff(w)},
ma AS (SELECT *, sqrt(diff_p * diff_p + diff_q * diff_q) AS force FROM di
  WHERE idx >= {w} AND idx < n - {w} AND (abs(diff_p) >= greatest({rules.floor_w}, {rules.k_noise} * coalesce(diff_noise, 0)) OR abs(diff_q) >= {rules.q_floor})),
rn AS (SELECT *, idx - row_number() OVER (PARTITION BY series_id ORDER BY idx) AS run FROM ma),
ks AS (SELECT series_id, idx AS k, n FROM rn QUALIFY row_number() OVER (PARTITION BY series_id, run ORDER BY force DESC, idx) = 1),
lv AS (
  SELECT ks.series_id, k, any_value(n) AS n, median(m.p) FILTER (WHERE idx < k AND idx >= k - {w}) AS p_before, median(m.p) FILTER (WHERE idx >= k AND idx < k + {w}) AS p_after,
         median(m.q) FILTER (WHERE idx < k AND idx >= k - {w}) AS q_before, median(m.q) FILTER (WHERE idx >= k AND idx < k + {w}) AS q_after,
         median(m.p) FILTER (WHERE idx >= k + {w} AND idx < k + {2 * w}) AS later
  FROM ks JOIN meter m ON m.series_id = ks.series_id AND m.idx BETWEEN k - {2 * w} AND k + {2 * w - 1} GROUP BY ks.series_id, k),
ld AS (SELECT *, p_after - p_before AS delta_p, q_after - q_before AS delta_q FROM lv),
onset AS (
  SELECT ld.series_id, k, max(idx) FILTER (WHERE idx > greatest(k - {2 * w}, 0) AND idx <= k AND abs(delta_p) > 1e-6 AND (m.p - p_before) / delta_p < 0.5) AS began
  FROM ld JOIN meter m ON m.series_id = ld.series_id AND m.idx BETWEEN k - {2 * w} AND k GROUP BY ld.series_id, k),
so AS (SELECT ld.*, CASE WHEN abs(delta_p) > 1e-6 THEN coalesce(began, greatest(k - {w}, 0)) ELSE k END AS idx FROM ld JOIN onset USING (series_id, k)),
steps AS (
  SELECT so.series_id, so.idx, m.t_sec, delta_p, delta_q, p_before, p_after FROM so JOIN meter m ON m.series_id = so.series_id AND m.idx = so.idx
  WHERE (abs(delta_p) >= {rules.floor_w} OR abs(delta_q) >= {rules.q_floor}) AND NOT (k + {2 * w} <= n AND abs(delta_p) > 1e-6 AND abs(later - p_after) > {rules.sustain} * abs(delta_p)))"""


STEP_CTE = step_cte(METER, STEPS)


def _r(*names: str) -> str:
    return ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in names)


def load_normalise(spark, sf_dir):
    return rounded(meter(spark, sf_dir).drop("thd", "n"), "t_sec")


def meter_files(spark, sf_dir):
    """The event table written as meter files, one for each user with a header, and read back."""
    folder = new_folder(spark, "meter-files")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp_iso"), F.concat(F.lit("user "), "user_id").alias("device_name"),
        F.col("value").alias("p_total_w"), (F.get_json_object("props", "$.k").cast("int") - 50).alias("q_total_var"), "user_id", "event_id",
    )
    dealt = spread(rows, "user_id", rows=EVENTS_A_TASK).sortWithinPartitions("user_id", "timestamp_iso", "event_id").drop("event_id")
    # version 2: each task puts its own files in place, not the driver all of them one by one
    dealt.write.partitionBy("user_id").option("header", True).option("mapreduce.fileoutputcommitter.algorithm.version", "2").csv(folder)
    back = read_recordings(spark, f"{folder}/*")
    return rounded(back.select("device_name", "idx", "t_sec", F.col("p_total_w").alias("p"), F.col("q_total_var").alias("q")), "t_sec")


def resolve_sps(spark, sf_dir):
    return windows.sample_rates(meter(spark, sf_dir))


def smooth_zero_pad(spark, sf_dir):
    s = windows.own_rows(windows.with_halo(meter(spark, sf_dir), 1, 1).withColumns({"ps": windows.smooth("p", 3), "qs": windows.smooth("q", 3)}))
    return rounded(s.select("series_id", "idx", "ps", "qs"), "ps", "qs")


def rolling_noise(spark, sf_dir):
    s = windows.with_halo(meter(spark, sf_dir), 4, 4).withColumn("ps", windows.smooth("p", 3)).withColumn("off", F.col("p") - F.col("ps"))
    s = windows.own_rows(s.withColumn("noise", windows.rolling_std("off", 5)).withColumn("noise", windows.filled("noise")))
    return rounded(s.select("series_id", "idx", "noise"), "noise")


def window_diff(spark, sf_dir):
    s = steps.change_scores(meter(spark, sf_dir), STEPS)
    return rounded(s.select("series_id", "idx", "diff_p", "diff_q", "diff_noise"), "diff_p", "diff_q", "diff_noise")


def regions_all(spark, sf_dir):
    return rounded(regions.detect_regions(meter(spark, sf_dir), REGIONS), "on_t", "off_t", "baseline_w")


def regions_longest(spark, sf_dir):
    return rounded(regions.longest_regions(regions.detect_regions(meter(spark, sf_dir), REGIONS)), "on_t", "off_t", "baseline_w")


def detect_steps(spark, sf_dir):
    s = steps.detect_steps(meter(spark, sf_dir), STEPS).drop("thd_i_after")
    return rounded(s, "t_sec", "delta_p", "delta_q", "p_before", "p_after")


def step_feature_rows(spark, sf_dir):
    s = steps.detect_steps(meter(spark, sf_dir), STEPS).select("series_id", "idx", "delta_p", "delta_q")
    made = step_features("delta_p", "delta_q")
    return rounded(s.withColumns(made), "delta_p", "delta_q", *made)


def channels(df):
    """The event signal with stand-ins for the meter's other channels."""
    return df.select("series_id", "idx", "p", "q", F.hypot("p", "q").alias("s"), (F.hypot("p", "q") / 230.0).alias("i"), F.abs("q").alias("thd_i"), (F.col("p") % 7).alias("thd_u"), F.try_divide(F.col("p"), F.hypot("p", "q")).alias("pf"), (F.lit(230.0) + F.col("q") / 100).alias("u"))


CHANNELS = "ch AS (SELECT series_id, idx, p, q, sqrt(p*p + q*q) AS s, sqrt(p*p + q*q) / 230.0 AS i, abs(q) AS thd_i, p % 7 AS thd_u, p / nullif(sqrt(p*p + q*q), 0) AS pf, 230.0 + q / 100 AS u FROM meter)"
FEATURE_RULES = regions.RegionRules(sps=1, baseline_s=3, k_noise=1.0, floor_w=3.0, min_on_s=3, max_gap_s=1, smooth_s=3)


def region_features(spark, sf_dir):
    m = staged(meter(spark, sf_dir), "meter")  # positions are counted once
    found = staged(features.cycles(regions.detect_regions(m, FEATURE_RULES)), "regions")
    out = features.region_features(found, channels(m))
    return rounded(out, *[c for c in features.FEATURES if c not in ("q_sign", "n_state_changes")])


def fingerprint(spark, sf_dir):
    m = staged(meter(spark, sf_dir), "meter")
    main = staged(regions.longest_regions(regions.detect_regions(m, FEATURE_RULES)), "regions")
    out = features.fingerprints(main, channels(m))
    return rounded(out, *[c for c, kind in out.dtypes if kind == "double"])


def band_check(spark, sf_dir):
    """Users as runs of seven devices; every seventh user is the real one."""
    m = meter(spark, sf_dir).where("idx >= 3").withColumn("u", F.col("series_id").cast("long"))
    rows = m.select("u", F.concat(F.lit("d"), F.col("u") % 3).alias("device"), F.explode(F.create_map(F.lit("p"), "p", F.lit("pf"), F.try_divide("p", F.hypot("p", "q")))).alias("feature", "value"))
    real = rows.where("u % 7 = 0")
    runs = rows.where("u % 7 <> 0").withColumnRenamed("u", "run")
    out = features.band_check(real, runs)
    return rounded(out, "real_mean", "real_std", "synth_mean_p05", "synth_mean_p95", "synth_std_p05", "synth_std_p95")


def settled_window(spark, sf_dir):
    out = windows.settled_windows(meter(spark, sf_dir), seconds=7200, share=0.2)
    return rounded(out.select("series_id", "idx", "p_std", "s_std", "settled"), "p_std", "s_std")


def downsample_stride(spark, sf_dir):
    return windows.every_nth(meter(spark, sf_dir).select("series_id", "idx", "p"), 20)


def segments_by_event(spark, sf_dir):
    m = meter(spark, sf_dir)
    found = steps.detect_steps(m, STEPS).select("series_id", "t_sec")
    return windows.segments(m.select("series_id", "idx", "t_sec"), found).drop("t_sec")


QUERIES = {
    "load_normalise": load_normalise, "resolve_sps": resolve_sps, "smooth_zero_pad": smooth_zero_pad, "rolling_noise": rolling_noise, "window_diff": window_diff,
    "regions_all": regions_all, "regions_longest": regions_longest, "detect_steps": detect_steps, "step_features": step_feature_rows, "region_features": region_features,
    "meter_files": meter_files, "fingerprint": fingerprint, "band_check": band_check, "settled_window": settled_window, "downsample_stride": downsample_stride, "segments_by_event": segments_by_event,
}

_REGION_COLS = "series_id, on_idx, off_idx, round(on_t, 6) + 0.0 AS on_t, round(off_t, 6) + 0.0 AS off_t, round(baseline_w, 6) + 0.0 AS baseline_w, sps"
_STEADY = """st AS (SELECT g.*, CASE WHEN on_idx + 1 < off_idx THEN on_idx + 1 ELSE on_idx END AS sf FROM {src} g),
ro AS (SELECT st.*, c.idx, c.p, c.q, c.s, c.i, c.thd_i, c.thd_u, c.pf, c.u, c.idx >= sf AS ok FROM st JOIN ch c ON c.series_id = st.series_id AND c.idx >= on_idx AND c.idx < off_idx)"""
ORACLE_SQL = {
    "meter_files": f"WITH {METER} SELECT 'user ' || series_id AS device_name, idx, round(t_sec, 6) + 0.0 AS t_sec, p, q FROM meter",
    "load_normalise": f"WITH {METER} SELECT series_id, idx, round(t_sec, 6) + 0.0 AS t_sec, p, q FROM meter",
    "resolve_sps": f"WITH {METER}, g AS (SELECT series_id, t_sec - lag(t_sec) OVER (PARTITION BY series_id ORDER BY idx) AS gap FROM meter) SELECT series_id, CAST(CASE WHEN count(gap) > 0 THEN greatest(1, round_even(1.0 / median(gap), 0)) ELSE 5 END AS INTEGER) AS sps FROM g GROUP BY series_id",
    "smooth_zero_pad": f"WITH {METER}, {SMOOTH} SELECT series_id, idx, {_r('ps', 'qs')} FROM sm",
    "rolling_noise": f"WITH {METER}, {SMOOTH}, {NOISE} SELECT series_id, idx, {_r('noise')} FROM no",
    "window_diff": f"WITH {METER}, {SMOOTH}, {NOISE}, {DIFF} SELECT series_id, idx, {_r('diff_p', 'diff_q', 'diff_noise')} FROM di",
    "regions_all": f"WITH {REGION_CTE} SELECT {_REGION_COLS} FROM regions",
    "regions_longest": f"WITH {REGION_CTE} SELECT {_REGION_COLS} FROM longest",
    "detect_steps": f"WITH {STEP_CTE} SELECT series_id, idx, {_r('t_sec', 'delta_p', 'delta_q', 'p_before', 'p_after')} FROM steps",
    "step_features": f"""WITH {STEP_CTE} SELECT series_id, idx, {_r('delta_p', 'delta_q')}, round(abs(delta_p), 6) + 0.0 AS abs_dp, round(abs(delta_q), 6) + 0.0 AS abs_dq,
  round(sqrt(delta_p * delta_p + delta_q * delta_q), 6) + 0.0 AS mag, round(atan2(delta_q, delta_p), 6) + 0.0 AS angle,
  round(CASE WHEN abs(delta_p) > 1e-6 THEN delta_q / delta_p ELSE 0 END, 6) + 0.0 AS qp_ratio FROM steps""",
    "region_features": f"""WITH {REGION_CTE}, {CHANNELS}, cy AS (SELECT * FROM regions WHERE off_t - on_t >= 4), {_STEADY.format(src='cy')},
su AS (SELECT series_id, on_idx, any_value(off_idx) AS off_idx, coalesce(avg(p) FILTER (ok), 0) AS p_mean, coalesce(avg(q) FILTER (ok), 0) AS q_mean, coalesce(avg(s) FILTER (ok), 0) AS s_mean,
  coalesce(avg(thd_i) FILTER (ok), 0) AS thd_i_mean, coalesce(avg(thd_u) FILTER (ok), 0) AS thd_u_mean, coalesce(stddev_pop(p) FILTER (ok), 0) AS p_std,
  max(p) FILTER (idx < on_idx + 1) AS inrush, max(i) FILTER (ok) AS i_max, avg(i) FILTER (ok) AS i_avg FROM ro GROUP BY series_id, on_idx),
rc AS (SELECT ro.series_id, ro.on_idx, min(idx) AS reached FROM ro JOIN su ON su.series_id = ro.series_id AND su.on_idx = ro.on_idx WHERE p >= 0.9 * p_mean GROUP BY ALL),
bl AS (SELECT series_id, on_idx, (idx - on_idx) // 2 AS block, avg(p) AS level FROM ro WHERE off_idx - on_idx >= 3 AND (idx - on_idx) // 2 < (off_idx - on_idx) // 2 GROUP BY ALL),
jl AS (SELECT *, lag(level) OVER (PARTITION BY series_id, on_idx ORDER BY block) AS was FROM bl),
ju AS (SELECT jl.series_id, jl.on_idx, count(*) FILTER (p_mean >= 1e-6 AND abs(level - was) > 0.25 * p_mean) AS n_state_changes FROM jl JOIN su ON su.series_id = jl.series_id AND su.on_idx = jl.on_idx GROUP BY ALL)
SELECT su.series_id, su.on_idx, {_r('p_mean', 'q_mean')}, CASE WHEN q_mean > 5 THEN 1 WHEN q_mean < -5 THEN -1 ELSE 0 END AS q_sign,
  round(CASE WHEN abs(p_mean) > 1e-6 THEN q_mean / p_mean ELSE 0 END, 6) + 0.0 AS qp_ratio, {_r('thd_i_mean')},
  round(CASE WHEN abs(p_mean) > 1e-6 THEN coalesce(inrush, p_mean) / p_mean ELSE 1 END, 6) + 0.0 AS inrush_ratio, {_r('p_std', 'thd_u_mean')},
  round(coalesce(reached - su.on_idx, 0), 6) + 0.0 AS settling_s, round(CASE WHEN i_avg > 1e-6 THEN i_max / i_avg ELSE 1 END, 6) + 0.0 AS crest_factor,
  coalesce(n_state_changes, 0) AS n_state_changes, {_r('s_mean')}
FROM su LEFT JOIN rc ON rc.series_id = su.series_id AND rc.on_idx = su.on_idx LEFT JOIN ju ON ju.series_id = su.series_id AND ju.on_idx = su.on_idx""",
    "fingerprint": f"""WITH {REGION_CTE}, {CHANNELS}, {_STEADY.format(src='longest')},
su AS (SELECT series_id, on_t, off_t, sps, coalesce(avg(p) FILTER (ok), 0) AS on_p_mean, coalesce(stddev_samp(p) FILTER (ok), 0) AS on_p_std, coalesce(avg(q) FILTER (ok), 0) AS on_q_mean,
  coalesce(stddev_samp(q) FILTER (ok), 0) AS on_q_std, coalesce(avg(pf) FILTER (ok), 0) AS on_pf_mean, coalesce(avg(thd_i) FILTER (ok), 0) AS on_thd_i_mean,
  coalesce(stddev_samp(thd_i) FILTER (ok), 0) AS on_thd_i_std, coalesce(avg(thd_u) FILTER (ok), 0) AS on_thd_u_mean, max(p) FILTER (idx < on_idx + 1) AS inrush FROM ro GROUP BY ALL),
ah AS (SELECT l.series_id, avg(p) AS off_p_mean, avg(q) AS off_q_mean FROM longest l JOIN ch c ON c.series_id = l.series_id AND c.idx < CASE WHEN on_idx > 5 THEN on_idx ELSE 5 END GROUP BY ALL),
vo AS (SELECT series_id, avg(u) AS voltage_mean FROM ch GROUP BY ALL)
SELECT series_id, {_r('on_t', 'off_t')}, sps, {_r('on_p_mean', 'on_p_std', 'on_q_mean', 'on_q_std', 'on_pf_mean', 'on_thd_i_mean', 'on_thd_i_std', 'on_thd_u_mean', 'off_p_mean', 'off_q_mean', 'voltage_mean')},
  round(CASE WHEN on_p_mean > 1 THEN inrush / on_p_mean ELSE 1 END, 6) + 0.0 AS inrush_ratio,
  CASE WHEN on_pf_mean > 0.97 AND on_thd_i_mean < 5 THEN 'resistive' WHEN on_thd_i_mean > 25 AND on_q_mean > 15 THEN 'non-linear + inductive' WHEN on_thd_i_mean > 25 AND on_q_mean < -15 THEN 'non-linear + capacitive/leading'
       WHEN on_thd_i_mean > 25 THEN 'non-linear' WHEN on_q_mean > 15 THEN 'inductive' WHEN on_q_mean < -15 THEN 'capacitive/leading' ELSE 'mostly resistive' END AS load_character
FROM su JOIN ah USING (series_id) JOIN vo USING (series_id)""",
    "band_check": f"""WITH {METER}, b AS (SELECT CAST(series_id AS BIGINT) AS u, p, p / nullif(sqrt(p*p + q*q), 0) AS pf FROM meter WHERE idx >= 3),
l AS (SELECT u, 'd' || u % 3 AS device, 'p' AS feature, p AS value FROM b UNION ALL SELECT u, 'd' || u % 3, 'pf', pf FROM b),
o AS (SELECT device, feature, avg(value) AS real_mean, stddev_pop(value) AS real_std FROM l WHERE u % 7 = 0 GROUP BY ALL HAVING count(value) >= 5),
e AS (SELECT device, feature, u, avg(value) AS m, stddev_samp(value) AS s FROM l WHERE u % 7 <> 0 GROUP BY ALL HAVING count(value) >= 5),
k AS (SELECT device, feature, CASE WHEN count(*) >= 20 THEN quantile_cont(m, 0.05) END AS a, CASE WHEN count(*) >= 20 THEN quantile_cont(m, 0.95) END AS b, CASE WHEN count(*) >= 20 THEN quantile_cont(s, 0.05) END AS c, CASE WHEN count(*) >= 20 THEN quantile_cont(s, 0.95) END AS d FROM e GROUP BY ALL)
SELECT device, feature, {_r('real_mean', 'real_std')}, round(a, 6) + 0.0 AS synth_mean_p05, round(b, 6) + 0.0 AS synth_mean_p95, round(c, 6) + 0.0 AS synth_std_p05, round(d, 6) + 0.0 AS synth_std_p95,
  coalesce(real_mean BETWEEN a AND b, false) AS mean_pass, coalesce(real_std BETWEEN c AND d, false) AS noise_pass, feature = 'pf' AS informational FROM o LEFT JOIN k USING (device, feature)""",
    "settled_window": f"""WITH {METER} SELECT series_id, idx, round(stddev_pop(p) OVER w, 6) + 0.0 AS p_std, round(stddev_pop(sqrt(p*p + q*q)) OVER w, 6) + 0.0 AS s_std,
  stddev_pop(p) OVER w <= greatest(1.5, 0.2 * greatest(abs(avg(p) OVER w), 1.0)) OR stddev_pop(sqrt(p*p + q*q)) OVER w <= greatest(1.5, 0.2 * greatest(abs(avg(sqrt(p*p + q*q)) OVER w), 1.0)) AS settled FROM meter
  WINDOW w AS (PARTITION BY series_id ORDER BY t_sec RANGE BETWEEN 7200 PRECEDING AND CURRENT ROW)""",
    "downsample_stride": f"WITH {METER} SELECT series_id, idx, p FROM meter JOIN len USING (series_id) WHERE idx % CAST(ceil(n / 20) AS BIGINT) = 0",
    "segments_by_event": f"WITH {STEP_CTE} SELECT m.series_id, m.idx, (SELECT count(*) FROM steps s WHERE s.series_id = m.series_id AND s.t_sec < m.t_sec) AS segment_no FROM meter m",
}
