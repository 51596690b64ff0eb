"""The engine's operators on small frames, against plain loops and hand-made cases."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlens import schema
from gridlens.functions import scalars
from gridlens.operators import calibration, evaluation, features, learning, matching, regions, steps, synthesis, tracker, windows
from gridlens.sources import meter, sinks, tail
from gridlens.streaming import live

SIGNAL = "series_id string, idx long, t_sec double, p double, q double, thd double"


def signal(spark, *series, sps=5):
    rows = [(str(k), i, i / sps, float(p), float(q), None if thd is None else float(thd)) for k, s in enumerate(series) for i, (p, q, thd) in enumerate(s)]
    return spark.createDataFrame(rows, SIGNAL).repartition(3)


def noisy(seed, *levels, noise=0.3):
    rng = np.random.default_rng(seed)
    return [(p + rng.normal(0, noise), q + rng.normal(0, noise / 2), None) for n, p, q in levels for _ in range(n)]


# ---- plain readings of the two detectors ----------------------------------------------------


def boxcar(x, w):
    return np.convolve(x, np.ones(w) / w, "same")


def plain_regions(p, r):
    n = max(3, r.rows(r.baseline_s))
    base, bar = np.median(p[:n]), max(r.k_noise * np.std(p[:n]), r.floor_w)
    above = np.flatnonzero(np.abs(boxcar(p, int(r.smooth_s * r.sps) | 1) - base) > bar)
    runs = []
    for i in above:
        if runs and i - runs[-1][1] <= r.rows(r.max_gap_s) + 1:
            runs[-1][1] = i
        else:
            runs.append([i, i])
    return [(a, b) for a, b in runs if b - a + 1 >= r.rows(r.min_on_s)]


def plain_steps(t, p, q, r):
    n, w = len(p), r.w
    width, k = int(r.smooth_s * r.sps) | 1, int(r.noise_s * r.sps)
    ps, qs = boxcar(p, width), boxcar(q, width)
    off, ahead = p - ps, (k - 1) // 2
    noise = np.array([np.std(off[max(0, i - (k - 1 - ahead)) : i + ahead + 1], ddof=1) for i in range(n)])
    d = np.zeros((2, n))
    for i in range(w, n - w):
        d[:, i] = ps[i : i + w].mean() - ps[i - w : i].mean(), qs[i : i + w].mean() - qs[i - w : i].mean()
    marked = [i for i in range(w, n - w) if abs(d[0, i]) >= max(r.floor_w, r.k_noise * noise[i] * math.sqrt(2 / w)) or abs(d[1, i]) >= r.q_floor]
    runs = []
    for i in marked:
        runs[-1].append(i) if runs and runs[-1][-1] == i - 1 else runs.append([i])
    out = []
    for run in runs:
        k = max(run, key=lambda i: (math.hypot(*d[:, i]), -i))
        pre, post = np.median(p[max(0, k - w) : k]), np.median(p[k : k + w])
        dp, dq = post - pre, np.median(q[k : k + w]) - np.median(q[max(0, k - w) : k])
        lasts = not (k + 2 * w <= n and abs(dp) > 1e-6 and abs(np.median(p[k + w : k + 2 * w]) - post) > r.sustain * abs(dp))
        on = k
        if abs(dp) > 1e-6:
            low = [m for m in range(max(0, k - 2 * w) + 1, k + 1) if (p[m] - pre) / dp < 0.5]
            on = max(low) if low else max(0, k - w)
        if lasts and (abs(dp) >= r.floor_w or abs(dq) >= r.q_floor):
            out.append((on, round(dp, 6), round(dq, 6)))
    return out


SERIES = [
    noisy(1, (60, 0, 0), (100, 60, 20), (40, 0, 0), (60, 60, 20), (60, 0, 0)),
    noisy(2, (30, 500, 3), (80, 0, 0), (90, 90, -30)),
    noisy(3, (50, 0, 0), (6, 80, 0), (120, 0, 0), (100, 0, 40), (60, 0, 0)),
    noisy(4, (200, 5, 5), noise=3.0),
    noisy(5, (60, -1, 0), (100, -30, -17), (100, 0, 0)),
    noisy(6, (12, 0, 0), (3, 9, 9)),
]


def test_regions_against_plain_loops(spark):
    rules = regions.RegionRules()
    out = sorted((int(r["series_id"]), r["on_idx"], r["off_idx"]) for r in regions.detect_regions(signal(spark, *SERIES), rules).collect())
    want = [(k, a, b) for k, s in enumerate(SERIES) for a, b in plain_regions(np.array([x[0] for x in s]), rules)]
    assert out == want and len(want) >= 4


def test_steps_against_plain_loops(spark):
    rules = steps.StepRules()
    out = sorted((int(r["series_id"]), r["idx"], round(r["delta_p"], 6), round(r["delta_q"], 6)) for r in steps.detect_steps(signal(spark, *SERIES), rules).collect())
    want = [(k, *x) for k, s in enumerate(SERIES) for x in plain_steps(None, np.array([x[0] for x in s]), np.array([x[1] for x in s]), rules)]
    assert out == want and len(want) >= 8


def test_chunks_do_not_change_windows(spark, monkeypatch):
    whole = steps.change_scores(signal(spark, *SERIES), steps.StepRules()).collect()
    monkeypatch.setattr(windows, "CHUNK_ROWS", 1)
    df = signal(spark, *SERIES)
    cut = windows.own_rows(windows.with_halo(df, 3, 3, rows=50).withColumn("ps", windows.smooth("p", 7)), rows=50).select("series_id", "idx", "ps").collect()
    one = windows.own_rows(windows.with_halo(df, 3, 3, rows=10**6).withColumn("ps", windows.smooth("p", 7)), rows=10**6).select("series_id", "idx", "ps").collect()
    key = lambda rows: {(r["series_id"], r["idx"]): round(r["ps"], 9) for r in rows}
    assert key(cut) == key(one) and len(cut) == sum(map(len, SERIES)) == len(whole)


def test_region_gap_and_length_limits(spark):
    rules = regions.RegionRules(sps=1, baseline_s=3, smooth_s=1, min_on_s=3, max_gap_s=2)
    flat = lambda bits: [(50.0 if b == "1" else 0.0, 0.0, None) for b in bits]
    series = [flat("0000111001110000"), flat("00001110001110000"), flat("00001100"), flat("000011100"), flat("11100000"), flat("0000111"), flat("00")]
    out = sorted((int(r["series_id"]), r["on_idx"], r["off_idx"]) for r in regions.detect_regions(signal(spark, *series, sps=1), rules).collect())
    assert out == [(0, 4, 11), (1, 4, 6), (1, 10, 12), (3, 4, 6), (4, 3, 7), (5, 4, 6)]
    main = {r["series_id"]: r["on_idx"] for r in regions.longest_regions(regions.detect_regions(signal(spark, *series, sps=1), rules)).collect()}
    assert main["1"] == 4  # of equal lengths the earliest


def test_empty_and_null_signals(spark):
    empty = spark.createDataFrame([], SIGNAL)
    assert regions.detect_regions(empty).count() == 0 and steps.detect_steps(empty).count() == 0
    nulls = spark.createDataFrame([("a", i, i / 5, None, None, None) for i in range(60)], SIGNAL)
    assert regions.detect_regions(nulls).count() == 0 and steps.detect_steps(nulls).count() == 0
    assert tracker.timelines(steps.detect_steps(empty), schema.devices(spark)).count() == 0


def test_distortion_after_a_step(spark):
    s = [(0.0, 0.0, None)] * 50 + [(100.0, 0.0, x) for x in [None, 5, 7, 9] * 15]
    out = steps.detect_steps(signal(spark, s)).collect()
    assert len(out) == 1 and out[0]["thd_i_after"] == pytest.approx(7.0)


def test_sample_rates_and_by_rate(spark):
    df = spark.createDataFrame([("a", i, i / 5, 0.0, 0.0, None) for i in range(9)] + [("b", i, i * 1.0, 0.0, 0.0, None) for i in range(9)] + [("c", 0, 0.0, 0.0, 0.0, None)], SIGNAL)
    rates = windows.sample_rates(df)
    assert {r["series_id"]: r["sps"] for r in rates.collect()} == {"a": 5, "b": 1, "c": 5}
    out = regions.by_rate(df, rates, lambda part, sps: part.groupBy("series_id").count().withColumn("sps", F.lit(sps)))
    assert {(r["series_id"], r["sps"]) for r in out.collect()} == {("a", 5), ("b", 1), ("c", 5)}


# ---- scalars --------------------------------------------------------------------------------


def test_names_and_characters(spark):
    row = spark.sql("SELECT ' Laptop_Ravi ' AS a, 'USB Ladegerät 6.3' AS b").select(scalars.clean_name("a"), scalars.slug("b")).first()
    assert tuple(row) == ("Laptop", "usb_ladegeraet_6p3")
    cases = [(0.99, 0.0, None, "resistive"), (0.99, 20.0, 30.0, "non-linear + inductive"), (0.5, -20.0, 6.0, "capacitive/leading"), (0.5, 0.0, 6.0, "mostly resistive"), (0.99, 20.0, 1.0, "resistive")]
    df = spark.createDataFrame(cases, "pf double, q double, thd double, want string").select(scalars.load_character("pf", "q", "thd").alias("got"), "want")
    assert all(r["got"] == r["want"] for r in df.collect())


def test_described_loads(spark):
    df = spark.createDataFrame([(1000.0, 5.0), (-60.0, -80.0), (10.0, -9.0), (0.0, 0.0)], "dp double, dq double").select(scalars.describe_load("dp", "dq").alias("d")).select("d.*")
    out = df.collect()
    assert [r["class"] for r in out] == ["resistive", "inductive", "capacitive", "none"]
    assert out[1]["s_va"] == 100.0 and out[1]["description"].startswith("About 100 VA at power factor 0.60. It draws current that lags") and out[3]["label"] == "No load"


def test_dashboard_value(spark):
    out = spark.sql("SELECT explode(array('1.005', 'x', 'NaN', null)) AS v").select(scalars.clean_value("v").alias("v")).collect()
    assert [r["v"] for r in out] == [1.0, 0.0, 0.0, 0.0]


# ---- matching -------------------------------------------------------------------------------


@pytest.mark.parametrize("case", [(0.1, 0.0, None, []), (709.0, 1.0, 2.3, ["Toaster"]), (32.9, 55.9, None, ["COOLER_FAN1"]), (16.3, 0.6, 165.5, ["Monitor"]), (30.4, -3.1, 155.5, ["USB Ladegerät"]), (991.5, 2.8, 2.4, ["Foen Stufe 3"]), (50.1, 79.5, None, ["COOLER_FAN1", "TABLE_FAN"])])
def test_standing_load_cases(spark, case):
    level = spark.createDataFrame([case[:3]], "P_now double, Q_now double, thd_now double")
    out = matching.standing_loads(level, schema.devices(spark)).first()
    assert out["best"] == case[3] and out["idle"] == (case[3] == [])


def test_match_ties_margins_and_unknowns(spark):
    twins = [(0, "a", 50.0, 0.0, None, None, False, False, None, None, None, None), (1, "b", 50.0, 0.0, None, None, False, False, None, None, None, None)]
    devs = schema.devices(spark, twins)
    st = spark.createDataFrame([(50.0, 0.0), (-100.0, 0.0), (400.0, 0.0)], "delta_p double, delta_q double")
    out = matching.match_steps(st, devs).collect()
    assert (out[0]["members"], out[1]["members"], out[1]["err"], out[2]["ok"]) == (["a"], ["a", "b"], 6.0, False)
    assert [r["nearest"]["device"] for r in matching.nearest_device(st, devs).collect()] == ["a", "a", "a"]
    assert [n["device"] for n in matching.nearest_known(st, devs).first()["nearest"]] == ["a", "b"]


def test_steps_that_begin_at_one_row_are_judged_together(spark, monkeypatch):
    from gridlens.plans import matching as plans

    st = spark.createDataFrame([("s", 43, 8.6, 13.85, -8.0), ("s", 43, 8.6, 15.38, 25.0), ("t", 43, 8.6, 709.0, 1.0)], "series_id string, idx long, t_sec double, delta_p double, delta_q double")
    monkeypatch.setattr(plans, "_steps", lambda spark, sf_dir: st)
    rows = lambda query, *cols: sorted(tuple(r[c] for c in cols) for r in query(spark, "").collect())
    assert rows(plans.nearest_device, "series_id", "idx", "device") == [("s", 43, "TABLE_FAN"), ("t", 43, "Toaster")]
    assert rows(plans.nearest_k, "series_id", "rank", "device")[:2] == [("s", 0, "TABLE_FAN"), ("s", 1, "Monitor")]
    assert rows(plans.match_combo, "series_id", "members", "ok") == [("s", "TABLE_FAN", True), ("t", "Toaster", True)]
    assert rows(plans.novel_steps, "series_id", "err", "novel") == [("s", 2.241093, False), ("t", 0.05, False)]


def test_too_many_combinations_are_refused(spark, monkeypatch):
    st = spark.createDataFrame([(50.0, 0.0)], "delta_p double, delta_q double")
    with pytest.raises(ValueError):
        matching.with_constant(st, matching.folded(schema.devices(spark), "devs", most=5))


def test_calibration_overlay(spark):
    known = schema.devices(spark, calibrated=False)
    measured = spark.createDataFrame([("Monitor", 20.0, 1.0, None), ("Zwei", 5.0, 2.0, "F"), ("Alpha", 6.0, 2.0, None)], "device string, P double, Q double, family string")
    out = {r["device"]: r for r in calibration.apply_calibration(known, measured).collect()}
    assert (out["Monitor"]["P"], out["Monitor"]["thd_i"], out["Monitor"]["calibrated"]) == (20.0, 165.5, True)
    assert (out["Alpha"]["ord"], out["Zwei"]["ord"], out["Zwei"]["family"]) == (14, 15, "F") and not out["Toaster"]["calibrated"] and out["PV"]["generator"]
    assert calibration.candidates(calibration.apply_calibration(known, measured)).count() == 3 and calibration.candidates(known).count() == 14
    assert calibration.onboard(known, "Neu", -10.0, -4.0).where("device = 'Neu'").first()["Q"] == 4.0


def test_calibration_of_steps_at_one_time(spark):
    st = lambda rows: spark.createDataFrame(rows, "series_id string, t_sec double, delta_p double, delta_q double").coalesce(1)
    order = spark.createDataFrame([("s", 1, "a"), ("s", 2, "b")], "series_id string, pos int, device string")
    rows = [("s", 1.0, 30.0, 2.0), ("s", 1.0, 20.0, 1.0), ("s", 2.0, -19.0, 0.0)]
    for given in (rows, rows[::-1]):
        assert {r["device"]: (r["P"], r["n_obs"]) for r in calibration.calibrate(st(given), order).collect()} == {"a": (19.5, 2), "b": (30.0, 1)}


def test_a_forest_in_parts_sums_its_trees(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "xyz"[i % 3], [float(v) for v in rng.normal(i % 3, 0.8, 4)]) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, label string, vector array<double>")
    made = learning.forest_in_parts(df, trees=8, depth=4, seed=0, part=3)
    assert [m.getNumTrees for m in made.model.models] == [3, 3, 2] and len({m.toDebugString for m in made.model.models}) == 3
    out = made.predict(df, with_shares=True).collect()
    assert all(math.isclose(sum(r["shares"]), 1.0) and r["confidence"] == max(r["shares"]) for r in out)
    assert sum(r["predicted"] == r["label"] for r in out) > 100


def test_a_forest_by_votes_is_that_of_its_parts_and_grows_few_trees_at_a_time(spark):
    for rows, trees in ((100, 300), (80_000, 300), (10_000_000, 3)):
        sizes, at_once = learning.forest_plan(rows, trees, 12)
        assert sum(sizes) == trees and (max(sizes) * at_once * rows <= learning.FOREST_ROWS or max(sizes) * at_once == 1)
    assert learning.forest_plan(1_000, 300, 12) == ([learning.FOREST_PART] * 12, 32)
    rng = np.random.default_rng(3)
    rows = [(i % 100, "xyz"[i % 3], [float(v) for v in rng.normal(i % 3, 0.8, 4)]) for i in range(150)]  # some ids twice
    df = spark.createDataFrame(rows, "id long, label string, vector array<double>")
    want = learning.forest_in_parts(df, trees=8, depth=4, seed=0, part=3).predict(df, with_shares=True).collect()
    votes, labels = learning.forest_votes(df, df, 8, 4, 0, most=12 * 150)
    got = {tuple(r["vector"]): r["votes"] for r in votes.collect()}
    assert labels == ["x", "y", "z"] and len(got) == 150
    assert all(math.isclose(v, 8 * s) for r in want for v, s in zip(got[tuple(r["vector"])], r["shares"]))


def test_plans_of_signals_spread_over_tasks(spark):
    made = synthesis.signal_plans(spark, schema.devices(spark), spark.range(40).coalesce(1), 7)
    assert made.rdd.getNumPartitions() > 4 and made.select("series_id").distinct().count() == 40

def test_runs_spread_over_tasks(spark):
    rules = {"on_p_mean": 50.0, "on_p_std": 1.0, "on_q_mean": 9.0, "on_q_std": 1.0, "on_thd_i_mean": 5.0, "on_thd_i_std": 1.0, "on_thd_u_mean": 0.0, "voltage_mean": 230.0, "inrush_ratio": 1.0}
    prints = spark.range(20).coalesce(1).select(F.col("id").cast("string").alias("device"), *[F.lit(v).alias(n) for n, v in rules.items()])
    made = synthesis.synthetic_runs(prints, 2, 7)
    assert made.rdd.getNumPartitions() > 4 and made.select("device", "run").distinct().count() == 40


def test_summed_signals_stay_where_their_plans_were_dealt(spark):
    one = spark.range(40).coalesce(1).select(F.col("id").cast("string").alias("series_id"), F.lit(30).alias("total"), F.lit(3).alias("ord"), F.lit("Monitor").alias("device"), F.lit(5).alias("on_idx"), F.lit(20).alias("off_idx"))
    plan = synthesis.spread(one, "series_id", rows=2)
    shares = plan.select("series_id", F.explode(F.sequence("on_idx", F.col("off_idx") - 1)).alias("idx"), F.lit(2.0).alias("p"), F.lit(1.0).alias("q"), F.lit(5.0).alias("thd"), F.lit(1.0).alias("i"))
    sig, sets = synthesis.summed(plan, shares), synthesis.active_sets(plan)
    for made in (sig, sets):
        text = made._jdf.queryExecution().executedPlan().toString()
        assert text.count("Exchange") == text.count("REPARTITION_BY_NUM") > 0
        assert made.rdd.getNumPartitions() >= 20 and made.count() == 40 * 30
    assert [tuple(r) for r in sig.groupBy("n", "p", "thd").count().orderBy("p").collect()] == [(30, 0.0, None, 600), (30, 2.0, 5.0, 600)]
    assert sets.where(F.size("active") > 0).count() == 600

def test_sets_at_their_changes_tell_the_set_at_any_time(spark):
    runs = [("a", 12, "x", 0, 5), ("a", 12, "y", 3, 9), ("a", 12, "x", 5, 7), ("a", 12, None, 2, 4), ("b", 9, "x", 4, 20), ("c", 7, "y", None, None)]
    plan = spark.createDataFrame(runs, "series_id string, total int, device string, on_idx int, off_idx int")
    few, every = synthesis.active_sets(plan, changes=True), synthesis.active_sets(plan)
    assert every.count() == 12 + 9 + 7 and few.groupBy("series_id").count().orderBy("series_id").collect() == [("a", 7), ("b", 2), ("c", 1)]
    checks = plan.select("series_id").distinct().withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(30)))).withColumn("t", F.col("t") / 10)
    told = [sorted(map(tuple, evaluation.active_at(checks, sets).select("series_id", "t", "active").collect())) for sets in (few, every)]
    assert told[0] == told[1] and len(told[0]) == 3 * 31 and ("a", 0.6, ["x", "y"]) in told[0]


def test_truth_at_checks_is_made_at_changes_only(spark, sf_dir, monkeypatch):
    from gridlens.plans import matching as plans

    made, active_at = [], evaluation.active_at
    monkeypatch.setattr(evaluation, "active_at", lambda checks, active: made.append(active.count()) or active_at(checks, active))
    assert plans.jaccard_eval(spark, sf_dir).count() == 1
    signals = spark.read.parquet(f"{sf_dir}/supplier.parquet").count()
    assert len(made) == 2 and max(made) <= 7 * signals


def test_matches_and_timelines_spread_over_tasks(spark):
    found = spark.range(40).coalesce(1).select(F.col("id").cast("string").alias("series_id"), F.lit(1).alias("no"), F.lit(3.0).alias("t_sec"), F.lit(16.0).alias("delta_p"), F.lit(0.6).alias("delta_q"))
    matches, timeline = evaluation.match_to_truth(found, found), tracker.timelines(found, schema.devices(spark))
    for made in (matches, timeline):
        assert made.rdd.getNumPartitions() >= 16 and made.select("series_id").distinct().count() == 40


def test_silhouettes_of_many_blocks(monkeypatch):
    import numpy as np
    import pandas as pd

    assert learning.silhouette_blocks(120_000, 10, 12) == learning.silhouette_blocks(600_000, 10, 12) == 10
    monkeypatch.setattr(learning, "BLOCK", 3)
    rows = pd.DataFrame({"id": range(11), "label": [0, 1, 2, 0, 1, 2, 0, 1, 2, 0, 7], "vector": [[float(i * i % 7), float(i)] for i in range(11)]})
    both = pd.concat([learning._label_sums(rows[:4]), learning._label_sums(rows[4:]), learning._label_sums(rows[:4], rows[4:].reset_index(drop=True))])
    got = both.groupby(["id", "other"])["total"].sum()
    v = np.array(rows["vector"].tolist())
    far = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
    for (i, label), total in got.items():
        assert abs(total - far[i, rows["label"] == label].sum()) < 1e-9
    assert len(got) == 11 * 4

def test_recordings_open_their_files_once(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.csv").write_text("timestamp_iso,device_name,p_total_w\n2024-01-01T00:00:00,Lamp,5\n2024-01-01T00:00:01,Lamp,6\n")
    made = meter.read_recordings(spark, f"{tmp_path}/*.csv")
    assert made.count() == 4 and "Format: Text" not in made._jdf.queryExecution().executedPlan().toString()


# ---- tracker --------------------------------------------------------------------------------


def run(spark, *moves):
    st = spark.createDataFrame([("s", float(i), float(dp), float(dq)) for i, (dp, dq) in enumerate(moves)], "series_id string, t_sec double, delta_p double, delta_q double")
    return [(r["active"], r["unknown_residual"]) for r in tracker.timelines(st, schema.devices(spark)).orderBy("step_no").collect()]


def test_tracker_on_off_and_unknown(spark):
    out = run(spark, (709, 1), (16.3, 0.6), (-709, -1), (4000, 0), (-16.3, -0.6), (-50, 0), (0, 0))
    assert [a for a, _ in out[:5]] == [["Toaster"], ["Monitor", "Toaster"], ["Monitor"], ["Monitor"], []]
    assert out[3][1] > 10 and out[5] == ([], None)


def test_tracker_transitions_and_families(spark):
    assert [a for a, _ in run(spark, (197.1, -0.2), (794.4, 3.0), (-991.5, -2.8))] == [["Foen Stufe 1"], ["Foen Stufe 3"], []]
    assert [a for a, _ in run(spark, (22.34, 36.02), (32.93, 55.87))] == [["COOLER_FAN1 Stufe 1"], ["COOLER_FAN1"]]


def test_tracker_generator_and_variable_load(spark):
    assert [a for a, _ in run(spark, (-20, -17.3), (20, 17.3))] == [["PV"], []]
    assert [a for a, _ in run(spark, (30.4, -3.1), (-12.0, 3.0))] == [["USB Ladegerät"], []]


def test_tracker_helpers(spark):
    site = tracker.site_of(schema.devices(spark))
    assert tracker.explain(site, [site.named["Toaster"], site.named["WATER_HEATER"]], 709.0, 1.0, True, classify=lambda p, q: "WATER_HEATER") == ({"Toaster"}, None)
    tl = tracker.timelines(spark.createDataFrame([("s", 1.0, 709.0, 1.0), ("s", 5.0, -709.0, -1.0), ("s", 9.0, 709.0, 1.0)], "series_id string, t_sec double, delta_p double, delta_q double"), schema.devices(spark))
    assert sorted((r["from_t"], r["to_t"]) for r in tracker.intervals(tl).collect()) == [(1.0, 5.0), (9.0, None)]


# ---- evaluation -----------------------------------------------------------------------------


def test_greedy_match_excludes_in_order(spark):
    kind = "series_id string, no int, t_sec double, delta_p double"
    found = spark.createDataFrame([("a", 1, 10.0, 5.0), ("a", 2, 10.5, 5.0), ("a", 3, 30.0, -5.0), ("b", 1, 1.0, 1.0)], kind)
    truth = spark.createDataFrame([("a", 1, 9.0, 5.0), ("a", 2, 11.0, 5.0), ("a", 3, 30.0, 5.0), ("a", 4, 33.0, -5.0)], kind)
    out = evaluation.match_to_truth(found, truth)
    assert sorted((r["detected_no"], r["truth_no"]) for r in out.collect()) == [(1, 1), (2, 2)]
    pr = evaluation.precision_recall(out, found, truth).first()
    assert (pr["precision"], pr["recall"]) == (0.5, 0.5)


def test_asof_edges(spark):
    active = spark.createDataFrame([("a", 1.0, ["x"]), ("a", 2.0, ["y"])], "series_id string, t double, active array<string>")
    checks = spark.createDataFrame([("a", 0.0), ("a", 1.0), ("a", 1.5), ("a", 9.0)], "series_id string, t double")
    assert {r["t"]: r["active"] for r in evaluation.active_at(checks, active).collect()} == {0.0: ["x"], 1.0: ["x"], 1.5: ["y"], 9.0: ["y"]}
    tl = spark.createDataFrame([("a", 1, 1.0, ["x"]), ("a", 2, 2.0, ["y"])], "series_id string, step_no int, t_sec double, active array<string>")
    assert {r["t"]: r["predicted"] for r in evaluation.predicted_at(checks, tl).collect()} == {0.0: [], 1.0: ["x"], 1.5: ["y"], 9.0: ["y"]}


def test_cluster_scores_by_hand(spark):
    df = spark.createDataFrame([("a", 0), ("a", 0), ("b", 1), ("b", 1), ("b", 0)], "label string, cluster int")
    assert evaluation.purity(df, "label", "cluster").first()[0] == pytest.approx(0.8)
    assert evaluation.adjusted_rand(df.withColumn("cluster", F.col("label")), "label", "cluster").first()[0] == 1.0
    wide = evaluation.confusion(df.withColumn("cluster", F.col("cluster").cast("string")), "label", "cluster", ["0", "1"]).orderBy("label").collect()
    assert [tuple(r) for r in wide] == [("a", 2, 0), ("b", 1, 2)]


def test_band_needs_twenty_runs(spark):
    real = spark.createDataFrame([("d", "p", float(x)) for x in range(5)] + [("e", "p", 1.0)] * 4, "device string, feature string, value double")
    runs = lambda n: spark.createDataFrame([("d", r, "p", x + r / 100) for r in range(n) for x in range(5)], "device string, run int, feature string, value double")
    assert [(r["device"], r["mean_pass"]) for r in features.band_check(real, runs(20)).collect()] == [("d", False)]
    mid = real.withColumn("value", F.col("value") + 0.1)
    assert features.band_check(mid, runs(20)).first()["mean_pass"] and not features.band_check(mid, runs(19)).first()["mean_pass"]
    assert features.pass_counts(features.band_check(mid, runs(20))).first()["mean_passes"] == 1


# ---- learning -------------------------------------------------------------------------------


def blobs(spark, n=90):
    rng = np.random.default_rng(0)
    return spark.createDataFrame([(i, "abc"[i % 3], (rng.normal(size=4) + 8 * np.eye(4)[i % 3]).tolist()) for i in range(n)], "id long, label string, vector array<double>")


def test_learners_on_separate_blobs(spark, monkeypatch):
    df = learning.scaled(blobs(spark))
    monkeypatch.setattr(learning, "BLOCK", 20)
    train, test = df.where("id % 5 <> 0"), df.where("id % 5 = 0")
    assert evaluation.accuracy(learning.knn_classify(test, train).join(test, "id"), "label", "predicted").first()["accuracy"] == 1.0
    assert evaluation.accuracy(learning.random_forest(train, test, trees=10, depth=5), "label", "predicted").first()["accuracy"] == 1.0
    assert evaluation.accuracy(learning.logistic(train, test, rounds=50), "label", "predicted").first()["accuracy"] == 1.0
    assert evaluation.purity(learning.kmeans(df, 3, starts=2), "label", "cluster").first()[0] == 1.0
    assert learning.silhouettes(df).agg(F.avg("silhouette")).first()[0] > 0.5
    assert max(learning.silhouette_curve(df, range(2, 5)), key=lambda x: x[1])[0] == 3
    assert [r["feature"] for r in learning.importances(train, list("wxyz"), trees=10).collect()][-1] == "z"
    heights = [r["height"] for r in learning.ward_merges(df).orderBy("step").collect()]
    assert heights == sorted(heights) and heights[-2] > 2 * heights[-3]
    pc = learning.principal(df).first()
    assert len(pc["components"]) == 2 and sum(pc["explained"]) > 0.7


def test_novelty(spark):
    means = learning.label_means(blobs(spark))
    near = spark.createDataFrame([(1, [8.0, 0.0, 0.0, 0.0]), (2, [0.0, 0.0, 0.0, 500.0])], "id long, vector array<double>")
    assert {r["id"]: r["novel"] for r in learning.novel_rows(near, means).collect()} == {1: False, 2: True}


# ---- synthesis ------------------------------------------------------------------------------


def test_synthesis_end_to_end(spark):
    devs = schema.devices(spark).where("ord IN (4, 5, 7, 8)")
    plan = synthesis.signal_plans(spark, devs, 6, seed=3).persist()
    assert {tuple(r) for r in plan.collect()} == {tuple(r) for r in synthesis.signal_plans(spark, devs, 6, seed=3).repartition(2).collect()}
    sig = synthesis.summed(plan, synthesis.device_shares(plan, devs, seed=3))
    truth = synthesis.active_sets(plan)
    checks = synthesis.truth_events(plan, devs).select("series_id", F.col("t_sec").alias("t")).distinct()
    tl = tracker.timelines(steps.detect_steps(sig), devs)
    both = evaluation.active_at(checks.withColumn("t", F.col("t") + 0.5), truth).withColumn("t", F.round(F.col("t") - 0.5, 3)).join(evaluation.predicted_at(checks.withColumn("t", F.col("t") + 0.6), tl).withColumn("t", F.round(F.col("t") - 0.6, 3)), ["series_id", "t"])
    assert evaluation.set_scores(both).first()["jaccard"] > 0.7


def test_synthetic_runs(spark):
    fp = spark.createDataFrame([("Mixer", 300.0, 3.0, 10.0, 1.0, 20.0, 1.0, 1.7, 231.0, 3.7), ("Lamp", 40.0, 1.0, 50.0, 1.0, 9.0, 1.0, 0.0, 230.0, 1.2)], "device string, on_p_mean double, on_p_std double, on_q_mean double, on_q_std double, on_thd_i_mean double, on_thd_i_std double, on_thd_u_mean double, voltage_mean double, inrush_ratio double")
    runs = synthesis.synthetic_runs(fp, 3, 7).persist()
    assert runs.select("device", "run").distinct().count() == 6 and runs.where("p = 0 AND pf IS NOT NULL").count() == 0
    assert {r["n_samples"] for r in synthesis.manifest(runs, 7).collect()} <= set(range(340, 560))
    again = synthesis.synthetic_runs(fp.repartition(2), 3, 7)
    assert runs.agg(F.sum("p")).first()[0] == pytest.approx(again.agg(F.sum("p")).first()[0])


# ---- sources and sinks ----------------------------------------------------------------------

HEAD = "timestamp_iso, device_name ,p_total_w,q_total_var,thd_i_l1_percent,extra"


def test_recordings(spark, tmp_path):
    (tmp_path / "a.csv").write_text(f"{HEAD}\n\n2024-01-01T00:00:01.000Z,,2.5,x,,1\n\n2024-01-01T00:00:00.000Z, Laptop_Ravi,1.5,0.5,NaN,1\nbad,,3,3,3,1\n2024-01-01T00:00:02.000Z,Other,,1,1,1\n2024-01-01T00:00:01.000Z,,7,7,7,7\n")
    (tmp_path / "b.csv").write_text("timestamp_iso,p_total_w\n2024-01-01T00:00:01.000Z,1\n")
    (tmp_path / "c.csv").write_text("device_name,timestamp_iso,p_total_w\nPV,2024-01-01T00:00:01Z,-3\n")
    (tmp_path / "d.csv").write_text("device_name,timestamp_iso,p_total_w\nLaptop,2024-01-01T00:00:01Z,9\n")
    df = meter.read_recordings(spark, f"{tmp_path}/*.csv")
    assert df.columns == [c.split()[0] for c in schema.METER_SCHEMA.split(", ")]
    a = df.where(F.col("series_id").endswith("a.csv")).orderBy("idx").collect()
    assert [(r["idx"], r["t_sec"], r["p_total_w"], r["q_total_var"], r["thd_i_l1_percent"], r["device_name"]) for r in a] == [(0, 0.0, 1.5, 0.5, None, "Laptop"), (1, 1.0, 2.5, None, None, "Laptop"), (2, 1.0, 7.0, 7.0, 7.0, "Laptop")]
    assert [(r["device"], r["path"][-5:]) for r in meter.discover(spark, f"{tmp_path}/*.csv").collect()] == [("Laptop", "d.csv")]
    assert meter.discover(spark, f"{tmp_path}/*.csv", include_excluded=True).count() == 2
    assert meter.read_plain(spark, f"{tmp_path}/a.csv").count() == 2 and meter.signal(df).count() == 5
    sinks.write_recordings(df, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").where("device_slug = 'pv'").count() == 1


def test_quoted_fields_bad_powers_and_discovery(spark, tmp_path):
    (tmp_path / "a.csv").write_text('device_name,run_id,"timestamp_iso",p_total_w\n"Fan, big","say ""x""",2024-01-01T00:00:05Z,3\nLater,r,2024-01-01T00:00:01Z,oops\n,r,2024-01-01T00:00:09Z,NaN\n')
    rows = meter.read_recordings(spark, f"{tmp_path}/a.csv").orderBy("idx").collect()
    assert [(r["p_total_w"], r["run_id"], r["device_name"]) for r in rows] == [(None, "r", "Later"), (3.0, 'say "x"', "Later")]
    (tmp_path / "b.csv").write_text("device_name,x\nLamp,1\n")  # no power, yet a name
    assert {r["device"] for r in meter.discover(spark, f"{tmp_path}/*.csv").collect()} == {"Fan, big", "Lamp"}
    runs = tmp_path / "synth" / "training"
    runs.mkdir(parents=True)
    for name in ("pac4200_table_fan_train_002.csv", "pac4200_table_fan_train_001.csv", "pac4200_monitor_train_001.csv", "pac4200_other_train_001.csv", "pac4200_monitor_test_001.csv"):
        (runs / name).write_text("x\n")
    found = meter.find_runs(spark, str(tmp_path / "synth"), ["TABLE FAN", "Monitor"], per_device=1).collect()
    assert sorted((r["device"], r["path"].rsplit("/")[-1]) for r in found) == [("Monitor", "pac4200_monitor_train_001.csv"), ("TABLE FAN", "pac4200_table_fan_train_001.csv")]


def test_tail_header_holds_over_batches(tmp_path):
    path = tmp_path / "live.csv"
    path.write_text("timestamp_iso,p_total_w\n2024-01-01T00:00:00Z,1\np_total_w,timestamp_iso\n")
    reader = tail.TailReader({"path": str(path), "startingOffset": "earliest"})
    got, at = reader.read(reader.initialOffset())
    with path.open("a") as f:
        f.write("7,2024-01-01T00:00:02Z\n")
    more, end = reader.read(at)
    assert [r[5] for r in got] == [1.0] and [r[5] for r in more] == [7.0] == [r[5] for r in reader.readBetweenOffsets(at, end)]
    assert tail.read_from(str(path), 0, 5)[0][0] == "timestamp_iso,p_total_w"


def test_step_forest_and_false_alarms(spark, tmp_path):
    from pyspark.ml.classification import RandomForestClassificationModel

    labelled = spark.createDataFrame([(d, p + i / 10, q + i / 20) for d, p, q in (("A", 700.0, 2.0), ("B", 30.0, 50.0)) for i in range(20)], "label string, delta_p double, delta_q double")
    forest = learning.step_forest(labelled, trees=5, depth=4)
    forest.save(f"{tmp_path}/forest")
    again = learning.Fitted.load(f"{tmp_path}/forest", RandomForestClassificationModel)
    found = spark.createDataFrame([("s", 1.0, 701.0, 2.0), ("s", 2.0, -31.0, -50.0)], "series_id string, t_sec double, delta_p double, delta_q double")
    assert [r["said"] for r in learning.with_said(found, again).orderBy("t_sec").collect()] == ["A", "B"]
    new = learning.onboarded(labelled, "C", -250.0, 180.0)
    assert learning.with_said(spark.createDataFrame([("s", 1.0, 250.0, -180.0)], found.schema), new).first()["said"] == "C"
    devs = spark.createDataFrame([(*r[:2], 700.0, 1.0, *r[4:], True) for r in schema.DEVICES if r[0] in (7, 8)], schema.DEVICE_SCHEMA)
    step = spark.createDataFrame([("s", 1.0, 700.0, 1.0, "Toaster")], "series_id string, t_sec double, delta_p double, delta_q double, said string")
    assert tracker.timelines(step, devs).first()["active"] == ["Toaster"]  # a near-tie goes by the classifier
    alarms = learning.false_alarms(learning.label_means(blobs(spark)), repeats=20).collect()
    assert all(r["n"] == 20 and r["alarms"] == 0 for r in alarms)


def test_positions_over_days(spark):
    rows = [("a", f"2024-01-0{1 + i // 3}T0{i % 3}:00:00") for i in range(9)]
    df = spark.createDataFrame(rows, "series_id string, ts string").withColumn("ts", F.col("ts").cast("timestamp")).repartition(4)
    out = meter.with_position(df, "ts").orderBy("ts").collect()
    assert [r["idx"] for r in out] == list(range(9)) and out[3]["t_sec"] == 86400.0


def test_json_maps_runs_and_reports(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"Ü": {"P": 1.5, "p_range": [1, 2]}, "B": {"P": 2}}))
    table = meter.read_json_map(spark, f"{tmp_path}/m.json", "P DOUBLE, p_range ARRAY<DOUBLE>")
    assert {r["device"]: r["P"] for r in table.collect()} == {"Ü": 1.5, "B": 2.0}
    sinks.write_json_map(table, f"{tmp_path}/out.json")
    assert meter.read_json_map(spark, f"{tmp_path}/out.json", "P DOUBLE, p_range ARRAY<DOUBLE>").count() == 2
    sinks.write_summary(table.drop("p_range"), f"{tmp_path}/s.csv", F.desc("P"))
    assert [r["device"] for r in spark.read.option("header", True).csv(f"{tmp_path}/s.csv").collect()] == ["B", "Ü"]
    files = spark.createDataFrame([("d", f"{i}") for i in range(4)], "device string, path string")
    assert [r["path"] for r in meter.run_files(files, 2).orderBy("path").collect()] == ["0", "1"]


def test_tail_parsing(tmp_path):
    rows, head = tail.parse_lines(["a,timestamp_iso", "1,x", "1,2,3", "timestamp_iso,b", "y,2"], ["z"])
    assert rows == [{"a": "1", "timestamp_iso": "x"}, {"timestamp_iso": "y", "b": "2"}] and head == ["timestamp_iso", "b"]
    path = tmp_path / "live.csv"
    path.write_text("timestamp_iso,p_total_w\n2024-01-01T00:00:00Z,1\n2024-01-01T00:00:01Z,2")
    reader = tail.TailReader({"path": str(path), "startingOffset": "earliest"})
    got, at = reader.read(reader.initialOffset())
    assert [r[5] for r in got] == [1.0]
    with path.open("a") as f:
        f.write("5\n")
    got, at2 = reader.read(at)
    assert [r[5] for r in got] == [25.0] and [r[5] for r in reader.readBetweenOffsets(at, at2)] == [25.0]
    path.write_text("timestamp_iso,p_total_w\n2024-01-01T00:00:09Z,3\n")
    got, at3 = reader.read(at2)
    assert [(r[1], r[5]) for r in got] == [(1, 3.0)] and at3["session"] == 1


def test_tail_stream(spark, tmp_path):
    path = tmp_path / "live.csv"
    path.write_text("timestamp_iso,p_total_w\n" + "".join(f"2024-01-01T00:00:0{i}Z,{i}\n" for i in range(5)))
    spark.dataSource.register(tail.MeterTail)
    stream = spark.readStream.format("meter_tail").option("path", str(path)).option("startingOffset", "earliest").load()
    query = stream.writeStream.format("memory").queryName("tailed").start()
    try:
        for _ in range(60):
            query.processAllAvailable() if query.isActive else None
            if spark.table("tailed").count() == 5:
                break
        assert {r["p_total_w"] for r in spark.table("tailed").collect()} == {0.0, 1.0, 2.0, 3.0, 4.0}
    finally:
        query.stop()


# ---- streaming ------------------------------------------------------------------------------


def test_live_equals_batch_on_clean_signals(spark, tmp_path):
    clean = [noisy(7, (70, 0, 0), (100, 709, 1), (120, 725, 1.6), (110, 16, 0.6), (80, 0, 0)), noisy(8, (90, 33, 56), (160, 742, 57), (160, 33, 56))]
    df = signal(spark, *clean)
    session = live.Live(spark, f"{tmp_path}/live", schema.devices(spark))
    live.replay(df, session, batches=6)
    got = sorted((r["series_id"], r["t_sec"], r["delta_p"]) for r in session.steps().collect())
    want = sorted((r["series_id"], r["t_sec"], r["delta_p"]) for r in steps.detect_steps(df).collect())
    assert len(got) == len(want)
    assert all(a[0] == b[0] and abs(a[1] - b[1]) <= 3 and abs(a[2] - b[2]) < 2 for a, b in zip(got, want))
    last = {r["series_id"]: (r["active"], r["stale"]) for r in session.latest(5, now=1e9).collect()}
    assert last == {"0": ([], True), "1": (["COOLER_FAN1"], True)}  # series 1 began with a standing load
    assert ("1", "Toaster", "on") in {(r["series_id"], r["device"], r["kind"]) for r in session.events().collect()}


def test_live_waits_for_enough_rows(spark):
    rules = live.LiveRules()
    assert rules.least_rows == 50
    rows = signal(spark, noisy(7, (24, 0, 0), (25, 700, 0))).drop("idx")
    found, buffer, pointer = live.advance_steps(rows, live.empty_state(spark), rules)
    assert found.count() == 0 and buffer.count() == 49 and pointer.first()["finalized"] is None


def test_live_on_a_file_stream(spark, tmp_path):
    df = signal(spark, noisy(7, (70, 0, 0), (100, 709, 1), (90, 0, 0))).drop("idx")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    session = live.Live(spark, f"{tmp_path}/live", schema.devices(spark))
    query = session.start(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/cp", availableNow=True)
    query.awaitTermination(120)
    assert [round(r["delta_p"], -1) for r in session.steps().orderBy("t_sec").collect()] == [710.0, -710.0]
