"""Keyed live state, its detector, and the replay source."""

import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlens import schema
from gridlens.operators import buffered, learning, steps, tracker, windows
from gridlens.sources import replay
from gridlens.streaming import keyed


def levels(seed, *parts, noise=0.3):
    """(p, q, thd) rows of a signal with levels (rows, p, q)."""
    rng = random.Random(seed)
    return [(p + rng.gauss(0, noise), q + rng.gauss(0, noise), rng.choice([None, 5.0 + rng.random()])) for n, p, q in parts for _ in range(n)]


def frame(spark, named):
    rows = [(name, i, i / 5, *r) for name, signal in named.items() for i, r in enumerate(signal)]
    return spark.createDataFrame(rows, schema.SIGNAL_SCHEMA)


SIGNALS = {
    "a": levels(1, (70, 0, 0), (100, 709, 1), (120, 725, 1.6), (110, 16, 0.6), (80, 0, 0)),
    "b": levels(2, (90, 33, 56), (160, 742, 57), (160, 33, 56), noise=2.0),
    "c": levels(3, (60, 0, 0), (8, 300, 0), (60, 0, 0), (3, 900, 0), (60, 0, 0), (50, 0, 30)),
    "d": levels(4, (31, 5, 5)),
    "e": levels(5, (200, 100, 0), noise=40.0),
}


def test_buffer_steps_are_those_of_the_batch(spark):
    want = sorted((r["series_id"], *(None if r[c] is None else round(r[c], 6) for c in ("t_sec", "delta_p", "delta_q", "p_before", "p_after", "thd_i_after"))) for r in steps.detect_steps(frame(spark, SIGNALS)).collect())
    got = []
    for name, signal in SIGNALS.items():
        p, q, thd = (np.array([np.nan if v is None else v for v in col], float) for col in zip(*signal))
        got += [(name, *(None if v is None else round(v, 6) for v in s)) for s in buffered.buffer_steps(np.arange(len(p)) / 5, p, q, thd)]
    assert len(want) > 8 and sorted(got) == want


def test_first_level_is_the_settled_window_of_the_batch(spark):
    df = frame(spark, SIGNALS)
    rows = windows.settled_windows(df, 5).collect()
    for name, signal in SIGNALS.items():
        p, q, thd = (np.array([np.nan if v is None else v for v in col], float) for col in zip(*signal))
        at = min((r["t_sec"] for r in rows if r["series_id"] == name and r["settled"] and 5 <= r["t_sec"] <= 25), default=None)
        got = buffered.first_level(np.arange(len(p)) / 5, p, q, thd, 0.0, 5.0, 25.0)
        assert (got and got[0]) == at
    assert buffered.first_level(*np.zeros((4, 0)), 0.0, 5.0, 25.0) is None and buffered.buffer_steps(*np.zeros((4, 0))) == []


def stream_of(spark, rows, path, **options):
    replay.write_replay(rows, f"{path}/replay", buckets=3, chunk_s=25.0)
    spark.dataSource.register(replay.Replay)
    return spark.readStream.format("replay").options(path=f"{path}/replay", progress=f"{path}/progress", batchSeconds=10, drainSeconds=30, **options).load()


def test_keyed_steps_equal_the_batch_on_clean_signals(spark, tmp_path):
    df = frame(spark, {k: SIGNALS[k] for k in "ab"}).drop("idx")
    found = keyed.run_to_table(keyed.detected(stream_of(spark, df, tmp_path)), str(tmp_path), 3)
    got = sorted((r["series_id"], r["t_sec"], r["delta_p"]) for r in found.where("kind = 'step'").collect())
    want = sorted((r["series_id"], r["t_sec"], r["delta_p"]) for r in steps.detect_steps(frame(spark, {k: SIGNALS[k] for k in "ab"})).collect())
    assert len(got) == len(want) and all(a[0] == b[0] and abs(a[1] - b[1]) <= 3 and abs(a[2] - b[2]) < 2 for a, b in zip(got, want))
    assert sorted((r["series_id"], r["n"]) for r in found.where("kind = 'stale'").collect()) == [("a", 0), ("b", 0)]
    assert {r["series_id"] for r in found.where("kind = 'level'").collect()} == {"a", "b"}


def test_tracker_begins_with_the_standing_load_and_tells_changes(spark, tmp_path):
    df = frame(spark, {k: SIGNALS[k] for k in "ab"}).drop("idx")
    rows = keyed.run_to_table(keyed.tracked(keyed.detected(stream_of(spark, df, tmp_path)), schema.devices(spark)), str(tmp_path), 3)
    own = {(r["series_id"], r["kind"], r["step_no"]): (r["was"], r["active"]) for r in rows.collect()}
    assert own["b", "seed", 0] == ([], ["COOLER_FAN1"]) and own["b", "step", 1] == (["COOLER_FAN1"], ["COOLER_FAN1", "Toaster"]) and own["b", "step", 2][1] == ["COOLER_FAN1"]
    assert own["a", "seed", 0][1] == []
    events = {(r["series_id"], r["device"], r["kind"]) for r in keyed.switched(rows.where("kind = 'step'")).collect()}
    assert {("a", "Toaster", "on"), ("a", "Toaster", "off"), ("b", "Toaster", "on")} <= events


def test_a_forest_settles_near_ties_in_the_stream(spark, tmp_path):
    two = [(0, "ONE", 100.0, 0.0), (1, "TWO", 100.5, 0.0)]
    devices = spark.createDataFrame([(o, d, p, q, None, None, False, False, None, None, None, None, True) for o, d, p, q in two], schema.DEVICE_SCHEMA)
    df = frame(spark, {"x": levels(7, (80, 0, 0), (100, 100.2, 0), noise=0.02)}).drop("idx")
    learnt = [("TWO" if i >= 30 else "ONE", 99.6 + i / 60, 0.0) for i in range(60)]  # where ONE is nearer, TWO from 100.1 on
    forest = learning.step_forest(spark.createDataFrame(learnt, "label string, delta_p double, delta_q double"), trees=15, depth=4)
    rows = keyed.run_to_table(keyed.tracked(keyed.detected(stream_of(spark, df, tmp_path)), devices, classify=lambda rows: learning.with_said(rows, forest)), str(tmp_path), 2)
    assert [r["active"] for r in rows.where("kind = 'step'").collect()] == [["TWO"]]
    assert tracker.advance(tracker.site_of(devices), set(), 100.2, 0.0)[0] == {"ONE"}


def test_late_rows_are_listed_and_change_nothing(spark, tmp_path):
    df = frame(spark, {"a": SIGNALS["a"]}).drop("idx")
    odd = df.withColumn("due", F.when(F.col("t_sec").isin(20.0, 40.2), F.col("t_sec") + 25).otherwise(F.col("t_sec")))
    odd = odd.withColumn("p", F.when(F.col("due") > F.col("t_sec"), 5000.0).otherwise(F.col("p")))  # they would be steps
    found = keyed.run_to_table(keyed.detected(stream_of(spark, odd, tmp_path)), str(tmp_path), 2)
    assert sorted(r["t_sec"] for r in found.where("kind = 'late'").collect()) == [20.0, 40.2]
    assert [r["n"] for r in found.where("kind = 'stale'").collect()] == [2]
    assert max(abs(r["delta_p"]) for r in found.where("kind = 'step'").collect()) < 1000


class Told:
    """State and timers of one series, as a processor calls them."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, name, kind):  # noqa: N802
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.remove(at)


def test_a_micro_batch_of_a_series_takes_few_calls_of_its_state():
    import pandas as pd

    class Now:
        at = 0

        def getCurrentWatermarkInMs(self):  # noqa: N802
            return self.at

        def getExpiryTimeInMs(self):  # noqa: N802
            return self.at

    told, now = Told(), Now()
    detector = keyed.Detector(keyed.LiveRules(), keyed.Clock())
    detector.init(told)
    for tick in range(3):
        t = np.arange(tick * 50, (tick + 1) * 50) / 5
        rows = pd.DataFrame({"series_id": "a", "t_sec": t, "p": np.where(t >= 26.4, 700.0, 0.0), "q": 0.0, "thd": np.nan, "arrived": pd.Timestamp("1970-01-01", tz="UTC") + pd.to_timedelta(t, unit="s")})
        told.calls = 0
        list(detector.handleInputRows(("a",), iter([rows]), now))
        assert told.calls <= 4 and len(told.timers) == 1
    end = 29_800
    told.timers.remove(end + 3000)  # it runs
    now.at = end + 3000
    out = pd.concat(detector.handleExpiredTimer(("a",), now, now))
    assert list(out["kind"]) == ["stale"] and told.timers == {end + 10_000}
    now.at = end + 10_000
    told.timers.clear()
    out = pd.concat(detector.handleExpiredTimer(("a",), now, now))
    assert list(out["kind"]) == ["step"] and not told.timers


def test_series_of_a_bin_share_a_state_and_are_judged_as_alone():
    import pandas as pd
    import pyarrow as pa

    class Now:
        def __init__(self, at):
            self.at = at

        def getCurrentWatermarkInMs(self):  # noqa: N802
            return self.at

        def getExpiryTimeInMs(self):  # noqa: N802
            return self.at

    rows = pd.DataFrame([(name, i / 5, p, q, np.nan if x is None else x) for name, signal in SIGNALS.items() for i, (p, q, x) in enumerate(signal)], columns=["series_id", "t_sec", "p", "q", "thd"])
    due = rows["t_sec"] + np.where(rows.index % 29 == 3, 25.0, 0.0)  # some are late
    rows["arrived"] = pd.Timestamp("2000-01-01", tz="UTC") + pd.to_timedelta(due, unit="s")
    ticks = [own.drop(columns="tick") for _, own in rows.assign(tick=(due // 10)).groupby("tick")]

    def run(ticks, pack):
        told, out = Told(), []
        detector = keyed.Detector(keyed.LiveRules(), keyed.Clock())
        detector.init(told)
        for own in ticks:
            batch = pa.RecordBatch.from_pandas(own.assign(bin=5), preserve_index=False)
            come = [b.to_pandas() for b in keyed._packed(iter([batch[:7], batch[7:]]))] if pack else [own]
            told.calls = 0
            out += detector.handleInputRows((5,), iter(come), None)
            assert told.calls <= 4 and len(told.timers) == 1
        while told.timers:
            at = Now(told.timers.pop())
            out += detector.handleExpiredTimer((5,), at, at)
        return sorted((repr(tuple(r)) for part in out for r in part.astype(object).where(part.notna(), None).itertuples(index=False)))

    alone = sum((run([own for t in ticks if len(own := t[t["series_id"] == name])], False) for name in SIGNALS), [])
    assert run(ticks, True) == sorted(alone) and {"step", "level", "late", "stale"} == {r.split("'")[1] for r in alone}


def test_bins_grow_with_the_series():
    assert [keyed.bins_for(n, 8) for n in (10, 16_001, 360_000)] == [64, 65, 1440] and keyed.bins_for(10, 100) == 400


def test_replay_gives_spark_whole_batches(spark, tmp_path):
    replay.write_replay(frame(spark, {"a": SIGNALS["a"]}).drop("idx"), f"{tmp_path}/r", buckets=2, chunk_s=10.0)
    reader = replay.Replay({"path": f"{tmp_path}/r", "drainSeconds": "5"}).streamReader(None)
    parts = reader.partitions({"tick": 2}, {"tick": 12})
    got = [b for part in parts for b in reader.read(part)]
    assert all(b.schema.names == ["series_id", "t_sec", "p", "q", "thd", "arrived"] for b in got)
    times = [t for b in got for t in b.column("t_sec").to_pylist()]
    assert [t for t in times if t is None] == [None] and sorted(t for t in times if t is not None) == [i / 5 for i in range(100, 480)]


def test_nulls_and_extra_columns_on_a_stream(spark, tmp_path):
    df = frame(spark, {"a": [(None if i % 9 == 0 else p, None if i % 7 == 0 else q, None) for i, (p, q, _) in enumerate(levels(1, (80, 0, 0), (90, 0, 40)))]}).drop("idx")
    bad = spark.createDataFrame([("a", None, 1.0, 1.0, None), (None, 3.0, 1.0, 1.0, None)], "series_id string, t_sec double, p double, q double, thd double")
    found = keyed.run_to_table(keyed.detected(stream_of(spark, df.unionByName(bad).withColumn("n", F.lit("clash")), tmp_path)), str(tmp_path), 2)
    assert {r["kind"] for r in found.collect()} >= {"stale"}


def test_processing_time_timers_report_silence(spark, tmp_path):
    df = frame(spark, {"a": SIGNALS["a"][:200]}).drop("idx")
    stream = keyed.detected(stream_of(spark, df, tmp_path), clock=keyed.Clock(event=False, stale_s=1.0, flush_s=2.0))
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        query = stream.writeStream.format("memory").queryName("silence").trigger(processingTime="0 seconds").start()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    try:
        end = time.time() + 90
        while time.time() < end and not spark.table("silence").where("kind = 'stale'").count():
            time.sleep(1)
        assert spark.table("silence").where("kind = 'stale'").count() >= 1
    finally:
        query.stop()


def test_replay_resumes_where_its_checkpoint_stands(spark, tmp_path):
    df = frame(spark, {"a": SIGNALS["a"], "b": SIGNALS["b"]}).drop("idx")
    for _ in range(3):
        stream = stream_of(spark, df, tmp_path) if _ == 0 else spark.readStream.format("replay").options(path=f"{tmp_path}/replay", progress=f"{tmp_path}/progress", batchSeconds=10, drainSeconds=30).load()
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="0 seconds").start()
        if _ < 2:
            time.sleep(2.5)  # stopped in the midst of it
            query.stop()
        else:
            end = time.time() + 120  # a first look after a restart may find nothing new
            while time.time() < end and not re.search(r"tick\D+11\b", str(query.lastProgress)):
                time.sleep(1)
            query.processAllAvailable()
            query.stop()
    out = spark.read.schema(stream.schema).parquet(f"{tmp_path}/out").where("series_id IS NOT NULL")
    assert out.count() == df.count() == out.select("series_id", "t_sec").distinct().count()


def test_replay_offsets(spark, tmp_path):
    replay.write_replay(frame(spark, {"a": SIGNALS["a"]}).drop("idx"), f"{tmp_path}/r", buckets=2, chunk_s=7.0)
    read = lambda **o: replay.ReplayReader({"path": f"{tmp_path}/r", "batchSeconds": "10", **o})
    assert read().latestOffset() == {"tick": 10}  # not told where the stream stands: all at once
    one = read(progress=f"{tmp_path}/p", drainSeconds="5")
    seen = [one.latestOffset()["tick"] for _ in range(13)]
    assert seen == [*range(1, 12), 11, 11]
    one.commit({"tick": 4})
    assert read(progress=f"{tmp_path}/p").latestOffset() == {"tick": 6}
    assert len(one.partitions({"tick": 2}, {"tick": 3})) == 2 and [p.bucket for p in one.partitions({"tick": 10}, {"tick": 11})] == [None]
    times = sorted(r[1] for b in one.partitions({"tick": 2}, {"tick": 3}) for r in one.read(b))
    assert times == [i / 5 for i in range(100, 150)]
    slow = read(progress=f"{tmp_path}/q", speed="20", startedAt=str(time.time() - 2.1), mostTicks="3")
    assert slow.latestOffset() == {"tick": 3} and slow.latestOffset() == {"tick": 4}  # 42 seconds are due
    replay.write_replay(frame(spark, {}).drop("idx"), f"{tmp_path}/none")
    empty = replay.ReplayReader({"path": f"{tmp_path}/none", "progress": f"{tmp_path}/n"})
    assert empty.latestOffset() == {"tick": 0} and math.isclose(empty.tick, 10)


@pytest.fixture(autouse=True)
def _names(spark):
    yield
    spark.catalog.clearCache()
