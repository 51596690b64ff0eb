"""Live detection: the batch step detector and tracker over micro-batches.

Each micro-batch joins the rows a series still needs (its last keep_s seconds) with the new rows and
runs the same detector as a batch job; steps up to confirm_s before the newest row are final. State is
a table per micro-batch in a shared folder, named by its number, so a repeated micro-batch reads the
same state and writes the same result.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import describe_load
from ..operators.calibration import onboard
from ..operators.matching import nearest_known, standing_loads
from ..operators.steps import StepRules, detect_steps
from ..operators.tracker import Rules, switch_events, timelines
from ..operators.windows import settled_windows
from ..schema import TIMELINE_SCHEMA
from ..staging import new_folder

BUFFER_SCHEMA = "series_id string, t_sec double, p double, q double, thd double"
POINTER_SCHEMA = "series_id string, first_t double, last_t double, finalized double, decided boolean"
RUNNING_SCHEMA = "series_id string, step_no int, active array<string>"
SEED_SCHEMA = "series_id string, active array<string>, confidence int, residual double"
UNKNOWN_SCHEMA = "series_id string, t_sec double, delta_p double, delta_q double, unknown_residual double, class string, label string, description string, nearest array<string>"
LIVE_STEP_SCHEMA = "series_id string, t_sec double, delta_p double, delta_q double, p_before double, p_after double, thd_i_after double"


def by_session(rows: DataFrame) -> DataFrame:
    """rows with each session after a series' first one as a series of its own (`name#session`), so that a
    source that began anew starts from no state."""
    if "session" not in rows.columns:
        return rows
    return rows.withColumn("series_id", F.when(F.col("session") > 0, F.concat("series_id", F.lit("#"), F.col("session"))).otherwise(F.col("series_id"))).drop("session")


@dataclass(frozen=True)
class LiveRules:
    steps: StepRules = field(default_factory=StepRules)
    confirm_s: float = 4.0
    keep_s: float = 30.0
    warm_s: int = 5  # whole seconds: a window frame
    give_up_s: float = 25.0

    @property
    def least_rows(self) -> int:
        return int((2 * self.steps.win_s + self.confirm_s) * self.steps.sps)


@dataclass
class State:
    buffer: DataFrame
    pointer: DataFrame
    running: DataFrame


def empty_state(spark: SparkSession) -> State:
    return State(spark.createDataFrame([], BUFFER_SCHEMA), spark.createDataFrame([], POINTER_SCHEMA), spark.createDataFrame([], RUNNING_SCHEMA))


def advance_steps(rows: DataFrame, state: State, rules: LiveRules, flush: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(steps that became final, new buffer, new pointers). rows: BUFFER_SCHEMA; late rows are sorted in
    as long as their time is still in the buffer. flush: everything after the pointer is final."""
    held = state.buffer.unionByName(rows.select(*state.buffer.columns))
    ends = held.groupBy("series_id").agg(F.count("*").alias("n"), F.min("t_sec").alias("low"), F.max("t_sec").alias("high"))
    ends = ends.join(state.pointer, "series_id", "left")
    ready = F.col("n") >= rules.least_rows
    cutoff = F.lit(float("inf")) if flush else F.col("high") - rules.confirm_s
    ends = ends.withColumns({"ready": ready, "cutoff": cutoff, "after": F.coalesce("finalized", F.lit(float("-inf")))})
    at = F.row_number().over(Window.partitionBy("series_id").orderBy("t_sec", "p", "q")) - 1
    full = held.join(ends.where("ready").select("series_id"), "series_id", "left_semi").withColumn("idx", at.cast("long"))
    found = detect_steps(full, rules.steps).drop("idx").join(ends.select("series_id", "after", "cutoff"), "series_id")
    final = found.where((F.col("t_sec") > F.col("after")) & (F.col("t_sec") <= F.col("cutoff"))).drop("after", "cutoff")
    keep = held.join(ends.select("series_id", "high"), "series_id").where(F.col("t_sec") >= F.col("high") - rules.keep_s).drop("high")
    moved = F.when(F.col("ready"), F.greatest("after", F.when(F.col("cutoff") < float("inf"), F.col("cutoff")).otherwise(F.col("high")))).otherwise(F.col("finalized"))
    pointer = ends.select("series_id", F.coalesce("first_t", "low").alias("first_t"), F.col("high").alias("last_t"), moved.alias("finalized"), F.coalesce("decided", F.lit(False)).alias("decided"))
    return final.select(*[c.split()[0] for c in LIVE_STEP_SCHEMA.split(", ")]), keep, pointer


def standing(held: DataFrame, pointer: DataFrame, devices: DataFrame, rules: LiveRules) -> tuple[DataFrame, DataFrame]:
    """(seeds: SEED_SCHEMA; pointers with `decided`). A series is decided by its first settled
    window of warm_s that ends within give_up_s of its start, or after that without a seed."""
    open_ = pointer.where("NOT decided").select("series_id", "first_t", "last_t")
    since = F.col("t_sec") - F.col("first_t")
    calm = settled_windows(held.join(open_, "series_id").where(since <= rules.give_up_s), rules.warm_s)
    at = calm.where((since >= rules.warm_s) & F.col("settled")).groupBy("series_id").agg(F.min("t_sec").alias("at"))
    level = held.join(at, "series_id").where(F.col("t_sec").between(F.col("at") - rules.warm_s, F.col("at"))).groupBy("series_id").agg(F.median("p").alias("P_now"), F.median("q").alias("Q_now"), F.median("thd").alias("thd_now"))
    seeds = standing_loads(level, devices).select("series_id", F.col("best").alias("active"), "confidence", "residual")
    pointer = pointer.join(at, "series_id", "left")
    late = F.col("last_t") - F.col("first_t") > rules.give_up_s
    return seeds, pointer.withColumn("decided", F.col("decided") | F.col("at").isNotNull() | late).drop("at")


def advance_running(steps: DataFrame, running: DataFrame, devices: DataFrame, rules: Rules = Rules()) -> tuple[DataFrame, DataFrame]:
    """(timeline of the new steps, new running sets)."""
    timeline = timelines(steps, devices, rules, start=running)
    last = timeline.groupBy("series_id").agg(F.max_by(F.struct("step_no", "active"), "step_no").alias("l")).select("series_id", "l.*")
    return timeline, running.join(last, "series_id", "left_anti").unionByName(last)


def unknown_loads(timeline: DataFrame, steps: DataFrame, devices: DataFrame) -> DataFrame:
    """UNKNOWN_SCHEMA: the steps that were no known load, described, with the known devices nearest to them."""
    odd = timeline.where("unknown_residual IS NOT NULL").select("series_id", "t_sec", "unknown_residual").distinct()
    told = nearest_known(steps.join(odd, ["series_id", "t_sec"]).withColumn("d", describe_load("delta_p", "delta_q")), devices)
    return told.select("series_id", "t_sec", "delta_p", "delta_q", "unknown_residual", "d.class", "d.label", "d.description", F.transform("nearest", lambda n: n["device"]).alias("nearest"))


class Live:
    """A live session over a stream of BUFFER_SCHEMA rows (and `session`, where a source can begin anew);
    results lie under `folder`: steps, timeline, unknown and standing, each by micro-batch. The folder must be
    one that all executors share.

    on_change and on_unknown are called after each micro-batch with its switch events and unknown loads
    as DataFrames, and its number.
    """

    def __init__(self, spark: SparkSession, folder: str, devices: DataFrame, rules: LiveRules = LiveRules(), tracking: Rules = Rules(), seed: bool = True, on_change: Callable[[DataFrame, int], None] | None = None, on_unknown: Callable[[DataFrame, int], None] | None = None):
        self.spark, self.folder, self.devices, self.rules, self.tracking, self.seed = spark, folder.rstrip("/"), devices, rules, tracking, seed
        self.on_change, self.on_unknown = on_change, on_unknown
        self.named: list[tuple[str, str]] = []

    def _path(self, name: str, batch: int) -> str:
        return f"{self.folder}/{name}/batch={batch}"

    def _state(self, batch: int) -> State:
        if batch < 0:
            return empty_state(self.spark)
        read = lambda name, schema: self.spark.read.schema(schema).parquet(self._path(name, batch))
        return State(read("buffer", BUFFER_SCHEMA), read("pointer", POINTER_SCHEMA), read("running", RUNNING_SCHEMA))

    def _put(self, df: DataFrame, name: str, batch: int) -> DataFrame:
        df.write.mode("overwrite").parquet(self._path(name, batch))
        return self.spark.read.schema(df.schema).parquet(self._path(name, batch))

    def onboard(self, series_id: str, name: str, dp: float, dq: float) -> None:
        """Take an unknown step of a series as a new device from the next micro-batch on; it runs if it was switched on."""
        self.devices = onboard(self.devices, name, dp, dq)
        if dp >= 0:
            self.named.append((series_id, name))

    def process(self, rows: DataFrame, batch: int, flush: bool = False) -> None:
        """One micro-batch; the function for foreachBatch."""
        state = self._state(batch - 1)
        rows = by_session(rows).select("series_id", "t_sec", F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("q", F.lit(0.0)).alias("q"), "thd")
        rows = self._put(rows, "rows", batch)  # several jobs read them
        steps, buffer, pointer = advance_steps(rows, state, self.rules, flush)
        self._put(buffer, "buffer", batch)
        steps = self._put(steps, "steps", batch)
        running = state.running
        if self.named:
            own = self.spark.createDataFrame(self.named, "series_id string, device string").groupBy("series_id").agg(F.collect_set("device").alias("more"))
            running = running.join(own, "series_id", "full").select("series_id", F.coalesce("step_no", F.lit(0)).alias("step_no"), F.array_sort(F.array_union(F.coalesce("active", F.array().cast("array<string>")), F.coalesce("more", F.array().cast("array<string>")))).alias("active"))
        if self.seed:
            seeds, pointer = standing(state.buffer.unionByName(rows), pointer, self.devices, self.rules)
            seeds = self._put(seeds, "standing", batch)
            fresh = seeds.join(running, "series_id", "left_anti").select("series_id", F.lit(0).alias("step_no"), "active")
            running = running.unionByName(fresh)
        pointer = pointer.unionByName(state.pointer.join(pointer.select("series_id"), "series_id", "left_anti"))
        self._put(pointer, "pointer", batch)
        timeline, after = advance_running(steps, running, self.devices, self.tracking)
        timeline = self._put(timeline, "timeline", batch)
        self._put(after, "running", batch)
        unknown = self._put(unknown_loads(timeline, steps, self.devices), "unknown", batch)
        self.named = []
        if self.on_change:
            self.on_change(switch_events(timeline, running), batch)
        if self.on_unknown:
            self.on_unknown(unknown, batch)

    def start(self, stream: DataFrame, checkpoint: str, **trigger):
        return stream.writeStream.foreachBatch(lambda rows, batch: self.process(rows, batch)).option("checkpointLocation", checkpoint).trigger(**trigger or {"processingTime": "1 second"}).start()

    def steps(self) -> DataFrame:
        return self.spark.read.schema(LIVE_STEP_SCHEMA).parquet(f"{self.folder}/steps/batch=*")

    def timeline(self) -> DataFrame:
        return self.spark.read.schema(TIMELINE_SCHEMA).parquet(f"{self.folder}/timeline/batch=*")

    def unknown(self) -> DataFrame:
        return self.spark.read.schema(UNKNOWN_SCHEMA).parquet(f"{self.folder}/unknown/batch=*")

    def standing(self) -> DataFrame:
        """The loads that series began with, with the confidence in them."""
        return self.spark.read.schema(SEED_SCHEMA).parquet(f"{self.folder}/standing/batch=*")

    def events(self) -> DataFrame:
        return switch_events(self.timeline())

    def latest(self, batch: int, now: float | None = None, stale_s: float = 3.0) -> DataFrame:
        """(series_id, last_t, active, stale) after a micro-batch; of a series only its last session."""
        s = self._state(batch)
        base, at = F.substring_index("series_id", "#", 1), F.coalesce(F.try_element_at(F.split("series_id", "#"), F.lit(2)).cast("int"), F.lit(0))
        newest = s.pointer.groupBy(base.alias("base")).agg(F.max_by("series_id", at).alias("series_id")).select("series_id")
        s.pointer = s.pointer.join(newest, "series_id", "left_semi")
        out = s.pointer.select("series_id", "last_t").join(s.running.drop("step_no"), "series_id", "left").withColumn("active", F.coalesce("active", F.array().cast("array<string>")))
        return out.withColumn("stale", F.lit(now) - F.col("last_t") > stale_s) if now is not None else out


def replay(recordings: DataFrame, live: Live, batches: int = 10, speed: float | None = None) -> None:
    """Push a recording through a live session in `batches` parts by time, then flush; at `speed` times
    real time if given, else as fast as it goes."""
    rows = recordings.select("series_id", "t_sec", "p", "q", "thd")
    low, high = rows.agg(F.min("t_sec"), F.max("t_sec")).first()
    if low is None:
        return
    width = (high - low) / batches or 1.0
    for b in range(batches):
        if speed and b:
            time.sleep(width / speed)
        live.process(rows.where(F.least(F.floor((F.col("t_sec") - low) / width), F.lit(batches - 1)) == b), b, flush=b == batches - 1)
