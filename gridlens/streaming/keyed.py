"""Live detection and tracking with keyed state.

    found = detected(stream, LiveRules())            # steps, standing levels, late rows, stale series
    tracked(found, devices(spark))                   # running sets after each step

Each series has its own state: the rows of its last keep_s seconds, and how far its steps are final. The states of the
series of one bin are kept as one value and judged together, as each call of a state and each group costs more than the
rows of a series do; rows come packed, a bin's rows of a task as one. A micro-batch touches the bins that have rows
in it, and those whose timers ran out. What is final is never revised, so rows at or before that time are late: they
change nothing and are counted and listed. Timers run by event time over `arrived`, the clock of the source, or by the
machines' clock: a series that is silent for stale_s is reported, and one that is silent for
flush_s gets its last steps without waiting for the confirmation margin.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.scalars import describe_load
from ..operators.buffered import first_level, steps_of_buffers
from ..operators.matching import nearest_known, standing_loads
from ..operators.tracker import Rules, Site, advance, site_of
from .live import LiveRules

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_FOUND = "kind string, series_id string, t_sec double, delta_p double, delta_q double, p_before double, p_after double, thd_i_after double, P_now double, Q_now double, thd_now double, n long"
_FOUND_NAMES = [c.split()[0] for c in _FOUND.split(", ")]
_TRACKED = "kind string, series_id string, step_no int, t_sec double, delta_p double, delta_q double, was array<string>, active array<string>, unknown_residual double, confidence int"
_TRACKED_NAMES = [c.split()[0] for c in _TRACKED.split(", ")]


#: Bins of series unless said otherwise, series that a bin had better hold, rows that a task packs at once.
BINS, BIN_SERIES, PACK_ROWS = 64, 250, 500_000
_PACKED = "bin int, arrived timestamp, names array<string>, rows binary"


def bins_for(series: int, tasks: int) -> int:
    """Bins for so many series, enough for each task to have some."""
    return max(BINS, 4 * tasks, -(-series // BIN_SERIES))


@dataclass(frozen=True)
class Clock:
    """What timers run by. event: `arrived`, else the machines' clock. delay: of the watermark over `arrived`."""

    event: bool = True
    delay: str = "0 seconds"
    stale_s: float = 3.0
    flush_s: float = 10.0


def _found(kind: str, names, t, **more) -> pd.DataFrame:
    names = np.asarray(names, object)
    made = {"kind": np.full(len(names), kind, object), "series_id": names, "t_sec": np.asarray(t, float)}
    made |= {c: np.asarray(more[c], float) if c in more else np.full(len(names), np.nan) for c in _FOUND_NAMES[3:-1]}
    return pd.DataFrame(made | {"n": pd.array(more["n"] if "n" in more else [None] * len(names), "Int64")})


def _milliseconds(arrived: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return arrived.cast(pa.timestamp("us", arrived.type.tz), safe=False).cast(pa.int64()).fill_null(0).to_numpy() // 1000


def _packs(rows: pa.Table) -> pa.RecordBatch:
    """A row for each bin: its latest `arrived`, the names of its series, and as bytes their rows (number of the name,
    t_sec, p, q, thd, arrived in ms). Rows without a series make a pack without rows."""
    names = rows["series_id"].combine_chunks().dictionary_encode()
    code = names.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    arrived = _milliseconds(rows["arrived"])
    value = lambda c: rows[c].cast(pa.float64()).to_numpy()  # noqa: E731  null becomes NaN
    table = np.column_stack([code, *[value(c) for c in ("t_sec", "p", "q", "thd")], arrived])
    bins = np.where(code < 0, -1, rows["bin"].to_numpy())
    order = np.argsort(bins, kind="stable")
    table, (there, begin) = table[order], np.unique(bins[order], return_index=True)
    made = []
    for at, part in zip(there, np.split(table, begin[1:])):
        own, part[:, 0] = np.unique(part[:, 0], return_inverse=True)
        known = at >= 0
        made.append((max(at, 0), int(part[:, 5].max()) * 1000, names.dictionary.take(pa.array(own, pa.int64())).to_pylist() if known else [], part.tobytes() if known else b""))
    kinds = {"bin": pa.int32(), "arrived": pa.timestamp("us", "UTC"), "names": pa.list_(pa.string()), "rows": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*made), kinds.values())], list(kinds))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= PACK_ROWS:
            yield _packs(pa.Table.from_batches(held))
            held, n = [], 0
    if n:
        yield _packs(pa.Table.from_batches(held))


def _come(frames: list[pd.DataFrame]) -> tuple[list[str], np.ndarray]:
    """(names of series, their rows: number of the name, t_sec, p, q, thd, arrived in ms), of packs or of plain rows."""
    come = pd.concat(frames)
    if "rows" not in come.columns:
        packs = _packs(pa.Table.from_pandas(come.assign(bin=0), preserve_index=False)).to_pandas()
        come = packs[["names", "rows"]]
    names: dict[str, int] = {}
    parts = []
    for own, rows in zip(come["names"], come["rows"]):
        part = np.frombuffer(rows, float).reshape(-1, 6).copy()
        if len(part):
            part[:, 0] = np.array([names.setdefault(name, len(names)) for name in own])[part[:, 0].astype(int)]
            parts.append(part)
    return list(names), np.concatenate(parts) if parts else np.zeros((0, 6))


@dataclass
class Held:
    """The state of the series of a bin: a value of each for each series, and all series' rows (t_sec, p, q, thd) behind
    each other. NaN: none. stale_at and flush_at are in ms."""

    names: list
    marks: np.ndarray
    sizes: np.ndarray
    rows: np.ndarray
    timer: int | None = None

    KIND = "names array<string>, marks binary, sizes binary, rows binary, timer long"
    MARKS = ("first_t", "last_t", "finalized", "decided", "late", "stale_at", "flush_at")

    @staticmethod
    def of(value: tuple | None) -> Held:
        if not value:
            return Held([], np.zeros((0, 7)), np.zeros(0, np.int64), np.zeros((0, 4)))
        names, marks, sizes, rows, timer = value
        return Held(list(names), np.frombuffer(marks, float).reshape(-1, 7).copy(), np.frombuffer(sizes, np.int64), np.frombuffer(rows, float).reshape(-1, 4), timer)

    def value(self) -> tuple:
        return self.names, self.marks.tobytes(), self.sizes.astype(np.int64).tobytes(), self.rows.tobytes(), self.timer

    def places(self, names: list[str]) -> np.ndarray:
        """Where the series of these names are; new ones are added."""
        known = {name: i for i, name in enumerate(self.names)}
        at = np.array([known.setdefault(name, len(known)) for name in names], int)
        fresh = len(known) - len(self.names)
        self.names = list(known)
        self.marks = np.concatenate([self.marks, np.tile([np.nan, np.nan, np.nan, 0.0, 0.0, np.nan, np.nan], (fresh, 1))])
        self.sizes = np.concatenate([self.sizes, np.zeros(fresh, np.int64)])
        return at

    def __getattr__(self, name: str) -> np.ndarray:
        if name in Held.MARKS:
            return self.marks[:, Held.MARKS.index(name)]
        raise AttributeError(name)

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.names)), self.sizes)


class Detector(StatefulProcessor):
    """Steps, standing levels, late rows and silence of the series of each bin."""

    def __init__(self, rules: LiveRules, clock: Clock):
        self.rules, self.clock = rules, clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # each call of the state is a round trip and a row of a list another one, so all is one value and rows are bytes
        self.at = handle.getValueState("at", Held.KIND)

    def _final(self, held: Held, which: np.ndarray, after: np.ndarray, upto: np.ndarray) -> list[pd.DataFrame]:
        """The steps of the series `which` that begin after `after` and up to `upto`."""
        if not which.any():
            return []
        rows, names = held.rows[which[held.owners()]], np.array(held.names, object)[which]
        own, found = steps_of_buffers(held.sizes[which], *rows.T, self.rules.steps, after[which], upto[which])
        cols = ["delta_p", "delta_q", "p_before", "p_after", "thd_i_after"]
        return [_found("step", names[own], found[:, 0], **dict(zip(cols, found[:, 1:].T)))]

    def _levels(self, held: Held, which: np.ndarray) -> list[pd.DataFrame]:
        """The first settled levels of those series that have none yet."""
        r, end, out = self.rules, np.cumsum(held.sizes), []
        for i in np.flatnonzero(which & (held.decided == 0) & ~np.isnan(held.first_t)):
            first, last = held.first_t[i], held.last_t[i]
            level = first_level(*held.rows[end[i] - held.sizes[i] : end[i]].T, first, r.warm_s, first + r.give_up_s)
            if level:
                out.append((held.names[i], *level))
            held.decided[i] = level is not None or last - first > r.give_up_s
        return [_found("level", *list(zip(*out))[:2], **dict(zip(["P_now", "Q_now", "thd_now"], list(zip(*out))[2:])))] if out else []

    def _set_timer(self, held: Held, ran: bool = False) -> None:
        """One timer is set at a time: of a series that of silence, and when it has run that of its last steps; of a
        bin the first of its series'."""
        due = np.where(np.isnan(held.stale_at), held.flush_at, held.stale_at)
        timer = None if np.isnan(due).all() else int(np.nanmin(due))
        if held.timer is not None and not ran and timer != held.timer:
            self.handle.deleteTimer(held.timer)
        if timer is not None and (ran or timer != held.timer):
            self.handle.registerTimer(timer)
        held.timer = timer

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        r, out = self.rules, []
        names, new = _come(list(rows))
        if not names:
            return  # a beat of the clock
        new[:, 2:4] = np.nan_to_num(new[:, 2:4])
        held = Held.of(self.at.get())
        own = held.places(names)[new[:, 0].astype(int)]
        n = len(held.names)
        touched = np.bincount(own, minlength=n) > 0
        after = np.where(np.isnan(held.finalized), -np.inf, held.finalized)
        timely = new[:, 1] > after[own]
        if not timely.all():
            late = own[~timely]
            out.append(_found("late", np.array(held.names, object)[late], new[~timely, 1]))
            held.late[:] += np.bincount(late, minlength=n)
        owners = np.concatenate([held.owners(), own[timely]])
        held.rows = np.concatenate([held.rows, new[timely, 1:5]])
        order = np.lexsort((held.rows[:, 2], held.rows[:, 1], held.rows[:, 0], owners))
        held.rows, owners = held.rows[order], owners[order]
        held.sizes = np.bincount(owners, minlength=n)
        end = np.cumsum(held.sizes)
        some = touched & (held.sizes > 0)
        held.first_t[:] = np.where(some & np.isnan(held.first_t), held.rows[np.where(some, end - held.sizes, 0), 0] if len(owners) else np.nan, held.first_t)
        held.last_t[:] = np.where(some, np.fmax(held.last_t, held.rows[np.where(some, end - 1, 0), 0] if len(owners) else np.nan), held.last_t)
        out += self._levels(held, touched)
        cutoff = held.last_t - r.confirm_s
        judged = touched & (held.sizes >= r.least_rows) & (cutoff > after)
        out += self._final(held, judged, after, cutoff)
        held.finalized[judged] = cutoff[judged]
        kept = held.rows[:, 0] >= held.last_t[owners] - r.keep_s
        held.rows, held.sizes = held.rows[kept], np.bincount(owners[kept], minlength=n)
        if self.clock.event:
            now = np.zeros(n)
            np.maximum.at(now, own, new[:, 5])
        else:
            now = np.full(n, float(timerValues.getCurrentProcessingTimeInMs()))
        held.stale_at[touched], held.flush_at[touched] = ((now + int(1000 * s))[touched] for s in (self.clock.stale_s, self.clock.flush_s))
        self._set_timer(held)
        self.at.update(held.value())
        yield from out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, out = Held.of(self.at.get()), []
        now = timerValues.getCurrentWatermarkInMs() if self.clock.event else timerValues.getCurrentProcessingTimeInMs()
        due = max(expiredTimerInfo.getExpiryTimeInMs(), now - 1)  # of series whose own time ran out with it too
        silent = held.stale_at <= due
        if silent.any():
            out.append(_found("stale", np.array(held.names, object)[silent], held.last_t[silent], n=held.late[silent].astype(int)))
            held.stale_at[silent] = np.nan
        over = np.isnan(held.stale_at) & (held.flush_at <= due)
        last = over & (held.sizes >= self.rules.least_rows)
        out += self._final(held, last, np.where(np.isnan(held.finalized), -np.inf, held.finalized), np.full(len(last), np.inf))
        held.finalized[last] = held.last_t[last]
        held.flush_at[over] = np.nan
        self._set_timer(held, ran=True)
        self.at.update(held.value())
        yield from out


def _binned(bins: int):
    return F.pmod(F.xxhash64("series_id"), F.lit(bins)).cast("int")


def detected(stream: DataFrame, rules: LiveRules = LiveRules(), clock: Clock = Clock(), bins: int = BINS) -> DataFrame:
    """A stream of what happens in each series of `stream` (REPLAY_SCHEMA), by kind:

    step: a step that became final; level: the first settled level (P_now, Q_now, thd_now) within give_up_s of
    the series' start; late: a row whose time was final already (it changes nothing); stale: nothing came for stale_s
    (t_sec: of the last row, n: late rows so far). Rows without t_sec are dropped; null power is 0. Rows
    without a series carry the clock only. bins: of series (`bins_for`); a checkpoint keeps them for its life.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)  # keyed state of several kinds needs it
    rows = stream.select("series_id", "t_sec", "p", "q", "thd", "arrived").where("t_sec IS NOT NULL OR series_id IS NULL")
    rows = rows.withColumn("bin", _binned(bins)).mapInArrow(_packed, _PACKED)
    if clock.event:
        rows = rows.withWatermark("arrived", clock.delay)
    mode = "EventTime" if clock.event else "ProcessingTime"
    return rows.groupBy("bin").transformWithStateInPandas(Detector(rules, clock), _FOUND, "Append", mode)


class Tracker(StatefulProcessor):
    """The running set of each series of a bin."""

    def __init__(self, site: Site):
        self.site = site

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.running = handle.getValueState("running", "names array<string>, step_no array<int>, active array<array<string>>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        come = pd.concat(list(rows)).sort_values(["series_id", "seed", "t_sec", "delta_p", "delta_q"], ascending=[True, False, True, True, True])
        state = {name: (at, list(on)) for name, at, on in zip(*(self.running.get() or ([], [], [])))}
        begun, out = set(state), []
        for r in come.itertuples(index=False):
            at, was = state.get(r.series_id, (0, []))
            if r.seed:
                if r.series_id in begun or at:
                    continue
                on, at, unknown, kind = set(r.active), 0, None, "seed"
            else:
                said = r.said if isinstance(r.said, str) else None
                on, unknown = advance(self.site, set(was), r.delta_p, r.delta_q, classify=lambda p, q, said=said: said)
                at, kind = at + 1, "step"
            state[r.series_id] = at, sorted(on)
            out.append((kind, r.series_id, at, r.t_sec, None if r.seed else r.delta_p, None if r.seed else r.delta_q, was, sorted(on), unknown, r.confidence if r.seed else None))
        if out:
            self.running.update((list(state), [at for at, _ in state.values()], [on for _, on in state.values()]))
            yield pd.DataFrame(out, columns=_TRACKED_NAMES).astype({"confidence": "Int64"})


def tracked(found: DataFrame, devices: DataFrame, rules: Rules = Rules(), seed: bool = True, classify=None, bins: int = BINS) -> DataFrame:
    """A stream of the running set after each step of `found` (of `detected`): kind, series_id, step_no, t_sec,
    delta_p, delta_q, was, active, unknown_residual, confidence.

    seed: a series' standing level, matched to devices, is what it runs before its first step (kind seed; only
    if no step came before). classify: optional function of the rows that adds `said`, a classifier's device for
    each step, which settles near-ties of single devices. bins: as of `detected`.
    """
    rows = found.where("kind IN ('step', 'level')" if seed else "kind = 'step'")
    rows = standing_loads(rows, devices).withColumn("seed", F.col("kind") == "level")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("delta_p", "delta_q")})  # of levels
    rows = classify(rows) if classify else rows.withColumn("said", F.lit(None).cast("string"))
    slim = rows.select(_binned(bins).alias("bin"), "series_id", "seed", "t_sec", "delta_p", "delta_q", F.when(F.col("seed"), F.col("best")).alias("active"), "confidence", "said")
    return slim.groupBy("bin").transformWithStateInPandas(Tracker(site_of(devices, rules)), _TRACKED, "Append", "None")


def switched(timeline: DataFrame) -> DataFrame:
    """(series_id, t_sec, device, kind) of each device that a row of `tracked` turned on or off; kind: on, off."""
    named = lambda a, b, kind: F.transform(F.array_except(a, b), lambda d: F.struct(d.alias("device"), F.lit(kind).alias("kind")))
    return timeline.select("series_id", "t_sec", F.explode(F.concat(named("active", "was", "on"), named("was", "active", "off"))).alias("e")).select("series_id", "t_sec", "e.*")


def unknown(timeline: DataFrame, devices: DataFrame) -> DataFrame:
    """The steps of `tracked` that were no known load, described, with the known devices nearest to them."""
    odd = timeline.where("unknown_residual IS NOT NULL").withColumn("d", describe_load("delta_p", "delta_q"))
    return nearest_known(odd, devices).select("series_id", "t_sec", "delta_p", "delta_q", "unknown_residual", "d.class", "d.label", "d.description", F.transform("nearest", lambda n: n["device"]).alias("nearest"))


def run_to_table(stream: DataFrame, folder: str, partitions: int | None = None) -> DataFrame:
    """Run a finite stream to its end into Parquet under folder (which all executors share) and read that.
    partitions: of the keyed state, which keeps them for the life of its checkpoint."""
    spark: SparkSession = stream.sparkSession
    width = "spark.sql.shuffle.partitions"
    before = spark.conf.get(width)
    spark.conf.set(width, str(partitions or before))
    try:
        query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(processingTime="0 seconds").start()
    finally:
        spark.conf.set(width, before)
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
