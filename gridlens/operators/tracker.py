"""The set of running devices of each series, step by step.

The set after a step depends on the set before it, so a series' steps (not its samples) are taken
in order by one grouped function; series are independent and spread over the cluster.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import TIMELINE_SCHEMA
from .windows import dealt


@dataclass(frozen=True)
class Rules:
    largest: int = 2
    tol_abs: float = 10.0
    tol_share: float = 0.18
    uncalibrated: float = 2.0
    per_extra: float = 6.0
    min_share: float = 0.10
    tie: float = 1.0
    slack_w: float = 2.0

    def tolerance(self, size: float) -> float:
        return max(self.tol_abs, self.tol_share * size)


@dataclass
class Site:
    """The devices of a site, in order."""

    rows: list
    rules: Rules = field(default_factory=Rules)

    def __post_init__(self):
        self.rows = sorted(self.rows, key=lambda r: r["ord"])
        self.named = {r["device"]: r for r in self.rows}

    def penalty(self, d) -> float:
        return 0.0 if d["calibrated"] else self.rules.uncalibrated

    def distance(self, d, p: float, q: float) -> float:
        return math.hypot(d["P"] - p, d["Q"] - q) + self.penalty(d)

    @staticmethod
    def generates(d) -> bool:
        return bool(d["generator"]) or d["P"] < 0


def change_of_state(site: Site, on: set, dp: float, dq: float):
    """(old, new) of the family move nearest to the step, if near enough; ties go to the lower ord."""
    moves = [
        (math.hypot(b["P"] - a["P"] - dp, b["Q"] - a["Q"] - dq), a["ord"], b["ord"], a["device"], b["device"])
        for a in site.rows if a["device"] in on and a["family"]
        for b in site.rows if b["family"] == a["family"] and b is not a
    ]
    if moves and min(moves)[0] <= max(8.0, 0.10 * math.hypot(dp, dq)):
        return min(moves)[3:]
    return None


def generator_toggle(site: Site, on: set, dp: float, dq: float):
    """The generator that best explains the step by turning to its other state: (err, device) or None."""
    best = None
    for d in filter(site.generates, site.rows):
        turn = -1.0 if d["device"] in on else 1.0  # what an ON step of it would have been
        p, q = turn * dp, turn * dq
        if d["varies"] and d["p_lo"] is not None:
            ep = 0.0 if d["p_lo"] <= p <= d["p_hi"] else min(abs(p - d["p_lo"]), abs(p - d["p_hi"]))
        else:
            ep = p - d["P"]
        err = math.hypot(ep, q - d["Q"])
        if err <= site.rules.tolerance(math.hypot(d["P"], d["Q"])) and (best is None or err < best[0]):
            best = (err, d["device"])
    return best


def explain(site: Site, devices: list, p: float, q: float, alone: bool, classify=None):
    """(names, unknown residual or None) of the load (p, q) among devices.

    alone: nothing else runs, so the step must resemble a single device. classify: optional function
    of (p, q) that settles near-ties of single devices.
    """
    if not devices:
        return set(), None
    r, size = site.rules, math.hypot(p, q)
    errs = [(site.distance(d, p, q), d["ord"], d["device"]) for d in devices]
    single, _, name = min(errs)
    heavy = [d for d in devices if math.hypot(d["P"], d["Q"]) >= r.min_share * size]
    sets = (c for n in range(2, r.largest + 1) for c in itertools.combinations(heavy, n))
    joint = min(((math.hypot(sum(d["P"] for d in c) - p, sum(d["Q"] for d in c) - q) + r.per_extra * (len(c) - 1) + sum(map(site.penalty, c)), i, c) for i, c in enumerate(sets)), default=(math.inf, 0, ()))
    judged = single if alone else min(single, joint[0])
    if judged > r.tolerance(size):
        return set(), judged
    if joint[0] + max(r.slack_w, 0.03 * size) < single:
        return {d["device"] for d in joint[2]}, None
    if classify is not None:
        near = [n for e, _, n in errs if e <= single + r.tie]
        said = classify(p, q) if len(near) > 1 else None
        if said in near:
            return {said}, None
    return {name}, None


def advance(site: Site, on: set, dp: float, dq: float, classify=None):
    """(set after the step, unknown residual or None)."""
    p, q = abs(dp), dq if dp >= 0 else -dq
    moved = change_of_state(site, on, dp, dq)
    if moved:
        return (on - {moved[0]}) | {moved[1]}, None
    loads = [d for d in site.rows if not site.generates(d)]
    off = [d for d in loads if d["device"] not in on]
    running = [d for d in loads if d["device"] in on]
    toggle = generator_toggle(site, on, dp, dq)
    if toggle:
        rivals = off if toggle[1] in on else running
        if toggle[0] <= min((site.distance(d, p, q) for d in rivals), default=math.inf):
            return on ^ {toggle[1]}, None
    if dp >= 0:
        fresh, unknown = explain(site, off, p, q, alone=not on, classify=classify)
        family = lambda n: site.named[n]["family"] if n in site.named else None
        rivals_of = lambda n: any(d != n and family(d) and family(d) == family(n) for d in fresh)
        return {n for n in on | fresh if not rivals_of(n)}, unknown
    if not running:
        return set(on), None
    if min(site.distance(d, p, q) for d in running) > site.rules.tolerance(math.hypot(p, q)):
        for d in running:
            if d["varies"] and d["p_lo"] is not None and d["p_lo"] - 2.0 <= p <= d["p_hi"] + 2.0:
                return on - {d["device"]}, None
    gone, unknown = explain(site, running, p, q, alone=False, classify=classify)
    return on - gone, unknown


def site_of(devices: DataFrame, rules: Rules = Rules(), most: int = 1000) -> Site:
    """The device table for use inside tasks. It is a site's; its size is checked."""
    rows = devices.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} devices at one site")
    return Site([r.asDict() for r in rows], rules)


def timelines(steps: DataFrame, devices: DataFrame, rules: Rules = Rules(), start: DataFrame | None = None) -> DataFrame:
    """TIMELINE_SCHEMA: after every step of a series the sorted running set, and the residual where the
    step was no known load.

    steps: series_id, t_sec, delta_p, delta_q and optionally `said`, a classifier's device for the step, which
    settles near-ties of single devices. start: (series_id, step_no, active) to go on from.
    """
    site = site_of(devices, rules)
    cols = ["t_sec", "delta_p", "delta_q", "said"]
    steps = steps if "said" in steps.columns else steps.withColumn("said", F.lit(None).cast("string"))

    def run(key, rows, before=None):
        on = set(before["active"].iloc[0]) if before is not None and len(before) else set()
        at = int(before["step_no"].iloc[0]) if before is not None and len(before) else 0
        out = []
        for t, dp, dq, said in rows.sort_values(cols[:3])[cols].itertuples(index=False):
            on, unknown = advance(site, on, dp, dq, classify=lambda p, q, said=said: said)
            at += 1
            out.append((key[0], at, t, sorted(on), unknown))
        return pd.DataFrame(out, columns=["series_id", "step_no", "t_sec", "active", "unknown_residual"])

    slim = steps.select("series_id", *cols)
    if start is None:
        return dealt(slim, "series_id").groupBy("series_id").applyInPandas(lambda key, rows: run(key, rows), TIMELINE_SCHEMA)
    return slim.groupBy("series_id").cogroup(start.select("series_id", "step_no", "active").groupBy("series_id")).applyInPandas(lambda key, rows, before: run(key, rows, before), TIMELINE_SCHEMA)


def switch_events(timeline: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(series_id, t_sec, device, kind): what each step turned on or off. before: (series_id, active) that ran
    ahead of the first step."""
    from pyspark.sql import Window

    none = F.array().cast("array<string>")
    if before is not None:
        timeline = timeline.join(before.select("series_id", F.col("active").alias("ran")), "series_id", "left")
    was = F.coalesce(F.lag("active").over(Window.partitionBy("series_id").orderBy("step_no")), F.coalesce("ran", none) if before is not None else none)
    diff = timeline.withColumn("was", was)
    named = lambda a, b, kind: F.transform(F.array_except(a, b), lambda d: F.struct(d.alias("device"), F.lit(kind).alias("kind")))
    return diff.select("series_id", "t_sec", F.explode(F.concat(named("active", "was", "on"), named("was", "active", "off"))).alias("e")).select("series_id", "t_sec", "e.*")


def intervals(timeline: DataFrame) -> DataFrame:
    """(series_id, device, from_t, to_t): stretches in which a device ran; to_t is null while it still does."""
    from pyspark.sql import Window

    events = switch_events(timeline)
    after = F.lead("t_sec").over(Window.partitionBy("series_id", "device").orderBy("t_sec", F.col("kind").desc()))
    return events.withColumn("to_t", after).where("kind = 'on'").select("series_id", "device", F.col("t_sec").alias("from_t"), "to_t")
