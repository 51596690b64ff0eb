"""Queries over live sessions with keyed state and the default rules, with the SQL of their micro-batches.

The summed signals are replayed as they might arrive: some series join late, some fall silent early, and some
rows come eight seconds after their time. Each micro-batch admits ten seconds.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..schema import devices
from ..sources.replay import Replay, write_replay
from ..staging import new_folder
from ..streaming import keyed, live
from .matching import _STANDING, _SUMMED, _TRACK, COMBOS, _signals
from .signal import rounded, step_cte

RULES = live.LiveRules()
#: Seconds that a micro-batch admits, that delayed rows are delayed, and that the clock runs on after the end.
TICK, DELAY, DRAIN = 10, 8, 30
_COMES = "NOT (s % 4 = 0 AND t < 14) AND NOT (s % 5 = 1 AND t < 30) AND NOT (s % 7 = 3 AND t >= 45)"
_LATE = "(idx * 7 + s) % 41 = 0"


def _found(spark, sf_dir):
    """(folder, stream of what is detected, bins of series)."""
    folder, tasks = new_folder(spark), spark.sparkContext.defaultParallelism
    bins = keyed.bins_for(spark.read.parquet(f"{sf_dir}/supplier.parquet").count(), tasks)
    rows = _signals(spark, sf_dir).withColumns({"s": F.col("series_id").cast("long"), "t": F.col("t_sec")}).where(_COMES)
    due = F.col("t_sec") + F.when(F.expr(_LATE), float(DELAY)).otherwise(0.0)
    write_replay(rows.select("series_id", "t_sec", "p", "q", F.lit(None).cast("double").alias("thd"), due.alias("due")), f"{folder}/replay", buckets=max(8, tasks), chunk_s=float(TICK))
    spark.dataSource.register(Replay)
    stream = spark.readStream.format("replay").options(path=f"{folder}/replay", progress=f"{folder}/progress").option("batchSeconds", TICK).option("drainSeconds", DRAIN).load()
    return folder, keyed.detected(stream, RULES, bins=bins), bins


def _detected(spark, sf_dir, kind: str):
    folder, found, _ = _found(spark, sf_dir)
    return keyed.run_to_table(found, folder, spark.sparkContext.defaultParallelism).where(F.col("kind") == kind)


def _tracked(spark, sf_dir):
    folder, found, bins = _found(spark, sf_dir)
    return keyed.run_to_table(keyed.tracked(found, devices(spark), bins=bins), folder, spark.sparkContext.defaultParallelism)


def stream_steps(spark, sf_dir):
    """Steps of the replayed signals, by default rules."""
    cols = ["t_sec", "delta_p", "delta_q", "p_before", "p_after"]
    return rounded(_detected(spark, sf_dir, "step").select("series_id", *cols), *cols)


def stream_late(spark, sf_dir):
    """Rows that came after their time was final."""
    late = _detected(spark, sf_dir, "late")
    return rounded(late.groupBy("series_id").agg(F.count("*").alias("n_late"), F.min("t_sec").alias("first_t"), F.max("t_sec").alias("last_t")), "first_t", "last_t")


def stream_stale(spark, sf_dir):
    """Series that fell silent, with their last row's time and their late rows until then."""
    return rounded(_detected(spark, sf_dir, "stale").select("series_id", "t_sec", F.col("n").alias("n_late")), "t_sec")


def stream_seeded(spark, sf_dir):
    """What each series ran when it began: its standing load."""
    seeds = _tracked(spark, sf_dir).where("kind = 'seed'")
    return rounded(seeds.select("series_id", "t_sec", F.concat_ws("+", "active").alias("active"), "confidence"), "t_sec")


def stream_tracker(spark, sf_dir):
    """The running set after each step, begun with the standing load."""
    rows = _tracked(spark, sf_dir).where("kind = 'step'")
    return rounded(rows.select("series_id", "step_no", "t_sec", F.concat_ws("+", "active").alias("active"), "unknown_residual"), "t_sec", "unknown_residual")


def stream_events(spark, sf_dir):
    """What turned on or off, as the stream said it."""
    return rounded(keyed.switched(_tracked(spark, sf_dir).where("kind = 'step'")), "t_sec")


def stream_unknown(spark, sf_dir):
    """Steps that were no known load, described, with the nearest devices."""
    odd = keyed.unknown(_tracked(spark, sf_dir), devices(spark))
    return rounded(odd.select("series_id", "t_sec", "delta_p", "delta_q", "unknown_residual", "class", F.concat_ws("+", "nearest").alias("nearest")), "t_sec", "delta_p", "delta_q", "unknown_residual")


def stream_latest(spark, sf_dir):
    """Each series' running set at the end."""
    rows = _tracked(spark, sf_dir)
    last = rows.groupBy("series_id").agg(F.max_by("active", "step_no").alias("active"), F.max("step_no").alias("steps"))
    return last.select("series_id", F.concat_ws("+", "active").alias("active"), "steps")


QUERIES = {
    "stream_steps": stream_steps, "stream_late": stream_late, "stream_stale": stream_stale, "stream_seeded": stream_seeded,
    "stream_tracker": stream_tracker, "stream_events": stream_events, "stream_unknown": stream_unknown, "stream_latest": stream_latest,
}

_BY = "PARTITION BY series_id ORDER BY b"
#: rec: rows as they arrive, b their micro-batch. bf: a series' micro-batches, how far its steps are final before (fin)
#: and after each (cut). meter: what a micro-batch judges, as series of its own; b = 9999 is the last look.
_ARRIVED = f"""{_SUMMED.replace("meter AS (", "meter0 AS (").replace(", len AS (SELECT series_id, count(*) AS n FROM meter GROUP BY series_id)", "")},
rec AS (SELECT *, CAST(floor((t + CASE WHEN {_LATE} THEN {DELAY} ELSE 0 END) / {TICK}) AS INTEGER) AS b
  FROM (SELECT series_id, CAST(series_id AS BIGINT) AS s, idx, t_sec AS t, p, q FROM meter0) WHERE {_COMES}),
bt AS (SELECT series_id, b, count(*) AS c, max(t) AS high, min(t) AS low FROM rec GROUP BY ALL),
bh AS (SELECT series_id, b, max(high) OVER ({_BY}) AS high, sum(c) OVER ({_BY}) AS c, first_value(low) OVER ({_BY}) AS first_t FROM bt),
bf AS (SELECT *, CASE WHEN c >= {RULES.least_rows} THEN high - {RULES.confirm_s} END AS cut, coalesce(max(CASE WHEN c >= {RULES.least_rows} THEN high - {RULES.confirm_s} END) OVER ({_BY} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1e18) AS fin,
  lag(high) OVER ({_BY}) AS was FROM bh),
tm AS (SELECT rec.* FROM rec JOIN bf ON bf.series_id = rec.series_id AND bf.b = rec.b WHERE t > fin),
ju AS (SELECT series_id, b, fin, cut, was - {RULES.keep_s} AS since, b AS upto, first_t, was FROM bf
  UNION ALL SELECT series_id, 9999, coalesce(cut, fin), 1e18, high - {RULES.keep_s}, b, first_t, high FROM bf QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY b DESC) = 1),
mt AS (SELECT ju.series_id AS own, ju.b, tm.series_id || '@' || ju.b AS series_id, t AS t_sec, p, q FROM ju JOIN tm ON tm.series_id = ju.series_id AND (tm.b = ju.b OR tm.b <= ju.upto AND tm.b < ju.b AND t >= since)),
meter AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t_sec, p, q) - 1 AS idx FROM mt),
len AS (SELECT series_id, count(*) AS n FROM meter GROUP BY series_id)"""
_JUDGED = step_cte(_ARRIVED, RULES.steps).replace("steps AS (\n", "steps0 AS (\n") + """,
steps AS (SELECT ju.series_id, ju.b, t_sec, delta_p, delta_q, p_before, p_after FROM steps0 JOIN ju ON steps0.series_id = ju.series_id || '@' || ju.b WHERE cut IS NOT NULL AND t_sec > fin AND t_sec <= cut)"""
_CALM = lambda c: f"stddev_pop({c}) OVER w <= greatest(1.5, 0.02 * greatest(abs(avg({c}) OVER w), 1.0))"
#: sl: the first settled level of each series and its micro-batch. sd: what it ran then, if no step came before.
_SEEDS = f"""sw AS (SELECT own, b, series_id, t_sec, {_CALM('p')} OR {_CALM('sqrt(p*p + q*q)')} AS calm FROM meter WHERE b < 9999 WINDOW w AS (PARTITION BY series_id ORDER BY t_sec RANGE BETWEEN {RULES.warm_s} PRECEDING AND CURRENT ROW)),
sl AS (SELECT sw.* FROM sw JOIN ju ON ju.series_id = own AND ju.b = sw.b WHERE calm AND t_sec >= first_t + {RULES.warm_s} AND t_sec <= first_t + {RULES.give_up_s} AND coalesce(was, first_t) - first_t <= {RULES.give_up_s}
  QUALIFY row_number() OVER (PARTITION BY own ORDER BY sw.b, t_sec) = 1),
lvl AS (SELECT own AS series_id, sl.b, sl.t_sec, median(p) AS pn, median(q) AS qn FROM sl JOIN meter m USING (own, b) WHERE m.t_sec BETWEEN sl.t_sec - {RULES.warm_s} AND sl.t_sec GROUP BY ALL),
{COMBOS}, {_STANDING.replace('SELECT *, sqrt', 'SELECT *, CAST(NULL AS DOUBLE) AS tn, sqrt').replace('FROM lv)', 'FROM lvl)')},
sd AS (SELECT series_id, t_sec, CASE WHEN idle OR res > tol THEN CAST([] AS VARCHAR[]) WHEN wins THEN list_sort(members) ELSE [device] END AS active,
  CAST(CASE WHEN idle THEN 100 WHEN res > tol THEN 0 ELSE greatest(5, least(99, round_even(100.0 * (1.0 - res / tol), 0))) END AS INTEGER) AS confidence
  FROM r WHERE b <= coalesce((SELECT min(b) FROM steps WHERE steps.series_id = r.series_id), 9999)),
so0 AS (SELECT series_id, list(ord) AS ords FROM sd JOIN dev ON list_contains(active, device) GROUP BY series_id)"""
_FOLLOWED = _TRACK.replace("CAST([] AS INTEGER[]), CAST(NULL AS DOUBLE) FROM st\n", "coalesce(ords, CAST([] AS INTEGER[])), CAST(NULL AS DOUBLE) FROM st LEFT JOIN so0 USING (series_id)\n")
_ALL = f"WITH RECURSIVE {_JUDGED}, {_SEEDS}, {_FOLLOWED}"
_LATER = f"la AS (SELECT rec.series_id, t FROM rec JOIN bf ON bf.series_id = rec.series_id AND bf.b = rec.b WHERE t <= fin)"
_WAS = "wa AS (SELECT tn.*, coalesce(lag(tn.active) OVER (PARTITION BY series_id ORDER BY step_no), sd.active, []) AS was FROM tn LEFT JOIN sd USING (series_id))"
ORACLE_SQL = {
    "stream_steps": f"WITH {_JUDGED} SELECT series_id, round(t_sec, 6) + 0.0 AS t_sec, round(delta_p, 6) + 0.0 AS delta_p, round(delta_q, 6) + 0.0 AS delta_q, round(p_before, 6) + 0.0 AS p_before, round(p_after, 6) + 0.0 AS p_after FROM steps",
    "stream_late": f"WITH {_ARRIVED}, {_LATER} SELECT series_id, count(*) AS n_late, round(min(t), 6) + 0.0 AS first_t, round(max(t), 6) + 0.0 AS last_t FROM la GROUP BY series_id",
    "stream_stale": f"WITH {_ARRIVED}, {_LATER} SELECT series_id, round(max(rec.t), 6) + 0.0 AS t_sec, (SELECT count(*) FROM la WHERE la.series_id = rec.series_id) AS n_late FROM rec GROUP BY series_id",
    "stream_seeded": f"WITH {_JUDGED}, {_SEEDS} SELECT series_id, round(t_sec, 6) + 0.0 AS t_sec, array_to_string(active, '+') AS active, confidence FROM sd",
    "stream_tracker": f"{_ALL} SELECT series_id, CAST(step_no AS INTEGER) AS step_no, round(t_sec, 6) + 0.0 AS t_sec, array_to_string(active, '+') AS active, round(unknown, 6) + 0.0 AS unknown_residual FROM tn",
    "stream_events": f"""{_ALL}, {_WAS}
SELECT series_id, round(t_sec, 6) + 0.0 AS t_sec, unnest(list_filter(active, lambda x: NOT list_contains(was, x))) AS device, 'on' AS kind FROM wa
UNION ALL SELECT series_id, round(t_sec, 6) + 0.0, unnest(list_filter(was, lambda x: NOT list_contains(active, x))), 'off' FROM wa""",
    "stream_unknown": f"""{_ALL}, od AS (SELECT tn.series_id, tn.t_sec, dp, dq, p, q, unknown FROM tn JOIN st USING (series_id, step_no) WHERE unknown IS NOT NULL),
ne AS (SELECT od.*, device, row_number() OVER (PARTITION BY series_id, t_sec ORDER BY round_even(sqrt((dev.P - od.p) * (dev.P - od.p) + (dev.Q - od.q) * (dev.Q - od.q)), 2), ord) AS n FROM od, dev)
SELECT series_id, round(t_sec, 6) + 0.0 AS t_sec, round(dp, 6) + 0.0 AS delta_p, round(dq, 6) + 0.0 AS delta_q, round(unknown, 6) + 0.0 AS unknown_residual,
  CASE WHEN abs(any_value(q)) <= 0.15 * greatest(any_value(p), 1e-6) THEN 'resistive' WHEN any_value(q) > 0 THEN 'inductive' ELSE 'capacitive' END AS class, string_agg(device, '+' ORDER BY n) AS nearest
FROM ne WHERE n <= 2 GROUP BY series_id, t_sec, dp, dq, unknown""",
    "stream_latest": f"""{_ALL}, la AS (SELECT series_id, arg_max(active, step_no) AS active, max(step_no) AS steps FROM tn GROUP BY series_id)
SELECT series_id, array_to_string(coalesce(la.active, sd.active), '+') AS active, CAST(coalesce(steps, 0) AS INTEGER) AS steps FROM sd FULL JOIN la USING (series_id)""",
}
