"""Queries of made recordings, plans of signals and false alarms; every random number is a hash that SQL repeats."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import learning, synthesis
from ..schema import devices, devices_sql
from .models import _MEANS, rows_of
from .signal import rounded

SEED = 7
RUNS = 2
#: Made numbers go through logarithms and cosines; they are rounded to so many digits.
DIGITS = 4


def _prints(spark, sf_dir):
    """A fingerprint for each supplier, by a rule; one of them has two speeds."""
    s = F.col("s_suppkey")
    rule = {
        "on_p_mean": 20 + F.abs(F.col("s_acctbal").cast("double")), "on_p_std": s % 7 / 10, "on_q_mean": (s % 90).cast("double"), "on_q_std": 1.0 + s % 3, "on_thd_i_mean": 5.0 + s % 20, "on_thd_i_std": (s % 2).cast("double"),
        "on_thd_u_mean": (s % 2).cast("double"), "voltage_mean": 229.0 + s % 3, "inrush_ratio": 1 + s % 4 / 5,
    }
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.when(s == 5, "Mixer").otherwise(s.cast("string")).alias("device"), *[c.alias(n) for n, c in rule.items()])


def synthetic_runs(spark, sf_dir):
    out = synthesis.synthetic_runs(_prints(spark, sf_dir), RUNS, SEED)
    return rounded(out, "t_sec", "u", "i", "p", "s", "q", "pf", "frequency", "thd_u", "thd_i", digits=DIGITS)


def run_manifest(spark, sf_dir):
    return synthesis.manifest(synthesis.synthetic_runs(_prints(spark, sf_dir), RUNS, SEED), SEED)


def signal_plans(spark, sf_dir):
    signals = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("long").alias("id"))
    return synthesis.signal_plans(spark, devices(spark), signals, SEED)


def device_shares(spark, sf_dir):
    """The noise of each running device, over the plans of all suppliers' signals."""
    signals = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("id"))
    made = synthesis.device_shares(synthesis.signal_plans(spark, devices(spark), signals, SEED), devices(spark), SEED)
    return rounded(made, "p", "q", "i", "thd", digits=DIGITS)


def false_alarms(spark, sf_dir):
    return learning.false_alarms(learning.label_means(rows_of(spark, sf_dir)))


QUERIES = {"synthetic_runs": synthetic_runs, "run_manifest": run_manifest, "signal_plans": signal_plans, "device_shares": device_shares, "false_alarms": false_alarms}


def _hash(*keys) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(map(str, keys))})), 1, 15) AS BIGINT)"


def _uniform(low: float, high: float, *keys) -> str:
    return f"({low!r}::DOUBLE + {high - low!r}::DOUBLE * ((CAST({_hash(*keys)} >> 7 AS DOUBLE) + 0.5::DOUBLE) / {float(1 << 53)!r}::DOUBLE))"


def _normal(mean: str, std: str, *keys) -> str:
    far, turn = _uniform(0.0, 1.0, *keys, "'far'"), _uniform(0.0, 2 * math.pi, *keys, "'turn'")
    return f"({mean} + {std} * sqrt(-2 * ln({far})) * cos({turn}))"


def _round(*names: str) -> str:
    return ", ".join(f"round({n}, {DIGITS}) + 0.0 AS {n}" for n in names)


def _of(name: str, *more: str) -> tuple:
    return ("ss", f"'{name}'", *more)


_START, _LASTS = _uniform(*synthesis.START_S, *_of("start")), _uniform(*synthesis.LASTS_S, *_of("lasts"))
_LEVEL = "(1 + 0.05::DOUBLE * {})"
_P_SPEED = f"CASE WHEN two THEN CASE WHEN a < turn THEN {_uniform(*synthesis.SLOW, *_of('slow'))} ELSE {_uniform(*synthesis.FAST, *_of('fast'))} END ELSE {_LEVEL.format(_normal('0', '1', *_of('p')))} END"
_Q_LEVEL = f"CASE WHEN two THEN 1 ELSE {_LEVEL.format(_normal('0', '1', *_of('q')))} END"
_RUN_CTE = f"""fp AS (SELECT CASE WHEN s_suppkey = 5 THEN 'Mixer' ELSE CAST(s_suppkey AS VARCHAR) END AS device, 20 + abs(CAST(s_acctbal AS DOUBLE)) AS p_mean, s_suppkey % 7 / 10 AS p_std, CAST(s_suppkey % 90 AS DOUBLE) AS q_mean,
  CAST(1 + s_suppkey % 3 AS DOUBLE) AS q_std, CAST(5 + s_suppkey % 20 AS DOUBLE) AS i_mean, CAST(s_suppkey % 2 AS DOUBLE) AS i_std, CAST(s_suppkey % 2 AS DOUBLE) AS u_mean, CAST(229 + s_suppkey % 3 AS DOUBLE) AS volts, 1 + s_suppkey % 4 / 5 AS inrush FROM supplier),
w0 AS (SELECT *, {_hash(SEED, 'device', 'run')} AS ss, device = 'Mixer' AS two FROM fp, range({RUNS}) r(run)),
w1 AS (SELECT *, CAST(floor({_uniform(*synthesis.RUN_S, *_of('total'))} * 5) AS INTEGER) AS total, CAST(floor({_START} * 5) AS INTEGER) AS from_, CAST(floor(({_START} + {_LASTS}) * 5) AS INTEGER) AS until0 FROM w0),
w2 AS (SELECT *, least(until0, total - 5) AS until_ FROM w1),
w3 AS (SELECT *, greatest(5, least((until_ - from_) // 2 + {_hash(*_of('turn'))} % 11 - 5, until_ - from_ - 5)) AS turn FROM w2),
ro AS (SELECT *, idx - from_ AS a, idx >= from_ AND idx < until_ AS up, NOT two AND inrush > 1.05 AND until_ - from_ > 1 AND idx = from_ AS rush FROM w3, range(600) g(idx) WHERE idx < total)"""
_ON_P = f"""CASE WHEN NOT up THEN 0 WHEN two AND (a = 0 OR a = turn) THEN p_mean * inrush * {_uniform(*synthesis.SPIKE_SPREAD, *_of('spike', 'idx'))} WHEN rush THEN p_mean * inrush * {_uniform(*synthesis.INRUSH_SPREAD, *_of('spike', 'idx'))}
  ELSE {_normal(f'p_mean * {_P_SPEED}', 'greatest(p_std, 0.01)', *_of('p', 'idx'))} END"""
_ON_Q = f"""CASE WHEN NOT up THEN 0 WHEN rush AND q_mean > 30 THEN q_mean * 1.4 * {_uniform(*synthesis.INRUSH_SPREAD, *_of('q_spike', 'idx'))} ELSE {_normal(f'q_mean * {_Q_LEVEL}', 'greatest(q_std, 0.01)', *_of('q', 'idx'))} END"""
_SITE = f"""{devices_sql()}, ids AS (SELECT {{key}} AS id FROM {{table}}),
sh AS (SELECT id, ord, sqrt(P*P + Q*Q) / 230.0 AS i, row_number() OVER (PARTITION BY id ORDER BY {_hash(SEED, 'id', 'ord')}, sqrt(P*P + Q*Q), ord) AS n FROM ids, dev),
wa AS (SELECT id, 1 + {_hash(SEED, 'id', "'want'")} % (CASE WHEN id % 2 = 0 THEN 4 ELSE 3 END) AS want FROM ids),
rc(id, n, used, taken) AS (SELECT id, CAST(0 AS BIGINT), CAST(0 AS DOUBLE), CAST([] AS INTEGER[]) FROM ids UNION ALL
  SELECT rc.id, rc.n + 1, CASE WHEN len(taken) < want AND used + i <= 6.0 THEN used + i ELSE used END, CASE WHEN len(taken) < want AND used + i <= 6.0 THEN list_append(taken, ord) ELSE taken END FROM rc JOIN wa USING (id) JOIN sh ON sh.id = rc.id AND sh.n = rc.n + 1),
tk AS (SELECT id, CASE WHEN len(taken) > 0 THEN taken ELSE (SELECT [arg_min(ord, (sqrt(P*P + Q*Q), ord))] FROM dev) END AS taken FROM rc WHERE n = (SELECT count(*) FROM dev)),
pk AS (SELECT id, unnest(taken) AS ord, generate_subscripts(taken, 1) - 1 AS k, len(taken) AS m, id % 2 = 1 AS shared, (20 + 18 * len(taken)) * 5 AS total FROM tk),
on0 AS (SELECT *, total // (m + 2) AS gap, CASE WHEN shared THEN -1 ELSE ord END AS jo FROM pk),
on1 AS (SELECT *, greatest(2, least(CASE WHEN shared THEN total // 3 ELSE gap * (k + 1) END + {_hash(SEED, 'id', 'jo', "'on'")} % 7 - 3, total - 6)) AS on_idx FROM on0),
pn AS (SELECT id, CASE WHEN shared THEN 'simultaneous' ELSE 'sequential' END AS mode, CAST(total AS INTEGER) AS total, ord, CAST(on_idx AS INTEGER) AS on_idx,
  CAST(least(greatest(total - CASE WHEN shared THEN total // 4 ELSE gap // 2 + (m - k) * (gap // 3) END + {_hash(SEED, 'id', 'jo', "'off'")} % 7 - 3, on_idx + 4), total - 2) AS INTEGER) AS off_idx FROM on1)"""
ORACLE_SQL = {
    "synthetic_runs": f"""WITH {_RUN_CTE}, pq AS (SELECT *, {_ON_P} AS p, {_ON_Q} AS q, {_normal('volts', '0.4::DOUBLE', *_of('u', 'idx'))} AS u FROM ro),
va AS (SELECT *, sqrt(p*p + q*q) AS s FROM pq),
ch AS (SELECT device, run, idx, sum({_normal('0.2::DOUBLE', '0.005::DOUBLE', *_of('gap', 'idx'))}) OVER (PARTITION BY device, run ORDER BY idx) AS t_sec, u, CASE WHEN up THEN s / u ELSE 0 END AS i, p, s, q, CASE WHEN up AND s <> 0 THEN p / s END AS pf,
  {_normal('50.01::DOUBLE', '0.012::DOUBLE', *_of('frequency', 'idx'))} AS frequency, {_normal('CASE WHEN u_mean > 0 THEN u_mean ELSE 1.7::DOUBLE END', '0.05::DOUBLE', *_of('thd_u', 'idx'))} AS thd_u,
  CASE WHEN up THEN greatest(0.1::DOUBLE, {_normal('i_mean', 'greatest(i_std, 0.01)', *_of('thd_i', 'idx'))}) END AS thd_i FROM va)
SELECT device, CAST(run AS INTEGER) AS run, CAST(idx AS INTEGER) AS idx, {_round('t_sec', 'u', 'i', 'p', 's', 'q', 'pf', 'frequency', 'thd_u', 'thd_i')} FROM ch""",
    "run_manifest": f"WITH {_RUN_CTE} SELECT device, CAST(run AS INTEGER) AS run, count(*) AS n_samples, ss AS seed FROM ro GROUP BY ALL",
    "signal_plans": f"WITH RECURSIVE {_SITE.format(key='c_custkey', table='customer')} SELECT CAST(id AS VARCHAR) AS series_id, mode, total, ord, device, on_idx, off_idx FROM pn JOIN dev USING (ord)",
    "device_shares": f"""WITH RECURSIVE {_SITE.format(key='s_suppkey', table='supplier')}, rw AS (SELECT id, ord, idx, P, Q, thd_i FROM pn JOIN dev USING (ord), range(500) g(idx) WHERE idx >= on_idx AND idx < off_idx)
SELECT CAST(id AS VARCHAR) AS series_id, ord, CAST(idx AS INTEGER) AS idx, round({_normal('P', '1', SEED, 'id', 'ord', 'idx', "'p'")}, {DIGITS}) + 0.0 AS p, round({_normal('Q', '1', SEED, 'id', 'ord', 'idx', "'q'")}, {DIGITS}) + 0.0 AS q,
  round(sqrt(P*P + Q*Q) / 230.0, {DIGITS}) + 0.0 AS i, round(thd_i, {DIGITS}) + 0.0 AS thd FROM rw""",
    "false_alarms": f"""WITH {_MEANS}, ft AS (SELECT pos, avg(x) AS m, CASE WHEN stddev_pop(x) = 0 THEN 1 ELSE stddev_pop(x) END AS s, coalesce(stddev_samp(x), 0) AS dev FROM mn GROUP BY pos), z AS (SELECT label, pos, (x - m) / s AS z FROM mn JOIN ft USING (pos)),
d2 AS (SELECT a.label, b.label AS l2, sqrt(sum((a.z - b.z) * (a.z - b.z))) AS d FROM z a JOIN z b ON a.pos = b.pos AND a.label <> b.label GROUP BY ALL), t AS (SELECT median(d) + 2 * stddev_pop(d) AS threshold FROM (SELECT label, min(d) AS d FROM d2 GROUP BY label)),
q AS (SELECT label AS held, repeat, pos, (x + {_normal('0', '(0.05::DOUBLE * dev)', 0, 'label', 'pos', 'repeat')} - m) / s AS zo FROM mn JOIN ft USING (pos), range(20) r(repeat)),
n AS (SELECT held, repeat, min(d) AS nearest FROM (SELECT held, repeat, label, sqrt(sum((z - zo) * (z - zo))) AS d FROM q JOIN z USING (pos) GROUP BY ALL) GROUP BY ALL)
SELECT held AS label, count(*) FILTER (nearest > threshold) AS alarms, count(*) AS n FROM n, t GROUP BY held""",
}
