"""Synthetic recordings: single-device runs from fingerprints, and sums of several devices with truth.

Every random number is a hash of the seed and of what it stands for (a run, a row, a channel), so runs
and signals are column expressions: work spreads over tasks, and any part can be made again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rate, voltage, and the current that a circuit carries.
SPS = 5
VOLTS = 230.0
MOST_AMPS = 6.0
#: Fixed values of a run: seconds in all, before and while it is on; rows after it at least; deviation of a
#: gap between rows; deviations of a run's level, of voltage, frequency and both distortions; least deviations.
RUN_S, START_S, LASTS_S, TAIL_ROWS, GAP_STD = (70, 110), (15, 30), (20, 60), 5, 0.005
LEVEL_STD, VOLT_STD, HERTZ, HERTZ_STD, THD_U, THD_U_STD, LEAST_THD, LEAST_STD = 0.05, 0.4, 50.01, 0.012, 1.7, 0.05, 0.1, 0.01
#: Fixed values of inrush: ratio from which there is one, its spread; reactive inrush and from which var.
INRUSH_FROM, INRUSH_SPREAD, Q_INRUSH, Q_INRUSH_FROM = 1.05, (0.9, 1.1), 1.4, 30
#: Devices with two speeds, their shares of the mean level, and the spread of their spikes.
TWO_SPEEDS, SLOW, FAST, SPIKE_SPREAD = ["Mixer"], (0.55, 0.75), (1.25, 1.45), (0.85, 1.15)
#: Fixed values of a signal: seconds in all and per device, jitter in rows.
SIGNAL_S, PER_DEVICE_S, JITTER = 20, 18, 3
MODES = ("sequential", "simultaneous")
#: What tells the two uniform numbers of a normal one apart.
PARTS = ("far", "turn")
#: Signals or runs that one task makes.
SIGNALS_A_TASK = 250


def spread(df: DataFrame, *keys: str, rows: int = SIGNALS_A_TASK) -> DataFrame:
    """df dealt by its keys over so many tasks that each takes about `rows` of its rows. For rows of few bytes and much work:
    tasks that are cut by bytes would leave them together."""
    tasks = 4 * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(tasks, -(-df.count() // rows)), *keys)


def hashed(*keys) -> Column:
    """A whole number of 60 bits that depends on the keys alone; names are columns, as any SQL engine can repeat it."""
    text = F.concat_ws("|", *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _share(number: Column) -> Column:
    return (F.shiftright(number, 7).cast("double") + 0.5) / float(1 << 53)


def uniform(low: float, high: float, *keys) -> Column:
    """A number in (low, high) that depends on the keys alone."""
    return low + (high - low) * _share(hashed(*keys))


def _normal_of(mean, std, far: Column, turn: Column) -> Column:
    """A normal number of two uniform ones in (0, 1)."""
    return mean + std * F.sqrt(-2 * F.log(far)) * F.cos(2 * math.pi * turn)


def normal(mean, std, *keys) -> Column:
    """A normal number that depends on the keys alone."""
    return _normal_of(mean, std, *[uniform(0.0, 1.0, *keys, F.lit(part)) for part in PARTS])


def _sub_seed(seed: int) -> Column:
    return hashed(F.lit(seed), "device", "run")


def synthetic_runs(fingerprints: DataFrame, runs: int, seed: int) -> DataFrame:
    """`runs` recordings of each device: device, run, idx, t_sec, u, i, p, s, q, pf, frequency, thd_u, thd_i.

    A run is off, on around its device's mean, and off again; pf and thd_i are null while it is off.
    fingerprints: device, on_p_mean, on_p_std, on_q_mean, on_q_std, on_thd_i_mean, on_thd_i_std,
    on_thd_u_mean, voltage_mean, inrush_ratio.
    """
    c = F.col
    of_run = lambda name: (c("sub_seed"), F.lit(name))
    of_row = lambda name: (c("sub_seed"), F.lit(name), c("idx"))
    rows = lambda seconds: F.floor(seconds * SPS).cast("int")
    wanted = fingerprints.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    wanted = spread(wanted, "device", "run").withColumn("sub_seed", _sub_seed(seed))
    start, lasts = uniform(*START_S, *of_run("start")), uniform(*LASTS_S, *of_run("lasts"))
    wanted = wanted.withColumn("total", rows(uniform(*RUN_S, *of_run("total"))))
    wanted = wanted.withColumns({"on": rows(start), "off": F.least(rows(start + lasts), c("total") - TAIL_ROWS)})
    half = F.floor((c("off") - c("on")) / 2) + F.pmod(hashed(*of_run("turn")), F.lit(2 * SPS + 1)) - SPS
    wanted = wanted.withColumn("turn", F.greatest(F.lit(5), F.least(half, c("off") - c("on") - 5)))
    level = lambda name: 1 + LEVEL_STD * normal(0.0, 1.0, *of_run(name))
    # what holds for a whole run is made before its rows are
    wanted = wanted.withColumns({"slow": uniform(*SLOW, *of_run("slow")), "fast": uniform(*FAST, *of_run("fast")), "level_p": level("p"), "level_q": level("q")})
    every = wanted.withColumn("idx", F.explode(F.sequence(F.lit(0), c("total") - 1)))

    at, two = c("idx") - c("on"), c("device").isin(TWO_SPEEDS)
    runs_now = (at >= 0) & (c("idx") < c("off"))
    # a row's chances come as one array: spelled out in the expressions that use them they are more code than the JVM compiles
    always, names = 4, ["u", "gap", "frequency", "thd_u", "p", "q", "thd_i"]
    numbers = [hashed(*of_row(name), F.lit(part)) for name in names for part in PARTS]
    numbers = [n if k < always * len(PARTS) else F.when(runs_now, n) for k, n in enumerate(numbers)]
    every = every.withColumn("chances", F.transform(F.array(*numbers), _share))
    noisy = lambda mean, std, name: _normal_of(mean, std, *[F.get("chances", F.lit(len(PARTS) * names.index(name) + k)) for k in range(len(PARTS))])
    std = lambda name: F.greatest(c(name), F.lit(LEAST_STD))
    speed = F.when(at < c("turn"), c("slow")).otherwise(c("fast"))
    rushes = (c("inrush_ratio") > INRUSH_FROM) & (c("off") - c("on") > 1) & (at == 0)
    spike = lambda spread: c("on_p_mean") * c("inrush_ratio") * uniform(*spread, *of_row("spike"))
    p_on = F.when(two & ((at == 0) | (at == c("turn"))), spike(SPIKE_SPREAD)).when(~two & rushes, spike(INRUSH_SPREAD)).otherwise(noisy(c("on_p_mean") * F.when(two, speed).otherwise(c("level_p")), std("on_p_std"), "p"))
    q_rush = c("on_q_mean") * Q_INRUSH * uniform(*INRUSH_SPREAD, *of_row("q_spike"))
    q_on = F.when(~two & rushes & (c("on_q_mean") > Q_INRUSH_FROM), q_rush).otherwise(noisy(c("on_q_mean") * F.when(two, 1.0).otherwise(c("level_q")), std("on_q_std"), "q"))
    out = every.withColumns({"p": F.when(runs_now, p_on).otherwise(0.0), "q": F.when(runs_now, q_on).otherwise(0.0), "u": noisy(c("voltage_mean"), VOLT_STD, "u")})
    s = F.hypot("p", "q")
    so_far = Window.partitionBy("device", "run").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return out.select(
        "device", "run", "idx", F.sum(noisy(1 / SPS, GAP_STD, "gap")).over(so_far).alias("t_sec"), "u", F.when(runs_now, s / c("u")).otherwise(0.0).alias("i"), "p", s.alias("s"), "q",
        F.when(runs_now, F.try_divide(c("p"), s)).alias("pf"), noisy(HERTZ, HERTZ_STD, "frequency").alias("frequency"),
        noisy(F.when(c("on_thd_u_mean") > 0, c("on_thd_u_mean")).otherwise(THD_U), THD_U_STD, "thd_u").alias("thd_u"),
        F.when(runs_now, F.greatest(F.lit(LEAST_THD), noisy(c("on_thd_i_mean"), std("on_thd_i_std"), "thd_i"))).alias("thd_i"),
    )


def manifest(runs: DataFrame, seed: int) -> DataFrame:
    """(device, run, seed, n_samples) of synthetic runs."""
    return runs.groupBy("device", "run").agg(F.count("*").alias("n_samples")).withColumn("seed", _sub_seed(seed))


def feasible(entries: Column, want: Column, amps: float = MOST_AMPS) -> Column:
    """Of an array of devices {turn, i, ord, device}, in its order, up to `want` whose currents fit together;
    the one of least current if none does."""
    start = F.struct(F.lit(0.0).alias("used"), F.slice(entries, 1, 0).alias("taken"))

    def step(state: Column, d: Column) -> Column:
        fits = (F.size(state["taken"]) < want) & (state["used"] + d["i"] <= amps)
        return F.struct(F.when(fits, state["used"] + d["i"]).otherwise(state["used"]).alias("used"), F.when(fits, F.array_append(state["taken"], d)).otherwise(state["taken"]).alias("taken"))

    taken = F.aggregate(entries, start, step, lambda state: state["taken"])
    least = F.array_min(F.transform(entries, lambda d: F.struct(d["i"].alias("i"), d["ord"].alias("ord"), d.alias("d"))))["d"]
    return F.when(F.size(taken) > 0, taken).otherwise(F.array(least))


def signal_plans(spark: SparkSession, devices: DataFrame, n: int | DataFrame, seed: int, most: tuple[int, int] = (4, 3)) -> DataFrame:
    """series_id, mode, total, ord, device, on_idx, off_idx: which devices run in each of n signals (or in
    each `id` of a table), from and until (excluded) which row; modes alternate. Sequential devices come on one after the other and go
    off likewise, simultaneous ones share their times. devices: ord, device, P, Q; a site's table, of which
    matching checks the size.
    """
    from .matching import folded, with_constant
    from .steps import once

    c = F.col
    site = folded(devices.select("ord", "device", (F.hypot("P", "Q") / VOLTS).alias("i")), "site")
    ids = n.select("id") if isinstance(n, DataFrame) else spark.range(n)
    ids = ids.repartition(4 * spark.sparkContext.defaultParallelism, "id")  # few bytes an id, much work
    signals = with_constant(ids.withColumn("mode", F.when(c("id") % 2 == 0, MODES[0]).otherwise(MODES[1])), site)
    shuffled = F.array_sort(F.transform("site", lambda d: F.struct(hashed(F.lit(seed), c("id"), d["ord"]).alias("turn"), d["i"].alias("i"), d["ord"].alias("ord"), d["device"].alias("device"))))
    limit = F.when(c("id") % 2 == 0, most[0]).otherwise(most[1])
    want = 1 + F.pmod(hashed(F.lit(seed), c("id"), F.lit("want")), limit)
    picked = once(once(signals, entries=shuffled, want=want), combo=feasible(c("entries"), c("want"))).select("id", "mode", "combo", F.size("combo").alias("m"))
    runs = picked.select("id", "mode", "m", ((SIGNAL_S + PER_DEVICE_S * c("m")) * SPS).cast("int").alias("total"), F.posexplode("combo").alias("k", "d"))
    whole = lambda x: F.floor(x).cast("int")
    gap = whole(c("total") / (c("m") + 2))
    shared = c("mode") == MODES[1]
    jitter = lambda end: (F.pmod(hashed(F.lit(seed), c("id"), F.when(shared, -1).otherwise(c("d.ord")), F.lit(end)), F.lit(2 * JITTER + 1)) - JITTER).cast("int")
    on = F.when(shared, whole(c("total") / 3)).otherwise(gap * (c("k") + 1)) + jitter("on")
    off = c("total") - F.when(shared, whole(c("total") / 4)).otherwise(whole(gap / 2) + (c("m") - c("k")) * whole(gap / 3)) + jitter("off")
    runs = runs.withColumn("on_idx", F.greatest(F.lit(2), F.least(on, c("total") - 6)))
    off = F.least(F.greatest(off, c("on_idx") + 4), c("total") - 2)
    return runs.select(c("id").cast("string").alias("series_id"), "mode", "total", "d.ord", "d.device", "on_idx", off.alias("off_idx"))


def device_shares(plan: DataFrame, devices: DataFrame, seed: int, noise_w: float = 1.0) -> DataFrame:
    """series_id, ord, idx, p, q, i, thd: each running device's power at each row of its signal, with normal noise."""
    rows = plan.select("series_id", "ord", "on_idx", "off_idx").join(devices.select("ord", "P", "Q", "thd_i"), "ord").withColumn("idx", F.explode(F.sequence("on_idx", F.col("off_idx") - 1)))
    at = lambda name: (F.lit(seed), "series_id", "ord", "idx", F.lit(name))
    return rows.select("series_id", "ord", "idx", normal(F.col("P"), noise_w, *at("p")).alias("p"), normal(F.col("Q"), noise_w, *at("q")).alias("q"), (F.hypot("P", "Q") / VOLTS).alias("i"), F.col("thd_i").alias("thd"))


def sampled(files: DataFrame, n: int = 5, seed: int = 42) -> DataFrame:
    """n rows of each device, drawn without replacement by the hash of (seed, path). files: device, path."""
    by = Window.partitionBy("device").orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "path")), "path")
    return files.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= n).drop("_n")


def summed(plan: DataFrame, shares: DataFrame) -> DataFrame:
    """One row per row of each signal: sums of power, distortion weighted by current, apparent power,
    current and power factor, null where nothing runs, and n, the rows of the signal."""
    every = plan.groupBy("series_id").agg(F.max("total").alias("total")).select("series_id", F.explode(F.sequence(F.lit(0), F.col("total") - 1)).alias("idx"), F.col("total").cast("long").alias("n"))
    # a plan that comes dealt by series_id stays so: no row moves, neither here nor for windows over the signals
    both = shares.select("series_id", "idx", "p", "q", "thd", "i").unionByName(every, allowMissingColumns=True)
    sums = both.groupBy("series_id", "idx").agg(F.sum("p").alias("p"), F.sum("q").alias("q"), F.sum(F.col("thd") * F.col("i")).alias("ti"), F.sum("i").alias("ii"), F.max("n").alias("n"))
    out = sums.where("n IS NOT NULL").na.fill(0.0, ["p", "q"])
    s = F.hypot("p", "q")
    return out.select("series_id", F.col("idx").cast("long").alias("idx"), (F.col("idx") / SPS).alias("t_sec"), "n", "p", "q", F.when(F.col("ii") > 1e-6, F.col("ti") / F.col("ii")).alias("thd"), s.alias("s"), (s / VOLTS).alias("i"), F.when(s > 1e-6, F.try_divide(F.col("p"), s)).alias("pf"))


def truth_events(plan: DataFrame, devices: DataFrame) -> DataFrame:
    """(series_id, t_sec, device, kind, delta_p, delta_q): what is switched when."""
    both = plan.join(devices.select("ord", "P", "Q"), "ord")
    e = F.explode(F.array(F.struct(F.col("on_idx").alias("at"), F.lit("on").alias("kind"), F.lit(1.0).alias("sign")), F.struct(F.col("off_idx").alias("at"), F.lit("off").alias("kind"), F.lit(-1.0).alias("sign"))))
    return both.select("series_id", "device", "P", "Q", e.alias("e")).select("series_id", (F.col("e.at") / SPS).alias("t_sec"), "device", "e.kind", (F.col("e.sign") * F.col("P")).alias("delta_p"), (F.col("e.sign") * F.col("Q")).alias("delta_q"))


def active_sets(plan: DataFrame, changes: bool = False) -> DataFrame:
    """(series_id, t, active): the true set at every row, empty ones included. A signal's runs, as few as its devices,
    travel with its rows, which meet by no join. With `changes` only the rows after which a set may change and the last
    one: looking for the first row at or after a time finds the same set among them as among all."""
    runs = F.collect_list(F.struct("device", "on_idx", "off_idx"))
    each = plan.groupBy("series_id").agg(F.max("total").alias("total"), runs.alias("runs"))
    every = F.sequence(F.lit(0), F.col("total") - 1)
    ends = F.concat(F.flatten(F.transform("runs", lambda r: F.array(r["on_idx"] - 1, r["off_idx"] - 1))), F.array(F.col("total") - 1))
    ends = F.array_distinct(F.filter(ends, lambda i: (i >= 0) & (i < F.col("total"))))
    rows = each.select("series_id", "runs", F.explode(ends if changes else every).alias("idx"))
    now = F.filter("runs", lambda r: (r["on_idx"] <= F.col("idx")) & (F.col("idx") < r["off_idx"]) & r["device"].isNotNull())
    return rows.select("series_id", (F.col("idx") / SPS).alias("t"), F.array_sort(F.array_distinct(F.transform(now, lambda r: r["device"]))).alias("active"))
