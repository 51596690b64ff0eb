"""Window computations over ordered signals.

All frames count rows. A long series is cut into chunks of rows; each chunk also holds the rows that
its frames reach (its halo), so no window needs a whole series in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a series that one window partition holds, halo apart, and seconds where windows go by time.
CHUNK_ROWS = 1 << 20
CHUNK_SECONDS = 86_400.0


def odd_width(seconds: float, sps: int) -> int:
    return int(seconds * sps) | 1


def with_halo(df: DataFrame, before: int, after: int, rows: int = CHUNK_ROWS) -> DataFrame:
    """df with `chunk`, each row in its own chunk and in those whose frames [-before, after] reach it."""
    low, own, high = ((F.floor((F.col("idx") + shift) / rows)) for shift in (-after, 0, before))
    spread = F.filter(F.array_distinct(F.array(low, own, high)), lambda c: c >= 0)
    return df.withColumn("chunk", F.explode(spread))


def own_rows(df: DataFrame, rows: int = CHUNK_ROWS) -> DataFrame:
    return df.where(F.floor(F.col("idx") / rows) == F.col("chunk")).drop("chunk")


def frame(first: int, last: int):
    return Window.partitionBy("series_id", "chunk").orderBy("idx").rowsBetween(first, last)


def smooth(c: str, width: int) -> Column:
    """Moving mean of an odd width with zeros beyond both ends."""
    half = (width - 1) // 2
    return F.sum(c).over(frame(-half, half)) / width


def rolling_std(c: str, k: int, least: int = 3) -> Column:
    """Sample deviation over k centred rows, null with fewer than `least`."""
    ahead = (k - 1) // 2
    over = frame(-(k - 1 - ahead), ahead)
    return F.when(F.count(c).over(over) >= least, F.stddev_samp(c).over(over))


def filled(c: str) -> Column:
    """The next value that is not null, else the last one."""
    keys = Window.partitionBy("series_id", "chunk")
    so_far = (Window.unboundedPreceding, 0)
    coming = F.last(c, ignorenulls=True).over(keys.orderBy(F.col("idx").desc()).rowsBetween(*so_far))
    return F.coalesce(coming, F.last(c, ignorenulls=True).over(keys.orderBy("idx").rowsBetween(*so_far)))


def window_difference(c: str, w: int, n: Column) -> Column:
    """Mean of w rows from here less mean of w rows before, 0 where either leaves the series of n rows."""
    inside = (F.col("idx") >= w) & (F.col("idx") < n - w)
    return F.when(inside, F.avg(c).over(frame(0, w - 1)) - F.avg(c).over(frame(-w, -1))).otherwise(0.0)


def series_lengths(df: DataFrame) -> DataFrame:
    return df.groupBy("series_id").agg(F.count("*").alias("n"))


def with_length(df: DataFrame) -> DataFrame:
    """df with `n`, the rows of its series: the one that came with its positions, else counted and joined."""
    return df if "n" in df.columns else df.join(series_lengths(df), "series_id")


def sample_rates(df: DataFrame, default: int = 5) -> DataFrame:
    """(series_id, sps): rows a second from the median gap, at least 1."""
    from ..staging import staged
    from .medians import medians

    gap = F.col("t_sec") - F.lag("t_sec").over(Window.partitionBy("series_id", "chunk").orderBy("idx"))
    gaps = own_rows(with_halo(df.select("series_id", "idx", "t_sec"), 1, 0).withColumn("gap", gap)).select("series_id", "gap")
    rate = F.greatest(F.lit(1), F.bround(F.try_divide(F.lit(1.0), F.col("median"))).cast("int"))
    return medians(staged(gaps, "gaps"), {"median": "gap"}).select("series_id", F.when(F.col("median").isNotNull(), rate).otherwise(default).alias("sps"))


def islands(marked: DataFrame, most_gap: int = 0, *more: Column) -> DataFrame:
    """(series_id, first, last, more aggregates of the rows) of runs of the given rows by idx; gaps of up to
    most_gap rows are bridged. Only the marked rows come here."""
    by = Window.partitionBy("series_id").orderBy("idx")
    fresh = F.coalesce((F.col("idx") - F.lag("idx").over(by) > most_gap + 1).cast("int"), F.lit(1))
    run = F.sum("fresh").over(by.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("fresh", fresh).withColumn("run", run).groupBy("series_id", "run").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), *more).drop("run")


def spread_over(ranges: DataFrame, first: Column, last: Column, rows: int = 4096) -> DataFrame:
    """ranges, each once for every bin of `rows` positions it touches, for an equi-join by bin."""
    return ranges.withColumn("bin", F.explode(F.sequence(F.floor(first / rows), F.floor(last / rows))))


def rows_within(ranges: DataFrame, df: DataFrame, first: str, last: str, rows: int = 4096) -> DataFrame:
    """The rows of df in each range of its series, both ends included."""
    wide = spread_over(ranges.where(F.col(last) >= F.col(first)), F.col(first), F.col(last), rows)
    binned = df.withColumn("bin", F.floor(F.col("idx") / rows))
    return wide.join(binned, ["series_id", "bin"]).where(F.col("idx").between(F.col(first), F.col(last))).drop("bin")


def settled_windows(df: DataFrame, seconds: int = 5, least: float = 1.5, share: float = 0.02, chunk_s: float = CHUNK_SECONDS) -> DataFrame:
    """df with p_std, s_std over the last `seconds` and `settled`: either deviation is within
    max(least, share * mean size). A series is cut by time; each chunk also holds the `seconds` before it."""
    chunk_s = max(chunk_s, 8.0 * seconds)
    own, next_ = (F.floor((F.col("t_sec") + shift) / chunk_s) for shift in (0, seconds))
    wide = df.withColumn("_chunk", F.explode(F.array_distinct(F.array(own, next_))))
    over = Window.partitionBy("series_id", "_chunk").orderBy("t_sec").rangeBetween(-seconds, 0)
    wide = wide.withColumn("_s", F.sqrt(F.col("p") * F.col("p") + F.col("q") * F.col("q")))
    for c, name in (("p", "p_std"), ("_s", "s_std")):
        wide = wide.withColumn(f"_{name}", F.collect_list(c).over(over)).withColumn(f"_{name}_mean", F.avg(c).over(over))
    out = wide.where(own.eqNullSafe(F.col("_chunk"))).withColumns({name: deviation(f"_{name}") for name in ("p_std", "s_std")})
    calm = lambda name: F.col(name) <= F.greatest(F.lit(least), share * F.greatest(F.abs(f"_{name}_mean"), F.lit(1.0)))
    return out.withColumn("settled", calm("p_std") | calm("s_std")).drop("_chunk", "_s", *[f"_{name}{more}" for name in ("p_std", "s_std") for more in ("", "_mean")])


def deviation(values: str) -> Column:
    """Population deviation of an array without nulls, null of none. The squares grow by (x - mean before) * (x - mean
    after), value by value, so that a deviation right at a limit falls on the side that SQL engines put it."""

    def step(a: Column, x: Column) -> Column:
        n, far = a["n"] + 1.0, x - a["mean"]
        mean = a["mean"] + far / n
        return F.struct(n.alias("n"), mean.alias("mean"), (a["squares"] + far * (x - mean)).alias("squares"))

    zero = F.lit(0.0)
    return F.aggregate(values, F.struct(zero.alias("n"), zero.alias("mean"), zero.alias("squares")), step, lambda a: F.sqrt(F.try_divide(a["squares"], a["n"])))


def carried(df: DataFrame, made: dict[str, tuple], t: str = "t_sec", backward: bool = False, chunk_s: float = CHUNK_SECONDS) -> DataFrame:
    """df with further columns that look over all rows of a series up to each one (backward: from it on), by chunks of
    time. made: name to (value within the chunk, given its window of rows; the chunk's own value as an aggregate; how
    the chunks before give theirs, given a window over them; how both are joined)."""
    chunk = F.floor(F.col(t) / chunk_s)
    df = df.withColumn("_chunk", chunk)
    by = Window.partitionBy("series_id").orderBy(F.col("_chunk").desc() if backward else F.col("_chunk").asc()).rowsBetween(Window.unboundedPreceding, -1)
    inside = df.withColumns({f"_in_{name}": value for name, (value, _, _, _) in made.items()})
    chunks = df.groupBy("series_id", "_chunk").agg(*[own.alias(f"_own_{name}") for name, (_, own, _, _) in made.items()])
    before = chunks.select("series_id", "_chunk", *[far(F.col(f"_own_{name}"), by).alias(f"_far_{name}") for name, (_, _, far, _) in made.items()])
    out = inside.join(before, ["series_id", "_chunk"], "left")
    out = out.withColumns({name: both(F.col(f"_in_{name}"), F.col(f"_far_{name}")) for name, (_, _, _, both) in made.items()})
    return out.drop("_chunk", *[f"{kind}{name}" for name in made for kind in ("_in_", "_far_")])


def in_chunk(*order, first=Window.unboundedPreceding, last: int = 0):
    """The window of `carried` within a chunk."""
    return Window.partitionBy("series_id", "_chunk").orderBy(*order).rowsBetween(first, last)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df by its keys over tasks whose number does not hang on bytes, for groups of few bytes and much work: tasks cut
    by bytes would leave them together. Nothing is counted, so what df is made of runs once."""
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def every_nth(df: DataFrame, most: int = 900) -> DataFrame:
    """Stride down-sampling of each series to at most `most` rows."""
    n = series_lengths(df)
    return df.join(n, "series_id").where(F.col("idx") % F.ceil(F.col("n") / most) == 0).drop("n")


def segments(df: DataFrame, events: DataFrame, chunk_s: float = CHUNK_SECONDS) -> DataFrame:
    """df with segment_no, the number of events (series_id, t_sec) of its series before each row, counted by
    chunks of time."""
    both = df.withColumn("event", F.lit(0)).unionByName(events.select("series_id", "t_sec", F.lit(1).alias("event")), allowMissingColumns=True)
    inside = F.sum("event").over(in_chunk("t_sec", "event", last=-1))
    none = lambda c: F.coalesce(c, F.lit(0))
    made = {"segment_no": (inside, F.sum("event"), lambda c, by: F.sum(c).over(by), lambda a, b: none(a) + none(b))}
    return carried(both, made, chunk_s=chunk_s).where("event = 0").drop("event")
