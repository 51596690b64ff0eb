"""Batch sources: meter CSV files, run files by split, JSON maps and the driver's event table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import clean_name, slug
from ..schema import MEASURES, WHOLE
from ..staging import staged

#: Devices that discovery leaves out unless asked.
EXCLUDED = ["PV"]


def with_position(df: DataFrame, ts: str = "timestamp_iso", *ties: str) -> DataFrame:
    """df with idx (0-based position in its series by ts, then ties), t_sec (seconds since the first) and n (rows of the series).

    Positions are counted by day: rows are ordered within (series, day) and shifted by the running
    sum of the days before, so a series of any length spreads over as many tasks as it has days.
    """
    keys = ["series_id", "_day"]
    df = df.withColumn("_day", F.to_date(ts))
    days = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(ts).alias("_first"))
    by_day = Window.partitionBy("series_id").orderBy(F.col("_day").asc_nulls_first())
    before = F.coalesce(F.sum("_n").over(by_day.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    every = Window.partitionBy("series_id")
    days = days.select(*keys, before.alias("_before"), F.min("_first").over(every).alias("_start"), F.sum("_n").over(every).alias("n"))
    inside = Window.partitionBy(*keys).orderBy(ts, *ties)
    at = F.row_number().over(inside) - 1 + F.col("_before")
    seconds = F.timestamp_diff("MICROSECOND", F.col("_start"), F.col(ts)) / F.lit(1e6)
    return df.join(days, keys).withColumns({"idx": at.cast("long"), "t_sec": seconds}).drop("_day", "_before", "_start")


def _number(name: str, kind: str) -> Column:
    value = F.col(name).try_cast("double")
    value = F.when(~F.isnan(value), value)
    return (value.try_cast("int") if kind == "int" else value).alias(name)


#: A comma outside of quotes.
_COMMA = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'
#: Texts that count as missing.
MISSING = ["", "nan", "null", "none", "n/a", "na"]


def _cells(line: str) -> Column:
    """The trimmed fields of a line; quoted ones may hold commas and doubled quotes."""
    bare = lambda c: F.when(c.startswith('"') & c.endswith('"') & (F.length(c) > 1), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c)
    return F.transform(F.split(line, _COMMA), lambda c: F.trim(bare(F.trim(F.regexp_replace(c, "^\ufeff", "")))))


def _lines(spark: SparkSession, path: str, *needed: str) -> DataFrame:
    """series_id (the file), _line, _names (of its header) and _cells of each line below a header that has the needed columns."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("series_id"), F.monotonically_increasing_id().alias("_line"), "value")
    filled = staged(lines.where(F.trim("value") != ""), "lines")  # many small files are opened once
    head = filled.groupBy("series_id").agg(F.min_by("value", "_line").alias("_head"), F.min("_line").alias("_at"))
    head = head.withColumn("_names", _cells("_head"))
    for name in needed:
        head = head.where(F.array_contains("_names", name))
    return filled.join(head, "series_id").where(F.col("_line") > F.col("_at")).select("series_id", "_line", "_names", _cells("value").alias("_cells"))


def _cell(name: str) -> Column:
    """A line's field by its header's name, null where it is missing."""
    got = F.try_element_at("_cells", F.array_position("_names", name).cast("int"))
    return F.when(F.array_contains("_names", name) & ~F.lower(got).isin(MISSING), got).alias(name)


def read_recordings(spark: SparkSession, path: str) -> DataFrame:
    """All meter files under path as METER_SCHEMA.

    Header names are trimmed; files without device_name and p_total_w have no rows; rows without a
    good timestamp or with no power at all go; bad numbers are null, a power that is none too; the
    device's name is the first one that is not null in the order of time. Fields may be quoted. Equal
    timestamps keep the order of the file's lines.
    """
    raw = _lines(spark, path, "device_name", "p_total_w").select("series_id", "_line", *[_cell(c) for c in ["timestamp_iso", "device_name", "run_id", *WHOLE, *MEASURES]])
    good = raw.where("p_total_w IS NOT NULL").select(
        "series_id", "_line", F.try_to_timestamp("timestamp_iso").alias("timestamp_iso"), "device_name", "run_id",
        *[_number(c, "int") for c in WHOLE], *[_number(c, "double") for c in MEASURES],
    ).where("timestamp_iso IS NOT NULL")
    good = staged(good, "recordings")
    named = F.expr("min_by(device_name, struct(timestamp_iso, _line)) FILTER (WHERE device_name IS NOT NULL)")
    name = good.groupBy("series_id").agg(clean_name(named).alias("device_name"))
    placed = with_position(good.drop("device_name").join(name, "series_id"), "timestamp_iso", "_line")
    order = ["series_id", "timestamp_iso", "device_name", "run_id", "sample_interval_ms", *MEASURES, "block_time_difference_ms", "idx", "t_sec"]
    return placed.select(*order)


def read_plain(spark: SparkSession, path: str) -> DataFrame:
    """The lighter scan for calibration: (series_id, idx, t_sec, p, q), rows without either power dropped."""
    rows = read_recordings(spark, path).where("p_total_w IS NOT NULL AND q_total_var IS NOT NULL")
    return rows.select("series_id", "idx", "t_sec", F.col("p_total_w").alias("p"), F.col("q_total_var").alias("q"))


def discover(spark: SparkSession, path: str, include_excluded: bool = False) -> DataFrame:
    """(device, path) of the recordings under path. A file's device is the first name in the order of its
    lines; only names are read from it. Files without one are left out; of files of one device the
    last by name stays."""
    names = _lines(spark, path, "device_name").select("series_id", "_line", _cell("device_name")).where("device_name IS NOT NULL")
    found = names.groupBy("series_id").agg(clean_name(F.min_by("device_name", "_line")).alias("device"))
    if not include_excluded:
        found = found.where(~F.col("device").isin(EXCLUDED))
    return found.groupBy("device").agg(F.max("series_id").alias("path"))


#: How run files are named, and their splits' tags.
RUN_FILES = "pac4200_{slug}_{tag}_*.csv"
TAGS = {"training": "train", "testing": "test"}


def find_runs(spark: SparkSession, folder: str, devices: list[str], split: str = "training", per_device: int | None = None) -> DataFrame:
    """(device, path) of the run files of a site's devices in folder/split, the first per_device by name."""
    tag = TAGS.get(split, "test")
    files = spark.read.format("binaryFile").load(f"{folder.rstrip('/')}/{split}/{RUN_FILES.format(slug='*', tag=tag)}").select("path")
    own = F.regexp_extract(F.element_at(F.split("path", "/"), -1), f"^pac4200_(.*)_{tag}_[^_]*\\.csv$", 1)
    named = spark.createDataFrame([(d,) for d in devices], "device string").withColumn("slug", slug("device"))
    return run_files(files.withColumn("slug", own).join(F.broadcast(named), "slug").select("device", "path"), per_device)


def run_files(files: DataFrame, per_device: int | None = None) -> DataFrame:
    """The first per_device paths of each device. files: device, path."""
    if per_device is None:
        return files
    return files.withColumn("_n", F.row_number().over(Window.partitionBy("device").orderBy("path"))).where(F.col("_n") <= per_device).drop("_n")


def read_json_map(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """A whole-file JSON object of objects as rows (device, fields...); `fields` is the inner DDL."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.explode(F.from_json("value", f"MAP<STRING, STRUCT<{fields}>>")).alias("device", "v"))
    return rows.select("device", "v.*")


def signal(recordings: DataFrame) -> DataFrame:
    """What detectors read, of recordings. A null distortion stays null."""
    return recordings.select("series_id", "idx", "t_sec", F.col("p_total_w").alias("p"), F.col("q_total_var").alias("q"), F.col("thd_i_l1_percent").alias("thd"))


def meter_view(events: DataFrame) -> DataFrame:
    """The driver's event table as one signal per user: p = value, q = props.k - 50, no distortion."""
    rows = events.select(F.col("user_id").cast("string").alias("series_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("value").alias("p"), (F.get_json_object("props", "$.k").cast("int") - 50).cast("double").alias("q"))
    return with_position(rows, "ts", "event_id").select("series_id", "idx", "t_sec", "n", "p", "q", F.lit(None).cast("double").alias("thd"))
