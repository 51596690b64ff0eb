"""Writers of recordings, maps, summaries and runs. All go through Spark's writers, into any store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import slug


def write_recordings(recordings: DataFrame, path: str) -> None:
    """Cleaned recordings as Parquet, a folder per device."""
    recordings.withColumn("device_slug", slug("device_name")).repartition("device_slug", F.pmod(F.floor(F.col("idx") / 1_000_000), F.lit(64))).write.mode("overwrite").partitionBy("device_slug").parquet(path)


def write_runs(runs: DataFrame, path: str, split: str) -> None:
    """Synthetic runs as Parquet, by split and device."""
    runs.withColumns({"split": F.lit(split), "device_slug": slug("device")}).write.mode("append").partitionBy("split", "device_slug").parquet(path)


def write_json_map(table: DataFrame, path: str, key: str = "device") -> None:
    """A small table as one JSON object of objects, replacing what was there."""
    fields = [c for c in table.columns if c != key]
    table.coalesce(1).agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, F.struct(*fields).alias("v")))))).alias("value")).write.mode("overwrite").text(path)


def write_summary(table: DataFrame, path: str, *order) -> None:
    """A small report as one CSV file in the given order."""
    table.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
