"""The tail of many files and the committed table."""

import json
import os

from pyspark.sql import functions as F

from gridlens.schema import METER_COLUMNS
from gridlens.sources import committed, tails

HEAD = ",".join(METER_COLUMNS)


def line(at, p, columns=METER_COLUMNS):
    cells = {"timestamp_iso": f"2024-05-01T10:{at // 60:02d}:{at % 60:02d}Z", "device_name": "x", "p_total_w": str(p)}
    return ",".join(cells.get(c, "") for c in columns)


def append(path, *lines, end="\n"):
    with open(path, "a") as f:
        f.write("\n".join(lines) + end)


def test_each_file_has_its_own_offset_session_and_header(spark, tmp_path):
    folder = tmp_path / "in"
    os.makedirs(folder)
    append(folder / "a.csv", HEAD, *[line(i, i) for i in range(3)])
    append(folder / "b.csv", HEAD, line(0, 100))
    spark.dataSource.register(tails.MeterTails)
    stream = spark.readStream.format("meter_tails").options(path=str(folder), state=f"{tmp_path}/state", startingOffset="earliest").load()

    def run():
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").start()
        try:
            query.processAllAvailable()
            act(query)
        finally:
            query.stop()
        rows = spark.read.schema(stream.schema).parquet(f"{tmp_path}/out")
        return sorted((os.path.basename(r["series_id"]), r["session"], r["p_total_w"]) for r in rows.collect())

    short = ["timestamp_iso", "p_total_w"]

    def act(query):
        append(folder / "a.csv", line(3, 3), ",".join(short), line(4, 4, short))
        append(folder / "c.csv", HEAD, line(0, 200), line(1, 201)[:-5], end="")  # a new file, its last line half written
        query.processAllAvailable()

    first = [("a.csv", 0, float(i)) for i in range(5)] + [("b.csv", 0, 100.0), ("c.csv", 0, 200.0)]
    assert run() == first

    def act(query):  # after a restart; the short header is still in force
        append(folder / "a.csv", line(5, 5, short))
        append(folder / "c.csv", line(1, 201)[-5:])
        with open(folder / "b.csv", "w") as f:
            f.write(line(2, 102) + "\n")  # begun anew, and shorter, without a header
        query.processAllAvailable()
        query.processAllAvailable()

    assert run() == sorted([*first, ("a.csv", 0, 5.0), ("b.csv", 1, 102.0), ("c.csv", 0, 201.0)])


def test_tails_take_bounded_bytes_and_whole_lines(tmp_path):
    folder = tmp_path / "in"
    os.makedirs(folder)
    append(folder / "a.csv", HEAD, *[line(i, i) for i in range(40)], "x" * 5000)
    read = lambda **o: tails.TailsReader({"path": str(folder), "state": f"{tmp_path}/s", "startingOffset": "earliest", "maxBytesPerFile": "400", **o})
    reader, start, got, steps = read(), {"files": {}}, [], 0
    while True:
        end = reader.latestOffset()
        if end == start:
            break
        for part in reader.partitions(start, end):
            got += [r[5] for r in reader.read(part)]
        start, steps = end, steps + 1
    assert got == [float(i) for i in range(40)] and steps > 5
    reader.commit({"files": {"a.csv": {"pos": 400, "session": 0}}})
    assert 800 <= read().latestOffset()["files"]["a.csv"]["pos"] <= 1200
    late = tails.TailsReader({"path": str(folder), "state": f"{tmp_path}/t"})
    assert late.partitions(late.initialOffset(), late.latestOffset()) == []
    assert tails.TailsReader({"path": f"{tmp_path}/none", "state": f"{tmp_path}/t"}).latestOffset() == {"files": {}}


def test_a_committed_table_holds_each_row_once(spark, tmp_path):
    spark.dataSource.register(committed.Committed)
    source, table = tmp_path / "in", f"{tmp_path}/table"
    rows = lambda low: spark.range(low, low + 50).select("id", F.timestamp_seconds("id").alias("at"), F.when(F.col("id") % 3 > 0, F.array("id")).alias("list"))
    rows(0).write.parquet(str(source))
    stream = spark.readStream.schema(rows(0).schema).parquet(str(source))

    def run(checkpoint="cp"):
        query = stream.writeStream.format("committed").option("path", table).option("checkpointLocation", f"{tmp_path}/{checkpoint}").trigger(availableNow=True).start()
        query.awaitTermination(120)
        return sorted(r["id"] for r in committed.committed(spark, table).collect())

    assert run() == list(range(50))
    rows(50).write.mode("append").parquet(str(source))
    assert run() == list(range(100))
    # the same batches again, as after a crash between the table's commit and the checkpoint's
    assert run("cp-lost") == list(range(100))
    assert committed.committed(spark, table).where("list IS NULL").count() == 34
    before = len(committed.live_files(table))
    gone = committed.compacted(spark, table)
    assert len(gone) == before and len(committed.live_files(table)) == 1
    assert sorted(r["id"] for r in committed.committed(spark, table).collect()) == list(range(100))
    rows(100).write.mode("append").parquet(str(source))
    assert run() == list(range(150))


def test_a_failed_batch_leaves_nothing(tmp_path):
    import pyarrow as pa
    from pyspark.sql.types import LongType, StructField, StructType

    writer = committed.CommittedWriter(str(tmp_path), StructType([StructField("id", LongType())]))
    batch = pa.RecordBatch.from_pydict({"id": [1, 2]})
    one = writer.write(iter([batch, batch]))
    assert committed.live_files(str(tmp_path)) == [] and os.path.exists(f"{tmp_path}/{one.files[0]}")
    writer.abort([one, None], 0)
    assert not os.path.exists(f"{tmp_path}/{one.files[0]}")
    two, again = writer.write(iter([batch])), writer.write(iter([batch]))
    writer.commit([two, writer.write(iter([]))], 0)
    writer.commit([again], 0)
    assert committed.live_files(str(tmp_path)) == two.files and not os.path.exists(f"{tmp_path}/{again.files[0]}")
    assert json.load(open(f"{tmp_path}/schema.json"))["fields"][0]["name"] == "id"
