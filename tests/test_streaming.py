import os

from pyspark.sql import functions as F

from pagewarden.plans import catalog
from pagewarden.streaming import rollups


def test_rollup_goes_on_where_it_stopped(spark, tmp_path):
    folder, out, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
    part = lambda a, b: spark.range(a, b).select(
        (F.timestamp_seconds(F.col("id") * 600)).alias("ts"), F.lit("k").alias("event_type"), F.col("id").cast("double").alias("value"))
    part(0, 12).coalesce(1).write.parquet(folder)
    run = lambda: rollups.run_rollup(rollups.hourly(rollups.open_stream(spark, folder, part(0, 1).schema)), out, mark).awaitTermination()
    run()
    part(9, 20).coalesce(1).write.mode("append").parquet(folder)
    run()
    run()  # nothing new: nothing changes
    got = {r["start"].hour: (r["n"], r["total"]) for r in rollups.read_rollup(spark, out, ["start", "event_type"]).collect()}
    every = [i for a, b in ((0, 12), (9, 20)) for i in range(a, b)]
    want = {h: (sum(i // 6 == h for i in every), float(sum(i for i in every if i // 6 == h))) for h in range(4)}
    assert got == want
    rollups.compact_rollup(spark, out, str(tmp_path / "small"), ["start", "event_type"])
    rows = lambda f: sorted(map(tuple, rollups.read_rollup(spark, f, ["start", "event_type"]).collect()))
    assert rows(str(tmp_path / "small")) == rows(out)


def test_day_starts_at_local_midnight(spark):
    rows = spark.sql("SELECT timestamp'2024-01-01 17:59:59' ts, 'k' event_type, 1D value UNION ALL SELECT timestamp'2024-01-01 18:00:00', 'k', 1D")
    assert rollups.local_daily(rows).count() == 2


def test_latest_and_engine(spark):
    rows = spark.createDataFrame([("w", 1, 5, 1, "a"), ("w", 2, 7, 3, "b")], "worker_id string, last_seen int, scanned_total int, current_batch int, state string")
    assert tuple(rollups.engine_state(rows).first()) == ("w", 2, 12, 3, "b")
    assert tuple(rollups.latest_state(rows, "worker_id", "last_seen", ["state"]).first()) == ("w", 2, "b")


def test_registered_rollup_counts_files_out_of_time_order(spark, tmp_path):
    """24 files are three batches; the later half of the hours is listed first."""
    rows = spark.range(24 * 20).select(
        F.timestamp_seconds(F.col("id") * 180).alias("ts"), F.lit("k").alias("event_type"), F.lit(1.0).alias("value"))
    rows.repartitionByRange(24, "ts").write.parquet(str(tmp_path / "events.parquet"))
    files = sorted((tmp_path / "events.parquet").glob("part-*.parquet"))
    assert len(files) == 24
    for k, f in enumerate(files):
        os.utime(f, (1_700_000_000 + (k + 12) % 24 * 10,) * 2)
    got = {(r["start"].day, r["start"].hour): r["n"] for r in catalog.QUERIES["stream_hourly"](spark, str(tmp_path)).collect()}
    assert got == {(1, h): 20 for h in range(24)}
