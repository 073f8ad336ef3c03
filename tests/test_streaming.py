"""Streams over several files against the same rows as a batch."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from presswave.streaming import operators, queries


def test_files_out_of_time_order(spark, tmp_path):
    rows = []
    for file, day in enumerate((20, 1, 10)):
        some = [(100 * file + k, datetime(2024, 1, day) + timedelta(hours=k), "ab"[k % 2], float(k)) for k in range(30)]
        rows += some
        again = rows[:5] if file else []
        spark.createDataFrame(some + again, "event_id long, ts timestamp_ntz, event_type string, value double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    got = sorted(tuple(r) for r in queries.stream_deduplicated(spark, str(tmp_path)).collect())
    assert got == sorted((e, t, v) for e, _, t, v in rows)
    seen = {}
    for _, ts, kind in [r[:3] for r in rows + 2 * rows[:5]]:
        seen[ts.date(), kind] = seen.get((ts.date(), kind), 0) + 1
    assert {(r["day"], r["event_type"]): r["n"] for r in queries.stream_daily_counts(spark, str(tmp_path)).collect()} == seen
    counts = {(r["day"], r["event_type"]): r["n"] for r in queries.stream_daily_counts(spark, str(tmp_path)).collect()}
    assert counts == seen


SCHEMA = "event_id long, ts timestamp, event_type string, value double"


def stream_of(spark, path, files=1):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(f"{path}/in")


def add_file(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")


def event(k, day=1, hour=0):
    return (k, datetime(2024, 1, day) + timedelta(hours=hour), "a", float(k))


def test_days_that_late_rows_touch_are_counted_again(spark, tmp_path):
    """Days that were closed before their last rows come, and only those, are read again."""
    want = {}
    for day, hours in ((1, 5), (2, 4), (20, 5), (1, 3), (19, 2), (25, 4), (20, 1)):
        add_file(spark, tmp_path, [event(1000 * day + k + 100 * hours, day, k) for k in range(hours)])
        want[f"2024-01-{day:02d}"] = want.get(f"2024-01-{day:02d}", 0) + hours
    edge = operators.hot_edge(stream_of(spark, tmp_path), f"{tmp_path}/edge", "ts", "event_type")
    assert {r["day"]: r["n"] for r in edge.counts.collect()} == want
    assert edge.late_days == ["2024-01-01", "2024-01-20"]
    plan = edge.reread._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [day" in plan and all(d in plan.split("PartitionFilters: ")[1].split("]")[0] for d in edge.late_days)
    # more files, after a restart: a late row for another day
    add_file(spark, tmp_path, [event(9, 2, 1)])
    edge = operators.hot_edge(stream_of(spark, tmp_path), f"{tmp_path}/edge", "ts", "event_type")
    assert {r["day"]: r["n"] for r in edge.counts.collect()} == want | {"2024-01-02": 5}
    assert edge.late_days == ["2024-01-01", "2024-01-02", "2024-01-20"]


def test_counters_of_many_batches_and_after_a_restart(spark, tmp_path):
    """More batches than a query's progress remembers."""
    spark.range(110).select(F.col("id").alias("event_id"), F.current_timestamp().alias("ts"), F.lit("a").alias("event_type"), F.lit(1.0).alias("value")).repartition(110, "event_id").write.option("maxRecordsPerFile", 1).parquet(f"{tmp_path}/in")
    bad = F.when(F.col("event_id") == 50, None).otherwise(F.col("event_id") % 10 == 0)
    told = lambda: operators.counted(stream_of(spark, tmp_path), f"{tmp_path}/run", bad, "event_id")
    sums, failed = told()
    assert tuple(sums.first()) == (110, 100, 10)
    assert {r[0] for r in failed.collect()} == {k for k in range(0, 110, 10)} - {50}
    add_file(spark, tmp_path, [event(200), event(201)])
    assert tuple(told()[0].first()) == (112, 101, 11)
    assert tuple(told()[0].first()) == (112, 101, 11)


def test_state_of_deduplication_is_bounded(spark, tmp_path):
    for file in range(8):
        old = [event(k, k % 5 + 1) for k in range(0, 20 * file, 7)]
        add_file(spark, tmp_path, [event(k, k % 5 + 1) for k in range(20 * file, 20 * file + 20)] + old + old)
    got = operators.deduplicated(stream_of(spark, tmp_path), f"{tmp_path}/d", "event_id", "ts", ttl="1 second")
    assert sorted(r["event_id"] for r in got.collect()) == list(range(160))
    assert operators.dedup_state(spark, f"{tmp_path}/d") < 120
    add_file(spark, tmp_path, [event(5, 1), event(500, 1), (None, None, "a", 1.0), (None, None, "a", 2.0)])
    again = operators.deduplicated(stream_of(spark, tmp_path), f"{tmp_path}/d", "event_id", "ts", ttl="1 second")
    assert sorted(str(r["event_id"]) for r in again.collect()) == sorted(map(str, [*range(160), 500, None]))
