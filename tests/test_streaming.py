from conftest import streams_of

from tidemark.operators import facts
from tidemark.streaming.daily import daily_activity_stream, late_groups, merge_daily, merged_daily


def test_closed_days_equal_the_batch_table(spark, tmp_path):
    s = streams_of(
        spark,
        buy=[(1, "2024-01-01 23:59:59.900000", 1), (1, "2024-01-02 00:00:00", 1)],
        visit=[(1, "2024-01-01 00:00:00", 1), (2, "2024-01-02 10:00:00", 1), (2, "2024-01-02 10:00:00", 1)],
        search=[(2, "2024-01-02 11:00:00", "q"), (3, "2024-01-09 00:00:00", "q")],
    )
    folder = str(tmp_path / "in")
    s.events.coalesce(1).write.parquet(folder)
    s.events.limit(0).unionByName(s.events.filter("client_id = 3")).coalesce(1).write.mode("append").parquet(folder)
    live = spark.readStream.schema(s.events.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    query = (
        daily_activity_stream(live)
        .writeStream.outputMode("append")
        .format("memory")
        .queryName("daily_live")
        .option("checkpointLocation", str(tmp_path / "ck"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(120)
    got = sorted(map(tuple, spark.table("daily_live").collect()))
    closed = facts.daily_activity(s).filter("activity_date < '2024-01-08'")
    assert got == sorted(map(tuple, closed.collect())) and len(got) == 3


def late_log(spark, tmp_path):
    """A log read in four micro-batches, the last with events of days long closed, and the same as a table.

    Spark drops as late what is behind the watermark of the batch before, which the one
    before that has set; hence two batches of later days.
    """
    s = streams_of(
        spark,
        buy=[(1, "2024-01-01 23:59:59.900000", 1), (2, "2024-01-20 12:00:00", 1), (1, "2024-01-01 08:00:00", 2), (4, "2024-01-02 00:00:00", 2)],
        visit=[(1, "2024-01-01 00:00:00", 1), (2, "2024-01-02 10:00:00", 1), (3, "2024-01-21 10:00:00", 1), (1, None, 3)],
    )
    folder = str(tmp_path / "late")
    first = "client_id < 4 AND event_ts < '2024-01-10' AND (event_ts < '2024-01-01 01:00' OR event_ts > '2024-01-01 20:00')"
    parts = [first, "event_ts >= '2024-01-10' AND client_id = 2", "event_ts >= '2024-01-10' AND client_id = 3"]
    for part in [*parts, "NOT coalesce(" + " OR ".join(f"({x})" for x in parts) + ", false)"]:
        s.events.filter(part).coalesce(1).write.mode("append").parquet(folder)
    return s, spark.readStream.schema(s.events.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_late_events_are_told_of(spark, tmp_path):
    _, live = late_log(spark, tmp_path)
    query = (
        daily_activity_stream(live)
        .writeStream.outputMode("append")
        .format("noop")
        .option("checkpointLocation", str(tmp_path / "ck"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(120)
    assert late_groups(query) >= 2  # clients 1 and 4


def test_merged_days_take_late_events_in(spark, tmp_path):
    s, live = late_log(spark, tmp_path)
    folder, checkpoint = str(tmp_path / "parts"), str(tmp_path / "ck")
    merge_daily(live, folder, checkpoint).trigger(availableNow=True).start().awaitTermination(120)
    want = sorted(map(tuple, facts.daily_activity(s).collect()), key=str)
    rows = lambda: sorted(map(tuple, merged_daily(spark, folder).collect()), key=str)
    assert rows() == want and len(want) > 4
    # a batch whose end was not recorded is written again in its own place
    commits = sorted((tmp_path / "ck" / "commits").glob("[0-9]*"))
    last = commits[-1]
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    merge_daily(live, folder, checkpoint).trigger(availableNow=True).start().awaitTermination(120)
    assert rows() == want
