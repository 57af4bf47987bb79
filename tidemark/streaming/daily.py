"""The daily activity table kept up to date from a stream of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from ..functions.dialect import day, epoch_second
from ..plans.rollup import EVENT_TYPES


def daily_activity_stream(events: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Counts per client and day; a day is final once events are ``lateness`` past its end.

    ``events`` is a streaming frame ``(client_id, event_ts, event_type)``. State holds only
    the open days. Later events of a closed day are left out, which the batch table corrects;
    ``late_groups`` tells of them, and ``merge_daily`` takes them in.
    """
    # the event's wall clock as an instant, so that days do not depend on the session's zone
    timed = events.withColumn("_time", F.timestamp_seconds(epoch_second("event_ts")))
    per_day = (
        timed.withWatermark("_time", lateness)
        .groupBy("client_id", F.window("_time", "1 day").alias("w"))
        .agg(*_counts())
    )
    return per_day.select(
        "client_id",
        F.date_from_unix_date(F.floor(F.unix_seconds("w.start") / 86400).cast("int")).alias("activity_date"),
        *[f"n_{t}" for t in EVENT_TYPES],
        "n_events_total",
        _kinds().alias("n_event_types_active"),
    )


def _counts() -> list[Column]:
    counts = [F.count_if(F.col("event_type") == t).alias(f"n_{t}") for t in EVENT_TYPES]
    return [*counts, F.count(F.lit(1)).alias("n_events_total")]


def _kinds() -> Column:
    return sum((F.col(f"n_{t}") > 0).cast("bigint") for t in EVENT_TYPES)


def late_groups(query: StreamingQuery) -> int:
    """Rows that a query has left out as too late, in the batches it still reports on.

    Spark drops them after the partial aggregation, so several late events of one client and
    day in one task count once: zero means that none was lost, not how many were.
    """
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def merge_daily(events: DataFrame, folder: str, checkpoint: str) -> DataStreamWriter:
    """Writer that adds every event to partial daily counts in ``folder``, however late it is.

    A micro-batch is reduced to one row per client and day and written as partition
    ``batch`` of the folder, in place of what an earlier try of the batch left there, so a
    restart counts nothing twice. No state is held; ``merged_daily`` sums the parts.
    """

    def add(batch: DataFrame, number: int) -> None:
        days = batch.groupBy("client_id", day("event_ts").alias("activity_date")).agg(*_counts())
        days.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return events.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)


def merged_daily(spark: SparkSession, folder: str) -> DataFrame:
    """The daily table over all that ``merge_daily`` has written, equal to the batch table."""
    names = [f"n_{t}" for t in EVENT_TYPES] + ["n_events_total"]
    parts = spark.read.parquet(folder)
    whole = parts.groupBy("client_id", "activity_date").agg(*[F.sum(n).alias(n) for n in names])
    return whole.select("client_id", "activity_date", *names, _kinds().alias("n_event_types_active"))
