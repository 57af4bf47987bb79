"""Look back over a short span per key without one task per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dialect import epoch_second


def flag_repeat_within(
    df: DataFrame, keys: list[str], seconds: int, ts: str = "event_ts", out: str = "is_burst_repeat"
) -> DataFrame:
    """True where the same key has an earlier event at most ``seconds`` before.

    Rows are partitioned by (key, time slice). A slice is much longer than ``seconds``;
    the events in its last ``seconds`` are repeated at the start of the next slice, which
    is all the next slice can look back to. A key holding a third of the log is therefore
    spread over as many tasks as the log has slices.
    """
    width = max(24 * seconds, 600)
    rows = df.withColumn("_sec", epoch_second(ts)).withColumn("_slice", F.floor(F.col("_sec") / width))
    own = F.struct(F.col("_slice").alias("slice"), F.lit(False).alias("carried"))
    nxt = F.struct((F.col("_slice") + 1).alias("slice"), F.lit(True).alias("carried"))
    near_end = F.col("_sec") >= (F.col("_slice") + 1) * width - seconds
    rows = rows.withColumn("_copy", F.explode(F.when(near_end, F.array(own, nxt)).otherwise(F.array(own))))
    w = Window.partitionBy(*keys, F.col("_copy.slice")).orderBy(F.col(ts).asc_nulls_last())
    gap = F.col("_sec") - F.lag("_sec").over(w)
    return (
        rows.withColumn(out, F.coalesce(gap.between(0, seconds), F.lit(False)))
        .filter(~F.col("_copy.carried"))
        .drop("_sec", "_slice", "_copy")
    )
