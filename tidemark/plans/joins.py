"""Join of a fact table, whose key may be badly skewed, with a keyed lookup table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread_lookup(
    facts: DataFrame,
    lookup: DataFrame,
    on: list[str],
    spread_by: list[str],
    how: str = "inner",
    ways: int = 16,
) -> DataFrame:
    """Join ``facts`` with ``lookup`` (unique on ``on``), cutting each key in ``ways`` parts.

    The lookup side is repeated ``ways`` times and the fact side picks a part by a hash of
    ``spread_by``, so that one key holding a third of the facts is still joined by
    ``ways`` tasks. The join is by sorting: Spark's size estimate does not count the
    repeats, so left to itself it would broadcast a lookup far above its limit, all of it
    by way of the driver.
    """
    part = "_part"
    left = facts.withColumn(part, F.pmod(F.xxhash64(*spread_by), F.lit(ways)).cast("int"))
    right = lookup.withColumn(part, F.explode(F.sequence(F.lit(0), F.lit(ways - 1)))).hint("merge")
    return left.join(right, [*on, part], how).drop(part)
