"""Global ranks, prefix counts and exact quantiles without sorting in a single task.

Values are first counted per distinct value, so a tie of any size is one row. Distinct
values are then cut in slices by magnitude (1024 per power of two). Slice totals are few
and are summed up per group; the order inside a slice is settled by one task per slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_slice(value) -> Column:
    """A bigint that never falls as ``value`` grows."""
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    size = F.floor(F.log2(F.abs(v)) * 1024) + (1 << 21)
    return F.when(v > 0, size).when(v < 0, -size).otherwise(F.lit(0).cast("bigint"))


def prefix_counts(
    counts: DataFrame,
    groups: Sequence[str],
    value: str,
    measures: Sequence[str],
    descending: bool = True,
    then_by: Sequence[str] = (),
) -> DataFrame:
    """Add ``<m>_before`` and ``<m>_total`` to a frame of counts per (groups, value, then_by).

    ``<m>_before`` sums ``m`` over the rows of the group that come earlier in the order.
    """
    g = list(groups)

    def order(c):
        return F.col(c).desc() if descending else F.col(c).asc()

    rows = counts.withColumn("_slice", value_slice(value))
    if not g:
        rows, g = rows.withColumn("_all", F.lit(0)), ["_all"]
    per_slice = rows.groupBy(*g, "_slice").agg(*[F.sum(m).alias(m) for m in measures])
    earlier = Window.partitionBy(*g).orderBy(order("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*g)
    offsets = per_slice.select(
        *g,
        "_slice",
        *[F.coalesce(F.sum(m).over(earlier), F.lit(0)).alias(f"_{m}_offset") for m in measures],
        *[F.sum(m).over(whole).alias(f"{m}_total") for m in measures],
    )
    inside = (
        Window.partitionBy(*g, "_slice")
        .orderBy(order(value), *[F.col(c).asc() for c in then_by])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    out = rows.join(offsets, [*g, "_slice"])
    for m in measures:
        out = out.withColumn(f"{m}_before", F.col(f"_{m}_offset") + F.coalesce(F.sum(m).over(inside), F.lit(0)))
    return out.drop("_slice", "_all", *[f"_{m}_offset" for m in measures])


def exact_quantiles(
    df: DataFrame, value: str, probs: Sequence[float], groups: Sequence[str] = ()
) -> DataFrame:
    """Interpolated quantiles per group: columns ``groups, prob, quantile``. NULLs are left out."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n"))
    return counted_quantiles(counts, value, "n", probs, groups)


def counted_quantiles(
    counts: DataFrame, value: str, n: str, probs: Sequence[float], groups: Sequence[str] = ()
) -> DataFrame:
    """The same from one row per group and value with its count ``n``."""
    g = list(groups)
    counts = counts.filter(F.col(value).isNotNull()).select(*g, F.col(value).cast("double").alias("_v"), F.col(n).alias("n"))
    ranked = prefix_counts(counts, g, "_v", ["n"], descending=False)
    at = ranked.withColumn("prob", F.explode(F.array(*[F.lit(float(q)) for q in probs])))
    pos = (F.col("n_total") - 1) * F.col("prob")
    lo, hi = F.floor(pos), F.ceil(pos)

    def holds(rank):
        return (F.col("n_before") <= rank) & (rank < F.col("n_before") + F.col("n"))

    return (
        at.withColumn("_pos", pos)
        .filter(holds(lo) | holds(hi))
        .groupBy(*g, "prob")
        .agg(
            F.max(F.when(holds(lo), F.col("_v"))).alias("_lo"),
            F.max(F.when(holds(hi), F.col("_v"))).alias("_hi"),
            F.max(F.col("_pos") - F.floor("_pos")).alias("_w"),
        )
        .select(*g, "prob", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_w")).alias("quantile"))
    )


def tie_key(*cols: str) -> Column:
    """A fixed, evenly spread order among rows with the same score."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in cols]))


def with_tie_blocks(scored: DataFrame, tie_cols: Sequence[str]) -> DataFrame:
    """``_tie`` orders equal scores; ``_block`` cuts each tie in 4096 parts of that order.

    A frame that brings its ``_tie`` keeps it.
    """
    tied = scored if "_tie" in scored.columns else scored.withColumn("_tie", tie_key(*tie_cols))
    return tied.withColumn("_block", F.substring("_tie", 1, 3))


def rank_blocks(scored: DataFrame, groups: Sequence[str], score: str, label: str) -> DataFrame:
    """Rows and positives before each (score, tie block), highest score first."""
    counts = scored.groupBy(*groups, score, "_block").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("bigint")).alias("pos")
    )
    return prefix_counts(counts, groups, score, ["n", "pos"], then_by=["_block"])
