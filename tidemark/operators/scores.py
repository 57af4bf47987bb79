"""Chronological split, rule-based scores, and feature preparation for the models.

Score functions work on a panel with a ``split`` column and scale within each split, so
their statistics are one row per split. The panel should be a written or checkpointed
table, since statistics and rows are two passes over it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import Params
from ..plans.ranking import exact_quantiles, tie_key

SPLITS = ("train", "val", "test")


def chronological_split(panel: DataFrame, p: Params) -> DataFrame:
    """Tag rows by date order: the last dates test, those before validate, the rest train.

    The last two of ``split_sizes`` count the dates of validation and test. A grid too short
    to leave a training date is an error, so that no part is silently empty.
    """
    dates = panel.agg(F.sort_array(F.collect_set("snapshot_date"))).scalar()
    _, val, test = p.split_sizes
    from_end = F.size(dates) - F.array_position(dates, F.col("snapshot_date"))
    tag = (
        F.when(F.size(dates) <= val + test, F.raise_error(F.lit("too few snapshot dates for a split")))
        .when(from_end < test, "test")
        .when(from_end < test + val, "val")
        .otherwise("train")
    )
    return panel.withColumn("split", tag)


def _few(stats: DataFrame) -> DataFrame:
    """One row of statistics per split, named as the side to broadcast.

    A written panel may be a few compressed megabytes on disk, by which Spark would choose
    to broadcast the panel, all of its rows by way of the driver.
    """
    return F.broadcast(stats)


def scaled(df: DataFrame, raws: dict[str, Column], by: Sequence[str] = ("split",)) -> DataFrame:
    """Add min-max scaled columns; a constant column becomes 0.5."""
    by = list(by)
    rows = df.select("*", *[c.cast("double").alias(f"_raw_{n}") for n, c in raws.items()])
    stats = rows.groupBy(*by).agg(
        *[F.min(f"_raw_{n}").alias(f"_lo_{n}") for n in raws], *[F.max(f"_raw_{n}").alias(f"_hi_{n}") for n in raws]
    )

    def unit(n):
        x, lo, hi = F.col(f"_raw_{n}"), F.col(f"_lo_{n}"), F.col(f"_hi_{n}")
        return F.when(hi - lo < 1e-9, F.lit(0.5)).otherwise((x - lo) / (hi - lo))

    return rows.join(_few(stats), by).select(*df.columns, *[unit(n).alias(n) for n in raws])


def random_score(seed: int) -> Column:
    """In [0, 1), fixed by client, date and seed however the rows are partitioned."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("snapshot_date").cast("string"), F.col("client_id").cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def base_rate_score(panel: DataFrame, label: str) -> DataFrame:
    """Every row gets the training rate of the label."""
    rate = panel.filter("split = 'train'").agg(F.avg(F.col(label).cast("double"))).scalar()
    return panel.withColumn("base_rate", rate)


def _days_summary(panel: DataFrame) -> DataFrame:
    """Per split: largest recency and the median recency once unknown ones are set to it."""
    days = panel.groupBy("split", F.col("days_since_last_purchase").alias("days")).agg(F.count(F.lit(1)).alias("n"))
    top = F.coalesce(F.max("days").over(Window.partitionBy("split")), F.lit(1))
    filled = days.select("split", "n", top.alias("max_days"), F.coalesce("days", top).alias("days"))
    return filled.groupBy("split").agg(
        F.max("max_days").alias("max_days"),
        F.max(F.lit(1)).alias("_one"),
        F.min("days").alias("min_days"),
        F.percentile("days", 0.5, F.col("n")).alias("median_days"),
    )


def _with_top_days(panel: DataFrame) -> DataFrame:
    top = panel.groupBy("split").agg(F.max("days_since_last_purchase").alias("_top"))
    return panel.join(_few(top), "split")


def _filled_days() -> Column:
    """Recency; no purchase counts as twice the longest of the split."""
    return F.coalesce("days_since_last_purchase", F.col("_top") * 2, F.lit(1))


def _recent_purchases(p: Params) -> Column:
    return F.coalesce(f"n_purchases_{max(p.purchase_windows)}d", F.lit(0))


def _tier(p: Params) -> Column:
    """0 to 3 by the lifecycle limits at the snapshot; no purchase counts as 3."""
    days = F.col("days_since_last_purchase")
    return (
        F.when(days <= p.recent_days, 0)
        .when(days <= p.declining_days, 1)
        .when(days <= p.at_risk_days, 2)
        .otherwise(3)
    )


def _interest(p: Params) -> Column:
    """Recent visits plus three times the recent searches."""
    a = p.activity_days
    visits, searches = (F.coalesce(f"n_{k}_{a}d", F.lit(0)) for k in ("page_visit", "search_query"))
    return visits + searches * 3


def recency_risk(panel: DataFrame) -> DataFrame:
    """Higher the longer ago the last purchase."""
    return scaled(_with_top_days(panel), {"recency_risk": _filled_days()}).drop("_top")


def frequency_risk(panel: DataFrame, p: Params) -> DataFrame:
    """Higher the fewer recent purchases."""
    return scaled(panel, {"frequency_risk": F.lit(0) - _recent_purchases(p)})


def lifecycle_tier_risk(panel: DataFrame, p: Params) -> DataFrame:
    return scaled(panel, {"lifecycle_risk": _tier(p)})


def churn_rules(panel: DataFrame, p: Params) -> DataFrame:
    """The three risk scores with one pass for their statistics."""
    raws = {
        "recency_risk": _filled_days(),
        "frequency_risk": F.lit(0) - _recent_purchases(p),
        "lifecycle_risk": _tier(p),
    }
    return scaled(_with_top_days(panel), raws).drop("_top")


def frequency_propensity(panel: DataFrame) -> DataFrame:
    """Higher the more purchases so far."""
    return scaled(panel, {"frequency_propensity": F.coalesce("n_purchase_occasions_so_far", F.lit(0))})


def visit_propensity(panel: DataFrame, p: Params) -> DataFrame:
    return scaled(panel, {"visit_propensity": _interest(p)})


def propensity_rules(panel: DataFrame, p: Params) -> DataFrame:
    """The three propensity scores."""
    raws = {
        "frequency_propensity": F.coalesce("n_purchase_occasions_so_far", F.lit(0)),
        "visit_propensity": _interest(p),
    }
    return scaled(recency_propensity(panel), raws)


def recency_propensity(panel: DataFrame) -> DataFrame:
    """Higher the more recent the last purchase; without one, the median of all scores.

    The score falls linearly with the days, so the median score is the score of the median.
    """
    rows = panel.join(_few(_days_summary(panel)), "split")
    lo, hi = F.col("min_days"), F.col("max_days")

    def score(days):
        return F.lit(1.0) - F.when(hi - lo < 1e-9, F.lit(0.5)).otherwise((days - lo) / (hi - lo))

    own = score(F.coalesce("days_since_last_purchase", hi))
    middle = score(F.col("median_days"))
    return rows.select(
        *panel.columns, F.when(F.col("has_purchase_history"), own).otherwise(middle).alias("recency_propensity")
    )


def train_medians(panel: DataFrame, columns: Sequence[str]) -> Column:
    """Exact training medians as one map, column name to value."""
    train = panel.filter("split = 'train'").select(*[F.col(c).cast("double").alias(c) for c in columns])
    long = train.unpivot([], list(columns), "name", "value")
    pairs = exact_quantiles(long, "value", [0.5], ["name"]).select(F.struct("name", "quantile").alias("e"))
    return pairs.agg(F.map_from_entries(F.collect_list("e"))).scalar()


def imputed(panel: DataFrame, with_flag: Sequence[str], without_flag: Sequence[str] = (), as_int: Sequence[str] = ()) -> DataFrame:
    """Fill NULLs with the training median, with a ``_missing`` flag where asked for."""
    fill = [*with_flag, *without_flag]
    rows = panel.withColumn("_medians", train_medians(panel, fill)) if fill else panel
    for c in with_flag:
        rows = rows.withColumn(f"{c}_missing", F.col(c).isNull().cast("int"))
    for c in fill:
        rows = rows.withColumn(c, F.coalesce(F.col(c).cast("double"), F.try_element_at("_medians", F.lit(c))))
    for c in as_int:
        rows = rows.withColumn(c, F.col(c).cast("int"))
    return rows.drop("_medians")


def standardised(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Subtract the training mean and divide by the population deviation (1 where it is 0)."""
    stats = []
    for c in columns:
        x = F.col(c).cast("double")
        stats.append(F.struct(F.avg(x).alias("m"), F.stddev_pop(x).alias("s")).alias(c))
    one = rows.filter("split = 'train'").agg(F.struct(*stats)).scalar()
    out = rows.withColumn("_stats", one)

    def z(c):
        s = F.col(f"_stats.{c}.s")
        return (F.col(c).cast("double") - F.col(f"_stats.{c}.m")) / F.when(s > 0, s).otherwise(F.lit(1.0))

    return out.select(*[(z(c).alias(c) if c in columns else F.col(c)) for c in rows.columns])


def stacked(rows: DataFrame, methods: dict[str, str], label: str) -> DataFrame:
    """Long form ``(split, method, snapshot_date, client_id, y, score)`` with the tie order ``_tie``."""
    pairs = [F.struct(F.lit(m).alias("method"), F.col(c).cast("double").alias("score")) for m, c in methods.items()]
    return rows.select(
        "split",
        "snapshot_date",
        "client_id",
        F.col(label).cast("int").alias("y"),
        tie_key("snapshot_date", "client_id").alias("_tie"),
        F.explode(F.array(*pairs)).alias("m"),
    ).select(F.lit(label).alias("label"), "split", "m.method", "snapshot_date", "client_id", "y", "m.score", "_tie")
