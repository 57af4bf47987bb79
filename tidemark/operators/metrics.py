"""Ranking metrics and targeting tables.

Input is a long frame ``(groups..., snapshot_date, client_id, y, score)``. All metrics of
all groups come from the same few aggregates; no group is sorted as a whole. Rows with the
same score are ordered by a hash of date and client.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dialect import index_range, ratio
from ..plans.ranking import exact_quantiles, prefix_counts, rank_blocks, with_tie_blocks

ROWS = ("snapshot_date", "client_id")


def score_counts(scored: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Per distinct score: rows, positives, and both before it from the top."""
    counts = scored.groupBy(*groups, "score").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("y").cast("bigint")).alias("pos")
    )
    return prefix_counts(counts, groups, "score", ["n", "pos"])


def ranking_quality(scored: DataFrame, groups: Sequence[str]) -> DataFrame:
    """ROC-AUC (ties count half) and average precision; NULL when a class is missing."""
    c = score_counts(scored, groups)
    n, pos = F.col("n").cast("double"), F.col("pos").cast("double")
    neg = n - pos
    all_pos, all_neg = F.col("pos_total"), F.col("n_total") - F.col("pos_total")
    neg_below = all_neg - (F.col("n_before") - F.col("pos_before")) - neg
    precision_here = (F.col("pos_before") + pos) / (F.col("n_before") + n)
    sums = c.groupBy(*groups).agg(
        F.sum(pos * (neg_below + neg / 2)).alias("u"),
        F.sum(pos * precision_here).alias("ap"),
        F.max(all_pos).alias("p"),
        F.max(all_neg).alias("q"),
    )
    return sums.select(
        *groups,
        F.when((F.col("p") > 0) & (F.col("q") > 0), F.col("u") / (F.col("p") * F.col("q"))).alias("roc_auc"),
        ratio("ap", "p").alias("pr_auc"),
    )


def probability_loss(scored: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Log loss and Brier score with scores kept off 0 and 1."""
    s = F.least(F.greatest(F.col("score"), F.lit(1e-6)), F.lit(1 - 1e-6))
    y = F.col("y").cast("double")
    return scored.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(y).alias("actual_positive_rate"),
        F.avg(-(y * F.log(s) + (1 - y) * F.log(1 - s))).alias("log_loss"),
        F.avg((s - y) * (s - y)).alias("brier_score"),
    )


def selected_at(
    scored: DataFrame, groups: Sequence[str], rates: Sequence[float], floor: bool = False
) -> DataFrame:
    """Positives among the top ``rate`` % of each group.

    The number selected is rounded half to even, or cut down when ``floor``. Blocks of rows
    wholly inside the top are summed; only the block holding the cut is ranked row by row.
    Whole percents may be given as a ``range``; a block then tries only those near it.
    """
    g = list(groups)
    rows = with_tie_blocks(scored, ROWS)
    blocks = rank_blocks(rows, g, "score", "y")

    def cut(rate):
        size = F.col("n_total") * rate / F.lit(100.0)
        return F.greatest(F.lit(1).cast("bigint"), (F.floor(size) if floor else F.bround(size, 0)).cast("bigint"))

    before, n = F.col("n_before"), F.col("n")
    if isinstance(rates, range):
        per_row = F.lit(100.0) / F.col("n_total")
        lo = F.greatest(F.lit(rates.start), F.floor((before - 1) * per_row))
        hi = F.least(F.lit(rates.stop - 1), F.ceil((before + n + 1) * per_row))
        tried = index_range(lo, hi).cast("array<double>")
    else:
        tried = F.array(*[F.lit(float(x)) for x in rates])
    here = F.filter(tried, lambda x: (cut(x) > before) & (cut(x) <= before + n))
    edges = blocks.withColumn("rate", F.explode(here)).select(
        *g, "score", "_block", "rate", cut(F.col("rate")).alias("k"), "n_before", "pos_before", "n_total", "pos_total"
    )
    # one row per group and rate
    inside = rows.select(*g, "score", "_block", "_tie", *ROWS, "y").join(edges, [*g, "score", "_block"])
    place = F.row_number().over(Window.partitionBy(*g, "rate").orderBy("_tie", *ROWS))
    return (
        inside.withColumn("place", place)
        .groupBy(*g, "rate")
        .agg(
            F.max("n_total").alias("n_total"),
            F.max("pos_total").alias("pos_total"),
            F.max("k").alias("n_selected"),
            (
                F.max("pos_before")
                + F.coalesce(
                    F.sum(F.when(F.col("place") <= F.col("k") - F.col("n_before"), F.col("y").cast("bigint"))), F.lit(0)
                )
            ).alias("n_captured"),
        )
    )


def with_rates(selected: DataFrame) -> DataFrame:
    """Precision, recall and lift; 0 where undefined."""
    k, hit = F.col("n_selected"), F.col("n_captured")
    precision = hit / k
    base = F.col("pos_total") / F.col("n_total")
    return selected.select(
        "*",
        precision.alias("precision"),
        F.coalesce(ratio(hit, "pos_total"), F.lit(0.0)).alias("recall"),
        F.when(base > 0, precision / base).otherwise(F.lit(0.0)).alias("lift"),
    )


def precision_recall_lift(scored: DataFrame, groups: Sequence[str], rates: Sequence[float]) -> DataFrame:
    return with_rates(selected_at(scored, groups, rates))


def lift_curve(scored: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Lift at each whole percent, the selection size cut down to whole rows."""
    points = with_rates(selected_at(scored, groups, range(1, 101), floor=True))
    return points.select(*groups, F.col("rate").cast("int").alias("pct"), "n_selected", "lift")


def needed_for(scored: DataFrame, groups: Sequence[str], targets: DataFrame) -> DataFrame:
    """Smallest top of each group that holds ``target`` positives.

    ``targets`` has few rows ``(groups..., rate, target)``. A target of 0 needs one row; a
    group without positives needs all its rows.
    """
    g = list(groups)
    rows = with_tie_blocks(scored, ROWS)
    blocks = rank_blocks(rows, g, "score", "y").join(targets, g)
    goal = F.greatest(F.col("target"), F.lit(1))
    edges = blocks.filter((F.col("pos_before") < goal) & (goal <= F.col("pos_before") + F.col("pos"))).select(
        *g, "score", "_block", "rate", (goal - F.col("pos_before")).alias("missing"), "n_before", "target"
    )
    inside = rows.select(*g, "score", "_block", "_tie", *ROWS, "y").join(edges, [*g, "score", "_block"])
    w = Window.partitionBy(*g, "rate").orderBy("_tie", *ROWS)
    found = (
        inside.withColumn("place", F.row_number().over(w))
        .withColumn("hits", F.sum(F.col("y").cast("bigint")).over(w))
        .filter(F.col("hits") >= F.col("missing"))
        .groupBy(*g, "rate")
        .agg((F.max("n_before") + F.min("place")).alias("found"))
    )
    totals = scored.groupBy(*g).agg(
        F.count(F.lit(1)).alias("n_total"), F.sum(F.col("y").cast("bigint")).alias("pos_total")
    )
    needed = (
        F.when(F.col("pos_total") == 0, F.col("n_total")).when(F.col("target") <= 0, F.lit(1)).otherwise(F.col("found"))
    )
    return (
        targets.join(totals, g)
        .join(found, [*g, "rate"], "left")
        .select(*g, "rate", "target", needed.cast("bigint").alias("n_needed"))
    )


def full_evaluation(scored: DataFrame, groups: Sequence[str], rates: Sequence[int] = (5, 10, 20)) -> DataFrame:
    """One row of all metrics per group."""
    g = list(groups)
    tops = precision_recall_lift(scored, g, rates)

    def at(rate, c):
        return F.max(F.when(F.col("rate") == rate, F.col(c)))

    wide = tops.groupBy(*g).agg(
        *[at(x, c).alias(f"{c}_at_{x}pct") for x in rates for c in ("precision", "recall", "lift")]
    )
    return probability_loss(scored, g).join(ranking_quality(scored, g), g).join(wide, g)


def roc_points(scored: DataFrame, groups: Sequence[str]) -> DataFrame:
    """False and true positive rate at each distinct score, from the top."""
    c = score_counts(scored, groups)
    seen, hits = F.col("n_before") + F.col("n"), F.col("pos_before") + F.col("pos")
    return c.select(
        *groups,
        F.col("score").alias("threshold"),
        ratio(seen - hits, F.col("n_total") - F.col("pos_total")).alias("fpr"),
        ratio(hits, "pos_total").alias("tpr"),
    )


def calibration_table(scored: DataFrame, groups: Sequence[str], n_bins: int = 10) -> DataFrame:
    """Mean score and actual rate per quantile bin; equal bin edges are merged."""
    g = list(groups)
    q = exact_quantiles(scored, "score", [k / n_bins for k in range(n_bins + 1)], g)
    edges = q.groupBy(*g).agg(F.array_sort(F.collect_set("quantile")).alias("edges"))
    # right-closed bins; the lowest score belongs to the first
    place: Column = F.greatest(F.lit(1), F.size(F.filter("edges", lambda e: e < F.col("score"))))
    return (
        scored.join(edges, g)
        .groupBy(*g, place.alias("bin"))
        .agg(
            F.avg("score").alias("mean_predicted"),
            F.avg(F.col("y").cast("double")).alias("actual_rate"),
            F.count(F.lit(1)).alias("n"),
        )
    )


# --- targeting ---------------------------------------------------------------------------


def policy_table(scored: DataFrame, groups: Sequence[str], rates: Sequence[int]) -> DataFrame:
    """What each policy captures at each contact rate; the policy is ``method``."""
    rows = precision_recall_lift(scored, [*groups, "method"], rates)
    return rows.select(
        *groups,
        F.col("rate").cast("int").alias("contact_rate_pct"),
        F.col("method").alias("policy"),
        "n_total",
        "n_selected",
        F.col("n_captured").alias("n_actual_captured"),
        "precision",
        "recall",
        "lift",
    )


def model_vs_rule(
    scored: DataFrame, groups: Sequence[str], rates: Sequence[int], model: str, rule: str
) -> DataFrame:
    """Contacts the rule needs for the recall the model reaches, and the share saved.

    The comparison is on whole captured customers, not on a rounded recall.
    """
    g = list(groups)
    top = with_rates(selected_at(scored.filter(F.col("method") == model), g, rates))
    targets = top.select(*g, "rate", F.col("n_captured").alias("target"))
    need = needed_for(scored.filter(F.col("method") == rule), g, targets).select(*g, "rate", "n_needed")
    saved = (F.lit(1.0) - F.col("n_selected") / F.col("n_needed")) * 100
    return top.join(need, [*g, "rate"]).select(
        *g,
        F.col("rate").cast("int").alias("contact_rate_pct"),
        F.lit(f"{model}_vs_{rule}_same_recall").alias("policy"),
        "n_total",
        "n_selected",
        F.col("n_captured").alias("n_actual_captured"),
        "recall",
        F.col("n_needed").alias("customers_needed_by_rule_for_same_recall"),
        F.when(F.col("n_needed") > 0, saved).otherwise(F.lit(0.0)).alias("contact_reduction_pct"),
    )


def targeting_table(
    scored: DataFrame, groups: Sequence[str], rates: Sequence[int], model: str, rule: str
) -> DataFrame:
    """Policy rows and comparison rows in one table."""
    policies = policy_table(scored, groups, rates)
    versus = model_vs_rule(scored, groups, rates, model, rule)
    return policies.unionByName(versus, allowMissingColumns=True)
