"""Split, rule scores, ranking metrics and targeting queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics, panel, scores
from ..plans.materialize import materialize
from ..sources.streams import Streams, from_event_table
from .base import Registry
from .sql import STORE, d, r, store_sql

P = STORE
RATES = P.contact_rates
SHORT = min(P.label_days)
CHURN_LABELS = [f"churn_{n}d" for n in P.label_days]
CHURN_RULES = {"recency": "recency_risk", "frequency": "frequency_risk", "lifecycle": "lifecycle_risk"}
BUY_RULES = {"recency": "recency_propensity", "frequency": "frequency_propensity", "visit": "visit_propensity"}


def churn_panel(s: Streams) -> DataFrame:
    return materialize(scores.chronological_split(panel.churn_target(panel.customer_snapshot(s, P), P), P))


def buy_panel(s: Streams) -> DataFrame:
    return materialize(scores.chronological_split(panel.purchase_propensity(s, P), P))


def churn_scored(s: Streams) -> DataFrame:
    """Rule scores of all splits against the short churn label, in long form."""
    return materialize(scores.stacked(scores.churn_rules(churn_panel(s), P), CHURN_RULES, f"churn_{SHORT}d"))


def buy_scored(s: Streams) -> DataFrame:
    return materialize(scores.stacked(scores.propensity_rules(buy_panel(s), P), BUY_RULES, f"will_purchase_{SHORT}d"))


def _unit(x: str, w: str = "w") -> str:
    x = f"CAST({x} AS DOUBLE)"
    return f"""CASE WHEN max({x}) OVER {w} - min({x}) OVER {w} < 1e-9 THEN 0.5
               ELSE ({x} - min({x}) OVER {w}) / (max({x}) OVER {w} - min({x}) OVER {w}) END"""


_A, _B, _C = P.split_sizes
_SPLIT = f"""CASE WHEN dense_rank() OVER (ORDER BY s) <= {_A} THEN 'train'
             WHEN dense_rank() OVER (ORDER BY s) <= {_A + _B} THEN 'val' ELSE 'test' END AS split"""
_A7 = P.activity_days

SCORE_CTES = {
    "churn_rows": f"SELECT *, {_SPLIT} FROM snap",
    "churn_wide": f"""
        SELECT *, {_unit('since')} AS recency, {_unit(f'0 - n_purchases_{max(P.purchase_windows)}d')} AS frequency,
               {_unit(f'''CASE WHEN since <= {P.recent_days} THEN 0 WHEN since <= {P.declining_days} THEN 1
                               WHEN since <= {P.at_risk_days} THEN 2 ELSE 3 END''')} AS lifecycle
        FROM churn_rows WINDOW w AS (PARTITION BY split)""",
    "buy_rows": f"SELECT *, {_SPLIT} FROM prop",
    "buy_filled": "SELECT *, coalesce(since, max(since) OVER (PARTITION BY split), 1) AS filled FROM buy_rows",
    "buy_own": f"SELECT *, 1 - ({_unit('filled')}) AS own FROM buy_filled WINDOW w AS (PARTITION BY split)",
    "buy_wide": f"""
        SELECT *, CASE WHEN has_history THEN own ELSE median(own) OVER (PARTITION BY split) END AS recency,
               {_unit('n_occ')} AS frequency,
               {_unit(f'n_page_visit_{_A7}d + 3 * n_search_query_{_A7}d')} AS visit
        FROM buy_own WINDOW w AS (PARTITION BY split)""",
}


def _long(source: str, methods, label: str, y: str) -> str:
    return "\nUNION ALL ".join(
        f"""SELECT '{label}' AS label, split, '{m}' AS method, s, client_id, {y} AS y, {m} AS score
            FROM {source}"""
        for m in methods
    )


def _ranked(name: str) -> dict[str, str]:
    return {
        f"{name}_ranked": f"""
            SELECT *, row_number() OVER g AS place, sum(y) OVER (g ROWS UNBOUNDED PRECEDING) AS hits,
                   count(*) OVER (PARTITION BY label, split, method) AS n,
                   sum(y) OVER (PARTITION BY label, split, method) AS p
            FROM {name}_long
            WINDOW g AS (PARTITION BY label, split, method
                         ORDER BY score DESC, md5(strftime(s, '%Y-%m-%d') || '|' || CAST(client_id AS VARCHAR)))""",
        f"{name}_top": f"""
            SELECT *, hit / k AS prec, coalesce(hit / nullif(p, 0), 0) AS recall,
                   CASE WHEN p > 0 THEN (hit / k) / (p / n) ELSE 0 END AS lift
            FROM (SELECT label, split, method, rate, any_value(n) AS n, CAST(any_value(p) AS BIGINT) AS p,
                         any_value(k) AS k, CAST(sum(y) FILTER (place <= k) AS BIGINT) AS hit
                  FROM (SELECT *, greatest(1, CAST(round_even(n * rate / 100.0, 0) AS BIGINT)) AS k
                        FROM {name}_ranked, (SELECT unnest({sorted({*RATES, *P.metric_rates})}) AS rate))
                  GROUP BY 1, 2, 3, 4)""",
    }


METRIC_CTES = {
    **SCORE_CTES,
    "churn_long": _long("churn_wide", CHURN_RULES, f"churn_{SHORT}d", f"(label_{SHORT} = 0)::INT"),
    "buy_long": _long("buy_wide", BUY_RULES, f"will_purchase_{SHORT}d", f"label_{SHORT}"),
    **_ranked("churn"),
    **_ranked("buy"),
}


def evaluation_sql(name: str) -> str:
    tops = ", ".join(
        r(f"max({c}) FILTER (rate = {x})", f"{long}_at_{x}pct")
        for x in P.metric_rates
        for c, long in (("prec", "precision"), ("recall", "recall"), ("lift", "lift"))
    )
    clip = "least(greatest(score, 1e-6), 1 - 1e-6)"
    return f"""
        SELECT * FROM (
            SELECT label, split, method, count(*) AS n, {r('avg(y)', 'actual_positive_rate')},
                   {r(f'avg(-(y * ln({clip}) + (1 - y) * ln(1 - {clip})))', 'log_loss')},
                   {r(f'avg(({clip} - y) * ({clip} - y))', 'brier_score')}
            FROM {name}_long GROUP BY 1, 2, 3)
        JOIN ({quality_sql(name)}) USING (label, split, method)
        JOIN (SELECT label, split, method, {tops} FROM {name}_top GROUP BY 1, 2, 3) USING (label, split, method)"""


def quality_sql(name: str) -> str:
    return f"""
        SELECT label, split, method,
               {r("sum(pos * (nb + (n - pos) / 2)) / nullif(any_value(pp) * any_value(nn), 0)", 'roc_auc')},
               {r("sum(pos * cp / cn) / nullif(any_value(pp), 0)", 'pr_auc')}
        FROM (SELECT label, split, method, n, pos, sum(pos) OVER d AS cp, sum(n) OVER d AS cn,
                     coalesce(sum(n - pos) OVER (a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb,
                     sum(pos) OVER g AS pp, sum(n - pos) OVER g AS nn
              FROM (SELECT label, split, method, score, count(*) AS n, sum(y) AS pos FROM {name}_long GROUP BY ALL)
              WINDOW d AS (PARTITION BY label, split, method ORDER BY score DESC),
                     a AS (PARTITION BY label, split, method ORDER BY score),
                     g AS (PARTITION BY label, split, method))
        GROUP BY 1, 2, 3"""


def register(reg: Registry) -> None:
    G = ["label", "split", "method"]

    def store(fn):
        return lambda spark, sf: fn(from_event_table(spark, sf))

    def sql(body):
        return store_sql(body, METRIC_CTES)

    key = ["snapshot_date", "client_id", "split"]
    key_sql = f"{d('s', 'snapshot_date')}, client_id, split"

    # --- split and rule scores -------------------------------------------------------
    reg.add(
        "l01_chronological_split",
        store(
            lambda s: churn_panel(s).groupBy("snapshot_date", "split").agg(F.count(F.lit(1)).alias("n_rows"))
        ),
        sql(f"SELECT {d('s', 'snapshot_date')}, split, count(*) AS n_rows FROM churn_rows GROUP BY s, split"),
    )
    reg.add(
        "l02_minmax",
        store(
            lambda s: scores.scaled(
                churn_panel(s), {"unit_occasions": F.col("n_purchase_occasions_so_far"), "unit_constant": F.lit(7)}
            ).select(*key, "unit_occasions", "unit_constant")
        ),
        sql(
            f"""SELECT {key_sql}, {r(_unit('n_occ'), 'unit_occasions')}, 0.5::DOUBLE AS unit_constant
                FROM churn_rows WINDOW w AS (PARTITION BY split)"""
        ),
    )
    reg.add(
        "l03_random_score",
        store(lambda s: churn_panel(s).select(*key, scores.random_score(P.seed).alias("random_score"))),
        sql(
            f"""SELECT {key_sql}, {r(f"""CAST('0x' || substr(md5('{P.seed}|' || strftime(s, '%Y-%m-%d') || '|'
                || CAST(client_id AS VARCHAR)), 1, 13) AS BIGINT) / pow(2, 52)""", 'random_score')} FROM churn_rows"""
        ),
    )
    reg.add(
        "l04_base_rate",
        store(lambda s: scores.base_rate_score(churn_panel(s), f"churn_{SHORT}d").select(*key, "base_rate")),
        sql(
            f"""SELECT {key_sql}, {r(f"(SELECT avg((label_{SHORT} = 0)::INT) FROM churn_rows WHERE split = 'train')", 'base_rate')}
                FROM churn_rows"""
        ),
    )
    rules = [
        ("l05_recency_risk", lambda s: scores.recency_risk(churn_panel(s)), "recency_risk", "churn_wide", "recency"),
        ("l06_frequency_risk", lambda s: scores.frequency_risk(churn_panel(s), P), "frequency_risk", "churn_wide", "frequency"),
        (
            "l06_frequency_propensity",
            lambda s: scores.frequency_propensity(buy_panel(s)),
            "frequency_propensity",
            "buy_wide",
            "frequency",
        ),
        (
            "l07_lifecycle_tier_risk",
            lambda s: scores.lifecycle_tier_risk(churn_panel(s), P),
            "lifecycle_risk",
            "churn_wide",
            "lifecycle",
        ),
        (
            "l08_recency_propensity",
            lambda s: scores.recency_propensity(buy_panel(s)),
            "recency_propensity",
            "buy_wide",
            "recency",
        ),
        ("l09_visit_propensity", lambda s: scores.visit_propensity(buy_panel(s), P), "visit_propensity", "buy_wide", "visit"),
    ]
    for name, fn, column, source, sql_column in rules:
        reg.add(
            name,
            store(lambda s, fn=fn, column=column: fn(s).select(*key, column)),
            sql(f"SELECT {key_sql}, {r(sql_column, column)} FROM {source}"),
        )
    reg.add(
        "l10_impute_median",
        store(
            lambda s: scores.imputed(
                churn_panel(s), ["avg_purchase_gap_days_so_far", "avg_category_repurchase_rate"]
            ).select(
                *key,
                "avg_purchase_gap_days_so_far",
                "avg_purchase_gap_days_so_far_missing",
                "avg_category_repurchase_rate",
                "avg_category_repurchase_rate_missing",
            )
        ),
        sql(
            f"""SELECT {key_sql}, """
            + ", ".join(
                f"""{r(f"coalesce({c}, (SELECT median({c}) FROM churn_rows WHERE split = 'train'))", name)},
                    ({c} IS NULL)::INT AS {name}_missing"""
                for c, name in (("avg_gap", "avg_purchase_gap_days_so_far"), ("avg_rate", "avg_category_repurchase_rate"))
            )
            + " FROM churn_rows"
        ),
    )
    reg.add(
        "l11_standardise",
        store(
            lambda s: scores.standardised(
                churn_panel(s).select(*key, "days_since_last_purchase", "n_purchase_occasions_so_far"),
                ["days_since_last_purchase", "n_purchase_occasions_so_far"],
            )
        ),
        sql(
            f"SELECT {key_sql}, "
            + ", ".join(
                r(
                    f"""({c} - (SELECT avg({c}) FROM churn_rows WHERE split = 'train'))
                        / (SELECT stddev_pop({c}) FROM churn_rows WHERE split = 'train')""",
                    name,
                )
                for c, name in (("since", "days_since_last_purchase"), ("n_occ", "n_purchase_occasions_so_far"))
            )
            + " FROM churn_rows"
        ),
    )

    # --- metrics ---------------------------------------------------------------------
    def churn(fn):
        return store(lambda s: fn(churn_scored(s)))

    def buy(fn):
        return store(lambda s: fn(buy_scored(s)))

    reg.add(
        "e01_roc_auc",
        buy(lambda x: metrics.ranking_quality(x, G).select(*G, "roc_auc")),
        sql(f"SELECT label, split, method, roc_auc FROM ({quality_sql('buy')})"),
    )
    reg.add(
        "e02_average_precision",
        buy(lambda x: metrics.ranking_quality(x, G).select(*G, "pr_auc")),
        sql(f"SELECT label, split, method, pr_auc FROM ({quality_sql('buy')})"),
    )
    reg.add(
        "e03_log_loss_brier",
        buy(lambda x: metrics.probability_loss(x, G).select(*G, "log_loss", "brier_score")),
        sql(f"SELECT label, split, method, log_loss, brier_score FROM ({evaluation_sql('buy')})"),
    )
    reg.add("e04_full_evaluation_churn", churn(lambda x: metrics.full_evaluation(x, G, P.metric_rates)), sql(evaluation_sql("churn")))
    reg.add("e04_full_evaluation_propensity", buy(lambda x: metrics.full_evaluation(x, G, P.metric_rates)), sql(evaluation_sql("buy")))
    reg.add(
        "e05_roc_points",
        buy(lambda x: metrics.roc_points(x, G)),
        sql(
            f"""SELECT label, split, method, {r('score', 'threshold')}, {r('(cn - cp) / (nn - pp)', 'fpr')}, {r('cp / pp', 'tpr')}
                FROM (SELECT label, split, method, score, sum(pos) OVER d AS cp, sum(n) OVER d AS cn,
                             sum(pos) OVER g AS pp, sum(n) OVER g AS nn
                      FROM (SELECT label, split, method, score, count(*) AS n, sum(y) AS pos FROM buy_long GROUP BY ALL)
                      WINDOW d AS (PARTITION BY label, split, method ORDER BY score DESC),
                             g AS (PARTITION BY label, split, method))"""
        ),
    )
    reg.add(
        "e06_calibration",
        buy(lambda x: metrics.calibration_table(x, G)),
        sql(
            f"""SELECT label, split, method, CAST(bin AS INT) AS bin, {r('avg(score)', 'mean_predicted')}, {r('avg(y)', 'actual_rate')},
                count(*) AS n
                FROM (SELECT b.label, b.split, b.method, b.s, b.client_id, any_value(b.score) AS score, any_value(b.y) AS y,
                             greatest(1, count(*) FILTER (e.edge < b.score)) AS bin
                      FROM buy_long b JOIN (SELECT DISTINCT label, split, method, edge FROM (
                              SELECT label, split, method,
                                     unnest(quantile_cont(score, {[k / 10 for k in range(11)]})) AS edge
                              FROM buy_long GROUP BY 1, 2, 3)) e USING (label, split, method)
                      GROUP BY 1, 2, 3, 4, 5)
                GROUP BY 1, 2, 3, 4"""
        ),
    )

    # --- targeting -------------------------------------------------------------------
    top_cols = f"""label, split, method, CAST(rate AS DOUBLE) AS rate, n AS n_total, p AS pos_total, k AS n_selected,
        hit AS n_captured, {r('prec', 'precision')}, {r('recall')}, {r('lift')}"""
    reg.add(
        "p01_precision_recall_lift",
        buy(lambda x: metrics.precision_recall_lift(x, G, P.metric_rates)),
        sql(f"SELECT {top_cols} FROM buy_top WHERE rate IN {P.metric_rates}"),
    )

    def half_needed(x: DataFrame) -> DataFrame:
        totals = x.groupBy(*G).agg(F.sum("y").alias("p"))
        targets = totals.select(
            *G,
            F.explode(F.array(F.lit(10), F.lit(50), F.lit(90))).alias("rate"),
            "p",
        ).select(*G, "rate", F.ceil(F.col("p") * F.col("rate") / F.lit(100.0)).cast("bigint").alias("target"))
        return metrics.needed_for(x, G, targets)

    reg.add(
        "p02_needed_for_recall",
        buy(half_needed),
        sql(
            f"""SELECT label, split, method, rate, target,
                CASE WHEN any_value(p) = 0 THEN any_value(n) ELSE min(place) FILTER (hits >= target) END AS n_needed
                FROM (SELECT *, CAST(ceil(p * rate / 100.0) AS BIGINT) AS target
                      FROM buy_ranked, (SELECT unnest([10, 50, 90]) AS rate))
                GROUP BY 1, 2, 3, 4, 5"""
        ),
    )
    policy_cols = f"""label, split, CAST(rate AS INT) AS contact_rate_pct, method AS policy, n AS n_total, k AS n_selected,
        hit AS n_actual_captured, {r('prec', 'precision')}, {r('recall')}, {r('lift')}"""
    LS = ["label", "split"]
    reg.add(
        "p03_policy_table_churn",
        churn(lambda x: metrics.policy_table(x, LS, RATES)),
        sql(f"SELECT {policy_cols} FROM churn_top WHERE rate IN {RATES}"),
    )
    reg.add(
        "p03_policy_table_propensity",
        buy(lambda x: metrics.policy_table(x, LS, RATES)),
        sql(f"SELECT {policy_cols} FROM buy_top WHERE rate IN {RATES}"),
    )
    reg.add(
        "p04_rule_vs_rule",
        buy(lambda x: metrics.model_vs_rule(x, LS, RATES, "visit", "recency")),
        sql(
            f"""SELECT label, split, contact_rate_pct, 'visit_vs_recency_same_recall' AS policy, n_total, n_selected,
                n_actual_captured, {r('recall')}, need AS customers_needed_by_rule_for_same_recall,
                {r('(1 - n_selected / need) * 100', 'contact_reduction_pct')}
                FROM (SELECT t.label, t.split, CAST(t.rate AS INT) AS contact_rate_pct, t.n AS n_total, t.k AS n_selected,
                             t.hit AS n_actual_captured, any_value(t.recall) AS recall,
                             CASE WHEN any_value(t.p) = 0 THEN any_value(t.n) WHEN t.hit = 0 THEN 1
                                  ELSE min(x.place) FILTER (x.hits >= t.hit) END AS need
                      FROM buy_top t JOIN buy_ranked x ON t.label = x.label AND t.split = x.split
                      WHERE t.method = 'visit' AND x.method = 'recency' AND t.rate IN {RATES}
                      GROUP BY 1, 2, 3, 4, 5, 6)"""
        ),
    )
    reg.add(
        "f18_lift_curve",
        buy(lambda x: metrics.lift_curve(x, G)),
        sql(
            f"""SELECT label, split, method, CAST(pct AS INT) AS pct, any_value(k) AS n_selected,
                {r('(sum(y) FILTER (place <= k) / any_value(k)) / (any_value(p) / any_value(n))', 'lift')}
                FROM (SELECT *, greatest(1, CAST(floor(n * pct / 100.0) AS BIGINT)) AS k
                      FROM buy_ranked, (SELECT unnest(range(1, 101)) AS pct)) GROUP BY 1, 2, 3, 4"""
        ),
    )
