"""Models, experiment assignment, embedding clusters, sources and sinks."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..functions.dialect import day, parse_vector
from ..operators import checks, clusters, experiment, learn, marts, panel, profile, reports, scores
from ..plans.materialize import materialize, new_folder
from ..sources import sinks
from ..sources.store import CLIENT, DATED, WHOLE, build_in_steps
from ..sources.streams import from_event_table
from .base import Registry
from .scoring import METRIC_CTES, buy_panel, churn_panel
from .sql import STORE, d, r, store_sql

P = STORE
B = learn.Boosting()
SHORT = min(P.label_days)
KEY = ("snapshot_date", "client_id")
COVARIATES = ("days_since_last_purchase", f"n_page_visit_{P.activity_days}d", "n_purchase_occasions_so_far")


def register(reg: Registry) -> None:
    def store(fn):
        return lambda spark, sf: fn(from_event_table(spark, sf))

    def sql(body, extra=None):
        return store_sql(body, {**METRIC_CTES, **(extra or {})})

    # --- models ----------------------------------------------------------------------
    churn, buying = learn.churn_spec(P), learn.propensity_spec(P)

    def logistic(s):
        frame = materialize(learn.model_frame(churn_panel(s), churn, P))
        model = learn.fit_logistic(frame, f"churn_{SHORT}d")
        return learn.with_score(model, frame.filter("split = 'test'"), "logistic").select(*KEY, "logistic")

    def boosted(s):
        frame = materialize(learn.model_frame(churn_panel(s), churn, P))
        model = learn.fit_boosted(frame, [f"churn_{SHORT}d"], B)[f"churn_{SHORT}d"]
        return learn.with_score(model, frame.filter("split = 'test'"), "boosted").select(*KEY, "boosted")

    def importance(spark, sf):
        frame = materialize(learn.model_frame(buy_panel(from_event_table(spark, sf)), buying, P))
        model = learn.fit_boosted(frame, [f"will_purchase_{SHORT}d"], B)[f"will_purchase_{SHORT}d"]
        return learn.feature_importance(model, buying.features, spark)

    reg.add("l12_logistic_regression", store(logistic))
    reg.add("l13_boosted_trees", store(boosted))
    reg.add("l14_feature_importance", importance)
    reg.add("l16_train_and_evaluate_churn", store(lambda s: learn.train_and_evaluate(churn_panel(s), churn, P, B)))
    reg.add(
        "l16_train_and_evaluate_propensity", store(lambda s: learn.train_and_evaluate(buy_panel(s), buying, P, B))
    )
    horizons = replace(P, split_sizes=(4, 1, 1))
    reg.add(
        "l17_horizon_comparison",
        store(lambda s: learn.horizon_comparison(lambda q: panel.customer_snapshot(s, q), (3, 5, 7), horizons, B)),
    )
    reg.add(
        "m11_targeting_simulation",
        store(lambda s: learn.targeting_simulation([(churn, churn_panel(s)), (buying, buy_panel(s))], P, B)),
    )
    reg.add(
        "p05_targeting_grid_churn", store(lambda s: learn.targeting_simulation([(churn, churn_panel(s))], P, B))
    )
    reg.add(
        "c17_model_order",
        store(
            lambda s: checks.policy_order(
                materialize(learn.targeting_simulation([(buying, buy_panel(s))], P, B)), "boosted", "random"
            )
        ),
    )

    # --- experiment ------------------------------------------------------------------
    def latest(s):
        rows = scores.visit_propensity(buy_panel(s), P)
        return materialize(learn.latest_population(rows))

    def assigned(s):
        return experiment.assign(latest(s), "visit_propensity", P)

    bands = "CASE " + " ".join(
        f"WHEN pct >= {lo} AND pct < {hi} THEN '{name}'" for name, lo, hi in P.score_bands
    ) + " END"
    x_ctes = {
        "latest": "SELECT * FROM buy_wide WHERE s = (SELECT max(s) FROM buy_wide)",
        "ranked_latest": """SELECT *, (1 - (rank() OVER (ORDER BY visit) + (count(*) OVER (PARTITION BY visit) - 1) / 2)
                            / count(*) OVER ()) * 100 AS pct FROM latest""",
        "banded": f"SELECT * FROM (SELECT *, {bands} AS segment FROM ranked_latest) WHERE segment IS NOT NULL",
        "arms": f"""SELECT *, CASE WHEN row_number() OVER (PARTITION BY segment
                            ORDER BY md5('{P.seed}|' || CAST(client_id AS VARCHAR)), client_id)
                            <= floor(count(*) OVER (PARTITION BY segment) / 2) THEN 'Treatment' ELSE 'Control' END AS arm
                    FROM banded""",
    }
    reg.add(
        "x01_score_bands",
        store(
            lambda s: experiment.with_bands(latest(s), "visit_propensity", P).select(
                "client_id", "visit_propensity", "segment"
            )
        ),
        sql(f"SELECT client_id, {r('visit', 'visit_propensity')}, segment FROM banded", x_ctes),
    )
    reg.add(
        "x02_assignment",
        store(lambda s: assigned(s).select("client_id", "visit_propensity", "segment", "group")),
        sql(f"SELECT client_id, {r('visit', 'visit_propensity')}, segment, arm AS \"group\" FROM arms", x_ctes),
    )
    covariate_sql = {
        "days_since_last_purchase": "since",
        f"n_page_visit_{P.activity_days}d": f"n_page_visit_{P.activity_days}d",
        "n_purchase_occasions_so_far": "n_occ",
    }
    long = "\nUNION ALL ".join(
        f"SELECT '{name}' AS covariate, arm, CAST({c} AS DOUBLE) AS v FROM arms WHERE {c} IS NOT NULL"
        for name, c in covariate_sql.items()
    )
    reg.add(
        "x03_balance",
        store(
            lambda s: experiment.check_balance(assigned(s), COVARIATES).select(
                "covariate", "n_treatment", "n_control", "mean_treatment", "mean_control", "statistic"
            )
        ),
        sql(
            f"""SELECT covariate, count(*) FILTER (arm = 'Treatment') AS n_treatment,
                count(*) FILTER (arm = 'Control') AS n_control, {r("avg(v) FILTER (arm = 'Treatment')", 'mean_treatment')},
                {r("avg(v) FILTER (arm = 'Control')", 'mean_control')},
                {r('''sum(rk) FILTER (arm = 'Treatment') - count(*) FILTER (arm = 'Treatment')
                      * (count(*) FILTER (arm = 'Treatment') + 1) / 2''', 'statistic')}
                FROM (SELECT *, rank() OVER (PARTITION BY covariate ORDER BY v)
                             + (count(*) OVER (PARTITION BY covariate, v) - 1) / 2 AS rk FROM ({long}))
                GROUP BY 1""",
            x_ctes,
        ),
    )
    reg.add("x03_balance_test", store(lambda s: experiment.check_balance(assigned(s), COVARIATES)))

    # two market segments as arms within each nation: few customers each in small data
    def small_arms(spark, sf):
        rows = spark.read.parquet(f"{sf}/customer.parquet").filter("c_mktsegment IN ('BUILDING', 'MACHINERY')")
        arm = F.when(F.col("c_mktsegment") == "BUILDING", experiment.TREATMENT).otherwise(experiment.CONTROL)
        found = experiment.check_balance(rows.withColumn("group", arm), ["c_acctbal"], ["c_nationkey"])
        exact_p = F.when(F.col("exact"), F.col("p_value")).alias("exact_p")
        return found.select("c_nationkey", "n_treatment", "n_control", "statistic", "exact", exact_p)

    reg.add(
        "x03_balance_exact",
        small_arms,
        f"""WITH RECURSIVE v AS (
                SELECT c_nationkey, c_mktsegment = 'BUILDING' AS t, CAST(c_acctbal AS DOUBLE) AS x FROM customer
                WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')),
            ranked AS (
                SELECT *, rank() OVER (PARTITION BY c_nationkey ORDER BY x)
                          + (count(*) OVER (PARTITION BY c_nationkey, x) - 1) / 2 AS rk FROM v),
            arms AS (
                SELECT c_nationkey, count(*) FILTER (t) AS n, count(*) FILTER (NOT t) AS m,
                       count(DISTINCT x) = count(*) AS no_ties, sum(rk) FILTER (t) AS ranks FROM ranked GROUP BY 1),
            tested AS (
                SELECT *, CASE WHEN n > 0 AND m > 0 THEN ranks - n * (n + 1) / 2 END AS u,
                       n > 0 AND m > 0 AND no_ties AND least(n, m) <= {experiment.EXACT_ARM} AS exact FROM arms),
            -- ways to choose k of the ranks 1 .. total with a given sum
            ways AS (
                SELECT 0 AS total, 0 AS k, 0 AS s, CAST(1 AS DOUBLE) AS c
                UNION ALL
                SELECT total + 1, k + a, s + a * (total + 1), sum(c) FROM ways, (VALUES (0), (1)) AS step(a)
                WHERE k + a <= {experiment.EXACT_ARM}
                  AND total < (SELECT coalesce(max(n + m), 0) FROM tested WHERE exact) GROUP BY 1, 2, 3),
            tails AS (
                SELECT c_nationkey, least(1.0, 2 * sum(c) FILTER (s - k * (k + 1) / 2 <= least(u, n * m - u)) / sum(c)) AS p
                FROM tested JOIN ways ON exact AND total = n + m AND k = least(n, m) GROUP BY 1)
            SELECT c_nationkey, n AS n_treatment, m AS n_control, {r('u', 'statistic')}, exact, {r('p', 'exact_p')}
            FROM tested LEFT JOIN tails USING (c_nationkey)""",
    )
    reg.add(
        "x04_sample_ratio",
        store(
            lambda s: experiment.check_sample_ratio(assigned(s)).select("segment", "n_treatment", "n_control", "chi2")
        ),
        sql(
            f"""SELECT coalesce(segment, 'all') AS segment, count(*) FILTER (arm = 'Treatment') AS n_treatment,
                count(*) FILTER (arm = 'Control') AS n_control,
                {r('''pow(count(*) FILTER (arm = 'Treatment') - count(*) / 2, 2) / (count(*) / 2) * 2''', 'chi2')}
                FROM arms GROUP BY ROLLUP (segment)""",
            x_ctes,
        ),
    )
    reg.add("x04_sample_ratio_test", store(lambda s: experiment.check_sample_ratio(assigned(s))))
    kpi = f"will_purchase_{SHORT}d"
    moments = ["status", "kpi_col", "n_treatment", "n_control", "mean_treatment", "mean_control", "diff", "lift_pct", "ci_low", "ci_high"]

    def outcome(s):
        return experiment.evaluate(assigned(s).select("client_id", "group", kpi), kpi)

    t_, c_ = (f"FILTER (arm = '{x}')" for x in ("Treatment", "Control"))
    y = f"label_{SHORT}"
    se = f"sqrt(var_samp({y}) {t_} / count(*) {t_} + var_samp({y}) {c_} / count(*) {c_})"
    z = 1.959963984540054
    reg.add(
        "x05_experiment_result",
        store(lambda s: outcome(s).select(*moments)),
        sql(
            f"""SELECT 'measured' AS status, '{kpi}' AS kpi_col, count(*) {t_} AS n_treatment, count(*) {c_} AS n_control,
                {r(f'avg({y}) {t_}', 'mean_treatment')}, {r(f'avg({y}) {c_}', 'mean_control')},
                {r(f'avg({y}) {t_} - avg({y}) {c_}', 'diff')},
                {r(f'(avg({y}) {t_} / nullif(avg({y}) {c_}, 0) - 1) * 100', 'lift_pct')},
                {r(f'avg({y}) {t_} - avg({y}) {c_} - {z} * {se}', 'ci_low')},
                {r(f'avg({y}) {t_} - avg({y}) {c_} + {z} * {se}', 'ci_high')} FROM arms""",
            x_ctes,
        ),
    )
    reg.add("x05_experiment_test", store(outcome))
    reg.add(
        "x06_experiment_assignment",
        store(
            lambda s: learn.experiment_assignment(buy_panel(s), P, B).select(
                "client_id", "propensity_score", "segment", "group"
            )
        ),
    )

    # --- embeddings ------------------------------------------------------------------
    def embeddings(spark, sf):
        return spark.read.parquet(f"{sf}/embeddings.parquet")

    reg.add(
        "v01_parse_vector",
        lambda spark, sf: embeddings(spark, sf)
        .select(
            "vec_id",
            parse_vector(F.concat(F.lit("["), F.concat_ws("  ", F.transform("embedding", lambda x: F.round(x * 100, 0).cast("int").cast("string"))), F.lit(" ]"))).alias("v"),
        )
        .select("vec_id", F.size("v").alias("n_dims"), F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("total")),
        """SELECT vec_id, CAST(count(*) AS INT) AS n_dims, CAST(sum(x) AS DOUBLE) AS total
           FROM (SELECT vec_id, CAST(round(CAST(unnest(embedding) * 100 AS DOUBLE), 0) AS INT) AS x FROM embeddings) GROUP BY 1""",
    )
    def products(spark, sf):
        """Product vectors as their source has them: text, parsed; the label is the category."""
        text = F.concat(F.lit("["), F.concat_ws(" ", F.col("embedding").cast("array<string>")), F.lit("]"))
        return embeddings(spark, sf).select("vec_id", F.col("label").alias("category"), parse_vector(text).alias("v"))

    def clustered(spark, sf):
        return materialize(clusters.cluster(products(spark, sf), "v").select("vec_id", "category", "cluster"))

    reg.add("v02_inertia_by_k", lambda spark, sf: clusters.inertia_by_k(products(spark, sf), "v"))
    reg.add("v03_cluster", clustered)
    reg.add(
        "v03_cluster_agreement",
        lambda spark, sf: clusters.agreement(clustered(spark, sf), "category", "cluster"),
    )
    reg.add(
        "v03_cluster_purity", lambda spark, sf: clusters.purity(clustered(spark, sf), "cluster", "category")
    )

    def search_links(spark, sf):
        """Query vectors clustered, searches followed to purchases."""
        s = from_event_table(spark, sf)
        found = clusters.cluster(products(spark, sf), "v", k=20)
        labels = materialize(found.select(F.col("vec_id").cast("string").alias("query"), "cluster"))
        search = s.search.join(labels, "query").select("client_id", "event_ts", "cluster")
        return clusters.search_purchase_mix(search, clusters.search_to_purchase(search, s.buy, s.products))

    reg.add("v03_search_clusters_to_purchases", search_links)

    def peaks(spark, sf):
        peak = F.array_position("embedding", F.array_max("embedding"))
        return embeddings(spark, sf).select("vec_id", F.col("label").alias("category"), peak.cast("bigint").alias("cluster"))

    peak_cte = {
        "peaks": """SELECT vec_id, label AS category, CAST(list_position(embedding, list_max(embedding)) AS BIGINT) AS cluster
                    FROM embeddings"""
    }
    reg.add(
        "v04_agreement",
        lambda spark, sf: clusters.agreement(peaks(spark, sf), "category", "cluster"),
        store_sql(
            f"""SELECT {r('mi / ((ha + hb) / 2)', 'nmi')}, {r('(pc - pa * pb / pt) / ((pa + pb) / 2 - pa * pb / pt)', 'ari')} FROM (
                SELECT sum(n / t * ln(n * t / (na * nb))) AS mi, sum(n * (n - 1) / 2) AS pc, any_value(t * (t - 1) / 2) AS pt,
                       (SELECT sum(-c / t * ln(c / t)) FROM (SELECT count(*) AS c FROM peaks GROUP BY category)) AS ha,
                       (SELECT sum(-c / t * ln(c / t)) FROM (SELECT count(*) AS c FROM peaks GROUP BY cluster)) AS hb,
                       (SELECT sum(c * (c - 1) / 2) FROM (SELECT count(*) AS c FROM peaks GROUP BY category)) AS pa,
                       (SELECT sum(c * (c - 1) / 2) FROM (SELECT count(*) AS c FROM peaks GROUP BY cluster)) AS pb
                FROM (SELECT category, cluster, count(*) AS n, (SELECT count(*) FROM peaks) AS t,
                             (SELECT count(*) FROM peaks p WHERE p.category = x.category) AS na,
                             (SELECT count(*) FROM peaks p WHERE p.cluster = x.cluster) AS nb
                      FROM peaks x GROUP BY 1, 2) GROUP BY t)""",
            peak_cte,
        ),
    )

    def top_sql(cells, k):
        return f"""SELECT cluster, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_distinct_labels,
            {r('max(n) * 100.0 / sum(n)', 'top1_pct')},
            string_agg(category || ':' || n, ', ' ORDER BY rank) FILTER (rank <= {k}) AS top{k}
            FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, category) AS rank FROM ({cells}))
            GROUP BY 1"""

    reg.add(
        "v05_purity",
        lambda spark, sf: clusters.purity(peaks(spark, sf), "cluster", "category"),
        store_sql(top_sql("SELECT cluster, category, count(*) AS n FROM peaks GROUP BY 1, 2", 3), peak_cte),
    )
    reg.add(
        "v06_searching_buyers",
        store(lambda s: clusters.searching_buyers(s.search, s.buy)),
        store_sql("SELECT client_id FROM searches INTERSECT SELECT client_id FROM buys"),
    )

    def clustered_search(spark, sf, s):
        """Searches with the label of their query vector as the cluster."""
        labels = embeddings(spark, sf).select(F.col("vec_id").cast("string").alias("query"), F.col("label").alias("cluster"))
        return s.search.join(labels, "query").select("client_id", "event_ts", "cluster")

    def links(spark, sf):
        s = from_event_table(spark, sf)
        search = clustered_search(spark, sf, s)
        return search, clusters.search_to_purchase(search, s.buy, s.products)

    link_cte = {
        "asked": """SELECT client_id, event_ts, label AS cluster FROM searches
                    JOIN embeddings ON query = CAST(vec_id AS VARCHAR)""",
        "links": """SELECT a.cluster, category FROM asked a JOIN buys b ON a.client_id = b.client_id
                    AND b.event_ts > a.event_ts JOIN prod USING (sku)""",
    }
    reg.add(
        "v07_search_to_purchase",
        lambda spark, sf: links(spark, sf)[1],
        store_sql("SELECT cluster, category, count(*) AS n FROM links GROUP BY 1, 2", link_cte),
    )
    reg.add(
        "v07_search_purchase_mix",
        lambda spark, sf: clusters.search_purchase_mix(*links(spark, sf)),
        store_sql(
            f"""SELECT cluster, n_search_events, n_rows AS n_linked_purchases, n_distinct_labels AS n_distinct_categories,
                top1_pct AS top1_category_pct, top5 AS top5_categories
                FROM ({top_sql('SELECT cluster, category, count(*) AS n FROM links GROUP BY 1, 2', 5)})
                JOIN (SELECT cluster, count(*) AS n_search_events FROM asked GROUP BY 1) USING (cluster)""",
            link_cte,
        ),
    )
    reg.add(
        "v08_overall_category_share",
        lambda spark, sf: clusters.overall_category_share(links(spark, sf)[1]),
        store_sql(
            f"""SELECT category, count(*) AS n, {r('count(*) * 100.0 / (SELECT count(*) FROM links)', 'pct')}
                FROM links GROUP BY 1 ORDER BY n DESC, category LIMIT 5""",
            link_cte,
        ),
    )

    # --- catalogue, build, export ------------------------------------------------------
    def catalogue(spark, sf):
        s = from_event_table(spark, sf)
        for kind, df in s.by_type().items():
            df.createOrReplaceTempView(f"stg_{kind}")
        s.products.createOrReplaceTempView("stg_products")
        return sinks.catalogue(spark, ("stg_",))

    counts = "\nUNION ALL ".join(
        f"SELECT '{name}' AS table_name, count(*) AS n_rows FROM {source}"
        for name, source in (
            ("stg_page_visit", "visits"),
            ("stg_search_query", "searches"),
            ("stg_add_to_cart", "adds"),
            ("stg_remove_from_cart", "removes"),
            ("stg_product_buy", "buys"),
            ("stg_products", "prod"),
        )
    )
    reg.add("s03_catalogue", catalogue, store_sql(counts))
    marts_counts = "\nUNION ALL ".join(
        f"SELECT '{name}', count(*) FROM {source}"
        for name, source in (
            ("int_client_day", "daily"),
            ("int_client_rollup", "obs"),
            ("int_observation_period", "obs"),
            ("int_purchase_gap", "gaps"),
            ("int_purchase_history", "buys"),
            ("int_cart_behavior", "cart"),
            ("int_cart_pair", "(SELECT DISTINCT client_id, sku FROM ev WHERE event_type NOT IN ('page_visit', 'search_query'))"),
            ("int_category_start", "cats"),
            ("int_population", "prop"),
            ("int_daily_activity", "daily"),
            ("int_category_behavior", "cats"),
            ("int_category_repurchase", "cat_rate"),
            ("int_category_repurchase_avg", "cat_avg"),
            ("mart_customer_360", "c360"),
            ("mart_customer_daily", "daily"),
            ("mart_customer_weekly", "(SELECT DISTINCT client_id, date_trunc('week', activity_date) FROM daily)"),
            ("mart_customer_cohort", "cohort"),
            ("mart_customer_retention", "(SELECT DISTINCT cohort_week FROM cohort)"),
            ("mart_customer_lifecycle", "life"),
            ("mart_customer_segment", "seg"),
            ("mart_customer_snapshot", "snap"),
            ("mart_churn_target", "snap"),
            ("mart_purchase_propensity", "prop"),
        )
    )
    reg.add(
        "s04_build_layers",
        lambda spark, sf: sinks.row_counts(sinks.build_layers(from_event_table(spark, sf), P, new_folder(spark, "layers"))),
        store_sql(f"{counts}\nUNION ALL {marts_counts}"),
    )

    def in_steps(spark, sf):
        """The store built from the log up to its last day, then from that day."""
        s = from_event_table(spark, sf)
        last = s.bounds.select(day("hi")).first()[0]
        store = build_in_steps(s, P, new_folder(spark, "store"), [last] if last else [])
        names = ("int_client_day", *CLIENT, *DATED, *WHOLE)
        return sinks.row_counts({n: store.table(n) for n in names})

    steps_counts = "\nUNION ALL ".join(
        f"SELECT '{name}' AS table_name, count(*) AS n_rows FROM {source}"
        for name, source in (
            ("int_client_day", "daily"),
            ("int_client_rollup", "obs"),
            ("int_purchase_gap", "gaps"),
            ("int_cart_pair", "(SELECT DISTINCT client_id, sku FROM ev WHERE event_type NOT IN ('page_visit', 'search_query'))"),
            ("int_category_start", "cats"),
            ("int_population", "prop"),
            ("mart_customer_snapshot", "snap"),
            ("mart_purchase_propensity", "prop"),
            ("mart_customer_360", "c360"),
            ("mart_customer_lifecycle", "life"),
            ("mart_customer_segment", "seg"),
        )
    )
    reg.add("s04_incremental_build", in_steps, store_sql(steps_counts))

    def stepwise_snapshot(spark, sf):
        """The snapshot panel of a store that was built in two steps."""
        s = from_event_table(spark, sf)
        last = s.bounds.select(day("hi")).first()[0]
        store = build_in_steps(s, P, new_folder(spark, "store"), [last] if last else [])
        return store.table("mart_customer_snapshot").groupBy("snapshot_date").agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.sum("n_purchase_occasions_so_far").alias("n_occasions"),
            F.sum(F.col(f"label_purchase_{SHORT}d").cast("bigint")).alias("n_buying"),
        )

    reg.add(
        "s04_incremental_snapshot",
        stepwise_snapshot,
        store_sql(
            f"""SELECT {d('s', 'snapshot_date')}, count(*) AS n_rows, CAST(sum(n_occ) AS BIGINT) AS n_occasions,
                CAST(sum(CAST(label_{SHORT} AS INT)) AS BIGINT) AS n_buying FROM snap GROUP BY s"""
        ),
    )

    def exported(spark, sf):
        path = new_folder(spark, "csv")
        rows = reports.distribution(marts.customer_segment(from_event_table(spark, sf), P), "segment")
        sinks.export_csv(rows, path)
        return spark.read.option("header", True).schema("segment string, n bigint, pct double").csv(path)

    reg.add(
        "s05_csv_export",
        exported,
        store_sql(
            "SELECT segment, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS pct FROM seg GROUP BY 1"
        ),
    )
    reg.add(
        "s06_wide_to_long",
        store(lambda s: profile.as_metrics(s.products.agg(F.count("sku").alias("n_sku"), F.max("price_bucket").alias("top_bucket")))),
        store_sql(
            """SELECT 'n_sku' AS metric, CAST(count(sku) AS DOUBLE) AS value FROM prod
               UNION ALL SELECT 'top_bucket', CAST(max(price_bucket) AS DOUBLE) FROM prod"""
        ),
    )
