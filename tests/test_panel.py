"""The grid form against the plain form: every event joined to every snapshot."""

import random
from dataclasses import replace
from datetime import date, datetime, timedelta

import pytest
from conftest import streams_of
from pyspark.sql import functions as F

from tidemark import Params
from tidemark.operators import panel
from tidemark.plans.grid import snapshot_dates

P = Params(
    grid_lead_days=7,
    grid_trail_days=7,
    grid_step_days=3,
    activity_days=7,
    purchase_windows=(2, 4, 7),
    label_days=(3, 7),
    category_min_customers=3,
    high_intent_visits=3,
)


@pytest.fixture(scope="module")
def streams(spark):
    rng = random.Random(11)
    start = datetime(2024, 1, 1)

    def some(n, item):
        out = []
        for _ in range(n):
            client = 1 if rng.random() < 0.33 else rng.randrange(2, 40)
            t = start + timedelta(seconds=rng.randrange(30 * 86400))
            if rng.random() < 0.25:  # exactly at midnight
                t = t.replace(hour=0, minute=0, second=0)
            out.append((client, t, item(rng)))
        return out

    products = [(k, k % 4 if k < 9 else None, k, "v") for k in range(10)]
    return streams_of(
        spark,
        buy=some(160, lambda r: r.randrange(12)),
        add=some(90, lambda r: r.randrange(12)),
        remove=some(60, lambda r: r.randrange(12)),
        visit=some(200, lambda r: r.randrange(50)),
        search=some(90, lambda r: "q"),
        products=products,
    )


def plain(spark, s, p):
    """Reference results straight from the definitions, by theta joins."""
    grid = snapshot_dates(s.bounds, p).select(F.col("snapshot_date").alias("s"))
    grid.createOrReplaceTempView("g")
    s.events.createOrReplaceTempView("e")
    s.products.createOrReplaceTempView("prod")
    spark.sql("SELECT DISTINCT client_id, event_ts FROM e WHERE event_type = 'product_buy'").createOrReplaceTempView("occ")
    labels = ", ".join(
        f"coalesce(max(CASE WHEN o.event_ts > s AND o.event_ts <= s + INTERVAL {n} DAY THEN 1 ELSE 0 END), 0) AS y{n}"
        for n in p.label_days
    )
    windows = ", ".join(f"count_if(event_ts >= s - INTERVAL {n} DAY) AS w{n}" for n in p.purchase_windows)
    spark.sql(
        f"""SELECT s, client_id, count(*) AS n, count(DISTINCT date(event_ts)) AS days, max(event_ts) AS last, {windows}
            FROM occ JOIN g ON event_ts < s GROUP BY 1, 2"""
    ).createOrReplaceTempView("past")
    spark.sql(
        f"""SELECT s, client_id, count_if(event_type = 'page_visit') AS cv, count_if(event_type = 'add_to_cart') AS ca,
            min(CASE WHEN event_type = 'page_visit' THEN event_ts END) AS fv,
            min(CASE WHEN event_type = 'search_query' THEN event_ts END) AS fs,
            count_if(event_type = 'page_visit' AND event_ts >= s - INTERVAL 7 DAY) AS v,
            count_if(event_type = 'search_query' AND event_ts >= s - INTERVAL 7 DAY) AS q,
            count_if(event_type = 'add_to_cart' AND event_ts >= s - INTERVAL 7 DAY) AS a,
            count_if(event_type = 'remove_from_cart' AND event_ts >= s - INTERVAL 7 DAY) AS r
            FROM e JOIN g ON event_ts < s GROUP BY 1, 2"""
    ).createOrReplaceTempView("act")
    spark.sql(
        f"SELECT s, a.client_id, {labels} FROM act a LEFT JOIN occ o ON a.client_id = o.client_id GROUP BY 1, 2"
    ).createOrReplaceTempView("lab")
    spark.sql(
        """SELECT s, client_id, count(DISTINCT category) AS cats FROM e JOIN prod USING (sku) JOIN g ON event_ts < s
           WHERE event_type = 'product_buy' GROUP BY 1, 2"""
    ).createOrReplaceTempView("cats")


def same(a, b):
    a, b = sorted(map(tuple, a.collect()), key=str), sorted(map(tuple, b.collect()), key=str)
    assert len(a) > 0 and a == b


def test_snapshot_equals_theta_form(spark, streams):
    plain(spark, streams, P)
    got = panel.customer_snapshot(streams, P).select(
        "snapshot_date", "client_id", "last_purchase_ts", "n_purchase_occasions_so_far", "n_purchase_days_so_far",
        "n_purchases_2d", "n_purchases_4d", "n_purchases_7d", "n_categories_so_far",
        "n_page_visit_7d", "n_search_query_7d", "n_add_to_cart_7d", "n_remove_from_cart_7d",
        "label_purchase_3d", "label_purchase_7d",
    )
    want = spark.sql(
        """SELECT s, client_id, last, n, days, w2, w4, w7, coalesce(cats, 0), v, q, a, r, y3, y7
           FROM past JOIN act USING (s, client_id) JOIN lab USING (s, client_id) LEFT JOIN cats USING (s, client_id)"""
    )
    same(got, want)


def test_propensity_population_equals_theta_form(spark, streams):
    plain(spark, streams, P)
    got = panel.purchase_propensity(streams, P).select(
        "snapshot_date", "client_id", "has_purchase_history", "n_purchase_occasions_so_far", "n_page_visit_7d",
        "will_purchase_3d", "will_purchase_7d",
    )
    want = spark.sql(
        f"""SELECT s, client_id, n IS NOT NULL, coalesce(n, 0), v, y3, y7
            FROM act JOIN lab USING (s, client_id) LEFT JOIN past USING (s, client_id)
            WHERE n IS NOT NULL OR cv >= {P.high_intent_visits} OR fs < fv OR ca > 0"""
    )
    same(got, want)


UNEVEN = tuple(date(2024, 1, k) for k in (22, 9, 10, 13, 21, 2, 30, 9))


def test_listed_dates_equal_theta_form(spark, streams):
    p = replace(P, snapshot_days=UNEVEN)
    dates = sorted(r.snapshot_date.day for r in snapshot_dates(streams.bounds, p).collect())
    assert dates == [9, 10, 13, 21, 22]  # the 2nd and the 30th are outside lead and trail
    plain(spark, streams, p)
    got = panel.customer_snapshot(streams, p).select(
        "snapshot_date", "client_id", "last_purchase_ts", "n_purchase_occasions_so_far", "n_purchase_days_so_far",
        "n_purchases_2d", "n_purchases_4d", "n_purchases_7d", "n_categories_so_far",
        "n_page_visit_7d", "n_search_query_7d", "n_add_to_cart_7d", "n_remove_from_cart_7d",
        "label_purchase_3d", "label_purchase_7d",
    )
    want = spark.sql(
        """SELECT s, client_id, last, n, days, w2, w4, w7, coalesce(cats, 0), v, q, a, r, y3, y7
           FROM past JOIN act USING (s, client_id) JOIN lab USING (s, client_id) LEFT JOIN cats USING (s, client_id)"""
    )
    same(got, want)
    since = panel.customer_snapshot(streams, p, since=date(2024, 1, 13))
    same(since, panel.customer_snapshot(streams, p).filter("snapshot_date >= DATE '2024-01-13'"))


def test_regular_dates_may_be_listed(spark, streams):
    regular = panel.purchase_propensity(streams, P)
    dates = tuple(r.snapshot_date for r in snapshot_dates(streams.bounds, P).collect())
    same(panel.purchase_propensity(streams, replace(P, snapshot_days=dates)), regular)


def test_listed_dates_are_not_joined(spark, streams):
    plan = panel.customer_snapshot(streams, replace(P, snapshot_days=UNEVEN))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_no_listed_date_fits(spark, streams):
    p = replace(P, snapshot_days=(date(2023, 5, 1), date(2024, 1, 2), date(2025, 1, 1)))
    assert snapshot_dates(streams.bounds, p).count() == 0
    assert panel.customer_snapshot(streams, p).count() == 0


@pytest.mark.parametrize("step, lead, window", [(1, 3, 7), (5, 0, 2), (14, 10, 3)])
def test_other_grids(spark, streams, step, lead, window):
    p = replace(P, grid_step_days=step, grid_lead_days=lead, activity_days=7, purchase_windows=(window, 4, 9))
    plain(spark, streams, p)
    got = panel.customer_snapshot(streams, p).select(
        "snapshot_date", "client_id", "n_purchase_occasions_so_far", f"n_purchases_{window}d", "n_page_visit_7d", "label_purchase_7d"
    )
    want = spark.sql(f"SELECT s, client_id, n, w{window}, v, y7 FROM past JOIN act USING (s, client_id) JOIN lab USING (s, client_id)")
    same(got, want)


def test_category_rates_equal_theta_form(spark, streams):
    plain(spark, streams, P)
    counts = """SELECT s, client_id, category, count(DISTINCT event_ts) AS k FROM e JOIN prod USING (sku) JOIN g ON event_ts < s
                WHERE event_type = 'product_buy' GROUP BY 1, 2, 3"""
    rates = f"""SELECT s, category, count(*) AS n, count_if(k >= 2) AS r, avg(CAST(k >= 2 AS INT)) AS rate
                FROM ({counts}) GROUP BY 1, 2 HAVING count(*) >= {P.category_min_customers}"""
    got = panel.category_repurchase_by_snapshot(streams, P)
    same(got.select("snapshot_date", "category", "n_customers", "n_repurchase_customers"), spark.sql(f"SELECT s, category, n, r FROM ({rates})"))
    avg = panel.category_repurchase_avg_by_snapshot(streams, P).withColumn("x", F.round("avg_category_repurchase_rate", 9))
    want = spark.sql(
        f"""SELECT a.s, client_id, round(avg(rate), 9) FROM ({counts}) a LEFT JOIN ({rates}) b
            ON a.s = b.s AND a.category = b.category GROUP BY 1, 2"""
    )
    same(avg.select("snapshot_date", "client_id", "x"), want)


def test_all_small_categories_give_null(spark, streams):
    p = replace(P, category_min_customers=10_000)
    rows = panel.category_repurchase_avg_by_snapshot(streams, p).collect()
    assert rows and all(r.avg_category_repurchase_rate is None for r in rows)


def test_short_log_gives_empty_grid(spark):
    s = streams_of(spark, buy=[(1, "2024-01-01", 1), (1, "2024-01-20", 1)], products=[(1, 1, 0, "x")])
    p = Params()
    assert snapshot_dates(s.bounds, p).count() == 0
    assert panel.customer_snapshot(s, p).count() == 0
    assert panel.purchase_propensity(s, p).count() == 0


def test_default_grid_has_nine_dates(spark):
    s = streams_of(spark, buy=[(1, "2022-06-23 00:10:00", 1), (1, "2022-12-08 00:09:59", 1)])
    dates = [str(r.snapshot_date) for r in snapshot_dates(s.bounds, Params()).orderBy("snapshot_date").collect()]
    assert len(dates) == 9 and dates[0] == "2022-07-21" and dates[-1] == "2022-11-10"


def test_event_at_snapshot_midnight_is_in_neither_side(spark):
    s = streams_of(
        spark,
        buy=[(1, "2024-01-02 00:00:00", 1), (1, "2024-01-08 00:00:00", 1), (2, "2024-01-03", 1), (2, "2024-01-11 00:00:00", 1)],
        visit=[(5, "2024-01-01 00:00:00", 1), (5, "2024-01-30 00:00:00", 1)],
        products=[(1, 1, 0, "x")],
    )
    rows = {(str(r.snapshot_date), r.client_id): r for r in panel.customer_snapshot(s, P).collect()}
    first = rows[("2024-01-08", 1)]
    assert first.n_purchase_occasions_so_far == 1 and first.label_purchase_3d == 0 and first.label_inactive_3d
    # a label window ends with the midnight of its last day
    assert rows[("2024-01-08", 2)].label_purchase_3d == 1
