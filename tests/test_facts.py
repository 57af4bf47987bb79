from datetime import datetime, timedelta

import pytest
from conftest import SKU, streams_of, ts

from tidemark import Params
from tidemark.operators import facts, marts, profile, staging

P = Params()


def by(df, *key):
    return {tuple(r[k] for k in key) if len(key) > 1 else r[key[0]]: r for r in df.collect()}


def test_burst_counts_second_boundaries_and_flags_zero_gap(spark):
    s = streams_of(
        spark,
        buy=[
            (1, "2024-01-01 00:00:00", 7),
            (1, "2024-01-01 00:00:00", 7),
            (1, "2024-01-01 00:00:05", 7),
            (1, "2024-01-01 00:00:11", 7),
            (1, "2024-01-01 00:00:12", 8),
            (2, "2024-01-01 00:00:00.900000", 7),
            (2, "2024-01-01 00:00:06.100000", 7),
            (3, "2024-01-01 00:00:00.900000", 7),
            (3, "2024-01-01 00:00:05.999000", 7),
        ],
    )
    rows = staging.staged(s, "product_buy", P).orderBy("client_id", "event_ts", "sku", "is_burst_repeat").collect()
    assert [r.is_burst_repeat for r in rows] == [False, True, True, False, False, False, False, False, True]


def test_burst_looks_back_over_a_slice_edge(spark):
    # slices are 600 s wide for 5 s bursts; 00:10:00 opens a new one
    s = streams_of(
        spark,
        search=[
            (1, "2024-01-01 00:09:54", "a"),
            (1, "2024-01-01 00:09:58", "a"),
            (1, "2024-01-01 00:10:01", "a"),
            (1, "2024-01-01 00:19:50", "a"),
            (1, "2024-01-01 00:20:00", "a"),
            (2, "2024-01-01 00:09:55", "a"),
            (2, "2024-01-01 00:10:00", "a"),
        ],
    )
    got = [r.is_burst_repeat for r in staging.staged(s, "search_query", P).orderBy("client_id", "event_ts").collect()]
    assert got == [False, True, True, False, False, False, True]


def test_burst_equals_plain_lag_for_a_hot_client(spark):
    import random

    rng = random.Random(3)
    start = datetime(2024, 1, 1)
    rows = [(1, start + timedelta(milliseconds=rng.randrange(40_000_000)), rng.randrange(3)) for _ in range(6000)]
    rows += [(rng.randrange(2, 50), start + timedelta(seconds=rng.randrange(40_000)), 1) for _ in range(2000)]
    s = streams_of(spark, add=rows)
    got = sorted((r.client_id, r.sku, r.event_ts, r.is_burst_repeat) for r in staging.staged(s, "add_to_cart", P).collect())
    last, want = {}, []
    for c, t, k in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        prev = last.get((c, k))
        sec = int((t - start).total_seconds())
        want.append((c, k, t, prev is not None and 0 <= sec - prev <= 5))
        last[(c, k)] = sec
    assert got == sorted(want)


def test_rows_without_time_are_kept_in_staging(spark):
    s = streams_of(spark, buy=[(1, None, 7), (1, "2024-01-01 00:00:00", 7)])
    rows = staging.staged(s, "product_buy", P).collect()
    assert len(rows) == 2 and not any(r.is_burst_repeat for r in rows)


def test_purchase_gap_by_occasion(spark):
    s = streams_of(
        spark,
        buy=[
            (1, "2024-01-01 23:59:00", 1),
            (1, "2024-01-01 23:59:00", 2),
            (1, "2024-01-02 00:01:00", 1),
            (1, "2024-01-02 05:00:00", 1),
            (1, "2024-01-10 05:00:00", 1),
            (2, "2024-01-05 05:00:00", 1),
            (3, "2024-01-05 05:00:00", 1),
            (3, "2024-01-09 05:00:00", 1),
        ],
    )
    rows = by(facts.purchase_gap(s.buy), "client_id")
    assert rows[1].n_purchases == 5 and rows[1].n_purchase_days == 3
    assert rows[1].avg_purchase_gap_days == 3.0  # gaps 1, 0, 8
    assert rows[1].min_purchase_gap_days == 0 and rows[1].max_purchase_gap_days == 8
    assert rows[1].stddev_purchase_gap_days == pytest.approx(4.358898943540674)
    assert rows[2].avg_purchase_gap_days is None and rows[2].min_purchase_gap_days is None
    assert rows[3].avg_purchase_gap_days == 4.0 and rows[3].stddev_purchase_gap_days is None


def test_purchase_history_places(spark):
    s = streams_of(
        spark,
        buy=[
            (1, "2024-01-01 10:00:00", 2),
            (1, "2024-01-01 10:00:00", 1),
            (1, "2024-01-01 12:00:00", 1),
            (1, "2024-01-04 01:00:00", 9),
        ],
    )
    rows = facts.purchase_history(s.buy).orderBy("raw_row_seq").collect()
    assert [r.sku for r in rows] == [1, 2, 1, 9]
    assert [r.purchase_occasion_seq for r in rows] == [1, 1, 2, 3]
    assert [r.days_since_prev_purchase_occasion for r in rows] == [None, None, 0, 3]
    assert [r.is_first_observed_purchase for r in rows] == [True, True, False, False]


def test_cart_edges(spark):
    s = streams_of(
        spark,
        add=[
            (1, "2024-01-01 10:00:00", 5),
            (1, "2024-01-03 10:00:00", 5),
            (2, "2024-01-02 10:00:00", 5),
            (4, "2024-01-02 10:00:00", 5),
        ],
        remove=[
            (1, "2024-01-01 09:00:00", 5),
            (1, "2024-01-01 10:00:00", 5),
            (3, "2024-01-01 10:00:00", 5),
            (4, "2024-01-01 10:00:00", 5),
            (4, "2024-01-09 10:00:00", 5),
        ],
        buy=[(1, "2024-01-01 12:30:00", 5), (2, "2024-01-01 10:00:00", 5), (2, "2024-01-05 10:00:00", 5)],
    )
    rows = by(facts.cart_behavior(s), "client_id")
    assert rows[1].n_add == 2 and rows[1].n_add_distinct_sku == 1 and rows[1].n_remove == 2
    assert rows[1].median_seconds_add_to_remove == 0.0
    assert rows[1].n_add_to_buy_pairs == 1 and rows[1].avg_hours_add_to_buy == 2.5
    # the first buy lies before the add, so the pair is dropped although a later buy exists
    assert rows[2].n_add_to_buy_pairs == 0 and rows[2].avg_hours_add_to_buy is None
    # removals alone
    assert rows[3].n_add == 0 and rows[3].first_add_ts is None and rows[3].median_seconds_add_to_remove is None
    assert rows[4].median_seconds_add_to_remove == 7 * 86400


def test_hot_pair_first_removal_matches_brute_force(spark):
    import random

    rng = random.Random(5)
    start = datetime(2024, 1, 1)

    def some(n, hot):
        return [
            (1 if rng.random() < hot else rng.randrange(2, 40), start + timedelta(seconds=rng.randrange(400_000)), 1)
            for _ in range(n)
        ]

    add, remove = some(800, 0.4), some(2000, 0.4)
    s = streams_of(spark, add=add, remove=remove)
    got = {r.client_id: r.remove_after_add_ts for r in facts.cart_pairs(s).collect()}
    for c in got:
        firsts = [t for k, t, _ in add if k == c]
        after = [t for k, t, _ in remove if k == c and firsts and t >= min(firsts)]
        assert got[c] == (min(after) if after else None)


def test_purchase_counts_include_rows_without_time(spark):
    s = streams_of(spark, buy=[(1, None, 1), (1, "2024-01-01 00:00:00", 1)])
    r = facts.purchase_gap(s.buy).collect()[0]
    assert (r.n_purchases, r.n_purchase_days, r.avg_purchase_gap_days) == (2, 1, None)


LIFE = [
    # client, purchases, expected stage with the log ending 2024-04-10
    (1, ["2024-04-01"], "first_purchase"),
    (2, ["2024-03-20", "2024-04-01"], "active"),
    (3, ["2024-02-01", "2024-04-01"], "returned"),
    (4, ["2024-03-20"], "declining"),
    (5, ["2024-02-20"], "at_risk"),
    (6, ["2024-01-20"], "inactive"),
    # 14 and 28 days are still inside, a gap of exactly 28 is no return
    (7, ["2024-02-28", "2024-03-27"], "active"),
    (8, ["2024-03-13"], "declining"),
    (9, ["2024-02-10"], "at_risk"),
]


def test_lifecycle_and_segments(spark):
    s = streams_of(
        spark,
        buy=[(c, f"{d} 12:00:00", 1) for c, dates, _ in LIFE for d in dates],
        add=[(20, "2024-04-01 00:00:00", 1), (22, "2024-04-01 00:00:00", 1), (22, "2024-04-02 00:00:00", 2)],
        remove=[
            (21, "2024-04-01 00:00:00", 1),
            (22, "2024-04-01 06:00:00", 1),
            (23, "2024-04-01 06:00:01", 1),
        ],
        visit=[(30, f"2024-04-0{d} 00:00:00", d) for d in range(1, 10)]
        + [(31, f"2024-04-0{d} 00:00:00", d) for d in range(1, 10)]
        + [(31, "2024-04-10 00:00:00", 1), (32, "2024-04-02 00:00:00", 1), (33, "2024-04-02 00:00:00", 1)],
        search=[(32, "2024-04-01 00:00:00", "q"), (33, "2024-04-02 00:00:00", "q"), (34, "2024-04-02 00:00:00", "q")],
    )
    stages = {c: r.lifecycle_stage for c, r in by(marts.customer_lifecycle(s, P), "client_id").items()}
    assert {c: stages[c] for c, _, _ in LIFE} == {c: want for c, _, want in LIFE}
    seg = by(marts.customer_segment(s, P), "client_id")
    assert seg[20].segment == "cart_hold" and seg[20].cart_removal_subtype == "no_removal_recorded"
    assert seg[21].segment == "cart_hold"  # removals alone leave no gap
    assert seg[22].segment == "cart_abandon" and seg[22].cart_removal_subtype == "fast_removal"
    assert seg[30].segment == "low_intent_explorer" and seg[31].segment == "high_intent_explorer"
    assert seg[32].segment == "high_intent_explorer"  # searched first
    assert seg[33].segment == "low_intent_explorer"  # search and visit at the same instant
    assert seg[34].segment == "low_intent_explorer"
    assert seg[5].segment == seg[6].segment == "lapsed" and seg[5].cart_removal_subtype is None
    c360 = by(marts.customer_360(s, P), "client_id")
    assert c360[21].has_cart_activity and not c360[21].is_buyer and not c360[1].is_repeat_capable


def test_last_gap_of_two_occasions_on_one_day_is_zero(spark):
    s = streams_of(
        spark, buy=[(1, "2024-01-01 10:00:00", 1), (1, "2024-03-01 10:00:00", 1), (1, "2024-03-01 11:00:00", 1)]
    )
    r = marts.customer_lifecycle(s, P).collect()[0]
    assert r.gap_before_last_purchase == 0 and r.lifecycle_stage == "active"


def test_retention_window_is_closed_at_its_end(spark):
    s = streams_of(
        spark,
        buy=[
            (1, "2024-01-02 10:00:00", 1),
            (1, "2024-01-09 10:00:00", 1),
            (2, "2024-01-03 10:00:00", 1),
            (2, "2024-01-10 10:00:01", 1),
            (3, "2024-01-04 10:00:00", 1),
        ],
        visit=[(9, "2024-02-20 00:00:00", 1)],
        products=[(1, 4, 0, "x")],
    )
    r = marts.customer_retention(s, P).collect()[0]
    assert r.n_customers_in_cohort == 3
    assert r.repurchase_7d_rate == pytest.approx(1 / 3) and r.repurchase_14d_rate == pytest.approx(2 / 3)
    assert r.avg_category_diversity == 1.0 and not r.is_28d_window_censored


def test_overlap_masks(spark):
    s = streams_of(
        spark,
        buy=[(1, "2024-01-01", 1), (2, "2024-01-01", 1)],
        add=[(1, "2024-01-01", 1)],
        visit=[(3, "2024-01-01", 1), (1, "2024-01-02", 1)],
    )
    m = {r.metric: r.value for r in profile.client_overlap(s.events).collect()}
    assert m["total_unique_clients_union"] == 3 and m["intersect_buy_and_cart"] == 1
    assert m["clients_with_only_1_event_type"] == 2 and m["clients_with_all_5_events"] == 0


def test_pre_purchase_browsing_is_strict(spark):
    s = streams_of(
        spark,
        buy=[(1, "2024-01-02 10:00:00", 1), (1, "2024-01-01 23:00:00", 1)],
        visit=[
            (1, "2024-01-01 22:59:59", 1),
            (1, "2024-01-01 23:00:00", 1),
            (1, "2024-01-01 01:00:00", 1),
            (1, "2023-12-01 01:00:00", 1),
            (2, "2023-12-01 01:00:00", 1),
        ],
    )
    rows = by(profile.pre_purchase_browsing(s), "event_type")
    assert set(rows) == {"page_visit"} and rows["page_visit"].mean_per_client == 3.0


def test_schema_of_typed_events(spark):
    from tidemark.sources.streams import typed_events

    raw = spark.createDataFrame([(1, "2024-01-01 00:00:00", 5), (1, "bad", 6)], "client_id bigint, timestamp string, sku bigint")
    out = typed_events(raw, "sku")
    assert out.schema.simpleString() == f"struct<{SKU.replace(', ', ',').replace(' ', ':')}>"
    assert [r.event_ts for r in out.orderBy("sku").collect()] == [ts("2024-01-01 00:00:00"), None]
