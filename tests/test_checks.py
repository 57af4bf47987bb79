"""Every check fires: hand-made rows with one planted violation per rule."""

from dataclasses import replace
from datetime import date, datetime

from conftest import streams_of

from tidemark import Params
from tidemark.operators import checks

P = replace(Params(), purchase_windows=(7, 14), label_days=(14,), retention_days=(7,), category_min_customers=5)


def counts(df):
    return {r.check_name: r.n_violations for r in df.collect()}


def only(df, name):
    """The named rule counts one row and every other none."""
    found = counts(df)
    assert found.pop(name) == 1, name
    assert set(found.values()) <= {0}, found


def ts(text):
    return datetime.fromisoformat(text)


def test_c01_repeated_key(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (2, 2)], "a int, b int")
    assert counts(checks.key_uniqueness({"t": (df, ["a", "b"]), "u": (df.filter("a = 2"), ["a", "b"])})) == {"t": 1, "u": 0}


def test_c02_lost_and_new_rows(spark):
    raw = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "event_type string")
    staged = spark.createDataFrame([("a",), ("b",), ("d",)], "event_type string")
    got = {r.event_type: r.is_violation for r in checks.row_conservation(raw, staged).collect()}
    assert got == {"a": True, "b": False, "c": True, "d": True}


def test_c03_burst_share(spark):
    df = spark.createDataFrame([("a", 5.0), ("b", 20.0)], "event_type string, burst_pct double")
    assert {r.event_type for r in checks.burst_share_range(df, 0, 10).filter("is_violation").collect()} == {"b"}


def test_c04_null_keys(spark):
    s = streams_of(spark, buy=[(None, "2024-01-01", 1), (1, None, 1), (1, "2024-01-01", None), (1, "2024-01-01", 1)])
    got = {(r.event_type, r.check_name): r.n_violations for r in checks.null_keys(s).collect()}
    assert [got["product_buy", c] for c in ("null_client", "null_time", "null_item")] == [1, 1, 1]
    assert sum(got.values()) == 3


def test_c05_product_range(spark):
    schema = "sku bigint, price_bucket bigint"
    only(checks.product_range(spark.createDataFrame([(1, 0), (2, 99), (3, 100)], schema)), "price_out_of_range")
    only(checks.product_range(spark.createDataFrame([(1, 0), (1, 99)], schema)), "sku_repeated")


def test_c06_totals(spark):
    events = spark.range(5)
    table = lambda *n: spark.createDataFrame([(x,) for x in n], "n_events_total bigint")
    assert not checks.total_agreement(events, table(2, 3), table(5)).first().is_violation
    assert checks.total_agreement(events, table(2, 2), table(5)).first().is_violation
    assert checks.total_agreement(events, table(2, 3), table(6)).first().is_violation


def test_c07_cart_customers(spark):
    s = streams_of(spark, add=[(1, "2024-01-01", 1), (2, "2024-01-01", 1)], remove=[(2, "2024-01-02", 1), (3, "2024-01-02", 1)])
    assert not checks.cart_customers(s, spark.range(3)).first().is_violation
    assert checks.cart_customers(s, spark.range(4)).first().is_violation


def test_c08_category_and_gap(spark):
    categories = lambda *c: spark.createDataFrame([(x,) for x in c], "category bigint")
    history = lambda *g: spark.createDataFrame([(x,) for x in g], "days_since_prev_purchase_occasion bigint")
    only(checks.category_and_gap(categories(1, None), history(0, None)), "null_category")
    only(checks.category_and_gap(categories(1), history(3, -1)), "negative_gap")


def test_c08a_pooled_gap(spark):
    rows = [(1, 2, 4), (1, 3, 6), (2, 2, 8)]
    history = spark.createDataFrame(rows, "client_id int, purchase_occasion_seq int, days_since_prev_purchase_occasion bigint")
    gaps = lambda *r: spark.createDataFrame(list(r), "gap bigint, n bigint")
    assert not checks.pooled_gap_agreement(history, gaps((4, 1), (6, 1), (8, 1))).first().is_violation
    assert checks.pooled_gap_agreement(history, gaps((4, 1), (6, 1), (9, 1))).first().is_violation
    assert checks.pooled_gap_agreement(history, gaps((5, 2), (8, 1))).first().is_violation


def test_c09_rates(spark):
    cohort = "cohort_week date, repurchase_7d_rate double, is_7d_window_censored boolean"
    category = lambda x: spark.createDataFrame([(x,)], "repurchase_rate double")
    good = [(date(2024, 1, 1), 0.5, False), (date(2024, 1, 8), 1.0, True)]
    frame = lambda rows: spark.createDataFrame(rows, cohort)
    assert set(counts(checks.rate_ranges(frame(good), category(1.0), P)).values()) == {0}
    only(checks.rate_ranges(frame([(date(2024, 1, 1), 1.1, False), good[1]]), category(1.0), P), "retention_7d_out_of_range")
    only(checks.rate_ranges(frame([good[0], (date(2024, 1, 8), 1.0, False)]), category(1.0), P), "last_cohort_not_censored")
    only(checks.rate_ranges(frame(good), category(-0.1), P), "category_rate_out_of_range")


def test_c10_lifecycle(spark):
    good = [("active", True, 3), ("cart", False, None)]
    for row, name in (
        ((None, True, 3), "no_stage"),
        (("cart", True, 3), "buyer_in_visitor_stage"),
        (("active", False, 3), "visitor_in_buyer_stage"),
        (("active", True, -1), "negative_recency"),
    ):
        df = spark.createDataFrame([*good, row], "lifecycle_stage string, is_buyer boolean, days_since_last_purchase int")
        found = counts(checks.lifecycle_rules(df))
        assert found[name] == 1 and sum(found.values()) == 1


def test_c11_segments(spark):
    good = [("active", "steady_repeat", None), ("cart", "cart_hold", "no_removal_recorded"), ("cart", "cart_abandon", "fast_removal")]
    for row, name in (
        (("active", "lapsed", None), "segment_not_of_stage"),
        (("active", "steady_repeat", "fast_removal"), "subtype_outside_cart"),
        (("cart", "cart_hold", None), "cart_without_subtype"),
        (("cart", "cart_hold", "fast_removal"), "hold_with_removal"),
        (("cart", "cart_abandon", "no_removal_recorded"), "abandon_without_removal"),
    ):
        df = spark.createDataFrame([*good, row], "lifecycle_stage string, segment string, cart_removal_subtype string")
        only(checks.segment_rules(df), name)


def test_c12_label_window(spark):
    s = streams_of(spark, buy=[(1, "2024-01-20 00:00:00", 1)])
    panel = spark.createDataFrame([(date(2024, 1, 6),), (date(2024, 1, 7),)], "snapshot_date date")
    only(checks.label_window(panel, s, P), "label_window_cut_off")


def test_c13_window_order(spark):
    schema = "n_purchases_7d int, n_purchases_14d int, n_purchase_occasions_so_far int"
    only(checks.window_order(spark.createDataFrame([(1, 1, 2), (2, 1, 2)], schema), P), "n_purchases_7d_above_n_purchases_14d")
    only(
        checks.window_order(spark.createDataFrame([(1, 3, 2)], schema), P), "n_purchases_14d_above_n_purchase_occasions_so_far"
    )


def test_c14_labels(spark):
    d = date(2024, 1, 1)
    snap = lambda *r: spark.createDataFrame(list(r), "snapshot_date date, client_id int, label_purchase_14d int, label_inactive_14d boolean")
    churn = lambda *r: spark.createDataFrame(list(r), "snapshot_date date, client_id int, churn_14d boolean")
    only(checks.label_rules(snap((d, 1, 1, False), (d, 2, 0, False)), churn((d, 1, False), (d, 2, False)), P), "inactive_14d_not_opposite")
    only(checks.label_rules(snap((d, 1, 2, False)), churn((d, 1, False)), P), "label_14d_not_0_or_1")
    only(checks.label_rules(snap((d, 1, 1, False)), churn((d, 1, True)), P), "churn_14d_differs")
    only(checks.label_rules(snap((d, 1, 1, False)), churn((d, 1, False), (d, 9, False)), P), "churn_14d_differs")


def test_c15_category_growth(spark):
    schema = "category int, snapshot_date date, n_customers int, n_repurchase_customers int"
    a, b = date(2024, 1, 1), date(2024, 1, 15)
    only(checks.category_growth(spark.createDataFrame([(1, a, 9, 1), (1, b, 8, 1)], schema), P), "customers_fall")
    only(checks.category_growth(spark.createDataFrame([(1, a, 4, 1)], schema), P), "below_min_sample")
    only(checks.category_growth(spark.createDataFrame([(1, a, 9, 10)], schema), P), "more_repeaters_than_customers")


def test_c16_history(spark):
    d = date(2024, 1, 1)
    schema = "snapshot_date date, client_id int, has_purchase_history boolean, days_since_last_purchase int, avg_category_repurchase_rate double"
    churn = spark.createDataFrame([(d, 1)], "snapshot_date date, client_id int")
    good = (d, 1, True, 3, 0.5)
    for row, name in (
        ((d, 2, True, None, None), "history_without_recency"),
        ((d, 2, False, 3, None), "recency_without_history"),
        ((d, 2, False, None, 0.1), "rate_without_history"),
    ):
        only(checks.history_rules(spark.createDataFrame([good, row], schema), churn), name)
    only(checks.history_rules(spark.createDataFrame([(d, 2, True, 3, 0.5)], schema), churn), "churn_row_not_in_propensity")


def test_c17_targeting(spark):
    schema = "label string, split string, policy string, contact_rate_pct int, n_total int, n_selected int, n_actual_captured int, recall double"
    good = [("l", "test", "p", 10, 1000, 100, 10, 0.1), ("l", "test", "p", 20, 1000, 200, 20, 0.2)]
    frame = lambda rows: spark.createDataFrame(rows, schema)
    assert set(counts(checks.targeting_rules(frame(good), (10, 20))).values()) == {0}
    only(checks.targeting_rules(frame([good[0], (*good[1][:5], 300, 20, 0.2)]), (10, 20)), "selected_share_off")
    only(checks.targeting_rules(frame([good[0], (*good[1][:7], 1.2)]), (10, 20)), "recall_out_of_range")
    only(checks.targeting_rules(frame([good[0], (*good[1][:6], 201, 0.2)]), (10, 20)), "captured_above_selected")
    only(checks.targeting_rules(frame(good[:1]), (10, 20)), "rates_missing")


def test_c17_order(spark):
    schema = "model string, label string, contact_rate_pct int, policy string, recall double, contact_reduction_pct double"
    rows = [("m", "l", 10, "a", 0.5, 3.0), ("m", "l", 10, "b", 0.4, None), ("m", "l", 20, "a", 0.5, 3.0), ("m", "l", 20, "b", 0.5, None)]
    only(checks.policy_order(spark.createDataFrame(rows, schema), "a", "b"), "not_above_worse_policy")
    only(checks.policy_order(spark.createDataFrame([rows[0][:5] + (-1.0,), rows[1]], schema), "a", "b"), "negative_reduction")


def test_c18_splits(spark):
    schema = "snapshot_date date, split string"
    day = lambda n: date(2024, 1, n)
    good = [(day(1), "train"), (day(2), "val"), (day(3), "test")]
    only(checks.split_rules(spark.createDataFrame([*good, (day(9), None)], schema), ["a"], ["b"]), "row_without_split")
    only(checks.split_rules(spark.createDataFrame([*good, (day(2), "train")], schema), ["a"], ["b"]), "split_overlaps_earlier")
    found = counts(checks.split_rules(spark.createDataFrame(good, schema), ["a"], ["a"]))
    assert found["label_among_features"] == 3


def test_c19_shares_and_notes(spark):
    shares = lambda *p: spark.createDataFrame([(x,) for x in p], "pct double")
    notes = lambda *r: spark.createDataFrame(list(r), "crm_purpose string, priority string, recommended_action string")
    only(checks.distribution_rules(shares(60.0, 39.0), notes(("a", "b", "c"))), "shares_not_100")
    only(checks.distribution_rules(shares(60.0, 40.0), notes(("a", "b", "c"), ("a", None, "c"))), "notes_missing")


def test_c20_funnel(spark):
    reach = lambda *n: spark.createDataFrame(list(enumerate(n)), "step int, n_customers int")
    s = streams_of(spark, buy=[(1, "2024-01-01", 1), (1, "2024-01-05", 1)])
    schema = "client_id bigint, is_buyer boolean, first_purchase_ts timestamp_ntz, last_purchase_ts timestamp_ntz"
    who = lambda a, b: spark.createDataFrame([(1, True, ts(a), ts(b))], schema)
    good = who("2024-01-01", "2024-01-05")
    assert set(counts(checks.funnel_rules(reach(9, 5, 5), good, s)).values()) == {0}
    only(checks.funnel_rules(reach(9, 5, 6), good, s), "step_grows")
    only(checks.funnel_rules(reach(9, 5), who("2024-01-02", "2024-01-05"), s), "first_purchase_differs")
    only(checks.funnel_rules(reach(9, 5), who("2024-01-01", "2023-12-31"), s), "first_purchase_after_last")
