"""Models are judged by their metrics on data with a planted signal."""

import random
from dataclasses import replace
from datetime import date, timedelta

import pytest

from tidemark import Params
from tidemark.operators import learn, scores
from tidemark.plans.materialize import materialize

P = replace(Params(), split_sizes=(3, 1, 2))
B = learn.Boosting(rounds=12, leaves=8, depth=3, min_rows=10, patience=4, keep=6)


@pytest.fixture(scope="module")
def panel(spark):
    rng = random.Random(3)
    rows = []
    for s in range(6):
        for c in range(400):
            history = rng.random() < 0.5
            days = rng.randrange(1, 90) if history else None
            visits, searches, adds = rng.randrange(12), rng.randrange(4), rng.randrange(3)
            # the signal is in the adds, which no rule looks at
            y = int(rng.random() < 0.05 + 0.3 * adds + (0.1 if history and days < 20 else 0))
            rate = rng.random() if history and rng.random() < 0.8 else None
            rows.append(
                (date(2024, 1, 1) + timedelta(days=14 * s), c, history, days, rng.randrange(1, 9) if history else 0,
                 visits, searches, adds, rng.randrange(3), rate, y, int(y or rng.random() < 0.1))
            )
    df = spark.createDataFrame(
        rows,
        "snapshot_date date, client_id bigint, has_purchase_history boolean, days_since_last_purchase bigint, "
        "n_purchase_occasions_so_far bigint, n_page_visit_28d bigint, n_search_query_28d bigint, n_add_to_cart_28d bigint, "
        "n_remove_from_cart_28d bigint, avg_category_repurchase_rate double, will_purchase_14d int, will_purchase_28d int",
    )
    return materialize(scores.chronological_split(df, P))


def test_models_beat_rules(panel):
    spec = replace(learn.propensity_spec(P), labels=("will_purchase_14d",))
    rows = learn.train_and_evaluate(panel, spec, P, B).collect()
    assert len(rows) == 14
    auc = {r.method: r.roc_auc for r in rows if r.split == "test"}
    best_rule = max(auc[m] for m in ("recency", "frequency", "visit"))
    assert auc["logistic"] > best_rule + 0.1 and auc["boosted"] > best_rule + 0.1
    assert auc["base_rate"] == 0.5 and abs(auc["random"] - 0.5) < 0.1


def test_importance_finds_the_signal(panel, spark):
    spec = learn.propensity_spec(P)
    model = learn.fit_boosted(materialize(learn.model_frame(panel, spec, P)), ["will_purchase_14d"], B)["will_purchase_14d"]
    top = learn.feature_importance(model, spec.features, spark).first()
    assert top.feature == "n_add_to_cart_28d"


def test_targeting_rows_and_order(panel):
    spec = replace(learn.propensity_spec(P), labels=("will_purchase_14d",))
    rows = learn.targeting_simulation([(spec, panel)], P, B).collect()
    assert len(rows) == 4 * 4  # random, recency, model, and model against recency
    recall = {(r.policy, r.contact_rate_pct): r.recall for r in rows}
    saved = [r.contact_reduction_pct for r in rows if r.contact_reduction_pct is not None]
    assert len(saved) == 4 and min(saved) > 0
    assert all(recall[("boosted", k)] > recall[("random", k)] for k in (5, 10, 20, 30))


def test_scores_are_reproducible(panel):
    spec = replace(learn.propensity_spec(P), labels=("will_purchase_14d",))
    frame = learn.model_frame(panel, spec, P)
    model = learn.fit_boosted(materialize(frame), ["will_purchase_14d"], B)["will_purchase_14d"]
    a = learn.label_scores(materialize(frame), spec, "will_purchase_14d", model)
    b = learn.label_scores(materialize(frame.repartition(5)), spec, "will_purchase_14d", model)
    key = ["split", "method", "snapshot_date", "client_id"]
    joined = a.join(b.withColumnRenamed("score", "other").select(*key, "other"), key)
    rule_rows = joined.filter("method <> 'boosted' and method <> 'logistic'")
    assert rule_rows.filter("score <> other").count() == 0 and joined.count() == a.count()


def test_experiment_covers_the_latest_snapshot(panel):
    rows = learn.experiment_assignment(panel, P, B).collect()
    assert len(rows) == len({r.client_id for r in rows}) and {r.group for r in rows} == {"Treatment", "Control"}


def test_rule_scores(spark):
    rows = [("test", 1, 10, True), ("test", 2, 20, True), ("test", 3, None, False), ("test", 4, 40, True)]
    df = spark.createDataFrame(rows, "split string, client_id bigint, days_since_last_purchase bigint, has_purchase_history boolean")
    risk = {r.client_id: r.recency_risk for r in scores.recency_risk(df).collect()}
    assert risk == pytest.approx({1: 0.0, 2: 10 / 70, 3: 1.0, 4: 30 / 70})
    got = {r.client_id: r.recency_propensity for r in scores.recency_propensity(df).collect()}
    # filled days 10, 20, 40, 40: scores 1, 2/3, 0, 0 with median 1/3
    assert got == pytest.approx({1: 1.0, 2: 2 / 3, 3: 1 / 3, 4: 0.0})
    none = df.filter("client_id = 3")
    assert scores.recency_propensity(none).first().recency_propensity == 0.5
    tier = {r.client_id: r.lifecycle_risk for r in scores.lifecycle_tier_risk(df, Params()).collect()}
    assert tier == pytest.approx({1: 0.0, 2: 1 / 3, 3: 1.0, 4: 2 / 3})


@pytest.mark.parametrize("n", [5, 9, 12])
def test_split_follows_the_grid(spark, n):
    rows = [(date(2024, 1, 1) + timedelta(days=k), k) for k in range(n)]
    df = spark.createDataFrame(rows, "snapshot_date date, client_id bigint")
    tags = [r.split for r in scores.chronological_split(df, Params()).orderBy("snapshot_date").collect()]
    assert tags == ["train"] * (n - 3) + ["val"] + ["test"] * 2


def test_split_of_a_short_grid_fails(spark):
    rows = [(date(2024, 1, 1) + timedelta(days=k), k) for k in range(3)]
    df = spark.createDataFrame(rows, "snapshot_date date, client_id bigint")
    with pytest.raises(Exception, match="too few snapshot dates"):
        scores.chronological_split(df, Params()).collect()


def test_impute_and_standardise(spark):
    rows = [("train", 1.0, True), ("train", 3.0, False), ("train", None, True), ("test", None, False), ("test", 9.0, True)]
    df = spark.createDataFrame(rows, "split string, x double, flag boolean")
    out = scores.imputed(df, ["x"], as_int=["flag"]).collect()
    assert [(r.x, r.x_missing, r.flag) for r in out] == [(1.0, 0, 1), (3.0, 0, 0), (2.0, 1, 1), (2.0, 1, 0), (9.0, 0, 1)]
    z = scores.standardised(df.select("split", "x").fillna(2.0), ["x"]).collect()
    assert z[0].x == pytest.approx(-1.224744871391589) and z[4].x == pytest.approx(7 / 0.816496580927726)
