from pyspark.sql import functions as F

from tidemark.operators import checks, facts, scores
from tidemark.plans.joins import spread_lookup


def test_repeated_lookup_is_never_broadcast(spark, capsys):
    """Its repeats are not in Spark's size estimate: left to itself, Spark broadcasts them all."""
    rows = spark.createDataFrame([(c, c % 3) for c in range(40)] + [(40, None), (41, 9)], "client_id bigint, sku bigint")
    lookup = spark.createDataFrame([(k, k * 10) for k in range(3)], "sku bigint, category bigint")
    for how, n in (("inner", 40), ("left", 42)):
        joined = spread_lookup(rows, lookup, ["sku"], ["client_id"], how=how)
        assert joined.count() == n
        assert all(r.category == (None if r.sku in (None, 9) else r.sku * 10) for r in joined.collect())
        joined.explain()
        assert "Broadcast" not in capsys.readouterr().out


def test_category_behavior_broadcasts_no_products(spark, capsys):
    buy = spark.sql("SELECT id AS client_id, TIMESTAMP_NTZ '2024-01-01' AS event_ts, id % 5 AS sku FROM range(20)")
    products = spark.sql("SELECT id AS sku, id % 2 AS category FROM range(4)")
    found = facts.category_behavior(buy, products)
    assert found.count() == 16
    found.explain()
    assert "Broadcast" not in capsys.readouterr().out


def test_scores_broadcast_their_statistics_and_not_the_panel(spark, capsys, tmp_path):
    """A written panel is small on disk, however many rows it has: Spark would broadcast it."""
    spark.sql(
        "SELECT id AS client_id, if(id % 2 = 0, 'train', 'test') AS split, id % 7 AS days_since_last_purchase, "
        "id % 7 > 0 AS has_purchase_history FROM range(1000)"
    ).write.parquet(str(tmp_path / "panel"))
    rows = spark.read.parquet(str(tmp_path / "panel"))
    for found in (
        scores.scaled(rows, {"unit": F.col("days_since_last_purchase")}),
        scores.recency_risk(rows),
        scores.recency_propensity(rows),
    ):
        assert found.count() == 1000
        found.explain()
        plan = capsys.readouterr().out
        assert "BuildRight" in plan and "BuildLeft" not in plan


def test_history_rules_broadcast_no_panel(spark, capsys, tmp_path):
    spark.sql(
        "SELECT DATE '2024-01-01' AS snapshot_date, id AS client_id, id % 2 = 0 AS has_purchase_history, "
        "if(id % 2 = 0, 3, NULL) AS days_since_last_purchase, CAST(NULL AS double) AS avg_category_repurchase_rate FROM range(50)"
    ).write.parquet(str(tmp_path / "wide"))
    wide = spark.read.parquet(str(tmp_path / "wide"))
    churn = spark.sql("SELECT DATE '2024-01-01' AS snapshot_date, id AS client_id FROM range(40, 60)")
    found = checks.history_rules(wide, churn)
    assert {r.check_name: (r.n_checked, r.n_violations) for r in found.collect()}["churn_row_not_in_propensity"] == (20, 10)
    found.explain()
    assert "Broadcast" not in capsys.readouterr().out
