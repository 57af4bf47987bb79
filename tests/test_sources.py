from tidemark import Params
from tidemark.operators import marts, reports
from tidemark.sources import sinks
from tidemark.sources.streams import read_streams

P = Params()


def write_raw(spark, folder):
    rows = {
        "product_buy": ("sku bigint", [(1, "2024-01-02 10:00:00", 5), (1, "2024-02-20 10:00:00", 5), (2, "bad", 6)]),
        "add_to_cart": ("sku bigint", [(1, "2024-01-02 09:00:00", 5), (3, "2024-03-01 00:00:00", 6)]),
        "remove_from_cart": ("sku bigint", [(3, "2024-03-01 01:00:00", 6)]),
        "page_visit": ("url bigint", [(4, "2024-01-01 00:00:00", 9), (4, "2024-03-20 00:00:00", 9)]),
        "search_query": ("query string", [(4, "2024-01-01 00:00:00", "[1 2]")]),
    }
    for name, (item, data) in rows.items():
        df = spark.createDataFrame(data, f"client_id bigint, timestamp string, {item}")
        df.write.parquet(f"{folder}/{name}.parquet")
    spark.createDataFrame(
        [(5, 50, 3, "[1 2]"), (6, 60, 4, "[3 4]")], "sku bigint, category bigint, price bigint, name string"
    ).write.parquet(f"{folder}/product_properties.parquet")


def test_layers_from_raw_files(spark, tmp_path):
    write_raw(spark, str(tmp_path))
    s = read_streams(spark, str(tmp_path))
    assert s.products.columns == ["sku", "category", "price_bucket", "name_embedding"]
    assert s.events.filter("event_ts is null").count() == 1
    built = sinks.build_layers(s, P, str(tmp_path / "out"))
    counts = {r.table_name: r.n_rows for r in sinks.row_counts(built).collect()}
    assert counts["stg_product_buy"] == 3 and counts["mart_customer_360"] == 4
    # the tables built on the written rollup equal those built from the log
    for name, fresh in (
        ("mart_customer_360", marts.customer_360(s, P)),
        ("mart_customer_segment", marts.customer_segment(s, P)),
        ("mart_customer_weekly", marts.customer_weekly(marts.customer_daily(s))),
    ):
        assert sorted(map(str, built[name].select(*fresh.columns).collect())) == sorted(map(str, fresh.collect()))
    assert counts["mart_churn_target"] == counts["mart_customer_snapshot"] == built["mart_customer_snapshot"].count() > 0


def test_csv_and_catalogue(spark, tmp_path):
    write_raw(spark, str(tmp_path))
    s = read_streams(spark, str(tmp_path))
    rows = reports.distribution(marts.customer_segment(s, P), "segment")
    sinks.export_csv(rows, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.columns == ["segment", "n", "pct"] and back.count() == rows.count()
    s.buy.createOrReplaceTempView("zz_buy")
    got = sinks.catalogue(spark, ("zz_",)).collect()
    assert [(r.table_name, r.n_rows) for r in got] == [("zz_buy", 3)]
    assert sinks.catalogue(spark, ("none_",)).count() == 0


def test_banned_claims_take_the_first_of_the_list(spark):
    df = spark.createDataFrame([(1, "실제 매출이 증가"), (2, "all quiet"), (3, None)], "id int, text string")
    got = {r.id: r.banned_phrase for r in reports.banned_claims(df, ["id"], "text").collect()}
    assert got == {1: "매출이 증가", 2: None, 3: None}


def test_fact_problems(spark):
    nan = float("nan")
    df = spark.createDataFrame(
        [("a", "recall", 1.2), ("a", "lift", 1.2), ("a", "buyers", -1.0), ("b", "x", nan), ("b", "y", None)],
        "kind string, metric string, value double",
    )
    got = {r.metric: r.problem for r in reports.fact_problems(df).collect()}
    assert got == {"recall": "rate_above_one", "buyers": "negative", "x": "missing", "y": "missing"}
    assert {r.kind: r.n_rejected for r in reports.fact_check(df).collect()} == {"a": 2, "b": 2}
