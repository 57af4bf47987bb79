import os
import sys
from datetime import datetime

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemark.sources.streams import Streams  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tidemark-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "2")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def ts(text):
    return datetime.fromisoformat(text) if isinstance(text, str) else text


SKU = "client_id bigint, event_ts timestamp_ntz, sku bigint"


def streams_of(spark, buy=(), add=(), remove=(), visit=(), search=(), products=()):
    """Streams from rows ``(client, time, item)``."""

    def frame(rows, schema):
        return spark.createDataFrame([(c, ts(t), x) for c, t, x in rows], schema)

    return Streams(
        buy=frame(buy, SKU),
        add=frame(add, SKU),
        remove=frame(remove, SKU),
        visit=frame(visit, SKU.replace("sku", "url")),
        search=frame(search, SKU.replace("sku bigint", "query string")),
        products=spark.createDataFrame(
            list(products), "sku bigint, category bigint, price_bucket bigint, name_embedding string"
        ),
    )
