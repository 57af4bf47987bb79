"""Written tables leave nothing behind but themselves, and go when they are discarded."""

import os

from pyspark.sql import functions as F

from tidemark.plans.materialize import CLEAN_UP, discard, materialize


def test_no_shuffle_files_stay_and_tables_can_be_discarded(spark):
    def files():
        return spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()

    before, setting = files(), spark.conf.get(CLEAN_UP)
    table = materialize(spark.range(5000).repartition(7, "id").groupBy((F.col("id") % 100).alias("k")).count())
    assert files() <= before and spark.conf.get(CLEAN_UP) == setting
    assert table.count() == 100
    folder = os.path.dirname("/" + table.inputFiles()[0].removeprefix("file:").lstrip("/"))
    assert os.path.isdir(folder)
    discard(table)
    discard(table)
    assert not os.path.exists(folder)
