"""Exact duplicates by a persistent digest index.

The index is a table of text digests, bucketed and sorted by digest, in a folder that
outlives the session. A batch is reduced to one row per digest, sorted into the same
buckets, and merged with the index by an anti-join that shuffles only the batch; what is
not there yet is appended. A text that the index knows is a duplicate of the row indexed.
Of a new text, the row with the largest key stays; of rows equal in key, the one with the
largest hash over all columns, and of rows equal in everything, one. Null keys come last:
a group of rows without keys keeps one of them and has a null ``keep_id``.

Texts are equal when identical after lower-casing A-Z; null counts as empty.

A digest that makes up ``1 / HOT_SHARE`` of a batch or more is split off: there are at
most ``HOT_SHARE`` of these, so that list is broadcast and their rows are not shuffled by
digest. Everything else is joined by sort-merge.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.materialize import materialize, new_folder

from .text import lower_ascii

HOT_SHARE = 256


def digest_of(text: Column) -> Column:
    """SHA-256 of the normalised text, as lowercase hex."""
    return F.sha2(F.encode(lower_ascii(F.coalesce(text, F.lit(""))), "UTF-8"), 256)


def row_hash(df: DataFrame) -> Column:
    return F.xxhash64(*(F.col(f"`{c}`") for c in df.columns))


class DigestIndex:
    """A bucketed, sorted table of digests at a path; created if nothing is there."""

    def __init__(self, spark: SparkSession, path: str, key_type: str = "bigint", buckets: int | None = None):
        self.spark, self.path = spark, path
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.columns = (
            f"digest string, keep_id {key_type}, keep_hash bigint, keep_row bigint, keep_rows bigint,"
            " group_size bigint, batch string"
        )

    def add(self, rows: DataFrame) -> str:
        """Append the digests of ``rows`` (id, digest, row_hash, row_id) that are not there yet.

        Returns the name of the batch, which its entries carry.
        """
        batch, name = uuid.uuid4().hex, f"digest_index_{uuid.uuid4().hex}"
        # equal rows are counted first, so that a group of copies is small before it is gathered
        same = rows.groupBy("digest", F.col("id").alias("keep_id"), F.col("row_hash").alias("keep_hash")).agg(
            F.min("row_id").alias("keep_row"), F.count(F.lit(1)).alias("keep_rows")
        )
        one = F.max(F.struct("keep_id", "keep_hash", "keep_row", "keep_rows")).alias("one")
        groups = same.groupBy("digest").agg(one, F.sum("keep_rows").alias("group_size"))
        entries = groups.select("digest", "one.*", "group_size", F.lit(batch).alias("batch"))
        self.spark.sql(
            f"CREATE TABLE {name} ({self.columns}) USING parquet"
            f" CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )
        try:
            fresh = entries.join(self.spark.table(name).select("digest"), "digest", "left_anti")
            fresh.repartition(self.buckets, "digest").write.insertInto(name)
        finally:
            self.spark.sql(f"DROP TABLE {name}")  # the name only: the files stay
        return batch

    def entries(self) -> DataFrame:
        return self.spark.read.schema(self.columns).parquet(self.path)


def _joined(rows: DataFrame, entries: DataFrame, hot: list[str]) -> DataFrame:
    """Rows with the entry of their digest; hot digests without a shuffle of their rows."""
    if not hot:
        return rows.join(entries, "digest")
    is_hot = F.col("digest").isin(hot)
    few = rows.filter(is_hot).join(F.broadcast(entries.filter(is_hot)), "digest")
    return few.unionByName(rows.filter(~is_hot).join(entries.filter(~is_hot), "digest"))


def _hot(rows: DataFrame) -> list[str]:
    """The digests with a fixed share of the rows; at most ``HOT_SHARE`` by arithmetic."""
    total = rows.count()
    many = rows.groupBy("digest").count().filter(F.col("count") * HOT_SHARE >= total)
    return [r.digest for r in many.select("digest").collect()] if total > HOT_SHARE else []


def _index(docs: DataFrame, text: str, key: str, path: str | None) -> tuple[DataFrame, DigestIndex, str]:
    """Narrow rows (id, digest, row_hash, row_id) written once, their index and batch."""
    rows = materialize(
        docs.select(
            F.col(f"`{key}`").alias("id"),
            digest_of(F.col(f"`{text}`")).alias("digest"),
            row_hash(docs).alias("row_hash"),
            F.monotonically_increasing_id().alias("row_id"),
        )
    )
    spark = docs.sparkSession
    index = DigestIndex(spark, path or new_folder(spark, "digests"), docs.schema[key].dataType.simpleString())
    return rows, index, index.add(rows)


def verdicts(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None) -> DataFrame:
    """Per row of ``docs``: key, digest, keep_id, group_size, kept.

    ``path`` names a lasting index; without one the rows are an index of their own.
    """
    rows, index, batch = _index(docs, text, key, path)
    kept = (F.col("batch") == batch) & (F.col("row_id") == F.col("keep_row"))
    return _joined(rows, index.entries(), _hot(rows)).select(
        F.col("id").alias(key), "digest", "keep_id", "group_size", kept.alias("kept")
    )


def deduplicated(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, one per new text, with the columns of ``docs``."""
    rows, index, batch = _index(docs, text, key, path)
    entries = index.entries().filter(F.col("batch") == batch)
    packed = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"),
        F.col(f"`{key}`").alias("id"),
        digest_of(F.col(f"`{text}`")).alias("digest"),
        row_hash(docs).alias("row_hash"),
    )
    same = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("row_hash") == F.col("keep_hash"))
    kept = _joined(packed, entries, _hot(rows)).filter(same)
    if not entries.filter(F.col("keep_rows") > 1).isEmpty():
        kept = kept.dropDuplicates(["digest"])  # rows equal in everything
    return kept.select("doc.*")
