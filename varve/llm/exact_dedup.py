"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest. A batch is reduced to its distinct
digests (partial aggregation first, so a text that a third of the rows share is one row
per task before the shuffle), anti-joined to the index by a sort-merge join that reads
the index by bucket without a shuffle, and its new digests are appended under the batch's
name. A batch that is run again is judged by the digests of the other batches and appends
nothing, so it gets the same result.

Defined results: a null text counts as empty; texts that differ only in runs of the six
ASCII white-space characters are equal; rows that repeat both doc_id and text are one
more member of their group each, and only the first of them is kept; a null doc_id sorts
after all others; an empty batch gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from varve.llm.common import SPACE, table, written


def digest(text: str):
    return F.sha2(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE, " "), 256)


class DigestIndex:
    """Digests seen so far: digest, keep_id, and the batch that brought each."""

    def __init__(self, spark: SparkSession, name: str, n_buckets: int = 32):
        self.spark, self.name, self.n_buckets = spark, name, n_buckets

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def create(self, id_type) -> None:
        """An empty index, where there is none."""
        if not self.exists():
            schema = StructType([StructField("digest", StringType()), StructField("keep_id", id_type), StructField("batch", StringType())])
            self._write(self.spark.createDataFrame([], schema))

    def _write(self, rows: DataFrame) -> None:
        (
            rows.select("digest", "keep_id", "batch")
            .repartition(self.n_buckets, "digest")
            .write.bucketBy(self.n_buckets, "digest").sortBy("digest")
            .mode("append").format("parquet").saveAsTable(self.name)
        )

    def append(self, rows: DataFrame, batch: str) -> None:
        """rows: digest, keep_id. A batch that has been appended is not appended again."""
        if self.read().where(F.col("batch") == batch).limit(1).count() == 0:
            self._write(rows.withColumn("batch", F.lit(batch)))

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def unseen(batch: DataFrame, known: DataFrame) -> DataFrame:
    """Digests of the batch that the index does not hold: a sort-merge anti-join."""
    return batch.join(known.hint("merge"), "digest", "left_anti")


def deduplicate(docs: DataFrame, index: DigestIndex, batch: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    A digest that the index already holds from another batch keeps the row it was first
    seen with, and no row of this batch is kept for it. group_size counts the rows of this
    batch. The result does not read the index any more.
    """
    name = batch or uuid.uuid4().hex
    rows = written(docs.select(F.col(id_col).alias("doc_id"), digest(text_col).alias("digest")), "digests")
    groups = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("group_size"))
    index.create(rows.schema["doc_id"].dataType)
    known = index.read().where(F.col("batch") != name).select("digest", "keep_id")
    fresh = unseen(groups, known).withColumns({"keep_id": F.col("first_id"), "fresh": F.lit(True)})
    seen = groups.join(known.hint("merge"), "digest").withColumn("fresh", F.lit(False))
    found = written(fresh.unionByName(seen.select(fresh.columns)), "groups")
    index.append(found.where("fresh"), name)
    # Both sides are shuffled by digest, so a hot group is split by the skew-join rule.
    copies = rows.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("copies"))
    out = copies.join(found, "digest").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select(
        "doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"),
        (F.col("fresh") & F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def keep_first(docs: DataFrame, index: DigestIndex, batch: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that deduplicate() keeps, with all their columns."""
    kept = deduplicate(docs, index, batch, id_col, text_col).where("kept").select(F.col("text_sha256").alias("__sha"), F.col("doc_id").alias("__id"))
    rows = docs.withColumn("__digest", digest(text_col))
    # Joined by digest and id: of a hot group only the row that stays meets a partner.
    rows = rows.join(kept, (rows["__digest"] == kept["__sha"]) & rows[id_col].eqNullSafe(kept["__id"]), "left_semi")
    return rows.dropDuplicates(["__digest", id_col]).select(*docs.columns)


def own_index(spark: SparkSession) -> DigestIndex:
    """An index for one run, empty; its owner drops it."""
    return DigestIndex(spark, f"varve_digests_{uuid.uuid4().hex}")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = own_index(spark)
    try:
        return deduplicate(table(spark, sf_dir, "documents"), index)
    finally:
        index.drop()


SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) = 1 AS kept, text_sha256
FROM d
"""
