"""New sample files analysed as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varve.params import Params
from varve.plans.study import Study

SCHEMA = "site string, sample_no int, cm_top double, cm_bot double, age_top double, age_bot double, vol double, cnt double"


def watch(spark: SparkSession, samples_dir: str, out_dir: str, checkpoint: str, p: Params = Params()):
    """Starts a query that, for each batch of arriving Parquet sample files, analyses the
    series whose samples are in it and writes their results under batch=<id>. A batch that
    is run again overwrites its own output, so results stay whole after a failure."""
    arriving = spark.readStream.schema(SCHEMA).parquet(samples_dir)

    def analyse(batch: DataFrame, batch_id: int) -> None:
        sites = batch.select("site").distinct()
        held = spark.read.schema(SCHEMA).parquet(samples_dir).join(sites, "site", "left_semi").dropDuplicates(["site", "sample_no"])
        Study(held, p).results.write.mode("overwrite").parquet(f"{out_dir}/batch={batch_id}")

    return arriving.writeStream.foreachBatch(analyse).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, out_dir: str) -> DataFrame:
    """The newest results of each site."""
    x = spark.read.parquet(out_dir)
    newest = x.groupBy("site").agg(F.max("batch").alias("batch"))
    return x.join(newest, ["site", "batch"], "left_semi").drop("batch")
