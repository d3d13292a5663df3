"""Results written between stages, so that what several branches read is made once."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_held: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; where it is unset,
    a local one for a session that is its own only executor, and an error for any other."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"/tmp/checkpoints/varve-{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet, read back: its plan ends here, and a lost executor costs a reread. The
    files go when the interpreter ends, or by drop_stages()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/varve/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _held.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop_stages(spark: SparkSession) -> None:
    for held in [h for h in _held if h[0] is spark]:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(held[1])
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        _held.remove(held)


@atexit.register
def _at_exit() -> None:
    for spark in {id(s): s for s, _ in _held}.values():
        try:
            drop_stages(spark)
        except Exception:  # noqa: BLE001  the session may be gone already
            continue
