"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but space, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, a local one serves a
    session whose driver is its only executor; any other session is told to set one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"/tmp/checkpoints/varve-{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back.

    This cuts the lineage: a lost executor costs a reread of the files, not a rerun of
    what made them. Files live until clear() or the end of the session.
    """
    spark = df.sparkSession
    return written_at(df, f"{shared_dir(spark)}/varve/{tag}-{uuid.uuid4().hex}")


def written_at(df: DataFrame, path: str, keep: bool = False) -> DataFrame:
    """written() at a given path; keep: its owner deletes it."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(path)
    if not keep:
        _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Texts are long: the default of 10,000 rows a batch is tens of megabytes, held
    several times over. A session that sets a number of its own keeps it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def delete(path: str, spark: SparkSession) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def finished(spark: SparkSession, path: str) -> bool:
    """A write to path has ended well."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def marked() -> int:
    """A place in the list of what written() has left, for clear()."""
    return len(_written)


def clear(spark: SparkSession, since: int = 0, but: str = "") -> None:
    """Deletes what written() has left in the shared folder (since a place), but for one path."""
    for owner, path in [x for x in _written[since:] if x[0] is spark and x[1] != but]:
        delete(path, owner)
        _written.remove((owner, path))


@atexit.register
def _at_exit() -> None:
    for spark, path in _written:
        try:
            delete(path, spark)
        except Exception:  # noqa: BLE001  the session may be gone already
            return


def crc_mod(column: str, n: int):
    """crc32 of the id as decimal text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(n)
