from test_series import P, series

from pyspark.sql import functions as F

from varve.streaming import arrivals


def test_arriving_samples_are_analysed_once_a_batch(spark, tmp_path):
    samples, out = str(tmp_path / "samples"), str(tmp_path / "out")
    series(spark, 30).write.parquet(samples)
    for extra in (None, 41):
        if extra:
            series(spark, extra).where(F.col("sample_no") > 30).write.mode("append").parquet(samples)
        arrivals.watch(spark, samples, out, str(tmp_path / "state"), P).awaitTermination()
    got = arrivals.latest(spark, out)
    assert spark.read.parquet(out).select("batch").distinct().count() == 2
    assert got.agg(F.max("age_top_i")).first()[0] == 400.0 - 0.0
