"""Regression comparison of two result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compare(a: DataFrame, b: DataFrame, peak_tol: float = 0, thresh_tol: float = 0.001, mag_tol: float = 0.01, freq_tol: float = 0.01) -> DataFrame:
    """site, check, a_value, b_value, ok: peak counts and mean thresholds by column, total
    magnitude (relative), mean frequency difference, and nulls in the series itself. Rows
    are matched by site and i, as far as the shorter table goes."""
    peaks, cuts = ["peaks1", "peaks2", "peaks3", "peaks_final"], ["thresh1", "thresh2", "thresh3", "thresh_pos"]
    cols = [*peaks, *cuts, "peak_mag", "sm_peak_freq", "peak"]
    x = a.select("site", "i", *[F.col(c).alias(f"{c}_a") for c in cols]).join(b.select("site", "i", *[F.col(c).alias(f"{c}_b") for c in cols]), ["site", "i"])
    sums = [F.sum(f"{c}_{s}").cast("double").alias(f"{c}_{s}") for c in [*peaks, "peak_mag"] for s in "ab"] + [F.avg(f"{c}_{s}").alias(f"{c}_{s}") for c in cuts for s in "ab"]
    x = x.groupBy("site").agg(*sums, F.avg(F.abs(F.col("sm_peak_freq_a") - F.col("sm_peak_freq_b"))).alias("freq_a"), F.count_if(F.col("peak_a").isNull() != F.col("peak_b").isNull()).cast("double").alias("null_a"))
    gap = lambda c: F.abs(F.col(f"{c}_a") - F.col(f"{c}_b"))
    row = lambda name, u, v, ok: F.struct(F.lit(name).alias("check"), u.alias("a_value"), v.alias("b_value"), F.coalesce(ok, F.lit(False)).alias("ok"))
    zero = F.lit(0.0)
    rows = [row(c, F.col(f"{c}_a"), F.col(f"{c}_b"), gap(c) <= peak_tol) for c in peaks] + [row(c, F.col(f"{c}_a"), F.col(f"{c}_b"), gap(c) <= thresh_tol) for c in cuts]
    rows.append(row("peak_mag", F.col("peak_mag_a"), F.col("peak_mag_b"), gap("peak_mag") <= mag_tol * F.abs("peak_mag_a")))
    rows += [row("sm_peak_freq", F.col("freq_a"), zero, F.col("freq_a") <= freq_tol), row("nulls", F.col("null_a"), zero, F.col("null_a") == 0)]
    return x.select("site", F.explode(F.array(*rows)).alias("r")).select("site", "r.*")
