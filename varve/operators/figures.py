"""The data behind each figure, as DataFrames."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from varve.functions import stats
from varve.operators import history, resample, threshold
from varve.operators.smooth import KEY
from varve.params import Params


def raw_bars(rated: DataFrame) -> DataFrame:
    """Figure 1, bars: site, age_top, age_bot, acc, and the 99 % cap of the axis."""
    cap = F.percentile("acc", F.lit(0.99)).over(Window.partitionBy("site"))
    return rated.select("site", "age_top", "age_bot", "acc", cap.alias("y_cap"))


def smoother_curves(curves: DataFrame) -> DataFrame:
    """Figure 1, lines: site, age (moved by half a cell), series, value of the five smoothers."""
    pairs = F.array(*[F.struct(F.lit(m).alias("method"), F.col(f"bkg{m}").alias("value")) for m in range(1, 6)])
    return curves.select(*KEY, (F.col("age") - 0.5 * F.col("yr")).alias("age"), F.explode(pairs).alias("r")).select(*KEY, "age", "r.*")


def noise_histogram(peaks: DataFrame, bins: DataFrame) -> DataFrame:
    """Figure 2, global: rows in each of the 250 intervals between bins."""
    ends = bins.groupBy(*KEY).agg(F.min("possible").alias("lo"), F.max("possible").alias("hi"))
    x = peaks.where("peak is not null").join(ends, list(KEY))
    at = F.least(F.lit(249), F.floor(F.round((F.col("peak") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / 250), 9)).cast("int"))
    return x.withColumn("bin", at).groupBy(*KEY, "bin").agg(F.count("*").alias("n_rows"))


def diagnostics(thresholded: DataFrame, p: Params, most: int = 25) -> DataFrame:
    """Figure 2, local: at most 25 evenly spaced windows with their model."""
    hw = threshold.half_window(p)
    step = F.greatest(F.lit(1), F.bround(F.col("n") / most).cast("int"))
    x = thresholded.where((F.col("i") >= 2 * hw) & ((F.col("i") - 2 * hw) % step == 0))
    x = x.withColumn("no", F.row_number().over(Window.partitionBy(*KEY).orderBy("i"))).where(F.col("no") <= most)
    return x.select(*KEY, "no", "i", "age", "mu", "sigma", "pos4", "sni")


def peak_panel(thresholded: DataFrame, peaks: DataFrame) -> DataFrame:
    """Figure 3: series, thresholds, accepted and rejected peaks."""
    one = history.final(peaks).select(*KEY, "i", "is_peak", "insig")
    return thresholded.join(one, [*KEY, "i"]).select(*KEY, "i", "age", "acc", "bkg", "peak", "pos4", "neg4", "is_peak", "insig")


def zone_threshold_means(peaks: DataFrame, zone_table: DataFrame) -> DataFrame:
    """Figure 4, local: mean return interval by zone and threshold."""
    w = Window.partitionBy(*KEY, "t", "zone").orderBy("age")
    x = peaks.where("is_peak").join(zone_table, "site").where("age >= z_lo and age < z_hi").withColumn("fri", F.col("age") - F.lag("age").over(w))
    return x.groupBy(*KEY, "t", "zone").agg(F.count("fri").alias("n_fri"), F.avg("fri").alias("mfri"))


def zone_threshold_limits(peaks: DataFrame, zone_table: DataFrame, times: int = 1000) -> DataFrame:
    """Figure 4, local: mean return interval by zone and threshold with bootstrap limits, of
    the zones and thresholds with two intervals or more."""
    key = [*KEY, "t", "zone"]
    x = peaks.where("is_peak").join(zone_table, [c for c in KEY if c in zone_table.columns]).where("age >= z_lo and age < z_hi")
    x = x.withColumn("fri", F.col("age") - F.lag("age").over(Window.partitionBy(*key).orderBy("age"))).where("fri is not null")
    groups = resample.gathered(x.select(*key, "fri"), key, "fri").where("n > 1")
    draws = resample.resamples(groups, key, times).withColumn("m", resample.mean_of("picks"))
    return groups.join(resample.limits(draws, key, ["m"]), key).select(*key, F.col("n").alias("n_fri"), F.col("mean").alias("mfri"), F.col("m_lo").alias("lo"), F.col("m_hi").alias("hi"))


def sni_box(thresholded: DataFrame) -> DataFrame:
    """Figure 4: five-number summary of the signal-to-noise index, whiskers at 1.5 IQR."""
    q = thresholded.groupBy(*KEY).agg(*[F.percentile("sni", F.lit(v)).alias(c) for c, v in (("q1", 0.25), ("mid", 0.5), ("q3", 0.75))])
    x = thresholded.join(q, list(KEY))
    inside = (F.col("sni") >= F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))) & (F.col("sni") <= F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    return x.groupBy(*KEY).agg(F.min(F.when(inside, F.col("sni"))).alias("low"), *[F.first(c).alias(c) for c in ("q1", "mid", "q3")], F.max(F.when(inside, F.col("sni"))).alias("high"))


def cumulative(peaks: DataFrame) -> DataFrame:
    """Figure 5: rank of each peak from the oldest."""
    w = Window.partitionBy(*KEY).orderBy(F.desc("age"))
    return history.final(peaks).where("is_peak").select(*KEY, "age", F.row_number().over(w).alias("n_peaks"))


def weibull_curve(zone_stats: DataFrame) -> DataFrame:
    """Figure 6: Weibull density times the bin width at bin centres, and the test's verdict."""
    x = zone_stats.withColumn("centre", F.explode(F.sequence(F.lit(30), F.lit(990), F.lit(20)))).withColumn("centre", F.col("centre").cast("double"))
    r = F.col("centre") / F.col("wbl_b")
    pdf = F.col("wbl_c") / F.col("wbl_b") * F.pow(r, F.col("wbl_c") - 1) * F.exp(-F.pow(r, F.col("wbl_c"))) * 20
    passes = (F.col("n_fri") > 4) & (F.col("p_ks") > F.when(F.col("n_fri") < 30, 0.10).otherwise(0.05))
    return x.select(*KEY, "zone", "centre", pdf.alias("density"), passes.alias("passes"))


def history_panel(results: DataFrame) -> DataFrame:
    """Figure 7: magnitude, smoothed intervals and frequency."""
    return results.select(*KEY, "i", F.col("age_top_i").alias("age"), "peak_mag", "sm_fri", F.col("sm_peak_freq").alias("sm_freq"))


def zone_ecdf(zoned: DataFrame) -> DataFrame:
    """Figure 8: cumulative share of return intervals by zone."""
    return zoned.select(*KEY, "zone", "age", "fri", F.cume_dist().over(Window.partitionBy(*KEY, "zone").orderBy("fri")).alias("share"))


def zone_box(zoned: DataFrame) -> DataFrame:
    return zoned.groupBy(*KEY, "zone").agg(F.count("*").alias("n_fri"), *[F.percentile("fri", F.lit(v)).alias(c) for c, v in (("least", 0.0), ("q1", 0.25), ("mid", 0.5), ("q3", 0.75), ("most", 1.0))])


def zone_tests(zoned: DataFrame) -> DataFrame:
    """Figure 8: two-sample test between each pair of a series' zones (a handful)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        groups = {z: g["fri"].to_numpy() for z, g in pdf.groupby("zone")}
        order, site, run_id = sorted(groups), pdf["site"].iloc[0], pdf["run_id"].iloc[0]
        rows = [(site, run_id, a, b, *stats.ks_two_sample(groups[a], groups[b])) for k, a in enumerate(order) for b in order[k + 1 :]]
        return pd.DataFrame(rows, columns=["site", "run_id", "zone_a", "zone_b", "d", "p"])

    return zoned.groupBy(*KEY).applyInPandas(run, "site string, run_id string, zone_a int, zone_b int, d double, p double")


def window_tests(moved: DataFrame, p: Params) -> DataFrame:
    """Tests of each step's intervals against the step round(w/100 - 1) before it:
    two-sample, rank-sum, and the two-sample Anderson-Darling statistic. An interval goes to
    both steps that it is tested in, so the intervals are worked out once and meet in one aggregate."""
    back = max(1, round(p.peak_freq_yr / history.STEP - 1))
    none = F.lit(None).cast("double")
    sides = F.array(F.struct("step", F.col("fri").alias("x"), none.alias("y")), F.struct((F.col("step") + back).alias("step"), none.alias("x"), F.col("fri").alias("y")))
    x = moved.select(*KEY, F.explode(sides).alias("s")).select(*KEY, "s.*")
    x = x.groupBy(*KEY, "step").agg(*[F.sort_array(F.collect_list(c)).alias(c) for c in ("x", "y")]).where("size(x) > 1 and size(y) > 1")

    @F.pandas_udf("struct<ks_p:double,rank_p:double,ad:double>")
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        rows = [(stats.ks_two_sample(u, v)[1], stats.rank_sum_p(np.asarray(u), np.asarray(v)), stats.anderson_darling_k([np.asarray(u), np.asarray(v)])) for u, v in zip(x, y, strict=True)]
        return pd.DataFrame(rows, columns=["ks_p", "rank_p", "ad"])

    return x.withColumn("r", run("x", "y")).select(*KEY, "step", "r.*")


def threshold_domains(thresholded: DataFrame, p: Params) -> DataFrame:
    """Figure 9: the final threshold as accumulation, ratio and residual."""
    t, b = F.col("pos4"), F.col("bkg")
    acc = b + t if p.c_peak == 1 else b * t
    return thresholded.select(*KEY, "i", acc.alias("as_acc"), F.try_divide(acc, b).alias("as_ratio"), (acc - b).alias("as_residual"))


def summary(results: DataFrame) -> DataFrame:
    """One row a series: rows, peaks, ages and the zones' interval counts."""
    zone = F.when(F.col("n_fri").isNotNull(), F.struct(F.col("i").alias("zone"), "n_fri", F.round("mfri", 6).alias("mfri")))
    return results.groupBy(*KEY).agg(F.count("*").alias("n_rows"), F.sum("peaks_final").alias("n_peaks"), F.min("age_top_i").alias("youngest"), F.max("age_top_i").alias("oldest"), F.sort_array(F.collect_list(zone)).alias("zones"))
