"""Residuals or ratios, noise models and thresholds, for the whole series or by window."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varve.functions import stats
from varve.operators import mixture
from varve.operators.smooth import KEY, lowess, rows_of, span_points, widest_of, within
from varve.params import Params
from varve.stages import stage

N_BINS = 250


def peak_series(smoothed: DataFrame, p: Params) -> DataFrame:
    """Adds peak: acc less bkg, or acc by bkg (null where bkg is 0)."""
    return smoothed.withColumn("peak", F.col("acc") - F.col("bkg") if p.c_peak == 1 else F.try_divide("acc", "bkg"))


def bins(peaks: DataFrame) -> DataFrame:
    """site, run_id, bin (0..250), possible: evenly spaced from the least peak to the greatest."""
    x = peaks.groupBy(*KEY).agg(F.min("peak").alias("lo"), F.max("peak").alias("hi"))
    x = x.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(N_BINS))))
    return x.select(*KEY, "bin", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("bin") / N_BINS).alias("possible"))


def snap(value: Column, lo: Column, hi: Column) -> Column:
    """The bin value nearest to value, the upper of two; the end bins beyond them."""
    step = (hi - lo) / N_BINS
    at = F.coalesce(F.try_divide(value - lo, step), F.lit(0.0))
    at = F.round(at, 9)
    up = F.greatest(F.lit(0), F.least(F.lit(N_BINS), F.ceil(at)))
    down = F.greatest(F.lit(0), F.least(F.lit(N_BINS), F.floor(at)))
    return lo + step * F.when(F.abs(up - at) <= F.abs(down - at), up).otherwise(down)


def half_gaussian(peaks: DataFrame, p: Params) -> DataFrame:
    """site, run_id, mu, sigma of the values at or below neutral mirrored about it (those
    at neutral twice): their mean is neutral, so the spread has a closed form."""
    d = F.when(F.col("peak") <= p.neutral, F.col("peak") - p.neutral)
    x = peaks.groupBy(*KEY).agg(F.sum(d * d).alias("ss"), F.count(d).alias("m"))
    return x.select(*KEY, F.lit(p.neutral).alias("mu"), F.sqrt(F.try_divide(2 * F.col("ss"), (2 * F.col("m") - 1).cast("double"))).alias("sigma"))


def noise_of(x: np.ndarray, neutral: float, merge: bool = False) -> tuple[float, float, float, bool]:
    """Mean, spread and share of the lower component of a mixture; with equal means of the
    lowest of three (merge: of three merged to two); of the half-Gaussian where no mixture
    can be fitted."""
    fit = stats.mixture_em(x, 2) if x.sum() != 0 else None
    if fit is None:
        d = x[x <= neutral] - neutral
        if len(d):
            return neutral, float(np.sqrt(2 * (d**2).sum() / (2 * len(d) - 1))), 1.0, False
        return neutral, float(x.std(ddof=1)) if len(x) > 1 else float("nan"), 1.0, False
    if fit["mu"][0] == fit["mu"][1]:
        fit = (stats.mixture_mdl(x, 3, 2) if merge else stats.mixture_em(x, 3)) or fit
    return float(fit["mu"][0]), float(fit["sigma"][0]), float(fit["prop"][0]), True


def mixture_noise(peaks: DataFrame, p: Params) -> DataFrame:
    """site, run_id, mu, sigma, prop, fitted: noise_of() of whole series, by aggregates over all
    tasks. Asking for it runs the rounds of the fit."""
    d = F.when(F.col("peak") <= p.neutral, F.col("peak") - p.neutral)
    x = stage(peaks.select(*KEY, "i", "peak"), "peak_values")
    plain = x.groupBy(*KEY).agg(F.sum(d * d).alias("ss"), F.count(d).alias("m"), F.stddev_samp("peak").alias("sd"), F.sum("peak").alias("sum"))
    half = F.when(F.col("m") > 0, F.sqrt(2 * F.col("ss") / (2 * F.col("m") - 1))).otherwise(F.col("sd"))
    fit = mixture.lower(mixture.values(x), p.merge).withColumnRenamed("prop", "share")
    y = plain.join(fit.withColumnRenamed("mu", "m_fit").withColumnRenamed("sigma", "s_fit"), list(KEY), "left")
    ok = F.col("m_fit").isNotNull() & (F.col("sum") != 0)
    return y.select(*KEY, F.when(ok, F.col("m_fit")).otherwise(p.neutral).alias("mu"), F.when(ok, F.col("s_fit")).otherwise(half).alias("sigma"), F.when(ok, F.col("share")).otherwise(1.0).alias("prop"), ok.alias("fitted"))


def global_noise(peaks: DataFrame, p: Params) -> DataFrame:
    return half_gaussian(peaks, p) if p.thresh_method != 3 else mixture_noise(peaks, p).select(*KEY, "mu", "sigma")


def noise_pdf(peaks: DataFrame, p: Params) -> DataFrame:
    """site, run_id, bin, possible, density of the noise model at the bins."""
    x = bins(peaks).join(global_noise(peaks, p), list(KEY))
    z = (F.col("possible") - F.col("mu")) / F.col("sigma")
    return x.select(*KEY, "bin", "possible", (F.exp(-0.5 * z * z) / (F.col("sigma") * float(np.sqrt(2 * np.pi)))).alias("density"))


def global_thresholds(peaks: DataFrame, p: Params) -> DataFrame:
    """site, run_id, mu, sigma, pos (4 values snapped to bins), neg."""
    par = [F.first("par").alias("par")] if "par" in peaks.columns else []
    ends = peaks.groupBy(*KEY).agg(F.min("peak").alias("lo"), F.max("peak").alias("hi"), *par)
    lo, hi = F.col("lo"), F.col("hi")
    if p.thresh_method == 1:
        pos = [snap(p.value(j), lo, hi) for j in range(4)]
        return ends.select(*KEY, F.lit(None).cast("double").alias("mu"), F.lit(None).cast("double").alias("sigma"), F.array(*pos).alias("pos"), F.lit(-99.0).alias("neg"))
    x = ends.join(global_noise(peaks, p), list(KEY))
    pos = [snap(F.col("mu") + p.z(j) * F.col("sigma"), lo, hi) for j in range(4)]
    return x.select(*KEY, "mu", "sigma", F.array(*pos).alias("pos"), (F.col("mu") + p.z_low(2) * F.col("sigma")).alias("neg"))


def global_sni(peaks: DataFrame, thresholds: DataFrame) -> DataFrame:
    """site, run_id, sni: how far signals lie above noise, in its spreads; 0 without both."""
    t = F.col("pos")[3]
    x = peaks.join(thresholds.select(*KEY, "pos"), list(KEY))
    signal, noise = F.when(F.col("peak") > t, F.col("peak")), F.when(F.col("peak") <= t, F.col("peak"))
    x = x.groupBy(*KEY).agg(F.avg(signal).alias("s"), F.count(signal).alias("ns"), F.avg(noise).alias("m"), F.stddev_samp(noise).alias("d"), F.count(noise).alias("nn"))
    sni = F.try_divide(F.col("s") - F.col("m"), F.col("d")) * (F.col("nn") - 2) / F.col("nn")
    return x.select(*KEY, F.when((F.col("ns") > 0) & (F.col("nn") > 2), sni).otherwise(0.0).alias("sni"))


def half_window(p: Params) -> int | Column:
    return rows_of(0.5 * (p.smooth_yr if p.fixed else p.smooth), p)


def _frame(hw: int | Column):
    return within(KEY, hw)


def local_noise(peaks: DataFrame, p: Params, hw: int | None = None) -> DataFrame:
    """Adds x (peak, neutral where null), win_n, mu and sigma of the half-Gaussian in the
    window of hw rows to either side, cut off at the ends; a window with no value at or
    below neutral takes its plain spread."""
    hw = half_window(p) if hw is None else hw
    x = peaks.withColumn("x", F.coalesce("peak", F.lit(p.neutral)))
    d = F.when(F.col("x") <= p.neutral, F.col("x") - p.neutral)
    x = x.withColumns({"__ss": F.sum(d * d).over(_frame(hw)), "__m": F.count(d).over(_frame(hw)), "win_n": F.count("x").over(_frame(hw)), "__sd": F.stddev_samp("x").over(_frame(hw))})
    sigma = F.when(F.col("__m") > 0, F.sqrt(F.try_divide(2 * F.col("__ss"), (2 * F.col("__m") - 1).cast("double")))).otherwise(F.col("__sd"))
    return x.withColumns({"mu": F.lit(p.neutral), "sigma": sigma}).drop("__ss", "__m", "__sd")


def local_mixture(peaks: DataFrame, p: Params, hw: int | None = None) -> DataFrame:
    """local_noise() with the lower component of a mixture fitted to each window; windows
    with under four values off neutral keep the half-Gaussian. Windows are independent
    rows for the fit, so a single long series still spreads over all tasks."""
    hw = half_window(p) if hw is None else hw
    x = local_noise(peaks, p, hw).withColumn("__win", F.collect_list("x").over(_frame(hw)))

    @F.pandas_udf("struct<mu:double,sigma:double,prop:double,fitted:boolean>")
    def fit(windows: pd.Series) -> pd.DataFrame:
        rows = []
        for w in windows:
            w = np.asarray(w, float)
            rows.append(noise_of(w, p.neutral, p.merge) if (w != p.neutral).sum() >= 4 else (np.nan, np.nan, np.nan, False))
        return pd.DataFrame(rows, columns=["mu", "sigma", "prop", "fitted"])

    x = x.withColumn("__fit", fit("__win"))
    use = F.col("__fit.fitted")
    return x.withColumns({"mu": F.when(use, F.col("__fit.mu")).otherwise(F.col("mu")), "sigma": F.when(use, F.col("__fit.sigma")).otherwise(F.col("sigma")), "prop": F.when(use, F.col("__fit.prop")), "fitted": use}).drop("__fit", "__win")


def with_thresholds(noise: DataFrame, p: Params) -> DataFrame:
    """Adds pos1..pos4 and neg1..neg4 from mu and sigma."""
    at = lambda z: F.col("mu") + z * F.col("sigma")
    return noise.withColumns({f"pos{j + 1}": at(p.z(j)) for j in range(4)} | {f"neg{j + 1}": at(p.z_low(j)) for j in range(4)})


def local_sni(df: DataFrame, p: Params, hw: int | None = None) -> DataFrame:
    """Adds sni of each window at its own final threshold: the threshold differs from row
    to row, so the window's values are folded as an array."""
    hw = half_window(p) if hw is None else hw
    df = df.withColumn("__win", F.collect_list("x").over(_frame(hw)))
    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("s", "ns", "m", "nn")])
    t = F.col("pos4")

    def add(a, v):
        up = v > t
        return F.struct((a["s"] + F.when(up, v).otherwise(0.0)).alias("s"), (a["ns"] + F.when(up, 1.0).otherwise(0.0)).alias("ns"), (a["m"] + F.when(up, 0.0).otherwise(v)).alias("m"), (a["nn"] + F.when(up, 0.0).otherwise(1.0)).alias("nn"))

    df = df.withColumn("__f", F.aggregate("__win", zero, add))
    mean = F.try_divide(F.col("__f.m"), F.col("__f.nn"))
    df = df.withColumn("__mean", mean)
    ss = F.aggregate("__win", F.lit(0.0), lambda a, v: a + F.when(v > t, 0.0).otherwise((v - F.col("__mean")) * (v - F.col("__mean"))))
    df = df.withColumn("__d", F.sqrt(F.try_divide(ss, F.col("__f.nn") - 1)))
    sni = F.try_divide(F.try_divide(F.col("__f.s"), F.col("__f.ns")) - F.col("__mean"), F.col("__d")) * F.try_divide(F.col("__f.nn") - 2, F.col("__f.nn"))
    sni = F.when((F.col("__f.ns") > 0) & (F.col("__f.nn") > 2), sni).otherwise(0.0)
    return df.withColumn("sni", sni).drop("__win", "__f", "__mean", "__d")


def local_gof(df: DataFrame, p: Params, hw: int | None = None) -> DataFrame:
    """Adds gof: p-value of the window's noise against its normal model (over 3 values);
    null in a window with under four values off neutral, which is not tested."""
    hw = half_window(p) if hw is None else hw
    win = F.collect_list("x").over(_frame(hw))
    off = F.size(F.filter(win, lambda v: v != p.neutral))
    noise = F.when(off >= 4, F.filter(win, lambda v: v <= F.col("pos4")))

    @F.pandas_udf("double")
    def fit(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for values, mu, sigma in batches:
            yield pd.Series([stats.ks_one_sample(v, lambda q, m=m, s=s: stats.normal_cdf(q, m, s))[1] if v is not None and len(v) > 3 and s > 0 else None for v, m, s in zip(values, mu, sigma, strict=True)], dtype="float64")

    return df.withColumn("__noise", noise).withColumn("gof", fit("__noise", "mu", "sigma")).drop("__noise")


def smooth_thresholds(df: DataFrame, p: Params) -> DataFrame:
    """sni and the eight thresholds run through the local line; sni at least 0. The thresholds
    of a row are null together and share a pass; sni is null by itself and has its own."""
    cols = [f"{a}{j}" for a in ("pos", "neg") for j in (1, 2, 3, 4)]
    k = span_points(p.smooth / F.col("yr"), F.col("n"))
    widest = widest_of(p, p.smooth_yr) if p.fixed else None
    df = lowess(lowess(df, cols, cols, k, widest), "sni", "sni", k, widest)
    return df.withColumn("sni", F.when(F.col("sni") < 0, 0.0).otherwise(F.col("sni")))


def thresholds(peaks: DataFrame, p: Params, gof: bool = True) -> DataFrame:
    """Adds pos1..4, neg1..4, sni, gof by the run's own type and method."""
    if p.thresh_type == 1:
        if p.thresh_method == 3:
            # The rounds of a mixture run anyway: the thresholds, the index and the rows read what is written for them.
            peaks = stage(peaks, "peaked")
        t = global_thresholds(peaks, p)
        t = t.join(global_sni(peaks, t), list(KEY)).select(*KEY, *[F.col("pos")[j - 1].alias(f"pos{j}") for j in (1, 2, 3, 4)], *[F.col("neg").alias(f"neg{j}") for j in (1, 2, 3, 4)], "sni", F.lit(-999.0).alias("gof"))
        return peaks.join(t, list(KEY))
    x = local_mixture(peaks, p) if p.thresh_method == 3 else local_noise(peaks, p)
    x = local_sni(with_thresholds(x, p), p)
    x = local_gof(x, p) if gof else x.withColumn("gof", F.lit(None).cast("double"))
    return smooth_thresholds(x, p)
