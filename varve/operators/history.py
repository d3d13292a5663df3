"""Event history: magnitudes, frequencies, return intervals and zone statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from varve.operators import resample
from varve.operators.peaks import KEY_T, intervals
from varve.operators.smooth import KEY, lowess, span_points, widest_of
from varve.params import ByRun, Params

FINAL = 4
STEP0, STEP = -70, 100
MAX_FRI = 5000.0

def _by_i():
    return Window.partitionBy(*KEY).orderBy("i")



def final(peaks: DataFrame) -> DataFrame:
    return peaks.where(F.col("t") == FINAL)


def magnitude(thresholds: DataFrame) -> DataFrame:
    """site, run_id, i, peak_mag: at the last row of each run above the final threshold,
    the run's summed excess times (rows spanned + years a row); the last row never is one."""
    over = F.coalesce(F.greatest(F.lit(0.0), F.round(F.col("peak"), 9) - F.round(F.col("pos4"), 9)), F.lit(0.0))
    x = thresholds.select(*KEY, "i", "yr", F.when(F.col("i") == F.col("n"), 0.0).otherwise(over).alias("over"))
    # Runs are numbered by a window and dropped after the aggregate: a filter on "over"
    # itself would be pushed below and write the local regression out many times.
    x = x.withColumn("starts", (F.col("over") > 0) & (F.coalesce(F.lag("over").over(_by_i()), F.lit(0.0)) <= 0))
    x = x.withColumn("island", F.sum(F.col("starts").cast("int")).over(_by_i()))
    spot = F.when(F.col("over") > 0, F.col("i"))
    runs = x.groupBy(*KEY, "island").agg(F.sum("over").alias("s"), F.min(spot).alias("p1"), F.max(spot).alias("p2"), F.first("yr").alias("yr")).where("p2 is not null")
    return runs.select(*KEY, F.col("p2").alias("i"), (F.col("s") * (F.col("p2") - F.col("p1") + F.col("yr"))).alias("peak_mag"))


def frequency(one: DataFrame, p: Params) -> DataFrame:
    """Adds freq: peaks in a window of peak_freq_yr about each row, scaled up where the
    series' ends cut it off. All frames are literals."""
    if not p.fixed:
        return _frequency_by_series(one, p)
    q = p.peak_freq_yr / p.yr_interp
    half = int(q) / 2
    lo, full = int(half), round(q)
    k = F.when(F.col("is_peak"), 1).otherwise(0)
    head = F.sum(k).over(_by_i().rowsBetween(Window.unboundedPreceding, lo)) * (full / (F.col("i") + lo))
    # All peaks less those before: a frame open at its end would be read anew for every row.
    left = F.sum(k).over(Window.partitionBy(*KEY)) - F.coalesce(F.sum(k).over(_by_i().rowsBetween(Window.unboundedPreceding, -lo - 1)), F.lit(0))
    tail = left * q / (F.col("n") - F.col("i") + lo + 1)
    mid = F.coalesce(F.sum(k).over(_by_i().rowsBetween(1 - int(q / 2), -int(-0.5 * full // 1))), F.lit(0)).cast("double")
    return one.withColumn("freq", F.when(F.col("i") < half, head).when(F.col("i") > F.col("n") - half, tail).otherwise(mid))


def _frequency_by_series(one: DataFrame, p: Params) -> DataFrame:
    """frequency() where each series has its own interval: the row numbers are scaled, so
    that the frames stay literals."""
    q = p.freq / F.col("yr")
    half = F.floor(q) / 2
    lo, full, ahead, behind = F.floor(half), F.bround(q), F.ceil(F.bround(q) / 2), F.floor(q / 2)
    k = F.when(F.col("is_peak"), 1).otherwise(0)
    whole = Window.partitionBy(*KEY)

    def up_to(rows: Column) -> Column:
        """Peaks at most so many rows ahead."""
        return F.sum(k).over(whole.orderBy(F.col("i") / (rows + 0.5)).rangeBetween(Window.unboundedPreceding, 1))

    def before(rows: Column) -> Column:
        """Peaks at least so many rows (one or more) behind."""
        return F.coalesce(F.sum(k).over(whole.orderBy(F.col("i") / (rows - 0.5)).rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))

    head = up_to(lo) * (full / (F.col("i") + lo))
    tail = (F.sum(k).over(whole) - before(lo + 1)) * q / (F.col("n") - F.col("i") + lo + 1)
    gone = F.when(behind >= 1, before(F.greatest(behind, F.lit(1)))).otherwise(up_to(F.lit(0)))
    mid = (up_to(ahead) - gone).cast("double")
    return one.withColumn("freq", F.when(F.col("i") < half, head).when(F.col("i") > F.col("n") - half, tail).otherwise(mid))


def smooth_frequency(freq: DataFrame, p: Params) -> DataFrame:
    k = span_points(p.freq / F.col("yr"), F.col("n"))
    return lowess(freq, "freq", "sm_freq", k, widest_of(p, p.peak_freq_yr) if p.fixed else None)


def moving_intervals(one: DataFrame, p: Params) -> DataFrame:
    """site, run_id, step, step_age, fri: return intervals with both peaks inside the
    window of peak_freq_yr about each step. An interval is sent to its steps by arithmetic.
    The end of its series comes with it: a join would work the peaks out twice."""
    w = p.freq
    par = [c for c in one.columns if c == "par"]
    x = intervals(one.withColumn("end", F.max("age").over(Window.partitionBy(*KEY))), ("end", *par))
    lo = F.greatest(F.lit(0).cast("long"), F.floor((F.col("age") - w / 2 - STEP0) / STEP) + 1)
    hi = F.least(F.floor((F.col("prev_age") + w / 2 - STEP0) / STEP), F.floor((F.col("end") - STEP0) / STEP + 1e-10))
    x = x.withColumns({"lo": lo, "hi": hi}).where("lo <= hi").withColumn("step", F.explode(F.sequence("lo", "hi")))
    return x.select(*KEY, "step", (STEP0 + STEP * F.col("step")).cast("double").alias("step_age"), "fri", *par)


def fri_band(moved: DataFrame) -> DataFrame:
    """site, run_id, step, step_age, n, mean, lo, hi: mean with its standard error, from two intervals on."""
    x = moved.groupBy(*KEY, "step", "step_age").agg(F.count("*").alias("n"), F.avg("fri").alias("mean"), F.stddev_samp("fri").alias("sd"), *_kept(moved)).where("n > 1")
    se = F.col("sd") / F.sqrt("n")
    return x.select(*KEY, "step", "step_age", "n", "mean", (F.col("mean") - se).alias("lo"), (F.col("mean") + se).alias("hi"), *[c for c in x.columns if c == "par"])


def fri_bootstrap(moved: DataFrame, p: Params | ByRun) -> DataFrame:
    """fri_band() with percentiles of seeded bootstrap means."""
    key = [*KEY, "step", "step_age"]
    groups = resample.gathered(moved, key, "fri").where("n > 1")
    draws = resample.resamples(groups, [*KEY, "step"], p.n_boot).withColumn("m", resample.mean_of("picks"))
    cut = resample.limits(draws, [*KEY, "step"], ["m"]).withColumnsRenamed({"m_lo": "lo", "m_hi": "hi"})
    return groups.drop("values").join(cut, [*KEY, "step"])


def smooth_band(band: DataFrame, p: Params) -> DataFrame:
    """Adds sm_fri, sm_lo, sm_hi: local lines over the steps in order, from three steps on."""
    x = band.withColumns({"i": F.row_number().over(Window.partitionBy(*KEY).orderBy("step")), "m": F.count("*").over(Window.partitionBy(*KEY)).cast("int")}).where("m > 2")
    span = p.freq / STEP / F.col("m")
    x = lowess(x, ["mean", "lo", "hi"], ["sm_fri", "sm_lo", "sm_hi"], span_points(span, F.col("m")), max(3, round(p.peak_freq_yr / STEP)) if p.fixed else None)
    return x.drop("i", "m")


def fri_on_grid(smoothed: DataFrame, grid: DataFrame, p: Params) -> DataFrame:
    """site, run_id, i, sm_fri at grid ages before the last step, linear between steps."""
    w = Window.partitionBy(*KEY).orderBy("step")
    x = smoothed.select(*KEY, "step", "step_age", "sm_fri").withColumns({"next_age": F.lead("step_age").over(w), "next_fri": F.lead("sm_fri").over(w)}).where("next_age is not null")
    sites = grid.groupBy(*KEY).agg(F.min("age").alias("z"), F.first("yr").alias("yr"), F.max("n").alias("n"))
    x = x.join(sites, list(KEY))
    lo = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("step_age") - F.col("z")) / F.col("yr") - 1e-9))
    hi = F.least(F.col("n").cast("long") - 1, F.ceil((F.col("next_age") - F.col("z")) / F.col("yr") - 1e-9) - 1)
    x = x.withColumns({"lo": lo, "hi": hi}).where("lo <= hi").withColumn("c", F.explode(F.sequence("lo", "hi")))
    part = (F.col("z") + F.col("c") * F.col("yr") - F.col("step_age")) / (F.col("next_age") - F.col("step_age"))
    return x.select(*KEY, (F.col("c") + 1).cast("int").alias("i"), (F.col("sm_fri") + (F.col("next_fri") - F.col("sm_fri")) * part).alias("sm_fri"))


def zones(ends: DataFrame, p: Params) -> DataFrame:
    """site, zone, z_lo, z_hi: the parameter's zones, the last cut at the site's end."""
    end = F.when(F.col("k") == F.size("d") - 2, F.col("zone_end")).otherwise(F.col("d")[F.col("k") + 1])
    x = ends.select(*_series(ends), "zone_end", p.limits.alias("d")).withColumn("k", F.explode(F.sequence(F.lit(0), F.size("d") - 2)))
    return x.select(*_series(ends), (F.col("k") + 1).alias("zone"), F.col("d")[F.col("k")].alias("z_lo"), end.alias("z_hi"))


def _series(df: DataFrame) -> list[str]:
    return [c for c in KEY if c in df.columns]


def _kept(df: DataFrame) -> list[Column]:
    return [F.first("par").alias("par")] if "par" in df.columns else []


def zone_intervals(one: DataFrame, zone_table: DataFrame) -> DataFrame:
    """site, run_id, zone, age, fri: intervals between peaks of one zone [z_lo, z_hi)."""
    x = one.where("is_peak").join(zone_table, _series(zone_table)).where("age >= z_lo and age < z_hi")
    w = Window.partitionBy(*KEY, "zone").orderBy("age")
    x = x.withColumn("fri", F.col("age") - F.lag("age").over(w))
    return x.where("fri is not null").select(*KEY, "zone", "age", "fri")


def usable_zones(zoned: DataFrame) -> DataFrame:
    """Zones with two intervals or more and none over MAX_FRI: n_fri, mfri."""
    x = zoned.groupBy(*KEY, "zone").agg(F.count("*").alias("n_fri"), F.avg("fri").alias("mfri"), F.max("fri").alias("most"))
    return x.where((F.col("n_fri") > 1) & (F.col("most") <= MAX_FRI)).drop("most")


def histogram(zoned: DataFrame, width: float = 20.0, top: float = 1000.0) -> DataFrame:
    """site, run_id, zone, bin, centre, freq, share: bins [20, 40) to [980, 1000), empty ones too."""
    n = int(top / width) - 1
    x = zoned.join(usable_zones(zoned).select(*KEY, "zone"), [*KEY, "zone"], "left_semi")
    hit = x.where((F.col("fri") >= width) & (F.col("fri") < top)).select(*KEY, "zone", F.floor(F.col("fri") / width).cast("int").alias("bin"), F.lit(1).alias("k"))
    every = x.select(*KEY, "zone").distinct().withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("k", F.lit(0))
    out = hit.unionByName(every).groupBy(*KEY, "zone", "bin").agg(F.sum("k").alias("freq"))
    share = F.try_divide(F.col("freq").cast("double"), F.sum("freq").over(Window.partitionBy(*KEY, "zone")).cast("double"))
    return out.select(*KEY, "zone", "bin", ((F.col("bin") + 0.5) * width).alias("centre"), "freq", share.alias("share"))


def zone_stats(zoned: DataFrame, p: Params | ByRun) -> DataFrame:
    """Weibull fits, their test and bootstrap limits by zone, of the usable zones with two bins
    in use or more. As in the tables this feeds, *_uci holds the 2.5 % limit and *_lci the
    97.5 % limit. A resample with fewer than two bins in use counts for none of them."""
    key = [*KEY, "zone"]
    groups = resample.gathered(zoned, key, "fri").where((F.col("n") > 1) & (F.element_at("values", -1) <= MAX_FRI))
    # Rows are left out before the fit: a filter behind it would be pushed below, and write
    # the whole fit out once for each time that it names it.
    in_use = F.size(F.filter("freq", lambda f: f > 0)) > 1
    fitted = resample.with_weibull(groups.withColumn("freq", resample.binned("values")).where(in_use), "freq", "wbl_b", "wbl_c")
    fitted = fitted.withColumn("p_ks", resample.ks_weibull("values", "n", "wbl_b", "wbl_c"))
    draws = resample.resamples(groups, key, p.n_boot)
    draws = resample.with_weibull(draws.withColumn("freq", resample.binned("picks")).withColumn("m", F.when(in_use, resample.mean_of("picks"))), "freq", "b", "c")
    cut = resample.limits(draws, key, ["m", "b", "c"])
    x = fitted.join(cut, key)
    named = {"mfri_uci": "m_lo", "mfri_lci": "m_hi", "wbl_b_uci": "b_lo", "wbl_b_lci": "b_hi", "wbl_c_uci": "c_lo", "wbl_c_lci": "c_hi"}
    out = ["mfri_uci", "mfri_lci", "wbl_b", "wbl_b_uci", "wbl_b_lci", "wbl_c", "wbl_c_uci", "wbl_c_lci", "p_ks"]
    return x.select(*key, F.col("n").alias("n_fri"), F.col("mean").alias("mfri"), *[F.col(named.get(c, c)).alias(c) for c in out])


RESULT = [
    "cm_top_i", "age_top_i", "count_i", "vol_i", "con_i", "acc_i", "bkg", "peak", "thresh1", "thresh2", "thresh3", "thresh_pos", "thresh_neg", "sni", "gof",
    "peaks1", "peaks2", "peaks3", "peaks_final", "peaks_insig", "peak_mag", "sm_peak_freq", "sm_fri", "n_fri", "mfri", "mfri_uci", "mfri_lci",
    "wbl_b", "wbl_b_uci", "wbl_b_lci", "wbl_c", "wbl_c_uci", "wbl_c_lci",
]


def results(thresholds: DataFrame, peaks: DataFrame, ends: DataFrame, p: Params, bootstrap: bool = True) -> DataFrame:
    """The table of 33 result columns by grid row (RESULT), keyed by site, run_id, i."""
    one = final(peaks)
    by_t = peaks.groupBy(*KEY, "i").agg(*[F.max(F.when(F.col("t") == j, F.col("is_peak").cast("int"))).alias(f"pk{j}") for j in (1, 2, 3, 4)], F.max(F.when(F.col("t") == FINAL, F.col("insig").cast("int"))).alias("pk_insig"))
    freq = smooth_frequency(frequency(one, p), p).select(*KEY, "i", "sm_freq")
    moved = moving_intervals(one, p)
    band = smooth_band(fri_bootstrap(moved, p) if bootstrap else fri_band(moved), p)
    grid_fri = fri_on_grid(band, one, p)
    zone = zone_stats(zone_intervals(one, zones(ends, p)), p).withColumnRenamed("zone", "i").drop("p_ks")
    x = thresholds
    for more in (by_t, freq, magnitude(thresholds), grid_fri, zone):
        x = x.join(more, [*KEY, "i"], "left")
    renamed = {
        "cm_top_i": "cm", "age_top_i": "age", "count_i": "cnt", "vol_i": "vol", "con_i": "con", "acc_i": "acc", "thresh1": "pos1", "thresh2": "pos2", "thresh3": "pos3",
        "thresh_pos": "pos4", "thresh_neg": "neg4", "peaks1": "pk1", "peaks2": "pk2", "peaks3": "pk3", "peaks_final": "pk4", "peaks_insig": "pk_insig", "sm_peak_freq": "sm_freq",
    }
    x = x.withColumn("peak_mag", F.coalesce("peak_mag", F.lit(0.0)))
    return x.select(*KEY, "i", *[F.col(renamed.get(c, c)).alias(c) for c in RESULT])
