"""Peaks: flags, run ends, and the count test against their neighbours."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from varve.functions import stats
from varve.operators.smooth import KEY, rows_of, within
from varve.params import Params

KEY_T = (*KEY, "t")
SEARCH_YR = 150.0

def _by_i():
    return Window.partitionBy(*KEY_T).orderBy("i")



def flags(df: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """One row for each grid row and threshold t (1..4): thr, flag (peak above it), and more
    columns if asked for. Both sides are compared at 9 decimals, so that equal values do not differ by rounding."""
    cols = ["i", "age", "yr", "n", "cnt", "vol", "peak", *[c for c in df.columns if c == "par"], *more]
    x = df.select(*KEY, *cols, F.posexplode(F.array(*[F.col(f"pos{j}") for j in (1, 2, 3, 4)])).alias("t", "thr"))
    return x.withColumns({"t": F.col("t") + 1, "flag": F.coalesce(F.round("peak", 9) > F.round("thr", 9), F.lit(False))})


def run_ends(flagged: DataFrame) -> DataFrame:
    """Adds is_end: the last row of each run of flags; and thr_peak, the first row's threshold there."""
    end = F.col("flag") & ~F.coalesce(F.lead("flag").over(_by_i()), F.lit(False))
    x = flagged.withColumn("is_end", end)
    return x.withColumn("thr_peak", F.when(F.col("is_end"), F.first("thr").over(_by_i().rowsBetween(Window.unboundedPreceding, 0))).otherwise(0.0))


def search_rows(p: Params) -> int | Column:
    return rows_of(SEARCH_YR, p)


def windows(ends: DataFrame, p: Params) -> DataFrame:
    """Adds young and old, the rows within which a peak is compared: SEARCH_YR to either
    side, no further than the next peaks; null unless the series has two peaks or more."""
    m = search_rows(p)
    spot = F.when(F.col("is_end"), F.col("i"))
    before = _by_i().rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*KEY_T).orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, -1)
    x = ends.withColumns({"prev_i": F.max(spot).over(before), "next_i": F.min(spot).over(after)})
    tested = F.col("is_end") & (F.col("prev_i").isNotNull() | F.col("next_i").isNotNull())
    young = F.greatest(F.lit(1), F.col("i") - m, F.coalesce("prev_i", F.lit(1)))
    old = F.least(F.col("n"), F.col("i") + m, F.coalesce("next_i", F.col("n")))
    return x.withColumns({"young": F.when(tested, young), "old": F.when(tested, old)})


def extremes(windowed: DataFrame, p: Params) -> DataFrame:
    """Adds c_max, v_max (greatest rounded count on the young side, the first row that has
    it, and its volume) and c_min, v_min (least on the old side)."""
    m = search_rows(p)
    near = F.collect_list(F.struct("i", F.bround("cnt").alias("c"), "vol")).over(within(KEY_T, m))
    x = windowed.withColumn("__near", F.when(F.col("young").isNotNull(), near))
    young = F.filter("__near", lambda r: (r["i"] >= F.col("young")) & (r["i"] <= F.col("i")) & r["c"].isNotNull())
    old = F.filter("__near", lambda r: (r["i"] >= F.col("i")) & (r["i"] <= F.col("old")) & r["c"].isNotNull())
    x = x.withColumns({"__y": young, "__o": old})
    x = x.withColumns({"c_max": F.array_max(F.transform("__y", lambda r: r["c"])), "c_min": F.array_min(F.transform("__o", lambda r: r["c"]))})
    v_max = F.try_element_at(F.filter("__y", lambda r: r["c"] == F.col("c_max")), F.lit(1))["vol"]
    v_min = F.try_element_at(F.filter("__o", lambda r: r["c"] == F.col("c_min")), F.lit(1))["vol"]
    return x.withColumns({"v_max": v_max, "v_min": v_min}).drop("__near", "__y", "__o")


def count_test(x: DataFrame, p: Params) -> DataFrame:
    """Adds d, the statistic that two counts from two volumes have one rate, and insig:
    its p-value is above the limit, by the literal quantile. Two zero counts have p 1."""
    both = F.col("c_min") + F.col("c_max")
    v = F.try_divide("v_min", F.col("v_min") + F.col("v_max"))
    d = F.try_divide(F.abs(F.col("c_min") - both * v) - 0.5, F.sqrt(both * v * (1 - v)))
    x = x.withColumns({"d": F.when(both > 0, d), "__both": both})
    insig = F.when(F.col("__both") == 0, True).otherwise(F.round("d", 9) < F.round(p.z_count, 9))
    return x.withColumn("insig", F.coalesce(insig & F.col("is_end"), F.lit(False))).drop("__both")


def identify(thresholds: DataFrame, p: Params, more: tuple[str, ...] = ()) -> DataFrame:
    """All of the above (with more of the columns of thresholds); adds is_peak: run ends that the count test leaves."""
    x = count_test(extremes(windows(run_ends(flags(thresholds, more)), p), p), p)
    return x.withColumn("is_peak", F.col("is_end") & ~F.col("insig"))


def totals(peaks: DataFrame) -> DataFrame:
    return peaks.groupBy(*KEY_T).agg(F.count_if("is_peak").alias("n_peaks"))


def intervals(peaks: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """site, run_id, t, age, prev_age, fri: years between next peaks; and more columns if asked for."""
    x = peaks.where("is_peak").withColumn("prev_age", F.lag("age").over(_by_i()))
    return x.where("prev_age is not null").select(*KEY_T, "i", "age", "prev_age", (F.col("age") - F.col("prev_age")).alias("fri"), *more)


def exact_p(x: DataFrame) -> DataFrame:
    """Adds p, the count test's p-value itself."""
    @F.pandas_udf("double")
    def tail(d: pd.Series) -> pd.Series:
        return pd.Series(1 - stats.normal_cdf(d.fillna(0.0).to_numpy())).where(d.notna().reset_index(drop=True))

    return x.withColumn("p", F.when((F.col("c_min") + F.col("c_max")) == 0, 1.0).otherwise(tail("d")))


def sensitivity(df: DataFrame, possible: DataFrame) -> DataFrame:
    """site, run_id, bin, possible, n_above, n_ends: rows above each positive bin value and
    run ends among them. Rows meet bins by series; what leaves is one row a bin."""
    grid = df.select(*KEY, "i", F.round("peak", 9).alias("peak"), F.round(F.lead("peak").over(Window.partitionBy(*KEY).orderBy("i")), 9).alias("next"))
    x = grid.join(possible.where("possible > 0"), list(KEY))
    thr = F.round("possible", 9)
    above = F.coalesce(F.col("peak") > thr, F.lit(False))
    end = above & ~F.coalesce(F.col("next") > thr, F.lit(False))
    return x.groupBy(*KEY, "bin").agg(F.first("possible").alias("possible"), F.count_if(above).alias("n_above"), F.count_if(end).alias("n_ends"))
