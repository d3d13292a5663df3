"""Peaks at every candidate threshold of a series, not only at four.

A row ends a run above a threshold if it lies above and its successor does not: so it is a
run end for the bins between the two values, a range found by arithmetic. Only run ends are
made into rows, not every row at every bin.

What the count test asks of a run end's window, the greatest count on the young side and the
least on the old side, depends on the row and on how far the window reaches, not on the bin.
Each grid row therefore gets, once, the records met when walking away from it: where a new
extreme is reached, its count and its volume. A window of any reach is answered by the last
record within it. Records are few where counts vary, and never more than the search window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from varve.operators.peaks import count_test, search_rows
from varve.operators.smooth import KEY, within
from varve.operators.threshold import N_BINS
from varve.params import ByRun, Params

KEY_B = (*KEY, "bin")


def run_ends(df: DataFrame) -> DataFrame:
    """site, run_id, bin, possible, i, age, n: the run ends at each positive bin. Null values
    lie above nothing; a series without spread has no run."""
    whole, by_i = Window.partitionBy(*KEY), Window.partitionBy(*KEY).orderBy("i")
    x = df.withColumns({"__lo": F.min("peak").over(whole), "__hi": F.max("peak").over(whole), "__next": F.lead("peak").over(by_i)})
    step = (F.col("__hi") - F.col("__lo")) / N_BINS
    at = lambda v: F.try_divide(v - F.col("__lo"), step)
    first = F.greatest(F.lit(0), F.floor(F.coalesce(at(F.col("__next")), F.lit(0.0))) - 1).cast("int")
    last = F.least(F.lit(N_BINS), F.ceil(at(F.col("peak"))) + 1).cast("int")
    x = x.withColumns({"__first": first, "__last": last}).where("__last >= __first").withColumn("bin", F.explode(F.sequence("__first", "__last")))
    x = x.withColumn("possible", F.col("__lo") + (F.col("__hi") - F.col("__lo")) * F.col("bin") / N_BINS)
    thr = F.round("possible", 9)
    ends = (F.round("peak", 9) > thr) & ~F.coalesce(F.round("__next", 9) > thr, F.lit(False)) & (F.col("possible") > 0)
    return x.where(ends).select(*KEY_B, "possible", "i", "age", "n", *[c for c in df.columns if c == "par"])


def records(df: DataFrame, p: Params | ByRun) -> DataFrame:
    """site, run_id, i, young, old: records of the rounded count from each row outwards, as
    arrays of structs (far: rows away, c, v), nearest first. On the young side a greater or
    equal count is a record (of equal counts the youngest row speaks), on the old side a lesser one."""
    row = F.struct("i", F.bround("cnt").alias("c"), F.col("vol").alias("v"))
    x = df.select(*KEY, "i", F.collect_list(row).over(within(KEY, search_rows(p))).alias("__near"), *[c for c in df.columns if c in ("yr", "par")])
    none = F.array().cast("array<struct<far:int,c:double,v:double>>")

    def climb(rows: Column, far, beats) -> Column:
        return F.aggregate(rows, none, lambda acc, r: F.when(r["c"].isNotNull() & ((F.size(acc) == 0) | beats(r["c"], F.try_element_at(acc, F.lit(-1))["c"])), F.concat(acc, F.array(F.struct(far(r).alias("far"), r["c"].alias("c"), r["v"].alias("v"))))).otherwise(acc))

    young = F.reverse(F.filter("__near", lambda r: r["i"] <= F.col("i")))
    old = F.filter("__near", lambda r: r["i"] >= F.col("i"))
    return x.select(
        *KEY, "i", climb(young, lambda r: F.col("i") - r["i"], lambda a, b: a >= b).alias("young"), climb(old, lambda r: r["i"] - F.col("i"), lambda a, b: a < b).alias("old")
    )


def identify(df: DataFrame, p: Params | ByRun) -> DataFrame:
    """run_ends() with c_max, v_max, c_min, v_min, d, insig and is_peak: as peaks.identify()
    has them for four thresholds. A bin with a single run end is not tested."""
    ends, m = run_ends(df), search_rows(p)
    if not p.fixed:
        ends = ends.join(df.select(*KEY, "i", "yr"), [*KEY, "i"])
    w = Window.partitionBy(*KEY_B).orderBy("i")
    x = ends.withColumns({"prev_i": F.lag("i").over(w), "next_i": F.lead("i").over(w)})
    tested = F.col("prev_i").isNotNull() | F.col("next_i").isNotNull()
    reach = {
        "__y": F.col("i") - F.greatest(F.lit(1), F.col("i") - m, F.coalesce("prev_i", F.lit(1))),
        "__o": F.least(F.col("n"), F.col("i") + m, F.coalesce("next_i", F.col("n"))) - F.col("i"),
    }
    x = x.withColumns({k: F.when(tested, v) for k, v in reach.items()} | {"is_end": F.lit(True)})
    x = x.join(records(df, p), [*KEY, "i"])
    best = lambda side, far: F.try_element_at(F.filter(side, lambda r: r["far"] <= F.col(far)), F.lit(-1))
    x = x.withColumns({"__max": best("young", "__y"), "__min": best("old", "__o")})
    x = x.withColumns({"c_max": F.col("__max.c"), "v_max": F.col("__max.v"), "c_min": F.col("__min.c"), "v_min": F.col("__min.v")})
    x = count_test(x, p)
    return x.withColumn("is_peak", ~F.col("insig")).drop("young", "old", "__y", "__o", "__max", "__min", "prev_i", "next_i")


def totals(peaks: DataFrame, bins: DataFrame) -> DataFrame:
    """site, run_id, bin, possible, n_ends, n_peaks of every positive bin, those without a peak too."""
    none = bins.where("possible > 0").select(*KEY_B, "possible", F.lit(0).alias("end"), F.lit(0).alias("peak"))
    hits = peaks.select(*KEY_B, "possible", F.lit(1).alias("end"), F.col("is_peak").cast("int").alias("peak"))
    return none.unionByName(hits).groupBy(*KEY_B).agg(F.max("possible").alias("possible"), F.sum("end").alias("n_ends"), F.sum("peak").alias("n_peaks"))


def intervals(peaks: DataFrame) -> DataFrame:
    """site, run_id, bin, age, prev_age, fri: between next peaks of one bin."""
    x = peaks.where("is_peak").withColumn("prev_age", F.lag("age").over(Window.partitionBy(*KEY_B).orderBy("i")))
    return x.where("prev_age is not null").select(*KEY_B, "age", "prev_age", (F.col("age") - F.col("prev_age")).alias("fri"))
