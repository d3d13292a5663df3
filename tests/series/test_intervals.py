import numpy as np
import pytest
from pyspark.sql import functions as F

from varve.functions import stats
from varve.operators import figures, history, smooth
from varve.params import Params

P = Params(zone_div=(0.0, 4000.0), yr_interp=20.0, smooth_yr=400.0, peak_freq_yr=1000.0)
PEAKS = "site string, run_id string, t int, i int, age double, yr double, n int, is_peak boolean"


def peaks(spark):
    spots = {"a": {5, 12, 14, 30, 41, 47, 60, 66, 67, 90, 120, 133, 150, 171}, "b": {7, 9, 80, 81, 95}}
    return spark.createDataFrame([(s, "r", 4, i, 20.0 * (i - 1), 20.0, 200, i in at) for s, at in spots.items() for i in range(1, 201)], PEAKS)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_window_tests_work_the_peaks_out_once(spark):
    one = peaks(spark)
    found = figures.window_tests(history.moving_intervals(one, P), P)
    assert plan_of(found).count("LogicalRDD") == plan_of(one).count("LogicalRDD")


def test_window_tests_by_hand(spark):
    moved = history.moving_intervals(peaks(spark), P)
    fri = {}
    for r in moved.collect():
        fri.setdefault((r.site, r.step), []).append(r.fri)
    want = {}
    for (site, step), x in fri.items():
        y = fri.get((site, step - 9), [])
        if len(x) > 1 and len(y) > 1:
            x, y = np.sort(x), np.sort(y)
            want[site, step] = (stats.ks_two_sample(x, y)[1], stats.rank_sum_p(x, y), stats.anderson_darling_k([x, y]))
    got = {(r.site, r.step): (r.ks_p, r.rank_p, r.ad) for r in figures.window_tests(moved, P).collect()}
    assert len(want) > 10 and got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_an_interval_stays_within_the_end_of_its_series(spark):
    short = peaks(spark).where("site = 'a' and i <= 172 or site = 'b'")
    last = {r.site: r.s for r in history.moving_intervals(short, P).groupBy("site").agg(F.max("step").alias("s")).collect()}
    assert last == {"a": 34, "b": 21}


def test_weight_of_a_neighbour_is_made_once(spark):
    df = spark.range(1, 31).selectExpr("'s' AS site", "'r' AS run_id", "cast(id as int) AS i", "cast(2 * id + 1 as double) AS y", "cast(id as double) AS z")
    fit = smooth.lowess(df, ["y", "z"], ["fy", "fz"], F.lit(7), 7)
    assert plan_of(fit).count("abs(") < 20
    assert all(abs(r.fy - r.y) < 1e-9 and abs(r.fz - r.z) < 1e-9 for r in fit.collect())
