import math
import random

from pyspark.sql import functions as F
from test_runs import P, cores

from varve.functions import stats
from varve.operators import levels, peaks, resample, threshold
from varve.params import Params
from varve.plans.study import Study

G = Params(**{**P.__dict__, "thresh_type": 1})


def test_all_levels_screen_as_four_do(spark):
    df = Study(cores(spark), G, gof=False).peaked
    bins = threshold.bins(df).where("bin in (130, 150, 190, 230) and possible > 0")
    four = bins.groupBy("site", "run_id").agg(F.sort_array(F.collect_list("possible")).alias("p"), F.sort_array(F.collect_list("bin")).alias("b"))
    assert four.count() == 2 and four.where("size(b) = 4").count() == 2
    given = df.join(four, ["site", "run_id"]).withColumns({f"pos{j}": F.col("p")[j - 1] for j in (1, 2, 3, 4)})
    want = {(r.site, (130, 150, 190, 230)[r.t - 1], r.i): (r.c_max, r.v_max, r.c_min, r.v_min, r.is_peak) for r in peaks.identify(given, G).where("is_end").collect()}
    got = {(r.site, r.bin, r.i): (r.c_max, r.v_max, r.c_min, r.v_min, r.is_peak) for r in levels.identify(df, G).where("bin in (130, 150, 190, 230)").collect()}
    assert got == want and len(got) > 20


def test_levels_of_flat_null_and_empty_series(spark):
    schema = "site string, run_id string, i int, age double, yr double, n int, cnt double, vol double, peak double"
    rows = [("flat", "r", k, float(k), 20.0, 5, 1.0, 1.0, 2.0) for k in range(1, 6)] + [("null", "r", k, float(k), 20.0, 3, None, None, None) for k in range(1, 4)] + [("one", "r", k, float(k), 20.0, 3, 0.0, 1.0, v) for k, v in ((1, 0.0), (2, 5.0), (3, None))]
    df = spark.createDataFrame(rows, schema)
    got = levels.totals(levels.identify(df, G), threshold.bins(df))
    assert {r.site for r in levels.identify(df, G).collect()} == {"one"}
    assert {(r.n_ends, r.n_peaks) for r in got.where("site = 'one' and bin < 250").collect()} == {(1, 1)}
    assert levels.identify(df.limit(0), G).count() == 0


def test_resamples_are_fair_and_repeat(spark):
    rows = [("a", float(v)) for v in (3, 1, 2, 9)] + [("b", 5.0)]
    groups = resample.gathered(spark.createDataFrame(rows, "g string, v double"), ["g"], "v")
    draws = resample.resamples(groups, ["g"], 2000)
    first = draws.orderBy("g", "draw").collect()
    assert first == draws.orderBy("g", "draw").collect() and len(first) == 4000
    of = [v for r in first if r.g == "a" for v in r.picks]
    assert len(of) == 8000 and all(abs(of.count(v) - 2000) < 200 for v in (1.0, 2.0, 3.0, 9.0))
    assert all(r.picks == [5.0] for r in first if r.g == "b")


def test_weibull_and_its_test_equal_numpy(spark):
    r = random.Random(5)
    cases = [sorted(r.weibullvariate(b, c) for _ in range(n)) for b, c, n in ((200, 1.5, 60), (90, 3.0, 25), (400, 0.8, 40), (50, 8.0, 12))] + [[100.0, 101.0], [30.0, 990.0], [2000.0, 2500.0]]
    df = spark.createDataFrame([(k, v, len(v)) for k, v in enumerate(cases)], "k int, v array<double>, n int").withColumn("f", resample.binned("v"))
    for row in resample.with_weibull(df, "f", "b", "c").withColumn("p", resample.ks_weibull("v", "n", "b", "c")).collect():
        x = [(math.floor(v / 20) + 0.5) * 20 for v in row.v if 20 <= v < 1000]
        fit = stats.weibull_mle(x) if x else None
        if fit is None:
            assert row.b is None and row.c is None
            continue
        assert math.isclose(row.b, fit[0], rel_tol=1e-9) and math.isclose(row.c, fit[1], rel_tol=1e-9)
        edge = [20.0 * k for k in range(251)]
        import numpy as np

        cdf = 1 - np.exp(-((np.array(edge) / row.b) ** row.c))
        assert math.isclose(row.p, stats.ks_one_sample(row.v, lambda q: np.interp(q, edge, cdf), exact=False)[1], abs_tol=1e-9)
