import math
import statistics

from pyspark.sql import functions as F

from varve.params import ByRun, Params, as_table, families, quantile
from varve.plans.study import Runs, Study, window_sweep
from varve.stages import stage

P = Params(zone_div=(0.0, 900.0, 2400.0), yr_interp=20.0, smooth_yr=600.0, peak_freq_yr=500.0)
Q = Params(zone_div=(100.0, 2000.0), yr_interp=30.0, smooth_yr=700.0, peak_freq_yr=600.0, thresh_values=(0.8, 0.9, 0.95, 0.9), min_count_p=0.4, run_id="q")


def cores(spark, sites=("a", "b")):
    rows = [(s, k, 0.5 * (k - 1), 0.5 * k, 10.0 * (k - 1), 10.0 * k, 0.0 if k in (40, 41) else 2.0 + k % 3, float((k * 37 + len(s)) % 11 + (25 if k % 30 < 2 else 0))) for s in sites for k in range(1, 241)]
    return spark.createDataFrame(rows, "site string, sample_no int, cm_top double, cm_bot double, age_top double, age_bot double, vol double, cnt double")


def table(df):
    return {(r.site, r.run_id, r.i): (r.acc, r.bkg, r.peak, r.pos4, r.neg1, r.sni) for r in df.select("site", "run_id", "i", *[F.round(c, 9).alias(c) for c in ("acc", "bkg", "peak", "pos4", "neg1", "sni")]).collect()}


def test_quantile_is_the_librarys(spark):
    ps = [1e-300, 1e-12, 0.001, 0.075, 0.2, 0.5, 0.74, 0.95, 0.999, 1 - 1e-9]
    rows = spark.createDataFrame([(p,) for p in [*ps, 0.0, 1.0, 2.0]], "p double").select("p", quantile(F.col("p")).alias("z")).collect()
    for r in rows:
        assert r.z is None if not 0 < r.p < 1 else math.isclose(r.z, statistics.NormalDist().inv_cdf(r.p), rel_tol=1e-13, abs_tol=1e-15)


def test_runs_equal_single_runs(spark):
    raw = cores(spark)
    runs = Runs(raw, as_table(spark, [("a", P), ("a", Q), ("b", Q), ("none", P)]), gof=False)
    assert len(runs.studies) == 1
    got = table(runs.union(lambda s: s.thresholds))
    want = {}
    for site, p in (("a", P), ("a", Q), ("b", Q)):
        want |= table(Study(raw.where(F.col("site") == site), p, gof=False).thresholds)
    assert got == want and len(got) == 249


def test_own_interval_beside_given_ones(spark):
    raw, auto = cores(spark), Params(**{**P.__dict__, "yr_interp": 0.0, "run_id": "auto"})
    got = table(Runs(raw, as_table(spark, [("a", auto), ("b", P)]), gof=False).union(lambda s: s.thresholds))
    assert got == table(Study(raw.where("site = 'a'"), auto, gof=False).thresholds) | table(Study(raw.where("site = 'b'"), P, gof=False).thresholds)


def test_moving_windows_by_run(spark):
    raw = cores(spark)
    for method in (3, 4, 5):
        p, q = (Params(**{**x.__dict__, "method": method}) for x in (P, Q))
        runs = Runs(raw, as_table(spark, [("a", p), ("b", q)]))
        bkg = lambda df: {(r.site, r.i): round(r.bkg, 9) for r in df.select("site", "i", "bkg").where("bkg is not null").collect()}
        assert bkg(runs.union(lambda s: s.smoothed)) == bkg(Study(raw.where("site = 'a'"), p).smoothed) | bkg(Study(raw.where("site = 'b'"), q).smoothed)


def test_families_are_choices_in_use(spark):
    more = Params(**{**P.__dict__, "method": 2, "run_id": "r"})
    found = families(as_table(spark, [("a", P), ("b", Q), ("c", more)]))
    assert [f["method"] for f in found] == [1, 2] and ByRun(found[0]).neutral == 0.0
    assert families(as_table(spark, [])) == []


def test_sweep_has_one_plan_of_any_width(spark):
    raw = cores(spark)
    nodes = lambda n: window_sweep(raw, P, [300.0 + 50 * k for k in range(n)], gof=False)._jdf.queryExecution().analyzed().toString().count("\n")
    assert nodes(2) == nodes(12)
    rows = {(r.site, r.bkg_window): r for r in window_sweep(raw, P, [400.0, 600.0], gof=True).collect()}
    assert len(rows) == 4
    one = Study(raw, P).thresholds.where("site = 'a'").agg(F.avg("sni").alias("sni"), F.avg("gof").alias("gof")).first()
    assert math.isclose(rows["a", 600.0].sni, one.sni, rel_tol=1e-9) and math.isclose(rows["a", 600.0].gof, one.gof, rel_tol=1e-9)


def test_valid_study_names_the_first_error(spark):
    import pytest

    raw = cores(spark)
    assert Study.valid(raw, P).p is P
    with pytest.raises(ValueError, match="rule 8"):
        Study.valid(raw, Params(**{**P.__dict__, "method": 9}))
    with pytest.raises(ValueError, match="background reaches 0"):
        Study.valid(raw.withColumn("cnt", F.lit(0.0)), Params(**{**P.__dict__, "c_peak": 2}))


def test_stage_is_read_back_as_it_was(spark):
    df = spark.createDataFrame([("a", None, [1.0])], "s string, n int, v array<double>")
    held = stage(df, "test")
    assert held.schema == df.schema and held.collect() == df.collect()
