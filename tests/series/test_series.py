from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from varve.operators import history, peaks, pretreat, smooth, threshold, validate
from varve.params import Params
from varve.plans.study import Study, sweep_windows
from varve.sources import files

P = Params(zone_div=(0.0, 400.0), yr_interp=10.0, smooth_yr=100.0, peak_freq_yr=100.0)
COLUMNS = "site string, sample_no int, cm_top double, cm_bot double, age_top double, age_bot double, vol double, cnt double"


def series(spark, n=41, step=10.0, vol=lambda i: 2.0, cnt=lambda i: float(i % 7)):
    return spark.createDataFrame([("s", i + 1, 0.5 * i, 0.5 * i + 0.5, step * i, step * i + step, vol(i), cnt(i)) for i in range(n)], COLUMNS)


def test_regular_samples_resample_to_themselves(spark):
    got = pretreat.pretreat(series(spark, 40), P).orderBy("i").collect()
    assert [round(r.cnt, 9) for r in got[:40]] == [float(i % 7) for i in range(40)] and [r.cm for r in got[:40]] == [0.5 * i for i in range(40)]


def test_gaps_are_linear_in_depth_and_edges_are_reported(spark):
    raw = series(spark, 12, vol=lambda i: 0.0 if i in (0, 4, 5) else 2.0, cnt=lambda i: 10.0 * i)
    got = {r.sample_no: r.cnt for r in pretreat.fill_gaps(pretreat.trim(raw, P)).collect()}
    assert got[1] is None and got[5] == pytest.approx(40) and got[6] == pytest.approx(50)
    assert (17, "error") in {(r.rule_no, r.severity) for r in validate.violations(spark, raw, P).collect()}
    with pytest.raises(ValueError):
        validate.require_valid(spark, raw, P)


def test_nan_is_null_and_never_a_peak(spark):
    raw = series(spark).withColumn("cnt", F.when(F.col("sample_no") == 9, float("nan")).otherwise(F.col("cnt")))
    found = Study(raw, P, gof=False).peaks.where("i = 9 and is_peak").count()
    assert pretreat.trim(raw, P).where("cnt is null").count() == 1 and found == 0


def test_constant_series_has_no_peak(spark):
    assert Study(series(spark, cnt=lambda i: 0.0), P, gof=False).peaks.where("is_peak").count() == 0


def test_local_line_is_exact_on_a_line(spark):
    df = spark.range(1, 31).selectExpr("'s' AS site", "'r' AS run_id", "cast(id as int) AS i", "cast(2 * id + 1 as double) AS y", "30 AS n")
    got = smooth.lowess(df, "y", "fit", F.lit(7), 7).collect()
    assert all(abs(r.fit - r.y) < 1e-9 for r in got)


def test_run_ends_keep_the_last_row(spark):
    hits = {1, 2, 5, 6, 7, 10}
    df = spark.createDataFrame([("s", "r", i, 10.0 * i, 10.0, 10, 1.0, 1.0, float(i in hits), 0.5, 0.5, 0.5, 0.5) for i in range(1, 11)], "site string, run_id string, i int, age double, yr double, n int, cnt double, vol double, peak double, pos1 double, pos2 double, pos3 double, pos4 double")
    got = {r.i for r in peaks.run_ends(peaks.flags(df)).where("t = 1 and is_end").collect()}
    assert got == {2, 7, 10}


def test_rules_on_parameters():
    assert validate.parameter_violations(replace(P, thresh_values=(0.9, 0.9, 1.0, 0.9))) == [12, 22]
    assert 11 in validate.parameter_violations(replace(P, thresh_method=1)) and 5 in validate.parameter_violations(replace(P, zone_div=(5.0, 1.0)))
    assert sweep_windows(replace(P, yr_interp=10.0)) == [300.0, 400.0]


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "AB_charParams.csv").write_text("Stage,Variable,Parameters,Units,Note\n" + "".join(f's,v{k},{v},u,"a, b"\n' for k, v in enumerate([-51, 5500, 7500] + [-9999] * 5 + [15, 0, 4, 500, 1, 2, 3, 0.95, 0.99, 0.999, 0.99, 0.05, 1000, 0, 0, 1, 0])))
    (tmp_path / "AB_charData.csv").write_text("a,b,c,d,e,f\n0,0.5,-51,-40,2,3\n0.5,1,-40,-20,x,1\n")
    p = files.to_params(files.read_params(spark, str(tmp_path / "*_charParams.csv")).first())
    assert p.zone_div == (-51.0, 5500.0, 7500.0) and p.method == 4 and p.thresh_values == (0.95, 0.99, 0.999, 0.99) and p.peak_freq_yr == 1000
    rows = files.read_samples(spark, str(tmp_path / "*_charData.csv")).orderBy("sample_no").collect()
    assert [(r.site, r.sample_no, r.age_top, r.vol) for r in rows] == [("AB", 1, -51.0, 2.0), ("AB", 2, -40.0, None)]
    table = Study(series(spark), P).results
    files.write_results(table, str(tmp_path / "out"))
    back = {r.i: r for r in files.read_results(spark, str(tmp_path / "out")).collect()}
    for r in table.collect():
        for c in ("age_top_i", "acc_i", "bkg", "thresh_pos", "peaks_final"):
            a, b = r[c], back[r.i][c]
            assert (a is None) == (b is None) and (a is None or abs(a - b) <= 1e-6 * max(1, abs(a)))


def test_own_intervals_give_what_given_ones_do(spark):
    one, two = series(spark, 121, 10.0, cnt=lambda i: float(i * i % 23)), series(spark, 121, 15.0, cnt=lambda i: float(i * i % 19)).withColumn("site", F.lit("u"))
    p = replace(P, zone_div=(0.0, 1200.0, 1800.0), smooth_yr=300.0, peak_freq_yr=200.0)
    shape = lambda df: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect())
    keep = lambda df: df.select("site", "i", "age", "bkg", "pos4", "neg4", "sni", "gof", "t", "is_peak", "insig")

    def all_of(raw, p):
        s = Study(raw, p)
        at = s.peaks.join(s.thresholds.select("site", "run_id", "i", "bkg", "pos4", "neg4", "sni", "gof"), ["site", "run_id", "i"])
        freq = history.smooth_frequency(history.frequency(s.final, p), p)
        return keep(at), freq.select("site", "i", "freq", "sm_freq"), s.results.select("site", "i", "peaks_final", "peak_mag", "sm_peak_freq")

    got = [shape(df) for df in all_of(one.unionByName(two), replace(p, yr_interp=0.0))]
    want = [shape(a) + shape(b) for a, b in zip(all_of(one, p), all_of(two, replace(p, yr_interp=15.0)))]
    assert got == [sorted(w) for w in want]


def test_windows_with_few_values_off_neutral_are_not_tested(spark):
    peak = [0.0] * 30
    peak[10:13] = [2.0, -1.0, 3.0]
    df = spark.createDataFrame([("s", "r", i, v) for i, v in enumerate(peak, 1)], "site string, run_id string, i int, peak double")
    got = {r.i: r.gof for r in threshold.local_gof(threshold.with_thresholds(threshold.local_noise(df, P, 8), P), P, 8).collect()}
    assert set(got.values()) == {None}
    peak[13] = -2.0
    df = spark.createDataFrame([("s", "r", i, v) for i, v in enumerate(peak, 1)], "site string, run_id string, i int, peak double")
    got = {r.i: r.gof for r in threshold.local_gof(threshold.with_thresholds(threshold.local_noise(df, P, 8), P), P, 8).collect()}
    assert got[12] is not None and got[30] is None


def test_a_row_without_sni_keeps_its_thresholds(spark):
    rows = [("s", "r", i, 10.0, 30, None if i == 15 else 1.0 + i % 3, 9.0 if i == 15 else 1.0) for i in range(1, 31)]
    df = spark.createDataFrame(rows, "site string, run_id string, i int, yr double, n int, sni double, pos1 double")
    for c in ("pos2", "pos3", "pos4", "neg1", "neg2", "neg3", "neg4"):
        df = df.withColumn(c, F.col("pos1"))
    got = {r.i: r for r in threshold.smooth_thresholds(df, P).collect()}
    alone = {r.i: r.f for r in smooth.lowess(df, "pos1", "f", F.lit(10), 10).collect()}
    assert got[15].sni is None and all(abs(got[i].pos1 - alone[i]) < 1e-9 and got[i].pos1 == got[i].neg4 for i in got)
    assert got[15].pos1 > 1.2
