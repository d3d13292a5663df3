import os

import pytest
from pyspark.sql import functions as F
from test_runs import P, Q

from varve.operators import peaks, validate
from varve.params import Params, as_table
from varve.plans.study import Runs
from varve.sources import files

HEAD = "Stage,Variable,Parameters,Units,Description"


def params_file(values):
    return "\n".join([HEAD] + [f'a,b,{v},yr,"some, text"' for v in values]) + "\n"


SLOTS = [0, 900, 2400, -9999, -9999, -9999, -9999, -9999, 20, 0, 1, 600, 1, 2, 2, 0.95, 0.99, 0.999, 0.99, 0.05, 500, 0, 0, 1, 1]


def test_table_rules_are_those_of_single_sets(spark):
    wrong = Params(zone_div=(0.0,), yr_interp=-1.0, method=6, thresh_type=3, thresh_method=4, c_peak=3, min_count_p=1.5, peak_freq_yr=0.0, run_id="w")
    sets = [("a", P), ("a", Q), ("b", wrong), ("c", Params(**{**P.__dict__, "zone_div": (5.0, 5.0, 1.0)})), ("d", Params(**{**P.__dict__, "thresh_method": 1, "thresh_values": (1.0, 2.0, 3.0, 4.0), "smooth_yr": 30.0}))]
    got = {}
    for r in validate.table_violations(as_table(spark, sets)).collect():
        got.setdefault((r.site, r.run_id), []).append(r.rule_no)
    assert {k: sorted(v) for k, v in got.items()} == {(s, p.run_id): sorted(validate.parameter_violations(p)) for s, p in sets if validate.parameter_violations(p)}
    assert [r.rule_no for r in validate.table_violations(as_table(spark, [("a", P), ("a", P)])).collect() if r.severity == "error"] == [23]
    assert validate.table_violations(as_table(spark, [])).count() == 0


def test_folder_with_two_sites_and_lone_files(spark, tmp_path):
    for site, slots in (("A", SLOTS), ("B c", [*SLOTS[:8], 30, *SLOTS[9:]]), ("no data", SLOTS)):
        (tmp_path / f"{site}_charParams.csv").write_text(params_file(slots))
    samples = "cmTop,cmBot,ageTop,ageBot,vol,count\n" + "".join(f"{k / 2},{(k + 1) / 2},{10 * k},{10 * k + 10},{2 + k % 3},{(k * 37) % 11 + (25 if k % 30 < 2 else 0)}\n" for k in range(240))
    for site in ("A", "B c", "no params"):
        (tmp_path / f"{site}_charData.csv").write_text(samples)
    found = files.discover(spark, str(tmp_path))
    assert {tuple(r) for r in found.collect()} == {("A", True, True), ("B c", True, True), ("no data", True, False), ("no params", False, True)}
    assert {(r.site, r.rule_no) for r in files.lone_files(found).collect()} == {("no data", 24), ("no params", 25)}
    table = files.runs(spark, f"{tmp_path}/*_charParams.csv")
    assert validate.table_violations(table).where("severity = 'error'").count() == 0
    rows = Runs(files.read_samples(spark, f"{tmp_path}/*_charData.csv"), table, gof=False).union(lambda s: s.thresholds)
    assert {r.site: r.k for r in rows.groupBy("site").agg(F.count("*").alias("k")).collect()} == {"A": 121, "B c": 81}


@pytest.mark.skipif("SERIES_DATA_DIR" not in os.environ, reason="opt-in: a folder of parameter, sample and result files")
def test_files_in_place(spark):
    """Every site of a folder in one plan, by its own parameters (mixtures too). Where a result
    file lies beside, the resampled columns agree, and the peaks are about as many."""
    folder = os.environ["SERIES_DATA_DIR"]
    table = files.runs(spark, f"{folder}/*_charParams.csv")
    assert validate.table_violations(table).where("severity = 'error' and site not like 'template%'").count() == 0
    runs = Runs(files.read_samples(spark, f"{folder}/*_charData.csv"), table, gof=False)
    found = runs.union(lambda s: peaks.identify(s.thresholds, s.p, ("cm", "con", "acc")))
    ours = {(r.site, r.i): r for r in found.where("t = 4").collect()}
    whole = found.where("t = 4").groupBy("site").agg(F.count_if("is_peak").alias("n"), F.count("*").alias("rows")).collect()
    print(sorted(tuple(r) for r in whole))
    assert whole and all(10 <= r.n <= 200 for r in whole)
    near = lambda a, b: (a is None) == (b is None) and (a is None or abs(a - b) <= 1e-4 * max(1.0, abs(b)))
    for name in sorted(n for n in os.listdir(folder) if n.endswith("_charResults.csv")):
        site = name.removesuffix("_charResults.csv")
        golden = files.read_results(spark, f"{folder}/{name}").orderBy("i").collect()
        assert len(golden) == sum(1 for s, _ in ours if s == site)
        for g in golden:
            o = ours[site, g.i]
            assert all(near(a, b) for a, b in ((o.cm, g.cm_top_i), (o.age, g.age_top_i), (o.cnt, g.count_i), (o.vol, g.vol_i), (o.con, g.con_i), (o.acc, g.acc_i))), g
        assert abs(sum(o.is_peak for (s, _), o in ours.items() if s == site) - sum(g.peaks_final for g in golden)) <= 3
