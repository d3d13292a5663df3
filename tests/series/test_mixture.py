import math
import random
from dataclasses import replace

import numpy as np
import pytest
from test_runs import P, cores

from varve import queries
from varve.functions import stats
from varve.operators import mixture, threshold
from varve.plans.study import Study

KEYS = ("site", "run_id")


def frame(spark, series):
    rows = [(s, "r", i, None if v is None else float(v)) for s, vs in series.items() for i, v in enumerate(vs)]
    random.Random(3).shuffle(rows)
    return spark.createDataFrame(rows, "site string, run_id string, i int, peak double").repartition(3)


def normals(seed, *parts):
    r = random.Random(seed)
    out = [r.gauss(m, s) for m, s, n in parts for _ in range(n)]
    r.shuffle(out)
    return out


SERIES = {
    "two": normals(1, (0, 1, 150), (6, 2, 60)), "one": normals(2, (3, 1, 120)), "three": normals(3, (-5, 1, 60), (0, 0.5, 60), (7, 1, 60)),
    "copies": [1.0, 1.0, 1.0, 4.0, 4.0, 9.0], "pair": [0.0, 5.0], "flat": [0.1] * 7, "single": [2.0], "null": [None, None], "holes": [None, 3.0, None, *normals(4, (0, 1, 40), (9, 1, 20)), None],
    "same": [2.0, *normals(5, (0, 1, 60), (6, 1, 30)), 2.0],
}


def held(series):
    return np.array([v for v in series if v is not None], float)


def close(got, want):
    return len(got) == len(want) and all(math.isclose(a, b, rel_tol=1e-7, abs_tol=1e-9) for a, b in zip(got, want))


@pytest.mark.parametrize("k", [2, 3])
def test_rounds_as_aggregates_equal_numpy(spark, k):
    x = mixture.values(frame(spark, SERIES)).cache()
    got = {r.site: r for r in mixture.fit(x, k).collect()}
    want = {s: stats.mixture_em(held(v), k) for s, v in SERIES.items()}
    assert got.keys() == {s for s, f in want.items() if f}
    for s, r in got.items():
        assert close(r.mu, want[s]["mu"]) and close(r.sigma, want[s]["sigma"]) and close(r.prop, want[s]["prop"]) and close([r.loglik], [want[s]["loglik"]]), s
    assert mixture.fit(x.limit(0), k).count() == 0


def test_rounds_end(spark):
    x = mixture.values(frame(spark, {"two": SERIES["two"]}))
    for most in (1, 3):
        got, want = mixture.fit(x, 2, max_rounds=most).first(), stats.mixture_em(held(SERIES["two"]), 2, most)
        assert got.rounds == most and close(got.mu, want["mu"]) and not want["converged"]


@pytest.mark.parametrize("final_k", [0, 2])
def test_reduced_orders_equal_numpy(spark, final_k):
    some = {s: SERIES[s] for s in ("two", "one", "three", "same", "pair")}
    got = {r.site: r for r in mixture.reduced(mixture.values(frame(spark, some)), 3, final_k).collect()}
    assert got.keys() == some.keys() - {"pair"}
    for s, r in got.items():
        want = stats.mixture_mdl(held(some[s]), 3, final_k)
        assert r.k == len(want["mu"]) and close(r.mu, want["mu"]) and close(r.sigma, want["sigma"]) and close([r.description], [want["mdl"]]), s
    if not final_k:
        assert (got["one"].k, got["three"].k) == (1, 3)


def test_merges_worked_by_hand(spark):
    # Equal shares at 0, 1 and 10 with variance 1: 0 and 1 merge to 0.5 with variance 1 + 1/4.
    row = ("s", "r", 30, 0.0, 0.0, 1.0, 10.0, 1.0, 1.0, 1.0, 1 / 3, 1 / 3, 1 / 3, "rests")
    models = spark.createDataFrame([row], "site string, run_id string, n long, least double, m1 double, m2 double, m3 double, v1 double, v2 double, v3 double, s1 double, s2 double, s3 double, state string")
    r = mixture.merge_closest(models, 3).first()
    assert close([r.m1, r.m2, r.v1, r.v2, r.s1, r.s2], [0.5, 10, 1.25, 1, 2 / 3, 1 / 3]) and r.state == "moves"
    # The later pair: 10 and 9 merge in the place of the first of them.
    r = mixture.merge_closest(models.replace(1.0, 9.0, subset=["m2"]), 3).first()
    assert close([r.m1, r.m2, r.v1, r.v2, r.s1, r.s2], [0, 9.5, 1, 1.25, 1 / 3, 2 / 3])
    f = stats.merge_closest({"mu": np.array([0.0, 1.0, 10.0]), "sigma": np.ones(3), "prop": np.ones(3) / 3})
    assert close(f["mu"], [0.5, 10]) and close(f["sigma"], [math.sqrt(1.25), 1]) and close(f["prop"], [2 / 3, 1 / 3])


@pytest.mark.parametrize("merge", [False, True])
def test_noise_of_whole_series_is_that_of_one(spark, merge):
    p = replace(P, merge=merge)
    got = {r.site: r for r in threshold.mixture_noise(frame(spark, SERIES), p).collect()}
    assert got.keys() == SERIES.keys()
    for s, r in got.items():
        mu, sigma, share, fitted = threshold.noise_of(held(SERIES[s]), 0.0, merge)
        assert r.fitted == fitted and close([r.mu, r.prop], [mu, share]), s
        assert r.sigma is None if math.isnan(sigma) else close([r.sigma], [sigma]), s
    two = stats.mixture_em(held(SERIES["same"]), 2)
    assert two["mu"][0] == two["mu"][1] and got["same"].mu < two["mu"][0]


def test_merging_reaches_the_thresholds(spark):
    same = frame(spark, {"same": SERIES["same"]}).selectExpr("*", "cast(i as double) AS age", "1.0D AS yr", f"{len(SERIES['same'])} AS n")
    pos = [threshold.global_thresholds(same, replace(P, thresh_type=1, thresh_method=3, merge=m)).first() for m in (False, True)]
    assert pos[0].mu != pos[1].mu


def test_classes_and_likelihoods(spark):
    x = mixture.values(frame(spark, {s: SERIES[s] for s in ("two", "holes", "flat")})).cache()
    rows = mixture.classes(x, mixture.fit(x)).collect()
    assert {r.site for r in rows} == {"two", "holes"}
    for s in ("two", "holes"):
        fit, mine = stats.mixture_em(held(SERIES[s])), sorted((r for r in rows if r.site == s), key=lambda r: r.i)
        v = np.array([r.x for r in mine])
        assert close([r.loglik for r in mine], stats.mixture_loglik(v, fit)) and [r["class"] - 1 for r in mine] == list(stats.mixture_classes(v, fit))


def test_a_study_by_mixtures(spark):
    s = Study(cores(spark), replace(P, thresh_type=1, thresh_method=3), gof=False)
    assert s.peaks.where("is_peak").count() > 0


def test_thresholds_by_mixtures_read_one_written_series(spark, sf_small):
    """The rounds write the peak series; nothing behind them works it out anew from the samples."""
    found = queries.study(spark, sf_small, queries.MIXED).thresholds
    assert found.inputFiles() and not any("events" in f for f in found.inputFiles())
