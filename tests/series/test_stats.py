import numpy as np

from varve.functions import stats


def test_weibull_recovers_its_parameters():
    rng = np.random.default_rng(1)
    b, c = stats.weibull_mle(120 * rng.weibull(1.7, 20_000))
    assert abs(b - 120) < 2 and abs(c - 1.7) < 0.05
    assert stats.weibull_mle([3, 3, 3]) is None


def test_mixture_recovers_two_normals():
    rng = np.random.default_rng(2)
    x = rng.permutation(np.concatenate([rng.normal(0, 1, 700), rng.normal(8, 1, 300)]))
    fit = stats.mixture_em(x)
    assert abs(fit["mu"][0]) < 0.2 and abs(fit["mu"][1] - 8) < 0.2 and abs(fit["prop"][0] - 0.7) < 0.03 and fit["converged"]
    assert stats.mixture_em([1.0, 1.0, 1.0]) is None
    assert len(stats.mixture_mdl(x, 3)["mu"]) == 2
    assert (stats.mixture_classes(np.array([0.0, 8.0]), fit) == [0, 1]).all()
    assert np.isfinite(stats.mixture_loglik(x, fit)).all()


def test_kolmogorov_smirnov():
    # Known values: exact P(D_10 > 0.409) is near 0.05, the limit's 1.358 too.
    assert abs(stats.ks_exact(0.40925, 10) - 0.05) < 1e-3
    assert abs(stats.ks_asymptotic(1.3581, 1) - 0.05) < 1e-3
    d, p = stats.ks_two_sample(np.arange(50.0), np.arange(50.0))
    assert d == 0 and p == 1
    assert abs(stats.normal_cdf(np.array([1.959964]))[0] - 0.975) < 1e-6 and abs(stats.z_of(0.975) - 1.959964) < 1e-6


def test_rank_sum_and_anderson_darling():
    x, y = np.arange(20.0), np.arange(20.0) + 30
    assert stats.rank_sum_p(x, y) < 1e-5 and abs(stats.rank_sum_p(x, x) - 1) < 1e-9
    assert stats.anderson_darling_k([x, y]) > stats.anderson_darling_k([x, x + 0.5])
