"""Kernels against closed forms and small known cases."""

import math

import numpy as np
import pytest

from lexarium.functions import numeric as N


def test_distributions():
    assert N.chi2_p(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert N.t_p(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-9)
    assert N.t_p(1.0, 1) == pytest.approx(0.5, abs=1e-12)
    assert N.beta_inc(2, 3, 0.4) == pytest.approx(0.5248, abs=1e-9)


def test_mann_whitney():
    u, p = N.mann_whitney(np.array([1.0, 2, 3]), np.array([4.0, 5, 6]))
    assert u == 0 and p == pytest.approx(0.1)
    assert N.mann_whitney(np.ones(5), np.ones(5))[1] == 1.0


def test_text_kernels():
    assert N.mtld([]) == 0 and N.mtld(list("абв")) == 3
    assert N.phrases("") == 0 and N.phrases("ааа") == 2
    raw, packed, ratio = N.compression("а" * 1000)
    assert raw == 2000 and packed < 100 and ratio == packed / raw


def test_hurst_of_noise():
    h, r2, kind = N.dfa(np.random.default_rng(42).integers(1, 10, 1000).astype(float))
    assert 0.4 < h < 0.6 and kind == "random" and r2 > 0.9
    assert N.dfa(np.arange(5.0)) == (0.5, 0.0, "insufficient_data")


def test_resampling_is_reproducible():
    a, b = np.arange(10.0), np.arange(10.0) + 3
    assert N.permutation_p(a, b, 500) == N.permutation_p(a, b, 500)
    assert N.bootstrap_entropy(np.array([10, 10, 10, 10]))[0] == pytest.approx(2, abs=0.1)
    assert N.bootstrap_entropy(np.zeros(4, int)) == (0, 0, 0, 0)
    with pytest.raises(ValueError):
        N.bootstrap_entropy(np.array([1, 2]), 10)


def test_fits():
    y = np.round(1e6 / (np.arange(1, 200) + 2.0) ** 1.1)
    a, b, _, r2, gain = N.zipf_mandelbrot(y)
    assert gain > 0 and N.zipf_mandelbrot(np.full(9, 4.0))[4] == 0
    assert a == pytest.approx(1.1, abs=0.02) and b == pytest.approx(2, abs=0.1) and r2 > 0.999
    k, _ = N.weibull_shape(np.random.default_rng(1).weibull(1.5, 4000) * 10)
    assert k == pytest.approx(1.5, abs=0.06) and math.isinf(N.weibull_shape(np.ones(5))[0])


def test_fits_together_are_those_alone():
    rng = np.random.default_rng(3)
    many = [rng.zipf(1.3, int(n)).clip(0, 5000) for n in [0, 2, 5, 5, 40, 40, 40, 301, 301, 900, 900] * 3]
    assert N.zipf_mandelbrots(many, together=4) == [N.zipf_mandelbrot(c) for c in many]
    assert N.zipf_mandelbrots([]) == []
