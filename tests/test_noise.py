"""Distributions of the draws, by Kolmogorov-Smirnov distance on ten thousand of them."""

import math
import random

import pytest

from veilframe.operators.release import average_of, best_of
from veilframe.plans.noise import NoiseSource

N = 10_000
LIMIT = 1.95 / math.sqrt(N)  # passed by a right sampler but for one in a thousand


def distance(draws, cdf):
    draws = sorted(draws)
    return max(max(abs((i + 1) / N - cdf(x)), abs(i / N - cdf(x))) for i, x in enumerate(draws))


def laplace_cdf(x, mu=0.0, b=1.0):
    z = (x - mu) / b
    return 0.5 * math.exp(z) if z < 0 else 1 - 0.5 * math.exp(-z)


def test_laplace():
    noise = NoiseSource(random.Random(1))
    assert distance([noise.laplace(3.0) for _ in range(N)], lambda x: laplace_cdf(x, 0, 3.0)) < LIMIT


@pytest.mark.parametrize("mu, b", [(0.0, 0.4), (0.9, 0.2), (-1.0, 5.0)])
def test_truncated_laplace_is_laplace_given_the_interval(mu, b):
    noise = NoiseSource(random.Random(2))
    lo, hi = laplace_cdf(-1, mu, b), laplace_cdf(1, mu, b)
    draws = [noise.truncated_laplace(mu, b, -1, 1) for _ in range(N)]
    assert all(-1 <= x <= 1 for x in draws)
    assert distance(draws, lambda x: (laplace_cdf(x, mu, b) - lo) / (hi - lo)) < LIMIT


def test_average_of_no_rows_is_uniform():
    noise = NoiseSource(random.Random(3))
    assert distance([average_of(noise, 1.0, 0.0, 0) for _ in range(N)], lambda x: (x + 1) / 2) < LIMIT


def test_snapping_and_default_source():
    noise = NoiseSource(random.Random(4), snap=0.5)
    assert all((2 * noise.laplace(1.0)).is_integer() for _ in range(100))
    assert isinstance(NoiseSource()._rng, random.SystemRandom)


def test_last_of_equal_candidates_wins():
    class Fixed(NoiseSource):
        def laplace(self, scale):
            return 0.0

    assert best_of([1.0, 3.0, 3.0, 2.0], 1.0, Fixed()) == 2
    with pytest.raises(ValueError):
        best_of([], 1.0, Fixed())
