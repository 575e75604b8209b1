"""Random draws of the release mechanisms, made on the driver from the system's entropy."""

from __future__ import annotations

import math
import random


class NoiseSource:
    """Draws by inverse distribution functions from one stream of uniforms.

    Doubles carry the known weakness of floating-point Laplace noise (Mironov,
    CCS 2012): ``snap`` rounds every Laplace draw to a multiple of that step.
    """

    def __init__(self, rng: random.Random | None = None, snap: float | None = None):
        self._rng = rng or random.SystemRandom()
        self.snap = snap

    def unit(self) -> float:
        """Uniform on [0, 1)."""
        return self._rng.random()

    def uniform(self, lo: float, hi: float) -> float:
        return lo + (hi - lo) * self.unit()

    def laplace(self, scale: float) -> float:
        """Laplace with scale ``scale``, so with standard deviation sqrt(2) * scale."""
        u = self.unit() - 0.5
        while u == -0.5:  # its logarithm is infinite
            u = self.unit() - 0.5
        draw = math.copysign(math.log1p(-2.0 * abs(u)), u) * scale
        return round(draw / self.snap) * self.snap if self.snap else draw

    def truncated_laplace(self, centre: float, scale: float, lo: float, hi: float) -> float:
        """Laplace around ``centre`` given that it falls in [lo, hi]: one draw, no rejection."""
        def below(x: float) -> float:
            z = (x - centre) / scale
            return 0.5 * math.exp(z) if z < 0 else 1.0 - 0.5 * math.exp(-z)

        p = self.uniform(below(lo), below(hi))
        if p < 0.5:
            x = centre + scale * math.log(max(2.0 * p, 1e-300))
        else:
            x = centre - scale * math.log(max(2.0 * (1.0 - p), 1e-300))
        return min(hi, max(lo, x))
