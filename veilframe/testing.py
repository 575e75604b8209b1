"""For tests and oracles only: nothing here is private."""

from __future__ import annotations

from pyspark.sql import DataFrame

from veilframe.operators.frame import PrivateFrame
from veilframe.plans.noise import NoiseSource


class FixedUniform(NoiseSource):
    """Every uniform draw is ``u``, and every Laplace draw is +ln(2) times its scale."""

    def __init__(self, u: float = 0.75):
        super().__init__()
        self.u = u

    def unit(self) -> float:
        return self.u

    def laplace(self, scale: float) -> float:
        return scale * 0.6931471805599453


def reveal(frame: PrivateFrame) -> DataFrame:
    """The rows of a private frame. Unsafe by design."""
    return frame._df
