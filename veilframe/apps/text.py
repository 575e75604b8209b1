"""Text statistics: lines, lines that contain something, words per line."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import functions as F

from veilframe.operators.frame import PrivateFrame
from veilframe.sources.readers import words


def line_count(lines: PrivateFrame, eps: float = 1.0) -> float:
    return lines.noisy_count(eps)


def lines_with(lines: PrivateFrame, needle: str, eps: float = 1.0) -> float:
    return lines.where(F.contains(F.col("value"), F.lit(needle))).noisy_count(eps)


def words_per_line(lines: PrivateFrame, sizes: Sequence[int] = tuple(range(10)), eps: float = 0.1) -> dict:
    """Noisy number of lines with each number of space-separated parts."""
    arrays = lines.select(words("value").alias("words"))
    return arrays.partition(list(sizes), F.size("words")).noisy_counts(eps)
