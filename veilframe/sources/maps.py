"""Sinks for the geo histogram: a table of points, and a self-contained HTML page."""

from __future__ import annotations

import html
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def points_frame(spark: SparkSession, points: Iterable[tuple[str, float, float]]) -> DataFrame:
    return spark.createDataFrame(list(points), "prefix string, lat double, lon double")


def points_page(points: Iterable[tuple[str, float, float]], title: str = "noisy points") -> str:
    """An HTML page that draws the points on a plain world rectangle; it loads nothing."""
    dots = "".join(
        f'<circle cx="{lon + 180:.4f}" cy="{90 - lat:.4f}" r="0.5"><title>{html.escape(prefix)}</title></circle>'
        for prefix, lat, lon in points
    )
    return (
        f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body>"
        f"<svg viewBox='0 0 360 180' width='1080' height='540' style='background:#eef'>{dots}</svg></body></html>"
    )
