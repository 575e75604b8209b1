"""Search log to coordinates, and an adaptive noisy quadtree over them."""

from __future__ import annotations

import random
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.operators.frame import PrivateFrame
from veilframe.sources.readers import fields

KEEP_LEVELS = 6  # levels after which the points of a quadtree are kept


def search_coordinates(searches: PrivateFrame, locations: PrivateFrame, query: str) -> PrivateFrame:
    """Coordinates in [-1, 1]^2, one per /24 network that searched for ``query``.

    ``searches``: comma-separated lines (``value``) with the address first and
    the query as the 21st field; ``locations``: tab-separated (network, latitude,
    longitude). Malformed lines drop out instead of failing.
    """
    parts = searches.select(fields(F.col("value"), ",").alias("f"))
    hits = parts.where(F.lower(F.get("f", F.lit(20))) == F.lit(query.lower()))
    octets = hits.select(fields(F.get("f", F.lit(0)), ".").alias("o")).where(F.size("o") == 4)
    networks = octets.select(F.concat_ws(".", F.get("o", F.lit(0)), F.get("o", F.lit(1)), F.get("o", F.lit(2)), F.lit("0")).alias("ip"))
    places = locations.select(fields(F.col("value"), "\t").alias("f")).select(
        F.get("f", F.lit(0)).alias("ip"),
        F.get("f", F.lit(1)).try_cast("double").alias("lat"),
        F.get("f", F.lit(2)).try_cast("double").alias("lon"),
    )
    places = places.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    joined = networks.join_groups(
        places,
        "ip",
        "ip",
        [F.count(F.lit(1)).alias("searches")],
        [F.min_by(F.struct("lat", "lon"), F.struct("lat", "lon")).alias("place")],
    )
    return joined.select((F.col("place.lat") / 90.0).alias("x0"), (F.col("place.lon") / 180.0).alias("x1"))


def quadtree(points: PrivateFrame, valid: set[str] | None, depth: int, start: float | None = None) -> list[tuple[str, int]]:
    """(prefix, noisy number of points) of every leaf at ``depth`` with points.

    Level by level: ONE job gives the noisy mean sign of the split coordinate of
    all open cells together. Coordinates alternate; a cell's points are divided
    by that mean, both halves rounded half to even. A prefix outside ``valid``
    (and a cell without points) is not followed. Points are kept every few
    levels, so that no level starts from the source through all those above it.
    """
    eps0 = 1.0
    count = points.noisy_count(eps0) if start is None else start
    cells = {"": int(round(count))}
    rows = points.select(F.lit("").alias("prefix"), F.col("x0").alias("a"), F.col("x1").alias("b"))
    for level in range(depth):
        cells = {p: n for p, n in cells.items() if n > 0 and (valid is None or p in valid)}
        if not cells:
            return []
        means = rows.partition(list(cells), "prefix").noisy_averages(1.0 / (level + 1), [F.signum("a")])
        following = {}
        for prefix, n in cells.items():
            shift = means[prefix][0] * n
            following[prefix + "0"] = int(round((n - shift) / 2))
            following[prefix + "1"] = int(round((n + shift) / 2))
        cells = following
        right = F.col("a") > 0
        rescaled = F.when(right, 2 * F.col("a") - 1).otherwise(2 * F.col("a") + 1)
        rows = rows.select(
            F.concat("prefix", F.when(right, "1").otherwise("0")).alias("prefix"),
            F.col("b").alias("a"),
            rescaled.alias("b"),
        )
        if level % KEEP_LEVELS == KEEP_LEVELS - 1 and level + 1 < depth:
            rows = rows.materialize()
    return [(p, n) for p, n in sorted(cells.items()) if n > 0 and (valid is None or p in valid)]


def cell_of(prefix: str) -> tuple[float, float, float, float]:
    """(low and high x0, low and high x1) of a cell."""
    bounds = [[-1.0, 1.0], [-1.0, 1.0]]
    for i, bit in enumerate(prefix):
        lo, hi = bounds[i % 2]
        bounds[i % 2] = [(lo + hi) / 2, hi] if bit == "1" else [lo, (lo + hi) / 2]
    return (*bounds[0], *bounds[1])


def scatter(leaves: Iterable[tuple[str, int]], rng: random.Random | None = None) -> Iterable[tuple[str, float, float]]:
    """(prefix, latitude, longitude) of each noisy point, spread evenly over its cell."""
    rng = rng or random.SystemRandom()
    for prefix, n in leaves:
        lo0, hi0, lo1, hi1 = cell_of(prefix)
        for _ in range(n):
            yield prefix, 90.0 * rng.uniform(lo0, hi0), 180.0 * rng.uniform(lo1, hi1)


def leaves_frame(spark, leaves: Iterable[tuple[str, int]]) -> DataFrame:
    return spark.createDataFrame(list(leaves), "prefix string, points long")
