"""The release mechanisms: the only ways by which data leaves a private frame.

Every release charges the agent first, then runs ONE Spark job that returns a
bounded number of rows, then adds noise on the driver. Order statistics take a few:
their gaps are computed once and kept, and small sums of them are read. A failing
job keeps the charge and tells nothing about the data.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.functions.scalars import clamp
from veilframe.plans.agents import Agent, PrivacyDenied
from veilframe.plans.noise import NoiseSource
from veilframe.sources.storage import pinned

TAIL = 2**31 - 1  # the range of the gap behind the last value


class ReleaseFailed(RuntimeError):
    """The job failed. The reason is withheld: which record broke it would be a leak."""


def charge(agent: Agent, eps: float) -> None:
    if not agent.apply(eps):
        raise PrivacyDenied("the privacy budget does not cover this release")


def collect_bounded(df: DataFrame) -> list:
    """Rows of a result whose size does not depend on the data."""
    try:
        return df.collect()
    except Exception:
        raise ReleaseFailed("the release failed; its charge stays") from None


def average_of(noise: NoiseSource, eps: float, tally: float, n: int) -> float:
    """A noisy mean of ``n`` values in [-1, 1], itself in [-1, 1]."""
    if n == 0:
        return noise.uniform(-1.0, 1.0)
    return noise.truncated_laplace(tally / n, 2.0 / (eps * n), -1.0, 1.0)


def sum_column(value: Column) -> Column:
    return F.coalesce(F.sum(clamp(value, -1.0, 1.0)), F.lit(0.0))


def gap_table(df: DataFrame, value: Column) -> DataFrame:
    """The gaps between the sorted values of ``value`` held in [0, 1]: (bucket, lo, hi, below).

    ``below`` counts the rows strictly below the gap's upper end. Values are
    grouped first, with map-side sums, and the distinct ones are dealt to ranges
    of about as many each, however crowded they lie. They are kept, so that all
    that follows sees the same ranges. Ranks and predecessors are found inside
    the ranges in parallel, and carried over from range to range in a summary of
    one row each.
    """
    counted = df.select(clamp(value, 0.0, 1.0).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("m"))
    values = pinned(counted.repartitionByRange("v").withColumn("bucket", F.spark_partition_id()))
    inside = Window.partitionBy("bucket").orderBy("v")
    ranked = values.select(
        "bucket",
        "v",
        F.lag("v").over(inside).alias("prev"),
        F.coalesce(F.sum("m").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
    )
    across = Window.orderBy("bucket")
    summary = (
        values.groupBy("bucket")
        .agg(F.sum("m").alias("rows"), F.max("v").alias("last"))
        .select(
            "bucket",
            F.coalesce(F.lag("last").over(across), F.lit(0.0)).alias("carry"),
            F.coalesce(F.sum("rows").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"),
        )
    )
    gaps = ranked.join(F.broadcast(summary), "bucket").select(
        "bucket",
        F.coalesce("prev", "carry").alias("lo"),
        F.col("v").alias("hi"),
        (F.col("base") + F.col("before")).alias("below"),
    )
    tail = values.agg(
        F.lit(TAIL).alias("bucket"),
        F.coalesce(F.max("v"), F.lit(0.0)).alias("lo"),
        F.lit(1.0).alias("hi"),
        F.coalesce(F.sum("m"), F.lit(0)).alias("below"),
    )
    return gaps.unionByName(tail).filter(F.col("hi") > F.col("lo"))


def order_statistic(df: DataFrame, value: Column, eps: float, fraction: float, noise: NoiseSource) -> float:
    """Draw a point of [0, 1] with density proportional to exp(-eps * |fraction * n - rank|).

    Log weights keep distant gaps from underflowing. The gap is drawn by its
    cumulative weight: first its range, from one sum each, then within the
    range, so that no per-gap randomness is needed. The rank behind the last gap
    is the number of rows.
    """
    try:
        gaps = pinned(gap_table(df, value))
    except Exception:
        raise ReleaseFailed("the release failed; its charge stays") from None
    total = collect_bounded(gaps.agg(F.max(F.when(F.col("bucket") == TAIL, F.col("below"))).alias("n")))[0]["n"]
    if total is None:  # the last value is 1, so there is no gap behind it
        total = collect_bounded(df.agg(F.count(F.lit(1)).alias("n")))[0]["n"]
    weight = F.ln(F.col("hi") - F.col("lo")) - eps * F.abs(F.lit(total) * fraction - F.col("below"))
    weighted = gaps.select("bucket", "lo", "hi", weight.alias("lw"))
    top = collect_bounded(weighted.agg(F.max("lw").alias("top")))[0]["top"]
    sums = weighted.groupBy("bucket").agg(F.sum(F.exp(F.col("lw") - F.lit(top))).alias("mass"))
    rows = sorted(collect_bounded(sums), key=lambda r: r["bucket"])
    masses = [r["mass"] for r in rows]
    target = noise.unit() * math.fsum(masses)
    chosen, before = len(rows) - 1, math.fsum(masses[:-1])
    run = 0.0
    for i, mass in enumerate(masses):
        if run + mass > target:
            chosen, before = i, run
            break
        run += mass
    window = Window.partitionBy("bucket").orderBy("lo").rowsBetween(Window.unboundedPreceding, 0)
    inside = weighted.filter(F.col("bucket") == rows[chosen]["bucket"])
    inside = inside.withColumn("mass", F.sum(F.exp(F.col("lw") - F.lit(top))).over(window))
    hit = inside.filter(F.col("mass") > F.lit(target - before)).orderBy("lo").limit(1)
    gap = collect_bounded(hit) or collect_bounded(inside.orderBy(F.col("lo").desc()).limit(1))
    return gap[0]["lo"] + (gap[0]["hi"] - gap[0]["lo"]) * noise.unit()


def best_of(scores: Sequence[float], eps: float, noise: NoiseSource) -> int:
    """Index of the largest noisy score; the last of equal ones."""
    if not scores:
        raise ValueError("there is no candidate")
    noisy = [s + noise.laplace(1.0 / eps) for s in scores]
    best = 0
    for i, value in enumerate(noisy):
        if value >= noisy[best]:
            best = i
    return best


def candidate_scores(df: DataFrame, candidates: Sequence, score, name: str = "candidate") -> list[float]:
    """The sum of clamped scores of every candidate, all in one pass over the rows."""
    sums = [
        F.coalesce(F.sum(clamp(score(F.lit(c)), 0.0, 1.0)), F.lit(0.0)).alias(f"s{i}")
        for i, c in enumerate(candidates)
    ]
    row = collect_bounded(df.agg(*sums))[0]
    return [row[f"s{i}"] for i in range(len(candidates))]
