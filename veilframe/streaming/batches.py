"""Private counts over a stream, one release per window of a public grid.

Windows are disjoint, so releases of different windows compose in parallel: all
of them together cost one epsilon. The grid comes from the caller, and a window
without rows is released like any other, so that which windows have rows tells
nothing. A window is released once, when a later one shows that the watermark has
passed it.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.operators.release import charge, collect_bounded
from veilframe.plans.agents import Agent, check_epsilon
from veilframe.plans.noise import NoiseSource

LEDGER = "batch long, start timestamp, noisy double"
LAST = -1  # the batch of what :meth:`WindowReleaser.finish` releases


def windowed_counts(stream: DataFrame, time: str, window: str, watermark: str) -> DataFrame:
    """Counts per closed tumbling window (append mode emits each window once)."""
    return (
        stream.withWatermark(time, watermark)
        .groupBy(F.window(time, window).alias("window"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("start"), "n")
    )


class WindowReleaser:
    """A ``foreachBatch`` function that pays for and releases closed windows.

    The raw counts never leave it: ``sink`` gets (start, noisy count) of every
    window from ``first`` on, ``width`` apart, in order. Windows before ``first``
    or off the grid are dropped. With a ``folder`` that the cluster shares, each
    batch's releases are written there before the sink gets them: a batch that is
    delivered again, to this object or to one that took its place after a
    restart, gives the same values and neither draws nor pays again.
    """

    def __init__(
        self,
        agent: Agent,
        eps: float,
        sink: Callable[[datetime, float], None],
        first: datetime,
        width: timedelta,
        folder: str | None = None,
        noise: NoiseSource | None = None,
    ):
        if width <= timedelta(0):
            raise ValueError("a window must have a positive width")
        self._agent, self._eps, self._sink = agent, check_epsilon(eps), sink
        self._next, self._width, self._folder = first, width, folder
        self._noise = noise or NoiseSource()
        self._paid = False
        self._done: dict[int, list[tuple[datetime, float]]] | None = None if folder else {}

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if self._again(spark, batch_id):
            return
        counts = {r["start"]: r["n"] for r in collect_bounded(batch)}
        self._release(spark, batch_id, counts, max(counts, default=self._next - self._width) + self._width)

    def finish(self, spark: SparkSession, until: datetime) -> None:
        """Release what is left of the grid before ``until``, a public time that the watermark has passed."""
        if not self._again(spark, LAST):
            self._release(spark, LAST, {}, until)

    def _again(self, spark: SparkSession, batch_id: int) -> bool:
        if self._done is None:
            self._restore(spark)
        if batch_id not in self._done:
            return False
        for start, value in self._done[batch_id]:
            self._sink(start, value)
        return True

    def _restore(self, spark: SparkSession) -> None:
        self._done = {}
        try:
            rows = spark.read.schema(LEDGER).parquet(self._folder).collect()  # one small row per window
        except AnalysisException:  # nothing has been released yet
            return
        for row in sorted(rows, key=lambda r: r["start"]):
            self._done.setdefault(row["batch"], []).append((row["start"], row["noisy"]))
            self._next = max(self._next, row["start"] + self._width)
        if rows:
            charge(self._agent, self._eps)
            self._paid = True

    def _release(self, spark: SparkSession, batch_id: int, counts: dict, until: datetime) -> None:
        starts, following = [], self._next
        while following < until:
            starts.append(following)
            following += self._width
        if not starts:
            return
        if not self._paid:
            charge(self._agent, self._eps)
            self._paid = True
        out = [(s, counts.get(s, 0) + self._noise.laplace(1.0 / self._eps)) for s in starts]
        if self._folder:
            rows = [(batch_id, s, v) for s, v in out]
            spark.createDataFrame(rows, LEDGER).coalesce(1).drop("batch").write.mode("overwrite").parquet(f"{self._folder}/batch={batch_id}")
        self._next, self._done[batch_id] = following, out
        for start, value in out:
            self._sink(start, value)
