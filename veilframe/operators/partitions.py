"""Partition: disjoint parts whose releases together cost as much as the dearest part."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import PySparkTypeError, PySparkValueError
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.operators import release
from veilframe.operators.frame import Keys, PrivateFrame, key_columns
from veilframe.plans.agents import PartitionAgent, PartitionLedger, check_epsilon

BROADCAST_KEYS = 1_000_000  # listed keys up to which every executor gets them all


class PrivatePartitions:
    """A key-indexed view of ONE keyed DataFrame.

    Keys come from the caller, never from the data, so that which keys exist
    tells nothing. ``parts[key]`` is a frame of its own; the batched releases
    serve all parts with a single job. With several key columns, keys are tuples.
    """

    def __init__(self, frame: PrivateFrame, keys: Sequence, by: Keys):
        self.keys = list(dict.fromkeys(keys))
        self._frame, self._by = frame, key_columns(by)
        self._names = [f"__p{i}" for i in range(len(self._by))]
        self._keyed = frame._guard.select(frame._df, ["*", *[c.alias(n) for c, n in zip(self._by, self._names, strict=True)]])
        self._ledger = PartitionLedger(frame._agent, self.keys)

    def _parts(self, key) -> tuple:
        return key if len(self._names) > 1 else (key,)

    def __len__(self) -> int:
        return len(self.keys)

    def __iter__(self):
        return iter(self.keys)

    def __getitem__(self, key) -> PrivateFrame:
        if key not in self._ledger.spent:
            raise KeyError(key)
        match = F.lit(True)
        for name, value in zip(self._names, self._parts(key), strict=True):
            match = match & F.col(name).eqNullSafe(F.lit(value))
        rows = self._keyed.filter(match).drop(*self._names)
        return self._frame._derive(rows, PartitionAgent(self._ledger, key))

    def _charge_all(self, eps: float) -> None:
        if not self._ledger.settle_all(eps):
            raise release.PrivacyDenied("the privacy budget does not cover this release")

    def _listed(self) -> DataFrame:
        """(__key, __k0, ...): the listed keys by number, as the types of the columns they are compared with."""
        spark = self._frame._df.sparkSession
        columns = list(zip(*[self._parts(k) for k in self.keys], strict=True))
        kinds = [self._keyed.schema[n].dataType for n in self._names]
        try:
            rows = spark.createDataFrame(list(zip(range(len(self.keys)), *columns, strict=True)), ["__key", *[f"__k{i}" for i in range(len(kinds))]])
        except (PySparkTypeError, PySparkValueError):  # keys of several Python types, or none but nulls, have no type of their own
            text = [[None if v is None else str(v) for v in column] for column in columns]
            schema = T.StructType([T.StructField("__key", T.LongType()), *[T.StructField(f"__k{i}", T.StringType()) for i in range(len(kinds))]])
            rows = spark.createDataFrame(list(zip(range(len(self.keys)), *text, strict=True)), schema)
        return rows.select("__key", *[F.col(f"__k{i}").cast(kind).alias(f"__k{i}") for i, kind in enumerate(kinds)])

    def _grid(self, *aggs: Column) -> dict:
        """Aggregates by listed key, from one job.

        Rows meet their key in a join with the table of keys, so the plan has the
        same size for any number of them, and only as many rows come back. The
        table comes from the driver and is broadcast while it is small enough.
        """
        if not self.keys:
            return {}
        keys = self._listed()
        if len(self.keys) <= BROADCAST_KEYS:
            keys = F.broadcast(keys)
        match = [F.col(n).eqNullSafe(F.col(f"__k{i}")) for i, n in enumerate(self._names)]
        rows = release.collect_bounded(self._keyed.join(keys, match).groupBy("__key").agg(*aggs))
        found = {r["__key"]: r for r in rows}
        return {key: found.get(i) for i, key in enumerate(self.keys)}

    def noisy_counts(self, eps: float) -> dict:
        eps = check_epsilon(eps)
        self._charge_all(eps)
        grid = self._grid(F.count(F.lit(1)).alias("n"))
        return {k: (r["n"] if r else 0) + self._frame._noise.laplace(1.0 / eps) for k, r in grid.items()}

    def _tallies(self, values: Sequence[Column]) -> dict:
        self._frame._guard.select(self._frame._df, [v.alias(f"v{i}") for i, v in enumerate(values)])
        sums = [release.sum_column(v).alias(f"s{i}") for i, v in enumerate(values)]
        grid = self._grid(*sums, F.count(F.lit(1)).alias("n"))
        return {k: ([r[f"s{i}"] for i in range(len(values))], r["n"]) if r else ([0.0] * len(values), 0) for k, r in grid.items()}

    def noisy_sums(self, eps: float, values: Sequence[Column]) -> dict:
        eps = check_epsilon(eps)
        self._charge_all(eps * len(values))
        tallies = self._tallies(values)
        return {k: [s + self._frame._noise.laplace(1.0 / eps) for s in sums] for k, (sums, _) in tallies.items()}

    def noisy_averages(self, eps: float, values: Sequence[Column]) -> dict:
        eps = check_epsilon(eps)
        self._charge_all(eps * len(values))
        tallies = self._tallies(values)
        return {k: [release.average_of(self._frame._noise, eps, s, n) for s in sums] for k, (sums, n) in tallies.items()}
