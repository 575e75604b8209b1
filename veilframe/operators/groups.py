"""Grouping: one record per observed key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.functions.ranking import first_per_key
from veilframe.operators.frame import PrivateFrame, key_columns
from veilframe.plans.agents import ScaledAgent, check_bound


class PrivateGroups:
    """Groups that are not built until it is known what is wanted of them.

    ``agg`` needs only partial aggregates, so a key with very many rows never
    gathers in one place; ``items`` builds the rows of each group and should be
    kept for groups that are small.
    """

    def __init__(self, frame: PrivateFrame, keys: Sequence[Column | str]):
        self._frame, self._keys = frame, key_columns(keys)

    def agg(self, *aggs: Column) -> PrivateFrame:
        frame = self._frame
        return frame._derive(frame._guard.aggregate(frame._df, self._keys, aggs), frame._scaled(2))

    def sizes(self, name: str = "n") -> PrivateFrame:
        return self.agg(F.count(F.lit(1)).alias(name))

    def first(self, k: int, order_by: Sequence[str] | str) -> PrivateFrame:
        """The first ``k`` rows of each group as rows: what ``items`` and ``flat_map`` give, and cost, together.

        No group is gathered: the plan is a partial and a final group limit, so a
        key with very many rows meets in no one place.
        """
        check_bound(k)
        frame = self._frame
        frame._guard.select(frame._df, self._keys)
        return frame._derive(first_per_key(frame._df, self._keys, k, order_by), ScaledAgent(frame._scaled(2), k))

    def items(self, order_by: Sequence[str] | str | None = None, name: str = "items") -> PrivateFrame:
        """Each group as an array of its rows, sorted by ``order_by`` and then all columns."""
        first = [order_by] if isinstance(order_by, str) else list(order_by or [])
        columns = first + [c for c in self._frame._df.columns if c not in first]
        return self.agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
