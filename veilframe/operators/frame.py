"""Private frames: relational transformations that carry their privacy cost along."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.ranking import first_per_key, order_columns, order_terms, skip_rows
from veilframe.functions.scalars import clamp
from veilframe.operators import release
from veilframe.plans.agents import Agent, PairAgent, ScaledAgent, check_bound, check_epsilon
from veilframe.plans.guard import Guard
from veilframe.plans.noise import NoiseSource

Keys = Column | str | Sequence[Column | str]


def key_columns(keys: Keys) -> list[Column]:
    parts = [keys] if isinstance(keys, (str, Column)) else list(keys)
    return [F.col(k) if isinstance(k, str) else k for k in parts]


class PrivateFrame:
    """Rows that may be transformed but never read.

    Every transformation returns a new frame whose agent multiplies charges by
    the stability constant: by how many rows the result can differ at most if
    one row is added to or taken from the source. ``compat=True`` charges Take
    and order statistics as the classic constants do (too little for Take, and
    for fractions other than one half).
    """

    def __init__(
        self,
        df: DataFrame,
        agent: Agent | None = None,
        guard: Guard | None = None,
        noise: NoiseSource | None = None,
        compat: bool = False,
    ):
        self._df = df
        self._agent = agent or Agent()
        self._guard = guard or Guard()
        self._noise = noise or NoiseSource()
        self._compat = compat

    # ---- derivation -------------------------------------------------------
    def _derive(self, df: DataFrame, agent: Agent) -> PrivateFrame:
        """Factory of all results; subclasses override it to stay themselves."""
        return type(self)(df, agent, self._guard, self._noise, self._compat)

    def _scaled(self, scale: float) -> Agent:
        return ScaledAgent(self._agent, scale)

    def as_base(self) -> PrivateFrame:
        return PrivateFrame(self._df, self._agent, self._guard, self._noise, self._compat)

    def materialize(self) -> PrivateFrame:
        """The same rows, computed once and kept; releases nothing, so charges nothing.

        Uses ``checkpoint()`` if the session has a checkpoint folder, which
        also survives lost executors, and else ``persist()``.
        """
        from veilframe.sources.storage import pinned

        return self._derive(pinned(self._df), self._agent)

    @property
    def schema(self):
        """Column names and types are public."""
        return self._df.schema

    # ---- record-wise ------------------------------------------------------
    def where(self, condition: Column | str) -> PrivateFrame:
        return self._derive(self._guard.where(self._df, condition), self._scaled(1))

    def select(self, *columns: Column | str) -> PrivateFrame:
        return self._derive(self._guard.select(self._df, columns), self._scaled(1))

    def flat_map(self, k: int, array: Column | str, name: str = "item") -> PrivateFrame:
        """The first ``k`` items of each row's array, one row each; null arrays count as empty."""
        check_bound(k)
        items = self._guard.select(self._df, [key_columns(array)[0].alias(name)])
        return self._derive(items.select(F.explode(F.slice(F.col(name), 1, k)).alias(name)), self._scaled(k))

    # ---- first rows -------------------------------------------------------
    def take(self, n: int, order_by: Sequence[str] | str) -> PrivateFrame:
        """First ``n`` rows by ``order_by``; an early row also evicts the n-th, hence the factor 2."""
        if isinstance(n, bool) or not isinstance(n, int) or n < 0:
            raise ValueError("the number of rows must be an integer of at least 0")
        rows = self._df.orderBy(*order_columns(order_terms(self._df, order_by))).limit(n)
        return self._derive(rows, self._scaled(1 if self._compat else 2))

    def skip(self, n: int, order_by: Sequence[str] | str) -> PrivateFrame:
        if isinstance(n, bool) or not isinstance(n, int) or n < 0:
            raise ValueError("the number of rows must be an integer of at least 0")
        return self._derive(skip_rows(self._df, n, order_by), self._scaled(1))

    # ---- grouping ---------------------------------------------------------
    def group_by(self, *keys: Column | str):
        from veilframe.operators.groups import PrivateGroups

        return PrivateGroups(self, list(keys))

    def distinct(self, k: int | None = None, by: Keys | None = None, order_by: Sequence[str] | str | None = None) -> PrivateFrame:
        """At most one copy of each row; with ``k`` at most ``k``; with ``by`` at most ``k`` rows a key."""
        if by is None:
            if k is None:
                return self._derive(self._df.distinct(), self._scaled(1))
            check_bound(k)
            names = [F.col("`" + c.replace("`", "``") + "`") for c in self._df.columns]
            return self._derive(first_per_key(self._df, names, k, self._df.columns), self._scaled(1))
        check_bound(k)
        keys = key_columns(by)
        self._guard.select(self._df, keys)
        return self._derive(first_per_key(self._df, keys, k, order_by or []), self._scaled(2))

    def partition(self, keys: Sequence, by: Keys):
        """One part per listed key, whether it has rows or not; rows with other keys go."""
        from veilframe.operators.partitions import PrivatePartitions

        return PrivatePartitions(self, keys, by)

    # ---- joins ------------------------------------------------------------
    def _other(self, other, agent: Agent | None) -> tuple[DataFrame, Agent | None]:
        if isinstance(other, DataFrame):
            return other, agent
        raise TypeError("a join needs a DataFrame or a PrivateFrame")

    def _joined_agent(self, mine: float, other: Agent | None, others: float) -> Agent:
        own = self._scaled(mine)
        return own if other is None else PairAgent(own, ScaledAgent(other, others))

    def join_groups(self, other, key: Keys, other_key: Keys, aggs: Sequence[Column], other_aggs: Sequence[Column], agent: Agent | None = None) -> PrivateFrame:
        """One row per key on both sides: the key, aggregates of its rows here and of those there."""
        if isinstance(other, PrivateFrame):
            return other._join_groups_with(self, key, other_key, aggs, other_aggs)
        public, agent = self._other(other, agent)
        mine = _grouped(self._guard, self._df, key, aggs)
        theirs = _grouped(self._guard, public, other_key, other_aggs)
        return self._derive(_key_join(mine, theirs, "inner"), self._joined_agent(2, agent, 2))

    def _join_groups_with(self, first: PrivateFrame, key, other_key, aggs, other_aggs) -> PrivateFrame:
        self._check_partner(first, key, aggs)
        return first.join_groups(self._df, key, other_key, aggs, other_aggs, agent=self._agent)

    def _check_partner(self, first: PrivateFrame, key: Keys, aggs: Sequence[Column]) -> None:
        """This frame's own guard also has to accept what runs beside its rows."""
        self._guard.aggregate(first._df, key_columns(key), aggs)

    def join(
        self,
        other,
        key: Keys,
        other_key: Keys,
        bound: int,
        other_bound: int,
        select: Sequence[Column | str],
        order_by: Sequence[str] | str,
        other_order_by: Sequence[str] | str,
        agent: Agent | None = None,
    ) -> PrivateFrame:
        """Inner equi-join of the first ``bound`` rows of a key here and ``other_bound`` there.

        ``select`` names the two sides ``l`` and ``r`` (``F.col("l.x")``). Null keys match nothing.
        """
        check_bound(bound)
        check_bound(other_bound)
        if isinstance(other, PrivateFrame):
            return other._join_with(self, key, other_key, bound, other_bound, select, order_by, other_order_by)
        public, agent = self._other(other, agent)
        left = _first_rows(self._guard, self._df, key, bound, order_by).alias("l")
        right = _first_rows(self._guard, public, other_key, other_bound, other_order_by).alias("r")
        n = len(key_columns(key))
        match = [F.col(f"l.__k{i}") == F.col(f"r.__k{i}") for i in range(n)]
        rows = self._guard.select(left.join(right, match, "inner"), list(select))
        return self._derive(rows, self._joined_agent(2 * other_bound, agent, 2 * bound))

    def _join_with(self, first: PrivateFrame, key, other_key, bound, other_bound, select, order_by, other_order_by) -> PrivateFrame:
        self._guard.select(first._df, key_columns(key))
        return first.join(self._df, key, other_key, bound, other_bound, select, order_by, other_order_by, agent=self._agent)

    def left_join_list(self, other: DataFrame, key: Keys, other_key: Keys, other_aggs: Sequence[Column], fill: dict | None = None) -> PrivateFrame:
        """Every row here with aggregates of its (maybe empty) matches in a public table."""
        public, _ = self._other(other, None)
        keys = key_columns(key)
        rows = self._guard.select(self._df, ["*", *[k.alias(f"__k{i}") for i, k in enumerate(keys)]])
        theirs = _grouped(self._guard, public, other_key, other_aggs)
        out = rows.join(theirs, [f"__k{i}" for i in range(len(keys))], "left")
        out = _filled(out, fill).drop(*[f"__k{i}" for i in range(len(keys))])
        return self._derive(out, self._scaled(1))

    def left_join_groups(self, other, key: Keys, other_key: Keys, aggs: Sequence[Column], other_aggs: Sequence[Column], fill: dict | None = None, agent: Agent | None = None) -> PrivateFrame:
        """One row per key here: aggregates of its rows and of its (maybe empty) matches there."""
        if isinstance(other, PrivateFrame):
            return other._left_join_groups_with(self, key, other_key, aggs, other_aggs, fill)
        public, agent = self._other(other, agent)
        mine = _grouped(self._guard, self._df, key, aggs)
        theirs = _grouped(self._guard, public, other_key, other_aggs)
        return self._derive(_filled(_key_join(mine, theirs, "left"), fill), self._joined_agent(2, agent, 2))

    def _left_join_groups_with(self, first: PrivateFrame, key, other_key, aggs, other_aggs, fill) -> PrivateFrame:
        self._check_partner(first, key, aggs)
        return first.left_join_groups(self._df, key, other_key, aggs, other_aggs, fill, agent=self._agent)

    # ---- set operations ---------------------------------------------------
    def _combined(self, other, agent: Agent | None, how: Callable[[DataFrame, DataFrame], DataFrame]) -> PrivateFrame:
        public, agent = self._other(other, agent)
        return self._derive(how(self._df, public), self._joined_agent(1, agent, 1))

    def concat(self, other, agent: Agent | None = None) -> PrivateFrame:
        if isinstance(other, PrivateFrame):
            return other._concat_with(self)
        return self._combined(other, agent, lambda a, b: a.unionByName(b))

    def _concat_with(self, first: PrivateFrame) -> PrivateFrame:
        return first.concat(self._df, agent=self._agent)

    def union(self, other, agent: Agent | None = None) -> PrivateFrame:
        if isinstance(other, PrivateFrame):
            return other._union_with(self)
        return self._combined(other, agent, lambda a, b: a.unionByName(b).distinct())

    def _union_with(self, first: PrivateFrame) -> PrivateFrame:
        return first.union(self._df, agent=self._agent)

    def intersect(self, other, agent: Agent | None = None) -> PrivateFrame:
        if isinstance(other, PrivateFrame):
            return other._intersect_with(self)
        return self._combined(other, agent, lambda a, b: a.intersect(b))

    def _intersect_with(self, first: PrivateFrame) -> PrivateFrame:
        return first.intersect(self._df, agent=self._agent)

    def except_(self, other, agent: Agent | None = None) -> PrivateFrame:
        if isinstance(other, PrivateFrame):
            return other._except_with(self)
        return self._combined(other, agent, lambda a, b: a.subtract(b))

    def _except_with(self, first: PrivateFrame) -> PrivateFrame:
        return first.except_(self._df, agent=self._agent)

    # ---- releases ---------------------------------------------------------
    def noisy_count(self, eps: float) -> float:
        eps = check_epsilon(eps)
        release.charge(self._agent, eps)
        row = release.collect_bounded(self._df.agg(F.count(F.lit(1)).alias("n")))[0]
        return row["n"] + self._noise.laplace(1.0 / eps)

    def _tallies(self, values: Sequence[Column]) -> tuple[list[float], int]:
        checked = self._guard.select(self._df, [v.alias(f"v{i}") for i, v in enumerate(values)])
        sums = [release.sum_column(F.col(f"v{i}")).alias(f"s{i}") for i in range(len(values))]
        row = release.collect_bounded(checked.agg(*sums, F.count(F.lit(1)).alias("n")))[0]
        return [row[f"s{i}"] for i in range(len(values))], row["n"]

    def noisy_sums(self, eps: float, values: Sequence[Column]) -> list[float]:
        """Several sums in one job, ``eps`` each."""
        eps = check_epsilon(eps)
        release.charge(self._agent, eps * len(values))
        return [s + self._noise.laplace(1.0 / eps) for s in self._tallies(values)[0]]

    def noisy_sum(self, eps: float, value: Column) -> float:
        """Sum of ``value`` held in [-1, 1]."""
        return self.noisy_sums(eps, [value])[0]

    def noisy_averages(self, eps: float, values: Sequence[Column]) -> list[float]:
        """Several averages in one job, ``eps`` each."""
        eps = check_epsilon(eps)
        release.charge(self._agent, eps * len(values))
        sums, n = self._tallies(values)
        return [release.average_of(self._noise, eps, s, n) for s in sums]

    def noisy_array_averages(self, eps: float, values: Column, size: int) -> list[float]:
        """Averages of the first ``size`` items of an array by place, in one job, ``eps`` each.

        For many values: the plan stays small, while each row becomes ``size`` cells
        that are summed before they are shuffled. Items that a row lacks count as 0.
        """
        eps = check_epsilon(eps)
        check_bound(size)
        checked = self._guard.select(self._df, [values.alias("v")])
        release.charge(self._agent, eps * size)
        cells = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.get("v", i))
        each = checked.select(F.posexplode(cells).alias("i", "x")).groupBy("i").agg(release.sum_column(F.col("x")).alias("s"), F.count(F.lit(1)).alias("n"))
        found = {r["i"]: (r["s"], r["n"]) for r in release.collect_bounded(each)}
        return [release.average_of(self._noise, eps, *found.get(i, (0.0, 0))) for i in range(size)]

    def noisy_average(self, eps: float, value: Column) -> float:
        """Average of ``value`` held in [-1, 1]; without rows a uniform draw."""
        return self.noisy_averages(eps, [value])[0]

    def noisy_order_statistic(self, eps: float, fraction: float, value: Column) -> float:
        """A point of [0, 1] whose rank among the values is near ``fraction`` of them."""
        eps = check_epsilon(eps)
        if not 0.0 <= fraction <= 1.0:
            raise ValueError("a fraction lies between 0 and 1")
        factor = 1.0 if self._compat else 2.0 * max(fraction, 1.0 - fraction)
        release.charge(self._agent, eps * factor)
        checked = self._guard.select(self._df, [value.alias("v")])
        return release.order_statistic(checked, F.col("v"), eps, fraction, self._noise)

    def noisy_median(self, eps: float, value: Column) -> float:
        return self.noisy_order_statistic(eps, 0.5, value)

    def select_best(self, eps: float, candidates: Sequence, score: Callable[[Column], Column]):
        """The candidate with the largest noisy sum of ``score(candidate)`` held in [0, 1]."""
        eps = check_epsilon(eps)
        if not candidates:
            raise ValueError("there is no candidate")
        release.charge(self._agent, eps)
        self._guard.select(self._df, [clamp(score(F.lit(c)), 0, 1).alias(f"s{i}") for i, c in enumerate(candidates)])
        scores = release.candidate_scores(self._df, candidates, score)
        return candidates[release.best_of(scores, eps, self._noise)]


def _grouped(guard: Guard, df: DataFrame, key: Keys, aggs: Sequence[Column]) -> DataFrame:
    keys = [k.alias(f"__k{i}") for i, k in enumerate(key_columns(key))]
    return guard.aggregate(df, keys, aggs)


def _key_join(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    names = [c for c in left.columns if c.startswith("__k")]
    joined = left.join(right, names, how)
    return joined.withColumnsRenamed({c: "key" if len(names) == 1 else f"key{i}" for i, c in enumerate(names)})


def _filled(df: DataFrame, fill: dict | None) -> DataFrame:
    for name, value in (fill or {}).items():
        df = df.withColumn(name, F.coalesce(F.col(name), value if isinstance(value, Column) else F.lit(value)))
    return df


def _first_rows(guard: Guard, df: DataFrame, key: Keys, k: int, order_by) -> DataFrame:
    keys = key_columns(key)
    terms = order_terms(df, order_by)
    rows = guard.select(df, ["*", *[c.alias(f"__k{i}") for i, c in enumerate(keys)]])
    names = ["-" + n if down else n for n, down in terms]
    return first_per_key(rows, [F.col(f"__k{i}") for i in range(len(keys))], k, names)
