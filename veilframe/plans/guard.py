"""Checks that what a user passes to a transformation works on one record at a time.

A Column may hold an aggregate, a window, a generator, a subquery or a Python
function, each of which lets one record influence many rows and so breaks the
stability constant. The analysed plan shows this: record-wise columns leave only
projections and filters above the plan of the frame.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame

_PYTHON = ("PythonUDF", "PythonUDAF", "PythonUDTF", "ScalaUDF")
_SUBQUERIES = ("ScalarSubquery", "ListQuery", "Exists", "InSubquery", "LateralSubquery")


class GuardError(ValueError):
    """The expression is not record-wise."""


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.length())]


class Guard:
    """The default policy: deterministic, record-wise, JVM-side expressions only."""

    def __init__(self, allow_python: bool = False):
        self.allow_python = allow_python

    def where(self, df: DataFrame, condition: Column | str) -> DataFrame:
        return self._checked(df, self._build(lambda: df.filter(condition)), aggregates=False)

    def select(self, df: DataFrame, columns: Sequence[Column | str]) -> DataFrame:
        return self._checked(df, self._build(lambda: df.select(*columns)), aggregates=False)

    def aggregate(self, df: DataFrame, keys: Sequence[Column | str], aggs: Sequence[Column]) -> DataFrame:
        """Aggregates of one group are a function of one (nested) record, so they may stand here."""
        self.select(df, list(keys))
        return self._checked(df, self._build(lambda: df.groupBy(*keys).agg(*aggs)), aggregates=True)

    def _build(self, make) -> DataFrame:
        from pyspark.errors import AnalysisException

        try:
            return make()
        except AnalysisException as error:
            if "WINDOW" in str(error).upper():
                raise GuardError("window functions are not record-wise") from None
            raise

    def _checked(self, df: DataFrame, out: DataFrame, aggregates: bool) -> DataFrame:
        base, plan = df._jdf.queryExecution().analyzed(), out._jdf.queryExecution().analyzed()
        allowed = {"Project", "Filter", "Aggregate"} if aggregates else {"Project", "Filter"}
        while not plan.fastEquals(base):
            if plan.nodeName() not in allowed or plan.children().length() != 1:
                raise GuardError(f"{plan.nodeName()} is not record-wise")
            for expression in _items(plan.expressions()):
                self._walk(expression)
            plan = plan.children().apply(0)
        return out

    def _walk(self, expression) -> None:
        kind = expression.getClass().getSimpleName()
        if kind in _PYTHON and not self.allow_python:
            raise GuardError("Python functions have to be allowed explicitly")
        if kind in _SUBQUERIES:
            raise GuardError("subqueries are not record-wise")
        if kind == "WindowExpression":
            raise GuardError("window functions are not record-wise")
        if kind not in _PYTHON and kind != "AggregateExpression" and not expression.deterministic():
            inner = _items(expression.children())
            if all(child.deterministic() for child in inner):
                raise GuardError(f"{kind} is not deterministic")
        for child in _items(expression.children()):
            self._walk(child)
