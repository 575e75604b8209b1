"""Order-dependent building blocks, made deterministic by a total order over all columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def order_terms(df: DataFrame, order_by: Sequence[str] | str) -> list[tuple[str, bool]]:
    """(column, descending) of each named column (a leading ``-`` reverses), then of all others."""
    names = [order_by] if isinstance(order_by, str) else list(order_by)
    if not names:
        raise ValueError("the first rows are defined only by an order: give order_by")
    terms = [(n[1:], True) if n.startswith("-") else (n, False) for n in names]
    seen = {n for n, _ in terms}
    return terms + [(c, False) for c in df.columns if c not in seen]


def order_columns(terms: Sequence[tuple[str, bool]]) -> list[Column]:
    return [F.col(_quoted(n)).desc() if down else F.col(_quoted(n)).asc() for n, down in terms]


def first_per_key(df: DataFrame, keys: Sequence[Column], k: int, order_by: Sequence[str] | str) -> DataFrame:
    """The first ``k`` rows of each key; planned as a partial and a final group limit."""
    window = Window.partitionBy(*keys).orderBy(*order_columns(order_terms(df, order_by)))
    return df.withColumn("__rank", F.row_number().over(window)).filter(F.col("__rank") <= k).drop("__rank")


def _after(row: str, edge: str, terms: Sequence[tuple[str, bool]]) -> Column:
    """Whether ``row`` sorts behind ``edge``."""
    later, equal = F.lit(False), F.lit(True)
    for name, down in terms:
        a, b = F.col(row)[name], F.col(edge)[name]
        if down:  # nulls come last
            step = (a.isNull() & b.isNotNull()) | (a < b)
        else:  # nulls come first
            step = (b.isNull() & a.isNotNull()) | (a > b)
        later = later | (equal & F.coalesce(step, F.lit(False)))
        equal = equal & a.eqNullSafe(b)
    return later


def skip_rows(df: DataFrame, n: int, order_by: Sequence[str] | str) -> DataFrame:
    """All but the first ``n`` rows, without sorting the rest.

    The n-th row is found by one distributed top-n, whose last step holds n rows
    in a task, so n should be small beside the data; every later row passes a
    row-wise comparison with it. Copies of that row are interchangeable, so only
    their number has to be right.
    """
    if n <= 0:
        return df
    terms = order_terms(df, order_by)
    packed = F.struct(*[F.col(_quoted(c)) for c in df.columns])
    top = df.orderBy(*order_columns(terms)).limit(n).select(packed.alias("edge"), F.row_number().over(Window.orderBy(*order_columns(terms))).alias("k"))
    same = F.count(F.lit(1)).over(Window.partitionBy("edge")).alias("used")
    edge_row = F.broadcast(top.select("edge", "k", same).filter(F.col("k") == n).drop("k"))  # one row, or none of fewer than n
    rows = df.select(packed.alias("row"))
    behind = rows.join(edge_row, _after("row", "edge", terms)).select("row.*")
    copies = (
        rows.join(edge_row, F.col("row").eqNullSafe(F.col("edge")))
        .groupBy("row", "used")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > F.col("used"))
        .select("row", F.explode(F.sequence(F.lit(1), (F.col("n") - F.col("used")).cast("int"))))
        .select("row.*")
    )
    return behind.unionByName(copies)
