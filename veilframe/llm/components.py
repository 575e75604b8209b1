"""Connected components by contraction: every round at least halves the nodes that are left."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from veilframe.llm.common import checkpointed

TASK_EDGES = 400_000  # edges left that one task takes to their end


def components(edges: DataFrame, a: str = "a", b: str = "b", task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, root) for every node with a link to another; ``root`` is the smallest node reachable.

    Each round points every node at its smallest neighbour (or itself), follows
    the pointers to their ends by doubling, and replaces the ends of all edges by
    these. Pointers only ever descend, so the smallest node of a component keeps
    itself and ends as its root; nodes left after a round are local minima, at
    most half of the nodes before. Minima are combined before they are shuffled and joins
    can be split by AQE, so that a hub with very many links is no bottleneck.
    Rounds go on until no more than ``task_edges`` edges are left, which are few
    enough for one task to finish. Only numbers of edges reach the driver. Null
    ends and loops are ignored.
    """
    left = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    left = checkpointed(left.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    roots = None
    while left.count() > task_edges:
        both = left.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(left.select("b", "a"))
        point = both.groupBy("node").agg(F.min("other").alias("to")).select("node", F.least("node", "to").alias("to"))
        point = _ends(checkpointed(point))
        roots = point.select("node", F.col("to").alias("root")) if roots is None else _moved(roots, point.select("node", "to"))
        ends = point.select(F.col("node").alias("a"), F.col("to").alias("x"))
        other = point.select(F.col("node").alias("b"), F.col("to").alias("y"))
        left = left.join(ends, "a").join(other, "b").where("x <> y")
        left = checkpointed(left.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    last = _finished(left)
    return checkpointed(last.select("node", F.col("to").alias("root")) if roots is None else _moved(roots, last))


def _moved(roots: DataFrame, point: DataFrame) -> DataFrame:
    """``roots`` after the (node, to) of a further round."""
    moved = point.select(F.col("node").alias("root"), F.col("to").alias("to"))
    return roots.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root"))


def _finished(edges: DataFrame) -> DataFrame:
    """(node, to) of a number of edges that fits one task: labels sink along edges, halving their way each time."""
    kind = edges.schema["a"].dataType
    schema = T.StructType([T.StructField("node", kind), T.StructField("to", kind)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        ends = pa.concat_arrays([*table.column("a").chunks, *table.column("b").chunks])
        nodes = pc.unique(ends)
        nodes = nodes.take(pc.sort_indices(nodes))
        at = pc.index_in(ends, nodes).to_numpy(zero_copy_only=False).astype(np.int64)
        i, j = at[: len(at) // 2], at[len(at) // 2 :]
        to = np.arange(len(nodes))
        while True:
            x, y = to[i], to[j]
            apart = x != y
            if not apart.any():
                break
            i, j, x, y = i[apart], j[apart], x[apart], y[apart]
            np.minimum.at(to, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(further := to[to], to):
                to = further
        for lo in range(0, len(nodes), 50_000):
            part = slice(lo, lo + 50_000)
            yield pa.RecordBatch.from_arrays([nodes[part], nodes.take(pa.array(to[part]))], names=arrow.names)

    return edges.coalesce(1).mapInArrow(run, schema)


def _ends(point: DataFrame) -> DataFrame:
    """(node, to) with every pointer followed to its end; rounds grow with the logarithm of the longest way."""
    while True:
        hop = point.select(F.col("node").alias("to"), F.col("to").alias("next"))
        twice = checkpointed(point.join(hop, "to").select("node", F.col("to").alias("before"), F.col("next").alias("to")))
        point = twice.select("node", "to")
        if twice.where("before <> to").isEmpty():
            return point
