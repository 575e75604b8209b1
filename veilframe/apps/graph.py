"""Graph statistics over private edges (src, dst)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import functions as F

from veilframe.functions.scalars import first_item, glue
from veilframe.operators.frame import PrivateFrame


def degree_distribution(edges: PrivateFrame, degrees: Sequence[int] = tuple(range(20)), eps: float = 0.1) -> dict:
    """Noisy number of nodes of each out-degree."""
    return edges.group_by("src").sizes("n").partition([int(d) for d in degrees], F.col("n").cast("int")).noisy_counts(eps)


def bound_degree(edges: PrivateFrame, bound: int, cheap: bool = False) -> PrivateFrame:
    """Symmetric, distinct edges with at most ``bound`` edges kept per source, then per target.

    The grouped form costs (2 * bound)^2 before it is made symmetric; ``cheap``
    keeps the same rows through ``distinct(k, by)``, which costs 4.
    """
    if cheap:
        kept = edges.distinct(bound, by="src", order_by=["src", "dst"]).distinct(bound, by="dst", order_by=["src", "dst"])
    else:
        for key in ("src", "dst"):
            edges = edges.group_by(key).first(bound, order_by=["src", "dst"])
        kept = edges
    return kept.concat(kept.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def as_paths(edges: PrivateFrame) -> PrivateFrame:
    return edges.select(F.array("src", "dst").alias("path"))


def extend_paths(paths: PrivateFrame, more: PrivateFrame, bound: int, more_bound: int) -> PrivateFrame:
    """Paths glued where one ends and another begins, within bounds per meeting node."""
    return paths.join(
        more,
        F.element_at("path", -1),
        first_item(F.col("path")),
        bound,
        more_bound,
        [glue(F.col("l.path"), F.col("r.path")).alias("path")],
        order_by="path",
        other_order_by="path",
    )


def assortativity(edges: PrivateFrame, degrees: Sequence[int], bound: int, eps: float) -> dict:
    """Noisy number of edges by the degrees of their two ends, all cells in one job."""
    nodes = edges.group_by("src").sizes("n").select(F.col("src").alias("node"), F.col("n").cast("int").alias("n"))
    keep = [F.col("l.src").alias("src"), F.col("l.dst").alias("dst")]
    one = edges.join(nodes, "src", "node", bound, 1, [*keep, F.col("r.n").alias("d1")], ["src", "dst"], "node")
    two = one.join(nodes, "dst", "node", bound, 1, [F.col("l.d1").alias("d1"), F.col("r.n").alias("d2")], ["src", "dst"], "node")
    cells = [(int(a), int(b)) for a in degrees for b in degrees]
    return two.partition(cells, [F.col("d1"), F.col("d2")]).noisy_counts(eps)


def closed_walks(paths3: PrivateFrame) -> PrivateFrame:
    return paths3.where(first_item(F.col("path")) == F.element_at("path", -1))


def triangle_ratio(edges: PrivateFrame, bound: int, eps: float) -> tuple[float, float]:
    """Noisy numbers of closed three-edge walks and of two-edge walks."""
    one = as_paths(edges).materialize()
    two = extend_paths(one, one, bound, bound)
    three = extend_paths(two, one, bound * bound, bound)
    return closed_walks(three).noisy_count(eps), two.noisy_count(eps)


def path_pagerank(edges: PrivateFrame, nodes: int, bound: int, depth: int = 3, eps: float = 0.1, damping: float = 0.85) -> float:
    """Damped noisy count of walks that end at a node divisible by ``nodes``."""
    one = as_paths(edges).materialize()
    walks, total = one, 0.0
    for level in range(depth):
        weight = (damping / bound) ** level
        total += weight * walks.where(F.element_at("path", -1) % nodes == 0).noisy_count(eps * weight)
        if level + 1 < depth:
            walks = extend_paths(walks, one, bound ** (level + 1), bound).materialize()
    return total
