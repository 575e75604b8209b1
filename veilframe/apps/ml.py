"""Learning from private vectors; every step is one Spark job whatever the dimension."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from veilframe.functions.scalars import centred, dot, nearest, vector_literal
from veilframe.operators.frame import PrivateFrame

Vector = Sequence[float]


def _items(vector: Column, dims: int) -> list[Column]:
    return [F.get(vector, F.lit(i)) for i in range(dims)]


def mean(frame: PrivateFrame, vector: str, dims: int, eps: float) -> list[float]:
    return frame.noisy_averages(eps, _items(F.col(vector), dims))


def centre(frame: PrivateFrame, vector: str, means: Vector) -> PrivateFrame:
    return frame.select(centred(F.col(vector), means).alias(vector))


def covariance(frame: PrivateFrame, vector: str, dims: int, eps: float, symmetric: bool = False) -> list[list[float]]:
    """Noisy averages of all products; ``symmetric`` buys each unordered pair once, for half the price."""
    v = F.slice(F.col(vector), 1, dims)
    products = F.transform(v, lambda x, i: F.transform(F.slice(v, i + 1, F.size(v)) if symmetric else v, lambda y: x * y))
    cells = [(i, j) for i in range(dims) for j in range(i if symmetric else 0, dims)]
    values = dict(zip(cells, frame.noisy_array_averages(eps, F.flatten(products), len(cells)), strict=True))
    return [[values[min(i, j), max(i, j)] if symmetric else values[i, j] for j in range(dims)] for i in range(dims)]


def kmeans_step(frame: PrivateFrame, vector: str, centres: Sequence[Vector], eps: float) -> list[list[float]]:
    """New centres; rows are told apart by the index of the nearest, so equal centres stay apart."""
    dims = len(centres[0])
    parts = frame.partition(list(range(len(centres))), nearest(F.col(vector), centres))
    averages = parts.noisy_averages(eps, _items(F.col(vector), dims))
    return [averages[c] for c in range(len(centres))]


def kmeans(frame: PrivateFrame, vector: str, centres: Sequence[Vector], eps: float, steps: int) -> list[list[float]]:
    for _ in range(steps):
        centres = kmeans_step(frame, vector, centres, eps)
    return [list(c) for c in centres]


def label_by_nearest(frame: PrivateFrame, vector: str, centres: Sequence[Vector]) -> PrivateFrame:
    """Examples (vector, label): +1 where the first centre is the nearest, else -1."""
    label = F.when(nearest(F.col(vector), centres) == 0, 1.0).otherwise(-1.0)
    return frame.select(F.col(vector).alias("vector"), label.alias("label"))


def _margin(weights: Vector) -> Column:
    return F.col("label") * dot(F.col("vector"), vector_literal(weights))


def _moved(weights: Vector, steps: Vector) -> list[float]:
    return [w + s for w, s in zip(weights, steps, strict=True)]


def _label_weighted(dims: int) -> list[Column]:
    return [F.col("label") * x for x in _items(F.col("vector"), dims)]


def perceptron_step(examples: PrivateFrame, weights: Vector, eps: float) -> list[float]:
    wrong = examples.where(_margin(weights) < 0.0)
    return _moved(weights, wrong.noisy_averages(eps, _label_weighted(len(weights))))


def svm_step(spark: SparkSession, examples: PrivateFrame, weights: Vector, eps: float, pull: int = 10) -> list[float]:
    """As the perceptron, with margin one and ``pull`` public copies of (weights, -1) as regulariser."""
    near = examples.where(_margin(weights) < 1.0)
    regulariser = spark.range(pull).select(vector_literal(weights).alias("vector"), F.lit(-1.0).alias("label"))
    return _moved(weights, near.concat(regulariser).noisy_averages(eps, _label_weighted(len(weights))))


def logistic_step(examples: PrivateFrame, weights: Vector, eps: float) -> list[float]:
    odds = dot(F.col("vector"), vector_literal(weights))
    error = (F.col("label") + 1.0) / 2.0 - 1.0 / (1.0 + F.exp(-odds))
    scored = examples.select("vector", error.alias("error"))
    steps = scored.noisy_sums(eps, [F.col("error") * x for x in _items(F.col("vector"), len(weights))])
    return _moved(weights, steps)


def error_rate(examples: PrivateFrame, weights: Vector, eps: float) -> float:
    return examples.noisy_average(eps, F.when(_margin(weights) < 0.0, 1.0).otherwise(0.0))
