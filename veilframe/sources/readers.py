"""Sources: text lines, delimited lines, Parquet tables, prefixes and synthetic inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per line (``value``); gzip files are read as well."""
    return spark.read.text(path)


def lines_of(df: DataFrame, text: Column | str = "text") -> DataFrame:
    """One row per line of a text column."""
    column = F.col(text) if isinstance(text, str) else text
    return df.select(F.explode(F.split(column, "\n")).alias("value"))


def words(line: Column | str) -> Column:
    """A line's parts between single spaces; an empty line has one empty part."""
    return F.split(F.col(line) if isinstance(line, str) else line, " ")


def fields(line: Column, separator: str) -> Column:
    """A delimited line as an array; ``separator`` is taken literally."""
    return F.split(line, "\\Q" + separator + "\\E")


def prefixes(spark: SparkSession, path: str, length: int = 33) -> DataFrame:
    """All distinct prefixes of 0 to ``length`` characters of the lines of a file; short lines give what they have."""
    lines = spark.read.text(path).select("value")
    each = F.explode(F.sequence(F.lit(0), F.least(F.lit(length), F.length("value"))))
    return lines.select("value", each.alias("n")).select(F.expr("substring(value, 1, n)").alias("prefix")).distinct()


def random_vectors(spark: SparkSession, n: int, dims: int, seed: int = 42) -> DataFrame:
    """Vectors uniform in [-1, 1)."""
    return spark.range(n).select(F.array(*[2 * F.rand(seed + i) - 1 for i in range(dims)]).alias("vec"))


def random_edges(spark: SparkSession, n: int, nodes: int, seed: int = 42) -> DataFrame:
    return spark.range(n).select(
        F.floor(F.rand(seed) * nodes).alias("src"), F.floor(F.rand(seed + 1) * nodes).alias("dst")
    )
