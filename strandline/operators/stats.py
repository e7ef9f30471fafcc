"""Statistics of a corpus of triples or questions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F


def value_counts(rows: DataFrame, columns: dict[str, str], top: int = 50) -> DataFrame:
    """(field, value, n, place): the `top` most frequent values of each column, ties by value; NULL is no value."""
    parts = [rows.where(F.col(c).isNotNull()).groupBy(F.lit(f).alias("field"), F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n")) for f, c in columns.items()]
    together = reduce(DataFrame.unionAll, parts)
    place = F.row_number().over(Window.partitionBy("field").orderBy(F.col("n").desc(), "value")).cast("long")
    return together.withColumn("place", place).where(F.col("place") <= top)


def distinct_counts(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(field, total_count): the number of distinct values of each column."""
    counted = rows.agg(*[F.count_distinct(c).alias(f) for f, c in columns.items()])
    return counted.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("total_count")) for f in columns])))


def observed(rows: DataFrame, name: str, **measures) -> tuple[DataFrame, Observation]:
    """rows, and counts of them that are taken along when they are written: `rows`, and a named condition each."""
    counts = Observation(name)
    return rows.observe(counts, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(n) for n, c in measures.items()]), counts
