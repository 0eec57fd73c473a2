"""Vector functions as Column expressions, accumulated in double."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 for null, empty, unequally long or zero vectors."""
    fine = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (F.size(a) > 0)
    lengths = norm(a) * norm(b)
    return F.when(fine & (lengths > 0), dot(a, b) / lengths).otherwise(F.lit(0.0))


def mean_vector(df: DataFrame, key: list[str], vector: str) -> DataFrame:
    """(key, n, centroid): the mean per position; partial sums before the shuffle."""
    at = df.select(*key, F.posexplode(vector).alias("pos", "x")).groupBy(*key, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count("*").alias("n"))
    return at.groupBy(*key).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("centroid"))
