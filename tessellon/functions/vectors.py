"""Column functions on arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length; null where lengths differ or a part is missing."""
    n = norm(a) * norm(b)
    return F.when(F.size(a) == F.size(b), F.when(n > 0, dot(a, b) / n).otherwise(0.0))


def mean_vector(rows: DataFrame, key: str, vec: str) -> DataFrame:
    """(key, vec): the mean of each key's vectors, place by place; null vectors don't count."""
    parts = rows.select(key, F.posexplode(vec).alias("_i", "_x")).groupBy(key, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    return parts.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias(vec))
