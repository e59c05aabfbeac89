"""Vector arithmetic on array columns, and the aggregation of several vectors into one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METHODS = ("weighted_average", "length_scaling", "max_pooling", "logarithmic_scaling")


def doubles(c: Column) -> Column:
    return c.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null if one of them is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def l2_normalize(a: Column) -> Column:
    """A vector of length 1; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n == 0, doubles(a)).otherwise(F.transform(doubles(a), lambda x: F.try_divide(x, n)))


def aggregate_vectors(rows: DataFrame, keys: list[str], vector: str, length: str, method: str = "weighted_average") -> DataFrame:
    """One unit vector for each group of `keys`, out of its rows' vectors and text lengths.

    weighted_average: weights in proportion to the lengths. length_scaling: the mean of vectors scaled by their length
    over the mean length; it differs by a factor only, which the normalisation takes away. max_pooling: the largest of
    each component. logarithmic_scaling: the mean of vectors scaled by log(1 + length). A zero result gives null.
    Components are rows while they are summed, so a group may have any number of vectors.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method}; there are {', '.join(METHODS)}")
    x = F.col("__x").cast("double")
    n = F.col(length).cast("double")
    how = {
        "weighted_average": F.try_divide(F.sum(x * n), F.sum(n)),
        "length_scaling": F.try_divide(F.sum(x * n), F.avg(n) * F.count(F.lit(1))),
        "max_pooling": F.max(x),
        "logarithmic_scaling": F.avg(x * F.log1p(n)),
    }[method]
    parts = rows.select(*keys, length, F.posexplode(vector).alias("__p", "__x")).groupBy(*keys, "__p").agg(how.alias("__v"))
    whole = parts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__p", "__v"))), lambda s: s["__v"]).alias(vector))
    return whole.withColumn(vector, F.when(norm(F.col(vector)) > 0, l2_normalize(F.col(vector))))


def weighted_sum(vectors: Column, weights: Column) -> Column:
    """The sum of an array of vectors, each times its weight, as one expression; for few vectors."""
    scaled = F.zip_with(vectors, weights, lambda v, w: F.transform(v, lambda x: x.cast("double") * w))
    return F.aggregate(F.slice(scaled, 2, F.greatest(F.size(scaled) - 1, F.lit(0))), F.try_element_at(scaled, F.lit(1)), lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
