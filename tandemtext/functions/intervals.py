"""Rows that lie in intervals, found by merging both in order: no pair of row and interval is ever formed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def within(rows: DataFrame, intervals: DataFrame, keys: list[str], value: str, low: str, high: str) -> DataFrame:
    """The `rows` whose `value` lies in at least one of the closed `intervals` of their keys, each once.

    Starts and ends of intervals are counted up to each row in one window: a row lies inside while more have started than ended
    before it. Null values lie nowhere; intervals that end before they start, or have a null end, hold nothing.
    """
    own = intervals.where(F.col(low) <= F.col(high))
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields if f.name not in keys]
    # at one place starts come first, then rows, then ends
    mark = lambda place, kind, add: own.select(*keys, *none, F.col(place).alias("__v"), F.lit(kind).alias("__kind"), F.lit(add).alias("__add"))
    all_rows = rows.where(F.col(value).isNotNull()).select(*keys, *[F.col(f"`{f.name}`") for f in rows.schema.fields if f.name not in keys], F.col(value).alias("__v"), F.lit(1).alias("__kind"), F.lit(0).alias("__add"))
    both = all_rows.unionByName(mark(low, 0, 1)).unionByName(mark(high, 2, -1))
    w = Window.partitionBy(*keys).orderBy("__v", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("__open", F.sum("__add").over(w)).where((F.col("__kind") == 1) & (F.col("__open") > 0)).select(*rows.columns)
