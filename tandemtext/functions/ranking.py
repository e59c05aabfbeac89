"""Running totals over one global order without a single-partition window."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandemtext.functions.durable import written


def running_total(df: DataFrame, order: list[str], value: str, out: str, by: list[str] | None = None) -> DataFrame:
    """Adds `out`: the sum of the long column `value` over all rows up to this one in `order`, apart for each value of the columns `by`.

    `order` starts with `by` and must tell all rows apart. Rows are range-partitioned and summed locally; the
    totals of the partitions (one row per partition and group) then give the offsets. No row is ever moved to
    a single partition, so a group that holds most rows is no bottleneck.
    """
    by = by or []
    n_by = [f"__by{i}" for i in range(len(by))]
    fields = [*df.schema.fields, T.StructField(out, T.LongType()), T.StructField("__pid", T.IntegerType())]
    names = df.columns

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        pid, carry, last = TaskContext.get().partitionId(), 0, None
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column(names.index(value)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            total = np.cumsum(v)
            starts = np.zeros(len(v), bool)
            keys = [b.column(names.index(c)) for c in by]
            for k in keys:
                code = k.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                starts[1:] |= code[1:] != code[:-1]
            first = tuple(k[0].as_py() for k in keys)
            starts[0] = last is None or first != last
            base = np.where(starts, total - v, np.iinfo(np.int64).min)
            base[0] = total[0] - v[0] if starts[0] else -carry
            # the base of each row is that of the last start before it
            at = np.maximum.accumulate(np.where(starts | (np.arange(len(v)) == 0), np.arange(len(v)), 0))
            run = total - base[at]
            carry, last = int(run[-1]), tuple(k[-1].as_py() for k in keys)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(run), pa.array(np.full(len(v), pid, np.int32))], names=[*names, out, "__pid"])

    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(local, T.StructType(fields))
    ranged = written(ranged, "running")
    sums = ranged.groupBy("__pid", *by).agg(F.sum(value).alias("__sum"))
    w = Window.partitionBy(*by).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("__pid").alias("__p"), *[F.col(c).alias(n) for c, n in zip(by, n_by, strict=True)], F.coalesce(F.sum("__sum").over(w), F.lit(0)).alias("__before"))
    same = F.col("__pid") == F.col("__p")
    for c, n in zip(by, n_by, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(n))
    return ranged.join(offsets, same).withColumn(out, F.col(out) + F.col("__before")).select(*names, out)
