"""Matching lines of two sides by vector similarity within a diagonal band."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandemtext.functions.vectors import cosine

#: Least similarity of an eligible pair.
FLOOR = 0.01


def _side(batches: DataFrame, vectors: DataFrame, side: str, a: str, b: str) -> DataFrame:
    """(doc_id, batch_id, pos, n, line_id, embedding): the lines of each batch on one side; `pos` counts from 0 in the batch.

    Batches become rows of line ids, so the join with the vectors is on equal keys.
    """
    ids = batches.where(F.col(b) > F.col(a)).select("doc_id", "batch_id", (F.col(b) - F.col(a)).alias("n"), F.posexplode(F.sequence(F.col(a) + 1, F.col(b))).alias("pos", "line_id"))
    own = vectors.where(F.col("side") == side).select("doc_id", "line_id", "embedding")
    return ids.join(own, ["doc_id", "line_id"])


def similarities(batches: DataFrame, vectors: DataFrame, window: int) -> DataFrame:
    """(doc_id, batch_id, from_id, to_id, sim): the eligible pairs of each batch, all in built-in expressions.

    Pair (i, j) of a batch with L1 and L2 lines is eligible if i - window < j * L1 / L2 < i + window. Similarities are
    at least FLOOR; a zero vector has FLOOR. Pairs outside the band have no rows.
    """
    f = _side(batches, vectors, "from", "f0", "f1").select("doc_id", "batch_id", F.col("pos").alias("i"), F.col("n").alias("n1"), F.col("line_id").alias("from_id"), F.col("embedding").alias("v"))
    t = _side(batches, vectors, "to", "t0", "t1").select("doc_id", "batch_id", F.col("pos").alias("j"), F.col("n").alias("n2"), F.col("line_id").alias("to_id"), F.col("embedding").alias("u"))
    at = F.col("j") * (F.col("n1") / F.col("n2"))
    pairs = f.join(t, ["doc_id", "batch_id"]).where((at > F.col("i") - window) & (at < F.col("i") + window))
    return pairs.select("doc_id", "batch_id", "from_id", "to_id", F.greatest(F.coalesce(cosine(F.col("v"), F.col("u")), F.lit(FLOOR)), F.lit(FLOOR)).alias("sim"))


def band_similarity(v: np.ndarray, u: np.ndarray, window: int) -> np.ndarray:
    """The similarity matrix of two lists of vectors, 0 outside the band."""
    n1, n2 = len(v), len(u)
    size = np.linalg.norm(v, axis=1)[:, None] * np.linalg.norm(u, axis=1)[None, :]
    sims = np.maximum(np.divide(v @ u.T, size, out=np.full((n1, n2), FLOOR), where=size > 0), FLOOR)
    i, at = np.arange(n1)[:, None], np.arange(n2)[None, :] * (n1 / n2)
    return np.where((at > i - window) & (at < i + window), sims, 0.0)


def align(batches: DataFrame, vectors: DataFrame, window: int) -> DataFrame:
    """(doc_id, batch_id, sub_id, from_ids, to_ids, sim): for each from-line of each batch its most similar to-line.

    Ties go to the first to-line; a line without an eligible partner gets the first of its batch, with similarity 0; in a
    batch without to-lines, none: an empty list and null. One product of matrices for each batch, in Arrow: the
    two sides of a batch meet by its key and no pair of lines ever becomes a row.
    """
    f = _side(batches, vectors, "from", "f0", "f1").select("doc_id", "batch_id", "pos", "line_id", "embedding")
    t = _side(batches, vectors, "to", "t0", "t1")
    t = t.select(*[F.col(c).alias(c) for c in ("doc_id", "batch_id", "pos", "line_id", "embedding")])  # columns of its own: both sides come from one table
    ids = T.ArrayType(T.LongType())
    schema = T.StructType([batches.schema["doc_id"], T.StructField("batch_id", T.LongType()), T.StructField("sub_id", T.LongType()), T.StructField("from_ids", ids), T.StructField("to_ids", ids), T.StructField("sim", T.DoubleType())])

    def matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        table = table.sort_by("pos").combine_chunks()
        flat = table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        return flat.reshape(table.num_rows, -1), table.column("line_id").to_numpy()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        n = left.num_rows
        if not n:
            return pa.table({f: [] for f in schema.names}, schema=arrow)
        v, from_ids = matrix(left)
        if right.num_rows:
            u, to_ids = matrix(right)
            s = band_similarity(v, u, window)
            best = s.argmax(axis=1)
            to, sim = [[int(to_ids[j])] for j in best], s[np.arange(n), best]
        else:
            to, sim = [[] for _ in range(n)], [None] * n
        key = [left.column(c)[0].as_py() for c in ("doc_id", "batch_id")]
        return pa.table({"doc_id": [key[0]] * n, "batch_id": [key[1]] * n, "sub_id": list(range(n)), "from_ids": [[int(x)] for x in from_ids], "to_ids": to, "sim": list(sim)}, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return f.groupBy("doc_id", "batch_id").cogroup(t.groupBy("doc_id", "batch_id")).applyInArrow(run, schema)


def unmatched(match: DataFrame) -> DataFrame:
    """Rows whose line had no eligible partner: the first to-line of the batch by default, or none at all."""
    return match.where("sim is null or sim = 0")

