"""The plan of an alignment: overlapping batches of lines of both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandemtext.operators.books import next_boundary


def plain_batches(counts: DataFrame, size: int, window: int, shift: int = 0, batch_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, batch_id, f0, f1, t0, t1): the batches of each document as half-open ranges of 0-based line places.

    `counts` is (doc_id, l1, l2). The from-side is cut into runs of `size`; a run's share of the to-side, rounded
    half to even, is widened by `window` on both ends and moved by `shift`. No `batch_ids` means all. Documents
    without from-lines have no batches; a to-range may be empty where the rounding has run past the end.
    """
    k = F.bround(F.col("l2") * F.lit(float(size)) / F.col("l1")).cast("long")
    b = F.col("batch_id")
    rows = counts.where("l1 > 0").withColumn("k", k).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil((F.col("l1") - 1) / size - F.lit(1e-9)).cast("long"))).alias("batch_id"))
    rows = rows.where(b * size < F.col("l1"))
    out = rows.select("doc_id", "batch_id", (b * size).alias("f0"), F.least(b * size + size, F.col("l1")).cast("long").alias("f1"), F.greatest(F.lit(0), b * F.col("k") - window + shift).cast("long").alias("t0"), F.least(b * F.col("k") + F.col("k") + window + shift, F.col("l2")).cast("long").alias("t1"))
    out = out.withColumn("t1", F.greatest("t0", "t1"))
    return out.where(b.isin(*batch_ids)) if batch_ids else out


def segment_batches(segments: DataFrame, lines: DataFrame, size: int, window: int, shift: int = 0, batch_ids: list[int] | None = None) -> DataFrame:
    """Batches within the segments of each document, numbered on through all of them; places count from the document's start.

    `lines` has the paragraph of each line. Segments that lack lines on either side have no batches.
    """
    place = lines.select("doc_id", "side", "paragraph", (F.col("line_id") - 1).alias("place"))

    def side(s: str, n: str, first: str) -> DataFrame:
        # segments don't overlap: that of a line is the one with the least end not before its paragraph, if it has begun there
        some = segments.where(F.col(f"par_start_{s}") < F.col(f"par_end_{s}"))
        own = next_boundary(place.where(F.col("side") == s), some, ["doc_id"], "paragraph", f"par_end_{s}", "__end")
        ends = some.select("doc_id", "segment", F.col(f"par_end_{s}").alias("__end"), F.col(f"par_start_{s}").alias("__start"))
        return own.join(ends, ["doc_id", "__end"]).where(F.col("paragraph") > F.col("__start")).groupBy("doc_id", "segment").agg(F.count(F.lit(1)).alias(n), F.min("place").alias(first))

    both = side("from", "l1", "a").join(side("to", "l2", "b"), ["doc_id", "segment"])
    own = both.withColumn("seg", F.struct("doc_id", "segment"))
    cut = plain_batches(own.select(F.col("seg").alias("doc_id"), "l1", "l2"), size, window, shift).withColumnRenamed("doc_id", "seg")
    w = Window.partitionBy("seg.doc_id").orderBy("seg.segment", "batch_id")
    out = cut.join(own.select("seg", "a", "b"), "seg").select(F.col("seg.doc_id").alias("doc_id"), F.col("seg.segment").alias("segment"), (F.row_number().over(w) - 1).cast("long").alias("new"), *[(F.col(c) + F.col(o)).alias(c) for c, o in (("f0", "a"), ("f1", "a"), ("t0", "b"), ("t1", "b"))])
    out = out.withColumnRenamed("new", "batch_id").select("doc_id", "segment", "batch_id", "f0", "f1", "t0", "t1")
    return out.where(F.col("batch_id").isin(*batch_ids)) if batch_ids else out


def batch_ids_by_segment(batches: DataFrame) -> DataFrame:
    """The batch ids of each segment, in order."""
    return batches.groupBy("doc_id", "segment").agg(F.sort_array(F.collect_list("batch_id")).alias("batch_ids"))
