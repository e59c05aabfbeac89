"""Chains of well-matched lines, the conflicts between them, and the score of an alignment.

A match table has (doc_id, batch_id, sub_id, from_ids, to_ids); rows are ordered by (batch_id, sub_id) within a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def match_points(match: DataFrame, side: str = "to") -> DataFrame:
    """(doc_id, batch_id, sub_id, line, from_ids, edited): a row for each id that a match row has on `side`, in order.

    `edited` says that the row matches several lines. Rows without ids on that side have none.
    """
    other = "from_ids" if side == "to" else "to_ids"
    return match.select("doc_id", "batch_id", "sub_id", F.posexplode(f"{side}_ids").alias("part", "line"), F.col(other).alias("other_ids"), (F.size(other) > 1).alias("edited"))


def _islands(points: DataFrame) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("batch_id", "sub_id", "part")
    first = F.coalesce((F.lag("line").over(w) + 1 != F.col("line")).cast("int"), F.lit(1))
    return points.withColumn("first", first).withColumn("island", F.sum("first").over(w).cast("long")).withColumn("place", F.row_number().over(w).cast("long"))


def good_chains(match: DataFrame, min_len: int = 2, handle_start: bool = False, handle_finish: bool = False, lengths: DataFrame | None = None) -> DataFrame:
    """(doc_id, chain, n, start, end): the longest runs of match points in which each to-line follows the one before.

    `start` and `end` are structs (from_id, to_id, batch_id, sub_id), from_id being the first from-line of the row; only the
    to-side has to go on without a gap. Runs shorter than `min_len` are left out. With handle_start a first point
    that isn't to-line 1 becomes a chain by itself that starts at 1; with handle_finish a last run that is too short becomes
    a chain at the last lines (`lengths`: doc_id, len_from, len_to). Both make conflicts at the ends visible. `chain`
    counts from 1 in order.
    """
    points = match_points(match).where(F.size("other_ids") > 0)
    whole = Window.partitionBy("doc_id")
    order = whole.orderBy("batch_id", "sub_id", "part")
    if handle_start:
        points = points.withColumn("late", (F.row_number().over(order) == 1) & (F.col("line") != 1))
    own = _islands(points.where("not late") if handle_start else points)
    edge = F.struct("place", F.element_at("other_ids", 1).alias("from_id"), F.col("line").alias("to_id"), "batch_id", "sub_id")
    runs = own.withColumn("e", edge).groupBy("doc_id", "island").agg(F.count(F.lit(1)).alias("n"), F.min("e").alias("a"), F.max("e").alias("b"))
    point = lambda e: F.struct(*[F.col(f"{e}.{f}").alias(f) for f in ("from_id", "to_id", "batch_id", "sub_id")])
    runs = runs.select("doc_id", "island", "n", point("a").alias("start"), point("b").alias("end"))
    kept = runs.where(F.col("n") >= min_len)

    def extra(df: DataFrame, island: F.Column, f: F.Column, t: F.Column, at: str) -> DataFrame:
        p = F.struct(f.cast("long").alias("from_id"), t.cast("long").alias("to_id"), F.col(f"{at}batch_id").alias("batch_id"), F.col(f"{at}sub_id").alias("sub_id"))
        return df.select("doc_id", island.cast("long").alias("island"), F.lit(1).cast("long").alias("n"), p.alias("start"), p.alias("end"))

    if handle_start:
        kept = kept.unionByName(extra(points.where("late"), F.lit(0), F.element_at("other_ids", 1), F.lit(1), ""))
    if handle_finish and lengths is not None:
        last = runs.withColumn("top", F.max("island").over(whole)).where((F.col("island") == F.col("top")) & (F.col("n") < min_len))
        kept = kept.unionByName(extra(last.join(lengths, "doc_id"), F.col("island"), F.col("len_from"), F.col("len_to"), "end."))
    w = whole.orderBy("island")
    return kept.select("doc_id", F.row_number().over(w).cast("long").alias("chain"), "n", "start", "end")


def conflicts(chains: DataFrame) -> DataFrame:
    """(doc_id, conflict, start, end, len_from, len_to): what lies from the end of each chain to the start of the next.

    Lengths are differences of ids, so they count the lines after the first.
    """
    w = Window.partitionBy("doc_id").orderBy("chain")
    own = chains.select("doc_id", F.col("chain").alias("conflict"), F.col("end").alias("start"), F.lead("start").over(w).alias("end")).where("end is not null")
    return own.select("*", (F.col("end.from_id") - F.col("start.from_id")).alias("len_from"), (F.col("end.to_id") - F.col("start.to_id")).alias("len_to"))


def solvable(found: DataFrame, max_len: int = 6) -> DataFrame:
    """Conflicts whose lengths on both sides are at least 0 and below `max_len`."""
    return found.where(_fits(max_len))


def unsolvable(found: DataFrame, max_len: int = 6) -> DataFrame:
    return found.where(~_fits(max_len))


def _fits(max_len: int) -> F.Column:
    return F.col("len_from").between(0, max_len - 1) & F.col("len_to").between(0, max_len - 1)


def conflict_statistics(found: DataFrame) -> DataFrame:
    """How many conflicts have so many lines on either side."""
    kind = F.concat_ws(":", F.col("len_from") + 1, F.col("len_to") + 1)
    return found.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def chain_breaks(match: DataFrame, side: str = "to") -> DataFrame:
    """(doc_id, breaks, n): how often an id isn't the one after its predecessor, once more if the first isn't the least."""
    w = Window.partitionBy("doc_id").orderBy("batch_id", "sub_id", "part")
    own = match_points(match, side).select("doc_id", "line", F.lag("line").over(w).alias("before"), F.min("line").over(Window.partitionBy("doc_id")).alias("least"))
    broken = F.when(F.col("before").isNull(), F.col("line") != F.col("least")).otherwise(F.col("line") != F.col("before") + 1)
    return own.groupBy("doc_id").agg(F.count_if(broken).alias("breaks"), F.count(F.lit(1)).alias("n"))


def chain_score(match: DataFrame, mode: str = "to") -> DataFrame:
    """(doc_id, score): 1 less the share of breaks on the to-side, or on both sides with mode "both". Null without lines."""
    to = chain_breaks(match, "to")
    if mode == "to":
        return to.select("doc_id", (1 - F.try_divide("breaks", "n")).alias("score"))
    both = to.join(chain_breaks(match, "from").select("doc_id", F.col("breaks").alias("b1"), F.col("n").alias("n1")), "doc_id", "full")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return both.select("doc_id", (1 - F.try_divide(zero("breaks") + zero("b1"), zero("n") + zero("n1"))).alias("score"))
