"""Repairing conflicts: candidate groupings of their lines, scored by vector similarity, and put into the alignment."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandemtext.functions.durable import consumed, written
from tandemtext.functions.intervals import within
from tandemtext.functions.vectors import aggregate_vectors, cosine
from tandemtext.operators import chains as C

#: Size of the conflicts that the last round of `resolve_all` and `correct_conflicts` take.
LARGE = 26


def variants(conflicts: DataFrame, max_side: int = LARGE) -> DataFrame:
    """(doc_id, conflict, variant, pair, from_ids, to_ids): every order-preserving grouping of a conflict's lines.

    The side with more lines is cut into as many contiguous groups as the other side has lines; the groups are paired with
    these in order. A grouping is the set of its cuts. The cuts are chosen one after the other by explode, so exactly
    the C(n - 1, g - 1) groupings arise and no others. Variants are numbered from 0 in the order of their cuts.
    Conflicts with a length of `max_side` or more on a side have none: the groupings grow exponentially. To solve conflicts of
    any length, see `solutions`.
    """
    ids = lambda side: F.sequence(F.col(f"start.{side}_id"), F.col(f"end.{side}_id"))
    own = conflicts.where((F.col("len_from") >= 0) & (F.col("len_to") >= 0) & (F.greatest("len_from", "len_to") < max_side))
    own = own.select("doc_id", "conflict", ids("from").alias("f"), ids("to").alias("t")).withColumn("wide_to", F.size("f") < F.size("t"))
    own = own.withColumn("n", F.greatest(F.size("f"), F.size("t"))).withColumn("g", F.least(F.size("f"), F.size("t")))
    grown = own.withColumn("cuts", F.array(F.lit(0)))
    done = grown.where("g = 1").withColumn("cuts", F.concat("cuts", F.array("n")))
    left = grown.where("g > 1")
    # one step for each cut; the cap on sides bounds the number of steps, not of rows
    steps = left.agg(F.max("g")).first()[0] or 1
    for k in range(1, steps):
        last, room = F.element_at("cuts", -1), F.col("n") - (F.col("g") - k) + 0
        left = left.where(F.col("g") > k).withColumn("cut", F.explode(F.sequence(last + 1, room))).withColumn("cuts", F.concat("cuts", F.array("cut"))).drop("cut")
        done = done.unionByName(left.where(F.col("g") == k + 1).withColumn("cuts", F.concat("cuts", F.array("n"))))
    w = Window.partitionBy("doc_id", "conflict").orderBy("cuts")
    rows = done.withColumn("variant", (F.row_number().over(w) - 1).cast("long"))
    rows = rows.select("doc_id", "conflict", "variant", "f", "t", "wide_to", "cuts", F.explode(F.sequence(F.lit(1), F.col("g"))).alias("k"))
    a, b = F.element_at("cuts", F.col("k")), F.element_at("cuts", F.col("k") + 1)
    group = lambda side: F.slice(side, a + 1, b - a)
    one = lambda side: F.array(F.element_at(side, F.col("k")))
    return rows.select("doc_id", "conflict", "variant", F.col("k").cast("long").alias("pair"), F.when(F.col("wide_to"), one("f")).otherwise(group("f")).alias("from_ids"), F.when(F.col("wide_to"), group("t")).otherwise(one("t")).alias("to_ids"))


def group_vectors(groups: DataFrame, vectors: DataFrame, method: str = "weighted_average", embed: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(doc_id, side, ids, embedding) for each distinct group of lines: the stored vectors aggregated by text length, or, with
    `embed`, whatever that makes of (doc_id, side, ids, text), the texts joined with blanks.

    `vectors` is (doc_id, side, line_id, text, embedding).
    """
    own = groups.select("doc_id", "side", "ids").distinct()
    rows = own.select("*", F.posexplode("ids").alias("at", "line_id")).join(vectors, ["doc_id", "side", "line_id"])
    if embed is not None:
        texts = rows.groupBy("doc_id", "side", "ids").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("l"))
        return embed(texts.select("doc_id", "side", "ids", F.concat_ws(" ", "l.text").alias("text")))
    return aggregate_vectors(rows.withColumn("n", F.length("text")), ["doc_id", "side", "ids"], "embedding", "n", method)


def pair_similarities(pairs: DataFrame, vectors: DataFrame, method: str = "weighted_average", embed: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(doc_id, from_ids, to_ids, sim): the cosine of each distinct pair of groups; groups and pairs are scored once."""
    own = pairs.select("doc_id", "from_ids", "to_ids").distinct()
    side = lambda s: own.select("doc_id", F.lit(s).alias("side"), F.col(f"{s}_ids").alias("ids"))
    got = group_vectors(side("from").unionByName(side("to")), vectors, method, embed)
    vec = lambda s: got.where(F.col("side") == s).select("doc_id", F.col("ids").alias(f"{s}_ids"), F.col("embedding").alias(f"v_{s}"))
    return own.join(vec("from"), ["doc_id", "from_ids"], "left").join(vec("to"), ["doc_id", "to_ids"], "left").select("doc_id", "from_ids", "to_ids", F.coalesce(cosine(F.col("v_from"), F.col("v_to")), F.lit(0.0)).alias("sim"))


def best_variants(found: DataFrame, sims: DataFrame) -> DataFrame:
    """(doc_id, conflict, variant, score): the variant of each conflict with the largest sum of similarities, the first of equals.

    Where no sum is above 0 the first variant is taken.
    """
    score = found.join(sims, ["doc_id", "from_ids", "to_ids"]).groupBy("doc_id", "conflict", "variant").agg(F.greatest(F.round(F.sum("sim"), 12), F.lit(0.0)).alias("score"))
    best = score.groupBy("doc_id", "conflict").agg(F.max(F.struct("score", (-F.col("variant")).alias("v"))).alias("b"))
    return best.select("doc_id", "conflict", (-F.col("b.v")).alias("variant"), F.col("b.score").alias("score"))


def grouping_pairs(conflicts: DataFrame) -> DataFrame:
    """(doc_id, conflict, k, a, b, from_ids, to_ids): every pair that some variant of a conflict has as its k-th: a line of
    the shorter side and the lines a to b, counted from 1, of the longer. There are at most g * (n - g + 1)^2 of them, however
    many variants they make up, for conflicts of any length."""
    ids = lambda side: F.sequence(F.col(f"start.{side}_id"), F.col(f"end.{side}_id"))
    own = conflicts.where((F.col("len_from") >= 0) & (F.col("len_to") >= 0))
    own = own.select("doc_id", "conflict", ids("from").alias("f"), ids("to").alias("t")).withColumn("wide_to", F.size("f") < F.size("t"))
    own = own.withColumn("n", F.greatest(F.size("f"), F.size("t"))).withColumn("g", F.least(F.size("f"), F.size("t")))
    k, a, b, room = F.col("k"), F.col("a"), F.col("b"), F.col("n") - F.col("g") + F.col("k")
    rows = own.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("g"))))
    rows = rows.withColumn("a", F.explode(F.when(k == 1, F.array(F.lit(1))).otherwise(F.sequence(k, room))))
    rows = rows.withColumn("b", F.explode(F.when(k == F.col("g"), F.array("n")).otherwise(F.sequence(a, room))))
    group = lambda side: F.slice(side, a, b - a + 1)
    one = lambda side: F.array(F.element_at(side, k))
    return rows.select("doc_id", "conflict", "k", "a", "b", F.when(F.col("wide_to"), one("f")).otherwise(group("f")).alias("from_ids"), F.when(F.col("wide_to"), group("t")).otherwise(one("t")).alias("to_ids"))


def best_groups(k: np.ndarray, a: np.ndarray, b: np.ndarray, sim: np.ndarray) -> list[tuple[int, int]]:
    """The (a, b) of each group, in order, of the grouping with the largest sum of similarities; of equals, and where no sum is
    above 0, the first in the order of cuts. `best[k, a]` is the most that groups k and later can have from line a on."""
    g, n = int(k.max()), int(b.max())
    best = np.full((g + 2, n + 2), -np.inf)
    best[g + 1, n + 1] = 0
    order = np.lexsort((b, a, k))
    k, a, b, sim = k[order], a[order], b[order], sim[order]
    cut = np.searchsorted(k, np.arange(1, g + 2))
    total = np.empty(len(k))
    for i in range(g, 0, -1):
        own = slice(cut[i - 1], cut[i])
        total[own] = sim[own] + best[i + 1, b[own] + 1]
        np.maximum.at(best[i], a[own], total[own])
    if round(best[1, 1], 12) <= 0:
        return [(i, i) for i in range(1, g)] + [(g, n)]
    out, at = [], 1
    for i in range(1, g + 1):
        own = slice(cut[i - 1], cut[i])
        to = int(b[own][(a[own] == at) & (total[own] >= best[i, at] - 1e-12)][0])
        out.append((at, to))
        at = to + 1
    return out


def solutions(conflicts: DataFrame, vectors: DataFrame, method: str = "weighted_average", embed: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(doc_id, conflict, pair, from_ids, to_ids, sim): the best grouping of each conflict; all conflicts at once.

    What `variants` and `best_variants` would find among all C(n - 1, g - 1) groupings is found by dynamic programming over
    the few pairs that these share. Conflicts may have any length; what is scored grows with the cube of their lines.
    """
    pairs = grouping_pairs(conflicts)
    scored = written(pairs.join(pair_similarities(pairs, vectors, method, embed), ["doc_id", "from_ids", "to_ids"]), "pairs")
    each = scored.groupBy("doc_id", "conflict").agg(F.collect_list(F.struct("k", "a", "b", "sim")).alias("l")).select("doc_id", "conflict", *[F.col(f"l.{c}").alias(c) for c in ("k", "a", "b", "sim")])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            rows = []
            for doc, conflict, *columns in df.itertuples(index=False):
                for i, (x, y) in enumerate(best_groups(*map(np.asarray, columns)), 1):
                    rows.append((doc, conflict, i, x, y))
            yield pd.DataFrame(rows, columns=["doc_id", "conflict", "k", "a", "b"])

    kind = conflicts.schema["doc_id"].dataType.simpleString()
    chosen = each.mapInPandas(run, f"doc_id {kind}, conflict long, k int, a int, b int")
    return scored.join(chosen, ["doc_id", "conflict", "k", "a", "b"]).select("doc_id", "conflict", F.col("k").cast("long").alias("pair"), "from_ids", "to_ids", "sim")


def splice(match: DataFrame, conflicts: DataFrame, solved: DataFrame) -> DataFrame:
    """The match table with each solved conflict's rows, both ends included, replaced by its solution; sub_ids are counted anew.

    A solution belongs to the batch where its conflict starts; rows of batches in between go as well. Where two conflicts
    share an end row, its ids stay with the first.
    """
    ends = conflicts.join(solved.select("doc_id", "conflict").distinct(), ["doc_id", "conflict"], "left_semi").select("doc_id", F.struct(F.col("start.batch_id").alias("b"), F.col("start.sub_id").alias("s")).alias("lo"), F.struct(F.col("end.batch_id").alias("b"), F.col("end.sub_id").alias("s")).alias("hi"), "conflict")
    place = F.struct(F.col("batch_id").alias("b"), F.col("sub_id").alias("s"))
    inside = within(match.withColumn("p", place), ends, ["doc_id"], "p", "lo", "hi").select("doc_id", "batch_id", "sub_id")
    kept = match.join(inside, ["doc_id", "batch_id", "sub_id"], "left_anti").select("doc_id", "batch_id", "sub_id", F.lit(0).cast("long").alias("pair"), "from_ids", "to_ids", "sim")
    new = solved.join(ends, ["doc_id", "conflict"]).select("doc_id", F.col("lo.b").alias("batch_id"), F.col("lo.s").alias("sub_id"), "pair", "from_ids", "to_ids", "sim")
    # a chain of one row ends one conflict and starts the next: its ids must not occur twice
    w = Window.partitionBy("doc_id").orderBy("batch_id", "sub_id", "pair")
    both = kept.unionByName(new).withColumn("last", F.max(F.array_max("from_ids")).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    fresh = F.filter("from_ids", lambda x: F.col("last").isNull() | (x > F.col("last")))
    both = both.withColumn("from_ids", F.when(F.col("pair") > 0, fresh).otherwise(F.col("from_ids"))).where("size(from_ids) > 0")
    order = Window.partitionBy("doc_id", "batch_id").orderBy("sub_id", "pair")
    return both.select("doc_id", "batch_id", (F.row_number().over(order) - 1).cast("long").alias("sub_id"), "from_ids", "to_ids", "sim")


def all_conflicts(match: DataFrame, min_chain: int = 3, max_len: int = 6, handle_start: bool = False, handle_finish: bool = False, lengths: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The conflicts to solve and the rest."""
    found = C.conflicts(C.good_chains(match, min_chain, handle_start, handle_finish, lengths))
    return C.solvable(found, max_len), C.unsolvable(found, max_len)


def resolve_round(match: DataFrame, vectors: DataFrame, min_chain: int, max_len: int, handle_start: bool = False, handle_finish: bool = False, lengths: DataFrame | None = None, method: str = "weighted_average", embed: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One round: conflicts found, solved and spliced in for all documents; the result is written, so rounds don't pile up lineage."""
    todo, _ = all_conflicts(match, min_chain, max_len, handle_start, handle_finish, lengths)
    todo = written(todo, "conflicts")
    return written(splice(match, todo, written(solutions(todo, vectors, method, embed), "solutions")), "match")


def resolve_all(match: DataFrame, vectors: DataFrame, rounds: int = 3, method: str = "weighted_average", embed: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Rounds with growing chain length and conflict size, then a last one with short chains and large conflicts."""
    for i in range(rounds):
        match = resolve_round(match, vectors, 2 + i, 6 * (i + 1), method=method, embed=embed)
    return resolve_round(match, vectors, 2, LARGE, method=method, embed=embed)


def fix_start(match: DataFrame, vectors: DataFrame, max_len: int = 6) -> DataFrame:
    """A round that also treats what lies before the first chain of each document as a conflict."""
    return resolve_round(match, vectors, 2, max_len, handle_start=True)


def correct_conflicts(match: DataFrame, min_chain: int = 2, max_len: int = LARGE) -> DataFrame:
    """The match table with one to-id raised by 1 wherever that leaves its document fewer unsolvable conflicts.

    Tried are the start and then the end row of each conflict that steps back by at least 2 on the to-side. All trials
    of all documents are one table: a trial is a copy of its document. A document takes its best trial, the
    first of equals; call again to go on.
    """
    _, rest = all_conflicts(match, min_chain, max_len)
    back = rest.where("len_to < -1")
    spot = lambda e, o: back.select("doc_id", (F.col("conflict") * 2 + o).alias("trial"), F.col(f"{e}.batch_id").alias("tb"), F.col(f"{e}.sub_id").alias("ts"))
    trials = spot("start", 0).unionByName(spot("end", 1))
    raised = F.concat(F.array(F.element_at("to_ids", 1) + 1), F.slice("to_ids", 2, F.greatest(F.size("to_ids") - 1, F.lit(0))))
    hit = (F.col("batch_id") == F.col("tb")) & (F.col("sub_id") == F.col("ts"))
    tried = match.join(trials, "doc_id").withColumn("to_ids", F.when(hit, raised).otherwise(F.col("to_ids")))
    _, left = all_conflicts(tried.withColumn("doc_id", F.struct("doc_id", "trial")), min_chain, max_len)
    counts = trials.select("doc_id", "trial").distinct().join(left.groupBy(F.col("doc_id.doc_id").alias("doc_id"), F.col("doc_id.trial").alias("trial")).agg(F.count(F.lit(1)).alias("n")), ["doc_id", "trial"], "left")
    before = rest.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n0"))
    better = counts.withColumn("n", F.coalesce("n", F.lit(0))).join(before, "doc_id").where("n < n0").groupBy("doc_id").agg(F.min(F.struct("n", "trial")).alias("b"))
    chosen = trials.join(better.select("doc_id", F.col("b.trial").alias("trial")), ["doc_id", "trial"], "left_semi").drop("trial")
    return match.join(chosen, "doc_id", "left").withColumn("to_ids", F.when(F.coalesce(hit, F.lit(False)), raised).otherwise(F.col("to_ids"))).drop("tb", "ts")


def correct_all(match: DataFrame, min_chain: int = 2, max_len: int = LARGE) -> DataFrame:
    """`correct_conflicts` again and again until no document gets fewer unsolvable conflicts. Each call that changes something
    leaves a document at least one such conflict less, so there are no more calls than a document has conflicts."""
    match = written(match, "match")
    while True:
        with consumed(match.sparkSession) as keep:
            new = keep(correct_conflicts(match, min_chain, max_len), "match")
        if new.select(F.sum(F.xxhash64(*new.columns).cast("decimal(38,0)"))).first() == match.select(F.sum(F.xxhash64(*new.columns).cast("decimal(38,0)"))).first():
            return new
        match = new


def conflict_lines(found: DataFrame, lines: DataFrame) -> DataFrame:
    """The lines of each conflict on either side."""
    side = lambda s: found.select("doc_id", "conflict", F.lit(s).alias("side"), F.col(f"start.{s}_id").alias("a"), F.col(f"end.{s}_id").alias("b"))
    both = side("from").unionByName(side("to")).where("b >= a").select("doc_id", "conflict", "side", F.explode(F.sequence("a", "b")).alias("line_id"))
    return both.join(lines, ["doc_id", "side", "line_id"]).select("doc_id", "conflict", "side", "line_id", "text")
