"""Pairs of unlikely length, and the regroupings of their neighbourhoods that fit better.

An item table has (doc_id, pos, from_ids, to_ids, text_from, text_to), `pos` being its place in the document.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandemtext.functions.vectors import aggregate_vectors, cosine

N_STD, MIN_TEXT = 1.5, 10


def n_words(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(r"(?U)\S+")), F.lit(0))


def _ratio(a: Column, b: Column) -> Column:
    return F.least(a, b) / F.greatest(a, b, F.lit(1))


def length_ratios(items: DataFrame, text_from: str = "text_from", text_to: str = "text_to") -> DataFrame:
    """`items` with len_from, len_to, char_ratio and word_ratio: the shorter over the longer text. Null texts count as empty."""
    f, t = F.coalesce(F.col(text_from), F.lit("")), F.coalesce(F.col(text_to), F.lit(""))
    return items.withColumns({"len_from": F.length(f).cast("long"), "len_to": F.length(t).cast("long"), "char_ratio": _ratio(F.length(f), F.length(t)), "word_ratio": _ratio(n_words(f), n_words(t))})


def outlier_bounds(ratios: DataFrame, n_std: float = N_STD, by: list[str] | None = None) -> DataFrame:
    """One row (for each `by`): mean and mean +- n_std sample deviations of both ratios."""
    agg = []
    for r in ("char", "word"):
        m, s = F.avg(f"{r}_ratio"), F.stddev_samp(f"{r}_ratio")
        agg += [m.alias(f"{r}_mean"), (m - n_std * s).alias(f"{r}_low"), (m + n_std * s).alias(f"{r}_high")]
    return ratios.groupBy(*(by or [])).agg(*agg)


def outliers(ratios: DataFrame, bounds: DataFrame, min_text: int = MIN_TEXT, by: list[str] | None = None) -> DataFrame:
    """`ratios` with is_outlier: a ratio outside its closed interval, and both texts longer than `min_text`. Bounds of one row are broadcast."""
    both = ratios.join(bounds, by) if by else ratios.crossJoin(F.broadcast(bounds))
    out = [~F.col(f"{r}_ratio").between(F.col(f"{r}_low"), F.col(f"{r}_high")) for r in ("char", "word")]
    long = (F.col("len_from") > min_text) & (F.col("len_to") > min_text)
    return both.withColumn("is_outlier", F.coalesce((out[0] | out[1]) & long, F.lit(False)))


def correction_tasks(items: DataFrame) -> DataFrame:
    """(doc_id, task, pos): the items of each task: outliers with the item before and after, joined where these overlap.

    Outliers at most two places apart share an item. No outliers: no tasks.
    """
    w = Window.partitionBy("doc_id").orderBy("pos")
    spot = items.withColumn("end", F.max("pos").over(Window.partitionBy("doc_id"))).where("is_outlier").select("doc_id", "pos", "end")
    own = spot.withColumn("new", F.coalesce((F.col("pos") - F.lag("pos").over(w) > 2).cast("int"), F.lit(1))).withColumn("task", F.sum("new").over(w).cast("long"))
    first = items.groupBy("doc_id").agg(F.min("pos").alias("begin"))
    span = own.groupBy("doc_id", "task").agg(F.min("pos").alias("a"), F.max("pos").alias("b"), F.max("end").alias("end")).join(first, "doc_id")
    return span.select("doc_id", "task", F.explode(F.sequence(F.greatest(F.col("a") - 1, F.col("begin")), F.least(F.col("b") + 1, F.col("end")))).alias("pos"))


Pair = tuple[tuple[int, ...], tuple[int, ...]]


def walk(pairs: list[Pair], exhaustive: bool = False) -> list[list[Pair]]:
    """The regroupings of a list of pairs in which first elements of a pair move to the pair before it.

    At each pair: nothing moves, or the first from-line, the first to-line, or both of the next pair. As a rule a state of two
    neighbouring pairs that was seen before, whatever came earlier, is not followed again; `exhaustive` follows
    all. Regroupings with a one-sided pair are left out, pairs that were emptied on both sides are dropped.
    """
    found: list[list[Pair]] = []
    added: set[tuple[Pair, ...]] = set()
    seen: set[tuple[Pair, Pair]] = set()
    # a stack of steps instead of recursion: tasks may be long
    pending: list[tuple[Pair, int, tuple[Pair, ...], tuple[Pair, Pair] | None]] = [(pairs[0], 1, (), None)] if pairs else []
    while pending:
        here, i, before, state = pending.pop()
        if state is not None and not exhaustive:
            if state in seen:
                continue
            seen.add(state)
        if i == len(pairs):
            whole = tuple(p for p in (*before, here) if p[0] or p[1])
            if all(p[0] and p[1] for p in whole) and whole not in added:
                added.add(whole)
                found.append(list(whole))
            continue
        f, t = pairs[i]
        branches: list[tuple[Pair, int, tuple[Pair, ...], tuple[Pair, Pair] | None]] = [((f, t), i + 1, (*before, here), None)]
        for mf, mt in ((1, 0), (0, 1), (1, 1)):
            if len(f) < mf or len(t) < mt:
                continue
            left, right = (here[0] + f[:mf], here[1] + t[:mt]), (f[mf:], t[mt:])
            branches.append((right, i + 1, (*before, left), (left, right)))
        pending.extend(reversed(branches))
    return found


def task_variants(tasks: DataFrame, items: DataFrame, exhaustive: bool = False) -> DataFrame:
    """(doc_id, task, variant, pair, from_ids, to_ids): the regroupings of each task, numbered in the order of the walk.

    The walk depends on what it has seen, so each task is walked in one place, many tasks to a batch.
    """
    own = tasks.join(items.select("doc_id", "pos", "from_ids", "to_ids"), ["doc_id", "pos"]).groupBy("doc_id", "task").agg(F.array_sort(F.collect_list(F.struct("pos", "from_ids", "to_ids"))).alias("l"))
    own = own.select("doc_id", "task", F.col("l.from_ids").alias("f"), F.col("l.to_ids").alias("t"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            rows = []
            for doc, task, f, t in zip(df["doc_id"], df["task"], df["f"], df["t"], strict=True):
                pairs = [(tuple(map(int, a)), tuple(map(int, b))) for a, b in zip(f, t, strict=True)]
                for v, variant in enumerate(walk(pairs, exhaustive)):
                    rows += [(doc, task, v, k, list(a), list(b)) for k, (a, b) in enumerate(variant, 1)]
            yield pd.DataFrame(rows, columns=["doc_id", "task", "variant", "pair", "from_ids", "to_ids"])

    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInPandas(run, f"doc_id {kind}, task long, variant long, pair long, from_ids array<long>, to_ids array<long>")


def _texts(variants: DataFrame, lines: DataFrame) -> DataFrame:
    """`variants` with text_from and text_to, the joined lines of each pair; every group is joined once."""
    out = variants
    for s in ("from", "to"):
        own = variants.select("doc_id", F.col(f"{s}_ids").alias("ids")).distinct()
        rows = own.select("*", F.posexplode("ids").alias("at", "line_id")).join(lines.where(F.col("side") == s), ["doc_id", "line_id"])
        joined = rows.groupBy("doc_id", "ids").agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"])).alias(f"text_{s}"))
        out = out.join(joined.withColumnRenamed("ids", f"{s}_ids"), ["doc_id", f"{s}_ids"])
    return out


def score_by_length(variants: DataFrame, lines: DataFrame, bounds: DataFrame) -> DataFrame:
    """(doc_id, task, variant, score): the sum of how far the ratios of the pairs are from their means; less is better."""
    own = length_ratios(_texts(variants, lines)).crossJoin(F.broadcast(bounds.select("char_mean", "word_mean")))
    off = F.abs(F.col("char_mean") - F.col("char_ratio")) + F.abs(F.col("word_mean") - F.col("word_ratio"))
    return own.groupBy("doc_id", "task", "variant").agg(F.sum(off).alias("score"))


def score_by_similarity(variants: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, task, variant, score): the mean over pairs of cosine less a thousandth of the difference in length, plus 0.05 a pair.

    `lines` has text and embedding of each line. Vectors of a group are aggregated by logarithmic scaling.
    """
    own = _texts(variants, lines)
    for s in ("from", "to"):
        groups = variants.select("doc_id", F.col(f"{s}_ids").alias("ids")).distinct()
        rows = groups.select("*", F.explode("ids").alias("line_id")).join(lines.where(F.col("side") == s), ["doc_id", "line_id"]).withColumn("n", F.length("text"))
        got = aggregate_vectors(rows.select("doc_id", "ids", "embedding", "n"), ["doc_id", "ids"], "embedding", "n", "logarithmic_scaling")
        own = own.join(got.select("doc_id", F.col("ids").alias(f"{s}_ids"), F.col("embedding").alias(f"v_{s}")), ["doc_id", f"{s}_ids"], "left")
    sim = F.coalesce(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine(F.col("v_from"), F.col("v_to")))), F.lit(0.0))
    each = sim - 0.001 * F.abs(F.length("text_from") - F.length("text_to"))
    n = F.count(F.lit(1))
    return own.groupBy("doc_id", "task", "variant").agg((F.sum(each) / n + 0.05 * n).alias("score"))


def best_corrections(scores: DataFrame, least_is_best: bool) -> DataFrame:
    """The best variant of each task; the first of equals."""
    w = Window.partitionBy("doc_id", "task").orderBy(F.round("score", 12) if least_is_best else F.round("score", 12).desc(), "variant")
    return scores.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def apply_corrections(match: DataFrame, items: DataFrame, tasks: DataFrame, variants: DataFrame, best: DataFrame) -> DataFrame:
    """The match table with the rows of each task replaced by its best variant. `items` also has batch_id and sub_id.

    A task's new rows belong to the batch of its first item. Tasks whose best variant is what they had are left as they are.
    """
    at = tasks.join(items.select("doc_id", "pos", "batch_id", "sub_id"), ["doc_id", "pos"])
    changed = best.where("variant > 0")
    gone = at.join(changed, ["doc_id", "task"], "left_semi")
    start = gone.groupBy("doc_id", "task").agg(F.min(F.struct("pos", "batch_id", "sub_id")).alias("s"))
    new = variants.join(changed.select("doc_id", "task", "variant"), ["doc_id", "task", "variant"], "left_semi").join(start, ["doc_id", "task"])
    new = new.select("doc_id", F.col("s.batch_id").alias("batch_id"), F.col("s.sub_id").alias("sub_id"), "pair", "from_ids", "to_ids")
    kept = match.join(gone.select("doc_id", "batch_id", "sub_id"), ["doc_id", "batch_id", "sub_id"], "left_anti").select("doc_id", "batch_id", "sub_id", F.lit(0).cast("long").alias("pair"), "from_ids", "to_ids")
    w = Window.partitionBy("doc_id", "batch_id").orderBy("sub_id", "pair")
    return kept.unionByName(new).select("doc_id", "batch_id", (F.row_number().over(w) - 1).cast("long").alias("sub_id"), "from_ids", "to_ids")
