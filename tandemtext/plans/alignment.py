"""From two texts to an alignment that can be read: the operators in the order they are used."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandemtext.functions.durable import written
from tandemtext.operators import align, batching, books, correct, embed, lines, resolve, store


def prepared_lines(raw: DataFrame, lang: str) -> tuple[DataFrame, DataFrame]:
    """(lines with counters, meta) of raw lines of one language: split to sentences, marks taken out."""
    own = written(lines.split_lines(raw, lang), "sentences")
    return lines.handle_marks(own), lines.meta_lines(own)


def align_documents(both: DataFrame, vectors: DataFrame, size: int = 200, window: int = 50, shift: int = 0, segments: DataFrame | None = None, batch_ids: list[int] | None = None) -> DataFrame:
    """The match table of all documents of a line table with both sides; with `segments`, batches keep within these; `batch_ids` chooses batches."""
    batches = batching.plain_batches(store.line_counts(both), size, window, shift, batch_ids) if segments is None else batching.segment_batches(segments, both, size, window, shift, batch_ids)
    return align.align(batches, vectors, window)


def line_vectors(both: DataFrame, vectors: DataFrame | None, encoder: Callable | str, model: str = "", proxies: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(all vectors, the lines with the vectors to align by). Only what `vectors` lacks is encoded.

    Sides named in `proxies` are aligned by their proxy texts; a line without one by its own text. `vectors` is a vector table; rows of
    other models don't count.
    """
    if "proxy_text" not in both.columns:
        both = both.withColumn("proxy_text", F.lit(None).cast("string"))
    lines_ = both.withColumn("is_proxy", F.col("side").isin(*proxies) & F.col("proxy_text").isNotNull())
    if vectors is None:
        vectors = both.sparkSession.createDataFrame([], store.SCHEMAS["vector"])
    vectors = store.typed(vectors, "vector").withColumn("doc_id", F.col("doc_id").cast(both.schema["doc_id"].dataType))
    have = vectors.where(F.col("model") == model)
    for proxy in (False, True):
        if not proxy or proxies:
            have = embed.fill_vectors(lines_.where(F.col("is_proxy") == proxy), have, encoder, model, proxy)
    every = written(have.unionByName(vectors.where(~F.col("model").eqNullSafe(model))), "vectors")
    own = every.where(F.col("model") == model).select("doc_id", "side", "line_id", "is_proxy", "embedding")
    return every, lines_.join(own, ["doc_id", "side", "line_id", "is_proxy"]).drop("is_proxy")


def realigned(match: DataFrame | None, both: DataFrame, vectors: DataFrame | None, encoder: Callable | str, model: str = "", proxies: tuple[str, ...] = (), size: int = 200, window: int = 50, shift: int = 0, segments: DataFrame | None = None, batch_ids: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(match, vectors) after the chosen batches, or all, have been aligned, with the vectors that were there and those that were missing."""
    every, own = line_vectors(both, vectors, encoder, model, proxies)
    new = align_documents(both, own, size, window, shift, segments, batch_ids)
    return written(new if match is None else store.replace_batches(match, new), "match"), every


def align_texts(raw_from: DataFrame, raw_to: DataFrame, lang_from: str, lang_to: str, encoder: Callable | str, size: int = 200, window: int = 50, rounds: int = 3, fix_lengths: bool = False, shift: int = 0, proxy_from: DataFrame | None = None, proxy_to: DataFrame | None = None, vectors: DataFrame | None = None, model: str = "", marks: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Lines, meta, vectors, match and items of pairs of raw texts that share a doc_id: split, encoded, aligned and repaired.

    `proxy_from` and `proxy_to` are line tables of translations by which a side is aligned. What `vectors` holds is not encoded again.
    With `marks`, batches keep within the segments between these marks.
    """
    lf, mf = prepared_lines(raw_from, lang_from)
    lt, mt = prepared_lines(raw_to, lang_to)
    both, meta = written(lf.unionByName(lt), "lines"), mf.unionByName(mt)
    given = {s: p for s, p in (("from", proxy_from), ("to", proxy_to)) if p is not None}
    if given:
        table = functools.reduce(DataFrame.unionByName, [p.select("doc_id", F.lit(s).alias("side"), "line_id", "text") for s, p in given.items()])
        both = written(lines.with_proxy(both, table), "lines")
    parts = lines.segments(meta, both.groupBy("doc_id", "side").agg(F.count(F.lit(1)).alias("n")), marks) if marks else None
    every, own = line_vectors(both, vectors, encoder, model, tuple(given))
    own = written(own, "line-vectors")
    match = written(align_documents(both, own, size, window, shift, parts), "match")
    match = resolve.resolve_all(match, own, rounds)
    if fix_lengths:
        match = written(corrected(match, own), "corrected")
    return {"line": both, "meta": meta, "vector": every, "match": match, "items": books.aligned_items(match, both)}


def corrected(match: DataFrame, lines_with_vectors: DataFrame) -> DataFrame:
    """The match table with pairs of unlikely length regrouped where a regrouping scores better by similarity."""
    items = written(books.aligned_items(match, lines_with_vectors), "items")
    ratios = correct.length_ratios(items)
    marked = written(correct.outliers(ratios, correct.outlier_bounds(ratios)), "outliers")
    tasks = written(correct.correction_tasks(marked), "tasks")
    found = written(correct.task_variants(tasks, items), "task-variants")
    best = correct.best_corrections(correct.score_by_similarity(found, lines_with_vectors), least_is_best=False)
    return correct.apply_corrections(match, items, tasks, found, written(best, "best")).withColumn("sim", F.lit(None).cast("double"))
