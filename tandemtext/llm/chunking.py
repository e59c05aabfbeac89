"""Passages that repeat across documents: content-defined chunks by a gear hash, deduplicated by digest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandemtext.functions.durable import written
from tandemtext.llm.common import chunks, mix, table

#: Bytes that the gear hash sees, and bytes on either side among which a cut has the largest hash: chunks of 33 bytes on average.
GEAR_WINDOW, REACH = 16, 16
#: A run of repeated chunks counts as a repeated passage from this many words on. A passage loses up to about 130
#: bytes at its ends, where chunks reach out of it; so passages of 50 words surely pass and short common lines don't.
MIN_WORDS = 24
#: Digests that many documents hold are gathered apart: their statistics are combined before the shuffle and sent to all tasks, so
#: that their rows need not meet in one. Which are so common is guessed from a share of the documents: those met COMMON times
#: and more in it, of these the MOST_COMMON most frequent. All others meet in one task each; the result is the same.
SHARE, COMMON, MOST_COMMON = 0.05, 16, 10_000
_PAD = 2 * (GEAR_WINDOW + REACH)
_GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def _back(x: np.ndarray, by: int) -> np.ndarray:
    out = np.zeros_like(x)
    out[by:] = x[:-by]
    return out


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The gear hash h = (h << 1) + G[byte] at each byte, over the last GEAR_WINDOW bytes, all at once by doubling."""
    h, k = _GEAR[data], 1
    while k < GEAR_WINDOW:
        h = h + (_back(h, k) << np.uint32(k))
        k *= 2
    return h


def cuts(data: np.ndarray) -> np.ndarray:
    """Positions after which a chunk ends: the hash is larger than the REACH before and not smaller than the REACH after.

    A cut depends on GEAR_WINDOW + REACH bytes before and REACH bytes after it and on nothing else, so an
    insertion moves only the cuts next to it. Bytes that repeat without end have equal hashes and no cut.
    """
    h = gear_hashes(data)
    most, k = h, 1
    while k < REACH:
        most = np.maximum(most, _back(most, k))
        k *= 2
    left = _back(most, 1)
    right = np.zeros_like(most)
    right[:-REACH] = most[REACH:]
    return np.flatnonzero((h > left) & (h >= right))


def chunk_spans(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """(number of the text, start in it, end in it, words starting in it, place in the buffer, buffer) of each chunk, in order."""
    pad = b"\0" * _PAD
    buffer = pad + b"".join(t + pad for t in texts)
    data = np.frombuffer(buffer, np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = _PAD + np.cumsum(np.r_[0, sizes[:-1] + _PAD])
    c = cuts(data) + 1
    which = np.searchsorted(begin, c, "right") - 1
    inside = (which >= 0) & (c - begin[which] < sizes[which]) & (c > begin[which])
    c, which = c[inside], which[inside]
    full = np.flatnonzero(sizes > 0)
    start = np.r_[begin[full], c]
    owner = np.r_[full, which]
    order = np.argsort(start, kind="stable")
    start, owner = start[order], owner[order]
    last = np.r_[owner[1:] != owner[:-1], True][: len(owner)]
    end = np.where(last, begin[owner] + sizes[owner], np.r_[start[1:], 0][: len(start)])
    space = (data <= 32)
    word = np.cumsum(np.r_[False, space[:-1] & ~space[1:]])
    words = word[end - 1] - word[start - 1] if len(start) else np.zeros(0, np.int64)
    return owner, start - begin[owner], end - begin[owner], words, start, buffer


def _cut(b: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(owner, start, end, words, digests as two int64) of the chunks of a batch's texts."""
    texts = [t.encode("utf-8", "surrogatepass") if t else b"" for t in b.column(column).to_pylist()]
    owner, start, end, words, place, buffer = chunk_spans(texts)
    view, digest = memoryview(buffer), xxhash.xxh3_128_digest
    d = np.frombuffer(b"".join([digest(view[x:y]) for x, y in zip(place.tolist(), (place + end - start).tolist(), strict=True)]), np.int64).reshape(-1, 2)
    return owner, start, end, words, d


def _identified(docs: DataFrame) -> DataFrame:
    """(doc_id, u, text): `u` tells documents apart, a hash of doc_id and text, so rows alike in both are one document."""
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("u"), "text")


def text_chunks(docs: DataFrame) -> DataFrame:
    """(d1, d2, doc_id, u, start, n, words): every chunk of every text with its 128-bit digest, byte place and words. Null and empty
    texts have no chunks."""
    schema = T.StructType([T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType()), docs.schema["doc_id"], *[T.StructField(n, t) for n, t in (("u", T.LongType()), ("start", T.IntegerType()), ("n", T.IntegerType()), ("words", T.IntegerType()))]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in chunks(whole, 2):
                owner, start, end, words, d = _cut(b, 2)
                if len(owner):
                    at = pa.array(owner)
                    columns = [pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy()), b.column(0).take(at), b.column(1).take(at), pa.array(start.astype(np.int32)), pa.array((end - start).astype(np.int32)), pa.array(words.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return _identified(docs).mapInArrow(run, schema)


def common_digests(docs: DataFrame, share: float | None = None) -> DataFrame:
    """(d1, d2) of at most MOST_COMMON digests that a `share` of `docs`, or SHARE, has COMMON times and more, the most frequent ones. They
    decide where rows go and nothing else: their statistics are then taken over all texts."""
    share = SHARE if share is None else share
    met = text_chunks(docs if share >= 1 else docs.sample(share, 7)).groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n"))
    return met.where(F.col("n") >= COMMON).orderBy(F.desc("n"), "d1", "d2").limit(MOST_COMMON).select("d1", "d2")


def common_statistics(docs: DataFrame, common: DataFrame) -> DataFrame:
    """(d1, d2, u0, u1, first): of each common digest the least and largest `u` and the least doc_id over all texts. Combined in each
    task before the shuffle; `common` has MOST_COMMON rows at most, which the tasks are given."""
    given = {(r["d1"], r["d2"]) for r in common.collect()}
    shared = docs.sparkSession.sparkContext.broadcast(np.array(sorted(given), np.int64).reshape(-1, 2))
    schema = T.StructType([T.StructField("at", T.LongType()), T.StructField("id", docs.schema["doc_id"].dataType), T.StructField("u0", T.LongType()), T.StructField("u1", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        first = known[:, 0]
        held: list[pa.Table] = []
        for whole in batches:
            for b in chunks(whole, 2):
                owner, _, _, _, d = _cut(b, 2)
                if not len(owner) or not len(known):
                    continue
                # digests are sorted; more than one may share its first half, so all of these are looked at
                low, high = np.searchsorted(first, d[:, 0], "left"), np.searchsorted(first, d[:, 0], "right")
                rows, at = [], []
                for k in range(int((high - low).max())):
                    ok = np.flatnonzero(low + k < high)
                    ok = ok[known[low[ok] + k, 1] == d[ok, 1]]
                    rows.append(ok)
                    at.append(low[ok] + k)
                if rows and sum(map(len, rows)):
                    of = pa.array(owner[np.concatenate(rows)])
                    t = pa.table({"at": np.concatenate(at), "id": b.column(0).take(of), "u": b.column(1).take(of)})
                    held.append(t.group_by("at").aggregate([("id", "min"), ("u", "min"), ("u", "max")]).rename_columns(["at", "id", "u0", "u1"]))
        if held:
            t = pa.concat_tables(held).group_by("at").aggregate([("id", "min"), ("u0", "min"), ("u1", "max")]).rename_columns(schema.names)
            yield from t.combine_chunks().to_batches()

    got = _identified(docs).mapInArrow(run, schema).groupBy("at").agg(F.min("id").alias("id"), F.min("u0").alias("u0"), F.max("u1").alias("u1"))
    named = docs.sparkSession.createDataFrame([(i, *p) for i, p in enumerate(sorted(given))], "at long, d1 long, d2 long")
    return got.join(F.broadcast(named), "at").select("d1", "d2", "u0", "u1", F.struct(F.col("id").isNull().alias("no"), F.col("id").alias("id")).alias("first"))


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, start_byte, n_bytes, n_words, first_doc_id): the longest runs of chunks that also occur in another document.

    first_doc_id is the least doc_id, null ones last, that holds a chunk of the run; an occurrence in another
    document is the one to delete. Runs of fewer than `min_words` words are left out. A passage that repeats within
    one document only is no repeat. Null and empty texts have none; of rows alike in doc_id and text one counts. Very long
    texts are cut whole. Other columns, whatever their names, are ignored. Empty input: no rows.
    """
    docs = docs.select("doc_id", "text")
    common = written(common_statistics(docs, common_digests(docs)), "common").select("d1", "d2", F.col("u0").alias("c0"), F.col("u1").alias("c1"), F.col("first").alias("c"))
    # the rows of a common digest know what they need and are spread; those of others meet
    every = text_chunks(docs).join(F.broadcast(common), ["d1", "d2"], "left").withColumn("salt", F.when(F.col("c0").isNotNull(), F.col("u")).otherwise(F.lit(0)))
    same = Window.partitionBy("d1", "d2", "salt")
    who = F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("id"))
    seen = every.select("*", F.coalesce("c0", F.min("u").over(same)).alias("u0"), F.coalesce("c1", F.max("u").over(same)).alias("u1"), F.coalesce("c", F.min(who).over(same)).alias("first"))
    again = seen.where("u0 != u1").select("doc_id", "u", "start", "n", "words", "first")
    own = again.repartition("u").dropDuplicates(["u", "start"])
    order = Window.partitionBy("u").orderBy("start")
    own = own.withColumn("new", (F.lag(F.col("start") + F.col("n")).over(order) != F.col("start")).cast("int"))
    own = own.withColumn("run", F.sum(F.coalesce("new", F.lit(1))).over(order))
    runs = own.groupBy("u", "run").agg(F.first("doc_id").alias("doc_id"), F.min("start").cast("long").alias("start_byte"), F.sum("n").alias("n_bytes"), F.sum("words").alias("n_words"), F.min("first").alias("first"))
    return runs.where(F.col("n_words") >= min_words).select("doc_id", "start_byte", "n_bytes", "n_words", F.col("first.id").alias("first_doc_id"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every repeated passage of every document, with the document that holds it first."""
    return repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
