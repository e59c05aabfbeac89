"""Quality selection by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandemtext.functions.durable import written
from tandemtext.functions.ranking import running_total
from tandemtext.llm.common import WORDS, chunks, mix, table, word_hashes

#: Buckets that word unigrams and bigrams are hashed to, and what is added to each count of the raw model.
BUCKETS, SMOOTHING = 1 << 16, 10.0
#: Bound of the labelled sample: the target model is fitted on at most this many good documents, those of least hash of doc_id.
TARGET_DOCS = 100_000
SEED = "resample-1"
_TOKENS = re.compile(r"\w+|[^\w\s]+")
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def ngram_buckets(text: str) -> np.ndarray:
    """The buckets of all unigrams and bigrams of a whole lower-case text, cut into words and runs of marks."""
    words = _TOKENS.findall(text.lower())
    if not words:
        return np.zeros(0, np.int64)
    h = word_hashes(words)
    pairs = mix(h[:-1] * _PRIME + h[1:])
    return (np.concatenate([h, pairs]) % np.uint64(BUCKETS)).astype(np.int64)


def bucket_counts(docs: DataFrame, flag: str) -> DataFrame:
    """(bucket, target, raw): how often each bucket occurs in texts where `flag` is true, and in all texts. Counted before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS), np.int64)
        for whole in batches:
            for b in chunks(whole, 0):
                at = [ngram_buckets(t) if t else np.zeros(0, np.int64) for t in b.column(0).to_pylist()]
                good = [x for x, g in zip(at, b.column(1).to_pylist(), strict=True) if g]
                counts[0] += np.bincount(np.concatenate([*good, np.zeros(0, np.int64)]), minlength=BUCKETS)
                counts[1] += np.bincount(np.concatenate(at), minlength=BUCKETS)
        used = np.flatnonzero(counts[1])
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[0][used]), pa.array(counts[1][used])], names=["bucket", "target", "raw"])

    parts = docs.select("text", F.coalesce(F.col(flag), F.lit(False)).alias("good")).mapInArrow(run, "bucket long, target long, raw long")
    return parts.groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw"))


def gathered(counts: DataFrame) -> np.ndarray:
    """Target and raw counts by bucket. At most BUCKETS rows come to the driver, whatever the corpus."""
    got = counts.toPandas()
    n = np.zeros((2, BUCKETS))
    n[0][got["bucket"]], n[1][got["bucket"]] = got["target"], got["raw"]
    return n


def log_weight(text: str | None, good: bool, n: np.ndarray) -> float:
    """The sum over the n-grams of a whole text of log p_target / p_raw, the text's own n-grams left out of both models.

    Without that, rare words would favour the documents that the target model was counted over. The target's
    smoothing is in proportion to its size, so n-grams that no other text has weigh nothing.
    """
    if not text:
        return 0.0
    at, own = np.unique(ngram_buckets(text), return_counts=True)
    if not len(at):
        return 0.0
    total = n.sum(axis=1) - [own.sum() * bool(good), own.sum()]
    if total[0] <= 0 or total[1] <= 0:
        return 0.0
    target = (n[0][at] - own * bool(good)) / total[0] + SMOOTHING / total[1]
    raw = (n[1][at] - own) / total[1] + SMOOTHING / total[1]
    return float((own * (np.log(target) - np.log(raw))).sum())


def scored(docs: DataFrame, flag: str, n: np.ndarray) -> DataFrame:
    """(doc_id, th, log_weight) of each row; 0 for null and empty texts."""
    shared = docs.sparkSession.sparkContext.broadcast(n)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("th", T.LongType()), T.StructField("log_weight", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for whole in batches:
            for b in chunks(whole, 2):
                w = [log_weight(t, g, counts) for t, g in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(w, pa.float64())], names=schema.names)

    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text", F.coalesce(F.col(flag), F.lit(False)).alias("good")).mapInArrow(run, schema)


def gumbel(seed: str = SEED) -> F.Column:
    """Standard Gumbel noise that depends on seed, doc_id and text only: it is the same whenever a row is computed again."""
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("th")), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: str = SEED, target_docs: int = TARGET_DOCS) -> DataFrame:
    """(doc_id, th, log_weight, sample_key): the documents sampled without replacement with weights p_target / p_raw.

    The target model is counted over whole texts that `labels` calls good (quality 1 and not toxic), at most
    `target_docs` of them; their ids are the one thing broadcast, so no text is shuffled. The raw model is counted over all texts. The sample holds the k largest sums of log weight and Gumbel noise; k is `share` of the rows, by default
    the share of the labelled documents that have quality 1. Ties of the key are broken by doc_id, then text; rows alike in
    both stay or go together, within k.

    Nulls: no text weighs log 1 = 0; a null label is not good, a null doc_id has no label. Documents labelled
    twice are good if any row says so. No labels: nothing is good, the share is 1 and all rows stay. Texts of any length are
    counted whole. Other columns, whatever their names, are ignored. Empty input: no rows.
    """
    good = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max((F.coalesce("quality", F.lit(0)) == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("good"), F.max(F.coalesce("quality", F.lit(0))).alias("quality"))
    if share is None:
        got = good.agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0]
        share = 1.0 if got is None else float(got)
    target = good.where("good").orderBy(F.xxhash64("doc_id"), "doc_id").limit(target_docs).select(F.col("doc_id").alias("__id"), F.lit(True).alias("__good"))
    target = written(target, "target")
    flagged = docs.select("doc_id", "text").join(F.broadcast(target), F.col("doc_id") == F.col("__id"), "left")
    found = scored(flagged, "__good", gathered(bucket_counts(flagged, "__good"))).withColumn("key", F.col("log_weight") + gumbel(seed))
    keyed = written(found.groupBy("doc_id", "th").agg(F.max("log_weight").alias("log_weight"), F.max("key").alias("key"), F.count(F.lit(1)).alias("rows")), "keys")
    k = keyed.agg(F.floor(F.coalesce(F.sum("rows"), F.lit(0)) * F.lit(share)).cast("long").alias("k"))
    ranked = running_total(keyed.withColumn("__order", -F.col("key")), ["__order", "doc_id", "th"], "rows", "__rank")
    kept = ranked.crossJoin(F.broadcast(k)).where(F.col("__rank") <= F.col("k"))
    return kept.select("doc_id", "th", "log_weight", F.col("key").alias("sample_key"))


def op9_quality_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sampled document with its log weight and sampling key."""
    kept = resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return kept.select("doc_id", F.round("log_weight", 6).alias("log_weight"), F.round("sample_key", 6).alias("sample_key"))
