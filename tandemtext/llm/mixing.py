"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandemtext.functions.durable import written
from tandemtext.functions.ranking import running_total
from tandemtext.llm.common import packed, table, unpacked

#: Weight of each named source; all others have DEFAULT_WEIGHT.
WEIGHTS: dict[str, float] = {"src0": 2.0}
DEFAULT_WEIGHT = 1.0
#: Share of all tokens that the mixture holds.
BUDGET_SHARE = 0.5
SEED = "mix-1"
#: Sources up to which the last kept key of each is broadcast.
BROADCAST_SOURCES = 10_000


def _shuffle_key(seed: str) -> F.Column:
    """Place of a document in the shuffled order: 16 hexadecimal digits of an MD5 over seed, doc_id and text."""
    return F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce(F.col("text"), F.lit("")))), 1, 16)


def _weight(weights: dict[str, float], default: float) -> F.Column:
    w = F.lit(float(default))
    for s, x in sorted(weights.items()):
        w = F.when(F.col("__source") == s, F.lit(float(x))).otherwise(w)
    return w


def schedule(docs: DataFrame, weights: dict[str, float] | None = None, default: float = DEFAULT_WEIGHT, share: float = BUDGET_SHARE, seed: str = SEED) -> DataFrame:
    """The queue up to the budget: (source, key, tokens, finish, total), one row for each shuffle key of a source.

    Documents of a source are served in the order of their shuffle keys. `finish`, the virtual finish time, is
    the source's tokens so far divided by its weight; `total` counts the tokens of the global order by finish
    time, which ends where it would pass floor(share * all tokens). Only keys and counts are shuffled; texts are not.

    Nulls: no source counts as the source ''; no text has 0 tokens; no doc_id has a key of its own. Rows alike in
    doc_id and text share a key: they finish together and stay or go together (ties are peers). Empty input: no rows.
    """
    narrow = docs.select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("__source"), _shuffle_key(seed).alias("__key"), F.coalesce(F.regexp_count(F.col("text"), F.lit(r"\S+")), F.lit(0)).cast("long").alias("__tokens"))
    keys = written(narrow.groupBy("__source", "__key").agg(F.sum("__tokens").alias("__tokens")), "mix-keys")
    served = running_total(keys, ["__source", "__key"], "__tokens", "__cum", by=["__source"])
    weight = _weight(weights if weights is not None else WEIGHTS, default)
    timed = written(served.where(weight > 0).withColumn("__finish", F.col("__cum") / weight).drop("__cum"), "mix-finish")
    budget = keys.agg(F.floor(F.sum("__tokens").cast("double") * F.lit(float(share))).cast("long").alias("__budget"))
    queue = running_total(timed, ["__finish", "__key", "__source"], "__tokens", "__total")
    return written(queue.crossJoin(F.broadcast(budget)).where(F.col("__total") <= F.col("__budget")).select(F.col("__source").alias("source"), F.col("__key").alias("key"), F.col("__tokens").alias("tokens"), F.col("__finish").alias("finish"), F.col("__total").alias("total")), "mix-queue")


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, default: float = DEFAULT_WEIGHT, share: float = BUDGET_SHARE, seed: str = SEED) -> DataFrame:
    """The documents of the mixture, all columns kept, globally range-sorted by virtual finish time.

    What `schedule` keeps of a source is a prefix of its shuffled order. Where there are at most BROADCAST_SOURCES sources, the
    last kept keys, one row a source, are broadcast, so documents beyond them are dropped before any shuffle. Beyond
    that number the next step does all by itself: finish times are joined by source and key, which
    spreads a source that holds most rows, and the documents are range-sorted. Null, tied, repeated and
    empty cases are those of `schedule`.
    """
    queue = schedule(docs, weights, default, share, seed).select(F.col("source").alias("__qs"), F.col("key").alias("__qk"), F.col("finish").alias("__finish"))
    used = ("doc_id", "text", "source")
    keyed = packed(docs, used).withColumn("__source", F.coalesce(F.col("source").cast("string"), F.lit(""))).withColumn("__key", _shuffle_key(seed))
    lasts = written(queue.groupBy(F.col("__qs").alias("__ls")).agg(F.max("__qk").alias("__last")), "mix-lasts")
    if lasts.count() <= BROADCAST_SOURCES:
        keyed = keyed.join(F.broadcast(lasts), (F.col("__source") == F.col("__ls")) & (F.col("__key") <= F.col("__last")))
    timed = keyed.join(queue, (F.col("__source") == F.col("__qs")) & (F.col("__key") == F.col("__qk")))
    return unpacked(timed.repartitionByRange(F.col("__finish"), F.col("__key"), F.col("__source")).sortWithinPartitions("__finish", "__key", "__source"), docs.columns, used)


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of the mixture with its virtual finish time and the tokens up to it, in queue order."""
    docs = table(spark, sf_dir, "documents")
    queue = schedule(docs)
    ids = docs.select("doc_id", F.coalesce(F.col("source"), F.lit("")).alias("__s"), _shuffle_key(SEED).alias("__k"))
    out = ids.join(queue, (F.col("__s") == F.col("source")) & (F.col("__k") == F.col("key")))
    return out.select("doc_id", "source", F.col("tokens").alias("n_tokens"), F.round("finish", 6).alias("finish_time"), F.col("total").alias("total_tokens")).orderBy("finish_time", "total_tokens")


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS source,
         substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, '-') || '|' || coalesce(text, '')), 1, 16) AS k,
         coalesce(len(regexp_extract_all(text, '[^ \t\n\f\r\v]+')), 0) AS n
  FROM documents),
g AS (SELECT source, k, sum(n) AS n FROM d GROUP BY source, k),
f AS (SELECT source, k, n, (sum(n) OVER (PARTITION BY source ORDER BY k))::DOUBLE / CASE WHEN source = 'src0' THEN 2.0 ELSE 1.0 END::DOUBLE AS fin FROM g),
q AS (SELECT *, sum(n) OVER (ORDER BY fin, k, source) AS total FROM f)
SELECT d.doc_id, q.source, q.n::BIGINT AS n_tokens, round(q.fin, 6) AS finish_time, q.total::BIGINT AS total_tokens
FROM d JOIN q ON d.source = q.source AND d.k = q.k
WHERE q.total <= floor((SELECT sum(n)::DOUBLE FROM g) * {BUDGET_SHARE})
"""
