"""Document fingerprints from Lempel-Ziv phrases, compared by minimum-hash signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandemtext.functions.components import connected_components
from tandemtext.functions.durable import written
from tandemtext.functions.runs import whole_keys
from tandemtext.llm.common import WORDS, chunks, mix, table, word_hashes
from tandemtext.llm.simhash import _forest

#: Minima of a signature; they are cut into BANDS bands of ROWS minima each, and documents that agree in a band are compared.
#: Two that share 0.6 of the minima, the least that is reported, meet with a probability of 0.98 by the banding formula.
BANDS, ROWS = 16, 3
MINIMA = BANDS * ROWS
#: Least share of equal minima, the estimated Jaccard similarity of the phrase sets, of a reported partner. Near copies with
#: a tenth of their words changed have about 0.8, other texts of one language below 0.3.
SIMILARITY = 0.6
_A = mix(np.arange(1, MINIMA + 1, dtype=np.uint64)) | np.uint64(1)
_B = mix(np.arange(1001, 1001 + MINIMA, dtype=np.uint64))
_MULT = np.uint64(0xD6E8FEB86659FD93)
#: So many similar pairs are held at once before they are reduced to a forest.
_PAIRS = 1_000_000


def phrases(words: list[str]) -> tuple[np.ndarray, list[str]]:
    """The dictionary of an LZ78 parse of words: for each phrase the number of the phrase it extends (0: none) and the word added.

    Phrases are numbered from 1. A last phrase that is in the dictionary already adds nothing.
    """
    found: dict[tuple[int, str], int] = {}
    get, node, n = found.get, 0, 0
    for w in words:
        key = (node, w)
        node = get(key)
        if node is None:
            n += 1
            found[key] = n
            node = 0
    return np.fromiter((k[0] for k in found), np.int64, n), [k[1] for k in found]


def phrase_hashes(parent: np.ndarray, word: list[str]) -> np.ndarray:
    """A 64-bit hash of the words of each phrase, for all phrases at once by doubling the length looked back."""
    up = np.r_[0, parent]
    value = np.r_[np.zeros(1, np.uint64), word_hashes(word) | np.uint64(1)]
    factor = np.full(len(up), _MULT)
    factor[0] = 1
    while up.any():
        value = value + factor * value[up]
        factor = factor * factor[up]
        up = up[up]
    return mix(value[1:])


def signature(text: str | None) -> tuple[int, bytes | None]:
    """(number of phrases, for each of MINIMA hash functions the low byte of its least value over the phrases).

    The words are those of the whole lower-case text. Null texts and texts without a word have no signature.
    """
    words = WORDS.findall(text.lower()) if text else []
    if not words:
        return 0, None
    h = phrase_hashes(*phrases(words))
    least = np.full(MINIMA, 0xFFFFFFFF, np.uint64)
    for at in range(0, len(h), 512):
        least = np.minimum(least, ((h[at : at + 512, None] * _A + _B) >> np.uint64(32)).min(axis=0))
    return len(h), least.astype(np.uint8).tobytes()


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n_phrases, sig): the signature of each row's whole text as MINIMA bytes, null for texts without a word."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_phrases", T.LongType()), T.StructField("sig", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in chunks(whole, 1):
                got = [signature(t) for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _ in got], pa.int64()), pa.array([s for _, s in got], pa.binary())], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _near_in_runs(keys: np.ndarray, v: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each row with another row of equal key and at least `least` equal minima: (row, most similar other, equal minima, root).

    Ties go to the least signature: rows of a key are sorted by it. Rows that any such pairs connect share their root.
    """
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    best, other, root = np.full(len(keys), -1), np.full(len(keys), -1), np.arange(len(keys))
    left, right, held = [], [], 0
    run_end = np.repeat(starts + sizes, sizes)
    rows, d = np.flatnonzero(run_end - np.arange(len(keys)) > 1), 1
    while len(rows):
        rows = rows[rows + d < run_end[rows]]
        for at in range(0, len(rows), 20_000):
            i = rows[at : at + 20_000]
            j = i + d
            same = (v[i] == v[j]).sum(axis=1)
            near = same >= least
            i, j, same = i[near], j[near], same[near]
            left.append(i)
            right.append(j)
            held += len(i)
            # later partners of i come in ascending order, so they win only if better; earlier ones of j in descending order
            up = same > best[i]
            best[i[up]], other[i[up]] = same[up], j[up]
            up = (same > best[j]) | (same == best[j]) & (i < other[j])
            best[j[up]], other[j[up]] = same[up], i[up]
            if held > _PAIRS:
                tied, to = _forest(len(keys), np.concatenate(left), np.concatenate(right))
                left, right, held = [tied], [to], 0
        d += 1
    if left:
        tied, to = _forest(len(keys), np.concatenate(left), np.concatenate(right))
        root[tied] = to
    ok = np.flatnonzero(best >= 0)
    return ok, other[ok], best[ok], root[ok]


def partners(sigs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(sig, other, equal, root): for each distinct signature the most similar other one, if they agree in a band and are similar
    enough, and the least signature of the group that all such pairs, not only the most similar, connect.

    `sigs` has one row per signature. Bands are rows: the key of a row is a hash of the band's number and minima. Ties
    go to the least signature.
    """
    keys = F.array(*[F.xxhash64(F.lit(b), F.substring("sig", b * ROWS + 1, ROWS)) for b in range(BANDS)])
    rows = sigs.select(F.explode(keys).alias("key"), "sig").repartition("key").sortWithinPartitions("key", "sig")
    least = int(np.ceil(similarity * MINIMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole_keys(batches):
            v = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(-1, MINIMA)
            i, j, n, r = _near_in_runs(b.column(0).to_numpy(zero_copy_only=False), v, least)
            if len(i):
                yield pa.RecordBatch.from_arrays([*(b.column(1).take(pa.array(x)) for x in (i, j)), pa.array(n.astype(np.int32)), b.column(1).take(pa.array(r))], names=["sig", "other", "equal", "root"])

    found = written(rows.mapInArrow(run, "sig binary, other binary, equal int, root binary"), "near-signatures")
    best = found.groupBy("sig").agg(F.min(F.struct((-F.col("equal")).alias("n"), F.col("other").alias("o"))).alias("b"))
    roots = connected_components(found, "sig", "root").withColumnRenamed("node", "sig")
    return best.join(roots, "sig").select("sig", F.col("b.o").alias("other"), (-F.col("b.n")).alias("equal"), "root")


def fingerprint_partners(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, n_phrases, fingerprint, partner_id, similarity, group_id): each row's fingerprint, its most similar other document,
    and its group.

    The fingerprint is a hash of the signature. A document with equals (the same signature in another row) has as partner the
    least doc_id of these other than its own; otherwise the least doc_id of the most similar signature. Without any of at
    least `similarity`, partner and similarity are null. All partners, equal or similar, are in one group, and a group holds
    what such pairs connect; its group_id is the fingerprint of its least signature, so a document alone has its own. Texts
    without a word have 0 phrases, no fingerprint and no group. A null doc_id is nobody's partner but has one. Repeated rows
    are repeated. Empty input: no rows.
    """
    all_rows = written(signatures(docs), "signatures")
    ids = all_rows.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("id1"), F.max("doc_id").alias("id9"))
    second = all_rows.where("sig is not null").join(ids.where("id1 != id9"), "sig").where("doc_id != id1").groupBy("sig").agg(F.min("doc_id").alias("id2"))
    groups = written(ids.select("sig", "id1").join(second, "sig", "left"), "equal-signatures")
    near = partners(groups.select("sig"), similarity)
    named = near.join(groups.select(F.col("sig").alias("other"), F.col("id1").alias("near_id")), "other")
    known = groups.join(named, "sig", "left")
    out = all_rows.join(known, "sig", "left")
    equal = F.when(F.col("doc_id").isNull() | (F.col("doc_id") != F.col("id1")), F.col("id1")).otherwise(F.col("id2"))
    partner = F.coalesce(equal, F.col("near_id"))
    hashed = lambda c: F.when(F.col("sig").isNotNull(), F.xxhash64(c))
    return out.select("doc_id", "n_phrases", hashed("sig").alias("fingerprint"), partner.alias("partner_id"), F.when(equal.isNotNull(), F.lit(1.0)).when(F.col("near_id").isNotNull(), F.round(F.col("equal") / float(MINIMA), 6)).alias("similarity"), hashed(F.coalesce("root", "sig")).alias("group_id"))


def op3_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's phrase count, fingerprint, most similar other document and group of similar ones."""
    return fingerprint_partners(table(spark, sf_dir, "documents"))
