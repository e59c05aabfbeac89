"""Queries over vectors: arithmetic, batches, band alignment, and conflict repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandemtext.functions import vectors as V
from tandemtext.operators import align, batching, chains, resolve, store
from tandemtext.plans import inputs as I

N, WIN = 25, 8


def cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    v = I.vector_lines(spark, d)
    a, b = v.where("side = 'from'"), v.where("side = 'to'").select("doc_id", "line_id", F.col("embedding").alias("u"))
    return a.join(b, ["doc_id", "line_id"]).select("doc_id", "line_id", F.round(V.cosine(F.col("embedding"), F.col("u")), 6).alias("cosine"), F.round(V.dot(F.col("embedding"), F.col("u")), 6).alias("dot"))


def l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    v = I.vector_lines(spark, d).select("doc_id", "side", "line_id", V.l2_normalize(F.transform("embedding", lambda x: x * F.col("line_id"))).alias("e"))
    return v.select("doc_id", "side", "line_id", F.posexplode("e").alias("i", "x")).select("doc_id", "side", "line_id", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


def _aggregate(method: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        v = I.vector_lines(spark, d).withColumn("n", F.length("text"))
        got = V.aggregate_vectors(v, ["doc_id", "side"], "embedding", "n", method)
        return got.select("doc_id", "side", F.posexplode("embedding").alias("i", "x")).select("doc_id", "side", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))

    return run


def _aggregate_sql(how: str) -> str:
    return f"""WITH {I.VECTOR_LINES},
p AS (SELECT doc_id, side, length(text)::DOUBLE AS n, generate_subscripts(e, 1) - 1 AS i, unnest(e) AS x FROM vl),
g AS (SELECT doc_id, side, i, {how} AS v FROM p GROUP BY ALL)
SELECT doc_id, side, i::BIGINT AS i, round(v / sqrt(sum(v * v) OVER (PARTITION BY doc_id, side)), 6) AS x FROM g"""


def _counts(spark: SparkSession, d: str) -> DataFrame:
    return store.line_counts(I.vector_lines(spark, d))


_COUNTS = "ct AS (SELECT doc_id, count(*) FILTER (side = 'from') AS l1, count(*) FILTER (side = 'to') AS l2 FROM vl GROUP BY doc_id)"


def _batches_sql(n: int, w: int, shift: int) -> str:
    return f"""{I.VECTOR_LINES}, {_COUNTS},
k0 AS (SELECT *, round_even(l2 * {n}.0 / l1, 0)::BIGINT AS k FROM ct WHERE l1 > 0),
b0 AS (SELECT *, unnest(range(((l1 + {n} - 1) // {n})::BIGINT)) AS batch_id FROM k0),
bt AS (SELECT doc_id, batch_id::BIGINT AS batch_id, (batch_id * {n})::BIGINT AS f0, least(batch_id * {n} + {n}, l1)::BIGINT AS f1,
  greatest(0, batch_id * k - {w} + {shift})::BIGINT AS t0,
  greatest(greatest(0, batch_id * k - {w} + {shift}), least(batch_id * k + k + {w} + {shift}, l2))::BIGINT AS t1 FROM b0)"""


def batches_plain(spark: SparkSession, d: str) -> DataFrame:
    return batching.plain_batches(_counts(spark, d), N, WIN)


def batches_shift(spark: SparkSession, d: str) -> DataFrame:
    return batching.plain_batches(_counts(spark, d), 30, 5, 7)


def aligned(spark: SparkSession, d: str) -> DataFrame:
    v = I.vector_lines(spark, d)
    return align.align(batching.plain_batches(store.line_counts(v), N, WIN), v, WIN)


_PAIRS = f"""{_batches_sql(N, WIN, 0)},
fr AS (SELECT doc_id, batch_id, unnest(range(f0, f1)) AS x, f0, f1 - f0 AS n1, t0, t1, t1 - t0 AS n2 FROM bt),
pr AS (SELECT fr.*, j, a.e AS v, b.e AS u FROM (SELECT *, unnest(range(t0, t1)) AS y FROM fr) fr, LATERAL (SELECT y - t0 AS j)
  JOIN vl a ON a.doc_id = fr.doc_id AND a.side = 'from' AND a.line_id = fr.x + 1
  JOIN vl b ON b.doc_id = fr.doc_id AND b.side = 'to' AND b.line_id = fr.y + 1
  WHERE j * (n1 / n2) > x - f0 - {WIN} AND j * (n1 / n2) < x - f0 + {WIN}),
si AS (SELECT doc_id, batch_id, x + 1 AS from_id, t0 + j + 1 AS to_id, greatest(list_cosine_similarity(v, u), 0.01) AS sim FROM pr)"""
_ALIGN = f"""{_PAIRS},
al AS (SELECT fr.doc_id, fr.batch_id, (fr.x - fr.f0)::BIGINT AS sub_id, (fr.x + 1)::BIGINT AS from_id, coalesce(m.to_id, fr.t0 + 1)::BIGINT AS to_id, coalesce(m.sim, 0) AS sim
  FROM fr LEFT JOIN (SELECT doc_id, batch_id, from_id, arg_max(to_id, sim) AS to_id, max(sim) AS sim FROM si GROUP BY ALL) m
  ON m.doc_id = fr.doc_id AND m.batch_id = fr.batch_id AND m.from_id = fr.x + 1)"""


def align_band(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: for each from-line its best to-line within the band."""
    return aligned(spark, d).select("doc_id", "batch_id", "sub_id", F.col("from_ids")[0].alias("from_id"), F.col("to_ids")[0].alias("to_id"), F.round("sim", 6).alias("sim"))


def similarity_band(spark: SparkSession, d: str) -> DataFrame:
    v = I.vector_lines(spark, d)
    return align.similarities(batching.plain_batches(store.line_counts(v), N, WIN), v, WIN).withColumn("sim", F.round("sim", 6))


def align_unmatched_default(spark: SparkSession, d: str) -> DataFrame:
    """Window 0 leaves no pair eligible, so every line gets the first to-line of its batch."""
    v = I.vector_lines(spark, d)
    got = align.unmatched(align.align(batching.plain_batches(store.line_counts(v), 40, 0), v, 0))
    return got.select("doc_id", "batch_id", "sub_id", F.col("from_ids")[0].alias("from_id"), F.col("to_ids")[0].alias("to_id"), "sim")


def _conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Conflicts by rule over the vector lines: boundaries every 12 lines of each document, the sides differing in length."""
    v = store.line_counts(I.vector_lines(spark, d)).withColumn("k", F.floor((F.least("l1", "l2") - 6) / 12)).where("k >= 1")
    own = v.select("doc_id", F.explode(F.sequence(F.lit(1).cast("long"), "k")).alias("conflict"))
    at = F.col("conflict") * 12
    point = lambda f, t, k: F.struct(f.alias("from_id"), t.alias("to_id"), F.lit(0).cast("long").alias("batch_id"), (at + k).alias("sub_id"))
    a, b = (F.col("conflict") % 4 + 1), (F.col("conflict") * 2 % 5 + 1)
    return own.select("doc_id", "conflict", point(at, at, 0).alias("start"), point(at + a, at + b, 6).alias("end"), a.alias("len_from"), b.alias("len_to"))


_VARIANTS = f"""{I.VECTOR_LINES}, {_COUNTS},
cf AS (SELECT doc_id, c AS conflict, c * 12 AS s, c % 4 + 2 AS nf, c * 2 % 5 + 2 AS nt FROM (SELECT doc_id, unnest(range(1, (least(l1, l2) - 6) // 12 + 1)) AS c FROM ct)),
vm AS (SELECT *, greatest(nf, nt) AS n, least(nf, nt) AS g, unnest(range((1 << (greatest(nf, nt) - 1))::BIGINT)) AS m FROM cf),
vc AS (SELECT *, list_concat([0], list_filter(range(1, n), lambda i: (m >> (i - 1)) & 1 = 1), [n]) AS cuts FROM vm WHERE bit_count(m) = g - 1),
vn AS (SELECT *, row_number() OVER (PARTITION BY doc_id, conflict ORDER BY cuts) - 1 AS variant FROM vc),
vp AS (SELECT *, unnest(range(1, g + 1)) AS k FROM vn),
va AS (SELECT doc_id, conflict::BIGINT AS conflict, variant::BIGINT AS variant, k::BIGINT AS pair,
  CASE WHEN nf < nt THEN [s + k - 1] ELSE range(s + cuts[k], s + cuts[k + 1]) END AS from_ids,
  CASE WHEN nf < nt THEN range(s + cuts[k], s + cuts[k + 1]) ELSE [s + k - 1] END AS to_ids FROM vp)"""


def conflict_variants(spark: SparkSession, d: str) -> DataFrame:
    got = resolve.variants(_conflicts(spark, d))
    return got.select("doc_id", "conflict", "variant", "pair", F.concat_ws(",", F.col("from_ids").cast("array<string>")).alias("from_ids"), F.concat_ws(",", F.col("to_ids").cast("array<string>")).alias("to_ids"))


def best_variant(spark: SparkSession, d: str) -> DataFrame:
    found = resolve.variants(_conflicts(spark, d))
    sims = resolve.pair_similarities(found, I.vector_lines(spark, d))
    return resolve.best_variants(found, sims).select("doc_id", "conflict", "variant", F.round("score", 5).alias("score"))


_GROUPS = """gr AS (SELECT DISTINCT doc_id, 'from' AS side, from_ids AS ids FROM va UNION SELECT DISTINCT doc_id, 'to', to_ids FROM va),
gl AS (SELECT doc_id, side, ids, unnest(ids) AS line_id FROM gr),
gx AS (SELECT gl.doc_id, gl.side, ids, length(text)::DOUBLE AS n, generate_subscripts(e, 1) AS i, unnest(e) AS x FROM gl JOIN vl USING (doc_id, side, line_id)),
gv AS (SELECT doc_id, side, ids, i, sum(x * n) / sum(n) AS v FROM gx GROUP BY ALL),
ge AS (SELECT doc_id, side, ids, list(v ORDER BY i) AS e FROM gv GROUP BY ALL),
sc AS (SELECT va.doc_id, conflict, variant, greatest(round(sum(list_cosine_similarity(a.e, b.e)), 12), 0) AS score FROM va
  JOIN ge a ON a.doc_id = va.doc_id AND a.side = 'from' AND a.ids = va.from_ids JOIN ge b ON b.doc_id = va.doc_id AND b.side = 'to' AND b.ids = va.to_ids GROUP BY ALL)"""


def solved_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """The best grouping of each conflict, found by dynamic programming over the pairs that groupings share."""
    got = resolve.solutions(_conflicts(spark, d), I.vector_lines(spark, d))
    return got.select("doc_id", "conflict", "pair", F.concat_ws(",", F.col("from_ids").cast("array<string>")).alias("from_ids"), F.concat_ws(",", F.col("to_ids").cast("array<string>")).alias("to_ids"))


def resolved_round(spark: SparkSession, d: str) -> DataFrame:
    """A whole round over the band alignment: conflicts found, solved and spliced in."""
    got = resolve.resolve_round(aligned(spark, d), I.vector_lines(spark, d), 2, 8)
    return got.select("doc_id", "batch_id", "sub_id", F.concat_ws(",", F.col("from_ids").cast("array<string>")).alias("from_ids"), F.concat_ws(",", F.col("to_ids").cast("array<string>")).alias("to_ids"))


def score_after_repair(spark: SparkSession, d: str) -> DataFrame:
    got = chains.chain_score(resolve.resolve_round(aligned(spark, d), I.vector_lines(spark, d), 2, 8), "both")
    return got.withColumn("score", F.round("score", 6))


def missing_embeddings(spark: SparkSession, d: str) -> DataFrame:
    v = I.vector_lines(spark, d)
    have = v.where("line_id % 5 <> 0").select("doc_id", "side", "line_id", F.lit(False).alias("is_proxy"), "embedding")
    return store.missing_vectors(v, have).select("doc_id", "side", "line_id")


QUERIES = {
    "cosine_pairs": cosine_pairs, "l2_normalize": l2_normalize, **{f"vec_{m}": _aggregate(m) for m in V.METHODS}, "batches_plain": batches_plain, "batches_shift": batches_shift, "align_band": align_band,
    "similarity_band": similarity_band, "align_unmatched_default": align_unmatched_default, "conflict_variants": conflict_variants, "best_variant": best_variant, "solved_conflicts": solved_conflicts, "resolved_round": resolved_round,
    "score_after_repair": score_after_repair, "missing_embeddings": missing_embeddings,
}

ORACLES = {
    "cosine_pairs": f"WITH {I.VECTOR_LINES} SELECT a.doc_id, a.line_id, round(list_cosine_similarity(a.e, b.e), 6) AS cosine, round(list_dot_product(a.e, b.e), 6) AS dot FROM vl a JOIN vl b USING (doc_id, line_id) WHERE a.side = 'from' AND b.side = 'to'",
    "l2_normalize": f"WITH {I.VECTOR_LINES}, n AS (SELECT *, sqrt(list_dot_product(e, e)) * line_id AS s FROM vl) SELECT doc_id, side, line_id, (generate_subscripts(e, 1) - 1)::BIGINT AS i, round(unnest(e) * line_id / s, 6) AS x FROM n",
    "vec_weighted_average": _aggregate_sql("sum(x * n) / sum(n)"), "vec_length_scaling": _aggregate_sql("avg(x * n)"), "vec_max_pooling": _aggregate_sql("max(x)"), "vec_logarithmic_scaling": _aggregate_sql("avg(x * ln(1 + n))"),
    "batches_plain": f"WITH {_batches_sql(N, WIN, 0)} SELECT * FROM bt", "batches_shift": f"WITH {_batches_sql(30, 5, 7)} SELECT * FROM bt",
    "align_band": f"WITH {_ALIGN} SELECT doc_id, batch_id, sub_id, from_id, to_id, round(sim, 6) AS sim FROM al",
    "similarity_band": f"WITH {_PAIRS} SELECT doc_id, batch_id, from_id::BIGINT AS from_id, to_id::BIGINT AS to_id, round(sim, 6) AS sim FROM si",
    "align_unmatched_default": f"WITH {_batches_sql(40, 0, 0)}, x AS (SELECT *, unnest(range(f0, f1)) AS x FROM bt) SELECT doc_id, batch_id, (x - f0)::BIGINT AS sub_id, (x + 1)::BIGINT AS from_id, (t0 + 1)::BIGINT AS to_id, 0.0::DOUBLE AS sim FROM x",
    "conflict_variants": f"WITH {_VARIANTS} SELECT doc_id, conflict, variant, pair, array_to_string(from_ids, ',') AS from_ids, array_to_string(to_ids, ',') AS to_ids FROM va",
    "best_variant": f"WITH {_VARIANTS}, {_GROUPS} SELECT doc_id, conflict, arg_max(variant, (round(score, 9), -variant)) AS variant, round(max(score), 5) AS score FROM sc GROUP BY ALL",
    "solved_conflicts": f"WITH {_VARIANTS}, {_GROUPS}, bv AS (SELECT doc_id, conflict, arg_max(variant, (round(score, 9), -variant)) AS variant FROM sc GROUP BY ALL) SELECT doc_id, conflict, pair, array_to_string(from_ids, ',') AS from_ids, array_to_string(to_ids, ',') AS to_ids FROM va JOIN bv USING (doc_id, conflict, variant)",
    "missing_embeddings": f"WITH {I.VECTOR_LINES} SELECT doc_id, side, line_id FROM vl WHERE line_id % 5 = 0",
}
