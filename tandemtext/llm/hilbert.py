"""Nearest neighbours: shifted Hilbert orders of projected vectors, then exact completion over blocks of one order."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandemtext.functions.durable import written
from tandemtext.functions.ranking import running_total
from tandemtext.functions.runs import whole_keys
from tandemtext.llm.common import table

#: Neighbours of each vector that are looked for.
NEIGHBOURS = 10
#: Orders, projected dimensions and bits of each in a Hilbert key, rows of a window; rows of a block of the completion, and
#: blocks that travel together: of n vectors, each is sent about n / (BLOCK * TILE) times.
CURVES, DIMS, LEVELS, WINDOW, BLOCK, TILE = 4, 7, 8, 64, 2048, 8
#: Different dimensions that one table may hold; each is a search of its own.
MOST_DIMENSIONS = 16
_SLACK = 1e-5


def hilbert_keys(grid: np.ndarray, levels: int = LEVELS) -> np.ndarray:
    """The place of each row of integers below 2^levels on the Hilbert curve through all such rows, as int64.

    The transpose form of the curve is made bit by bit from the axes, for all rows at once.
    """
    x = grid.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (levels - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) > 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (levels - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for level in range(levels - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> level) & 1)
    return key


def curve_keys(v: np.ndarray, curves: int = CURVES) -> np.ndarray:
    """A Hilbert key of each unit vector for each curve: another random projection and another shift of the grid."""
    d = v.shape[1]
    dims = min(DIMS, d)
    out = np.empty((len(v), curves), np.int64)
    for c in range(curves):
        rng = np.random.default_rng(7919 * (c + 1))
        q, _ = np.linalg.qr(rng.standard_normal((d, dims)))
        cells = 1 << LEVELS
        # unit vectors lie within 4 / sqrt(d) of 0 in almost all directions; half of the grid is room for the shift
        y = (v @ q) * np.sqrt(d) / 4
        grid = np.floor((y + 1) / 2 * (cells // 2) + rng.random(dims) * (cells // 2)).clip(0, cells - 1)
        out[:, c] = hilbert_keys(grid)
    return out


def usable_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): one row for each id. Left out are null ids, null, empty and zero vectors and those with nulls or other than
    finite numbers. Of rows with one id the least vector stays."""
    ok = vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<float>").alias("v"))
    ok = ok.where("size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = float('inf')) and exists(v, x -> x <> 0)")
    return ok.groupBy("id").agg(F.min("v").alias("v"))


def unit_vectors(one: DataFrame) -> DataFrame:
    """(id, vec, keys): unit vectors packed as float32 bytes, with their curve keys. `one` is (id, v), all of one dimension."""
    schema = T.StructType([T.StructField("id", one.schema["id"].dataType), T.StructField("vec", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
            v = v / np.linalg.norm(v, axis=1, keepdims=True)
            keys = curve_keys(v)
            packed = np.ascontiguousarray(v.astype(np.float32)).view(np.uint8).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in packed], pa.binary()), pa.array(list(keys))], names=["id", "vec", "keys"])

    return one.mapInArrow(run, schema)


def _unpack(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float32).reshape(len(rows), -1)


def _exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Cosines of row pairs in double precision."""
    a, b = q.astype(np.float64), c.astype(np.float64)
    return (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))


def window_candidates(base: DataFrame, k: int, window: int = WINDOW) -> DataFrame:
    """(id, other, sim): for each curve the k nearest of those that a vector has within a window of its place, or one next to it.

    Places along a curve are ranks under a range partitioning. A row is a query in its own window and a candidate in
    three, so that windows at partition borders meet as all others do.
    """
    rows = base.select(F.posexplode("keys").alias("curve", "key"), "id", "vec", F.lit(1).cast("long").alias("one"))
    placed = running_total(rows, ["curve", "key", "id"], "one", "place", by=["curve"])
    cell = F.floor((F.col("place") - 1) / window)
    spread = placed.select(F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("off"), cell.alias("cell"), "curve", "id", "vec")
    spread = spread.select((F.col("curve").cast("long") * F.lit(1 << 40) + F.col("cell") + F.col("off") + 1).alias("group"), (F.col("off") == 0).alias("query"), "id", "vec")
    schema = T.StructType([T.StructField("id", base.schema["id"].dataType), T.StructField("other", base.schema["id"].dataType), T.StructField("sim", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole_keys(batches):
            g = b.column(0).to_numpy(zero_copy_only=False)
            v = _unpack(b.column(3))
            asks = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            cuts = np.r_[np.flatnonzero(np.r_[True, g[1:] != g[:-1]]), len(g)]
            left, right = [], []
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                q = np.flatnonzero(asks[s:e]) + s
                if not len(q) or e - s < 2:
                    continue
                sims = v[q] @ v[s:e].T
                sims[np.arange(len(q)), q - s] = -9
                n = min(k, e - s - 1)
                best = np.argpartition(-sims, n - 1, axis=1)[:, :n] + s
                left.append(np.repeat(q, n))
                right.append(best.ravel())
            if left:
                i, j = np.concatenate(left), np.concatenate(right)
                yield pa.RecordBatch.from_arrays([b.column(2).take(pa.array(i)), b.column(2).take(pa.array(j)), pa.array(_exact(v[i], v[j]))], names=schema.names)

    return spread.repartition("group").sortWithinPartitions("group").mapInArrow(run, schema)


def nearest(found: DataFrame, k: int) -> DataFrame:
    """The k best of each id with their ranks; ties of similarity go to the least other id."""
    order = Window.partitionBy("id").orderBy(F.desc("sim"), "other")
    return found.groupBy("id", "other").agg(F.max("sim").alias("sim")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _blocks(base: DataFrame, bounds: DataFrame, block: int) -> DataFrame:
    """(block, n, ids, vecs, least, centre, radius): runs of the first curve, each with all its vectors, the k-th similarity that
    each already has, and a cone (unit centre, angle) around them."""
    one = base.select(F.col("keys")[0].alias("key"), "id", "vec", F.lit(1).cast("long").alias("one"))
    placed = running_total(one, ["key", "id"], "one", "place").withColumn("block", F.floor((F.col("place") - 1) / block).cast("long"))
    rows = placed.join(bounds, "id", "left").select("block", "id", "vec", F.coalesce("least", F.lit(-2.0)).alias("least"))
    kind = base.schema["id"].dataType
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("vecs", T.BinaryType()), T.StructField("least", T.BinaryType()), T.StructField("lowest", T.DoubleType()), T.StructField("centre", T.ArrayType(T.DoubleType())), T.StructField("radius", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in whole_keys(batches):
            g = whole.column(0).to_numpy(zero_copy_only=False)
            cuts = np.r_[np.flatnonzero(np.r_[True, g[1:] != g[:-1]]), len(g)]
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                b = whole.slice(s, e - s)
                v = _unpack(b.column(2)).astype(np.float64)
                c = v.mean(axis=0)
                size = np.linalg.norm(c)
                c = c / size if size > 1e-12 else np.eye(1, v.shape[1])[0]
                radius = float(np.arccos(np.clip((v @ c).min(), -1, 1)))
                least = b.column(3).to_numpy(zero_copy_only=False).astype(np.float64)
                yield pa.RecordBatch.from_pylist([{"block": int(g[s]), "ids": b.column(1).to_pylist(), "vecs": v.astype(np.float32).tobytes(), "least": least.tobytes(), "lowest": float(least.min()), "centre": c.tolist(), "radius": radius}], schema=pa_schema)

    from pyspark.sql.pandas.types import to_arrow_schema

    pa_schema = to_arrow_schema(schema)
    return rows.repartition("block").sortWithinPartitions("block").mapInArrow(run, schema)


def completed(base: DataFrame, known: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """(id, other, sim): all pairs that beat the k-th similarity an id has in `known`, over all pairs of blocks that can hold one.

    Two blocks are not compared if their cones lie so far apart that no pair can beat the least k-th similarity of the
    first. That spares most pairs where the vectors cluster; vectors without any structure leave nothing to spare.
    """
    ranked = nearest(known, k)
    bounds = ranked.groupBy("id").agg(F.when(F.count(F.lit(1)) >= k, F.min("sim")).alias("least"))
    b = written(_blocks(base, bounds, block), "blocks")
    left = b.select(F.col("block").alias("qb"), F.col("centre").alias("qc"), F.col("radius").alias("qr"), "lowest")
    right = b.select(F.col("block").alias("cb"), F.col("centre").alias("cc"), F.col("radius").alias("cr"))
    dot = F.aggregate(F.zip_with("qc", "cc", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    apart = F.greatest(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))) - F.col("qr") - F.col("cr"), F.lit(0.0))
    pairs = left.crossJoin(right).where(F.cos(apart) + _SLACK >= F.col("lowest"))
    tile = lambda c: F.floor(F.col(c) / TILE).cast("long")
    tiles = pairs.groupBy(tile("qb").alias("qt"), tile("cb").alias("ct")).agg(F.collect_list(F.struct("qb", "cb")).alias("todo"))
    packs = written(b.groupBy(tile("block").alias("t")).agg(F.collect_list(F.struct("block", "ids", "vecs", "least")).alias("blocks")), "tiles")
    full = tiles.join(packs.select(F.col("t").alias("ct"), F.col("blocks").alias("cs")), "ct").join(packs.select(F.col("t").alias("qt"), F.col("blocks").alias("qs")), "qt").select("todo", "qs", "cs")
    kind = base.schema["id"].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("other", kind), T.StructField("sim", T.DoubleType())])

    def opened(blocks: pa.StructArray) -> dict[int, tuple[pa.Array, np.ndarray, np.ndarray]]:
        out = {}
        for x in range(len(blocks)):
            ids = blocks.field("ids")[x].values
            vecs = np.frombuffer(blocks.field("vecs")[x].as_py(), np.float32).reshape(len(ids), -1)
            out[blocks.field("block")[x].as_py()] = ids, vecs, np.frombuffer(blocks.field("least")[x].as_py(), np.float64).copy()
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                qs, cs = opened(batch.column(1)[r].values), opened(batch.column(2)[r].values)
                for todo in batch.column(0)[r].as_py():
                    (qids, q, least), (cids, c, _) = qs[todo["qb"]], cs[todo["cb"]]
                    sims = q @ c.T
                    if todo["qb"] == todo["cb"]:
                        np.fill_diagonal(sims, -9)
                    # no more than k of one block can be among the k nearest, ties aside; the next blocks must beat them too
                    if sims.shape[1] > k:
                        np.maximum(least, -np.partition(-sims, k - 1, axis=1)[:, k - 1], out=least)
                    i, j = np.nonzero(sims >= least[:, None] - _SLACK)
                    if len(i):
                        yield pa.RecordBatch.from_arrays([qids.take(pa.array(i)), cids.take(pa.array(j)), pa.array(_exact(q[i], c[j]))], names=schema.names)

    return full.mapInArrow(run, schema)


def neighbours(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = NEIGHBOURS, exact: bool = True) -> DataFrame:
    """(id, other, sim, rank): the k vectors of largest cosine similarity for each vector, itself left out.

    With `exact`, what the curves miss is completed; otherwise the result is that of the curve windows alone. Fewer than
    k other vectors: all of them. Ties go to the least id. What rows are left out is said in `usable_vectors`. A vector is
    compared with those of its own dimension, since there is no cosine with others; each dimension is searched by itself.
    Dimensions may be long: a block holds BLOCK vectors. Other columns are ignored. Empty input: no rows.
    """
    spark = vectors.sparkSession
    one = usable_vectors(vectors, id_col, vec_col)
    dimensions = sorted(r["d"] for r in one.select(F.size("v").alias("d")).distinct().limit(MOST_DIMENSIONS + 1).collect())
    if len(dimensions) > MOST_DIMENSIONS:
        raise ValueError(f"vectors have more than {MOST_DIMENSIONS} different dimensions")

    def of(d: int) -> DataFrame:
        base = written(unit_vectors(one.where(F.size("v") == d)), "vectors")
        known = written(window_candidates(base, k), "windows")
        return nearest(known.unionByName(completed(base, known, k)) if exact else known, k)

    kind = one.schema["id"].dataType.simpleString()
    found = [of(d) for d in dimensions] or [spark.createDataFrame([], f"id {kind}, other {kind}, sim double, rank int")]
    return reduce(DataFrame.unionByName, found)


def op2_hilbert_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every vector."""
    found = neighbours(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), F.col("other").alias("neighbour_id"), F.col("rank").cast("long").alias("rank"), F.round("sim", 5).alias("similarity"))


ORACLE = f"""
WITH p AS (
  SELECT a.vec_id, b.vec_id AS neighbour_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, neighbour_id) AS rank FROM p)
SELECT vec_id, neighbour_id, rank::BIGINT AS rank, round(s, 5) AS similarity FROM r WHERE rank <= {NEIGHBOURS}
"""
