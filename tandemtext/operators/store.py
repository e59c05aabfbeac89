"""The tables of an alignment and the edits of them. Tables are rewritten, not updated in place."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from typing import TYPE_CHECKING

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandemtext.functions.durable import consumed, exists, written
from tandemtext.functions.runs import whole_keys
from tandemtext.functions.text import LEVELS

if TYPE_CHECKING:
    import numpy as np

VERSION = "7.0"
_ID, _IDS = T.LongType(), T.ArrayType(T.LongType())
_counters = [T.StructField(c, _ID) for c in ("paragraph", *LEVELS, "divider")]
_key = [T.StructField("doc_id", T.StringType()), T.StructField("side", T.StringType())]
SCHEMAS: dict[str, T.StructType] = {
    "line": T.StructType([*_key, T.StructField("line_id", _ID), T.StructField("text", T.StringType()), T.StructField("proxy_text", T.StringType()), T.StructField("exclude", T.BooleanType()), *_counters]),
    "vector": T.StructType([*_key, T.StructField("line_id", _ID), T.StructField("is_proxy", T.BooleanType()), T.StructField("model", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType()))]),
    "meta": T.StructType([*_key, *[T.StructField(n, T.StringType()) for n in ("mark", "val")], T.StructField("occurrence", _ID), T.StructField("par_id", _ID), T.StructField("deleted", T.BooleanType()), T.StructField("comment", T.StringType())]),
    "batch": T.StructType([_key[0], *[T.StructField(n, _ID) for n in ("batch_id", "f0", "f1", "t0", "t1", "shift", "window")], T.StructField("insert_ts", T.TimestampType())]),
    "match": T.StructType([_key[0], T.StructField("batch_id", _ID), T.StructField("sub_id", _ID), T.StructField("from_ids", _IDS), T.StructField("to_ids", _IDS), T.StructField("sim", T.DoubleType()), T.StructField("version", _ID)]),
    "history": T.StructType([_key[0], T.StructField("operation", T.StringType()), T.StructField("batch_id", _ID), T.StructField("parameters", T.MapType(T.StringType(), T.StringType())), T.StructField("insert_ts", T.TimestampType())]),
    "document": T.StructType([_key[0], *[T.StructField(n, T.StringType()) for n in ("name", "lang_from", "lang_to", "file_from", "file_to", "guid_from", "guid_to", "version")]]),
}
#: Folders of a table on disk: documents are spread over them by a hash, so their number doesn't grow with the documents.
BUCKETS = 256


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")


def typed(df: DataFrame, table: str) -> DataFrame:
    """The columns of a table out of `df`, those it lacks null."""
    return df.select(*[F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in SCHEMAS[table].fields])


def save(df: DataFrame, path: str, table: str, buckets: int = BUCKETS) -> None:
    """Writes a table; the rows of documents in `df` are replaced, those of other documents stay.

    Only the folders that hold these documents are rewritten; a table keeps the number of folders it was made with. What is merged
    is written aside first, since a folder can't be read and overwritten in one job.
    """
    spark = df.sparkSession
    with consumed(spark):
        own = written(typed(df, table).withColumn("bucket", _bucket(buckets)), "save")
        if exists(spark, f"{path}/{table}"):
            touched = [r["bucket"] for r in own.select("bucket").distinct().collect()]  # at most `buckets` numbers
            old = spark.read.schema(own.schema).parquet(f"{path}/{table}").where(F.col("bucket").isin(*touched)) if touched else own.limit(0)
            kept = old.join(own.select("doc_id").distinct(), "doc_id", "left_anti").select(*own.columns)
            own = written(own.unionByName(kept), "merged")
        own.repartition("bucket").sortWithinPartitions("bucket", "doc_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/{table}")


def load(spark, path: str, table: str) -> DataFrame:
    """A saved table; one that was never saved has no rows."""
    if not exists(spark, f"{path}/{table}"):
        return spark.createDataFrame([], SCHEMAS[table])
    return spark.read.schema(T.StructType([*SCHEMAS[table].fields, T.StructField("bucket", T.IntegerType())])).parquet(f"{path}/{table}").drop("bucket")


def loaded_documents(spark, path: str, table: str, docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The rows of the documents in `docs`; only the folders that hold them are read."""
    touched = [r[0] for r in docs.select(_bucket(buckets)).distinct().collect()]
    if not touched or not exists(spark, f"{path}/{table}"):
        return spark.createDataFrame([], SCHEMAS[table])
    own = spark.read.schema(T.StructType([*SCHEMAS[table].fields, T.StructField("bucket", T.IntegerType())])).parquet(f"{path}/{table}")
    return own.where(F.col("bucket").isin(*touched)).drop("bucket").join(docs.select("doc_id").distinct(), "doc_id", "left_semi")


def replace_batches(match: DataFrame, new: DataFrame) -> DataFrame:
    """`match` with the batches that `new` has replaced by its rows."""
    own = match.join(new.select("doc_id", "batch_id").distinct(), ["doc_id", "batch_id"], "left_anti")
    return own.unionByName(new, allowMissingColumns=True)


def log(history: DataFrame, docs: DataFrame, operation: str, parameters: dict[str, str]) -> DataFrame:
    """`history` with a row for each (doc_id, batch_id) of `docs`."""
    pairs = F.map_from_arrays(F.array(*map(F.lit, parameters)), F.array(*map(F.lit, parameters.values()))) if parameters else F.create_map().cast("map<string,string>")
    return history.unionByName(docs.select("doc_id", F.lit(operation).alias("operation"), "batch_id", pairs.alias("parameters"), F.current_timestamp().alias("insert_ts")))


def missing_vectors(lines: DataFrame, vectors: DataFrame, is_proxy: bool = False, ids: DataFrame | None = None) -> DataFrame:
    """(doc_id, side, line_id, text) of the lines, or of those in `ids`, that have no vector; proxy texts where `is_proxy`."""
    key = ["doc_id", "side", "line_id"]
    own = lines.join(ids, key, "left_semi") if ids is not None else lines
    have = vectors.where(F.col("embedding").isNotNull() & (F.coalesce("is_proxy", F.lit(False)) == is_proxy))
    text = F.col("proxy_text") if is_proxy else F.col("text")
    return own.join(have, key, "left_anti").select(*key, text.alias("text"))


def set_text(lines: DataFrame, new: DataFrame, column: str = "text") -> DataFrame:
    """`lines` with `column` from `new` (doc_id, side, line_id, value) where that has a row; null values change nothing."""
    key = ["doc_id", "side", "line_id"]
    return lines.join(new.select(*key, F.col("value").alias("__v")), key, "left").withColumn(column, F.coalesce("__v", column)).select(*lines.columns)


def _points(after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, __at): the places of inserts, in order; a place named twice counts twice."""
    return after.groupBy(*keys).agg(F.sort_array(F.collect_list(F.col("line_id").cast("long"))).alias("__at"))


def _moved(x, at: str = "__at"):
    """An id after the inserts: it moves up by one for each place below it."""
    return x + F.coalesce(F.size(F.filter(at, lambda a: a < x)), F.lit(0)).cast("long")


def shift_ids(match: DataFrame, side: str, after: DataFrame) -> DataFrame:
    """`match` with all ids on `side` moved up by the number of `after` (doc_id, line_id) below them: lines were inserted there."""
    c = f"{side}_ids"
    own = match.join(_points(after, ["doc_id"]), "doc_id", "left").withColumn("__at", F.coalesce("__at", F.array().cast("array<long>")))
    return own.withColumn(c, F.transform(c, lambda x: _moved(x))).select(*match.columns)


def insert_lines(lines: DataFrame, side: str, after: DataFrame) -> DataFrame:
    """`lines` with an empty line after each (doc_id, line_id) of `after`; it inherits the counters. Ids above move up.

    A document may have any number of inserts; a line named twice gets two. Places that name no line add nothing but move
    what is above them.
    """
    # the places are hashed, so that lines need not be sorted; a line becomes itself and its new ones in one pass
    points = _points(after, ["doc_id"]).withColumn("side", F.lit(side)).hint("shuffle_hash")
    own = lines.join(points, ["doc_id", "side"], "left").withColumn("__at", F.coalesce("__at", F.array().cast("array<long>")))
    here = F.size(F.filter("__at", lambda a: a == F.col("line_id")))
    own = own.withColumn("__k", F.explode(F.sequence(F.lit(0), here)))
    new = {"line_id": _moved(F.col("line_id")) + F.col("__k")}
    for c, empty in (("text", F.lit("")), ("proxy_text", F.lit("")), ("embedding", F.lit(None))):
        if c in lines.columns:
            new[c] = F.when(F.col("__k") == 0, F.col(c)).otherwise(empty)
    return own.withColumns(new).select(*lines.columns)


def _renumbered(meta: DataFrame) -> DataFrame:
    """Occurrences counted anew by place; moved or new values of a place come after those that were there. Deleted ones keep none."""
    w = Window.partitionBy("doc_id", "side", "mark").orderBy("par_id", "__late", "occurrence")
    live = meta.where("not deleted").withColumn("occurrence", (F.row_number().over(w) - 1).cast("long"))
    return live.unionByName(meta.where("deleted")).drop("__late")


def add_meta(meta: DataFrame, new: DataFrame) -> DataFrame:
    """`meta` with the rows of `new` (doc_id, side, mark, val, par_id) put in by place."""
    own = new.select("doc_id", "side", "mark", "val", F.lit(None).cast("long").alias("occurrence"), F.col("par_id").cast("long").alias("par_id"), F.lit(False).alias("deleted"))
    return _renumbered(meta.select("doc_id", "side", "mark", "val", "occurrence", "par_id", "deleted").withColumn("__late", F.lit(0)).unionByName(own.withColumn("__late", F.lit(1))))


def delete_meta(meta: DataFrame, gone: DataFrame) -> DataFrame:
    """`meta` with the rows of `gone` (doc_id, side, mark, occurrence) marked as deleted."""
    key = ["doc_id", "side", "mark", "occurrence"]
    return meta.join(gone.select(*key, F.lit(True).alias("__g")), key, "left").withColumn("deleted", F.col("deleted") | F.coalesce("__g", F.lit(False))).select(*meta.columns)


def edit_meta(meta: DataFrame, new: DataFrame) -> DataFrame:
    """`meta` with the value and place of the rows in `new` (doc_id, side, mark, occurrence, val, par_id) changed."""
    key = ["doc_id", "side", "mark", "occurrence"]
    own = meta.join(new.select(*key, F.col("val").alias("__v"), F.col("par_id").cast("long").alias("__p")), key, "left")
    moved = F.col("__p").isNotNull() & (F.col("__p") != F.col("par_id"))
    own = own.withColumn("__late", F.coalesce(moved, F.lit(False)).cast("int"))
    return _renumbered(own.withColumns({"val": F.coalesce("__v", "val"), "par_id": F.coalesce("__p", "par_id")}).select(*meta.columns, "__late"))


def page(items: DataFrame, wanted: DataFrame) -> DataFrame:
    """The items of a list of (doc_id, rank, pos), in the order of the ranks."""
    return wanted.join(items, ["doc_id", "pos"]).orderBy("doc_id", "rank")


def line_counts(lines: DataFrame) -> DataFrame:
    """(doc_id, l1, l2): the lines of either side."""
    return lines.groupBy("doc_id").agg(F.count_if(F.col("side") == "from").alias("l1"), F.count_if(F.col("side") == "to").alias("l2"))


def alignment_points(match: DataFrame, bucket: int = 0) -> DataFrame:
    """(doc_id, bucket, x, y): every pair of ids that a row matches, by batch or by runs of `bucket` from-lines."""
    own = match.select("doc_id", "batch_id", F.explode("from_ids").alias("x"), "to_ids").select("doc_id", "batch_id", "x", F.explode("to_ids").alias("y"))
    return own.select("doc_id", (F.floor((F.col("x") - 1) / bucket).cast("long") if bucket else F.col("batch_id")).alias("bucket"), "x", "y")


def regression(points: DataFrame) -> DataFrame:
    """(doc_id, bucket, slope, intercept, mse): the least-squares line through the points of each bucket; null without two different x."""
    fit = points.groupBy("doc_id", "bucket").agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"))
    off = F.col("y") - (F.col("slope") * F.col("x") + F.col("intercept"))
    return points.join(fit, ["doc_id", "bucket"]).groupBy("doc_id", "bucket").agg(F.first("slope").alias("slope"), F.first("intercept").alias("intercept"), F.avg(off * off).alias("mse"))


def robust_regression(points: DataFrame, epsilon: float = 1.0, rounds: int = 500) -> DataFrame:
    """(doc_id, bucket, slope, intercept): the Huber line of each bucket, with the scale of the errors found together with it.

    Both axes are standardised. The line and the scale s minimise n s + s * sum h(error / s), h being the square up to `epsilon`
    and linear beyond; points off by more than `epsilon` s count less. Line and scale are improved in turns, by weighted
    least squares and by the root of the scale's equation, until they settle. Points of a bucket are in one group, buckets
    are independent, and many are fitted at once. Null without two different x; where all y are equal the line is flat.
    """
    names = ["doc_id", "bucket", "x", "y"]

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        kept: list[pa.RecordBatch] = []
        for b in chain(whole_keys(batches), [None]):
            if b is not None:
                kept.append(b)
            if not kept or b is not None and sum(k.num_rows for k in kept) < 200_000:
                continue
            t = pa.Table.from_batches(kept).combine_chunks()
            kept = []
            new = np.zeros(t.num_rows, bool)
            new[0] = True
            for c in names[:2]:
                code = t[c].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                new[1:] |= code[1:] != code[:-1]
            starts = np.flatnonzero(new)
            slope, intercept = huber_lines(*[t[c].to_numpy().astype(float) for c in names[2:]], starts, epsilon, rounds)
            heads = t.select(names[:2]).take(pa.array(starts)).combine_chunks()
            yield pa.RecordBatch.from_arrays([*[c.chunk(0) for c in heads.columns], *[pa.array(v, mask=np.isnan(v)) for v in (slope, intercept)]], names=["doc_id", "bucket", "slope", "intercept"])

    kind = points.schema["doc_id"].dataType.simpleString()
    hashed = points.select(*[F.col(c).cast("long") if c != "doc_id" else F.col(c) for c in names]).repartition("doc_id", "bucket").select(F.xxhash64("doc_id", "bucket").alias("__key"), *names)
    return hashed.sortWithinPartitions("__key", *names).mapInArrow(fit, f"doc_id {kind}, bucket long, slope double, intercept double")


def huber_lines(x: np.ndarray, y: np.ndarray, starts: np.ndarray, epsilon: float = 1.0, rounds: int = 500, cells: int = 500_000) -> tuple[np.ndarray, np.ndarray]:
    """The slope and intercept of each group of points, groups beginning at `starts`. Groups of about one length are fitted side by side, at most `cells` points with padding."""
    import numpy as np

    n = np.diff(np.r_[starts, len(x)])
    slope, intercept = np.full(len(n), np.nan), np.full(len(n), np.nan)
    order = np.argsort(n, kind="stable")
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * n[order[end]] <= cells:
            end += 1
        own = order[at:end]
        place = np.arange(n[own[-1]])
        valid = place < n[own, None]
        cell = np.where(valid, starts[own, None] + place, starts[own, None])
        slope[own], intercept[own] = _side_by_side(x[cell], y[cell], valid, epsilon, rounds)
        at = end
    return slope, intercept


def _side_by_side(x: np.ndarray, y: np.ndarray, valid: np.ndarray, epsilon: float, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Huber lines of the rows of two matrices, of which the `valid` cells count."""
    import numpy as np

    m = valid.sum(1)
    mean = lambda v: np.where(valid, v, 0.0).sum(1) / m
    mx, my = mean(x), mean(y)
    sx, sy = np.sqrt(mean((x - mx[:, None]) ** 2)), np.sqrt(mean((y - my[:, None]) ** 2))
    sy = np.where(sy == 0, 1.0, sy)
    p_all, q_all = np.full(len(m), np.nan), np.full(len(m), np.nan)
    at = np.flatnonzero(sx > 0)
    u, v = ((z[at] - mz[at, None]) / sz[at, None] for z, mz, sz in ((x, mx, sx), (y, my, sy)))
    valid, m = valid[at], m[at]
    w, p0, q0 = valid.astype(float), np.full(len(at), np.nan), np.full(len(at), np.nan)
    for _ in range(rounds):
        if not len(at):
            break
        total = w.sum(1)
        mu, mv = (u * w).sum(1) / total, (v * w).sum(1) / total
        du = (u - mu[:, None]) * w
        var = (du * (u - mu[:, None])).sum(1) / total
        flat = ~(var > 1e-12)
        with np.errstate(divide="ignore", invalid="ignore"):
            p = np.where(flat, p0, (du * (v - mv[:, None])).sum(1) / total / var)
        q = np.where(flat, q0, mv - p * mu)
        r = np.abs(v - p[:, None] * u - q[:, None])
        w = np.where(valid, np.minimum(1.0, epsilon * _scales(r, valid, m, epsilon)[:, None] / np.maximum(r, 1e-12)), 0.0)
        p_all[at], q_all[at] = p, q
        go = ~flat & ~(np.abs(p - p0) + np.abs(q - q0) < 1e-10)
        p0, q0 = p, q
        if not go.all():
            at, u, v, w, valid, m, p0, q0 = (z[go] for z in (at, u, v, w, valid, m, p0, q0))
    slope = p_all * sy / sx if (sx > 0).all() else p_all * sy / np.where(sx > 0, sx, 1.0)
    return slope, my + q_all * sy - slope * mx


def _scales(r: np.ndarray, valid: np.ndarray, m: np.ndarray, epsilon: float) -> np.ndarray:
    """For each row the root s of m = sum of (r / s)^2 over the small errors, less epsilon^2 for each large one."""
    import numpy as np

    large = -np.sort(np.where(valid, -r, 1.0), axis=1)  # the largest first; cells that don't count are -1, below all
    squares = np.zeros((len(r), r.shape[1] + 1))
    squares[:, :-1] = np.cumsum(np.where(large < 0, 0.0, large**2)[:, ::-1], axis=1)[:, ::-1]
    k = np.arange(r.shape[1] + 1)
    below = m[:, None] - k * epsilon**2
    s = np.sqrt(squares / np.where(below > 0, below, 1.0))
    fits = (below > 0) & (k <= m[:, None])
    fits[:, 1:] &= large > epsilon * s[:, 1:]
    fits[:, :-1] &= large <= epsilon * s[:, :-1] + 1e-15
    first = fits.argmax(1)
    return np.where(fits.any(1), np.maximum(s[np.arange(len(r)), first], 1e-10), 1e-10)
