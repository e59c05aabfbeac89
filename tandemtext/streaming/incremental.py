"""Alignments that grow: match rows or lines that arrive as files are merged into tables batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tandemtext.functions.durable import consumed, written
from tandemtext.operators.store import SCHEMAS, loaded_documents, save


def stream_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Rows of a table as they arrive as Parquet files in a folder, with the file they came in as __file: its time, then its name."""
    rows = spark.readStream.schema(SCHEMAS[table]).parquet(path)
    return rows.select(*rows.columns, F.struct(F.col("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_path").alias("name")).alias("__file"))


def latest_batches(rows: DataFrame, order: str) -> DataFrame:
    """Of each (doc_id, batch_id) the rows of its largest `order` only: a batch that was aligned again replaces the one before."""
    w = Window.partitionBy("doc_id", "batch_id")
    return rows.withColumn("__m", F.max(order).over(w)).where(F.col(order).eqNullSafe(F.col("__m"))).drop("__m")


def one_version(new: DataFrame) -> DataFrame:
    """The match rows of a micro-batch, each batch once: the rows of its largest `version`, null being the least.

    Files without versions may hold parts of one batch or a batch again; of rows alike in (doc_id, batch_id, sub_id) the one in the
    latest file stays.
    """
    if "version" not in new.columns:
        new = new.withColumn("version", F.lit(None).cast("long"))
    own = latest_batches(new.withColumn("__version", F.coalesce("version", F.lit(-(2**63)))), "__version").drop("__version")
    if "__file" not in own.columns:
        own = own.withColumn("__file", F.lit(0))
    place = Window.partitionBy("doc_id", "batch_id", "sub_id").orderBy(F.desc("__file"), F.desc(F.xxhash64(F.to_json(F.struct("from_ids", "to_ids", "sim")))))
    return own.withColumn("__r", F.row_number().over(place)).where("__r = 1").drop("__r", "__file")


def upsert_matches(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes arriving match batches into the table at `path`; a batch that arrives again replaces its old rows.

    A producer that may deliver batches out of order gives their rows a `version`: a stored batch is replaced by one of an equal or
    larger version only, null being the least. Only the folders of documents that a micro-batch touches are rewritten, and a
    micro-batch that is replayed after a failure gives the same table.
    """

    def merge(arrived: DataFrame, _: int) -> None:
        spark = arrived.sparkSession
        with consumed(spark):
            new = written(one_version(arrived), "arrived")
            old = loaded_documents(spark, path, "match", new.select("doc_id"))
            least = F.lit(-(2**63))
            both = old.withColumn("__order", F.struct(F.coalesce("version", least).alias("v"), F.lit(0).alias("new"))).unionByName(new.withColumn("__order", F.struct(F.coalesce("version", least).alias("v"), F.lit(1).alias("new"))))
            save(written(latest_batches(both, "__order").drop("__order"), "merged"), path, "match")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_lengths(lines: DataFrame) -> DataFrame:
    """Running counts of lines and characters of each document and side, for an update-mode sink."""
    return lines.groupBy("doc_id", "side").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("text")).alias("n_chars"))
