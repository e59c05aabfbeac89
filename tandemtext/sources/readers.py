"""Where alignments come from: text files, line-by-line vectors, results of services, and single-file databases of older tools."""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def text_lines(spark: SparkSession, path: str, side: str = "from") -> DataFrame:
    """(doc_id, side, line_id, text): the lines of text files, the document being the file's name. Order is kept by
    reading each file whole, so files are the unit of parallelism. A last empty line is none."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_name", r"^(.*?)(?:\.[^.]*)?$", 1).alias("doc_id"), F.regexp_replace("value", r"\r\n?", "\n").alias("value"))
    rows = files.select("doc_id", F.posexplode(F.split(F.regexp_replace("value", r"\n\z", ""), "\n")).alias("p", "text"))
    return rows.select("doc_id", F.lit(side).alias("side"), (F.col("p") + 1).cast("long").alias("line_id"), "text")


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def legacy_vectors(column: F.Column) -> F.Column:
    """Vectors kept as JSON text."""
    return F.from_json(column, "array<double>").cast("array<float>")


def blob_vectors(column: F.Column) -> F.Column:
    """Vectors kept as little-endian 32-bit floats."""

    @F.pandas_udf("array<float>")
    def read(s: pd.Series) -> pd.Series:
        import numpy as np

        return s.map(lambda b: None if b is None else np.frombuffer(bytes(b), "<f4"))

    return read(column)


def to_blob(column: F.Column) -> F.Column:
    @F.pandas_udf("binary")
    def write(s: pd.Series) -> pd.Series:
        import numpy as np

        return s.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())

    return write(column)


def legacy_index(column: F.Column) -> F.Column:
    """The match rows of an index kept as one JSON text, as an array of (batch_id, sub_id, from_ids, to_ids); the id lists are JSON inside JSON."""
    batches = F.from_json(column, "array<array<array<string>>>")
    ids = lambda c: F.from_json(c, "array<bigint>")
    rows = F.transform(batches, lambda b, i: F.transform(b, lambda r, j: F.struct(i.cast("long").alias("batch_id"), j.cast("long").alias("sub_id"), ids(r[1]).alias("from_ids"), ids(r[3]).alias("to_ids"))))
    return F.flatten(rows)


_TABLES = {
    "line": ("select 'from' side, rowid, * from splitted_from union all select 'to', rowid, * from splitted_to", "side string, line_id long, text string, proxy_text string, paragraph long, h1 long, h2 long, h3 long, h4 long, h5 long, divider long"),
    "meta": ("select * from meta", "key string, val string, occurence long, par_id long, deleted long, comment string"),
}


def database_table(spark: SparkSession, paths: list[str], table: str) -> DataFrame:
    """A table of single-file databases, one file a document; files are read in parallel where the workers can see them.

    `table` is line, meta or index. Columns that a file lacks are null.
    """
    kind = "val string" if table == "index" else _TABLES[table][1]
    names = [c.split()[0] for c in kind.split(", ")]
    alias = {"line_id": "id"}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            for path in df["path"]:
                with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
                    db.row_factory = sqlite3.Row
                    sql = "select contents val from doc_index" if table == "index" else _TABLES[table][0]
                    rows = [{c: (r[alias.get(c, c)] if alias.get(c, c) in r.keys() else None) for c in names} for r in db.execute(sql)]
                out = pd.DataFrame(rows, columns=names)
                out.insert(0, "doc_id", path.rsplit("/", 1)[-1].rsplit(".", 1)[0])
                yield out

    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    got = files.mapInPandas(run, f"doc_id string, {kind}")
    if table == "index":
        return got.select("doc_id", F.explode(legacy_index(F.col("val"))).alias("r")).select("doc_id", "r.*")
    if table == "meta":
        return got.select("doc_id", F.regexp_extract("key", "_(from|to)$", 1).alias("side"), F.regexp_replace("key", "_(from|to)$", "").alias("mark"), "val", F.col("occurence").alias("occurrence"), "par_id", (F.coalesce("deleted", F.lit(0)) != 0).alias("deleted"), "comment")
    return got


def parse_request_metadata(line: str) -> dict:
    """The metadata of a result line of a service: a JSON list of request, response and metadata."""
    got = json.loads(line)
    return got[2] if len(got) > 2 else {}
