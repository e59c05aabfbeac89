"""What several operators of this subpackage share."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of letters and digits; everything beyond ASCII counts as a letter. Safe in Python, Java and RE2.
WORD = r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"
WORDS = re.compile(WORD)
_CACHE_LIMIT = 500_000
_hashes: dict[str, int] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(docs: DataFrame, used: tuple[str, ...]) -> DataFrame:
    """The `used` columns of `docs`, and all others in one struct __rest: no name of theirs can then clash with one of ours."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in used]
    return docs.select(*used, (F.struct(*rest) if rest else F.lit(None).cast("int")).alias("__rest"))


def unpacked(df: DataFrame, columns: list[str], used: tuple[str, ...]) -> DataFrame:
    """The columns that `packed` was given, in their order."""
    return df.select(*[F.col(c) if c in used else F.col("__rest").getField(c).alias(c) for c in columns])


def word_hashes(words: list[str]) -> np.ndarray:
    """Each word's XXH3 hash as uint64; a word is hashed once per worker, until the cache is full."""
    if len(_hashes) > _CACHE_LIMIT:
        _hashes.clear()
    get, out = _hashes.get, []
    for w in words:
        h = get(w)
        if h is None:
            h = _hashes[w] = xxhash.xxh3_64_intdigest(w)
        out.append(h)
    return np.array(out, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: all bits of the result depend on all bits of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(batch: pa.RecordBatch, text: int, chars: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The rows of `batch` in slices of about `chars` bytes of text, at least one row each; rows are never cut."""
    col = batch.column(text)
    sizes = np.asarray(pc.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    ends = np.cumsum(sizes)
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + chars, "right")))
        yield batch.slice(at, to - at)
        at = to

