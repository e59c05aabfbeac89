"""Byte-level BPE: encoding by tree reduction over halves of a text, decoding by concatenation."""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tandemtext.llm.common import chunks, packed, table, unpacked

#: Ranks of a public vocabulary; the file is read on the driver only and sent to the workers.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of a leaf, which is encoded as a whole, and of the first window on either side of a join.
LEAF, WINDOW = 16_384, 64
#: Between a letter, digit or ASCII mark and a blank, line end or tab, every cut of PATTERN ends, whatever is around.
_HARD = re.compile(r"[\w!-/:-@\[-`{-~](?=[ \n\t])")


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}


class Codec:
    """An encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], leaf: int = LEAF, window: int = WINDOW) -> None:
        import tiktoken

        self.own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.leaf, self.window = leaf, window

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.own.encode_ordinary(text), np.int32)

    def encode(self, text: str) -> np.ndarray:
        """The tokens of a text of any length: halves are encoded by themselves and joined."""
        return self._encode(text, 0, len(text))

    def _encode(self, text: str, a: int, b: int) -> np.ndarray:
        if b - a <= self.leaf:
            return self.whole(text[a:b])
        mid = (a + b) // 2
        return self.join(text, a, mid, b, self._encode(text, a, mid), self._encode(text, mid, b))

    def join(self, text: str, a: int, mid: int, b: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The tokens of text[a:b] from those of text[a:mid] and text[mid:b].

        A window around `mid` grows until it begins and ends at places where the text is cut for sure. The
        tokens outside are then those of the whole, and what the parts had inside is encoded anew.
        """
        start, w = a, self.window
        while mid - w > a:
            hard = [m.end() for m in _HARD.finditer(text, mid - w, mid)]
            if hard:
                start = hard[-1]
                break
            w *= 2
        end, w = b, self.window
        while mid + w < b:
            hard = _HARD.search(text, mid, mid + w)
            if hard:
                end = hard.end()
                break
            w *= 2
        drop, skip = len(self.whole(text[start:mid])), len(self.whole(text[mid:end]))
        return np.concatenate([left[: len(left) - drop], self.whole(text[start:end]), right[skip:]])

    def decode(self, tokens: np.ndarray) -> bytes:
        """The bytes of the tokens; long sequences are decoded as halves, and these are concatenated."""
        if len(tokens) > self.leaf:
            mid = len(tokens) // 2
            return self.decode(tokens[:mid]) + self.decode(tokens[mid:])
        return b"".join(map(self.bytes_of.__getitem__, tokens.tolist()))


_codecs: dict[str, Codec] = {}


def tokenize(docs: DataFrame, ranks: dict[bytes, int] | None = None, leaf: int = LEAF) -> DataFrame:
    """Adds tokens, n_tokens and round_trip (whether they decode to the text) to the columns of `docs`.

    Columns of `docs` with these names are replaced. A null text has null in all three, an empty one no tokens. All
    else is encoded whole, special tokens' names as ordinary text. Repeated rows get equal tokens.
    """
    new = [T.StructField("tokens", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("round_trip", T.BooleanType())]
    docs = docs.drop(*[f.name for f in new])
    rows = packed(docs, ("text",))
    shared = docs.sparkSession.sparkContext.broadcast(ranks if ranks is not None else read_ranks())
    names, at, key = rows.columns, 0, uuid.uuid4().hex
    schema = T.StructType([*rows.schema.fields, *new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codecs.get(key) or _codecs.setdefault(key, Codec(shared.value, leaf))
        for whole in batches:
            for b in chunks(whole, at):
                texts = b.column(at).to_pylist()
                tokens = [None if t is None else codec.encode(t) for t in texts]
                ok = [None if t is None else codec.decode(x) == t.encode("utf-8", "surrogatepass") for t, x in zip(texts, tokens, strict=True)]
                sizes = np.array([0 if x is None else len(x) for x in tokens], np.int64)
                offsets = np.r_[0, np.cumsum(sizes)].astype(np.int32)
                values = np.concatenate([x for x in tokens if x is not None] + [np.zeros(0, np.int32)])
                null = np.array([x is None for x in tokens])
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=pa.array(null)) if null.any() else pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
                yield pa.RecordBatch.from_arrays([*b.columns, lists, pa.array(sizes, mask=null), pa.array(ok, pa.bool_())], names=[*names, "tokens", "n_tokens", "round_trip"])

    added = tuple(f.name for f in new)
    return unpacked(rows.mapInArrow(run, schema), [*docs.columns, *added], ("text", *added))


def op8_bpe_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens, and whether they decode to its text."""
    return tokenize(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
