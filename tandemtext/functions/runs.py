"""Streams of Arrow batches cut where a key changes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_keys(batches: Iterator[pa.RecordBatch], key: int = 0) -> Iterator[pa.RecordBatch]:
    """The rows of sorted `batches`, regrouped so that rows of equal integer key are never in two batches."""
    kept: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key).to_numpy(zero_copy_only=False)
        if kept and kept[-1].column(key)[-1].as_py() != k[0]:
            yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
            kept = []
        at = int(np.searchsorted(k, k[-1], "left"))
        if at:
            kept.append(b.slice(0, at))
            yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
            kept = []
        kept.append(b.slice(at))
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
