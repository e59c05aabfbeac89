"""Near-duplicate documents: SimHash fingerprints, candidates by a covering family of bit masks."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandemtext.functions.components import connected_components
from tandemtext.functions.durable import consumed, written
from tandemtext.functions.runs import whole_keys
from tandemtext.llm.common import WORDS, chunks, mix, packed, table, unpacked, word_hashes

#: Bits of a fingerprint; BLOCKS blocks of BLOCK_BITS bits, from the first bit on, are searched, each with masks for BLOCK_RADIUS.
BITS, BLOCKS, BLOCK_BITS, BLOCK_RADIUS = 256, 7, 36, 6
#: Pairs within RADIUS of all bits surely meet: one of the blocks then differs in BLOCK_RADIUS bits at most. These are all near pairs.
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
#: Two documents are near copies if at most this share of their fingerprint bits differs (set cosine of about 0.83).
MOST_DIFFERENT = 0.1875
#: Up to so many fingerprints a row stands for 2^FEW_ROWS tables of a block, which share four bits at least: a task then holds the rows that
#: agree in these, about 1 in 16 of all. Beyond, for two, which share seven at least: more is shuffled and tasks hold less, the pairs are the same.
TOGETHER, FEW_ROWS = 1 << 26, 4
#: Up to so many fingerprints of one key all pairs are compared, for all such keys at once; up to CROWDED key by key; more are
#: searched around leaders, without a cap. All three ways connect the same rows.
_AT_ONCE, CROWDED = 64, 1024
#: After so many leaders, if they took less than one other row each, the rows left are compared with each other instead.
_LEADERS = 64
#: Rows of a matrix of comparisons have so many cells in all, at most.
_CELLS = 1 << 18


def fingerprint(words: set[str]) -> bytes | None:
    """The SimHash of a set of words: each bit is the majority of that bit over the words' hashes, ties being 0."""
    if not words:
        return None
    h = word_hashes(list(words))
    total = np.zeros(BITS, np.uint32)
    step = 255  # so many ones fit a byte
    for at in range(0, len(h), step):
        x = h[at : at + step, None] + np.arange(1, BITS // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        total += np.unpackbits(mix(x).view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * total > len(h)).tobytes()


@functools.cache
def covering_masks(bits: int = BLOCK_BITS, radius: int = BLOCK_RADIUS) -> list[int]:
    """2^(radius+1) - 1 masks over `bits` bits; any `radius` positions are all left out by at least one of them.

    Each position gets a vector of radius + 1 bits. The mask of a vector v holds the positions whose vectors have odd
    parity with v. At most `radius` positions leave room for a v orthogonal to all of theirs. Vectors are chosen one by one
    so that few random fingerprints agree in a mask. With larger radii the first seven are those of the three high bits: masks whose
    vectors agree in these, not all 0, share four of the seven positions.
    """
    n = 1 << (radius + 1)
    odd = np.array([[(p & v).bit_count() & 1 for v in range(n)] for p in range(n)])
    place = [x << (radius - 2) for x in range(1, 8)][:bits] if radius > 3 else []
    kept = odd[place].sum(axis=0)
    while len(place) < bits:
        crowd = (0.5 ** (kept + odd)[1:, 1:]).sum(axis=1)
        best = 1 + min(range(n - 1), key=lambda p: (crowd[p], place.count(p + 1), ((p + 1) * 0x9E3779B1) & 0xFFFFFFFF))
        place.append(best)
        kept = kept + odd[best]
    return [sum(1 << i for i in range(bits) if odd[place[i], v]) for v in range(1, n)]


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, th, fp) of each row: a hash of the text, and the SimHash of the set of its lower-case words or null.

    Whole texts are read. Null texts and texts without a word have no fingerprint.
    """
    schema = T.StructType([docs.schema["doc_id"], T.StructField("th", T.LongType()), T.StructField("fp", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in chunks(whole, 2):
                fps = [fingerprint(set(WORDS.findall(t.lower()))) if t else None for t in b.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.binary())], names=["doc_id", "th", "fp"])

    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(run, schema)


def _bits(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many bits rows differ; four counts of a byte are added at once."""
    four = np.bitwise_count(x ^ y).view(np.uint32)[..., 0]
    two = (four & np.uint32(0xFF00FF)) + (four >> np.uint32(8) & np.uint32(0xFF00FF))
    return ((two & np.uint32(0xFFFF)) + (two >> np.uint32(16))).astype(np.int32)


def _near(x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    return _bits(x, y) <= most


def _near_of_all(x: np.ndarray, y: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a row of `x` and a row of `y` that are near, all being compared."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    columns = [np.ascontiguousarray(y[:, w]) for w in range(y.shape[1])]
    step = max(1, _CELLS // max(1, len(y)))
    for at in range(0, len(x), step):
        differ = np.zeros((len(x[at : at + step]), len(y)), np.uint16)
        for w, column in enumerate(columns):
            differ += np.bitwise_count(x[at : at + step, w, None] ^ column)
        i, j = np.nonzero(differ <= most)
        left.append(i + at)
        right.append(j)
    return np.concatenate(left), np.concatenate(right)


def _near_within(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The near pairs (i, j) of rows of `v`, i < j, all being compared."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    step = max(64, _CELLS // max(1, len(v)))
    for at in range(0, len(v), step):
        i, j = _near_of_all(v[at : at + step], v[at:], most)
        left.append(i[i < j] + at)
        right.append(j[i < j] + at)
    return np.concatenate(left), np.concatenate(right)


def bucket_edges(v: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Pairs of rows of `v` (fingerprints as uint64 words) that connect all rows which near pairs connect.

    Rows near a leader are tied to it and need no comparison among themselves; rows that no leader has taken become
    leaders, as long as they take others. Two groups that are still apart are compared row by row until one near pair ties
    them, and only if their leaders lie near enough, given the groups' radii, for such a pair to exist. What leaders have
    left is compared with itself, and with those groups that a near pair is possible with.
    """
    edges: list[tuple[int, int]] = []
    leaders: list[int] = []
    groups: list[np.ndarray] = []
    radius: list[int] = []
    rest = np.arange(len(v))
    before = len(rest)
    while len(rest):
        if leaders and len(leaders) % _LEADERS == 0:
            if before - len(rest) < 2 * _LEADERS:
                break
            before = len(rest)
        i = int(rest[0])
        far = _bits(v[i], v[rest])
        close = rest[far <= most]
        leaders.append(i)
        groups.append(close)
        radius.append(int(far[far <= most].max()))
        edges += [(i, int(j)) for j in close if j != i]
        rest = rest[far > most]
    root = np.arange(len(groups))  # of each group the least that it is tied to
    lead, radii = v[leaders], np.array(radius)
    for g in range(1, len(groups)):
        other = np.flatnonzero((_bits(lead[g], lead[:g]) <= most + radii[g] + radii[:g]) & (root[:g] != root[g]))
        for h in other:
            if root[h] == root[g]:
                continue
            y = groups[h]
            for i in groups[g]:
                if int(_bits(v[i], lead[h])) > most + radii[h]:
                    continue
                near = np.flatnonzero(_near(v[i], v[y], most))
                if len(near):
                    edges.append((int(i), int(y[near[0]])))
                    a, b = sorted((int(root[g]), int(root[h])))
                    root[root == b] = a
                    break
    if len(rest):
        i, j = _near_within(v[rest], most)
        edges += zip(rest[i].tolist(), rest[j].tolist(), strict=True)
        for g in np.flatnonzero(radii):
            reach = rest[_bits(lead[g], v[rest]) <= most + radii[g]]
            i, j = _near_of_all(v[groups[g]], v[reach], most)
            edges += zip(groups[g][i].tolist(), reach[j].tolist(), strict=True)
    return edges


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each group of the rows 0..n-1 that the pairs (i, j) connect: its rows and their least row."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], least)
        np.minimum.at(new, label[j], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    rows = np.flatnonzero(label != np.arange(n))
    return rows, label[rows]


def _edges_of(keys: np.ndarray, v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that connect what the near pairs within runs of equal keys connect, however long a run is."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    run_size = np.repeat(sizes, sizes)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    rows = np.flatnonzero((run_size > 1) & (run_size <= _AT_ONCE))
    d = 1
    while len(rows):
        rows = rows[rows + d < len(keys)]
        rows = rows[keys[rows] == keys[rows + d]]
        ok = rows[_near(v[rows], v[rows + d], most)]
        left.append(ok)
        right.append(ok + d)
        d += 1
    for s, size in zip(starts[sizes > _AT_ONCE].tolist(), sizes[sizes > _AT_ONCE].tolist(), strict=True):
        if size <= CROWDED:
            i, j = _near_within(v[s : s + size], most)
        else:
            i, j = np.array(bucket_edges(v[s : s + size], most), np.int64).reshape(-1, 2).T
        left.append(i + s)
        right.append(j + s)
    return _forest(len(keys), np.concatenate(left), np.concatenate(right))


def tables_of_rows(together: int) -> list[tuple[int, ...]]:
    """The tables that each row of a fingerprint stands for: up to 2^together of one block; every table is in one of them.

    These are the masks whose vectors agree in all but their `together` low bits. Those with nothing above the low bits, where
    such masks share no position, are divided by half as many low bits, and so on.
    """
    n, high, low = len(covering_masks()), BLOCK_RADIUS + 1, int(together)
    of_block: list[range] = []
    while True:
        of_block += [range((h << low) - 1, (h + 1 << low) - 1) for h in range(1, 1 << (high - low))]
        if not low:
            return [tuple(b * n + t for t in own) for b in range(BLOCKS) for own in of_block]
        high, low = low, low // 2


def shared_masks(together: int) -> list[int]:
    """For each row of a fingerprint the bits of its block that all masks of its tables keep: rows that agree in the key of one of these
    tables agree in them."""
    masks = covering_masks()
    return [functools.reduce(int.__and__, (masks[t % len(masks)] for t in own)) for own in tables_of_rows(together)]


def block_values(v: np.ndarray, b: int) -> np.ndarray:
    """Block `b` of fingerprints (as uint64 words), as a number."""
    at, odd = divmod(b * BLOCK_BITS, 8)
    wide = v.view(np.uint8).reshape(len(v), -1)[:, at : at + 5].astype(np.int64) @ (1 << np.arange(32, -1, -8, dtype=np.int64))
    return wide >> (40 - BLOCK_BITS - odd) & ((1 << BLOCK_BITS) - 1)


def node(fp: str = "fp") -> F.Column:
    """What stands for a fingerprint where groups are connected: 16 bytes of its digest instead of all 32."""
    return F.unhex(F.md5(fp))


def _words(column: pa.Array) -> np.ndarray:
    """A column of fingerprints as uint64 words."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, BITS // 64)


def _sent_words(column: pa.Array) -> np.ndarray:
    """The same of a column without nulls, as its buffer holds it."""
    return np.frombuffer(column.buffers()[2], np.uint64, len(column) * (BITS // 64), column.offset * BITS // 8).reshape(-1, BITS // 64)


def _edges_of_row(own: tuple[int, ...], v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows, as `_edges_of` gives them, of all tables that a row stands for, together as one forest."""
    masks, left, right = covering_masks(), [], []
    block = block_values(v, own[0] // len(masks))
    for t in own:
        # keys and rows sorted as one number; a column holds fewer than 2^27 fingerprints
        both = np.sort((block & masks[t % len(masks)]) << 27 | np.arange(len(v)))
        key, order = both >> 27, both & ((1 << 27) - 1)
        same = key[1:] == key[:-1]
        shared = np.r_[same, False] | np.r_[False, same]
        order = order[shared]
        i, j = _edges_of(key[shared], v[order], most)
        left.append(order[i])
        right.append(order[j])
    return _forest(len(v), np.concatenate(left), np.concatenate(right))


def near_pairs(fps: DataFrame, most: float = MOST_DIFFERENT, together: int = FEW_ROWS) -> DataFrame:
    """(a, b): the nodes of distinct fingerprints in pairs that connect every near pair, some of them more than once. `fps` has
    one row per fingerprint. Pairs that differ in more than RADIUS bits, where `most` allows for such, may be missing.

    Fingerprints that differ in at most RADIUS of their bits meet in some table by construction. All that meet are compared over
    all bits, however many share a key. A key holds 15 bits of the fingerprint or more.
    Tables are rows, not loops. A row stands for up to 2^together tables and is sent by the bits that their keys share;
    within these, rows are sorted by each key. That bounds what is shuffled; the pairs are the same. Rows are made table by table:
    what is shuffled doesn't depend on how many of a fingerprint's rows go to one task and compress each other.
    """
    limit = int(most * BITS)
    rows_of, masks = tables_of_rows(together), shared_masks(together)
    per_block = len(rows_of) // BLOCKS

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = _words(batch.column(0))
                for r, mask in enumerate(masks):
                    if r % per_block == 0:
                        block = block_values(v, r // per_block)
                    yield pa.RecordBatch.from_arrays([pa.array((block & mask) + (r << BLOCK_BITS)), batch.column(0)], names=["key", "fp"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole_keys(batches):
            row = b.column(0).to_numpy(zero_copy_only=False) >> BLOCK_BITS
            cuts = [0, *(np.flatnonzero(row[1:] != row[:-1]) + 1).tolist(), len(row)]
            v, raw = _sent_words(b.column(1)), b.column(1)
            for at, to in zip(cuts, cuts[1:], strict=False):
                i, j = _edges_of_row(rows_of[row[at]], v[at:to], limit)
                if len(i):
                    ends = [pa.array([hashlib.md5(x).digest() for x in raw.take(pa.array(side + at)).to_pylist()], pa.binary()) for side in (i, j)]
                    yield pa.RecordBatch.from_arrays(ends, names=["a", "b"])

    rows = fps.select("fp").mapInArrow(spread, "key long, fp binary").repartition("key").sortWithinPartitions("key")
    return rows.mapInArrow(run, "a binary, b binary").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, th, n, keeper_id, keeper_th): for each group of near copies a row for each (doc_id, text) of it, with its rows `n`.

    A group is a set of documents connected by near pairs; exact copies share a fingerprint. The keeper has the least
    doc_id, null ones last, then the least hash of its text. Documents without words and those alone are not here.
    Whole texts of any length count. Other columns are ignored. Empty input: no rows.
    """
    fp = written(fingerprints(docs), "simhash").where("fp is not null")
    together = FEW_ROWS if fp.count() <= TOGETHER else 1
    with consumed(docs.sparkSession) as keep:
        groups = keep(connected_components(near_pairs(fp.select("fp").distinct(), together=together)), "groups")
    own = fp.withColumn("node", node()).join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    own = own.groupBy("root", "doc_id", "th").agg(F.count(F.lit(1)).alias("n"))
    first = own.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id"), F.col("th"))).alias("k"), F.sum("n").alias("rows")).where("rows > 1")
    return own.join(first, "root").select("doc_id", "th", "n", F.col("k.doc_id").alias("keeper_id"), F.col("k.th").alias("keeper_th"))


def is_keeper() -> F.Column:
    """Whether a row of `duplicates` is the one of its group that stays; null doc_ids are equal to each other."""
    return F.col("doc_id").eqNullSafe(F.col("keeper_id")) & (F.col("th") == F.col("keeper_th"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies, and all others, with the columns of `docs`.

    Nulls: no text or no word means no copy, the row stays; a null doc_id is a value that comes last. Rows alike in
    doc_id and text count as copies of each other: one stays. Extra columns are left alone. Empty input: no rows.
    """
    with consumed(docs.sparkSession) as keep:
        found = keep(duplicates(docs), "copies")
    keeper = is_keeper()
    gone = found.where(~keeper).select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"))
    again = found.where(keeper & (F.col("n") > 1)).select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"))
    keyed = packed(docs, ("doc_id", "text")).withColumn("__t", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__t") == F.col("__th"))
    marked = keyed.join(gone.withColumn("__what", F.lit(0)).unionByName(again.withColumn("__what", F.lit(1))), same, "left")
    kept = marked.where(F.col("__what").isNull()).select("doc_id", "text", "__rest")
    repeated = marked.where("__what = 1").dropDuplicates(["__id", "__th"]).select("doc_id", "text", "__rest")
    return unpacked(kept.unionByName(repeated), docs.columns, ("doc_id", "text"))


def op1_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, keeper_id): each document that is a near copy, with the document of its group that stays.

    Rows alike in doc_id and text are one document. A copy under a null doc_id, and another text under the
    keeper's own doc_id, are copies as all others. Texts without a word and documents alone are not here.
    """
    found = duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.where(~is_keeper()).select("doc_id", "keeper_id")
