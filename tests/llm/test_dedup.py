"""Near-dedup, substring dedup and fingerprints against brute force, and on the odd rows that tables hold."""

from __future__ import annotations

import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import Row

from tandemtext.llm import chunking, lempel_ziv, simhash
from tandemtext.llm.common import WORDS

SCHEMA = "doc_id long, text string"


def prose(rnd, n=200, vocabulary=4000):
    return " ".join(f"w{rnd.randrange(vocabulary)}x" if rnd.random() < 0.8 else "the" for _ in range(n))


def edited(rnd, text, share):
    return " ".join(f"new{rnd.randrange(10**6)}" if rnd.random() < share else w for w in text.split())


def corpus(seed=1, groups=12):
    rnd = random.Random(seed)
    rows, truth, i = [], {}, 0
    for g in range(groups):
        base = prose(rnd, rnd.randint(60, 400))
        for k in range(rnd.randint(1, 6)):
            rows.append((i, base if k < 2 else edited(rnd, base, 0.05)))
            truth[i] = g
            i += 1
    return rows, truth


def test_masks_cover_every_radius():
    masks = simhash.covering_masks(10, 3)
    assert len(masks) == 15
    for bits in itertools.combinations(range(10), 3):
        assert any(all(not m >> b & 1 for b in bits) for m in masks)


def test_all_bits_are_searched(spark):
    rnd = random.Random(51)
    pairs = []
    for _ in range(100):
        a = rnd.getrandbits(simhash.BITS)
        # as many bits differ as is guaranteed to be found, all in one half
        half = rnd.choice((0, simhash.BITS // 2))
        flipped = sum(1 << b for b in rnd.sample(range(half, half + simhash.BITS // 2), simhash.RADIUS))
        pairs.append(tuple(sorted(x.to_bytes(simhash.BITS // 8, "big") for x in (a, a ^ flipped))))
    fps = spark.createDataFrame([(bytearray(f),) for p in pairs for f in p], "fp binary")
    got = simhash.near_pairs(fps).collect()
    assert {(bytes(r.a), bytes(r.b)) for r in got} == {tuple(sorted(hashlib.md5(f).digest() for f in p)) for p in pairs}
    of = {bytes(r.fp): bytes(r.n) for r in fps.select("fp", simhash.node().alias("n")).collect()}
    assert all(n == hashlib.md5(f).digest() for f, n in of.items())


def test_all_pairs_at_the_threshold_meet(spark):
    # as many bits differ as the threshold allows, about as many in each part of the fingerprint, or in any
    rnd = random.Random(52)
    limit = int(simhash.MOST_DIFFERENT * simhash.BITS)
    assert limit <= simhash.RADIUS
    pairs = []
    for k in range(200):
        a = rnd.getrandbits(simhash.BITS)
        flip = rnd.sample(range(simhash.BITS), limit) if k % 2 else [b for at in range(0, simhash.BITS, 16) for b in rnd.sample(range(at, at + 16), limit // 16)]
        pairs.append(tuple(sorted(hashlib.md5(x.to_bytes(32, "big")).digest() for x in (a, a ^ sum(1 << b for b in flip)))))
        pairs[-1] += (a, a ^ sum(1 << b for b in flip))
    fps = spark.createDataFrame([(bytearray(f.to_bytes(32, "big")),) for p in pairs for f in p[2:]], "fp binary")
    for together in (simhash.FEW_ROWS, 1):
        assert {(bytes(r.a), bytes(r.b)) for r in simhash.near_pairs(fps, together=together).collect()} == {p[:2] for p in pairs}


def test_rows_of_many_tables_are_sent_by_four_bits():
    n = len(simhash.covering_masks())
    of = simhash.tables_of_rows(simhash.FEW_ROWS)
    assert sorted(t for own in of for t in own) == list(range(simhash.BLOCKS * n)) and len(of) == 12 * simhash.BLOCKS
    assert min(m.bit_count() for m in simhash.shared_masks(simhash.FEW_ROWS)) >= 4
    assert min(m.bit_count() for m in simhash.covering_masks()) >= 15


def test_rows_share_what_their_tables_keep():
    masks = simhash.covering_masks()
    for together in (False, True):
        of, shared = simhash.tables_of_rows(together), simhash.shared_masks(together)
        assert sorted(t for own in of for t in own) == list(range(simhash.BLOCKS * len(masks)))
        for own, keep in zip(of, shared, strict=True):
            assert len({t // len(masks) for t in own}) == 1 and keep
            assert all(keep & masks[t % len(masks)] == keep for t in own)


def test_rows_of_two_tables_give_the_pairs_of_one(spark):
    rows, _ = corpus(23, 20)
    fps = spark.createDataFrame([(bytearray(f),) for f in sorted({simhash.fingerprint(set(WORDS.findall(t.lower()))) for _, t in rows})], "fp binary")
    groups = [{(bytes(r.node), bytes(r.root)) for r in simhash.connected_components(simhash.near_pairs(fps, together=x)).collect()} for x in (False, True)]
    assert groups[0] == groups[1] and groups[0]


def test_groups_match_truth(spark):
    rows, truth = corpus()
    got = {r.doc_id: r.keeper_id for r in simhash.duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, g in truth.items():
        members = [j for j in truth if truth[j] == g]
        assert got.get(i, i) == min(members)


def test_pairs_match_brute_force(spark):
    rnd = random.Random(5)
    rows, _ = corpus(7, 8)
    fps = sorted({simhash.fingerprint(set(WORDS.findall(t.lower()))) for _, t in rows + [(0, prose(rnd))]})
    v = {f: np.frombuffer(f, np.uint64) for f in fps}
    limit = int(simhash.MOST_DIFFERENT * simhash.BITS)
    near = {(a, b) for a, b in itertools.combinations(fps, 2) if int(np.bitwise_count(v[a] ^ v[b]).sum()) <= limit}
    got = simhash.near_pairs(spark.createDataFrame([(bytearray(f),) for f in fps], "fp binary")).collect()
    named = {hashlib.md5(f).digest(): f for f in fps}
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    got = [Row(a=named[bytes(r.a)], b=named[bytes(r.b)]) for r in got]
    for r in got:
        assert (min(bytes(r.a), bytes(r.b)), max(bytes(r.a), bytes(r.b))) in near
        parent[find(bytes(r.a))] = find(bytes(r.b))
    assert all(find(a) == find(b) for a, b in near)


def test_bucket_edges_connect_like_all_pairs():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, (6, 4), dtype=np.uint64)
    v = np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 60, (30, 4)).astype(np.uint64)) for b in base])
    v = v[rng.permutation(len(v))]
    edges = simhash.bucket_edges(v, 10)
    parent = list(range(len(v)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    near = np.bitwise_count(v[:, None] ^ v[None]).sum(-1) <= 10
    for i, j in zip(*np.nonzero(near), strict=True):
        assert find(int(i)) == find(int(j))
    assert len({find(i) for i in range(len(v))}) == 6


ODD = [(1, None), (2, ""), (3, "  \n "), (None, "one two three four five"), (5, "one two three four five"), (5, "one two three four five"), (6, "!!!"), (7, "solo words here"), (None, None)]


def test_keep_one_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, "x", k, k, "y") for k, (i, t) in enumerate(ODD)], "doc_id long, text string, root string, th long, __id long, `a.b` string")
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in got.collect()]
    assert kept.count((5, "one two three four five")) == 1 and (None, "one two three four five") not in kept
    assert len(kept) == len(ODD) - 2
    assert simhash.keep_one(docs.limit(0)).count() == 0
    assert simhash.duplicates(docs.limit(0)).count() == 0


def test_query_names_all_copies(spark, tmp_path):
    # a copy under a null id, one under the keeper's own id with another text, rows alike
    text = prose(random.Random(61), 120)
    rows = [(4, text), (None, text + " end"), (4, text + " more"), (4, text), (9, text), (10, "something else entirely here"), (11, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = simhash.op1_simhash_neardup(spark, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.keeper_id) for r in got), key=str) == [(4, 4), (9, 4), (None, 4)]


def test_groups_of_a_table_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.keeper_id for r in simhash.duplicates(docs).collect()}
    fp = {r.doc_id: simhash.fingerprint(set(WORDS.findall(r.text.lower()))) for r in docs.collect()}
    fp = {i: np.frombuffer(f, np.uint64) for i, f in fp.items() if f}
    ids, v = np.array(list(fp)), np.array(list(fp.values()))
    root = {int(i): int(i) for i in ids}
    for a in range(len(ids)):
        for b in np.flatnonzero(np.bitwise_count(v[a] ^ v[a + 1 :]).sum(1) <= simhash.MOST_DIFFERENT * simhash.BITS) + a + 1:
            x, y = sorted((root[int(ids[a])], root[int(ids[b])]))
            root = {i: x if r == y else r for i, r in root.items()} if x != y else root
    split = sum(got.get(i, i) != r for i, r in root.items())
    assert split <= 0.02 * sum(i != r for i, r in root.items()) and all(root[i] == root[k] for i, k in got.items())


def test_large_keys_are_searched_as_small_ones(spark, monkeypatch):
    rows, _ = corpus(17, 30)
    fps = [(bytearray(f),) for f in sorted({simhash.fingerprint(set(WORDS.findall(t.lower()))) for _, t in rows})]
    groups = []
    for at_once in (64, 1):
        monkeypatch.setattr(simhash, "_AT_ONCE", at_once)
        found = simhash.connected_components(simhash.near_pairs(spark.createDataFrame(fps, "fp binary"))).collect()
        groups.append({(bytes(r.node), bytes(r.root)) for r in found})
    assert groups[0] == groups[1] and groups[0]


def test_crowded_keys_keep_the_guarantee(monkeypatch):
    # one key holds random rows, among them pairs that differ in as many bits as is guaranteed
    monkeypatch.setattr(simhash, "CROWDED", 100)
    rng, rnd = np.random.default_rng(3), random.Random(3)
    masks = simhash.covering_masks()
    rows, pairs = [], []
    for k in range(400):
        a = int.from_bytes(rng.bytes(32), "big") & ~(masks[2] << (simhash.BITS - 3 * simhash.BLOCK_BITS))  # block 2 has key 0 under this mask
        rows.append(a)
        if k % 4 == 0:
            free = [i for i in range(simhash.BITS) if not (masks[2] << (simhash.BITS - 3 * simhash.BLOCK_BITS)) >> i & 1]
            third = [i for i in free if simhash.BITS - 3 * simhash.BLOCK_BITS <= i < simhash.BITS - 2 * simhash.BLOCK_BITS]
            flip = rnd.sample(third, 3) + rnd.sample([i for i in free if i not in third], simhash.RADIUS - 3)
            rows.append(a ^ sum(1 << i for i in flip))
            pairs.append((len(rows) - 2, len(rows) - 1))
    v = np.frombuffer(b"".join(x.to_bytes(32, "big") for x in rows), np.uint64).reshape(-1, 4)
    keys = np.full(len(rows), (2 * len(masks) + 2) << simhash.BLOCK_BITS)
    i, j = simhash._edges_of(keys, v, int(simhash.MOST_DIFFERENT * simhash.BITS))
    assert {tuple(sorted(p)) for p in zip(i.tolist(), j.tolist(), strict=True)} >= set(pairs)


def test_crowded_keys_find_every_near_pair(monkeypatch):
    # pairs at the threshold, spread over all blocks but the one of the key: however many rows share the key, all are found
    rnd = random.Random(9)
    limit = int(simhash.MOST_DIFFERENT * simhash.BITS)
    rest = simhash.BITS - simhash.BLOCK_BITS  # the key is of block 0
    rows = []
    for _ in range(150):
        a = rnd.getrandbits(rest)
        rows += [a, a ^ sum(1 << i for i in rnd.sample(range(rest), limit))]
    centre = rnd.getrandbits(rest)  # and a group whose rows lie around one
    rows += [centre] + [centre ^ sum(1 << i for i in rnd.sample(range(rest), 30)) for _ in range(100)]
    v = np.frombuffer(b"".join(x.to_bytes(32, "big") for x in rows), np.uint64).reshape(-1, 4)
    i, j = np.nonzero(np.triu(np.bitwise_count(v[:, None] ^ v[None]).sum(-1) <= limit, 1))
    truth = {tuple(map(int, p)) for p in zip(*simhash._forest(len(v), i, j), strict=True)}
    assert len(truth) == 250
    for at_once, crowded, leaders in ((64, 10**6, 64), (10**6, 10**6, 64), (1, 100, 64), (1, 100, 4), (1, 1, 10**6)):
        monkeypatch.setattr(simhash, "_AT_ONCE", at_once)
        monkeypatch.setattr(simhash, "CROWDED", crowded)
        monkeypatch.setattr(simhash, "_LEADERS", leaders, raising=False)
        got = simhash._edges_of(np.zeros(len(v), np.int64), v, limit)
        assert {tuple(map(int, p)) for p in zip(*got, strict=True)} == truth


def test_long_text(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    docs = spark.createDataFrame([(1, long), (2, long + " more"), (3, "a" * 300_000)], SCHEMA)
    assert [(r.doc_id, r.keeper_id) for r in simhash.duplicates(docs).where("doc_id != keeper_id").collect()] == [(2, 1)]


# passages


def test_gear_hash_and_cuts_match_a_loop():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 123, 3000).astype(np.uint8)
    h = chunking.gear_hashes(data)
    loop = np.zeros(len(data), np.uint32)
    for i in range(len(data)):
        loop[i] = sum(int(chunking._GEAR[data[i - j]]) << j for j in range(min(chunking.GEAR_WINDOW, i + 1))) & 0xFFFFFFFF
    assert (h == loop).all()
    n = chunking.REACH
    want = [i for i in range(len(h) - 1) if all(h[i] > h[j] for j in range(max(0, i - n), i)) and all(h[i] >= h[j] for j in range(i + 1, min(len(h), i + n + 1)))]
    inner = lambda x: [i for i in x if n < i < len(h) - n - 1]
    assert inner(chunking.cuts(data).tolist()) == inner(want)


def test_chunks_cover_texts_and_depend_on_them_only():
    rnd = random.Random(2)
    texts = [prose(rnd, rnd.randint(0, 300)).encode() for _ in range(20)] + [b"", b"x", b"aaaa" * 500]
    owner, start, end, words, place, buffer = chunking.chunk_spans(texts)
    for k, t in enumerate(texts):
        own = np.flatnonzero(owner == k)
        assert b"".join(buffer[place[i] : place[i] + end[i] - start[i]] for i in own) == t
        alone = chunking.chunk_spans([t])
        assert (alone[1] == start[own]).all() and (alone[2] == end[own]).all() and (alone[3] == words[own]).all()


def brute_repeats(rows, min_words):
    """Runs of chunks that another document has too, by a dictionary of chunk bytes."""
    docs = sorted({(i, t) for i, t in rows if t}, key=str)
    cut = {}
    for d in docs:
        _, s, e, w, place, buffer = chunking.chunk_spans([d[1].encode()])
        cut[d] = [(int(a), int(b), int(n), buffer[p : p + b - a]) for a, b, n, p in zip(s, e, w, place, strict=True)]
    owners = {}
    for d, cs in cut.items():
        for c in cs:
            owners.setdefault(c[3], set()).add(d)
    out = []
    for d, cs in cut.items():
        run = []
        for c in [*cs, None]:
            if c and len(owners[c[3]]) > 1:
                run.append(c)
            else:
                if run and sum(x[2] for x in run) >= min_words:
                    ids = [i for x in run for i, _ in owners[x[3]]]
                    first = min([i for i in ids if i is not None], default=None)
                    out.append((d[0], run[0][0], run[-1][1] - run[0][0], sum(x[2] for x in run), first))
                run = []
    return sorted(out, key=str)


def test_repeats_match_brute_force(spark):
    rnd = random.Random(4)
    passage = prose(rnd, 70)
    rows = [(i, prose(rnd, 50) + (" " + passage + " " if i % 3 == 0 else " ") + prose(rnd, 40)) for i in range(12)]
    rows += [(20, rows[1][1]), (21, None), (22, ""), (None, prose(rnd, 30) + " " + passage), (23, prose(rnd, 5) + " All rights reserved."), (24, prose(rnd, 6) + " All rights reserved."), (25, passage + " " + passage), (26, "z" * 100_000), (26, "z" * 100_000)]
    got = chunking.repeated_passages(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute_repeats(rows, chunking.MIN_WORDS)
    assert {r.doc_id for r in got} == {0, 3, 6, 9, 1, 20, None, 25}


@pytest.mark.parametrize("common, most", [(3, 10_000), (3, 2), (64, 10_000)])
def test_common_chunks_are_counted_apart(spark, monkeypatch, common, most):
    monkeypatch.setattr(chunking, "SHARE", 1 if common < 64 else chunking.SHARE)
    monkeypatch.setattr(chunking, "COMMON", common)
    monkeypatch.setattr(chunking, "MOST_COMMON", most)
    rnd = random.Random(14)
    license_, other = prose(rnd, 60), prose(rnd, 55)
    rows = [(i, f"{prose(rnd, 30)} {license_} {prose(rnd, 20)}" + (f" {other} " if i % 10 == 0 else "")) for i in range(60)]
    rows += [(None, license_), (70, license_ + " " + license_), (71, None), (72, "z" * 5000)]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, u long, d1 long, start long")
    assert (chunking.common_digests(docs).count() > 0) == (common == 3)
    got = chunking.repeated_passages(docs).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute_repeats(rows, chunking.MIN_WORDS) and len(got) >= 60


@pytest.mark.parametrize("words", [51, 60, 90])
def test_no_passage_is_missed(spark, words):
    rnd = random.Random(words)
    rows, planted = [], []
    for k in range(30):
        p = prose(rnd, words)
        for j in range(2):
            rows.append((2 * k + j, prose(rnd, rnd.randint(1, 60)) + " " + p + " " + prose(rnd, rnd.randint(1, 60))))
            planted.append(2 * k + j)
    rows += [(1000 + k, prose(rnd, 150)) for k in range(30)]
    got = {r.doc_id for r in chunking.repeated_passages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == set(planted)


def test_repeats_empty_table(spark):
    assert chunking.repeated_passages(spark.createDataFrame([], SCHEMA)).count() == 0


# fingerprints


def lz78(words):
    seen, cur = [], ()
    for w in words:
        cur += (w,)
        if cur not in seen:
            seen.append(cur)
            cur = ()
    return seen


def test_phrases_match_a_plain_parse():
    rnd = random.Random(8)
    for n in (0, 1, 2, 50, 400):
        words = [rnd.choice("abcde") for _ in range(n)]
        parent, added = lempel_ziv.phrases(words)
        spelled = [()]
        for p, w in zip(parent.tolist(), added, strict=True):
            spelled.append((*spelled[p], w))
        assert spelled[1:] == lz78(words)
        hashes = lempel_ziv.phrase_hashes(parent, added) if n else np.zeros(0)
        assert len(set(hashes.tolist())) == len(spelled) - 1


def brute_partners(rows):
    sig = [(i, *lempel_ziv.signature(t)) for i, t in rows]
    out = []
    for k, (i, n, s) in enumerate(sig):
        partner, sim = None, None
        if s is not None:
            equal = [j for m, (j, _, o) in enumerate(sig) if o == s and j is not None and j != i]
            if equal:
                partner, sim = min(equal), 1.0
            else:
                a = np.frombuffer(s, np.uint8)
                best = None
                for o in {o for _, _, o in sig if o is not None and o != s}:
                    b = np.frombuffer(o, np.uint8)
                    same = a == b
                    if same.sum() / len(a) >= lempel_ziv.SIMILARITY and same.reshape(-1, lempel_ziv.ROWS).all(1).any():
                        key = (-int(same.sum()), o)
                        best = min(best, key) if best else key
                if best:
                    partner = min((j for j, _, o in sig if o == best[1] and j is not None), default=None)
                    sim = round(-best[0] / lempel_ziv.MINIMA, 6) if partner is not None else None
        out.append((i, n, partner, sim))
    return sorted(out, key=str)


def test_partners_match_brute_force(spark):
    rows, _ = corpus(11, 10)
    rows += [(500, None), (501, ""), (502, "..."), (None, rows[0][1]), (503, "x"), (503, "x"), (504, "word " * 20_000)]
    got = lempel_ziv.fingerprint_partners(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted([(r.doc_id, r.n_phrases, r.partner_id, r.similarity) for r in got], key=str) == brute_partners(rows)
    assert lempel_ziv.fingerprint_partners(spark.createDataFrame([], SCHEMA)).count() == 0


def test_near_copies_find_each_other(spark):
    rnd = random.Random(21)
    rows = []
    for k in range(60):
        base = prose(rnd, rnd.randint(80, 300))
        rows += [(2 * k, base), (2 * k + 1, edited(rnd, base, 0.06))]
    got = {r.doc_id: r.partner_id for r in lempel_ziv.fingerprint_partners(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sum(got[i] == i ^ 1 for i in got) / len(got) >= 0.9


def brute_groups(sigs):
    """The least signature of each signature's group, over all pairs that agree in a band and are similar enough."""
    v = {s: np.frombuffer(s, np.uint8) for s in sigs}
    root = {s: s for s in sigs}
    for a, b in itertools.combinations(sorted(v), 2):
        same = v[a] == v[b]
        if same.mean() >= lempel_ziv.SIMILARITY and same.reshape(-1, lempel_ziv.ROWS).all(1).any() and root[a] != root[b]:
            low, high = sorted((root[a], root[b]))
            root = {s: low if r == high else r for s, r in root.items()}
    return root


def test_fingerprint_groups_hold_all_partners(spark, monkeypatch):
    monkeypatch.setattr(lempel_ziv, "_PAIRS", 5)
    rnd = random.Random(31)
    one = prose(rnd, 300)
    other = edited(rnd, one, 0.04)
    # two sets of exact copies near each other: every row has an equal one as its partner
    rows = [(0, one), (1, one), (2, other), (3, other), (None, one), (4, None), (5, "..."), (6, prose(rnd, 80))]
    base = prose(rnd, 250)
    rows += [(10 + k, edited(rnd, base, rnd.choice((0.02, 0.08)))) for k in range(25)]
    got = lempel_ziv.fingerprint_partners(spark.createDataFrame(rows, SCHEMA)).collect()
    of = {r.doc_id: r.group_id for r in got}
    assert {r.doc_id: r.partner_id for r in got if r.doc_id in (0, 1, 2, 3)} == {0: 1, 1: 0, 2: 3, 3: 2}
    assert len({of[i] for i in (0, 1, 2, 3, None)}) == 1
    assert of[4] is None and of[5] is None and of[6] == next(r.fingerprint for r in got if r.doc_id == 6)
    sig = {i: lempel_ziv.signature(t)[1] for i, t in rows}
    root = brute_groups({s for s in sig.values() if s})
    for a, b in itertools.combinations([i for i in sig if sig[i]], 2):
        assert (of[a] == of[b]) == (root[sig[a]] == root[sig[b]])


def test_recall_at_the_reported_similarity(spark):
    rng = np.random.default_rng(41)
    n, least = 1500, int(np.ceil(lempel_ziv.SIMILARITY * lempel_ziv.MINIMA))
    a = rng.integers(0, 256, (n, lempel_ziv.MINIMA), np.uint8)
    changed = rng.permuted(np.tile(np.arange(lempel_ziv.MINIMA) >= least, (n, 1)), axis=1)
    b = a + changed * rng.integers(1, 256, a.shape, np.uint8)
    assert ((a == b).sum(axis=1) == least).all()
    rows = [(bytearray(x.tobytes()),) for x in np.concatenate([a, b])]
    got = {(bytes(r.sig), bytes(r.other)) for r in lempel_ziv.partners(spark.createDataFrame(rows, "sig binary")).collect()}
    # every pair of a row of a and its copy is similar enough, whether or not they agree in a band
    assert sum((x.tobytes(), y.tobytes()) in got for x, y in zip(a, b, strict=True)) / n >= 0.95
