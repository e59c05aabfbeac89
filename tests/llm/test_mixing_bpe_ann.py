"""Mixing, tokens, nearest neighbours and the pipeline."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tandemtext.llm import bpe, hilbert, language, mixing, secrets_crf, simhash

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks()


# mixing


def brute_mix(rows, weights, share):
    import hashlib

    key = lambda i, t: hashlib.md5(f"{mixing.SEED}|{'-' if i is None else i}|{t or ''}".encode()).hexdigest()[:16]
    groups = {}
    for i, t, s in rows:
        k = (s or "", key(i, t))
        groups[k] = groups.get(k, 0) + len((t or "").split())
    queue, cum = [], {}
    for (s, k), n in sorted(groups.items()):
        cum[s] = cum.get(s, 0) + n
        if weights.get(s, 1.0) > 0:
            queue.append((cum[s] / weights.get(s, 1.0), k, s, n))
    total, out, budget = 0, set(), int(sum(groups.values()) * share)
    for fin, k, s, n in sorted(queue):
        total += n
        if total <= budget:
            out.add((s, k))
    return sorted((r for r in rows if ((r[2] or ""), key(r[0], r[1])) in out), key=str)


@pytest.mark.parametrize("weights, share", [({"a": 3.0, "b": 1.0}, 0.5), ({"a": 0.0}, 0.7), ({}, 1.0), ({"b": 0.1}, 0.01)])
def test_mix_matches_brute_force(spark, weights, share):
    rnd = random.Random(3)
    rows = [(i, " ".join("w" for _ in range(rnd.randint(0, 30))), rnd.choice(["a", "a", "b", None])) for i in range(80)]
    rows += [(None, "x y", "a"), (5, None, "b"), (7, rows[7][1], rows[7][2]), (90, "w " * 3000, "b")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, __key long")
    out = mixing.mix_sources(docs, weights, share=share)
    assert out.columns == docs.columns
    assert sorted([tuple(r)[:3] for r in out.collect()], key=str) == brute_mix(rows, weights, share)
    assert mixing.mix_sources(docs.limit(0)).count() == 0


# tokens


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("ab '\n\tsé1!#漢-\x85"), max_size=80), st.integers(1, 9), st.integers(1, 6))
def test_tree_encodes_like_the_whole(text, leaf, window):
    codec = bpe.Codec(_RANKS, leaf, window)
    assert codec.encode(text).tolist() == codec.whole(text).tolist()
    assert codec.decode(codec.encode(text)) == text.encode()


_RANKS = bpe.read_ranks()


def test_long_texts(ranks):
    codec, whole = bpe.Codec(ranks, 1000), bpe.Codec(ranks, 10**9)
    for text in ("word and more " * 20_000, "x" * 5000, " " * 5000, "a\n" * 9000, "né" * 3000):
        assert np.array_equal(codec.encode(text), whole.encode(text))


def test_tokenize_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "hello <|endoftext|> world"), (None, "é漢🙂"), (4, "w " * 60_000), (3, "hello <|endoftext|> world")]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, n_tokens long")
    got = bpe.tokenize(docs).collect()
    assert len(got) == len(rows)
    codec = bpe.Codec(bpe.read_ranks())
    for r in got:
        if r.text is None:
            assert r.tokens is None and r.n_tokens is None and r.round_trip is None
        else:
            assert r.round_trip and r.n_tokens == len(r.tokens) and codec.decode(np.array(r.tokens, int)) == r.text.encode()
    assert bpe.tokenize(docs.limit(0)).count() == 0


# neighbours


def test_hilbert_curve_visits_all_cells_by_steps():
    import itertools

    for dims, levels in ((2, 3), (3, 2), (4, 2)):
        g = np.array(list(itertools.product(range(1 << levels), repeat=dims)))
        k = hilbert.hilbert_keys(g, levels)
        assert sorted(k.tolist()) == list(range(len(g)))
        assert (np.abs(np.diff(g[np.argsort(k)], axis=0)).sum(1) == 1).all()


def brute_neighbours(rows, k):
    ids, v = [i for i, _ in rows], np.array([x for _, x in rows], dtype=np.float32).astype(float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    s = v @ v.T
    return {i: sorted(((-round(float(s[a, b]), 6), j) for b, j in enumerate(ids) if b != a))[:k] for a, i in enumerate(ids)}


@pytest.mark.parametrize("clusters", [0, 12])
def test_neighbours_match_brute_force(spark, clusters):
    rng = np.random.default_rng(clusters)
    x = rng.standard_normal((400, 16))
    if clusters:
        x = rng.standard_normal((clusters, 16))[rng.integers(0, clusters, 400)] * 3 + 0.2 * x
    rows = [(int(i), [float(t) for t in v]) for i, v in enumerate(x)]
    odd = [(None, rows[0][1]), (500, None), (501, []), (502, [0.0] * 16), (503, [float("nan")] * 16), (504, [1.0, 2.0]), (3, rows[3][1])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    want = brute_neighbours(rows, 5)
    got = hilbert.neighbours(df, k=5).toPandas()
    assert len(got) == 400 * 5
    for i, part in got.groupby("id"):
        own = part.sort_values("rank")
        assert own.sim.round(5).tolist() == pytest.approx([-s for s, _ in want[i]], abs=2e-5)
    curves = hilbert.neighbours(df, k=5, exact=False).toPandas()
    hit = sum(len(set(part.other) & {j for _, j in want[i]}) for i, part in curves.groupby("id")) / (400 * 5)
    assert hit > (0.9 if clusters else 0.5)


def test_completion_in_small_blocks(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(t) for t in v]) for i, v in enumerate(rng.standard_normal((150, 8)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    base = hilbert.written(hilbert.unit_vectors(hilbert.usable_vectors(df, "vec_id", "embedding")), "t")
    known = hilbert.written(hilbert.window_candidates(base, 4, 8), "t")
    got = hilbert.nearest(known.unionByName(hilbert.completed(base, known, 4, 16)), 4).toPandas()
    want = brute_neighbours(rows, 4)
    assert all(set(p.other) == {j for _, j in want[i]} for i, p in got.groupby("id"))


def test_each_dimension_by_itself_and_clashing_names(spark):
    rng = np.random.default_rng(8)
    rows = {d: [(1000 * d + i, [float(t) for t in v]) for i, v in enumerate(rng.standard_normal((n, d)))] for d, n in ((4, 30), (600, 12))}
    data = [(*r, "a", [1], 2, 3) for own in rows.values() for r in own] + [(9, [1.0], "a", [1], 2, 3)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, id string, keys array<long>, place int, vec int")
    got = hilbert.neighbours(df, k=3).toPandas()
    for own in rows.values():
        want = brute_neighbours(own, 3)
        for i, _ in own:
            assert set(got[got.id == i].other) == {j for _, j in want[i]}
    assert len(got) == 3 * 42


def test_few_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert sorted((r.id, r.other) for r in hilbert.neighbours(df).collect()) == [(1, 2), (2, 1)]
    assert hilbert.neighbours(df.limit(0)).count() == 0
    assert hilbert.neighbours(df.where("vec_id = 1")).count() == 0


# pipeline


def test_pipeline_matches_its_parts(spark):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["language_id", "near_dedup", "secret_scan", "mix", "encode"] and P.ORACLE_SQL is None
    got = P.run(spark, DATA).toPandas().sort_values("doc_id").reset_index(drop=True)

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = language.train(spark, docs)
    rows = []
    for r in docs.collect():
        data = language.encode(r.text)
        lang, n = language.classify(model, data)
        if language.accepted(model, lang, n, len(data)):
            rows.append([r.doc_id, r.text, lang, r.source, r.n_chars])
    fp = [np.frombuffer(simhash.fingerprint(set(simhash.WORDS.findall(t.lower()))) or bytes(32), np.uint64) for _, t, *_ in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if np.bitwise_count(fp[i] ^ fp[j]).sum() <= simhash.MOST_DIFFERENT * simhash.BITS:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {}
    for g, r in zip(group, rows, strict=True):
        least[g] = min(least.get(g, r[0]), r[0])
    rows = [r for g, r in zip(group, rows, strict=True) if least[g] == r[0]]
    tagger = secrets_crf.Tagger(secrets_crf.trained())
    for r, spans in zip(rows, tagger.find([r[1] for r in rows]), strict=True):
        for s, e in reversed(spans):
            r[1] = r[1][:s] + secrets_crf.REDACTED + r[1][e:]
        r[4] = len(r[1])
    kept = {m[0] for m in brute_mix([(r[0], r[1], r[3]) for r in rows], mixing.WEIGHTS, mixing.BUDGET_SHARE)}
    want = sorted([r for r in rows if r[0] in kept])
    codec = bpe.Codec(bpe.read_ranks(), 10**9)
    assert got.doc_id.tolist() == [r[0] for r in want]
    for g, w in zip(got.itertuples(), want, strict=True):
        assert [g.text, g.lang, g.source, g.n_chars] == w[1:] and list(g.tokens) == codec.encode(w[1]).tolist() and g.round_trip


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline as P

    spark.read.parquet(f"{DATA}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_columns(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumns({"root": F.lit(1), "__lang": F.lit("x"), "a.b": F.lit(2)})
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns and out.first()["__lang"] == "x"
