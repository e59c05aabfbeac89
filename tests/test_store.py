from __future__ import annotations

import random
import sqlite3
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandemtext.functions.components import connected_components
from tandemtext.functions.intervals import within
from tandemtext.functions.ranking import running_total
from tandemtext.functions.runs import whole_keys
from tandemtext.operators import books, embed, store
from tandemtext.operators import lines as line_tables
from tandemtext.plans import alignment
from tandemtext.sources import exports, readers
from tandemtext.streaming import incremental


def lines(spark):
    return spark.createDataFrame([("d", s, i, f"{s}{i}", 7) for s in ("from", "to") for i in (1, 2, 3)], "doc_id string, side string, line_id long, text string, paragraph long")


def meta(spark):
    return spark.createDataFrame([("d", "from", "h1", "A", 0, 1, False), ("d", "from", "h1", "B", 1, 5, False), ("d", "from", "h2", "C", 0, 2, True)], "doc_id string, side string, mark string, val string, occurrence long, par_id long, deleted boolean")


def test_line_edits(spark):
    got = store.insert_lines(lines(spark), "from", spark.createDataFrame([("d", 2)], "doc_id string, line_id long"))
    assert [(r.line_id, r.text, r.paragraph) for r in got.where("side = 'from'").orderBy("line_id").collect()] == [(1, "from1", 7), (2, "from2", 7), (3, "", 7), (4, "from3", 7)]
    assert got.where("side = 'to'").count() == 3
    several = spark.createDataFrame([("d", 3), ("d", 1), ("d", 1), ("d", 99)], "doc_id string, line_id long")
    got = store.insert_lines(lines(spark), "from", several).where("side = 'from'").orderBy("line_id").collect()
    assert [(r.line_id, r.text) for r in got] == [(1, "from1"), (2, ""), (3, ""), (4, "from2"), (5, "from3"), (6, "")]
    match = spark.createDataFrame([("d", [1, 2]), ("d", [3]), ("e", [3])], "doc_id string, to_ids array<long>")
    assert [r.to_ids for r in store.shift_ids(match, "to", several).collect()] == [[1, 4], [5], [3]]
    new = spark.createDataFrame([("d", "to", 2, "changed"), ("d", "to", 3, None)], "doc_id string, side string, line_id long, value string")
    assert [r.text for r in store.set_text(lines(spark), new).where("side = 'to'").orderBy("line_id").collect()] == ["to1", "changed", "to3"]


def test_meta_edits(spark):
    key = lambda df: sorted((r.mark, r.val, r.occurrence, r.par_id, r.deleted) for r in df.collect())
    new = spark.createDataFrame([("d", "from", "h1", "N", 3)], "doc_id string, side string, mark string, val string, par_id long")
    assert key(store.add_meta(meta(spark), new)) == [("h1", "A", 0, 1, False), ("h1", "B", 2, 5, False), ("h1", "N", 1, 3, False), ("h2", "C", 0, 2, True)]
    moved = spark.createDataFrame([("d", "from", "h1", 0, "A2", 9)], "doc_id string, side string, mark string, occurrence long, val string, par_id long")
    assert key(store.edit_meta(meta(spark), moved)) == [("h1", "A2", 1, 9, False), ("h1", "B", 0, 5, False), ("h2", "C", 0, 2, True)]
    gone = store.delete_meta(meta(spark), moved)
    assert [r.val for r in gone.where("deleted").orderBy("val").collect()] == ["A", "C"]
    assert books.meta_value(meta(spark), "h1", "from", 1).first().val == "B" and books.meta_value(meta(spark), "title", "from").first().val == ""
    assert books.next_heading(meta(spark)).first().val == "A"


def test_save_replaces_documents_only(spark, tmp_path):
    row = lambda d, b: (d, b, 0, [1], [1], 0.5)
    schema = "doc_id string, batch_id long, sub_id long, from_ids array<long>, to_ids array<long>, sim double"
    store.save(spark.createDataFrame([row("a", 0), row("b", 0)], schema), str(tmp_path), "match")
    store.save(spark.createDataFrame([row("b", 5)], schema), str(tmp_path), "match")
    assert sorted((r.doc_id, r.batch_id) for r in store.load(spark, str(tmp_path), "match").collect()) == [("a", 0), ("b", 5)]


def test_stream_upserts(spark, tmp_path):
    schema = "doc_id string, batch_id long, sub_id long, from_ids array<long>, to_ids array<long>, sim double"
    land, out, check = (f"{tmp_path}/{x}" for x in ("in", "out", "check"))
    for rows in ([("a", 0, 0, [1], [1], 0.1), ("a", 1, 0, [2], [2], 0.1), ("b", 0, 0, [1], [1], 0.1)], [("a", 1, 0, [2], [9], 0.2), ("a", 1, 1, [3], [9], 0.2)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(land)
        incremental.upsert_matches(incremental.stream_table(spark, land, "match"), out, check).awaitTermination()
    got = sorted((r.doc_id, r.batch_id, r.sub_id, tuple(r.to_ids)) for r in store.load(spark, out, "match").collect())
    assert got == [("a", 0, 0, (1,)), ("a", 1, 0, (9,)), ("a", 1, 1, (9,)), ("b", 0, 0, (1,))]


def test_stream_takes_one_version_of_a_batch(spark, tmp_path):
    schema = "doc_id string, batch_id long, sub_id long, from_ids array<long>, to_ids array<long>, sim double, version long"
    land, out, check = (f"{tmp_path}/{x}" for x in ("in", "out", "check"))
    put = lambda *rows: spark.createDataFrame([(d, b, s, [1], [t], 0.1, v) for d, b, s, t, v in rows], schema).coalesce(1).write.mode("append").parquet(land)
    go = lambda: incremental.upsert_matches(incremental.stream_table(spark, land, "match"), out, check).awaitTermination()
    got = lambda: sorted((r.doc_id, r.batch_id, r.sub_id, r.to_ids[0]) for r in store.load(spark, out, "match").collect())
    # two files with the same batches in one trigger: without versions the later file counts, with versions the larger one
    put(("a", 0, 0, 9, None), ("b", 0, 0, 5, 7), ("b", 0, 1, 5, 7))
    time.sleep(1.1)
    put(("a", 0, 0, 1, None), ("b", 0, 0, 4, 6))
    go()
    assert got() == [("a", 0, 0, 1), ("b", 0, 0, 5), ("b", 0, 1, 5)]
    put(("b", 0, 0, 2, 3), ("c", 4, 0, 8, None), ("a", 0, 0, 6, None))
    go()
    assert got() == [("a", 0, 0, 6), ("b", 0, 0, 5), ("b", 0, 1, 5), ("c", 4, 0, 8)]
    put(("b", 0, 0, 3, 8))
    go()
    assert got() == [("a", 0, 0, 6), ("b", 0, 0, 3), ("c", 4, 0, 8)]


def huber_objective(x, y, slope, intercept):
    """The least value over the scale of n s + s * sum h(error / s) on standardised axes, by a fine search."""
    u, v = (x - x.mean()) / x.std(), (y - y.mean()) / y.std()
    p = slope * x.std() / y.std()
    q = (intercept + slope * x.mean() - y.mean()) / y.std()
    r = np.abs(v - p * u - q)
    best = np.inf
    for s in np.exp(np.linspace(-12, 3, 6000)):
        small = r <= s
        best = min(best, len(r) * s + (r[small] ** 2 / s).sum() + (2 * r[~small] - s).sum())
    return best


def test_robust_line_is_the_least(spark):
    rng = np.random.default_rng(2)
    x = np.arange(40)
    y = 3 * x + 5 + rng.integers(-4, 5, 40)
    y[[3, 20, 33]] += (90, -120, 70)
    points = spark.createDataFrame([("d", 0, int(a), int(b)) for a, b in zip(x, y, strict=True)] + [("d", 1, 5, 1), ("d", 1, 5, 2), ("d", 2, 1, 4), ("d", 2, 9, 4)], "doc_id string, bucket long, x long, y long")
    got = {r.bucket: r for r in store.robust_regression(points).collect()}
    a, b = got[0].slope, got[0].intercept
    assert abs(a - 3) < 0.15 and abs(b - 5) < 3 and got[1].slope is None and (got[2].slope, got[2].intercept) == (0.0, 4.0)
    least = huber_objective(x, y, a, b)
    for da, db in ((0.02, 0), (-0.02, 0), (0, 0.5), (0, -0.5), (0.02, -0.5), (-0.02, 0.5)):
        assert huber_objective(x, y, a + da, b + db) >= least - 1e-6


def test_many_robust_lines_at_once(spark):
    rng = np.random.default_rng(5)
    groups = [(d, b, rng.integers(0, 30, n), rng.integers(0, 90, n)) for d in ("a", "b", None) for b, n in enumerate((1, 2, 3, 9, 25, 25, 40))]
    points = spark.createDataFrame([(d, b, int(x), int(y)) for d, b, xs, ys in groups for x, y in zip(xs, ys, strict=True)], "doc_id string, bucket long, x long, y long")
    fitted = store.robust_regression(points)
    assert "Pandas" not in fitted._jdf.queryExecution().analyzed().toString()  # no call of Python for each bucket
    got = {(r.doc_id, r.bucket): (r.slope, r.intercept) for r in fitted.collect()}
    assert len(got) == len(groups)
    for d, b, xs, ys in groups:
        order = np.lexsort((ys, xs))
        alone = store.huber_lines(xs[order].astype(float), ys[order].astype(float), np.array([0]))
        a, q = got[d, b]
        assert (a is None) == (len(set(xs)) == 1) and (a is None or np.allclose((a, q), np.concatenate(alone), rtol=1e-9, atol=1e-9))


def test_next_boundary_is_found_from_the_end(spark):
    rows = spark.createDataFrame([("d", v) for v in (1, 3, 3, 4, 9, None)] + [("e", 2)], "d string, v long")
    bounds = spark.createDataFrame([("d", 3), ("d", 3), ("d", 7), ("d", None), ("f", 5)], "d string, b long")
    got = books.next_boundary(rows, bounds, ["d"], "v", "b")
    assert sorted((r.v is not None, r.v or 0, r.bucket) for r in got.collect()) == [(False, 0, 3), (True, 1, 3), (True, 3, 3), (True, 3, 3), (True, 4, 7)]
    # a frame up to the last row is made anew for each row
    assert "unboundedfollowing" not in got._jdf.queryExecution().analyzed().toString().lower()


def test_each_text_is_shuffled_once(spark):
    line = spark.createDataFrame([("d", s, i, f"{s}{i}", i // 3) for s in ("from", "to") for i in range(1, 8) if (s, i) != ("to", 4)] + [("d", "to", 9, None, 3), (None, "from", 1, "n", 0)], "doc_id string, side string, line_id long, text string, paragraph long")
    rows = [("d", 0, 0, [1, 2], [2, 1]), ("d", 0, 1, [], [4]), ("d", 0, 2, [3, 99], [9, 5]), ("d", 1, 0, [77], None), ("d", 1, 1, [6, 4, 5], [7, 7]), (None, 0, 0, [1], [1]), ("e", 0, 0, [1], [1])]
    match = spark.createDataFrame(rows, "doc_id string, batch_id long, sub_id long, from_ids array<long>, to_ids array<long>")
    got = books.aligned_items(match, line, "from")
    want = {("d", 0, 0): ("from1 from2", "to2 to1"), ("d", 0, 1): ("", ""), ("d", 0, 2): ("from3", "to5"), ("d", 1, 0): ("", ""), ("d", 1, 1): ("from6 from4 from5", "to7 to7"), (None, 0, 0): ("", ""), ("e", 0, 0): ("", "")}
    assert {(r.doc_id, r.batch_id, r.sub_id): (r.text_from, r.text_to) for r in got.collect()} == want
    assert sorted((r.doc_id or "", r.pos, r.from_ids, r.to_ids) for r in got.collect() if r.doc_id == "d") == [("d", i, f, t) for i, (*_, f, t) in enumerate(rows[:5], 1)]
    # the ends that are carried along are those that a join with the lines finds
    pars = lambda items: sorted((r.pos, r.par, r.p0, r.p1) for r in books.paragraph_rows(items, line).collect())
    assert pars(got) == pars(got.drop("ends")) == [(1, 1, 0, 0), (3, 2, 1, 1), (5, 2, 1, 2)]
    plan = books.paragraphs(got, line)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_inserts_sort_no_lines(spark):
    got = store.insert_lines(lines(spark).withColumn("embedding", F.array(F.lit(1.0).cast("float"))).withColumn("proxy_text", F.lit("p")), "from", spark.createDataFrame([("d", 2), ("d", 2)], "doc_id string, line_id long"))
    assert [(r.line_id, r.text, r.proxy_text, r.embedding) for r in got.where("side = 'from'").orderBy("line_id").collect()] == [(1, "from1", "p", [1.0]), (2, "from2", "p", [1.0]), (3, "", "", None), (4, "", "", None), (5, "from3", "p", [1.0])]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Union" not in plan.split("Join")[0]


def test_rows_within_intervals(spark):
    rnd = random.Random(3)
    rows = [(d, i, f"t{i}") for d in "ab" for i in range(30)] + [("c", 1, "x"), ("a", None, "n")]
    spans = [(rnd.choice("ab"), a, a + rnd.randint(-2, 5)) for a in rnd.choices(range(30), k=12)] + [("a", 5, 5), ("a", 5, None)]
    got = within(spark.createDataFrame(rows, "d string, i long, t string"), spark.createDataFrame(spans, "d string, lo long, hi long"), ["d"], "i", "lo", "hi").collect()
    want = [r for r in rows if any(s[0] == r[0] and None not in (r[1], s[2]) and s[1] <= r[1] <= s[2] for s in spans)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_consumed_tables_go(spark):
    from tandemtext.functions.durable import consumed, exists, written_at

    with consumed(spark) as keep:
        inner, path = written_at(spark.range(5))
        kept = keep(inner.where("id > 2"))
        assert exists(spark, path)
    assert not exists(spark, path) and kept.count() == 2
    with pytest.raises(ValueError), consumed(spark):
        _, path = written_at(spark.range(5))
        raise ValueError
    assert not exists(spark, path)


def test_text_files(spark, tmp_path):
    (tmp_path / "book.txt").write_text("one\r\ntwo\n\nlast\n")
    got = readers.text_lines(spark, str(tmp_path)).orderBy("line_id").collect()
    assert [(r.doc_id, r.line_id, r.text) for r in got] == [("book", 1, "one"), ("book", 2, "two"), ("book", 3, ""), ("book", 4, "last")]


def test_database_files(spark, tmp_path):
    path = str(tmp_path / "pair.db")
    with sqlite3.connect(path) as db:
        for s in ("from", "to"):
            db.execute(f"create table splitted_{s}(id integer, text text, proxy_text text, paragraph integer, h1 integer)")
            db.execute(f"insert into splitted_{s} values (1, '{s} line', null, 4, 2)")
        db.execute("create table meta(key text, val text, occurence integer, par_id integer, deleted integer, comment text)")
        db.execute("insert into meta values ('h1_to', 'Head', 0, 1, 0, '')")
        db.execute("create table doc_index(id integer, contents text)")
        db.execute("""insert into doc_index values (1, '[[[1, "[1]", 1, "[1, 2]"]], [[2, "[2]", 2, "[3]"]]]')""")
    assert sorted(tuple(r)[:5] for r in readers.database_table(spark, [path], "line").collect()) == [("pair", "from", 1, "from line", None), ("pair", "to", 1, "to line", None)]
    assert tuple(readers.database_table(spark, [path], "meta").first())[:4] == ("pair", "to", "h1", "Head")
    assert sorted((r.batch_id, r.sub_id, r.from_ids, r.to_ids) for r in readers.database_table(spark, [path], "index").collect()) == [(0, 0, [1], [1, 2]), (1, 0, [2], [3])]


def test_vectors_as_blobs(spark):
    v = [0.25, -1.5, 0.3, 1e-3]
    df = spark.createDataFrame([(v,), (None,)], "v array<float>").select("v", readers.blob_vectors(readers.to_blob(F.col("v"))).alias("w"), readers.legacy_vectors(F.to_json("v")).alias("j"))
    rows = df.collect()
    assert np.allclose(rows[0].v, rows[0].w, atol=1e-7) and np.allclose(rows[0].v, rows[0].j, atol=1e-7) and rows[1].w is None


def test_exports(spark):
    items = spark.createDataFrame([("d", 0, 0, 1, "a & b", "<c>"), ("d", 0, 1, 2, "e", "f")], "doc_id string, batch_id long, sub_id long, pos long, text_from string, text_to string")
    tmx = exports.tmx_documents(items, "en", "de").first().value
    assert "a &amp; b" in tmx and "&lt;c&gt;" in tmx and tmx.count("<tu>") == 2 and tmx.rstrip().endswith("</tmx>")
    import xml.etree.ElementTree as ET

    assert len(ET.fromstring(tmx.split("\n", 1)[1]).findall(".//tuv")) == 4
    pars = spark.createDataFrame([("d", 1, ["a", "b"], ["x", "y"]), ("d", 2, ["c"], ["z"])], "doc_id string, par long, texts_from array<string>, texts_to array<string>")
    xml = ET.fromstring(exports.xml_books(pars, F.lit("T & U")).first().value)
    assert [s.get("id") for s in xml.iter("sentence")] == ["1", "2", "3"]
    book = spark.createDataFrame([("d", 1, "heading", "h1", 0, "H", "K"), ("d", 2, "paragraph", None, 0, "p", "q")], "doc_id string, item long, kind string, mark string, par_id long, value_from string, value_to string")
    import json

    head = spark.createDataFrame([("d", "Title")], "doc_id string, title string")
    got = json.loads(exports.json_books(book, head).first().value)
    assert got == {"head": {"title": "Title"}, "body": [{"t": "h", "c": "h1", "p": ["H", "K"]}, {"t": "p", "p": ["p", "q"]}]}
    page = exports.html_books(book, "de", [{"color": "red"}]).first().value
    assert "Inhalt" in page and page.count("<tr>") == 2 and "width: 50%" in page and "color: red" in page
    assert exports.html_books(book, "en", amount=1).first().value.count("<tr>") == 1
    blocks = spark.createDataFrame([("d", 1, "a", "x"), ("d", 1, "b", "y"), ("d", 2, "a", "z")], "doc_id string, end long, lang string, text string")
    assert exports.polybook_html(blocks, ["a", "b"]).first().value.count("<td") == 4


def test_embedding_and_service(spark):
    df = spark.createDataFrame([("d", "from", 1, "hello world"), ("d", "from", 2, None)], "doc_id string, side string, line_id long, text string")
    got = {r.line_id: r.embedding for r in embed.embed(df, embed.hashing_encoder(16)).collect()}
    assert np.linalg.norm(got[1]) == pytest.approx(1, abs=1e-6) and got[2] is None
    embed.register("test", embed.hashing_encoder(16))
    have = spark.createDataFrame([("d", "from", 1, False, "m", [1.0])], "doc_id string, side string, line_id long, is_proxy boolean, model string, embedding array<float>")
    assert embed.fill_vectors(df.withColumn("text", F.coalesce("text", F.lit("x"))), have, embed.hashing_encoder(16), "m").count() == 2

    def send(body):
        if body["input"] == "bad":
            raise ValueError("no")
        return {"data": [{"embedding": [float(len(body["input"])), 0.0]}]}

    rows = spark.createDataFrame([(1, "abc"), (2, "bad")], "line_id long, text string")
    out = embed.call_service(embed.requests_for(rows, "m"), send, "embeddings", str.split, attempts=2, sleep=lambda s: None)
    assert {r.row_id: r.embedding for r in embed.service_vectors(out).collect()} == {1: [3.0, 0.0], 2: None}
    assert {(r.error, r.attempts) for r in out.collect()} == {(None, 1), ("no", 2)}
    url = spark.createDataFrame([("https://a.example/v1/embeddings",), ("https://x.example/openai/deployments/d/chat/completions?v=1",), ("nothing",)], "u string")
    assert [r[0] for r in url.select(embed.endpoint(F.col("u"))).collect()] == ["embeddings", "chat/completions", None]


def test_limiter_and_token_counts():
    now = [0.0]
    limiter = embed.Limiter(60, 600, lambda: now[0])
    assert [limiter.wait(10) for _ in range(60)] == [0.0] * 60
    assert limiter.wait(10) == pytest.approx(1.0)
    now[0] = 1.0
    assert limiter.wait(10) == 0.0
    assert embed.count_tokens({"input": ["a b", "c"]}, "embeddings", str.split) == 3
    assert embed.count_tokens({"prompt": "a b", "max_tokens": 5}, "completions", str.split) == 7
    assert embed.count_tokens({"messages": [{"role": "user", "content": "a b"}], "max_tokens": 5}, "chat/completions", str.split) == 4 + 3 + 2 + 5


def test_texts_to_alignment(spark):
    texts = [("d", f"{n.capitalize()} is sentence {n} of the tale. " + ("It goes on here for long. " if i % 4 == 0 else "")) for i, n in enumerate("one two three four five six seven eight nine ten".split())]
    raw = spark.createDataFrame([(d, "x", i + 1, t) for i, (d, t) in enumerate(texts)], "doc_id string, side string, line_id long, text string")
    got = alignment.align_texts(raw.withColumn("side", F.lit("from")), raw.withColumn("side", F.lit("to")), "en", "en", embed.hashing_encoder(256), 6, 3, rounds=1, fix_lengths=True)
    items = got["items"].orderBy("pos").collect()
    assert [i for r in items for i in r.from_ids] == sorted(i for r in items for i in r.from_ids) and len(items) >= 8
    assert sum(r.text_from == r.text_to for r in items) >= 0.8 * len(items)


def test_second_run_encodes_nothing(spark):
    def never(texts):
        raise AssertionError(f"encoded again: {texts}")

    words = "one two three four five six seven eight nine ten eleven twelve".split()
    rows = [("d", s, i + 1, f"{n} {n}") for s in ("from", "to") for i, n in enumerate(words)]
    both = spark.createDataFrame(rows, "doc_id string, side string, line_id long, text string")
    encoder = embed.hashing_encoder(128)
    match, vectors = alignment.realigned(None, both, None, encoder, "h", size=4, window=2)
    assert vectors.count() == 24 and match.count() == 12
    again, same = alignment.realigned(None, both, vectors, lambda: never, "h", size=4, window=2)
    assert same.count() == 24 and sorted(map(str, again.collect())) == sorted(map(str, match.collect()))
    # another model's vectors are kept and don't count
    with pytest.raises(Exception, match="encoded again"):
        alignment.realigned(None, both, vectors, lambda: never, "other", size=4, window=2)
    # proxies of one side: only these are encoded; one batch is aligned anew, the others stay
    proxy = both.where("side = 'from'").withColumn("text", F.concat(F.lit("x "), "text"))
    mixed = line_tables.with_proxy(both, proxy)
    part, more = alignment.realigned(match, mixed, vectors, encoder, "h", ("from",), 4, 2, batch_ids=[1])
    assert more.count() == 36 and more.where("is_proxy").count() == 12
    key = lambda df, b: sorted(str(r) for r in df.where(F.col("batch_id") == b).select("sub_id", "from_ids", "to_ids", "sim").collect())
    assert [key(part, b) == key(match, b) for b in (0, 1, 2)] == [True, False, True] and part.count() == 12


def test_encoders_of_objects(spark):
    class Model:
        def encode(self, texts, scale=1.0):
            return [[scale * len(t), 1.0] for t in texts]

    df = spark.createDataFrame([(1, "abc"), (2, None)], "line_id long, text string")
    got = {r.line_id: r.embedding for r in embed.embed(df, embed.model_encoder(Model, scale=2.0), normalize=False).collect()}
    assert got == {1: [6.0, 1.0], 2: None}
    assert {"labse", "sonar", "rubert_tiny"} <= set(embed.REGISTRY)


@pytest.mark.parametrize("n", [0, 1, 40])
def test_components(spark, n):
    rng = np.random.default_rng(n)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 50, (n, 2))] + ([(100 + i, 101 + i) for i in range(30)] if n > 1 else [])
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: r for x, r in root.items() if any(x in e and e[0] != e[1] for e in edges)}


def test_running_total(spark):
    rows = [(g, i, i % 7) for g in ("a", "b", None, "c") for i in range(50)]
    got = running_total(spark.createDataFrame(rows, "g string, i long, v long"), ["g", "i"], "v", "t", by=["g"]).collect()
    want, t = {}, {}
    for g, i, v in rows:
        t[g] = t.get(g, 0) + v
        want[g, i] = t[g]
    assert {(r.g, r.i): r.t for r in got} == want
    assert running_total(spark.createDataFrame([], "i long, v long"), ["i"], "v", "t").count() == 0


def test_whole_keys():
    import pyarrow as pa

    keys = [1, 1, 2, 3, 3, 3, 3, 4, 9]
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + 2], pa.int64())], names=["k"]) for i in range(0, 9, 2)]
    seen = [b.column(0).to_pylist() for b in whole_keys(iter(batches))]
    assert sum(seen, []) == keys and len({k for b in seen for k in set(b)}) == sum(len(set(b)) for b in seen)
