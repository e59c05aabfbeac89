"""Queries over match tables: chains, conflicts, corrections, books, exports and edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tandemtext.functions.durable import written
from tandemtext.operators import books, chains, correct, embed, resolve, store
from tandemtext.plans import inputs as I
from tandemtext.sources import exports


def _csv(c: str) -> Column:
    return F.concat_ws(",", F.col(c).cast("array<string>")).alias(c)


def _ends(df: DataFrame, *keep: str) -> DataFrame:
    cols = [F.col(f"{e}.{f}").alias(f"{e}_{f}") for e in ("start", "end") for f in ("from_id", "to_id", "batch_id", "sub_id")]
    return df.select(*keep, *cols)


# chains and conflicts

_POINTS = f"""{I.MATCH}, mp AS (SELECT doc_id, batch_id, sub_id, from_ids, generate_subscripts(to_ids, 1) AS part, unnest(to_ids) AS line FROM ma),
is1 AS (SELECT *, row_number() OVER w AS place, CASE WHEN lag(line) OVER w + 1 = line THEN 0 ELSE 1 END AS nw FROM mp WINDOW w AS (PARTITION BY doc_id ORDER BY batch_id, sub_id, part)),
is2 AS (SELECT *, sum(nw) OVER (PARTITION BY doc_id ORDER BY place) AS island FROM is1),
ch AS (SELECT doc_id, island, count(*) AS n, arg_min((from_ids[1], line, batch_id, sub_id), place) AS a, arg_max((from_ids[1], line, batch_id, sub_id), place) AS b FROM is2 GROUP BY ALL)"""


def _chains_sql(n: int) -> str:
    return f"{_POINTS}, gc AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY island) AS chain, n, a, b FROM ch WHERE n >= {n})"


_COLS = ", ".join(f"{e}[{i}]::BIGINT AS {name}_{f}" for e, name in (("a", "start"), ("b", "end")) for i, f in enumerate(("from_id", "to_id", "batch_id", "sub_id"), 1))
_CONF = f"""{_chains_sql(2)}, c1 AS (SELECT doc_id, chain AS conflict, b AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY chain) AS b FROM gc),
co AS (SELECT *, b[1] - a[1] AS len_from, b[2] - a[2] AS len_to FROM c1 WHERE b IS NOT NULL)"""


def good_chains(spark: SparkSession, d: str) -> DataFrame:
    return _ends(chains.good_chains(I.match_rows(spark, d), 3), "doc_id", "chain", "n")


def chains_with_ends(spark: SparkSession, d: str) -> DataFrame:
    m = I.match_rows(spark, d)
    n = m.groupBy("doc_id").agg(F.count(F.lit(1)).alias("len_from"), F.count(F.lit(1)).alias("len_to"))
    return _ends(chains.good_chains(m, 2, True, True, n), "doc_id", "chain", "n")


_WITH_ENDS = f"""WITH {I.MATCH}, mp0 AS (SELECT doc_id, batch_id, sub_id, from_ids, generate_subscripts(to_ids, 1) AS part, unnest(to_ids) AS line FROM ma),
mp1 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY batch_id, sub_id, part) = 1 AND line <> 1 AS late FROM mp0),
is1 AS (SELECT *, row_number() OVER w AS place, CASE WHEN lag(line) OVER w + 1 = line THEN 0 ELSE 1 END AS nw FROM mp1 WHERE NOT late WINDOW w AS (PARTITION BY doc_id ORDER BY batch_id, sub_id, part)),
is2 AS (SELECT *, sum(nw) OVER (PARTITION BY doc_id ORDER BY place) AS island FROM is1),
ch AS (SELECT doc_id, island, count(*) AS n, arg_min((from_ids[1], line, batch_id, sub_id), place) AS a, arg_max((from_ids[1], line, batch_id, sub_id), place) AS b FROM is2 GROUP BY ALL),
ct AS (SELECT doc_id, count(*) AS l FROM ma GROUP BY doc_id),
al AS (SELECT doc_id, island, n, a, b FROM ch WHERE n >= 2
  UNION ALL SELECT doc_id, 0, 1, (from_ids[1], 1, batch_id, sub_id), (from_ids[1], 1, batch_id, sub_id) FROM mp1 WHERE late
  UNION ALL SELECT doc_id, island, 1, (l, l, b[3], b[4]), (l, l, b[3], b[4]) FROM ch JOIN ct USING (doc_id) WHERE n < 2 AND island = (SELECT max(island) FROM ch c2 WHERE c2.doc_id = ch.doc_id))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY island) AS chain, n, {_COLS} FROM al"""


def conflicts_to_solve(spark: SparkSession, d: str) -> DataFrame:
    return _ends(resolve.all_conflicts(I.match_rows(spark, d), 2, 4)[0], "doc_id", "conflict", "len_from", "len_to")


def conflicts_rest(spark: SparkSession, d: str) -> DataFrame:
    return _ends(resolve.all_conflicts(I.match_rows(spark, d), 2, 4)[1], "doc_id", "conflict", "len_from", "len_to")


def conflict_stats(spark: SparkSession, d: str) -> DataFrame:
    return chains.conflict_statistics(chains.conflicts(chains.good_chains(I.match_rows(spark, d), 2)))


def conflict_lines(spark: SparkSession, d: str) -> DataFrame:
    found, _ = resolve.all_conflicts(I.match_rows(spark, d), 2, 4)
    return resolve.conflict_lines(found, I.both_lines(spark, d)).select("doc_id", "conflict", "side", "line_id", "text")


def _score(mode: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return chains.chain_score(I.match_rows(spark, d), mode).select("doc_id", F.round("score", 6).alias("score"))

    return run


_BREAKS = f"""{I.MATCH}, pt AS (SELECT doc_id, 'to' AS side, batch_id, sub_id, generate_subscripts(to_ids, 1) AS part, unnest(to_ids) AS line FROM ma
  UNION ALL SELECT doc_id, 'from', batch_id, sub_id, generate_subscripts(from_ids, 1), unnest(from_ids) FROM ma),
p2 AS (SELECT *, lag(line) OVER (PARTITION BY doc_id, side ORDER BY batch_id, sub_id, part) AS pv, min(line) OVER (PARTITION BY doc_id, side) AS mn FROM pt),
br AS (SELECT doc_id, side, sum(CASE WHEN pv IS NULL THEN line <> mn ELSE line <> pv + 1 END::INT) AS br, count(*) AS n FROM p2 GROUP BY ALL)"""


def corrected_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """To-ids raised where that leaves fewer unsolvable conflicts."""
    got = resolve.correct_conflicts(I.match_rows(spark, d), 2, 26)
    return got.select("doc_id", "batch_id", "sub_id", _csv("from_ids"), _csv("to_ids"))


def spliced(spark: SparkSession, d: str) -> DataFrame:
    """Conflicts of the match table replaced by one row that pairs all their lines."""
    m = I.match_rows(spark, d)
    found, _ = resolve.all_conflicts(m, 2, 4)
    ids = lambda s: F.sequence(F.col(f"start.{s}_id"), F.col(f"end.{s}_id")).alias(f"{s}_ids")
    solved = found.select("doc_id", "conflict", F.lit(1).cast("long").alias("pair"), ids("from"), ids("to"), F.lit(1.0).alias("sim"))
    return resolve.splice(m, found, solved).select("doc_id", "batch_id", "sub_id", _csv("from_ids"), _csv("to_ids"))


# corrections

_RATIO = """ra AS (SELECT *, length(text_from) AS len_from, length(text_to) AS len_to, least(length(text_from), length(text_to))::DOUBLE / greatest(length(text_from), length(text_to), 1) AS char_ratio,
  least(wf, wt)::DOUBLE / greatest(wf, wt, 1) AS word_ratio FROM (SELECT *, len(regexp_extract_all(text_from, '[^ \\t\\n\\f\\r\\v]+')) AS wf, len(regexp_extract_all(text_to, '[^ \\t\\n\\f\\r\\v]+')) AS wt FROM tu))"""
_BOUNDS = f"""{I.TURNS}, {_RATIO}, bo AS (SELECT avg(char_ratio) AS char_mean, avg(char_ratio) - 1.5 * stddev_samp(char_ratio) AS char_low, avg(char_ratio) + 1.5 * stddev_samp(char_ratio) AS char_high,
  avg(word_ratio) AS word_mean, avg(word_ratio) - 1.5 * stddev_samp(word_ratio) AS word_low, avg(word_ratio) + 1.5 * stddev_samp(word_ratio) AS word_high FROM ra),
ol AS (SELECT ra.*, (NOT char_ratio BETWEEN char_low AND char_high OR NOT word_ratio BETWEEN word_low AND word_high) AND len_from > 10 AND len_to > 10 AS is_outlier FROM ra, bo)"""


def _ratios(spark: SparkSession, d: str) -> DataFrame:
    return correct.length_ratios(I.turns(spark, d))


def _outliers(spark: SparkSession, d: str) -> DataFrame:
    r = _ratios(spark, d)
    return correct.outliers(r, correct.outlier_bounds(r))


def length_ratios(spark: SparkSession, d: str) -> DataFrame:
    return _ratios(spark, d).select("doc_id", "pos", "len_from", "len_to", F.round("char_ratio", 6).alias("char_ratio"), F.round("word_ratio", 6).alias("word_ratio"))


def outlier_bounds(spark: SparkSession, d: str) -> DataFrame:
    b = correct.outlier_bounds(_ratios(spark, d))
    return b.select(*[F.round(c, 6).alias(c) for c in b.columns])


def outliers(spark: SparkSession, d: str) -> DataFrame:
    return _outliers(spark, d).select("doc_id", "pos", "is_outlier")


def _book_outliers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Items of the match table, every seventh place by rule an outlier."""
    items = books.aligned_items(I.match_rows(spark, d), I.both_lines(spark, d))
    return items, items.withColumn("is_outlier", (F.col("doc_id") + F.col("pos") * 3) % 7 == 0)


def correction_tasks(spark: SparkSession, d: str) -> DataFrame:
    return correct.correction_tasks(_book_outliers(spark, d)[1])


_TASKS = f"""{I.MATCH}, it AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY batch_id, sub_id) AS pos, count(*) OVER (PARTITION BY doc_id) AS n FROM ma),
o1 AS (SELECT doc_id, pos, n FROM it WHERE (doc_id + pos * 3) % 7 = 0),
o2 AS (SELECT *, sum(CASE WHEN pos - pv > 2 OR pv IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS task FROM (SELECT *, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS pv FROM o1)),
tk AS (SELECT doc_id, task::BIGINT AS task, unnest(range(greatest(min(pos) - 1, 1), least(max(pos) + 1, any_value(n)) + 1)) AS pos FROM o2 GROUP BY doc_id, task)"""


def task_variants(spark: SparkSession, d: str) -> DataFrame:
    items, marked = _book_outliers(spark, d)
    return correct.task_variants(correct.correction_tasks(marked), items).select("doc_id", "task", "variant", "pair", _csv("from_ids"), _csv("to_ids"))


def score_by_length(spark: SparkSession, d: str) -> DataFrame:
    """Scores of what each task holds as it is: its items as the one variant."""
    items, marked = _book_outliers(spark, d)
    tasks = correct.correction_tasks(marked)
    asis = tasks.join(items, ["doc_id", "pos"]).select("doc_id", "task", F.lit(0).cast("long").alias("variant"), F.col("pos").alias("pair"), "from_ids", "to_ids")
    means = spark.range(1).select(F.lit(0.9).alias("char_mean"), F.lit(0.8).alias("word_mean"))
    return correct.score_by_length(asis, I.both_lines(spark, d), means).select("doc_id", "task", F.round("score", 6).alias("score"))


def _corrected(spark: SparkSession, d: str, by: str) -> DataFrame:
    """The match table of the pairs of turns, a line each, after a correction: ratios, bounds, outliers, tasks, regroupings, scores, the best put in."""
    t = I.turns(spark, d)
    side = lambda s: t.select("doc_id", F.lit(s).alias("side"), F.col("pos").alias("line_id"), F.col(f"text_{s}").alias("text"))
    lines = side("from").unionByName(side("to"))
    match = t.select("doc_id", F.lit(0).cast("long").alias("batch_id"), (F.col("pos") - 1).alias("sub_id"), "from_ids", "to_ids")
    items = t.join(match.select("doc_id", "batch_id", "sub_id", (F.col("sub_id") + 1).alias("pos")), ["doc_id", "pos"])
    ratios = correct.length_ratios(items)
    bounds = correct.outlier_bounds(ratios)
    tasks = correct.correction_tasks(correct.outliers(ratios, bounds))
    # the walks and the vectors are made in Python and read by several joins each; unwritten they were made anew for each
    found = written(correct.task_variants(tasks, items), "variants")
    if by == "length":
        best = correct.best_corrections(correct.score_by_length(found, lines, bounds), True)
    else:
        vectors = written(embed.embed(lines, embed.hashing_encoder(64)), "vectors")
        best = correct.best_corrections(correct.score_by_similarity(found, vectors), False)
    return correct.apply_corrections(match, items, tasks, found, best).select("doc_id", "batch_id", "sub_id", _csv("from_ids"), _csv("to_ids"))


def corrected_by_length(spark: SparkSession, d: str) -> DataFrame:
    return _corrected(spark, d, "length")


def corrected_by_similarity(spark: SparkSession, d: str) -> DataFrame:
    return _corrected(spark, d, "similarity")


_TEXTS = """tx AS (SELECT m.doc_id, m.batch_id, m.sub_id, row_number() OVER (PARTITION BY m.doc_id ORDER BY batch_id, sub_id) AS pos, from_ids, to_ids, f.text AS text_from,
  coalesce((SELECT string_agg('[' || l.text || ']', ' ' ORDER BY l.line_id) FROM ln l WHERE l.doc_id = m.doc_id AND list_contains(m.to_ids, l.line_id)), '') AS text_to
  FROM ma m JOIN ln f ON f.doc_id = m.doc_id AND f.line_id = m.from_ids[1])"""

# books


def aligned_items(spark: SparkSession, d: str) -> DataFrame:
    return books.aligned_items(I.match_rows(spark, d), I.both_lines(spark, d)).select("doc_id", "pos", "text_from", "text_to")


def aligned_pair_chains(spark: SparkSession, d: str) -> DataFrame:
    return books.aligned_pair_chains(I.match_rows(spark, d), I.both_lines(spark, d), 3)


def empty_cells(spark: SparkSession, d: str) -> DataFrame:
    m = I.match_rows(spark, d)
    return books.has_empty_cells(m.withColumn("to_ids", F.when(F.col("doc_id") % 5 == F.col("sub_id"), F.array().cast("array<long>")).otherwise(F.col("to_ids"))))


def _paragraphs(spark: SparkSession, d: str, amount: int = 0) -> DataFrame:
    lines = I.both_lines(spark, d)
    return books.paragraphs(books.aligned_items(I.match_rows(spark, d), lines, "from"), lines, "from", amount)


def paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return _paragraphs(spark, d).select("doc_id", "par", "par_id", F.concat_ws("|", "texts_from").alias("texts_from"), F.concat_ws("|", "texts_to").alias("texts_to"), "n_from", "n_to")


def paragraphs_preview(spark: SparkSession, d: str) -> DataFrame:
    return _paragraphs(spark, d, 2).select("doc_id", "par", "n_from", "n_to")


_PARS = f"""{I.MATCH}, {_TEXTS}, pa AS (SELECT doc_id, ((from_ids[1] - 1) // 4)::BIGINT AS par_id, list(text_from ORDER BY pos) AS tf, list(text_to ORDER BY pos) AS tt, sum(len(from_ids))::BIGINT AS n_from, sum(len(to_ids))::BIGINT AS n_to FROM tx GROUP BY ALL)"""


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of three languages over each document's lines: ends by rule."""
    l = I.lines(spark, d).select("doc_id", "line_id")
    n = F.max("line_id").over(_by_doc())
    own = l.withColumn("n", n).withColumn("lang", F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("c"))))
    k = F.when(F.col("lang") == "a", 2).when(F.col("lang") == "b", 3).otherwise(1)
    own = own.where((F.col("line_id") % k == 0) | (F.col("line_id") == F.col("n")))
    from pyspark.sql import Window

    before = F.coalesce(F.lag("line_id").over(Window.partitionBy("doc_id", "lang").orderBy("line_id")), F.lit(0))
    return own.select("doc_id", "lang", F.col("line_id").alias("end"), F.sequence(before + 1, F.col("line_id")).alias("main_ids"), F.array(F.col("line_id") * 10).alias("target_ids"))


def _by_doc():
    from pyspark.sql import Window

    return Window.partitionBy("doc_id")


_BLOCKS = I.LINES + """, bl0 AS (SELECT doc_id, line_id, max(line_id) OVER (PARTITION BY doc_id) AS n, lang, k FROM ln, (VALUES ('a', 2), ('b', 3), ('c', 1)) t(lang, k)),
bl AS (SELECT doc_id, lang, line_id AS "end", coalesce(lag(line_id) OVER (PARTITION BY doc_id, lang ORDER BY line_id), 0) AS pv FROM bl0 WHERE line_id % k = 0 OR line_id = n),
ce AS (SELECT doc_id, "end" FROM bl GROUP BY ALL HAVING count(DISTINCT lang) = 3)"""


def polybook_blocks(spark: SparkSession, d: str) -> DataFrame:
    return books.polybook_blocks(_blocks(spark, d), ["doc_id"]).select("doc_id", "end", "lang", _csv("main_ids"), _csv("target_ids"))


def common_boundaries(spark: SparkSession, d: str) -> DataFrame:
    return books.common_ends(_blocks(spark, d), ["doc_id"])


def next_boundary(spark: SparkSession, d: str) -> DataFrame:
    l = I.lines(spark, d).select("doc_id", "line_id")
    return books.next_boundary(l, l.where("line_id % 5 = 0"), ["doc_id"], "line_id", "line_id", "boundary")


def _book_items(spark: SparkSession, d: str) -> DataFrame:
    from tandemtext.operators import lines as L

    raw = I.marked_lines(spark, d)
    meta = L.meta_lines(raw)
    meta = meta.unionByName(meta.withColumns({"side": F.lit("to"), "val": F.concat(F.lit("["), "val", F.lit("]"))}))
    own = L.handle_marks(raw)
    pars = own.groupBy("doc_id", F.col("paragraph").alias("par_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("line_id", "text"))), lambda x: x["text"]).alias("texts_from"))
    from pyspark.sql import Window

    pars = pars.withColumns({"texts_to": F.array(F.concat(F.lit("["), F.concat_ws(" ", "texts_from"), F.lit("]"))), "par": F.row_number().over(Window.partitionBy("doc_id").orderBy("par_id")).cast("long")})
    return books.book_items(pars, meta)


def book_items(spark: SparkSession, d: str) -> DataFrame:
    return _book_items(spark, d)


def book_sections(spark: SparkSession, d: str) -> DataFrame:
    return books.sections(_book_items(spark, d)).groupBy("doc_id", "section").agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("kind") == "paragraph").alias("paragraphs"))


def xml_sections(spark: SparkSession, d: str) -> DataFrame:
    return exports.xml_sections(books.sections(_book_items(spark, d)))


def _items_sql() -> str:
    from tandemtext.plans import queries_text as Q

    return f"""{Q._FLAGS}, m0 AS (SELECT doc_id, mark, CASE WHEN mark = 'divider' THEN '* * *' ELSE regexp_replace(s, '{Q._META}', '') END AS val, paragraph AS par_id, line_id FROM fl WHERE mark IS NOT NULL),
m1 AS (SELECT doc_id, mark, val, par_id, row_number() OVER (PARTITION BY doc_id, mark ORDER BY line_id) - 1 AS occ FROM m0 WHERE val <> ''),
p1 AS (SELECT doc_id, paragraph AS par_id, string_agg(s, ' ' ORDER BY line_id) AS t FROM fl WHERE mark IS NULL GROUP BY ALL),
i0 AS (SELECT doc_id, 'heading' AS kind, mark, par_id, list_position(['h1','h2','h3','h4','h5','divider','qtext','qname','image'], mark) AS rank, occ, val AS value_from, '[' || val || ']' AS value_to, par_id - 0.5 AS ord FROM m1 WHERE mark NOT IN ('title', 'author', 'translator')
  UNION ALL SELECT doc_id, 'paragraph', NULL, par_id, 99, 0, t, '[' || t || ']', par_id FROM p1),
bi AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord, rank, occ)::BIGINT AS item, kind, mark, par_id, value_from, value_to FROM i0)"""


_ESC = lambda e: f"replace(replace(replace(replace({e}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
_JSON = """'{"t":"' || CASE kind WHEN 'heading' THEN 'h' ELSE 'p' END || '"' || coalesce(',"c":"' || mark || '"', '') || ',"p":[' || to_json(value_from)::VARCHAR || ',' || to_json(value_to)::VARCHAR || ']}'"""
_SECT = "se AS (SELECT *, sum(coalesce(mark IN ('h1','h2','h3','h4','h5'), false)::INT) OVER (PARTITION BY doc_id ORDER BY item)::BIGINT AS section FROM bi)"


# exports


def _items(spark: SparkSession, d: str) -> DataFrame:
    return books.aligned_items(I.match_rows(spark, d), I.both_lines(spark, d))


def tmx_rows(spark: SparkSession, d: str) -> DataFrame:
    return exports.tmx_units(_items(spark, d), "en", "de")


def plain_text(spark: SparkSession, d: str) -> DataFrame:
    return exports.plain_text(_items(spark, d), "to")


def paragraph_text(spark: SparkSession, d: str) -> DataFrame:
    return exports.paragraph_text(_paragraphs(spark, d), "to")


def json_body(spark: SparkSession, d: str) -> DataFrame:
    return exports.json_items(_book_items(spark, d))


def json_books(spark: SparkSession, d: str) -> DataFrame:
    items = _book_items(spark, d)
    return exports.json_books(items, items.select("doc_id", F.concat(F.lit("Book "), F.col("doc_id").cast("string")).alias("title")).distinct())


def tmx_documents(spark: SparkSession, d: str) -> DataFrame:
    return exports.tmx_documents(_items(spark, d), "en", "de")


def xml_books(spark: SparkSession, d: str) -> DataFrame:
    return exports.xml_books(_paragraphs(spark, d), F.concat(F.lit("A & B "), F.col("doc_id").cast("string")))


def html_rows(spark: SparkSession, d: str) -> DataFrame:
    return exports.html_rows(_book_items(spark, d), 3)


def xml_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return exports.xml_paragraphs(_paragraphs(spark, d))


# edits


def shift_ids(spark: SparkSession, d: str) -> DataFrame:
    m = I.match_rows(spark, d)
    after = m.select("doc_id").distinct().select("doc_id", (F.col("doc_id") % 9 + 1).alias("line_id"))
    return store.shift_ids(m, "to", after).select("doc_id", "batch_id", "sub_id", _csv("from_ids"), _csv("to_ids"))


def insert_lines(spark: SparkSession, d: str) -> DataFrame:
    """Two empty lines put in after one line of each document, and one after the third line below it."""
    l = I.both_lines(spark, d)
    after = l.select("doc_id").distinct().select("doc_id", F.explode(F.array(*[F.col("doc_id") % 9 + k for k in (1, 1, 4)])).alias("line_id"))
    return store.insert_lines(l, "from", after).where("side = 'from'").select("doc_id", "line_id", "text", "paragraph")


def set_text(spark: SparkSession, d: str) -> DataFrame:
    """New texts for every third from-line; null ones change nothing."""
    l = I.both_lines(spark, d)
    new = l.where("line_id % 3 = 0 and side = 'from'").select("doc_id", "side", "line_id", F.when(F.col("line_id") % 6 != 0, F.concat(F.lit("new "), "text")).alias("value"))
    return store.set_text(l, new).select("doc_id", "side", "line_id", "text")


def paragraph_range(spark: SparkSession, d: str) -> DataFrame:
    from tandemtext.operators import lines as L

    return L.paragraph_range(I.both_lines(spark, d), 1, 4)


def proxy_texts(spark: SparkSession, d: str) -> DataFrame:
    """Proxy texts of all documents; those of every third lack the first line, so these documents get none."""
    from tandemtext.operators import lines as L

    l = I.lines(spark, d)
    proxy = l.where("not (doc_id % 3 = 0 and line_id = 1)").withColumn("text", F.concat(F.lit("p "), "text"))
    return L.with_proxy(l, proxy).select("doc_id", "line_id", "text", "proxy_text")


def _meta(spark: SparkSession, d: str) -> DataFrame:
    from tandemtext.operators import lines as L

    return L.meta_lines(I.marked_lines(spark, d)).withColumn("deleted", F.lit(False))


def meta_insert(spark: SparkSession, d: str) -> DataFrame:
    m = _meta(spark, d)
    new = m.select("doc_id", "side").distinct().select("doc_id", "side", F.lit("h1").alias("mark"), F.lit("new").alias("val"), F.lit(1).alias("par_id"))
    return store.add_meta(m, new).select("doc_id", "mark", "val", "occurrence", "par_id")


def meta_edit(spark: SparkSession, d: str) -> DataFrame:
    """The first heading of three marks gets another value and moves down by two paragraphs."""
    m = _meta(spark, d)
    new = m.where("occurrence = 0 and mark in ('h1', 'h2', 'title')").withColumns({"val": F.lit("edited"), "par_id": F.col("par_id") + 2})
    return store.edit_meta(m, new.select("doc_id", "side", "mark", "occurrence", "val", "par_id")).select("doc_id", "mark", "val", "occurrence", "par_id")


def meta_soft_delete(spark: SparkSession, d: str) -> DataFrame:
    m = _meta(spark, d)
    return store.delete_meta(m, m.where("occurrence = 0 and mark in ('h1', 'h2')")).groupBy("mark").agg(F.count_if("deleted").alias("gone"), F.count(F.lit(1)).alias("n"))


def page_join(spark: SparkSession, d: str) -> DataFrame:
    items = _items(spark, d)
    wanted = items.select("doc_id", (-F.col("pos")).alias("rank"), "pos")  # every item, the last one first
    return store.page(items, wanted).select("doc_id", "rank", "text_from", "text_to")


def replaced_batches(spark: SparkSession, d: str) -> DataFrame:
    m = I.match_rows(spark, d)
    new = m.where("batch_id = 1 and sub_id < 5").withColumn("to_ids", F.array(F.lit(1).cast("long")))
    return store.replace_batches(m, new).groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.aggregate("to_ids", F.lit(0).cast("long"), lambda s, x: s + x)).alias("total"))


def alignment_points(spark: SparkSession, d: str) -> DataFrame:
    return store.alignment_points(I.match_rows(spark, d), 10)


def ols_fit(spark: SparkSession, d: str) -> DataFrame:
    r = store.regression(store.alignment_points(I.match_rows(spark, d), 10))
    return r.select("doc_id", "bucket", *[(F.round(c, 5) + 0.0).alias(c) for c in ("slope", "intercept", "mse")])


def robust_fit(spark: SparkSession, d: str) -> DataFrame:
    return store.robust_regression(store.alignment_points(I.match_rows(spark, d), 25))


QUERIES = {
    "good_chains": good_chains, "chains_with_ends": chains_with_ends, "conflicts_to_solve": conflicts_to_solve, "conflicts_rest": conflicts_rest, "conflict_stats": conflict_stats, "conflict_lines": conflict_lines,
    "chain_score_to": _score("to"), "chain_score_both": _score("both"), "corrected_conflicts": corrected_conflicts, "spliced": spliced, "length_ratios": length_ratios, "outlier_bounds": outlier_bounds, "outliers": outliers,
    "correction_tasks": correction_tasks, "task_variants": task_variants, "score_by_length": score_by_length, "corrected_by_length": corrected_by_length, "corrected_by_similarity": corrected_by_similarity, "aligned_items": aligned_items, "aligned_pair_chains": aligned_pair_chains, "empty_cells": empty_cells,
    "paragraphs": paragraphs, "paragraphs_preview": paragraphs_preview, "polybook_blocks": polybook_blocks, "common_boundaries": common_boundaries, "next_boundary": next_boundary, "book_items": book_items, "book_sections": book_sections, "xml_sections": xml_sections,
    "tmx_rows": tmx_rows, "plain_text": plain_text, "paragraph_text": paragraph_text, "json_body": json_body, "json_books": json_books, "tmx_documents": tmx_documents, "xml_books": xml_books, "html_rows": html_rows, "xml_paragraphs": xml_paragraphs, "shift_ids": shift_ids, "insert_lines": insert_lines, "set_text": set_text, "paragraph_range": paragraph_range, "proxy_texts": proxy_texts,
    "meta_insert": meta_insert, "meta_edit": meta_edit, "meta_soft_delete": meta_soft_delete, "page_join": page_join, "replaced_batches": replaced_batches, "alignment_points": alignment_points, "ols_fit": ols_fit, "robust_fit": robust_fit,
}

_FIT = "len_from BETWEEN 0 AND 3 AND len_to BETWEEN 0 AND 3"
_MATCH_CSV = "doc_id, batch_id, sub_id, array_to_string(from_ids, ',') AS from_ids, array_to_string(to_ids, ',') AS to_ids"
_TAG = "coalesce(mark, 'p')"
_TU = f"""'<tu><tuv xml:lang="en-US"><seg>' || {_ESC('text_from')} || '</seg></tuv><tuv xml:lang="de-DE"><seg>' || {_ESC('text_to')} || '</seg></tuv></tu>'"""
_XML = f"""xs AS (SELECT doc_id, par_id, coalesce(sum(len(tf)) OVER (PARTITION BY doc_id ORDER BY par_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bf, generate_subscripts(tf, 1) AS i, unnest(tf) AS f, unnest(tt) AS t FROM pa),
xp AS (SELECT doc_id, par_id, '<p id="' || (par_id + 1) || '">' || string_agg('<sentence id="' || (bf + i)::BIGINT || '"><su lang="from">' || {_ESC('f')} || '</su><su lang="to">' || {_ESC('t')} || '</su></sentence>', '' ORDER BY i) || '</p>' AS value FROM xs GROUP BY doc_id, par_id)"""
_SPLICED = f"""{_CONF}, fit AS (SELECT doc_id, conflict, a, b FROM co WHERE len_from BETWEEN 0 AND 3 AND len_to BETWEEN 0 AND 3),
kp AS (SELECT doc_id, batch_id, sub_id, 0 AS pair, from_ids, to_ids FROM ma WHERE NOT EXISTS (SELECT 1 FROM fit WHERE fit.doc_id = ma.doc_id AND (ma.batch_id, ma.sub_id) >= (fit.a[3], fit.a[4]) AND (ma.batch_id, ma.sub_id) <= (fit.b[3], fit.b[4]))
  UNION ALL SELECT doc_id, a[3], a[4], 1, range(a[1], b[1] + 1), range(a[2], b[2] + 1) FROM fit),
ls AS (SELECT *, max(list_max(from_ids)) OVER (PARTITION BY doc_id ORDER BY batch_id, sub_id, pair ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM kp),
sp AS (SELECT doc_id, batch_id, sub_id, pair, CASE WHEN pair > 0 THEN list_filter(from_ids, lambda x: top IS NULL OR x > top) ELSE from_ids END AS from_ids, to_ids FROM ls)"""
ORACLES = {
    "good_chains": f"WITH {_chains_sql(3)} SELECT doc_id, chain, n, {_COLS} FROM gc", "chains_with_ends": _WITH_ENDS,
    "conflicts_to_solve": f"WITH {_CONF} SELECT doc_id, conflict, len_from, len_to, {_COLS} FROM co WHERE {_FIT}", "conflicts_rest": f"WITH {_CONF} SELECT doc_id, conflict, len_from, len_to, {_COLS} FROM co WHERE NOT ({_FIT})",
    "conflict_stats": f"WITH {_CONF} SELECT (len_from + 1) || ':' || (len_to + 1) AS kind, count(*) AS n FROM co GROUP BY ALL",
    "conflict_lines": f"WITH {_CONF}, k AS (SELECT doc_id, conflict, 'from' AS side, unnest(range(a[1], b[1] + 1)) AS line_id FROM co WHERE {_FIT} UNION ALL SELECT doc_id, conflict, 'to', unnest(range(a[2], b[2] + 1)) FROM co WHERE {_FIT}) SELECT doc_id, conflict, side, line_id, CASE WHEN side = 'to' THEN '[' || text || ']' ELSE text END AS text FROM k JOIN ln USING (doc_id, line_id)",
    "chain_score_to": f"WITH {_BREAKS} SELECT doc_id, round(1 - br / n, 6) AS score FROM br WHERE side = 'to'", "chain_score_both": f"WITH {_BREAKS} SELECT doc_id, round(1 - sum(br) / sum(n), 6) AS score FROM br GROUP BY doc_id",
    "length_ratios": f"WITH {I.TURNS}, {_RATIO} SELECT doc_id, pos, len_from, len_to, round(char_ratio, 6) AS char_ratio, round(word_ratio, 6) AS word_ratio FROM ra",
    "outlier_bounds": f"WITH {_BOUNDS} SELECT {', '.join(f'round({c}, 6) AS {c}' for c in ('char_mean', 'char_low', 'char_high', 'word_mean', 'word_low', 'word_high'))} FROM bo",
    "spliced": f"WITH {_SPLICED} SELECT doc_id, batch_id, row_number() OVER (PARTITION BY doc_id, batch_id ORDER BY sub_id, pair) - 1 AS sub_id, array_to_string(from_ids, ',') AS from_ids, array_to_string(to_ids, ',') AS to_ids FROM sp WHERE len(from_ids) > 0",
    "outliers": f"WITH {_BOUNDS} SELECT doc_id, pos, is_outlier FROM ol", "correction_tasks": f"WITH {_TASKS} SELECT doc_id, task, pos FROM tk",
    "score_by_length": f"WITH {_TASKS}, {_TEXTS}, tu AS (SELECT tk.task, tx.* FROM tk JOIN tx USING (doc_id, pos) WHERE EXISTS (SELECT 1 FROM ln WHERE ln.doc_id = tx.doc_id AND list_contains(tx.to_ids, ln.line_id))), {_RATIO} SELECT doc_id, task, round(sum(abs(0.9 - char_ratio) + abs(0.8 - word_ratio)), 6) AS score FROM ra GROUP BY ALL",
    "aligned_items": f"WITH {I.MATCH}, {_TEXTS} SELECT doc_id, pos, text_from, text_to FROM tx",
    "aligned_pair_chains": f"WITH {_chains_sql(3)}, {_TEXTS} SELECT DISTINCT tx.doc_id, batch_id, sub_id, text_from, text_to FROM tx JOIN gc ON gc.doc_id = tx.doc_id AND (batch_id, sub_id) >= (a[3], a[4]) AND (batch_id, sub_id) <= (b[3], b[4])",
    "empty_cells": f"WITH {I.MATCH} SELECT doc_id, bool_or(doc_id % 5 = sub_id) AS has_empty FROM ma GROUP BY doc_id",
    "paragraphs": f"WITH {_PARS} SELECT doc_id, par_id + 1 AS par, par_id, array_to_string(tf, '|') AS texts_from, array_to_string(tt, '|') AS texts_to, n_from, n_to FROM pa",
    "paragraphs_preview": f"WITH {_PARS} SELECT doc_id, par_id + 1 AS par, n_from, n_to FROM pa WHERE par_id < 2",
    "polybook_blocks": f"WITH {_BLOCKS}, b1 AS (SELECT bl.*, (SELECT min(ce.\"end\") FROM ce WHERE ce.doc_id = bl.doc_id AND ce.\"end\" >= bl.\"end\") AS bk FROM bl) SELECT doc_id, bk AS \"end\", lang, array_to_string(range(min(pv) + 1, max(\"end\") + 1), ',') AS main_ids, string_agg((\"end\" * 10)::VARCHAR, ',' ORDER BY \"end\") AS target_ids FROM b1 GROUP BY doc_id, bk, lang",
    "common_boundaries": f"WITH {_BLOCKS} SELECT doc_id, \"end\" FROM ce",
    "next_boundary": f"WITH {I.LINES} SELECT l.doc_id, l.line_id, min(b.line_id) AS boundary FROM ln l JOIN ln b ON b.doc_id = l.doc_id AND b.line_id >= l.line_id AND b.line_id % 5 = 0 GROUP BY ALL",
    "book_items": f"WITH {_items_sql()} SELECT * FROM bi", "book_sections": f"WITH {_items_sql()}, {_SECT} SELECT doc_id, section, count(*) AS items, count(*) FILTER (kind = 'paragraph') AS paragraphs FROM se GROUP BY ALL",
    "xml_sections": f"WITH {_items_sql()}, {_SECT} SELECT doc_id, section, '<section>' || chr(10) || string_agg('<' || {_TAG} || '><su lang=\"from\">' || {_ESC('value_from')} || '</su><su lang=\"to\">' || {_ESC('value_to')} || '</su></' || {_TAG} || '>', chr(10) ORDER BY item) || chr(10) || '</section>' AS value FROM se GROUP BY ALL HAVING count(*) FILTER (kind = 'paragraph') > 0",
    "tmx_rows": f"WITH {I.MATCH}, {_TEXTS} SELECT doc_id, pos, {_TU} AS value FROM tx",
    "plain_text": f"WITH {I.MATCH}, {_TEXTS} SELECT doc_id, pos, text_to AS value FROM tx",
    "paragraph_text": f"WITH {_PARS} SELECT doc_id, par_id + 1 AS pos, array_to_string(tt, ' ') AS value FROM pa",
    "json_body": f"WITH {_items_sql()} SELECT doc_id, item, {_JSON} AS value FROM bi",
    "json_books": f"WITH {_items_sql()} SELECT doc_id, '{{\"head\":{{\"title\":\"Book ' || doc_id || '\"}},\"body\":[' || string_agg({_JSON}, ',' ORDER BY item) || ']}}' AS value FROM bi GROUP BY doc_id",
    "xml_paragraphs": f"WITH {_PARS}, {_XML} SELECT doc_id, par_id + 1 AS pos, value FROM xp",
    "xml_books": f"WITH {_PARS}, {_XML} SELECT doc_id, '<book><head><title>A &amp; B ' || doc_id || '</title></head><body>' || chr(10) || string_agg(value, chr(10) ORDER BY par_id) || chr(10) || '</body></book>' AS value FROM xp GROUP BY doc_id",
    "tmx_documents": f"WITH {I.MATCH}, {_TEXTS}, tm AS (SELECT doc_id, pos, {_TU} AS value FROM tx) SELECT doc_id, '<?xml version=''1.0'' encoding=''UTF-8''?>' || chr(10) || '<tmx version=''1.4''>' || chr(10) || '<header srclang=\"en-US\" datatype=\"plaintext\" segtype=\"sentence\"/>' || chr(10) || '<body>' || chr(10) || string_agg(value, chr(10) ORDER BY pos) || chr(10) || '</body>' || chr(10) || '</tmx>' AS value FROM tm GROUP BY doc_id",
    "html_rows": f"WITH {_items_sql()}, h AS (SELECT *, CASE kind WHEN 'heading' THEN 'h2' ELSE 'p' END AS g, (item % 3)::VARCHAR AS y FROM bi) SELECT doc_id, item AS pos, '<tr>' || {' || '.join(f'''{chr(39)}<td class=\"col\"><{chr(39)} || g || {chr(39)} class=\"s{chr(39)} || y || {chr(39)}\">{chr(39)} || {_ESC('value_' + s)} || {chr(39)}</{chr(39)} || g || {chr(39)}></td>{chr(39)}''' for s in ('from', 'to'))} || '</tr>' AS value FROM h",
    "shift_ids": f"WITH {I.MATCH} SELECT doc_id, batch_id, sub_id, array_to_string(from_ids, ',') AS from_ids, array_to_string(list_transform(to_ids, lambda x: CASE WHEN x > doc_id % 9 + 1 THEN x + 1 ELSE x END), ',') AS to_ids FROM ma",
    "insert_lines": f"WITH {I.LINES}, x AS (SELECT *, doc_id % 9 + 1 AS a, ((line_id - 1) // 4)::BIGINT AS paragraph FROM ln), y AS (SELECT *, line_id + CASE WHEN line_id > a THEN 2 ELSE 0 END + CASE WHEN line_id > a + 3 THEN 1 ELSE 0 END AS pl FROM x) SELECT doc_id, pl AS line_id, text, paragraph FROM y UNION ALL SELECT doc_id, pl + unnest([1, 2]), '', paragraph FROM y WHERE line_id = a UNION ALL SELECT doc_id, pl + 1, '', paragraph FROM y WHERE line_id = a + 3",
    "set_text": f"WITH {I.LINES} SELECT doc_id, side, line_id, CASE WHEN line_id % 3 = 0 AND line_id % 6 <> 0 AND side = 'from' THEN 'new ' || t ELSE t END AS text FROM (SELECT doc_id, 'from' AS side, line_id, text AS t FROM ln UNION ALL SELECT doc_id, 'to', line_id, '[' || text || ']' FROM ln)",
    "paragraph_range": f"WITH {I.LINES} SELECT doc_id, side, line_id, CASE side WHEN 'to' THEN '[' || text || ']' ELSE text END AS text FROM ln, (VALUES ('from'), ('to')) t(side) WHERE (line_id - 1) // 4 > 1 AND (line_id - 1) // 4 <= 4",
    "proxy_texts": f"WITH {I.LINES}, px AS (SELECT doc_id, line_id, text, CASE WHEN doc_id % 3 <> 0 THEN 'p ' || text END AS proxy_text FROM ln) SELECT * FROM px",
    "meta_edit": f"WITH {_items_sql()}, u AS (SELECT doc_id, mark, CASE WHEN e THEN 'edited' ELSE val END AS val, CASE WHEN e THEN par_id + 2 ELSE par_id END AS par_id, e::INT AS late, occ FROM (SELECT *, occ = 0 AND mark IN ('h1', 'h2', 'title') AS e FROM m1)) SELECT doc_id, mark, val, (row_number() OVER (PARTITION BY doc_id, mark ORDER BY par_id, late, occ) - 1)::BIGINT AS occurrence, par_id::BIGINT AS par_id FROM u",
    "meta_insert": f"WITH {_items_sql()}, u AS (SELECT doc_id, mark, val, par_id, 0 AS late, occ FROM m1 UNION ALL SELECT DISTINCT doc_id, 'h1', 'new', 1, 1, NULL FROM m1) SELECT doc_id, mark, val, (row_number() OVER (PARTITION BY doc_id, mark ORDER BY par_id, late, occ) - 1)::BIGINT AS occurrence, par_id::BIGINT AS par_id FROM u",
    "meta_soft_delete": f"WITH {_items_sql()} SELECT mark, count(*) FILTER (occ = 0 AND mark IN ('h1', 'h2')) AS gone, count(*) AS n FROM m1 GROUP BY mark",
    "page_join": f"WITH {I.MATCH}, {_TEXTS} SELECT doc_id, -pos AS rank, text_from, text_to FROM tx",
    "replaced_batches": f"WITH {I.MATCH}, x AS (SELECT batch_id, to_ids FROM ma WHERE batch_id <> 1 OR NOT EXISTS (SELECT 1 FROM ma b WHERE b.doc_id = ma.doc_id AND b.batch_id = 1 AND b.sub_id < 5) UNION ALL SELECT batch_id, [1] FROM ma WHERE batch_id = 1 AND sub_id < 5) SELECT batch_id, count(*) AS n, sum(list_sum(to_ids))::BIGINT AS total FROM x GROUP BY batch_id",
    "alignment_points": f"WITH {I.MATCH} SELECT doc_id, (from_ids[1] - 1) // 10 AS bucket, from_ids[1] AS x, unnest(to_ids) AS y FROM ma",
    "ols_fit": f"WITH {I.MATCH}, p AS (SELECT doc_id, (from_ids[1] - 1) // 10 AS bucket, from_ids[1]::DOUBLE AS x, unnest(to_ids)::DOUBLE AS y FROM ma), f AS (SELECT doc_id, bucket, CASE WHEN count(DISTINCT x) > 1 THEN regr_slope(y, x) END AS slope, CASE WHEN count(DISTINCT x) > 1 THEN regr_intercept(y, x) END AS intercept FROM p GROUP BY ALL) SELECT doc_id, bucket, round(any_value(slope), 5) + 0.0 AS slope, round(any_value(intercept), 5) + 0.0 AS intercept, round(avg(CASE WHEN slope IS NOT NULL THEN (y - slope * x - intercept) * (y - slope * x - intercept) END), 5) AS mse FROM p JOIN f USING (doc_id, bucket) GROUP BY doc_id, bucket",
}
