from __future__ import annotations

from pyspark.sql import functions as F

from tandemtext.functions import text as X
from tandemtext.operators import books, lines as L


def one(spark, column, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in df.select("i", column(F.col("t")).alias("v")).orderBy("i").collect()]


def test_splitters(spark):
    assert one(spark, X.split_marks, "你好。再见！好", "", None) == [["你好。", "再见！", "好"], [], None]
    assert one(spark, X.split_jp, "「行く。」と言った。」そう。", "」a。b。") == [["「行く。」", "と言った。」", "そう。"], ["」a。", "b。"]]
    assert one(spark, X.split_hy, "Ա։ Բ... Գ:") == [["Ա։", "Բ…", "Գ:"]]
    assert one(spark, lambda c: X.after_fr(F.split(c, "\\|")), "« Oui.|» Non.|Fin.") == [["« Oui. »", " Non.", "Fin."]]
    assert one(spark, lambda c: X.split_sentences(c, "de"), "Am 12. Mai kam er. Er „ging“.") == [["Am 12. Mai kam er.", 'Er "ging".']]
    assert one(spark, X.split_default, "Mr. Smith came. He left! Why? no. 3 men.") == [["Mr. Smith came.", "He left!", "Why? no.", "3 men."]]
    assert one(spark, X.strip, "  a b  ") == ["a b"]
    assert one(spark, lambda c: X.clean_line(c, "jp"), "a. 日本（ご）。。") == ["。日本ご。。"]


def test_parts_are_made_once(spark):
    # an expression inside a function of elements is computed for each of them: a line of n sentences was split n times
    df = spark.createDataFrame([("a",)], "t string")
    for column in (X.split_jp, *[lambda c, k=k: X.split_sentences(c, k) for k in ("fr", "de", "en", "jp", "hy")]):
        plan = df.select(column(F.col("t")).alias("v"))._jdf.queryExecution().analyzed().toString()
        assert plan.count("split(t") + plan.count("split(regexp_replace") + plan.count("split(replace") == 1
    long = "「はい。" * 20_000
    assert one(spark, lambda c: F.size(X.split_jp(c)), long) == [20_000]


def test_cuts_after_marks(spark):
    texts = ["!!a..b", "。", "", "a\u0001b.c", "\u0001", "x…y։.z"]
    assert one(spark, X.split_marks, *texts) == [["a.", "b"], [], [], ["a\u0001b.", "c"], ["\u0001"], ["x…y։.", "z"]]
    assert one(spark, X.split_hy, *texts) == [["!!a..b"], ["。"], [], ["a\u0001b.c"], ["\u0001"], ["x…", "y։", ".z"]]
    plan = spark.range(1).select(X.split_marks(F.col("id").cast("string")))._jdf.queryExecution().analyzed().toString()
    assert plan.index("CASE WHEN") < plan.index("regexp_extract_all")  # only for texts with the sign of the cut


def test_lines_without_mark_are_not_searched(spark):
    plan = spark.range(1).select(X.split_paragraph_marks(F.col("id").cast("string")), X.mark_paragraph(F.col("id").cast("string")))._jdf.queryExecution().analyzed().toString()
    assert plan.index("Contains") < plan.index("regexp_extract_all") and "RLIKE" not in plan
    assert one(spark, X.split_paragraph_marks, "a b", "", None, "%%%%%", "a%%%%%.b") == [["a b"], [], None, ["%%%%%"], ["a%%%%%.", "b"]]
    assert one(spark, X.mark_paragraph, "", None, ".", " x? ", "x\u3000") == ["", None, "%%%%%.", "x%%%%%?", "x\u3000"]


def test_signs_and_names(spark):
    kept = "it's `a` {b} <c> |d| e_f g=h+i~j \\k"
    assert one(spark, X.clean_symbols, kept, "a-b:c/d[e](f)「g」①⑴＂＋〃》【】“q” «r» #@$%^&*•–—'s", "x\ny\x1a") == [kept, "abcdefgq r 's", "xy"]
    assert "regexp" not in spark.range(1).select(X.clean_symbols(F.col("id").cast("string")))._jdf.queryExecution().analyzed().toString()
    assert one(spark, X.clean_symbols, "", None, "".join(map(chr, range(9, 128)))) == ["", None, "\t\x0b\x0c\r" + "".join(map(chr, (*range(14, 26), *range(27, 34), 39, 43, 44, 46, *range(48, 58), *range(59, 64), *range(65, 91), 92, *range(95, 128))))]
    assert one(spark, X.contents_name, "fr", "it", "hu", "cv", "hy", "??", None) == ["Table des matières", "Sommario", "Tartalom", "Содержани", "Table of contents", "Table of contents", "Table of contents"]
    assert one(spark, X.culture, "de", "ru", "zh", "fr", None) == ["de-DE", "ru-RU", "zh-CN", "en-US", "en-US"]


def test_mark_headings_with_deletions(spark):
    config = {**X.HEADING_CONFIG, "arabic": X.DELETE, "roman": X.PASS}
    got = [r.text for r in L.mark_headings(table(spark, ["no end", "12", "open", " XIV ", "x"]), config).orderBy("line_id").collect()]
    assert got == ["no end", "open.", "XIV", "x"]


def test_marks(spark):
    assert one(spark, X.mark_paragraph, "End.", "no end", "Why? ") == ["End%%%%%.", "no end", "Why%%%%%?"]
    assert one(spark, X.split_paragraph_marks, "a%%%%%.b%%%%%! c") == [["a%%%%%.", "b%%%%%!", " c"]]
    got = one(spark, X.parsed_line, "Text%%%%%.", "One%%%%%h1.", "plain")
    assert [tuple(r) for r in got] == [("Text.", True, None, None), ("One", False, "h1", "h1"), ("plain", False, None, None)]
    kinds = one(spark, X.heading_kind, "Часть первая", "Erster Band", "глава 1", "XIV", "12", "12 March 1901", "x x x", "plain", "")
    assert kinds == ["type_1", "type_1", "type_2", "roman", "arabic", "date", "misc", None, None]
    both = lambda config=None: one(spark, lambda c: X.marked_heading(c, X.heading_kind(c), config), "глава der band", "12 teil")
    assert both() == ["глава der band%%%%%h1.%%%%%h2.", "12 teil%%%%%h2."]
    assert both({**X.HEADING_CONFIG, "type_1": X.PASS}) == ["глава der band%%%%%h2.", "12 teil%%%%%h2."] and both({**X.HEADING_CONFIG, "type_1": X.DELETE}) == ["", "12 teil%%%%%h2."]
    assert one(spark, X.cleaned_artifacts, "2000 leagues", "1999 leagues", "2000") == [["2000", "leagues"], ["1999 leagues"], []]
    assert one(spark, X.cleaned_artifacts, "-7-", "12", "12 plus one", "1984 was", "x x x", "  keep ") == [[], [], ["12", "plus one"], ["1984 was"], [], ["keep"]]
    assert one(spark, X.is_date, "1. Mai 1900", "12/03/1999", "May 5", "hello", "1901") == [True, True, True, False, True]


LINES = ["Title%%%%%title.", "One%%%%%h1.", "A. ", "B%%%%%.", "C.", "Two%%%%%h1.", "D.", "%%%%%divider.", "E%%%%%!"]


def table(spark, texts=LINES):
    return spark.createDataFrame([("d", "from", i + 1, t) for i, t in enumerate(texts)], "doc_id string, side string, line_id long, text string")


def test_handle_marks(spark):
    got = [(r.text, r.paragraph, r.h1, r.divider) for r in L.handle_marks(table(spark)).orderBy("line_id").collect()]
    assert got == [("A.", 2, 1, 0), ("B.", 2, 1, 0), ("C.", 3, 1, 0), ("D.", 4, 2, 0), ("E!", 5, 2, 1)]
    meta = {(r.mark, r.val, r.occurrence, r.par_id) for r in L.meta_lines(table(spark)).collect()}
    assert meta == {("title", "Title", 0, 0), ("h1", "One", 0, 1), ("h1", "Two", 1, 3), ("divider", "* * *", 0, 4)}


def test_marks_are_computed_once(spark):
    for made in (L.handle_marks, L.meta_lines):
        plan = made(table(spark))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("trim(") == 1 and "(?U)" not in plan
    # meta lines carry their values, not the texts of all lines, through the windows
    plan = L.meta_lines(table(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert "m#" in plan and ".line" not in plan
    spaces = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u200a\u2028\u2029\u202f\u205f\u3000"
    assert one(spark, X.strip, spaces + "\u200ba\x1c" + spaces, spaces, None) == ["\u200ba\x1c", "", None]


def test_split_lines(spark):
    got = [r.text for r in L.split_lines(table(spark, ["One%%%%%h1.", "He came. She", "left%%%%%. Then", "", "End."]), "en").orderBy("line_id").collect()]
    assert got[0] == "One%%%%%h1." and "".join(got[1:]).replace(" ", "") == "Hecame.Sheleft%%%%%.ThenEnd."
    assert got[1] == "He came." and any(t.endswith("left%%%%%.") for t in got)


def test_mark_headings_ends_the_line_before(spark):
    got = [r.text for r in L.mark_headings(table(spark, ["no end", "Part one", "x", "y.", "XIV"])).orderBy("line_id").collect()]
    assert got == ["no end.", "Part one%%%%%h1.", "x", "y.", "XIV%%%%%h2."]


def test_merge_example(spark):
    runs = lambda *sizes: [list(range(6 + sum(sizes[:k]), 6 + sum(sizes[: k + 1]))) for k in range(len(sizes))]
    a, b = runs(2, 1, 4, 3, 1), runs(1, 1, 1, 1, 4, 3)
    data = [("d", lang, x[-1], x, [x[0]]) for lang, bs in (("a", a), ("b", b)) for x in bs]
    df = spark.createDataFrame(data, "doc_id string, lang string, end long, main_ids array<long>, target_ids array<long>")
    got = books.polybook_blocks(df, ["doc_id"]).where("lang = 'a'").orderBy("end").collect()
    assert [r.main_ids for r in got] == [[6, 7], [8], list(range(9, 17))]


def test_segments(spark):
    meta = spark.createDataFrame([("d", s, "h2", "x", i, p) for s, ps in (("from", (0, 5)), ("to", (1, 7))) for i, p in enumerate(ps)] + [("e", "from", "h2", "x", 0, 0)], "doc_id string, side string, mark string, val string, occurrence long, par_id long")
    n = spark.createDataFrame([("d", "from", 20), ("d", "to", 30), ("e", "from", 5)], "doc_id string, side string, n long")
    got = L.segments(meta, n).orderBy("segment").collect()
    assert [(r.par_start_from, r.par_end_from, r.par_start_to, r.par_end_to) for r in got] == [(0, 5, 1, 7), (5, 20, 7, 30)]
    assert [r.doc_id for r in L.unequal_segments(meta).collect()] == ["e"]
