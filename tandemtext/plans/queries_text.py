"""Queries over texts: cleaning, splitting, artefacts, headings, marks and segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tandemtext.functions import text as X
from tandemtext.operators import batching, lines as L
from tandemtext.plans import inputs as I


def _parts(df: DataFrame, parts: Column) -> DataFrame:
    return df.select("doc_id", "line_id", F.posexplode(parts).alias("p", "part")).select("doc_id", "line_id", F.col("p").cast("long").alias("p"), "part")


def _split(column, rows=I.dirty_lines):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _parts(rows(spark, d), column(F.col("text")))

    return run


def _line(column, rows=I.dirty_lines):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return rows(spark, d).select("doc_id", "line_id", column(F.col("text")).alias("text"))

    return run


def _split_sql(expr: str, rows: str = I.DIRTY, name: str = "di") -> str:
    return f"WITH {rows}, s AS (SELECT doc_id, line_id, {expr} AS a FROM {name}) SELECT doc_id, line_id, (generate_subscripts(a, 1) - 1)::BIGINT AS p, unnest(a) AS part FROM s"


def _line_sql(expr: str) -> str:
    return f"WITH {I.DIRTY} SELECT doc_id, line_id, {expr} AS text FROM di"


def _rx(expr: str, *rules: tuple[str, str]) -> str:
    for a, b in rules:
        expr = f"regexp_replace({expr}, '{a.replace(chr(39), chr(39) * 2)}', '{b}', 'g')"
    return expr


# The rules are typed out here once more and in other forms, so that a change of a rule shows as a difference.
_S = r"[ \t\n\f\r\v]"
_SENTENCES = "[^!?。！？.]+[!?。！？.]?"
_SHORT = "Mr|Mrs|Ms|Dr|Prof|St|Jr|Sr|Sra|Mme|Nr|No|vs|etc|ca|bzw|usw"
_MONTHS = "Januar|Jänner|Janner|Februar|März|Marz|April|Mai|Juni|Juli|August|September|Oktober|October|November|Dezember"
_PAGE, _NUMBER, _XXX = "^-[0-9]+-$", "^[0-9]+$", "^x x x*$"
_HEAD_1 = "(?i)^part .*$|^часть .*$|^díl .*$|^capitolo .*$|^.* band$"
_HEAD_2 = "(?i)^глава .*$|^.* teil$"
_ROMAN = "^M{0,4}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$"
_YEAR = lambda e: f"(regexp_matches({e}, '^1[5-9][0-9][0-9]') OR regexp_matches({e}, '^20[0-9][0-9]$'))"
_MONTH_NAMES = "|".join((
    "january|february|march|april|may|june|july|august|september|october|november|december", "januar|jänner|februar|märz|mai|juni|juli|oktober|dezember",
    "janvier|février|mars|avril|juin|juillet|août|septembre|octobre|novembre|décembre", "gennaio|febbraio|marzo|aprile|maggio|giugno|luglio|agosto|settembre|ottobre|dicembre", "января|февраля|марта|апреля|мая|июня|июля|августа|сентября|октября|ноября|декабря",
))
_DATES = (rf"[0-9]{{1,2}}\.?{_S}+({_MONTH_NAMES})(,?{_S}+[0-9]{{2,4}})?", rf"({_MONTH_NAMES}){_S}+[0-9]{{1,2}}(,?{_S}+[0-9]{{4}})?", rf"({_MONTH_NAMES}){_S}+[0-9]{{4}}", "[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4}", "[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}", rf"[0-9]{{4}}{_S}*年.*", "(1[5-9]|20)[0-9][0-9]")
_IS_DATE = lambda e: "(" + " OR ".join(f"regexp_matches(lower({e}), '^({d})[.]?$')" for d in _DATES) + ")"
_CLEANED = "[10, 26, 34, 35, 36, 37, 38, 40, 41, 42, 45, 47, 58, 64, 91, 93, 94, 171, 187, 8211, 8212, 8216, 8217, 8219, 8220, 8221, 8222, 8223, 8226, 8231, 9450, 12289, 12291, 12297, 12299, 12300, 12301, 12304, 12305, 12316, 12319, 12336, 12350, 12351, 65103, 65293, 65295, 65312, 65378, 65379, 65380] || range(9312, 9322) || range(9332, 9342) || range(12308, 12314) || range(65282, 65292) || range(65306, 65311) || range(65339, 65345) || range(65371, 65377)"
_DEFAULT = ((_S + "{2,}", " "), (",{2,}", ","), ("[-—]{2,}", "—"))
_MARKS_SQL = f"regexp_extract_all(%s, '{_SENTENCES}')"
_SPLIT_DEFAULT = (
    lambda e, before="": "list_transform(string_split("
    + _rx(_rx(e, (rf"\b({_SHORT})\.{_S}+", r"\1." + "\u0002")), (rf"""([.!?…]["»”')]*){_S}+({before}["«“(—-]*(?:\p{{Lu}}|[0-9]))""", r"\1" + "\u0001" + r"\2"))
    + ", '\u0001'), lambda x: replace(x, '\u0002', ' '))"
)
_PULL = lambda parts, sign, add: f"list_transform({parts}, lambda x, i: CASE WHEN i > 1 AND x[1] = '{sign}' THEN x[2:] ELSE x END || CASE WHEN coalesce(({parts})[i + 1][1] = '{sign}', false) THEN '{add}' ELSE '' END)"
_DROP_BLANK = lambda parts: f"CASE WHEN len({parts}) > 0 AND trim(({parts})[-1]) = '' THEN ({parts})[:-2] ELSE {parts} END"


def split_wrapper(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of whole documents: runs of unmarked lines joined and split, marked lines kept, cut at paragraph marks."""
    return L.split_lines(I.marked_lines(spark, d), "en").select("doc_id", "line_id", "text")


_WRAPPER = f"""WITH {I.MARKED},
w1 AS (SELECT doc_id, line_id, text, regexp_matches(text, '%%%%%(h1|h2|h3|h4|h5|divider|title|author|qtext|qname|image|translator)')::INT AS m FROM mk WHERE trim(text) <> ''),
w2 AS (SELECT *, sum(m) OVER (PARTITION BY doc_id ORDER BY line_id) * 2 - m AS run FROM w1),
w3 AS (SELECT doc_id, run, max(m) AS m, list(text ORDER BY line_id) AS l FROM w2 GROUP BY ALL),
w4 AS (SELECT doc_id, run, m, l, {_SPLIT_DEFAULT(_rx("array_to_string(l, ' ')", *_DEFAULT))} AS s0 FROM w3),
w5 AS (SELECT doc_id, run, m, l, {_DROP_BLANK("s0")} AS s FROM w4),
w6 AS (SELECT doc_id, run, CASE WHEN m = 1 THEN l ELSE flatten(list_transform(s, lambda x: regexp_extract_all(x, '(?s).*?%%%%%[.!?;:。？！"'']|.+$'))) END AS s FROM w5),
w7 AS (SELECT doc_id, run, generate_subscripts(s, 1) AS p, unnest(s) AS text FROM w6)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY run, p)::BIGINT AS line_id, text FROM w7"""


def clean_artifacts(spark: SparkSession, d: str) -> DataFrame:
    return L.clean_artifacts(I.artifact_lines(spark, d)).select("doc_id", "line_id", "text")


def find_artifacts(spark: SparkSession, d: str) -> DataFrame:
    return L.find_artifacts(I.artifact_lines(spark, d)).select("doc_id", "line_id", "kind")


_ST = lambda e: f"regexp_replace(regexp_replace({e}, '^{_S}+', ''), '{_S}+$', '')"
_INLINE = rf"^[0-9]+{_S}+.*$|^[0-9]+´.*$"
_CLEAN = f"""WITH {I.ARTIFACTS},
a1 AS (SELECT doc_id, line_id, {_ST("text")} AS s FROM ar),
a2 AS (SELECT doc_id, line_id, CASE WHEN regexp_matches(s, '{_PAGE}') THEN '' ELSE s END AS s FROM a1),
a3 AS (SELECT *, regexp_matches(s, '{_INLINE}') AND NOT {_YEAR('s')} AND NOT {_IS_DATE('s')} AS inl FROM a2),
a4 AS (SELECT doc_id, line_id, CASE WHEN inl THEN regexp_extract(s, '[0-9]+') END AS num, CASE WHEN inl THEN regexp_replace(s, '^[0-9]+', '') ELSE s END AS s FROM a3),
a5 AS (SELECT doc_id, line_id, num, CASE WHEN regexp_matches(s, '{_NUMBER}') OR regexp_matches(s, '{_XXX}') THEN '' ELSE {_ST("s")} END AS s FROM a4),
a6 AS (SELECT doc_id, line_id, list_filter([num, s], lambda x: x IS NOT NULL AND x <> '') AS l FROM a5),
a7 AS (SELECT doc_id, line_id, generate_subscripts(l, 1) AS p, unnest(l) AS text FROM a6)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_id, p)::BIGINT AS line_id, text FROM a7"""
_FIND = f"""WITH {I.ARTIFACTS}, a1 AS (SELECT doc_id, line_id, {_ST("text")} AS s FROM ar),
a2 AS (SELECT doc_id, line_id, CASE WHEN regexp_matches(s, '{_PAGE}') THEN 'page_num' WHEN regexp_matches(s, '{_INLINE}') AND NOT {_YEAR('s')} THEN 'inline'
  WHEN regexp_matches(s, '{_NUMBER}') THEN 'arabic' WHEN regexp_matches(s, '{_XXX}') THEN 'misc' END AS kind FROM a1) SELECT * FROM a2 WHERE kind IS NOT NULL"""


def find_headings(spark: SparkSession, d: str) -> DataFrame:
    return L.find_headings(I.artifact_lines(spark, d)).select("doc_id", "line_id", "kind")


def mark_headings(spark: SparkSession, d: str) -> DataFrame:
    return L.mark_headings(I.artifact_lines(spark, d)).select("doc_id", "line_id", "text")


_KIND = f"""CASE WHEN regexp_matches(s, '{_HEAD_1}') THEN 'type_1' WHEN regexp_matches(s, '{_HEAD_2}') THEN 'type_2' WHEN s <> '' AND regexp_matches(s, '{_ROMAN}') THEN 'roman' WHEN regexp_matches(s, '{_NUMBER}') THEN 'arabic'
  WHEN regexp_matches(s, '{_INLINE}') AND {_IS_DATE('s')} THEN 'date' WHEN regexp_matches(s, '{_XXX}') THEN 'misc' END"""
_HEADS = f"""{I.ARTIFACTS}, h1 AS (SELECT doc_id, line_id, {_ST("text")} AS s FROM ar), h2 AS (SELECT *, {_KIND} AS kind FROM h1)"""
_MARK = f"""WITH {_HEADS},
h3 AS (SELECT doc_id, line_id, kind, CASE kind WHEN 'type_1' THEN s || '%%%%%h1.' WHEN 'type_2' THEN s || '%%%%%h2.' WHEN 'roman' THEN s || '%%%%%h2.' WHEN 'arabic' THEN s || '%%%%%h2.' WHEN 'date' THEN s || '%%%%%h3.' WHEN 'misc' THEN s || '%%%%%divider.' ELSE s END AS s FROM h2),
h4 AS (SELECT *, lead(kind) OVER (PARTITION BY doc_id ORDER BY line_id) AS nk FROM h3 WHERE s <> '')
SELECT doc_id, line_id, CASE WHEN nk IS NOT NULL AND NOT regexp_matches(s, '[.!?;:。？！"'']$') THEN s || '.' ELSE s END AS text FROM h4"""


def handle_marks(spark: SparkSession, d: str) -> DataFrame:
    return L.handle_marks(I.marked_lines(spark, d)).drop("side")


def meta_occurrences(spark: SparkSession, d: str) -> DataFrame:
    return L.meta_lines(I.marked_lines(spark, d)).drop("side")


_ENDS = "%%%%%([.!?;:。？！\"''])$"
_META = "%%%%%(h1|h2|h3|h4|h5|divider|title|author|qtext|qname|image|translator)\\.$"
_FLAGS = f"""{I.MARKED}, f1 AS (SELECT doc_id, line_id, {_ST("text")} AS s FROM mk),
f2 AS (SELECT doc_id, line_id, regexp_matches(s, '{_ENDS}') AS nx, regexp_replace(s, '{_ENDS}', '\\1') AS s FROM f1),
f3 AS (SELECT *, nullif(regexp_extract(s, '{_META}', 1), '') AS mark FROM f2),
fl AS (SELECT *, coalesce(sum((mark IS NOT NULL OR nx)::INT) OVER (PARTITION BY doc_id ORDER BY line_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS paragraph,
  {", ".join(f"(count(*) FILTER (mark = '{m}') OVER (PARTITION BY doc_id ORDER BY line_id))::BIGINT AS {m}" for m in ("h1", "h2", "h3", "h4", "h5", "divider"))} FROM f3)"""
_SEG = f"""{_FLAGS}, sg AS (SELECT DISTINCT doc_id, paragraph AS par_id FROM fl WHERE mark IN ('h2', 'h4')),
sn AS (SELECT doc_id, count(*) AS n FROM fl WHERE mark IS NULL GROUP BY doc_id),
ss AS (SELECT doc_id, row_number() OVER w AS segment, par_id AS p0, coalesce(lead(par_id) OVER w, n)::BIGINT AS p1 FROM sg JOIN sn USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY par_id))"""


def _both_marked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    raw = I.marked_lines(spark, d)
    both = raw.unionByName(raw.withColumn("side", F.lit("to")))
    return L.handle_marks(both), L.meta_lines(both)


def segments(spark: SparkSession, d: str) -> DataFrame:
    own, meta = _both_marked(spark, d)
    n = own.groupBy("doc_id", "side").agg(F.count(F.lit(1)).alias("n"))
    return L.segments(meta, n, ("h2", "h4"))


def batches_segments(spark: SparkSession, d: str) -> DataFrame:
    own, meta = _both_marked(spark, d)
    n = own.groupBy("doc_id", "side").agg(F.count(F.lit(1)).alias("n"))
    return batching.segment_batches(L.segments(meta, n, ("h2", "h4")), own, 3, 1)


_SEG_BATCHES = f"""WITH {_SEG}, tl AS (SELECT doc_id, paragraph, row_number() OVER (PARTITION BY doc_id ORDER BY line_id) - 1 AS place FROM fl WHERE mark IS NULL),
sb AS (SELECT ss.doc_id, segment, count(*) AS l, min(place) AS a FROM ss JOIN tl ON tl.doc_id = ss.doc_id AND tl.paragraph > p0 AND tl.paragraph <= p1 GROUP BY ALL),
b1 AS (SELECT *, unnest(range(((l + 2) // 3)::BIGINT)) AS b FROM sb)
SELECT doc_id, segment::BIGINT AS segment, (row_number() OVER (PARTITION BY doc_id ORDER BY segment, b) - 1)::BIGINT AS batch_id, (a + b * 3)::BIGINT AS f0, (a + least(b * 3 + 3, l))::BIGINT AS f1,
  (a + greatest(0, b * 3 - 1))::BIGINT AS t0, (a + greatest(greatest(0, b * 3 - 1), least(b * 3 + 4, l)))::BIGINT AS t1 FROM b1"""


def parsed_lines(spark: SparkSession, d: str) -> DataFrame:
    return I.marked_lines(spark, d).select("doc_id", "line_id", X.parsed_line(X.strip(F.col("text"))).alias("p")).select("doc_id", "line_id", "p.text", "p.paragraph", "p.mark", "p.flag")


_CODES = "ru bu zh de en fr it tr es pl pt hu cz jp ba ko sw nl uk cv hy xx la qq".split()


def languages(spark: SparkSession, d: str) -> DataFrame:
    """All codes that are known, some that are not and none, with the documents that have them."""
    c = F.col("lang")
    n = I.table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    every = spark.createDataFrame([(x,) for x in (*_CODES, None)], "code string").join(n, F.col("code") == c, "left")
    c = F.col("code")
    return every.select("code", F.coalesce("n", F.lit(0)).alias("n"), X.is_lang_code_valid(c).alias("known"), X.culture(c).alias("culture"), X.contents_name(c).alias("contents"))


_LANGUAGES = """WITH v(code, known, culture, contents) AS (VALUES
('ru', true, 'ru-RU', 'Содержание'), ('bu', true, 'en-US', 'Table of contents'), ('zh', true, 'zh-CN', '目录'), ('de', true, 'de-DE', 'Inhalt'), ('en', true, 'en-US', 'Contents'), ('fr', true, 'en-US', 'Table des matières'),
('it', true, 'en-US', 'Sommario'), ('tr', true, 'en-US', 'İçindekiler'), ('es', true, 'en-US', 'Tabla de contenido'), ('pl', true, 'en-US', 'Spis treści'), ('pt', true, 'en-US', 'Conteúdo'), ('hu', true, 'en-US', 'Tartalom'),
('cz', true, 'en-US', 'Obsah'), ('jp', true, 'en-US', '目次'), ('ba', true, 'en-US', 'Йөкмәткеһе'), ('ko', true, 'en-US', '목차'), ('sw', true, 'en-US', 'Innehållsförteckning'), ('nl', true, 'en-US', 'Inhoudsopgave'),
('uk', true, 'en-US', 'Зміст'), ('cv', true, 'en-US', 'Содержани'), ('hy', true, 'en-US', 'Table of contents'), ('xx', true, 'en-US', 'Table of contents'), ('la', false, 'en-US', 'Table of contents'), ('qq', false, 'en-US', 'Table of contents'), (NULL, false, 'en-US', 'Table of contents'))
SELECT code, (SELECT count(*) FROM documents d WHERE d.lang = v.code) AS n, known, culture, contents FROM v"""

# Lines of scripts that the tables lack, with answers worked out by hand: (rule, line, parts or cleaned line).
_FIXTURES: list[tuple[str, str, list[str]]] = [
    ("zh", "你好。再见！好吗？好", ["你好。", "再见！", "好吗？", "好"]), ("zh", "a.b!c", ["a.", "b!", "c"]), ("zh", "一《二》三「四」：五（六）", ["一《二三四：五（六）"]), ("zh", "好 ① 〃", ["好"]),
    ("jp", "「行く。」と言った。」そう。", ["「行く。」", "と言った。」", "そう。"]), ("jp", "今日は...雨 ABC", ["今日は。", "雨"]), ("jp", "彼（私）は：来た。", ["彼私は来た。"]),
    ("hy", "Նա եկավ։ Ո՞վ... Այո:", ["Նա եկավ։", "Ո՞վ…", "Այո:"]), ("hy", "Մեկ…. Երկու", ["Մեկ…", ". Երկու"]),
    ("de", "Am 12. Mai kam er. Und am 3. Juli auch.", ["Am 12. Mai kam er.", "Und am 3. Juli auch."]), ("de", "Er sagte: „Nein.“ Dann ging er am 5. Tag.", ['Er sagte: "Nein."', "Dann ging er am 5.", "Tag."]),
    ("fr", "Il dit : « Non. » Puis rien.", ["Il dit : « Non. »", " Puis rien."]), ("fr", "Oui. Et toi ? Moi aussi.", ["Oui.", "Et toi ?", "Moi aussi."]),
    ("ru", "Он <сказал> 'да'.  Потом ушёл.", ["Он сказал да.", "Потом ушёл."]), ("ru", "Раз,, два -- три.", ["Раз, два — три."]), ("en", "Mr. Smith came.  He left!", ["Mr. Smith came.", "He left!"]),
]


def script_fixtures(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of lines in eight languages, cleaned and split by each language's rules."""
    df = spark.createDataFrame([(i, k, t) for i, (k, t, _) in enumerate(_FIXTURES)], "id long, lang string, text string")
    by = {k: X.split_sentences(F.col("text"), k) for k in sorted({k for k, _, _ in _FIXTURES})}
    parts = F.lit(None).cast("array<string>")
    for k, c in by.items():
        parts = F.when(F.col("lang") == k, c).otherwise(parts)
    return df.select("id", "lang", F.posexplode(parts).alias("p", "part")).select("id", "lang", F.col("p").cast("long").alias("p"), "part")


_quoted = lambda t: "'" + t.replace("'", "''") + "'"
_SCRIPTS = "SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, '{k}', {p}::BIGINT, {_quoted(t)})" for i, (k, _, parts) in enumerate(_FIXTURES) for p, t in enumerate(parts)) + ") t(id, lang, p, part)"


def is_date(spark: SparkSession, d: str) -> DataFrame:
    """Which lines are dates: those strewn among the lines and some of each kind."""
    more = spark.createDataFrame([(-1, i, t) for i, t in enumerate(_DATE_LINES)], "doc_id long, line_id long, text string")
    return I.artifact_lines(spark, d).select("doc_id", "line_id", "text").unionByName(more).select("doc_id", "line_id", X.is_date(F.col("text")).alias("date"))


_DATE_LINES = ["1. Mai 1900", "12/03/1999", "May 5", "may 1900.", "hello", "1901", "2050", "1401", "5 августа", " 3 marzo 22 ", "2020-1-2", "1999年5月", "12 Maybe 1900", "32", "juin 7, 1888", "the 4 July"]


QUERIES = {
    "split_zh": _split(X.split_marks), "split_jp": _split(X.split_jp, I.script_lines), "split_hy": _split(X.split_hy, I.script_lines), "split_default": _split(X.split_default), "split_fr": _split(lambda c: X.split_sentences(c, "fr")), "split_de": _split(lambda c: X.split_sentences(c, "de")),
    "clean_symbols": _line(X.clean_symbols, I.signed_lines), "clean_default": _line(lambda c: X.clean_line(c, "en")), "clean_ru": _line(lambda c: X.clean_line(c, "ru")), "clean_de_dates": _line(lambda c: X.clean_line(c, "de")), "paragraph_marks": _line(X.mark_paragraph), "split_wrapper": split_wrapper,
    "clean_artifacts": clean_artifacts, "find_artifacts": find_artifacts, "find_headings": find_headings, "mark_headings": mark_headings, "handle_marks": handle_marks, "meta_occurrences": meta_occurrences,
    "segments": segments, "batches_segments": batches_segments, "parsed_lines": parsed_lines, "languages": languages, "script_fixtures": script_fixtures, "is_date": is_date,
}
_DE_RULES = (("[»«“„]+", '"'), (rf"({_S})([0-9]{{1,2}})\.({_S}+)({_MONTHS})", r"\1\2%@%\3\4"), *_DEFAULT)
ORACLES = {
    "split_zh": _split_sql(_MARKS_SQL % "text"), "split_jp": _split_sql(_PULL(_MARKS_SQL % "text", "」", "」"), I.SCRIPT, "sl"),
    "split_hy": _split_sql(f"list_filter(list_transform(regexp_extract_all({_rx('text', (r'\.{3,}', '…'))}, '[^:։…]+[:։…]?'), lambda x: {_ST('x')}), lambda x: x <> '')", I.SCRIPT, "sl"),
    "split_default": _split_sql(_SPLIT_DEFAULT("text")),
    "split_fr": f"WITH {I.DIRTY}, s0 AS (SELECT doc_id, line_id, {_SPLIT_DEFAULT(_rx('text', *_DEFAULT), '(?:»' + _S + '*)?')} AS a FROM di), s1 AS (SELECT doc_id, line_id, {_PULL('a', '»', ' »')} AS a FROM s0), s2 AS (SELECT doc_id, line_id, {_DROP_BLANK('a')} AS a FROM s1) SELECT doc_id, line_id, (generate_subscripts(a, 1) - 1)::BIGINT AS p, unnest(a) AS part FROM s2",
    "split_de": f"WITH {I.DIRTY}, s0 AS (SELECT doc_id, line_id, list_transform({_SPLIT_DEFAULT(_rx('text', *_DE_RULES))}, lambda x: {_rx('x', (rf'({_S})([0-9]{{1,2}})%@%({_S}+)({_MONTHS})', r'\1\2.\3\4'))}) AS a FROM di), s2 AS (SELECT doc_id, line_id, {_DROP_BLANK('a')} AS a FROM s0) SELECT doc_id, line_id, (generate_subscripts(a, 1) - 1)::BIGINT AS p, unnest(a) AS part FROM s2",
    "clean_symbols": f"WITH {I.SIGNED} SELECT doc_id, line_id, array_to_string(list_filter(string_split(text, ''), lambda c: NOT list_contains({_CLEANED}, unicode(c))), '') AS text FROM sd", "clean_default": _line_sql(_rx("text", *_DEFAULT)), "clean_ru": _line_sql(_rx("text", (r"[/<>•'\n]+", ""), *_DEFAULT)), "clean_de_dates": _line_sql(_rx("text", *_DE_RULES)),
    "paragraph_marks": _line_sql(f"CASE WHEN regexp_matches({_ST('text')}, '[.!?;:。？！\"'']$') THEN regexp_replace({_ST('text')}, '([.!?;:。？！\"''])$', '%%%%%\\1') ELSE text END"),
    "split_wrapper": _WRAPPER, "clean_artifacts": _CLEAN, "find_artifacts": _FIND, "find_headings": f"WITH {_HEADS} SELECT doc_id, line_id, kind FROM h2 WHERE kind IS NOT NULL", "mark_headings": _MARK,
    "handle_marks": f"WITH {_FLAGS} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_id)::BIGINT AS line_id, s AS text, paragraph, h1, h2, h3, h4, h5, divider FROM fl WHERE mark IS NULL",
    "meta_occurrences": f"WITH {_FLAGS}, m AS (SELECT doc_id, mark, CASE WHEN mark = 'divider' THEN '* * *' ELSE regexp_replace(s, '{_META}', '') END AS val, paragraph AS par_id, line_id FROM fl WHERE mark IS NOT NULL) SELECT doc_id, mark, val, (row_number() OVER (PARTITION BY doc_id, mark ORDER BY line_id) - 1)::BIGINT AS occurrence, par_id FROM m WHERE val <> ''",
    "segments": f"WITH {_SEG} SELECT doc_id, segment::BIGINT AS segment, p0 AS par_start_from, p1 AS par_end_from, p0 AS par_start_to, p1 AS par_end_to FROM ss",
    "batches_segments": _SEG_BATCHES,
    "parsed_lines": f"WITH {_FLAGS} SELECT doc_id, line_id, CASE WHEN mark IS NULL THEN s ELSE regexp_replace(s, '{_META}', '') END AS text, nx AND mark IS NULL AS paragraph, mark, mark[1:2] AS flag FROM fl",
    "languages": _LANGUAGES, "script_fixtures": _SCRIPTS,
    "is_date": f"WITH {I.ARTIFACTS}, a AS (SELECT doc_id, line_id, text FROM ar UNION ALL SELECT -1, i - 1, ({_DATE_LINES})[i] FROM range(1, {len(_DATE_LINES) + 1}) r(i)) SELECT doc_id, line_id, {_IS_DATE(_ST('text'))} AS date FROM a",
}
