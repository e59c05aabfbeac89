"""Tables that the registered queries start from, derived from the supplied ones by rules that SQL repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Vectors of so many ids make one document; even ids are its from-lines, odd ones its to-lines.
DOC_IDS = 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vector_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, side, line_id, text, embedding); a line's text is so many x as its id demands, for weights by length."""
    e = table(spark, sf_dir, "embeddings")
    v = F.col("vec_id")
    return e.select(F.floor(v / DOC_IDS).cast("long").alias("doc_id"), F.when(v % 2 == 0, "from").otherwise("to").alias("side"), (F.floor((v % DOC_IDS) / 2) + 1).cast("long").alias("line_id"), F.repeat(F.lit("x"), (v % 7 + 1).cast("int")).alias("text"), "embedding")


VECTOR_LINES = f"""vl AS (SELECT (vec_id // {DOC_IDS})::BIGINT AS doc_id, CASE WHEN vec_id % 2 = 0 THEN 'from' ELSE 'to' END AS side,
  ((vec_id % {DOC_IDS}) // 2 + 1)::BIGINT AS line_id, repeat('x', (vec_id % 7 + 1)::INT) AS text, embedding::DOUBLE[] AS e FROM embeddings)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, side, line_id, text): the lines of all documents, as from-side."""
    from tandemtext.operators.lines import document_lines

    return document_lines(table(spark, sf_dir, "documents"))


LINES = """l0 AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents),
ln AS (SELECT doc_id, generate_subscripts(a, 1)::BIGINT AS line_id, unnest(a) AS text FROM l0)"""


def marked_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with marks put in by rule: every 12th a meta line of one of the twelve marks, every third of the others ends a paragraph."""
    from tandemtext.functions.text import MARKS, mark_paragraph

    n = F.col("doc_id") * 31 + F.col("line_id")
    mark = F.element_at(F.array(*map(F.lit, MARKS)), (F.floor(n / 12) % 12 + 1).cast("int"))
    text = F.when(n % 12 == 0, F.concat(F.col("text"), F.lit("%%%%%"), mark, F.lit("."))).when(n % 3 == 1, mark_paragraph(F.col("text"))).otherwise(F.col("text"))
    return lines(spark, sf_dir).withColumn("text", text)


_MARK_LIST = "['h1','h2','h3','h4','h5','divider','title','author','qtext','qname','image','translator']"
MARKED = LINES + f""",
mk AS (SELECT doc_id, line_id, CASE
  WHEN (doc_id * 31 + line_id) % 12 = 0 THEN text || '%%%%%' || ({_MARK_LIST})[((doc_id * 31 + line_id) // 12) % 12 + 1] || '.'
  WHEN (doc_id * 31 + line_id) % 3 = 1 AND regexp_matches(text, '[.!?;:。？！"'']$') THEN text[:-2] || '%%%%%' || text[-1:] ELSE text END AS text FROM ln)"""


def artifact_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines among which, by rule, page numbers, numbers, leading numbers, headings and dates are strewn."""
    n = F.col("doc_id") * 7 + F.col("line_id")
    i = F.col("line_id").cast("string")
    new = {
        0: F.concat(F.lit("-"), i, F.lit("-")), 2: i, 4: F.concat(i, F.lit(" "), F.col("text")), 6: F.lit("XIV"), 8: F.lit("x x x"), 10: F.concat(F.lit("Part "), i), 12: F.concat(i, F.lit(" teil")), 14: F.concat(F.lit("12 "), F.lit("March 1901")), 16: F.concat(F.lit("  erster band ")),
    }
    text = F.col("text")
    for k, c in new.items():
        text = F.when(n % 37 == k, c).otherwise(text)
    return lines(spark, sf_dir).withColumn("text", text)


ARTIFACTS = LINES + """,
ar AS (SELECT doc_id, line_id, CASE (doc_id * 7 + line_id) % 37 WHEN 0 THEN '-' || line_id || '-' WHEN 2 THEN line_id::VARCHAR WHEN 4 THEN line_id || ' ' || text WHEN 6 THEN 'XIV' WHEN 8 THEN 'x x x'
  WHEN 10 THEN 'Part ' || line_id WHEN 12 THEN line_id || ' teil' WHEN 14 THEN '12 March 1901' WHEN 16 THEN '  erster band ' ELSE text END AS text FROM ln)"""


def dirty_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with doubled blanks, commas and dashes and with quotes and dates put in by rule."""
    n, t = F.col("doc_id") * 5 + F.col("line_id"), F.col("text")
    text = F.when(n % 6 == 0, F.replace(t, F.lit(" "), F.lit("  "))).when(n % 6 == 1, F.replace(t, F.lit(","), F.lit(",,"))).when(n % 6 == 2, F.concat(F.lit("»"), F.replace(t, F.lit(" "), F.lit(" -- ")), F.lit("«"))).when(n % 6 == 3, F.replace(t, F.lit(". "), F.lit(". » "))).when(n % 6 == 4, F.concat(t, F.lit(" Am 12. Mai war es so. Und am 3. Juni auch."))).otherwise(t)
    return lines(spark, sf_dir).withColumn("text", text)


DIRTY = LINES + """,
di AS (SELECT doc_id, line_id, CASE (doc_id * 5 + line_id) % 6 WHEN 0 THEN replace(text, ' ', '  ') WHEN 1 THEN replace(text, ',', ',,') WHEN 2 THEN '»' || replace(text, ' ', ' -- ') || '«'
  WHEN 3 THEN replace(text, '. ', '. » ') WHEN 4 THEN text || ' Am 12. Mai war es so. Und am 3. Juni auch.' ELSE text END AS text FROM ln)"""


#: Signs that are cleaned and signs that stay, put at the end of lines by turns.
SIGNS = "「」⓪①⑩⑴⑽＂＋－／；＞＠［｀｛｠､、〃》【】〔〙〜〟〰〾〿–—‘’‛‧﹏〉'`{}<>|_=+~\\…・$&"


def signed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a sign of SIGNS at either end, by rule."""
    sign = lambda n: F.substr(F.lit(SIGNS), (n % len(SIGNS) + 1).cast("int"), F.lit(1))
    n = F.col("doc_id") * 5 + F.col("line_id")
    return lines(spark, sf_dir).withColumn("text", F.concat(sign(n), F.col("text"), sign(n + 7)))


_SIGN_TEXT = SIGNS.replace("'", "''")
SIGNED = LINES + f""",
sd AS (SELECT doc_id, line_id, ('{_SIGN_TEXT}')[(doc_id * 5 + line_id) % {len(SIGNS)} + 1] || text || ('{_SIGN_TEXT}')[(doc_id * 5 + line_id + 7) % {len(SIGNS)} + 1] AS text FROM ln)"""


def script_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose full stops are, by rule, those of Armenian or are followed by a Japanese closing quote, or come in threes."""
    n, t = F.col("doc_id") * 5 + F.col("line_id"), F.col("text")
    text = F.when(n % 5 == 0, F.replace(t, F.lit("."), F.lit("։"))).when(n % 5 == 1, F.replace(t, F.lit(". "), F.lit("。」"))).when(n % 5 == 2, F.replace(t, F.lit(","), F.lit("..."))).when(n % 5 == 3, F.replace(t, F.lit(". "), F.lit(": 」")))
    return lines(spark, sf_dir).withColumn("text", text.otherwise(t))


SCRIPT = LINES + """,
sl AS (SELECT doc_id, line_id, CASE (doc_id * 5 + line_id) % 5 WHEN 0 THEN replace(text, '.', '։') WHEN 1 THEN replace(text, '. ', '。」') WHEN 2 THEN replace(text, ',', '...')
  WHEN 3 THEN replace(text, '. ', ': 」') ELSE text END AS text FROM ln)"""


def match_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, batch_id, sub_id, from_ids, to_ids, sim): each line of a document matched to itself, but for skips, steps
    back and pairs of lines put in by rule; batches of 25 lines."""
    l, d = F.col("line_id"), F.col("doc_id")
    to = F.when((d + l) % 7 == 0, F.array(l + 2)).when((d * 3 + l) % 11 == 0, F.array(l, l + 1)).when((d + l * 5) % 23 == 0, F.array(F.greatest(l - 3, F.lit(1).cast("long")))).otherwise(F.array(l))
    return lines(spark, sf_dir).select("doc_id", F.floor((l - 1) / 25).cast("long").alias("batch_id"), ((l - 1) % 25).alias("sub_id"), F.array(l).alias("from_ids"), to.alias("to_ids"), F.lit(1.0).alias("sim"))


MATCH = LINES + """,
ma AS (SELECT doc_id, (line_id - 1) // 25 AS batch_id, (line_id - 1) % 25 AS sub_id, [line_id] AS from_ids,
  CASE WHEN (doc_id + line_id) % 7 = 0 THEN [line_id + 2] WHEN (doc_id * 3 + line_id) % 11 = 0 THEN [line_id, line_id + 1] WHEN (doc_id + line_id * 5) % 23 = 0 THEN [greatest(line_id - 3, 1)] ELSE [line_id] END AS to_ids FROM ln)"""


def both_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of both sides with a paragraph counter: the to-side is the from-side in brackets, paragraphs have four lines."""
    own = lines(spark, sf_dir).withColumn("paragraph", F.floor((F.col("line_id") - 1) / 4).cast("long"))
    return own.unionByName(own.withColumns({"side": F.lit("to"), "text": F.concat(F.lit("["), "text", F.lit("]"))}))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, pos, from_ids, to_ids, text_from, text_to): each user turn with the assistant turn after it, numbered in the conversation."""
    from pyspark.sql import Window

    c = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    own = c.select("conv_id", "turn", "role", "text", F.lead("role").over(w).alias("r2"), F.lead("text").over(w).alias("t2")).where("role = 'user' and r2 = 'assistant'")
    pos = F.row_number().over(w).cast("long")
    return own.select(F.col("conv_id").alias("doc_id"), pos.alias("pos"), F.array(pos).alias("from_ids"), F.array(pos).alias("to_ids"), F.col("text").alias("text_from"), F.col("t2").alias("text_to"))


TURNS = """c0 AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS r2, lead(text) OVER w AS t2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
tu AS (SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS pos, text AS text_from, t2 AS text_to FROM c0 WHERE role = 'user' AND r2 = 'assistant')"""
