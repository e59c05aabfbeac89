"""Documents as line tables: reading order, sentence splitting over runs of lines, headings, marks, meta and segments.

A line table has (doc_id, side, line_id, text); line ids count from 1 within a document's side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandemtext.functions import text as X

KEY = ["doc_id", "side"]


def _order(*extra: str) -> Window:
    return Window.partitionBy(*KEY).orderBy("line_id", *extra)


def document_lines(docs: DataFrame, side: str = "from", text: str = "text") -> DataFrame:
    """The lines of each document's text, numbered from 1. Null texts have none."""
    out = docs.where(F.col(text).isNotNull()).select("doc_id", F.lit(side).alias("side"), F.posexplode(F.split(text, "\n")).alias("p", "text"))
    return out.select("doc_id", "side", (F.col("p") + 1).cast("long").alias("line_id"), "text")


def _explode_parts(df: DataFrame, parts: Column, order: list[str]) -> DataFrame:
    """One row for each element of `parts`, numbered anew within the document's side."""
    rows = df.select(*KEY, *order, F.posexplode(parts).alias("part", "text"))
    w = Window.partitionBy(*KEY).orderBy(*order, "part")
    return rows.select(*KEY, F.row_number().over(w).cast("long").alias("line_id"), "text")


def split_lines(lines: DataFrame, lang: str, clean: bool = True) -> DataFrame:
    """Lines split to sentences. Runs of lines without a meta mark are joined with blanks and split together, then
    cut at paragraph marks; lines with a meta mark stay whole; blank lines go."""
    own = lines.where(X.strip(F.col("text")) != "").withColumn("m", F.col("text").rlike("%%%%%(" + "|".join(X.MARKS) + ")").cast("int"))
    own = own.withColumn("run", F.sum("m").over(_order().rowsBetween(Window.unboundedPreceding, 0)) * 2 - F.col("m"))
    runs = own.groupBy(*KEY, "run").agg(F.max("m").alias("m"), F.array_sort(F.collect_list(F.struct("line_id", "text"))).alias("l"))
    joined = F.concat_ws(" ", F.col("l.text"))
    parts = F.flatten(F.transform(X.split_sentences(joined, lang, clean), X.split_paragraph_marks))
    return _explode_parts(runs, F.when(F.col("m") == 1, F.col("l.text")).otherwise(parts), ["run"])


def clean_artifacts(lines: DataFrame, config: dict[str, str] | None = None) -> DataFrame:
    """Lines without artefacts, numbered anew."""
    return _explode_parts(lines, X.cleaned_artifacts(F.col("text"), config), ["line_id"])


def find_artifacts(lines: DataFrame) -> DataFrame:
    """The lines that the artefact rules would touch, with the rule."""
    s = X.strip(F.col("text"))
    kind = F.when(s.rlike(X.PAGE_NUMBER), "page_num").when(s.rlike(X.INLINE_NUMBER) & ~s.rlike(X.YEARS), "inline").when(s.rlike(X.ARABIC), "arabic").when(s.rlike(X.MISC), "misc")
    return lines.withColumn("kind", kind).where("kind is not null")


def find_headings(lines: DataFrame) -> DataFrame:
    """The lines that the heading rules would touch, with the first rule that fits."""
    return lines.withColumn("kind", X.heading_kind(F.col("text"))).where("kind is not null")


def mark_headings(lines: DataFrame, config: dict[str, str] | None = None) -> DataFrame:
    """Headings get their marks, and the line before a heading a full stop if it has no ending. Emptied lines go."""
    config = config or X.HEADING_CONFIG
    own = lines.withColumn("text", X.strip(F.col("text"))).withColumn("kind", X.heading_kind(F.col("text")))
    # what empties a line is told without making the marked text, so that the filter costs no second pass over the rules
    emptied = [k for k, action in config.items() if action == X.DELETE]
    left = (F.col("text") != "") & (~F.coalesce(F.col("kind").isin(emptied), F.lit(False)) if emptied else F.lit(True))
    own = own.where(left).withColumn("next", F.lead("kind").over(_order()))
    text = X.marked_heading(F.col("text"), F.col("kind"), config)
    return own.select(*KEY, "line_id", text.alias("text"), "next").select(*KEY, "line_id", F.when(F.col("next").isNotNull() & ~F.col("text").rlike(X.ENDING_CLASS + "$"), F.concat("text", F.lit("."))).otherwise(F.col("text")).alias("text"))


def _flagged(lines: DataFrame) -> DataFrame:
    # one expression, computed once a line; the values are made here, so that meta lines need not carry the texts of all others
    own = lines.select(*KEY, "line_id", X.line_marks(X.strip(F.col("text"))).alias("m")).select(*KEY, "line_id", "m.line", "m.next", "m.mark", "m.val")
    ends = (F.col("mark").isNotNull() | F.col("next")).cast("int")
    before = _order().rowsBetween(Window.unboundedPreceding, -1)
    here = _order().rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumn("paragraph", F.coalesce(F.sum(ends).over(before), F.lit(0)).cast("long"))
    return own.withColumns({m: F.sum(F.coalesce((F.col("mark") == m).cast("int"), F.lit(0))).over(here).cast("long") for m in (*X.LEVELS, "divider")})


def handle_marks(lines: DataFrame) -> DataFrame:
    """Text lines without their marks, with the paragraph they lie in and the headings and dividers counted up to them.

    The paragraph counter moves on after a line that ends a paragraph and after every meta line.
    """
    own = _flagged(lines).where("mark is null")
    new_id = F.row_number().over(_order()).cast("long")
    return own.select(*KEY, new_id.alias("line_id"), F.col("line").alias("text"), "paragraph", *X.LEVELS, "divider")


def meta_lines(lines: DataFrame) -> DataFrame:
    """Meta values with their mark, occurrence (from 0 within a mark) and the paragraph counter they were met at. Empty values go."""
    own = _flagged(lines).where("mark is not null and val != ''")
    w = Window.partitionBy(*KEY, "mark").orderBy("line_id")
    return own.select(*KEY, "mark", "val", (F.row_number().over(w) - 1).cast("long").alias("occurrence"), F.col("paragraph").alias("par_id"))


def segments(meta: DataFrame, counts: DataFrame, marks: tuple[str, ...] = ("h2",)) -> DataFrame:
    """(doc_id, segment, par_start, par_end for either side): the paragraph ranges (start, end] between chosen marks.

    The last range of a side ends at its number of lines, `counts` being (doc_id, side, n). Both sides need as many marks;
    documents where they differ are left out, see `unequal_segments`. Text before the first mark belongs to no segment.
    """
    cut = meta.where(F.col("mark").isin(*marks)).select(*KEY, "par_id").distinct()
    w = Window.partitionBy(*KEY).orderBy("par_id")
    own = cut.join(counts, KEY).select(*KEY, F.row_number().over(w).cast("long").alias("segment"), F.col("par_id").alias("par_start"), F.coalesce(F.lead("par_id").over(w), F.col("n")).cast("long").alias("par_end"))
    own = own.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy(*KEY)))
    side = lambda s: own.where(F.col("side") == s).select("doc_id", "segment", "k", *[F.col(c).alias(f"{c}_{s}") for c in ("par_start", "par_end")])
    return side("from").join(side("to"), ["doc_id", "segment", "k"]).drop("k")


def unequal_segments(meta: DataFrame, marks: tuple[str, ...] = ("h2",)) -> DataFrame:
    """The documents whose sides differ in the number of cut points, with both numbers."""
    cut = meta.where(F.col("mark").isin(*marks)).select(*KEY, "par_id").distinct()
    n = cut.groupBy("doc_id").agg(F.count_if(F.col("side") == "from").alias("n_from"), F.count_if(F.col("side") == "to").alias("n_to"))
    return n.where("n_from != n_to")


def paragraph_range(lines: DataFrame, start: int, end: int, column: str = "text") -> DataFrame:
    """The lines of the paragraphs in (start, end], for texts and proxy texts alike."""
    return lines.where((F.col("paragraph") > start) & (F.col("paragraph") <= end)).select(*KEY, "line_id", column)


def with_proxy(lines: DataFrame, proxy: DataFrame) -> DataFrame:
    """`lines` with a proxy_text column from another line table; only sides of equally many lines take theirs."""
    n = lambda df, name: df.groupBy(*KEY).agg(F.count(F.lit(1)).alias(name))
    fit = n(lines, "n").join(n(proxy, "m"), KEY).where("n = m").select(*KEY)
    own = proxy.join(fit, KEY, "left_semi").select(*KEY, "line_id", F.col("text").alias("proxy_text"))
    return lines.join(own, [*KEY, "line_id"], "left")
