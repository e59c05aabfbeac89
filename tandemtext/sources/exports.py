"""What alignments are written as: text, TMX, JSON, XML and HTML. Rows become strings in Spark; a sink only writes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandemtext.functions.text import contents_name, culture


def xml_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def tmx_units(items: DataFrame, lang_from: str, lang_to: str) -> DataFrame:
    """(doc_id, pos, value): a translation unit for each item, its texts escaped."""

    def variant(lang: str, text: str) -> list[Column]:
        return [F.lit('<tuv xml:lang="'), culture(F.lit(lang)), F.lit('"><seg>'), xml_escape(F.col(text)), F.lit("</seg></tuv>")]

    return items.select("doc_id", "pos", F.concat(F.lit("<tu>"), *variant(lang_from, "text_from"), *variant(lang_to, "text_to"), F.lit("</tu>")).alias("value"))


def wrapped(rows: DataFrame, head: Column, foot: Column, keys: tuple[str, ...] = ("doc_id",), order: str = "pos") -> DataFrame:
    """(keys, value): the values of each document in order, a line each, between a head and a foot. One document is one row."""
    body = F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct(order, "value"))), lambda x: x["value"]))
    return rows.groupBy(*keys).agg(body.alias("body")).select(*keys, F.concat_ws("\n", head, "body", foot).alias("value"))


def tmx_documents(items: DataFrame, lang_from: str, lang_to: str) -> DataFrame:
    head = F.concat(F.lit("<?xml version='1.0' encoding='UTF-8'?>\n<tmx version='1.4'>\n<header srclang=\""), culture(F.lit(lang_from)), F.lit('" datatype="plaintext" segtype="sentence"/>\n<body>'))
    return wrapped(tmx_units(items, lang_from, lang_to), head, F.lit("</body>\n</tmx>"))


def plain_text(items: DataFrame, side: str, batch_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, pos, value): the texts of one side, of some batches or of all."""
    own = items.where(F.col("batch_id").isin(*batch_ids)) if batch_ids else items
    return own.select("doc_id", "pos", F.col(f"text_{side}").alias("value"))


def paragraph_text(pars: DataFrame, side: str) -> DataFrame:
    """(doc_id, pos, value): a line for each paragraph."""
    return pars.select("doc_id", F.col("par").alias("pos"), F.concat_ws(" ", f"texts_{side}").alias("value"))


def json_items(items: DataFrame) -> DataFrame:
    """(doc_id, item, value): each book item as JSON: t its kind, c its mark, p its texts."""
    body = F.to_json(F.struct(F.when(F.col("kind") == "heading", "h").otherwise("p").alias("t"), F.col("mark").alias("c"), F.array("value_from", "value_to").alias("p")))
    return items.select("doc_id", "item", body.alias("value"))


def json_books(items: DataFrame, head: DataFrame) -> DataFrame:
    """(doc_id, value): one JSON text a document: head (its title, author and languages) and body. Encoded once."""
    body = items.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("item", F.when(F.col("kind") == "heading", "h").otherwise("p").alias("t"), F.col("mark").alias("c"), F.array("value_from", "value_to").alias("p")))), lambda x: F.struct(x["t"].alias("t"), x["c"].alias("c"), x["p"].alias("p"))).alias("body"))
    own = body.join(head, "doc_id", "left")
    return own.select("doc_id", F.to_json(F.struct(F.struct(*[F.col(c) for c in head.columns if c != "doc_id"]).alias("head"), "body")).alias("value"))


def xml_paragraphs(pars: DataFrame) -> DataFrame:
    """(doc_id, pos, value): each paragraph as XML, a sentence element for each row with a unit for either language; sentences count on through the document."""
    w = Window.partitionBy("doc_id").orderBy("par").rowsBetween(Window.unboundedPreceding, -1)
    own = pars.withColumn("before", F.coalesce(F.sum(F.size("texts_from")).over(w), F.lit(0)))
    unit = lambda lang, t: F.concat(F.lit(f'<su lang="{lang}">'), xml_escape(t), F.lit("</su>"))
    sent = F.transform(F.arrays_zip("texts_from", "texts_to"), lambda x, i: F.concat(F.lit('<sentence id="'), (F.col("before") + i + 1).cast("string"), F.lit('">'), unit("from", x["texts_from"]), unit("to", x["texts_to"]), F.lit("</sentence>")))
    return own.select("doc_id", F.col("par").alias("pos"), F.concat(F.lit('<p id="'), F.col("par").cast("string"), F.lit('">'), F.concat_ws("", sent), F.lit("</p>")).alias("value"))


def xml_books(pars: DataFrame, title: Column) -> DataFrame:
    head = F.concat(F.lit("<book><head><title>"), xml_escape(title), F.lit("</title></head><body>"))
    return wrapped(xml_paragraphs(pars), head, F.lit("</body></book>"))


def xml_sections(items_with_section: DataFrame) -> DataFrame:
    """(doc_id, section, value): each section as XML, headings first; sections that hold no paragraph are left out."""
    has = Window.partitionBy("doc_id", "section")
    own = items_with_section.withColumn("full", F.max((F.col("kind") == "paragraph").cast("int")).over(has)).where(F.col("full") == 1)
    tag = F.coalesce("mark", F.lit("p"))
    cell = lambda s: F.concat(F.lit(f'<su lang="{s}">'), xml_escape(F.col(f"value_{s}")), F.lit("</su>"))
    rows = own.select("doc_id", "section", "item", F.concat(F.lit("<"), tag, F.lit(">"), cell("from"), cell("to"), F.lit("</"), tag, F.lit(">")).alias("value"))
    return wrapped(rows, F.lit("<section>"), F.lit("</section>"), ("doc_id", "section"), "item")


def css(styles: list[dict[str, str]], columns: int = 2) -> str:
    """Rules for the columns of a book: their width, and a background for each given style."""
    rules = [f".col {{ width: {100 // columns}%; }}"]
    rules += [f".s{i} {{ {'; '.join(f'{k}: {v}' for k, v in sorted(s.items()))}; }}" for i, s in enumerate(styles)]
    return "\n".join(rules)


def html_rows(items: DataFrame, styles: int = 1) -> DataFrame:
    """(doc_id, pos, value): each book item as a table row with a cell for either language; styles take turns."""
    tag = F.when(F.col("kind") == "heading", "h2").otherwise("p")
    cell = lambda s: F.concat(F.lit('<td class="col"><'), tag, F.lit(' class="s'), (F.col("item") % max(1, styles)).cast("string"), F.lit('">'), xml_escape(F.col(f"value_{s}")), F.lit("</"), tag, F.lit("></td>"))
    return items.select("doc_id", F.col("item").alias("pos"), F.concat(F.lit("<tr>"), cell("from"), cell("to"), F.lit("</tr>")).alias("value"))


def html_books(items: DataFrame, lang: str, styles: list[dict[str, str]] | None = None, amount: int = 0) -> DataFrame:
    """(doc_id, value): a two-column page for each document; `amount` keeps the first so many items for a preview."""
    own = items.where(F.col("item") <= amount) if amount else items
    head = F.concat(F.lit(f'<!doctype html><html lang="{lang}"><meta charset=utf-8><style>\n{css(styles or [])}\n</style><h1>'), contents_name(F.lit(lang)), F.lit("</h1><table>"))
    return wrapped(html_rows(own, len(styles or [1])), head, F.lit("</table></html>"))


def polybook_html(blocks: DataFrame, langs: list[str], keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, value): a page with a column for each language; `blocks` is (keys, end, lang, text)."""
    cells = F.map_from_entries(F.collect_list(F.struct("lang", "text")))
    row = F.concat(F.lit("<tr>"), *[F.concat(F.lit('<td class="col">'), xml_escape(F.coalesce(F.try_element_at("m", F.lit(c)), F.lit(""))), F.lit("</td>")) for c in langs], F.lit("</tr>"))
    rows = blocks.groupBy(*keys, "end").agg(cells.alias("m")).select(*keys, F.col("end").alias("pos"), row.alias("value"))
    return wrapped(rows, F.lit(f"<html><style>\n{css([], len(langs))}\n</style><table>"), F.lit("</table></html>"), keys)


def write_lines(rows: DataFrame, path: str, order: tuple[str, ...] = ("doc_id", "pos")) -> None:
    """Writes values as text files, a folder for each document, lines in order within it."""
    own = rows.repartition("doc_id").sortWithinPartitions(*order)
    own.select("doc_id", "value").write.mode("overwrite").partitionBy("doc_id").text(path)
