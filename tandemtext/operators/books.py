"""Reading an alignment as text: pairs, paragraphs, several languages over a common one, and book items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandemtext.functions.intervals import within
from tandemtext.functions.text import COUNTED_MARKS, LEVELS
from tandemtext.operators import chains as C


def joined_text(ids: DataFrame, lines: DataFrame, keys: list[str], column: str = "ids", text: str = "text") -> DataFrame:
    """`keys` with the texts of their lines, in the order of the ids, joined with blanks; `lines` is (doc_id, line_id, text)."""
    rows = ids.select(*keys, F.posexplode(column).alias("__at", "line_id")).join(lines.select("doc_id", "line_id", text), ["doc_id", "line_id"])
    return rows.groupBy(*keys).agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("__at", text))), lambda x: x[text])).alias("text"))


def aligned_items(match: DataFrame, lines: DataFrame, ends: str | None = None) -> DataFrame:
    """`match` with pos, the place of each row in its document, and text_from and text_to.

    With `ends`, a side, also `ends`: the least and the greatest of a row's lines on it, as structs of line_id and paragraph, null
    where the side has neither line. Line ids tell the lines of a side apart.

    Rows, the ids they name and lines are put together by document once; what follows needs no other exchange and no join, so
    each text is shuffled once.
    """
    key = ["doc_id", "batch_id", "sub_id"]

    def named(s: str) -> Column:
        c = F.col(f"{s}_ids")
        end = (lambda x: (x == F.array_min(c)) | (x == F.array_max(c))) if s == ends else lambda x: F.lit(False)
        return F.coalesce(F.transform(c, lambda x, i: F.struct(F.lit(s).alias("side"), i.alias("at"), x.cast("long").alias("line_id"), end(x).alias("end"))), F.slice(itself, 1, 0))

    # a row stands for itself, without a side, and once for each id that it names
    itself = F.array(F.struct(F.lit(None).cast("string").alias("side"), F.lit(None).cast("int").alias("at"), F.lit(None).cast("long").alias("line_id"), F.lit(False).alias("end")))
    whole = F.struct(*[F.col(c) for c in match.columns if c not in key])
    rows = match.select(*key, whole.alias("__row"), F.explode(F.concat(itself, named("from"), named("to"))).alias("n")).select(*key, F.when(F.col("n.side").isNull(), F.col("__row")).alias("__row"), "n.*", F.lit(1).alias("__kind"))
    line = F.struct("text", F.col("paragraph").cast("long").alias("paragraph")) if ends else F.struct("text")
    own = lines.where(F.col("side").isin("from", "to") & F.col("doc_id").isNotNull() & F.col("line_id").isNotNull()).select("doc_id", "side", F.col("line_id").cast("long").alias("line_id"), line.alias("__line"), F.lit(0).alias("__kind"))
    both = rows.unionByName(own, allowMissingColumns=True).repartition("doc_id")
    at_line = Window.partitionBy("doc_id", "side", "line_id").orderBy("__kind").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("__line", F.first("__line").over(at_line)).where("__kind = 1")
    found = lambda s: F.when((F.col("side") == s) & F.col("__line").isNotNull(), F.struct("at", F.col("__line.text").alias("text")))
    agg = [F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(found(s))), lambda x: x["text"])).alias(f"text_{s}") for s in ("from", "to")]
    if ends:
        end = F.when(F.col("end") & F.col("__line").isNotNull(), F.struct("line_id", F.col("__line.paragraph").alias("paragraph")))
        agg.append(F.when(F.min(end).isNotNull(), F.struct(F.min(end).alias("first"), F.max(end).alias("last"))).alias("ends"))
    items = both.groupBy(*key).agg(F.collect_list("__row").alias("__rows"), *agg).select("*", F.explode("__rows").alias("__row"))
    out = items.withColumn("pos", F.row_number().over(Window.partitionBy("doc_id").orderBy("batch_id", "sub_id")).cast("long"))
    return out.select(*[F.col(c) if c in key else F.col(f"__row.{c}").alias(c) for c in match.columns], "pos", "text_from", "text_to", *["ends"] * bool(ends))


def aligned_pair_chains(match: DataFrame, lines: DataFrame, min_len: int = 2) -> DataFrame:
    """(doc_id, batch_id, sub_id, text_from, text_to): the pairs that lie on chains of at least `min_len`, each row once."""
    chains = C.good_chains(match, min_len).select("doc_id", F.struct("start.batch_id", "start.sub_id").alias("a"), F.struct("end.batch_id", "end.sub_id").alias("b"))
    own = within(match.withColumn("__p", F.struct("batch_id", "sub_id")), chains, ["doc_id"], "__p", "a", "b").drop("__p").where("size(from_ids) > 0 and size(to_ids) > 0")
    return aligned_items(own, lines).select("doc_id", "batch_id", "sub_id", "text_from", "text_to")


def has_empty_cells(match: DataFrame) -> DataFrame:
    """(doc_id, has_empty): whether any row has no lines on one side."""
    return match.groupBy("doc_id").agg(F.bool_or((F.size("from_ids") == 0) | (F.size("to_ids") == 0)).alias("has_empty"))


def paragraph_rows(items: DataFrame, lines: DataFrame, side: str = "from") -> DataFrame:
    """`items` with `par`, counting from 1: a new paragraph starts where a row's first line lies in another one than the last line of the row before.

    Items that were made with the `ends` of `side` are not joined with lines again."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    if "ends" in items.columns:
        own = items.where("ends is not null").withColumns({"p0": F.col("ends.first.paragraph"), "p1": F.col("ends.last.paragraph")}).drop("ends")
    else:
        ids = F.col(f"{side}_ids")
        par = lines.where(F.col("side") == side).select("doc_id", "line_id", "paragraph")
        ends = items.select("doc_id", "pos", F.explode(F.array_distinct(F.array(F.array_min(ids), F.array_max(ids)))).alias("line_id")).join(par, ["doc_id", "line_id"]).groupBy("doc_id", "pos").agg(F.min_by("paragraph", "line_id").alias("p0"), F.max_by("paragraph", "line_id").alias("p1"))
        own = items.join(ends, ["doc_id", "pos"])
    own = own.withColumn("new", F.coalesce((F.col("p0") != F.lag("p1").over(w)).cast("int"), F.lit(1)))
    return own.withColumn("par", F.sum("new").over(w).cast("long")).drop("new")


def paragraphs(items: DataFrame, lines: DataFrame, side: str = "from", amount: int = 0) -> DataFrame:
    """(doc_id, par, par_id, texts_from, texts_to, n_from, n_to): the rows of each paragraph, in order, its counter at the
    end and its numbers of sentences. `amount` keeps the first so many of each document."""
    own = paragraph_rows(items, lines, side)
    rows = F.array_sort(F.collect_list(F.struct("pos", "text_from", "text_to")))
    out = own.groupBy("doc_id", "par").agg(rows.alias("r"), F.max_by("p1", "pos").alias("par_id"), F.sum(F.size("from_ids")).alias("n_from"), F.sum(F.size("to_ids")).alias("n_to"))
    out = out.select("doc_id", "par", "par_id", F.col("r.text_from").alias("texts_from"), F.col("r.text_to").alias("texts_to"), "n_from", "n_to")
    return out.where(F.col("par") <= amount) if amount else out


def common_ends(blocks: DataFrame, keys: list[str], lang: str = "lang", end: str = "end") -> DataFrame:
    """`keys` with the block ends that all languages of a key have: the finest division that is coarser than each of theirs."""
    n = blocks.groupBy(*keys).agg(F.count_distinct(lang).alias("n"))
    ends = blocks.groupBy(*keys, end).agg(F.count_distinct(lang).alias("k"))
    return ends.join(n, keys).where("k = n").select(*keys, end)


def next_boundary(rows: DataFrame, bounds: DataFrame, keys: list[str], value: str, bound: str, out: str = "bucket") -> DataFrame:
    """`rows` with the least bound not below their value; rows beyond the last bound go. Rows and bounds are merged in order and the
    next bound is looked up in a window: no pair of row and bound is ever formed."""
    both = rows.withColumns({"__v": F.col(value), "__b": F.lit(None).cast(bounds.schema[bound].dataType), "__k": F.lit(0)})
    marks = bounds.select(*keys, F.col(bound).alias("__b")).distinct().withColumns({"__v": F.col("__b"), "__k": F.lit(1)})
    # from the end: Spark makes a frame that grows with each row in one pass, but one of all rows that follow anew for each row
    w = Window.partitionBy(*keys).orderBy(F.desc("__v"), F.desc("__k")).rowsBetween(Window.unboundedPreceding, 0)
    found = both.unionByName(marks, allowMissingColumns=True).withColumn(out, F.last("__b", ignorenulls=True).over(w))
    return found.where(F.col("__k") == 0).where(F.col(out).isNotNull()).select(*rows.columns, out)


def polybook_blocks(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, end, lang, main_ids, target_ids): each language's blocks gathered to the common blocks of the main language.

    `blocks` is (keys, lang, end, main_ids, target_ids), `end` being the last main line of a block.
    """
    own = next_boundary(blocks, common_ends(blocks, keys), keys, "end", "end", "block")
    got = own.groupBy(*keys, "block", "lang").agg(F.array_sort(F.collect_list(F.struct("end", "main_ids", "target_ids"))).alias("l"))
    return got.select(*keys, F.col("block").alias("end"), "lang", F.flatten("l.main_ids").alias("main_ids"), F.flatten("l.target_ids").alias("target_ids"))


def blocks_of(match: DataFrame, lang: Column, main: str = "from") -> DataFrame:
    """An alignment as the blocks of a polybook; rows without lines on the main side go."""
    other = "to" if main == "from" else "from"
    return match.where(F.size(f"{main}_ids") > 0).select("doc_id", lang.alias("lang"), F.array_max(f"{main}_ids").alias("end"), F.col(f"{main}_ids").alias("main_ids"), F.col(f"{other}_ids").alias("target_ids"))


def polybook_paragraphs(ends: DataFrame) -> DataFrame:
    """(doc_id, par_id): the paragraph ends that all languages share; `ends` is (doc_id, lang, par_id)."""
    return common_ends(ends.withColumnRenamed("par_id", "end"), ["doc_id"]).withColumnRenamed("end", "par_id")


_MARK_RANK = {m: i for i, m in enumerate(("title", "author", "translator", *COUNTED_MARKS))}


def mark_rank(c: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in _MARK_RANK.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, c), F.lit(len(_MARK_RANK)))


def book_items(pars: DataFrame, meta: DataFrame) -> DataFrame:
    """(doc_id, item, kind, mark, par_id, value_from, value_to): headings and paragraphs in reading order.

    A heading comes before the paragraphs that end after its place; headings of one place go by the rank of their marks. The
    n-th value of a mark on one side goes with the n-th on the other; a missing one is blank.
    """
    side = lambda s: meta.where((F.col("side") == s) & ~F.col("mark").isin("title", "author", "translator")).select("doc_id", "mark", "occurrence", F.col("val").alias(f"value_{s}"), F.col("par_id").alias(f"p_{s}"))
    heads = side("from").join(side("to"), ["doc_id", "mark", "occurrence"], "full")
    heads = heads.select("doc_id", F.lit("heading").alias("kind"), "mark", F.coalesce("p_from", "p_to").alias("par_id"), mark_rank(F.col("mark")).alias("rank"), "occurrence", *[F.coalesce(f"value_{s}", F.lit("")).alias(f"value_{s}") for s in ("from", "to")])
    body = pars.select("doc_id", F.lit("paragraph").alias("kind"), F.lit(None).cast("string").alias("mark"), "par_id", F.lit(99).alias("rank"), F.col("par").alias("occurrence"), *[F.concat_ws(" ", f"texts_{s}").alias(f"value_{s}") for s in ("from", "to")])
    w = Window.partitionBy("doc_id").orderBy("__at", "rank", "occurrence")
    both = heads.unionByName(body).withColumn("__at", F.col("par_id") + F.when(F.col("kind") == "heading", 0.5).otherwise(0.0) - F.when(F.col("kind") == "heading", 1.0).otherwise(0.0))
    return both.withColumn("item", F.row_number().over(w).cast("long")).select("doc_id", "item", "kind", "mark", "par_id", "value_from", "value_to")


def sections(items: DataFrame) -> DataFrame:
    """`items` with the section they lie in: one begins at each heading h1 to h5; what comes before the first is section 0."""
    w = Window.partitionBy("doc_id").orderBy("item").rowsBetween(Window.unboundedPreceding, 0)
    return items.withColumn("section", F.sum(F.coalesce(F.col("mark").isin(*LEVELS).cast("int"), F.lit(0))).over(w).cast("long"))


def meta_value(meta: DataFrame, mark: str, side: str, occurrence: int = 0) -> DataFrame:
    """(doc_id, val): a value of a mark, "" where a document that has any meta lacks it."""
    hit = (F.col("mark") == mark) & (F.col("side") == side) & (F.col("occurrence") == occurrence)
    return meta.groupBy("doc_id").agg(F.coalesce(F.max(F.when(hit, F.col("val"))), F.lit("")).alias("val"))


def next_heading(meta: DataFrame) -> DataFrame:
    """The first heading of each document and side: least place, then rank of its mark."""
    w = Window.partitionBy("doc_id", "side").orderBy("par_id", mark_rank(F.col("mark")), "occurrence")
    return meta.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
