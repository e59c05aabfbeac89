"""Text rules as column expressions: cleaning, sentence splitting, marks, headings and artefacts.

Regular expressions run in Java; (?U) gives \\s, \\d and \\w their Unicode meaning.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

LANGUAGES: dict[str, str] = {
    "ru": "Russian", "bu": "Belarusian", "zh": "Chinese", "de": "German", "en": "English", "fr": "French", "it": "Italian", "tr": "Turkish", "es": "Spanish", "pl": "Polish", "pt": "Portuguese",
    "hu": "Hungarian", "cz": "Czech", "jp": "Japanese", "ba": "Bashkir", "ko": "Korean", "sw": "Swedish", "nl": "Dutch", "uk": "Ukrainian", "cv": "Chuvash", "hy": "Armenian", "xx": "Unknown",
}
#: Languages that have a culture of their own in exports; all others have that of English.
CULTURES = {lang: f"{lang}-{country}" for lang, country in (("de", "DE"), ("en", "US"), ("ru", "RU"), ("zh", "CN"))}
#: What a list of contents is called; other languages have the English phrase of `contents_name`.
CONTENTS = {
    "ba": "Йөкмәткеһе", "cv": "Содержани", "cz": "Obsah", "de": "Inhalt", "en": "Contents", "es": "Tabla de contenido", "fr": "Table des matières", "hu": "Tartalom", "it": "Sommario", "jp": "目次",
    "ko": "목차", "nl": "Inhoudsopgave", "pl": "Spis treści", "pt": "Conteúdo", "ru": "Содержание", "sw": "Innehållsförteckning", "tr": "İçindekiler", "uk": "Зміст", "zh": "目录",
}

PARAGRAPH_MARK = "%%%%%"
LINE_ENDINGS = tuple(""".!?;:。？！"'""")
LEVELS = tuple(f"h{i}" for i in range(1, 6))
MARKS = (*LEVELS, "divider", "title", "author", "qtext", "qname", "image", "translator")
COUNTED_MARKS = (*LEVELS, "divider", "qtext", "qname", "image")
DELETE, SPLIT, PASS = "delete", "split", "pass"

ENDING_CLASS = r"""[.!?;:。？！"']"""
_PAR_END = rf"%%%%%({ENDING_CLASS})$"
META_END = "%%%%%(" + "|".join(MARKS) + r")\.$"
#: Signs that carry no words, by ranges of code points: ASCII brackets, quotes and list signs, circled and bracketed numbers, dashes
#: and quotes, CJK brackets and waves, full-width signs. Apostrophes and signs of code stay.
SYMBOLS = "000A 001A 0022-0026 0028-002A 002D 002F 003A 0040 005B 005D 005E 00AB 00BB 2013 2014 2018 2019 201B-201F 2022 2027 2460-2469 2474-247D 24EA 3001 3003 3009 300B-300D 3010 3011 3014-3019 301C 301F 3030 303E 303F FE4F FF02-FF0B FF0D FF0F FF1A-FF1E FF20 FF3B-FF40 FF5B-FF60 FF62-FF64"
_SYMBOLS = [chr(i) for span in SYMBOLS.split() for i in range(int(span[:4], 16), int(span[-4:], 16) + 1)]
SENTENCE_MARKS = "!?。！？."
GERMAN_MONTHS = "April|August|Dezember|Februar|J[aä]nner|Januar|Ju[ln]i|M[aä]rz|Mai|November|O[ck]tober|September"
_HIDDEN = "%@%"
#: What Unicode counts as white space, (?U)\s in a pattern.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_SPACES, _COMMAS, _DASHES = (r"(?U)\s{2,}", " "), (r",{2,}", ","), (r"[-—]{2,}", "—")
DEFAULT_RULES = (_SPACES, _COMMAS, _DASHES)
#: Signs and letters foreign to Chinese and Japanese prose, by ranges of code points: ASCII and list signs, Cyrillic, dashes and
#: quotes, CJK brackets and waves, full-width signs. Japanese also loses Latin letters and more full-width signs, Chinese corner brackets.
_FOREIGN = r"\s\x1A\x28-\x2A\x2D\x2F\x3A\x5B\x5D\u0410-\u044F\u2013\u2014\u2018\u2019\u201B-\u201F\u2022\u2027\u24EA\u2460-\u2469\u2474-\u247D\u3001\u3003\u3009\u300B\u3010\u3011\u3014-\u301C\u301F\u3030\u303E\u303F\uFE4F\uFF02-\uFF07\uFF0A\uFF0B\uFF0D\uFF0F\uFF1C-\uFF1E\uFF20\uFF3B-\uFF40\uFF5B-\uFF60\uFF62-\uFF64"
_CJK_NOISE = rf"(?U)[{_FOREIGN}\u300C\u300D]+"
_JP_NOISE = rf"(?U)[{_FOREIGN}A-Za-z\uFF08\uFF09\uFF1A\uFF1B]+"
RULES: dict[str, tuple[tuple[str, str], ...]] = {
    "ru": ((r"[/<>•'\n]+", ""), *DEFAULT_RULES),
    "de": (("[»«“„]+", '"'), (rf"(?U)(?<=\s)(\d\d?)\.(?=\s+(?:{GERMAN_MONTHS}))", f"$1{_HIDDEN}"), *DEFAULT_RULES),
    "zh": ((_CJK_NOISE, ""),),
    "jp": ((r"\.+", "。"), (_JP_NOISE, "")),
}
#: Words whose full stop ends no sentence.
ABBREVIATIONS = "Mr|Mrs|Ms|Dr|Prof|St|Jr|Sr|Sra|Mme|Nr|No|vs|etc|ca|bzw|usw"


def strip(c: Column) -> Column:
    """Without white space at either end, non-breaking spaces included."""
    return F.btrim(c, F.lit(WHITE))


def is_lang_code_valid(c: Column) -> Column:
    return F.coalesce(c.isin(*LANGUAGES), F.lit(False))


def _from_map(c: Column, values: dict[str, str], default: str) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, c), F.lit(default))


def culture(c: Column) -> Column:
    return _from_map(c, CULTURES, "en-US")


def contents_name(c: Column) -> Column:
    return _from_map(c, CONTENTS, "Table of contents")


def clean_symbols(c: Column) -> Column:
    """Without brackets, quotes and list signs; signs are looked up, see `_through`."""
    return F.translate(c, "".join(_SYMBOLS), "")


def apply_rules(c: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    for pattern, to in rules:
        c = F.regexp_replace(c, pattern, to)
    return c


def clean_line(c: Column, lang: str, clean: bool = True) -> Column:
    """The cleaning rules of a language; languages without own rules, and `clean` False, get the default ones."""
    return apply_rules(c, RULES.get(lang, DEFAULT_RULES) if clean else DEFAULT_RULES)


def _through(c: Column, marks: str) -> Column:
    """The runs of other signs, each with the one of `marks` that follows it; marks that follow none are left out.

    Every mark gets a cut after it by a search for its bytes. A class of signs beyond Latin-1 is a chain of predicates in Java, which threads
    of one executor slow down for each other; so a pattern is used only for texts that hold the sign of the cut.
    """
    cut = c
    for m in marks:
        cut = F.replace(cut, F.lit(m), F.lit(m + "\u0001"))
    parts = F.filter(F.split(cut, "\u0001"), lambda x: ~x.isin("", *marks))
    return F.when(c.contains("\u0001"), F.regexp_extract_all(c, F.lit(f"[^{marks}]+[{marks}]?"), F.lit(0))).otherwise(parts)


def split_marks(c: Column) -> Column:
    """Sentences up to and with a full stop, exclamation or question mark, as Chinese text is split."""
    return _through(c, SENTENCE_MARKS)


def _bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """`f` of `c`, which is computed once: an expression that stands in several places, or in a function of elements, is else computed at each."""
    return F.transform(F.array(c), f)[0]


def _pull_back(parts: Column, sign: str, added: str) -> Column:
    """A `sign` that opens a part closes the one before it; the first part keeps its own."""

    def pulled(own: Column) -> Column:
        nxt = lambda i: F.try_element_at(own, i + 2)
        return F.transform(own, lambda x, i: F.concat(F.when((i > 0) & x.startswith(sign), F.substr(x, F.lit(2))).otherwise(x), F.when(F.coalesce(nxt(i).startswith(sign), F.lit(False)), F.lit(added)).otherwise("")))

    return _bound(parts, pulled)


def split_jp(c: Column) -> Column:
    return _pull_back(split_marks(c), "」", "」")


def after_fr(parts: Column) -> Column:
    return _pull_back(parts, "»", " »")


def split_hy(c: Column) -> Column:
    """Armenian sentences; three or more full stops are one sign."""
    found = _through(F.regexp_replace(c, r"\.{3,}", "…"), ":։…")
    return F.filter(F.transform(found, strip), lambda x: x != "")


def after_de(parts: Column) -> Column:
    """The full stops of dates, hidden while splitting, are put back."""
    return F.transform(parts, lambda x: F.when(x.contains(_HIDDEN), F.regexp_replace(x, rf"(?U)(?<=\s)(\d\d?){_HIDDEN}(?=\s+(?:{GERMAN_MONTHS}))", "$1.")).otherwise(x))


def split_default(c: Column, before: str = "") -> Column:
    """Sentences of an alphabetic language: cut at white space after closing marks where a capital or digit follows, also after
    what the pattern `before` matches.

    Full stops of ABBREVIATIONS cut nothing. This is a rule set of its own, not that of any external segmenter.
    """
    # the full stop is looked for first: at each letter a pattern would else go through all abbreviations
    kept = F.regexp_replace(c, rf"\.(?<=\b(?:{ABBREVIATIONS})\.)\s+", ".\u0002")
    cut = F.regexp_replace(kept, rf"""([.!?…]["»”')]*)\s+({before}["«“(—-]*(?:\p{{Lu}}|[0-9]))""", "$1\u0001$2")
    return F.transform(F.split(cut, "\u0001"), lambda x: F.replace(x, F.lit("\u0002"), F.lit(" ")))


def split_french(c: Column) -> Column:
    """As `split_default`; a closing quote that stands apart opens a part, and `after_fr` gives it back to the one before."""
    return split_default(c, r"(?:»\s*)?")


def split_sentences(c: Column, lang: str, clean: bool = True) -> Column:
    """Cleaned and split by the rules of a language; a blank last sentence is dropped, null text gives null."""
    line = clean_line(c, lang, clean)
    parts = {"zh": split_marks, "jp": split_jp, "hy": split_hy, "fr": split_french}.get(lang, split_default)(line)
    parts = {"fr": after_fr, "de": after_de}.get(lang, lambda p: p)(parts)

    def ended(own: Column) -> Column:
        last = F.try_element_at(own, F.lit(-1))
        return F.when((F.size(own) > 0) & (strip(last) == ""), F.slice(own, F.lit(1), F.size(own) - 1)).otherwise(own)

    return _bound(parts, ended)


def split_paragraph_marks(c: Column) -> Column:
    """Cut after every paragraph mark and its ending sign."""
    found = F.regexp_extract_all(c, F.lit(rf"(?s).*?%%%%%{ENDING_CLASS}|.+$"), F.lit(0))
    return F.when(~c.contains(PARAGRAPH_MARK), F.filter(F.array(c), lambda x: x != "")).otherwise(found)


def mark_paragraph(c: Column) -> Column:
    """The paragraph mark before the last sign of a line that ends in one; other lines as they are."""
    s = strip(c)
    last = F.substr(s, F.lit(-1), F.lit(1))
    return F.when(last.isin(*LINE_ENDINGS), F.concat(F.substr(s, F.lit(1), F.length(s) - 1), F.lit(PARAGRAPH_MARK), last)).otherwise(c)


def ends_paragraph(c: Column) -> Column:
    return c.contains(PARAGRAPH_MARK) & c.rlike(_PAR_END)  # most lines have no mark; a search for bytes tells it


def without_paragraph_mark(c: Column) -> Column:
    """The last paragraph mark removed from lines that end a paragraph."""
    return F.when(ends_paragraph(c), F.regexp_replace(c, _PAR_END, "$1")).otherwise(c)


def meta_mark(c: Column) -> Column:
    """The mark of a meta line, or null."""
    return F.when(c.contains(PARAGRAPH_MARK) & c.rlike(META_END), F.regexp_extract(c, META_END, 1))


def meta_value(c: Column) -> Column:
    """The text of a meta line without its mark; dividers have a sign of their own."""
    mark = meta_mark(c)
    return F.when(mark == "divider", F.lit("* * *")).when(mark.isNotNull(), F.regexp_replace(c, META_END, ""))


def line_marks(c: Column) -> Column:
    """Struct of a stripped marked line: the line without its paragraph mark, whether it ends a paragraph (`next`), its mark, and the value of a meta line."""

    def marked(line: Column, mark: Column, c: Column) -> Column:
        val = F.when(mark == "divider", F.lit("* * *")).when(mark.isNotNull(), F.regexp_replace(line, META_END, ""))
        return F.struct(line.alias("line"), ends_paragraph(c).alias("next"), mark.alias("mark"), val.alias("val"))

    return _bound(c, lambda s: _bound(without_paragraph_mark(s), lambda line: _bound(meta_mark(line), lambda mark: marked(line, mark, s))))


def parsed_line(c: Column) -> Column:
    """Struct of a marked line: text, whether it ends a paragraph, its mark and the mark's first two letters."""
    line = without_paragraph_mark(c)
    mark = meta_mark(line)
    return F.struct(F.coalesce(F.when(mark.isNotNull(), F.regexp_replace(line, META_END, "")), line).alias("text"), (ends_paragraph(c) & mark.isNull()).alias("paragraph"), mark.alias("mark"), F.substr(mark, F.lit(1), F.lit(2)).alias("flag"))


_MONTH = "(?:january|february|march|april|may|june|july|august|september|october|november|december|januar|jänner|februar|märz|mai|juni|juli|oktober|dezember|janvier|février|mars|avril|juin|juillet|août|septembre|octobre|novembre|décembre|gennaio|febbraio|marzo|aprile|maggio|giugno|luglio|agosto|settembre|ottobre|dicembre|января|февраля|марта|апреля|мая|июня|июля|августа|сентября|октября|ноября|декабря)"
_DATE = rf"^(?:\d{{1,2}}\.?\s+{_MONTH}(?:,?\s+\d{{2,4}})?|{_MONTH}\s+\d{{1,2}}(?:,?\s+\d{{4}})?|{_MONTH}\s+\d{{4}}|\d{{1,2}}[./-]\d{{1,2}}[./-]\d{{2,4}}|\d{{4}}-\d{{1,2}}-\d{{1,2}}|\d{{4}}\s*年.*|(?:1[5-9]|20)\d\d)\.?$"


def is_date(c: Column) -> Column:
    """Whether a line is a date: day, month and year in usual orders, months by name in six languages, or a year."""
    return F.lower(strip(c)).rlike(_DATE)


HEADING_1 = r"(?iu)^(?:capitolo|díl|part|часть) .*$|^.* band$"
HEADING_2 = r"(?iu)^глава .*$|^.* teil$"
ROMAN = r"^M{0,4}(?:D?C{0,3}|C[DM])(?:L?X{0,3}|X[CL])(?:V?I{0,3}|I[VX])$"
ARABIC = r"^[0-9]+$"
PAGE_NUMBER = r"^-[0-9]+-$"
INLINE_NUMBER = r"^[0-9]+\s+.*$|^[0-9]+´.*$"
MISC = r"^x x x*$"
#: Lines that begin with a year up to 1999, or are one from 2000 on.
YEARS = r"^(?:1[5-9][0-9][0-9]|20[0-9][0-9]$)"

#: For each kind of heading: the mark that it gets, or DELETE or PASS.
HEADING_CONFIG = {"type_1": "h1", "type_2": "h2", "roman": "h2", "arabic": "h2", "date": "h3", "misc": "divider"}
ARTIFACT_CONFIG = {"page_num": DELETE, "inline": SPLIT, "date": PASS, "arabic": DELETE, "misc": DELETE}


def _acted(line: Column, action: str) -> Column:
    return F.lit("") if action == DELETE else line if action == PASS else F.concat(line, F.lit(f"{PARAGRAPH_MARK}{action}."))


def heading_kind(c: Column) -> Column:
    """The first rule that a stripped line meets: type_1, type_2, roman, arabic, date, misc, or null."""
    s = strip(c)
    return (
        F.when(s.rlike(HEADING_1), "type_1").when(s.rlike(HEADING_2), "type_2").when((s != "") & s.rlike(ROMAN), "roman").when(s.rlike(ARABIC), "arabic").when(s.rlike(INLINE_NUMBER) & is_date(s), "date").when(s.rlike(MISC), "misc")
    )


def marked_heading(c: Column, kind: Column, config: dict[str, str] | None = None) -> Column:
    """The stripped line `c` after all heading rules in their order, `kind` being its `heading_kind`.

    A rule sees what the one before left. Marks and deletions leave nothing that another rule fits, but for a line of type 1 that
    also begins as one of type 2: it gets both marks.
    """
    config = config or HEADING_CONFIG
    out = c
    for k, action in config.items():
        text = _acted(c, action)
        if k == "type_1" and action != DELETE:
            text = F.when(text.rlike(HEADING_2), _acted(text, config["type_2"])).otherwise(text)
        out = F.when(kind == k, text).otherwise(out)
    return out


def cleaned_artifacts(c: Column, config: dict[str, str] | None = None) -> Column:
    """Array of the lines that a line becomes: page numbers, leading numbers, bare numbers and x x x removed or split off."""
    config = config or ARTIFACT_CONFIG

    def page(s: Column) -> Column:
        return F.struct(s["num"].alias("num"), F.when(s["line"].rlike(PAGE_NUMBER), "").otherwise(s["line"]).alias("line"))

    def inline(s: Column) -> Column:
        hit = s["line"].rlike(INLINE_NUMBER) & ~s["line"].rlike(YEARS)
        if config["date"] == PASS:
            hit = hit & ~is_date(s["line"])
        if config["inline"] == DELETE:
            return F.struct(s["num"].alias("num"), F.when(hit, "").otherwise(s["line"]).alias("line"))
        return F.struct(F.when(hit, F.regexp_extract(s["line"], "[0-9]+", 0)).alias("num"), F.when(hit, F.regexp_replace(s["line"], "^[0-9]+", "")).otherwise(s["line"]).alias("line"))

    def rest(s: Column) -> Column:
        gone = F.lit(False)
        for kind, pattern in (("arabic", ARABIC), ("misc", MISC)):
            if config[kind] == DELETE:
                gone = gone | s["line"].rlike(pattern)
        return F.array(s["num"], F.when(gone, "").otherwise(strip(s["line"])))

    # one-element arrays bind what a rule left to a name, as for headings
    state = F.array(F.struct(F.lit(None).cast("string").alias("num"), strip(c).alias("line")))
    if config["page_num"] == DELETE:
        state = F.transform(state, page)
    if config["inline"] in (DELETE, SPLIT):
        state = F.transform(state, inline)
    return F.filter(F.flatten(F.transform(state, rest)), lambda x: x.isNotNull() & (x != ""))
