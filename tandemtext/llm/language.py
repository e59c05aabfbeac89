"""Language identification by cross-parsing against suffix automata of labelled text."""

from __future__ import annotations

import unicodedata
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandemtext.llm.common import chunks, packed, table, unpacked

#: Bound of the labelled sample: rows read for each language. Their texts are taken whole, in the order of their hashes, until
#: they hold REFERENCE_CHARS characters; every HELD-th is held out of the automaton.
SAMPLE_DOCS, REFERENCE_CHARS, HELD = 400, 52_000, 4
#: Phrases that a document may need beyond its language's rate before it is rejected; keeps very short texts.
SLACK = 6.0
#: Least rate of phrases per symbol at which a language rejects text, however repetitive its sample is.
LEAST_RATE = 0.2
#: Held-out texts are joined to pieces of at least so many symbols, on which the rate of phrases is measured.
PIECE = 100
#: Texts that are parsed in step; the rest of the last and longest ones is parsed one by one.
LANES = 48


class _Fold(dict):
    """Letters, vowel signs and accents are kept, those beyond ASCII folded to 95 symbols; what words with digits have becomes 0, all else a blank."""

    def __missing__(self, c: int) -> str:
        x = chr(c)
        if x.isalpha() or unicodedata.category(x)[0] == "M":
            v = x if c < 128 else chr(161 + (c * 0x9E3779B1 >> 7) % 95)
        else:
            v = "0" if x.isalnum() or x == "_" else " "
        self[c] = v
        return v


_fold = _Fold()


def encode(text: str) -> bytes:
    """The characters the automata are read with: the lower-case words, a blank between them, letters beyond ASCII folded to 95 symbols.

    Punctuation, numbers and words with a digit belong to no language and are left out. Vowel signs and accents belong to their word.
    """
    words = text.lower().translate(_fold).split()
    return " ".join([w for w in words if "0" not in w]).encode("latin-1")


def suffix_automaton(data: bytes) -> tuple[array, bytes, int]:
    """The automaton of all substrings of `data` as (table, symbols, width): table[state + symbol] is the next state or -1.

    States are multiples of the width; symbols maps each byte to its column, unseen bytes to column 0, which has no moves.
    """
    nxt: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in data:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    used = sorted(set(data))
    symbols = bytearray(256)
    for i, c in enumerate(used):
        symbols[c] = i + 1
    width = len(used) + 1
    flat = np.full(len(nxt) * width, -1, np.int32)
    for s, moves in enumerate(nxt):
        for c, t in moves.items():
            flat[s * width + symbols[c]] = t * width
    return array("i", flat.tobytes()), bytes(symbols), width


def phrases(automaton: tuple[array, bytes, int], data: bytes, stop: int = 1 << 60) -> int:
    """Greedy cross-parse: how many longest matches cover `data`; gives up (with a count above `stop`) once it needs more."""
    table_, symbols, _ = automaton
    n, cur = 0, 0
    for c in data.translate(symbols):
        t = table_[cur + c]
        if t < 0:
            if cur:
                n += 1
            t = table_[c]
            if t < 0:  # a symbol that the language never shows is a phrase by itself
                n += 1
                t = 0
            if n > stop:
                return n
        cur = t
    return n + 1 if cur else n


def classify(model: dict, data: bytes) -> tuple[str | None, int]:
    """(language, phrases) of the language that needs fewest phrases; ties go to the first name. None for no words."""
    if not data:
        return None, 0
    langs = model["automata"]
    head = data[:160]
    order = sorted(langs, key=lambda k: (phrases(langs[k], head), k))  # only the order of trying depends on the head
    best, least = None, 1 << 60
    for k in order:
        n = phrases(langs[k], data, least)
        if n < least or n == least and k < best:
            best, least = k, n
    return best, least


_parsers: dict[str, Parser] = {}


def _parser(model: dict) -> Parser:
    """The parser of a model, made once in a worker; a model is known by its id."""
    if model["id"] not in _parsers:
        _parsers.clear()
        _parsers[model["id"]] = Parser(model["automata"])
    return _parsers[model["id"]]


def accepted(model: dict, lang: str | None, n: int, chars: int) -> bool:
    return lang is not None and n <= model["rates"][lang] * chars + SLACK


class Parser:
    """All automata of a model as one table over common symbols: many texts are parsed in step, against all languages at once."""

    def __init__(self, automata: dict[str, tuple[array, bytes, int]]) -> None:
        self.automata, self.names = automata, sorted(automata)
        seen = sorted({c for k in self.names for c, x in enumerate(automata[k][1]) if x})
        self.symbols = bytearray(256)
        for i, c in enumerate(seen):
            self.symbols[c] = i + 1
        width, tables, roots, base = len(seen) + 1, [], [], 0
        for k in self.names:
            flat, symbols, own = automata[k]
            t = np.frombuffer(flat, np.int32).reshape(-1, own)
            out = np.full((len(t), width), -1, np.int64)
            for i, c in enumerate(seen):
                if symbols[c]:
                    to = t[:, symbols[c]].astype(np.int64)
                    out[:, i + 1] = np.where(to < 0, -1, base + to // own * width)
            tables.append(out.ravel())
            roots.append(base)
            base += out.size
        if base > 2**31:
            raise ValueError("the automata are too large")
        self.table = np.concatenate(tables).astype(np.int32)
        self.roots = np.array(roots, np.int32)
        first = self.table[self.roots[None, :] + np.arange(width, dtype=np.int32)[:, None]]
        #: For each symbol and language the state after it from the root, and whether it is none of the language's.
        self.first, self.miss = np.where(first < 0, self.roots, first).astype(np.int32), first < 0

    def counts(self, texts: list[bytes]) -> np.ndarray:
        """The phrases that each text needs in each language, languages by name."""
        n = np.zeros((len(texts), len(self.names)), np.int64)
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        own = [texts[i].translate(bytes(self.symbols)) for i in order]
        sizes = np.array([len(t) for t in own])
        steps = int(sizes[LANES - 1]) if len(own) >= LANES else 0
        lanes = int((sizes > 0).sum())
        got = np.zeros((len(own), len(self.names)), np.int64)
        state = np.tile(self.roots, (len(own), 1))
        if steps:
            grid = np.zeros((lanes, steps), np.uint8)
            for i in range(lanes):
                part = own[i][:steps]
                grid[i, : len(part)] = np.frombuffer(part, np.uint8)
            grid = np.ascontiguousarray(grid.T)
            active = np.searchsorted(-sizes, -np.arange(1, steps + 1), "right")  # texts that have a symbol at each step
            for at, k in enumerate(active.tolist()):
                c, was = grid[at, :k], state[:k]
                to = self.table[was + c[:, None]]
                failed = to < 0
                got[:k] += failed & (was != self.roots)
                got[:k] += failed & self.miss[c]
                state[:k] = np.where(failed, self.first[c], to)
        for i in range(min(len(own), LANES)):
            if sizes[i] > steps:
                for x, k in enumerate(self.names):
                    got[i, x], state[i, x] = self._go_on(own[i][steps:], int(state[i, x]), int(got[i, x]), x)
        got += state != self.roots
        n[order] = got
        return n

    def _go_on(self, data: bytes, cur: int, n: int, x: int) -> tuple[int, int]:
        table_, root = self.table, int(self.roots[x])
        flat = memoryview(table_)
        first, miss = self.first[:, x].tolist(), self.miss[:, x].tolist()
        for c in data:
            t = flat[cur + c]
            if t < 0:
                n += (cur != root) + miss[c]
                t = first[c]
            cur = t
        return n, cur

    def best(self, texts: list[bytes]) -> list[tuple[str | None, int]]:
        """What `classify` gives for each text; equal texts are parsed once."""
        different = [t for t in dict.fromkeys(texts) if t]
        counts = self.counts(different) if different else np.zeros((0, 1), np.int64)
        lang = counts.argmin(axis=1)
        found = {t: (self.names[k], int(n[k])) for t, k, n in zip(different, lang.tolist(), counts, strict=True)}
        return [found.get(t, (None, 0)) for t in texts]


def train(spark: SparkSession, docs: DataFrame, per_lang: int = SAMPLE_DOCS, chars: int = REFERENCE_CHARS) -> dict:
    """Automata of a bounded sample of labelled rows: of each `lang` the `per_lang` with the least hash of their text.

    The texts of the sample are taken whole, short ones as well as long ones, until they hold `chars` characters. Three
    quarters of them make the automaton; the others are held out for the rejection rate: halfway, geometrically, between
    what own and foreign held-out text needs. So a language whose labelled texts are all short has an automaton as all others.
    Equal texts count once. Rows without label or without a letter are no examples. Without any labelled text there are no
    languages and all is rejected.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select(F.col("lang").cast("string").alias("lang"), "text", F.xxhash64("text").alias("h"))
    # hashes and lengths first, so that no more texts come to the driver than are used
    w = Window.partitionBy("lang").orderBy("h")
    few = labelled.select("lang", "h", F.length("text").alias("n")).withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_lang)
    sizes: dict[str, dict[int, int]] = {}
    for r in sorted(few.collect(), key=lambda r: (r["lang"], r["h"])):
        sizes.setdefault(r["lang"], {})[r["h"]] = r["n"]
    wanted = []
    for own in sizes.values():
        total = 0
        for h, n in own.items():
            wanted.append(h)
            total += n
            if total >= chars:
                break
    if not wanted:
        return {"automata": {}, "rates": {}}
    texts: dict[str, list[str]] = {}
    rows = labelled.where(F.col("h").isin(wanted)).select("lang", "h", "text").distinct().collect()
    for r in sorted(rows, key=lambda r: (r["lang"], r["h"], r["text"])):
        if r["h"] in sizes[r["lang"]]:
            texts.setdefault(r["lang"], []).append(r["text"])
    return fit(texts)


def pieces(texts: list[bytes]) -> list[bytes]:
    """The texts joined, in order, to pieces of at least PIECE symbols; what is left at the end joins the last piece."""
    out: list[bytes] = []
    held = b""
    for t in texts:
        held = held + b" " + t if held else t
        if len(held) >= PIECE:
            out.append(held)
            held = b""
    return [*out[:-1], out[-1] + b" " + held] if held and out else [held] if held else out


def fit(texts: dict[str, list[str]]) -> dict:
    automata, held = {}, {}
    for k, own in sorted(texts.items()):
        codes = [encode(t) for t in own]
        held[k] = pieces(codes[::HELD]) if len(codes) > 1 else []
        automata[k] = suffix_automaton(b" ".join([c for i, c in enumerate(codes) if i % HELD or len(codes) == 1]))
    rates = {}
    for k in automata:
        own = [phrases(automata[k], d) / len(d) for d in held[k]]
        foreign = [phrases(automata[k], d) / len(d) for j in held if j != k for d in held[j]]
        if own and foreign:
            rates[k] = max(LEAST_RATE, float(np.sqrt(np.quantile(own, 0.9) * np.quantile(foreign, 0.5))))
        else:
            rates[k] = max(LEAST_RATE, float(2.0 * max(own, default=0.25)))
    return {"automata": automata, "rates": rates, "id": uuid.uuid4().hex}


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """Adds __lang (language or null), __phrases, __chars and __accepted to each row of `docs`; whole texts are parsed.

    Null and empty texts and those without a word have no language and are rejected. A text that needs at most SLACK phrases is
    accepted whatever it says, so junk of one or two words passes: so little text is no evidence against a language.
    Equal counts go to the alphabetically first language. Very long texts are parsed whole as all others. Repeated rows
    get equal results; other columns are left alone. Empty input: no rows.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    fields = docs.schema.names
    added = [T.StructField("__lang", T.StringType()), T.StructField("__phrases", T.LongType()), T.StructField("__chars", T.LongType()), T.StructField("__accepted", T.BooleanType())]
    schema = T.StructType([*docs.schema.fields, *added])
    at = fields.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        parser = _parser(m) if m["automata"] else None
        for whole in batches:
            for b in chunks(whole, at):
                langs, counts, sizes, ok = [], [], [], []
                codes = [encode(t) if t else b"" for t in b.column(at).to_pylist()]
                for data, (lang, n) in zip(codes, parser.best(codes) if parser else [(None, 0)] * len(codes), strict=True):
                    langs.append(lang)
                    counts.append(n)
                    sizes.append(len(data))
                    ok.append(accepted(m, lang, n, len(data)))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ok, pa.bool_())], names=[*fields, "__lang", "__phrases", "__chars", "__accepted"])

    return docs.mapInArrow(run, schema)


def keep_known_languages(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """The documents that are text of some known language, all columns kept, `lang` set to the language found."""
    model = train(docs.sparkSession, labelled if labelled is not None else docs)
    used = ("text", "lang") if "lang" in docs.columns else ("text",)
    found = identify(packed(docs, used), model).where("__accepted")
    return unpacked(found.withColumn("lang", F.col("__lang")), docs.columns, used)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that is accepted as text of a known language, with that language and its phrases per character."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), train(spark, docs)).where("__accepted")
    return found.select("doc_id", F.col("__lang").alias("language"), F.col("__phrases").alias("n_phrases"), F.col("__chars").alias("n_symbols"), F.round(F.col("__phrases") / F.col("__chars"), 6).alias("phrase_rate"))

