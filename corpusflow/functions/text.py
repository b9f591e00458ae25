"""Scalar text functions: Column to Column, all inside generated code."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon

EMAIL = lexicon.EMAIL


def normalize(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+")).cast("long")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), which is worked out once however often it is used: each of many alternatives would work it out anew."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def once(value: Column) -> Column:
    """value for each row, as a generator's column: a condition on it, or several uses, would have it worked out again each time."""
    return F.explode(F.array(value))


def lexical(text: Column) -> Column:
    """The form that BM25 indexes: lower case, no quotes, punctuation as spaces."""
    return F.trim(F.regexp_replace(_plain(text), r"\s+", " "))


def _plain(text: Column) -> Column:
    """One pass: characters of the second list without one in the third are left out."""
    return F.translate(F.lower(F.coalesce(text, F.lit(""))), lexicon.PUNCTUATION + lexicon.QUOTES, " " * len(lexicon.PUNCTUATION))


def tokens(text: Column) -> Column:
    return F.filter(F.split(_plain(text), r"\s+"), lambda w: w != "")


#: What tokens() makes of each byte (0 keeps it, 1 ends a word, 2 leaves it out), and of characters of several bytes, by the first one.
BYTES, LONGER = np.zeros(256, np.uint8), {}
for _kind, _chars in ((2, lexicon.QUOTES), (1, lexicon.PUNCTUATION + " \t\n\x0b\f\r")):
    for _c in map(str.encode, _chars):
        if len(_c) == 1:
            BYTES[_c[0]] = _kind
        else:
            LONGER.setdefault(_c[0], {})[_c] = _kind


def lowered(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def token_lists(low: pa.Array) -> pa.Array:
    """tokens() of many texts that are in lower case (see lowered), as an array of lists: words are found in the bytes of all texts at once."""
    low = low.cast(pa.string())
    _, ends, data = low.buffers()
    at = np.frombuffer(ends, np.int32)[low.offset : low.offset + len(low) + 1] if len(low) else np.zeros(1, np.int32)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    at = at - at[0]
    kind = BYTES[raw]
    for lead, chars in LONGER.items():
        places = np.flatnonzero(raw == lead)
        for char, k in chars.items():
            hit = places
            for i in range(1, len(char)):
                hit = hit[raw[hit + i] == char[i]]
            for i in range(len(char)):
                kind[hit + i] = k
    kept = np.flatnonzero(kind == 0)
    ended = kind == 1
    ended[at[:-1][at[:-1] < len(raw)]] = True  # no word goes on in the next text
    first = np.flatnonzero(np.diff(np.cumsum(ended, dtype=np.int32)[kept], prepend=-1))
    row = np.searchsorted(at, kept[first], side="right") - 1
    words = pa.StringArray.from_buffers(len(first), pa.py_buffer(np.append(first, len(kept)).astype(np.int32)), pa.py_buffer(raw[kept]))
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(low))))), pa.int32()), words)


def keywords(text: Column, stop: list[str] = lexicon.STOP_WORDS, longer: int = 3) -> Column:
    return F.array_distinct(F.filter(tokens(text), lambda w: (F.length(w) > longer) & ~w.isin(stop)))


#: The passes of cleaning, in order: control characters, blank lines, spaces, page numbers, page marks, rules, tabs.
CLEANING = [
    (r"[\x00-\x08\x0b\x0c\x0e-\x1f]", ""),
    (r"\n\s*\n\s*\n+", "\n\n"),
    (r" {3,}", " "),
    (r"(?m)^\s*\d{1,3}\s*$", ""),
    (r"(?mi)^\s*PAG\.?\s*$", ""),
    (r"(?m)^[\s_\-=]{5,}$", ""),
    (r"\t{2,}", " "),
]


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def clean(text: Column) -> Column:
    """The passes of CLEANING, then without white space at the ends."""
    return strip(reduce(lambda t, step: F.regexp_replace(t, *step), CLEANING, text))


def trim_to_sentence(text: Column) -> Column:
    """Cuts after the last sentence end if that keeps more than half."""
    head = F.regexp_extract(text, r"(?s)^(.*(?:[.?!] |[.:]\n))", 1)
    last = F.length(head) - 2
    return F.when(F.rtrim(text).rlike(r"[.?!:]$"), text).when(last > F.length(text) * 0.5, F.substring(text, F.lit(1), last + 1)).otherwise(text)


def web_clean(text: Column) -> Column:
    """Without rules, runs of spaces and of blank lines, lines of one or two characters."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?m)^\s*[-*_]{3,}\s*$", "")
    plain = F.regexp_replace(F.regexp_replace(plain, r"[ \t]{2,}", " "), r"\n{3,}", "\n\n")
    lines = F.filter(F.split(plain, "\n"), lambda x: (F.length(strip(x)) > 2) | (strip(x) == ""))
    return strip(F.array_join(lines, "\n"))


def markdown_clean(text: Column) -> Column:
    """Without images, links as their words, blank lines collapsed."""
    plain = F.regexp_replace(F.regexp_replace(text, r"!\[.*?\]\(.*?\)", ""), r"\[(.*?)\]\(.*?\)", "$1")
    return strip(F.regexp_replace(plain, r"\n{3,}", "\n\n"))


def emails(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0)))


def urls(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(lexicon.LINK), F.lit(0)))


def link(url: Column, kind: str, description: Column) -> Column:
    return F.struct(url.alias("url"), F.lit(kind).alias("type"), description.alias("description"))


def links(text: Column) -> Column:
    """Structs of url, type and description: every url, then every address, as they occur."""
    of = lambda pattern, kind: F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda u: link(u, kind, F.lit("")))
    return F.concat(of(lexicon.LINK, "url"), of(lexicon.EMAIL, "email"))


def with_source(found: Column, url: Column, name: Column) -> Column:
    """Links with that of the source page before them, if it is known and not among them."""
    own = F.array(link(url, "url", F.concat(F.lit("Pagina web sorgente: "), F.coalesce(name, url))))
    return F.when((F.coalesce(url, F.lit("")) != "") & ~F.exists(found, lambda x: x["url"] == url), F.concat(own, found)).otherwise(found)


def times(text: Column) -> Column:
    """The distinct expressions of time, lower-cased, by pattern and then as they occur."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(low, F.lit(p), F.lit(0)) for _, p in lexicon.TEMPORAL])))


ENTITY = "array<struct<type: string, value: string, matched_text: string, start: int, stop: int, numeric_value: string>>"


def found_times(text: str) -> list[tuple]:
    """Expressions of time by place; of those with one span the first by pattern."""
    low = text.lower()
    every = [(m.start(), i, m.end(), kind, m) for i, (kind, pattern) in enumerate(lexicon.TEMPORAL) for m in re.finditer(pattern, low)]
    out, seen = [], set()
    for start, _, stop, kind, m in sorted(every, key=lambda x: x[:2]):
        if (start, stop) not in seen:
            seen.add((start, stop))
            out.append((kind, m.group(0), text[start:stop], start, stop, m.group(1)))
    return out


def temporal_entities(content: Column) -> Column:
    """Structs of type, value, matched_text, start, stop, numeric_value, by place; null for null. Spans need Python: native functions tell no places."""
    names = ("type", "value", "matched_text", "start", "stop", "numeric_value")

    @F.pandas_udf(ENTITY)
    def find(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else [dict(zip(names, x, strict=True)) for x in found_times(t)])

    return find(content)


def marked(text: Column, entities: Column, mark: str = "⏰") -> Column:
    """text with a mark before each of its expressions of time, right to left: of those with one start the last is marked first."""
    return F.aggregate(F.reverse(entities), text, lambda t, e: F.concat(F.substr(t, F.lit(1), e["start"]), F.lit(mark), e["matched_text"], F.substr(t, e["stop"] + 1)))


def time_note(text: Column, entities: Column) -> Column:
    """text after a note of the first five expressions of time in it."""
    said = F.array_join(F.transform(F.slice(entities, 1, 5), lambda e: e["matched_text"]), ", ")
    note = F.concat(F.lit("\n\n⏰ ATTENZIONE: Questo contesto contiene valori temporali specifici: "), said, F.lit(". Devono essere riportati ESATTAMENTE nella risposta.\n"))
    return F.when(F.size(entities) > 0, F.concat(note, text)).otherwise(text)


def missing_times(answer: Column, context: Column) -> Column:
    return F.array_except(times(context), times(answer))


def normalize_url(url: Column) -> Column:
    """Trimmed, without one final dot, `www.` made absolute."""
    plain = F.regexp_replace(strip(url), r"\.$", "")
    return F.when(F.startswith(F.lower(plain), F.lit("www.")), F.concat(F.lit("https://"), plain)).otherwise(plain)


def url_slug(url: Column, most: int = 100) -> Column:
    """A file's name: the path and 30 characters of the query in letters, digits and single underscores, with a digest if long."""
    way = F.translate(F.regexp_replace(path(url), "^/+|/+$", ""), "/", "_")
    asked = F.translate(F.substring(F.regexp_extract(url, r"\?([^#]*)", 1), 1, 30), "=&", "-_")
    slug = F.concat(way, F.when(asked != "", F.concat(F.lit("_"), asked)).otherwise(""))
    slug = F.regexp_replace(F.regexp_replace(slug, r"[^\p{L}\p{N}_\-]", "_"), "_+", "_")
    slug = F.regexp_replace(slug, "^_+|_+$", "")
    long = F.concat(F.substring(slug, 1, most), F.lit("_"), F.substring(F.md5(url), 1, 6))
    return F.when(slug == "", F.substring(F.md5(url), 1, 16)).when(F.length(slug) > most, long).otherwise(slug)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^[a-z]+://([^/?#:]+)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, "^[a-z]+://[^/?#]+([^?#]*)", 1)


def hash16(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def redact_input(text: Column) -> Column:
    return reduce(lambda t, p: F.regexp_replace(t, p[1], f"[{p[0]}_RIMOSSO]"), lexicon.PII_INPUT, text)


def redact_log(text: Column) -> Column:
    return reduce(lambda t, p: F.regexp_replace(t, p[1], p[0]), lexicon.PII_LOG, text)


def has_pii(text: Column) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(p) for _, p in lexicon.PII_INPUT])


def has_injection(text: Column) -> Column:
    return F.lower(text).rlike("|".join(lexicon.INJECTION))


#: A decimal number as text.
NUMBER = r"^\s*[+-]?([0-9]+(_[0-9]+)*(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def first_int(text: Column) -> Column:
    """The first whole number, with its sign; null without one."""
    return F.nullif(F.regexp_extract(text, "-?[0-9]{1,15}", 0), F.lit("")).cast("long")


def first_number(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"-?[0-9]{1,15}(?:\.[0-9]{1,15})?", 0), F.lit("")).cast("double")


def clamp(value: Column, low: int, high: int, default: int) -> Column:
    """A text or number as an integer within bounds; the default where it is none.

    A text may have white space around it, a sign, single underscores between digits, a fraction and an exponent; it is rounded, halves away
    from zero. Hexadecimal and binary digits follow 0x and 0b.
    """
    t = value.cast("string")
    plain = F.replace(F.when(t.rlike(NUMBER), strip(t)), F.lit("_"), F.lit(""))
    based = F.coalesce(*[F.conv(F.nullif(F.regexp_extract(t, rf"(?i)^\s*0{x}([{digits}]{{1,15}})\s*$", 1), F.lit("")), base, 10) for x, digits, base in (("x", "0-9a-f", 16), ("b", "01", 2))])
    number = F.coalesce(F.round(plain.try_cast("double")), based.cast("double")).try_cast("int")
    return F.when(number.isNull(), default).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), number)))


def casefolded(text: Column) -> Column:
    """Lower case with ß as ss, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("ß"), F.lit("ss")), r"\s+", " "))


def tagged(text: Column, concepts: Column) -> Column:
    """`[C1] [C2] text`; text as it is without concepts."""
    tags = F.array_join(F.transform(concepts, lambda c: F.concat(F.lit("["), c, F.lit("]"))), " ")
    return F.when(F.coalesce(F.size(concepts), F.lit(0)) > 0, F.trim(F.concat(tags, F.lit(" "), text))).otherwise(text)


def index_text(text: Column, concepts: Column) -> Column:
    """What is indexed of a passage: its text after its concepts' tags; nothing of an empty one."""
    return F.when(F.coalesce(text, F.lit("")) == "", "").otherwise(tagged(text, concepts))


def concept_list(text: Column) -> Column:
    """Concepts written as one text, split at commas, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda c: F.trim(c)), lambda c: c != "")


def concepts(text: Column, names: list[tuple[str, list[str]]] = lexicon.CONCEPTS, fold: bool = True) -> Column:
    """The concepts of which a synonym occurs, in the lexicon's order."""
    t = casefolded(text) if fold else F.lower(F.coalesce(text, F.lit("")))
    return bound(t, lambda t: F.array_compact(F.array(*[F.when(any_of(t, [" ".join(w.casefold().split()) if fold else w for w in words]), name) for name, words in names])))


def domain_words(text: Column, words: list[str] = lexicon.DOMAIN_WORDS, most: int = 10) -> Column:
    t = F.lower(F.coalesce(text, F.lit("")))
    return bound(t, lambda t: F.slice(F.array_compact(F.array(*[F.when(F.contains(t, F.lit(w)), w) for w in words])), 1, most))


def first_present(*values: Column) -> Column:
    """The first that is not null nor empty (text, list or map)."""
    return F.coalesce(*[F.when(F.length(F.trim(v.cast("string"))) > 0, v) for v in values])


def first_list(*values: Column) -> Column:
    """The first list or map that has entries."""
    return F.coalesce(*[F.when(F.size(v) > 0, v) for v in values])


def flat(fields: dict[str, Column], kinds: dict[str, str]) -> Column:
    """A map of texts out of columns: lists joined by commas, structs and maps as JSON, nulls left out."""
    as_text = {"list": lambda c: F.array_join(c.cast("array<string>"), ", "), "json": F.to_json, "plain": lambda c: c.cast("string")}
    made = F.create_map(*[x for k, c in fields.items() for x in (F.lit(k), as_text[kinds.get(k, "plain")](c))])
    return F.map_filter(made, lambda _, v: v.isNotNull())


def merged(*maps: Column) -> Column:
    """Maps in one, the last entry of a key."""

    def without(m: Column, later: tuple[Column, ...]) -> Column:
        named = lambda k: reduce(lambda a, b: a | b, [F.coalesce(F.map_contains_key(x, k), F.lit(False)) for x in later])
        return F.map_filter(m, lambda k, _: ~named(k)) if later else m

    return F.map_concat(*[without(m, maps[i + 1 :]) for i, m in enumerate(maps)])


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)


def extension(path: Column) -> Column:
    """Lower-cased, with its dot; empty without one."""
    return F.lower(F.regexp_extract(basename(path), r"[^.](\.[^.]+)$", 1))


def stable_id(*parts: Column) -> Column:
    """A version-5-like identifier out of a digest of the parts: the same for the same parts."""
    h = F.sha1(F.concat_ws("|", *[p.cast("string") for p in parts]))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def page_id(filename: Column, source: Column, rel_path: Column, page: Column) -> Column:
    """`name::pN`, or the name alone without a page."""
    name = F.coalesce(first_present(filename, source, rel_path), F.lit("UNKNOWN"))
    return F.concat(name, F.when(page.isNotNull(), F.concat(F.lit("::p"), page.cast("string"))).otherwise(""))


def relevants(ids: Column, docs: Column) -> Column:
    """Ids as they are, or those of structs (filename, page), as page_id writes them."""
    made = F.transform(docs, lambda d: F.concat(F.coalesce(d["filename"], F.lit("")), F.when(F.coalesce(d["page"], F.lit(0)) != 0, F.concat(F.lit("::p"), d["page"].cast("string"))).otherwise("")))
    return F.coalesce(first_list(ids), made, F.array().cast("array<string>"))


def with_role(question: Column, role: Column) -> Column:
    return F.when(F.coalesce(role, F.lit("")) != "", F.concat(question, F.lit(" [role: "), role, F.lit("]"))).otherwise(question)


def aligned(text: Column) -> Column:
    """The form in which passages are compared with pages: lower case, no soft hyphens, marks other than % € ° - as spaces."""
    plain = F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("\u00ad"), F.lit(""))
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"[^\p{L}\p{N}_\s%€°\-]", " "), r"\s+", " "))


def numbers(text: Column) -> Column:
    """The distinct numbers and dates in a text, page references left out, sorted."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\bpag(?:ina)?\b\s*\d{1,4}\b", " ")
    plain = F.regexp_replace(plain, r"\bp\.\s*\d{1,4}\b", " ")
    some = [F.regexp_extract_all(plain, F.lit(p), F.lit(0)) for p in (r"\b\d{1,4}(?:[.,]\d+)?\b", r"\b\d{1,2}[\/\-]\d{1,2}[\/\-]\d{2,4}\b")]
    return F.sort_array(F.array_distinct(F.concat(*some)))


def word_overlap(a: Column, b: Column) -> Column:
    """The share of a's distinct words that b has; 0 without words."""
    own, other = (F.array_distinct(F.filter(F.split(x, r"\s+"), lambda w: w != "")) for x in (a, b))
    return F.when(F.size(own) == 0, 0.0).otherwise(F.size(F.array_intersect(own, other)) / F.size(own))


def pages_of(content_type: Column, content: Column, pages: Column, images: Column) -> Column:
    """One shape for the content of a document: array of (page_number, text) out of a text, pages, or images (no text)."""
    empty = F.array().cast("array<struct<page_number: int, text: string>>")
    shots = F.transform(images, lambda _, i: F.struct((i + 1).cast("int").alias("page_number"), F.lit(None).cast("string").alias("text")))
    one = F.array(F.struct(F.lit(None).cast("int").alias("page_number"), content.alias("text")))
    return F.coalesce(F.when(content_type == "image_list", shots).when(pages.isNotNull(), pages).when(content.isNotNull(), one), empty)


def json_object(text: Column, schema: str) -> Column:
    """The object in a model's answer: inside a fence, else up to the end of the text; null where there is none."""
    fenced = F.coalesce(F.nullif(F.regexp_extract(text, r"(?s)```json(.*?)```", 1), F.lit("")), F.nullif(F.regexp_extract(text, r"(?s)```(.*?)```", 1), F.lit("")))
    found = F.coalesce(fenced, F.nullif(F.regexp_extract(text, r"(?s)\{.*\}\s*$", 0), F.lit("")))
    return F.when(strip(found).startswith("{"), F.from_json(strip(found), schema))


def claims(text: Column, longer: int = 10) -> Column:
    """The lines of a list without their numbers, those of more than 10 characters."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.regexp_replace(strip(x), r"^[\d\-\*\.]+\s*", ""))
    return F.filter(lines, lambda x: F.length(x) > longer)


def judged_score(text: Column, default: int = 3, most: int = 5) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(text, r"SCORE:\s*(\d)", 1), F.lit("")).cast("int"), F.lit(default)) / most


def verdict(text: Column, yes: str, no: str = "NON", partly: str = "PARZIALMENTE") -> Column:
    """1, 0.5 or 0 for a judge's word: the whole yes, partly, else no; a null one counts as no."""
    return F.when(text.contains(yes) & ~text.contains(no) & ~text.contains(partly), 1.0).when(text.contains(partly), 0.5).otherwise(0.0)


def stamped(at: Column) -> Column:
    """yyyyMMdd_HHmmss, as versions are named."""
    return F.date_format(at, "yyyyMMdd_HHmmss")


def elapsed(start: Column, stop: Column) -> Column:
    """Seconds between two times, to three digits."""
    return F.round((F.unix_micros(stop) - F.unix_micros(start)) / 1e6, 3)


def canonical_json(fields: dict[str, Column]) -> Column:
    """A JSON object with its keys in order, `", "` and `": "` between, nulls as null, other letters than ASCII not escaped, as hashes of entries are taken."""
    def value(c: Column) -> Column:
        return F.coalesce(F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1), F.lit("null"))

    parts = [F.concat(F.lit(f'"{k}": '), F.when(fields[k].isNull(), "null").otherwise(value(fields[k]))) for k in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def any_of(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def hits(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.contains(text, F.lit(w)).cast("int") for w in words])


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
