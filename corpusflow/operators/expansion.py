"""Variants of a question: synonyms, templates by intent, acronyms. All are Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Templates by intent, of which the first two are used.
TEMPLATES = {
    "procedural": ["procedura per {}", "come si fa a {}", "passaggi per {}"],
    "definitional": ["definizione di {}", "cosa significa {}", "spiegazione {}"],
    "acronym_definition": ["cosa significa {}", "significato acronimo {}", "per cosa sta {}"],
}


def by_synonym(question: Column, lexicon: list[tuple[str, list[str]]], most: int = 2) -> Column:
    """The first term of the lexicon that occurs gives up to `most` variants, lower-cased with a capital at the start."""
    low = F.lower(question)
    out = None
    for term, synonyms in lexicon:
        swapped = [F.replace(low, F.lit(term), F.lit(s)) for s in synonyms[:most]]
        capital = F.array(*[F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 2147483647)) for x in swapped])
        out = (F if out is None else out).when(F.contains(low, F.lit(term)), capital)
    nothing = F.array().cast("array<string>")
    return nothing if out is None else F.coalesce(out, nothing)


def by_intent(question: Column, intent: Column, most: int = 2) -> Column:
    out = None
    for name, templates in TEMPLATES.items():
        made = F.array(*[F.format_string(t.replace("{}", "%s"), question) for t in templates[:most]])
        out = (F if out is None else out).when(intent == name, made)
    return F.coalesce(out, F.array().cast("array<string>"))


def expand(question: Column, intent: Column, lexicon: list[tuple[str, list[str]]], most: int = 5) -> Column:
    """The question, then its variants, each text once and at most `most` of them."""
    return F.slice(F.array_distinct(F.concat(F.array(question), by_synonym(question, lexicon), by_intent(question, intent))), 1, most)


def with_acronyms(question: Column, meanings: dict[str, list[str]], most: int = 2) -> Column:
    """Appends the first meanings of each known acronym (two to six capitals), in order of occurrence."""
    if not meanings:
        return question
    known = F.create_map(*[x for k, v in meanings.items() for x in (F.lit(k), F.array(*map(F.lit, v[:most])))])
    found = F.regexp_extract_all(question, F.lit(r"\b([A-Z]{2,6})\b"), F.lit(1))
    added = F.flatten(F.array_compact(F.transform(found, lambda a: F.try_element_at(known, a))))
    return F.when(F.size(added) > 0, F.concat_ws(" ", question, F.array_join(added, " "))).otherwise(question)


def strategies(question: Column, intent: Column, lexicon: list[tuple[str, list[str]]], reworded: Column | None = None, names: tuple[str, ...] = ("synonyms", "intent"), most: int = 5) -> Column:
    """A struct of original, synonyms, llm, intent and all: the variants by strategy, and each text once, the question first, at most `most`."""
    nothing = F.array().cast("array<string>")
    made = {
        "synonyms": by_synonym(question, lexicon) if "synonyms" in names else nothing,
        "llm": reworded if reworded is not None and "llm" in names else nothing,
        "intent": by_intent(question, intent) if "intent" in names else nothing,
    }
    every = F.slice(F.array_distinct(F.concat(F.array(question), *made.values())), 1, most)
    return F.struct(F.array(question).alias("original"), *[v.alias(k) for k, v in made.items()], every.alias("all"))
