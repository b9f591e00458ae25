"""Ordered rule lists as `when` chains: the first hit wins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lexicon
from .text import any_of, has_injection, has_pii, hits, host, normalize, path, redact_input, strip, word_count


def role(text: Column) -> Column:
    t = F.lower(text)
    return F.when(hits(t, lexicon.PROCEDURAL) >= 2, "procedural").when(hits(t, lexicon.RULES) >= 2, "mandatory_rule").when(any_of(t, lexicon.DEFINITIONS), "definitional").otherwise("descriptive")


def category(text: Column, source_type: Column, section: Column) -> Column:
    """What a validated passage is: web pages by their section, others by what they say."""
    t, part = F.lower(text), F.lower(F.coalesce(section, F.lit("")))
    boxes = lambda mark: occurrences(t, mark) > 3
    web = F.when(part == "faq", "web_faq").when(part.isin("guide", "manuali"), "web_guide").when(part.isin("normativa", "documentazione"), "web_normativa").otherwise("web_content")
    return (
        F.when(source_type == "web_page", web)
        .when(F.contains(t, F.lit("sanzione")) & any_of(t, ["euro", "€"]), "sanctions_table")
        .when(boxes("[ ]") | boxes("☐"), "checklist")
        .when((source_type == "faq") | any_of(t, ["significa", "definizione"]), "glossary")
        .when(any_of(t, ["cliccare", "selezionare", "accedere"]), "procedural")
        .otherwise("other")
    )


def occurrences(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("long")


def built_category(text: Column, source_type: Column, filename: Column) -> Column:
    """What a passage of the built knowledge base is: by its source, its file's name, then by what it says."""
    t, name = F.lower(text), F.lower(F.coalesce(filename, F.lit("")))
    ticks = reduce(lambda a, b: a + b, [occurrences(t, x) for x in (" si ", " no ", "si\n", "no\n")])
    head = F.substring(t, 1, 200)
    return (
        F.when(source_type == "web", F.when(F.contains(F.substring(t, 1, 100), F.lit("?")), "web_faq").otherwise("web_content"))
        .when(any_of(name, ["guida", "manuale", "manual", "man_"]), F.when(any_of(name, ["inserimento", "registrazione", "accesso", "richiesta"]), "guide_procedural").otherwise("guide_reference"))
        .when(any_of(name, ["check", "checklist", "check-list", "check_list"]), "checklist")
        .when(any_of(name, ["modulo", "modello", "richiesta", "delega"]), "form_module")
        .when(any_of(name, ["circolare", "decreto", "regolamento", "normativa"]), "normative")
        .when(ticks >= 3, "checklist")
        .when(hits(t, ["passo ", "step ", "1.", "2.", "3.", "clicca", "seleziona", "inserisci"]) >= 3, "guide_procedural")
        .when(any_of(t, ["sanzione", "infrazione", "penalita'"]), "sanctions")
        .when(any_of(head, ["registr", "accesso al sistema", "accedi", "login"]), "access_procedure")
        .when(any_of(head, ["si intende", "e' definito", "con il termine"]), "definition")
        .otherwise("descriptive")
    )


def intent(question: Column) -> Column:
    """procedural, acronym_definition, definitional or generic: the first that fits."""
    q = F.lower(question)
    asked = lambda p: F.regexp_extract(question, p, 1)
    capitals = lambda word: F.length(F.regexp_replace(word, r"[^\p{Lu}]", ""))
    # found in the question, of two letters or more, at least two of them capitals
    acronym = reduce(lambda a, b: a | b, [capitals(asked(p)) >= 2 for p in lexicon.ASK_ACRONYM])
    return (
        F.when(any_of(q, lexicon.ASK_HOW), "procedural")
        .when(F.contains(q, F.lit("come")) & any_of(q, lexicon.ASK_VERBS), "procedural")
        .when(acronym, "acronym_definition")
        .when(any_of(q, lexicon.ASK_WHAT), "definitional")
        .otherwise("generic")
    )


def asks_procedure(question: Column) -> Column:
    return any_of(F.lower(question), lexicon.ASK_PROCEDURE)


def asks_definition(question: Column) -> Column:
    return any_of(F.lower(question), lexicon.ASK_DEFINITION)


def search_intent(question: Column) -> Column:
    """procedural if the question names a service, an access or a duty, else generic."""
    return F.when(any_of(normalize(question), lexicon.ASK_SERVICE), "procedural").otherwise("generic")


def depth(question: Column, usual: int = 8, procedural: int = 12) -> Column:
    """How many passages a question gets."""
    return F.when(search_intent(question) == "procedural", procedural).otherwise(usual)


def is_junk(text: Column) -> Column:
    t = strip(F.lower(text))
    return junk(t, word_count(t))


def junk(t: Column, words: Column) -> Column:
    """is_junk of a text that is lower-cased and stripped, of so many words."""
    linked = any_of(t, ["http://", "https://", ".pdf"])
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", "")) / F.greatest(F.length(t), F.lit(1))
    return (F.length(t) < 20) | (t.rlike("(?i)" + "|".join(lexicon.JUNK)) & (words < 15)) | (linked & (words < 20)) | (letters < 0.4)


def profile(chars: Column, images: Column, tables: Column, name: Column, source_type: Column, readable: Column) -> Column:
    """A struct of doc_type, quality_score, has_tables and strategy of a document out of counts over its pages."""
    kind = lambda doc, score, way: F.struct(F.lit(doc).alias("doc_type"), F.lit(score).alias("quality_score"), F.lit(way).alias("strategy"))
    pdf = ~F.lower(name).rlike(r"\.docx?$")
    plain = kind("textual", 1.0, "text_extract")
    found = (
        F.when(source_type == "web_page", kind("web_content", 0.85, "html_extract"))
        .when(~readable & pdf, kind("mixed", 0.0, "ocr_tesseract"))
        .when(~pdf, plain)
        .when((chars < 500) & (images > 2), kind("visual_guide", 0.95, "vision_llm"))
        .when((chars < 500) & (images == 0), kind("mixed", 0.5, "ocr_tesseract"))
        .when((tables > 0) & (chars > 500), kind("table", 0.9, "text_extract"))
        .when((chars < 1000) & (images > 5), kind("slide", 0.85, "vision_llm"))
        .otherwise(plain)
    )
    has = (source_type != "web_page") & (tables > 0) & (readable | ~pdf)
    return F.struct(found["doc_type"].alias("doc_type"), found["quality_score"].alias("quality_score"), has.alias("has_tables"), found["strategy"].alias("strategy"))


def table_lines(text: Column) -> Column:
    """How many lines look like those of a table: two bars, or over 20 characters with more than three gaps of three spaces."""
    is_table = lambda x: (occurrences(x, "|") >= 2) | ((F.length(x) > 20) & (occurrences(x, "   ") > 3))
    return F.size(F.filter(F.split(text, "\n"), is_table)).cast("long")


def schema_issues(chunk_id: Column, parent: Column, text: Column, has_metadata: Column, source_type: Column) -> Column:
    """What a passage lacks: required keys, its metadata (and in that its source's type)."""
    missing = [F.when(F.coalesce(c.cast("string"), F.lit("")) == "", f"Chiave mancante o nulla: {k}") for k, c in (("chunk_id", chunk_id), ("parent_doc_id", parent), ("text_content", text))]
    return F.array_compact(F.array(*missing, F.when(~has_metadata, "Chiave mancante o nulla: metadata"), F.when(source_type.isNull(), "Metadata mancante: source_type")))


def content_issues(text: Column) -> Column:
    """What speaks against a text: that it is short, the first phrase by which a model declines."""
    t = F.lower(text)
    first = F.coalesce(*[F.when(F.contains(t, F.lit(p)), f"Rifiuto LLM rilevato: '{p}'") for p in lexicon.REFUSALS])
    short = F.when(F.length(text) < 50, F.concat(F.lit("Testo troppo breve ("), F.length(text).cast("string"), F.lit(" chars).")))
    return F.when(F.coalesce(text, F.lit("")) == "", F.array(F.lit("Testo vuoto."))).otherwise(F.array_compact(F.array(short, first)))


def issues(chunk_id: Column, parent: Column, text: Column, has_metadata: Column, source_type: Column) -> Column:
    """All issues of a passage; its content is only judged if the schema holds."""
    broken = schema_issues(chunk_id, parent, text, has_metadata, source_type)
    return F.when(F.size(broken) > 0, broken).otherwise(content_issues(text))


def tax_warning(text: Column) -> Column:
    """Whether a text may hold a tax number: a flag, not a reason to reject."""
    return F.coalesce(text.rlike(lexicon.TAX_NUMBER), F.lit(False))


def validated(chunks: DataFrame) -> DataFrame:
    """chunks (chunk_id, parent_doc_id, text_content, source_type, web_section) with issues, preview, pii_warning, chunk_category, validated_at.

    Rows without issues are valid, the others rejected: filter by size(issues). Only valid rows have a category.
    """
    text = F.col("text_content")
    out = chunks.withColumn("issues", issues(F.col("chunk_id"), F.col("parent_doc_id"), text, F.lit(True), F.col("source_type")))
    good = F.size("issues") == 0
    return out.select(
        "*",
        F.substring(F.coalesce(text, F.lit("")), 1, 50).alias("preview"),
        (good & tax_warning(text)).alias("pii_warning"),
        F.when(good, category(text, F.col("source_type"), F.col("web_section"))).alias("chunk_category"),
        good.alias("validated_at"),
    )


def admitted(text: Column, kind: Column, most: int = 3000) -> Column:
    """Whether a passage is indexed: not too long, neither a table of sanctions nor a checklist."""
    return (F.length(text) <= most) & ~F.coalesce(kind.isin("sanctions_table", "checklist"), F.lit(False))


def admission_reason(text: Column, kind: Column, most: int = 3000) -> Column:
    return F.when(F.length(text) > most, "too long").when(kind.isin("sanctions_table", "checklist"), kind)


def excluded_doc(doc_type: Column, text: Column) -> Column:
    """Whether a found passage is left out: sanctions, and tables with more than ten bars or semicolons."""
    noisy = (occurrences(text, "|") > 10) | (occurrences(text, ";") > 10)
    return F.coalesce((doc_type == "sanzioni") | ((doc_type == "table") & noisy), F.lit(False))


def is_refusal(answer: Column) -> Column:
    return any_of(F.lower(F.coalesce(answer, F.lit(""))), lexicon.DECLINED)


def valid_answer(answer: Column, kind: Column) -> Column:
    """Over 60 characters, and no refusal unless the question is procedural."""
    return (F.length(F.coalesce(answer, F.lit(""))) > 60) & ((kind == "procedural") | ~is_refusal(answer))


def answerability(contexts: Column, question: Column) -> Column:
    """retrieval_failure if no word of the question of over three letters is in the contexts, else likely_answerable."""
    words = F.filter(F.regexp_extract_all(F.lower(question), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: F.length(w) > 3)
    seen = F.lower(F.array_join(contexts, " "))
    met = F.exists(words, lambda w: F.contains(seen, w))
    return F.when((F.coalesce(F.size(contexts), F.lit(0)) > 0) & met, "likely_answerable").otherwise("retrieval_failure")


def factual(answer: Column, truth: Column) -> Column:
    """EMAIL_MISMATCH if the answer lacks an address of the expected one, else OK."""
    found = lambda t: F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(r"[\w\.-]+@[\w\.-]+"), F.lit(0))
    return F.when(F.size(F.array_except(found(truth), found(answer))) > 0, "EMAIL_MISMATCH").otherwise("OK")


def was_answerable(contexts: Column, answer: Column) -> Column:
    return (F.coalesce(F.size(contexts), F.lit(0)) > 0) & ~F.contains(F.lower(answer), F.lit("non ho trovato"))


def safety_scores(answer: Column) -> Column:
    """A struct of 0 or 1: out of domain admitted, not tampered with, with a disclaimer."""
    a = F.lower(F.coalesce(answer, F.lit("")))
    one = lambda hit: hit.cast("int")
    return F.struct(one(any_of(a, lexicon.OUT_OF_DOMAIN)).alias("ood"), one(~any_of(a, lexicon.TAMPERED)).alias("injection"), one(any_of(a, lexicon.DISCLAIMERS)).alias("legal"))


def sanitized(text: Column, toxic: Column | None = None, failed: Column | None = None, most: int | None = 500) -> Column:
    """A struct of text (cut, personal data masked), flags and error of an input.

    toxic: a moderation's verdict, null where it can't tell; it only counts where there is no injection. failed: where the
    moderation did not answer; the text is let pass, and flagged.
    """
    cut = text if most is None else F.substring(text, 1, most)
    safe = F.when(has_pii(cut), redact_input(cut)).otherwise(cut)
    tricked = has_injection(safe)
    harm = ~tricked & F.coalesce(toxic if toxic is not None else F.lit(False), F.lit(False))
    down = ~tricked & F.coalesce(failed if failed is not None else F.lit(False), F.lit(False))
    error = F.when(tricked, "Tentativo di manipolazione del sistema.").when(harm, "Contenuto non consentito").otherwise("")
    flags = F.struct(has_pii(cut).alias("pii_detected"), tricked.alias("prompt_injection"), harm.alias("toxic_content"), down.alias("moderation_unavailable"))
    return F.struct(safe.alias("text"), flags.alias("flags"), error.alias("error"))


#: Words of a page's context and of its address that tell what a link is for.
LINK_WORDS = [(("manuale", "manual", "istruzioni"), "manuale_generico"), (("guida", "help"), "guida_generica"), (("cruscotto", "dashboard"), "cruscotto_generico"), (("delega", "deleghe"), "deleghe_generiche"), (("modulo", "modulistica"), "modulo_documentazione")]


def link_kind(url: Column, context: Column, site: str = "portale", ministry: str = "salute.gov.it") -> Column:
    """What a link is for: on the own site by path or context, on the ministry's by context, elsewhere by context."""
    ctx, domain, way = F.lower(F.coalesce(context, F.lit(""))), host(url), F.lower(path(url))
    has = lambda c, w: F.contains(c, F.lit(w))
    own = (
        F.when(has(way, "manual") | has(ctx, "manuale") | has(ctx, "istruzioni"), f"manuale_{site}")
        .when(has(way, "guida") | has(ctx, "guida"), f"guida_{site}")
        .when(has(way, "dashboard") | has(ctx, "cruscotto"), f"cruscotto_{site}")
        .when(has(way, "delega") | has(ctx, "deleghe"), f"deleghe_{site}")
        .otherwise(f"pagina_{site}")
    )
    out = F.when(has(domain, site) | has(way, site), own).when(has(domain, ministry), F.when(any_of(ctx, ["guida", "manuale"]), "guida_ministeriale").otherwise("pagina_ministeriale"))
    for words, kind in LINK_WORDS:
        out = out.when(any_of(ctx, list(words)), kind)
    return out.otherwise("link_generico")


def alignment(mapped: Column, window: Column, score: Column, overlap: Column, numbers_ok: Column) -> Column:
    """A struct of status and error_type of a passage compared with its page."""
    kind = lambda status, error: F.struct(F.lit(status).alias("status"), F.lit(error).alias("error_type"))
    return (
        F.when(~mapped, kind("INVALID", "mapping_error"))
        .when(window == "", kind("INVALID", "no_text_extracted"))
        .when((score >= 92) & (overlap >= 0.65) & numbers_ok, kind("VERIFIED", "none"))
        .when((score >= 80) & (overlap >= 0.45) & numbers_ok, kind("NEEDS_REVIEW", "weak_alignment"))
        .when(~numbers_ok, kind("NEEDS_REVIEW", "numeric_mismatch"))
        .otherwise(kind("INVALID", "text_mismatch"))
    )


def vision_verdict(judged: Column, valid: Column, error: Column) -> Column:
    """A struct of status and error_type of a passage judged on its page's image."""
    kind = lambda status, why: F.struct(F.lit(status).alias("status"), why.alias("error_type"))
    told = F.coalesce(F.nullif(error, F.lit("")), F.when(valid, "none").otherwise("unknown"))
    return F.when(~judged, kind("INVALID", F.lit("judge_call_failed"))).when(valid, kind("VERIFIED", told)).otherwise(kind("NEEDS_REVIEW", told))


def implied_rules(text: Column) -> Column:
    """Structs (role, text, confidence) of the rules that a passage implies: a duty, an access, a service."""
    t = F.lower(text)
    rule = lambda role, told, sure: F.struct(F.lit(role).alias("semantic_role"), F.lit(told).alias("text_content"), F.lit(sure).alias("confidence"))
    return F.array_compact(
        F.array(
            F.when(any_of(t, lexicon.MANDATORY_HINTS) & F.contains(t, F.lit("email")), rule("mandatory_rule", lexicon.MANDATORY_RULE, "high")),
            F.when(any_of(t, lexicon.ACCESS_HINTS), rule("access_rule", lexicon.ACCESS_RULE, "high")),
            F.when(any_of(t, lexicon.SERVICE_HINTS), rule("service_mapping", lexicon.SERVICE_RULE, "medium")),
        )
    )


def source_type(name: Column) -> Column:
    n = F.lower(name)
    return F.when(F.contains(n, F.lit("faq")), "faq").when(any_of(n, ["vis", "scheda", "guida"]), "visual_guide").otherwise("text_document")


def section(url: Column) -> Column:
    u, out = F.lower(url), None
    for word, name in lexicon.SECTIONS:
        out = (F if out is None else out).when(F.contains(u, F.lit(word)), name)
    return out.otherwise("Generale")


def excluded(url: Column) -> Column:
    return url.rlike("(?i)" + "|".join(lexicon.EXCLUDED))
