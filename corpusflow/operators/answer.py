"""From questions to answers: what is told a generator, what is kept of its answers."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify, lexicon, text
from ..sources.scratch import saved
from . import ensemble, expansion, plugins, retrieval

#: The parts of a prompt, in order; a deployment brings its own wording.
PROMPT = "{system}\n\n=== CONTESTO DOCUMENTALE ===\n{context}\n\n=== LINK E RISORSE UTILI ===\n{links}\n\n=== STORICO CONVERSAZIONE ===\n{history}\n\n=== DOMANDA DELL'UTENTE ===\n{question}\n"
STEPS = "Rispondi solo con i documenti forniti, passo per passo.\n\nDOMANDA: {question}\n\nDOCUMENTAZIONE:\n{context}\n\nRISPOSTA:\n"
AGAIN = "I documenti contengono la risposta: usali.\n\nDOCUMENTI:\n{context}\n\nDOMANDA: {question}\n\nRISPOSTA:\n"
SYSTEM = "Oggi è il {date}. Rispondi in base ai documenti."
#: Answers without a generator.
BLOCKED, NOTHING, FAILED = "Richiesta bloccata per motivi di sicurezza.", "Non ho trovato informazioni pertinenti.", "Errore nella generazione della risposta."
NO_LINKS, NO_HISTORY = "Nessun link o risorsa esterna pertinente è stata recuperata.", "Nessuno."


def filled(template: str, **parts: Column) -> Column:
    """The template with {names} replaced, each part once and as it is."""
    out, rest = [], template
    while rest:
        head, brace, tail = rest.partition("{")
        if head:
            out.append(F.lit(head))
        if not brace:
            break
        name, _, rest = tail.partition("}")
        out.append(F.coalesce(parts[name], F.lit("")))
    return F.concat(*out)


def system_prompt(at: Column, template: str = SYSTEM) -> Column:
    return filled(template, date=F.date_format(at, "dd/MM/yyyy"))


def sources(found: DataFrame) -> DataFrame:
    """(query, sources): the distinct (filename, page_number) of found (query, rank, filename, page_number, source_url) by rank; those
    without a name are left out. A query without any has no row."""
    named = found.where(F.coalesce("filename", F.lit("")) != "")
    first = named.groupBy("query", "filename", "page_number").agg(F.min_by(F.struct("rank", "filename", "page_number", F.coalesce("source_url", F.lit("")).alias("source_url")), "rank").alias("s"))
    listed = first.groupBy("query").agg(F.sort_array(F.collect_list("s")).alias("l"))
    return listed.select("query", F.transform("l", lambda s: F.struct(s["filename"], s["page_number"], s["source_url"])).alias("sources"))


def link_lines(found: DataFrame) -> DataFrame:
    """(query, links): a line for each distinct url of the links of found (query, rank, links), by rank and place, addresses as mailto."""
    rows = found.select("query", "rank", F.posexplode("links").alias("pos", "l")).select("query", "rank", "pos", F.trim("l.url").alias("url"), F.trim(F.coalesce(F.nullif(F.col("l.description"), F.lit("")), F.col("l.url"))).alias("told"), F.coalesce("l.type", F.lit("url")).alias("type"))
    rows = rows.where("url <> ''")
    mail = (F.col("type") == "email") | F.lower("url").startswith("mailto:")
    address = F.when(mail & ~F.lower("url").startswith("mailto:"), F.concat(F.lit("mailto:"), "url")).otherwise(F.col("url"))
    line = F.when(mail, F.concat(F.lit(" - [Contatto Email: "), F.replace(address, F.lit("mailto:"), F.lit("")), F.lit("]("), address, F.lit(")"))).otherwise(F.concat(F.lit(" - [Link Esterno: "), "told", F.lit("]("), address, F.lit(")")))
    first = rows.select("query", "rank", "pos", address.alias("address"), line.alias("line")).groupBy("query", "address").agg(F.min(F.struct("rank", "pos", "line")).alias("s"))
    return first.groupBy("query").agg(F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["line"]), "\n").alias("links"))


def context(found: DataFrame) -> DataFrame:
    """(query, context): `[i] name (pag. p) — Fonte: url` and the text of each row of found by rank, an empty line between."""
    place = F.row_number().over(Window.partitionBy("query").orderBy("rank"))
    page, url = F.col("page_number"), F.coalesce("source_url", F.lit(""))
    head = F.concat(F.lit("["), place.cast("string"), F.lit("] "), F.coalesce("filename", F.lit("Sconosciuto")), F.when(F.coalesce(page, F.lit(0)) != 0, F.concat(F.lit(" (pag. "), page.cast("string"), F.lit(")"))).otherwise(""), F.when(url != "", F.concat(F.lit(" — Fonte: "), url)).otherwise(""))
    rows = found.select("query", "rank", F.concat(head, F.lit("\n"), text.strip(F.col("content"))).alias("part"))
    return rows.groupBy("query").agg(F.trim(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "part"))), lambda x: x["part"]), "\n\n")).alias("context"))


def history(messages: Column, most: int = 5) -> Column:
    """`role: content` of the last messages of an array of (role, content)."""
    recent = F.slice(messages, F.greatest(F.size(messages) - most + 1, F.lit(1)), most)
    said = F.array_join(F.transform(recent, lambda m: F.concat(F.coalesce(m["role"], F.lit("user")), F.lit(": "), F.coalesce(m["content"], F.lit("")))), "\n")
    return F.when(F.coalesce(F.size(messages), F.lit(0)) <= 0, NO_HISTORY).otherwise(said)


def usable(found: DataFrame, least: int = 150) -> DataFrame:
    """(query, usable, out_of_domain): whether a text has so many characters; whether they have under 50 on average."""
    size = F.length(text.strip(F.coalesce("content", F.lit(""))))
    return found.groupBy("query").agg(F.coalesce(F.max(size >= least), F.lit(False)).alias("usable"), (F.avg(F.length(F.coalesce("content", F.lit("")))) < 50).alias("out_of_domain"))


def weights(intent: Column) -> tuple[Column, Column]:
    """Of the vector and the lexical list."""
    pick = lambda i: F.coalesce(*[F.when(intent == name, F.lit(w[i])) for name, *w in lexicon.WEIGHTS], F.lit(lexicon.WEIGHTS[-1][1 + i]))
    return pick(0), pick(1)


def ensemble_scores(lists: list[tuple[DataFrame, Column]], passages: DataFrame, questions: DataFrame, k: int = 8) -> DataFrame:
    """(query, id, score, rank) of lists (query, id, rank) with their weights, over questions (query, question, and columns of the weights).

    Each list gives max(0, 1 - 0.05 * (rank - 1)) times the boosts for definitions, density and names; scores are summed by weight,
    passages (id, content, filename, category) that the question doesn't ask for are left out, long ones without its words halved."""
    asked = questions.withColumn("kws", text.keywords(F.col("question")))
    parts = []
    for rows, weight in lists:
        parts.append(rows.join(asked.select("query", weight.alias("_w")), "query").select("query", "id", (ensemble.rank_score(F.col("rank")) * F.col("_w")).alias("score")))
    summed = saved(reduce(DataFrame.unionByName, parts).groupBy("query", "id").agg(F.sum("score").alias("score")))
    both = summed.join(passages, "id").join(asked.select("query", "question", "kws"), "query")
    q, kws, content = F.col("question"), F.col("kws"), F.col("content")
    boosts = ensemble.definition_boost(classify.asks_definition(q), kws, content) * ensemble.density_boost(kws, content) * ensemble.name_boost(kws, F.col("filename"))
    kept = both.where(ensemble.allowed(q, F.col("category")))
    return retrieval.top_k(kept.select("query", "id", (F.col("score") * boosts * ensemble.length_penalty(q, content)).alias("score")), k)


def overlap(question: pd.Series, content: pd.Series) -> list[float]:
    """A stand-in for a cross-encoder: the share of a question's words that the text has."""
    out = []
    for q, t in zip(question, content, strict=True):
        words = set(q.lower().split())
        out.append(len(words & set((t or "").lower().split())) / len(words) if words else 0.0)
    return out


def quoting(prompts: pd.Series) -> pd.Series:
    """A stand-in for a generator: the first passage of the prompt's context."""

    def first(prompt: str) -> str:
        at = prompt.find("\n[1] ")
        if at < 0:
            return "Mi dispiace"
        body = prompt[prompt.find("\n", at + 1) + 1 :]
        stop = min((x for x in map(body.find, ("\n\n[2] ", "\n\n===", "\n\nDOMANDA:", "\n\nRISPOSTA:")) if x >= 0), default=len(body))
        return body[:stop]

    return prompts.map(first)


def requests(
    asked: DataFrame,
    passages: DataFrame,
    generator: Callable = quoting,
    scorer: Callable = overlap,
    synonyms: list = lexicon.SYNONYMS,
    names: list = lexicon.CONCEPTS,
    depth_each: int = 10,
    context_chars: int = 6000,
    as_of: Column | None = None,
    moderator: Callable | None = None,
) -> DataFrame:
    """Answers to asked (id, question, messages: array of role and content or null) over passages (id, content, filename,
    page_number, source_url, category, concepts, doc_type, links, vec).

    (id, answer, sources, contexts, safety_flags, answer_mode): the input is checked and masked; its intent and concepts are told;
    its variants are searched by words and vectors; candidates are united, noisy ones left out, scored by the pair scorer and boosted
    by category, unless the curated FAQ alone has a strong match; those on the question's concepts are kept if there are any; the
    generator is told by intent, told again where it refuses on a usable context, and its answer masked. All questions go through
    each step at once; what a step gives is saved, so plans stay small.

    moderator: maps a Series of questions to verdicts; where it fails a question passes, flagged. Ids are unique. Null questions count as empty. safety_flags is null for none.
    """
    at = F.current_timestamp() if as_of is None else as_of
    # questions are numbered: ids may be of any kind
    checked = asked.select(F.monotonically_increasing_id().alias("query"), F.col("id").alias("own"), F.coalesce("question", F.lit("")).alias("raw"), "messages")
    verdict = plugins.moderated(F.col("raw"), moderator) if moderator else None
    checked = saved(checked.withColumn("m", verdict)) if moderator else checked
    checked = checked.withColumn("s", classify.sanitized(F.col("raw"), *([F.col("m.toxic"), F.col("m.failed")] if moderator else [])))
    blocked = F.col("s.flags.prompt_injection") | F.col("s.flags.toxic_content")
    checked = checked.select("query", "own", "messages", F.col("s.text").alias("question"), F.col("s.flags").alias("flags"), F.col("s.error").alias("error"), blocked.alias("blocked"))
    checked = saved(checked)
    open_ = checked.where("not blocked").withColumn("asked", text.concepts(F.col("question"), names)).withColumn("intent", classify.intent(F.col("question")))
    searched = text.tagged(F.col("question"), F.col("asked"))
    searched = F.when(F.col("intent") == "acronym_definition", expansion.with_acronyms(searched, lexicon.ACRONYMS)).otherwise(searched)
    open_ = open_.withColumn("variants", expansion.strategies(searched, F.col("intent"), synonyms)["all"]).withColumn("k", classify.depth(F.col("question")))
    open_ = saved(open_)

    # one search for each variant
    each = open_.select("query", "intent", F.posexplode("variants").alias("v", "question")).withColumn("qv", F.shiftleft("query", 3) + F.col("v"))
    vec_w, lex_w = weights(F.col("intent"))
    terms = each.select(F.col("qv").alias("query"), F.col("question").alias("text"))
    lexical = saved(retrieval.bm25_top(passages, terms, 8, "id", "content"))
    near = saved(retrieval.nearest(passages, each.select(F.col("qv").alias("query"), retrieval.embedding(F.col("question")).alias("vec")), 8, "id", "vec"))
    scored = saved(ensemble_scores([(near, vec_w), (lexical, lex_w)], passages.select("id", "content", "filename", "category"), each.select(F.col("qv").alias("query"), "question", "intent"), depth_each))
    # what else is known of passages is told of the candidates alone
    body = saved(passages.drop("vec").join(scored.select("id").distinct(), "id", "left_semi"))
    found = scored.join(body, "id").withColumn("v", F.col("query").bitwiseAND(7)).withColumn("query", F.shiftright("query", 3))
    found = retrieval.united([found.withColumn("rank", F.col("v") * 1000 + F.col("rank")).drop("v", "score")])
    found = found.where(~classify.excluded_doc(F.col("doc_type"), F.col("content")))

    told = found.join(open_.select("query", "question", "asked", "k"), "query")
    ranked = plugins.scored(told, scorer, 1 << 20)
    gate = retrieval.gated(ranked, "master_faq")
    strong = F.max(F.when(F.col("category") == "master_faq", F.col("score"))).over(Window.partitionBy("query")) > 0.5
    gate = gate.withColumn("_only", F.coalesce(strong, F.lit(False)))
    score = F.when(F.col("_only"), F.col("score")).otherwise(F.col("score") * retrieval.category_boost(F.col("category")))
    best = retrieval.top_k(gate.withColumn("score", score).drop("rank", "_only"), 12).where(F.col("rank") <= F.col("k"))
    best = saved(best)
    fit = usable(best)
    kept = retrieval.sharing_concepts(best)
    contexts = best.groupBy("query").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", F.substring("content", 1, context_chars).alias("c")))), lambda x: x["c"]).alias("contexts"))

    rows = open_.join(fit, "query", "left").join(contexts, "query", "left").join(sources(kept), "query", "left").join(link_lines(kept), "query", "left").join(context(kept), "query", "left")
    direct = F.col("intent").isin("definitional", "acronym_definition")
    said = F.when(direct, text.time_note(F.col("context"), text.temporal_entities(F.col("context")))).otherwise(F.col("context"))
    parts = {"system": system_prompt(at), "context": said, "links": F.coalesce("links", F.lit(NO_LINKS)), "history": history(F.col("messages")), "question": F.col("question")}
    ok = F.coalesce("usable", F.lit(False))
    steps = F.col("intent") == "procedural"
    rows = rows.withColumn("first", plugins.generate(F.when(ok, F.when(steps, filled(STEPS, **parts)).otherwise(filled(PROMPT, **parts))), generator))
    rows = saved(rows)
    # where a strategy's answer is not valid the general one follows; where that refuses, it is told again
    good = F.coalesce(classify.valid_answer(F.col("first"), F.col("intent")), F.lit(False))
    special = direct | steps
    plain = {**parts, "context": F.col("context")}
    rows = rows.withColumn("second", plugins.generate(F.when(ok & special & ~good, filled(PROMPT, **plain)), generator))
    rows = saved(rows.withColumn("general", F.when(special, F.col("second")).otherwise(F.col("first"))).withColumn("good", good).withColumn("special", special))
    special, good, general = F.col("special"), F.col("good"), F.col("general")
    rows = rows.withColumn("third", plugins.generate(F.when(ok & ~(special & good) & classify.is_refusal(general), filled(AGAIN, **plain)), generator))
    retried = F.when((F.coalesce("third", F.lit("")) != "") & ~classify.is_refusal(F.col("third")), F.col("third")).otherwise(general)
    answer = F.when(special & good, F.col("first")).otherwise(retried)
    rows = saved(rows.withColumn("answer", answer))
    answer = F.col("answer")
    mode = F.when(direct & good, F.concat(F.lit("llm_direct_"), "intent")).when(steps & good, "procedural_synthesis").otherwise("llm_generation")
    masked = F.trim(classify.sanitized(answer, most=None)["text"])
    none = F.array().cast("array<string>")
    no_sources = F.array().cast(kept_sources := "array<struct<filename: string, page_number: int, source_url: string>>")
    done = rows.select(
        F.col("own").alias("id"),
        F.when(~ok, NOTHING).otherwise(F.coalesce(masked, F.lit(FAILED))).alias("answer"),
        F.when(ok & answer.isNotNull(), F.coalesce(F.col("sources").cast(kept_sources), no_sources)).otherwise(no_sources).alias("sources"),
        F.coalesce("contexts", none).alias("contexts"),
        F.col("flags").alias("safety_flags"),
        F.when(ok & answer.isNotNull(), mode).alias("answer_mode"),
    )
    refused = checked.where("blocked").select(F.col("own").alias("id"), F.lit(BLOCKED).alias("answer"), no_sources.alias("sources"), none.alias("contexts"), F.col("flags").alias("safety_flags"), F.lit(None).cast("string").alias("answer_mode"))
    return done.unionByName(refused)


def plain_answers(asked: DataFrame, passages: DataFrame, generator: Callable = quoting, k: int = 5) -> DataFrame:
    """(id, answer, sources): the baseline: the k nearest passages by vector alone, told a generator."""
    near = saved(retrieval.nearest(passages, asked.select(F.col("id").alias("query"), retrieval.embedding(F.col("question")).alias("vec")), k, "id", "vec"))
    found = near.join(passages.drop("vec"), "id")
    rows = asked.select(F.col("id").alias("query"), "question").join(context(found), "query", "left").join(sources(found), "query", "left")
    prompt = filled(STEPS, question=F.col("question"), context=F.col("context"))
    return rows.select(F.col("query").alias("id"), plugins.generate(prompt, generator).alias("answer"), "sources")
