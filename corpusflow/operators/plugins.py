"""Places for models: text generators and pair scorers as Arrow-batched functions, and what is built on them.

A generator maps a Series of prompts to a Series of texts, a scorer two Series (questions, texts) to a Series of
numbers. They run on the executors, so they must be importable or picklable there and load their model lazily.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import json_object

log = logging.getLogger(__name__)
#: What a refused answer says.
REFUSALS = ["non è presente", "non emerge", "non ho trovato informazioni", "non è specificato", "mi dispiace"]
#: What to do with a chunk, by the type of its document.
REWRITING = {
    "table": "Converti la tabella in elenco strutturato discorsivo.",
    "slide": "Unisci i punti elenco in un discorso fluido e completo.",
    "web_content": "Riscrivi questo testo estratto da una pagina web in italiano professionale. Mantieni SEMPRE invariati: indirizzi email, URL, numeri di telefono, nomi propri, sigle tecniche e scadenze temporali. Elimina navigazione, breadcrumb e testi di menu non informativi.",
}
REWRITING_DEFAULT = "Riscrivi in italiano professionale mantenendo i dati tecnici."


def generate(prompt: Column, generator: Callable[[pd.Series], pd.Series]) -> Column:
    """The generator's texts; null where the prompt is null or the generator failed on the batch."""

    @F.pandas_udf("string")
    def call(prompts: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(prompts), index=prompts.index, dtype=object)
        asked = prompts[prompts.notna()]
        if len(asked):
            try:
                out.loc[asked.index] = list(generator(asked))
            except Exception:  # a model's failure is not the plan's: callers have a default for null
                log.warning("a generator failed on %d prompts", len(asked), exc_info=True)
        return out

    return call(prompt)


def moderated(text: Column, moderator: Callable[[pd.Series], pd.Series]) -> Column:
    """A struct of toxic and failed: the moderator's verdict on each text (true or false), and whether it gave none. A text that it fails on
    passes: toxic is false there. Null texts are not asked about."""

    @F.pandas_udf("toxic boolean, failed boolean")
    def call(texts: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"toxic": False, "failed": False}, index=texts.index)
        asked = texts[texts.notna()]
        if len(asked):
            try:
                said = list(moderator(asked))
                if len(said) != len(asked):
                    raise ValueError(f"{len(said)} verdicts on {len(asked)} texts")
                out.loc[asked.index, "failed"] = [x is None or x != x for x in said]
                out.loc[asked.index, "toxic"] = [x == x and bool(x) for x in said]
            except Exception:  # a moderation that is down lets texts pass, flagged
                log.warning("a moderator failed on %d texts", len(asked), exc_info=True)
                out.loc[asked.index, "failed"] = True
        return out

    return call(text)


#: What a generator is told to describe a passage, and to put a question in other words.
DESCRIBE = 'Descrivi il testo. Rispondi solo con un oggetto JSON: {"summary": "una frase", "keywords": ["al massimo cinque"], "topic": "tema principale"}\n\nTESTO:\n'
REPHRASE = "Riscrivi la domanda per la ricerca nei documenti: una sola riga, senza commenti.\n\nDOMANDA: "


def described(chunk: Column, generator: Callable[[pd.Series], pd.Series]) -> Column:
    """A struct of summary, keywords and topic of a passage, out of the JSON in the generator's text; N/A and no keywords where it gives none."""
    answer = generate(F.when(F.trim(F.coalesce(chunk, F.lit(""))) != "", F.concat(F.lit(DESCRIBE), chunk)), generator)
    said = json_object(answer, "summary string, keywords array<string>, topic string")
    word = lambda c: F.coalesce(F.nullif(F.trim(said[c]), F.lit("")), F.lit("N/A")).alias(c)
    words = F.filter(F.transform(said["keywords"], lambda w: F.trim(w)), lambda w: w.isNotNull() & (w != ""))
    return F.struct(word("summary"), F.coalesce(words, F.array().cast("array<string>")).alias("keywords"), word("topic"))


def rephrased(question: Column, generator: Callable[[pd.Series], pd.Series]) -> Column:
    """The question as the generator puts it, its first line that isn't empty; as it is where the generator gives none."""
    lines = F.filter(F.transform(F.split(generate(F.concat(F.lit(REPHRASE), question), generator), r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(F.try_element_at(lines, F.lit(1)), question)


def variants(response: Column) -> Column:
    """Reformulations in a response, split on three pipes, trimmed, empty ones left out; null gives none."""
    parts = F.transform(F.split(response, r"\|\|\|"), lambda x: F.trim(x))
    return F.coalesce(F.filter(parts, lambda x: x != ""), F.array().cast("array<string>"))


def rewrite(chunk: Column, doc_type: Column, generator: Callable[[pd.Series], pd.Series]) -> Column:
    """Chunks rewritten; those under 50 letters become empty, those the generator fails on stay as they are."""
    told = F.coalesce(*[F.when(doc_type == k, v) for k, v in REWRITING.items()], F.lit(REWRITING_DEFAULT))
    long = F.length(F.trim(F.coalesce(chunk, F.lit("")))) >= 50
    prompt = F.when(long, F.concat(told, F.lit('\n\nTESTO:\n"""'), chunk, F.lit('"""')))
    return F.when(long, F.coalesce(F.trim(generate(prompt, generator)), chunk)).otherwise("")


def scored(candidates: DataFrame, scorer: Callable[[pd.Series, pd.Series], pd.Series], k: int = 5, min_score: float | None = None, letters: int = 2048) -> DataFrame:
    """The k best of each query's candidates (query, id, rank, question, content) by the scorer, with `score` and a new `rank`.

    The scorer sees the first `letters` letters of a text. Equal scores keep the order they had. Where it fails on any
    candidate of a query (or gives no number), that query keeps its order, with scores 0 and no threshold.
    """

    @F.pandas_udf("double")
    def call(question: pd.Series, content: pd.Series) -> pd.Series:
        try:
            return pd.Series(list(scorer(question, content)), index=question.index, dtype="float64")
        except Exception:  # the whole query then keeps its order
            log.warning("a scorer failed on %d pairs", len(question), exc_info=True)
            return pd.Series([None] * len(question), index=question.index, dtype="float64")

    raw = candidates.withColumn("_s", F.nanvl(call("question", F.substring("content", 1, letters)), F.lit(None)))
    per = Window.partitionBy("query")
    seen = raw.withColumn("_failed", F.max(F.col("_s").isNull()).over(per)).withColumn("score", F.when(F.col("_failed"), 0.0).otherwise(F.col("_s")))
    if min_score is not None:
        seen = seen.where(F.col("_failed") | (F.col("score") >= min_score))
    seen = seen.withColumnRenamed("rank", "_was")
    ranked = seen.withColumn("rank", F.row_number().over(per.orderBy(F.col("score").desc(), "_was", "id")))
    return ranked.where(F.col("rank") <= k).drop("_s", "_failed", "_was")


def is_failed(answer: Column, sources: Column) -> Column:
    """True for an answer without sources, or one that refuses."""
    low = F.lower(F.coalesce(answer, F.lit("")))
    said = F.lit(False)
    for phrase in REFUSALS:
        said = said | low.contains(phrase)
    return (F.coalesce(F.size(sources), F.lit(0)) <= 0) | said


def with_retry(asked: DataFrame, run: Callable[[DataFrame], DataFrame], expanded: Column) -> DataFrame:
    """Answers of asked (id, question), the failed ones asked again in their expanded form; `path` tells the attempts.

    run maps (id, question) to (id, answer, sources); a row it leaves out has failed. Where the second attempt fails
    too, the first answer stays. id is unique in asked. run is planned twice: the second time on failed rows only.
    """
    first = asked.join(run(asked.select("id", "question")), "id", "left").withColumn("_failed", is_failed(F.col("answer"), F.col("sources")))
    again = run(first.where("_failed").select("id", expanded.alias("question"))).select("id", F.col("answer").alias("_answer"), F.col("sources").alias("_sources"))
    both = first.join(again, "id", "left")
    better = F.col("_failed") & ~is_failed(F.col("_answer"), F.col("_sources"))
    path = F.when(~F.col("_failed"), F.array(F.lit("initial"))).when(better, F.array(*map(F.lit, ("initial", "retry_same_query")))).otherwise(F.array(*map(F.lit, ("initial", "retry_same_query", "not_found"))))
    return both.select("id", "question", F.when(better, F.col("_answer")).otherwise(F.col("answer")).alias("answer"), F.when(better, F.col("_sources")).otherwise(F.col("sources")).alias("sources"), path.alias("path"))
