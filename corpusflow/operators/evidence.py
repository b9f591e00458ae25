"""Evidence for an answer: groups of documents, their hard facts, conflicts between them, lines that state them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon

KINDS = ("emails", "phones", "times")


def atoms(content: Column) -> Column:
    """Structs of kind and value: the distinct addresses, telephone numbers and durations (number and unit) in a text."""
    text = F.coalesce(content, F.lit(""))
    every = lambda pattern, group: F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    spans = F.zip_with(every(lexicon.DURATION, 1), every(lexicon.DURATION, 2), lambda n, unit: F.concat(n, F.lit(" "), unit))
    found = (every(lexicon.EMAIL, 0), every(lexicon.PHONE, 1), spans)
    of = lambda values, kind: F.transform(F.array_distinct(values), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    return F.concat(*[of(values, kind) for values, kind in zip(found, KINDS, strict=True)])


def groups(docs: DataFrame, by: list[str], id_col: str, text_col: str) -> DataFrame:
    """For each group: docs, distinct values of each kind, and whether it suffices: two documents at least, no kind with two values.

    Values are made distinct on the map side; no group's texts are gathered.
    """
    rows = docs.select(*by, F.col(id_col).alias("_id"), F.explode_outer(atoms(F.col(text_col))).alias("_a"))
    values = rows.select(*by, "_id", "_a.kind", "_a.value").distinct()
    counted = values.groupBy(*by).agg(F.count_distinct("_id").alias("docs"), *[F.count_distinct(F.when(F.col("kind") == k, F.col("value"))).alias(k) for k in KINDS])
    return counted.withColumn("sufficient", (F.col("docs") >= 2) & (F.greatest(*KINDS) <= 1))


def stated(docs: DataFrame, by: list[str], id_col: str, text_col: str) -> DataFrame:
    """The distinct lines of each group that state an atom, with the document and line where each is first seen."""
    lines = docs.select(*by, F.col(id_col).alias("_id"), F.posexplode(F.split(text_col, "\n")).alias("_pos", "_line")).withColumn("line", F.trim("_line"))
    kept = lines.where((F.col("line") != "") & (F.size(atoms(F.col("line"))) > 0))
    first = kept.groupBy(*by, "line").agg(F.min(F.struct("_id", "_pos")).alias("_f"))
    return first.select(*by, "line", F.col("_f._id").alias("first_doc"), F.col("_f._pos").cast("long").alias("first_line"))


def by_concept(docs: DataFrame, concepts: str, scope: str, id_col: str, text_col: str) -> DataFrame:
    """groups of documents by (concept, scope): a document is in the group of each of its concepts."""
    return groups(docs.select(F.explode(concepts).alias("concept"), F.col(scope).alias("scope"), id_col, text_col), ["concept", "scope"], id_col, text_col)


def answerable(question: Column, content: Column) -> Column:
    """Why a passage may answer a question at once: times, contacts, access; each reason once."""
    q, low = F.lower(question), F.lower(content)
    asks = lambda *words: F.contains(q, F.lit(words[0])) | F.contains(q, F.lit(words[1]))
    has = lambda *kinds: F.exists(atoms(low), lambda a: a["kind"].isin(*kinds))
    shown = F.contains(low, F.lit("visualizza")) | F.contains(low, F.lit("esclusivamente"))
    return F.array_compact(F.array(F.when(asks("orari", "quando") & has("times"), "times"), F.when(asks("assistenza", "contattare") & has("phones", "emails"), "contacts"), F.when(asks("visualizza", "allevamenti") & shown, "access")))
