"""Weights of a ranked candidate in an ensemble of retrievers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import tokens

#: Words of file names that say nothing; add a deployment's own name.
NAME_NOISE = [
    "pdf", "docx", "xlsx", "rev", "def", "min", "man", "2019", "2020", "2021", "2022", "2023", "2024", "2025",
    "01", "02", "03", "vers", "ver", "final", "draft",
]


def rank_score(rank: Column) -> Column:
    """1 for rank 1, less by 0.05 for each further rank, 0 at least."""
    return F.greatest(F.lit(0.0), 1 - (rank - 1) * 0.05)


def definition_boost(definitional: Column, keywords: Column, content: Column) -> Column:
    low = F.lower(content)
    named = F.exists(keywords, lambda k: F.rlike(low, F.concat(F.lit(r"\b\Q"), k, F.lit(r"\E\w*\s*(dell\w+)?\s*:"))))
    first = F.exists(keywords, lambda k: F.startswith(F.trim(low), k))
    return F.when(definitional & named, 1.5).when(definitional & first, 1.2).otherwise(1.0)


def density_boost(keywords: Column, content: Column) -> Column:
    """Short passages that hold two keywords and over half of them."""
    met = F.size(F.array_intersect(keywords, tokens(content)))
    return F.when((F.length(content) < 500) & (met >= 2) & (met / F.size(keywords) > 0.5), 1.3).otherwise(1.0)


def name_boost(keywords: Column, filename: Column, noise: list[str] = NAME_NOISE) -> Column:
    met = F.size(F.array_intersect(keywords, F.array_except(tokens(filename), F.array(*map(F.lit, noise)))))
    return F.when(met >= 2, 1.45).when(met == 1, 1.30).otherwise(1.0)


def length_penalty(question: Column, content: Column) -> Column:
    """Half for passages over 2000 characters that hold none of the question's words of over three letters."""
    terms = F.filter(F.split(F.lower(question), r"\s+"), lambda t: F.length(t) > 3)
    low = F.lower(content)
    missed = (F.size(terms) > 0) & ~F.exists(terms, lambda t: F.contains(low, t))
    return F.when((F.length(content) > 2000) & missed, 0.5).otherwise(1.0)


def allowed(question: Column, category: Column) -> Column:
    """Tables of sanctions and checklists only answer questions about them."""
    q = F.lower(question)
    sanctions = F.contains(q, F.lit("sanzion")) | (category != "sanctions_table")
    return F.coalesce(sanctions & (F.contains(q, F.lit("controll")) | F.contains(q, F.lit("check")) | (category != "checklist")), F.lit(True))
