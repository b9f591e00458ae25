"""Where a chunk stands on its pages: similarity of sorted words over windows of lines."""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence: one row of the table is one integer's bits."""
    at: dict[str, int] = defaultdict(int)
    for i, c in enumerate(a):
        at[c] |= 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & at.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def sorted_ratio(a: str, b: str) -> float:
    """0 to 100: twice the common letters of both texts with their words in order, over all letters; 100 for two empty ones."""
    a, b = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    return 200.0 * common(a, b) / (len(a) + len(b)) if a or b else 100.0


def best_window(page: str | None, chunk: str, lines: int = 5) -> tuple[float, str]:
    """The first window of so many lines that is most like the chunk; nothing (0) on an empty page."""
    rows = [x for x in (" ".join(y.lower().split()) for y in (page or "").splitlines()) if x]
    best = 0.0, ""
    for i in range(len(rows)):
        window = " ".join(rows[i : i + lines])
        score = sorted_ratio(chunk, window)
        if score > best[0]:
            best = score, window
    return best


def align(chunks: DataFrame, pages: DataFrame, lines: int = 5) -> DataFrame:
    """chunks (id, doc, page, chunk) with the best of the pages before, at and after (doc, page, text).

    Returns id, score, best_page, window; ties go to the earlier page. A chunk none of whose pages exist keeps its
    page and scores 0. Null chunks count as empty. (doc, page) is unique in pages.
    """

    @F.pandas_udf("score double, text string")
    def window(page: pd.Series, chunk: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([best_window(p, c, lines) for p, c in zip(page, chunk, strict=True)], columns=["score", "text"])

    near = F.explode(F.sequence(F.greatest(F.lit(1), F.col("page") - 1), F.col("page") + 1))
    wanted = chunks.select("id", "doc", F.col("page").alias("own"), F.lower(F.trim(F.regexp_replace(F.coalesce("chunk", F.lit("")), r"\s+", " "))).alias("chunk"), near.alias("page"))
    found = wanted.join(pages.select("doc", "page", "text"), ["doc", "page"]).select("id", "page", window("text", "chunk").alias("w"))
    best = found.groupBy("id").agg(F.max_by(F.struct("page", "w"), F.struct("w.score", -F.col("page"))).alias("b"))
    out = chunks.select("id", "page").join(best, "id", "left")
    return out.select("id", F.coalesce("b.w.score", F.lit(0.0)).alias("score"), F.coalesce("b.page", "page").alias("best_page"), F.coalesce("b.w.text", F.lit("")).alias("window"))
